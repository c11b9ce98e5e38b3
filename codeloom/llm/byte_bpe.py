"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pre-tokens of about equal length form a matrix of token ids, padded at the right. In each round every row merges
its leftmost pair of minimum rank; ranks of pairs come from an open-addressing hash table held in two arrays. Rows
without a pair left are written out and the matrix is compacted, by one column a round at least.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from codeloom.llm.chunks import ChunkCache, split_chunks
from codeloom.llm.common import map_rows

NONE = np.int32(2**31 - 1)
#: Rows longer than this take the heap, as a round of the matrix costs a row's whole length.
LONG = 1024
CELLS = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> id of the merged token, or NONE."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.bits = max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        size = 1 << self.bits
        keys, values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        left_k, left_v = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slot, self.probes = self.slots(left_k), 0
        while len(left_k):  # all keys that found a free slot settle; the others move on by one
            self.probes += 1
            free = keys[slot] == -1
            first = np.zeros(len(slot), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            keys[slot[put]], values[slot[put]] = left_k[put], left_v[put]
            left_k, left_v, slot = left_k[~put], left_v[~put], (slot[~put] + 1) & (size - 1)
        self.keys, self.values, self.get1 = keys, values, pairs.get

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; an id under 0 is padding."""
        out = np.full(a.shape, NONE, np.int32)
        todo = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        keys = (a.ravel()[todo].astype(np.int64) << 32) | b.ravel()[todo]
        slot, flat = self.slots(keys), out.ravel()
        while len(todo):
            found = self.keys[slot]
            hit = found == keys
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(a.shape)


class ByteBPE:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = load_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.tokens = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; pieces share a matrix if their lengths share a bucket."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            n = len(p)
            if n > LONG:
                out[i] = self.encode_long(p)
            else:
                buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self.encode_matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def encode_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, pieces), np.int64, n)
        m = np.where(np.arange(width) < size[:, None], self.byte_id[raw], -1)
        rank = self.pairs.get(m[:, :-1], m[:, 1:])
        row, out = np.arange(n), [None] * n
        while len(row):
            if m.shape[1] > 1:
                at = rank.argmin(axis=1)  # the leftmost minimum
                best = rank[np.arange(len(row)), at]
                done = best == NONE
            else:
                done = np.ones(len(row), bool)
            if done.any():
                for i, ids, k in zip(row[done].tolist(), m[done].tolist(), size[done].tolist(), strict=True):
                    out[i] = ids[:k]
                keep = ~done
                row, m, size = row[keep], m[keep], size[keep]
                if not len(row):
                    break
                rank, at, best = rank[keep], at[keep], best[keep]
            every = np.arange(len(row))
            m[every, at] = best
            size -= 1
            width = int(size.max())
            column = np.arange(width)
            m = np.take_along_axis(m, np.minimum(column + (column > at[:, None]), m.shape[1] - 1), 1)
            m[column >= size[:, None]] = -1
            column = column[: width - 1]
            rank = np.take_along_axis(rank, np.minimum(column + (column > at[:, None]), rank.shape[1] - 1), 1)
            rank[column >= size[:, None] - 1] = NONE
            for shift in (-1, 0):  # only the pairs beside the merged token are new
                p = at + shift
                ok = np.flatnonzero((p >= 0) & (p < width - 1))
                rank[ok, p[ok]] = self.pairs.get(m[ok, p[ok]], m[ok, p[ok] + 1])
        return out

    def encode_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get1
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j], k = rank, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def encode_chunks(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Ids of each chunk, each match of the pattern encoded separately; each different match once."""
        found = [self.find(c) for c in chunks]
        missing = list({p for pieces in found for p in pieces if p not in self.known})
        fresh = dict(zip(missing, self.encode_pieces([p.encode() for p in missing]), strict=True))
        known = self.known
        out = [tuple(x for p in pieces for x in (fresh[p] if p in fresh else known[p])) for pieces in found]
        if len(known) > 200_000:
            known.clear()
        known.update((p, tuple(ids)) for p, ids in fresh.items() if len(p) <= 64)
        return out

    def encode(self, text: str) -> list[int]:
        return [x for ids in self.encode_chunks(split_chunks(text)) for x in ids]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each worker process and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBPE(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) for every row; a null text counts as empty and has no ids."""

    def rows(columns):
        bpe = codec(path, pattern)
        for i, t in zip(*columns, strict=True):
            yield [[i], [bpe.encode(t or "")]]

    return map_rows(docs.select("doc_id", text), rows, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, data (binary) of doc_id, ids; null ids decode to no bytes."""

    def rows(columns):
        bpe = codec(path, pattern)
        for i, ids in zip(*columns, strict=True):
            yield [[i], [bpe.decode(ids or ())]]

    return map_rows(encoded.select("doc_id", "ids"), rows, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every row's whole text encoded and its ids decoded again.

    A null text counts as empty: no tokens, digests of the empty string. Rows may repeat; other columns are ignored.
    """

    def rows(columns):
        bpe = codec(path, pattern)
        if not hasattr(bpe, "cache"):
            bpe.cache = ChunkCache(lambda chunks: [(" ".join(map(str, ids)), bpe.decode(ids)) for ids in bpe.encode_chunks(chunks)], most=700_000)
        n, ids_sha, raw_sha = [], [], []
        for made in bpe.cache.of([split_chunks(t or "") for t in columns[1]]):
            ids = " ".join([dec for dec, _ in made])
            n.append(ids.count(" ") + bool(ids))
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            raw_sha.append(hashlib.sha256(b"".join([data for _, data in made])).hexdigest())
        yield [columns[0], n, ids_sha, raw_sha]

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=128)
