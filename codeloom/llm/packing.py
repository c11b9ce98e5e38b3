"""Mixture-controlled packing.

Each source is a queue of token streams. Windows of a fixed number of sequences are filled by deficit round-robin over a
tree whose leaves are the queues: what a node may send in a window is shared by its two sides, whose deficit counters grow
by their shares; the left side sends the whole units that its counter holds, the right side the rest, and what is left of a
counter is carried to the next window. The counters after any number of windows have a closed form, so every document finds
its windows alone, in any partition, from the tokens before it in its queue.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm.common import map_rows, materialise

END = 0
PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
#: Texts with so many characters in a row without white space inside (or with nothing else) take the tokenizer itself.
WINDOW = 1000
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The ids that a tokenizer file gives a text, as little-endian 16-bit numbers.

    A byte-level BPE file whose ids are in the order of its merges is one that tiktoken can read: it encodes most texts,
    several times faster and to the same ids. Texts that hold an added token's string or a very long run, and any other
    kind of file, take the tokenizers library.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer don't fit 16 bits")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        ranks = ranks_in_order(made, set(self.added))
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def plain(self, text: str) -> bool:
        """Whether tiktoken may encode the text."""
        if self.fast is None or any(t in text for t in self.added):
            return False
        return all(len(text[k : k + WINDOW].split(None, 1)) == 2 for k in range(0, len(text) - WINDOW + 1, WINDOW))

    def of(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u2").tobytes() if self.plain(t) else None for t in texts]
        slow = [k for k, m in enumerate(out) if m is None]
        for k, e in zip(slow, self.tokenizer.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, "<u2").tobytes()
        return out


def ranks_in_order(made: dict, added: set[str]) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level BPE tokenizer whose merges make ids one after another, else None."""
    model, before = made["model"], made["pre_tokenizer"] or {}
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    simple = made["normalizer"] is None and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if model.get("type") != "BPE" or not byte_level or not simple:
        return None
    # In such a file a printable byte stands for itself, and the others for the characters from 256 on, in order.
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    code = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ids = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [ids.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if not all(set(t) <= code.keys() for t in ids) or sorted(merged) != merged or len(ids) != len(merged) + 256:
        return None
    return {bytes(code[c] for c in t): i for t, i in ids.items()}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenise(docs: DataFrame, path: str, source: str = "source") -> DataFrame:
    """doc_id, source, ids (little-endian 16-bit numbers, END last), n_tokens, copy; a null text counts as empty.

    copy numbers the rows of a batch that are equal, so that a row that is repeated very often can be dealt out; else it is 0.
    """

    def rows(columns):
        ids, sources, texts = columns
        made = [m + END.to_bytes(2, "little") for m in encoder(path).of([t or "" for t in texts])]
        seen: Counter = Counter()
        copies = []
        for key in zip(ids, made, strict=True):
            copies.append(seen[key])
            seen[key] += 1
        yield [ids, sources, made, [len(m) // 2 for m in made], copies]

    return map_rows(docs.select("doc_id", F.col(source).alias("source"), "text"), rows, "doc_id long, source string, ids binary, n_tokens long, copy int", rows=128)


#: Ways down the tree: at each node whether to the right, and the units of its left side and of both.
Path = list[tuple[bool, int, int]]


@dataclass
class Turn:
    """What a class of queues sends in a phase, in units: its path among the classes, what it sent before, what it sends, and the phase's all and start."""

    path: Path
    first: int
    own: int
    total: int
    base: int


def turns(sizes: list[int], weights: list[float]) -> list[list[Turn]]:
    """For each class its phases: shares of a window go by weight, and a phase ends when a class is empty.

    Classes of weight 0 wait until all others are empty, and then go by their sizes.
    """
    if any(w < 0 for w in weights):
        raise ValueError("weights are 0 or more")
    sent, out, base = [0] * len(sizes), [[] for _ in sizes], 0
    while left := [c for c in range(len(sizes)) if sent[c] < sizes[c]]:
        weighted = {c: Fraction(weights[c]) for c in left if weights[c]}
        if weighted:
            ends = min(weighted, key=lambda c: (sizes[c] - sent[c]) / weighted[c])
            turn = (sizes[ends] - sent[ends]) / weighted[ends]
            now = {c: sizes[c] - sent[c] if c == ends else int(turn * w) for c, w in weighted.items()}
        else:
            now = {c: sizes[c] - sent[c] for c in left}
        total = rest = sum(now.values())
        passed: Path = []
        for c, n in now.items():
            if n:
                own = [(False, n, rest)] if n < rest else []
                out[c].append(Turn([*passed, *own], sent[c], n, total, base))
                passed, rest, sent[c] = [*passed, (True, n, rest)], rest - n, sent[c] + n
        base += total
    return out


@dataclass
class Queue:
    """A source's tokens as they are sent: whole units by the turns of its class, and what doesn't fill a unit after all else, at `tail`."""

    turns: list[Turn]
    path: Path
    units: int
    tail: int
    window: int
    unit: int

    def sent(self, turn: Turn, w: int) -> tuple[int, int]:
        """Units of the queue, and of all queues before it, that are sent before window w of a turn."""
        a, earlier = min(w * self.window, turn.total), 0
        for path, first in ((turn.path, turn.first), (self.path, 0)):
            for right, left, both in path:
                k = a * left // both
                if right:
                    a, earlier = a - k, earlier + k
                else:
                    a = k
            a += first
        return a, earlier

    def pieces(self, start: int, n: int) -> list[tuple[int, int, int]]:
        """(place in all sequences' tokens, tokens before it in the document, tokens) for n tokens from `start` of the queue."""
        out, unit, whole = [], self.unit, self.units * self.unit
        for turn in self.turns if self.units else []:
            windows = -(-turn.total // self.window)
            lo, hi = max(start, unit * self.sent(turn, 0)[0]), min(start + n, unit * self.sent(turn, windows)[0])
            w = -1
            while lo < hi:
                if w < 0 or unit * self.sent(turn, w + 1)[0] <= lo:
                    w = bisect_right(range(windows), lo // unit, key=lambda x: self.sent(turn, x)[0]) - 1
                (a, before), (b, after) = self.sent(turn, w), self.sent(turn, w + 1)
                k = min(hi, unit * b) - lo
                out.append((unit * (turn.base + min(w * self.window, turn.total) + after - before) + lo - unit * a, lo - start, k))
                lo, w = lo + k, w + 1
                if w >= windows:
                    break
        lo = max(start, whole)
        if lo < start + n:
            out.append((self.tail + lo - whole, lo - start, start + n - lo))
        return out


def sums_before(table: DataFrame, keys: list[str], order: list[str], value: str, name: str, chunk: int = 4096) -> DataFrame:
    """table with name: the sum of value over the rows of its keys that stand before it in order, whose last column is a number from 0.

    Chunks of that number are summed first, so no task orders more than a chunk or the sums of all chunks.
    """
    cut = table.withColumn("__chunk", F.floor(F.col(order[-1]) / chunk).cast("long"))
    sums = cut.groupBy(*keys, "__chunk").agg(F.sum(value).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__opens", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    within = Window.partitionBy(*keys, "__chunk").orderBy(*order[::-1]).rowsBetween(Window.unboundedPreceding, -1)
    added = cut.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return added.join(sums, [*keys, "__chunk"]).withColumn(name, F.col("__opens") + F.col("__own")).drop("__chunk", "__opens", "__own")


def queues(tokens: DataFrame, weights: dict[str, float] | None, block: int, unit: int) -> DataFrame:
    """q, class, units, rest, blocks, before, path: a queue for each source, null included, with its path and the rests before its own.

    Without weights all sources are one class. With weights each source that they name is a class, in their order, and all
    others together are the last one. The sources of a class, numbered by a hash of their names, are the leaves of its tree.
    """
    named = list(weights or {})
    number = F.coalesce(*[F.when(F.col("source") == s, F.lit(k)) for k, s in enumerate(named)], F.lit(len(named)))
    by = tokens.groupBy("source").agg(F.sum("n_tokens").alias("size")).select(
        F.xxhash64(F.lit(3), "source", F.col("source").isNull()).alias("q"), number.alias("class"), F.floor(F.col("size") / unit).cast("long").alias("units"),
        (F.col("size") % unit).alias("rest"), F.ceil(F.col("size") / block).cast("long").alias("blocks"),
    )
    by = materialise(by.withColumn("slot", F.pmod("q", F.lit(1 << 22))), "sources")
    slots = by.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("rest").alias("r"))
    opens = sums_before(sums_before(slots, [], ["slot"], "n", "n_before"), [], ["slot"], "r", "r_before").select("slot", "n_before", "r_before")
    w = Window.partitionBy("slot").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    placed = by.join(opens, "slot").withColumn("leaf", F.col("n_before") + F.coalesce(F.count(F.lit(1)).over(w), F.lit(0))).withColumn("before", F.col("r_before") + F.coalesce(F.sum("rest").over(w), F.lit(0)))
    placed = materialise(placed.select("q", "class", "units", "rest", "blocks", "leaf", "before"), "leaves")
    depth = max(1, (max(placed.count(), 2) - 1).bit_length())
    up = placed.where("units > 0").select("q", "class", "units", F.col("leaf"), F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level"))
    child = F.floor(F.col("leaf") / F.pow(F.lit(2.0), F.lit(depth) - F.col("level"))).cast("long")
    up = up.withColumn("right", child % 2 == 1).withColumn("node", F.floor(child / 2).cast("long"))
    nodes = up.groupBy("class", "level", "node").agg(F.coalesce(F.sum(F.when(~F.col("right"), F.col("units"))), F.lit(0)).alias("left"), F.sum("units").alias("both"))
    ways = up.join(nodes.where("left > 0 and left < both"), ["class", "level", "node"]).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("level", "right", "left", "both"))).alias("path"))  # depth rows at most
    return placed.join(ways, "q", "left").select("q", "class", "units", "rest", "blocks", "before", "path")


#: Sources are broadcast up to this many; beyond it the same join shuffles.
MOST_SOURCES = 200_000


def pack(
    tokens: DataFrame, length: int = 1024, window_sequences: int = 64, weights: dict[str, float] | None = None, block: int = 1 << 18, unit: int = 64
) -> DataFrame:
    """Pieces of tokens (doc_id, source, ids, n_tokens, copy) laid into sequences of `length`: one row a piece.

    Every window holds each source by its share of all tokens. With weights (source -> weight, 0 or more), those that they
    name have these shares for as long as they last, and all other sources have the weight 0: they follow when those are
    empty. A source sends in units of `unit` tokens, which its deficit waits for, so that a small source isn't cut to bits: a
    window is off its targets by two units for each level of the tree at most (the levels are the logarithm of the sources). What doesn't fill a source's last unit comes
    after all else, and only the last sequence is not full. The order within a queue is that of a hash of doc_id and ids;
    rows that repeat are all packed. Queues are numbered in blocks of about `block` tokens, so that no source is sorted in
    one task. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    window = length * window_sequences // unit
    if window * unit != length * window_sequences:
        raise ValueError("a window holds whole units")
    sources = materialise(queues(tokens, weights, block, unit), "queues")
    own = {r["class"]: r.n for r in sources.groupBy("class").agg(F.sum("units").alias("n")).collect()}  # a row for each weight, and one
    plan = turns([own.get(c, 0) for c in range(len(weights or {}) + 1)], [*(weights or {}).values(), 0.0])
    whole = unit * sum(own.values())

    few = sources.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    blocks = sources.select("q", "blocks")
    placed = tokens.withColumn("q", F.xxhash64(F.lit(3), "source", F.col("source").isNull())).join(F.broadcast(blocks) if few else blocks, "q")
    placed = placed.select("doc_id", "ids", "n_tokens", "q", F.pmod(F.xxhash64("doc_id", "ids", "copy"), F.col("blocks")).alias("block"))
    # Tokens before each block of its queue, one row for each, which opens the block below and holds what the queue is.
    sums = placed.groupBy("q", "block").agg(F.sum("n_tokens").alias("n"))
    opens = sums_before(sums, ["q"], ["block"], "n", "opens").drop("n").join(sources.drop("blocks", "rest"), "q")
    joined = placed.unionByName(opens, allowMissingColumns=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions hold whole blocks in order, so a running sum and a queue are all that is held."""
        now, queue = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out: list[tuple] = []
                for i, ids, n, opens, c, units, before, path in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    if opens is not None:  # the first row of a block
                        now = opens
                        queue = Queue(plan[c], [(x["right"], x["left"], x["both"]) for x in path or []], units, whole + before, window, unit)
                        continue
                    for place, skip, k in queue.pieces(now, n):
                        while k:
                            part = min(k, length - place % length)
                            raw = np.frombuffer(ids, "<u2", part, 2 * skip).astype("<u4").tobytes()
                            out.append((i, skip, part, zlib.crc32(raw), n, place // length, place % length))
                            place, skip, k = place + part, skip + part, k - part
                    now += n
                columns = list(zip(*out, strict=True)) if out else [()] * len(PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECES)

    order = ["q", "block", F.col("opens").isNull(), F.xxhash64(F.lit(1), "doc_id"), "doc_id", "ids"]
    dealt = joined.repartition("q", "block").sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids", "n_tokens", "opens", "class", "units", "before", "path").mapInArrow(rows, ", ".join(f"{c} long" for c in PIECES))


def pack_documents(docs: DataFrame, path: str, source: str = "source", length: int = 1024, weights: dict[str, float] | None = None) -> DataFrame:
    """All rows of docs, tokenised once and packed. Null ids stay null, null texts are the end token alone, null sources are a queue of their own."""
    return pack(materialise(tokenise(docs, path, source), "tokens"), length, weights=weights)
