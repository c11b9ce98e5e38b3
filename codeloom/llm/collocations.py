"""Phrases of two to four words that occur together more often than their parts let expect, by language.

Counting goes level by level, and nothing but words is ever held as text. A word is the 64-bit hash of its language and
itself; texts become arrays of codes once. Pairs first count into hashed buckets, numpy arrays that are summed over
the tasks, and only pairs of full buckets are candidates; of three and four words only those are whose two shorter phrases
are frequent (Apriori). Both are asked of a bit array of a bounded size: a bit set by chance lets a rare phrase through,
which is then counted and dropped, so results don't depend on it.

Candidates are routed by hash to classes of a bounded number of occurrences, as many as the data needs. Each class builds a
minimal perfect hash over its candidates and keeps their keys, so that no other phrase counts for one; what a chunk of
texts holds becomes an array by slot, and arrays are summed as a tree. Cuts are looked up in what was counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialise

#: Capitals become small, tabs blanks, and what ends a piece a full stop, which no word holds.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
BREAK = b"."
LONGEST = 4
#: Bytes of a text that are split at once, distinct words that a task counts before it hands them on, tokens of a chunk.
SLICE, MOST_WORDS, CHUNK = 1 << 22, 400_000, 1 << 20
#: Buckets or bits of one slice of an array, of all slices at most, and occurrences of a class.
SLICE_BITS, MOST_BITS, PER_CLASS = 20, 27, 4_000_000
#: Parts of a language whose phrases are ordered apart before they are together.
PARTS = 16
#: Beyond so many words every bucket of pairs is full, so none is counted.
MOST_PAIRED = 1 << 31


def tokens(data: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text and BREAK where a piece ends, in lists of about size bytes that end where a piece does."""
    data, at = data.translate(TABLE), 0
    while at < len(data):
        end = len(data) if len(data) - at <= size else data.find(BREAK, at + size) + 1 or len(data)
        yield data[at:end].replace(BREAK, b" . ").split()
        at = end


def mixed(columns: list[np.ndarray], seed: int) -> np.ndarray:
    """A 64-bit hash of each row of integer columns."""
    h = np.full(len(columns[0]), (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


class PerfectHash:
    """A minimal perfect hash over distinct rows of keys, which it keeps in the order of their slots.

    On each level the keys that are alone in their place of a table twice as large get the next slots; the others go
    on to the next level under another seed.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        left, order = np.arange(len(keys)), []
        while len(left):
            size = max(8, 2 * len(left))
            at = self.places(keys[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            table = np.full(size, -1, np.int32)
            done = sum(map(len, order))
            table[at[alone]] = np.arange(done, done + alone.sum())
            self.levels.append(table)
            order.append(left[alone])
            left = left[~alone]
        self.keys = keys[np.concatenate(order)] if order else keys

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (((mixed(list(keys.T), 1000 + level) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each row of keys; -1 for rows whose key is not the stored one."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, table in enumerate(self.levels):
            found = table[self.places(keys[left], level, len(table))]
            out[left[found >= 0]] = found[found >= 0]
            left = left[found < 0]
        known = np.flatnonzero(out >= 0)
        out[known[(self.keys[out[known]] != keys[known]).any(axis=1)]] = -1
        return out


def distinct_rows(keys: np.ndarray) -> np.ndarray:
    """The distinct rows, by a hash that tells all of them apart."""
    for seed in range(64):
        _, first, group = np.unique(mixed(list(keys.T), seed), return_index=True, return_inverse=True)
        if (keys[first][group] == keys).all():
            return keys[first]
    raise ValueError("no seed tells the keys apart")


def tree_sum(arrays: list[np.ndarray]) -> np.ndarray:
    """The sum of arrays, pair by pair."""
    while len(arrays) > 1:
        arrays = [a + b for a, b in zip(arrays[::2], arrays[1::2], strict=False)] + arrays[len(arrays) // 2 * 2 :]
    return arrays[0]


def blobs(group: np.ndarray, *columns: np.ndarray) -> list:
    """Rows parted by group: its values, and for each column the bytes of each part; the rows come sorted by group."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    out = [pa.array(group[first].astype(np.int64))]
    for c in columns:
        raw = np.ascontiguousarray(c)
        offsets = np.r_[first, len(group)].astype(np.int64) * (raw.nbytes // max(1, len(group)))
        out.append(pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary()))
    return out


# Bit arrays


class Bits:
    """A bit array by hash, in slices; without any, all bits are set."""

    def __init__(self, bits: int, level: int, slices: dict[int, bytes] | None):
        self.bits, self.level = bits, level
        self.packed = None
        if slices is not None:
            self.packed = np.zeros(1 << max(bits - 3, 0), np.uint8)
            for k, b in slices.items():
                at = k << (SLICE_BITS - 3)
                self.packed[at : at + len(b)] = np.frombuffer(b, np.uint8)

    def places(self, columns: list[np.ndarray]) -> np.ndarray:
        return (mixed(columns, self.level) >> np.uint64(64 - self.bits)).astype(np.int64)

    def hold(self, columns: list[np.ndarray]) -> np.ndarray:
        if self.packed is None:
            return np.ones(len(columns[0]), bool)
        at = self.places(columns)
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def bits_for(n: int) -> int:
    """The logarithm of the size of a bit array, about n bits, from one slice to all."""
    return min(MOST_BITS, max(SLICE_BITS, int(n).bit_length()))


def summed(places: DataFrame, bits: Bits, least: int) -> Bits:
    """bits with those places set that places (slice, low, n) have at least `least` times in all; a slice is one array."""

    def run(table: pa.Table) -> pa.Table:
        arrays = []
        for low, n in zip(table["low"].to_pylist(), table["n"].to_pylist(), strict=True):
            arrays.append((np.frombuffer(low, np.uint32), np.frombuffer(n, np.uint8)))
        total = np.zeros(1 << SLICE_BITS, np.int64)
        for k in range(0, len(arrays), 16):  # few places of many: their counts are summed as one array
            low, n = (np.concatenate(x) for x in zip(*arrays[k : k + 16], strict=True))
            total += np.bincount(low, weights=n, minlength=len(total)).astype(np.int64)
        return pa.table({"slice": table["slice"][:1], "packed": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    rows = places.groupBy("slice").applyInArrow(run, "slice long, packed binary").collect()  # at most 2 ** MOST_BITS bits in all
    return Bits(bits.bits, bits.level, {r.slice: bytes(r.packed) for r in rows})


def place_rows(at: np.ndarray) -> pa.RecordBatch:
    """Places as rows of summed: each distinct one with its number, 255 at most."""
    at, n = np.unique(at, return_counts=True)
    columns = blobs(at >> SLICE_BITS, (at & ((1 << SLICE_BITS) - 1)).astype(np.uint32), np.minimum(n, 255).astype(np.uint8))
    return pa.RecordBatch.from_arrays(columns, names=["slice", "low", "n"])


PLACES = "slice long, low binary, n binary"


def bits_of(phrases: DataFrame, level: int, n: int) -> Bits:
    """The bit array of n phrases (ws: array of `level` words)."""
    bits = Bits(bits_for(16 * n), level, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ws = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, level)
                yield place_rows(bits.places(list(ws.T)))

    return summed(phrases.select("ws").mapInArrow(run, PLACES), bits, 1)


# Words


def word_counts(docs: DataFrame, most: int = MOST_WORDS, size: int = SLICE) -> DataFrame:
    """lang, word, n of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def handed_on() -> pa.RecordBatch:
            lang, word, n = [], [], []
            for name, found in counts.items():
                found.pop(BREAK, None)
                lang += [name] * len(found)
                word += found.keys()
                n += found.values()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                found = counts.setdefault(lang, Counter())
                for part in tokens(text.as_py(), size):
                    found.update(part)
                    if len(found) > most:
                        yield handed_on()
                        found = counts.setdefault(lang, Counter())
            if sum(map(len, counts.values())) > most:
                yield handed_on()
        yield handed_on()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_hash(lang: Column, word: Column, seed: int) -> Column:
    return F.xxhash64(F.concat(F.lit(str(seed)), lang), word)


class Codes(dict):
    """Words of one language with their codes in a chunk; new ones are numbered and their hashes kept."""

    def __init__(self, lang: str, seed: int, hashes: list[int]):
        super().__init__({BREAK: 0})
        self.hashes, self.seed = hashes, xxhash.xxh64_intdigest(f"{seed}{lang}".encode(), 42)

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        code = self[word] = len(self.hashes)
        return code


def coded(docs: DataFrame, frequent: Bits, seed: int, chunk: int = CHUNK, size: int = SLICE) -> DataFrame:
    """words (hashes), codes: chunks of texts as codes of their frequent words, from 1; 0 stands for what parts them."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []
        known: dict[str, Codes] = {}
        parts: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            words = np.array(hashes, np.uint64).view(np.int64)
            stay = sent.value.hold([words]) if len(words) else np.zeros(0, bool)
            number = np.r_[0, np.where(stay, np.cumsum(stay), 0)].astype(np.int32)
            codes = number[np.concatenate(parts)]
            codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
            hashes.clear(), known.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([words[stay].tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], names=["words", "codes"])

        held = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                of = known.get(lang)
                for part in tokens(text.as_py(), size):
                    if of is None:
                        of = known[lang] = Codes(lang, seed, hashes)
                    parts.append(np.fromiter(map(of.__getitem__, part), np.int32, len(part)))
                    parts.append(np.zeros(1, np.int32))
                    held += len(part) + 1
                    if held > chunk:
                        yield made()
                        held, of = 0, None
        if parts:
            yield made()

    return docs.mapInArrow(run, "words binary, codes binary")


# Phrases


def windows(words: bytes, codes: bytes, k: int, shorter: Bits) -> tuple[np.ndarray, np.ndarray, int]:
    """Where k words stand whose two phrases of k - 1 words may be frequent: places and codes, and the number of codes."""
    v = np.r_[np.int64(0), np.frombuffer(words, np.int64)]
    c = np.frombuffer(codes, np.int32)
    whole = c != 0
    if k > 2:  # for two words, each is frequent as it has a code
        at = np.flatnonzero(np.logical_and.reduce([whole[j : len(c) - k + 2 + j] for j in range(k - 1)])) if len(c) >= k - 1 else np.zeros(0, np.int64)
        whole = np.zeros(max(len(c) - k + 2, 0), bool)
        whole[at[shorter.hold([v[c[at + j]] for j in range(k - 1)])]] = True
    return np.flatnonzero(whole[:-1] & whole[1:]), c, v


def phrase_counts(ids: DataFrame, k: int, shorter: Bits | None, pairs: Bits | None, classes: int, least: int) -> DataFrame:
    """ws, f: the phrases of k words that occur at least `least` times."""
    sent = ids.sparkSession.sparkContext.broadcast((shorter, pairs))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, pairs = sent.value
        for b in batches:
            for words, codes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, c, v = windows(words, codes, k, shorter)
                number = c[at].astype(np.int64)
                for j in range(1, k):  # every phrase of the chunk gets a number of its own
                    if j > 1:
                        number = np.unique(number, return_inverse=True)[1]
                    number = number * len(v) + c[at + j]
                _, first, n = np.unique(number, return_index=True, return_counts=True)
                keys = np.stack([v[c[at[first] + j]] for j in range(k)], axis=1)
                if pairs is not None:
                    full = pairs.hold(list(keys.T))
                    keys, n = keys[full], n[full]
                own = (mixed(list(keys.T), 77) % np.uint64(classes)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                yield pa.RecordBatch.from_arrays(blobs(own[order], keys[order], n[order].astype(np.uint32)), names=["own", "keys", "n"])

    def counted(table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(a, np.int64).reshape(-1, k), np.frombuffer(b, np.uint32)) for a, b in zip(table["keys"].to_pylist(), table["n"].to_pylist(), strict=True)]
        by_slot = PerfectHash(distinct_rows(np.concatenate([a for a, _ in parts])))
        size = len(by_slot.keys)
        total, step = np.zeros(size, np.int64), []
        for at in range(0, len(parts), 64):  # arrays of a class are as long as its candidates, so few are held at once
            step = []
            for some in range(at, min(at + 64, len(parts)), 8):
                keys, n = (np.concatenate(x) for x in zip(*parts[some : some + 8], strict=True))
                slot = by_slot.slots(keys)
                step.append(np.bincount(slot[slot >= 0], weights=n[slot >= 0], minlength=size).astype(np.int64))
            total += tree_sum(step)
        full = total >= least
        ws = by_slot.keys[full]
        return pa.table({"ws": pa.ListArray.from_arrays(np.arange(0, ws.size + 1, k, dtype=np.int32), ws.ravel()), "f": total[full]})

    return ids.mapInArrow(found, "own long, keys binary, n binary").groupBy("own").applyInArrow(counted, "ws array<long>, f long")


def full_pairs(ids: DataFrame, n_words: int, least: int) -> Bits:
    """The buckets of pairs that hold at least `least` occurrences; all of them where too many words fill every bucket."""
    bits = Bits(bits_for(n_words), 2_000, None)
    if n_words > MOST_PAIRED:
        return bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, codes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, c, v = windows(words, codes, 2, None)
                yield place_rows(bits.places([v[c[at]], v[c[at + 1]]]))

    return summed(ids.mapInArrow(run, PLACES), bits, least)


def count_phrases(docs: DataFrame, least: int, per_class: int = PER_CLASS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (h, lang, word); frequent phrases of one to four words (ws: hashes, f); and lang, n: all words of each language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = materialise(word_counts(texts), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    for seed in range(64):  # frequent words have hashes of their own
        words = counts.where(F.col("n") >= least).select(word_hash(F.col("lang"), F.col("word"), seed).alias("h"), "lang", "word", F.col("n").alias("f"))
        if words.groupBy("h").count().where("count > 1").isEmpty():
            break
    words = materialise(words, "frequent")
    n_words, n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], words.count()
    phrases = words.select(F.array("h").alias("ws"), "f")
    bits = bits_of(phrases, 1, n)
    ids = materialise(coded(texts, bits, seed), "codes")
    pairs = full_pairs(ids, n_words, least)
    classes = max(1, -(-n_words // per_class))
    for k in range(2, LONGEST + 1):
        made = materialise(phrase_counts(ids, k, bits if k > 2 else None, pairs if k == 2 else None, classes, least), "phrases")
        phrases = phrases.unionByName(made)
        if k < LONGEST:
            bits = bits_of(made, k, made.count())
    return words.select("h", "lang", "word"), phrases, totals


def mine(docs: DataFrame, least: int = 30, share: int = 80, most: int = 2_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `most` phrases, as they score at their lowest-scoring cut.

    A phrase occurs `least` times or more; cut after k words, its score is floor(2000000 a / (l + r)) of its own
    occurrences and those of both parts, and of equal scores the smallest k counts. A phrase goes that stands in a longer
    one with `share` percent of its occurrences or more. Ties go by a, then by the phrase's bytes. A null language is `und`,
    a null text is empty; rows that repeat count as often as they stand, and other columns are ignored. Counts are exact but
    for a rare word with the 64-bit hash of a frequent one.
    """
    words, phrases, totals = count_phrases(docs, least)
    long = phrases.where(F.size("ws") > 1).withColumnRenamed("f", "a")
    part = lambda at, n: F.slice("ws", at, n)
    cuts = long.select("ws", "a", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.select("ws", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("ws") - F.col("k")).alias("rest"))
    cuts = cuts.join(phrases.select(F.col("ws").alias("first"), F.col("f").alias("l")), "first").join(phrases.select(F.col("ws").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr("(cast(a as decimal(28, 0)) * 2000000) div (cast(l as decimal(28, 0)) + r)")
    best = cuts.groupBy("ws", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    within = long.where(F.size("ws") > 2).select("ws", "a", F.explode(F.sequence(F.lit(2), F.size("ws") - 1)).alias("size"))
    within = within.select("ws", "a", "size", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1)).alias("at")).select("a", part(F.col("at"), F.col("size")).alias("ws"))
    kept = best.join(within.groupBy("ws").agg(F.max("a").alias("longer")), "ws", "left").where(F.expr("longer is null or cast(longer as decimal(28, 0)) * 100 < cast(a as decimal(28, 0)) * " + str(share)))
    for k in range(1, LONGEST + 1):
        own = words.select(F.col("h").alias("h"), F.col("word").alias(f"w{k}"), *([F.col("lang")] if k == 1 else []))
        kept = kept.withColumn("h", F.try_element_at("ws", F.lit(k))).join(own, "h", "left").drop("h")
    kept = kept.join(totals, "lang")
    phrase = F.concat_ws(" ", *[f"w{k}" for k in range(1, LONGEST + 1)])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = kept.select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # The first of a language are among the first of its parts, so no task orders a whole language.
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by counting every phrase.
ORACLE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS ws FROM words, range(1, 5) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, ws, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::bigint AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, ws, f AS a FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.ws, c.k, a, j, x.f AS l, y.f AS r, ((a::hugeint * 2000000) // (x.f + y.f))::bigint AS score
  FROM c, range(1, 4) t(j) JOIN f x ON x.lang = c.lang AND x.ws = list_slice(c.ws, 1, j) JOIN f y ON y.lang = c.lang AND y.ws = list_slice(c.ws, j + 1, c.k) WHERE j < c.k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
inner_ AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda n: list_transform(range(1, k - n + 2), lambda i: list_slice(ws, i, i + n - 1))))) AS ws FROM c WHERE k > 2),
longer AS (SELECT lang, ws, max(a) AS longer FROM inner_ GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM (SELECT best.lang, array_to_string(best.ws, ' ') AS phrase, a, l, r, n, score FROM best JOIN totals USING (lang) LEFT JOIN longer ON longer.lang = best.lang AND longer.ws = best.ws
  WHERE longer IS NULL OR longer::hugeint * 100 < a::hugeint * 80)
QUALIFY rank <= 2000"""
