"""Exact n-gram Jaccard join as a join in metric space.

Jaccard distance is a metric, and documents of a large corpus lie at distance 1 from nearly every other document, so
pivots drawn from the documents would put nearly all of them on every border. The pivots here are single shingles, as
one-element sets: they are nearer than 1 to exactly the documents that hold them. A document joins the region of every
pivot that a partner within the threshold could share as its first one in a fixed order (the prefix of its shingles,
common ones last); that is its replication across borders. Within a region, the triangle inequality bounds how far two
documents' sizes (their distances to the empty set), their places in the order and their bucketed counts may lie apart.
Large regions join in rounds: first every document with the leader of its band of sizes; then, once links have become
components, only documents of different components, a share of the pairs before all the rest. All rounds verify
candidates by their whole sets, so the links are exact (up to collisions of 64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_rows, materialise

BUCKETS = 256
#: The second round first takes one in SHARE of the pairs, so that few are left that are still in different components.
SHARE = 16
#: Regions up to this size compare all pairs within their windows at once; larger ones in two rounds.
SMALL = 32
#: In the second round a region over this many documents joins block against block.
BLOCK = 2048
#: Ids are broadcast up to this many (16 MB); beyond it the same join shuffles.
MOST_BROADCAST = 1_000_000
#: The most frequent shingles that are put last in the order, at most so many (2 MB).
MOST_COMMON = 1 << 18


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted 64-bit hashes: words are lower-cased in A-Z; fewer than k words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    g = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        g = (g ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(g ^ (g >> np.uint64(32)))


def packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """v, n, tokens, sketch, h1, h2 of docs (doc_id, text, h1, h2): the set's size, its hashes and how many of them fall in each bucket (255 at most)."""

    def rows(columns):
        found = [shingles(t, k) for t in columns[1]]
        sketch = [np.minimum(np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes() for s in found]
        yield [columns[0], [len(s) for s in found], [packed(s) for s in found], sketch, *columns[2:]]

    return map_rows(docs, rows, "v long, n long, tokens binary, sketch binary, h1 long, h2 long", rows=256)


def common_shingles(sets: DataFrame, share: int = 8, least: int = 5) -> np.ndarray:
    """Shingles that at least `least` of one in `share` documents have early in the order of hashes, the most frequent first.

    They only decide the order of shingles, on which the cost of the join depends but never its result.
    """

    def rows(columns):
        yield [[x for data in columns[0] for x in unpacked(data[: 8 * (len(data) // 32)]).astype(np.int64).tolist()]]

    some = map_rows(sets.where(F.pmod(F.xxhash64("v"), F.lit(share)) == 0).select("tokens"), rows, "token long")
    found = some.groupBy("token").count().where(F.col("count") >= least).orderBy(F.desc("count"), "token").limit(MOST_COMMON)
    return np.sort(found.select("token").toPandas()["token"].to_numpy(np.int64).astype(np.uint64))


def prefix(tokens: np.ndarray, common: np.ndarray, pct: int) -> np.ndarray:
    """The first n - ceil(pct n / 100) + 1 shingles, common ones last: two sets that link share one of both prefixes."""
    n = len(tokens)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        hot = common[at] == tokens
        tokens = np.concatenate([tokens[~hot], tokens[hot]])
    return tokens[: n - -(-pct * n // 100) + 1]


def regions(sets: DataFrame, common: np.ndarray, pct: int) -> DataFrame:
    """token, v, n, pos: each document in the regions of its prefix."""
    sent = sets.sparkSession.sparkContext.broadcast(common)

    def rows(columns):
        out = ([], [], [], [])
        for v, n, data in zip(*columns, strict=True):
            p = prefix(unpacked(data), sent.value, pct)
            out[0].append(p.astype(np.int64))
            out[1].append(np.full(len(p), v, np.int64))
            out[2].append(np.full(len(p), n, np.int32))
            out[3].append(np.arange(len(p), dtype=np.int32))
        yield [np.concatenate(x) for x in out] if out[0] else [[], [], [], []]

    return map_rows(sets.select("v", "n", "tokens"), rows, "token long, v long, n int, pos int")


def overlap_needed(a, b, pct: int):
    """The least intersection of sets of a and b elements that link."""
    return -(-pct * (a + b) // (100 + pct))


def within(n, pos, i, j, pct: int) -> np.ndarray:
    """Whether rows i and j of one region (sizes and places in the order) may link, this pivot being their first common one."""
    a, b = n[i], n[j]
    left = np.minimum(a - pos[i], b - pos[j])
    return (100 * np.minimum(a, b) >= pct * np.maximum(a, b)) & (left >= overlap_needed(a, b, pct))


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Columns of a stream sorted by its first column, cut so that no value of it is cut in two."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:width]]
        if not batch.num_rows:
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or (held and held[-1][0][-1] != columns[0][0]):
            held.append([c[:cut] for c in columns])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def first_round(dealt: DataFrame, pct: int) -> DataFrame:
    """a, b: candidates, a < b; and, with a null b, the token of each large region as a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for token, v, n, pos in groups(batches, 4):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[start, len(token)])
            of = np.repeat(np.arange(len(start)), size)
            left, right, large = [], [], []
            at = np.flatnonzero((size[of] > 1) & (size[of] <= SMALL))
            d = 1
            while len(at):  # rows d apart in one region
                at = at[at + d < len(of)]
                at = at[of[at] == of[at + d]]
                ok = at[within(n, pos, at, at + d, pct)]
                left.append(v[ok])
                right.append(v[ok + d])
                d += 1
            for g in np.flatnonzero(size > SMALL).tolist():
                lo, hi = int(start[g]), int(start[g] + size[g])
                large.append(token[lo])
                # The leader of a band of sizes, all within each other's windows, is the same document in most regions.
                band = np.floor(np.log(n[lo:hi]) / np.log(100 / pct)).astype(np.int64)
                mixed = (v[lo:hi].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
                order = np.lexsort((mixed * np.uint64(0xBF58476D1CE4E5B9), band))
                opens = np.r_[True, band[order][1:] != band[order][:-1]]
                leaders = np.empty(hi - lo, np.int64)
                leaders[order] = lo + order[np.flatnonzero(opens)][np.cumsum(opens) - 1]
                every = np.arange(lo, hi)
                i, j = leaders[leaders != every], every[leaders != every]
                ok = within(n, pos, i, j, pct)
                left.append(v[i[ok]])
                right.append(v[j[ok]])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            pairs = pairs[:, pairs[0] != pairs[1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)
            if large:
                yield pa.RecordBatch.from_arrays([pa.array(large, pa.int64()), pa.nulls(len(large), pa.int64())], schema=schema)

    return dealt.repartition("token").sortWithinPartitions("token", "n", "v").mapInArrow(run, "a long, b long")


def held_pivots(sets: DataFrame, common: np.ndarray, pct: int, large: DataFrame) -> DataFrame:
    """v, n, sketch, held: each document's pivots of large regions (token), with their places in the order."""
    placed = among(regions(sets, common, pct), large, "token")
    own = placed.groupBy("v", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("held"))
    return own.join(sets.select("v", "n", "sketch"), ["v", "n"])


def large_regions(held: DataFrame, label: DataFrame) -> DataFrame:
    """token, v, n, pos, component, sketch, earlier: documents in large regions, with their pivots before this one."""
    each = held.join(label, "v", "left").select("v", "n", F.coalesce("component", "v").alias("component"), "sketch", "held", F.explode("held").alias("p"))
    earlier = F.transform(F.filter("held", lambda x: x["pos"] < F.col("p.pos")), lambda x: x["token"])
    return each.select(F.col("p.token").alias("token"), "v", "n", F.col("p.pos").alias("pos"), "component", "sketch", earlier.alias("earlier"))


def in_blocks(dealt: DataFrame, pct: int) -> DataFrame:
    """part, side, v, n, pos, component, sketch, earlier: dealt (as of large_regions), cut so that a part is about two blocks at most.

    A region up to BLOCK is one part, and its side is 2: all of it is compared. A larger one is cut into bands of sizes (links
    join equal or neighbouring bands), these into the band's largest component and the rest, and both by a hash of v into
    blocks. A part is two blocks, sides 0 and 1, or one block with itself; blocks of one common component meet nowhere.
    """
    width = float(np.log(100 / pct)) * 1.000001  # a little wide, so that rounding never puts two that link two bands apart
    counts = dealt.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK)
    hot = materialise(counts.select("token"), "hot")
    whole = F.xxhash64("token").alias("part"), F.lit(2).alias("side")
    columns = ["v", "n", "pos", "component", "sketch", "earlier"]
    if hot.isEmpty():
        return dealt.select(*whole, *columns)
    few = hot.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    hot = F.broadcast(hot) if few else hot
    small = dealt.join(hot, "token", "left_anti").select(*whole, *columns)
    rows = dealt.join(hot, "token", "left_semi").withColumn("band", F.floor(F.log("n") / width))
    of_component = rows.groupBy("token", "band", "component").agg(F.count(F.lit(1)).alias("rows"))
    band = of_component.groupBy("token", "band").agg(F.max(F.struct("rows", "component")).alias("top"), F.sum("rows").alias("rows"))
    band = materialise(band.select("token", "band", F.col("top.component").alias("main"), F.col("top.rows").alias("own"), (F.col("rows") - F.col("top.rows")).alias("others")), "bands")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    kinds = band.select("token", "band", F.lit(True).alias("is_main"), F.col("main").alias("only"), blocks("own").alias("blocks")).unionAll(
        band.where("others > 0").select("token", "band", F.lit(False), F.lit(None).cast("long"), blocks("others"))
    )
    a, b = (kinds.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("band", "is_main", "only", "blocks")]) for x in "ab")
    met = a.join(b.withColumn("band_a", F.explode(F.array(F.col("band_b"), F.col("band_b") - 1))), ["token", "band_a"])
    same_band = F.col("band_a") == F.col("band_b")
    same = same_band & (F.col("is_main_a") == F.col("is_main_b"))
    met = met.where(~F.coalesce(F.col("only_a") == F.col("only_b"), F.lit(False)) & (~same_band | (F.col("is_main_a") <= F.col("is_main_b"))))
    met = met.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)))
    met = met.withColumn("block_b", F.explode(F.sequence(F.when(same, F.col("block_a")).otherwise(F.lit(0)), F.col("blocks_b") - 1)))
    met = met.withColumn("part", F.xxhash64("token", *[f"{c}_{x}" for x in "ab" for c in ("band", "is_main", "block")])).withColumn("alone", same & (F.col("block_a") == F.col("block_b")))
    side = lambda x, n: met.select("token", *[F.col(f"{c}_{x}").alias(c) for c in ("band", "is_main", "block")], "part", n.cast("int").alias("side"), "alone")
    to = side("a", F.when(F.col("alone"), 2).otherwise(0)).unionAll(side("b", F.lit(1)).where(~F.col("alone"))).drop("alone")
    few = band.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    placed = rows.join(F.broadcast(band) if few else band, ["token", "band"]).withColumn("is_main", F.col("component") == F.col("main"))
    block = F.pmod(F.xxhash64("v"), F.when(F.col("is_main"), blocks("own")).otherwise(blocks("others"))).cast("int")
    return small.unionAll(placed.withColumn("block", block).join(to, ["token", "band", "is_main", "block"]).select("part", "side", *columns))


def second_round(dealt: DataFrame, pct: int, share: int) -> DataFrame:
    """a, b: the pairs of large regions that are in different components and may link, each at the first large pivot that they share.

    With a share over 1, one in so many of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for part, side, v, n, pos, component, sketch, earlier in groups(batches, 8):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(part)], strict=True):
                if (component[lo:hi] == component[lo]).all():
                    continue
                own = np.stack([np.frombuffer(s, np.uint8) for s in sketch[lo:hi]]).astype(np.int16)
                before = [frozenset(x.tolist()) for x in earlier[lo:hi]]
                left, right = [], []
                for i in range(lo, hi - 1):
                    end = lo + int(np.searchsorted(n[lo:hi], 100 * n[i] // pct, "right"))
                    j = np.arange(i + 1, end)
                    j = j[(component[j] != component[i]) & ((side[i] == 2) | (side[j] != side[i]))]
                    if share > 1:
                        j = j[((v[j] ^ v[i]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(share) == 0]
                    j = j[within(n, pos, np.full(len(j), i), j, pct)]
                    if len(j):
                        apart = np.abs(own[j - lo] - own[i - lo]).sum(axis=1)
                        j = j[apart <= n[i] + n[j] - 2 * overlap_needed(n[i], n[j], pct)]
                        first = [k for k in j.tolist() if before[i - lo].isdisjoint(before[k - lo])]
                        left += [min(v[i], v[k]) for k in first]
                        right += [max(v[i], v[k]) for k in first]
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)

    return in_blocks(dealt, pct).repartition("part").sortWithinPartitions("part", "n", "v").mapInArrow(run, "a long, b long")


def among(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of table whose key is in ids: by broadcast up to MOST_BROADCAST ids, else by a shuffle."""
    ids = ids.withColumnRenamed(ids.columns[0], key)
    few = ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return table.join(F.broadcast(ids) if few else ids, key, "left_semi")


def with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pairs (a, b) with the value of table (v, n, ...) of each end: a, b, n_a, n_b, x, y."""
    left = table.select(F.col("v").alias("a"), F.col("n").alias("n_a"), F.col(value).alias("x"))
    right = table.select(F.col("v").alias("b"), F.col("n").alias("n_b"), F.col(value).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "x", "y")


def near_by_sketch(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs whose bucketed counts differ by no more than the sets may: the counts' distance never exceeds the sets'."""

    def rows(columns):
        a, b, n_a, n_b, x, y = columns
        if a:
            n_a, n_b = np.array(n_a), np.array(n_b)
            apart = np.abs(np.frombuffer(b"".join(x), np.uint8).astype(np.int16) - np.frombuffer(b"".join(y), np.uint8)).reshape(-1, BUCKETS).sum(axis=1)
            ok = apart <= n_a + n_b - 2 * overlap_needed(n_a, n_b, pct)
            yield [np.array(a, np.int64)[ok], np.array(b, np.int64)[ok]]

    return map_rows(with_both(pairs, sets, "sketch"), rows, "a long, b long", rows=8192)


def verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs that link, by their whole sets. Only sets of documents in a pair are moved."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    few = among(sets.select("v", "n", "tokens"), ids, "v")

    def rows(columns):
        keep = []
        for n_a, n_b, x, y in zip(*columns[2:], strict=True):
            both = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
            keep.append(100 * both >= pct * (n_a + n_b - both))
        yield [[v for v, k in zip(c, keep, strict=True) if k] for c in columns[:2]]

    return map_rows(with_both(pairs, few, "tokens"), rows, "a long, b long", rows=256)


def components(edges: DataFrame) -> DataFrame:
    """v, component (the smallest vertex reachable) of each vertex of edges (a, b), by alternating stars.

    Each round joins every vertex with the smallest of its neighbours; rounds grow with the logarithm of the longest path.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).where("u <> w").distinct(), "edges")
    state = None
    while True:
        both = now.select("u", "w").unionAll(now.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).unionAll(now.join(least, "u").where("m < u").select("u", F.col("m").alias("w")))
        large = large.where("u <> w").distinct()
        low = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("w")).unionAll(small.where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("w"))).distinct()
        now = materialise(small, "edges")
        after = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first())
        if after == state:
            break
        state = after
    # Every star now has its smallest vertex as its centre.
    stars = now.groupBy("u").agg(F.min("w").alias("component"))
    centres = now.select(F.col("w").alias("u"), F.col("w").alias("component")).distinct()
    return stars.unionAll(centres.join(stars, "u", "left_anti")).select(F.col("u").alias("v"), "component")


def join(docs: DataFrame, k: int = 4, pct: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Documents link when 100 * |intersection| >= pct * |union| of their k-word shingles; component_id is the smallest
    doc_id reachable by links. A null or empty text has no shingle, links with nothing and is a component of its own.
    Equal texts are compared once. Rows that share a doc_id are one document for the links; a null doc_id links with
    nothing and has a null component. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    worded = F.col("text").rlike("[^\\x20\\x09-\\x0D]")  # texts without a word link with nothing, not even with their copies
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.md5("text")).alias("h2"))
    keyed = docs.select("doc_id", "h1", "h2", worded.alias("worded"))
    texts = keyed.where(F.col("doc_id").isNotNull() & F.col("worded")).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    many = texts.where("copies > 1").drop("copies")
    member = keyed.where("worded").join(many, ["h1", "h2"]).where(F.col("doc_id").isNotNull() & (F.col("doc_id") > F.col("first")))
    member = materialise(member.select("doc_id", "h1", "h2", "first").distinct(), "copies")
    copies = member.select("doc_id", "h1", "h2")
    few = copies.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    single = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(copies) if few else copies, ["doc_id", "h1", "h2"], "left_anti")
    sets = materialise(sets_of(single.select("doc_id", "text", "h1", "h2"), k), "sets")
    # A document with a copied text and another one ties them together.
    other = sets.select(F.col("v").alias("doc_id")).unionAll(member.groupBy("doc_id").count().where("count > 1").select("doc_id")).distinct()
    ties = materialise(member.join(other, "doc_id", "left_semi").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct(), "ties")

    common = common_shingles(sets.where("n > 0"))
    found = materialise(first_round(regions(sets.where("n > 0"), common, pct), pct), "candidates")
    pairs = found.where("b is not null").distinct()
    edges = materialise(verified(materialise(near_by_sketch(pairs, sets, pct), "pairs"), sets, pct), "links").unionAll(ties)
    label = components(edges)

    large = found.where("b is null").select(F.col("a").alias("token")).distinct()
    if not large.isEmpty():  # pivots of regions over SMALL
        held = materialise(held_pivots(sets.where("n > 0"), common, pct, large), "pivots")
        for share in (SHARE, 1):
            label = materialise(label, "components")
            more = materialise(second_round(large_regions(held, label), pct, share).distinct(), "pairs")
            if not more.isEmpty():
                edges = edges.unionAll(materialise(verified(more, sets, pct), "links"))
                label = components(edges)
    label = label.select(F.col("v").alias("first"), "component")

    lengths = sets.select("h1", "h2", "n").distinct().join(member.select("h1", "h2", "doc_id"), ["h1", "h2"]).select("doc_id", "n")
    sizes = sets.select(F.col("v").alias("doc_id"), "n").unionAll(lengths).groupBy("doc_id").agg(F.max("n").alias("n"))
    own = keyed.where(F.col("doc_id").isNotNull()).select("doc_id").join(member.groupBy("doc_id").agg(F.min("first").alias("of")), "doc_id", "left")
    own = own.select("doc_id", F.coalesce("of", "doc_id").alias("first")).join(sizes, "doc_id", "left").join(label, "first", "left")
    known = own.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"))

    def alone(columns):
        yield [columns[0], [len(shingles(t, k)) for t in columns[1]], [None] * len(columns[0])]

    unnamed = map_rows(docs.where(F.col("doc_id").isNull()).select("doc_id", "text"), alone, "doc_id long, n_shingles long, component_id long")
    return known.unionByName(unnamed)
