"""Document fingerprints: a digest of quartiles over bucket counts of hashed byte triplets.

A window of ten bytes slides over the UTF-8 text; three triplets of each window, all with the window's last byte,
are hashed to one of 256 buckets. The triplets are spread out, as neighbouring bytes mostly tell the language. Each bucket's count is coded by the quartile it falls in (two bits), and a header
codes the length on a logarithmic scale and how far apart the quartiles lie. Digests are compared by a difference
score that is bounded, so that a likeness from 0 to 1 follows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialise

BUCKETS = 256
#: Offsets of a triplet's two older bytes behind the window's last byte.
TRIPLETS = ((2, 5), (3, 7), (5, 9))
WINDOW = 9
#: The mean difference of the codes of two independent digests; beyond it, nothing is alike.
FULL = 1.625 * BUCKETS
#: How much each step of length (a factor of 1.5) or of quartile distance adds.
STEP = 4


def bucket_counts(raw: bytes) -> np.ndarray:
    """Triplets of each bucket; zero bytes stand before the text."""
    if not raw:
        return np.zeros(BUCKETS, np.int64)
    v = np.frombuffer(bytes(WINDOW) + raw, np.uint8).astype(np.uint32)
    n = len(v) - WINDOW
    last, total = v[WINDOW:] * np.uint32(0x9E3779B1), np.zeros(BUCKETS, np.int64)
    second, third = v * np.uint32(0x85EBCA77), v * np.uint32(0xC2B2AE3D)
    for salt, (i, j) in enumerate(TRIPLETS):
        h = last + second[WINDOW - i : WINDOW - i + n] + third[WINDOW - j : WINDOW - j + n] + np.uint32(salt * 0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(24)
        total += np.bincount(h, minlength=BUCKETS)
    return total


def fingerprint(text: str | None) -> str:
    """The digest in hex: a byte of length, a byte of two quartile ratios, 64 bytes of codes. A null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(raw)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    size = min(255, round(math.log(len(raw) + 1, 1.5)))
    ratio = [0 if q3 == 0 else int(15 * q // q3) for q in (q1, q2)]
    return bytes([size, ratio[0] << 4 | ratio[1]]).hex() + body.astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 at a difference of FULL or more."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8).astype(np.int16), np.frombuffer(bytes.fromhex(b), np.uint8).astype(np.int16)
    diff = STEP * abs(int(x[0]) - int(y[0])) + sum(abs((int(x[1]) >> s & 15) - (int(y[1]) >> s & 15)) for s in (0, 4))
    for s in (0, 2, 4, 6):
        d = np.abs((x[2:] >> s & 3) - (y[2:] >> s & 3))
        diff += int(d.sum()) + 3 * int((d == 3).sum())
    return 1 - min(diff, FULL) / FULL


def edited(text: str, after: str) -> str:
    """The text with its last quarter of code points replaced by as many (or all) of the next text's first ones."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def compared(i, text: str, own: str, after: str, after_own: str) -> list:
    new = edited(text, after)
    print_ = fingerprint(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return [i, len(text), sha, own, print_, likeness(own, print_), likeness(own, after_own)]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    + [("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())]
)


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each row's digest beside those of its edited text and of the next document.

    The order is that of doc_id, null first, then of the text; after the last row comes the first (a single row
    follows itself). A null text counts as empty. Other columns are ignored. The texts are dealt out by ranges of
    doc_id (and of the texts' beginnings, where ids repeat) and compared as they stream by; only the last row of each
    range waits for the first row of the next range. Ranges find each other by number: what a single task orders is two
    numbers a range, and the texts then meet range by range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, first = None, True
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for i, text in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                    text = text or ""
                    own = fingerprint(text)
                    if first:
                        rows.append([i, 0, "", own, "", 0.0, 0.0, part, 1, text])
                        first = False
                    else:
                        rows.append([*compared(*before, text, own), part, 0, None])
                    before = i, text, own
                if rows:
                    yield _batch(rows)
        if before:
            yield _batch([[before[0], 0, "", before[2], "", 0.0, 0.0, part, 2, before[1]]])

    ranges = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first()]
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*ranges).sortWithinPartitions(*order)
    made = materialise(dealt.mapInArrow(run, RESULT + ", part int, edge int, text string"), "fingerprints")

    opening = made.where("edge = 1")
    w = Window.orderBy("part")  # the numbers of the ranges that have rows
    after = opening.select("part").withColumn("then", F.coalesce(F.lead("part").over(w), F.first("part").over(w)))
    first_rows = opening.select(F.col("part").alias("then"), F.col("text").alias("after"), F.col("fingerprint").alias("after_own"))
    open_rows = made.where("edge = 2").join(after, "part").join(first_rows, "then").select("doc_id", "text", "fingerprint", "after", "after_own")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield _batch([[*compared(*row), 0, 0, None]])

    names = [f.name for f in made.schema.fields[:7]]
    closed = open_rows.mapInArrow(close, RESULT + ", part int, edge int, text string")
    return made.where("edge = 0").select(*names).unionByName(closed.select(*names))
