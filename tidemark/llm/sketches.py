"""Document fingerprints: bottom-k sketches of shingle hashes.

The shingles of a text are the ``WIDTH`` bytes that end at each of its bytes
(before the first byte stand zeros, so that short texts have shingles too). A
sketch keeps the ``K`` smallest of their distinct 40-bit hashes. Sketches of
parts merge into the sketch of all by keeping the smallest of both; the smallest
of two sketches together sample the union, which estimates resemblance and,
with the distinct counts, containment. Equal texts have equal sketches.

``with_next`` pairs every document with the one after it in the order of
descending ids without a global sort in one task: ids are cut into ranges by
quantiles, a range is sorted by one task, and the first document of a range
also goes to the range before.

Edge cases: null and empty texts have the empty sketch, alike to each other
(1) and to nothing else (0); rows of one id follow each other by a hash of
their texts, null ids come last; the only row follows itself; texts of any
length are read whole, in chunks; other columns, whatever their names, are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, claim, partitions

K = 128
WIDTH = 12
#: Bytes hashed at once.
CHUNK = 1 << 21
BITS = 40

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def hashes(raw: bytes) -> np.ndarray:
    """Hashes (40 bits) of the windows of ``WIDTH`` bytes of raw."""
    n = len(raw) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.ndarray((n,), "<u8", raw, 0, (1,)) * _ODD[0]
    x ^= np.ndarray((n,), "<u4", raw, 8, (1,)) * _ODD[1]
    x ^= x >> np.uint64(29)
    x *= _ODD[2]
    x ^= x >> np.uint64(32)
    x *= _ODD[3]
    return x >> np.uint64(64 - BITS)


def smallest(h: np.ndarray) -> np.ndarray:
    """The K smallest distinct values, sorted."""
    if len(h) > 16 * K:
        few = np.unique(h[h < np.uint64(int(4 * K / len(h) * (1 << BITS)))])
        if len(few) >= K:
            return few[:K]
    return np.unique(h)[:K]


def sketch(raw: bytes, before: bytes = bytes(WIDTH - 1)) -> np.ndarray:
    """The sketch of raw; before: the bytes in front of it."""
    out = np.zeros(0, np.uint64)
    whole = before + raw
    for at in range(0, len(raw), CHUNK):
        out = smallest(np.concatenate([out, smallest(hashes(whole[at : at + CHUNK + WIDTH - 1]))]))
    return out


def merge(*parts: np.ndarray) -> np.ndarray:
    """The sketch of all shingles of which parts are sketches."""
    return smallest(np.concatenate([np.zeros(0, np.uint64), *parts]))


def distinct(a: np.ndarray) -> float:
    """Estimated number of distinct shingles (exact below K)."""
    return float(len(a)) if len(a) < K else (K - 1) / (float(a[-1]) + 1) * (1 << BITS)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the union's shingles that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:K]
    return float(np.intersect1d(both, np.intersect1d(a, b, True), True).size / both.size)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b) * distinct(merge(a, b)) / distinct(a))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, BITS // 8)
    return np.hstack([raw, np.zeros((len(raw), 8 - BITS // 8), np.uint8)]).view("<u8").ravel() if len(raw) else np.zeros(0, np.uint64)


def _above(value: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are at or above value: whole groups of bounds first, then within one."""
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[at : at + width] for at in range(0, len(bounds), width)]
    none = F.array().cast("array<bigint>")
    whole = F.size(F.filter(F.lit([g[-1] for g in groups]).cast("array<bigint>") if groups else none, lambda b: value <= b))
    last = F.get(F.array(*[F.lit(g).cast("array<bigint>") for g in groups], none), whole)
    return whole * width + F.size(F.filter(last, lambda b: value <= b))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (range, follows, id, text), sorted within partitions: each range in order, and after it, with follows
    true, the document that comes next. ids must be whole numbers."""
    spark = docs.sparkSession
    ids = F.col(id_col).cast("long")
    n = 4 * partitions(spark)
    quantiles = docs.agg(F.percentile_approx(ids, [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    bounds = sorted(set(quantiles), reverse=True)
    rows = docs.select(F.when(ids.isNull(), len(bounds) + 1).otherwise(_above(ids, bounds)).alias("range"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("hash"), F.coalesce(text_col, F.lit("")).alias("text"))
    first = sorted((r["range"], r["first"]["id"], r["first"]["hash"]) for r in rows.groupBy("range").agg(F.max(F.struct("id", "hash")).alias("first")).collect())
    sent = [(*f, first[i - 1][0]) for i, f in enumerate(first)]  # a row a range: bounded by the number of partitions
    to = spark.createDataFrame(sent, f"f_range int, f_id {dict(docs.dtypes)[id_col]}, f_hash long, before int")
    joined = rows.join(F.broadcast(to), (F.col("range") == F.col("f_range")) & F.col("id").eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash")), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("follows"))))
    places = places.otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("follows")), F.struct(F.col("before").alias("range"), F.lit(True).alias("follows"))))
    spread = joined.select("id", "hash", "text", F.explode(places).alias("place")).select("place.range", "place.follows", "id", "hash", "text")
    return spread.repartition(partitions(spark), "range").sortWithinPartitions("range", "follows", F.desc_nulls_last("id"), F.desc("hash")).select("range", "follows", "id", "text")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edits (the second half gives way to the next document's beginning):
    id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    bounded_batches(docs.sparkSession)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def answer(doc: tuple, text: str, own: np.ndarray, after: str, next_own: np.ndarray) -> tuple:
        half = len(text) // 2
        kept = text[: len(text) - half].encode()
        edit = kept + after[:half].encode()
        part = sketch(edit)
        return doc, len(text), hashlib.sha256(edit).hexdigest(), to_text(own), to_text(part), resemblance(own, part), resemblance(own, next_own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sketches")
        held = None  # the last document, whose next has not come yet
        for batch in batches:
            out = []
            for where, follows, doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                if held is None and follows:
                    continue
                own = sketch(text.encode())
                if held is not None:
                    out.append(answer(*held[1:], text, own))
                held = None if follows else (where, doc, text, own)
            columns = list(zip(*out)) if out else [()] * len(names)
            kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = dict(docs.dtypes)[id_col]
    return with_next(docs, id_col=id_col, text_col=text_col).mapInArrow(run, f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
