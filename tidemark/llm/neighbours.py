"""Exact nearest neighbours by a block matrix join on 8-bit tiles.

Every vector has an 8-bit code, a scale and the norm of its rounding error. Only
these travel to the tiles (a block of queries against a block of candidates).
One product of codes gives all approximate distances of a tile, and the norms
bound how far off each may be: with ``x = s q + e``, the true distance lies
within ``|e_x| + |e_y|`` of the coded one. A candidate whose lower bound exceeds
a query's k-th smallest upper bound, in its tile and then over all tiles, cannot
be among its neighbours. The original vectors of the surviving pairs are fetched,
distances are worked out in double precision, and heaps keep the least of them.

The grid of tiles is a cogroup of the two sides on (dimension, query block,
candidate block). Its sides are chosen so that what both sides send, and what
tiles answer, is least for the number of tiles: with a query in a hundred rows,
candidates are repeated a few times and queries more often.

Edge cases: vectors that are null, empty, all zero, or hold a null or a
non-finite component take no part; vectors are compared with those of their own
dimension; rows that repeat an id are rows of their own, each with neighbours of
its own, except that a query is never its own neighbour by id; ties go to the
smaller id; fewer than k candidates give fewer rows; other columns, whatever
their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bounded_batches, materialize, partitions

#: Rows of either side that a tile has at most (about), and pairs that it is to have.
BLOCK = 1 << 17
PAIRS = 1 << 31
#: Queries, and candidates, whose product is made at once within a tile.
ROWS, COLUMNS = 256, 4096


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes, a scale a row, and the norm of each row's rounding error (rounded up)."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - scale[:, None] * q) ** 2).sum(1))
    return q, scale, error * (1 + 1e-9) + 1e-300


class Codes:
    """Rows of one side of a tile."""

    def __init__(self, table: pa.Table, dim: int):
        self.rid, self.id, self.scale, self.error = (table.column(c).to_numpy() for c in ("rid", "id", "scale", "error"))
        self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(-1, dim)


def survivors(q: Codes, c: Codes, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query (by place) the candidates that may be among its k nearest: places, lower and upper bounds."""
    # Products of 8-bit codes are whole numbers below 2**24 for up to 1040 components: single precision holds them exactly.
    kind = np.float32 if q.codes.shape[1] <= 1040 else np.float64
    blocks = [slice(at, at + COLUMNS) for at in range(0, len(c.id), COLUMNS)]
    squares = c.scale**2 * np.concatenate([(c.codes[b].astype(np.float64) ** 2).sum(1) for b in blocks])
    for at in range(0, len(q.id), ROWS):
        part = slice(at, at + ROWS)
        own = q.codes[part].astype(kind)
        qn = q.scale[part] ** 2 * (own.astype(np.float64) ** 2).sum(1)
        top = np.full((len(own), k), np.inf)  # the least upper bounds so far
        found = []
        for b in blocks:
            dots = (own @ c.codes[b].astype(kind).T).astype(np.float64) * q.scale[part, None] * c.scale[None, b]
            coded = np.sqrt(np.maximum(qn[:, None] + squares[None, b] - 2 * dots, 0))
            slack = q.error[part, None] + c.error[None, b] + 1e-7 * (np.sqrt(qn)[:, None] + np.sqrt(squares[None, b]))
            same = q.id[part, None] == c.id[None, b]
            upper = np.where(same, np.inf, coded + slack)
            top = np.partition(np.hstack([top, upper]), k - 1, axis=1)[:, :k]
            i, j = np.nonzero((coded - slack <= top.max(1)[:, None]) & ~same)
            found.append((i, j + b.start, (coded - slack)[i, j], upper[i, j]))
        i, j, low, high = (np.concatenate(x) for x in zip(*found))
        near = low <= top.max(1)[i]
        i, j, low, high = i[near], j[near], low[near], high[near]
        order = np.argsort(i, kind="stable")
        cut = np.searchsorted(i[order], np.arange(len(own) + 1))
        for x, (a, z) in enumerate(zip(cut[:-1], cut[1:])):
            if z > a:
                some = order[a:z]
                yield at + x, j[some], low[some], high[some]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, id, dim, asks, vector -> rid, id, dim, asks, codes, scale, error."""
    for batch in batches:
        codes, scale, error = [], [], []
        for v in batch.column(4):
            q, s, e = quantise(v.values.to_numpy(zero_copy_only=False).astype(np.float64)[None, :])
            codes.append(q.tobytes())
            scale.append(s[0])
            error.append(e[0])
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(codes, pa.binary()), pa.array(scale, pa.float64()), pa.array(error, pa.float64())], ["rid", "id", "dim", "asks", "codes", "scale", "error"])


def grid(n: int, asked: int, dim: int, k: int, tasks: int) -> tuple[int, int]:
    """Blocks of queries and of candidates: tiles enough for the tasks and small enough, at the least traffic."""
    tiles = max(tasks, -(-n * asked // PAIRS), 1)
    # A query goes to every block of candidates, with an answer of k bounds from each; a candidate to every block of queries.
    share = asked * (dim + 32 * k) / max(1, n * dim)
    q = min(max(round(math.sqrt(tiles * share)), -(-asked // BLOCK), 1), max(1, asked))
    return q, max(-(-tiles // q), -(-n // BLOCK), 1)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each row for which ``queries`` holds: query_id, rank, id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull())
    rows = whole.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vector_col).alias("vector"))
    rows = materialize(rows, "vectors")
    n, asked, dim = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max("dim"), F.lit(1))).first()
    wide, high = grid(n, asked, dim, k, partitions(spark))
    coded = rows.mapInArrow(_encode, "rid bigint, id bigint, dim int, asks boolean, codes binary, scale double, error double")
    place, names = F.xxhash64("rid"), ["rid", "id", "codes", "scale", "error"]
    ask = coded.filter("asks").select("dim", F.pmod(place, F.lit(wide)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("cb"), *names)
    have = coded.select("dim", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("qb"), F.pmod(place, F.lit(high)).cast("int").alias("cb"), *names)
    keys = ["dim", "qb", "cb"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            q, c = Codes(left, dim), Codes(right, dim)
            out = [(q.rid[i], c.rid[j], low, high) for i, j, low, high in survivors(q, c, k)]
        columns = list(zip(*out)) if out else [()] * 4
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], ["q", "c", "low", "high"])

    found = ask.groupBy(*keys).cogroup(have.groupBy(*keys)).applyInArrow(search, "q bigint, c array<bigint>, low array<double>, high array<double>")
    # k bounds and little more from each tile.
    merged = found.groupBy("q").agg(*[F.flatten(F.collect_list(x)).alias(x) for x in ("c", "low", "high")]).withColumn("most", F.coalesce(F.get(F.sort_array("high"), F.lit(k - 1)), F.lit(float("inf"))))
    pairs = merged.select("q", F.explode(F.filter(F.arrays_zip("c", "low"), lambda x: x["low"] <= F.col("most"))).alias("x")).select("q", F.col("x.c").alias("c"))
    theirs = rows.select(F.col("rid").alias("c"), F.col("id").alias("c_id"), F.col("vector").alias("c_vector"))
    ours = rows.filter("asks").select(F.col("rid").alias("q"), F.col("id").alias("q_id"), F.col("vector").alias("q_vector"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heaps: dict[int, tuple[int, list[tuple[float, int]]]] = {}
            for q, q_id, c_id, x, y in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), batch.column(4)):
                a, b = (v.values.to_numpy(zero_copy_only=False).astype(np.float64) for v in (x, y))
                distance = float(np.sqrt(np.add.accumulate((b - a) ** 2)[-1]))  # components added in their order
                heap = heaps.setdefault(q, (q_id, []))[1]
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (-distance, -c_id))
            out = [(q, q_id, -d, -i) for q, (q_id, heap) in heaps.items() for d, i in heap]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64(), pa.int64(), pa.float64(), pa.int64()])], ["q", "query_id", "score", "id"])

    near = pairs.join(theirs, "c").join(ours, "q").select("q", "q_id", "c_id", "q_vector", "c_vector").mapInArrow(exact, "q bigint, query_id bigint, score double, id bigint")
    order = Window.partitionBy("q").orderBy("score", "id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
