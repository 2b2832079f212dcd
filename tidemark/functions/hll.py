"""Distinct counts by HyperLogLog sketches: struct(precision int, registers binary).

Hashing and the maxima of registers are Catalyst expressions with partial
aggregation; Python puts at most 2^18 registers of a group together and
estimates. Merged sketches equal the sketch of the union exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark import reachable

TYPE = "struct<precision:int,registers:binary>"
#: Groups whose sketches a task holds before it emits them all.
GROUPS = 2_000


def _check(bits: int) -> None:
    if not 4 <= bits <= 18:
        raise ValueError("a sketch has 4 to 18 bits")


def error(bits: int) -> float:
    """The standard error of an estimate, as a part of the count."""
    _check(bits)
    return 1.04 / math.sqrt(1 << bits)


def _assemble(maxima: DataFrame, keys: list[str], name: str, count: str | None = None) -> DataFrame:
    """maxima: keys, _p, _i, _rho (null where a group has no value), and _n where a count is asked for."""
    reachable(maxima.sparkSession)

    @pandas_udf("binary")
    def registers(p: pd.Series, i: pd.Series, rho: pd.Series) -> bytes:
        out = np.zeros(1 << int(p.iloc[0]), np.uint8)
        seen = i.notna().to_numpy()
        out[i[seen].to_numpy(np.int64)] = rho[seen].to_numpy(np.uint8)
        return out.tobytes()

    @pandas_udf("bigint")
    def total(n: pd.Series) -> int:
        return int(n.sum())

    counts = [total("_n").alias("_count")] if count else []
    found = maxima.groupBy(*keys, "_p").agg(registers("_p", "_i", "_rho").alias("_regs"), *counts)
    sketch = F.struct(F.col("_p").alias("precision"), F.col("_regs").alias("registers")).alias(name)
    return found.select(*keys, sketch, *([F.col("_count").alias(count)] if count else []))


def distinct_sketch(df: DataFrame, keys: list[str], value: str, bits: int = 12, name: str = "sketch", count: str | None = None) -> DataFrame:
    """A sketch of the values of each group. Nulls do not count; a group of nulls has an empty sketch.

    ``count`` names a column with the exact number of values, which a sketch only estimates, as values meet in registers.
    For it all distinct values are shuffled; else at most a group's registers.
    """
    _check(bits)
    values = df.select(*keys, F.col(value).alias("_v"))
    if count:
        values = values.distinct()
    h = F.xxhash64("_v")
    rest = F.shiftleft(h, bits)
    zeros = F.when(rest == 0, 64).otherwise(64 - F.length(F.bin(rest)))
    rho = F.least(zeros + 1, F.lit(64 - bits + 1))
    rows = values.select(*keys, F.lit(bits).alias("_p"), F.when(F.col("_v").isNotNull(), F.shiftrightunsigned(h, 64 - bits)).alias("_i"), rho.alias("_rho"), "_v")
    counts = [F.count("_v").alias("_n")] if count else []
    return _assemble(rows.groupBy(*keys, "_p", "_i").agg(F.max("_rho").alias("_rho"), *counts), keys, name, count)


def merge(df: DataFrame, keys: list[str], sketch: str = "sketch") -> DataFrame:
    """The union of the sketches of each group; nulls are skipped, different precisions are an error.

    Tasks first take the maxima of the registers of all sketches that they see of a group.
    """
    reachable(df.sparkSession)
    names = [*[f"k{i}" for i in range(len(keys))], "p", "r"]
    rows = df.filter(F.col(sketch).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(f"{sketch}.precision").alias("p"), F.col(f"{sketch}.registers").alias("r"))

    def peak(some: Iterable[tuple[int, bytes]]) -> tuple[int, bytes]:
        bits, top = None, None
        for p, r in some:
            if bits is not None and p != bits:
                raise ValueError("sketches of different precisions do not merge")
            own = np.frombuffer(r, np.uint8)
            if len(own) != 1 << p:
                raise ValueError("a sketch's registers do not fit its precision")
            bits, top = p, own.copy() if top is None else np.maximum(top, own, out=top)
        return bits, top.tobytes()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[int, bytes]] = {}
        out = lambda: pd.DataFrame([(*k, *v) for k, v in held.items()], columns=names)
        for batch in batches:
            for *key, p, r in batch.itertuples(index=False, name=None):
                key = tuple(None if pd.isna(x) else x for x in key)
                held[key] = peak([held[key], (p, r)]) if key in held else peak([(p, r)])
            if len(held) > GROUPS:
                yield out()
                held.clear()
        if held:
            yield out()

    def together(found: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*found.iloc[0][names[:-2]], *peak(zip(found["p"], found["r"]))]], columns=names)

    merged = rows.mapInPandas(partial, rows.schema).groupBy(*names[:-2]).applyInPandas(together, rows.schema)
    return merged.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.struct(F.col("p").alias("precision"), F.col("r").alias("registers")).alias(sketch))


def estimate(registers: bytes, bits: int) -> int:
    """Ertl's improved raw estimate, rounded."""
    if len(registers) != 1 << bits:
        raise ValueError("a sketch's registers do not fit its precision")
    m, q = 1 << bits, 64 - bits
    counts = np.bincount(np.frombuffer(registers, np.uint8), minlength=q + 2)
    if len(counts) > q + 2:
        raise ValueError("a register is over its largest value")
    # Ertl, "New cardinality estimation algorithms for HyperLogLog sketches" (2017), algorithm 6.
    empty, full = counts[0] / m, 1 - counts[q + 1] / m
    if empty == 1:
        return 0
    middle = float((counts[1 : q + 1] * 0.5 ** np.arange(1, q + 1)).sum())
    return round(m * m / (2 * math.log(2)) / (m * _tau(full) * 0.5**q + middle + m * _sigma(empty)))


def _sigma(x: float) -> float:
    """x + the sum over k of x^(2^k) 2^(k-1), for registers that saw nothing (x < 1)."""
    k = np.arange(1, 65)
    return x + float(((x ** (2.0**k)) * 2.0 ** (k - 1)).sum())


def _tau(x: float) -> float:
    """(1 - x - the sum over k of (1 - x^(2^-k))^2 2^-k) / 3, for registers that are full."""
    if x in (0.0, 1.0):
        return 0.0
    k = np.arange(1, 65)
    return (1 - x - float(((1 - x ** (2.0**-k)) ** 2 * 2.0**-k).sum())) / 3


def distinct_count(sketch: Column | str) -> Column:
    """The estimated number of distinct values."""
    reachable(SparkSession.active())

    @pandas_udf("bigint")
    def count(found: pd.DataFrame) -> pd.Series:
        return pd.Series([None if r is None or pd.isna(p) else estimate(bytes(r), int(p)) for p, r in zip(found["precision"], found["registers"])], dtype="Int64")

    return count(F.col(sketch) if isinstance(sketch, str) else sketch)


def to_text(sketch: Column | str) -> Column:
    c = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.to_json(F.struct(c["precision"].alias("precision"), F.lower(F.hex(c["registers"])).alias("registers")))


def from_text(text: Column | str) -> Column:
    c = F.from_json(text, "precision int, registers string")
    return F.struct(c["precision"].alias("precision"), F.unhex(c["registers"]).alias("registers"))
