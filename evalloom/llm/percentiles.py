"""Percentiles per group within a bounded rank error, from mergeable compactor sketches.

Each sketch is a hierarchy of compactors: a full level is sorted, a coin decides whether the odd or the even
values rise to the next level with twice the weight; merging joins level by level. Spark's own KLL aggregates
do this in the JVM, so rows are never sorted and a group that holds a third of them is one sketch per task.

Redelivered rows are removed by an aggregate on the key's 16 bytes before any value is counted. Nulls are left
out; a group of nulls only gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sketch size; the rank error of a single percentile is about 2.3 / K ** 0.9 of the rows with 99 % confidence.
K = 1000
PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def rank_error(k: int = K) -> float:
    """Normalised rank error of one percentile, held with 99 % confidence (Karnin, Lang and Liberty's sketch)."""
    return 2.296 / k**0.9021


def key_bytes(key: str) -> Column:
    """A key as few bytes: 16 for 32 hexadecimal digits, else the text and a mark, so that no two keys meet."""
    hexed = F.col(key).rlike("^[0-9a-f]{32}$")
    return F.when(hexed, F.unhex(key)).otherwise(F.concat(F.col(key).cast("binary"), F.lit("#").cast("binary")))


def _kind(df: DataFrame, column: Column | str) -> str:
    """Sketches of whole numbers stay whole; those of fractional ones are of doubles."""
    kind = df.select(column).schema[0].dataType
    return "double" if isinstance(kind, (T.FractionalType, T.StringType)) else "bigint"


def sketches(df: DataFrame, keys: list[str], value: Column, row_key: str | None = None, k: int = K) -> DataFrame:
    """keys and a `sketch` of the non-null values of each group; rows with the same row_key count once.

    Fractional values make sketches of doubles, in a column `sketch_double`. NaN counts as null.
    """
    kind = _kind(df, value)
    rows = df.select(*keys, value.cast(kind).alias("__v"), *([key_bytes(row_key).alias("__k")] if row_key else []))
    rows = rows.where(F.col("__v").isNotNull() if kind == "bigint" else F.col("__v").isNotNull() & ~F.isnan("__v"))
    if row_key:
        known = rows.where(F.col("__k").isNotNull()).groupBy("__k").agg(*[F.min(c).alias(c) for c in keys], F.min("__v").alias("__v"))
        # Rows without a key can't be told apart; each counts.
        rows = known.select(*keys, "__v").unionAll(rows.where(F.col("__k").isNull()).select(*keys, "__v"))
    aggregate = {"bigint": F.kll_sketch_agg_bigint, "double": F.kll_sketch_agg_double}[kind]
    return rows.groupBy(*keys).agg(aggregate("__v", F.lit(k)).alias(_NAMES[kind]), F.count(F.lit(1)).alias("n"))


#: The column of a sketch names its numbers, so that merging and reading need no flag.
_NAMES = {"bigint": "sketch", "double": "sketch_double"}


def _held(parts: DataFrame) -> tuple[str, str]:
    return next((kind, name) for kind, name in _NAMES.items() if name in parts.columns)


def merge(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches of separate days, files or runs joined into one per group of keys."""
    kind, name = _held(parts)
    join = {"bigint": F.kll_merge_agg_bigint, "double": F.kll_merge_agg_double}[kind]
    return parts.groupBy(*keys).agg(join(name, F.lit(k)).alias(name), F.sum("n").alias("n"))


def percentiles(parts: DataFrame, ranks: tuple[float, ...] = PERCENTILES, k: int = K) -> DataFrame:
    """A row per group and rank: the value there, and the values between which the exact one lies with 99 % confidence."""
    bound = rank_error(k)
    kind, name = _held(parts)
    quantile = {"bigint": F.kll_sketch_get_quantile_bigint, "double": F.kll_sketch_get_quantile_double}[kind]
    at = lambda r: quantile(name, F.lit(float(min(1.0, max(0.0, r)))))
    answers = F.array(*[F.struct(F.lit(float(r)).alias("rank"), at(r - bound).alias("least"), at(r).alias("value"), at(r + bound).alias("most")) for r in ranks])
    kept = [c for c in parts.columns if c != name]
    return parts.select(*kept, F.explode(answers).alias("a")).select(*kept, "a.rank", "a.least", "a.value", "a.most")
