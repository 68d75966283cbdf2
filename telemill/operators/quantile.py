"""Exact group quantiles by distributed radix selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.session import cut

PER_OCTAVE = 128  # first digit: bins per doubling of the value
BINS = 4096  # further digits: equal bins of what is left
SORTED = 1024  # a bin of so many rows at most is sorted as one array


def _first_digit(v: Column) -> Column:
    """A number that never decreases with ``v``: at most 10^6 of them, about 0.5 % of the value wide."""
    a = F.abs(v)
    octave = F.when((a == 0) | F.isnan(v), 0).when(a == float("inf"), 400_000).otherwise(F.floor(F.log2(a) * PER_OCTAVE) + 200_000)
    return F.when(F.isnan(v), 500_000).otherwise(F.signum(v) * octave).cast("int")


def _select(src: DataFrame, by: list[str], qs: dict[str, float], bins: int = BINS) -> DataFrame:
    """Quantiles of ``__v`` per group of the stored table ``src`` of (``by``, ``__v``, ``__w``); a row counts ``__w`` times."""
    seen = [F.sum("__w").alias("c"), F.count(F.lit(1)).alias("m"), F.min("__v").alias("nlo"), F.max("__v").alias("nhi")]
    before = lambda of: F.coalesce(F.sum("c").over(Window.partitionBy(*of).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = lambda r: (r >= F.col("b")) & (r < F.col("b") + F.col("c"))

    def rows_of(bins: DataFrame) -> DataFrame:
        near = src.join(bins.select(*by, "lo", "hi").distinct(), by)
        return near.where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))

    def into(met: DataFrame) -> DataFrame:
        return met.select(*by, "__n", "j", (F.col("r") - F.col("b")).alias("r"), "m", F.col("nlo").alias("lo"), F.col("nhi").alias("hi"))

    first = cut(src.groupBy(*by, _first_digit(F.col("__v")).alias("__d")).agg(*seen))
    placed = first.withColumns({"b": before(by), "__n": F.sum("c").over(Window.partitionBy(*by))})
    # two wanted ranks per quantile, below and above, each in the bin that holds it
    ranks = [F.struct(F.lit(k).alias("j"), f(F.lit(q) * (F.col("__n") - 1)).cast("long").alias("r")) for k, (q, f) in enumerate((q, f) for q in qs.values() for f in (F.floor, F.ceil))]
    state = cut(into(placed.select(*placed.columns, F.inline(F.filter(F.array(*ranks), lambda x: inside(x["r"]))))))
    of = [*by, "lo", "hi"]
    large = (F.col("lo") < F.col("hi")) & (F.col("m") > SORTED)
    while state.where(large).limit(1).count():
        wide = state.where(large)
        digit = F.least(F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
        fine = rows_of(wide).groupBy(*of, digit.alias("__d")).agg(*seen)
        state = cut(state.where(~large).unionByName(into(wide.drop("m").join(fine.withColumn("b", before(of)), of).where(inside(F.col("r"))))))
    ordered = rows_of(state.where("lo < hi")).groupBy(*of).agg(F.sort_array(F.collect_list(F.struct("__v", "__w"))).alias("vs"))
    none = F.lit(None).cast("double")
    step = lambda a, e: F.when(a["x"].isNull() & (a["r"] < e["__w"]), F.struct(a["r"].alias("r"), e["__v"].alias("x"))).otherwise(F.struct((a["r"] - e["__w"]).alias("r"), a["x"].alias("x")))
    picked = F.aggregate("vs", F.struct(F.col("r").alias("r"), none.alias("x")), step)["x"]
    got = state.join(ordered, of, "left").withColumn("v", F.when(F.col("vs").isNull(), F.col("lo")).otherwise(picked))
    at = lambda j: F.max(F.when(F.col("j") == j, F.col("v")))
    out = []
    for i, (name, q) in enumerate(qs.items()):
        rank = F.lit(q) * (F.max("__n") - 1)
        out.append((at(2 * i) + (at(2 * i + 1) - at(2 * i)) * (rank - F.floor(rank))).alias(name))
    return got.groupBy(*by).agg(*out)


def _slim(df: DataFrame, keys: list[str], value: str, weight: Column | None) -> tuple[DataFrame, list[str]]:
    src = df if keys else df.withColumn("__all", F.lit(0))
    by = keys or ["__all"]
    w = F.lit(1) if weight is None else weight
    return cut(src.dropna(subset=[*by, value]).select(*by, F.col(value).cast("double").alias("__v"), w.cast("long").alias("__w"))), by


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], weight: Column | None = None, accuracy: int = BINS) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per key group, one output column per entry of ``qs``.

    A row counts ``weight`` times, a whole number above 0, once by default.
    Nulls do not count; NaN is largest. Groups are keyed as in a join: a null
    key has no row. Keys and values are stored once; then rows are counted by
    (key, digit of the value) in map tasks, and the bin of a wanted rank again
    by its next digit, all quantiles and keys in one pass, until it holds one
    value or at most ``SORTED`` rows. The first digit is logarithmic, further
    ones cut the values of their bin (least and greatest seen) into ``accuracy``
    equal parts, so a pass leaves as small a part of the range; the answer is exact whatever it is. Only bins are ordered
    by a window, never rows.
    """
    src, by = _slim(df, keys, value, weight)
    return _select(src, by, qs, accuracy).select(*keys, *qs)


def median_and_mad(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Median and median absolute deviation per key group."""
    src, by = _slim(df, keys, value, weight)
    med = cut(_select(src, by, {"median": 0.5}))
    mad = _select(src.join(med, by).select(*by, F.abs(F.col("__v") - F.col("median")).alias("__v"), "__w"), by, {"mad": 0.5})
    return med.join(mad, by).select(*keys, "median", "mad")
