"""Robust statistics as columns and grouped operators; medians are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.vocab import EPS, MAD_SCALE


def fraction(p: Column) -> Column:
    """Share of rows for which p holds; 0 for no rows."""
    return F.coalesce(F.avg(p.cast("double")), F.lit(0.0))


def percentile(x: Column | str, q: float) -> Column:
    """Linear interpolation between the neighbours; null for no rows. Its state holds a group's distinct values: for groups of bounded size, others take `quantiles`."""
    return F.percentile(x, F.lit(q))


#: Half a bracket's width as a share of its group, the sketch's accuracy (its error is at most 1 / ACCURACY of the group), and the size up to
#: which a group is its own bracket: beyond it, a bracket of 2 * WIDTH is sure to hold the ranks that it is for.
WIDTH, ACCURACY, WHOLE = 3e-4, 10_000, 20_000


def _with(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, null keys included."""
    other = right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], *[c for c in right.columns if c not in by])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return left.join(other, same, how).drop(*[f"__k{i}" for i in range(len(by))])


def _cells(df: DataFrame, by: list[str], x: str, qs: list[float]) -> DataFrame:
    """(by..., __n, __one, __at, __c, __s, __upto): a group's values in order, as cells of one value (__one) near the quantiles and of all values between elsewhere.

    A sketch of bounded size brackets each quantile; what lies between brackets is counted before the shuffle, so a group's
    sorted cells are at most its values inside brackets, however large the group.
    """
    v = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__v"))
    ends = [min(max(q + d, 0.0), 1.0) for q in qs for d in (-WIDTH, WIDTH)]
    found = v.groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx("__v", ends, ACCURACY).alias("__e"))
    rows = _with(v, found.withColumn("__e", F.when(F.col("__n") > WHOLE, F.col("__e"))), by)
    one, gap = F.col("__e").isNull(), F.lit(0)
    for i in range(len(qs)):
        one = one | F.col("__v").between(F.col("__e")[2 * i], F.col("__e")[2 * i + 1])
        gap = gap + (F.col("__v") > F.col("__e")[2 * i + 1]).cast("int")
    keyed = rows.select(*by, "__n", "__v", one.alias("__one"), F.when(one, F.col("__v")).alias("__key"), F.when(~one, gap).alias("__gap"))
    cells = keyed.groupBy(*by, "__n", "__one", "__key", "__gap").agg(F.max("__v").alias("__at"), F.count("*").alias("__c"), F.sum("__v").alias("__s"))
    w = Window.partitionBy(*by).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.drop("__key", "__gap").withColumn("__upto", F.sum("__c").over(w))


def _exactly(value: Column) -> Column:
    """value where a cell is one value; a rank that no bracket holds stops the query, as nothing exact is known of it."""
    return F.when(F.col("__one"), value).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))


def quantiles(df: DataFrame, by: list[str], x: str, qs: dict[str, float]) -> DataFrame:
    """(by..., n, one column for each of qs): exact quantiles of the values that are not null, interpolated between neighbours.

    Two passes over df; groups without values have no row. NaN counts as the largest value.
    """
    n = F.col("__n")
    cells = _cells(df, by, x, sorted(set(qs.values())))
    at = lambda r: F.max(F.when((r >= F.col("__upto") - F.col("__c")) & (r < F.col("__upto")), _exactly(F.col("__at"))))
    ranks = {k: (n - 1) * F.lit(float(q)) for k, q in qs.items()}
    both = [f(p, k) for k, p in ranks.items() for f in (lambda p, k: at(F.floor(p)).alias(f"__lo_{k}"), lambda p, k: at(F.ceil(p)).alias(f"__hi_{k}"))]
    got = cells.groupBy(*by, "__n").agg(*both)
    lo, hi = (lambda k: F.col(f"__lo_{k}")), (lambda k: F.col(f"__hi_{k}"))
    mixed = lambda k, p: F.when(lo(k) == hi(k), lo(k)).otherwise(lo(k) * (F.ceil(p) - p) + hi(k) * (p - F.floor(p))).alias(k)
    return got.select(*by, n.alias("n"), *[mixed(k, p) for k, p in ranks.items()])


def medians_and_mads(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by..., median, mad): mad is unscaled. Both by bracketed selection, so no task holds a large group's values."""
    median = quantiles(df, by, x, {"median": 0.5}).drop("n")
    off = _with(df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__x")), median, by)
    away = off.select(*by, "median", F.abs(F.col("__x") - F.col("median")).alias("__off"))
    return quantiles(away, [*by, "median"], "__off", {"mad": 0.5}).select(*by, "median", "mad")


def scaled_mad(mad: Column) -> Column:
    """0 for no rows."""
    return F.coalesce(MAD_SCALE * mad, F.lit(0.0))


def robust_mean(df: DataFrame, by: list[str], x: str, trim: float = 0.1) -> DataFrame:
    """(by..., n, robust_mean): the mean without floor(trim * n) values at either end; of fewer than 3 values, the mean."""
    n, c, upto = F.col("__n"), F.col("__c"), F.col("__upto")
    cut = F.when(n < 3, 0).otherwise(F.floor(n * F.lit(float(trim))))
    kept = F.greatest(F.least(upto, n - cut) - F.greatest(upto - c, cut), F.lit(0))
    total = F.when(kept == 0, 0.0).when(kept == c, F.col("__s")).otherwise(kept * _exactly(F.col("__at")))
    cells = _cells(df, by, x, [trim, 1.0 - trim])
    return cells.groupBy(*by, n.alias("n")).agg((F.sum(total) / F.sum(kept)).alias("robust_mean"))


def trimmed_mean_of(values: Column, trim: float = 0.1) -> Column:
    """robust_mean of a short array, such as a region's patches."""
    n = F.size(values)
    k = F.when(n < 3, 0).otherwise(F.floor(n * trim)).cast("int")
    kept = F.slice(F.array_sort(values), k + 1, n - 2 * k)
    return F.when(n > 0, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept))


def robust_z(x: Column, median: Column, mad: Column, eps: float = EPS) -> Column:
    return (x - median) / (MAD_SCALE * mad + eps)


def variation(x: str) -> Column:
    """Sample standard deviation over the absolute mean; null for a zero mean."""
    return F.when(F.avg(x) != 0, F.stddev_samp(x) / F.abs(F.avg(x)))


def relative_drift(base: Column, value: Column) -> Column:
    return F.abs(value - base) / F.greatest(F.abs(base), F.lit(1e-9))


def to_pixels(share: float, anchor: Column, odd: bool = False, least: int = 1) -> Column:
    """A length in pixels from a share of the anchor: half-even rounding, then the least, then the next odd number if asked."""
    n = F.greatest(F.bround(anchor * share, 0).cast("int"), F.lit(least))
    return F.when(n % 2 == 0, n + 1).otherwise(n) if odd else n


def least_support(share: float, anchor: Column) -> Column:
    """The smallest area in pixels from a share of the squared anchor."""
    return F.greatest(F.bround(anchor * anchor * share, 0).cast("int"), F.lit(1))


def unit_scale(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """df with ``unit``: x between its group's 1st and 99th percentile, clipped to 0..1; a flat group and a null give 0."""
    ends = quantiles(df, by, x, {"__lo": 0.01, "__hi": 0.99}).drop("n")
    v = F.when(F.col("__hi") > F.col("__lo"), F.least(F.greatest((F.col(x) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return _with(df, ends, by, "left").withColumn("unit", v).drop("__lo", "__hi")


def even_subsample(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly spaced in order, both ends included; picks that round to one row count once."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"__r": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(max(most - 1, 1)), 0).cast("int")))
    return ranked.where((F.col("__n") <= most) | F.array_contains(picks, F.col("__r").cast("int"))).drop("__r", "__n")
