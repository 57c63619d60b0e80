"""Aggregates over all rows of one or more columns: the long frame and what is counted on it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lawfinder.functions import columns as C

#: Buckets in which running counts of a column's values are taken, less one cut than this between them; a power of two.
CUTS = 512
#: Distinct values of a column whose ranks (16 bytes each) are broadcast.
FEW_VALUES = 100_000


def check_columns(df: DataFrame, column: str | None, columns: Sequence[str] | None) -> list[str]:
    """The target columns: exactly one of the two must be given, and each must be numeric."""
    if (column is None) == (columns is None):
        raise ValueError("give either column or columns")
    names = [column] if column is not None else list(columns)
    if not names:
        raise ValueError("columns is empty")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for n in names:
        if n not in kinds:
            raise ValueError(f"no column {n!r}; there are {', '.join(kinds)}")
        if not isinstance(kinds[n], T.NumericType):
            raise TypeError(f"column {n!r} is {kinds[n].simpleString()}, not numeric")
    return names


def long_frame(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), discrete: bool = False) -> DataFrame:
    """(keep..., column_name, value): one row for each finite number in the columns."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    rows = df.select(*keep, F.explode(F.array(*pairs)).alias("_p")).select(*keep, "_p.column_name", "_p.value")
    rows = rows.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    return rows.withColumn("value", F.col("value").cast("bigint").cast("double")) if discrete else rows


def column_stats(rows: DataFrame, by: Sequence[str] = ("column_name",)) -> DataFrame:
    """Count, extremes, moments (population), quantiles and the sums that closed-form estimates need.

    Logarithms and inverses are those of IEEE arithmetic, so their means are not finite where values are zero.
    """
    v = F.col("value")
    ln = C.log(v)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min(v).alias("data_min"),
        F.max(v).alias("data_max"),
        F.avg(v).alias("data_mean"),
        F.stddev_pop(v).alias("data_stddev"),
        F.skewness(v).alias("data_skewness"),
        F.kurtosis(v).alias("data_kurtosis"),
        F.avg(v * v).alias("mean_square"),
        F.count_if(v > 0).alias("n_positive"),
        F.coalesce(F.sum(F.when(v > 0, v * v)), F.lit(0.0)).alias("positive_square"),
        F.coalesce(F.sum(F.when(v > 0, ln)), F.lit(0.0)).alias("positive_log"),
        F.avg(ln).alias("mean_log"),
        C.log(F.min(v)).alias("log_min"),
        F.stddev_pop(ln).alias("sd_log"),
        F.avg(C.quotient(F.lit(1.0), v)).alias("mean_inverse"),
    )


def quantiles(rows: DataFrame, at: Sequence[float], by: Sequence[str] = ("column_name",), exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Quantiles of each column, named q<percent>, interpolated linearly where they are exact.

    Exact ones come from the distinct values' running counts, so no task holds a column's values.
    """
    names = [f"q{100 * p:g}".replace(".", "_") for p in at]
    if not exact:
        return rows.groupBy(*by).agg(*[F.percentile_approx("value", F.lit(p), accuracy).alias(n) for p, n in zip(at, names, strict=True)])
    place = lambda p: (F.col("total") - 1) * F.lit(float(p))
    holds = lambda k: (F.col("before") <= k) & (k < F.col("upto"))
    picks = []
    for i, p in enumerate(at):
        picks += [F.max(F.when(holds(F.floor(place(p))), F.col("value"))).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(place(p))), F.col("value"))).alias(f"_hi{i}")]
    got = ecdf(rows, by).groupBy(*by).agg(F.max("total").alias("total"), *picks)
    part = lambda p: place(p) - F.floor(place(p))
    return got.select(*by, *[(F.col(f"_lo{i}") + part(p) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(n) for i, (p, n) in enumerate(zip(at, names, strict=True))])


def auto_bounds(rows: DataFrame) -> DataFrame:
    return rows.groupBy("column_name").agg(F.min("value").alias("lower_bound"), F.max("value").alias("upper_bound"))


def heavy_tail_flags(rows: DataFrame) -> DataFrame:
    """Excess kurtosis above 6, or the largest value above 3 times a positive 99th percentile; under 10 values never."""
    s = rows.groupBy("column_name").agg(F.count("*").alias("n"), F.kurtosis("value").alias("kurtosis"), F.max("value").alias("top"))
    s = s.join(quantiles(rows, (0.99,), exact=True).withColumnRenamed("q99", "p99"), "column_name")
    ratio = F.when(F.col("p99") > 0, F.col("top") / F.col("p99"))
    heavy = (F.col("n") >= 10) & ((F.col("kurtosis") > 6) | F.coalesce(ratio > 3, F.lit(False)))
    return s.select("column_name", "kurtosis", ratio.alias("max_over_p99"), heavy.alias("heavy_tailed"))


def rice_bins(n: Column) -> Column:
    return F.greatest(F.lit(2), (F.ceil(F.pow(n.cast("double"), F.lit(1 / 3)) - 1e-9) * 2).cast("int"))


def histogram(rows: DataFrame, bins: int | None = None, edges: Sequence[float] | None = None) -> DataFrame:
    """(column_name, bin_id, lo, hi, n, density) of the bins that hold values; ``bins`` None: Rice's rule.

    Given edges win; values outside them are left out. The last bin is closed. A constant column has one
    bin without width and density 1. The extremes come from one aggregate, the counts from another.
    """
    v = F.col("value")
    if edges is not None:
        edges = [float(e) for e in edges]
        last, step = len(edges) - 2, max(1, math.isqrt(len(edges)))
        array = lambda some: F.array(*[F.lit(e) for e in some])
        upto = lambda some: F.size(F.filter(some, lambda e: e <= F.col("value")))
        # two short searches, over every step-th edge and over the edges from there on
        first = (upto(array(edges[::step])) - 1) * step
        at = rows.where((v >= edges[0]) & (v <= edges[-1])).withColumn("_first", first)
        at = at.withColumn("bin_id", F.least(F.col("_first") + upto(F.slice(array(edges), F.col("_first") + 1, F.lit(step))) - 1, F.lit(last)))
        count = at.groupBy("column_name", "bin_id").agg(F.count("*").alias("n"))
        out = count.withColumn("lo", F.element_at(array(edges), F.col("bin_id") + 1)).withColumn("hi", F.element_at(array(edges), F.col("bin_id") + 2))
    else:
        range_ = rows.groupBy("column_name").agg(F.min(v).alias("_min"), F.max(v).alias("_max"), F.count("*").alias("_all"))
        range_ = range_.withColumn("_bins", rice_bins(F.col("_all")) if bins is None else F.lit(max(2, bins)))
        range_ = range_.withColumn("_width", (F.col("_max") - F.col("_min")) / F.col("_bins"))
        at = F.when(F.col("_width") == 0, 0).otherwise(F.least(F.floor((v - F.col("_min")) / F.col("_width")).cast("int"), F.col("_bins") - 1))
        # one row for each column: as small as the query that names the columns
        count = rows.join(F.broadcast(range_), "column_name").groupBy("column_name", "_min", "_width", "_bins", at.alias("bin_id")).agg(F.count("*").alias("n"))
        out = count.withColumn("lo", F.col("_min") + F.col("_width") * F.col("bin_id")).withColumn("hi", F.col("_min") + F.col("_width") * (F.col("bin_id") + 1))
    total = F.sum("n").over(Window.partitionBy("column_name"))  # at most as many rows as there are bins
    density = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("n") / (total * (F.col("hi") - F.col("lo"))))
    return out.withColumn("density", density).select("column_name", "bin_id", "lo", "hi", "n", "density")


def binned(rows: DataFrame, ranges: dict[str, tuple[float, float, int]]) -> DataFrame:
    """(column_name, bin_id, n) of equal bins between each column's known extremes: one aggregate, no pass for the extremes."""
    low, width, bins = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("int")
    for c, (a, b, k) in ranges.items():
        mine = F.col("column_name") == c
        low, width, bins = F.when(mine, F.lit(float(a))).otherwise(low), F.when(mine, F.lit(float((b - a) / k))).otherwise(width), F.when(mine, F.lit(int(k))).otherwise(bins)
    rows = rows.where(F.col("column_name").isin(*ranges)).select("column_name", "value", low.alias("_low"), width.alias("_width"), bins.alias("_bins"))
    at = F.when(F.col("_width") == 0, 0).otherwise(F.least(F.floor((F.col("value") - F.col("_low")) / F.col("_width")).cast("int"), F.col("_bins") - 1))
    return rows.groupBy("column_name", at.alias("bin_id")).agg(F.count("*").alias("n"))


def pmf(rows: DataFrame) -> DataFrame:
    """(column_name, value, n, pmf) of whole-number values."""
    count = rows.groupBy("column_name", F.col("value").cast("bigint").alias("value")).agg(F.count("*").alias("n"))
    total = rows.groupBy("column_name").agg(F.count("*").alias("_all"))
    return count.join(F.broadcast(total), "column_name").select("column_name", "value", "n", (F.col("n") / F.col("_all")).alias("pmf"))


def _cuts(values: DataFrame, by: Sequence[str], n: int = CUTS) -> DataFrame:
    """(by..., _q): up to ``n`` less one of the column's distinct values, in order: the bounds of the buckets in which its values are put in order.

    A plan may come to the cuts more than once and must find the same ones each time, in whatever order tasks end
    (approximate quantiles depend on it). So they are the values of the least hash (a bijection) in each remainder of the hashes.
    """
    h = F.xxhash64("value")
    some = values.groupBy(*by, F.pmod(h, F.lit(n - 1)).alias("_r")).agg(F.min_by("value", h).alias("_v"))
    return some.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_q"))


def _in_buckets(rows: DataFrame, cuts: DataFrame, by: Sequence[str], n: int = CUTS) -> DataFrame:
    """Add _b: how many of the cuts (column _q of ``cuts``) lie below the value, by halving, a projection for each step; ``n`` is a power of two."""
    small = F.broadcast(cuts)  # one row for each column
    rows = (rows.join(small, list(by)) if by else rows.crossJoin(small)).withColumn("_b", F.lit(0))
    step = n // 2
    while step:
        rows = rows.withColumn("_b", F.col("_b") + F.when(F.get("_q", F.col("_b") + (step - 1)) < F.col("value"), step).otherwise(0))
        step //= 2
    return rows.drop("_q")


def ecdf(rows: DataFrame, by: Sequence[str] = ("column_name",), cuts: int = CUTS) -> DataFrame:
    """(by..., value, n, before, upto, total): distinct values with their counts and running counts.

    Running counts are taken in buckets between some of the column's values, so one column with most rows is many tasks'
    work, however its values lie; what lies before each bucket comes from the buckets' counts.
    """
    by = list(by)
    count = rows.groupBy(*by, "value").agg(F.count("*").alias("n"))
    count = _in_buckets(count, _cuts(count, by, cuts), by, cuts)
    sums = count.groupBy(*by, "_b").agg(F.sum("n").alias("_n"))
    all_ = Window.partitionBy(*by)
    ahead = sums.select(*by, "_b", (F.sum("_n").over(all_.orderBy("_b")) - F.col("_n")).alias("_ahead"), F.sum("_n").over(all_).alias("total"))
    upto = F.sum("n").over(Window.partitionBy(*by, "_b").orderBy("value")) + F.col("_ahead")
    out = count.join(ahead, [*by, "_b"]).withColumn("upto", upto)
    return out.select(*by, "value", "n", (F.col("upto") - F.col("n")).alias("before"), "upto", "total")


def with_previous(rows: DataFrame, name: str = "previous", cuts: int = CUTS) -> DataFrame:
    """Add each distinct value's predecessor in its column (null for the first).

    Values are dealt to buckets between some of them; inside a bucket a window looks back, and a bucket's first
    value takes the largest one of the buckets before, from a table of one row for each bucket.
    """
    rows = _in_buckets(rows, _cuts(rows, ["column_name"], cuts), ["column_name"], cuts)
    tops = rows.groupBy("column_name", "_b").agg(F.max("value").alias("_top"))
    tops = tops.select("column_name", "_b", F.lag("_top").over(Window.partitionBy("column_name").orderBy("_b")).alias("_before"))
    inside = F.lag("value").over(Window.partitionBy("column_name", "_b").orderBy("value"))
    return rows.withColumn("_inside", inside).join(tops, ["column_name", "_b"]).withColumn(name, F.coalesce("_inside", "_before")).drop("_b", "_inside", "_before")


def correlation(df: DataFrame, columns: Sequence[str], method: str = "spearman") -> DataFrame:
    """(column_a, column_b, correlation) for all pairs; rows with a null or NaN in any column are left out."""
    columns = list(columns)
    clean = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    names = [f"x{i}" for i in range(len(columns))]
    if method == "spearman":
        # average ranks by way of the distinct values' running counts, and back by value: broadcast where these are few
        few = clean.agg(*[(F.approx_count_distinct(n, 0.03) <= FEW_VALUES).alias(n) for n in names]).first()
        rows = clean
        for i, n in enumerate(names):
            known = ecdf(clean.select(F.lit(n).alias("column_name"), F.col(n).alias("value")))
            rank = known.select(F.col("value").alias(n), ((F.col("before") + F.col("upto") + 1) / 2).alias(f"r{i}"))
            rows = rows.join(F.broadcast(rank) if few[n] else rank, n)
        clean, names = rows, [f"r{i}" for i in range(len(columns))]
    elif method != "pearson":
        raise ValueError("method must be spearman or pearson")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = clean.agg(*[F.corr(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs])
    each = [F.struct(F.lit(columns[a]).alias("column_a"), F.lit(columns[b]).alias("column_b"), F.col(f"c{min(a, b)}_{max(a, b)}").alias("correlation")) for a in range(len(columns)) for b in range(len(columns))]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def covariance(df: DataFrame, columns: Sequence[str], ddof: int = 1) -> DataFrame:
    """(column_a, column_b, covariance), and each column's mean as mean_a, in one aggregate."""
    columns = list(columns)
    clean = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    f = F.covar_samp if ddof else F.covar_pop
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = clean.agg(*[f(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs], *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))])
    each = [F.struct(F.lit(columns[a]).alias("column_a"), F.lit(columns[b]).alias("column_b"), F.col(f"m{a}").alias("mean_a"), F.col(f"c{min(a, b)}_{max(a, b)}").alias("covariance")) for a in range(len(columns)) for b in range(len(columns))]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def two_sample_ks(rows: DataFrame, group: str, first, second) -> DataFrame:
    """(n_first, n_second, ks_statistic) between the values of two groups: one running count over both."""
    two = rows.where(F.col(group).isin(first, second)).select("value", (F.col(group) == F.lit(first)).cast("int").alias("_a"))
    sizes = two.agg(F.sum("_a").alias("n_first"), (F.count("*") - F.sum("_a")).alias("n_second"))
    count = two.groupBy("value").agg(F.sum("_a").alias("_na"), F.count("*").alias("_n"))
    a = ecdf_counts(count, "_na").withColumnRenamed("_upto", "_fa")
    b = ecdf_counts(count.withColumn("_nb", F.col("_n") - F.col("_na")), "_nb").withColumnRenamed("_upto", "_fb")
    gap = F.max(F.abs(F.col("_fa") / F.col("n_first") - F.col("_fb") / F.col("n_second")))
    joined = a.join(b, "value").crossJoin(F.broadcast(sizes))  # sizes is one row
    return joined.groupBy("n_first", "n_second").agg(gap.alias("ks_statistic"))


def ecdf_counts(count: DataFrame, n: str) -> DataFrame:
    """Running totals of ``n`` over ``value``, in buckets."""
    rows = _in_buckets(count, _cuts(count, []), []).select("value", n, "_b")
    sums = rows.groupBy("_b").agg(F.sum(n).alias("_s"))
    ahead = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_ahead"))  # CUTS rows at most
    return rows.join(ahead, "_b").select("value", (F.sum(n).over(Window.partitionBy("_b").orderBy("value")) + F.col("_ahead")).alias("_upto"))
