"""Distribution statistics: mean/std (A3), exact histograms (A8), exact
quantiles (A9), Gaussian smoothing of a binned series (W6).

Nothing here gathers a column in one place: the histogram is a hash
aggregate on the bin index, the quantile is found by range partitioning
plus per-partition counts, and smoothing is an equi-join of bins with
kernel offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import reliable_checkpoint
# Fixed values of the reference's similarity audit and map axes.
HIST_BINS = 50
FIXED_HIST_BINS = 100
FIXED_HIST_RANGE = (0.2, 1.0)
SMOOTH_SIGMA = 2.0
SMOOTH_TRUNCATE = 4.0
AXIS_PERCENTILES = (0.02, 0.98)
AXIS_MARGIN = 0.1
DECIMALS = 6
SALT_SEED = 7


def mean_std(df: DataFrame, col: str) -> DataFrame:
    """A3: n, mean and population standard deviation of a column."""
    return df.agg(F.count(col).alias("n"),
                  F.round(F.avg(col), DECIMALS).alias("mean_sim"),
                  F.round(F.stddev_pop(col), DECIMALS).alias("std_sim"))


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS,
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram over [lo, hi] (data range when not given).

    Right edge of the last bin is closed; values outside are dropped; every
    bin is reported, empty ones with 0.  Output (bin, lo_edge, hi_edge, n)."""
    v = F.col(col).cast("double")
    if lo is None or hi is None:
        # read for the range and for the counts: computed once
        df = reliable_checkpoint(df.select(col))
    lo_c = F.lit(float(lo)) if lo is not None else df.select(F.min(v)).scalar()
    hi_c = F.lit(float(hi)) if hi is not None else df.select(F.max(v)).scalar()
    width = (hi_c - lo_c) / bins
    idx = F.least(F.floor((v - lo_c) * bins / (hi_c - lo_c)), F.lit(bins - 1)).cast("int")
    counts = (df.where(v.between(lo_c, hi_c))
              .select(F.when(hi_c > lo_c, idx).otherwise(F.lit(0)).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (axis.join(counts, "bin", "left")
            .select("bin",
                    F.round(lo_c + F.col("bin") * width, DECIMALS).alias("lo_edge"),
                    F.round(lo_c + (F.col("bin") + 1) * width, DECIMALS).alias("hi_edge"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def exact_quantiles(df: DataFrame, col: str, probs) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy 'linear').

    Scales without gathering the column: values are range-partitioned and
    sorted within partitions, each partition's row count gives its global
    offset, and only the rows at the wanted ranks are kept.  The ranges come
    from a sample, so the ranged values are checkpointed: the counts and the
    ranks see the same partitions.  Output: one row with a column ``q_<i>``
    per probability."""
    vals = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    nparts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # a seeded salt as the second range key splits a hot value (a third of
    # all rows equal) over several partitions; order by value is unchanged
    salted = vals.withColumn("_salt", F.rand(SALT_SEED))
    ranged = salted.repartitionByRange(nparts, "v", "_salt").sortWithinPartitions("v", "_salt")
    pos = reliable_checkpoint(ranged.select("v", F.spark_partition_id().alias("pid"),
                                            F.monotonically_increasing_id().alias("mid")))
    counts = pos.groupBy("pid").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("off", F.coalesce(F.sum("c").over(before), F.lit(0)))
               .withColumn("total", F.sum("c").over(Window.partitionBy())))
    rank = F.col("off") + (F.col("mid") - F.shiftleft(F.col("pid").cast("long"), 33))
    ranked = pos.join(offsets, "pid").select("v", rank.alias("r"), "total")
    keep = None
    aggs = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("total") - 1)
        lo, hi = F.floor(h), F.ceil(h)
        cond = (F.col("r") == lo) | (F.col("r") == hi)
        keep = cond if keep is None else keep | cond
        v_lo = F.max(F.when(F.col("r") == lo, F.col("v")))
        v_hi = F.max(F.when(F.col("r") == hi, F.col("v")))
        frac = F.max(h - lo)
        aggs.append((v_lo + (v_hi - v_lo) * frac).alias(f"q_{i}"))
    return ranked.where(keep).agg(*aggs)


def axis_limits(df: DataFrame, col: str, probs=AXIS_PERCENTILES,
                margin: float = AXIS_MARGIN) -> DataFrame:
    """Percentile limits widened by a margin of their span (map axes)."""
    q = exact_quantiles(df, col, probs)
    span = F.col("q_1") - F.col("q_0")
    return q.select(F.round("q_0", DECIMALS).alias("p_lo"), F.round("q_1", DECIMALS).alias("p_hi"),
                    F.round(F.col("q_0") - margin * span, DECIMALS).alias("axis_lo"),
                    F.round(F.col("q_1") + margin * span, DECIMALS).alias("axis_hi"))


def gaussian_weights(sigma: float = SMOOTH_SIGMA, truncate: float = SMOOTH_TRUNCATE):
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    total = sum(raw)
    return radius, [w / total for w in raw]


def gaussian_smooth(series: DataFrame, index_col: str = "bin", value_col: str = "n",
                    sigma: float = SMOOTH_SIGMA, truncate: float = SMOOTH_TRUNCATE) -> DataFrame:
    """1-D Gaussian filter with 'reflect' edges (d c b a | a b c d | d c b a).

    Each output index is joined to its 2r+1 source indices (an equi-join on
    the reflected index) and the weighted values are summed."""
    radius, weights = gaussian_weights(sigma, truncate)
    n = series.select(F.count(F.lit(1))).scalar()
    w_arr = F.array(*[F.lit(w) for w in weights])
    taps = (series.select(F.col(index_col).alias("out"))
            .select("out", F.posexplode(w_arr).alias("k", "w")))
    j = F.col("out") + F.col("k") - radius
    # reflect into [0, n-1]; indices at most one period out of range
    j = F.when(j < 0, -j - 1).when(j > n - 1, 2 * n - 1 - j).otherwise(j)
    taps = taps.withColumn("src", j.cast("int"))
    src = series.select(F.col(index_col).alias("src"), F.col(value_col).cast("double").alias("x"))
    return (taps.join(src, "src")
            .groupBy(F.col("out").alias(index_col))
            .agg(F.round(F.sum(F.col("w") * F.col("x")), DECIMALS).alias("smoothed")))
