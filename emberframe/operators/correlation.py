"""Correlations in time: lags become rows, and each lag is an equi-join of a track with itself."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.functions import geometry as G
from emberframe.operators.selectors import FRAME
from emberframe.operators.stats import convolve, gaussian, savgol_second

TRACK = ("track",)


def displacements(tracks: DataFrame, lags: Sequence[int], keys: Sequence[str] = TRACK) -> DataFrame:
    """keys, idx, lag, d2: squared displacement over each lag. tracks: keys, idx, x, y, z with idx from 0 without gaps."""
    own = tracks.select(*keys, "idx", "x", "y", "z")
    start = own.withColumn("lag", F.explode(F.array(*[F.lit(int(v)) for v in lags]))).withColumn("then", F.col("idx") + F.col("lag"))
    end = own.select(*keys, F.col("idx").alias("then"), *[F.col(a).alias(f"e{a}") for a in "xyz"])
    both = start.join(end, [*keys, "then"])
    d = G.minus(G.vector("e"), G.vector(""))
    return both.select(*keys, "idx", "lag", G.dot(d, d).alias("d2"))


def track_msd(tracks: DataFrame, max_lag: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """keys, lag, msd, n of each track; lags that a track is too short for have no row."""
    return displacements(tracks, range(1, max_lag + 1), keys).groupBy(*keys, "lag").agg(F.avg("d2").alias("msd"), F.count("*").alias("n"))


def _with_lags(found: DataFrame, max_lag: int, columns: Sequence[Column]) -> DataFrame:
    spine = found.sparkSession.range(1, max_lag + 1).select(F.col("id").cast("int").alias("lag"))
    return spine.join(found, "lag", "left").select("lag", *columns)


def pooled_msd(tracks: DataFrame, max_lag: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """lag, msd, n, stderr (null) over all samples of all tracks."""
    found = displacements(tracks, range(1, max_lag + 1), keys).groupBy("lag").agg(F.avg("d2").alias("msd"), F.count("*").alias("n"))
    return _with_lags(found, max_lag, [F.col("msd"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("double").alias("stderr")])


def block_msd(tracks: DataFrame, max_lag: int, block: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """lag, msd, n, stderr: the mean over full blocks of each track, all with equal weight; without a full block, pooled_msd."""
    size = tracks.groupBy(*keys).agg((F.floor(F.count("*") / block) * block).alias("full"))
    own = tracks.join(size, list(keys)).filter(F.col("idx") < F.col("full")).withColumn("b", F.floor(F.col("idx") / block).cast("int")).withColumn("idx", F.col("idx") % block)
    if own.isEmpty():
        return pooled_msd(tracks, max_lag, keys)
    each = track_msd(own, max_lag, [*keys, "b"])
    found = each.groupBy("lag").agg(F.avg("msd").alias("msd"), F.count("*").alias("n"), (F.stddev_samp("msd") / F.sqrt(F.count("*"))).alias("stderr"))
    return _with_lags(found, max_lag, [F.col("msd"), F.coalesce("n", F.lit(0)).alias("n"), F.col("stderr")])


def msd(tracks: DataFrame, segments: DataFrame | None = None, *, max_lag: int | None = None, correlation_time: float | None = None, buffer: int = 5, block_size: int | None = None, n_blocks: int | None = None, dt: float = 1.0, keys: Sequence[str] = TRACK) -> DataFrame:
    """lag, time, msd, n, stderr of a formula's tracks. Short segments warn if a correlation time is given."""
    if block_size is not None and n_blocks is not None:
        raise ValueError("block_size or n_blocks, not both")
    sizes = tracks.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"), F.sum("n").alias("all")).first()
    if sizes["longest"] is None:
        raise ValueError("no tracks")
    if correlation_time is not None and segments is not None:
        short = segments.filter(F.col("stop") - F.col("start") < correlation_time * buffer).count()
        if short:
            warnings.warn(f"{short} segments are shorter than {buffer} correlation times", stacklevel=2)
    lag = max_lag if max_lag is not None else max(1, sizes["longest"] // 2)
    if n_blocks is not None:
        block_size = max(1, sizes["all"] // n_blocks)
    found = block_msd(tracks, lag, block_size, keys) if block_size else pooled_msd(tracks, lag, keys)
    return found.withColumn("time", F.col("lag") * float(dt))


def diffusion_per_track(tracks: DataFrame, max_lag: int, keys: Sequence[str] = TRACK, *, low: int = 1) -> DataFrame:
    """keys, diffusion: a sixth of the slope of each track's (or segment's) mean squared displacement over lags from low to max_lag."""
    curves = track_msd(tracks, max_lag, keys).filter(F.col("lag") >= low)
    return curves.groupBy(*keys).agg((F.regr_slope("msd", F.col("lag").cast("double")) / 6.0).alias("diffusion"))


def diffusive_window(curve: DataFrame, *, window_frac: float = 0.25, stride_frac: float = 0.05) -> DataFrame:
    """One row (first, last, onset, alpha, r2): the window of log msd over log lag whose slope is nearest to 1, weighed by its fit; the first of equals. curve: lag, msd."""
    valid = curve.filter("lag > 0 and msd > 0")
    n = valid.count()
    if n < 4:
        raise ValueError("fewer than four places")
    size = max(4, int(window_frac * n))
    stride = max(1, int(stride_frac * size))
    ranked = valid.withColumn("k", F.row_number().over(W.orderBy("lag")) - 1)  # a row per lag
    starts = F.filter(F.sequence(F.lit(0), F.lit(n - size), F.lit(stride)), lambda s: (F.col("k") >= s) & (F.col("k") < s + size))
    spread = ranked.select("lag", F.ln(F.col("lag").cast("double")).alias("lx"), F.ln("msd").alias("ly"), F.explode(starts).alias("s"))
    fits = spread.groupBy("s").agg(F.regr_slope("ly", "lx").alias("alpha"), F.regr_r2("ly", "lx").alias("fit"), F.var_pop("ly").alias("v"), F.min("lag").alias("first"), F.max("lag").alias("last"))
    fits = fits.withColumn("r2", F.when(F.col("v") > 0, F.col("fit")).otherwise(0.0))
    scored = fits.withColumn("score", F.abs(F.col("alpha") - 1.0) / F.greatest(F.col("r2"), F.lit(1e-6)))
    return scored.orderBy("score", "s").limit(1).select("first", "last", F.col("first").alias("onset"), "alpha", "r2")


def van_hove_rmax(tracks: DataFrame, lag: int, keys: Sequence[str] = TRACK) -> float:
    """1.1 times the 99th percentile of displacements over the largest lag, or 10."""
    p = displacements(tracks, [lag], keys).agg(F.percentile(F.sqrt("d2"), F.lit(0.99)).alias("p")).first()["p"]
    return 10.0 if p is None else 1.1 * p


def van_hove(tracks: DataFrame, lags: Sequence[int] = (1, 10, 50, 200), *, rmax: float | None = None, dr: float = 0.1, keys: Sequence[str] = TRACK) -> DataFrame:
    """lag, bin, r, p, n: the density of displacements (its sum times dr is 1) and the number of those binned."""
    n = len(G.edges(rmax if rmax is not None else van_hove_rmax(tracks, max(lags), keys), dr)) - 1
    binned = displacements(tracks, lags, keys).select("lag", G.bin_of(F.sqrt("d2"), 0.0, n * dr, n).alias("bin")).filter("bin is not null").groupBy("lag", "bin").agg(F.count("*").alias("c"))
    total = binned.groupBy("lag").agg(F.sum("c").alias("n"))
    spark = tracks.sparkSession
    spine = spark.range(n).select(F.col("id").cast("int").alias("bin"), F.explode(F.array(*[F.lit(int(v)) for v in lags])).alias("lag"))
    found = spine.join(binned, ["lag", "bin"], "left").join(total, "lag", "left")
    p = F.when(F.col("n") > 0, F.coalesce("c", F.lit(0)) / (F.col("n") * dr)).otherwise(0.0)
    return found.select("lag", "bin", ((F.col("bin") + 0.5) * dr).alias("r"), p.alias("p"), F.coalesce("n", F.lit(0)).alias("n"))


def _n_bins(curves: DataFrame) -> int:
    return curves.agg(F.max("bin")).first()[0] + 1


def van_hove_kde(curves: DataFrame, tracks: DataFrame, dr: float = 0.1, bandwidth: float | None = None, keys: Sequence[str] = TRACK) -> DataFrame:
    """curves with p smoothed by a Gaussian: of the bandwidth, or of Scott's rule for each lag's displacements."""
    n, lags = _n_bins(curves), sorted(r["lag"] for r in curves.select("lag").distinct().collect())
    widths = {v: bandwidth for v in lags}
    if bandwidth is None:
        stats = displacements(tracks, lags, keys).groupBy("lag").agg(F.stddev_pop(F.sqrt("d2")).alias("s"), F.count("*").alias("n")).collect()
        widths |= {r["lag"]: 1.06 * r["s"] * r["n"] ** -0.2 for r in stats}
    out = None
    for v in lags:  # a handful of lags, each with a kernel of its own
        part = curves.filter(F.col("lag") == v)
        s = convolve(part.select("bin", "p"), gaussian(max((widths[v] or dr) / dr, 0.5)), n, place="bin", value="p")
        part = part.drop("p").join(s, "bin").withColumn("lag", F.lit(v))
        out = part if out is None else out.unionByName(part)
    total = F.sum("s").over(W.partitionBy("lag")) * dr
    return out.withColumn("p", F.when(total > 0, F.col("s") / total).otherwise(F.col("s"))).select("lag", "bin", "r", "p", "n")


def van_hove_peaks(curves: DataFrame, dr: float = 0.1) -> DataFrame:
    """lag, peak: the place of the largest smoothed p (sigma 2 bins), refined by a parabola; null for lags without samples."""
    n = _n_bins(curves)
    s = convolve(curves.select("lag", "bin", "p"), gaussian(2.0), n, group=("lag",), place="bin", value="p")
    by = W.partitionBy("lag").orderBy("bin")
    near = s.withColumn("lo", F.lag("s").over(by)).withColumn("hi", F.lead("s").over(by)).withColumn("k", F.row_number().over(W.partitionBy("lag").orderBy(F.desc("s"), "bin"))).filter("k = 1")
    bend = F.col("lo") - 2.0 * F.col("s") + F.col("hi")
    delta = F.when(F.col("lo").isNull() | F.col("hi").isNull() | (bend == 0), 0.0).otherwise(0.5 * (F.col("lo") - F.col("hi")) / bend)
    some = curves.groupBy("lag").agg(F.max("n").alias("n"))
    return near.join(some, "lag").select("lag", F.when(F.col("n") > 0, (F.col("bin") + 0.5) * dr + delta * dr).alias("peak"))


def van_hove_map(curves: DataFrame, dr: float = 0.1, *, window: int = 9, poly: int = 3) -> DataFrame:
    """lag, bin, r, p (each lag's largest is 1) and d2: the second derivative of the p given, null below 5 % of the largest. The derivative near the ends is of the mirrored curve."""
    n = _n_bins(curves)
    d2 = convolve(curves.select("lag", "bin", "p"), savgol_second(window, poly, dr), n, group=("lag",), place="bin", value="p", out="d2")
    top = F.max("p").over(W.partitionBy("lag"))
    both = curves.join(d2, ["lag", "bin"]).withColumn("top", top)
    return both.select("lag", "bin", "r", F.when(F.col("top") > 0, F.col("p") / F.col("top")).otherwise(F.col("p")).alias("p"), F.when(F.col("p") >= 0.05 * F.col("top"), F.col("d2")).alias("d2"))


def hbond_acf(found: DataFrame, n_frames: int, max_lag: int = 200) -> DataFrame:
    """lag, c: over frames with bonds, the mean share of bonds that exist again lag frames later; 0 beyond the last frame. Lags from 1."""
    bond = ("donor", "h", "acceptor")
    own = found.select(FRAME, *bond)
    n = own.groupBy(FRAME).agg(F.count("*").alias("n"))
    start = own.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn("then", F.col(FRAME) + F.col("lag")).filter(F.col("then") < n_frames)
    again = start.join(own.withColumnRenamed(FRAME, "then"), ["then", *bond]).groupBy("lag", FRAME).agg(F.count("*").alias("k")).join(n, FRAME)
    sums = again.groupBy("lag").agg(F.sum(F.col("k") / F.col("n")).alias("s"))
    lags = found.sparkSession.range(1, max_lag + 1).select(F.col("id").cast("int").alias("lag"))
    # origins of a lag: frames with bonds that are lag or more before the end
    last = n.select((F.lit(n_frames - 1) - F.col(FRAME)).alias("room")).groupBy("room").agg(F.count("*").alias("o"))
    origins = last.withColumn("lag", F.explode(F.when(F.col("room") >= 1, F.sequence(F.lit(1), F.least(F.col("room"), F.lit(max_lag)))))).groupBy("lag").agg(F.sum("o").alias("o"))
    return lags.join(sums, "lag", "left").join(origins, "lag", "left").select("lag", F.coalesce(F.col("s") / F.col("o"), F.lit(0.0)).alias("c"))

