"""Block statistics, smoothing kernels, spectra and normalisations of series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Speed of light in cm per fs.
LIGHT = 2.998e-5


def split_blocks(n: int, tau: float) -> tuple[int, int]:
    """(blocks, length) of n values; fewer than two blocks or a rest is an error."""
    size = int(tau)
    if size < 1 or n // size < 2:
        raise ValueError("fewer than two blocks")
    if n % size:
        raise ValueError(f"{n} values do not divide into blocks of {size}")
    return n // size, size


def block_average(series: DataFrame, tau: float, *, place: str = "i", value: str = "v") -> DataFrame:
    """mean, stderr, n_blocks of a series with places from 0: the standard error is that of the blocks' means."""
    _, size = split_blocks(series.count(), tau)
    means = series.groupBy(F.floor(F.col(place) / size).alias("b")).agg(F.avg(value).alias("m"))
    return means.agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("stderr"), F.count("*").alias("n_blocks"))


def block_convergence(series: DataFrame, sizes: list[int], *, place: str = "i", value: str = "v") -> DataFrame:
    """size, mean, stderr, n_blocks for block lengths; a rest at the end is left out."""
    spine = F.explode(F.array(*map(F.lit, sizes))).alias("size")
    own = series.select(F.col(place).alias("i"), F.col(value).alias("v"), spine).withColumn("b", F.floor(F.col("i") / F.col("size")))
    means = own.groupBy("size", "b").agg(F.avg("v").alias("m"), F.count("*").alias("c")).filter("c = size")
    return means.groupBy("size").agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("stderr"), F.count("*").alias("n_blocks"))


def count_segments(counts: DataFrame, n_frames: int, block: int = 100, threshold: float = 0.5, *, place: str = "frame_id", value: str = "n") -> DataFrame:
    """segment, start, stop: cuts where the mean count of a complete block differs from the last one's by more than the threshold; the last segment runs to the end."""
    means = counts.groupBy(F.floor(F.col(place) / block).cast("int").alias("b")).agg(F.avg(value).alias("m")).filter(F.col("b") < n_frames // block)
    by = W.orderBy("b")  # a row per block
    cuts = means.withColumn("cut", (F.abs(F.col("m") - F.lag("m").over(by)) > threshold) | (F.col("b") == 0)).filter("cut").select((F.col("b") * block).alias("start"))
    by = W.orderBy("start")
    return cuts.select((F.row_number().over(by) - 1).cast("int").alias("segment"), "start", F.coalesce(F.lead("start").over(by), F.lit(n_frames)).cast("int").alias("stop"))


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """The weights of a Gaussian kernel of width sigma (in samples), cut at truncate sigma."""
    half = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return [float(x) for x in w / w.sum()]


def reflected(place: Column, n: int | Column) -> Column:
    """A place beyond either end, mirrored at the end."""
    n = F.lit(n) if isinstance(n, int) else n
    p = F.pmod(place, 2 * n)
    return F.when(p < n, p).otherwise(2 * n - 1 - p)


def convolve(series: DataFrame, kernel: list[float], n: int, *, group: tuple[str, ...] = (), place: str = "i", value: str = "v", mirror: bool = True, out: str = "s") -> DataFrame:
    """group, place, out: a centred convolution of a series with places 0 to n - 1, mirrored or padded by zeros.

    Each value goes to the places that its weight reaches (one row per weight), and sums combine before the shuffle, so a task holds no series whole.
    """
    half = len(kernel) // 2
    weights = F.array(*[F.struct(F.lit(k - half).alias("o"), F.lit(w).alias("w")) for k, w in enumerate(kernel)])
    if mirror:
        # place p takes value at reflected(p + o): spread from p's side
        spine = series.select(*group, F.col(place).alias("_p"), F.explode(weights).alias("_k")).withColumn("_q", reflected(F.col("_p") + F.col("_k.o"), n))
        own = series.select(*group, F.col(place).alias("_q"), F.col(value).alias("_v"))
        both = spine.join(own, [*group, "_q"])
        return both.groupBy(*group, F.col("_p").alias(place)).agg(F.sum(F.col("_k.w") * F.col("_v")).alias(out))
    moved = series.select(*group, F.col(value).alias("_v"), F.col(place).alias("_p"), F.explode(weights).alias("_k")).withColumn("_q", F.col("_p") + F.col("_k.o")).filter((F.col("_q") >= 0) & (F.col("_q") < n))
    return moved.groupBy(*group, F.col("_q").cast("int").alias(place)).agg(F.sum(F.col("_k.w") * F.col("_v")).alias(out))


def smooth(series: DataFrame, n: int, sigma: float = 20.0, **names) -> DataFrame:
    """A Gaussian filter, mirrored at the ends, cut at four sigma."""
    return convolve(series, gaussian(sigma), n, **names)


def savgol_second(window: int = 9, poly: int = 3, delta: float = 1.0) -> list[float]:
    """Kernel weights of the second derivative of the polynomial fitted to a window."""
    half = window // 2
    a = np.vander(np.arange(-half, half + 1), poly + 1, increasing=True)
    return [float(x) for x in 2.0 * np.linalg.pinv(a)[2] / delta**2]


def spectrum(series: DataFrame, n: int, dt: float = 0.5, *, place: str = "i", value: str = "v") -> DataFrame:
    """k, wavenumber, power: the squared modulus of the Fourier transform of a Hann-windowed series, for frequencies 0 to n / 2, in cm^-1.

    Each value is spread over the frequencies, and the sums combine before the shuffle. n^2 / 2 terms: for series beyond some ten
    thousand values ``spectrum_fft`` takes the one series into one task.
    """
    hann = 0.5 - 0.5 * F.cos(2.0 * math.pi * F.col(place) / float(n - 1)) if n > 1 else F.lit(1.0)
    own = series.select(F.col(place).cast("long").alias("i"), (F.col(value) * hann).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("k"))
    phase = 2.0 * math.pi * F.pmod(F.col("i") * F.col("k"), F.lit(n)) / float(n)
    sums = own.groupBy("k").agg(F.sum(F.col("w") * F.cos(phase)).alias("re"), F.sum(F.col("w") * F.sin(phase)).alias("im"))
    return sums.select("k", (F.col("k") / float(n * dt) / LIGHT).alias("wavenumber"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def spectrum_fft(series: DataFrame, dt: float = 0.5, *, group: str = "series", place: str = "i", value: str = "v") -> DataFrame:
    """spectrum of each series of a group, by the fast transform; one series fits one task."""
    import pandas as pd

    def one(key, pdf):
        v = pdf.sort_values(place)[value].to_numpy(dtype=float)
        power = np.abs(np.fft.rfft(v * np.hanning(len(v)))) ** 2
        return pd.DataFrame({group: key[0], "k": np.arange(len(power)), "wavenumber": np.fft.rfftfreq(len(v), d=dt) / LIGHT, "power": power})

    kind = series.schema[group].dataType.simpleString()
    return series.groupBy(group).applyInPandas(one, f"{group} {kind}, k long, wavenumber double, power double")


def normalized_to_max(curves: DataFrame, value: str, group: tuple[str, ...] = (), within: Column | None = None) -> DataFrame:
    """value divided by its largest in the group (within a range, if given); groups whose largest is not positive stay."""
    top = F.max(F.when(within, F.col(value)) if within is not None else F.col(value)).over(W.partitionBy(*group))
    return curves.withColumn(value, F.col(value) / F.when(top > 0, top).otherwise(1.0))


def difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of a less that of b."""
    return a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key).select(key, (F.col("_a") - F.col("_b")).alias(value))


def slope_over_six(curve: DataFrame, x: str = "lag", y: str = "msd", low: float | None = None, high: float | None = None) -> DataFrame:
    """diffusion: a sixth of the slope of a line fitted to y over x."""
    own = curve
    if low is not None:
        own = own.filter(F.col(x) >= low)
    if high is not None:
        own = own.filter(F.col(x) <= high)
    return own.agg((F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")) / 6.0).alias("diffusion"))
