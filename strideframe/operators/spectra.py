"""Spectral features of whole series, in one task per short series and several per long one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windowmath import spectrum
from ..session import materialize, spread

# Longest series whose transform is done in one task, and longest that is sent as one
# array so that many are transformed together.
WHOLE_ROWS = 1 << 20
ARRAY_ROWS = 1 << 10


def series_spectrum(df: DataFrame, keys: Sequence[str], sizes: DataFrame, size_key: str, *, limit: int = WHOLE_ROWS) -> DataFrame:
    """``total_energy, dominant_freq, centroid`` per key from ``(keys, pos, x)``.

    ``sizes`` gives ``n`` and ``fps`` per ``size_key``. Longer series go through the
    distributed transform, so no task holds more than about ``limit`` rows.
    """
    keys = list(keys)
    rows = df.join(sizes, size_key)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def whole(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos").x.to_numpy(float)
        e, d, c = spectrum(x[None, :], pdf.fps.to_numpy()[:1])[0]
        return pd.DataFrame([[*key, e, d, c]], columns=[*keys, "total_energy", "dominant_freq", "centroid"])

    def stacked(batches):
        for pdf in batches:
            out = np.zeros((len(pdf), 3))
            lengths = pdf.x.map(len).to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                out[at] = spectrum(np.stack(pdf.x.iloc[at].to_list()).astype(float), pdf.fps.to_numpy()[at])
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    names = ["total_energy", "dominant_freq", "centroid"]
    schema = f"{fields}, total_energy double, dominant_freq double, centroid double"
    longest = sizes.agg(F.max("n")).first()[0] or 0
    small = min(limit, ARRAY_ROWS)
    packed = rows.where(F.col("n") <= small).groupBy(*keys, "fps").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_a"))
    out = spread(packed.select(*keys, "fps", F.col("_a.x").alias("x")), *keys).mapInPandas(stacked, schema)
    if longest > small:
        middle = rows.where((F.col("n") > small) & (F.col("n") <= limit))
        out = out.unionByName(spread(middle, *keys).groupBy(*keys).applyInPandas(whole, schema))
    # NaN never equals a number: a missing series has missing energy but zero frequencies.
    out = out.withColumn("total_energy", F.when(~F.isnan("total_energy"), F.col("total_energy")))
    if longest > limit:
        out = out.unionByName(_long_spectrum(rows.where(F.col("n") > limit), keys, limit))
    return out


def _long_spectrum(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    missing = rows.groupBy(*keys).agg(F.count("x").alias("_v"), F.first("n").alias("n"), F.first("fps").alias("fps"))
    x = rows.select(*keys, "n", "pos", F.coalesce("x", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    half = dft(x, keys, limit).where(F.col("k") < F.floor(F.col("n") / 2))
    sized = half.select(*keys, "k", F.hypot("re", "im").alias("a")).join(missing, keys)
    freq = F.col("k") * F.col("fps") / F.col("n")
    beyond = F.when((F.col("k") > 0) & (F.col("a") > 0), F.struct(F.col("a"), -F.col("k")))
    out = sized.groupBy(*keys).agg(
        F.sum("a").alias("e"), F.sum(freq * F.col("a")).alias("fa"), F.max(beyond).alias("top"),
        F.first("fps").alias("fps"), F.first("n").alias("n"), F.first("_v").alias("_v"),
    )
    known = F.col("_v") > 0
    return out.select(
        *keys, F.when(known, F.col("e")).alias("total_energy"),
        F.when(known, F.coalesce(-F.col("top.col2") * F.col("fps") / F.col("n"), F.lit(0.0))).otherwise(0.0).alias("dominant_freq"),
        F.when(known & (F.col("e") > 0), F.col("fa") / F.col("e")).otherwise(0.0).alias("centroid"),
    )


def dft(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Discrete Fourier transform of ``(keys, n, pos, re, im)`` as ``(keys, n, k, re, im)``, any length.

    A transform of arbitrary length is a convolution with a chirp, done with
    power-of-two transforms, which split evenly into interleaved parts.
    """
    keys = list(keys)
    size = F.expr("CAST(shiftleft(1L, CAST(ceil(log2(2 * n - 1)) AS INT)) AS BIGINT)")
    # pos*pos mod 2n keeps the chirp angle exact for long series.
    square = lambda p: F.expr(f"CAST(CAST({p} AS DECIMAL(19,0)) * {p} % (2 * n) AS DOUBLE)")
    angle = square("pos") * np.pi / F.col("n")
    c, s = F.cos(angle), F.sin(angle)
    a = df.select(
        *keys, "n", size.alias("m"), "pos",
        (F.col("re") * c + F.col("im") * s).alias("re"), (F.col("im") * c - F.col("re") * s).alias("im"),
    )
    lengths = df.select(*keys, "n").distinct()
    offsets = lengths.select(*keys, "n", size.alias("m"), F.explode(F.sequence(1 - F.col("n"), F.col("n") - 1)).alias("j"))
    turn = F.expr("CAST(CAST(j AS DECIMAL(19,0)) * j % (2 * n) AS DOUBLE)") * np.pi / F.col("n")
    b = offsets.select(*keys, "n", "m", F.pmod("j", "m").alias("pos"), F.cos(turn).alias("re"), F.sin(turn).alias("im"))
    fa, fb = _power_two(a, keys, limit, 1), _power_two(b, keys, limit, 1)
    fb = fb.select(*keys, "pos", F.col("re").alias("re2"), F.col("im").alias("im2"))
    product = fa.join(fb, [*keys, "pos"]).select(
        *keys, "n", "m", "pos", (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"),
        (F.col("re") * F.col("im2") + F.col("im") * F.col("re2")).alias("im"),
    )
    back = _power_two(product, keys, limit, -1).where("pos < n")
    return back.select(
        *keys, "n", F.col("pos").alias("k"),
        ((F.col("re") * c + F.col("im") * s) / F.col("m")).alias("re"), ((F.col("im") * c - F.col("re") * s) / F.col("m")).alias("im"),
    )


def _power_two(df: DataFrame, keys: list[str], limit: int, sign: int) -> DataFrame:
    """Unscaled transform of length ``m`` (a power of two); absent positions are zero.

    Interleaved parts ``pos % p`` are transformed on their own, then every frequency
    combines one value per part, in blocks of frequencies.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    schema = f"{fields}, n bigint, m bigint, part bigint, k bigint, re double, im double"
    parts = F.greatest(F.lit(1), F.floor(F.col("m") / limit)).cast("bigint")
    rows = df.withColumn("part", F.pmod("pos", parts))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = int(pdf.m.iloc[0]), int(pdf.n.iloc[0])
        p = max(1, m // limit)
        x = np.zeros(m // p, complex)
        x[pdf.pos.to_numpy() // p] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy()
        y = np.fft.fft(x) if sign > 0 else np.fft.ifft(x) * len(x)
        k = np.arange(len(y))
        y = y * np.exp(-2j * np.pi * sign * k * int(key[-1]) / m)
        out = pd.DataFrame({"n": n, "m": m, "part": int(key[-1]), "k": k, "re": y.real, "im": y.imag})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "n", "m", "part", "k", "re", "im"]]

    first = materialize(rows.groupBy(*keys, "part").applyInPandas(one, schema))
    block = max(1, limit // 1024)
    first = first.withColumn("_b", F.floor(F.col("k") / block))

    def combine(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = int(pdf.m.iloc[0]), int(pdf.n.iloc[0])
        p = max(1, m // limit)
        pdf = pdf.sort_values(["part", "k"])
        low = pdf.k.to_numpy()[: len(pdf) // p]
        y = (pdf.re.to_numpy() + 1j * pdf.im.to_numpy()).reshape(p, -1)
        z = np.fft.fft(y, axis=0) if sign > 0 else np.fft.ifft(y, axis=0) * p
        pos = (low[None, :] + (m // p) * np.arange(p)[:, None]).ravel()
        out = pd.DataFrame({"n": n, "m": m, "pos": pos, "re": z.real.ravel(), "im": z.imag.ravel()})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "n", "m", "pos", "re", "im"]]

    return first.groupBy(*keys, "_b").applyInPandas(combine, f"{fields}, n bigint, m bigint, pos bigint, re double, im double")
