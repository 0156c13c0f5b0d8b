"""Curve fits and bootstrap intervals per cell, on tables of a few bins or units."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.curves import HOLDOUT_SPLIT, LN2, MIN_BIN_WINDOWS, N_BINS
from tessella.scratch import Scratch

#: Largest mean relative error on the held-out bins.
HOLDOUT_ERROR = 0.05
REPLICATES = 300


def _linear(basis: np.ndarray, y: np.ndarray, w: np.ndarray, low: tuple, high: tuple) -> tuple[float, np.ndarray]:
    """Least squares of y = a * basis + b inside a box; the error and (a, b)."""
    best = (math.inf, np.zeros(2))
    design = np.c_[basis, np.ones_like(basis)] * w[:, None]
    free = np.linalg.lstsq(design, y * w, rcond=None)[0]
    tries = [free] if all(l <= v <= h for v, l, h in zip(free, low, high)) else []
    if not tries:
        for a in (low[0], high[0]):
            tries.append(np.array([a, np.clip(np.average(y - a * basis, weights=w**2), low[1], high[1])]))
        for b in (low[1], high[1]):
            a = ((y - b) * basis * w**2).sum() / max((basis**2 * w**2).sum(), 1e-300)
            tries.append(np.array([np.clip(a, low[0], high[0]), b]))
    for p in tries:
        err = float(((y - p[0] * basis - p[1]) ** 2 * w**2).sum())
        best = min(best, (err, p), key=lambda t: t[0])
    return best


def _search(family, y: np.ndarray, w: np.ndarray, grid: np.ndarray, low: tuple, high: tuple) -> tuple[float, float, float]:
    """The one nonlinear parameter by grid and golden section, the two linear ones inside."""
    error = lambda t: _linear(family(t), y, w, low, high)[0]
    errors = [error(t) for t in grid]
    k = int(np.argmin(errors))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    gold = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - gold * (b - a), a + gold * (b - a)
        if error(c) < error(d):
            b = d
        else:
            a = c
    t = (a + b) / 2
    if errors[k] < error(t):
        t = grid[k]
    p = _linear(family(t), y, w, low, high)[1]
    return float(p[0]), float(t), float(p[1])


def power_law(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float, float]:
    """A, beta, L of y = A x**-beta + L, in the box 0..50, 0..3, 0..10."""
    w = np.ones_like(y) if w is None else w
    return _search(lambda t: x**-t, y, w, np.linspace(0, 3, 61), (0, 0), (50, 10))


def saturating(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """A, tau, L of y = A exp(-x / tau) + L, in the box 0..50, 1..1e6, 0..10."""
    return _search(lambda t: np.exp(-x / t), y, np.ones_like(y), np.geomspace(1, 1e6, 121), (0, 0), (50, 10))


def log_linear(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of y = a - b ln x, in the box -50..50, -10..10."""
    _, p = _linear(-np.log(x), y, np.ones_like(y), (-10, -50), (10, 50))
    return float(p[1]), float(p[0])


def gated_fit(bins: pd.DataFrame) -> dict:
    """Power law on the bins up to the split, judged on the contiguous bins beyond it.

    Accepted if its mean relative error there is below HOLDOUT_ERROR and no
    larger than that of the two other forms. Parameters of a rejected fit are
    null.
    """
    out = {"accepted": False, "reason": None, "a": None, "beta": None, "l_inf": None, "relerr": None}
    v = bins[bins.n_windows >= MIN_BIN_WINDOWS].sort_values("bin")
    if len(v) and list(v.bin) != list(range(v.bin.iloc[0], v.bin.iloc[-1] + 1)):
        return out | {"reason": "non-contiguous valid-bin support"}
    fit, hold = v[v.mid <= HOLDOUT_SPLIT], v[v.mid > HOLDOUT_SPLIT]
    if len(fit) < 5 or len(hold) < 2:
        return out | {"reason": "insufficient bins for the holdout gate"}
    x, y, xh, yh = (c.to_numpy(float) for c in (fit.mid, fit.bpb, hold.mid, hold.bpb))
    miss = lambda pred: float(np.mean(np.abs(pred - yh) / np.maximum(yh, 1e-9)))
    a, beta, low = power_law(x, y)
    sa, tau, sl = saturating(x, y)
    la, lb = log_linear(x, y)
    mine, others = miss(a * xh**-beta + low), (miss(sa * np.exp(-xh / tau) + sl), miss(la - lb * np.log(xh)))
    if mine < HOLDOUT_ERROR and all(mine <= o for o in others):
        return out | {"accepted": True, "a": a, "beta": beta, "l_inf": low, "relerr": mine}
    return out | {"reason": "failed holdout gate", "relerr": mine}


def fits(bins: DataFrame, key: str = "cell_name") -> DataFrame:
    """One fit per key; a group is at most N_BINS rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: pdf[key].iloc[0]} | gated_fit(pdf)])

    return bins.select(key, "bin", "mid", "bpb", "n_windows").groupBy(key).applyInPandas(run, f"{key} string, accepted boolean, reason string, a double, beta double, l_inf double, relerr double")


def bootstrap_gain(nll: np.ndarray, size: np.ndarray, decade: list[int], top: int, seed: int, replicates: int = REPLICATES) -> tuple[float | None, float | None, int]:
    """Percentile interval of the context gain over resampled units, bins frozen; replicates without bytes are skipped."""
    rng = np.random.default_rng(seed)
    gains, skipped = [], 0
    for _ in range(replicates):
        pick = rng.integers(0, len(nll), len(nll))
        n, b = nll[pick].sum(0), size[pick].sum(0)
        if b[top] <= 0 or b[decade].sum() <= 0:
            skipped += 1
            continue
        gains.append(n[decade].sum() / LN2 / b[decade].sum() - n[top] / LN2 / b[top])
    return *_percentiles(gains), skipped


def _percentiles(gains: list[float]) -> tuple[float | None, float | None]:
    if len(gains) <= 20:
        return None, None
    low, high = np.percentile(gains, [2.5, 97.5])
    return float(low), float(high)


# Chances that a Poisson(1) variable is at most 0, 1, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def multiplicities(units: np.ndarray, seed: int, replicates: int = REPLICATES) -> np.ndarray:
    """How often each unit (a 64-bit hash) is drawn in each replicate: Poisson(1), from hashes alone, so the same for any partitioning."""
    u = np.uint64

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
        return x ^ (x >> u(31))

    salt = mix(np.arange(1, replicates + 1, dtype=np.uint64) + (u(seed) << u(32)))
    h = mix(mix(units.astype(np.int64).view(np.uint64))[:, None] ^ salt[None, :])
    return np.searchsorted(_POISSON, (h >> u(11)).astype(float) / 2.0**53, side="right")


def _replicate_sums(key: str, seed: int) -> Callable:
    """Per task, cell and replicate the sums of nd, bd, nt, bt over units drawn by multiplicities()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            cells = np.array(batch.column(0).to_pylist(), object)
            hashes, *parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            values = np.column_stack(parts).astype(float)
            for at in range(0, len(cells), 2_000):
                m = multiplicities(hashes[at : at + 2_000], seed).astype(float)
                for c in set(cells[at : at + 2_000]):
                    mine = cells[at : at + 2_000] == c
                    sums[c] = sums.get(c, 0.0) + m[mine].T @ values[at : at + 2_000][mine]
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(s)), pa.array(np.arange(len(s), dtype=np.int32)), *[pa.array(s[:, i]) for i in range(4)]], names=[key, "replicate", "nd", "bd", "nt", "bt"])

    return run


def gain_intervals(nll_units: DataFrame, byte_units: DataFrame, bins: DataFrame, unit: str, key: str = "cell_name", seed: int = 7, floor: int = MIN_BIN_WINDOWS, most_units: int = 200_000) -> DataFrame:
    """Bootstrap interval of the gain per key, from unit-by-bin sums.

    Only the sums of a cell meet in one task: units x 19 numbers. A cell with
    more than ``most_units`` units is resampled where its units are: each unit
    counts Poisson(1) times in a replicate, and only the sums of replicates
    meet. Units are never merged.
    """
    cols = [f"b{b}" for b in range(N_BINS)]
    named = lambda df, p: df.select(key, F.col(unit).alias("__u"), *[F.col(c).cast("double").alias(f"{p}{c}") for c in cols])
    units = Scratch(bins.sparkSession).cut(named(nll_units, "n_").join(named(byte_units, "s_"), [key, "__u"]), "units")
    support = bins.where(F.col("n_windows") >= floor).groupBy(key).agg(F.collect_list(F.when(F.col("mid").between(16, 255.999999), F.col("bin"))).alias("decade"), F.max("bin").alias("top"))
    counted = Scratch(bins.sparkSession).cut(units.groupBy(key).agg(F.count(F.lit(1)).alias("n_units")).join(support, key), "counted")
    rows = units.join(F.broadcast(counted), key)  # one row per cell of the grid

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__u")
        decade, top = sorted(pdf["decade"].iloc[0]), int(pdf["top"].iloc[0])
        low = high = None
        skipped = 0
        if len(pdf) >= 4 and decade:
            nll, size = (pdf[[f"{p}{c}" for c in cols]].to_numpy(float) for p in ("n_", "s_"))
            low, high, skipped = bootstrap_gain(nll, size, decade, top, seed)
        return pd.DataFrame([{key: pdf[key].iloc[0], "n_units": len(pdf), "gain_low": low, "gain_high": high, "skipped": skipped}])

    schema = f"{key} string, n_units bigint, gain_low double, gain_high double, skipped bigint"
    out = rows.where(F.col("n_units") <= most_units).drop("n_units").groupBy(key).applyInPandas(run, schema)
    if not counted.where(F.col("n_units") > most_units).limit(1).count():
        return out

    def of_replicates(pdf: pd.DataFrame) -> pd.DataFrame:
        low = high = None
        skipped = 0
        if pdf["any_decade"].iloc[0]:
            # in a fixed order, so that sums are the same again
            s = pdf.sort_values(["replicate", "nd", "bd", "nt", "bt"]).groupby("replicate")[["nd", "bd", "nt", "bt"]].sum()
            ok = s[(s.bt > 0) & (s.bd > 0)]
            skipped = len(s) - len(ok)
            low, high = _percentiles(list(ok.nd / LN2 / ok.bd - ok.nt / LN2 / ok.bt))
        return pd.DataFrame([{key: pdf[key].iloc[0], "n_units": pdf["n_units"].iloc[0], "gain_low": low, "gain_high": high, "skipped": skipped}])

    decade = lambda p: sum((F.when(F.array_contains("decade", b), F.col(f"{p}{c}")).otherwise(0.0) for b, c in enumerate(cols)), F.lit(0.0))
    top = lambda p: F.element_at(F.array(*[f"{p}{c}" for c in cols]), F.col("top").cast("int") + 1)
    many = rows.where(F.col("n_units") > most_units).select(key, F.xxhash64("__u").alias("h"), decade("n_").alias("nd"), decade("s_").alias("bd"), top("n_").alias("nt"), top("s_").alias("bt"))
    sums = many.mapInArrow(_replicate_sums(key, seed), f"{key} string, replicate int, nd double, bd double, nt double, bt double")
    of = counted.select(key, "n_units", (F.size("decade") > 0).alias("any_decade"))
    return out.unionByName(sums.join(F.broadcast(of), key).groupBy(key).applyInPandas(of_replicates, schema))
