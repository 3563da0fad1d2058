"""Change points of monthly share series, one row a series with its values in an array.

Series of one length go to Python in Arrow batches, a row each, where all of a batch are smoothed and segmented together: a step of the EWMA is one
vector operation over all series, and PELT with a Gaussian kernel cost is optimal partitioning over a grid of possible breaks, which gives the
segmentation that pruning would. A fold over the array in the JVM took 30 times as long (nested lambdas aren't compiled).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAMBDA, WIDTH, BASELINE, MIN_SIZE, PENALTY, MIN_GROUPS = 0.2, 3.0, 12, 6, 10.0, 15
#: Breaks lie at multiples of this many months.
GRID, BATCH = 5, 128


def ewma_alarms(x: np.ndarray, lam: float = LAMBDA, width: float = WIDTH, baseline: int = BASELINE) -> list[tuple[int, float] | None]:
    """For each row of x (at, statistic) of the first month in which the smoothed values leave the limit upwards; None for short or quiet series.

    The limit of a month rests on the `baseline` months before it alone, so later values move no alarm. A level baseline has no limit and can't alarm.
    """
    count, n = x.shape
    if n <= baseline + 1:
        return [None] * count
    past = np.lib.stride_tricks.sliding_window_view(x, baseline, axis=1)
    mean, sd = past.mean(axis=2), past.std(axis=2, ddof=1)
    limit = width * (lam / (2 - lam)) ** 0.5
    at, statistic, e = np.full(count, -1), np.zeros(count), x[:, 0].copy()
    for t in range(1, n):
        e = lam * x[:, t] + (1 - lam) * e
        if t >= baseline:
            over, s = e - mean[:, t - baseline], sd[:, t - baseline]
            new = (at < 0) & (s > 1e-12) & (over > limit * s)
            at[new], statistic[new] = t, over[new] / s[new]
    return [(int(a), float(v)) if a >= 0 else None for a, v in zip(at, statistic)]


def segment_costs(x: np.ndarray) -> np.ndarray:
    """cost[s, i, j] of x[s, i:j] for series of one length under a Gaussian kernel whose width is the series' median squared distance."""
    count, n = x.shape
    d2 = (x[:, :, None] - x[:, None, :]) ** 2
    upper = np.triu_indices(n, 1)
    med = np.median(d2[:, upper[0], upper[1]], axis=1) if n > 1 else np.zeros(count)
    gram = np.exp(-np.clip(d2 / np.where(med > 0, med, 1.0)[:, None, None], 1e-2, 1e2))
    gram[:, np.arange(n), np.arange(n)] = 1.0
    total = np.zeros((count, n + 1, n + 1))
    total[:, 1:, 1:] = gram.cumsum(1).cumsum(2)
    diagonal = total[:, np.arange(n + 1), np.arange(n + 1)]
    inside = diagonal[:, None, :] - total - total.transpose(0, 2, 1) + diagonal[:, :, None]
    length = np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]
    return length - inside / np.where(length > 0, length, 1)


def segment_ends(x: np.ndarray, penalty: float = PENALTY, min_size: int = MIN_SIZE, grid: int = GRID) -> list[list[int]]:
    """For each row of x the ends of the segments of its cheapest segmentation, the last being the length. The first of equal starts is taken."""
    count, n = x.shape
    if n < 2 * min_size:
        return [[n] for _ in range(count)]
    cost = segment_costs(x)
    best = {0: np.zeros(count)}
    last: dict[int, np.ndarray] = {}
    for j in [*(k for k in range(0, n, grid) if k >= min_size), n]:
        starts = [i for i in best if j - i >= min_size]
        values = np.stack([best[i] + cost[:, i, j] + penalty for i in starts])
        at = values.argmin(axis=0)
        best[j], last[j] = values[at, np.arange(count)], np.array(starts)[at]
    out = []
    for s in range(count):
        ends, j = [], n
        while j > 0:
            ends.append(j)
            j = int(last[j][s])
        out.append(ends[::-1])
    return out


def pelt_alarms(x: np.ndarray, penalty: float = PENALTY, min_size: int = MIN_SIZE) -> list[tuple[int, float] | None]:
    """For each row of x (at, relative jump) of the first break with a higher mean of all that follows than of all before; None if there is none."""
    sd = x.std(axis=1)
    moving = np.flatnonzero(sd > 0)
    out: list[tuple[int, float] | None] = [None] * len(x)
    sums = np.cumsum(x, axis=1)
    for lo in range(0, len(moving), BATCH):
        part = moving[lo : lo + BATCH]
        for s, ends in zip(part, segment_ends(x[part] / sd[part, None], penalty, min_size)):
            for b in ends[:-1]:
                low, high = sums[s, b - 1] / b, (sums[s, -1] - sums[s, b - 1]) / (x.shape[1] - b)
                if x.shape[1] - b >= min_size and high > low:
                    out[s] = (b, float((high - low) / max(low, 1e-12)))
                    break
    return out


METHODS = {"ewma": ewma_alarms, "pelt": pelt_alarms}


def detect(series: DataFrame, lo: str, min_groups: int = MIN_GROUPS, methods: tuple[str, ...] = ("ewma", "pelt")) -> DataFrame:
    """series (signals.series_arrays, from month lo on) -> (cluster_id, company_id, method, period_month, statistic): the first alarm of each method.

    Series whose months add up to less than min_groups, and level ones, which can't alarm, never leave the JVM.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            x = np.array(pdf["share"].tolist(), float)
            for name in methods:
                found = METHODS[name](x)
                hits = [f for f in found if f is not None]
                rows = pdf.loc[np.array([f is not None for f in found]), ["cluster_id", "company_id"]]
                yield rows.assign(method=name, at=np.array([a for a, _ in hits], np.int32), statistic=np.array([v for _, v in hits], float))

    moving = series.where((F.col("n_total") >= min_groups) & (F.array_min("share") < F.array_max("share")))
    found = moving.select("cluster_id", "company_id", "share").mapInPandas(run, "cluster_id string, company_id string, method string, at int, statistic double")
    return found.select("cluster_id", "company_id", "method", F.add_months(F.lit(lo).cast("date"), F.col("at")).alias("period_month"), "statistic")
