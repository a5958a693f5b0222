"""Kernels over the sliding windows of a series, many windows at once.

A window is a row of a strided view, so nothing is copied, and whatever two
windows share is worked out once for the series: digits, and the differences
between values some rows apart.  Ranks come from one sort of each window.  Long
inputs go through in steps of a bounded number of windows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from tickloom.functions.fold import fold

#: Values of the windows that are worked on at once.
STEP_VALUES = 1 << 17


def average_ranks(windows: np.ndarray) -> np.ndarray:
    """Ranks from 1 along each row, equal values sharing the mean; NaN comes last."""
    order = np.argsort(windows, axis=1, kind="stable")
    ordered = np.take_along_axis(windows, order, 1)
    n = windows.shape[1]
    place = np.broadcast_to(np.arange(n), windows.shape)
    starts = np.ones(windows.shape, bool)
    starts[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.maximum.accumulate(np.where(starts, place, 0), axis=1)
    ends = np.ones(windows.shape, bool)
    ends[:, :-1] = starts[:, 1:]
    last = np.minimum.accumulate(np.where(ends, place, n)[:, ::-1], axis=1)[:, ::-1]
    ranks = np.empty(windows.shape)
    np.put_along_axis(ranks, order, (first + last) / 2 + 1, 1)
    return ranks


def spearman(x: np.ndarray, y: np.ndarray, n: int, least: int = 3) -> np.ndarray:
    """The rank correlation of the complete pairs of each window of ``n``; NaN where it is undefined."""
    count = len(x) - n + 1
    out = np.full(max(count, 0), np.nan)
    whole = ~(np.isnan(x) | np.isnan(y))
    a, b = np.where(whole, x, np.nan), np.where(whole, y, np.nan)
    step = max(1, STEP_VALUES // n)
    for at in range(0, count, step):
        some = slice(at, min(at + step, count))
        good = sliding_window_view(whole, n)[some]
        m = good.sum(1)
        centre = ((m + 1) / 2)[:, None]
        u = np.where(good, average_ranks(sliding_window_view(a, n)[some]) - centre, 0.0)
        v = np.where(good, average_ranks(sliding_window_view(b, n)[some]) - centre, 0.0)
        size = np.sqrt((u * u).sum(1) * (v * v).sum(1))
        with np.errstate(all="ignore"):
            out[some] = np.where((m >= least) & (size > 0), (u * v).sum(1) / size, np.nan)
    return out


def rank_correlations(df: DataFrame, pairs: Sequence[tuple[str, str, str, int]], keys: Sequence[str], order: Sequence[str], back: int = 1) -> DataFrame:
    """``df`` with a column for each ``(x, y, out, n)`` of ``pairs``: the rank correlation over
    the ``n`` rows that end ``back`` rows before; null until there are so many.

    Only complete pairs count, of which there must be three.  Series are streamed;
    a few rows are carried from batch to batch.
    """
    most = max(n for *_, n in pairs) + back

    def step(state: dict[str, np.ndarray], rows: pd.DataFrame):
        names = {c for x, y, *_ in pairs for c in (x, y)}
        both = {c: np.r_[state[c], rows[c].to_numpy(dtype=float, na_value=np.nan)] if state else rows[c].to_numpy(dtype=float, na_value=np.nan) for c in names}
        new, total = len(rows), len(next(iter(both.values())))
        made = {}
        for x, y, out, n in pairs:
            # Windows that end at the rows `back` before the new ones.
            got = np.full(total, np.nan)
            if total >= n + back:
                got[n - 1 + back :] = spearman(both[x][: total - back], both[y][: total - back], n)
            made[out] = pd.array(got[total - new :], "Float64")
        return {c: v[-most:] for c, v in both.items()}, rows.assign(**made)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{out}` double" for _, _, out, _ in pairs)])
    return fold(df, keys, order, dict, step, schema)


def longest_runs(flags: np.ndarray) -> np.ndarray:
    """The longest run of true flags of each row."""
    now = np.zeros(len(flags), np.int64)
    best = now.copy()
    for column in flags.T:
        now = (now + 1) * column
        np.maximum(best, now, out=best)
    return best


def leading_digits(x: np.ndarray) -> np.ndarray:
    """The first of eleven digits, as rounded there; 0 for 0."""
    size = np.abs(x)
    size = np.where(size > 0, size, np.nan)
    lead = np.round(size / 10.0 ** np.floor(np.log10(size)), 10)
    return np.nan_to_num(np.floor(np.where(lead >= 10, lead / 10, np.where(lead < 1, lead * 10, lead)))).astype(int)


def _entropy(x: np.ndarray, tolerance: float, m: int) -> float:
    """The same of one window, all pairs at once."""
    if len(x) <= m + 1 or not tolerance > 0:
        return np.nan
    first = near = np.abs(x[:, None] - x[None, :]) <= tolerance
    matches = []
    for k in range(1, m + 2):
        if k > 1:
            near = near[:-1, :-1] & first[k - 1 :, k - 1 :]
        matches.append(int(near.sum()) - len(near))
    b, a = matches[m - 1], matches[m]
    return float(-np.log(a / b)) if a and b else np.nan


def sample_entropies(x: np.ndarray, n: int, m: int = 2, r: float = 0.2) -> np.ndarray:
    """-log(A / B) of each window of ``n``: pairs of templates of ``m + 1`` and of ``m`` values that
    match within ``r`` deviations; NaN where it is undefined.

    Two templates ``d`` rows apart match as far as their largest difference, which
    is found once for the series; a window counts those within its own tolerance.
    """
    count = len(x) - n + 1
    tolerance = r * sliding_window_view(x, n).std(1)
    if count == 1:
        return np.array([_entropy(x, tolerance[0], m)])
    matches = np.zeros((2, count), np.int64)
    for d in range(1, n - m + 1):
        apart = np.abs(x[d:] - x[:-d])
        for i in (0, 1):
            k = m + i
            # Templates that start t and t + d after a window's start, both inside it.
            inside = n - d - k + 1
            if inside > 0:
                far = sliding_window_view(apart, k).max(1)
                matches[i] += (sliding_window_view(far, inside)[:count] <= tolerance[:, None]).sum(1)
    b, a = matches
    with np.errstate(all="ignore"):
        return np.where((tolerance > 0) & (a > 0) & (b > 0) & (n > m + 1), -np.log(a / b), np.nan)


def order_statistics(x: np.ndarray, n: int) -> np.ndarray:
    """For each window of ``n`` values the twelve figures of :data:`tickloom.operators.features.ORDER_STATS`, as rows."""
    count = len(x) - n + 1
    out = np.empty((max(count, 0), 12))
    law = np.log10(1 + 1 / np.arange(1, 10))
    step = max(1, STEP_VALUES // n)
    for at in range(0, count, step):
        stop = min(at + step, count)
        some, got = x[at : stop + n - 1], out[at:stop]
        w = sliding_window_view(some, n)
        mean = w.mean(1)[:, None]
        above, below = w > mean, w < mean
        got[:, 0], got[:, 1] = above.sum(1), below.sum(1)
        got[:, 2], got[:, 3] = w.argmax(1) / n, w.argmin(1) / n
        got[:, 4], got[:, 5] = longest_runs(above), longest_runs(below)
        # Of values that occur again: all of their places, and the first of each.
        ordered = np.sort(w, axis=1)
        same = ordered[:, 1:] == ordered[:, :-1]
        place = np.zeros(w.shape, bool)
        place[:, :-1] |= same
        place[:, 1:] |= same
        first = place.copy()
        first[:, 1:] &= ~same
        got[:, 6] = place.sum(1) / n
        got[:, 7] = first.sum(1) / (n - same.sum(1))
        got[:, 8], got[:, 9] = np.where(place, ordered, 0.0).sum(1), np.where(first, ordered, 0.0).sum(1)
        digits = leading_digits(some)
        counts = np.stack([np.convolve(digits == k, np.ones(n, int), "valid") for k in range(1, 10)], 1)
        share = counts / n
        with np.errstate(all="ignore"):
            off = share - share.mean(1, keepdims=True)
            size = np.sqrt((off * off).sum(1) * ((law - law.mean()) ** 2).sum())
            got[:, 10] = np.where(share.std(1) > 0, (off * (law - law.mean())).sum(1) / size, np.nan)
        got[:, 11] = sample_entropies(some, n)
    return out
