"""Numeric kernels on one series at a time, in numpy: what columns cannot express.

Each takes and gives plain arrays; ``per_series`` runs one over every series of a table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: K-weighting, a high shelf and a high pass.
SHELF_HZ, SHELF_DB, SHELF_SLOPE = 1681.974450955533, 3.99984385397, 1.0
HIGH_PASS_HZ, HIGH_PASS_Q = 38.13547087602444, 0.5003270373
#: Pitch range and least confidence, vibrato range and least correlation.
PITCH_LOW, PITCH_HIGH, PITCH_ACCEPT = 40.0, 2000.0, 0.30
VIBRATO_LOW, VIBRATO_HIGH, VIBRATO_ACCEPT = 3.0, 9.0, 0.25
#: Costs of the alignment's steps.
DIAGONAL_EXTRA, GAP_SHARE, GAP_FREE = 0.05, 0.10, 0.40


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Whole frames of ``size`` every ``hop`` samples; a shorter series has none."""
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(n)


def power_spectrum(frame: np.ndarray) -> np.ndarray:
    """One-sided power of windowed frames, inner bins doubled, scaled by the window."""
    n = frame.shape[-1]
    w = hann(n)
    p = np.abs(np.fft.rfft(frame * w, axis=-1)) ** 2 / (w.sum() ** 2)
    p[..., 1 : (n + 1) // 2] *= 2
    return p


def phase_onset(frame: np.ndarray) -> np.ndarray:
    """Magnitude-weighted sine of half the second phase difference; 0 for two frames."""
    z = np.fft.rfft(frame * hann(frame.shape[-1]), axis=-1)
    out = np.zeros(len(frame))
    if len(frame) > 2:
        second = np.diff(np.angle(z), 2, axis=0)
        mag = np.abs(z[2:])
        out[2:] = (mag * np.abs(np.sin(second / 2))).sum(1) / np.maximum(mag.sum(1), 1e-30)
    return out


def combined_onset(flux, rms_rise_db, phase, semitones) -> np.ndarray:
    c = lambda v: np.clip(v, 0, 1)
    return c(0.40 * c(2 * np.asarray(flux)) + 0.25 * c(np.asarray(rms_rise_db) / 18) + 0.20 * np.asarray(phase) + 0.15 * c(np.abs(semitones) / 2))


def pitch(frame: np.ndarray, rate: float, low=PITCH_LOW, high=PITCH_HIGH) -> tuple[float, float]:
    """(Hz, confidence) by windowed autocorrelation with a parabolic lag; Hz is NaN where
    the confidence is too small."""
    n = len(frame)
    x = (frame - frame.mean()) * hann(n)
    r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n)) ** 2)[:n]
    if r[0] <= 0:
        return math.nan, 0.0
    a, b = max(2, int(rate / high)), min(n - 2, int(rate / low))
    if b <= a:
        return math.nan, 0.0
    k = a + int(np.argmax(r[a : b + 1]))
    confidence = float(r[k] / r[0])
    if confidence < PITCH_ACCEPT:
        return math.nan, confidence
    d = r[k - 1] - 2 * r[k] + r[k + 1]
    lag = k + (0.5 * (r[k - 1] - r[k + 1]) / d if d else 0.0)
    return rate / lag, confidence


#: Samples that a filter runs over at a time.
FILTER_BLOCK = 64


def biquad(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(output, state behind it) of a second-order section that starts in ``state``. Blocks
    are filtered together from rest, by their response to impulses; what a block's two state
    values at its start add follows from their own responses, and the states pass from block
    to block by a 2 by 2 matrix."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    size, n = FILTER_BLOCK, len(x)
    blocks = np.pad(x, (0, -n % size)).reshape(-1, size)
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    gain = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    free = np.zeros((size + 1, 2, 2))  # the state after k samples without input
    free[0] = np.eye(2)
    for k in range(size):
        free[k + 1] = step @ free[k]
    impulse = np.concatenate([[b[0]], [(free[k] @ gain)[0] for k in range(size - 1)]])
    lower = np.subtract.outer(np.arange(size), np.arange(size))
    out = blocks @ np.where(lower >= 0, impulse[np.maximum(lower, 0)], 0.0).T
    pushed = blocks @ np.stack([free[size - 1 - k] @ gain for k in range(size)])
    now, starts = np.zeros(2) if state is None else np.asarray(state, float), np.zeros((len(blocks), 2))
    for k in range(len(blocks)):
        starts[k] = now
        now = free[size] @ now + pushed[k]
    if n % size:  # the last block's samples only, not what it was filled up with
        rest = n % size
        now = free[rest] @ starts[-1] + sum(free[rest - 1 - k] @ gain * blocks[-1, k] for k in range(rest))
    return (out + starts @ free[:size, 0, :].T).reshape(-1)[:n], now


def high_shelf(rate: float, hz=SHELF_HZ, db=SHELF_DB, slope=SHELF_SLOPE) -> tuple[np.ndarray, np.ndarray]:
    g = 10 ** (db / 40)
    w = 2 * math.pi * hz / rate
    alpha = math.sin(w) / 2 * math.sqrt((g + 1 / g) * (1 / slope - 1) + 2)
    c, r = math.cos(w), 2 * math.sqrt(g) * alpha
    b = np.array([g * ((g + 1) + (g - 1) * c + r), -2 * g * ((g - 1) + (g + 1) * c), g * ((g + 1) + (g - 1) * c - r)])
    return b, np.array([(g + 1) - (g - 1) * c + r, 2 * ((g - 1) - (g + 1) * c), (g + 1) - (g - 1) * c - r])


def high_pass(rate: float, hz=HIGH_PASS_HZ, q=HIGH_PASS_Q) -> tuple[np.ndarray, np.ndarray]:
    w = 2 * math.pi * hz / rate
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    return np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2]), np.array([1 + alpha, -2 * c, 1 - alpha])


def k_sections(rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """At low rates the shelf moves down to stay within what the rate can hold."""
    return [high_shelf(rate, SHELF_HZ if SHELF_HZ < 0.45 * rate else 0.40 * rate), high_pass(rate)]


def k_weighted(x: np.ndarray, rate: float) -> np.ndarray:
    x = np.asarray(x, float)
    for b, a in k_sections(rate):
        x, _ = biquad(x, b, a)
    return x


#: Samples to either side that the interpolation between two samples looks at.
PEAK_REACH = 16


def true_peak(x: np.ndarray, factor: int = 4, reach: int = PEAK_REACH, padded: np.ndarray | None = None) -> float:
    """Largest magnitude among the samples and Lanczos values between them, and just before
    and behind them. ``padded`` has the ``reach`` samples before and behind, else silence."""
    x = np.asarray(x, float)
    if not len(x):
        return 0.0
    top = float(np.abs(x).max())
    padded = np.pad(x, reach) if padded is None else padded
    k = np.arange(-reach + 1, reach + 1)
    for phase in range(1, factor):
        t = phase / factor - k
        top = max(top, float(np.abs(np.convolve(padded, (np.sinc(t) * np.sinc(t / reach))[::-1], "valid")).max()))
    return top


def resample(x: np.ndarray, n: int) -> np.ndarray:
    return np.interp(np.linspace(0, max(len(x) - 1, 0), n), np.arange(len(x)), x) if len(x) else np.zeros(0)


def vibrato(cents: np.ndarray, step: float) -> tuple[float, float, float]:
    """(rate Hz, depth cents, residual ratio) of a detrended pitch curve; NaN if there is
    no periodicity between 3 and 9 Hz."""
    n = len(cents)
    if n < 4:
        return (math.nan,) * 3
    t = np.arange(n)
    from_middle, level = t - (n - 1) / 2, float(cents.mean())
    y = cents - level - float(from_middle @ (cents - level)) * 12 / (n * (n * n - 1.0)) * from_middle
    power = float((y * y).mean())
    a, b = max(1, math.ceil(1 / (VIBRATO_HIGH * step))), min(n // 2, int(1 / (VIBRATO_LOW * step)))
    if power < 1e-12 or b < a:
        return (math.nan,) * 3
    r = np.array([(y[:-k] * y[k:]).sum() / math.sqrt((y[:-k] ** 2).sum() * (y[k:] ** 2).sum() + 1e-30) for k in range(a, b + 1)])
    k = int(np.argmax(r))
    if r[k] < VIBRATO_ACCEPT:
        return (math.nan,) * 3
    return 1 / ((a + k) * step), math.sqrt(2 * power), 1 - float(r[k])


def decay_seconds(ir: np.ndarray, rate: float, bins: int = 64) -> tuple[float, float]:
    """(decay time to -60 dB, R squared) from backward-integrated energy between -5 and
    -25 dB; NaN below four bins or an R squared of 0.8."""
    energy = np.cumsum((np.asarray(ir, float) ** 2)[::-1])[::-1]
    if not len(energy) or energy[0] <= 0:
        return math.nan, math.nan
    at = np.unique(np.linspace(0, len(energy) - 1, bins).astype(int))
    db = 10 * np.log10(np.maximum(energy[at] / energy[0], 1e-30))
    use = (db <= -5) & (db >= -25)
    if use.sum() < 4:
        return math.nan, math.nan
    t, y = at[use] / rate, db[use]
    slope = np.polyfit(t, y, 1)[0]
    r2 = float(np.corrcoef(t, y)[0, 1] ** 2)
    return (-60 / slope, r2) if slope < 0 and r2 >= 0.8 else (math.nan, r2)


def harmonics(power: np.ndarray, hz: float, step: float, partials: int = 12, cents: float = 35.0) -> list[tuple]:
    """(order, Hz, cents off, power) of the peak within ``cents`` of each partial."""
    out = []
    for order in range(1, partials + 1):
        f = hz * order
        a, b = f * 2 ** (-cents / 1200) / step, f * 2 ** (cents / 1200) / step
        low, high = max(1, math.floor(a)), min(len(power) - 2, math.ceil(b))
        if high < low:
            break
        k = low + int(np.argmax(power[low : high + 1]))
        l, m, r = np.log(np.maximum(power[k - 1 : k + 2], 1e-30))
        d = l - 2 * m + r
        # only a real top is refined: elsewhere the parabola has its vertex far away
        at = (k + (0.5 * (l - r) / d if m > max(l, r) else 0.0)) * step
        out.append((order, float(at), 1200 * math.log2(at / f), float(power[k])))
    return out


def corridor(path: list[tuple[int, int]], n: int, m: int, scale: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last column of each row of an (n + 1) by (m + 1) table that lie within
    ``reach`` of a path found on means of ``scale`` frames."""
    rows = np.arange(n + 1)
    ends = np.array([(0, 0), *[((i + 0.5) * scale, (j + 0.5) * scale) for i, j in path if (i + 0.5) * scale < n and (j + 0.5) * scale < m], (n, m)], float)
    middle = np.interp(rows, ends[:, 0], ends[:, 1])
    # where the path stands still in one series, all columns from before to behind it
    low, high = np.minimum(middle, np.roll(middle, 1)), np.maximum(middle, np.roll(middle, -1))
    low[0], high[-1] = 0, m
    return np.clip(np.floor(low - reach), 0, m).astype(int), np.clip(np.ceil(high + reach), 0, m).astype(int)


def _columns(table: np.ndarray, base: int, start: int, count: int, fill: float) -> np.ndarray:
    """Columns ``start`` and on of a band whose first column is ``base``."""
    out = np.full((count, *table.shape[1:]), fill, table.dtype)
    a, b = max(start, base), min(start + count, base + len(table))
    if a < b:
        out[a - start : b - start] = table[a - base : b - base]
    return out


def align(
    cost, skip: float = 0.45, repeat: float = 0.45, band: int | None = None, step: float = 0.05, within: tuple[np.ndarray, np.ndarray] | None = None, shape: tuple[int, int] | None = None
) -> tuple[list[tuple[int, int]], float]:
    """Cheapest monotone path through a cost table (reference by target): diagonal steps,
    reference frames skipped, target frames repeated, and 1x2 and 2x1 steps at a little
    extra. For its first 0.4 s a gap that goes on costs a share of its first step, then the
    whole. ``band`` keeps the path near the diagonal, ``within`` (first and last column of
    each row) in a corridor. Raises if no path exists.

    ``cost`` is a matrix, or a function (row, first column, end column) with ``shape``. Only
    the corridor's cells are ever priced or kept: three bytes each, and three rows of sums.
    A row's cells are done together; only repeated target frames depend on the cell before
    in the row, and these are a plain scan over the band.
    """
    n, m = shape or cost.shape
    price_of = cost if callable(cost) else lambda i, a, b: cost[i, a:b]
    if within is None:
        at = np.arange(n + 1) * m // max(n, 1)
        within = (np.zeros(n + 1, int), np.full(n + 1, m)) if band is None else (np.maximum(0, at - band), np.minimum(m, at + band))
    first, last = within
    cheap = round(GAP_FREE / step)
    inf = math.inf

    def prices(i: int, start: int, count: int) -> np.ndarray:
        """What matching reference frame i - 1 with the frame before each column costs."""
        out = np.full(count, inf)
        a, b = max(start, 1), min(start + count, m + 1)
        if i >= 1 and a < b:
            out[a - start : b - start] = price_of(i - 1, a - 1, b - 1)
        return out

    # how a cell was entered: 0 match, 1 skip, 2 repeat; only the last rows' costs are kept
    best = [(np.zeros((0, 3)), 0)] * 2
    runs = (np.zeros((0, 3), np.int32), 0)
    came = []
    for i in range(n + 1):
        low, high = int(first[i]), int(last[i])
        width = high - low + 1
        now, run = np.full((width, 3), inf), np.zeros((width, 3), np.int32)
        how = np.zeros((width, 3), np.int8)
        if i == 0 and low == 0:
            now[0, 0] = 0.0
        if i:
            here = prices(i, low - 1, width + 1)
            here, left = here[1:], here[:-1]
            ways = [(_columns(*best[1], low - 1, width, inf), here, 1)]
            if m > 1:
                ways.append((_columns(*best[1], low - 2, width, inf), (here + left) / 2 + DIAGONAL_EXTRA, 2))
            if i > 1:
                ways.append((_columns(*best[0], low - 1, width, inf), (here + prices(i - 1, low, width)) / 2 + DIAGONAL_EXTRA, 3))
            for table, extra, way in ways:
                for prior in range(3):
                    total = table[:, prior] + extra
                    better = total < now[:, 0] - 1e-15
                    now[better, 0] = total[better]
                    how[better, 0] = way * 3 + prior
            one, one_run = _columns(*best[1], low, width, inf), _columns(*runs, low, width, 0)
            for prior in range(3):
                goes_on = one_run[:, prior] < cheap if prior == 1 else False
                total = one[:, prior] + np.where(goes_on, skip * GAP_SHARE, skip)
                better = total < now[:, 1] - 1e-15
                now[better, 1] = total[better]
                run[better, 1] = one_run[better, prior] + 1 if prior == 1 else 1
                how[better, 1] = prior
        # repeats: from the best of match and skip to the left, or the repeat to the left
        anew = (np.minimum(now[:, 0], now[:, 1]) + repeat).tolist()
        kind = np.where(now[:, 0] <= now[:, 1], 0, 1).tolist()
        sums, lengths, ways = [inf] * width, [0] * width, [0] * width
        before, length, share = inf, 0, repeat * GAP_SHARE
        for j in range(1, width):
            longer = before + (share if length < cheap else repeat)
            # of two as dear the gap begins anew, and has its cheap steps before it
            if longer < anew[j - 1] - 1e-15:
                before, length, ways[j] = longer, length + 1, 2
            else:
                before, length, ways[j] = anew[j - 1], 1, kind[j - 1]
            sums[j], lengths[j] = before, length
        now[:, 2], run[:, 2], how[:, 2] = sums, lengths, ways
        came.append(how)
        best, runs = [best[1], (now, low)], (run, low)
    end = best[1][0][m - int(first[n])] if first[n] <= m <= last[n] else np.full(3, inf)
    kind = int(np.argmin(end))
    total = end[kind]
    if total == inf:
        raise ValueError("no path within the band")
    return _walked(lambda i, j, kind: int(came[i][j - first[i], kind]), n, m, kind), float(total)


def _walked(came, n: int, m: int, kind: int) -> list[tuple[int, int]]:
    """The path back from a table's end; ``came(i, j, kind)`` is how a cell was entered."""
    path, i, j = [], n, m
    while (i, j) != (0, 0):
        how = came(i, j, kind)
        if kind == 0:
            path.append((i - 1, j - 1))
            way, kind = divmod(how, 3)
            i, j = i - (2 if way == 3 else 1), j - (2 if way == 2 else 1)
        elif kind == 1:
            i, kind = i - 1, how
        else:
            j, kind = j - 1, how
    return path[::-1]


def align_tables(cost: np.ndarray, skip: float = 0.45, repeat: float = 0.45, step: float = 0.05) -> list[tuple[list[tuple[int, int]], float]]:
    """``align`` of many whole tables of one shape (tables, n, m), a row of all at a time: the
    same sums and choices in the same order."""
    many, n, m = cost.shape
    cheap, inf = round(GAP_FREE / step), math.inf

    def back(table: np.ndarray, by: int) -> np.ndarray:
        out = np.full(table.shape, inf)
        out[:, by:] = table[:, : table.shape[1] - by]
        return out

    price = np.full((many, n + 1, m + 1), inf)
    price[:, 1:, 1:] = cost
    best = [np.full((many, m + 1, 3), inf)] * 2
    runs = np.zeros((many, m + 1, 3), np.int32)
    came = []
    for i in range(n + 1):
        now, run, how = np.full((many, m + 1, 3), inf), np.zeros((many, m + 1, 3), np.int32), np.zeros((many, m + 1, 3), np.int8)
        if i == 0:
            now[:, 0, 0] = 0.0
        else:
            here = price[:, i]
            ways = [(back(best[1], 1), here, 1)]
            if m > 1:
                ways.append((back(best[1], 2), (here + back(here, 1)) / 2 + DIAGONAL_EXTRA, 2))
            if i > 1:
                ways.append((back(best[0], 1), (here + price[:, i - 1]) / 2 + DIAGONAL_EXTRA, 3))
            for table, extra, way in ways:
                for prior in range(3):
                    total = table[:, :, prior] + extra
                    better = total < now[:, :, 0] - 1e-15
                    now[better, 0] = total[better]
                    how[better, 0] = way * 3 + prior
            for prior in range(3):
                goes_on = runs[:, :, prior] < cheap if prior == 1 else False
                total = best[1][:, :, prior] + np.where(goes_on, skip * GAP_SHARE, skip)
                better = total < now[:, :, 1] - 1e-15
                now[better, 1] = total[better]
                run[better, 1] = runs[better, prior] + 1 if prior == 1 else 1
                how[better, 1] = prior
        anew, kind = np.minimum(now[:, :, 0], now[:, :, 1]) + repeat, np.where(now[:, :, 0] <= now[:, :, 1], 0, 1)
        before, length = np.full(many, inf), np.zeros(many, np.int32)
        for j in range(1, m + 1):
            longer = before + np.where(length < cheap, repeat * GAP_SHARE, repeat)
            goes_on = longer < anew[:, j - 1] - 1e-15
            before, length = np.where(goes_on, longer, anew[:, j - 1]), np.where(goes_on, length + 1, 1)
            now[:, j, 2], run[:, j, 2], how[:, j, 2] = before, length, np.where(goes_on, 2, kind[:, j - 1])
        came.append(how)
        best, runs = [best[1], now], run
    end = best[1][:, m]
    if np.isinf(end.min(1)).any():
        raise ValueError("no path within the band")
    steps = np.stack(came, 1)
    return [(_walked(steps[k].item, n, m, kind), float(end[k, kind])) for k, kind in enumerate(end.argmin(1).tolist())]


#: Frames that are averaged at a time from level to level, and half the corridor's width.
SCALE, REACH = 4, 16
#: What a wider corridor must save to be taken for better.
GAIN = 1e-9


def coarser(x: np.ndarray, scale: int) -> np.ndarray:
    """Means of ``scale`` frames, the last of what is left: no frequency folds over, as it
    would if frames were left out."""
    starts = np.arange(0, len(x), scale)
    counts = np.diff(np.append(starts, len(x)))
    return np.add.reduceat(x, starts, axis=0) / counts.reshape(-1, *[1] * (x.ndim - 1))


def touches(path: list[tuple[int, int]], within: tuple[np.ndarray, np.ndarray], m: int) -> bool:
    """Whether a path runs along its corridor's edge, other than the table's own."""
    at = np.array([(i + 1, j + 1) for i, j in path]).reshape(-1, 2)
    low, high = within[0][at[:, 0]], within[1][at[:, 0]]
    return bool((((at[:, 1] <= low) & (low > 0)) | ((at[:, 1] >= high) & (high < m))).any())


def align_coarse_to_fine(x: np.ndarray, y: np.ndarray, cost, scale: int = SCALE, reach: int = REACH, **options) -> tuple[list[tuple[int, int]], float]:
    """The cheapest path between two series of frames, by one method at every length.

    Means of ``scale`` frames are aligned first, in the same way, down to series no longer
    than ``reach``, whose table is a corridor by itself. Each level looks within ``reach`` of
    the path of the coarser one; the corridor is widened, twice as far each time, until its
    path keeps off the edge and widening makes it no cheaper. ``cost(x, y)`` prices all pairs
    of some frames; it is only asked for a row of the corridor at a time.
    """
    n, m = len(x), len(y)
    row = lambda i, a, b: cost(x[i : i + 1], y[a:b])[0]
    if min(n, m) <= reach:
        return align(row, shape=(n, m), **options)
    path, _ = align_coarse_to_fine(coarser(x, scale), coarser(y, scale), cost, scale, reach, **options)
    rough, found, wide = path, None, reach
    while True:
        within = corridor(rough, n, m, scale, wide)
        whole = bool((within[0] == 0).all() and (within[1] == m).all())
        try:
            new = align(row, within=within, shape=(n, m), **options)
        except ValueError:
            if whole:
                raise
            new = None
        if new and (whole or (found and new[1] >= found[1] - GAIN and not touches(new[0], within, m))):
            return new if not found or new[1] < found[1] else found
        found, wide = (new if new and (not found or new[1] < found[1]) else found), wide * 2


def align_locked(x: np.ndarray, y: np.ndarray, cost, locked: list[tuple[int, int]], **options) -> tuple[list[tuple[int, int]], float]:
    """``align_coarse_to_fine`` with matches that must hold, strictly rising in both series.
    A locked match is a step of its own, so the stretches between are alone."""
    path, total, i, j = [], 0.0, 0, 0
    for a, b in [*locked, (len(x), len(y))]:
        if a < i or b < j:
            raise ValueError("locked matches must rise in both series")
        found, price = align_coarse_to_fine(x[i:a], y[j:b], cost, **options)
        path += [(i + p, j + q) for p, q in found]
        total += price
        if a < len(x):
            path.append((a, b))
            total += float(cost(x[a : a + 1], y[b : b + 1])[0, 0])
        i, j = a + 1, b + 1
    return path, total


#: Cells of a table up to which tables of one shape are done together, and cells of all these.
FEW, TOGETHER = 1 << 10, 1 << 18


def align_many(pairs: list[tuple[np.ndarray, np.ndarray, bool]], cost, reach: int = REACH, **options) -> list[tuple[list[tuple[int, int]], float]]:
    """``align_locked`` of many pairs (x, y, whether their last frames must match). Short ones,
    whose table is a corridor by itself, are done together by their shape."""
    out, short = [None] * len(pairs), {}
    for k, (x, y, ended) in enumerate(pairs):
        n, m = len(x) - ended, len(y) - ended
        if min(n, m) <= reach and n * m <= FEW and max(n, m) <= FEW and set(options) <= {"skip", "repeat", "step"}:
            short.setdefault((n, m), []).append(k)
        else:
            out[k] = align_locked(x, y, cost, [(n, m)] if ended else [], reach=reach, **options)
    for (n, m), places in short.items():
        most = max(1, TOGETHER // ((n + 1) * (m + 1)))
        for some in (places[k : k + most] for k in range(0, len(places), most)):
            price = np.stack([cost(pairs[k][0][:n], pairs[k][1][:m]) if n and m else np.zeros((n, m)) for k in some])
            for k, (path, total) in zip(some, align_tables(price, **options)):
                x, y, ended = pairs[k]
                out[k] = (path + [(n, m)], total + float(cost(x[n:], y[m:])[0, 0])) if ended else (path, total)
    return out


def anchors(path: list[tuple[int, int]], onset: np.ndarray, step: float, least: float = 0.35, apart: float = 1.0) -> list[tuple[int, int]]:
    """The path's ends and its landmarks: onsets, or a second after the last one kept."""
    kept: list = []
    for k, (i, j) in enumerate(path):
        if k in (0, len(path) - 1) or onset[j] >= least or (i - kept[-1][0]) * step >= apart:
            kept.append((i, j))
    return kept


def per_series(df: DataFrame, key: list[str], order: list[str], kernel, schema: str) -> DataFrame:
    """``kernel`` (a function of a series' rows, in order) on each series, a task at a time.
    A series is one recording: a recurrence cannot be split."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return kernel(rows.sort_values(order, kind="stable"))

    return df.groupBy(*key).applyInPandas(run, schema)
