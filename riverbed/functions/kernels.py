"""Functionals of one window or one series, in numpy: what windows of SQL can't say.

They take arrays of finite numbers in time order and return numbers, NaN where the window is too short or has no variance. `operators.stateful.rolling_apply` and
`operators.functional.per_series` run them over the rows of a key.
"""

from __future__ import annotations

import itertools
import math

import numpy as np

NAN = float("nan")


def finite(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return x[np.isfinite(x)]


def slope(x: np.ndarray, y: np.ndarray) -> float:
    d = x - x.mean()
    return float(d @ (y - y.mean()) / (d @ d))


# ---- memory and stationarity


def log_scales(n: int, least: int = 8, count: int = 20) -> np.ndarray:
    """Distinct whole numbers, evenly spaced in logarithms, from least to n // 4."""
    return np.unique(np.floor(10 ** np.linspace(math.log10(least), math.log10(n // 4), count) + 1e-9).astype(int))


def detrended(y: np.ndarray, s: int) -> np.ndarray:
    """Mean squared distance of each whole segment of s values from its own line."""
    seg = y[: len(y) // s * s].reshape(-1, s)
    t = np.arange(s) - (s - 1) / 2
    level = seg - seg.mean(1, keepdims=True)
    tilt = level @ t / (t @ t)
    return ((level - tilt[:, None] * t) ** 2).mean(1)


def hurst(x: np.ndarray) -> float:
    """Detrended fluctuation analysis: the slope of the mean fluctuation over segment length, both in logarithms; 100 values at least."""
    x = finite(x)
    if len(x) < 100:
        return NAN
    y = np.cumsum(x - x.mean())
    scales = [s for s in log_scales(len(x)) if s >= 4]
    size = np.array([np.sqrt(detrended(y, s)).mean() for s in scales])
    if len(scales) < 4 or (size <= 0).any():
        return NAN
    return slope(np.log(scales), np.log(size))


def fluctuation_exponents(x: np.ndarray, powers: tuple[float, ...], scales: tuple[int, ...]) -> list[float]:
    """Generalised Hurst exponents h(q), from segments laid from either end; 40 values and four scales at least."""
    x = finite(x)
    y = np.cumsum(x - x.mean()) if len(x) >= 40 else x[:0]
    sizes, found = [], []
    for s in scales:
        if 8 <= s <= len(y) // 4:
            f2 = np.concatenate((detrended(y, s), detrended(y[len(y) % s :], s)))
            f2 = f2[f2 > 0]
            if len(f2) >= 4:
                sizes.append(math.log(s))
                found.append([0.5 * np.log(f2).mean() if abs(q) < 1e-6 else math.log((f2 ** (q / 2)).mean()) / q for q in powers])
    if len(sizes) < 4:
        return [NAN] * len(powers)
    return [slope(np.array(sizes), np.array(h)) for h in zip(*found, strict=True)]


def multifractal_width(x: np.ndarray, power: float = 5.0, scales: tuple[int, ...] = (8, 10, 12, 16, 20, 24, 32)) -> float:
    low, high = fluctuation_exponents(x, (-power, power), scales)
    return low - high


def least_squares(columns: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residuals and the inverse of the normal matrix."""
    a = np.column_stack(columns)
    inv = np.linalg.inv(a.T @ a)
    beta = inv @ (a.T @ y)
    return beta, y - a @ beta, inv


def augmented_df(x: np.ndarray, most: int = 8, trend: str = "c") -> tuple[float, float]:
    """t of the lagged level in the augmented Dickey-Fuller regression, and the number of lagged differences with the least information criterion."""
    x = finite(x)
    dx, best = np.diff(x), (math.inf, NAN, 0)
    if len(x) < most + 20:
        return NAN, 0.0
    for p in range(most + 1):
        n = len(dx) - p
        if n < 15:
            break
        cols = [x[p : p + n], *[dx[p - i : p - i + n] for i in range(1, p + 1)]]
        cols += [np.ones(n)] if trend in ("c", "ct") else []
        cols += [np.arange(n, dtype=float)] if trend == "ct" else []
        try:
            beta, e, inv = least_squares(cols, dx[p:])
        except np.linalg.LinAlgError:
            continue
        free = n - len(cols)
        if free > 1 and inv[0, 0] > 0 and (rss := float(e @ e)) > 0:
            best = min(best, (n * math.log(rss / n) + 2 * len(cols), float(beta[0] / math.sqrt(rss / free * inv[0, 0])), p))
    return best[1], float(best[2])


def frac_weights(d: float, tau: float) -> np.ndarray:
    """Weights of fractional differencing, newest first, until they fall below tau."""
    w = [1.0]
    while abs(nxt := -w[-1] * (d - len(w) + 1) / len(w)) >= tau:
        w.append(nxt)
    return np.array(w)


def least_d(level: np.ndarray, grid: tuple[float, ...], tau: float = 1e-3, critical: float = -2.86) -> float:
    """The smallest order of differencing on the grid whose series has a Dickey-Fuller t below critical."""
    for d in grid:
        w = frac_weights(d, tau)
        if len(level) - len(w) + 1 >= 50:
            t, _ = augmented_df(np.convolve(level, w, "valid"))
            if t < critical:
                return d
    return NAN


# ---- entropy, recurrence, tails


def permutation_entropy(x: np.ndarray, m: int = 3, tau: int = 1) -> float:
    """Entropy of order patterns of m values, tau apart, in units of its largest value; equal values keep their order."""
    n = len(x) - (m - 1) * tau
    if n < 2:
        return NAN
    order = np.argsort(np.stack([x[j * tau : j * tau + n] for j in range(m)], 1), axis=1, kind="stable")
    _, c = np.unique(order @ (m ** np.arange(m)), return_counts=True)
    p = c / n
    return float(-(p * np.log(p)).sum() / math.log(math.factorial(m)))


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """-ln of the share of pairs of m values that stay within r deviations for one value more."""
    if len(x) < m + 2:
        return NAN
    if (tol := r * x.std()) == 0:
        return 0.0
    near = np.abs(x[:, None] - x) < tol

    def pairs(k: int) -> int:
        n = len(x) - k + 1
        both = np.logical_and.reduce([near[j : j + n, j : j + n] for j in range(k)])
        return (int(both.sum()) - n) // 2

    b, a = pairs(m), pairs(m + 1)
    return -math.log(a / b) if a and b else NAN


def embedded(x: np.ndarray, m: int, tau: int) -> np.ndarray:
    """Rows of m values, tau apart."""
    n = len(x) - (m - 1) * tau
    return np.stack([x[j * tau : j * tau + n] for j in range(m)], 1) if n > 1 else np.empty((0, m))


def distances(points: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None] - points) ** 2).sum(2))


def run_lengths(bits: np.ndarray) -> np.ndarray:
    """Lengths of the runs of ones in each row, rows apart."""
    edge = np.diff(np.pad(bits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    return np.argwhere(edge == -1)[:, 1] - np.argwhere(edge == 1)[:, 1]


def recurrence(x: np.ndarray, m: int = 3, tau: int = 1, rate: float = 0.1) -> tuple[float, float, float, float]:
    """(rate, determinism, laminarity, trapping time) of the recurrence matrix whose threshold is the `rate` quantile of distances; lines have two points at least."""
    points = embedded(np.asarray(x, float), m, tau)
    n = len(points)
    if n < 3:
        return NAN, NAN, NAN, NAN
    d = distances(points)
    near = d <= np.quantile(d[np.triu_indices(n, 1)], rate)
    np.fill_diagonal(near, False)
    total = int(near.sum())
    if not total:
        return 0.0, 0.0, 0.0, 0.0
    # diagonal k of the matrix as a row: the upper half shifted left by its row number
    skewed = np.zeros((n, n), bool)
    for k in range(1, n):
        skewed[k, : n - k] = np.diagonal(near, k)
    along, upright = run_lengths(skewed), run_lengths(near.T)
    long_ = upright[upright >= 2]
    return total / (n * (n - 1)), 2 * int(along[along >= 2].sum()) / total, int(long_.sum()) / total, float(long_.mean()) if len(long_) else 0.0


def hill(losses: np.ndarray, k: int) -> float:
    """Tail index of the k largest positive losses; five, and two more losses than k, at least."""
    x = np.sort(losses[losses > 0])[::-1]
    if k < 5 or len(x) < k + 2:
        return NAN
    xi = float(np.log(x[:k] / x[k]).mean())
    return 1 / xi if xi > 1e-9 else NAN


def pareto_shape(losses: np.ndarray, share: float = 0.9) -> float:
    """Shape of a generalised Pareto tail above the quantile `share`, by probability-weighted moments; 30 losses and ten beyond it at least."""
    x = losses[losses > 0]
    if len(x) < 30:
        return NAN
    over = np.sort(x[x > (u := np.quantile(x, share))] - u)
    n = len(over)
    if n < 10:
        return NAN
    first = over.mean()
    second = ((1 - (np.arange(1, n + 1) - 0.35) / n) * over).mean()
    gap = first - 2 * second
    return float(2 - first / gap) if abs(gap) >= 1e-12 else NAN


# ---- paths and shapes


def signature(steps: np.ndarray, level: int) -> np.ndarray:
    """The signature, levels 1 to 3, of a path given by its steps (rows); iterated sums, one pass."""
    d = steps.shape[1]
    before = np.cumsum(steps, 0) - steps
    out = [steps.sum(0)]
    if level >= 2:
        # level-two signature before each step, and what the step itself adds
        step2 = before[:, :, None] * steps[:, None, :] + steps[:, :, None] * steps[:, None, :] / 2
        out.append(step2.sum(0).ravel())
    if level >= 3:
        area = np.cumsum(step2, 0) - step2
        pair = steps[:, :, None] * steps[:, None, :]
        third = area[:, :, :, None] * steps[
            :, None, None, :
        ] + before[:, :, None, None] * pair[:, None] / 2 + steps[:, :, None, None] * pair[:, None] / 6
        out.append(third.sum(0).ravel())
    return np.concatenate(out) if d else np.zeros(0)


def signature_product(steps: np.ndarray, level: int) -> np.ndarray:
    """The same by products of tensor exponentials, term by term: slow, for tests."""
    d = steps.shape[1]
    now = [np.ones(()), *[np.zeros((d,) * k) for k in range(1, level + 1)]]
    for s in steps:
        power = [np.ones(())]
        for k in range(1, level + 1):
            power.append(np.multiply.outer(power[-1], s) / k)
        now = [sum(np.multiply.outer(now[i], power[k - i]) for i in range(k + 1)) for k in range(level + 1)]
    return np.concatenate([x.ravel() for x in now[1:]])


def path_channels(*series: np.ndarray) -> np.ndarray:
    """Steps of the path of time from 0 to 1 and of each series' running sum in its own deviations."""
    n = len(series[0])
    return np.stack([np.full(n, 1 / max(1, n - 1)), *[s / s.std() if s.std() > 0 else s * 0 for s in series]], 1)


def merge_lengths(points: np.ndarray) -> np.ndarray:
    """Edges of the least spanning tree, ascending: the deaths of connected components as balls around the points grow."""
    n = len(points)
    if n < 2:
        return np.zeros(0)
    d, near, out = distances(points), None, []
    rest = np.arange(1, n)
    near = d[0, 1:]
    while len(rest):
        k = int(near.argmin())
        out.append(near[k])
        near = np.minimum(np.delete(near, k), d[rest[k], np.delete(rest, k)])
        rest = np.delete(rest, k)
    return np.sort(np.array(out))


def shape_features(points: np.ndarray, grid: int = 256) -> tuple[float, float, float, float, float, float, float]:
    """Of the merge lengths: sum, root of squares, largest, the two norms of the landscape, largest less median, and the mean distance of nearest neighbours."""
    deaths = merge_lengths(points)
    if len(deaths) < 2:
        return (NAN,) * 7
    at = np.linspace(0.0, deaths[-1], grid)
    tents = np.maximum(np.minimum(at, deaths[:, None] - at), 0)
    d = distances(points)
    np.fill_diagonal(d, np.inf)
    l1, l2 = float(np.trapezoid(tents.sum(0), at)), math.sqrt(float(np.trapezoid((tents**2).sum(0), at)))
    return float(deaths.sum()), math.sqrt(float(deaths @ deaths)), float(deaths[-1]), l1, l2, float(
        deaths[-1] - np.median(deaths)
    ), float(d.min(1).mean())


def standardized(x: np.ndarray) -> np.ndarray:
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)


# ---- events


def excitation(times: np.ndarray, beta: float) -> np.ndarray:
    """For each event the decayed sum over those before it, in one pass."""
    out = np.zeros(len(times))
    for k, fade in enumerate(np.exp(-beta * np.diff(times)), 1):
        out[k] = fade * (out[k - 1] + 1)
    return out


def hawkes_loss(logs: np.ndarray, times: np.ndarray, end: float) -> float:
    """Negative log-likelihood of a self-exciting process with an exponential kernel on [0, end]; logs of base rate, jump and decay."""
    mu, alpha, beta = np.exp(np.clip(logs, -30, 30))
    rate = mu + alpha * excitation(times, beta)
    loss = mu * end + alpha / beta * float((1 - np.exp(-beta * (end - times))).sum()) - float(np.log(rate).sum())
    return loss if math.isfinite(loss) else 1e12


def hawkes_moments(times: np.ndarray, end: float) -> tuple[float, float, float]:
    """Base rate, jump and decay from the rate of events, the spread of their counts and their mean distance."""
    gap = float(np.diff(times).mean())
    counts, _ = np.histogram(times, bins=math.ceil(end / max(1.0, 4 * gap)), range=(0, end))
    fano = counts.var() / counts.mean() if counts.mean() > 0 else 1.0
    n = min(0.9, max(0.0, 1 - 1 / max(fano, 1.0)))
    beta = 1 / max(gap, 1e-6)
    return max(len(times) / end * (1 - n), 1e-6), max(n * beta, 1e-6), max(beta, 1e-6)


def downhill(loss, x: np.ndarray, size: float = 0.5, rounds: int = 200, tol: float = 1e-7) -> np.ndarray:
    """Simplex descent for a handful of unknowns."""
    pts = [x, *[x + size * np.eye(len(x))[k] for k in range(len(x))]]
    val = [loss(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val)
        pts, val = [pts[k] for k in order], [val[k] for k in order]
        if val[-1] - val[0] < tol:
            break
        mid = np.mean(pts[:-1], 0)
        for step in (1.0, 2.0, 0.5, -0.5):
            p = mid + step * (mid - pts[-1])
            v = loss(p)
            if step == 1.0:
                one = (p, v)
                if not v < val[0]:
                    continue
            elif step == 2.0:
                if not one[1] < val[0]:
                    if one[1] < val[-2]:
                        pts[-1], val[-1] = one
                        break
                    continue
                pts[-1], val[-1] = min((one, (p, v)), key=lambda t: t[1])
                break
            elif v < min(val[-1], one[1]):
                pts[-1], val[-1] = p, v
                break
        else:
            pts = [pts[0], *[(p + pts[0]) / 2 for p in pts[1:]]]
            val = [val[0], *[loss(p) for p in pts[1:]]]
    return pts[int(np.argmin(val))]


def hawkes(times: np.ndarray, end: float) -> tuple[float, float, float]:
    """(branching ratio, rate at the end over base rate, base rate) by likelihood, by moments where that is not stationary; six events at least."""
    if len(times) < 6 or end <= 0:
        return NAN, NAN, NAN
    start = hawkes_moments(times, end)
    mu, alpha, beta = np.exp(downhill(lambda p: hawkes_loss(p, times, end), np.log(start)))
    if not 0 < alpha / beta < 1:
        mu, alpha, beta = start
    now = mu + alpha * float(np.exp(-beta * (end - times)).sum())
    return float(min(alpha / beta, 0.999)), float(now / mu), float(mu)


# ---- many series at once


def cleaned_factors(returns: np.ndarray) -> np.ndarray:
    """Eigenvectors (columns) of the correlations whose eigenvalue exceeds (1 + sqrt(N / W))^2; one at least, all but one at most."""
    rows, n = returns.shape
    values, vectors = np.linalg.eigh(standardized(returns).T @ standardized(returns) / rows)
    keep = int((values > (1 + math.sqrt(n / rows)) ** 2).sum())
    return vectors[:, ::-1][:, : max(1, min(keep, n - 1))]


def reversion_score(resid: np.ndarray, per_year: float = 252) -> tuple[float, float, float]:
    """(score, speed a year, half-life) of the running sum of residuals as an autoregression with coefficient between 0 and 1; 20 values at least."""
    x = np.cumsum(resid)
    if len(x) < 20 or x[:-1].std() == 0:
        return NAN, NAN, NAN
    (a, b), e, _ = least_squares([np.ones(len(x) - 1), x[:-1]], x[1:])
    if not 0 < b < 1 - 1e-9:
        return NAN, NAN, NAN
    spread = float(e @ e) / max(1, len(e) - 2) / (1 - b * b)
    if spread <= 0:
        return NAN, NAN, NAN
    return float((x[-1] - a / (1 - b)) / math.sqrt(spread)), float(-math.log(b) * per_year), float(math.log(2) / -math.log(b))


def residual_scores(returns: np.ndarray) -> tuple[list[tuple[float, float, float]], int]:
    """reversion_score of each column after the cleaned factors, and how many factors there are. Columns without variance have no weight."""
    sd = returns.std(0)
    weights = cleaned_factors(returns) / np.where(sd > 0, sd, np.inf)[:, None]
    factors = np.column_stack((np.ones(len(returns)), returns @ weights))
    rest = returns - factors @ (np.linalg.pinv(factors) @ returns)
    return [reversion_score(rest[:, i]) for i in range(returns.shape[1])], weights.shape[1]


def binned(x: np.ndarray, bins: int) -> np.ndarray:
    return np.digitize(x, np.quantile(x, np.arange(1, bins) / bins))


def transfer(x: np.ndarray, y: np.ndarray, lag: int, bins: int) -> float:
    """What x, `lag` steps back, tells about y beyond y one step back, in nats; x and y are binned."""
    if len(y) <= lag + 2:
        return 0.0
    c = np.bincount((y[lag:] * bins + y[lag - 1 : -1]) * bins + x[: len(x) - lag], minlength=bins**3).reshape(bins, bins, bins).astype(float)
    i, j, k = np.nonzero(c)
    n = c[i, j, k]
    gain = np.log(n * c.sum((0, 2))[j] / (c.sum(0)[j, k] * c.sum(2)[i, j]))
    return max(0.0, float((n * gain).sum() / c.sum()))


def transfer_score(x: np.ndarray, y: np.ndarray, lag: int, bins: int, shuffles: int, seed: int) -> tuple[float, float]:
    """transfer, and its distance from that of circular shifts of x, in their deviations."""
    seen, rng = transfer(x, y, lag, bins), np.random.default_rng(seed)
    if len(x) < 30:
        return seen, 0.0
    null = np.array([transfer(np.roll(x, int(rng.integers(lag + 4, len(x) - lag - 4))), y, lag, bins) for _ in range(shuffles)])
    return seen, float((seen - null.mean()) / null.std()) if null.std() > 0 else 0.0


# ---- fits


def ridge(x: np.ndarray, y: np.ndarray, penalty: float, intercept: bool = True) -> np.ndarray:
    """Coefficients, then the intercept if there is one, which is not penalised."""
    mx, my = (x.mean(0), y.mean()) if intercept else (np.zeros(x.shape[1]), 0.0)
    a = x - mx
    w = np.linalg.solve(a.T @ a + penalty * np.eye(x.shape[1]), a.T @ (y - my))
    return np.append(w, my - mx @ w) if intercept else w


def logistic(x: np.ndarray, y: np.ndarray, strength: float, rounds: int = 50) -> np.ndarray:
    """Coefficients and intercept of a logistic regression with squared penalty 1 / (2 strength), by Newton steps."""
    a = np.column_stack((x, np.ones(len(x))))
    w, hold = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], 1 / strength), 1e-12)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(hold), a.T @ (p - y) + hold * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def greedy_apart(corr: np.ndarray, most: int, limit: float) -> list[int]:
    """Indices in order, each less than limit correlated with those before it, `most` at most."""
    out: list[int] = []
    for i in range(len(corr)):
        if len(out) < most and all(abs(corr[i, j]) < limit for j in out):
            out.append(i)
    return out


def walk_forward(x: np.ndarray, y: np.ndarray, window: int, every: int, penalty: float) -> np.ndarray:
    """Predictions for each row from a ridge fitted on the `window` rows before its block of `every` rows; NaN for the first window."""
    out = np.full(len(y), np.nan)
    for a in range(window, len(y), every):
        w = ridge(x[a - window : a], y[a - window : a], penalty)
        block = x[a : a + every]
        out[a : a + every] = block @ w[:-1] + w[-1]
    return out


def grid_product(**axes: tuple) -> list[dict]:
    """All combinations of the values of the axes, the last axis fastest."""
    return [dict(zip(axes, v, strict=True)) for v in itertools.product(*axes.values())]
