"""NumPy routines behind the fitted estimators, from textbook formulas."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np


def generator(*parts) -> np.random.Generator:
    """A random generator fixed by its parts, for reruns that agree."""
    return np.random.default_rng(int.from_bytes(hashlib.md5(":".join(map(str, parts)).encode()).digest()[:8], "little"))


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 800, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    n = len(start)
    pts = np.vstack([start, start + np.diag(np.where(start != 0, 0.1 * start, 0.1))])
    val = np.array([f(p) for p in pts])
    for _ in range(rounds):
        order = np.argsort(val, kind="stable")
        pts, val = pts[order], val[order]
        if val[-1] - val[0] < tol and np.isfinite(val[-1]):
            break
        mid = pts[:-1].mean(0)
        up = mid + (mid - pts[-1])
        fu = f(up)
        if fu < val[0]:
            far = mid + 2 * (mid - pts[-1])
            ff = f(far)
            pts[-1], val[-1] = (far, ff) if ff < fu else (up, fu)
        elif fu < val[-2]:
            pts[-1], val[-1] = up, fu
        else:
            near = mid + 0.5 * ((up if fu < val[-1] else pts[-1]) - mid)
            fn = f(near)
            if fn < min(fu, val[-1]):
                pts[-1], val[-1] = near, fn
            else:
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                val[1:] = [f(p) for p in pts[1:]]
    k = int(val.argmin())
    return pts[k], float(val[k])


# exponentiated and plain Weibull


def exponweib_nll(x: np.ndarray, a: float, c: float, loc: float, scale: float) -> float:
    if min(a, c, scale) <= 0 or (x <= loc).any():
        return math.inf
    z = (x - loc) / scale
    with np.errstate(all="ignore"):
        p = z**c
        v = math.log(a) + math.log(c) - math.log(scale) + (a - 1) * np.log(-np.expm1(-p)) - p + (c - 1) * np.log(z)
    s = -float(v.sum())
    return s if math.isfinite(s) else math.inf


def exponweib_fit(x: np.ndarray) -> tuple[float, float, float, float, float]:
    """(a, c, loc, scale, nll) from two starts; the better one."""
    best = (np.array([1.0, 1.0, 0.0, 1.0]), math.inf)
    for start in ([1.0, 1.0, 0.0, 1.0], [1.0, 1.5, min(0.0, float(x.min()) - 1e-3), max(float(x.mean()), 1e-6)]):
        got = nelder_mead(lambda p: exponweib_nll(x, *p), np.array(start))
        if got[1] < best[1]:
            best = got
    return (*map(float, best[0]), best[1])


def exponweib_quantile(q: float, a: float, c: float, loc: float, scale: float) -> float:
    return loc + scale * (-math.log(1 - q ** (1 / a))) ** (1 / c)


def weibull_fit(x: np.ndarray) -> tuple[float, float, float, float]:
    """(k, l, divisor, nll) of the two-parameter Weibull of x over its least value."""
    low = float(x.min())
    z = x / low
    logs = np.log(z)

    def g(k: float) -> float:
        w = np.exp(k * (logs - logs.max()))
        return float((w * logs).sum() / w.sum() - 1 / k - logs.mean())

    a, b = 1e-3, 1.0
    while g(b) < 0 and b < 1e4:
        b *= 2
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if g(m) < 0 else (a, m)
    k = (a + b) / 2
    lam = float(np.exp(logs.max()) * np.mean(np.exp(k * (logs - logs.max()))) ** (1 / k))
    nll = -float((math.log(k / lam) + (k - 1) * np.log(z / lam) - (z / lam) ** k).sum())
    return k, lam, low, nll


# low-pass filters


def butter(order: int, wn: float | np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital Butterworth low-pass, or of one for each value of wn."""
    w = np.tan(np.pi * np.asarray(wn, float) / 2)
    one, zero = np.ones_like(w), np.zeros_like(w)
    out = []
    for k in range(order // 2):
        q = 2 * math.sin(math.pi * (2 * k + 1) / (2 * order))
        d = 1 + q * w + w * w
        out.append((np.stack([w * w, 2 * w * w, w * w]) / d, np.stack([one, 2 * (w * w - 1) / d, (1 - q * w + w * w) / d])))
    if order % 2:
        out.append((np.stack([w, w, zero]) / (1 + w), np.stack([one, (w - 1) / (1 + w), zero])))
    return out


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One section, started in the steady state of its first value; filters side by side in the last axis."""
    gain = b.sum(0) / a.sum(0)
    y0 = gain * x[0]
    z2 = b[2] * x[0] - a[2] * y0
    z1 = b[1] * x[0] - a[1] * y0 + z2
    b0, b1, b2 = b
    _, a1, a2 = a
    out = np.empty((len(x), *np.shape(gain)))
    for i, v in enumerate(x):
        y = b0 * v + z1
        z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
        out[i] = y
    return out


def filtfilt(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Forward and backward, over an odd extension of both ends."""
    n = min(len(x) - 1, 3 * (2 * len(sections) + 1))
    ext = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]) if n > 0 else x
    for _ in range(2):
        for b, a in sections:
            ext = _section(b, a, ext)
        ext = ext[::-1]
    return ext[n : len(ext) - n] if n > 0 else ext


def fft_resample(x: np.ndarray, n: int) -> np.ndarray:
    m = len(x)
    if n == m:
        return x.astype(float)
    f, out = np.fft.rfft(x), np.zeros(n // 2 + 1, complex)
    k = min(m, n) // 2 + 1
    out[:k] = f[:k]
    if min(m, n) % 2 == 0:  # the middle frequency is shared by two halves
        out[k - 1] *= 2.0 if n < m else 0.5
        if n < m:
            out[k - 1] = out[k - 1].real
    return np.fft.irfft(out, n) * n / m


# isolation trees; axis-parallel splits are the extension level 0


def c_factor(n: int) -> float:
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 1 else 0.0


def isolation_tree(x: np.ndarray, limit: int, level: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, left, right, normal, point, size, depth); leaves have no children."""
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        k = len(nodes)
        nodes.append(())
        if depth >= limit or len(rows) <= 1:
            nodes[k] = (k, None, None, None, None, len(rows), depth)
            return k
        d = rows.shape[1]
        normal = rng.normal(size=d)
        normal[rng.choice(d, d - level - 1, replace=False)] = 0.0
        point = rng.uniform(rows.min(0), rows.max(0))
        left = (rows - point) @ normal < 0
        a, b = grow(rows[left], depth + 1), grow(rows[~left], depth + 1)
        nodes[k] = (k, a, b, normal.tolist(), point.tolist(), len(rows), depth)
        return k

    grow(x, 0)
    return nodes


def path_lengths(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    out, work = np.zeros(len(x)), [(0, np.arange(len(x)))]
    while work:
        k, rows = work.pop()
        _, a, b, normal, point, size, depth = nodes[k]
        if a is None:
            out[rows] = depth + c_factor(size)
        elif len(rows):
            left = (x[rows] - point) @ np.asarray(normal) < 0
            work += [(a, rows[left]), (b, rows[~left])]
    return out


# kernel machines


def kernel(x: np.ndarray, y: np.ndarray, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> np.ndarray:
    if kind == "linear":
        return x @ y.T
    if kind == "poly":
        return (gamma * (x @ y.T) + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * (x @ y.T) + coef0)
    if kind == "rbf":
        return np.exp(-gamma * np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))
    raise ValueError(f"unknown kernel: {kind}")


def kernel_times(x: np.ndarray, y: np.ndarray, w: np.ndarray, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> np.ndarray:
    """kernel(x, y) @ w, of which a part of 256 rows and 1024 columns is there at a time."""
    out, px, kern = np.zeros(len(x)), 1.0, lambda a, b: kernel(a, b, kind, gamma, degree, coef0)
    if kind == "rbf" and gamma * max(((v * v).sum(1).max(initial=0) for v in (x, y))) < 100:  # exp(-g|x|^2) exp(2g xy) exp(-g|y|^2), in range
        px, w, y = np.exp(-gamma * (x * x).sum(1)), np.exp(-gamma * (y * y).sum(1)) * w, 2 * gamma * y

        def kern(a, b):
            k = a @ b.T
            return np.exp(k, out=k)

    for i in range(0, len(x), 256):
        for j in range(0, len(y), 1024):
            out[i : i + 256] += kern(x[i : i + 256], y[j : j + 1024]) @ w[j : j + 1024]
    return px * out


def smo(q: np.ndarray, p: np.ndarray, y: np.ndarray, cap: np.ndarray, start: np.ndarray, tol: float = 1e-4, rounds: int = 20_000) -> tuple[np.ndarray, float]:
    """Minimises a'Qa / 2 + p'a with y'a kept and 0 <= a <= cap, by most violating pairs; (a, rho)."""
    a = start.astype(float)
    g = q @ a + p
    for _ in range(rounds):
        up = ((y > 0) & (a < cap - 1e-12)) | ((y < 0) & (a > 1e-12))
        low = ((y < 0) & (a < cap - 1e-12)) | ((y > 0) & (a > 1e-12))
        v = -y * g
        if not up.any() or not low.any():
            break
        i = int(np.flatnonzero(up)[v[up].argmax()])
        j = int(np.flatnonzero(low)[v[low].argmin()])
        if v[i] - v[j] < tol:
            break
        curve = max(q[i, i] + q[j, j] - 2 * y[i] * y[j] * q[i, j], 1e-12)
        step = (v[i] - v[j]) / curve
        step = min(step, cap[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else cap[j] - a[j])
        di, dj = y[i] * step, -y[j] * step
        a[i], a[j] = a[i] + di, a[j] + dj
        g += q[:, i] * di + q[:, j] * dj
    free = (a > 1e-9) & (a < cap - 1e-9)
    v = -y * g
    if free.any():
        rho = float(v[free].mean())
    else:
        hi, lo = v[((y > 0) & (a <= 1e-9)) | ((y < 0) & (a > 1e-9))], v[((y < 0) & (a <= 1e-9)) | ((y > 0) & (a > 1e-9))]
        rho = float(((hi.max() if len(hi) else 0) + (lo.min() if len(lo) else 0)) / 2)
    return a, rho


def svc(k: np.ndarray, y: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, float]:
    """(signed weights, offset) of a soft-margin classifier: decision k @ w + b."""
    a, rho = smo(k * np.outer(y, y), -np.ones(len(y)), y, cap, np.zeros(len(y)))
    return a * y, rho


def one_class(k: np.ndarray, nu: float) -> tuple[np.ndarray, float]:
    """(weights, rho) of a one-class machine: decision k @ a - rho."""
    n = len(k)
    full = nu * n
    start = np.zeros(n)
    start[: int(full)] = 1.0
    if int(full) < n:
        start[int(full)] = full - int(full)
    a, rho = smo(k, np.zeros(n), np.ones(n), np.ones(n), start, tol=1e-6)
    return a, -rho


def top_eigenvalue(times: Callable[[np.ndarray], np.ndarray], n: int, rounds: int = 100) -> float:
    """The largest eigenvalue of a symmetric matrix without negative ones, from its products, and a thousandth more."""
    v, was = generator("eigenvalue", n).random(n) + 0.5, 0.0
    for _ in range(rounds):
        v = v / np.sqrt(v @ v)
        u = times(v)
        now = float(np.sqrt(u @ u))
        if now <= was * (1 + 1e-5) or not now:
            break
        v, was = u, now
    return now * 1.001


def moments(x: np.ndarray, gamma: float) -> tuple[Callable[[np.ndarray], np.ndarray], float]:
    """About the product of the rbf kernel of x, from moments up to the second of its rows, and how far an entry is off at most.

    exp(2g xy) is its series up to the square; what is left out has no negative eigenvalue.
    """
    parts = [slice(i, i + 2048) for i in range(0, len(x), 2048)]
    px, t = np.exp(-gamma * (x * x).sum(1)), 2 * gamma * (x * x).sum(1).max(initial=0)

    def times(z: np.ndarray) -> np.ndarray:
        u, out, second = px * z, np.empty(len(x)), np.zeros((x.shape[1], x.shape[1]))
        for p in parts:
            second += x[p].T @ (x[p] * u[p, None])
        first, all_ = 2 * gamma * (u @ x), u.sum()
        for p in parts:
            out[p] = px[p] * (all_ + x[p] @ first + 2 * gamma**2 * np.einsum("ij,ij->i", x[p] @ second, x[p]))
        return out

    return times, float((px * px).max(initial=0) * (math.exp(min(t, 700)) - 1 - t - t * t / 2))


def ssad_fit(k: np.ndarray | Callable[[np.ndarray], np.ndarray], y: np.ndarray, kappa: float = 1.0, cp: float = 1.0, cu: float = 1.0, cn: float = 1.0, rounds: int = 4000, near: tuple[Callable[[np.ndarray], np.ndarray], float] | None = None, tol: float = 1e-6) -> tuple[np.ndarray, float, np.ndarray]:
    """(signed weights w, rho, K w) of the convex semi-supervised problem, by projected gradients.

    Least a'(K . yy')a / 2 with 0 <= a <= C, sum(y a) = 1, sum of labelled a >= kappa.
    k: the matrix, or a function that multiplies by it. near: a cheap product near
    it and by how much an entry is off; steps are then found with it, and checked
    and cut to length with k. Ends when the duality gap is at most tol of the
    objective, as the solver of the definition does, or after so many rounds.
    """
    cy, cl = np.where(y >= 0, 1.0, -1.0), np.abs(y)
    cap = np.where(y > 0, cp, np.where(y < 0, cn, cu)).astype(float)
    kappa = kappa if cl.any() else 0.0
    times = k if callable(k) else lambda z: k @ z
    at = [0.0, 0.0]  # the multipliers of the last projection

    def newton(v: np.ndarray, lam: float, mu: float, both: bool) -> np.ndarray | None:
        for _ in range(40):
            z = v + lam * cy + mu * cl
            a = np.clip(z, 0, cap)
            r, q = cy @ a - 1, cl @ a - kappa
            if abs(r) < 1e-11 and (not both or abs(q) < 1e-11):
                at[:] = lam, mu
                return a
            free = ((z > 0) & (z < cap)).astype(float)
            n, m, c = free.sum(), free @ cl, free @ (cl * cy)
            det = n * m - c * c if both else n
            if not det:
                return None
            lam, mu = (lam - (m * r - c * q) / det, mu - (n * q - c * r) / det) if both else (lam - r / n, mu)
        return None

    def bisected(v: np.ndarray) -> np.ndarray:
        """The same by bisection of both multipliers."""

        def inner(mu: float) -> np.ndarray:
            hi = abs(v).max() + mu + cap.max() + 1.0
            lo = -hi
            for _ in range(60):
                lam = (lo + hi) / 2
                a = np.clip(v + lam * cy + mu * cl, 0, cap)
                lo, hi = (lam, hi) if cy @ a < 1 else (lo, lam)
            at[:] = lam, mu
            return a

        a = inner(0.0)
        if cl @ a >= kappa - 1e-9:
            return a
        lo, hi = 0.0, 2 * (abs(v).max() + cap.max() + 1.0)
        for _ in range(50):
            mu = (lo + hi) / 2
            lo, hi = (mu, hi) if cl @ inner(mu) < kappa else (lo, mu)
        return inner(hi)

    def project(v: np.ndarray) -> np.ndarray:
        """Nearest feasible point: two multipliers, the one of kappa only if it binds."""
        a = newton(v, at[0], 0.0, False)
        if a is not None and cl @ a < kappa - 1e-9:
            a = newton(v, *at, True)
            a = a if at[1] >= 0 else None
        return bisected(v) if a is None else a

    def gap(a: np.ndarray, g: np.ndarray, rate: float) -> float:
        """How far a is above the best at most, by the dual value of the last projection's mu and of the best lambda for it."""
        best, side = -np.inf, cap * cy
        for mu in {0.0, max(0.0, at[1] / rate)}:
            h = g - mu * cl
            hi = abs(h).max() + 1e-300
            lo = -hi
            for _ in range(60):
                lam = (lo + hi) / 2
                lo, hi = (lo, lam) if side @ (h < lam * cy) > 1 else (lam, hi)
            best = max(best, lam + kappa * mu + cap @ np.minimum(0, h - lam * cy))
        return float(a @ g - best)

    def steps(slope: Callable[[np.ndarray], np.ndarray], a: np.ndarray, rate: float, near_enough: Callable[[np.ndarray, np.ndarray], bool], most: int) -> np.ndarray:
        """Accelerated projected gradients from a, begun anew where they overshoot."""
        last, t = a, 1.0
        for i in range(1, most + 1):
            t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
            z = a + (t - 1) / t2 * (a - last)
            new = project(z - rate * slope(z))
            last, a, t = a, new, 1.0 if (z - new) @ (new - a) > 0 else t2
            if i % 10 == 0 and near_enough(a, slope(a)):
                break
        return a

    def steepest(f: Callable[[np.ndarray], np.ndarray]) -> float:
        """The largest eigenvalue among changes that keep sum(y a), with some to spare."""
        off = lambda z: z - z.mean()
        return max(1.1 * top_eigenvalue(lambda z: off(f(off(z))), len(y)), 1e-9)

    enough = lambda a, g, rate: gap(a, g, rate) <= tol * max(a @ g / 2, 0.1)
    a = project(np.full(len(y), 1.0 / len(y)))
    if near is not None:
        cheap, off = near
        top, damp, s = steepest(cheap), 4 * off, times(a * cy)
        for _ in range(rounds):
            g, was = cy * s, cheap(a * cy)
            rate = 1 / (top + damp)
            if enough(a, g, rate):
                break
            b = steps(lambda z, a=a, g=g, was=was, damp=damp: g + cy * (cheap(z * cy) - was) + damp * (z - a), a, rate, lambda a, g, rate=rate: gap(a, g, rate) <= tol * 0.5, 1000)
            d = b - a
            kd = times(d * cy)
            down, bend = -(g @ d), d @ (cy * kd)
            if down <= 0 or bend <= 0:
                break
            t = min(1.0, down / bend)
            damp = max(damp, (bend - d @ (cy * cheap(d * cy))) / (d @ d))
            a, s = a + t * d, s + t * kd
    else:
        rate = 1 / steepest(times)
        a = steps(lambda z: cy * times(z * cy), a, rate, lambda a, g: enough(a, g, rate), rounds)
        s = times(a * cy)
    free = (a > 1e-6) & (a < cap - 1e-6)
    pick = free & (y == 0) if (free & (y == 0)).any() else free if free.any() else a > 1e-6
    return a * cy, float(s[pick].mean()) if pick.any() else 0.0, s


def ssad(k: np.ndarray | Callable[[np.ndarray], np.ndarray], y: np.ndarray, kappa: float = 1.0, cp: float = 1.0, cu: float = 1.0, cn: float = 1.0, rounds: int = 4000) -> tuple[np.ndarray, float]:
    """(signed weights, rho) of the same."""
    return ssad_fit(k, y, kappa, cp, cu, cn, rounds)[:2]


# clusters


def _sided(d: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Each point's nearest cluster that holds none of the other side yet, nearest points first; else the nearest.

    A choice changes only when a cluster gets its first point of a side, so all
    points up to the next such one choose at once.
    """
    new = d.argmin(1)
    order = np.argsort(d.min(1), kind="stable")
    order = order[sides[order] != 0]
    row = (sides[order] < 0).astype(int)
    held = np.zeros((2, d.shape[1]), bool)  # clusters with a point of side 1, of side -1
    at = 0
    while at < len(order):
        i, r = order[at:], row[at:]
        free = ~held[1 - r]
        pick = np.where(free.any(1), np.where(free, d[i], np.inf).argmin(1), d[i].argmin(1))
        first = np.flatnonzero(~held[r, pick])
        n = int(first[0]) + 1 if len(first) else len(i)
        new[i[:n]] = pick[:n]
        held[r[n - 1], pick[n - 1]] = True
        at += n
    return new


def kmeans(x: np.ndarray, k: int, seed: int = 0, apart: list[tuple[int, int]] | None = None, rounds: int = 100, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres); apart: pairs that may not share a cluster, dropped where they cannot hold.

    sides: 1, -1 or 0 (neither) for each point; instead of all pairs of a 1 and a -1.
    """
    rng, k = generator("kmeans", seed), min(k, len(x))
    centres = x[[int(rng.integers(len(x)))]]
    far = lambda c: ((x - c) ** 2).sum(1)
    least = far(centres[0])
    while len(centres) < k:
        centres = np.vstack([centres, x[int(least.argmax())]])
        least = np.minimum(least, far(centres[-1]))
    rivals: dict[int, list[int]] = {}
    for a, b in apart or []:
        rivals.setdefault(a, []).append(b)
        rivals.setdefault(b, []).append(a)
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        d = np.stack([far(c) for c in centres], 1)
        new = np.full(len(x), -1)
        for i in np.argsort(d.min(1), kind="stable") if rivals else []:
            taken = {new[j] for j in rivals.get(int(i), [])}
            new[i] = next((c for c in np.argsort(d[i], kind="stable") if c not in taken), d[i].argmin())
        if not rivals:
            new = d.argmin(1) if sides is None else _sided(d, sides)
        if (new == labels).all():
            break
        labels = new
        centres = np.array([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
    return labels, centres


def spectral(a: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Clusters of an affinity matrix by the symmetric normalised Laplacian."""
    k = min(k, len(a))
    d = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
    _, v = np.linalg.eigh(a * d[:, None] * d[None])
    u = v[:, -k:]
    return kmeans(u / np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-12), k, seed)[0]


def dtw(a: np.ndarray, b: np.ndarray, band: int | None = None) -> float:
    n, m = len(a), len(b)
    prev = np.full(m + 1, np.inf)
    prev[0] = 0.0
    for i in range(1, n + 1):
        now = np.full(m + 1, np.inf)
        lo, hi = (1, m) if band is None else (max(1, i - band), min(m, i + band))
        for j in range(lo, hi + 1):
            now[j] = (a[i - 1] - b[j - 1]) ** 2 + min(prev[j], prev[j - 1], now[j - 1])
        prev = now
    return math.sqrt(prev[m])
