"""Geometric agreement of matched points, and clusters of points."""

from __future__ import annotations

import heapq

import numpy as np

#: Points that fix a plane transform of each kind.
MODELS = {"affine": 3, "homography": 4}


def fit_transform(p: np.ndarray, q: np.ndarray, model: str = "homography") -> np.ndarray | None:
    """The 3 x 3 transform from p to q in least squares; None where the points do not fix one."""
    one = np.ones((len(p), 1))
    if model == "affine":
        a = np.hstack((p, one))
        if np.linalg.matrix_rank(a) < 3:
            return None
        return np.vstack((np.linalg.lstsq(a, q, rcond=None)[0].T, [0, 0, 1]))

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = x.mean(axis=0)
        s = np.sqrt(2) / (np.sqrt(((x - c) ** 2).sum(axis=1)).mean() + 1e-12)
        return (x - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    (a, ta), (b, tb) = centred(p), centred(q)
    zero = np.zeros((len(a), 3))
    h = np.hstack((a, one))
    rows = np.vstack((np.hstack((h, zero, -b[:, :1] * h)), np.hstack((zero, h, -b[:, 1:] * h))))
    _, s, vt = np.linalg.svd(rows)
    if len(s) < 8 or s[7] < 1e-9:
        return None
    m = np.linalg.inv(tb) @ vt[8].reshape(3, 3) @ ta
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else None


def moved(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    h = np.hstack((p, np.ones((len(p), 1)))) @ m.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return h[:, :2] / h[:, 2:]


def agreeing(p: np.ndarray, q: np.ndarray, model: str = "homography", within: float = 3.0, least: int = 4, trials: int = 1000, seed: int = 0) -> np.ndarray:
    """Indices of the pairs that one plane transform explains; empty for fewer than ``least``.

    Seeded random samples; as many trials as make a missed sample of agreeing
    pairs a one in a thousand chance, at most ``trials``; the best model is fitted
    again to its pairs until they no longer change.
    """
    k, n = MODELS[model], len(p)
    if n < max(k, least):
        return np.zeros(0, int)
    rng, best, needed, done = np.random.default_rng(seed), np.zeros(n, bool), trials, 0
    error = lambda m: np.sqrt(((moved(p, m) - q) ** 2).sum(axis=1))
    while done < needed:
        done += 1
        at = rng.choice(n, k, replace=False)
        m = fit_transform(p[at], q[at], model)
        if m is None:
            continue
        ok = error(m) <= within
        if ok.sum() > best.sum():
            best = ok
            share = (ok.sum() / n) ** k
            needed = min(trials, int(np.ceil(np.log(1e-3) / np.log(1 - share)))) if share < 1 else done
    for _ in range(10):
        m = fit_transform(p[best], q[best], model) if best.sum() >= k else None
        ok = best if m is None else error(m) <= within
        if ok.sum() < best.sum() or (ok == best).all():
            break
        best = ok
    return np.flatnonzero(best) if best.sum() >= least else np.zeros(0, int)


def cluster_points(points: np.ndarray, height: int, width: int, neighbours: float = 0.1, share: float = 0.003) -> list[list[int]]:
    """Clusters of points by Ward's criterion among near neighbours, up to a distance that is a share of the image's area.

    Only clusters with points among each other's nearest ``neighbours`` (a share of
    all) merge; parts that are not linked are linked at their nearest points.
    Clusters are listed by their first point.
    """
    n = len(points)
    if n < 2:
        return [[i] for i in range(n)]
    limit, k = height * width * share, round(n * neighbours)
    x = np.asarray(points, float)
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    if k:
        near = np.zeros((n, n), bool)
        order = np.argsort(d2 + np.diag(np.full(n, np.inf)), axis=1, kind="stable")[:, :k]
        near[np.arange(n)[:, None], order] = True
        near |= near.T
        part = np.arange(n)
        while True:  # the smallest number in each linked part
            low = np.where(near, part[None], n).min(axis=1)
            new = np.minimum(part, low)
            if (new == part).all():
                break
            part = new
        kinds = np.unique(part)
        for i, a in enumerate(kinds):
            for b in kinds[i + 1:]:
                ia, ib = np.flatnonzero(part == a), np.flatnonzero(part == b)
                u, v = np.unravel_index(d2[np.ix_(ia, ib)].argmin(), (len(ia), len(ib)))
                near[ia[u], ib[v]] = near[ib[v], ia[u]] = True
    else:
        near = ~np.eye(n, dtype=bool)
    size, centre, members, alive = [1] * n, list(x), [[i] for i in range(n)], set(range(n))
    links = [set(np.flatnonzero(r).tolist()) - {i} for i, r in enumerate(near)]
    cost = lambda i, j: float(np.sqrt(2 * size[i] * size[j] / (size[i] + size[j]) * ((centre[i] - centre[j]) ** 2).sum()))
    heap = [(cost(i, j), i, j) for i in range(n) for j in links[i] if i < j]
    heapq.heapify(heap)
    while heap:
        c, i, j = heapq.heappop(heap)
        if c >= limit:
            break
        if i not in alive or j not in alive:
            continue
        new = len(size)
        size.append(size[i] + size[j])
        centre.append((size[i] * centre[i] + size[j] * centre[j]) / size[new])
        members.append(members[i] + members[j])
        links.append((links[i] | links[j]) - {i, j})
        alive -= {i, j}
        alive.add(new)
        for o in list(links[new]):
            if o in alive:
                links[o] = (links[o] - {i, j}) | {new}
                heapq.heappush(heap, (cost(new, o), new, o))
            else:
                links[new].discard(o)
    return sorted(sorted(members[i]) for i in alive)
