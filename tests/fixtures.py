"""Seeded synthetic scans and brute-force models of the operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from skytrace.params import Grid


def square_grid(n: int, bound: float = 1.0, dims: int = 2) -> Grid:
    """n + 1 nodes per axis over [-bound, bound], in metres."""
    names = ("z", "y", "x")[-dims:]
    step = 2.0 * bound / n
    return Grid(names, (n + 1,) * dims, (step,) * dims, (-bound,) * dims, ("m",) * dims)


def points_frame(spark, grid: Grid, index: np.ndarray, values: np.ndarray, scan: int = 0):
    """Points at grid indices (one row per node) with one variable ``v``."""
    pdf = pd.DataFrame(index.astype(np.int32), columns=list(grid.dims))
    for d, o, r in zip(grid.dims, grid.origin, grid.resolution):
        pdf["c_" + d] = o + pdf[d] * r
    pdf["pid"] = sum(pdf[d].astype(np.int64) * s for d, s in zip(grid.dims, grid.strides))
    pdf["gid"] = scan * grid.cells + pdf["pid"]
    pdf["scan"] = np.int64(scan)
    pdf["v"] = values.astype(float)
    pdf["is_original"] = True
    return spark.createDataFrame(pdf)


def cloud_cells(grid: Grid, divisions: int, spread: float, draws: int, seed: int) -> pd.DataFrame:
    """Gaussian clouds around the inner intersections of the axis divisions: value 3 exp(-r^2 / (2 spread^2))."""
    rng = np.random.default_rng(seed)
    bound = -grid.origin[0]
    ticks = [-bound + i * 2 * bound / divisions for i in range(1, divisions)]
    centres = np.array(np.meshgrid(*[ticks] * len(grid.dims), indexing="ij")).reshape(len(grid.dims), -1).T
    cells: dict[tuple, float] = {}
    for c in centres:
        draw = rng.normal(c, spread, (draws, len(grid.dims)))
        idx = np.rint((draw - grid.origin[0]) / grid.resolution[0]).astype(int)
        inside = ((idx >= 0) & (idx < grid.sizes[0])).all(axis=1)
        for i in idx[inside]:
            r2 = float((((i * grid.resolution[0] + grid.origin[0]) - c) ** 2).sum())
            value = 3.0 * math.exp(-r2 / (2 * spread * spread))
            cells[tuple(i)] = max(cells.get(tuple(i), 0.0), value)
    out = pd.DataFrame([(*k, v) for k, v in cells.items()], columns=[*grid.dims, "v_raw"])
    out[list(grid.dims)] = out[list(grid.dims)].astype(np.int32)
    out["scan"], out["ts"] = np.int64(0), np.int64(0)
    return out


def greedy(pairs: list[tuple[int, int, float]]) -> set[tuple[int, int]]:
    """One-to-one assignment by falling score; ties by n, then m."""
    used_n, used_m, out = set(), set(), set()
    for n, m, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if n not in used_n and m not in used_m:
            used_n.add(n)
            used_m.add(m)
            out.add((n, m))
    return out


def components(edges: list[tuple[int, int]]) -> dict[int, int]:
    parent: dict[int, int] = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {a: find(a) for a in list(parent)}


def kendall(a, b) -> float:
    n, s, n1, n2 = len(a), 0, 0, 0
    for i in range(n):
        for j in range(i + 1, n):
            u, v = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
            s += u * v
            n1 += abs(u)
            n2 += abs(v)
    return s / math.sqrt(n1) / math.sqrt(n2) if n1 and n2 else -1.0


def spearman(a, b) -> float:
    ra, rb = pd.Series(a).rank().to_numpy(), pd.Series(b).rank().to_numpy()
    da, db = ra - ra.mean(), rb - rb.mean()
    d = math.sqrt((da @ da) * (db @ db))
    return float(da @ db / d) if d else -1.0
