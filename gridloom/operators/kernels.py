"""NumPy kernels for solvers whose steps depend on each other within one image, polyline or clip. No Spark in here.

Images are 2-D arrays, masks boolean ones, polylines arrays of (x, y).
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np

EIGHT = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
FOUR = [(0, -1), (-1, 0), (1, 0), (0, 1)]
RING = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def components(mask: np.ndarray, offsets=EIGHT) -> np.ndarray:
    """Labels from 1 in reading order of the first pixel, 0 elsewhere."""
    h, w = mask.shape
    out, n = np.zeros((h, w), np.int64), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not out[y, x]:
            n += 1
            out[y, x], todo = n, [(y, x)]
            while todo:
                a, b = todo.pop()
                for dx, dy in offsets:
                    p, q = a + dy, b + dx
                    if 0 <= p < h and 0 <= q < w and mask[p, q] and not out[p, q]:
                        out[p, q] = n
                        todo.append((p, q))
    return out


def gradient_flow(image: np.ndarray, rounds: int = 20, mu: float = 0.2, dt: float = 0.15) -> np.ndarray:
    """op N16: gradient vector flow (2, h, w) of the edge strength, by explicit diffusion of the inner pixels."""
    gy, gx = np.gradient(image.astype(float))
    edge = np.hypot(gx, gy)
    edge = edge / edge.max() if edge.max() > 0 else edge
    fy, fx = np.gradient(edge)
    size = fx**2 + fy**2
    out = np.stack([fx, fy])
    for _ in range(rounds):
        inner = out[:, 1:-1, 1:-1]
        lap = out[:, :-2, 1:-1] + out[:, 2:, 1:-1] + out[:, 1:-1, :-2] + out[:, 1:-1, 2:] - 4 * inner
        pull = size[1:-1, 1:-1] * (inner - np.stack([fx, fy])[:, 1:-1, 1:-1])
        out[:, 1:-1, 1:-1] = np.clip(inner + dt * (mu * lap - pull), -2, 2)
    return out


def watershed(relief: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """op C5: Meyer's flooding; 0 is a dam between basins."""
    h, w = relief.shape
    out, queued = markers.astype(np.int64).copy(), markers > 0
    heap: list[tuple[float, int]] = []

    def around(y: int, x: int):
        return [(y + dy, x + dx) for dx, dy in EIGHT if 0 <= y + dy < h and 0 <= x + dx < w]

    for y, x in zip(*np.nonzero(markers), strict=True):
        for p, q in around(y, x):
            if not queued[p, q]:
                queued[p, q] = True
                heapq.heappush(heap, (float(relief[p, q]), p * w + q))
    while heap:
        _, at = heapq.heappop(heap)
        y, x = divmod(at, w)
        near = {int(out[p, q]) for p, q in around(y, x)} - {0}
        if len(near) == 1:
            out[y, x] = near.pop()
            for p, q in around(y, x):
                if not queued[p, q]:
                    queued[p, q] = True
                    heapq.heappush(heap, (float(relief[p, q]), p * w + q))
    return out


def minima(relief: np.ndarray) -> np.ndarray:
    """op C6: labelled inner pixels that no neighbour is below."""
    padded = np.pad(relief, 1, mode="edge")
    h, w = relief.shape
    low = np.min([padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dx, dy in EIGHT], 0)
    mask = relief <= low
    mask[[0, -1]] = False
    mask[:, [0, -1]] = False
    return components(mask)


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Distance of every pixel to the nearest one in the mask; infinite without one."""
    h, w = mask.shape
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.full((h, w), np.inf)
    column = np.full((h, w), np.inf)
    rows = np.arange(h)
    for x in np.unique(xs):
        column[:, x] = np.abs(rows[:, None] - ys[xs == x][None]).min(1)
    out, square = np.full((h, w), np.inf), column**2
    for x in np.unique(xs):  # one column of seeds at a time, so memory stays that of the image
        np.minimum(out, square[:, x, None] + (np.arange(w) - x) ** 2, out=out)
    return np.sqrt(out)


def sobel(a: np.ndarray) -> np.ndarray:
    """Size of the Sobel gradient over eight, borders repeated."""
    p = np.pad(np.asarray(a, float), 1, mode="edge")
    smooth = lambda q, axis: q.take(range(q.shape[axis] - 2), axis) + 2 * q.take(range(1, q.shape[axis] - 1), axis) + q.take(range(2, q.shape[axis]), axis)
    return np.hypot(smooth(p[:, 2:] - p[:, :-2], 0), smooth(p[2:] - p[:-2], 1)) / 8


def log_crossings(a: np.ndarray, sigma: float = 1.4, reach: int = 5) -> np.ndarray:
    """Inner pixels where the Laplacian of Gaussian changes its sign against the left or upper neighbour."""
    d = np.arange(-reach, reach + 1)
    r2 = d[:, None] ** 2 + d[None] ** 2
    k = (r2 - 2 * sigma**2) / sigma**4 * np.exp(-r2 / (2 * sigma**2))
    k -= k.mean()
    h, w = a.shape
    p = np.pad(np.asarray(a, float), reach, mode="edge")
    on = np.round(sum(k[i, j] * p[i : i + h, j : j + w] for i in range(2 * reach + 1) for j in range(2 * reach + 1)), 6) >= 0
    out = np.zeros((h, w), bool)
    out[1:-1, 1:-1] = (on[1:-1, 1:-1] != on[1:-1, :-2]) | (on[1:-1, 1:-1] != on[:-2, 1:-1])
    return out


def livewire_cost(a: np.ndarray) -> np.ndarray:
    """op C18: low on strong edges and on zero crossings."""
    m = sobel(a)
    return 0.02 + 0.45 * (1 - m / max(1e-9, m.max())) + np.where(log_crossings(a), 0.0, 0.35)


def lab(rgb: np.ndarray) -> np.ndarray:
    """op P2 for (h, w, 3) in 0..255: CIE L*a*b* (D65)."""
    c = np.asarray(rgb, float) / 255
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = c @ np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]).T / [0.95047, 1.0, 1.08883]
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def watershed_of_mask(mask: np.ndarray, least: float = 1.5) -> np.ndarray:
    """op C7: floods minus the inner distance from its maxima; the deepest pixel where there is none."""
    d = distance_to(~mask)
    d = np.where(np.isfinite(d), d, max(mask.shape))
    relief = np.where(mask, -d, 1e6)
    peaks = minima(relief)
    peaks = components(mask & (d >= least) & (peaks > 0))
    if not peaks.any() and mask.any():
        peaks[np.unravel_index(np.argmax(np.where(mask, d, -1)), mask.shape)] = 1
    return watershed(relief, peaks)


def superpixels(image: np.ndarray, k: int = 64, m: float = 10.0, rounds: int = 8) -> np.ndarray:
    """op C9: SLIC with distance dc + m / S ds over windows of 2S; image is (h, w, channels)."""
    h, w = image.shape[:2]
    s = max(1, int(np.sqrt(h * w / k)))
    gy, gx = np.gradient(image.mean(2))
    slope = gx**2 + gy**2
    seeds = []
    for y in range(s // 2, h, s):
        for x in range(s // 2, w, s):
            ys, xs = slice(max(0, y - 1), y + 2), slice(max(0, x - 1), x + 2)
            dy, dx = np.unravel_index(np.argmin(slope[ys, xs]), slope[ys, xs].shape)
            seeds.append((max(0, y - 1) + dy, max(0, x - 1) + dx))
    place = np.array(seeds, float)
    colour = np.array([image[y, x] for y, x in seeds], float)
    yy, xx = np.mgrid[:h, :w]
    for _ in range(rounds):
        best, out = np.full((h, w), np.inf), np.zeros((h, w), np.int64)
        for i, (cy, cx) in enumerate(place):
            ys, xs = slice(max(0, int(cy) - 2 * s), int(cy) + 2 * s + 1), slice(max(0, int(cx) - 2 * s), int(cx) + 2 * s + 1)
            d = np.linalg.norm(image[ys, xs] - colour[i], axis=2) + m / s * np.hypot(yy[ys, xs] - cy, xx[ys, xs] - cx)
            closer = d < best[ys, xs]
            best[ys, xs][closer], out[ys, xs][closer] = d[closer], i
        n = np.maximum(1, np.bincount(out.ravel(), minlength=len(place)))
        mean = lambda v: np.bincount(out.ravel(), v.ravel(), len(place)) / n
        place = np.stack([mean(yy), mean(xx)], 1)
        colour = np.stack([mean(image[..., c]) for c in range(image.shape[2])], 1)
    return out


def merge_small(labels: np.ndarray, least: int) -> np.ndarray:
    """op C10: connected labels, of which pieces below a size join a neighbour."""
    h, w = labels.shape
    out, n = np.full((h, w), -1, np.int64), 0
    for y in range(h):
        for x in range(w):
            if out[y, x] < 0:
                piece, todo, beside = [(y, x)], [(y, x)], -1
                out[y, x] = n
                while todo:
                    a, b = todo.pop()
                    for dx, dy in FOUR:
                        p, q = a + dy, b + dx
                        if 0 <= p < h and 0 <= q < w:
                            if out[p, q] < 0 and labels[p, q] == labels[y, x]:
                                out[p, q] = n
                                piece.append((p, q))
                                todo.append((p, q))
                            elif 0 <= out[p, q] != n:
                                beside = out[p, q]
                if len(piece) < least and beside >= 0:
                    for p in piece:
                        out[p] = beside
                else:
                    n += 1
    return out


class Sets:
    """Disjoint sets with sizes."""

    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, a: int, b: int) -> int:
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size[b]
        return a


def graph_segments(image: np.ndarray, k: float = 80.0, least: int = 32) -> np.ndarray:
    """op C11: Felzenszwalb and Huttenlocher's merging of 4-neighbours by rising difference, then of small pieces."""
    h, w = image.shape[:2]
    at = np.arange(h * w).reshape(h, w)
    flat = image.reshape(h * w, -1).astype(float)
    a = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()])
    b = np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    weight = np.linalg.norm(flat[a] - flat[b], axis=1)
    order = np.argsort(weight, kind="stable")
    sets, inside = Sets(h * w), [0.0] * (h * w)
    for i in order.tolist():
        p, q = sets.find(int(a[i])), sets.find(int(b[i]))
        if p != q and weight[i] <= min(inside[p] + k / sets.size[p], inside[q] + k / sets.size[q]):
            inside[sets.join(p, q)] = float(weight[i])
    for i in order.tolist():
        p, q = sets.find(int(a[i])), sets.find(int(b[i]))
        if p != q and min(sets.size[p], sets.size[q]) < least:
            sets.join(p, q)
    return np.unique([sets.find(i) for i in range(h * w)], return_inverse=True)[1].reshape(h, w)


class Flow:
    """op C14: largest flow and least cut by level graphs (Dinic)."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, room: float, back: float = 0.0) -> None:
        for p, q, r in ((a, b, room), (b, a, back)):
            self.out[p].append(len(self.to))
            self.to.append(q)
            self.room.append(r)

    def levels(self, s: int) -> list[int]:
        level, todo = [-1] * len(self.out), deque([s])
        level[s] = 0
        while todo:
            a = todo.popleft()
            for e in self.out[a]:
                if self.room[e] > 1e-8 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    todo.append(self.to[e])
        return level

    def run(self, s: int, t: int) -> float:
        total = 0.0
        while (level := self.levels(s))[t] >= 0:
            tried, path = [0] * len(self.out), []
            while True:
                a = self.to[path[-1]] if path else s
                if a == t:
                    least = min(self.room[e] for e in path)
                    total += least
                    for i, e in enumerate(path):
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    first = next(i for i, e in enumerate(path) if self.room[e] <= 1e-8)
                    del path[first:]
                    continue
                while tried[a] < len(self.out[a]):
                    e = self.out[a][tried[a]]
                    if self.room[e] > 1e-8 and level[self.to[e]] == level[a] + 1:
                        path.append(e)
                        break
                    tried[a] += 1
                else:
                    if not path:
                        break
                    tried[self.to[path.pop() ^ 1]] += 1
        return total


def lloyd(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """op C13: centres by farthest points from the first, then rounds of means; empty clusters stay."""
    centres = [points[0]]
    for _ in range(1, min(k, len(points))):
        centres.append(points[np.argmax(np.min([((points - c) ** 2).sum(1) for c in centres], 0))])
    c = np.array(centres, float)
    for _ in range(rounds):
        own = np.argmin(((points[:, None] - c[None]) ** 2).sum(2), 1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = points[own == i].mean(0)
    return c


def graph_cut(image: np.ndarray, box: tuple[int, int, int, int], gamma: float = 30.0, k: int = 4) -> np.ndarray:
    """op C12: foreground by a least cut: colour models of inside and outside the box (x, y, w, h), smoothness between
    neighbours; pixels outside are background."""
    h, w = image.shape[:2]
    flat = image.reshape(h * w, -1).astype(float)
    inside = np.zeros((h, w), bool)
    inside[box[1] : box[1] + box[3], box[0] : box[0] + box[2]] = True
    inside = inside.ravel()
    if inside.all() or not inside.any():
        return inside.reshape(h, w)
    far = lambda c: ((flat[:, None] - c[None]) ** 2).sum(2).min(1)
    fg, bg = far(lloyd(flat[inside], k)), far(lloyd(flat[~inside], k))
    at = np.arange(h * w).reshape(h, w)
    a, b = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()]), np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    d = ((flat[a] - flat[b]) ** 2).sum(1)
    near = gamma * np.exp(-d / (2 * d.mean() + 1e-9))
    scale = gamma / (np.mean(fg + bg) + 1e-9)
    g = Flow(h * w + 2)
    s, t = h * w, h * w + 1
    for i in range(h * w):
        g.edge(s, i, float(bg[i] * scale) if inside[i] else 0.0)
        g.edge(i, t, float(fg[i] * scale) if inside[i] else 1e9)
    for p, q, r in zip(a.tolist(), b.tolist(), near.tolist(), strict=True):
        g.edge(p, q, r, r)
    g.run(s, t)
    return np.array(g.levels(s)[: h * w]).reshape(h, w) >= 0


def colour_graph(edges: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    """op C17: Welsh and Powell's colours, as many as needed; nodes by falling degree, then number."""
    near: dict[int, set[int]] = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out: dict[int, int] = {}
    for n in sorted(nodes, key=lambda n: (-len(near[n]), n)):
        taken = {out[m] for m in near[n] if m in out}
        out[n] = next(c for c in range(len(nodes) + 1) if c not in taken)
    return out


def shortest_path(cost: np.ndarray, a: tuple[int, int], b: tuple[int, int], corridor: int = 48, turn: float = 0.2) -> list[tuple[int, int]]:
    """op C19: cheapest 8-connected way from a to b (x, y), within a corridor around both, turning steps costing more."""
    h, w = cost.shape
    lo = max(0, min(a[0], b[0]) - corridor), max(0, min(a[1], b[1]) - corridor)
    hi = min(w - 1, max(a[0], b[0]) + corridor), min(h - 1, max(a[1], b[1]) + corridor)
    gy, gx = np.gradient(cost)
    norm = np.hypot(gx, gy) + 1e-12
    best, came, heap = {a: 0.0}, {}, [(0.0, a)]
    while heap:
        d, (x, y) = heapq.heappop(heap)
        if (x, y) == b:
            break
        if d > best[(x, y)]:
            continue
        for dx, dy in EIGHT:
            p, q = x + dx, y + dy
            if lo[0] <= p <= hi[0] and lo[1] <= q <= hi[1]:
                step = np.hypot(dx, dy)
                along = abs(gx[q, p] * dx + gy[q, p] * dy) / (norm[q, p] * step)
                new = d + step * (cost[q, p] + turn * 0.5 * (1 - along))
                if new < best.get((p, q), np.inf):
                    best[(p, q)], came[(p, q)] = new, (x, y)
                    heapq.heappush(heap, (new, (p, q)))
    path = [b]
    while path[-1] != a and path[-1] in came:
        path.append(came[path[-1]])
    return path[::-1]


def trace_through(cost: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """op C20: ways through the seeds in turn, closed with three or more."""
    stops = seeds + seeds[:1] if len(seeds) >= 3 else seeds
    out: list[tuple[int, int]] = []
    for a, b in zip(stops, stops[1:], strict=False):
        out += shortest_path(cost, a, b)[bool(out) :]
    return out


def trace_boundary(mask: np.ndarray) -> np.ndarray:
    """op G1: Moore's trace of the first component in reading order, clockwise (y down)."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.zeros((0, 2), int)
    h, w = mask.shape
    on = lambda x, y: 0 <= x < w and 0 <= y < h and mask[y, x]
    start = (int(xs[0]), int(ys[0]))
    at, back, out, first = start, 4, [start], None
    for _ in range(8 * len(ys) + 8):
        for k in range(1, 9):
            d = (back + k) % 8
            if on(at[0] + RING[d][0], at[1] + RING[d][1]):
                break
        else:
            break
        if first is None:
            first = d
        elif at == start and d == first:
            out.pop()
            break
        at = at[0] + RING[d][0], at[1] + RING[d][1]
        back = (d + 4) % 8
        out.append(at)
    return np.array(out)


def seeds_along(points: np.ndarray, every: int, most: int = 24) -> list[tuple[int, int]]:
    """op C21: way-points along a traced boundary."""
    step = max(every, -(-len(points) // most))
    return [tuple(int(v) for v in p) for p in points[::step]]


def stitch(segments: np.ndarray) -> list[np.ndarray]:
    """op G9: loops and chains out of pieces (ax, ay, bx, by) whose ends agree to a thousandth."""
    ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
    key = lambda x, y: (round(x * 1000), round(y * 1000))
    for i, (ax, ay, bx, by) in enumerate(segments):
        ends.setdefault(key(ax, ay), []).append((i, 0))
        ends.setdefault(key(bx, by), []).append((i, 1))
    used, out = np.zeros(len(segments), bool), []
    for i in range(len(segments)):
        if used[i]:
            continue
        used[i] = True
        chain = deque([segments[i][:2], segments[i][2:]])
        for grow, tip in ((chain.append, -1), (chain.appendleft, 0)):
            while True:
                found = next(((j, e) for j, e in ends[key(*chain[tip])] if not used[j]), None)
                if found is None:
                    break
                used[found[0]] = True
                grow(segments[found[0]][2:] if found[1] == 0 else segments[found[0]][:2])
        if len(chain) >= 3:
            out.append(np.array(chain))
    return out


def dual_contour(field: np.ndarray, iso: float = 0.0) -> tuple[np.ndarray, int]:
    """op G11: a vertex (x, y) for each cell that the iso line crosses, by a 2x2 quadratic error fit to the crossings'
    normals (their mean where it is ill-conditioned), kept within the cell; and how many sides link two cells."""
    f = field.astype(float) - iso
    gy, gx = np.gradient(f)
    h, w = f.shape
    hits: dict[tuple[int, int], list[tuple[float, float, float, float]]] = {}
    links = 0
    for dx, dy in ((1, 0), (0, 1)):
        a, b = f[: h - dy, : w - dx], f[dy:, dx:]
        for y, x in zip(*np.nonzero((a <= 0) != (b <= 0)), strict=True):
            t = a[y, x] / (a[y, x] - b[y, x])
            n = np.array([gx[y, x] * (1 - t) + gx[y + dy, x + dx] * t, gy[y, x] * (1 - t) + gy[y + dy, x + dx] * t])
            n = n / (np.hypot(*n) + 1e-12)
            cells = [(y, x), (y - 1, x)] if dx else [(y, x), (y, x - 1)]
            cells = [c for c in cells if 0 <= c[0] < h - 1 and 0 <= c[1] < w - 1]
            links += len(cells) == 2
            for c in cells:
                hits.setdefault(c, []).append((x + t * dx, y + t * dy, n[0], n[1]))
    out = []
    for (y, x), own in sorted(hits.items()):
        p = np.array(own)
        mass = p[:, :2].mean(0)
        m = p[:, 2:].T @ p[:, 2:]
        v = mass
        if np.linalg.eigvalsh(m)[0] > 1e-2:
            v = mass + np.linalg.solve(m, p[:, 2:].T @ ((p[:, :2] - mass) * p[:, 2:]).sum(1))
        out.append(np.clip(v, [x, y], [x + 1, y + 1]))
    return np.array(out).reshape(-1, 2), links


def simplify(points: np.ndarray, eps: float) -> np.ndarray:
    """op G12: which points Ramer, Douglas and Peucker keep."""
    keep = np.zeros(len(points), bool)
    if len(points):
        keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = points[a + 1 : b] - points[a], points[b] - points[a]
        n = np.hypot(*d)
        far = np.hypot(*p.T) if n < 1e-12 else np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / n
        i = int(far.argmax())
        if far[i] > eps:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def hull(points: np.ndarray) -> np.ndarray:
    """op G14: corners of the convex hull (monotone chains), without points on its sides."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def defects(contour: np.ndarray, corners: np.ndarray, depth: float = 2.0) -> int:
    """op G15: pockets between successive hull corners along the contour whose deepest point lies deeper than `depth`."""
    where = {tuple(p): i for i, p in enumerate(contour.tolist())}
    at = sorted(where[tuple(c)] for c in corners.tolist() if tuple(c) in where)
    n = 0
    for a, b in zip(at, at[1:] + at[:1], strict=True):
        own = contour[a : b + 1] if a < b else np.concatenate([contour[a:], contour[: b + 1]])
        d = own[-1] - own[0]
        size = np.hypot(*d)
        n += bool(size > 0 and (np.abs((own[:, 0] - own[0, 0]) * d[1] - (own[:, 1] - own[0, 1]) * d[0]) / size).max() > depth)
    return n


def snake(image: np.ndarray, box: tuple[int, int, int, int], n: int = 192, rounds: int = 140) -> np.ndarray:
    """op G16: a closed contour from the box's inset ellipse, moved by tension, rigidity and gradient flow."""
    flow = gradient_flow(image, 64)
    x, y, w, h = box
    t = 2 * np.pi * np.arange(n) / n
    p = np.stack([x + w / 2 + 0.45 * w * np.cos(t), y + h / 2 + 0.45 * h * np.sin(t)], 1)
    for i in range(rounds):
        a = np.roll(p, 1, 0) + np.roll(p, -1, 0) - 2 * p
        b = np.roll(a, 1, 0) + np.roll(a, -1, 0) - 2 * a
        at = np.clip(np.rint(p).astype(int), 0, [image.shape[1] - 1, image.shape[0] - 1])
        p = np.clip(p + 0.2 * a - 0.05 * b + 0.8 * flow[:, at[:, 1], at[:, 0]].T, 0, [image.shape[1] - 1, image.shape[0] - 1])
        if i % 12 == 11:
            p = resampled(p, n)
    return p


def resampled(p: np.ndarray, n: int) -> np.ndarray:
    """op G2 on one closed polyline."""
    q = np.concatenate([p, p[:1]])
    s = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(q, axis=0).T))])
    at = np.arange(n) * s[-1] / n
    return np.stack([np.interp(at, s, q[:, 0]), np.interp(at, s, q[:, 1])], 1)


def chan_vese(image: np.ndarray, rounds: int = 50, mu: float = 0.2, dt: float = 0.5, every: int = 10) -> np.ndarray:
    """op G17: level set, negative inside, that lowers the spread within and without, from a centred circle."""
    h, w = image.shape
    u = image.astype(float) / max(1.0, float(image.max()))
    yy, xx = np.mgrid[:h, :w]
    phi = np.hypot(xx - w / 2, yy - h / 2) - min(h, w) / 3
    for i in range(rounds):
        inside = phi < 0
        c1, c2 = (u[m].mean() if m.any() else 0.0 for m in (inside, ~inside))
        gy, gx = np.gradient(phi)
        n = np.hypot(gx, gy) + 1e-8
        curve = np.gradient(gx / n, axis=1) + np.gradient(gy / n, axis=0)
        phi = phi + dt * (mu * curve + (u - c1) ** 2 - (u - c2) ** 2) * 4
        if i % every == every - 1 and (phi < 0).any() and (phi >= 0).any():
            phi = distance_to(phi < 0) - distance_to(phi >= 0)
    return phi


def thin_plate(centres: np.ndarray, values: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """op G19: weights of r^2 log r about the centres that fit the values."""
    return np.linalg.solve(_plate(centres, centres) + ridge * np.eye(len(centres)), values)


def thin_plate_at(points: np.ndarray, centres: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _plate(points, centres) @ weights


def _plate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    r2 = ((a[:, None] - b[None]) ** 2).sum(2)
    return np.where(r2 > 0, 0.5 * r2 * np.log(np.maximum(r2, 1e-300)), 0.0)


def power_spectrum(frame: np.ndarray, padded: int = 512) -> np.ndarray:
    """op A4."""
    return np.abs(np.fft.rfft(frame, padded)) ** 2 / padded


def poles(a: np.ndarray, rate: float) -> list[tuple[float, float]]:
    """op A9: (frequency, bandwidth) of a prediction polynomial's roots in the upper half plane."""
    if not np.any(a[1:]) or not np.isfinite(a).all():
        return []
    r = np.roots(a)
    r = r[(r.imag > 0) & (np.abs(r) > 1e-12)]
    return sorted((float(np.angle(z) * rate / (2 * np.pi)), float(-np.log(np.abs(z)) * rate / np.pi)) for z in r)
