"""Clustering that has no relational form: one group of rows in, (key, cluster) out.

Kernels run in grouped pandas functions, one task a group. Ward and single linkage compute the distances of a row when they
come to it and hold a few numbers a row, whatever their number; so do mean shift and the consensus by average linkage. Average
and complete linkage of vectors hold a square of distances and refuse groups beyond MOST_ROWS; HDBSCAN holds the edges to near
rows and a block of distances, t-SNE those edges and a grid.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from colscope.errors import ClusteringError
from colscope.functions.constants import K_RANGE, MIN_CLUSTER_SIZE
from colscope.operators.rank import checkpoint

#: Rows of a square of distances at most; rows whose distances to all others are held at a time.
MOST_ROWS, BLOCK = 12_000, 256
#: Clusters that a block of Ward's search meets at a time: what arises stays in cache.
TILE = 1024
#: Distances of a block of rows at most, whatever the rows (HDBSCAN: twice as many); pairs of t-SNE beyond which only near rows attract.
MOST_CELLS = 1 << 21
#: Near rows that a spanning tree begins with, at least; rows of a group of which only the least distance is looked at first.
NEAR, FOLD = 16, 32


def _matrix(pdf: pd.DataFrame, column: str = "vector") -> np.ndarray:
    return np.array(pdf[column].tolist(), np.float64).reshape(len(pdf), -1)


def _square(n: int) -> None:
    if n > MOST_ROWS:
        raise ClusteringError(f"{n} rows in one group; at most {MOST_ROWS}")


class Rows:
    """Distances of some rows to all rows, made when they are asked for."""

    def __init__(self, x: np.ndarray, metric: str = "euclidean"):
        if metric == "cosine":
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(n == 0, 1, n)
        self.x, self.cosine = x, metric == "cosine"
        self.s = (x * x).sum(axis=1)

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, at: slice) -> np.ndarray:
        return self.rows(np.arange(at.start, min(at.stop, len(self))))

    def rows(self, at: np.ndarray) -> np.ndarray:
        d = self.x[at] @ self.x.T
        if self.cosine:
            return np.clip(1 - d, 0, None, out=d)
        d *= -2
        d += self.s[None, :]
        d += self.s[at][:, None]
        d = np.sqrt(np.clip(d, 0, None, out=d), out=d)
        d[np.arange(len(d)), at] = 0
        return d

    def blocks(self):
        step = max(1, min(BLOCK, MOST_CELLS // max(1, len(self.x))))
        for a in range(0, len(self.x), step):
            yield slice(a, min(a + step, len(self.x)))


def distances(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    _square(len(x))
    return Rows(x, metric)[0 : len(x)]


def _ward_nearest(mean: np.ndarray, size: np.ndarray, todo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cluster of each of ``todo`` by Ward's squared height, the first of equals, and that height.

    Blocks meet all clusters by matrix products in single width; whatever these leave within their error is compared in
    double width without cancellation. Where that is much, the products are of double width too.
    """
    length = np.einsum("ij,ij->i", mean, mean)
    left = np.column_stack([-2 * mean, np.ones(len(mean)), length])
    right = np.column_stack([mean, length, np.ones(len(mean))])
    single = left.astype(np.float32), right.astype(np.float32)
    scaled, of = single[1], 0.0
    near, far = np.empty(len(todo), np.int64), np.empty(len(todo))
    starts = range(0, len(mean), TILE)
    for k in range(0, len(todo), BLOCK):
        rows, here = todo[k : k + BLOCK], np.arange(len(todo[k : k + BLOCK]))
        for kind in (np.float32, np.float64):
            even = size[rows[0]] == size[rows[-1]] and kind is np.float32  # todo is in order of size
            if even and of != size[rows[0]]:
                of = size[rows[0]]
                scaled = (right * (2 * of * size / (size + of))[:, None]).astype(np.float32)
            one, other = (single[0], scaled if even else single[1]) if kind is np.float32 else (left, right)
            one, weight = one[rows], size.astype(kind)

            def heights(who: np.ndarray, a: int) -> np.ndarray:
                d = one[who] @ other[a : a + TILE].T
                if not even:
                    mine, theirs = weight[rows[who]][:, None], weight[a : a + TILE]
                    d *= 2 * mine * theirs / (mine + theirs)
                own = rows[who] - a
                inside = np.flatnonzero((own >= 0) & (own < d.shape[1]))
                d[inside, own[inside]] = np.inf
                return d

            # the least of a tile first; tiles are made again only for the rows that may have their nearest there
            least = np.stack([heights(here, a).min(axis=1) for a in starts], axis=1)
            error = 4 * (mean.shape[1] + 4) * np.finfo(kind).eps * (length[rows] + length.max()) * 2 * size[rows]
            most = least.min(axis=1) + error
            pairs = []
            for t in np.flatnonzero((least <= most[:, None]).any(axis=0)):
                who = np.flatnonzero(least[:, t] <= most)
                i, j = np.nonzero(heights(who, starts[t]) <= most[who][:, None])
                pairs.append((who[i], j + starts[t]))
            i, j = (np.concatenate(side) for side in zip(*pairs, strict=True))
            if len(i) <= 64 * len(rows):
                break
        gap = mean[rows[i]] - mean[j]
        height = 2 * size[rows[i]] * size[j] / (size[rows[i]] + size[j]) * np.einsum("ij,ij->i", gap, gap)
        height[j == rows[i]] = np.inf
        order = np.lexsort((j, height, i))
        best = order[np.searchsorted(i[order], here)]
        near[k : k + BLOCK], far[k : k + BLOCK] = j[best], height[best]
    return near, far


def ward_merges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges of Ward's linkage, as ``merges`` gives them, from means and sizes instead of distances.

    The squared height of two clusters is 2 n m / (n + m) times the squared distance of their means. Copies merge first, at
    zero. Then every round merges all clusters that are each other's nearest: by the reducibility of the linkage nothing
    that they become is nearer to a third one than they were, so the nearest of the others stand and only those are looked
    for again that lost theirs.
    """
    n = len(x)
    x = x.astype(np.float64)
    _, first, kind = np.unique(x, axis=0, return_index=True, return_inverse=True)
    heads = first[kind.ravel()]
    out = [(int(h), i, 0.0) for i, h in enumerate(heads.tolist()) if h != i]
    at = np.sort(first)  # clusters by their least row
    mean, size = (x - x.mean(axis=0))[at], np.bincount(heads, minlength=n)[at].astype(np.float64)
    near, far = np.full(len(at), -1), np.full(len(at), np.inf)
    while len(at) > 1:
        todo = np.flatnonzero(near < 0)
        todo = todo[np.argsort(size[todo], kind="stable")]
        near[todo], far[todo] = _ward_nearest(mean, size, todo)
        i = np.flatnonzero((near[near] == np.arange(len(at))) & (near > np.arange(len(at))))
        if not len(i):  # rounding may have closed a ring: its least pair
            i = np.array([int(far.argmin())])
        a, b = np.minimum(i, near[i]), np.maximum(i, near[i])
        out += zip(at[a].tolist(), at[b].tolist(), np.sqrt(far[i]).tolist(), strict=True)
        mean[a] = (size[a][:, None] * mean[a] + size[b][:, None] * mean[b]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        lost, kept = np.zeros(len(at), bool), np.ones(len(at), bool)
        lost[a] = lost[b] = True
        near[lost[near] | lost] = -1
        kept[b] = False
        place = np.cumsum(kept) - 1
        near = np.where(near < 0, -1, place[near])[kept]
        at, mean, size, far = at[kept], mean[kept], size[kept], far[kept]
    return sorted(out, key=lambda m: m[2])


def single_merges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges of single linkage: the edges of a spanning tree, lowest first."""
    return sorted(spanning_tree(Rows(x)), key=lambda m: m[2])


def merges(d: np.ndarray, linkage: str = "ward") -> list[tuple[int, int, float]]:
    """The merges of an agglomerative clustering, lowest first: (a, b, height), clusters named by their least row.

    Chains of nearest neighbours end in mutual pairs; updates by the Lance-Williams rule of the linkage.
    """
    if linkage not in ("ward", "single", "complete", "average"):
        raise ClusteringError(f"unknown linkage {linkage}")
    n = len(d)
    d = d.astype(np.float64).copy()
    if linkage == "ward":
        d **= 2
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    out: list[tuple[int, int, float]] = []
    chain: list[int] = []
    while len(out) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        row = np.where(alive, d[a], np.inf)
        b = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            h, i, j = d[a, b], min(a, b), max(a, b)
            if linkage == "single":
                new = np.minimum(d[i], d[j])
            elif linkage == "complete":
                new = np.maximum(d[i], d[j])
            elif linkage == "average":
                new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            else:
                new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * h) / (size[i] + size[j] + size)
            new[i] = np.inf
            d[i], d[:, i] = new, new
            d[j], d[:, j] = np.inf, np.inf
            alive[j] = False
            size[i] += size[j]
            out.append((i, j, math.sqrt(max(h, 0.0)) if linkage == "ward" else float(h)))
        else:
            chain.append(b)
    return sorted(out, key=lambda m: m[2])


def cut_tree(n: int, tree: list[tuple[int, int, float]], k: int | None = None, height: float | None = None) -> np.ndarray:
    """Labels of the tree cut at k clusters, or below a height (merges at the height or above do not happen)."""
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    done = tree[: n - k] if k is not None else [m for m in tree if m[2] < height]
    for a, b, _ in done:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(n)]
    names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([names[r] for r in roots], int)


def silhouette_sums(d: Rows, cuts: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """The sum of the silhouettes of the rows ``mine`` under each column of ``cuts``, 0 for one cluster.

    Every distance is made once and summed by the classes that all cuts have in common.
    """
    classes, inverse = np.unique(cuts, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    member, out = np.eye(len(classes))[inverse], np.zeros(cuts.shape[1])
    names = [np.unique(classes[:, k], return_inverse=True) for k in range(cuts.shape[1])]
    for a in range(0, len(mine), BLOCK):
        rows = mine[a : a + BLOCK]
        fine, row = d.rows(rows) @ member, np.arange(len(rows))
        for k, (known, of) in enumerate(names):
            if len(known) < 2:
                continue
            into = np.eye(len(known))[of]
            sums, size, own_class = fine @ into, np.bincount(of[inverse], minlength=len(known)).astype(np.float64), of[inverse[rows]]
            own = sums[row, own_class] / np.maximum(size[own_class] - 1, 1)
            mean = sums / size
            mean[row, own_class] = np.inf
            other = mean.min(axis=1)
            top = np.maximum(own, other)
            out[k] += np.where((size[own_class] == 1) | (top == 0), 0, (other - own) / np.where(top == 0, 1, top)).sum()
    return out


def silhouettes(d: Rows, cuts: list[np.ndarray]) -> list[float]:
    """The mean silhouette of each of several labellings, NaN for one cluster."""
    if not cuts:
        return []
    sums = silhouette_sums(d, np.stack(cuts, axis=1), np.arange(len(d)))
    return [float(s) / len(d) if len(np.unique(c)) > 1 else math.nan for s, c in zip(sums, cuts, strict=True)]


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    return silhouettes(Rows(x), [labels])[0]


def agglomerative(x: np.ndarray, k: int = 5, linkage: str = "ward") -> np.ndarray:
    if len(x) < 2:
        raise ClusteringError("agglomerative clustering needs two rows")
    tree = ward_merges(x) if linkage == "ward" else single_merges(x) if linkage == "single" else merges(distances(x), linkage)
    return cut_tree(len(x), tree, k=min(k, len(x)))


def ward_cuts(x: np.ndarray, k_range: tuple[int, int] = K_RANGE) -> list[np.ndarray]:
    """One tree, cut at every k of the range; one cluster of fewer than three rows or of copies of one row."""
    if len(x) < 3 or (x == x[0]).all():
        return [np.zeros(len(x), int)]
    tree = ward_merges(x)
    return [cut_tree(len(x), tree, k=k) for k in range(k_range[0], min(k_range[1], len(x) - 1) + 1)]


def best_cut(values: list[float]) -> int:
    """The place of the best silhouette, the first of equals."""
    best = 0
    for k, s in enumerate(values):
        if math.isnan(values[best]) or s > values[best]:
            best = k
    return best


def ward_by_silhouette(x: np.ndarray, k_range: tuple[int, int] = K_RANGE) -> tuple[np.ndarray, int, float]:
    """One tree, cut at every k of the range; the k of the best silhouette, the least of equals."""
    cuts = ward_cuts(x, k_range)
    if len(x) < 3 or (x == x[0]).all() or not cuts:
        return np.zeros(len(x), int), 1, math.nan
    values = silhouettes(Rows(x), cuts)
    best = best_cut(values)
    return cuts[best], best + k_range[0], values[best]


def consensus(agree: np.ndarray, threshold: float = 0.5, linkage: str = "average") -> np.ndarray:
    """Clusters of a co-association matrix: a tree over one less agreement, cut at the threshold."""
    if not len(agree):
        return np.empty(0, int)
    d = 1.0 - agree
    np.fill_diagonal(d, 0.0)
    return cut_tree(len(d), merges(d, linkage), height=threshold)


def average_roots(parts: list, rows: np.ndarray, views: int, threshold: float) -> np.ndarray:
    """For each signature the first one of its cluster, by average linkage of agreement cut at a threshold.

    ``parts`` are the parts (a view's cluster) of each signature, ``rows`` its number of rows. Two clusters agree by the sum
    over parts of the products of their rows that have it, whole numbers, so no pair of signatures is held. A cluster whose
    nearest is at the threshold or beyond stays as it is.
    """
    n = len(parts)
    names: dict[str, int] = {}
    own = [np.array([names.setdefault(p, len(names)) for p in ps], np.int64) for ps in parts]
    lengths = np.array([len(o) for o in own], np.int64)
    flat, at = (np.concatenate(own) if n else np.empty(0, np.int64)), np.repeat(np.arange(n), lengths)
    order = np.argsort(flat, kind="stable")
    holders = np.split(at[order], np.searchsorted(flat[order], np.arange(1, len(names)))) if names else []
    root, size, final = np.arange(n), rows.astype(np.float64), np.zeros(n, bool)
    members, counts = [[i] for i in range(n)], [dict.fromkeys(o.tolist(), float(r)) for o, r in zip(own, rows, strict=True)]
    weight, chain, start = rows.astype(np.float64), [], 0
    while True:
        if not chain:
            while start < n and (final[start] or root[start] != start):
                start += 1
            if start == n:
                return root
            chain = [start]
        a = chain[-1]
        held = [holders[p] for p in counts[a]]
        if held:
            who = np.concatenate(held)
            both = np.bincount(root[who], weight[who] * np.repeat(list(counts[a].values()), [len(h) for h in held]), n)
            share = both / (size * size[a] * views)
            share[a] = -1.0
        else:
            share = np.zeros(n)
        b = int(np.argmax(share))
        if len(chain) > 1 and share[chain[-2]] >= share[b]:
            b = chain[-2]
        if n == 1 or not 1.0 - share[b] < threshold:
            final[chain] = True  # whoever stands before it in the chain is no nearer to anything
            chain = []
        elif len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            i, j = min(a, b), max(a, b)
            root[members[j]] = i
            members[i] += members[j]
            size[i] += size[j]
            for p, c in counts[j].items():
                counts[i][p] = counts[i].get(p, 0.0) + c
            members[j], counts[j] = [], {}
        else:
            chain.append(b)


def neighbour_sum(x: np.ndarray, mine: np.ndarray, quantile: float) -> float:
    """The sum over the rows ``mine`` of the distance to the row that a quantile of all rows is no farther than."""
    d, k = Rows(x), min(max(int(len(x) * quantile), 1), len(x)) - 1
    return float(sum(np.partition(d.rows(mine[a : a + BLOCK]), k, axis=1)[:, k].sum() for a in range(0, len(mine), BLOCK)))


def shift_peaks(x: np.ndarray, mine: np.ndarray, bandwidth: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Where flat-kernel mean shift leads from the rows ``mine``, distinct, and how many rows are near each place.

    Blocks of places meet all distinct rows, weighted by their copies, by matrix products.
    """
    kinds, n = np.unique(x, axis=0, return_counts=True)
    right = np.vstack([kinds.T, (kinds * kinds).sum(axis=1), np.ones(len(kinds))])
    totals = np.column_stack([kinds * n[:, None], n]).astype(np.float64)
    peaks: dict[tuple, int] = {}
    starts = np.unique(x[mine], axis=0)
    for a in range(0, len(starts), BLOCK):
        p = starts[a : a + BLOCK]
        for _ in range(rounds):
            near = (np.column_stack([-2 * p, np.ones(len(p)), (p * p).sum(axis=1)]) @ right <= bandwidth**2).astype(np.float64) @ totals
            new = near[:, :-1] / near[:, -1:]
            still = np.linalg.norm(new - p, axis=1) < 1e-3 * bandwidth
            peaks |= zip(map(tuple, p[still].tolist()), near[still, -1].astype(int).tolist(), strict=True)
            p, near = new[~still], near[~still]
            if not len(p):
                break
        peaks |= zip(map(tuple, p.tolist()), near[:, -1].astype(int).tolist(), strict=True)
    return np.array(list(peaks)).reshape(-1, x.shape[1]), np.array(list(peaks.values()), int)


def apart(peaks: np.ndarray, near: np.ndarray, bandwidth: float) -> np.ndarray:
    """The fullest peaks of which no two lie within a bandwidth, the fullest first, then the largest."""
    left = peaks[np.lexsort((*peaks.T[::-1], near))[::-1]]
    kept = []
    while len(left):
        kept.append(left[0])
        left = left[1:][np.linalg.norm(left[1:] - left[0], axis=1) > bandwidth]
    return np.array(kept)


def nearest_peak(x: np.ndarray, kept: np.ndarray) -> np.ndarray:
    return np.argmin(np.stack([((x - p) ** 2).sum(axis=1) for p in kept]), axis=0)


def mean_shift(x: np.ndarray, bandwidth: float | None = None, quantile: float = 0.3, rounds: int = 300) -> np.ndarray:
    """Flat-kernel mean shift from every row; peaks within a bandwidth of a fuller one are dropped."""
    if not len(x):
        return np.empty(0, int)
    # rows by place about their mean: products lose less
    x, every = x - x.mean(axis=0), np.arange(len(x))
    if bandwidth is None:
        bandwidth = neighbour_sum(x, every, quantile) / len(x)
    bandwidth = bandwidth if bandwidth > 0 else 1.0
    return nearest_peak(x, apart(*shift_peaks(x, every, bandwidth, rounds), bandwidth))


def mean_shift_dealt(df: DataFrame, bandwidth: float | None = None, quantile: float = 0.3, rounds: int = 300) -> DataFrame:
    """(key, cluster) as ``mean_shift`` gives it: every task starts from some rows and has all of them."""
    from pyspark.sql import functions as F

    df = checkpoint(df.select("key", F.col("vector").cast("array<double>").alias("vector")))
    n, first = df.count(), df.first()
    if not n:
        return df.select("key", F.lit(0).alias("cluster"))
    slices = df.sparkSession.sparkContext.defaultParallelism
    sums = df.agg(*[F.avg(F.col("vector")[i]) for i in range(len(first["vector"]))]).first()
    middle = np.array(sums, np.float64)
    dealt = df.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).groupBy("_slice")

    def side(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return _matrix(pdf.sort_values("key")) - middle, np.arange(int(pdf["_slice"].iloc[0]), len(pdf), slices)

    if bandwidth is None:
        parts = dealt.applyInPandas(lambda pdf: pd.DataFrame({"s": [neighbour_sum(*side(pdf), quantile)]}), "s double")
        bandwidth = sum(r["s"] for r in parts.collect()) / n  # a number of every slice
    width = bandwidth if bandwidth > 0 else 1.0

    def shift(pdf: pd.DataFrame) -> pd.DataFrame:
        peaks, near = shift_peaks(*side(pdf), width, rounds)
        return pd.DataFrame({"vector": peaks.tolist(), "near": near})

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"vector": apart(_matrix(pdf), pdf["near"].to_numpy(), width).tolist()})

    found = dealt.applyInPandas(shift, "vector array<double>, near long").distinct().withColumn("_g", F.lit(0))
    kept = np.array([r["vector"] for r in found.groupBy("_g").applyInPandas(choose, "vector array<double>").collect()])  # no two within a bandwidth

    def name(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[["key"]].assign(cluster=nearest_peak(_matrix(pdf) - middle, kept).astype("int32"))

    return df.mapInPandas(name, df.select("key").schema.add("cluster", "integer"))


def spanning_tree(d: Rows, core: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Prim's minimum spanning tree of distances, or with core distances of mutual reachability."""
    n, out = len(d), []
    ids, x, length = np.arange(n), d.x, d.s
    best, source, reach = np.full(n, np.inf), np.zeros(n, int), core
    j, taken = 0, 0
    for _ in range(n - 1):
        # rows in the tree go, a quarter at a time, so that a step costs as many distances as there are rows outside
        best[np.searchsorted(ids, j)] = np.nan
        taken += 1
        if 4 * taken > len(ids):
            left = ~np.isnan(best)
            ids, x, length, best, source = ids[left], x[left], length[left], best[left], source[left]
            reach, taken = reach if reach is None else reach[left], 0
        w = x @ d.x[j]
        if d.cosine:
            w = np.clip(1 - w, 0, None)
        else:
            w = np.sqrt(np.clip(length + d.s[j] - 2 * w, 0, None))
        if core is not None:
            w = np.maximum(w, np.maximum(reach, core[j]))
        closer = w < best
        best[closer], source[closer] = w[closer], j
        at = int(np.nanargmin(best))
        j = int(ids[at])
        out.append((int(source[at]), j, float(best[at])))
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first row of each kind of equal rows, in order; the kind of each row; how many rows a kind has."""
    _, first, kind, copies = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return first[order], place[kind.ravel()], copies[order]


def _sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose products are the squared distances of all rows; about their mean, as products lose less."""
    x = x - x.mean(axis=0)
    length = np.einsum("ij,ij->i", x, x)
    return np.column_stack([x, np.ones(len(x)), length]), np.column_stack([-2 * x, length, np.ones(len(x))])


def _gaps(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of pairs of rows, without cancellation."""
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 15):
        gap = x[i[a : a + (1 << 15)]] - x[j[a : a + (1 << 15)]]
        out[a : a + (1 << 15)] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def near_depth(n: int, samples: int) -> int:
    """How many near rows a spanning tree of mutual reachability begins with."""
    return min(n - 1, max(NEAR, samples))


def near_rows(x: np.ndarray, mine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of each of the rows ``mine``, of equals the first, and their distances, lowest first.

    The least distances of groups of FOLD rows bound the k-th distance; only groups below the bound are looked through.
    """
    n = len(x)
    left, right = _sides(x)
    length, wide = left[:, -1], n // FOLD if n > 4 * FOLD * k else 0  # groups; the rest are looked through one by one
    near, far = np.empty((len(mine), k), np.int32), np.empty((len(mine), k))
    step = max(1, min(BLOCK, 2 * MOST_CELLS // n))
    for a in range(0, len(mine) if k else 0, step):
        rows = mine[a : a + step]
        d = left[rows] @ right.T
        d[np.arange(len(rows)), rows] = np.inf
        rest = d[:, FOLD * wide :]
        least = np.column_stack([d[:, : FOLD * wide].reshape(len(rows), FOLD, wide).min(axis=1), rest]) if wide else d
        most = np.partition(least, k - 1, axis=1)[:, k - 1] + 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (length[rows] + length.max())
        i, j = np.nonzero(rest <= most[:, None])
        j += FOLD * wide
        if wide:
            who, group = np.nonzero(least[:, :wide] <= most[:, None])
            at = group[:, None] + wide * np.arange(FOLD)
            hit, fold = np.nonzero(d[who[:, None], at] <= most[who][:, None])
            i, j = np.concatenate([i, who[hit]]), np.concatenate([j, at[hit, fold]])
        gap = _gaps(x, rows[i], j)
        order = np.lexsort((j, gap, i))
        best = order[np.searchsorted(i[order], np.arange(len(rows)))[:, None] + np.arange(k)]
        near[a : a + step], far[a : a + step] = j[best], gap[best]
    return near, far


def _joined(x: np.ndarray, near: np.ndarray, far: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning tree of the mutual reachability of distinct rows by Boruvka's rounds.

    A part takes its lowest known edge if none of its rows may have a lower one beyond its near rows. Where no part can,
    the rows that may, but those of the largest part, look for the nearest row outside their part among all rows.
    """
    n, k = near.shape
    i, j = np.repeat(np.arange(n), k), near.ravel().astype(np.int64)
    low, high, w = np.minimum(i, j), np.maximum(i, j), np.maximum(far.ravel(), np.maximum(core[i], core[j]))
    beyond = np.maximum(far[:, -1], core) if k < n - 1 else np.full(n, np.inf)  # no unknown edge of a row is lower
    part, tree, sides = np.arange(n), [], None
    while True:
        order = np.lexsort((high, low, w))
        low, high, w = low[order], high[order], w[order]
        while True:
            live = part[low] != part[high]
            low, high, w = low[live], high[live], w[live]
            names, size = np.unique(part, return_counts=True)
            if len(names) == 1:
                return tuple(np.concatenate(side) for side in zip(*tree, strict=True))
            best = np.full(n, len(w))
            np.minimum.at(best, part[low], np.arange(len(w)))
            np.minimum.at(best, part[high], np.arange(len(w)))
            height = np.append(w, np.inf)[best]
            unsure = np.zeros(n, bool)
            unsure[part[beyond < height[part]]] = True
            take = np.unique(best[names[~unsure[names]]])
            if not len(take):
                break
            tree.append((low[take], high[take], w[take]))
            root = np.arange(n)
            for a, b in zip(part[low[take]].tolist(), part[high[take]].tolist(), strict=True):
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
            while (root[root] != root).any():
                root = root[root]
            part = root[part]
        sides = sides or _sides(x)
        todo = np.flatnonzero((beyond < height[part]) & (part != names[size.argmax()]))
        found = _outside(x, *sides, core, part, todo[np.argsort(beyond[todo], kind="stable")], beyond, height)
        low, high, w = (np.concatenate(both) for both in zip((low, high, w), found, strict=True))


def _outside(x: np.ndarray, left: np.ndarray, right: np.ndarray, core: np.ndarray, part: np.ndarray, todo: np.ndarray, beyond: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lowest edge out of its part of each of the rows ``todo`` that may have one below its part's ``height``.

    Lowers ``height`` and raises ``beyond`` by what is found.
    """
    by = np.argsort(part, kind="stable")  # a part's rows stand side by side
    right, square, start = right[by], (core * core)[by], np.searchsorted(part[by], np.arange(len(x) + 1))
    step, at, out = max(1, min(BLOCK, 2 * MOST_CELLS // len(x))), 0, []
    while at < len(todo):
        ahead = todo[at : at + 16 * step]
        open_ = np.flatnonzero(beyond[ahead] < height[part[ahead]])[:step]
        at += int(open_[-1]) + 1 if len(open_) == step else len(ahead)
        rows = ahead[open_]
        if not len(rows):
            continue
        d = left[rows] @ right.T
        np.maximum(d, square, out=d)
        for i, p in enumerate(part[rows].tolist()):
            d[i, start[p] : start[p + 1]] = np.inf
        to = by[d.argmin(axis=1)]
        w = np.maximum(_gaps(x, rows, to), np.maximum(core[rows], core[to]))
        beyond[rows] = w
        np.minimum.at(height, part[rows], w)
        np.minimum.at(height, part[to], w)
        out.append((np.minimum(rows, to), np.maximum(rows, to), w))
    return tuple(np.concatenate(side) for side in zip(*out, strict=True))


def _walk(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float]]:
    """Prim's spanning tree of some edges, from the first row; of equals the first row, from whichever was there first."""
    ends, to, height = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
    order = np.argsort(ends, kind="stable")
    start = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    to, height = to[order].tolist(), height[order].tolist()
    heap: list[tuple[float, int, int, int]] = []
    taken, out, a = bytearray(n), [], 0
    while True:
        taken[a] = 1
        for e in range(start[a], start[a + 1]):
            if not taken[to[e]]:
                heapq.heappush(heap, (height[e], to[e], len(out), a))
        while heap and taken[heap[0][1]]:
            heapq.heappop(heap)
        if not heap:
            return out
        h, b, _, source = heapq.heappop(heap)
        out.append((source, b, h))
        a = b


def density_edges(x: np.ndarray, min_samples: int, metric: str = "euclidean", found: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, float]]:
    """The spanning tree of mutual reachability, as Prim's algorithm finds it from the first row.

    ``found`` are the ``near_rows`` of the ``distinct`` rows, ``near_depth`` of them or more, if they are known.
    """
    k = min(min_samples, len(x) - 1)
    if metric != "euclidean":
        d = Rows(x, metric)
        return spanning_tree(d, np.concatenate([np.partition(d[at], k, axis=1)[:, k].copy() for at in d.blocks()]))  # a view would keep its block
    first, kind, copies = distinct(x)
    kinds, every = x[first].astype(np.float64), np.arange(len(first))
    near, far = found or near_rows(kinds, every, near_depth(len(kinds), k))
    within = np.cumsum(np.column_stack([copies, copies[near]]), axis=1) > k
    core = np.column_stack([np.zeros(len(kinds)), far])[every, within.argmax(axis=1)]
    i, j, w = _joined(kinds, near, far, core) if len(kinds) > 1 else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    # edges as low as those of the tree: many rows join all that lie within their core distance at once; and copies
    a, c = np.nonzero((far <= core[:, None]) & (core[near] <= core[:, None]))
    more = np.flatnonzero(first[kind] != np.arange(len(x)))
    return _walk(len(x), np.concatenate([first[i], first[a], first[kind[more]]]), np.concatenate([first[j], first[near[a, c]], more]), np.concatenate([w, core[a], core[kind[more]]]))


def hdbscan(x: np.ndarray, min_cluster_size: int = MIN_CLUSTER_SIZE, min_samples: int | None = None, metric: str = "euclidean", method: str = "eom", epsilon: float = 0.0, edges: list | None = None) -> tuple[np.ndarray, float]:
    """Hierarchical density clusters and their relative validity (NaN if undefined).

    Mutual reachability, its spanning tree, the tree condensed to clusters of ``min_cluster_size``, and the selection of
    most stable clusters (eom) or of leaves; selected clusters born below ``epsilon`` give way to the ancestor above it.
    ``edges`` is the spanning tree, if it is known.
    """
    n = len(x)
    if n < max(2, min_cluster_size):
        return np.full(n, -1), math.nan
    edges = edges or density_edges(x, min_samples or min_cluster_size, metric)
    parent, node, size = list(range(n)), list(range(n)), [1] * n
    children: dict[int, tuple[int, int, float]] = {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b, h in sorted(edges, key=lambda e: e[2]):
        a, b = find(a), find(b)
        children[n + len(children)] = (node[a], node[b], h)
        parent[b] = a
        node[a] = n + len(children) - 1
        size.append(size[children[node[a]][0]] + size[children[node[a]][1]])
    top = n + len(children) - 1

    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += children[j][:2]
        return out

    birth, up, stable, points = {0: 0.0}, {0: None}, {0: 0.0}, {0: []}
    todo = [(top, 0)]
    while todo:
        i, c = todo.pop()
        if i < n:
            continue
        a, b, h = children[i]
        level = 1 / h if h > 0 else np.inf
        rich = [j for j in (a, b) if size[j] >= min_cluster_size]
        for j in (a, b):
            if len(rich) == 2:
                new = len(birth)
                birth[new], up[new], stable[new], points[new] = level, c, 0.0, []
                stable[c] += size[j] * (level - birth[c]) if np.isfinite(level) else 0.0
                todo.append((j, new))
            elif j in rich:
                todo.append((j, c))
            else:
                gone = leaves(j)
                points[c] += [(p, level) for p in gone]
                stable[c] += len(gone) * ((level if np.isfinite(level) else 1e12) - birth[c])
    below: dict[int, list[int]] = {c: [] for c in birth}
    for c, p in up.items():
        if p is not None:
            below[p].append(c)
    chosen: set[int] = set()
    value: dict[int, float] = {}
    for c in sorted(birth, reverse=True):
        inner = sum(value[j] for j in below[c])
        if not below[c]:
            value[c] = stable[c]
            chosen.add(c)
        elif method == "eom" and stable[c] > inner and c != 0:
            value[c] = stable[c]
            drop = list(below[c])
            while drop:
                j = drop.pop()
                chosen.discard(j)
                drop += below[j]
            chosen.add(c)
        else:
            value[c] = inner
    if 0 in chosen and len(birth) == 1:
        chosen.discard(0)
    if epsilon > 0:
        raised = set()
        for c in chosen:
            while up[c] not in (None, 0) and birth[c] > 1 / epsilon:
                c = up[c]
            raised.add(c)
        chosen = {c for c in raised if not any(a in raised for a in _ancestors(c, up))}
    labels = np.full(n, -1)
    for name, c in enumerate(sorted(chosen)):
        todo = [c]
        while todo:
            j = todo.pop()
            for p, _ in points[j]:
                labels[p] = name
            todo += below[j]
    return labels, relative_validity(labels, edges)


def _ancestors(c: int, up: dict[int, int | None]) -> list[int]:
    out = []
    while up[c] is not None:
        c = up[c]
        out.append(c)
    return out


def relative_validity(labels: np.ndarray, edges: list[tuple[int, int, float]]) -> float:
    """Density validity from a spanning tree: per cluster (separation - sparseness) / the larger, weighted by size."""
    names = [c for c in np.unique(labels) if c != -1]
    if len(names) < 2:
        return math.nan
    sparse, apart = dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
    for a, b, h in edges:
        x, y = labels[a], labels[b]
        if x == y and x != -1:
            sparse[x] = max(sparse[x], h)
        elif x != y:
            for c in (x, y):
                if c != -1:
                    apart[c] = min(apart[c], h)
    out = 0.0
    for c in names:
        most = max(apart[c], sparse[c])
        if np.isfinite(apart[c]) and most > 0:
            out += (labels == c).sum() / len(labels) * (apart[c] - sparse[c]) / most
    return float(out)


def tsne_neighbours(x: np.ndarray, mine: np.ndarray, perplexity: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """The nearest other rows of each of the rows ``mine``, and how likely it picks each at the perplexity.

    All other rows as long as no more than MOST_CELLS pairs arise; else as many as that allows, three times the perplexity
    and one at least, which is what Barnes-Hut t-SNE takes.
    """
    n = len(x)
    k, goal = min(n - 1, max(int(3 * perplexity + 1), MOST_CELLS // n)), math.log(min(perplexity, (n - 1) / 3))
    x = x - x.mean(axis=0)
    d, step = Rows(x), max(1, min(BLOCK, MOST_CELLS // n, 2 * MOST_CELLS // max(1, k * x.shape[1])))
    near, p = np.empty((len(mine), k), np.int32), np.empty((len(mine), k))
    for a in range(0, len(mine), step):
        rows = mine[a : a + step]
        far = d.rows(rows)
        far[np.arange(len(rows)), rows] = np.inf
        at = np.sort(np.argpartition(far, k - 1, axis=1)[:, :k], axis=1)
        gap = x[at] - x[rows][:, None, :]  # products err by the rows that meet them, and descent makes much of that
        far = np.einsum("ijk,ijk->ij", gap, gap)
        far -= far.min(axis=1, keepdims=True)
        low, high, beta, q = np.zeros((len(rows), 1)), np.full((len(rows), 1), np.inf), np.ones((len(rows), 1)), far
        for _ in range(60):
            q = np.exp(-far * beta)
            q /= q.sum(axis=1, keepdims=True)
            gap = -(q * np.log(q + 1e-300)).sum(axis=1, keepdims=True) - goal
            off = np.abs(gap) >= 1e-5
            if not off.any():
                break
            low, high = np.where(off & (gap > 0), beta, low), np.where(off & (gap <= 0), beta, high)
            with np.errstate(invalid="ignore"):
                beta = np.where(off, np.where(np.isinf(high), beta * 2, (low + high) / 2), beta)
        near[a : a + step], p[a : a + step] = at, q
    return near, p


def pulls(y: np.ndarray, near: np.ndarray, p: np.ndarray) -> np.ndarray:
    """t-SNE's attraction: over all edges, p times the near-weight times the gap, on one end and against it on the other."""
    n, k = near.shape
    at, out = [np.ascontiguousarray(c) for c in y.T], np.zeros(y.shape)
    step = max(1, (1 << 16) // k)  # what is computed of a block stays in cache
    for a in range(0, n, step):
        to = near[a : a + step]
        gaps = [c[a : a + step, None] - c[to] for c in at]
        w = p[a : a + step] / (1 + sum(g * g for g in gaps))
        for i, g in enumerate(gaps):
            g *= w
            out[a : a + step, i] += g.sum(axis=1)
            if len(to) * k < n:
                np.subtract.at(out[:, i], to.ravel(), g.ravel())
            else:
                out[:, i] -= np.bincount(to.ravel(), g.ravel(), n)
    return out


class Pushes:
    """t-SNE's repulsion of all pairs: the sums of squared near-weights times gaps, and of near-weights.

    Few rows meet in blocks. Many are spread over a grid by interpolation, NODES nodes an interval of at most one, fifty
    intervals at least; Fourier transforms convolve it with the forces, which are interpolated back.
    """

    NODES = 5

    def __init__(self):
        self.of, self.kernels = None, []

    def __call__(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        n, dims = y.shape
        if n * n <= MOST_CELLS or dims > 2:
            return self.pairs(y)
        force, total = self.grid(y if dims == 2 else np.column_stack([y, np.zeros(n)]))
        return force[:, :dims], total

    def pairs(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        force, total, step = np.empty(y.shape), 0.0, max(1, MOST_CELLS // len(y))
        for a in range(0, len(y), step):
            gaps = y[a : a + step, None, :] - y[None, :, :]
            w = 1 / (1 + (gaps * gaps).sum(axis=2))
            total += float(w.sum())
            force[a : a + step] = np.einsum("ij,ij,ijk->ik", w, w, gaps)
        return force, total - len(y)

    def grid(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        wide, n = np.ptp(y, axis=0), len(y)
        # sizes go in steps, so that the kernels serve many rounds
        h = min(1.0, 2.0 ** (math.ceil(4 * math.log2(max(wide.max(), 1e-30))) / 4) / 50)
        shape = tuple(self.NODES * _smooth(max(1, math.ceil(w / h))) for w in wide)
        if self.of != (h, shape):
            self.of, self.kernels = (h, shape), self.transforms(h, shape)
        places = (np.arange(self.NODES) + 0.5) / self.NODES
        low = y.min(axis=0) + wide / 2 - np.array(shape) / self.NODES * h / 2  # the grid's middle is that of the places
        cell, weights = np.empty((2, n), np.int64), []
        for i in range(2):
            t = (y[:, i] - low[i]) / h
            cell[i] = np.minimum(t.astype(np.int64), shape[i] // self.NODES - 1)
            t -= cell[i]
            weights.append([np.prod([(t - b) / (a - b) for b in places if b != a], axis=0) for a in places])
        first = self.NODES * (cell[0] * shape[1] + cell[1])
        nodes = [(first + a * shape[1] + b, weights[0][a] * weights[1][b]) for a in range(self.NODES) for b in range(self.NODES)]
        charge = sum(np.bincount(at, w, shape[0] * shape[1]) for at, w in nodes).astype(np.float32).reshape(shape)  # single width errs less than the grid
        twice = [2 * s for s in shape]
        spread = np.fft.rfft2(charge, twice)
        fields = [np.fft.irfft2(spread * kernel, twice)[: shape[0], : shape[1]].ravel() for kernel in self.kernels]
        found = [sum(w * field[at] for at, w in nodes) for field in fields]
        return np.column_stack(found[1:]), float(found[0].sum()) - n

    def transforms(self, h: float, shape: tuple[int, int]) -> list[np.ndarray]:
        gap = [np.where((k := np.arange(2 * s)) < s, k, k - 2 * s) * (h / self.NODES) for s in shape]
        u, v = gap[0][:, None], gap[1][None, :]
        w = 1 / (1 + u * u + v * v)
        return [np.fft.rfft2(k.astype(np.float32)) for k in (w, w * w * u, w * w * v)]


def _smooth(m: int) -> int:
    """The least of 1, 2, 4, 8 ... 64, 80, 100, 128, 160, 200 ... that is no less: transforms of small factors."""
    power = 1 << max(0, m - 1).bit_length()
    return next(s for s in ((power * 5 // 8, power * 25 // 32, power) if power > 64 else (power,)) if s >= m)


def tsne_descent(near: np.ndarray, p: np.ndarray, dims: int = 2, rounds: int = 500, seed: int = 42) -> np.ndarray:
    """The places that gradient descent finds for the edges of ``tsne_neighbours`` over all rows."""
    n = len(near)
    near, p, push = near.astype(np.int64), p / (2 * n), Pushes()
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, dims))
    step, rate = np.zeros_like(y), max(n / 48, 50.0)
    for t in range(rounds):
        force, total = push(y)
        grad = 4 * ((12.0 if t < 250 else 1.0) * pulls(y, near, p) - force / total)
        step = (0.5 if t < 250 else 0.8) * step - rate * grad
        y = y + step
        y -= y.mean(axis=0)
    return y


def tsne(x: np.ndarray, dims: int = 2, perplexity: float = 30.0, rounds: int = 500, seed: int = 42) -> np.ndarray:
    """t-SNE of a group: attraction of near rows, repulsion of all; no square of distances is held."""
    if len(x) < 3:
        return np.zeros((len(x), dims))
    return tsne_descent(*tsne_neighbours(x, np.arange(len(x)), perplexity), dims, rounds, seed)


def cluster_groups(df: DataFrame, by: list[str], method: str, **options) -> DataFrame:
    """(by, key, cluster) of every group of ``by``, groups in parallel; ``df`` has key and vector.

    Methods: agglomerative, ward (k by silhouette), meanshift, hdbscan.
    """
    if method not in ("agglomerative", "ward", "meanshift", "hdbscan"):
        raise ClusteringError(f"unknown method {method}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        x = _matrix(pdf)
        if method == "agglomerative":
            labels = agglomerative(x, **options)
        elif method == "ward":
            labels = ward_by_silhouette(x, **options)[0]
        elif method == "meanshift":
            labels = mean_shift(x, **options)
        else:
            labels = hdbscan(x, **options)[0]
        return pdf[[*by, "key"]].assign(cluster=labels.astype("int32"))

    schema = df.select(*by, "key").schema.add("cluster", "integer")
    return df.select(*by, "key", "vector").groupBy(*by).applyInPandas(run, schema)


def cluster(df: DataFrame, method: str, **options) -> DataFrame:
    """(key, cluster) of all rows as one group."""
    from pyspark.sql import functions as F

    if method == "meanshift":
        return mean_shift_dealt(df, **options)
    return cluster_groups(df.withColumn("_g", F.lit(0)), ["_g"], method, **options).drop("_g")
