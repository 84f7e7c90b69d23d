"""Clusters of one event: tracks, blobs, noise adoption, tracks across TPCs, vertices, showers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tickloom.functions import numeric as N
from tickloom.operators.components import dimensionality


@dataclass
class Labels:
    """``label`` per hit (-1 noise); ids below ``backbone`` are tracks or showers of the backbone; ``kind`` by label."""

    label: np.ndarray
    backbone: int
    kind: dict[int, str] = field(default_factory=dict)


def blobs(p: np.ndarray, e: np.ndarray, label: np.ndarray, eps: float, least: int, by_energy: bool = True) -> np.ndarray:
    """Density clusters of the unlabelled hits, numbered after the labels there are, the most energetic first."""
    out = label.copy()
    free = np.nonzero(label < 0)[0]
    found = N.dbscan_labels(p[free], eps, least)
    first = out.max(initial=-1) + 1
    ids = np.arange(found.max(initial=-1) + 1)
    if by_energy and len(ids):
        energy = np.bincount(found[found >= 0], weights=e[free][found >= 0], minlength=len(ids))
        rank = np.empty(len(ids), int)
        rank[np.lexsort((ids, -energy))] = ids
        found = np.where(found >= 0, rank[np.maximum(found, 0)], -1)
    out[free] = np.where(found >= 0, found + first, -1)
    return out


def noise_list(p: np.ndarray, label: np.ndarray, reach: float = 40.0, expand: float = 1.2) -> list[tuple[float, int, int]]:
    """(distance, noise hit, cluster): the nearest cluster of each noise hit, and others almost as near; sorted by distance."""
    at, of, dist = N.nearest_labels(p, label < 0, label, reach, expand)
    order = np.lexsort((of, at, dist))
    return list(zip(dist[order].tolist(), at[order].tolist(), of[order].tolist()))


def adopt_noise(label: np.ndarray, candidates: list[tuple[float, int, int]], first: int, share: float = 0.20) -> np.ndarray:
    """Each cluster from id ``first`` on, in the order of ids, takes up to ``share`` of its size of noise hits still free, nearest first."""
    out = label.copy()
    near: dict[int, list[int]] = {}
    for _, hit, cluster in candidates:
        near.setdefault(cluster, []).append(hit)
    for c in range(first, label.max(initial=-1) + 1):
        room = int((label == c).sum() * share) if c in near else 0
        for hit in near.get(c, ()):
            if room <= 0:
                break
            if out[hit] == -1:
                out[hit] = c
                room -= 1
    return out


def labels_2x2(p: np.ndarray, e: np.ndarray, reach: float = 1.1, min_length: float = 40.0, eps: float = 2.5, least: int = 3, iters: int = 400, seed: int = 0) -> Labels:
    tracks = N.fit_track_labels(p, reach, iters=iters, min_length=min_length, seed=seed)
    n = tracks.max(initial=-1) + 1
    return Labels(blobs(p, e, tracks, eps, least), n, dict.fromkeys(range(n), "track"))


@dataclass
class Segment:
    tpc: int
    hits: np.ndarray
    p: np.ndarray
    q: np.ndarray
    linearity: float


def _segment(p: np.ndarray, tpc: int, hits: np.ndarray) -> Segment:
    c, u, ev = N.principal(p[hits])
    t = (p[hits] - c) @ u
    return Segment(tpc, hits, c + t.min() * u, c + t.max() * u, float(ev[0] / max(ev.sum(), 1e-12)))


def tpc_segments(p: np.ndarray, tpc: np.ndarray, reach: float = 1.2, split: float = 4.0, least: int = 20, eps: float = 4.0, rescue_hits: int = 15, rescue_length: float = 20.0, rescue_linearity: float = 0.88, rescue_width: float = 5.0, iters: int = 400, min_length: float = 30.0, seed: int = 0) -> list[Segment]:
    """Lines of each TPC: RANSAC tracks split into connected parts, and line-like density clusters of the rest."""
    out = []
    for t in np.unique(tpc[tpc >= 0]):
        at = np.nonzero(tpc == t)[0]
        label = N.fit_track_labels(p[at], reach, iters=iters, min_length=min_length, seed=seed)
        used = np.zeros(len(at), bool)
        for c in np.unique(label[label >= 0]):
            mine = np.nonzero(label == c)[0]
            part = N.radius_components(p[at[mine]], split)
            for k in range(part.max() + 1):
                some = mine[part == k]
                if len(some) >= least:
                    out.append(_segment(p, int(t), at[some]))
                    used[some] = True
        free = np.nonzero(~used)[0]
        rest = N.dbscan_labels(p[at[free]], eps, 3)
        for k in range(rest.max(initial=-1) + 1):
            some = at[free[rest == k]]
            if len(some) < rescue_hits:
                continue
            c, u, ev = N.principal(p[some])
            length = np.ptp((p[some] - c) @ u)
            if length >= rescue_length and ev[0] / max(ev.sum(), 1e-12) >= rescue_linearity and np.sqrt(ev[1] + ev[2]) <= rescue_width:
                out.append(_segment(p, int(t), some))
    return out


def join_segments(segments: list[Segment], dist: float = 5.0, angle: float = 12.0, ends: float = 40.0) -> np.ndarray:
    """Track number of each segment: segments of different TPCs whose match is the best for both of its ends."""
    n = len(segments)
    edges = []
    ends_of = np.array([(s.p, s.q) for s in segments]).reshape(n, 2, 3)
    way = ends_of[:, 1] - ends_of[:, 0]
    size, of = np.linalg.norm(way, axis=1), np.array([s.tpc for s in segments], int)
    for i in range(n):
        a, u = segments[i], way[i]
        # with some room: what is left is measured below
        cos = np.abs(way[i + 1 :] @ u) / np.maximum(size[i] * size[i + 1 :], 1e-12)
        gap = np.linalg.norm(ends_of[i][:, None, None] - ends_of[None, i + 1 :], axis=-1).min(axis=(0, 2))
        for j in (i + 1 + np.nonzero((of[i + 1 :] != a.tpc) & (cos >= np.cos(np.radians(angle)) - 1e-6) & (gap <= ends + 1e-6))[0]).tolist():
            b, v = segments[j], way[j]
            cos = abs(u @ v) / max(np.linalg.norm(u) * np.linalg.norm(v), 1e-12)
            g = np.degrees(np.arccos(min(1.0, cos)))
            if g > angle:
                continue
            gaps = [(np.linalg.norm(x - y), k, m) for k, x in enumerate((a.p, a.q)) for m, y in enumerate((b.p, b.q))]
            e, k, m = min(gaps)
            d = min(N.line_line(a.p, u, b.p, v), e)
            if d > dist or e > ends:
                continue
            edges.append((d / dist + 0.45 * e / ends + 0.35 * g / angle - 0.15 * min(a.linearity, b.linearity), i, k, j, m))
    best: dict[tuple[int, int], tuple] = {}
    for edge in sorted(edges):
        _, i, k, j, m = edge
        best.setdefault((i, k), edge)
        best.setdefault((j, m), edge)
    kept = [x for x in edges if best[(x[1], x[2])] is x and best[(x[3], x[4])] is x]
    a, b = np.array([x[1] for x in kept], int), np.array([x[3] for x in kept], int)
    return N.numbered(N.components(n, a, b)) if n else np.zeros(0, int)


def absorb_into_tracks(p: np.ndarray, tpc: np.ndarray, owner: np.ndarray, noise: np.ndarray, scale: float = 1.5, least_radius: float = 1.2, margin: float = 4.0) -> np.ndarray:
    """Noise hits close to a track's line in their TPC join the one of smallest distance over radius."""
    out = owner.copy()
    best = np.full(len(p), np.inf)
    order = np.argsort(tpc, kind="stable")
    own = {int(tpc[some[0]]): some for some in np.split(order, np.nonzero(np.diff(tpc[order]))[0] + 1) if len(some)}
    lost = {t: some[noise[some]] for t, some in own.items()}
    for t, k in {(int(a), int(b)) for a, b in zip(tpc, owner) if b >= 0}:
        mine = own[t][owner[own[t]] == k]
        if len(mine) < 3:
            continue
        c, u, _ = N.principal(p[mine])
        radius = scale * max(least_radius, np.percentile(N.line_gap(p[mine], c, u), 90))
        along = (p[mine] - c) @ u
        at = lost[t]
        s, gap = (p[at] - c) @ u, N.line_gap(p[at], c, u)
        ok = (gap <= radius) & (s >= along.min() - margin) & (s <= along.max() + margin) & (gap / radius < best[at])
        out[at[ok]], best[at[ok]] = k, gap[ok] / radius
    return out


def vertex_groups(ends: np.ndarray, line: np.ndarray, eps: float = 10.0, least: int = 3, most_distance: float = 4.0, how: str = "ends") -> np.ndarray:
    """Group of each track. ``ends`` is (tracks, 2, 3), ``line`` the directions.

    ``ends``: density clusters of track ends; ``nhc``: graph of tracks that pass each other closely
    near an end; ``hca``: complete linkage of the closest approaches; ``dvfs``: single linkage of
    the midpoints between passing tracks; ``spectral``: groups of the affinity of approaches.
    """
    n = len(ends)
    if n == 0:
        return np.zeros(0, int)
    if how not in ("nhc", "hca", "dvfs", "spectral"):
        return _by_ends(ends, line, eps, least, most_distance)
    dca = np.array([[0.0 if i == j else N.line_line(ends[i, 0], line[i], ends[j, 0], line[j]) for j in range(n)] for i in range(n)])
    close = np.array([[min(np.linalg.norm(a - b) for a in ends[i] for b in ends[j]) if i != j else 0.0 for j in range(n)] for i in range(n)])
    if how == "nhc":
        i, j = np.nonzero(np.triu((dca <= most_distance) & (close <= eps), 1))
        return N.numbered(N.components(n, i, j))
    if how == "hca":
        return N.linkage(np.maximum(dca, close / max(eps, 1e-9) * most_distance), most_distance, True)
    if how == "dvfs":
        return N.linkage(np.where(dca <= most_distance, close, np.inf), eps, False)
    a = np.exp(-(close / eps) ** 2 / 2) * (dca <= most_distance)
    np.fill_diagonal(a, 1.0)
    return N.spectral_groups(a, max(1, n - 1))


def _by_ends(ends: np.ndarray, line: np.ndarray, eps: float, least: int, most_distance: float) -> np.ndarray:
    """``vertex_groups`` of track ends; only tracks of one density cluster are compared."""
    n = len(ends)
    lab = N.dbscan_labels(ends.reshape(-1, 3), eps, least)
    group = np.full(n, -1)
    no = 0
    for c in range(lab.max(initial=-1) + 1):
        ids = np.unique(np.nonzero(lab == c)[0] // 2)
        if len(ids) >= 2 and np.median([N.line_line(ends[a, 0], line[a], ends[b, 0], line[b]) for x, a in enumerate(ids) for b in ids[x + 1 :]]) <= most_distance:
            free = ids[group[ids] < 0]
            group[free] = no
            no += 1
    for i in np.nonzero(group < 0)[0]:
        group[i] = no
        no += 1
    return N.numbered(group)


def labels_nd(p: np.ndarray, e: np.ndarray, tpc: np.ndarray, eps: float = 4.0, least: int = 3, shower_tracks: int = 3, how: str = "ends", iters: int = 400, seed: int = 0, reach: float = 1.2) -> Labels:
    """Segments joined to tracks, leftover clusters, noise absorbed, tracks grouped at vertices (a shower from three on)."""
    seg = tpc_segments(p, tpc, reach, iters=iters, seed=seed)
    track = join_segments(seg)
    owner = np.full(len(p), -1)
    for s, k in zip(seg, track):
        owner[s.hits] = k
    left = np.nonzero(owner < 0)[0]
    rest = N.dbscan_labels(p[left], eps, least)
    noise = np.zeros(len(p), bool)
    noise[left[rest < 0]] = True
    owner = absorb_into_tracks(p, tpc, owner, noise)
    n = int(track.max(initial=-1)) + 1
    ends, line = np.zeros((n, 2, 3)), np.zeros((n, 3))
    order = np.argsort(owner, kind="stable")
    upto = np.searchsorted(owner[order], np.arange(n + 1))
    for k in range(n):
        at = order[upto[k] : upto[k + 1]]
        c, u, _ = N.principal(p[at])
        t = (p[at] - c) @ u
        ends[k], line[k] = (c + t.min() * u, c + t.max() * u), u
    group = vertex_groups(ends, line, how=how)
    label = np.full(len(p), -1)
    label[owner >= 0] = group[owner[owner >= 0]] if n else -1
    backbone = int(group.max(initial=-1)) + 1
    kind = {g: "shower" if (group == g).sum() >= shower_tracks else "track" if (group == g).sum() == 1 else "vertex" for g in range(backbone)}
    free = left[rest >= 0]
    label[free] = np.where(label[free] < 0, rest[rest >= 0] + backbone, label[free])
    return Labels(label, backbone, kind)


def split_mixed(p: np.ndarray, label: np.ndarray, targets: list[int], most: int = 4, seed: int = 0) -> np.ndarray:
    """Target clusters replaced by the components of their best Gaussian mixture; the first keeps the id."""
    out = label.copy()
    top = label.max(initial=-1) + 1
    for c in targets:
        at = np.nonzero(label == c)[0]
        if len(at) < 8:
            continue
        part = N.gmm_split(p[at], most, seed)
        for k in range(1, part.max() + 1):
            out[at[part == k]] = top
            top += 1
    return out


def microfragments(p: np.ndarray, e: np.ndarray, eps: float = 2.5, least: int = 3, most: int = 40) -> np.ndarray:
    """Density clusters, those of more than ``most`` hits cut in two at their middle until small or round."""
    label = N.dbscan_labels(p, eps, least)
    todo = list(range(label.max(initial=-1) + 1))
    top = len(todo)
    while todo:
        c = todo.pop()
        at = np.nonzero(label == c)[0]
        if len(at) <= most or dimensionality(p[at])[0] < 0.3:
            continue
        centre, u, _ = N.principal(p[at], e[at])
        far = (p[at] - centre) @ u > 0
        if far.all() or not far.any():
            continue
        label[at[far]] = top
        todo += [c, top]
        top += 1
    return label


def shower_tpcs(label: np.ndarray, kind: dict[int, str], tpc: np.ndarray, e: np.ndarray, least_hits: int = 1, least_energy: float = 0.0) -> list[int]:
    """TPCs that hold enough hits and energy of shower-like labels."""
    shower = np.array([any(w in kind.get(int(c), "").lower() for w in ("shower", "vertex")) for c in label])
    return sorted(int(t) for t in np.unique(tpc[shower]) if (shower & (tpc == t)).sum() >= least_hits and e[shower & (tpc == t)].sum() >= least_energy)


def long_tracks(label: np.ndarray, kind: dict[int, str], tpc: np.ndarray, least_tpcs: int = 3) -> np.ndarray:
    """Hits of labels that are tracks, not showers, and span at least max(least_tpcs, 3) TPCs."""
    out = np.zeros(len(label), bool)
    for c, k in kind.items():
        at = label == c
        if "track" in k.lower() and "shower" not in k.lower() and len(np.unique(tpc[at])) >= max(least_tpcs, 3):
            out |= at
    return out


def capacity(kind: str, energy: float, share: float = 0.20, shower_most: int = 50, huge_energy: float = 50.0, huge_most: int = 20) -> int:
    """Hits that a cluster may still absorb: none for tracks, fewer than its energy's share for the rest."""
    if "track" in kind:
        return 0
    n = int(np.floor(share * energy))
    if kind in ("shower", "vertex"):
        return min(shower_most, n)
    return min(huge_most, n) if energy > huge_energy else n
