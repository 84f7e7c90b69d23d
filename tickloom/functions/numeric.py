"""NumPy kernels for work inside one event: neighbours, components, density clusters, lines, peaks."""

from __future__ import annotations

import itertools

import numpy as np


# ---------------------------------------------------------------- neighbours and components
def radius_pairs(p: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of points at most ``r`` apart, found through grid cells of side ``r``.

    Cells are visited one neighbour offset at a time over all points at once.
    """
    n = len(p)
    if n < 2 or r <= 0:
        return np.zeros(0, int), np.zeros(0, int)
    if n <= FEW:
        return np.nonzero(np.triu(sum((p[:, k, None] - p[:, k]) ** 2 for k in range(p.shape[1])) <= r * r, 1))
    d = p.shape[1]
    cell = np.floor((p - p.min(0)) / r).astype(np.int64) + 1
    size = cell.max(0) + 2
    step = np.concatenate([np.cumprod(size[::-1])[::-1][1:], [1]])
    code = cell @ step
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    ii, jj = [], []
    for offset in np.ndindex(*(3,) * d):
        shift = (np.array(offset) - 1) @ step
        if shift < 0:
            continue
        lo = np.searchsorted(sorted_code, code + shift, side="left")
        hi = np.searchsorted(sorted_code, code + shift, side="right")
        count = hi - lo
        for a in range(0, n, 20_000):  # bounded memory in crowded places
            c = count[a : a + 20_000]
            i = np.repeat(np.arange(a, a + len(c)), c)
            k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[a : a + 20_000], c)
            j = order[k]
            near = ((p[i] - p[j]) ** 2).sum(1) <= r * r
            keep = near & ((i < j) if shift == 0 else (i != j))
            ii.append(np.minimum(i[keep], j[keep]))
            jj.append(np.maximum(i[keep], j[keep]))
    return np.concatenate(ii), np.concatenate(jj)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components of a graph as the smallest member of each, by pointer jumping over all edges at once."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def numbered(root: np.ndarray) -> np.ndarray:
    """Components renumbered 0, 1, .. by their smallest member."""
    return np.unique(root, return_inverse=True)[1]


def _squeezed(c: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Cell numbers with empty stretches shortened, and groups set apart, so that codes made of them stay small and neighbours stay neighbours."""
    order = np.argsort(c, kind="stable") if group is None else np.lexsort((c, group))
    step = np.minimum(np.diff(c[order], prepend=c[order[:1]]), 4)
    if group is not None:
        step[1:][np.diff(group[order]) != 0] = 4
    out = np.empty(len(c), np.int64)
    out[order] = np.cumsum(step)
    return out


class Grid:
    """Points of each group in cells. Sorted by cell (and ``label``): ``order``; per cell its ``start``, ``count`` and the box of its points."""

    def __init__(self, p: np.ndarray, side: float, reach: int, group: np.ndarray | None = None, label: np.ndarray | None = None) -> None:
        d = p.shape[1]
        at = np.stack([_squeezed(np.floor(p[:, k] / side).astype(np.int64), group if k == 0 else None) for k in range(d)], 1) + reach
        size = at.max(0) + reach + 1
        self.step = np.concatenate([np.cumprod(size[::-1])[::-1][1:], [1]]).astype(np.int64)
        code = at @ self.step
        self.order = np.argsort(code, kind="stable") if label is None else np.lexsort((label, code))
        self.p = p[self.order]
        code = code[self.order]
        self.start = np.nonzero(np.diff(code, prepend=code[0] - 1))[0]
        self.code = code[self.start]
        self.count = np.diff(self.start, append=len(code))
        self.cell = np.repeat(np.arange(len(self.code)), self.count)
        self.low, self.high = (f.reduceat(self.p, self.start, axis=0) for f in (np.minimum, np.maximum))
        near = [o for o in itertools.product(range(-reach, reach + 1), repeat=d) if any(o)]
        self.offsets = sorted(near, key=lambda o: (sum(x * x for x in o), o))

    def neighbours(self, cells: np.ndarray, offset: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``cells`` that have an occupied cell at ``offset``, as positions in ``cells``, and that cell."""
        want = self.code[cells] + np.asarray(offset) @ self.step
        at = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
        ok = np.nonzero(self.code[at] == want)[0]
        return ok, at[ok]

    def pairs(self, a: np.ndarray, cell: np.ndarray, r: float | np.ndarray, block: int = 1_000_000):
        """Blocks ``k, b``: point ``a[k]`` and point ``b`` of the cell ``cell[k]``; cells whose box is further than ``r`` (of each point, if an array) are left out."""
        if not len(a):
            return
        gap = np.maximum(np.maximum(self.low[cell] - self.p[a], self.p[a] - self.high[cell]), 0)
        some = np.nonzero((gap * gap).sum(1) <= r * r * 1.000001)[0]
        total = np.cumsum(self.count[cell[some]])
        i = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + block, side="right")))
            c = self.count[cell[some[i:j]]]
            k = np.repeat(some[i:j], c)
            yield k, np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.start[cell[some[i:j]]], c)
            i = j

    def points(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All points of ``cells``, and the position in ``cells`` that each belongs to."""
        c = self.count[cells]
        k = np.repeat(np.arange(len(cells)), c)
        return np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.start[cells], c), k


def apart(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for k in range(p.shape[1]):
        out += (p[a, k] - p[b, k]) ** 2
    return np.sqrt(out)


#: Points up to which all are compared with all: of so few the cells cost more than the distances.
FEW = 256


def _between(p: np.ndarray, q: np.ndarray, group: np.ndarray | None = None, other: np.ndarray | None = None) -> np.ndarray:
    """Distances of a few points, summed as in ``apart``; infinite between groups."""
    d = np.zeros((len(p), len(q)))
    for k in range(p.shape[1]):
        d += (p[:, k, None] - q[:, k]) ** 2
    d = np.sqrt(d)
    if group is not None:
        d[group[:, None] != other] = np.inf
    return d


def _fine(p: np.ndarray, r: float, group: np.ndarray | None, label: np.ndarray | None = None) -> Grid:
    """Cells so small that all points of one are within ``r`` of each other."""
    d = p.shape[1]
    return Grid(p, 0.999 * r / d**0.5, int(np.ceil(d**0.5 / 0.999)), group, label)


def grid_components(p: np.ndarray, r: float, group: np.ndarray | None = None) -> np.ndarray:
    """For each point a number of its component: points of one group linked by steps of at most ``r``.

    Points of one cell are linked anyway, so cells are joined, not points: first where their first
    points are near, then point by point where cells are still apart. No list of pairs is kept.
    """
    n = len(p)
    if n < 2 or r <= 0:
        return np.arange(n)
    if n <= FEW:
        a, b = np.nonzero(np.triu(_between(p, p, group, group) <= r, 1))
        return components(n, a, b)
    g = _fine(p, r, group)
    root, cells = np.arange(len(g.code)), np.arange(len(g.code))
    half = [o for o in g.offsets if o > (0,) * p.shape[1]]
    for full in (False, True):
        for o in half:
            i, j = g.neighbours(cells, o)
            new = root[i] != root[j]
            i, j = i[new], j[new]
            if full:
                linked = np.zeros(len(i), bool)
                a, k = g.points(i)
                for m, b in g.pairs(a, j[k], r):
                    m, b = m[open_ := ~linked[k[m]]], b[open_]
                    linked[k[m[apart(g.p, a[m], b) <= r]]] = True
            else:
                linked = apart(g.p, g.start[i], g.start[j]) <= r
            if linked.any():
                root = components(len(root), root[i[linked]], root[j[linked]])[root]
    out = np.empty(n, np.int64)
    out[g.order] = root[g.cell]
    return out


def near_pairs(p: np.ndarray, r: float, group: np.ndarray, v: np.ndarray, least: float):
    """Blocks of index pairs of a group's points at most ``r`` apart whose ``v`` differ by more than ``least``; each pair once.

    Cells that hold no such value are left out, so that crowded places of one value cost little.
    """
    if len(p) < 2 or r <= 0:
        return
    if len(p) <= FEW:
        i, j = radius_pairs(p, r)
        ok = (group[i] == group[j]) & (np.abs(v[i] - v[j]) > least)
        yield i[ok], j[ok]
        return
    g = Grid(p, r * 1.000001, 1, group)
    w, of = v[g.order], group[g.order]
    low, high = (f.reduceat(w, g.start) for f in (np.minimum, np.maximum))
    zero = (0,) * p.shape[1]
    for o in [zero, *(o for o in g.offsets if o > zero)]:
        a, cell = g.neighbours(g.cell, o)
        ok = (high[cell] - w[a] > least) | (w[a] - low[cell] > least)
        a, cell = a[ok], cell[ok]
        for m, b in g.pairs(a, cell, r):
            m = a[m]
            ok = (of[m] == of[b]) & (np.abs(w[m] - w[b]) > least)
            if o == zero:
                ok &= m < b
            m, b = m[ok], b[ok]
            ok = ((g.p[m] - g.p[b]) ** 2).sum(1) <= r * r
            yield g.order[m[ok]], g.order[b[ok]]


def core_points(p: np.ndarray, eps: float, least: int, group: np.ndarray | None = None) -> np.ndarray:
    """Points with at least ``least`` points of their group within ``eps``, themselves counted; counting stops there."""
    n = len(p)
    if not n or eps <= 0:
        return np.full(n, least <= 1)
    if n <= FEW:
        return (_between(p, p, group, group) <= eps).sum(1) >= least
    g = _fine(p, eps, group)
    seen = g.count[g.cell]
    for o in g.offsets:
        a = np.nonzero(seen < least)[0]
        if not len(a):
            break
        k, cell = g.neighbours(g.cell[a], o)
        a = a[k]
        for m, b in g.pairs(a, cell, eps):
            near = a[m[apart(g.p, a[m], b) <= eps]]
            seen += np.bincount(near, minlength=n)
    out = np.empty(n, bool)
    out[g.order] = seen >= least
    return out


def dbscan_links(p: np.ndarray, eps: float, least: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Core mask, component number of each core point (-1 for others), and pairs of a border point and the component of a core point within ``eps``."""
    n = len(p)
    core = core_points(p, eps, least, group)
    part = np.full(n, -1)
    part[core] = grid_components(p[core], eps, None if group is None else group[core])
    found = []
    if n <= FEW and eps > 0:
        a, b = np.nonzero(~core)[0], np.nonzero(core)[0]
        i, j = np.nonzero(_between(p[a], p[b], *((None, None) if group is None else (group[a], group[b]))) <= eps)
        found.append(np.stack([a[i], part[b[j]]], 1))
    elif n and eps > 0 and core.any() and not core.all():
        g = _fine(p, eps, group)
        inner, comp = core[g.order], part[g.order]
        for o in [(0,) * p.shape[1], *g.offsets]:
            a = np.nonzero(~inner)[0]
            k, cell = g.neighbours(g.cell[a], o)
            a = a[k]
            for m, b in g.pairs(a, cell, eps):
                ok = inner[b]
                m, b = m[ok], b[ok]
                ok = apart(g.p, a[m], b) <= eps
                found.append(np.unique(np.stack([g.order[a[m[ok]]], comp[b[ok]]], 1), axis=0))
    at = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), int)
    return core, part, at[:, 0], at[:, 1]


def linked_labels(p: np.ndarray, label: np.ndarray, r: float, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``group, a, b`` with a < b: labels of a group that have points at most ``r`` apart, each pair once.

    In groups of many points pairs of labels known to be linked are not looked at again, and others
    are sought from the points of the rarer label; where a group is small, or its labels are so many
    that a table of their pairs would be large, points are compared with all near them.
    """
    none = np.zeros(0, np.int64)
    if len(p) < 2 or r <= 0:
        return none, none, none
    group = np.zeros(len(p), np.int64) if group is None else group
    if len(p) <= FEW:
        i, j = np.nonzero((_between(p, p, group, group) <= r) & (label[:, None] < label))
        if not len(i):
            return group[:0], label[:0], label[:0]
        order = np.lexsort((label[j], label[i], group[i]))
        i, j = i[order], j[order]
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(group[i]) != 0) | (np.diff(label[i]) != 0) | (np.diff(label[j]) != 0)
        return group[i[new]], label[i[new]], label[j[new]]
    _, gno, n = np.unique(group, return_inverse=True, return_counts=True)
    _, lno = np.unique(label, return_inverse=True)
    many = np.bincount(np.unique(gno.astype(np.int64) * (lno.max() + 1) + lno) // (lno.max() + 1)).astype(np.int64)
    batch = np.full(len(n), -1)
    table = (n > SMALL) & (many**2 <= PAIRS)
    batch[table] = np.cumsum(many[table] ** 2) // PAIRS
    batch = batch[gno]
    found = []
    for i in np.unique(batch):
        rows = np.nonzero(batch == i)[0]
        found.append((_every_link if i < 0 else _table_links)(p[rows], label[rows], r, group[rows]))
    of, a, b = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a, of))
    return of[order], a[order], b[order]


#: Points of a group up to which their pairs are fewer than what is spared by knowing linked labels.
SMALL = 2_000
#: Pairs of labels that are held as a table at once.
PAIRS = 25_000_000


def _every_link(p: np.ndarray, label: np.ndarray, r: float, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``linked_labels`` from all pairs of near points, taken in blocks; only linked labels are kept."""
    names, lno = np.unique(label, return_inverse=True)
    groups, gno = np.unique(group, return_inverse=True)
    g = Grid(p, r * 1.000001, 1, group)
    lab, grp, most = lno[g.order].astype(np.int64), gno[g.order].astype(np.int64), len(names)
    found, held = [np.zeros(0, np.int64)], 0
    zero = (0,) * p.shape[1]
    for o in [zero, *(o for o in g.offsets if o > zero)]:
        a, cell = g.neighbours(g.cell, o)
        for m, b in g.pairs(a, cell, r):
            m = a[m]
            new = lab[m] != lab[b]
            m, b = m[new], b[new]
            ok = apart(g.p, m, b) <= r
            m, b = m[ok], b[ok]
            found.append(np.unique((grp[m] * most + np.minimum(lab[m], lab[b])) * most + np.maximum(lab[m], lab[b])))
            held += len(found[-1])
            if held > 1_000_000:
                found, held = [np.unique(np.concatenate(found))], 0
    code = np.unique(np.concatenate(found))
    return groups[code // most // most], names[code // most % most], names[code % most]


def _table_links(p: np.ndarray, label: np.ndarray, r: float, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``linked_labels`` with a table of the pairs of labels known to be linked."""
    _, gno = np.unique(group, return_inverse=True)
    _, lno = np.unique(label, return_inverse=True)
    ids, item = np.unique(gno.astype(np.int64) * (lno.max() + 1) + lno, return_inverse=True)
    first = np.zeros(len(ids), np.int64)
    first[item] = np.arange(len(p))  # a point of each item
    igroup = gno[first]
    base = np.searchsorted(igroup, np.arange(igroup.max() + 1))
    many = np.diff(base, append=len(ids))
    offset = np.concatenate([[0], np.cumsum(many.astype(np.int64) ** 2)])
    # a cell of the table for each two labels of a group
    local = np.arange(len(ids)) - base[igroup]
    size = np.bincount(item)
    known = np.zeros(offset[-1], bool)
    row = offset[igroup] + local * many[igroup]
    known[row + local] = True

    def learn(u: np.ndarray, v: np.ndarray) -> None:
        known[row[u] + local[v]] = True
        known[row[v] + local[u]] = True

    g = _fine(p, r, group, item)
    it = item[g.order]
    # labels of one cell
    head = np.nonzero((np.diff(g.cell, prepend=-1) != 0) | (np.diff(it, prepend=-1) != 0))[0]
    hcell, hitem = g.cell[head], it[head]
    n_in = np.bincount(hcell, minlength=len(g.code))
    at = np.concatenate([[0], np.cumsum(n_in)])
    for i in range(0, len(head), 200_000):
        left = at[hcell[i : i + 200_000] + 1] - np.arange(i, min(i + 200_000, len(head))) - 1
        u = np.repeat(np.arange(i, i + len(left)), left)
        v = u + 1 + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
        learn(hitem[u], hitem[v])
    # of a pair of labels the rarer one seeks
    order = np.lexsort((np.arange(len(ids)), size))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    for o in g.offsets:
        seeks = _seekers(known, row, many, base, igroup, rank)
        a = np.nonzero(seeks[it])[0]
        if not len(a):
            break
        k, cell = g.neighbours(g.cell[a], o)
        a = a[k]
        for m, b in g.pairs(a, cell, r):
            u, v = it[a[m]], it[b]
            new = ~known[row[u] + local[v]]
            m, b, u, v = m[new], b[new], u[new], v[new]
            ok = apart(g.p, a[m], b) <= r
            learn(u[ok], v[ok])
    known[row + local] = False
    flat = np.nonzero(known)[0]
    u = np.searchsorted(row, flat, side="right") - 1
    v = base[igroup[u]] + flat - row[u]
    ok = label[first[u]] < label[first[v]]
    return group[first[u[ok]]], label[first[u[ok]]], label[first[v[ok]]]


def _seekers(known: np.ndarray, row: np.ndarray, many: np.ndarray, base: np.ndarray, igroup: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Labels that are the rarer one of some pair not known to be linked."""
    out = np.zeros(len(row), bool)
    for i in range(0, len(known), 1_000_000):
        flat = i + np.nonzero(~known[i : i + 1_000_000])[0]
        u = np.searchsorted(row, flat, side="right") - 1
        v = base[igroup[u]] + flat - row[u]
        out[u[rank[u] < rank[v]]] = True
    return out


def nearest_labels(p: np.ndarray, lost: np.ndarray, label: np.ndarray, reach: float, expand: float, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``point, label, distance`` for the points of ``lost`` (a mask) that have another within ``reach``: the labels not further than ``expand`` times the nearest.

    Cells grow until the nearest point and that multiple lie within one side; points that have found
    theirs drop out, so that crowded places are searched in small cells and empty ones in large. Only
    points beside those still sought are put in cells.
    """
    group = np.zeros(len(p), np.int64) if group is None else group
    out, held = [], 0
    far = reach * max(expand, 1.0) * 1.000001
    open_, have = np.nonzero(lost)[0], np.nonzero(~lost)[0]
    if len(open_) and len(have) and len(p) <= FEW:
        d = _between(p[open_], p[have], group[open_], group[have])
        low = d.min(1, keepdims=True)
        i, j = np.nonzero((d <= expand * low) & (low <= reach))
        out.append(np.rec.fromarrays([open_[i], label[have[j]], d[i, j]], names="p,c,d"))
        open_ = open_[:0]
    side = far / 64
    while len(open_) and len(have):
        side = min(side, far)
        near = have[_beside(p, side, group, have, open_)]
        if not len(near):
            open_, side = open_ if side < far else open_[:0], side * 2
            continue
        q = np.concatenate([near, open_])
        g = Grid(p[q], side, 1, group[q])
        where = g.order < len(near)  # of the sorted points, those with a label
        lab = label[q][g.order]
        mine = np.nonzero(~where)[0]
        low = np.full(len(g.p), np.inf)
        for o in [(0,) * p.shape[1], *g.offsets]:
            k, cell = g.neighbours(g.cell[mine], o)
            a = mine[k]
            for m, b in g.pairs(a, cell, side):
                ok = where[b]
                m, b = m[ok], b[ok]
                np.minimum.at(low, a[m], apart(g.p, a[m], b))
        done = (low * expand <= side) & (low <= reach) if side < far else low <= reach
        mine = np.nonzero(done & ~where)[0]
        for o in [(0,) * p.shape[1], *g.offsets] if len(mine) else []:
            k, cell = g.neighbours(g.cell[mine], o)
            a = mine[k]
            for m, b in g.pairs(a, cell, side):
                ok = where[b]
                m, b = m[ok], b[ok]
                d = apart(g.p, a[m], b)
                ok = d <= expand * low[a[m]]
                out.append(np.rec.fromarrays([q[g.order[a[m[ok]]]], lab[b[ok]], d[ok]], names="p,c,d"))
                held += len(out[-1])
                if held > 1_000_000:
                    out, held = [_least_each(out)], 0
        rest = np.nonzero(~done & ~where)[0]
        open_ = np.sort(q[g.order[rest]]) if side < far else rest[:0]
        side *= 2
    if not out:
        return np.zeros(0, np.int64), label[:0], np.zeros(0)
    at = _least_each(out)
    return at["p"], at["c"], at["d"]


def _least_each(found: list[np.recarray]) -> np.recarray:
    """The least distance ``d`` of each point ``p`` and label ``c``, sorted by these."""
    at = np.concatenate(found)
    at = at[np.lexsort((at["d"], at["c"], at["p"]))]
    keep = np.ones(len(at), bool)
    keep[1:] = (np.diff(at["p"]) != 0) | (np.diff(at["c"]) != 0)
    return at[keep]


def _beside(p: np.ndarray, side: float, group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of ``a``: points in a cell of a point of ``b``, or next to it, and by chance some others."""
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    d = p.shape[1]
    bits = np.uint64(64 - (8 * 3**d * len(b)).bit_length())

    def code(at: np.ndarray) -> np.ndarray:
        out = group[at].astype(np.uint64) * odd[-1]
        for k in range(d):
            out += np.floor(p[at, k] / side).astype(np.int64).astype(np.uint64) * odd[k]
        return out

    table, own = np.zeros(1 << (64 - int(bits)), bool), code(b)
    for o in itertools.product((-1, 0, 1), repeat=d):
        table[(own + (np.array(o).astype(np.uint64) * odd[:d]).sum(dtype=np.uint64)) >> bits] = True
    return table[code(a) >> bits]


def radius_components(p: np.ndarray, r: float) -> np.ndarray:
    """Components 0, 1, .. by their smallest member."""
    return _by_first(grid_components(p, r))


def _by_first(part: np.ndarray) -> np.ndarray:
    _, first, at = np.unique(part, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[at]


def dbscan_labels(p: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Density clusters 0, 1, .. (by smallest core point), -1 for noise; border points join the lowest-numbered cluster near them."""
    n = len(p)
    out = np.full(n, -1)
    if not n:
        return out
    core, part, at, of = dbscan_links(p, eps, least)
    if not core.any():
        return out
    out[core] = _by_first(part[core])
    name = np.full(part.max() + 1, n)
    name[part[core]] = out[core]
    big = np.full(n, n)
    np.minimum.at(big, at, name[of])
    border = ~core & (big < n)
    out[border] = big[border]
    return out


def nearest(p: np.ndarray, q: np.ndarray, chunk: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
    """Nearest point of ``q`` for each of ``p``, and the distance; by blocks."""
    at, dist = np.full(len(p), -1), np.full(len(p), np.inf)
    for i in range(0, len(p), chunk):
        for j in range(0, len(q), chunk):
            d = ((p[i : i + chunk, None] - q[None, j : j + chunk]) ** 2).sum(2)
            k = d.argmin(1)
            v = np.sqrt(d[np.arange(len(k)), k])
            better = v < dist[i : i + chunk]
            dist[i : i + chunk] = np.where(better, v, dist[i : i + chunk])
            at[i : i + chunk] = np.where(better, k + j, at[i : i + chunk])
    return at, dist


def nearest_other(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each of ``p`` to the nearest of ``q`` that lies elsewhere; infinite where there is none.

    Cells grow until the nearest lies within one side, so that crowded places are searched in small
    cells and empty ones in large; the last few points are compared with all.
    """
    low = np.full(len(p), np.inf)
    if not len(p) or not len(q):
        return low
    both = np.concatenate([p, q])
    width = float(np.ptp(both, axis=0).max())
    side, open_ = width / len(q) ** 0.5 / 4, np.arange(len(p))
    while len(open_) * len(q) > 1_000_000 and 0 < side < width:
        # in a cell the points of q come first; only they are counted and boxed
        g = Grid(np.concatenate([q, p[open_]]), side, 1, label=np.repeat([0, 1], [len(q), len(open_)]))
        where = g.order < len(q)
        g.count = np.add.reduceat(where.astype(np.int64), g.start)
        g.low, g.high = np.minimum.reduceat(np.where(where[:, None], g.p, np.inf), g.start), np.maximum.reduceat(np.where(where[:, None], g.p, -np.inf), g.start)
        mine = np.nonzero(~where)[0]
        found = np.full(len(g.p), np.inf)
        for o in [(0,) * p.shape[1], *g.offsets]:
            k, cell = g.neighbours(g.cell[mine], o)
            a = mine[k]
            for m, b in g.pairs(a, cell, np.minimum(found[a], side)):
                d = apart(g.p, a[m], b)
                ok = d > 0
                np.minimum.at(found, a[m[ok]], d[ok])
        done = found[mine] <= side
        low[open_[g.order[mine[done]] - len(q)]] = found[mine[done]]
        open_ = np.sort(open_[g.order[mine[~done]] - len(q)])
        side *= 2
    step = max(1, 1_000_000 // max(len(q), 1))
    for i in range(0, len(open_), step):
        d = _between(p[open_[i : i + step]], q)
        d[d == 0] = np.inf
        low[open_[i : i + step]] = d.min(1)
    return low


def cluster_links(p: np.ndarray, label: np.ndarray, r: float) -> dict[int, set[int]]:
    """Neighbouring clusters (labels >= 0): those with hits at most ``r`` apart."""
    own = label >= 0
    out: dict[int, set[int]] = {int(c): set() for c in np.unique(label[own])}
    _, a, b = linked_labels(p[own], label[own], r)
    for x, y in zip(a.tolist(), b.tolist()):
        out[x].add(y)
        out[y].add(x)
    return out


# ---------------------------------------------------------------- lines
def principal(p: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, direction and descending eigenvalues of weighted points."""
    w = np.ones(len(p)) if w is None else np.clip(w, 1e-8, None)
    c = (p * w[:, None]).sum(0) / w.sum()
    q = p - c
    ev, vec = np.linalg.eigh((q * w[:, None]).T @ q / w.sum())
    return c, vec[:, 2], np.clip(ev[::-1], 0, None)


def line_gap(p: np.ndarray, c: np.ndarray, u: np.ndarray) -> np.ndarray:
    q = p - c
    return np.sqrt(np.clip((q * q).sum(1) - (q @ u) ** 2, 0, None))


def line_line(p1: np.ndarray, v1: np.ndarray, p2: np.ndarray, v2: np.ndarray) -> float:
    """Closest approach of two lines."""
    n = np.cross(v1, v2)
    nn = n @ n
    d = p2 - p1
    if nn > 1e-18:
        return float(abs(d @ n) / np.sqrt(nn))
    c = np.cross(d, v1)
    return float(np.sqrt(c @ c / max(v1 @ v1, 1e-18)))


#: Points from which lines are compared with cells of points first.
MANY = 5_000


def _fullest_line(q: np.ndarray, u: np.ndarray, i: np.ndarray, reach: float) -> int | None:
    """Of the lines through the points ``i`` along ``u`` the first with most points within ``reach``; None where cells hold too few points to help.

    Only points of cells whose ball comes near a line are compared with it, by the same sums as all would be.
    """
    size = np.ptp(q, axis=0)
    side = max(reach, float(np.prod(size) * 64 / len(q)) ** (1 / 3), float(size.max()) / 1_000)  # some 64 points a cell where they lie evenly
    g = Grid(q, side, 0) if side > 0 else None
    if g is None or len(g.code) * 16 > len(q):
        return None
    middle = (g.low + g.high) / 2
    limit = (reach * 1.000001 + np.sqrt(((g.high - g.low) ** 2).sum(1)) / 2) ** 2
    square = (g.p * g.p).sum(1)
    at_middle, x, y, z = (middle * middle).sum(1), *np.ascontiguousarray(g.p.T)
    best, first = -1, None
    step = max(1, 1_000_000 // len(middle))
    for a in range(0, len(u), step):
        v, o = u[a : a + step], q[i[a : a + step]]
        along = v @ middle.T - (v * o).sum(1)[:, None]
        close = at_middle - 2 * (o @ middle.T) + (o * o).sum(1)[:, None] - along * along <= limit * 1.000001 + 1e-6
        most = close @ g.count
        for k in np.argsort(-most, kind="stable").tolist():
            if most[k] < best:
                break
            cells = np.nonzero(close[k])[0]
            # neighbouring cells along the order are one slice
            cut = np.nonzero(np.diff(cells) != 1)[0] + 1
            lo, hi = g.start[cells[np.r_[0, cut]]], (g.start + g.count)[cells[np.r_[cut - 1, len(cells) - 1]]]
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            (vx, vy, vz), (ox, oy, oz) = v[k], o[k]
            px, py, pz = x[at], y[at], z[at]
            t = px * vx + py * vy + pz * vz - (vx * ox + vy * oy + vz * oz)
            count = int((px * (-2 * ox) + py * (-2 * oy) + pz * (-2 * oz) + square[at] + (ox * ox + oy * oy + oz * oz) - t * t <= reach * reach).sum())
            if count > best or (count == best and a + k < first):
                best, first = count, a + k
    return first


def ransac_line(p: np.ndarray, iters: int, reach: float, least: int, rng: np.random.Generator) -> np.ndarray | None:
    """Mask of the points near the best of ``iters`` lines through two random points, refined once; None if too few."""
    n = len(p)
    if n < max(least, 2):
        return None
    i, j = rng.integers(0, n, iters), rng.integers(0, n - 1, iters)
    j = j + (j >= i)
    u = p[j] - p[i]
    length = np.sqrt((u * u).sum(1))
    ok = length > 1e-9
    u, i = u[ok] / length[ok, None], i[ok]
    best, mask = -1, None
    # about the middle, so that squares stay small; distances by matrix products
    q = p - p.mean(0)
    if n > MANY and (k := _fullest_line(q, u, i, reach)) is not None:
        u, i = u[k : k + 1], i[k : k + 1]
    square, turned = (q * q).sum(1), np.ascontiguousarray(q.T)
    for a in range(0, len(u), max(1, 2_000_000 // n)):
        b = a + max(1, 2_000_000 // n)
        o = q[i[a:b]]
        along = u[a:b] @ turned - (u[a:b] * o).sum(1)[:, None]
        gap = (-2 * o) @ turned
        gap += square
        gap += square[i[a:b]][:, None]
        along *= along
        gap -= along
        near = gap <= reach * reach
        count = near.sum(1)
        k = count.argmax()
        if count[k] > best:
            best, mask = count[k], near[k]
    if best < least:
        return None
    c, d, _ = principal(p[mask])
    refined = line_gap(p, c, d) <= reach
    return refined if refined.sum() >= best else mask


def fit_tracks(p: np.ndarray, iters: int = 800, least: int = 35, reach: float = 1.2, most: int = 12, attach: float = 1.15, seed: int = 0) -> np.ndarray:
    """Labels of lines taken one after another from the points left; unlabelled points close to a line join the nearest."""
    label = np.full(len(p), -1)
    rng = np.random.default_rng(seed)
    lines = []
    for k in range(most):
        free = np.nonzero(label < 0)[0]
        mask = ransac_line(p[free], iters, reach, least, rng)
        if mask is None:
            break
        label[free[mask]] = k
        lines.append(principal(p[free[mask]])[:2])
    free = np.nonzero(label < 0)[0]
    if lines and len(free):
        gap = np.stack([line_gap(p[free], c, u) for c, u in lines])
        k = gap.argmin(0)
        near = gap[k, np.arange(len(free))] <= attach * reach
        label[free[near]] = k[near]
    return label


def rss_curve(p: np.ndarray, label: np.ndarray, params: int = 5) -> list[tuple[int, float, float]]:
    """(K, RSS, BIC) when only the K largest lines are kept and each point belongs to the nearest."""
    ids, n = np.unique(label[label >= 0], return_counts=True)
    order = ids[np.lexsort((ids, -n))]
    out, gap = [], np.full(len(p), np.inf)
    for k, c in enumerate(order, 1):
        centre, u, _ = principal(p[label == c])
        gap = np.minimum(gap, line_gap(p, centre, u))
        rss = float((gap**2).sum())
        out.append((k, rss, len(p) * np.log(max(rss, 1e-12) / len(p)) + params * k * np.log(len(p))))
    return out


def choose_k(curve: list[tuple[int, float, float]], rss_cut: float) -> int:
    """The first K whose RSS is under the cut, else the one of smallest BIC, else 0 for no curve."""
    under = [k for k, rss, _ in curve if rss <= rss_cut]
    return under[0] if under else min(curve, key=lambda c: (c[2], c[1]))[0] if curve else 0


def keep_largest(p: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Only the ``k`` largest lines, renumbered by size, and these lines; points of the others join the nearest kept one."""
    ids, n = np.unique(label[label >= 0], return_counts=True)
    order = ids[np.lexsort((ids, -n))][:k]
    out = np.full(len(p), -1)
    lines = []
    for i, c in enumerate(order):
        out[label == c] = i
        lines.append(principal(p[label == c])[:2])
    rest = (label >= 0) & (out < 0)
    if lines and rest.any():
        gap = np.stack([line_gap(p[rest], c, u) for c, u in lines])
        out[rest] = gap.argmin(0)
    return out, lines


def near_own_line(p: np.ndarray, label: np.ndarray, lines: list[tuple[np.ndarray, np.ndarray]], most: float) -> np.ndarray:
    """Labels without the points further than ``most`` from their line."""
    out = label.copy()
    for c, (centre, u) in enumerate(lines):
        at = np.nonzero(label == c)[0]
        out[at[line_gap(p[at], centre, u) > most]] = -1
    return out


def long_enough(p: np.ndarray, label: np.ndarray, least: float) -> np.ndarray:
    """Labels without lines shorter than ``least``, renumbered."""
    out = np.full(len(p), -1)
    k = 0
    for c in np.unique(label[label >= 0]):
        at = label == c
        centre, u, _ = principal(p[at])
        along = (p[at] - centre) @ u
        if np.ptp(along) >= least:
            out[at] = k
            k += 1
    return out


def densest_stretch(p: np.ndarray, label: np.ndarray, gap: float = 2.0, least: int = 25) -> np.ndarray:
    """Each line cut at gaps along it: of its stretches with ``least`` points the densest stays; without a gap it is whole, without such a stretch gone."""
    out = label.copy()
    for c in np.unique(label[label >= 0]):
        at = np.nonzero(label == c)[0]
        centre, u, _ = principal(p[at])
        t = (p[at] - centre) @ u
        order = np.argsort(t, kind="stable")
        cut = np.nonzero(np.diff(t[order]) > gap)[0] + 1
        if not len(cut):
            continue
        parts = [s for s in np.split(order, cut) if len(s) >= least]
        out[at] = -1
        if parts:
            best = max(parts, key=lambda s: len(s) / max(np.ptp(t[s]), 1e-6))
            out[at[best]] = c
    return out


def fit_track_labels(p: np.ndarray, reach: float = 1.2, rss_cut: float = 1.5e6, iters: int = 800, least: int = 35, min_length: float = 30.0, seed: int = 0) -> np.ndarray:
    """Lines by RANSAC, their number by RSS, points near them, lines long enough."""
    label = fit_tracks(p, iters, least, reach, seed=seed)
    curve = rss_curve(p[label >= 0], label[label >= 0]) if (label >= 0).any() else []
    label, lines = keep_largest(p, label, choose_k(curve, rss_cut))
    return long_enough(p, near_own_line(p, label, lines, reach), min_length)


def trimmed_axis(p: np.ndarray, w: np.ndarray, keep: float = 0.85, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Principal axis of the share ``keep`` of points closest to it, iterated."""
    at = np.arange(len(p))
    for _ in range(rounds):
        c, u, ev = principal(p[at], w[at])
        gap = line_gap(p, c, u)
        new = np.argsort(gap, kind="stable")[: max(3, int(np.ceil(keep * len(p))))]
        if set(new.tolist()) == set(at.tolist()):
            break
        at = new
    return c, u, ev


# ---------------------------------------------------------------- one dimension
def merge_gaps(values, tol: float) -> np.ndarray:
    """Medians of values whose gap to the previous one is at most ``tol``."""
    v = np.sort(np.asarray([x for x in values if np.isfinite(x)], dtype=float))
    if not len(v):
        return v
    return np.array([np.median(g) for g in np.split(v, np.nonzero(np.diff(v) > tol)[0] + 1)])


def insert(candidates: list[float], t0: float, separation: float, highest: float | None = None) -> float:
    """Add ``t0`` to a sorted list unless one lies within ``separation``; the value that stands for it."""
    if highest is not None:
        t0 = float(np.clip(np.rint(t0), 0, highest))
    near = min(candidates, key=lambda c: abs(c - t0), default=None)
    if near is not None and abs(near - t0) <= separation:
        return near
    candidates.append(t0)
    candidates.sort()
    return t0


def weighted_median(v: np.ndarray, w: np.ndarray) -> float:
    ok = np.isfinite(v) & np.isfinite(w) & (w > 0)
    if not ok.any():
        return float("nan")
    order = np.argsort(v[ok], kind="stable")
    share = np.cumsum(w[ok][order]) / w[ok].sum()
    return float(v[ok][order][min(np.searchsorted(share, 0.5 * (1 - 1e-12)), ok.sum() - 1)])


# ---------------------------------------------------------------- groupings of tracks
def gmm_split(p: np.ndarray, most: int = 4, seed: int = 0, rounds: int = 60) -> np.ndarray:
    """Labels of the Gaussian mixture of 1..``most`` components with the smallest BIC."""
    n, d = p.shape
    rng = np.random.default_rng(seed)
    best, label = np.inf, np.zeros(n, int)
    for k in range(1, min(most, max(1, n // 4)) + 1):
        mu = p[rng.integers(0, n, 1)]
        for _ in range(k - 1):  # each next centre is the point furthest from those before
            mu = np.vstack([mu, p[((p[:, None] - mu[None]) ** 2).sum(2).min(1).argmax()]])
        for _ in range(10):
            near = ((p[:, None] - mu[None]) ** 2).sum(2).argmin(1)
            mu = np.stack([p[near == j].mean(0) if (near == j).any() else mu[j] for j in range(k)])
        pi = np.maximum(np.bincount(near, minlength=k), 1) / n
        cov = np.stack([(np.cov(p[near == j].T, bias=True) if (near == j).sum() > d else np.cov(p.T, bias=True) / k) + 1e-3 * np.eye(d) for j in range(k)])
        ll = -np.inf
        for _ in range(rounds):
            logp = np.empty((n, k))
            for j in range(k):
                q = p - mu[j]
                s, logdet = np.linalg.slogdet(cov[j])
                logp[:, j] = np.log(pi[j] + 1e-300) - 0.5 * (np.einsum("nd,nd->n", q @ np.linalg.inv(cov[j]), q) + logdet + d * np.log(2 * np.pi))
            top = logp.max(1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(logp - top).sum(1))
            r = np.exp(logp - total[:, None])
            if total.sum() - ll < 1e-6 * n:
                break
            ll = total.sum()
            w = r.sum(0) + 1e-9
            pi, mu = w / n, (r.T @ p) / w[:, None]
            for j in range(k):
                q = p - mu[j]
                cov[j] = (q * r[:, j : j + 1]).T @ q / w[j] + 1e-3 * np.eye(d)
        bic = -2 * ll + (k * (1 + d + d * (d + 1) / 2) - 1) * np.log(n)
        if bic < best:
            best, label = bic, r.argmax(1)
    return numbered(label)


def linkage(dist: np.ndarray, cut: float, complete: bool) -> np.ndarray:
    """Agglomerative groups by complete or single linkage up to ``cut``; for the few tracks of an event."""
    n = len(dist)
    if not complete:
        i, j = np.nonzero(np.triu(dist <= cut, 1))
        return numbered(components(n, i, j))
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label = np.arange(n)
    while n > 1:
        k = d.argmin()
        a, b = divmod(k, n)
        if d[a, b] > cut:
            break
        a, b = min(a, b), max(a, b)
        label[label == b] = a
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
    return numbered(label)


def spectral_groups(affinity: np.ndarray, most: int, least: int = 1, seed: int = 0) -> np.ndarray:
    """Groups by the eigenvectors of the normalised affinity; their number at the largest eigenvalue gap."""
    n = len(affinity)
    if n < 3:
        return np.zeros(n, int)
    deg = affinity.sum(1)
    s = 1 / np.sqrt(np.maximum(deg, 1e-12))
    ev, vec = np.linalg.eigh(np.eye(n) - s[:, None] * affinity * s[None])
    top = min(most, n - 1)
    gaps = np.diff(ev[: top + 1])
    k = int(np.clip(gaps.argmax() + 1, least, top))
    x = vec[:, :k]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(n, k, replace=False)]
    for _ in range(50):
        lab = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.stack([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(k)])
    return numbered(lab)
