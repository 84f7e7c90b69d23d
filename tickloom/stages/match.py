"""Times for the clusters of one event: ordered placements on a running light model.

The state of an event is its data light, its running base (the sum of the light placed so far,
clipped), predicted images of clusters, candidates per TPC, and the time of every hit. Each stage
takes clusters off or puts them on and keeps what lowers the loss. One object serves both detectors;
what differs is in ``Rules``.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

import numpy as np

from tickloom.functions import numeric as N
from tickloom.functions import scans as S


@dataclass(frozen=True)
class Rules:
    search: int = 700
    peak: int = 105
    clip: float = 60780.0
    mean: bool = False  # mean chi2 (ND) or its sum (2x2)
    resolution: float = 5.0
    small_energy: float = 8.0
    dim_peak: float = 40.0
    bright_light: float = 150.0
    free_margin: float = 0.05
    tie_share: float = 0.08
    support_share: float = 0.90
    support_floor: float = 25.0
    brightness_window: int = 8
    refine_gain: float = 0.01
    large_energy: float = 50.0
    least_energy: float = 0.5
    band: float = 0.20
    band_margin: float = -1e-4
    band_tolerance: float = 0.15
    expand_gain: float = -20000.0
    align_back: int = 5
    separation: float = 2.0
    guard_energy: float = 80.0
    guard_ticks: float = 8.0
    guard_worse: float = 0.08
    swap_passes: int = 8
    swap_ticks: float = 8.0
    half_window: int = 18
    sigma: float = 3.0
    overflow_adc: float = 400.0
    model_adc: float = 400.0
    least_channels: int = 6
    gate_channels: int = 8
    gate_chi2: float = 500.0
    gate_per_mev: float = 10.0
    veto_tpcs: int = 4
    most_moves: int = 24
    most_moves_tpc: int = 3
    donor_radius: float = 3.0
    donor_hits: int = 4
    donor_energy: float = 0.2
    most_donors: int = 80
    # donors of several overflowing times permuted together
    severe: float = 100.0
    reshuffle_rows: int = 3
    reshuffle_pool: int = 4
    reshuffle_most: int = 6
    reshuffle_chi2: float = 500.0
    reshuffle_per_mev: float = 10.0
    # gates of second and later passes
    later_channels: int = 12
    later_chi2: float = 2000.0
    later_per_mev: float = 25.0
    # overflow so extreme that even a long track may be moved: channels, those at the peak, severity, channels gained, chi2, chi2 per MeV
    override: tuple[float, ...] = (22, 12, 250.0, 14, 5000.0, 50.0)


#: Hits times channels whose light is kept for an event.
KEPT_LIGHT = 8_000_000
#: Families whose light is kept.
KEPT_FAMILIES = 16

TWO_RULES = Rules()
ND_RULES = Rules(search=800, mean=True)


@dataclass
class Event:
    xyz: np.ndarray
    e: np.ndarray
    tpc: np.ndarray
    actual: dict[int, np.ndarray]
    variance: dict[int, np.ndarray]
    model: object
    rules: Rules
    label: np.ndarray = None
    backbone: int = 0
    kind: dict[int, str] = field(default_factory=dict)
    candidates: dict[int, list[float]] = field(default_factory=dict)
    t0: np.ndarray = None
    base: dict[int, np.ndarray] = field(default_factory=dict)
    images: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    noisy: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    place: dict[int, float] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)
    moves: list[dict] = field(default_factory=list)
    recent: dict[tuple[int, float], list] = field(default_factory=dict)
    in_tpc: dict[int, tuple] = field(default_factory=dict)
    light: tuple | None = None  # of each hit, where the model is a sum over hits
    energies: tuple | None = None  # of the labels and energies they were summed of
    images_in: tuple | None = None  # TPCs of each cluster, of so many images
    sums: dict[tuple[int, float], tuple] = field(default_factory=dict)  # light of families
    sums_of: np.ndarray | None = None  # the times it was summed by

    def __post_init__(self) -> None:
        self.t0 = np.full(len(self.e), np.nan) if self.t0 is None else self.t0
        self.base = self.base or {t: np.zeros_like(a) for t, a in self.actual.items()}

    # ------------------------------------------------------------ images and clusters
    def image(self, hits: np.ndarray, tpc: int) -> np.ndarray:
        h = hits[self.tpc[hits] == tpc]
        if not len(h):
            return np.zeros_like(self.actual[tpc])
        if hasattr(self.model, "per_hit"):
            return self.model.image_of(self.light_of(h)[None])
        return self.model.image(*self.xyz[h].T, self.e[h], tpc)

    def light_of(self, h: np.ndarray) -> np.ndarray:
        """Light of hits in each channel, added hit by hit; that of many is made in blocks."""
        if len(self.e) * self.model.channels <= KEPT_LIGHT:
            if self.light is None or self.light[0] is not self.xyz or self.light[1] is not self.e:
                self.light = self.xyz, self.e, self.model.per_hit(*self.xyz.T, self.e)
            return self.light[2].take(h, 0).sum(0)
        total, step = np.zeros((1, self.model.channels)), max(1, KEPT_LIGHT // 4 // self.model.channels)
        for i in range(0, len(h), step):
            some = h[i : i + step]
            total = np.concatenate([total, self.model.per_hit(*self.xyz[some].T, self.e[some])]).sum(0, keepdims=True)
        return total[0]

    def family_light(self, tpc: int, t0: float) -> tuple[np.ndarray, int]:
        """``light_of`` the hits of a TPC and time, and their number; kept up to date as hits move."""
        if self.sums_of is not self.t0:
            self.sums_of, self.sums = self.t0, {}
        if (tpc, t0) not in self.sums:
            at = families(self, tpc, t0)
            if len(self.sums) >= KEPT_FAMILIES:
                del self.sums[next(iter(self.sums))]
            self.sums[tpc, t0] = self.light_of(at), len(at)
        return self.sums[tpc, t0]

    def move_families(self, hits: np.ndarray, new: float, tolerance: float = 0.5) -> None:
        """The kept light of families after ``hits`` go to the time ``new``; called before they do."""
        for (tpc, t0), (light, n) in self.sums.items() if self.sums_of is self.t0 else ():
            own = hits[self.tpc[hits] == tpc]
            was, arrive = np.abs(self.t0[own] - t0) <= tolerance, abs(new - t0) <= tolerance
            own = own[~was] if arrive else own[was]
            if len(own):
                n += len(own) if arrive else -len(own)
                self.sums[tpc, t0] = light + self.light_of(own) if arrive else light - self.light_of(own) if n else np.zeros_like(light), n

    def hits_in(self, tpc: int) -> np.ndarray:
        if tpc not in self.in_tpc or self.in_tpc[tpc][0] is not self.tpc:
            self.in_tpc[tpc] = self.tpc, np.nonzero(self.tpc == tpc)[0]
        return self.in_tpc[tpc][1]

    def family_image(self, hits: np.ndarray, tpc: int, t0: float) -> np.ndarray:
        """``image``; the last two of each TPC and time are remembered, as one move's families are the next one's."""
        known = self.recent.setdefault((tpc, t0), [])
        for own, img in known:
            if len(own) == len(hits) and np.array_equal(own, hits):
                return img
        img = self.image(hits, tpc)
        known.insert(0, (hits, img))
        del known[2:]
        return img

    def predict(self, label: np.ndarray | None = None) -> dict[tuple[int, int], np.ndarray]:
        label = self.label if label is None else label
        out = {}
        for c, t in sorted({(int(c), int(t)) for c, t in zip(label, self.tpc) if c >= 0 and t in self.actual}):
            out[(c, t)] = self.image(np.nonzero(label == c)[0], t)
        return out

    def tpcs(self, c: int) -> list[int]:
        if self.images_in is None or self.images_in[0] is not self.images or self.images_in[1] != len(self.images):
            found: dict[int, list[int]] = {}
            for k, t in self.images:
                found.setdefault(k, []).append(t)
            self.images_in = self.images, len(self.images), found
        return list(self.images_in[2].get(c, ()))

    def energy(self, c: int) -> float:
        """Energy of the hits of a cluster; ``forget_energies`` after labels were changed in place."""
        if self.energies is None or self.energies[0] is not self.label or self.energies[1] is not self.e:
            self.energies = self.label, self.e, {}
        known = self.energies[2]
        if c not in known:
            known[c] = float(self.e[self.label == c].sum())
        return known[c]

    def forget_energies(self) -> None:
        self.energies = None

    def clusters(self, backbone: bool | None = None) -> list[int]:
        ids = sorted({c for c, _ in self.images})
        ids = [c for c in ids if backbone is None or (c < self.backbone) == backbone]
        return sorted(ids, key=lambda c: (-self.energy(c), c))

    # ------------------------------------------------------------ light on and off
    def put(self, c: int, t0: float, sign: int = 1, noisy: bool = False) -> None:
        for t in self.tpcs(c):
            img = self.noisy.get((c, t), self.images[(c, t)]) if noisy else self.images[(c, t)]
            b = self.base[t] + sign * S.shifted(img, t0)
            self.base[t] = np.clip(b, 0, self.rules.clip)

    def assign(self, c: int, t0: float, stage: str, noisy: bool = False, mode: str = "") -> None:
        self.put(c, t0, noisy=noisy)
        self.place[c] = t0
        self.t0[self.label == c] = t0
        self.sums.clear()
        for t in self.tpcs(c):
            self.add_candidate(t, t0)
        self.log.append({"stage": stage, "cluster": c, "t0": t0, "energy": self.energy(c), "mode": mode, "assigned": True})

    def reject(self, c: int, stage: str) -> None:
        self.log.append({"stage": stage, "cluster": c, "t0": np.nan, "energy": self.energy(c), "mode": "", "assigned": False})

    def add_candidate(self, t: int, t0: float) -> float:
        return N.insert(self.candidates.setdefault(t, []), float(t0), self.rules.separation, None)

    def without(self, c: int) -> dict[int, np.ndarray]:
        """The base of the cluster's TPCs without its own light."""
        if c not in self.place:
            return {t: self.base[t] for t in self.tpcs(c)}
        return {t: np.maximum(self.base[t] - S.shifted(self.images[(c, t)], self.place[c]), 0) for t in self.tpcs(c)}

    def block(self, c: int, base: dict[int, np.ndarray] | None = None, only: list[int] | None = None, noisy: bool = False, support: bool = False) -> tuple[np.ndarray, ...]:
        """Image, base, data and variance of a cluster over its TPCs, one below the other."""
        base = base or self.base
        out = ([], [], [], [])
        for t in only or self.tpcs(c):
            img = self.noisy.get((c, t), self.images[(c, t)]) if noisy else self.images[(c, t)]
            keep = self.support(img) if support else slice(None)
            for o, a in zip(out, (img, base[t], self.actual[t], self.variance[t])):
                o.append(a[keep])
        return tuple(np.concatenate(o) for o in out)

    def support(self, img: np.ndarray):
        """Channels with 90 % of the peak light or a peak of 25; all when there is no light."""
        peak = np.clip(img.max(1), 0, None)
        if peak.sum() <= 0:
            return slice(None)
        order = np.argsort(-peak, kind="stable")
        n = int(np.searchsorted(np.cumsum(peak[order]), self.rules.support_share * peak.sum() * (1 - 1e-12))) + 1
        keep = peak >= self.rules.support_floor
        keep[order[:n]] = True
        return keep

    def chi2(self, c: int, t0: float, base=None, noisy: bool = False) -> float:
        p, b, a, v = self.block(c, base, noisy=noisy)
        return S.chi2_at(p, b, a, v, t0, self.rules.clip, self.rules.mean)

    def curve(self, c: int, base=None, only=None) -> np.ndarray:
        p, b, a, v = self.block(c, base, only)
        return S.clipped_scan(p, b, a, v, self.rules.search, self.rules.clip, self.rules.mean)

    def idle(self, c: int, base=None) -> float:
        """Loss of the cluster's TPCs without it."""
        p, b, a, v = self.block(c, base)
        return S.chi2_at(np.zeros_like(p), b, a, v, 0.0, self.rules.clip, self.rules.mean)

    def snap_back(self, c: int, t0: float, back: int | None = None) -> float:
        _, b, a, _ = self.block(c)
        return S.snap(a, b, t0, int(self.rules.resolution) if back is None else back, 0, self.rules.peak, self.rules.search)

    def snap_to_candidate(self, c: int, t0: float) -> float:
        near = [x for t in self.tpcs(c) for x in self.candidates.get(t, []) if abs(x - t0) <= self.rules.resolution]
        return min(near, key=lambda x: abs(x - t0)) if near else t0


# ---------------------------------------------------------------- invariants
def snapshot(ev: Event, backbone_only: bool = True) -> tuple[np.ndarray, np.ndarray]:
    at = np.nonzero(np.isfinite(ev.t0) & ((ev.label < ev.backbone) if backbone_only else True))[0]
    return at, ev.t0[at].copy()


def changed_since(ev: Event, snap: tuple[np.ndarray, np.ndarray], tolerance: float = 1e-4) -> int:
    """Hits of a snapshot whose time is another now."""
    return int((~(np.abs(ev.t0[snap[0]] - snap[1]) <= tolerance)).sum())


# ---------------------------------------------------------------- tracks
def place_tracks(ev: Event) -> None:
    """Each track, most energetic first: full scan over all its TPCs, snap backward, put on the base."""
    for c in ev.clusters(backbone=True):
        t0 = ev.snap_back(c, float(ev.curve(c).argmin()))
        ev.assign(c, t0, "track")


def rescan_tracks(ev: Event) -> None:
    """Each track taken off and scanned again, guarded against showers.

    Where a track of several TPCs runs through some with a bright shower, the scan of the clean TPCs
    is taken instead if the two times differ by ``guard_ticks`` and the full curve's minimum is,
    on the clean curve, worse by more than ``guard_worse`` of its range.
    """
    r = ev.rules
    shower = {t for t in ev.actual if ev.e[(ev.tpc == t) & np.isin(ev.label, [k for k, v in ev.kind.items() if "shower" in v])].sum() >= r.guard_energy}
    for c in ev.clusters(backbone=True):
        if c not in ev.place:
            continue
        base = ev.without(c)
        curve = ev.curve(c, base)
        t0 = float(curve.argmin())
        clean = [t for t in ev.tpcs(c) if t not in shower]
        if 0 < len(clean) < len(ev.tpcs(c)):
            own = ev.curve(c, base, clean)
            u = float(own.argmin())
            scale = max(np.percentile(own, 90) - own.min(), 1e-12)
            if abs(u - t0) >= r.guard_ticks and (own[int(t0)] - own.min()) / scale > r.guard_worse:
                t0 = u
        if ev.chi2(c, t0, base) < ev.chi2(c, ev.place[c], base):
            ev.base.update(base)
            ev.assign(c, t0, "rescan")


def swap_tracks(ev: Event, pairs: list[tuple[int, int]]) -> int:
    """Swap the times of the pair that gains most, again and again; swapped tracks are locked."""
    locked: set[int] = set()
    done = 0
    gains: dict[tuple[int, int], float] = {}  # of pairs in TPCs that no swap has changed since
    for _ in range(ev.rules.swap_passes):
        best = (0.0, None)
        for a, b in pairs:
            if {a, b} & locked or a not in ev.place or b not in ev.place or abs(ev.place[a] - ev.place[b]) < ev.rules.swap_ticks:
                continue
            if (a, b) not in gains:
                gains[a, b] = _swap_gain(ev, a, b)
            gain = gains[a, b]
            if gain > best[0]:
                best = (gain, (a, b))
        if best[1] is None:
            break
        a, b = best[1]
        ta, tb = ev.place[a], ev.place[b]
        ev.put(a, ta, -1)
        ev.put(b, tb, -1)
        ev.assign(a, tb, "swap")
        ev.assign(b, ta, "swap")
        locked |= {a, b}
        done += 1
        changed = {*ev.tpcs(a), *ev.tpcs(b)}
        gains = {k: v for k, v in gains.items() if changed.isdisjoint(ev.tpcs(k[0])) and changed.isdisjoint(ev.tpcs(k[1]))}
    return done


def _swap_gain(ev: Event, a: int, b: int) -> float:
    """What the loss falls by when two clusters swap their times."""
    gain = 0.0
    for t in sorted({*ev.tpcs(a), *ev.tpcs(b)}):
        ia, ib = (ev.images.get((c, t), np.zeros_like(ev.base[t])) for c in (a, b))
        rest = np.maximum(ev.base[t] - S.shifted(ia, ev.place[a]) - S.shifted(ib, ev.place[b]), 0)
        new = rest + S.shifted(ia, ev.place[b]) + S.shifted(ib, ev.place[a])
        zero = np.zeros_like(new)
        gain += S.chi2_at(zero, ev.base[t], ev.actual[t], ev.variance[t], 0, ev.rules.clip, ev.rules.mean) - S.chi2_at(zero, new, ev.actual[t], ev.variance[t], 0, ev.rules.clip, ev.rules.mean)
    return gain


def fine_correct(ev: Event, reach: float = 1.5, step: float = 0.5) -> None:
    """Tracks moved on a grid of half ticks where that lowers the loss strictly; of equal ones the smallest move."""
    for c in ev.clusters(backbone=True):
        if c not in ev.place:
            continue
        base, now = ev.without(c), ev.place[c]
        grid = [d for d in np.arange(-reach, reach + step / 2, step) if 0 <= now + d <= ev.rules.search]
        loss, _, d = min((ev.chi2(c, now + d, base), abs(d), d) for d in grid)
        if d and loss < ev.chi2(c, now, base):
            ev.base.update(base)
            ev.assign(c, now + d, "fine")


def amend_candidates(ev: Event, window: float = 10.0) -> None:
    """Flash candidates within ``window`` of a track's time give way to that time; the most energetic tracks first."""
    for c in ev.clusters(backbone=True):
        if c not in ev.place:
            continue
        for t in ev.tpcs(c):
            have = ev.candidates.get(t, [])
            if any(abs(x - ev.place[c]) <= window for x in have):
                ev.candidates[t] = sorted([x for x in have if abs(x - ev.place[c]) > window] + [ev.place[c]])


# ---------------------------------------------------------------- blobs, greedy
def place_blobs(ev: Event, tie_variance: dict[int, np.ndarray] | None = None) -> None:
    """TPCs in order, the brightest blobs first: small ones by candidates, large ones by a full scan.

    A dim small blob takes the brightest candidate. Another takes the candidate of best cosine (a
    second variance may decide near ties), or a free scan when that is better by a margin, then is
    refined below a tick. The image with adopted noise is kept where its chi2 is lower.
    """
    r = ev.rules
    for t in sorted(ev.actual):
        mine = [c for c in ev.clusters(backbone=False) if (c, t) in ev.images and c not in ev.place]
        for c in mine:
            p, b, a, v = ev.block(c, support=True)
            cand = sorted(ev.candidates.get(t, []))
            if ev.energy(c) < r.small_energy and cand:
                light = np.clip(a - b, 0, None).sum(0)
                bright = {x: light[max(0, int(r.peak + x) - r.brightness_window) : int(r.peak + x) + r.brightness_window + 1].max(initial=0) for x in cand}
                if p.max(initial=0) < r.dim_peak:
                    some = [x for x in cand if bright[x] > r.bright_light] or cand
                    ev.assign(c, max(some, key=lambda x: bright[x]), "blob", mode="brightest")
                    continue
                cos = sorted(((S.cosine_at(p, b, a, v, x), -x) for x in cand), reverse=True)
                t0 = -cos[0][1]
                if tie_variance is not None and len(cos) > 1 and cos[0][0] - cos[1][0] <= r.tie_share * max(abs(cos[0][0]), 1e-12):
                    tv = np.concatenate([tie_variance[k][ev.support(ev.images[(c, k)])] for k in ev.tpcs(c)])
                    t0 = S.best_of(p, b, a, tv, [-cos[0][1], -cos[1][1]], r.clip)[0]
                free = S.cosine_scan(p, b, a, v, r.search)
                if free.max() > cos[0][0] + r.free_margin:
                    t0 = ev.snap_to_candidate(c, float(free.argmax()))
                mode = "cosine"
            else:
                curve = S.clipped_scan(p, b, a, v, r.search, r.clip, r.mean)
                t0 = ev.snap_to_candidate(c, S.snap(a, b, float(curve.argmin()), int(r.resolution), 0, r.peak, r.search))
                mode = "scan"
            t0 = S.refine_subtick(p, b, a, v, t0, clip=r.clip)
            noisy = bool(ev.noisy) and ev.chi2(c, t0, noisy=True) < ev.chi2(c, t0)
            ev.assign(c, t0, "blob", noisy, mode)


def refine_blobs(ev: Event) -> None:
    """Larger blobs taken off, scanned again and put where the chi2 falls by more than ``refine_gain``."""
    for c in ev.clusters(backbone=False):
        if c not in ev.place or ev.energy(c) < ev.rules.small_energy:
            continue
        base = ev.without(c)
        t0 = float(ev.curve(c, base).argmin())
        if ev.chi2(c, ev.place[c], base) - ev.chi2(c, t0, base) > ev.rules.refine_gain:
            ev.base.update(base)
            ev.assign(c, t0, "refine")


# ---------------------------------------------------------------- phases by energy
def population(ev: Event) -> tuple[list[int], list[int], list[int]]:
    """Primary (several TPCs or large), iterative, and pruned (tiny) blobs."""
    first, second, pruned = [], [], []
    for c in ev.clusters(backbone=False):
        if c in ev.place:
            continue
        e = ev.energy(c)
        (first if len(ev.tpcs(c)) > 1 or e > ev.rules.large_energy else pruned if e < ev.rules.least_energy else second).append(c)
    return first, second, pruned


def place_large(ev: Event, clusters: list[int]) -> None:
    """Full scan with two-sided snap; kept when the loss falls against leaving the cluster out."""
    for c in sorted(clusters, key=lambda c: (-ev.energy(c), c)):
        _, b, a, _ = ev.block(c)
        t0 = float(ev.curve(c).argmin())
        k = int(ev.rules.resolution)
        snapped = S.snap(a, b, t0, k, k, ev.rules.peak, ev.rules.search)
        t0 = snapped if ev.chi2(c, snapped) <= ev.chi2(c, t0) else t0
        if ev.chi2(c, t0) < ev.idle(c):
            ev.assign(c, t0, "large")
        else:
            ev.reject(c, "large")


def place_small(ev: Event, clusters: list[int]) -> None:
    """Per TPC: of the clusters in the energy band of the most energetic, the one with the best cell of the
    normalised cluster x candidate matrix is placed; hopeless rows get a candidate of their own by a full scan."""
    r = ev.rules
    for t in sorted(ev.actual):
        left = [c for c in clusters if ev.tpcs(c) == [t]]
        spent: set[int] = set()
        while left:
            anchor = max(left, key=lambda c: (ev.energy(c), -c))
            band = [c for c in left if ev.energy(c) >= r.band * ev.energy(anchor)]
            cand = sorted(ev.candidates.get(t, []))
            if not cand:
                expand(ev, anchor, left, spent)
                continue
            delta = np.array([[ev.chi2(c, x) - ev.idle(c) for x in cand] for c in band])
            weak = [c for c, row in zip(band, delta) if row.min() > r.band_margin and c not in spent]
            if weak:
                expand(ev, max(weak, key=lambda c: (ev.energy(c), -c)), left, spent)
                continue
            scale = np.abs(delta).max(1, keepdims=True)
            share = np.clip(np.sqrt([ev.energy(c) / max(ev.energy(anchor), 1e-9) for c in band]), 0.25, 1.0)
            score = np.where(scale > 0, delta / np.where(scale > 0, scale, 1), 0) * share[:, None]
            i, j = divmod(int(score.argmin()), len(cand))
            if score[i, j] > r.band_tolerance and band[i] not in spent:
                expand(ev, band[i], left, spent)
                continue
            ev.assign(band[i], ev.snap_back(band[i], cand[j], r.align_back), "small", mode="matrix")
            left.remove(band[i])


def expand(ev: Event, c: int, left: list[int], spent: set[int]) -> None:
    """Full scan of a cluster: a new time becomes a candidate of its TPC, a known one places the cluster or gives it up."""
    t = ev.tpcs(c)[0]
    t0 = ev.snap_back(c, float(ev.curve(c).argmin()), ev.rules.align_back)
    known = any(abs(x - t0) <= ev.rules.separation for x in ev.candidates.get(t, []))
    if not known and c not in spent:
        ev.add_candidate(t, t0)
        spent.add(c)
        return
    spent.add(c)
    left.remove(c)
    if ev.idle(c) - ev.chi2(c, t0) > ev.rules.expand_gain:
        ev.assign(c, t0, "small", mode="expand")
    else:
        ev.reject(c, "small")


def place_beam(ev: Event, t: int, clusters: list[int], width: int = 8) -> None:
    """Placements of a TPC's clusters together by a beam of the ``width`` best partial ones; states alike in all times count once."""
    cand = sorted(ev.candidates.get(t, []))
    if not cand:
        return
    states = [((), ev.base[t], 0.0)]
    for c in sorted(clusters, key=lambda c: (-ev.energy(c), c)):
        grown = {}
        for key, base, _ in states:
            for x in [*cand, None]:
                b = base if x is None else np.clip(base + S.shifted(ev.images[(c, t)], x), 0, ev.rules.clip)
                loss = S.chi2_at(np.zeros_like(b), b, ev.actual[t], ev.variance[t], 0, ev.rules.clip, ev.rules.mean)
                grown[(*key, x)] = (b, loss)
        states = sorted(((k, b, s) for k, (b, s) in grown.items()), key=lambda s: s[2])[:width]
    for c, x in zip(sorted(clusters, key=lambda c: (-ev.energy(c), c)), states[0][0]):
        ev.reject(c, "beam") if x is None else ev.assign(c, x, "beam")


# ---------------------------------------------------------------- association
def region_grow(ev: Event, contact: float = 3.5, seed_cos: float = 0.55, margin: float = 0.04, least_cos: float = 0.20, rounds: int = 4, frozen: bool = False) -> int:
    """Neighbours of tracks and of well-matched clusters take their time where the light agrees nearly as well."""
    links = N.cluster_links(ev.xyz, ev.label, contact)

    def cos(c: int, t0: float) -> float:
        return S.cosine_at(*ev.block(c, ev.without(c)), t0)

    moved = 0
    for _ in range(rounds):
        seeds = [(c < ev.backbone, cos(c, t), -c) for c, t in ev.place.items() if c in links]
        todo = [-s[2] for s in sorted(seeds, reverse=True) if s[0] or s[1] >= seed_cos]
        seen, n = set(todo), 0
        for c in todo:
            for k in sorted(links.get(c, ())):
                if k < ev.backbone or not ev.tpcs(k) or (frozen and k in ev.place) or (k in ev.place and abs(ev.place[k] - ev.place[c]) < 1):
                    continue
                want, own = cos(k, ev.place[c]), cos(k, ev.place[k]) if k in ev.place else 0.0
                if want >= own - margin and want >= least_cos:
                    move(ev, k, ev.place[c], "region")
                    n += 1
                    if k not in seen:
                        todo.append(k)
                        seen.add(k)
        moved += n
        if not n:
            break
    return moved


def move(ev: Event, c: int, t0: float, stage: str) -> None:
    if c in ev.place:
        ev.put(c, ev.place[c], -1)
    ev.assign(c, t0, stage)


def colocate(ev: Event, radius: float = 5.0, least_energy: float = 20.0, window: float = 8.0, votes: int = 2, share: float = 0.55, rounds: int = 3) -> int:
    """Larger clusters go to the time of most of their neighbours when these agree."""
    links = N.cluster_links(ev.xyz, ev.label, radius)
    moved = 0
    for _ in range(rounds):
        n = 0
        for c in ev.clusters(backbone=False):
            if c not in ev.place or ev.energy(c) < least_energy:
                continue
            times = np.sort([ev.place[k] for k in links.get(c, ()) if k in ev.place])
            if not len(times):
                continue
            groups = np.split(times, np.nonzero(np.diff(times) > window)[0] + 1)
            big = max(groups, key=len)
            if len(big) >= votes and len(big) >= share * len(times) and abs(np.median(big) - ev.place[c]) > window:
                move(ev, c, float(np.median(big)), "colocate")
                n += 1
        moved += n
        if not n:
            break
    return moved


def family_expand(ev: Event, contact: float = 3.5, accept: float = 1.15, hysteresis: float = 0.95, frozen: bool = True) -> int:
    """Families grow from the clusters surest of their time over neighbours whose chi2 at the family's time is nearly their best.

    With ``frozen`` only clusters without a time are taken; else contested ones change family where
    the chi2 there is clearly lower.
    """
    links = N.cluster_links(ev.xyz, ev.label, contact)
    best: dict[int, tuple[float, float, float]] = {}
    for c in links:
        if not ev.tpcs(c):
            continue
        cand = sorted({float(np.rint(x)) for t in ev.tpcs(c) for x in ev.candidates.get(t, [])} | ({ev.place[c]} if c in ev.place else set()))
        if not cand:
            continue
        base = ev.without(c)
        s = sorted((ev.chi2(c, x, base), x) for x in cand)
        best[c] = (s[0][0], s[0][1], (s[1][0] - s[0][0]) / max(s[0][0], 1e-12) if len(s) > 1 else 0.0)
    family = {c: ev.place[c] for c in ev.place}
    anchors = set(family)
    moved = 0
    queue = sorted(family, key=lambda c: (-best.get(c, (0, 0, 0))[2], -ev.energy(c), c))
    while queue:
        c = queue.pop(0)
        for k in sorted(links.get(c, ())):
            if k not in best or k < ev.backbone or (frozen and k in anchors):
                continue
            at = ev.chi2(k, family[c], ev.without(k))
            if k not in family:
                ok = at <= accept * best[k][0]
            else:
                ok = not frozen and abs(family[k] - family[c]) >= 1 and at < hysteresis * ev.chi2(k, family[k], ev.without(k))
            if ok:
                family[k] = family[c]
                move(ev, k, family[c], "family")
                moved += 1
                queue.append(k)
    return moved


# ---------------------------------------------------------------- absorption
def absorb(ev: Event, capacity_of, reach: float = 40.0) -> int:
    """Noise hits offered to each cluster, up to its capacity: taken all together if the light gets better, or refused all."""
    from tickloom.stages.labels import noise_list

    offers: dict[int, list[int]] = {}
    for _, hit, c in noise_list(ev.xyz, ev.label, reach):
        offers.setdefault(c, []).append(hit)
    taken = 0
    for c in sorted(offers, key=lambda c: (-ev.energy(c), c)):
        room = capacity_of(ev.kind.get(c, "cluster"), ev.energy(c))
        hits = [h for h in offers[c] if ev.label[h] == -1 and ev.tpc[h] in ev.actual][:room]
        if not hits or c not in ev.place:
            continue
        base = {**ev.base, **ev.without(c)}
        both = np.concatenate([np.nonzero(ev.label == c)[0], hits])
        tpcs = sorted({int(t) for t in ev.tpc[both] if t in ev.actual})
        new = {t: ev.image(both, t) for t in tpcs}

        def loss(images: dict[int, np.ndarray]) -> float:
            return sum(S.chi2_at(images.get(t, np.zeros_like(base[t])), base[t], ev.actual[t], ev.variance[t], ev.place[c], ev.rules.clip, ev.rules.mean) for t in tpcs)

        if loss(new) < loss({t: ev.images[(c, t)] for t in ev.tpcs(c)}):
            ev.base.update(base)
            for t in tpcs:
                ev.images[(c, t)] = new[t]
            ev.label[hits] = c
            ev.forget_energies()
            ev.assign(c, ev.place[c], "absorb")
            taken += len(hits)
    return taken


# ---------------------------------------------------------------- rescue by light and space
def families(ev: Event, t: int, t0: float, tolerance: float = 0.5) -> np.ndarray:
    at = ev.hits_in(t)
    return at[np.abs(ev.t0[at] - t0) <= tolerance]


def windows(ev: Event, t: int, times) -> np.ndarray:
    ticks = ev.actual[t].shape[1]
    mask = np.zeros(ticks, bool)
    for x in times:
        k = int(np.rint(x)) + ev.rules.peak
        mask[max(0, k - ev.rules.half_window) : max(0, k + ev.rules.half_window + 1)] = True
    return mask if mask.any() else np.ones(ticks, bool)


def window_loss(ev: Event, t: int, base: np.ndarray, times) -> float:
    m = windows(ev, t, times)
    return float((((base - ev.actual[t])[:, m]) ** 2 / np.maximum(ev.variance[t][:, m], 1e-6)).sum())


def overflow(ev: Event, t: int, t0: float, base: np.ndarray | None = None) -> tuple[int, float, float, int]:
    """Channels that overflow near ``t0``, the severity, the summed overflow, and channels that overflow at the peak itself."""
    r = ev.rules
    m = ev.base[t] if base is None else base
    k = int(np.rint(t0)) + r.peak
    if not 0 <= k < m.shape[1]:
        return 0, 0.0, 0.0, 0
    lo, hi = max(0, k - r.half_window), k + r.half_window + 1
    d = (m - ev.actual[t])[:, lo:hi]
    over = (d > np.maximum(r.sigma * np.sqrt(ev.variance[t][:, lo:hi]), r.overflow_adc)) & (m[:, lo:hi] > r.model_adc)
    n, total = int(over.any(1).sum()), float(d[over].sum())
    at = over[:, k - lo]
    return n, float(d[at, k - lo].sum()) / max(n, 1) + 0.002 * total, total, int(at.sum())


def donors(ev: Event, t: int, t0: float) -> list[np.ndarray]:
    """Connected groups of hits assigned near ``t0``, the most energetic first."""
    at = families(ev, t, t0, ev.rules.resolution)
    if not len(at):
        return []
    part = N.radius_components(ev.xyz[at], ev.rules.donor_radius)
    order = np.argsort(part, kind="stable")
    groups = np.split(at[order], np.nonzero(np.diff(part[order]))[0] + 1)
    groups = [g for g in groups if len(g) >= ev.rules.donor_hits and ev.e[g].sum() >= ev.rules.donor_energy]
    return sorted(groups, key=lambda g: -ev.e[g].sum())[: ev.rules.most_donors]


def vetoed(ev: Event, hits: np.ndarray) -> bool:
    """The donor's label of most energy is a track over many TPCs."""
    ids = np.unique(ev.label[hits])
    top = max(ids, key=lambda c: (ev.e[hits[ev.label[hits] == c]].sum(), -c))
    return top >= 0 and "track" in ev.kind.get(int(top), "") and len(np.unique(ev.tpc[ev.label == top])) >= ev.rules.veto_tpcs


@dataclass(frozen=True)
class Gates:
    """What a move must gain: channels that no longer overflow, chi2, and chi2 for each MeV moved."""

    channels: int
    chi2: float
    per_mev: float

    def passed(self, channels: int, gain: float, energy: float) -> bool:
        return channels >= self.channels and gain >= self.chi2 and gain / max(energy, 1e-9) >= self.per_mev


def gates(r: Rules, later: bool) -> tuple[Gates, Gates]:
    """The gates of single moves and of permutations (these ask for no channels); stricter after the first pass."""
    if not later:
        return Gates(r.gate_channels, r.gate_chi2, r.gate_per_mev), Gates(0, r.reshuffle_chi2, r.reshuffle_per_mev)
    return Gates(r.later_channels, r.later_chi2, r.later_per_mev), Gates(0, max(r.reshuffle_chi2, r.later_chi2), max(r.reshuffle_per_mev, r.later_per_mev))


def overridden(ev: Event, over: tuple[int, float, float, int], fewer: int, gain: float, energy: float) -> bool:
    """Whether the overflow at the old time and the gain are so large that a track's veto doesn't count."""
    have = (over[0], over[3], over[1], fewer, gain, gain / max(energy, 1e-6))
    return all(h >= least for h, least in zip(have, ev.rules.override))


def moved_base(ev: Event, t: int, hits: np.ndarray, old: float, new: float) -> np.ndarray:
    """The base of a TPC after hits moved: their families' images predicted anew, old ones taken off.

    Where the model is a sum over hits, only the light of the moved ones is added up anew.
    """
    b = ev.base[t].copy()
    if hasattr(ev.model, "per_hit"):
        own = hits[ev.tpc[hits] == t]
        left, come = own[np.abs(ev.t0[own] - old) <= 0.5], own[~(np.abs(ev.t0[own] - new) <= 0.5)]
        (was, n), (to, _) = ev.family_light(t, old), ev.family_light(t, new)
        stay = was - ev.light_of(left) if n > len(left) else np.zeros_like(was)
        for light, x, sign in ((was, old, -1), (to, new, -1), (stay, old, 1), (to + ev.light_of(come), new, 1)):
            b += sign * S.shifted(ev.model.image_of(light[None]), x)
        return np.clip(b, 0, ev.rules.clip)
    was, to = families(ev, t, old), families(ev, t, new)
    moved, arrived = np.zeros(len(ev.e), bool), np.zeros(len(ev.e), bool)
    moved[hits] = arrived[hits] = arrived[to] = True
    stay, joined = was[~moved[was]], np.nonzero(arrived)[0]
    for group, x, sign in ((was, old, -1), (to, new, -1), (stay, old, 1), (joined, new, 1)):
        b += sign * S.shifted(ev.family_image(group, t, x), x)
    return np.clip(b, 0, ev.rules.clip)


def commit_move(ev: Event, t: int, hits: np.ndarray, old: float, new: float, base: np.ndarray, how: str) -> None:
    ev.base[t] = base
    ev.move_families(hits, new)
    ev.t0[hits] = new
    ev.add_candidate(t, new)
    ev.moves.append({"kind": how, "tpc": t, "old": old, "new": new, "hits": hits.tolist(), "energy": float(ev.e[hits].sum())})


def overflows(ev: Event) -> list[tuple[int, float, tuple]]:
    """TPC, time and ``overflow`` of all assigned times with enough overflowing channels, the most severe first."""
    rows = []
    for t in sorted(ev.actual):
        for x in sorted({float(np.rint(v)) for v in ev.t0[(ev.tpc == t) & np.isfinite(ev.t0)]} - {0.0}):
            over = overflow(ev, t, x)
            if over[0] >= ev.rules.least_channels:
                rows.append((t, x, over))
    return sorted(rows, key=lambda r: (-r[2][1], r[0], r[1]))


@dataclass
class Trial:
    """A donor's hits, its old and new time, and what the windows of both gain in chi2."""

    gain: float
    hits: np.ndarray
    old: float
    new: float
    base: np.ndarray


def best_trial(ev: Event, t: int, x: float, barred: set[tuple[int, float, float]]) -> Trial | None:
    """Of all donors at a time and all other candidates of the TPC the move that gains most."""
    best = None
    targets = [y for y in sorted({float(np.rint(v)) for v in ev.candidates.get(t, [])}) if y != x and (t, y, x) not in barred]
    for hits in donors(ev, t, x):
        old = float(np.median(ev.t0[hits]))
        for y in targets:
            b = moved_base(ev, t, hits, old, y)
            gain = window_loss(ev, t, ev.base[t], (x, y)) - window_loss(ev, t, b, (x, y))
            if best is None or gain > best.gain:
                best = Trial(gain, hits, old, y, b)
    return best


def light_rescue(ev: Event, passes: int = 1, reshuffle: bool = True) -> int:
    """Donor groups moved from overflowing times to others while the chi2 of the windows falls enough.

    Per pass first the donors of several severe times of a TPC are permuted together, then the most
    severe times give up their single best donor. A move that undoes an earlier one is skipped;
    passes after the first ask for more. A track over many TPCs stays unless the overflow is extreme.
    """
    r = ev.rules
    done: set[tuple[int, float, float]] = set()
    per_tpc: dict[int, int] = {}
    total = 0
    for no in range(passes):
        single, joint = gates(r, no > 0)
        n = 0
        rows = overflows(ev)
        if reshuffle:
            shuffled = 0
            for t in sorted({t for t, _, _ in rows}):
                severe = [(x, over) for k, x, over in rows if k == t and over[1] >= r.severe][: r.reshuffle_rows]
                if len(severe) >= 2 and shuffled < r.reshuffle_most and total + n < r.most_moves:
                    moved = permute_donors(ev, t, severe, joint, done)
                    shuffled += bool(moved)
                    n += moved
            if shuffled:
                rows = overflows(ev)
        for t, x, over in rows:
            if total + n >= r.most_moves or per_tpc.get(t, 0) >= r.most_moves_tpc:
                continue
            m = best_trial(ev, t, x, done)
            if m is None:
                continue
            energy, fewer = float(ev.e[m.hits].sum()), over[0] - overflow(ev, t, x, m.base)[0]
            if single.passed(fewer, m.gain, energy) and (not vetoed(ev, m.hits) or overridden(ev, over, fewer, m.gain, energy)):
                commit_move(ev, t, m.hits, m.old, m.new, m.base, "light")
                done.add((t, x, m.new))
                per_tpc[t] = per_tpc.get(t, 0) + 1
                n += 1
        total += n
        if not n:
            break
    return total


def permute_donors(ev: Event, t: int, severe: list[tuple[float, tuple]], gate: Gates, barred: set[tuple[int, float, float]]) -> int:
    """The best of all ways to give each severe time's donor one of the pooled times; the number of donors moved.

    The pool holds the old and the best new time of each donor, in the order of severity. All is
    refused when a moved donor is a track that must stay.
    """
    picked = [(m, over) for x, over in severe if (m := best_trial(ev, t, x, barred)) is not None]
    pool = list(dict.fromkeys(float(np.rint(x)) for m, _ in picked for x in (m.old, m.new)))[: ev.rules.reshuffle_pool]
    if len(picked) < 2 or len(pool) < 2:
        return 0
    stays = [[float(np.rint(m.old)) == x for x in pool] for m, _ in picked]
    # what each donor's move to each time adds to the base
    shift = []
    for m, _ in picked:
        img = ev.image(m.hits, t)
        off = S.shifted(img, m.old)
        shift.append([np.zeros_like(off) if m.old == x else S.shifted(img, x) - off for x in pool])
    now, best, choice = window_loss(ev, t, ev.base[t], pool), 0.0, None
    for pick in itertools.product(range(len(pool)), repeat=len(picked)):
        if all(stays[i][k] for i, k in enumerate(pick)):
            continue
        b = np.clip(ev.base[t] + sum(np.zeros_like(ev.base[t]) if stays[i][k] else shift[i][k] for i, k in enumerate(pick)), 0, ev.rules.clip)
        gain = now - window_loss(ev, t, b, pool)
        if gain > best:
            best, choice = gain, pick
    if choice is None:
        return 0
    moved = [(m, over, pool[k]) for i, ((m, over), k) in enumerate(zip(picked, choice)) if not stays[i][k]]
    energy = float(sum(ev.e[m.hits].sum() for m, _, _ in moved))
    if energy <= 0 or not gate.passed(0, best, energy):
        return 0
    if any(vetoed(ev, m.hits) and not overridden(ev, over, over[0], best, energy) for m, over, _ in moved):
        return 0
    for m, _, x in moved:
        commit_move(ev, t, m.hits, m.old, x, moved_base(ev, t, m.hits, m.old, x), "reshuffle")
        barred.add((t, float(np.rint(m.old)), x))
    return len(moved)


def grid_correct(ev: Event, offsets=(-2, -1, 0, 1, 2)) -> int:
    """Large clusters tried at each candidate and offset; the lowest loss (then the smallest move) is taken when strictly lower."""
    n = 0
    for c in ev.clusters(backbone=False):
        if c not in ev.place or ev.energy(c) < ev.rules.large_energy:
            continue
        base, now = ev.without(c), ev.place[c]
        tries = sorted({x + d for t in ev.tpcs(c) for x in ev.candidates.get(t, []) for d in offsets if 0 <= x + d <= ev.rules.search})
        if not tries:
            continue
        loss, _, t0 = min((ev.chi2(c, x, base), abs(x - now), x) for x in tries)
        if loss < ev.chi2(c, now, base):
            ev.base.update(base)
            ev.assign(c, t0, "grid")
            n += 1
    return n


def mixed_times(ev: Event, contact: float, same: float) -> dict[tuple[int, float, float], int]:
    """Pairs of near hits of a TPC for each two rounded times more than ``same`` apart; no list of the pairs is kept."""
    have = np.nonzero(np.isfinite(ev.t0))[0]
    p, tpc, t0 = ev.xyz[have], ev.tpc[have], ev.t0[have]
    names, no = np.unique(np.rint(t0), return_inverse=True)
    tpcs, of = np.unique(tpc, return_inverse=True)
    out: dict[tuple[int, float, float], int] = {}
    for i, j in N.near_pairs(p, contact, tpc, t0, same):
        lo, hi = np.minimum(no[i], no[j]), np.maximum(no[i], no[j])
        for code, n in zip(*(x.tolist() for x in np.unique((of[i].astype(np.int64) * len(names) + lo) * len(names) + hi, return_counts=True))):
            key = (int(tpcs[code // len(names) // len(names)]), float(names[code // len(names) % len(names)]), float(names[code % len(names)]))
            out[key] = out.get(key, 0) + n
    return out


def spatial_repair(ev: Event, contact: float = 4.0, same: float = 10.0, radius: float = 2.8, worse: float = 3.0, slack: float = 0.75, margin: float = 0.08, most: int = 24) -> int:
    """Hits of two times mixed in space go to the time whose hits they lie with: whole connected groups, else one by one.

    How well a hit fits a time is its distance to the time's trimmed axis (70 %), to its nearest hit
    (20 %) and to its centre (10 %); for groups that are no lines axis and neighbour count alike.
    """
    pairs = mixed_times(ev, contact, same)
    locked = long_hits(ev)
    moved = 0
    for t, ta, tb in sorted(pairs, key=lambda k: (-pairs[k], k))[:most]:
        side = [families(ev, t, x, same / 2) for x in (ta, tb)]
        if min(len(s) for s in side) < 3:
            continue
        fit = []
        for s in side:
            c, u, evs = N.trimmed_axis(ev.xyz[s], ev.e[s])
            line = evs[0] / max(evs.sum(), 1e-12) > 0.8
            fit.append((c, u, s, (0.70, 0.20, 0.10) if line else (0.45, 0.45, 0.10)))

        def score(hits: np.ndarray, f) -> np.ndarray:
            c, u, own, w = f
            near = N.nearest_other(ev.xyz[hits], ev.xyz[own])
            return w[0] * N.line_gap(ev.xyz[hits], c, u) + w[1] * np.where(np.isfinite(near), near, 0) + w[2] * np.sqrt(((ev.xyz[hits] - c) ** 2).sum(1)) / 10

        for k in (0, 1):
            hits = side[k][~locked[side[k]]]
            if not len(hits):
                continue
            own, other = score(hits, fit[k]), score(hits, fit[1 - k])
            near = (np.minimum(own, other) <= worse) | (other <= own + slack)
            pick, own, other = hits[near], own[near], other[near]
            if not len(pick):
                continue
            part = N.radius_components(ev.xyz[pick], radius)
            target = (tb, ta)[k]
            order = np.argsort(part, kind="stable")
            for at in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1):
                some, o, n = pick[at], own[at], other[at]
                w = np.clip(ev.e[some], 1e-9, None)
                go = some if (w @ n) / w.sum() < (w @ o) / w.sum() - margin else some[n < o - margin]
                if len(go) and len(go) < len(side[k]):
                    old = float(np.median(ev.t0[go]))
                    commit_move(ev, t, go, old, target, moved_base(ev, t, go, old, target), "spatial")
                    moved += len(go)
    return moved


def long_hits(ev: Event) -> np.ndarray:
    from tickloom.stages.labels import long_tracks

    return long_tracks(ev.label, ev.kind, ev.tpc)


def fill_holes(ev: Event, least_missing: float = 0.5) -> int:
    """Unplaced clusters put, most energetic first, on the candidate whose missing light they fill best."""
    n = 0
    for c in [c for c in ev.clusters(backbone=False) if c not in ev.place]:
        options = []
        for t in ev.tpcs(c):
            a, m = ev.actual[t].sum(0), ev.base[t].sum(0)
            for x in ev.candidates.get(t, []):
                k = int(np.rint(x)) + ev.rules.peak
                if 0 <= k < len(a) and a[k] > 0 and (a[k] - m[k]) / a[k] >= least_missing:
                    options.append(x)
        if options:
            x, loss = S.best_of(*ev.block(c), options, ev.rules.clip, ev.rules.mean)
            if loss < ev.idle(c):
                ev.assign(c, x, "fill")
                n += 1
    return n


def relabel_moves(ev: Event) -> np.ndarray:
    """Cluster ids after moves: one new id per move from the largest on, spatial moves first, later ones overwrite."""
    out = ev.label.copy()
    top = out.max(initial=-1)
    for i, m in enumerate(sorted(ev.moves, key=lambda m: m["kind"] != "spatial"), 1):
        out[m["hits"]] = top + i
    return out


def rules_of(detector: str, **changes) -> Rules:
    return replace(ND_RULES if detector == "nd" else TWO_RULES, **changes)
