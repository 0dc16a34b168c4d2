"""NumPy kernels over many reaches at once: depths, capacities and backwater. No Spark here."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
from numpy.polynomial import chebyshev

from culvert.schema import G_US, K_US

#: Depths that the search for the largest open-channel flow looks at, and the one it finds in a circle.
GRID, CIRCLE_PEAK = 2000, 1876
CIRCULAR, RECTANGULAR, ELLIPTICAL, ARCH = range(4)
SHAPES = {"circular": CIRCULAR, "rectangular": RECTANGULAR, "elliptical": ELLIPTICAL, "arch": ARCH}
TOLERANCE, _SIMPSON = 1e-7, 256
_REACH_STEPS, _ROOT_STEPS = 12, 60
#: Halvings of a step's bracket before false position.
_HALVINGS = 20
_peaks: dict[tuple[int, float], int] = {}


def _over(a, b):
    """a / b where b > 0, else 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


def _circle(y, d):
    t = 2.0 * np.arccos(np.clip(1.0 - 2.0 * _over(y, d), -1.0, 1.0))
    return d * d / 8.0 * (t - np.sin(t)), d * t / 2.0, d * np.sin(t / 2.0)


def _ellipse_perimeter(y, rise, span):
    """Arc length below depth y: Simpson's rule over the angle."""
    a, b = span / 2.0, rise / 2.0
    step = np.arccos(np.clip(1.0 - _over(y, b), -1.0, 1.0)) / _SIMPSON
    total = np.zeros_like(step)
    for i in range(_SIMPSON + 1):
        t = i * step
        total += (1.0 if i in (0, _SIMPSON) else 4.0 if i % 2 else 2.0) * np.sqrt((a * np.cos(t)) ** 2 + (b * np.sin(t)) ** 2)
    return 2.0 * step / 3.0 * total


class Sections:
    """Arrays of shape, rise and span."""

    def __init__(self, shape, rise, span) -> None:
        self.shape, self.rise, self.span = np.asarray(shape), np.asarray(rise, float), np.asarray(span, float)
        self.mixed = bool((self.shape != CIRCULAR).any())

    @classmethod
    def of(cls, shape, rise, span) -> Sections:
        """From pandas columns; unknown shapes are circles."""
        return cls(shape.map(SHAPES).fillna(CIRCULAR).to_numpy(int), rise.to_numpy(float), span.to_numpy(float))

    def __getitem__(self, at) -> Sections:
        return Sections(self.shape[at], self.rise[at], self.span[at])

    def geometry(self, y):
        """Area, wetted perimeter, hydraulic radius and top width at depth y; free surface on top."""
        y = np.clip(y, 0.0, self.rise)
        area, perimeter, top = _circle(y, self.rise)
        if self.mixed:
            own = self.shape == RECTANGULAR
            area, top = np.where(own, self.span * y, area), np.where(own, self.span, top)
            perimeter = np.where(own, self.span + 2.0 * y, perimeter)
            if (own := self.shape == ELLIPTICAL).any():
                wide = _over(self.span, self.rise)
                area, top = np.where(own, wide * area, area), np.where(own, wide * top, top)
                perimeter[own] = _ellipse_perimeter(y[own], self.rise[own], self.span[own])
            if (own := self.shape == ARCH).any():
                r = self.span / 2.0
                wall = np.maximum(self.rise - r, 0.0)
                above = np.minimum(np.maximum(y - wall, 0.0), r)
                half = np.sqrt(np.maximum(r * r - above * above, 0.0))
                angle = np.arcsin(np.clip(_over(above, r), -1.0, 1.0))
                low = y <= wall
                area = np.where(own, np.where(low, self.span * y, self.span * wall + above * half + r * r * angle), area)
                perimeter = np.where(own, np.where(low, self.span + 2.0 * y, self.span + 2.0 * wall + 2.0 * r * angle), perimeter)
                top = np.where(own, np.where(low, self.span, 2.0 * half), top)
        return area, perimeter, _over(area, perimeter), top

    def full(self):
        """Area and hydraulic radius with the whole boundary wetted."""
        r, wall = self.span / 2.0, np.maximum(self.rise - self.span / 2.0, 0.0)
        area, perimeter = math.pi * self.rise**2 / 4.0, math.pi * self.rise
        if self.mixed:
            kinds = [self.shape == k for k in (RECTANGULAR, ELLIPTICAL, ARCH)]
            area = np.select(kinds, [self.rise * self.span, math.pi * self.span * self.rise / 4.0, self.span * wall + math.pi * r * r / 2.0], area)
            oval = np.where(kinds[1], _ellipse_perimeter(self.rise, self.rise, self.span), 0.0) if kinds[1].any() else 0.0
            perimeter = np.select(kinds, [2.0 * (self.rise + self.span), oval, self.span + 2.0 * wall + math.pi * r], perimeter)
        return area, _over(area, perimeter)


def _conveyance(n, area, radius):
    return _over(K_US, n) * area * radius ** (2.0 / 3.0)


def manning_q(n, s, sections: Sections, y):
    area, _, radius, _ = sections.geometry(y)
    return _conveyance(n, area, radius) * np.sqrt(np.maximum(s, 0.0))


def full_capacity(n, s, sections: Sections):
    area, radius = sections.full()
    return _conveyance(n, area, radius) * np.sqrt(np.maximum(s, 0.0))


def peak_index(shape: int, ratio: float) -> int:
    """Which of GRID depths has the largest flow: it depends on the shape and span/rise alone."""
    if shape == CIRCULAR:
        return CIRCLE_PEAK
    if shape == RECTANGULAR:
        return GRID
    key = (shape, round(ratio, 9))
    if key not in _peaks:
        one = Sections(np.full(GRID, shape), np.ones(GRID), np.full(GRID, ratio))
        area, _, radius, _ = one.geometry(np.arange(1, GRID + 1) / GRID)
        _peaks[key] = int(np.argmax(area * radius ** (2.0 / 3.0))) + 1
    return _peaks[key]


def max_capacity(n, s, sections: Sections):
    """Largest open-channel flow and its depth; 0 and 0 without slope or roughness."""
    index = np.full(sections.rise.shape, CIRCLE_PEAK)
    if sections.mixed:
        ratio = _over(sections.span, sections.rise)
        keys, inverse = np.unique(np.stack([sections.shape, ratio]), axis=1, return_inverse=True)
        index = np.array([peak_index(int(k), r) for k, r in keys.T])[inverse.ravel()]
    y = sections.rise * index / GRID
    q = manning_q(n, s, sections, y)
    return q, np.where(q > 0, y, 0.0)


def _bisect(lo, hi, goes_up):
    """Halves all brackets until each is narrower than the tolerance; `goes_up(mid)` keeps the upper half."""
    open_ = np.ones(lo.shape, bool)
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        up = goes_up(mid)
        lo, hi = np.where(open_ & up, mid, lo), np.where(open_ & ~up, mid, hi)
        open_ &= hi - lo >= TOLERANCE
        if not open_.any():
            break
    return 0.5 * (lo + hi)


def normal_depth(q, n, s, sections: Sections, peak=None):
    """Depth of uniform flow; 0 without flow, NaN beyond the largest open-channel flow."""
    q_max, y_max = max_capacity(n, s, sections) if peak is None else peak
    y = _bisect(np.zeros(q.shape), y_max.copy(), lambda m: ~(manning_q(n, s, sections, m) > q))
    return np.where(q <= 0, 0.0, np.where(q > q_max, np.nan, y))


def critical_depth(q, sections: Sections, g: float = G_US):
    def below(m):
        area, _, _, top = sections.geometry(m)
        return np.where((area <= 0) | (top <= 0), -q * q, q * q * top - g * area**3) > 0

    y = _bisect(1e-6 * sections.rise, 0.999 * sections.rise, below)
    return np.where(q <= 0, 0.0, y)


@dataclass(frozen=True)
class DepthTable:
    """Depth of a circle, as a share of its diameter, over a variable from 0 to `top`: a polynomial for
    each of equal pieces, in -1..1 within the piece, the constant first. `unit` scales the variable."""

    pieces: np.ndarray
    top: float
    unit: float


def _pieces(share_at, top: float, count: int, degree: int) -> np.ndarray:
    """Interpolated at the Chebyshev points of each piece."""
    z = np.cos(math.pi * (np.arange(degree + 1) + 0.5) / (degree + 1))
    fitted = (chebyshev.cheb2poly(chebyshev.chebfit(z, share_at((k + 0.5 * (z + 1.0)) / count * top), degree)) for k in range(count))
    return np.array([np.pad(c, (0, degree + 1 - len(c))) for c in fitted])


def _angle(goes_up, lo, hi, shape):
    """Angles where goes_up(angle) ends, to the last bit."""
    lo, hi = np.full(shape, lo), np.full(shape, hi)
    for _ in range(100):
        mid = 0.5 * (lo + hi)
        up = goes_up(mid)
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return 0.5 * (lo + hi)


def _share(angle):
    return 0.5 * (1.0 - np.cos(0.5 * angle))


@cache
def normal_table() -> DepthTable:
    """Over u = sqrt(1 - (Q / Q_peak)^(3/13)), in which the depth is smooth: the flow grows with the
    13/3rd power of a small angle and is flat at its peak. `unit` is Q_peak for K/n S^(1/2) d^(8/3) = 1.
    Off by less than 1e-11 of the diameter."""
    raw = lambda t: (t - np.sin(t)) ** (5.0 / 3.0) / t ** (2.0 / 3.0)
    peak = float(_angle(lambda t: 5.0 * t * (1.0 - np.cos(t)) > 2.0 * (t - np.sin(t)), 5.0, 5.6, ()))
    most = raw(peak)
    at = lambda u: _share(_angle(lambda t: (raw(t) / most) ** (3.0 / 13.0) < 1.0 - u * u, 1e-12, peak, u.shape))
    return DepthTable(_pieces(at, 1.0, 16, 7), 1.0, most * 2.0 ** (2.0 / 3.0) / 8.0 ** (5.0 / 3.0))


@cache
def critical_table() -> DepthTable:
    """Over p = v / (1 + v), v the eighth root of Q^2 / (g d^5), which grows like a small angle; up to
    0.9995 of the diameter. Off by less than 1e-11 of the diameter."""
    root = lambda t: (((t - np.sin(t)) / 8.0) ** 3 / np.sin(0.5 * t)) ** 0.125
    most = float(root(2.0 * math.acos(1.0 - 2.0 * 0.9995)))
    at = lambda p: _share(_angle(lambda t: root(t) < p / (1.0 - p), 1e-9, 2.0 * math.pi - 1e-9, p.shape))
    top = most / (1.0 + most)
    return DepthTable(_pieces(at, top, 64, 7), top, 1.0)


def _root(f, lo, hi, f_lo, f_hi, open_):
    """Roots between lo and hi: the bracket is halved first, and what is left of it closed by false position,
    where an end that stays twice has its value halved (the Illinois rule). Below the crown friction
    falls and rises again, so a step can have three roots; the halving says which one is meant."""
    lo, hi, f_lo, f_hi = lo.copy(), hi.copy(), f_lo.copy(), f_hi.copy()
    for _ in range(_HALVINGS if open_.any() else 0):
        mid = 0.5 * (lo + hi)
        value = f(mid)
        upper = np.signbit(value) == np.signbit(f_hi)
        lo, f_lo = np.where(upper, lo, mid), np.where(upper, f_lo, value)
        hi, f_hi = np.where(upper, mid, hi), np.where(upper, value, f_hi)
    root, side = np.where(open_, hi, lo), np.zeros(lo.shape, np.int8)
    for _ in range(_ROOT_STEPS):
        gap = f_hi - f_lo
        mid = np.where(open_ & (gap != 0), hi - f_hi * np.divide(hi - lo, gap, out=np.zeros_like(gap), where=gap != 0), root)
        value = f(mid)
        upper = np.signbit(value) == np.signbit(f_hi)
        root = np.where(open_, mid, root)
        up, down = open_ & upper, open_ & ~upper
        f_lo = np.where(up & (side == 1), 0.5 * f_lo, np.where(down, value, f_lo))
        f_hi = np.where(down & (side == -1), 0.5 * f_hi, np.where(up, value, f_hi))
        hi, lo = np.where(up, mid, hi), np.where(down, mid, lo)
        side = np.where(up, 1, np.where(down, -1, side)).astype(np.int8)
        open_ = open_ & (np.abs(value) > 1e-12) & (hi - lo > 1e-12)
        if not open_.any():
            break
    return root


def backwater(sections: Sections, n, q, inv_dn, inv_up, length, ws_dn, y_crit, y_normal):
    """Water surface at the upper end of subcritical reaches, by standard steps from the lower end."""
    plain = (length <= 1e-9) | (q <= 0)
    run = np.where(plain, 1.0, length)
    bed, dx = (inv_up - inv_dn) / run, run / _REACH_STEPS
    floor = np.maximum(y_crit, 1e-4)

    def flow_at(y):
        area, _, radius, _ = sections.geometry(np.clip(y, 1e-4, sections.rise))
        velocity, conv = _over(q, area), _conveyance(n, area, radius)
        return velocity * velocity / (2.0 * G_US), _over(q, conv) ** 2

    y = np.maximum(ws_dn - inv_dn, floor)
    for i in range(_REACH_STEPS):
        z_dn, z_up = inv_dn + bed * dx * i, inv_dn + bed * dx * (i + 1)
        head, friction = flow_at(y)
        known = z_dn + y + head

        def excess(m, z_up=z_up, known=known, friction=friction):
            h, sf = flow_at(m)
            return z_up + m + h - (known + 0.5 * (sf + friction) * dx)

        lo, hi = floor.copy(), np.maximum(y + 2.0, 2.0 * sections.rise)
        at_lo = f_lo = excess(lo)
        f_hi = excess(hi)
        none = np.signbit(f_lo) == np.signbit(f_hi)
        root = _root(excess, lo, hi, f_lo, f_hi, ~none & (at_lo != 0))
        y = np.where(at_lo == 0, floor, np.where(none, np.maximum(y_normal, floor), root))
        y = np.maximum(y, floor)
    return np.where(plain, ws_dn + (inv_up - inv_dn), inv_up + y)


def access_hole_loss(v_out, d_out, access_diam, cos, depth, d_in, bench, plunge=0.0, g: float = G_US):
    """HEC-22 access-hole loss: K V^2 / 2g with corrections for depth, diameter, angle, plunge and bench."""
    ratio = _over(depth, d_out)
    by_depth = np.where(d_out <= 0, 1.0, np.where(ratio >= 3.2, 1.0, np.clip(0.5 * np.maximum(ratio, 0.0) ** 0.6, 0.0, 1.0)))
    by_diameter = np.where((d_out > 0) & (d_in > 0) & (ratio >= 3.2), _over(d_out, d_in) ** 3, 1.0)
    sine = np.sqrt(np.maximum(1.0 - np.clip(cos, -1.0, 1.0) ** 2, 0.0))
    r = _over(access_diam, d_out)
    base = np.where(d_out > 0, 0.1 * r * (1.0 - sine) + 1.4 * r**0.15 * sine, 0.0)
    by_plunge = np.where((d_out > 0) & (plunge > depth), 1.0 + 0.2 * _over(plunge, d_out) * _over(plunge - depth, d_out), 1.0)
    k = np.maximum(base * by_diameter * by_depth * by_plunge * np.where(bench > 0, bench, 1.0), 0.0)
    return k * v_out * v_out / (2.0 * g)


def pipe_state(q, s, n, d):
    """Velocity, share of the full capacity and whether the flow exceeds the largest open-channel
    flow, of circular pipes."""
    pipe = Sections(np.zeros(len(d), int), d, d)
    yn = normal_depth(q, n, s, pipe)
    over = np.isnan(yn)
    wet = np.where(over, math.pi * d * d / 4.0, pipe.geometry(np.where(over, d, yn))[0])
    return _over(q, wet), _over(q, full_capacity(n, s, pipe)), over


def size_circular(q, s, n, d, sizes, max_velocity: float, max_pct_full: float, open_channel: bool, slack: float = 1e-9):
    """For each row: whether d meets the limits, the first of the ascending sizes that does (NaN
    without one), and velocity, share and overload of d if it does, else of that size or the last."""

    def fits(velocity, share, over, d):
        return (d > 0) & (q[rows] >= 0) & (velocity <= max_velocity + slack) & (share <= max_pct_full + slack) & ~(over & open_channel)

    rows = np.arange(len(q))
    velocity, share, over = pipe_state(q, s, n, d)
    meets = fits(velocity, share, over, d)
    found = np.full(len(q), np.nan)
    best = [velocity.copy(), share.copy(), over.copy()]
    for size in sizes:
        rows = np.flatnonzero(np.isnan(found))
        if not len(rows):
            break
        trial = np.full(len(rows), float(size))
        state = pipe_state(q[rows], s[rows], n[rows], trial)
        ok = fits(*state, trial)
        found[rows[ok]] = size
        for kept, new in zip(best, state, strict=True):  # the last trial stays where none fits
            kept[rows] = np.where(meets[rows], kept[rows], new)
    return meets, found, *best
