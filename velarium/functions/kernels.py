"""The distances and bounds of the registry on numpy blocks.

The same formats as :mod:`numeric` has them as Columns, for joins that meet
whole blocks of vectors: inputs are rounded once a vector, and a term is a few
array operations for a run of base rows.  Exponents come from the bits.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np

from . import numeric as n

Array = np.ndarray
Step = Callable[[Array], Array]

#: Digits for every double as a decimal.
WIDE = Context(prec=800)

#: Numbers that one step works on, so that its temporaries stay in a core's cache.
RUN = 1 << 16


def same(x: Array) -> Array:
    return x


def fp16(x: Array) -> Array:
    with np.errstate(over="ignore"):
        return x.astype(np.float16).astype(np.float64)


def _exponent(a: Array) -> Array:
    return np.frexp(a)[1] - 1


def fp8(bits: int, low: float, high: float) -> Step:
    def rounded(x: Array) -> Array:
        a = np.abs(x)
        with np.errstate(invalid="ignore"):
            unit = np.ldexp(1.0, _exponent(a) - bits)
            value = np.minimum(np.floor(a / unit + 0.5) * unit, high)
            return np.where(np.isnan(x), x, np.copysign(np.where(a < low, 0.0, np.where(a > high, high, value)), x))

    return rounded


E4M3, E2M5, E3M4 = fp8(3, 2.0**-6, 448.0), fp8(5, 0.5, 6.0), fp8(4, 0.125, 30.0)


def approximate_square(x: Array, bits: int, table: Sequence[int], step: int, low: int, high: int) -> Array:
    """See :func:`numeric.approximate_square`."""
    a = np.abs(x)
    m, e = np.frexp(np.where(np.isfinite(a), a, 0.0))
    one = 1 << bits
    i = np.floor((2 * m - 1) * one).astype(np.int64)
    i = np.maximum(i, 0)
    carry = 2 * i >= one
    summed = 2 * i - carry * one + (np.asarray(table, np.int64) * step)[i // (one // len(table))]
    again = summed >= one
    e = 2 * (e.astype(np.int64) - 1) + carry + again
    value = np.ldexp(1 + (summed - again * one) / one, e)
    value = np.where(e < low, 0.0, np.where(e >= high, np.inf, value))
    return np.where(a < 2.0**low, 0.0, np.where(np.isfinite(a), value, a))


_squares: dict[int, Array] = {}


def square_fp16(table: Sequence[int]) -> Step:
    """Approximate squares of half-precision differences, looked up among all 65,536 of them."""

    def square(x: Array) -> Array:
        if len(table) not in _squares:
            every = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float64)
            _squares[len(table)] = approximate_square(every, 10, table, 1, -14, 16)
        with np.errstate(over="ignore"):
            return _squares[len(table)][x.astype(np.float16).view(np.uint16)]

    return square


_true_squares: list[Array] = []


def square_of_half(x: Array) -> Array:
    """Squares of half-precision differences, rounded to half precision, looked up among all 65,536 of them."""
    with np.errstate(over="ignore", invalid="ignore"):
        if not _true_squares:
            _true_squares.append(fp16(square(np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float64))))
        return _true_squares[0][x.astype(np.float16).view(np.uint16)]


def square_fp8(x: Array) -> Array:
    return approximate_square(x, 23, n.SQUARE_FP8, 1 << 20, -126, 128)


def square_fp32(x: Array) -> Array:
    return approximate_square(x.astype(np.float32).astype(np.float64), 23, n.SQUARE_FP32, 1, -126, 128)


def square_int16(x: Array) -> Array:
    return approximate_square(np.clip(x, -32768, 32767), 10, n.SQUARE_8, 1, -14, 16)


def fixed_point(x: Array, q: tuple[int, int]) -> Array:
    frac, total = q
    return np.minimum(np.floor(np.fmax(x, 0) * float(1 << frac) + 0.5), (1 << total) - 1) / float(1 << frac)


def quantise_int(most: int) -> Step:
    return lambda x: np.clip(np.copysign(np.floor(np.abs(x) * float(most) + 0.5), x), -most, most)


def _float(x: Array) -> Array:
    return x.astype(np.float32).astype(np.float64)


def square(x: Array) -> Array:
    return x * x


@dataclass(frozen=True)
class Kernel:
    prepare: Step  #: of components
    term: Step  #: of differences, or of products if ``product``
    finish: Step  #: of the sums
    product: bool = False

    def distances(self, q: Array, v: Array) -> Array:
        """Distances of one prepared query to prepared rows."""
        out = np.empty(len(v))
        step = max(1, RUN // max(1, v.shape[1]))
        for a in range(0, len(v), step):
            part = v[a : a + step]
            with np.errstate(invalid="ignore"):  # infinities of narrow formats may meet
                out[a : a + step] = self.term(part * q if self.product else q - part).sum(axis=1)
        return self.finish(out)


def _scaled(kind: Step, by: float) -> Step:
    return lambda x: kind(_float(x * by))


def _over(by: float) -> Step:
    return lambda s: s / by / by


_square_8, _square_16 = square_fp16(n.SQUARE_8), square_fp16(n.SQUARE_16)


_codes: dict[Step, Array] = {}


def _quantised(kind: Step) -> Step:
    """Narrow formats have at most 5 significand bits and round up from the middle: single precision's first 16 bits tell a term, so it is looked up."""

    def term(d: Array) -> Array:
        if kind not in _codes:
            with np.errstate(invalid="ignore"):
                every = (np.arange(1 << 16, dtype=np.uint32) << 16).view(np.float32).astype(np.float64)
                _codes[kind] = fixed_point(square_fp8(kind(every)), n.Q3_13)
        with np.errstate(over="ignore"):
            return _codes[kind][np.ascontiguousarray(d, np.float32).view(np.uint16)[..., sys.byteorder == "little" :: 2]]

    return term


KERNELS: dict[str, Kernel] = {
    "fp32": Kernel(same, square, same),
    "ip": Kernel(same, same, lambda s: 1 - s, product=True),
    "ip_negative": Kernel(same, same, lambda s: -s, product=True),
    "l2_int": Kernel(np.floor, square, same),
    "fp32_fpma": Kernel(same, square_fp32, same),
    "fp16_true": Kernel(fp16, square_of_half, same),
    "fp16_fpma": Kernel(fp16, _square_8, same),
    "fp16_fpma_16": Kernel(fp16, _square_16, same),
    "fp16_fpma_quantized": Kernel(fp16, lambda d: fixed_point(_square_8(d), n.Q3_14), same),
    "fp8_e4m3": Kernel(_scaled(E4M3, 100), square, _over(100)),
    "fp8_e2m5": Kernel(_scaled(E2M5, 3), square, _over(3)),
    "fp8_e3m4": Kernel(_scaled(E3M4, 15), square, _over(15)),
    "fp8_fpma": Kernel(_scaled(E4M3, 100), square_fp8, _over(100)),
    "fp8_fpma_e2m5": Kernel(_scaled(E2M5, 3), square_fp8, _over(3)),
    "fp8_fpma_e3m4": Kernel(_scaled(E3M4, 15), square_fp8, _over(15)),
    "fp8_fpma_quantized": Kernel(same, _quantised(E4M3), same),
    "fp8_fpma_quantized_e2m5": Kernel(same, _quantised(E2M5), same),
    "fp8_fpma_quantized_e3m4": Kernel(same, _quantised(E3M4), same),
    "int16_diff_fpma": Kernel(np.rint, square_int16, same),
    "int16": Kernel(quantise_int(32767), square, _over(32767)),
    "int8": Kernel(quantise_int(127), square, _over(127)),
}


def distances_of_both(one: Kernel, other: Kernel, q: Array, rows: Array, q_other: Array, rows_other: Array) -> tuple[Array, Array]:
    """Distances of one query by two kernels; two kinds of squares of one difference of halves round it once."""
    if not (one.prepare is other.prepare is fp16 and {one.term, other.term} <= {square_of_half, _square_8, _square_16}):
        return one.distances(q, rows), other.distances(q_other, rows_other)
    out = np.empty((2, len(rows)))
    step = max(1, RUN // max(1, rows.shape[1]))
    for a in range(0, len(rows), step):
        with np.errstate(over="ignore", invalid="ignore"):
            apart = (q - rows[a : a + step]).astype(np.float16)
        for n, kernel in enumerate((one, other)):
            out[n, a : a + step] = kernel.term(apart).sum(axis=1)
    return one.finish(out[0]), other.finish(out[1])


def rounded(x: Array, digits: int = 6) -> Array:
    """As Spark's ``round``: half up, away from zero, in the shortest decimal that tells a double from its neighbours; there is one zero."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x * 10.0**digits
        out = np.rint(scaled) / 10.0**digits + 0.0
        # Rounding of the product moves no number across a middle that is farther away than this.
        close = ~(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) > 1e-6) | (np.abs(scaled) > 1e9)
    for i in np.flatnonzero(close):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, WIDE)) + 0.0 if np.isfinite(x[i]) else x[i]
    return out


#: Scales of the squares that terms are held against; a floor is the best of them.
_SHARES = (1.0, 0.98, 0.95, 0.9, 0.85, 0.8, 0.7, 0.5)
_floors: dict[tuple[str, float], list[tuple[float, float]]] = {}


def _floor_points(name: str) -> tuple[Array, Array]:
    """Differences, and the least term of those between each and the one before it."""
    if name in ("fp16_true", "fp16_fpma", "fp16_fpma_16", "fp16_fpma_quantized"):
        # Terms depend on the half that is nearest to a difference: every one of them, up to the middle to the next.
        h = np.arange(1 << 15, dtype=np.uint16).view(np.float16).astype(np.float64)
        h = h[np.isfinite(h)]
        return (h + np.append(h[1:], 65536.0)) / 2, KERNELS[name].term(h)
    if name.startswith("fp8_fpma_quantized"):
        # A term is the same from one value of single precision's first 16 bits up to the next.
        f = (np.arange(0x7F80, dtype=np.uint32) << 16).view(np.float32).astype(np.float64)
        return np.append(f[1:], np.inf) * (1 + 2.0**-23), KERNELS[name].term(f)
    if name == "int16_diff_fpma":
        i = np.arange(32768.0)
        return i, KERNELS[name].term(i)
    # Single-precision squares of a significand rise between these points, among which are the ends of their table's cells.
    m = 1 + np.arange((1 << 16) + 1) / 65536
    return m[1:], KERNELS[name].term(m[:-1])


def floors(name: str, most: float) -> list[tuple[float, float]]:
    """Pairs (a, b) with term(d) >= a * d * d - b for all |d| <= most: how far a distance may lie below the squares of differences.

    Empty if the kernel's terms are products.
    """
    kernel = KERNELS[name]
    if kernel.product:
        return []
    if kernel.term is square:
        return [(1.0, 0.0)]
    most = float(2.0 ** np.ceil(np.log2(max(most, 2.0**-100))))
    if (name, most) not in _floors:
        upto, least = _floor_points(name)
        if name in ("fp32_fpma", "fp8_fpma", "fp8_fpma_e2m5", "fp8_fpma_e3m4"):  # the same for every exponent
            _floors[name, most] = [(float((least / upto**2).min()) * (1 - 1e-6), 1e-36)]
        elif most > upto[-1]:  # terms no longer grow
            _floors[name, most] = []
        else:
            last = int(np.searchsorted(upto, most)) + 1
            d2 = np.minimum(upto[:last], most) ** 2
            found = [(a, max(0.0, float((a * d2 - least[:last]).max())) + 1e-12) for a in _SHARES]
            _floors[name, most] = [(a, b) for a, b in found if np.isfinite(b)]
    return _floors[name, most]


def strict_bounds(v: Array) -> tuple[Array, Array, Array]:
    """What :func:`lower_bounds` needs of rows: squared lengths, signed powers of two of half-precision exponents, and sizes."""
    half = fp16(v)
    power = np.where(np.abs(half) < 2.0**-14, 0.0, np.ldexp(1.0, _exponent(np.where(np.isfinite(half), np.abs(half), 0.0))))
    return (v * v).sum(axis=1), np.where(half < 0, -power, power), np.abs(v)


def lower_bounds(q: Array, rows: tuple[Array, Array, Array]) -> Array:
    """Never above the squared distance: sign and exponent bounds, less what rounding to half precision may add."""
    squares, powers, sizes = rows
    product = powers * q
    terms = np.where(product < 0, -product, -2 * product).sum(axis=1)
    slack = (sizes @ np.abs(q)) * 2.0**-10 + np.abs(q).sum() * 2.0**-13
    return np.maximum(0.0, (q * q).sum() + squares + 2 * terms - 2 * slack - 1e-9)


# Bounds of pairs that :mod:`bounds` has as Columns, on blocks: rows are prepared once, and a query meets all of them.


@dataclass(frozen=True)
class Bound:
    rows: Callable[[Array], tuple[Array, ...]]
    query: Step
    value: Callable[..., Array]

    def distances(self, q: Array, rows: tuple[Array, ...]) -> Array:
        return self.value(q, *rows)


def _coarse(q: Array, powers: Array) -> Array:
    product = powers * q
    return np.where(product < 0, -product, -2 * product)


def _unit(q: Array, powers: Array) -> Array:
    return 2 + 2 * (np.trunc(_coarse(q, powers) * 16384) / 16384).sum(axis=1)


def _l2(q: Array, squares: Array, powers: Array, sizes: Array) -> Array:
    # The coarse term of a product p is -p or -2 p, which is -(3 p + |p|) / 2: two products with a matrix.
    return np.maximum(0.0, (q * q).sum() + squares - 3 * (powers @ q) - sizes @ np.abs(q))


def _with_sizes(v: Array) -> tuple[Array, Array, Array]:
    squares, powers, _ = strict_bounds(v)
    return squares, powers, np.abs(powers)


def lower_bounds_of(q: Array, rows: tuple[Array, Array, Array]) -> Array:
    """:func:`lower_bounds` of several queries, a row each, less what the matrix products' rounding may add."""
    squares, powers, sizes = rows
    own = np.abs(q)
    q2 = (q * q).sum(axis=1)[:, None]
    low = q2 + squares - 3 * (q @ powers.T) - own @ (np.abs(powers) + sizes * 2.0**-9).T
    return np.maximum(0.0, low - own.sum(axis=1)[:, None] * 2.0**-12 - 1e-9 - 64 * (q.shape[1] + 4) * np.finfo(np.float64).eps * (q2 + squares))


_halves: list[Array] = []


def codes(v: Array) -> Array:
    """The 16 bits of the half that each component is rounded to; there is one zero."""
    with np.errstate(over="ignore"):
        code = v.astype(np.float16).view(np.uint16)
    return np.where(code == 0x8000, np.uint16(0), code)


def ends(code: Array, bits: int) -> tuple[Array, Array]:
    """Least and largest value of the halves that share the first ``bits`` bits of each of ``code``: bits in front of the others all unset or all set."""
    if not _halves:
        _halves.append(np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float64))
    others = np.uint16((1 << (16 - bits)) - 1)
    near, far = code & ~others, np.where(code & 0x7FFF == 0x7C00, code, code | others)
    negative = code > 0x7FFF
    return _halves[0][np.where(negative, far, near)], _halves[0][np.where(negative, near, far)]


def intervals(v: Array, bits: int) -> tuple[Array, Array]:
    """Least and largest value of half-precision numbers that share each component's first ``bits`` bits."""
    return ends(codes(v), bits)


def _gap(q: Array, low: Array, high: Array) -> Array:
    gap = np.maximum(np.maximum(low - q, q - high), 0.0)
    return (gap * gap).sum(axis=1)


@dataclass(frozen=True)
class Gaps:
    """The sums that ``bitsB`` adds up, of many queries with many rows, as a matrix product: at most ``over`` too great or ``under`` too small."""

    asked: Array
    parts: list[Array]
    places: Array
    over: Array
    under: Array

    def sums(self, queries: slice, rows: Array) -> Array:
        """A row a query; ``rows`` come from :meth:`take`."""
        return self.asked[queries] @ rows.T

    def take(self, rows: slice) -> Array:
        return np.concatenate([part[place[rows]] for part, place in zip(self.parts, self.places, strict=True)], axis=1)


def gaps(q: Array, code: Array, bits: int, rank: int, most: int = 128) -> Gaps | None:
    """:class:`Gaps` of queries ``q`` (halves) and rows (:func:`codes`), all of them finite, in single precision.

    A component has few intervals, so its squared gaps are a table of queries by intervals.  The table is near one of
    low rank, by its leading eigenvectors; what that leaves of it is at hand and is added up into ``over`` and ``under``.  None
    if a component has more than ``most`` intervals.
    """
    asked, parts, places = [], [], np.empty(code.shape[::-1], np.uint16)
    over, under, size = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for i in range(q.shape[1]):
        first = code[:, i] >> (16 - bits)
        met = np.bincount(first, minlength=1 << bits) > 0
        if met.sum() > most:
            return None
        places[i] = (np.cumsum(met) - 1)[first]
        low, high = ends((np.flatnonzero(met) << (16 - bits)).astype(np.uint16), bits)
        gap = np.maximum(np.maximum(low - q[:, i : i + 1], q[:, i : i + 1] - high), 0.0)
        table = gap * gap
        part = np.linalg.eigh(table.T @ table)[1][:, -rank:]
        own = table @ part
        left = own @ part.T - table
        over += np.maximum(left.max(axis=1), 0.0)
        under += np.maximum(-left.min(axis=1), 0.0)
        size += np.sqrt((own * own).sum(axis=1) * (part * part).sum(axis=1).max())
        asked.append(own.astype(np.float32))
        parts.append(part.astype(np.float32))
    asked = np.concatenate(asked, axis=1)
    rounding = 2 * (asked.shape[1] + 8) * 2.0**-24 * size
    return Gaps(asked, parts, places, over + rounding, under + rounding)


def _leading(v: Array, bits: int) -> Array:
    unit = np.ldexp(1.0, _exponent(np.where(v == 0, 1.0, np.abs(v))) - bits)
    return np.copysign(np.floor(np.abs(v) / unit) * unit, v)


def bound(name: str) -> Bound:
    """``unit``, ``l2``, ``bitsB`` (from each component's first B bits), ``headN`` (the first N dimensions) or ``firstN`` (those, of 7 leading significand bits)."""
    if name == "unit":
        return Bound(lambda v: strict_bounds(v)[1:2], same, _unit)
    if name == "l2":
        return Bound(_with_sizes, same, _l2)
    if name.startswith("bits"):
        return Bound(lambda v: intervals(v, int(name[4:])), fp16, _gap)
    if name.startswith("head"):
        n = int(name[4:])
        return Bound(lambda v: (np.ascontiguousarray(v[:, :n]),), lambda q: q[..., :n], lambda q, v: ((q - v) ** 2).sum(axis=1))
    if name.startswith("first"):
        n = int(name[5:])
        return Bound(lambda v: (_leading(v[:, :n], 7),), lambda q: q[..., :n], lambda q, v: ((q - v) ** 2).sum(axis=1))
    raise KeyError(name)
