"""Reduced-precision number formats as Column arithmetic on doubles.

Spark SQL has no access to a float's bits, so each format is computed from its
definition: the exponent is the floor of log2 (corrected at powers of two) and
the significand is rounded in units of the last place.  All builders take and
give scalar Columns, keep NaN, and are used inside ``transform``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Compensation added to the doubled significand of an approximate
# square, by the leading bits of the significand.
SQUARE_8 = [4, 36, 100, 158, 98, 50, 18, 2]
SQUARE_16 = [1, 9, 25, 49, 81, 121, 166, 145, 113, 85, 61, 41, 25, 13, 5, 0]
SQUARE_FP8 = [0, 0, 0, 1, 1, 1, 0, 0]
SQUARE_FP32 = [32768, 294912, 819200, 1296579, 802816, 409600, 147456, 16384]

#: Fractional bits and total bits of the fixed-point sums.
Q3_14, Q3_13 = (14, 17), (13, 16)


def lit(x: float) -> Column:
    return F.lit(float(x))


def pow2(e: Column) -> Column:
    return F.pow(lit(2), e)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: a Column that is used twice would be evaluated twice inside a lambda."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def exponent(a: Column) -> Column:
    """floor(log2(a)) of a positive, finite number."""
    return let(F.floor(F.log2(a)).cast("double"), lambda e: F.when(pow2(e) > a, e - 1).when(pow2(e + 1) <= a, e + 1).otherwise(e))


def _finite_part(x: Column, f) -> Column:
    """f(|x|) with x's sign; zero, NaN and infinities stay."""
    return let(F.abs(x), lambda a: F.when((a > 0) & (a < lit(float("inf"))), F.signum(x) * f(a)).otherwise(x))


def fp16(x: Column) -> Column:
    """IEEE half precision, ties to even; beyond 65,504 an infinity."""

    def f(a: Column) -> Column:
        rounded = let(pow2(F.greatest(exponent(a), lit(-14)) - 10), lambda unit: F.rint(a / unit) * unit)
        return let(rounded, lambda r: F.when(r >= 65520, lit(float("inf"))).otherwise(r))

    return _finite_part(x, f)


def fp8(x: Column, bits: int, low: float, high: float) -> Column:
    """A saturating 8-bit format with ``bits`` significand bits, least normal ``low`` and largest value ``high``.

    Ties go away from zero; what lies below the normals becomes zero.
    """

    def f(a: Column) -> Column:
        rounded = let(pow2(exponent(a) - bits), lambda unit: F.floor(a / unit + 0.5) * unit)
        return F.when(a < low, lit(0)).when(a > high, lit(high)).otherwise(F.least(rounded, lit(high)))

    return F.when(F.abs(x) == lit(float("inf")), F.signum(x) * high).otherwise(_finite_part(x, f))


def fp8_e4m3(x: Column) -> Column:
    return fp8(x, 3, 2.0**-6, 448.0)


def fp8_e2m5(x: Column) -> Column:
    return fp8(x, 5, 0.5, 6.0)


def fp8_e3m4(x: Column) -> Column:
    return fp8(x, 4, 0.125, 30.0)


#: Exponent and significand bits and exponent bias of the 8-bit formats.
FP8_FIELDS = {"e4m3": (4, 3, 7), "e2m5": (2, 5, 1), "e3m4": (3, 4, 3)}


def fp8_encode(x: Column, kind: str) -> Column:
    """A number's 8-bit encoding: ties to even; below the normals zero, from the highest exponent on the largest code."""
    wide, bits, bias = FP8_FIELDS[kind]
    a, top, one = F.abs(x), (1 << wide) - 1, float(1 << bits)
    e = exponent(a)
    mant = F.rint((a / pow2(e) - 1) * one)
    field = e + bias + F.when(mant >= one, 1.0).otherwise(0.0)
    code = F.when((a < 2.0 ** (1 - bias)) | (a == 0), lit(0)).when((a == lit(float("inf"))) | F.isnan(a) | (field >= top), lit(127)).otherwise(field * one + F.when(mant >= one, 0.0).otherwise(mant))
    return (code + F.when(x < 0, 128).otherwise(0)).cast("int")


def fp8_decode(code: Column, kind: str) -> Column:
    """The number of an 8-bit encoding; exponent 0 is zero."""
    wide, bits, bias = FP8_FIELDS[kind]
    field = F.shiftright(code, bits).bitwiseAND((1 << wide) - 1)
    size = pow2(field.cast("double") - bias) * (1 + code.bitwiseAND((1 << bits) - 1) / float(1 << bits))
    return F.when(field == 0, lit(0)).when(code >= 128, -size).otherwise(size)


def approximate_square(x: Column, bits: int, table: Sequence[int], step: int, low: int, high: int) -> Column:
    """A square without a multiplication.

    The exponent is doubled; so is the ``bits``-bit significand, which then
    gets the table's entry for its leading bits.  Carries go to the exponent.
    Results below 2**low are zero, from 2**high on infinite; so are squares of
    numbers below 2**low or infinite ones.
    """
    one = float(1 << bits)
    entries = F.array(*[lit(t * step) for t in table])

    def f(a: Column) -> Column:
        fields = let(exponent(a), lambda e: F.struct(e.alias("e"), F.floor((a / pow2(e) - 1) * one).cast("double").alias("i")))
        carry = lambda s: (s["i"] * 2 >= one).cast("double")
        twice = let(fields, lambda s: F.struct((2 * s["e"] + carry(s)).alias("e"), (2 * s["i"] - carry(s) * one).alias("m"), s["i"].alias("i")))
        summed = let(twice, lambda s: F.struct(s["e"], (s["m"] + F.get(entries, F.floor(s["i"] / (one / len(table))).cast("int"))).alias("m")))
        return let(summed, lambda s: _assemble(s["e"], s["m"], one, low, high))

    return let(F.abs(x), lambda a: F.when((a >= 2.0**low) & (a < lit(float("inf"))), f(a)).when(a < 2.0**low, lit(0)).otherwise(a))


def _assemble(e: Column, m: Column, one: float, low: int, high: int) -> Column:
    carry = (m >= one).cast("double")
    return F.when(e + carry < low, lit(0)).when(e + carry >= high, lit(float("inf"))).otherwise(pow2(e + carry) * (1 + (m - carry * one) / one))


def square_fp16(x: Column, table: Sequence[int] = SQUARE_8) -> Column:
    """Approximate square of a half-precision value."""
    return approximate_square(x, 10, table, 1, -14, 16)


def square_fp32(x: Column) -> Column:
    return approximate_square(x.cast("float").cast("double"), 23, SQUARE_FP32, 1, -126, 128)


def square_fp8(x: Column) -> Column:
    return approximate_square(x, 23, SQUARE_FP8, 1 << 20, -126, 128)


def square_int16(diff: Column) -> Column:
    """Approximate square of a whole number, clipped to 16 bits, through a half-precision significand."""
    return approximate_square(F.greatest(F.least(diff, lit(32767)), lit(-32768)), 10, SQUARE_8, 1, -14, 16)


def fixed_point(x: Column, q: tuple[int, int]) -> Column:
    """Rounded half up to a saturating unsigned fixed-point number."""
    frac, total = q
    return F.least(F.floor(F.greatest(x, lit(0)) * float(1 << frac) + 0.5), lit((1 << total) - 1)) / float(1 << frac)


def quantise_int(x: Column, most: int) -> Column:
    """x * most, rounded half away from zero, clipped to +-most."""
    y = F.signum(x) * F.floor(F.abs(x) * float(most) + 0.5)
    return F.greatest(F.least(y, lit(most)), lit(-most))


def rtl_square(bits: Column) -> Column:
    """The circuit's square of a half-precision encoding, on bits: doubled magnitude plus a biased correction."""
    magnitude = bits.bitwiseAND(0x7FFF)
    comp = F.get(F.array(*[F.lit(t) for t in SQUARE_16]), F.shiftright(magnitude, 6).bitwiseAND(15))
    return (F.shiftleft(magnitude, 1).bitwiseAND(0x7FFF) + F.lit(0x4400).bitwiseOR(comp)).bitwiseAND(0x7FFF)


def product_table(bits: int = 4) -> list[list[int]]:
    """Compensation of an encoded product by the leading ``bits`` bits of both significands.

    Adding two encodings gives 1 + a + b for (1 + a) * (1 + b).  It misses a * b
    while the product stays below 2, and (1 - a) * (1 - b) / 2, in the next
    binade, beyond.  An entry is that error's mean over the cell's pairs of
    10-bit significands, rounded half up; the last cell gets none.
    """
    n, one = 1 << bits, 1 << 10
    a = np.arange(one, dtype=np.int64)
    # In 1 / (2 * one) of a significand's unit, so all sums are whole.
    missed = np.where(np.add.outer(a, one)[:, None] * np.add.outer(a, one) < 2 * one * one, 2 * a[:, None] * a, (one - a)[:, None] * (one - a))
    cells = missed.reshape(n, one // n, n, one // n).sum(axis=(1, 3))
    unit = 2 * one * (one // n) ** 2
    table = (2 * cells + unit) // (2 * unit)
    table[-1, -1] = 0
    return table.tolist()


def rtl_product(a: Column, b: Column, table: Sequence[Sequence[int]] | None = None) -> Column:
    """The circuit's product of two half-precision encodings: added magnitudes plus a biased correction, 16 bits wide.

    ``table`` is the two-dimensional compensation (default: :func:`product_table`).
    """
    rows = table or product_table()
    flat, n = [x for r in rows for x in r], len(rows)
    index = lambda x: F.shiftright(x, 10 - (n.bit_length() - 1)).bitwiseAND(n - 1)
    comp = F.get(F.array(*[F.lit(x) for x in flat]), (index(a) * n + index(b)).cast("int"))
    total = (a.bitwiseAND(0x7FFF) + b.bitwiseAND(0x7FFF)).bitwiseAND(0xFFFF) + F.lit(0xC400).bitwiseOR(comp)
    return F.shiftleft(F.shiftright(a.bitwiseXOR(b), 15).bitwiseAND(1), 15).bitwiseOR(total.bitwiseAND(0x7FFF))


def fp16_decode(bits: Column) -> Column:
    """The number of a half-precision encoding."""
    e, m = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    size = F.when((e == 31) & (m > 0), lit(float("nan"))).when(e == 31, lit(float("inf"))).when(e == 0, m * 2.0**-24).otherwise((1 + m / 1024.0) * pow2(e.cast("double") - 15))
    return F.when(bits >= 32768, -size).otherwise(size)


def fp16_encode(x: Column, negative: Column | None = None) -> Column:
    """A number's half-precision encoding, ties to even; ``negative`` tells the sign of zeros.  NaN has one encoding."""
    a = F.abs(fp16(x))
    e = F.greatest(exponent(F.when(a > 0, a).otherwise(lit(2.0**-24))), lit(-14))
    unit = pow2(e - 10)
    normal = (e + 15) * 1024 + (a / unit - 1024)
    code = F.when(a == lit(float("inf")), lit(31744)).when(a < 2.0**-14, a / 2.0**-24).otherwise(normal)
    sign = negative if negative is not None else x < 0
    return F.when(F.isnan(x), F.lit(32256)).otherwise((code + F.when(sign, 32768).otherwise(0)).cast("long")).cast("long")


def split_mix(name: str) -> Column:
    """A 64-bit mixing of a long, as an unsigned decimal(20): products wrap, so it is done on unsigned arrays."""

    @F.arrow_udf("decimal(20,0)")
    def mixed(ids: pa.Array) -> pa.Array:
        x = ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return pa.array(x ^ (x >> np.uint64(31))).cast(pa.decimal128(20, 0))

    return mixed(name)


def fnv1a(raw: Column) -> Column:
    """64-bit FNV-1a of bytes, as an unsigned decimal(20)."""

    @F.arrow_udf("decimal(20,0)")
    def digest(values: pa.Array) -> pa.Array:
        out = []
        for v in values:
            h = 0xCBF29CE484222325
            for b in v.as_py() or b"":
                h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
            out.append(h)
        return pa.array(out, pa.uint64()).cast(pa.decimal128(20, 0))

    return digest(raw)
