"""The distance registry: name -> how to round inputs, a dimension's term, and how to finish the sum.

Rounding of the inputs happens once a vector, before the join that pairs
vectors; only the term is evaluated for each pair.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numeric as n

Scalar = Callable[[Column], Column]


@dataclass(frozen=True)
class Distance:
    prepare: Scalar  #: of each component (a double that came from a float)
    term: Callable[[Column], Column]  #: of a difference, or of a product if ``product``
    finish: Scalar  #: of the sum
    product: bool = False


def same(x: Column) -> Column:
    return x


def _float(x: Column) -> Column:
    return x.cast("float").cast("double")


def _scaled(rounder: Scalar, by: float) -> Scalar:
    return lambda x: rounder(_float(x * by))


def _over(by: float) -> Scalar:
    return lambda s: s / by / by


square: Scalar = lambda d: d * d

DISTANCES: dict[str, Distance] = {
    "fp32": Distance(same, square, same),
    "ip": Distance(same, same, lambda s: 1 - s, product=True),
    "ip_negative": Distance(same, same, lambda s: -s, product=True),
    "l2_int": Distance(lambda x: F.floor(x).cast("double"), square, same),
    "fp32_fpma": Distance(same, n.square_fp32, same),
    "fp16_true": Distance(n.fp16, lambda d: n.fp16(square(d)), same),
    "fp16_fpma": Distance(n.fp16, n.square_fp16, same),
    "fp16_fpma_16": Distance(n.fp16, lambda d: n.square_fp16(d, n.SQUARE_16), same),
    "fp16_fpma_quantized": Distance(n.fp16, lambda d: n.fixed_point(n.square_fp16(d), n.Q3_14), same),
    "fp8_e4m3": Distance(_scaled(n.fp8_e4m3, 100), square, _over(100)),
    "fp8_e2m5": Distance(_scaled(n.fp8_e2m5, 3), square, _over(3)),
    "fp8_e3m4": Distance(_scaled(n.fp8_e3m4, 15), square, _over(15)),
    "fp8_fpma": Distance(_scaled(n.fp8_e4m3, 100), n.square_fp8, _over(100)),
    "fp8_fpma_e2m5": Distance(_scaled(n.fp8_e2m5, 3), n.square_fp8, _over(3)),
    "fp8_fpma_e3m4": Distance(_scaled(n.fp8_e3m4, 15), n.square_fp8, _over(15)),
    "fp8_fpma_quantized": Distance(same, lambda d: n.fixed_point(n.square_fp8(d), n.Q3_13), same),
    "fp8_fpma_quantized_e2m5": Distance(same, lambda d: n.fixed_point(n.square_fp8(d), n.Q3_13), same),
    "fp8_fpma_quantized_e3m4": Distance(same, lambda d: n.fixed_point(n.square_fp8(d), n.Q3_13), same),
    "int16_diff_fpma": Distance(F.rint, n.square_int16, same),
    "int16": Distance(lambda x: n.quantise_int(x, 32767), square, _over(32767)),
    "int8": Distance(lambda x: n.quantise_int(x, 127), square, _over(127)),
}

#: Differences of these are rounded before the term.
ROUND_DIFFERENCE: dict[str, Scalar] = {
    "fp16_true": n.fp16,
    "fp16_fpma": n.fp16,
    "fp16_fpma_16": n.fp16,
    "fp16_fpma_quantized": n.fp16,
    "fp8_fpma_quantized": lambda d: n.fp8_e4m3(_float(d)),
    "fp8_fpma_quantized_e2m5": lambda d: n.fp8_e2m5(_float(d)),
    "fp8_fpma_quantized_e3m4": lambda d: n.fp8_e3m4(_float(d)),
}


def prepared(name: str, vector: Column) -> Column:
    """The vector as the distance's arithmetic sees it."""
    return F.transform(vector, lambda x: DISTANCES[name].prepare(x.cast("double")))


def between(name: str, a: Column, b: Column) -> Column:
    """Distance of two prepared vectors."""
    d = DISTANCES[name]
    terms = F.zip_with(a, b, (lambda x, y: x * y) if d.product else (lambda x, y: x - y))
    if name in ROUND_DIFFERENCE:
        terms = F.transform(terms, lambda x: ROUND_DIFFERENCE[name](x))
    if d.term is not same:
        terms = F.transform(terms, lambda x: d.term(x))
    return d.finish(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def distance(name: str, a: Column, b: Column) -> Column:
    """Distance of two plain vectors."""
    return between(name, prepared(name, a), prepared(name, b))


def norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def normalized(v: Column) -> Column:
    """Unit length; vectors without a usable length become null."""
    n2 = norm2(v)
    return F.when((n2 > 1e-24) & (n2 < float("inf")), F.transform(v, lambda x: x.cast("double") / F.sqrt(n2)))


def normalized_strict(v: Column, row: Column) -> Column:
    """Unit length; a vector without a usable length fails the query and names its row."""
    n2 = norm2(v)
    return F.when((n2 > 1e-24) & (n2 < float("inf")), F.transform(v, lambda x: x.cast("double") / F.sqrt(n2))).otherwise(F.raise_error(F.concat(F.lit("cannot normalise the vector of row "), row.cast("string"))))


def normalized_clamped(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.greatest(F.sqrt(norm2(v)), F.lit(1e-12)))
