"""DuckDB text for number formats and distances: the oracles of the distance queries.

Long-form instead of arrays: one row a dimension, each step a column that later
steps of the same SELECT refer to.
"""

from __future__ import annotations

Steps = list[tuple[str, str]]


def exponent(p: str, a: str) -> Steps:
    return [(f"{p}0", f"floor(log2(greatest({a}, 1e-300)))"), (p, f"CASE WHEN pow(2.0, {p}0) > {a} THEN {p}0 - 1 WHEN pow(2.0, {p}0 + 1) <= {a} THEN {p}0 + 1 ELSE {p}0 END")]


def fp16(p: str, x: str) -> Steps:
    return [
        (f"{p}a", f"abs({x})"), *exponent(f"{p}e", f"{p}a"), (f"{p}u", f"pow(2.0, greatest({p}e, -14) - 10)"), (f"{p}r", f"round_even({p}a / {p}u, 0) * {p}u"),
        (p, f"CASE WHEN {p}a = 0 THEN 0 WHEN {p}r >= 65520 THEN sign({x}) * 'inf'::DOUBLE ELSE sign({x}) * {p}r END"),
    ]


def fp8(p: str, x: str, bits: int, low: float, high: float) -> Steps:
    return [
        (f"{p}a", f"abs({x})"), *exponent(f"{p}e", f"{p}a"), (f"{p}u", f"pow(2.0, {p}e - {bits})"),
        (p, f"sign({x}) * CASE WHEN {p}a < {low} THEN 0 WHEN {p}a > {high} THEN {high} ELSE least(floor({p}a / {p}u + 0.5) * {p}u, {high}) END"),
    ]


E4M3, E2M5, E3M4 = (3, 2.0**-6, 448.0), (5, 0.5, 6.0), (4, 0.125, 30.0)
# The compensation of approximate squares, written apart from those that the queries use.
T8, T16, T8F, T32 = "[4, 36, 100, 158, 98, 50, 18, 2]", "[1, 9, 25, 49, 81, 121, 166, 145, 113, 85, 61, 41, 25, 13, 5, 0]", "[0, 0, 0, 1048576, 1048576, 1048576, 0, 0]", "[32768, 294912, 819200, 1296579, 802816, 409600, 147456, 16384]"


def square(p: str, x: str, bits: int, table: str, n: int, low: int, high: int) -> Steps:
    one = float(1 << bits)
    return [
        (f"{p}a", f"abs({x})"), *exponent(f"{p}e", f"{p}a"), (f"{p}m", f"floor(({p}a / pow(2.0, {p}e) - 1) * {one})"),
        (f"{p}s", f"CASE WHEN {p}m * 2 >= {one} THEN {p}m * 2 - {one} ELSE {p}m * 2 END + {table}[floor({p}m / {one / n})::INTEGER + 1]"),
        (f"{p}f", f"2 * {p}e + CASE WHEN {p}m * 2 >= {one} THEN 1 ELSE 0 END + CASE WHEN {p}s >= {one} THEN 1 ELSE 0 END"),
        (p, f"CASE WHEN {p}a < pow(2.0, {low}) OR {p}f < {low} THEN 0 WHEN {p}f >= {high} THEN 'inf'::DOUBLE ELSE pow(2.0, {p}f) * (1 + CASE WHEN {p}s >= {one} THEN {p}s - {one} ELSE {p}s END / {one}) END"),
    ]


def sq16(table: str = T8, n: int = 8) -> Steps:
    return square("t", "d", 10, table, n, -14, 16)


def _fixed(frac: int, total: int) -> Steps:
    return [("z", f"least(floor(greatest(t, 0) * {float(1 << frac)} + 0.5), {float((1 << total) - 1)}) / {float(1 << frac)}")]


def _scaled8(by: float, kind) -> Steps:
    return [("y", f"(x * {float(by)})::FLOAT::DOUBLE"), *fp8("p", "y", *kind)]


HALF = fp16("p", "x")
DIFF16 = fp16("d", "a - b")
PLAIN: Steps = [("d", "a - b"), ("t", "d * d")]
SQ8 = [("d", "a - b"), *square("t", "d", 23, T8F, 8, -126, 128)]

#: name -> (steps on a component x, its prepared name, steps on a and b, the term's name, what is done to the sum)
RECIPES: dict[str, tuple[Steps, str, Steps, str, str]] = {
    "fp32": ([], "x", PLAIN, "t", "{s}"),
    "ip": ([], "x", [("t", "a * b")], "t", "1 - {s}"),
    "ip_negative": ([], "x", [("t", "a * b")], "t", "-({s})"),
    "l2_int": ([("p", "floor(x)")], "p", PLAIN, "t", "{s}"),
    "fp32_fpma": ([], "x", [("d", "(a::FLOAT - b::FLOAT)::DOUBLE"), *square("t", "d", 23, T32, 8, -126, 128)], "t", "{s}"),
    "fp16_true": (HALF, "p", [*DIFF16, ("w", "d * d"), *fp16("t", "w")], "t", "{s}"),
    "fp16_fpma": (HALF, "p", [*DIFF16, *sq16()], "t", "{s}"),
    "fp16_fpma_16": (HALF, "p", [*DIFF16, *sq16(T16, 16)], "t", "{s}"),
    "fp16_fpma_quantized": (HALF, "p", [*DIFF16, *sq16(), *_fixed(14, 17)], "z", "{s}"),
    "fp8_e4m3": (_scaled8(100, E4M3), "p", PLAIN, "t", "{s} / 100.0 / 100.0"),
    "fp8_e2m5": (_scaled8(3, E2M5), "p", PLAIN, "t", "{s} / 3.0 / 3.0"),
    "fp8_e3m4": (_scaled8(15, E3M4), "p", PLAIN, "t", "{s} / 15.0 / 15.0"),
    "fp8_fpma": (_scaled8(100, E4M3), "p", SQ8, "t", "{s} / 100.0 / 100.0"),
    "fp8_fpma_e2m5": (_scaled8(3, E2M5), "p", SQ8, "t", "{s} / 3.0 / 3.0"),
    "fp8_fpma_e3m4": (_scaled8(15, E3M4), "p", SQ8, "t", "{s} / 15.0 / 15.0"),
    "fp8_fpma_quantized": ([], "x", [("g", "(a - b)::FLOAT::DOUBLE"), *fp8("d", "g", *E4M3), *square("t", "d", 23, T8F, 8, -126, 128), *_fixed(13, 16)], "z", "{s}"),
    "fp8_fpma_quantized_e2m5": ([], "x", [("g", "(a - b)::FLOAT::DOUBLE"), *fp8("d", "g", *E2M5), *square("t", "d", 23, T8F, 8, -126, 128), *_fixed(13, 16)], "z", "{s}"),
    "fp8_fpma_quantized_e3m4": ([], "x", [("g", "(a - b)::FLOAT::DOUBLE"), *fp8("d", "g", *E3M4), *square("t", "d", 23, T8F, 8, -126, 128), *_fixed(13, 16)], "z", "{s}"),
    "int16_diff_fpma": ([("p", "round_even(x, 0)")], "p", [("d", "greatest(least(a - b, 32767), -32768)"), *sq16()], "t", "{s}"),
    "int16": ([("p", "greatest(least(sign(x) * floor(abs(x) * 32767.0 + 0.5), 32767), -32767)")], "p", PLAIN, "t", "{s} / 32767.0 / 32767.0"),
    "int8": ([("p", "greatest(least(sign(x) * floor(abs(x) * 127.0 + 0.5), 127), -127)")], "p", PLAIN, "t", "{s} / 127.0 / 127.0"),
}


def _columns(steps: Steps) -> str:
    return "".join(f", {e} AS {n}" for n, e in steps)


def all_pairs(name: str, scale: float = 1.0, where: str = "q.vec_id % 25 = 0", base: str = "embeddings") -> str:
    """SELECT of qid, vec_id, d over every pair."""
    before, x, steps, term, finish = RECIPES[name]
    value = "x" if scale == 1.0 else f"x * {scale}"
    return f"""
SELECT qid, vec_id, {finish.format(s='sum(v)')} AS d FROM (
  SELECT qid, vec_id, {term} AS v FROM (
    SELECT *{_columns(steps)} FROM (
      SELECT q.vec_id AS qid, v.vec_id, q.x AS a, v.x AS b FROM (
        SELECT vec_id, i, {x} AS x FROM (SELECT *{_columns(before)} FROM (SELECT vec_id, i, {value} AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)))
      ) q JOIN (
        SELECT vec_id, i, {x} AS x FROM (SELECT *{_columns(before)} FROM (SELECT vec_id, i, {value} AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM {base})))
      ) v USING (i) WHERE {where}
    )
  )
) GROUP BY qid, vec_id"""


def topk(select: str, k: int = 10) -> str:
    return f"SELECT qid, rank::INTEGER AS rank, vec_id, round(d + 1e-12, 6) + 0.0 AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM ({select})) WHERE rank <= {k}"
