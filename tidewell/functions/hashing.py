"""Seeded, portable pseudo-random values as Spark Column expressions.

Every generated value is a pure function of ``(seed, column name, key)``:

    h(seed, name, key) = first 60 bits of md5("seed:name:key")   (BIGINT)
    u(seed, name, key) = first 52 bits of it / 2**52             (DOUBLE in [0, 1))

so a row does not depend on partitioning, task retries, restarts of a
stream or the engine that evaluates it (the same text hash is available in
SQL engines, which is what the oracle checks use). Everything here is a
built-in expression and stays inside whole-stage codegen; nothing runs in
Python per row.

``fast=True`` swaps md5 for ``xxhash64`` (cheaper, Spark-only).
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

TWO52 = 4503599627370496.0


def _as_col(k) -> Column:
    return k if isinstance(k, Column) else F.col(k)


def key_text(seed, name: str, *keys) -> Column:
    parts = [F.lit(str(seed)), F.lit(name)] + [_as_col(k).cast("string") for k in keys]
    return F.concat_ws(":", *parts)


def h60(seed, name: str, *keys, fast: bool = False) -> Column:
    """Unsigned 60-bit hash as BIGINT in [0, 2**60): wide enough to draw any ordinal of a table by its remainder."""
    if fast:
        return F.pmod(F.xxhash64(F.lit(str(seed)), F.lit(name), *[_as_col(k) for k in keys]),
                      F.lit(1 << 60)).cast("bigint")
    return F.conv(F.substring(F.md5(key_text(seed, name, *keys)), 1, 15), 16, 10).cast("bigint")


def unif(seed, name: str, *keys, fast: bool = False) -> Column:
    """Uniform DOUBLE in [0, 1)."""
    return F.shiftright(h60(seed, name, *keys, fast=fast), 8) / F.lit(TWO52)


def int_between(u: Column, lo: int, hi: int) -> Column:
    """Uniform integer in [lo, hi] (both inclusive) from a uniform ``u``."""
    return (F.lit(lo) + F.floor(u * F.lit(hi - lo + 1))).cast("bigint")


def float_between(u: Column, lo: float, hi: float) -> Column:
    return F.lit(float(lo)) + u * F.lit(float(hi) - float(lo))


def decimal_between(u: Column, lo, hi, precision: int, scale: int) -> Column:
    """Uniform value on the grid of ``decimal(precision, scale)`` in [lo, hi].

    The value is drawn as an integer number of units of 10**-scale, so no
    double rounding is involved and any engine gets the same digits.
    """
    step = Decimal(1).scaleb(-scale)
    lo_u = int((Decimal(str(lo)) / step).to_integral_value())
    hi_u = int((Decimal(str(hi)) / step).to_integral_value())
    units = int_between(u, lo_u, hi_u).cast(DecimalType(38, 0))
    return (units * F.lit(step)).cast(DecimalType(precision, scale))


def sql_literal(v) -> str:
    """A Python scalar as Spark SQL literal text."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_literal(values: Sequence) -> Column:
    """A literal array built from one SQL expression (one call to the JVM, not one per element)."""
    return F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")


def pick(u: Column, values: Sequence) -> Column:
    """Uniform choice from a literal list."""
    return F.element_at(array_literal(values), (F.floor(u * F.lit(len(values))) + 1).cast("int"))


def weighted_pick(u: Column, values: Sequence, weights: Sequence[float] | None) -> Column:
    """Choice with (integer or float) weights via cumulative thresholds of ``u * total``."""
    if not values:
        return F.lit(None)
    if not weights:
        return pick(u, values)
    if len(weights) != len(values):
        raise ValueError("weights and values must have the same length")
    total = float(sum(weights))
    x = u * F.lit(total)
    acc = 0.0
    expr = None
    for v, w in zip(values[:-1], weights[:-1]):
        acc += float(w)
        expr = (F.when(x < F.lit(acc), F.lit(v)) if expr is None else expr.when(x < F.lit(acc), F.lit(v)))
    last = F.lit(values[-1])
    return last if expr is None else expr.otherwise(last)


def padded(prefix: str, n: Column, width: int) -> Column:
    """``prefix`` + n left-padded with zeros; never truncates (unlike bare lpad)."""
    s = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0")))


def uuid_text(seed, name: str, *keys) -> Column:
    """Deterministic version-4 shaped UUID text from md5 of the key."""
    m = F.md5(key_text(seed, name, *keys))
    return F.concat_ws(
        "-",
        F.substring(m, 1, 8), F.substring(m, 9, 4),
        F.concat(F.lit("4"), F.substring(m, 14, 3)),
        F.concat(F.substring(F.lit("89ab"), (F.conv(F.substring(m, 17, 1), 16, 10).cast("int") % 4) + 1, 1),
                 F.substring(m, 18, 3)),
        F.substring(m, 21, 12),
    )


# --- the same recipe as Spark SQL text ------------------------------------------------
# Building a column from one SQL expression costs one JVM call instead of one per
# operator, which keeps plan construction cheap for wide generated tables. The
# semantics are identical to the Column functions above (double literals carry D).
def _q(s: str) -> str:
    return sql_literal(str(s))


def h60_sql(seed, name: str, *key_sql: str, fast: bool = False) -> str:
    if fast:  # Spark-only: xxhash64 of the same parts, reduced to 60 bits
        keys = ", ".join(key_sql)
        return f"pmod(xxhash64({_q(seed)}, {_q(name)}, {keys}), {1 << 60})"
    keys = ", ".join(f"CAST({k} AS STRING)" for k in key_sql)
    return f"CAST(conv(substring(md5(concat_ws(':', {_q(seed)}, {_q(name)}, {keys})), 1, 15), 16, 10) AS BIGINT)"


def unif_sql(seed, name: str, *key_sql: str, fast: bool = False) -> str:
    return f"(shiftright({h60_sql(seed, name, *key_sql, fast=fast)}, 8) / 4503599627370496.0D)"


def int_between_sql(u: str, lo: int, hi: int) -> str:
    return f"CAST({int(lo)} + FLOOR({u} * {int(hi) - int(lo) + 1}) AS BIGINT)"


def float_between_sql(u: str, lo: float, hi: float) -> str:
    return f"({float(lo)!r}D + {u} * {float(hi) - float(lo)!r}D)"


def decimal_between_sql(u: str, lo, hi, precision: int, scale: int) -> str:
    step = Decimal(1).scaleb(-scale)
    lo_u = int((Decimal(str(lo)) / step).to_integral_value())
    hi_u = int((Decimal(str(hi)) / step).to_integral_value())
    return (f"CAST(CAST({int_between_sql(u, lo_u, hi_u)} AS DECIMAL(38,0)) * CAST({step} AS DECIMAL({max(scale, 1)},{scale})) "
            f"AS DECIMAL({precision},{scale}))")


def pick_sql(u: str, values: Sequence) -> str:
    arr = "array(" + ", ".join(sql_literal(v) for v in values) + ")"
    return f"element_at({arr}, CAST(FLOOR({u} * {len(values)}) + 1 AS INT))"


def weighted_pick_sql(u: str, values: Sequence, weights: Sequence[float] | None) -> str:
    if not values:
        return "NULL"
    if not weights:
        return pick_sql(u, values)
    if len(weights) != len(values):
        raise ValueError("weights and values must have the same length")
    total = float(sum(weights))
    x = f"({u} * {total!r}D)"
    acc, arms = 0.0, []
    for v, w in zip(values[:-1], weights[:-1]):
        acc += float(w)
        arms.append(f"WHEN {x} < {acc!r}D THEN {sql_literal(v)}")
    if not arms:
        return sql_literal(values[-1])
    return f"CASE {' '.join(arms)} ELSE {sql_literal(values[-1])} END"


def padded_sql(prefix: str, n_sql: str, width: int) -> str:
    s = f"CAST({n_sql} AS STRING)"
    return f"concat({_q(prefix)}, lpad({s}, greatest({int(width)}, length({s})), '0'))"


def uuid_sql(seed, name: str, *key_sql: str) -> str:
    keys = ", ".join(f"CAST({k} AS STRING)" for k in key_sql)
    m = f"md5(concat_ws(':', {_q(seed)}, {_q(name)}, {keys}))"
    return (f"concat_ws('-', substring({m}, 1, 8), substring({m}, 9, 4), concat('4', substring({m}, 14, 3)), "
            f"concat(substring('89ab', (CAST(conv(substring({m}, 17, 1), 16, 10) AS INT) % 4) + 1, 1), "
            f"substring({m}, 18, 3)), substring({m}, 21, 12))")
