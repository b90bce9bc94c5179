"""Column specifications for generated streams and batches.

A spec is a list of dicts, one per output column::

    {"name": "amount", "type": "decimal(10,2)", "min": 0.5, "max": 15000, "random": True}

Options (one value source per column):

* ``expr``      Spark SQL text, may use earlier columns; must be deterministic
* ``values``    list; sequential cycling by row id, or ``random``/``weights``
* ``min``/``max`` numeric range; random uniform or sequential cycling
* ``begin``/``end``/``interval`` date or timestamp steps (``days=1``, ``hours=6``)
* ``parts``     concatenation of literals and numeric sub-draws
  (``{"min": 0, "max": 9999, "pad": 4}``), e.g. device ids and IPv4 text
* ``uuid``      deterministic v4-shaped text
* ``probability`` boolean ``u < p``

Modifiers: ``random``, ``weights``, ``unique_values`` (at most k distinct),
``template`` (``\\0`` is replaced by the base value), ``percent_nulls``
(0..100), ``omit`` (usable by later columns, dropped from the output),
``base_column`` (derive from another column instead of the row id) and
``type`` (any Spark SQL type, cast at the end).

Everything is keyed on a row id, so the same (seed, id) yields the same row
in any partitioning, and a stream continues ids across micro-batches.
"""

from __future__ import annotations

import functools
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, _parse_datatype_string

from .hashing import (decimal_between_sql, float_between_sql, h60, h60_sql, int_between_sql, padded,
                      padded_sql, pick_sql, sql_literal, unif_sql, uuid_sql, weighted_pick_sql)

#: Calls and keywords whose value is that of the moment or the session; Spark counts them as deterministic within one query.
_OF_THE_MOMENT = re.compile(r"\b(?:(?:now|curdate|user|version|current_timezone|current_catalog|current_schema|current_database)\s*\(|"
                            r"(?:current_date|current_timestamp|current_time|current_user|localtimestamp|session_user)\b|"
                            r"(?:unix_timestamp|to_unix_timestamp)\s*\(\s*\))", re.I)
_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`")
_NON_DETERMINISTIC = re.compile(r"\b(rand|randn|random|uuid|shuffle|uniform|randstr)\s*\(", re.I)
_INTERVAL = re.compile(r"^\s*(days|hours|minutes|seconds|weeks)\s*=\s*(\d+)\s*$")
_INT_TYPES = {"int", "integer", "bigint", "long", "smallint", "short", "tinyint", "byte"}
_FLOAT_TYPES = {"float", "double", "real"}


class SpecError(ValueError):
    pass


@functools.lru_cache(maxsize=256)
def _parse_type(t: str):
    try:
        return _parse_datatype_string(t)
    except Exception as e:  # noqa: BLE001 - report any parse failure the same way
        raise SpecError(f"unknown type {t!r}: {e}") from None


def _interval_seconds(text: str) -> int:
    m = _INTERVAL.match(text or "days=1")
    if not m:
        raise SpecError(f"bad interval {text!r}; use e.g. 'days=1'")
    unit, n = m.group(1), int(m.group(2))
    return n * {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}[unit]


def _epoch(text: str) -> int:
    dt = datetime.fromisoformat(text)
    if dt.tzinfo is None:
        dt = dt.replace(tzinfo=timezone.utc)
    return int(dt.timestamp())


def validate(spec: list[dict]) -> None:
    """Static checks that do not need a session (names, weights, types)."""
    seen = set()
    for c in spec:
        n = c.get("name")
        if not n:
            raise SpecError("every column needs a name")
        if n in seen:
            raise SpecError(f"duplicate column {n!r}")
        seen.add(n)
        _parse_type(c.get("type", "string"))
        if c.get("weights") is not None:
            if not c.get("values") or len(c["weights"]) != len(c["values"]):
                raise SpecError(f"{n}: weights must match values")
        bare = _QUOTED.sub("''", c.get("expr") or "")
        if (_NON_DETERMINISTIC.search(bare) or _OF_THE_MOMENT.search(bare)) and not c.get("unseeded"):
            raise SpecError(f"{n}: expression is not deterministic; set unseeded=True to allow it")
        pn = c.get("percent_nulls")
        if pn is not None and not 0 <= pn <= 100:
            raise SpecError(f"{n}: percent_nulls must be in 0..100")
        if c.get("base_column") and c["base_column"] not in seen:
            raise SpecError(f"{n}: base_column {c['base_column']!r} must be an earlier column")


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_expr(c: dict, seed, key: Column | str, fast: bool = False) -> Column:
    """Value expression of one spec column, before null injection and cast.

    Built as one Spark SQL expression (one JVM call) when the key is a column
    name; foreign-key parts over a parent's row count keep a Column for the
    scalar subquery.
    """
    c = dict(c)
    for a, b in (("min_value", "min"), ("max_value", "max")):
        if a in c and b not in c:
            c[b] = c[a]
    name = c["name"]
    dtype = _parse_type(c.get("type", "string"))
    tname = dtype.simpleString()
    key_sql = _ident(key) if isinstance(key, str) else None
    if key_sql is None:
        raise SpecError("column_expr needs the key as a column name")
    driver = _ident(c["base_column"]) if c.get("base_column") else key_sql
    rnd = bool(c.get("random")) or c.get("weights") is not None
    k = c.get("unique_values")

    def u(tag: str = "") -> str:
        return unif_sql(seed, name + tag, driver, fast=fast)

    def draw(tag: str = "") -> str:
        x = u(tag)
        return f"(FLOOR({x} * {int(k)}) / {float(k)!r}D)" if k else x

    if c.get("expr"):
        return F.expr(c["expr"])
    if c.get("uuid"):
        return F.expr(uuid_sql(seed, name, driver))
    if c.get("person"):
        from . import pools
        return F.expr(f"concat_ws(' ', {pick_sql(u('#first'), pools.FIRST_NAMES)}, "
                      f"{pick_sql(u('#last'), pools.LAST_NAMES)})")
    if c.get("probability") is not None:
        return F.expr(f"({u()} < {float(c['probability'])!r}D)")
    if c.get("parts") is not None:
        pieces: list[Column] = []
        sql_run: list[str] = []
        for i, p in enumerate(c["parts"]):
            if isinstance(p, dict) and p.get("mod") is not None:
                if sql_run:
                    pieces.append(F.expr("concat(" + ", ".join(sql_run) + ")"))
                    sql_run = []
                v = F.pmod(h60(seed, f"{name}#{i}", F.expr(driver)), p["mod"]) + F.lit(int(p.get("offset", 1)))
                pieces.append(padded("", v, int(p["pad"])) if p.get("pad") else v.cast("string"))
                continue
            if isinstance(p, dict):
                if "col" in p:      # an existing key column (e.g. a fixture foreign key)
                    v = f"(CAST({_ident(p['col'])} AS BIGINT) + {int(p.get('offset', 0))})"
                else:
                    v = int_between_sql(u(f"#{i}"), int(p["min"]), int(p["max"]))
                sql_run.append(padded_sql("", v, int(p["pad"])) if p.get("pad") else f"CAST({v} AS STRING)")
            else:
                sql_run.append(sql_literal(str(p)))
        if sql_run:
            pieces.append(F.expr("concat(" + ", ".join(sql_run) + ")"))
        return pieces[0] if len(pieces) == 1 else F.concat(*pieces)
    if c.get("values") is not None:
        vals = c["values"]
        if rnd:
            return F.expr(weighted_pick_sql(draw(), vals, c.get("weights")))
        base = f"CAST({driver} AS BIGINT)" if not c.get("base_column") else h60_sql(seed, name, driver, fast=fast)
        idx = f"pmod({base}, {len(vals)})"
        if k:
            idx = f"pmod({idx}, {min(int(k), len(vals))})"
        arr = "array(" + ", ".join(sql_literal(v) for v in vals) + ")"
        return F.expr(f"element_at({arr}, CAST({idx} + 1 AS INT))")
    if c.get("begin") is not None:
        lo, hi = _epoch(c["begin"]), _epoch(c.get("end") or c["begin"])
        step = _interval_seconds(c.get("interval", "days=1"))
        steps = max(0, (hi - lo) // step)
        idx = int_between_sql(draw(), 0, steps) if rnd else f"pmod(CAST({driver} AS BIGINT), {steps + 1})"
        ts = f"timestamp_seconds({lo} + {idx} * {step})"
        return F.expr(f"CAST({ts} AS DATE)" if tname == "date" else ts)
    if c.get("min") is not None or c.get("max") is not None:
        lo = c.get("min", 0)
        hi = c.get("max", lo)
        if not rnd:
            span = int(hi) - int(lo) + 1
            base = f"pmod(CAST({driver} AS BIGINT), {span})"
            if k:
                base = f"pmod({base}, {int(k)})"
            return F.expr(f"({int(lo)} + {base})")
        if isinstance(dtype, DecimalType):
            return F.expr(decimal_between_sql(draw(), lo, hi, dtype.precision, dtype.scale))
        if tname in _FLOAT_TYPES:
            return F.expr(float_between_sql(draw(), float(lo), float(hi)))
        return F.expr(int_between_sql(draw(), int(lo), int(hi)))
    # no value source: the row id itself (or k distinct hashed values)
    if k:
        return F.expr(f"CAST(FLOOR({u()} * {int(k)}) AS BIGINT)")
    return F.expr(driver)


def _deterministic(df: DataFrame) -> bool:
    return bool(df._jdf.queryExecution().analyzed().deterministic())  # noqa: SLF001


def apply_spec(df: DataFrame, spec: list[dict], key: str = "id", seed=42,
               keep: list[str] | None = None, fast: bool = False) -> DataFrame:
    """Add the spec's columns to ``df``.

    Columns are added in as few ``select``s as dependencies allow: every
    column that only reads the key and input columns goes into one projection;
    an ``expr`` or ``base_column`` column that may read columns of the pending
    projection starts the next one. Few, wide projections keep the analysed
    plan shallow (chained ``withColumn`` re-analyses the plan per column).
    ``keep`` lists input columns to carry through (default: none but the spec's).
    ``fast=True`` draws with ``xxhash64`` instead of md5: several times cheaper,
    same distributions, but the values are Spark-specific (no SQL oracle).
    """
    validate(spec)
    out = df
    omitted = [c["name"] for c in spec if c.get("omit")]
    pending: list[tuple[str, Column]] = []

    def flush(frame: DataFrame) -> DataFrame:
        if not pending:
            return frame
        names = {n for n, _ in pending}
        kept = [F.col(c) for c in frame.columns if c not in names]
        frame = frame.select(*kept, *[v.alias(n) for n, v in pending])
        pending.clear()
        return frame

    for c in spec:
        if (c.get("expr") or c.get("base_column")) and pending:
            out = flush(out)
        v = column_expr(c, seed, key, fast=fast)
        if c.get("template") is not None:
            v = F.replace(F.lit(c["template"]), F.lit("\\0"), v.cast("string"))
        pn = c.get("percent_nulls")
        if pn:
            v = F.when(F.expr(f"{unif_sql(seed, c['name'] + '#null', _ident(key), fast=fast)} >= {pn / 100.0!r}D"), v)
        pending.append((c["name"], v.cast(c.get("type", "string"))))
    out = flush(out)
    # whatever an expression calls, the analysed plan knows whether it is deterministic
    if any(c.get("expr") for c in spec) and not any(c.get("unseeded") for c in spec) and _deterministic(df) and not _deterministic(out):
        raise SpecError("an expression is not deterministic; set unseeded=True to allow it")
    names = [c["name"] for c in spec if c["name"] not in omitted]
    return out.select(*(keep or []), *names)


def generate(spark: SparkSession, spec: list[dict], rows: int, partitions: int | None = None,
             seed=42, offset: int = 0, fast: bool = False) -> DataFrame:
    """``rows`` generated rows with global ids ``offset .. offset+rows-1``."""
    base = spark.range(offset, offset + rows, 1, partitions) if partitions else spark.range(offset, offset + rows)
    return apply_spec(base, spec, key="id", seed=seed, fast=fast)


def trial(spark: SparkSession, spec: list[dict], seed=42) -> dict:
    """Validate a spec by analysing its plan; returns schema and one sample row (JSON)."""
    try:
        df = generate(spark, spec, 1, 1, seed)
        schema = df.schema
        sample = df.select(F.to_json(F.struct("*")).alias("j")).first()["j"]
        return {"valid": True, "schema": schema.simpleString(), "sample": sample}
    except Exception as e:  # noqa: BLE001 - the error text is the result
        return {"valid": False, "error": str(e).splitlines()[0]}


def to_records(df: DataFrame, ts: Column | None = None, ts_name: str = "event_timestamp") -> DataFrame:
    """Whole row as one JSON text column ``value``, with an ISO-8601 UTC timestamp field."""
    if ts is not None:
        df = df.withColumn(ts_name, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
