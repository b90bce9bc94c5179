"""JSON generator rules (tables, nodes, edge properties) compiled to Columns.

A rule is a dict such as ``{"generator": "choice", "values": [...],
"weights": [...]}``. ``rule_column`` turns it into one built-in Spark
expression of the row key, so a table of any size is generated in parallel
with no Python per row and with the same values on every run.

Rules (defaults in brackets): uuid, sequence [prefix "", width 6], choice
[weights optional, empty -> null], range_int [0..100, max inclusive],
range_float [0..100, precision 2], bool [probability 0.5], date
[2023-01-01..2025-12-31, format %Y-%m-%d], timestamp [2023-01-01T00:00:00..
2025-12-31T23:59:59, ISO text], name, email [domain example.com], phone,
address, constant, null_or [null_percent 20, inner rule], and the fallback
random text [length 8, a-z0-9].
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pools
from .hashing import (float_between, int_between, padded, pick, unif, uuid_text,
                      weighted_pick)

_STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh",
    "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a",
    "%a": "EEE", "%A": "EEEE", "%f": "SSSSSS", "%%": "%",
}


def strftime_to_spark(fmt: str) -> str:
    """Translate a strftime format to a Spark datetime pattern."""
    out, lit = [], []
    i = 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in _STRFTIME:
            if lit:
                out.append("'" + "".join(lit).replace("'", "''") + "'")
                lit = []
            out.append(_STRFTIME[tok])
            i += 2
        else:
            lit.append(fmt[i])
            i += 1
    if lit:
        text = "".join(lit)
        out.append(text if all(c in " -:/.,T" for c in text) and "T" not in text
                   else "'" + text.replace("'", "''") + "'")
    return "".join(out)


def _epoch(text: str) -> int:
    dt = datetime.fromisoformat(text)
    if dt.tzinfo is None:
        dt = dt.replace(tzinfo=timezone.utc)
    return int(dt.timestamp())


def _random_seconds(u: Column, start: str, end: str) -> Column:
    lo, hi = _epoch(start), _epoch(end)
    return F.timestamp_seconds(int_between(u, lo, hi))


def rule_column(rule: dict | None, seed, name: str, key: Column, seq: Column) -> Column:
    """Compile one rule for column ``name``.

    ``key`` identifies the row for hashing (any type), ``seq`` is the 1-based
    row number used by ``sequence`` and ``email``.
    """
    rule = rule or {"generator": "random"}
    g = rule.get("generator", "random")

    def u(tag: str = "") -> Column:
        return unif(seed, name + tag, key)

    if g == "uuid":
        return uuid_text(seed, name, key)
    if g == "sequence":
        return padded(rule.get("prefix", ""), seq, int(rule.get("width", 6)))
    if g == "choice":
        values = rule.get("values", [])
        if not values:
            return F.lit(None).cast("string")
        return weighted_pick(u(), values, rule.get("weights"))
    if g == "range_int":
        return int_between(u(), int(rule.get("min", 0)), int(rule.get("max", 100)))
    if g == "range_float":
        v = float_between(u(), float(rule.get("min", 0.0)), float(rule.get("max", 100.0)))
        return F.round(v, int(rule.get("precision", 2)))
    if g == "bool":
        return u() < F.lit(float(rule.get("probability", 0.5)))
    if g == "date":
        ts = _random_seconds(u(), rule.get("start", "2023-01-01"), rule.get("end", "2025-12-31"))
        return F.date_format(ts, strftime_to_spark(rule.get("format", "%Y-%m-%d")))
    if g == "timestamp":
        ts = _random_seconds(u(), rule.get("start", "2023-01-01T00:00:00"),
                             rule.get("end", "2025-12-31T23:59:59"))
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    if g == "name":
        return F.concat_ws(" ", pick(u("#first"), pools.RULE_FIRST_NAMES),
                           pick(u("#last"), pools.RULE_LAST_NAMES))
    if g == "email":
        return F.concat(F.lit("user"), seq.cast("string"), F.lit("@" + rule.get("domain", "example.com")))
    if g == "phone":
        return F.format_string("(%d) %d-%d", int_between(u("#a"), 200, 999),
                               int_between(u("#b"), 200, 999), int_between(u("#c"), 1000, 9999))
    if g == "address":
        return F.concat_ws(" ", int_between(u("#no"), 100, 9999).cast("string"),
                           pick(u("#street"), pools.RULE_STREETS))
    if g == "constant":
        return F.lit(rule.get("value"))
    if g == "null_or":
        inner = rule_column(rule.get("rule", {"generator": "random"}), seed, name + "#inner", key, seq)
        draw = int_between(u("#null"), 1, 100)
        return F.when(draw > F.lit(int(rule.get("null_percent", 20))), inner)
    # fallback: random text over a-z0-9
    length = int(rule.get("length", 8))
    alphabet = F.lit(pools.RULE_ALPHABET)
    n = len(pools.RULE_ALPHABET)
    chars = [F.substring(alphabet, (F.floor(u(f"#{i}") * n) + 1).cast("int"), 1) for i in range(length)]
    return F.concat(*chars) if chars else F.lit("")
