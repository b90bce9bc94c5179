"""Table contracts: type, rule, key and transition checks over whole tables.

A contract is a list of field contracts::

    {"name": "email", "type": "email", "required": True, "rules": ["not empty", "length < 120"]}

``check`` compiles every (field, check) into one boolean Column and evaluates
all of them in a single pass over the table; the result is a long
violations table ``(row_key, field, check)`` built with
``explode(filter(array(...)))`` on the executors, and ``summary`` is one
aggregate over it. Uniqueness uses an aggregate of duplicate values joined
back (partial aggregation and AQE skew handling cope with hot values; no
window puts a hot value in one task).

Semantics follow the source validator: a value is checked against its
semantic type and then against each rule; rules are matched by prefix in a
fixed order and unknown rules pass; a rule that cannot be evaluated on a
value fails. Nulls: a required field that is null is one ``required``
violation; type and rule checks skip nulls.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES: patterns, extension sets, time zones and default rules of the source validator
URL_PATTERN = (r"^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|"
               r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$")
MAC_PATTERN = r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$"
COLOR_HEX = r"^#([A-Fa-f0-9]{6}|[A-Fa-f0-9]{3})$"
COLOR_RGB = r"^rgb\(\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\)$"
VERSION_PATTERN = r"^\d+\.\d+\.\d+(-\w+)?$"
COMMON_TIMEZONES = ["UTC", "GMT", "EST", "PST", "CST", "MST"]
EXTENSIONS = {
    "pdf": [".pdf"], "word_doc": [".doc", ".docx"], "excel": [".xls", ".xlsx"], "powerpoint": [".ppt", ".pptx"],
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg"], "video": [".mp4", ".avi", ".mov", ".wmv", ".flv"],
    "audio": [".mp3", ".wav", ".ogg", ".m4a", ".flac"],
}
DEFAULT_RULES = {
    "string": ["not empty", "length > 0", "length < 1000"],
    # the source lists "positive" and "min 0" together, which rejects 0; "positive" is kept
    "integer": ["positive", "max 2147483647"],
    "float": ["positive", "min 0.0"],
    "email": ["contains @", "contains .", "not empty"],
    "url": ["starts with http", "not empty"],
    "password": ["length > 8", "not empty"],
    "phone_number": ["length > 10", "not empty"],
    "percentage": ["min 0", "max 100"],
    "price": ["positive", "min 0"],
    "latitude": ["min -90", "max 90"],
    "longitude": ["min -180", "max 180"],
    "status_code": ["min 100", "max 599"],
    "uuid": ["length = 36"],
    "json": ["not empty"],
    "array": ["not empty"],
    "dictionary": ["not empty"],
}
RULE_ORDER = ["length >", "length <", "length =", "min", "max", "not empty", "positive", "negative", "non-negative",
              "has", "contains", "starts with", "ends with", "matches", "in range", "unique", "alphanumeric",
              "alphabetic", "numeric"]
VALID_STATUS_TRANSITIONS = {
    "pending": ["ready", "cancelled", "queued", "scheduled"],
    "queued": ["ready", "cancelled"],
    "scheduled": ["ready", "cancelled"],
    "ready": ["in_progress", "blocked", "cancelled", "running", "processing", "executing"],
    "in_progress": ["completed", "failed", "paused", "blocked", "success", "finished"],
    "running": ["completed", "failed", "paused", "success", "finished"],
    "processing": ["completed", "failed", "paused", "success", "finished"],
    "executing": ["completed", "failed", "paused", "success", "finished"],
    "blocked": ["ready", "cancelled", "waiting"],
    "waiting": ["ready", "cancelled"],
    "paused": ["in_progress", "cancelled", "running"],
    "suspended": ["ready", "cancelled"],
    "on_hold": ["ready", "cancelled"],
    "under_review": ["approved", "rejected"],
    "approved": ["ready", "in_progress"],
    "rejected": ["cancelled", "pending"],
    "retrying": ["in_progress", "failed", "running"],
    "retry_pending": ["retrying", "cancelled"],
    "timeout": ["retrying", "failed", "cancelled"],
    "aborted": ["pending", "cancelled"],
    "completed": [],
    "success": [],
    "finished": [],
    "failed": ["retrying", "retry_pending"],
    "error": ["retrying", "retry_pending"],
    "cancelled": [],
}
# end FIXED VALUES

EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"  # a documented subset of full address validation
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
_H = "[0-9A-Fa-f]{1,4}"


def _ipv6() -> str:
    """Eight groups of hex digits, the last two possibly an IPv4 address; one run of zero groups may be "::"."""
    last = f"({_H}:{_H}|{IPV4[1:-1]})"
    forms = [f"({_H}:){{6}}{last}"]
    for n in range(7):  # groups after "::", by how many (at most) stand before it
        before = f"(({_H}:){{0,{n - 1}}}{_H})?" if n else ""
        forms.append(f"{before}::({_H}:){{{5 - n}}}{last}" if n <= 5 else f"{before}::{_H}")
    forms.append(f"(({_H}:){{0,6}}{_H})?::")
    return "^(" + "|".join(forms) + ")$"


IPV6 = _ipv6()
#: A full date, with a time of hours at least, a fraction and an offset if given.
DATE_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}:\d{2})?)?$"
UUID_PATTERN = r"^([0-9A-Fa-f]{8}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{12})$"


def _numeric(dt) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                           T.DecimalType))


def _integral(dt) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _lit_false() -> Column:
    return F.lit(False)


def _strip(txt: Column) -> Column:
    """Whitespace stripped on both ends (as the source's ``str.strip``; Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(txt, r"^\s+|\s+$", "")


def type_check(c: Column, dt, semantic: str) -> Column:
    """True when a non-null value is valid for ``semantic``."""
    s = semantic.lower()
    txt = c.cast("string")
    is_str = isinstance(dt, T.StringType)
    num = _numeric(dt)
    if s in ("string", "clob", "encrypted_data", "unit_of_measure"):
        return F.lit(is_str)
    if s == "integer":
        return F.lit(_integral(dt))
    if s == "float":
        return F.lit(isinstance(dt, (T.FloatType, T.DoubleType)))
    if s in ("decimal", "metric"):
        return F.lit(num)
    if s == "boolean":
        return F.lit(isinstance(dt, T.BooleanType))
    if s == "date":
        return (txt.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_timestamp(txt, F.lit("yyyy-M-d")).isNotNull()) \
            if is_str else F.lit(isinstance(dt, T.DateType))
    if s == "time":
        return txt.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$") if is_str else _lit_false()
    if s == "date_time":
        return (txt.rlike(DATE_TIME) & F.try_to_timestamp(F.replace(txt, F.lit("Z"), F.lit("+00:00"))).isNotNull()) if is_str \
            else F.lit(isinstance(dt, (T.TimestampType, T.TimestampNTZType)))
    if s == "timestamp":
        return (c > 0) if num else _lit_false()
    if s == "duration":
        return (c >= 0) if num else _lit_false()
    if s == "timezone":
        return txt.isin(COMMON_TIMEZONES) | txt.contains("+") | txt.contains("-")
    if s == "json":
        if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
            return F.lit(True)
        return F.json_object_keys(txt).isNotNull() | F.json_array_length(txt).isNotNull() if is_str else _lit_false()
    if s in ("array", "list"):
        return F.lit(isinstance(dt, T.ArrayType)) if not is_str else F.json_array_length(txt).isNotNull()
    if s in ("dictionary", "object"):
        return F.lit(isinstance(dt, (T.MapType, T.StructType))) if not is_str else F.json_object_keys(txt).isNotNull()
    if s == "csv":
        return (txt.contains("\n") & txt.contains(",")) if is_str else _lit_false()
    if s == "html":
        return (F.lower(txt).contains("<html>") | txt.endswith(".html")) if is_str else _lit_false()
    if s == "markdown":
        return (txt.endswith(".md") | txt.contains("#") | txt.contains("*")) if is_str else _lit_false()
    if s in EXTENSIONS:
        low = F.lower(txt)
        cond = _lit_false()
        for ext in EXTENSIONS[s]:
            cond = cond | low.endswith(ext)
        return cond if is_str else _lit_false()
    if s == "url":
        return txt.rlike("(?i)" + URL_PATTERN)
    if s == "email":
        return txt.rlike(EMAIL_PATTERN)
    if s == "ip_address":
        return txt.rlike(IPV4) | txt.rlike(IPV6)
    if s == "mac_address":
        return txt.rlike(MAC_PATTERN)
    if s == "uuid":
        return F.regexp_replace(txt, r"^(urn:uuid:|\{)|\}$", "").rlike(UUID_PATTERN)
    if s == "database_record":
        if isinstance(dt, T.StructType):
            return F.lit("id" in dt.fieldNames())
        if isinstance(dt, T.MapType):
            return F.map_contains_key(c, F.lit("id"))
        return _lit_false()
    if s in ("primary_key", "foreign_key"):
        if is_str:
            return txt != ""
        return (c != 0) if _integral(dt) else _lit_false()
    if s == "coordinate":
        if isinstance(dt, T.ArrayType) and _numeric(dt.elementType):
            return F.size(c) == 2
        return _lit_false()
    if s == "latitude":
        return c.between(-90, 90) if num else _lit_false()
    if s == "longitude":
        return c.between(-180, 180) if num else _lit_false()
    if s == "address":
        return (F.length(_strip(txt)) > 5) if is_str else _lit_false()
    if s in ("postal_code", "message"):
        return (~txt.rlike(r"^\s*$")) if is_str else _lit_false()
    if s == "currency":
        return txt.rlike(r"^\p{L}{3}$") if is_str else _lit_false()
    if s in ("price", "quantity"):
        return (c >= 0) if num else _lit_false()
    if s == "percentage":
        return c.between(0, 100) if num else _lit_false()
    if s == "password":
        return (F.length(txt) >= 8) if is_str else _lit_false()
    if s in ("token", "api_key"):
        return (F.length(txt) > 10) if is_str else _lit_false()
    if s == "hash":
        return (F.length(txt) >= 32) if is_str else _lit_false()
    if s == "phone_number":
        cleaned = F.regexp_replace(txt, r"[^\d+]", "")
        return (F.length(cleaned) >= 10) & (cleaned.startswith("+") | cleaned.rlike(r"^\d+$"))
    if s == "color_code":
        return txt.rlike(COLOR_HEX) | txt.rlike(COLOR_RGB)
    if s == "version_number":
        return txt.rlike(VERSION_PATTERN)
    if s == "status_code":
        return c.between(100, 599) if _integral(dt) else _lit_false()
    if s == "binary" or s == "blob":
        return F.lit(isinstance(dt, T.BinaryType))
    return F.lit(True)  # types without a check (and unknown types) pass


_RANGE = re.compile(r"^\s*(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)\s*$")


def rule_check(c: Column, dt, rule: str) -> Column:
    """True when a non-null value satisfies ``rule`` (I14); unknown rules pass."""
    key = next((k for k in RULE_ORDER if rule.startswith(k)), None)
    if key is None:
        return F.lit(True)
    param = rule.replace(key, "", 1).strip()
    txt = c.cast("string")
    num = _numeric(dt)
    dbl = c.cast("double") if num else txt.try_cast("double")
    if key == "length >":
        return F.length(txt) > int(param)
    if key == "length <":
        return F.length(txt) < int(param)
    if key == "length =":
        return F.length(txt) == int(param)
    if key == "min":
        return F.coalesce(dbl >= float(param), F.lit(False))
    if key == "max":
        return F.coalesce(dbl <= float(param), F.lit(False))
    if key == "not empty":
        if num:
            return c != 0
        if isinstance(dt, (T.ArrayType, T.MapType)):
            return F.size(c) > 0
        if isinstance(dt, T.BooleanType):
            return c
        return ~txt.rlike(r"^\s*$")
    if key == "positive":
        return (c > 0) if num else F.lit(False)
    if key == "negative":
        return (c < 0) if num else F.lit(False)
    if key == "non-negative":
        return (c >= 0) if num else F.lit(False)
    if key == "has":
        if isinstance(dt, T.MapType):
            return F.map_contains_key(c, F.lit(param))
        if isinstance(dt, T.StructType):
            return F.lit(param in dt.fieldNames())
        return F.lit(False)
    if key == "contains":
        return txt.contains(param)
    if key == "starts with":
        return txt.startswith(param)
    if key == "ends with":
        return txt.endswith(param)
    if key == "matches":
        return txt.rlike("^(?:" + param + ")")
    if key == "in range":
        m = _RANGE.match(param)
        if not m:
            return F.lit(True) if "-" not in param else F.lit(False)
        lo, hi = float(m.group(1)), float(m.group(2))
        return F.coalesce(dbl.between(lo, hi), F.lit(False))
    if key == "unique":
        return (F.size(F.array_distinct(c)) == F.size(c)) if isinstance(dt, T.ArrayType) else F.lit(True)
    if key == "alphanumeric":
        return txt.rlike(r"^[\p{L}\p{N}]+$")
    if key == "alphabetic":
        return txt.rlike(r"^\p{L}+$")
    if key == "numeric":
        return txt.rlike(r"^\p{N}+$")
    return F.lit(True)


def checks_for(df: DataFrame, contract: list[dict]) -> list[tuple[str, str, Column]]:
    """(field, check name, violation Column) for every check of the contract."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for fc in contract:
        name = fc["name"]
        if name not in schema:
            if fc.get("required", True):
                out.append((name, "required", F.lit(True)))
            continue
        c, dt = F.col(name), schema[name]
        if fc.get("required", True):
            out.append((name, "required", c.isNull()))
        if fc.get("type"):
            out.append((name, f"type {fc['type']}", c.isNotNull() & ~F.coalesce(type_check(c, dt, fc["type"]),
                                                                              F.lit(False))))
        rules = fc.get("rules")
        if rules is None and fc.get("default_rules"):
            rules = DEFAULT_RULES.get(str(fc.get("type", "")).lower(), ["not empty"])
        for r in rules or []:
            if r.strip() == "unique" and not isinstance(dt, T.ArrayType):
                continue  # column uniqueness is a table-level check, see ``duplicates``
            out.append((name, r, c.isNotNull() & ~F.coalesce(rule_check(c, dt, r), F.lit(False))))
    return out


def violations(df: DataFrame, contract: list[dict], key: str) -> DataFrame:
    """Long table ``(row_key, field, check)``: one row per failed check (I17), one pass over ``df``."""
    checks = checks_for(df, contract)
    uniq = [fc["name"] for fc in contract if ("unique" in (fc.get("rules") or []) or fc.get("unique")) and fc["name"] in df.columns]
    entry = "array<struct<field:string,check:string,bad:boolean,digest:binary>>"
    found = [F.struct(F.lit(f), F.lit(n), v, F.lit(None)) for f, n, v in checks] + [_unique_entry(df, u) for u in uniq]
    bad = F.filter(F.array(*found).cast(entry), lambda x: x["bad"])
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.explode(bad).alias("v")).select("row_key", "v.field", "v.check", "v.digest")
    if not uniq:
        return rows.drop("digest")
    repeated = repeated_values(df, uniq).withColumnsRenamed({"field": "_f", "digest": "_d"})
    met = rows.join(repeated, (rows["field"] == repeated["_f"]) & (rows["digest"] == repeated["_d"]), "left")
    return met.filter(F.col("digest").isNull() | F.col("_d").isNotNull()).select("row_key", "field", "check")


def _unique_entry(df: DataFrame, column: str) -> Column:
    """What a value of a unique column sends on: its md5 digest, if it is not null."""
    text = F.to_json(F.struct(column)) if isinstance(df.schema[column].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(column).cast("string")
    return F.struct(F.lit(column), F.lit("unique"), F.col(column).isNotNull(), F.unhex(F.md5(text)))


def repeated_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, digest`` of the values that occur more than once, for all unique columns by one scan and one shuffle
    of 16-byte digests. They are dealt out before they are counted: a count by the scan's tasks would hold nearly every
    digest of a task's file part in memory, and the values of a unique column have next to nothing to combine. No task
    counts more digests than its share of ``spark.sql.shuffle.partitions``; of a hot value it holds one count."""
    entries = F.array(*[_unique_entry(df, c) for c in columns]).cast("array<struct<field:string,check:string,bad:boolean,digest:binary>>")
    each = df.select(F.explode(F.filter(entries, lambda x: x["bad"])).alias("v")).select("v.field", "v.digest")
    dealt = each.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "field", "digest")
    return dealt.groupBy("field", "digest").count().filter(F.col("count") > 1).select("field", "digest")


def duplicates(df: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose ``column`` value occurs more than once."""
    return violations(df, [{"name": column, "required": False, "rules": ["unique"]}], key)


def summary(df: DataFrame, contract: list[dict]) -> DataFrame:
    """Per (field, check): failed row count, in one aggregate over ``df`` (no violations table needed)."""
    checks = checks_for(df, contract)
    aggs = [F.sum(v.cast("int")).alias(f"c{i}") for i, (_f, _n, v) in enumerate(checks)]
    wide = df.agg(F.count("*").alias("rows"), *aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(n).alias("check"),
                                         F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("bigint").alias("failed"))
                                for i, (f, n, _v) in enumerate(checks)]))
    return wide.select("rows", stack.alias("s")).select("s.field", "s.check", "s.failed", "rows")


def transition_violations(df: DataFrame, entity: str, ts: str, status: str, allowed: dict[str, list[str]],
                          order_tiebreak: str | None = None) -> DataFrame:
    """Consecutive status pairs per entity that are not allowed.

    Each row is paired with the entity's previous row by (ts, tiebreak) using
    a skew-safe lag: a hot entity is split by time bucket or, for an order key
    that is no timestamp, by ranges of the key, and is not sorted in one task.
    The allowed pairs are a literal table (its size is that of the transition
    list); a ``left_anti`` join keeps the illegal pairs.
    """
    from .timeseries import bucketed_lag, ranged_lag
    cols = [entity, ts, *([order_tiebreak] if order_tiebreak else []), status]
    d = df.select(*cols)
    if isinstance(d.schema[ts].dataType, (T.TimestampType, T.TimestampNTZType)):
        lagged = bucketed_lag(d, entity, ts, [status], tiebreak=order_tiebreak)
    else:
        lagged = ranged_lag(d, entity, ts, [status], tiebreak=order_tiebreak)
    pairs = (lagged.filter(F.col("prev_" + status).isNotNull())
             .select(*cols[:-1], F.col("prev_" + status).alias("from_status"), F.col(status).alias("to_status")))
    spark = df.sparkSession
    ok = spark.createDataFrame([(a, b) for a, bs in allowed.items() for b in bs],
                               "from_status string, to_status string")
    return pairs.join(ok, ["from_status", "to_status"], "left_anti")


def coverage(requirements: DataFrame, req_key: str, story_links: DataFrame, epic_links: DataFrame) -> DataFrame:
    """Per requirement, stories and epics that list it; pct = min(100, 25 * count); gap text.

    Links are normalised ``(item, req)`` pairs (explode list columns first); counts
    are aggregated per requirement before the two left joins, so no list of an
    unbounded size is built.
    """
    s = story_links.groupBy(F.col("req").alias(req_key)).agg(F.count_distinct("item").alias("stories"))
    e = epic_links.groupBy(F.col("req").alias(req_key)).agg(F.count_distinct("item").alias("epics"))
    r = (requirements.select(req_key).join(s, req_key, "left").join(e, req_key, "left")
         .fillna(0, ["stories", "epics"]))
    pct = F.least(F.lit(100.0), (F.col("stories") + F.col("epics")) * F.lit(25.0))
    return r.select(req_key, "stories", "epics", pct.alias("coverage_percentage"),
                    F.when(pct < 100.0, F.concat(F.lit("Only "), pct.cast("string"), F.lit("% covered")))
                    .alias("gap"))


def coverage_lists(requirements: DataFrame, req_key: str, story_links: DataFrame, epic_links: DataFrame, page_size: int = 1000) -> DataFrame:
    """The items that list each requirement, as ``(requirement, kind, page, ids)``: kind is story or epic, and the ids
    of one requirement are dealt to pages of about ``page_size`` by a hash of the id, ascending within a page, so the list
    of a requirement that a third of all items name is many rows and many tasks. A requirement without items of a kind has
    one page without ids; an item that lists it twice counts once; links to unknown requirements and null ids are left out."""
    links = story_links.select("item", "req", F.lit("story").alias("kind")).unionByName(epic_links.select("item", "req", F.lit("epic").alias("kind")))
    links = links.where("item IS NOT NULL").distinct()
    pages = links.groupBy("req", "kind").agg(F.ceil(F.count(F.lit(1)) / page_size).alias("pages"))
    page = F.pmod(F.conv(F.substring(F.md5(F.col("item").cast("string")), 1, 8), 16, 10).cast("long"), F.col("pages"))
    lists = (links.join(pages, ["req", "kind"]).select(F.col("req").alias("_req"), "kind", page.alias("page"), "item")
             .groupBy("_req", "kind", "page").agg(F.array_sort(F.collect_list("item")).alias("ids")))
    every = requirements.select(F.col(req_key).alias("requirement")).distinct().withColumn("kind", F.explode(F.array(F.lit("story"), F.lit("epic"))))
    met = every.join(lists.withColumnRenamed("kind", "_kind"), (F.col("requirement") == F.col("_req")) & (F.col("kind") == F.col("_kind")), "left")
    return met.select("requirement", "kind", F.coalesce("page", F.lit(0)).cast("long").alias("page"), F.coalesce("ids", F.array()).alias("ids"))


def search(df: DataFrame, query: str, fields: list[str], status_col: str | None = None,
           status: str | None = None) -> DataFrame:
    """Case-insensitive substring match in any of ``fields``, optional status filter."""
    q = query.lower()
    cond = F.lit(False)
    for f in fields:
        cond = cond | F.lower(F.col(f)).contains(q)
    out = df.filter(cond)
    if status_col and status is not None:
        out = out.filter(F.col(status_col) == status)
    return out
