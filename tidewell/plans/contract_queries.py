"""§2.I table contracts applied to the fixture tables.

Each query checks a whole table in one pass and reports failed-row counts
per (field, check); the violation rows themselves stay on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts as C
from ..sources.fixtures import Tables

DOCUMENT_CONTRACT = [
    {"name": "doc_id", "type": "primary_key", "rules": ["unique"]},
    {"name": "text", "type": "string", "rules": ["not empty", "length < 1000", "contains http", "matches [A-Z]"]},
    {"name": "lang", "type": "string", "rules": ["length = 2", "alphabetic"]},
    {"name": "source", "type": "string", "rules": ["starts with src", "alphanumeric"]},
    {"name": "n_chars", "type": "integer", "rules": ["positive", "max 20000", "in range 1-5000"]},
]

PAGE_CONTRACT = [
    {"name": "page_id", "type": "primary_key"},
    {"name": "url", "type": "url", "rules": ["starts with https", "ends with .com"]},
    {"name": "html", "type": "html", "rules": ["contains <body", "length > 100", "markdown-free"]},
]

EVENT_CONTRACT = [
    {"name": "event_id", "type": "primary_key", "rules": ["unique"]},
    {"name": "ts", "type": "date_time"},
    {"name": "user_id", "type": "integer", "rules": ["positive"]},
    {"name": "event_type", "type": "string", "rules": ["matches (click|view|purchase|signup)", "numeric"]},
    {"name": "value", "type": "price", "rules": ["max 100", "in range 0-50", "in range -5-5"]},
    {"name": "props", "type": "json", "rules": ["contains \"k\"", "length > 9"]},
]

CONVERSATION_CONTRACT = [
    {"name": "conv_id", "type": "integer", "default_rules": True},
    {"name": "turn", "type": "integer", "default_rules": True},
    {"name": "role", "type": "string", "default_rules": True},
    {"name": "text", "type": "string", "default_rules": True},
]

# transitions of the events stream checked by I18 (a parameter of the check, not source data)
EVENT_FLOW = {
    "signup": ["view", "click", "signup"],
    "view": ["view", "click", "purchase", "error"],
    "click": ["view", "click", "purchase", "error"],
    "purchase": ["view", "click", "purchase"],
    "error": ["view", "click", "error"],
}


def _counts(v: DataFrame) -> DataFrame:
    return v.groupBy("field", "check").agg(F.count("*").alias("failed")).orderBy("field", "check")


def i_documents(t: Tables) -> DataFrame:
    return _counts(C.violations(t.documents, DOCUMENT_CONTRACT, "doc_id"))


def i_pages(t: Tables) -> DataFrame:
    return _counts(C.violations(t.pages, PAGE_CONTRACT, "page_id"))


def i_events(t: Tables) -> DataFrame:
    return _counts(C.violations(t.events, EVENT_CONTRACT, "event_id"))


def i_conversations_default_rules(t: Tables) -> DataFrame:
    """I16: default rules per semantic type (string, integer) on the conversations table."""
    df = t.conversations
    return C.summary(df, CONVERSATION_CONTRACT).filter(F.col("failed") > 0).drop("rows")


def i_event_transitions(t: Tables) -> DataFrame:
    bad = C.transition_violations(t.events, "user_id", "ts", "event_type", EVENT_FLOW, order_tiebreak="event_id")
    return bad.groupBy("from_status", "to_status").agg(F.count("*").alias("violations")).orderBy(
        "from_status", "to_status")


def i_event_transitions_by_id(t: Tables) -> DataFrame:
    """I18 with an order key that is no timestamp: the events of a user in the order of event_id."""
    bad = C.transition_violations(t.events, "user_id", "event_id", "event_type", EVENT_FLOW)
    return bad.groupBy("from_status", "to_status").agg(F.count("*").alias("violations")).orderBy("from_status", "to_status")


ORDER_CONTRACT = [
    {"name": "o_orderkey", "rules": ["unique"]},
    {"name": "o_custkey", "rules": ["unique"]},
    {"name": "o_orderdate", "rules": ["unique"]},
    {"name": "o_totalprice", "rules": ["unique"]},
]


def i_orders_unique(t: Tables) -> DataFrame:
    """Four unique columns of one table, by one scan and one shuffle besides the check scan."""
    return _counts(C.violations(t.orders, ORDER_CONTRACT, "o_orderkey"))


def i_requirement_coverage(t: Tables) -> DataFrame:
    """I19 over the fixtures: parts are requirements, orders are stories, suppliers are epics."""
    li = t.lineitem
    stories = li.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("req"))
    epics = li.select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("req"))
    return C.coverage(t.part, "p_partkey", stories, epics)


def i_requirement_lists(t: Tables) -> DataFrame:
    """I19, the id lists: orders and suppliers of each part in pages of about 16, as comma-separated ids."""
    li = t.lineitem
    lists = C.coverage_lists(t.part, "p_partkey", li.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("req")),
                             li.select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("req")), page_size=16)
    return lists.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


def i_text_search(t: Tables, query: str = "ING", lang: str = "en") -> DataFrame:
    """Documents whose text or source contains the query (any case), restricted to one language."""
    return C.search(t.documents, query, ["text", "source"], "lang", lang).select("doc_id", "lang", "n_chars")


def i_sample_rows(t: Tables) -> DataFrame:
    """A realistic value per semantic type for each row key (types with a generator rule)."""
    from ..functions.rules import rule_column
    by_type = {"uuid": {"generator": "uuid"}, "email": {"generator": "email"}, "phone_number": {"generator": "phone"},
               "address": {"generator": "address"}, "date": {"generator": "date"},
               "date_time": {"generator": "timestamp"}, "boolean": {"generator": "bool"},
               "integer": {"generator": "range_int"}, "float": {"generator": "range_float"},
               "string": {"generator": "name"}}
    k = F.col("doc_id")
    return t.documents.select("doc_id", *[rule_column(r, "42/sample", n, k, k + 1).cast("string").alias(n)
                                         for n, r in by_type.items()])


EMBEDDING_CONTRACT = [
    {"name": "vec_id", "type": "primary_key", "rules": ["unique"]},
    {"name": "embedding", "type": "array", "rules": ["not empty", "unique"]},
    {"name": "label", "type": "integer", "rules": ["in range 0-9", "non-negative", "max 5"]},
]

CONVERSATION_TEXT_CONTRACT = [
    {"name": "role", "type": "string", "rules": ["matches (user|assistant)", "alphabetic"]},
    {"name": "text", "type": "message", "rules": ["length > 200"]},
    {"name": "text_as_csv", "type": "csv"},
    {"name": "text_as_markdown", "type": "markdown"},
    {"name": "text_as_json", "type": "json"},
]


def i_embeddings(t: Tables) -> DataFrame:
    """I5 (collections) and integer rules on the embeddings table."""
    return _counts(C.violations(t.embeddings, EMBEDDING_CONTRACT, "vec_id"))


def i_conversation_text(t: Tables) -> DataFrame:
    """I4 (structured-text types) and I12 (message) on conversation turns."""
    df = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("turn_key"), "role", "text",
                                F.col("text").alias("text_as_csv"), F.col("text").alias("text_as_markdown"),
                                F.col("text").alias("text_as_json"))
    return _counts(C.violations(df, CONVERSATION_TEXT_CONTRACT, "turn_key"))


DEVICE_CONTRACT = [
    {"name": "day", "type": "date"},
    {"name": "clock", "type": "time"},
    {"name": "zone", "type": "timezone"},
    {"name": "ip", "type": "ip_address"},
    {"name": "mac", "type": "mac_address"},
    {"name": "device", "type": "uuid"},
    {"name": "contact", "type": "email"},
    {"name": "manual", "type": "pdf"},
    {"name": "photo", "type": "image"},
    {"name": "sound", "type": "audio"},
    {"name": "lat", "type": "latitude"},
    {"name": "lon", "type": "longitude"},
    {"name": "point", "type": "coordinate"},
    {"name": "token", "type": "token"},
    {"name": "digest", "type": "hash"},
    {"name": "colour", "type": "color_code"},
    {"name": "firmware", "type": "version_number"},
    {"name": "status", "type": "status_code"},
    {"name": "currency", "type": "currency"},
    {"name": "place", "type": "postal_code", "required": False},
]
_FILE = "concat(event_type, '_', user_id, element_at(array('.pdf', '.PNG', '.mp3', '.docx', '.jpeg', '.exe', ''), cast(event_id % 7 as int) + 1))"
#: A device record made of an event's columns: values in each type's form, some of them out of it.
DEVICE = {
    "day": "concat('2024-', event_id % 14, '-', user_id % 33)",
    "clock": "concat(event_id % 26, ':', lpad(cast(user_id % 60 as string), 2, '0'), ':', event_id % 62)",
    "zone": "if(event_id % 5 = 0, 'CEST', if(event_id % 5 = 1, '+02:00', 'UTC'))",
    "ip": "concat(10, '.', user_id % 300, '.', event_id % 256, '.', event_id % 260)",
    "mac": "concat('02:00:5E:10:', hex(event_id % 256), if(event_id % 9 = 0, '-', ':'), lpad(hex(user_id % 256), 2, '0'))",
    "device": "concat(substr(md5(props), 1, 8), '-', substr(md5(props), 9, 4), '-', substr(md5(props), 13, 4), '-', substr(md5(props), 17, 4), '-', substr(md5(props), 21, 7 + cast(event_id % 6 as int)))",
    "contact": "concat(event_type, if(event_id % 4 = 0, '.at.', '@'), 'site', user_id, if(event_id % 10 = 3, '', '.org'))",
    "manual": _FILE, "photo": _FILE, "sound": _FILE,
    "lat": "value - 100", "lon": "value * 2 - 200",
    "point": "if(event_id % 3 = 0, array(value, value, value), array(value, -value))",
    "token": "substr(md5(props), 1, cast(event_id % 20 as int))",
    "digest": "substr(md5(props), 1, 28 + cast(event_id % 6 as int))",
    "colour": "if(event_id % 2 = 0, concat('#', lpad(lower(hex(user_id)), cast(event_id % 7 as int), '0')), concat('rgb(', event_id % 256, ', ', user_id, if(event_id % 3 = 0, ')', ', 7)')))",
    "firmware": "concat(user_id % 9, '.', event_id % 12, if(event_id % 4 = 0, '', '.3'), if(event_id % 5 = 0, '-rc1', ''))",
    "status": "90 + event_id % 600",
    "currency": "substr('EURO', 1, 1 + cast(event_id % 4 as int))",
    "place": "if(event_id % 3 = 0, null, if(event_id % 3 = 1, ' ', concat('D-', user_id)))",
}


def i_device_records(t: Tables) -> DataFrame:
    """Dates, network, file-name, geographic, secret-like and patterned types on device records."""
    df = t.events.select("event_id", *(F.expr(e).alias(c) for c, e in DEVICE.items()))
    return _counts(C.violations(df, DEVICE_CONTRACT, "event_id"))
