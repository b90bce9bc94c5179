"""Secret scan: fixed patterns, and a token-efficiency test that exposes random strings.

Patterns (kinds ``assign``, ``access``, ``hex``) find keyword assignments, access key ids and long hexadecimal runs. The
token-efficiency test (kind ``random``) looks at runs of base-64 or identifier characters of `LEAST` or more: a byte-pair
vocabulary spells words of any language it has seen, names and program identifiers with few tokens, and random strings with
about one token for every one or two characters. A run of `RATIO` characters a token or fewer is a span if its characters
also look drawn from an alphabet: letters and digits mixed, or upper and lower case that alternate as no camel case does.

Left out before the test, as known digests and identifiers: hexadecimal runs of the length of a common digest (32, 40, 56,
64, 96, 128) and runs behind a digest's name (``sha256:``, ``sha512-``, ``md5=``); UUIDs; dates and times; IBANs with valid
check digits; parts of mail addresses; inline ``;base64,`` data; ascending or repeating sequences; and, within a web
address, the address itself (each of its parts is tested alone). A run that overlaps a span of the patterns is not added
again.

A text is scanned whole in the task that reads it: one projection, no shuffle, so neither a hot source nor copies matter.
Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans; repeated rows are scanned
alike; all other columns, ids included, pass through untouched.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fresh

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
LEAST, RATIO, MIXED_RATIO = 16, 2.1, 1.7

ASSIGN = re.compile("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LONG_HEX = re.compile("[0-9a-f]{24}")

RUN = re.compile(f"[A-Za-z0-9+/_=-]{{{LEAST},}}")
EDGE = "+/_=-"
ONLY_HEX = re.compile("(?:0[xX])?([0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
DIGEST_NAME = re.compile("(?:md5|sha-?(?:1|224|256|384|512)|blake2[bs]|crc32|digest|checksum|commit|;base64)[\"']?\\x20?[:=,-]?\\x20?[\"']?$", re.I | re.A)
DIGEST_START = re.compile("(?:md5|sha(?:1|224|256|384|512))[-=_]", re.I | re.A)
UUID = re.compile("[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
DATE = re.compile("(?:19|20)[0-9]{2}-?(?:0[1-9]|1[0-2])-?(?:0[1-9]|[12][0-9]|3[01])[T_-]?[0-9Zz_+-]*")
IBAN = re.compile("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
ADDRESS = re.compile("[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\\s\"'<>]+")
SWITCH = re.compile("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each pattern; matches that are too short are dropped, not searched again."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    at = LONG_HEX.search(text)
    while at:
        m = HEX.match(text, at.start())
        out.append(("hex", *m.span()))
        at = LONG_HEX.search(text, m.end())
    return out


def _valid_iban(run: str) -> bool:
    return int("".join(str(int(c, 36)) for c in run[4:] + run[:4])) % 97 == 1


def _sequence(run: str) -> bool:
    """Mostly steps of nought or one between neighbours, or few distinct characters."""
    near = sum(abs(ord(a) - ord(b)) <= 1 for a, b in zip(run, run[1:]))
    return len(set(run.lower())) < 8 or near > len(run) // 3


def known(run: str, before: str, after: str) -> bool:
    """Whether ``run`` is a digest or an identifier of a known form; ``before`` and ``after`` are its surroundings."""
    m = ONLY_HEX.fullmatch(run)
    return bool((m and len(m.group(1)) in DIGEST_LENGTHS) or UUID.fullmatch(run) or DATE.fullmatch(run)
                or DIGEST_NAME.search(before) or DIGEST_START.match(run) or (IBAN.fullmatch(run) and _valid_iban(run))
                or after.startswith("@") or before.endswith("@") or _sequence(run))


class Scanner:
    """``spans(text)``: (kind, start, end, characters a token or None), by start and then kind."""

    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("secret_scan", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ratio(self, run: str) -> float:
        return len(run) / len(self.encoding.encode_ordinary(run))

    def random(self, run: str) -> float | None:
        """Characters a token of a run that looks drawn from an alphabet, or None."""
        digits = sum(map(str.isdigit, run))
        letters = sum(map(str.isalpha, run))
        if digits and letters >= 3:
            most = RATIO
        elif len(SWITCH.findall(run)) >= 0.3 * (len(run) - 1):
            most = MIXED_RATIO
        else:
            return None
        ratio = self.ratio(run)
        return ratio if ratio <= most else None

    def _runs(self, text: str) -> Iterator[tuple[int, int]]:
        links = [m.span() for m in ADDRESS.finditer(text)] if "://" in text else []
        k = 0
        for m in RUN.finditer(text):
            while k < len(links) and links[k][1] <= m.start():
                k += 1
            parts = [m.span()]
            if k < len(links) and links[k][0] < m.end():
                parts = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(f"[^/=]{{{LEAST},}}", m.group())]
            for a, b in parts:
                run = text[a:b]
                a += len(run) - len(run.lstrip(EDGE))
                b -= len(run) - len(run.rstrip("+/_-"))
                if b - a >= LEAST:
                    yield a, b

    def spans(self, text: str | None) -> list[tuple[str, int, int, float | None]]:
        if not text:
            return []
        out: list[tuple[str, int, int, float | None]] = [(*s, None) for s in pattern_spans(text)]
        fixed = sorted((a, b) for _, a, b, _ in out)
        k = 0
        for a, b in self._runs(text):
            while k < len(fixed) and fixed[k][1] <= a:
                k += 1
            if (k < len(fixed) and fixed[k][0] < b) or known(text[a:b], text[max(0, a - 16): a], text[b: b + 1]):
                continue
            ratio = self.random(text[a:b])
            if ratio is not None:
                out.append(("random", a, b, ratio))
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_scanners: dict[tuple[str, str], Scanner] = {}


def scanner(ranks: str, pattern: str) -> Scanner:
    """One per worker process and vocabulary."""
    if (ranks, pattern) not in _scanners:
        _scanners[ranks, pattern] = Scanner(ranks, pattern)
    return _scanners[ranks, pattern]


SPANS = "array<struct<kind:string,start:long,end:long,ratio:double>>"


def find_secrets(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end, ratio), ratio for the kind ``random`` only. ``ranks`` is a
    tiktoken rank file and ``pattern`` its split pattern."""
    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        find = scanner(ranks, pattern).spans
        return pd.Series([[dict(zip(("kind", "start", "end", "ratio"), s)) for s in find(t)] for t in texts], dtype=object)

    new = fresh(docs, "_secrets")
    return columns_of(docs.withColumn(new, scan(F.col("text").cast("string"))), docs, {"secrets": F.col(new)})


def redacted(docs: DataFrame, ranks: str, pattern: str, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans are replaced as one."""
    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        find = scanner(ranks, pattern).spans
        out = []
        for t in texts:
            parts, at, end = [], 0, -1
            for _, a, b, _ in find(t):
                if a >= end:
                    parts += [t[at:a], mask]
                at = end = max(end, b)
            out.append(t if not parts else "".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return columns_of(docs, docs, {"text": replace(F.col("text").cast("string"))})


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, the number of spans of each pattern, the digest of the patterns' spans, and all spans as text."""
    found = find_secrets(docs, ranks, pattern)
    base = F.filter("secrets", lambda s: s["kind"] != "random")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
