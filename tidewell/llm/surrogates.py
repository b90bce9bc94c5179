"""Keyed surrogates for personal data and secrets, with DataFrame and SQL functions only.

Detected entities: e-mail addresses, IPv4 and IPv6 addresses, phone, card, social security and bank account numbers,
access keys, passwords and tokens after their keyword (quoted or not), and names after a title: up to four words with
particles, hyphens, apostrophes, inner capitals and initials, in scripts with and without case. The words of a document's
titled names are mentions throughout that document, so a later "Schmidt" without a title goes too. (A Han name that
running text follows without a space has no border: up to four characters go, and later mentions may differ.) A name
that no title ever announces in its document is not found, nor an address after "version". An entity is its type
and normal form (lower case, or its digits or letters without punctuation), so mentions that differ in case or punctuation
are one entity and get one surrogate (coreference), written in the format of each mention.

A surrogate has its entity's type and shape: digits for digits, letters for letters of the same case, hex for hex, valid
octets, valid check digits where the card or bank account has them, the card's first digit, the key's prefix, the mail's
top domain, the country code or trunk zero. A name's words become made-up names of the title's gender, in the script of
the original (those of `SCRIPTS`; Latin for any other), word by word, so a surname is the same with another first name or
title: surnames, and first names by gender, get their surrogates as entities of their own, of which names are then
composed. (A first name after a title without gender is an entity apart from the same name after one with.) Particles
stay; an initial becomes another one by a keyed shift, so initials stay distinct.

Characters come from a keyed hash of (type, normal form, attempt). All distinct entities meet in one table: when two
would share a surrogate, or a surrogate is itself an entity of the texts, all but the least try again with the next
attempt, until none is left, so distinct entities stay distinct over the whole corpus. Later attempts draw from a wider
space (a syllable more each fourth; from the fifth on octets of any width, and more letters or digits in mail addresses
and secrets), so a shape with few forms does not run out of them.

Entities, not texts, are shuffled to assign surrogates; hot entities are combined before the shuffle. Defined results:
null and empty texts stay as they are; texts without entities are unchanged; rows with equal doc_id and text get equal
results; extra columns pass through; the same key gives the same surrogates unless the corpus forces another attempt.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, scratch, with_found

# Titles by gender, and the keywords that announce a secret.
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
TITLES_N = ("Dr", "Prof")
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zur", "bin", "ibn", "al", "ter", "ten", "y")
KEYWORDS = ("password", "passwd", "pwd", "passwort", "contraseña", "token", "secret", "api_key", "apikey", "api-key", "access_key")

_TITLE = "|".join(TITLES_M + TITLES_F + TITLES_N)
_KEYWORD = "|".join(KEYWORDS)
_PARTICLE = "|".join(PARTICLES)
_HAN = r"\p{IsHan}{2,4}"
_WORD = rf"(?:\p{{Lu}}[\p{{L}}\p{{M}}]*(?:['’-]\p{{L}}[\p{{L}}\p{{M}}]*)*(?![\p{{L}}\p{{M}}])|[\p{{Lo}}&&[^\p{{IsHan}}]][\p{{Lo}}\p{{M}}]*(?![\p{{L}}\p{{M}}])|{_HAN})"
_INITIAL = r"\p{Lu}\.(?= )"
_NAME = rf"(?:(?:{_PARTICLE}) )*(?:{_INITIAL} )*{_WORD}(?:(?: {_INITIAL})*(?: (?:{_PARTICLE}))* {_WORD}){{0,3}}"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?:{_GROUP}:){{7}}{_GROUP}|(?=[0-9A-Fa-f:]*[0-9]){_GROUP}(?::{_GROUP}){{0,5}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: In order of precedence; no pattern holds a capturing group.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": rf"(?i:(?<=(?:{_KEYWORD})[\"']{{0,1}}[ ]{{0,3}}[=:][ ]{{0,3}}[\"']{{0,1}}))[A-Za-z0-9_./+=-]{{6,}}",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])(?<![0-9][.-])(?:1[ .-])?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?!(?:[ -]?[0-9]){3}|[0-9]|[.-][0-9])|(?<![0-9])(?<![0-9][ .-])0[1-9][0-9]{1,3}[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9]|[ .-][0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:{_IP6})(?![0-9A-Za-z:]|\.[0-9])",
    "ip": rf"(?<![0-9.])(?<!(?i:version|release) )(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE})\.? {_NAME}",
}
MASTER = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has somewhere; texts without it skip the detailed search.
HINT = rf"[0-9@]|AKIA|ASIA|(?i:{_KEYWORD})|(?:{_TITLE})\.? (?:\p{{Lu}}|\p{{Lo}}|(?:{_PARTICLE}) )"
MOST_ATTEMPTS = 100


def gender(m: Column) -> Column:
    """f, m or n by the title of a name."""
    return F.when(m.rlike(rf"^(?:{'|'.join(TITLES_F)})\.? "), "f").when(m.rlike(rf"^(?:{'|'.join(TITLES_M)})\.? "), "m").otherwise("n")


def is_name(m: Column) -> Column:
    return m.rlike(rf"^(?:{_TITLE})\.? {_NAME}$")


def bare(m: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(m, rf"^(?:{_TITLE})\.? ", "")


def is_unit(word: Column) -> Column:
    """Not a separator, particle or initial."""
    return ~word.rlike(rf"^(?:[ -]|{_PARTICLE}|\p{{L}}\.)$")


def name_words(mentions: Column) -> Column:
    """(word, role) of the names in an array of mentions, longest first: what later mentions of those persons consist of."""
    def of(m: Column) -> Column:
        words = F.split(bare(m), " ")
        return F.flatten(F.transform(words, lambda w, i: F.transform(F.split(w, "-"), lambda p: F.struct(
            (-F.length(p)).alias("order"), p.alias("word"), F.when(i < F.size(words) - 1, F.concat(F.lit("first_"), gender(m))).otherwise("surname").alias("role")))))
    every = F.flatten(F.transform(F.filter(mentions, is_name), of))
    return F.array_sort(F.array_distinct(F.filter(every, lambda w: is_unit(w["word"]) & (w["order"] < -1))))


def word_pattern(words: Column) -> Column:
    """A pattern of those words, as they are and in capitals; words of the Han script stand without spaces. Null without any."""
    def one(w: Column) -> Column:
        t = w["word"]
        return F.when(t.rlike(r"^\p{IsHan}"), t).otherwise(F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), t, F.lit("|"), F.upper(t), F.lit(r")(?![\p{L}\p{M}])")))
    return F.when(F.size(words) > 0, F.concat(F.lit("|"), F.array_join(F.transform(words, one), "|")))


def kind(m: Column) -> Column:
    """The type of a mention, from its own form."""
    titled, named = is_name(m), F.concat(F.lit("name_"), gender(m))
    return (F.when(m.contains("@"), "email").when(titled, named)
            .when(m.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "access_key")
            .when(m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip").when(m.rlike(rf"^(?:{_IP6})$"), "ip6").when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(m.rlike(r"^(?:\+[0-9]|\([0-9]{2,4}\))[0-9 .()-]+$") | m.rlike(r"^(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$") | m.rlike(r"^0[1-9][0-9]{1,3}[ .-][0-9]{3,4}[ .-][0-9]{3,4}$"), "phone").when(m.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), "card")
            .when(m.rlike("^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"), "account").otherwise("secret"))


def normal(m: Column, k: Column) -> Column:
    return (F.when(k.isin("email", "ip6") | (k == "surname") | k.startswith("first"), F.lower(m)).when(k.isin("phone", "card", "ssn"), F.regexp_replace(m, "[^0-9+]", ""))
            .when(k == "account", F.regexp_replace(m, " ", ""))
            .when(k.startswith("name"), F.lower(bare(m))).otherwise(m))


def _draw(n: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _pick(letters: str, *key: Column) -> Column:
    return F.substring(F.lit(letters), _draw(len(letters), *key) + 1, F.lit(1))


DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _shaped(text: Column, h: Column) -> Column:
    """``text`` with every ASCII digit and letter drawn anew within its class; the rest stays."""
    def one(c: Column, i: Column) -> Column:
        return (F.when(c.between("0", "9"), _pick(DIGITS, h, i)).when(c.between("a", "z"), _pick(LOWER, h, i))
                .when(c.between("A", "Z"), _pick(UPPER, h, i)).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _each(text: Column, letters: str, h: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _pick(letters, h, i)), "")


def _octets(text: Column, h: Column, wide: bool) -> Column:
    """Octets of as many digits: 0-9, 10-99 or 100-255; or of any."""
    def one(o: Column, i: Column) -> Column:
        if wide:
            return _draw(256, h, i).cast("string")
        return F.when(F.length(o) == 1, _draw(10, h, i)).when(F.length(o) == 2, _draw(90, h, i) + 10).otherwise(_draw(156, h, i) + 100).cast("string")
    return F.array_join(F.transform(F.split(text, r"\."), one), ".")


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """The check sum, every second digit from the right doubled (the last one first, if ``double_last``)."""
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(i, F.lit(2)) == (0 if double_last else 1), twice).otherwise(d)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda a, d: a + d)


def _card(n: Column, h: Column) -> Column:
    body = F.concat(F.substring(n, 1, 1), _each(F.expr("substring(norm, 2, length(norm) - 2)"), DIGITS, h))
    check = F.pmod(10 - F.pmod(_luhn_sum(body, True), F.lit(10)), F.lit(10)).cast("string")
    valid = F.pmod(_luhn_sum(n, False), F.lit(10)) == 0
    return F.concat(body, F.when(valid, check).otherwise(_pick(DIGITS, h, F.lit(-1))))


def _mod97(text: Column) -> Column:
    """The number that the digits and letters (A 10 to Z 35) spell, modulo 97."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(
        F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)))


def _account(n: Column, h: Column) -> Column:
    """Country code, check digits (valid where the original's are) and the rest drawn by class."""
    country, rest = F.substring(n, 1, 2), _shaped(F.expr("substring(norm, 5)"), h)
    check = F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.expr("substring(norm, 5)"), F.substring(n, 1, 4))) == 1
    return F.concat(country, F.when(valid, check).otherwise(_each(F.substring(n, 3, 2), DIGITS, h)), rest)


def _ip6(n: Column, h: Column, wide: bool) -> Column:
    """Hexadecimal digits for digits, or eight full groups."""
    if wide:
        return F.concat_ws(":", *(F.substring(h, 1 + 4 * i, 4) for i in range(8)))
    return F.array_join(F.transform(F.split(n, ""), lambda c, i: F.when(c == ":", c).otherwise(_pick(HEX, h, i))), "")


#: Letters of made-up names in scripts that are not written with the syllables.
SCRIPTS = {
    "Han": "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗明华伟芳娜敏静丽强磊军洋勇艳杰娟涛超霞平",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにのはひふへほまみむめもやゆよらりるれろ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニノハヒフヘホマミムメモヤユヨラリルレロ",
    "Hangul": "김이박최정강조윤장임민서준지현우수영진호",
    "Arabic": "بتجحدرسشصطعفقكلمنهوي",
    "Hebrew": "אבגדהוזחטילמנסעפקרשת",
    "Devanagari": "कखगघचजटडतदनपबमयरलवसह",
}

#: Syllables of made-up names, and the letters that write them in another script (read in parallel).
SYLLABLES = ("ba", "ra", "mi", "lo", "ne", "da", "vi", "so", "ka", "te", "no", "ri", "la", "me", "do", "si", "ga", "re", "to", "ni")
LATIN, CYRILLIC, GREEK = "abdegiklmnorstv", "абдегиклмнорств", "αβδεγικλμνορστφ"


def _word(w: Column, k: Column, secret: Column, attempt: int) -> Column:
    """A made-up word for a surname, or for a first name by its gender (kinds surname, first_f, first_m, first_n)."""
    h = F.sha2(F.concat_ws("|", secret, k, w, F.lit(str(attempt))), 256)
    syllable = lambda j: F.element_at(F.array(*map(F.lit, SYLLABLES)), _draw(len(SYLLABLES), h, F.lit(j)) + 1)
    end = F.when(k == "first_f", "a").when(k == "first_m", _pick("nrs", h, F.lit(-1))).otherwise(_pick("dklnrt", h, F.lit(-1)))
    plain = F.concat(*(syllable(j) for j in range(3 + attempt // 4)), end)
    other = lambda letters: F.concat(_each(w, letters, h), F.lit(""), *(_pick(letters, h, F.lit(-2 - j)) for j in range(attempt // 4)))
    made = F.when(F.lit(False), w)
    for script, letters in SCRIPTS.items():
        made = made.when(w.rlike(rf"^\p{{Is{script}}}"), other(letters))
    return made.otherwise(F.initcap(F.when(w.rlike(r"^\p{IsCyrillic}"), F.translate(plain, LATIN, CYRILLIC)).when(w.rlike(r"^\p{IsGreek}"), F.translate(plain, LATIN, GREEK)).otherwise(plain)))


def surrogate(secret: str, attempt: int) -> Column:
    """For the columns kind and norm."""
    n, k = F.col("norm"), F.col("kind")
    h = F.sha2(F.concat_ws("|", F.lit(secret), k, n, F.lit(str(attempt))), 256)
    code = F.regexp_extract(n, r"^\+(?:1|7|[2-9][0-9])", 0)
    rest = F.expr(r"substring(norm, length(regexp_extract(norm, '^\\+(?:1|7|[2-9][0-9])', 0)) + 1)")
    trunk = F.concat(F.lit("0"), _pick(DIGITS[1:], h, F.lit(-1)), _each(F.expr("substring(norm, 3)"), DIGITS, h))
    top = F.regexp_extract(n, r"\.[a-z]+$", 0)
    mail = F.expr(r"substring(norm, 1, length(norm) - length(regexp_extract(norm, '\\.[a-z]+$', 0)))")
    more = attempt // 4
    extra = lambda letters: F.concat(F.lit(""), *(_pick(letters, h, F.lit(-2 - j)) for j in range(more)))
    return (F.when(k == "email", F.concat(extra(LOWER), _shaped(mail, h), top)).when(k == "ip", _octets(n, h, more > 0)).when(k == "ip6", _ip6(n, h, more > 0))
            .when((k == "phone") & n.startswith("0"), trunk).when(k == "phone", F.concat(code, _each(rest, DIGITS, h))).when(k == "ssn", _each(n, DIGITS, h)).when(k == "card", _card(n, h))
            .when(k == "access_key", F.concat(F.substring(n, 1, 4), _each(F.substring(n, 5, 100), UPPER + "234567", h)))
            .when(k == "account", _account(n, h))
            .when((k == "surname") | k.startswith("first"), _word(n, k, F.lit(secret), attempt))
            .when(n.rlike("^[0-9a-f]+$"), F.concat(_each(n, HEX, h), extra(HEX))).otherwise(F.concat(_shaped(n, h), extra(DIGITS))))


def written(mention: Column, k: Column, s: Column) -> Column:
    """The surrogate in the mention's format: its punctuation, its case, its title."""
    filled = F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
                         lambda a, c: F.when(c.rlike("[0-9A-Z+]"), F.struct(F.concat(a["out"], F.substring(s, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at")))
                         .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))), lambda a: a["out"])
    capitals = lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))
    words = F.array_join(F.zip_with(F.split(bare(mention), " "), F.split(s, " "), lambda w, x: F.when(capitals(w), F.upper(x)).otherwise(x)), " ")
    return (F.when(k.isin("phone", "card", "ssn", "account"), filled).when(k.isin("email", "ip6") & capitals(mention), F.upper(s))
            .when(k.startswith("name"), F.concat(F.regexp_extract(mention, rf"^(?:{_TITLE})\.? ", 0), words))
            .when((k == "surname") | k.startswith("first"), F.when(capitals(mention), F.upper(s)).otherwise(s)).otherwise(s))


def assign(entities: DataFrame, secret: str) -> DataFrame:
    """kind, norm, surrogate of all distinct entities (kind, norm) and of the words of names, whose kinds are surname and
    first_f, first_m or first_n; names are composed of the surrogates of their words."""
    titled = F.col("kind").startswith("name")
    single = (F.col("kind") == "surname") | F.col("kind").startswith("first")
    tokens = F.regexp_extract_all("norm", F.lit("[^ -]+|[ -]"), 0)
    last = F.size(F.regexp_extract_all(F.element_at(F.split("norm", " "), -1), F.lit("[^ -]+|[ -]"), 0))
    named = entities.where(titled).select("kind", "norm", last.alias("last"), F.size(tokens).alias("n"), F.posexplode(tokens).alias("place", "word"))
    role = F.when(F.col("place") < F.col("n") - F.col("last"), F.regexp_replace("kind", "^name", "first")).otherwise("surname")
    named = scratch(named.select("kind", "norm", "place", F.when(is_unit(F.col("word")), role).alias("role"), "word"), "named")
    words = named.where("role IS NOT NULL").select(F.col("role").alias("kind"), F.col("word").alias("norm")).distinct()
    units = _distinct(scratch(entities.where(~titled & ~single).select("kind", "norm").unionByName(words), "units"), secret)
    parts = units.where(single).select(F.col("kind").alias("role"), F.col("norm").alias("word"), "surrogate")
    shift = 1 + hashlib.sha256(secret.encode()).digest()[0] % 25
    initial = F.translate(F.upper("word"), UPPER, UPPER[shift:] + UPPER[:shift])
    token = F.coalesce("surrogate", F.when(F.col("word").rlike(r"^\p{L}\.$"), initial).otherwise(F.col("word")))
    composed = (named.join(parts, ["role", "word"], "left").groupBy(F.struct("kind", "norm").alias("e"))
                .agg(F.sort_array(F.collect_list(F.struct("place", token.alias("token")))).alias("words"))
                .select("e.kind", "e.norm", F.array_join(F.col("words")["token"], "").alias("surrogate")))
    return units.unionByName(composed)


def _distinct(entities: DataFrame, secret: str) -> DataFrame:
    """kind, norm, surrogate of all distinct units (kind, norm), after the collision checks."""
    left, done = entities, None
    family = F.regexp_replace("kind", "_[fmn]$", "")
    for attempt in range(MOST_ATTEMPTS):
        tried = scratch(left.select("kind", "norm", surrogate(secret, attempt).alias("surrogate")), "tried")
        first = tried.groupBy(family.alias("f"), "surrogate").agg(F.min(F.struct("kind", "norm")).alias("first"))
        taken = entities.select(family.alias("f"), F.lower("norm").alias("t"))
        if done is not None:
            taken = taken.unionByName(done.select(family.alias("f"), F.lower("surrogate").alias("t")))
        named = tried.withColumn("f", family).join(first, ["f", "surrogate"])
        free = named.withColumn("t", F.lower("surrogate")).join(taken.distinct().withColumn("taken", F.lit(True)), ["f", "t"], "left")
        ok = free.withColumn("ok", F.col("taken").isNull() & (F.struct("kind", "norm") == F.col("first"))).select("kind", "norm", "surrogate", "ok")
        ok = scratch(ok, "checked")
        good = ok.where("ok").drop("ok")
        done = good if done is None else done.unionByName(good)
        left = ok.where("not ok").select("kind", "norm")
        if left.isEmpty():
            return done
    raise ValueError(f"entities left without a distinct surrogate after {MOST_ATTEMPTS} attempts")


def replace_entities(docs: DataFrame, secret: str) -> DataFrame:
    """``docs`` with the replaced ``text``, and ``kinds``: the types of the replaced mentions, in order."""
    text = F.col("text").cast("string")
    found = (docs.where(text.rlike(HINT)).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), F.regexp_extract_all(text, F.lit(MASTER), 0).alias("mentions"))
             .where(F.size("mentions") > 0))
    # the words of a document's titled names are mentions in all of it
    words = F.when(F.exists("mentions", is_name), name_words(F.col("mentions")))
    found = found.withColumn("words", words).withColumn("more", word_pattern(F.col("words")))
    again = F.when(F.col("more").isNull(), F.col("mentions")).otherwise(F.regexp_extract_all("text", F.concat(F.lit(MASTER), F.coalesce("more", F.lit(""))), 0))
    found = scratch(found.select("doc_id", "th", again.alias("mentions"), "words", "more"), "mentions")
    m = F.col("mention")
    each = found.select("doc_id", "th", "words", F.posexplode("mentions").alias("place", "mention"))
    known = F.get(F.filter("words", lambda w: (w["word"] == m) | (F.upper(w["word"]) == m)), F.lit(0))["role"]
    each = each.withColumn("kind", F.coalesce(F.when(F.size("words") > 0, known), kind(m))).drop("words")
    each = each.withColumn("norm", normal(m, F.col("kind")))
    entities = scratch(each.select("kind", "norm").distinct(), "entities")
    # the mentions of an entity meet its surrogate by a join that Spark splits when the entity is hot
    met = each.join(assign(entities, secret), ["kind", "norm"]).select("doc_id", "th", "place", "kind", written(m, F.col("kind"), F.col("surrogate")).alias("new"))
    new = met.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("place", "kind", "new"))).alias("new"))
    patterns = found.where("more IS NOT NULL").select("doc_id", "th", "more").groupBy("doc_id", "th").agg(F.first("more").alias("more"))
    new = new.join(patterns, (new["doc_id"].eqNullSafe(patterns["doc_id"])) & (new["th"] == patterns["th"]), "left").select(new["doc_id"], new["th"], "new", "more")
    joined, (_, n, more) = with_found(docs, new, "left", ("new", "more"))
    between = F.when(F.col(more).isNull(), F.split(text, MASTER, -1)).otherwise(F.split(text, F.concat(F.lit(MASTER), F.col(more)), -1))
    filled = F.array_join(F.flatten(F.zip_with(between, F.concat(F.col(n)["new"], F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    added = {"text": F.when(F.col(n).isNull(), F.col("text")).otherwise(filled), "kinds": F.coalesce(F.col(n)["kind"], F.array().cast("array<string>"))}
    return columns_of(joined, docs, added)
