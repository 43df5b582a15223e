"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

Everything is a column expression. A pattern's matches and the text between them come
from ``regexp_extract_all`` and ``split``; a span's start is the running sum of both.
Patterns use possessive repeats and fixed starts, so they are linear in the text and
never deep in the stack, but match what the plain patterns in the comments match. Work is
linear in the text and its matches: arrays are computed once per text, never per match, and a
place in a text is reached by way of pieces of _CHUNK characters.

Four kinds are certain by their form (base spans, score 1): email, ip (parts at most
255), card (12 to 19 digits, Luhn) and phone (international, 9 to 15 digits). The others
start from a score and need more: iban is confirmed by its mod-97 checksum, at the last
of its possible ends where that holds, so words after it do not hide it; secret,
national (a national phone number) and ssn gain by a word of their context close before
them and are kept from ``KEEP_SCORE`` on.

Defined cases: a null or empty text has no spans; positions are code points, end
exclusive; spans of different kinds, and account numbers of which one begins inside the
other, may overlap and all stay in the list, while redaction joins overlapping ones and
names the first; other columns pass through, and an input column named ``pii`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions.arrays import let, scanned

KEEP_SCORE = 0.6
CONTEXT_CHARS = 40
_CHUNK = 1024  # characters of a text that are walked through to reach a place in it

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "national", "ssn")

PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : only the first place of a run of
    # local characters, or the end of the match before, can begin a match
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # takes the first four characters only, so another one may begin in the rest; group 1 is all
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])))"
            r"[A-Z]{2}[0-9]{2}",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
    "national": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# first score of a kind and the words before a span that raise it by 0.5
SCORES = {"iban": 0.3, "secret": 0.2, "national": 0.3, "ssn": 0.4}
CONTEXT = {
    "secret": r"(?i)\b(?:api|access|auth|bearer|client|key|passphrase|passwd|password|private|secret|token)[\w-]*\W{0,6}$",
    "national": r"(?i)\b(?:call|cell|contact|fax|mobile|phone|tel|telephone)\b",
    "ssn": r"(?i)\b(?:ssn|social security|tax id|taxpayer)\b",
}
#: Group of the match and characters that it takes, where not all of it.
GROUPS, TAKEN = {"iban": 1}, {"iban": 4}
IBAN_LEAST = 12
#: What a text must contain before a pattern is tried at all.
HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}


def _chunks(text: Column) -> Column:
    """The text in pieces of _CHUNK characters, so a place in it is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive) of a text in chunks."""
    first, last = F.floor(start / _CHUNK).cast("int"), F.floor((end - 1) / _CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(held, start - first * _CHUNK + 1, end - start)).otherwise("")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    n = F.length(digits)

    def weight(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + weight(i))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """The checksum of an account number: its first four characters moved to the end, letters
    counted from 10, modulo 97 equal to 1."""
    packed = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        v = F.when(c > 57, c - 55).otherwise(c - 48)
        return F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _iban(found: Column) -> Column:
    """The longest stretch of a match, up to one of its spaces or its end, that the checksum
    confirms; null without one."""
    words = F.split(found, " ")
    ends = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)),
                       lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    return F.get(F.filter(ends, lambda v: (F.length(F.replace(v, F.lit(" "), F.lit(""))) >= IBAN_LEAST) & mod97(v)), 0)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
                           r"(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})){3}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return value.isNotNull()
    if kind == "secret":  # mixed letters and digits
        return (n >= 4) & F.regexp_replace(value, "[^A-Za-z]", "").rlike("[A-Za-z]{4}")
    if kind == "ssn":
        return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _score(kind: str, chunks: Column, start: Column) -> Column:
    if kind in BASE_KINDS:
        return F.lit(1.0)
    if kind == "iban":  # the checksum alone confirms it
        return F.lit(SCORES[kind] + 0.5)
    near = _between(chunks, F.greatest(F.lit(0), start - CONTEXT_CHARS), start)
    return F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), 0.5).otherwise(0.0)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input columns plus ``pii``: array of (start, end, kind, score, value), by start, then
    kind as listed."""
    keep = [c for c in docs.columns if c != "pii"]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")

    def matches(kind: str) -> Column:
        hint = F.contains(t, F.lit(HINTS[kind])) if kind in HINTS else t.rlike("[0-9]")
        return F.when(hint, F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(GROUPS.get(kind, 0)))).otherwise(none)

    out = docs.select(*keep, *(matches(k).alias(f"_m_{k}") for k in KINDS))

    def taken(kind: str, m: Column) -> Column:
        return F.lit(TAKEN[kind]) if kind in TAKEN else F.length(m)

    def ends(kind: str, found: Column) -> Column:
        """Where each match ends: running sums of the stretches before the matches and the matches."""
        steps = F.zip_with(F.slice(F.split(t, PATTERNS[kind], -1), F.lit(1), F.size(found)), found,
                           lambda before, m: F.length(before) + taken(kind, m))
        return scanned(steps, lambda a, x: a + x)

    def spans(kind: str) -> Column:
        def span(m: Column, end: Column, chunks: Column) -> Column:
            start = end - taken(kind, m)
            return let(_iban(m) if kind == "iban" else m, lambda value: F.struct(
                start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(value)).alias("end"),
                _score(kind, chunks, start).alias("score"), value.alias("value")))

        def rows(found: Column, chunks: Column) -> Column:
            return F.filter(F.zip_with(found, ends(kind, found), lambda m, e: span(m, e, chunks)),
                            lambda r: (r["score"] >= KEEP_SCORE) & _valid(kind, r["value"]))

        chunks = _chunks(t) if kind in CONTEXT else none
        return F.when(F.size(f"_m_{kind}") > 0, let(F.col(f"_m_{kind}"), lambda m: let(chunks, lambda c: rows(m, c))))

    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,score:double,value:string>>")
    found = F.array_sort(F.concat(*(F.coalesce(spans(k), nothing) for k in KINDS)))  # by start, then kind
    names = F.array(*(F.lit(k) for k in KINDS))
    return out.select(*keep, F.transform(found, lambda r: F.struct(
        r["start"], r["end"], F.get(names, r["rank"]).alias("kind"), r["score"], r["value"])).alias("pii"))


def of_kinds(spans: Column, *kinds: str) -> Column:
    """The spans of these kinds."""
    return F.filter(spans, lambda r: r["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", r["kind"], r["start"], r["end"])), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """The result of ``find_pii`` with every span in the text replaced by its kind in
    brackets, without ``pii``. Texts without spans, nulls too, stay as they are."""
    def cut(spans: Column) -> Column:
        """(start, end, kind) of overlapping spans joined: a span opens a new one if it starts where all before ended."""
        upto = scanned(F.transform(spans, lambda r: r["end"]), F.greatest)

        def joined_spans(upto: Column) -> Column:
            opens = F.filter(F.sequence(F.lit(0), F.size(spans) - 1),
                             lambda i: (i == 0) | (F.get(upto, i - 1) <= F.get(spans, i)["start"]))
            return let(opens, lambda first: F.transform(first, lambda i, k: F.struct(
                F.get(spans, i)["start"].alias("start"),
                F.get(upto, F.coalesce(F.get(first, k + 1), F.size(spans)) - 1).alias("end"),
                F.get(spans, i)["kind"].alias("kind"))))

        return let(upto, joined_spans)

    def redacted(spans: Column, chunks: Column) -> Column:
        def text_of(cuts: Column) -> Column:
            pieces = F.transform(cuts, lambda r, i: F.concat(
                _between(chunks, F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0)), r["start"]),
                F.lit("["), F.upper(r["kind"]), F.lit("]")))
            rest = _between(chunks, F.element_at(cuts, -1)["end"],
                            (F.size(chunks) - 1) * _CHUNK + F.length(F.element_at(chunks, -1)))
            return F.concat(F.array_join(pieces, ""), rest)

        return let(cut(spans), text_of)

    t = F.col(text)
    return found.withColumn(text, F.when(F.size("pii") > 0, let(F.col("pii"), lambda s: let(
        _chunks(t), lambda c: redacted(s, c)))).otherwise(t)).drop("pii")
