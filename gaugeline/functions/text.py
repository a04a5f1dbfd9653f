"""Text functions as Column expressions; offsets are code points, 0-based and half-open."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPAN = "struct<start:int,stop:int,text:string>"

# Redaction patterns, applied in this order, ignoring case.
REDACTIONS = {
    "email": r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?<!\w)(?:\+?1[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)",
    "coordinates": r"(?<![\w.])-?\d{1,3}\.\d{4,}\s*[,;/]\s*-?\d{1,3}\.\d{4,}(?!\d)",
    "named_coordinate": r"\b(?:latitude|longitude|lat|lon|long)\s*[:=]?\s*-?\d{1,3}\.\d+",
    "street": r"\b\d{1,6}\s+(?:[\w.-]+\s+){1,5}(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|court|ct|way)\b\.?",
}
# Further detectors of what must not be published.
RISKS = {
    "registration": r"\b(?:N\d{1,5}[A-Z]{0,2}|[A-Z]{1,3}-\d{2,6})\b",
    "personal_name": r"(?i)\b(?:mr\.?|mrs\.?|ms\.?|dr\.?|inspector|reported by|contact)\s+[A-Z][a-z]+\s+[A-Z][a-z]+\b",
}
REDACTED = "[REDACTED]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unfold(rows: DataFrame, array: Column | str, name: str, *columns: Column | str) -> DataFrame:
    """columns of rows and, as name, each element of an array of them (elements are not null).

    A plain explode of a computed array has the optimizer ask below for arrays that are not empty:
    that filter goes through every projection and computes the array again at each mention.
    """
    return rows.select(*columns, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def nfkc(text: Column) -> Column:
    """Unicode NFKC, the one thing here that Spark lacks. Spark asks Python about every row, so texts within ASCII go there as null."""
    beyond = text.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, _nfkc(F.when(beyond, text))).otherwise(text)


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """All characters that full case folding changes: those that become one character, what these become, and those that become several. From Python's own table."""
    changed = {c: f for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (f := c.casefold()) != c}
    one = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in changed.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full Unicode case folding, as str.casefold() has it. Characters that become several are looked for only in texts that have one."""
    before, after, several = _folds()
    one = F.translate(text, before, after)
    known = F.str_to_map(F.lit("\n".join(f"{c}\t{f}" for c, f in several.items())), F.lit("\n"), F.lit("\t"))
    spelled = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    return F.when(text.rlike(f"[{''.join(several)}]"), spelled).otherwise(one)


def collapse(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def tokens(text: Column) -> Column:
    return F.filter(F.split(collapse(F.coalesce(text, F.lit(""))), " "), lambda x: x != "")


def redact(text: Column) -> Column:
    """Detectors in their order; words, digits and letter case are those of Unicode."""
    for pattern in REDACTIONS.values():
        text = F.regexp_replace(text, f"(?iU){pattern}", REDACTED.replace("[", r"\[").replace("]", r"\]"))
    return text


def prepare(text: Column) -> Column:
    """struct(text, sensitive): collapsed, then redacted."""
    clean = collapse(text)
    found = redact(clean)
    return F.struct(found.alias("text"), (found != clean).alias("sensitive"))


def prepare_evidence(text: Column) -> Column:
    """struct(display, clean, offsets, sensitive) of a text: its lines kept and redacted, the same collapsed, and the map between.

    Line ends become line feeds before anything is redacted, and redaction comes before
    collapsing, so that offsets[i] is where character i of clean stands in display; the last
    one is display's length. Null stays null; a blank text has empty forms and one offset.
    """
    lines = F.replace(F.replace(nfkc(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))

    def of(known: Column) -> Column:
        display = F.regexp_replace(known["redacted"], r"(?U)^\s+|\s+$", "")
        return let(F.struct(display.alias("display"), (known["redacted"] != known["lines"]).alias("sensitive")), mapped)

    def mapped(known: Column) -> Column:
        clean = F.regexp_replace(known["display"], r"(?U)\s+", " ")
        return F.struct(known["display"].alias("display"), clean.alias("clean"), offset_map(known["display"]).alias("offsets"), known["sensitive"].alias("sensitive"))

    return F.when(text.isNotNull(), let(let(lines, lambda x: F.struct(x.alias("lines"), redact(x).alias("redacted"))), of))


#: Stands around matches while they are found; in a text it counts as another control character.
_MARK = "\x01"


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, text>> of all matches (no empty ones), from the lengths of what stands between them.

    Matches are marked by one replacement, whose pattern Spark compiles once, and cut at
    the mark; splitting by the pattern itself would compile it again for every row. Texts
    without a match are told by one search and go no further.
    """
    return F.when(text.rlike(pattern), _marked_spans(text, F.regexp_replace(F.translate(text, _MARK, "\x02"), pattern, f"{_MARK}$0{_MARK}"))).when(text.isNotNull(), F.expr(f"cast(array() as array<{SPAN}>)"))


def _marked_spans(text: Column, marked: Column) -> Column:
    """Spans of a text from the same text with marks around them."""
    parts = F.transform(F.split(marked, _MARK, -1), lambda p, i: F.struct(F.length(p).alias("n"), (i % 2 == 1).alias("hit")))
    begun = F.expr(f"struct(0 as at, cast(array() as array<{SPAN}>) as spans)")

    def step(known: Column, x: Column) -> Column:
        start, stop = known["at"], known["at"] + x["n"]
        span = F.struct(start.alias("start"), stop.alias("stop"), F.substring(text, start + 1, x["n"]).alias("text"))
        return F.struct(stop.alias("at"), F.when(x["hit"], F.concat(known["spans"], F.array(span))).otherwise(known["spans"]).alias("spans"))

    return F.aggregate(parts, begun, step)["spans"]


def offset_map(text: Column) -> Column:
    """For each character of the collapsed form its offset in the (trimmed) text, and the text's length at the end; in one pass over its characters."""

    def kept(chars: Column) -> Column:
        n = F.size(chars)
        starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(chars, i) != " ") | (F.get(chars, i - 1) != " "))
        return F.when(n > 0, starts).otherwise(F.array(F.lit(0)))

    plain = F.regexp_replace(text, r"(?U)\s", " ")
    return let(F.when(plain == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(plain, "")), kept)


def exact_key(text: Column) -> Column:
    """SHA-256 of the lower-cased, collapsed text; empty for an empty one."""
    norm = F.lower(collapse(F.coalesce(text, F.lit(""))))
    return F.when(norm == "", F.lit("")).otherwise(F.sha2(norm.cast("binary"), 256))


def template_key(text: Column) -> Column:
    """The same of its words, with numbers as slots; null below eight words."""
    found = F.regexp_extract_all(F.lower(collapse(F.coalesce(text, F.lit("")))), F.lit(r"(?U)\w+(?:[.-]\w+)*"), F.lit(0))
    slots = F.transform(found, lambda t: F.when(t.rlike(r"^\d+(?:\.\d+)?$"), "<NUMBER>").otherwise(t))
    return F.when(F.size(found) >= 8, F.sha2(F.array_join(slots, " ").cast("binary"), 256))


def vendor_template_key(text: Column, vendor: Column) -> Column:
    """SHA-256 of the words, with the vendor's name and numbers as slots."""
    low = F.lower(text)
    named = F.when(F.coalesce(vendor, F.lit("")) != "", F.regexp_replace(low, F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower(vendor), F.lit(r"\E(?!\w)")), F.lit("<vendor>"))).otherwise(low)
    slots = F.regexp_replace(named, r"\d+(?:\.\d+)?", "<number>")
    return F.sha2(F.array_join(F.regexp_extract_all(slots, F.lit(r"(?U)\w+|<number>|<vendor>"), F.lit(0)), " ").cast("binary"), 256)


def unit_hash(text: Column) -> Column:
    """The first 32 bits of SHA-256 as a number from 0 up to 1."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def spreadsheet_safe(value: Column) -> Column:
    return F.when(F.ltrim(value).rlike(r"^[=+@-]"), F.concat(F.lit("'"), value)).otherwise(value)


def escape_html(value: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(plain), F.lit(coded))
    return value


def vendor_key(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """Collapsed and case-folded; aliases are normalised on both sides."""
    key = casefold(collapse(F.coalesce(value, F.lit(""))))
    for name, target in (aliases or {}).items():
        key = F.when(key == " ".join(name.split()).casefold(), " ".join(target.split()).casefold()).otherwise(key)
    return key


def parse_date(value: Column, pattern: str = "yyyy-M-d") -> Column:
    """ISO date, or null where the one given format does not fit."""
    return F.date_format(F.try_to_timestamp(collapse(value), F.lit(pattern)), "yyyy-MM-dd")


def risks(text: Column) -> Column:
    """Sorted names of the detectors that find something, and whether redaction would change the text."""
    named = [F.when(text.rlike(f"(?iU){p}"), F.lit(n)) for n, p in REDACTIONS.items()] + [F.when(text.rlike(f"(?U){p}"), F.lit(n)) for n, p in RISKS.items()]
    changed = F.when(prepare(text)["sensitive"], F.lit("redaction_change"))
    return F.array_sort(F.array_compact(F.array(*named, changed)))
