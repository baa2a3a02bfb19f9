"""Column functions on catalogue text: numbers, dates, names, formats, fingerprints."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bulgarian month names in order.
MONTHS = ["януари", "февруари", "март", "април", "май", "юни", "юли", "август", "септември", "октомври", "ноември", "декември"]
#: The official Bulgarian transliteration.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ь": "y", "ю": "yu", "я": "ya",
}
#: Spellings of true and false.
TRUE, FALSE = ["true", "да", "yes", "1", "y"], ["false", "не", "no", "0", "n"]
#: GeoJSON's type names.
GEO = "Feature|FeatureCollection|Point|Polygon|LineString|MultiPolygon|MultiLineString|MultiPoint|GeometryCollection"
#: Declared formats by kind.
FORMATS = {"tabular": ["csv", "tsv", "xlsx", "xls"], "geojson": ["geojson"], "json": ["json", "jsonl", "ndjson"], "xml": ["xml"], "text": ["txt", "text", "md"]}

#: White space as JavaScript's trim and \s have it.
BLANK = r"[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_GROUPED = rf"^-?[0-9]{{1,3}}(?:(?:{BLANK}|\.)[0-9]{{3}})*(?:,[0-9]+)?$"
_PLAIN = r"^-?[0-9]+(?:\.[0-9]+)?$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def decimal_value(text: Column) -> Column:
    """The number a cell stands for: grouped thousands with a decimal comma first, then a decimal point; else null."""
    text = trimmed(text)
    grouped = F.regexp_replace(F.regexp_replace(text, rf"{BLANK}|\.", ""), ",", ".")
    return F.when(text.rlike(_GROUPED), grouped.try_cast("double")).when(text.rlike(_PLAIN), text.try_cast("double"))


def decimal_rule(text: Column) -> Column:
    """integer, decimal-comma-to-point or decimal-point; null where decimal_value is."""
    text = trimmed(text)
    grouped = F.when(text.contains(","), "decimal-comma-to-point").otherwise("integer")
    return F.when(text.rlike(_GROUPED), grouped).when(text.rlike(_PLAIN), F.when(text.contains("."), "decimal-point").otherwise("integer"))


def date_value(text: Column) -> Column:
    """Ten-character dates from ISO 8601, day.month.year and `5 май 2025`; ranges are not checked."""
    text = trimmed(text)
    part = lambda pattern, k, of=text: F.regexp_extract(of, pattern, k)
    dmy = r"^([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})$"
    named = rf"^([0-9]{{1,2}}){BLANK}+(\p{{L}}+){BLANK}+([0-9]{{4}})$"
    low = F.lower(text)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(named, 2, low))
    two = lambda x: F.lpad(F.regexp_replace(x, "^0(?=.)", ""), 2, "0")
    return (
        F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T.+)?$"), F.substring(text, 1, 10))
        .when(text.rlike(dmy), F.concat_ws("-", part(dmy, 3), two(part(dmy, 2)), two(part(dmy, 1))))
        .when(low.rlike(named) & (month > 0), F.concat_ws("-", part(named, 3, low), F.lpad(month.cast("string"), 2, "0"), two(part(named, 1, low))))
    )


def boolean_value(text: Column) -> Column:
    low = F.lower(trimmed(text))
    return F.when(low.isin(TRUE), True).when(low.isin(FALSE), False)


def is_number(text: Column) -> Column:
    """Whether JavaScript's Number() is finite: decimal with exponent, or 0x, 0o, 0b; a blank is not."""
    return trimmed(text).rlike(r"^(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$")


def number_value(text: Column) -> Column:
    text = trimmed(text)
    coded = [F.when(text.rlike(f"^0[{c}{c.upper()}]"), F.conv(F.substring(text, 3, 64), base, 10).cast("double")) for c, base in (("x", 16), ("o", 8), ("b", 2))]
    return F.when(is_number(text), F.coalesce(*coded, text.try_cast("double")))


def transliterate(text: Column) -> Column:
    """Bulgarian Cyrillic to Latin; of a capital only the first Latin letter is one."""
    many = {c: x for c, x in LATIN.items() if len(x) > 1}
    one = {c: x for c, x in LATIN.items() if len(x) == 1}
    for c, x in many.items():
        text = F.replace(F.replace(text, F.lit(c), F.lit(x)), F.lit(c.upper()), F.lit(x.capitalize()))
    letters = "".join(one) + "".join(one).upper()
    return F.translate(text, letters, "".join(one.values()) + "".join(one.values()).upper())


def decomposed(text: Column) -> Column:
    """Text with compatible and accented characters taken apart (NFKD); in Python, by batches, as Spark has no such function."""

    @F.pandas_udf("string")
    def taken_apart(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))

    return taken_apart(text)


def canonical_name(text: Column, decompose: bool = False) -> Column:
    """A column's identifier before duplicates are told apart.

    Characters that need decomposing, like accented Latin letters, are read as their
    base letters only with `decompose`, which goes through Python: for headers, not rows.
    """
    latin = decomposed(transliterate(text)) if decompose else transliterate(text)
    name = F.regexp_replace(F.lower(latin), r"[^\p{L}\p{N}_]+", "_")
    name = F.regexp_replace(F.regexp_replace(name, "^_+|_+$", ""), "__+", "_")
    name = F.when(name.rlike("^[a-z]"), name).otherwise(F.concat(F.lit("c_"), name))
    return F.when(name.rlike("^[a-z][a-z0-9_]*$"), name).otherwise(F.concat(F.lit("c_"), F.regexp_replace(name, "[^a-z0-9_]", "")))


def slug(text: Column, longest: int | None = 64, default: str = "") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(transliterate(text)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    if longest:
        out = F.regexp_replace(F.substring(out, 1, longest), "-+$", "")
    return F.when(out == "", default).otherwise(out)


def sniffed(head: Column, name: Column | None = None, declared: Column | None = None, content_type: Column | None = None) -> Column:
    """struct(kind, reason) of a resource: magic bytes, extension, declared format, content type, else text."""
    start = F.regexp_replace(F.substring(F.regexp_replace(head, "^﻿", ""), 1, 1024), r"^[ \t\n\r]+", "")
    geo = start.rlike(rf'"type"\s*:\s*"(?:{GEO})"')
    magic = (
        F.when(F.substring(head, 1, 2) == "PK", "tabular").when(start.startswith("<"), "xml")
        .when(start.startswith("{"), F.when(geo, "geojson").otherwise("json")).when(start.startswith("["), "json")
    )

    def by_format(x: Column) -> Column:
        return F.coalesce(*[F.when(F.lower(x).isin(names), kind) for kind, names in FORMATS.items()])

    none = F.lit(None).cast("string")
    kind_type = F.lower(content_type) if content_type is not None else none
    by_type = (
        F.when(kind_type.rlike("csv|tab-separated|spreadsheet"), "tabular").when(kind_type.contains("geo+json"), "geojson")
        .when(kind_type.contains("json"), "json").when(kind_type.contains("xml"), "xml").when(kind_type.startswith("text/"), "text")
    )
    by_name = by_format(F.regexp_extract(name, r"(?<=[^/])\.([^./]+)$", 1)) if name is not None else none
    by_declared = by_format(declared) if declared is not None else none
    found = [(magic, "magic"), (by_name, "extension"), (by_declared, "declared-format"), (by_type, "declared-content-type"), (F.lit("text"), "fallback")]
    return F.coalesce(*[F.when(k.isNotNull(), F.struct(k.alias("kind"), F.lit(r).alias("reason"))) for k, r in found])


def root_element(xml: Column) -> Column:
    """The name of a document's root element, `unknown` without one; declaration and comments come before it."""
    bare = F.regexp_replace(F.regexp_replace(xml, r"(?s)<\?.*?\?>", ""), r"(?s)<!--.*?-->", "")
    found = F.regexp_extract(bare, r"<([A-Za-z_][\w.:-]*)", 1)
    return F.when(found == "", "unknown").otherwise(found)


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of `name=value` lines, in the order given; null is empty."""
    lines = [F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("")), F.lit("\n")) for name, value in fields.items()]
    return F.sha2(F.concat(*lines), 256)


def is_stale(at: Column, seconds: int, now: Column) -> Column:
    """Null, or more than `seconds` before now."""
    return at.isNull() | (F.unix_seconds(now) - F.unix_seconds(at) > seconds)


def iso_text(at: Column) -> Column:
    """A time as ISO 8601 in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def diff_seconds(a: Column, b: Column) -> Column:
    """Seconds from b to a, both ISO 8601 texts, to the millisecond; null where either is none."""
    millis = lambda x: F.floor(F.unix_micros(x.try_cast("timestamp")) / 1000)
    return (millis(a) - millis(b)) / 1000


def sofia_text(at: Column) -> Column:
    """A time as day/month/year, hour:minute:second in Sofia."""
    return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), "Europe/Sofia"), "dd/MM/yyyy, HH:mm:ss")


def clamp_int(raw: Column, default: int, most: int) -> Column:
    """The whole number that a text begins with, `most` at most; `default` where there is none or it is negative."""
    digits = F.regexp_extract(F.coalesce(raw, F.lit("")), rf"^{BLANK}*(-?)\+?([0-9]+)", 2)
    minus = F.regexp_extract(F.coalesce(raw, F.lit("")), rf"^{BLANK}*(-?)\+?([0-9]+)", 1)
    number = F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 18, F.lit(most)).otherwise(F.least(digits.try_cast("long"), F.lit(most)))
    zero = F.regexp_replace(digits, "^0+", "") == ""
    return F.when((digits == "") | ((minus == "-") & ~zero), F.lit(default)).otherwise(number).cast("long")


def route_class(path: Column) -> Column:
    """A request path's class."""
    return F.when(path.startswith("/api/chat"), "chat").when(path.startswith("/api/admin"), "admin").when(path.startswith("/api/"), "data").otherwise("other")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def safe_segment(name: Column) -> Column:
    """A path segment: the name, or 32 hex digits of its SHA-256 where it is unsafe."""
    unsafe = name.isin("", ".", "..") | name.contains("/") | name.contains("\\") | (F.octet_length(name) > 200)
    return F.when(unsafe, F.substring(F.sha2(name, 256), 1, 32)).otherwise(name)


def csv_cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


#: Crockford's letters for 32 digits.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _letters(number: Column, digits: int) -> Column:
    """A number of five bits a digit, in Crockford's letters."""
    parts = [F.substring(F.lit(CROCKFORD), F.shiftright(number, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in reversed(range(digits))]
    return F.concat(*parts)


def ulid(at: Column, seed: Column) -> Column:
    """A ULID: ten letters of a time's milliseconds, then sixteen by a seed, so the same row keeps its id when a task runs again."""
    half = F.lit((1 << 40) - 1)
    one, two = F.xxhash64(seed), F.xxhash64(seed, F.lit("ulid"))
    return F.concat(_letters(F.unix_millis(at), 10), _letters(one.bitwiseAND(half), 8), _letters(two.bitwiseAND(half), 8))


def is_ulid(text: Column) -> Column:
    return text.rlike("^[0-9A-HJKMNP-TV-Z]{26}$")
