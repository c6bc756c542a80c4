"""Text normalisation and statistics as column functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StringType, StructType

from lexspark.functions.vectors import let

#: Character classes with Unicode meaning, for Java's matcher.
WORD = r"[\p{L}\p{N}_]"
# Java looks single characters up to U+00FF up in one table, but tries ranges and others one after the other: blanks
# beyond are tried only where one may be, and printable ASCII is no blank at the first try.
WIDE_BLANKS = r"\x1c\x1d\x1e\x1f\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
BREAKS = r"\t\n\x0b\f\r"
BLANK = rf"[ {BREAKS}{WIDE_BLANKS}]"
NO_BLANK = rf"[!-~[^ {BREAKS}{WIDE_BLANKS}]]"
#: The same blanks one by one.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Where a word begins, before a word character, and ends, after one.
START, END = rf"(?<!{WORD})", rf"(?!{WORD})"

#: What stands before garbled texts (fixed value).
GARBLED_BANNER = "[WARNING: Text extraction may be incomplete or corrupted]\n\n"


def words(text: Column) -> Column:
    """The blank-separated words; an empty array for null."""
    return F.coalesce(F.filter(F.split(text, f"{BLANK}+"), lambda w: w != ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{NO_BLANK}+")), F.lit(0))


def strip(text: Column) -> Column:
    """The text without blanks at its ends, which alone are looked at."""
    return F.trim(text, F.lit(BLANKS))


def has_words(text: Column) -> Column:
    """Whether a text has any but blank characters."""
    return text.rlike(NO_BLANK)


def collapse(text: Column) -> Column:
    """Each run of blanks as one space; single spaces are passed over."""
    return F.regexp_replace(text, rf" {BLANK}+|[{BREAKS}{WIDE_BLANKS}]{BLANK}*", " ")


#: (sign, pattern, replacement) of the legal forms; a pattern is tried only in texts with its sign.
LEGAL_FORMS = (
    (r"\p{Nd} U", rf"{START}(\p{{Nd}}+)\s+U\.?S\.?\s+(\p{{Nd}}+)", "$1 U.S. $2"),
    (r"\p{Nd} F", rf"{START}(\p{{Nd}}+)\s+F\.?\s*(\p{{Nd}}+)d?\s+(\p{{Nd}}+)", "$1 F.$2d $3"),
    ("WHEREAS", rf"{START}WHEREAS,?\s+", "WHEREAS "),
    ("THEREFORE", rf"{START}NOW\s+THEREFORE,?\s+", "NOW THEREFORE "),
)


def preprocess_legal(text: Column) -> Column:
    """Blanks collapsed, reporter citations in one form, commas after WHEREAS and NOW THEREFORE dropped."""

    def form(sign: str, pattern: str, told: str) -> Callable[[Column], Column]:
        return lambda t: F.when(t.rlike(sign), F.regexp_replace(t, pattern, told)).otherwise(t)

    out = collapse(text)
    for one in LEGAL_FORMS:
        out = let(out, form(*one))
    return strip(out)


def preprocess_sentences(text: Column) -> Column:
    """Blanks collapsed, a line end before each capital that follows . ! or ?, numbered and lettered lines marked."""
    out = F.regexp_replace(collapse(text), r"([.!?])\s*([A-Z])", "$1\n$2")
    out = F.regexp_replace(out, r"(\n\s*\p{Nd}+\.)", "\n\nSECTION$1")
    out = F.regexp_replace(out, r"(\n\s*\([a-z]\))", "\n\nSUBSECTION$1")
    return strip(out)


#: Literal replacements of text cleaning (fixed values).
REPLACED = {"–": "-", "—": "-", "…": "...", "€": "EUR", "£": "GBP", "°": " degrees ", "§": "section", "¶": "paragraph", ": \"'\", ": "'"}
#: Signs that stay in texts of mostly other characters (fixed value).
KEPT_SIGNS = ".,!?;:()[]{}\"'-/\\@#$%^&*+=<>|`~"


#: Control characters other than tabs and line ends.
CONTROLS = re.compile(r"[\x00-\x08\x0b-\x1f]")


def _spelled(c: str) -> str:
    """What a character outside ASCII decomposes to in ASCII; nothing for other ASCII characters."""
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() if ord(c) > 127 else ""


def clean(text: str | None) -> str:
    """One text decomposed, without control characters, with signs spelled out and blanks collapsed."""
    if not text:
        return ""
    text = unicodedata.normalize("NFKD", text)
    text = CONTROLS.sub("", text)
    for sign, spelled in REPLACED.items():
        text = text.replace(sign, spelled)
    text = re.sub(r"\s+", " ", text).strip()
    if text and len(text.encode("ascii", "ignore")) / len(text) < 0.5:
        kept = [c if c.isalnum() or c.isspace() or c in KEPT_SIGNS else _spelled(c) for c in text]
        text = re.sub(r"\s+", " ", "".join(kept)).strip()
    return text


# Row by row: a worker holds a hundred rows at most, whatever the lengths of texts, where Arrow brings ten thousand.
_clean = F.udf(clean, StringType(), useArrow=False)


def clean_text(text: Column) -> Column:
    """clean() of each row. Plain ASCII rows stay in the JVM: for them only blanks and controls matter."""
    plain = F.coalesce(text, F.lit(""))
    ascii_only = ~plain.rlike(r"[^\x00-\x7f]|: \"'\", ")
    simple = strip(collapse(F.regexp_replace(plain, r"[\x00-\x08\x0b-\x1f]", "")))
    return F.when(ascii_only, simple).otherwise(_clean(F.when(~ascii_only, text)))


def _length_without(text: Column, dropped: str) -> Column:
    """The length without runs of a class of characters."""
    return F.length(F.regexp_replace(text, f"{dropped}+", ""))


def is_garbled(text: Column) -> Column:
    """Whether a text looks like broken extraction: short, few ASCII characters or letters, odd share of
    blanks, or few distinct characters for its length. Null counts as garbled.

    No text has more distinct characters than there are in ASCII and others in it: one that is garbled by this bound
    is not taken apart."""
    n = F.nullif(F.length(text), F.lit(0))
    others = _length_without(text, r"[\x00-\x7f]")
    spaces = n - _length_without(text, BLANK)
    distinct = F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    return F.coalesce(
        (n * F.lit(0.1) > others + 128)
        | (F.length(strip(text)) < 10)
        | (_length_without(text, r"[^\x00-\x7f]") / n < 0.3)
        | (_length_without(text, r"[^\p{L}]") / n < 0.2)
        | (spaces / n > 0.8)
        | (spaces / n < 0.05)
        | (distinct < F.greatest(F.lit(5.0), n * F.lit(0.1))),
        F.lit(True),
    )


def extraction_quality(text: Column) -> Column:
    return F.when(is_garbled(text), "poor").otherwise("good")


def with_banner(text: Column) -> Column:
    """A warning before garbled texts."""
    return F.when(is_garbled(text), F.concat(F.lit(GARBLED_BANNER), F.coalesce(text, F.lit("")))).otherwise(text)


def content_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def preview(text: Column, n: int = 200, always: bool = False) -> Column:
    """The first n characters; with dots if there are more, or always."""
    cut = F.concat(F.substring(text, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(text) > n, cut).otherwise(text)


def flatten_metadata(values: Column, prefix: str) -> Column:
    """A map with prefix_ before its keys and an empty text for null values."""
    named = F.transform_keys(values, lambda k, _: F.concat(F.lit(f"{prefix}_"), k))
    return F.transform_values(named, lambda _, v: F.coalesce(v, F.lit("")))


def flatten_struct(value: Column, kind: StructType, prefix: str) -> Column:
    """A map of prefix_key and text for a struct: lists joined with commas, structs and maps in it flattened with
    longer prefixes, an empty text for null, zero, false and empty values."""
    maps = []
    for f in kind.fields:
        own, name = value[f.name], f"{prefix}_{f.name}"
        if isinstance(f.dataType, StructType):
            maps.append(flatten_struct(own, f.dataType, name))
        elif isinstance(f.dataType, MapType):
            maps.append(F.coalesce(flatten_metadata(own.cast("map<string,string>"), name), F.create_map().cast("map<string,string>")))
        elif isinstance(f.dataType, ArrayType):
            maps.append(F.create_map(F.lit(name), joined(own.cast("array<string>"))))
        else:
            told = own.cast("string")
            empty = own == F.lit(0 if isinstance(f.dataType, NumericType) else False) if isinstance(f.dataType, (NumericType, BooleanType)) else F.lit(False)
            maps.append(F.create_map(F.lit(name), F.when(empty, "").otherwise(F.coalesce(told, F.lit("")))))
    return F.map_concat(*maps)


def joined(values: Column) -> Column:
    """A list as one text with commas, an empty text for null."""
    return F.coalesce(F.array_join(values, ", "), F.lit(""))
