"""Text columns: everything stays an expression of the engine, so scans and filters stay whole."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Lines that are nothing but a page number.
PAGE_LINE = r"^\s*(?:[-–—~·]\s*\d{1,4}\s*[-–—~·]|\d{1,4}|(?i:trang|page)\s+\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?)\s*$"


def _accents() -> tuple[str, str]:
    """Precomposed small Latin letters and their bases, by rule."""
    pairs = {}
    for c in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base != chr(c) and chr(c).islower() and base.isascii():
            pairs[chr(c)] = base
    pairs["đ"] = "d"
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Small letters without accents, đ as d, spaces collapsed. NULL stays NULL."""
    seen, base = _accents()
    bare = F.regexp_replace(F.translate(F.lower(text), seen, base), r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def collapse_spaces(text: Column) -> Column:
    """Runs of tabs, no-break and plain spaces to one, none around line ends, at most one blank line."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[\t  ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, " ?\n ?", "\n"), "\n{3,}", "\n\n"))


def clean_lines(text: Column) -> Column:
    """``collapse_spaces`` without the lines that only number a page."""
    kept = F.filter(F.split(collapse_spaces(text), "\n"), lambda line: ~line.rlike(PAGE_LINE))
    return F.array_join(kept, "\n")


def words(text: Column) -> Column:
    """Words in small letters, in order; NULL text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """The set of folded words of more than two letters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(fold(text), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.length(w) > 2))


def identifier(text: Column) -> Column:
    """Capital letters and digits only, Đ as D: equal for the spellings of one number."""
    return F.regexp_replace(F.upper(F.translate(text, "Đđ", "Dd")), "[^0-9A-Z]", "")


def stable_id(*parts: Column, prefix: str = "") -> Column:
    """A 16-digit hash of the parts joined by ``|``; a NULL part counts as empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16))


def sentences(text: Column) -> Column:
    """Sentences, split behind . ! ? ; and at line ends, trimmed, without empty ones."""
    cut = F.split(F.regexp_replace(text, r"([.!?;])\s+", "$1\n"), "\n+")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def host(url: Column) -> Column:
    """Host of a web address in small letters; NULL when there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def normal_url(url: Column) -> Column:
    """Scheme and host small, fragment and last slashes dropped; NULL with user info or without a host."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)", 1)
    return F.when((head != "") & ~head.contains("@"), F.concat(F.lower(head), F.substr(bare, F.length(head) + 1)))


def spans(text: Column, most: int) -> Column:
    """Parts of a text between semicolons and line ends, neighbours joined by ``; `` so that there are at most ``most``."""
    parts = F.filter(F.transform(F.split(text, "[;\n]"), lambda s: F.trim(s)), lambda s: s != "")
    size = F.greatest(F.ceil(F.size(parts) / most), F.lit(1)).cast("int")
    starts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, size), "; "))
