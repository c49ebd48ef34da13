"""Text functions, Column to Column. All but ``fold_text`` stay in the JVM.

Java's ``\\w``, ``\\d`` and ``\\s`` are ASCII unless ``(?U)`` is set; patterns that mean Unicode say so.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables as t

SPACE = r"[\s\u001c-\u001f]"
#: The same as characters.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: What is not a printing ASCII character; most addresses have none and skip what looks for blanks and scripts.
_ODD = r"[^\x21-\x7e]"


def translate(c: Column, table: Mapping[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def literals(*values: str) -> str:
    """SQL string literals; the fixed values hold no quotes or backslashes."""
    return ", ".join(f"'{v}'" for v in values)


def literal_map(table: Mapping[str, str]) -> Column:
    return F.expr(f"map({literals(*[x for pair in table.items() for x in pair])})")


def looked_up(c: Column, table: Mapping[str, str]) -> Column:
    """The table's value, NULL where the key is missing."""
    return F.try_element_at(literal_map(table), c)


def any_of(letters: str) -> str:
    return "[" + "".join("\\" + ch if ch in "\\[]^-&" else ch for ch in letters) + "]"


def strip(c: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.trim(c, F.lit(BLANKS))


# --- HTML character references -------------------------------------------------------------------
@lru_cache(maxsize=1)
def _references() -> tuple[str, str, str]:
    """All references that end in a semicolon with their texts, marked off in one text; a pattern of the names that
    need no semicolon, longest first; and what the numbers 128 to 159 stand for."""
    named = "\x01".join(["", *(f"{k}\x02{v}" for k, v in html5.items() if k.endswith(";")), ""])
    legacy = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    western = "".join(b.decode("cp1252", "ignore") or chr(b[0]) for b in (bytes([n]) for n in range(128, 160)))
    return named, "^(?:" + "|".join(legacy) + ")", western


def _character(n: Column) -> Column:
    """The text of a numbered reference; NULL stands for a number beyond all bounds."""
    unknown = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 65534)
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    western = F.call_function("substring", F.lit(_references()[2]), n.cast("int") - 127, F.lit(1))
    return F.when(unknown, F.lit("\ufffd")).when(n.between(128, 159), western).when(nothing, F.lit("")).otherwise(plain)


def _reference(p: Column) -> Column:
    """A text after an ampersand, without further ones, with the reference that it begins with decoded."""
    named, legacy, _ = _references()
    decimal, hexadecimal = F.regexp_extract(p, "^#0*([0-9]+);?", 1), F.regexp_extract(p, "^#[xX]0*([0-9A-Fa-f]+);?", 1)
    rest = F.regexp_replace(p, "^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", "")
    whole, part = F.regexp_extract(p, "^[^\t\n\f <#;]{1,32};", 0), F.regexp_extract(p, legacy, 0)
    key = lambda name: F.concat(F.lit("\x01"), name, F.lit("\x02"))
    value = lambda name: F.substring_index(F.call_function("substring_index", F.lit(named), key(name), F.lit(-1)), "\x01", 1)
    after = lambda name: F.call_function("substring", p, F.length(name) + 1)
    number = lambda digits, most, base: F.when(F.length(digits) <= most, F.conv(digits, base, 10).try_cast("long"))
    return (
        F.when(decimal != "", F.concat(_character(number(decimal, 9, 10)), rest))
        .when(hexadecimal != "", F.concat(_character(number(hexadecimal, 8, 16)), rest))
        .when((whole != "") & (F.call_function("instr", F.lit(named), key(whole)) > 0), F.concat(value(whole), after(whole)))
        .when(part != "", F.concat(value(F.concat(part, F.lit(";"))), after(part)))
        .otherwise(F.concat(F.lit("&"), p))
    )


def decode_entities(c: Column) -> Column:
    """HTML character references, with the legacy ones that need no semicolon."""
    parts = F.split(c, "&")
    return F.when(F.instr(c, "&") > 0, F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), _reference), ""))).otherwise(c)


def clean_address(raw: Column) -> Column:
    """An address without what running text puts around and into it."""
    x = decode_entities(strip(raw))
    first = F.split(F.translate(x, t.INVISIBLE, ""), rf"(?U)(?:&nbsp;|\u00a0|{SPACE})+")[0]
    x = F.when(x.rlike(f"{_ODD}|&nbsp;"), first).otherwise(x)
    x = F.substring_index(F.substring_index(x, ";", 1), ",", 1)
    return F.trim(x, F.lit(t.EDGE_JUNK))


def percent_decode(c: Column) -> Column:
    """%XX decoded as UTF-8; malformed escapes and plus signs stay."""
    safe = F.regexp_replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(F.instr(c, "%") > 0, F.url_decode(safe)).otherwise(c)


def form_decode(c: Column) -> Column:
    """As ``percent_decode``, with plus signs for blanks."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


# --- scripts -----------------------------------------------------------------------------------
def has_lookalikes(c: Column) -> Column:
    return c.rlike(any_of("".join(t.LOOKALIKES)))


def has_non_latin(c: Column) -> Column:
    """Any letter outside A to Z, accented Latin included."""
    return c.rlike(r"[\p{L}&&[^A-Za-z]]")


def is_mixed_script(c: Column) -> Column:
    return c.rlike("[A-Za-z]") & has_non_latin(c)


def to_latin(c: Column) -> Column:
    return translate(c, t.LOOKALIKES)


def host_to_latin(c: Column) -> Column:
    return translate(c, t.HOST_LOOKALIKES)


def to_cyrillic(c: Column) -> Column:
    return translate(c, t.LATIN_TO_CYRILLIC)


def is_misspelt(c: Column) -> Column:
    """Latin letters mixed with look-alikes, and no other foreign letter that would make the word genuine."""
    genuine = c.rlike(r"[\p{L}&&[^A-Za-z" + "".join(t.LOOKALIKES) + "]]")
    return has_lookalikes(c) & ~genuine & c.rlike("[A-Za-z]")


def fix_segment(c: Column) -> Column:
    return F.when(is_misspelt(c), to_latin(c)).otherwise(c)


def latin_variant(c: Column) -> Column:
    return F.nullif(to_latin(c), c)


def cyrillic_variant(c: Column) -> Column:
    return F.nullif(to_cyrillic(c), c)


# --- hosts -------------------------------------------------------------------------------------
def normalize_host(c: Column) -> Column:
    """Lower case, look-alikes to Latin, synonyms and service prefixes undone until nothing changes."""
    prefix = "^(?:" + "|".join(p.replace(".", r"\.") for p in t.SERVICE_PREFIXES) + ")"

    def step(host: Column, _: Column) -> Column:
        known = F.coalesce(looked_up(host, t.HOST_SYNONYMS), host)
        return F.when(known.rlike(r"\..*\."), F.regexp_replace(known, prefix, "")).otherwise(known)

    host = host_base(c)
    plain = ~host.rlike(prefix) & looked_up(host, t.HOST_SYNONYMS).isNull()
    return F.when(plain, host).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(6)), host, step))


def host_base(c: Column) -> Column:
    """Lower case in Latin; the table changes foreign letters only, so plain hosts pass as they are."""
    return host_to_latin(F.lower(F.trim(strip(c), F.lit("."))))


def is_odd(c: Column) -> Column:
    """Whether a path has escapes, or characters other than printing ASCII."""
    return c.rlike(f"{_ODD}|%")


def host_notes(c: Column, host: Column | None = None) -> Column:
    """What ``normalize_host`` repaired: host:lookalikes, host:synonym. ``host`` is its result where it is known: a host
    that is no synonym's meaning and was typed in ASCII has none."""
    if host is not None:
        return F.when(c.rlike(_ODD) | host.isin(*set(t.HOST_SYNONYMS.values())), host_notes(c)).otherwise(F.array().cast("array<string>"))
    lowered = F.lower(F.trim(strip(c), F.lit(".")))
    base = host_base(c)
    undone = F.regexp_replace(base, "^(?:" + "|".join(p.replace(".", r"\.") for p in t.SERVICE_PREFIXES) + ")+(?=[^.]+\\.)", "")
    known = looked_up(base, t.HOST_SYNONYMS).isNotNull() | looked_up(undone, t.HOST_SYNONYMS).isNotNull()
    return F.filter(F.array(F.when(base != lowered, F.lit("host:lookalikes")), F.when(known, F.lit("host:synonym"))), lambda x: x.isNotNull())


def is_checkable_host(c: Column) -> Column:
    """Whether a host by itself can identify a site: no go-between, and labels of sensible length."""
    below = F.exists(F.expr(f"array({literals(*['.' + g for g in t.GENERIC_HOSTS])})"), lambda g: F.endswith(c, g))
    return ~c.isin(*t.GENERIC_HOSTS) & (F.instr(c, ".") > 0) & (F.length(F.substring_index(c, ".", 1)) >= 2) & ~below


# --- scanners ----------------------------------------------------------------------------------
def find_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(t.URL_PATTERN), F.lit(0))


def find_bare_domains(c: Column) -> Column:
    found = F.regexp_extract_all(F.regexp_replace(c, t.URL_PATTERN, " "), F.lit(t.DOMAIN_PATTERN), F.lit(1))
    lowered = F.transform(found, lambda d: F.lower(d))
    return F.filter(lowered, lambda d: F.substring_index(d, ".", -1).isin(*t.KNOWN_TLDS) & (F.length(F.substring_index(d, ".", 1)) >= 2))


def find_spelled_ids(c: Column) -> Column:
    """Numbers announced in words."""
    found = F.regexp_extract_all(c, F.lit(t.SPELLED_ID_PATTERN), F.lit(1))
    return F.transform(found, lambda d: F.regexp_replace(d, rf"(?U){SPACE}", ""))


def find_bare_handles(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(t.HANDLE_PATTERN), F.lit(1))


# --- other -------------------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def fold_text(s: pd.Series) -> pd.Series:
    """Case-folded, decomposed, without marks and punctuation; for loose comparison of titles."""
    import re
    import unicodedata

    def fold(x: str) -> str:
        kept = "".join(ch for ch in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(ch))
        return " ".join(re.sub(r"[^\w\s]", " ", kept).split())

    return s.map(fold, na_action="ignore")


def tidy(c: Column) -> Column:
    """Single blanks, no blank lines, no blanks at the ends."""
    x = F.regexp_replace(F.translate(c, "\u00a0", " "), "[ \t]+", " ")
    return strip(F.regexp_replace(x, rf"(?U)\n{SPACE}*\n+", "\n"))


def shorten(c: Column, limit: int = 200) -> Column:
    x = strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - 1), F.lit("…"))).otherwise(x)


def chat_id(c: Column) -> Column:
    """Digits of an id, without the leading 100 of long ones."""
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    return F.when(digits.startswith("100") & (F.length(digits) > 10), F.substring(digits, 4, 1 << 20)).otherwise(digits)


def date_of_1601(micros: Column) -> Column:
    """Microseconds since 1601 to a date; zero, NULL and what no date holds give NULL."""
    return _date(micros, 11_644_473_600)


def date_of_1970(micros: Column) -> Column:
    return _date(micros, 0)


def _date(micros: Column, shift: int) -> Column:
    days = F.floor(micros / 86_400_000_000) - shift // 86_400
    inside = (micros != 0) & (days >= -719_162) & (days <= 2_932_896)  # years 1 to 9999
    return F.when(inside, F.date_add(F.lit("1970-01-01").cast("date"), F.when(inside, days).cast("int")))


def trace_label(c: Column) -> Column:
    return F.coalesce(looked_up(c, t.TRACE_LABELS), c)


def confidence_label(c: Column) -> Column:
    return F.coalesce(looked_up(c, t.CONFIDENCE_LABELS), c)


def profile_label(browser: Column, profile: Column) -> Column:
    return F.when(F.length(profile) > 0, F.concat(browser, F.lit(" ("), profile, F.lit(")"))).otherwise(browser)


def age_label(built_at: Column, now: Column) -> Column:
    """today, yesterday or the number of days; empty for what is no time."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(built_at))) / 86_400)
    text = F.when(days == 0, F.lit("today")).when(days == 1, F.lit("yesterday")).otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    return F.coalesce(text, F.lit(""))


def key(platform: Column, kind: Column, value: Column) -> Column:
    return F.concat_ws(":", platform, kind, value)
