"""Text expressions: strip, accents, spaces, title case, safe casts."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


#: Unicode's white space.
BLANKS = "\t\n\x0b\f\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """All white space at both ends; by default Spark's trim takes spaces only."""
    return F.btrim(c, F.lit(BLANKS))


@functools.cache
def _accents() -> tuple[str, str]:
    """What translate() replaces and drops: characters of the basic plane that lose their marks."""
    one, gone = {"đ": "d", "Đ": "D"}, []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code < 0xE000 or ch in one:
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        bare = unicodedata.normalize("NFC", bare)
        if not bare:
            gone.append(ch)
        elif bare != ch and len(bare) == 1:
            one[ch] = bare
    return "".join(one) + "".join(gone), "".join(one.values())


def remove_accents(c: Column) -> Column:
    """Stripped text without marks; null gives the empty text."""
    source, target = _accents()
    return F.translate(strip(F.coalesce(c, F.lit(""))), source, target)


def normalize_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[._\-/]", " "), r"(?U)\s+", " "))


def normalize_token(c: Column) -> Column:
    return normalize_spaces(F.lower(remove_accents(c)))


def title(c: Column) -> Column:
    """Every run of letters starts with a capital; initcap looks at spaces only."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def safe_double(c: Column) -> Column:
    """Null where the text is no number."""
    s = strip(c)
    low = F.lower(s)
    return (
        F.when(s.rlike(NUMBER), s.try_cast("double"))
        .when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
        .when(low.isin("-inf", "-infinity"), F.lit(float("-inf"))))


def safe_int(c: Column) -> Column:
    """Truncates; null outside the int range."""
    d = safe_double(c)
    return F.when(F.abs(d) < 2147483648.0, d.cast("int"))


def coerce_frontage(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin("true", "t", "1"), 1.0).when(low.isin("false", "f", "0"), 0.0).otherwise(safe_double(c))
