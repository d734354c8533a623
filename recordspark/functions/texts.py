"""Strings."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordspark.functions.base import col, let, text, verb
from recordspark.functions.logic import coerce_string

BLANKS = r"[\s\p{Z}]+"


@verb("concat")
def concat(*vs):
    """Nulls are left out."""
    return F.concat_ws("", *[coerce_string(v) for v in vs])


@verb("upper")
def upper(s):
    return F.upper(text(s))


@verb("lower")
def lower(s):
    return F.lower(text(s))


@verb("trimLeft")
def trim_left(s):
    return F.regexp_replace(text(s), "^" + BLANKS, "")


@verb("trimRight")
def trim_right(s):
    return F.regexp_replace(text(s), BLANKS + "$", "")


@verb("trim")
def trim(s):
    return trim_left(trim_right(s))


def _capital(s: Column, rest=F.lower) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), rest(F.substring(s, 2, 1 << 30)))


@verb("capitalize")
def capitalize(s):
    return _capital(text(s))


@verb("titleCase")
def title_case(s):
    """First letters go up, the rest stays."""
    return F.array_join(F.transform(F.split(text(s), "[ \t]"), lambda w: _capital(w, lambda r: r)), " ")


@verb("contains")
def contains(s, part):
    return F.coalesce(F.contains(text(s), text(part)), F.lit(False))


@verb("startsWith")
def starts_with(s, part):
    return F.coalesce(F.startswith(text(s), text(part)), F.lit(False))


@verb("endsWith")
def ends_with(s, part):
    return F.coalesce(F.endswith(text(s), text(part)), F.lit(False))


@verb("replace")
def replace(s, find, by):
    return F.replace(text(s), text(find), text(by))


@verb("replaceRegex")
def replace_regex(s, pattern: str, by):
    return F.regexp_replace(text(s), F.lit(pattern), text(by))


@verb("padLeft")
def pad_left(s, width: int, fill=" "):
    return F.when(F.length(text(s)) < width, F.lpad(text(s), width, fill[0])).otherwise(text(s))


@verb("padRight")
def pad_right(s, width: int, fill=" "):
    return F.when(F.length(text(s)) < width, F.rpad(text(s), width, fill[0])).otherwise(text(s))


@verb("pad", "center")
def pad(s, width: int, fill=" "):
    """On both sides; the odd one goes to the right."""
    s = text(s)
    room = F.greatest(F.lit(width) - F.length(s), F.lit(0))
    left = F.floor(room / 2).cast("int")
    return F.concat(F.repeat(F.lit(fill[0]), left), s, F.repeat(F.lit(fill[0]), room - left))


@verb("truncate")
def truncate(s, n: int, ellipsis=""):
    """Cut to n characters, in which the ellipsis fits if n is longer."""
    s = text(s)
    cut = F.concat(F.substring(s, 1, n - len(ellipsis)), F.lit(ellipsis)) if n > len(ellipsis) else F.substring(s, 1, max(n, 0))
    return F.when(F.length(s) <= n, s).otherwise(cut)


@verb("split")
def split(s, delimiter: str, index=None):
    parts = F.split(text(s), re.escape(delimiter)) if delimiter else F.filter(F.split(text(s), ""), lambda x: x != "")
    if index is None:
        return parts
    return F.get(parts, F.lit(index)) if index >= 0 else F.try_element_at(parts, F.lit(index))


@verb("join")
def join(a, delimiter: str):
    """Nulls count as empty."""
    return F.array_join(F.transform(col(a), lambda x: F.coalesce(x.cast("string"), F.lit(""))), delimiter)


@verb("mask")
def mask(s, pattern: str):
    """#, A and * take a character, others stand for themselves; it ends with the text."""
    s, out, used = text(s), [], 0
    for c in pattern:
        if c in "#A*":
            used += 1
            out.append(F.substring(s, used, 1))
        else:
            out.append(F.when(F.length(s) > used, F.lit(c)).otherwise(F.lit("")))
    return F.concat(*out) if out else F.when(s.isNotNull(), F.lit(""))


@verb("reverseString")
def reverse_string(s):
    return F.reverse(text(s))


@verb("repeat")
def repeat(s, n):
    return F.repeat(text(s), F.greatest(col(n).cast("int"), F.lit(0)))


@verb("substring")
def substring(s, start, length=1 << 30):
    """From a place counted from 0."""
    return F.substring(text(s), F.greatest(col(start).cast("int"), F.lit(0)) + 1, F.greatest(col(length).cast("int"), F.lit(0)))


@verb("length")
def length(v, kind: str | None = None):
    """Characters of a string, elements of an array (kind "array"); 0 for null."""
    return F.coalesce(F.greatest(F.size(col(v)), F.lit(0)) if kind == "array" else F.length(text(v)), F.lit(0))


def words(s) -> Column:
    """Parts between blanks, _, - and where capitals start."""
    spaced = F.regexp_replace(F.regexp_replace(text(s), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, r"[ \t_-]+"), lambda w: w != "")


@verb("camelCase")
def camel_case(s):
    return F.array_join(F.transform(words(s), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(_capital(w))), "")


@verb("pascalCase")
def pascal_case(s):
    return F.array_join(F.transform(words(s), lambda w: _capital(w)), "")


@verb("snakeCase")
def snake_case(s):
    return F.array_join(F.transform(words(s), F.lower), "_")


@verb("kebabCase")
def kebab_case(s):
    return F.array_join(F.transform(words(s), F.lower), "-")


def _accents() -> tuple[str, str]:
    """Letters that decompose into a letter of ASCII and marks, and that letter."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


@verb("stripAccents")
def strip_accents(s):
    return F.translate(F.regexp_replace(text(s), r"\p{Mn}+", ""), ACCENTED, PLAIN)


@verb("slugify")
def slugify(s):
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(s)), "[^a-z0-9]+", "-"), "^-|-$", "")


@verb("match")
def match(s, pattern: str):
    return F.when(F.rlike(text(s), F.lit(pattern)), F.regexp_extract(text(s), pattern, 0))


@verb("extract")
def extract(s, pattern: str, *ignored):
    """The groups of the first match; the match, if the pattern has none."""
    groups = re.compile(pattern).groups
    found = [F.regexp_extract(text(s), pattern, i) for i in (range(1, groups + 1) if groups else [0])]
    return F.when(F.rlike(text(s), F.lit(pattern)), F.array(*found))


@verb("matches")
def matches(s, pattern: str):
    return F.coalesce(F.rlike(text(s), F.lit(pattern)), F.lit(False))


@verb("normalizeSpace")
def normalize_space(s):
    return F.trim(F.regexp_replace(text(s), BLANKS, " "))


@verb("leftOf")
def left_of(s, d):
    return F.substring_index(text(s), d, 1)


@verb("rightOf")
def right_of(s, d):
    s, at = text(s), F.instr(text(s), F.lit(d))
    return F.when(at > 0, F.substring(s, at + len(d), F.lit(1 << 30))).otherwise(s)


@verb("wrap")
def wrap(s, prefix, suffix=None):
    return F.concat(text(prefix), text(s), text(prefix if suffix is None else suffix))


@verb("clean")
def clean(s):
    """Without control characters but tab and line ends."""
    return F.regexp_replace(text(s), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


@verb("tokenize")
def tokenize(s, *ignored):
    return F.coalesce(F.filter(F.split(text(s), r"\s+"), lambda x: x != ""), F.array().cast("array<string>"))


@verb("wordCount")
def word_count(s):
    return F.size(tokenize(s))


@verb("levenshtein")
def levenshtein(a, b):
    return F.coalesce(F.levenshtein(text(a), text(b)), F.lit(0))


@verb("soundex")
def soundex(s):
    """A letter and three digits; any letter between two of one code parts them."""
    up = F.upper(text(s))
    code = lambda c: F.translate(c, "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    digit = lambda c: F.when(code(c).rlike("^[1-6]$"), code(c)).otherwise(F.lit("0"))
    chars = F.split(up, "")
    state = F.aggregate(
        F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(0))),
        F.struct(F.lit("").alias("out"), digit(F.substring(up, 1, 1)).alias("last")),
        lambda st, c: F.struct(F.concat(st["out"], F.when((digit(c) != "0") & (digit(c) != st["last"]), digit(c)).otherwise(F.lit(""))).alias("out"), digit(c).alias("last")),
        lambda st: st["out"],
    )
    return F.when(up.rlike("^[A-Z]"), F.concat(F.substring(up, 1, 1), F.rpad(F.substring(state, 1, 3), 3, "0"))).when(text(s).isNotNull(), F.lit("0000"))


#: Country -> (code that may lead, least digits, most digits, pattern, layout).
PHONES = {
    "US": ("1", 10, 10, r"^(\d{3})(\d{3})(\d+)$", "($1) $2-$3"),
    "CA": ("1", 10, 10, r"^(\d{3})(\d{3})(\d+)$", "($1) $2-$3"),
    "GB": ("44", 10, 11, r"^(\d{4})(\d+)$", "+44 $1 $2"),
    "DE": ("49", 10, 11, r"^(\d{4})(\d+)$", "+49 $1 $2"),
    "FR": ("33", 9, 9, r"^(\d)(\d\d)(\d\d)(\d\d)(\d+)$", "+33 $1 $2 $3 $4 $5"),
    "AU": ("61", 9, 9, r"^(\d)(\d{4})(\d+)$", "+61 $1 $2 $3"),
    "JP": ("81", 10, 11, r"^(\d\d)(\d{4})(\d+)$", "+81 $1-$2-$3"),
}


@verb("formatPhone")
def format_phone(s, country: str):
    raw, rule = text(s), PHONES.get(country.upper())
    if rule is None:
        return raw
    code, least, most, pattern, layout = rule
    digits = F.regexp_replace(raw, r"\D", "")
    leads = digits.startswith(code) & (F.length(digits) == 11) if code == "1" else digits.startswith(code)
    own = F.when(leads, F.substring(digits, len(code) + 1, 1 << 30)).otherwise(digits)
    return let(own, lambda d: F.when(F.length(d).between(least, most), F.regexp_replace(d, pattern, layout)).otherwise(raw))
