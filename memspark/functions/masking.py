"""Masking of keys, addresses and numbers by category: redact, hash or mask.

Every category is a pattern and, where its matches must pass a check (Luhn,
GB 11643, octets), an expression over the match: a text is split into its
matches and what lies between, each match decided by itself, and put together
again. All of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of each category, in the order in which they apply.
PATTERNS = {
    "api_key": r"(?:sk-ant-|sk-proj-|sk-)[A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|Bearer\s+[A-Za-z0-9._-]{20,}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "id_card": r"(?<!\d)\d{17}[\dXx](?!\d)",
    "bank_card": r"(?<!\d)\d{16,19}(?!\d)",
    "phone": r"(?<!\d)1[3-9]\d{9}(?!\d)",
    "ipv4": r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)",
}
# The weights and check characters of GB 11643; how many characters of a number stay at either end.
WEIGHTS, CHECKS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2], "10X98765432"
ENDS = {"phone": (3, 4), "id_card": (4, 2), "bank_card": (4, 4)}


def _digits(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda x: x.cast("int"))


def id_card(c: Column) -> Column:
    """Whether 17 digits and a check character agree by GB 11643."""
    weighted = F.zip_with(_digits(F.substring(c, 1, 17)), F.array(*map(F.lit, WEIGHTS)), lambda d, w: d * w)
    rest = F.aggregate(weighted, F.lit(0), lambda s, x: s + x) % 11
    return F.substr(F.lit(CHECKS), rest + 1, F.lit(1)) == F.upper(F.substring(c, 18, 1))


def luhn(c: Column) -> Column:
    """Whether the digits pass Luhn's check: from the right, of every second one twice its value, less 9 if above 9."""
    parts = F.transform(F.reverse(_digits(c)), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x) % 10 == 0


def octets(c: Column) -> Column:
    """Whether all parts are 255 at most."""
    return F.forall(F.split(c, r"\."), lambda p: p.cast("int") <= 255)


VALID: dict[str, Callable[[Column], Column]] = {"id_card": id_card, "bank_card": luhn, "ipv4": octets}


def _masked(category: str, c: Column) -> Column:
    """The match with what tells most covered by stars."""
    if category == "api_key":  # what comes before the secret: the maker's prefix, else two characters
        return F.concat(F.regexp_extract(c, r"^(?:[^-]{0,9}(?=-)|..)", 0), F.lit("-***"))
    if category == "email":
        return F.regexp_replace(c, r"^(.)[^@]*@", "$1***@")
    if category == "ipv4":
        return F.regexp_replace(c, r"\.\d+", ".*")
    head, tail = ENDS[category]
    stars = F.repeat(F.lit("*"), F.length(c) - (head + tail))
    return F.concat(F.substring(c, 1, head), stars, F.substring(c, -tail, tail))


def _put(category: str, strategy: str, c: Column) -> Column:
    name = category.upper()
    if strategy == "redact":
        return F.lit(f"[{name}]")
    return _masked(category, c) if strategy == "mask" else F.concat(F.lit(f"[{name}:"), F.substring(F.sha2(c, 256), 1, 8), F.lit("]"))


def masked(c: Column, strategy: str = "redact", categories: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """The text with [CATEGORY], [CATEGORY:hash] or the ends only in place of each match; a null text stays null."""
    if strategy not in ("redact", "hash", "mask") or set(categories) - set(PATTERNS):
        raise ValueError(f"no such masking: {strategy!r}, {categories!r}")

    def one(text: Column, category: str) -> Column:
        pattern, valid = F.lit(PATTERNS[category]), VALID.get(category)
        if strategy == "redact" and valid is None:
            return F.regexp_replace(text, PATTERNS[category], f"[{category.upper()}]")
        found = F.regexp_extract_all(text, pattern, F.lit(0))
        kept = F.split(text, PATTERNS[category], -1)
        new = F.transform(found, lambda m: _put(category, strategy, m) if valid is None else F.when(valid(m), _put(category, strategy, m)).otherwise(m))
        whole = F.concat(F.array_join(F.flatten(F.zip_with(F.slice(kept, 1, F.size(new)), new, lambda a, b: F.array(a, b))), ""), F.element_at(kept, -1))
        return F.when(F.size(found) > 0, whole).otherwise(text)

    return reduce(one, [k for k in PATTERNS if k in categories], c)
