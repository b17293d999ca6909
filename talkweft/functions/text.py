"""Column expressions over text: normalizers, hashes, patterns, formats. All run inside the JVM."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of personal data, in reporting order.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "long_number": r"\b(?:\d[ -]?){12,19}\b",
    "phone": r"\b(?:\+?1[ -.]?)?(?:\(?\d{3}\)?[ -.]?)\d{3}[ -.]\d{4}\b",
}
CREDENTIAL_REQUEST = r"(?i)\b(account number|customer id|password|pin|verify your identity|social security|ssn)\b"
TOOL_BLOCK = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"


WHITE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # what counts as white space, of any script


def strip(c: Column) -> Column:
    """White space off both ends, line breaks included."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """How letters fold, read off the Unicode tables at hand: those that become one letter (from, to), and those that become several."""
    each = [(c, c.casefold()) for c in map(chr, range(sys.maxunicode + 1)) if c != c.casefold()]
    one = [(a, b) for a, b in each if len(b) == 1]
    return "".join(a for a, _ in one), "".join(b for _, b in one), tuple((a, b) for a, b in each if len(b) > 1)


def casefold(c: Column) -> Column:
    """Full case folding: as ``lower``, but for letters that lower case keeps apart (ß and ss, final sigma, ligatures).

    ASCII texts, which are most, are only lowered; letters that fold into several are replaced where a text has one.
    """
    before, after, several = _folds()
    folded = F.translate(c, before, after)
    known = F.create_map(*[F.lit(x) for pair in several for x in pair])
    spread = F.array_join(F.transform(F.split(folded, ""), lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    rare = F.translate(c, "".join(a for a, _ in several), "") != c
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).when(rare, spread).otherwise(folded)


def norm_ascii(c: Column) -> Column:
    """Lower case; runs of other than a-z and 0-9 become one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def norm_unicode(c: Column) -> Column:
    """Runs of other than letters and digits of any script become one space, then lower case."""
    return F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))


def norm_spaces(c: Column) -> Column:
    """Case folded, with white space collapsed; punctuation stays."""
    return F.trim(F.regexp_replace(casefold(c), f"{WHITE}+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(norm_unicode(c), " "), lambda w: w != "")


def stable_rank(seed: str, *parts: Column) -> Column:
    """Hex digest that orders rows the same on every run."""
    return F.sha2(F.concat_ws("\0", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def stable_int(c: Column) -> Column:
    """The first 12 hex digits of a SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 12), 16, 10).cast("long")


def usd(cents: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(cents / F.lit(100), 2))


def last4(seed: Column, salt: int) -> Column:
    return (F.lit(1000) + F.pmod(seed + F.lit(salt * 997), F.lit(9000))).cast("string")


def is_revision(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{40}$")


def has_pii(c: Column, kind: str) -> Column:
    return c.rlike("(?U)" + PII_PATTERNS[kind])


def asks_credentials(c: Column) -> Column:
    return c.rlike(CREDENTIAL_REQUEST)


def tool_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOOL_BLOCK), F.lit(1))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    return F.transform(powers, lambda p: p / total)


def top_k(scores: Column, k: int) -> Column:
    """The k largest as structs of score and index; ties go to the smaller index."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["s"]).alias("score"), p["i"].alias("index")))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-12
