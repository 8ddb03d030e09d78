"""Text expressions for reviews and drug names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewatch.constants import EVENT_STEMS, MARKUP, SALT_WORDS, TARGET_DRUGS

# White space as Unicode defines it, plus the four separator control characters.
BLANK_CHARS = "".join(
    chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                     0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def clean_html(text: Column, markup: Sequence[tuple[str, str]] = MARKUP) -> Column:
    """Replace markup in order, squeeze, and take off one pair of surrounding quotes."""
    for pattern, replacement in markup:
        # Unicode classes cost time, so only where the pattern has one
        flags = "(?iU)" if "\\s" in pattern else "(?i)"
        text = F.regexp_replace(text, flags + pattern, replacement)
    return F.trim(F.regexp_replace(squeeze(text), '^"(?:(.*)")?$', "$1"))


def first_case(cases: Iterable[tuple[Column, object]]) -> Column:
    """Value of the first condition that holds, else null, as one CASE expression.

    A coalesce over single WHENs means the same but runs many times slower on long lists.
    """
    return reduce(
        lambda chain, case: chain.when(*case) if chain is not None else F.when(*case), cases, None
    )


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the lower-cased text holds any of the words; false for null text."""
    lowered = F.lower(text)
    hit = reduce(lambda a, b: a | b, [lowered.contains(w.lower()) for w in words])
    return F.coalesce(hit, F.lit(False))


def mentions_event(text: Column, stems: Sequence[str] = EVENT_STEMS) -> Column:
    return contains_any(text, stems)


def first_target(name: Column, targets: Sequence[str] = TARGET_DRUGS) -> Column:
    """The first of ``targets`` that occurs in the name, else null."""
    lowered = F.lower(name)
    return first_case((lowered.contains(t.lower()), F.lit(t)) for t in targets)


def word_count(text: Column) -> Column:
    """Number of pieces when split at single spaces."""
    return F.size(F.split(text, " "))


def review_id(drug: Column, text: Column, chars: int | None = None, digits: int | None = None) -> Column:
    """SHA-256 over the drug name, a separator and the whole text: only equal reviews share it.

    ``chars`` hashes no more of the text than that, ``digits`` keeps no more of the hex digits;
    reviews that open alike may then share an id.
    """
    text = F.coalesce(text, F.lit(""))
    text = text if chars is None else F.substring(text, 1, chars)
    key = F.sha2(F.concat(F.coalesce(drug, F.lit("")), F.lit("\x1f"), text), 256)
    return key if digits is None else F.substring(key, 1, digits)


def strip_salts(name: Column, salts: Sequence[str] = SALT_WORDS) -> Column:
    """Drop salt words standing as whole words, then squeeze."""
    words = "|".join(re.escape(s) for s in salts)
    return squeeze(F.regexp_replace(name, rf"(?iU)\b({words})\b", ""))


def sorted_tokens(name: Column) -> Column:
    """Words of the name in sorted order, joined by one space."""
    return F.array_join(F.array_sort(F.split(squeeze(name), " ")), " ")
