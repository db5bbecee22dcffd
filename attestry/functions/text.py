"""Text as column expressions: cleaning, tokens, identifiers, sentence units."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attestry import rules

_ANY_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def pattern(regex: str) -> str:
    """Give ``\\b`` its ASCII meaning under Java regular expressions."""
    head = ""
    for flag in ("(?i)", "(?s)"):
        if regex.startswith(flag):
            head, regex = head + flag, regex[len(flag):]
    if regex.startswith(r"\b"):
        head, regex = head + r"(?<!\w)", regex[2:]
    return head + regex.replace(r"\b", _ANY_BOUNDARY)


def matches(col: Column, regex: str) -> Column:
    return F.coalesce(col.rlike(pattern(regex)), F.lit(False))


def extract_all(col: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern(regex)), F.lit(group))


def replace(col: Column, regex: str, value: str) -> Column:
    return F.regexp_replace(col, pattern(regex), value)


def clean(col: Column, limit: int | None = None) -> Column:
    """Collapse white space and control characters, trim, cut to ``limit`` code points."""
    trimmed = F.trim(F.regexp_replace(col, r"\s{2,}|[\x00-\x1f]", " "))  # single blanks are left alone
    return trimmed if limit is None else F.left(trimmed, F.lit(limit))


def first_text(*cols: Column) -> Column:
    """First value that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def record_ids(col: Column) -> Column:
    return extract_all(col, rules.RECORD_ID)


def task_ids(col: Column) -> Column:
    return F.array_distinct(extract_all(col, rules.TASK_ID))


def product_names(col: Column, own_names: list[str] | None = None) -> Column:
    found = F.array_distinct(extract_all(col, rules.PRODUCT_NAME))
    return F.array_except(found, F.array(*[F.lit(n) for n in own_names])) if own_names else found


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def stem_tokens(col: Column) -> Column:
    """Question/answer tokens: lower case, longer than two, no stop words, suffix cut."""
    words = F.split(F.trim(F.regexp_replace(F.lower(clean(col)), r"[^a-z0-9-]+", " ")), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(rules.ANSWER_STOP_WORDS))
    return F.transform(kept, lambda w: F.regexp_replace(w, r"(?:ing|ed|es|s)$", ""))


def search_tokens(col: Column) -> Column:
    """Search tokens of at least two characters: letters and digits, with ``#`` and ``-`` inside only."""
    words = F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9][a-z0-9#-]*[a-z0-9]"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(rules.SEARCH_STOP_WORDS))


def wording_tokens(col: Column) -> Column:
    """Distinct task-wording tokens of at least three characters."""
    words = F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(rules.WORDING_STOP_WORDS)))


def prose_sentences(col: Column) -> Column:
    """Split after ``.!?`` before a capital or a digit.

    Control characters become blanks first and runs of blanks one, so every sentence comes out clean.
    """
    single = F.regexp_replace(clean(col), " {2,}", " ")
    return F.split(single, r" (?<=[.!?] )(?=[A-Z0-9])")


def plain_sentences(col: Column) -> Column:
    """Split after ``.!?`` at any white space."""
    return F.split(F.trim(col), r"(?<=[.!?])\s+")


def signal(col: Column, keywords: str) -> Column:
    """True when a keyword occurs at least once without a negation just before it.

    The text is cut at every hit, and the 40 characters before a hit are read from the
    last twelve pieces: every piece but the first holds a hit of four characters or
    more, so twelve always cover them and the work stays linear in the text.
    """
    hit = pattern("(?i)" + keywords)
    # Mark every hit, then look at the 40 characters that precede each mark.
    marked = F.regexp_replace(col, hit, "\u0001$0\u0002")
    pieces = F.split(marked, "\u0001")
    plain = lambda c: F.regexp_replace(c, "\u0002", "")
    before = F.transform(
        F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda piece, i: F.right(
            plain(F.array_join(F.slice(pieces, F.greatest(i - 10, F.lit(1)), F.least(i + 1, F.lit(12))), "")),
            F.lit(40),
        ),
    )
    return F.coalesce(F.exists(before, lambda b: ~b.rlike(pattern(rules.NEGATION))), F.lit(False))


def grade_text(col: Column) -> Column:
    """Lower-cased words joined by single blanks; see :func:`compatibility_form` for NFKC."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(StringType())
def compatibility_form(values: pd.Series) -> pd.Series:
    """NFKC form of a text column; Spark has no built-in for it."""
    return values.str.normalize("NFKC")


def claim_key(col: Column) -> Column:
    marks = F.regexp_replace(F.lower(col), r"[#*_`>]", " ")
    return F.trim(F.regexp_replace(marks, r"[^a-z0-9]+", " "))


def count_true(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags])
