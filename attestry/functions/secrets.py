"""Redaction of credentials and screening of hostile text, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import rules
from attestry.functions import text


def suspect(col: Column) -> Column:
    """Whether a text holds a word that some redaction rule needs; no rule finds anything in other texts.

    Replacements bring in no such word, so the test holds for the text that earlier rules left behind.
    """
    low = F.lower(col)
    has = lambda c, words: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])
    assigned = has(col, ":=") & has(low, rules.CREDENTIAL_STEMS)
    return assigned | has(col, rules.SECRET_MARKS) | has(low, rules.SECRET_WORDS)


def redact(col: Column) -> Column:
    """Apply every redaction rule in order, to texts that may hold a secret."""
    out = col
    for _, regex, value in rules.SECRET_RULES:
        out = text.replace(out, regex, value)
    return F.when(suspect(col), out).otherwise(col)


def hit_counts(col: Column) -> list[Column]:
    """One count per rule, taken on the text the rules before it left behind."""
    counts = []
    for name, regex, value in rules.SECRET_RULES:
        counts.append(F.regexp_count(col, F.lit(text.pattern(regex))).alias(name))
        col = text.replace(col, regex, value)
    return counts


def sensitive_field(key: Column) -> Column:
    compact = F.lower(F.regexp_replace(key, "(?i)[^a-z0-9]", ""))
    return (
        compact.isin(rules.SENSITIVE_FIELDS)
        | compact.rlike(rules.SENSITIVE_VENDOR_FIELD)
        | key.rlike(rules.SENSITIVE_FIELD_SUFFIX)
    )


def redact_map(col: Column, hidden: bool = False) -> Column:
    """Replace values of sensitive keys whole and scan all others; drop hidden keys if asked."""
    out = F.transform_values(
        col,
        lambda k, v: F.when(sensitive_field(k) & v.isNotNull(), F.lit("[REDACTED]")).otherwise(redact(v)),
    )
    return F.map_filter(out, lambda k, v: ~k.isin(rules.HIDDEN_FIELDS)) if hidden else out


def redact_deep(value: Column, kind: T.DataType, name: str = "", hidden: bool = False) -> Column:
    """Redact structs, arrays and maps to any depth; values under a sensitive name become one marker string.

    Map values keep their type, so a sensitive key over values that are not strings gives null. With
    ``hidden`` the hidden fields of structs and maps are dropped at every level.
    """
    marker = F.lit("[REDACTED]")
    if name and is_sensitive(name):
        return F.when(value.isNotNull(), marker)
    if isinstance(kind, T.StringType):
        return redact(value)
    if isinstance(kind, T.StructType):
        fields = [f for f in kind.fields if not (hidden and f.name in rules.HIDDEN_FIELDS)]
        parts = [redact_deep(value[f.name], f.dataType, f.name, hidden).alias(f.name) for f in fields]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: redact_deep(v, kind.elementType, "", hidden))
    if isinstance(kind, T.MapType):
        instead = marker if isinstance(kind.valueType, T.StringType) else F.lit(None)
        shown = F.map_filter(value, lambda k, v: ~k.isin(rules.HIDDEN_FIELDS)) if hidden else value
        return F.transform_values(
            shown, lambda k, v: F.when(sensitive_field(k) & v.isNotNull(), instead).otherwise(redact_deep(v, kind.valueType, "", hidden))
        )
    return value


def is_sensitive(name: str) -> bool:
    """``sensitive_field`` for a name that is known while the plan is built."""
    compact = re.sub("[^a-z0-9]", "", name.lower())
    return (
        compact in rules.SENSITIVE_FIELDS or re.search(rules.SENSITIVE_VENDOR_FIELD, compact) is not None
        or re.search(rules.SENSITIVE_FIELD_SUFFIX, name) is not None
    )


def injected(col: Column) -> Column:
    return text.matches(col, rules.INJECTION)


def hostile_reason(col: Column) -> Column:
    credential = text.matches(col, rules.CREDENTIAL_MENTION)
    disclosure = text.matches(col, rules.DISCLOSURE_VERB)
    override = text.matches(col, rules.INSTRUCTION_OVERRIDE)
    return F.when(credential & disclosure, rules.REASON_DISCLOSURE).when(
        override & (credential | disclosure), rules.REASON_OVERRIDE
    )


def safe_cell(col: Column) -> Column:
    """Neutralise spreadsheet formulas."""
    return F.when(col.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)


def public_alias(prefix: str, workspace: Column, kind: str | Column, value: Column) -> Column:
    """Stable public reference of a private id: salted by workspace, not reversible."""
    digest = F.sha2(
        F.concat_ws(":", F.lit(prefix), workspace.cast("string"), F.lit(kind), value.cast("string")), 256
    )
    return F.concat(F.lit("public-"), F.lit(kind), F.lit("-"), F.left(digest, F.lit(32)))
