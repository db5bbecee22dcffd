"""Projections and filters over evidence records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import rules
from attestry.functions import secrets, text
from attestry.operators.shape import top_k

TITLE_MAX = 180


def normalise(df: DataFrame, titles: list[str], bodies: list[str], times: list[str]) -> DataFrame:
    """Add ``title``, ``excerpt``, ``authority``, ``event_time`` and ``unsafe`` from candidate columns.

    Bodies are kept, screened and redacted whole; only the title has a length.
    """
    raw = text.clean(F.coalesce(text.first_text(*map(F.col, bodies)), F.lit("")))
    lead = F.split(raw, r"[.!?]\s", 2)[0]
    named = [F.col(c) for c in titles]
    title = text.clean(F.coalesce(text.first_text(*named), lead) if named else lead, TITLE_MAX)
    when = text.first_text(*map(F.col, times)) if times else F.lit(None).cast("string")
    return df.select(
        "*",
        secrets.redact(title).alias("title"),
        secrets.redact(raw).alias("excerpt"),
        F.lit("primary").alias("authority"),
        F.try_to_timestamp(when).alias("event_time"),
        secrets.injected(raw).alias("unsafe"),
    )


def canonical_provider(*candidates: Column) -> Column:
    """First present label, lower-cased and mapped to its registered name."""
    label = F.lower(F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates]))
    pairs = [F.lit(x) for kv in rules.PROVIDER_ALIASES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label)


def secret_counts(df: DataFrame, body: str, group: str) -> DataFrame:
    """Hits per rule and group over whole texts; the rules read only texts that may hold a secret."""
    names = [name for name, _, _ in rules.SECRET_RULES]
    held = df.select(group, F.col(body).isNotNull().alias("_text"), F.when(secrets.suspect(F.col(body)), F.col(body)).alias("_body"))
    counts = held.select(group, "_text", *secrets.hit_counts(F.col("_body")))
    hits = counts.select(group, *[F.coalesce(F.col(n), F.when(F.col("_text"), 0)).alias(n) for n in names])
    some = F.greatest(*[F.col(n) for n in names]) > 0
    return hits.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(some).alias("n_with_secret"),
        *[F.sum(n).cast("bigint").alias(f"n_{n}") for n in names],
    )


def document_like(kind: Column, mime: Column, filename: Column) -> Column:
    """File-shaped record by kind, media type or extension; provider labels are not consulted."""
    return (
        F.coalesce(kind.rlike(rules.DOCUMENT_KIND), F.lit(False))
        | F.coalesce(mime.rlike(rules.DOCUMENT_MIME), F.lit(False))
        | F.coalesce(filename.rlike(rules.DOCUMENT_EXTENSION), F.lit(False))
    )


def noise_hits(body: Column) -> Column:
    return text.count_true([text.matches(body, p) for p in rules.NOISE_PATTERNS])


def without_noise(df: DataFrame, body: Column, provider: str = "github", at_least: int = 2) -> DataFrame:
    """Drop records of one provider that carry several release-chatter patterns."""
    return df.where((F.col("provider") != provider) | (noise_hits(body) < at_least))


def exact_id_hits(records: DataFrame, requests: DataFrame, keep: int = 6) -> DataFrame:
    """Records (``workspace_id``, ``record_id``, ``seq``, ``body``) naming the identifier a
    request asks for; the first ``keep`` of each request.

    Postings are cut to ``keep`` per identifier before the join, which cannot change the
    result, so an identifier named by a third of all records joins as ``keep`` rows.
    """
    postings = records.select(
        "workspace_id", "record_id", "seq",
        F.explode(F.array_distinct(F.transform(text.record_ids(F.col("body")), F.upper))).alias("identifier"),
    )
    first = top_k(postings, ["workspace_id", "identifier"], [F.asc("seq")], keep, rank="place")
    return requests.join(first, ["workspace_id", "identifier"]).select(
        "request_id", "identifier", "record_id", F.col("place").cast("bigint").alias("place")
    )


def merged_scope(lineage: Column, caller: Column) -> Column:
    """Filter value after merging: the caller's wins where it names one."""
    return F.coalesce(caller, lineage)


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _omitted(name: str) -> bool:
    return _plain(name) in rules.OMITTED_KEYS or "hash" in _plain(name)


def public_projection(df: DataFrame, workspace: str, prefix: str = "public-reference") -> DataFrame:
    """Schema-driven public view: private fields dropped, links nulled, ids replaced by aliases.

    Structs, arrays and maps are walked to any depth. The decision is taken once per field name,
    not per value, so Catalyst prunes the dropped columns out of the scan; only the keys of maps
    are data and are tested per row.
    """
    owner = F.col(workspace)
    seen = [(f.name, _public(F.col(f.name), f.dataType, f.name, owner, prefix)) for f in df.schema.fields]
    return df.select(*[c.alias(name) for name, c in seen if c is not None])


def _is_link(key: str) -> bool:
    return key.endswith("url") or key in ("href", "permalink")


def _public(value: Column, kind: T.DataType, name: str, owner: Column, prefix: str) -> Column | None:
    """Public form of a value that stands under ``name`` ("" inside an array); None when it is left out."""
    key = _plain(name)
    if name and _omitted(name):
        return None
    if _is_link(key):
        return F.lit(None).cast("string")
    if key.endswith(("id", "ids")) or key in ("source", "target"):
        what = re.sub(r"ids?$", "", key) or "ref"
        alias = lambda v: secrets.public_alias(prefix, owner, what, v)
        if isinstance(kind, T.StringType):
            return alias(value)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.transform(F.filter(value, lambda v: v.isNotNull()), alias)
    if isinstance(kind, T.StringType):
        return secrets.redact(value)
    if isinstance(kind, T.StructType):
        parts = [(f.name, _public(value[f.name], f.dataType, f.name, owner, prefix)) for f in kind.fields]
        shown = [c.alias(n) for n, c in parts if c is not None]
        return F.when(value.isNotNull(), F.struct(*shown)) if shown else None
    if isinstance(kind, T.ArrayType):
        if _public(value, kind.elementType, "", owner, prefix) is None:
            return None
        return F.transform(value, lambda v: _public(v, kind.elementType, "", owner, prefix))
    if isinstance(kind, T.MapType):
        return _public_map(value, kind, owner, prefix)
    return value


def _public_map(value: Column, kind: T.MapType, owner: Column, prefix: str) -> Column | None:
    """Public form of a map; the plain form of a key is made once per entry."""
    plain = lambda k: F.regexp_replace(F.lower(k.cast("string")), "[^a-z0-9]", "")
    text_value = isinstance(kind.valueType, T.StringType)
    if not text_value and _public(F.lit(None), kind.valueType, "", owner, prefix) is None:
        return None
    entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), plain(e["key"]).alias("plain")))
    shown = F.filter(entries, lambda e: ~(e["plain"].isin(*rules.OMITTED_KEYS) | F.contains(e["plain"], F.lit("hash"))))

    def one(key: Column, v: Column) -> Column:
        safe = _public(v, kind.valueType, "", owner, prefix)
        if not text_value:
            return safe
        what = F.coalesce(F.nullif(F.regexp_replace(key, "ids?$", ""), F.lit("")), F.lit("ref"))
        alias = secrets.public_alias(prefix, owner, what, v)
        return F.when(F.endswith(key, F.lit("url")) | key.isin("href", "permalink"), F.lit(None).cast("string")).when(
            F.endswith(key, F.lit("id")) | F.endswith(key, F.lit("ids")) | key.isin("source", "target"), F.when(v.isNotNull(), alias)
        ).otherwise(safe)

    return F.map_from_entries(F.transform(shown, lambda e: F.struct(e["key"].alias("key"), one(e["plain"], e["value"]).alias("value"))))


def intact(df: DataFrame, payload: str, stored_hash: str, release: str, current: Column) -> DataFrame:
    """Rows whose stored hash is the hash of their payload and whose release is current."""
    return df.where((F.sha2(F.col(payload), 256) == F.col(stored_hash)) & (F.col(release) == current))


def safe_url(url: Column) -> Column:
    """https link without user info, secret-looking parameters and fragment; NULL when refused."""
    allowed = url.rlike(r"^https://[^/?#@\s]+(?:[/?#]\S*)?$")
    plain = F.regexp_replace(url, r"#.*$", "")
    head = F.substring_index(plain, "?", 1)
    query = F.when(F.instr(plain, "?") > 0, F.substring(plain, F.length(head) + 2, 100000000))
    params = F.filter(
        F.split(F.coalesce(query, F.lit("")), "&"),
        lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(rules.URL_SECRET_PARAM),
    )
    joined = F.array_join(params, "&")
    return F.when(allowed, secrets.redact(F.when(joined == "", head).otherwise(F.concat(head, F.lit("?"), joined))))
