"""Grouping evidence into tasks: duplicates, identifier components, careful attachment.

Nothing here lists all pairs of a group. Records that look the same to a rule are
folded into one row with a count, candidate pairs come from rare shared tokens, and
components work on identifiers instead of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import dates, text
from attestry.operators.shape import earliest
from attestry.session import cut_lineage

MIN_SHARED = 5
MIN_COVERAGE = 0.8
MIN_JACCARD = 0.65
MAX_FREE = 6  # actors and products of a span whose 2^n choices are offered as keys


def mark_duplicates(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Add the first ``seq`` of the same keys and whether the row is a later copy.

    The first of each group is an aggregate joined back. Its side has one row per
    group, so AQE can split a group of copies that holds a large share of the rows.
    """
    first = df.groupBy(*keys).agg(F.min(seq).alias("first_seq"))
    return df.join(first, keys).withColumn("is_duplicate", F.col(seq) != F.col("first_seq"))


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return earliest(df, keys, [seq])


def merge_lanes(lanes: dict[str, DataFrame], keys: list[str], seq: str) -> DataFrame:
    """Union of retrieval lanes with one row per key: the first one, and which lanes had it."""
    parts = [df.withColumn("lane", F.lit(name)) for name, df in lanes.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    flags = [F.max((F.col("lane") == n).cast("int")).alias(f"in_{n}") for n in lanes]
    return union.groupBy(*keys).agg(F.min(seq).alias(seq), *flags)


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph (``a``, ``b``) as (``node``, ``label``), label = least node.

    Each round takes the least label among neighbours, then follows it one step
    further, so long chains shrink by halves. A node with very many edges is reduced
    by a partial minimum before the shuffle. Every round is checkpointed.
    """
    edges = cut_lineage(edges.select("a", "b").distinct())
    proper = edges.where("a <> b")
    both = cut_lineage(proper.union(proper.select("b", "a")).distinct())
    alone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = cut_lineage(alone.select("node", F.col("node").alias("label")))
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        targets = stepped.select(F.col("node").alias("t"), F.col("label").alias("further"))
        jumped = stepped.join(targets, F.col("label") == F.col("t")).select("node", "old", F.col("further").alias("label"))
        after = cut_lineage(jumped)
        if after.where("old <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def identifier_components(df: DataFrame, key: str, ids: str) -> DataFrame:
    """Component of each row of ``df`` (``key``, array column ``ids``) through shared ids.

    Rows with the same least id are one node. Only ids that stand in several nodes link them, each to the
    least of its nodes; all other ids are counted once and go no further. A single id shared by a third
    of all rows adds no more links than it has nodes.
    """
    with_ids = df.where(F.size(ids) > 0).withColumn("_first", F.array_min(ids))
    held = with_ids.select("_first", F.explode(ids).alias("_id"))
    shared = held.groupBy("_id").agg(F.min("_first").alias("_hub"), F.max("_first").alias("_top")).where("_hub <> _top")
    links = held.join(shared.select("_id", "_hub"), "_id").where("_first <> _hub").select(F.col("_hub").alias("a"), F.col("_first").alias("b"))
    labels = connected(links).select(F.col("node").alias("_first"), "label")
    return with_ids.select(key, "_first").join(labels, "_first", "left").select(key, F.coalesce("label", "_first").alias("component"))


def _actor_prefix(span: Column) -> Column:
    lead = F.regexp_extract(span, "(?s)^(.*?)" + text.pattern(rules.WORDING_ACTION).replace("(?i)", "(?i:") + ")", 1)
    return F.trim(F.regexp_replace(F.trim(lead), r"[,:-]+$", ""))


def actor_tokens(span: Column) -> Column:
    prefix = _actor_prefix(span)
    single = ~text.matches(prefix, r"\b(?:and|&)\b|,")
    role = prefix.rlike(r"(?i)^(?:i|we|you|engineering|the team|support|security|operations)$")
    proper = prefix.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?$")
    words = F.filter(F.regexp_extract_all(F.lower(prefix), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    return F.when(single & (role | proper), F.array_distinct(words)).otherwise(F.array().cast("array<string>"))


def product_tokens(span: Column) -> Column:
    found = text.extract_all(span, r"\b[A-Z][a-z]+[A-Z][A-Za-z0-9]*\b")
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def named_scopes(title: Column, span: Column, actors: Column, products: Column) -> Column:
    words = text.extract_all(F.concat_ws(" ", title, span), r"\b[A-Z][A-Za-z0-9]{2,}\b")
    lower = F.transform(F.filter(words, lambda w: ~w.rlike("^[A-Z0-9]+$")), lambda w: F.lower(w))
    generic = text.literal_array(rules.GENERIC_SCOPES + list(rules.MONTHS) + rules.WEEKDAYS)
    return F.array_sort(F.array_except(F.array_except(F.array_except(F.array_distinct(lower), generic), actors), products))


def wording_features(df: DataFrame) -> DataFrame:
    """Columns that decide whether two task records (``title``, ``span``, ``source_date``) say the same."""
    span = F.col("span")
    base = df.withColumns(
        {
            "tokens": F.array_sort(text.wording_tokens(span)),
            "anchors": dates.anchors(span, F.col("source_date")),
            "undated": dates.unresolved(span, F.col("source_date")),
            "years": F.array_sort(dates.explicit_years(span)),
            "actors": F.array_sort(actor_tokens(span)),
            "products": F.array_sort(product_tokens(span)),
        }
    )
    return base.withColumn("scopes", named_scopes(F.col("title"), span, F.col("actors"), F.col("products")))


FEATURE_COLUMNS = ["tokens", "anchors", "undated", "years", "actors", "products", "scopes"]


def _controlled(left: str, right: str) -> Column:
    """Differences are only years, actors and products, and not on both sides beyond years."""
    l, r = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    l_only, r_only = F.array_except(l("tokens"), r("tokens")), F.array_except(r("tokens"), l("tokens"))

    def beyond(only: Column, side) -> Column:
        allowed = F.concat(side("years"), side("actors"), side("products"))
        return F.size(F.array_except(only, allowed)) > 0

    extra_l = F.size(F.array_except(l_only, l("years"))) > 0
    extra_r = F.size(F.array_except(r_only, r("years"))) > 0
    return ~beyond(l_only, l) & ~beyond(r_only, r) & ~(extra_l & extra_r)


def same_wording(left: str, right: str) -> Column:
    l, r = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    shared = F.size(F.array_intersect(l("tokens"), r("tokens")))
    union = F.size(l("tokens")) + F.size(r("tokens")) - shared
    dated = ~l("undated") & ~r("undated") & (
        (F.size(l("anchors")) == 0) | (F.size(r("anchors")) == 0) | dates.compatible(l("anchors"), r("anchors"))
    )
    return (
        (shared >= MIN_SHARED)
        & (shared >= MIN_COVERAGE * F.least(F.size(l("tokens")), F.size(r("tokens"))))
        & (shared >= MIN_JACCARD * union)
        & (l("scopes") == r("scopes"))
        & dated
        & _controlled(left, right)
    )


def folded(df: DataFrame, key: str, extra: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """The wording features of each record, written once: signatures and their members both read them; ``kept`` rides along."""
    return cut_lineage(wording_features(df).select(key, "workspace_id", "provider", *extra, *FEATURE_COLUMNS, *kept))


def signatures(df: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """Fold records that no wording rule can tell apart into one row with a count; :func:`folded` gives them with features."""
    keys = ["workspace_id", "provider", *extra, *FEATURE_COLUMNS]
    features = df if set(FEATURE_COLUMNS) <= set(df.columns) else wording_features(df)
    return features.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("rep"))


def _probes(each: DataFrame) -> DataFrame:
    """Tokens by which a signature looks for its matches: few, rare, and none can be missed.

    Apart from years, only one of two matching records may have words of its own, so for the
    other one every word but its years occurs in both and its rarest such word finds the
    pair. A signature of nothing but years uses its n - ceil(t n) + 1 rarest tokens, of
    which any set with Jaccard >= t shares at least one.
    """
    frequency = each.groupBy("workspace_id", "token").agg(F.count(F.lit(1)).alias("df"))
    weighed = each.join(frequency, ["workspace_id", "token"])
    keys = ["workspace_id", "rep"]
    rarest = weighed.where("core").groupBy(*keys).agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    coreless = weighed.join(rarest.select(*keys), keys, "left_anti")
    ordered = Window.partitionBy(*keys).orderBy("df", "token")  # the tokens of one span of at most 360 characters
    keep = F.col("size") - F.ceil(MIN_JACCARD * F.col("size")) + 1
    prefix = coreless.withColumn("at", F.row_number().over(ordered)).where(F.col("at") <= keep)
    return rarest.select(*keys, "token").union(prefix.select(*keys, "token"))


def members(features: DataFrame, sigs: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """The signature (``rep``) of every record of :func:`folded`."""
    keys = ["workspace_id", "provider", *extra, *FEATURE_COLUMNS]
    records = features.select(key, *keys).alias("folded")
    reps = sigs.select("rep", *keys).alias("reps")
    same = [F.col(f"folded.{c}").eqNullSafe(F.col(f"reps.{c}")) for c in keys]
    return records.join(reps, same).select(f"folded.{key}", "reps.rep")


def wording_candidates(sigs: DataFrame, either: str | None = None) -> DataFrame:
    """Signature pairs (``rep`` < ``rep2``) among which are all of the same wording.

    Of two matching records one (the seeker) has no words of its own but years, and the
    other's own words are years, actors or products of its span. Without four-digit words
    the seeker's words are therefore the other's words less some of its actors and products,
    and each record offers its words under every such choice. Scopes, dates (as meeting
    codes) and the other provider are parts of the key too, so records of one provider
    never meet, and a template in many records meets only at dates that agree.

    Records with more than ``MAX_FREE`` actors and products would offer too many choices and
    are looked up by the seeker's rarest word instead. ``either`` names a boolean column
    that must hold on at least one side.
    """
    usable = sigs.where((F.size("tokens") >= MIN_SHARED) & ~F.col("undated")).withColumn(
        "core", F.filter("tokens", lambda w: ~w.rlike("^[0-9]{4}$"))
    )
    usable = usable.withColumn("free", F.array_intersect("core", F.concat("actors", "products")))
    flag = F.col(either) if either else F.lit(True)

    def key(words: Column) -> Column:
        return F.xxhash64(F.concat_ws(" ", words), F.concat_ws(" ", "scopes"))

    place = ["workspace_id", "words", "code"]
    seek = usable.select(
        "workspace_id", "provider", "rep", flag.alias("open"), key(F.col("core")).alias("words"),
        F.explode(dates.meeting_codes(F.col("anchors"), True)).alias("code"),
    )
    masks = F.expr("sequence(0, shiftleft(1, size(free)) - 1)")
    fits = F.size("tokens") - F.bit_count("mask") >= MIN_JACCARD * F.size("tokens")
    left_out = F.expr("filter(free, (word, i) -> shiftright(mask, i) & 1 = 1)")
    offer = (
        usable.where(F.size("free") <= MAX_FREE)
        .withColumn("mask", F.explode(masks))
        .where(fits)
        .select(
            "workspace_id", F.col("provider").alias("own"), F.col("rep").alias("rep2"), flag.alias("open2"), "anchors",
            key(F.array_except("core", left_out)).alias("words"),
        )
        .withColumn("code", F.explode(dates.meeting_codes(F.col("anchors"), False)))
        .drop("anchors")
    )
    seekers = seek.groupBy(*place).agg(F.collect_set("provider").alias("providers"))  # as many as there are connectors
    aimed = offer.join(seekers, place).withColumn(
        "provider", F.explode(F.array_except("providers", F.array("own")))
    ).drop("providers")
    on = [*place, "provider"]
    met = seek.where("open").join(aimed, on).select("rep", "rep2")
    if either:
        met = met.union(seek.where("NOT open").join(aimed.where("open2"), on).select("rep", "rep2"))
    wide = usable.where(F.size("free") > MAX_FREE)
    if not wide.isEmpty():
        met = met.union(_wide_candidates(usable, wide, flag))
    return met.where("rep <> rep2").select(
        F.least("rep", "rep2").alias("rep"), F.greatest("rep", "rep2").alias("rep2")
    ).distinct()


def _wide_candidates(usable: DataFrame, wide: DataFrame, flag: Column) -> DataFrame:
    near = usable.join(wide.select("workspace_id").distinct(), "workspace_id", "left_semi")
    each = near.select(
        "workspace_id", "rep", F.size("tokens").alias("size"), "years", F.explode("tokens").alias("token")
    ).withColumn("core", ~F.array_contains("years", F.col("token"))).drop("years")
    other = wide.select("workspace_id", F.explode("tokens").alias("token"), F.col("rep").alias("rep2"), flag.alias("open2"))
    seekers = _probes(each).join(near.select("rep", flag.alias("open")), "rep")
    return seekers.join(other, ["workspace_id", "token"]).where("open OR open2").select("rep", "rep2")


def wording_pairs(sigs: DataFrame, either: str | None = None) -> DataFrame:
    """Signature pairs of different providers with the same wording, each pair once.

    ``sigs`` is read several times, so it is a written table. Sides are the structs ``l`` and ``r``;
    ``either`` as in ``wording_candidates``.
    """
    candidates = wording_candidates(sigs, either)
    fields = [c for c in sigs.columns if c != "rep"]
    packed = sigs.select("rep", F.struct(*fields).alias("s"))
    joined = candidates.join(packed.withColumnRenamed("s", "l"), "rep").join(
        packed.select(F.col("rep").alias("rep2"), F.col("s").alias("r")), "rep2"
    )
    return joined.where((F.col("l.provider") != F.col("r.provider")) & same_wording("l", "r"))


def wording_links(df: DataFrame, key: str) -> DataFrame:
    """Number of other records with the same wording (``n_links``) and the first of them by ``key``, per record."""
    features = folded(df, key, [])
    sigs = cut_lineage(signatures(features, key, []))
    pairs = wording_pairs(sigs)
    sides = pairs.select("rep", F.col("rep2").alias("other"), F.col("r.n").alias("n")).union(
        pairs.select("rep2", "rep", "l.n")
    )
    linked = sides.groupBy("rep").agg(F.sum("n").alias("n_links"), F.min("other").alias("first_match"))
    return members(features, sigs, key, []).join(linked, "rep", "left").select(
        key, F.coalesce("n_links", F.lit(0)).alias("n_links"), "first_match"
    )


def reciprocal_unique(pairs: DataFrame) -> DataFrame:
    """Pairs in which each record is the other's only match (``a``, ``b``, ``n_a``, ``n_b``)."""
    sides = pairs.select(F.col("a").alias("x"), F.col("n_b").alias("n")).union(pairs.select("b", "n_a"))
    single = sides.groupBy("x").agg(F.sum("n").alias("degree")).where(F.col("degree") == 1).select("x")
    return pairs.join(single, F.col("a") == F.col("x"), "left_semi").join(
        single, F.col("b") == F.col("x"), "left_semi"
    )


def attach_idless(idless: DataFrame, wording: DataFrame, entities: DataFrame) -> DataFrame:
    """Component an id-less record joins, only when exactly one qualifies.

    ``wording`` and ``entities`` hold (``record_id``, ``component``) matches. One wording
    match beats entity matches; several wording matches mean the record stays alone.
    """

    def counted(matches: DataFrame, name: str) -> DataFrame:
        return matches.groupBy("record_id").agg(
            F.min("component").alias(f"{name}_lo"), F.max("component").alias(f"{name}_hi")
        )

    joined = idless.select("record_id").join(counted(wording, "w"), "record_id", "left").join(
        counted(entities, "e"), "record_id", "left"
    )
    chosen = (
        F.when(F.col("w_lo") == F.col("w_hi"), F.struct(F.col("w_lo").alias("component"), F.lit("wording").alias("matched_by")))
        .when(
            F.col("w_lo").isNull() & (F.col("e_lo") == F.col("e_hi")),
            F.struct(F.col("e_lo").alias("component"), F.lit("entity").alias("matched_by")),
        )
    )
    return joined.select("record_id", chosen.alias("c")).where("c IS NOT NULL").select("record_id", "c.component", "c.matched_by")


def attach_documents(documents: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster a document joins: the only one that shares an identifier with it.

    ``documents`` is (``record_id``, ``ids``), ``clusters`` is (``cluster``, ``identifier``);
    cluster identifiers are fixed beforehand, so one document cannot bridge two clusters.
    """
    each = documents.select("record_id", F.explode("ids").alias("identifier"))
    hits = each.join(clusters.distinct(), "identifier").groupBy("record_id").agg(
        F.min("cluster").alias("lo"), F.max("cluster").alias("hi")
    )
    return hits.where(F.col("lo") == F.col("hi")).select("record_id", F.col("lo").alias("cluster"))


def primary(df: DataFrame, cluster: str) -> DataFrame:
    """Main record of each cluster: no document, dated, longest span, then first."""
    order = [
        (F.col("provider") == "document").cast("int"),
        F.col("source_date").isNull().cast("int"),
        -F.length("span"),
        F.col("seq"),
    ]
    return earliest(df, [cluster], order)


def task_key(provider: Column, external_id: Column, corpus: Column, own_names: list[str] | None = None) -> Column:
    ids = F.array_sort(text.task_ids(corpus))
    names = F.array_sort(text.product_names(corpus, own_names))
    return (
        F.when(F.size(ids) > 0, F.concat(F.lit("id:"), F.array_join(ids, "|")))
        .when(F.size(names) > 0, F.concat(F.lit("entity:"), F.array_join(names, "|")))
        .otherwise(F.concat_ws(":", F.lit("source"), provider, external_id))
    )


def cluster_tasks(tasks: DataFrame) -> DataFrame:
    """Cluster of every task record (``workspace_id``, ``record_id``, ``provider``, ``title``, ``span``, ``source_date``).

    Identifier components first; attachments are decided against those components and
    added as links together with the reciprocal wording pairs, then components are taken
    once more, so a pair whose members attach to two components joins them.
    """
    corpus = F.concat_ws(" ", "title", "span")
    located = F.concat_ws("/", F.col("workspace_id").cast("string"), "record_id")
    scoped = tasks.withColumns(
        {
            "node": located,
            "ids": F.transform(text.task_ids(corpus), lambda i: F.concat_ws("/", F.col("workspace_id").cast("string"), i)),
            "entities": text.product_names(corpus),
        }
    )
    scoped = cut_lineage(scoped)
    parts = identifier_components(scoped, "node", "ids")
    known = scoped.join(parts, "node", "left")
    wording, entities, twins = match_records(known)
    idless = known.where(F.col("component").isNull()).select(F.col("node").alias("record_id"))
    attached = attach_idless(idless, wording, entities)
    links = (
        attached.select(F.col("record_id").alias("a"), F.col("component").alias("b"))
        .union(twins.select("a", "b"))
        .union(idless.select("record_id", "record_id"))
        .union(parts.select("component", "component"))
    )
    final = connected(links)
    start = known.withColumn("_start", F.coalesce("component", "node"))
    return start.join(final.select(F.col("node").alias("_start"), "label"), "_start").select(
        "workspace_id", "record_id", F.col("label").alias("cluster")
    )


def match_records(known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Wording and entity matches of id-less records, and reciprocal wording twins.

    ``known`` has ``node``, ``component`` (NULL without ids), ``entities`` and the task columns.
    """
    keyed = known.withColumn("home", F.coalesce("component", F.lit("")))
    features = folded(keyed, "node", ["home"], ("component", "entities"))
    sigs = cut_lineage(signatures(features, "node", ["home"]).withColumn("is_open", F.col("home") == ""))
    pairs = cut_lineage(
        wording_pairs(sigs, either="is_open").select(
            F.col("rep").alias("a"), F.col("rep2").alias("b"), F.col("l.n").alias("n_a"), F.col("r.n").alias("n_b"),
            F.col("l.home").alias("home_a"), F.col("r.home").alias("home_b"),
        )
    )
    twins = reciprocal_unique(pairs.where("home_a = '' AND home_b = ''").select("a", "b", "n_a", "n_b"))
    mixed = pairs.where("home_a = '' AND home_b <> ''").select("a", F.col("home_b").alias("component")).union(
        pairs.where("home_b = '' AND home_a <> ''").select("b", "home_a")
    )
    # A match holds for every record folded into the signature, so unfold before attaching.
    unfolded = members(features.where("home = ''"), sigs.where("home = ''"), "node", ["home"])
    wording = mixed.join(unfolded, F.col("a") == F.col("rep")).select(F.col("node").alias("record_id"), "component")

    dated = features.where(~F.col("undated"))
    each = dated.select("workspace_id", "node", "component", "anchors", F.explode("entities").alias("entity"))
    # Homes are kept per meeting code of their dates, so a product that a third of all records
    # name is looked up by date and never met as date set by date set; least and greatest
    # component are enough to tell one match from several.
    homes = (
        each.where("component IS NOT NULL")
        .withColumn("code", F.explode(dates.meeting_codes(F.col("anchors"), False)))
        .groupBy("workspace_id", "entity", "code")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    )
    open_nodes = each.where("component IS NULL").select("workspace_id", "entity", "node", "anchors")
    probes = open_nodes.select("workspace_id", "entity", "anchors").distinct()
    sought = probes.withColumn("code", F.explode(dates.meeting_codes(F.col("anchors"), True)))
    found = sought.join(homes, ["workspace_id", "entity", "code"]).groupBy("workspace_id", "entity", "anchors").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    entities = open_nodes.join(found, ["workspace_id", "entity", "anchors"]).groupBy(F.col("node").alias("record_id")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    both = entities.select("record_id", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("component"))
    return wording, both, twins
