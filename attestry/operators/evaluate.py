"""Grading of answers, routing and runs over tables of cases."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import scoring, text
from attestry.session import BROADCAST_LIMIT_BYTES, broadcast_if_small, size_in_bytes, written_table


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, scoring.round_half_up(a / b, 4))


def router_metrics(cases: DataFrame) -> DataFrame:
    """Routing accuracy overall and per category; ``cases``: category, expected, predicted."""
    hit = F.col("expected") == F.col("predicted")
    slow = F.col("predicted") == "thinking"
    out = cases.rollup("category").agg(
        F.grouping("category").alias("_all"),
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct"),
        F.count_if(slow).alias("predicted_thinking"), F.count_if(F.col("expected") == "thinking").alias("expected_thinking"),
        F.count_if(slow & (F.col("expected") == "fast")).alias("over_escalated"),
        F.count_if((F.col("predicted") == "fast") & (F.col("expected") == "thinking")).alias("under_escalated"),
    )
    name = F.when(F.col("_all") == 1, "all").otherwise(F.col("category"))
    return out.withColumn("category", name).withColumn("accuracy", _ratio(F.col("correct"), F.col("total"))).drop("_all")


def provider_gap(cases: DataFrame, available: list[str]) -> DataFrame:
    """Per provider that is not available: how many cases need it."""
    needed = cases.select("case_id", F.explode(F.array_distinct("required_providers")).alias("provider"))
    return needed.where(~F.col("provider").isin(available)).groupBy("provider").agg(F.count(F.lit(1)).alias("n_cases"))


def coverage(cases: DataFrame, minimum: int) -> DataFrame:
    """Cases per overlapping dimension, with whether the minimum is met."""
    dims = [
        F.when(F.col("category").isin(names), F.lit(dim)) for dim, names in rules.COVERAGE_DIMENSIONS.items()
    ] + [F.lit("total"), F.when((F.col("category") == "large-pdf") | F.array_contains("required_providers", "document"), "document_pdf")]
    each = cases.select(F.explode(F.array_compact(F.array(*dims))).alias("dimension"))
    return each.groupBy("dimension").agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") >= minimum)


def phrase_in(corpus: Column, phrases: Column) -> Column:
    """First phrase that occurs in a normalised corpus, or NULL."""
    hits = F.filter(phrases, lambda p: (text.grade_text(p) != "") & (F.instr(corpus, text.grade_text(p)) > 0))
    return F.get(hits, F.lit(0))


def fact_matched(corpus: Column, any_of: Column, all_of: Column) -> Column:
    """One complete phrase, and one alternative of every group; a fact must ask for something."""
    any_ok = (F.size(any_of) == 0) | phrase_in(corpus, any_of).isNotNull()
    groups_ok = F.forall(all_of, lambda g: phrase_in(corpus, g).isNotNull())
    return any_ok & groups_ok & ((F.size(any_of) > 0) | (F.size(all_of) > 0))


def _words(values: list[str]) -> Column:
    return text.literal_array(values)


def topical(phrase: Column) -> Column:
    words = F.split(phrase, " ")
    plain = _words(rules.NON_TOPICAL)
    return F.exists(words, lambda w: w.rlike(r"\p{L}") & (F.length(w) >= 3) & ~F.array_contains(plain, w))


def anchors(facts: Column) -> Column:
    """Topical phrases a case's facts name, normalised."""
    phrases = F.flatten(F.transform(facts, lambda f: F.concat(f["any_of"], F.flatten(f["all_of"]))))
    return F.filter(F.array_distinct(F.transform(phrases, lambda p: text.grade_text(p))), topical)


def _pieces(col: Column, regex: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), regex), lambda x: text.grade_text(x)), lambda x: x != "")


def _sources(citations: DataFrame) -> DataFrame:
    """Citations (``case_id``, ``citation_id``, ``provider``, ``title``, ``excerpt``) with provider and excerpt normalised."""
    return citations.select(
        "case_id", "citation_id", "title", "excerpt",
        text.grade_text(F.col("provider")).alias("n_provider"), text.grade_text(F.col("excerpt")).alias("n_excerpt"),
    )


def _sentences(excerpt: Column) -> Column:
    return _pieces(excerpt, r"[.!?;\n]+")


def _clauses(excerpt: Column) -> Column:
    return _pieces(excerpt, r"(?i)[.!?;,\n]+|(?<!\w)(?:and|but|however|whereas|while)(?!\w)")


def _read_claims(claims: DataFrame) -> DataFrame:
    """Claims (``case_id``, ``claim_no``, ``claim``, ``citation_ids``, ``providers``) with text and providers normalised."""
    return claims.select(
        "case_id", "claim_no", text.grade_text(F.col("claim")).alias("n_claim"),
        F.transform("providers", lambda p: text.grade_text(p)).alias("claim_providers"),
        F.array_distinct(F.filter("citation_ids", lambda i: i != "")).alias("ids"),
    )


def _resolved(each: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with a citation id beside the citation, whether it resolves and supports the row's claim."""
    supports = (
        (F.col("n_claim") != "")
        & F.contains("n_excerpt", "n_claim")
        & (F.col("n_provider") != "")
        & F.array_contains("claim_providers", F.col("n_provider"))
    )
    return each.join(sources, ["case_id", "citation_id"], "left").withColumns(
        {"resolves": F.col("n_excerpt").isNotNull(), "supports": F.coalesce(supports, F.lit(False))}
    )


def claim_citations(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """One row per claim and citation id with whether it resolves and supports the claim.

    ``claims``: case_id, claim_no, claim, citation_ids, providers.
    """
    each = _read_claims(claims).select("*", F.explode_outer("ids").alias("citation_id")).drop("ids")
    return _resolved(each, _sources(citations)).select("case_id", "claim_no", "n_claim", "citation_id", "resolves", "supports")


def claim_support(pairs: DataFrame) -> DataFrame:
    """Per case: pairs, supported pairs, claims, supported claims and unresolved ids."""
    per_claim = pairs.groupBy("case_id", "claim_no").agg(
        F.count("citation_id").alias("n_pairs"), F.count_if("supports").alias("n_supported"),
        F.count_if(F.col("citation_id").isNotNull() & ~F.col("resolves")).alias("n_invalid"),
    )
    return per_claim.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.sum("n_pairs").alias("n_pairs"), F.sum("n_supported").alias("n_supported_pairs"),
        F.count_if(F.col("n_supported") > 0).alias("n_supported_claims"), F.sum("n_invalid").alias("n_invalid"),
    ).withColumns(
        {"citation_precision": _ratio(F.col("n_supported_pairs"), F.col("n_pairs")),
         "citation_completeness": _ratio(F.col("n_supported_claims"), F.col("n_claims"))}
    )


def _wanted(facts: Column) -> Column:
    """Facts with normalised phrases, made once per case: phrases with whether they are topical, and groups."""
    plain = lambda xs: F.filter(F.transform(xs, lambda p: text.grade_text(p)), lambda p: p != "")
    return F.transform(
        facts,
        lambda f: F.struct(
            F.transform(plain(f["any_of"]), lambda p: F.struct(p.alias("phrase"), topical(p).alias("topical"))).alias("any_of"),
            F.transform(f["all_of"], plain).alias("all_of"),
        ),
    )


def _touching(claims: DataFrame) -> DataFrame:
    """Claims (``n_claim``, ``wanted``, ``anchors``) with ``touches``; NULL where only the supporting citations can tell."""
    here = lambda phrase: F.contains("n_claim", phrase)
    hit = lambda fact: F.get(F.filter(fact["any_of"], lambda p: here(p["phrase"])), F.lit(0))

    def by_groups(fact: Column) -> Column:
        said = F.size(F.filter(fact["all_of"], lambda g: F.exists(g, here)))
        return (F.size(fact["all_of"]) > 0) & (said >= F.least(F.lit(2), F.size(fact["all_of"])))

    bound = lambda h: h["topical"] | F.col("_bound")
    sure = F.exists("wanted", lambda f: F.when(hit(f).isNotNull(), bound(hit(f))).otherwise(by_groups(f)))
    open_ = F.exists("wanted", lambda f: hit(f).isNotNull()) & (F.size("anchors") > 0)
    touches = (
        F.when(F.coalesce(F.col("n_claim") == "", F.lit(True)), False).when(F.coalesce(sure, F.lit(False)), True)
        .when(~F.coalesce(open_, F.lit(False)), False)
    )
    marked = claims.withColumn("_bound", (F.size("anchors") == 0) | F.exists("anchors", here))
    return marked.withColumn("touches", touches).drop("_bound")


def assessed(
    cases: DataFrame, claims: DataFrame, citations: DataFrame, contradictions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Claims and contradictions beside the citations they name, as two written tables.

    Pairs: a claim and a citation id, with ``resolves``, ``supports``, ``n_provider``, ``touches`` (the claim carries
    the signal of a fact that its case requires) and ``whole_sentence``. Evidence: a contradiction and a citation
    id, with the citation's provider, title and clauses. Citations are normalised, shuffled and joined once for
    both, and split into sentences or clauses only where a later step reads those. ``cases`` has ``case_id`` and ``facts``.
    """
    wanted = cases.select("case_id", _wanted(F.col("facts")).alias("wanted"), anchors(F.col("facts")).alias("anchors"))
    read = _touching(_read_claims(claims).join(wanted, "case_id")).select(
        "case_id", "claim_no", "n_claim", "claim_providers", "touches",
        F.when(F.col("touches").isNull(), F.col("anchors")).alias("anchors"), F.posexplode_outer("ids").alias("place", "citation_id"),
    )
    ids = F.array_distinct("evidence_ids")
    named = contradictions.join(wanted.drop("wanted"), "case_id").select(
        "case_id", "conflict_no", F.size(ids).alias("n_ids"), "anchors",
        _pieces(F.col("summary"), r"(?i)(?<!\w)(?:but|however|whereas|while)(?!\w)|[;.!?]+").alias("said"),
        F.explode(ids).alias("citation_id"), F.lit(True).alias("in_conflict"),
    )
    both = _resolved(read.unionByName(named, allowMissingColumns=True), _sources(citations))
    asks = F.col("supports") & F.coalesce("touches", F.lit(True))
    both = both.withColumns(
        {"whole_sentence": F.when(asks, F.coalesce(F.array_contains(_sentences(F.col("excerpt")), F.col("n_claim")), F.lit(False))),
         "clauses": F.when(F.col("in_conflict") | (asks & F.col("touches").isNull()), _clauses(F.col("excerpt"))),
         "n_title": text.grade_text(F.col("title"))}
    )
    local = F.concat_ws(
        " ", F.when(F.col("whole_sentence"), F.col("n_title")),
        F.array_join(F.filter("clauses", lambda x: F.contains(x, F.col("n_claim"))), " "),
    )
    kept = both.select(
        "case_id", "claim_no", "n_claim", "touches", "anchors", "place", "citation_id", "resolves", "supports", "n_provider",
        "whole_sentence", F.when(F.col("touches").isNull() & F.col("supports"), local).alias("local"), "in_conflict", "conflict_no",
        "n_ids", "said", *[F.when(F.col("in_conflict"), F.col(c)).alias(c) for c in ("n_title", "clauses")],
    )
    table = written_table(kept)
    evidence = table.where("in_conflict").select(
        "case_id", "conflict_no", "n_ids", "anchors", "said", "citation_id", "n_provider", "n_title", "clauses"
    )
    pairs = table.where("in_conflict IS NULL")
    columns = ["case_id", "claim_no", "n_claim", "touches", "citation_id", "resolves", "supports", "n_provider", "whole_sentence"]
    open_ = pairs.where("touches IS NULL")
    if open_.isEmpty():
        return pairs.select(columns), evidence
    key = ["case_id", "claim_no", "n_claim"]
    context = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("supports"), F.struct("place", "local")))), lambda x: x["local"]), " "
    )
    told = open_.groupBy(*key).agg(context.alias("context"), F.first("anchors").alias("anchors"))
    corpus = F.concat_ws(" ", "n_claim", "context")
    told = written_table(told.select(*key, F.exists("anchors", lambda a: F.contains(corpus, a)).alias("touches")))
    settled = pairs.where("touches IS NOT NULL").select(columns)
    return settled.unionByName(open_.drop("touches").join(told, key).select(columns)), evidence


def supported_contradictions(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Contradictions (both sides of :func:`assessed`) and whether they hold.

    At least two ids, all resolved, two providers, every citation on topic, and the parts of
    the summary attributed to each provider name different things its citation says.
    """
    c = F.col
    has_anchor = lambda t: F.exists("anchors", lambda a: F.contains(t, a))
    # One column per step: a list that the next step reads twice is then made once.
    read = evidence.withColumns(
        {"titled": F.coalesce(has_anchor(c("n_title")), F.lit(False)), "on_topic": F.filter("clauses", has_anchor),
         "named": F.filter("said", lambda x: F.array_contains(F.split(x, " "), c("n_provider")))}
    ).drop("clauses", "said", "n_title")
    # A claim of the citation counts only beside a title on topic.
    topical_claims = (
        pairs.where("touches AND supports AND whole_sentence")
        .join(read.where("titled").select("case_id", "citation_id").distinct(), ["case_id", "citation_id"], "left_semi")
        .groupBy("case_id", "citation_id").agg(F.collect_set("n_claim").alias("own"))
    )
    joined = read.join(topical_claims, ["case_id", "citation_id"], "left").withColumn(
        "own", F.coalesce("own", F.array().cast("array<string>"))
    )
    stop, states, plain = _words(rules.CONFLICT_STOP), _words(rules.STATE_TOKENS), _words(rules.NON_TOPICAL)
    months = rf"\b\d{{1,2}} (?:{rules._MONTHS_LONG})\b"
    joined = joined.withColumns(
        {"words": F.array_distinct(F.flatten(F.transform("named", lambda x: F.split(x, " ")))),
         "days": F.flatten(F.transform("named", lambda x: F.regexp_extract_all(x, F.lit(months), F.lit(0)))),
         "anchor_words": F.flatten(F.transform("anchors", lambda a: F.split(a, " ")))}
    )
    meaningful = F.filter(
        "words",
        lambda w: (F.length(w) >= 3) & (w != c("n_provider")) & ~w.rlike(r"^\d+$") & ~F.array_contains(stop, w)
        & (F.array_contains(states, w) | (~F.array_contains(plain, w) & ~F.array_contains(c("anchor_words"), w))),
    )
    stated = F.filter(
        F.array_distinct(F.concat("days", meaningful)),
        lambda s: F.exists("on_topic", lambda x: F.contains(x, s)) | (c("titled") & F.exists("own", lambda x: F.contains(x, s))),
    )
    topic = (F.size("on_topic") > 0) | (c("titled") & (F.size("own") > 0))
    marked = joined.select(
        "case_id", "conflict_no", "n_ids", "n_provider", F.coalesce(topic, F.lit(False)).alias("topic"),
        F.array_join(F.array_sort(stated), "|").alias("sign"),
    )
    return marked.groupBy("case_id", "conflict_no").agg(
        F.max("n_ids").alias("n_ids"), F.count("n_provider").alias("n_resolved"),
        F.countDistinct("n_provider").alias("n_providers"), F.min(c("topic").cast("int")).alias("topic"),
        F.min(F.length("sign")).alias("least_sign"), F.countDistinct("sign").alias("n_signs"),
    ).select(
        "case_id", "conflict_no", "n_ids", "n_resolved", "n_providers",
        F.coalesce(
            (c("n_ids") >= 2) & (c("n_resolved") == c("n_ids")) & (c("n_providers") >= 2)
            & (c("topic") == 1) & (c("least_sign") > 0) & (c("n_signs") >= 2),
            F.lit(False),
        ).alias("holds"),
    )


def grade(cases: DataFrame, claims: DataFrame, citations: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Pass or fail of every case with the parts that decide it.

    ``cases``: case_id, answer, facts, required_providers, provider_coverage, needs_contradiction.
    """
    pairs, evidence = assessed(cases, claims, citations, contradictions)
    held = supported_contradictions(pairs, evidence).where("holds").select("case_id", "conflict_no")
    held_ids = written_table(
        evidence.join(held, ["case_id", "conflict_no"], "left_semi").select("case_id", "citation_id", "n_provider").distinct()
    )
    by_conflict = (
        pairs.where("NOT touches").select("case_id", "claim_no", "citation_id")
        .join(held_ids, ["case_id", "citation_id"], "left_semi")
        .select("case_id", "claim_no", F.lit(True).alias("touches"), F.lit(False).alias("supports"))
    )
    slim = pairs.select(
        "case_id", "claim_no", "touches", "supports", "resolves", F.col("citation_id").isNotNull().alias("cites"),
        F.when(F.col("supports"), F.col("n_provider")).alias("p"),
    )
    per_claim = slim.unionByName(by_conflict, allowMissingColumns=True).groupBy("case_id", "claim_no").agg(
        F.max("touches").alias("relevant"), F.count_if("cites").alias("n_pairs"), F.count_if("supports").alias("n_supported"),
        F.count_if(F.col("cites") & ~F.col("resolves")).alias("n_invalid"), F.collect_set("p").alias("providers"),
    )
    # One row per relevant supported provider of a claim; its counts stand on the first.
    each = per_claim.select(
        "case_id", "relevant", "n_pairs", "n_supported", "n_invalid",
        F.posexplode_outer(F.when(F.col("relevant"), F.col("providers"))).alias("place", "p"),
    ).withColumn("first", F.coalesce("place", F.lit(0)) == 0)
    conflicts = held_ids.select("case_id", F.col("n_provider").alias("p"), F.lit(True).alias("has_conflict"))
    first = lambda c: F.sum(F.when(F.col("first"), F.col(c)))
    per_case = each.unionByName(conflicts, allowMissingColumns=True).groupBy("case_id").agg(
        F.count_if("first").alias("n_claims"), first("n_pairs").alias("n_pairs"), first("n_supported").alias("n_supported_pairs"),
        F.count_if(F.col("first") & (F.col("n_supported") > 0)).alias("n_supported_claims"), first("n_invalid").alias("n_invalid"),
        F.count_if(F.col("first") & F.col("relevant")).alias("n_relevant"), F.max("has_conflict").alias("has_conflict"),
        F.collect_set(F.when(F.col("p") != "", F.col("p"))).alias("supported_providers"),
    )
    joined = cases.join(per_case, "case_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    corpus = text.grade_text(F.col("answer"))
    missing_facts = F.size(F.filter("facts", lambda f: ~fact_matched(corpus, f["any_of"], f["all_of"])))
    have = F.coalesce("supported_providers", F.array().cast("array<string>"))
    expected = F.array_distinct(F.transform("required_providers", lambda p: text.grade_text(p)))
    reported = F.array_distinct(F.transform("provider_coverage", lambda p: text.grade_text(p)))
    parts = joined.select(
        "case_id",
        ((F.size("facts") > 0) & (missing_facts == 0)).alias("fact_pass"),
        ((F.size(expected) > 0) & (F.size(F.array_except(expected, have)) == 0)).alias("provider_pass"),
        ((n("n_claims") > 0) & (n("n_invalid") == 0) & (n("n_supported_claims") == n("n_claims"))
         & (n("n_supported_pairs") == n("n_pairs"))).alias("citation_pass"),
        ((n("n_claims") > 0) & (F.size("facts") > 0) & (n("n_relevant") == n("n_claims"))).alias("relevance_pass"),
        (~F.col("needs_contradiction") | F.coalesce("has_conflict", F.lit(False))).alias("contradiction_pass"),
        F.array_join(F.array_sort(F.array_except(expected, have)), ",").alias("missing_providers"),
        F.array_join(F.array_sort(F.array_except(reported, have)), ",").alias("reported_unsupported"),
        F.array_join(F.array_sort(F.array_except(have, reported)), ",").alias("cited_unreported"),
    )
    flags = ["fact_pass", "provider_pass", "citation_pass", "relevance_pass", "contradiction_pass"]
    return parts.withColumn("pass", reduce(lambda a, b: a & b, [F.col(f) for f in flags]))


def quality_ratios(df: DataFrame, key: str, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratio of sums per run, NULL when there is nothing to divide by."""
    sums = sorted({c for pair in ratios.values() for c in pair})
    totals = df.groupBy(key).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    return totals.select(key, *[_ratio(F.col(f"_{a}"), F.col(f"_{b}")).alias(n) for n, (a, b) in ratios.items()])


def compare_modes(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """Two runs side by side, comparable only on equal ordered cases, target and release.

    Rows: run_key, case_no, case_id, target, release, passed, cost_units.
    """
    keep = ["case_id", "target", "release", "passed", "cost_units"]
    pack = lambda df, p: df.select("run_key", "case_no", *[F.col(c).alias(f"{p}_{c}") for c in keep])
    both = pack(fast, "f").join(pack(slow, "t"), ["run_key", "case_no"], "full_outer")
    differs = lambda c: ~F.equal_null(F.col(f"f_{c}"), F.col(f"t_{c}"))
    sums = both.groupBy("run_key").agg(
        F.count("f_case_id").alias("fast_cases"), F.count("t_case_id").alias("thinking_cases"),
        F.count_if(differs("case_id")).alias("case_mismatches"),
        F.count_if(differs("target") & F.col("f_case_id").isNotNull() & F.col("t_case_id").isNotNull()).alias("_t"),
        F.count_if((differs("release") | F.col("f_release").isNull()) & F.col("f_case_id").isNotNull()
                   & F.col("t_case_id").isNotNull()).alias("_r"),
        (F.count_if("t_passed") - F.count_if("f_passed")).alias("_passes"),
        (F.sum("t_cost_units") - F.sum("f_cost_units")).alias("_cost"),
    )
    measured = (F.col("fast_cases") > 0) & (F.col("thinking_cases") > 0)
    status = (
        F.when(~measured, "partial")
        .when((F.col("case_mismatches") + F.col("_t") + F.col("_r")) > 0, "incompatible")
        .otherwise("measured")
    )
    ok = F.col("status") == "measured"
    return sums.withColumn("status", status).select(
        "run_key", "fast_cases", "thinking_cases", "case_mismatches", "status",
        F.when(ok, F.col("_passes")).alias("delta_passes"), F.when(ok, F.col("_cost")).alias("delta_cost"),
    )


def canaries(rows: DataFrame, key: str) -> DataFrame:
    """Whether the first case of each document position passed; absent counts as not passed."""
    return rows.groupBy(key).agg(
        *[
            F.coalesce(
                F.min_by(F.when(F.col("kind") == kind, F.col("passed")), F.when(F.col("kind") == kind, F.col("seq"))),
                F.lit(False),
            ).alias(position)
            for position, kind in rules.CANARY_KINDS.items()
        ]
    )


def order_checks(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against observed best task of a case, with bounds and closed-work checks.

    ``candidates``: case_id, task_id, status, score.
    """
    best = F.max_by("task_id", F.struct(F.col("score"), -F.col("task_id")))
    seen = candidates.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), best.alias("observed_top"),
        (F.min((F.col("score") >= 0) & (F.col("score") <= 100))).alias("bounded"),
        F.min(~F.col("status").isin("completed", "cancelled") | (F.col("score") == 0)).alias("inert_closed"),
    )
    return seen.where("n_candidates >= 2").join(expected, "case_id").withColumn(
        "order_pass", F.col("observed_top") == F.col("expected_top")
    )


def fixture_problems(cases: DataFrame, categories: list[str], minimum: int) -> DataFrame:
    """Failing checks of a fixture: repeated ids, unknown categories, thin categories."""
    repeated = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("duplicate_id").alias("problem"), F.col("case_id").alias("subject"), "n"
    )
    sizes = cases.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    unknown = sizes.where(~F.col("category").isin(categories)).select(F.lit("unknown_category"), "category", "n")
    thin = sizes.where(F.col("category").isin(categories) & (F.col("n") < minimum)).select(F.lit("thin_category"), "category", "n")
    return repeated.union(unknown).union(thin)


def run_costs(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted cost units (fast 1, thinking 3) and calls per run."""
    units = F.when(F.col("mode") == "thinking", 3).otherwise(1)
    return calls.groupBy(*keys).agg(F.sum(units).alias("cost_units"), F.count(F.lit(1)).alias("calls"))


RUN = 3  # words of a run in the page index
WINDOW = 4  # of so many neighbouring runs the least hash is indexed (a power of two)
PARTS = 4  # large tables meet in so many parts, one after the other
COMMON = 64  # a fact is looked up by a run on more pages only if all its runs are


def _runs(df: DataFrame, key: str, words: Column) -> DataFrame:
    """(``key``, ``h``): hashes of the indexed runs of a word list, of each ``WINDOW`` neighbouring runs the least.

    Equal stretches of ``RUN + WINDOW - 1`` words share an indexed run, whatever stands around them.
    """
    ahead = lambda name, by: F.slice(name, by + 1, F.size(name))
    least = lambda x, y: F.least(x, y)
    # One column per step: a list that the next step reads twice is then made once.
    steps = df.select(key, words.alias("_w")).where(F.size("_w") >= RUN + WINDOW - 1)
    steps = steps.withColumn("_h", F.zip_with("_w", ahead("_w", 1), lambda a, b: F.xxhash64(a, b)))
    steps = steps.withColumn("_h", F.zip_with("_h", ahead("_w", 2), lambda h, c: F.xxhash64(h, c)))
    for step in (1, 2):  # least of two, then of four neighbours
        steps = steps.withColumn("_h", F.zip_with("_h", ahead("_h", step), least))
    picked = F.slice("_h", F.lit(1), F.size("_w") - (RUN + WINDOW - 2))
    return steps.select(key, F.explode(F.array_distinct(picked)).alias("h"))


def _inner(passage: Column) -> Column:
    """Words of a fact but the outer ones, which may be parts of a page's words."""
    words = F.split(passage, " ")
    return F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))


def _in_parts(tables: list[DataFrame], key: str, parts: int, step: Callable[..., DataFrame]) -> DataFrame:
    """``step`` over tables that meet on ``key``, one part of its values after the other, each part written: disk holds the shuffle of one."""
    one = lambda df, p: df.where(F.pmod(F.col(key), F.lit(parts)) == p) if parts > 1 else df
    return reduce(DataFrame.unionByName, [written_table(step(*[one(df, p) for df in tables])) for p in range(parts)])


def _standing(pairs: DataFrame, facts: DataFrame, folds: DataFrame, parts: int) -> DataFrame:
    """Those (``item``, ``fold``) whose passage stands on the page, as ``item`` with the ``n`` and ``place`` of the fold."""
    asked = _in_parts([pairs, facts.select("item", "passage")], "item", parts, lambda x, y: x.join(y, "item"))
    pages = folds.select("fold", "flat", "n", "place")
    return _in_parts(
        [asked, pages], "fold", parts, lambda x, y: x.join(y, "fold").where(F.contains("flat", F.col("passage"))).select("item", "n", "place")
    )


def _long_hits(facts: DataFrame, folds: DataFrame, parts: int) -> DataFrame:
    """Pages on which a fact stands; each fact is looked up by one run, a common one only for want of others."""
    wanted = _runs(facts, "item", _inner(F.col("passage")))
    index = _runs(folds, "fold", F.split("flat", " "))
    if size_in_bytes(facts) <= BROADCAST_LIMIT_BYTES // 16:  # few facts thin the index without a shuffle
        index = index.join(F.broadcast(wanted.select("h").distinct()), "h", "left_semi")
    index = written_table(index)
    common = _in_parts([index], "h", parts, lambda x: x.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > COMMON))
    weighed = wanted.join(broadcast_if_small(common), "h", "left")
    probes = written_table(weighed.groupBy("item").agg(F.min_by("h", F.struct(F.coalesce("df", F.lit(0)), "h")).alias("h")))
    pairs = _in_parts([probes, index], "h", parts, lambda x, y: x.join(y, "h").select("item", "fold"))
    return _standing(pairs, facts, folds, parts)


def _short_hits(facts: DataFrame, folds: DataFrame, parts: int) -> DataFrame:
    """The same for facts too short for the index: by their rarest inner word, or by the vocabulary without one."""
    wanted = facts.select("item", F.explode(F.array_distinct(_inner(F.col("passage")))).alias("word"))
    postings = folds.select("fold", F.explode(F.array_distinct(F.split("flat", " "))).alias("word"))
    needed = written_table(postings.join(broadcast_if_small(wanted.select("word").distinct()), "word", "left_semi"))
    frequency = needed.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = wanted.join(frequency, "word", "left").groupBy("item").agg(
        F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word")
    )
    pairs = rarest.join(needed, "word").select("item", "fold")
    words = F.split("passage", " ")
    tiny = facts.where(F.size(words) < 3).select("item", F.get(words, F.lit(0)).alias("head"))
    if not tiny.isEmpty():
        vocabulary = postings.select("word").distinct()
        # Written, its size is known: few words that hold a fact meet the postings where they lie.
        holds = written_table(vocabulary.join(broadcast_if_small(tiny), F.contains(vocabulary["word"], tiny["head"])).select("item", "word"))
        pairs = pairs.union(postings.join(broadcast_if_small(holds), "word").select("item", "fold")).distinct()
    pairs = written_table(pairs)
    return _standing(pairs, facts, folds, parts)


def grounding(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """On which pages each fact stands word for word, and whether that is as declared.

    ``facts``: item_id, passage, doc_id and page (NULL if none is declared). ``pages``: doc_id, page,
    text. White space is normalised on both sides; pages of equal text are looked at once.
    ``verdict``: ``missing`` (on no page), ``several``, ``elsewhere`` (on one page, but not the
    declared one), ``grounded`` (on one page, the declared one if any).
    """
    flat = pages.select("doc_id", "page", text.clean(F.col("text")).alias("flat"))
    folds = flat.groupBy("flat").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "page")).alias("place"))
    # Facts and pages go by numbers, fixed when the tables are written; texts are read where they are compared.
    folds = written_table(folds.withColumn("fold", F.monotonically_increasing_id()))
    asked = facts.select("item_id", text.clean(F.col("passage")).alias("passage"), "doc_id", "page")
    asked = written_table(asked.withColumn("item", F.monotonically_increasing_id()))
    long = F.size(F.split("passage", " ")) >= RUN + WINDOW + 1
    parts = PARTS if size_in_bytes(folds) + size_in_bytes(asked) > BROADCAST_LIMIT_BYTES else 1
    hits = _long_hits(asked.where(long), folds, parts)
    short = asked.where(~long)
    if not short.isEmpty():
        hits = hits.union(_short_hits(short, folds, parts))
    one = F.col("n_pages") == 1
    own = F.col("doc_id").isNull() | ((F.col("place.doc_id") == F.col("doc_id")) & (F.col("place.page") == F.col("page")))
    verdict = (
        F.when(F.col("n_pages").isNull(), "missing").when(~one, "several").when(own, "grounded").otherwise("elsewhere")
    )

    def judged(items: DataFrame, found: DataFrame) -> DataFrame:
        found = found.groupBy("item").agg(F.sum("n").alias("n_pages"), F.min("place").alias("place"))
        return items.join(found, "item", "left").select(
            "item_id", F.coalesce("n_pages", F.lit(0)).cast("bigint").alias("n_pages"), F.col("place.doc_id").alias("first_doc"),
            F.col("place.page").alias("first_page"), verdict.alias("verdict"),
        )

    return _in_parts([asked.select("item", "item_id", "doc_id", "page"), hits], "item", parts, judged)


def identifier_leaks(declared: DataFrame, pages: DataFrame) -> DataFrame:
    """Identifiers whose pages are not the declared ones: (``identifier``, ``n_undeclared``, ``n_absent``).

    ``declared``: identifier, doc_id, page. An identifier counts wherever its text stands, inside longer words too.
    """
    names = declared.select("identifier").distinct()
    words = pages.select("doc_id", "page", F.explode(F.array_distinct(F.split(text.clean(F.col("text")), " "))).alias("word"))
    # Identifiers are few and without blanks, so each is within one word; the distinct words are searched, not the pages.
    holding = words.select("word").distinct().join(broadcast_if_small(names), F.contains("word", "identifier"))
    seen = words.join(broadcast_if_small(holding), "word").select("identifier", "doc_id", "page").distinct()
    both = seen.withColumn("seen", F.lit(1)).join(
        declared.distinct().withColumn("told", F.lit(1)), ["identifier", "doc_id", "page"], "full_outer"
    )
    out = both.groupBy("identifier").agg(
        F.count_if(F.col("told").isNull()).alias("n_undeclared"), F.count_if(F.col("seen").isNull()).alias("n_absent")
    )
    return out.where("n_undeclared + n_absent > 0")


def closure_problems(shown: DataFrame, cited: DataFrame, referenced: DataFrame) -> DataFrame:
    """Questions whose shown, cited and referenced evidence differ, with what differs."""
    tag = lambda df, name: df.select("question_id", "evidence_id", F.lit(name).alias("side"))
    union = tag(shown, "shown").union(tag(cited, "cited")).union(tag(referenced, "referenced"))
    has = lambda s: F.max((F.col("side") == s).cast("int"))
    sides = union.groupBy("question_id", "evidence_id").agg(
        has("shown").alias("s"), has("cited").alias("c"), has("referenced").alias("r")
    )
    out = sides.groupBy("question_id").agg(
        F.count_if((F.col("s") == 1) & (F.col("r") == 0)).alias("shown_unreferenced"),
        F.count_if((F.col("s") == 0) & (F.col("r") == 1)).alias("referenced_not_shown"),
        F.count_if(F.col("c") != F.col("r")).alias("citation_gaps"),
    )
    return out.where(F.col("shown_unreferenced") + F.col("referenced_not_shown") + F.col("citation_gaps") > 0)
