"""Secret scanning with a random forest against false positives.

A candidate is a run of at least sixteen characters of a key's alphabet, or a value of any length
and alphabet that a rule of ``rules.SECRET_RULES`` finds (assigned, bearer, in a URL, of a vendor);
both are candidates where they differ. The forest sees its length, how often its characters change class, its mix of classes, how much of its
letter runs is in the corpus's own dictionary, the path of its document, and the words beside
it. It is trained on labelled findings and scores every candidate; low scores are false
positives. Everything is DataFrame functions and Spark's own forest.

The dictionary holds the letter runs of candidates that stand as whole words in at least
``min_docs`` documents, counted over all texts. The forest is fitted on at most ``max_labelled``
findings, the first by hash. Without findings of both labels nothing is ruled out: every score
is 1.

Null and empty texts have no candidates; a null path counts as empty. Candidates at several
places, and in repeated rows, are findings of their own.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import text
from attestry.llm.common import WORD, Shelf, keyed
from attestry.session import broadcast_if_small

MAX_LABELLED = 20_000
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
NAMED = r"(?i)(token|passw|secret|api.?key|credential|private|auth)"
FEATURES = [
    "length", "changes", "digits", "uppers", "lowers", "symbols", "hexadecimal", "known", "path_length", "path_test",
    "named_here", "named_before", "named_after", "assigned", "quoted", "words_before", "words_after",
]


def _values() -> list[tuple[str, int]]:
    """``(pattern, group)`` of each secret rule: the group is the value, which stands in the last word of the text searched."""
    out = []
    for _, pattern, put in rules.SECRET_RULES:
        flags, body = re.fullmatch(r"(\(\?i\))?(.*)", pattern, re.DOTALL).groups()
        flags, prefix = flags or "", 0
        if put.startswith("$1"):
            depth = [body[: i + 1].count("(") - body[: i + 1].count(")") for i in range(len(body))]
            prefix = depth.index(0) + 1
        rest = body.rindex("(", prefix) if "$2" in put else len(body)
        value = f"{flags}{body[:prefix]}({body[prefix:rest]}){body[rest:]}" + r"(?=[^\x20\x09-\x0D]*\z)"
        out.append((text.pattern(value), 2 if prefix else 1))
    return out


def _share(column: str, pattern: str) -> Column:
    return F.regexp_count(F.col(column), F.lit(pattern)) / F.length(column)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """``(doc_id, key, tie, path, at, token, head, tail, before, after)``: one row per candidate; ``at`` is its word's place."""
    with_path = docs.select(
        "doc_id", "text", F.coalesce(F.col(path).cast("string") if path in docs.columns else F.lit(None), F.lit("")).alias("path")
    )
    body = F.col("text").cast("string")
    none = F.array().cast("array<string>")
    ruled = reduce(lambda x, y: x | y, [body.rlike(text.pattern(pattern)) for _, pattern, _ in rules.SECRET_RULES])
    base = with_path.select(F.struct("path").alias("kept"), "doc_id", "text", F.coalesce(ruled, F.lit(False)).alias("ruled"))
    base = base.where(F.col("ruled") | body.rlike(CANDIDATE))
    words = base.select(
        F.col("doc_id").cast("long").alias("doc_id"), "kept.path", "ruled", F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1)).alias("words")
    )

    def tokens(word: Column, at: Column) -> Column:
        # A rule's name, sign and value are at most three words.
        near = F.concat_ws(" ", F.get("words", at - 2), F.get("words", at - 1), word)
        runs = F.when(word.rlike(CANDIDATE), F.regexp_extract_all(word, F.lit(f"({CANDIDATE})"), F.lit(1))).otherwise(none)
        values = F.when(F.col("ruled"), F.concat(*[F.regexp_extract_all(near, F.lit(v), F.lit(g)) for v, g in _values()])).otherwise(none)
        return F.concat(runs, F.array_except(values, runs))

    placed = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"), tokens(w, i).alias("tokens")))
    each = words.select("doc_id", "path", "words", F.explode(F.filter(placed, lambda s: F.size(s["tokens"]) > 0)).alias("f"))
    each = each.select(
        "doc_id", "path", F.col("f.at").alias("at"), F.col("f.word").alias("word"), F.col("f.tokens").alias("tokens"),
        F.coalesce(F.get("words", F.col("f.at") - 1), F.lit("")).alias("before"), F.coalesce(F.get("words", F.col("f.at") - 2), F.lit("")).alias("before2"),
        F.coalesce(F.get("words", F.col("f.at") + 1), F.lit("")).alias("after"),
    )
    each = each.select("*", F.posexplode("tokens").alias("nth", "token")).drop("tokens")
    place = F.position(F.col("token"), F.col("word"))
    head = F.substring(F.col("word"), F.lit(1), place - 1)
    tail = F.substring(F.col("word"), place + F.length("token"), F.length("word"))
    return each.withColumn("head", head).withColumn("tail", tail)


def dictionary(shelf: Shelf, docs: DataFrame, found: DataFrame, min_docs: int) -> DataFrame:
    """Letter runs (three letters or more) of candidates that are words of at least ``min_docs`` documents."""
    runs = found.select(F.explode(F.regexp_extract_all(F.lower("token"), F.lit(r"([a-z]{3,})"), F.lit(1))).alias("run")).distinct()
    runs = broadcast_if_small(shelf.keep(runs))
    words = keyed(docs).select("key", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("run"))
    return words.join(runs, "run").groupBy("run").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("run")


def described(shelf: Shelf, docs: DataFrame, path: str = "source", min_docs: int = 2) -> DataFrame:
    """Candidates with their features, numbered by ``row``."""
    found = shelf.keep(candidates(docs, path).withColumn("row", F.xxhash64("doc_id", "path", "at", "nth", "word")))
    known = shelf.keep(dictionary(shelf, docs, found, min_docs))
    runs = found.select("row", F.explode(F.regexp_extract_all(F.lower("token"), F.lit(r"([a-z]{3,})"), F.lit(1))).alias("run")).distinct()
    covered = shelf.keep(runs.join(broadcast_if_small(known), "run").groupBy("row").agg(F.sum(F.length("run")).alias("letters")))
    rows = found.join(broadcast_if_small(covered), "row", "left")
    yes = lambda c: c.cast("double")
    return rows.select(
        "doc_id", "row", "at", "token",
        F.length("token").cast("double").alias("length"),
        _share("token", r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])").alias("changes"),
        _share("token", "[0-9]").alias("digits"), _share("token", "[A-Z]").alias("uppers"), _share("token", "[a-z]").alias("lowers"),
        _share("token", "[^A-Za-z0-9]").alias("symbols"), _share("token", "[0-9a-fA-F]").alias("hexadecimal"),
        F.least(F.lit(1.0), F.coalesce(F.col("letters") / F.length("token"), F.lit(0.0))).alias("known"),
        F.length("path").cast("double").alias("path_length"), yes(F.col("path").rlike("(?i)(test|example|sample|doc)")).alias("path_test"),
        yes(F.col("head").rlike(NAMED)).alias("named_here"), yes(F.col("before").rlike(NAMED) | F.col("before2").rlike(NAMED)).alias("named_before"),
        yes(F.col("after").rlike(NAMED)).alias("named_after"), yes(F.col("head").rlike("[=:]") | F.col("before").rlike("[=:]$")).alias("assigned"),
        yes(F.col("head").rlike("[\"']$")).alias("quoted"), F.length("before").cast("double").alias("words_before"), F.length("after").cast("double").alias("words_after"),
    )


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source", max_labelled: int = MAX_LABELLED, seed: int = 7) -> DataFrame:
    """``(doc_id, at, length, token_sha256, score, secret)`` of every candidate.

    ``findings`` (row, label 0/1) are labelled candidates; ``row`` is the number that ``described``
    gives them. Without it the candidates of ``weak_findings`` are used.
    """
    shelf = Shelf(docs.sparkSession, "secrets")
    rows = shelf.keep(described(shelf, docs, path))
    labelled = weak_findings(rows) if findings is None else findings
    labels = labelled.where("label is not null").groupBy("row").agg(F.max("label").alias("label"))
    once = rows.dropDuplicates(["row"])
    train = once.join(labels, "row").select("row", *FEATURES, F.col("label").cast("double").alias("label")).orderBy("row").limit(max_labelled)
    train = shelf.keep(train.coalesce(1))
    kinds = {r["label"] for r in train.select("label").distinct().collect()}
    out = rows.select("doc_id", "at", F.length("token").alias("length"), F.sha2("token", 256).alias("token_sha256"), *[F.col(f).alias(f"x_{f}") for f in FEATURES])
    if kinds != {0.0, 1.0}:
        scored = out.withColumn("score", F.lit(1.0))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train)
        forest = RandomForestClassifier(numTrees=30, maxDepth=6, seed=seed, featuresCol="features", labelCol="label").fit(vectors)
        ready = VectorAssembler(inputCols=[f"x_{f}" for f in FEATURES], outputCol="features").transform(out)
        scored = forest.transform(ready).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return scored.select("doc_id", "at", "length", "token_sha256", "score", (F.col("score") >= 0.5).alias("secret"))


def weak_findings(rows: DataFrame) -> DataFrame:
    """Labels by known forms, where no reviewed findings exist: assignments to a telling name and vendor prefixes
    are secrets, plain numbers and runs made of dictionary words are not (assigned ones neither, if they hold no digit);
    the rest stays unlabelled."""
    known_form = F.col("token").rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-.+)$")
    named = (F.col("named_here") + F.col("named_before") > 0) & (F.col("assigned") > 0) & ((F.col("digits") > 0) | (F.col("known") <= 0.5))
    plain = F.col("token").rlike(r"^[0-9_/+-]+$") | (F.col("known") > 0.5) | (F.col("lowers") + F.col("symbols") > 0.9)
    return rows.select("row", F.when(known_form | named, 1).when(plain, 0).alias("label")).where("label is not null")
