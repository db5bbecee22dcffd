"""Operators on small hostile tables: nulls, empty and very long texts, ties, repeats, no rows, clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import decontaminate, extract, hamming, language, mixing, near_dup, secret_forest, sharding, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key long, tie string, h string, component string, size int"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "river", "stone"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base, passage = prose(rng, 120), prose(rng, 30)
    words = base.split()
    near = [" ".join(w if i != 10 * j + 5 else f"new{j}" for i, w in enumerate(words)) for j in range(6)]
    texts = [base, base, *near, passage + " x y", "start " + passage, prose(rng, 25) + " " + passage + " " + passage, "", None, " \n ", "one", "one two three", "one two three"]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(40)]
    texts.append(prose(rng, 30_000))
    out = [(i * 3, t, "en" if i % 2 else None, [None, "a", "b", "c"][i % 4]) for i, t in enumerate(texts)]
    out += [out[0], (None, base, "en", None), (None, None, None, None), (7, "same id, one text", "de", "a"), (7, "same id, other text", "de", "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 5, "x", "y", "z", 9) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def cut(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_substring_matches_brute_force(docs, rows):
    seen, expected = set(), {}
    for i, text in sorted({(i, t) for i, t, *_ in rows if i is not None and i != 7}):
        w = cut(text)
        covered = [False] * len(w)
        for p in range(len(w) - 19):
            window = tuple(w[p : p + 20])
            if window in seen:
                covered[p : p + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(x for x, c in zip(w, covered) if not c)
        expected[i] = (len(w), sum(covered), hashlib.sha256(kept.encode()).hexdigest())
    got = substring.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in expected:
            assert (r.n_words, r.n_removed, r.kept_sha256) == expected[r.doc_id], r.doc_id
    assert [r.n_removed for r in got if r.doc_id is None and r.n_words] == [120]  # rows without id come last


def test_doubling_ends_with_the_longest_repeat(spark):
    rng = random.Random(4)
    p = prose(rng, 100)
    docs = spark.createDataFrame([(1, p), (2, "before " + p), (3, None)], "doc_id long, text string")
    levels = substring.doubled(docs).groupBy("length").count().collect()
    assert {r["length"]: r["count"] for r in levels} == {20: 81, 40: 61, 80: 21}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(docs, rows, percent):
    sets = {}
    for i, text, *_ in rows:
        w = [x.lower() for x in cut(text)]
        if i is not None:
            sets.setdefault(i, set()).add(frozenset(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else frozenset())
    ids = sorted(sets)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = root(x), root(y)
                label[max(a, b)] = min(a, b)
    got = near_dup.near_duplicates(docs, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == root(r.doc_id) and r.kept == (root(r.doc_id) == r.doc_id)
    assert {r.component_id for r in got if r.doc_id is None} == {0, None}


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.unique(x[:350]), np.unique(x[50:])
    s = near_dup.super_minhash([a, b, a], 512)
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - 0.75) < 0.08
    assert (s < np.uint64(512 << 32)).all()


def test_decontamination_tolerates_substitutions(spark, docs):
    rng = random.Random(9)
    item = [f"w{rng.randint(0, 500)}" for _ in range(30)]
    changed = list(item)
    for i in (4, 13, 22):
        changed[i] = "other"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (None, " ".join(item))], "item_id long, text string")
    more = spark.createDataFrame([(1001, "Before, " + ", ".join(changed).upper() + ". After"), (1002, " ".join(item[:10])), (1003, " ".join(reversed(item)))], "doc_id long, text string")
    got = decontaminate.decontaminate(docs.select("doc_id", "text").union(more), bench).collect()
    bad = {r.doc_id: (r.n_items, r.item_ids) for r in got if r.contaminated}
    assert bad == {1001: (2, [1])}


def test_seeds_meet_every_overlap_of_the_rule():
    for width in range(1, 16):
        for percent in (60, 80, 90, 100):
            masks, gone = decontaminate.masks_for(width, percent), decontaminate.lost(width, percent)
            places = [sum(1 << (s + o) for o in m) for m in masks for s in range(width - m[-1])]
            for lost in itertools.combinations(range(width), gone):
                bits = sum(1 << i for i in lost)
                assert any(not p & bits for p in places), (width, percent, lost)


def test_decontamination_misses_no_pattern_and_no_short_item(spark):
    fresh = itertools.count()
    items = {n: [f"i{n}w{j}" for j in range(n)] for n in (1, 2, 4, 5, 8, 9, 10, 12, 14, 15, 40, 59)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    texts, expected = [], []

    def add(n, changed, bad):
        words = [f"x{next(fresh)}" if j in changed else w for j, w in enumerate(items[n])]
        texts.append((len(texts), " ".join(["pad", *words, "pad"])))
        expected.append([n] if bad else [])

    for n in items:
        few = min(n, 15) // 5
        add(n, set(), True)
        add(n, set(range(0, n, 3)), False)
        for first in range(n if 5 <= n < 15 else 0):
            add(n, {(first + 5 * j) % n for j in range(few)}, True)
    add(40, set(range(3, 40, 4)), True)
    add(59, set(range(3, 59, 4)), True)
    for lost in itertools.combinations(range(15), 3):
        add(15, set(lost), True)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(docs, bench).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_mixing_meets_targets(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    again = sorted((r.doc_id or -1, r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    assert again == sorted((r.doc_id or -1, r.taken) for r in got)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r.source_size][0] += r.taken
        by[r.source_size][1] = r.target
    assert abs(sum(v[1] for v in by.values()) - total) < 1e-3


def test_mixing_leaves_less_than_the_smallest_document_that_is_left(spark):
    rng = random.Random(2)
    data = []
    for source in ("a", "b", "c", None):
        sizes = [rng.randint(100, 700) for _ in range(150)] + [150_000, 20_000, 0]
        data += [(len(data) + j, source, n) for j, n in enumerate(sizes)]
    data += data[:3] + [(None, "a", 300), (None, "a", 300)]
    docs = spark.createDataFrame(data, "doc_id long, source string, row int").withColumn("text", F.when(F.col("row") > 0, F.repeat(F.lit("w "), F.col("row").cast("int"))))
    for seed in (5, 6):
        got = mixing.mix(docs, seed=seed).collect()
        assert len(got) == len(data)
        by = collections.defaultdict(list)
        for r in got:
            by[r.source_size, r.target].append(r)
        for (size, target), some in by.items():
            taken, whole = sum(r.taken for r in some), int(target // size)
            left = [r["size"] for r in some if r["size"] and r.times == whole]
            assert 0 <= target - taken < min(left, default=1) + 1e-6


def test_water_filling_clamps_and_shares(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 490)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, [3, 1, 1], 3).collect()}
    assert got == {"a": 30.0, "b": 735.0, None: 735.0}


def test_sharding_is_even_and_keeps_groups(docs, rows):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(rows)
    places = collections.defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    counts = [len(v) for v in places.values()]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in places.values())
    text = {i: t for i, t, *_ in rows if i not in (None, 7)}
    for r in got:
        if r.doc_id in text:
            raw = (text[r.doc_id] or "").encode()
            assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    assert len({r.shard for r in got if r.doc_id in (0, 3)}) == 1


def test_a_group_larger_than_a_shard_is_cut_into_few(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard(docs, 4).collect()
    assert sorted(collections.Counter(r.shard for r in got).values()) == [15] * 4
    assert len({r.shard for r in got if r.doc_id < 40}) == 3


def test_quotas_keep_room():
    grant = sharding.quotas({(0, 1): 5, (1, 0): 3, (2, 1): 4}, [0, 1, 0])
    assert grant[1, 0] <= 3 and grant[0, 1] >= 3
    assert grant[0, 1] + grant[2, 1] - grant[1, 0] <= 1


def test_toxicity_blames_the_sentence(spark, docs, none):
    rng = random.Random(3)
    data, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        sentences = [prose(rng, 8) for _ in range(5)]
        if bad:
            sentences[rng.randint(0, 4)] += " vile" + rng.choice(["x", "y", ""]) + " rotten!"
        data.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    train = spark.createDataFrame(data, "doc_id long, text string")
    model = toxicity.fit(train, spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int"))
    probe = spark.createDataFrame([(1, "fine words here. a vile rotten thing! fine"), (2, "fine words"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(probe, model).collect()}
    assert got[1].score >= 0.5 > max(got[i].score for i in (2, 3, 4)) and got[3].score == 0
    (place,) = got[1].offending
    assert "vile" in "fine words here. a vile rotten thing! fine"[place.start : place.start + place.length]
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int")).weights == {}


def test_language_by_output_codes(spark, docs, none):
    rng = random.Random(5)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrstü"}
    data = [(i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(30)), lang) for i, (lang, a) in enumerate(list(letters.items()) * 40)]
    train = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit(train, F.lit(True))
    assert model.languages == sorted(letters) and model.codes.shape == (4, 7)
    probe = spark.createDataFrame([(1, "badce ecdab"), (2, "qrstp püq"), (3, "12 !?"), (4, None), (5, "abfg bagf")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.predict(probe, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["aa", "dd", "und", "und"] and got[1].score > 0.5
    assert len(language.codewords(30)) == 30 and len({tuple(c) for c in language.codewords(30)}) == 30
    assert language.predict(docs, model).count() == docs.count()
    assert {r.lang_pred for r in language.predict(docs, language.fit(none, F.lit(True))).collect()} == {"und"}


def test_main_text_reads_unseen_layouts():
    rng = random.Random(6)
    text = lambda n: (prose(rng, n) + ".").capitalize()
    pages = [
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><div class=ad>{text(6)}</div>"
        f"<article><h1>{text(6)}</h1><p>{text(40)}<p>{text(30)}</article><footer>&copy; {text(5)}</footer></body></html>" for _ in range(40)
    ]
    model = extract.train(pages)
    page = f"<body><ul class='top-menu'><li><a href=a>A</a></ul><div id=content><h1>Head &amp; more</h1><p>{text(40)}</p><p>Two\n lines,<br>one block {text(12)}</p></div><div class=footer>&copy; me</div><script>var a='<p>no</p>'</script>"
    got = extract.main_text(model, page).split("\n\n")
    assert got[0] == "Head & more" and len(got) == 3 and got[2].startswith("Two lines, one block")
    assert extract.main_text(model, None) == extract.main_text(model, "") == ""
    assert extract.train([]) is extract.PRIOR
    extract.main_text(model, "<div " * 2000 + "<p>x" * 500)


def test_pages_are_read_whole_and_their_own_marks_are_not_trusted():
    page = '<p data-told="x">energy <math>E=m</math> and <object>o</object> 5 &lt; 6 < 7 <button>Go</button> x</p> <a title="a > b" href=\'q>\'>ln</a> <noscript>ns</noscript>'
    assert [b.text for b in extract.blocks(page)] == ["energy E=m and o 5 < 6 < 7", "Go", "x", "ln", "ns"]
    assert {b.told for b in extract.blocks('<div data-told="1">x</div>')} == {None}
    assert [b.told for b in extract.blocks('<div data-told="1">x</div>', layout=True)] == [1]


@pytest.mark.parametrize("make", [
    lambda n: "".join(f'<div class="c{i}"><p>text number {i} here' for i in range(n)), lambda n: '<a "' * n, lambda n: '<a b="' * n, lambda n: "<!" * n, lambda n: "<a" * n,
    lambda n: "<b>" * n + "<div>x</div></i></b>" * n, lambda n: "<p>" + "<b>" * n + "<div>x</div>" * n,
])
def test_hostile_pages_take_linear_time(make):
    import time

    def seconds(n):
        start = time.process_time()
        extract.main_text(extract.PRIOR, make(n))
        return time.process_time() - start

    assert seconds(8000) < max(0.5, 12 * seconds(2000)) and seconds(8000) < 10


def test_viterbi_is_the_best_path():
    rng = random.Random(8)
    for _ in range(30):
        x = [rng.uniform(-2, 2) for _ in range(6)]
        step = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        value = lambda y: sum(a * b for a, b in zip(x, y)) + sum(step[a][b] for a, b in zip(y, y[1:]))
        paths = [[m >> i & 1 for i in range(6)] for m in range(64)]
        assert abs(value(extract.viterbi(x, step)) - max(map(value, paths))) < 1e-9


def test_hamming_is_exact(spark):
    rng = random.Random(7)
    vectors = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(300)]
    data = [(i, v, "x") for i, v in enumerate(vectors + vectors[:1] * 40)] + [(400, None, "x"), (None, vectors[0], "x"), (500, [1.0], "x"), (3, vectors[3], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, code string")
    codes = {i: sum((x > 0) << j for j, x in enumerate(v)) for i, v, _ in data if i is not None and v and len(v) == 64}
    got = collections.defaultdict(list)
    for r in hamming.nearest(df, df.where("vec_id % 50 = 0"), 5).collect():
        got[r.vec_id].append((r.rank, r.distance, r.neighbour_id))
    assert set(got) == {i for i in codes if i % 50 == 0}
    for i, found in got.items():
        best = sorted(((codes[i] ^ c).bit_count(), j) for j, c in codes.items() if j != i)[:5]
        assert sorted(found) == [(n + 1, *b) for n, b in enumerate(best)]


def test_secret_forest_learns_from_findings(spark, docs):
    rng = random.Random(11)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    data = [(i, f'some words token = "{hexes()}" and more' if i % 2 else f"order number {rng.randint(10**16, 10**17)} was sent", "src/a.py") for i in range(80)]
    data += [(None, None, None), (900, "", "x")]
    texts = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = secret_forest.scan(texts).collect()
    assert len(got) == 80 and all(r.secret == (r.doc_id % 2 == 1) for r in got)
    assert secret_forest.scan(docs).count() == 0


def test_secret_candidates_of_any_length_and_alphabet(spark):
    found = {
        "login password=hunter2 now": ["hunter2"],
        "api_key: Ab3dE9": ["Ab3dE9"],
        "the token = 'pa.ss~w$rd@x', then": ["pa.ss~w$rd@x"],
        "Authorization: Bearer ab.cd~ef": ["ab.cd~ef"],
        "see https://me:s3cr.t@host/x": ["s3cr.t"],
        "no digits QwErTyUiOpAsDfGhJk here": ["QwErTyUiOpAsDfGhJk"],
        "secret=a\\Eb\\Qc password:x": ["a\\Eb\\Qc", "x"],
        "token=abcd1234efgh5678ijkl.mn": ["abcd1234efgh5678ijkl", "abcd1234efgh5678ijkl.mn"],
        "nothing to see": [],
    }
    docs = spark.createDataFrame([(i, t, "src") for i, t in enumerate(found)], "doc_id long, text string, source string")
    got = collections.defaultdict(list)
    for r in secret_forest.candidates(docs).collect():
        assert r.head + r.token + r.tail == r.word
        got[r.doc_id].append(r.token)
    assert [sorted(got[i]) for i in range(len(found))] == [sorted(v) for v in found.values()]
    hashes = {hashlib.sha256(v.encode()).hexdigest() for values in found.values() for v in values}
    assert {r.token_sha256 for r in secret_forest.scan(docs).collect()} == hashes


def test_empty_tables(spark, none):
    assert substring.remove_repeats(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert secret_forest.scan(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, items).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming.nearest(vectors, vectors).count() == 0
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>text</p>", None)] + [(2, "u", "", "y")] * 3, "page_id long, url string, html string, text string")
    assert extract.extract(pages, extract.fit(pages)).count() == 5 and extract.extract(pages.limit(0), extract.fit(pages.limit(0))).count() == 0
    assert [r.n_chars for r in extract.extract(pages, extract.fit(pages)).orderBy("page_id").collect()][-1] == 0
