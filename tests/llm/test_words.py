"""Collocations and source divergence against brute force."""

import collections
import random
import re

import pytest

from attestry.llm import divergence, phrases

SCHEMA = "doc_id long, text string, lang string, source string, phrase string, f int, n int, rank string, word string, number int, value int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["The", "of", "river", "Ünder", "stone", "über", "a-b", "x1", "it's", "ÀB", "mill"]
    text = lambda n: "".join(rng.choice(words[: rng.randint(2, 11)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x1f"]) for _ in range(n))
    out = [(i, text(rng.randint(0, 60)), rng.choice(["en", "de", "en", None, ""]), rng.choice(["s0", "s0", "s1", "s2", "s3", "", None])) for i in range(120)]
    out += [out[0], out[0], (None, out[1][1], "en", "s0"), (None, None, None, None), (5, "", "en", "s9"), (6, "zz", "xx", "s0"), (7, None, "xx", "s1")]
    return out + [(8, text(20_000), "en", "s0"), (9, "the of the " * 200, "de", "s1")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, "r", "w", 3, 4) for r in rows], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def expected_phrases(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        found = {p: a for (x, p), a in f.items() if x == lang and a >= least and len(p) > 1}
        best = []
        for p, a in found.items():
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in found.items()):
                best.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"held": 40, "burst": 2, "vocabulary": 10**6}, {"held": 10**6, "burst": 3, "vocabulary": 5}])
def test_phrases_match_brute_force(docs, rows, bounds):
    got = phrases.collocations(docs.repartition(3), least=6, top=25, **bounds).collect()
    assert sorted(map(tuple, got)) == expected_phrases(rows, 6, 25)


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    sql = "cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"
    a, left, right = 8 * 10**17 + 7, 9 * 10**17 + 1, 9 * 10**17 + 3
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(sql + " AS x").collect()[0].x
    assert got == 2000000 * a // (left + right)


def test_trie_counts_and_spills_whole_subtrees():
    import numpy as np

    rng = random.Random(4)
    trie, seen, out = phrases.HatTrie(burst=4), collections.Counter(), collections.Counter()
    for _ in range(60):
        size = rng.randint(1, 4)
        some = collections.Counter(tuple(rng.randint(1, 6) * 40 for _ in range(size)) for _ in range(30))
        ids = np.array(sorted(some), np.int64)
        trie.add(ids, np.array([some[tuple(r)] for r in ids.tolist()]))
        seen.update(some)
        if trie.size > 150:
            heads = set(trie.root)
            for key, n in zip(*trie.take(75)):
                out[tuple(np.frombuffer(key, ">u4").tolist())] += n
            assert trie.size <= 75 and len(trie.root) < len(heads)
    for key, n in zip(*trie.take(0)):
        out[tuple(np.frombuffer(key, ">u4").tolist())] += n
    assert out == seen and trie.size == 0 and not trie.root


def expected_divergences(rows, least, top):
    n, docs, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        n.update((lang, source, x) for x in w)
        docs.update((lang, x) for x in set(w))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), d in docs.items() if x == lang and d >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def p(counts, kept=kept):
            total = sum(counts.values()) + len(kept)
            return {w: 1 + 10**9 * (counts[w] + 1) // total for w in kept}

        own = {s: {w: n[lang, s, w] for w in kept} for s in sources}
        whole = p({w: sum(own[s][w] for s in sources) for w in kept})
        ps = {s: p(own[s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(ps[s][w], ps[t][w]) for w in kept), t.encode()) for t in sources if t != s]
            terms = [(-f(ps[s][w], whole[w]), w.encode()) for w in kept if own[s][w] and ps[s][w] > whole[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"block": 2, "shards": 3, "held": 20}, {"block": 1, "shards": 1, "held": 1}])
def test_divergences_match_brute_force(docs, rows, bounds):
    got = divergence.divergences(docs.repartition(3), documents=2, top=5, **bounds).collect()
    assert sorted(map(tuple, got)) == expected_divergences(rows, 2, 5)


def test_per_billion_is_exact():
    import numpy as np

    pairs = [(1, 3), (9 * 10**15 - 1, 9 * 10**15), (123456789012345, 987654321098765), (7, 7)]
    n, total = (np.array(x, np.int64) for x in zip(*pairs))
    assert divergence._per_billion(n, total).tolist() == [10**9 * a // b for a, b in pairs]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(none).count() == 0 and divergence.divergences(none).count() == 0
