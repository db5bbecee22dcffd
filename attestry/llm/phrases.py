"""Collocations by HAT-trie counting.

Each task counts phrases in a trie of word ids: neighbouring first words share a hybrid hash container
of phrases, and a container that outgrows ``BURST`` bursts into a node with one container for each
first word. A task that holds ``HELD`` phrases spills its largest subtrees whole, as runs sorted by phrase,
until half are left. The runs are tables in the shared folder; range partitions of the phrases, each a
stretch of neighbouring prefixes, merge them. A prefix that many phrases share gets several stretches.

Words come first, then pairs, then phrases of three and four words. A phrase can only occur ``least``
times if its parts do, so later levels pass over phrases whose words (pairs) are certainly rarer. They
are looked up in a bitmap of ``SLOTS`` bits, 8 MB whatever the corpus: two phrases that meet in one bit
cost time and never a result.

Nulls count as empty texts and as the language ``und``; every row counts, repeated rows and rows without
``doc_id`` too; texts without words and empty tables give no phrases. Other columns are not read. Bytes
that are not UTF-8 count as U+FFFD. Ties of the ranking are settled by phrase. A text and its words are
held in memory by one task; nothing else grows with a text, a language or the corpus.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.llm.common import Shelf, counted_broadcast, mixed

LEAST = 30
LONGEST = 4
SHARE = 80
TOP = 2000
SLOTS = 2**26
BURST = 4096
HELD = 1_000_000
VOCABULARY = 1_000_000
#: Lower case for A-Z, one line feed for every byte that ends a piece.
FOLD = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"."


def pieces_of(text: bytes) -> bytes:
    """A text with one ``END`` (never a word) after each of its pieces."""
    return text.translate(FOLD).replace(b"\n", b" . ") + b" ."


def utf8(text: bytes | None) -> bytes:
    text = text or b""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


class Words:
    """The word ids of a task, each of one language; ``END`` is 0."""

    def __init__(self):
        self.names, self.langs, self.hashes = [END], [b""], array("Q", [0])
        self.ids: dict[bytes, dict[bytes, int]] = {}

    def read(self, lang: bytes, texts: list[bytes]) -> np.ndarray:
        """Ids of all words of the texts, in order."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string())).flatten().dictionary_encode()
        # Splitting leaves an empty word before white space that leads a text.
        known = self.ids.setdefault(lang, {END: 0, b"": 0})
        distinct = words.dictionary.cast(pa.large_binary()).to_pylist()
        fresh = [w for w in distinct if w not in known]
        known.update(zip(fresh, range(len(self.names), len(self.names) + len(fresh))))
        self.names += fresh
        self.langs += [lang] * len(fresh)
        self.hashes.extend([word_hash(lang, w) for w in fresh])
        return np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang + b"\x00" + word)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


class HatTrie:
    """Phrases, written as four bytes for each word id, and their counts."""

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.root: dict[int, dict] = {}  # 64 neighbouring first words to their container
        self.deep: set[int] = set()  # those whose container has burst
        self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add phrases of one length (rows of ``ids``, sorted by their first word)."""
        if not len(ids):
            return
        keys, counts = _packed(ids), counts.tolist()
        slots = ids[:, 0] >> 6
        edges = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(ids)]
        for slot, start, stop in zip(slots[edges[:-1]].tolist(), edges, edges[1:]):
            box = self.root.setdefault(slot, {})
            if slot in self.deep:
                for key, n in zip(keys[start:stop], counts[start:stop]):
                    inner = box.setdefault(key[:4], {})
                    before = inner.get(key)
                    self.size += before is None
                    inner[key] = (before or 0) + n
                continue
            known = len(box)
            for key, n in zip(keys[start:stop], counts[start:stop]):
                box[key] = box.get(key, 0) + n
            self.size += len(box) - known
            if len(box) > self.burst:
                node: dict[bytes, dict] = {}
                for key, n in box.items():
                    node.setdefault(key[:4], {})[key] = n
                self.root[slot] = node
                self.deep.add(slot)

    def take(self, leave: int) -> tuple[list[bytes], list[int]]:
        """Cut off the largest subtrees until at most ``leave`` phrases are left; their phrases, unsorted, and counts."""
        sizes = {s: sum(map(len, box.values())) if s in self.deep else len(box) for s, box in self.root.items()}
        keys: list[bytes] = []
        counts: list[int] = []
        for slot in sorted(sizes, key=sizes.get, reverse=True):
            if self.size <= leave:
                break
            box = self.root.pop(slot)
            self.size -= sizes[slot]
            for inner in box.values() if slot in self.deep else [box]:
                keys += inner
                counts += inner.values()
            self.deep.discard(slot)
        return keys, counts


def _packed(ids: np.ndarray) -> list[bytes]:
    width = ids.shape[1]
    if not width:
        return [b""] * len(ids)
    return np.ascontiguousarray(ids.astype(">u4")).view(f"V{4 * width}").ravel().tolist()


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of up to four id columns, sorted, and how often each occurs."""
    code, tables = columns[0], []
    for column in columns[1:]:
        if tables:
            known, code = np.unique(code, return_inverse=True)
            tables.append(known)
        else:
            tables.append(None)
        code = code << 32 | column
    code, counts = np.unique(code, return_counts=True)
    out = []
    for table in reversed(tables):
        out.append(code & 0xFFFFFFFF)
        code = code >> 32
        code = code if table is None else table[code]
    out.append(code)
    return np.stack(out[::-1], axis=1), counts


def _alive(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    slot = hashes & np.uint64(SLOTS - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrases_of(a: np.ndarray, hashes: np.ndarray, size: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of ``size`` words in an id sequence and their counts, but for those that ``bits`` rule out."""
    inside = a > 0
    if size < 3:
        part, live = 1, inside & _alive(bits, hashes[a])
    else:
        part, live = 2, inside[:-1] & inside[1:]
        at = np.flatnonzero(live)
        live[at] = _alive(bits, pair_hash(hashes[a[at]], hashes[a[at + 1]]))
    n = max(0, len(a) - size + 1)
    whole = np.ones(n, bool)
    for j in range(size - part + 1):
        whole &= live[j : j + n]
    at = np.flatnonzero(whole)
    return _grouped([a[at + j] for j in range(size)])


def _count(sizes: tuple[int, ...], bits: np.ndarray | None, held: int, burst: int, vocabulary: int):
    def run(batches):
        words, trie = Words(), HatTrie(burst)
        singles = np.zeros(0, np.int64)  # words need no trie: counts by id

        def taken(leave: int) -> tuple[list[bytes], list[int]]:
            if sizes != (1,):
                return trie.take(leave)
            ids = np.flatnonzero(singles)
            return _packed(ids[:, None]), singles[ids].tolist()

        def spilled(leave: int):
            """Whole subtrees as rows sorted by language and phrase."""
            names, langs = pa.array(words.names, pa.binary()).cast(pa.string()), pa.array(words.langs, pa.binary()).cast(pa.string())
            keys, counts = taken(leave)
            n, size = np.array(counts, np.int64), np.fromiter(map(len, keys), np.int64, len(keys)) // 4
            parts = []
            for width in np.unique(size).tolist():
                mine = size == width
                some = keys if mine.all() else [k for k, m in zip(keys, mine.tolist()) if m]
                ids = np.frombuffer(b"".join(some), ">u4").reshape(-1, width).astype(np.int64)
                columns = [names.take(pa.array(ids[:, j])) for j in range(width)]
                phrase = columns[0] if width == 1 else pc.binary_join_element_wise(*columns, " ")
                parts.append(pa.table({"lang": langs.take(pa.array(ids[:, 0])), "phrase": phrase, "f": n[mine]}))
            if parts:
                run = pa.concat_tables(parts)
                for lang in sorted(pc.unique(run["lang"]).to_pylist()):
                    own = run.filter(pc.equal(run["lang"], lang)) if len(words.ids) > 1 else run
                    yield from own.take(pc.sort_indices(own["phrase"])).to_batches(max_chunksize=50_000)

        for batch in batches:
            by_lang: dict[bytes, list[bytes]] = {}
            for lang, text in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "text"))):
                by_lang.setdefault(utf8(lang), []).append(pieces_of(utf8(text)))
            read = [words.read(lang, texts) for lang, texts in by_lang.items()]
            hashes = np.array(words.hashes, np.uint64)
            for a in read:
                if sizes == (1,):
                    fresh = np.bincount(a, minlength=len(words.names))
                    fresh[: len(singles)] += singles
                    fresh[0] = 0
                    singles = fresh
                    continue
                for size in sizes:
                    trie.add(*phrases_of(a, hashes, size, bits))
            if len(words.names) > vocabulary:
                yield from spilled(0)
                words, trie, singles = Words(), HatTrie(burst), np.zeros(0, np.int64)
            elif trie.size > held:
                yield from spilled(held // 2)
        yield from spilled(0)

    return run


def merged(runs: DataFrame) -> DataFrame:
    """Counts of whole phrases from sorted runs; a stretch of prefixes is merged in one place."""
    return runs.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _slots(batches):
    for batch in batches:
        out = []
        for lang, phrase in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "phrase"))):
            hashes = [np.array([word_hash(lang, w)], np.uint64) for w in phrase.split(b" ")]
            out.append(hashes[0] if len(hashes) == 1 else pair_hash(*hashes))
        slot = (np.concatenate(out) & np.uint64(SLOTS - 1)).astype(np.int64) if out else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slot)], ["slot"])


def bitmap(often: DataFrame) -> np.ndarray:
    """The bits of the given words or pairs. The driver gets ``SLOTS`` bits at most."""
    slots = often.select("lang", "phrase").mapInArrow(_slots, "slot long")
    parts = slots.groupBy(F.shiftright("slot", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bits")
    )
    out = np.zeros(SLOTS // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def frequent(shelf: Shelf, docs: DataFrame, least: int = LEAST, held: int = HELD, burst: int = BURST, vocabulary: int = VOCABULARY):
    """``(lang, phrase, f)`` of all phrases of one to four words that occur ``least`` times, and ``(lang, n)``."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    found, bits, n = [], None, None
    for sizes in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        runs = shelf.keep(texts.mapInArrow(_count(sizes, bits, held, burst, vocabulary), "lang string, phrase string, f long"))
        if n is None:
            n = shelf.keep(runs.groupBy("lang").agg(F.sum("f").alias("n")))
        found.append(shelf.keep(merged(runs).where(F.col("f") >= least)))
        shelf.drop(runs)
        if sizes[-1] < LONGEST:
            bits = bitmap(found[-1])
    return found, n


def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, **bounds: int) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best ``top`` phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut that scores lowest, ``n`` all words
    of the language; ``score`` is ``2,000,000 * a / (l + r)``, rounded down. Phrases that occur within
    longer ones ``share`` percent of the time are left out. ``bounds`` set the memory of a task
    (``held``, ``burst``, ``vocabulary``).
    """
    shelf = Shelf(docs.sparkSession, "phrases")
    levels, n = frequent(shelf, docs, least, **bounds)
    parts = levels[0].unionByName(levels[1]).unionByName(levels[2])
    whole = levels[1].unionByName(levels[2]).withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    cut = whole.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _joined(words, F.lit(1), F.col("k")).alias("left"), _joined(words, F.col("k") + 1, F.size(words)).alias("right")
    )
    side = counted_broadcast(parts, 120)
    scored = shelf.keep(
        cut.join(side.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(side.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .withColumn("score", F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"))
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    size = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: _joined(words, i, k))))
    around = (
        levels[2].select("lang", "f", F.explode(spans).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    )
    alone = scored.join(counted_broadcast(shelf.keep(around), 120), ["lang", "phrase"], "left").where(
        F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True))
    )
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = alone.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(counted_broadcast(n, 40), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces
), starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded
), counted AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(words) GROUP BY ALL
), often AS (
  SELECT * FROM counted WHERE f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, p.k AS cut, p.f AS l, q.f AS r, (2000000::HUGEINT * c.f) // (p.f + q.f) AS score
  FROM often c JOIN often p ON p.lang = c.lang AND p.k < c.k AND array_to_string(string_split(c.phrase, ' ')[1 : p.k], ' ') = p.phrase
  JOIN often q ON q.lang = c.lang AND q.k = c.k - p.k AND array_to_string(string_split(c.phrase, ' ')[p.k + 1 :], ' ') = q.phrase
  WHERE c.k > 1
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), alone AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM often o WHERE o.lang = s.lang AND o.k > s.k AND 100 * o.f >= 80 * s.a AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM alone JOIN totals USING (lang) QUALIFY rank <= 2000
"""
