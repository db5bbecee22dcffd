"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between two block-level tags, in page order. Each block has
features of its ancestors (tags, words of class and id) and of its text (length, link share,
punctuation, neighbours). The field scores a block as main text or not, and pairs of
neighbouring blocks; it is trained by gradient on labelled pages and decoded by Viterbi.

Labelled pages: a page that marks its article (``article``, ``main``, ``itemprop=articleBody``) labels
its own blocks; parts inside it that say they are navigation, comments, adverts, forms and the
like are not main text. Such pages are also set anew in other layouts with known
labels, and their telling tags are hidden in a part of the training, so pages without those tags are
read by their other features. At most ``max_pages`` labelled pages are used, the first by hash.

Scripts, styles, templates, form controls, frames, drawings and the head are markup, not blocks; a tag that
the page never ends is markup up to the end of the page. Training labels are read from the layouts made
here alone, never from a page that comes in. A page is read in time proportional to its length: what its
ancestors say of a block is counted as tags open and close, by the features the field knows. Character
references are decoded, white space inside a block becomes one space, blocks are joined by an
empty line. Null and empty pages give the empty text. Bytes that are not UTF-8 are read as U+FFFD; columns beyond page_id, url and html are not read. Pages without any labelled page to learn from
keep the blocks of an untrained prior: long blocks outside navigation tags. Repeated rows are
read one by one.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import small_batches

MAX_PAGES = 600
MAX_BLOCKS = 150  # of a training page
MAX_CHARS = 100_000  # of a training page

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>|[^<]++|<(?![a-zA-Z/])|</(?![a-zA-Z])",
    re.S,
)
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_NAME = re.compile(r"[a-z]+")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = set("script style template svg iframe textarea select head title".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var br wbr img input math object".split()
)
_CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_NOISE = re.compile(
    r"comment|reply|disqus|nav|menu|sidebar|aside|footer|header|masthead|banner|advert|sponsor|promo|related|share|social|cookie|consent|notice|newsletter|"
    r"subscribe|breadcrumb|pagination|widget|popup|modal|toolbar|copyright"
)
_AD = {"ad", "ads", "adv"}
_SAYS = {"nav", "aside", "footer", "form", "button"}
_NOISY_TAGS = {"tag:" + t for t in _SAYS}


@dataclass
class Block:
    text: str
    leaf: str
    found: frozenset[str]  # what the open tags say
    links: int
    inside: bool  # in a marked article
    noise: bool  # in a part that says it is something else
    told: int | None  # label given by a layout


@dataclass
class _Open:
    tag: str
    leaf: str = ""
    found: tuple[str, ...] = ()
    inside: bool = False
    noise: bool = False
    told: int | None = None


def _tag_features(tag: str, names: list[str], known: Container[str] | None) -> tuple[str, ...]:
    out = set()
    if tag not in _INLINE and tag not in ("html", "body") and (known is None or tag in _SAYS or f"tag:{tag}" in known):
        out.add("tag:" + tag)
    for name in names:
        if known is None or f"name:{name}" in known:
            out.add("name:" + name)
        out |= {"noise:" + hit for hit in _NOISE.findall(name)}
        if name in _AD:
            out.add("noise:ad")
    return tuple(out)


def blocks(page: str | None, known: Container[str] | None = None, layout: bool = False) -> list[Block]:
    """Leaf blocks of a page with text, in page order.

    ``known``: the features that are of use (all if None). ``layout``: the page was made here and carries labels.
    """
    out: list[Block] = []
    stack: list[_Open] = [_Open("")]
    tags: Counter[str] = Counter()
    found: Counter[str] = Counter()
    text: list[str] = []
    links = 0
    page = page or ""

    def flush() -> None:
        nonlocal links
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            top = stack[-1]
            out.append(Block(words, top.leaf, frozenset(found), links, top.inside, top.noise, top.told))
        text.clear()
        links = 0

    def push(item: _Open) -> None:
        stack.append(item)
        tags[item.tag] += 1
        found.update(item.found)

    def pop() -> str:
        item = stack.pop()
        tags[item.tag] -= 1
        for f in item.found:
            found[f] -= 1
            if not found[f]:
                del found[f]
        return item.tag

    at, quotes = 0, True
    while at < len(page):
        m = _TOKEN.match(page, at) if quotes else None
        if m is None and page[at] == "<":
            # a quote that is never closed: from here on a tag ends at the next ">"
            m = _SIMPLE.match(page, at)
            quotes = quotes and m is None
        m = m or _TOKEN.match(page, at)
        at = m.end()
        piece, tag = m.group(), m.group(2)
        if tag is None:
            if piece in ("<", "</") or not piece.startswith("<"):
                text.append(piece)
                if tags["a"]:
                    links += len(piece)
            elif piece.startswith("<![CDATA["):
                text.append(html.escape(piece[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in _INLINE:
                i = len(stack) - 1
                while tags[tag] and i and stack[i].tag in _INLINE and stack[i].tag != tag:
                    i -= 1
                if i and stack[i].tag == tag:
                    while pop() != tag:
                        pass
                continue
            flush()
            while tags[tag] and pop() != tag:
                pass
            continue
        if tag in _SKIP:
            if not m.group(3).rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>|<body\b" if tag in ("head", "title") else rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = len(page) if end is None else end.start() if end.group().lower().startswith("<body") else end.end()
            text.append(" ")
            continue
        if tag in ("br", "wbr", "img", "input"):
            text.append("" if tag == "wbr" else " ")
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if tag in _CLOSES_P and tags["p"]:
            i = len(stack) - 1
            while i and stack[i].tag in _INLINE:
                i -= 1
            if stack[i].tag == "p":
                while pop() != "p":
                    pass
        if tag in ("li", "td", "th", "tr", "dd", "dt", "option") and any(o.tag == tag for o in stack[-2:]):
            while pop() != tag:
                pass
        above = stack[-1]
        marks = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(m.group(3))} if m.group(3).strip() else {}
        names = _NAME.findall(" ".join(marks.get(k, "") for k in ("class", "id", "role")))
        marked = tag in ("article", "main") or marks.get("itemprop") == "articlebody" or marks.get("role") == "main"
        says = tag in _SAYS or bool(_NOISE.search(" ".join(names))) or bool(_AD & set(names))
        told = int(marks["data-told"]) if layout and "data-told" in marks else above.told
        leaf = above.leaf if tag in _INLINE else tag
        push(_Open(tag, leaf, _tag_features(tag, names, known), above.inside or marked, (above.noise or says) and not (marked and not above.inside), told))
    flush()
    return out


def _bucket(n: float, edges: tuple[float, ...]) -> int:
    return sum(n >= e for e in edges)


def features(page: list[Block], hide: frozenset[str] = frozenset()) -> list[set[str]]:
    """Feature names of each block; names in ``hide`` are left out."""
    own = []
    for i, b in enumerate(page):
        words = b.text.split()
        size = _bucket(len(words), (3, 6, 10, 20, 40, 80))
        link = _bucket(b.links / max(1, len(b.text)), (0.05, 0.3, 0.7))
        found = {f"words{size}", f"links{link}", f"words{size}links{link}", f"commas{_bucket(b.text.count(','), (1, 3, 6))}"}
        found.add("ends" if b.text[-1:] in ".!?…\"'”»" else "open")
        if re.search(r"©|\(c\)|copyright|all rights", b.text, re.I):
            found.add("copyright")
        if i < 2:
            found.add("first")
        if i >= len(page) - 2:
            found.add("last")
        found |= b.found - {kind + n for n in hide for kind in ("tag:", "name:")}
        if b.leaf:
            found |= {f"leaf:{b.leaf}", f"leaf:{b.leaf}:{size}"}
        if any(f.startswith("noise:") or f in _NOISY_TAGS for f in found):
            found.add("noisy")
        own.append(found)
    for i in range(len(own)):
        for step, side in ((-1, "before"), (1, "after")):
            if 0 <= i + step < len(own):
                own[i] |= {f"{side}:{f}" for f in own[i + step] if f.startswith(("words", "links", "leaf")) and f.count(":") < 2 and "links" not in f[1:]}
    return own


def _own_labels(page: list[Block]) -> list[int]:
    return [b.told if b.told is not None else int(b.inside and not b.noise) for b in page]


def layouts(main: list[str], rest: list[str], seed: int) -> str:
    """A page with known labels: the texts of another page set in one of several layouts."""
    rng = random.Random(seed)
    esc = [html.escape(t) for t in main]
    noise = [html.escape(t) for t in rest] or ["Menu"]
    line = lambda: rng.choice(noise)
    sentence = lambda: html.escape(" ".join(rng.choice(main).split()[: rng.randint(8, 40)]))
    menu = lambda: "<ul>" + "".join(f'<li><a href="/x">{html.escape(" ".join(line().split()[:3]))}</a></li>' for _ in range(rng.randint(3, 8))) + "</ul>"
    title, body = (esc[0], esc[1:]) if len(esc) > 1 else ("", esc)
    paragraphs = "".join(f"<li>{p}</li>" if rng.random() < 0.05 else f"<blockquote>{p}</blockquote>" if rng.random() < 0.05 else f"<p>{p}</p>" for p in body)
    heading = f"<h1>{title}</h1>" if title else ""
    before, after = [
        lambda: f'<nav data-told="0">{menu()}</nav>', lambda: f'<div class="{rng.choice(["menu", "navbar", "top-menu", "main-nav"])}" data-told="0">{menu()}</div>',
        lambda: f'<header data-told="0"><p>{line()}</p>{menu()}</header>', lambda: f'<div id="header" data-told="0"><h2>{line()}</h2></div>',
        lambda: f'<div class="{rng.choice(["cookie-notice", "notice", "consent-banner", "alert"])}" data-told="0"><p>{sentence()}</p></div>',
        lambda: f'<div class="{rng.choice(["ad", "advert", "sponsored", "banner-ad", "promo"])}" data-told="0">{sentence()}</div>',
    ], [
        lambda: f'<footer data-told="0">&copy; {line()}</footer>', lambda: f'<div class="{rng.choice(["footer", "site-footer", "copyright"])}" data-told="0"><p>&copy; {line()}</p></div>',
        lambda: f'<aside data-told="0"><h3>{line()}</h3><p>{sentence()}</p>{menu()}</aside>', lambda: f'<div class="{rng.choice(["sidebar", "related-posts", "widget"])}" data-told="0"><h4>{line()}</h4>{menu()}<p>{sentence()}</p></div>',
        lambda: f'<form class="{rng.choice(["newsletter", "search", "subscribe"])}" data-told="0"><p>{sentence()}</p><label>{line()}</label></form>',
        lambda: f'<div id="comments" class="comments" data-told="0">' + "".join(f'<div class="comment"><b>{line()}</b><p>{sentence()}</p></div>' for _ in range(rng.randint(1, 5))) + "</div>",
        lambda: '<ol class="comment-list" data-told="0">' + "".join(f"<li><p>{sentence()}</p></li>" for _ in range(rng.randint(1, 4))) + "</ol>",
    ]
    wrap = rng.choice([
        '<article data-told="1">%s</article>', '<main data-told="1">%s</main>', '<div id="content" data-told="1">%s</div>', '<div class="post-body entry-content" data-told="1">%s</div>',
        '<section class="story" data-told="1">%s</section>', '<div class="article-text" data-told="1">%s</div>', '<table><tr><td class="main" data-told="1">%s</td></tr></table>',
        '<div data-told="1">%s</div>', '<div class="page"><div class="col" data-told="1">%s</div></div>',
    ])
    inner = heading + paragraphs
    if rng.random() < 0.3:
        cut = inner.find("</p>") + 4
        if cut > 4:
            inner = inner[:cut] + rng.choice(before[4:] + after[2:5])() + inner[cut:]
    top = "".join(part() for part in rng.sample(before, rng.randint(1, 3)))
    end = "".join(part() for part in rng.sample(after, rng.randint(1, 4)))
    return f"<html><body>{top}{wrap % inner}{end}</body></html>"


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    step: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))


PRIOR = Model({"words0": -1.0, "words1": -0.5, "words4": 0.5, "words5": 1.0, "words6": 1.0, "noisy": -6.0, "links3": -3.0, "tag:header": -2.0, "copyright": -2.0, "leaf:p": 1.0, "leaf:h1": 2.0}, ((0.5, -0.5), (-0.5, 0.5)))


def train(pages: list[str], rounds: int = 200, seed: int = 3) -> Model:
    """Conditional likelihood of the labelled ``pages`` and their new layouts, by Adam with a small ridge."""
    rng = random.Random(seed)
    chains: list[tuple[list[set[str]], list[int]]] = []
    for i, page in enumerate(pages):
        parsed = blocks(page)
        labels = _own_labels(parsed)
        if not 1 <= sum(labels) < len(labels) or len(labels) > MAX_BLOCKS:
            continue
        hide = frozenset({"article", "main"} if rng.random() < 0.5 else ())
        chains.append((features(parsed, hide), labels))
        again = blocks(layouts([b.text for b, y in zip(parsed, labels) if y], [b.text for b, y in zip(parsed, labels) if not y], seed * 100_003 + i), layout=True)
        chains.append((features(again), _own_labels(again)))
    if not chains:
        return PRIOR
    names = sorted({f for found, _ in chains for one in found for f in one})
    number = {f: i for i, f in enumerate(names)}
    longest = max(len(y) for _, y in chains)
    y = np.zeros((len(chains), longest), np.int64)
    mask = np.zeros((len(chains), longest), bool)
    cell, feature = [], []
    for c, (found, labels) in enumerate(chains):
        y[c, : len(labels)] = labels
        mask[c, : len(labels)] = True
        for t, one in enumerate(found):
            cell += [c * longest + t] * len(one)
            feature += [number[f] for f in one]
    cell, feature = np.array(cell), np.array(feature)
    k = len(names)
    theta = np.zeros(k + 4)
    first, second = np.zeros(k + 4), np.zeros(k + 4)
    both = mask[:, :-1] & mask[:, 1:]
    seen = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for n in range(1, rounds + 1):
        unary = np.zeros((len(chains), longest, 2))
        unary[:, :, 1] = np.bincount(cell, theta[feature], y.size).reshape(y.shape)
        step = theta[k:].reshape(2, 2)
        ahead, behind = np.zeros_like(unary), np.zeros_like(unary)
        ahead[:, 0] = unary[:, 0]
        for t in range(1, longest):
            into = np.logaddexp(ahead[:, t - 1, 0, None] + step[0], ahead[:, t - 1, 1, None] + step[1]) + unary[:, t]
            ahead[:, t] = np.where(mask[:, t, None], into, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            out = unary[:, t + 1] + behind[:, t + 1]
            back = np.logaddexp(step[:, 0] + out[:, 0, None], step[:, 1] + out[:, 1, None])
            behind[:, t] = np.where(mask[:, t + 1, None], back, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p = np.exp(ahead + behind - total[:, None, None])[:, :, 1] * mask
        pair = ahead[:, :-1, :, None] + step + (unary + behind)[:, 1:, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(pair, 0)) * both[:, :, None, None]).sum(axis=(0, 1))
        grad = np.empty(k + 4)
        grad[:k] = np.bincount(feature, (p - y * mask).ravel()[cell], k)
        grad[k:] = (expected - seen).ravel()
        grad = grad / len(chains) + 1e-3 * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta -= 0.1 * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.99**n)) + 1e-9)
    s = theta[k:].reshape(2, 2).tolist()
    return Model({f: float(theta[i]) for f, i in number.items() if abs(theta[i]) > 1e-4}, ((s[0][0], s[0][1]), (s[1][0], s[1][1])))


def viterbi(scores: list[float], step) -> list[int]:
    """The best sequence of labels for the scores of label 1."""
    best, back = (0.0, scores[0]), []
    for x in scores[1:]:
        a = (best[0] + step[0][0], best[1] + step[1][0])
        b = (best[0] + step[0][1], best[1] + step[1][1])
        back.append((int(a[1] > a[0]), int(b[1] > b[0])))
        best = (max(a), max(b) + x)
    last = int(best[1] > best[0])
    path = [last]
    for choice in reversed(back):
        path.append(choice[path[-1]])
    return path[::-1]


def main_text(model: Model, page: str | None) -> str:
    parsed = blocks(page, model.weights)
    if not parsed:
        return ""
    weight = model.weights.get
    scores = [sum(weight(f, 0.0) for f in found) for found in features(parsed)]
    return "\n\n".join(b.text for b, y in zip(parsed, viterbi(scores, model.step)) if y)


def fit(pages: DataFrame, labelled: Column | None = None, max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS) -> Model:
    """A model of the pages that meet ``labelled`` (by default, those that mark their article).

    The first ``max_pages`` different pages by hash are read, of those up to ``max_chars`` characters. Only
    hashes are ranked; then those pages alone go to the driver, each once.
    """
    marks = F.col("html").rlike(r"(?i)<(article|main)\b|itemprop=.?articleBody") if labelled is None else labelled
    rows = pages.where(F.col("html").isNotNull() & marks).select(F.col("html").cast("string").alias("html"))
    rows = rows.where(F.length("html") <= max_chars).withColumn("h", F.xxhash64("html"))
    last = [r.h for r in rows.select("h").distinct().orderBy("h").limit(max_pages).collect()]
    if not last:
        return train([])
    sample = rows.where(F.col("h") <= last[-1]).groupBy("h").agg(F.min("html").alias("html")).collect()
    return train([r["html"] for r in sorted(sample, key=lambda r: r.h)])


def _extract(model: Model):
    def run(batches):
        for batch in batches:
            pages = batch.column("html").cast(pa.binary()).to_pylist()
            text = [main_text(model, None if p is None else p.decode("utf-8", "replace")) for p in pages]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return run


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    small_batches(pages.sparkSession)
    mine = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return mine.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
