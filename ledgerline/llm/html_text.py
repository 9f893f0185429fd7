"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by path: an element node is known by its host and the chain of tag
names and classes above it. From all pages that show a node come

* its presentation: the entropy over the sequences of child tags that it shows;
* its content: one less the mean entropy, over those pages, of all words that stand in it directly; a node
  that only holds others has the content of these, each of which is judged by itself;
* its importance, by the number of its child sequences more of the one or of the other;
* its share of its parent's words, links not counted.

Low importance marks templates: words that many pages repeat. A node of many effective child sequences,
and not mostly links, is content; what lies in it goes only for repeating. Everywhere else the tree is
layout, whose children compete: a branch goes whose importance, weighed by its share, is low, which takes
menus, adverts and footers whose words change from page to page. Branches with a first heading stay.

Two rules stand beside the tree. Elements and classes that say that they are no article (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) go on every page, since
comments can outweigh an article. Where a host has fewer than COMPARED pages, nothing can be compared, and
of a page that marks its article only that is taken.

Marked nodes are looked up in a table that goes to all tasks while it has at most SENT rows, and beyond
that reaches each page by a join on its own paths.

Defined cases: a null or empty html has empty text; a null or odd url counts as the host '';
unclosed elements end where their parent ends; a page whose pruning would leave nothing keeps its
branches of low importance; repeated rows give equal rows; an empty table gives no rows; columns
besides page_id, url and html are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, trimmed

#: Importance below which a branch goes; fading of content by child sequences.
LOW, GAMMA = 0.3, 0.9
#: Pages from which on repeated words mark a node; and from which on its layout can be compared.
LEAST, COMPARED = 4, 8
#: Share of its parent's words from which a branch counts in full; effective child sequences that make a node content.
SHARE, VARIED = 0.5, 6.0
#: Words of a node that a page contributes (None: all of them); marked nodes that are sent to all tasks at most.
FEATURES, SENT = None, 500_000
#: What a node is marked as.
REPEATED, SLIGHT, CONTENT, SPARSE = 1, 2, 4, 8

# Element and class names of HTML practice.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE_TAGS = frozenset("nav footer aside form button select input textarea dialog menu svg canvas object video audio head fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar aside rail widget footer foot masthead topbar toolbar share sharing social newsletter subscribe signup login "
    "comment comments responses reply replies disqus discussion related recommended more-links pagination pager tags copyright disclaimer".split()
)
#: Those that name a title block where they stand within an article.
OUTER_WORDS = frozenset("header heading-bar logo site-header page-header site-title search login-bar".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES_P = frozenset(
    "address article aside blockquote body details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html main nav ol p pre section table ul li".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    """An open element: its path, what it is, and what it holds so far."""

    __slots__ = ("tag", "path", "out", "main", "linked", "tags", "heading")

    def __init__(self, tag: str, path: int, out: bool, main: bool, linked: bool):
        self.tag, self.path, self.out, self.main, self.linked = tag, path, out, main, linked
        self.tags: list[str] = []
        self.heading = tag == "h1"


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Paths(dict):
    """Hashes of paths by (hash of the path above, step), kept for those seen."""

    def __missing__(self, key: tuple[int | str, str]) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[key] = _hash(f"{key[0]}>{key[1]}")
        return value


class _Words(dict):
    """Hashes of words, kept for those seen."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = _hash(word)
        return value


_PATHS, _WORDS = _Paths(), _Words()


def _is_aside(tag: str, names: dict[str, str], in_main: bool) -> bool:
    if tag in ASIDE_TAGS or (tag == "header" and not in_main):
        return True
    if tag in ("html", "body", "main"):
        return False
    if names.get("role", "").lower() in ASIDE_ROLES:
        return True
    words = f"{names.get('class', '')} {names.get('id', '')}".lower()
    if words == " ":
        return False
    return any(w in ASIDE_WORDS or w.split("-")[0].split("_")[0] in ASIDE_WORDS or (not in_main and w in OUTER_WORDS) for w in words.split())


def parse(text: str, host: str = "") -> tuple[list[tuple], list[tuple]]:
    """The page's text runs in order, as (text, breaks before it, inside the article, paths of open
    elements, in an aside, in a link); and its nodes, as (path, path above, child tags, first run, end,
    whether a first heading is in it)."""
    runs: list[tuple[str, bool, bool, tuple, bool, bool]] = []
    nodes: list[tuple[int, int, str, int, int, bool]] = []
    root = _PATHS["", host]
    stack = [Node("", root, False, False, False)]
    at, size, gap = 0, len(text), True
    begun: list[int] = [0]
    above: tuple = ()

    def close(depth: int) -> None:
        nonlocal above
        while len(stack) > depth:
            node = stack.pop()
            start = begun.pop()
            stack[-1].heading = stack[-1].heading or node.heading
            if node.tag not in INLINE:
                nodes.append((node.path, stack[-1].path, " ".join(node.tags), start, len(runs), node.heading))
                above = above[:-1]

    def add(raw: str) -> None:
        nonlocal gap
        if raw:
            words = html_lib.unescape(raw) if "&" in raw else raw
            if words:
                top = stack[-1]
                runs.append((words, gap, top.main, above, top.out, top.linked))
                gap = False

    while at < size:
        found = _TOKEN.search(text, at)
        if found is None:
            break
        add(text[at : found.start()])
        at = found.end()
        shut, tag, rest = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if tag is None:
            if found[0].startswith("<![CDATA["):
                add(found[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag not in INLINE:
            gap = True
        if shut:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        if tag in RAW:
            ends = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
            at = ends.end() if ends else size
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag not in INLINE:
                    break
        if tag in SIBLINGS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SIBLINGS[tag]:
                    close(depth)
                    break
                if stack[depth].tag in ("ul", "ol", "dl", "table", "select", "div", "article", "body"):
                    break
        top = stack[-1]
        if tag not in INLINE:
            top.tags.append(tag)
        if rest.rstrip().endswith("/") and tag not in INLINE and tag in ("svg", "path"):
            continue
        names = {k.lower(): a or b or c for k, a, b, c in _NAMES.findall(rest)} if rest else {}
        main = top.main or tag in ("article", "main") or names.get("role", "").lower() == "main"
        path = top.path if tag in INLINE else _PATHS[top.path, f"{tag}.{names.get('class', '')}"]
        if tag not in INLINE:
            above = (*above, path)
        stack.append(Node(tag, path, top.out or _is_aside(tag, names, top.main), main, top.linked or tag == "a"))
        begun.append(len(runs))
    add(text[at:] if at < size else "")
    close(1)
    return runs, nodes


def join_runs(runs: list[tuple]) -> str:
    """Blocks in page order with one space between them, and for any white space within."""
    return " ".join("".join((" " if gap else "") + words for words, gap, *_ in runs).split())


def main_text(text: str | None, host: str = "", marks: dict[int, int] = {}) -> str:  # noqa: B006
    """What remains of a page without the branches that `marks` (by path) and the lists take."""
    if not text:
        return ""
    runs = [r for r in parse(text, host)[0] if not r[4]]
    if marks.get(_PATHS["", host], SPARSE) & SPARSE and any(r[2] for r in runs):
        return join_runs([r for r in runs if r[2]])
    if marks:
        judged: dict[tuple, bool] = {}
        kept = []
        for r in runs:
            if r[3] not in judged:
                judged[r[3]] = stays(r[3], marks)
            if judged[r[3]]:
                kept.append(r)
        runs = kept if join_runs(kept) else runs
    return join_runs(runs)


def stays(paths: tuple, marks: dict[int, int]) -> bool:
    """Whether text below these elements, outermost first, is kept."""
    if paths and marks.get(paths[-1], 0) & REPEATED:
        return False
    for p in paths:
        mark = marks.get(p, 0)
        if mark & CONTENT:
            return True
        if mark & SLIGHT:
            return False
    return True


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


KINDS = "path long, kind int, feature long, n long, x double"


def tallies(words: list[str], owners: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, ...]:
    """path, hash of word, n, sum of f log f over pages, in the order of paths and, of a path, of x and n: `words`
    stand in nodes of single pages by `owners`, whose places among the distinct paths are `paths`."""
    ids: defaultdict[str, int] = defaultdict()
    ids.default_factory = ids.__len__
    at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    hashes = np.fromiter((_WORDS[w] for w in ids), np.int64, len(ids))
    size = max(1, len(ids))
    keys, f = np.unique(owners * size + at, return_counts=True)
    keys, place = np.unique(paths[keys // size] * size + keys % size, return_inverse=True)
    n = np.bincount(place, f, len(keys)).astype(np.int64)
    x = np.bincount(place, f * np.log(f), len(keys))
    order = np.lexsort((n, x, keys // size))
    return (keys // size)[order], hashes[keys % size][order], n[order], x[order]


def style_nodes(pages: DataFrame) -> DataFrame:
    """What the pages show of each node, summed for some pages at a time, in four kinds of rows (KINDS), which have
    no columns besides, since rows of words are what the shuffle holds:
    0: n pages that have the node, x of them with a first heading in it, feature is the path above it;
    1: n times a child sequence of it; 2: n times a word of its text, with the sum of f log f over pages as x;
    3: n words in it, x of them in links."""
    names = [x.split()[0] for x in KINDS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            seen: dict[int, list[int]] = {}  # path: above, pages, with a heading, words, links
            styles: Counter[tuple[int, int]] = Counter()
            at: dict[int, int] = {}  # path: its place
            places: list[int] = []  # by nodes of single pages that hold words directly
            texts: list[str] = []
            owners: list[int] = []  # by runs, as their numbers of words
            sizes: list[int] = []
            for url, text in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                runs, nodes = parse(text or "", host)
                counts, linked = [0], [0]
                direct: dict[int, int] = {}
                for r in runs:
                    own_words = r[0].split()
                    counts.append(counts[-1] + len(own_words))
                    linked.append(linked[-1] + (len(own_words) if r[5] else 0))
                    if r[3] and own_words:
                        owner = direct.get(r[3][-1])
                        if owner is None:
                            owner = direct[r[3][-1]] = len(places)
                            places.append(at.setdefault(r[3][-1], len(at)))
                        texts += own_words
                        owners.append(owner)
                        sizes.append(len(own_words))
                own: dict[int, list] = {_PATHS["", host]: [0, 0, 0, 0]}
                for path, above, tags, start, stop, heading in nodes:
                    if counts[stop] == counts[start]:
                        continue
                    here = own.setdefault(path, [above, 0, 0, 0])
                    here[1] += counts[stop] - counts[start]
                    here[2] += linked[stop] - linked[start]
                    here[3] |= heading
                    styles[path, _PATHS["child tags", tags]] += 1
                for path, (above, n, links, heading) in own.items():
                    page = seen.setdefault(path, [above, 0, 0, 0, 0])
                    page[1] += 1
                    page[2] += heading
                    page[3] += n
                    page[4] += links
            rows = [(path, 0, v[0], v[1], v[2]) for path, v in seen.items()] + [(path, 3, 0, v[3], v[4]) for path, v in seen.items()]
            rows += [(path, 1, style, n, 0) for (path, style), n in styles.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)
            if texts:
                path, feature, n, x = tallies(texts, np.repeat(owners, sizes), np.asarray(places))
                cols = [np.fromiter(at, np.int64, len(at))[path], np.full(len(n), 2, np.int32), feature, n, x]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names)

    return pages.select("url", "html").mapInArrow(trimmed(run), KINDS)


def marked(nodes: DataFrame, low: float = LOW) -> DataFrame:
    """path, mark: of the nodes of the site style trees, those that say something about a page's text."""
    rows = nodes.groupBy("path", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    page, style, feature, inner = (F.col("kind") == k for k in range(4))
    n = F.col("n").cast("double")
    stats = rows.groupBy("path").agg(
        F.max(F.when(page, F.col("feature"))).alias("above"),
        F.sum(F.when(page, n)).alias("pages"),
        F.sum(F.when(inner, F.col("n"))).alias("words"),
        F.sum(F.when(inner, F.col("x"))).cast("long").alias("links"),
        F.max(F.when(page, F.least(F.col("x"), F.lit(1.0)))).cast("int").alias("heading"),
        F.coalesce(F.sum(F.when(style, n)), F.lit(0.0)).alias("shown"),
        F.coalesce(F.sum(F.when(style, n * F.log(n))), F.lit(0.0)).alias("shown_x"),
        F.count_if(style).alias("kinds"),
        F.avg(F.when(feature, F.log(n) - F.col("x") / n)).alias("spread"),
    )
    stats = stored(stats, "style-tree")
    entropy = F.when(F.col("shown") > 0, F.log("shown") - F.col("shown_x") / F.col("shown")).otherwise(F.lit(0.0))
    stats = stats.withColumn("entropy", entropy)
    presentation = F.when(F.col("shown") > 1, F.col("entropy") / F.log("shown")).otherwise(F.lit(1.0))
    content = F.when(F.col("pages") > 1, 1 - F.coalesce("spread", F.lit(0.0)) / F.log("pages")).otherwise(F.lit(1.0))
    fade = F.pow(F.lit(GAMMA), F.col("kinds"))
    stats = stats.withColumn("importance", (1 - fade) * presentation + fade * content)
    parents = stats.select(F.col("path").alias("above"), (F.col("words") - F.col("links")).alias("above_words"))
    stats = stats.join(parents, "above", "left")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("words") - F.col("links")) / F.greatest(F.coalesce("above_words", "words"), F.lit(1)) / SHARE))
    known = F.col("pages") >= COMPARED
    mark = (
        F.when((F.col("pages") >= LEAST) & (F.col("above") != 0) & F.col("spread").isNotNull() & (F.col("importance") < low), REPEATED).otherwise(0)
        + F.when(known & (F.col("heading") == 0) & F.col("above_words").isNotNull() & (F.col("above_words") > 0) & (F.col("importance") * share < low), SLIGHT).otherwise(0)
        + F.when(known & (F.exp("entropy") >= VARIED) & (2 * F.col("links") < F.col("words")), CONTENT).otherwise(0)
        + F.when(~known & (F.col("above") == 0), SPARSE).otherwise(F.when(F.col("above") == 0, 16).otherwise(0))
    )
    return stats.select("path", mark.cast("int").alias("mark")).where("mark > 0")


def page_paths(pages: DataFrame) -> DataFrame:
    """page, path: the paths above the text of every page that has some; `page` is a hash of url and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            found: list[tuple[int, int]] = []
            for page, url, text in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html")), strict=True):
                host = host_of(url)
                found += [(page, path) for path in {_PATHS["", host], *(p for r in parse(text or "", host)[0] for p in r[3])}]
            cols = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["page", "path"])

    return pages.select("page", "url", "html").mapInArrow(run, "page long, path long")


def extract(pages: DataFrame, low: float = LOW, sent: int = SENT) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    marks = stored(marked(style_nodes(pages), low), "marks")
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"
    few = marks.count() <= sent
    table = {r.path: r.mark for r in marks.collect()} if few else {}
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = []
            own = batch.column("own").to_pylist() if not few else None
            for k, (url, text) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                texts.append(main_text(text, host_of(url), shared.value if few else {m["path"]: m["mark"] for m in own[k] or ()}))
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    if few:
        return pages.mapInArrow(trimmed(run), schema)
    keyed = pages.withColumn("page", F.xxhash64("url", "html"))
    own = page_paths(keyed).join(marks, "path").groupBy("page").agg(F.collect_set(F.struct("path", "mark")).alias("own"))
    return keyed.join(own, "page", "left").select("page_id", "url", "html", "own").mapInArrow(trimmed(run), schema)
