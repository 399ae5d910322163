"""Main text extraction with a site style tree.

The DOMs of all pages of a host are merged into one tree whose nodes are element
paths (tag, class, id).  A node has its presentations (sequences of child elements)
and contents (text blocks), each with the number of pages that show it.  A node whose
presentation never varies and whose contents recur on many pages tells a reader
nothing: its importance, from the entropies of both and of what lies below, is near
0, and its text is removed from each page.  A branch goes where all of its nodes do;
every other block stays.  What an element says of itself is a prior on the importance
of it and all below it, up to the next that says something: an article gains, links to
other pages and the like lose.  What says that it is a menu, header, footer, sidebar,
notice, form, advert or comment goes whatever its importance: the site may only
remove more.  An article within these stays, but not within adverts and comments.
Where a site shows a node too seldom to judge it, the prior is all there is.

Importance of a node on m of the host's pages, with base-m logarithms: contents give
one less the mean entropy of a block over the pages that show it; presentation gives
the entropy of the child sequences, over all that its pages show, 1 at most; a node with children takes
``(1 - DECAY) * presentation + DECAY * mean of children (and contents)``.

Equal pages of a host are one page.  Statistics per host are sums that combine before the shuffle; a host's pages never
meet in one task, only the nodes of its merged tree do that enough pages show.

Edge cases: a null or empty html has no text; pages without a host make one site;
broken markup is read as far as it goes; a node exactly as important as the bound
stays; repeated rows are all answered; an empty
table gives an empty result; a page of any length is read whole; extra columns are
never touched.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .base import any_key, cut, lower_ascii, read, ship, slices

#: A node of which fewer pages are known than this is not judged by its site.
LEAST_PAGES = 8
#: Text of nodes below this importance is removed.
LEAST_IMPORTANCE = 0.3
DECAY = 0.9
#: Hints of an element and what they make of an importance: a factor and a summand.
PLAIN, CONTENT, NOISY, SHUT, REMARKS = range(5)
PRIOR = {PLAIN: (1.0, 0.0), CONTENT: (1.0, 0.2), NOISY: (0.32, 0.0), SHUT: (0.0, 0.0), REMARKS: (0.0, 0.0)}
#: Importance of a node that no site has judged: that of a text of its own without structure.
UNJUDGED = DECAY
#: Nodes judged against their hint that are sent to every executor at most; more are joined by host.
BROADCAST_NODES = 200_000
#: Parts into which a host's pages are dealt for that join.
SALTS = 32

_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: What follows a tag's name, where quotes may hold the character that ends it.
_REST = re.compile(r"((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
#: Tags of a page whose quotes may be found not to close; after that its tags end at the next ``>``.
_MOST_OPEN_QUOTES = 16
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe svg math xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: What is not rendered as text.
UNSEEN = frozenset("script style noscript template iframe svg math head title object embed canvas audio video".split())
SHUT_TAGS = frozenset("nav footer aside menu form button select textarea dialog".split())
#: Words of classes and ids.
REMARK_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored comment comments disqus respond replies".split())
SHUT_NAMES = frozenset("banner menu nav navbar navigation sidebar footer masthead cookie cookies consent notice notices popup modal newsletter subscribe subscription login signup search".split())
NOISE_NAMES = frozenset("promo share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar copyright".split())
#: A name with such a word tells a state or a layout, not what the element is.
STATES = frozenset("no has with without is hide hidden show free open closed enabled disabled active only".split())
LAYOUTS = frozenset("wrap wrapper container layout outer inner page grid row column columns".split())
CONTENT_NAMES = frozenset("article content entry post story maincontent articlebody".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: What an opening tag closes if it is open: each of these ends the nearest of the second within the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def _hash(*parts: object) -> int:
    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _names(found: dict[str, str]) -> tuple[set[str], set[str]]:
    """The class and id names of an element that are one word, and the words of those that are several and tell what it is."""
    single, several = set(), set()
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = _NAME.findall(token)
        if len(words) < 2:
            single.update(words)
        elif STATES.isdisjoint(words) and (LAYOUTS.isdisjoint(words) or CONTENT_NAMES.isdisjoint(words)):
            several.update(words)
    return single, several


def _hint(name: str, found: dict[str, str], over: int) -> int:
    """What an element says of itself within one of the hint ``over``; PLAIN if nothing, or if it contradicts itself."""
    if name in ("html", "body"):
        return PLAIN
    single, several = _names(found)
    words, role = single | several, found.get("role")
    sure = name in ("article", "main") or role == "main"
    content = not CONTENT_NAMES.isdisjoint(single)
    header = name == "header" or "header" in single or {"site", "header"} <= several
    # A header within content may hold its title.
    header = header and over != CONTENT
    if words & REMARK_NAMES:
        return PLAIN if content else REMARKS
    hint = SHUT if name in SHUT_TAGS or role in NOISE_ROLES or words & SHUT_NAMES or header else NOISY if words & NOISE_NAMES else PLAIN
    if sure or content:
        # In what goes, a class alone does not make content, and in adverts and comments nothing does.
        able = over not in (SHUT, NOISY, REMARKS) or sure and over != REMARKS
        return CONTENT if able and hint == PLAIN else PLAIN
    return hint


def judged(importance: float, hint: int, least: float = LEAST_IMPORTANCE) -> bool:
    """Whether a node of this importance and hint is removed."""
    factor, more = PRIOR[hint]
    return factor * importance + more < least


class Page:
    """One page: its element nodes and text blocks.  ``turned``: paths that their site judges otherwise than their hint alone; ``whole``: remove nothing."""

    def __init__(self, html: str, turned: frozenset[int] = frozenset(), memo: dict | None = None, whole: bool = False):
        self.whole = whole
        self.memo = {} if memo is None else memo
        self.turned = turned
        #: Per node: parent, tag, path, hint (an ancestor's if it has none), whether it is never seen, whether its text is removed, and the node that its text belongs to.
        self.parent, self.tag, self.path, self.hint, self.unseen, self.gone, self.owner = [-1], ["#root"], [0], [PLAIN], [False], [False], [0]
        self.children: dict[int, list[str]] = {}
        self.blocks: list[tuple[int, str]] = []
        self._stack, self._open = [0], {}
        self._parts: list[str] = []
        self._all: list[str] = []
        self._node = 0
        self._read(html)

    def _read(self, html: str) -> None:
        """Tags and texts in one pass; a step back for an unclosed quote is taken a fixed number of times, so time grows with the page's length."""
        at = begin = 0
        last, tries = html.rfind(">"), _MOST_OPEN_QUOTES
        while (start := html.find("<", at)) >= 0:
            close = name = None
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                end = len(html) if end < 0 else end + 3
            elif html.startswith(("<!", "<?"), start):
                end = html.find(">", start) + 1 or len(html)
            elif start < last and (m := _TAG.match(html, start + 1)) is not None and (stop := html.find(">", m.end())) >= 0:
                close, name = m[1], m[2].lower()
                rest = _REST.match(html, m.end()) if tries else None
                tries -= bool(tries) and rest is None
                attributes, end = (rest[1], rest.end()) if rest else (html[m.end() : stop], stop + 1)
            else:
                at = start + 1
                continue
            if start > begin:
                self._text(html[begin:start])
            at = begin = end
            if close:
                self._end(name)
            elif name:
                self._start(name, attributes)
                if name in RAW and not attributes.rstrip().endswith("/"):
                    found = re.compile(f"</{name}", re.I).search(html, at)
                    at = begin = (html.find(">", found.end()) + 1 or len(html)) if found else len(html)
                    self._end(name)
        if begin < len(html):
            self._text(html[begin:])
        self._flush()

    def _text(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        node = self._stack[-1]
        if self.unseen[node]:
            return
        if not self._all:
            self._node = self.owner[node]
        self._all.append(text)
        if self.whole or not self.gone[node]:
            self._parts.append(text)

    def _flush(self) -> None:
        if self._all:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._node, text))
            self._parts, self._all = [], []

    def _pop(self) -> None:
        name = self.tag[self._stack.pop()]
        self._open[name] -= 1
        if name in BLOCK:
            self._flush()

    def _close(self, names: set[str], scope: set[str]) -> None:
        if any(self._open.get(n) for n in names):
            for i in range(len(self._stack) - 1, 0, -1):
                name = self.tag[self._stack[i]]
                if name in names:
                    while len(self._stack) > i:
                        self._pop()
                    return
                if name in scope:
                    return

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._flush()
            self._close({"p"}, {"td", "th", "table", "button", "li", "article", "section", "div"})
        if name in CLOSES:
            self._close(*CLOSES[name])
        if name in VOID:
            if name in ("br", "hr"):
                self._text(" ")
            return
        over = self._stack[-1]
        key = (self.path[over], name, attributes)
        known = self.memo.get(key)
        if known is None:
            found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
            names = frozenset(_NAME.findall(f"{found.get('class', '')} {found.get('id', '')}"))
            style = found.get("style", "").replace(" ", "")
            unseen = name in UNSEEN or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
            own = _hint(name, found, self.hint[over])
            # Nothing that a branch says of itself brings it back from adverts and comments.
            hint = REMARKS if self.hint[over] == REMARKS else own or self.hint[over]
            path = _hash(self.path[over], name, hint, *sorted(names))
            known = self.memo[key] = (path, hint, unseen, judged(UNJUDGED, hint), name in BLOCK or own != PLAIN)
        path, hint, unseen, gone, owns = known
        gone = gone != (path in self.turned)
        # Unnamed inline text goes with the block that it is part of.
        owner = len(self.tag) if owns else self.owner[over]
        unseen = self.unseen[over] or (unseen and name not in ("html", "body"))
        self.children.setdefault(over, []).append(name)
        self.parent.append(over)
        self.tag.append(name)
        self.path.append(path)
        self.hint.append(hint)
        self.unseen.append(unseen)
        self.owner.append(owner)
        self.gone.append(unseen or (self.gone[over] if not owns else gone and name not in ("html", "body")))
        self._stack.append(len(self.tag) - 1)
        self._open[name] = self._open.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if not self._open.get(name):
            return
        while True:
            found = self.tag[self._stack[-1]] == name
            self._pop()
            if found:
                return

    def text(self) -> str:
        """All blocks that are left, one a line."""
        return "\n".join(t for _, t in self.blocks)

    def features(self) -> set[tuple[int, int, int, int, int]]:
        """``(path, parent path, hint, 0, presentation)``, ``(path, parent path, hint, 1, content)`` and, once a path, ``(path, parent path, hint, 2, 0)`` of the page."""
        out = set()
        above = [0, *(self.path[self.owner[p]] for p in self.parent[1:])]
        for node in range(1, len(self.tag)):
            if self.owner[node] != node or self.unseen[node]:
                continue
            out.add((self.path[node], above[node], self.hint[node], 0, _hash(*self.children.get(node, ()))))
            out.add((self.path[node], above[node], self.hint[node], 2, 0))
        for node, text in self.blocks:
            out.add((self.path[node], above[node], self.hint[node], 1, _hash(text)))
        return out


FEATURE = ("path", "parent", "hint", "kind", "feature")


def site_trees(pages: DataFrame, host: str, html: str, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(host, path, parent, hint, pages, presentation, repetition, contents, rare)``: the merged tree of each host's different pages, of nodes on ``least_pages`` or more.

    ``rare``: the node's children on fewer.  ``presentation``: entropy of the child sequences; ``repetition``: mean log of the pages that show a content.
    """

    def run(batches):
        for batch in slices(batches, html, 1_000_000):
            memo: dict = {}
            names, prints, lists = [], [], []
            for name, text in zip(batch.column(host).to_pylist(), batch.column(html).to_pylist(), strict=True):
                names.append(name)
                prints.append(_hash(text or ""))
                lists.append([dict(zip(FEATURE, f, strict=True)) for f in Page(text or "", memo=memo, whole=True).features()])
            kind = pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("hint", pa.int32()), ("kind", pa.int32()), ("feature", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(prints, pa.int64()), pa.array(lists, kind)], ["host", "page", "features"])

    ship(__name__, base.__name__)
    seen = pages.select(host, html).mapInArrow(run, "host string, page bigint, features array<struct<path:bigint,parent:bigint,hint:int,kind:int,feature:bigint>>")
    seen = seen.dropDuplicates(["host", "page"]).select("host", F.inline("features"))
    counted = seen.groupBy("host", *FEATURE).agg(F.count("*").alias("n"))
    shown = F.when(F.col("kind") == 0, F.col("n"))
    # Written once, as it is read twice and pages are costly to parse.
    nodes = counted.groupBy("host", "path", "parent", "hint").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0)).alias("pages"),
        (F.log(F.sum(shown)) - F.sum(shown * F.log(shown)) / F.sum(shown)).alias("presentation"),
        F.avg(F.when(F.col("kind") == 1, F.log("n"))).alias("repetition"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("contents"),
    )
    # A node is shown by no more pages than the one above it, so what is too rare to be judged goes as whole branches: only their number counts.
    nodes = cut(nodes)
    rare = nodes.filter(F.col("pages") < least_pages)
    branches = rare.groupBy("host", F.col("parent").alias("path")).agg(F.count("*").alias("rare"))
    return nodes.filter(F.col("pages") >= least_pages).join(branches, ["host", "path"], "left").withColumn("rare", F.coalesce("rare", F.lit(0)))


def turned_nodes(trees: DataFrame, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """``(host, path)`` of the nodes that are judged otherwise than their hint alone would be."""
    from math import log

    def judge(table: pa.Table) -> pa.Table:
        rows = {r["path"]: r for r in table.to_pylist()}
        below: dict[int, list[int]] = {}
        for path, r in rows.items():
            below.setdefault(r["parent"], []).append(path)
        order, i = [p for p, r in rows.items() if r["parent"] not in rows], 0
        while i < len(order):
            order.extend(below.get(order[i], ()))
            i += 1
        importance: dict[int, float] = {}
        own: dict[int, float] = {}
        for path in reversed(order):
            r = rows[path]
            base_log = log(max(r["pages"] or 0, 2))
            # A branch too rare to be judged counts as one that no site has judged.
            parts = [importance[c] for c in below.get(path, ())] + [UNJUDGED] * r["rare"]
            if r["contents"]:
                own[path] = max(0.0, 1 - (r["repetition"] or 0.0) / base_log) if (r["pages"] or 0) > 1 else 1.0
                parts.append(own[path])
            shape = min(1.0, (r["presentation"] or 0.0) / base_log) if (r["pages"] or 0) > 1 else 1.0
            importance[path] = (1 - DECAY) * shape + DECAY * (sum(parts) / len(parts) if parts else 0.0)
        # Text is not removed for what stands beside it in the same node.
        importance |= {p: max(importance[p], DECAY * x) for p, x in own.items()}
        turned = [p for p in order if judged(importance[p], rows[p]["hint"], least_importance) != judged(UNJUDGED, rows[p]["hint"])]
        return pa.table({"host": pa.array([table.column("host")[0].as_py()] * len(turned), pa.string()), "path": pa.array(turned, pa.int64())})

    ship(__name__, base.__name__)
    return trees.groupBy("host").applyInArrow(judge, "host string, path bigint")


@any_key("url", "text", "n_chars")
def extract_text(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` of every row of ``pages``."""
    name = lower_ascii(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1))
    rows = pages.select(F.col(key), F.col(url), F.col(html).alias("_html"), name.alias("_host"))
    turned = cut(turned_nodes(site_trees(rows, "_host", "_html")))
    types = dict(pages.dtypes)
    schema = f"`{key}` {types[key]}, `{url}` {types[url]}, text string, n_chars bigint"

    def read_pages(batch, paths):
        memo: dict = {}
        texts = [Page(h or "", p, memo).text() for h, p in zip(batch.column("_html").to_pylist(), paths, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    ship(__name__, base.__name__)
    if turned.count() <= BROADCAST_NODES:
        of: dict[str, set[int]] = {}
        for r in turned.toLocalIterator():
            of.setdefault(r["host"], set()).add(r["path"])
        sent = pages.sparkSession.sparkContext.broadcast({h: frozenset(x) for h, x in of.items()})

        def run(batches):
            for batch in slices(batches, "_html", 1_000_000):
                yield read_pages(batch, [sent.value.get(h, frozenset()) for h in batch.column("_host").to_pylist()])

        return rows.mapInArrow(run, schema)

    def run_joined(batches):
        for batch in slices(batches, "_html", 1_000_000):
            yield read_pages(batch, [frozenset(x or ()) for x in batch.column("_turned").to_pylist()])

    # A host's pages are dealt over SALTS tasks.
    lists = turned.groupBy(F.col("host").alias("_host")).agg(F.collect_list("path").alias("_turned")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int"))
    return salted.join(lists, ["_host", "_salt"], "left").select(key, url, "_html", "_turned").mapInArrow(run_joined, schema)


def op1_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")


QUERIES = {"op1_site_tree": op1_site_tree}
ORACLES: dict[str, str] = {}
