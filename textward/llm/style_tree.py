"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree.  An element node is a path of tags with their
classes; its style nodes are the sequences of children it has, and its content is the text of
its blocks and its links.  An element whose pages all look alike has a low presentation
importance, one whose content repeats over the pages a low content importance (both by
entropy); the composite of a branch weighs the two.  Branches that are low from top to bottom
are removed from every page.  Containers are judged, inside articles too, and what stands in them
goes with them: a heading that many articles share stays while a box that repeats goes.  Pages that share the text of their largest element count once, so
copies of an article do not look like boilerplate.  For hosts with few pages the tree of all
hosts decides.

Tags and names that declare an element to be no part of an article are a prior of importance 0:
they remove what the tree cannot tell, on hosts with few pages, and comments, which differ from
page to page.  Of what is left, the articles are the page if they hold at least half of the text;
otherwise they are teasers, and the rest is.  The result says how many blocks went either way.

Cases: null or empty html gives an empty text; broken markup is read as far as it goes; a null
or odd url belongs to the host ""; repeated rows get equal texts; an empty table gives an empty
result.  Columns of the input are kept; the added ones (``ADDED``) replace those of their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, fresh_name, stage

#: Branches below this importance are noise.
THRESHOLD = 0.4
#: Weight of a branch below its styles, by the number of styles.
GAMMA = 0.9
#: Pages that a host (or all hosts) must have of a branch to judge it.
MIN_PAGES = 8
#: Steps of a path that are spelled out; the steps above become a digest, so branches stay apart.
MAX_DEPTH = 40
#: Characters of a step that are spelled out, likewise.
MAX_LABEL = 80
ADDED = ("text", "n_chars", "by_tree", "by_prior")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rp rt "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An opening tag closes an open one of these kinds, up to a boundary.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_NOISE_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select textarea input label "
    "iframe object svg math menu dialog title".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus footer form login menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promotion related replies reply "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_HEADER_WORDS = frozenset("header masthead".split())
#: Words that say nothing about what an element is for.
_PLAIN_WORDS = frozenset(
    "site page main global top bottom left right user reader post posts article articles blog the "
    "box boxes block blocks list bar bars wrap wrapper container section area areas link links button "
    "buttons item items inner outer content slot unit primary secondary column col row card desktop "
    "mobile fixed sticky text title head body group panel region zone widgets icons icon us".split()
)
_ARTICLE = frozenset(["article", "main"])
#: Elements that are judged; paragraphs and headings go with the one they stand in.
_CONTAINERS = frozenset(
    "div section ul ol dl table figure details fieldset center nav aside footer header form article".split()
)
KEPT, BY_TREE, BY_PRIOR = 0, 1, 2


def _declared(tag: str, names: list[str], role: str, inside: bool) -> bool:
    """True if tag, class, id or role say that an element is no part of an article.

    A name counts if it has a word for such a part and otherwise only words that say nothing:
    ``related-posts`` does, ``share-price`` does not.
    """
    if tag in _NOISE_TAGS or role in _NOISE_ROLES:
        return True
    if tag in ("html", "body") or tag in _ARTICLE:
        return False
    words = _NOISE_WORDS if inside else _NOISE_WORDS | _HEADER_WORDS
    if tag == "header":
        return not inside
    for name in names:
        segments = {x for x in re.split(r"[^a-z]+", name) if x}
        if segments & words and segments <= words | _PLAIN_WORDS:
            return True
    return False


class Page:
    """Blocks and elements of a page in one walk over its markup.

    ``texts``: (path, state, inside an article, raw text) in page order, where None as a text
    ends a block; the state is one of ``KEPT``, ``BY_TREE`` (below a branch of ``noise``) and
    ``BY_PRIOR``.  ``styles``: (path, children) of each closed element.  ``links``: (path, target).
    """

    def __init__(self, markup: str, noise: frozenset[str] = frozenset()):
        self.noise = noise
        self.texts: list[tuple[str, int, bool, str | None]] = []
        self.styles: list[tuple[str, str]] = []
        self.links: list[tuple[str, str]] = []
        # open elements: tag, path, state, inside an article, children
        self.open: list[tuple[str, str, int, bool, list[str]]] = [("", "", KEPT, False, [])]
        self._walk(markup)
        while len(self.open) > 1:
            self._close()

    def _text(self, raw: str | None) -> None:
        _, path, state, inside, _ = self.open[-1]
        self.texts.append((path, state, inside, raw))

    def _close(self) -> None:
        tag, path, _, _, children = self.open.pop()
        if children:
            self.styles.append((path, ",".join(children)))
        if tag not in _INLINE:
            self._text(None)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES:
            kinds, stops = _CLOSES[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in stops:
                    break
                if self.open[k][0] in kinds:
                    while len(self.open) > k:
                        self._close()
                    break
        elif tag not in _INLINE and tag != "br":
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == "p":
                    while len(self.open) > k:
                        self._close()
                    break
                if self.open[k][0] not in _INLINE:
                    break
        found = {}
        if "=" in attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), (a or b or c).lower())
        names = (found.get("class", "") + " " + found.get("id", "")).split()
        label = ".".join([tag, *sorted({re.sub(r"\d+", "#", n) for n in names})]).replace("/", "|")
        if len(label) > MAX_LABEL:
            label = f"{label[: MAX_LABEL - 20]}~{_digest(label) & _MASK:x}"
        _, path, state, inside, children = self.open[-1]
        if not children or children[-1] != label:
            children.append(label)
        if tag not in _INLINE:
            self._text(None)
        if tag == "a" and "href" in found:
            self.links.append((f"{path}/{label}", found["href"]))
        if tag in _VOID:
            return
        if len(self.open) % MAX_DEPTH == 0:
            path = f"/~{_digest(path) & _MASK:x}"
        path = f"{path}/{label}"
        if state == KEPT and tag in _CONTAINERS and path in self.noise:
            state = BY_TREE
        if state == KEPT and _declared(tag, names, found.get("role", ""), inside):
            state = BY_PRIOR
        self.open.append((tag, path, state, inside or tag in _ARTICLE, []))

    def _end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._close()
                return
            if self.open[k][0] in ("table", "article", "main", "body") and tag in ("p", "li", "div", "span"):
                return

    def _walk(self, markup: str) -> None:
        at = 0
        while True:
            m = _TOKEN.search(markup, at)
            if m is None:
                self._text(markup[at:])
                return
            if m.start() > at:
                self._text(markup[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._end(tag)
                continue
            attributes = m[3] if m[2] else m[6]
            self._start(tag, attributes or "")
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(markup, at)
                at = end.end() if end else len(markup)
                if self.open[-1][0] == tag:
                    self._close()

    def blocks(self) -> Iterator[tuple[str, int, str]]:
        """(path, state, text) of every block with text."""
        for path, state, _, text in _joined(self.texts):
            yield path, state, text


def _joined(texts) -> Iterator[tuple[str, int, bool, str]]:
    """Pieces between block ends, white space turned into one space; empty blocks are left out."""
    pieces: list[str] = []
    head: tuple[str, int, bool] = ("", KEPT, False)
    for path, state, inside, raw in [*texts, ("", KEPT, False, None)]:
        if raw is None:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                yield *head, text
            pieces = []
        else:
            if not any(p.strip() for p in pieces):
                head = (path, state, inside)
            pieces.append(raw)


_MASK = (1 << 64) - 1


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def judged_text(markup: str, noise: frozenset[str] = frozenset()) -> tuple[str, int, int]:
    """The main text of a page, and how many blocks the tree and the prior took out."""
    page = Page(markup, noise)
    # elements of other states end no block of the text, and inline ones may stand inside it
    kept = [x for x in page.texts if x[1] == KEPT or x[3] is None]
    blocks = list(_joined(kept))
    size = {side: sum(len(b[3]) for b in blocks if b[2] == side) for side in (True, False)}
    chosen = [b[3] for b in blocks if b[2] == (size[True] >= size[False] and size[True] > 0)]
    gone = [state for _, state, _, _ in _joined(page.texts)]
    return " ".join(chosen), gone.count(BY_TREE), gone.count(BY_PRIOR)


def main_text(markup: str, noise: frozenset[str] = frozenset()) -> str:
    """The main text of a page."""
    return judged_text(markup, noise)[0]


def host(url: Column) -> Column:
    """Host of an url in lower case."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def tree_rows(pages: DataFrame, url: str, markup: str) -> DataFrame:
    """(host, page, path, style, value): every style and content value of an element once per page.

    ``page`` is the digest of the text of the element that has most of it and is not declared
    noise.
    """
    schema = "host string, page bigint, path string, style boolean, value bigint"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            columns: list[list] = [[], [], [], [], []]
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(text)
                blocks = list(page.blocks())
                own: dict[str, list[str]] = {}
                for p, n, t in blocks:
                    if not n:
                        own.setdefault(p, []).append(t)
                longest = max((" ".join(x) for x in own.values()), key=len, default="")
                rows = {(p, False, _digest(t)) for p, _, t in blocks}
                rows |= {(p, False, _digest("\0" + x)) for p, x in page.links}
                rows |= {(p, True, _digest(x)) for p, x in page.styles}
                mark = _digest(longest)
                for p, style, value in rows:
                    for c, x in zip(columns, (name, mark, p, style, value), strict=True):
                        c.append(x)
            types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["host", "page", "path", "style", "value"],
            )

    rows = pages.where(F.col(markup).isNotNull()).select(host(F.col(url)).alias("host"), F.col(markup).alias("html"))
    return rows.mapInArrow(run, schema)


def _importance(counts: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, m, styles, presentation, content) from value counts n and pages m.

    Presentation: entropy of the styles in base m.  Content: 1 less the mean entropy of the
    values over pages, log n / log m.
    """
    p = F.col("n") / F.col("of")
    with_total = (
        counts.where("style").groupBy(*keys, "path").agg(F.sum("n").alias("of")).withColumnsRenamed({k: k + "_" for k in [*keys, "path"]})
    )
    on = [F.col(k) == F.col(k + "_") for k in [*keys, "path"]]
    log_m = F.log(F.col("m").cast("double"))
    m = pages.withColumnsRenamed({k: k + "_m" for k in [*keys, "path"]})
    on_m = [F.col(k) == F.col(k + "_m") for k in [*keys, "path"]]
    styles = (
        counts.where("style").join(with_total, on).groupBy(*keys, "path")
        .agg(F.count(F.lit(1)).alias("styles"), F.sum(-p * F.log(p)).alias("entropy"))
    )
    content = counts.where("NOT style").groupBy(*keys, "path").agg(F.avg(F.log("n")).alias("spread"))
    both = styles.join(content, [*keys, "path"], "full").join(m, on_m)
    one = F.col("m") <= 1
    return both.select(
        *keys,
        "path",
        "m",
        F.coalesce("styles", F.lit(0)).alias("styles"),
        F.when(one, 1.0).otherwise(F.col("entropy") / log_m).alias("presentation"),
        F.when(one, 1.0).otherwise(1 - F.col("spread") / log_m).alias("content"),
    )


def _branches(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, m, importance, most): composite of each branch and its largest content below."""
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    below = (
        nodes.where("content IS NOT NULL AND path <> ''").select(*keys, F.explode(above).alias("top"), "content")
        .groupBy(*keys, "top")
        .agg(F.avg("content").alias("mean"), F.max("content").alias("most"))
    )
    at = below.join(nodes.withColumnRenamed("path", "top"), [*keys, "top"])
    weight = F.pow(F.lit(GAMMA), F.col("styles"))
    look = F.coalesce("presentation", F.lit(0.0))
    return at.select(
        *keys, F.col("top").alias("path"), "m", ((1 - weight) * look + weight * F.col("mean")).alias("importance"), "most"
    )


def noise_branches(pages: DataFrame, url: str = "url", markup: str = "html", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, paths): the branches that go from the pages of a host; containers only."""
    seen = stage(tree_rows(pages, url, markup).distinct(), "tree-rows")
    by_host = stage(seen.groupBy("host", "path", "style", "value").agg(F.count(F.lit(1)).alias("n")), "tree-values")
    m_host = seen.groupBy("host", "path").agg(F.countDistinct("page").alias("m"))
    m_host = stage(m_host, "tree-pages")
    n_all = by_host.groupBy("path", "style", "value").agg(F.sum("n").alias("n"))
    m_all = m_host.groupBy("path").agg(F.sum("m").alias("m"))
    own = _branches(stage(_importance(by_host, m_host, ["host"]), "tree-nodes"), ["host"])
    total = _branches(stage(_importance(n_all, m_all, []), "tree-nodes-all"), [])
    names = {c: c + "_all" for c in total.columns}
    both = own.join(total.withColumnsRenamed(names), F.col("path") == F.col("path_all"), "left")
    enough = F.col("m") >= min_pages
    low = lambda x: (F.col("importance" + x) < threshold) & (F.col("most" + x) < threshold)
    gone = F.when(enough, low("")).otherwise((F.col("m_all") >= min_pages) & low("_all"))
    tag = F.substring_index(F.substring_index("path", "/", -1), ".", 1)
    return both.where(gone & tag.isin(*sorted(_CONTAINERS))).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def extract(df: DataFrame, url: str = "url", markup: str = "html", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns but the markup, with the main text, its number of code points, and the number
    of blocks that the tree (``by_tree``) and only the prior (``by_prior``) took out."""
    df = df.drop(*[c for c in df.columns if c.lower() in ADDED and c not in (url, markup)])
    at, list_ = fresh_name(df, "host__"), fresh_name(df, "paths__")
    noise = stage(noise_branches(df, url, markup, threshold, min_pages), "tree-noise")
    noise = noise.select(F.col("host").alias(at), F.col("paths").alias(list_))
    names = [c for c in df.columns if c != markup]
    rows = df.join(noise, host(F.col(url)) == F.col(at), "left").select(*names, markup, list_)
    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, noise_here = None, frozenset()
        for b in batches(frames):
            bodies, lists = (b.column(b.num_columns - k).to_pylist() for k in (2, 1))
            out = []
            for body, paths in zip(bodies, lists, strict=True):
                if paths != last:
                    last, noise_here = paths, frozenset(paths or ())
                out.append(judged_text(body, noise_here) if body else ("", 0, 0))
            found = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *found], [*names, "text", "by_tree", "by_prior"])

    found = rows.mapInArrow(run, f"{schema}, text string, by_tree bigint, by_prior bigint")
    return found.select(*names, "text", F.length("text").cast("bigint").alias("n_chars"), "by_tree", "by_prior")
