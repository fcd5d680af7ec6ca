"""Main text of web pages by a site style tree.

Pages of one host are merged by the paths of their DOM nodes (tag, class and id
on the way from the root). Every path of a host gets an importance from two
entropies over the different pages that have it: of its presentations (the
sequences of child tags that pages give it), and of its contents (the texts that
pages have there: what all pages repeat tells nothing; text inside links counts
for nothing; nodes inside article elements have the texts of their branches). A
path inherits the importance of its nearest ancestors, by 0.8 a step. Branches of
low importance are cut from every page of the host, inside articles as outside.

What the names of elements say is a prior: 0 for menus, headers, footers and
notices, 1 inside article (or main) elements, 1/2 elsewhere. It weighs as much as
60 pages (where the names say nothing: 10), so the tree decides on hosts with many
pages and the names on hosts with few. Two things the tree cannot tell, because
they change from page to page as articles do, and names alone decide: scripts,
forms and hidden elements, and adverts, sidebars and reader comments. A page of
which the tree would leave nothing is judged by the names.

Edge cases: null or empty html gives an empty text; hosts are taken from the url
(null or odd urls share the empty host); copies of a page count once in the tree;
unclosed and unopened tags are repaired by the parser, which takes time in
proportion to the length of the page and no recursion; an empty table gives an
empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
#: Never part of an article's text, whatever they hold.
NEVER = frozenset("script style noscript template iframe form select option button input textarea dialog head title object embed canvas audio video noframes xmp aside".split())
MENUS = frozenset("nav footer menu".split())
CONTENT = frozenset(("article", "main"))
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hr header footer nav aside form fieldset center hgroup".split())
#: What an open p ends at.
CLOSES_P = BLOCKS - {"html", "body", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
#: An element on the left ends an open sibling on the right.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table select".split())


def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)


#: Names (class, id) of what changes from page to page and is still no article.
NEVER_NAMES = _names(r"ads?|advert\w*|advertisement|sponsor\w*|promo\w*|sidebar|side|aside|widget\w*|related|recommend\w*|comments?|commentlist|disqus|respond|replies|popup|modal|overlay|newsletter|subscribe|signup|tracking")
#: Names of what a site repeats.
MENU_NAMES = _names(r"banner|nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|topbar|footer|foot|cookies?|consent|gdpr|notice|alert|login|search|share|sharing|social|pagination|pager|toolbar|skip")
#: In the header of an article these name its own parts.
OWN_PARTS = _names(r"header|masthead|banner|side")
NEVER_ROLES = frozenset("complementary search form dialog alertdialog".split())
MENU_ROLES = frozenset("navigation banner contentinfo alert menu menubar".split())

#: Kinds of nodes, with the importance that their names give them and how many pages that weighs.
NOTHING, REPEATED, UNKNOWN, MAIN = range(4)
PRIOR = {REPEATED: (0.0, 60), UNKNOWN: (0.5, 10), MAIN: (1.0, 60)}
#: Branches below this importance are cut.
LEAST_IMPORTANCE = 0.4
#: A style node's share in the importance of its element falls by this factor with every further one.
DECAY = 0.9
#: What a step down the path leaves of an ancestor's importance, for up to so many steps.
INHERITED, STEPS = 0.8, 3
#: Up to so many cut paths (8 bytes each) are sent to all tasks; beyond, pages are joined with them.
BROADCAST_PATHS, SALTS = 500_000, 64

TAG = re.compile(r"([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]++))?")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)


class Node:
    """An element: children are texts (raw, not decoded) and nodes; up has the paths of the ancestors that it inherits from."""

    __slots__ = ("tag", "path", "parent", "kind", "up", "children")

    def __init__(self, tag: str, path: bytes, parent: Node | None, kind: int, up: tuple):
        self.tag, self.path, self.parent, self.kind, self.up, self.children = tag, path, parent, kind, up, []

    @property
    def block(self) -> bool:
        return self.tag in BLOCKS or self.parent is None or self.kind != self.parent.kind


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in ATTRIBUTE.findall(raw)} if raw.strip(" /\t\n") else {}


def _kind(tag: str, a: dict[str, str], parent: Node) -> int:
    if parent.kind == NOTHING or tag in NEVER:
        return NOTHING
    names, role = f"{a.get('class', '')} {a.get('id', '')}".strip(), a.get("role", "").lower()
    if tag in ("html", "body"):
        names = ""
    if tag == "header" and parent.kind == MAIN:
        names = OWN_PARTS.sub(" ", names)
    if role in NEVER_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "")) or (names and tag != "main" and NEVER_NAMES.search(names)):
        return NOTHING
    if tag in MENUS or (tag == "header" and parent.kind != MAIN) or role in MENU_ROLES or (names and tag != "main" and MENU_NAMES.search(names)):
        return REPEATED
    if tag in CONTENT or role in ("main", "article") or a.get("itemprop", "") == "articleBody":
        return max(parent.kind, MAIN) if parent.kind != REPEATED else REPEATED
    return parent.kind


def _open(tag: str, raw: str, parent: Node) -> Node:
    a = _attributes(raw)
    kind = _kind(tag, a, parent)
    label = f"{tag}.{'.'.join(sorted(a.get('class', '').split()))}#{a.get('id', '')}:{kind}"
    up = (parent.path, *parent.up)[:STEPS] if parent.kind == kind and parent.tag not in ("", "html", "body") else ()
    node = Node(tag, xxhash.xxh3_64_digest(parent.path + label.encode()), parent, kind, up)
    parent.children.append(node)
    return node


def parse(source: str, host: str = "") -> Node:
    """The DOM of source, its paths starting from the host."""
    root = at = Node("", xxhash.xxh3_64_digest(host.encode()), None, UNKNOWN, ())
    is_open: dict[str, int] = {}
    quotes, place, end = True, 0, 0

    def leave(node: Node) -> Node:
        """Close everything from the innermost element to node; its parent."""
        inner = at
        while True:
            is_open[inner.tag] -= 1
            if inner is node:
                return node.parent
            inner = inner.parent

    def innermost(tags, stops) -> Node | None:
        if not any(is_open.get(t) for t in tags):
            return None
        node = at
        while node.parent is not None and node.tag not in tags:
            if node.tag in stops:
                return None
            node = node.parent
        return node if node.parent is not None else None

    while (start := source.find("<", place)) >= 0:
        second = source[start + 1 : start + 2]
        place = start + 1
        tag = raw = None
        closing = second == "/"
        if source.startswith("<!--", start):
            stop = source.find("-->", start + 4)
            stop = len(source) if stop < 0 else stop + 3
        elif second in ("!", "?"):
            stop = source.find(">", start) + 1
        elif closing or (second.isascii() and second.isalpha()):
            found = TAG.match(source, start + 1 + closing) if quotes else None
            if found:
                tag, raw, stop = found[1], found[2], found.end()
            else:
                # an odd quote: from here on tags end at the next >
                stop = source.find(">", start) + 1
                if stop and re.match(r"/?[a-zA-Z]", source[start + 1 : start + 3]):
                    quotes = False
                    name = re.compile(r"[a-zA-Z][^\s/>]*").match(source, start + 1 + closing)
                    tag, raw = name[0], source[name.end() : stop - 1]
        else:
            continue
        if not stop:
            break  # no > is left: the rest is text
        if start > end:
            at.children.append(source[end:start])
        place = end = stop
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if node := innermost((tag,), ()):
                at = leave(node)
            continue
        if tag in CLOSES_P and (node := innermost(("p",), BLOCKS - {"p"})):
            at = leave(node)
        if tag in CLOSES and (node := innermost(CLOSES[tag], LISTS)):
            at = leave(node)
            if tag == "tr" and at.tag == "tr":
                at = leave(at)
        node = _open(tag, raw, at)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, end)
            place = end = close.end() if close else len(source)
        elif tag not in VOID:
            at = node
            is_open[tag] = is_open.get(tag, 0) + 1
    if end < len(source):
        at.children.append(source[end:])
    return root


def blocks(root: Node) -> Iterator[tuple[Node, str, int]]:
    """(block element, text, characters of it in links) of every block of text in page order."""
    pieces: list[str] = []
    owner, links, linked = root, 0, 0

    def flush() -> str:
        text = SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
        pieces.clear()
        return text

    stack = [(root, iter(root.children))]
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if isinstance(child, str):
            pieces.append(child)
            linked += len(child) * (links > 0)
            continue
        if child is not None and child.tag == "br":
            pieces.append("\n")
            continue
        if child is None:
            stack.pop()
            links -= node.tag == "a"
        if (child or node).block:
            if text := flush():
                yield owner, text, min(linked, len(text))
            linked = 0
            owner = child if child is not None else next((n for n, _ in reversed(stack) if n.block), root)
        if child is not None:
            links += child.tag == "a"
            stack.append((child, iter(child.children)))


def _number(path: bytes) -> int:
    return int.from_bytes(path, "little", signed=True)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def style_nodes(source: str, host: str = "") -> list[tuple]:
    """(path, kind, paths that it inherits from, shape, content or None, characters, those in links) of the nodes of a page that the tree judges: those with text, and what they inherit from."""
    nodes: dict[bytes, list] = {}
    seen = set()

    def add(node: Node) -> list:
        entry = nodes.setdefault(node.path, [node, [], [], 0, 0])
        if id(node) not in seen:
            seen.add(id(node))
            entry[1].append(",".join(c.tag for c in node.children if isinstance(c, Node)))
        return entry

    for node, text, linked in blocks(parse(source, host)):
        if node.kind == NOTHING:
            continue
        up, owns = node.up, True
        for _ in range(len(up) + 1):
            entry = add(node)
            if owns:
                entry[2].append(text)
                entry[3] += len(text)
                entry[4] += linked
            owns = node.kind == MAIN  # what is named as an article is judged as a whole, too
            node = node.parent
    return [(_number(path), node.kind, [_number(u) for u in node.up], _hash("|".join(shapes)), _hash("\n".join(texts)) if texts else None, chars, linked) for path, (node, shapes, texts, chars, linked) in nodes.items()]


def own_importance(pages: int, presentation: float, styles: int, content: float, linked: float) -> float:
    """Of a path of so many pages: the entropy of its presentations (to base pages), their number, the share of different contents, the share of text in links."""
    return 1 - (1 - (1 - DECAY**styles) * presentation) * (1 - content * (1 - linked))


def main_text(source: str, cut=None, host: str = "") -> str:
    """The text of all blocks whose path is not cut; by the names alone without a tree, or if it left nothing."""
    found = [(node, text) for node, text, _ in blocks(parse(source, host)) if node.kind != NOTHING]
    kept = [] if cut is None else [text for node, text in found if _number(node.path) not in cut]
    if not kept:
        best = max((node.kind for node, _ in found), default=NOTHING)
        kept = [text for node, text in found if node.kind == best > REPEATED]
    return "\n\n".join(kept)


class SortedPaths:
    """Membership in a sorted array of paths."""

    def __init__(self, paths: np.ndarray):
        self.paths = paths

    def __contains__(self, path: int) -> bool:
        at = np.searchsorted(self.paths, path)
        return at < len(self.paths) and self.paths[at] == path


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


_NODES = "page long, path long, kind int, up array<long>, shape long, content long, chars long, linked long"


def style_tree(pages: DataFrame) -> DataFrame:
    """(path, n_pages, importance): the merged DOMs of each host, importance being that of the entropies and the names together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 4)
        for batch in batches:
            rows = []
            for host, source in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                found = style_nodes(source, host)
                page = _hash(str([(host, *n) for n in found]))
                rows += [(page, *n) for n in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page", "path", "kind", "up", "shape", "content", "chars", "linked"])

    nodes = pages.select(_host().alias("host"), F.col("html")).where("html <> ''").mapInArrow(run, _NODES)
    once = nodes.dropDuplicates(["page", "path"])
    counted = stored(once.groupBy("path", "shape", "content").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"), F.min("up").alias("up"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")))
    # m pages in groups of n equal ones: the entropy to base m is 1 - sum(n log n) / (m log m), and exp(-sum(n log n) / m) the share of different ones
    n_log_n = F.sum(F.col("n") * F.log("n"))
    shapes = counted.groupBy("path", "shape").agg(F.sum("n").alias("n")).groupBy("path").agg(F.sum("n").alias("m"), n_log_n.alias("_s"), F.count(F.lit(1)).alias("styles"))
    contents = counted.groupBy("path", "content").agg(F.sum("n").alias("n")).where("content is not null").groupBy("path").agg(F.exp(-n_log_n / F.sum("n")).alias("content"))
    facts = counted.groupBy("path").agg(F.min("kind").alias("kind"), F.min("up").alias("up"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    presentation = F.when(F.col("m") > 1, 1 - F.col("_s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    share = F.when(F.col("chars") > 0, F.col("linked") / F.col("chars")).otherwise(0.0)
    own = 1 - (1 - (1 - F.pow(F.lit(DECAY), "styles")) * presentation) * (1 - F.coalesce("content", F.lit(0.0)) * (1 - share))
    tree = stored(facts.join(shapes, "path").join(contents, "path", "left").select("path", "kind", "up", F.col("m").alias("n_pages"), own.alias("own")))
    above = tree.select("path", F.posexplode("up").alias("_step", "_up")).join(tree.select(F.col("path").alias("_up"), F.col("own").alias("_own")), "_up")
    passed_on = above.groupBy("path").agg(F.max(F.col("_own") * F.pow(F.lit(INHERITED), F.col("_step") + 1)).alias("_passed"))
    of_tree = F.greatest("own", F.coalesce("_passed", F.lit(0.0)))
    prior, weight = (F.element_at(F.create_map(*[F.lit(x) for k, v in PRIOR.items() for x in (k, v[i])]), F.col("kind")) for i in (0, 1))
    joined = (F.col("n_pages") * of_tree + weight * prior) / (F.col("n_pages") + weight)
    return tree.join(passed_on, "path", "left").select("path", "n_pages", joined.alias("importance"))


def extract(pages: DataFrame, broadcast_paths: int = BROADCAST_PATHS) -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    cuts = stored(style_tree(pages).where(F.col("importance") < LEAST_IMPORTANCE).select("path"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    ids = dict(pages.dtypes)["page_id"]
    schema = f"page_id {ids}, url string, text string"

    def texts(batch: pa.RecordBatch, found) -> pa.RecordBatch:
        text = [main_text(source, cut, host) for source, host, cut in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    if cuts.count() <= broadcast_paths:
        sent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in cuts.collect()], dtype=np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut = SortedPaths(sent.value)
            for batch in batches:
                yield texts(batch, [cut] * batch.num_rows)

        return rows.mapInArrow(run, schema)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, n[0]) for key, source, host in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for n in style_nodes(source, host)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["_key", "path"])

    keyed = rows.withColumn("_key", F.xxhash64("page_id", "url", "html"))
    salted = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_page = keyed.select("_key", "html", "host").mapInArrow(paths, "_key long, path long").withColumn("_salt", F.pmod("_key", F.lit(SALTS)).cast("int"))
    listed = of_page.join(salted, ["path", "_salt"]).groupBy("_key").agg(F.collect_set("path").alias("cut"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield texts(batch, [frozenset(c or ()) for c in batch.column(4).to_pylist()])

    return keyed.join(listed, "_key", "left").select("page_id", "url", "html", "host", "cut").mapInArrow(joined, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
