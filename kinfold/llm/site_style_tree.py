"""Main text of web pages by a site style tree (operator 3).

1. Every page's html becomes a tree. The trees of one host are merged: a node of the merged tree is a path from the
   root of tags, class names, ids and places among the siblings that share these (numbers in names count as equal, as in
   post-123), and counts, over all pages of the host, which presentation styles (sequences of children) and which
   contents (hashes of its text) occur there. Pages of one host whose articles have equal text count as one, so that
   copies of a page are no evidence against its text. A page leaves its task as the hashes of its nodes. Paths are
   64-bit hashes.
   Nodes are blocks of every kind (p, li, headings, figures and so on), inside articles as well, and spans and links
   without text beside them; other inline elements style a block's text. What is noise by its tag or names is left out
   of contents, so that an advert that changes doesn't hide that the rest of a branch stays.
2. A node's importance is the entropy of its presentations and its contents, over the logarithm of its pages, the
   larger of the two; it lies in 0 to 1. It is averaged with a prior importance of 1, whose weight falls against the
   number of pages that have the node (PRIOR, IN_ARTICLE): one rule for hosts of any size. A branch that has the same styles and contents on most pages is low.
   What tags say (menu, footer and the like) is decisive, as menus and adverts that change from page to page are no
   text. What class, id or role say, and forms, is prior evidence: such a branch goes, unless on the host's pages it
   has high importance and most of the text (NAMED, KEEP). An article is looked for in forms and in branches with a
   name that may mean a page's layout too; it, and what holds it, is never removed; its branches are judged as any others.
3. Pages meet the low paths of their host (broadcast up to BROADCAST_BYTES; beyond, spread over SALTS keys, so that a
   large host's pages are not one task's) and are parsed again without those branches.

Text: blocks in page order joined by one space; white space in a block becomes one space; character references are
decoded. If a page has an article (or main) element, the blocks are those inside; else those of the body.

Defined results: null and empty html give an empty text; an empty table gives an empty one; pages of any length and depth
are parsed whole; pages that tie in everything count once in the tree and get equal texts; text without markup is one block; unclosed and stray tags are
closed where html says so; null urls share a host of their own; repeated rows get equal results; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ship_package, written

SALTS = 64
#: Bytes that the paths of all hosts may have to be broadcast.
BROADCAST_BYTES = 32 << 20
#: A branch is removed below this importance.
LOW = 0.3
#: That a branch is text is believed like so many pages' evidence, plus the logarithm of how rare the branch is on its
#: host; inside an article, so many times more. The same on all pages of a host, it goes from 2 (inside: 8) pages up.
PRIOR, IN_ARTICLE = 0.8, 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Never main text, whatever its importance.
NOISE_TAGS = frozenset("head nav footer aside form menu dialog button select datalist svg math canvas audio video object map".split()) | RAW
NOISE_NAMES = re.compile(
    r"^(ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumb\w*|footer|header|masthead|side-?bar\w*|widget\w*|cookie\w*|consent|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search\w*|share|sharing|social|comments?|comment-\w+|replies|reply|discussion|disqus\w*|related\w*|recommend\w*|pagination|pager|toolbar|skip\w*|legal|copyright|hidden|visually-hidden|sr-only)$",
    re.I,
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names and roles of what holds other articles than the page's: an article below them is not looked for.
FOREIGN_NAMES = re.compile(r"^(ads?|advert\w*|promo\w*|sponsor\w*|nav|menu|footer|side-?bar|widgets?|comments?|comment-\w+|replies|reply|discussion|disqus\w*|related\w*|recommend\w*)$", re.I)
FOREIGN_ROLES = frozenset("navigation contentinfo complementary menu menubar".split())
HEADER_NAMES = re.compile(r"^(header|masthead|banner)$", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: How sure it is that a node is noise: no evidence; a form, a mark that it isn't shown, or a name that may also
#: mean a page's layout; a name of what holds other texts; a tag.
CLEAN, LAYOUT, FOREIGN, SURE = range(4)
#: Names are outweighed where importance times share of the page's text, over so many pages' evidence for 0, reaches this.
NAMED, KEEP = 3, 0.75
P_CLOSERS = BLOCK - frozenset(("br", "option", "title", "caption", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())

#: Inline elements that are branches where no text stands beside them.
PLAIN = frozenset(("a", "span"))

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "name", "kids", "noise", "path", "places", "header", "holds")

    def __init__(self, tag: str, name: str = "", noise: int = CLEAN, path: int = 0, header: bool = False):
        self.tag, self.name, self.kids, self.noise, self.path, self.header = tag, name, [], noise, path, header
        self.holds = False  # an article or main element
        self.places: dict[tuple[str, str], int] = {}

    def place(self, tag: str, name: str) -> int:
        """The path of the next child with this tag and name: a hash of ours, of both, and of its place among such."""
        n = self.places[tag, name] = self.places.get((tag, name), 0) + 1
        return _hash(f"{self.path} {tag} {name} {n}")


def _hash(text: str) -> int:
    """64 bits. Not a cyclic sum: hashes are hashed again, and the differences of such sums cancel out."""
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _named(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(class names in order and id, how sure tag, class, id or role make it that it is no main text, whether it is
    called a header). Names of html and body say what a page is, and those of headings how they look."""
    noise, classes, ident, header = LAYOUT if tag == "form" else SURE if tag in NOISE_TAGS else CLEAN, "", "", tag == "header"
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "class":
                classes = ".".join(sorted(value.split()))
            elif name == "id":
                ident = "#" + value
            if name in ("class", "id") and tag not in ("html", "body"):
                for x in value.split():
                    if FOREIGN_NAMES.match(x):
                        noise = max(noise, FOREIGN)
                    elif HEADER_NAMES.match(x):
                        header = header or tag not in HEADINGS
                    elif NOISE_NAMES.match(x):
                        noise = max(noise, LAYOUT)
            elif name == "role" and value.lower() in NOISE_ROLES and tag not in ("html", "body"):
                noise = max(noise, FOREIGN if value.lower() in FOREIGN_ROLES else LAYOUT)
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                noise = max(noise, LAYOUT)
    return _NUMBER.sub("0", classes + ident), noise, header


def parse(html: str) -> Node:
    """The tree of a page. Text is kept as strings among the kids, with its references decoded."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)

    def text(raw: str) -> None:
        if raw:
            stack[-1].kids.append(unescape(raw) if "&" in raw else raw)

    while at < n:
        i = html.find("<", at)
        if i < 0:
            text(html[at:])
            break
        m = _TAG.match(html, i)
        if not m:
            text(html[at : i + 1])
            at = i + 1
            continue
        text(html[at:i])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].kids.append(Node("p"))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and tag not in SCOPES:
                    break
            continue
        if tag in P_CLOSERS or tag in CLOSES:
            closed = ({"p"} if tag in P_CLOSERS else set()) | CLOSES.get(tag, set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closed:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and stack[k].tag not in closed:
                    break
        name, noise, header = _named(tag, m[3])
        node = Node(tag, name, noise, stack[-1].place(tag, f"{name} {noise}"), header)
        stack[-1].kids.append(node)
        if tag in ("article", "main") and noise < FOREIGN:
            for x in reversed(stack):
                if x.noise >= FOREIGN or x.holds:
                    break
                x.holds = True
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = m.end() if m else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def _article(node: Node) -> list[Node]:
    """The outermost article elements; else main elements; else those in branches whose names may also mean a page's
    layout. An article that is itself marked, as a comment is, or stands among others' texts is none."""
    for sure in (CLEAN, LAYOUT):
        for tag in ("article", "main"):
            found, todo = [], [node]
            while todo:
                x = todo.pop()
                if x.noise > sure:
                    continue
                if x.tag == tag:
                    found.append(x)
                else:
                    todo.extend(k for k in reversed(x.kids) if isinstance(k, Node))
            if found:
                return found
    return [node]


def _is_noise(x: Node, inside: bool, kept: frozenset[int] | set[int] = frozenset()) -> bool:
    """By tag and names, unless an article stands in it. An article's header with its heading is text, whatever it is
    made of; a measured importance can outweigh names."""
    if x.noise == SURE or x.noise == CLEAN and not x.header:
        return x.noise == SURE
    if x.holds and x.noise < FOREIGN or x.noise == CLEAN and (inside or x.tag == "header") and not _is_page_header(x):
        return False
    return _key(x, inside) not in kept


def main_text(html: str | None, low: frozenset[int] | set[int] = frozenset(), kept: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of a page without noise and without the branches at the paths in low; names are no evidence at the paths in kept."""
    if not html:
        return ""
    root = parse(html)
    tops = _article(root)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        x = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if x:
            blocks.append(x)

    for top in tops:
        inside = top is not root
        todo: list = [(top, False)]
        while todo:
            x, beside = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                run.append(x)
            elif x is not top and (_is_noise(x, inside, kept) or not x.holds and _key(x, inside) in low and _is_branch(x, beside)):
                if x.tag in BLOCK:
                    flush()
            else:
                if x.tag in BLOCK:
                    flush()
                    todo.append((None, False))
                own = bool(low) and _has_text(x)
                todo.extend((k, own) for k in reversed(x.kids))
        flush()
    return " ".join(blocks)


def _is_page_header(x: Node) -> bool:
    """A header with a heading of its article is text; another is the page's or a notice."""
    return not any(isinstance(k, Node) and k.tag in ("h1", "h2", "h3", "hgroup") for k in x.kids)


def _has_text(x: Node) -> bool:
    """Of its own, not only in the elements in it."""
    return any(isinstance(k, str) and not k.isspace() for k in x.kids)


def _is_branch(x: Node, beside: bool) -> bool:
    """Blocks, custom elements, and plain inline elements without text beside them; others style a block's text."""
    return x.tag in BLOCK or "-" in x.tag or x.tag in PLAIN and not beside


def _key(x: Node, inside: bool) -> int:
    """A path's last bit says whether it lies inside an article."""
    return x.path & ~1 | inside


def observations(html: str | None) -> dict[int, tuple[int, int, float]]:
    """{path: (presentation, content, share)} of a page's branches that hold text, as hashes; share: of the page's text,
    for noise by name. At path 0: the content of the articles, by which pages of equal text are known."""
    if not html:
        return {}
    root = parse(html)
    tops = {id(x) for x in _article(root)}
    order, todo = [], [(root, False, False)]
    while todo:
        x, inside, beside = at = todo.pop()
        order.append(at)
        inside, own = inside or id(x) in tops and x is not root, _has_text(x)
        todo.extend((k, inside, own) for k in x.kids if isinstance(k, Node) and k.noise < SURE)
    out: dict[int, tuple[int, int, float]] = {}
    done: dict[int, tuple[int, int, bool]] = {}  # content, characters with those of noise by name, whether it is such
    named, text = [], []
    for x, inside, beside in reversed(order):  # kids before their parents
        parts, style, n = [], [], 0
        noise = id(x) not in tops and _is_noise(x, inside)
        for k in x.kids:
            if not isinstance(k, Node):
                parts.append(_SPACE.sub(" ", k))
                n += len(k.strip())
            elif k.noise < SURE:
                c, chars, left_out = done[id(k)]
                n += chars
                if noise or not left_out:
                    style.append(f"{k.tag}.{k.name}")
                    if c:
                        parts.append(f"<{c}>")
        content = _hash(joined) if (joined := "".join(parts).strip()) else 0
        done[id(x)] = content, n, noise
        if content and id(x) in tops:
            text.append(content)
        if content and x is not root and _is_branch(x, beside):
            out[_key(x, inside)] = (_hash(" ".join(style)), content, 0.0)
            if noise:
                named.append((_key(x, inside), n))
    total = done[id(root)][1]
    for path, n in named:
        style, content, _ = out[path]
        out[path] = (style, content, n / total)
        if 2 * n > total and id(root) in tops:
            text.append(content)
    if total:
        out[0] = (0, _hash(str(text)), 0.0)
    return out


def host_of(url: Column) -> Column:
    """Lower-cased, without user, port and www."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), "^www\\.", ""), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages, presentation, content, share, host_pages, importance): the merged trees of all hosts."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import site_style_tree as M

        for batch in batches:
            hosts, texts, nodes = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                if seen := M.observations(html.as_py()):
                    hosts.append(host)
                    texts.append(seen[0][1])
                    nodes.append([{"path": p, "style": s, "content": c, "share": x} for p, (s, c, x) in sorted(seen.items())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(texts, pa.int64()), pa.array(nodes, pa.list_(pa.struct([(x, pa.int64()) for x in ("path", "style", "content")] + [("share", pa.float64())])))],
                names=["host", "page", "nodes"],
            )

    seen = pages.select(host_of(pages["url"]).alias("host"), F.col("html").cast("string")).mapInArrow(run, "host string, page long, nodes array<struct<path: long, style: long, content: long, share: double>>")
    once = seen.groupBy("host", "page").agg(F.min("nodes").alias("nodes")).select("host", F.explode("nodes").alias("x"))
    values = F.explode(F.array(F.struct(F.lit(False).alias("is_content"), F.col("x.style").alias("value")), F.struct(F.lit(True).alias("is_content"), F.col("x.content").alias("value"))))
    counts = once.select("host", F.col("x.path").alias("path"), F.col("x.share").alias("share"), values.alias("y")).groupBy("host", "path", "y.is_content", "y.value").agg(F.count("*").alias("n"), F.sum("share").alias("share"))
    c = F.col("n").cast("double")

    def entropy(kind: bool) -> Column:
        """Of the values' shares, over the logarithm of the pages: 1 if every page has a value of its own."""
        of = F.col("is_content") == F.lit(kind)
        total, plogp = F.sum(F.when(of, c)), F.sum(F.when(of, c * F.log(c)))
        return F.when(total > 1, (F.log(total) - plogp / total) / F.log(total)).otherwise(F.lit(1.0))

    merged = counts.groupBy("host", "path").agg(F.sum(F.when(F.col("is_content"), F.col("n"))).alias("n_pages"), entropy(False).alias("presentation"), entropy(True).alias("content"), (F.sum("share") / F.sum("n")).alias("share"))
    merged = written(merged, "style-tree-nodes")
    of_host = merged.where("path = 0").select(F.col("host").alias("t_host"), F.col("n_pages").alias("host_pages"))
    tree = merged.where("path <> 0").join(of_host, F.col("host") == F.col("t_host")).drop("t_host")
    prior = (F.lit(PRIOR) + F.log(F.col("host_pages") / F.col("n_pages"))) * F.when(F.col("path").bitwiseAND(F.lit(1)) == 1, F.lit(float(IN_ARTICLE))).otherwise(F.lit(1.0))
    return tree.withColumn("importance", (F.col("n_pages") * F.greatest("presentation", "content") + prior) / (F.col("n_pages") + prior))


def extract(pages: DataFrame, low: float = LOW) -> DataFrame:
    """(page_id, url, text, n_chars, n_low), a row for each row of pages. n_low: low branches of its host."""
    ship_package(pages.sparkSession)
    tree = style_tree(pages)
    goes = (F.col("share") == 0) & (F.col("importance") < low)
    stays = F.col("n_pages") * F.col("content") * F.round("share", 6) >= KEEP * (F.col("n_pages") + NAMED)
    noise = tree.where(goes | stays & (F.col("n_pages") > 1)).groupBy("host").agg(*(F.sort_array(F.collect_set(F.when(x, F.col("path")))).alias(k) for k, x in (("low", goes), ("kept", stays))))
    noise = written(noise, "style-tree")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    noise = noise.withColumnRenamed("host", "n_host")
    size = noise.agg(F.sum(F.length("n_host") + 8 * (F.size("low") + F.size("kept")) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(noise), F.col("host") == F.col("n_host"), "left")
    else:  # a large host's pages meet its paths on SALTS keys
        noise = noise.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        at = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("at", at).join(noise, (F.col("host") == F.col("n_host")) & (F.col("at") == F.col("salt")), "left")
    rows = rows.select("page_id", "url", "html", "low", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kinfold.llm import site_style_tree as M

        for batch in batches:
            texts, n_low = [], []
            for html, paths, kept in zip(batch.column(2), batch.column(3), batch.column(4)):
                paths = frozenset(paths.as_py() or ())
                texts.append(M.main_text(html.as_py(), paths, frozenset(kept.as_py() or ())))
                n_low.append(len(paths))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_low, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_low"],
            )

    kind, url = pages.schema["page_id"].dataType.simpleString(), pages.schema["url"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url {url}, text string, n_chars long, n_low long")
