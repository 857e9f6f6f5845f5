"""Main text of pages by a site style tree.

A page's elements are grouped by style: the tags and classes from the root of its content down. Merging
the pages of a host gives each style the contents and the presentations (its children's styles)
that it takes there. A style's importance is the entropy of these over the host's different
pages, as a share of the most it could be: what is the same on
every page has none, and a style that too few pages have, all. An element's importance is that of the texts in its branch, by
their length. Branches without importance are removed from each page, as is the text of such styles in the branches that stay.

What HTML itself says is no text of the article (scripts, menus, forms, footers) goes before that. Class names
decide alone only where they leave no doubt (adverts, sidebars, reader comments); doubtful ones inside an article only
ask for more importance of their branch, and without a tree they decide nothing there.

Two passes read the pages; between them only hashes are shuffled, by host and style.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ASCII_LOWER, ASCII_UPPER, ascii_lower, checkpointed, slices

#: Different pages that a host needs, importance that a style needs, importance that a branch of doubtful name needs, and the part of it that is presentation.
MIN_PAGES, MIN_IMPORTANCE, MIN_DOUBTFUL, PRESENTATION = 8, 0.1, 0.9, 0.1
#: Styles (about 100 bytes each) up to here are broadcast; more are joined by host.
BROADCAST_ROWS = 100_000
#: Elements without content, elements that begin a block, elements that are never part of an article's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
NOISE_TAGS = frozenset("applet aside audio button canvas datalist dialog embed footer form frame frameset head iframe input menu meter nav noframes noscript object progress script select style svg template textarea title video".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: Names of what is no part of an article; words that may stand beside them.
NOISE_NAMES = frozenset("ad adbox ads advert advertisement advertising adverts breadcrumb breadcrumbs comment commentlist comments disqus guestbook navbar newsletter pagination sidebar sidebars".split())
PARTS = frozenset("area bar block bottom box button buttons container form icons inner items left link links list panel posts right section thread top wrap wrapper".split())
#: Names that may also be those of passages.
DOUBTFUL = frozenset("alert alerts banner consent cookie cookies discussion feedback footer gdpr menu menubar modal nav navigation notice notices notification pager popup promo promoted promotion recommended related replies reply respond responses share sharing skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split())
#: Names of headers, which are noise outside articles only; first parts of names that tell of a page's layout and not of the element.
HEADER_WORDS, LAYOUT = frozenset("header masthead".split()), frozenset("has is no with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 section".split())
NOISE_ROLES = frozenset("alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: An open element that such a tag closes.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
CLOSES_P = BLOCKS - {"br", "body", "html", "head", "title", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}
_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[^a-z0-9]+")
_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


class Node:
    """An element: noise is "always", "outside" (of an article), "doubt" or ""; weight, mass and peak are of its branch, set by weigh()."""

    __slots__ = ("tag", "style", "parent", "children", "noise", "path", "weight", "mass", "peak")

    def __init__(self, tag: str, style: str, parent: "Node | None", noise: str):
        self.tag, self.style, self.parent, self.noise, self.children = tag, style, parent, noise, []
        self.path, self.weight, self.mass, self.peak = 0, 0, 0.0, 0.0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def whole(name: str, words: frozenset[str]) -> bool:
    """Whether a name as a whole, not one word of it, is of these words."""
    parts = set(_WORD.split(name))
    return name in words or bool(parts & words) and parts <= words | PARTS


def noise_of(tag: str, own: dict[str, str]) -> str:
    """A Node's noise by its tag and attributes."""
    if tag in NOISE_TAGS or own.get("role", "").lower() in NOISE_ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true":
        return "always"
    classes, ids = own.get("class", "").lower().split(), own.get("id", "").lower().split()
    if tag in ("body", "html", "article", "main") and not any("comment" in n for n in (*classes, *ids)):
        return ""
    # ids of headings and sections are made of their headings
    named = classes if tag in HEADINGS else classes + [n for n in ids if n not in ("ad", "comment")]
    # one doubtful word may name a passage, two, or one with a part of the page, don't
    if any(whole(n, NOISE_NAMES) or len(_WORD.split(n)) > 1 and whole(n, NOISE_NAMES | DOUBTFUL) for n in named):
        return "always"
    words = {w for n in named for parts in [_WORD.split(n)] if parts[0] not in LAYOUT for w in (n, *parts)}
    if tag == "header" or words & (DOUBTFUL | HEADER_WORDS | NOISE_NAMES):
        return "doubt" if any(whole(n, DOUBTFUL) for n in classes) else "outside"
    return ""


def parse(page: str) -> Node:
    """The page's tree, in time in proportion to the page. Children are nodes and strings; references in strings are decoded."""
    root = Node("#root", "", None, "")
    stack, open_, blocks = [root], {}, [0]  # open elements; where each tag, and where blocks, are open
    pos, end = 0, len(page)

    def close(depth: int) -> None:
        """Closes the elements from that depth on."""
        while len(stack) > depth:
            gone = stack.pop()
            open_[gone.tag].pop()
            if gone.tag in BLOCKS:
                blocks.pop()

    def ended(tag: str) -> int:
        """The depth of the outermost element that a tag closes, within the innermost one that shields others; 0: none."""
        fence = max((open_[t][-1] for t in FENCE[tag] if open_.get(t)), default=0)
        return min((open_[t][-1] for t in CLOSES[tag] if open_.get(t) and open_[t][-1] > fence), default=0)

    while pos < end:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if not tag:
            text = m[0]
            if text[0] != "<" or text == "<":
                stack[-1].children.append(html.unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if m[1]:
            # an article's end also ends what was left open in it; a stray end tag ends nothing
            if open_.get(tag):
                close(open_[tag][-1])
            continue
        own = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        if tag in CLOSES_P and open_.get("p") and open_["p"][-1] == blocks[-1]:
            close(blocks[-1])
        if tag in CLOSES and (depth := ended(tag)):
            close(depth)
        named = own.get("class") or own.get("id") or own.get("role") or ""
        new = Node(tag, f"{tag}.{' '.join(named.split())}" if named else tag, stack[-1], noise_of(tag, own))
        new.parent.children.append(new)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, pos)
            pos = found.start() if found else end
        open_.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            blocks.append(len(stack))
        stack.append(new)
    return root


def content_roots(root: Node) -> list[Node]:
    """The outermost articles that are no noise; else the main elements, the body, or all."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    stack = [(root, False, False)]
    while stack:
        node, in_article, in_main = stack.pop()
        if node.noise:
            continue
        tag = node.tag
        if tag == "article" and not in_article:
            found["article"].append(node)
        elif tag == "main" and not in_main:
            found["main"].append(node)
        elif tag == "body":
            found["body"].append(node)
        stack += [(c, in_article or tag == "article", in_main or tag == "main") for c in reversed(node.children) if isinstance(c, Node)]
    return found["article"] or found["main"] or found["body"] or [root]


def kept(roots: list[Node]) -> list[Node]:
    """The elements of the content in page order, each with its path (a hash of the styles down to it), without those that HTML or their names rule out, whose place is marked by noise "always"."""
    out, stack = [], list(reversed(roots))
    own, in_article = set(map(id, roots)), any(r.tag == "article" for r in roots)
    for r in roots:
        r.parent = None
    while stack:
        x = stack.pop()
        if id(x) not in own:
            if x.noise == "always" or x.noise and not in_article:
                x.noise = "always"
                continue
        x.path = xxhash.xxh64_intdigest(f"{x.parent.path if x.parent else ''}>{x.style}") - (1 << 63)
        out.append(x)
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return out


def weigh(nodes: list[Node], importance: dict[int, float]) -> None:
    """Sets the branches' weight (characters), mass (the same times importance) and peak (the most important text's)."""
    for x in reversed(nodes):
        own = sum(len(c) for c in x.children if isinstance(c, str) and not c.isspace())
        if own:
            i = importance.get(x.path, 1.0)
            x.weight, x.mass, x.peak = x.weight + own, x.mass + i * own, max(x.peak, i)
        if x.parent is not None:
            up = x.parent
            up.weight, up.mass, up.peak = up.weight + x.weight, up.mass + x.mass, max(up.peak, x.peak)


def without_importance(x: Node, min_importance: float) -> bool:
    """Whether a branch goes: doubtful names need much importance, the others some, or one important text."""
    if not x.weight:
        return False
    mean = x.mass / x.weight
    return mean < MIN_DOUBTFUL if x.noise == "doubt" else mean < min_importance and x.peak < MIN_DOUBTFUL


def blocks_of(roots: list[Node], importance: dict[int, float] | None = None, min_importance: float = MIN_IMPORTANCE) -> str:
    """The text of what is kept: blocks with white space as single spaces, joined by a space."""
    nodes = kept(roots)
    if importance:
        weigh(nodes, importance)
    out: list[str] = []
    run: list[str] = []

    def edge() -> None:
        if run:
            out.append(" ".join("".join(run).split()))
            run.clear()

    stack: list = [(r, True) for r in reversed(roots)]
    while stack:
        x, top = stack.pop()
        if x is None:
            edge()
        elif isinstance(x, str):
            run.append(x)
        elif not top and (x.noise == "always" or importance and without_importance(x, min_importance)):
            edge()
        else:
            if top or x.tag in BLOCKS:
                edge()
                stack.append((None, False))
            silent = importance and importance.get(x.path, 1.0) < min_importance
            stack.extend((c, False) for c in reversed(x.children) if not (silent and isinstance(c, str)))
    edge()
    return " ".join(b for b in out if b)


def styles_of(roots: list[Node]) -> list[tuple[int, int, int]]:
    """(path, hash of its content, hash of its presentation) of each style in the page that has text of its own."""
    texts: dict[int, list[str]] = {}
    shapes: dict[int, list[str]] = {}
    for x in kept(roots):
        texts.setdefault(x.path, []).extend(c for c in x.children if isinstance(c, str))
        shapes.setdefault(x.path, []).extend(c.style for c in x.children if isinstance(c, Node))
    digest = lambda x: xxhash.xxh64_intdigest(x) - (1 << 63)
    own = {p: " ".join("".join(t).split()) for p, t in texts.items()}
    return [(p, digest(t), digest("\n".join(shapes[p]))) for p, t in own.items() if t]


def host_of(url: str | None) -> str:
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m[1].translate(_LOWER) if m else ""


def importances(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, path, importance) of the styles that min_pages different pages of a host have and whose importance is below MIN_DOUBTFUL. pages: url and html; null url: the host named by the empty string; null html: no styles."""

    def styles(batches):
        for batch in batches:
            for b in slices(batch, "html"):
                out: tuple[list, ...] = ([], [], [], [], [])
                for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                    if not page:
                        continue
                    found = styles_of(content_roots(parse(page)))
                    whole = xxhash.xxh64_intdigest(repr(found)) - (1 << 63)
                    for row in found:
                        for column, x in zip(out, (host_of(url), row[0], whole, row[1], row[2]), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.string(), *[pa.int64()] * 4], strict=True)], ["host", "path", "page", "content", "shape"])

    seen = pages.mapInArrow(styles, "host string, path bigint, page bigint, content bigint, shape bigint")
    # pages that are equal count once
    once = seen.groupBy("host", "path", "page").agg(F.first("content").alias("content"), F.first("shape").alias("shape"))
    each = once.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("shape").alias("value")))).alias("x"))
    counts = each.groupBy("host", "path", "x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("s")).where(F.col("m") >= min_pages)
    entropy = (F.log2("m") - F.col("s") / F.col("m")) / F.log2("m")
    found = sums.groupBy("host", "path").agg(F.sum(entropy * F.when(F.col("kind") == 0, 1 - PRESENTATION).otherwise(PRESENTATION)).alias("importance"))
    return found.where(F.col("importance") < MIN_DOUBTFUL)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null html counts as empty, and an empty page has empty text. Null urls and those without
    :// are of one host, named by the empty string. Hosts with fewer than min_pages (2 at least) different pages have no
    tree, so there names and HTML decide alone. Broken markup is read to its end. Repeated rows stay; an empty table gives no rows; other columns are
    ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    known = checkpointed(importances(rows.select("url", "html"), max(2, min_pages)))
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    by_host: dict[str, dict[int, float]] = {}
    if few:
        for r in known.collect():
            by_host.setdefault(r["host"], {})[r["path"]] = r["importance"]
        shared, joined = spark.sparkContext.broadcast(by_host), rows.select("page_id", "url", "html", F.lit(None).cast("map<bigint,double>").alias("styles"))
    else:  # adaptive execution splits hosts with very many pages
        lists = known.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "importance"))).alias("styles"))
        host = F.coalesce(ascii_lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
        shared, joined = None, rows.withColumn("host", host).join(lists, "host", "left").select("page_id", "url", "html", "styles")

    def text(batches):
        for batch in batches:
            for b in slices(batch, "html"):
                found = [shared.value.get(host_of(u)) for u in b.column("url").to_pylist()] if shared else [dict(x or ()) for x in b.column("styles").to_pylist()]
                out = [blocks_of(content_roots(parse(page)), own, min_importance) if page else "" for page, own in zip(b.column("html").to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(text, f"page_id {kind}, url string, text string, n_chars bigint")
