"""HTML extraction with a site style tree.

Pages of one host are merged into a tree: a node is the path of tags with their
classes and marks, its presentation styles are the child sequences that it has
on the pages, its contents are the texts below it, one per page; a text of its
own is a leaf.  The entropy of styles and of contents over the pages that show
a node give its importance: what many pages show alike says little.  A node
seen on few pages says little either way, so ``DOUBT`` pages of full importance
are added to each.  What goes from a page is what lies below its nodes of low
importance, and nothing else does.

Marks are evidence that a page gives by itself, and tell nodes apart: an
element whose tag, role or name says furniture (navigation, notices, adverts,
forms, comments and the like), and what stands beside the page's article or
main part.  They multiply a node's importance by ``MARKED``, which is below the
bound for every host.  A class or id name alone marks no branch that holds the
page's only article or main part, or most of its text.

Single texts are judged too, inside article and main parts and on hosts of two
pages as well, by the entropy of the pages that show them.  An article that is
published again stays: a text is not judged where copies of one article are half
of the pages that show it, and where most of a part would go, only texts go
whose importance is low with ``DOUBT`` as well.

Cases: null html is the empty page, whose text is empty; a null or odd url has
the empty host; pages of any length and depth are read whole; unclosed and
misplaced tags, comments and truncated pages are read as browsers do in the
main; repeated rows get equal results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, slices

TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not text of the page.
SILENT = frozenset("button datalist select script style title textarea xmp iframe noembed noframes noscript template svg math canvas object audio video".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
CLOSES_P = BLOCKS - frozenset("caption html body head frameset legend optgroup option tbody td tfoot th thead tr".split())
#: Open elements that a tag ends, and those that shield them.
P_SHIELDS = frozenset("td th table caption".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FURNITURE = frozenset("nav footer aside form menu dialog head search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
# Words of class and id names that mark page furniture.
FURNITURE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Parts of longer names that say the same, and names of navigation in one word.
FURNITURE_PARTS = re.compile(r"comment(?!ar)|cookie|advert|sidebar|newsletter|breadcrumb|footer|sponsor|masthead|popup|^(?:top|main|site|page|sub|side)?(?:nav|menu)(?:bar|menu|list)?$")
#: How names of sections that readers write begin; these may be longer than the article.
REPLIES = ("comment", "repl", "respond", "disqus")
BODY = frozenset(("article", "main"))
#: A node of less importance than LEAST goes; GAMMA is the weight of contents against styles.
LEAST, GAMMA = 0.3, 0.9
#: Pages of full importance that are added to those of a node, and the factor of marks.
DOUBT, MARKED = 3, 0.25
TEXT = "#text"


@dataclass
class Page:
    """Elements in page order, the root first: parent, label, and what each says of itself; and the texts of elements."""

    parent: list[int] = field(default_factory=lambda: [0])
    label: list[str] = field(default_factory=lambda: [""])
    #: its tag, role or attributes say furniture; its name does; its name says that readers wrote it
    own: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])
    replies: list[bool] = field(default_factory=lambda: [False])
    #: it is or lies in an article or main part
    body: list[bool] = field(default_factory=lambda: [False])
    #: (element, text)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def read(source: str) -> Page:
    """Elements and texts of a page."""
    page, parts = Page(), []
    stack: list[tuple[str, int]] = [("", 0)]
    #: how many elements of a tag are open; silent elements that are open, with the elements in them; silent tags with no end ahead
    count: Counter[str] = Counter()
    mute: list[str] = []
    endless: set[str] = set()
    at = 0

    def flush() -> None:
        if parts and (text := " ".join("".join(parts).split())):
            page.blocks.append((stack[-1][1], text))
        parts.clear()

    def pop_to(i: int) -> None:
        flush()
        count.subtract(tag for tag, _ in stack[i:])
        del stack[i:]

    def close(tags: set[str] | frozenset[str], shields: set[str] | frozenset[str]) -> None:
        if any(count[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in tags:
                    pop_to(i)
                    break
                if stack[i][0] in shields:
                    break

    while at < len(source):
        m = TAG.search(source, at)
        if at < (stop := m.start() if m else len(source)) and not mute:
            parts.append(markup.unescape(source[at:stop]))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if mute:
            if m[1]:
                if tag in mute:
                    while mute.pop() != tag:
                        pass
                    continue
                if tag not in BLOCKS or not count[tag]:
                    continue
                mute.clear()
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            else:
                if tag not in VOID and not m[3].rstrip().endswith("/"):
                    mute.append(tag)
                continue
        if m[1]:
            if tag in BLOCKS:
                if count[tag]:
                    pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
                elif tag == "p":
                    flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in SILENT:
            if not m[3].rstrip().endswith("/") and tag not in endless:
                if re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at):
                    mute.append(tag)
                else:
                    endless.add(tag)
            if tag in endless:  # its label ends at the next tag
                nxt = TAG.search(source, at)
                at = nxt.start() if nxt else len(source)
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        if tag in CLOSES_P:
            close({"p"}, P_SHIELDS)
        if tag in ENDS:
            close(*ENDS[tag])
        flush()
        if tag in VOID:
            continue
        names = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])} if m[3] and not m[3].isspace() else {}
        above = stack[-1][1]
        body = page.body[above]
        marks = {x.lower() for x in NAMES.findall(f"{names.get('class', '')} {names.get('id', '')}")}
        hidden = "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")
        own = tag in FURNITURE or tag == "header" and not body or names.get("role", "").lower() in ROLES or hidden
        named = bool(marks & FURNITURE_NAMES) or any(map(FURNITURE_PARTS.search, marks)) or "header" in marks and not body
        named = not own and named and tag not in ("html", "body", "main") and (tag != "article" or body or any(x.startswith(("comment", "repl")) for x in marks))
        stack.append((tag, len(page.parent)))
        count[tag] += 1
        page.parent.append(above)
        page.label.append(".".join([tag, *sorted(names.get("class", "").split())]))
        page.own.append(own)
        page.named.append(named)
        page.replies.append(named and any(x.lower().startswith(REPLIES) for x in f"{names.get('class', '')} {names.get('id', '')}".split()))
        page.body.append(body or tag in BODY)
    flush()
    return page


def marked(page: Page) -> tuple[list[bool], bool]:
    """Which elements a page itself marks as furniture, and whether an article or main part is left.

    Names don't count for elements that hold most of the text, or the wrappers of the largest part where all parts are in named ones.
    """
    n, parent = len(page.parent), page.parent
    furniture = [False] * n
    for i in range(1, n):
        furniture[i] = page.own[i] or furniture[parent[i]]
    shown = [(i, len(t)) for i, t in page.blocks if not furniture[i]]
    size = [0] * n
    for i, length in shown:
        size[i] += length
    total = sum(size)
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
    counts = [page.named[i] and (page.replies[i] or 2 * size[i] <= total) for i in range(n)]

    def inside() -> list[bool]:
        held = [False] * n
        for i in range(1, n):
            held[i] = held[parent[i]] or counts[i]
        return held

    parts = [(i, length) for i, length in shown if page.body[i]]
    held = inside()
    if parts and all(held[i] for i, _ in parts):
        outer = list(range(n))  # the outermost article or main part of each element
        readers = [False] * n
        for i in range(1, n):
            outer[i] = outer[parent[i]] if page.body[parent[i]] else i
            readers[i] = readers[parent[i]] or page.replies[i]
        best = max({outer[i] for i, _ in parts}, key=lambda k: (not readers[k], size[k], -k))
        rest = max((x for x in parts if outer[x[0]] == best), key=lambda x: (not readers[x[0]], x[1], -x[0]))[0]
        for i in (best, rest):
            while i and all(held[k] for k, _ in parts):
                counts[i] = False
                i = parent[i]
            held = inside()
    found = [page.own[i] or counts[i] for i in range(n)]
    return found, any(not held[i] for i, _ in parts)


@dataclass
class Tree:
    """A page's elements and texts as nodes of its host's tree: their numbers are odd if marked, and 0 below marks."""

    nodes: list[int]
    leaves: list[int]
    #: per element: whether it is or lies in a part that is marked
    gone: list[bool]


def place(page: Page) -> Tree:
    """Numbers of a page's nodes: hashes of the labels and marks from the root down."""
    flags, parts = marked(page)
    n, parent = len(page.parent), page.parent
    holds = [False] * n  # an article or main part
    for i in range(n - 1, 0, -1):
        holds[parent[i]] = holds[parent[i]] or holds[i] or page.body[i]
    number = lambda above, label, mark: xxhash.xxh3_64_intdigest(f"{above} {label}") >> 2 << 1 | mark
    nodes, gone = [2] * n, [False] * n
    for i in range(1, n):
        if gone[parent[i]]:
            gone[i], nodes[i] = True, 0
            continue
        gone[i] = flags[i] or parts and not (page.body[i] or holds[i])
        nodes[i] = number(nodes[parent[i]], page.label[i], gone[i])
    leaves = [0 if gone[i] else number(nodes[i], TEXT, parts and not page.body[i]) for i, _ in page.blocks]
    return Tree(nodes, leaves, gone)


def content_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def main_part(page: Page, tree: Tree) -> list[int]:
    """The texts that are below no mark."""
    return [k for k, leaf in enumerate(tree.leaves) if leaf and not leaf & 1]


def part_hash(page: Page, tree: Tree) -> int:
    return content_hash(" ".join(page.blocks[k][1] for k in main_part(page, tree)))


@dataclass
class Site:
    """What the tree of a host says: its pages, nodes of low importance, and how many pages show a repeated text or copy of a main part."""

    pages: int
    low: frozenset[int]
    texts: dict[int, int]
    copies: dict[int, int]


def main_text(page: Page, site: Site | None) -> str:
    """The text that is left without what is below the host's nodes of low importance and without texts of low importance."""
    if site is None:
        return " ".join(t for _, t in page.blocks)
    tree = place(page)
    n = len(page.parent)
    dropped, unmarked = [False] * n, [False] * n  # by any node, and by nodes without a mark
    for i in range(1, n):
        low = tree.nodes[i] in site.low
        dropped[i] = dropped[page.parent[i]] or low
        unmarked[i] = unmarked[page.parent[i]] or low and not tree.nodes[i] & 1
    part = [k for k, (i, _) in enumerate(page.blocks) if not (dropped[i] and not unmarked[i]) and not (tree.leaves[k] & 1 and tree.leaves[k] in site.low)]
    size = lambda blocks: sum(len(page.blocks[k][1]) for k in blocks)
    good = [k for k in part if not dropped[page.blocks[k][0]] and tree.leaves[k] not in site.low]
    if 2 * size(good) < size(part) and any(page.body[page.blocks[k][0]] for k in part):
        good = part
    if site.texts:
        copies = site.copies.get(part_hash(page, tree), 1)
        shown = [site.texts.get(content_hash(page.blocks[k][1]), 0) for k in good]
        shown = [0 if copies > 1 and 2 * copies >= m else m for m in shown]
        kept = [k for k, m in zip(good, shown, strict=True) if not m]
        if 2 * size(kept) < size(good):
            kept = [k for k, m in zip(good, shown, strict=True) if not m or text_importance(m, site.pages) >= LEAST] or good
        good = kept
    return " ".join(page.blocks[k][1] for k in good)


def text_importance(n: int, pages: int) -> float:
    """Importance of a text that n pages of a host show, with doubt."""
    own = 1 - math.log(n) / math.log(pages) if pages > 1 else 1.0
    return (pages * own + DOUBT) / (pages + DOUBT)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def page_features(page: Page) -> set[tuple[int, str, int]]:
    """(node, kind, feature) of a page; node 0 stands for the host."""
    tree, out = place(page), {(0, "page", 0)}
    n = len(page.parent)
    styles: dict[int, list[str]] = defaultdict(list)
    below: list[list[int]] = [[] for _ in range(n)]
    leaves: dict[int, list[int]] = defaultdict(list)
    for k, (i, text) in enumerate(page.blocks):
        h = content_hash(text)
        below[i].append(h)
        if tree.leaves[k]:
            leaves[tree.leaves[k]].append(h)
        if tree.leaves[k] and not tree.leaves[k] & 1:
            out.add((0, "text", h))
    contents: dict[int, list[int]] = defaultdict(list)
    folded = lambda found: found[0] if len(found) == 1 else content_hash(repr(found))
    for i in range(n - 1, 0, -1):
        if below[i]:
            h = folded(below[i])
            below[page.parent[i]].append(h)
            if tree.nodes[i]:
                contents[tree.nodes[i]].append(h)
    for i in range(1, n):
        if tree.nodes[i]:
            out.add((tree.nodes[i], "page", 0))
            if tree.nodes[page.parent[i]] and not tree.nodes[page.parent[i]] & 1:
                styles[tree.nodes[page.parent[i]]].append(page.label[i])
    out |= {(node, "page", 0) for node in leaves}
    out |= {(node, "style", content_hash(">".join(x))) for node, x in styles.items() if node != 2}
    out |= {(node, "text", folded(x)) for found in (contents, leaves) for node, x in found.items()}
    out.add((0, "copy", part_hash(page, tree)))
    return out


def features(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, node, kind, feature, n, times): how many pages show what, features of one page counted together; node 0 is the host."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int, str, int]] = Counter()
        for part in slices(batch, 1):
            for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen.update((host, *x) for x in page_features(read(source or "")))
        columns = zip(*((*k, n) for k, n in seen.items()), strict=True) if seen else [()] * 5
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "node", "kind", "feature", "n"])

    rows = map_arrow(pages.select(host_of(F.col(url)).alias("host"), html), run, "host string, node bigint, kind string, feature bigint, n bigint")
    summed = rows.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))
    return summed.groupBy("host", "node", "kind", F.when((F.col("n") > 1) & (F.col("node") == 0), F.col("feature")).alias("feature"), "n").agg(F.count(F.lit(1)).alias("times"))


def nodes(seen: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of every node of :func:`features`."""
    n, times, m = F.col("n").cast("double"), F.col("times"), F.col("pages").cast("double")
    only = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    found = seen.where("node != 0").groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == "page", F.col("n"))).alias("pages"),
        *(only(kind, times * n).alias(f"{kind}_n") for kind in ("text", "style")),
        *(only(kind, times * n * F.log(n)).alias(f"{kind}_log") for kind in ("text", "style")),
    )
    # entropy over the pages that have it, and its part of the greatest that is possible
    entropy = lambda kind: F.coalesce((F.log(f"{kind}_n") - F.col(f"{kind}_log") / F.col(f"{kind}_n")) / F.log(F.greatest(F.col("pages"), F.lit(2))), F.lit(0.0))
    own = F.when(F.col("pages") > 1, (1 - GAMMA) * entropy("style") + GAMMA * entropy("text")).otherwise(F.lit(1.0))
    return found.select("host", "node", "pages", ((m * own + DOUBT) / (m + DOUBT) * F.when(F.col("node") % 2 == 1, MARKED).otherwise(1.0)).alias("importance"))


def style_tree(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, node, pages, importance) of every node."""
    return nodes(features(pages, html, url))


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """``key``, ``url`` and the main ``text`` of every page."""
    seen = cut(features(pages, html, url))
    low = nodes(seen).where(F.col("importance") < LEAST).groupBy("host").agg(F.collect_list("node").alias("low"))
    root = seen.where((F.col("node") == 0) & ((F.col("n") > 1) | (F.col("kind") == "page")))
    hosts = root.where(F.col("kind") == "page").select("host", F.col("n").alias("pages"))
    n, log_pages = F.col("n").cast("double"), F.log(F.col("pages").cast("double"))
    poor = (F.col("kind") == "text") & (GAMMA * (1 - F.log(n) / log_pages) < LEAST)
    #: fewer copies can't be half of the pages that show a text of low importance
    copied = (F.col("kind") == "copy") & (2 * n >= F.exp(log_pages * (1 - LEAST / GAMMA)) * (1 - 1e-9))
    listed = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("feature", "n")))
    often = root.where("kind != 'page'").join(hosts, "host").where(poor | copied).groupBy("host").agg(listed("text").alias("texts"), listed("copy").alias("copies"))
    told = cut(hosts.join(low, "host", "left").join(often, "host", "left").where("low is not null or size(texts) > 0").select("host", F.struct("pages", "low", "texts", "copies").alias("site")))
    listed_size = lambda c: F.greatest(F.size(f"site.{c}"), F.lit(0))
    size = told.agg(F.coalesce(F.sum(F.length("host") + 8 * listed_size("low") + 16 * (listed_size("texts") + listed_size("copies")) + 64), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        told = F.broadcast(told)
    joined = pages.select(F.col(key), F.col(url), F.col(html), host_of(F.col(url)).alias("host")).join(told, "host", "left").select(key, url, html, "host", "site")
    kept: dict[str, Site | None] = {}

    def site_of(row: dict | None) -> Site | None:
        if row is None:
            return None
        texts, copies = ({x["feature"]: x["n"] for x in row[k] or ()} for k in ("texts", "copies"))
        return Site(row["pages"], frozenset(row["low"] or ()), texts, copies)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 2):
            texts = []
            for i, (source, host) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                if host not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    kept[host] = site_of(part.column(4)[i].as_py())
                texts.append(main_text(read(source or ""), kept[host]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], [key, url, "text"])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return map_arrow(joined, run, f"`{key}` {kind(key)}, `{url}` {kind(url)}, text string")
