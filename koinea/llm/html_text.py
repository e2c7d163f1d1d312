"""Main text of web pages by wrapper inference.

The pages of a host are token streams of one template. Each page's elements are aligned with the host's
wrapper, a union-free regular expression: under the same parent equal labels match; elements that only
some pages have become optional, those that stand several times in one page become repeated groups,
and texts that differ become slots. A wrapper is kept as one row for each path of labels. Merging takes
sums, minima and maxima only, so it is the same in any order and combines before the shuffle.

The region whose slots hold most text is the article's. Containers in it that say the same on every page
are no part of the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koinea.llm._tables import written

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("script style noscript template iframe svg math canvas object audio video head title nav footer aside form button select option textarea dialog menu".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
WHOLE = frozenset("html body main article page".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg"
#: Whole class, id and role names of what is not the article. A name that only contains one of them says nothing.
MARKS = frozenset(
    "ad ads advert adverts advertisement banner sponsored promo sidebar menu navigation navbar breadcrumb breadcrumbs footer masthead toolbar topbar "
    "comment comments comment-list comments-area disqus_thread respond cookie-notice cookie-banner cookies consent gdpr notice popup modal newsletter "
    "subscribe share sharing social related recommended pagination pager login search complementary contentinfo search-form skip-link".split()
)
#: A container that is the same on so many pages, and on all that have it, is left out of the article ...
SAME_PAGES = 3
#: ... unless such containers hold more than this share of the region: then the pages are copies of each other.
COPIES = 0.3

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>(.*?)(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass
class Group:
    """What a wrapper knows of one path of labels: pages that have it, the most in one parent, text without links, and hashes of texts."""

    pages: int = 0
    most: int = 0
    mass: int = 0
    low: int | None = None
    high: int | None = None
    place: float = 0.0
    children: dict[str, Group] = field(default_factory=dict)

    @property
    def slot(self) -> bool:
        return self.low != self.high

    def add(self, other: Group) -> None:
        """Aligns another wrapper with this one, group by group."""
        self.pages, self.most, self.mass, self.place = self.pages + other.pages, max(self.most, other.most), self.mass + other.mass, self.place + other.place
        known = [x for x in (self.low, self.high, other.low, other.high) if x is not None]
        if known:
            self.low, self.high = min(known), max(known)
        for label, child in other.children.items():
            self.children.setdefault(label, Group()).add(child)

    def expression(self, label: str = "page", parent_pages: int = 0) -> str:
        """The wrapper as a union-free regular expression: # is a slot, . a constant text."""
        order = sorted(self.children.items(), key=lambda x: (x[1].place / x[1].pages, x[0]))
        inner = ("#" if self.slot else "." if self.low is not None else "") + "".join(c.expression(k, self.pages) for k, c in order)
        own, optional = f"<{label}>{inner}</>", self.pages < parent_pages
        return f"({own}){'*' if optional else '+'}" if self.most > 1 else f"({own})?" if optional else own


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """Element name with its first class, digits as #, and whether its names mark it as no part of an article."""
    if not attributes or attributes.isspace():
        return name, False
    names: list[str] = []
    first = ""
    for kind, a, b, c in _NAMED.findall(attributes):
        own = (a or b or c).lower().split()
        if kind.lower() == "class" and own and not first:
            first = re.sub(r"[0-9]+", "#", own[0])
        names += own
    marked = name not in WHOLE and not MARKS.isdisjoint(names)
    return (f"{name}.{first}" if first else name).replace("/", "|"), marked or bool(_HIDDEN.search(attributes))


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """('open', label, marked), ('close', name, False) and ('text', text, False); raw elements and comments are left out."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], False
        at = m.end()
        name = m.group(4)
        if name is None:
            continue
        name = name.lower()
        if m.group(3):
            yield "close", name, False
        else:
            label, marked = _label(name, m.group(5))
            yield "open", label, marked
            if name not in VOID and m.group(5).endswith("/") and name not in INLINE and ":" in name:
                yield "close", name, False
    if at < len(page):
        yield "text", page[at:], False


@dataclass
class _Open:
    label: str
    path: str
    marked: bool
    texts: list[str] = field(default_factory=list)
    mass: int = 0
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.label.split(".")[0]


def skeleton(page: str) -> dict[str, Group]:
    """The page's paths of labels with their groups; marked elements and what is in them are left out, inline text is its parent's."""
    groups: dict[str, Group] = {"": Group(pages=1, most=1)}
    stack = [_Open("page", "", False)]
    links = 0

    def shut(n: int) -> None:
        while len(stack) > n:
            node = stack.pop()
            if not node.marked:
                group = groups[node.path]
                group.mass += node.mass
                text = " ".join("".join(node.texts).split())
                if text:
                    h = xxhash.xxh64_intdigest(text) >> 1
                    group.low = h if group.low is None else min(group.low, h)
                    group.high = h if group.high is None else max(group.high, h)

    for kind, value, marked in events(page):
        name = value.split(".")[0]
        if kind == "text":
            if not stack[-1].marked:
                stack[-1].texts.append(value)
                if not links:
                    stack[-1].mass += len(value) - value.count(" ") if not value.isspace() else 0
        elif name == "a":
            links = 1 if kind == "open" else 0
        elif name in ("br", "hr"):
            stack[-1].texts.append(" ")
        elif name in VOID or name in INLINE:
            continue
        elif kind == "open":
            if name == stack[-1].name and name in ("p", "li", "td", "th", "dt", "dd", "tr", "option"):
                shut(len(stack) - 1)  # such elements end where the next begins
            links, top = 0, stack[-1]
            path = f"{top.path}/{value}" if top.path else value
            out = top.marked or marked or name in DROPPED
            if not out:
                top.counts[value] = top.counts.get(value, 0) + 1
                group = groups.setdefault(path, Group(pages=1, place=sum(top.counts.values())))
                group.most = max(group.most, top.counts[value])
            stack.append(_Open(value, path, out))
        else:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    shut(k)
                    links = 0
                    break
    shut(0)
    return groups


def tree(groups: dict[str, Group]) -> Group:
    """Groups by path as a tree."""
    root = Group()
    for path, group in sorted(groups.items()):
        node = root
        for label in path.split("/") if path else []:
            node = node.children.setdefault(label, Group())
        node.add(group)
    return root


@dataclass
class Region:
    """Where a host's pages hold their articles: labels from the root, and paths below that say the same on every page."""

    path: list[str]
    same: frozenset[str]


def find_region(wrapper: Group) -> Region:
    """The outermost <article>, else <main>, with most slot text; else the deepest container with 7/10 of it.

    If no text differs, as with one page or copies of one, all text without links counts.
    """

    def slots(node: Group, all_text: bool) -> int:
        return (node.mass if all_text or node.slot else 0) + sum(slots(c, all_text) for c in node.children.values())

    all_text = slots(wrapper, False) == 0
    mass = lambda node: slots(node, all_text)

    def named(node: Group, path: list[str], name: str) -> Iterator[tuple[int, list[str], Group]]:
        for label, child in sorted(node.children.items()):
            if label.split(".")[0] == name:
                yield mass(child), [*path, label], child
            else:
                yield from named(child, [*path, label], name)

    for name in ("article", "main"):
        found = sorted(named(wrapper, [], name), key=lambda x: (-x[0], len(x[1]), x[1]))
        if found and found[0][0]:
            return Region(found[0][1], _same(found[0][2]))
    path, node = [], wrapper
    while True:
        inner = {k: c for k, c in node.children.items() if k.split(".")[0] not in PROSE}
        label = max(sorted(inner), key=lambda k: mass(inner[k]), default=None)
        if label is None or mass(inner[label]) == 0 or mass(inner[label]) < 0.7 * mass(node):
            return Region(path, _same(node) if path else frozenset())
        path, node = [*path, label], inner[label]


def _same(region: Group) -> frozenset[str]:
    """Paths below a region of containers whose texts are constant; none if they hold much of it or the pages are few."""

    def total(node: Group) -> int:
        return node.mass + sum(total(c) for c in node.children.values())

    def constant(node: Group) -> bool:
        return not node.slot and all(constant(c) for c in node.children.values())

    def walk(node: Group, path: str) -> Iterator[tuple[str, int]]:
        for label, child in node.children.items():
            own = f"{path}/{label}" if path else label
            if label.split(".")[0] not in PROSE and child.pages >= SAME_PAGES and constant(child):
                yield own, total(child)
            else:
                yield from walk(child, own)

    found = list(walk(region, ""))
    return frozenset(p for p, _ in found) if sum(m for _, m in found) <= COPIES * total(region) else frozenset()


def extract(page: str, region: Region) -> str:
    """Text of the page's elements at the region's path, or, where it lacks them, of the region of this page alone."""
    blocks = _blocks(page, region)
    if blocks is None:
        blocks = _blocks(page, find_region(tree(skeleton(page)))) or []
    return " ".join(blocks)


def _blocks(page: str, region: Region) -> list[str] | None:
    """Blocks inside the elements at the region's path; None if there are none."""
    stack: list[tuple[str, str, bool]] = []  # name, path, dropped
    out: list[str] = []
    piece: list[str] = []
    want = "/".join(region.path)
    seen, path, dropped = not want, "", False

    def flush() -> None:
        text = " ".join(html.unescape("".join(piece)).split())
        if text:
            out.append(text)
        piece.clear()

    for kind, value, marked in events(page):
        inside = not want or path == want or path.startswith(want + "/")
        if kind == "text":
            if inside and not dropped:
                piece.append(value)
            continue
        name = value.partition(".")[0]
        if name in ("br", "hr"):
            piece.append(" ")
            continue
        if name in INLINE:
            if kind == "open" and marked:
                stack.append((name, path, dropped))
                dropped = True
            elif kind == "close" and stack and stack[-1][0] == name:
                path, dropped = stack.pop()[1:]
            continue
        flush()
        if kind == "open":
            if name in VOID:
                continue
            if stack and name == stack[-1][0] and name in ("p", "li", "td", "th", "dt", "dd", "tr", "option"):
                path, dropped = stack.pop()[1:]
            stack.append((name, path, dropped))
            path = f"{path}/{value}" if path else value
            seen = seen or path == want
            inside = not want or path == want or path.startswith(want + "/")
            below = path[len(want) + 1 :] if want else path
            dropped = dropped or (path != want and marked) or name in DROPPED or (inside and below in region.same) or (name == "header" and not want)
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    path, dropped = stack[k][1:]
                    del stack[k:]
                    break
    flush()
    return out if seen else None


def host_of(url):
    """Host of a URL column, lower case; an empty string if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


#: Paths of labels that one task holds before it hands them on.
FRESH = 50_000
_GROUPS = "host string, path string, pages long, most long, mass long, low long, high long, place double"
_NAMES = [c.split()[0] for c in _GROUPS.split(", ")]


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups by host and path from the pages of a partition; some hosts and paths may come more than once."""
    held: dict[tuple[str, str], Group] = {}

    def out() -> pa.RecordBatch:
        rows = [[h, p, g.pages, g.most, g.mass, g.low, g.high, g.place] for (h, p), g in held.items()]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_NAMES)

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for path, group in skeleton(page or "").items():
                held.setdefault((host, path), Group()).add(group)
            if len(held) > FRESH:
                yield out()
    if held:
        yield out()


def wrappers(pages: DataFrame) -> DataFrame:
    """Rows (host, groups) from all pages(url, html): a wrapper's groups by path, with what Group holds."""
    made = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(_infer, _GROUPS)
    merged = made.groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.max("most").alias("most"), F.sum("mass").alias("mass"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("place").alias("place")
    )
    return merged.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(*_NAMES[1:]))).alias("groups"))


def wrapper_of(groups: list[dict]) -> Group:
    """The wrapper from its row's groups."""
    return tree({g["path"]: Group(**{k: g[k] for k in _NAMES[2:]}) for g in groups})


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_region(wrapper_of(g)) for g in batch.column(1).to_pylist()]
        columns = [pa.array(["/".join(r.path) for r in found]), pa.array([sorted(r.same) for r in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["host", "region", "same"])


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, path, same in zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)], strict=True):
            texts.append(extract(page or "", Region(path.split("/") if path else [], frozenset(same or ()))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of pages(page_id, url, html): rows (page_id, url, text, n_chars).

    The text lies in the region that the host's wrapper finds, without what its elements or whole names
    mark as menus, footers, sidebars, notices, adverts, forms, scripts, styles or comments, and without
    containers that say the same on every page. Character references are decoded, white space within a
    block is one space, blocks are joined by one space.

    Null or empty html gives an empty text; a null url counts as the host ''. A page that lacks its host's
    region is taken by its own. Repeated rows give repeated results and, like ties of equal mass, which
    go to the shorter path and then the first by name, make no difference to order; other columns are
    ignored; an empty table gives an empty result.
    """
    found = wrappers(pages).mapInArrow(_regions, "host string, region string, same array<string>")
    hosts = written(found)  # of known size, so Spark can decide on a broadcast
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    joined = rows.join(hosts, "host", "left").select("page_id", "url", "html", "region", "same")
    return joined.mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")
