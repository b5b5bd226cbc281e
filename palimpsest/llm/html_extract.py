"""HTML extraction by wrapper induction.

For each host with three distinct pages or more, every page is aligned with the host's reference (the page
with the middle number of blocks) by simple tree matching: the largest matching of ordered trees whose matched nodes have
equal tags and matched parents. Counts by node over all pages tell constant nodes from varying slots:
blocks whose text is the same on most of the pages are template, and the elements that hold nearly all of
the varying text are the host's content roots. A page's main text is what is left without template and
without elements whose tag, role, class or heading says that they are menus, headers, footers, sidebars,
notices, adverts, forms or reader comments; a class or id counts only if it says nothing else, and not
where it would take nearly all of a page. Article and main elements are evidence of where the text is; of
several articles the largest counts, and those at least half as large. Where the host's varying text is
elsewhere by far, the induced root decides.

All pages are aligned, whole; copies of a page count once, and copies but for a few words of the
reference say nothing. Lists of children of any length are matched exactly, in memory that grows with the
root of their product.

Defined results: null html is the empty page: empty text; a null url is a host of its own; a page
without blocks has the empty text; a host with fewer than three distinct pages has no template; repeated
rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import portions
from .shared import forgotten, free_name, written

#: Rows and characters of a portion of pages.
ROWS, CHARS = 1000, 8_000_000

#: Elements by how they are treated, and names of what is no part of an article.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "select", "object", "math", "canvas", "audio", "video")
DROPPED_TAGS = frozenset("head nav footer aside button menu dialog".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar widget widgets footer masthead comment comments reply replies disqus related recommended recommendations share sharing social login search pagination pager toolbar skip copyright disclaimer".split()
)
#: Parts of class names that say nothing by themselves.
PLAIN_NAMES = frozenset("site page main post article content body top bottom left right inner outer global primary secondary box bar block list area wrap wrapper container section panel group item items links link form text inline fixed sticky bg js id x y px the of and".split())
#: Headings of what follows an article.
DROPPED_HEADINGS = frozenset(("comments", "comment", "reader comments", "leave a comment", "leave a reply", "add a comment", "responses", "related articles", "related posts", "related stories", "kommentare", "kommentar schreiben", "leserkommentare", "comentarios", "deja un comentario", "commentaires", "laisser un commentaire"))
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What may hold a page's text as a whole.
ROOTS = frozenset("html body main article section div center form td".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: How an element is marked as no article: whatever it holds, or by a name that may mislead.
FIXED, NAMED = 1, 2

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\b[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
SPACES = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none")
HEADING_WORDS = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("chars", "children", "dropped", "inside", "level", "mark", "parent", "path", "tag", "texts")

    def __init__(self, tag: str, parent: Node | None, path: int, mark: int, inside: bool):
        """path: a hash of the tags and classes of the blocks down to it; mark: FIXED or NAMED if it seems to be no article; inside: an article or main element."""
        self.tag, self.parent, self.path, self.mark, self.inside = tag, parent, path, mark, inside
        self.children: list[Node] = []
        self.texts: list[str] = []
        self.dropped, self.chars = False, 0
        self.level = 0 if parent is None else parent.level + 1


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)}


def says_no_article(name: str) -> bool:
    """Whether a class or id is made of names of what is no article and words without meaning, like `ad`, `site-footer`, `cookie_notice`."""
    parts = NAME.findall(name)
    return any(p in DROPPED_NAMES for p in parts) and all(p in DROPPED_NAMES or p in PLAIN_NAMES for p in parts)


def mark_of(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """FIXED: no part of an article by its tag, role or state; NAMED: by its class or id, or a form, which may as well hold the whole page."""
    if tag in DROPPED_TAGS or (tag == "header" and not inside):
        return FIXED
    if attrs:
        if attrs.get("role", "").lower() in DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
            return FIXED
        if tag not in ("html", "body", "article", "main"):
            names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
            if any(says_no_article(n) or (n == "header" and not inside) for n in names):
                return NAMED
    return NAMED if tag == "form" else 0


def digest(*parts: object) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Page:
    """The tree of a page's elements and its blocks: (node, text), in page order."""

    def __init__(self, source: str | None):
        self.root = Node("#root", None, 0, 0, False)
        self.nodes = [self.root]
        self.blocks: list[tuple[Node, str]] = []
        self._stack = [self.root]
        self._parts: list[str] = []
        for m in TOKEN.finditer(source or ""):
            kind = m.lastgroup
            if kind == "text":
                self._parts.append(m[0])
            elif m["raw"] or m[0].startswith("<!--"):
                continue
            elif m["tag"] or m["tag2"]:
                tag = (m["tag"] or m["tag2"]).lower()
                if m["end"] or m["end2"]:
                    self._close(tag)
                else:
                    self._open(tag, m["attrs"] if m["tag"] else m["attrs2"])
        self._flush()
        for n in self.nodes:
            if n.tag in HEADINGS and HEADING_WORDS.sub(" ", " ".join(n.texts).lower()).strip() in DROPPED_HEADINGS:
                self._drop_section(n)
        self._resolve()

    def _flush(self) -> None:
        if self._parts:
            text = "".join(self._parts)
            self._parts = []
            text = SPACES.sub(" ", html.unescape(text) if "&" in text else text).strip()
            if text:
                owner = next((n for n in reversed(self._stack) if n.tag in BLOCKS or n.mark), self.root)
                owner.texts.append(text)
                self.blocks.append((owner, text))

    def _open(self, tag: str, source: str) -> None:
        if tag == "br":
            self._parts.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            closes = CLOSED_BY_SAME.get(tag)
            for k in range(len(self._stack) - 1, 0, -1):
                t = self._stack[k].tag
                if t == "p" or (closes and t in closes):
                    del self._stack[k:]
                    break
                if t in BLOCKS:
                    break
        if tag in VOID:
            return
        top = self._stack[-1]
        attrs = attributes(source) if source.strip() else {}
        mark = mark_of(tag, attrs, top.inside)
        path = digest(top.path, tag, *attrs.get("class", "").split()) if tag in BLOCKS else top.path
        if mark and tag not in BLOCKS:  # its text is told apart from what is around it
            self._flush()
        node = Node(tag, top, path, mark, top.inside or tag in ("article", "main"))
        top.children.append(node)
        self.nodes.append(node)
        self._stack.append(node)

    def _close(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].tag == tag:
                if tag in BLOCKS or any(n.mark for n in self._stack[k:]):
                    self._flush()
                del self._stack[k:]
                return
            if self._stack[k].tag in ("td", "th", "table", "article", "main", "body") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "article", "main", "body", "html"):
                return
        if tag in BLOCKS:
            self._flush()

    def _drop_section(self, heading: Node) -> None:
        """What a heading like `Comments` begins: its section if it comes first there, else what follows it beside it up to the next heading of its rank."""
        around = heading.parent
        if around.tag not in ("#root", "html", "body", "main", "article") and not around.texts and around.children[0] is heading:
            around.mark = around.mark or NAMED
            return
        follows = False
        for n in around.children:
            if n is heading:
                follows = True
            elif follows and n.tag in HEADINGS and n.tag <= heading.tag:
                return
            if follows:
                n.mark = FIXED

    def _resolve(self) -> None:
        """What is dropped: what is marked, but for a named element that holds nearly all of the page's text and leaves no article outside."""
        fixed = set()
        for n in self.nodes:  # parents come first
            if n.mark == FIXED or (n.parent and id(n.parent) in fixed):
                fixed.add(id(n))
        under: dict[int, int] = {}  # of text in article and main elements
        for n in reversed(self.nodes):
            if id(n) not in fixed:
                own = sum(map(len, n.texts))
                n.chars += own
                under[id(n)] = under.get(id(n), 0) + (own if n.inside else 0)
                if n.parent:
                    n.parent.chars += n.chars
                    under[id(n.parent)] = under.get(id(n.parent), 0) + under[id(n)]
        total, named = self.root.chars, under[id(self.root)]
        for n in self.nodes:
            spared = n.mark == NAMED and 10 * n.chars >= 9 * total and under.get(id(n), 0) >= named
            n.dropped = n.mark == FIXED or (n.mark == NAMED and not spared) or bool(n.parent and n.parent.dropped)

    def inside_of(self, roots: list[Node]) -> set[int]:
        """The nodes under any of roots."""
        found = set(map(id, roots))
        for n in self.nodes:
            if n.parent and id(n.parent) in found:
                found.add(id(n))
        return found


def kids(n) -> list:
    """The blocks among a node's or slot's children."""
    return [c for c in n.children if c.tag in BLOCKS]


#: Cells held at once of the table that the children of two nodes are matched by; what a larger table is needed for again is computed again.
MOST_CELLS = 40_000


def next_row(above: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The most nodes of the first children with one more on the left: weights has what it makes with each on the right, 0 where tags differ."""
    row = above.copy()
    np.maximum(above[1:], above[:-1] + weights, out=row[1:])
    return np.maximum.accumulate(row, out=row)


def in_order(left: list[int], right: list[int], weight) -> tuple[int, list[tuple[int, int]]]:
    """The most that pairs in order weigh, and the pairs, last first; left, right: kinds of children, weight(x, y) of two kinds.

    First children of one kind are a pair of every best choice that takes the first ones it can. Of the rest
    rows of the table are kept at distances, and those between are computed again as the pairs are read off it.
    """
    begin = 0
    while begin < min(len(left), len(right)) and left[begin] == right[begin]:
        begin += 1
    same = [(k, k) for k in reversed(range(begin))]
    total = sum(weight(x, x) for x in left[:begin])
    left, right = left[begin:], right[begin:]
    if not left or not right:
        return total, same
    kinds = {y: k for k, y in enumerate(dict.fromkeys(right))}
    place = np.fromiter(map(kinds.__getitem__, right), np.int64, len(right))
    of: dict[int, np.ndarray] = {}

    def weights(x: int) -> np.ndarray:
        if x not in of:
            of[x] = np.array([weight(x, y) for y in kinds], np.int64)  # no generator, whose frames are C's: trees may be deep
        return of[x][place]

    step = max(math.isqrt(len(left)) + 1, MOST_CELLS // (len(right) + 1))
    row = np.zeros(len(right) + 1, np.int64)
    kept = [row]
    for i, x in enumerate(left, 1):
        row = next_row(row, weights(x))
        if i % step == 0:
            kept.append(row)
    total += int(row[-1])
    pairs, i, j = [], len(left), len(right)
    while i and j:
        first = (i - 1) // step * step
        rows = [kept[first // step][: j + 1]]
        for x in left[first:i]:
            rows.append(next_row(rows[-1], weights(x)[:j]))
        while i > first and j:
            here = rows[i - first]
            if here[j] == rows[i - first - 1][j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j = int(np.searchsorted(here[: j + 1], here[j]))  # rows ascend
            else:
                i, j = i - 1, j - 1
                pairs.append((begin + i, begin + j))
    return total, pairs + same


def matching(a, b, depth: int) -> list[tuple]:
    """The aligned nodes of two trees by simple tree matching of elements that are blocks: the most nodes in order, with equal tags and matched parents.

    Nodes with equal tags and children of the same kinds are of one kind; two kinds are matched once. Every pair of
    lists is matched exactly, whatever its length.
    """
    if a.tag != b.tag:
        return []
    numbers: dict[tuple, int] = {}
    shapes: list[tuple[str, tuple[int, ...], int]] = []
    kind: dict[int, int] = {}

    def name(top) -> None:
        order = [top]
        for x in order:
            order += kids(x)
        for x in reversed(order):  # children come before parents
            key = (x.tag, tuple(kind[id(c)] for c in kids(x)))
            if key not in numbers:
                numbers[key] = len(shapes)
                shapes.append((*key, 1 + sum(shapes[c][2] for c in key[1])))
            kind[id(x)] = numbers[key]

    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def size(x: int, y: int) -> int:
        if x == y:
            return shapes[x][2]
        if shapes[x][0] != shapes[y][0]:
            return 0
        if (x, y) not in memo:
            most, pairs = in_order(shapes[x][1], shapes[y][1], size)
            memo[x, y] = 1 + most, pairs
        return memo[x, y][0]

    name(a)
    name(b)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 4 * depth + 2000))
    try:
        size(kind[id(a)], kind[id(b)])
    finally:
        sys.setrecursionlimit(limit)
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        xs, ys = kids(x), kids(y)
        pair = kind[id(x)], kind[id(y)]
        todo += zip(xs, ys, strict=True) if pair[0] == pair[1] else [(xs[i], ys[j]) for i, j in memo[pair][1]]
    return out


class Slot:
    """A node of a page's skeleton: what alignment needs to know of it."""

    __slots__ = ("chars", "children", "dropped", "inside", "level", "loose", "parent", "path", "place", "said", "tag")

    def __init__(self, place: int, tag: str, parent: Slot | None, path: int, flags: int):
        """said: digests of its texts, chars: their characters; loose: characters of text below that no slot holds."""
        self.place, self.tag, self.parent, self.path, self.inside, self.dropped = place, tag, parent, path, bool(flags & 1), bool(flags & 2)
        self.children: list[Slot] = []
        self.level, self.said, self.chars, self.loose = 0 if parent is None else parent.level + 1, (), 0, 0
        if parent:
            parent.children.append(self)


#: Tags by the numbers that skeletons have of them.
TAGS = ("#root", *sorted(BLOCKS))
_TAG_NUMBER = {t: k for k, t in enumerate(TAGS)}
_SKELETON = {"parents": ("array<int>", pa.list_(pa.int32())), "tags": ("array<int>", pa.list_(pa.int32())), "paths": ("array<bigint>", pa.list_(pa.int64())), "flags": ("array<int>", pa.list_(pa.int32())), "chars": ("array<int>", pa.list_(pa.int32())), "loose": ("array<int>", pa.list_(pa.int32())), "n_said": ("array<int>", pa.list_(pa.int32())), "said": ("array<bigint>", pa.list_(pa.int64()))}


def skeleton(page: Page) -> list[list[int]]:
    """The page's blocks that stand under blocks only, parents first: the columns of _SKELETON."""
    place, columns = {}, [[] for _ in _SKELETON]
    of: dict[int, int] = {}
    parents, tags, paths, flags, chars, loose, n_said, said = columns
    for n in page.nodes:
        up = -1 if n.parent is None else of[id(n.parent)]
        if n.parent is None or (n.tag in BLOCKS and id(n.parent) in place):
            of[id(n)] = place[id(n)] = len(tags)
            parents.append(up)
            tags.append(_TAG_NUMBER[n.tag])
            paths.append(n.path)
            flags.append(n.inside + 2 * n.dropped)
            chars.append(sum(map(len, n.texts)))
            loose.append(0)
            n_said.append(len(n.texts))
            said += [digest(t) for t in n.texts]
        else:
            of[id(n)] = up
            loose[up] += sum(map(len, n.texts))
    return columns


def slots_of(columns: list[list[int]]) -> list[Slot]:
    parents, tags, paths, flags, chars, loose, n_said, said = columns
    out: list[Slot] = []
    at = 0
    for k, (up, tag, path, flag) in enumerate(zip(parents, tags, paths, flags, strict=True)):
        x = Slot(k, TAGS[tag], out[up] if up >= 0 else None, path, flag)
        x.said, x.chars, x.loose = tuple(said[at : at + n_said[k]]), chars[k], loose[k]
        at += n_said[k]
        out.append(x)
    return out


def compared(reference: list[Slot], page: list[Slot]) -> list[tuple[int, int, int]]:
    """(place among the reference's slots, whether the texts are equal, characters that differ) of the slots that are aligned with page; text of others counts for the nearest slot above that is aligned. Empty for copies but for a few words."""
    of = {y.place: x for x, y in matching(reference[0], page[0], max(x.level for x in page))}
    seen: dict[int, list[int]] = {}
    varying = 0
    for y in page:
        x, up = of.get(y.place), y
        same = x is not None and bool(y.said) and x.said == y.said
        differs = y.loose + (0 if same else y.chars)
        if not same and not differs:
            continue
        while x is None:
            up = up.parent
            x = of.get(up.place)
        got = seen.setdefault(x.place, [0, 0])
        got[0] |= same
        got[1] += 0 if y.dropped else differs
        varying += differs
    if 20 * varying < sum(y.chars + y.loose for y in page):
        return []
    return [(k, int(s), c) for k, (s, c) in seen.items()]


def induce(reference: list[Slot], others: int, counts: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """(template, roots) of a host from what its other pages say of the reference's slots (place, pages with equal text, characters that differ).

    template: digests of path and text of blocks that are the same on most pages, inside of article and main on nearly
    all; roots: paths of what holds nearly all that varies, deepest first.
    """
    template: set[int] = set()
    weight = [0] * len(reference)
    for k, same, chars in counts:
        x = reference[k]
        if same >= (4 if x.inside else 2) and 10 * same >= (9 if x.inside else 6) * others:
            template |= {digest(x.path, t) for t in x.said}
        if not x.dropped:
            while x is not None:
                weight[x.place] += chars
                x = x.parent
    roots = [x for x in reference if x.tag in ROOTS and weight[0] and 20 * weight[x.place] >= 19 * weight[0]]
    return sorted(template), list(dict.fromkeys(x.path for x in reversed(roots)))


def article_of(page: Page, kept: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """What of kept is in the page's article or main element; of several articles the largest and those half as large; all if there is none."""

    def under(tag: str) -> list[tuple[Node, str]]:
        found = [n for n in page.nodes if n.tag == tag and not n.dropped]
        outer = page.inside_of(found)
        found = [n for n in found if not (n.parent and id(n.parent) in outer)]
        of = {}
        for n in page.nodes:
            if n.parent and id(n.parent) in of:
                of[id(n)] = of[id(n.parent)]
            elif n in found:
                of[id(n)] = id(n)
        sizes: Counter[int] = Counter()
        for n, t in kept:
            if id(n) in of:
                sizes[of[id(n)]] += len(t)
        most = max(sizes.values(), default=0)
        return [(n, t) for n, t in kept if id(n) in of and 2 * sizes[of[id(n)]] >= most]

    chars = lambda blocks: sum(len(t) for _, t in blocks)
    article, main = under("article"), under("main")
    if article and (not main or 2 * chars(article) >= chars(main)):
        return article
    return main or kept


def main_text(page: Page, template: frozenset[int], roots: list[int]) -> str:
    kept = [(n, t) for n, t in page.blocks if not n.dropped and (not template or digest(n.path, digest(t)) not in template)]
    article = article_of(page, kept)
    for path in roots:
        found = page.inside_of([n for n in page.nodes if n.path == path and n.tag in BLOCKS])
        under = [(n, t) for n, t in kept if id(n) in found]
        if under:
            # An article or main element is evidence; where the host's varying text is elsewhere by far, that decides.
            if len(article) == len(kept) or 4 * sum(len(t) for _, t in article) < sum(len(t) for _, t in under):
                article = under
            break
    return "\n".join(t for _, t in article)


def host_of(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))


def trees(pages: DataFrame, *, url_col: str, html_col: str) -> DataFrame:
    """(host, digest, size, skeleton's columns) of the pages: what alignment moves, instead of their html."""
    rows = pages.where(F.col(html_col).isNotNull()).select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("digest"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, 2, rows=ROWS, chars=CHARS):
            made = [skeleton(Page(x)) for x in texts]
            columns = [pa.array([m[k] for m in made], kind) for k, (_, kind) in enumerate(_SKELETON.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(m[0]) for m in made], pa.int64()), *columns], names=["host", "digest", "size", *_SKELETON])

    return rows.mapInArrow(run, ", ".join(["host string, digest bigint, size bigint", *(f"{n} {kind}" for n, (kind, _) in _SKELETON.items())]))


def wrappers(pages: DataFrame, *, url_col: str, html_col: str) -> DataFrame:
    """(host, template, roots) of each host with three distinct pages or more.

    A host's reference is the page whose number of blocks is nearest to the median. Every other page is aligned with it;
    what is counted by host and slot are partial sums, copies of a page count once.
    """
    rows = written(trees(pages, url_col=url_col, html_col=html_col))
    sizes = written(rows.select("host", "digest", "size").distinct())
    middle = sizes.groupBy("host").agg(F.percentile_approx("size", 0.5).alias("middle"), F.count(F.lit(1)).alias("n")).where("n > 2")
    nearest = sizes.join(middle.hint("merge"), "host").groupBy("host").agg(F.min(F.struct(F.abs(F.col("size") - F.col("middle")), "digest"))["digest"].alias("digest"))
    nearest = written(nearest)
    own = F.struct(*_SKELETON).alias("own")
    references = written(rows.join(nearest, ["host", "digest"], "left_semi").groupBy("host", "digest").agg(F.any_value(own).alias("own")).select("host", F.col("digest").alias("own_digest"), "own"))

    def columns_of(x: pa.StructScalar) -> list[list[int]]:
        return list(x.as_py().values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("place", pa.int32()), ("same", pa.int32()), ("chars", pa.int64())]))
        last, reference = None, []
        for batch in batches:
            found = []
            for digest_, of, own in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                if (key := (digest_.as_py())) != last:  # rows of a host mostly follow one another
                    last, reference = key, slots_of(columns_of(own))
                found.append([{"place": p, "same": s, "chars": c} for p, s, c in compared(reference, slots_of(columns_of(of)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["host", "digest", "found"])

    others = rows.select("host", "digest", F.struct(*_SKELETON).alias("page")).join(references.hint("merge"), "host").where(F.col("digest") != F.col("own_digest"))
    said = others.select("host", "digest", "own_digest", "page", "own").mapInArrow(run, "host string, digest bigint, found array<struct<place: int, same: int, chars: bigint>>")
    said = written(said.where(F.size("found") > 0).groupBy("host", "digest").agg(F.any_value("found").alias("found")))
    forgotten(rows, sizes, nearest)
    n_others = said.groupBy("host").agg(F.count(F.lit(1)).alias("others"))
    counts = said.select("host", F.explode("found").alias("x")).groupBy("host", "x.place").agg(F.sum("x.same").alias("same"), F.sum("x.chars").alias("chars"))
    # As many as the reference has slots.
    counts = counts.groupBy("host").agg(F.collect_list(F.struct("place", "same", "chars")).alias("counts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [induce(slots_of(columns_of(r)), n.as_py(), [(x["place"], x["same"], x["chars"]) for x in c.as_py()]) for r, n, c in zip(batch.column(1), batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int64()))], names=["host", "template", "roots"])

    out = written(references.join(n_others, "host").join(counts, "host").select("host", "own", "others", "counts").mapInArrow(finish, "host string, template array<bigint>, roots array<bigint>"))
    forgotten(references, said)
    return out


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id_col, url_col, text, n_chars."""
    found = wrappers(pages, url_col=url_col, html_col=html_col).withColumnRenamed("host", "host_of_wrapper")
    host = free_name(pages.select(id_col, url_col, html_col), "host")
    joined = pages.select(id_col, url_col, html_col, host_of(F.col(url_col)).alias(host)).join(found, F.col(host) == F.col("host_of_wrapper"), "left")
    joined = joined.select(id_col, url_col, html_col, "template", "roots")
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, given in portions(batches, 2, rows=ROWS, chars=CHARS):
            texts = [main_text(Page(h), frozenset(t.as_py() or ()), r.as_py() or []) for h, t, r in zip(given, batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
