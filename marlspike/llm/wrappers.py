"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of one host.

A page's tag stream is folded into a skeleton: elements with a label (tag, class, id, role), text as
slots. Skeletons of one host are aligned, level by level: where the streams mismatch, a repetition of
what stands before becomes a repeated group, an element that one side lacks becomes optional, and text
that differs becomes a slot: text that all pages have stays constant, and is the host's template. Folding is done within each task first and the distinct results of a host meet after,
so a host with a third of all pages sends a few small wrappers. Each wrapper element then gets a role,
once for the host, and every page is read whole through its host's wrapper.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_of, sliced, table, written

#: Elements that hold no text of their own block; all unknown elements are blocks' insides too.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, or never text of the page.
OPAQUE = frozenset("script style title textarea noscript template svg iframe object select canvas audio video math".split())
CLOSED_BY_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ()}
#: Roles: elements and names (words of class, id or role) of what surrounds an article.
AROUND_TAGS = frozenset("head nav footer aside form button dialog menu fieldset".split())
AROUND_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav widget widgets footer masthead topbar toolbar share sharing "
    "social related recommended recommendations comment comments commentlist respond disqus replies login signin signup register search pagination pager contentinfo complementary aside copyright disclaimer toast dialog form survey paywall".split()
)
ARTICLE_NAMES = frozenset("article articlebody post postbody entry story".split())
MAIN_NAMES = frozenset("main content maincontent".split())
#: Elements that are menus where they hold nothing but links.
CONTAINERS = frozenset("div section ul ol dl table".split())
#: Levels and neighbours of a wrapper; pages are read at any depth.
DEPTH, WIDE = 60, 200

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HUMP, DIGITS, WORD = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"\d+"), re.compile(r"[a-z]+")
BLANK = re.compile(r"[^\s]")


def label(tag: str, attributes: str) -> str:
    """The tag with its class, id and role names in lower case, words in one name set apart by hyphens, digits left out."""
    if not attributes or "=" not in attributes:
        return tag
    names = {x for m in NAMES.finditer(attributes) for x in DIGITS.sub("", HUMP.sub("-", m[2] or m[3] or m[4] or "").lower()).split()}
    return " ".join([tag, *sorted(names)])


def events(page: str):
    """(1, label) opens a block element, (-1, None) closes one, (2, text) is text (of a link: 3), (0, None) is white space or a break."""
    at, stack, link, end = 0, [], False, len(page)
    opened: Counter = Counter()  # of the stack
    while at < end:
        m = TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at:
            yield 3 if link else 2, page[at:start]
        if not m:
            return
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                link = link and tag != "a"
            elif opened[tag]:
                while True:
                    top = stack.pop()
                    opened[top] -= 1
                    yield -1, None
                    if top == tag:
                        break
                link = False
            elif tag == "p":  # a stray end still ends a block
                yield 1, "p"
                yield -1, None
            continue
        if tag in OPAQUE:
            if not m[3].endswith("/") or tag in ("script", "style", "title", "textarea"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in INLINE:
            if tag == "br":
                yield 0, None
            elif tag == "a":
                link = True
            continue
        if tag == "hr":
            yield 1, "hr"
            yield -1, None
            continue
        if tag in VOID:
            continue
        link = False
        if tag == "body" and opened["head"]:
            while True:
                top = stack.pop()
                opened[top] -= 1
                yield -1, None
                if top == "head":
                    break
        if opened["p"]:
            while True:
                top = stack.pop()
                opened[top] -= 1
                yield -1, None
                if top == "p":
                    break
        if tag in CLOSED_BY_SELF and any(opened[x] for x in (tag, "dt", "dd", "td", "th")):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in CLOSED_BY_SELF[tag]:
                    break
                if stack[i] == tag or (tag in ("dt", "dd") and stack[i] in ("dt", "dd")) or (tag in ("td", "th") and stack[i] in ("td", "th")) or (tag == "tr" and stack[i] in ("td", "th")):
                    while len(stack) > i:
                        opened[stack.pop()] -= 1
                        yield -1, None
        stack.append(tag)
        opened[tag] += 1
        yield 1, label(tag, m[3])


# A wrapper element is [label, multiplicity, plain, children, text]: multiplicity "1", "?", "+" or "*"; plain
# is whether it holds text that is no link's; text is a checksum of all text in it, 0 for none, SLOT if pages
# differ. A group of elements that repeat together is labelled "()". A root has the number of its pages as well.
SLOT = -1
#: Pages of a host from which on its constant text is its template.
PAGES = 5


def _times(a: str, b: str) -> str:
    return {(False, False): "1", (True, False): "?", (False, True): "+", (True, True): "*"}[a in "?*" or b in "?*", a in "+*" or b in "+*"]


def align(a: list, b: list) -> list:
    """The wrapper of both of two elements with the same label."""
    return [a[0], _times(a[1], b[1]), a[2] or b[2], aligned(a[3], b[3]), a[4] if a[4] == b[4] else SLOT, *([a[5] + b[5]] if len(a) > 5 else [])]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Aligns two sequences: what both have in order stays, the rest becomes optional, repetitions become groups."""
    if a == b:
        return a
    head = 0
    while head < min(len(a), len(b)) and a[head][0] == b[head][0] != "()":
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail][0] == b[-1 - tail][0] != "()":
        tail += 1
    out = [align(x, y) for x, y in zip(a[:head], b[:head])]
    p, q = a[head : len(a) - tail], b[head : len(b) - tail]
    same = lambda x, y: x[0] == y[0] and (x[0] != "()" or [c[0] for c in x[3]] == [c[0] for c in y[3]])
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        for j in range(len(q) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if same(p[i], q[j]) else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(p) or j < len(q):
        if i < len(p) and j < len(q) and same(p[i], q[j]):
            out.append(align(p[i], q[j]))
            i, j = i + 1, j + 1
        elif j == len(q) or (i < len(p) and best[i + 1][j] >= best[i][j + 1]):
            out.append([p[i][0], _times(p[i][1], "?"), *p[i][2:]])
            i += 1
        else:
            out.append([q[j][0], _times(q[j][1], "?"), *q[j][2:]])
            j += 1
    out += [align(x, y) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :])] if tail else []
    return repeated(out)


def repeated(items: list[list]) -> list[list]:
    """Resolves neighbours that repeat, alone or in groups of two or three, into repeated elements and groups."""
    for size in (1, 2, 3):
        out: list[list] = []
        for x in items:
            out.append(x)
            if size == 1 and len(out) > 1 and out[-2][0] == x[0] != "()":
                last = out.pop()
                out[-1] = align(out[-1], last)
                out[-1][1] = _times(out[-1][1], "+")
            elif size > 1 and len(out) >= size:
                tail = out[-size:]
                names = [y[0] for y in tail]
                before = out[-size - 1] if len(out) > size else None
                if before is not None and before[0] == "()" and [y[0] for y in before[3]] == names:
                    del out[-size:]
                    out[-1] = ["()", "+", before[2] or any(y[2] for y in tail), [align(c, d) for c, d in zip(before[3], tail)], SLOT]
                elif len(out) >= 2 * size and [y[0] for y in out[-2 * size : -size]] == names and len(set(names)) > 1 and "()" not in names:
                    first = out[-2 * size : -size]
                    del out[-2 * size :]
                    out.append(["()", "+", any(y[2] for y in first + tail), [align(c, d) for c, d in zip(first, tail)], SLOT])
        items = out
    if len(items) > WIDE:  # no order is left to find: one repeated element for each label
        one: dict[str, list] = {}
        for x in items:
            for y in x[3] if x[0] == "()" else [x]:
                one[y[0]] = align(one[y[0]], y) if y[0] in one else list(y)
                one[y[0]][1] = "*"
        items = list(one.values())
    return items


def skeleton(page: str) -> list:
    """A page as a wrapper of itself."""
    root = ["", "1", False, [], 0, 1]
    stack = [root]
    for kind, x in events(page):
        if kind == 1:
            node = [x, "1", False, [], 0]
            if len(stack) <= DEPTH:  # deeper elements only say whether there is text
                stack[-1][3].append(node)
            stack.append(node)
        elif kind == -1:
            node = stack.pop()
            node[3] = repeated(node[3])
            stack[-1][2] = stack[-1][2] or node[2]
            stack[-1][4] = zlib.crc32(b"%d" % node[4], stack[-1][4]) if node[4] else stack[-1][4]
        elif kind >= 2 and BLANK.search(x):
            stack[-1][2] = stack[-1][2] or kind == 2
            stack[-1][4] = zlib.crc32(" ".join(x.split()).encode("utf-8", "replace"), stack[-1][4]) or 1
    while stack:
        node = stack.pop()
        node[3] = repeated(node[3])
        if stack:
            stack[-1][2] = stack[-1][2] or node[2]
            stack[-1][4] = zlib.crc32(b"%d" % node[4], stack[-1][4]) if node[4] else stack[-1][4]
    return root


def packed(wrapper: list) -> str:
    return json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))


def folding(batches):
    """(host, wrapper, pages) of each host in this task's pages; the wrapper does not count them, so that equal ones are one."""
    found: dict[str | None, list] = {}
    seen: set = set()
    for batch in sliced(batches, "html"):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = skeleton(page or "")
            key = (host, packed(own))
            if key not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
                found[host] = align(found[host], own) if host in found else own
    if found:
        pages = [w[5] for w in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([packed([*w[:5], 0]) for w in found.values()], pa.string()), pa.array(pages, pa.int64())], names=["host", "wrapper", "pages"])


def meeting(rows: pa.Table) -> pa.Table:
    """One wrapper for all of a host's, with the number of their pages."""
    out = None
    for w in sorted(rows.column("wrapper").to_pylist()):
        out = json.loads(w) if out is None else align(out, json.loads(w))
    out[5] = pc.sum(rows.column("pages")).as_py()
    return pa.table({"host": rows.column("host").slice(0, 1).cast(pa.string()), "wrapper": pa.array([packed(out)], pa.string()), "pages": pa.array([out[5]], pa.int64())})


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper) over all pages; a URL without a host has the host ""."""
    rows = pages.select(host_of(url).alias("host"), F.col(html).cast("string").alias("html"))
    kind = "host string, wrapper string, pages long"
    part = rows.mapInArrow(folding, kind).groupBy("host", "wrapper").agg(F.sum("pages").alias("pages"))
    # two steps, so that a host that every task has does not send all its parts to one group
    near = part.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(32)))
    half = near.groupBy("host", "salt").applyInArrow(meeting, kind)
    return half.groupBy("host").applyInArrow(meeting, kind).select("host", "wrapper")


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


class Roles:
    """A wrapper with the role of each element: children by label, whether it stands around the article, and how near to one it is
    (3 within an article, 2 within main, 1 within content, 0 else).

    With template, all pages of the host have the element, with the same text, in one whose text differs: it stands around the
    article unless its name says it is one. So does a container whose text is that of links alone on each of PAGES pages and
    more. Elsewhere names decide."""

    __slots__ = ("children", "around", "level")

    def __init__(self, node: list | None, parent: "Roles | None" = None, template: bool = False, fixed: bool = False, many: bool = False):
        name = node[0] if node else ""
        tag, *names = name.split(" ")
        level = parent.level if parent else 0
        around = parent is not None and parent.around
        if not around and parent is not None:
            inner = tag not in ("html", "body", "main")
            named, article, main = False, False, False
            for x in names:
                words = set(WORD.findall(x))
                if words & {"with", "has", "no", "without"}:  # says what stands elsewhere
                    continue
                if words & AROUND_NAMES or ("header" in words and level < 3):
                    named = True
                elif words & ARTICLE_NAMES:
                    article = True
                elif words & MAIN_NAMES:
                    main = True
            around = tag in AROUND_TAGS or (named and inner and not article and not main) or (tag == "header" and level < 3)
            if node and level == 0 and tag in ("ul", "ol") and not node[2]:  # only links, on all pages of the host
                around = True
            if many and tag in CONTAINERS and level < 3 and not article and not main and node[4] and not node[2]:
                around = True
            if template and inner and not article and not main and tag != "article":
                around = True
            if tag == "article" or (article and tag in ("div", "section")):
                level = 3
            elif tag == "main" or (main and tag in ("div", "section", "td")):
                level = max(level, 2 if tag == "main" or "main" in names else 1)
        self.around, self.level = around, level
        self.children: dict[str, Roles] = {}
        if parent is None:
            fixed = many = bool(node) and node[5] >= PAGES
        each = [(y, x[1] in "1+" and y[1] in "1+") for x in (node[3] if node else ()) for y in (x[3] if x[0] == "()" else [x])]
        # elements of one label cannot be told apart in a page: all are constant or none
        moving = {y[0] for y, always in each if not always or y[4] in (SLOT, 0)}
        differs = fixed and node[4] == SLOT
        for y, always in each:
            if y[0] not in self.children:
                self.children[y[0]] = Roles(y, self, differs and y[0] not in moving, fixed and always, many)


def main_text(page: str, roles: Roles) -> str:
    """The blocks of the page's article, in order: character references decoded, white space made one blank, joined by blank lines."""
    stack, level = [roles], 0
    blocks: list[tuple[int, str]] = []
    text: list[str] = []

    def ended():
        if text:
            x = " ".join(html_lib.unescape("".join(text)).split())
            if x:
                blocks.append((stack[-1].level, x))
            text.clear()

    for kind, x in events(page):
        if kind >= 2:
            if not stack[-1].around:
                text.append(x)
        elif kind == 0:
            text.append(" ")
        elif kind == 1:
            ended()
            top = stack[-1]
            stack.append(top.children.get(x) or Roles([x, "1", True, []], top))
        else:
            ended()
            stack.pop()
    ended()
    level = max((b[0] for b in blocks), default=0)
    return "\n\n".join(b[1] for b in blocks if b[0] == level)


def extracting(batches):
    """Replaces the last two columns, html and wrapper, by text."""
    known: dict[str | None, Roles] = {}
    for batch in sliced(batches, "_html"):
        k = batch.num_columns - 2
        out = []
        for page, w in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()):
            if w not in known:
                if len(known) > 2000:
                    known.clear()
                known[w] = Roles(json.loads(w) if w else None)
            out.append(main_text(page or "", known[w]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(out, pa.string())], names=[*batch.schema.names[:k], "text"])


def extracted(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages without the html, as a struct _row, and the main text of each.

    The text is that of the innermost kind of container the page has (article, main, content, body) less
    what stands around it. A null or empty page has an empty text; pages of no host are one host's.
    """
    known = written(wrappers(pages, url, html), "wrappers")
    rows = pages.select(row_of(pages, html), F.col(html).cast("string").alias("_html"), host_of(url).alias("host"))
    both = rows.join(known, "host", "left").select("_row", "_html", "wrapper")
    return both.mapInArrow(extracting, both.select("_row").schema.add("text", "string"))


def op7_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("_row.page_id", "_row.url", "text", F.length("text").cast("long").alias("n_chars"))
