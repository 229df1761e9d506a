"""HTML extraction by wrapper induction: same-host pages are aligned, what they share is template.

1. Each host has up to three reference pages, those of least and greatest page_id and of the least hash of it.
   They are found in one aggregation over page_id and url alone; the texts of the references are read by
   a second, narrow join.
2. Every page is parsed once, next to its host's references, and aligned with each by simple tree matching:
   children lists are matched in order for the greatest number of equal-labelled nodes. Aligned nodes with
   equal text in most references that have them are template; nodes whose text differs are slots.
3. Going down from the body, template nodes are dropped, and so are elements that are not the article by
   their kind: menus, headers, footers, sidebars, notices, adverts, forms, comments, hidden parts. Comments and
   adverts differ from page to page, so their names decide, if a name says nothing else besides. The text is
   sought in article and main elements if there are any, but for those that are template or mostly links
   while the page differs from the references elsewhere. The alignment decides inside them too: blocks that
   recur with equal text, and link lists that stand at the same place of every reference, go. Paragraphs of an
   article or main element, and those beside a paragraph that differs, stay, so that sentences which an article
   shares with another page of the host are kept. A reference with the very same article says nothing there.
4. Blocks are written in page order with single spaces inside and an empty line between.

Pages of a host without other pages, and pages equal to their references, are judged by kind alone.

Nulls: null or empty html gives an empty text; a null url is a host of its own (empty); rows with a null page_id
are extracted, but are no references. Repeated page_ids keep all their rows; of a repeated reference, the least
html is taken. Pages of any length and depth are read whole. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import shared
from sensorloom.llm.dom import BLOCK, RAW, Node, parse
from sensorloom.llm.url_filter import host_and_path

#: References are broadcast up to this many bytes in all; beyond it they are joined by host.
BROADCAST_BYTES = 32 << 20
#: Parsed references that a task keeps.
KEPT_TREES = 256
NEVER = RAW | frozenset("nav aside footer form button select input option dialog menu svg canvas object embed audio video map head search link meta".split())
#: Words of a class, id or role that mark what is not the article.
OTHER = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidebars aside widget widgets related recommended recommendations trending popular comment comments commentlist commentary respond replies disqus discussion menu menus nav navbar navi navigation breadcrumb breadcrumbs pagination pager "
    "share sharing social footer foot masthead toolbar login search skip skiplink copyright complementary contentinfo form forms hidden topbar header".split()
)
#: Words beside those in a name that say where or what kind of box it is; any other word makes it another name.
PLAIN = frozenset(
    "area article articles bar block body bottom box btn button cell center col column container content div el element entry first fixed global group holder inner item items js last layer layout left link links list lists main mod module "
    "new news outer page panel placeholder post posts primary reader readers region right row secondary section segment site slot small space strip sub tab the thread title top unit user users view web wrap wrapper x z".split()
)
#: Names that a part of an article may carry too: paragraphs and headings may have them.
WEAK = frozenset("discussion form forms header hidden login menu menus notice notices popular promo promotion promotions related respond search share sharing social subscription trending".split())
ARTICLE = frozenset("articlebody articletext articlecontent postcontent postbody entrycontent maincontent storybody".split())
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def names_of(node: Node) -> tuple[set[str], dict[str, str]]:
    """All words of an element's class, id and role, and its attributes."""
    values = node.attribute_values()
    raw = " ".join(values.get(k, "") for k in ("class", "id", "role"))
    return {w.lower() for w in WORD.findall(raw)} if raw.strip() else set(), values


def other_names(values: dict[str, str]) -> set[str]:
    """Words that mark what is not the article, of names without any word that says something else."""
    out: set[str] = set()
    for name in " ".join(values.get(k, "") for k in ("class", "id", "role")).split():
        words = {w.lower() for w in WORD.findall(name)}
        if words & OTHER and all(w in OTHER or w in PLAIN or w.isdigit() or len(w) == 1 for w in words):
            out |= words & OTHER
    return out


def holds_title(node: Node) -> bool:
    return node.holds("h1") or node.holds("h2")


def is_other(node: Node, inside: bool) -> bool:
    """Whether an element is not part of the article by its kind; ``inside``: below an article or main element."""
    if (known := node.kept.get(inside)) is None:
        known = node.kept[inside] = _is_other(node, inside)
    return known


def _is_other(node: Node, inside: bool) -> bool:
    if node.tag in NEVER:
        return True
    if node.tag == "header":
        return not (inside and holds_title(node))
    if not node.attributes:
        return False
    values = node.attribute_values()
    if "hidden" in values or values.get("aria-hidden") == "true" or HIDDEN.search(values.get("style", "")):
        return True
    found = other_names(values)
    if node.tag in ("html", "body", "main", "article"):
        # A comment may be an article element of its own; a page's body may carry any class.
        return node.tag == "article" and bool(found & {"comment", "comments", "reply", "replies", "related", "ad", "ads", "advert", "promo", "sponsored"})
    if node.tag in FLOW:
        found -= WEAK
    if found == {"header"}:
        return not (inside and holds_title(node))
    return bool(found)


def is_main(node: Node) -> bool:
    if node.tag in ("article", "main"):
        return True
    if not node.attributes:
        return False
    if (known := node.kept.get("main")) is None:
        known = node.kept["main"] = _is_main(node.attribute_values())
    return known


def _is_main(values: dict[str, str]) -> bool:
    if values.get("role") in ("main", "article") or values.get("itemprop") == "articleBody":
        return True
    return bool({re.sub("[^a-z]", "", w.lower()) for w in f"{values.get('class', '')} {values.get('id', '')}".split()} & ARTICLE)


def label(node: Node) -> str:
    return node.tag + "." + " ".join(sorted(names_of(node)[0])) if node.attributes else node.tag


class Matcher:
    """Simple tree matching of one page with one reference; paragraphs count as single nodes."""

    def __init__(self):
        self.sizes: dict[tuple[int, int], int] = {}

    def label(self, node: Node) -> str:
        if not node.attributes:
            return node.tag
        if (found := node.kept.get("label")) is None:
            found = node.kept["label"] = label(node)
        return found

    def children(self, node: Node) -> list[Node]:
        if (found := node.kept.get("children")) is None:
            found = node.kept["children"] = [] if node.tag in FLOW else [c for c in node.elements() if c.tag not in RAW]
        return found

    def table(self, a: list[Node], b: list[Node]) -> list[list[int]]:
        """Matched nodes of the first i of ``a`` and the first j of ``b``; the sizes of all their pairs are known."""
        sizes, rows, ids = self.sizes, [[0] * (len(b) + 1)], [*map(id, b)]
        for x in a:
            above, row, ix = rows[-1], [0], id(x)
            for j, y in enumerate(ids):
                row.append(max(above[j + 1], row[j], above[j] + sizes.get((ix, y), 0)))
            rows.append(row)
        return rows

    def shaped(self, root: Node) -> None:
        """For every node below: a number for the labels of its whole subtree, and how many nodes that has."""
        if "shape" in root.kept:
            return
        nodes, todo = [], [root]
        while todo:
            nodes.append(node := todo.pop())
            todo += self.children(node)
        for node in reversed(nodes):
            below = self.children(node)
            node.kept["shape"] = hash((self.label(node), *(c.kept["shape"] for c in below)))
            node.kept["count"] = 1 + sum(c.kept["count"] for c in below)

    def match(self, x: Node, y: Node) -> None:
        """Finds the sizes (matched nodes of two subtrees with the roots matched) of all pairs that ``table`` asks for.

        Equal subtrees match whole. Walks with a stack of its own: pages may be nested to any depth.
        """
        self.shaped(x), self.shaped(y)
        sizes, children, label = self.sizes, self.children, self.label
        todo: list[tuple] = [(x, y, None)]
        while todo:
            x, y, rest = todo.pop()
            if rest is not None:
                a, b, ends = rest
                sizes[id(x), id(y)] = 1 + ends + self.table(a, b)[-1][-1]
                continue
            if (id(x), id(y)) in sizes:
                continue
            if x.kept["shape"] == y.kept["shape"]:
                sizes[id(x), id(y)] = x.kept["count"]
                continue
            a, b, ends = self.trimmed(children(x), children(y))
            if not a or not b:
                sizes[id(x), id(y)] = 1 + ends
                continue
            todo.append((x, y, (a, b, ends)))
            by_label: dict[str, list[Node]] = {}
            for q in b:
                by_label.setdefault(label(q), []).append(q)
            for p in a:
                todo += [(p, q, None) for q in by_label.get(label(p), ())]

    def trimmed(self, a: list[Node], b: list[Node], out: dict[int, Node] | None = None) -> tuple[list[Node], list[Node], int]:
        """Without equal subtrees at both ends, which some best matching pairs; how many nodes these have."""
        i, j, most, size = 0, 0, min(len(a), len(b)), 0
        while i < most and a[i].kept["shape"] == b[i].kept["shape"]:
            size += a[i].kept["count"]
            i += 1
        while j < most - i and a[-1 - j].kept["shape"] == b[-1 - j].kept["shape"]:
            size += a[-1 - j].kept["count"]
            j += 1
        if out is not None:
            for x, y in [*zip(a[:i], b[:i]), *zip(a[len(a) - j :], b[len(b) - j :])]:
                self.same(x, y, out)
        return a[i : len(a) - j], b[i : len(b) - j], size

    def same(self, x: Node, y: Node, out: dict[int, Node]) -> None:
        """Partners of two equal subtrees."""
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            out[id(x)] = y
            todo += zip(self.children(x), self.children(y))

    def align(self, x: Node, y: Node, out: dict[int, Node]) -> None:
        """Partners in ``y`` of the nodes below ``x``."""
        self.match(x, y)
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            if x.kept["shape"] == y.kept["shape"]:
                self.same(x, y, out)
                continue
            out[id(x)] = y
            a, b, _ = self.trimmed(self.children(x), self.children(y), out)
            if not a or not b:
                continue
            rows, i, j = self.table(a, b), len(a), len(b)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((a[i], b[j]))


def body_of(root: Node) -> Node:
    return next((x for x in root.walk() if x.tag == "body"), root)


class Extractor:
    def __init__(self, body: Node, references: list[Node]):
        self.partners: list[dict[int, Node]] = []
        for other in references:
            if other.plain() != body.plain():
                self.partners.append({})
                Matcher().align(body, other, self.partners[-1])
        self.telling = self.partners
        self.blocks: list[str] = []
        self.inline: list[str] = []

    def constant(self, node: Node) -> bool:
        """Whether the references that have a partner of the node mostly have it with the same text: two at least, or all."""
        same = other = 0
        for partners in self.telling:
            if (y := partners.get(id(node))) is not None:
                if y.plain() == node.plain():
                    same += 1
                else:
                    other += 1
        return same > other and same >= min(2, len(self.telling))

    def end_block(self) -> None:
        if self.inline:
            if text := " ".join("".join(self.inline).split()):
                self.blocks.append(text)
            self.inline = []

    def tell(self, node: Node) -> None:
        """For an article or main element: references with an equal one do not tell template from text."""
        self.telling = [p for p in self.partners if (y := p.get(id(node))) is not None and y.plain() != node.plain()]

    def article(self, node: Node) -> None:
        self.tell(node)
        self.content(node, True, True)
        self.end_block()
        self.telling = self.partners

    def content(self, node: Node, inside: bool, slot: bool, skip: frozenset[int] = frozenset()) -> None:
        """Writes what is article below ``node``, but for ``skip``. ``slot``: constant paragraphs are content too.

        Walks with a stack of its own, on which None ends a block.
        """
        todo: list[tuple[Node | str | None, bool, bool]] = []

        def enter(node: Node, inside: bool, slot: bool) -> None:
            here = inside or is_main(node)
            slot = slot or is_main(node) or any(c.tag in FLOW and not self.constant(c) for c in node.elements())
            todo.extend((c, here, slot) for c in reversed(node.children))

        enter(node, inside, slot)
        while todo:
            child, here, slot = todo.pop()
            if child is None:
                self.end_block()
                if slot:  # behind an article
                    self.telling = self.partners
                continue
            if isinstance(child, str):
                self.inline.append(child)
                continue
            if child.tag == "br":
                self.inline.append(" ")
                continue
            block = child.tag in BLOCK
            if block:
                self.end_block()
                todo.append((None, False, False))
            if id(child) not in skip and not is_other(child, here) and (not block or (slot and child.tag in FLOW) or not self.constant(child)) and not self.menu(child, here):
                if is_main(child) and not here:
                    self.tell(child)
                    todo.append((None, False, True))
                    enter(child, True, True)
                else:
                    enter(child, here, slot and child.tag in FLOW)

    def link_list(self, node: Node) -> bool:
        """A list whose text is mostly that of links: a menu without a name."""
        if node.tag not in ("ul", "ol", "div", "table"):
            return False
        if (known := node.kept.get("links")) is None:
            known = node.kept["links"] = not any(map(node.holds, FLOW)) and self.linked(node)
        return known

    def linked(self, node: Node) -> bool:
        if not node.holds("a"):
            return False
        links = sum(len(x.plain()) for x in node.walk() if x.tag == "a")
        return links > 0 and links >= 0.6 * len(node.plain())

    def menu(self, node: Node, inside: bool) -> bool:
        """A link list; inside an article, which may list its sources, one at this place of every reference."""
        if not self.link_list(node):
            return False
        return not inside or bool(self.telling) and all((y := p.get(id(node))) is not None and self.link_list(y) for p in self.telling)

    def differs_outside(self, body: Node, tops: list[Node]) -> bool:
        """Whether a paragraph outside ``tops``, and not of another kind than article, is not template."""
        todo, skip = [body], {id(x) for x in tops}
        while todo:
            node = todo.pop()
            for c in node.elements():
                if id(c) not in skip and not is_other(c, False):
                    if c.tag in FLOW and self.partners and c.plain() and not self.linked(c) and not self.constant(c):
                        return True
                    todo.append(c)
        return False


def main_text(html: str, references: list[Node] = ()) -> str:
    """The article of a page as blocks; ``references``: bodies of other pages of the host."""
    body = body_of(parse(html))
    out = Extractor(body, list(references))
    mains = [x for x in body.walk() if is_main(x) and not is_other(x, False)]
    # The outermost article or main elements that no excluded element holds: none below these is asked.
    tops, todo, found = [], [body], set(map(id, mains))
    while todo:
        x = todo.pop()
        if id(x) in found:
            tops.append(x)
        elif not is_other(x, False):
            todo.extend(reversed(x.elements()))
    poor = [x for x in tops if out.constant(x) or out.linked(x)]
    if poor and len(poor) == len(tops) and not out.differs_outside(body, tops):
        poor = []  # nothing else on the page is the article
    skip = frozenset(map(id, poor))
    if good := [x for x in tops if id(x) not in skip]:
        for node in good:
            out.article(node)
    else:
        out.content(body, False, False, skip)
        out.end_block()
    return "\n\n".join(out.blocks)


def reference_pages(pages: DataFrame) -> DataFrame:
    """host and refs: the html of up to three pages of each host, those of least and greatest page_id and of the least hash of it."""
    keyed = pages.select("page_id", host_and_path(F.col("url"))[0].alias("host"))
    mixed = F.struct(F.xxhash64("page_id").alias("h"), "page_id")
    ends = keyed.where("page_id is not null").groupBy("host").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.min(mixed)["page_id"].alias("mid"))
    picks = shared.stored(ends.select("host", F.explode(F.array_distinct(F.array("lo", "hi", "mid"))).alias("page_id")), "reference-ids")
    size = picks.agg(F.sum(F.octet_length("host") + 16)).head()[0] or 0
    html = pages.select("page_id", host_and_path(F.col("url"))[0].alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = html.join(F.broadcast(picks) if size <= BROADCAST_BYTES else picks, ["host", "page_id"])
    once = found.groupBy("host", "page_id").agg(F.min("html").alias("html"))  # of rows with equal ids, one
    return shared.stored(once.groupBy("host").agg(F.sort_array(F.collect_set("html")).alias("refs")), "references")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    references = reference_pages(pages)
    size = references.agg(F.sum(F.aggregate("refs", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)))).head()[0] or 0
    # The columns travel under names of their own: nothing of the input can clash with them.
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_and_path(F.col("url"))[0].alias("host"))
    rows = rows.join(F.broadcast(references) if size <= BROADCAST_BYTES else references, "host", "left")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Node] = {}
        for batch in shared.sliced(batches, 200):
            out = []
            for html, others in zip(batch.column("html").to_pylist(), batch.column("refs").to_pylist(), strict=True):
                bodies = []
                for x in others or ():
                    if x:
                        if x not in kept:
                            if len(kept) >= KEPT_TREES:
                                kept.clear()
                            kept[x] = body_of(parse(x))
                        bodies.append(kept[x])
                out.append(main_text(html, bodies))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "refs").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
