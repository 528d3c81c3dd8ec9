"""Main text of web pages by wrapper induction.

Every page is parsed once. Its skeleton is the tree of its block elements, equal siblings
folded into one slot; its blocks are the texts, each with the slot it stands in. The
distinct skeletons of a host are aligned by simple tree matching and merged to one wrapper
tree, in a tournament of bounded matches, so that all pages of a host count and no task
holds a host. Each skeleton is then matched with its host's wrapper, which names the slots
alike on all pages, and the wrapper's slots are judged by counts over all of them:

- a text that nearly all pages with that slot show there is template;
- the content's root is found from the top down: while one inner slot holds most of the
  varying text that is no link, it is there. So a container of the content is found
  whatever its tag and names are;
- for pages that have little in that root, whether the host's articles, its main elements
  or its bodies are the content is decided by where the varying text of the pages with the
  same content slots stands;
- in bodies without either, slots that hold mostly links are navigation.

Blocks in the remaining, varying slots are content. What markup itself declares to be
something else (nav, footer, aside, form, advert, comment and the like) is left out before,
since navigation and adverts vary between pages as content does. Pages of hosts too small
to learn from are judged by themselves. After the parse all is DataFrame work.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stash, table

#: Distinct pages that a slot needs to be judged, and the share of them that must show a text for it to be template.
LEAST_PAGES, CONSTANT = 4, 0.9
#: Share of link characters from which a slot outside article and main is navigation.
LINKS = 0.66
#: Share of the varying text under a slot that one of its children must hold for the content to be looked for there.
DENSE = 0.9
#: Slots of a skeleton, in breadth-first order; what lies deeper counts to the slot above it. Twice as many in a wrapper.
SLOTS = 1000
#: Skeletons that one match of the tournament merges.
FAN = 64

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot caption option optgroup legend title".split())
SCOPE = frozenset("html body table td th caption button object article section main div blockquote ul ol dl form fieldset aside nav header footer".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
LANDMARKS = frozenset("html body main article section header footer nav aside table tbody thead tr ul ol dl".split())
# Elements and roles that are no content; a header is none outside article and main.
NO_CONTENT = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas button select textarea input label dialog menu head title audio video map noembed noframes".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: What may stand around a whole page though it is no content by itself, and what swallows the page where its end tag is missing.
AROUND, AROUND_ROLES, SWALLOWS = frozenset("form dialog label button fieldset".split()), frozenset("form dialog alertdialog alert".split()), frozenset("nav aside footer header menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
# Class and id names that are no content, alone or with each other and with the words below.
NO_CONTENT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets related recommended share sharing social comment comments disqus respond reply replies pagination pager toolbar skip".split()
)
NAME_WORDS = frozenset("area bar block body bottom box button buttons center col column container content group icons inner item items left link links list main outer panel primary region right secondary section site slot the thread top unit wrap wrapper".split())

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z))""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|itemprop|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[^a-z]+")
_DIGIT = re.compile(r"[\d.]")


class Node:
    __slots__ = ("tag", "classes", "ids", "role", "children", "closed")

    def __init__(self, tag: str, attributes: str) -> None:
        self.tag, self.classes, self.ids, self.role = tag, "", "", ""
        self.closed = False  # by its own end tag
        self.children: list[Node | str] = []
        if attributes and attributes.strip(" /"):
            for name, a, b, c in _NAMED.findall(attributes):
                name, value = name.lower(), (a or b or c).lower()
                if name == "role" or name == "itemprop":
                    self.role = value
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    self.role = self.role or "hidden"
                elif name == "class":
                    self.classes = value
                elif name == "id":
                    self.ids = value

    def label(self) -> str:
        """Tag and the classes that may recur on other pages: those without digits; ids name one element of one page."""
        if not self.classes or self.tag in LANDMARKS:
            return self.tag
        return ".".join([self.tag, *sorted({c for c in self.classes.split() if not _DIGIT.search(c)})])


def parse(source: str) -> Node:
    """A forgiving parse: implied ends, unclosed and stray tags, raw elements, cut-off input."""
    root = Node("#root", "")
    stack, at, opened = [root], 0, Counter()

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    for m in iter(_tags(source).__next__, None):
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag] > 0:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                stack[i].closed = True
                close(i)
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        if tag in SIBLINGS and any(opened[x] > 0 for x in SIBLINGS[tag]):
            cut = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in STOP[tag]:
                    break
                if stack[i].tag in SIBLINGS[tag]:
                    cut = i
            if cut:
                close(cut)
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag not in VOID and tag not in RAW and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < len(source):
        stack[-1].children.append(source[at:])
    return root


def _tags(source: str) -> Iterator[re.Match | _Skip | None]:
    at = 0
    while (m := _TAG.search(source, at)) is not None:
        yield m
        at = m.end()
        tag = (m[2] or "").lower()
        if tag in RAW and not m[1] and not m[3].endswith("/"):  # up to its end tag all is text, and none of it content
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            at = end.start() if end else len(source)
            yield _Skip(at)
    yield None


class _Skip:
    """Stands for the text of a raw element, which is passed over."""

    def __init__(self, end: int) -> None:
        self._end = end

    def start(self) -> int:
        return 0

    def end(self) -> int:
        return self._end

    def __getitem__(self, _: int) -> None:
        return None


def declared_other(names: str) -> bool:
    """Whether a class or id says that this is no content: "ad", "cookie-notice", "site-header", but not "entry-header"."""
    for name in names.split():
        parts = {x for x in _PART.split(name) if x}
        if parts & NO_CONTENT_NAMES and parts <= NO_CONTENT_NAMES | NAME_WORDS:
            return True
    return False


def is_main(node: Node) -> bool:
    return node.tag == "main" or node.role in ("main", "articlebody")


def is_article(node: Node) -> bool:
    return node.tag == "article" or node.role == "article"


def is_content(node: Node, inner: bool) -> bool:
    """Whether markup leaves a node in question; `inner` tells that it is inside article or main."""
    if node.tag in NO_CONTENT or node.tag == "header" and not inner or node.role in NO_CONTENT_ROLES or node.role == "hidden":
        return False
    if node.tag in ("html", "body", "main") or not (node.classes or node.ids):
        return True
    return not declared_other(f"{node.classes} {node.ids}")


def page_frames(root: Node) -> set[int]:
    """id() of elements that markup calls no content but that are the page's frame.

    A form, dialog, label or button around an article, a main element or most of the page's
    text is passed through, its controls are not; so is a nav, aside, footer or header that
    is never closed and has swallowed an article, a main element or running text.
    """
    order, work = [], [(root, False)]
    mass: dict[int, int] = {}
    linked: dict[int, int] = {}
    holds: dict[int, bool] = {}
    while work:
        node, in_link = work.pop()
        order.append(node)
        own = sum(len(x.strip()) for x in node.children if isinstance(x, str))
        mass[id(node)], linked[id(node)], holds[id(node)] = own, own if in_link else 0, False
        work += [(x, in_link or x.tag == "a") for x in node.children if not isinstance(x, str)]
    for node in reversed(order):
        for x in node.children:
            if not isinstance(x, str):
                mass[id(node)] += mass[id(x)]
                linked[id(node)] += linked[id(x)]
                holds[id(node)] |= holds[id(x)] or is_main(x) or is_article(x)
    out = set()
    for node in order:
        at = id(node)
        if node.tag in AROUND or node.role in AROUND_ROLES:
            if holds[at] or 2 * mass[at] > mass[id(root)] and 2 * linked[at] < mass[at]:
                out.add(at)
        elif node.tag in SWALLOWS and not node.closed and (holds[at] or 2 * linked[at] < mass[at]):
            out.add(at)
    return out


class Tree:
    """Slots in breadth-first order: label, parent and the pages that have it; the first is the root."""

    def __init__(self, labels: list[str], parents: list[int], pages: list[int] | None = None) -> None:
        self.labels, self.parents, self.pages = labels, parents, pages or [1] * len(labels)
        self.kids: list[list[int]] = [[] for _ in labels]
        for i, p in enumerate(parents):
            if i:
                self.kids[p].append(i)

    def text(self) -> str:
        return " ".join(f"{p}:{n}:{x}" for p, n, x in zip(self.parents, self.pages, self.labels, strict=True))

    @classmethod
    def read(cls, text: str) -> Tree:
        parts = [x.split(":", 2) for x in text.split(" ")]
        return cls([x[2] for x in parts], [int(x[0]) for x in parts], [int(x[1]) for x in parts])


def folded(root: Node) -> tuple[Tree, dict[int, int]]:
    """The skeleton of a page, and the slot of each block element by its id().

    Siblings of equal structure share a slot, so a list of records is one record.
    """
    below: dict[int, list[Node]] = {}
    order: list[tuple[Node, Node]] = []  # (element, block element above)
    work = [(root, root)]
    while work:
        node, above = work.pop()
        if node.tag in BLOCK or node is root:
            order.append((node, above))
            below[id(node)] = []
            if node is not root:
                below[id(above)].append(node)
            above = node
        work += [(x, above) for x in reversed(node.children) if not isinstance(x, str)]
    shape: dict[int, int] = {}
    for node, _ in reversed(order):
        kinds = dict.fromkeys(shape[id(x)] for x in below[id(node)])
        shape[id(node)] = xxhash.xxh64_intdigest(f"{node.label()} {list(kinds)}")
    labels, parents, slot, queue = [root.tag], [0], {id(root): 0}, deque([root])
    met: dict[tuple[int, int], int] = {}
    while queue:
        node = queue.popleft()
        here = slot[id(node)]
        for x in below[id(node)]:
            key = (here, shape[id(x)])
            if key not in met:
                if len(labels) < SLOTS:
                    met[key] = len(labels)
                    labels.append(x.label())
                    parents.append(here)
                else:
                    met[key] = here
            slot[id(x)] = met[key]
            queue.append(x)
    return Tree(labels, parents), slot


#: Bits of a block's place; of one inside an unclosed nav or the like only what is no list of links is content.
IN_MAIN, IN_ARTICLE, DOUBTFUL = 1, 2, 4
Block = tuple[int, int, int, str]


def blocks(root: Node, slot: dict[int, int]) -> list[Block]:
    """(slot, place, characters in links, text) of each block that may be content, in page order.

    Of several articles those that are mostly links are teasers and count as no article,
    unless all are.
    """
    out: list[list] = []
    held: list[str] = []
    links = 0
    article, articles = 0, 0  # number of the outermost article, if inside one

    def close(at: int, place: int) -> None:
        nonlocal links
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text and not (place & DOUBTFUL and 2 * links > len(text)):
            out.append([at, place, min(links, len(text)), text, article])
        links = 0

    frames = page_frames(root)
    work: list[tuple] = [(root, 0, 0, False, False)]
    while work:
        item, at, place, linked, ends = work.pop()
        if ends:  # a block element ends
            close(at, place)
            if item is not None and article and is_article(item) and not place & IN_ARTICLE:
                article = 0
        elif isinstance(item, str):
            held.append(item)
            links += len(item.strip()) if linked else 0
        elif not is_content(item, place & (IN_MAIN | IN_ARTICLE) > 0) and id(item) not in frames:
            if item.tag in BLOCK:
                close(at, place)
        elif item.tag == "br":
            held.append(" ")
        else:
            inner = place | (DOUBTFUL if item.tag in SWALLOWS and id(item) in frames else 0) | (IN_MAIN if is_main(item) else 0) | (IN_ARTICLE if is_article(item) else 0)
            block = item.tag in BLOCK or inner != place
            below = slot.get(id(item), at)
            if block:
                close(at, place)
                if inner & ~place & IN_ARTICLE:
                    articles += 1
                    article = articles
                # what is left when it ends stands in it; then the element above goes on
                work.append((item if inner & ~place & IN_ARTICLE else None, at, place, linked, True))
                work.append((None, below, inner, linked, True))
            work += [(x, below, inner, linked or item.tag == "a", False) for x in reversed(item.children)]
    close(0, 0)
    if articles > 1:
        chars, linked_chars = Counter(), Counter()
        for _, _, n, text, a in out:
            chars[a] += len(text)
            linked_chars[a] += n
        teasers = {a for a in range(1, articles + 1) if 2 * linked_chars[a] > chars[a]}
        if len(teasers) < sum(a > 0 for a in chars):
            for b in out:
                if b[4] in teasers:
                    b[1] &= ~IN_ARTICLE
    return [tuple(b[:4]) for b in out]


def compatible(a: str, b: str) -> bool:
    """Whether two labels may match: one tag, and a class in common unless either has none."""
    x, y = a.split("."), b.split(".")
    return x[0] == y[0] and (len(x) == 1 or len(y) == 1 or not set(x[1:]).isdisjoint(y[1:]))


def aligned(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of slots of the order-preserving match with the most pairs.

    Bottom-up over the pairs that can meet, without recursion; each is weighed once.
    """
    agree: dict[tuple[str, str], bool] = {}

    def meets(i: int, j: int) -> bool:
        key = (a.labels[i], b.labels[j])
        if key not in agree:
            agree[key] = compatible(*key)
        return agree[key]

    if not meets(0, 0):
        return []
    order = [(0, 0)]
    for i, j in order:  # grows while it is read
        order += [(x, y) for x in a.kids[i] for y in b.kids[j] if meets(x, y)]
    weight: dict[tuple[int, int], int] = {}

    def best(i: int, j: int) -> list[list[int]]:
        right, get = b.kids[j], weight.get
        rows = [[0] * (len(right) + 1)]
        for x in a.kids[i]:
            above, row = rows[-1], [0]
            for k, y in enumerate(right):
                row.append(max(above[k + 1], row[k], above[k] + get((x, y), 0)))
            rows.append(row)
        return rows

    for pair in reversed(order):
        weight[pair] = 1 + (best(*pair)[-1][-1] if a.kids[pair[0]] and b.kids[pair[1]] else 0)
    pairs = [(0, 0)]
    for i, j in pairs:
        left, right, rows = a.kids[i], b.kids[j], best(i, j)
        x, y = len(left), len(right)
        while x and y:
            w = weight.get((left[x - 1], right[y - 1]), 0)
            if w and rows[x][y] == rows[x - 1][y - 1] + w:
                x, y = x - 1, y - 1
                pairs.append((left[x], right[y]))
            elif rows[x][y] == rows[x - 1][y]:
                x -= 1
            else:
                y -= 1
    return pairs


def merged(a: Tree, b: Tree) -> Tree:
    """One tree with the slots of both: matched ones once, others at their place among their siblings."""
    of = {j: i for i, j in aligned(a, b)}
    if not of:
        return a
    labels, pages, kids = list(a.labels), list(a.pages), [list(x) for x in a.kids]
    for j, i in of.items():
        pages[i] += b.pages[j]
        stable = set(labels[i].split(".")[1:]) & set(b.labels[j].split(".")[1:])
        labels[i] = ".".join([labels[i].split(".")[0], *sorted(stable)]) if stable else labels[i]
    queue = deque([0])
    while queue:
        j = queue.popleft()
        last = -1  # place of the sibling before, in the merged tree
        for y in b.kids[j]:
            row = kids[of[j]]
            if y in of:
                last = row.index(of[y])
            else:
                of[y] = len(labels)
                labels.append(b.labels[y])
                pages.append(b.pages[y])
                kids.append([])
                last += 1
                row.insert(last, of[y])
            queue.append(y)
    return arranged(labels, pages, kids)


def arranged(labels: list[str], pages: list[int], kids: list[list[int]]) -> Tree:
    """Breadth-first, the slots on fewest pages left out where they are too many."""
    order, parents = [0], [0]
    for at, i in enumerate(order):
        order += kids[i]
        parents += [at] * len(kids[i])
    if len(order) > 2 * SLOTS:
        # a slot goes after all below it, which are on no more pages
        go = sorted(range(1, len(order)), key=lambda k: (pages[order[k]], -k))[: len(order) - 2 * SLOTS]
        gone = {order[k] for k in go}
        return arranged(labels, pages, [[x for x in row if x not in gone] for row in kids])
    return Tree([labels[i] for i in order], parents, [pages[i] for i in order])


def merge_all(trees: list[str]) -> str:
    """One tree of many, in the order given."""
    out = Tree.read(trees[0])
    for text in trees[1:]:
        out = merged(out, Tree.read(text))
    return out.text()


def slots_of(skeleton: str, wrapper: str) -> tuple[list[int], str]:
    """For each slot of a skeleton its slot of the wrapper, and the wrapper's slots of its content elements.

    An unmatched slot has that of the next above that is matched.
    """
    tree = Tree.read(skeleton)
    of = dict(aligned(tree, Tree.read(wrapper)))
    out: list[int] = []
    for i, p in enumerate(tree.parents):
        out.append(of[i] if i in of else (out[p] if i else 0))
    return out, " ".join(sorted({f"{x}:{out[i]}" for i, x in enumerate(tree.labels) if x in ("article", "main")}))


_PARSED = "rid long, page_id string, url string, host string, shape long, content long, skeleton string, slots array<int>, places array<int>, chars array<int>, links array<int>, hashes array<long>, texts array<string>"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """The skeleton and blocks of every page; `shape` is the skeleton's hash, `content` that of the blocks as well."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        names = [x.split()[0] for x in _PARSED.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64()), pa.list_(pa.string())]
        for batch in batches:
            for piece in slices(batch, "html"):
                out = []
                for source in piece.column(4).to_pylist():
                    root = parse(source or "")
                    tree, slot = folded(root)
                    found = blocks(root, slot)
                    skeleton = tree.text()
                    hashes = [signed(xxhash.xxh64_intdigest(t)) for *_, t in found]
                    shape = signed(xxhash.xxh64_intdigest(skeleton))
                    content = signed(xxhash.xxh64_intdigest(f"{shape} {hashes}"))
                    out.append((shape, content, skeleton, [b[0] for b in found], [b[1] for b in found], [len(b[3]) for b in found], [b[2] for b in found], hashes, [b[3] for b in found]))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*piece.columns[:4], *[pa.array(c, k) for c, k in zip(columns, kinds[4:], strict=True)]], names)

    return pages.select("rid", "page_id", "url", "host", "html").mapInArrow(measure, _PARSED)


def wrappers(shapes: DataFrame) -> DataFrame:
    """(host, wrapper) from the distinct skeletons (host, shape, skeleton) of each host, merged in a tournament."""
    now = stash(shapes.select("host", F.col("shape").alias("key"), F.col("skeleton").alias("tree")), "skeletons")

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["key", "tree"])
        return pd.DataFrame({"host": [ordered["host"].iloc[0]], "key": [ordered["key"].iloc[0]], "tree": [merge_all(ordered["tree"].tolist())]})

    while True:
        sizes = now.groupBy(F.col("host").alias("h")).count()
        most = sizes.agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return now.select("host", F.col("tree").alias("wrapper"))
        # an even deal: matches of a host by the rank of the key's hash would need a sort, a hash of it is near enough
        lots = F.ceil(F.col("count") / FAN)
        drawn = now.join(sizes, F.col("host") == F.col("h")).withColumn("match", F.pmod(F.xxhash64("key"), lots))
        now = stash(drawn.select("host", "key", "tree", "match").groupBy("host", "match").applyInPandas(play, now.schema), "skeletons")


def place_of(whole: Column, main: Column, article: Column, both: Column) -> Column:
    """The bits that a content block's place must have: each narrower choice where it holds most of the text."""
    return (
        F.when((2 * main > whole) & (2 * both > main), IN_MAIN | IN_ARTICLE).when(2 * main > whole, IN_MAIN).when(2 * article > whole, IN_ARTICLE).otherwise(0)
    )


def chars_in(place: int) -> Column:
    """Characters of a page's `blocks` that stand in a place."""
    return F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.when(b["place"].bitwiseAND(place) == place, b["chars"]).otherwise(0))


PLACES = {"whole": 0, "main": IN_MAIN, "article": IN_ARTICLE, "both": IN_MAIN | IN_ARTICLE}
def content_root(wrapper: str, mass: dict[int, int]) -> list[int]:
    """The wrapper's slots of the content: the root found from the top down, and all below it.

    An article or main element is not left again, nor a slot whose child to go to stands
    behind a heading of its own level, which belongs to it.
    """
    tree = Tree.read(wrapper)
    total = [mass.get(i, 0) for i in range(len(tree.labels))]
    for i in range(len(total) - 1, 0, -1):  # children come after their parents
        total[tree.parents[i]] += total[i]
    at = 0
    while total[at]:
        tag = tree.labels[at].split(".")[0]
        inner = [x for x in tree.kids[at] if tree.kids[x] and total[x] >= DENSE * total[at]]
        if tag in ("article", "main") or not inner:
            break
        before = tree.kids[at][: tree.kids[at].index(inner[0])]
        if at and tag != "body" and any(tree.labels[x].split(".")[0] in HEADINGS and total[x] for x in before):
            break
        at = inner[0]
    if not at:
        return []
    below = [at]
    for x in below:
        below += tree.kids[x]
    return sorted(below)


_NAMED_ARROW = ["host", "shape", "named", "kind"]


def named_slots(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, shape, named, kind): the wrapper's slots of each distinct skeleton; and (host, wrapper); both stashed."""
    shapes = stash(parsed.groupBy("host", "shape").agg(F.min("skeleton").alias("skeleton")), "shapes")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots_of(s, w) for s, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.string())], _NAMED_ARROW)

    trees = stash(wrappers(shapes), "wrappers")
    met = shapes.join(trees, "host").select("host", "shape", "skeleton", "wrapper")
    return stash(met.mapInArrow(match, "host string, shape long, named array<int>, kind string"), "named"), trees


def rules(parsed: DataFrame) -> DataFrame:
    """What hosts' wrappers say of the pages of each (of_host, of_shape): named slots, template (slot, hash), navigation slots, content slots, content place; null where there is no rule."""
    named, trees = named_slots(parsed)
    key = F.struct("slot", "hash")
    block = F.transform(
        F.arrays_zip("slots", "places", "chars", "links", "hashes"),
        lambda b: F.struct(F.get("named", b["slots"]).alias("slot"), b["places"].alias("place"), b["chars"].alias("chars"), b["links"].alias("links"), b["hashes"].alias("hash")),
    )
    # copies of a page count once: what is constant among them may be content
    once = parsed.select("host", "shape", "content", "slots", "places", "chars", "links", "hashes").dropDuplicates(["host", "content"])
    once = stash(once.join(named, ["host", "shape"]).select("host", "kind", block.alias("blocks")), "once")

    shown = once.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(b["slot"], b["hash"]))))).select("host", "col.*")
    shown = shown.groupBy("host", "slot", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= CONSTANT * LEAST_PAGES)
    pages = once.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["slot"]))).alias("slot"))
    pages = stash(pages.groupBy("host", "slot").agg(F.count("*").alias("pages")).filter(F.col("pages") >= LEAST_PAGES), "slot_pages")
    constant = stash(shown.join(pages, ["host", "slot"]).filter(F.col("n") >= CONSTANT * F.col("pages")).groupBy("host").agg(F.collect_set(key).alias("template")), "template")  # bounded by a wrapper's slots

    vary = once.join(constant, "host", "left").select("host", "kind", F.filter("blocks", lambda b: ~in_template(b["slot"], b["hash"])).alias("blocks"))
    loose = vary.select("host", F.inline("blocks")).filter("place = 0").groupBy("host", "slot").agg(F.sum("links").alias("links"), F.sum("chars").alias("chars"))
    loose = loose.filter(F.col("links") > LINKS * F.col("chars")).join(pages, ["host", "slot"], "left_semi")
    loose = stash(loose.groupBy("host").agg(F.collect_set("slot").alias("navigation")), "navigation")

    summed = vary.select("host", "kind", *[chars_in(p).alias(x) for x, p in PLACES.items()]).groupBy("host", "kind").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in PLACES])
    places = stash(summed.filter(F.col("n") >= LEAST_PAGES).select("host", "kind", place_of(*[F.col(x) for x in PLACES]).alias("wanted")), "places")

    masses = vary.select("host", F.inline("blocks")).groupBy("host", "slot").agg(F.sum(F.col("chars") - F.col("links")).alias("mass")).join(pages, ["host", "slot"], "left_semi")
    masses = masses.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "mass"))).alias("masses"))  # bounded by a wrapper's slots

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [content_root(w, dict(m)) for w, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["host", "inside"])

    inside = trees.join(masses, "host").select("host", "wrapper", "masses").mapInArrow(look, "host string, inside array<int>").filter(F.size("inside") > 0)
    found = named.join(places, ["host", "kind"], "left").join(constant, "host", "left").join(loose, "host", "left").join(stash(inside, "insides"), "host", "left")
    found = found.filter("wanted is not null or template is not null or navigation is not null or inside is not null")
    return stash(found.select(F.col("host").alias("of_host"), F.col("shape").alias("of_shape"), "named", "wanted", "template", "navigation", "inside"), "rules")


def in_template(slot: Column, hashed: Column) -> Column:
    return F.coalesce(F.array_contains("template", F.struct(slot.alias("slot"), hashed.alias("hash"))), F.lit(False))


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html); `key` names another column to go by.

    Null and empty html have an empty text. A null or hostless url belongs to one nameless
    host. Repeated rows give a row each and count once for the wrapper; ties in the merge
    go by the skeletons' hashes; an empty table gives no rows; other columns are not read.
    Very long and very deep pages are parsed without recursion, in memory of some times
    their size.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    read = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("string").alias("page_id"), F.col("url"), F.col("html"), host.alias("host"))
    parsed = stash(parsed_pages(read), "parsed")
    met = parsed.join(rules(parsed), (F.col("host") == F.col("of_host")) & (F.col("shape") == F.col("of_shape")), "left")
    block = F.transform(
        F.arrays_zip("slots", "places", "chars", "hashes", "texts"),
        lambda b: F.struct(F.get("named", b["slots"]).alias("slot"), b["places"].alias("place"), b["chars"].alias("chars"), b["hashes"].alias("hash"), b["texts"].alias("text")),
    )
    rest = met.withColumn("blocks", block).withColumn("blocks", F.filter("blocks", lambda b: ~in_template(b["slot"], b["hash"])))
    wanted = F.coalesce("wanted", place_of(*[chars_in(p) for p in PLACES.values()]))
    in_links = lambda b: (b["place"] == 0) & F.coalesce(F.array_contains("navigation", b["slot"]), F.lit(False))
    own = F.filter("blocks", lambda b: (b["place"].bitwiseAND(F.col("wanted")) == F.col("wanted")) & ~in_links(b))
    of_root = F.filter("blocks", lambda b: F.array_contains("inside", b["slot"]))
    chars = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, b: a + b["chars"])
    rest = rest.withColumn("wanted", wanted).withColumn("own", own).withColumn("root", F.when(F.col("inside").isNotNull(), of_root))
    kept = F.when(F.col("root").isNotNull() & (3 * chars("root") >= chars("own")), F.col("root")).otherwise(F.col("own"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return rest.select(F.col("page_id").cast(pages.schema[key].dataType).alias(key), "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6_wrapper(spark, sf_dir: str) -> DataFrame:
    """Main text of every row of `pages`: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages").withColumn("page_id", F.col("page_id").cast("long")))
