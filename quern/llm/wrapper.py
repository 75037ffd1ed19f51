"""HTML extraction by wrapper induction over pages of the same host.

One page of each host (the one with the smallest digest) begins the host's skeleton; nodes that other pages have
besides join it, named by parent and label. The tree of a page's block elements is aligned with the skeleton by simple
tree matching, over sibling lists in which runs of like nodes are folded into one repeated node. Then the pages of a
host decide, where TEMPLATE_PAGES or more are at hand:

- Template: a node whose text is the same on TEMPLATE_SHARE of the pages that have the node, while other nodes vary.
  Pages of the same text count once.
- Main slot: the deepest container that holds most of the varying text, and the first-order headings, on at least half
  of the pages. What stands outside it on a page that has it is not content; template nodes inside it are not either.

Roles come after that: within the slot, articles alone are content where a page has them (or main parts; an article
outside the slot counts only if none is inside); what a role excludes goes (menus, headers, footers, sidebars, notices,
adverts, forms, comments: by element or by a whole class, role or id word; inside an article by the element or the
class of a box, with fewer words). They settle what induction cannot tell, such as comments that vary like content, and
hosts with fewer pages. With roles=False induction stands alone; scripts, styles and controls never are text.

Blocks: block elements begin a new block; inline markup and <br> do not. Character references are decoded, white
space becomes one space, blocks are trimmed and joined by one newline in page order; empty blocks go.

Parsing takes time in proportion to the page, whatever is left unclosed; nothing recurses, so pages may be nested to any
depth. Sibling lists of any length are aligned best: what a pair is worth depends on the shapes of its two trees alone and
is found once for each pair of shapes, and of long lists' tables a few rows are kept, from which the way back is found.

Null or empty html gives an empty text. A null url is a host of its own. Repeated rows give repeated rows. Extra
columns are ignored. Pages of one host are never gathered in one task: skeletons and what induction found are broadcast
while their measured size is at most BROADCAST_BYTES, else joined (a join that splits skewed hosts); statistics are
partial sums. Each page is parsed once; its blocks are written to the checkpoint folder and read for both purposes.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed, read_table, stored

TEMPLATE_SHARE = 0.9
TEMPLATE_PAGES = 8
BROADCAST_BYTES = 32 << 20
TABLE = 4_096  # pairs of runs whose table is held whole

#: Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
NEVER_TEXT = frozenset("script style noscript template button select textarea iframe svg object head title".split())
EXCLUDED = frozenset("nav footer aside form menu dialog header".split())
EXCLUDED_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side widget widgets footer foot header masthead topbar notice notices notification alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies discussion disqus form search share sharing social related recommended pagination pager toolbar skip copyright legal disclaimer".split())
#: Inside an article other words of the list may be its own (a legal note, a header); class words count there, ids are anchors.
ARTICLE_WORDS = EXCLUDED_WORDS - frozenset("header head masthead footer foot side notice notices notification alert legal disclaimer copyright search discussion form login skip respond reply replies".split())
ARTICLE_BOXES = frozenset("div section ul ol table figure details article center dl".split())
#: p ends where a block begins, li at li, and so on.
ENDS_P = BLOCK - {"html", "body"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: A quote opens a value after = alone; what is not closed runs to the end. Nothing is tried twice.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NO_WORDS: frozenset[str] = frozenset()


class Node:
    __slots__ = ("children", "classes", "ids", "kids", "label", "name", "runs", "shape", "shapes", "tag")

    def __init__(self, tag: str, label: str = "", classes: frozenset = _NO_WORDS, ids: frozenset = _NO_WORDS):
        self.tag, self.label, self.classes, self.ids = tag, label or tag, classes, ids  # whole words of class and role, and of id
        self.children: list[Node | str] = []
        self.kids: list[Node] = []  # block elements below it, through inline ones
        self.name, self.runs = -1, None
        self.shape, self.shapes = -1, None

    def excluded(self, words: bool, in_article: bool) -> bool:
        tag = self.tag
        if tag in ("html", "body", "main"):
            return False
        if tag == "article":
            return words and bool(self.classes & {"comment", "comments", "related", "ad", "sponsored", "promo"})
        if in_article:
            return tag in EXCLUDED and tag != "header" or words and tag in ARTICLE_BOXES and bool(ARTICLE_WORDS & self.classes)
        return tag in EXCLUDED or words and bool(EXCLUDED_WORDS & (self.classes | self.ids))


def parse(html: str) -> Node:
    """Tolerant: end tags may be missing, stray or out of order."""
    root = Node("#root")
    stack, blocks, at, text = [root], [root], 0, html or ""
    open_tags: Counter[str] = Counter()

    def close(i: int) -> None:
        for node in reversed(stack[i:]):
            open_tags[node.tag] -= 1
            if blocks[-1] is node:
                blocks.pop()
        del stack[i:]

    def close_nearest(tags: set[str], scope: frozenset | set) -> None:
        if any(open_tags[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    return close(i)
                if stack[i].tag in scope:
                    return None
        return None

    while at < len(text):
        m = _MARKUP.search(text, at)
        if not m:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_tags[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag not in BLOCK and stack[i].tag in BLOCK:
                        break  # an inline end tag closes nothing beyond its block
            continue
        if tag in ENDS_P:
            close_nearest({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            close_nearest(CLOSES[tag], SCOPES[tag])
        given = _ATTR.findall(m[3]) if len(m[3]) > 5 else ()
        if given:
            ids, classes = (frozenset(w for a in given if (a[0].lower() == "id") == k for w in "".join(a[1:]).lower().split()) for k in (True, False))
            node = Node(tag, f"{tag}.{' '.join(sorted(classes | ids))}", classes, ids)
        else:
            node = Node(tag)
        stack[-1].children.append(node)
        if tag in BLOCK:
            blocks[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(text, at)
            stop = end.start() if end else len(text)
            if tag not in NEVER_TEXT and text[at:stop]:
                node.children.append(text[at:stop])
            at = end.end() if end else len(text)
            continue
        stack.append(node)
        open_tags[tag] += 1
        if tag in BLOCK:
            blocks.append(node)
    return root


def number(root: Node) -> int:
    """Name all block nodes in page order from 0."""
    n, todo = 0, [root]
    while todo:
        node = todo.pop()
        node.name = n
        n += 1
        todo.extend(reversed(node.kids))
    return n


def folded(node: Node) -> list[list[Node]]:
    """Kids with runs of the same label put together."""
    if node.runs is None:
        node.runs = []
        for c in node.kids:
            if node.runs and node.runs[-1][0].label == c.label:
                node.runs[-1].append(c)
            else:
                node.runs.append([c])
    return node.runs


def shaped(root: Node, known: dict[tuple, int]) -> dict[tuple, int]:
    """Number the shapes of root's block nodes: label and shapes of the runs below, as matching sees them. Returns those
    that are not known."""
    new: dict[tuple, int] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.kids)
    for node in reversed(order):
        key = (node.label, *(r[0].shape for r in folded(node)))
        node.shape = known[key] if key in known else new.setdefault(key, len(known) + len(new))
    return new


def _held_mapping(x: list, y: list, worth: Callable[[Node, Node], int]) -> tuple[int, list[tuple[int, int]]]:
    """The order-keeping pairs of runs that are worth most, by a table held whole."""
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, r in enumerate(x):
        for j, s in enumerate(y):
            here = worth(r[0], s[0]) if r[0].label == s[0].label else 0
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + here)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return table[-1][-1], pairs


def _long_mapping(x: list, y: list, worth: Callable[[Node, Node], int]) -> tuple[int, list[tuple[int, int]]]:
    """The same pairs with whole rows at a time; rows are kept at distances of sqrt(len(x)), and those between two of
    them are made again when the way back comes there."""
    places: dict[str, dict[int, tuple[Node, list[int]]]] = {}
    for j, s in enumerate(y):
        places.setdefault(s[0].label, {}).setdefault(s[0].shape, (s[0], []))[1].append(j)
    rows: dict[int, np.ndarray] = {}  # worth of a shape of x with all of y

    def step(before: np.ndarray, node: Node) -> np.ndarray:
        if node.shape not in rows:
            if len(rows) >= 64:
                rows.clear()
            rows[node.shape] = np.zeros(len(y), np.int64)
            for other, at in places.get(node.label, {}).values():
                rows[node.shape][at] = worth(node, other)
        out = np.zeros(len(y) + 1, np.int64)
        np.maximum.accumulate(np.maximum(before[1:], before[:-1] + rows[node.shape]), out=out[1:])
        return out

    apart = int(len(x) ** 0.5) + 1
    row, kept = np.zeros(len(y) + 1, np.int64), []
    for i, r in enumerate(x):
        if i % apart == 0:
            kept.append(row)
        row = step(row, r[0])
    most, pairs, j = int(row[-1]), [], len(y)
    for k in reversed(range(len(kept))):
        table = [kept.pop()]
        for r in x[k * apart:(k + 1) * apart]:
            table.append(step(table[-1], r[0]))
        i = len(table) - 1
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j = int(np.searchsorted(table[i], table[i][j]))  # rows never fall
            else:
                i, j = i - 1, j - 1
                pairs.append((k * apart + i, j))
    return most, pairs


def match(a: Node, b: Node, memo: dict[tuple[int, int], tuple[int, list]]) -> list[tuple[int, int]]:
    """Simple tree matching of two nodes with one label: the most node pairs of an order-keeping, top-down mapping.

    memo: (shape, shape) -> (pairs of nodes, pairs of the nodes' runs). Own stack, children first.
    """
    worth = lambda m, n: memo[m.shape, n.shape][0] if m.kids and n.kids else 1
    todo = [(a, b)]
    while todo:
        p, q = todo[-1]
        key = (p.shape, q.shape)
        if key in memo:
            todo.pop()
            continue
        x, y = folded(p), folded(q)
        kinds: dict[str, dict[int, Node]] = {}
        for s in y:
            if s[0].kids:
                kinds.setdefault(s[0].label, {})[s[0].shape] = s[0]
        mine = {r[0].shape: r[0] for r in x if r[0].kids}
        missing = [(m, n) for m in mine.values() for n in kinds.get(m.label, {}).values() if (m.shape, n.shape) not in memo]
        if missing:
            todo.extend(missing)
            continue
        most, pairs = (_held_mapping if len(x) * len(y) <= TABLE else _long_mapping)(x, y, worth)
        memo[key] = (most + 1, pairs)
        todo.pop()
    return memo[a.shape, b.shape][1]


def align(page: Node, skeleton: Node) -> None:
    """Give the page's block nodes the names of the skeleton nodes they stand for. Runs map member by member, then to
    the last one. What the skeleton lacks is named by its parent's name and its label."""
    import xxhash

    if skeleton.shapes is None:
        skeleton.shapes = shaped(skeleton, {})
    shaped(page, skeleton.shapes)
    memo: dict = {}
    todo = [(page, skeleton)]
    page.name = skeleton.name
    while todo:
        a, b = todo.pop()
        if a.kids and b.kids:
            x, y = folded(a), folded(b)
            for i, j in match(a, b, memo):
                for k, node in enumerate(x[i]):
                    other = y[j][min(k, len(y[j]) - 1)]
                    node.name = other.name
                    todo.append((node, other))
    rest = [page]
    while rest:
        a = rest.pop()
        for c in a.kids:
            if c.name == -1:
                c.name = -2 - (xxhash.xxh3_64_intdigest(f"{a.name} {c.label}") >> 2)
        rest.extend(a.kids)


def _articles(root: Node, words: bool) -> list[Node]:
    """Articles in page order that no excluded node hides."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag == "article":
            out.append(n)
        todo.extend(c for c in reversed(n.kids) if not c.excluded(words, False))
    return out


def _main_parts(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag == "main" or "main" in n.classes | n.ids:
            out.append(n)
        else:
            todo.extend(c for c in reversed(n.kids) if not c.excluded(True, False))
    return out


class Cut:
    """A page's blocks (node, text, excluded by role, inside an article) and its containers (node, first block, block
    after the last, depth, holds the headings)."""

    def __init__(self, root: Node, roles: bool = True):
        # a class word never hides the page's only articles
        tops = (_articles(root, True) or _articles(root, False) or _main_parts(root)) if roles else []
        own = {id(t) for t in tops}
        self.blocks: list[tuple[int, str, bool, bool]] = []
        headings: list[int] = []
        boxes: list[tuple[int, int, int, int]] = []
        parts: list[str] = []
        owner, role, top, depth = root, 0, 0, 0  # the block being read; excluded and article elements around; containers

        def flush() -> None:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                if owner.tag == "h1" and not role:
                    headings.append(len(self.blocks))
                self.blocks.append((owner.name, text, role > 0, top > 0))

        todo: list = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif isinstance(x, tuple):
                flush()
                node, begin, owner, role, top, depth = x
                if begin >= 0 and len(self.blocks) > begin:
                    boxes.append((node.name, begin, len(self.blocks), depth))
            elif x.tag == "br":
                parts.append(" ")
            elif x.tag in NEVER_TEXT:
                continue
            elif x.tag not in BLOCK and x is not root:
                if not (roles and x.excluded(True, top > 0)):
                    todo.extend(reversed(x.children))
            else:
                flush()
                box = x.tag in CONTAINERS and not top
                todo.append((x, len(self.blocks) if box else -1, owner, role, top, depth))
                owner, depth = x, depth + box
                if id(x) in own:
                    role, top = 0, top + 1
                elif roles and x.excluded(True, top > 0):
                    role += 1
                todo.extend(reversed(x.children))
        flush()
        least, most = (headings[0], headings[-1]) if headings else (len(self.blocks), -1)
        self.boxes = [(name, a, b, d, a <= least and most < b) for name, a, b, d in boxes]


def _small(df: DataFrame, size) -> DataFrame:
    """Broadcast where the measured size allows; else the join shuffles, and splits skewed hosts."""
    measured = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if measured <= BROADCAST_BYTES else df


BLOCKS = "array<struct<node:long,text:string,role:boolean,inside:boolean>>"
BOXES = "array<struct<node:long,first:long,end:long,depth:long,headed:boolean>>"


def _lists(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    flat = [x for r in rows for x in r]
    cols = list(zip(*flat, strict=True)) or [()] * kind.value_type.num_fields
    fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values).cast(kind)


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_host, d, weights of the blocks, boxes) -> (_host, d, node, depth) of boxes with the headings and most of the weight."""
    for batch in batches:
        weights, boxes = batch.column("weights"), batch.column("boxes")
        at = np.concatenate([[0], np.cumsum(weights.value_lengths().to_numpy(zero_copy_only=False))])
        sums = np.concatenate([[0], np.cumsum(weights.flatten().to_numpy(zero_copy_only=False))])
        page = np.repeat(np.arange(batch.num_rows), boxes.value_lengths().to_numpy(zero_copy_only=False))
        node, first, end, depth, headed = (x.to_numpy(zero_copy_only=False) for x in boxes.flatten().flatten())
        total = sums[at[1:]] - sums[at[:-1]]
        most = headed.astype(bool) & (2 * (sums[at[page] + end] - sums[at[page] + first]) > total[page])
        of = pa.array(page[most])
        yield pa.RecordBatch.from_arrays([batch.column("_host").take(of), batch.column("d").take(of), pa.array(node[most], pa.int64()), pa.array(depth[most], pa.int64())], ["_host", "d", "node", "depth"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES, roles: bool = True) -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_template (blocks left out as template), n_outside (outside the main slot)."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"), host.alias("_host"))
    skeletons = slim.groupBy("_host").agg(F.min(F.struct(F.xxhash64("page_id", "url").alias("d"), F.col("_html").alias("h"))).alias("_s")).select("_host", F.col("_s.h").alias("_skeleton"))
    skeletons = checkpointed(skeletons)
    both = slim.join(_small(skeletons, F.octet_length("_skeleton")), "_host")
    schema = both.select("page_id", "url", "_host", F.lit(None).cast(BLOCKS).alias("blocks"), F.lit(None).cast(BOXES).alias("boxes")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, Node] = {}
        for batch in batches:
            cuts = []
            for page, skeleton in zip(batch.column("_html").to_pylist(), batch.column("_skeleton").to_pylist(), strict=True):
                if skeleton not in parsed:
                    if len(parsed) >= 64:
                        parsed.clear()
                    parsed[skeleton] = parse(skeleton)
                    number(parsed[skeleton])
                tree = parse(page)
                align(tree, parsed[skeleton])
                cuts.append(Cut(tree, roles))
            lists = [_lists([c.blocks for c in cuts], arrow.field("blocks").type), _lists([c.boxes for c in cuts], arrow.field("boxes").type)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in ("page_id", "url", "_host")), *lists], schema=arrow)

    cut = stored(both.select("page_id", "url", "_host", "_html", "_skeleton").mapInArrow(run, schema))
    # a page counts once for a text at a node, and pages of the same text count once; entries without text count the pages that have the node
    content = F.filter("blocks", lambda b: ~b["role"])
    told_text = F.xxhash64(F.transform(content, lambda b: b["text"])).alias("d")
    told_once = F.array_distinct(F.transform(content, lambda b: F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("h"))))
    once = F.concat(told_once, F.array_distinct(F.transform(content, lambda b: F.struct(b["node"].alias("node"), F.lit(None).cast("long").alias("h")))))
    seen = cut.select("_host", told_text, F.explode(once).alias("b")).select("_host", "b.node", "b.h", "d").distinct()
    same = seen.groupBy("_host", "node", "h").agg(F.count(F.lit(1)).alias("n"))
    with_text = F.when(F.col("h").isNotNull(), F.col("n"))
    nodes = same.groupBy("_host", "node").agg(F.max(with_text).alias("most"), F.sum(with_text).alias("all"), F.max_by("h", with_text).alias("h"), F.max(F.when(F.col("h").isNull(), F.col("n"))).alias("pages"))
    # a host whose pages all say the same has no slot to tell a template from
    fixed = nodes.groupBy("_host").agg(
        F.collect_list(F.when((F.col("pages") >= least) & (F.col("most") >= share * F.col("pages")), F.struct("node", "h"))).alias("_fixed"),
        F.count(F.when(F.col("most") < 0.5 * F.col("all"), 1)).alias("_slots"),
    ).filter((F.size("_fixed") > 0) & (F.col("_slots") > 0)).select("_host", "_fixed")
    cut = cut.join(_small(checkpointed(fixed), 64 + 16 * F.size("_fixed")), "_host", "left")
    is_fixed = lambda b: F.coalesce(F.exists("_fixed", lambda x: (x["node"] == b["node"]) & (x["h"] == F.xxhash64(b["text"]))), F.lit(False))
    # the containers that hold most of the text on half of the pages lie within each other; the deepest one is the main slot
    weights = F.transform("blocks", lambda b: F.when(b["role"] | is_fixed(b), 0).otherwise(F.length(b["text"])).cast("long"))
    held = cut.select("_host", told_text, weights.alias("weights"), "boxes").mapInArrow(_holding, "_host string, d long, node long, depth long").distinct().groupBy("_host", "node").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))
    sizes = cut.select("_host", told_text).distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_pages")).filter(F.col("_pages") >= least)
    main = held.join(sizes, "_host").filter(2 * F.col("n") >= F.col("_pages")).groupBy("_host").agg(F.max_by("node", F.struct("depth", "node")).alias("_main"))
    told = cut.join(_small(checkpointed(main), F.lit(64)), "_host", "left")
    # blocks of the page's main slot, if it has one; of these the ones in articles, or else all articles
    slots = F.filter("boxes", lambda b: b["node"] == F.col("_main"))
    placed = told.withColumn("_slots", F.coalesce(slots, F.array().cast(BOXES))).withColumn(
        "_b", F.transform("blocks", lambda b, i: F.struct(
            b["text"].alias("text"), b["inside"].alias("inside"), b["role"].alias("role"),
            ((F.size("_slots") == 0) | F.exists("_slots", lambda s: (i >= s["first"]) & (i < s["end"]))).alias("slot"),
            is_fixed(b).alias("fixed"))))
    any_inside = F.exists("_b", lambda b: b["inside"] & ~b["role"])
    both_ways = F.exists("_b", lambda b: b["inside"] & b["slot"] & ~b["role"])
    region = placed.withColumn("_any", any_inside).withColumn("_both", both_ways)
    wanted = lambda b: ~b["role"] & F.when(F.col("_both"), b["inside"] & b["slot"]).when(F.col("_any"), b["inside"]).otherwise(b["slot"])
    kept = region.withColumn("_kept", F.filter("_b", lambda b: wanted(b) & ~b["fixed"]))
    text = F.array_join(F.transform("_kept", lambda b: b["text"]), "\n")
    left_out = lambda test: F.size(F.filter("_b", test)).cast("long")
    return kept.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), left_out(lambda b: b["fixed"]).alias("n_template"), left_out(lambda b: ~b["slot"]).alias("n_outside"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).drop("n_template", "n_outside")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_html_extract": op7_html_extract}
ORACLE_SQL: dict[str, str] = {}
