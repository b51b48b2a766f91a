"""Main text of pages by union-free regular expressions inferred per host.

A page is a stream of block-level tags and text.  Streams of one host are
aligned, one after the other, into a wrapper: equal tokens match, different
texts become a text slot, runs that repeat in tandem become a repeated group
(+), and what one side lacks becomes an optional group (?).  Alternatives
don't exist, hence union-free.  Folding is per task first (each distinct stream
once), then over tasks; a wrapper stays as small as the host's template.

The wrapper's text nodes are labelled: chrome, if an element around them is by
its name, class, id or role (navigation, headers, footers, asides, forms,
adverts, notices, comments ...); framed, inside an article or main element;
template, if constant on three pages at least; or plain.  A page's stream is
matched with the wrapper, and each of its texts has the label of the node it
falls on; a text that falls on none is labelled by its own elements.  A page
with framed texts has those as its main text, any other page its plain ones.

Hosts are read from URLs in one place.  Pages without a host are labelled by
their own elements.  Hosts with more than a ``SPLIT``-th of the pages are at most
``SPLIT`` and their wrappers are broadcast; pages of other hosts meet theirs in a
shuffle only if these are too many to broadcast.

Nulls: null html is empty and has empty text; a null URL has no host.  Rows with
equal pages and hosts get equal texts.  Malformed or cut pages are read as far
as they go.  Nothing is capped.  An empty table gives an empty result.  Input
columns named like an output are replaced.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .line_dedup import patience
from .runtime import fan, settle

#: hosts with more than this part of all pages are few
SPLIT = 4096
#: scheme, then host after user names and before port and path
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)"
#: steps of a table to align what stands between two anchors
CELLS = 1 << 20
#: shapes of pages held before they are aligned
SHAPES = 64
OUTPUTS = ("text", "n_chars")

#: self-closed svg and names with a hyphen are ordinary tags
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?!svg(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?/>)(script|style|noscript|template|textarea|select|svg|iframe|title)(?=[\s/>]|\Z).*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?([A-Za-z][A-Za-z0-9:_-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: elements that hold others and keep their place in the path of a text
HOLDERS = frozenset("html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr td th figure details dialog menu fieldset".split())
#: elements whose bounds are bounds of a block of text
BLOCKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd br hr pre blockquote address figcaption caption summary option button label legend head title hgroup".split())
CHROME_TAGS = frozenset("nav footer aside form dialog menu button".split())
CHROME_WORDS = re.compile(r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|header|masthead|ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|newsletter|subscri\w+|social|share|sharing|related|recommend\w*|comments?|replies|respond|disqus|widget|pagination|pager|toolbar|login|search|complementary|contentinfo|skip)(?:$|[^a-z])", re.I)
TEXT = "#"


def tokens(page: str) -> list[tuple[str, str]]:
    """('<name class', '') or ('</name', '') for tags of blocks; ('#', text) for what is between."""
    out, text, at = [], [], 0

    def flush():
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                out.append((TEXT, words))
            text.clear()

    for m in TOKEN.finditer(page):
        text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name in BLOCKS:
            flush()
            if m[0][1] == "/":
                out.append((f"</{name}", ""))
            else:
                kind = " ".join(next(filter(None, a.groups()), "") for a in ATTRIBUTE.finditer(m[3])) if m[3] else ""
                out.append((f"<{name} {kind}".strip(), ""))
                if m[3].endswith("/") and name in HOLDERS:
                    out.append((f"</{name}", ""))
    text.append(page[at:])
    flush()
    return out


def paths(stream):
    """(text or text node, path) of each text; the path names the holders that are open."""
    stack: list[str] = []
    for tag, text in stream:
        if tag == TEXT:
            yield text, tuple(stack)
        elif tag.startswith("</"):
            name = tag[2:]
            if name in HOLDERS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][1:].split(" ")[0] == name:
                        del stack[i:]
                        break
        elif tag[1:].split(" ")[0] in HOLDERS:
            stack.append(tag)


# A wrapper is a list of nodes: "<tag", ["#" and the element around, text or None, places], ["+", nodes], ["?", nodes].
# places: of a page's texts that the node stands for; of a wrapper's node, its label once it has one.


def fold(nodes: list) -> list:
    """Runs that repeat in tandem as repeated groups, shortest first, of any width."""
    known: dict = {}
    while True:
        ids = [known.setdefault(_shape(x), len(known)) for x in nodes]
        last, width = {}, 0
        # a run repeats at the distance of some node's next like
        for i in range(len(ids) - 1, -1, -1):
            w = last.get(ids[i], len(ids)) - i
            if (not width or w < width) and i + 2 * w <= len(ids) and ids[i : i + w] == ids[i + w : i + 2 * w] and not (w == 1 and nodes[i][0] in "+?"):
                width = w
            last[ids[i]] = i
        if not width:
            return nodes
        out, i = [], 0
        while i < len(nodes):
            body, j = nodes[i : i + width], i + width
            while len(body) == width and ids[j : j + width] == ids[i : i + width] and not (width == 1 and body[0][0] in "+?"):
                body = [_join(a, b) for a, b in zip(body, nodes[j : j + width], strict=True)]
                j += width
            if j > i + width:
                out.append(["+", body])
            else:
                out.append(nodes[i])
                j = i + 1
            i = j
        nodes = out


def _shape(node):
    if isinstance(node, str):
        return node
    return node[0] if node[0][0] == TEXT else (node[0], tuple(_shape(x) for x in node[1]))


def _join(a, b):
    """A node that matches what a or b, of one shape, match."""
    if isinstance(a, str):
        return a
    if a[0][0] == TEXT:
        return [a[0], a[1] if a[1] == b[1] else None, a[2] + b[2]]
    return [a[0], [_join(x, y) for x, y in zip(a[1], b[1], strict=True)]]


def _core(node):
    """What decides whether two nodes can stand for each other: the shape without + and ?."""
    while not isinstance(node, str) and node[0] in "+?":
        if len(node[1]) != 1:
            return tuple(_core(x) for x in node[1])
        node = node[1][0]
    return node if isinstance(node, str) else node[0]


def _matched(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of nodes that stand for each other, in order: anchors that are unique on both sides first, then, between
    them, a longest common subsequence where its table has at most ``CELLS`` cells."""
    known: dict = {}
    x, y = ([known.setdefault(_core(n), len(known)) for n in side] for side in (a, b))
    anchors, out, i0, j0 = patience(x, y), [], 0, 0
    for i, j in [*anchors, (len(x), len(y))]:
        n, m = i - i0, j - j0
        if n and m and n * m <= CELLS:
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for p in range(n - 1, -1, -1):
                row, below, c = best[p], best[p + 1], x[i0 + p]
                for q in range(m - 1, -1, -1):
                    row[q] = below[q + 1] + 1 if c == y[j0 + q] else max(below[q], row[q + 1])
            p = q = 0
            while p < n and q < m:
                if x[i0 + p] == y[j0 + q]:
                    out.append((i0 + p, j0 + q))
                    p, q = p + 1, q + 1
                elif best[p + 1][q] >= best[p][q + 1]:
                    p += 1
                else:
                    q += 1
        if i < len(x):
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out


def align(a: list, b: list) -> list:
    """The wrapper that matches what either matches."""
    out, i0, j0 = [], 0, 0
    for i, j in [*_matched(a, b), (len(a), len(b))]:
        only = [*a[i0:i], *b[j0:j]]
        if only:
            out.append(only[0] if len(only) == 1 and only[0][0] == "?" else ["?", only])
        if i < len(a):
            out.append(_merge(a[i], b[j]))
        i0, j0 = i + 1, j + 1
    return out


def _bare(node):
    """The node, or the nodes of a group of several, inside groups of one; and their marks."""
    marks = set()
    while not isinstance(node, str) and node[0] in "+?":
        marks.add(node[0])
        node = node[1]
        if len(node) != 1:
            return node, True, marks
        node = node[0]
    return node, False, marks


def _merge(a, b):
    (p, several, marks), (q, _, more) = _bare(a), _bare(b)
    body = align(p, q) if several else [_join(p, q)]
    for mark in "+?":
        if mark in marks | more:
            body = [[mark, body]]
    return body[0]


def told_by(page: list, wrapper: list) -> None:
    """Give the text nodes of a page's folded stream, in place, the labels of the wrapper's nodes they fall on."""
    for i, j in _matched(page, wrapper):
        (p, several, _), (q, _, _) = _bare(page[i]), _bare(wrapper[j])
        if several:
            told_by(p, q)
        elif not isinstance(p, str):
            p.append(q[2])


def flat(nodes: list):
    for n in nodes:
        if isinstance(n, str):
            yield n, n
        elif n[0][0] == TEXT:
            yield TEXT, n
        else:
            yield from flat(n[1])


def is_chrome(path: tuple[str, ...]) -> bool:
    inside = False
    for step in path:
        name, _, kind = step[1:].partition(" ")
        if name in CHROME_TAGS or (name == "header" and not inside) or (kind and name not in ("html", "body", "article", "main") and CHROME_WORDS.search(kind)):
            return True
        inside = inside or name in ("article", "main")
    return False


def label_of(path: tuple[str, ...]) -> str:
    if is_chrome(path):
        return "chrome"
    return "framed" if any(re.match(r"<(?:article|main)\b", s) for s in path) else "plain"


def labelled(wrapper: list, pages: int) -> list:
    """The wrapper with labels instead of texts."""
    for node, path in paths(flat(wrapper)):
        label = label_of(path)
        node[1:] = [None, "template" if label == "plain" and node[1] is not None and pages >= 3 else label]
    return wrapper


class Reader:
    """Main texts of a host's pages; each shape of page is matched with the wrapper once."""

    def __init__(self, wrapper: list | None, common: set[str] = frozenset()):
        self.wrapper, self.common, self.known = wrapper, common, {}

    def __call__(self, page: str) -> str:
        stream = tokens(page)
        own = [label_of(path) for _, path in paths(stream)]
        texts = [t for tag, t in stream if tag == TEXT]
        if self.wrapper is not None and texts:
            nodes = fold(_nodes(stream))
            shape = tuple(_shape(x) for x in nodes)
            leaves = [n for tag, n in flat(nodes) if tag == TEXT]
            if shape not in self.known:
                told_by(nodes, self.wrapper)
                self.known[shape] = [n[3] if len(n) > 3 else None for n in leaves]
            for leaf, label in zip(leaves, self.known[shape], strict=True):
                for place in leaf[2]:
                    if label is not None:
                        own[place] = label
        want = "framed" if "framed" in own else "plain"
        return " ".join(t for t, label in zip(texts, own, strict=True) if label == want and (want == "framed" or t not in self.common))


def host_of(url: Column) -> Column:
    """The URL's host in lower case; empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), HOST, 1)), F.lit(""))


def _nodes(stream: list[tuple[str, str]]) -> list:
    around = paths(stream)
    place, out = 0, []
    for tag, text in stream:
        if tag != TEXT:
            out.append(tag)
            continue
        _, path = next(around)
        out.append([TEXT + (path[-1] if path else ""), text, [place]])
        place += 1
    return out


class _Fold:
    """A host's wrapper so far; equal shapes are joined without alignment."""

    def __init__(self):
        self.wrapper, self.pages, self.shapes, self.common = None, 0, {}, None

    def add(self, nodes: list, pages: int, texts: set[str]) -> None:
        self.pages += pages
        self.common = texts if self.common is None else self.common & texts
        shape = tuple(_shape(x) for x in nodes)
        have = self.shapes.get(shape)
        self.shapes[shape] = nodes if have is None else [_join(a, b) for a, b in zip(have, nodes, strict=True)]
        if len(self.shapes) >= SHAPES:
            self.close()

    def close(self) -> list:
        for nodes in self.shapes.values():
            self.wrapper = nodes if self.wrapper is None else fold(align(self.wrapper, nodes))
        self.shapes = {}
        return self.wrapper


def _placeless(nodes: list) -> list:
    return [n if isinstance(n, str) else [n[0], n[1], []] if n[0][0] == TEXT else [n[0], _placeless(n[1])] for n in nodes]


def _folded(rows):
    hosts: dict[str, _Fold] = {}
    for host, nodes, pages, texts in rows:
        hosts.setdefault(host, _Fold()).add(_placeless(nodes), pages, texts)
    out = [(h, json.dumps(f.close()), f.pages, json.dumps(sorted(f.common))) for h, f in hosts.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["host", "wrapper", "pages", "common"])


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, pages, common): the wrapper of each host, its pages with text, and the texts all of them have, as JSON."""
    rows = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("h")).where("host <> '' and h <> ''")

    def read(batch_iter):
        for b in batch_iter:
            for host, page in zip(b["host"].to_pylist(), b["h"].to_pylist(), strict=True):
                stream = tokens(page)
                texts = {t for tag, t in stream if tag == TEXT}
                if texts:
                    yield host, fold(_nodes(stream)), 1, texts

    def first(batch_iter):
        yield _folded(read(batch_iter))

    def then(batch_iter):
        yield _folded((h, json.loads(w), n, set(json.loads(c))) for b in batch_iter for h, w, n, c in zip(*(b[x].to_pylist() for x in ("host", "wrapper", "pages", "common")), strict=True))

    kind = "host string, wrapper string, pages long, common string"
    return settle(rows.mapInArrow(first, kind).repartition(fan(pages), "host").mapInArrow(then, kind), "wrappers")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The rows of ``pages`` without the html, with text and n_chars (code points)."""
    def label_all(batch_iter):
        for b in batch_iter:
            told = [zlib.compress(json.dumps([labelled(json.loads(w), n), sorted(json.loads(c)) if n >= 3 else []]).encode()) for w, n, c in zip(*(b[x].to_pylist() for x in ("wrapper", "pages", "common")), strict=True)]
            yield pa.RecordBatch.from_arrays([b["host"], b["pages"], pa.array(told, pa.binary())], ["host", "pages", "told"])

    labels = settle(infer(pages, url_col, html_col).mapInArrow(label_all, "host string, pages long, told binary"), "labels")
    kept = [f for f in pages.schema.fields if f.name not in (html_col, *OUTPUTS)]
    rows = pages.select(F.struct(F.lit(0).alias("0"), *(F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(kept))).alias("row"), F.col(f"`{html_col}`").cast("string").alias("page"), host_of(F.col(f"`{url_col}`")).alias("host"))
    # few hosts have many pages: theirs stay where they are, the others' are joined by the size of their labels
    many = F.col("pages") > (labels.agg(F.sum("pages")).first()[0] or 0) / SPLIT
    hot = labels.where(many).select("host", F.col("told").alias("hot"))
    cold = labels.where(~many).select(F.col("host").alias("key"), F.col("told").alias("cold"))
    key = F.when(F.col("hot").isNull() & (F.col("host") != ""), F.col("host")).otherwise(F.concat(F.lit("#"), F.xxhash64("page").cast("string")))
    rows = rows.join(F.broadcast(hot), "host", "left").withColumn("key", key).join(cold, "key", "left")
    rows = rows.select(*(F.col(f"row._{i}") for i in range(len(kept))), F.col("page").alias("page"), F.coalesce("hot", "cold").alias("told"))

    def read(batch_iter):
        readers: dict[bytes | None, Reader] = {None: Reader(None)}
        for b in batch_iter:
            out = []
            for html, label in zip(b["page"].to_pylist(), b["told"].to_pylist(), strict=True):
                if label not in readers:
                    wrapper, common = json.loads(zlib.decompress(label))
                    readers[label] = Reader(wrapper, set(common))
                out.append(readers[label](html or ""))
            yield pa.RecordBatch.from_arrays([*(b[f"_{i}"] for i in range(len(kept))), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema.names)

    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(read, schema)
