"""HTML extraction by wrapper induction.

Pages of a host are aligned, by simple tree matching of their DOM trees, with the host's reference page
(the least hash of page_id). A text node's slot is the reference node that it aligns with or, if none, its path of tags: so
nodes that the reference lacks, of another layout, are induced too. For every slot the texts that the host's
pages have there are counted: a text that at least SUPPORT of the pages share (of a path: of the pages that have it, if these are
FEW and LAYOUT of the host's) is template. The other texts there vary: they are content. Elements that a browser doesn't
render (UNSEEN) have no text. A page is parsed and matched once; equal shapes align alike, so a pair of shapes is matched once.

Defined results: a null html gives null content; a page without a host, and the only page of one, is all
content; repeated rows are so many pages; tags that are never closed or opened are mended as browsers
do, comments that never end run to the end of the page; nesting of any depth is read; of equally good alignments the
one holds that leaves later nodes out; an empty table gives an empty one; columns named
as a result (host, content, n_template, n_slots) or ``ref``, ``constant``, ``slots`` or ``texts`` give way.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import kernel
from cairn.session import BROADCAST_BYTES, bounded, cut, stored

SUPPORT, LAYOUT, FEW = 0.6, 0.01, 3
UNSEEN = frozenset({"script", "style", "noscript", "template", "head"})
ALONE = -1
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b[^>]*+>(.*?)(?:</\1\s*+>|\Z)|<[!?][^>]*+>|<(/?)([a-z][\w:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)/?>",
    re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPE = frozenset("html table td th button object caption".split())
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_signs: dict[tuple, int] = {}


class Tree:
    """Nodes in document order: tag ('#' for text), parent, children, text, and whether an UNSEEN element holds it."""

    def __init__(self, source: str):
        self.tag, self.up, self.kids, self.text, self.skip = ["#root"], [0], [[]], [""], [False]
        self.open: dict[str, int] = {}
        stack = [0]
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._add_text(source[at : m.start()], stack[-1])
            at = m.end()
            raw, close, name = m.group(1), m.group(3), m.group(4)
            if raw:
                self._add_text(m.group(2), self._add(raw.lower(), stack[-1]))
            elif name:
                name = name.lower()
                if close:
                    if self.open.get(name):
                        k = len(stack) - 1
                        while self.tag[stack[k]] != name:
                            k -= 1
                        self._close(stack, k)
                else:
                    self._imply(name, stack)
                    node = self._add(name, stack[-1])
                    if name not in _VOID and not m.group(0).endswith("/>"):
                        stack.append(node)
                        self.open[name] = self.open.get(name, 0) + 1
        if at < len(source):
            self._add_text(source[at:], stack[-1])
        self._sign()

    def _add(self, tag: str, up: int, text: str = "") -> int:
        n = len(self.tag)
        self.tag.append(tag)
        self.up.append(up)
        self.kids.append([])
        self.text.append(text)
        self.skip.append(self.skip[up] or tag in UNSEEN)
        self.kids[up].append(n)
        return n

    def _add_text(self, text: str, up: int) -> None:
        text = " ".join(entities.unescape(text).split())
        if text:
            self._add("#", up, text)

    def _close(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self.open[self.tag[node]] -= 1
        del stack[k:]

    def _imply(self, name: str, stack: list[int]) -> None:
        """Close the elements that the start of ``name`` ends."""
        ends = {"p"} if name in _BLOCK else _SELF.get(name)
        if not ends or not any(self.open.get(t) for t in ends):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in ends:
                self._close(stack, k)
                return
            if tag in _SCOPE or name in _SELF and tag in ("ul", "ol", "dl", "select"):
                return

    def _sign(self) -> None:
        """A number for the shape of each subtree (equal shape, equal number), and its size."""
        n = len(self.tag)
        self.sign, self.size = [0] * n, [1] * n
        for k in range(n - 1, -1, -1):  # children come after their parents
            kids = self.kids[k]
            self.sign[k] = _signs.setdefault((self.tag[k], *[self.sign[x] for x in kids]), len(_signs))
            for x in kids:
                self.size[k] += self.size[x]

    def path(self, node: int) -> int:
        """A negative number, below ALONE, for the tags from the root to a node."""
        tags = []
        while node:
            tags.append(self.tag[node])
            node = self.up[node]
        return ALONE - 1 - (xxhash.xxh3_64_intdigest("/".join(tags)) >> 2)


class Matcher:
    """Simple tree matching: the most node pairs of equal tags that keep ancestry and order."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b = a, b
        self.known: dict[tuple[int, int], int] = {}

    def _matrix(self, x: int, y: int) -> np.ndarray | None:
        p, q = self.a.kids[x], self.b.kids[y]
        if not p or not q:
            return None
        cols: dict[int, int] = {}
        of = np.array([cols.setdefault(self.b.sign[k], k) for k in q])
        first, inverse = np.unique(of, return_inverse=True)
        first = first.tolist()
        m = np.zeros((len(p) + 1, len(q) + 1), np.int32)
        lines: dict[int, np.ndarray] = {}
        for i, k in enumerate(p):
            sign = self.a.sign[k]
            w = lines.get(sign)
            if w is None:
                w = lines[sign] = np.array([self.weight(k, f) for f in first], np.int32)[inverse]
            np.maximum(m[i, 1:], m[i, :-1] + w, out=m[i + 1, 1:])
            np.maximum.accumulate(m[i + 1], out=m[i + 1])
        return m

    def _found(self, x: int, y: int) -> int | None:
        a, b = self.a, self.b
        if a.tag[x] != b.tag[y]:
            return 0
        if a.sign[x] == b.sign[y]:
            return a.size[x]
        return self.known.get((a.sign[x], b.sign[y]))

    def weight(self, x: int, y: int) -> int:
        """Pairs in the best matching of two subtrees that pairs their roots, 0 if these differ. The pairs of
        children that it depends on are weighed first, from a list instead of by recursion."""
        a, b = self.a, self.b
        todo = [(x, y)]
        while todo:
            i, j = todo[-1]
            if self._found(i, j) is not None:
                todo.pop()
                continue
            p = {a.sign[k]: k for k in a.kids[i]}.values()
            q = {b.sign[k]: k for k in b.kids[j]}.values()
            missing = [(k, f) for k in p for f in q if self._found(k, f) is None]
            if missing:
                todo += missing
                continue
            m = self._matrix(i, j)
            self.known[a.sign[i], b.sign[j]] = 1 + (int(m[-1, -1]) if m is not None else 0)
            todo.pop()
        return self._found(x, y)

    def pairs(self) -> dict[int, int]:
        """Node of ``a`` -> the node of ``b`` that it aligns with."""
        out = {}
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[x] = y
            p, q = self.a.kids[x], self.b.kids[y]
            if self.a.sign[x] == self.b.sign[y]:
                todo += zip(p, q)
                continue
            m = self._matrix(x, y)
            if m is None:
                continue
            i, j = len(p), len(q)
            while i and j:
                if m[i, j] == m[i - 1, j]:
                    i -= 1
                elif m[i, j] == m[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((p[i], q[j]))
        return out


def text_hash(text: str) -> int:
    """What Spark's xxhash64 gives for a text."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >> 63 else h


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's visible texts with their slots. The last references stay parsed, the last pairs of shapes matched."""
    refs: dict[str, tuple[str, Tree]] = {}
    matched: dict[tuple[int, int], dict[int, int]] = {}
    for b in batches:
        rows: list[tuple] = []
        for host, html, ref in zip(*[b.column(c).to_pylist() for c in ("host", "html", "ref")]):
            if len(_signs) > 500_000:
                _signs.clear()
                refs.clear()
                matched.clear()
            page = Tree(html)
            seen = [k for k in range(len(page.tag)) if page.tag[k] == "#" and not page.skip[k]]
            if ref is None:
                slots = [ALONE] * len(seen)
            else:
                if host not in refs or refs[host][0] != ref:
                    if len(refs) > 256:
                        refs.clear()
                    refs[host] = (ref, Tree(ref))
                tree = refs[host][1]
                key = (page.sign[0], tree.sign[0])
                pairs = matched.get(key)
                if pairs is None:
                    if len(matched) > 4096:
                        matched.clear()
                    every = Matcher(page, tree).pairs()
                    pairs = matched[key] = {k: every[k] for k in seen if k in every}
                slots = [pairs[k] if k in pairs else page.path(k) for k in seen]
            texts = [page.text[k] for k in seen]
            rows.append((slots, texts))
        names = [c for c in b.schema.names if c not in ("html", "ref")]
        kinds = (pa.list_(pa.int64()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *[pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]], [*names, "slots", "texts"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content of each page: its texts but for the constants of its host."""
    held: tuple[str | None, set] = (None, set())
    for b in batches:
        rows: list[tuple] = []
        for k, (host, slots, texts) in enumerate(zip(*[b.column(c).to_pylist() for c in ("host", "slots", "texts")])):
            constant = b.column("constant")[k]
            if not constant.is_valid:
                rows.append(("\n".join(texts), 0, len(texts)))
                continue
            if held[0] != host:
                held = (host, {(c["slot"], c["h"]) for c in constant.as_py()})
            own = [t for s, t in zip(slots, texts) if (s, text_hash(t)) not in held[1]]
            rows.append(("\n".join(own), len(texts) - len(own), len(own)))
        names = [c for c in b.schema.names if c not in ("slots", "texts", "constant")]
        kinds = (pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *[pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]], [*names, "content", "n_template", "n_slots"])


def constants(aligned: DataFrame, hosts: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(host, constant): the (slot, h) of the template texts of each host of ``hosts`` (host, pages)."""
    p = aligned.join(bounded(hosts.select("host"), 64), "host", "left_semi")
    each = p.select("host", F.explode(F.array_distinct(F.zip_with("slots", "texts", lambda s, t: F.struct(s.alias("slot"), F.xxhash64(t).alias("h"))))).alias("x"))
    n = each.groupBy("host", "x.slot", "x.h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    paths = p.select("host", F.explode(F.array_distinct(F.filter("slots", lambda s: s < ALONE))).alias("slot")).groupBy("host", "slot").agg(F.count(F.lit(1)).alias("there"))
    t = n.join(bounded(hosts, 72), "host").join(paths, ["host", "slot"], "left")
    most = F.col("n") >= support * F.coalesce("there", "pages")
    layout = F.col("there").isNull() | ((F.col("n") >= FEW) & (F.col("there") >= LAYOUT * F.col("pages")))
    return t.filter(most & layout).groupBy("host").agg(F.collect_list(F.struct("slot", "h")).alias("constant"))


def extract(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``pages`` (url, html and a page_id) with host, content, n_template and n_slots instead of html."""
    kernel.frugal(pages.sparkSession)
    pages = kernel.without(pages, "host", "content", "n_template", "n_slots", "ref", "constant", "slots", "texts")
    pages = pages.withColumn("host", F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")))
    whole = pages.filter("html is not null")
    lead = whole.filter("host is not null").groupBy("host").agg(F.min(F.struct(F.xxhash64("page_id"), "page_id")).alias("m"), F.count(F.lit(1)).alias("pages"))
    lead = cut(lead.filter("pages > 1").select("host", F.col("m.page_id").alias("page_id"), "pages"))
    on = whole.alias("w").join(bounded(lead, 64).alias("l"), (F.col("w.host") == F.col("l.host")) & F.equal_null("w.page_id", "l.page_id"), "left_semi")
    refs = cut(on.groupBy("host").agg(F.min("html").alias("ref")))
    side = lambda d, size: F.broadcast(d) if d.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES else d.hint("shuffle_hash")
    kept = [f for f in pages.schema if f.name != "html"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = [f.name for f in kept]
    aligned = whole.join(side(refs, F.octet_length("ref")), "host", "left").select(*names, "html", "ref").mapInArrow(_align, schema + ", slots array<bigint>, texts array<string>")
    aligned = stored(aligned)
    fixed = cut(constants(aligned, lead.select("host", "pages"), support))
    got = aligned.join(side(fixed, F.size("constant") * 16), "host", "left").select(*names, "slots", "texts", "constant").mapInArrow(_choose, schema + ", content string, n_template int, n_slots int")
    bare = pages.filter("html is null").drop("html").withColumns({"content": F.lit(None).cast("string"), "n_template": F.lit(0), "n_slots": F.lit(0)})
    return got.select(bare.columns).union(bare)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "content", "n_template", "n_slots")
