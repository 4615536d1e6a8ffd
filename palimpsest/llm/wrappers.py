"""Main text of web pages by wrapper induction.

Each page's DOM tree is folded (equal siblings become one repeated node) and
aligned with the commonest tree of its host by simple tree matching. Nodes that
are aligned with one node of that tree are one slot; a node without a partner is
a slot of its own shape. Over the host's distinct pages a slot has the number of
pages, the most that agree in its text, and its mean share of a page's text,
links left out.

* A slot whose text is the same on most pages is template: on ``share`` of
  at least ``least`` pages, inside marked articles and containers so named on
  ``sure_share`` of ``sure_pages``. That text is dropped; where a page has another
  one in the slot, it is judged like any varying text.
* Varying slots are content or not by where the host's text lies. From the root
  on, the region narrows to a child as long as that child has over half of the
  text and ``dominant`` of what it and its largest rival have; what stands outside
  the region is no content, but for its h1 heading.
  Lists of links are none either, unless inside an article or where at least
  ``least`` pages of the host show that they vary.
* Marks are one feature of it. Text in article, main or a container so named
  weighs ``boost`` times. An element that says it is a menu, header, footer,
  sidebar, notice, advert, form or comments is out, but a class, id, form or
  header that only hints so is overruled where it holds nearly all text and
  there is no other article but a teaser. So no word blanks what surrounds the content.
  What words say of notices, banners and headers counts for hosts of fewer than
  ``least`` pages only: else it is their being the same that tells them.

A host with one page is treated in the same way: by the density and the marks
of that page. Copies of a page count once.

Pages are aligned by host and shape, not pair by pair, and counted before and
after the shuffle, so a host with a third of all pages costs no more than others.

Defined cases: null or empty html gives an empty text; a null url is a host of
its own named ''; hosts with fewer pages than asked have no template; repeated
rows are answered each; an empty table gives an empty result; a very long page
costs time in proportion to its length, and a tree of very many different nodes
as well; columns of any name are kept (``text`` and ``n_chars`` are replaced).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import settle, with_fields
from palimpsest.llm.dom import ARTICLE, FIXED, SOFT, STORY, SURE, Page, folded, tree_matching

_HASH = 0x7FFFFFFFFFFFFFFF
BROADCAST_BYTES = 8 << 20
# Elements that hold a text as a whole.
CONTAINERS = frozenset("html body main article section div center form table tbody tr td dd figure fieldset details hgroup header".split())


@dataclass(frozen=True)
class Evidence:
    """What template and content ask for."""

    share: float = 0.5
    least: int = 3
    sure_share: float = 0.95
    sure_pages: int = 12
    dominant: float = 0.85
    boost: float = 10.0
    links: float = 0.6
    teaser: float = 0.02


def _host(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return rest.partition("/")[0].partition("?")[0].partition("#")[0].rpartition("@")[2].lower()


def page_blocks(source: str | None) -> tuple[list, list[tuple[int, int, str, int]], list[tuple[int, str]]]:
    """(folded tree, entries of (node, block, text, characters in links), raw contents of (node, contents)) of a page."""
    page = Page(source or "")
    tree, node = folded(page)
    return tree, [(node[k], block, text, links) for k, block, text, links in page.blocks], [(node[k], text) for k, text in page.raw]


def node_figures(blocks: list, raw: list) -> dict[int, tuple[int, float, float]]:
    """(hash of its text, share of the page's text, the same share of what is in links) of each node that has contents."""
    total = max(1, sum(len(text) - links for _, _, text, links in blocks))
    found: dict[int, list] = {}
    for node, _, text, links in blocks:
        own = found.setdefault(node, [xxhash.xxh64(), 0, 0])
        own[0].update(text + "\n")
        own[1] += len(text) - links
        own[2] += links
    for node, text in raw:
        found.setdefault(node, [xxhash.xxh64(), 0, 0])[0].update(text)
    return {node: (h.intdigest() & _HASH, n / total, links / total) for node, (h, n, links) in found.items()}


def decided(tree: list, figures: dict[int, tuple[int, int, float, float]], by: Evidence) -> tuple[list[int], list[int]]:
    """(content, template): nodes of a folded tree, from the (pages, pages of one text, share of the text, share in links) of its nodes' slots. A node in both is content where a page's text isn't the slot's common one."""
    n = len(tree)
    kids: list[list[int]] = [[] for _ in tree]
    for k, (parent, _, _) in enumerate(tree):
        if parent >= 0:
            kids[parent].append(k)
    pages_of = [figures[k][0] if k in figures else 0 for k in range(n)]
    for k in range(n - 1, 0, -1):
        pages_of[tree[k][0]] = max(pages_of[tree[k][0]], pages_of[k])
    # the host's pages tell what is fixed better than words do
    marks = [m & ~SOFT if m & FIXED and pages_of[k] >= by.least else m for k, (_, _, m) in enumerate(tree)]
    article, sure, hinted, story = [False] * n, [False] * n, [False] * n, [False] * n
    for k, (parent, _, _) in enumerate(tree):
        m = marks[k]
        up = (lambda flags: parent >= 0 and flags[parent])
        sure[k] = up(sure) or bool(m & SURE)
        hinted[k] = up(hinted) or bool(m & SOFT) and not sure[k]
        article[k] = up(article) or bool(m & ARTICLE)
        story[k] = up(story) or bool(m & (ARTICLE | STORY))
    own, template = [0.0] * n, []
    for k, (pages, same, share, _) in figures.items():
        constant = (same >= by.sure_share * pages and pages >= by.sure_pages) if story[k] else (same > by.share * pages and pages >= by.least)
        if constant:
            template.append(k)
        else:
            own[k] = share
    gone = set(template)

    def below(values: list[float]) -> list[float]:
        out = list(values)
        for k in range(n - 1, 0, -1):
            out[tree[k][0]] += out[k]
        return out

    text = below([0.0 if sure[k] else own[k] for k in range(n)])
    # the share in articles that no hint surrounds; where there is none, hints may be wrong
    marked = sum(own[k] for k in range(n) if article[k] and not sure[k] and not hinted[k])
    nested = [marks[k] & ARTICLE and not marks[k] & SOFT and not sure[k] for k in range(n)]
    for k in range(n - 1, 0, -1):
        nested[tree[k][0]] = nested[tree[k][0]] or nested[k]
    hint = [False] * n
    for k, (parent, _, _) in enumerate(tree):
        if parent >= 0 and hint[parent]:
            hint[k] = True
        elif marks[k] & SOFT and not sure[k]:
            most = text[k] >= by.dominant * text[0] > 0
            overruled = nested[k] or most if not marked else most and marked < by.teaser * text[0]
            hint[k] = not overruled
    out = [sure[k] or hint[k] for k in range(n)]
    plain = below([0.0 if out[k] else own[k] for k in range(n)])
    weight = below([0.0 if out[k] else own[k] * (by.boost if story[k] else 1.0) for k in range(n)])
    linked = below([0.0 if out[k] or k in gone else figures[k][3] if k in figures else 0.0 for k in range(n)])
    names = [re.split("[.#@]", signature, maxsplit=1)[0] for _, signature, _ in tree]
    at, path, headings = 0, {0}, set()
    while True:
        best = max((c for c in kids[at] if names[c] in CONTAINERS), key=lambda c: weight[c], default=None)
        if best is None or not weight[best] > 0.5 * weight[at]:
            break
        rival = max([weight[at] - sum(weight[c] for c in kids[at]), *(weight[c] for c in kids[at] if c != best)])
        if weight[best] < by.dominant * (weight[best] + rival):
            break
        headings |= {c for c in kids[at] if names[c] == "h1" and not out[c]}
        at = best
        path.add(at)
    inside, content = [False] * n, []
    for k, (parent, _, _) in enumerate(tree):
        listed = linked[k] > by.links * (linked[k] + plain[k]) and not article[k] and k not in path and pages_of[k] < by.least
        inside[k] = (k == at or parent >= 0 and inside[parent] or k in headings) and not out[k] and not listed
        if inside[k]:
            content.append(k)
    return content, sorted(template)


def page_text(source: str | None, by: Evidence = Evidence()) -> str:
    """The main text of a page that is the only one of its host."""
    tree, blocks, raw = page_blocks(source)
    content = set(decided(tree, {k: (1, 1, share, links) for k, (_, share, links) in node_figures(blocks, raw).items()}, by)[0])
    lines: dict[int, list[str]] = {}
    for node, block, text, _ in blocks:
        if node in content:
            lines.setdefault(block, []).append(text)
    return "\n".join(" ".join(x) for x in lines.values())


def _shape(tree: list) -> tuple[int, str]:
    said = json.dumps(tree, separators=(",", ":"))
    return xxhash.xxh64_intdigest(said) & _HASH, said


def _figures(pages: DataFrame) -> DataFrame:
    """Host, shape, tree and a hash of each page, and the figures of its nodes."""
    kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64()), ("share", pa.float64()), ("links", pa.float64())]))

    def apply(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part, out = batch.slice(a, 64), []
                for url, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tree, blocks, raw = page_blocks(source)
                    shape, said = _shape(tree)
                    found = node_figures(blocks, raw)
                    whole = xxhash.xxh64_intdigest(repr((shape, [x[0] for x in found.values()]))) & _HASH
                    out.append((_host(url), shape, said, whole, [{"node": k, "text": h, "share": s, "links": x} for k, (h, s, x) in found.items()]))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), kind)
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], x) for k, x in enumerate(kinds)], ["host", "shape", "tree", "page", "nodes"])

    return pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        apply, "host string, shape long, tree string, page long, nodes array<struct<node int, text long, share double, links double>>"
    )


def _aligned(batches):
    """Node by node, the slot on the host's reference, or -1."""
    for batch in batches:
        out = []
        for host, shape, tree, reference in zip(*(batch.column(k).to_pylist() for k in range(4))):
            out += [(host, shape, n, r) for n, r in enumerate(tree_matching(json.loads(tree), json.loads(reference)))]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["host", "shape", "node", "slot"])


def slots(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``host, shape, tree`` of each shape, and ``host, shape, node, pages, same, common, share, links`` of each of its nodes that has contents."""
    distinct = settle(_figures(pages).groupBy("host", "shape", "page").agg(F.first("tree").alias("tree"), F.first("nodes").alias("nodes")))
    shapes = settle(distinct.groupBy("host", "shape").agg(F.count("*").alias("n"), F.first("tree").alias("tree")))
    reference = shapes.groupBy("host").agg(F.max_by("tree", F.struct("n", F.length("tree"), "tree")).alias("reference"))
    aligned = settle(shapes.join(reference, "host").select("host", "shape", "tree", "reference").mapInArrow(_aligned, "host string, shape long, node int, slot int"))
    # a node without a partner is a slot of its own shape
    placed = aligned.select("host", "shape", "node", F.when(F.col("slot") >= 0, -1).otherwise(F.col("shape")).alias("at"), F.when(F.col("slot") >= 0, F.col("slot")).otherwise(F.col("node")).alias("slot"))
    nodes = distinct.select("host", "shape", F.explode("nodes").alias("x")).select("host", "shape", "x.*")
    per_text = nodes.join(placed, ["host", "shape", "node"]).groupBy("host", "at", "slot", "text").agg(F.count("*").alias("n"), F.sum("share").alias("share"), F.sum("links").alias("links"))
    found = per_text.groupBy("host", "at", "slot").agg(F.sum("n").alias("pages"), F.max("n").alias("same"), F.max_by("text", F.struct("n", "text")).alias("common"), (F.sum("share") / F.sum("n")).alias("share"), (F.sum("links") / F.sum("n")).alias("links"))
    return shapes.select("host", "shape", "tree"), placed.join(found, ["host", "at", "slot"]).select("host", "shape", "node", "pages", "same", "common", "share", "links")


def induced(pages: DataFrame, by: Evidence = Evidence()) -> DataFrame:
    """``host, shape, content, template, common``: the nodes of each page shape that are content, those that are template, and the hashes of what these have in common."""
    shapes, nodes = slots(pages)
    listed = nodes.groupBy("host", "shape").agg(F.collect_list(F.struct("node", "pages", "same", "common", "share", "links")).alias("nodes"))

    def decide(batches):
        for batch in batches:
            found = []
            for tree, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                each = {x["node"]: x for x in sorted(nodes or [], key=lambda x: x["node"])}
                content, template = decided(json.loads(tree), {k: (x["pages"], x["same"], x["share"], x["links"]) for k, x in each.items()}, by)
                found.append((content, template, [each[k]["common"] for k in template]))
            kinds = (pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([f[k] for f in found], pa.list_(x)) for k, x in enumerate(kinds)]], ["host", "shape", "content", "template", "common"])

    return shapes.join(listed, ["host", "shape"], "left").select("host", "shape", "tree", "nodes").mapInArrow(decide, "host string, shape long, content array<int>, template array<int>, common array<long>")


def _texts(pages: DataFrame) -> DataFrame:
    """``row`` (the given columns but html), host, shape and entries of each page, each with the hash of all text of its node."""
    rest = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = pa.list_(pa.struct([("node", pa.int32()), ("block", pa.int32()), ("text", pa.string()), ("all", pa.int64())]))
    schema = with_fields(rows.select("row").schema, host="string", shape="long", blocks="array<struct<node int, block int, text string, all long>>")

    def apply(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                shapes, found = [], []
                for source in part.column(2).to_pylist():
                    tree, blocks, raw = page_blocks(source)
                    shapes.append(_shape(tree)[0])
                    whole = node_figures(blocks, raw)
                    found.append([{"node": n, "block": b, "text": t, "all": whole[n][0]} for n, b, t, _ in blocks])
                hosts = pa.array([_host(u) for u in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), hosts, pa.array(shapes, pa.int64()), pa.array(found, kind)], ["row", "host", "shape", "blocks"])

    return rows.mapInArrow(apply, schema)


def main_text(pages: DataFrame, **evidence) -> DataFrame:
    """Every page with ``text`` and ``n_chars`` in the place of ``html`` (other columns are kept, those names replaced); ``evidence`` is that of ``Evidence``."""
    both = F.arrays_zip(F.col("template").alias("node"), F.col("common").alias("all"))
    found = settle(induced(pages, Evidence(**evidence))).select("host", "shape", "content", F.filter(both, lambda x: F.array_contains("content", x["node"])).alias("dropped"))
    size = found.agg(F.sum(F.length("host") + 4 * F.size("content") + 12 * F.size("dropped") + 32).alias("n")).first()["n"] or 0
    # where the table is small, page texts aren't shuffled; else a hot host's pages are split by the adaptive join
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    common = lambda b: F.array_contains("dropped", F.struct(b["node"].alias("node"), b["all"].alias("all")))
    kept = F.filter("blocks", lambda b: F.array_contains("content", b["node"]) & ~common(b))
    lines = F.transform("kept", lambda b, k: F.concat(F.when(k == 0, "").when(F.get("kept", k - 1)["block"] == b["block"], " ").otherwise("\n"), b["text"]))
    joined = _texts(pages).join(found, ["host", "shape"], "left").select("row", F.coalesce(kept, F.array()).alias("kept"))
    return joined.select("row.*", F.array_join(lines, "").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
