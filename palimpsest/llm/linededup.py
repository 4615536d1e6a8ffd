"""Line deduplication by pairwise alignment.

Documents overlap where they share lines. Every line's hash is owned by the
document of smallest doc_id that has it; a later document is compared with the
owners of its lines, so however many documents share a line, each of them is in
one pair for it. Lines of few words are common, so such a line counts only in
the context of the line before it, of its text alone and not of its context.
A line's length is its words, or its characters where a script has no spaces.

Owners of single lines tear a block apart where an earlier document has some of
its lines. So with ``runs`` every run of lines names a pair too: from each line on,
and up to each line, the shortest of ``least_words`` words, with the first document
that has it. A line lies in a block of that many words shared with any earlier
document if and only if one of its runs is shared, so those pairs are all that
matter. The shared runs of a pair are dealt on patience piles, each of which rises
in both documents and so aligns them; blocks that stand in another order or
repeatedly are further piles, and what lies on one diagonal of a pile is one block.

Each pair is aligned by patience: the lines that are unique in both documents
and rare in the corpus are the anchors, their longest increasing run of
positions is kept, and the other shared lines join where they fit between its
neighbours. Runs that go on without a gap in both documents are blocks. Blocks
of ``least_words`` words or more are deleted from the later document; where
aligned lines make up ``copied`` of a document's words, all aligned lines are.

Defined cases: null texts and null doc_ids are left as they are, and own
nothing; lines differ by case but not by white space at their ends; blank lines
neither match nor part blocks; rows that share a doc_id are one document to the
others, keep what they share with each other, and lose each their own places only; a document of which nothing
but blank lines is left has an empty text; a text of very many lines is keyed and
aligned in time proportional to them (times a logarithm); an empty table gives an
empty result; other columns are kept whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import settle, with_fields

SHORT = 5
# Scripts written without spaces (Thai to Khmer, kana, Han, and their further blocks).
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def line_words(line: str) -> int:
    """Words of a line; where its words are longer than that for want of spaces, the characters of unspaced scripts."""
    n = len(line.split())
    return n if line.isascii() or not n else max(n, len(_UNSPACED.findall(line)))


def line_keys(text: str) -> list[tuple[bytes, bool, int]]:
    """(key, unique in the text, words) of each line that isn't blank."""
    keys, words, seen = [], [], {}
    before = b""
    for line in text.split("\n"):
        n = line_words(line)
        if not n:
            continue
        own = line.strip().encode()
        key = xxhash.xxh128_digest(own if n >= SHORT else before + b"\n" + own)
        before = own
        keys.append(key)
        words.append(n)
        seen[key] = seen.get(key, 0) + 1
    out, met = [], {}
    for key, n in zip(keys, words):
        k = met[key] = met.get(key, 0) + 1
        out.append((key if k == 1 else xxhash.xxh128_digest(key + str(k).encode()), seen[key] == 1, n))
    return out


def line_runs(text: str, least_words: int) -> list[tuple[bytes, int, int]]:
    """(key, first place, lines) of the shortest runs of ``least_words`` from each line on and up to each line."""
    own = [(x.strip().encode(), line_words(x)) for x in text.split("\n") if x.strip()]
    ends, words, z = set(), 0, 0
    for a in range(len(own)):
        while z < len(own) and words < least_words:
            words += own[z][1]
            z += 1
        if words < least_words:
            break
        ends.add((a, z))
        words -= own[a][1]
    words, a = 0, 0
    for z in range(len(own)):
        words += own[z][1]
        while words - own[a][1] >= least_words:
            words -= own[a][1]
            a += 1
        if words >= least_words:
            ends.add((a, z + 1))
    return [(xxhash.xxh128_digest(b"\n".join(x for x, _ in own[a:z])), a, z - a) for a, z in sorted(ends)]


def _whole(text: str) -> list[tuple[bytes, int, int]]:
    """A text under ``least_words`` as one run, equal to such texts only."""
    own = [x.strip().encode() for x in text.split("\n") if x.strip()]
    return [(xxhash.xxh128_digest(b"\n" + b"\n".join(own)), 0, len(own))] if own else []


def _increasing(pairs: list[tuple]) -> list[tuple]:
    """A longest run of pairs, sorted by their first number, in which the second rises."""
    tails, last, back = [], [], []
    for i, p in enumerate(pairs):
        k = bisect_left(tails, p[1])
        back.append(last[k - 1] if k else -1)
        if k == len(tails):
            tails.append(p[1])
            last.append(i)
        else:
            tails[k], last[k] = p[1], i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def aligned_blocks(shared: list[tuple[int, int, bool, int, int]], rare: int) -> list[tuple[int, int, int]]:
    """(place, words, words of its block) of the aligned lines, from the shared ones (place, owner's place, unique in both, documents, words)."""
    shared = sorted(shared)
    for chosen in (lambda s: s[2] and s[3] <= rare, lambda s: s[2], lambda s: True):
        anchors = _increasing([s for s in shared if chosen(s)])
        if anchors:
            break
    run, k = [], 0
    for left, right in zip([(-1, -1), *[a[:2] for a in anchors]], [*[a[:2] for a in anchors], (1 << 62, 1 << 62)]):
        gap = []
        while k < len(shared) and shared[k][0] < right[0]:
            if shared[k][0] > left[0] and left[1] < shared[k][1] < right[1]:
                gap.append(shared[k])
            k += 1
        run += _increasing(gap)
        if k < len(shared) and shared[k][0] == right[0]:
            run.append(shared[k])
            k += 1
    out, block = [], []
    for s in run:
        if block and (s[0] != block[-1][0] + 1 or s[1] != block[-1][1] + 1):
            out += [(b[0], b[4], sum(x[4] for x in block)) for b in block]
            block = []
        block.append(s)
    return out + [(b[0], b[4], sum(x[4] for x in block)) for b in block]


def aligned_runs(shared: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(place, lines) of the aligned blocks of a pair, from its shared runs (place, owner's place, lines), by patience piles."""
    tops: list[int] = []
    piles: list[list[tuple[int, int, int]]] = []
    for run in sorted(set(shared)):
        k = bisect_left(tops, run[1]) - 1  # of the piles that go on rising the one that has risen most
        if k < 0:
            tops.insert(0, run[1])
            piles.insert(0, [run])
        else:
            tops[k] = run[1]
            piles[k].append(run)
    out = []
    for pile in piles:
        begin, own, end = pile[0][0], pile[0][1], pile[0][0] + pile[0][2]
        for place, owner, lines in pile[1:]:
            if place - owner == begin - own and place <= end:
                end = max(end, place + lines)
            else:
                out.append((begin, end - begin))
                begin, own, end = place, owner, place + lines
        out.append((begin, end - begin))
    return sorted(out)


def without_lines(text: str, found: list[tuple[int, int, int]], least_words: int, copied: float, runs: list[tuple[int, int]] = ()) -> tuple[str, int, int, int, int]:
    """(text that is left, lines, words, lines deleted, words deleted)."""
    lines = text.split("\n")
    sizes = [line_words(x) for x in lines]
    aligned = {place: (words, block) for place, words, block in found}
    full = [n for n in sizes if n]
    in_runs = {place for a, n in runs for place in range(a, a + n)}
    aligned |= {place: (full[place], least_words) for place in in_runs}
    whole = sum(w for w, _ in aligned.values()) >= copied * max(1, sum(sizes))
    gone = {place for place, (_, block) in aligned.items() if whole or block >= least_words}
    out, place, n_gone, words_gone = [], 0, 0, 0
    for line, n in zip(lines, sizes):
        if n:
            if place in gone:
                n_gone, words_gone = n_gone + 1, words_gone + n
            else:
                out.append(line)
            place += 1
        else:
            out.append(line)
    left = "\n".join(out)
    return (left if not n_gone or left.strip() else ""), len(lines), sum(sizes), n_gone, words_gone


_KIND = pa.list_(pa.struct([("place", pa.int32()), ("words", pa.int32()), ("block", pa.int32())]))


def _row(text: str) -> F.Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), _row(text).alias("row")).where("doc_id is not null and text is not null")


def overlaps(docs: DataFrame, text: str = "text", least_words: int = 10, rare: int = 64) -> DataFrame:
    """``doc_id, row, found, most``: the aligned lines of every row (``row`` is a hash of its text) that shares ``SHORT`` words or more with an earlier one, and the most words that one owner has of it."""

    def lines(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                out = []
                for doc_id, x, row in zip(*[part.column(k).to_pylist() for k in range(3)]):
                    out += [(key, doc_id, row, k, unique, n) for k, (key, unique, n) in enumerate(line_keys(x))]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32()))], ["key", "doc_id", "row", "place", "single", "words"])

    rows = _rows(docs, text)
    keyed = rows.mapInArrow(lines, "key binary, doc_id long, row long, place int, single boolean, words int")
    owners = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "place", "single")).alias("own"), F.count("*").alias("n"), F.max("doc_id").alias("last")).where("last > own.doc_id")
    # settled, so that the join shuffles both sides and a line that very many documents share is split over tasks
    shared = keyed.join(settle(owners.select("key", "own", "n")), "key").where(F.col("doc_id") > F.col("own.doc_id"))
    pairs = shared.groupBy("doc_id", "row", F.col("own.doc_id").alias("owner")).agg(
        F.collect_list(F.struct("place", F.col("own.place").alias("own_place"), (F.col("single") & F.col("own.single")).alias("single"), "n", "words")).alias("shared"), F.sum("words").alias("words")
    ).where(F.col("words") >= SHORT)

    def align(batches):
        for batch in batches:
            found, most = [], []
            for shared in batch.column(2).to_pylist():
                rows = [tuple(s.values()) for s in shared]
                places: dict = {}
                for r in sorted(rows):  # rows that share a doc_id may hold a line twice
                    places.setdefault(r[0], r)
                found.append([{"place": p, "words": w, "block": b} for p, w, b in aligned_blocks(list(places.values()), rare)])
                most.append(sum(f["words"] for f in found[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _KIND), pa.array(most, pa.int32())], ["doc_id", "row", "found", "most"])

    kind = "array<struct<place int, words int, block int>>"
    each = pairs.select("doc_id", "row", "shared").mapInArrow(align, f"doc_id long, row long, found {kind}, most int")
    return each.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("found")).alias("found"), F.max("most").alias("most"))


def repeated_runs(docs: DataFrame, text: str = "text", least_words: int = 10, whole: bool = False) -> DataFrame:
    """``doc_id, row, runs``: (place, lines) of the blocks of every row that are aligned with an earlier document; ``whole`` adds shorter texts that an earlier document is."""

    def keys(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                out = []
                for doc_id, x, row in zip(*[part.column(k).to_pylist() for k in range(3)]):
                    out += [(key, doc_id, row, place, n) for key, place, n in line_runs(x, least_words) or (_whole(x) if whole else [])]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["key", "doc_id", "row", "place", "lines"])

    rows = _rows(docs, text)
    keyed = rows.mapInArrow(keys, "key binary, doc_id long, row long, place int, lines int")
    owners = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("own"), F.max("doc_id").alias("last")).where("last > own.doc_id")
    shared = keyed.join(settle(owners.select("key", "own")), "key").where("doc_id > own.doc_id")
    pairs = shared.groupBy("doc_id", "row", F.col("own.doc_id").alias("owner")).agg(F.collect_list(F.struct("place", F.col("own.place").alias("own_place"), "lines")).alias("shared"))

    def align(batches):
        kind = pa.list_(pa.struct([("place", pa.int32()), ("lines", pa.int32())]))
        for batch in batches:
            found = [[{"place": p, "lines": n} for p, n in aligned_runs([tuple(s.values()) for s in shared])] for shared in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["doc_id", "row", "runs"])

    each = pairs.select("doc_id", "row", "shared").mapInArrow(align, "doc_id long, row long, runs array<struct<place int, lines int>>")
    return each.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _after_deletion(docs: DataFrame, text: str = "text", least_words: int = 10, copied: float = 0.8, rare: int = 64, runs: bool = False) -> DataFrame:
    """``row`` (the given columns), the text that is left, ``n_lines``, ``n_words``, ``n_removed``, ``removed_words``, and ``most``: the most words that one owner has of a document."""
    found = overlaps(docs, text, least_words, rare)
    if runs:
        found = found.join(repeated_runs(docs, text, least_words, whole=True), ["doc_id", "row"], "full")
    else:
        found = found.withColumn("runs", F.lit(None).cast("array<struct<place int, lines int>>"))
    found = found.withColumnsRenamed({"doc_id": "id", "row": "hash"})
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), _row(text).alias("hash"))
    joined = given.join(found, ["id", "hash"], "left").select("row", "found", "runs", "most")
    at = docs.columns.index(text)
    schema = with_fields(joined.select("row").schema, text="string", n_lines="int", n_words="int", n_removed="int", removed_words="int", most="int")

    def apply(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                out = []
                for x, f, r in zip(part.column(0).flatten()[at].to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    out.append((None, 0, 0, 0, 0) if x is None else without_lines(str(x), [tuple(s.values()) for s in f or ()], least_words, copied, [tuple(s.values()) for s in r or ()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o[0] for o in out], pa.string()), *[pa.array([o[k] for o in out], pa.int32()) for k in (1, 2, 3, 4)], part.column(3)], schema.names)

    return joined.mapInArrow(apply, schema)


def deduplicated_lines(docs: DataFrame, text: str = "text", least_words: int = 10, copied: float = 0.8, rare: int = 64, runs: bool = False) -> DataFrame:
    """Every row with its ``text`` after deletion, ``n_lines``, ``n_words``, ``n_removed`` and ``removed_words`` (columns of these names are replaced). Without ``runs`` blocks are those with the owners of single lines only."""
    counts = ["n_lines", "n_words", "n_removed", "removed_words"]
    found = _after_deletion(docs, text, least_words, copied, rare, runs)
    rest = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in counts]
    return found.select(*rest, *counts)


def without_repeated_lines(docs: DataFrame, copied: float = 0.8, **options) -> DataFrame:
    """The documents, columns as given, after deletion (``n_chars``, where there is one, follows); a document goes whole if nothing is left, or if it was a copy: one single earlier document owns ``copied`` of its words. One made of several documents' passages keeps its own text."""
    found = _after_deletion(docs, copied=copied, **{"runs": True, **options})
    kept = found.where((F.col("n_removed") == 0) | (F.col("removed_words") < F.col("n_words")) & (F.coalesce("most", F.lit(0)) < copied * F.col("n_words")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
