"""Document fingerprints from statistically improbable features.

Every 64-byte window of a text gets its normalised byte entropy (0 to 1000).
How rare an entropy is comes from a histogram over all texts, and a window's
rank is its place in that order of rarity. In each run of 64 neighbouring
windows the leftmost one of lowest rank scores a point; windows with 16 points
or more are the text's features. Five 11-bit parts of a feature's hash set bits
in a 256-byte Bloom filter; after 160 features the next filter of the chain
begins. Two digests are compared by the overlap of their bits, less what chance
gives, relative to the fullest overlap possible: the mean over the filters of
the shorter chain of the best match in the longer one.

Defined cases: a null text counts as empty; a text without bytes has a digest
without filters; one of fewer than 64 bytes has itself as its only feature; two
digests without filters are alike (1), one with and one without are not (0).
Windows of entropy under 100 (runs of few symbols) are no features. Very long
texts are read in segments; an empty table gives an empty result; rows without a
doc_id, and rows of one doc_id, lie in one range; other columns are kept
(``fingerprint`` is replaced) or, in the comparison, not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import key_bounds, parts_for, range_of, text_bytes, with_fields

WINDOW = 64
RUN = 64
LEVELS = 1001
FLOOR = 100
POINTS = 16
BITS = 2048
PARTS = 5
FULL = 160
SEGMENT = 1 << 18
GAP = WINDOW + RUN
_OUT = 1023  # rank of what can't be chosen

_c = np.arange(WINDOW + 1)
_G = np.rint((1 << 20) * _c * np.log2(np.maximum(_c, 1))).astype(np.int64)  # whole numbers: sums don't depend on their order
_GROW = np.append(np.diff(_G), 0)
_MOST = int(_G[WINDOW])


def _entropies(b: np.ndarray) -> np.ndarray:
    """Level of the window that starts at each byte; the last 63 bytes start none."""
    n = len(b) - WINDOW + 1
    out = np.empty(max(n, 0), np.uint16)
    for a in range(0, n, SEGMENT):
        z = min(n, a + SEGMENT)
        out[a:z] = _segment(b[a : z + WINDOW - 1])
    return out


def _segment(b: np.ndarray) -> np.ndarray:
    n = len(b)
    order = np.argsort(b, kind="stable")
    key = (b[order].astype(np.int32) << 21) + order.astype(np.int32)
    after, before = np.ones(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes in the window that a byte opens, and before it
    for t in range(1, min(WINDOW, n)):
        near = (key[t:] - key[:-t]) < WINDOW
        if not near.any():
            break
        after[:-t] += near
        before[t:] += near
    own, prior = np.empty(n, np.uint8), np.empty(n, np.uint8)
    own[order], prior[order] = after, before
    first = np.bincount(b[:WINDOW], minlength=256)
    # the byte that leaves had `own` equals; the one that enters meets `prior`, less the leaving byte, which lies 64 back
    steps = _GROW[prior[WINDOW:]] - _GROW[own[: n - WINDOW].astype(np.int64) - 1]
    sums = np.concatenate(([_G[first].sum()], steps)).cumsum()
    return ((_MOST - sums) * 1000 // _MOST).astype(np.uint16)


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One array of all texts with gaps so wide that no run spans two texts; where each starts; lengths."""
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
    pad = bytes(GAP)
    starts = np.cumsum(lengths + GAP) - lengths
    return np.frombuffer(pad + pad.join(blobs) + pad, np.uint8), starts, lengths


def _windows(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """True at the bytes that open a window inside one text."""
    edge = np.zeros(n + 1, np.int8)
    some = lengths >= WINDOW
    np.add.at(edge, starts[some], 1)
    np.add.at(edge, starts[some] + lengths[some] - WINDOW + 1, -1)
    return np.cumsum(edge[:n], dtype=np.int8).astype(bool)


def _groups(blobs, size=SEGMENT):
    """Runs of texts of about ``size`` bytes together; a longer text stands alone."""
    at = total = 0
    for k, blob in enumerate(blobs):
        if total and total + len(blob) > size:
            yield at, k
            at, total = k, 0
        total += len(blob) + GAP
    if at < len(blobs):
        yield at, len(blobs)


def entropy_counts(blobs: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each level."""
    counts = np.zeros(LEVELS, np.int64)
    for a, z in _groups(blobs):
        b, starts, lengths = _joined(blobs[a:z])
        levels = _entropies(b)
        counts += np.bincount(levels[_windows(starts, lengths, len(levels))], minlength=LEVELS)
    return counts


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Place of each level from rarest to commonest; levels under the floor can't be chosen."""
    ranks = np.empty(LEVELS, np.int32)
    ranks[np.lexsort((np.arange(LEVELS), counts))] = np.minimum(np.arange(LEVELS), _OUT - 1)
    ranks[:FLOOR] = _OUT
    return ranks


def _popular(ranks: np.ndarray) -> np.ndarray:
    """Bytes whose windows have points enough, ascending."""
    n = len(ranks)
    points = np.zeros(n, np.int32)
    for a in range(0, n, SEGMENT):
        z = min(n, a + SEGMENT)
        part = ranks[a : z + RUN - 1]
        low = (part << 20) + np.arange(len(part), dtype=np.int32)
        for step in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-step], low[step:])
        low = low[: z - a]
        at = low[(low >> 20) < _OUT] & ((1 << 20) - 1)
        if len(at):
            got = np.bincount(at)
            points[a : a + len(got)] += got.astype(np.int32)
    return np.flatnonzero(points >= POINTS)


def _hash_parts(windows: np.ndarray) -> np.ndarray:
    """(features, 64) bytes to (features, 5) bit numbers."""
    words = np.ascontiguousarray(windows).view("<u8")
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h ^= words[:, k]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    shifts = np.arange(PARTS, dtype=np.uint64) * np.uint64(11)
    return ((h[:, None] >> shifts) & np.uint64(BITS - 1)).astype(np.int64)


def features(blobs: list[bytes], ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(byte positions, (features, 5) bit numbers) of each text's features, in the order of the text."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, z in _groups(blobs):
        b, starts, lengths = _joined(blobs[a:z])
        levels = _entropies(b)
        inside = _windows(starts, lengths, len(levels))
        at = _popular(np.where(inside, ranks[levels], _OUT).astype(np.int32))
        short = starts[(lengths > 0) & (lengths < WINDOW)]
        if len(short):
            at = np.sort(np.concatenate((at, short)))
        parts = _hash_parts(np.lib.stride_tricks.sliding_window_view(b, WINDOW)[at]) if len(at) else np.empty((0, PARTS), np.int64)
        cut = np.searchsorted(at, starts)
        out += [(at[i:j] - s, parts[i:j]) for i, j, s in zip(cut, [*cut[1:], len(at)], starts)]
    return out


def digest_of(parts: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of features, (filters, 256) bytes) from the features' bit numbers."""
    n = len(parts)
    bits = np.zeros((-(-n // FULL), BITS), np.uint8)
    bits[np.repeat(np.arange(n) // FULL, PARTS), parts.ravel()] = 1
    return n, np.packbits(bits, axis=1)


def digests(blobs: list[bytes], ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [digest_of(parts) for _, parts in features(blobs, ranks)]


def edited_digests(texts: list[tuple[bytes, int, bytes, tuple[np.ndarray, np.ndarray]]], ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Digests of ``blob[:cut] + end`` for each (blob, cut, end, features of blob): only what lies near the change is looked at again."""
    anew = [max(0, cut - WINDOW - RUN) for _, cut, _, _ in texts]
    whole = [len(blob[:cut]) + len(end) < WINDOW for blob, cut, end, _ in texts]
    begin = [0 if w else max(0, a - RUN) for a, w in zip(anew, whole)]
    again = features([blob[s:cut] + end for s, (blob, cut, end, _) in zip(begin, texts)], ranks)
    out = []
    for a, s, w, (_, _, _, (at, parts)), (new_at, new_parts) in zip(anew, begin, whole, texts, again):
        out.append(digest_of(new_parts if w or not a else np.concatenate((parts[at < a], new_parts[new_at + s >= a]))))
    return out


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Normalised overlap of two digests, 0 to 1."""
    one, two = sorted((a[1], b[1]), key=len)
    if not len(one):
        return float(not len(two))
    x, y = one.view("<u8"), two.view("<u8")
    px, py = np.bitwise_count(x).sum(1), np.bitwise_count(y).sum(1)
    total = 0.0
    step = max(1, 65_536 // len(y))
    for k in range(0, len(x), step):
        both = np.stack([np.bitwise_count(row & y).sum(1) for row in x[k : k + step]]).astype(float)
        chance = px[k : k + step, None] * py[None, :] / BITS
        room = np.minimum(px[k : k + step, None], py[None, :]) - chance
        total += np.clip((both - chance) / np.where(room > 0, room, 1), 0, 1).max(1).sum()
    return float(total / len(x))


def written_as(digest: tuple[int, np.ndarray]) -> str:
    """``features:filters in base64``."""
    return f"{digest[0]}:{base64.b64encode(digest[1].tobytes()).decode()}"


def corpus_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rarity ranks of the entropy levels over every window of every text. The driver gets at most 1001 counts."""

    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            total += entropy_counts([x.encode() for x in batch.column(0).drop_null().to_pylist()])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["level", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for level, n in rows:
        counts[level] = n
    return rarity_ranks(counts)


def fingerprints(docs: DataFrame, text: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """Every row of ``docs`` with its ``fingerprint`` (any such column is replaced). No shuffle besides the 1001 counts."""
    ranks = corpus_ranks(docs, text) if ranks is None else ranks
    rest = docs.drop("fingerprint")
    schema = with_fields(rest.schema, fingerprint="string")
    at = rest.columns.index(text)

    def apply(batches):
        for batch in batches:
            found = digests([(x or "").encode() for x in batch.column(at).to_pylist()], ranks)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([written_as(d) for d in found], pa.string())], [*batch.schema.names, "fingerprint"])

    return rest.mapInArrow(apply, schema)


_EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """Each text against an edited copy and against the next text in ascending doc_id (ties: by text; null doc_ids first; after the last, the first).

    The rows move once, into ranges of doc_id whose bounds are ids of the table:
    the row that opens a range is also sent to the range before it, so that no
    range needs another one's rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranks = corpus_ranks(docs) if ranks is None else ranks
    bounds = key_bounds(docs, "doc_id", parts_for(docs.sparkSession, text_bytes(docs)))
    n = max(1, len(bounds))
    here, opens = range_of("doc_id", bounds)
    no_id = F.col("doc_id").isNull()
    if docs.where(no_id).limit(1).count():  # then they come first, and close the circle
        opens = F.when(no_id, True).otherwise(opens & (F.col("doc_id") != F.lit(bounds[0]))) if bounds else F.lit(True)
    own, before = F.struct(F.col("here").alias("part"), F.lit(False).alias("tail")), F.struct(((F.col("here") + n - 1) % n).alias("part"), F.lit(True).alias("tail"))
    dealt = docs.withColumns({"here": here, "opens": opens}).withColumn("to", F.explode(F.when(F.col("opens"), F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select("to.part", "to.tail", "doc_id", "text").repartitionById(n, "part").sortWithinPartitions("part", "tail", F.asc_nulls_first("doc_id"), "text")

    def apply(batches):
        last = None  # (part, doc_id, text, features, digest) that waits for its next text
        for batch in batches:
            parts, tails, ids, texts = (batch.column(k).to_pylist() for k in range(4))
            pairs = []
            for part, tail, doc_id, text, found in zip(parts, tails, ids, texts, features([x.encode() for x in texts], ranks)):
                digest = digest_of(found[1])
                if last is not None and last[0] == part:
                    pairs.append((*last[1:], text, digest))
                last = None if tail else (part, doc_id, text, found, digest)
            kept = [p[1][: len(p[1]) - len(p[1]) // 4].encode() for p in pairs]
            ends = [p[4][: len(p[1]) // 4].encode() for p in pairs]
            changed = edited_digests([(k, len(k), e, p[2]) for k, e, p in zip(kept, ends, pairs)], ranks)
            blobs = [k + e for k, e in zip(kept, ends)]
            pairs = [(p[0], p[1], p[3], p[4], p[5]) for p in pairs]
            yield pa.RecordBatch.from_arrays([
                pa.array([p[0] for p in pairs], pa.int64()),
                pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in blobs], pa.string()),
                pa.array([written_as(p[2]) for p in pairs], pa.string()),
                pa.array([written_as(c) for c in changed], pa.string()),
                pa.array([likeness(p[2], c) for p, c in zip(pairs, changed)], pa.float64()),
                pa.array([likeness(p[2], p[4]) for p in pairs], pa.float64()),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(apply, _EDITS)
