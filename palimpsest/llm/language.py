"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are runs of one to three characters of the lower-cased whole text,
hashed into ``1 << HASH_BITS`` slots. A feature's value is its share of the
text's n-grams times its inverse document frequency, which is counted over all
training texts. The model is fitted by follow-the-regularised-leader with L1 and
L2 penalties, which leaves most weights zero, on a bounded sample of labelled
rows (``max_rows``, dealt evenly over the labels, drawn by a hash of the row);
a fifth of the sample is held back to fit the temperature that calibrates the
probabilities.

Defined cases: a null text or one without a letter (digits in circles and the
like are none) is ``und`` with score 0, as is every text if there was no label to
learn from; rows with a null label teach nothing; repeated rows are answered each;
a row without a doc_id counts as having the id ''; a very long text is read in
pieces; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import with_fields

HASH_BITS = 16
SLOTS = 1 << HASH_BITS
ORDERS = 3
SCALE = 64.0
SEGMENT = 1 << 17
_LETTER = regex.compile(r"\p{L}")
_MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # (slots, languages): what one n-gram adds to the logits, divided by the number of n-grams
    bias: np.ndarray
    temperature: float


def _slots(points: np.ndarray, order: int) -> np.ndarray:
    """Slot of the n-gram that ends at each character; ``order`` is 1 to 3."""
    h = points * np.uint32(_MIX[0])
    for back in range(1, order):
        h[back:] = (h[back:] ^ (points[:-back] * np.uint32(_MIX[back]))) * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    h *= np.uint32(_MIX[order - 1])
    return h >> np.uint32(32 - HASH_BITS)


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two spaces."""
    return np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(points: np.ndarray):
    """Slots of all n-grams, in pieces of bounded size."""
    for a in range(0, len(points), SEGMENT):
        back = min(a, ORDERS - 1)
        part = points[a - back : a + SEGMENT]
        for order in range(1, ORDERS + 1):
            yield _slots(part, order)[max(back, order - 1) if not a else back :]


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, shares) of one text."""
    counts, total = np.zeros(SLOTS, np.int64), 0
    for slots in _pieces(_points(text)):
        counts += np.bincount(slots, minlength=SLOTS)
        total += len(slots)
    at = np.flatnonzero(counts)
    return at, counts[at] / total


def _document_counts(batches):
    seen, counts, n = np.zeros(SLOTS, bool), np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for slots in _pieces(_points(text)):
                seen[slots] = True
            at = np.flatnonzero(seen)
            counts[at] += 1
            seen[at] = False
            n += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], n))], ["slot", "n"])


def _ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """(classes, slots + 1) weights; the last slot is the bias and free of penalties."""
    z, n = np.zeros((classes, SLOTS + 1)), np.zeros((classes, SLOTS + 1))

    def weights(at):
        w = -(np.sign(z[:, at]) * np.maximum(np.abs(z[:, at]) - l1, 0)) / ((beta + np.sqrt(n[:, at])) / alpha + l2)
        w[:, -1] = -z[:, SLOTS] / ((beta + np.sqrt(n[:, SLOTS])) / alpha)
        return w

    order = np.arange(len(rows))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for k in order:
            label, at, x = rows[k]
            w = weights(at)
            p = _softmax(w @ x)
            p[label] -= 1
            g = p[:, None] * x
            root = np.sqrt(n[:, at] + g * g)
            z[:, at] += g - (root - np.sqrt(n[:, at])) / alpha * w
            n[:, at] = root * root
    return weights(np.arange(SLOTS + 1))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of least log loss, by golden sections of its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    a, z, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        b, c = z - r * (z - a), a + r * (z - a)
        a, z = (a, c) if loss(b) < loss(c) else (b, z)
    return float(np.exp((a + z) / 2))


def fit(labelled: DataFrame, max_rows: int = 3000, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0001) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of ``labelled``. At most about ``max_rows`` rows, drawn evenly from the labels, come to the driver, as sparse features."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()
    if not counts:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32), np.zeros(0), 1.0)
    langs = sorted(r["lang"] for r in counts)
    quota = max(1, max_rows // len(langs))
    frequency, documents = np.zeros(SLOTS), 1
    for slot, n in rows.select("text").mapInArrow(_document_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        if slot < 0:
            documents = n
        else:
            frequency[slot] = n
    idf = np.log((1 + documents) / (1 + frequency)) + 1

    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, quota / r["count"])))])
    draw = (F.xxhash64("lang", "text").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))

    def sparse(batches):
        for batch in batches:
            found = [text_features(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(1),
                pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                pa.array([s.astype(np.float32) for _, s in found], pa.list_(pa.float32())),
            ], ["lang", "at", "share"])

    sample = rows.where(draw < share[F.col("lang")]).dropDuplicates(["lang", "text"]).mapInArrow(sparse, "lang string, at array<int>, share array<float>").toArrow()
    number = {x: k for k, x in enumerate(langs)}
    data = []
    for lang, at, shares in zip(sample["lang"].to_pylist(), sample["at"], sample["share"]):
        at = np.asarray(at.values)
        data.append((number[lang], np.append(at, SLOTS), np.append(np.asarray(shares.values) * idf[at] * SCALE, 1.0)))
    data.sort(key=lambda r: (r[0], len(r[1]), r[1].tolist(), r[2].tolist()))  # whatever order the rows came in
    training, calibration = [r for k, r in enumerate(data) if k % 5 or len(data) < 10], data[::5] if len(data) >= 10 else []
    w = _ftrl(training, len(langs), epochs, alpha, beta, l1, l2)
    logits = np.array([w[:, at] @ x for _, at, x in calibration]).reshape(-1, len(langs))
    t = _temperature(logits, np.array([r[0] for r in calibration], np.int64))
    return LanguageModel(langs, np.ascontiguousarray((w[:, :SLOTS] * idf * SCALE).T.astype(np.float32)), w[:, SLOTS], t)


def scores(text: str, model: LanguageModel) -> np.ndarray:
    """Calibrated probabilities of the learned languages for one whole text."""
    sums, total = np.zeros(len(model.langs)), 0
    counts = np.zeros(SLOTS, np.int64) if len(text) > SLOTS // 8 else None
    for slots in _pieces(_points(text)):
        total += len(slots)
        if counts is None:
            sums += model.weights[slots].sum(0, dtype=np.float64)
        else:
            counts += np.bincount(slots, minlength=SLOTS)
    if counts is not None:
        sums = counts @ model.weights.astype(np.float64)
    return _softmax((sums / total + model.bias) / model.temperature)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Every row with ``lang_pred`` and ``score`` (such columns of the input are replaced)."""
    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        model = held.value
        for batch in batches:
            found = []
            for x in batch.column(at).to_pylist():
                if x is None or not model.langs or not _LETTER.search(x):
                    found.append(("und", 0.0))
                else:
                    p = scores(x, model)
                    found.append((model.langs[int(p.argmax())], float(p.max())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(apply, with_fields(rest.schema, lang_pred="string", score="double"))


def held_out() -> F.Column:
    """Rows that nothing is learned from: crc32 of the doc_id's digits, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, by a model that has seen only rows that aren't held out."""
    model = fit(docs.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, model).drop("text")


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that some learned language explains with probability ``least`` or more; columns as given, but a null ``lang`` becomes the language found. Without any label nothing is rejected."""
    model = fit(docs.where(~held_out()))
    if not model.langs:
        return docs
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    kept = identify(own, model).where(F.col("score") >= least)
    return kept.select(*[F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias("lang") if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
