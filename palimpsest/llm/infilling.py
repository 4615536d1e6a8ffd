"""Fill-in-middle transformation with content-defined chunk memoization.

A text's units are runs of ASCII letters and single other characters. Two numbers
drawn from a hash of the document's id say after how many units its prefix and its
middle end; the parts are written in the order prefix, suffix, middle (``psm``) or
suffix, prefix, middle (``spm``), each after a mark, or the text stays ``plain``.

To find the cuts a text isn't matched unit by unit. A polynomial hash that rolls
over ``WINDOW`` bytes cuts it into chunks where the content says so, so that
passages which documents share give the same chunks wherever they stand. A chunk
met before, which its whole content verifies, has its summary in a cache: units,
characters, and whether it begins and ends with a letter. The counts of a text are
the sums over its chunks, less one unit wherever a run of letters goes on over a
boundary; the running sums say in which chunk a cut lies, and only that chunk is
looked at unit by unit. The cache is one of a Python worker, bounded by bytes.

Defined cases: a null text is empty, and an empty text is plain; a null doc_id
counts as one without digits; equal rows have equal results; a text of any length
is taken whole, in chunks of ``LEAST`` to ``MOST`` bytes (a last one may be
shorter); an empty table gives an empty result; other columns are kept, those of
the results' names are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import with_fields

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes that the hash rolls over, and of the smallest and largest chunk; a boundary is expected every 2**BITS bytes.
WINDOW, LEAST, MOST, BITS = 32, 64, 8192, 9
_FACTOR = 0x9E3779B1  # odd, so that no byte of the window loses its weight
_GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_BEGINS = np.array([not 128 <= b < 192 for b in range(256)])  # a byte that begins a character


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the (up to) ``WINDOW`` bytes that end at each place, by doubling the width."""
    h, width, factor = _GEAR[data], 1, _FACTOR
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] * np.uint32(factor)
        h, width, factor = wider, 2 * width, factor * factor & 0xFFFFFFFF
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of a text end, always between characters."""
    size = len(data)
    marks = (np.flatnonzero(rolling_hash(data) >> np.uint32(32 - BITS) == 0) + 1).tolist()
    out, last, k = [], 0, 0
    while size - last > LEAST:
        k = bisect_left(marks, last + LEAST, k)
        end = min(marks[k] if k < len(marks) else size, last + MOST)
        while end < size and not _BEGINS[data[end]]:
            end += 1
        out.append(end)
        last = end
    if last < size:
        out.append(size)
    return out


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Where units begin, the first of them at 0 even if it goes on from before."""
    letter = _LETTER[data]
    fresh = letter.copy()
    fresh[1:] &= ~letter[:-1]
    return np.flatnonzero(fresh | (_BEGINS[data] & ~letter))


class Chunks:
    """Summaries of chunks by their content."""

    def __init__(self, most: int = 48 << 20):
        self.most, self.held, self.known, self.hits = most, 0, {}, 0

    def summary(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        """(units, characters, begins with a letter, ends with a letter)."""
        found = self.known.get(chunk)
        if found is None:
            data = np.frombuffer(chunk, np.uint8)
            found = len(unit_starts(data)), int(np.count_nonzero(_BEGINS[data])), bool(_LETTER[data[0]]), bool(_LETTER[data[-1]])
            if self.held > self.most:
                self.known, self.held = {}, 0
            self.known[chunk] = found
            self.held += len(chunk) + 200
        else:
            self.hits += 1
        return found

    def measured(self, text: bytes) -> Measured:
        data = np.frombuffer(text, np.uint8)
        ends = chunk_ends(data)
        units, chars, joins = [0], [0], []
        begin, before = 0, False
        for end in ends:
            n, c, opens, closes = self.summary(text[begin:end])
            joined = before and opens
            joins.append(joined)
            units.append(units[-1] + n - joined)
            chars.append(chars[-1] + c)
            begin, before = end, closes
        return Measured(data, [0, *ends], units, chars, joins)


class Measured:
    """A text with the running counts of its chunks."""

    def __init__(self, data, bounds, units, chars, joins):
        self.data, self.bounds, self.units, self.chars, self.joins = data, bounds, units, chars, joins
        self.n = units[-1]

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, characters) of the first ``units`` units."""
        if units >= self.n:
            return len(self.data), self.chars[-1]
        k = bisect_left(self.units, units + 1) - 1  # the chunk in which the next unit begins
        chunk = self.data[self.bounds[k] : self.bounds[k + 1]]
        at = int(unit_starts(chunk)[units - self.units[k] + self.joins[k]])
        return self.bounds[k] + at, self.chars[k] + int(np.count_nonzero(_BEGINS[chunk[:at]]))


_chunks = Chunks()


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers of 32 bits from a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def transformed(text: bytes, doc_id: int | None, seed: str, applied: int, swapped: int, chunks: Chunks) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    m = chunks.measured(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= applied or any(mark.encode() in text for mark in MARKS):
        return m.n, "plain", None, None, text
    low, high = sorted((h1 % (m.n + 1), h2 % (m.n + 1)))
    (a, a_chars), (b, b_chars) = m.cut(low), m.cut(high)
    p, s, i = (mark.encode() for mark in MARKS)
    spm = h4 % 100 < swapped
    head, tail = p + text[:a], s + text[b:]
    return m.n, "spm" if spm else "psm", a_chars, b_chars - a_chars, (tail + head if spm else head + tail) + i + text[a:b]


def fill_in_middle(docs: DataFrame, seed: str = "1", applied: int = 90, swapped: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``. Of 100 texts ``applied`` are transformed, and ``swapped`` of 100 of these put the suffix first. No shuffle."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    rest = docs.drop(*names)
    id_at, text_at = rest.columns.index(doc_id), rest.columns.index(text)

    def apply(batches):
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            rows = [transformed(t or b"", k, seed, applied, swapped, _chunks) for t, k in zip(texts, batch.column(id_at).to_pylist())]
            n, form, prefix, middle, output = (list(c) for c in zip(*rows)) if rows else ([],) * 5
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return rest.mapInArrow(apply, with_fields(rest.schema, n="long", form="string", prefix_chars="long", middle_chars="long", output="string"))


def restored(form: str = "form", output: str = "output") -> F.Column:
    """The text that an output was made from, found by its marks."""
    p, s, m = (f"instr({output}, '{mark}')" for mark in MARKS)
    return F.expr(f"""CASE {form}
        WHEN 'psm' THEN concat(substring({output}, 4, {s} - 4), substring({output}, {m} + 3), substring({output}, {s} + 3, {m} - {s} - 3))
        WHEN 'spm' THEN concat(substring({output}, {p} + 3, {m} - {p} - 3), substring({output}, {m} + 3), substring({output}, 4, {p} - 4))
        ELSE {output} END""")


def digests(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``, of the outputs and of the texts rebuilt from them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = fill_in_middle(rows, **options)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
