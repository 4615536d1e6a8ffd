"""Token counts by rank-synchronous array merging.

For a byte-level BPE vocabulary, texts are cut where no token can reach across:
before a lone space between two other characters. Each distinct unit is split
into pre-tokens by the tokenizer's pattern, and all new pre-tokens of a batch
are held together as one ragged array of symbols. In each round every sequence
finds the lowest rank among its adjacent pairs and applies that merge to all its
places, left to right, at once; when no sequence has a pair left, the surviving
symbols are counted. Counts of units and of pre-tokens are remembered per Python
worker and begin anew beyond a bound.

The special strings of the vocabulary are one token each wherever a text holds
them, as is the library's default. Vocabularies of other kinds (``.model``
files, or other pre-tokenizers) are counted by their library.

Defined cases: a null text is empty and has no tokens; lone surrogates count as
'?', like in any UTF-8 column; equal texts have equal counts; a very long text is
a batch of its own, and what is long in it isn't remembered; an empty table gives
an empty result; other columns are kept (those of the results are replaced).
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import by_bytes, with_fields

#: Fixed value: the split of byte-level vocabularies.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_NONE = np.int64(1) << 60
#: Characters beyond which a pre-token or a run of them isn't kept after its batch.
LONG = 256


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(free)}


class RankMerger:
    """The merges of a byte-level vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        kind = given["pre_tokenizer"] or {}
        model = given["model"]
        self.fits = (
            model["type"] == "BPE" and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not given["normalizer"]
            and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("ignore_merges")
            and all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in given["added_tokens"])
        )
        if not self.fits:
            return
        vocab = model["vocab"]
        self.special = [t["content"] for t in given["added_tokens"]]
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        out = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        row = np.repeat(np.arange(len(words)), out)
        # the rank of each symbol with the one after it in the same sequence
        rank = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            inside = np.flatnonzero(row[1:] == row[:-1])
            rank[inside] = self._ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            least = np.minimum.reduceat(rank, begin)
            going = least < _NONE
            lengths = np.diff(np.append(begin, len(row)))
            out[row[begin[~going]]] = lengths[~going]
            keep = np.repeat(going, lengths)
            symbols, row, rank = symbols[keep], row[keep], rank[keep]
            low = np.repeat(least[going], lengths[going])
            if not len(symbols):
                break
            hit = rank == low
            # of equal symbols in a row every second pair merges: those at even distance from where the run of hits begins
            fresh = hit & np.concatenate(([True], ~hit[:-1]))
            at = np.arange(len(hit))
            since = at - np.maximum.accumulate(np.where(fresh, at, 0))
            hit &= since % 2 == 0
            symbols[hit] = self.merged[low[hit]]
            keep = np.concatenate(([True], ~hit[:-1]))
            changed = hit[keep]
            symbols, row, rank = symbols[keep], row[keep], rank[keep]
            # ranks change where a merged symbol is the left or the right one of a pair
            touched = changed | np.append(changed[1:], False)
            inside = np.flatnonzero(touched & np.append(row[1:] == row[:-1], False))
            rank[touched] = _NONE
            rank[inside] = self._ranks(symbols[inside], symbols[inside + 1])
        return out


class TokenCounter:
    """Counts of whole texts, by the method above or, for other vocabularies, by the library."""

    def __init__(self, path: str, most: int = 600_000):
        self.merger = RankMerger(path) if path.endswith(".json") else None
        self.most, self.units, self.words = most, {}, {}
        if self.merger and self.merger.fits:
            self.special = re.compile("|".join(map(re.escape, sorted(self.merger.special, key=len, reverse=True)))) if self.merger.special else None
            self.library = None
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            self.library = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: list(map(len, processor.encode(texts, num_threads=1)))

    def _learn(self, units: list[str]) -> None:
        """Units begin with their space, but for those that open a text."""
        split = [_PATTERN.findall(u) for u in units]
        new = [w for w in set().union(*split) if w not in self.words]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.words.update(zip(part, self.merger.counts([w.encode() for w in part]).tolist()))
        words = self.words
        for u, s in zip(units, split):
            self.units[u] = sum(words[w] for w in s)
        for w in new:
            if len(w) > LONG:
                del words[w]

    def counts(self, texts: list[str]) -> list[int]:
        if self.library:
            return self.library(texts)
        if len(self.units) > self.most:
            self.units = {}
        if len(self.words) > self.most:
            self.words = {}
        out, openings, pieces = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            for n, part in enumerate(self.special.split(text) if self.special else [text]):
                out[k] += n > 0
                if part:
                    first, *rest = _LONE_SPACE.split(part)
                    openings.append((k, first))
                    pieces.append((k, [" " + r for r in rest]))
        units = self.units
        new = {u for _, p in pieces for u in p if u not in units} | {u for _, u in openings if u not in units}
        if new:
            self._learn(list(new))
        for k, u in openings:
            out[k] += units[u]
        for k, p in pieces:
            out[k] += sum(map(units.__getitem__, p))
        for u in new:
            if len(u) > LONG:
                del units[u]
        return out


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Every row with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (columns of these names are replaced). No shuffle."""
    rest = docs.drop("n_bytes", "n_tokens", "over_limit")
    at = rest.columns.index(text)

    def apply(batches):
        if tokenizer not in _counters:
            _counters[tokenizer] = TokenCounter(tokenizer)
        counter = _counters[tokenizer]
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            n = [c for a, z in by_bytes(texts) for c in counter.counts(texts[a:z])]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([c > limit for c in n], pa.bool_()),
            ], [*batch.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return rest.mapInArrow(apply, with_fields(rest.schema, n_bytes="long", n_tokens="long", over_limit="boolean"))


def document_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return count_tokens(rows, tokenizer, limit).drop("text")
