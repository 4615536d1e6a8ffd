import random
import zlib

import numpy as np

from palimpsest.llm import language as lang

from .conftest import ODD

STEMS = {"aa": "the and ing tion ou re st er".split(), "bb": "eau eux que ment é ç la".split(), "cc": "sch ung ein ü der pf ich".split()}


STRANGE = [*ODD, "\u2461 \u00bd", "\u00b2 _ 7", "\u2460a"]


def text_of(code, seed, n=60):
    r = random.Random(f"{code}{seed}")
    return " ".join("".join(r.choices(STEMS[code], k=r.randint(1, 4))) for _ in range(n))


def corpus(n=240):
    return [(k, text_of(code, k), code, f"src{k % 3}") for k in range(n) for code in [list(STEMS)[k % 3]]]


def test_held_out_accuracy_and_odd_rows(make):
    rows = corpus() + [(1000 + k, t, "aa" if k % 2 else None, "s") for k, t in enumerate(STRANGE)] + [(None, text_of("bb", 1), "bb", "s")]
    docs = make(rows, {"lang_pred": "1", "score": "'x'"})
    got = lang.predictions(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in corpus()}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    for k, t in enumerate(STRANGE):
        assert (by_id[1000 + k].lang_pred == "und") == (t is None or not any(x.isalpha() for x in t))
    assert all(0 <= r.score <= 1 for r in got) and by_id[None].lang_pred == "bb"


def test_held_out_rows_teach_nothing(make):
    rows = corpus(120)
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else c, s) for i, t, c, s in rows]
    a, b = (sorted(map(tuple, lang.predictions(make(r)).collect())) for r in (rows, changed))
    assert a == b


def test_model_is_sparse_and_calibrated(make):
    model = lang.fit(make(corpus(300)))
    assert model.langs == ["aa", "bb", "cc"] and (model.weights != 0).mean() < 0.2 and 0.05 <= model.temperature <= 20
    assert np.isclose(lang.scores(text_of("cc", 9), model).sum(), 1) and lang.scores(text_of("cc", 9), model).argmax() == 2


def test_whole_long_texts_count(make):
    model = lang.fit(make(corpus(300)))
    long = text_of("aa", 1, 2000) + " " + text_of("bb", 2, 40_000)
    assert model.langs[int(lang.scores(long, model).argmax())] == "bb"
    whole = np.concatenate([s for s in lang._pieces(lang._points(long))])
    at, share = lang.text_features(long)
    assert np.allclose(np.bincount(whole, minlength=lang.SLOTS)[at] / len(whole), share) and len(whole) == 3 * (len(long) + 4) - 3


def test_without_labels_or_rows(make):
    assert lang.predictions(make([])).collect() == []
    none = lang.predictions(make([(k, "abc", None, "s") for k in range(4)])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 4
    assert lang.known_language(make([(1, "abc", None, "s")])).count() == 1


def test_stage_keeps_clean_documents(make):
    docs = make(corpus() + [(900, None, "aa", "s"), (901, "1234 !!", "aa", "s")])
    kept = lang.known_language(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(240))
