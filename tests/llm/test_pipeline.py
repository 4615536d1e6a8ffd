import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from palimpsest.llm import queries

from .test_language import corpus

SF = "/root/testdata/sf0.001"


def test_stages_and_result_against_the_operators(spark, make, tmp_path):
    rows = corpus(90)
    copies = [(1000 + k, rows[k][1], rows[k][2], "copies") for k in range(5)]
    docs = make(rows + copies + [(2000, None, "aa", "s"), (2001, "12 34", "aa", "s"), (2002, "", None, None)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == list(range(90))
    processor = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        ids = processor.encode(texts[r.doc_id])
        assert r.ids == ids and r.matched and r.restored and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_odd_rows_and_further_columns(spark, make, tmp_path):
    rows = corpus(40)
    odd = [(None, rows[0][1], "aa", "s"), (3, rows[3][1], None, None), (3, rows[3][1], None, None), (700, None, None, None), (701, "", "aa", "s"), (702, "\u2461 \u00bd 12", "aa", "s")]
    clashing = dict.fromkeys(["id", "row", "text_", "__id", "__row", "__host", "__n", "__slot", "__text", "key", "mix_block", "score", "lang_pred", "shingles", "found"], "7")
    docs = make(rows + odd, clashing)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    held = docs
    for _, stage in pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == docs.columns and held.select("lang_pred", "mix_block", "__n").distinct().collect() == [(7, 7, 7)]
    kept = sorted((r.doc_id is None, r.doc_id, r.lang) for r in held.collect())
    assert [k[1] for k in kept] == [*range(40), None] and all(k[2] is not None for k in kept)
    assert len(pipeline.run(spark, str(tmp_path)).collect()) == 41
    make([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= n


@pytest.mark.parametrize("name, table", [("op5_mixing", "documents"), ("op10_main_text", "pages")])
def test_queries_against_sql(spark, name, table):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    expected = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert got.columns == expected.columns and sorted(map(tuple, got.collect())) == sorted(expected.fetchall())


def test_queries_cover_their_tables(spark):
    q = queries.queries()
    assert [name.split("_")[0] for name in q] == [f"op{k}" for k in range(1, 14)] and list(queries.oracle_sql()) == ["op5_mixing", "op10_main_text", "op11_collocations", "op13_fill_in_middle"]
    docs, n_pages = spark.read.parquet(f"{SF}/documents.parquet").count(), spark.read.parquet(f"{SF}/pages.parquet").count()
    for name in ("op1_fingerprints", "op2_simhash", "op3_language", "op4_token_files", "op9_token_counts", "op12_model_scores", "op13_fill_in_middle"):
        assert q[name](spark, SF).count() == docs
    assert q["op10_main_text"](spark, SF).count() == n_pages


def test_the_ids_are_in_the_order_of_the_mix(spark, make, tmp_path):
    from palimpsest.llm.mixing import mix_order

    rows = [(k, t, lang, ("web", "books")[k % 2]) for k, t, lang, *_ in corpus(90)]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    kept = spark.createDataFrame([r for r in rows if r[0] in {o.doc_id for o in out}], "doc_id long, text string, lang string, source string")
    expected = [r.doc_id for r in sorted(mix_order(kept, pipeline.TARGETS).collect(), key=lambda r: (r.mix_slot, r.mix_offset))]
    assert [r.mix_position for r in sorted(out, key=lambda r: r.mix_position)] == list(range(len(out)))
    assert [r.doc_id for r in sorted(out, key=lambda r: r.mix_position)] == expected != sorted(expected)


def test_places_in_many_files(spark, make, tmp_path):
    rows = [(k, "x" * (k % 7 * 300), "aa", "s") for k in range(400)]
    make(rows).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "d"))
    found = pipeline.in_file_order(spark, spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted((r.mix_position, r.doc_id) for r in found) == [(k, k) for k in range(400)]
