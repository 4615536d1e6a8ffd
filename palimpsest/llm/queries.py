"""The queries of the training-data operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import collocations, fingerprints, hamming, infilling, language, linededup, mixing, scoring, sentencepieces, simhash, tokencounts, tokenfiles, wrappers
from palimpsest.llm.common import read_table, settle


#: Target weights of the mix; sources that aren't named have the least of these.
TARGETS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.075, "src4": 0.05, "src5": 0.025}

#: The mix by plain rules, block by block: of the released blocks the one of earliest deadline is next. Weights are in thousandths.
OP5_SQL = """
WITH RECURSIVE
targets(name, w) AS (VALUES ('src0', 200), ('src1', 100), ('src2', 100), ('src3', 75), ('src4', 50), ('src5', 25)),
numbered AS (
  SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS s,
    row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, ''))[1:15], doc_id NULLS FIRST) - 1 AS n
  FROM documents),
sources AS (
  SELECT s, CAST(ceil(count(*) / 16.0) AS BIGINT) AS blocks, coalesce(any_value(w), 25)::BIGINT AS w, row_number() OVER (ORDER BY s) AS k
  FROM numbered LEFT JOIN targets ON s = name GROUP BY s),
begun AS (SELECT list(s ORDER BY k) AS s, list(w ORDER BY k) AS w, list(blocks ORDER BY k) AS blocks, list(0::BIGINT ORDER BY k) AS none, sum(blocks)::BIGINT AS total FROM sources),
states AS (
  SELECT 0::BIGINT AS slot, 0::BIGINT AS begin, none AS dealt, none AS phase, 0::BIGINT AS chosen FROM begun WHERE total > 0
  UNION ALL
  SELECT slot + 1, CASE WHEN dealt[c] + 1 = blocks[c] THEN slot + 1 ELSE begin END,
    list_transform(dealt, lambda x, k: CASE WHEN k = c THEN x + 1 ELSE x END),
    CASE WHEN dealt[c] + 1 = blocks[c] THEN none ELSE list_transform(phase, lambda x, k: CASE WHEN k = c THEN x + 1 ELSE x END) END,
    c
  FROM (
    SELECT *, list_min(list_transform(list_filter(range(1, len(w) + 1), lambda k: dealt[k] < blocks[k] AND (phase[k] * share) // w[k] <= slot - begin),
      lambda k: {'deadline': ((phase[k] + 1) * share + w[k] - 1) // w[k], 'first': CASE WHEN phase[k] = 0 THEN 1 ELSE 0 END, 'i': phase[k], 'w': CASE WHEN phase[k] = 0 THEN -w[k] ELSE 0 END, 'k': k})).k AS c
    FROM (SELECT *, list_sum(list_transform(range(1, len(w) + 1), lambda k: CASE WHEN dealt[k] < blocks[k] THEN w[k] ELSE 0 END))::BIGINT AS share FROM states, begun WHERE slot < total))),
slots AS (SELECT s[chosen] AS s, dealt[chosen] - 1 AS block, slot - 1 AS slot FROM states, begun WHERE chosen > 0)
SELECT doc_id, source, block AS mix_block, slot AS mix_slot, CAST(n % 16 AS INTEGER) AS mix_offset
FROM numbered JOIN slots USING (s) WHERE n // 16 = block
"""


#: The articles of the given pages by their tags alone, which mark each of them. Character references are those that occur.
OP10_SQL = r"""
WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS h FROM pages),
plain AS (
  SELECT page_id, url, list_transform(string_split_regex(h, '</?(?:h1|h2|h3|p|ul|ol|li|div|blockquote)[^>]*>'), lambda x:
    trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS lines
  FROM articles),
whole AS (SELECT page_id, url, coalesce(array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)), '') AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM whole
"""


#: Phrases and their counts by joins of the words of each piece at adjacent places.
OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
o AS (SELECT p, lang, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
f1 AS (SELECT lang, w AS w1, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
f2 AS (SELECT a.lang, a.w AS w1, b.w AS w2, count(*) AS f FROM o a JOIN o b ON a.p = b.p AND b.i = a.i + 1 GROUP BY ALL),
f3 AS (SELECT a.lang, a.w AS w1, b.w AS w2, c.w AS w3, count(*) AS f FROM o a JOIN o b ON a.p = b.p AND b.i = a.i + 1 JOIN o c ON a.p = c.p AND c.i = a.i + 2 GROUP BY ALL),
c3 AS (SELECT * FROM f3 WHERE f >= 10),
s2 AS (
  SELECT x.lang, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * x.f * x.f) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM f2 x JOIN f1 l ON l.lang = x.lang AND l.w1 = x.w1 JOIN f1 r ON r.lang = x.lang AND r.w1 = x.w2
  WHERE x.f >= 10 AND NOT EXISTS (SELECT 1 FROM c3 WHERE c3.lang = x.lang AND c3.w1 = x.w1 AND c3.w2 = x.w2 AND 100 * c3.f >= 50 * x.f)
    AND NOT EXISTS (SELECT 1 FROM c3 WHERE c3.lang = x.lang AND c3.w2 = x.w1 AND c3.w3 = x.w2 AND 100 * c3.f >= 50 * x.f)),
k3 AS (
  SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3 AS phrase, x.f AS a, l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2,
    CAST((1000000::HUGEINT * x.f * x.f) // (l1.f::HUGEINT * r1.f) AS BIGINT) AS score1, CAST((1000000::HUGEINT * x.f * x.f) // (l2.f::HUGEINT * r2.f) AS BIGINT) AS score2
  FROM c3 x JOIN f1 l1 ON l1.lang = x.lang AND l1.w1 = x.w1 JOIN f2 r1 ON r1.lang = x.lang AND r1.w1 = x.w2 AND r1.w2 = x.w3
    JOIN f2 l2 ON l2.lang = x.lang AND l2.w1 = x.w1 AND l2.w2 = x.w2 JOIN f1 r2 ON r2.lang = x.lang AND r2.w1 = x.w3),
s AS (SELECT * FROM s2 UNION ALL SELECT lang, phrase, a, CASE WHEN score1 <= score2 THEN l1 ELSE l2 END, CASE WHEN score1 <= score2 THEN r1 ELSE r2 END, least(score1, score2) FROM k3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


#: The transformation by its statement: units by a regular expression, draws from the digest's hex digits.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, t, h, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
c AS (
  SELECT doc_id, t, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:least(c1, c2)], '') AS pre, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
    array_to_string(units[greatest(c1, c2) + 1:], '') AS suf
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(read_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(read_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_order(read_table(spark, sf_dir, "documents"), TARGETS)


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = settle(hamming.sign_codes(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return hamming.top_k(codes, codes.where("id % 100 = 0"), 10)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.document_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), runs=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.document_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.held_out_scores(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_fingerprints, op2_simhash, op3_language, op4_token_files, op5_mixing, op6_hamming_top_k, op7_sentencepiece,
        op8_line_dedup, op9_token_counts, op10_main_text, op11_collocations,
        op12_model_scores, op13_fill_in_middle,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The mix and the articles; the tests hold the others against brute force, round trips and held-out accuracy."""
    return {"op5_mixing": OP5_SQL, "op10_main_text": OP10_SQL, "op11_collocations": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
