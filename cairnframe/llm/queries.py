"""The registered queries of the operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The tokenizer's model file; read by the driver, sent to the executors.
PIECES = os.environ.get("CAIRNFRAME_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_sentencepiece_transducer(spark, sf_dir, model=PIECES):
    from .pieces import encode

    with open(model, "rb") as f:
        return encode(spark, _docs(spark, sf_dir), f.read())


def op2_quality_perplexity(spark, sf_dir):
    from .quality import rate

    return rate(spark, _docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op3_tag_path_text(spark, sf_dir):
    from .html import extract_pages

    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_language_bitmasks(spark, sf_dir):
    from .langid import held_out, learn, predict

    docs = _docs(spark, sf_dir)
    filters = learn(spark, docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(spark, docs, filters).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_jaccard_components(spark, sf_dir):
    from .jaccard import join

    return join(spark, _docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_url_templates(spark, sf_dir):
    from .urls import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "template")


def op7_simhash_leaks(spark, sf_dir):
    from .leaks import leaks

    return leaks(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_vector_sharding(spark, sf_dir):
    from .sharding import shard

    out = shard(spark, _docs(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_repeated_passages(spark, sf_dir):
    from .substrings import remove_repeats

    found = remove_repeats(spark, _docs(spark, sf_dir), length=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_pii_spans(spark, sf_dir):
    from .pii import KINDS, find

    line = lambda which: F.concat_ws(
        ",",
        *(
            F.when(F.size(f"{which}_{k}") > 0, F.expr(f"transform(sequence(0, size({which}_{k}) - 2, 2), i -> concat('{k}:', {which}_{k}[i], ':', {which}_{k}[i + 1]))"))
            for k in KINDS
        ),
    )
    return find(_docs(spark, sf_dir)).select(
        "doc_id",
        *((F.size(f"base_{k}") / 2).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(line("base").cast("binary"), 256).alias("base_sha256"),
        line("all").alias("spans"),
    )


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Words, and the words in lower case (A-Z).
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TEXT = "coalesce(text, '')"
_LOWER = f"translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets, all pairs that share a shingle, links, and what is reached over links.
_OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS x FROM w),
u AS (SELECT doc_id, len(x) AS n, unnest(x) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS same FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * same >= 80 * (an + bn - same)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.x) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN reach r ON r.a = s.doc_id GROUP BY ALL
"""

#: All windows of 20 words, those that began before, and the words that none of them covers.
_OP9 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(_TEXT)} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(20)) AS k FROM rep)),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
left_over AS (SELECT word.doc_id, string_agg(word.x, ' ' ORDER BY word.p) AS kept, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over ON w.doc_id = left_over.doc_id
"""

#: The given pages hold one article each, of headings, paragraphs, line breaks and bold text: what stands in it, block by block.
_OP3 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS inside FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(inside, '</?b>', '', 'g'), '</?(?:h1|p)>|<br>'),
      lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


def oracle_sql():
    """What SQL can express; the other queries are held against brute force, round trips or held-out accuracy in tests/llm."""
    return {"op3_tag_path_text": _OP3, "op5_jaccard_components": _OP5, "op9_repeated_passages": _OP9}
