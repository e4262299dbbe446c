"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tabprep.llm import (
    alignment, deobfuscation, forest, language, maxent, mixing, near, packing, preference, ranking, repair, repetition, whitening,
)
from tabprep.llm.common import crc_remainder, table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = " ".join(sql.split())
        return fn

    return add


@query()
def op1_projection_forest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return forest.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations),
  b AS (SELECT conv_id, arg_max(text, turn) AS other FROM c WHERE role = 'assistant' AND turn < last GROUP BY conv_id),
  t AS (SELECT c.conv_id, turn, role, text, CASE WHEN turn = last THEN coalesce(other, '') ELSE text END AS text_r
    FROM c LEFT JOIN b USING (conv_id) WHERE last IS NULL OR turn <= last),
  k AS (SELECT conv_id, coalesce(min(CASE WHEN text <> text_r THEN turn END), max(turn) + 1) AS cut FROM t GROUP BY conv_id),
  s AS (SELECT t.*, cut, '<|' || role || '|>' || chr(10) || text || chr(10) AS c, '<|' || role || '|>' || chr(10) || text_r || chr(10) AS r
    FROM t JOIN k USING (conv_id)),
  m AS (SELECT *, sum(CASE WHEN turn >= cut THEN length(c) ELSE 0 END) OVER w AS ce, sum(CASE WHEN turn >= cut THEN length(r) ELSE 0 END) OVER w AS re
    FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS pair_id, count(*) FILTER (turn < cut) AS n_common,
  coalesce(string_agg(c, '' ORDER BY turn) FILTER (turn < cut), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY turn) FILTER (turn >= cut), '') AS chosen,
  coalesce(string_agg((ce - length(text) - 1)::BIGINT || '-' || ce::BIGINT, ';' ORDER BY turn) FILTER (turn >= cut AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(r, '' ORDER BY turn) FILTER (turn >= cut), '') AS rejected,
  coalesce(string_agg((re - length(text_r) - 1)::BIGINT || '-' || re::BIGINT, ';' ORDER BY turn) FILTER (turn >= cut AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY conv_id""")
def op2_preference_format(spark, sf_dir):
    return preference.preference_pairs(preference.own_reply_pairs(table(spark, sf_dir, "conversations")))


@query()
def op3_bayes_minhash(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query()
def op4_suffix_repetition(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.apply_rules(docs).drop("text")


@query()
def op5_repair_ids(spark, sf_dir):
    path = repair.id_file_folder(spark)
    repair.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return repair.read_ids(spark, path)


@query()
def op9_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op6_hashed_maxent(spark, sf_dir):
    return maxent.score(table(spark, sf_dir, "documents"), crc_remainder("doc_id", 7) == 2)


#: Domains are the languages of labelled documents; targets are their shares of all tokens.
LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


@query()
def op7_soft_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return mixing.mixing_rates(docs, labelled, LANGUAGES)


@query()
def op8_pairwise_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_remainder("doc_id", 4) != 2)
    rows = ranking.measured(docs)
    scored = ranking.fit_measured(rows, labels).score_measured(rows)
    return scored.select(
        "doc_id", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query()
def op10_deobfuscated_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_remainder("doc_id", 3) != 1)
    model, _ = deobfuscation.learn_words(docs, labels)
    rows = model.measured(docs)
    scored = model.fit_measured(rows, labels).score_measured(rows)
    return scored.select(
        "doc_id", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query()
def op11_arrow_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op12_output_codes_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    plan = language.fit(docs.filter(crc_remainder("doc_id", 3) != 1))
    return plan.predict(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous",
    )


@query()
def op13_spectrum_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
