"""Registered queries of this subpackage: each applies one operator to the whole of its table."""

import functools

import public_tokenizers
from pyspark.sql import functions as F

from skyseries.llm import (
    chat, conversation_repair, hard_negatives, html_mincut, jaccard_join, language_gru, line_dedup, packing, piece_nbest,
    quality, sql, token_counts, toxicity, va_topk,
)
from skyseries.llm.frames import ship, table

#: Vocabulary files; the operators take their paths as parameters.
PACKING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COUNTING_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scores = toxicity.scored(docs.select("doc_id", "text"), model)
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_counts.counts(table(spark, sf_dir, "documents"), COUNTING_VOCABULARY)


def op4_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), PACKING_TOKENIZER, with_ids=False)


def op5_sentencepiece(spark, sf_dir):
    return piece_nbest.segmentations(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op6_exact_topk(spark, sf_dir):
    vectors = va_topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return va_topk.top_k(vectors, vectors.where(F.col("vec_id") % va_topk.QUERY_STEP == 0))


def op7_quality_rules(spark, sf_dir):
    return quality.measures(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark, sf_dir):
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(turns.unionByName(extra)))


def op9_line_dedup(spark, sf_dir):
    cleaned = line_dedup.without_boilerplate(table(spark, sf_dir, "documents"), count_col="lines_dropped")
    return cleaned.select("doc_id", "text", "lines_dropped")


def op10_html_extraction(spark, sf_dir):
    return html_mincut.extracted(table(spark, sf_dir, "pages"))


def op11_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labelled = language_gru.predicted(docs.select("doc_id", "text"), language_gru.train(docs))
    return labelled.select("doc_id", language_gru.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_hard_negative_mining(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = hard_negatives.integer_rows(hard_negatives.moved_labels(vectors))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % hard_negatives.ANCHOR_STEP == 0)


def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.digests(conversation_repair.repaired(conversation_repair.damaged(table(spark, sf_dir, "conversations"))))


def _with_code(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        return query(ship(spark), sf_dir)

    return run


QUERIES = {
    query.__name__: (_with_code(query), text)
    for query, text in (
        (op1_toxicity, None),
        (op2_ngram_jaccard_join, sql.NEAR_DUPLICATES),
        (op3_token_counts, None),
        (op4_packing, None),
        (op5_sentencepiece, None),
        (op6_exact_topk, sql.VECTOR_TOP_K),
        (op7_quality_rules, sql.QUALITY),
        (op8_chat_formatting, sql.CHAT),
        (op9_line_dedup, sql.LINE_DEDUP),
        (op10_html_extraction, None),
        (op11_language_id, None),
        (op12_hard_negative_mining, sql.HARD_NEGATIVES),
        (op13_conversation_repair, sql.CONVERSATION_REPAIR),
    )
}
