"""The queries opN_<name> over the given tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import decontamination, jaccard_join, language_id, quality_classifier, quality_rules, secrets, sentencepiece_bpe, token_files, toxicity, url_filter
from emberframe.llm.common import fold, hash_sample, scratch, table
from emberframe.llm.oracles import ORACLE_SQL as ORACLE_SQL

#: The tokenizer that operators 2 and 10 use where no other is given.
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; rows of fold 0 of 5 and rows without id teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 5) == 0)
    filters = language_id.learn(docs.filter("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document, counted in flat token files written from all documents."""
    return token_files.counts(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model(), scratch(spark, "tokens"))


#: Labelled rows that operator 9 learns from, at most; operator 3 counts all. Up to BROADCAST_LABELS labels are broadcast, so
#: that texts are not shuffled; more are joined by shuffling.
QUALITY_ROWS, BROADCAST_LABELS = quality_classifier.ROWS_MOST, 1_000_000


def _labelled(spark: SparkSession, sf_dir: str, label: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with held_out, and the labelled ones that may be learned from, at most about ``most`` if given."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 4) == 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label")).filter("label is not null").filter(fold("doc_id", 4) != 2).distinct()
    if most is not None:
        labels = hash_sample(labels, "doc_id", most)
    few = (labels.count() if most is None else most) <= BROADCAST_LABELS
    return docs, docs.filter("not held_out").join(labels.hint("broadcast" if few else "merge"), "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows of fold 2 of 4 and rows without id teach nothing."""
    docs, known = _labelled(spark, sf_dir, "toxic")
    found = toxicity.score(docs, toxicity.learn(known))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and its host's trust and distrust."""
    found = url_filter.judge(table(spark, sf_dir, "pages"))
    return found.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.random_strings(spark).unionByName(secrets.identifiers(docs)))
    found = secrets.spans(docs, model)
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.RULES]
    return found.select("doc_id", *counts, F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    return jaccard_join.join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.withColumn("n_hit", decontamination.n_hit(F.col("places")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document."""
    found = quality_rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows of fold 2 of 4 and rows without id teach nothing."""
    docs, known = _labelled(spark, sf_dir, "quality", QUALITY_ROWS)
    found = quality_classifier.score(docs, quality_classifier.learn(known))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), piece_model())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_secrets": op5_secrets,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality": op9_quality,
    "op10_sentencepiece": op10_sentencepiece,
}
