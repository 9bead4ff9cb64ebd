"""The corpus pipeline: five stages over ``documents``, each one operator of ``emberframe.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows its predecessor kept, and its result is written and
read again as the next one's docs. All but the last return the columns of documents.

Rows are told apart by number, not by doc_id, so null and repeated ids do no harm; numbers hold while docs give their rows in the same
order each time they are read, as written tables do. What is found about few rows (their numbers, their spans) is broadcast behind
a count and joined by shuffling beyond it, so texts are not shuffled to drop or mark some of them. Columns beside those of
documents are carried along, whatever their names; empty documents give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import decontamination, jaccard_join, language_id, secrets, sentencepiece_bpe
from emberframe.llm.common import few, table, written
from emberframe.llm.queries import piece_model

#: The least share of a text's n-grams that its language must know.
MIN_LANGUAGE_SCORE = 0.2

#: Spans of all texts up to which they are broadcast.
BROADCAST_SPANS = 200_000


def _unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as it takes to be none of the columns'."""
    while name in docs.columns:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the number of each row, and that column's name."""
    name = _unused(docs, "_row_of_docs")
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language stay; texts without a letter, nulls and texts that no language knows go. Where no row names a language, all stay."""
    filters = language_id.learn(docs)
    if not filters.languages:
        return docs
    names = {c: f"_{n}" for n, c in enumerate(docs.columns)}
    judged = language_id.predict(docs.withColumnsRenamed(names), filters, names["text"])
    kept = judged.filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: the one with the smallest doc_id."""
    return jaccard_join.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share a window of words with the benchmark go; null and empty texts, which have no words, stay."""
    own, row = _numbered(docs)
    leaks = decontamination.hits(own, table(spark, sf_dir, "benchmark"), keep=(row,)).filter(F.size("places") > 0).select(row)
    return own.join(few(written(leaks, "pipeline-leaks")), row, "left_anti").drop(row)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts give way to a mark, and n_chars follows. Null and empty texts stay as they are."""
    own, row = _numbered(docs)
    model = secrets.train(secrets.random_strings(spark).unionByName(secrets.identifiers(docs)))
    spans = _unused(docs, "_spans")
    found = secrets.spans(own, model, keep=(row,)).filter(F.size("spans") > 0).select(row, F.col("spans").alias(spans))
    found = written(found, "pipeline-spans")
    small = (found.agg(F.sum(F.size(spans))).first()[0] or 0) <= BROADCAST_SPANS
    joined = own.join(F.broadcast(found) if small else found, row, "left")
    text = F.when(F.col(spans).isNotNull(), secrets.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, begin and end included, and the text decoded from them."""
    found = sentencepiece_bpe.encode(docs.select("doc_id", "lang", "source", "text"), piece_model())
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", languages),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("secrets", secret_spans),
    ("sentencepiece", tokens),
]

#: SQL can express neither the learned language filters nor the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
