"""Operator 2: token counts of flat, unindexed token files by a separator scan.

A token file is a row of little-endian unsigned integers and nothing else; an end-of-document id closes each document. The scan cuts
files into blocks of whole tokens, searches each block for the id in one vectorised comparison, and keeps the places found. What a
block's first separator closes may begin in any block before: a prefix scan over a file's blocks carries the tokens that are still
open and the number of documents so far. The prefix scan sees a row of four numbers for each block, never the places, so a file of
any size can be cut; its results are joined back to the blocks.

Files on paths that each machine mounts (no scheme, or ``file:``) are read block by block; files elsewhere through Spark's
reader of binary files, which holds one file of at most 2 GB at a time and cuts it in its row.

``write`` makes such files with Spark's own committed writer, one for each partition, so lost executors leave no torn file: rows
are the tokens' bytes and the line separator is the end-of-document id.

An empty document is a separator alone and has 0 tokens. Tokens after a file's last separator are a document with ``closed``
false. Empty files have no documents. A file whose size is not a whole number of tokens is an error. Null texts are empty documents,
repeated rows are documents of their own, and an empty table writes no documents. ``counts`` takes the id and the text alone, so
names cannot clash.
"""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.llm.common import by_batches, few, written
from emberframe.llm.sentencepiece_bpe import Encoder, PieceModel

#: Tokens of a block, and bytes of a token.
BLOCK_TOKENS, WIDTH = 1 << 20, 2


def write(docs: DataFrame, model_path: str, path: str, text: str = "text") -> int:
    """Writes the ids of each of docs, in order, to part files under path. Returns the end-of-document id. Null texts are empty documents."""
    import pandas as pd

    model = PieceModel(model_path)
    held = docs.sparkSession.sparkContext.broadcast(model)
    if model.n > 1 << (8 * WIDTH):
        raise ValueError("the model's ids need wider tokens")

    def encode(batches):
        encoder = Encoder(held.value)
        for pdf in batches:
            yield pd.DataFrame({"value": [ids.astype(f"<u{WIDTH}").tobytes() for ids in encoder.encode([t if isinstance(t, str) else None for t in pdf["text"]])]})

    separator = model.eos.to_bytes(WIDTH, "little").decode("latin-1")
    rows = by_batches(docs.select(F.col(text).cast("string").alias("text")), encode, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 0).option("compression", "none").text(path)
    return model.eos


def _local(path: str) -> str | None:
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _places(tokens: np.ndarray, separator: int, base: int) -> np.ndarray:
    return np.flatnonzero(tokens == separator) + base


def blocks(spark: SparkSession, path: str, separator: int, *, block_tokens: int = BLOCK_TOKENS, width: int = WIDTH, pattern: str = "part-*") -> DataFrame:
    """file, block, base (its first token's place), n (its tokens), ends (places of the separators in it)."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    size = block_tokens * width
    kind = f"<u{width}"
    cut = files.filter("length > 0").select(F.col("path").alias("file"), "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("block", "at"))

    def found(pdf, parts):
        rows = []
        for (file, block, at), data in zip(pdf[["file", "block", "at"]].itertuples(index=False), parts):
            if len(data) % width:
                raise ValueError(f"{file}: not a whole number of tokens")
            tokens = np.frombuffer(data, dtype=kind)
            rows.append((file, block, at // width, len(tokens), _places(tokens, separator, at // width)))
        return pd.DataFrame(rows, columns=["file", "block", "base", "n", "ends"])

    def by_range(batches):
        def read(file, at):
            with open(_local(file), "rb") as f:
                f.seek(at)
                return f.read(size)

        for pdf in batches:
            for k in range(0, len(pdf), 8):
                part = pdf.iloc[k : k + 8]
                yield found(part, [read(f, a) for f, a in zip(part["file"], part["at"])])

    def whole(batches):
        for pdf in batches:
            yield found(pdf, pdf["data"])

    schema = "file string, block int, base long, n long, ends array<long>"
    some = files.select("path").head()
    if some is None or _local(some["path"]) is not None:
        spread = spark.sparkContext.defaultParallelism * 4
        return by_batches(cut.repartition(spread, "file", "block"), by_range, schema)
    parts = F.expr(f"transform(sequence(0L, length - 1, {size}L), at -> struct(at, substring(content, cast(at as int) + 1, {size}) as data))")
    data = files.filter("length > 0").select(F.col("path").alias("file"), F.posexplode(parts).alias("block", "part")).select("file", "block", "part.at", "part.data")
    return by_batches(data, whole, schema)


def scan(spark: SparkSession, path: str, separator: int, **options) -> DataFrame:
    """file, document (from 0 in its file), start (its first token's place), n_tokens, closed."""
    found = written(blocks(spark, path, separator, **options), "token-blocks")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    closes = F.col("closed") > 0
    blank = found.select("file", "block", "n", F.size("ends").alias("closed"), F.when(F.size("ends") > 0, F.col("base") + F.col("n") - F.element_at("ends", -1) - 1).otherwise(F.col("n")).alias("opened"))
    seen = blank.withColumn("documents", F.coalesce(F.sum("closed").over(before), F.lit(0))).withColumn("run", F.sum(closes.cast("int")).over(upto))
    after = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = seen.withColumn("after", F.sum("opened").over(after))
    seen = seen.withColumn("carry", F.lag("after", 1, 0).over(order)).withColumn("last", F.lead("block").over(order).isNull())
    summary = written(seen.select("file", "block", "documents", "after", "carry", "last"), "token-summary")
    whole = found.join(few(summary), ["file", "block"])
    closed = whole.select("file", "documents", F.col("ends").alias("e"), (F.col("base") - F.col("carry")).alias("first"), F.posexplode("ends").alias("k", "end")).select(
        "file", (F.col("documents") + F.col("k")).alias("document"), F.when(F.col("k") == 0, F.col("first")).otherwise(F.get("e", F.col("k") - 1) + 1).alias("start"), "end", F.lit(True).alias("closed")
    )
    end = F.col("base") + F.col("n")
    rest = whole.filter("last and after > 0").select("file", (F.col("documents") + F.size("ends")).alias("document"), (end - F.col("after")).alias("start"), end.alias("end"), F.lit(False).alias("closed"))
    return closed.union(rest).select("file", "document", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed")


def counts(docs: DataFrame, model_path: str, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id and n_tokens of each of docs: docs are written as token files under path, which are then scanned. docs must give its rows in the same order each time it is read, as a written table does."""
    spark = docs.sparkSession
    separator = write(docs, model_path, path, text)
    found = scan(spark, path, separator)
    part = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long")
    numbers = found.select((F.shiftleft(part, 33) + F.col("document")).alias("row"), "n_tokens")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column))
    missing = F.raise_error(F.lit("a document is not in the token files"))
    # both sides have a row for each document: no side is small
    return rows.join(numbers.hint("merge"), "row", "left").select(id_column, F.coalesce("n_tokens", missing.cast("long")).alias("n_tokens"))
