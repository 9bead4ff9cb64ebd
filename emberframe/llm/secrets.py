"""Operator 5 [native]: secrets by rules and by character Markov models.

Base rules find assignments of long values to names such as ``password``, access keys and long runs of hex digits; their
matches are leftmost and do not overlap within a kind. The method adds runs of 20 or more key characters that two first-order
Markov models, one of random strings and one of ordinary identifiers, call random: the log-likelihood ratio per transition
exceeds a threshold. Models are counts of character pairs from labelled samples, two tables of 67 x 67 cells whatever the
input: hashes as random strings, and the words of about ``IDENTIFIER_DOCS`` distinct texts, whole, as identifiers. A run that
overlaps a base span is left out; one whose ratio equals the threshold is no secret.

Offsets count code points, ends are exclusive. Matches of a text become rows, whose offsets are running sums; texts with any
number of matches take time in proportion. Null texts count as empty and have no spans. Repeated rows each give a row; equal texts
teach once. An empty table gives no rows, and without texts to learn from every identifier's pair is as likely as any. Columns of
the input other than those asked for are left out, so names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberframe.llm.common import let

#: The base rules, as kind: (pattern, the group whose length counts, least length). Where the whole match counts,
#: the least length stands in the pattern: a run is matched whole, so its short matches are just those that fail.
RULES = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(?-i)([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
KINDS = ["assign", "access", "hex", "markov"]
#: Runs that the models judge, their alphabet (other characters are one more symbol), and the least ratio per transition.
RUN, ALPHABET = r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
THRESHOLD, IDENTIFIER_DOCS, RANDOM_STRINGS = 1.0, 2_000, 4_000
SYMBOLS = len(ALPHABET) + 1


def _cells(s: Column) -> Column:
    """The cells of all pairs of neighbours of s, in one pass over its characters."""
    numbers = F.transform(F.split(s, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    return let(numbers, lambda n: F.transform(F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(0))), lambda a, i: a * SYMBOLS + F.get(n, i + 1)))


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """text, label 1: random strings of the usual alphabets, hex and base 64 and letters with digits, by hashing numbers."""
    bits = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    b64 = F.base64(bits)
    kinds = [F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40), F.rtrim(b64, F.lit("=")), F.translate(b64, "+/=", "0x"), F.upper(F.translate(b64, "+/=", "Q7"))]
    return spark.range(n).select(F.explode(F.array(*kinds)).alias("text"), F.lit(1).alias("label"))


def identifiers(docs: DataFrame, text: str = "text", most: int = IDENTIFIER_DOCS) -> DataFrame:
    """text, label 0: ordinary identifiers, from all words of about ``most`` distinct texts (by their hash), or of all if there are fewer: words alone, joined by _ or -, and in camel case."""
    words = F.regexp_extract_all("t", F.lit(r"\b[A-Za-z]{2,}\b"), F.lit(0))
    named = docs.select(F.col(text).cast("string").alias("t")).filter("t is not null").withColumn("h", F.xxhash64("t"))
    distinct = named.select("h").distinct().count()
    if distinct > most:
        named = named.filter(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * most / distinct))
    some = named.dropDuplicates(["h"])
    some = some.select(words.alias("w")).filter(F.size("w") >= 3)
    three = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.slice(F.col("w"), i + 1, 3))
    forms = some.select(F.posexplode(three).alias("n", "t")).select(
        F.when(F.col("n") % 4 == 0, F.array_join("t", "_")).when(F.col("n") % 4 == 1, F.array_join("t", "-")).when(F.col("n") % 4 == 2, F.array_join(F.transform("t", F.initcap), "")).otherwise(F.lower(F.array_join("t", ""))).alias("text"), F.lit(0).alias("label")
    )
    return forms


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio (random over ordinary) of each pair of symbols, row by row. samples: text, label."""
    own = samples.filter("text is not null and length(text) > 1 and label in (0, 1)")
    cells = own.select("label", F.explode(_cells(F.col("text"))).alias("cell"))
    counts = [[0.5] * (SYMBOLS * SYMBOLS) for _ in range(2)]
    for r in cells.groupBy("label", "cell").count().collect():  # 2 x SYMBOLS^2 rows at most
        counts[r["label"]][r["cell"]] += r["count"]
    logs = []
    for c in counts:
        logs.append([math.log(c[a * SYMBOLS + b] / sum(c[a * SYMBOLS : (a + 1) * SYMBOLS])) for a in range(SYMBOLS) for b in range(SYMBOLS)])
    return [x - y for x, y in zip(logs[1], logs[0])]


def ratio_per_transition(s: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio of the transitions of s."""
    ratios = F.lit([float(x) for x in model])
    total = F.aggregate(_cells(s), F.lit(0.0), lambda acc, cell: acc + F.get(ratios, cell))
    return F.when(F.length(s) > 1, total / (F.length(s) - 1)).otherwise(0.0)


def _found(text: Column, kind: str, model: list[float] | None) -> Column:
    """An array of (kind, n, gap, size, good) for a kind's matches: the characters between it and the one before, and its own."""
    pattern, group, least = RULES.get(kind, (RUN, 0, 0))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.lit(None).cast("array<struct<kind:int,n:int,gap:int,size:int,good:boolean>>")

    def rows(found: Column) -> Column:
        def both(gaps: Column, values: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                good = ratio_per_transition(m, model) > THRESHOLD if kind == "markov" else F.length(F.get(values, i)) >= least
                return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.cast("int").alias("n"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"), good.alias("good"))

            return F.transform(found, one)

        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: let(values, lambda v: both(gaps, v)))).otherwise(empty)

    return let(whole, rows)


def spans(docs: DataFrame, model: list[float], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each of docs: row (its number), the columns in keep, and spans, an array of (start, kind, end) in order."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("own"), t.alias("t"))
    arrays = [_found(F.col("t"), k, model) for k in KINDS]
    flat = F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<struct<kind:int,n:int,gap:int,size:int,good:boolean>>")) for a in arrays]))
    each = numbered.select("row", "own", F.explode_outer(flat).alias("m")).select("row", "own", "m.*")
    each = each.repartition("row")
    so_far = W.partitionBy("row", "kind").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")).withColumn("start", (F.col("end") - F.col("size")).cast("int"))
    good = F.col("good") & F.col("kind").isNotNull()
    base = F.when(good & (F.col("kind") < 3), F.col("end"))
    at = W.partitionBy("row").orderBy("start")
    each = each.withColumn("reach", F.max(base).over(at.rangeBetween(W.unboundedPreceding, W.currentRow))).withColumn("next", F.min(F.when(good & (F.col("kind") < 3), F.col("start"))).over(at.rangeBetween(W.currentRow, W.unboundedFollowing)))
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
    keeps = good & ((F.col("kind") < 3) | clear)
    span = F.when(keeps, F.struct("start", "kind", "end"))
    found = each.groupBy("row").agg(F.first("own").alias("own"), F.sort_array(F.collect_list(span)).alias("s"))
    return found.select("row", "own.*", F.col("s").alias("spans"))


def as_text(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with a mark in place of each span, or of spans that overlap or touch."""
    t = F.coalesce(text.cast("string"), F.lit(""))

    def cover(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def add(acc: Column, s: Column) -> Column:
            gap = F.substring(t, acc["at"] + 1, s["start"] - acc["at"])
            fresh = (s["start"] > acc["at"]) | (F.size(acc["out"]) == 0)
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(spans, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))

    return F.when(F.size(found) > 0, cover(found)).otherwise(text)
