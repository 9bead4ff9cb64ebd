"""Operator 8 [native]: quality rules with risk-controlled thresholds.

``statistics`` counts words, symbols, repeated lines and repeated windows of words of whole texts. Base rules reject texts that
are short or mostly repetition. The other rules compare a ratio with a cutoff, and labelled holdouts choose the cutoffs. Settings
of all rules together form one chain: the first rule's cutoffs from lenient to strict, then, with that rule at its strictest, the
second's, then the third's. The chain is read from the rows labelled bad alone, so the good rows, which test it, never shape
it: the rule that rejects most of them at its strictest is first, and a setting that rejects none that those before it keep is left
out. In each stratum the settings are tested in order, and the last before the first failure holds. A setting passes if the chance to see as few good rows rejected that the base
rules keep, were the true share ``ALPHA`` of the good rows, is at most ``DELTA`` / strata: an exact binomial tail, the fixed
sequence inside a stratum, Bonferroni's correction over strata. So with probability 1 - DELTA, in no stratum do the rules together
reject more than ALPHA of the good rows beyond the base rules. Strata count, and can have cutoffs, if they hold good rows enough
to pass at DELTA without a rejection (their number decides, not their verdicts).

Whether two windows of words are equal is decided on the words; hashes only sort out what cannot be equal.

Null texts have no words and fail. A null stratum is a stratum of its own. Rows whose label is neither 1 nor 0 choose nothing; a
row labelled both ways counts as both. A ratio equal to a cutoff is kept. Repeated rows each give a row. Empty tables give no rows,
and without labels there are no cutoffs. Only the columns asked for are carried along, so names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import let, written

#: Fixed values of the base rules.
SPACES, SYMBOL_CHARS, MIN_WORDS, MAX_REPEAT_PERCENT = " \t\n\x0b\x0c\r", "#*$%&|<>", 50, 50
#: The risk: of good rows of a stratum, in all rules together; the chance that the proof errs.
ALPHA, DELTA = 0.02, 0.05
#: Cutoffs of every ratio, from lenient to strict.
CUTOFFS = [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05]
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}
#: Rows of the table of cutoffs up to which it is broadcast; beyond, it is joined by shuffling.
BROADCAST_STRATA = 10_000


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word), all long."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.struct(*keep).alias("own"), t.alias("t"))

    def measure(words: Column) -> Column:
        n = F.size(words).cast("long")

        def windows(hashes: Column) -> Column:
            some = F.slice(hashes, 1, F.size(hashes) - 2)
            return F.transform(some, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))

        def alike(found: Column) -> Column:
            # a number for each window: the hash's upper part, then the place; sorted, windows that may be equal are neighbours
            packed = F.sort_array(F.transform(found, lambda h, i: let(h.bitwiseAND(F.lit((1 << 62) - 1)), lambda x: x - x % n + i)))

            def again(p: Column) -> Column:
                def upper(x: Column) -> Column:
                    return x - x % n

                inner = F.filter(p, lambda x, i: let(upper(x), lambda u: (F.coalesce(upper(F.get(p, i - 1)), F.lit(-1)) == u) | (F.coalesce(upper(F.get(p, i + 1)), F.lit(-1)) == u)))
                return F.transform(inner, lambda x: (x % n).cast("int"))

            return let(packed, again)

        def same(places: Column) -> Column:
            # the words themselves, sorted: equal windows are neighbours
            named = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))
            return let(named, lambda x: F.sort_array(F.transform(F.filter(x, lambda r, i: (F.get(x, i - 1)["w"] == r["w"]) | (F.get(x, i + 1)["w"] == r["w"])), lambda r: r["i"])))

        def covered(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x)

        def repeated(found: Column) -> Column:
            return F.when(F.size(F.array_distinct(found)) < F.size(found), let(same(alike(found)), covered)).otherwise(F.lit(0).cast("long"))

        repeats = F.when(F.size(words) >= 4, let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(windows(hashes), repeated))).otherwise(F.lit(0).cast("long"))
        return F.struct(n.alias("n_words"), repeats.alias("n_repeat_words"))

    words = F.array_remove(F.split("t", f"[{SPACES}]+", -1), "")
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.trim(F.translate(x, "\t\n\x0b\x0c\r", "     ")) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    found = base.select("own", let(words, measure).alias("m"), line_counts.alias("l"), F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"), (F.length("t") - F.length(F.translate("t", SYMBOL_CHARS, ""))).cast("long").alias("n_symbols"))
    return found.select("own.*", "m.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "m.n_repeat_words", "l.n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series after a shift; its error is below 1e-9."""
    z = x.cast("double") + 8
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    shift = F.ln(x.cast("double") + 1)
    for k in range(2, 8):
        shift = shift + F.ln(x.cast("double") + k)
    return series - shift


def log_tail(k: Column, n: Column, p: float, terms: int = 400) -> Column:
    """An upper bound of ln P(X <= k) for X binomial (n, p), k < n p: the largest ``terms`` terms exactly, a geometric series for the rest; 0 where k >= n p."""
    k, n = k.cast("double"), n.cast("double")
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = F.when(j <= k, acc["term"] * (k - j + 1) / (n - k + j) * odds).otherwise(0.0)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    ratio = k / (n - k + 1) * odds
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, add, lambda acc: acc["sum"] + acc["term"] * ratio / (1 - ratio))
    return F.when(n <= 0, 0.0).when(k >= n * p, 0.0).otherwise(top + F.ln(total))


def _ratios() -> dict[str, Column]:
    return {name: F.expr(r) for name, r in RULES.items()}


def _step(order: list[str]) -> Column:
    """The first setting of the chain that rejects a row; the number of settings if none does."""
    never = len(RULES) * len(CUTOFFS)
    steps = []
    for k, name in enumerate(order):
        first = sum(((_ratios()[name] <= c).cast("int") for c in CUTOFFS), F.lit(0))
        steps.append(F.when(first < len(CUTOFFS), first + k * len(CUTOFFS)).otherwise(never))
    return F.least(*steps)


def chain(bad: DataFrame) -> tuple[list[str], list[int]]:
    """The rules in order, by how many of the rows labelled bad that the base rules keep each rejects at its strictest; and the settings that reject some that those before them keep."""
    bad = bad.filter(~base_failed())
    counts = bad.agg(*[F.coalesce(F.sum((r > CUTOFFS[-1]).cast("long")), F.lit(0)).alias(name) for name, r in _ratios().items()]).first()
    order = sorted(RULES, key=lambda name: -counts[name])
    steps = bad.select(_step(order).alias("step")).distinct().collect()  # one more than settings at most
    return order, sorted(r["step"] for r in steps if r["step"] < len(RULES) * len(CUTOFFS))


def cutoffs(holdout: DataFrame, stratum: str = "stratum", label: str = "label", *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and, for each rule, its cutoff or null: a row rejected has a ratio above the cutoff. holdout: statistics with stratum and label (1 good, 0 bad)."""
    order, settings = chain(holdout.filter(F.col(label) == 0))
    never = len(RULES) * len(CUTOFFS)
    good = holdout.filter(F.col(label) == 1).select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_s"), F.when(base_failed(), never).otherwise(_step(order)).alias("_step"))
    over = F.array(*[F.sum((F.col("_step") <= i).cast("long")) for i in settings]).cast("array<bigint>")
    counts = good.groupBy("_s").agg(F.count("*").alias("n"), over.alias("over"))
    counts = counts.filter(F.col("n") >= math.ceil(math.log(delta) / math.log1p(-alpha)))
    strata = max(1, counts.count())
    tests = F.transform("over", lambda k: log_tail(k, F.col("n"), alpha) <= math.log(delta / strata))
    failed = F.array_position(tests, False)
    last = F.when(failed == 0, len(settings)).otherwise(failed - 1).cast("int")
    passed = F.coalesce(F.get(F.lit(settings).cast("array<int>"), last - 1) + 1, F.lit(0))
    chosen = []
    for k, name in enumerate(order):
        chosen.append(F.get(F.lit([float(c) for c in CUTOFFS]), F.least(F.col("passed") - k * len(CUTOFFS), F.lit(len(CUTOFFS))) - 1).alias(name))
    return counts.select(F.col("_s").alias("stratum"), passed.alias("passed")).select("stratum", *chosen).select("stratum", *RULES)


def verdicts(stats: DataFrame, table: DataFrame, stratum: str = "stratum") -> DataFrame:
    """stats with base_failed and kept."""
    few = table.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    cuts = table.select(F.col("stratum").alias("_s"), *[F.col(r).alias(f"_{r}") for r in RULES])
    joined = stats.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(F.broadcast(cuts) if few else cuts, "_s", "left")
    rejected = F.lit(False)
    for name, r in RULES.items():
        rejected = rejected | F.coalesce(F.expr(r) > F.col(f"_{name}"), F.lit(False))
    joined = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
    return joined.drop("_s", *[f"_{r}" for r in RULES])


def apply(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality") -> DataFrame:
    """Statistics and verdicts of all docs; labels (id, label) choose the cutoffs."""
    numbered = docs.select(F.col(id_column).alias("id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    stats = written(statistics(numbered, keep=("id", "stratum")), "quality-statistics")
    known = labels.select(F.col(id_column).alias("id"), F.col(label).alias("label")).filter("label in (0, 1)").distinct()
    table = written(cutoffs(written(stats.join(known, "id"), "quality-holdout")), "quality-cutoffs")
    return verdicts(stats, table).withColumnRenamed("id", id_column)
