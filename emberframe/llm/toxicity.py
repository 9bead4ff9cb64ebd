"""Operator 3: toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the characters of words (order 6, a word's begin and end included) are learned, one
from toxic and one from ordinary rows. Each class has its own discounted counts of order 6; both back off to the same Kneser-Ney
model of orders 6 to 1, counted over both classes together, so a rare expression is smoothed through counts that both share and
tells next to nothing by itself. What neither class has seen after a context has the same backoff in both, which cancels. A
text's score compares the two log-likelihoods of each distinct word, normalised by length: their means over characters and over
words, the means of the largest one, three, six, a fiftieth and a twenty-fifth of the distinct words, the roots of the shares above
1, 2 and 3, and the mean excess over 2. A logistic curve turns these into a probability; it is fitted on labelled rows, each
measured by models whose class counts leave this very row out.

Counting covers all labelled rows, and every n-gram counted is gathered, however rare: the driver's and the broadcast's size
grow with the number of distinct n-grams. Only the curve is fitted on a sample, at most ``CALIBRATION_ROWS`` rows.

Null and empty texts and texts without a word score as a text whose words tell nothing. Without labelled rows of both classes (in
an empty table, say) every text gets the share of toxic rows, smoothed. Equal texts get equal scores; repeated rows each give a
row, and a labelled row counts as often as it is there. A score column of the input gives way, other columns are carried along.
Texts of any length are taken whole, long ones in pieces that end between words.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import adding, by_batches, hash_sample, HashTable, logistic_fit, mix, pieces, runs

ORDER, BITS = 6, 10
#: Values of characters: a hash below MOD; a place before a word; the end of a word.
MOD, BEFORE, END = 1021, 1022, 1023
CALIBRATION_ROWS = 20_000
#: N-grams that a worker gathers before it hands them on.
HELD_GRAMS = 2_000_000


@cache
def _word_chars() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each character (and end) of each word; where words begin among these; words per text."""
    parts = [f" {t.lower()} " for t in texts]
    lens = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = _word_chars()[flat]
    take = word.copy()
    take[1:] |= word[:-1]
    begins = np.zeros(len(flat), dtype=bool)
    begins[1:] = word[1:] & ~word[:-1]
    words = np.add.reduceat(begins, np.cumsum(lens) - lens, dtype=np.int64)
    value = np.where(word, flat % MOD, END)[take].astype(np.uint64)
    starts = np.flatnonzero(begins[take])
    n = len(value)
    offset = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    key = value.copy()
    for j in range(1, ORDER):
        back = np.full(n, BEFORE, dtype=np.uint64)
        back[j:] = np.where(offset[j:] >= j, value[:-j] if j < n else 0, BEFORE) if n > j else 0
        key |= back << np.uint64(BITS * j)
    return key, starts, words


def _low(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (BITS * order)) - 1)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, weights=values, minlength=len(found))


class _Level:
    """Discounted counts of one order: the share of a gram after its context, and the weight that the context leaves."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        ones, twos = float((counts == 1).sum()), float((counts == 2).sum())
        self.d = ones / (ones + 2 * twos) if ones and twos else 0.5
        self.keys, self.counts = keys, counts
        self.contexts, back = np.unique(keys >> np.uint64(BITS), return_inverse=True)
        total = np.bincount(back, weights=counts)
        left = np.bincount(back, weights=np.minimum(self.d, counts))
        self.gamma = left / total if len(total) else total
        self.share = np.maximum(counts - self.d, 0) / total[back] if len(total) else counts

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """share and gamma for grams; an unseen context leaves all its weight."""
        def look(table, values, what, other):
            if not len(table):
                return np.full(len(what), other)
            i = np.minimum(np.searchsorted(table, what), len(table) - 1)
            return np.where(table[i] == what, values[i], other)

        return look(self.keys, self.share, keys, 0.0), look(self.contexts, self.gamma, keys >> np.uint64(BITS), 1.0)


def _lower(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Continuation counts: for each gram of the next lower order, before how many distinct characters it follows."""
    return _sums(_low(keys, order - 1), np.ones(len(keys)))


class Counts:
    """What the models have counted: the n-grams of the highest order with a count for each class, and the shared model's probability of each."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.of_class = keys[order], np.stack([toxic[order], ordinary[order]]).astype(np.int64)
        levels, k, c = {}, self.keys, self.of_class.sum(0).astype(float)
        for n in range(ORDER, 0, -1):
            levels[n] = _Level(k, c)
            k, c = _lower(k, n) if n > 1 else (k, c)
        self.shared = np.full(len(self.keys), 1.0 / (1 << BITS))
        for n in range(1, ORDER + 1):
            share, gamma = levels[n].at(_low(self.keys, n))
            self.shared = share + gamma * self.shared
        self.discounts = [_Level(self.keys[own > 0], own[own > 0].astype(float)).d for own in self.of_class]
        self.contexts, self.context_of = np.unique(self.keys >> np.uint64(BITS), return_inverse=True)
        self.totals = np.stack([np.bincount(self.context_of, weights=own, minlength=len(self.contexts)) for own in self.of_class])
        self.kinds = np.stack([np.bincount(self.context_of, weights=own > 0, minlength=len(self.contexts)) for own in self.of_class])

    def _gamma(self, value: int, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The weight that a context leaves to the shared model: all of it, where the class hasn't seen the context."""
        return np.where(total > 0, np.minimum(self.discounts[value] * kinds, total) / np.maximum(total, 1), 1.0)

    def _p(self, value: int, count: np.ndarray, total: np.ndarray, kinds: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return np.maximum(count - self.discounts[value], 0) / np.maximum(total, 1) + self._gamma(value, total, kinds) * shared

    def ratios(self) -> tuple[np.ndarray, np.ndarray]:
        """log P(toxic) - log P(ordinary) of each n-gram, and of any other character after each context."""
        at = self.context_of
        p = [self._p(v, self.of_class[v], self.totals[v][at], self.kinds[v][at], self.shared) for v in (0, 1)]
        g = [self._gamma(v, self.totals[v], self.kinds[v]) for v in (0, 1)]
        return np.log(p[0]) - np.log(p[1]), np.log(np.maximum(g[0], 1e-9)) - np.log(np.maximum(g[1], 1e-9))

    def without(self, text: str, label: int):
        """From n-grams of a text that was counted with this label to their ratios, if its own counts are taken away."""
        parts = list(pieces(text))
        found, own = _sums(*map(np.concatenate, zip(*[np.unique(_keys([p])[0], return_counts=True) for p in parts])))
        at = np.searchsorted(self.keys, found)
        less, inside = np.unique(self.context_of[at], return_inverse=True)
        p = []
        for v in (0, 1):
            count, total, kinds = self.of_class[v][at], self.totals[v][less], self.kinds[v][less]
            if v == 1 - label:
                total, kinds = total - np.bincount(inside, weights=own), kinds - np.bincount(inside, weights=count == own)
                count = count - own
            p.append(self._p(v, count, total[inside], kinds[inside], self.shared[at]))
        ratios = np.log(p[0]) - np.log(p[1])
        return lambda keys: ratios[np.searchsorted(found, keys)]


class LikelihoodRatio:
    """log P(toxic) - log P(ordinary) of every n-gram, from tables that hold no more than scoring needs."""

    def __init__(self, counts: Counts):
        grams, contexts = counts.ratios()
        self.grams, self.contexts = HashTable(counts.keys, grams.astype(np.float32)), HashTable(counts.contexts, contexts.astype(np.float32))

    def of(self, keys: np.ndarray) -> np.ndarray:
        out, seen = self.grams.find(keys)
        rest = np.flatnonzero(~seen)
        out[rest] = self.contexts.find(keys[rest] >> np.uint64(BITS))[0]
        return out


FEATURES = 11


def _measures(owner: np.ndarray, word: np.ndarray, chars: np.ndarray, size: int) -> np.ndarray:
    """FEATURES numbers for each of size texts, from the distinct words (sorted by text, then ratio, downwards): whose they are, their ratios and their lengths."""
    out = np.zeros((size, FEATURES))
    n = np.bincount(owner, minlength=size)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    begin = (np.cumsum(n) - n)[some]
    sums = np.concatenate([[0.0], np.cumsum(word)])
    n = n[some]

    def largest(k: np.ndarray) -> np.ndarray:
        return sums[begin + np.minimum(k, n)] - sums[begin]

    out[some, 0] = largest(n) / np.add.reduceat(chars, begin)
    out[some, 1] = largest(n) / n
    for at, k in enumerate((1, 3, 6)):
        out[some, 2 + at] = largest(np.full(len(n), k)) / k
    for at, part in enumerate((50, 25)):
        k = np.maximum(1, n // part)
        out[some, 5 + at] = largest(k) / k
    for at, least in enumerate((1, 2, 3)):
        out[some, 7 + at] = np.sqrt(np.add.reduceat(word > least, begin, dtype=np.int64) / n)
    out[some, 10] = np.add.reduceat(np.maximum(word - 2, 0), begin) / n
    return out


def _distinct(owner: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The places of each text's distinct words."""
    order = np.lexsort((name, owner))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (name[order][1:] != name[order][:-1])
    return order[fresh]


def features(texts: list[str | None], ratio) -> np.ndarray:
    """A row of numbers for each text. ratio: from n-grams to their ratios."""
    parts = [(i, p) for i, t in enumerate(texts) if t for p in pieces(t)]
    found = []
    for a, b in runs([p for _, p in parts]):
        keys, starts, words = _keys([p for _, p in parts[a:b]])
        if len(starts):
            # a word is its n-grams: words with the same ones have the same ratio
            name = np.add.reduceat(mix(keys), starts)
            owner = np.repeat(np.array([i for i, _ in parts[a:b]]), words)
            first = _distinct(owner, name)
            word = np.add.reduceat(ratio(keys).astype(np.float64), starts)
            found.append((owner[first], name[first], word[first], np.diff(np.append(starts, len(keys)))[first]))
    if not found:
        return np.zeros((len(texts), FEATURES))
    owner, name, word, chars = (np.concatenate(c) for c in zip(*found))
    first = _distinct(owner, name)
    first = first[np.lexsort((-word[first], owner[first]))]
    return _measures(owner[first], word[first], chars[first], len(texts))


class Model:
    def __init__(self, ratio: LikelihoodRatio | None, weights: np.ndarray):
        self.ratio, self.weights = ratio, weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = features(texts, self.ratio.of) if self.ratio else np.zeros((len(texts), FEATURES))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35)))


def learn(rows: DataFrame, text: str = "text", label: str = "label", *, id_column: str = "doc_id", calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """A model from labelled rows (1 toxic, 0 ordinary; others are left out). All teach the class models; about ``calibration_rows`` of them, chosen by a hash of the id, the curve."""
    import pandas as pd

    rows = rows.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")

    def count(batches):
        held: dict[int, list] = {0: [], 1: []}

        def merged():
            for value, found in held.items():
                if found:
                    keys, n = _sums(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]).astype(float))
                    held[value] = []
                    yield pd.DataFrame({"gram": keys.view(np.int64), "toxic": (n if value else 0 * n).astype(np.int64), "ordinary": (0 * n if value else n).astype(np.int64)})

        for pdf in batches:
            for value, texts in pdf.groupby("label")["text"]:
                texts = [p for t in texts if t for p in pieces(t)]
                for a, b in runs(texts):
                    held[value].append(np.unique(_keys(texts[a:b])[0], return_counts=True))
            if sum(len(k) for found in held.values() for k, _ in found) > HELD_GRAMS:
                yield from merged()
        yield from merged()

    counts = by_batches(rows, count, "gram long, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    found = counts.toArrow()
    grams, toxic, ordinary = (found[c].to_numpy() for c in ("gram", "toxic", "ordinary"))
    counted = Counts(grams.view(np.uint64), toxic, ordinary) if toxic.any() and ordinary.any() else None
    held = rows.sparkSession.sparkContext.broadcast(counted)

    def measure(batches):
        for pdf in batches:
            x = np.zeros((len(pdf), FEATURES))
            for k, (t, label) in enumerate(zip(pdf["text"], pdf["label"])):
                if held.value and t:
                    x[k] = features([t], held.value.without(t, label))[0]
            yield pd.DataFrame({**{f"x{k}": x[:, k] for k in range(FEATURES)}, "label": pdf["label"]})

    columns = [f"x{k}" for k in range(FEATURES)]
    seen = by_batches(hash_sample(rows, "id", calibration_rows), measure, ", ".join(f"{c} double" for c in columns) + ", label int").toPandas()
    held.destroy()
    return Model(LikelihoodRatio(counted) if counted else None, logistic_fit(seen[columns].to_numpy(float), seen["label"].to_numpy(float)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score; a column of that name gives way."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return adding(docs, text, lambda: lambda texts: [held.value.scores(texts)], [T.StructField("score", T.DoubleType())])
