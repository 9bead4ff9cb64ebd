"""Operator 1: language identification by bit-sliced Bloom filters over character n-grams.

Learning counts the n-grams of each language over all its rows. An n-gram is of every language that uses it at ``LEAST_RATE`` of the
rate, or more, of the language that uses it most; so every n-gram, however rare, is in one filter at least, and a few rows with a
wrong language do no harm, whatever the input's size. (With every n-gram in the filter of every language that has it once, 27 % of
0.5 GB of texts came out wrong.) The bits are set on the executors and combine by OR there; the driver gathers bits, never n-grams.
Filters have ``BITS`` bits for each n-gram of the language with most, 2^``LOG2_MOST`` at most: beyond, no n-gram is lost, only false
positives rise, which the scores correct for. The filters of
all languages lie side by side: position i holds a mask with one bit per language, and the AND of an n-gram's positions is the set
of all languages that (may) contain it. A text's n-grams are looked up at once; the popcount of each language's bit, less what its
fill makes expected as false positives, is divided by the number of n-grams. The language with most wins; ties go to the first in
alphabetical order.

An n-gram is taken from the lower-cased letters of the text, with each run of other characters as one space. Texts of any length
are taken whole; one of more than ``CHUNK_CHARS`` in pieces that end at a space, and n-grams across that space aren't formed.

Null texts and texts without a letter give ``und`` and score 0; so does every text if no language was learned (from an empty
table, say). Rows whose text or language is null are not learned from. Equal texts get equal results; repeated rows each give a row
and each count. Columns named lang_pred or score give way.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import adding, by_batches, mix, pieces, runs, written

UND = "und"
#: The order of the n-grams; filter bits per n-gram, hash functions, and the most bits a filter may have (as a power of 2).
ORDER, BITS, HASHES, LOG2_MOST = 4, 12, 5, 26
#: The least rate of an n-gram in a language, as a part of its rate in the language that uses it most.
LEAST_RATE = 0.1


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """The hashes of n-grams: columns[k] holds the code point of each one's k-th character."""
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for k, values in enumerate(columns):
        h = (h ^ values) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    return mix(h)


def _grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, where each text's begin, and which texts have a letter."""
    parts = [f" {t.lower()} " + "\0" * (order - 1) for t in texts]
    lens = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[flat]
    begins = np.cumsum(lens) - lens
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[begins] = True
    for k in range(1, order):
        keep[begins + lens - k] = True
    kept = np.add.reduceat(keep, begins, dtype=np.int64)
    some = np.logical_or.reduceat(letter, begins)
    values = np.where(letter, flat, 32).astype(np.uint64)
    for k in range(1, order):
        values[begins + lens - k] = 0
    values = values[keep]
    n = len(values) - order + 1
    h = gram_hashes([values[k : n + k] for k in range(order)])
    at = np.cumsum(kept) - kept
    inside = np.ones(n, dtype=bool)
    for k in range(1, order):
        tails = (at + kept - k)[:-1]
        inside[tails[tails < n]] = False
    per = kept - order + 1
    return h[inside], np.cumsum(per) - per, some


def filter_log2(most: int, bits: int = BITS) -> int:
    """The size of a filter for that many n-grams, as a power of 2 of bits, whole cells of 64 at least."""
    return min(LOG2_MOST, max(6, int(np.ceil(np.log2(max(1, most) * bits)))))


def positions(grams: np.ndarray, log2: int, hashes: int = HASHES):
    """The places of n-grams in a filter, hash function by hash function."""
    mask = np.uint64((1 << log2) - 1)
    step = (grams >> np.uint64(log2)) | np.uint64(1)
    for k in range(hashes):
        yield ((grams + np.uint64(k) * step) & mask).astype(np.int64)


class BitSlicedFilters:
    """masks[w][i] holds, for languages 64 w to 64 w + 63, one bit each. cells: for each language its filter, 64 bits a cell."""

    def __init__(self, cells: dict[str, np.ndarray], order: int = ORDER, hashes: int = HASHES):
        self.languages, self.order, self.hashes = sorted(cells), order, hashes
        self.log2 = int(np.log2(64 * len(next(iter(cells.values()))))) if cells else 6
        self.masks, fill = [], []
        for first in range(0, len(self.languages), 64):
            own = self.languages[first : first + 64]
            kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(own) <= n)
            mask = np.zeros(1 << self.log2, dtype=kind)
            for n, name in enumerate(own):
                bits = np.unpackbits(cells[name].astype("<u8").view(np.uint8), bitorder="little")
                mask |= bits.astype(kind) << kind(n)
                fill.append(float(bits.mean()))
            self.masks.append(mask)
        self.false_rate = np.minimum(np.array(fill) ** hashes, 1 - 1e-9)

    @classmethod
    def of(cls, grams: dict[str, np.ndarray], order: int = ORDER) -> BitSlicedFilters:
        """The filters of n-grams at hand."""
        log2 = filter_log2(max([0, *map(len, grams.values())]))
        cells = {name: np.zeros(1 << (log2 - 6), dtype=np.uint64) for name in grams}
        for name, own in grams.items():
            for at in positions(own.astype(np.uint64), log2):
                np.bitwise_or.at(cells[name], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return cls(cells, order)

    def languages_of(self, grams: np.ndarray) -> list[np.ndarray]:
        """The mask of each n-gram, for each 64 languages."""
        out = None
        for at in positions(grams, self.log2, self.hashes):
            out = [m[at] for m in self.masks] if out is None else [o & m[at] for o, m in zip(out, self.masks)]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        parts = [(i, p) for i, t in enumerate(texts) if t for p in pieces(t)]
        hits, total, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        for a, b in runs([p for _, p in parts]):
            own = np.array([i for i, _ in parts[a:b]])
            grams, begins, some = _grams([p for _, p in parts[a:b]], self.order)
            np.add.at(total, own, np.diff(np.append(begins, len(grams))))
            np.logical_or.at(letters, own, some)
            masks = self.languages_of(grams)
            for n in range(len(self.languages)):
                bit = (masks[n // 64] >> masks[n // 64].dtype.type(n % 64)) & masks[n // 64].dtype.type(1)
                np.add.at(hits[:, n], own, np.add.reduceat(bit, begins, dtype=np.int64))
        share = (hits - total[:, None] * self.false_rate) / (1 - self.false_rate) / np.maximum(total, 1)[:, None]
        best = share.argmax(1)
        for i in np.flatnonzero(letters):
            names[i], scores[i] = self.languages[best[i]], float(min(1.0, max(0.0, share[i, best[i]])))
        return names, scores


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", *, order: int = ORDER, least_rate: float = LEAST_RATE) -> BitSlicedFilters:
    """The filters from all rows with text and language."""
    import pandas as pd

    def count(batches):
        for pdf in batches:
            for name, texts in pdf.groupby("lang")["text"]:
                texts = [p for t in texts for p in pieces(t)]
                for a, b in runs(texts):
                    found, n = np.unique(_grams(texts[a:b], order)[0], return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": found.view(np.int64), "n": n})

    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and text != '' and lang is not null")
    counts = written(by_batches(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-counts")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # a row per language
    rates = counts.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    # a window holds a row per language at most
    most = F.max("rate").over(W.partitionBy("gram"))
    grams = written(rates.withColumn("most", most).filter(F.col("rate") >= least_rate * F.col("most")).select("lang", "gram"), "language-grams")
    sizes = {r["lang"]: r["count"] for r in grams.groupBy("lang").count().collect()}  # a row per language
    log2 = filter_log2(max([0, *sizes.values()]))
    mask = F.lit((1 << log2) - 1)
    # the same places as positions() gives, modulo the filter's size from the start
    step = F.shiftrightunsigned("gram", log2).bitwiseOR(F.lit(1)).bitwiseAND(mask)
    at = F.explode(F.array(*[(F.col("gram").bitwiseAND(mask) + k * step).bitwiseAND(mask) for k in range(HASHES)]))
    cells = grams.select("lang", at.alias("at")).groupBy("lang", F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    gathered = cells.toPandas()  # 2^(log2 - 6) rows per language at most
    filters = {name: np.zeros(1 << (log2 - 6), dtype=np.int64) for name in sizes}
    for name, part in gathered.groupby("lang"):
        filters[name][part["cell"].to_numpy()] = part["bits"].to_numpy()
    return BitSlicedFilters({name: own.view(np.uint64) for name, own in filters.items()}, order)


def predict(docs: DataFrame, filters: BitSlicedFilters, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; any columns of those names give way."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    return adding(docs, text, lambda: held.value.predict, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
