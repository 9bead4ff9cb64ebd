"""Operator 7 [native]: benchmark decontamination by winnowing.

Every span of ``WINDOW`` words is a window; an item with fewer words is one window of its own length. Winnowing keeps the
smallest hash of the k-grams in each window, so two equal windows always share a fingerprint: no shared span of WINDOW words or
more is missed. A training text's k-grams are looked up in a bitmap of the test side's fingerprints (its size follows their number
up to 2^``BITMAP_MOST`` bits; beyond, it lets more pass and loses nothing). Windows whose smallest k-gram passed are extended to
their whole words and joined with the test windows word by word, which is exact. Windows become the places of hit words.

The test side's windows are broadcast if their measured size is small, else shuffled; a window's items are kept as one set, so
neighbouring windows of an item do not multiply the rows. Nothing but the candidate windows leaves a text's row.

Words are runs of letters and digits (all characters beyond ASCII count as letters), A-Z lower-cased. Null and empty texts have no
words and no hits; items without words or without id are left out. Equal items, and equal windows of an item, count once. Repeated
rows each give a row. An empty benchmark hits nothing, and an empty table gives no rows. Only the columns asked for are carried
along, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import ascii_lower, let, written

WINDOW, GRAM = 10, 5
#: Fixed value: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The bitmap has 2^BITMAP_LOG2 bits, or 16 for each fingerprint if that is more, 2^BITMAP_MOST at most.
BITMAP_LOG2, BITMAP_MOST = 20, 24
#: Characters of test windows up to which they are broadcast.
BROADCAST_CHARS = 8_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN, -1), "")


def _grams(hashes: Column, k: int) -> Column:
    """Hashes of the k-grams of an array of k word hashes or more."""
    return F.transform(F.slice(hashes, 1, F.size(hashes) - (k - 1)), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, k)]))


def _least(grams: Column, i: Column, length: int) -> Column:
    """The fingerprint of the window of that length at place i."""
    return F.array_min(F.slice(grams, i + 1, length - min(GRAM, length) + 1))


def _hashes(own: Column) -> Column:
    return F.transform(own, lambda w: F.xxhash64(w))


def _windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """item, length, window (its words) and fingerprint of all windows."""
    own = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).filter("item is not null and size(w) > 0")
    kind = "array<struct<length:int,window:string,fingerprint:bigint>>"

    def rows(length: int) -> Column:
        def of(grams: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda i: F.struct(F.lit(length).alias("length"), F.array_join(F.slice("w", i + 1, length), " ").alias("window"), _least(grams, i, length).alias("fingerprint")))

        return let(_hashes(F.col("w")), lambda h: let(_grams(h, min(GRAM, length)), of)).cast(kind)

    found = rows(WINDOW)
    for length in range(1, WINDOW):
        found = F.when(F.size("w") == length, rows(length)).otherwise(found)
    return own.select("item", F.inline(found))


def _bitmap(fingerprints: DataFrame) -> list[int]:
    """The bits of distinct fingerprints, 64 a number: 2^BITMAP_MOST / 64 rows at most."""
    log2 = min(BITMAP_MOST, max(BITMAP_LOG2, (16 * fingerprints.count()).bit_length()))
    place = F.col("fingerprint").bitwiseAND(F.lit((1 << log2) - 1))
    cells = fingerprints.select(F.shiftright(place, 6).alias("cell"), F.expr("shiftleft(1L, cast(fingerprint & 63 as int))").alias("bit"))
    out = [0] * (1 << (log2 - 6))
    for r in cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["cell"]] = r["bits"]
    return out


def _candidates(own: Column, lengths: list[int], bitmap: list[int]) -> Column:
    """n_words and an array of (place, length, window) of the words' windows that the bitmap lets pass."""
    cells = F.lit(bitmap).cast("array<bigint>")
    mask = F.lit(64 * len(bitmap) - 1)
    kind = "array<struct<place:int,length:int,window:string>>"

    def passes(f: Column) -> Column:
        return F.getbit(F.get(cells, F.shiftright(f.bitwiseAND(mask), 6).cast("int")), f.bitwiseAND(F.lit(63)).cast("int")) == 1

    def of(w: Column) -> Column:
        def one(h: Column, length: int) -> Column:
            k = min(GRAM, length)

            def places(grams: Column) -> Column:
                some = F.filter(F.transform(grams, lambda g, i: F.when(passes(g), i)), lambda i: i.isNotNull())
                if length == k:
                    return some

                def around(p: Column) -> Column:
                    near = F.sequence(F.greatest(p - (length - k), F.lit(0)), F.least(p, F.size(w) - length))
                    return F.filter(near, lambda i: _least(grams, i, length) == F.get(grams, p))

                return F.array_distinct(F.flatten(F.transform(some, around)))

            def named(at: Column) -> Column:
                return F.transform(at, lambda i: F.struct(i.alias("place"), F.lit(length).alias("length"), F.array_join(F.slice(w, i + 1, length), " ").alias("window")))

            return F.when(F.size(w) >= length, let(_grams(h, k), lambda grams: named(places(grams))).cast(kind)).otherwise(F.array().cast(kind))

        found = let(_hashes(w), lambda h: F.flatten(F.array(*[one(h, n) for n in lengths]))) if lengths else F.array().cast(kind)
        return F.struct(F.size(w).cast("long").alias("n_words"), found.alias("found"))

    return let(own, of)


def hits(docs: DataFrame, items: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each of docs: the columns in keep, n_words, places (array of (start, end) of hit spans of words) and items (array of item ids, sorted as strings)."""
    test = written(_windows(items, item, item_text), "decontamination-windows")
    lengths = sorted(r["length"] for r in test.select("length").distinct().collect())  # WINDOW at most
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("own"), _candidates(words(F.col(text)), lengths, _bitmap(test.select("fingerprint").distinct())).alias("c"))
    found = written(found.select("row", "own", "c.*"), "decontamination-candidates")
    by_window = written(test.groupBy("length", "window").agg(F.array_sort(F.collect_set("item")).alias("items")), "decontamination-items")
    # written once, a set's number is its own
    known = written(by_window.select("items").distinct().withColumn("set", F.monotonically_increasing_id()), "decontamination-sets")
    windows = written(by_window.join(known, "items").select("length", "window", "set"), "decontamination-numbered")
    size = windows.agg(F.sum(F.length("window") + 40)).first()[0] or 0
    each = found.select("row", F.inline("found")).join(F.broadcast(windows) if size <= BROADCAST_CHARS else windows, ["length", "window"])
    spans = each.groupBy("row").agg(F.collect_set(F.struct(F.col("place").alias("start"), (F.col("place") + F.col("length")).alias("end"))).alias("places"), F.collect_set("set").alias("sets"))
    spans = written(spans, "decontamination-hits")
    known_size = known.agg(F.sum(F.length(F.to_json("items")))).first()[0] or 0
    pairs = spans.select("row", F.explode("sets").alias("set")).join(F.broadcast(known) if known_size <= BROADCAST_CHARS else known, "set")
    whole = pairs.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    joined = found.select("row", "own", "n_words").join(spans.select("row", "places").join(whole, "row", "left"), "row", "left")
    return joined.select("own.*", "n_words", F.coalesce("places", F.array().cast("array<struct<start:int,end:int>>")).alias("places"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def n_hit(places: Column) -> Column:
    """Words inside any of the spans."""
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, p: Column) -> Column:
        fresh = F.greatest(F.lit(0), p["end"] - F.greatest(p["start"], acc["to"]))
        return F.struct(F.greatest(acc["to"], p["end"]).alias("to"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(F.sort_array(places), start, add, lambda acc: acc["n"])
