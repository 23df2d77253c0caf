"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``window`` words (a shorter item is one window). A window occurs in a document when all
its shingles do, in place, so its *necessary prefix* is one shingle: the rarest, by counts over the whole corpus. Documents'
shingles are joined to those prefixes only; a match says where the window would have to start, which must lie within the
document (positional bound) and leave room for the window (length bound); then the words themselves are compared.

The documents' words are exploded inside one generated stage, and only verified matches leave it, so nothing of the
corpus is shuffled but the matches, pre-aggregated per word. Rarity counts are a partial aggregation. Prefix tables are
broadcast only if a count shows them small (``broadcast_rows``). Beyond, the joins shuffle positions and 64-bit keys of the
corpus, and only positions that pass both bounds are joined back to their documents' words.

Defined cases: texts of any length are read whole, and what is shuffled of a word does not grow with its text; there are no
ties, every window that occurs is reported; null or empty texts and items have no words and match nothing; an item without id marks words but is not
listed; items that repeat count once per id; repeated rows and null document ids get their own rows; extra columns are
ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import content_key, keyed, stored, without
from .textwords import BROADCAST_ROWS, count_words, shingle_at, split_words

_SHINGLE = 3


def _item_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``win_id, win, item``: distinct windows of the items, and the items that hold them."""
    words = items.select(F.col(item_col).cast("string").alias("item"),
                         F.filter(split_words(F.col(text_col).cast("string")), lambda x: x != "").alias("words"))
    n = F.size("words")
    starts = words.filter(n > 0).select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("at"))
    held = starts.select("item", F.slice("words", F.col("at") + 1, window).alias("win")).distinct()
    named = held.select("win").distinct().withColumn("win_id", F.monotonically_increasing_id())
    return stored(held.join(stored(named, "windows"), "win"), "item-windows")


def _document_shingles(rows: DataFrame, width: int) -> DataFrame:
    """``id, part, words, at, key``: every shingle of ``width`` words of every document."""
    words = rows.select("id", "part", split_words("text").alias("words"))
    return words.select("id", "part", "words", F.posexplode_outer("words").alias("at", "word")).select(
        "id", "part", "words", "at", shingle_at("words", "at", width).alias("key")).filter("key is not null")


def _seen(shingles: DataFrame, keys: DataFrame, small: bool) -> DataFrame:
    """``key, seen``: how often the corpus has each of the windows' shingles. A small set of keys filters before the count;
    a large one joins counts made before the join, so that a frequent shingle is one row a task there."""
    if small:
        return shingles.join(F.broadcast(keys), "key").groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
    return shingles.groupBy("key").agg(F.count(F.lit(1)).alias("seen")).join(keys, "key")


def _matches_in_place(rows: DataFrame, prefix: DataFrame, width: int) -> DataFrame:
    """Occurrences found beside the documents' words, by a broadcast of the windows' prefixes."""
    start = F.col("at") - F.col("offset")
    return (_document_shingles(rows, width).join(F.broadcast(prefix), "key")
            .filter((start >= 0) & (start + F.col("size") <= F.size("words")))
            .filter(F.slice("words", start + 1, F.col("size")) == F.col("win"))
            .select("id", "part", start.alias("start"), "size", "win_id"))


def _matches_by_key(rows: DataFrame, prefix: DataFrame, width: int) -> DataFrame:
    """Occurrences by shuffles: positions meet the prefixes without any words, candidates within the bounds are written
    once and then compared with the words of their documents, each of which is shuffled once."""
    start = F.col("at") - F.col("offset")
    near = (_document_shingles(rows, width).select("id", "part", "at", F.size("words").alias("n"), "key")
            .join(prefix.select("key", "win_id", "offset", "size"), "key")
            .filter((start >= 0) & (start + F.col("size") <= F.col("n")))
            .select("id", "part", start.alias("start"), "size", "win_id").distinct())
    near = stored(near, "window-candidates").join(prefix.select("win_id", "win"), "win_id").alias("c")
    texts = rows.select("id", "part", split_words("text").alias("words")).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.part") == F.col("c.part"))
    return (texts.join(near, same).filter(F.slice("d.words", F.col("c.start") + 1, F.col("c.size")) == F.col("c.win"))
            .select("c.id", "c.part", "c.start", "c.size", "c.win_id"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text_col: str = "text",
                broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(``id, part, start, size, win_id`` of every occurrence of an item window, ``win_id, item``). Positions count the
    entries of ``split_words``. Windows' tables of more than ``broadcast_rows`` rows are joined by shuffles."""
    rows = keyed(docs, id_col, text_col).withColumn("part", content_key())
    windows = _item_windows(items, window, item_col, item_text_col)
    distinct = windows.select("win_id", "win", F.size("win").alias("size")).dropDuplicates(["win_id"])
    # shingles are as wide as the shortest windows allow: at most three widths
    distinct = distinct.withColumn("width", F.least(F.col("size"), F.lit(_SHINGLE)))
    widths = [r["width"] for r in distinct.select("width").distinct().collect()]
    found = None
    for width in widths:
        own = distinct.filter(F.col("width") == width)
        keys = own.select("win_id", "win", "size", F.explode(F.sequence(F.lit(0), F.col("size") - width)).alias("offset"))
        keys = stored(keys.withColumn("key", shingle_at("win", "offset", width)), "window-shingles")
        wanted = stored(keys.select("key").distinct(), "keys")
        seen = _seen(_document_shingles(rows, width).select("key"), wanted, wanted.count() <= broadcast_rows)
        # the rarest shingle of each window; a window with one that no document has cannot occur
        ranked = keys.join(seen, "key", "left").groupBy("win_id").agg(
            F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "key")).alias("rare"),
            F.first("win").alias("win"), F.first("size").alias("size"))
        prefix = stored(ranked.filter("rare.seen > 0").select(
            "win_id", "win", "size", F.col("rare.offset").alias("offset"), F.col("rare.key").alias("key")), "prefixes")
        matches = _matches_in_place if prefix.count() <= broadcast_rows else _matches_by_key
        match = matches(rows, prefix, width)
        found = match if found is None else found.unionByName(match)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "id long, part long, start int, size int, win_id long")
    # a row that repeats finds the same again
    return stored(found.distinct(), "occurrences"), windows.select("win_id", "item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, part`` per row."""
    found, members = occurrences(docs, items, window, id_col, text_col, item_col, item_text_col, broadcast_rows)
    hit = (found.select("id", "part", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at"))
           .groupBy("id", "part", "at").agg(F.lit(1).alias("one"))
           .groupBy("id", "part").agg(F.count(F.lit(1)).alias("n_hit")))
    listed = (found.select("id", "part", "win_id").distinct().join(members, "win_id").filter("item is not null")
              .select("id", "part", "item").distinct()
              .groupBy("id", "part").agg(F.array_sort(F.collect_list("item")).alias("items")))
    marked = hit.alias("h").join(listed.alias("l"), F.col("h.id").eqNullSafe(F.col("l.id")) & (F.col("h.part") == F.col("l.part")),
                                 "left").select("h.id", "h.part", "h.n_hit", "l.items").alias("m")
    base = keyed(docs, id_col, text_col).select("id", content_key().alias("part"), split_words("text").alias("words")).select(
        "id", "part", count_words("words").alias("n_words")).alias("b")
    items_of = F.coalesce("m.items", F.array().cast("array<string>"))
    return (base.join(marked, F.col("b.id").eqNullSafe(F.col("m.id")) & (F.col("b.part") == F.col("m.part")), "left")
            .select(F.col("b.id").alias("doc_id"), "b.n_words", F.coalesce("m.n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.size(items_of).cast("long").alias("n_items"),
                    F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
                    F.col("m.n_hit").isNotNull().alias("contaminated"), items_of.alias("items"), F.col("b.part").alias("part")))


def uncontaminated(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Rows without an occurrence of an item window, all columns kept."""
    found, _ = occurrences(docs, items, window, id_col, text_col)
    return without(docs, stored(found.select("id", "part").distinct(), "contaminated"), "left_anti", id_col, text_col)
