"""N-gram Jaccard join by grouped prefixes.

Two texts link when their sets of ``width``-word shingles have a Jaccard similarity of at least ``percent`` / 100. Shingles
get one global order, rare before common; sets that similar share a shingle among their first ``n - ceil(t n) + 1``.
Documents with one prefix and one size form a group, and a group's prefix enters the shuffle once however many copies it
has. Pairs of groups that share a prefix shingle are filtered by size and by the overlap that remains possible, then
expanded to their members, which are verified exactly.

* Order: blocks of documents report the shingles that they hold more than once; the most reported, a fixed number, are
  *common* and come last, by count. All others are ordered by fingerprint, which is the same for every document. Any global
  order gives whole results; this one fills the prefixes of near copies with what is their own.
* Copies: rows with one shingle set are one class, found by a 128-bit digest. Only classes are compared.
* Hot prefixes: a prefix shingle shared by thousands of near copies is never expanded into pairs. Its classes are first
  compared with a few pivots (a linear number of pairs), verified links are contracted to components, and only pairs
  whose components still differ are formed. A class pair inside one component cannot change the result, so none is lost.
* Positions: such a pair is formed only at a shared shingle that leaves room, in both sets, for the overlap that their
  sizes ask for. The first shingle that a linked pair shares always does, so none is lost; classes whose own shingles
  fill the front of their order, as in copies with many edits, form no pairs at all.
* Closed shingles: a prefix shingle that no other component's prefix holds is in neither set of an open pair, if it comes
  before the end of both prefixes. So the class whose prefix ends first must hold enough open shingles, from the shared one
  on, for the overlap; of a group of copies with many edits, most meet at none. Before texts are read for them, pairs that
  share too few prefix shingles are dropped, found from one list a class: those of large tables that meet by chance share
  one or two.

Expensive steps are written to the shared folder, and dropped there once their last reader is written. Texts are read
again for the classes to be verified rather than keeping every set; those of other classes are left out before the shuffle
by a bitmap of a fixed size. What is asked of all rows of a shingle is asked by a window where they arrive, so that they
are shuffled once.

Defined cases: null or empty text has the empty set and is linked with nothing; fewer words than ``width`` make one
shingle; repeated rows are linked with each other (an empty one is not); a row without id has a component like any
other, named by the smallest id in it (null if none has one). Extra columns are ignored, whatever their names. An empty
table gives an empty one. Of ties for the row that is kept, the smallest id wins, then the smallest text digest; rows
alike in both are one row's copies, and one of them stays. A very long text is one set, held by one task at a time and
compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import content_key, dropped, key_bit, key_marks, keyed, raw_texts, row_key, small_batches, stored, without
from .wordhash import LOWER_ASCII, mix, shingle_set


def prefix_size(n: int, percent: int) -> int:
    """How many first shingles of a set of ``n`` must hold one of any set that reaches the similarity."""
    return n - -(-percent * n // 100) + 1


def common_shingles(rows: DataFrame, width: int, most: int, block: int = 4000) -> DataFrame:
    """``token, seen``: at most ``most`` shingles that blocks of ``block`` documents report most often, with the sum of the
    reports. A block reports every shingle that two of its documents or more hold; all documents are counted. The list
    ends at a level of reports (a sixteenth of a power of two) that it can hold whole, found by counting, not by sorting."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often])],
                                              ["token", "seen"])
        sets, held = [], 0
        for batch in batches:
            for raw in raw_texts(batch.column(1)):
                sets.append(shingle_set(raw.translate(LOWER_ASCII), width))
                held += sets[-1].size
                if len(sets) >= block or held > 1 << 22:
                    yield counted(sets)
                    sets, held = [], 0
        if sets:
            yield counted(sets)

    found = rows.mapInArrow(run, "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen"))
    found = stored(found.withColumn("level", F.floor(F.log2("seen") * 16).cast("int")), "reports")
    total, cut = 0, None
    for level, k in sorted(found.groupBy("level").count().collect(), reverse=True):  # at most 16 x 64 levels
        total += k
        if total > most:
            break
        cut = level
    return found.filter(F.col("level") >= cut if cut is not None else F.lit(False)).select("token", "seen")


def _ordered(raw: bytes, width: int, tokens: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A text's shingle set in the global order."""
    own = shingle_set(raw.translate(LOWER_ASCII), width)
    if not tokens.size or not own.size:
        return own
    weight = _weights(own, tokens, seen)
    return own if not weight.any() else own[np.argsort(weight, kind="stable")]


def _weights(own: np.ndarray, tokens: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """What each shingle is ordered by before its fingerprint: its reports if it is common, else 0."""
    at = np.minimum(np.searchsorted(tokens, own), tokens.size - 1)
    return np.where(tokens[at] == own, seen[at], 0)


def _place(token: np.ndarray, tokens: np.ndarray, seen: np.ndarray) -> int:
    """Place in the global order of the only shingle of ``token``, to its first 31 + 32 bits: a lower place comes before."""
    weight = int(_weights(token, tokens, seen)[0]) if tokens.size else 0
    return weight << 32 | int(token[0]) >> 32


def _digest(tokens: np.ndarray, salt: int) -> int:
    """64-bit digest of a set or prefix, given in a canonical order."""
    if not tokens.size:
        return 0
    step = mix(np.arange(1, tokens.size + 1, dtype=np.uint64) + np.uint64(salt << 32))
    return int(np.add.reduce(mix(tokens ^ step)).view(np.int64))


class Shingler:
    """Arrow functions over ``(id, text, ...)``, bound to the order that ``common`` gives."""

    def __init__(self, spark, common: DataFrame, width: int, percent: int):
        listed = common.toArrow()  # of a fixed greatest size, see common_shingles
        tokens = listed["token"].to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        self.common = spark.sparkContext.broadcast((tokens[order], listed["seen"].to_numpy()[order].astype(np.int32)))
        self.width, self.percent = width, percent

    def sets(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
        """(ordered set, prefix size) of each row."""
        tokens, seen = self.common.value
        for raw in raw_texts(batch.column(1)):
            own = _ordered(raw, self.width, tokens, seen)
            yield own, prefix_size(own.size, self.percent) if own.size else 0

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``id, part, n, s1, s2, grp, last, prefix``: set size and digest, the group (size and prefix), where its prefix ends
        in the global order, and the prefix in order, given once for a group in a run of batches."""
        met = set()
        for batch in batches:
            out, met = [], met if len(met) < 1 << 16 else set()
            for own, k in self.sets(batch):
                grp = _digest(own[:k], own.size + 3)
                first = k > 0 and grp not in met
                met.add(grp)
                out.append((own.size, _digest(np.sort(own), 1), _digest(np.sort(own), 2), grp,
                            _place(own[k - 1:k], *self.common.value) if k else None, own[:k].view(np.int64) if first else None))
            if out:
                *digests, prefix = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in digests),
                     pa.array(prefix, pa.list_(pa.int64()))], ["id", "part", "n", "s1", "s2", "grp", "last", "prefix"])

    def members(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``vid, tokens``: whole sets of (vid, text)."""
        for batch in batches:
            if batch.num_rows:
                sets = [shingle_set(raw.translate(LOWER_ASCII), self.width).view(np.int64)
                        for raw in raw_texts(batch.column(1))]
                ends = np.concatenate([[0], np.cumsum([x.size for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))],
                    ["vid", "tokens"])


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Shared shingles that two sets of sizes ``n`` and ``m`` must have."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - F.lit(1e-9))


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Shared prefix shingles that two sets of sizes ``n`` and ``m`` must show, at least 1: the overlap their similarity
    asks for, less what can lie behind the prefix of either."""
    behind = F.greatest(*(F.ceil(F.lit(percent) * x / F.lit(100) - F.lit(1e-9)) - 1 for x in (n, m)))
    return F.greatest(_overlap(n, m, percent) - behind, F.lit(1))


def _near_size(n: Column, m: Column, percent: int) -> Column:
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _mixed(rows: DataFrame, col: str) -> DataFrame:
    """Rows of tokens that have several values of ``col``; the rows are placed by token, and are not shuffled again."""
    one = Window.partitionBy("token")
    return (rows.withColumn("_least", F.min(col).over(one)).withColumn("_most", F.max(col).over(one))
            .filter("_least <> _most").drop("_least", "_most"))


def _chosen(pivots: int) -> Column:
    """Up to ``pivots`` groups of a token, over rows (token, grp, d): those of the least ``d``, by as many random orders."""
    one = Window.partitionBy("token")
    return F.array_distinct(F.array(*(
        F.min(F.struct("d", F.xxhash64("grp", F.lit(k)).alias("h"), "grp")).over(one)["grp"] for k in range(pivots))))


def _left(rows: DataFrame, percent: int) -> DataFrame:
    """``rows(vid, n, at)`` of open prefix shingles with ``left``: how many shingles of the class can be in the set of another
    component whose prefix ends no earlier, if this is the first that they share. Those are the open ones of its prefix from
    here on, and what lies behind the prefix."""
    here = Window.partitionBy("vid").orderBy(F.col("at").desc())
    behind = F.ceil(F.lit(percent) * F.col("n") / F.lit(100) - F.lit(1e-9)) - 1
    return rows.withColumn("left", behind + F.row_number().over(here))


def _shown(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b, n, m, c``: how many tokens both of ``pairs(a, b, n, m)`` hold in ``rows(vid, token)``, of those that share one."""
    wanted = pairs.select(F.col("a").alias("vid")).unionByName(pairs.select(F.col("b").alias("vid"))).distinct()
    held = rows.select("vid", "token").join(wanted, "vid", "left_semi").groupBy("vid").agg(F.collect_set("token").alias("s"))  # a prefix at most
    both = (pairs.join(held.select(F.col("vid").alias("a"), "s"), "a")
            .join(held.select(F.col("vid").alias("b"), F.col("s").alias("t")), "b"))
    return both.select("a", "b", "n", "m", F.size(F.array_intersect("s", "t")).alias("c")).filter("c > 0")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, common: int = 1 << 20, pivots: int = 4,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, part, component`` per row; ``part`` is the text's digest, and ``component`` tells
    components apart where ids repeat (null for an empty set)."""
    small_batches(docs)
    rows = keyed(docs, id_col, text_col).withColumn("part", content_key())
    work = Shingler(docs.sparkSession, common_shingles(rows, width, common), width, percent)
    own = stored(rows.mapInArrow(work.rows, "id long, part long, n long, s1 long, s2 long, grp long, last long, prefix array<long>"), "sets")
    # classes of equal sets; the row that stands for one is its smallest
    classes = stored(own.filter("n > 0").groupBy("n", "s1", "s2", "grp")
                     .agg(F.min(F.struct("id", "part")).alias("at"), F.min("id").alias("label"), F.min("last").alias("last"))
                     .withColumn("vid", F.monotonically_increasing_id()), "classes")

    prefixes = own.filter("prefix is not null").select("grp", F.posexplode("prefix").alias("at", "token"))
    # one shuffle carries one row per group, prefix shingle and run of batches; shingles of one group only drop out where they arrive
    groups = stored(_mixed(prefixes.repartition("token"), "grp").dropDuplicates(["token", "grp"]), "shared-prefixes")

    # expand groups to members; a group of several classes is a bucket of its own
    member = classes.select("vid", "n", "last", "grp")
    several = member.groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.min("vid").alias("pivot")).filter("k > 1")
    within = member.join(several, "grp").filter("vid <> pivot").select(F.col("vid").alias("a"), F.col("pivot").alias("b"))
    bucket = stored(groups.select("token", "grp", "at").join(member, "grp").select("token", "vid", "n", "last", "at").unionByName(
        several.join(member, "grp").select(F.col("grp").alias("token"), "vid", "n", "last", F.lit(-1).alias("at"))), "buckets")

    # pivots: each class against the first member of a few groups of each of its buckets
    first = member.groupBy("grp").agg(F.min("vid").alias("pivot"), F.first("n").alias("m"))
    # a group with most of its prefix shared lies in the middle of its near copies, where most of them link
    shares = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("d")).join(first, "grp").select(
        "grp", F.round(-F.col("d") / F.col("m"), 2).alias("d"))
    # narrow rows go to their shingle once; its pivots are found there and each is named once, however many marks choose it
    low = groups.select("token", "grp").join(shares, "grp").repartition("token").select("grp", _chosen(pivots).alias("low"))
    chosen = low.select("grp", F.explode("low").alias("p")).filter("p <> grp").groupBy("grp", "p").agg(F.count(F.lit(1)).alias("c"))
    stars = (chosen.join(first.select("pivot", "m", F.col("grp").alias("p")), "p").join(member, "grp")
             .filter(F.col("vid") != F.col("pivot")).filter(_near_size(F.col("n"), F.col("m"), percent))
             .filter(F.col("c") >= _needed(F.col("n"), F.col("m"), percent))
             .select(F.col("vid").alias("a"), F.col("pivot").alias("b")))
    pairs = stored(stars.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "star-pairs")
    links = verified(pairs, classes, rows, work, percent)
    label = stored(components(links).select(F.col("vertex").alias("vid"), "component"), "star-components")

    # what is left: classes of one bucket whose components still differ
    placed = (bucket.join(label, "vid", "left")
              .select("token", "vid", "n", "last", "at", F.coalesce("component", "vid").alias("c")))
    open_ = stored(_left(_mixed(placed.repartition("token"), "c"), percent), "open-buckets")
    dropped(bucket, groups)
    x, y = open_.alias("x"), open_.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    need = _overlap(n, m, percent)
    room = F.least(n - F.col("x.at"), m - F.col("y.at")) >= need
    enough = ((F.col("x.last") <= F.col("y.last")) & (F.col("x.left") >= need)
              | (F.col("y.last") <= F.col("x.last")) & (F.col("y.left") >= need))
    rest = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.vid") < F.col("y.vid"))
                   & (F.col("x.c") != F.col("y.c")) & _near_size(n, m, percent) & room & ((F.col("x.at") < 0) | enough))
            .groupBy(F.col("x.vid").alias("a"), F.col("y.vid").alias("b"))
            .agg(F.max(n).alias("n"), F.max(m).alias("m"), F.min("x.at").alias("at")))
    rest = stored(rest.join(pairs, ["a", "b"], "left_anti"), "open-pairs")
    # members of one group share their prefix; others must show the shared prefix shingles that their sizes ask for
    shown = _shown(rest.filter("at >= 0"), open_).filter(F.col("c") >= _needed(F.col("n"), F.col("m"), percent))
    rest = stored(rest.filter("at < 0").select("a", "b").unionByName(shown.select("a", "b")), "near-pairs")
    dropped(open_, pairs)
    links = links.unionByName(verified(rest, classes, rows, work, percent))

    label = components(links).select(F.col("vertex").alias("vid"), "component")
    named = classes.join(label, "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    least = named.groupBy("component").agg(F.min("label").alias("component_id"))
    named = named.select("n", "s1", "s2", "component").join(least, "component").select(
        "n", "s1", "s2", "component_id", "component")
    return (own.join(named, ["n", "s1", "s2"], "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "part", "component"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, that of the smallest id, with all columns; rows with an empty set all stay."""
    found = stored(jaccard_components(docs, width, percent, id_col=id_col, text_col=text_col)
                   .filter("component is not null").select(F.col("doc_id").alias("id"), "part", "component"), "placed")
    least = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "part")).alias("at"))
    keep = least.select("at.id", "at.part", F.lit(True).alias("keep"))
    rows = found.groupBy("id", "part").agg(F.count(F.lit(1)).alias("copies")).alias("f")
    rows = rows.join(keep.alias("k"), F.col("f.id").eqNullSafe(F.col("k.id")) & (F.col("f.part") == F.col("k.part")), "left")
    rows = rows.select("f.id", "f.part", "f.copies", F.coalesce("k.keep", F.lit(False)).alias("keep"))
    out = stored(rows.filter("not keep or copies > 1").select("id", "part", "keep"), "leaving")
    # rows alike in id and text leave too, but for one of each that is kept
    copies = without(docs, out.filter("keep").select("id", "part"), "left_semi", id_col, text_col)
    own, part = row_key(docs, id_col, text_col)
    copies = (copies.select(F.struct("*").alias("row"), own.alias("id"), part.alias("part"))
              .dropDuplicates(["id", "part"]).select("row.*"))
    return without(docs, out.select("id", "part"), "left_anti", id_col, text_col).unionByName(copies)


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, work: Shingler, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` of classes whose sets reach the similarity, by intersecting the whole sets."""
    wanted = pairs.select(F.col("a").alias("vid")).unionByName(pairs.select(F.col("b").alias("vid"))).distinct()
    at = stored(wanted.join(classes.select("vid", "at.id", "at.part"), "vid"), "wanted")
    # merge: a join of a few wanted rows and one of many are the same plan
    texts = (_maybe_among(rows, at).alias("t").hint("merge").join(at.alias("w"), F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.part") == F.col("w.part")))
             .select("w.vid", "t.text"))
    sets = stored(texts.mapInArrow(work.members, "vid long, tokens array<long>").dropDuplicates(["vid"]), "members")
    both = (pairs.join(sets.select(F.col("vid").alias("a"), F.col("tokens").alias("s")), "a")
            .join(sets.select(F.col("vid").alias("b"), F.col("tokens").alias("t")), "b"))
    common = F.size(F.array_intersect("s", "t"))
    links = stored(both.filter(F.lit(100) * common >= F.lit(percent) * (F.size("s") + F.size("t") - common)).select("a", "b"),
                   "links")
    dropped(sets, at)
    return links


def _maybe_among(rows: DataFrame, keys: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """``id, part, text`` of all rows whose key is in ``keys(id, part)``, and of few others, so that a join shuffles no more
    texts than it needs. Keys mark a bitmap of a fixed size, which is all that reaches the driver; a full one drops no row."""
    marks = key_marks(keys, bits).toArrow()
    bitmap = np.zeros(-(-bits // 64), np.uint64)
    bitmap[marks["word"].to_numpy()] = marks["mask"].to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy().astype(np.uint64)
            mark = shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
            yield batch.select([0, 1, 2]).filter(pa.array(mark.astype(bool)))

    return rows.select("id", "part", "text", key_bit(bits).alias("bit")).mapInArrow(run, "id long, part long, text string")
