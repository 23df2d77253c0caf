"""Filter interaction audit: what every order of a set of filters keeps, removes and hides, by wide packed counters.

With five filters a document's outcome depends on seven bits only: which filters it fails, whether its label calls it good
and whether it calls it toxic. Such a state fixes the document's outcome at every step of every order, so each state maps
to one big integer, whose 64-bit fields hold those outcomes (0 or 1 at each of the 600 steps, five counters a step), its
unique failure and its removals by filter over all orders. Adding the integers of a part's documents adds all counters at
once. Fields cannot overflow into each other: the largest one, removals over all 120 orders, stays below 2**63 for fewer
than 7 * 10**16 documents. One pass over the sum's bytes unpacks it.

Plan: one pass over the texts gives 40 bytes a row (id, part, content digest, failed filters). A shuffle by id finds the
labels and, in place, joins rows alike in id. A second shuffle by content, combined map-side so that copies of one text
are one row a task, tells each text's smallest id. Counts per (part, state) are combined map-side too: at most 128
rows a part and task are shuffled, however large a part is; the integers are weighted by them and added per part.

Defined cases: null text is empty; null part is the empty string; a row without an id has no smaller one, is no smaller one
to any other, and has no label; of rows that repeat an id none is smaller than another. Several label rows of one document
count as 1 where any is 1. Texts are taken whole, however long. An empty table has no parts and gives no rows. Other
columns of either table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import raw_texts

FILTERS = "ABCDE"
_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_FIELDS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
_DUPLICATE = 1 << FILTERS.index("E")
_GOOD, _TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
_ROW = "id long, part string, digest binary, failed int"
_RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
           "good_lost long, toxic_lost long, shapley long")


def failed_filters(raw: bytes, points: int) -> int:
    """Bits of the filters A to D that a text fails; ``points`` is its length in code points."""
    words = raw.split()  # exactly the six ASCII white-space bytes
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * points) << 2
            | (len(raw.translate(None, _MARKS)) < len(raw)) << 3)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, part) to (id, part, digest, failed)."""
    for batch in batches:
        raws = raw_texts(batch.column(1))
        points = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([hashlib.sha256(r).digest() for r in raws], pa.binary()),
             pa.array([failed_filters(r, n) for r, n in zip(raws, points)], pa.int32())],
            ["id", "part", "digest", "failed"])


def orders() -> list[str]:
    """All orders of the filters, in lexicographic order."""
    return ["".join(p) for p in permutations(FILTERS)]


def packed(state: int) -> int:
    """The big integer of a state: five fields a step of every order, then unique failures and removals by filter."""
    fields = np.zeros((len(orders()) * len(FILTERS), len(_FIELDS)), "<u8")
    unique, removals = np.zeros(len(FILTERS), "<u8"), np.zeros(len(FILTERS), "<u8")
    fails = [bool(state >> k & 1) for k in range(len(FILTERS))]
    for o, order in enumerate(orders()):
        gone = False
        for t, letter in enumerate(order):
            k = FILTERS.index(letter)
            removed, redundant = fails[k] and not gone, fails[k] and gone
            gone = gone or fails[k]
            fields[o * len(FILTERS) + t] = (not gone, removed, redundant, removed and bool(state & _GOOD),
                                            removed and bool(state & _TOXIC))
            removals[k] += removed
    if sum(fails) == 1:
        unique[fails.index(True)] = 1
    return int.from_bytes(np.concatenate([fields.ravel(), unique, removals]).tobytes(), "little")


def unpacked(total: int) -> dict[str, np.ndarray]:
    """Columns of the 600 steps from a sum of packed integers."""
    n, k = len(orders()) * len(FILTERS), len(FILTERS)
    raw = np.frombuffer(total.to_bytes(8 * (n * len(_FIELDS) + 2 * k), "little"), "<u8").astype(np.int64)
    steps, unique, removals = raw[:-2 * k].reshape(n, -1), raw[-2 * k:-k], raw[-k:]
    letter = np.array([FILTERS.index(c) for order in orders() for c in order])
    return {name: steps[:, i] for i, name in enumerate(_FIELDS)} | {"unique_fails": unique[letter], "shapley": removals[letter]}


def _audit():
    """Function of one part's (part, state, n) rows, of which there are at most 128, to its 600 result rows."""
    integers: dict[int, int] = {}  # filled in the worker, kept from part to part

    def run(rows: pa.Table) -> pa.Table:
        total = 0
        for state, n in zip(rows.column("state").to_pylist(), rows.column("n").to_pylist()):
            if state not in integers:
                integers[state] = packed(state)
            total += n * integers[state]
        columns = unpacked(total)
        names = orders()
        columns = {"part": [rows.column("part")[0].as_py()] * columns["kept"].size,
                   "filter_order": [o for o in names for _ in o],
                   "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names)), **columns}
        return pa.table({name: columns[name] for name in [f.split()[0] for f in _RESULT.split(", ")]})
    return run


def _states(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, label_id: str,
            good: Column, toxic: Column) -> DataFrame:
    """``part, state, n``: how many documents of a part are in each state."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")).mapInArrow(_scan, _ROW)
    known = (labels.select(F.col(label_id).cast("long").alias("id"), good.alias("good"), toxic.alias("toxic"))
             .filter("id is not null").groupBy("id")
             .agg((F.max(F.col("good").cast("int")) * _GOOD + F.max(F.col("toxic").cast("int")) * _TOXIC).alias("label")))
    told = rows.join(known, "id", "left").withColumn(
        "state", F.col("failed") + F.coalesce("label", F.lit(0))).drop("failed", "label")
    alike = told.groupBy("id", "part", "digest", "state").agg(F.count(F.lit(1)).alias("n"))  # stays where the join put it
    # ids of a group are distinct now, so the rows at its smallest id are one entry
    texts = alike.groupBy("digest", "part", "state").agg(
        F.sum("n").alias("n"), F.min("id").alias("lo"), F.min_by("n", "id").alias("at_lo"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("lo").over(Window.partitionBy("digest"))  # a text's rows: at most four label states a part
    firsts = F.col("no_id") + F.when(F.col("lo") == first, F.col("at_lo")).otherwise(0)
    split = texts.withColumn("firsts", firsts).select("part", F.inline(F.array(
        F.struct(F.col("state"), F.col("firsts").alias("n")),
        F.struct((F.col("state") + _DUPLICATE).alias("state"), (F.col("n") - F.col("firsts")).alias("n")))))
    return split.groupBy("part", "state").agg(F.sum("n").alias("n")).filter("n > 0")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source", label_id: str = "doc_id", good: Column | None = None,
                 toxic: Column | None = None) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: one row per part
    and step of every order of the five filters. ``good`` and ``toxic`` are conditions over ``labels``."""
    good = F.coalesce((F.col("quality") == 1) if good is None else good, F.lit(False))
    toxic = F.coalesce((F.col("toxic") == 1) if toxic is None else toxic, F.lit(False))
    states = _states(docs, labels, id_col, text_col, part_col, label_id, good, toxic)
    return states.groupBy("part").applyInArrow(_audit(), _RESULT)
