"""Substring dedup by window fingerprints, partitioned by seeds.

Built in place of a literal suffix tree. Every word position starts a suffix; two places share a passage of ``width``
words exactly where their suffixes agree to that depth. The suffixes are split into groups by short prefixes, and
prefixes that too many suffixes share are extended, so that each group fits in memory; a group's leaves are then sorted
by the fingerprint of their first ``width`` words, and runs of two or more are the repeats: the tree's internal nodes
at that one depth. Other depths are not asked for, so no suffix is sorted word by word and no edge is split.
Overlapping repeats of a document join to its maximal repeated spans.

A group's prefix is a *seed* of ``seed`` words. Suffixes that start next to each other share most of their words, so a
suffix is filed not under its literal first words but under the seed with the smallest fingerprint among those inside
its first ``width`` words (equal passages choose equal seeds at equal offsets). A run of suffixes with one seed is one
record: about a tenth of the rows, and none of the text, goes through the shuffle. A leaf's path is 64 bits of the
seed's words, the offset, and all 64 bits of the passage's fingerprint: under one seed, where the first 64 agree by
construction, n distinct passages make some n*n / 2^65 false pairs. Words are not compared.

Plan: (1) count seeds, with map-side combining; those of more than ``group_limit`` records are *crowded*. (2) Shuffle the
records by seed; each task sorts them and streams group by group, a group being at most ``group_limit`` records (some
6 MB of edges).
Suffixes under crowded seeds have their prefix extended to the whole passage instead: their leaves are counted per
passage with map-side combining and a join that may be split, so no task meets a crowded group whole.
(3) Join the repeated spans to the texts by row key. Passages that recur inside one text are found there, and enter the
shuffle once.

Defined cases: null, empty and short texts have nothing removed; rows that repeat (even with one id) are separate
documents and lose all their windows; null ids are kept; texts of any length are taken whole, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import content_key, keyed, raw_texts, stored
from .wordhash import covered, text_words, window_hashes, word_spans

_EDGE = 8  # bytes of a passage's fingerprint under its seed: all of it, as one hot seed may have millions of passages


def least_positions(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the first smallest value in every run of ``span`` values."""
    at, have = np.arange(values.size), 1
    best = values
    while have < span:
        step = min(have, span - have)
        right = best[step:]
        left = best[: right.size]
        take = right < left
        best = np.where(take, right, left)
        at = np.where(take, at[step:], at[: right.size])
        have += step
    return at


def passages(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word fingerprints, passage fingerprint by start, whether the passage is the text's first such)."""
    words = text_words(raw)
    prints = window_hashes(words, width)
    first = np.zeros(prints.size, bool)
    if prints.size:
        first[np.unique(prints, return_index=True)[1]] = True
    return words, prints, first


def seed_runs(raw: bytes, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of first-seen passages with one seed: (seed fingerprint, start, length, seed offset at the start), and all
    passage fingerprints."""
    words, prints, first = passages(raw, width)
    if not prints.size:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, prints
    grams = window_hashes(words, seed)
    at = least_positions(grams, width - seed + 1)
    new = np.ones(prints.size, bool)
    new[1:] = (at[1:] != at[:-1]) | (first[1:] != first[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, prints.size))
    keep = first[starts]
    starts, sizes = starts[keep], sizes[keep]
    return grams[at[starts]], starts, sizes, at[starts] - starts, prints


def _edges(prints: np.ndarray) -> np.ndarray:
    """Each fingerprint as a row of bytes."""
    return prints.astype("<u8").view(np.uint8).reshape(-1, _EDGE)


def _records(width: int, seed: int, whole: bool):
    """``mapInArrow`` function over (id, text, part): seed records, or only their seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0), batch.column(2)
            row, out = [], ([], [], [], [])
            for k, raw in enumerate(raw_texts(batch.column(1))):
                seeds, starts, sizes, offsets, prints = seed_runs(raw, width, seed)
                if not seeds.size:
                    continue
                out[0].append(seeds.view(np.int64))
                if whole:
                    row.append(np.full(seeds.size, k))
                    out[1].append(starts)
                    out[2].append(offsets)
                    edges = _edges(prints)
                    out[3].extend(edges[a:a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist()))
            if not out[0]:
                continue
            seeds = pa.array(np.concatenate(out[0]))
            if not whole:
                yield pa.RecordBatch.from_arrays([seeds], ["seed"])
                continue
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [seeds, ids.take(take), parts.take(take), pa.array(np.concatenate(out[1]).astype(np.int32)),
                 pa.array(np.concatenate(out[2]).astype(np.int32)), pa.array(out[3], pa.binary())],
                ["seed", "id", "part", "start", "offset", "edges"])
    return run


_RECORD = "seed long, id long, part long, start int, offset int, edges binary"


def _flatten(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Leaves of a batch of records: (record, index in the record, seed offset, edge)."""
    edges = batch.column("edges").cast(pa.large_binary())
    ends = np.frombuffer(edges.buffers()[1], np.int64)[edges.offset:edges.offset + len(edges) + 1]
    edge = np.frombuffer(edges.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].copy().view("<u8")
    sizes = np.diff(ends) // _EDGE
    record = np.repeat(np.arange(len(edges)), sizes)
    index = np.arange(record.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return record, index, batch.column("offset").to_numpy()[record] - index, edge


def _spans(batch: pa.RecordBatch, record: np.ndarray, index: np.ndarray) -> pa.RecordBatch:
    """Repeated leaves, ordered by record and index, as spans of starts."""
    new = np.ones(record.size, bool)
    new[1:] = (record[1:] != record[:-1]) | (index[1:] != index[:-1] + 1)
    first = np.flatnonzero(new)
    take = pa.array(record[first])
    start = batch.column("start").to_numpy()[record[first]] + index[first]
    size = np.diff(np.append(first, record.size))
    return pa.RecordBatch.from_arrays(
        [batch.column("id").take(take), batch.column("part").take(take), pa.array(start.astype(np.int32)),
         pa.array(size.astype(np.int32))], ["id", "part", "start", "size"])


_SPAN = "id long, part long, start int, size int"


def subtree_repeats(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Build the trees of a batch of whole groups: sort the leaves by path (seed, then edge); a run of two or more equal
    paths is an internal node at passage depth, and its leaves are repeats."""
    record, index, offset, edge = _flatten(batch)
    seed = batch.column("seed").to_numpy()[record]
    order = np.lexsort((edge, offset, seed))
    same = ((seed[order][1:] == seed[order][:-1]) & (offset[order][1:] == offset[order][:-1])
            & (edge[order][1:] == edge[order][:-1]))
    node = np.zeros(record.size, bool)
    node[order[1:][same]] = True
    node[order[:-1][same]] = True
    return _spans(batch, record[node], index[node])


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream records sorted by seed, holding back the last group of each batch until it is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        seeds = batch.column("seed").to_numpy()
        last = int(np.searchsorted(seeds, seeds[-1]))
        if last == 0 and held and held[-1].column("seed")[-1].as_py() == seeds[0]:
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks() if held else None
        for part in whole.to_batches() if whole is not None else [batch.slice(0, last)]:
            if part.num_rows:
                yield subtree_repeats(part)
        held = [batch.slice(last)]
    if held:
        for part in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield subtree_repeats(part)


def _crowded_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per leaf of crowded records: the extended prefix is the whole passage."""
    for batch in batches:
        if not batch.num_rows:
            continue
        record, index, offset, edge = _flatten(batch)
        take = pa.array(record)
        yield pa.RecordBatch.from_arrays(
            [batch.column("seed").take(take), pa.array(offset.astype(np.int32)), pa.array(edge.view(np.int64)),
             batch.column("id").take(take), batch.column("part").take(take),
             pa.array((batch.column("start").to_numpy()[record] + index).astype(np.int32))],
            ["seed", "offset", "edge", "id", "part", "start"])


def repeated_spans(docs: DataFrame, width: int = 35, seed: int = 8, group_limit: int = 20_000,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, part, start, size``: runs of ``size`` passage starts, from word ``start`` on, whose ``width`` words also start
    in another row. ``part`` is the text's digest; with the id it is the row's key. Passages that recur only inside one
    text are not among them."""
    rows = keyed(docs, id_col, text_col).withColumn("part", content_key())
    crowded = (rows.mapInArrow(_records(width, seed, False), "seed long").groupBy("seed").count()
               .filter(F.col("count") > group_limit).select("seed", F.lit(True).alias("crowded")))
    records = (rows.mapInArrow(_records(width, seed, True), _RECORD)
               .join(stored(crowded, "crowded-seeds"), "seed", "left"))
    small = (records.filter("crowded is null").drop("crowded").repartition("seed").sortWithinPartitions("seed")
             .mapInArrow(_by_group, _SPAN))
    leaves = records.filter("crowded").drop("crowded").mapInArrow(
        _crowded_leaves, "seed long, offset int, edge long, id long, part long, start int")
    path = ["seed", "offset", "edge"]
    nodes = leaves.groupBy(*path).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    large = leaves.join(nodes, path).select("id", "part", "start", F.lit(1).alias("size"))
    return small.unionByName(large)


def _kept(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            spans = batch.column(2).to_pylist()
            for raw, found in zip(raw_texts(batch.column(1)), spans):
                starts, ends = word_spans(raw)
                n = starts.size
                gone = np.zeros(n, bool)
                if n >= width:
                    _, prints, first = passages(raw, width)
                    again = np.zeros(prints.size, bool)
                    if not first.all():
                        again = np.isin(prints, prints[~first])
                    for x in found or ():
                        again[x["start"]:x["start"] + x["size"]] = True
                    gone = covered(np.flatnonzero(again), width, n)
                kept = b" ".join([raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist())])
                out.append((n, int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                            *((kept.decode(),) if with_text else ())))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(x) for x in zip(*out))],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])
    return run


def remove_repeats(docs: DataFrame, width: int = 35, seed: int = 8, group_limit: int = 20_000, with_text: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) per row: words in a passage of ``width`` words whose
    sequence also starts anywhere else are removed, judged on the input."""
    spans = (repeated_spans(docs, width, seed, group_limit, id_col, text_col).groupBy("id", "part")
             .agg(F.collect_list(F.struct("start", "size")).alias("spans")).alias("s"))  # bounded by the text's length
    rows = keyed(docs, id_col, text_col).withColumn("part", content_key()).alias("t")
    joined = rows.join(spans, F.col("t.id").eqNullSafe(F.col("s.id")) & (F.col("t.part") == F.col("s.part")), "left")
    return joined.select("t.id", "t.text", "s.spans").mapInArrow(
        _kept(width, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string"
        + (", kept_text string" if with_text else ""))
