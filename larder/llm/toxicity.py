"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as overlapping windows of words. A word's input is a hashed word embedding beside the mean of hashed
character n-gram embeddings (bytes), so unseen words with a known stem are recognised. Two gated recurrent layers read the
window forwards and backwards, attention pools their states, and a logistic unit scores the pool. A document's score is
that of its worst window: no window is skipped, whatever the text's length.

Training uses a sample bounded by ``Settings.rows`` labelled rows a class and ``Settings.windows`` windows a row. As labels
are of documents, each epoch learns from the window of every document that scores highest at that point. Embeddings start
from smoothed log-odds of the sample in their first dimension and noise in the others.

Scoring is map-only. Words are embedded once per distinct word and block of texts; memory is bounded by the block.

Defined cases: null or empty text, and text without a word, scores 0; texts of any length are scored whole; without labelled
rows of both classes every score is the constant 0; an empty table gives no rows; repeated rows, null ids and extra columns
change nothing; of several labels of one id the largest holds, of several texts the one with the least digest is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import content_key, crc_fold, keyed
from .wordhash import word_hashes


@dataclass(frozen=True)
class Settings:
    rows: int = 800
    windows: int = 12
    folds: int = 5
    held_out: int = 0
    length: int = 48
    stride: int = 40
    hidden: int = 12
    word_size: int = 8
    char_size: int = 8
    buckets: int = 1 << 15
    epochs: int = 10
    batch: int = 64
    rate: float = 0.01
    block: int = 1 << 21  # characters of text embedded at once
    seed: int = 11


_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_GRAMS = (3, 5, 7)


def spans_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words of lower-case ``raw``: letters, digits, bytes beyond ASCII."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IN_WORD[np.frombuffer(raw, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Words:
    """Distinct words of some texts, as hashed word and character n-gram buckets."""

    def __init__(self, texts: list[str], buckets: int):
        raws = [x.lower().encode() for x in texts]
        raw = b"\n".join(raws)
        starts, ends = spans_of(raw)
        hashes = word_hashes(raw, starts, ends)
        distinct, first, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        limits = np.cumsum([len(x) + 1 for x in raws])
        self.bounds = np.concatenate([[0], np.searchsorted(starts, limits)])  # of each text's words
        self.word = (distinct >> np.uint64(64 - int(np.log2(buckets)))).astype(np.int64)
        starts, ends = starts[first], ends[first]
        sizes = ends - starts
        owner = np.repeat(np.arange(sizes.size), sizes)
        place = np.arange(owner.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes = np.frombuffer(raw, np.uint8)[np.repeat(starts, sizes) + place].astype(np.uint64) if sizes.size else np.zeros(0, np.uint64)
        codes[place == 0] += np.uint64(256)  # a word's first byte is a letter of its own: stems differ from inner parts
        left = np.repeat(sizes, sizes) - place
        grams, owners = [], []
        for width in _GRAMS:
            if codes.size < width:
                continue
            code = np.full(codes.size - width + 1, width, np.uint64)
            for k in range(width):
                code = code * np.uint64(0x9E3779B97F4A7C15) + codes[k: codes.size - width + 1 + k]
            fits = left[: code.size] >= width
            grams.append((code[fits] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - int(np.log2(buckets))))
            owners.append(owner[: code.size][fits])
        gram = np.concatenate(grams).astype(np.int64) if grams else np.zeros(0, np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        self.gram, self.owner = gram[order], owner[order]
        self.count = np.maximum(np.bincount(self.owner, minlength=sizes.size), 1).astype(np.float32)

    def subset(self, chosen: np.ndarray) -> Words:
        """Some of the distinct words only, by increasing index; for a training batch."""
        some = object.__new__(Words)
        some.word, some.count = self.word[chosen], self.count[chosen]
        begin = np.searchsorted(self.owner, chosen)
        size = np.searchsorted(self.owner, chosen, side="right") - begin
        at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        some.gram, some.owner = self.gram[at], np.repeat(np.arange(chosen.size), size)
        return some

    def embed(self, words: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Input vector of each distinct word."""
        mean = np.zeros((self.word.size, chars.shape[1]), np.float32)
        for k in range(chars.shape[1]):
            mean[:, k] = np.bincount(self.owner, chars[self.gram, k], minlength=self.word.size) / self.count
        return np.concatenate([words[self.word], mean], axis=1)


def windows_of(n: int, length: int, stride: int) -> np.ndarray:
    """Starts of the overlapping windows over ``n`` words; every word lies in one."""
    return np.arange(0, max(n - length, 0) + stride, stride)[: 1 + max(0, -(-(n - length) // stride))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward pass and gradients. Arrays are (time, batch, features)."""

    def __init__(self, settings: Settings, words: np.ndarray, chars: np.ndarray):
        draw = np.random.default_rng(settings.seed)
        size, h = words.shape[1] + chars.shape[1], settings.hidden
        new = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.h, self.p = h, {"words": words, "chars": chars, "attend": new(2 * h, h), "attend_b": np.zeros(h, np.float32),
                             "query": new(h), "out": new(2 * h), "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": new(size, 3 * h), f"h{side}": new(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}

    def _scan(self, side: str, given: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction, at their places. ``given``: the inputs' share of the gates."""
        h, weight = self.h, self.p[f"h{side}"]
        state = np.zeros((given.shape[1], h), np.float32)
        out = np.empty((*given.shape[:2], h), np.float32)
        for t in range(given.shape[0]) if side == "f" else range(given.shape[0] - 1, -1, -1):
            inner = state @ weight
            gates = _sigmoid(given[t, :, :2 * h] + inner[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(given[t, :, 2 * h:] + r * inner[:, 2 * h:])
            m = mask[t, :, None]
            if keep is not None:
                keep.append((t, state, inner, z, r, new))
            state = np.where(m, new + z * (state - new), state)
            out[t] = state
        return out

    def forward(self, vectors: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; ``at`` indexes the distinct words' ``vectors``."""
        p, states = self.p, []
        for side in "fb":
            given = (vectors @ p[f"x{side}"] + p[f"b{side}"])[at]
            steps = None if keep is None else []
            states.append(self._scan(side, given, mask, steps))
            if keep is not None:
                keep[side] = steps
        both = np.concatenate(states, axis=2)
        hidden = np.tanh(both @ p["attend"] + p["attend_b"])
        weight = np.where(mask, hidden @ p["query"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight *= mask
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pool = (weight[:, :, None] * both).sum(axis=0)
        if keep is not None:
            keep |= {"both": both, "hidden": hidden, "weight": weight, "pool": pool}
        return pool @ p["out"] + p["out_b"][0]

    def gradients(self, words: Words, vectors: np.ndarray, at: np.ndarray, mask: np.ndarray, slope: np.ndarray,
                  keep: dict) -> dict[str, np.ndarray]:
        """Gradients of all parameters from the logits' ``slope``, after a forward pass into ``keep``."""
        p, h = self.p, self.h
        g = {"out": keep["pool"].T @ slope, "out_b": slope.sum(keepdims=True)}
        pool = slope[:, None] * p["out"]
        both = keep["weight"][:, :, None] * pool
        score = (keep["both"] * pool).sum(axis=2)
        score = keep["weight"] * (score - (keep["weight"] * score).sum(axis=0))
        hidden = score[:, :, None] * p["query"] * (1 - keep["hidden"] ** 2)
        g["query"] = np.einsum("tbh,tb->h", keep["hidden"], score)
        g["attend"] = np.einsum("tbi,tbj->ij", keep["both"], hidden)
        g["attend_b"] = hidden.sum(axis=(0, 1))
        both = both + hidden @ p["attend"].T
        into = np.zeros_like(vectors)
        for k, side in enumerate("fb"):
            weight = p[f"h{side}"]
            back = np.zeros((at.shape[1], h), np.float32)
            given = np.zeros((*at.shape, 3 * h), np.float32)
            g[f"h{side}"] = np.zeros_like(weight)
            for t, state, inner, z, r, new in reversed(keep[side]):
                m = mask[t, :, None]
                out = (back + both[t, :, k * h:(k + 1) * h]) * m
                rest = (back + both[t, :, k * h:(k + 1) * h]) * ~m
                d_new = out * (1 - z) * (1 - new ** 2)
                d_z = out * (state - new) * z * (1 - z)
                d_r = d_new * inner[:, 2 * h:] * r * (1 - r)
                given[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"h{side}"] += state.T @ d_inner
                back = out * z + d_inner @ weight.T + rest
            flat = given.reshape(-1, 3 * h)
            summed = np.zeros((vectors.shape[0], 3 * h), np.float32)
            np.add.at(summed, at.ravel(), flat)
            g[f"x{side}"] = vectors.T @ summed
            g[f"b{side}"] = summed.sum(axis=0)
            into += summed @ p[f"x{side}"].T
        size = p["words"].shape[1]
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(g["words"], words.word, into[:, :size])
        np.add.at(g["chars"], words.gram, (into[:, size:] / words.count[:, None])[words.owner])
        return g


def _layout(starts: np.ndarray, sizes: np.ndarray, index: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, whether there is one) at each time and window."""
    place = np.arange(length)[:, None]
    mask = place < sizes
    return index[np.where(mask, starts + place, starts if starts.size else 0)], mask


def _spread(words: Words, settings: Settings, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window, or of at most ``most`` windows a text, evenly."""
    text, first, size = [], [], []
    for k, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
        if b > a:
            starts = windows_of(b - a, settings.length, settings.stride)
            if most and starts.size > most:
                starts = starts[np.linspace(0, starts.size - 1, most).astype(int)]
            text.append(np.full(starts.size, k))
            first.append(a + starts)
            size.append(np.minimum(settings.length, b - a - starts))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (text, first, size))


def _log_odds(index: np.ndarray, text: np.ndarray, label: np.ndarray, buckets: int) -> np.ndarray:
    """Smoothed log-odds of the label, per bucket, by texts that hold it."""
    pairs = np.unique(np.stack([index, text]), axis=1)
    yes = label[pairs[1]] == 1
    n1, n0 = max((label == 1).sum(), 1), max((label == 0).sum(), 1)
    a = np.bincount(pairs[0][yes], minlength=buckets) + 2.0
    b = np.bincount(pairs[0][~yes], minlength=buckets) + 2.0
    return np.log(a / (n1 + 4)) - np.log(b / (n0 + 4))


def fit(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Network | None:
    """Train on a sample; None unless it has both classes."""
    label = np.array(labels, np.int64)
    if label.size == 0 or label.min() == label.max():
        return None
    words = Words(texts, settings.buckets)
    owner, first, size = _spread(words, settings, settings.windows)
    if not owner.size:
        return None
    draw = np.random.default_rng(settings.seed)
    tables = []
    in_text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    gram_word = np.bincount(words.owner, minlength=words.word.size)
    for width, index, text in ((settings.word_size, words.word[words.index], in_text),
                               (settings.char_size, words.gram, None)):
        if text is None:  # every n-gram of every word of every text
            begin = np.concatenate([[0], np.cumsum(gram_word)])
            count = gram_word[words.index]
            at = np.repeat(begin[words.index], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            index, text = words.gram[at], np.repeat(in_text, count)
        table = 0.02 * draw.standard_normal((settings.buckets, width))
        table[:, 0] = _log_odds(index, text, label, settings.buckets)
        tables.append(table.astype(np.float32))
    network = Network(settings, *tables)
    weight = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum()) * label.size
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    step = 0
    for epoch in range(settings.epochs):
        vectors = words.embed(network.p["words"], network.p["chars"])
        logit = np.concatenate([network.forward(vectors, *_layout(first[k:k + 4096], size[k:k + 4096], words.index, settings.length))
                                for k in range(0, owner.size, 4096)])
        order = np.lexsort((-logit, owner))
        top = order[np.unique(owner[order], return_index=True)[1]]  # the worst window of each text
        for part in np.array_split(draw.permutation(top), max(1, top.size // settings.batch)):
            at, mask = _layout(first[part], size[part], words.index, settings.length)
            chosen, at = np.unique(at, return_inverse=True)
            at, some, keep = at.reshape(mask.shape), words.subset(chosen), {}
            vectors = some.embed(network.p["words"], network.p["chars"])
            miss = _sigmoid(network.forward(vectors, at, mask, keep)) - label[owner[part]]
            slope = (miss * weight[owner[part]] / part.size).astype(np.float32)
            step += 1
            for k, g in network.gradients(some, vectors, at, mask, slope, keep).items():
                a, b = moment[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                rate = settings.rate * (1 - epoch / settings.epochs) + 1e-4
                network.p[k] -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return network


def scores(network: Network, texts: list[str], settings: Settings) -> np.ndarray:
    """Score of each text: that of its worst window, 0 without a word."""
    words = Words(texts, settings.buckets)
    owner, first, size = _spread(words, settings, None)
    worst = np.full(len(texts), -np.inf)
    vectors = words.embed(network.p["words"], network.p["chars"])
    for k in range(0, owner.size, 4096):
        at, mask = _layout(first[k:k + 4096], size[k:k + 4096], words.index, settings.length)
        np.maximum.at(worst, owner[k:k + 4096], network.forward(vectors, at, mask))
    return np.where(np.isfinite(worst), _sigmoid(np.where(np.isfinite(worst), worst, 0)), 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str,
                  label_id_col: str, label_col: str) -> list:
    """At most ``rows`` (text, label) of each class, of ids that may be learned from and have a text: those with the least
    digests of their ids. Of several texts of one id the one with the least digest is taken."""
    rows = keyed(docs, id_col, text_col).filter("id is not null and text <> ''")
    marked = labels.select(F.col(label_id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.filter("id is not null and label in (0, 1)").filter(crc_fold("id", settings.folds) != settings.held_out)
    marked = marked.groupBy("id").agg(F.max("label").alias("label")).join(rows.select("id").distinct(), "id", "left_semi")
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = marked.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= settings.rows).drop("k")
    # the sample is bounded by ``rows`` a class, so it may be broadcast
    least = F.min(F.struct(content_key().alias("digest"), "text")).alias("least")
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(least).orderBy("id")
    return sample.select("least.text", "label").collect()


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
             text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row."""
    sample = training_rows(docs, labels, settings, id_col, text_col, label_id_col, label_col)
    network = fit([r["text"] for r in sample], [r["label"] for r in sample], settings)
    shared = docs.sparkSession.sparkContext.broadcast(network)  # its size is set by the settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, part, held = [], [], 0
            texts = batch.column(1).to_pylist()
            for k, text in enumerate(texts):
                part.append(text or "")
                held += len(part[-1])
                if held >= settings.block or k + 1 == len(texts):
                    found.append(scores(shared.value, part, settings) if shared.value else np.zeros(len(part)))
                    part, held = [], 0
            if texts:
                score = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])
    rows = keyed(docs, id_col, text_col)
    rows = rows.select("id", "text", F.coalesce(crc_fold("id", settings.folds) == settings.held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
