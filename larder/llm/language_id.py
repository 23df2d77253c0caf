"""Language identification by error-correcting output codes.

Every learned language gets a codeword; each bit has a binary classifier over hashed character n-grams (logistic
regression, trained in numpy). A text's margins are decoded by loss: the language whose codeword costs the least total
logistic loss wins, each bit weighted by how well it did on the sample. The score is the winner's share of
exp(-loss), and a text whose two best languages lie close together is flagged as ambiguous.

The classifier is fitted on a sample bounded by ``Settings.rows`` rows a language (the smallest digests of the id) and
``Settings.chars`` characters a row. Prediction reads every text whole, map-only, one text at a time in bounded pieces.

Defined cases: null text, and text without a letter, is ``und`` with score 0, as is every text where no language could be
learned; repeated rows, null ids and extra columns change nothing; with one learned language every text is that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import crc_fold, keyed, small_batches

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    rows: int = 300
    languages: int = 200
    chars: int = 3000
    folds: int = 3
    held_out: int = 1
    buckets: int = 1 << 13
    steps: int = 120
    piece: int = 1 << 20
    ambiguous: float = 0.6


def codewords(n: int) -> np.ndarray:
    """``n`` rows of +1/-1 bits: the exhaustive code for few languages, else seeded random rows far apart."""
    if n <= 6:
        bits = max(1, 2 ** (n - 1) - 1)
        columns = [[1 if row == 0 or (mask >> (row - 1)) & 1 else -1 for row in range(n)] for mask in range(bits)]
        return np.array(columns, np.float32).T if n > 1 else np.ones((1, 1), np.float32)
    bits = 10 * int(np.ceil(np.log2(n)))
    draw = np.random.default_rng(7)
    best, far = None, -1
    for _ in range(50):
        code = draw.choice(np.array([-1, 1], np.float32), (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart.min()
    return best


class Profile:
    """Hashed character n-gram counts of texts."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.letter = np.zeros(0x110000, bool)
        for a, b in ((0, 0x3400), (0xA000, 0xD7FF + 1), (0xF900, 0x33480)):
            self.letter[a:b] = [chr(c).isalpha() for c in range(a, b)]
        self.letter[0x3400:0x4DC0] = True  # ideographs; the hexagrams between them are symbols
        self.letter[0x4E00:0xA000] = True

    def counts(self, text: str) -> np.ndarray | None:
        """Counts of the 1- to 3-grams of the text's letters, words parted by one blank; None without a letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = self.letter[codes]
        if not is_letter.any():
            return None
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # the first other character after a word stands for the blank
        codes = np.where(is_letter, codes, 32)[keep].astype(np.uint64)
        codes = np.concatenate([[np.uint64(32)], codes])
        total = np.zeros(self.buckets)
        shift = np.uint64(64 - int(np.log2(self.buckets)))
        for width, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
            if codes.size < width:
                break
            gram = codes[: codes.size - width + 1]
            for k in range(1, width):
                gram = gram * np.uint64(0x100000001B3) + codes[k: codes.size - width + 1 + k]
            total += np.bincount(((gram * np.uint64(salt)) >> shift).astype(np.int64), minlength=self.buckets)
        return total

    def of(self, text: str, piece: int) -> np.ndarray | None:
        """Unit vector of square-rooted counts of a whole text, taken in pieces; None without a letter."""
        total = None
        for k in range(0, max(len(text), 1), piece):
            part = self.counts(text[k:k + piece])
            if part is not None:
                total = part if total is None else total + part
        if total is None:
            return None
        root = np.sqrt(total).astype(np.float32)
        return root / np.linalg.norm(root)


class Model:
    """Fitted codewords, bit classifiers and bit weights."""

    def __init__(self, languages: list[str], code: np.ndarray, weight: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weight, self.bias, self.trust = languages, code, weight, bias, trust

    def decode(self, vector: np.ndarray) -> tuple[str, float]:
        """(language, its share among the learned languages)."""
        margin = 8 * (vector @ self.weight + self.bias)
        loss = (np.logaddexp(0, -self.code * margin) * self.trust).sum(axis=1)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(loss.argmin())
        return self.languages[best], float(share[best])


def fit(texts: list[str], languages: list[str], settings: Settings = Settings()) -> Model | None:
    """Fit on a sample; None where it has no usable row."""
    profile = Profile(settings.buckets)
    rows = [(profile.of(t, settings.piece), x) for t, x in zip(texts, languages)]
    rows = [(v, x) for v, x in rows if v is not None]
    if not rows:
        return None
    known = sorted({x for _, x in rows})
    code = codewords(len(known))
    vectors = np.stack([v for v, _ in rows])
    target = code[[known.index(x) for _, x in rows]]
    # each language weighs alike, however many rows the sample has of it
    share = np.array([1 / sum(x == y for _, y in rows) for _, x in rows], np.float32)[:, None]
    share /= share.sum()
    weight = np.zeros((settings.buckets, code.shape[1]), np.float32)
    bias = np.zeros(code.shape[1], np.float32)
    pace = np.zeros_like(weight)
    for _ in range(settings.steps):  # full-batch gradient steps with momentum
        margin = vectors @ weight + bias
        slope = -target / (1 + np.exp(np.clip(4 * target * margin, -30, 30))) * share
        pace = 0.9 * pace - 4.0 * (vectors.T @ slope)
        weight += pace
        bias -= 2.0 * slope.sum(axis=0)
    wrong = ((vectors @ weight + bias) * target <= 0).astype(np.float32)
    trust = np.log((1.02 - (wrong * share).sum(axis=0)) / ((wrong * share).sum(axis=0) + 0.02))
    return Model(known, code, weight, bias, np.maximum(trust, 0.05) / max(trust.max(), 0.05))


def training_rows(docs: DataFrame, settings: Settings, id_col: str, text_col: str, lang_col: str) -> list:
    """At most ``rows`` (text, lang) of each language, and ``rows * languages`` in all, from the rows that may be learned; where
    there are more languages than that, all of them have equally many rows, to one.

    Rows are counted by language first. Of the ``languages`` most frequent ones only rows go on to be ordered whose digest lies
    below a bound that some four times ``rows`` stay under, so no task meets all rows of a large language.
    """
    rows = keyed(docs, id_col, text_col, lang_col).filter(F.col("lang").isNotNull() & (F.col("text") != ""))
    fold = crc_fold("id", settings.folds)
    rows = rows.filter(fold.isNull() | (fold != settings.held_out))
    counts = rows.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.orderBy(F.desc("_rows"), "_lang").limit(settings.languages)  # so few that they may be broadcast
    bound = F.coalesce(F.least(F.lit(1.0), 4.0 * settings.rows / F.col("_rows")), F.lit(1.0)) * float(1 << 32)
    rows = rows.join(F.broadcast(counts), F.col("lang") == F.col("_lang"), "left").filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 32)) < bound)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    rows = rows.select("lang", F.substring("text", 1, settings.chars).alias("text"), F.row_number().over(order).alias("k"))
    return (rows.filter(F.col("k") <= settings.rows).orderBy("k", "lang").limit(settings.rows * settings.languages)
            .select("text", "lang").collect())


def predict(text: str | None, profile: Profile, model: Model | None, settings: Settings) -> tuple[str, float]:
    """(language, score) of a text; ``und`` where it has no letter or nothing could be learned."""
    vector = profile.of(text or "", settings.piece) if model else None
    return model.decode(vector) if vector is not None else (UNKNOWN, 0.0)


def identify(docs: DataFrame, model: Model | None, settings: Settings = Settings(), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous, part`` per row with a fitted model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile, fitted = Profile(settings.buckets), shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                name, score = predict(text, profile, fitted, settings)
                out.append((name, score, score < settings.ambiguous))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), *(pa.array(x) for x in zip(*out)), batch.column(3)],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous", "part"])
    rows = keyed(docs, id_col, text_col)
    rows = rows.select("id", "text", F.coalesce(crc_fold("id", settings.folds) == settings.held_out, F.lit(False)).alias("held_out"),
                       F.xxhash64("text").alias("part"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, part long")


def language_id(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that may be learned from and predict every row."""
    sample = training_rows(docs, settings, id_col, text_col, lang_col)
    model = fit([r["text"] for r in sample], [r["lang"] for r in sample], settings)
    return identify(docs, model, settings, id_col, text_col)


def known_language(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang") -> DataFrame:
    """Rows whose language is recognised, all columns kept: rejects exactly the rows that ``language_id`` calls ``und``, never
    a merely ambiguous text. Where no language could be learned every text is ``und`` and rejected."""
    small_batches(docs)
    sample = training_rows(docs, settings, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit([r["text"] for r in sample], [r["lang"] for r in sample], settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile, fitted = Profile(settings.buckets), shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            yield batch.filter(pa.array([predict(t, profile, fitted, settings)[0] != UNKNOWN for t in batch.column(at).to_pylist()]))
    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
