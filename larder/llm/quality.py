"""Quality rules by compression bands.

Text that repeats itself compresses far better than prose, and text without structure (keys, encoded blobs) far worse.
Each document's zstandard ratio (compressed bytes / bytes) must lie in a band that depends on the document's length,
because short texts carry the frame's overhead and long ones profit from distant repeats. Fixed chunks of long
documents, and the rest behind the last, are held against bands of their own, so a repetitive or opaque part is seen
inside a sound document.
Word counts, symbol counts, repeated lines and repeated five-word windows are taken in the same pass.

Map-only: one Arrow pass over the texts, no shuffle. One text is held at a time.

Defined cases: null or empty text has zero counts, fails the base rule (fewer than 10 words) and is not kept; texts of one
chunk or less are judged whole only; repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .shared import keyed, raw_texts
from .wordhash import repeated_window_words, text_words, word_spans

_SYMBOLS = b"#*$%&|<>"
_NONE = float("inf")


@dataclass(frozen=True)
class Bands:
    """``whole``: (least bytes, lowest ratio, highest ratio, highest ratio of three-byte scripts), longest first; the first
    that a text reaches holds. ``chunk`` bounds the ratio of each full chunk; the rest behind the last is a chunk with the band of
    its own length. More than ``chunk_share`` of the bytes in chunks outside their band rejects the text.

    The highest ratios lie between prose of the band's least length and opaque text of its greatest, as measured (see
    README). Three-byte scripts come nearer to noise while short: their limit holds from half the bytes on, and between
    the two for a smaller share. Below 128 bytes neither prose nor a key compresses, and there is no upper limit."""
    whole: tuple[tuple[int, float, float, float], ...] = (
        (16384, 0.15, 0.64, 0.64), (4096, 0.18, 0.64, 0.64), (2048, 0.22, 0.64, 0.71), (1536, 0.22, 0.66, 0.74),
        (1024, 0.22, 0.72, 0.785), (768, 0.28, 0.765, 0.83), (512, 0.28, 0.78, 0.90), (384, 0.28, 0.815, 0.97),
        (256, 0.28, 0.85, 1.045), (192, 0.34, 0.89, 1.1), (160, 0.34, 0.93, 1.1), (128, 0.34, 0.97, 1.1),
        (64, 0.45, _NONE, _NONE), (32, 0.65, _NONE, _NONE), (1, 0.75, _NONE, _NONE))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.18, 0.64)
    chunk_share: float = 0.25
    level: int = 3


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long")


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in raw.split(b"\n") if x.strip(b"\t\n\x0b\x0c\r ")]
    return len(lines) - len(set(lines))


def limits(raw: bytes, bands: Bands) -> tuple[float, float]:
    """(lowest, highest ratio) for a text of this length and script."""
    low, high, wide = next((x[1:] for x in bands.whole if len(raw) >= x[0]), (0.0, _NONE, _NONE))
    if wide == high:
        return low, high
    share = 3 * int((np.frombuffer(raw, np.uint8) >= 0xE0).sum()) / len(raw)
    return low, high + min(1.0, 2 * share) * (wide - high)


def compression(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(whole ratio, chunks outside their band, chunks, whether the text is within its bands)."""
    if not raw:
        return 1.0, 0, 0, True
    ratio = len(packer.compress(raw)) / len(raw)
    low, high = limits(raw, bands)
    size = bands.chunk_bytes
    parts = [len(packer.compress(raw[k:k + size])) / size for k in range(0, len(raw) - size + 1, size)]
    n, outside = len(parts), sum(not bands.chunk[0] <= x <= bands.chunk[1] for x in parts)
    lost = outside * size
    if n and (tail := raw[n * size:]):
        n += 1
        least, most = limits(tail, bands)
        if not least <= len(packer.compress(tail)) / len(tail) <= most:
            outside, lost = outside + 1, lost + len(tail)
    return ratio, outside, n, low <= ratio <= high and lost <= bands.chunk_share * len(raw)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: the counts, ``base_failed``, the compression figures and ``kept``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            out = []
            for raw in raw_texts(batch.column(1)):
                starts, ends = word_spans(raw)
                n = starts.size
                codes = np.frombuffer(raw, np.uint8)
                # code points inside words: bytes that neither continue a character nor separate words
                spaces = int(len(raw) - (ends - starts).sum())
                chars = int((codes & 0xC0 != 0x80).sum()) - spaces
                repeats = repeated_window_words(text_words(raw), 5)
                failed = n < 10 or 100 * repeats > 20 * n
                ratio, bad, chunks, within = compression(raw, bands, packer)
                out.append((n, chars, sum(raw.count(bytes([s])) for s in _SYMBOLS), duplicate_lines(raw), repeats,
                            failed, not failed and within, ratio, bad, chunks))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(x) for x in zip(*out))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept", "ratio", "bad_chunks", "n_chunks"])
    return keyed(docs, id_col, text_col).mapInArrow(run, SCHEMA)
