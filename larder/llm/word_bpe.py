"""BPE encoding and decoding with a word-end vocabulary, by contiguous rank arrays.

A word is split into its bytes; one array holds the parts that remain and one the merge rank of each adjacent pair. The
smallest rank is looked up by a scan, its boundary deleted by closing the gap, and the ranks on either side refreshed,
until no pair can merge. Words are short, so scanning a contiguous array beats a heap; the scans here run over all distinct
new words of a length at once, one word per matrix row. Words of more parts than ``LONG`` (runs without a break) go
through a heap, whose cost does not grow with the square of their length.

Text is split as the vocabulary's file says: special strings first, then NFC, white space, lower case, then the word
pattern. Decoding joins the tokens' strings by a space, which is what the library does for a file without a decoder.

Map-only: texts are encoded where they lie; each task keeps a bounded cache of the words it has met.

Defined cases: null or empty text has no ids and decodes to the empty text; repeated rows, null ids and extra columns
change nothing; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import keyed, small_batches

LONG = 48
_NONE = np.iinfo(np.int32).max

# The split pattern of the vocabulary's file, in full and with its classes spelt out for plain Latin text.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zé]+|[0-9²]|[^ a-zé0-9²]+")  # over a text's classes, see ``_Classes``
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ɏß]+|[0-9]|[^\\sa-zà-öø-ɏß0-9]+")
#: Texts of these characters only: NFC leaves them alone and lower case maps each to one letter of the pattern above.
_PLAIN = re.compile("[\\t-\\r -~\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u0148\\u2013-\\u201d\\u2020-\\u2026]*")


#: White space of the vocabulary's regex engine
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class _Classes(dict):
    """``str.translate`` table: ASCII letters, digits, quote and blank as they are, any other letter as é, number as ² and the
    rest as a dash, by Unicode category."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = char in "abcdefghijklmnopqrstuvwxyz0123456789' "
        self[code] = char if plain else {"L": "é", "N": "²"}.get(unicodedata.category(char)[0], "-")
        return self[code]


_CLASSES = _Classes()


class WordBpe:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, payload: str | bytes, held: int = 1 << 19):
        spec = json.loads(payload)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
                                           + ")") if self.special else None
        end = model["end_of_word_suffix"] or ""
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(256, 512))
        letters = [chr(b) if b in plain else chr(next(spare)) for b in range(256)]
        self.inner = np.array([self.ids[c] for c in letters], np.int32)
        self.last = np.array([self.ids[c + end] for c in letters], np.int32)
        size = max(self.ids.values()) + 1
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((self.ids[a], self.ids[b], self.ids[a + b])
                                                                  for a, b in pairs)))
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.rank, self.made = size, keys[order], order.astype(np.int32), made[order].astype(np.int32)
        self.held = held
        self.forget()

    def forget(self) -> None:
        """Start an empty word cache."""
        self.index: dict[str, int] = {}
        self.word_text: list[str] = []
        self.ends = np.zeros(1, np.int64)  # of the words' ids in ``flat``, with a leading 0
        self.flat = np.zeros(0, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rank (``_NONE``: cannot merge) and merged id of each pair."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], _NONE), self.made[at]

    def merge_rows(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of words of one length, one a row of ``parts``, as (row numbers, their ids as a matrix)."""
        n, width = parts.shape
        rows = np.arange(n)
        rank = np.full((n, max(width - 1, 1)), _NONE, np.int32)
        if width > 1:
            rank, _ = self.ranks(parts[:, :-1], parts[:, 1:])
        while True:
            at = rank.argmin(axis=1)  # the first of equal ranks, as merges go from the left
            open_ = rank[np.arange(rows.size), at] != _NONE
            if not open_.all():
                yield rows[~open_], parts[~open_]
            if not open_.any():
                return
            rows, parts, rank, at = rows[open_], parts[open_], rank[open_], at[open_]
            every = np.arange(rows.size)
            _, made = self.ranks(parts[every, at], parts[every, at + 1])
            width = parts.shape[1]
            # delete the boundary after ``at``: close the gap in the parts and in the ranks
            keep = np.arange(width - 1)
            parts = np.take_along_axis(parts, keep + (keep > at[:, None]), axis=1)
            parts[every, at] = made
            if width == 2:
                rank = np.full((rows.size, 1), _NONE, np.int32)
                continue
            keep = np.arange(width - 2)
            rank = np.take_along_axis(rank, keep + (keep >= at[:, None]), axis=1)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.ranks(parts[before, at[before] - 1], parts[before, at[before]])[0]
            after = np.flatnonzero(at < width - 2)
            rank[after, at[after]] = self.ranks(parts[after, at[after]], parts[after, at[after] + 1])[0]

    def merge_long(self, parts: np.ndarray) -> np.ndarray:
        """Ids of one long word: a heap of pair ranks over a linked list of parts."""
        ids, n = parts.tolist(), parts.size
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank, made = self.ranks(parts[:-1], parts[1:])
        heap = [(int(r), k, ids[k], ids[k + 1], int(m)) for k, (r, m) in enumerate(zip(rank, made)) if r != _NONE]
        heapq.heapify(heap)
        alive = [True] * n

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                r, m = self.ranks(np.array([ids[k]]), np.array([ids[after[k]]]))
                if r[0] != _NONE:
                    heapq.heappush(heap, (int(r[0]), k, ids[k], ids[after[k]], int(m[0])))

        while heap:
            _, k, a, b, merged = heapq.heappop(heap)
            if not alive[k] or ids[k] != a or after[k] < 0 or ids[after[k]] != b:
                continue
            gone = after[k]
            ids[k], alive[gone], after[k] = merged, False, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return np.array([x for x, live in zip(ids, alive) if live], np.int32)

    def learn(self, words: list[str]) -> None:
        """Put distinct new words into the cache."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            by_length.setdefault(len(raw), []).append((word, raw))
        begun = self.flat.size
        blocks, sizes, tokens = [self.flat], [], self.tokens
        for length, group in by_length.items():
            step = max(1, (1 << 20) // length)
            for k in range(0, len(group), step):
                some = group[k:k + step]
                codes = np.frombuffer(b"".join([raw for _, raw in some]), np.uint8).reshape(len(some), length)
                parts = self.inner[codes]
                parts[:, -1] = self.last[codes[:, -1]]
                done = self.merge_rows(parts) if length <= LONG else (
                    (np.array([r]), self.merge_long(row)[None]) for r, row in enumerate(parts))
                for rows, ids in done:
                    blocks.append(ids.ravel())
                    sizes.append(np.full(rows.size, ids.shape[1]))
                    for r, own in zip(rows.tolist(), ids.tolist()):
                        self.index[some[r][0]] = len(self.index)
                        self.word_text.append(" ".join([tokens[i] for i in own]))
        self.flat = np.concatenate(blocks)
        self.ends = np.concatenate([self.ends, begun + np.cumsum(np.concatenate(sizes))])

    def words(self, text: str) -> list[str]:
        """Words of a text without special strings."""
        if _PLAIN.fullmatch(text):
            return _PLAIN_WORDS.findall(text.lower())
        text = _BLANKS.sub(" ", unicodedata.normalize("NFC", text))
        text = "".join([c.lower() for c in text])
        return [text[m.start():m.end()] for m in _WORDS.finditer(text.translate(_CLASSES))]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids of each text, and the decoded text of those ids."""
        pieces, ends = [], []  # words of all texts in order; a special string stands as itself in a 1-tuple
        for text in texts:
            if self.special_split and any(x in text for x in self.special):
                for piece in self.special_split.split(text):
                    pieces += [(piece,)] if piece in self.special else self.words(piece)
            else:
                pieces += self.words(text)
            ends.append(len(pieces))
        if len(self.index) > self.held:
            self.forget()
        new = set(pieces).difference(self.index)
        for piece in [x for x in new if isinstance(x, tuple)]:
            new.discard(piece)
            self.index[piece] = len(self.index)
            self.word_text.append(piece[0])
            self.flat = np.append(self.flat, np.int32(self.special[piece[0]]))
            self.ends = np.append(self.ends, self.flat.size)
        if new:
            self.learn(list(new))
        words = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        begin, size = self.ends[words], self.ends[words + 1] - self.ends[words]
        until = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - until[:-1], size) + np.arange(until[-1])]
        begun = 0
        for end in ends:
            yield ids[until[begun]:until[end]], " ".join([self.word_text[k] for k in words[begun:end].tolist()])
            begun = end

    def decode(self, ids) -> str:
        """Text of ids: the tokens' strings, special ones included, joined by a space."""
        return " ".join([self.tokens[int(i)] for i in ids])


def _load(docs: DataFrame, tokenizer_path: str):
    with open(tokenizer_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # one tokenizer file, a fixed size


def _chunks(texts: list, size: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters, null as empty; a longer text is a run of its own."""
    part, held = [], 0
    for text in texts:
        part.append(text or "")
        held += len(part[-1])
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` per row: the operator's real output."""
    payload = _load(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(payload.value)
        for batch in batches:
            done = [x for part in _chunks(batch.column(1).to_pylist()) for x in bpe.encode(part)]
            if done:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([i.tolist() for i, _ in done], pa.list_(pa.int32())),
                     pa.array([t for _, t in done])], ["doc_id", "ids", "decoded"])
    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row, for comparing encoders without moving their output."""
    small_batches(docs)
    payload = _load(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(payload.value)
        for batch in batches:
            out = [(ids.size, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest())
                   for part in _chunks(batch.column(1).to_pylist()) for ids, decoded in bpe.encode(part)]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in zip(*out))],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return keyed(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
