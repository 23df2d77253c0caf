"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content under the digest of the tokenizer file, so a count is valid for
exactly one tokenizer version. Digests are joined to the cache; only distinct texts that it lacks are encoded, their counts
appended as a new part of the cache, and all rows read their count from it. "Normalised" means what cannot change a
count: null is the empty text; nothing else is altered, because the tokenizer is sensitive to case and white space.

The first pass moves digests only. The text of one row per missing digest is fetched by a join on the row's key and
encoded where it lands; copies, however many, are never encoded or moved twice. No group is gathered: a digest's
representative is a ``min`` with map-side combining.

Defined cases: null or empty text has 0 bytes and 0 tokens; repeated rows each get their row; an absent cache is empty; a
cache part lost or written twice is harmless (counts are read as ``max`` per digest); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import checkpoint_dir

from .shared import content_key, keyed, stored

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of a tokenizer file: its version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


#: Texts of these characters only are split into pre-tokens here; any other text goes to the library whole. ASCII without the
#: control characters on whose class regex engines disagree, Latin letters, and common punctuation.
_PLAIN = re.compile("[\\t-\\r -~À-ÖØ-öø-ɏ–-”†-…]*")
#: Fixed value: the byte-level pre-tokenizer's split, with its classes spelt out for the characters above.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\\sA-Za-zÀ-ÖØ-öø-ɏ0-9]+|\\s+(?!\\S)|\\s+")


class Counter:
    """Token counts of texts by the library that a tokenizer file belongs to, in its default handling.

    With byte-level BPE, tokens never cross a pre-token, so the library's model sees each distinct pre-token once and a
    text's count is the sum over its pre-tokens; special strings and unusual characters take the library's whole path.
    """

    def __init__(self, path: str, payload: bytes, held: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.held, self.known = held, {}
        if not path.endswith(".json"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_proto=payload)
            self.whole, self.split = (lambda text: len(pieces.encode(text, num_threads=1))), False
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_buffer(payload)
        library.no_truncation()
        library.no_padding()
        self.whole = lambda text: len(library.encode(text, add_special_tokens=False).ids)
        kind = json.loads(payload)
        pre = kind.get("pre_tokenizer") or {}
        self.split = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                      and not kind.get("normalizer") and not kind.get("post_processor"))
        self.special = [x["content"] for x in kind.get("added_tokens", [])]
        self.model = library.model
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in set(plain) else next(rest)) for b in range(256)}
        self.alphabet = str.maketrans({chr(b): c for b, c in self.alphabet.items()})

    def count(self, text: str) -> int:
        if not self.split or not _PLAIN.fullmatch(text) or any(x in text for x in self.special):
            return self.whole(text)
        parts = _SPLIT.findall(text)
        known = self.known
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > self.held:
                known.clear()
            for part in parts:
                if part not in known:
                    known[part] = len(self.model.tokenize(part.encode().decode("latin-1").translate(self.alphabet)))
            return sum(map(known.__getitem__, parts))


def read_cache(spark: SparkSession, cache_path: str | None, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest; no rows where there is no cache yet."""
    if cache_path is None:
        return spark.createDataFrame([], CACHE_SCHEMA)
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return (spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)
            .groupBy("tokenizer", "digest").agg(F.max("n_tokens").alias("n_tokens")))


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """``(digest, n_tokens)`` of ``(digest, text)``."""
    with open(path, "rb") as f:
        payload = f.read()
    shared = misses.sparkSession.sparkContext.broadcast(payload)  # one tokenizer file, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, shared.value)
        for batch in batches:
            sizes = [counter.count(text) for text in batch.column(1).to_pylist()]
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["digest", "n_tokens"])
    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row. New counts are appended to ``cache_path`` (default: a table of
    the session's shared folder), where later runs find them."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or f"{checkpoint_dir(spark)}/larder-llm/token-cache"
    rows = keyed(docs, id_col, text_col)
    # sha2 gives hexadecimal text; half the bytes travel as binary
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    keys = stored(rows.select("id", content_key().alias("part"), digest.alias("digest"),
                              F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    cache = read_cache(spark, cache_path, version).select("digest", "n_tokens")
    missing = (keys.join(cache, "digest", "left_anti").groupBy("digest")
               .agg(F.min(F.struct(F.col("id"), F.col("part"))).alias("at"))
               .select("digest", "at.id", "at.part"))
    texts = rows.withColumn("part", content_key()).alias("t")
    fetched = (texts.join(missing.alias("m"), F.col("t.id").eqNullSafe(F.col("m.id")) & (F.col("t.part") == F.col("m.part")))
               .select("m.digest", "t.text"))
    counted = stored(encode_misses(fetched, tokenizer_path).select(
        F.lit(version).alias("tokenizer"), "digest", "n_tokens"), "counts")
    counted.write.mode("append").parquet(cache_path)
    known = reduce(DataFrame.unionByName, [cache, counted.select("digest", "n_tokens")])
    known = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return (keys.join(known, "digest").select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
