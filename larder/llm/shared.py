"""Helpers of the training-data operators: stored intermediate tables, row keys, Arrow plumbing."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import checkpoint_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a fresh table in the shared folder and read it back.

    Cuts the lineage at files that every executor can reach, so a lost executor costs no recomputation, and numbers
    given by ``monotonically_increasing_id`` stay what they were when written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/larder-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(docs: DataFrame, size: int = 1 << 20) -> None:
    """Bound the Arrow batches between Spark and Python by bytes, unless the session bounds them itself. By rows alone, ten
    thousand texts are one batch, which an executor holds several times over in each of its Python workers and beside its heap."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(size))


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``stored``, all readers of which are written."""
    for table in tables:
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """``(id, text)`` of every row, null text as empty, under fixed names so that other columns cannot clash."""
    cols = [F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    if lang_col:
        cols.append(F.col(lang_col).alias("lang"))
    return docs.select(*cols)


def content_key(text: str | Column = "text") -> Column:
    """64-bit digest of a text. With the id it tells rows apart whose ids are null or repeated; rows alike in both
    are the same work with the same result."""
    return F.xxhash64(text)


def crc_fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; the hold-out rule of the learned operators."""
    return F.crc32(F.col(id_col).cast("string").cast("binary") if isinstance(id_col, str)
                   else id_col.cast("string").cast("binary")) % folds


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """The key of a row as ``keyed`` and ``content_key`` give it, over the table's own columns."""
    return (F.col(id_col).cast("long"), content_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def key_marks(keys: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """``word, mask``: a bitmap of a fixed size in which every key of ``keys(id, part)`` marks its ``key_bit``."""
    return keys.select(key_bit(bits).alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("mask"))


def key_bit(bits: int) -> Column:
    """The bit of a key ``id, part`` in a bitmap of ``bits``."""
    return F.pmod(F.xxhash64("id", "part"), F.lit(bits))


def without(docs: DataFrame, keys: DataFrame, how: str = "left_anti", id_col: str = "doc_id",
            text_col: str = "text", bits: int = 1 << 24) -> DataFrame:
    """Rows of ``docs`` whose key is not (``left_anti``) or is (``left_semi``) in ``keys(id, part)``, all columns kept. Whole
    rows go through the join as one struct, so that no column can clash.

    A bitmap of a fixed size, made of the keys and broadcast, shows most rows that have none of them; only the others are
    joined, and shuffled if ``keys`` are many. ``keys`` and ``docs`` are read twice. A full bitmap sends all rows to the join."""
    own, part = row_key(docs, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), own.alias("id"), part.alias("part")).withColumn("bit", key_bit(bits)).alias("d")
    marks = F.broadcast(key_marks(keys, bits)).alias("m")
    marked = ((F.floor(F.col("d.bit") / 64) == F.col("m.word"))
              & F.expr("(shiftright(m.mask, CAST(d.bit % 64 AS INT)) & 1L) = 1L"))
    same = F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.part") == F.col("k.part"))
    # a semi-join, as Spark would move the join with the keys below an inner one
    found = rows.join(marks, marked, "left_semi").join(keys.select("id", "part").alias("k"), same, how).select("row")
    if how == "left_anti":
        found = found.unionByName(rows.join(marks, marked, "left_anti").select("row"))
    return found.select("row.*")
