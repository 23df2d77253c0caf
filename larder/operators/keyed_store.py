"""A keyed snapshot that is updated in place of its parts: rows lie in hash buckets of the key, and an upsert rewrites the
buckets that its updates touch, the others stay as the files they are.

Each published version (see ``sources.versions``) names the folder of every bucket, so a version is whole at any moment, readers
are not disturbed, and an upsert that was overtaken by another starts again from the newer version. Cost follows the touched
buckets: with b buckets and updates to t of them, t / b of the snapshot is read and written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.publish import last_by_id
from larder.sources.tables import file_system, stored
from larder.sources.versions import Version, VersionConflict, history, publish, read_version, version

_BUCKET = "_bucket"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, base: str, key: str, buckets: int) -> dict[str, list[str]]:
    """Write rows by bucket to a new folder; its bucket folders by bucket. ``rebalance`` brings a bucket's rows together and
    splits buckets that are too large for one task."""
    spark = rows.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    path = f"{base.rstrip('/')}/{name}"
    rows.withColumn(_BUCKET, _bucket(key, buckets)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).option(
        "compression", "zstd").parquet(path)
    fs, own = file_system(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(own) if f.isDirectory()]
    return {f.split("=")[1]: [f"{name}/{f}"] for f in found if f.startswith(f"{_BUCKET}=")}


def create_store(rows: DataFrame, base: str, key: str = "id", buckets: int = 64, order_col: str | None = None) -> Version:
    """Publish ``rows`` as the first version of the store at ``base``; of several rows with one key the last (see
    ``last_by_id``). Rows without a key are not accepted: they could never be updated."""
    spark = rows.sparkSession
    if history(spark, base):
        raise VersionConflict(f"{base} holds a dataset already")
    rows = last_by_id(rows.filter(F.col(key).isNotNull()), order_col, key)
    return publish(spark, base, _write(rows, base, key, buckets), rows.schema, 0, {"key": key, "buckets": buckets})


def upsert_store(updates: DataFrame, base: str, order_col: str | None = None, attempts: int = 3) -> Version:
    """Replace or add rows by key: of several updates of one key the one with the largest ``order_col`` (its arrival) stands, equal
    ones are told apart by the row's digest. Null keys are left out. An update without rows publishes nothing."""
    spark = updates.sparkSession
    now = version(spark, base)
    if now is None:
        raise FileNotFoundError(f"{base} has no published version")
    key, buckets = now.info["key"], now.info["buckets"]
    last = stored(last_by_id(updates.filter(F.col(key).isNotNull()), order_col, key), "upserts")
    # at most one row a bucket comes to the driver
    touched = [str(r[0]) for r in last.select(_bucket(key, buckets)).distinct().collect()]
    for attempt in range(attempts):
        if not touched:
            return now
        old = read_version(spark, base, now.number, touched)
        kept = old.join(last.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
        written = _write(kept.unionByName(last.select(*old.columns)), base, key, buckets)
        folders = {b: f for b, f in now.folders.items() if b not in touched} | written
        try:
            return publish(spark, base, folders, old.schema, now.number, now.info)
        except VersionConflict:
            for f in written.values():
                fs, own = file_system(spark, f"{base.rstrip('/')}/{f[0]}")
                fs.delete(own, True)
            if attempt == attempts - 1:
                raise
            now = version(spark, base)
    raise AssertionError("unreachable")


def lookup(spark: SparkSession, base: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of the store whose key is among ``ids``; only the buckets that those fall into are read."""
    now = version(spark, base)
    if now is None:
        raise FileNotFoundError(f"{base} has no published version")
    key, buckets = now.info["key"], now.info["buckets"]
    wanted = ids.select(F.col(id_col).alias(key)).filter(F.col(key).isNotNull()).distinct()
    parts = [str(r[0]) for r in wanted.select(_bucket(key, buckets)).distinct().collect()]
    return read_version(spark, base, now.number, parts).join(wanted, key, "left_semi")
