"""Publishing: exclusion joins, keyed upserts, tag patches, status flags and
the whole de-duplicating publish job.

A published collection is a table keyed by ``id`` (a snapshot). Writes never
replace the path being read: each job writes a new version (see
``sources.versions.replace_dataset``). Id-set operations are semi/anti joins:
the planner broadcasts the id side only when its size estimate is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides on
the key; AQE splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import empty_array
from larder.operators.mapping import map_recipes, validate
from larder.sources.tables import stored
from larder.sources.versions import replace_dataset


def exclude_ids(df: DataFrame, ids: DataFrame, key: str = "recipe_id", ids_key: str = "id") -> DataFrame:
    """Rows of ``df`` whose key is not among ``ids`` (null keys stay: anti join)."""
    return df.join(ids.select(F.col(ids_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def matching_ids(df: DataFrame, ids: DataFrame, key: str = "recipe_id", ids_key: str = "id") -> DataFrame:
    """Keys of ``df`` present among ``ids`` (semi join, keys only)."""
    return df.join(ids.select(F.col(ids_key).alias("_k")).distinct(), F.col(key) == F.col("_k"),
                   "left_semi").select(key)


def flagged_ids(status: DataFrame, flag: str) -> DataFrame:
    """Ids whose flag is true (null flags dropped)."""
    return status.filter(F.col(flag)).select("recipe_id")


def status_defaults(df: DataFrame) -> DataFrame:
    """Add ``uploaded`` / ``bad`` = false when the columns are missing."""
    for c in ("uploaded", "bad"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(False))
    return df


def mark_flag(status: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """flag := true for listed ids, unchanged elsewhere (empty id list: no-op)."""
    hits = ids.select(F.col("recipe_id").alias("_k")).distinct().withColumn("_hit", F.lit(True))
    j = status.join(hits, status.recipe_id == hits._k, "left")
    return j.select(*[F.when(F.col("_hit"), F.lit(True)).otherwise(F.col(flag)).alias(flag) if c == flag
                      else F.col(c) for c in status.columns])


def last_by_id(updates: DataFrame, order_col: str | None = None, key: str = "id") -> DataFrame:
    """One row per ``key``: the last by ``order_col``. A table has no arrival order of its own, so without one, and among
    rows that arrived together, the row with the largest digest stands, the same in every run."""
    # the digest is a column before the shuffle, so that only columns that are read later go through it; rows that were joined
    # before may bring theirs along
    w = Window.partitionBy(key).orderBy(*([F.desc_nulls_last(order_col)] if order_col else []), F.desc("_digest"))
    if "_digest" not in updates.columns:
        updates = updates.withColumn("_digest", F.xxhash64(*updates.columns))
    out = (updates.withColumn("_rn", F.row_number().over(w))
           .filter("_rn = 1").drop("_rn", "_digest"))
    return out.drop(order_col) if order_col else out


def upsert_by_id(target: DataFrame, updates: DataFrame, order_col: str | None = None) -> DataFrame:
    """Full-row replace by ``id``: target rows without an update, plus one update per id (see ``last_by_id``)."""
    updates = last_by_id(updates, order_col)
    kept = target.join(updates.select(F.col("id").alias("_k")), target.id == F.col("_k"), "left_anti")
    return kept.unionByName(updates.select(*target.columns))


def patch_tags(target: DataFrame, new_tags: DataFrame) -> DataFrame:
    """Array-union patch: append new tags missing from a document's tags.

    ``new_tags``: (recipe_id, new_tags). Ids absent in the target are not
    created (see ``patch_skipped``). Existing duplicates are kept, unlike
    ``array_union``: ``concat(old, array_except(new, old))``.
    """
    upd = new_tags.select(F.col("recipe_id").alias("_k"), F.col("new_tags").alias("_new"))
    j = target.join(upd, target.id == upd._k, "left")
    old = F.coalesce(F.col("tags"), empty_array())
    merged = F.when(F.col("_new").isNotNull(), F.concat(old, F.array_except(F.col("_new"), old))).otherwise(F.col("tags"))
    return j.select(*[merged.alias("tags") if c == "tags" else F.col(c) for c in target.columns])


def patch_skipped(target: DataFrame, new_tags: DataFrame) -> DataFrame:
    """Update ids that are not in the target (skipped and counted)."""
    return new_tags.join(target.select(F.col("id").alias("recipe_id")), "recipe_id", "left_anti")


def publish_rows(selected: DataFrame, published: DataFrame, status: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every selected recipe, mapped, with ``outcome`` (dropped_bad / skipped / failed / published) and ``error``.

    Rows are mapped and validated where they are read, and two narrow id tables are left-joined: the joins carry only the
    columns that the caller keeps. One ``when`` chain decides: drop bad -> skip already published -> validate. A row that
    fails, in whatever way, carries its error and never stops the job.
    """
    bad = flagged_ids(status, "bad").select(F.col("recipe_id").alias("_b")).distinct().withColumn("_bad", F.lit(True))
    known = published.select(F.col("id").alias("_p")).distinct().withColumn("_known", F.lit(True))
    checked = validate(map_recipes(selected, keep=("recipe_id", *keep)))
    checked = (checked.join(bad, F.col("recipe_id") == F.col("_b"), "left")
               .join(known, F.col("recipe_id") == F.col("_p"), "left").drop("_b", "_p"))
    outcome = (F.when(F.col("_bad"), "dropped_bad").when(F.col("_known"), "skipped")
               .when(F.col("valid"), "published").otherwise("failed"))
    return (checked.withColumn("outcome", outcome)
            .withColumn("error", F.when(F.col("outcome") == "failed", F.col("error")).otherwise(""))
            .withColumn("recipe_id", F.when(F.col("outcome").isin("published", "failed"), F.col("id"))
                        .otherwise(F.col("recipe_id")))
            .drop("_bad", "_known", "valid"))


def publish_outcomes(selected: DataFrame, published: DataFrame, status: DataFrame) -> DataFrame:
    """(recipe_id, outcome, error) per selected recipe."""
    return publish_rows(selected, published, status).select("recipe_id", "outcome", "error")


def publishable(selected: DataFrame, published: DataFrame, status: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The mapped rows whose outcome is ``published`` (see ``publish_rows``); rows that fail are dropped before the join, bad
    and known ones in it. Without ids of their own the rows join on ``id``, by which an upsert then finds them placed."""
    key = "recipe_id" if "id" in selected.columns else "id"
    rows = validate(map_recipes(selected, keep=("recipe_id", *keep))).filter("valid")
    rows = rows.withColumn("_digest", F.xxhash64(*published.columns, *keep))
    out = flagged_ids(status, "bad").unionByName(published.select(F.col("id").alias("recipe_id")))
    return exclude_ids(rows, out, key, "recipe_id").select(*published.columns, *keep, "_digest")


def publish_summary(outcomes: DataFrame) -> DataFrame:
    """selected, valid, published, failed, skipped (one row)."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if(o.isin("published", "failed")).alias("checked"),
        F.count_if(o == "published").alias("valid"),
        F.count_if(o == "published").alias("published"),
        F.count_if(o == "failed").alias("failed"),
        F.count_if(o == "skipped").alias("skipped"),
        F.count_if(o == "dropped_bad").alias("dropped_bad"),
    )


def publish_job(selected: DataFrame, published: DataFrame, status: DataFrame, dry_run: bool = True,
                order_col: str | None = None):
    """Returns (outcomes, new_snapshot, new_status). ``dry_run`` stops before the upsert and flags. The outcomes are stored
    once; of several rows with one id the last by ``order_col`` is published."""
    outcomes = publish_outcomes(selected, published, status)
    if dry_run:
        return outcomes, published, status
    outcomes = stored(outcomes, "publish-outcomes")
    order = ("_order",) if order_col else ()
    if order_col:
        selected = selected.withColumn("_order", F.col(order_col))
    snapshot = upsert_by_id(published, publishable(selected, published, status, order), "_order" if order_col else None)
    new_status = mark_flag(status, outcomes.filter(F.col("outcome") == "published").select("recipe_id"), "uploaded")
    return outcomes, snapshot, new_status


def write_publish(selected: DataFrame, published: DataFrame, status: DataFrame, base: str,
                  order_col: str | None = None) -> dict[str, str]:
    """The whole job: writes outcomes, snapshot and status as new versions below ``base`` and returns their paths. Readers
    switch to the returned paths; the tables that were read stay as they are."""
    names = ("outcomes", "snapshot", "status")
    frames = publish_job(selected, published, status, dry_run=False, order_col=order_col)
    return {name: replace_dataset(frame, f"{base}/{name}") for name, frame in zip(names, frames)}
