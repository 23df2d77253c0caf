"""Tag tables: local vs published counts, diet distribution, dataset vs
snapshot verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.stats import tag_counts, top_k_per_group
from larder.plans.diet_rules import DIET_NAMES


def tag_counts_both(local: DataFrame, published: DataFrame) -> DataFrame:
    """Full outer merge of local and published tag counts (0 for missing),
    ordered by local count desc, or published count desc when local is 0."""
    lc = tag_counts(local).select("tag", F.col("count").alias("local"))
    pc = tag_counts(published, drop_empty=True).select("tag", F.col("count").alias("published"))
    j = lc.join(pc, "tag", "full_outer").select(
        "tag", F.coalesce("local", F.lit(0)).alias("local"), F.coalesce("published", F.lit(0)).alias("published"))
    return j.orderBy(F.when(F.col("local") > 0, -F.col("local")).otherwise(-F.col("published")), "tag")


def diet_tags(tags, names=DIET_NAMES):
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isin(list(names)))


def first_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """``recipe_id, title, diet``: of the rows (recipe_id, title, diets) of a task, the first ``k`` of each diet by id, null
    before all. At most ``k`` rows a diet and one batch are held."""
    held = pa.table({"recipe_id": pa.array([], pa.string()), "title": pa.array([], pa.string()), "diet": pa.array([], pa.string())})
    for batch in batches:
        diets = batch.column(2)
        at = pc.list_parent_indices(diets)
        new = pa.table({"recipe_id": batch.column(0).cast(pa.string()).take(at), "title": batch.column(1).cast(pa.string()).take(at),
                        "diet": pc.list_flatten(diets).cast(pa.string())})
        rows = pa.concat_tables([held, new])
        rows = rows.take(pc.sort_indices(rows["recipe_id"], null_placement="at_start"))
        kept = [rows.filter(pc.equal(rows["diet"], d)).slice(0, k) for d in pc.unique(rows["diet"])]
        held = pa.concat_tables(kept).combine_chunks() if kept else held
    yield from held.to_batches()


def diet_distribution(dataset: DataFrame, samples: int = 3) -> DataFrame:
    """Per diet: recipes carrying the tag, percent of all rows, first titles by id.

    Counts are a grouped aggregate (partial aggregation absorbs hot diets). For the sample titles each task keeps the first
    rows of every diet that it meets, in one pass and without sorting its rows; the few that are kept are ranked in a
    window. Zero-filled over all diets.
    """
    total = dataset.agg(F.count(F.lit(1))).scalar()
    listed = dataset.select("recipe_id", "title", F.array_distinct(diet_tags(F.col("tags"))).alias("diets")).filter(
        F.size("diets") > 0)
    counts = listed.select(F.explode("diets").alias("diet")).groupBy("diet").agg(F.count(F.lit(1)).alias("count"))
    x = listed.select(F.col("recipe_id").cast("string"), "title", "diets").mapInArrow(
        partial(first_rows, k=samples), "recipe_id string, title string, diet string")
    sample = (top_k_per_group(x, "diet", [F.col("recipe_id")], samples)
              .groupBy("diet").agg(F.array_sort(F.collect_list(F.struct("recipe_id", "title"))).alias("_s")))
    spark = dataset.sparkSession
    names = spark.createDataFrame([(i, n) for i, n in enumerate(DIET_NAMES)], "diet_order int, diet string")
    return (names.join(counts, "diet", "left").join(sample, "diet", "left")
            .select("diet_order", "diet", F.coalesce("count", F.lit(0)).alias("count"),
                    (F.coalesce("count", F.lit(0)) / total * 100).alias("pct"),
                    F.array_join(F.transform(F.coalesce("_s", F.array()), lambda s: s["title"]), " | ")
                    .alias("sample_titles")))


def verify_compare(dataset: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Diet tags of every tagged dataset row vs the snapshot document:
    match / mismatch, or missing when the id is not published."""
    d = dataset.filter(F.size(diet_tags(F.col("tags"))) > 0).select(
        "recipe_id", F.array_sort(diet_tags(F.col("tags"))).alias("local_tags"))
    s = snapshot.select(F.col("id").alias("recipe_id"), F.array_sort(diet_tags(F.col("tags"))).alias("published_tags"),
                        F.lit(True).alias("_present"))
    j = d.join(s, "recipe_id", "left")
    return j.select(
        "recipe_id", F.array_join("local_tags", ",").alias("local_tags"),
        F.array_join("published_tags", ",").alias("published_tags"),
        F.when(F.col("_present").isNull(), "missing").when(F.col("local_tags") == F.col("published_tags"), "match")
        .otherwise("mismatch").alias("status"))
