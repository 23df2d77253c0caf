"""Published-collection snapshot and status side table over the derived view.

- published snapshot: recipes with both a uuid and an image (fulfilled
  orders), mapped to the published schema, with the last tag dropped (so
  local and published tag counts differ) and the embedding / cluster label of
  the ``embeddings`` row whose ``vec_id`` equals the order key (left join:
  most recipes have none, which is what a coverage audit looks for).
- status table: (recipe_id, uploaded, bad) kept beside the dataset instead of
  rewriting it; bad = grade F recipes without an image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.mapping import PUBLISHED_COLUMNS, map_recipes
from larder.sources.recipe_view import recipe_table
from larder.sources.tables import read_table, select_columns


def published_snapshot(spark: SparkSession, sf_dir: str, recipes: DataFrame | None = None) -> DataFrame:
    r = recipes if recipes is not None else recipe_table(spark, sf_dir)
    mapped = map_recipes(r.filter(F.col("uuid").isNotNull() & F.col("image").isNotNull()))
    mapped = mapped.withColumn("tags", F.slice("tags", 1, F.greatest(F.size("tags") - 1, F.lit(0))))
    emb = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("_vid"),
        F.col("embedding").cast("array<double>").alias("_emb"), F.col("label").alias("_label"))
    j = mapped.drop("embedding", "cluster_id").join(emb, F.col("id") == F.col("_vid"), "left")
    j = j.withColumn("embedding", F.coalesce("_emb", F.array().cast("array<double>"))) \
         .withColumn("cluster_id", F.col("_label").cast("int"))
    return j.select(*PUBLISHED_COLUMNS)


def status_table(spark: SparkSession, sf_dir: str, recipes: DataFrame | None = None) -> DataFrame:
    r = recipes if recipes is not None else recipe_table(spark, sf_dir)
    return r.select(
        "recipe_id",
        (F.col("uuid").isNotNull() & F.col("image").isNotNull()).alias("uploaded"),
        F.coalesce((F.col("healthGrade") == "F") & F.col("image").isNull(), F.lit(False)).alias("bad"),
    )


def collection(spark: SparkSession, sf_dir: str, fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The published collection as a source: all or the named fields, all rows or the first ``limit`` by id."""
    docs = published_snapshot(spark, sf_dir)
    if limit is not None:
        if limit < 0:
            raise ValueError("limit must not be negative")
        docs = docs.orderBy("id").limit(limit)
    return select_columns(docs, fields)
