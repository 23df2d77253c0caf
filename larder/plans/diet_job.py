"""The whole diet job: load, skip tagged rows, limit, classify, write tags back, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.predicates import any_tag_in
from larder.operators.batch import get_batch
from larder.plans.classify import diet_summary, merge_tags, with_classification
from larder.plans.diet_rules import DIET_NAMES
from larder.sources.versions import replace_dataset


def diet_job(recipes: DataFrame, base: str, skip_tagged: bool = True, limit: int | None = None) -> tuple[DataFrame, str]:
    """(summary of the rows classified, path of the new dataset version below ``base``).

    Rows whose tags are null or already name a diet are skipped unless ``skip_tagged`` is off; ``limit`` takes the first rows
    by key. All other rows are written unchanged. Without a limit nothing is joined: the decision rides on the row.
    """
    todo = F.col("tags").isNotNull() & ~any_tag_in(F.col("tags"), list(DIET_NAMES)) if skip_tagged else F.lit(True)
    marked = recipes.withColumn("_todo", F.coalesce(todo, F.lit(False)))
    if limit is not None:
        chosen = get_batch(marked.filter("_todo").select("recipe_id"), limit).select(F.col("recipe_id").alias("_k"))
        marked = marked.join(chosen, F.col("recipe_id") == F.col("_k"), "left").withColumn(
            "_todo", F.col("_k").isNotNull()).drop("_k")
    classified = with_classification(marked, reasons=False)
    tags = F.when(F.col("_todo") & (F.size("new_tags") > 0), merge_tags(F.col("tags"), F.col("new_tags"))).otherwise(F.col("tags"))
    path = replace_dataset(classified.withColumn("tags", tags).drop("results", "new_tags", "_todo"), base)
    return diet_summary(classified.filter("_todo")), path
