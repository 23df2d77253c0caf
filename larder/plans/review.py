"""Review exchange for uncertain classifications, as two table jobs.

The catalogue escalates undecided (recipe, diet) results to an external
reviewer in batches of 20 recipes. Here the exchange is tables: a request
job writes one row per batch (payload JSON + prompt text) and a reply job
reads (batch, reply JSON) rows back, maps each reply's index to the recipe id
and replaces the rule results it covers. The model call itself is outside
Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.ordering import fixed_size_groups
from larder.plans.diet_rules import DIETS, REVIEW_BATCH_SIZE, UNCERTAINTY_THRESHOLD

# Token prices of the ledger (USD per 1M tokens)
PRICE_IN_PER_M = 0.10
PRICE_OUT_PER_M = 0.40

REPLY_SCHEMA = ("struct<results:array<struct<id:bigint,"
                "classifications:map<string,struct<applies:string,confidence:double,reason:string>>>>>")
#: texts of ``applies`` that are read as false; any other value is true, as a number or text other than these
FALSE_TEXTS = ("false", "0", "0.0", "")


def undecided_diets() -> Column:
    """The diets of undecided results below the threshold, in rule order."""
    undecided = F.filter("results", lambda r: r["applies"].isNull() & (r["confidence"] < UNCERTAINTY_THRESHOLD))
    return F.transform(undecided, lambda r: r["diet"])


def uncertain_by_recipe(classified: DataFrame) -> DataFrame:
    """(recipe_id, title, ingredients, diets) for recipes with undecided diets.

    The results already lie in the recipe's row (see ``with_classification``): a filter on that array, no shuffle. A stored
    classification has the diets as a column ``undecided``, so that the results need not be read for them.
    """
    diets = F.col("undecided") if "undecided" in classified.columns else undecided_diets()
    return classified.select("recipe_id", "title", "ingredients", diets.alias("diets")).filter(F.size("diets") > 0)


def review_index(uncertain: DataFrame, batch_size: int = REVIEW_BATCH_SIZE) -> DataFrame:
    """(batch, idx, recipe_id, title, ingredients, diets): batches are consecutive runs of ``batch_size`` recipes in recipe_id
    order. Requests and replies must use one such table; it is stored when it is numbered."""
    return fixed_size_groups(uncertain, "recipe_id", batch_size).withColumnRenamed("group", "batch")


def review_requests(index: DataFrame) -> DataFrame:
    """One row per batch of the index: batch, n_recipes, diets (rule order), payload JSON, prompt text. A batch has a fixed
    number of rows, so ``collect_list`` per batch is bounded."""
    order = {d.name: i for i, d in enumerate(DIETS)}
    desc = {d.name: d.description for d in DIETS}
    item = F.struct(F.col("idx").cast("long").alias("id"), F.coalesce("title", F.lit("")).alias("title"),
                    F.coalesce("ingredients", F.array().cast("array<string>")).alias("ingredients"))
    batches = index.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_recipes"),
        F.array_sort(F.collect_list(item)).alias("_items"),
        F.array_distinct(F.flatten(F.collect_list("diets"))).alias("_diets"),
    )
    ordmap = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    descmap = F.create_map(*[x for k, v in desc.items() for x in (F.lit(k), F.lit(v))])
    diets_sorted = F.transform(
        F.array_sort(F.transform("_diets", lambda d: F.struct(F.element_at(ordmap, d).alias("o"), d.alias("d")))),
        lambda x: x["d"])
    payload = F.to_json("_items")
    diet_json = F.to_json(F.map_from_arrays(diets_sorted, F.transform(diets_sorted, lambda d: F.element_at(descmap, d))))
    prompt = F.concat(
        F.lit("Classify each recipe below for the listed diets, using only its ingredients.\nDiets: "), diet_json,
        F.lit("\nRecipes: "), payload,
        F.lit('\nAnswer with JSON only: {"results": [{"id": <recipe id>, "classifications": '
              '{"<diet>": {"applies": true|false, "confidence": 0.0-1.0, "reason": "..."}}}]}'))
    return batches.select("batch", "n_recipes", F.array_join(diets_sorted, ",").alias("diets"),
                          payload.alias("payload"), prompt.alias("prompt"))


def parse_replies(replies: DataFrame, index: DataFrame) -> DataFrame:
    """(recipe_id, diet, applies, confidence, method, reason) from reply JSON.

    ``index`` is one of ``review_index``, so a batch has a fixed number of rows and a reply carries its recipes as a list.
    Malformed replies parse to null and contribute nothing (the whole batch is skipped); unknown indices find no recipe and
    are dropped; confidence defaults to 0.7 and reason to "LLM classification". ``applies`` is read by truth value, but
    for the text "false". Where a reply answers a recipe's diet twice, the later answer holds.
    """
    # a reply meets the recipes of its batch as one row, before its answers become rows
    ids = index.groupBy("batch").agg(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), "recipe_id")).alias("ids"))
    parsed = replies.join(ids, "batch").select("ids", F.from_json("reply", REPLY_SCHEMA).alias("r"))
    items = parsed.select("ids", F.posexplode("r.results").alias("pos", "it"))
    known = items.select("pos", F.col("it.classifications").alias("answers"), F.explode(
        F.filter("ids", lambda x: x["idx"] == F.col("it.id"))).alias("known"))
    # one row an item goes through the shuffle, and what it answers is sorted once, where it arrives
    known = (known.select(F.col("known.recipe_id").alias("recipe_id"), "pos", "answers").repartition("recipe_id")
             .select("recipe_id", "pos", F.explode("answers").alias("diet", "c")))
    answer = F.struct(
        F.coalesce(~F.lower(F.trim(F.col("c.applies"))).isin(*FALSE_TEXTS), F.lit(False)).alias("applies"),
        F.coalesce(F.col("c.confidence"), F.lit(0.7)).alias("confidence"),
        F.lit("llm").alias("method"),
        F.coalesce(F.col("c.reason"), F.lit("LLM classification")).alias("reason"))
    return (known.groupBy("recipe_id", "diet").agg(F.max_by(answer, F.col("pos")).alias("v"))
            .select("recipe_id", "diet", "v.*"))


def apply_review(classified: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(recipe_id, diet, applies, confidence, method, reason): every returned (recipe, diet) replaced, uncertain or not; diets
    the recipe was not classified for are ignored. Answers are gathered per recipe (at most one a diet) and joined once
    per recipe; the result is exploded last."""
    answers = reviewed.groupBy("recipe_id").agg(F.collect_list(
        F.struct("diet", "applies", "confidence", "method", "reason")).alias("_a"))
    joined = classified.select("recipe_id", "results").join(answers, "recipe_id", "left")
    merged = F.transform("results", lambda r: F.coalesce(F.get(F.filter("_a", lambda a: a["diet"] == r["diet"]), 0), r))
    # outer: a plain generate would have the whole classification once more in an inferred filter
    return joined.select("recipe_id", F.inline_outer(merged))


def cost_ledger(usage: DataFrame) -> DataFrame:
    """(batch, input_tokens, output_tokens, cost) of a usage table (batch, input_tokens, output_tokens), plus a total row."""
    cost = F.col("input_tokens") / 1e6 * PRICE_IN_PER_M + F.col("output_tokens") / 1e6 * PRICE_OUT_PER_M
    per = usage.select(F.col("batch").cast("string").alias("batch"), "input_tokens", "output_tokens", cost.alias("cost"))
    total = usage.agg(F.lit("total").alias("batch"), F.sum("input_tokens").alias("input_tokens"),
                      F.sum("output_tokens").alias("output_tokens")).select("batch", "input_tokens", "output_tokens", cost.alias("cost"))
    return per.unionByName(total)
