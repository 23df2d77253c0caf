"""A recipe catalogue derived from the driver's order tables.

The driver ships TPC-H style tables, not recipes. One recipe per order:
its ingredients are the order's line items (the part name mapped to a food
phrase), its nutrients one per line (part type -> nutrient name, line quantity
as grams), and the remaining recipe fields are derived from order columns.
Every row of ``orders`` becomes a recipe; orders without lines get NULL
ingredient/nutrient lists, which exercises the null-list semantics.

The same derivation is written in DuckDB SQL in ``oracles.py`` so
every query on this view has an independent oracle.

Scale: lines are grouped per order (bounded: an order holds a handful of
lines) and stored as lists with the order's columns, texts that follow from
them are made when they are read, the part dimension is joined after projecting it to three columns
and the planner chooses broadcast only when its size estimate is below
``spark.sql.autoBroadcastJoinThreshold``; the grouped lines are already
hash-partitioned by order key, so the join to ``orders`` re-uses that
partitioning instead of shuffling the aggregate again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import checkpoint_dir
from larder.sources.tables import new_version_path, read_table, table_path, version_of

# ---- FIXED VALUES: vocabulary of the derived catalogue ------------------------------------
# part-name noun -> food, part-name adjective -> modifier, part type -> nutrient name
NOUN_FOOD = {
    "anvil": "beef", "bolt": "milk", "gear": "flour", "gizmo": "eggs",
    "plate": "butter", "ring": "eggplant", "rod": "soy sauce", "widget": "rice",
}
ADJECTIVE_MODIFIER = {
    "blue": "almond", "cold": "coconut", "hot": "whole", "large": "sweet",
    "new": "brown", "old": "white", "red": "chopped", "small": "peanut",
}
TYPE_NUTRIENT = {
    "ECONOMY": "carbohydrateContent", "SMALL": "proteinContent", "MEDIUM": "fatContent",
    "LARGE": "sugarContent", "PROMO": "sodiumContent", "STANDARD": "saturatedFatContent",
}
# order priority -> meal tag and health grade ("4-NOT SPECIFIED" has no grade)
PRIORITY_MEAL = {
    "1-URGENT": "breakfast", "2-HIGH": "dessert", "3-MEDIUM": "salad",
    "4-NOT SPECIFIED": "soup", "5-LOW": "sandwich",
}
PRIORITY_GRADE = {"1-URGENT": "A", "2-HIGH": "B", "3-MEDIUM": "C", "5-LOW": "F"}
# order status -> second tag and cooking method ("P" has no method)
STATUS_TAG = {"F": "vegan", "O": "grilled", "P": "healthy"}
STATUS_METHOD = {"F": "Baking", "O": "Grilled"}
RECIPE_URL_PREFIX = "https://recipes.example.com/r/"
IMAGE_URL_PREFIX = "https://img.example.com/"
# ---- end of fixed values ------------------------------------------------------------------


def lit_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def ingredient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, l_partkey, l_quantity, food, nutrient_name) per line."""
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(
            F.coalesce(F.element_at(lit_map(ADJECTIVE_MODIFIER), F.substring_index("p_name", " ", 1)),
                       F.substring_index("p_name", " ", 1)),
            F.lit(" "),
            F.coalesce(F.element_at(lit_map(NOUN_FOOD), F.substring_index("p_name", " ", -1)),
                       F.substring_index("p_name", " ", -1)),
        ).alias("food"),
        F.coalesce(F.element_at(lit_map(TYPE_NUTRIENT), F.col("p_type")), F.col("p_type")).alias("nutrient_name"),
    )
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return lines.join(part, lines.l_partkey == part.p_partkey, "inner").drop("p_partkey")


def recipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: the order's own columns, and its lines in order as the lists ``ingredients``, ``nutrients`` and
    ``parts`` (all null without lines). This is what is stored; every other recipe column follows from it row by row."""
    # rows are placed by order before they are collected: a partial aggregate of lines in any order would only sort and copy
    per_order = ingredient_lines(spark, sf_dir).repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(
            "l_linenumber", "l_partkey", "l_quantity", "food", "nutrient_name"))).alias("_lines"))
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    j = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
    return j.select(
        *orders.columns,
        F.col("_lines.food").alias("ingredients"),
        F.transform("_lines", lambda x: F.struct(
            x["nutrient_name"].alias("name"),
            F.concat(x["l_quantity"].cast("string"), F.lit("g")).alias("quantity"),
        )).alias("nutrients"),
        F.transform("_lines", lambda x: F.struct(
            x["l_partkey"].alias("partkey"), x["l_quantity"].alias("quantity"))).alias("parts"),
    )


def recipe_columns(rows: DataFrame) -> DataFrame:
    """The recipe table (local-parquet schema of the catalogue) of ``recipe_rows``: a projection, of which a query computes
    only the columns that it reads."""
    ingredients = F.col("ingredients")
    has_lines, n_lines = ingredients.isNotNull(), F.size(ingredients)
    title = F.get(ingredients, 0)
    meal = F.element_at(lit_map(PRIORITY_MEAL), F.col("o_orderpriority"))
    cook = F.when(has_lines, n_lines) * F.lit(15)
    prep = F.dayofmonth("o_orderdate")
    rid = F.col("o_orderkey").cast("string")
    instructions = F.when(has_lines, F.concat(
        F.array(
            F.concat(F.lit("Combine "), F.array_join(ingredients, ", "), F.lit(".")),
            F.concat(F.lit("Cook for "), cook.cast("string"), F.lit(" minutes.")),
        ),
        F.when(F.col("o_orderstatus") != "O",
               F.array(F.concat(F.lit("Garnish with "), title, F.lit(" and serve."))))
        .otherwise(F.array().cast("array<string>")),
    ))
    return rows.select(
        rid.alias("recipe_id"),
        title.alias("title"),
        F.when(has_lines, F.concat(F.lit("A "), meal, F.lit(" of "), n_lines.cast("string"),
                                   F.lit(" ingredients"))).otherwise(F.lit("")).alias("description"),
        F.concat(F.lit(RECIPE_URL_PREFIX), rid).alias("url"),
        F.lit("recipes.example.com").alias("host"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(IMAGE_URL_PREFIX), rid, F.lit(".jpg"))).alias("image"),
        F.lit(None).cast("string").alias("author"),
        F.when(F.col("o_orderstatus") != "O", F.md5(rid)).alias("uuid"),
        instructions.alias("instructions"),
        ingredients.alias("ingredients"),
        F.transform("parts", lambda x, i: F.struct(
            x["quantity"].alias("quantity"), F.lit("g").alias("unit"), F.get(ingredients, i).alias("displayString"),
            F.struct(x["partkey"].cast("string").alias("ingredientID")).alias("foodCodes"),
        )).alias("procesedIngredients"),
        F.when(~has_lines, F.lit(None).cast("array<string>"))
        .when((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "P"),
              F.array().cast("array<string>"))
        .otherwise(F.array(meal, F.element_at(lit_map(STATUS_TAG), F.col("o_orderstatus")))).alias("tags"),
        F.element_at(lit_map(STATUS_METHOD), F.col("o_orderstatus")).alias("cookingMethod"),
        "nutrients",
        (F.col("o_totalprice") / F.lit(5000.0)).alias("healthScore"),
        F.element_at(lit_map(PRIORITY_GRADE), F.col("o_orderpriority")).alias("healthGrade"),
        F.when(has_lines, F.concat(n_lines.cast("string"), F.lit("-"),
                                   (n_lines + 2).cast("string"), F.lit(" servings"))).alias("numServings"),
        cook.cast("int").alias("cookTime"),
        prep.cast("int").alias("prepTime"),
        (cook + prep).cast("int").alias("totalTime"),
        ((F.col("o_custkey") % 50) / F.lit(10.0)).alias("ratings"),
        (F.col("o_custkey") % 1000).cast("int").alias("ratingsCount"),
        F.month("o_orderdate").cast("int").alias("cluster_id"),
    )


def recipe_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived recipe table, not stored."""
    return recipe_columns(recipe_rows(spark, sf_dir))


_TABLES: dict[tuple, str] = {}
_INPUTS = ("orders", "lineitem", "part")


def recipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived recipes written once as a parquet table, then scanned.

    In production the catalogue is a stored table; here its rows (see ``recipe_rows``) are derived from the driver tables the
    first time a session asks for them and written to the shared ``spark.checkpoint.dir`` folder (so a lost executor does
    not lose them). The number of files follows the data: it is that of the join's partitions as adaptive execution sizes
    them. The copy is derived anew when an input changes (size or time).
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"),
           *(version_of(spark, table_path(sf_dir, name)) for name in _INPUTS))
    path = _TABLES.get(key)
    if path is None:
        path = new_version_path(f"{checkpoint_dir(spark)}/recipes")
        recipe_rows(spark, sf_dir).write.parquet(path)
        _TABLES[key] = path
    return recipe_columns(spark.read.parquet(path))
