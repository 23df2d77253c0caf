"""Dataset and collection statistics as DataFrame -> DataFrame functions.

Scalar metrics are one global aggregate (map-side partials, one tiny
shuffle) followed by an unpivot into long (metric, value) rows; groupings
are hash aggregates with partial aggregation, so a hot key costs one row per
map task in the shuffle. Top-k uses ``orderBy().limit()`` (TakeOrderedAndProject:
a per-partition heap, no global sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import py_strip

GRADES = ("A", "B", "C", "D", "F")
REQUIRED_FIELDS = ("title", "instructions", "ingredients", "tags", "image", "description",
                   "numServings", "cookTime", "prepTime")


def _stack(cols: list[tuple[str, Column]], key: str = "metric", value: str = "value") -> Column:
    """Unpivot (name, column) pairs into rows via inline(array(struct))."""
    return F.inline(F.array(*[F.struct(F.lit(n).alias(key), c.alias(value)) for n, c in cols]))


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_recipes"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of ``column``; null is a group; ascending, null first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col(column).asc_nulls_first())


def distinct_values_incl_null(df: DataFrame, list_column: str) -> DataFrame:
    """Distinct elements over a list column; null (from null/empty lists or null
    elements) counts as one value."""
    x = df.select(F.explode_outer(list_column).alias("x"))
    return x.agg((F.countDistinct("x") + F.max(F.when(F.col("x").isNull(), 1).otherwise(0)))
                 .alias("unique_ingredients_count"))


def grade_distribution(df: DataFrame, column: str = "healthGrade") -> DataFrame:
    """Grades A-F with zero fill and percent of all rows (unrounded)."""
    wide = df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count_if(F.col(column) == g).alias(g) for g in GRADES])
    return wide.select("total", F.inline(F.array(*[
        F.struct(F.lit(g).alias("grade"), F.col(g).alias("count")) for g in GRADES]))).select(
        "grade", "count",
        F.when(F.col("total") > 0, F.col("count") / F.col("total") * 100).otherwise(F.lit(0.0)).alias("pct"))


def tag_counts(df: DataFrame, tags: str = "tags", drop_empty: bool = False) -> DataFrame:
    """Recipes per tag (null elements dropped; optionally ""), descending, tie by tag."""
    t = df.select(F.explode(tags).alias("tag")).filter(F.col("tag").isNotNull())
    if drop_empty:
        t = t.filter(F.col("tag") != "")
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "tag")


def tag_distribution(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Tag counts keeping null/"" elements, with percent of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    counts = df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("tag", "count", (F.col("count") / total * 100).alias("pct"))


def ingredient_top(df: DataFrame, k: int = 100, structured: str = "ingredients",
                   strings: str = "ingredientStrings") -> DataFrame:
    """Ingredient counts over structured names plus every ingredient string.

    Structured: name, else displayString; falsy values dropped *before*
    lower+strip. Strings: every element (even ""), lower+strip. An ingredient
    in both lists is counted twice. Top ``k`` by count, tie by name.
    """
    names = F.transform(structured, lambda i: F.coalesce(F.nullif(i["displayString"], F.lit("")), F.lit("")))
    one = F.filter(names, lambda n: n != "")
    both = F.concat(F.coalesce(one, F.array().cast("array<string>")),
                    F.coalesce(F.filter(F.col(strings), lambda s: s.isNotNull()), F.array().cast("array<string>")))
    x = df.select(F.explode(both).alias("raw")).select(py_strip(F.lower("raw")).alias("ingredient"))
    return (x.groupBy("ingredient").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "ingredient").limit(k))


def nutrient_coverage(df: DataFrame, nutrients: str = "nutrients") -> DataFrame:
    wide = df.agg(F.count(F.lit(1)).alias("total_recipes"),
                  F.count_if(F.coalesce(F.size(nutrients) > 0, F.lit(False))).alias("recipes_with_nutrients"))
    return wide.withColumn(
        "coverage_percent",
        F.when(F.col("total_recipes") > 0, F.col("recipes_with_nutrients") / F.col("total_recipes") * 100)
        .otherwise(F.lit(0.0)))


def nutrient_field_counts(df: DataFrame, nutrients: str = "nutrients") -> DataFrame:
    """Nutrient names over non-empty lists (missing name -> "unknown"), descending."""
    x = df.select(F.explode(nutrients).alias("n")).select(F.coalesce(F.col("n.name"), F.lit("unknown")).alias("field"))
    return x.groupBy("field").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "field")


def _missing(df: DataFrame, name: str) -> Column:
    """null, "" or [] is missing; 0 and white space are not."""
    dt = df.schema[name].dataType.typeName()
    c = F.col(name)
    if dt == "string":
        return c.isNull() | (c == "")
    if dt in ("array", "map"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def missing_fields(df: DataFrame, fields=REQUIRED_FIELDS) -> DataFrame:
    """Per required field: rows where it is missing; all fields reported, even at 0."""
    wide = df.agg(*[F.count_if(_missing(df, f)).alias(f) for f in fields])
    return wide.select(_stack([(f, F.col(f)) for f in fields], "field", "missing")).orderBy(F.desc("missing"), "field")


def coverage_audit(df: DataFrame) -> DataFrame:
    """Collection coverage: counts and percent of all rows per metric."""
    emb_valid = F.coalesce(F.size("embedding") > 0, F.lit(False))
    wide = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("channel") == "discover").alias("channel_discover"),
        F.count_if(F.col("embedding").isNotNull()).alias("embedding_present"),
        F.count_if(emb_valid).alias("embedding_valid"),
        F.count_if(F.col("cluster_id").isNotNull()).alias("cluster_present"),
        F.count_if(F.col("tags").isNotNull()).alias("tags_present"),
        F.count_if(F.coalesce(F.size("tags") > 0, F.lit(False))).alias("tags_non_empty"),
    )
    metrics = ["total", "channel_discover", "embedding_present", "embedding_valid", "cluster_present",
               "tags_present", "tags_non_empty"]
    return wide.select(F.col("total").alias("_t"), _stack([(m, F.col(m)) for m in metrics], "metric", "count")).select(
        "metric", "count", F.when(F.col("_t") > 0, F.col("count") / F.col("_t") * 100).alias("pct"))


def coverage_verdict(df: DataFrame) -> DataFrame:
    """none (no valid embedding) / partial (share < 0.8) / viable."""
    wide = df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.coalesce(F.size("embedding") > 0, F.lit(False))).alias("embedding_valid"))
    share = F.col("embedding_valid") / F.col("total")
    return wide.select("total", "embedding_valid", share.alias("share"),
                       F.when(F.col("embedding_valid") == 0, "none").when(share < 0.8, "partial")
                       .otherwise("viable").alias("verdict"))


def tag_len_hist(df: DataFrame, tags: str = "tags") -> DataFrame:
    return (df.filter(F.size(tags) > 0).groupBy(F.size(tags).alias("n_tags"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("n_tags"))


def embedding_dims(df: DataFrame) -> DataFrame:
    """Valid embeddings per dimension, percent of all rows, descending."""
    total = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    dims = (df.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim"))
            .agg(F.count(F.lit(1)).alias("count")))
    return dims.select("dim", "count", (F.col("count") / total * 100).alias("pct")).orderBy(F.desc("count"), "dim")


def missing_embedding_sample(df: DataFrame, n: int = 5, id_col: str = "id") -> DataFrame:
    """First ``n`` ids (by id) without a valid embedding, with the reason."""
    bad = df.filter(~F.coalesce(F.size("embedding") > 0, F.lit(False))).select(
        id_col, F.when(F.col("embedding").isNull(), "missing field").otherwise("invalid: empty").alias("reason"))
    return bad.orderBy(id_col).limit(n)


def avg_score_by(df: DataFrame, group: str = "cluster_id", score: str = "healthScore") -> DataFrame:
    return (df.groupBy(group).agg(F.count(F.lit(1)).alias("count"), F.avg(score).alias("avg_score"))
            .orderBy(F.desc("avg_score"), F.col(group).asc_nulls_first()))


def top_by(df: DataFrame, score: str, k: int = 10, tie: str = "recipe_id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), tie).limit(k)


def statistics(df: DataFrame) -> DataFrame:
    """(section, name, count): tag counts, missing fields and grades of a dataset in one long table."""
    def section(label: str, part: DataFrame, name: str, count: str) -> DataFrame:
        return part.select(F.lit(label).alias("section"), F.col(name).cast("string").alias("name"),
                           F.col(count).cast("long").alias("count"))
    return (section("tags", tag_counts(df, drop_empty=True), "tag", "count")
            .unionByName(section("missing", missing_fields(df), "field", "missing"))
            .unionByName(section("grades", grade_distribution(df), "grade", "count")))


def report(df: DataFrame, top: int = 100, fields=REQUIRED_FIELDS) -> DataFrame:
    """(section, name, value): the whole statistics export of one dataset in one scan.

    Sections are total, tags (not empty), the ``top`` ingredients (as in ``ingredient_top``), nutrients (recipes with any, and
    their percentage to two places), nutrient_fields and missing_fields (all of them, at 0 too). Every row is turned to its
    (section, name) pairs, which are counted together with map-side partials, so a hot name is one row a task.
    """
    def named(section: str, names: Column) -> Column:
        return F.transform(F.coalesce(names, F.array().cast("array<string>")),
                           lambda n: F.struct(F.lit(section).alias("section"), n.alias("name")))

    def one(section: str, name: str, when: Column | None = None) -> Column:
        return named(section, F.array(F.lit(name)) if when is None else F.when(when, F.array(F.lit(name))))

    structured = F.filter(F.transform("ingredients", lambda i: F.nullif(i["displayString"], F.lit(""))), lambda n: n.isNotNull())
    strings = F.filter("ingredientStrings", lambda s: s.isNotNull())
    clean = lambda names: F.transform(names, lambda n: py_strip(F.lower(n)))
    pairs = F.concat(
        one("total", "recipes"), named("tags", F.filter("tags", lambda t: t.isNotNull() & (t != ""))),
        named("ingredients", clean(structured)), named("ingredients", clean(strings)),
        one("nutrients", "recipes_with_nutrients", F.coalesce(F.size("nutrients") > 0, F.lit(False))),
        named("nutrient_fields", F.transform("nutrients", lambda n: F.coalesce(n["name"], F.lit("unknown")))),
        *(one("missing_fields", f, _missing(df, f)) for f in fields))
    zero = [("total", "recipes"), ("nutrients", "recipes_with_nutrients"), *(("missing_fields", f) for f in fields)]
    zeros = df.sparkSession.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.lit(0).cast("long").alias("n")) for s, n in zero))))
    counted = (df.select(F.inline(pairs)).withColumn("n", F.lit(1).cast("long")).unionByName(zeros)
               .groupBy("section", "name").agg(F.sum("n").alias("n")))
    small = counted.filter(F.col("section") != "ingredients")
    best = top_k_per_group(counted.filter(F.col("section") == "ingredients"), "section", [F.desc("n"), F.col("name")], top)
    share = small.filter(F.col("section").isin("total", "nutrients")).agg(
        F.max(F.when(F.col("section") == "nutrients", F.col("n"))).alias("with"),
        F.max(F.when(F.col("section") == "total", F.col("n"))).alias("all")).select(
        F.lit("nutrients").alias("section"), F.lit("coverage_percent").alias("name"),
        F.when(F.col("all") > 0, F.round(F.col("with") / F.col("all") * 100, 2)).otherwise(F.lit(0.0)).alias("value"))
    counts = small.unionByName(best).select("section", "name", F.col("n").cast("double").alias("value"))
    return counts.unionByName(share)


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group by ``order``.

    ``row_number() <= k`` is planned with a partial per-partition group limit
    before the shuffle (WindowGroupLimit), so a hot group ships at most k rows
    per map task instead of all of its rows.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
