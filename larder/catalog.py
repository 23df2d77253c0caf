"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or the recipe view Spark derives from
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.plans import classify as C
from larder.sources.recipe_view import PRIORITY_MEAL, recipe_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_classification(recipe_table(spark, sf_dir).select("recipe_id", "ingredients", "nutrients"), reasons=False)


@query("classify_rules")
def q_classify_rules(spark, sf_dir):
    return C.classify_rules(recipe_table(spark, sf_dir))


@query("diet_summary")
def q_diet_summary(spark, sf_dir):
    return C.diet_summary(classified(spark, sf_dir))


# ---- shared inputs -------------------------------------------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from larder.functions import predicates as P  # noqa: E402
from larder.operators import batch as B  # noqa: E402
from larder.operators import keyed_store as KS  # noqa: E402
from larder.operators import mapping as M  # noqa: E402
from larder.operators import publish as PB  # noqa: E402
from larder.operators import stats as S  # noqa: E402
from larder.sources import document_sink as DS  # noqa: E402
from larder.sources import tables as TB  # noqa: E402
from larder.sources import versions as VS  # noqa: E402
from larder.sources.snapshot import collection, published_snapshot, status_table  # noqa: E402


def _recipes(spark, sf_dir):
    return recipe_table(spark, sf_dir)


def _flat(df, *cols):
    """Arrays rendered as '|'-joined text so results compare as scalars."""
    return df.select(*[F.array_join(F.col(c), "|").alias(c) if c in cols else F.col(c) for c in df.columns])


# ---- scans and projections (S1, P1, P3, P4, L1, L3) ---------------------------------------

@query("scan_projection")
def q_scan_projection(spark, sf_dir):
    return TB.select_columns(_recipes(spark, sf_dir), ["recipe_id", "title", "healthScore"])


@query("status_defaults")
def q_status_defaults(spark, sf_dir):
    return PB.status_defaults(_recipes(spark, sf_dir).select("recipe_id", "title"))


@query("preview")
def q_preview(spark, sf_dir):
    r = _recipes(spark, sf_dir)
    from larder.functions.text import fmt_1dp
    return r.select(
        "recipe_id",
        F.substring(F.coalesce("title", F.lit("")), 1, 50).alias("title"),
        F.coalesce("healthGrade", F.lit("-")).alias("grade"),
        F.when(F.coalesce(F.col("cookTime"), F.lit(0)) != 0, F.concat(F.col("cookTime").cast("string"), F.lit(" min")))
        .otherwise(F.lit("-")).alias("cook"),
        F.when(F.coalesce(F.col("ratings"), F.lit(0.0)) != 0, fmt_1dp(F.col("ratings"))).otherwise(F.lit("-")).alias("rating"),
    )


@query("batch_head")
def q_batch_head(spark, sf_dir):
    return B.get_batch(_recipes(spark, sf_dir), 10, query={"healthGrade": "A"}).select("recipe_id", "title", "healthGrade")


# ---- predicates (F1-F17) -------------------------------------------------------------------

def _pred(filters=(), query=None, cols=("recipe_id", "title", "healthGrade", "healthScore")):
    def run(spark, sf_dir):
        return P.apply_filters(_recipes(spark, sf_dir), *filters, query=query).select(*cols)
    return run


QUERIES["filter_eq"] = _pred([P.Col.health_grade.eq("A")])
QUERIES["filter_ne"] = _pred([P.Col.health_grade.ne("A")])
QUERIES["filter_lt"] = _pred([P.Col.health_score.lt(30)])
QUERIES["filter_lte"] = _pred(query={"healthScore__le": 30})
QUERIES["filter_gt"] = _pred(query={"healthScore__gt": 70})
QUERIES["filter_gte"] = _pred(query={"healthScore": {"__gte": 70}})
QUERIES["filter_in"] = _pred([P.Col.cluster_id.is_in([1, 2, 3])], cols=("recipe_id", "cluster_id"))
QUERIES["filter_contains_ci"] = _pred([P.Col.title.contains("ALMOND (milk|flour)")])
QUERIES["filter_contains_cs"] = _pred(query={"title__contains": "^white"})
QUERIES["list_any_contains"] = _pred([P.Col.ingredients.list_any_contains("soy sauce$")])
QUERIES["filter_conjunction"] = _pred(
    P.cli_filters({"grade": "b", "max_cook_time": "60", "min_rating": "2.5", "ingredient": "rice"}),
    cols=("recipe_id", "title", "healthGrade", "cookTime", "ratings"))


@query("filter_join_combined")
def q_filter_join_combined(spark, sf_dir):
    r = _recipes(spark, sf_dir).select("recipe_id", "title", "healthScore", "cluster_id")
    return P.join_filtered(r, P.Col.title.contains("rice"), query={"healthScore__gt": 50})


@query("status_ids")
def q_status_ids(spark, sf_dir):
    return PB.flagged_ids(status_table(spark, sf_dir), "bad")


@query("any_diet_tag")
def q_any_diet_tag(spark, sf_dir):
    from larder.plans.diet_rules import DIET_NAMES
    return _recipes(spark, sf_dir).filter(P.any_tag_in(F.col("tags"), list(DIET_NAMES))).select("recipe_id")


@query("skip_tagged")
def q_skip_tagged(spark, sf_dir):
    from larder.plans.diet_rules import DIET_NAMES
    return P.skip_tagged(_recipes(spark, sf_dir), list(DIET_NAMES)).select("recipe_id")


# ---- statistics (G1-G17, G22) --------------------------------------------------------------

QUERIES["total_recipes"] = lambda spark, sf_dir: S.total_rows(_recipes(spark, sf_dir))
QUERIES["count_by_cluster"] = lambda spark, sf_dir: S.count_by(_recipes(spark, sf_dir), "cluster_id")
QUERIES["count_by_grade"] = lambda spark, sf_dir: S.count_by(_recipes(spark, sf_dir), "healthGrade")
QUERIES["distinct_ingredients"] = lambda spark, sf_dir: S.distinct_values_incl_null(_recipes(spark, sf_dir), "ingredients")
QUERIES["grade_distribution"] = lambda spark, sf_dir: S.grade_distribution(_recipes(spark, sf_dir))
QUERIES["tag_counts"] = lambda spark, sf_dir: S.tag_counts(_recipes(spark, sf_dir))
QUERIES["tag_counts_published"] = lambda spark, sf_dir: S.tag_counts(published_snapshot(spark, sf_dir), drop_empty=True)
QUERIES["tag_distribution"] = lambda spark, sf_dir: S.tag_distribution(published_snapshot(spark, sf_dir))
QUERIES["ingredient_top100"] = lambda spark, sf_dir: S.ingredient_top(published_snapshot(spark, sf_dir), 100)
QUERIES["nutrient_coverage"] = lambda spark, sf_dir: S.nutrient_coverage(published_snapshot(spark, sf_dir))
QUERIES["nutrient_field_counts"] = lambda spark, sf_dir: S.nutrient_field_counts(published_snapshot(spark, sf_dir))
QUERIES["missing_fields"] = lambda spark, sf_dir: S.missing_fields(published_snapshot(spark, sf_dir))
QUERIES["missing_fields_local"] = lambda spark, sf_dir: S.missing_fields(_recipes(spark, sf_dir))
QUERIES["coverage_audit"] = lambda spark, sf_dir: S.coverage_audit(published_snapshot(spark, sf_dir))
QUERIES["tag_len_hist"] = lambda spark, sf_dir: S.tag_len_hist(published_snapshot(spark, sf_dir))
QUERIES["embedding_dims"] = lambda spark, sf_dir: S.embedding_dims(published_snapshot(spark, sf_dir))
QUERIES["coverage_verdict"] = lambda spark, sf_dir: S.coverage_verdict(published_snapshot(spark, sf_dir))
QUERIES["missing_embedding_sample"] = lambda spark, sf_dir: S.missing_embedding_sample(published_snapshot(spark, sf_dir))
QUERIES["avg_score_by_cluster"] = lambda spark, sf_dir: S.avg_score_by(_recipes(spark, sf_dir))
QUERIES["top_score"] = lambda spark, sf_dir: S.top_by(_recipes(spark, sf_dir), "healthScore", 10).select(
    "recipe_id", "title", "healthScore")


# ---- mapping and validation (V1-V9) --------------------------------------------------------

@query("map_recipes")
def q_map_recipes(spark, sf_dir):
    m = M.map_recipes(_recipes(spark, sf_dir))
    return _flat(m.select("id", "title", "channel", "numServings", "cookTime", "tags", "instructions"),
                 "tags", "instructions")


@query("map_ingredients")
def q_map_ingredients(spark, sf_dir):
    m = M.map_recipes(_recipes(spark, sf_dir))
    return m.select("id", F.array_join("ingredientStrings", "|").alias("ingredientStrings"),
                    F.size("ingredients").alias("n_structured"),
                    F.array_join(F.transform("ingredients", lambda i: i["foodCodes"]["ingredientID"]), "|")
                    .alias("ingredient_ids"))


@query("normalize_nutrients")
def q_normalize_nutrients(spark, sf_dir):
    m = M.map_recipes(_recipes(spark, sf_dir))
    return m.select("id", F.size("nutrients").alias("n"),
                    F.array_join(F.transform("nutrients", lambda n: F.concat(n["name"], F.lit("="), n["quantity"])), "|")
                    .alias("nutrients"))


@query("normalize_servings")
def q_normalize_servings(spark, sf_dir):
    r = _recipes(spark, sf_dir)
    return r.select("recipe_id", "numServings", M.normalize_servings(r).alias("servings"))


@query("validate_recipes")
def q_validate_recipes(spark, sf_dir):
    v = M.validate(M.map_recipes(_recipes(spark, sf_dir)))
    return v.select("id", "valid", "error")


@query("validation_failures")
def q_validation_failures(spark, sf_dir):
    v = M.validate(M.map_recipes(_recipes(spark, sf_dir)))
    return v.filter(~F.col("valid")).groupBy("error").agg(F.count(F.lit(1)).alias("count"))


# ---- publish (J2-J5, S5, S9, S10, V10, G20) ------------------------------------------------

@query("snapshot_ids")
def q_snapshot_ids(spark, sf_dir):
    return collection(spark, sf_dir, ["id"])


@query("collection_fields")
def q_collection_fields(spark, sf_dir):
    return collection(spark, sf_dir, ["id", "title", "healthGrade"], limit=100)


@query("exclude_uploaded")
def q_exclude_uploaded(spark, sf_dir):
    return PB.exclude_ids(_recipes(spark, sf_dir).select("recipe_id", "title"), published_snapshot(spark, sf_dir))


@query("skipped_ids")
def q_skipped_ids(spark, sf_dir):
    return PB.matching_ids(_recipes(spark, sf_dir).select("recipe_id"), published_snapshot(spark, sf_dir))


@query("exclude_bad")
def q_exclude_bad(spark, sf_dir):
    r = _recipes(spark, sf_dir).select("recipe_id")
    return PB.exclude_ids(r, PB.flagged_ids(status_table(spark, sf_dir), "bad"), "recipe_id", "recipe_id")


@query("mark_flag")
def q_mark_flag(spark, sf_dir):
    st = status_table(spark, sf_dir)
    ids = P.apply_filters(_recipes(spark, sf_dir), P.Col.health_grade.eq("C")).select("recipe_id")
    return PB.mark_flag(st, ids, "bad")


def _publish_inputs(spark, sf_dir):
    r = _recipes(spark, sf_dir)
    return r, published_snapshot(spark, sf_dir, r), status_table(spark, sf_dir, r)


@query("publish_outcomes")
def q_publish_outcomes(spark, sf_dir):
    return PB.publish_outcomes(*_publish_inputs(spark, sf_dir))


@query("publish_summary")
def q_publish_summary(spark, sf_dir):
    return PB.publish_summary(PB.publish_outcomes(*_publish_inputs(spark, sf_dir)))


@query("upsert_by_id")
def q_upsert_by_id(spark, sf_dir):
    selected, published, status = _publish_inputs(spark, sf_dir)
    _, snapshot, _ = PB.publish_job(selected, published, status, dry_run=False)
    return _flat(snapshot.select("id", "title", "tags", "channel"), "tags")


@query("publish_status")
def q_publish_status(spark, sf_dir):
    selected, published, status = _publish_inputs(spark, sf_dir)
    _, _, new_status = PB.publish_job(selected, published, status, dry_run=False)
    return new_status


@query("publish_job")
def q_publish_job(spark, sf_dir):
    """The whole job, written as new versions and read back: every published document with its status flag."""
    paths = PB.write_publish(*_publish_inputs(spark, sf_dir), base=_scratch(spark, "publish"))
    flags = spark.read.parquet(paths["status"]).select(F.col("recipe_id").alias("id"), "uploaded")
    docs = spark.read.parquet(paths["snapshot"]).select("id", "title", "tags", "channel")
    return _flat(docs.join(flags, "id", "left"), "tags")


@query("type_check")
def q_type_check(spark, sf_dir):
    """Lax types over the recipe table with its numbers turned to text, wide integers and fractions."""
    r = _recipes(spark, sf_dir)
    cook, c = F.col("cookTime").cast("string"), F.col("cluster_id")
    raw = r.select(
        "recipe_id",
        F.when(c % 4 == 0, F.concat(cook, F.lit(" min"))).when(c % 4 == 1, F.concat(cook, F.lit(".0")))
        .when(c % 4 == 2, F.concat(F.lit(" "), cook, F.lit(" "))).otherwise(cook).alias("cookTime"),
        (F.col("prepTime").cast("long") * F.when(c % 3 == 0, F.lit(1000000000)).otherwise(F.lit(1))).alias("prepTime"),
        (F.col("totalTime") + F.when(c % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("totalTime"),
        F.when(F.col("healthGrade") == "F", F.lit("abc")).otherwise(F.col("healthScore").cast("string")).alias("healthScore"))
    return M.map_recipes(raw).select(F.col("id").alias("recipe_id"), "cookTime", "prepTime", "totalTime", "healthScore", "type_error")


# ---- tags, review exchange (T3, T5-T10, J6-J9, S6, S10, G19, G21, W1-W2) -------------------

from larder.operators import tags as TG  # noqa: E402
from larder.operators.ordering import fixed_size_groups  # noqa: E402
from larder.plans import diet_job as DJ  # noqa: E402
from larder.plans import review as RV  # noqa: E402


def _classified_with_tags(spark, sf_dir, reuse: bool = False):
    """(recipes, recipe_id/title/tags/new_tags); ``reuse`` stores that narrow table for several branches of a plan."""
    r = _recipes(spark, sf_dir)
    c = C.with_classification(r.select("recipe_id", "title", "ingredients", "nutrients", "tags"), reasons=False)
    c = c.select("recipe_id", "title", "tags", "new_tags")
    return r, (TB.stored(c, "new-tags") if reuse else c)


def tagged_dataset(classified_df):
    """The dataset after the tag write-back: merged tags where new tags exist."""
    return classified_df.withColumn(
        "tags", F.when(F.size("new_tags") > 0, C.merge_tags(F.col("tags"), F.col("new_tags"))).otherwise(F.col("tags")))


@query("nutrient_value")
def q_nutrient_value(spark, sf_dir):
    r = _recipes(spark, sf_dir)
    fields = ["carbohydrate", "fat", "protein", "sodium", "sugar"]
    return r.select("recipe_id", *[C.nutrient_value(F.col("nutrients"), f).alias(f"nv_{f}") for f in fields])


@query("new_tags")
def q_new_tags(spark, sf_dir):
    _, c = _classified_with_tags(spark, sf_dir)
    return c.filter(F.size("new_tags") > 0).select("recipe_id", F.array_join("new_tags", "|").alias("new_tags"))


@query("merge_tags")
def q_merge_tags(spark, sf_dir):
    _, c = _classified_with_tags(spark, sf_dir)
    return _flat(C.tag_update(c), "tags", "merged_tags")


@query("uncertain_pairs")
def q_uncertain_pairs(spark, sf_dir):
    return C.uncertain_pairs(C.classify_rules(_recipes(spark, sf_dir)))


@query("tag_counts_both")
def q_tag_counts_both(spark, sf_dir):
    r = _recipes(spark, sf_dir)
    return TG.tag_counts_both(r, published_snapshot(spark, sf_dir, r))


@query("diet_distribution")
def q_diet_distribution(spark, sf_dir):
    _, c = _classified_with_tags(spark, sf_dir, reuse=True)
    return TG.diet_distribution(tagged_dataset(c))


@query("patch_tags")
def q_patch_tags(spark, sf_dir):
    r, c = _classified_with_tags(spark, sf_dir)
    patched = PB.patch_tags(published_snapshot(spark, sf_dir, r), c.filter(F.size("new_tags") > 0))
    return _flat(patched.select("id", "tags"), "tags")


@query("patch_skipped")
def q_patch_skipped(spark, sf_dir):
    r, c = _classified_with_tags(spark, sf_dir)
    return PB.patch_skipped(published_snapshot(spark, sf_dir, r),
                            c.filter(F.size("new_tags") > 0).select("recipe_id", "new_tags")).select("recipe_id")


@query("verify_compare")
def q_verify_compare(spark, sf_dir):
    r, c = _classified_with_tags(spark, sf_dir, reuse=True)
    snapshot = PB.patch_tags(published_snapshot(spark, sf_dir, r), c.filter(F.size("new_tags") > 0))
    return TG.verify_compare(tagged_dataset(c), snapshot)


@query("snapshot_to_classifier_rows")
def q_snapshot_to_classifier_rows(spark, sf_dir):
    from larder.functions.text import empty_array
    p = published_snapshot(spark, sf_dir)
    own = F.coalesce(F.col("ingredientStrings"), empty_array())
    ing = F.when(F.size(own) > 0, own).otherwise(
        F.filter(F.transform("ingredients", lambda i: i["displayString"]), lambda s: s.isNotNull() & (s != "")))
    return p.select(F.col("id").alias("recipe_id"), F.coalesce("title", F.lit("")).alias("title"),
                    F.array_join(F.filter(ing, lambda s: s != ""), "|").alias("ingredients"))


def _review_index(spark, sf_dir, *columns):
    """The stored index of the recipes with undecided diets, with ``columns`` beside their ids and diets; numbering reads its
    input twice, so the classification is stored."""
    r = _recipes(spark, sf_dir).select("recipe_id", "title", "ingredients", "nutrients")
    uncertain = RV.uncertain_by_recipe(C.with_classification(r, reasons=False, undecided=True))
    return RV.review_index(TB.stored(uncertain.select("recipe_id", *columns, "diets"), "uncertain"))


def _review_inputs(spark, sf_dir):
    """(classified rows, the stored index of the uncertain ones), of one classification."""
    r = _recipes(spark, sf_dir).select("recipe_id", "title", "ingredients", "nutrients")
    rows = C.with_classification(r, undecided=True).select("recipe_id", "title", "ingredients", "results", "undecided")
    rows = TB.stored(rows, "classified")
    return rows, RV.review_index(RV.uncertain_by_recipe(rows).select("recipe_id", "diets"))


def _replies(index):
    """Replies of every kind, made from the index: true, false and numeric answers, answers without confidence or reason, an
    unknown recipe in every third batch, and no JSON in every seventh."""
    n, size = F.col("idx"), F.length
    answers = F.transform("diets", lambda d: F.concat(
        F.lit('"'), d, F.lit('":{"applies":'),
        F.when((n + size(d)) % 3 == 0, "true").when((n + size(d)) % 3 == 1, "false").otherwise("1"),
        F.when((n + size(d)) % 4 == 0, "").otherwise(F.concat(F.lit(',"confidence":0.'), (6 + size(d) % 4).cast("string"))),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit(',"reason":"reviewed '), d, F.lit('"'))), F.lit("}")))
    item = F.concat(F.lit('{"id":'), n.cast("string"), F.lit(',"classifications":{'), F.array_join(answers, ","), F.lit("}}"))
    batches = index.select("batch", "idx", item.alias("item")).groupBy("batch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "item"))), lambda x: x["item"]), ",").alias("items"))
    b = F.col("batch")
    return batches.select("batch", F.concat(
        F.when(b % 7 == 3, "no JSON: ").otherwise(""), F.lit('{"results":['), "items",
        F.when(b % 3 == 0, ',{"id":1000,"classifications":{"vegan":{"applies":true}}}').otherwise(""), F.lit("]}")).alias("reply"))


@query("review_batches")
def q_review_batches(spark, sf_dir):
    index = _review_index(spark, sf_dir, "title", "ingredients")
    return RV.review_requests(index).select("batch", "n_recipes", "diets", "payload")


@query("parse_review")
def q_parse_review(spark, sf_dir):
    index = _review_index(spark, sf_dir)
    return RV.parse_replies(_replies(index), index)


@query("apply_review")
def q_apply_review(spark, sf_dir):
    rows, index = _review_inputs(spark, sf_dir)
    return RV.apply_review(rows, RV.parse_replies(_replies(index), index))


@query("cost_ledger")
def q_cost_ledger(spark, sf_dir):
    """The ledger over a usage table: one batch per user, tokens as the text that the user's events hold."""
    usage = TB.read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("batch")).agg(
        F.sum(F.length("props")).alias("input_tokens"), F.sum(F.length("event_type")).alias("output_tokens"))
    return RV.cost_ledger(usage)


@query("diet_job")
def q_diet_job(spark, sf_dir):
    """The whole job over the whole table, written as a new version and read back."""
    _, path = DJ.diet_job(_recipes(spark, sf_dir), _scratch(spark, "tagged"))
    return _flat(spark.read.parquet(path).select("recipe_id", "tags"), "tags")


@query("commit_chunks")
def q_commit_chunks(spark, sf_dir):
    g = fixed_size_groups(published_snapshot(spark, sf_dir).select("id"), "id", 50)
    return g.select("id", F.col("group").alias("chunk"), "idx")


@query("commit_sink")
def q_commit_sink(spark, sf_dir):
    """Every published document's fate in a sink of 50-row commits that stores no document of more than 225 bytes; grade C is not in the target."""
    p = published_snapshot(spark, sf_dir).select("id", F.array_join("instructions", " ").alias("text"), "healthGrade")
    p = p.withColumn("text", F.when(F.col("healthGrade") == "A", F.col("text")).otherwise(F.substring("text", 1, 200)))
    target = p.filter(~F.col("healthGrade").eqNullSafe(F.lit("C"))).select("id")
    done = DS.commit_documents(p.select("id", "text"), TB.new_version_path(_scratch(spark, "commits")), existing=target, max_bytes=225)
    return (done.stored.select("chunk", "id", F.lit("success").alias("outcome"))
            .unionByName(done.failures.select("chunk", "id", F.lit("failed").alias("outcome"))))


# ---- prompts, pages, restructure, sources/sinks (B1-B9, S3, S4, S7, S8, S11-S14, L2) -------

from larder.plans import prompts as PR  # noqa: E402
from larder.sources import pages as PG  # noqa: E402


@query("prompt_text")
def q_prompt_text(spark, sf_dir):
    return PR.prompt_columns(M.map_recipes(_recipes(spark, sf_dir))).select("id", "full_prompt")


@query("image_manifest")
def q_image_manifest(spark, sf_dir):
    return PR.image_manifest(published_snapshot(spark, sf_dir))


@query("pages_to_recipes")
def q_pages_to_recipes(spark, sf_dir):
    p = PG.pages_to_recipes(TB.read_table(spark, sf_dir, "pages"))
    return p.select("id", "url", "title", "description", "host", F.size("instructions").alias("n_instructions"))


@query("page_tags")
def q_page_tags(spark, sf_dir):
    p = PG.with_sources(TB.read_table(spark, sf_dir, "pages"))
    return p.select("page_id", F.array_join(PG.page_tags(F.col("html"), F.col("_ld"), F.col("_items")), "|").alias("tags"))


@query("pages_validation")
def q_pages_validation(spark, sf_dir):
    p = PG.pages_to_recipes(TB.read_table(spark, sf_dir, "pages"))
    return M.validate(M.map_recipes(p)).groupBy("error").agg(F.count(F.lit(1)).alias("count"))


@query("restructure_wide")
def q_restructure_wide(spark, sf_dir):
    """A wide table, one struct column per order priority, turned to rows."""
    orders = TB.read_table(spark, sf_dir, "orders")
    wide = orders.agg(*(F.struct(F.count_if(F.col("o_orderpriority") == p).alias("n"),
                                 F.max(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))).alias("top")).alias(p)
                        for p in PRIORITY_MEAL))
    return TB.restructure_wide(wide)


@query("restructure_json")
def q_restructure_json(spark, sf_dir):
    """A JSON object {id: {...}} per customer turned to one row per order."""
    entry = F.struct(F.col("o_orderkey").cast("string").alias("key"),
                     F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority")).alias("value"))
    packed = TB.read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("payload"))
    return TB.restructure_json_map(packed.select("payload"), "payload", "struct<total:double,priority:string>")


@query("restructure_props")
def q_restructure_props(spark, sf_dir):
    return TB.json_map_rows(TB.read_table(spark, sf_dir, "events").select("event_id", "props"), "props")


@query("describe_columns")
def q_describe_columns(spark, sf_dir):
    return TB.describe_columns(_recipes(spark, sf_dir)).drop("dtype")


@query("sample_n")
def q_sample_n(spark, sf_dir):
    """Size, distinct ids and members of a random sample, which is what a random result can be held against."""
    r = _recipes(spark, sf_dir).select("recipe_id")
    some = B.select_rows(r, 10).withColumn("picked", F.lit(1))
    return some.join(r, "recipe_id", "left_semi").agg(
        F.count(F.lit(1)).alias("members"), F.countDistinct("recipe_id").alias("distinct_ids"), F.sum("picked").alias("picked"))


def _scratch(spark, name):
    from larder.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{name}"


@query("convert_codec")
def q_convert_codec(spark, sf_dir):
    dst = TB.new_version_path(_scratch(spark, "converted"))
    # the byte counts of the report vary with the writer
    return TB.convert_codec(spark, TB.table_path(sf_dir, "orders"), dst, "zstd").select("rows", "columns", "codec")


@query("replace_dataset")
def q_replace_dataset(spark, sf_dir):
    """The tagged dataset takes the place of the untagged one; a plain read of the base folder gives its rows."""
    base = TB.new_version_path(_scratch(spark, "recipes"))
    r, c = _classified_with_tags(spark, sf_dir, reuse=True)
    VS.replace_dataset(r.select("recipe_id", "title", "tags"), base)
    VS.replace_dataset(tagged_dataset(c).drop("new_tags"), base)
    return VS.read_version(spark, base).agg(F.count(F.lit(1)).alias("rows"),
                                            F.count_if(F.size("tags") > 0).alias("tagged_rows"))


@query("dataset_versions")
def q_dataset_versions(spark, sf_dir):
    """Rows that differ between a dataset's current version and its backup, after the tags were written back."""
    base = TB.new_version_path(_scratch(spark, "recipes"))
    r, c = _classified_with_tags(spark, sf_dir, reuse=True)
    VS.replace_dataset(r.select("recipe_id", "tags"), base)
    VS.replace_dataset(tagged_dataset(c).select("recipe_id", "tags"), base, expected=1)
    before = VS.read_version(spark, base, 1).select("recipe_id", F.col("tags").alias("before"))
    both = VS.read_version(spark, base).join(before, "recipe_id").filter(~F.col("tags").eqNullSafe(F.col("before")))
    return _flat(both, "tags", "before")


@query("upsert_store")
def q_upsert_store(spark, sf_dir):
    """The published titles in a keyed store, after a table of edits in which most recipes come several times."""
    base = TB.new_version_path(_scratch(spark, "store"))
    r = _recipes(spark, sf_dir)
    KS.create_store(published_snapshot(spark, sf_dir, r).select("id", "title", "healthGrade"), base)
    edits = r.select(F.col("recipe_id").alias("id"), "title", "healthGrade", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"))
    edits = edits.filter((F.col("id").cast("long") + F.col("n")) % 3 == 0).select(
        "id", F.concat_ws(" / edit ", "title", F.col("n").cast("string")).alias("title"), "healthGrade",
        (F.col("n") * 7 % 5).alias("arrived"))
    KS.upsert_store(edits, base, "arrived")
    return VS.read_version(spark, base)


@query("stats_export")
def q_stats_export(spark, sf_dir):
    """The statistics of the published snapshot as JSON lines (section, name, count), written and read back."""
    out = TB.new_version_path(_scratch(spark, "stats"))
    S.statistics(published_snapshot(spark, sf_dir)).write.json(out)
    return spark.read.schema("section string, name string, count long").json(out)


@query("stats_report")
def q_stats_report(spark, sf_dir):
    """All sections of the exported statistics, written as JSON lines and read back."""
    out = TB.new_version_path(_scratch(spark, "stats"))
    S.report(published_snapshot(spark, sf_dir)).write.json(out)
    return spark.read.schema("section string, name string, value double").json(out)


@query("sample_ids")
def q_sample_ids(spark, sf_dir):
    """The seeded sample's own ids: the same from any partitioning."""
    return B.select_rows(_recipes(spark, sf_dir).select("recipe_id"), 200)


@query("type_check_text")
def q_type_check_text(spark, sf_dir):
    """Numbers where text belongs: an author's number, and nutrients in list form with numeric quantities."""
    r = _recipes(spark, sf_dir)
    raw = r.select("recipe_id", "title", F.when(F.col("cluster_id") % 4 == 0, F.col("cluster_id")).alias("author"),
                   F.when(F.col("cluster_id") % 3 == 0, F.transform("nutrients", lambda n: F.struct(
                       n["name"].alias("name"), F.length(n["quantity"]).alias("quantity")))).alias("nutrients"))
    return M.validate(M.map_recipes(raw)).select("id", "error")


@query("json_source")
def q_json_source(spark, sf_dir):
    """A JSON batch written from the published snapshot, then read back with the raw schema."""
    out = TB.new_version_path(_scratch(spark, "json_batch"))
    published_snapshot(spark, sf_dir).select("id", "title", "tags", "ingredientStrings").write.json(out)
    back = TB.read_json_batch(spark, out, "id string, title string, tags array<string>, ingredientStrings array<string>",
                              multi_line=False)
    return _flat(back, "tags", "ingredientStrings")
