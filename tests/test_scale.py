"""Steps that grew faster than their input: what is stored, what goes through a shuffle, and what is tested per row."""

import pyarrow as pa
from pyspark.sql import functions as F

from larder.operators import publish as PB
from larder.operators import tags as TG
from larder.plans import classify as C
from larder.plans import prompts as PR
from larder.plans import review as RV
from larder.plans.diet_rules import DIET_NAMES

NUT = "array<struct<name:string,quantity:string>>"


def test_recipe_table_stores_no_derived_text(spark, scratch):
    from larder.sources.recipe_view import recipe_table, recipe_view

    at = F.to_timestamp(F.lit("2020-02-03"))
    spark.createDataFrame([(1, 7, "F", 10.0, "1-URGENT"), (2, 8, "O", 20.0, "5-LOW"), (2, 8, "O", 20.0, "5-LOW")],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
                          ).withColumn("o_orderdate", at).write.parquet(f"{scratch}/orders.parquet")
    spark.createDataFrame([(1, 5, 2, 3.0), (1, 4, 1, 2.0), (1, 9, 3, 1.0), (None, 4, 1, 1.0)],
                          "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{scratch}/lineitem.parquet")
    spark.createDataFrame([(4, "blue bolt", "SMALL"), (5, "odd thing", "X")], "p_partkey long, p_name string, p_type string").write.parquet(
        f"{scratch}/part.parquet")
    table = recipe_table(spark, scratch)
    assert not {"instructions", "url", "uuid", "procesedIngredients"} & set(spark.read.parquet(*table.inputFiles()).columns)
    rows = sorted(map(repr, table.collect()))
    assert rows == sorted(map(repr, recipe_view(spark, scratch).collect())) and len(rows) == 3
    one = table.filter("recipe_id = '1'").first()
    assert (one.ingredients, one.cookTime, one.numServings) == (["almond milk", "odd thing"], 30, "2-4 servings")
    assert [(p.quantity, p.displayString, p.foodCodes.ingredientID) for p in one.procesedIngredients] == [
        (2.0, "almond milk", "4"), (3.0, "odd thing", "5")]
    assert [(n.name, n.quantity) for n in one.nutrients] == [("proteinContent", "2.0g"), ("X", "3.0g")]
    assert table.filter("recipe_id = '2' AND ingredients IS NULL AND cookTime IS NULL AND numServings IS NULL").count() == 2


def test_phrases_are_tested_by_their_first_word_only(spark):
    df = spark.createDataFrame([("a", ["Half-and-Half"], None), ("b", ["half-and-halfs, sour creamy"], None),
                                ("c", ["x\tsour cream!"], None), ("d", ["sour  cream"], None)],
                               f"recipe_id string, ingredients array<string>, nutrients {NUT}")
    out = C.with_classification(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().upper().count("RLIKE") <= 2
    vegan = {r.recipe_id: [x.reason for x in r.results if x.diet == "vegan"][0] for r in out.collect()}
    assert "Contains" in vegan["d"] and "cream" in vegan["d"]  # the word alone, not the phrase
    milk = [d.name for d in C.DIETS if "half-and-half" in d.blocklist]
    got = {r.recipe_id: {x.diet for x in r.results if x.applies is False or x.confidence == 0.45} for r in out.collect()}
    assert milk and set(milk) <= got["a"] and not got["b"] & set(milk)
    for r in out.collect():
        assert r.new_tags == [x.diet for x in r.results if x.applies and x.confidence >= C.APPLY_THRESHOLD]


def test_word_count_of_highlights(spark):
    texts = ["one two three four", "one two three four five", " a b  c\td ", " a b c\nd e"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(PR.highlights(F.array("t", F.lit("z"))).alias("h"))
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.h for r in df.collect()] == ["featuring one two three four and z", "featuring z", "featuring a b  c\td and z",
                                           "featuring z"]


def _published(spark):
    from larder.operators import mapping as M

    raw = ("id string, recipe_id string, uuid string, title string, ingredients array<string>, "
           f"procesedIngredients array<{M.INGREDIENT_TYPE}>, nutrients {NUT}")
    row = lambda i, r, t: (i, r, "u", t, ["x"], [(1.0, "g", "x", ("1",))], [("fat", "1g")])
    selected = spark.createDataFrame([row("n1", "1", "own id"), row("n2", "2", "known"), row("n3", "3", "bad"), row("n3", "4", "good"),
                                      (None, "5", None, "t", None, None, None)], raw)
    known = M.map_recipes(spark.createDataFrame([row("2", "2", "old")], raw)).drop("type_error")
    status = spark.createDataFrame([("3", False, True), ("n1", False, None)], "recipe_id string, uploaded boolean, bad boolean")
    return selected, known, status


def test_publish_job_stores_outcomes_only(spark):
    outcomes, snapshot, flags = PB.publish_job(*_published(spark), dry_run=False)
    assert spark.read.parquet(*outcomes.inputFiles()).columns == ["recipe_id", "outcome", "error"]
    assert sorted((r.recipe_id, r.outcome) for r in outcomes.collect()) == [
        ("2", "skipped"), ("3", "dropped_bad"), ("5", "failed"), ("n1", "published"), ("n3", "published")]
    assert sorted((r.id, r.title) for r in snapshot.collect()) == [("2", "old"), ("n1", "own id"), ("n3", "good")]
    assert sorted((r.recipe_id, r.uploaded) for r in flags.collect()) == [("3", False), ("n1", True)]


def test_publish_joins_carry_no_recipe(spark):
    plan = PB.publish_outcomes(*_published(spark))._jdf.queryExecution().executedPlan().toString()
    # map and validate lie below every join: no exchange or sort has the recipe's lists in its input
    joins = [line for line in plan.splitlines() if "Join" in line]
    last = max(plan.rindex(line) for line in joins)
    assert joins and "ingredients are required" not in plan[:last]


def test_uncertain_by_recipe_reads_stored_diets(spark):
    df = spark.createDataFrame([("1", "t", ["x"], ["keto"]), ("2", "t", None, [])],
                               "recipe_id string, title string, ingredients array<string>, undecided array<string>")
    assert [tuple(r) for r in RV.uncertain_by_recipe(df).collect()] == [("1", "t", ["x"], ["keto"])]


def test_first_titles_of_a_diet_are_kept_without_a_sort(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(["3", None, "1", "2"]), pa.array(["c", "n", "a", None]),
                                        pa.array([["keto", "vegan"], ["keto"], ["keto"], ["vegan"]])], ["recipe_id", "title", "diets"])
    found = [r for b in TG.first_rows(iter([batch, batch]), 2) for r in b.to_pylist()]
    assert sorted((r["diet"], r["recipe_id"] or "") for r in found) == [("keto", ""), ("keto", ""), ("vegan", "2"), ("vegan", "2")]
    assert list(TG.first_rows(iter([]), 2)) == []
    rows = [(str(i), f"t{i}", ["vegan", "vegan", "other"]) for i in range(100, 160)] + [("99", None, None)]
    df = spark.createDataFrame(rows, "recipe_id string, title string, tags array<string>").repartition(5)
    got = {r.diet: r for r in TG.diet_distribution(df).collect()}
    assert list(got) and set(got) == set(DIET_NAMES)
    assert (got["vegan"]["count"], got["vegan"].sample_titles) == (60, "t100 | t101 | t102") and got["keto"]["count"] == 0


def test_undecided_diets_are_made_once_and_without_results(spark):
    df = spark.createDataFrame([
        ("a", ["almond milk", "Coconut Flour"], [("sodiumContent", "5g")]), ("b", ["beef", "peanut butter", "rice"], None),
        ("c", None, None), ("d", ["whole wheat flour", "vegetable oil", "soy milk"], [("sugarContent", "x"), ("fatContent", "70g")]),
        ("e", ["eggplant, cauliflower rice"], [("carbohydrateContent", "3g")])], f"recipe_id string, ingredients array<string>, nutrients {NUT}")
    df = df.withColumn("title", F.lit("t"))
    rows = C.with_classification(df, undecided=True).withColumn("want", RV.undecided_diets()).collect()
    assert len(rows) == 5 and any(len(r.want) > 2 for r in rows)
    assert [r.undecided for r in rows] == [r.want for r in rows]
    out = RV.uncertain_by_recipe(C.with_classification(df, reasons=False, undecided=True))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("may be" in line or "CASE WHEN" in line for line in plan.splitlines()) == 1
    assert {r.recipe_id: r.diets for r in out.collect()} == {r.recipe_id: r.want for r in rows if r.want}


def test_replies_are_parsed_once_and_meet_their_batch_before_they_become_rows(spark):
    index = spark.createDataFrame([(0, 0, "r1"), (0, 1, "r2"), (0, 2, "r1"), (1, 0, None), (2, 0, "r4")], "batch long, idx int, recipe_id string")
    replies = spark.createDataFrame([
        (0, '{"results":[{"id":0,"classifications":{"vegan":{"applies":true},"keto":{"applies":true}}},'
            '{"id":2,"classifications":{"vegan":{"applies":false,"confidence":0.6,"reason":"later"}}},'
            '{"id":1,"classifications":null},{"id":null,"classifications":{"vegan":{"applies":true}}}]}'),
        (1, '{"results":[{"id":0,"classifications":{"vegan":{"applies":"False"}}}]}'), (None, '{"results":[]}'),
        (2, '{"results":null}'), (2, None), (9, '{"results":[{"id":0,"classifications":{"vegan":{"applies":true}}}]}')], "batch long, reply string")
    out = RV.parse_replies(replies, index)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("from_json") == 1 and plan.index("join inner") > plan.rindex("generate posexplode")  # parents come first
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [
        ("r1", "vegan", False, 0.6, "llm", "later"), ("r1", "keto", True, 0.7, "llm", "LLM classification"),
        (None, "vegan", False, 0.7, "llm", "LLM classification")]))


def test_the_index_of_parse_review_holds_no_recipe_text(spark, scratch):
    from larder import catalog

    index = catalog._review_index(spark, "/root/testdata/sf0.001")
    assert not {"title", "ingredients"} & set(index.columns) and {"batch", "idx", "recipe_id", "diets"} <= set(index.columns)
