"""Predicates, sources, statistics, mapping, publish, review, ordering, streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from larder.functions import predicates as P
from larder.operators import mapping as M
from larder.operators import publish as PB
from larder.operators import stats as S
from larder.operators.ordering import global_row_number
from larder.plans import review as RV
from larder.sources import tables as TB


def test_strenum_fstring():
    assert f"{P.RecipeColumn.HEALTH_SCORE}__gt" == "healthScore__gt"
    assert P.RecipeColumn.has_column("cluster_id")


def test_dict_filters_and_errors(spark):
    df = spark.createDataFrame([(1, "Pasta", 4.5), (2, "Salad", None), (3, "Cake", 5.0)],
                               "id int, name string, rating double")
    assert P.apply_filters(df, query={"rating__gte": 4.6}).count() == 1
    assert P.apply_filters(df, query={"rating": {"__lte": 4.5}}).count() == 1  # null dropped
    assert P.apply_filters(df, P.ColumnRef("name").contains("^(PASTA|cake)$")).count() == 2
    with pytest.raises(ValueError):
        P.dict_filters({"nope": 1}, df.columns)
    with pytest.raises(ValueError):
        P.dict_filters({"rating__between": 1}, df.columns)
    with pytest.raises(ValueError):
        P.Filter("rating", "between", 1).to_column()


def test_list_any_contains_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, "Beef stock"])], "id int, l array<string>")
    assert [r.id for r in P.apply_filters(df, P.ColumnRef("l").list_any_contains("beef")).collect()] == [3]


def test_skip_tagged(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, ["vegan"]), (4, ["x"])], "id int, tags array<string>")
    assert sorted(r.id for r in P.skip_tagged(df, ["vegan", "keto"]).collect()) == [2, 4]


def test_scan_checks(spark, scratch):
    with pytest.raises(ValueError):
        TB.scan_parquet(spark, "")
    with pytest.raises(FileNotFoundError):
        TB.scan_parquet(spark, os.path.join(scratch, "missing.parquet"))
    bad = os.path.join(scratch, "x.csv")
    open(bad, "w").write("a\n1\n")
    with pytest.raises(ValueError):
        TB.scan_parquet(spark, bad)
    with pytest.raises(ValueError):
        TB.select_columns(spark.range(1), ["nope"])


def test_json_batch_list_and_object(spark, scratch):
    a = os.path.join(scratch, "list.json")
    b = os.path.join(scratch, "one.json")
    json.dump([{"id": "1", "title": "A"}, {"id": "2", "title": "B"}], open(a, "w"))
    json.dump({"id": "3", "title": "C"}, open(b, "w"))
    assert TB.read_json_batch(spark, a, "id string, title string").count() == 2
    assert TB.read_json_batch(spark, b, "id string, title string").count() == 1


def test_distinct_incl_null_and_missing_fields(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), (None,)], "ingredients array<string>")
    assert S.distinct_values_incl_null(df, "ingredients").first()[0] == 3
    mf = spark.createDataFrame([(None, 0), ("", None), (" ", 5)], "title string, cookTime int")
    got = {r.field: r.missing for r in S.missing_fields(mf, ("title", "cookTime")).collect()}
    assert got == {"title": 2, "cookTime": 1}


def test_mapping_and_validation(spark):
    df = spark.createDataFrame(
        [("r1", None, "T", ["a"], None, "4-6 servings"), ("r2", "u", "", ["b"], {"fat": "3g"}, "about four")],
        "recipe_id string, uuid string, title string, ingredients array<string>, nutrients map<string,string>, "
        "numServings string")
    m = M.validate(M.map_recipes(df)).orderBy("id").collect()
    assert m[0].numServings == 4.0 and m[1].numServings is None
    assert m[0].error == "uuid is required; ingredients are required structured; nutrients are required"
    assert m[1].title == "Unknown" and m[1].nutrients[0].asDict() == {"name": "fat", "quantity": "3g"}
    assert m[0].ingredientStrings == ["a"] and m[0].channel == "discover"


def test_upsert_and_patch(spark):
    target = spark.createDataFrame([("1", ["a", "a"]), ("2", None)], "id string, tags array<string>")
    upd = spark.createDataFrame([("2", ["z"], 1), ("2", ["y"], 2), ("3", ["x"], 1)],
                                "id string, tags array<string>, seq int")
    got = {r.id: r.tags for r in PB.upsert_by_id(target, upd, "seq").collect()}
    assert got == {"1": ["a", "a"], "2": ["y"], "3": ["x"]}
    new = spark.createDataFrame([("1", ["b", "a"]), ("9", ["c"])], "recipe_id string, new_tags array<string>")
    patched = {r.id: r.tags for r in PB.patch_tags(target, new).collect()}
    assert patched == {"1": ["a", "a", "b"], "2": None}
    assert [r.recipe_id for r in PB.patch_skipped(target, new).collect()] == ["9"]


@pytest.mark.parametrize("conf", [
    {"spark.sql.adaptive.coalescePartitions.enabled": "true"}, {"spark.sql.adaptive.coalescePartitions.enabled": "false"},
    {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}])
def test_global_row_number(spark, conf):
    """Every row once, numbers 0..n-1 in key order, for a frame of several columns over many range partitions."""
    held = {k: spark.conf.get(k, None) for k in [*conf, "spark.sql.shuffle.partitions"]}
    try:
        for k, v in {**conf, "spark.sql.shuffle.partitions": "12"}.items():
            spark.conf.set(k, v)
        df = spark.range(0, 60_000, 1, 9).select(F.format_string("k%06d", "id").alias("k"), (F.col("id") * 2).alias("v"),
                                                 F.repeat(F.lit("x"), F.lit(60)).alias("pad"))
        rows = global_row_number(df.orderBy(F.rand(3)), "k").collect()
        assert sorted((r.k, r.rn, r.v) for r in rows) == [(f"k{i:06d}", i, 2 * i) for i in range(60_000)]
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_parse_replies(spark):
    index = spark.createDataFrame([(0, 0, "r1", ["vegan"]), (0, 1, "r2", ["keto"])],
                                  "batch long, idx int, recipe_id string, diets array<string>")
    replies = spark.createDataFrame([
        (0, '{"results":[{"id":0,"classifications":{"vegan":{"applies":"false","confidence":0.9}}},'
            '{"id":7,"classifications":{"keto":{"applies":true}}},'
            '{"id":1,"classifications":{"keto":{"applies":false}}},{"id":1,"classifications":{"keto":{"applies":1}}}]}'),
        (1, "not json")], "batch long, reply string")
    got = {(r.recipe_id, r.diet): (r.applies, r.confidence, r.reason) for r in RV.parse_replies(replies, index).collect()}
    assert got == {("r1", "vegan"): (False, 0.9, "LLM classification"), ("r2", "keto"): (True, 0.7, "LLM classification")}


def test_publish_stream(spark, scratch):
    from larder.streaming.publish_stream import current_snapshot, failures, publish_stream
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    rec = {"recipe_id": "1", "uuid": "u1", "title": "A", "ingredients": ["x"],
           "nutrients": [{"name": "fat", "quantity": "1g"}], "procesedIngredients": [{"displayString": "x"}]}
    with open(os.path.join(src, "b1.json"), "w") as f:
        f.write(json.dumps(rec) + "\n" + json.dumps({"recipe_id": "2", "title": "B"}) + "\n")
    schema = ("recipe_id string, uuid string, title string, ingredients array<string>, "
              "nutrients array<struct<name:string,quantity:string>>, "
              "procesedIngredients array<struct<quantity:double,unit:string,displayString:string,"
              "foodCodes:struct<ingredientID:string>>>")
    out = os.path.join(scratch, "out")
    q = publish_stream(spark, src, out, schema, checkpoint=os.path.join(scratch, "chk"))
    q.awaitTermination(120)
    assert [r.id for r in current_snapshot(spark, out).collect()] == ["1"]
    assert [r.id for r in failures(spark, out).collect()] == ["2"]


RAW = ("recipe_id string, uuid string, title string, ingredients array<string>, cookTime {}, healthScore string, ratings string, "
       "nutrients array<struct<name:string,quantity:string>>, procesedIngredients array<struct<quantity:double,unit:string,"
       "displayString:string,foodCodes:struct<ingredientID:string>>>")


def raw(rid, title, cook, score="1.5", ratings="4"):
    return (rid, "u", title, ["x"], cook, score, ratings, [("fat", "1g")], [(1.0, "g", "x", None)])


def test_bad_values_fail_their_row_only(spark):
    df = spark.createDataFrame([raw("1", "A", " 30 "), raw("2", "B", "30 min"), raw("3", "C", "3000000000"), raw("4", "D", "5", "abc"),
                                raw("5", "E", "5.0", "2", "abc"), raw("6", "F", "3.5")], RAW.format("string"))
    got = {r.id: (r.valid, r.error, r.cookTime) for r in M.validate(M.map_recipes(df)).collect()}
    assert got["1"] == (True, "", 30)
    assert got["2"] == got["3"] == got["6"] == (False, "cookTime: Input should be a valid integer", None)
    assert got["4"][:2] == (False, "healthScore: Input should be a valid number")
    assert got["5"][:2] == (False, "ratings: Input should be a valid number")
    wide = spark.createDataFrame([raw("1", "A", 3_000_000_000)], RAW.format("long"))
    assert not M.validate(M.map_recipes(wide)).first().valid


def test_publish_job_takes_the_last_of_an_id(spark, scratch):
    rows = [(*raw("1", "old", "5"), 1), (*raw("1", "new", "5"), 2), (*raw("2", "bad", "x"), 3), (*raw("3", "known", "5"), 4), (*raw("4", "b", "5"), 5)]
    df = spark.createDataFrame(rows, RAW.format("string") + ", seq int")
    known = M.map_recipes(spark.createDataFrame([raw("3", "published", "5")], RAW.format("string"))).drop("type_error")
    status = spark.createDataFrame([("1", False, False), ("3", True, False), ("4", False, True)], "recipe_id string, uploaded boolean, bad boolean")
    outcomes, snapshot, flags = PB.publish_job(df, known, status, dry_run=False, order_col="seq")
    assert sorted((r.recipe_id, r.outcome) for r in outcomes.collect()) == [
        ("1", "published"), ("1", "published"), ("2", "failed"), ("3", "skipped"), ("4", "dropped_bad")]
    assert sorted((r.id, r.title) for r in snapshot.collect()) == [("1", "new"), ("3", "published")]
    assert {r.recipe_id: r.uploaded for r in flags.collect()} == {"1": True, "3": True, "4": False}
    _, twice, _ = PB.publish_job(df, known, status, dry_run=False)
    assert sorted(r.id for r in twice.collect()) == ["1", "3"]  # without an order still one row an id
    paths = PB.write_publish(df, known, status, scratch, "seq")
    assert spark.read.parquet(paths["snapshot"]).count() == 2


def test_batches_and_samples(spark):
    from larder.operators.batch import get_batch, select_rows

    df = spark.createDataFrame([(f"r{i}", i % 2) for i in range(20)], "recipe_id string, odd int")
    assert [r.recipe_id for r in get_batch(df, 3, query={"odd": 1}).collect()] == ["r1", "r11", "r13"]
    none = get_batch(df, 0)
    assert none.count() == 0 and none.schema == df.schema
    for bad in (lambda: get_batch(df, -1), lambda: select_rows(df, -1), lambda: select_rows(df, 1, "best")):
        with pytest.raises(ValueError):
            bad()
    assert [r.recipe_id for r in select_rows(df, 2, "first").collect()] == ["r0", "r1"]
    assert len({r.recipe_id for r in select_rows(df, 7).collect()}) == 7 and select_rows(df, 99).count() == 20


def test_diet_job(spark, scratch):
    from larder.plans.diet_job import diet_job

    rows = [("1", "a", ["beef"], ["x"]), ("2", "b", ["rice"], []), ("3", "c", ["rice"], None), ("4", "d", ["rice"], ["vegan"])]
    df = spark.createDataFrame(rows, "recipe_id string, title string, ingredients array<string>, tags array<string>").withColumn(
        "nutrients", F.array().cast("array<struct<name:string,quantity:string>>"))
    summary, path = diet_job(df, f"{scratch}/a")
    tags = {r.recipe_id: r.tags for r in spark.read.parquet(path).collect()}
    assert tags["3"] is None and tags["4"] == ["vegan"] and "vegan" in tags["2"] and "vegan" not in tags["1"]
    assert summary.first().total == 2
    _, path = diet_job(df, f"{scratch}/b", limit=1)
    assert {r.recipe_id: r.tags for r in spark.read.parquet(path).collect()}["2"] == []


def test_page_fields(spark):
    from larder.sources.pages import pages_to_recipes

    ld = ('{"recipeIngredient":["2 eggs"," flour "],"nutrition":{"@type":"N","fatContent":"3g"},"author":{"name":"Ann"},'
          '"recipeYield":["4 servings"],"prepTime":"PT1H30M","cookTime":"PT45M","totalTime":"P1DT15M","cookingMethod":"Baking",'
          '"aggregateRating":{"ratingValue":"4.5","ratingCount":12},"recipeCategory":"Dessert, Cake","keywords":["sweet"]}')
    html = f'<title>Cake</title><nav><a href="/">Home</a></nav><script type="application/ld+json">{ld}</script>'
    rows = [("http://x.org/a", html), ("http://x.org/b", "<title>Plain</title>"), ("http://x.org/c", '<title>Bad</title><script type="application/ld+json">{oops</script>')]
    a, b, c = pages_to_recipes(spark.createDataFrame(rows, "url string, html string")).orderBy("url").collect()
    assert a.ingredients == ["2 eggs", "flour"] and a.author == "Ann" and a.numServings == "4 servings"
    assert (a.prepTime, a.cookTime, a.totalTime, a.ratings, a.ratingsCount) == (90, 45, 1455, 4.5, 12)
    assert [tuple(n) for n in a.nutrients] == [("fatContent", "3g")] and a.ingredientGroups[0].ingredients == a.ingredients
    assert a.tags == ["Cake", "Dessert", "Home", "sweet"] and a.cookingMethod == "Baking"
    for r in (b, c):
        assert r.ingredients == [] == r.nutrients == r.ingredientGroups and r.author is None and r.prepTime is None


def test_page_recipe_among_blocks_and_graph(spark):
    import json

    from larder.sources.pages import pages_to_recipes

    recipe = {"@type": ["Article", "Recipe"], "description": "Good <b>soup</b>", "image": {"url": "s.png"}, "author": [{"name": "Bo"}],
              "recipeInstructions": [{"@type": "HowToSection", "itemListElement": [{"text": "Chop."}, {"name": "Boil."}]}, "Serve."],
              "recipeIngredient": ["1 leek"], "suitableForDiet": ["https://schema.org/VeganDiet", "GlutenFreeDiet"],
              "tool": [{"@type": "HowToTool", "name": "Pot"}, "Ladle"], "recipeCuisine": "French", "keywords": "warm, quick"}
    block = lambda v: f'<script type="application/ld+json">{v if isinstance(v, str) else json.dumps(v)}</script>'
    site = {"@type": "WebSite", "name": "Site", "description": "not this", "keywords": "site"}
    forms = [[block(site), block(recipe)], [block({"@graph": [site, recipe]})], [block([site, recipe])],
             [block("{broken"), block([{"@graph": [site]}, {"@graph": [recipe]}])]]
    rows = [(f"http://x.org/{i}", "<title>Soup</title>" + "".join(f)) for i, f in enumerate(forms)]
    got = pages_to_recipes(spark.createDataFrame(rows, "url string, html string")).collect()
    assert len(got) == len(forms)
    for r in got:
        assert (r.description, r.image, r.author, r.ingredients) == ("Good soup", "s.png", "Bo", ["1 leek"])
        assert r.instructions == ["Chop.", "Boil.", "Serve."]
        assert r.tags == ["French", "GlutenFreeDiet", "Ladle", "Pot", "VeganDiet", "quick", "warm"]


def test_page_microdata_fallback(spark):
    from larder.sources.pages import pages_to_recipes

    html = ('<div itemscope itemtype="https://schema.org/Recipe"><h1 itemprop="name">Pie &amp; Mash</h1>'
            '<span itemprop="author">Cy</span><meta itemprop="prepTime" content="PT20M"><time datetime="PT1H" itemprop="cookTime">1 hour</time>'
            '<li itemprop="recipeIngredient">2 eggs</li><li class="i" itemprop="recipeIngredient"> flour </li>'
            '<p itemprop="recipeInstructions">Bake.</p><span itemprop="keywords">warm, British</span>'
            '<link itemprop="suitableForDiet" content="https://schema.org/HalalDiet"><span itemprop="ratingValue">4.5</span></div>')
    rows = [("http://x.org/a", html), ("http://x.org/b", None), ("http://x.org/c", "<title> </title>"), (None, "<title>T</title>")]
    got = {r.url: r for r in pages_to_recipes(spark.createDataFrame(rows, "url string, html string")).collect()}
    a = got["http://x.org/a"]
    assert set(got) == {"http://x.org/a", None} and got[None].id is None and got[None].tags == []
    assert (a.title, a.author, a.prepTime, a.cookTime, a.ratings) == ("Pie & Mash", "Cy", 20, 60, 4.5)
    assert a.ingredients == ["2 eggs", "flour"] and a.instructions == ["Bake."] and a.tags == ["British", "HalalDiet", "warm"]


def test_image_requests(spark):
    from larder.plans.prompts import image_requests

    df = spark.createDataFrame([("1", "a dish"), ("2", "  "), ("3", None)], "id string, full_prompt string")
    assert [r.error for r in image_requests(df, 2).orderBy("id").collect()] == ["", "prompt is empty", "prompt is empty"]
    for n in (0, 5):
        with pytest.raises(ValueError):
            image_requests(df, n)


def test_restructure(spark):
    wide = spark.createDataFrame([('{"title":"A","n":1}', '{"title":"B","n":2}')], "r1 string, r2 string")
    long = TB.restructure_wide(wide, "struct<title:string,n:int>")
    assert sorted(tuple(r) for r in long.collect()) == [("r1", "A", 1), ("r2", "B", 2)]


def test_restructure_thousands_of_columns(spark):
    """As many columns as rows come out, in one generator; names and missing values survive."""
    n = 3000
    wide = spark.range(1).selectExpr(*(f"named_struct('title', 't{i}', 'n', id + {i}) AS `r{i}`" for i in range(n)))
    long = TB.restructure_wide(wide)
    assert long.agg(F.count("*"), F.countDistinct("recipe_id"), F.sum("n")).first()[:] == (n, n, n * (n - 1) // 2)
    odd = spark.createDataFrame([("x", None)], "`it's a.b` string, `c``d\\\\e` string")
    assert [tuple(r) for r in TB.restructure_wide(odd).collect()] == [("it's a.b", "x"), ("c`d\\\\e", None)]
    mixed = spark.createDataFrame([(1, 2)], "a int, b long")
    assert [tuple(r) for r in TB.restructure_wide(mixed).collect()] == [("a", 1), ("b", 2)]
    assert TB.restructure_wide(mixed.select()).count() == 0


def test_recipe_table_follows_its_inputs(spark, scratch):
    from larder.sources.recipe_view import recipe_table

    for t in ("orders", "lineitem", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{scratch}/{t}.parquet")
    before = recipe_table(spark, scratch).count()
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(3).write.mode("append").parquet(f"{scratch}/orders.parquet")
    assert recipe_table(spark, scratch).count() == before + 3


def test_seeded_sample_does_not_depend_on_partitions(spark):
    from larder.operators.batch import select_rows

    df = spark.range(2000).selectExpr("cast(id as string) AS recipe_id")
    picks = [[r.recipe_id for r in select_rows(df.repartition(n), 25).collect()] for n in (1, 7, 200)]
    assert picks[0] == picks[1] == picks[2] and len(set(picks[0])) == 25
    assert set(picks[0]) != {r.recipe_id for r in select_rows(df, 25, seed=7).collect()}
