"""Diet classifier: hand-made cases and a brute-force comparison."""

import random
import re

import pytest
from pyspark.sql import functions as F

from larder.plans import classify as C
from larder.plans.diet_rules import DIETS

NUT = "array<struct<name:string,quantity:string>>"


def classify(spark, rows):
    df = spark.createDataFrame(rows, f"recipe_id string, ingredients array<string>, nutrients {NUT}, tags array<string>")
    out = C.classify_rules(df).collect()
    return {(r.recipe_id, r.diet): r for r in out}


@pytest.fixture(scope="module")
def cases(spark):
    rows = [
        ("first_hit", ["almond milk", "beef"], [], None),
        ("safe", ["almond milk"], [], None),
        ("safe_hides", ["almond milk", "whole milk"], [], None),
        ("plural", ["2 eggs"], [], None),
        ("whole_word", ["eggplant"], [], None),
        ("empty", [], [], None),
        ("nutrient", [], [("carbohydrateContent", "45.2g")], None),
        ("block_first", ["sugar"], [("carbohydrateContent", "1g")], None),
        ("upper", ["msg"], [], None),
        ("null_list", None, None, None),
        ("bad_number", [], [("carbohydrateContent", "1.2.3g")], None),
    ]
    return classify(spark, rows)


def test_first_hit_decides(cases):
    r = cases[("first_hit", "vegan")]
    assert (r.applies, r.confidence, r.method, r.reason) == (False, 0.92, "rules", "Contains 'beef'")


def test_safe_compound(cases):
    r = cases[("safe", "vegan")]
    assert r.applies is None and r.confidence == 0.45 and r.method == "uncertain"
    assert r.reason.startswith("'milk' found")


def test_safe_compound_hides_real_hit(cases):
    r = cases[("safe_hides", "dairy-free")]
    assert r.applies is None and r.confidence == 0.45


def test_plural_and_whole_word(cases):
    assert (cases[("plural", "vegan")].applies, cases[("plural", "vegan")].confidence) == (True, 0.85)
    assert cases[("plural", "egg-free")].applies is False  # "eggs" is listed for egg-free
    assert (cases[("whole_word", "vegan")].applies, cases[("whole_word", "vegan")].confidence) == (True, 0.85)


def test_empty_and_null_lists(cases):
    for rid in ("empty", "null_list"):
        assert (cases[(rid, "vegan")].applies, cases[(rid, "vegan")].confidence) == (True, 0.85)
        r = cases[(rid, "high-protein")]
        assert r.applies is None and r.confidence == 0.40


def test_nutrient_rule(cases):
    r = cases[("nutrient", "low-carb")]
    assert (r.applies, r.confidence, r.method) == (True, 0.90, "nutrients")
    assert r.reason == "carbohydrate = 45.2g (✓ below 50.0g threshold)"
    assert cases[("nutrient", "keto")].applies is False  # 45.2 > 20


def test_blocklist_before_nutrients(cases):
    r = cases[("block_first", "keto")]
    assert (r.applies, r.confidence, r.reason) == (False, 0.92, "Contains 'sugar'")


def test_upper_case_term_never_fires(cases):
    assert cases[("upper", "whole30")].applies is True


def test_unparsable_number_is_null(cases):
    r = cases[("bad_number", "low-carb")]
    assert r.applies is None and r.confidence == 0.40


def test_merge_and_new_tags(spark):
    df = spark.createDataFrame([(["b", "a", "b"], ["a", "c"])], "tags array<string>, new array<string>")
    assert df.select(C.merge_tags(F.col("tags"), F.col("new"))).first()[0] == ["b", "a", "c"]


# ---- brute force over random lists, from token sets and character neighbourhoods ----------

def stands_alone(term, text, tokens):
    """Whether the term occurs with no word character running on at either end."""
    if term in tokens:
        return True
    word = lambda c: bool(c) and (c.isalnum() or c == "_")
    starts = [k for k in range(len(text) - len(term) + 1) if text.startswith(term, k)]
    return any(word(text[k - 1] if k else "") != word(term[0])
               and word(text[k + len(term):k + len(term) + 1]) != word(term[-1]) for k in starts)


def expected(ingredients, nutrients):
    """(applies, confidence) by diet name."""
    text = " | ".join(ingredients).lower()
    tokens = set(re.split(r"\W+", text)) - {""}
    amounts = [(name.lower(), float(quantity[:-1])) for name, quantity in nutrients]
    out = {}
    for d in DIETS:
        listed = [t for t in d.blocklist if stands_alone(t, text, tokens)]
        sheltered = [s for s in map(str.lower, d.safe_compounds) if listed and listed[0].lower() in s and s in text]
        grams = [g for n, g in amounts if d.nutrient_rule and d.nutrient_rule.field in n][:1]
        passes = [g < d.nutrient_rule.value if d.nutrient_rule.op == "lt" else g > d.nutrient_rule.value for g in grams]
        verdicts = [(None, 0.45)] * bool(sheltered) + [(False, 0.92)] * bool(listed) + [(p, 0.90) for p in passes]
        out[d.name] = (verdicts + [(True, 0.85) if d.blocklist else (None, 0.40)])[0]
    return out


def test_matches_plain_python(spark):
    rng = random.Random(7)
    vocab = sorted({t for d in DIETS for t in d.blocklist} | {s for d in DIETS for s in d.safe_compounds}
                   | {"eggs", "eggplant", "2 cups flour", "fresh basil", "water", "salted butter", "soy sauce"})
    names = ["carbohydrateContent", "proteinContent", "fatContent", "saturatedFatContent", "sugarContent",
             "sodiumContent"]
    rows = []
    for i in range(300):
        ings = [rng.choice(vocab) + rng.choice(["", "s", " chopped"]) for _ in range(rng.randint(0, 5))]
        nuts = [(rng.choice(names), f"{rng.randint(0, 900) / 10}g") for _ in range(rng.randint(0, 3))]
        rows.append((str(i), ings, nuts, None))
    got = classify(spark, rows)
    for rid, ings, nuts, _ in rows:
        for name, want in expected(ings, nuts).items():
            r = got[(rid, name)]
            assert (r.applies, r.confidence) == want, (rid, ings, nuts, name)


def test_lean_results_agree(spark):
    df = spark.createDataFrame([("a", ["almond milk", "beef"], []), ("b", None, None)], f"recipe_id string, ingredients array<string>, nutrients {NUT}")
    full, lean = (C.with_classification(df, reasons=r).orderBy("recipe_id").collect() for r in (True, False))
    for x, y in zip(full, lean):
        assert x.new_tags == y.new_tags
        assert [(r.diet, r.applies, r.confidence) for r in x.results] == [(r.diet, r.applies, r.confidence) for r in y.results]
