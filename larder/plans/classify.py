"""Rule-based diet classification as one projection.

Per (recipe, diet) the first matching rule wins:
1. blocklist terms in list order, whole-word match in the lower-cased
   ``" | "``-joined ingredient text; the first hit decides. If a safe compound
   of the diet that contains the hit term occurs anywhere in the text the
   result is uncertain (0.45), otherwise blocked (0.92).
2. no hit -> applies (0.85), unless a nutrient rule finds a value (0.90).
3. no blocklist: nutrient value decides, else uncertain (0.40).

The whole classification is a map-only stage: no shuffle, no join, no skew exposure, and the result rides along the
input rows, so tag merging needs no join back (see ``with_classification``).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import first_number, fmt_1dp
from larder.plans.diet_rules import (
    APPLY_THRESHOLD,
    DIETS,
    UNCERTAINTY_THRESHOLD,
    Diet,
    all_terms,
    safe_for_term,
    threshold_text,
)

# The reasons of the results
REASON_SAFE = "' found but may be a safe compound — needs LLM review"
REASON_NO_HIT = "No disqualifying ingredients found"
REASON_NO_NUTRIENT = "Nutrient data unavailable for threshold check"
REASON_NO_RULES = "No rules configured for this diet"


def ingredient_text(ingredients: Column) -> Column:
    """Lower-cased ``" | "`` join; null list -> "" (null elements are skipped)."""
    return F.lower(F.array_join(F.coalesce(ingredients, F.array().cast("array<string>")), " | "))


def word_pattern(term: str) -> str:
    """Whole-word, literal, Unicode-aware pattern for a term."""
    return r"(?U)\b\Q" + term + r"\E\b"


def nutrient_value(nutrients: Column, field: str) -> Column:
    """Number in the quantity of the first nutrient whose name contains ``field``.

    Only the first matching nutrient is looked at; a quantity without a
    parsable number gives null (no second try).
    """
    first = F.get(F.filter(F.coalesce(nutrients, F.array().cast("array<struct<name:string,quantity:string>>")),
                           lambda n: F.coalesce(F.instr(F.lower(n["name"]), field.lower()) > 0, F.lit(False))), 0)
    return first_number(first["quantity"])


def _result(diet: str, applies, confidence: float, method: str, reason: Column | str, reasons: bool) -> Column:
    fields = [
        F.lit(diet).alias("diet"),
        (applies if isinstance(applies, Column) else F.lit(applies).cast("boolean")).alias("applies"),
        F.lit(confidence).cast("double").alias("confidence"),
    ]
    if reasons:
        fields += [F.lit(method).alias("method"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason")]
    return F.struct(*fields)


def _fields(diets) -> list[str]:
    return list(dict.fromkeys(d.nutrient_rule.field for d in diets if d.nutrient_rule))


NO_HIT = 1 << 20


def positions(term: str, diets=DIETS) -> list[int]:
    """1-based position of a term in every diet's blocklist (``NO_HIT`` = not listed)."""
    return [d.blocklist.index(term) + 1 if term in d.blocklist else NO_HIT for d in diets]


def first_word(term: str) -> str:
    return re.split(r"\W+", term)[0]


BUCKETS = 512


def word_bucket(first: int | Column, length: int | Column) -> int | Column:
    """Place of a word in the constant index, by its first letter and its length."""
    return (first + length * 61) % BUCKETS


def term_index(terms: list[str], diets=DIETS) -> Column:
    """Constant array of ``BUCKETS`` lists of (word, phrase, pattern, at), by ``word_bucket``: a one-word term without phrase,
    any other under the first of its words."""
    lists: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for t in terms:
        word = first_word(t)
        own = {} if t == word else {"phrase": t, "pattern": word_pattern(t)}
        lists[word_bucket(ord(word[0]), len(word))].append({"word": word, **own, "at": positions(t, diets)})
    return F.from_json(F.lit(json.dumps(lists)), "array<array<struct<word:string,phrase:string,pattern:string,at:array<int>>>>")


def _safe(d: Diet, p: Column, txt: Column) -> Column | None:
    """Whether a safe compound of the diet that holds the term at ``p`` of its blocklist is in the text, false without a hit;
    None where no term has one."""
    table = [safe_for_term(d, t) for t in d.blocklist]
    if not any(table):
        return None
    # constant place -> safe compounds containing the term there
    lookup = F.from_json(F.lit(json.dumps(table)), "array<array<string>>")
    return F.coalesce(F.exists(F.get(lookup, p - F.lit(1)), lambda sc: F.instr(txt, sc) > 0), F.lit(False))


def _undecided(d: Diet, i: int, first: Column, nv_array: Column, txt: Column, fields: list[str]) -> Column | None:
    """Whether the result of diet ``d`` (see ``_diet_expr``) has no decision and less than the threshold's confidence; None
    if it never has."""
    rule = d.nutrient_rule
    if not d.blocklist:
        return F.get(nv_array, F.lit(fields.index(rule.field))).isNull() if rule is not None else F.lit(True)
    p = F.get(first, F.lit(i))
    safe = _safe(d, p, txt)
    return None if safe is None else F.when(p < F.lit(NO_HIT), safe).otherwise(F.lit(False))


def _diet_expr(d: Diet, i: int, first: Column, nv_array: Column, txt: Column, fields: list[str],
               reasons: bool) -> tuple[Column, Column]:
    """Codegen-friendly (result struct, whether it gives the tag) of diet ``d`` (rule order ``i``) from the
    fenced per-row columns: first-hit positions, nutrient values and text.
    Static rule properties are resolved here, so each diet is a short
    ``when`` chain over literals and attribute references."""
    chain = tag = None

    def add(cond: Column, value: Column, applies: Column):
        nonlocal chain, tag
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
        tag = F.when(cond, applies) if tag is None else tag.when(cond, applies)

    def tagged(applies, confidence: float) -> Column:
        return F.lit(bool(applies) and confidence >= APPLY_THRESHOLD) if not isinstance(applies, Column) else (
            applies if confidence >= APPLY_THRESHOLD else F.lit(False))

    default, applies = None, F.lit(False)
    if d.blocklist:
        p = F.get(first, F.lit(i))
        fh = F.when(p < F.lit(NO_HIT), F.element_at(F.array(*[F.lit(t) for t in d.blocklist]), p))
        safe = _safe(d, p, txt)
        if safe is not None:  # tested only when the diet has a hit
            # either way no tag, so the tag's chain does without the test
            chain = F.when(fh.isNotNull() & safe,
                           _result(d.name, None, 0.45, "uncertain", F.concat(F.lit("'"), fh, F.lit(REASON_SAFE)), reasons))
        add(p < F.lit(NO_HIT), _result(d.name, False, 0.92, "rules", F.concat(F.lit("Contains '"), fh, F.lit("'")), reasons),
            tagged(False, 0.92))
        default = _result(d.name, True, 0.85, "rules", REASON_NO_HIT, reasons)
        applies = tagged(True, 0.85)
    rule = d.nutrient_rule
    if rule is not None:
        v = F.get(nv_array, F.lit(fields.index(rule.field)))
        passes = (v < F.lit(rule.value)) if rule.op == "lt" else (v > F.lit(rule.value))
        direction = "below" if rule.op == "lt" else "above"
        reason = F.concat(F.lit(f"{rule.field} = "), fmt_1dp(v), F.lit("g ("),
                          F.when(passes, F.lit("✓")).otherwise(F.lit("✗")),
                          F.lit(f" {direction} {threshold_text(rule.value)}g threshold)"))
        add(v.isNotNull(), _result(d.name, passes, 0.90, "nutrients", reason, reasons), tagged(passes, 0.90))
        if default is None:
            default = _result(d.name, None, 0.40, "uncertain", REASON_NO_NUTRIENT, reasons)
    if default is None:
        default = _result(d.name, None, 0.40, "uncertain", REASON_NO_RULES, reasons)
    return (default if chain is None else chain.otherwise(default)), (applies if tag is None else tag.otherwise(applies))


def with_classification(df: DataFrame, diets=DIETS, ingredients: str = "ingredients",
                        nutrients: str = "nutrients", reasons: bool = True, undecided: bool = False) -> DataFrame:
    """Adds ``results`` (array of per-diet structs) and ``new_tags``. Without ``reasons`` a result is only (diet, applies,
    confidence), which is all that summaries and tag writing need. With ``undecided`` the diets that need a review are a
    column of that name, in rule order, made without the results.

    Plan, per row and without shuffle:
    1. ingredient text, split once into word tokens (``(?U)\\W+``, the word definition of the ``(?U)\\b`` boundaries);
    2. a term of one word occurs as a whole word exactly when it is a token. Any other term can occur only where its first
       word is a token. So only tokens that begin a term (one hash-set test each) are looked up in a constant index, and
       only their phrases are tested, as substrings before the pattern;
    3. the hits' constant blocklist positions give each diet's first hit (``NO_HIT`` when none);
    4. a one-row ``inline`` generate fences these columns, so a later filter on ``results``/``new_tags`` is not pushed down
       into the per-row work;
    5. each diet is a short generated ``when`` chain over the fenced columns: its first hit is ``block[_first[i]]``, and safe
       compounds are substring-tested only when the diet has a hit. ``new_tags`` has chains of its own, without them;
    6. ``undecided`` has one test a diet and lies behind the fence, so that a filter on it does not make it twice.
    """
    terms = all_terms(diets)
    heads = list(dict.fromkeys(map(first_word, terms)))
    if "" in heads:
        raise ValueError("a blocklist term must begin with a word character")
    index = term_index(terms, diets)
    fields = _fields(diets)
    base = df.columns
    staged = df.withColumn("_txt", ingredient_text(F.col(ingredients)))
    staged = staged.withColumns({
        "_tok": F.split(F.col("_txt"), r"(?U)\W+"),
        **{f"_nv_{f}": nutrient_value(F.col(nutrients), f) for f in fields},
    })
    staged = staged.withColumn("_tok", F.array_distinct(F.filter("_tok", lambda w: w.isin(heads))))
    txt = F.col("_txt")
    hits = F.flatten(F.transform("_tok", lambda w: F.filter(
        F.get(index, word_bucket(F.ascii(w), F.length(w))),
        lambda x: (x["word"] == w) & (x["phrase"].isNull() | ((F.instr(txt, x["phrase"]) > 0) & F.rlike(txt, x["pattern"]))))))
    staged = staged.withColumn("_hits", hits)
    staged = staged.withColumn("_first", F.aggregate(
        "_hits", F.array_repeat(F.lit(NO_HIT), len(diets)),
        lambda acc, c: F.zip_with(acc, c["at"], lambda a, b: F.least(a, b))))
    staged = staged.withColumn("_nv", F.array(*[F.col(f"_nv_{f}") for f in fields]).cast("array<double>"))
    keep = [*base, "_txt", "_first", "_nv"]
    if undecided:
        tests = ((d.name, _undecided(d, i, F.col("_first"), F.col("_nv"), F.col("_txt"), fields)) for i, d in enumerate(diets))
        open_ = F.array(*(F.when(test, F.lit(name)).otherwise(F.lit("")) for name, test in tests if test is not None))
        staged = staged.withColumn("undecided", F.filter(open_.cast("array<string>"), lambda t: t != ""))
        keep.insert(len(base), "undecided")
        base = keep[:len(base) + 1]
    fenced = staged.select(F.inline(F.array(F.struct(*[F.col(c) for c in keep]))))
    made = [_diet_expr(d, i, F.col("_first"), F.col("_nv"), F.col("_txt"), fields, reasons) for i, d in enumerate(diets)]
    # an empty text marks a diet that gives no tag; the lambda keeps the chains out of one method too large to be compiled
    tags = F.array(*(F.when(tag, F.lit(d.name)).otherwise(F.lit("")) for d, (_, tag) in zip(diets, made)))
    return fenced.withColumns({"results": F.array(*(result for result, _ in made)), "new_tags": F.filter(tags, lambda t: t != "")}).drop(
        *keep[len(base):])


def classify_rules(recipes: DataFrame, diets=DIETS) -> DataFrame:
    """Long table: one row per (recipe, diet) with the rule result."""
    c = with_classification(recipes.select("recipe_id", "ingredients", "nutrients"), diets)
    return c.select("recipe_id", F.posexplode_outer("results").alias("diet_order", "r")).select(
        "recipe_id", "r.diet", "r.applies", "r.confidence", "r.method", "r.reason")


def uncertain_pairs(classified_long: DataFrame) -> DataFrame:
    """(recipe, diet) pairs with no decision and confidence below 0.90."""
    return classified_long.filter(F.col("applies").isNull() & (F.col("confidence") < UNCERTAINTY_THRESHOLD))


def merge_tags(tags: Column, new: Column) -> Column:
    """Existing tags then the new ones, de-duplicated, first occurrence order."""
    return F.array_distinct(F.concat(F.coalesce(tags, F.array().cast("array<string>")), new))


def tag_update(classified: DataFrame) -> DataFrame:
    """Rows that receive new tags: (recipe_id, tags, merged_tags, changed).

    Only rows with new tags are touched; ``changed`` marks rows whose list
    actually differs. No join: the classification rides on the same rows.
    """
    return classified.filter(F.size("new_tags") > 0).select(
        "recipe_id", "tags", merge_tags(F.col("tags"), F.col("new_tags")).alias("merged_tags")
    ).withColumn("changed", F.col("merged_tags") != F.coalesce(F.col("tags"), F.array().cast("array<string>")))


def diet_summary(classified: DataFrame, diets=DIETS) -> DataFrame:
    """Per diet: tagged, still uncertain, percent of total; zero-filled, rule order.

    One global aggregate of 2 x 24 conditional counts (map-side partials, a
    single tiny shuffle) then an unpivot; no explode of the 24x long table.
    Also carries ``recipes_with_tags`` and ``total``.
    """
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.size("new_tags") > 0).alias("recipes_with_tags")]
    for i, d in enumerate(diets):
        r = F.col("results")[i]
        aggs.append(F.count_if(F.coalesce(r["applies"], F.lit(False)) & (r["confidence"] >= APPLY_THRESHOLD))
                    .alias(f"t{i}"))
        aggs.append(F.count_if(r["applies"].isNull()).alias(f"u{i}"))
    wide = classified.agg(*aggs)
    stack = F.inline(F.array(*[
        F.struct(F.lit(i).alias("diet_order"), F.lit(d.name).alias("diet"),
                 F.col(f"t{i}").alias("tagged"), F.col(f"u{i}").alias("uncertain"))
        for i, d in enumerate(diets)]))
    return wide.select("total", "recipes_with_tags", stack).select(
        "diet_order", "diet", "tagged", "uncertain",
        F.when(F.col("total") > 0, F.col("tagged") / F.col("total") * 100).alias("pct_of_total"),
        "recipes_with_tags", "total")
