"""DuckDB oracle SQL for every ``queries()`` entry.

Each query is an independent restatement of the Spark plan in SQL over the
driver's pre-registered views. The recipe view is re-derived here in SQL
(``RECIPES_CTE``); rule data (diet lists) are shared parameters, the logic is
written separately.
"""

from __future__ import annotations

from larder.plans.diet_rules import DIETS, threshold_text
from larder.sources import recipe_view as rv


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


_ADJ = "split_part(p_name, ' ', 1)"
_NOUN = "string_split(p_name, ' ')[-1]"
_ORDER = "ORDER BY l_linenumber, l_partkey, l_quantity"

RECIPES_CTE = f"""
_part AS (
  SELECT p_partkey,
         coalesce({_case(_ADJ, rv.ADJECTIVE_MODIFIER)}, {_ADJ}) || ' ' ||
         coalesce({_case(_NOUN, rv.NOUN_FOOD)}, {_NOUN}) AS food,
         coalesce({_case('p_type', rv.TYPE_NUTRIENT)}, p_type) AS nutrient_name
  FROM part),
_lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, food, nutrient_name
  FROM lineitem JOIN _part ON l_partkey = p_partkey),
_per_order AS (
  SELECT l_orderkey,
         list(food {_ORDER}) AS ingredients,
         list({{'name': nutrient_name, 'quantity': CAST(l_quantity AS VARCHAR) || 'g'}} {_ORDER}) AS nutrients,
         list({{'quantity': l_quantity, 'unit': 'g', 'displayString': food,
                'foodCodes': {{'ingredientID': CAST(l_partkey AS VARCHAR)}}}} {_ORDER}) AS procesedIngredients,
         CAST(count(*) AS INTEGER) AS n_lines
  FROM _lines GROUP BY l_orderkey),
_orders AS (
  SELECT o.*, p.*, {_case('o_orderpriority', rv.PRIORITY_MEAL)} AS meal,
         p.n_lines * 15 AS cook, CAST(day(o_orderdate) AS INTEGER) AS prep,
         CAST(o_orderkey AS VARCHAR) AS rid
  FROM orders o LEFT JOIN _per_order p ON o.o_orderkey = p.l_orderkey),
recipes AS (
  SELECT rid AS recipe_id,
         ingredients[1] AS title,
         CASE WHEN n_lines IS NOT NULL THEN 'A ' || meal || ' of ' || CAST(n_lines AS VARCHAR) || ' ingredients'
              ELSE '' END AS description,
         {_q(rv.RECIPE_URL_PREFIX)} || rid AS url,
         'recipes.example.com' AS host,
         CASE WHEN o_orderstatus <> 'P' THEN {_q(rv.IMAGE_URL_PREFIX)} || rid || '.jpg' END AS image,
         CAST(NULL AS VARCHAR) AS author,
         CASE WHEN o_orderstatus <> 'O' THEN md5(rid) END AS uuid,
         CASE WHEN n_lines IS NOT NULL THEN
              ['Combine ' || array_to_string(ingredients, ', ') || '.',
               'Cook for ' || CAST(cook AS VARCHAR) || ' minutes.']
              || CASE WHEN o_orderstatus <> 'O' THEN ['Garnish with ' || ingredients[1] || ' and serve.']
                      ELSE []::VARCHAR[] END
         END AS instructions,
         ingredients,
         procesedIngredients,
         CASE WHEN n_lines IS NULL THEN NULL
              WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN []::VARCHAR[]
              ELSE [meal, {_case('o_orderstatus', rv.STATUS_TAG)}] END AS tags,
         {_case('o_orderstatus', rv.STATUS_METHOD)} AS cookingMethod,
         nutrients,
         o_totalprice / 5000.0::DOUBLE AS healthScore,
         {_case('o_orderpriority', rv.PRIORITY_GRADE)} AS healthGrade,
         CASE WHEN n_lines IS NOT NULL THEN CAST(n_lines AS VARCHAR) || '-' || CAST(n_lines + 2 AS VARCHAR)
              || ' servings' END AS numServings,
         CAST(cook AS INTEGER) AS cookTime,
         prep AS prepTime,
         CAST(cook + prep AS INTEGER) AS totalTime,
         (o_custkey % 50) / 10.0::DOUBLE AS ratings,
         CAST(o_custkey % 1000 AS INTEGER) AS ratingsCount,
         CAST(month(o_orderdate) AS INTEGER) AS cluster_id
  FROM _orders)
"""


def with_recipes(body: str, extra_ctes: str = "") -> str:
    """``WITH <recipe view>[, extra] <body>``."""
    ctes = RECIPES_CTE + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


# ---- diet classifier, restated relationally --------------------------------------------

def _rule_ctes() -> str:
    terms = ", ".join(f"({_q(d.name)}, {i}, {_q(t)}, {j})"
                      for i, d in enumerate(DIETS) for j, t in enumerate(d.blocklist))
    safes = ", ".join(f"({_q(d.name)}, {_q(s.lower())})" for d in DIETS for s in d.safe_compounds)
    diets = ", ".join(
        "{" + f"'diet': {_q(d.name)}, 'diet_order': {i}, 'has_block': {str(bool(d.blocklist)).lower()}, "
        f"'nfield': {_q(d.nutrient_rule.field) if d.nutrient_rule else 'NULL'}, "
        f"'nop': {_q(d.nutrient_rule.op) if d.nutrient_rule else 'NULL'}, "
        f"'nval': {repr(d.nutrient_rule.value) + '::DOUBLE' if d.nutrient_rule else 'NULL'}, "
        f"'ntext': {_q(threshold_text(d.nutrient_rule.value)) if d.nutrient_rule else 'NULL'}" + "}"
        for i, d in enumerate(DIETS))
    fields = sorted({d.nutrient_rule.field for d in DIETS if d.nutrient_rule})
    nv = ",\n         ".join(
        f"TRY_CAST(nullif(regexp_extract(list_filter(nutrients, lambda n: contains(lower(n.name), {_q(f)}))[1].quantity,"
        f" '[0-9.]+'), '') AS DOUBLE) AS nv_{f}" for f in fields)
    pick_nv = "CASE d.nfield " + " ".join(f"WHEN {_q(f)} THEN x.nv_{f}" for f in fields) + " END"
    return f"""
_terms(diet, diet_order, term, term_order) AS (VALUES {terms}),
_safe(diet, safe) AS (VALUES {safes}),
_txt AS (
  SELECT recipe_id, lower(array_to_string(coalesce(ingredients, []::VARCHAR[]), ' | ')) AS txt,
         {nv}
  FROM recipes),
_first AS (
  SELECT x.recipe_id, t.diet, arg_min(t.term, t.term_order) AS first_hit
  FROM _txt x JOIN _terms t
    ON contains(x.txt, t.term) AND regexp_matches(x.txt, '\\b' || regexp_escape(t.term) || '\\b')
  GROUP BY x.recipe_id, t.diet),
_pairs AS (
  SELECT x.*, unnest([{diets}], recursive := true) FROM _txt x),
_eval AS (
  SELECT p.recipe_id, p.diet, p.diet_order, p.has_block, p.nfield, p.nop, p.ntext, f.first_hit,
         EXISTS (SELECT 1 FROM _safe s WHERE s.diet = p.diet AND contains(s.safe, lower(f.first_hit))
                 AND contains(p.txt, s.safe)) AS safe_hit,
         {pick_nv.replace('d.nfield', 'p.nfield').replace('x.nv_', 'p.nv_')} AS nv,
         p.nval
  FROM _pairs p LEFT JOIN _first f ON f.recipe_id = p.recipe_id AND f.diet = p.diet),
classified AS (
  SELECT recipe_id, diet, diet_order,
    CASE WHEN first_hit IS NOT NULL AND safe_hit THEN NULL
         WHEN first_hit IS NOT NULL THEN false
         WHEN nv IS NOT NULL THEN CASE WHEN nop = 'lt' THEN nv < nval ELSE nv > nval END
         WHEN has_block THEN true
         ELSE NULL END AS applies,
    CASE WHEN first_hit IS NOT NULL AND safe_hit THEN 0.45
         WHEN first_hit IS NOT NULL THEN 0.92
         WHEN nv IS NOT NULL THEN 0.90
         WHEN has_block THEN 0.85
         ELSE 0.40 END::DOUBLE AS confidence,
    CASE WHEN first_hit IS NOT NULL AND safe_hit THEN 'uncertain'
         WHEN first_hit IS NOT NULL THEN 'rules'
         WHEN nv IS NOT NULL THEN 'nutrients'
         WHEN has_block THEN 'rules'
         ELSE 'uncertain' END AS method,
    CASE WHEN first_hit IS NOT NULL AND safe_hit
              THEN '''' || first_hit || ''' found but may be a safe compound — needs LLM review'
         WHEN first_hit IS NOT NULL THEN 'Contains ''' || first_hit || ''''
         WHEN nv IS NOT NULL THEN nfield || ' = ' || printf('%.1f', nv) || 'g ('
              || CASE WHEN (CASE WHEN nop = 'lt' THEN nv < nval ELSE nv > nval END) THEN '✓' ELSE '✗' END
              || CASE WHEN nop = 'lt' THEN ' below ' ELSE ' above ' END || ntext || 'g threshold)'
         WHEN has_block THEN 'No disqualifying ingredients found'
         WHEN nfield IS NOT NULL THEN 'Nutrient data unavailable for threshold check'
         ELSE 'No rules configured for this diet' END AS reason
  FROM _eval)"""


def classified_sql(body: str) -> str:
    """SQL over the recipe view with a ``classified`` long table in scope."""
    return with_recipes(body, _rule_ctes())


def _new_tags_cte() -> str:
    return """
_new AS (
  SELECT recipe_id, list(diet ORDER BY diet_order) FILTER (WHERE applies AND confidence >= 0.75) AS new_tags
  FROM classified GROUP BY recipe_id)"""


SQL: dict[str, str] = {}

SQL["classify_rules"] = classified_sql(
    "SELECT recipe_id, diet, applies, confidence, method, reason FROM classified")

SQL["diet_summary"] = classified_sql("""
SELECT diet_order, diet,
       count(*) FILTER (WHERE applies AND confidence >= 0.75) AS tagged,
       count(*) FILTER (WHERE applies IS NULL) AS uncertain,
       count(*) FILTER (WHERE applies AND confidence >= 0.75) / (SELECT count(*) FROM recipes) * 100 AS pct_of_total,
       (SELECT count(DISTINCT recipe_id) FROM classified WHERE applies AND confidence >= 0.75) AS recipes_with_tags,
       (SELECT count(*) FROM recipes) AS total
FROM classified GROUP BY diet_order, diet""")


# ---- mapped / published / status views in SQL ---------------------------------------------

MAPPED_CTE = """
mapped AS (
  SELECT recipe_id AS id, uuid, coalesce(nullif(title, ''), 'Unknown') AS title, description, url, host, image, author,
         coalesce(instructions, []::VARCHAR[]) AS instructions,
         CASE WHEN len(coalesce(ingredients, []::VARCHAR[])) > 0 THEN ingredients
              ELSE coalesce(list_filter(list_transform(procesedIngredients, lambda i: i.displayString),
                                        lambda s: s IS NOT NULL AND s <> ''), []::VARCHAR[]) END AS ingredientStrings,
         coalesce(procesedIngredients, []) AS ingredients,
         coalesce(tags, []::VARCHAR[]) AS tags,
         cookingMethod, coalesce(nutrients, []) AS nutrients, healthScore, healthGrade,
         TRY_CAST(nullif(regexp_extract(numServings, '\\d+\\.?\\d*'), '') AS DOUBLE) AS numServings,
         cookTime, prepTime, totalTime, ratings, ratingsCount, cluster_id,
         'discover' AS channel
  FROM recipes),
published AS (
  SELECT m.* EXCLUDE (tags, cluster_id),
         m.tags[1:greatest(len(m.tags) - 1, 0)] AS tags,
         coalesce(CAST(e.embedding AS DOUBLE[]), []::DOUBLE[]) AS embedding,
         CAST(e.label AS INTEGER) AS cluster_id
  FROM mapped m LEFT JOIN embeddings e ON m.id = CAST(e.vec_id AS VARCHAR)
  WHERE m.uuid IS NOT NULL AND m.image IS NOT NULL),
status AS (
  SELECT recipe_id, (uuid IS NOT NULL AND image IS NOT NULL) AS uploaded,
         coalesce(healthGrade = 'F' AND image IS NULL, false) AS bad
  FROM recipes),
validated AS (
  SELECT *, concat_ws('; ',
      CASE WHEN id IS NULL OR id = '' THEN 'id is required' END,
      CASE WHEN uuid IS NULL OR uuid = '' THEN 'uuid is required' END,
      CASE WHEN title IS NULL OR title = '' THEN 'title is required' END,
      CASE WHEN len(ingredients) = 0 THEN 'ingredients are required structured' END,
      CASE WHEN len(ingredientStrings) = 0 THEN 'ingredient strings are required' END,
      CASE WHEN len(nutrients) = 0 THEN 'nutrients are required' END) AS error
  FROM mapped)"""


def with_mapped(body: str) -> str:
    return with_recipes(body, MAPPED_CTE)


DIET_LIST = "(" + ", ".join(_q(d.name) for d in DIETS) + ")"

SQL["scan_projection"] = with_recipes("SELECT recipe_id, title, healthScore FROM recipes")
SQL["status_defaults"] = with_recipes("SELECT recipe_id, title, false AS uploaded, false AS bad FROM recipes")
SQL["preview"] = with_recipes("""
SELECT recipe_id, substring(coalesce(title, ''), 1, 50) AS title, coalesce(healthGrade, '-') AS grade,
       CASE WHEN coalesce(cookTime, 0) <> 0 THEN CAST(cookTime AS VARCHAR) || ' min' ELSE '-' END AS cook,
       CASE WHEN coalesce(ratings, 0) <> 0 THEN printf('%.1f', ratings) ELSE '-' END AS rating
FROM recipes""")
SQL["batch_head"] = with_recipes(
    "SELECT recipe_id, title, healthGrade FROM recipes WHERE healthGrade = 'A' ORDER BY recipe_id LIMIT 10")

_P = "SELECT recipe_id, title, healthGrade, healthScore FROM recipes WHERE "
SQL["filter_eq"] = with_recipes(_P + "healthGrade = 'A'")
SQL["filter_ne"] = with_recipes(_P + "healthGrade <> 'A'")
SQL["filter_lt"] = with_recipes(_P + "healthScore < 30")
SQL["filter_lte"] = with_recipes(_P + "healthScore <= 30")
SQL["filter_gt"] = with_recipes(_P + "healthScore > 70")
SQL["filter_gte"] = with_recipes(_P + "healthScore >= 70")
SQL["filter_in"] = with_recipes("SELECT recipe_id, cluster_id FROM recipes WHERE cluster_id IN (1, 2, 3)")
SQL["filter_contains_ci"] = with_recipes(_P + "regexp_matches(title, 'ALMOND (milk|flour)', 'i')")
SQL["filter_contains_cs"] = with_recipes(_P + "regexp_matches(title, '^white')")
SQL["list_any_contains"] = with_recipes(
    _P + "len(list_filter(ingredients, lambda x: regexp_matches(x, 'soy sauce$', 'i'))) > 0")
SQL["filter_conjunction"] = with_recipes("""
SELECT recipe_id, title, healthGrade, cookTime, ratings FROM recipes
WHERE healthGrade = 'B' AND cookTime <= 60 AND ratings >= 2.5
  AND len(list_filter(ingredients, lambda x: regexp_matches(x, 'rice', 'i'))) > 0""")
SQL["filter_join_combined"] = with_recipes("""
SELECT l.recipe_id, l.title, l.healthScore, l.cluster_id,
       r.title AS title_right, r.healthScore AS healthScore_right, r.cluster_id AS cluster_id_right
FROM (SELECT * FROM recipes WHERE regexp_matches(title, 'rice', 'i')) l
JOIN (SELECT * FROM recipes WHERE healthScore > 50) r ON l.recipe_id = r.recipe_id""")
SQL["status_ids"] = with_mapped("SELECT recipe_id FROM status WHERE bad")
SQL["any_diet_tag"] = with_recipes(
    f"SELECT recipe_id FROM recipes WHERE len(list_filter(tags, lambda t: t IN {DIET_LIST})) > 0")
SQL["skip_tagged"] = with_recipes(
    f"SELECT recipe_id FROM recipes WHERE tags IS NOT NULL AND NOT len(list_filter(tags, lambda t: t IN {DIET_LIST})) > 0")

SQL["total_recipes"] = with_recipes("SELECT count(*) AS total_recipes FROM recipes")
SQL["count_by_cluster"] = with_recipes("SELECT cluster_id, count(*) AS count FROM recipes GROUP BY cluster_id")
SQL["count_by_grade"] = with_recipes("SELECT healthGrade, count(*) AS count FROM recipes GROUP BY healthGrade")
SQL["distinct_ingredients"] = with_recipes("""
SELECT count(DISTINCT x) + max(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS unique_ingredients_count
FROM (SELECT unnest(CASE WHEN len(coalesce(ingredients, []::VARCHAR[])) = 0 THEN [NULL::VARCHAR] ELSE ingredients END) AS x
      FROM recipes)""")
SQL["grade_distribution"] = with_recipes("""
SELECT g.grade, coalesce(c.n, 0) AS count, coalesce(c.n, 0) / (SELECT count(*) FROM recipes) * 100 AS pct
FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('F')) g(grade)
LEFT JOIN (SELECT healthGrade, count(*) AS n FROM recipes GROUP BY healthGrade) c ON c.healthGrade = g.grade""")
SQL["tag_counts"] = with_recipes("""
SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM recipes) WHERE tag IS NOT NULL GROUP BY tag""")
SQL["tag_counts_published"] = with_mapped("""
SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM published)
WHERE tag IS NOT NULL AND tag <> '' GROUP BY tag""")
SQL["tag_distribution"] = with_mapped("""
SELECT tag, count(*) AS count, count(*) / (SELECT count(*) FROM published) * 100 AS pct
FROM (SELECT unnest(tags) AS tag FROM published) GROUP BY tag""")
SQL["ingredient_top100"] = with_mapped("""
SELECT ingredient, count(*) AS count FROM (
  SELECT regexp_replace(lower(x), '^\\s+|\\s+$', '', 'g') AS ingredient FROM (
    SELECT unnest(list_filter(list_transform(ingredients, lambda i: i.displayString),
                              lambda n: n IS NOT NULL AND n <> '')) AS x FROM published
    UNION ALL
    SELECT unnest(list_filter(ingredientStrings, lambda s: s IS NOT NULL)) AS x FROM published))
GROUP BY ingredient ORDER BY count DESC, ingredient LIMIT 100""")
SQL["nutrient_coverage"] = with_mapped("""
SELECT count(*) AS total_recipes, count(*) FILTER (WHERE len(nutrients) > 0) AS recipes_with_nutrients,
       CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE len(nutrients) > 0) / count(*) * 100 ELSE 0.0 END
         AS coverage_percent
FROM published""")
SQL["nutrient_field_counts"] = with_mapped("""
SELECT coalesce(n.name, 'unknown') AS field, count(*) AS count FROM (SELECT unnest(nutrients) AS n FROM published)
GROUP BY 1""")


def _missing_sql(table: str, fields: list[tuple[str, str]]) -> str:
    parts = []
    for name, kind in fields:
        cond = {"s": f"{name} IS NULL OR {name} = ''", "a": f"{name} IS NULL OR len({name}) = 0",
                "n": f"{name} IS NULL"}[kind]
        parts.append(f"SELECT '{name}' AS field, count(*) FILTER (WHERE {cond}) AS missing FROM {table}")
    return "\nUNION ALL ".join(parts)


SQL["missing_fields"] = with_mapped(_missing_sql("published", [
    ("title", "s"), ("instructions", "a"), ("ingredients", "a"), ("tags", "a"), ("image", "s"),
    ("description", "s"), ("numServings", "n"), ("cookTime", "n"), ("prepTime", "n")]))
SQL["missing_fields_local"] = with_recipes(_missing_sql("recipes", [
    ("title", "s"), ("instructions", "a"), ("ingredients", "a"), ("tags", "a"), ("image", "s"),
    ("description", "s"), ("numServings", "s"), ("cookTime", "n"), ("prepTime", "n")]))
SQL["coverage_audit"] = with_mapped("""
SELECT metric, count, count / (SELECT count(*) FROM published) * 100 AS pct FROM (
  SELECT 'total' AS metric, count(*) AS count FROM published
  UNION ALL SELECT 'channel_discover', count(*) FILTER (WHERE channel = 'discover') FROM published
  UNION ALL SELECT 'embedding_present', count(*) FILTER (WHERE embedding IS NOT NULL) FROM published
  UNION ALL SELECT 'embedding_valid', count(*) FILTER (WHERE len(embedding) > 0) FROM published
  UNION ALL SELECT 'cluster_present', count(*) FILTER (WHERE cluster_id IS NOT NULL) FROM published
  UNION ALL SELECT 'tags_present', count(*) FILTER (WHERE tags IS NOT NULL) FROM published
  UNION ALL SELECT 'tags_non_empty', count(*) FILTER (WHERE len(tags) > 0) FROM published)""")
SQL["tag_len_hist"] = with_mapped("""
SELECT CAST(len(tags) AS INTEGER) AS n_tags, count(*) AS count FROM published WHERE len(tags) > 0 GROUP BY 1""")
SQL["embedding_dims"] = with_mapped("""
SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS count,
       count(*) / (SELECT count(*) FROM published) * 100 AS pct
FROM published WHERE len(embedding) > 0 GROUP BY 1""")
SQL["coverage_verdict"] = with_mapped("""
SELECT total, embedding_valid, embedding_valid / total AS share,
       CASE WHEN embedding_valid = 0 THEN 'none' WHEN embedding_valid / total < 0.8 THEN 'partial'
            ELSE 'viable' END AS verdict
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE len(embedding) > 0) AS embedding_valid FROM published)""")
SQL["missing_embedding_sample"] = with_mapped("""
SELECT id, CASE WHEN embedding IS NULL THEN 'missing field' ELSE 'invalid: empty' END AS reason
FROM published WHERE NOT coalesce(len(embedding) > 0, false) ORDER BY id LIMIT 5""")
SQL["avg_score_by_cluster"] = with_recipes(
    "SELECT cluster_id, count(*) AS count, avg(healthScore) AS avg_score FROM recipes GROUP BY cluster_id")
SQL["top_score"] = with_recipes(
    "SELECT recipe_id, title, healthScore FROM recipes ORDER BY healthScore DESC NULLS LAST, recipe_id LIMIT 10")

SQL["map_recipes"] = with_mapped("""
SELECT id, title, channel, numServings, cookTime, array_to_string(tags, '|') AS tags,
       array_to_string(instructions, '|') AS instructions FROM mapped""")
SQL["map_ingredients"] = with_mapped("""
SELECT id, array_to_string(ingredientStrings, '|') AS ingredientStrings,
       CAST(len(ingredients) AS INTEGER) AS n_structured,
       array_to_string(list_transform(ingredients, lambda i: i.foodCodes.ingredientID), '|') AS ingredient_ids
FROM mapped""")
SQL["normalize_nutrients"] = with_mapped("""
SELECT id, CAST(len(nutrients) AS INTEGER) AS n,
       array_to_string(list_transform(nutrients, lambda n: n.name || '=' || n.quantity), '|') AS nutrients
FROM mapped""")
SQL["normalize_servings"] = with_recipes("""
SELECT recipe_id, numServings,
       TRY_CAST(nullif(regexp_extract(numServings, '\\d+\\.?\\d*'), '') AS DOUBLE) AS servings FROM recipes""")
SQL["validate_recipes"] = with_mapped("SELECT id, error = '' AS valid, error FROM validated")
SQL["validation_failures"] = with_mapped(
    "SELECT error, count(*) AS count FROM validated WHERE error <> '' GROUP BY error")

SQL["snapshot_ids"] = with_mapped("SELECT id FROM published")
SQL["exclude_uploaded"] = with_mapped(
    "SELECT recipe_id, title FROM recipes r WHERE NOT EXISTS (SELECT 1 FROM published p WHERE p.id = r.recipe_id)")
SQL["skipped_ids"] = with_mapped(
    "SELECT recipe_id FROM recipes r WHERE EXISTS (SELECT 1 FROM published p WHERE p.id = r.recipe_id)")
SQL["exclude_bad"] = with_mapped("""
SELECT recipe_id FROM recipes r WHERE NOT EXISTS (SELECT 1 FROM status s WHERE s.bad AND s.recipe_id = r.recipe_id)""")
SQL["mark_flag"] = with_mapped("""
SELECT recipe_id, uploaded,
       CASE WHEN recipe_id IN (SELECT recipe_id FROM recipes WHERE healthGrade = 'C') THEN true ELSE bad END AS bad
FROM status""")

_OUTCOMES = """,
_sel AS (SELECT * FROM recipes),
_bad AS (SELECT recipe_id FROM status WHERE bad),
_not_bad AS (SELECT * FROM _sel WHERE recipe_id NOT IN (SELECT recipe_id FROM _bad)),
outcomes AS (
  SELECT recipe_id, 'dropped_bad' AS outcome, '' AS error FROM _sel WHERE recipe_id IN (SELECT recipe_id FROM _bad)
  UNION ALL
  SELECT recipe_id, 'skipped', '' FROM _not_bad WHERE recipe_id IN (SELECT id FROM published)
  UNION ALL
  SELECT v.id, CASE WHEN v.error = '' THEN 'published' ELSE 'failed' END, v.error
  FROM validated v WHERE v.id IN (SELECT recipe_id FROM _not_bad) AND v.id NOT IN (SELECT id FROM published))"""


def with_outcomes(body: str) -> str:
    return with_recipes(body, MAPPED_CTE + _OUTCOMES)


SQL["publish_outcomes"] = with_outcomes("SELECT recipe_id, outcome, error FROM outcomes")
SQL["publish_summary"] = with_outcomes("""
SELECT count(*) AS selected, count(*) FILTER (WHERE outcome IN ('published', 'failed')) AS checked,
       count(*) FILTER (WHERE outcome = 'published') AS valid, count(*) FILTER (WHERE outcome = 'published') AS published,
       count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
       count(*) FILTER (WHERE outcome = 'dropped_bad') AS dropped_bad
FROM outcomes""")
SQL["upsert_by_id"] = with_outcomes("""
SELECT id, title, array_to_string(tags, '|') AS tags, channel FROM published
WHERE id NOT IN (SELECT recipe_id FROM outcomes WHERE outcome = 'published')
UNION ALL
SELECT id, title, array_to_string(tags, '|') AS tags, channel FROM mapped
WHERE id IN (SELECT recipe_id FROM outcomes WHERE outcome = 'published')""")
SQL["publish_job"] = with_outcomes("""
SELECT d.id, d.title, array_to_string(d.tags, '|') AS tags, d.channel,
       s.uploaded OR s.recipe_id IN (SELECT recipe_id FROM outcomes WHERE outcome = 'published') AS uploaded
FROM (SELECT id, title, tags, channel FROM published
      WHERE id NOT IN (SELECT recipe_id FROM outcomes WHERE outcome = 'published')
      UNION ALL
      SELECT id, title, tags, channel FROM mapped
      WHERE id IN (SELECT recipe_id FROM outcomes WHERE outcome = 'published')) d
LEFT JOIN status s ON s.recipe_id = d.id""")
SQL["collection_fields"] = with_mapped("SELECT id, title, healthGrade FROM published ORDER BY id LIMIT 100")
SQL["type_check"] = with_recipes("""
SELECT recipe_id, CASE WHEN cluster_id % 4 <> 0 THEN cookTime END AS cookTime,
       TRY_CAST(prep AS INTEGER) AS prepTime,
       CASE WHEN cluster_id % 2 <> 0 THEN totalTime END AS totalTime,
       CASE WHEN healthGrade IS DISTINCT FROM 'F' THEN healthScore END AS healthScore,
       concat_ws('; ',
         CASE WHEN cookTime IS NOT NULL AND cluster_id % 4 = 0 THEN 'cookTime: Input should be a valid integer' END,
         CASE WHEN prep IS NOT NULL AND TRY_CAST(prep AS INTEGER) IS NULL THEN 'prepTime: Input should be a valid integer' END,
         CASE WHEN totalTime IS NOT NULL AND cluster_id % 2 = 0 THEN 'totalTime: Input should be a valid integer' END,
         CASE WHEN healthGrade = 'F' THEN 'healthScore: Input should be a valid number' END) AS type_error
FROM (SELECT *, CAST(prepTime AS BIGINT) * CASE WHEN cluster_id % 3 = 0 THEN 1000000000 ELSE 1 END AS prep FROM recipes)""")
SQL["publish_status"] = with_outcomes("""
SELECT recipe_id, CASE WHEN recipe_id IN (SELECT recipe_id FROM outcomes WHERE outcome = 'published') THEN true
                       ELSE uploaded END AS uploaded, bad
FROM status""")


# ---- tags and review ----------------------------------------------------------------------

_NEW = """,
_new AS (
  SELECT recipe_id, list(diet ORDER BY diet_order) FILTER (WHERE applies AND confidence >= 0.75) AS new_tags
  FROM classified GROUP BY recipe_id),
_merge AS (
  SELECT r.recipe_id, r.title, r.tags, n.new_tags, list_concat(coalesce(r.tags, []::VARCHAR[]), n.new_tags) AS _c
  FROM recipes r JOIN _new n ON r.recipe_id = n.recipe_id WHERE len(n.new_tags) > 0),
tagged AS (
  SELECT r.recipe_id, r.title,
         CASE WHEN m._c IS NOT NULL THEN list_filter(m._c, lambda x, i: list_position(m._c, x) = i) ELSE r.tags END AS tags
  FROM recipes r LEFT JOIN _merge m ON r.recipe_id = m.recipe_id),
patched AS (
  SELECT p.id, CASE WHEN m.new_tags IS NOT NULL
                    THEN list_concat(p.tags, list_filter(m.new_tags, lambda x: NOT list_contains(p.tags, x)))
                    ELSE p.tags END AS tags
  FROM published p LEFT JOIN _merge m ON p.id = m.recipe_id)"""


def with_tags(body: str, extra: str = "") -> str:
    return with_recipes(body, _rule_ctes() + "," + MAPPED_CTE + _NEW + ("," + extra if extra else ""))


SQL["nutrient_value"] = with_recipes("SELECT recipe_id, " + ", ".join(
    f"TRY_CAST(nullif(regexp_extract(list_filter(nutrients, lambda n: contains(lower(n.name), '{f}'))[1].quantity,"
    f" '[0-9.]+'), '') AS DOUBLE) AS nv_{f}" for f in ["carbohydrate", "fat", "protein", "sodium", "sugar"])
    + " FROM recipes")
SQL["new_tags"] = with_tags("SELECT recipe_id, array_to_string(new_tags, '|') AS new_tags FROM _new WHERE len(new_tags) > 0")
SQL["merge_tags"] = with_tags("""
SELECT recipe_id, array_to_string(tags, '|') AS tags,
       array_to_string(list_filter(_c, lambda x, i: list_position(_c, x) = i), '|') AS merged_tags,
       list_filter(_c, lambda x, i: list_position(_c, x) = i) <> coalesce(tags, []::VARCHAR[]) AS changed
FROM _merge""")
SQL["uncertain_pairs"] = classified_sql(
    "SELECT recipe_id, diet, applies, confidence, method, reason FROM classified WHERE applies IS NULL AND confidence < 0.90")
SQL["tag_counts_both"] = with_mapped("""
SELECT coalesce(l.tag, p.tag) AS tag, coalesce(l.n, 0) AS local, coalesce(p.n, 0) AS published FROM
  (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM recipes) WHERE tag IS NOT NULL GROUP BY tag) l
FULL OUTER JOIN
  (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM published) WHERE tag IS NOT NULL AND tag <> ''
   GROUP BY tag) p ON l.tag = p.tag""")
_DIETS_VALUES = ", ".join(f"({i}, {_q(d.name)})" for i, d in enumerate(DIETS))
SQL["diet_distribution"] = with_tags(f"""
SELECT d.diet_order, d.diet, coalesce(c.n, 0) AS count, coalesce(c.n, 0) / (SELECT count(*) FROM tagged) * 100 AS pct,
       coalesce(s.s, '') AS sample_titles
FROM (VALUES {_DIETS_VALUES}) d(diet_order, diet) LEFT JOIN _cnt c ON c.diet = d.diet LEFT JOIN _smp s ON s.diet = d.diet""",
    f"""
_x AS (SELECT recipe_id, title, unnest(list_distinct(list_filter(tags, lambda t: t IN {DIET_LIST}))) AS diet FROM tagged),
_cnt AS (SELECT diet, count(*) AS n FROM _x GROUP BY diet),
_smp AS (SELECT diet, string_agg(title, ' | ' ORDER BY recipe_id) AS s FROM
          (SELECT *, row_number() OVER (PARTITION BY diet ORDER BY recipe_id) AS rn FROM _x) WHERE rn <= 3 GROUP BY diet)""")
SQL["patch_tags"] = with_tags("SELECT id, array_to_string(tags, '|') AS tags FROM patched")
SQL["patch_skipped"] = with_tags("SELECT recipe_id FROM _merge WHERE recipe_id NOT IN (SELECT id FROM published)")
SQL["verify_compare"] = with_tags(f"""
SELECT t.recipe_id, array_to_string(list_sort(list_filter(t.tags, lambda x: x IN {DIET_LIST})), ',') AS local_tags,
       array_to_string(list_sort(list_filter(p.tags, lambda x: x IN {DIET_LIST})), ',') AS published_tags,
       CASE WHEN p.id IS NULL THEN 'missing'
            WHEN list_sort(list_filter(t.tags, lambda x: x IN {DIET_LIST}))
                 = list_sort(list_filter(p.tags, lambda x: x IN {DIET_LIST})) THEN 'match'
            ELSE 'mismatch' END AS status
FROM tagged t LEFT JOIN patched p ON p.id = t.recipe_id
WHERE len(list_filter(coalesce(t.tags, []::VARCHAR[]), lambda x: x IN {DIET_LIST})) > 0""")
SQL["snapshot_to_classifier_rows"] = with_mapped("""
SELECT id AS recipe_id, coalesce(title, '') AS title,
       array_to_string(list_filter(CASE WHEN len(ingredientStrings) > 0 THEN ingredientStrings
            ELSE list_filter(list_transform(ingredients, lambda i: i.displayString), lambda s: s IS NOT NULL AND s <> '')
            END, lambda s: s <> ''), '|') AS ingredients
FROM published""")

_REVIEW = """
_unc AS (
  SELECT c.recipe_id, list(c.diet ORDER BY c.diet_order) AS diets
  FROM classified c WHERE c.applies IS NULL AND c.confidence < 0.90 GROUP BY c.recipe_id),
_idx AS (
  SELECT u.recipe_id, u.diets, r.title, r.ingredients,
         (row_number() OVER (ORDER BY u.recipe_id) - 1) // 20 AS batch,
         CAST((row_number() OVER (ORDER BY u.recipe_id) - 1) % 20 AS INTEGER) AS idx
  FROM _unc u JOIN recipes r ON r.recipe_id = u.recipe_id),
_pairs_r AS (SELECT i.batch, i.idx, i.recipe_id, unnest(i.diets) AS diet FROM _idx i),
_reviewed AS (
  SELECT recipe_id, diet, (idx + length(diet)) % 3 <> 1 AS applies,
         CASE WHEN (idx + length(diet)) % 4 = 0 THEN 0.7
              ELSE CAST('0.' || CAST(6 + length(diet) % 4 AS VARCHAR) AS DOUBLE) END::DOUBLE AS confidence,
         'llm' AS method, CASE WHEN idx % 5 = 0 THEN 'LLM classification' ELSE 'reviewed ' || diet END AS reason
  FROM _pairs_r WHERE batch % 7 <> 3)"""


def with_review(body: str, extra: str = "") -> str:
    return with_recipes(body, _rule_ctes() + "," + _REVIEW + ("," + extra if extra else ""))


_BATCH_CTES = """
_bdiets AS (
  SELECT batch, string_agg(diet, ',' ORDER BY diet_order) AS diets FROM (
    SELECT DISTINCT p.batch, p.diet, c.diet_order FROM _pairs_r p
    JOIN (SELECT DISTINCT diet, diet_order FROM classified) c ON c.diet = p.diet) GROUP BY batch),
_batches AS (
  SELECT i.batch, count(*) AS n_recipes,
         to_json(list({'id': CAST(i.idx AS BIGINT), 'title': coalesce(i.title, ''),
                       'ingredients': coalesce(i.ingredients, []::VARCHAR[])} ORDER BY i.idx)) AS payload
  FROM _idx i GROUP BY i.batch)"""

SQL["review_batches"] = with_review(
    "SELECT b.batch, b.n_recipes, d.diets, CAST(b.payload AS VARCHAR) AS payload FROM _batches b JOIN _bdiets d USING (batch)",
    _BATCH_CTES)
SQL["parse_review"] = with_review("SELECT recipe_id, diet, applies, confidence, method, reason FROM _reviewed")
SQL["apply_review"] = with_review("""
SELECT c.recipe_id, c.diet,
       CASE WHEN r.method IS NOT NULL THEN r.applies ELSE c.applies END AS applies,
       CASE WHEN r.method IS NOT NULL THEN r.confidence ELSE c.confidence END AS confidence,
       CASE WHEN r.method IS NOT NULL THEN r.method ELSE c.method END AS method,
       CASE WHEN r.method IS NOT NULL THEN r.reason ELSE c.reason END AS reason
FROM classified c LEFT JOIN _reviewed r ON r.recipe_id = c.recipe_id AND r.diet = c.diet""")
SQL["cost_ledger"] = """
WITH usage AS (SELECT user_id, sum(length(props))::BIGINT AS i, sum(length(event_type))::BIGINT AS o FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS batch, i AS input_tokens, o AS output_tokens,
       i / 1e6::DOUBLE * 0.10::DOUBLE + o / 1e6::DOUBLE * 0.40::DOUBLE AS cost FROM usage
UNION ALL
SELECT 'total', sum(i)::BIGINT, sum(o)::BIGINT,
       sum(i)::BIGINT / 1e6::DOUBLE * 0.10::DOUBLE + sum(o)::BIGINT / 1e6::DOUBLE * 0.40::DOUBLE FROM usage"""
SQL["diet_job"] = with_tags(f"""
SELECT r.recipe_id, array_to_string(CASE WHEN r.tags IS NOT NULL AND NOT list_has_any(r.tags, [{', '.join(_q(d.name) for d in DIETS)}])
              AND m._c IS NOT NULL THEN list_filter(m._c, lambda x, i: list_position(m._c, x) = i) ELSE r.tags END, '|') AS tags
FROM recipes r LEFT JOIN _merge m ON m.recipe_id = r.recipe_id""")
SQL["replace_dataset"] = with_tags(
    "SELECT count(*) AS rows, count(*) FILTER (WHERE len(tags) > 0) AS tagged_rows FROM tagged")
SQL["dataset_versions"] = with_tags("""
SELECT t.recipe_id, array_to_string(t.tags, '|') AS tags, array_to_string(r.tags, '|') AS before
FROM tagged t JOIN recipes r USING (recipe_id) WHERE t.tags IS DISTINCT FROM r.tags""")
SQL["upsert_store"] = with_mapped("""
SELECT id, title, healthGrade FROM published WHERE id NOT IN (
  SELECT recipe_id FROM recipes, range(1, 6) e(n) WHERE (CAST(recipe_id AS BIGINT) + n) % 3 = 0)
UNION ALL
SELECT recipe_id, concat_ws(' / edit ', title, CAST(n AS VARCHAR)), healthGrade
FROM recipes, range(1, 6) e(n) WHERE (CAST(recipe_id AS BIGINT) + n) % 3 = 0
QUALIFY row_number() OVER (PARTITION BY recipe_id ORDER BY n * 7 % 5 DESC) = 1""")
SQL["commit_chunks"] = with_mapped("""
SELECT id, (row_number() OVER (ORDER BY id) - 1) // 50 AS chunk,
       CAST((row_number() OVER (ORDER BY id) - 1) % 50 AS INTEGER) AS idx FROM published""")

SQL["commit_sink"] = with_mapped("""
SELECT chunk, id, CASE WHEN max(CASE WHEN known AND bytes > 225 THEN 1 ELSE 0 END) OVER (PARTITION BY chunk) = 1
                       THEN 'failed' ELSE 'success' END AS outcome
FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 50 AS chunk, healthGrade IS DISTINCT FROM 'C' AS known,
             length('{"id":"' || id || '","text":"' ||
                    CASE WHEN healthGrade = 'A' THEN array_to_string(instructions, ' ')
                         ELSE substr(array_to_string(instructions, ' '), 1, 200) END || '"}') AS bytes FROM published)
QUALIFY known""")


# ---- prompts, pages, restructure ----------------------------------------------------------

from larder.plans import prompts as _pr  # noqa: E402


def _has_any(col: str, words) -> str:
    return f"list_has_any({col}, [{', '.join(_q(w) for w in words)}])"


def _first_sql(col: str, table, default: str) -> str:
    whens = " ".join(f"WHEN {_has_any(col, w)} THEN {v}" for w, v in table)
    return f"CASE {whens} ELSE {default} END"


def _style_sql(key: str) -> str:
    base = _first_sql("ts", [(w, _q(s[key])) for w, s in _pr.DISH_STYLES], _q(_pr.DEFAULT_STYLE[key]))
    for words, ov in _pr.DIET_OVERRIDES:
        if key in ov:
            base = f"CASE WHEN {_has_any('ts', words)} THEN {_q(ov[key])} ELSE {base} END"
    return base


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_extra = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {_has_any('ts', w)} THEN {_q(ov['extra'])} END" for w, ov in _pr.DIET_OVERRIDES if "extra" in ov) + ")"
_kw = "[" + ", ".join(_q(k) for k in _pr.GARNISH_KEYWORDS) + "]"

SQL["prompt_text"] = with_mapped(f"""
, _p1 AS (
  SELECT id, title, instructions, ingredientStrings,
         list_distinct(list_transform(tags, lambda t: coalesce(lower({_STRIP.format('t')}), 'none'))) AS ts,
         lower({_STRIP.format("coalesce(cookingMethod, '')")}) AS m
  FROM mapped),
_p2 AS (
  SELECT *, {_style_sql('angle')} AS angle, {_style_sql('lighting')} AS lighting,
         {_style_sql('surface')} AS surface, {_style_sql('mood')} AS mood, {_extra} AS extra,
         {_first_sql("list_concat(ts, CASE WHEN m <> '' THEN [m] ELSE []::VARCHAR[] END)",
                     [(w, _q(t)) for w, t in _pr.TEXTURES], "''")} AS tex,
         list_filter(list_transform(ingredientStrings[1:8], lambda s: {_STRIP.format('s')}),
                     lambda s: s IS NOT NULL AND s <> '') AS cands,
         coalesce(substring({_STRIP.format(f"list_filter(instructions, lambda st: len(list_filter({_kw}, lambda k: contains(lower(st), k))) > 0)[1]")}, 1, 120), '') AS gar
  FROM _p1),
_p3 AS (
  SELECT *, list_filter(cands, lambda s: len(string_split_regex(s, '\\s+')) <= 4)[1:3] AS visual FROM _p2),
_p4 AS (
  SELECT *, CASE WHEN len(visual) > 0 THEN visual ELSE cands[1:2] END AS vis FROM _p3),
_p5 AS (
  SELECT *, CASE WHEN len(vis) = 0 THEN '' WHEN len(vis) = 1 THEN 'featuring ' || vis[1]
                 ELSE 'featuring ' || array_to_string(vis[1:len(vis) - 1], ', ') || ' and ' || vis[-1] END AS hl
  FROM _p4)
SELECT id, concat_ws(' ',
    angle || ' photograph of ' || coalesce(title, 'dish') || CASE WHEN tex <> '' THEN ', ' || tex ELSE '' END || '.',
    'Served on ' || surface || '.',
    lighting || {_q(_pr.SHADOW_SENTENCE)},
    mood || ' composition.',
    CASE WHEN hl <> '' THEN hl || '.' || CASE WHEN extra <> '' THEN ' ' || extra || '.' ELSE '' END
         WHEN extra <> '' THEN extra || '.' END,
    CASE WHEN gar <> '' THEN gar || '.' END,
    {_q(_pr.CLOSING_SENTENCE)}) || ' Avoid: ' || {_q(_pr.NEGATIVE_PROMPT)} || '.' AS full_prompt
FROM _p5""")


def _clean(expr: str) -> str:
    e = f"regexp_replace({expr}, '<[^>]*>', '', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        e = f"replace({e}, {_q(ent)}, {_q(ch)})"
    return _STRIP.format(e)


_PAGES = f"""
_pg AS (
  SELECT url, sha256(url) AS id,
         nullif({_clean("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '') AS title,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), '') AS host,
         list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1),
                                                       '(?s)<p>(.*?)</p>', 1), lambda p: {_clean('p')}),
                     lambda p: p <> '') AS paras
  FROM pages)"""

SQL["pages_to_recipes"] = f"""WITH {_PAGES}
SELECT id, url, title, paras[1] AS description, host, CAST(len(paras) AS INTEGER) AS n_instructions
FROM _pg WHERE title IS NOT NULL"""
SQL["page_tags"] = f"""
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
         regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a[^>]*>(.*?)</a>', 1),
         lambda t: {_clean('t')}), lambda t: t <> ''))), '|') AS tags
FROM pages"""
SQL["pages_validation"] = f"""WITH {_PAGES}
SELECT concat_ws('; ', 'uuid is required', 'ingredients are required structured', 'ingredient strings are required',
                 'nutrients are required') AS error, count(*) AS count
FROM _pg WHERE title IS NOT NULL"""
SQL["restructure_wide"] = """
SELECT o_orderpriority AS recipe_id, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderpriority"""
SQL["restructure_json"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS recipe_id, o_totalprice AS total, o_orderpriority AS priority FROM orders"""
SQL["restructure_props"] = """
SELECT event_id, k AS key, json_extract_string(props, '$."' || k || '"') AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"""
SQL["image_manifest"] = with_mapped("""
SELECT id, 'recipe_images/' || id AS object_path,
       CASE lower(regexp_extract(image, '(\\.[A-Za-z0-9]+)$', 1)) WHEN '.jpg' THEN 'image/jpeg'
            WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' ELSE 'image/jpeg' END AS content_type
FROM published WHERE image IS NOT NULL""")


# ---- sources and exports --------------------------------------------------------------------

_COLUMNS = ("recipe_id", "title", "description", "url", "host", "image", "author", "uuid", "instructions", "ingredients",
            "procesedIngredients", "tags", "cookingMethod", "nutrients", "healthScore", "healthGrade", "numServings",
            "cookTime", "prepTime", "totalTime", "ratings", "ratingsCount", "cluster_id")
SQL["describe_columns"] = with_recipes("\nUNION ALL\n".join(
    f"SELECT {i}::INTEGER AS position, {_q(c)} AS \"column\", count(*) AS rows, count({c}) AS filled FROM recipes"
    for i, c in enumerate(_COLUMNS)))
SQL["sample_n"] = with_recipes(
    "SELECT least(10, count(*)) AS members, least(10, count(*)) AS distinct_ids, least(10, count(*)) AS picked FROM recipes")
SQL["convert_codec"] = """
SELECT (SELECT count(*) FROM orders) AS rows, CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM orders)) AS INTEGER) AS columns,
       'zstd' AS codec"""
SQL["json_source"] = with_mapped("""
SELECT id, title, array_to_string(tags, '|') AS tags, array_to_string(ingredientStrings, '|') AS ingredientStrings FROM published""")
_PUBLISHED_GRADES = with_mapped("""
SELECT g.grade, count(p.id) AS count FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('F')) g(grade)
LEFT JOIN published p ON p.healthGrade = g.grade GROUP BY g.grade""")
SQL["stats_export"] = f"""
SELECT 'tags' AS section, tag AS name, count FROM ({SQL["tag_counts_published"]})
UNION ALL SELECT 'missing', field, missing FROM ({SQL["missing_fields"]})
UNION ALL SELECT 'grades', grade, count FROM ({_PUBLISHED_GRADES})"""

_PERCENT = with_mapped("""SELECT CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE len(nutrients) > 0) / count(*) * 100, 2)
ELSE 0 END AS p FROM published""")
SQL["stats_report"] = f"""
SELECT 'total' AS section, 'recipes' AS name, total_recipes::DOUBLE AS value FROM ({SQL["nutrient_coverage"]})
UNION ALL SELECT 'tags', tag, count FROM ({SQL["tag_counts_published"]})
UNION ALL SELECT 'ingredients', ingredient, count FROM ({SQL["ingredient_top100"]})
UNION ALL SELECT 'nutrients', 'recipes_with_nutrients', recipes_with_nutrients FROM ({SQL["nutrient_coverage"]})
UNION ALL SELECT 'nutrients', 'coverage_percent', p FROM ({_PERCENT})
UNION ALL SELECT 'nutrient_fields', field, count FROM ({SQL["nutrient_field_counts"]})
UNION ALL SELECT 'missing_fields', field, missing FROM ({SQL["missing_fields"]})"""
SQL["sample_ids"] = with_recipes("SELECT recipe_id FROM recipes ORDER BY md5('42:' || recipe_id), recipe_id LIMIT 200")
SQL["type_check_text"] = with_recipes("""
SELECT recipe_id AS id, concat_ws('; ',
    CASE WHEN cluster_id % 4 = 0 THEN 'author: Input should be a valid string' END,
    CASE WHEN cluster_id % 3 = 0 AND len(nutrients) > 0 THEN 'nutrients.quantity: Input should be a valid string' END,
    'uuid is required', 'ingredients are required structured', 'ingredient strings are required',
    CASE WHEN cluster_id % 3 <> 0 OR coalesce(len(nutrients), 0) = 0 THEN 'nutrients are required' END) AS error
FROM recipes""")
