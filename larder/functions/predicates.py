"""Predicates as data -> Spark Columns.

Two surfaces, both ANDed: ``Col.<name>.<op>(value)`` builds a ``Filter``;
dict queries use ``{"column__op": value}`` (no suffix = equality), and the
nested form ``{"column": {"__gte": 70}}``. A null operand drops the row
(three-valued logic), as in the catalogue. Comparisons and ``isin`` reach the
parquet scan as pushed filters; regex predicates stay in the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RecipeColumn(StrEnum):
    """Stored column names of the recipe table (f-strings give the plain name)."""

    RECIPE_ID = "recipe_id"
    TITLE = "title"
    DESCRIPTION = "description"
    URL = "url"
    HOST = "host"
    IMAGE = "image"
    AUTHOR = "author"
    UUID = "uuid"
    INSTRUCTIONS = "instructions"
    INGREDIENT_GROUPS = "ingredientGroups"
    INGREDIENTS = "ingredients"
    INGREDIENT_STRINGS = "ingredientStrings"
    PROCESSED_INGREDIENTS = "procesedIngredients"
    TAGS = "tags"
    COOKING_METHOD = "cookingMethod"
    NUTRIENTS = "nutrients"
    HEALTH_SCORE = "healthScore"
    HEALTH_GRADE = "healthGrade"
    NUM_SERVINGS = "numServings"
    COOK_TIME = "cookTime"
    PREP_TIME = "prepTime"
    TOTAL_TIME = "totalTime"
    RATINGS = "ratings"
    RATINGS_COUNT = "ratingsCount"
    EMBEDDING = "embedding"
    CLUSTER_ID = "cluster_id"

    @classmethod
    def values(cls) -> list[str]:
        return [m.value for m in cls]

    @classmethod
    def has_column(cls, name: str) -> bool:
        return name in cls.values()




@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any

    def to_column(self) -> Column:
        c = F.col(self.column)
        op, v = self.operator, self.value
        if op == "eq":
            return c == F.lit(v)
        if op == "ne":
            return c != F.lit(v)
        if op == "lt":
            return c < F.lit(v)
        if op == "lte":
            return c <= F.lit(v)
        if op == "gt":
            return c > F.lit(v)
        if op == "gte":
            return c >= F.lit(v)
        if op == "is_in":
            return c.isin(list(v))
        if op == "contains":
            # regex search, case-insensitive (Unicode case folding), pattern not escaped
            return c.rlike(f"(?iu){v}")
        if op == "list_any_contains":
            # any element matches; null elements ignored, empty list false, null list null
            return F.exists(c, lambda x: F.coalesce(x.rlike(f"(?iu){v}"), F.lit(False)))
        raise ValueError(f"Unknown operator: {op}")


class ColumnRef:
    def __init__(self, name: str):
        self._name = name

    def eq(self, v): return Filter(self._name, "eq", v)
    def ne(self, v): return Filter(self._name, "ne", v)
    def lt(self, v): return Filter(self._name, "lt", v)
    def lte(self, v): return Filter(self._name, "lte", v)
    def gt(self, v): return Filter(self._name, "gt", v)
    def gte(self, v): return Filter(self._name, "gte", v)
    def is_in(self, v): return Filter(self._name, "is_in", list(v))
    def contains(self, v): return Filter(self._name, "contains", v)
    def list_any_contains(self, v): return Filter(self._name, "list_any_contains", v)


class _Col:
    """Attribute access in snake_case -> stored (camelCase) column names."""

    recipe_id = ColumnRef("recipe_id")
    title = ColumnRef("title")
    description = ColumnRef("description")
    url = ColumnRef("url")
    host = ColumnRef("host")
    image = ColumnRef("image")
    author = ColumnRef("author")
    uuid = ColumnRef("uuid")
    instructions = ColumnRef("instructions")
    ingredient_groups = ColumnRef("ingredientGroups")
    ingredients = ColumnRef("ingredients")
    ingredient_strings = ColumnRef("ingredientStrings")
    processed_ingredients = ColumnRef("procesedIngredients")
    tags = ColumnRef("tags")
    cooking_method = ColumnRef("cookingMethod")
    nutrients = ColumnRef("nutrients")
    health_score = ColumnRef("healthScore")
    health_grade = ColumnRef("healthGrade")
    num_servings = ColumnRef("numServings")
    cook_time = ColumnRef("cookTime")
    prep_time = ColumnRef("prepTime")
    total_time = ColumnRef("totalTime")
    ratings = ColumnRef("ratings")
    ratings_count = ColumnRef("ratingsCount")
    embedding = ColumnRef("embedding")
    cluster_id = ColumnRef("cluster_id")


Col = _Col()

# dict-query suffix -> operator; "contains" here is a case-SENSITIVE regex search
_DICT_OPS = {"eq": "eq", "ne": "ne", "lt": "lt", "le": "lte", "lte": "lte", "gt": "gt",
             "ge": "gte", "gte": "gte", "in": "is_in"}


def dict_filters(query: dict[str, Any], columns: list[str]) -> list[Column]:
    """Columns for a dict query; unknown column or operator -> ValueError."""
    out: list[Column] = []
    for key, value in query.items():
        key = str(key)
        if isinstance(value, dict):
            for op_key, v in value.items():
                out.extend(dict_filters({f"{key}{op_key if str(op_key).startswith('__') else '__' + op_key}": v},
                                        columns))
            continue
        col_name, op = key.rsplit("__", 1) if "__" in key else (key, "eq")
        if col_name not in columns:
            raise ValueError(f"Unknown column: '{col_name}'. Available columns: {columns}")
        if op == "contains":
            out.append(F.col(col_name).rlike(str(value)))
        elif op in _DICT_OPS:
            out.append(Filter(col_name, _DICT_OPS[op], value).to_column())
        else:
            raise ValueError(f"Unknown operator: {op}")
    return out


def apply_filters(df: DataFrame, *filters: Filter, query: dict[str, Any] | None = None) -> DataFrame:
    """AND of all ``Filter``s and the dict query (one Filter node; pushdown applies)."""
    conds = [f.to_column() for f in filters]
    if query:
        conds.extend(dict_filters(query, df.columns))
    for c in conds:
        df = df.filter(c)
    return df


def join_filtered(df: DataFrame, *filters: Filter, query: dict[str, Any]) -> DataFrame:
    """Parity form of combined filters: inner join of the two filtered results on
    ``recipe_id``; right-side columns come back suffixed ``_right``."""
    left = apply_filters(df, *filters)
    right = apply_filters(df, query=query)
    right = right.select(*[F.col(c).alias(c if c == "recipe_id" else f"{c}_right") for c in right.columns])
    return left.join(right, "recipe_id", "inner")


GRADES = ("A", "B", "C", "D", "F")


def cli_filters(params: dict[str, str]) -> list[Filter]:
    """Filters from CLI-style text inputs: grade only if A-F, cook time only if
    digits, rating only if it parses as a float; blanks are skipped."""
    out: list[Filter] = []
    grade = (params.get("grade") or "").strip().upper()
    if grade in GRADES:
        out.append(Col.health_grade.eq(grade))
    cook = (params.get("max_cook_time") or "").strip()
    if cook.isdigit():
        out.append(Col.cook_time.lte(int(cook)))
    rating = (params.get("min_rating") or "").strip()
    if rating:
        try:
            out.append(Col.ratings.gte(float(rating)))
        except ValueError:
            pass
    title = (params.get("title") or "").strip()
    if title:
        out.append(Col.title.contains(title))
    ingredient = (params.get("ingredient") or "").strip()
    if ingredient:
        out.append(Col.ingredients.list_any_contains(ingredient))
    cluster = (params.get("cluster_id") or "").strip()
    if cluster.isdigit():
        out.append(Col.cluster_id.eq(int(cluster)))
    return out


def any_tag_in(tags: Column, names: list[str]) -> Column:
    """At least one tag in ``names`` (null list -> null, null elements ignored)."""
    return F.exists(tags, lambda t: F.coalesce(t.isin(names), F.lit(False)))


def skip_tagged(df: DataFrame, names: list[str], tags: str = "tags") -> DataFrame:
    """Rows whose tags carry none of ``names``; null-tag rows are dropped, empty kept."""
    return df.filter(F.col(tags).isNotNull() & ~any_tag_in(F.col(tags), names))
