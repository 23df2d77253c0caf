"""Raw recipe rows -> the published schema, with per-row validation errors.

Polymorphic inputs (ingredients as strings or structs, nutrients as list or
map) are resolved once on the static schema when the plan is built, never
per row. Validation never raises: each row gets an ``error`` text ('' when
valid), so one bad row cannot abort a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.text import empty_array

INGREDIENT_TYPE = ("struct<quantity:double,unit:string,displayString:string,"
                   "foodCodes:struct<ingredientID:string>>")
NUTRIENT_TYPE = "struct<name:string,quantity:string>"
GROUP_TYPE = "struct<ingredients:array<string>,purpose:string>"

PUBLISHED_COLUMNS = (
    "id", "uuid", "title", "description", "url", "host", "image", "author", "instructions",
    "ingredientGroups", "ingredientStrings", "ingredients", "tags", "cookingMethod", "nutrients",
    "healthScore", "healthGrade", "numServings", "cookTime", "prepTime", "totalTime", "ratings",
    "ratingsCount", "embedding", "cluster_id", "channel")

# The published error texts
ERRORS = (
    ("id", "id is required"),
    ("uuid", "uuid is required"),
    ("title", "title is required"),
    ("ingredients", "ingredients are required structured"),
    ("ingredientStrings", "ingredient strings are required"),
    ("nutrients", "nutrients are required"),
)


def _col_or_null(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _falsy_list(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def normalize_nutrients(df: DataFrame, name: str = "nutrients") -> Column:
    """null -> []; map/struct -> [{name, quantity: text of value}] (null value -> "None"); list as is."""
    if name not in df.columns:
        return empty_array(NUTRIENT_TYPE)
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.MapType):
        out = F.transform(F.map_entries(c), lambda e: F.struct(
            e["key"].cast("string").alias("name"),
            F.coalesce(e["value"].cast("string"), F.lit("None")).alias("quantity")))
    elif isinstance(dt, T.StructType):
        out = F.array(*[F.struct(F.lit(f.name).alias("name"),
                                 F.coalesce(c[f.name].cast("string"), F.lit("None")).alias("quantity"))
                        for f in dt.fields])
        out = F.when(c.isNotNull(), out)
    elif isinstance(dt, T.ArrayType):
        out = c.cast(f"array<{NUTRIENT_TYPE}>")
    else:
        return empty_array(NUTRIENT_TYPE)
    return F.coalesce(out, empty_array(NUTRIENT_TYPE))


def normalize_servings(df: DataFrame, name: str = "numServings") -> Column:
    """Number -> double; text -> first ``\\d+\\.?\\d*`` as double ("4-6 servings" -> 4.0); else null."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.StringType):
        return F.nullif(F.regexp_extract(c, r"\d+\.?\d*", 0), F.lit("")).try_cast("double")
    if isinstance(dt, T.NumericType):
        return c.cast("double")
    return F.lit(None).cast("double")


def structured_ingredients(df: DataFrame) -> Column:
    """``procesedIngredients`` whenever it is a list (even empty), else raw
    ``ingredients`` when they are structs, else []."""
    raw_struct = ("ingredients" in df.columns and isinstance(df.schema["ingredients"].dataType, T.ArrayType)
                  and isinstance(df.schema["ingredients"].dataType.elementType, T.StructType))
    fallback = F.coalesce(F.col("ingredients"), empty_array(INGREDIENT_TYPE)) if raw_struct \
        else empty_array(INGREDIENT_TYPE)
    if "procesedIngredients" in df.columns:
        return F.coalesce(F.col("procesedIngredients"), fallback)
    return fallback


def ingredient_strings(df: DataFrame, structured: Column) -> Column:
    """Own ``ingredientStrings``; else raw string ``ingredients``; else the
    non-empty display strings of the structured list."""
    own = _col_or_null(df, "ingredientStrings", "array<string>")
    raw_str = ("ingredients" in df.columns and isinstance(df.schema["ingredients"].dataType, T.ArrayType)
               and isinstance(df.schema["ingredients"].dataType.elementType, T.StringType))
    raw = F.col("ingredients") if raw_str else F.lit(None).cast("array<string>")
    chosen = F.when(~_falsy_list(own), own).when(~_falsy_list(raw), raw).otherwise(empty_array())
    from_struct = F.filter(F.transform(structured, lambda i: i["displayString"]),
                           lambda s: s.isNotNull() & (s != ""))
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.coalesce(from_struct, empty_array()))


def map_recipes(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Map raw/local rows to the published schema (defaults and coercions). ``keep`` names further columns to carry along;
    ``type_error`` says which values no coercion accepts ('' when none)."""
    rid = _col_or_null(df, "recipe_id", "string")
    own_id = _col_or_null(df, "id", "string").cast("string")
    structured = structured_ingredients(df)

    def s(name):
        return _col_or_null(df, name, "string").cast("string")

    def lst(name, dtype):
        return F.coalesce(_col_or_null(df, name, f"array<{dtype}>"), empty_array(dtype))

    staged = df.select(
        F.coalesce(F.nullif(own_id, F.lit("")), rid).alias("id"),
        s("uuid").alias("uuid"),
        F.coalesce(F.nullif(s("title"), F.lit("")), F.lit("Unknown")).alias("title"),
        s("description").alias("description"), s("url").alias("url"), s("host").alias("host"),
        s("image").alias("image"), s("author").alias("author"),
        lst("instructions", "string").alias("instructions"),
        lst("ingredientGroups", GROUP_TYPE).alias("ingredientGroups"),
        structured.alias("ingredients"),
        ingredient_strings(df, structured).alias("ingredientStrings"),
        lst("tags", "string").alias("tags"),
        s("cookingMethod").alias("cookingMethod"),
        normalize_nutrients(df).alias("nutrients"),
        lax_float(df, "healthScore").alias("healthScore"),
        s("healthGrade").alias("healthGrade"),
        normalize_servings(df).alias("numServings"),
        *[lax_int(df, n).alias(n) for n in ("cookTime", "prepTime", "totalTime")],
        lax_float(df, "ratings").alias("ratings"),
        lax_int(df, "ratingsCount").alias("ratingsCount"),
        F.coalesce(_col_or_null(df, "embedding", "array<double>").try_cast("array<double>"),
                   empty_array("double")).alias("embedding"),
        lax_int(df, "cluster_id").alias("cluster_id"),
        F.coalesce(F.nullif(s("channel"), F.lit("")), F.lit("discover")).alias("channel"),
        type_errors(df).alias("type_error"),
        *(F.col(k).alias(f"_keep_{k}") for k in keep),
    )
    return staged.select(*PUBLISHED_COLUMNS, "type_error", *(f"_keep_{k}" for k in keep)).withColumnsRenamed(
        {f"_keep_{k}": k for k in keep})


#: Text fields, in which a number is an error
TEXT_FIELDS = ("uuid", "title", "description", "url", "host", "image", "author", "cookingMethod", "healthGrade", "channel")


def lax_float(df: DataFrame, name: str) -> Column:
    """Number with lax coercion: numeric types and numeric text; anything else becomes null (see ``type_errors``)."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    c = F.col(name)
    return F.trim(c).try_cast("double") if isinstance(df.schema[name].dataType, T.StringType) else c.try_cast("double")


def lax_int(df: DataFrame, name: str) -> Column:
    """Integer with lax coercion: 3.0, "30", " 30 ", true accepted; 3.5 and
    "30 min" and numbers beyond 32 bits become null (and are reported by ``type_errors``)."""
    if name not in df.columns:
        return F.lit(None).cast("int")
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return c.try_cast("int")
    if isinstance(dt, T.BooleanType):
        return c.cast("int")
    v = F.trim(c.cast("string")).try_cast("double") if isinstance(dt, T.StringType) else c.cast("double")
    return F.when(v == F.floor(v), v.try_cast("int"))


def type_errors(df: DataFrame, int_fields=("cookTime", "prepTime", "totalTime", "ratingsCount", "cluster_id"),
                float_fields=("healthScore", "ratings")) -> Column:
    """'; '-joined type errors of the lax checks ('' when none)."""
    msgs = []
    for n in int_fields:
        if n in df.columns:
            msgs.append(F.when(F.col(n).isNotNull() & lax_int(df, n).isNull(),
                               F.lit(f"{n}: Input should be a valid integer")))
    for n in float_fields:
        if n in df.columns:
            msgs.append(F.when(F.col(n).isNotNull() & lax_float(df, n).isNull(),
                               F.lit(f"{n}: Input should be a valid number")))
    for n in TEXT_FIELDS:  # text takes no coercion
        if n in df.columns and not isinstance(df.schema[n].dataType, (T.StringType, T.NullType)):
            msgs.append(F.when(F.col(n).isNotNull(), F.lit(f"{n}: Input should be a valid string")))
    dt = df.schema["nutrients"].dataType if "nutrients" in df.columns else None
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StructType):  # other forms are turned to text first
        for f in dt.elementType.fields:
            if f.name in ("name", "quantity") and not isinstance(f.dataType, T.StringType):
                some = F.size(F.array_compact(F.col(f"nutrients.{f.name}"))) > 0
                msgs.append(F.when(some, F.lit(f"nutrients.{f.name}: Input should be a valid string")))
    if not msgs:
        return F.lit("")
    return F.array_join(F.array_compact(F.array(*msgs)), "; ")


def validation_error(published: DataFrame) -> Column:
    """Required-field errors in fixed order, joined by '; ' ('' when valid)."""
    def missing(name):
        dt = published.schema[name].dataType
        c = F.col(name)
        if isinstance(dt, T.ArrayType):
            return c.isNull() | (F.size(c) == 0)
        return c.isNull() | (c == "")
    return F.array_join(F.array_compact(F.array(*[F.when(missing(n), F.lit(msg)) for n, msg in ERRORS])), "; ")


def validate(published: DataFrame) -> DataFrame:
    """Replaces ``type_error`` by ``error`` ('' = valid; type errors before missing fields) and adds ``valid``."""
    error = validation_error(published)
    if "type_error" in published.columns:
        error = F.array_join(F.filter(F.array(F.col("type_error"), error), lambda e: e != ""), "; ")
    return published.withColumn("error", error).drop("type_error").withColumn("valid", F.col("error") == "")
