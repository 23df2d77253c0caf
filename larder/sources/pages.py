"""Recipe rows from a table of fetched pages (url, html).

Fetching is outside Spark; extraction is column work: the title is
mandatory (rows without one are dropped), every other field degrades to
null / [] on its own; the id is the SHA-256 of the URL. A page's recipe is the
first linked-data node of type Recipe, over all blocks, lists of nodes and
``@graph``; where no node has that type, the first readable one. Each field
that it lacks is sought in the page's microdata (``itemprop``), then in the
markup. Tags are the union of categories, cuisines, diets, equipment, keywords
and navigation link texts, distinct and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import empty_array, py_strip

# The HTML entities decoded in extracted text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

# The fields of a recipe that become tags, as schema.org names them.
TAG_FIELDS = ("recipeCategory", "recipeCuisine", "suitableForDiet", "tool", "keywords")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def unescape(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def clean_text(c: Column) -> Column:
    return py_strip(unescape(strip_tags(c)))


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1), F.lit(""))


def _nodes(block: Column) -> Column:
    """The nodes of one linked-data block as JSON texts: a list's elements, and of each the members of its ``@graph``."""
    listed = F.when(py_strip(block).startswith("["), F.from_json(block, "array<string>")).otherwise(F.array(block))
    return F.flatten(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda n: F.coalesce(
        F.from_json(F.get_json_object(n, "$.@graph"), "array<string>"), F.array(n))))


def linked_data(html: Column) -> Column:
    """JSON text of the page's recipe node; null where no block is readable."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?si)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    nodes = F.filter(F.flatten(F.transform(blocks, _nodes)), lambda n: F.get_json_object(n, "$").isNotNull())
    recipes = F.filter(nodes, lambda n: F.get_json_object(n, "$.@type").rlike(r'(^|["/])Recipe($|")'))
    return F.when(html.contains("ld+json"), F.coalesce(F.get(recipes, 0), F.get(nodes, 0)))


def microdata(html: Column) -> Column:
    """(name, value) of the page's elements with an ``itemprop``, read in one pass: their content or datetime attribute, or
    else their text up to the next element; [] where there are none."""
    found = F.regexp_extract_all(html, F.lit(r'(?si)<[a-z0-9]+\s[^>]*?itemprop="[^"]*"[^>]*>[^<]*'), 0)
    items = F.transform(found, lambda e: F.struct(
        F.regexp_extract(e, r'(?i)itemprop="([^"]*)"', 1).alias("name"),
        F.coalesce(F.nullif(py_strip(unescape(F.regexp_extract(e, r'\s(?:content|datetime)="([^"]*)"', 1))), F.lit("")),
                   clean_text(e)).alias("value")))
    return F.when(html.contains("itemprop"), F.filter(items, lambda i: i["value"] != "")).otherwise(
        F.array().cast("array<struct<name:string,value:string>>"))


def _values(items: Column, name: str) -> Column:
    """Values of the microdata elements of one name; an element may carry several names."""
    return F.transform(F.filter(items, lambda i: F.array_contains(F.split(i["name"], r"\s+"), name)), lambda i: i["value"])


def _text(ld: Column, *paths: str) -> Column:
    """First non-empty text at one of the paths."""
    return F.coalesce(*(F.nullif(py_strip(F.get_json_object(ld, p)), F.lit("")) for p in paths))


def _texts(ld: Column, path: str) -> Column:
    """Texts at a path that holds a list, or one comma-separated text; [] where it is missing."""
    raw = F.get_json_object(ld, path)
    many = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, ","))
    return F.coalesce(F.filter(F.transform(many, lambda t: py_strip(t)), lambda t: t.isNotNull() & (t != "")), empty_array())


def _steps(ld: Column) -> Column:
    """Instruction texts: a list of texts or of steps, sections opened into their steps, or one text split into lines."""
    raw = F.get_json_object(ld, "$.recipeInstructions")
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, r"\R"))
    opened = F.flatten(F.transform(listed, lambda n: F.coalesce(
        F.from_json(F.get_json_object(n, "$.itemListElement"), "array<string>"), F.array(n))))
    texts = F.transform(opened, lambda n: F.when(n.startswith("{"), F.coalesce(
        F.get_json_object(n, "$.text"), F.get_json_object(n, "$.name"))).otherwise(n))
    return F.coalesce(F.filter(F.transform(texts, clean_text), lambda t: t != ""), empty_array())


def _or_else(first: Column, *others: Column) -> Column:
    """The first of several lists that has members."""
    for other in others:
        first = F.when(F.size(first) > 0, first).otherwise(other)
    return first


def _named(ld: Column, path: str) -> Column:
    """Texts at a path whose members are texts or objects with a name."""
    raw = F.get_json_object(ld, path)
    one = F.when(raw.startswith("{"), F.array(raw)).otherwise(_texts(ld, path))
    return F.filter(F.transform(one, lambda t: F.when(t.startswith("{"), py_strip(F.get_json_object(t, "$.name"))).otherwise(t)),
                    lambda t: t.isNotNull() & (t != ""))


def iso_minutes(text: Column) -> Column:
    """Minutes of an ISO 8601 duration such as PT1H30M, or of a plain number; null otherwise."""
    def part(pattern):
        return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int"), F.lit(0))
    minutes = part(r"(\d+)D") * 1440 + part(r"T.*?(\d+)H") * 60 + part(r"T(?:.*?H)?(\d+)M")
    return F.when(text.rlike(r"^P(?=.*\d)"), minutes).otherwise(text.try_cast("int"))


def with_sources(pages: DataFrame) -> DataFrame:
    """The pages with ``_ld`` (linked data) and ``_items`` (microdata), read once a page for all fields."""
    return pages.withColumns({"_ld": linked_data(F.col("html")), "_items": microdata(F.col("html"))})


def page_tags(html: Column, ld: Column, items: Column) -> Column:
    """Distinct tags of a page, sorted: categories, cuisines, diets, equipment and keywords of its recipe (linked data, or
    microdata where that has none), and the texts of its navigation links."""
    nav = F.regexp_extract(html, r"(?s)<nav>(.*?)</nav>", 1)
    links = F.transform(F.regexp_extract_all(nav, F.lit(r"(?s)<a[^>]*>(.*?)</a>"), 1), lambda t: clean_text(t))
    lists = [_or_else(_named(ld, f"$.{k}"), F.flatten(F.transform(_values(items, k), lambda v: F.split(v, r"\s*,\s*"))))
             for k in TAG_FIELDS]
    diets = lambda t: F.regexp_replace(t, r"^https?://schema\.org/", "")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(links, *lists), diets), lambda t: t != "")))


def pages_to_recipes(pages: DataFrame) -> DataFrame:
    """Recipe rows of pages with a title. Title and navigation come from the markup; every other field from linked data,
    from microdata where that lacks it, and from the markup where both do. Each falls back to null or [] on its own."""
    html, ld, items = F.col("html"), F.col("_ld"), F.col("_items")

    def text(name, *paths):
        return F.coalesce(_text(ld, *(paths or (f"$.{name}",))), F.get(_values(items, name), 0))
    title = F.coalesce(F.nullif(clean_text(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), F.lit("")), text("name"))
    article = F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)
    paragraphs = F.filter(F.transform(F.regexp_extract_all(article, F.lit(r"(?s)<p>(.*?)</p>"), 1),
                                      lambda p: clean_text(p)), lambda p: p != "")
    image = F.coalesce(_text(ld, "$.image.url", "$.image[0].url", "$.image[0]", "$.image"),
                       F.nullif(F.regexp_extract("html", r"<img[^>]*\ssrc=\"([^\"]+)\"", 1), F.lit("")))
    ingredients = _or_else(_texts(ld, "$.recipeIngredient"), _values(items, "recipeIngredient"))
    nutrition = F.map_entries(F.from_json(F.get_json_object(ld, "$.nutrition"), "map<string,string>"))
    nutrients = F.transform(F.filter(nutrition, lambda e: ~e["key"].startswith("@") & e["value"].isNotNull()),
                            lambda e: F.struct(e["key"].alias("name"), e["value"].alias("quantity")))
    group = F.array(F.struct(ingredients.alias("ingredients"), F.lit(None).cast("string").alias("purpose")))
    return with_sources(pages).withColumn("_paragraphs", paragraphs).select(
        F.sha2(F.col("url"), 256).alias("id"), "url", title.alias("title"),
        F.coalesce(F.nullif(clean_text(text("description")), F.lit("")), F.get("_paragraphs", 0)).alias("description"),
        host_of(F.col("url")).alias("host"), image.alias("image"),
        _or_else(_steps(ld), _values(items, "recipeInstructions"), F.col("_paragraphs")).alias("instructions"),
        page_tags(html, ld, items).alias("tags"),
        text("author", "$.author.name", "$.author[0].name", "$.author").alias("author"),
        text("recipeYield", "$.recipeYield[0]", "$.recipeYield").alias("numServings"),
        *(iso_minutes(text(k)).alias(k) for k in ("prepTime", "cookTime", "totalTime")),
        text("cookingMethod").alias("cookingMethod"),
        text("ratingValue", "$.aggregateRating.ratingValue").try_cast("double").alias("ratings"),
        F.coalesce(text("ratingCount", "$.aggregateRating.ratingCount"), text("reviewCount", "$.aggregateRating.reviewCount"))
        .try_cast("int").alias("ratingsCount"),
        ingredients.alias("ingredients"),
        F.when(F.size(ingredients) > 0, group).otherwise(F.array().cast(group_type())).alias("ingredientGroups"),
        F.coalesce(nutrients, F.array().cast("array<struct<name:string,quantity:string>>")).alias("nutrients"),
    ).filter(F.col("title").isNotNull())


def group_type() -> str:
    return "array<struct<ingredients:array<string>,purpose:string>>"
