"""Food-photo prompt text as a column job, plus the image object manifest.

Every step is a column expression over the published row (tags,
cookingMethod, ingredientStrings, instructions, title): keyword-set matching
is ``arrays_overlap`` against constant arrays, ordered first-match rules are
``when`` chains, and the text is assembled with ``concat_ws``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import empty_array, py_strip

# ---- FIXED VALUES: photo styles, textures, diet overrides and phrases ---------------------
NEGATIVE_PROMPT = (
    "blur, noise, overexposed, underexposed, text, watermark, logo, cartoon, illustration, "
    "painting, drawing, distortion, hands, people, plastic-looking, artificial, low quality, "
    "grainy, out of focus background clutter"
)
DEFAULT_STYLE = {
    "angle": "45-degree angle",
    "lighting": "soft warm studio lighting",
    "surface": "white ceramic plate on a dark slate surface",
    "mood": "appetizing and professional",
}
DISH_STYLES = [
    (("breakfast", "brunch"), {"angle": "overhead flat lay",
                               "lighting": "soft natural window light from the right side",
                               "surface": "white ceramic plate on a light linen tablecloth",
                               "mood": "bright and airy"}),
    (("dessert",), {"angle": "45-degree angle close-up", "lighting": "soft warm side lighting",
                    "surface": "dark marble surface", "mood": "rich and indulgent"}),
    (("salad",), {"angle": "overhead flat lay", "lighting": "soft diffused natural light",
                  "surface": "white plate on a light wooden table", "mood": "fresh and vibrant"}),
    (("soup", "stew"), {"angle": "45-degree angle", "lighting": "warm side lighting",
                        "surface": "rustic ceramic bowl on a dark wooden table", "mood": "hearty and comforting"}),
    (("beverage", "drink"), {"angle": "eye-level", "lighting": "backlit with warm rim lighting",
                             "surface": "dark oak bar surface", "mood": "elegant and inviting"}),
    (("sandwich",), {"angle": "eye-level close-up", "lighting": "dramatic warm studio lighting",
                     "surface": "dark wooden board", "mood": "bold and appetizing"}),
]
TEXTURES = [
    (("grill / bbq", "grilled"), "with visible grill marks and caramelized char"),
    (("baking", "baked"), "with a golden-brown crust and flaky layers"),
    (("air fryer",), "with a crispy golden exterior"),
    (("slow cooker", "slow cooked"), "tender and falling apart, with a rich glossy sauce"),
]
DIET_OVERRIDES = [
    (("vegan", "vegetarian"), {"surface": "white plate on a bright marble surface",
                               "extra": "fresh herbs as garnish, vibrant natural colors"}),
    (("keto", "low carb"), {"extra": "rich sauces and proteins as the focal point"}),
    (("healthy", "high protein"), {"mood": "fresh and energizing", "lighting": "bright natural light"}),
]
GARNISH_KEYWORDS = ("garnish", "top with", "sprinkle", "finish with", "drizzle", "serve with")
SHADOW_SENTENCE = ", casting soft shadows to highlight the dish's texture and depth."
CLOSING_SENTENCE = "Professional food photography, sharp focus on the dish, shallow depth of field, 4K."
IMAGE_PREFIX = "recipe_images/"
CONTENT_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png"}
# ---- end of fixed values ------------------------------------------------------------------


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tag_set(tags: Column) -> Column:
    """lower(strip(tag)); a null tag becomes "none"."""
    return F.array_distinct(F.transform(F.coalesce(tags, empty_array()),
                                        lambda t: F.coalesce(F.lower(py_strip(t)), F.lit("none"))))


def _first_match(keys: Column, table, default: Column) -> Column:
    chain = None
    for words, value in table:
        cond = F.arrays_overlap(keys, _lits(words))
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain.otherwise(default) if chain is not None else default


def style_fields(ts: Column) -> dict[str, Column]:
    """Dish style (first matching set) with diet overrides applied in order (later wins)."""
    out = {}
    for key in ("angle", "lighting", "surface", "mood"):
        base = _first_match(ts, [(w, F.lit(s[key])) for w, s in DISH_STYLES], F.lit(DEFAULT_STYLE[key]))
        for words, ov in DIET_OVERRIDES:  # apply in order: each matching override replaces the value
            if key in ov:
                base = F.when(F.arrays_overlap(ts, _lits(words)), F.lit(ov[key])).otherwise(base)
        out[key] = base
    extras = [F.when(F.arrays_overlap(ts, _lits(words)), F.lit(ov["extra"])) for words, ov in DIET_OVERRIDES
              if "extra" in ov]
    out["extra"] = F.array_join(F.array_compact(F.array(*extras)), ", ")
    return out


def texture(ts: Column, cooking_method: Column) -> Column:
    m = F.lower(py_strip(F.coalesce(cooking_method, F.lit(""))))
    keys = F.concat(ts, F.when(m != "", F.array(m)).otherwise(empty_array()))
    return _first_match(keys, [(w, F.lit(t)) for w, t in TEXTURES], F.lit(""))


def highlights(ingredient_strings: Column) -> Column:
    cands = F.filter(F.transform(F.slice(F.coalesce(ingredient_strings, empty_array()), 1, 8), lambda s: py_strip(s)),
                     lambda s: s.isNotNull() & (s != ""))
    # at most four words: a pattern that is compiled once, where a split compiles its own for each text
    visual = F.slice(F.filter(cands, lambda s: ~s.rlike(r"(?U)\s\S++\s++\S++\s++\S++\s")), 1, 3)
    vis = F.when(F.size(visual) > 0, visual).otherwise(F.slice(cands, 1, 2))
    return (F.when(F.size(vis) == 0, F.lit(""))
            .when(F.size(vis) == 1, F.concat(F.lit("featuring "), F.get(vis, 0)))
            .otherwise(F.concat(F.lit("featuring "), F.array_join(F.slice(vis, F.lit(1), F.size(vis) - 1), ", "),
                                F.lit(" and "), F.element_at(vis, -1))))


def garnish(instructions: Column) -> Column:
    step = F.get(F.filter(F.coalesce(instructions, empty_array()),
                          lambda st: F.exists(_lits(GARNISH_KEYWORDS),
                                              lambda k: F.coalesce(F.instr(F.lower(st), k) > 0, F.lit(False)))), 0)
    return F.coalesce(F.substring(py_strip(step), 1, 120), F.lit(""))


def prompt_columns(df: DataFrame) -> DataFrame:
    """(id, prompt, negative_prompt, full_prompt) for published rows."""
    ts = tag_set(F.col("tags"))
    st = style_fields(ts)
    tex = texture(ts, F.col("cookingMethod"))
    hl = highlights(F.col("ingredientStrings"))
    gar = garnish(F.col("instructions"))
    title = F.coalesce(F.col("title"), F.lit("dish"))
    extra = st["extra"]
    parts = [
        F.concat(st["angle"], F.lit(" photograph of "), title,
                 F.when(tex != "", F.concat(F.lit(", "), tex)).otherwise(F.lit("")), F.lit(".")),
        F.concat(F.lit("Served on "), st["surface"], F.lit(".")),
        F.concat(st["lighting"], F.lit(SHADOW_SENTENCE)),
        F.concat(st["mood"], F.lit(" composition.")),
        F.when(hl != "", F.concat(hl, F.lit("."), F.when(extra != "", F.concat(F.lit(" "), extra, F.lit(".")))
                                  .otherwise(F.lit(""))))
        .when(extra != "", F.concat(extra, F.lit("."))),
        F.when(gar != "", F.concat(gar, F.lit("."))),
        F.lit(CLOSING_SENTENCE),
    ]
    prompt = F.concat_ws(" ", *parts)
    return df.select(
        F.col("id"), prompt.alias("prompt"), F.lit(NEGATIVE_PROMPT).alias("negative_prompt"),
    ).withColumn("full_prompt", F.concat(F.col("prompt"), F.lit(" Avoid: "), F.col("negative_prompt"), F.lit(".")))


def image_requests(prompts: DataFrame, num_images: int = 1) -> DataFrame:
    """Prompts with the number of images to ask for (1 to 4); blank prompts carry an error and must not be sent."""
    if not 1 <= num_images <= 4:
        raise ValueError("num_images must be between 1 and 4")
    blank = F.coalesce(py_strip(F.col("full_prompt")) == "", F.lit(True))
    return prompts.withColumn("num_images", F.lit(num_images)).withColumn(
        "error", F.when(blank, F.lit("prompt is empty")).otherwise(F.lit("")))


def image_manifest(df: DataFrame, prefix: str = IMAGE_PREFIX) -> DataFrame:
    """Storage object path and content type per image (by file suffix; default jpeg)."""
    suffix = F.lower(F.regexp_extract(F.col("image"), r"(\.[A-Za-z0-9]+)$", 1))
    ctype = F.coalesce(F.element_at(F.create_map(*[x for k, v in CONTENT_TYPES.items() for x in (F.lit(k), F.lit(v))]),
                                    suffix), F.lit("image/jpeg"))
    return df.filter(F.col("image").isNotNull()).select(
        "id", F.concat(F.lit(prefix), F.col("id")).alias("object_path"), ctype.alias("content_type"))
