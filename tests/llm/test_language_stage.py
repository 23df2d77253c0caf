"""The language stage rejects what the operator calls und."""

import pytest
from pyspark.sql import functions as F

from larder.llm import language_id as L


@pytest.mark.parametrize("learned", [True, False])
def test_stage_and_operator_agree(spark, learned):
    rows = [(1, "the house by the water", "en"), (2, "1234 !!", "en"), (3, "la maison de la mer", "fr"), (4, None, None), (5, "der Weg", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs if learned else docs.withColumn("lang", F.lit(None).cast("string"))
    known = {r.doc_id for r in L.language_id(docs).collect() if r.lang_pred != L.UNKNOWN}
    assert {r.doc_id for r in L.known_language(docs).collect()} == known == ({1, 3, 5} if learned else set())


def test_letters_are_letters_by_category(spark):
    letter = L.Profile(8).letter
    wrong = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and letter[c] != chr(c).isalpha()]
    assert wrong == []
    rows = [(1, "the house by the water", "en"), (2, "\u4dc0\u4dff \u4dd0", "en"), (3, "la maison de la mer", "fr"), (4, "\ue000 \ufffe", None)]
    found = {r.doc_id: r.lang_pred for r in L.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found[2] == found[4] == L.UNKNOWN and found[1] != L.UNKNOWN


def test_sample_is_bounded_by_language(spark):
    rows = [(i, f"text {i % 50} of words", "en" if i % 10 else "fr") for i in range(4000)] + [(9000, "un texte", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = L.Settings(rows=40, languages=3)
    picks = [sorted(map(tuple, L.training_rows(d, settings, "doc_id", "text", "lang"))) for d in (docs, docs.repartition(13))]
    sizes = {lang: sum(r[1] == lang for r in picks[0]) for lang in ("en", "fr", "xx")}
    assert sizes["en"] == sizes["fr"] == 40 and sizes["xx"] <= 1 and picks[0] == picks[1]
    few = L.training_rows(docs, L.Settings(rows=40, languages=1), "doc_id", "text", "lang")
    assert len(few) == 40 and abs(sum(r.lang == "en" for r in few) - 20) <= 1
