"""The pipeline over a small table with odd rows."""

import public_tokenizers
from conftest_llm import SF, ordered
from tokenizers import Tokenizer

import corpus_pipeline
from larder.llm.queries import QUERIES, SQL


def test_stages_and_run(spark, odd, scratch):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    odd.select(*columns).write.parquet(f"{scratch}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{scratch}/benchmark.parquet")
    docs, counts = spark.read.parquet(f"{scratch}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, scratch)
        docs.write.parquet(f"{scratch}/stage{k}")
        docs = spark.read.parquet(f"{scratch}/stage{k}")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] == counts[3] == counts[4] > 100
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in before.collect()]
    assert ordered((r.doc_id, r.n_tokens) for r in docs.collect()) == ordered(want)
    assert corpus_pipeline.run(spark, scratch).count() == counts[-1]


def test_registry():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in names} and "pipeline" in names
    assert set(QUERIES) <= names and set(SQL) <= set(QUERIES)


def test_texts_reach_python_in_batches_bounded_by_bytes(spark):
    """Ten thousand long texts are many batches, not one; a session's own bound stays."""
    from larder.llm.pii import redact

    def rows_of(batches):
        for batch in batches:
            yield batch.select([0]).slice(0, 1).set_column(0, "n", [batch.num_rows])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for own in (None, str(1 << 26)):
        session = spark.newSession()
        if own:
            session.conf.set(key, own)
        docs = session.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 400) || id AS text", "0L AS n_chars")
        kept = redact(docs)
        assert session.conf.get(key) == (own or str(1 << 20))
        found = [r.n for r in docs.mapInArrow(rows_of, "n long").collect()]
        assert sum(found) == 4000 and (max(found) < 1500) == (not own)
        assert kept.count() == 4000
