"""Compression limits of the quality rules: opaque text goes, prose of every language stays."""

import base64
import os
import random
import string
import sysconfig

import pytest
import zstandard
from conftest_llm import SF

from larder.llm.quality import Bands, compression, quality_rules


def opaque(kind, n, rng):
    if kind == "base64":
        return base64.encodebytes(rng.randbytes(n))[:n].decode()
    if kind == "words":
        return " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=8)) for _ in range(n // 9 + 1))[:n]
    return " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(n // 19 + 1))


def test_opaque_text_is_rejected(spark):
    rng = random.Random(8)
    kinds = [(k, n) for k in ("base64", "words") for n in (1000, 1500, 3000, 5000, 30_000)] + [("noise", 5000), ("noise", 30_000)]
    rows = [(i, opaque(k, n, rng)) for i, (k, n) in enumerate(kinds)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not [kinds[i] for i, r in got.items() if r.kept]
    assert any(not r.base_failed for r in got.values())


def test_prose_of_every_language_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.lang, r.text) for r in docs.select("lang", "text").collect() if r.text]
    packer, seen = zstandard.ZstdCompressor(level=Bands().level), set()
    for lang, text in texts:
        raw = text.encode()
        ratio = len(packer.compress(raw)) / len(raw)
        if len(raw) >= 1024 and ratio > 0.3:
            seen.add(lang)
            assert compression(raw, Bands(), packer)[3]
    assert seen >= {"de", "en", "es", "fr"}


@pytest.mark.parametrize("name", ["euc_jp", "euc_kr", "gb18030", "big5", "euc_jisx0213", "gbk"])
def test_prose_in_three_byte_scripts_stays(name):
    path = os.path.join(sysconfig.get_path("stdlib"), "test", "cjkencodings", f"{name}-utf8.txt")
    if not os.path.exists(path):
        pytest.skip("the standard library's samples are not installed")
    raw = open(path, "rb").read()
    assert compression(raw, Bands(), zstandard.ZstdCompressor(level=Bands().level))[3]


def test_the_rest_behind_the_last_chunk_is_judged(spark):
    packer = zstandard.ZstdCompressor(level=Bands().level)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    prose = max((r.text.encode() for r in docs if r.text and compression(r.text.encode(), Bands(), packer)[3]), key=len)
    assert len(prose) > 8100
    sound, long_word = prose[:8000], prose[:4096] + b" " + b"A" * 3900
    blob = prose[:4096] + base64.encodebytes(random.Random(3).randbytes(3000))[:3900]
    assert [compression(x, Bands(), packer)[1:] for x in (sound, long_word, blob)] == [(0, 2, True), (1, 2, False), (1, 2, False)]


def test_short_texts_have_bands(spark):
    rng = random.Random(5)
    rows = [(0, "We walked down to the harbour before noon, bought bread, olives and two lemons, and sat by the water until the ferry came."),
            (1, " ".join("z" * k for k in range(1, 18))), (2, opaque("words", 250, rng)), (3, "x " + " ".join("y" * k for k in range(3, 14)))]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in range(4)] == [True, False, False, False]
