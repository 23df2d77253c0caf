"""Tokenizers, quality, licences, personal data and learned operators, against libraries, brute force and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from conftest_llm import SF, SPACED, ordered
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larder.llm import language_id as L
from larder.llm import license_scan as LS
from larder.llm import pii as P
from larder.llm import token_counts as TC
from larder.llm import toxicity as T
from larder.llm.quality import Bands, quality_rules
from larder.llm.word_bpe import LONG, WordBpe, encode_digests, encode_documents

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
WORD_LIB = Tokenizer.from_file(WORD_FILE)
BYTE_LIB = Tokenizer.from_file(BYTE_FILE)
BPE = WordBpe(open(WORD_FILE).read())
COUNTER = TC.Counter(BYTE_FILE, open(BYTE_FILE, "rb").read())

# characters that this Python's Unicode tables know; later ones may differ from the library's
texts = st.one_of(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=60), st.text(alphabet="abcXYZéÉ'sStT d12 \n\t!?-ßßĳİΣ<|endoftext|>²½", max_size=60))


@settings(max_examples=300, deadline=None)
@given(texts)
def test_tokenizers_agree_with_the_library(text):
    ids, decoded = next(BPE.encode([text]))
    want = WORD_LIB.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert decoded == BPE.decode(want) == WORD_LIB.decode(want, skip_special_tokens=False)
    assert COUNTER.count(text) == len(BYTE_LIB.encode(text, add_special_tokens=False).ids)


def test_long_words_take_the_heap():
    rng = random.Random(4)
    for n in (LONG - 1, LONG, LONG + 1, 3 * LONG, 2000):
        word = "".join(rng.choice("abcdeothin") for _ in range(n))
        assert next(BPE.encode([word]))[0].tolist() == WORD_LIB.encode(word, add_special_tokens=False).ids


def test_bpe_and_counts_over_a_table(odd, odd_texts, empty, scratch):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want, counts = [], []
    for doc, text in odd_texts:
        ids = WORD_LIB.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(WORD_LIB.decode(ids, skip_special_tokens=False).encode())))
        n = len(BYTE_LIB.encode(text or "", add_special_tokens=False).ids)
        counts.append((doc, len((text or "").encode()), n, n > 512))
    assert ordered(encode_digests(odd, WORD_FILE).collect()) == ordered(want)
    assert encode_documents(odd.limit(5), WORD_FILE).count() == 5 and encode_digests(empty, WORD_FILE).count() == 0
    cache = f"{scratch}/cache"
    assert ordered(TC.token_counts(odd, BYTE_FILE, cache).collect()) == ordered(counts)
    spark = odd.sparkSession
    first = spark.read.parquet(cache)
    assert first.count() == len({t or "" for _, t in odd_texts})  # distinct texts only
    assert ordered(TC.token_counts(odd, BYTE_FILE, cache).collect()) == ordered(counts)
    assert spark.read.parquet(cache).count() == first.count()  # a second run finds all of them
    assert TC.token_counts(empty, BYTE_FILE, cache).count() == 0


def test_sentence_pieces_are_counted():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = TC.Counter(path, open(path, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert all(own.count(t) == len(library.encode(t)) for t in ("", "Hello  world", "é\n​", "<s> x"))


def test_quality_against_brute_force(odd, odd_texts, empty):
    want = []
    for doc, text in odd_texts:
        text = text or ""
        words = SPACED.findall(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        want.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                     len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)))
    got = quality_rules(odd).collect()
    assert ordered(tuple(r)[:7] for r in got) == ordered(want)
    assert all(not r.kept for r in got if r.base_failed) and quality_rules(empty).count() == 0
    packer = zstandard.ZstdCompressor(level=Bands().level)
    sizes = {(d, len(SPACED.findall(t))): len(packer.compress(t.encode())) / len(t.encode()) for d, t in odd_texts if t and d is not None and d < 9000}
    assert all(abs(r.ratio - sizes[(r.doc_id, r.n_words)]) < 1e-12 for r in got if (r.doc_id, r.n_words) in sizes)


def test_quality_bands(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(2000))
    part = prose[:8000] + " " + " ".join(f"{a} {b}" for a in ("x",) for b in range(10)) + " zz" * 6000
    rows = [(0, prose), (1, "".join(f"line {i % 7} of the same few words again\n" for i in range(900))), (2, noise), (3, part)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].kept and not got[1].kept and not got[3].kept and got[3].bad_chunks > 0


def test_licenses_against_brute_force(spark, odd, empty):
    notices = [t for _, t in LS.TEMPLATES]
    rng = random.Random(6)
    rows = []
    for k in range(300):
        words = [f"t{rng.randint(0, 5000)}" for _ in range(rng.randint(0, 40))]
        if k % 2:
            words[rng.randint(0, len(words)):0] = [notices[k % len(notices)].upper() if k % 3 else notices[k % len(notices)]]
        rows.append((k, " ".join(words)))
    found = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in
             LS.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    word = re.compile(r"[0-9a-z]+")
    shingles = lambda w: {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    missed = extra = total = 0
    for doc, text in rows:
        own = shingles(word.findall(text.lower()))
        want = {n for n, t in LS.TEMPLATES if len(own & shingles(word.findall(t.lower()))) >= 0.8 * len(shingles(word.findall(t.lower())))}
        total += len(want)
        missed += len(want - found[doc])
        extra += len(found[doc] - want)
    assert total >= 150 and extra == 0 and missed <= 0.01 * total
    assert LS.license_scan(odd).count() == odd.count() and LS.license_scan(empty).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    def luhn(s):
        total = 0
        for k, c in enumerate(reversed(s)):
            d = int(c) * (1 + k % 2)
            total += d // 10 + d % 10
        return total % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {"email": [m.span() for m in EMAIL.finditer(text)],
            "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))],
            "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
            "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.b@-1234567890 +()_%.@0é", max_size=40))
def test_base_spans(text):
    assert P.base_spans(text) == brute_base(text)


def test_base_spans_are_linear_in_runs():
    for run in ("a" * 200_000, "1" * 3000 + ".", "a@" * 50_000, "+1" + "(" * 100_000):
        P.base_spans(run)


def test_pii_over_a_table(spark, odd, empty):
    rows = [(1, "mail bob.1@mail3.example.com or +1 (555) 010-9999, ip 10.0.0.1, card 4111 1111 1111 1111"),
            (2, 'the token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" here'), (3, "nothing here to see at all. It is the end"),
            (4, None), (4, None), (5, "version 1.2.33.4444 of 2024-11-12, 12.345.678,90 and 3.14"), (None, "+1 (555) 010-9999")]
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = P.learn(corpus)
    assert trees is not None and trees.thresholds["secret"] < 1
    got = {(r.doc_id, r.n_phone): r for r in P.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), trees=trees, with_text=True).collect()}
    one = got[(1, 1)]
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1)
    assert one.redacted == "mail [EMAIL] or [PHONE], ip [IP], card [CARD]"
    assert "secret:" in got[(2, 0)].spans and "f578ae" not in got[(2, 0)].redacted
    assert got[(3, 0)].spans == "" and got[(5, 0)].redacted.endswith("3.14") and got[(None, 1)].n_phone == 1
    assert P.find_pii(odd).count() == odd.count() and P.find_pii(empty).count() == 0
    same = P.redact(odd)
    assert same.columns == odd.columns and same.filter("text is null").count() == odd.filter("text is null").count()


def test_language_on_held_out_rows(spark, odd, odd_texts, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    found = L.language_id(odd).collect()
    blank = sum(not any(c.isalpha() for c in t or "") for _, t in odd_texts)
    assert len(found) == len(odd_texts) and sum(r.lang_pred == "und" for r in found) == blank
    assert all(r.score == 0 for r in found if r.lang_pred == "und") and all(0 <= r.score <= 1 for r in found)
    assert L.language_id(empty).count() == 0
    assert L.known_language(odd).count() == len(odd_texts) - blank and L.known_language(odd).columns == odd.columns


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 40])
def test_codewords_lie_apart(n):
    code = L.codewords(n)
    apart = [(a != b).sum() for k, a in enumerate(code) for b in code[:k]]
    assert code.shape[0] == n and (not apart or min(apart) >= (code.shape[1] + 1) // 2 - code.shape[1] // 4)


def test_toxicity_on_held_out_rows(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = T.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    hits = sum(r.predicted == 1 == r.toxic for r in held)
    flagged, toxic = sum(r.predicted for r in held), sum(r.toxic for r in held)
    assert 0 < toxic < 0.2 * len(held)
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)
    assert hits >= 0.75 * toxic and hits >= 0.6 * flagged, (hits, toxic, flagged, len(held))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.toxicity(odd, none).filter("score <> 0").count() == 0 and T.toxicity(empty, labels).count() == 0


def test_training_rows_do_not_depend_on_partitions(spark):
    """Ids with several texts give the same sample from any partitioning, one text an id."""
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(200)] + [(None, "x"), (3, None), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(5, 0), (None, 1)], "doc_id long, toxic int")
    s = T.Settings(rows=10)
    got = [[tuple(r) for r in T.training_rows(docs.repartition(n), labels, s, "doc_id", "text", "doc_id", "toxic")] for n in (1, 7, 30)]
    assert got[0] == got[1] == got[2] and sorted(label for _, label in got[0]) == [0] * 10 + [1] * 10


def test_network_against_a_plain_loop():
    """Logits of whole batches against one word, gate and window at a time, padding never visited."""
    s = T.Settings(buckets=64, hidden=3, word_size=2, char_size=2, length=6, stride=4)
    words = T.Words(["ab cde fghij klmno ab cde q ab xyzzy", "xyzzy cde q"], 64)
    draw = np.random.default_rng(1)
    net = T.Network(s, draw.standard_normal((64, 2)), draw.standard_normal((64, 2)))
    _, first, size = T._spread(words, s, None)
    at, mask = T._layout(first, size, words.index, s.length)
    p, h, vectors = net.p, net.h, words.embed(net.p["words"], net.p["chars"])
    gate = lambda v: 1 / (1 + np.exp(-v))

    def states(side, inputs):
        state, out = np.zeros(h), []
        for x in inputs:
            given, inner = x @ p[f"x{side}"] + p[f"b{side}"], state @ p[f"h{side}"]
            keep, reset = gate(given[:h] + inner[:h]), gate(given[h:2 * h] + inner[h:2 * h])
            state = (1 - keep) * np.tanh(given[2 * h:] + reset * inner[2 * h:]) + keep * state
            out.append(state)
        return out
    want = []
    for a, n in zip(first, size):
        inputs = [vectors[words.index[k]] for k in range(a, a + n)]
        both = [np.concatenate(pair) for pair in zip(states("f", inputs), states("b", inputs[::-1])[::-1])]
        weight = np.exp([np.tanh(b @ p["attend"] + p["attend_b"]) @ p["query"] for b in both])
        want.append(sum(w * b for w, b in zip(weight / weight.sum(), both)) @ p["out"] + p["out_b"][0])
    assert len(want) > 2 and np.allclose(net.forward(vectors, at, mask), want, atol=1e-5)


def test_network_gradients():
    s = T.Settings(buckets=64, hidden=3, word_size=2, char_size=2, length=6, stride=4)
    words = T.Words(["ab cde fghij klmno ab", "xyzzy cde q", ""], 64)
    draw = np.random.default_rng(0)
    net = T.Network(s, draw.standard_normal((64, 2)), draw.standard_normal((64, 2)))
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    _, first, size = T._spread(words, s, None)
    at, mask = T._layout(first, size, words.index, s.length)

    def loss():
        return net.forward(words.embed(net.p["words"], net.p["chars"]), at, mask).sum()
    keep = {}
    vectors = words.embed(net.p["words"], net.p["chars"])
    net.forward(vectors, at, mask, keep)
    grads = net.gradients(words, vectors, at, mask, np.ones(first.size), keep)
    for name, value in net.p.items():
        for index in list(np.ndindex(value.shape))[:25]:
            own = value[index]
            value[index] = own + 1e-3
            up = loss()
            value[index] = own - 1e-3
            down = loss()
            value[index] = own
            assert abs((up - down) / 2e-3 - grads[name][index]) < 1e-4, name


def test_windows_cover_every_word():
    for n in range(1, 200):
        seen = {k for a in T.windows_of(n, 48, 40) for k in range(a, min(a + 48, n))}
        assert seen == set(range(n))
