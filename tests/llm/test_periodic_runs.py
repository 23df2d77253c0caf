"""Periodic runs against brute force: Lyndon arrays, common extensions, runs and the whole operator."""

import hashlib
import random
import zlib

import numpy as np
from conftest_llm import SPACED

from larder.llm import periodic_runs as R


def lyndon_brute(w):
    """Longest Lyndon sequence by start: one that is smaller than all its own proper ends."""
    return [max(k for k in range(1, len(w) - i + 1) if all(w[i:i + k] < w[i + d:i + k] for d in range(1, k)))
            for i in range(len(w))]


def runs_brute(w, min_length=2):
    """All maximal repetitions, each with its smallest period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            k = i
            while k + p < len(w) and w[k] == w[k + p]:
                k += 1
            if k - i >= p and k + p - i >= min_length:
                found.setdefault((i, k + p - i), p)
            i = max(k, i) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def sequences():
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 5, 8, 13, 30, 64]:
        for letters in (1, 2, 3, 10):
            for _ in range(12):
                yield [rng.randrange(letters) for _ in range(n)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 100:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield [bin(i).count("1") % 2 for i in range(128)]
    for _ in range(60):
        base = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        yield [9] * rng.randint(0, 3) + base * rng.randint(2, 6) + base[:rng.randint(0, len(base))] + [rng.randrange(3) for _ in range(7)]


def dense(w):
    number = {c: k for k, c in enumerate(sorted(set(w)))}
    return [number[c] for c in w]


def test_lyndon_arrays_from_grouping():
    for w in map(dense, sequences()):
        top = max(w, default=0)
        assert R.lyndon_array(w) == lyndon_brute(w), w
        turned = [top - c for c in w]
        assert R.lyndon_array(turned) == lyndon_brute(turned), w


def test_common_extensions():
    for w in map(dense, sequences()):
        if len(w) < 2:
            continue
        lce = R.Extensions(np.array(w))
        pairs = [(i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)]
        i, j = (np.array(x) for x in zip(*pairs))
        right = [next((k for k in range(len(w) - b) if w[a + k] != w[b + k]), len(w) - b) for a, b in pairs]
        left = [next((k for k in range(a) if w[a - 1 - k] != w[b - 1 - k]), a) for a, b in pairs]
        assert lce.right(i, j).tolist() == right and lce.left(i, j).tolist() == left


def test_runs():
    for w in map(dense, sequences()):
        for least in (2, 5, 12):
            assert [tuple(r) for r in R.runs(w, least).tolist()] == runs_brute(w, least), w


def test_text_runs_leave_nothing_out():
    rng = random.Random(8)
    for _ in range(150):
        words = []
        while len(words) < 120:
            base = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            words += rng.choice([base, base * rng.randint(2, 5), [f"x{rng.random()}"] * rng.randint(1, 14)])
        raw = " ".join(words).encode()
        prints = R.word_hashes(raw, *R.word_spans(raw))
        assert [tuple(r) for r in R.text_runs(raw.split(), prints).tolist()] == runs_brute(words, 12)


def expected(doc_id, text):
    w = SPACED.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(runs_brute(w, 12) if n < 3000 else [], key=lambda r: (r[0], r[2]))
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_operator_on_odd_rows(spark, odd, odd_texts, empty):
    short = [(i, t) for i, t in odd_texts if len(t or "") < 12_000]
    keep = odd.filter("text is null or length(text) < 12000")
    more = [(i, t) for i in range(9200, 9330) for t in ("a b c " * 40, "p " * 12, "p " * 11, "q r " * 6 + "q s", "Ü ü " * 9)]
    frame = keep.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = R.periodic_runs(frame.selectExpr("*", "'x' AS id", "1 AS start", "2 AS n_runs"), rewrite=R.repeat_tail)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*r) for r in short + more), key=str)
    assert sum(R.repeat_tail(i, 50) is not None for i in range(9200, 9330)) > 3
    assert R.periodic_runs(empty).collect() == []


def test_long_text_in_linear_memory(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(500)}" for _ in range(50_000)]
    text = " ".join(words + words + ["tail"] * 20_000)
    row = R.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 0, 100_000, 50_000, 2000)
    kept = " ".join(words + ["tail"])
    assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
