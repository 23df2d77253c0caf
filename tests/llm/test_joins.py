"""Jaccard join, substring dedup and decontamination against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest_llm import LOWER, SF, SPACED, ordered

from larder.llm import oracles
from larder.llm.components import components
from larder.llm.decontamination import decontaminate, uncontaminated
from larder.llm.jaccard_join import _maybe_among, _mixed, _shown, jaccard_components, one_of_each
from larder.llm.shared import row_key, stored, without
from larder.llm.substring_dedup import least_positions, remove_repeats
from larder.llm.wordhash import covered, repeated_window_words, text_words, window_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_components(rows, width=5, percent=80):
    sets = []
    for _, text in rows:
        w = SPACED.findall((text or "").translate(LOWER))
        k = min(width, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i)), find(i)) for i, (doc, _) in enumerate(rows)]


def brute_repeats(rows, width):
    words = [SPACED.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_leaks(rows, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins[tuple(w[i:i + window])].add(item)
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (own := tuple(w[i:i + k])) in wins:
                    hit.update(range(i, i + k))
                    found |= {str(x) for x in wins[own] if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_jaccard_against_brute_force(odd, odd_texts):
    got = jaccard_components(odd).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(r[:3] for r in brute_components(odd_texts))


def test_jaccard_oracle_sql(odd_texts):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rows = [(d, t) for d, t in odd_texts if d is not None and d < 9000]
    assert ordered(con.execute(oracles.jaccard_sql()).fetchall()) == ordered(r[:3] for r in brute_components(rows))


def test_near_copy_group_is_whole(spark):
    """A hundred near copies whose chains of edits reach beyond 0.8 of the first."""
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for k in range(100):
        own = list(words)
        for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            own[at] = f"e{k}x{at}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(docs, pivots=1).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(r[:3] for r in brute_components(rows))


def test_near_copies_under_the_limit_to_every_pivot(spark):
    """Forty variants of one text, each too far from all others, each with its own close copies: every variant is a
    component, whichever classes serve as pivots."""
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for k in range(40):
        variant = list(words)
        for at in rng.choice(120, 6, replace=False):
            variant[at] = f"e{k}x{at}"
        for c in range(3):
            own = list(variant)
            if c:
                own[int(rng.integers(0, 120))] = f"c{k}x{c}"
            rows.append((len(rows), " ".join(own)))
    want = brute_components(rows)
    assert len({r[2] for r in want}) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for pivots in (1, 4):
        got = jaccard_components(docs, pivots=pivots).select("doc_id", "n_shingles", "component_id").collect()
        assert ordered(got) == ordered(r[:3] for r in want)


def test_one_of_each_with_clashing_columns(spark):
    names = ["id", "part", "row", "keep", "component", "__id", "__a"]
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text + " more"), (3, ""), (None, None), (None, None), (4, "other words")]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows],
                                 "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert ordered(tuple(r)[:2] for r in kept.collect()) == ordered([(1, text), (3, ""), (None, None), (None, None), (4, "other words")])
    assert {tuple(r)[2:] for r in kept.collect()} == {tuple(range(len(names)))}


def test_one_of_each_keeps_a_row_of_every_component(odd, odd_texts):
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    groups = {r[3] for r in brute_components(odd_texts) if r[1]}
    blanks = sum(not SPACED.search(t or "") for _, t in odd_texts)
    assert kept.count() == len(groups) + blanks


def test_texts_that_no_pair_wants_are_left_out_before_the_join(spark):
    rows = spark.createDataFrame([(i if i % 7 else None, i * 31 - 400, f"text {i}") for i in range(2000)], "id long, part long, text string")
    keys = rows.filter("part % 40 = 0 OR id IS NULL AND part % 3 = 0").select("id", "part")
    want = {(r.id, r.part) for r in keys.collect()}
    for bits, most in ((1 << 24, len(want) + 5), (64, 2000), (1, 2000)):
        got = _maybe_among(rows, keys, bits).collect()
        assert want <= {(r.id, r.part) for r in got} and len(got) <= most
        assert all(r.text == f"text {(r.part + 400) // 31}" for r in got)
    assert _maybe_among(rows, keys.limit(0)).count() == 0


def shuffled_rows(df):
    """Rows that the plan of ``df``, which has run, wrote to its shuffles."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(k)) for k in range(node.children().size()))
    return walk(df._jdf.queryExecution().executedPlan())


def test_rows_without_a_key_are_not_shuffled(spark):
    """Of a table that loses few rows, and by a join that is not broadcast, the rows that stay are not moved."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    docs = session.createDataFrame(
        [(i if i % 7 else None, f"text {i}" if i % 5 else None, i, "x") for i in range(2000)] * 2, "doc_id long, text string, id int, word string")
    own, part = row_key(docs)
    keys = stored(docs.filter("id % 40 in (3, 35)").select(own.alias("id"), part.alias("part")).distinct(), "keys")
    held = {tuple(r) for r in keys.collect()}
    rows = docs.select("*", own, part).collect()
    want = {how: ordered(r[:4] for r in rows if (r[4:] in held) == (how == "left_semi")) for how in ("left_anti", "left_semi")}
    assert len(want["left_semi"]) > 200 and any(r[0] is None for r in want["left_semi"])
    for how, bits in (("left_anti", 1 << 24), ("left_semi", 1 << 24), ("left_anti", 64), ("left_semi", 64), ("left_anti", 1)):
        got = without(docs, keys, how, bits=bits)
        assert got.columns == docs.columns and ordered(got.collect()) == want[how]
    for how in ("left_anti", "left_semi"):
        got = without(docs, keys, how)
        got.collect()
        assert len(want["left_semi"]) <= shuffled_rows(got) < 2000
        assert ordered(without(docs, keys.limit(0), how).collect()) == (ordered(r[:4] for r in rows) if how == "left_anti" else [])


def test_rows_of_a_token_are_shuffled_once(spark):
    rows = spark.createDataFrame([(t, t * 10 + k % (t % 3 + 1)) for t in range(30) for k in range(4)], "token long, grp long")
    out = _mixed(rows.repartition("token"), "grp").dropDuplicates(["token", "grp"])
    assert sorted(map(tuple, out.collect())) == [(t, t * 10 + k) for t in range(30) for k in range(t % 3 + 1) if t % 3]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_pairs_that_meet_by_chance_are_not_read(spark, monkeypatch):
    """Texts that share one phrase of their front are candidates, but not verified; near copies among them still link."""
    from larder.llm import jaccard_join as J

    rows = [(k, " ".join(["one", "two", "three", "four", "five"] + [f"w{k}x{i}" for i in range(60)])) for k in range(30)]
    rows += [(100 + k, rows[k][1] + " more") for k in range(5)]
    asked = []
    monkeypatch.setattr(J, "verified", lambda pairs, *a, f=J.verified: asked.append(pairs.count()) or f(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(docs, common=0).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(r[:3] for r in brute_components(rows))
    assert sum(asked) < 60
    held = spark.createDataFrame([(1, 7), (2, 7), (1, 8), (2, 8), (3, 8), (1, 9)], "vid long, token long")
    pairs = spark.createDataFrame([(1, 2, 5, 6), (1, 3, 5, 7), (3, 4, 1, 1)], "a long, b long, n long, m long")
    assert ordered(_shown(pairs, held).collect()) == ordered([(1, 2, 5, 6, 2), (1, 3, 5, 7, 1)])


def test_copies_with_many_edits_form_few_pairs(spark, monkeypatch):
    """Variants of one text, each with so many edits that none links with another, and two close copies of some: a pair is
    formed only if enough of its first shingles are open, and its shared shingles are counted in one row a pair."""
    from larder.llm import jaccard_join as J

    rng = np.random.default_rng(11)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for k in range(40):
        variant = list(words)
        for at in rng.choice(120, 24, replace=False):
            variant[at] = f"e{k}x{at}"
        for c in range(3 if k % 8 == 0 else 1):
            own = list(variant)
            for at in rng.choice(120, c, replace=False):
                own[at] = f"c{k}x{c}x{at}"
            rows.append((len(rows), " ".join(own)))
    want = brute_components(rows)
    formed = {}

    def stored(df, name, f=J.stored):
        out = f(df, name)
        if name == "open-pairs":
            formed[name] = out.count()
        return out
    monkeypatch.setattr(J, "stored", stored)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for common in (0, 1 << 20):  # by fingerprint alone, own shingles are spread over the whole order
        got = jaccard_components(docs, common=common, pivots=1).select("doc_id", "n_shingles", "component_id").collect()
        assert ordered(got) == ordered(r[:3] for r in want)
        assert formed.pop("open-pairs") < 60
    held = spark.createDataFrame([(v, t) for v in range(6) for t in range(40)], "vid long, token long")
    pairs = spark.createDataFrame([(a, b, 50, 50) for b in range(6) for a in range(b)], "a long, b long, n long, m long")
    plan = _shown(pairs, held)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join .*token", plan) and {r.c for r in _shown(pairs, held).collect()} == {40}


def test_open_shingles_bound_the_overlap(spark):
    """No linked pair is left out by where prefixes end and how many open shingles they hold, at any limit."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(120):
        own = [f"v{i}" for i in range(int(rng.integers(20, 40)))]
        for at in rng.choice(len(own), int(rng.integers(0, 4)), replace=False):
            own[at] = f"e{int(rng.integers(0, 3))}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, common in ((60, 0), (80, 0), (90, 40)):
        got = jaccard_components(docs, width=2, percent=percent, common=common, pivots=1).select("doc_id", "n_shingles", "component_id")
        assert ordered(got.collect()) == ordered(r[:3] for r in brute_components(rows, 2, percent))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (3, 2)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


@pytest.mark.parametrize("limit", [20_000, 2])
def test_substring_against_brute_force(odd, odd_texts, limit):
    got = remove_repeats(odd, width=12, seed=4, group_limit=limit).collect()
    assert ordered(got) == ordered(brute_repeats(odd_texts, 12))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination_against_brute_force(spark, odd, odd_texts, limit):
    """With the windows' tables broadcast and, at limit 0, with every join shuffled."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(None, "one two three"), (501, None), (502, ""), (503, "ONE"), (503, "near1 near2"), (504, "!!"), (505, "a b a b a b a b a b a")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(odd_texts, items)
    got = decontaminate(odd, table, broadcast_rows=limit).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert ordered(got) == ordered(want)
    assert uncontaminated(odd, table).count() == sum(not r[5] for r in want)


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_components(empty).count() == remove_repeats(empty).count() == decontaminate(empty, items).count() == 0


def test_empty_benchmark_leaves_all_clean(spark, odd):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(odd, items).filter("contaminated").count() == 0


def test_word_fingerprints():
    a = text_words("ab  cd\tab\x0bcd é é".encode())
    assert a.size == 6 and a[0] == a[2] and a[1] == a[3] and a[4] == a[5] and len(set(a.tolist())) == 3
    w = window_hashes(a, 2)
    assert w[0] == w[2] and len(set(w.tolist())) == 4 and window_hashes(a, 7).size == 0
    assert repeated_window_words(a, 2) == 4 and repeated_window_words(a[:0], 5) == 0
    values = np.random.default_rng(1).integers(0, 9, 50)
    assert least_positions(values, 7).tolist() == [i + int(values[i:i + 7].argmin()) for i in range(44)]
    assert covered(np.array([0, 3]), 2, 6).tolist() == [True, True, False, True, True, False]
