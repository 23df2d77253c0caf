"""Filter interaction audit against a plain loop over documents, orders and steps."""

from itertools import permutations

import pytest

from larder.llm import filter_audit as A

from conftest_llm import SF, SPACED


def brute(rows, labels):
    """rows (doc_id, text, source); labels (doc_id, quality, toxic)."""
    fails = []
    for i, text, _ in rows:
        text = text or ""
        w = SPACED.findall(text)
        f = {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
        f |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else set()
        fails.append(f)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                total[c] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(c in f for _, f in mine) - len(gone), sum(f == {c} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def labelled(spark):
    known = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    return known.unionByName(spark.createDataFrame(
        [(9003, 1, 0), (9003, 0, 1), (9007, 1, None), (9008, None, 1), (None, 1, 1), (9015, 1, 1), (-5, 1, 1)], known.schema))


def test_audit_against_brute_force(spark, odd, labelled):
    more = spark.createDataFrame([(9100, "same " * 60, None), (9101, "same " * 60, ""), (9101, "same " * 60, "x"),
                                  (9100, "same " * 60, "x"), (None, "same " * 60, "x"), (9102, "", "x"), (9103, "Ä" * 95 + "ABCDE", "x"),
                                  (9104, "Ä" * 94 + "ABCDEF", "x")], "doc_id long, text string, source string")
    docs = odd.select("doc_id", "text", "source").unionByName(more)
    clashing = docs.selectExpr("*", "'c' AS id", "'c' AS part", "'c' AS state", "'c' AS n", "'c' AS digest", "'c' AS label")
    expected = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in labelled.collect()])
    assert result(A.filter_audit(clashing, labelled.selectExpr("*", "1 AS good", "2 AS id"))) == expected
    assert result(A.filter_audit(clashing.repartition(23), labelled)) == expected


def test_empty_tables(spark, odd, empty, labelled):
    assert A.filter_audit(empty, labelled).collect() == []
    found = result(A.filter_audit(odd, labelled.limit(0)))
    assert len(found) % 600 == 0 and all(v[4] == v[5] == 0 for v in found.values())


def test_fields_do_not_overflow():
    weights = {s: (1 << 48) + 977 * s for s in range(128)}
    columns = A.unpacked(sum(n * A.packed(s) for s, n in weights.items()))
    steps = [(o, t) for o in A.orders() for t in range(5)]
    for at in (0, 1, 7, 299, 598, 599):
        order, t = steps[at]
        bit = 1 << A.FILTERS.index(order[t])
        before = sum(1 << A.FILTERS.index(c) for c in order[:t])
        here = [s for s in weights if s & bit and not s & before]
        assert columns["removed"][at] == sum(weights[s] for s in here)
        assert columns["redundant"][at] == sum(weights[s] for s in weights if s & bit and s & before)
        assert columns["kept"][at] == sum(weights[s] for s in weights if not s & (before | bit))
        assert columns["good_lost"][at] == sum(weights[s] for s in here if s & 32)
        assert columns["toxic_lost"][at] == sum(weights[s] for s in here if s & 64)
        assert columns["unique_fails"][at] == sum(weights[s] for s in weights if s & 31 == bit)
    small = A.unpacked(3 * A.packed(0b00001) + 2 * A.packed(0b00011))
    assert small["shapley"][0] == 3 * 120 + 2 * 60 and small["shapley"][1] == 2 * 60
