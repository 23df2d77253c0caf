"""Versioned datasets, the keyed store and the commit sink: what readers see, what races do, what stays untouched."""

import os

import pytest
from pyspark.sql import functions as F

from larder.operators import keyed_store as KS
from larder.operators.publish import last_by_id
from larder.sources import document_sink as DS
from larder.sources import versions as V


def frame(spark, rows, schema="id string, v long"):
    return spark.createDataFrame(rows, schema)


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(base):
    return {os.path.join(d, f) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def test_replace_makes_the_new_rows_current(spark, scratch):
    base = f"{scratch}/set"
    with pytest.raises(FileNotFoundError):
        V.read_version(spark, base)
    V.replace_dataset(frame(spark, [("a", 1)]), base)
    old = V.read_version(spark, base)
    # the new version may be made of the one that it replaces
    V.replace_dataset(old.withColumn("v", F.col("v") + 1), base)
    assert pairs(V.read_version(spark, base)) == [("a", 2)]
    assert pairs(V.read_version(spark, base, 1)) == pairs(old) == [("a", 1)]
    assert V.history(spark, base) == [1, 2]
    V.replace_dataset(frame(spark, []), base)
    assert V.read_version(spark, base).collect() == []
    assert V.read_version(spark, base).columns == ["id", "v"]


def test_a_lost_race_raises_and_leaves_nothing(spark, scratch):
    base = f"{scratch}/set"
    V.replace_dataset(frame(spark, [("a", 1)]), base)
    V.replace_dataset(frame(spark, [("a", 2)]), base, expected=1)
    before = files(base)
    with pytest.raises(V.VersionConflict):
        V.replace_dataset(frame(spark, [("a", 3)]), base, expected=1)
    assert files(base) == before and pairs(V.read_version(spark, base)) == [("a", 2)]


def test_two_writers_at_the_same_moment(spark, scratch, monkeypatch):
    """The second one has looked before the first one publishes: the rename itself refuses."""
    base = f"{scratch}/set"
    V.replace_dataset(frame(spark, [("a", 1)]), base)
    V.replace_dataset(frame(spark, [("a", 2)]), base)
    monkeypatch.setattr(V, "history", lambda *_: [1])
    with pytest.raises(V.VersionConflict, match="another writer"):
        V.publish(spark, base, {"": []}, frame(spark, []).schema, 1)
    monkeypatch.undo()
    assert pairs(V.read_version(spark, base)) == [("a", 2)]
    assert not [f for f in os.listdir(f"{base}/_manifests") if f.startswith(".0") and not f.endswith(".crc")]


def test_prune_keeps_the_latest(spark, scratch):
    base = f"{scratch}/set"
    for k in range(4):
        V.replace_dataset(frame(spark, [("a", k)]), base)
    V.replace_dataset(frame(spark, [("a", 9)]), base, keep=2)
    assert V.history(spark, base) == [4, 5]
    assert len({f.split("/v-")[1].split("/")[0] for f in files(base)}) == 2
    assert pairs(V.read_version(spark, base, 4)) == [("a", 3)]
    with pytest.raises(FileNotFoundError):
        V.read_version(spark, base, 1)
    with pytest.raises(ValueError):
        V.prune(spark, base, 0)


def test_upsert_touches_only_the_buckets_of_its_keys(spark, scratch):
    base = f"{scratch}/store"
    KS.create_store(frame(spark, [(f"k{i}", i) for i in range(200)] + [(None, 1)]), base, buckets=16)
    first = V.version(spark, base)
    before = files(base)
    updates = frame(spark, [("k3", 1, 1), ("k3", 2, 3), ("k3", 3, 2), ("new", 5, 1), (None, 6, 1)], "id string, v long, n long")
    second = KS.upsert_store(updates, base, "n")
    touched = {b for b in first.folders.keys() | second.folders.keys() if first.folders.get(b) != second.folders.get(b)}
    assert 1 <= len(touched) <= 2 and before <= files(base)
    unchanged = [b for b in first.folders if b not in touched]
    assert first.paths(base, unchanged) == second.paths(base, unchanged) and len(unchanged) >= 13
    expected = {f"k{i}": i for i in range(200)} | {"k3": 2, "new": 5}
    assert dict(pairs(V.read_version(spark, base))) == expected
    assert dict(pairs(V.read_version(spark, base, 1))) == {f"k{i}": i for i in range(200)}
    assert pairs(KS.lookup(spark, base, frame(spark, [("k3", 0), ("k7", 0), ("none", 0), (None, 0)]))) == [("k3", 2), ("k7", 7)]
    assert KS.upsert_store(updates.limit(0), base, "n").number == 2
    V.prune(spark, base, 1)
    assert dict(pairs(V.read_version(spark, base))) == expected


def test_overtaken_upsert_starts_again(spark, scratch, monkeypatch):
    base = f"{scratch}/store"
    KS.create_store(frame(spark, [("a", 1), ("b", 1)]), base, buckets=2)
    real, others = KS.publish, []

    def overtaken(*args):
        if not others:
            others.append(KS.upsert_store.__name__)
            monkeypatch.setattr(KS, "publish", real)
            KS.upsert_store(frame(spark, [("a", 2), ("c", 2)]), base)
        return real(*args)
    monkeypatch.setattr(KS, "publish", overtaken)
    assert KS.upsert_store(frame(spark, [("b", 3), ("c", 3)]), base).number == 3
    assert pairs(V.read_version(spark, base)) == [("a", 2), ("b", 3), ("c", 3)]
    with pytest.raises(V.VersionConflict):
        KS.create_store(frame(spark, []), base)


def test_empty_store(spark, scratch):
    base = f"{scratch}/store"
    KS.create_store(frame(spark, []), base)
    assert V.read_version(spark, base).collect() == []
    KS.upsert_store(frame(spark, [("a", 1)]), base)
    assert pairs(V.read_version(spark, base)) == [("a", 1)]


def test_last_by_id_is_the_same_in_every_order(spark):
    rows = [("a", 1, 1), ("a", 2, 2), ("a", 3, 2), ("a", 4, None), ("b", 5, None)]
    results = {tuple(pairs(last_by_id(frame(spark, list(order), "id string, v long, n long").repartition(k), "n")))
               for k, order in ((1, rows), (3, rows[::-1]), (5, rows[2:] + rows[:2]))}
    assert len(results) == 1 and dict(results.pop())["a"] in (2, 3)


def documents(spark, n):
    return spark.createDataFrame([(f"{i:04d}", "x" * (300 if i == 123 else 5)) for i in range(n)], "id string, title string")


def test_a_failing_commit_loses_only_its_rows(spark, scratch):
    done = DS.commit_documents(documents(spark, 230).repartition(7), scratch, size=50, max_bytes=200)
    assert (done.total, done.success, done.failed, done.skipped, done.commits, done.failed_commits) == (230, 180, 50, 0, 5, 1)
    failures = done.failures.collect()
    assert {r.id for r in failures} == {f"{i:04d}" for i in range(100, 150)} and {r.chunk for r in failures} == {2}
    assert {r.error for r in failures} == {f"0123: document of 324 bytes exceeds 200"}
    stored = done.stored.collect()
    assert sorted(r.id for r in stored) == [f"{i:04d}" for i in range(230) if not 100 <= i < 150]
    assert all(r.chunk == int(r.id) // 50 for r in stored)


def test_patches_skip_missing_documents(spark, scratch):
    existing = spark.createDataFrame([(f"{i:04d}",) for i in range(0, 230, 2)] * 2, "id string")
    done = DS.commit_documents(documents(spark, 230), scratch, size=DS.PATCH_COMMIT, existing=existing)
    assert (done.total, done.success, done.failed, done.skipped) == (230, 115, 0, 115)
    again = DS.commit_documents(documents(spark, 3), scratch, size=2)
    assert (again.total, again.commits, again.stored.count()) == (3, 2, 3)
    none = DS.commit_documents(documents(spark, 3).limit(0), scratch)
    assert (none.total, none.commits, none.stored.count(), none.failures.count()) == (0, 0, 0, 0)


def test_rows_without_an_id_fail_their_commit(spark, scratch):
    docs = spark.createDataFrame([("a", "t"), (None, "t")], "id string, title string")
    done = DS.commit_documents(docs, scratch, size=1)
    assert (done.success, done.failed, done.failures.first().error) == (1, 1, "None: id is required")


def test_an_aborted_job_leaves_no_file(spark, scratch):
    writer = DS.CommitWriter(scratch, "job", 100)
    os.makedirs(f"{scratch}/commits")
    open(f"{scratch}/commits/one.json", "w").close()
    writer.abort([DS.TaskOutcome({}, ["one.json"], []), None])
    assert os.listdir(f"{scratch}/commits") == []
