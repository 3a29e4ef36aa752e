"""Chunk store by buckets."""

import hashlib

from plans import plan_of

from textward.operators.kb import latest
from textward.sources import chunk_store as cs


def batch(spark, rows):
    data = [(hashlib.md5(t.encode()).hexdigest(), t, url, v) for t, url, v in rows]
    return spark.createDataFrame(data, "chunk_id string, text string, url string, embedding array<float>")


def state(spark, store):
    return {r["text"]: (r["url"], r["batch_no"], r["embedding"]) for r in cs.current(spark, store).collect()}


def test_versions_replay_vectors_and_compaction(spark, tmp_path):
    store = cs.open_store(spark, str(tmp_path / "kb"), buckets=4)
    assert state(spark, store) == {}
    cs.append(spark, store, batch(spark, [("a", "u1", None), ("b", "u2", [1.0]), ("b", "u1", [1.0])]), 0)
    second = batch(spark, [("b", "u9", None), ("c", None, [2.0]), ("a", "u5", [3.0])])
    cs.append(spark, store, second, 1)
    want = {"a": ("u5", 1, [3.0]), "b": ("u9", 1, [1.0]), "c": (None, 1, [2.0])}
    assert state(spark, store) == want
    texts = [(r["text"], r["part"]) for r in spark.table(store.bodies).collect()]
    assert sorted(texts) == [("a", 0), ("a", 1), ("b", 0), ("c", 1)]  # b: the version only
    cs.append(spark, store, batch(spark, [("b", "u0", [1.0])]), 2)
    want["b"] = ("u0", 2, [1.0])
    for again in (1, 0):  # earlier batches run again behind later ones
        rows = second if again else batch(spark, [("a", "u1", None), ("b", "u1", [1.0])])
        cs.append(spark, store, rows, again)
        assert state(spark, store) == want
    small = cs.compact(spark, store, str(tmp_path / "small"))
    assert state(spark, small) == want
    assert spark.table(small.bodies).count() == 3
    cs.append(spark, small, batch(spark, [("c", "u7", None), ("d", "", None)]), 3)
    assert state(spark, small) == want | {"c": ("u7", 3, [2.0]), "d": ("", 3, None)}
    # another session knows nothing of the tables and of the number of buckets
    spark.sql(f"DROP TABLE {small.bodies}")
    spark.sql(f"DROP TABLE {small.versions}")
    reopened = cs.open_store(spark, str(tmp_path / "small"), buckets=7)
    assert reopened.buckets == 4 and len(state(spark, reopened)) == 4


def test_last_batch_may_change(spark, tmp_path):
    store = cs.open_store(spark, str(tmp_path / "kb"), buckets=2)
    cs.append(spark, store, batch(spark, [("a", "u", None), ("b", "u", None)]), 0)
    cs.append(spark, store, batch(spark, [("c", "u", None)]), 0)
    assert set(state(spark, store)) == {"c"}
    cs.append(spark, store, batch(spark, []), 1)
    assert set(state(spark, store)) == {"c"}


def test_reading_shuffles_nothing(spark, tmp_path):
    store = cs.open_store(spark, str(tmp_path / "kb"), buckets=4)
    cs.append(spark, store, batch(spark, [(f"t{i}", "u", None) for i in range(100)]), 0)
    cs.append(spark, store, batch(spark, [(f"t{i}", "v", None) for i in range(50, 150)]), 1)
    plan = plan_of(cs.current(spark, store))
    assert "Exchange" not in plan and "Broadcast" not in plan


def test_texts_are_dealt_once(spark, tmp_path, monkeypatch):
    store = cs.open_store(spark, str(tmp_path / "kb"), buckets=4)
    cs.append(spark, store, batch(spark, [(f"t{i}", "u", None) for i in range(50)]), 0)
    staged, written = [], []
    stage, write = cs.stage, cs._write
    monkeypatch.setattr(cs, "stage", lambda df, *a: (staged.append(plan_of(df)), stage(df, *a))[1])
    monkeypatch.setattr(cs, "_write", lambda df, *a: (written.append(plan_of(df)), write(df, *a))[1])
    cs.append(spark, store, batch(spark, [(f"t{i}", "v", None) for i in range(25, 75)]), 1)
    assert [p.count("Exchange hashpartitioning") for p in staged] == [1]
    assert len(written) == 2 and not any("Exchange" in p for p in written)
    assert len(state(spark, store)) == 75


def test_copies_in_one_batch_of_rows(spark):
    rows = [
        (c, url, topic, no, f"{c}{url}{topic}{no}", 0)
        for c in ("a", "b", None)
        for url in ("u2", None, "Z", "é")
        for topic in (None, "t", "T")
        for no in (2, None, 1)
    ]
    rows = [r for r in rows if r[0] != "b" or r[1] is not None]
    types = "chunk_id string, url string, topic string, chunk_no int, text string, batch_no int"
    df = spark.createDataFrame(rows, types).where("chunk_id IS NOT NULL").coalesce(1)
    got = df.mapInArrow(cs._first_copies, df.schema)
    assert got.count() == 2
    assert sorted(got.collect()) == sorted(latest(df).collect())
