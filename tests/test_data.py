"""Stores, retrieval, grounding, evaluation sets, metrics, streams."""

import numpy as np
import pandas as pd
import pytest
from plans import plan_of
from pyspark.sql import functions as F

from textward import schemas
from textward.functions.vectors import hash_embedding
from textward.operators import chat, evalset, grounding, kb, metrics, retrieval
from textward.operators.skew import join_hot
from textward.plans import flows
from textward.session import scratch_dir
from textward.sources import logs, sinks, tables
from textward.streaming import screening as streams


def brute(q, c, k):
    out = []
    for qid, v in q:
        scored = []
        for cid, w in c:
            size = np.linalg.norm(v) * np.linalg.norm(w)
            cos = float(np.dot(v, w) / size) if size else 0.0
            scored.append((np.floor((1 - cos) * 1e6 + 0.5), cid))
        out += [(qid, i + 1, cid) for i, (_, cid) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows", [20_000, 40])
def test_topk_equals_brute_force(spark, rows):
    rng = np.random.default_rng(3)
    c = [(i, rng.normal(size=6)) for i in range(300)]
    # a third of the chunks are copies of one vector, some are zero, queries repeat too
    c += [(300 + i, c[0][1]) for i in range(150)] + [(460 + i, np.zeros(6)) for i in range(5)]
    q = [(f"q{i}", rng.normal(size=6)) for i in range(60)] + [("same", c[0][1]), ("zero", np.zeros(6))]
    qf = spark.createDataFrame([(a, [float(x) for x in b]) for a, b in q], "query_id string, embedding array<double>")
    cf = spark.createDataFrame([(a, [float(x) for x in b]) for a, b in c], "chunk_id bigint, embedding array<double>")
    hits = retrieval.kb_topk(qf, cf, 4, block_rows=rows)
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in hits.collect())
    assert got == brute(q, c, 4)
    plan = plan_of(hits)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id int, embedding array<double>")
    empty = retrieval.kb_topk(df.withColumnRenamed("chunk_id", "query_id"), df.limit(0), 3)
    assert empty.count() == 0


def test_fallback_and_relevance(spark):
    queries = spark.createDataFrame([(1, "one"), (2, "two")], "query_id int, query string")
    hits = spark.createDataFrame([(1, 1, "c", 0.1), (1, 2, "d", 0.5)],
                                 "query_id int, rank int, chunk_id string, distance double")
    store = spark.createDataFrame([("c", "u", "t", "text"), ("d", None, "s", "more")],
                                  "chunk_id string, url string, topic string, text string")
    items = {(r["query_id"], r["rank"]): r for r in retrieval.with_fallback(queries, hits, store).collect()}
    assert items[2, 1]["topic"] == "two" and items[2, 1]["url"] is None
    assert items[2, 1]["snippet"] == retrieval.FALLBACK_SNIPPET and items[2, 1]["distance"] is None
    assert items[1, 1]["snippet"] == "text" and items[1, 2]["url"] is None
    totals = {r["query_id"]: (r["hits"], r["total"], r["strong"])
              for r in retrieval.relevance_total(queries, hits).collect()}
    assert totals == {1: (2, 9, True), 2: (0, 0, False)}
    assert [r["query_id"] for r in retrieval.reingest_candidates(queries, hits).collect()] == [2]


def chunks(spark, rows):
    return spark.createDataFrame(
        [(c, "text " + c, None, u, t, 0, None) for c, u, t in rows], schemas.KB
    )


def test_kb_store(spark):
    path = scratch_dir(spark, "store")
    assert sinks.kb_current(spark, path).count() == 0
    sinks.kb_append(chunks(spark, [("a", "u1", "old"), ("b", "u1", "old"), ("b", "u0", "x")]), path, 0)
    batch = chunks(spark, [("a", "u2", "new")])
    sinks.kb_append(batch, path, 1)
    once = sorted(map(tuple, sinks.kb_current(spark, path).drop("embedding").collect()))
    sinks.kb_append(batch, path, 1)
    assert sorted(map(tuple, sinks.kb_current(spark, path).drop("embedding").collect())) == once
    state = {r["chunk_id"]: (r["url"], r["topic"], r["batch_no"]) for r in sinks.kb_current(spark, path).collect()}
    assert state == {"a": ("u2", "new", 1), "b": ("u0", "x", 0)}
    target = scratch_dir(spark, "compact")
    sinks.kb_compact(spark, path, target)
    assert sinks.kb_open(spark, target).count() == 2
    fresh = chunks(spark, [("a", "u", "t"), ("n", "u", "t"), ("n", "v", "t")]).withColumn("batch_no", F.lit(2))
    assert [r["chunk_id"] for r in kb.new_chunks(fresh, sinks.kb_current(spark, path)).collect()] == ["n"]


def test_copies_are_reduced_before_the_shuffle(spark):
    rows = chunks(spark, [("a", "u", "t")] * 50).withColumn("batch_no", F.lit(0))
    assert kb.latest(rows).count() == 1
    assert "WindowGroupLimit" in plan_of(kb.latest(rows))


def test_topics(spark):
    pages = spark.createDataFrame(
        [(3, "Art"), (1, "art"), (2, "  ART "), (5, "Art"), (9, "")], "page_id bigint, title string"
    )
    topics = spark.createDataFrame([("Art",), ("Art",), ("aRT",), ("none",), (None,)], "topic string")
    got = {r["topic"]: r["page_id"] for r in kb.resolve_topics(topics, pages).collect()}
    assert got == {"Art": 3, "aRT": 1, "none": None}
    assert [r["topic"] for r in kb.unresolved_topics(topics, pages).collect()] == ["none"]


def test_pages(spark):
    html = ("<html><head><title> A &amp; B </title><style>p{}</style></head><body><nav>menu</nav>"
            "<!-- x --><p>One &lt;two&gt;</p><script>var t='</p>';</script><div>Three</div></body>")  # fmt: skip
    row = kb.parse_pages(spark.createDataFrame([(1, "u", html)], schemas.PAGES)).first()
    assert row["title"] == "A & B" and row["content"] == "One <two>\n\nThree"


def contexts(spark, rows):
    return spark.createDataFrame(rows, "response_id int, pos int, context string")


def test_grounding(spark):
    responses = spark.createDataFrame(
        [(1, "alpha beta gamma delta. something else entirely"), (2, "no contexts at all here")],
        "response_id int, response string",
    )
    ctx = contexts(spark, [(1, 0, "alpha beta"), (1, 1, "alpha beta"), (1, 2, "z" * 250)])
    for block in (1, 1000):
        pairs = grounding.score_pairs(responses, ctx, block=block)
        rows = {r["response_id"]: r for r in grounding.assess_response(pairs).collect()}
        assert rows[1]["max_similar_chunk"] == "alpha beta" and rows[1]["contexts"] == 3
        assert rows[2]["overall_score"] == 0.0 and rows[2]["is_hallucination"]
        assert rows[2]["assessment"] == "No RAG context provided for comparison."
        score = rows[1]["overall_score"]
        avg = {r["response_id"]: r for r in grounding.assess_response(pairs, "average").collect()}
        assert avg[1]["overall_score"] == pytest.approx(score * 2 / 3)
        weighted = {r["response_id"]: r for r in grounding.assess_response(pairs, "weighted_average").collect()}
        # the long context weighs all its 250 characters; as shown it weighs 203
        assert weighted[1]["overall_score"] == pytest.approx(score * 20 / 270)
        shown = grounding.assess_response(pairs, "weighted_average", mode="compat").collect()
        assert {r["response_id"]: r for r in shown}[1]["overall_score"] == pytest.approx(score * 20 / 223)
        claims = grounding.score_claims(responses, ctx, block=block)
        done = {r["response_id"]: r for r in grounding.assess_claims(responses, claims).collect()}
        assert (done[1]["total_claims"], done[1]["hallucinated_claims"]) == (2, 1)
        assert (done[2]["total_claims"], done[2]["avg_claim_score"]) == (1, 0.0)
    short = spark.createDataFrame([(7, "tiny")], "response_id int, response string")
    none = grounding.assess_claims(short, grounding.score_claims(short, ctx)).first()
    assert (none["total_claims"], none["avg_claim_score"]) == (0, 0.0)


def test_context_prefix(spark):
    df = spark.createDataFrame([("p", "c"), ("p", None), ("p", " "), ("Filtered.", "c")], "p string, c string")
    got = [r[0] for r in df.select(chat.attach_context("p", "c")).collect()]
    assert got == ['Use the following as context for the prompt: "c"\np', "p", "p", "Filtered."]
    assert df.select(chat.attach_context("p", "c", enabled=False)).first()[0] == "p"


@pytest.mark.parametrize("turns", [1, 3, 256])
def test_previous_turn_over_gaps_and_shared_turns(spark, turns):
    rows = [
        (1, 0, "user", "a"), (1, 2, "assistant", "b"), (1, 900, "assistant", "c"), (1, 900, "assistant", "c"),
        (1, 901, "user", "x"), (1, 901, "user", "y"), (1, 902, "assistant", "d"), (1, 902, "assistant", "e"),
        (2, 5, "assistant", "first"), (2, -7, "system", None), (3, 4, "assistant", "alone"),
        (None, 1, "user", "n"), (None, 2, "assistant", "n"),
    ]
    talk = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted(map(tuple, chat.with_previous_turn(talk, turns=turns).collect()))
    assert got == [
        (1, 2, "assistant", "b", "user", "a"),
        (1, 900, "assistant", "c", "assistant", "b"),
        (1, 902, "assistant", "d", "user", "y"),
        (1, 902, "assistant", "e", "assistant", "d"),
        (2, 5, "assistant", "first", "system", None),
    ]


def test_history_segments(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(10)]
    rows += [(2, 0, "system", "own"), (2, 1, "user", "hi")]
    talk = spark.createDataFrame(rows, schemas.CONVERSATIONS)
    packed = chat.history_segments(chat.chat_history(talk), turns=4).collect()
    parts = {(r["conv_id"], r["segment"]): [m["content"] for m in r["messages"]] for r in packed}
    assert parts[1, 0] == [chat.DEFAULT_SYSTEM, "m0", "m1", "m2", "m3"]
    assert parts[1, 2] == ["m8", "m9"] and parts[2, 0] == ["own", "hi"]


def test_eval_batches(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    rows = evalset.eval_batches(df, "k", batch_size=64, seed=1).collect()
    assert sorted(r["row_no"] for r in rows) == list(range(1, 1001))
    assert {r["batch_no"] for r in rows} == set(range(16))
    again = evalset.eval_batches(df, "k", batch_size=64, seed=1).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    kept = evalset.eval_batches(df, "k", batch_size=10, shuffle=False, bucket_digits=1).collect()
    assert all(r["row_no"] == r["k"] + 1 for r in kept)


def test_eval_files(spark):
    base = scratch_dir(spark, "sets")
    red = spark.createDataFrame([("p1", "['x', 'y']"), ("p2", None)], "prompt string, harm_category string")
    red.write.json(f"{base}/red")
    mixed = spark.createDataFrame([("p3", None, False)], "prompt string, attack_type string, malicious boolean")
    mixed.write.option("header", "true").csv(f"{base}/mixed")
    rows = evalset.combine_eval(
        tables.load_eval_set(spark, f"{base}/red", "red", "json", red_team=True),
        tables.load_eval_set(spark, [f"{base}/mixed"], "mixed", "csv"),
    )
    assert sorted(map(tuple, rows.collect())) == [
        ("p1", "x | y", True, "red"), ("p2", "", True, "red"), ("p3", "", False, "mixed"),
    ]
    assert evalset.eval_subset(rows, "mixed").count() == 1
    with pytest.raises(ValueError, match="format"):
        tables.read_table(spark, base, "a int", "avro")


def test_metrics(spark):
    rows = [(True, True, "a"), (True, False, "a"), (False, True, "b"), (False, False, "b"), (True, True, "b")]
    df = spark.createDataFrame(rows, "is_filtered boolean, malicious boolean, s string")
    r = metrics.confusion_metrics(df).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 1)
    assert r["precision"] == r["recall"] == r["f1"] == pytest.approx(2 / 3)
    empty = metrics.confusion_metrics(df.where("not malicious and not is_filtered")).first()
    assert (empty["precision"], empty["recall"], empty["f1"]) == (0.0, 0.0, 0.0)
    by = {(x["slice"], x["value"]): x["tp"] for x in metrics.metrics_by_slice(df, ["s"]).collect()}
    assert by == {("s", "a"): 1, ("s", "b"): 1, ("(all)", None): 2}


LOG = """Time: 2024-01-01 00:00:00,123 - Level: RESULTS - Prompt:first says Malicious: True
and Filtered things
Time: 2024-01-01 00:00:00,124 - Level: RESULTS - Malicious: True
Time: 2024-01-01 00:00:00,125 - Level: RESULTS - Filtered due to Banned_Words, 4 > 3
Time: 2024-01-01 00:00:01,000 - Level: RESULTS - Prompt:second
Time: 2024-01-01 00:00:01,001 - Level: RESULTS - Malicious: False
Time: 2024-01-01 00:00:01,002 - Level: RESULTS - Passed Overall_Score
Time: 2024-01-01 00:00:02,000 - Level: RESULTS - Prompt:is Filtered water good
Time: 2024-01-01 00:00:02,001 - Level: RESULTS - Malicious: False
"""


def test_log_blocks(spark, tmp_path):
    (tmp_path / "results.log").write_text(LOG)
    path = str(tmp_path / "results.log")
    fixed = [tuple(r) for r in logs.log_blocks(spark, path).collect()]
    assert fixed == [(True, True), (False, False), (False, False)]
    # as coded: the marker inside a prompt counts, and a block runs into the next prompt
    compat = [tuple(r) for r in logs.log_blocks(spark, path, "compat").collect()]
    assert compat == [(True, True), (True, True), (False, True), (False, False)]
    lines = logs.read_results_log(spark, path)
    assert lines.where("level = 'RESULTS'").count() == 8
    assert sum(m.count("\n") for (m,) in lines.select("message").collect()) == LOG.strip().count("\n") - 7
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        logs.log_blocks(spark, path + ".missing")
    with pytest.raises(ValueError, match="mode"):
        logs.log_blocks(spark, path, "other")


def test_log_blocks_over_split_files(spark, tmp_path):
    entry = LOG.split("Time: 2024-01-01 00:00:02")[0]
    (tmp_path / "big.log").write_text(entry * 400)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        blocks = logs.log_blocks(spark, str(tmp_path / "big.log"))
        assert blocks.rdd.getNumPartitions() > 50
        got = {tuple(r)[:2]: r["count"] for r in blocks.groupBy("malicious", "is_filtered").count().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(True, True): 400, (False, False): 400}


def test_stream_history_keeps_every_message(spark, tmp_path):
    """Late, resumed and repeated messages, and two under one turn: as the batch form."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    batches = [
        [(1, 0, "user", "hi"), (1, 2, "user", "more"), (3, 300, "user", "far")],
        [(1, 1, "assistant", "hello"), (1, 2, "user", "more!"), (1, 0, "user", "hi")],
        [(1, 9, "user", "back"), (2, 0, "system", "own")],
    ]
    said = streams.read_stream(spark, str(src), schemas.CONVERSATIONS, files_per_trigger=1)
    for i, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
        frame.to_parquet(src / f"{i}.parquet")
        streams.stream_history(said, out, str(tmp_path / "state")).start().awaitTermination()
    flat = [m for rows in batches for m in rows]
    talk = spark.createDataFrame(flat, schemas.CONVERSATIONS)
    want = chat.history_segments(chat.chat_history(talk), turns=8)
    got = streams.read_history(spark, out, turns=8)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    first = next(r for r in got.collect() if (r["conv_id"], r["segment"]) == (1, 0))
    assert [m["content"] for m in first["messages"]] == [chat.DEFAULT_SYSTEM, "hi", "hello", "more", "more!"]


def test_open_windows_are_stored(spark, tmp_path):
    times = ["2024-01-01 10:05:00", "2024-01-01 10:50:00", "2024-01-01 11:01:00"]
    frame = pd.DataFrame({"ts": pd.to_datetime(times), "bad": [True, False, True]})
    (tmp_path / "in").mkdir()
    frame.to_parquet(tmp_path / "in" / "0.parquet", coerce_timestamps="us")
    events = streams.read_stream(spark, str(tmp_path / "in"), "ts timestamp, bad boolean")
    rates = streams.stream_filter_rates(events, F.col("bad"))
    out = str(tmp_path / "out")
    streams.store_updates(rates, out, str(tmp_path / "state")).start().awaitTermination()
    rows = streams.last_windows(spark.read.parquet(out)).collect()
    assert sorted((r["decisions"], r["filtered"]) for r in rows) == [(1, 1), (2, 1)]


def test_screen_and_answer(spark):
    prompts = spark.createDataFrame(
        [(1, "alpha beta gamma"), (2, "idiot stupid loser moron")], "query_id int, text string"
    ).withColumn("embedding", hash_embedding("text"))
    store = spark.createDataFrame([(1, "alpha beta delta"), (2, "other words")], "chunk_id int, text string")
    store = store.withColumn("embedding", hash_embedding("text"))
    rows = flows.screen_and_answer(prompts, store, lambda p: F.concat(p, F.lit(" alpha"))).collect()
    by = {r["query_id"]: r for r in rows}
    assert by[1]["context"] == "alpha beta delta" and by[1]["output_action"] == "pass"
    assert by[2]["input_action"] == "filter" and by[2]["answer"] is None


def test_evaluate(spark):
    rows = [("idiot stupid loser moron", True, "a"), ("fine", False, "b"), ("odd", True, "b")]
    df = spark.createDataFrame(rows, "prompt string, malicious boolean, source string")
    r = flows.evaluate(df).first()
    assert (r["tp"], r["fn"], r["tn"], r["recall"]) == (1, 1, 1, 0.5)
    assert flows.evaluate(df, slices=("source",)).count() == 3


def test_conform(spark):
    with pytest.raises(ValueError, match="missing"):
        schemas.conform(spark.range(1), "a int")


def test_reset(spark):
    rows = [(1, 0, "user", "old"), (1, 1, "reset", ""), (1, 2, "user", "new"), (2, 0, "user", "x")]
    talk = spark.createDataFrame(rows, schemas.CONVERSATIONS)
    left = sorted((r["conv_id"], r["text"]) for r in chat.after_reset(talk).collect())
    assert left == [(1, "new"), (2, "x")]


def test_scratch_folders_are_fresh(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(base)
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot_equals_join(spark, how):
    # one key holds a third of the rows, one has no partner
    left = spark.range(3000).select(
        F.col("id").alias("q"),
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") == 1, -1).otherwise(F.col("id")).alias("k"),
    )
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = join_hot(left, right, "k", "q", how, least_rows=10)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        map(tuple, left.join(right, "k", how).collect()), key=repr
    )
    assert "_part" in plan_of(got)
