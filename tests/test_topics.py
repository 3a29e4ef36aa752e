"""Names of pages, and prompts enriched from the page they are about."""

from plans import plan_of
from pyspark.sql import functions as F

from textward.config import ScreeningPolicy
from textward.functions.vectors import hash_embedding
from textward.operators import kb, retrieval
from textward.plans import flows

PAGES = [
    (1, "Mercury (planet)", "hot rock near the sun"),
    (2, "Mercury (element)", "liquid metal"),
    (3, "Venus", "clouds of acid"),
    (4, "venus", "small letters"),
    (5, "Mars", "red dust"),
    (6, "Mars", "red dust again"),
    (7, "Mars: a story", "novel"),
    (8, "", "no title"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, title string, text string")


def test_first_option_of_an_ambiguous_name(spark):
    got = {r["alias"]: (r["page_id"], r["options"]) for r in kb.title_aliases(pages(spark)).collect()}
    assert got == {
        "mercury": (2, 2), "mercury (planet)": (1, 1), "mercury (element)": (2, 1),
        "venus": (3, 2), "mars": (5, 2), "mars: a story": (7, 1),
    }


def test_prompts_get_the_passage_of_their_page(spark, tmp_path):
    embed = hash_embedding
    chunks = pages(spark).select(
        F.md5("text").alias("chunk_id"), "text", "page_id", embed("text").alias("embedding")
    )
    more = spark.createDataFrame([(1, "mercury is the planet")], "page_id bigint, text string")
    more = more.select(F.md5("text").alias("chunk_id"), "text", "page_id", embed("text").alias("embedding"))
    retrieval.store_by_page(chunks.unionByName(more).unionByName(more), str(tmp_path / "kb"))
    store = spark.read.parquet(str(tmp_path / "kb"))
    asked = [
        ("a", "tell", "```Mercury (planet)```\n"), ("b", "tell", "MARS"), ("c", "tell", "Pluto"),
        ("d", "tell", "x" * 51), ("e", "tell", None), ("f", None, "mars"), ("g", "Filtered.", "mars"), ("h", "tell", ""),
    ]
    prompts = spark.createDataFrame(asked, "query_id string, text string, topic_reply string")
    aliases = kb.title_aliases(pages(spark))
    rows = flows.enrich_by_topic(prompts, store, aliases, embed).collect()
    got = {r["query_id"]: (r["page_id"], r["context"]) for r in rows}
    assert got == {
        "a": (1, "mercury is the planet"), "b": (5, "red dust"), "c": (None, None), "d": (None, None),
        "e": (None, None), "f": (5, "red dust"), "g": (5, "red dust"), "h": (None, None),
    }
    said = {r["query_id"]: r["prompt"] for r in rows}
    assert said["c"] == "tell" and said["g"] == "Filtered." and "red dust" in said["b"]
    near = flows.enrich_by_topic(prompts, store, aliases, embed, ScreeningPolicy(max_context_distance=0.6))
    assert {r["query_id"] for r in near.where("context IS NOT NULL").collect()} == {"a"}
    off = flows.enrich_by_topic(prompts, store, aliases, embed, ScreeningPolicy(enable_context=False))
    assert off.where("context IS NOT NULL").count() == 0 and off.count() == len(asked)


def test_only_shelves_asked_for_are_read(spark, tmp_path):
    rows = spark.range(300).select(
        F.col("id").alias("page_id"), F.md5(F.col("id").cast("string")).alias("chunk_id"),
        F.lit("some text").alias("text"), hash_embedding(F.lit("some text")).alias("embedding"),
    )
    retrieval.store_by_page(rows, str(tmp_path / "kb"))
    topics = spark.createDataFrame([("t", 7, 1)], "topic string, page_id bigint, options bigint")
    best = retrieval.best_of_page(
        topics.withColumn("embedding", hash_embedding("topic")), spark.read.parquet(str(tmp_path / "kb"))
    )
    assert [r["page_id"] for r in best.collect()] == [7]
    plan = best._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shelf" in plan or "PartitionFilters: [(shelf" in plan or " IN (" in plan
    assert "text:string" not in plan_of(best).split("ReadSchema")[1].split(">")[0]
