"""Blocks of a log counted over its splits."""

import random
from collections import Counter

import pytest

from textward.sources import logs

HEAD = "Time: 2024-01-01 00:00:00,000 - Level: RESULTS - "


def written(tmp_path, seed, lines):
    rng = random.Random(seed)
    texts = [
        "Prompt:what", "Malicious: True", "Malicious: False", "Malicious: maybe", "Filtered due to X",
        "Prompt:say Malicious: True Filtered", "Passed", "Malicious: True Malicious: False",
    ]
    out = []
    for _ in range(lines):
        body = rng.choice(texts)
        out.append(body if rng.random() < 0.3 else HEAD + body)
        out += ["filler " * rng.randint(0, 9)] * rng.choice([0, 0, 1, 20])
    (tmp_path / f"{seed}.log").write_text("\n".join(out) + "\n" * (seed % 2))


@pytest.mark.parametrize("mode", ["fixed", "compat"])
@pytest.mark.parametrize("size", [700, 1 << 27])
def test_same_blocks_however_the_log_is_split(spark, tmp_path, mode, size):
    for seed in range(3):
        written(tmp_path, seed, 120)
    want = Counter(map(tuple, logs.log_blocks(spark, str(tmp_path), mode).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = Counter(map(tuple, logs.log_blocks_by_line(spark, str(tmp_path), mode).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and len(want) == 4
    assert splits > 20 or size > 700


def test_logs_without_markers(spark, tmp_path):
    (tmp_path / "a.log").write_text("Filtered\n" * 500)
    (tmp_path / "b.log").write_text("")
    assert logs.log_blocks_by_line(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="mode"):
        logs.log_blocks_by_line(spark, str(tmp_path), "other")
