"""Streams over tables that are one file, or a folder of files."""

import pytest

from textward.plans import registry
from textward.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["stream_screen", "stream_history"])
def test_stream_reads_a_table_of_several_files(spark, sf_dir, tmp_path, name):
    for table in ("documents", "conversations"):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        rows.repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    want = QUERIES[name](spark, sf_dir)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_parts_of_several_files_arrive_as_one_batch_each(spark, sf_dir, monkeypatch):
    want = QUERIES["stream_chunk_store"](spark, sf_dir).collect()
    monkeypatch.setattr(registry, "ARRIVING_ROWS", 15)
    written = []
    plain = registry.streams.read_stream
    monkeypatch.setattr(registry.streams, "read_stream", lambda s, path, *a, **b: written.append((len(s.read.parquet(path).inputFiles()), b["files_per_trigger"])) or plain(s, path, *a, **b))
    got = QUERIES["stream_chunk_store"](spark, sf_dir).collect()
    assert written and all(files == 4 * each and each > 1 for files, each in written)
    assert sorted(map(str, got)) == sorted(map(str, want)) != []
