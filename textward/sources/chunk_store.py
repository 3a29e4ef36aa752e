"""A chunk store in two bucketed tables: texts once, versions of chunks beside them.

``bodies`` holds the text and vector of a chunk, ``versions`` one narrow row per chunk and batch
with the part of ``bodies`` where its text lies.  Both are bucketed by ``chunk_id`` into the same
number of buckets, so the newest versions are found and joined to their texts without a shuffle.
A batch is a partition of both tables: nothing stored before is written again, and a batch run
again with the same rows replaces itself.  A chunk that comes again is stored as a version only;
its text is written again only where it brings another vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.kb import latest
from ..session import stage

BUCKETS = 64
#: Part of the rows written by :func:`compact`.
COMPACTED = -1

BODIES = "chunk_id string, text string, embedding array<float>, part bigint"
VERSIONS = (
    "chunk_id string, source string, url string, topic string, chunk_no int, batch_no bigint, "
    "vec bigint, body bigint, part bigint"
)


@dataclass(frozen=True)
class ChunkStore:
    """Names of the tables of a store, its folder and its number of buckets."""

    bodies: str
    versions: str
    path: str
    buckets: int


def open_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> ChunkStore:
    """The store of a folder, created where there is none.

    The number of buckets is kept with the store; ``buckets`` counts for a new one only.
    """
    path = path.rstrip("/")
    try:
        buckets = spark.read.schema("buckets int").json(f"{path}/settings").first()["buckets"]
        found = True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = False
    name = "chunks_" + hashlib.md5(path.encode()).hexdigest()
    store = ChunkStore(f"{name}_bodies", f"{name}_versions", path, buckets)
    tables = ((store.bodies, BODIES, "bodies"), (store.versions, VERSIONS, "versions"))
    for table, columns, folder in tables:
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet OPTIONS ('compression' = 'zstd') "
            f"PARTITIONED BY (part) CLUSTERED BY (chunk_id) INTO {buckets} BUCKETS LOCATION '{path}/{folder}'"
        )
        if found:
            # batches that another session has written
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
            spark.catalog.refreshTable(table)
        else:
            # makes the folders
            _write(spark.createDataFrame([], columns), table, columns, COMPACTED)
    if not found:
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.json(f"{path}/settings")
    return store


def _write(rows: DataFrame, table: str, ddl: str, part: int) -> None:
    """Replace a part of a table."""
    columns = schemas.conform(rows, ddl).drop("part")
    rows.sparkSession.sql(
        f"INSERT OVERWRITE TABLE {table} PARTITION (part = {part}) SELECT * FROM {{rows}}",
        rows=columns,
    )


def _newest(versions: DataFrame) -> DataFrame:
    order = Window.partitionBy("chunk_id").orderBy(F.col("batch_no").desc(), "part")
    return versions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk in a batch of rows the copy that :func:`latest` would take."""
    keys = [(c, "ascending") for c in ("chunk_id", "url", "topic", "chunk_no")]
    for part in batches:
        if part.num_rows:
            named = pa.Table.from_batches([part]).select([c for c, _ in keys])
            order = pc.sort_indices(named, sort_keys=keys, null_placement="at_start")
            ids = part.column("chunk_id").take(order)
            first = np.ones(len(ids), bool)
            first[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
            part = part.take(order.filter(pa.array(first)))
        yield part


def append(spark: SparkSession, store: ChunkStore, batch: DataFrame, batch_no: int) -> None:
    """Store a batch of chunks ``(chunk_id, text[, source, url, topic, chunk_no, embedding])``.

    Of copies inside the batch the one with the lowest url stays; rows without ``chunk_id`` are
    left out.  Texts go first, so a version never points at a text that is not there.  A batch may
    be run again with the same rows at any time, with other rows only while it is the last one.
    """
    types = {"source": "string", "url": "string", "topic": "string", "chunk_no": "int",
             "embedding": "array<float>"}
    for name, kind in types.items():
        if name not in batch.columns:
            batch = batch.withColumn(name, F.lit(None).cast(kind))
    number = F.lit(batch_no).cast("bigint")
    rows = schemas.conform(batch.where("chunk_id IS NOT NULL"), schemas.KB)
    rows = rows.withColumn("batch_no", number)
    # Texts are dealt once, by bucket: the newest copy, the join to the versions and the files
    # need no other order.  A chunk of very many copies sends one for each batch of rows.
    lying = rows.mapInArrow(_first_copies, rows.schema).repartition(store.buckets, "chunk_id")
    rows = latest(lying)
    # earlier batches only: a batch run again decides as it did the first time
    before = spark.table(store.versions).where(F.col("batch_no") < batch_no)
    known = _newest(before).select("chunk_id", F.col("vec").alias("_vec"), F.col("body").alias("_body"))
    own = F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))
    same = F.col("_body").isNotNull() & (own.isNull() | own.eqNullSafe(F.col("_vec")))
    decided = rows.join(known, "chunk_id", "left").select(
        *rows.columns,
        F.when(same, F.col("_vec")).otherwise(own).alias("vec"),
        F.when(same, F.col("_body")).otherwise(number).alias("body"),
        number.alias("part"),
    )
    # read twice, and the versions it rests on are overwritten below
    decided = stage(decided, "chunk-batch", "zstd")
    # a staged file holds one bucket, so a bucket has one file, or a few where it is very large
    _write(decided.where(F.col("body") == number), store.bodies, BODIES, batch_no)
    _write(decided, store.versions, VERSIONS, batch_no)


def current(spark: SparkSession, store: ChunkStore) -> DataFrame:
    """Every chunk in its newest version, with its text and vector; no row is shuffled."""
    versions = _newest(spark.table(store.versions)).drop("part", "vec")
    bodies = spark.table(store.bodies).select(F.col("chunk_id").alias("_id"), "text", "embedding", "part")
    # the part is no join key: the buckets know the chunk only
    found = (F.col("_id") == F.col("chunk_id")) & (F.col("part") - F.col("body") == 0)
    joined = bodies.join(versions.hint("shuffle_hash"), found)
    return joined.select(
        "chunk_id", "text", "source", "url", "topic", "chunk_no", "embedding", "batch_no"
    )


def compact(spark: SparkSession, store: ChunkStore, path: str) -> ChunkStore:
    """Write the current state to a new folder, as one part; the old one is left as it is."""
    target = open_store(spark, path, store.buckets)
    rows = current(spark, store)
    part = F.lit(COMPACTED).cast("bigint")
    rows = rows.withColumns(
        {"vec": F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")), "body": part, "part": part}
    )
    # the rows lie in buckets already
    _write(rows, target.bodies, BODIES, COMPACTED)
    _write(rows, target.versions, VERSIONS, COMPACTED)
    return target
