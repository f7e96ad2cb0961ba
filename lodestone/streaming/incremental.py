"""An index that follows a stream of notes: each micro-batch replaces the notes that it brings in a snapshot that is kept by parts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources import storage

#: Parts of a snapshot, by hash of the key; a batch rewrites only those that it has keys of.
PARTS = 64


def upsert(snapshot: DataFrame, batch: DataFrame, key: str = "id", at: str = "at", gone: str = "deleted") -> DataFrame:
    """snapshot with the latest row of each key in batch; rows marked deleted take their key out. Of rows of one time the greatest counts."""
    rest = [c for c in batch.columns if c not in (key, at)]
    last = batch.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_last")).select(key, "_last.*")
    kept = snapshot.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(~F.coalesce(F.col(gone), F.lit(False))).select(*snapshot.columns))


def part_of(key: str = "id", parts: int = PARTS):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def snapshot_of(spark: SparkSession, path: object, empty: DataFrame) -> DataFrame:
    """The snapshot that the last finished batch left in path; empty if there is none."""
    state = json.loads(storage.read_text(spark, f"{path}/state.json") or '{"folders": {}}')
    return _read(spark, path, empty, state["folders"])


def _read(spark: SparkSession, path: object, empty: DataFrame, folders: dict[str, str]) -> DataFrame:
    return spark.read.schema(empty.schema).parquet(*(f"{path}/{f}" for f in folders.values())) if folders else spark.createDataFrame([], empty.schema)


def follow(stream: DataFrame, path: object, empty: DataFrame, then: Callable[[DataFrame], None], key: str = "id") -> DataStreamWriter:
    """A writer that keeps the snapshot of notes in path, on any file system of Spark's, and calls then with it.

    A batch rewrites the parts that have its keys, in a folder of its own, and then says so in one small file; a batch
    that is run again starts from the same state. Folders that no part is in any more are deleted a batch later, so that
    the last snapshot can still be read.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        state = json.loads(storage.read_text(spark, f"{path}/state.json") or '{"folders": {}, "before": {}, "batch": -1}')
        if state["batch"] >= number:
            state |= {"folders": state["before"], "batch": number - 1}
        touched = [r[0] for r in batch.select(part_of(key)).distinct().collect()]
        old = {k: f for k, f in state["folders"].items() if int(k) in touched}
        to = f"{path}/batch-{number}"
        made = upsert(_read(spark, path, empty, old), batch, key).withColumn("part", part_of(key))
        made.repartition("part").write.mode("overwrite").partitionBy("part").parquet(to)
        new = {n.partition("=")[2]: f"batch-{number}/{n}" for n in storage.names(spark, to) if n.startswith("part=")}
        folders = {k: f for k, f in state["folders"].items() if int(k) not in touched} | new
        storage.write_text(spark, f"{path}/state.json", json.dumps({"batch": number, "folders": folders, "before": state["folders"]}))
        used = {f.partition("/")[0] for f in [*folders.values(), *state["folders"].values()]}
        for name in storage.names(spark, path):
            if name.startswith("batch-") and name not in used:
                storage.delete(spark, f"{path}/{name}")
        then(_read(spark, path, empty, folders))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/_checkpoint")
