"""Streams over folders of parquet files: the audit log as an append-only source, case states upserted per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from attestra.operators.state import fold_status

#: Parts into which the log is filed by loan, so that a micro-batch reads only those of the loans that it touches.
PARTS = 64


def audit_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 1, names: str = "*.parquet") -> DataFrame:
    """STM-03, STM-04: audit events as files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).parquet(folder)


def run_status(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """STM-02, STM-03, STM-07, SNK-03, SNK-04: the log appended under out/log and the states of touched loans under out/status, per micro-batch.

    A state is folded from the log of its loan, so repeated and late events change it just as in a batch. A micro-batch that is run again
    after a failure overwrites its own folders only: nothing is lost or counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        filed = batch.where("loan_id IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("loan_id"), F.lit(PARTS)).cast("int")).persist()
        filed.write.mode("overwrite").partitionBy("part").parquet(f"{out}/log/batch={number}")
        touched = filed.select("loan_id", "part").distinct()
        parts = [r["part"] for r in touched.select("part").distinct().collect()]
        known = spark.read.schema(filed.schema).option("basePath", f"{out}/log").parquet(f"{out}/log").where(F.col("part").isin(parts))
        states = fold_status(known.join(touched, ["loan_id", "part"], "left_semi"))
        states.write.mode("overwrite").parquet(f"{out}/status/batch={number}")
        filed.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame) -> DataFrame:
    """STM-01: the events of each loan as a stream of progress: loan_id, step, stage, status; a start before the first and a finish after the last."""
    steps = events.where(F.col("loan_id").isNotNull() & F.col("type").isNotNull()).groupBy("loan_id").agg(F.array_sort(F.collect_set(F.struct("event_ts", "audit_id", "type"))).alias("es"))
    done = F.transform("es", lambda e: F.struct(e["type"].alias("stage"), F.lit("completed").alias("status")))
    begin, end = F.struct(F.lit("start").alias("stage"), F.lit("started").alias("status")), F.struct(F.lit("finish").alias("stage"), F.lit("done").alias("status"))
    return steps.select("loan_id", F.posexplode(F.concat(F.array(begin), done, F.array(end))).alias("step", "x")).select("loan_id", "step", "x.stage", "x.status")
