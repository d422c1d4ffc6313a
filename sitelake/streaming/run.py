"""Running streams: bounded runs into tables, and incremental page extraction."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelake.operators.blueprint import page_blueprints
from sitelake.operators.ledger import decide
from sitelake.session import checkpoint_folder, cut_lineage
from sitelake.streaming import state


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table as a stream of files, whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A stream takes folders or patterns; the class of one letter makes a pattern of the name.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(stream: DataFrame, mode: str = "append", idle_batches: bool = True) -> DataFrame:
    """Process everything available into a fresh table in the shared folder and return that table.

    State with a processing-time TTL always has something to clean, so a bounded run over it must turn
    `idle_batches` off or it never ends.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(IDLE_BATCHES)
    spark.conf.set(IDLE_BATCHES, str(idle_batches).lower())
    try:
        query = (
            stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(IDLE_BATCHES, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process everything available in update mode and return the last row of every key.

    Each micro-batch writes the rows it changed into a folder of its own; a retried batch replaces itself.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    state.use_state_store(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    written = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def landed(rows: DataFrame, batches: int, order: Column) -> DataFrame:
    """The rows as a stream of at most `batches` micro-batches, dealt out by `order` and not by time.

    A micro-batch is as many files as the cluster has cores, so that all of it writes and reads them.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_folder(spark)}/landing-{uuid.uuid4().hex}"
    files = spark.sparkContext.defaultParallelism
    rows.repartition(batches * files, order).write.option("maxRecordsPerFile", 0).parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def admit_batches(ledger: DataFrame, base: str) -> DataFrame:
    """Spend admission with keys held over all wallets: each micro-batch is decided on the balances and keys of those before it.

    Takes everything the stream has and returns the decisions, kept under `base`; a later call goes on from there. Balances and used
    keys live in state stores (`state.admission_loop`); a batch writes the keys it used and the changes of its wallets as files that
    the next one takes in with its rows, so its cost does not grow with those before it. Decisions and changes are written into
    folders of their own, so a retried batch replaces its own. Rows come in the order of their batches.
    """
    spark = ledger.sparkSession
    state.use_state_store(spark)
    changes = f"{base}/changes"
    # The next batch takes all files that are there, then they are deleted.
    decided = spark.readStream.schema(state.ADMISSION).option("cleanSource", "delete").parquet(f"{changes}/*")

    def write(batch: DataFrame, number: int) -> None:
        rows = cut_lineage(batch)  # state operators run once
        if rows.isEmpty():  # only changes came in: what they changed is in the state stores
            return
        opening = rows.groupBy("wallet_id").agg(F.max("opening").alias("balance"))
        fresh = rows.filter("not used").drop("used", "opening")
        done = decide(fresh, opening).join(fresh.select("id", "idempotency_key"), "id").select("wallet_id", "id", "amount", "accepted", "balance", "idempotency_key")
        done.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        accepted = spark.read.parquet(f"{base}/out/batch={number}").filter("accepted")
        none = F.lit(None)
        keys = accepted.filter("idempotency_key is not null").select(
            F.lit("key").alias("kind"), F.concat(F.lit("key:"), "idempotency_key").alias("slot"), none.cast("long").alias("wallet_id"), none.cast("long").alias("amount"))
        sums = accepted.groupBy("wallet_id").agg(F.sum("amount").alias("amount")).select(
            F.lit("sum").alias("kind"), F.concat(F.lit("sum:"), F.col("wallet_id").cast("string")).alias("slot"), "wallet_id", "amount")
        both = keys.unionByName(sums).withColumns({"id": none.cast("long"), "created_at": none.cast("timestamp"), "idempotency_key": none.cast("string")})
        both.select(*spark.createDataFrame([], state.ADMISSION).columns).write.mode("overwrite").parquet(f"{changes}/{number}")

    loop = state.admission_loop(ledger, decided).writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state")
    query = loop.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema("wallet_id long, id long, amount long, accepted boolean, balance long, idempotency_key string").parquet(f"{base}/out")


def extract_pages(pages: DataFrame, out: str, state: str, extract: Callable[[DataFrame], DataFrame] = page_blueprints):
    """Append the extraction of new pages. Each micro-batch writes its own folder, so a retried batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
