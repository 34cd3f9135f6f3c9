"""The same operators on Structured Streaming.

A vault per record needs no state: masking is row-local.  A vault per session is
kept as a table that grows by one folder per micro-batch.  Numbering runs inside
``foreachBatch`` with the batch operators, so a session that receives a third of
the stream is spread over the cluster like in a batch job, and a batch that runs
again overwrites its own folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import remembered
from ..operators.mask import mask_documents, pii_findings
from ..operators.restore import restore
from ..operators.sessions import VAULT_COLUMNS, mask_sessions


def mask_stream(stream: DataFrame, text: str = "text", **options) -> DataFrame:
    """STR-1: append-mode masking, one vault per record, no shuffle and no state."""
    return mask_documents(stream, text, **options)


def vault_schema(session_type: str) -> str:
    return (
        f"session_id {session_type}, placeholder string, label string, n bigint, value string, seq bigint, generation int"
    )


def seen_schema(session_type: str) -> str:
    return f"session_id {session_type}, generation int, at timestamp"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it is; one that is not there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass
class SessionVault:
    """STR-2 and STR-4: a vault per session over a stream.

    ``folder`` is on shared storage.  Each micro-batch N adds ``vault/batch=N`` (new
    entries), ``seen/batch=N`` (its sessions) and ``masked/batch=N``.  Every
    ``compact_every`` batches the live state is rewritten as one snapshot, so a batch
    reads a snapshot and a bounded number of small folders.

    With ``ttl_seconds`` a session that was silent for longer starts over with an empty
    vault of the next generation; time is the largest value of ``event_time`` in the
    batch, so a repeated batch decides the same.

    A snapshot leaves out sessions that have been silent for longer, and what is older than the snapshot before
    it is deleted.  So the values of a silent session are gone from the folder at the second snapshot after it
    has expired.  Sessions have the type ``session_type``: numbers, texts, whatever a table can group by.
    """

    folder: str
    session: str
    sequence: str
    key: str
    text: str = "text"
    event_time: str | None = None
    ttl_seconds: int | None = None
    compact_every: int = 50
    session_type: str = "bigint"

    def __post_init__(self):
        if self.ttl_seconds is not None and not self.event_time:
            raise ValueError("ttl_seconds needs event_time")

    def _rows(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/{name}")
        except AnalysisException as missing:  # nothing has been written yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"{schema}, batch int")

    def _state(self, spark: SparkSession, name: str, schema: str, before: int) -> DataFrame:
        """The latest snapshot older than ``before`` and what was added after it."""
        done = self._rows(spark, "snapshots", "complete boolean").where(F.col("batch") < before)
        upto = done.agg(F.max("batch")).first()[0]
        upto = -1 if upto is None else upto
        added = self._rows(spark, name, schema).where((F.col("batch") > upto) & (F.col("batch") < before))
        base = self._rows(spark, f"{name}_snapshot", schema).where(F.col("batch") == upto)
        return base.unionByName(added).drop("batch")

    def _seen(self, spark: SparkSession, before: int) -> DataFrame:
        return self._state(spark, "seen", seen_schema(self.session_type), before).groupBy("session_id").agg(
            F.max("generation").alias("generation"), F.max("at").alias("at")
        )

    def _live(self, spark: SparkSession, sessions: DataFrame, before: int) -> DataFrame:
        vault = self._state(spark, "vault", vault_schema(self.session_type), before)
        return vault.join(sessions.select("session_id", "generation"), ["session_id", "generation"])

    def current_vault(self, spark: SparkSession, before: int = 2**31 - 1) -> DataFrame:
        """Vault entries of the current generation of each session."""
        return self._live(spark, self._seen(spark, before), before).select(*VAULT_COLUMNS)

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> str:
        path = f"{self.folder}/{name}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return path

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        present = batch.select(F.col(self.session).cast(self.session_type).alias("session_id")).distinct()
        now = F.lit(None).cast("timestamp")
        if self.event_time:
            now = F.lit(batch.agg(F.max(self.event_time)).first()[0]).cast("timestamp")
        silent = F.lit(False)
        if self.ttl_seconds is not None:
            silent = F.unix_timestamp(now) - F.unix_timestamp("at") > self.ttl_seconds
        generation = F.coalesce("generation", F.lit(0)) + F.when(F.coalesce(silent, F.lit(False)), 1).otherwise(0)
        sessions = present.join(self._seen(spark, batch_id), "session_id", "left").select(
            "session_id", generation.cast("int").alias("generation"), now.alias("at")
        )
        # written first and read back: the generations are then fixed for this batch
        sessions = spark.read.schema(seen_schema(self.session_type)).parquet(self._write(sessions, "seen", batch_id))

        known = self._live(spark, sessions, batch_id).select(*VAULT_COLUMNS)
        masked, vault = mask_sessions(
            batch, remembered(pii_findings, self.text), self.key, self.session, self.sequence,
            self.text, existing=known,
        )
        new = vault.join(known, ["session_id", "placeholder"], "left_anti").join(
            sessions.select("session_id", "generation"), "session_id"
        )
        self._write(new.select(*VAULT_COLUMNS, "generation"), "vault", batch_id)
        self._write(masked, "masked", batch_id)
        if (batch_id + 1) % self.compact_every == 0:
            self._compact(spark, batch_id)
        batch.unpersist()

    def _snapshots(self, spark: SparkSession) -> list[int]:
        rows = self._rows(spark, "snapshots", "complete boolean").select("batch").distinct().collect()  # two, as older ones are deleted
        return sorted(r["batch"] for r in rows)

    def _compact(self, spark: SparkSession, batch_id: int) -> None:
        """Rewrite the live state up to this batch and delete what only older snapshots need; the marker is written last."""
        seen = self._seen(spark, batch_id + 1)
        if self.ttl_seconds is not None:
            now = F.lit(seen.agg(F.max("at")).first()[0]).cast("timestamp")
            seen = seen.where(F.unix_timestamp(now) - F.unix_timestamp("at") <= self.ttl_seconds)
        path = self._write(seen, "seen_snapshot", batch_id)
        seen = spark.read.schema(seen_schema(self.session_type)).parquet(path)
        self._write(self._live(spark, seen, batch_id + 1), "vault_snapshot", batch_id)
        before = [b for b in self._snapshots(spark) if b < batch_id]
        self._write(spark.range(1).select(F.lit(True).alias("complete")), "snapshots", batch_id)
        if before:
            self._delete_older(spark, before)

    def _delete_older(self, spark: SparkSession, snapshots: list[int]) -> None:
        """Delete batches up to the last of ``snapshots``, which a repeated batch may read, and the snapshots before it."""
        last = snapshots[-1]
        for name in ("vault", "seen"):
            # at most two rounds of batches are there
            held = self._rows(spark, name, "generation int").where(F.col("batch") <= last).select("batch").distinct().collect()
            for r in held:
                delete_folder(spark, f"{self.folder}/{name}/batch={r['batch']}")
        for old in snapshots[:-1]:
            for name in ("snapshots", "seen_snapshot", "vault_snapshot"):
                delete_folder(spark, f"{self.folder}/{name}/batch={old}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def restore_stream(
    stream: DataFrame, vault, folder: str, checkpoint: str, key: str, session: str,
    text: str = "text", **trigger,
):
    """STR-3: restore each micro-batch against a vault.

    ``vault`` is a static table or a function of the session that reads the table
    anew for each batch.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        table = vault(batch.sparkSession) if callable(vault) else vault
        restore(batch, table, key, session, text).write.mode("overwrite").parquet(
            f"{folder}/batch={batch_id}"
        )

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
