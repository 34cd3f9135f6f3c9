"""Streams give what batches give, also when a batch is repeated."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from maskwright.operators import filters, mask, scan, sessions
from maskwright.streaming import streams

TURNS = [
    (1, 7, 0, "a@x.example then b@x.example"), (2, 7, 1, "c@x.example and a@x.example"),
    (3, 8, 0, "a@x.example"), (4, 8, 1, "nothing"), (5, 7, 2, "d@x.example b@x.example"),
]
SCHEMA = "id bigint, session bigint, turn bigint, text string"


def write_batches(spark, folder, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_session_vault_over_batches(spark, tmp_path):
    folder, source = str(tmp_path / "vault"), str(tmp_path / "in")
    keeper = streams.SessionVault(folder, "session", "turn", "id")
    for rows in (TURNS[:2], TURNS[2:4], TURNS[4:]):
        write_batches(spark, source, SCHEMA, rows)
        keeper.start(spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "state")).awaitTermination()
    docs = spark.createDataFrame(TURNS, SCHEMA)
    masked, vault = sessions.mask_sessions(
        docs, filters.settle(scan.pii_column(F.col("text"))), "id", "session", "turn"
    )
    assert sorted(map(tuple, keeper.current_vault(spark).collect())) == sorted(map(tuple, vault.collect()))
    out = spark.read.parquet(f"{folder}/masked").select("id", "masked")
    want = sorted(map(tuple, masked.select("id", "masked").collect()))
    assert sorted(map(tuple, out.collect())) == want
    keeper.process(spark.createDataFrame(TURNS[4:], SCHEMA), 2)  # the last batch runs again
    assert sorted(map(tuple, keeper.current_vault(spark).collect())) == sorted(map(tuple, vault.collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/masked").select("id", "masked").collect())) == want


@pytest.mark.parametrize("compact_every", [50, 2])
def test_silent_session_starts_over(spark, tmp_path, compact_every):
    keeper = streams.SessionVault(
        str(tmp_path / "v"), "session", "turn", "id", event_time="at", ttl_seconds=3600,
        compact_every=compact_every,
    )
    schema = SCHEMA + ", at timestamp"
    start = dt.datetime(2024, 1, 1)
    for batch, (hours, text) in enumerate([(0, "a@x.example"), (0.5, "b@x.example"), (3, "c@x.example a@x.example")]):
        rows = [(batch, 7, batch, text, start + dt.timedelta(hours=hours))]
        keeper.process(spark.createDataFrame(rows, schema), batch)
    assert {(r.value, r.n) for r in keeper.current_vault(spark).collect()} == {("a@x.example", 1), ("c@x.example", 2)}
    assert {(r.value, r.n) for r in keeper.current_vault(spark, before=2).collect()} == {
        ("a@x.example", 1), ("b@x.example", 2)}


def test_stateless_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_batches(spark, source, SCHEMA, TURNS[:3], TURNS[3:])
    stream = streams.mask_stream(spark.readStream.schema(SCHEMA).parquet(source)).select("id", "masked")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s")).trigger(
        availableNow=True).start(out).awaitTermination()
    want = mask.mask_documents(spark.createDataFrame(TURNS, SCHEMA)).select("id", "masked")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_restore_stream(spark, tmp_path):
    vault = spark.createDataFrame(
        [(7, "{{EMAIL_1}}", "EMAIL", 1, "a@x.example", 1)],
        "session_id bigint, placeholder string, label string, n int, value string, seq int",
    )
    source = str(tmp_path / "in")
    write_batches(spark, source, SCHEMA, [(1, 7, 0, "to {{EMAIL_1}}"), (2, 8, 0, "to {{EMAIL_1}}")])
    streams.restore_stream(
        spark.readStream.schema(SCHEMA).parquet(source), lambda session: vault,
        str(tmp_path / "out"), str(tmp_path / "state"), "id", "session",
    ).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.id, r.restored) for r in rows} == {(1, "to a@x.example"), (2, "to {{EMAIL_1}}")}


def test_values_of_expired_sessions_are_deleted(spark, tmp_path):
    keeper = streams.SessionVault(
        str(tmp_path / "v"), "session", "turn", "id", event_time="at", ttl_seconds=3600, compact_every=1, session_type="string",
    )
    start = dt.datetime(2024, 1, 1)
    for batch, (session, text) in enumerate([("s-a", "a@x.example"), ("s-b", "b@x.example"), ("s-b", "c@x.example"), ("s-b", "d@x.example")]):
        rows = [(batch, session, batch, text, start + dt.timedelta(hours=2 * min(batch, 1), minutes=batch))]
        keeper.process(spark.createDataFrame(rows, "id bigint, session string, turn bigint, text string, at timestamp"), batch)
    assert {(r.session_id, r.value) for r in keeper.current_vault(spark).collect()} == {
        ("s-b", "b@x.example"), ("s-b", "c@x.example"), ("s-b", "d@x.example")}
    held = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(
        str(tmp_path / "v" / "vault"), str(tmp_path / "v" / "vault_snapshot"))
    assert "a@x.example" not in {r.value for r in held.select("value").collect()}
    keeper.process(spark.createDataFrame(
        [(9, "s-a", 9, "z@x.example a@x.example", start + dt.timedelta(hours=3))], "id bigint, session string, turn bigint, text string, at timestamp"
    ), 4)
    assert {(r.value, r.n) for r in keeper.current_vault(spark).where("session_id = 's-a'").collect()} == {
        ("a@x.example", 1), ("z@x.example", 2)}
