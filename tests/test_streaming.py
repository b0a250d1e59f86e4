"""Streams against their batch twins."""

import os

from pyspark.sql import functions as F

from citeline import ports
from citeline.operators import catalog, conversation
from citeline.sources.files import read_chunks
from citeline.streaming import ingest, state
from citeline.streaming.log import BatchLog, KeyedState

NOW = "2024-01-15 00:00:00"


def drain(writer, folder):
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True
    ).start()
    query.awaitTermination(240)
    assert query.exception() is None


def in_files(spark, df, folder, n=3):
    """Rows in n files, in order, read back as a stream of one file a batch."""
    rows = df.collect()
    size = -(-len(rows) // n)
    for i in range(n):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def manuals(spark):
    rows = [
        (1, "pending", None, None),
        (2, "ready", None, None),
        (3, "processing", "2024-01-14 23:59:00", None),
        (4, "processing", "2024-01-14 20:00:00", None),
        (5, "failed", None, "broken"),
    ]
    df = spark.createDataFrame(rows, "manual_id long, status string, at string, error string")
    return df.withColumn("processing_started_at", F.to_timestamp("at")).drop("at")


def test_one_claim_wins_across_batches(spark, folder):
    requests = spark.createDataFrame(
        [(i, 1 + i % 6, i, False) for i in range(30)],
        "request_id long, manual_id long, arrival long, force boolean",
    )
    now = F.lit(NOW).cast("timestamp")
    log = BatchLog(spark, f"{folder}/claims", state.CLAIM)
    stream = in_files(spark, requests, f"{folder}/in")
    drain(state.claim_stream(stream, manuals(spark), log, now), folder)
    got = log.read()
    assert got.select("batch").distinct().count() == 3
    won = {r.manual_id: r.request_id for r in got.where("won").collect()}
    # 2 is ready, 3 is live, 6 does not exist; every other one has one winner.
    assert won == {1: 0, 4: 3, 5: 4}
    batch = catalog.claim(manuals(spark), requests, now)
    same = {r.request_id: (r.won, r.reason) for r in batch.collect()}
    assert {r.request_id: (r.won, r.reason) for r in got.collect()} == same
    # what a batch reads of the past is a row per manual, not the log
    assert KeyedState(spark, f"{folder}/claims-held", "manual_id long, won boolean, claimed_at timestamp").read().count() == 3


def test_a_replay_finds_the_state_before_it(spark, folder):
    kept = KeyedState(spark, f"{folder}/state", "k long, n long")

    def step(number):
        rows = kept.read(before=number).unionByName(spark.createDataFrame([(number % 3, number)], "k long, n long"))
        kept.write(rows.groupBy("k").agg(F.max("n").alias("n")), number)

    for number in (0, 1, 2, 3, 3, 4, 4, 4):
        step(number)
    assert {(r.k, r.n) for r in kept.read().collect()} == {(0, 3), (1, 4), (2, 2)}
    assert {(r.k, r.n) for r in kept.read(before=4).collect()} == {(0, 3), (1, 1), (2, 2)}


def test_replayed_batch_changes_nothing(spark, folder):
    log = BatchLog(spark, f"{folder}/log", "x long")
    rows = spark.range(5).select(F.col("id").alias("x"))
    log.write(rows, 0)
    log.write(rows.where("x > 2"), 1)
    log.write(rows, 0)
    assert log.read().count() == 7 and log.read(before=1).count() == 5


def test_progress_stream_equals_batch(spark, folder):
    events = spark.createDataFrame(
        [
            (1, 0, "read", "running", None, None, None),
            (1, 1, "read", "done", 12, "bytes", None),
            (1, 2, "extract", "running", None, None, None),
            (2, 0, "read", "running", None, None, None),
            (1, 3, "extract", "failed", 7, None, "ValueError: x"),
            (2, 1, "unknown", "done", 1, None, None),
            (3, 0, "read", "failed", 9, None, "broken"),
            (3, 1, catalog.RESTART, None, None, None, None),
            (3, 2, "read", "done", None, None, None),
        ],
        state.STEP,
    )
    stream = state.progress_stream(in_files(spark, events, f"{folder}/in"))
    writer = stream.writeStream.outputMode("complete").format("memory").queryName("steps")
    drain(writer, folder)
    live = state.assemble_progress(spark.table("steps"))
    batch = catalog.fold_progress(events)
    key = lambda r: r.manual_id
    assert sorted(live.collect(), key=key) == sorted(batch.collect(), key=key)
    first = {p.step: p for p in batch.where("manual_id = 1").first().progress}
    assert first["read"].status == "done" and first["read"].duration_ms == 12
    assert first["extract"].error == "ValueError: x" and first["index"].status == "pending"
    again = {p.step: p for p in batch.where("manual_id = 3").first().progress}
    assert (again["read"].status, again["read"].error, again["read"].duration_ms) == ("done", None, None)


def test_turn_stream_equals_batch(spark, folder):
    turns = spark.createDataFrame(
        [(1 + i % 2, i, f"q{i}", f"a{i}", None) for i in range(12)],
        "conversation_id long, seq long, question string, answer string, "
        "citations array<struct<chunk_id:string,page:int>>",
    )
    threads = spark.createDataFrame([(1, None), (2, "kept")], "conversation_id long, title string")
    log = BatchLog(spark, f"{folder}/messages", state.MESSAGE)
    drain(state.turn_stream(in_files(spark, turns, f"{folder}/in"), threads, log), folder)
    none = spark.createDataFrame([], state.MESSAGE)
    _, batch = conversation.append_turns(threads, none, turns)
    live = log.read().drop("batch")
    key = ["conversation_id", "ordinal"]
    assert live.orderBy(*key).collect() == batch.select(*live.columns).orderBy(*key).collect()
    assert [r.ordinal for r in live.where("conversation_id = 1").orderBy("ordinal").collect()] == list(range(12))

    titles = {r.conversation_id: r.title for r in state.titled_threads(threads, log).collect()}
    assert titles == {1: "q0", 2: "kept"}
    assert state.thread_state(log).read().count() == 2
    notes = BatchLog(spark, f"{folder}/notes", state.NOTES)
    for number in range(2):
        state.fold_notes(spark, threads, log, notes, ports.note_facts, number)
    done = notes.read().collect()
    # Twelve messages, a window of six: fold 0-5 once, then nothing is pending.
    assert {(r.conversation_id, r.summarised_through, r.batch) for r in done} == {(1, 6, 0), (2, 6, 0)}


def test_new_contents(spark, folder):
    uploads = spark.createDataFrame(
        [(i, "t", f"c{i % 3}") for i in range(9)], "upload_id long, tenant_id string, checksum string"
    )
    stream = state.new_contents(in_files(spark, uploads, f"{folder}/in"))
    drain(stream.writeStream.format("memory").queryName("contents"), folder)
    assert sorted(r.checksum for r in spark.table("contents").collect()) == ["c0", "c1", "c2"]


def test_live_intents_equal_batch(spark, folder):
    log = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "how_to").otherwise("safety").alias("intent"),
        (F.col("id") % 2 == 0).alias("resolved"),
        (F.col("id") % 5).cast("int").alias("feedback"),
        F.col("id").cast("int").alias("latency_ms"),
        F.lit("0.001").cast("decimal(10,6)").alias("token_cost_usd"),
        (F.lit(NOW).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("created_at"),
    )
    stream = state.live_intents(in_files(spark, log, f"{folder}/in"))
    drain(stream.writeStream.outputMode("append").format("memory").queryName("live"), folder)
    final = {(r.start, r.intent): r for r in spark.table("live").collect()}
    whole = {(r.start, r.intent): r for r in state.intents_by_window(log).collect()}
    # The last window stays open until the watermark passes its end.
    assert len(final) >= len(whole) - 4 and all(whole[k] == r for k, r in final.items())


def test_ingest_stream_replaces_documents(spark, folder):
    os.makedirs(f"{folder}/files")
    text = "\n".join(f"Clean the air filter number {i} every two weeks with care." for i in range(40))
    for name, content in (("a.txt", text), ("b.txt", "1\n2\n3"), ("copy.txt", text)):
        with open(f"{folder}/files/{name}", "w") as out:
            out.write(content)
    detect = lambda df: df.withColumn("language", F.lit("en"))
    log = BatchLog(spark, f"{folder}/manuals", ingest.MANUAL_DDL)
    files = ingest.file_stream(spark, f"{folder}/files", per_batch=1)
    drain(ingest.ingest_stream(files, f"{folder}/chunks", log, detect, buckets=4), folder)
    states = {r.manual_id: (r.status, r.page_count) for r in log.read().collect()}
    assert sorted(states.values()) == [("failed", 0), ("ready", 40)]
    chunks = read_chunks(spark, f"{folder}/chunks")
    ready = next(k for k, v in states.items() if v[0] == "ready")
    rows = chunks.orderBy("ordinal").collect()
    assert {r.manual_id for r in rows} == {ready}
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    assert rows[0].page_from == 1 and rows[-1].page_to == 40
    assert all(len(r.embedding) == ports.DIMENSIONS for r in rows)
