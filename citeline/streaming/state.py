"""Streams over catalogue and conversation state.

Each micro-batch runs the very operators of the batch library against the
state so far, so that stream and batch cannot drift apart, and a key that
holds a third of a batch is spread as it would be there. State lives in logs
(``BatchLog``) in shared storage: it outlives executors and replays.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from citeline.config import DEFAULTS
from citeline.operators import analytics, catalog, conversation
from citeline.session import scratch, settle
from citeline.streaming.log import BatchLog, KeyedState

CLAIM = (
    "request_id long, manual_id long, won boolean, status_after string, reason string, "
    "claimed_at timestamp"
)
STEP = (
    "manual_id long, seq long, step string, status string, duration_ms long, "
    "detail string, error string"
)
MESSAGE = (
    "conversation_id long, ordinal long, role string, content string, "
    "citations array<struct<chunk_id:string,page:int>>"
)
NOTES = (
    "conversation_id long, summarised_through long, "
    "summary struct<goal:string,tried:array<string>,outcome:string,facts:array<string>>"
)
ASKED = "start timestamp, end timestamp, normalized_question string, asked long, place int"


PROGRESS = ("status", "duration_ms", "detail", "error")


# --- claims -----------------------------------------------------------------


def claimed_state(manuals: DataFrame, claims: DataFrame) -> DataFrame:
    """Manuals with the claims granted so far."""
    latest = (
        claims.where("won").groupBy("manual_id").agg(F.max("claimed_at").alias("__at"))
    )
    taken = F.col("__at").isNotNull() & (
        F.col("processing_started_at").isNull() | (F.col("__at") >= F.col("processing_started_at"))
    )
    return manuals.join(latest, "manual_id", "left").select(
        *[
            {
                "status": F.when(taken, "processing").otherwise(F.col("status")),
                "processing_started_at": F.when(taken, F.col("__at")).otherwise(
                    F.col("processing_started_at")
                ),
                "error": F.when(~taken, F.col("error")),
            }.get(c, F.col(c)).alias(c)
            for c in manuals.columns
        ]
    )


def claim_stream(
    requests: DataFrame, manuals: DataFrame, log: BatchLog, now: Column | None = None, s=DEFAULTS
) -> DataStreamWriter:
    """Grant each manual to one request at a time, across micro-batches.

    requests: as ``catalog.claim``. A claim of an earlier batch counts as
    running until it is stale. Outcomes of all requests go to the log; a batch
    reads the last claim of each manual, never the log.
    """
    held = KeyedState(log.spark, f"{log.path}-held", "manual_id long, won boolean, claimed_at timestamp")

    def grant(batch: DataFrame, number: int) -> None:
        with scratch(log.spark):
            at = F.current_timestamp() if now is None else now
            before = held.read(before=number)
            outcomes = settle(
                catalog.claim(claimed_state(manuals, before), batch, at, s).withColumn(
                    "claimed_at", F.when(F.col("won"), at)
                )
            )
            log.write(outcomes, number)
            won = before.unionByName(outcomes.where("won").select(*before.columns))
            held.write(
                won.groupBy("manual_id").agg(F.lit(True).alias("won"), F.max("claimed_at").alias("claimed_at")), number
            )

    return requests.writeStream.foreachBatch(grant)


# --- progress ---------------------------------------------------------------


def progress_stream(events: DataFrame) -> DataFrame:
    """Latest state of every step, updated as events arrive (output mode
    ``update``); ``assemble_progress`` makes the step list of it. With each value
    goes the number of the event that set it, so that a restart can void it."""
    at = {c: F.when(F.col(c).isNotNull(), F.col("seq")) for c in PROGRESS}
    return events.groupBy("manual_id", "step").agg(
        F.max("seq").alias("seq"),
        *[F.max_by(c, at[c]).alias(c) for c in PROGRESS],
        *[F.max(at[c]).alias(f"{c}_at") for c in PROGRESS],
    )


def assemble_progress(states: DataFrame) -> DataFrame:
    """Progress per manual from the latest row per step."""
    begun = catalog.since_restart(states, "manual_id")
    void = F.col("__begun").isNotNull()
    kept = begun.withColumns(
        {c: F.when(~(void & (F.col(f"{c}_at") < F.col("__begun"))), F.col(c)) for c in PROGRESS}
    )
    return catalog.fold_progress(kept.select("manual_id", "seq", "step", *PROGRESS))


# --- uploads ----------------------------------------------------------------


def new_contents(uploads: DataFrame) -> DataFrame:
    """The first upload of each file per tenant; repeats are dropped, however
    late they come. The state holds one entry per file, so run it with the
    RocksDB state store. Links of the repeats are a matter of
    ``catalog.register_uploads``."""
    return uploads.dropDuplicates(["tenant_id", "checksum"])


# --- conversations ----------------------------------------------------------


def turn_stream(
    turns: DataFrame, conversations: DataFrame, messages: BatchLog, s=DEFAULTS
) -> DataStreamWriter:
    """Append turns to their threads. A batch reads the last ordinal and the
    title of each thread that has turns, never the messages; see
    ``titled_threads`` for the titles."""
    held = thread_state(messages)

    def append(batch: DataFrame, number: int) -> None:
        with scratch(messages.spark):
            before = settle(held.read(before=number))
            known = conversations.join(
                before.select("conversation_id", F.col("title").alias("__title")), "conversation_id", "left"
            ).withColumn("title", F.coalesce("title", "__title")).drop("__title")
            last = before.select("conversation_id", "ordinal", F.lit("last").alias("role"))
            none = messages.spark.createDataFrame([], messages.schema).drop("batch")
            last = none.unionByName(last, allowMissingColumns=True)
            titled, after = conversation.append_turns(known, last, batch, s)
            added = settle(after.where(F.col("role") != "last"))
            messages.write(added, number)
            ends = (
                added.select("conversation_id", "ordinal")
                .unionByName(before.select("conversation_id", "ordinal"))
                .groupBy("conversation_id")
                .agg(F.max("ordinal").alias("ordinal"))
            )
            titles = titled.select("conversation_id", "title")
            held.write(ends.join(titles, "conversation_id", "left"), number)

    return turns.writeStream.foreachBatch(append)


def thread_state(messages: BatchLog) -> KeyedState:
    """Last ordinal and title of each thread that a turn stream has seen."""
    return KeyedState(
        messages.spark, f"{messages.path}-threads", "conversation_id long, ordinal long, title string"
    )


def titled_threads(conversations: DataFrame, messages: BatchLog) -> DataFrame:
    """Conversations with the titles that a turn stream gave them."""
    given = thread_state(messages).read().select("conversation_id", F.col("title").alias("__title"))
    return conversations.join(given, "conversation_id", "left").select(
        *[F.coalesce("title", "__title").alias(c) if c == "title" else F.col(c) for c in conversations.columns]
    )


def fold_notes(
    spark: SparkSession, conversations: DataFrame, messages: BatchLog, notes: BatchLog,
    summarise, batch: int, s=DEFAULTS,
) -> None:
    """Take what outgrew the window of a thread into its notes. Call it after each batch of turns; a replay repeats it."""
    with scratch(spark):
        before = notes.read(before=batch)
        latest = before.groupBy("conversation_id").agg(
            F.max_by(F.struct("summarised_through", "summary"), "batch").alias("n")
        )
        state = conversations.select("conversation_id").join(latest, "conversation_id", "left").select(
            "conversation_id",
            F.coalesce("n.summarised_through", F.lit(0).cast("long")).alias("summarised_through"),
            F.col("n.summary").alias("summary"),
        )
        state = settle(state)
        after = conversation.fold_summaries(state, messages.read().drop("batch"), summarise, s)
        old = state.select("conversation_id", F.col("summarised_through").alias("__old"))
        moved = after.join(old, "conversation_id").where(F.col("summarised_through") > F.col("__old"))
        notes.write(moved, batch)


# --- analytics --------------------------------------------------------------


def live_intents(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Measures per intent and window of time, final once the watermark passes
    the window; the batch twin is ``intents_by_window``."""
    return (
        log.withWatermark("created_at", late)
        .groupBy(F.window("created_at", window), "intent")
        .agg(*analytics.intent_measures())
        .select("window.start", "window.end", "intent", "questions", "resolution_rate",
                "mean_latency_ms", "max_latency_ms", "mean_feedback", "cost_usd")
    )


def intents_by_window(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """The same over a finished log."""
    return (
        log.groupBy(F.window("created_at", window), "intent")
        .agg(*analytics.intent_measures())
        .select("window.start", "window.end", "intent", "questions", "resolution_rate",
                "mean_latency_ms", "max_latency_ms", "mean_feedback", "cost_usd")
    )


def live_questions(log: DataFrame, window: str = "1 day", late: str = "10 minutes", tracked=analytics.TRACKED) -> DataFrame:
    """Summaries of the questions of each window, final once the watermark passes
    it. The state of a window is one summary, however many questions it has."""
    return analytics.question_summaries(log.withWatermark("created_at", late), window, tracked)


def most_asked_stream(
    summaries: DataFrame, log, kept: BatchLog, window: str = "1 day", n: int = 20, tracked=analytics.TRACKED
) -> DataStreamWriter:
    """Write the n most frequent questions of every finished window, counted in the
    log that ``log()`` reads: of it, only the finished windows and the questions
    that their summaries list."""

    def recount(batch: DataFrame, number: int) -> None:
        with scratch(kept.spark):
            kept.write(analytics.most_asked_by_window(log(), batch, window, n, tracked), number)

    return summaries.writeStream.foreachBatch(recount)
