"""Threads: last messages, turns, lists, and what the notes cover.

messages: conversation_id, ordinal, role, content[, created_at].
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.config import DEFAULTS
from citeline.functions import text as fx
from citeline.operators.ordered import int_bucket, number_rows
from citeline.session import settle

KEY = "conversation_id"
#: Notes of consecutive segments that are merged at a time.
FAN = 64


def recent_messages(messages: DataFrame, limit: int = DEFAULTS.conversation_window) -> DataFrame:
    """The last messages of each thread. Spark cuts each task's share to the
    limit before the shuffle, so a long thread costs no more than a short one."""
    latest = Window.partitionBy(KEY).orderBy(F.col("ordinal").desc())
    return (
        messages.withColumn("__rank", F.row_number().over(latest))
        .where(F.col("__rank") <= limit)
        .drop("__rank")
    )


def message_line() -> Column:
    return F.concat_ws(": ", "role", "content")


def history(messages: DataFrame, limit: int = DEFAULTS.conversation_window) -> DataFrame:
    """Per thread: the last messages as one text, in reading order."""
    recent = recent_messages(messages, limit).withColumn("__line", message_line())
    lines = F.sort_array(F.collect_list(F.struct("ordinal", "__line")))
    return recent.groupBy(KEY).agg(F.concat_ws("\n", lines["__line"]).alias("history"))


def list_threads(conversations: DataFrame, messages: DataFrame, product=None) -> DataFrame:
    """Threads, of one product when named, most recently active first; one
    without messages counts as active when it was created."""
    if product is not None:
        conversations = conversations.where(F.col("product_id") == product)
    seen = messages.groupBy(KEY).agg(
        F.count("*").alias("messages"), F.max("created_at").alias("last_message_at")
    )
    listed = conversations.join(seen, KEY, "left").withColumn(
        "messages", F.coalesce("messages", F.lit(0))
    )
    active = F.coalesce("last_message_at", "created_at")
    return listed.orderBy(active.desc(), KEY)


def read_thread(messages: DataFrame, conversation) -> DataFrame:
    """A whole thread in reading order."""
    return messages.where(F.col(KEY) == conversation).orderBy("ordinal")


def first_questions(messages: DataFrame, s=DEFAULTS) -> DataFrame:
    """Title of each thread: its first question."""
    asked = messages.where(F.col("role") == "user").groupBy(KEY)
    first = asked.agg(F.min_by("content", "ordinal").alias("question"))
    return first.select(KEY, fx.thread_title(F.col("question"), s).alias("title"))


def append_turns(
    conversations: DataFrame, messages: DataFrame, turns: DataFrame, s=DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Add turns (conversation_id, seq, question, answer, citations) in order
    of the integer ``seq``: question and answer take the next two ordinals, and
    the first question names an untitled thread. Returns both tables after."""
    named = turns.select(KEY).distinct()
    last = settle(
        messages.join(named, KEY, "left_semi").groupBy(KEY).agg(F.max("ordinal").alias("__last"))
    )
    numbered = number_rows(turns, [KEY], ["seq"], int_bucket(F.col("seq"), s), "__pos")
    base = F.coalesce(F.col("__last"), F.lit(-1))
    placed = numbered.join(last, KEY, "left").withColumn("__base", base + 2 * F.col("__pos") + 1)
    none = F.col("citations").isNull()
    blank = F.array().cast(turns.schema["citations"].dataType)
    pair = F.array(
        F.struct(
            F.col("__base").alias("ordinal"), F.lit("user").alias("role"),
            F.col("question").alias("content"), blank.alias("citations"),
        ),
        F.struct(
            (F.col("__base") + 1).alias("ordinal"), F.lit("assistant").alias("role"),
            F.col("answer").alias("content"),
            F.when(none, blank).otherwise(F.col("citations")).alias("citations"),
        ),
    )
    added = placed.select(KEY, F.explode(pair).alias("m")).select(KEY, "m.*")
    first = turns.groupBy(KEY).agg(F.min_by("question", "seq").alias("__question"))
    titled = conversations.join(first, KEY, "left").withColumn(
        "title", F.coalesce("title", fx.thread_title(F.col("__question"), s))
    )
    return (
        titled.select(*conversations.columns),
        messages.unionByName(added, allowMissingColumns=True),
    )


def summary_ranges(conversations: DataFrame, messages: DataFrame, s=DEFAULTS) -> DataFrame:
    """Threads that outgrew their window: the ordinals the notes should take
    in, from ``fold_from`` up to but not including ``fold_to``."""
    total = messages.groupBy(KEY).agg(F.count("*").alias("total"))
    window = s.conversation_window
    return (
        conversations.join(total, KEY)
        .where(F.col("total") - F.col("summarised_through") > window)
        .select(
            KEY, "total", F.col("summarised_through").alias("fold_from"),
            (F.col("total") - window).alias("fold_to"),
        )
    )


def transcripts(ranges: DataFrame, messages: DataFrame, s=DEFAULTS) -> DataFrame:
    """The messages of each range as text, in segments of a bounded number of
    messages, so that a thread of any length never becomes one value."""
    within = messages.join(settle(ranges), KEY).where(
        (F.col("ordinal") >= F.col("fold_from")) & (F.col("ordinal") < F.col("fold_to"))
    )
    segment = F.floor((F.col("ordinal") - F.col("fold_from")) / s.transcript_segment)
    lines = F.sort_array(F.collect_list(F.struct("ordinal", message_line().alias("line"))))
    return (
        within.withColumn("segment", segment.cast("long"))
        .groupBy(KEY, "segment")
        .agg(
            F.concat_ws("\n", lines["line"]).alias("transcript"),
            (F.max("ordinal") + 1).alias("through"),
        )
    )


def _merged(parts: DataFrame, merge: Callable[[Column, Column], Column], longest: int) -> DataFrame:
    """One row per thread of (conversation_id, segment, notes), segment at most
    ``longest``: runs of at most ``FAN`` neighbours are merged in order, then the
    runs, so a thread takes as many steps as its segments have digits."""
    blank = F.lit(None).cast(parts.schema["notes"].dataType)

    def both(held: Column, following: Column) -> Column:
        return F.when(held.isNull(), following).when(following.isNull(), held).otherwise(merge(held, following))

    while True:
        run = F.floor(F.col("segment") / FAN).cast("long").alias("segment")
        rows = F.sort_array(F.collect_list(F.struct("segment", "notes"))).alias("rows")
        parts = parts.groupBy(KEY, run).agg(rows).select(
            KEY, "segment", F.aggregate("rows", blank, lambda held, r: both(held, r["notes"])).alias("notes")
        )
        longest //= FAN
        if not longest:
            return parts.drop("segment")


def _in_turn(segments: DataFrame, notes: DataFrame, summarise, longest: int) -> DataFrame:
    """Notes of each thread after its segments, each taken with the notes that the
    one before left: a round per segment of the longest thread."""
    done = []
    for number in range(longest + 1):
        step = segments.where(F.col("segment") == number).select(KEY, "transcript")
        taken = summarise(F.col("__notes"), F.col("transcript"))
        read = settle(
            notes.join(step, KEY).select(KEY, F.coalesce(taken, F.col("__notes")).alias("__notes"), "through")
        )
        more = segments.where(F.col("segment") == number + 1).select(KEY)
        done.append(read.join(more, KEY, "left_anti"))
        notes = read
    return reduce(DataFrame.unionByName, done, notes.limit(0))


def fold_summaries(
    conversations: DataFrame, messages: DataFrame, summarise, s=DEFAULTS
) -> DataFrame:
    """Conversations after all that outgrew the window is in the notes.

    ``summarise(notes, transcript) -> notes`` takes a segment of a thread: a call is
    bounded, a thread is not. NULL from the summariser (a failed call) keeps the old
    notes; either way the segment counts as covered.

    A summariser that has a ``merge(notes, notes) -> notes``, an expression by which
    the notes of what came first take in those of what followed, reads all segments
    at once, each without notes; theirs are merged in order. ``merge`` must be
    associative, and merging what a segment alone gives must equal summarising it.
    Any other reads the segments of a thread in order, each with the notes that the
    one before left: as many rounds as the longest thread has segments, and a round
    sees only the threads that still have one.
    """
    segments = settle(transcripts(summary_ranges(conversations, messages, s), messages, s))
    longest = segments.agg(F.max("segment").alias("n")).first()["n"]
    longest = 0 if longest is None else int(longest)
    notes = conversations.select(KEY, F.col("summary").alias("__notes")).join(
        settle(segments.groupBy(KEY).agg(F.max("through").alias("through"))), KEY
    )
    notes = settle(notes)
    merge = getattr(summarise, "merge", None)
    if merge is None:
        folded = _in_turn(segments, notes, summarise, longest)
    else:
        kind = conversations.schema["summary"].dataType
        own = summarise(F.lit(None).cast(kind), F.col("transcript")).cast(kind)
        first = notes.select(KEY, F.lit(0).cast("long").alias("segment"), F.col("__notes").alias("notes"))
        rest = segments.select(KEY, (F.col("segment") + 1).alias("segment"), own.alias("notes"))
        folded = notes.select(KEY, "through").join(
            _merged(first.unionByName(rest), merge, longest + 1).withColumnRenamed("notes", "__notes"), KEY
        )
    joined = conversations.join(folded, KEY, "left")
    return joined.select(
        *[
            {
                "summary": F.coalesce("__notes", "summary"),
                "summarised_through": F.coalesce("through", "summarised_through").cast(
                    conversations.schema["summarised_through"].dataType
                ),
            }.get(c, F.col(c)).alias(c)
            for c in conversations.columns
        ]
    )


# --- requests ---------------------------------------------------------------

# Limits and replies of a request to ask.
MAX_REQUEST_CHARS = 4000


def resolve_requests(
    requests: DataFrame, products: DataFrame, conversations: DataFrame
) -> DataFrame:
    """Requests with the product and thread they are about, or why not.

    requests: request_id, question, product_id, product_token,
    conversation_id. Adds resolved_product, notes, summarised_through and
    ``problem``: invalid, unknown token, unknown thread, or a thread about
    another product.
    """
    tokens = products.select(
        F.col("public_token").alias("product_token"), F.col("product_id").alias("__by_token")
    )
    threads = conversations.select(
        KEY, F.col("product_id").alias("__of_thread"), F.lit(True).alias("__known")
    )
    joined = requests.join(tokens, "product_token", "left").join(threads, KEY, "left")
    token = F.nullif(F.col("product_token"), F.lit(""))
    named = F.coalesce("product_id", "__by_token")
    size = F.length("question")
    problem = (
        F.when(
            (F.col("product_id").isNull() & token.isNull() & F.col(KEY).isNull()),
            "name a product or a conversation",
        )
        .when(size.isNull() | (size < 1) | (size > MAX_REQUEST_CHARS), "question length")
        .when(
            F.col("product_id").isNull() & token.isNotNull() & F.col("__by_token").isNull(),
            "Unknown product token.",
        )
        .when(F.col(KEY).isNotNull() & F.col("__known").isNull(), "Conversation not found.")
        .when(
            F.col(KEY).isNotNull() & named.isNotNull() & ~named.eqNullSafe(F.col("__of_thread")),
            "This conversation is about another product. Start a new one.",
        )
    )
    return joined.select(
        *requests.columns,
        F.coalesce(named, F.col("__of_thread")).alias("resolved_product"),
        problem.alias("problem"),
    )
