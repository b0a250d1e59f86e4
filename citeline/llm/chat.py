"""Chat formatting into budgeted windows of whole turns, in native expressions.

The place of a turn is the sum of the tokens of the turns before it. A grid over
these sums chooses the windows without walking a conversation: the turns that
lie within one cell make a window, and a turn that crosses a border makes one of
its own, so a window keeps its budget unless a single turn exceeds it. Every
later window begins with the conversation's system turn and with the turns that
start at most ``history`` tokens before it. These are repeats and carry no loss;
each assistant text is a target exactly once.

Conversations of any length are spread over tasks: the sums are made in ranges of
one global sort, so also turns with equal numbers spread; a turn meets only the windows of its own and the next cell, and what
is gathered in one place is a window.

A turn is written as <|im_start|>role, a line break, the text, <|im_end|>, a line
break. Inside a text a backslash is doubled and "<|" is written "<\\|", so no
text can imitate a mark; reading takes the backslashes off again.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm.arrays import let, running_sums
from citeline.llm.prefix import running_sums as running_sums_by
from citeline.llm.tables import place, store
from citeline.session import scratch

#: Tokens of a window and of the history repeated in it (at most a quarter).
BUDGET, HISTORY = 1024, 256
#: Characters that count as a token, and tokens of a turn's marks.
TOKEN_CHARS, MARK_TOKENS = 4, 4
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_TURN = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """Tokens of a turn with this text, by its characters."""
    return (F.floor((F.length(text) + TOKEN_CHARS - 1) / TOKEN_CHARS) + MARK_TOKENS).cast("long")


def _placed(turns: DataFrame, conv_id: str, budget: int, history: int) -> tuple[DataFrame, DataFrame]:
    """(turns with their window, leading system turns)."""
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit("")).alias("key"),
        F.col(conv_id).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    size = tokens(F.col("text"))
    spark = turns.sparkSession
    system_at, placed_at = place(spark), place(spark)
    with scratch(spark):  # what only these two tables need goes with them
        numbered = running_sums_by(rows, "key", ["turn", "role", "text"], {"pos": F.lit(1), "before": size})
        system = store(
            numbered.where((F.col("pos") == 0) & (F.col("role") == "system")).select(
                "key", F.col("text").alias("system"), size.alias("system_size")
            ),
            system_at,
        )
        taken = F.coalesce(F.col("system_size"), F.lit(0))
        lead = (F.col("pos") == 0) & F.col("system_size").isNotNull()
        at = F.when(lead, F.lit(0)).otherwise(F.col("before") - taken)
        cell = F.floor(F.col("at") / F.col("step"))
        last = F.floor((F.col("at") + size - 1) / F.col("step"))
        placed = (
            numbered.join(system.select("key", "system_size"), "key", "left")
            .withColumns(
                {"lead": lead, "at": at, "step": F.greatest(F.lit(budget // 4), F.lit(budget - history) - taken)}
            )
            .withColumn("cell", cell)
            .withColumn("window", 2 * cell + F.when(~F.col("lead") & (last > cell), 1).otherwise(0))
            .drop("system_size", "before")
        )
        return store(placed, placed_at), system


def _parts(placed: DataFrame, system: DataFrame, history: int) -> DataFrame:
    """(key, window, rank, pos, role, text): what each window holds. Rank 0 is
    the repeated system turn, 1 the repeated history, 2 its own turns."""
    starts = store(
        placed.groupBy("key", "window").agg(
            F.min("at").alias("start"), F.min(F.floor(F.col("at") / F.col("step"))).alias("cell")
        )
    )
    own = placed.select("key", "window", F.lit(2).alias("rank"), "pos", "role", "text")
    earlier = placed.where(~F.col("lead")).select(
        "key", "at", "pos", "role", "text", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell")
    )
    repeated = (
        earlier.join(starts, ["key", "cell"])
        .where((F.col("start") > F.col("at")) & (F.col("start") - F.col("at") <= history))
        .select("key", "window", F.lit(1).alias("rank"), "pos", "role", "text")
    )
    head = (
        starts.where(F.col("window") > 0)
        .join(system, "key")
        .select(
            "key", "window", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("pos"),
            F.lit("system").alias("role"), F.col("system").alias("text"),
        )
    )
    return own.unionByName(repeated).unionByName(head)


def format_windows(
    conversations: DataFrame, conv_id: str = "conv_id", budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """One row per window: conv_id, window (rising within a conversation),
    formatted, repeated (turns at its beginning that are repeats) and loss
    (structs of first character and end of each target).

    Rows need turn, role and text. A null text or role is empty, a null turn
    comes first; turns with equal numbers are ordered by role and text, and
    repeated rows are separate turns; a null conversation id is a conversation.
    A system turn counts as one to retain only if it leads. Further columns are
    ignored; an empty table gives no rows.
    """
    history = min(history, budget // 4)
    placed, system = _placed(conversations, conv_id, budget, history)
    names = placed.groupBy("key").agg(F.min("conv").alias(conv_id))
    turn = F.struct("rank", "pos", "role", "text")
    windows = (
        _parts(placed, system, history)
        .groupBy("key", "window")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    head = F.transform(
        F.col("turns"), lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"))
    )
    body = F.transform(F.col("turns"), lambda t: escape(t["text"]))
    written = windows.select(
        "key",
        "window",
        F.size(F.filter("turns", lambda t: t["rank"] < 2)).alias("repeated"),
        F.transform("turns", lambda t: (t["rank"] == 2) & (t["role"] == "assistant")).alias("target"),
        head.alias("head"),
        body.alias("body"),
    )
    tail = F.lit(CLOSE + "\n")
    formatted = F.array_join(F.zip_with("head", "body", lambda h, b: F.concat(h, b, tail)), "")
    steps = F.zip_with("head", "body", lambda h, b: F.length(h) + F.length(b) + len(CLOSE) + 1)

    def spans(ends):
        marked = F.zip_with(
            F.zip_with("target", "body", lambda t, b: F.struct(t.alias("t"), F.length(b).alias("n"))),
            ends,
            lambda x, e: F.struct(
                x["t"].alias("t"),
                (e - len(CLOSE) - 1 - x["n"]).alias("start"),
                (e - len(CLOSE) - 1).alias("end"),
            ),
        )
        return F.transform(
            F.filter(marked, lambda x: x["t"]),
            lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")),
        )

    loss = let(steps, lambda s: let(running_sums(s), spans))
    return (
        written.select("key", "window", "repeated", formatted.alias("formatted"), loss.alias("loss"))
        .join(store(names), "key")
        .select(conv_id, "window", "formatted", "repeated", "loss")
    )


def read_turns(formatted: Column, repeated: Column) -> Column:
    """Structs of role and text of a window's own turns, unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    own = F.slice(parts, repeated + 1, F.size(parts) - 1 - repeated)
    role = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*+)\n"

    def turn(part):
        found = F.regexp_extract(part, role, 1)
        text = F.substring(part, F.length(found) + len(OPEN) + 2, F.length(part))
        return F.struct(unescape(found).alias("role"), unescape(text).alias("text"))

    return F.transform(own, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(
        F.transform(
            loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))
        ),
        "",
    )


def digest(windows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from its windows. The hashes are over
    a whole conversation, so its texts come together here, and only here."""
    read = windows.select(
        conv_id,
        "window",
        F.length("formatted").cast("long").alias("chars"),
        read_turns(F.col("formatted"), F.col("repeated")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss")).alias("loss"),
    ).select(
        conv_id,
        "window",
        "chars",
        F.size("turns").alias("n"),
        F.array_join(
            F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
        ).alias("turns"),
        "loss",
    )
    joined = read.groupBy(conv_id).agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("held"),
    )
    loss = F.array_join(F.col("held.loss"), "")
    return joined.select(
        conv_id,
        "n_turns",
        F.sha2(F.array_join(F.col("held.turns"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
