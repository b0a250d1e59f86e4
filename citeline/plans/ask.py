"""Asking: from requests to responses, with the log and the threads they leave."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline import ports as default_ports
from citeline.config import DEFAULTS
from citeline.operators import answer, conversation
from citeline.session import settle

KEY = conversation.KEY


def ask(
    requests: DataFrame,
    products: DataFrame,
    conversations: DataFrame,
    messages: DataFrame,
    chunks: DataFrame,
    links: DataFrame,
    new_thread: Callable[[Column], Column],
    ports: answer.Ports = answer.Ports(),
    summarise: Callable[[Column, Column], Column] = default_ports.note_facts,
    now: Column | None = None,
    s=DEFAULTS,
) -> dict[str, DataFrame]:
    """Answer a batch of requests and carry their threads on.

    requests: request_id (integer, in order of arrival), question, product_id,
    product_token, conversation_id. ``new_thread`` makes the id of a thread
    opened by a request. A request sees its thread as it was before the batch.

    Returns ``responses``, ``refused`` (request_id, problem), ``query_log``
    (the new rows), and ``conversations`` and ``messages`` after the batch.
    """
    at = F.current_timestamp() if now is None else now
    resolved = settle(conversation.resolve_requests(requests, products, conversations))
    refused = resolved.where("problem IS NOT NULL").select("request_id", "problem")
    accepted = resolved.where("problem IS NULL")
    opens = F.col(KEY).isNull()
    accepted = accepted.withColumn("opened", opens).withColumn(
        KEY, F.coalesce(KEY, new_thread(F.col("request_id")))
    )

    named = accepted.where("NOT opened").select(KEY).distinct()
    history = conversation.history(
        messages.join(settle(named), KEY, "left_semi"), s.conversation_window
    )
    notes = conversations.select(KEY, F.to_json("summary").alias("notes"))
    questions = (
        accepted.join(settle(history), KEY, "left")
        .join(notes, KEY, "left")
        .select(
            F.col("request_id").alias("question_id"), "question",
            F.col("resolved_product").alias("product_id"), "history", "notes",
        )
    )
    answers = settle(answer.answer_questions(questions, chunks, links, ports, s))
    threads = accepted.select(F.col("request_id").alias("question_id"), KEY)
    answered = answers.join(threads, "question_id")

    log = answer.log_entries(answers).join(threads, "question_id").withColumn("created_at", at)
    opened = accepted.where("opened").select(
        KEY, F.col("resolved_product").alias("product_id"),
        F.lit(0).alias("summarised_through"), at.alias("created_at"),
    )
    state = conversations.unionByName(opened, allowMissingColumns=True)
    turns = answered.select(
        KEY, F.col("question_id").cast("long").alias("seq"), "question", "answer", "citations"
    )
    titled, after = conversation.append_turns(state, messages, turns, s)
    after = settle(after)
    return {
        "responses": answered.select(
            F.col("question_id").alias("request_id"), KEY, "question", "answer", "intent",
            "citations", "grounded", "escalated",
        ),
        "refused": refused,
        "query_log": log,
        "conversations": conversation.fold_summaries(titled, after, summarise, s),
        "messages": after,
    }
