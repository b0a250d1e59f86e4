"""The answer flow: screen, condense, route, retrieve, generate, verify.

Questions travel as rows and branches are filters, so a port (a model call) is
evaluated only for the rows that reach it: never inside a ``when``, which
Spark may evaluate on both sides. Each port stage is settled once.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline import ports as default_ports
from citeline.config import DEFAULTS
from citeline.functions import guard
from citeline.functions import text as fx
from citeline.operators import search
from citeline.session import settle

CITATIONS = "array<struct<chunk_id:string,page:int>>"


@dataclass(frozen=True)
class Ports:
    """The functions that stand for models; see ``citeline.ports``."""

    condense: Callable[[Column, Column], Column] = lambda conversation, question: question
    route: Callable[[Column], Column] = default_ports.keyword_router
    translate: Callable[[Column], Column] = default_ports.keep_original
    embed: Callable[[DataFrame, str, str], DataFrame] = default_ports.embed
    generate: Callable[..., Column] = (
        lambda hits, conversation, feedback, question: default_ports.quote_best(hits, feedback)
    )
    chat: Callable[[Column], Column] = default_ports.greet


def on_rows(df: DataFrame, condition: Column, add: Callable, blank: dict) -> DataFrame:
    """Apply ``add`` to the rows that meet the condition; the others get the
    ``blank`` columns, and no port sees them."""
    chosen = F.coalesce(condition, F.lit(False))
    done = add(df.where(chosen))
    return done.unionByName(df.where(~chosen).withColumns(blank))


def prepare_questions(asked: DataFrame, ports: Ports) -> DataFrame:
    """Translation, vectors and terms of ``search_question``."""
    translated = fx.distinct_translation(
        ports.translate(F.col("search_question")), F.col("search_question")
    )
    asked = settle(asked.withColumn("translated", translated))
    # Settled after each embedding: the rankings read the vectors in several jobs.
    asked = settle(ports.embed(asked, "search_question", "vector"))
    asked = on_rows(
        asked,
        F.col("translated").isNotNull(),
        partial(ports.embed, source="translated", name="translated_vector"),
        {"translated_vector": F.lit(None).cast("array<float>")},
    )
    return settle(asked.withColumn("terms", fx.query_terms(F.col("search_question"))))


def hit_lists(hits: DataFrame) -> DataFrame:
    """Per question, its hits as one ordered array."""
    hit = F.struct("rank", "chunk_id", "page_from", "page_to", "content", "similarity")
    return hits.groupBy("question_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))


def gate(hits: Column, s=DEFAULTS) -> Column:
    """Is the first hit too far off to answer from, or missing?"""
    best = F.get(hits, F.lit(0))["similarity"]
    return F.coalesce(best, F.lit(0.0)) < s.min_similarity


def verify(drafted: DataFrame) -> DataFrame:
    """Check the draft's citations against the hits: grounded, feedback."""
    cited = F.transform("citations", lambda c: c["chunk_id"])
    given = F.transform("hits", lambda h: h["chunk_id"].cast("string"))
    return drafted.withColumn("__check", guard.grounding(cited, given)).select(
        *[c for c in drafted.columns if c not in ("grounded", "feedback")],
        "__check.grounded", "__check.feedback",
    )


def _finish(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows at the end of a branch, in the flow's output shape."""
    defaults = {
        "search_question": F.lit(None).cast("string"),
        "rejection": F.lit(None).cast("string"),
        "intent": F.lit(None).cast("string"),
        "citations": F.array().cast(CITATIONS),
        "grounded": F.lit(True),
        "escalated": F.lit(False),
        "attempts": F.lit(0),
        "hits": None,
    }
    out = []
    for name, default in defaults.items():
        if name in columns:
            out.append(columns[name].alias(name))
        elif name in df.columns:
            out.append(F.col(name))
        elif default is not None:
            out.append(default.alias(name))
    return df.select("question_id", "question", columns["answer"].alias("answer"), *out)


def answer_questions(
    questions: DataFrame,
    chunks: DataFrame,
    links: DataFrame | None = None,
    ports: Ports = Ports(),
    s=DEFAULTS,
) -> DataFrame:
    """Answer a batch of questions from the chunk table, or decline.

    questions: question_id, question and, where they apply, product_id,
    history and notes (texts). Returns per question answer, citations,
    grounded, escalated, attempts, intent, rejection and hits.
    """
    for name in ("history", "notes"):
        if name not in questions.columns:
            questions = questions.withColumn(name, F.lit(None).cast("string"))
    if "product_id" not in questions.columns:
        questions = questions.withColumn("product_id", F.lit(None).cast("string"))
    question = F.col("question")
    screened = questions.withColumn("rejection", guard.prescreen(question, s))
    rejected = screened.where("rejection IS NOT NULL")

    conversation = fx.history_text(F.col("notes"), F.col("history"))
    passed = screened.where("rejection IS NULL").withColumn("conversation", conversation)
    condensed = on_rows(
        passed,
        F.length("conversation") > 0,
        lambda df: df.withColumn(
            "search_question",
            fx.search_question(ports.condense(F.col("conversation"), question), question),
        ),
        {"search_question": question},
    )
    routed = settle(condensed.withColumn("intent", ports.route(F.col("search_question"))))
    refused = routed.where(F.col("intent").isin("safety", "out_of_scope"))
    social = routed.where(F.col("intent") == "small_talk")
    # A router that failed gives NULL: the question is answered like any other.
    aside = F.col("intent").isin("safety", "out_of_scope", "small_talk")
    asked = routed.where(~F.coalesce(aside, F.lit(False)))

    prepared = prepare_questions(asked, ports)
    hits = search.hybrid_search(chunks, prepared, links, s.top_k, s)
    lists = hit_lists(search.fetch_hits(hits, chunks))
    found = settle(asked.join(lists, "question_id", "left"))
    weak = found.where(gate(F.col("hits"), s))

    pending = found.where(~gate(F.col("hits"), s)).withColumn(
        "feedback", F.lit(None).cast("string")
    )
    finished = []
    for attempt in range(1, s.max_attempts + 1):
        draft = ports.generate(
            F.col("hits"), F.col("conversation"), F.col("feedback"), F.col("search_question")
        )
        drafted = (
            pending.withColumn("__draft", draft)
            .withColumn("answer", F.col("__draft.answer"))
            .withColumn("citations", F.col("__draft.citations").cast(CITATIONS))
            .drop("__draft")
        )
        checked = settle(verify(drafted).withColumn("attempts", F.lit(attempt)))
        held = F.coalesce("grounded", F.lit(False))
        finished.append(_finish(checked.where(held), answer=F.col("answer")))
        pending = checked.where(~held)
    # A draft that failed for good keeps its rejected citations in the record.
    given_up = F.lit(guard.ESCALATION_ANSWER)
    none = F.lit(None).cast(lists.schema["hits"].dataType)
    safety = F.when(F.col("intent") == "safety", guard.SAFETY_ANSWER).otherwise(
        guard.OUT_OF_SCOPE_ANSWER
    )
    finished += [
        _finish(pending, answer=given_up, grounded=F.lit(False), escalated=F.lit(True)),
        _finish(weak, answer=given_up, grounded=F.lit(False), escalated=F.lit(True)),
        _finish(rejected, answer=guard.rejection_message(F.col("rejection")), hits=none),
        _finish(refused, answer=safety, hits=none),
        _finish(social, answer=ports.chat(question), hits=none),
    ]
    return reduce(DataFrame.unionByName, finished)


def log_entries(answers: DataFrame, latency_ms: Column | None = None) -> DataFrame:
    """Rows for the query log: every question, answered or not."""
    return answers.select(
        "question_id",
        "question",
        fx.normalized_question(F.col("question")).alias("normalized_question"),
        guard.stored_intent(F.col("intent")).alias("intent"),
        "answer",
        "citations",
        (F.col("grounded") & ~F.col("escalated")).alias("resolved"),
        (latency_ms if latency_ms is not None else F.lit(None).cast("int")).alias("latency_ms"),
    )


