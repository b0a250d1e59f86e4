"""Threads, the answer flow, evaluation and its files."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citeline import ports
from citeline.config import Settings
from citeline.functions import guard
from citeline.functions.numbers import round3
from citeline.operators import answer, conversation, evals
from citeline.plans import ingest
from citeline import session
from citeline.session import settle
from citeline.sources import evaluation, files
from citeline.sources import evaluation as stored

# The hashing embedder is rough on texts this short.
LENIENT = Settings(min_similarity=0.15)
MESSAGES = "conversation_id int, ordinal int, role string, content string"
NOTES = "struct<goal:string,tried:array<string>,outcome:string,facts:array<string>>"


def thread(spark, n):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(n)]
    return spark.createDataFrame(rows, MESSAGES)


def state(spark, through=0):
    return spark.createDataFrame(
        [(1, through, None)], f"conversation_id int, summarised_through int, summary {NOTES}"
    )


def test_last_messages_in_reading_order(spark):
    assert sorted(r.ordinal for r in conversation.recent_messages(thread(spark, 10), 4).collect()) == [6, 7, 8, 9]
    assert conversation.history(thread(spark, 4), 2).first().history == "user: m2\nassistant: m3"


def test_notes_wait_for_the_window_and_then_fold_once(spark):
    assert conversation.summary_ranges(state(spark), thread(spark, 6)).count() == 0
    messages = thread(spark, 10)
    seen = []

    def summarise(notes, transcript):
        return F.struct(
            transcript.alias("goal"), F.array().cast("array<string>").alias("tried"),
            F.lit(None).cast("string").alias("outcome"), F.array().cast("array<string>").alias("facts"),
        )

    once = conversation.fold_summaries(state(spark), messages, summarise).first()
    assert once.summarised_through == 4
    assert once.summary.goal == "user: m0\nassistant: m1\nuser: m2\nassistant: m3"
    again = conversation.fold_summaries(state(spark, 4), messages, summarise).first()
    assert again.summarised_through == 4 and again.summary is None and not seen


def test_a_failed_summary_keeps_the_notes_and_moves_on(spark):
    fail = lambda notes, transcript: F.lit(None).cast(NOTES)
    row = conversation.fold_summaries(state(spark), thread(spark, 10), fail).first()
    assert row.summary is None and row.summarised_through == 4


class Counted:
    """Counts the rows that reach a model, over all tasks."""

    def __init__(self, spark):
        self.rows = spark.sparkContext.accumulator(0)
        self.embedder = ports.hash_embedder(8)

    def embed(self, df, source, name="embedding"):
        seen, inner = self.rows, self.embedder

        def embedder(tokens):
            seen.add(len(tokens))
            return inner(tokens)

        return ports.embed(df, source, name, embedder)


def small_catalogue(spark, counted):
    chunks = spark.createDataFrame(
        [(i, "m1", i, 1, 1, "en", f"text number {i} about E{i}", None) for i in range(6)],
        "chunk_id long, manual_id string, ordinal long, page_from int, page_to int, language string, content string, applies_to array<long>",
    )
    return settle(counted.embed(chunks, "content"))


def test_no_question_is_lost_and_each_is_embedded_once(spark):
    counted = Counted(spark)
    chunks = small_catalogue(spark, counted)
    questions = spark.createDataFrame(
        [(i, f"what does E{i % 6} mean here") for i in range(12)], "question_id long, question string"
    )
    some = F.col("question_id") % 2 == 0
    null = lambda kind: F.lit(None).cast(kind)
    draft = "struct<answer:string,citations:array<struct<chunk_id:string,page:int>>>"
    flows = {
        "none": answer.Ports(embed=counted.embed),
        "router": answer.Ports(embed=counted.embed, route=lambda q: F.when(some, "how_to")),
        "all routes": answer.Ports(embed=counted.embed, route=lambda q: null("string")),
        "translator": answer.Ports(embed=counted.embed, translate=lambda q: null("string")),
        "generator": answer.Ports(embed=counted.embed, generate=lambda *a: null(draft)),
        "condenser": answer.Ports(embed=counted.embed, condense=lambda c, q: null("string")),
        "chat": answer.Ports(embed=counted.embed, route=lambda q: F.lit("small_talk"), chat=lambda q: null("string")),
    }
    for name, flow in flows.items():
        before = counted.rows.value
        out = settle(answer.answer_questions(questions, chunks, ports=flow))
        assert sorted(r.question_id for r in out.collect()) == list(range(12)), name
        assert counted.rows.value - before == (0 if name == "chat" else 12), name
        assert answer.log_entries(out).count() == 12


def test_the_sink_embeds_each_chunk_once(spark, folder):
    counted = Counted(spark)
    rows = spark.createDataFrame([(f"m{i % 2}", i, f"text {i}") for i in range(3)], "manual_id string, ordinal int, content string")
    for expected in (3, 6):  # at the first write, and again over the table
        files.write_chunks(counted.embed(rows, "content"), f"{folder}/chunks", 4)
        assert counted.rows.value == expected
    assert files.read_chunks(spark, f"{folder}/chunks").count() == 3


def test_a_read_error_is_not_taken_for_an_empty_table(spark, folder):
    rows = spark.createDataFrame([("m", 1)], "manual_id string, ordinal int")
    with open(f"{folder}/broken", "w") as file:
        file.write("this is no table")
    with pytest.raises(Exception, match="(?i)parquet|file"):
        files.write_chunks(rows, f"{folder}/broken")


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere)


def test_reports_are_replaced_and_compared(spark, folder):
    graded = spark.createDataFrame(
        [(1, True, True, True, True, False, False, 10), (2, False, None, True, True, False, False, 20)],
        "id long, answerable boolean, recall boolean, correct boolean, covers boolean, invents boolean, escalated boolean, latency_ms int",
    )
    summary = evals.summarise(graded)
    worse = evals.summarise(graded.withColumn("correct", F.lit(False)))
    for at, s in (("2024-01-01", summary), ("2024-01-02", worse), ("2024-01-02", worse)):
        stored.write_report(s, graded, at, {}, folder)
    kept = stored.read_summaries(spark, folder)
    assert kept.count() == 2 and stored.read_results(spark, f"{folder}/cases").count() == 4
    changes = {r.metric: r.change for r in stored.compare_with_last(summary, kept).collect()}
    assert changes["correctness"] == 1.0 and changes["recall"] == 0.0
    earlier = {r.metric: r.change for r in stored.compare_with_last(worse, kept, "2024-01-02").collect()}
    assert earlier["correctness"] == -1.0
    whole = spark.createDataFrame([("t", "t", {"recall@5": 0.5, "correctness": 1.0})], "run_at string, run string, summary map<string,double>")
    row = stored.report_summaries(whole).first()
    assert (row.recall, row.correctness, row.coverage) == (0.5, 1.0, None)


def test_a_long_backlog_folds_segment_by_segment(spark):
    messages = thread(spark, 150)
    row = conversation.fold_summaries(state(spark), messages, ports.note_facts).first()
    assert row.summarised_through == 144
    assert row.summary.goal == "user: m0" and len(row.summary.facts) == 144


def test_summaries_that_merge_take_no_round_per_segment(spark):
    """The same notes as segment by segment, over several levels, with one call of
    the summariser however long the thread is."""
    rows = [(c, i, "user", f"m{i} {'e' * (i % 7 > 3)}{i % 90}") for c, n in ((1, 420), (2, 9), (3, 5)) for i in range(n)]
    messages = spark.createDataFrame(rows, "conversation_id int, ordinal int, role string, content string")
    held = ("old goal", None, "done", ["e4", "x1", "e4"])
    threads = spark.createDataFrame(
        [(1, 0, held), (2, 1, None), (3, 0, held), (4, 0, None)],
        f"conversation_id int, summarised_through int, summary {NOTES}",
    )
    calls = []

    def summarise(notes, transcript):
        calls.append(1)
        return ports.note_facts(notes, transcript)

    s = Settings(transcript_segment=5)
    in_turn = conversation.fold_summaries(threads, messages, lambda n, t: ports.note_facts(n, t), s)
    summarise.merge = ports.merge_facts
    merged = conversation.fold_summaries(threads, messages, summarise, s)
    assert merged.orderBy("conversation_id").collect() == in_turn.orderBy("conversation_id").collect()
    assert len(calls) == 1


def test_source_texts_are_chosen_by_length(spark):
    """Only the chunks that fill the limit are read with their text, whatever else shares the page."""
    rows = [(i, "m", i // 2, 3, None if i == 4 else "" if i == 5 else f"{i} " + "x" * (i % 40), None if i % 5 else [7]) for i in range(300)]
    chunks = spark.createDataFrame(
        [*rows, rows[2]], "chunk_id int, manual_id string, ordinal int, page_from int, content string, applies_to array<long>"
    )
    links = spark.createDataFrame([("m", 7), ("m", 8), ("m", 8)], "manual_id string, product_id long")
    wanted = spark.createDataFrame([(1, 7, [3, 3]), (2, 8, [3]), (2, 8, [3]), (3, 8, [9])], "id int, product_id long, pages array<long>")
    s = Settings(max_source_chars=400)
    found = evals.source_texts(wanted, chunks, links, s)
    want = {}
    for case, product, times in ((1, 7, 1), (2, 8, 2)):
        mine = sorted((r for r in [*rows, rows[2]] for _ in range(times) if r[5] is None or product in r[5]), key=lambda r: (r[2], r[0]))
        want[case] = "\n\n".join(f"[page 3]\n{r[4]}" for r in mine if r[4] is not None)[:400]
    assert {r.id: r.source for r in found.collect()} == want
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()


def test_requests(spark):
    products = spark.createDataFrame([(1, "tok")], "product_id int, public_token string")
    threads = spark.createDataFrame([(5, 1), (6, None)], "conversation_id int, product_id int")
    rows = [
        (0, "q", None, None, None), (1, "q", 1, None, None), (2, "q", None, "tok", None),
        (3, "q", None, "bad", None), (4, "q", None, None, 5), (5, "q", None, None, 9),
        (6, "q", 2, None, 5), (7, "q", 1, None, 6), (8, "", 1, None, None), (9, "q", None, "", None),
    ]
    df = spark.createDataFrame(rows, "request_id int, question string, product_id int, product_token string, conversation_id int")
    got = {r.request_id: r for r in conversation.resolve_requests(df, products, threads).collect()}
    assert [got[i].resolved_product for i in (1, 2, 4)] == [1, 1, 1]
    assert [i for i, r in sorted(got.items()) if r.problem] == [0, 3, 5, 6, 7, 8, 9]
    assert "another product" in got[6].problem and "token" in got[3].problem


def corpus(spark):
    rows = [
        ("c1", "m1", "Clean the air filter every two weeks.", 3, 3),
        ("c2", "m1", "Error E5 means the water inlet is closed.", 7, 8),
        ("c3", "m2", "Preheat the oven to 200 degrees.", 1, 1),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, manual_id string, content string, page_from int, page_to int")
    return ports.embed(df.withColumn("applies_to", F.lit(None).cast("array<int>")), "content")


def ask(spark, rows, **over):
    df = spark.createDataFrame(rows, "question_id int, question string, product_id int, history string, notes string")
    links = spark.createDataFrame([("m1", 1), ("m2", 2)], "manual_id string, product_id int")
    got = answer.answer_questions(df, corpus(spark), links, answer.Ports(**over), LENIENT)
    return {r.question_id: r for r in got.collect()}


def test_every_branch_of_the_flow(spark):
    got = ask(
        spark,
        [
            (1, "What does error E5 mean?", 1, None, None),
            (2, "How do I clean the air filter", 1, None, None),
            (3, "x", 1, None, None),
            (4, "Can I open the gas pipe?", 1, None, None),
            (5, "hello there", 1, None, None),
            (6, "violin umbrella", 1, None, None),
            (7, "How do I clean the air filter", 2, None, None),
            (8, "and the weather today?", 1, None, None),
        ],
    )
    assert got[1].citations[0].chunk_id == "c2" and got[1].citations[0].page == 7
    assert got[1].intent == "error_code" and got[1].grounded and got[1].attempts == 1
    assert got[2].citations[0].chunk_id == "c1"
    assert got[3].answer == guard.REJECTION_MESSAGES["too_short"] and got[3].grounded
    assert got[4].answer == guard.SAFETY_ANSWER and got[8].answer == guard.OUT_OF_SCOPE_ANSWER
    assert got[5].answer == ports.GREETING and got[5].hits is None
    assert got[6].escalated and got[6].attempts == 0
    # Scoped to the other appliance, the filter is not in reach.
    assert all(h.chunk_id == "c3" for h in got[7].hits)


def test_retry_with_feedback_then_escalation(spark):
    def generate(hits, conversation, feedback, question):
        good = ports.quote_best(hits, feedback)["citations"]
        bad = F.array(F.struct(F.lit("made up").alias("chunk_id"), F.lit(1).alias("page")))
        corrects = feedback.isNotNull() & question.contains("filter")
        return F.struct(F.lit("a").alias("answer"), F.when(corrects, good).otherwise(bad).alias("citations"))

    got = ask(
        spark,
        [(1, "clean the air filter", 1, None, None), (2, "What does error E5 mean", 1, None, None)],
        generate=generate,
    )
    assert (got[1].grounded, got[1].attempts, got[1].escalated) == (True, 2, False)
    assert (got[2].grounded, got[2].attempts, got[2].escalated) == (False, 2, True)
    # The record keeps the citations that were rejected.
    assert got[2].citations[0].chunk_id == "made up"


def test_condensing_sees_only_follow_ups(spark):
    def condense(conversation, question):
        return F.when(conversation.contains("E5"), "what does error E5 mean")

    got = ask(
        spark,
        [
            (1, "and how long does it take", 1, "user: E5", None),
            (2, "clean the air filter", 1, "user: hm", None),
            (3, "clean the air filter", 1, None, "E5"),
            (4, "clean the air filter", 1, None, None),
        ],
        condense=condense,
    )
    assert got[1].search_question == got[3].search_question == "what does error E5 mean"
    assert got[2].search_question == got[4].search_question == "clean the air filter"
    log = answer.log_entries
    assert log is not None


def test_failing_port_falls_back(spark):
    def boom(text):
        if "x" in text:
            raise ValueError(text)
        return text.upper() if text != "empty" else ""

    df = spark.createDataFrame([("x",), ("ok",), ("empty",)], "t string")
    plain = [r[0] for r in df.select(ports.text_port(boom)("t")).collect()]
    kept = [r[0] for r in df.select(ports.text_port(boom, on_error=0)("t")).collect()]
    assert plain == [None, "OK", None] and kept == ["x", "OK", "empty"]


def results(spark):
    rows = [
        (1, True, True, True, True, False, False, 30),
        (2, True, False, False, True, True, True, 10),
        (3, True, None, True, True, False, False, 20),
        (4, False, None, False, False, True, False, 40),
    ]
    return spark.createDataFrame(
        rows, "id int, answerable boolean, recall boolean, correct boolean, covers boolean, "
        "invents boolean, escalated boolean, latency_ms int",
    ).withColumn("judge_reason", F.lit("r" * 70))


def test_summary(spark):
    row = evals.summarise(results(spark)).first().asDict()
    assert row == {
        "cases": 4, "answerable": 3, "unanswerable": 1, "recall": 0.5, "correctness": 0.667,
        "coverage": 1.0, "invention_rate": 0.333, "abstention": 0.0, "escalation_rate": 0.333,
        "median_latency_ms": 30,
    }
    empty = evals.summarise(results(spark).where("id > 9")).first()
    assert empty.cases == 0 and empty.recall is None and empty.median_latency_ms is None


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10])
def test_upper_median(spark, n):
    values = [(i * 7) % 11 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "latency_ms int")
    assert df.agg(evals.upper_median("latency_ms")).first()[0] == sorted(values)[n // 2]


def test_failures_and_comparison(spark):
    rows = {r.id: r for r in evals.failures(results(spark)).collect()}
    assert set(rows) == {2, 4} and rows[2].flag == "no-recall" and rows[4].flag == ""
    assert len(rows[2].reason) == 58
    now = evals.summarise(results(spark))
    old = evals.summarise(results(spark).where("id <> 4"))
    moved = {r.metric: r for r in evals.compare_runs(now, old).collect()}
    assert moved["abstention"].before is None and moved["abstention"].change is None
    assert moved["recall"].change == 0.0


def test_consistency(spark):
    rows = [(1, i, True) for i in range(3)] + [(2, 0, True), (2, 1, False), (2, 2, True)]
    overall, unstable = evals.consistency(spark.createDataFrame(rows, "id int, round int, matches boolean"))
    assert tuple(overall.first()) == (2, 1, 0.5)
    assert [(r.id, r.passed, r.failed) for r in unstable.collect()] == [(2, 2, 1)]


CASE = {"id": "a", "question": "q", "brand": "Haier", "model": "X1", "expected_answer": "yes", "expected_pages": [3]}


def write(path, *cases):
    with open(path, "w") as out:
        out.write("\n".join(json.dumps(c) for c in cases))


def test_cases_are_checked(spark, folder):
    write(f"{folder}/good.json", CASE, CASE | {"id": "b", "answerable": False, "expected_pages": []})
    rows = {r.id: r for r in evaluation.read_cases(spark, folder).collect()}
    assert rows["a"].answerable and rows["a"].key_facts == [] and not rows["b"].answerable
    write(f"{folder}/more.json", CASE)
    with pytest.raises(PySparkException, match="Duplicate case id a"):
        evaluation.read_cases(spark, folder).collect()


@pytest.mark.parametrize(
    "bad", [{"expected_answer": None}, {"answerable": False}, {"answerable": "maybe"}]
)
def test_malformed_cases_fail(spark, folder, bad):
    write(f"{folder}/bad.json", CASE | bad)
    with pytest.raises((PySparkException, Py4JJavaError)):
        evaluation.read_cases(spark, folder).collect()


def test_yaml_cases(spark, folder):
    with open(f"{folder}/x.yaml", "w") as out:
        out.write("- id: a\n  question: q\n  brand: B\n  model: M\n  expected_answer: yes it is\n")
    assert evaluation.read_yaml_cases(spark, folder).first().expected_answer == "yes it is"


def test_missing_product_fails_the_run(spark, folder):
    write(f"{folder}/c.json", CASE)
    cases = evaluation.read_cases(spark, folder)
    known = spark.createDataFrame([(7, "HAIER", "x1")], "product_id int, brand string, model string")
    assert evals.resolve_products(cases, known).first().product_id == 7
    with pytest.raises(PySparkException, match="No indexed product for Haier X1"):
        evals.resolve_products(cases, known.where("product_id < 0")).collect()


def test_reports(spark, folder):
    for stamp in ("2026-01-01T10:00:00+00:00", "2026-01-02T10:00:00+00:00"):
        evaluation.write_report(
            evals.summarise(results(spark)), results(spark), stamp, {"top_k": 5, "chunk_size": 1200}, folder
        )
    cases = evaluation.read_results(spark, f"{folder}/cases")
    last = evaluation.latest_run(cases)
    assert {r.run for r in last.collect()} == {"2026-01-02T10-00-00+00-00"} and last.count() == 4
    before = evaluation.latest_run(cases, "2026-01-02T10-00-00+00-00")
    assert {r.run for r in before.collect()} == {"2026-01-01T10-00-00+00-00"}
    config = spark.read.json(f"{folder}/summary").first().config
    assert config.top_k == "5" and config.chunk_size == "1200"


def test_old_report_files_read_with_nulls(spark, folder):
    report = {
        "run_at": "2026-01-01T10:00:00+00:00", "config": {"top_k": 5}, "summary": {"recall@5": 0.6, "cases": 8},
        "cases": [{"id": "a", "manual": "old", "correct": False, "recall": False, "latency_ms": 5}],
    }
    with open(f"{folder}/r.json", "w") as out:
        json.dump(report, out, indent=2)
    row = evaluation.read_reports(spark, folder).first()
    assert row.run == "2026-01-01T10-00-00+00-00" and row.summary["recall@5"] == 0.6
    assert row.cases[0].covers is None and row.cases[0].recall is False


def test_bad_files_are_rows_not_failures(spark):
    def extract(content):
        if content.startswith(b"%broken"):
            raise ValueError("no xref " + "x" * 3000)
        return content.decode().split("\f") if content != b"scan" else []

    text = "Clean the air filter every two weeks with warm water.\fDo not use the oven without its door, ever."
    files = spark.createDataFrame(
        [("good", bytearray(text.encode())), ("bad", bytearray(b"%broken")), ("scan", bytearray(b"scan"))],
        "doc_id string, content binary",
    )
    result = ingest.ingest_files(
        files, lambda df: df.withColumn("language", F.lit("en")), ports.page_port(extract)
    )
    states = {r.manual_id: r for r in result["manuals"].collect()}
    assert (states["good"].status, states["good"].page_count, states["good"].error) == ("ready", 2, None)
    assert states["bad"].status == "failed" and states["bad"].error.startswith("ValueError: no xref")
    assert len(states["bad"].error) == 2000
    assert states["scan"].status == "failed" and states["scan"].error == ingest.SCANNED_MESSAGE
    row = result["chunks"].first()
    assert (row.manual_id, row.page_from, row.page_to, row.content) == ("good", 1, 2, text.replace("\f", "\n\n"))


def test_rounding_as_python(spark):
    values = [0.0625, 0.1875, 0.0125, 0.0375, 2 / 3, 1.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(round3(F.col("v"))).collect()]
    assert got == [None if v is None else round(v, 3) for v in values]
