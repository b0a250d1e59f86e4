"""Golden-set evaluation: per-case measures, summary, comparison, consistency."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.config import DEFAULTS
from citeline.functions import text as fx
from citeline.functions.numbers import round3
from citeline.session import settle

# Measures of a summary, in report order.
METRICS = (
    "recall", "correctness", "coverage", "invention_rate", "abstention", "escalation_rate",
)


def case_violation() -> Column:
    """What is wrong with a case's shape, or NULL."""
    pages = F.size(F.coalesce("expected_pages", F.array().cast("array<int>")))
    no_answer = F.coalesce(F.length("expected_answer"), F.lit(0)) == 0
    return F.when(
        F.col("answerable") & no_answer, "an answerable case needs expected_answer"
    ).when(~F.col("answerable") & (pages > 0), "unanswerable cases cannot expect pages")


def resolve_products(cases: DataFrame, products: DataFrame, strict: bool = True) -> DataFrame:
    """Cases with the product their brand and model name, without regard to
    case. ``strict`` fails the job on a case that names none."""
    catalogue = products.groupBy(
        fx.fold(F.col("brand")).alias("__brand"), fx.fold(F.col("model")).alias("__model")
    ).agg(F.max("product_id").alias("product_id"))
    joined = (
        cases.withColumn("__brand", fx.fold(F.col("brand")))
        .withColumn("__model", fx.fold(F.col("model")))
        .join(catalogue, ["__brand", "__model"], "left")
        .drop("__brand", "__model")
    )
    if not strict:
        return joined
    message = F.concat(F.lit("No indexed product for "), F.concat_ws(" ", "brand", "model"))
    missing = F.raise_error(message).cast(products.schema["product_id"].dataType)
    return joined.withColumn("product_id", F.coalesce("product_id", missing))


def pages_of(hits: Column) -> Column:
    """Distinct pages the hits cover, in order."""
    ranges = F.transform(hits, lambda h: F.sequence(h["page_from"], h["page_to"]))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


def recall(expected: Column, retrieved: Column) -> Column:
    """Was any expected page retrieved? NULL when none is expected."""
    return F.when(F.size(expected) > 0, F.arrays_overlap(expected, retrieved))


def found_facts(answer: Column, facts: Column) -> Column:
    """Key facts the answer contains, without regard to case."""
    said = fx.fold(F.coalesce(answer, F.lit("")))
    return F.size(F.filter(facts, lambda f: F.contains(said, fx.fold(f))))


def source_texts(
    wanted: DataFrame, chunks: DataFrame, links: DataFrame, s=DEFAULTS
) -> DataFrame:
    """Manual text behind a set of pages, per case, cut to the judge's limit.

    wanted: id, product_id, pages. chunks: chunk_id, manual_id, ordinal,
    page_from, content, applies_to. A chunk counts when its first page is
    wanted, which makes the join an equi-join on manual and page: the pages of
    a manual with a large share of the chunks spread over all tasks. Lengths alone
    are ranked, and no more parts than fill the limit are brought together.
    """
    pages = wanted.select("id", "product_id", F.explode(F.array_distinct("pages")).alias("page_from"))
    places = settle(pages.join(links.select("manual_id", "product_id").distinct(), "product_id"))
    mark = F.concat(F.lit("[page "), F.col("page_from").cast("string"), F.lit("]\n"))
    applies = F.col("applies_to").isNull() | F.array_contains("applies_to", F.col("product_id"))
    # Each part is at least "[page 1]\n" long, so this many fill the limit.
    most = s.max_source_chars // len("[page 1]\n") + 1
    first = Window.partitionBy("id").orderBy("ordinal", "chunk_id")
    before = F.sum("__chars").over(first.rowsBetween(Window.unboundedPreceding, -1))
    # Which parts fill the limit is told by their lengths; only theirs are read again.
    narrow = chunks.select(
        "manual_id", "page_from", "ordinal", "chunk_id", "applies_to", F.length("content").alias("__length")
    )
    filling = (
        narrow.join(places, ["manual_id", "page_from"])
        .where(applies)
        .select(*places.columns, "ordinal", "chunk_id", F.coalesce(F.length(mark) + F.col("__length"), F.lit(0)).alias("__chars"))
        .withColumn("__n", F.row_number().over(first))
        .where(F.col("__n") <= most)
        .withColumn("__before", F.coalesce(before, F.lit(0)))
        .where(F.col("__before") < s.max_source_chars)
    )
    kept = settle(filling.select("id", "manual_id", "page_from", "ordinal", "chunk_id").distinct())
    place = ["manual_id", "page_from", "ordinal", "chunk_id"]

    def filled(rows: DataFrame, by: list[str]) -> DataFrame:
        wanted = kept.select(*[F.col(c).alias(f"__{c}") for c in by]).distinct()
        return rows.join(wanted, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]), "left_semi")

    held = chunks.select("manual_id", "page_from", "ordinal", "chunk_id", "content", "applies_to")
    rows = (
        filled(filled(held, place).join(places, ["manual_id", "page_from"]).where(applies), ["id", *place])
        .select("id", "ordinal", "chunk_id", F.left(F.concat(mark, "content"), F.lit(s.max_source_chars)).alias("part"))
        .withColumn("__n", F.row_number().over(first))
        .where(F.col("__n") <= most)
    )
    parts = F.sort_array(F.collect_list(F.struct("__n", "part")))
    return rows.groupBy("id").agg(
        F.left(F.concat_ws("\n\n", parts["part"]), F.lit(s.max_source_chars)).alias("source")
    )


#: Pages of a bin that ranges are dealt to.
BIN = 8


def page_overlaps(wanted: DataFrame, chunks: DataFrame, width: int = BIN) -> DataFrame:
    """(id, manual_id, chunk_id, first, last): every chunk whose pages meet a
    wanted range of its manual, and the pages they share.

    wanted: id, manual_id, page_from, page_to; chunks: chunk_id, manual_id,
    page_from, page_to. Ranges are cut into bins of ``width`` pages, so that the
    join is one on manual and bin: a manual with a large share of all chunks is
    many keys. A pair that meets in several bins counts in the first of them.
    A range that is null or ends before it begins meets nothing; rows that are
    repeated are met as often.
    """

    def binned(rows: DataFrame, prefix: str) -> DataFrame:
        low, high = (F.floor((F.col(c) - 1) / width) for c in ("page_from", "page_to"))
        kept = rows.where(F.col("page_from") <= F.col("page_to"))
        return kept.withColumn("bin", F.explode(F.sequence(low, high))).withColumnsRenamed(
            {"page_from": f"{prefix}_from", "page_to": f"{prefix}_to"}
        )

    asked = binned(wanted.select("id", "manual_id", "page_from", "page_to"), "asked")
    held = binned(chunks.select("chunk_id", "manual_id", "page_from", "page_to"), "held")
    first, last = F.greatest("asked_from", "held_from"), F.least("asked_to", "held_to")
    return (
        held.join(asked, ["manual_id", "bin"])
        .where((first <= last) & (F.col("bin") == F.floor((first - 1) / width)))
        .select("id", "manual_id", "chunk_id", first.alias("first"), last.alias("last"))
    )


def grade(results: DataFrame, judge) -> DataFrame:
    """Add the judge's verdict: covers, invents, judge_reason, correct.

    results: question, answer, expected_answer, answerable, source.
    """
    verdict = judge(
        F.col("answer"), F.col("expected_answer"), F.col("answerable"), F.col("source")
    )
    covers, invents = F.col("__v.covers"), F.col("__v.invents")
    return (
        results.withColumn("__v", verdict)
        .withColumns(
            {
                "covers": F.coalesce(covers, F.lit(False)),
                "invents": F.coalesce(invents, F.lit(False)),
                "judge_reason": F.coalesce("__v.reason", F.lit("judge error")),
            }
        )
        .withColumn("correct", F.col("covers") & ~F.col("invents"))
        .drop("__v")
    )


def case_results(cases: DataFrame, answers: DataFrame, sources: DataFrame, judge) -> DataFrame:
    """One graded row per case: cases (with id and question), the flow's
    answers (question_id = id), and the text behind the pages. latency_ms is
    that of the answers where they have one; a batch has none per question."""
    if "latency_ms" not in answers.columns:
        answers = answers.withColumn("latency_ms", F.lit(None).cast("int"))
    answered = answers.select(
        F.col("question_id").alias("id"), "answer", "citations", "grounded", "escalated",
        "attempts", F.col("intent").alias("intent_actual"), "hits", "latency_ms",
    )
    joined = cases.join(answered, "id").join(sources, "id", "left")
    graded = grade(joined.withColumn("source", F.coalesce("source", F.lit(""))), judge)
    retrieved = F.coalesce(pages_of(F.col("hits")), F.array().cast("array<bigint>"))
    cited = F.array_sort(F.array_distinct(F.transform("citations", lambda c: c["page"])))
    best = F.round(F.get(F.col("hits"), F.lit(0))["similarity"], 3)
    facts = F.coalesce("key_facts", F.array().cast("array<string>"))
    return graded.select(
        "id", "question", F.concat_ws(" ", "brand", "model").alias("product"), "answerable",
        F.col("intent").alias("intent_expected"),
        F.coalesce("intent_actual", F.lit("")).alias("intent_actual"),
        recall(F.col("expected_pages").cast("array<bigint>"), retrieved).alias("recall"),
        "correct", "covers", "invents", "judge_reason", "attempts",
        cited.alias("cited_pages"),
        F.when(
            F.size(facts) > 0,
            F.concat_ws("/", found_facts(F.col("answer"), facts), F.size(facts)),
        ).alias("key_facts_found"),
        "grounded", "escalated",
        F.coalesce(best, F.lit(0.0)).alias("best_similarity"),
        retrieved.alias("pages_retrieved"),
        "answer", "latency_ms",
    )


def _ratio(flag: str, among: Column) -> Column:
    truth = F.coalesce(F.col(flag), F.lit(False)).cast("int")
    return F.avg(F.when(among, truth))


def summarise(results: DataFrame) -> DataFrame:
    """One row of measures over graded cases, in a single pass.

    Answerable and unanswerable cases are kept apart. The median is the upper
    one: the element behind the middle, never a mean of two.
    """
    yes, no = F.col("answerable"), ~F.col("answerable")
    measured = results.agg(
        F.count("*").alias("cases"),
        F.count_if(yes).alias("answerable"),
        F.count_if(no).alias("unanswerable"),
        _ratio("recall", yes & F.col("recall").isNotNull()).alias("recall"),
        _ratio("correct", yes).alias("correctness"),
        _ratio("covers", yes).alias("coverage"),
        _ratio("invents", yes).alias("invention_rate"),
        _ratio("correct", no).alias("abstention"),
        _ratio("escalated", yes).alias("escalation_rate"),
        upper_median("latency_ms").alias("median_latency_ms"),
    )
    return measured.withColumns({name: round3(F.col(name)) for name in METRICS})


def upper_median(column: str) -> Column:
    """sorted[n // 2], exactly. Held as counts per distinct value, which for
    whole milliseconds stays small however many rows there are."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)").cast("long")


def long_metrics(summary: DataFrame) -> DataFrame:
    """A summary as (metric, value): the ratios, not the counts."""
    return summary.unpivot([], list(METRICS), "metric", "value")


def compare_runs(summary: DataFrame, previous: DataFrame) -> DataFrame:
    """Each measure beside the previous run's; no change where either lacks it."""
    before = long_metrics(previous).withColumnRenamed("value", "before")
    return (
        long_metrics(summary)
        .where("value IS NOT NULL")
        .join(before, "metric", "left")
        .withColumn("change", F.col("value") - F.col("before"))
    )


def failures(results: DataFrame) -> DataFrame:
    """Cases that went wrong. A missing recall is not a miss."""
    missed = F.col("recall").eqNullSafe(F.lit(False))
    return results.where(~F.col("correct")).select(
        "id", F.when(missed, "no-recall").otherwise("").alias("flag"),
        F.left("judge_reason", F.lit(58)).alias("reason"),
    )


def consistency(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated verdicts (id, round, matches) of the same answers: the overall
    stability, and the cases on which the rounds disagree."""
    per_case = verdicts.groupBy("id").agg(
        F.count_if(F.col("matches")).alias("passed"),
        F.count_if(~F.col("matches")).alias("failed"),
    )
    unstable = (F.col("passed") > 0) & (F.col("failed") > 0)
    overall = per_case.agg(
        F.count("*").alias("cases"),
        F.count_if(unstable).alias("unstable"),
    ).withColumn(
        "stability",
        round3(1 - F.col("unstable") / F.nullif(F.col("cases"), F.lit(0))),
    )
    return overall, per_case.where(unstable)


def judge_rounds(results: DataFrame, judge, rounds: int = DEFAULTS.judge_rounds) -> DataFrame:
    """Grade the same stored answers several times: (id, round, matches)."""
    repeated = results.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    return grade(repeated, judge).select("id", "round", F.col("correct").alias("matches"))
