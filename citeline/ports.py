"""Ports: the places where a model or a library plugs in.

A port is a plain function over a batch. The operators run it on Arrow batches,
only on the rows that need it; a job passes its own function (a model client,
say) in place of the default. The defaults are deterministic and need nothing
but Python, so that jobs run offline.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.functions import guard
from citeline.functions import text as fx
from citeline.functions.arrow import bounded_batches, pieces

DIMENSIONS = 64


# --- embedder ---------------------------------------------------------------

def hash_embedder(dimensions: int = DIMENSIONS) -> Callable[[pa.Array], np.ndarray]:
    """Feature hashing of tokens to a signed, unit-length vector.

    Each distinct token of a batch is hashed once; the sums are integers, so
    the vector does not depend on the order of addition.
    """

    def embed(tokens: pa.ListArray) -> np.ndarray:
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(
            zero_copy_only=False
        )
        coded = tokens.flatten().dictionary_encode()
        digests = [hashlib.md5(t.encode()).hexdigest() for t in coded.dictionary.to_pylist()]
        place = np.array([int(d[:8], 16) % dimensions for d in digests], dtype=np.int64)
        sign = np.array([1.0 if d[8] < "8" else -1.0 for d in digests])
        codes = coded.indices.to_numpy()
        rows = np.repeat(np.arange(len(tokens)), lengths)
        sums = np.bincount(
            rows * dimensions + place[codes] if len(codes) else np.empty(0, np.int64),
            weights=sign[codes] if len(codes) else None,
            minlength=len(tokens) * dimensions,
        ).reshape(len(tokens), dimensions)
        norms = np.sqrt((sums * sums).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(norms[:, None] > 0, sums / norms[:, None], 0.0)

    return embed


def embed(
    df: DataFrame,
    source: str,
    name: str = "embedding",
    embedder: Callable[[pa.Array], np.ndarray] | None = None,
    of_tokens: bool = True,
) -> DataFrame:
    """Add the vector of a text column.

    The default embedder reads tokens, cut in the JVM; a model takes the text
    itself (``of_tokens=False``).
    """
    run = embedder or hash_embedder()
    fed = fx.tokens(F.col(source)) if of_tokens else F.col(source)
    fields = T.StructType(df.schema.fields + [T.StructField(name, T.ArrayType(T.FloatType()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "__fed")):
            vectors = run(batch.column("__fed")).astype(np.float32)
            flat = pa.array(vectors.reshape(-1), pa.float32())
            offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*kept, column], names=[*names, name])

    return bounded_batches(df.withColumn("__fed", fed)).mapInArrow(add, fields)


# --- page extractors --------------------------------------------------------

def split_pages(text: Column) -> Column:
    """Pages of a text file: form feeds when there are any, else its lines."""
    return F.when(F.contains(text, F.lit("\f")), F.split(text, "\f")).otherwise(
        F.split(text, "\n")
    )


def page_port(function: Callable[[bytes], list[str]]) -> Callable[[Column], Column]:
    """Wrap an extractor of files (bytes to page texts) as an Arrow UDF.

    Returns struct(pages, error): a file that breaks the extractor is a row
    with an error, never a failed job.
    """

    @F.pandas_udf("pages array<string>, error string")
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            try:
                rows.append((list(function(content)), None))
            except Exception as error:  # noqa: BLE001 - the file's fault
                rows.append(([], f"{type(error).__name__}: {error}"))
        return pd.DataFrame(rows, columns=["pages", "error"])

    return run


def text_pages(content: Column) -> Column:
    """Default extractor of files: text, split into pages in the JVM."""
    return F.struct(
        split_pages(F.decode(content, "utf-8")).alias("pages"),
        F.lit(None).cast("string").alias("error"),
    )


def html_text(html: Column) -> Column:
    """Visible text of an HTML page by pattern: no script, style or tags."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return fx.strip(F.regexp_replace(text, rf"[{fx.BLANK}]+", " "))


def html_layout(html: Column) -> Column:
    """As ``html_text``, with a line break where a block element ends."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?i)</(p|div|li|ul|ol|h[1-6]|tr|title|nav)>|<br */?>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return fx.strip(F.regexp_replace(text, r"[ \n]*\n[ \n]*", "\n"))


EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "raw": lambda html: html,
    "text": html_text,
    "layout": html_layout,
}


# --- model ports over text columns ------------------------------------------

def text_port(function: Callable[..., str | None], on_error: int | None = None):
    """Wrap a per-row text function as an Arrow UDF.

    Returns NULL on an exception or an empty reply, so that callers fall back
    on the original; ``on_error`` names the argument returned instead.
    """

    @F.pandas_udf(T.StringType())
    def run(*columns: pd.Series) -> pd.Series:
        def one(*args):
            try:
                return function(*args) or (None if on_error is None else args[on_error])
            except Exception:  # noqa: BLE001 - a failed call degrades, never breaks
                return None if on_error is None else args[on_error]

        return pd.Series([one(*row) for row in zip(*columns)], dtype=object)

    return run


def keep_original(text: Column) -> Column:
    """Translator and condenser default: the question as it is."""
    return text


def glossary(words: dict[str, str]) -> Callable[[Column], Column]:
    """Translator from a fixed word list, word by word; a text that holds none
    of the words stays as it is."""

    def translate(text: Column) -> Column:
        said = fx.tokens(text)
        known = F.array(*[F.lit(w) for w in words])
        turned = F.transform(said, lambda w: F.coalesce(guard.lookup(words, w), w))
        return F.when(F.arrays_overlap(said, known), F.concat_ws(" ", turned)).otherwise(text)

    return translate


# The default router's rules, first match wins.
ROUTES = (
    ("safety", r"(?iU)\b(gas|wiring|refrigerant|dismantle|mains)\b"),
    ("small_talk", r"(?iU)\A\s*(hi|hello|hola|thanks|thank you|gracias)\b"),
    ("error_code", r"(?U)\b[EF][0-9]{1,3}\b|(?i)\berror code\b"),
    ("out_of_scope", r"(?iU)\b(weather|football|recipe)\b"),
)


def keyword_router(question: Column) -> Column:
    """Intent by keyword rules; anything else asks how to do something."""
    choice = F.lit(None).cast("string")
    for intent, pattern in reversed(ROUTES):
        choice = F.when(question.rlike(pattern), intent).otherwise(choice)
    return F.coalesce(choice, F.lit("how_to"))


GREETING = "Hello. Which appliance do you mean, and what would you like to know about it?"


def greet(question: Column) -> Column:
    """Chat default: a fixed greeting that states no fact."""
    return F.when(question.isNotNull(), F.lit(GREETING))


def quote_best(hits: Column, feedback: Column) -> Column:
    """Generator default: quote the best hit and cite it.

    ``hits`` is array<struct<rank, chunk_id, page_from, page_to, content,
    similarity>>, best first; returns struct(answer, citations).
    """
    best = F.get(hits, F.lit(0))
    citation = F.struct(
        best["chunk_id"].cast("string").alias("chunk_id"),
        best["page_from"].cast("int").alias("page"),
    )
    return F.struct(best["content"].alias("answer"), F.array(citation).alias("citations"))


def overlap_judge(
    answer: Column, reference: Column, answerable: Column, source: Column
) -> Column:
    """Judge default: the share of shared tokens.

    Covers when the answer holds half of the reference's tokens; invents when
    fewer than half of the answer's tokens occur in the source or reference.
    For a question without an answer, declining is right.
    """
    said = F.array_distinct(fx.tokens(F.coalesce(answer, F.lit(""))))
    wanted = F.array_distinct(fx.tokens(F.coalesce(reference, F.lit(""))))
    known = F.array_union(wanted, F.array_distinct(fx.tokens(F.coalesce(source, F.lit("")))))
    covers = F.size(F.array_intersect(said, wanted)) * 2 >= F.size(wanted)
    invents = F.size(F.array_intersect(said, known)) * 2 < F.size(said)
    declined = answer.isin(guard.ESCALATION_ANSWER, guard.OUT_OF_SCOPE_ANSWER)
    covers = F.when(answerable, covers).otherwise(F.coalesce(declined, F.lit(False)))
    invents = F.when(answerable, invents).otherwise(~F.coalesce(declined, F.lit(False)))
    reason = (
        F.when(covers & ~invents, "matches")
        .when(~covers, "differs from the reference")
        .otherwise("states something the source does not hold")
    )
    return F.struct(covers.alias("covers"), invents.alias("invents"), reason.alias("reason"))


def note_facts(notes: Column, transcript: Column) -> Column:
    """Summariser default: the first message as the goal, and every code or
    number said so far (words that hold a digit) as the facts."""
    none = F.array().cast("array<string>")
    codes = F.filter(fx.tokens(transcript), lambda w: w.rlike(r"\p{Nd}"))
    return F.struct(
        F.coalesce(notes["goal"], F.get(F.split(transcript, "\n"), F.lit(0))).alias("goal"),
        F.coalesce(notes["tried"], none).alias("tried"),
        notes["outcome"].alias("outcome"),
        F.array_union(F.coalesce(notes["facts"], none), codes).alias("facts"),
    )


def merge_facts(notes: Column, later: Column) -> Column:
    """Notes of ``note_facts`` that take in those of the messages that followed."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(notes["goal"], later["goal"]).alias("goal"),
        F.coalesce(notes["tried"], later["tried"], none).alias("tried"),
        notes["outcome"].alias("outcome"),
        F.array_union(F.coalesce(notes["facts"], none), F.coalesce(later["facts"], none)).alias("facts"),
    )


note_facts.merge = merge_facts
