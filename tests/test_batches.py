"""What a Python worker holds at a time does not grow with the table."""

import numpy as np
import pytest

from citeline import ports
from citeline.functions.arrow import BATCH_ROWS
from citeline.operators import scoring, search

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def unbounded(spark):
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY)


def test_embedding_takes_bounded_batches(unbounded):
    """The embedder sees at most so many rows, however many a partition has."""
    texts = unbounded.range(2 * BATCH_ROWS + 500).repartition(1).selectExpr("id", "'a b' AS text")
    sizes = ports.embed(texts, "text", embedder=lambda tokens: np.full((len(tokens), 1), float(len(tokens))))
    seen = [r.embedding[0] for r in sizes.collect()]
    assert len(seen) == 2 * BATCH_ROWS + 500 and max(seen) <= BATCH_ROWS


def test_ranking_takes_bounded_batches(unbounded):
    chunks = unbounded.range(3 * BATCH_ROWS).selectExpr("id AS chunk_id", "concat('word w', id % 7) AS content")
    asked = unbounded.createDataFrame([(1, ["w3", "word"])], "question_id long, terms array<string>")
    found = search.rank_candidates(chunks, asked, (search.LEXICAL,), k=2)
    assert int(unbounded.conf.get(KEY)) <= BATCH_ROWS
    assert sorted((r.rank, r.chunk_id) for r in found.collect()) == [(1, 3), (2, 10)]


def test_a_pass_of_the_scoring_is_small():
    """Eight arrays of a pass are tens of MB."""
    assert scoring._CELLS * 8 * 8 <= 64_000_000
