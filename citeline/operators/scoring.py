"""Score a block of questions against batches of chunks, inside tasks.

The arithmetic is numpy on Arrow batches: one pass over the chunk table yields
the candidates of every ranking for every question, and only the best k per
question and batch leave the task. Spark does the rest (see ``search``).
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rankings in fusion order.
VECTOR, LEXICAL, TRANSLATED = 0, 1, 2
# Scores are compared on nine decimals, so that a difference in the last bits
# of a sum never decides a tie; the chunk id does.
DECIMALS = 9
# Cells of a row x question table, or term matches, that one numpy pass works on.
_CELLS = 1_000_000


@dataclass
class QuestionBlock:
    """A bounded set of questions, laid out for scoring."""

    ids: np.ndarray
    vectors: np.ndarray | None
    translated: np.ndarray | None
    vocabulary: pa.Array
    term_start: np.ndarray
    term_questions: np.ndarray
    n_terms: np.ndarray
    products: pa.Array | None
    product_of: np.ndarray | None

    @classmethod
    def build(cls, rows: list[dict], product_type: pa.DataType) -> "QuestionBlock":
        ids = np.array([r["question_id"] for r in rows])
        terms = [sorted(set(r["terms"] or ())) for r in rows]
        vocabulary = sorted({t for ts in terms for t in ts})
        place = {t: i for i, t in enumerate(vocabulary)}
        asking = [[] for _ in vocabulary]
        for q, ts in enumerate(terms):
            for t in ts:
                asking[place[t]].append(q)
        lengths = np.array([len(a) for a in asking], dtype=np.int64)
        named = sorted({r["product_id"] for r in rows if r["product_id"] is not None})
        where = {p: i for i, p in enumerate(named)}
        return cls(
            ids=ids,
            vectors=_matrix([r["vector"] for r in rows]),
            translated=_matrix([r["translated_vector"] for r in rows]),
            vocabulary=pa.array(vocabulary, pa.string()),
            term_start=np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
            term_questions=np.array([q for a in asking for q in a], dtype=np.int64),
            n_terms=np.array([max(len(ts), 1) for ts in terms], dtype=np.float64),
            products=pa.array(named, product_type) if named else None,
            product_of=np.array([where.get(r["product_id"], -1) for r in rows]),
        )


def _matrix(vectors: list) -> np.ndarray | None:
    """Unit rows; a missing or zero vector becomes a row of NaN."""
    width = next((len(v) for v in vectors if v is not None), None)
    if width is None:
        return None
    full = np.full((len(vectors), width), np.nan)
    for i, v in enumerate(vectors):
        if v is not None:
            full[i] = v
    return _unit(full)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / norms[:, None]


def _lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Flat values of a list column and the row each one belongs to."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), lengths)


def unit_rows(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors of a list column as unit rows; NaN where there is none."""
    values, rows = _lists(column)
    matrix = np.full((len(column), width), np.nan)
    if len(values):
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
        present = np.unique(rows)
        matrix[present] = flat.reshape(len(present), width)
    return _unit(matrix)


def _allowed(column: pa.ListArray, block: QuestionBlock) -> np.ndarray | None:
    """Row x question: may this chunk answer this question's product?"""
    if block.products is None:
        return None
    values, rows = _lists(column)
    found = pc.index_in(values, value_set=block.products)
    hit = found.is_valid().to_numpy(zero_copy_only=False)
    covers = np.zeros((len(column), len(block.products) + 1), dtype=bool)
    covers[:, -1] = True  # questions that name no product
    covers[rows[hit], found.drop_null().to_numpy()] = True
    return covers[:, block.product_of]


class Held:
    """The k best scores a task has seen per ranking and question. A chunk
    below the least of them cannot be among the k best, so the more batches a
    task has read, the fewer rows it sends on."""

    def __init__(self, block: QuestionBlock, k: int):
        self.k, self.size = k, len(block.ids)
        self.scores: dict[int, np.ndarray] = {}

    def of(self, ranking: int) -> np.ndarray:
        if ranking not in self.scores:
            self.scores[ranking] = np.full((self.size, self.k), -np.inf)
        return self.scores[ranking]


def _best(
    scores: np.ndarray, ids: np.ndarray, k: int, held: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Row and question indexes of the k best rows of each column; rows with
    NaN never count, ties go to the smaller id. Updates ``held``."""
    rows_out, cols_out = [], []
    rounded = np.round(scores, DECIMALS)
    with np.errstate(invalid="ignore"):
        open_rows = rounded >= held.min(axis=1)
    for q in np.flatnonzero(open_rows.any(axis=0)):
        column = rounded[:, q]
        rows = np.flatnonzero(open_rows[:, q])
        if len(rows) > k:
            values = column[rows]
            least = np.partition(values, len(values) - k)[len(values) - k]
            rows = rows[values >= least]
            if len(rows) > k:
                order = np.lexsort((ids[rows], -column[rows]))
                rows = rows[order[:k]]
        both = np.concatenate([held[q], column[rows]])
        held[q] = np.partition(both, len(both) - k)[len(both) - k :]
        rows_out.append(rows)
        cols_out.append(np.full(len(rows), q))
    if not rows_out:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(rows_out), np.concatenate(cols_out)


class Words:
    """The tokens of a batch by number, each different one looked at once."""

    def __init__(self, column: pa.ListArray):
        values, self.rows = _lists(column)
        coded = values.dictionary_encode()
        self.different, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)

    def known(self, vocabulary: pa.Array) -> np.ndarray:
        """Place of each token in the vocabulary, or -1."""
        found = pc.fill_null(pc.index_in(self.different, value_set=vocabulary), -1)
        return found.to_numpy(zero_copy_only=False)[self.codes]


def _term_weights(words: Words, block: QuestionBlock):
    """(row, term, weight) for the question terms each chunk holds; the weight
    of a term seen n times is 1 + 1/4 + ... + 1/n^2."""
    found = words.known(block.vocabulary)
    hit = np.flatnonzero(found >= 0)
    size = max(len(block.vocabulary), 1)
    keys = words.rows[hit] * size + found[hit].astype(np.int64)
    pairs, counts = np.unique(keys, return_counts=True)
    longest = int(counts.max()) if len(counts) else 0
    saturation = np.cumsum(1.0 / np.arange(1, longest + 1) ** 2)
    return pairs // size, pairs % size, saturation[counts - 1]


def _lexical_scores(rows, terms, weights, first, last, block) -> np.ndarray:
    """Row x question score for rows first..last-1; NaN where nothing matches."""
    lo, hi = np.searchsorted(rows, [first, last])
    rows, terms, weights = rows[lo:hi] - first, terms[lo:hi], weights[lo:hi]
    start, stop = block.term_start[terms], block.term_start[terms + 1]
    times = stop - start
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    questions = block.term_questions[np.repeat(start, times) + at]
    width = len(block.ids)
    sums = np.bincount(
        np.repeat(rows, times) * width + questions,
        weights=np.repeat(weights, times),
        minlength=(last - first) * width,
    ).astype(np.float64).reshape(last - first, width)
    sums[sums == 0] = np.nan
    return sums / block.n_terms


def score_chunks(
    chunks: pa.RecordBatch | pa.Table,
    block: QuestionBlock,
    rankings: tuple[int, ...],
    k: int,
    schema: pa.Schema,
    held: Held | None = None,
    words: Words | None = None,
) -> pa.RecordBatch:
    """Best k chunks of one batch per question and ranking; with ``held``, only
    those that may still be among the best of all batches so far. ``words`` are the
    batch's tokens, where several blocks are scored against it."""
    held = held or Held(block, k)
    if isinstance(chunks, pa.Table):
        chunks = chunks.combine_chunks().to_batches()
        chunks = chunks[0] if chunks else None
    out = []
    n = chunks.num_rows if chunks is not None else 0
    if n and len(block.ids):
        ids = chunks.column("chunk_id").to_numpy(zero_copy_only=False)
        allowed = _allowed(chunks.column("products"), block)
        vectors = None
        if block.vectors is not None:
            width = block.vectors.shape[1]
            vectors = unit_rows(chunks.column("embedding"), width)
        weights = None
        if LEXICAL in rankings:
            weights = _term_weights(words or Words(chunks.column("tokens")), block)
        step = max(1, _CELLS // len(block.ids))
        if weights is not None:
            times = np.diff(block.term_start)[weights[1]]
            per_row = times.sum() / n
            step = max(1, min(step, int(_CELLS / max(per_row, 1))))
        for first in range(0, n, step):
            last = min(n, first + step)
            for ranking in rankings:
                if ranking == LEXICAL:
                    scores = _lexical_scores(*weights, first, last, block)
                else:
                    wanted = block.vectors if ranking == VECTOR else block.translated
                    if wanted is None or vectors is None:
                        continue
                    scores = np.full((last - first, len(block.ids)), np.nan)
                    # Questions none of these chunks may answer cost nothing.
                    asking = slice(None)
                    if allowed is not None:
                        asking = np.flatnonzero(allowed[first:last].any(axis=0))
                    scores[:, asking] = vectors[first:last] @ wanted[asking].T
                if allowed is not None:
                    scores[~allowed[first:last]] = np.nan
                rows, cols = _best(scores, ids[first:last], k, held.of(ranking))
                values = scores[rows, cols]
                near = values
                if ranking == LEXICAL:
                    near = np.full(len(rows), np.nan)
                    if vectors is not None:
                        near = np.einsum(
                            "ij,ij->i", vectors[first + rows], block.vectors[cols]
                        )
                out.append((ranking, cols, first + rows, values, near))
    rankings_out = np.concatenate(
        [np.full(len(o[1]), o[0], dtype=np.int32) for o in out] or [np.empty(0, np.int32)]
    )
    cols = np.concatenate([o[1] for o in out] or [np.empty(0, int)])
    rows = np.concatenate([o[2] for o in out] or [np.empty(0, int)])
    score = np.concatenate([o[3] for o in out] or [np.empty(0)])
    near = np.concatenate([o[4] for o in out] or [np.empty(0)])
    source = chunks.column("chunk_id") if n else pa.array([], schema.field("chunk_id").type)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rankings_out, pa.int32()),
            pa.array(block.ids[cols] if len(cols) else [], schema.field("question_id").type),
            source.take(pa.array(rows, pa.int64())),
            pa.array(score, pa.float64()),
            pa.array(near, pa.float64(), from_pandas=True),
        ],
        schema=schema,
    )
