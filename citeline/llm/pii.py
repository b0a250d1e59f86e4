"""Personal data in texts, found and confirmed in native expressions.

Patterns propose spans, one kind at a time, leftmost and without overlaps.
Validators confirm them: the ranges of address parts, the Luhn sum of cards,
the mod-97 remainder of bank account numbers, the digits of phone numbers. Each
span has a score from its validator, raised by words of its kind just before
it. The kinds with strict patterns are always reported; further kinds only if
their score reaches the threshold.

A match's place is not searched for in the text: the text is split by the same
pattern, and places are running sums of the lengths of the parts and of the
matches, summed in blocks, so that a text full of matches costs no more per
match. The patterns never try a start again within a run that has already
failed, so long runs of letters or digits cost linear time as well.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm.arrays import let, running_most, running_sums
from citeline.llm.columns import fresh

#: Score from which a span of a further kind is reported.
THRESHOLD = 0.6
#: Characters before a span in which words of its kind count.
CONTEXT = 40
_PIECE = 1000
_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
_DIGITS = "[^0-9]"


def _spaces_gone(match: Column) -> Column:
    return F.regexp_replace(match, "[ -]", "")


def _octets(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _luhn(match: Column) -> Column:
    """12 to 19 digits whose Luhn sum ends in 0."""
    digits = _spaces_gone(match)
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    size = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), size),
        F.lit(0),
        lambda sum_, i: sum_
        + F.when(
            (size - i) % 2 == 1, F.get(doubled, F.substring(digits, i, F.lit(1)).cast("int"))
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.when(size.between(12, 19), total % 10 == 0).otherwise(False)


def _phone(match: Column) -> Column:
    return F.length(F.regexp_replace(match, _DIGITS, "")).between(9, 15)


def _mod97(match: Column) -> Column:
    """An account number of 15 to 34 characters with remainder 1 (letters count 10 to 35)."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 30), F.substring(plain, 1, 4))
    values = F.transform(
        F.split(turned, ""),
        lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    rest = F.aggregate(
        values, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97
    )
    return F.when(F.length(plain).between(15, 34), rest == 1).otherwise(False)


def _national(match: Column) -> Column:
    """Number groups that are given out: none of them zero, nor area 666 or 9xx."""
    return ~match.rlike("^(?:000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """How one kind is found. ``score`` is what a confirmed span has without
    words of its kind before it, ``words`` a pattern of those (lower case)."""

    name: str
    pattern: str
    valid: object
    score: float
    words: str
    always: bool


# Fixed values. A start is tried only where a run begins or where the last match
# ended, as a start within a run can match only if the run's beginning does.
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        None,
        0.9,
        "mail|contact|write",
        True,
    ),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.6, "address|host|server|ip", True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _luhn, 0.7, "card|visa|credit|payment", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _phone, 0.6, "phone|call|tel|mobile", True),
    Kind(
        "iban",
        r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
        _mod97,
        0.8,
        "iban|account|bank|konto",
        False,
    ),
    Kind(
        "national_id",
        r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        _national,
        0.4,
        "ssn|social|security",
        False,
    ),
)
#: Added to the score where a word of the kind stands before the span.
CONTEXT_SCORE = 0.3


def _confirmed(kind: Kind, found: Column, gaps: Column, ends: Column) -> Column:
    """Spans of the matches that hold, with their scores. The context of a match
    is what stands between it and the match before, CONTEXT characters at most."""

    def span(x):
        match, gap, end = x["0"], x["1"], x["2"]
        near = F.lower(F.right(gap, F.lit(CONTEXT))).rlike(kind.words)
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, CONTEXT_SCORE).otherwise(0.0))
        whole = F.struct(
            F.lit(kind.name).alias("kind"),
            (end - F.length(match)).alias("start"),
            end.alias("end"),
            score.alias("score"),
        )
        return whole if kind.valid is None else F.when(kind.valid(match), whole)

    zipped = F.zip_with(
        F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("0"), g.alias("1"))),
        ends,
        lambda x, e: F.struct(x["0"].alias("0"), x["1"].alias("1"), e.alias("2")),
    )
    least = 0.0 if kind.always else THRESHOLD
    return F.filter(F.transform(zipped, span), lambda s: s.isNotNull() & (s["score"] >= least))


def spans(value: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind in the text ``value``, in order."""
    none = F.array().cast(_SPAN)

    def placed(found):
        gaps = F.slice(F.split(value, kind.pattern, -1), F.lit(1), F.size(found))

        def summed(gaps):
            steps = F.zip_with(found, gaps, lambda m, g: F.length(m) + F.length(g))
            return let(
                steps,
                lambda steps: let(running_sums(steps), lambda ends: _confirmed(kind, found, gaps, ends)),
            )

        return F.when(F.size(found) > 0, let(gaps, summed).cast(_SPAN)).otherwise(none)

    return let(F.regexp_extract_all(value, F.lit(kind.pattern), F.lit(0)), placed)


def find(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with ``into``: all spans (kind, start, end, score) in code
    points, end exclusive, by start and then by the order of ``KINDS``.

    A null or empty text has none. Kinds are independent: spans of different
    kinds may overlap. Rows are judged each for itself; an empty table gives no
    rows; a column called ``into`` is replaced, others pass through.
    """
    out, names = docs.drop(into), []
    value = F.coalesce(F.col(text), F.lit(""))
    for kind in KINDS:
        name = fresh(out, f"__{kind.name}")
        out = out.withColumn(name, spans(value, kind))
        names.append(name)
    order = F.array(*[F.lit(kind.name) for kind in KINDS])
    ranked = F.transform(
        F.concat(*names),
        lambda s: F.struct(
            s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s.alias("span")
        ),
    )
    return out.withColumn(into, F.transform(F.array_sort(ranked), lambda s: s["span"])).drop(*names)


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters start .. end - 1 of a text given in pieces of ``_PIECE``."""
    first = F.floor(start / _PIECE).cast("int")
    size = F.floor((end - 1) / _PIECE).cast("int") - first + 1
    whole = F.array_join(F.slice(pieces, first + 1, size), "")
    return F.when(end > start, F.substring(whole, start - first * _PIECE + 1, end - start)).otherwise("")


def redacted(value: Column, pii: Column) -> Column:
    """The text ``value`` with every span of ``pii`` (by start) replaced by its
    kind in brackets. Spans that overlap go together: the kind of the first
    stands for all that they cover. A null text stays null. The time is in
    proportion to the text and the spans."""

    def marked(pieces, most):
        place = lambda s, i: F.struct(
            s["start"].alias("from"),
            F.coalesce(F.get(most, i - 1), F.lit(0)).alias("before"),
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark"),
        )
        heads = F.filter(F.transform(pii, place), lambda h: h["from"] >= h["before"])
        parts = F.transform(heads, lambda h: F.concat(_cut(pieces, h["before"], h["from"]), h["mark"]))
        return F.concat(F.array_join(parts, ""), _cut(pieces, F.element_at(most, -1), F.length(value)))

    pieces = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    ends = F.transform(pii, lambda s: s["end"].cast("int"))
    most = let(ends, running_most)
    return F.when(F.size(pii) > 0, let(pieces, lambda p: let(most, lambda m: marked(p, m)))).otherwise(value)


def _listed(spans_: Column) -> Column:
    return F.array_join(
        F.transform(
            spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def digest(found: DataFrame, doc_id: str = "doc_id", pii: str = "pii") -> DataFrame:
    """One row per document: counts and a hash of the base spans, and all spans."""
    base = [kind.name for kind in KINDS if kind.always]

    def count(name):
        return F.size(F.filter(F.col(pii), lambda s: s["kind"] == name)).cast("long")

    return found.select(
        doc_id,
        *[count(name).alias(f"n_{name}") for name in base],
        F.sha2(_listed(F.filter(F.col(pii), lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _listed(F.col(pii)).alias("spans"),
    )
