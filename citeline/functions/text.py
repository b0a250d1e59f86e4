"""Text functions, Column in and Column out.

Everything stays in the JVM except Unicode NFC, which Spark has no function
for: that one goes through an Arrow UDF, and only for the texts that can
change (see ``nfc``).
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.config import DEFAULTS

# The characters Python's str.strip() and \s treat as blanks, as
# a pattern and as a string. Java's \s differs: it knows neither U+001C-U+001F
# nor, by default, U+00A0.
BLANK = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANKS = "".join(
    chr(c)
    for c in [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WORD = r"[\p{L}\p{N}_]"

# Ligatures and marks that become several characters.
EXPANSIONS = {
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "ft",
    "ﬆ": "st",
    "…": "...",
}
# One-to-one replacements, then characters that are removed.
SINGLE_QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„‟"
DASHES = "–—―−"
HARD_SPACES = "\N{NO-BREAK SPACE}\N{FIGURE SPACE}\N{NARROW NO-BREAK SPACE}"
REMOVED = (
    "\N{ZERO WIDTH SPACE}\N{ZERO WIDTH NON-JOINER}\N{ZERO WIDTH JOINER}"
    "\N{ZERO WIDTH NO-BREAK SPACE}\N{SOFT HYPHEN}"
)

# Letters and vowels of the word-shape test (Spanish accents only).
SHAPE_LETTER = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
SHAPE_VOWEL = "aeiouáéíóúüAEIOUÁÉÍÓÚÜ"
SHAPE_WORD = f"[{SHAPE_LETTER}]{{2,}}"
# A whole word of consonants.
MUTE_WORD = (
    f"(?<![{SHAPE_LETTER}])[{SHAPE_LETTER}&&[^{SHAPE_VOWEL}]]{{2,}}+(?![{SHAPE_LETTER}])"
)


def strip(text: Column) -> Column:
    """Remove blanks at both ends, Unicode blanks included."""
    return F.btrim(text, F.lit(BLANKS))


def fold(text: Column) -> Column:
    """Lower case with the German sharp s expanded, as case folding does."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition. Characters below U+0300 never change under NFC,
    so texts made of those reach the UDF as NULL and cost no transfer."""
    changeable = text.rlike(r"[^\x{0}-\x{2ff}]")
    return F.coalesce(_nfc(F.when(changeable, text)), text)


def replace_marks(text: Column) -> Column:
    """Fold ligatures, quotes, dashes and hard spaces; drop zero-width marks.

    One look for any of them first: most texts hold none.
    """
    folded = text
    for mark, plain in EXPANSIONS.items():
        folded = F.replace(folded, F.lit(mark), F.lit(plain))
    source = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + HARD_SPACES
    target = (
        "'" * len(SINGLE_QUOTES)
        + '"' * len(DOUBLE_QUOTES)
        + "-" * len(DASHES)
        + " " * len(HARD_SPACES)
    )
    # translate() removes the characters that have no counterpart.
    folded = F.translate(folded, source + REMOVED, target)
    # All the marks lie in these few ranges, which a pattern tests quickly.
    candidates = r"[\xa0\xad\u2007-\u2212\ufb00-\ufb06\ufeff]"
    return F.when(text.rlike(candidates), folded).otherwise(text)


def mark_bullets(text: Column, paragraphs: str = "bullets") -> Column:
    """Dingbat plus control characters at a line start becomes a bullet.

    The control class holds the newline too, so a blank line becomes a bullet
    line. ``paragraphs="preserve"`` leaves newlines and tabs out of the class.
    """
    control = {
        "bullets": r"\x00-\x1f\x7f-\x9f",
        "preserve": r"\x00-\x08\x0b-\x1f\x7f-\x9f",
    }[paragraphs]
    return F.regexp_replace(
        text, rf"(?:\A|(?<=\n))[z•▪●]?[{control}]+[ \t]*", "• "
    )


def join_lines(text: Column) -> Column:
    """Undo line breaks inside words and sentences."""
    text = F.regexp_replace(text, rf"({WORD})-\n({WORD})", "$1$2")
    return F.regexp_replace(
        text,
        rf"(?<!\n)\n(?!\n)(?![•\p{{Nd}}][{BLANK}]|[{BLANK}]*\z)",
        " ",
    )


def squeeze(text: Column) -> Column:
    """Collapse blanks, trim lines, keep at most one empty line. The patterns
    match only where something changes."""
    text = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    text = F.regexp_replace(text, r" \n ?|\n ", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_text(text: Column, paragraphs: str = "bullets") -> Column:
    """Raw page text to text worth indexing; the order of steps matters."""
    text = F.regexp_replace(nfc(text), r"\(cid:\p{Nd}+\)", " ")
    text = replace_marks(text)
    text = F.regexp_replace(
        text,
        rf"(\p{{Nd}})[{BLANK}]*[ºo][{BLANK}]*([CF])(?!{WORD})",
        "$1 °$2",
    )
    text = mark_bullets(text, paragraphs)
    text = F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", " ")
    return squeeze(join_lines(text))


def letter_ratio(text: Column) -> Column:
    """Unicode letters over characters; NULL for the empty text."""
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))
    return letters / F.nullif(F.length(text), F.lit(0))


def shape_words(text: Column) -> Column:
    """Number of words of two letters or more."""
    return F.regexp_count(text, F.lit(SHAPE_WORD))


def vowelless_ratio(text: Column) -> Column:
    """Share of words without a vowel; NULL when there are no words."""
    mute = F.regexp_count(text, F.lit(MUTE_WORD))
    return mute / F.nullif(shape_words(text), F.lit(0))


def is_garbled(text: Column, s=DEFAULTS) -> Column:
    """Letters that spell nothing: enough words, too many without a vowel.

    Both together imply a least number of vowelless words, so the words of a
    readable page need not be counted at all.
    """
    mute = F.regexp_count(text, F.lit(MUTE_WORD))
    garbled = (shape_words(text) >= s.garbled_min_words) & (
        vowelless_ratio(text) > s.garbled_threshold
    )
    least = s.garbled_min_words * s.garbled_threshold
    return F.when(mute > least, F.coalesce(garbled, F.lit(False))).otherwise(F.lit(False))


def drop_reason(text: Column, s=DEFAULTS) -> Column:
    """Why a cleaned page is unusable, or NULL when it is fine."""
    return (
        F.when(F.length(text) < s.min_page_chars, "too short")
        .when(is_garbled(text, s), "garbled font")
        .when(letter_ratio(text) < s.min_letter_ratio, "not enough letters")
    )


def heading_candidate(text: Column, s=DEFAULTS) -> Column:
    """First line when it could be a section name."""
    first = strip(F.split(text, "\n", 2)[0])
    plausible = (
        (F.length(first) > 0)
        & (F.length(first) <= s.max_section_chars)
        & first.rlike(r"\p{L}")
    )
    return F.when(plausible, first)


def tokens(text: Column) -> Column:
    """Lower-cased word tokens in reading order: no stemming, no stop words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "+"), F.lit(0))


def query_terms(question: Column) -> Column:
    """Distinct tokens of a question, sorted."""
    return F.array_sort(
        F.array_distinct(
            F.regexp_extract_all(fold(question), F.lit(WORD + "+"), F.lit(0))
        )
    )


def control_pct(text: Column) -> Column:
    """Control characters other than newline, return and tab, in percent."""
    plain = F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    size = F.length(text)
    return F.when(size == 0, F.lit(0.0)).otherwise((size - plain) / size * 100)


def space_pct(text: Column) -> Column:
    """Spaces in percent."""
    size = F.length(text)
    spaces = size - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(size == 0, F.lit(0.0)).otherwise(spaces / size * 100)


def thread_title(question: Column, s=DEFAULTS) -> Column:
    """Whitespace collapsed; cut to fit, with an ellipsis."""
    text = strip(F.regexp_replace(question, rf"[{BLANK}]+", " "))
    cut = F.regexp_replace(F.left(text, F.lit(s.title_chars - 1)), r" +\z", "")
    return F.when(F.length(text) <= s.title_chars, text).otherwise(
        F.concat(cut, F.lit("…"))
    )


def normalized_question(question: Column) -> Column:
    """Grouping key of the query log: stripped and case-folded, nothing more."""
    return fold(strip(question))


def page_label(page_from: Column, page_to: Column) -> Column:
    """``page 7`` or ``pages 7-8``."""
    one = F.concat(F.lit("page "), page_from.cast("string"))
    many = F.concat(F.lit("pages "), F.concat_ws("-", page_from, page_to))
    return F.when(page_from == page_to, one).otherwise(many)


def history_text(notes: Column, lines: Column) -> Column:
    """Notes line, when there are notes, then one line per message."""
    head = F.concat(F.lit("Notes on the conversation so far: "), notes)
    return F.concat_ws("\n", F.when(F.length(notes) > 0, head), lines)


def search_question(rewrite: Column, question: Column) -> Column:
    """The rewrite when there is one, else the question as asked."""
    return F.coalesce(F.nullif(rewrite, F.lit("")), question)


def distinct_translation(translated: Column, question: Column) -> Column:
    """The translation, or NULL when it repeats the question."""
    return F.when(fold(translated) != fold(question), translated)
