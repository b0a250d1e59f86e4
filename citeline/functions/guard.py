"""Deterministic checks on questions and the fixed replies they lead to."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeline.config import DEFAULTS
from citeline.functions.text import letter_ratio, strip

# Copy-pasted instructions a question has no reason to hold.
INJECTION_PATTERNS = (
    r"\bignore\s+(all\s+)?(previous|prior|above)\s+instructions?\b",
    r"\bdisregard\s+(all\s+)?(previous|prior|above)\b",
    r"\b(olvida|ignora)\s+(las\s+)?instrucciones\b",
    r"^\s*(system|assistant|developer)\s*:",
    r"<\|.*?\|>",
    r"\byou\s+are\s+now\b",
    r"\bact\s+as\s+(an?\s+)?(unrestricted|different)\b",
    r"\breveal\s+(your|the)\s+(system\s+)?prompt\b",
)

# Replies to rejected questions.
REJECTION_MESSAGES = {
    "too_short": "That is too short to work with. Describe what your appliance is doing.",
    "too_long": "That is too long. Ask one question about your appliance at a time.",
    "not_text": "I could not read that as a question. Try describing the problem in words.",
    "injection": "I can only answer questions about appliance manuals.",
}

# Replies that need no retrieval, and the honest way out.
SAFETY_ANSWER = (
    "This involves electrical, gas or refrigerant work. For your safety we do "
    "not provide instructions for it - contact the manufacturer's service "
    "centre or a qualified technician."
)
OUT_OF_SCOPE_ANSWER = (
    "This does not look like a question about an appliance manual. Ask about "
    "operating, cleaning or troubleshooting your appliance."
)
ESCALATION_ANSWER = (
    "I could not find a reliable answer to this in the manual. "
    "Passing it to the manufacturer's support team."
)
NO_CITATION_FEEDBACK = (
    "You cited nothing. Either cite the extracts you used, "
    "or state that the manual does not cover this."
)

# Routing labels kept in the query log, and language names.
STORED_INTENTS = ("error_code", "how_to", "safety", "out_of_scope")
LANGUAGE_NAMES = {
    "en": "English",
    "es": "Spanish",
    "fr": "French",
    "de": "German",
    "it": "Italian",
    "pt": "Portuguese",
    "nl": "Dutch",
    "pl": "Polish",
    "tr": "Turkish",
    "hr": "Croatian",
    "el": "Greek",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a fixed table, NULL when absent."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*pairs)[key]


def prescreen(question: Column, s=DEFAULTS) -> Column:
    """Why a question is not worth processing, or NULL to let it through."""
    text = strip(question)
    injected = F.lit(False)
    for pattern in INJECTION_PATTERNS:
        injected = injected | text.rlike(f"(?iUd){pattern}")
    return (
        F.when(F.length(text) < s.min_question_chars, "too_short")
        .when(F.length(text) > s.max_question_chars, "too_long")
        .when(letter_ratio(text) < s.question_letter_ratio, "not_text")
        .when(injected, "injection")
    )


def rejection_message(reason: Column) -> Column:
    return lookup(REJECTION_MESSAGES, reason)


def language_name(code: Column) -> Column:
    """Spelled-out language, or the code itself when unknown."""
    return F.coalesce(lookup(LANGUAGE_NAMES, code), code)


def stored_intent(intent: Column) -> Column:
    """Intent as the query log keeps it; other labels become NULL."""
    return F.when(intent.isin(*STORED_INTENTS), intent)


def grounding(cited: Column, retrieved: Column) -> Column:
    """Check cited ids against retrieved ids: struct(grounded, invented, feedback)."""
    given = F.array_distinct(F.coalesce(cited, F.array().cast("array<string>")))
    invented = F.size(F.array_except(given, retrieved))
    feedback = F.when(F.size(given) == 0, F.lit(NO_CITATION_FEEDBACK)).when(
        invented > 0,
        F.concat(
            F.lit("You cited "),
            invented.cast("string"),
            F.lit(
                " chunk id(s) that were not in the extracts provided. "
                "Cite only ids you were given."
            ),
        ),
    )
    return F.struct(
        ((F.size(given) > 0) & (invented == 0)).alias("grounded"),
        F.when(F.size(given) == 0, F.lit(0)).otherwise(invented).alias("invented"),
        feedback.alias("feedback"),
    )
