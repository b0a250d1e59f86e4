"""Settings that define results, in one place.

Every operator takes these as arguments with the defaults below, so a job can
override one without touching the others.
"""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Chunking and page labelling.
    chunk_size: int = 1200
    chunk_overlap: int = 150
    page_join: str = "\n\n"
    min_page_chars: int = 40
    min_letter_ratio: float = 0.45
    max_section_chars: int = 60
    min_section_repeats: int = 2
    smoothing_window: int = 2
    garbled_threshold: float = 0.35
    garbled_min_words: int = 20
    detection_chars: int = 1500

    # Retrieval.
    top_k: int = 5
    candidates: int = 20
    rrf_k: int = 60
    pivot_language: str = "en"

    # Answer flow.
    min_similarity: float = 0.35
    max_attempts: int = 2
    min_question_chars: int = 2
    max_question_chars: int = 2000
    question_letter_ratio: float = 0.4

    # Conversations, catalogue, evaluation.
    conversation_window: int = 6
    title_chars: int = 80
    stale_after_seconds: int = 2700
    orphan_min_age_seconds: int = 3600
    max_upload_bytes: int = 100 * 1024 * 1024
    max_error_chars: int = 2000
    max_source_chars: int = 6000
    judge_rounds: int = 3

    # Ours: physical bounds. A bucket is the largest slice of one ordered group
    # that a single task sorts; the block bounds how many questions, and how many
    # bytes of them, are scored in one scan.
    order_bucket: int = 4096
    question_block_rows: int = 2048
    question_block_bytes: int = 64 * 1024 * 1024
    transcript_segment: int = 64


DEFAULTS = Settings()
