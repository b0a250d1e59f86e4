"""Ingestion queries: cleaning, quality, labels, blocks, chunks, reports."""

from pyspark.sql import functions as F

from checks import check
from citeline.config import Settings
from citeline.functions import text as fx
from citeline.operators import catalog, chunking, language, pages
from citeline.plans import ingest
from citeline.session import settle
from citeline.sources.tables import document_chunks, line_pages, spread, table

LINES = """
texts AS (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, lang, generate_subscripts(parts, 1) AS page, unnest(parts) AS raw FROM texts
)"""

W = "[\\p{L}\\p{N}_]"
BLANK = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
MARKS = (
    "chr(8216) || chr(8217) || chr(8218) || chr(8219) || chr(8220) || chr(8221) || chr(8222) || chr(8223)"
    " || chr(8211) || chr(8212) || chr(8213) || chr(8722) || chr(160) || chr(8199) || chr(8239)"
    " || chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173)"
)
PLAIN = "repeat(chr(39), 4) || repeat(chr(34), 4) || repeat('-', 4) || '   '"


def clean_sql(source: str) -> str:
    """Cleaning step by step. RE2 has no look-around, so a newline that must
    stay is marked with U+E000 first and restored afterwards."""
    return f"""
c1 AS (SELECT * EXCLUDE (raw), regexp_replace(nfc_normalize(raw), '\\(cid:\\d+\\)', ' ', 'g') AS t FROM {source}),
c2 AS (SELECT * EXCLUDE (t), translate(replace(replace(replace(replace(replace(replace(replace(replace(t,
  chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'), chr(64259), 'ffi'), chr(64260), 'ffl'),
  chr(64261), 'ft'), chr(64262), 'st'), chr(8230), '...'), {MARKS}, {PLAIN}) AS t FROM c1),
c3 AS (SELECT * EXCLUDE (t), regexp_replace(t, '(\\d){BLANK}*[ºo]{BLANK}*([CF])\\b', '\\1 °\\2', 'g') AS t FROM c2),
c4 AS (SELECT * EXCLUDE (t), regexp_replace(regexp_replace(t,
  '(^|\\n)[z•▪●]?[\\x00-\\x1f\\x{{7f}}-\\x{{9f}}]+[ \\t]*', '\\1• ', 'g'),
  '[\\x00-\\x08\\x0b-\\x1f\\x{{7f}}-\\x{{9f}}]', ' ', 'g') AS t FROM c3),
c5 AS (SELECT * EXCLUDE (t), regexp_replace(t, '({W})-\\n({W})', '\\1\\2', 'g') AS t FROM c4),
c6 AS (SELECT * EXCLUDE (t), regexp_replace(regexp_replace(regexp_replace(t,
  '\\n\\n+', chr(57344) || chr(57344), 'g'), '\\n([•0-9]{BLANK})', chr(57344) || '\\1', 'g'),
  '\\n({BLANK}*)$', chr(57344) || '\\1') AS t FROM c5),
c7 AS (SELECT * EXCLUDE (t), replace(replace(t, chr(10), ' '), chr(57344), chr(10)) AS t FROM c6),
clean AS (SELECT * EXCLUDE (t), regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
  '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),
  '^{BLANK}+|{BLANK}+$', '', 'g') AS text FROM c7)"""


VOWELS = "[aeiouáéíóúüAEIOUÁÉÍÓÚÜ]"
WORDS = "regexp_extract_all({0}, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{{2,}}')"


def quality_sql(text: str) -> str:
    words = WORDS.format(text)
    return f"""CASE WHEN length({text}) < 40 THEN 'too short'
  WHEN len({words}) >= 20 AND len(list_filter({words},
    lambda w: NOT regexp_matches(w, '{VOWELS}'))) / len({words}) > 0.35 THEN 'garbled font'
  WHEN length(regexp_replace({text}, '[^\\p{{L}}]', '', 'g')) / length({text}) < 0.45
    THEN 'not enough letters' END"""


@check(
    "clean_text",
    f"""WITH source AS (SELECT doc_id, text AS raw FROM documents), {clean_sql("source")}
SELECT doc_id, text FROM clean""",
)
def clean_text(spark, folder):
    docs = spread(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", fx.clean_text(F.col("text")).alias("text"))


@check(
    "page_quality",
    f"""WITH {LINES}, {clean_sql("lines")}
SELECT doc_id, page, length(text) AS chars, {quality_sql("text")} AS reason,
  round(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / nullif(length(text), 0), 6) AS letters,
  round(len(list_filter({WORDS.format("text")}, lambda w: NOT regexp_matches(w, '{VOWELS}')))
    / nullif(len({WORDS.format("text")}), 0), 6) AS mute
FROM clean""",
)
def page_quality(spark, folder):
    cleaned = pages.clean_pages(line_pages(spark, folder))
    return cleaned.select(
        "doc_id", "page", "chars", "reason",
        F.round(fx.letter_ratio(F.col("text")), 6).alias("letters"),
        F.round(fx.vowelless_ratio(F.col("text")), 6).alias("mute"),
    )


@check(
    "section_labels",
    f"""WITH {LINES},
heads AS (
  SELECT doc_id, page, regexp_replace(raw, '^{BLANK}+|{BLANK}+$', '', 'g') AS first FROM lines
),
candidates AS (
  SELECT doc_id, page, CASE WHEN length(first) BETWEEN 1 AND 60 AND regexp_matches(first, '\\p{{L}}')
    THEN first END AS heading FROM heads
)
SELECT doc_id, page, CASE WHEN count(heading) OVER (PARTITION BY doc_id, heading) >= 2
  THEN heading END AS section FROM candidates""",
)
def section_labels(spark, folder):
    lines = line_pages(spark, folder).withColumn("heading", fx.heading_candidate(F.col("raw")))
    return pages.confirm_sections(lines).select("doc_id", "page", "section")


@check(
    "language_smoothing",
    """WITH around AS (
  SELECT source, doc_id, lang, list(lang) OVER (PARTITION BY source ORDER BY doc_id
    ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS frame FROM documents
)
SELECT source, doc_id, coalesce(list_filter(frame, lambda l:
  len(list_filter(frame, lambda x: x = l)) > len(frame) // 2)[1], lang) AS smoothed FROM around""",
)
def language_smoothing(spark, folder):
    docs = table(spark, folder, "documents").select(
        "source", "doc_id", F.col("lang").alias("language")
    )
    return pages.smooth_languages(docs, "source", "doc_id").select(
        "source", "doc_id", F.col("language").alias("smoothed")
    )


BLOCKS = """
marked AS (
  SELECT source, doc_id, lang, n_chars, text,
    coalesce(lang <> lag(lang) OVER (PARTITION BY source ORDER BY doc_id), true)::INT AS opens
  FROM documents
),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY doc_id) - 1 AS block FROM marked
),
located AS (
  SELECT *, coalesce(sum(n_chars + 2) OVER (PARTITION BY source, block ORDER BY doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM numbered
)"""


def source_blocks(spark, folder):
    docs = table(spark, folder, "documents").select(
        "source", "doc_id", F.col("lang").alias("language"), F.col("n_chars").alias("chars"), "text"
    )
    docs = docs.withColumn("section", fx.heading_candidate(F.col("text"))).drop("text")
    return pages.language_blocks(docs, "source", "doc_id")


@check("language_blocks", f"""WITH {BLOCKS} SELECT source, doc_id, block, "offset" FROM located""")
def language_blocks(spark, folder):
    return source_blocks(spark, folder).select("source", "doc_id", "block", "offset")


@check(
    "block_heads",
    f"""WITH {BLOCKS}, firsts AS (SELECT *, regexp_replace(string_split(text, chr(10))[1],
  '^{BLANK}+|{BLANK}+$', '', 'g') AS first FROM located)
SELECT source, block, min(lang) AS language,
  arg_min(CASE WHEN length(first) BETWEEN 1 AND 60 AND regexp_matches(first, '\\p{{L}}')
    THEN first ELSE '' END, doc_id) AS section,
  min(doc_id) AS first_page, max(doc_id) AS last_page, count(*) AS n_pages,
  max("offset" + n_chars) AS block_chars
FROM firsts GROUP BY source, block""",
)
def block_heads(spark, folder):
    heads = pages.block_heads(source_blocks(spark, folder), "source", "doc_id")
    return heads.withColumn("section", F.coalesce("section", F.lit("")))


@check(
    "manual_stats",
    """SELECT source || '-' || lang AS manual_id, lang AS language, count(*) AS n,
  sum(count(*)) OVER (PARTITION BY source || '-' || lang) AS chunks,
  CAST(floor(avg(length(text))) AS INT) AS avg_chunk_chars
FROM documents GROUP BY source, lang""",
)
def manual_stats(spark, folder):
    chunks = document_chunks(spark, folder)
    manuals = chunks.select("manual_id").distinct()
    stats = catalog.manual_stats(manuals, chunks)
    return stats.select(
        "manual_id", F.explode("languages").alias("language", "n"), "chunks", "avg_chunk_chars"
    )


@check(
    "page_languages",
    """WITH n AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first, sum(n_chars) AS chars
  FROM documents GROUP BY 1, 2)
SELECT source, string_agg(lang || ':' || n, ',' ORDER BY n DESC, first) AS languages,
  sum(chars) AS characters FROM n GROUP BY source""",
)
def page_languages(spark, folder):
    docs = table(spark, folder, "documents").select(
        "source", F.col("doc_id").alias("page"), F.col("lang").alias("language"),
        F.col("n_chars").alias("chars"),
    )
    found = catalog.page_languages(docs, "source")
    pair = F.transform("languages", lambda x: F.concat_ws(":", x["language"], x["n"]))
    return found.select("source", F.concat_ws(",", pair).alias("languages"), "characters")


def known_languages(spark, folder):
    """Labelled lines: the given language stands for the detector."""
    raw = line_pages(spark, folder)
    return ingest.label_pages(raw, lambda df: df.withColumnRenamed("lang", "language"))


@check(
    "labelled_pages",
    f"""WITH {LINES}, {clean_sql("lines")},
usable AS (SELECT doc_id, page, lang, text, length(text) AS chars FROM clean
  WHERE ({quality_sql("text")}) IS NULL),
first AS (SELECT *, CASE WHEN length(text) <= 60 AND regexp_matches(text, '\\p{{L}}') THEN text END AS heading
  FROM usable)
SELECT doc_id, page, lang AS language, chars, 0 AS block,
  CASE WHEN count(heading) OVER (PARTITION BY doc_id, heading) >= 2 THEN heading END AS section,
  coalesce(sum(chars + 2) OVER (PARTITION BY doc_id ORDER BY page
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
FROM first""",
)
def labelled_pages(spark, folder):
    return known_languages(spark, folder).select(
        "doc_id", "page", "language", "chars", "block", "section", "offset"
    )


USABLE = f"""{LINES}, {clean_sql("lines")},
usable AS (SELECT doc_id, page, text FROM clean WHERE ({quality_sql("text")}) IS NULL)"""


@check(
    "chunk_texts",
    f"""WITH {USABLE}
SELECT doc_id, length(t) AS chars, sha256(t) AS text FROM (
  SELECT doc_id, regexp_replace(string_agg(text, '' ORDER BY page), '{BLANK}+', '', 'g') AS t FROM usable GROUP BY 1)""",
)
def chunk_texts(spark, folder):
    """Chunks without overlap, put together again, are the document's text."""
    cut = chunking.chunk_pages(settle(known_languages(spark, folder)), Settings(chunk_overlap=0))
    joined = cut.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", "content")))["content"], "").alias("t")
    )
    text = F.regexp_replace("t", f"[{fx.BLANK}]+", "")
    return joined.select("doc_id", F.length(text).cast("long").alias("chars"), F.sha2(text, 256).alias("text"))


@check(
    "chunk_places",
    f"""WITH {USABLE}
SELECT doc_id, true AS dense, min(page) AS first_page, max(page) AS last_page, true AS rising, true AS bounded
FROM usable GROUP BY 1""",
)
def chunk_places(spark, folder):
    """Ordinals are dense, and the pages of the chunks rise and leave none out."""
    cut = chunking.chunk_pages(settle(known_languages(spark, folder)))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "page_from", "page_to")))
    steps = F.zip_with(
        F.slice("rows", F.lit(1), F.size("rows") - 1), F.slice("rows", F.lit(2), F.size("rows") - 1),
        lambda a, b: (a["page_from"] <= b["page_from"]) & (a["page_to"] <= b["page_to"]),
    )
    found = cut.groupBy("doc_id").agg(
        rows.alias("rows"),
        (F.count_distinct("ordinal") == F.max("ordinal") + 1).alias("dense"),
        F.min("page_from").cast("long").alias("first_page"),
        F.max("page_to").cast("long").alias("last_page"),
        (F.max(F.length("content")) <= Settings().chunk_size).alias("bounded"),
    )
    return found.select(
        "doc_id", "dense", "first_page", "last_page", F.forall(steps, lambda x: x).alias("rising"), "bounded"
    )


@check(
    "ingest_states",
    f"""WITH {USABLE}
SELECT d.doc_id AS manual_id, CASE WHEN count(u.page) = 0 THEN 'failed' ELSE 'ready' END AS status,
  count(u.page) AS page_count, coalesce(sum(length(u.text)), 0) AS characters
FROM documents d LEFT JOIN usable u USING (doc_id) GROUP BY 1""",
)
def ingest_states(spark, folder):
    """Ingestion with the given languages: states, pages and characters."""
    raw = line_pages(spark, folder)
    result = ingest.ingest_pages(raw, lambda df: df.withColumnRenamed("lang", "language"))
    chars = result["pages"].groupBy(F.col("doc_id").alias("manual_id")).agg(F.sum("chars").alias("characters"))
    return result["manuals"].join(chars, "manual_id", "left").select(
        "manual_id", "status", "page_count", F.coalesce("characters", F.lit(0)).cast("long").alias("characters")
    )


@check("chunks_rows")
def chunks_rows(spark, folder):
    return chunking.chunk_pages(settle(known_languages(spark, folder)))


@check("ingest_documents")
def ingest_documents(spark, folder):
    """The whole way, with a detector trained on the given languages."""
    docs = spread(spark, folder, "documents").select("text", "lang")
    model = language.train_detector(docs, "text", "lang")
    raw = line_pages(spark, folder).drop("lang")
    result = ingest.ingest_pages(raw, lambda df: language.detect(df, model))
    report = ingest.ingest_report(result["pages"], result["chunks"])
    return result["manuals"].join(
        report.withColumnRenamed("doc_id", "manual_id"), "manual_id", "left"
    )


@check("detect_language")
def detect_language(spark, folder):
    docs = spread(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.train_detector(docs, "text", "lang")
    return language.detect(docs, model).select("doc_id", "lang", "language")


@check(
    "detect_by_weights",
    """WITH heads AS (SELECT doc_id, lang, text, unnest(range(1, least(length(text), 1500) - 1)) AS pos FROM documents),
spread AS (SELECT doc_id, lang, substr(text, pos, 3) AS gram FROM heads),
n AS (SELECT gram, lang, count(*) AS n FROM spread WHERE lang IS NOT NULL GROUP BY ALL),
size AS (SELECT lang, count(*) AS docs, (SELECT coalesce(sum(n), 0) FROM n WHERE n.lang = d.lang) + (SELECT count(DISTINCT gram) FROM n) + 1 AS mass
  FROM documents d WHERE lang IS NOT NULL GROUP BY lang),
known AS (SELECT lang, mass, round(ln(docs / sum(docs) OVER ()) * 1000000)::BIGINT AS prior, round(ln(1 / mass) * 1000000)::BIGINT AS unseen FROM size),
weight AS (SELECT gram, lang, round(ln((n + 1) / mass) * 1000000)::BIGINT - unseen AS gain FROM n JOIN known USING (lang)),
gains AS (SELECT s.doc_id, w.lang, sum(gain) AS gain FROM spread s JOIN weight w USING (gram) GROUP BY ALL),
total AS (SELECT d.doc_id, d.lang, k.lang AS language, prior + coalesce(greatest(least(length(d.text), 1500) - 2, 0), 0) * unseen + coalesce(gain, 0) AS score
  FROM documents d CROSS JOIN known k LEFT JOIN gains g ON g.doc_id = d.doc_id AND g.lang = k.lang)
SELECT doc_id, lang, language FROM total QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) = 1""",
)
def detect_by_weights(spark, folder):
    """The language of every document by trigram weights learned from all of them."""
    docs = spread(spark, folder, "documents").select("doc_id", "text", "lang")
    languages, weights = language.fit_weights(docs, "text", "lang")
    found = language.detect_by_weights(docs, "doc_id", languages, weights)
    return docs.select("doc_id", "lang").join(found, "doc_id")


HTML = """
bare AS (SELECT page_id, html, regexp_replace(html, '(?is)<(script)\\b.*?</script>|<(style)\\b.*?</style>', ' ', 'g') AS t
  FROM pages),
texts AS (
  SELECT page_id, 'raw' AS backend, html AS text FROM pages
  UNION ALL SELECT page_id, 'text', regexp_replace(regexp_replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'),
    '""" + BLANK + """+', ' ', 'g'), '^""" + BLANK + """+|""" + BLANK + """+$', '', 'g') FROM bare
  UNION ALL SELECT page_id, 'layout', regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '(?i)</(p|div|li|ul|ol|h[1-6]|tr|title|nav)>|<br */?>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g'),
    '[ \\t]+', ' ', 'g'), '[ \\n]*\\n[ \\n]*', chr(10), 'g'),
    '^""" + BLANK + """+|""" + BLANK + """+$', '', 'g') FROM bare
)"""


@check(
    "extractor_report",
    f"""WITH {HTML}
SELECT page_id, backend, length(text) AS chars,
  round((length(text) - length(replace(text, ' ', ''))) / nullif(length(text), 0) * 100, 6) AS space_pct,
  round((length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')))
    / nullif(length(text), 0) * 100, 6) AS control_pct
FROM texts""",
)
def extractor_report(spark, folder):
    report = ingest.extraction_report(spread(spark, folder, "pages"), "page_id", "html")
    return report.select(
        "page_id", "backend", "chars", F.round("space_pct", 6).alias("space_pct"),
        F.round("control_pct", 6).alias("control_pct"),
    )
