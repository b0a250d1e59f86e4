"""Catalogue queries: admission, dedupe, claims, listings, integrity."""

from pyspark.sql import functions as F

from checks import check
from citeline.config import Settings
from citeline.operators import catalog
from citeline.sources.tables import document_chunks, table

NOW = "2024-01-15 00:00:00"
SMALL = 2000  # bytes allowed in the admission check, so that some are refused


def manuals_of(spark, folder):
    """Documents as manuals: the language is the tenant, the text the file."""
    docs = table(spark, folder, "documents")
    statuses = F.array(*[F.lit(x) for x in ("pending", "ready", "processing", "failed")])
    return docs.select(
        F.col("doc_id").alias("manual_id"),
        F.col("lang").alias("tenant_id"),
        F.concat_ws(" ", "source", "lang", "doc_id").alias("title"),
        F.sha2("text", 256).alias("checksum"),
        F.concat_ws("/", "source", F.sha2("text", 256)).alias("storage_key"),
        F.get(statuses, (F.col("doc_id") % 4).cast("int")).alias("status"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp")
         + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("created_at"),
    )


MANUALS = """
manual AS (
  SELECT doc_id AS manual_id, lang AS tenant_id, source || ' ' || lang || ' ' || doc_id AS title,
    sha256(text) AS checksum, source || '/' || sha256(text) AS storage_key,
    ['pending', 'ready', 'processing', 'failed'][doc_id % 4 + 1] AS status,
    TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at, source, text, n_chars
  FROM documents
)"""


def products_of(spark, folder):
    """Vector labels as products of one brand per parity."""
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("long").alias("product_id"),
        F.lit("en").alias("tenant_id"),
        F.when(F.col("label") % 2 == 0, "Haier").otherwise("Balay").alias("brand"),
        F.concat(F.lit("M"), F.col("label")).alias("model"),
        F.lit("other").alias("type"),
        F.concat(F.lit("token"), F.col("label")).alias("public_token"),
    ).distinct()


PRODUCTS = """
product AS (
  SELECT DISTINCT label AS product_id, 'en' AS tenant_id,
    CASE WHEN label % 2 = 0 THEN 'Haier' ELSE 'Balay' END AS brand, 'M' || label AS model,
    'token' || label AS public_token
  FROM embeddings
)"""


@check(
    "checksums",
    "SELECT doc_id, sha256(text) AS checksum FROM documents",
)
def checksums(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", catalog.checksum(F.col("text")).alias("checksum"))


@check(
    "admission",
    f"""SELECT page_id, CASE WHEN regexp_matches(url, '^https:') THEN
    CASE WHEN strlen(html) > {SMALL} THEN 'The PDF exceeds the 0 MB limit.' END
  ELSE 'Only PDF files are accepted. Convert the manual and try again.' END AS reason
FROM pages""",
)
def admission(spark, folder):
    uploads = table(spark, folder, "pages")
    kind = F.when(F.col("url").startswith("https:"), catalog.PDF).otherwise("text/html")
    reason = catalog.reject_reason(
        kind, F.length("html"), F.octet_length("html"), Settings(max_upload_bytes=SMALL)
    )
    return uploads.select("page_id", reason.alias("reason"))


def uploads_of(spark, folder):
    """Every document uploaded by its source, under names of varying case."""
    docs = table(spark, folder, "documents")
    brand = F.when(F.col("doc_id") % 3 == 0, F.upper("source")).otherwise(F.col("source"))
    return docs.select(
        F.col("doc_id").alias("upload_id"),
        F.lit("public").alias("tenant_id"),
        F.sha2("text", 256).alias("checksum"),
        F.concat(F.lit(" "), brand, F.lit(" ")).alias("brand"),
        F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("model"),
        F.lit("other").alias("type"),
        F.lit(None).cast("string").alias("title"),
        F.concat_ws("/", "source", "doc_id").alias("storage_key"),
    )


def stored_state(spark, folder):
    """What the catalogue holds before: the texts that carry a quality label."""
    docs = table(spark, folder, "documents").join(
        table(spark, folder, "labels").select("doc_id").distinct(), "doc_id", "left_semi"
    )
    manuals = docs.select(
        F.sha1(F.concat(F.lit("public|"), F.sha2("text", 256))).alias("manual_id"),
        F.lit("public").alias("tenant_id"),
        F.sha2("text", 256).alias("checksum"),
    ).distinct().withColumn("created_at", F.lit(0))
    products = docs.select(
        F.sha1(F.concat_ws("|", F.lit("public"), "source", "lang")).alias("product_id"),
        F.lit("public").alias("tenant_id"),
        F.col("source").alias("brand"),
        F.col("lang").alias("model"),
    ).distinct()
    links = docs.select(
        F.sha1(F.concat(F.lit("public|"), F.sha2("text", 256))).alias("manual_id"),
        F.sha1(F.concat_ws("|", F.lit("public"), "source", "lang")).alias("product_id"),
    ).distinct()
    return manuals, products, links


STORED = """
stored AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
known_file AS (SELECT DISTINCT sha256(text) AS checksum FROM stored),
known_name AS (SELECT DISTINCT source, lang FROM stored),
known_link AS (SELECT DISTINCT sha256(text) AS checksum, source, lang FROM stored)"""


def registered(spark, folder):
    return catalog.register_uploads(uploads_of(spark, folder), *stored_state(spark, folder))


@check(
    "upload_manuals",
    f"""WITH {STORED}, first AS (
  SELECT sha256(text) AS checksum, min(doc_id) AS doc_id FROM documents
  WHERE sha256(text) NOT IN (SELECT checksum FROM known_file) GROUP BY 1)
SELECT sha1('public|' || f.checksum) AS manual_id, f.checksum, d.source || '/' || d.doc_id AS storage_key,
  CASE WHEN d.doc_id % 3 = 0 THEN upper(source) ELSE source END || ' ' ||
  CASE WHEN d.doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS title
FROM first f JOIN documents d ON d.doc_id = f.doc_id""",
)
def upload_manuals(spark, folder):
    return registered(spark, folder)["manuals"].select(
        "manual_id", "checksum", "storage_key", "title"
    )


@check(
    "upload_products",
    f"""WITH {STORED}, first AS (SELECT source, lang, min(doc_id) AS doc_id FROM documents
  WHERE (source, lang) NOT IN (SELECT (source, lang) FROM known_name) GROUP BY 1, 2)
SELECT sha1('public|' || source || '|' || lang) AS product_id,
  CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS brand,
  CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS model FROM first""",
)
def upload_products(spark, folder):
    return registered(spark, folder)["products"].select("product_id", "brand", "model")


@check(
    "upload_links",
    f"""WITH {STORED}
SELECT sha1('public|' || checksum) AS manual_id, sha1('public|' || source || '|' || lang) AS product_id
FROM (SELECT DISTINCT sha256(text) AS checksum, source, lang FROM documents
      EXCEPT SELECT checksum, source, lang FROM known_link)""",
)
def upload_links(spark, folder):
    return registered(spark, folder)["links"]


@check(
    "insert_absent",
    """SELECT doc_id, 'kept' AS origin FROM labels
UNION ALL SELECT doc_id, 'added' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def insert_absent(spark, folder):
    held = table(spark, folder, "labels").select("doc_id", F.lit("kept").alias("origin"))
    rows = table(spark, folder, "documents").select("doc_id", F.lit("added").alias("origin"))
    return catalog.insert_absent(held, rows, ["doc_id"])


def claim_state(spark, folder):
    """Documents as manuals in every state; events as requests to ingest."""
    manuals = manuals_of(spark, folder)
    started = F.when(
        (F.col("status") == "processing") & (F.col("manual_id") % 8 == 2),
        F.lit(NOW).cast("timestamp") - F.make_dt_interval(mins=F.lit(44) + (F.col("manual_id") % 3).cast("int")),
    )
    manuals = manuals.withColumn("processing_started_at", started).withColumn(
        "error", F.when(F.col("status") == "failed", "broken")
    )
    events = table(spark, folder, "events")
    requests = events.select(
        F.col("event_id").alias("request_id"),
        F.floor(F.col("value") * 10).cast("long").alias("manual_id"),
        F.col("ts").cast("timestamp").alias("arrival"),
        (F.col("event_type") == "purchase").alias("force"),
    )
    return manuals, requests, F.lit(NOW).cast("timestamp")


CLAIMS = f"""{MANUALS},
state AS (SELECT *, CASE WHEN status = 'processing' AND manual_id % 8 = 2
    THEN TIMESTAMP '{NOW}' - to_minutes(44 + manual_id % 3) END AS started FROM manual),
request AS (SELECT event_id AS request_id, CAST(floor(value * 10) AS BIGINT) AS manual_id, ts AS arrival,
    event_type = 'purchase' AS force FROM events),
asked AS (
  SELECT r.*, s.status, s.manual_id IS NOT NULL AS known,
    coalesce(status IN ('pending', 'failed') OR (force AND status = 'ready')
      OR (status = 'processing' AND (started IS NULL OR started < TIMESTAMP '{NOW}' - to_seconds(2700))), false) AS may
  FROM request r LEFT JOIN state s USING (manual_id)
),
winner AS (SELECT manual_id, arg_min(request_id, (arrival, request_id)) AS winner, min((arrival, request_id)) AS since
  FROM asked WHERE may GROUP BY 1)"""


@check(
    "claim",
    f"""WITH {CLAIMS}
SELECT request_id, manual_id, coalesce(winner = request_id, false) AS won,
  CASE WHEN (arrival, request_id) >= since THEN 'processing' ELSE status END AS status_after,
  CASE WHEN coalesce(winner = request_id, false) THEN NULL WHEN NOT known THEN 'Manual not found.'
    WHEN (arrival, request_id) >= since OR status = 'processing'
      THEN 'This manual is being processed right now. Wait for it to finish.'
    WHEN status = 'ready' THEN 'This manual has already been processed and indexed successfully (ready).' END AS reason
FROM asked LEFT JOIN winner USING (manual_id)""",
)
def claim(spark, folder):
    return catalog.claim(*claim_state(spark, folder))


@check(
    "claimed_manuals",
    f"""WITH {CLAIMS}
SELECT manual_id, CASE WHEN winner IS NOT NULL THEN 'processing' ELSE status END AS status,
  strftime(CASE WHEN winner IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE started END, '%Y-%m-%d %H:%M:%S') AS started,
  CASE WHEN winner IS NULL AND status = 'failed' THEN 'broken' END AS error
FROM state LEFT JOIN winner USING (manual_id)""",
)
def claimed_manuals(spark, folder):
    manuals, requests, now = claim_state(spark, folder)
    after = catalog.apply_claims(manuals, catalog.claim(manuals, requests, now), now)
    return after.select(
        "manual_id", "status",
        F.date_format("processing_started_at", "yyyy-MM-dd HH:mm:ss").alias("started"), "error",
    )


LINKS = """
link AS (SELECT DISTINCT e.label AS product_id, d.doc_id AS manual_id
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"""


def manual_links(spark, folder):
    labels = table(spark, folder, "embeddings")
    return labels.select(
        F.col("vec_id").alias("manual_id"), F.col("label").cast("long").alias("product_id")
    )


def in_order(listed):
    """A page as it is ordered, each row with its place."""
    page = listed.agg(F.collect_list(F.struct(*listed.columns)).alias("rows"))
    return page.select(F.posexplode("rows").alias("at", "row")).select(
        (F.col("at") + 1).cast("long").alias("place"), "row.*"
    )


@check(
    "list_manuals",
    f"""WITH {MANUALS}, {LINKS}
SELECT row_number() OVER (ORDER BY created_at DESC, manual_id) AS place, manual_id, title, status
FROM manual WHERE tenant_id = 'en' AND manual_id IN (SELECT manual_id FROM link WHERE product_id = 3)
QUALIFY place <= 20""",
)
def list_manuals(spark, folder):
    listed = catalog.list_manuals(
        manuals_of(spark, folder), "en", manual_links(spark, folder), 3, limit=20
    )
    return in_order(listed).select("place", "manual_id", "title", "status")


@check(
    "catalogue_products",
    f"""WITH {MANUALS}, {LINKS}, {PRODUCTS}
SELECT row_number() OVER (ORDER BY brand, model, product_id) AS place, product_id, brand, model
FROM product WHERE product_id IN (
  SELECT product_id FROM link JOIN manual USING (manual_id) WHERE status = 'ready')
QUALIFY place <= 7""",
)
def catalogue_products(spark, folder):
    listed = catalog.list_products(
        products_of(spark, folder), manual_links(spark, folder), manuals_of(spark, folder), "en", 7
    )
    return in_order(listed).select("place", "product_id", "brand", "model")


@check(
    "match_products",
    f"""WITH {PRODUCTS} SELECT product_id, brand, model FROM product
WHERE brand ILIKE 'HAIER' AND model ILIKE 'm_'""",
)
def match_products(spark, folder):
    found = catalog.match_products(products_of(spark, folder), "HAIER", "m_")
    return found.select("product_id", "brand", "model")


@check(
    "chunk_counts",
    """WITH manual AS (SELECT DISTINCT source || '-' || lang AS manual_id FROM documents
  UNION SELECT 'none-' || label FROM embeddings)
SELECT manual_id, manual_id AS title, 'ready' AS status, count(doc_id) AS chunks
FROM manual LEFT JOIN documents ON source || '-' || lang = manual_id GROUP BY 1""",
)
def chunk_counts(spark, folder):
    chunks = document_chunks(spark, folder)
    empty = table(spark, folder, "embeddings").select(
        F.concat(F.lit("none-"), F.col("label")).alias("manual_id")
    )
    manuals = chunks.select("manual_id").union(empty).distinct()
    manuals = manuals.select("manual_id", F.col("manual_id").alias("title"), F.lit("ready").alias("status"))
    return catalog.chunk_counts(manuals, chunks)


@check(
    "replace_chunks",
    """WITH done AS (SELECT DISTINCT source || '-' || lang AS manual_id FROM documents WHERE lang = 'fr')
SELECT doc_id AS chunk_id, source || '-' || lang AS manual_id, 'old' AS version FROM documents
WHERE source || '-' || lang NOT IN (SELECT manual_id FROM done)
UNION ALL SELECT doc_id, source || '-' || lang, 'new' FROM documents
WHERE source || '-' || lang IN (SELECT manual_id FROM done) AND n_chars >= 500""",
)
def replace_chunks(spark, folder):
    chunks = document_chunks(spark, folder)
    old = chunks.select("chunk_id", "manual_id", F.lit("old").alias("version"))
    french = chunks.where("language = 'fr'")
    new = french.where(F.length("content") >= 500).select(
        "chunk_id", "manual_id", F.lit("new").alias("version")
    )
    return catalog.replace_chunks(old, new, french.select("manual_id"))


def deletion(spark, folder):
    manuals = manuals_of(spark, folder)
    wanted = table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("manual_id"))
    children = {"links": manual_links(spark, folder)}
    return manuals, catalog.delete_manuals(manuals, children, wanted)


@check(
    "delete_manuals",
    f"""WITH {MANUALS}, {LINKS}, gone AS (SELECT manual_id FROM manual WHERE status <> 'processing'
  AND manual_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT 'manual' AS what, manual_id FROM manual WHERE manual_id NOT IN (SELECT manual_id FROM gone)
UNION ALL SELECT 'link', manual_id FROM link WHERE manual_id NOT IN (SELECT manual_id FROM gone)
UNION ALL SELECT 'refused', manual_id FROM manual WHERE status = 'processing'
  AND manual_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def delete_manuals(spark, folder):
    manuals, after = deletion(spark, folder)
    # Links of vectors beyond the documents never had a manual.
    links = after["links"].join(manuals.select("manual_id"), "manual_id", "left_semi")
    rows = [("manual", after["manuals"]), ("link", links), ("refused", after["refused"])]
    parts = [df.select(F.lit(name).alias("what"), "manual_id") for name, df in rows]
    return parts[0].union(parts[1]).union(parts[2])


@check(
    "set_null",
    """SELECT doc_id, CASE WHEN source IN (SELECT source FROM documents WHERE lang = 'de' GROUP BY source
  HAVING count(*) > 5) THEN NULL ELSE source END AS source FROM documents""",
)
def set_null(spark, folder):
    docs = table(spark, folder, "documents")
    gone = docs.where("lang = 'de'").groupBy("source").count().where("count > 5").select("source")
    return catalog.set_null(docs.select("doc_id", "source"), "source", gone)


@check(
    "orphans",
    f"""WITH {MANUALS}
SELECT DISTINCT storage_key FROM manual WHERE storage_key NOT IN
  (SELECT storage_key FROM manual WHERE status IN ('ready', 'processing'))""",
)
def orphans(spark, folder):
    manuals = manuals_of(spark, folder)
    return catalog.orphans(manuals, manuals.where(F.col("status").isin("ready", "processing")))


@check(
    "sweep_summary",
    f"""WITH {MANUALS}, used AS (SELECT DISTINCT storage_key FROM manual WHERE status IN ('ready', 'processing')),
stored AS (SELECT DISTINCT storage_key FROM manual)
SELECT (SELECT count(*) FROM stored) AS checked, (SELECT count(*) FROM used) AS referenced,
  (SELECT count(*) FROM stored WHERE storage_key NOT IN (SELECT storage_key FROM used)) AS orphaned,
  0 AS deleted, true AS dry_run""",
)
def sweep_summary(spark, folder):
    manuals = manuals_of(spark, folder)
    return catalog.sweep_summary(manuals, manuals.where(F.col("status").isin("ready", "processing")))


@check(
    "duplicate_keys",
    "SELECT source, sha256(text) AS checksum, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(spark, folder):
    docs = table(spark, folder, "documents").select("source", F.sha2("text", 256).alias("checksum"))
    return catalog.duplicate_keys(docs, ["source", "checksum"])


@check(
    "missing_parents",
    "SELECT vec_id AS manual_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
)
def missing_parents(spark, folder):
    child = table(spark, folder, "embeddings").select(F.col("vec_id").alias("manual_id"), "label")
    return catalog.missing_parents(child, "manual_id", table(spark, folder, "labels"), "doc_id")


def step_events(spark, folder):
    """Events as steps of an ingestion: the user is the manual."""
    events = table(spark, folder, "events")
    step = F.get(
        F.array(*[F.lit(s) for s in ("read", "extract", "clean", "chunk", "embed", "index", "other")]),
        F.pmod(F.col("event_id"), F.lit(7)).cast("int"),
    )
    step = F.when(F.col("event_id") % 11 == 0, catalog.RESTART).otherwise(step)
    failed, done = F.col("event_type") == "error", F.col("event_type") == "purchase"
    return events.select(
        F.col("user_id").alias("manual_id"),
        F.col("event_id").alias("seq"),
        step.alias("step"),
        F.when(failed, "failed").when(done, "done").otherwise("running").alias("status"),
        F.when(failed | done, F.floor("value").cast("long")).alias("duration_ms"),
        F.when(done, F.col("props")).alias("detail"),
        F.when(failed, F.concat(F.lit("ValueError: "), F.col("props"))).alias("error"),
    )


STEP_SQL = """
step_event AS (
  SELECT user_id AS manual_id, event_id AS seq,
    CASE WHEN event_id % 11 = 0 THEN 'start'
      ELSE ['read', 'extract', 'clean', 'chunk', 'embed', 'index', 'other'][event_id % 7 + 1] END AS step,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'running' END AS status,
    CASE WHEN event_type IN ('error', 'purchase') THEN CAST(floor(value) AS BIGINT) END AS duration_ms,
    CASE WHEN event_type = 'purchase' THEN props END AS detail,
    CASE WHEN event_type = 'error' THEN 'ValueError: ' || props END AS error
  FROM events
),
plan(place, step) AS (VALUES (0, 'read'), (1, 'extract'), (2, 'clean'), (3, 'chunk'), (4, 'embed'), (5, 'index')),
folded AS (
  SELECT manual_id, step, arg_max(status, seq) AS status,
    arg_max(duration_ms, seq) FILTER (duration_ms IS NOT NULL) AS duration_ms,
    arg_max(detail, seq) FILTER (detail IS NOT NULL) AS detail,
    arg_max(error, seq) FILTER (error IS NOT NULL) AS error
  FROM step_event e
  WHERE seq > coalesce((SELECT max(seq) FROM step_event s WHERE s.manual_id = e.manual_id AND s.step = 'start'), -1)
  GROUP BY 1, 2
),
progress AS (
  SELECT m.manual_id, p.place, p.step, coalesce(f.status, 'pending') AS status, f.duration_ms, f.detail, f.error
  FROM (SELECT DISTINCT manual_id FROM step_event) m CROSS JOIN plan p
  LEFT JOIN folded f ON f.manual_id = m.manual_id AND f.step = p.step
)"""


@check("progress_fold", f"WITH {STEP_SQL} SELECT * FROM progress")
def progress_fold(spark, folder):
    folded = catalog.fold_progress(step_events(spark, folder))
    return folded.select("manual_id", F.posexplode("progress").alias("place", "p")).select(
        "manual_id", "place", "p.step", "p.status", "p.duration_ms", "p.detail", "p.error"
    )


@check(
    "progress_totals",
    f"""WITH {STEP_SQL}
SELECT manual_id, count(*) FILTER (status = 'done') AS done, coalesce(sum(duration_ms), 0) AS total_ms
FROM progress GROUP BY manual_id""",
)
def progress_totals(spark, folder):
    folded = catalog.fold_progress(step_events(spark, folder))
    totals = catalog.progress_totals(F.col("progress"))
    return folded.select("manual_id", totals.alias("t")).select("manual_id", "t.*")


@check(
    "find_manuals",
    f"""WITH {MANUALS}
SELECT v.vec_id AS manual_id, title, status, m.manual_id IS NULL AS is_missing
FROM (SELECT vec_id FROM embeddings UNION ALL SELECT -1 - event_id FROM events) v
LEFT JOIN manual m ON m.manual_id = v.vec_id""",
)
def find_manuals(spark, folder):
    wanted = table(spark, folder, "embeddings").select(F.col("vec_id").alias("manual_id")).union(
        table(spark, folder, "events").select(-1 - F.col("event_id"))
    )
    manuals = manuals_of(spark, folder).select("manual_id", "title", "status")
    return catalog.find(manuals, wanted, "manual_id")
