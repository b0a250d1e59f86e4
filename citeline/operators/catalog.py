"""Catalogue state: admission, dedupe, links, claims, listings, cascades.

State goes in as DataFrames and comes out as the DataFrames after the change;
which rows win is decided by aggregates that combine before the shuffle, so a
key that a third of the rows share costs one row per task.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.config import DEFAULTS
from citeline.functions.guard import lookup
from citeline.session import settle

# States and the replies to a claim that was not granted.
REQUEUEABLE = ("pending", "failed")
CONFLICT_REASON = {
    "ready": "This manual has already been processed and indexed successfully (ready).",
    "processing": "This manual is being processed right now. Wait for it to finish.",
}
NOT_FOUND = "Manual not found."
PDF = "application/pdf"


# --- admission and identity -------------------------------------------------


def reject_reason(content_type: Column, declared: Column, actual: Column, s=DEFAULTS) -> Column:
    """Why an upload is refused, or NULL. The declared size may lie, so the
    bytes received count as well."""
    limit = s.max_upload_bytes
    return F.when(
        content_type.isNull() | (content_type != PDF),
        "Only PDF files are accepted. Convert the manual and try again.",
    ).when(
        (F.coalesce(declared, F.lit(0)) > limit) | (actual > limit),
        f"The PDF exceeds the {limit // (1024 * 1024)} MB limit.",
    )


def checksum(content: Column) -> Column:
    """SHA-256 of the stored bytes, in hex."""
    return F.sha2(content, 256)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: an aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*")


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` added where their key is not in the table yet; repeats within
    ``rows`` count once."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new)


def get_or_create_products(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Products the requests name that do not exist yet, one row each.

    requests: request_id, tenant_id, brand, model, type. Brand and model match
    regardless of case; the spelling of the first request is kept.
    """
    named = requests.select(
        "tenant_id",
        F.lower(F.trim("brand")).alias("brand_key"),
        F.lower(F.trim("model")).alias("model_key"),
        "request_id",
        F.trim("brand").alias("brand"),
        F.trim("model").alias("model"),
        "type",
    )
    keys = ["tenant_id", "brand_key", "model_key"]
    known = products.select(
        "tenant_id", F.lower("brand").alias("brand_key"), F.lower("model").alias("model_key")
    )
    new = first_per_key(named, keys, ["request_id"]).join(known, keys, "left_anti")
    identity = F.concat_ws("|", F.col("tenant_id").cast("string"), "brand_key", "model_key")
    return new.select(
        F.sha1(identity).alias("product_id"),
        "tenant_id",
        "brand",
        "model",
        "type",
        F.left(F.sha2(F.concat(F.lit("token|"), identity), 256), F.lit(22)).alias("public_token"),
    )


def match_products(products: DataFrame, brand: str, model: str) -> DataFrame:
    """Products named by brand and model, as patterns without case."""
    return products.where(F.col("brand").ilike(brand) & F.col("model").ilike(model))


def register_uploads(
    uploads: DataFrame, manuals: DataFrame, products: DataFrame, links: DataFrame
) -> dict[str, DataFrame]:
    """Admit a batch of uploads: new products, manuals and links.

    uploads: upload_id, tenant_id, checksum, brand, model, type, title,
    storage_key. The same bytes twice in a tenant are one manual; every upload
    links its product to that manual all the same. Returns the new rows of
    ``products``, ``manuals`` and ``links``, and ``requests``: the manual each
    upload asks to ingest.
    """
    new_products = get_or_create_products(
        uploads.withColumnRenamed("upload_id", "request_id"), products
    )
    keys = ["tenant_id", "checksum"]
    known = first_per_key(
        manuals.select(*keys, "manual_id", "created_at"), keys, ["created_at", "manual_id"]
    ).select(*keys, "manual_id")
    title = F.coalesce(
        F.nullif(F.col("title"), F.lit("")), F.concat_ws(" ", F.trim("brand"), F.trim("model"))
    )
    first = first_per_key(
        uploads.select(*keys, "upload_id", title.alias("title"), "storage_key"),
        keys, ["upload_id"],
    )
    identity = F.concat_ws("|", F.col("tenant_id").cast("string"), "checksum")
    new_manuals = first.join(known, keys, "left_anti").select(
        F.sha1(identity).alias("manual_id"), *keys, "title", "storage_key",
        F.lit("pending").alias("status"),
    )
    of_file = settle(
        known.select(*keys, F.col("manual_id").cast("string").alias("manual_id")).unionByName(
            new_manuals.select(*keys, "manual_id")
        )
    )
    # Names may exist twice in different case: the largest id stands for them,
    # as it does for the cases of an evaluation.
    by_name = ["tenant_id", F.lower("brand").alias("brand_key"), F.lower("model").alias("model_key")]
    of_name = settle(
        products.groupBy(*by_name)
        .agg(F.max("product_id").cast("string").alias("product_id"))
        .unionByName(new_products.select(*by_name, "product_id"))
    )
    requests = (
        uploads.withColumn("brand_key", F.lower(F.trim("brand")))
        .withColumn("model_key", F.lower(F.trim("model")))
        .join(of_file, keys)
        .join(of_name, ["tenant_id", "brand_key", "model_key"])
        .select("upload_id", "manual_id", "product_id")
    )
    new_links = (
        requests.select("manual_id", "product_id")
        .distinct()
        .join(
            links.select(
                F.col("manual_id").cast("string").alias("manual_id"),
                F.col("product_id").cast("string").alias("product_id"),
            ),
            ["manual_id", "product_id"],
            "left_anti",
        )
    )
    return {
        "products": new_products,
        "manuals": new_manuals,
        "links": new_links,
        "requests": requests.select("upload_id", "manual_id"),
    }


# --- claims -----------------------------------------------------------------


def claimable(status: Column, started: Column, force: Column, now: Column, s=DEFAULTS) -> Column:
    """May an ingestion start from here? A claim older than the stale limit, or
    one without a start time, counts as abandoned."""
    stale = started.isNull() | (
        started < now - F.make_dt_interval(secs=F.lit(s.stale_after_seconds))
    )
    return (
        status.isin(*REQUEUEABLE)
        | (F.coalesce(force, F.lit(False)) & (status == "ready"))
        | ((status == "processing") & stale)
    )


def claim(manuals: DataFrame, requests: DataFrame, now: Column, s=DEFAULTS) -> DataFrame:
    """Outcome of each request: won, status afterwards, reason when refused.

    requests: request_id, manual_id, arrival, force. Of the requests that may
    claim a manual, the first to arrive wins. Those after it see it taken, those
    before it the state that was stored. The winner follows from one row per
    manual: its state, and its first request with and without force. Only the
    verdict is joined to the requests.
    """
    order = F.struct("arrival", "request_id")
    firsts = requests.groupBy("manual_id").agg(
        F.min(order).alias("__first"),
        F.min(F.when(F.coalesce("force", F.lit(False)), order)).alias("__forced"),
    )
    status, started = F.col("status"), F.col("processing_started_at")
    winner = F.when(
        claimable(status, started, F.lit(False), now, s), F.col("__first")
    ).when(claimable(status, started, F.lit(True), now, s), F.col("__forced"))
    verdicts = settle(
        firsts.join(manuals, "manual_id").select("manual_id", "status", winner.alias("winner"))
    )
    after = requests.join(verdicts, "manual_id", "left")
    won = F.coalesce(F.col("winner.request_id") == F.col("request_id"), F.lit(False))
    taken = F.coalesce(order >= F.col("winner"), F.lit(False))
    status = F.when(taken, "processing").otherwise(F.col("status"))
    reason = F.when(F.col("status").isNull(), NOT_FOUND).otherwise(lookup(CONFLICT_REASON, status))
    return after.select(
        "request_id", "manual_id", won.alias("won"), status.alias("status_after"),
        F.when(~won, reason).alias("reason"),
    )


def apply_claims(manuals: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Manuals after the claims: winners are processing, without an error."""
    won = outcomes.where("won").select("manual_id", F.lit(True).alias("__won"))
    taken = F.col("__won").isNotNull()
    return manuals.join(won, "manual_id", "left").select(
        *[
            {
                "status": F.when(taken, "processing").otherwise(F.col("status")),
                "processing_started_at": F.when(taken, now).otherwise(
                    F.col("processing_started_at")
                ),
                "error": F.when(~taken, F.col("error")),
            }.get(c, F.col(c)).alias(c)
            for c in manuals.columns
        ]
    )


# --- ingestion progress -----------------------------------------------------

# The steps of an ingestion, in order.
STEPS = {
    "read": "Reading the file from storage",
    "extract": "Extracting text from the PDF",
    "clean": "Cleaning text and detecting languages",
    "chunk": "Splitting into chunks",
    "embed": "Generating embeddings",
    "index": "Writing chunks and indexes",
}


#: Step name of the event with which an ingestion starts again.
RESTART = "start"


def progress_plan() -> Column:
    """Every step, pending, before any work starts."""
    return F.array(
        *[
            F.struct(
                F.lit(step).alias("step"),
                F.lit(label).alias("label"),
                F.lit("pending").alias("status"),
                F.lit(None).cast("long").alias("duration_ms"),
                F.lit(None).cast("string").alias("detail"),
                F.lit(None).cast("string").alias("error"),
            )
            for step, label in STEPS.items()
        ]
    )


def update_step(steps: Column, name: Column, **changes: Column) -> Column:
    """Merge changes into one step; others, and unknown names, stay as is."""

    def merged(step):
        out = step
        for field, value in changes.items():
            out = out.withField(field, value)
        return F.when(step["step"] == name, out).otherwise(step)

    return F.transform(steps, merged)


def since_restart(events: DataFrame, key: str) -> DataFrame:
    """Events with ``__begun``, the number of the last restart of their key."""
    begun = events.where(F.col("step") == RESTART).groupBy(key).agg(F.max("seq").alias("__begun"))
    begun = settle(begun.withColumnRenamed(key, "__key"))
    return events.join(begun, F.col(key) == F.col("__key"), "left").drop("__key")


def fold_progress(events: DataFrame, key: str = "manual_id") -> DataFrame:
    """Current progress from step events (key, seq, step, status, duration_ms,
    detail, error): what each event names is merged over what came before. An
    event of the step ``RESTART`` begins a fresh plan: what came before it no
    longer counts."""
    events = since_restart(events, key).where(
        F.col("__begun").isNull() | (F.col("seq") >= F.col("__begun"))
    )
    latest = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
        for c in ("status", "duration_ms", "detail", "error")
    ]
    state = events.where(F.col("step").isin(*STEPS, RESTART)).groupBy(key, "step").agg(*latest)
    # At most one entry per known step.
    found = state.groupBy(key).agg(
        F.map_from_entries(
            F.collect_list(F.struct("step", F.struct("status", "duration_ms", "detail", "error")))
        ).alias("__states")
    )

    def current(step):
        now = F.col("__states")[step["step"]]
        return F.struct(
            step["step"].alias("step"),
            step["label"].alias("label"),
            F.coalesce(now["status"], step["status"]).alias("status"),
            now["duration_ms"].cast("long").alias("duration_ms"),
            now["detail"].alias("detail"),
            now["error"].alias("error"),
        )

    return found.select(key, F.transform(progress_plan(), current).alias("progress"))


def progress_totals(progress: Column) -> Column:
    """Steps done and milliseconds spent so far."""
    return F.struct(
        F.size(F.filter(progress, lambda p: p["status"] == "done")).alias("done"),
        F.aggregate(
            progress, F.lit(0).cast("long"),
            lambda total, p: total + F.coalesce(p["duration_ms"], F.lit(0).cast("long")),
        ).alias("total_ms"),
    )


# --- listings ---------------------------------------------------------------

# The largest page of each listing.
MAX_MANUALS, MAX_PRODUCTS = 200, 500


def bounded(limit: int, most: int) -> int:
    """A page size as asked for, which must lie between 1 and ``most``."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


def list_manuals(
    manuals: DataFrame, tenant=None, links: DataFrame | None = None, product=None, limit: int = 50
) -> DataFrame:
    """Newest manuals of a tenant, of one product when named: a page of at most
    ``MAX_MANUALS``."""
    limit = bounded(limit, MAX_MANUALS)
    if tenant is not None:
        manuals = manuals.where(F.col("tenant_id") == tenant)
    if product is not None:
        of_product = links.where(F.col("product_id") == product).select("manual_id")
        manuals = manuals.join(of_product, "manual_id", "left_semi")
    return manuals.orderBy(F.col("created_at").desc(), "manual_id").limit(limit)


def list_products(
    products: DataFrame, links: DataFrame, manuals: DataFrame, tenant=None, limit: int | None = None
) -> DataFrame:
    """Products with at least one ready manual, by brand and model: all, or a
    page of at most ``MAX_PRODUCTS``."""
    ready = (
        links.join(
            manuals.where(F.col("status") == "ready").select("manual_id"), "manual_id", "left_semi"
        )
        .select("product_id")
        .distinct()
    )
    if tenant is not None:
        products = products.where(F.col("tenant_id") == tenant)
    listed = products.join(ready, "product_id", "left_semi").orderBy("brand", "model", "product_id")
    return listed if limit is None else listed.limit(bounded(limit, MAX_PRODUCTS))


def chunk_counts(manuals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every manual with its number of chunks, by title."""
    n = chunks.groupBy("manual_id").agg(F.count("*").alias("chunks"))
    return (
        manuals.join(n, "manual_id", "left")
        .select("manual_id", "title", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))
        .orderBy("title", "manual_id")
    )


def manual_stats(manuals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per manual: mean chunk length, cut to a whole number (NULL without
    chunks), and chunks per language."""
    by_language = chunks.groupBy("manual_id", "language").agg(
        F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")
    )
    totals = by_language.groupBy("manual_id").agg(
        F.sum("n").alias("chunks"),
        F.floor(F.sum("chars") / F.sum("n")).cast("int").alias("avg_chunk_chars"),
        F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("languages"),
    )
    return manuals.join(totals, "manual_id", "left")


def page_languages(pages: DataFrame, key: str = "manual_id") -> DataFrame:
    """Languages of a document by number of pages, most first; equals keep the
    order in which they appear. Also its characters."""
    counted = pages.groupBy(key, "language").agg(
        F.count("*").alias("n"), F.min("page").alias("first"), F.sum("chars").alias("chars")
    )
    order = F.sort_array(F.collect_list(F.struct(-F.col("n"), "first", "language", "n")))
    return counted.groupBy(key).agg(
        F.transform(
            order, lambda x: F.struct(x["language"].alias("language"), x["n"].alias("n"))
        ).alias("languages"),
        F.sum("chars").alias("characters"),
    )


# --- replacement, deletion, integrity ---------------------------------------


def replace_chunks(chunks: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """All chunks of the documents in ``done`` replaced by those in ``new``."""
    kept = chunks.join(settle(done.select("manual_id").distinct()), "manual_id", "left_anti")
    return kept.unionByName(new)


def delete_manuals(
    manuals: DataFrame, children: dict[str, DataFrame], wanted: DataFrame
) -> dict[str, DataFrame]:
    """Delete manuals that are not being processed, with all their child rows.

    ``children`` maps names to tables with a manual_id. Returns the tables
    after the change, ``refused`` and the ``storage_keys`` to unlink.
    """
    named = manuals.join(wanted.select("manual_id").distinct(), "manual_id", "left_semi")
    busy = F.col("status") == "processing"
    gone = named.where(~busy)
    ids = settle(gone.select("manual_id"))
    after = {
        name: df.join(ids, "manual_id", "left_anti")
        for name, df in {"manuals": manuals, **children}.items()
    }
    return after | {
        "refused": named.where(busy).select("manual_id"),
        "storage_keys": gone.select("storage_key"),
    }


def set_null(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Blank a reference to deleted rows, and keep the rows themselves."""
    keys = settle(gone.select(F.col(gone.columns[0]).alias(column)).distinct())
    joined = rows.join(keys.withColumn("__gone", F.lit(True)), column, "left")
    return joined.withColumn(
        column, F.when(F.col("__gone").isNull(), F.col(column))
    ).select(*rows.columns)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty when the constraint holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_parents(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference leads nowhere; NULL refers to nothing."""
    parents = parent.select(F.col(key).alias(column))
    return child.where(F.col(column).isNotNull()).join(parents, column, "left_anti")


def orphans(stored: DataFrame, manuals: DataFrame) -> DataFrame:
    """Stored keys no manual points at."""
    used = manuals.where("storage_key IS NOT NULL").select("storage_key")
    return stored.select("storage_key").distinct().join(used, "storage_key", "left_anti")


def sweep_summary(stored: DataFrame, manuals: DataFrame, dry_run: bool = True) -> DataFrame:
    """Counts of a sweep in one row. The keys themselves are ``orphans``. Nothing is
    deleted here: ``deleted`` is what a sweep would delete; ``sweep`` does it.

    Both sides meet in one aggregate by key, so each key is counted once and
    nothing has to be joined.
    """
    sides = stored.select("storage_key", F.lit(True).alias("disk")).unionByName(
        manuals.where("storage_key IS NOT NULL").select("storage_key", F.lit(False).alias("disk"))
    )
    keys = sides.groupBy("storage_key").agg(
        F.max("disk").alias("stored"), F.max(~F.col("disk")).alias("used")
    )
    orphaned = F.count_if(F.col("stored") & ~F.col("used"))
    return keys.agg(
        F.count_if(F.col("stored")).alias("checked"),
        F.count_if(F.col("used")).alias("referenced"),
        orphaned.alias("orphaned"),
        (F.lit(0).cast("long") if dry_run else orphaned).alias("deleted"),
        F.lit(dry_run).alias("dry_run"),
    )


def sweep(
    stored: DataFrame, manuals: DataFrame, unlink: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Delete what no manual points at: (keys in order, counts in one row).

    ``unlink(storage_key)`` deletes a file and says whether it is gone; without it the
    sweep is a dry run. Its answers are a table before they are counted, so it is asked
    once for each key; a task that runs again asks again, so a file that is gone
    already must count as deleted. keys: storage_key, deleted. ``orphaned`` counts
    them all, ``deleted`` those that are gone; a null answer is none.
    """
    gone = F.lit(False) if unlink is None else F.coalesce(unlink(F.col("storage_key")), F.lit(False))
    stored = settle(stored.select("storage_key").distinct())  # as listed before the first deletion
    keys = settle(orphans(stored, manuals).withColumn("deleted", gone))
    counts = sweep_summary(stored, manuals, dry_run=unlink is None)
    done = keys.agg(F.count_if("deleted").alias("deleted"))
    both = counts.drop("deleted").unionByName(done, allowMissingColumns=True)
    return keys.orderBy("storage_key"), both.agg(*[F.max(c).alias(c) for c in counts.columns])


def failure(error_type: Column, message: Column, s=DEFAULTS) -> Column:
    """Error text of a failed ingestion, cut to fit."""
    return F.left(F.concat_ws(": ", error_type, message), F.lit(s.max_error_chars))


def find(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows by id, one per id asked for; ``is_missing`` where there is none."""
    found = table.withColumn("__found", F.lit(True))
    return (
        wanted.select(key)
        .join(found, key, "left")
        .withColumn("is_missing", F.col("__found").isNull())
        .drop("__found")
    )
