"""Reads over the store's tables, each a plan of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import latest, relational
from ..store import Store


def outcomes(store: Store, document_id: str) -> DataFrame:
    """The last answer of every crop in every run: backend, variant, context, tag, model_version, page, band_index, entry, crop_id, text, error."""
    places = store.read("source_regions").where((F.col("document_id") == document_id) & (F.col("role") == "entry"))
    entries = store.read("physical_entries").select(F.col("id").alias("entry_id"), F.col("band_id"), F.col("entry_index").alias("entry"))
    bands = store.read("bands").select(F.col("id").alias("band_id"), "band_index")
    runs = store.read("ocr_runs").select(F.col("id").alias("ocr_run_id"), "model_id", F.col("input_variant").alias("variant"), "tag")
    models = store.read("models").select(F.col("id").alias("model_id"), "backend", F.col("version").alias("model_version"))
    answers = store.read("ocr_candidates").select("id", "source_region_id", "ocr_run_id", F.col("transcription").alias("text"), "raw")
    rows = answers.join(runs, "ocr_run_id").join(models, "model_id").join(places.withColumnRenamed("id", "source_region_id"), "source_region_id").join(entries, "entry_id").join(bands, "band_id")
    rows = rows.select("id", "backend", "variant", "context", "tag", "model_version", F.col("page_index").alias("page"), "band_index", "entry", "crop_id", "text", F.get_json_object("raw", "$.error").alias("error"))
    return latest.last_run_per_crop(rows, ["backend", "variant", "context", "tag"], "crop_id", "id", "model_version").drop("id")


def superseded_runs(store: Store) -> DataFrame:
    """Runs that a later one of the same tag, variant and backend replaces."""
    runs = store.read("ocr_runs").join(store.read("models").select(F.col("id").alias("model_id"), "backend"), "model_id").withColumn("tag", F.coalesce("tag", F.lit("")))
    return runs.join(relational.supersede(runs, ["tag", "input_variant", "backend"], "id").select("id"), "id", "left_anti")


def latest_layout(store: Store, document_id: str, stage: str = "layout") -> DataFrame:
    """Layouts of the last completed run of a stage."""
    runs = store.read("processing_runs").where((F.col("document_id") == document_id) & (F.col("stage") == stage) & (F.col("status") == "completed"))
    last = runs.agg(F.max("id").alias("run_id"))
    return store.read("page_layouts").join(last, "run_id", "left_semi")


def latest_per_page(store: Store, table: str, document_id: str, order: str) -> DataFrame:
    """Each page's last layout or transform."""
    return latest.last_per_key(store.read(table).where(F.col("document_id") == document_id), ["document_id", "page_index"], order)


def layout_scan(store: Store, document_id: str) -> DataFrame:
    """(page, band_index, entry, crop_path, text): tight crops with their readings; a crop read n times is n rows, as its counts are meant."""
    places = store.read("source_regions").where((F.col("document_id") == document_id) & (F.col("context") == "tight"))
    entries = store.read("physical_entries").select(F.col("id").alias("entry_id"), "band_id", F.col("entry_index").alias("entry"))
    bands = store.read("bands").select(F.col("id").alias("band_id"), "band_index")
    answers = store.read("ocr_candidates").select(F.col("source_region_id").alias("id"), F.col("transcription").alias("text"))
    return places.join(entries, "entry_id").join(bands, "band_id").join(answers, "id", "left").select(F.col("page_index").alias("page"), "band_index", "entry", "crop_path", "text")


def targets(store: Store, document_id: str) -> DataFrame:
    """Live regions on active pages, in reading order."""
    regions = store.read("regions").where((F.col("document_id") == document_id) & relational.live(F.col("deleted_at"), F.col("state")))
    rows = regions.join(store.read("pages").select("document_id", "page_index", "ignored"), ["document_id", "page_index"], "left")
    return rows.where(relational.not_ignored(F.col("ignored"))).drop("ignored").orderBy("page_index", "band_ordinal", "reading_order", "id")


def manifest(store: Store) -> DataFrame:
    """Every document with its pages, whether any can be reviewed, its progress and its latest tag."""
    regions, pages = store.read("regions"), store.read("pages")
    entries = regions.where((F.col("role") == "entry") & relational.live(F.col("deleted_at"), F.col("state"))).select("document_id", "page_index")
    said = store.read("human_corrections").where("role = 'entry'").select("document_id", "page_index")
    done = relational.progress(entries, said, pages, ["document_id", "page_index"])
    open_pages = relational.reviewable_pages(pages, regions).groupBy("document_id").agg(F.count("*").alias("reviewable"))
    answers = store.read("ocr_candidates").select(F.col("id").alias("candidate_id"), "region_id", "ocr_run_id")
    tagged = answers.join(store.read("ocr_runs").select(F.col("id").alias("ocr_run_id"), "tag"), "ocr_run_id").join(regions.select(F.col("id").alias("region_id"), "document_id"), "region_id")
    out = store.read("documents").select(F.col("id").alias("document_id"), "title", "page_count")
    for part in (open_pages, done, latest.latest_tag(tagged)):
        out = out.join(part, "document_id", "left")
    return out.select("document_id", "title", "page_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reviewable", "entries", "reviewed")], "tag")


def run_history(store: Store, n: int = 20) -> DataFrame:
    """The newest runs: a report of ``n`` rows."""
    return store.read("processing_runs").orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def decoded_assets(store: Store, document_id: str) -> DataFrame:
    """Decoded images of stored, active pages."""
    pages = store.read("pages").where((F.col("document_id") == document_id) & ~F.coalesce("ignored", F.lit(False)))
    return store.read("page_assets").where("role = 'decoded'").join(pages.select("document_id", "page_index"), ["document_id", "page_index"])


def stray_crops(store: Store) -> DataFrame:
    """Crops whose region has moved or gone: their pixels may serve another."""
    regions = store.read("regions").select(F.col("id").alias("region_id"), F.col("geometry_hash").alias("_hash"), "deleted_at", "state")
    rows = store.read("region_crops").join(regions, "region_id", "left")
    return rows.where(F.col("_hash").isNull() | (F.col("_hash") != F.col("geometry_hash")) | ~relational.live(F.col("deleted_at"), F.col("state"))).drop("_hash", "deleted_at", "state")


def adopt(crops: DataFrame, stray: DataFrame, regions: DataFrame) -> DataFrame:
    """Stray crops handed to the live region whose geometry they have."""
    live = regions.where(relational.live(F.col("deleted_at"), F.col("state"))).groupBy("geometry_hash").agg(F.min("id").alias("_new"))
    owned = stray.select("id", "geometry_hash").join(live, "geometry_hash").select("id", "_new")
    return crops.join(owned, "id", "left").withColumn("region_id", F.coalesce("_new", "region_id")).drop("_new")


def last_versions(store: Store) -> DataFrame:
    """The last seen model version of each backend, by candidate."""
    runs = store.read("ocr_runs").select(F.col("id").alias("ocr_run_id"), "model_id")
    models = store.read("models").select(F.col("id").alias("model_id"), "backend", "version")
    rows = store.read("ocr_candidates").select(F.col("id").alias("seq"), "ocr_run_id").join(runs, "ocr_run_id").join(models, "model_id")
    return rows.groupBy("backend").agg(F.max_by("version", "seq").alias("version"))


def set_ignored(pages: DataFrame, document_id: str, page: int, ignored: bool) -> DataFrame:
    """Pages with one ignored or restored; a page that isn't stored is an error."""
    here = (F.col("document_id") == document_id) & (F.col("page_index") == page)
    if pages.where(here).isEmpty():
        raise KeyError(f"{document_id} has no page {page}")
    return pages.withColumn("ignored", F.when(here, F.lit(ignored)).otherwise(F.col("ignored")))


def move_region(old: DataFrame, new: DataFrame) -> DataFrame:
    """Regions with new places: a locked order stays, null keeps what was. ``new``: region_uid, reading_order, band_label."""
    rows = old.join(new.select("region_uid", F.col("reading_order").alias("_order"), F.col("band_label").alias("_label")), "region_uid", "left")
    order = F.when(F.col("reading_order_locked"), F.col("reading_order")).otherwise(F.coalesce("_order", "reading_order"))
    return rows.withColumn("reading_order", order).withColumn("band_label", F.coalesce("_label", "band_label")).drop("_order", "_label")


def start_run(store: Store, run: dict) -> None:
    """A run's row, running until it is finished; ``finish_run`` names how."""
    runs = store.read("processing_runs")
    row = store.spark.createDataFrame([tuple((run | {"status": "running"}).get(c) for c in runs.columns)], runs.schema)
    store.replace("processing_runs", runs.unionByName(row))


def finish_run(store: Store, run_id: str, status: str = "completed") -> None:
    if status not in ("completed", "failed"):
        raise ValueError("a run ends completed or failed")
    here = F.col("id") == run_id
    runs = store.read("processing_runs")
    store.replace("processing_runs", runs.withColumn("status", F.when(here, status).otherwise(F.col("status"))).withColumn("finished_at", F.when(here, F.current_timestamp()).otherwise(F.col("finished_at"))))
