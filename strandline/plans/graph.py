"""From stored readings to people, links, findings and exports, for one document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import human_text, parent_label, snippet, source_of
from ..functions.watermarks import filter_watermark
from ..operators import graph, latest, relational, scoring, sequence
from ..profile import Profile
from ..sources import writers
from ..store import Store, written


def entry_texts(store: Store, profile: Profile, document_id: str, tag: str | None = None) -> DataFrame:
    """(document_id, region_uid, page, band, entry, geometric, order, ordinal, text, source) of live entries on active pages.

    A person's word wins by its presence; else the last machine reading that isn't the stamp alone.
    With a tag, entries that it never read are left out, as the left join's condition does.
    """
    regions = store.read("regions").where((F.col("document_id") == document_id) & (F.col("role") == "entry") & relational.live(F.col("deleted_at"), F.col("state")))
    pages = store.read("pages").select("document_id", "page_index", "ignored")
    active = regions.join(pages, ["document_id", "page_index"], "left").where(relational.not_ignored(F.col("ignored")))
    runs = store.read("ocr_runs").select(F.col("id").alias("ocr_run_id"), "tag")
    answers = store.read("ocr_candidates").select(F.col("region_id").alias("id"), "ocr_run_id", F.col("id").alias("candidate"), "transcription").join(runs, "ocr_run_id", "left")
    labels = F.array(*[F.lit(x) for x in profile.bands])
    label = F.coalesce("band_label", F.get(labels, F.col("band_ordinal")))
    rows = active.withColumn("geometric", label).join(answers, "id", "left")
    rows = rows if tag is None else rows.where(F.col("tag") == tag)
    said = store.read("human_corrections").where((F.col("role") == "entry") & ~F.coalesce("unreadable", F.lit(False))).select("document_id", "page_index", F.col("band_label").alias("geometric"), "entry_index", F.lit(True).alias("corrected"), human_text(F.lit(True), F.col("unreadable"), F.col("transcription")).alias("human"))
    rows = rows.join(said, ["document_id", "page_index", "geometric", "entry_index"], "left").withColumn("machine", filter_watermark(F.col("transcription"))["text"])
    keys = ["document_id", "region_uid", "page_index", "band_ordinal", "entry_index", "geometric", "reading_order"]
    best = latest.best_text(rows, keys, F.col("machine"), F.coalesce("corrected", F.lit(False)), F.col("human"), "candidate")
    return best.withColumnsRenamed({"page_index": "page", "band_ordinal": "band", "entry_index": "entry"}).withColumn("ordinal", F.struct("page", "band", "reading_order", "region_uid"))


@dataclass
class Graph:
    entries: DataFrame
    linked: DataFrame
    findings: DataFrame


def build(entries: DataFrame, profile: Profile) -> Graph:
    """Entries parsed once and written; people, links and findings are views of that."""
    parsed = written(graph.parsed_entries(entries.where(F.col("text").isNotNull()), profile, profile.bands), "parsed")
    linked = graph.links(graph.people(parsed), parent_label(F.col("label"), profile), profile.bands)
    siblings = graph.sibling_findings(linked)
    return Graph(parsed, linked, graph.link_findings(parsed, linked).unionByName(siblings))


def persons(g: Graph) -> DataFrame:
    """Rows of the people export, numbered in entry order."""
    from ..operators.stats import numbered

    rows = numbered(g.linked, ["ordinal"], "id")
    return rows.select(
        "id", "document_id", "person_key", F.col("label").alias("generation"), "own_id", "own_value", "father_key", F.col("parent_name").alias("father_name"),
        F.col("order").alias("birth_order"), F.col("rank").alias("order_rank"), F.col("leftover").alias("additional_info"), "link_status", "page",
    )


def export(g: Graph, profile: Profile, folder: str, document_id: str) -> tuple[int, tuple[int, int]]:
    """People as TSV and as GEDCOM; (people, (individuals, families))."""
    rows = written(persons(g), "persons")
    people = writers.write_people(rows, profile.bands, document_id, f"{folder}/people")
    shown = rows.withColumnsRenamed({"generation": "label", "birth_order": "order", "additional_info": "extra"})
    return people, writers.write_gedcom(shown, profile.bands, f"{folder}/people.ged")


def validate(entries: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(report, findings) of the ids read, per band, the band trusted."""
    from ..functions.fields import parse_entry

    own = entries.withColumn("id", parse_entry(F.col("text"), F.col("geometric"), profile, True)["own_id"])
    seen = sequence.observations(own, F.col("geometric"), F.col("page"), F.col("entry"), F.coalesce("id", "text", F.lit("")), F.col("ordinal"))
    return sequence.report(seen, profile.labels), sequence.findings(seen, profile.labels)


def recovered(entries: DataFrame, profile: Profile) -> DataFrame:
    """(page, band, entry, observed_label, own_id): ids of ``validate`` whose label wasn't read but taken from the band."""
    from ..functions.fields import parse_entry

    own = entries.withColumn("id", parse_entry(F.col("text"), F.col("geometric"), profile, True)).where("id.label_from_geometry")
    return own.select("page", F.col("geometric").alias("band"), "entry", "id.observed_label", "id.own_id")


def learning(entries: DataFrame, profile: Profile, keys: list[str]) -> DataFrame:
    """The scorecard of reviewed entries: keys, page, geometric, entry, ordinal, machine and human, which is a readable correction."""
    from ..functions.fields import parse_entry

    rows = entries.where(F.col("human").isNotNull())
    for name in ("human", "machine"):
        rows = rows.withColumn(f"_{name}", parse_entry(F.col(name), F.col("geometric"), profile, True))
    core = lambda c: F.struct(F.col(c).alias("text"), F.col(f"_{c}.own_id").alias("own_id"), F.coalesce(f"_{c}.parent_id", f"_{c}.parent_name").alias("parent"), F.col(f"_{c}.order").alias("order"))
    place = F.struct("ordinal", "page", F.col("geometric").alias("band"), "entry")
    flags = F.struct(*[f"_machine.{f}" for f in ("label_from_geometry", "parent_label_from_structure", "numeral_repairs")])
    return scoring.scorecard(rows.select(*keys, core("human").alias("human"), core("machine").alias("machine"), F.col("machine").isNotNull().alias("machine_read"), flags.alias("flags"), place.alias("place")), keys)


def review_entries(store: Store, document_id: str, page: int, profile: Profile, tag: str | None = None) -> DataFrame:
    """A page's entries as a reviewer sees them, headers first: readings, corrections, findings and fields.

    A tag names the run whose readings are shown; readings made on demand are shown beside any.
    """
    from ..functions.fields import parse_entry
    from ..functions.text import expected_id, header_kind, order_rank

    regions = store.read("regions").where((F.col("document_id") == document_id) & (F.col("page_index") == page) & relational.live(F.col("deleted_at"), F.col("state")))
    crops = store.read("region_crops").select(F.col("crop_key"), F.col("geometry_hash").alias("crop_hash"))
    answers = store.read("ocr_candidates").select(F.col("region_id").alias("id"), F.col("id").alias("candidate"), "ocr_run_id", filter_watermark(F.col("transcription"))["text"].alias("transcription"), "crop_key").join(crops, "crop_key", "left")
    runs = store.read("ocr_runs").select(F.col("id").alias("ocr_run_id"), "tag")
    answers = answers if tag is None else answers.join(runs.where(F.col("tag").isin(tag, "interactive")), "ocr_run_id", "left_semi")
    read = regions.select("id", "geometry_hash").join(answers, "id").select("id", "candidate", "transcription", (F.col("crop_hash") == F.col("geometry_hash")).alias("current"))
    best = latest.best_reading(read, ["id"], F.col("current"), "candidate").select("id", F.col("transcription").alias("machine"), F.coalesce("current", F.lit(False)).alias("current"))
    place = ["document_id", "page_index", "band_label", "entry_index"]
    said = store.read("human_corrections").select(*place, "role", F.lit(True).alias("corrected"), F.col("transcription").alias("human"), "unreadable")
    told = store.read("validation_findings").where("entry_index is not null").groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("id", "kind", "expected"))).alias("findings"))
    rows = regions.join(best, "id", "left").join(said, [*place, "role"], "left").join(told, place, "left")
    human = human_text(F.coalesce("corrected", F.lit(False)), F.col("unreadable"), F.col("human"))
    shown = F.coalesce(human, F.col("machine"))
    rows = rows.withColumn("text", shown).withColumn("fields", parse_entry(shown, F.col("band_label"), profile, True))
    return rows.select(
        "region_uid", "band_ordinal", "band_label", "entry_index", "role", "reading_order", "machine", human.alias("human"), "unreadable", (F.col("machine").isNotNull() & ~F.coalesce("current", F.lit(False))).alias("stale"),
        source_of(F.col("unreadable"), F.coalesce("corrected", F.lit(False)), human, F.col("machine")).alias("source"),
        "fields.own_id", F.coalesce("fields.parent_id", "fields.parent_name").alias("parent"), F.col("fields.order").alias("birth_order"), order_rank(F.col("fields.order")).alias("order_rank"),
        F.nullif("fields.leftover", F.lit("")).alias("additional_info"), expected_id(F.col("findings"), F.col("band_label")).alias("expected"),
        F.when(F.col("role") == "header", header_kind(shown)).alias("header_kind"),
    ).orderBy("band_ordinal", F.when(F.col("role") == "entry", 1).otherwise(0), "reading_order")


def score_runs(outcomes: DataFrame, gold: DataFrame, profile: Profile, bands: dict[int, str]) -> DataFrame:
    """Scores of each run against gold. ``outcomes``: backend, variant, context, tag, page, band_index, entry, text, error, latency_ms."""
    from ..functions.fields import parse_entry

    keys = ["backend", "variant", "context", "tag"]
    label = F.try_element_at(F.create_map(*[F.lit(x) for p in bands.items() for x in p]), F.col("band_index"))
    pairs = outcomes.withColumnRenamed("text", "raw").join(gold.withColumnRenamed("text", "reference"), ["page", "band_index", "entry"])
    pairs = pairs.withColumn("hypothesis", F.regexp_replace("raw", r"(?U)\s+", "")).withColumn("e", scoring.edits(F.col("reference"), F.col("hypothesis")))
    for name, column in (("gold", "reference"), ("read", "hypothesis")):
        p = parse_entry(F.col(column), label, profile)
        pairs = pairs.withColumn(f"_{name}", p)
        for f in scoring.FIELDS:
            pairs = pairs.withColumn(f"{name}_{f}", F.col(f"_{name}.{f}"))
    return scoring.scores(pairs, keys)


def quotes(findings: DataFrame) -> DataFrame:
    """Findings as lists show them: one line each, the text cut."""
    return findings.withColumn("observed", snippet(F.col("observed")))
