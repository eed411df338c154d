"""People out of entries, links to their fathers, and what in a family can't be right.

The chart has one hop from child to father and as many generations as the profile; a self-join on
the person's key is all the graph there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import named_key, person_key
from ..functions.text import snippet
from ..profile import Profile

KINDS = ("duplicate_id", "unresolved_father", "no_father_field", "order_conflict", "order_reversed")


def sort_rank(label: Column, labels: tuple[str, ...]) -> tuple[Column, Column]:
    """(rank, text): charted generations in their order, others after them by name."""
    known = tuple(dict.fromkeys(labels))
    text = F.coalesce(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""), F.lit(""))
    pairs = [F.lit(x) for i, name in enumerate(known) for x in (name, i)]
    rank = F.try_element_at(F.create_map(*pairs), text) if pairs else F.lit(None).cast("int")
    return F.coalesce(rank, F.lit(len(known))), F.when(rank.isNull(), text).otherwise("")


def people(entries: DataFrame) -> DataFrame:
    """The first entry of each (label, value), with its person_key. ``entries``: see ``links``."""
    keyed = entries.where(F.col("own_value").isNotNull()).withColumn("person_key", person_key(F.col("label"), F.col("own_value")))
    first = keyed.groupBy("person_key").agg(F.min_by(F.struct(*entries.columns), "ordinal").alias("r"))
    return first.select("person_key", "r.*")


def links(persons: DataFrame, above: Column, charted: tuple[str, ...]) -> DataFrame:
    """People with father_key, resolved_key and link_status.

    Columns: person_key, label, own_value, parent_value, parent_name, ordinal and others. ``above`` is
    the generation over a person's. root: none there is; outside_volume: it isn't charted; then
    resolved, unresolved (an id nobody carries, or neither id nor name), named_only.
    """
    inside = above.isin(*charted)
    father = F.when(inside & F.col("parent_value").isNotNull(), person_key(above, F.col("parent_value"))).when(inside & (F.coalesce("parent_name", F.lit("")) != ""), named_key(above, F.col("parent_name")))
    own = persons.withColumn("above", above).withColumn("father_key", father)
    # Null keys have no father to look for; without them the join can't be skewed by roots.
    fathers = persons.select(F.col("person_key").alias("father_key"), F.lit(True).alias("_found"))
    out = own.join(fathers, "father_key", "left")
    status = (
        F.when(F.col("above").isNull(), "root").when(~F.col("above").isin(*charted), "outside_volume")
        .when(F.col("parent_value").isNotNull(), F.when(F.col("_found"), "resolved").otherwise("unresolved"))
        .when(F.coalesce("parent_name", F.lit("")) != "", "named_only").otherwise("unresolved")
    )
    resolved = F.when(F.col("_found") | status.isin("named_only"), F.col("father_key"))
    return out.withColumn("link_status", status).withColumn("resolved_key", resolved).drop("_found")


def _finding(kind: Column | str, expected: Column, observed: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), expected.alias("expected"), observed.alias("observed"))


def link_findings(entries: DataFrame, linked: DataFrame) -> DataFrame:
    """(kind, geometric, page, entry, expected, observed) of repeated ids and missing fathers."""
    first = linked.select("person_key", F.col("page").alias("_page"), F.col("ordinal").alias("_first"))
    keyed = entries.where(F.col("own_value").isNotNull()).withColumn("person_key", person_key(F.col("label"), F.col("own_value")))
    again = keyed.join(first, "person_key").where(F.col("ordinal") != F.col("_first"))
    place, seen = ("geometric", "page", "entry"), snippet(F.col("text"))
    repeated = again.select(*place, _finding("duplicate_id", F.concat("person_key", F.lit(" already on page "), F.col("_page").cast("string")), seen).alias("f"))
    lost = linked.where(F.col("link_status") == "unresolved")
    kind = F.when(F.col("parent_value").isNotNull(), "unresolved_father").otherwise("no_father_field")
    due = F.coalesce("father_key", F.concat(F.lit("a "), F.col("above"), F.lit(" id or a name")))
    missing = lost.select(*place, _finding(kind, due, seen).alias("f"))
    return repeated.unionByName(missing).select("f.kind", *place, "f.expected", "f.observed")


def sibling_findings(linked: DataFrame) -> DataFrame:
    """(kind, geometric, page, entry, expected, observed): sons of one father with one rank, or ranks that fall as ids rise.

    ``linked`` has resolved_key, own_value, ordinal, rank and order. Rows without a rank are passed over.
    """
    ranked = linked.where(F.col("resolved_key").isNotNull() & F.col("rank").isNotNull())
    by_id = ("own_value", "ordinal")
    holder = F.lag("page").over(Window.partitionBy("resolved_key", "rank").orderBy(*by_id))
    elder = F.lag(F.struct("rank", "order")).over(Window.partitionBy("resolved_key").orderBy(*by_id))
    rows = ranked.withColumn("_holder", holder).withColumn("_elder", elder)
    told = F.array_compact(F.array(
        F.when(F.col("_holder").isNotNull(), _finding("order_conflict", F.concat(F.lit("a rank not already used among "), F.col("resolved_key"), F.lit("'s sons")), F.concat("order", F.lit(" duplicates page "), F.col("_holder").cast("string")))),
        F.when(F.col("rank") < F.col("_elder.rank"), _finding("order_reversed", F.concat(F.lit("a rank above "), F.col("_elder.order")), F.concat("order", F.lit(" after "), F.col("_elder.order")))),
    ))
    return rows.select("geometric", "page", "entry", F.explode(told).alias("f")).select("f.kind", "geometric", "page", "entry", "f.expected", "f.observed")


def tallies(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People by generation, and by link status."""
    return linked.groupBy("label").agg(F.count("*").alias("people")), linked.groupBy("link_status").agg(F.count("*").alias("people"))


def families(linked: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(father_key, family): families in the order of their fathers' generation and number, those known by name after.

    Numbers run over all families: ranges of rows are counted first and numbered within each, so no
    task sorts them all.
    """
    from .stats import numbered

    keys = linked.where(F.col("father_key").isNotNull()).select("father_key").distinct()
    named = ~F.col("father_key").contains(":")
    label = F.when(named, F.substring_index("father_key", "#", 1)).otherwise(F.substring_index("father_key", ":", 1))
    number = F.when(~named, F.substring_index("father_key", ":", -1).try_cast("long"))
    rank, other = sort_rank(label, labels)
    sorted_by = keys.withColumn("_rank", rank).withColumn("_other", other).withColumn("_unknown", number.isNull()).withColumn("_number", F.coalesce(number, F.lit(0)))
    return numbered(sorted_by, ["_rank", "_other", "_unknown", "_number", "father_key"], "family").select("father_key", "family")


def gedcom_lines(linked: DataFrame, labels: tuple[str, ...], file_name: str, source: str = "strandline") -> DataFrame:
    """(part, major, minor, line): the lines of a GEDCOM 5.5.1 file, sorted by the first three.

    ``linked`` has id, person_key, label, own_id, own_value, order, extra, father_key and father_name.
    A family has a husband only if his row is exported, otherwise his name.
    """
    from .stats import numbered

    rank, other = sort_rank(F.col("label"), labels)
    rows = linked.withColumn("_rank", rank).withColumn("_other", other).withColumn("_unknown", F.col("own_value").isNull()).withColumn("_value", F.coalesce("own_value", F.lit(0)))
    rows = numbered(rows, ["_rank", "_other", "_unknown", "_value", "id"], "place")
    fam = families(linked, labels)
    own = fam.select(F.col("father_key").alias("person_key"), F.col("family").alias("own_family"))
    rows = rows.join(fam, "father_key", "left").join(own, "person_key", "left")
    some = lambda value, *parts: F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    text, no = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None")), lambda c: F.col(c).cast("string")
    note = F.regexp_replace(F.regexp_replace("extra", r"(?U)\s+", " "), "^ | $", "")
    individual = F.array_compact(F.array(
        F.concat(F.lit("0 @I"), no("id"), F.lit("@ INDI")), F.concat(F.lit("1 NAME "), text("own_id")), F.concat(F.lit("1 _GEN "), text("label")),
        some(F.col("order"), "1 _ORDER ", F.col("order")), some(F.col("extra"), "1 NOTE ", note),
        some(F.col("family"), "1 FAMC @F", no("family"), "@"), some(F.col("own_family"), "1 FAMS @F", no("own_family"), "@"),
    ))
    first = rows.select(F.lit(1).alias("part"), F.col("place").alias("major"), F.posexplode(individual).alias("minor", "line"))
    # The eldest row of a family tells the father's name; children follow in order, each a row of its own.
    heads = rows.where(F.col("family").isNotNull()).groupBy("family").agg(F.min_by("father_name", "place").alias("name"), F.first("father_key").alias("person_key"))
    heads = heads.join(rows.select("person_key", F.col("id").alias("husband")), "person_key", "left")
    lines = F.array_compact(F.array(
        F.concat(F.lit("0 @F"), no("family"), F.lit("@ FAM")),
        F.coalesce(some(F.col("husband"), "1 HUSB @I", no("husband"), "@"), some(F.col("name"), "1 _FATHER_NAME ", F.col("name"))),
    ))
    second = heads.select(F.lit(2).alias("part"), F.col("family").alias("major"), F.posexplode(lines).alias("minor", "line"))
    children = rows.where(F.col("family").isNotNull()).select(F.lit(2).alias("part"), F.col("family").alias("major"), (F.col("place") + 2).cast("int").alias("minor"), F.concat(F.lit("1 CHIL @I"), no("id"), F.lit("@")).alias("line"))
    spark = linked.sparkSession
    fixed = ["0 HEAD", f"1 SOUR {source}", "1 GEDC", "2 VERS 5.5.1", "2 FORM LINEAGE-LINKED", "1 CHAR UTF-8", f"1 FILE {file_name}"]
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("major"), F.posexplode(F.array(*[F.lit(x) for x in fixed])).alias("minor", "line"))
    tail = spark.range(1).select(F.lit(3).alias("part"), F.lit(0).cast("long").alias("major"), F.lit(0).alias("minor"), F.lit("0 TRLR").alias("line"))
    return head.unionByName(first).unionByName(second).unionByName(children).unionByName(tail)


def parsed_entries(entries: DataFrame, profile: Profile, charted: tuple[str, ...]) -> DataFrame:
    """Entries (document_id, page, entry, geometric, text, source, ordinal) resolved to their generation and split into fields."""
    from ..functions.fields import resolve_entry
    from ..functions.numerals import value_of_id
    from ..functions.text import order_rank

    r = entries.withColumn("r", resolve_entry(F.col("text"), F.col("geometric"), profile, charted))
    p = "r.parsed."
    return r.select(
        *entries.columns, F.col("r.label").alias("label"), F.col(p + "own_id").alias("own_id"), value_of_id(F.col(p + "own_id")).alias("own_value"),
        F.col(p + "parent_id").alias("parent_id"), value_of_id(F.col(p + "parent_id")).alias("parent_value"), F.col(p + "parent_name").alias("parent_name"),
        F.col(p + "order").alias("order"), order_rank(F.col(p + "order")).alias("rank"), F.col(p + "leftover").alias("leftover"),
        F.struct(p + "label_from_geometry", p + "observed_label", p + "numeral_repairs", p + "watermark_noise").alias("flags"),
    )
