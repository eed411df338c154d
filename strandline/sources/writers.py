"""Exports: lines in order as text, findings as JSON, reports as Markdown, bundles."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Sequence
from typing import BinaryIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flat, one_line
from ..operators.graph import gedcom_lines, sort_rank
from ..operators.sequence import rate
from ..operators.stats import numbered

#: Rows of a report at most.
ROWS = 10_000
PEOPLE = ("person_key", "generation", "own_id", "own_value", "father_key", "father_name", "birth_order", "additional_info", "link_status")
TRANSCRIPTION = ("page", "band", "entry", "source", "text", "own_id", "parent", "birth_order", "additional_info")


def tsv(columns: Sequence[str], clean=one_line) -> Column:
    return F.concat_ws("\t", *[clean(F.col(c).cast("string")) for c in columns])


def people_lines(persons: DataFrame, labels: tuple[str, ...], document_id: str) -> DataFrame:
    """(place, line): a comment, a header, and a line per person, generations as charted, numbers ascending, unnumbered last."""
    rank, other = sort_rank(F.col("generation"), labels)
    rows = persons.withColumn("_rank", rank).withColumn("_other", other).withColumn("_unknown", F.col("own_value").isNull()).withColumn("_value", F.coalesce("own_value", F.lit(0)))
    rows = numbered(rows, ["_rank", "_other", "_unknown", "_value", "id"], "place")
    head = persons.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("place"), F.lit(x).alias("line")) for i, x in ((-1, f"# {document_id} — reconstructed people"), (0, "\t".join(PEOPLE)))])))
    return head.unionByName(rows.select("place", tsv(PEOPLE).alias("line")))


def write_lines(lines: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> None:
    """Lines in order as text: a folder of files whose names sort as their lines do, as many as their size asks for, or ``files``."""
    dealt = lines.repartitionByRange(files, *order) if files else lines.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def write_people(persons: DataFrame, labels: tuple[str, ...], document_id: str, path: str) -> int:
    """How many people were written. ``persons`` is read twice, so it should be a written table."""
    write_lines(people_lines(persons, labels, document_id), path, ["place"])
    return persons.count()


def write_gedcom(linked: DataFrame, labels: tuple[str, ...], path: str) -> tuple[int, int]:
    """(individuals, families) written."""
    lines = gedcom_lines(linked, labels, path.rsplit("/", 1)[-1])
    write_lines(lines, path, ["part", "major", "minor"])
    found = linked.agg(F.count("*").alias("i"), F.countDistinct("father_key").alias("f")).first()
    return found["i"], found["f"]


def transcription(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of every entry, and how many come from each source. ``entries`` has ``TRANSCRIPTION`` and place."""
    return entries.select("place", tsv(TRANSCRIPTION, flat).alias("line")), entries.groupBy("source").agg(F.count("*").alias("entries"))


def verified(entries: DataFrame) -> DataFrame:
    """Lines of what a person has read, readable, on pages that aren't ignored."""
    kept = entries.where((F.col("source") == "human") & F.col("text").isNotNull() & ~F.coalesce("ignored", F.lit(False)))
    return kept.select("place", tsv(TRANSCRIPTION, flat).alias("line"))


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def queue_lines(queue: DataFrame) -> DataFrame:
    """The review queue with an empty column for the transcription."""
    return queue.select("page", "entry", F.concat_ws("\t", F.col("page").cast("string"), "band", F.col("entry").cast("string"), F.lit(""), "reason").alias("line"))


def markdown(table: DataFrame, title: str) -> str:
    """A small aggregated table as Markdown; what is written is what was counted. A table of more than ``ROWS`` rows is no report."""
    rows = table.limit(ROWS + 1).collect()
    if len(rows) > ROWS:
        raise ValueError(f"a report has {ROWS} rows at most")
    head = f"# {title}\n\n| {' | '.join(table.columns)} |\n|{'---|' * len(table.columns)}\n"
    return head + "".join(f"| {' | '.join('' if x is None else f'{x:.4g}' if isinstance(x, float) else str(x) for x in r)} |\n" for r in rows)


def scorecard_markdown(card: DataFrame) -> str:
    """The scorecard's counts as rates of the eligible."""
    share = lambda c: F.round(rate(F.col(c), F.col("eligible")), 4).alias(c)
    return markdown(card.select("reviewed", "eligible", "machine_present", *[share(c) for c in ("own_id_exact", "parent_exact", "order_exact", "exact_core")]), "Corrections")


def bundle(parts: dict[str, DataFrame], counts: dict, out: BinaryIO) -> None:
    """Exports as one archive with a summary, written to an open file. Lines stream by, a partition at a time."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, lines in parts.items():
            with z.open(name, "w", force_zip64=True) as f:
                for r in lines.orderBy("place").toLocalIterator():
                    f.write(f"{r['line']}\n".encode())
        z.writestr("summary.json", json.dumps(counts, ensure_ascii=False, indent=1))


def ndjson(events) -> str:
    """Progress events as lines; exactly one result or error comes last."""
    rows = list(events)
    ends = [e["type"] in ("result", "error") for e in rows]
    if not rows or not ends[-1] or sum(ends) != 1:
        raise ValueError("a run ends with exactly one result or error")
    return "".join(json.dumps(e, ensure_ascii=False, sort_keys=True) + "\n" for e in rows)
