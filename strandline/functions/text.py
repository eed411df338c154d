"""Small text functions of the reports and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import Profile

# What headers say, and what of it contaminates an entry cut too wide.
SECTION, GENERATION, TITLES = "字第", "第[一二三四五六七八九十百千]+世", "宗譜|雁序圖"
CONTAMINATED = "字第|第[一二三四五六七八九十百]+世|雁序圖|宗譜"


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column) -> Column:
    """Without any white space: how hypotheses are compared."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def one_line(text: Column) -> Column:
    """White space collapsed; null as empty."""
    return F.coalesce(stripped(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def flat(text: Column) -> Column:
    """Tabs and line ends as spaces, trimmed, not collapsed; null as empty."""
    return F.coalesce(stripped(F.translate(text, "\t\n\r", "   ")), F.lit(""))


def snippet(text: Column, size: int = 40) -> Column:
    """The start of a text on one line, as findings quote it."""
    return F.substring(F.translate(text, "\n", " "), 1, size)


def canonical_label(label: Column, profile: Profile) -> Column:
    """The label that a printed variant stands for; others as they are."""
    pairs = profile.variants
    return F.translate(label, "".join(pairs), "".join(pairs.values()))


def parent_label(label: Column, profile: Profile) -> Column:
    """The generation above by the profile's chain; null for the first and for unknown labels."""
    pairs = [(a, b) for a, b in zip(profile.chain[1:], profile.chain[:-1], strict=True)]
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), label) if pairs else F.lit(None).cast("string")


def order_rank(order: Column) -> Column:
    """A birth order's rank: 1 for only, eldest and first, 2 second, -1 youngest, null if it tells none."""
    from .numerals import DIGITS

    head = F.substring(order, 1, 1)
    digit = F.try_element_at(F.create_map(*[F.lit(x) for k, v in DIGITS.items() for x in (k, v)]), head)
    return F.when(head.isin("子", "女", "長", "元"), 1).when(head == "次", 2).when(head == "幼", -1).when(digit > 0, digit)


def compose_entry(own: Column, parent: Column, order: Column, extra: Column) -> Column:
    """The printed fields on one line, further text on the next; missing ones leave nothing."""
    core = F.concat_ws("", own, parent, order)
    more = stripped(F.coalesce(extra, F.lit("")))
    return F.when(more == "", core).when(core == "", more).otherwise(F.concat_ws("\n", core, more))


def labels_from_header(text: Column) -> Column:
    """Labels that a header names, distinct, in order: the character before each section mark."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([\u4e00-\u9fff]){SECTION}"), 1))


def header_kind(text: Column) -> Column:
    """What a header says, white space aside: the first of its section, a generation or the document's title that fits, else the page's."""
    t = compact(F.coalesce(text, F.lit("")))
    return F.when(t.contains(SECTION), "section_title").when(t.rlike(GENERATION), "generation_title").when(t.rlike(TITLES), "document_title").otherwise("page_header")


def has_header(text: Column) -> Column:
    """Whether an entry's text holds a header's words."""
    return F.coalesce(text.rlike(CONTAMINATED), F.lit(False))


def expected_id(findings: Column, label: Column) -> Column:
    """The id that a run needs here: of the first gap or backward step among findings (kind, expected) that names one."""
    fits = F.filter(findings, lambda f: f["kind"].isin("gap", "non_monotonic") & (F.coalesce(f["expected"], F.lit("")) != ""))
    return F.concat(label, F.get(fits, 0)["expected"])


def source_of(unreadable: Column, corrected: Column, human: Column, machine: Column) -> Column:
    """Where an entry's text comes from: a reader's word counts by its presence, even when empty."""
    return F.when(F.coalesce(unreadable, F.lit(False)), "unreadable").when(corrected, "human").when(F.coalesce(machine, F.lit("")) != "", "machine").otherwise("none")


def human_text(corrected: Column, unreadable: Column, text: Column) -> Column:
    """A readable correction without text was stored for an empty one."""
    return F.when(corrected & ~F.coalesce(unreadable, F.lit(False)), F.coalesce(text, F.lit("")))
