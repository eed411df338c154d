"""Text of a library's stamp, told apart from what a page says: native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerals import let

# The stamp's phrases, in the order in which they are looked for, and its glyphs.
MARKS = ("富阳图书馆", "富陽圖書館", "富阳圖書館", "富陽图书馆", "富阳区图书馆", "富陽區圖書館", "图书馆", "圖書館", "书馆", "書館")
GLYPHS = "富陽阳旺图圖书書馆館区區"
#: Upper-case words of the stamp's Latin line, whole or broken.
LATIN = r"(?:[A-Z]*FUYANG[A-Z]*|FUYA[A-Z]*|[A-Z]*LIBRAR[A-Z]*|LIBR[A-Z]*|[A-Z]*BRARY[A-Z]*|BRAR[A-Z]*|RARY|EIBRAR)"
WORD = rf"(?<![A-Za-z]){LATIN}(?![A-Za-z])"
SHORT = r"(?<![A-Za-z])[A-Z]{1,3}(?![A-Za-z])"
EDGES = " ,.;:，。；：·|/-"


def filter_watermark(text: Column) -> Column:
    """struct(text, removed): the text without the stamp's words, null if nothing is left, and what went, in order.

    Phrases go first, then upper-case words of four letters or more; only if any went do detached
    runs of one to three capitals go too, and what then is left of four glyphs or fewer, all the
    stamp's or capitals. Lines are tidied of spaces and marks at their ends; empty ones go.
    """
    none = F.array().cast("array<string>")
    both = lambda work, gone: F.struct(work.alias("work"), gone.alias("gone"))
    stripped = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")

    def without(state: Column, mark: Column) -> Column:
        return let(F.replace(state["work"], mark, F.lit("")), lambda rest: both(rest, F.concat(state["gone"], F.array_repeat(mark, ((F.length(state["work"]) - F.length(rest)) / F.length(mark)).cast("int")))))

    def words(s: Column) -> Column:
        return both(F.regexp_replace(s["work"], WORD, " "), F.concat(s["gone"], F.regexp_extract_all(s["work"], F.lit(WORD), 0)))

    def shorts(s: Column) -> Column:
        gone = F.concat(s["gone"], F.regexp_extract_all(s["work"], F.lit(SHORT), 0))
        return F.when(F.size(s["gone"]) > 0, both(F.regexp_replace(s["work"], SHORT, " "), gone)).otherwise(s)

    def tidy(line: Column) -> Column:
        line = F.regexp_replace(F.regexp_replace(line, r"[ \t]+", " "), " ([,.;:，。；：])", "$1")
        return F.btrim(stripped(line), F.lit(EDGES))

    def tidied(s: Column) -> Column:
        lines = F.filter(F.transform(F.split(s["work"], r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), tidy), lambda x: x != "")
        return both(stripped(F.array_join(lines, "\n")), s["gone"])

    def rest(s: Column) -> Column:
        logo = (F.size(s["gone"]) > 0) & F.regexp_replace(s["work"], r"(?U)\s+", "").rlike(rf"^[{GLYPHS}A-Z]{{1,4}}$")
        return let(logo, lambda gone: F.struct(F.when(~gone & (s["work"] != ""), s["work"]).alias("text"), F.concat(s["gone"], F.when(gone, F.array(s["work"])).otherwise(none)).alias("removed")))

    out = F.aggregate(F.array(*[F.lit(m) for m in MARKS]), both(stripped(F.coalesce(text, F.lit(""))), none), without)
    for step in (words, shorts, tidied, rest):
        out = let(out, step)
    return out
