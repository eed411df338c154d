"""Traditional numerals as native expressions: one fold over the characters, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import FALLBACK_LABELS

# Numeral characters with their financial and simplified variants.
DIGITS = {
    "〇": 0, "零": 0, "一": 1, "壹": 1, "二": 2, "貳": 2, "贰": 2, "两": 2, "兩": 2, "三": 3, "參": 3, "叁": 3,
    "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陸": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9,
}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
CONTRACTED = {"廿": 20, "卅": 30, "卌": 40}
NUMERAL_CHARS = "".join((*DIGITS, *UNITS, *CONTRACTED))
PLAIN = "〇一二三四五六七八九"


#: ASCII names of units and contracted tens, into which a numeral is written before it is worked out.
_UNIT_NAMES = {10: "X", 100: "C", 1000: "M"}
_TEN_NAMES = {20: "a", 30: "b", 40: "c"}
_ASCII = "".join([*(str(v) for v in DIGITS.values()), *(_UNIT_NAMES[v] for v in UNITS.values()), *(_TEN_NAMES[v] for v in CONTRACTED.values())])


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _times(before: Column) -> Column:
    """What a unit is multiplied by: the digit before it, else one."""
    return F.when(before.between("0", "9"), F.ascii(before) - 48).otherwise(1)


def _any_order(ascii_text: Column) -> Column:
    """The value where a unit occurs twice: a sum over all of them."""
    units = F.regexp_extract_all(ascii_text, F.lit("[0-9]?[XCM]"), 0)
    size = lambda u: F.when(u.endswith("X"), 10).when(u.endswith("C"), 100).otherwise(1000)
    return F.aggregate(units, F.lit(0).cast("long"), lambda sum_, u: sum_ + size(u) * _times(F.substring(u, 1, 1)))


def parse_numeral(text: Column) -> Column:
    """The number that a numeral means, as long; null for what isn't one, or is empty.

    A unit without a digit means one of it; of adjacent digits the last counts; a contracted ten
    after a pending digit, or any other character, spoils the whole. Each unit is looked up by place,
    without a fold over the characters.
    """
    return let(ascii_numeral(text), lambda t: value_of_ascii(text, t))


def ascii_numeral(text: Column) -> Column:
    """A numeral in ASCII: 0-9, X, C, M for units, a, b, c for contracted tens."""
    return F.translate(text, NUMERAL_CHARS, _ASCII)


def value_of_ascii(text: Column, t: Column) -> Column:
    """What a text means whose ASCII form is ``t``; for plans that work ``t`` out once."""

    def unit(name: str, size: int) -> Column:
        at = F.instr(t, name)
        return F.when(at > 0, size * _times(F.substr(t, at - 1, F.lit(1)))).otherwise(0)

    tens = lambda name, size: size * (F.length(t) - F.length(F.replace(t, F.lit(name), F.lit(""))))
    last = F.substring(t, -1, 1)
    units = F.when(t.rlike(r"([XCM]).*\1"), _any_order(t)).otherwise(sum((unit(n, v) for v, n in _UNIT_NAMES.items()), F.lit(0).cast("long")))
    value = units + sum((tens(n, v) for v, n in _TEN_NAMES.items()), F.lit(0)) + F.when(last.between("0", "9"), F.ascii(last) - 48).otherwise(0)
    return F.when(text.rlike(f"^[{NUMERAL_CHARS}]+$") & ~t.rlike("[0-9][abc]"), value.cast("long"))


def format_numeral(value: Column) -> Column:
    """A number below 10,000 as a numeral; null for others. One of a unit is the unit alone, skipped places leave nothing."""
    rest, parts = value, []
    digits = F.split(F.lit(PLAIN), "")
    for size, char in ((1000, "千"), (100, "百"), (10, "十")):
        count = F.floor(rest / size).cast("int")
        parts.append(F.when(count > 1, F.concat(F.get(digits, count), F.lit(char))).when(count == 1, F.lit(char)).otherwise(""))
        rest = rest % size
    parts.append(F.when(rest > 0, F.get(digits, rest.cast("int"))).otherwise(""))
    return F.when((value > 0) & (value < 10_000), F.concat(*parts)).when(value == 0, F.lit(PLAIN[0]))


def entry_id_parts(text: Column, labels: tuple[str, ...] = FALLBACK_LABELS) -> tuple[Column, Column, Column]:
    """(stripped text, label, numeral) of an id; a text of no such form has a null numeral."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    pattern = rf"(?U)^([{''.join(labels)}])?\s*(\S+)$"
    return raw, F.nullif(F.regexp_extract(raw, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(raw, pattern, 2), F.lit(""))


def id_reason(numeral: Column, value: Column) -> Column:
    return F.when(numeral.isNull(), F.lit("unrecognised id format")).when(value.isNull(), F.lit("numeral not parseable")).otherwise("")


def parse_entry_id(text: Column, labels: tuple[str, ...] = FALLBACK_LABELS) -> Column:
    """An id such as 庶五百八十七 as struct(text, band, value, ok, reason). Space of any script may stand around its parts."""
    raw, band, numeral = entry_id_parts(text, labels)
    parts = F.struct(raw.alias("text"), band.alias("band"), numeral.alias("numeral"))

    def told(p: Column, value: Column) -> Column:
        return F.struct(p["text"].alias("text"), p["band"].alias("band"), value.alias("value"), value.isNotNull().alias("ok"), id_reason(p["numeral"], value).alias("reason"))

    return let(parts, lambda p: let(parse_numeral(p["numeral"]), lambda v: told(p, v)))


def value_of_id(text: Column) -> Column:
    """The number after an id's first character; null for ids shorter than two."""
    return F.when(F.length(text) >= 2, parse_numeral(F.substring(text, 2, 1 << 30)))


def own_id_from_digits(label: Column, digits: Column) -> Column:
    """Label and numeral for digits typed by a reviewer, e.g. (庶, 343); null unless they are ASCII digits alone."""
    text = F.btrim(digits)
    return F.when(text.rlike("^[0-9]{1,18}$"), F.concat(label, format_numeral(text.try_cast("long"))))
