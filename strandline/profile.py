"""What a document says about itself: its generations, its bands, and known misreadings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Labels of the known volumes, their printed variants and a misread numeral.
FALLBACK_LABELS = ("允", "庶", "富", "教", "清", "廉", "麗", "熙")
DEFAULT_CHAIN = ("允", "庶", "富", "教")
DEFAULT_BANDS = ("庶", "富", "教")
LABEL_VARIANTS = {"敎": "教", "庻": "庶"}
NUMERAL_CONFUSABLES = {"干": "千"}
#: Stems and branches, which name a year, and the label that comes before one in the volume before.
CYCLE = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥"
PREDECESSORS = {"庶": "允"}


@dataclass(frozen=True)
class Profile:
    """Passed to every operator that needs it; nothing is global, so executors see what the caller means."""

    document_id: str = ""
    bands: tuple[str, ...] = DEFAULT_BANDS
    chain: tuple[str, ...] = DEFAULT_CHAIN
    bands_per_page: int = 3
    label_variants: dict[str, str] = field(default_factory=dict)
    label_confusions: dict[str, str] = field(default_factory=dict)
    numeral_confusions: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_title(cls, title: str) -> Profile:
        """Labels out of a title such as 丙辰庶富教1: the Han characters between the cycle's name and the volume's number."""
        found = re.fullmatch(rf"[{CYCLE}]*([\u4e00-\u9fff]+?)\d*", title)
        labels = tuple(found[1]) if found else ()
        before = tuple(PREDECESSORS[x] for x in labels[:1] if x in PREDECESSORS)
        return cls(title, labels, before + labels, len(labels))

    @classmethod
    def from_dict(cls, values: dict) -> Profile:
        """As read from a profile file; unknown keys are left out, lists become tuples."""
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in cls.__dataclass_fields__}
        renamed = {"band_labels": "bands", "generation_chain": "chain"}
        known |= {new: tuple(values[old]) for old, new in renamed.items() if old in values}
        return cls(**known)

    @property
    def variants(self) -> dict[str, str]:
        return LABEL_VARIANTS | self.label_variants

    @property
    def repairs(self) -> dict[str, str]:
        """Misread numerals: one glyph for one, and only to a numeral."""
        from .functions.numerals import NUMERAL_CHARS

        return {a: b for a, b in (NUMERAL_CONFUSABLES | self.numeral_confusions).items() if len(a) == len(b) == 1 and b in NUMERAL_CHARS}

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*FALLBACK_LABELS, *self.chain)))

    def parent(self, label: str | None) -> str | None:
        """The generation above, if the chain has one."""
        return self.chain[self.chain.index(label) - 1] if label in self.chain[1:] else None
