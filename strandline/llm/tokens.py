"""Fast, exact encoding by a tokenizer file of the tokenizers library.

Both pre-tokenizers in use cut at white space whatever stands around it, so a text's words can be
encoded apart and remembered. ``encode`` gives the same ids as the library does on the whole text.
"""

from __future__ import annotations

import codecs
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Remembered words at most, and characters of the longest remembered.
WORDS, LONGEST = 1_000_000, 64
#: New words encoded in one call: the library holds some hundred bytes for each of their tokens.
CALL = 8192
#: Bytes of text encoded at once.
GROUP = 6 << 20

_loaded: dict[str, Encoder] = {}
_unsafe = re.compile(r"\s\n|\n[^\S ]|\n \s|\n\n")
_simple = re.compile(r" ?\S+")
#: Lines of letters alone, with one space before them at most: the byte-level pre-tokenizer leaves them whole.
_letters = re.compile("^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0400-\u0481]+$", re.MULTILINE)
#: The characters that byte-level vocabularies write for bytes: printable ones for themselves, others from 256 on.
_odd_bytes = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_shown = "".join(chr(256 + _odd_bytes.index(b) if b in _odd_bytes else b) for b in range(256))
#: Kinds of bytes for the cuts between words. A LETTER_LEAD and a LETTER_END are a letter (the two left out make signs after 0xC3);
#: a SPACE_LEAD may start white space.
OTHER, BLANK, LETTER, SIGN, LETTER_LEAD, LETTER_END, SPACE_LEAD = range(7)
_kinds = bytes(
    BLANK if chr(b) in " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" else LETTER if chr(b).isalpha() and b < 128 else SIGN if 33 <= b < 127 and not 48 <= b <= 57
    else LETTER_LEAD if b in (0xC3, 0xC4, 0xC5, 0xD0, 0xD1) else LETTER_END if 0x80 <= b < 0xC0 and b not in (0x97, 0xB7) else SPACE_LEAD if b in (0xC2, 0xE1, 0xE2, 0xE3) else OTHER for b in range(256)
)
_wide_blanks = np.unique([int.from_bytes(c.encode()) for c in map(chr, range(0x80, 0x3001)) if c.isspace()])
_to_space = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_stop_bytes = re.compile(rb"[.,](?<=[a-z][.,])(?=[ \n])")


def vocabulary_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers. Forgets all words when full, so memory is bounded.

    New words are encoded together, with a separator between whose one id no word can hold.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        self.between = "\n" if spaced else " \x01 "
        self.known: dict[str | bytes, bytes] = {}
        self.mark = self._alone(self.between)
        self.model = self._model() if spaced else None

    def _alone(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _model(self):
        """The same model behind a pre-tokenizer that only parts at spaces, which it drops; None where the file's own does not cut as the byte-level one."""
        from tokenizers import Tokenizer, pre_tokenizers

        own = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or own is None or [x for x, _ in own.pre_tokenize_str("a b\u00e9.c's\nd")] != ["a", "\u0120b\u00c3\u00a9", ".", "c", "'s", "\u010a", "d"]:
            return None
        out = Tokenizer(self.tokenizer.model)
        out.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        return out

    def _learn_letters(self, words: list[str]) -> dict:
        """Those of the words that are of letters go to the model as they are, without the pre-tokenizer, which takes longer than the model does."""
        out: dict = {}
        for i in range(0, len(words), CALL):
            own = words[i : i + CALL]
            letters = set(_letters.findall("\n".join(own)))
            own = [w for w in own if w in letters]
            if not own:
                continue
            shown = codecs.charmap_decode("\n".join(own).encode(), "strict", _shown)[0].replace(_shown[10], f" {_shown[10]} ")
            out.update(self._parted(own, self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids))
        return self._kept(out)

    def _parted(self, words: list, ids: list[int]) -> dict:
        """The words' ids out of those of all of them with the separator between."""
        coded = np.asarray(ids, "<u4")
        cuts = np.flatnonzero(coded == self.mark[0]) * 4
        if len(cuts) != len(words) - 1:
            raise ValueError("the separator's id is not its own")
        data = coded.tobytes()
        return dict(zip(words, [data[i:j] for i, j in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)], strict=True)], strict=True))

    def _kept(self, out: dict) -> dict:
        if len(self.known) + len(out) > WORDS:
            self.known.clear()
        self.known.update(out if max(map(len, out), default=0) <= LONGEST else {w: x for w, x in out.items() if len(w) <= LONGEST})
        return out

    def _learn(self, words: list) -> dict:
        if self.model is None:
            return self._learn_others(set(words))
        out = self._learn_letters(words)
        rest = {w for w in words if w not in out}
        if rest:
            out.update(self._learn_others(rest))
        return out

    def _learn_others(self, words: set) -> dict:
        if len(words) > CALL:
            own = list(words)
            return {w: x for i in range(0, len(own), CALL) for w, x in self._learn_others(set(own[i : i + CALL])).items()}
        own = list(words)
        texts = [w.decode() for w in own] if own and isinstance(own[0], bytes) else own
        joined = self.between.join(texts)
        # The separator stands alone only beside words that neither hold it nor begin or end with other white space.
        if joined.count(self.between.strip(" ")) != len(own) - 1 or _unsafe.search(f"\n{joined}\n") or len(self.mark) != 1:
            if len(own) == 1:
                out = {own[0]: self._alone(texts[0]).tobytes()}
            else:
                safe = {w for w, t in zip(own, texts, strict=True) if _simple.fullmatch(t) and "\x01" not in t}
                out = self._learn_others(safe) if safe and safe != words else {}
                for w, t in zip(own, texts, strict=True):
                    if w not in out:
                        out[w] = self._alone(t).tobytes()
        else:
            out = self._parted(own, self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids)
        return self._kept(out)

    def many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids. All words of the group are told apart at once, so a word is looked up once."""
        pieces, at = spaced_words(texts) if self.spaced else bare_words(texts)
        coded = pieces.dictionary_encode()
        del pieces
        words = listed(coded.dictionary)
        ids = list(map(self.known.get, words))
        new = self._learn([w for w, x in zip(words, ids, strict=True) if x is None]) if None in ids else {}
        payload = pa.array([new[w] if x is None else x for w, x in zip(words, ids, strict=True)], pa.binary()).take(coded.indices)
        _, offsets, data = payload.buffers()
        ends = np.frombuffer(offsets, np.int32)[at].tolist() if len(payload) else [0] * (len(texts) + 1)
        whole = data.to_pybytes() if data else b""
        return [whole[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def spaced_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Pieces for the byte-level pre-tokenizer, which gives a word the one space before it, and each text's first piece.

    A space or line feed with no other white space beside it always starts a piece, as does what
    follows such a line feed, and a sign of ASCII after a letter.
    """
    column = pa.array(texts, pa.string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[: len(texts) + 1]
    size = int(ends[-1]) if len(texts) else 0
    if not size:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[:size]
    kind = np.frombuffer(bytearray(raw.tobytes().translate(_kinds)), np.uint8)
    lead = np.flatnonzero(kind == SPACE_LEAD)
    if len(lead):
        two = raw[lead] == 0xC2
        code = raw[lead].astype(np.int64) << 8 | raw[lead + 1]
        code[~two] = code[~two] << 8 | raw[lead[~two] + 2]
        wide, two = np.isin(code, _wide_blanks), two[np.isin(code, _wide_blanks)]
        for step, some in ((0, lead[wide]), (1, lead[wide]), (2, lead[wide][~two])):
            kind[some + step] = BLANK
    starts, lasts = ends[:-1][ends[:-1] < size], ends[1:][ends[1:] > 0] - 1
    blank = kind == BLANK
    lone, beside = blank.copy(), np.r_[False, blank[:-1]]
    beside[starts] = False
    lone[beside] = False
    beside = np.r_[blank[1:], False]
    beside[lasts] = False
    lone[beside] = False
    feed = lone & (raw == 10)
    cut = feed | lone & (raw == 32)
    del blank, lone, beside
    cut[1:] |= feed[:-1]
    letter = kind == LETTER
    letter[1:] |= (kind[:-1] == LETTER_LEAD) & (kind[1:] == LETTER_END)
    cut[1:] |= letter[:-1] & (kind[1:] == SIGN)
    cut[starts] = True
    first = np.flatnonzero(cut)
    pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, size).astype(np.int32)), data)
    return pieces, np.searchsorted(first, ends)


def bare_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Pieces for the pre-tokenizer that drops white space and lower-cases, and each text's first piece: ASCII white space leaves no doubt."""
    marked = pa.array([_stop_bytes.sub(b" \\g<0>", t.encode().lower().translate(_to_space)) for t in texts], pa.binary())
    lists = pc.split_pattern(marked, " ")
    return lists.flatten(), np.asarray(lists.offsets)


def listed(words: pa.Array) -> list:
    """The words as a list; faster than to_pylist, where no word holds the mark between them."""
    if pa.types.is_string(words.type) and len(words):
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\x1f")[0].as_py()
        out = joined.split("\x1f")
        if len(out) == len(words):
            return out
    return words.to_pylist()


def groups(column: pa.Array, budget: int = GROUP) -> list[tuple[int, int]]:
    """(first row, rows) of groups of about ``budget`` bytes, one row at least."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0))
    part = np.cumsum(sizes) // budget
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    return list(zip(first.tolist(), np.diff(np.append(first, len(part))).tolist(), strict=True))


def encoder(name: str, path: str | None = None) -> Encoder:
    """The encoder of a vocabulary file, loaded once in a worker; ``path``: where it lies, if not at its public place."""
    at = path or vocabulary_path(name)
    if at not in _loaded:
        _loaded[at] = Encoder(at, not name.startswith("word_"))
    return _loaded[at]
