"""Language-model scoring by prediction by partial matching over bytes.

The trie of byte contexts up to ``order`` is kept as counts of (order + 1)-byte strings; counts of
shorter contexts are their marginals, since each text is padded in front. A symbol's probability
comes from the longest context that knows it; each longer context pays an escape (method D), and
symbols which a longer context knows are excluded below it. The byte 0xFF, which UTF-8 never holds,
pads the front and ends each text.

Every count covers all training documents. Texts are dealt into chunks of bounded size; each chunk
sends its distinct strings once, in compressed blocks, a block for each share of the trie. A share
sums them, works out the code lengths, and gives each chunk those of its own strings back. Shares
are groups of two-byte contexts, each split by the byte before them; what all shares of a group need
of the shorter contexts travels with the blocks, and the pairs of bytes, 65,536 at most whatever the
corpus, are counted first and are all that is broadcast.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashTable, chunk_count, chunked, mix64, raw, summed, trim

#: Bytes of a context; a string of order + 1 bytes must stay below 2^63, where words begin.
ORDER = 5
#: Shares into which a group of two-byte contexts is split, and groups at most.
SPLIT, GROUPS = 8, 1 << 16
#: Bytes of text in a chunk.
CHUNK = 16 << 20
#: Positions handled at once.
WINDOW = 1 << 18
END = b"\n"  # no word holds white space, so this names the end token
ALPHABET = 256

def word_key(word: bytes) -> int:
    """Words get negative keys, strings of bytes non-negative ones."""
    return (xxhash.xxh3_64_intdigest(word) >> 1) - (1 << 63)


def _strings(texts: list[bytes], order: int):
    """Yields (codes, first text, starts of texts among the codes) a window at a time. A code's lowest byte is the symbol."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    flat = np.frombuffer(b"".join(b"\xff" * order + t + b"\xff" for t in texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + order)])
    for at in range(0, len(flat), WINDOW):
        end, low = min(at + WINDOW, len(flat)), max(0, at - order)
        part = flat[low:end].astype(np.uint64)
        code = part.copy()
        for j in range(1, order + 1):
            code[j:] |= part[:-j] << np.uint64(8 * j)
        code = code[at - low :]
        keep = np.ones(end - at, bool)
        first, last = np.searchsorted(begin, at, "right") - 1, np.searchsorted(begin, end, "left")
        for i in range(first, last):
            keep[max(begin[i] - at, 0) : max(begin[i] + order - at, 0)] = False
        real = np.cumsum(keep) - keep
        starts = real[np.clip(begin[first:last] - at, 0, end - at - 1)]
        yield code[keep], first, starts


def _count(train: list[bool], texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a chunk with their counts in its training texts; keys of other texts alone get 0."""
    keys, counts = [], []
    for flag in (True, False):
        own = [t for t, f in zip(texts, train, strict=True) if f == flag]
        words: Counter = Counter()
        for t in own:
            words.update(t.lower().split())
        if own:
            words[END] = len(own)
        keys.append(np.fromiter(map(word_key, words), np.int64, len(words)))
        counts.append(np.fromiter(words.values(), np.int64, len(words)) * flag)
        found: list[tuple] = []
        for code, _, _ in _strings(own, order):
            found.append(np.unique(code, return_counts=True))
            if sum(len(k) for k, _ in found) > 1 << 19:
                found = [summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))]
        for k, c in found:
            keys.append(k.astype(np.int64))
            counts.append(c * flag)
    return summed(np.concatenate(keys), np.concatenate(counts))


def _lower(strings: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of order k, as marginals of a higher order's."""
    return summed(strings & np.uint64((1 << 8 * (k + 1)) - 1), counts)


def log_probabilities(queries: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> np.ndarray:
    """log10 of each string's last symbol after the bytes before it.

    tables[k]: ascending strings of k + 1 bytes with their counts, all that share a context with a query.
    """
    out, left = np.zeros(len(queries)), np.ones(len(queries), bool)
    gone, known = np.zeros(len(queries)), np.zeros(len(queries))  # count and number of the symbols excluded
    for k in range(order, -1, -1):
        strings, counts = tables[k]
        if not len(strings):
            continue
        contexts, first, symbols = np.unique(strings >> np.uint64(8), return_index=True, return_counts=True)
        totals = np.add.reduceat(counts, first)
        q = queries & np.uint64((1 << 8 * (k + 1)) - 1)
        at = np.minimum(np.searchsorted(contexts, q >> np.uint64(8)), len(contexts) - 1)
        seen = contexts[at] == q >> np.uint64(8)
        own = np.minimum(np.searchsorted(strings, q), len(strings) - 1)
        new = symbols[at] - known
        use = left & seen & (new > 0)
        whole = np.where(use, 2.0 * (totals[at] - gone), 1)
        hit = use & (strings[own] == q)
        out[hit] += np.log10((2 * counts[own[hit]] - 1) / whole[hit])
        miss = use & ~hit
        out[miss] += np.log10(new[miss] / whole[miss])
        left &= ~hit
        if k:
            below, amounts = tables[k - 1]
            same = np.searchsorted(below, strings & np.uint64((1 << 8 * k) - 1))
            gone = np.where(seen, np.add.reduceat(amounts[same], first)[at], 0)
        known = np.where(seen, symbols[at], 0)
    out[left] -= np.log10(ALPHABET - known[left])
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte by byte of equal weight, compressed: each comes back bit for bit."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes, kind=np.uint64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def share_of(keys: np.ndarray, groups: int, split: int) -> np.ndarray:
    """The share of strings: by the two bytes before the symbol, and by the one before these."""
    group = mix64(keys >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(groups)
    third = mix64(keys >> np.uint64(24) & np.uint64(0xFF)) % np.uint64(split)
    return (group * np.uint64(split) + third).astype(np.int64)


def count_pairs(docs: DataFrame, text: Column) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of bytes over all texts, ends included, ascending, with their counts: 65,536 at most reach the driver."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"\xff" + b"".join(t + b"\xff" for t in raw(batch.column(0))), np.uint8)
            for at in range(0, len(flat) - 1, 1 << 20):
                part = flat[at : at + (1 << 20) + 1].astype(np.uint16)
                total += np.bincount(part[:-1] << 8 | part[1:], minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    rows = docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    found = sorted((r["pair"], r["n"]) for r in rows)
    return np.array([p for p, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a condition over docs that says which rows the model learns from (null: it doesn't).
    score is the model's log10 probability of the text and its end; base_score that of its words
    under a unigram model smoothed by 0.1. A null text counts as empty, a null id is kept; repeated
    rows each count and each get a row; other columns are ignored; an empty table gives no rows. If
    no row is for training, every symbol has probability 1/256 and c, N and V are 0. ``order`` is 2 to 6.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6")
    chunks = chunk_count(docs, text_col, chunk_bytes)
    learns = F.coalesce(train, F.lit(False))
    texts = chunked(docs, id_col, text_col, chunks, train=learns)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    pairs = docs.sparkSession.sparkContext.broadcast(count_pairs(docs.where(learns), F.col(text_col)))
    # Without a third byte before the symbol a group is one share.
    split = SPLIT if order > 2 else 1
    groups = min(GROUPS, max(2, 2 * chunks // split))
    shares, word_shares = groups * split, max(1, groups // 4)

    def count(table: pa.Table) -> pa.Table:
        """A chunk's distinct strings and words by share, with their training counts, and the group's counts of order 2."""
        number = table["chunk"][0].as_py()
        keys, n = _count(table["train"].to_pylist(), raw(table["text"]), order)
        trim()
        words = keys < 0
        strings, held = keys[~words].view(np.uint64), n[~words]
        low, low_n = _lower(strings[held > 0], held[held > 0], 2)
        blank = pack(np.zeros(0, np.uint64))
        lower: dict[int, tuple[bytes, bytes]] = {}
        if split > 1:
            of = share_of(low, groups, split) // split
            order_of = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[order_of], np.arange(groups + 1))
            for g in np.unique(of).tolist():
                own = order_of[cut[g] : cut[g + 1]]
                lower[g] = pack_keys(low[own]), pack(low_n[own])
        out: list[list] = [[] for _ in range(5)]
        for kind, own_keys, own_n, of, first, last in ((0, strings, held, share_of(strings, groups, split), 0, shares), (1, keys[words].view(np.uint64), n[words], None, shares, shares + word_shares)):
            of = (mix64(own_keys) % np.uint64(word_shares)).astype(np.int64) + shares if kind else of
            order_of = np.argsort(of.astype(np.uint16) if last <= 1 << 16 else of, kind="stable")
            cut = np.searchsorted(of[order_of], np.arange(first, last + 1))
            for share in range(first, last):
                own = order_of[cut[share - first] : cut[share - first + 1]]
                below = lower.get(share // split) if not kind else None
                # Each share of words hears from every chunk, and tells it how many it knows.
                if len(own) or below or kind:
                    for c, x in zip(out, (share, pack_keys(own_keys[own]), pack(own_n[own]), *(below or (blank, blank))), strict=True):
                        c.append(x)
        trim()
        return pa.table({"share": pa.array(out[0], pa.int32()), "chunk": pa.array([number] * len(out[0]), pa.int32()), **{name: pa.array(x, pa.binary()) for name, x in zip(("keys", "n", "low", "low_n"), out[1:], strict=True)}})

    def weigh(table: pa.Table) -> pa.Table:
        """Back to each chunk: the logarithms of its strings, or the counts of its words with this share's numbers of tokens and words."""
        share = table["share"][0].as_py()
        blocks = [unpack_keys(x) for x in table["keys"].to_pylist()]
        keys, n = summed(np.concatenate(blocks), np.concatenate([unpack(x, np.int64) for x in table["n"].to_pylist()]))
        if share >= shares:
            tokens, vocabulary, value = int(n.sum()), int((n > 0).sum()), n.astype(float)
        else:
            one = pairs.value
            known = n > 0
            tables = {order: (keys[known], n[known]), 1: one, 0: _lower(*one, 0)}
            for k in range(order - 1, 2 if split > 1 else 1, -1):
                tables[k] = _lower(*tables[k + 1], k)
            if split > 1:
                low = [np.concatenate([f(x) for x in table[c].to_pylist()]) for c, f in (("low", unpack_keys), ("low_n", lambda x: unpack(x, np.int64)))]
                tables[2] = summed(*low)
            tokens, vocabulary, value = 0, 0, log_probabilities(keys, tables, order)
        back = [i for i, b in enumerate(blocks) if len(b) or share >= shares]
        values = [pack(value[np.searchsorted(keys, blocks[i])]) for i in back]
        trim()
        some = pa.array(back, pa.int64())
        longs = lambda x: pa.array([x] * len(back), pa.int64())
        return pa.table({"chunk": table["chunk"].take(some), "keys": table["keys"].take(some), "values": pa.array(values, pa.binary()), "tokens": longs(tokens), "vocabulary": longs(vocabulary)})

    def score(own: pa.Table, known: pa.Table) -> pa.Table:
        texts, value = raw(own["text"]), np.concatenate([unpack(x, float) for x in known["values"].to_pylist()])
        table = HashTable(np.concatenate([unpack_keys(x) for x in known["keys"].to_pylist()]))
        tokens_seen, vocabulary = sum(known["tokens"].to_pylist()), sum(known["vocabulary"].to_pylist())

        def found_at(keys: np.ndarray) -> np.ndarray:
            at = table.find(keys)
            if len(at) and at.min() < 0:
                raise ValueError("a chunk's string came back without its value")
            return at

        rest = float(np.log10(tokens_seen + 0.1 * (vocabulary + 1)))
        total = np.zeros(len(texts))
        for code, first, starts in _strings(texts, order):
            got = np.concatenate([value[found_at(code)], [0.0]])
            part = np.where(np.diff(np.r_[starts, len(code)]) > 0, np.add.reduceat(got, starts), 0) if len(starts) else []
            total[first : first + len(part)] += part
        words = {END}
        for t in texts:
            words.update(t.lower().split())
        asked = np.fromiter(map(word_key, words), np.int64, len(words)).view(np.uint64)
        logs = dict(zip(words, np.log10(value[found_at(asked)] + 0.1).tolist(), strict=True))
        del words, asked
        tokens, found, base = [], [], []
        for t in texts:
            own_words = [*t.lower().split(), END]
            got = np.fromiter(map(logs.__getitem__, own_words), float, len(own_words))
            tokens.append(len(got))
            found.append(int((got > 0).sum()))  # one occurrence or more, plus 0.1, has a positive logarithm
            base.append(float(got.sum()) - len(got) * rest)
        del logs, table, texts
        trim()
        longs = lambda x: pa.array(x, pa.int64())
        return pa.table({"doc_id": own["doc_id"], "train": own["train"], "n_tokens": longs(tokens), "n_known": longs(found), "train_tokens": longs([int(tokens_seen)] * len(tokens)), "base_score": pa.array(base, pa.float64()), "score": pa.array(total, pa.float64())})

    # The exchange of the texts by chunk is one, which both passes read.
    sent = texts.groupBy("chunk").applyInArrow(count, "share int, chunk int, keys binary, n binary, low binary, low_n binary")
    back = sent.groupBy("share").applyInArrow(weigh, "chunk int, keys binary, values binary, tokens long, vocabulary long")
    schema = f"doc_id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, schema)


def held_out(id_col: str, parts: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == remainder


def op1_ppm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_documents(docs, ~held_out("doc_id", 10, 0))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
