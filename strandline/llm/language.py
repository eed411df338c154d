"""Language identification by compression: the language whose dictionary codes a text in fewest bytes.

For each language a zstandard raw-content dictionary is cut from a bounded sample of labelled
documents. A text is coded in blocks, each by every dictionary, so that the whole text counts and a
long one can't lean on itself; sizes are summed. Where the best is hardly smaller than the next, the
text is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .ppm import held_out

#: The bounded sample, all of which makes the dictionary: documents of a language, and bytes of each.
SAMPLE, SNIPPET = 224, 512
#: Languages whose dictionaries a task holds ready at once; more are tried group by group.
GROUP = 256
#: Bytes of a block, level of zstandard, and the least share of the next best size to be won.
BLOCK, LEVEL, MARGIN = 2048, 6, 0.005
UNKNOWN = "und"
#: ASCII but for letters becomes space: marks and figures tell no language.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))

#: A word character that is no digit or underscore: letters, and numerals such as fractions, which has_letter() tells apart.
_letter = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _letter.finditer(text))


def normal(text: str) -> bytes:
    """Lower-cased words, each between spaces, so that a first or last word matches as a whole too."""
    return b" ".join([b"", *text.lower().encode().translate(_LETTERS).split(), b""])


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, those with more training documents first: ties go to them."""

    dictionaries: tuple[tuple[str, bytes], ...]


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, snippet: int = SNIPPET, languages: int | None = None) -> Model:
    """Dictionaries from the ``sample`` documents of each language whose ids hash lowest, among rows where ``train`` holds.

    All labelled languages are learned, or the ``languages`` with most rows. Only ``sample * snippet``
    characters of each reach the driver, whatever the table's size, and all of them are used. Rows
    whose id, text or language is null teach nothing. Without labelled rows the model is empty.
    """
    rows = docs.where(train & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    named = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    counted = named.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    counts = {r["lang"]: r["count"] for r in (counted if languages is None else counted.limit(languages)).collect()}
    order = sorted(counts, key=lambda x: (-counts[x], x))
    if not order:
        return Model(())
    # Below a threshold that counts set, some four samples' worth of hashes lie, so no task gathers a language.
    spark = docs.sparkSession
    below = spark.createDataFrame(pa.table({"lang": list(counts), "below": [min(1 << 32, (4 * sample << 32) // n) for n in counts.values()]}))
    hashed = named.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 32)))
    found = hashed.join(below, "lang").where(F.col("h") < F.col("below")).select("id", "lang", "h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = found.withColumn("place", place).where(F.col("place") <= sample).select("id", "lang").collect()
    if not chosen:
        return Model(())
    pairs = spark.createDataFrame(pa.table({"lang": [r["lang"] for r in chosen], "id": [r["id"] for r in chosen]}))
    cut = F.substring(F.col(text_col), 1, snippet)
    read = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), cut.alias("text"))
    texts = read.join(pairs, ["lang", "id"], "left_semi").groupBy("lang", "id").agg(F.min("text").alias("text")).collect()
    content: dict[str, bytes] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], str(r["id"]))):
        content[r["lang"]] = content.get(r["lang"], b"") + normal(r["text"])
    return Model(tuple((x, content[x]) for x in order if x in content))


def predict(docs: DataFrame, model: Model, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and accepted appended.

    score is the share of the second smallest size that the smallest saves, 0 to 1; accepted says
    that it reaches ``margin``, whatever the text's length. A null text, one without a letter, or an
    empty model gives ``und``, 0 and false. With one language, score is 1. Equal sizes go to the
    language of more training documents. Repeated rows are alike; columns of docs that are named as
    the new ones are replaced.
    """
    new = ("lang_pred", "score", "accepted")
    own = docs.select(*[c for c in docs.columns if c not in new])
    schema = StructType([*own.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])
    at = own.columns.index(text_col)
    names = [x for x, _ in model.dictionaries]

    groups = [model.dictionaries[i : i + GROUP] for i in range(0, len(names), GROUP)]

    def coders(group: tuple[tuple[str, bytes], ...]) -> list:
        out = []
        for _, content in group:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = coders(groups[0]) if len(groups) == 1 else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            seen: list = [None] * len(texts)  # smallest size, its place, the next size
            for g, group in enumerate(groups):
                use = ready or coders(group)
                for i, text in enumerate(texts):
                    if text is None or not has_letter(text):
                        continue
                    text = normal(text)
                    blocks = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
                    sizes = [sum(map(len, map(c, blocks))) for c in use]
                    best = int(np.argmin(sizes))
                    rest = min(sizes[:best] + sizes[best + 1 :], default=math.inf)
                    size, place, after = seen[i] or (math.inf, 0, math.inf)
                    if sizes[best] < size:
                        seen[i] = (sizes[best], g * GROUP + best, min(size, rest))
                    else:
                        seen[i] = (size, place, min(after, sizes[best]))
            langs = [UNKNOWN if x is None else names[x[1]] for x in seen]
            scores = [0.0 if x is None else 1.0 - x[0] / x[2] for x in seen]
            cols = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([x != UNKNOWN and s >= margin for x, s in zip(langs, scores, strict=True)])]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *new])

    return own.mapInArrow(run, schema)


def op5_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out("doc_id", 4, 2)
    model = fit(docs, ~out)
    rows = docs.select("doc_id", out.alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
