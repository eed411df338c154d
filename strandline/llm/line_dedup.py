"""Line dedup: explode normalised lines, hash them, find those of several documents, drop, reassemble.

DataFrame functions alone are used. Keys travel as 128 bits of hash; the smallest and largest
document of a key are found with partial sums before the shuffle, so a line that a third of all
documents hold arrives as one row per task; the join that finds its places splits them. The drops of
a document come back as positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, lower_ascii, written

MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends; letters are lower-cased before."""
    return F.btrim(line, F.lit(SPACE))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs``, the text reassembled from the lines that stay, with n_lines and n_dropped appended.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses its lines but
    those in the smallest id that holds it. A null text counts as one empty line and stays null;
    rows with a null id are kept whole and take no part. Rows that repeat an id are one document:
    equal rows are treated alike, and a key in the smallest id stays in all its rows. An empty table
    gives no rows. Columns named n_lines or n_dropped are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_row"), lower_ascii(text).alias("_low")).where(F.col(id_col).isNotNull())
    lines = part.select("_id", "_row", F.posexplode(F.split("_low", "\n", -1)).alias("_pos", "_line")).select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key")).where(F.char_length("_key") >= min_chars)
    lines = lines.select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    # With two documents, a smallest id below the largest says all; more need the distinct pairs.
    if min_docs <= 2:
        keys = lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
        keys = keys.where(F.col("_first") < F.col("_last")) if min_docs == 2 else keys
    else:
        keys = lines.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_n")).groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.sum("_n").alias("_n")).where(F.col("_n") >= min_docs)
    # Written, so that the join's sides are shuffles alone, of which Spark can split a common line's.
    keys = written(keys.select("_h1", "_h2", "_first"), "lines")
    drops = lines.join(keys, ["_h1", "_h2"]).where(F.col("_id") > F.col("_first"))
    # Equal rows bring equal positions; a set of positions serves them all.
    drops = drops.groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_drops"))

    # The rows travel as one column each, so no name of theirs meets those used here.
    own = docs.select(F.struct(*docs.columns).alias("_own"), F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_text"))
    both = own.join(drops, (own["_doc"] == drops["_id"]) & (own["_text"] == drops["_row"]), "left")
    gone, shown = drops["_drops"], own["_own"][text_col]
    parts = F.split(shown, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    kept = F.when(gone.isNull(), shown).otherwise(F.concat_ws("\n", F.transform(stay, lambda i: F.get(parts, i))))
    new = {"n_lines": F.when(shown.isNull(), 1).otherwise(F.size(parts)).cast("long"), "n_dropped": F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long")}
    return both.select(*[(kept if c == text_col else own["_own"][c]).alias(c) for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > s.first, false) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
