"""Hand-made TSV, page ranges, crops by name, JSON artifacts, images, profiles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import crop_position
from ..functions.text import stripped
from ..profile import Profile


def _rows(spark: SparkSession, path: str, least: int = 4) -> DataFrame:
    """Fields of lines that are neither blank nor comments and have enough columns, with their order."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("ordinal"))
    kept = lines.where((stripped(F.col("value")) != "") & ~F.ltrim("value").startswith("#"))
    return kept.withColumn("f", F.split("value", "\t")).where(F.size("f") >= least)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """(page, band, entry, text, ordinal) as written by hand; nothing is merged."""
    f = lambda i: F.get("f", i)
    return _rows(spark, path).select(stripped(f(0)).cast("int").alias("page"), stripped(f(1)).alias("band"), stripped(f(2)).cast("int").alias("entry"), stripped(f(3)).alias("text"), "ordinal")


def read_gold(spark: SparkSession, path: str | list[str], bands: dict[str, int]) -> DataFrame:
    """(page, band_index, entry, text): rows of unknown bands are left out, the last of a key wins."""
    rows = read_observations(spark, path)
    index = F.try_element_at(F.create_map(*[F.lit(x) for p in bands.items() for x in p]), F.col("band"))
    known = rows.withColumn("band_index", index).where(F.col("band_index").isNotNull())
    return known.groupBy("page", "band_index", "entry").agg(F.max_by("text", "ordinal").alias("text"))


def parse_pages(spec: str) -> list[int]:
    """``2,3,10-20`` as distinct pages in order."""
    out: set[int] = set()
    for part in filter(None, (x.strip() for x in spec.split(","))):
        a, _, b = part.partition("-")
        out.update(range(int(a), int(b or a) + 1))
    return sorted(out)


def discover_crops(spark: SparkSession, root: str, context: str) -> DataFrame:
    """(path, page, band, entry) of crops by their files' names, in reading order; other names are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*_{context}.png").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.png$", 1)
    found = files.select("path", crop_position(name).alias("p")).where(F.col("p").isNotNull())
    return found.select("path", "p.*").orderBy("page", "band", "entry")


def read_images(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, checksum, content) of files; content is decoded where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("checksum"), "length", "content")


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """A JSON artifact, one document over many lines."""
    return spark.read.option("multiLine", True).json(path)


def load_profile(spark: SparkSession, path: str, document_id: str) -> Profile:
    """A profile file (JSON); without one, what the title says, which is also written down."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.exists(p):
        return Profile.from_dict(json.loads("\n".join(r[0] for r in spark.read.text(path).collect())))
    profile = Profile.from_title(document_id)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(profile.__dict__, ensure_ascii=False, indent=1).encode()))
    out.close()
    return profile
