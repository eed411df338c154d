"""Tables of the store: schemas, reading, atomic replacement, and written intermediate results."""

from __future__ import annotations

import contextlib
import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
#: Columns by table. A name with a question mark may be null.
TABLES = {
    "documents": "id string, title string, source_path string, checksum string, page_count int, created_at timestamp",
    "processing_runs": "id string, document_id string, stage string, params map<string,string>, params_hash string, input_checksum string, compute_backend string, pipeline_version string, git_commit string, started_at timestamp, finished_at timestamp, status string",
    "pages": "document_id string, page_index int, width int, height int, x_ppi double, y_ppi double, colorspace string, encoding string, ignored boolean",
    "page_assets": "document_id string, page_index int, role string, path string, checksum string, run_id string, created_at timestamp",
    "transforms": "id string, document_id string, page_index int, kind string, forward array<array<double>>, inverse array<array<double>>, residual double, status string, run_id string, seq long",
    "page_layouts": f"id string, document_id string, page_index int, run_id string, layout_family string, frame {BOX}, template_fit double, is_outlier boolean",
    "bands": f"id string, page_layout_id string, band_index int, label string, bbox {BOX}",
    "physical_entries": f"id string, band_id string, entry_index int, bbox {BOX}",
    "regions": f"region_uid string, document_id string, page_index int, bbox {BOX}, geometry_hash string, transform_id string, orig_quad array<array<double>>, band_label string, band_ordinal int, reading_order int, reading_order_locked boolean, entry_index int, role string, state string, created_by string, origin_run_id string, last_run_id string, updated_by string, created_at timestamp, updated_at timestamp, deleted_at timestamp, id long",
    "region_lineage": "id long, child_uid string, parent_uid string, op string, run_id string, actor string, at timestamp, detail string",
    "region_crops": f"id long, region_id long, crop_key string, geometry_hash string, context string, pad_frac double, variant string, pixel_bbox {BOX}, path string, checksum string, created_at timestamp",
    "region_proposals": f"id long, run_id string, document_id string, page_index int, band_label string, region_id long, bbox {BOX}, geometry_hash string, entry_index int, kind string, iou double, status string",
    "source_regions": f"id string, entry_id string, document_id string, page_index int, role string, context string, bbox {BOX}, normalized_bbox {BOX}, transform_id string, crop_id string, crop_path string, region_id long",
    "models": "id string, name string, version string, backend string",
    "ocr_runs": "id string, run_id string, model_id string, input_variant string, tag string",
    "ocr_candidates": "id long, region_id long, source_region_id string, ocr_run_id string, crop_key string, model_key string, cache_key string, transcription string, confidence double, raw string, created_at timestamp",
    "ocr_characters": f"id long, candidate_id long, char_index int, character string, confidence double, bbox {BOX}",
    "human_corrections": "document_id string, page_index int, band_label string, entry_index int, role string, transcription string, unreadable boolean, corrected_by string, corrected_at timestamp, note string",
    "validation_findings": "id long, run_id string, document_id string, band_label string, kind string, page_index int, entry_index int, expected string, observed string, status string",
    "parsed_entries": "id long, document_id string, region_uid string, page_index int, band_label string, entry_index int, source string, text string, own_id string, own_value long, parent_id string, parent_value long, parent_name string, birth_order string, order_rank int, leftover string, flags map<string,string>",
    "persons": "id long, document_id string, person_key string, generation string, own_id string, own_value long, parsed_entry_id long, father_person_id long, father_key string, father_name string, birth_order string, order_rank int, link_status string",
}
VERSION = 6


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``.

    Where that is unset, a session whose executors are this very process gets a local folder; on a
    cluster no folder of one machine will do, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet into the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Busy(RuntimeError):
    """Another job holds the document."""


class Store:
    """A folder of Parquet tables, each replaced as a whole: a new version is written, then named as the current one.

    Versions are numbered by files ``CURRENT-<number>``, of which the highest counts. Each is put
    under its name by one rename, and none is taken away before: a reader, or a writer that stops
    half-way, always leaves the rows that were there. Of two writers at once the second fails.
    Readers hold the version they opened; writers of one document replace its partition's rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Store:
        """A new store, marked with this version; one that is there already is opened."""
        store = cls(spark, path)
        marker, fs = store._hadoop(f"{store.path}/STORE")
        if not fs.exists(marker):
            part, _ = store._hadoop(f"{store.path}/.STORE-{uuid.uuid4().hex}")
            out = fs.create(part, True)
            out.write(bytearray(str(VERSION).encode()))
            out.close()
            fs.rename(part, marker)
        return cls.discover(spark, path)

    @classmethod
    def discover(cls, spark: SparkSession, path: str) -> Store:
        """The store whose marker lies in a folder or the nearest above it; a later version's, or none, is an error."""
        at = path.rstrip("/")
        while True:
            store = cls(spark, at)
            marker, fs = store._hadoop(f"{at}/STORE")
            if fs.exists(marker):
                version = int(spark.read.text(f"{at}/STORE").first()[0])
                if version > VERSION:
                    raise ValueError(f"{at} is of version {version}, this program of {VERSION}")
                return store
            above = marker.getParent().getParent()
            if above is None:
                raise FileNotFoundError(f"no store in {path} or above")
            at = above.toString().rstrip("/")

    @contextlib.contextmanager
    def job(self, document_id: str):
        """Holds a document for one job; ``Busy`` at once if another does. The holder's name is a file that only one can create."""
        lock, fs = self._hadoop(f"{self.path}/locks/{hashlib.sha256(document_id.encode()).hexdigest()[:32]}")
        fs.mkdirs(lock.getParent())
        try:
            held = fs.createNewFile(lock)
        except Exception as e:  # a file system that says so by an exception
            raise Busy(f"{document_id} is held by another job") from e
        if not held:
            raise Busy(f"{document_id} is held by another job")
        try:
            yield self
        finally:
            fs.delete(lock, False)

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self, table: str) -> list[tuple[int, str]]:
        folder, fs = self._hadoop(f"{self.path}/{table}")
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"CURRENT-(\d+)", n)))

    def _version(self, table: str) -> str | None:
        found = self._pointers(table)
        return self.spark.read.text(f"{self.path}/{table}/{found[-1][1]}").first()[0] if found else None

    def read(self, table: str) -> DataFrame:
        """The current rows; none yet gives an empty table of the schema. Columns of older versions are filled with null."""
        version = self._version(table)
        empty = self.spark.createDataFrame([], TABLES[table])
        if version is None:
            return empty
        return empty.unionByName(self.spark.read.parquet(f"{self.path}/{table}/{version}"), allowMissingColumns=True)

    def replace(self, table: str, rows: DataFrame) -> None:
        version, found = uuid.uuid4().hex, self._pointers(table)
        rows.select(*self.spark.createDataFrame([], TABLES[table]).columns).write.parquet(f"{self.path}/{table}/{version}")
        self._name(table, version, found[-1][0] + 1 if found else 1)

    def _name(self, table: str, version: str, number: int) -> None:
        """Makes a written version the current one."""
        part, fs = self._hadoop(f"{self.path}/{table}/.{version}")
        to, _ = self._hadoop(f"{self.path}/{table}/CURRENT-{number:09d}")
        out = fs.create(part, True)
        out.write(bytearray(version.encode()))
        out.close()
        if fs.exists(to) or not fs.rename(part, to):
            raise RuntimeError(f"another writer replaced {table} at the same time")
        for _, name in self._pointers(table)[:-2]:  # the one before stays for readers that have just listed it
            fs.delete(self._hadoop(f"{self.path}/{table}/{name}")[0], False)

    def replace_document(self, table: str, rows: DataFrame, document_id: str) -> None:
        """One document's rows are these from now on."""
        kept = self.read(table).where(~F.col("document_id").eqNullSafe(document_id))
        self.replace(table, kept.unionByName(rows.select(*kept.columns)))
