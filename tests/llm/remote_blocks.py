"""Run by test_remote_blocks.py: operators on executors that fetch each other's blocks, so that rows of a group come in any order."""

import sys

from invented_prose import prose
from pyspark.sql import SparkSession
from test_near_dup import exact
from test_packing import check
from test_ppm import Plain
from test_repeats import plain, result
from test_shards import digest

from strandline.llm import near_dup, packing, ppm, shards
from strandline.llm.tokens import encoder

spark = (
    SparkSession.builder.master("local-cluster[3,1,1200]").config("spark.executor.memory", "900m").config("spark.sql.shuffle.partitions", "6")
    .config("spark.shuffle.readHostLocalDisk", "false").config("spark.reducer.maxSizeInFlight", "64k").config("spark.reducer.maxReqsInFlight", "2")
    .config("spark.checkpoint.dir", sys.argv[1]).config("spark.ui.enabled", "false").config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
passages = [prose(700 + i, 60) for i in range(20)]
rows = [(i, f"{prose(5000 + i, 20 + i % 50)} {passages[i % 20] if i % 3 else ''} {prose(9000 + i, i % 40)}") for i in range(420)]
rows += [(1000 + i, rows[i * 7][1]) for i in range(40)] + [(2000 + i, rows[i * 9][1] + " changed") for i in range(40)]
docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12, "doc_id")
assert result(docs, 50, 15_000) == plain(rows, 50), "repeats"
near_dup.CHUNK = 40_000
got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.find_near_duplicates(docs).collect())
assert got == sorted(exact(rows, 5)), "near duplicates"

learnt = [t.encode() for i, t in rows if i % 3]
model = Plain(learnt, 4)
scored = {r["doc_id"]: r["score"] for r in ppm.score_documents(docs, docs["doc_id"] % 3 != 0, order=4, chunk_bytes=20_000).collect()}
assert all(abs(scored[i] / model.score(t.encode()) - 1) < 1e-12 for i, t in rows), "scores"

ids = {i: x + b"\0" * 4 for (i, _), x in zip(rows, encoder("byte_bpe_50k.json").many([t for _, t in rows]), strict=True)}
check([tuple(r) for r in packing.pack_documents(docs).collect()], ids, 1024)

shards.SHARD, shards.BUCKET = 30_000, 200
docs.write.parquet(f"{sys.argv[1]}/tables/documents.parquet")
assert sorted(repr(tuple(r)) for r in shards.op3_mph_shards(spark, f"{sys.argv[1]}/tables").collect()) == digest(rows), "shards"
print("all the same")
