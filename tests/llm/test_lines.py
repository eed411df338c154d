import duckdb
import pandas as pd
from pyspark.sql import functions as F

from strandline.llm.line_dedup import OP9_SQL, dedup_lines

LINES = ["A common line here", "  a COMMON line here\t", "short", "Ünïcödé line É", "ünïcödé line é", "ten chars.", "nine char", "\x0bpadded line \x0c", "padded line"]


def rows():
    out = [(i, "\n".join(LINES[(i + k) % len(LINES)] for k in range(i % 5))) for i in range(1, 40)]
    return [*out, (50, None), (51, ""), (52, "\n\n"), (53, LINES[0] + "\r"), (54, "only here twice\nonly here twice"), (55, "x" * 50_000 + "\n" + LINES[0])]


def test_against_sql(spark, docs):
    got = dedup_lines(docs(rows())).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows(), columns=["doc_id", "text"]))
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(OP9_SQL).fetchall())


def plain(rows, least=10, shared=2):
    import re

    key = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(held.get(key(x), ())) < shared or i == min(held[key(x)])]
        out.append((i, t if t is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(map(repr, out))


def test_odd_rows(spark, docs, odd_rows):
    every = [*odd_rows, *rows()]
    for least, shared in ((10, 2), (3, 3)):
        got = dedup_lines(docs(every), min_chars=least, min_docs=shared).select("doc_id", "text", "n_lines", "n_dropped")
        assert sorted(repr(tuple(r)) for r in got.collect()) == plain(every, least, shared)
    assert dedup_lines(docs([])).count() == 0
    kept = dedup_lines(docs(every)).columns
    assert kept[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "_drops" in kept
