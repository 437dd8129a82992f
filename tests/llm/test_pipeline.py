"""The pipeline's stages on a small corpus, each against its plain version, and the registered queries."""

import brute
import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.llm import queries
from tools.check import norm

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.collect()
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, spark.createDataFrame(before, docs.schema), SF)
        after = out.collect()
        old, new = {r["doc_id"]: r for r in before}, {r["doc_id"]: r for r in after}
        assert set(new) <= set(old) and (i == 4 or out.columns == names)
        if i == 0:
            for d, r in old.items():
                n, _, _, _, repeated = brute.measures(r["text"])
                if n < 10 or 100 * repeated > 20 * n:
                    assert d not in new
        elif i == 1:
            cuts = brute.cut_lines([(d, r["text"]) for d, r in old.items()])
            for d, r in old.items():
                cut = cuts.get((d, r["text"]), set())
                text = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in cut) if cut else r["text"]
                assert (d in new) == bool(not cut or brute.SPACED.search(text))
                if d in new:
                    assert new[d]["text"] == text and new[d]["n_chars"] == (len(text) if cut else r["n_chars"])
        elif i == 2:
            want = brute.near([(d, r["text"]) for d, r in old.items()])
            assert set(new) == {d for d, (_, comp) in want.items() if d == comp}
        elif i == 3:
            assert set(new) == {d for d, r in old.items() if not brute.benchmark_hits(r["text"], bench)[4]}
        else:
            sizes, taken = {}, {}
            for d, r in old.items():
                n = len(brute.SPACED.findall(r["text"] or ""))
                sizes[r["source"]] = sizes.get(r["source"], 0) + n
                if d in new:
                    assert new[d]["size"] == n and 1 <= new[d]["copies"] <= 3 and new[d]["taken"] == n * new[d]["copies"]
                    taken[r["source"]] = taken.get(r["source"], 0) + new[d]["taken"]
            want = brute.targets(sizes)
            assert sum(abs(taken.get(s, 0) - t) for s, t in want.items()) < 0.1 * sum(want.values())
        before = after if i == 4 else [r for r in after]


def test_stages_take_awkward_and_empty_documents(spark, awkward, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, SF)
        assert set(awkward.columns) <= set(out.columns) and out.count() > 0, name
        assert stage(spark, empty, SF).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.all_queries()[1]))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(map(norm, r)) for r in cur.fetchall()]
    got = [tuple(norm(r[k]) for k in cols) for r in df.collect()]
    assert brute.copies_of(got) == brute.copies_of(want)
