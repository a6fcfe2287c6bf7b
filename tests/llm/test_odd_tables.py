"""Every query and the pipeline over empty tables, and over nulls, repeats and clashing names."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm.queries import oracle_sql, queries

CLASHES = ["size", "score", "row", "n", "word", "label", "digest", "id", "s", "h", "copies", "found", "_found", "bits", "taken", "_mix_s_", "lang_pred", "text_", "part", "u", "t", "base", "rest", "doc_ID2", "_id", "_keep", "keep", "again", "times", "_n", "_mix_s", "_mix_cut", "mix_source", "mix_copies", "rate", "value", "_rate", "score_evidence", "score_passages", "left", "about"]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Two folders of tables: empty, and strange."""
    out = {}
    for kind in ("empty", "strange"):
        d = tmp_path_factory.mktemp(kind)
        for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
            t = spark.read.parquet(f"{sf}/{name}.parquet")
            if kind == "empty":
                t = t.limit(0)
            else:
                nulls = t.limit(4)
                for c in t.columns:
                    nulls = nulls.unionByName(t.limit(2).withColumn(c, F.lit(None).cast(t.schema[c].dataType)))
                if name == "documents":
                    key = F.col("doc_id") + 50_000
                    nulls = nulls.unionByName(t.limit(1).withColumn("text", F.lit("")).withColumn("doc_id", key)).unionByName(t.limit(1).withColumn("text", F.repeat(F.lit("ab1@ x.y "), 20_000)).withColumn("doc_id", key + 1))
                t = t.unionByName(nulls)
                t = t.withColumns({c: F.lit("clash") for c in CLASHES if c not in t.columns}) if name == "documents" else t
            t.write.parquet(f"{d}/{name}.parquet")
        out[kind] = str(d)
    return out


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty(spark, odd, name):
    assert queries()[name](spark, odd["empty"]).count() == 0


#: Queries whose result has not a row for each row of a table; the next test has their values.
SEARCHES = ("op12_hard_negatives", "op13_lexical_search")


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SEARCHES)))
def test_strange(spark, odd, name):
    table = "pages" if name.startswith("op8_") else "documents"
    docs = spark.read.parquet(f"{odd['strange']}/{table}.parquet")
    want = docs.filter("doc_id is not null").count() if name.startswith("op4_") else docs.count()
    assert queries()[name](spark, odd["strange"]).count() == want


@pytest.mark.parametrize("name", ["op11_license_templates", *SEARCHES])
def test_strange_values(spark, odd, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd['strange']}/{t}.parquet/*.parquet')")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, queries()[name](spark, odd["strange"]).select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("kind", ["empty", "strange"])
def test_pipeline(spark, odd, kind):
    out = corpus_pipeline.run(spark, odd[kind])
    assert (out.count() == 0) == (kind == "empty")
    assert set(spark.read.parquet(f"{odd[kind]}/documents.parquet").columns) <= set(out.columns)
