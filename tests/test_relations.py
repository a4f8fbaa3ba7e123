"""Every relational query against its SQL twin in DuckDB, at the smallest size."""

import duckdb
import pytest

from stemloom.plans import catalogue
from stemloom.sources.alignments import cells_of
from stemloom.sources.files import read_fasta, read_msa

DIR = "/root/testdata/sf0.001"


def rows(names, values):
    key = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{float(v[i]) + 0:.4f}" if isinstance(v[i], float) or type(v[i]).__name__ == "Decimal" else str(v[i]) for i in key) for v in values)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("documents", "nation", "region"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_duckdb(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, DIR)
    found = oracle.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_without_sql(spark, name):
    df = catalogue.QUERIES[name](spark, DIR)
    found = df.collect()
    assert found and len({r[0] for r in found}) == 20


def test_readers(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text(">one\nacgt-\n\n>two x\nACG\nU-\n")
    assert [(r.seq, r.text) for r in read_msa(spark, str(p)).orderBy("seq").collect()] == [(0, "ACGU-"), (1, "ACG"), (2, "U-")]
    wrapped = read_fasta(spark, str(p)).orderBy("seq").collect()
    assert [(r.name, r.text) for r in wrapped] == [("one", "ACGT-"), ("two x", "ACGU-")]
    cells = cells_of(read_msa(spark, str(p))).where("seq = 0").orderBy("col").collect()
    assert [r.code for r in cells] == [0, 1, 2, 3, 5]
