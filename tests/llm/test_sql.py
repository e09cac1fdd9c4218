"""Queries of the subpackage give the rows of their SQL; every one of them runs over the smallest tables."""

import os

import duckdb
import pytest

from deltaloom.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(str(row[c]) for c in columns) for row in df.collect())
    if name not in ("op5_licenses", "op6_decontaminate", "op2_embeddings", "op11_collocations", "op12_conversations"):
        assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if name in catalog.ORACLE_SQL:
        con = duckdb.connect()
        for table in os.listdir(sf_dir):
            con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{sf_dir}/{table}'")
        result = con.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(str(row[names.index(c)]) for c in columns) for row in result.fetchall())
