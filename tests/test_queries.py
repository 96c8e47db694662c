"""Every registered table and package query against its SQL, on the smallest supplied tables."""

import os

import duckdb
import pandas as pd
import pytest

from lucerna.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS FROM '{SF}/{t}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([None if pd.isna(x) else str(x) for x in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, tables, name):
    got = registry.QUERIES[name](spark, SF)
    want = tables.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLE.keys()


def test_page_meta_reads_whole_pages(spark, tmp_path):
    """A long style before the title and the character set does not hide them."""
    page = f'<html lang="fr"><head><style>{"p{} " * 5000}</style><meta charset="utf-8"><title>Late</title></head></html>'
    spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["page_meta_extract"](spark, str(tmp_path)).first()
    assert (got["title"], got["lang"], got["charset"]) == ("Late", "fr", "utf-8")


def test_base64_of_a_text_near_the_limit_is_not_lengthened_by_line_breaks(spark, tmp_path):
    """16,500 bytes are at the limit; the line breaks of their base64 are not counted."""
    spark.createDataFrame([(1, "x" * 16_500), (2, "x" * 16_501)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["base64_round_trip"](spark, str(tmp_path)).collect()
    want = duckdb.sql(registry.ORACLE["base64_round_trip"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r["doc_id"]: r["fits"] for r in got} == {1: True, 2: False}
