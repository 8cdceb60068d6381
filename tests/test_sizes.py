"""Sizes as text, against printf of DuckDB and by hand."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from lodestack import catalog
from lodestack.functions.format import format_bytes
from tests.compare import rows


def test_ties_go_to_the_even_digit(spark):
    n = [*range(1024, 1 << 20, 256), 1025, 1 << 19, (1 << 20) - 1]
    got = {r["n"]: r["s"] for r in spark.createDataFrame([(x,) for x in n], "n long").select("n", format_bytes(F.col("n"), "KB").alias("s")).collect()}
    want = dict(duckdb.sql(f"SELECT unnest({n}) AS n, printf('%.1f KB', n / 1024.0::DOUBLE)").fetchall())
    assert got == want and got[1280] == "1.2 KB" and got[1792] == "1.8 KB"


def test_units(spark):
    rows_ = spark.createDataFrame([(1023,), (5 << 18,), (1 << 20,), (5 << 28,), (3 << 40,)], "n long")
    assert [r[0] for r in rows_.select(format_bytes(F.col("n"))).collect()] == ["1023 B", "1.2 MB", "1.0 MB", "1.2 GB", "3.0 TB"]
    assert [r[0] for r in rows_.select(format_bytes(F.col("n"), "KB")).collect()][1:3] == ["1280.0 KB", "1024.0 KB"]


def test_ls_sizes_of_ties_and_a_megabyte(spark, tmp_path):
    sizes = [1000, 1279, 1280, 2304, 3328, 1 << 20, 3 << 20]
    docs = spark.createDataFrame([(i, "x" * n, "en", "src4", n) for i, n in enumerate(sizes)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(catalog.QUERIES["ls_sizes"](spark, str(tmp_path)).toPandas()) == rows(con.sql(catalog.ORACLES["ls_sizes"]).df())
