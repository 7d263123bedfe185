"""Registered queries against their SQL on made-up tables at the edges where they differed from it."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry


def told(folder, name):
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.execute(entry.oracle_sql()[name])
    return [c[0] for c in got.description], sorted(got.fetchall(), key=repr)


def found(spark, folder, name, columns):
    return sorted((tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect()), key=repr)


@pytest.mark.parametrize("prices", [lambda cust, odd: 10.0, lambda cust, odd: 10.0 + cust * odd, lambda cust, odd: 10.0 - cust * odd, lambda cust, odd: 10.0 + odd * (-1) ** cust])
def test_signed_rank_of_one_sign_or_none(spark, tmp_path, prices):
    rows = [(2 * c + odd, c, "1-URGENT", prices(c, odd)) for c in range(1, 9) for odd in (0, 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    columns, want = told(tmp_path, "e7_signed_rank")
    assert found(spark, tmp_path, "e7_signed_rank", columns) == want


ORDERS = "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double"


@pytest.mark.parametrize(
    ("one", "two", "less"),
    [(499717.28, 224267.95, 485179.98), (424421.94, 287084.67, 40450.02), (166958.13, 170507.86, 44227.63), (248423.75, 108016.98, 344350.29)],
)
def test_signed_rank_rounds_doubles_and_not_their_decimals(spark, tmp_path, one, two, less):
    """A second customer's difference has the size that the first one's has in the SQL, and the other sign: they tie."""
    up = round((one + two) / 2 - less, 2)
    size = next(x for x in (abs(up), abs(up) + 0.01, abs(up) - 0.01) if abs(duckdb.execute("SELECT round(($1 + $2) / 2 - $3, 2)", [one, two, less]).fetchone()[0]) == round(x, 2))
    other = (0.0, round(size, 2)) if up > 0 else (round(size, 2), 0.0)
    rows = [(1, 1, "1-URGENT", one), (3, 1, "1-URGENT", two), (2, 1, "1-URGENT", less), (5, 2, "1-URGENT", other[0]), (4, 2, "1-URGENT", other[1])]
    spark.createDataFrame(rows, ORDERS).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    columns, want = told(tmp_path, "e7_signed_rank")
    assert want[0][:2] == (2, 1.5)
    assert found(spark, tmp_path, "e7_signed_rank", columns) == want


def test_signed_rank_of_a_table_in_pieces(spark, tmp_path):
    """Runs of a customer lie in several files: their sum is that of the table in one."""
    whole, pieces = tmp_path / "whole", tmp_path / "pieces"
    prices = "(100000 + pmod(xxhash64(id), 2000)) / 100D AS o_totalprice"  # close to each other: a cent moves a rank
    df = spark.range(20_000).filter("id % 10 IN (0, 1, 3, 5, 7)").selectExpr("id AS o_orderkey", "id div 10 AS o_custkey", "'1-URGENT' AS o_orderpriority", prices)
    df.coalesce(1).write.parquet(str(whole / "orders.parquet"))
    for k in range(4):
        df.filter(f"o_orderkey % 10 div 2 = {k}").coalesce(1).write.mode("append").parquet(str(pieces / "orders.parquet"))
    columns, want = told(whole, "e7_signed_rank")
    assert found(spark, pieces, "e7_signed_rank", columns) == want


def test_audited_files_hold_header_and_rows(spark, tmp_path):
    """Also where the shuffles of rows and headers are merged into other runs of partitions."""
    rows = spark.range(40_000).selectExpr("id % 16 * 3 AS l_suppkey", "id AS l_orderkey", "cast(id % 7 AS int) AS l_linenumber", "cast(id % 50 AS double) AS l_quantity")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    columns, want = told(tmp_path, "q1_file_audit")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for name, x in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64kb"), ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64kb")):
        spark.conf.set(name, x)
    try:
        assert found(spark, tmp_path, "q1_file_audit", columns) == want
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")


def test_replay_writes_what_a_stage_and_the_last_version_found(spark, tmp_path):
    """Both have a matched class, or the share of it, under a name of its own."""
    rng = np.random.default_rng(3)
    rows = [(k, k % 2, [float(x) + (k % 4 == 3) * 6 for x in rng.normal(0, 0.3, 4)]) for k in range(240)]  # label 1 in two places
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    entry.queries()["r7_replay"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    (got,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (got["config"], got["discovered"], got["matched"], got["n"]) == ("c1", True, "c1", 24)
    assert got["matched_rate"] == got["known"] > 0
