"""Cuts found by review: each case fails where part of the job is left out."""

from trovex.plans import registry


def test_pairs_read_the_whole_table(spark, tmp_path):
    ids = (1, 3000, 3001, 900_000_000)
    rows = spark.range(len(ids)).selectExpr(
        f"element_at(array({', '.join(f'{i}L' for i in ids)}), cast(id + 1 as int)) as l_orderkey", "7L as l_partkey", "3L as l_suppkey", "cast(id + 1 as int) as l_linenumber",
        "30.0D as l_quantity", "1.0D as l_extendedprice", "'A' as l_returnflag", "timestamp_ntz'2020-01-01 00:00:00' as l_shipdate",
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert registry.queries()["patent_id"](spark, str(tmp_path)).count() == len(ids)
    assert registry.queries()["pair_stats"](spark, str(tmp_path)).first().n_rows == len(ids)


def test_no_valid_row_is_cut_by_its_number(spark):
    sf = "/root/testdata/sf0.001"
    for query, source in (("normalize_product", "part"), ("valid_url", "events")):
        assert registry.queries()[query](spark, sf).count() == spark.read.parquet(f"{sf}/{source}.parquet").count()
