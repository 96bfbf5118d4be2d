"""Reference-shaped inputs derived from the generic tables; the SQL serves both engines but for the name of the string type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trovex.operators.retrieval import passage_matches

PRODUCTS = """select p_partkey as ord, concat('P', cast(p_partkey % 1900 as STR)) as product_id,
 case when p_partkey % 97 = 0 then '  ' else p_name end as title, p_brand as brand, p_size as size, p_type as ptype,
 concat('src', cast(p_size % 5 as STR), '.jsonl.gz') as source_file,
 concat(p_name, case
  when p_partkey % 3 = 0 then concat(' Covered by U.S. Pat. No. ', cast(7000000 + p_partkey as STR), 'B2 and D', cast(600000 + p_partkey as STR), ' .')
  when p_partkey % 3 = 1 then concat(' made with patent pending design ', cast(p_size as STR)) else '' end) as features
 from part"""
PAIRS = """select HASH60(concat_ws('|', cast(l_orderkey as STR), cast(l_linenumber as STR), cast(l_partkey as STR), cast(l_suppkey as STR), cast(cast(floor(l_quantity) as bigint) as STR), cast(cast(floor(l_extendedprice * 100) as bigint) as STR))) as ord,
 concat('P', cast(l_partkey as STR)) as product_id,
 case when l_orderkey % 41 = 0 then '' else concat(case when l_suppkey % 9 = 0 then 'D' else '' end, cast(7000000 + l_orderkey % 500 as STR)) end as patent_number,
 case l_suppkey % 5 when 0 then 'EP' when 1 then 'CN' when 2 then '' else 'US' end as country_code,
 case l_linenumber % 3 when 0 then 'B2' when 1 then 'A1' else '' end as kind_code,
 case when l_orderkey % 13 = 0 then '' else concat('title ', cast(l_orderkey % 500 as STR)) end as patent_title,
 case l_returnflag when 'A' then 'Active' when 'R' then 'Inactive' else 'Expired' end as legal_status,
 l_quantity > 10 as has_abstract, l_quantity > 25 as has_images
 from lineitem"""
CLAIMS = """select conv_id, turn * 2 as ord, cast(floor(turn / 2.0) as int) as claim_number, text from conversations
 union all select conv_id, turn * 2 + 1 as ord, cast(floor(turn / 2.0) as int) as claim_number, substring(text, 1, 40) as text
 from conversations where turn % 2 = 0"""
MANIFEST = """select event_id as ord, concat('http://x/', cast(user_id as STR), '/', cast(event_id % 7 as STR)) as url,
 event_type <> 'error' as downloaded, case event_id % 3 when 0 then 'product_image' when 1 then 'product_video' else 'patent_image' end as type,
 concat('P', cast(user_id as STR)) as product_id from events"""
QRELS = "select b.item_id as query_id, d.doc_id from documents d join benchmark b on contains(d.text, b.text)"

VIEWS = {"fx_products": (PRODUCTS, ("part",)), "fx_pairs": (PAIRS, ("lineitem",)), "fx_claims": (CLAIMS, ("conversations",)), "fx_manifest": (MANIFEST, ("events",)), "fx_qrels": (QRELS, ("documents", "benchmark"))}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generic table or a view above it."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "fx_qrels":
        return passage_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return run_sql(spark, sf_dir, VIEWS[name][0])


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL over the tables and views it names; nothing stays registered."""
    import re

    sql = re.sub(r"HASH60\((.*)\) as ord", r"cast(conv(substring(md5(\1), 1, 15), 16, 10) as bigint) as ord", sql).replace("STR", "string")
    used = [n for n in (*TABLES, *VIEWS) if re.search(rf"\b{n}\b", sql)]
    for n in used:
        sql = re.sub(rf"(?<=\bfrom ){n}\b|(?<=\bjoin ){n}\b|(?<=, ){n}(?= [a-z]\b)", f"{{{n}}}", sql)
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in used if f"{{{n}}}" in sql})


def duck(sql: str) -> str:
    """The SQL for DuckDB, its views as common table expressions."""
    import re

    own = lambda x: re.sub(r"HASH60\((.*)\) as ord", r"cast('0x' || substring(md5(\1), 1, 15) as bigint) as ord", x).replace("STR", "varchar")
    sql = own(sql).strip()
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = ", ".join(f"{n} as ({own(VIEWS[n][0])})" for n in names)
    if not names:
        return sql
    return f"with {heads}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {heads} {sql}"
