"""Queries over the generic tables, one for each operator, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.functions import citations as C
from trovex.functions import text as X
from trovex.operators import assets as A
from trovex.operators import claims as K
from trovex.operators import corpus as U
from trovex.operators import enrich as E
from trovex.operators import masking as M
from trovex.operators import merge as G
from trovex.operators import pages as P
from trovex.operators import retrieval as R
from trovex.operators.order import first_wins, last_wins, spread
from trovex.operators.records import normalize_products
from trovex.plans.fixtures import duck, table
from trovex.plans.scratch import round_trip
from trovex.sources import readers as SR
from trovex.streaming.manifest import latest_entries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (t -> DataFrame, where t(name) is a table) with its SQL for DuckDB."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


# --- ingest -----------------------------------------------------------------------------------------------------------


@query("select product_id as parent_asin, coalesce(trim(arg_min(title, ord)), '') as title, 'Brand=' || arg_min(brand, ord) as details, arg_min(features, ord) as description from fx_products where size % 3 <> 0 group by product_id")
def convert_catalog(t):
    catalog = t("fx_products").select("ord", "product_id", F.when(F.col("size") % 3 != 0, "us").otherwise("es").alias("product_locale"), F.col("title").alias("product_title"), F.col("features").alias("product_description"), F.col("brand").alias("product_brand"))
    rows = SR.convert_catalog(catalog)
    return rows.select("parent_asin", "title", F.concat(F.lit("Brand="), F.col("details")["Brand"]).alias("details"), F.get("description", F.lit(0)).alias("description"))


@query("""select case when ord % 5 = 0 then 'A' || ord::varchar else product_id end as product_id, title, brand as d_brand, size::varchar as d_size, case when ord % 2 = 0 then 'red' end as d_color
 from fx_products""")
def normalize_product(t):
    p = t("fx_products")
    own = F.when(F.col("ord") % 5 != 0, F.concat(F.lit('"'), "product_id", F.lit('"')))
    part = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    details = F.when(F.col("ord") % 2 == 0, part("details", F.lit('{"color":"red","brand":"old"}')))
    value = F.concat(F.lit("{"), F.concat_ws(",", part("product_id", own), part("asin", F.concat(F.lit('"A'), F.col("ord").cast("string"), F.lit('"'))), part("title", text(F.col("title"))), part("brand", text(F.col("brand"))), part("size", F.col("size").cast("string")), details), F.lit("}"))
    rows = normalize_products(p.select(value.alias("value")))
    return rows.select("product_id", "title", *[F.col("details")[k].alias(f"d_{k}") for k in ("brand", "size", "color")])


@query("select doc_id, quality::bigint as quality, toxic::bigint as toxic from labels")
def src_jsonl(t):
    return round_trip(t("labels").select("doc_id", "quality", "toxic"), "doc_id long, quality long, toxic long").drop("ord", "source_file", "raw_hash")


@query("select conv_id, turn::bigint as turn, role, md5(text) as h from conversations")
def src_jsonl_gz(t):
    rows = round_trip(t("conversations").select("conv_id", "turn", "role", "text"), "conv_id long, turn long, role string, text string", gzip=True)
    return rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"))


@query("select conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(text, '. ', chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|') as b from conversations")
def split_bullets(t):
    return t("conversations").select("conv_id", "turn", F.array_join(X.split_bullets(F.replace("text", F.lit(". "), F.lit("\n"))), "|").alias("b"))


@query(r"select ord, product_id, regexp_matches(features, '(?i)pat(ent)?s?\.?\s*(no|num)') as mentions from fx_products")
def patent_mention_filter(t):
    return t("fx_products").select("ord", "product_id", C.mentions_patent(F.col("features")).alias("mentions"))


@query("select min(doc_id) as doc_id, md5(text) as hash from documents group by md5(text)")
def content_dedup(t):
    return t("documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash")).groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


# --- citations --------------------------------------------------------------------------------------------------------


@query("""with h as (select ord, product_id, unnest([{'n': (7000000 + ord)::varchar, 'c': 'US', 'k': 'B2'}, {'n': 'D' || (600000 + ord)::varchar, 'c': 'US', 'k': ''}]) as x from fx_products where ord % 3 = 0)
select ord, product_id, x.n as patent_number, x.c as country_code, x.k as kind_code from h
union all select ord, product_id, '', '', '' from fx_products where ord % 3 = 1""")
def parse_citations(t):
    return C.parse_citations(t("fx_products")).select("ord", "product_id", "patent_number", "country_code", "kind_code")


@query("""select ord, case when kind_code like '.%' then 'CN' when p = 'ZL' then 'CN' when p in ('RE', 'D') then 'US' when length(p) >= 2 then p[1:2] else '' end as country,
 case when p = 'ZL' then '' when p in ('RE', 'D') then p when length(p) = 3 then p[3:3] when length(p) = 1 then p else '' end || d as number
 from (select ord, kind_code, (7000000 + ord)::varchar as d, case ord % 7 when 0 then 'ZL' when 1 then 'RE' when 2 then 'D' when 3 then 'EPA' when 4 then 'WO' when 5 then 'H' else '' end as p from fx_pairs)""")
def prefix_rules(t):
    p = F.element_at(F.array(*[F.lit(x) for x in ("ZL", "RE", "D", "EPA", "WO", "H", "")]), (F.col("ord") % 7 + 1).cast("int"))
    return t("fx_pairs").select("ord", C.apply_prefix(p, (7000000 + F.col("ord")).cast("string"), F.col("kind_code")).alias("x")).select("ord", "x.country", "x.number")


@query(r"select ord, position('at. No' in features) - 2 as start from fx_products where ord % 3 = 0 union all select ord, position('patent pending' in features) - 1 from fx_products where ord % 3 = 1")
def kw_spans(t):
    rows = t("fx_products").select("ord", F.explode(X.keyword_spans(F.col("features"), C.KEYWORD)).alias("s"))
    return rows.select("ord", F.col("s.start").cast("long").alias("start"))


@query("select product_id, patent_number, arg_min(country_code, ord) as country_code, min(ord) as ord from fx_pairs where patent_number <> '' group by product_id, patent_number union all select product_id, patent_number, country_code, ord from fx_pairs where patent_number = ''")
def pair_dedup(t):
    rows = t("fx_pairs").select("product_id", "patent_number", "country_code", "ord")
    return first_wins(rows.where("patent_number <> ''"), ["product_id", "patent_number"]).unionByName(rows.where("patent_number = ''"))


@query("select ord, concat(upper(country_code), patent_number, upper(kind_code)) as patent_id from fx_pairs")
def patent_id(t):
    return t("fx_pairs").select("ord", X.patent_id(F.col("country_code"), F.col("patent_number"), F.col("kind_code")).alias("patent_id"))


@query(r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(upper(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ', '')), '([A-Z]{1,3}[0-9]{4,})([A-Z][0-9]{0,2})', 2) as kind from pages")
def kind_from_title(t):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t("pages").select("page_id", title.alias("title"), F.regexp_extract(F.upper(F.replace(title, F.lit(" "), F.lit(""))), "([A-Z]{1,3}[0-9]{4,})([A-Z][0-9]{0,2})", 2).alias("kind"))


@query("select page_id, array_to_string(list_distinct_first, '|') as links from (select page_id, [x.u for x in list_sort([{'i': list_position(l, u), 'u': u} for u in list_distinct(l)])] as list_distinct_first from (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as l from pages))")
def html_links(t):
    return t("pages").select("page_id", F.array_join(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))), "|").alias("links"))


@query(r"select page_id, coalesce(nullif(regexp_extract(html, 'og:video\" content=\"([^\"]*)\"', 1), ''), nullif(regexp_extract(html, '<source src=\"([^\"]*)\"', 1), ''), nullif(regexp_extract(html, '(https?://[^\" ]*[.]mp4)', 1), '')) as media from pages")
def html_media(t):
    pick = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return t("pages").select("page_id", F.coalesce(pick('og:video" content="([^"]*)"'), pick('<source src="([^"]*)"'), pick('(https?://[^" ]*[.]mp4)')).alias("media"))


# --- claims -----------------------------------------------------------------------------------------------------------


@query("""with g as (select *, trim(arg_max(text, {'n': length(text), 'o': -ord}) over w) as longest, arg_max(ord, {'n': length(text), 'o': -ord}) over w as top from fx_claims window w as (partition by conv_id, claim_number)),
f as (select *, bool_or(trim(text) <> longest and contains(longest, trim(text))) over (partition by conv_id, claim_number) as cut from g)
select conv_id, ord, claim_number, text from f where not cut or ord = top""")
def claims_clean(t):
    packed = t("fx_claims").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("ord", "claim_number", "text"))).alias("c"))
    return packed.select("conv_id", F.explode(K.clean_claims(F.col("c"))).alias("x")).select("conv_id", "x.ord", "x.claim_number", "x.text")


@query(r"""select conv_id, turn, nullif(regexp_extract(s, '^([0-9]+)\s*[.:-]\s+', 1), '')::int as claim_number, nullif(regexp_extract(s, '(?i)\bclaim\s+([0-9]+)', 1), '')::int as depends_on
 from (select conv_id, turn, (turn + 1)::varchar || '. The device of claim ' || turn::varchar || ', ' || text as s from conversations)""")
def claims_parse(t):
    s = F.concat((F.col("turn") + 1).cast("string"), F.lit(". The device of claim "), F.col("turn").cast("string"), F.lit(", "), "text")
    return t("conversations").select("conv_id", "turn", K.parse_claim(s).alias("c")).select("conv_id", "turn", "c.claim_number", "c.depends_on")


@query("""with a as (select conv_id, list(text order by turn) as l from conversations group by conv_id), b as (select conv_id, list_concat([array_to_string(l, ' ')], l) as l from a where conv_id % 2 = 0 union all select conv_id, l from a where conv_id % 2 = 1)
select conv_id, len(case when len(l) > 1 and len(list_filter(l[2:], lambda x: not contains(lower(l[1]), lower(x)))) = 0 then l[2:] else l end) as n_claims from b""")
def claims_first_drop(t):
    a = t("conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("l"))
    whole = F.when(F.col("conv_id") % 2 == 0, F.concat(F.array(F.array_join("l", " ")), "l")).otherwise(F.col("l"))
    return a.select("conv_id", F.size(K.drop_whole_claim(whole)).cast("long").alias("n_claims"))


# --- merge and profile ------------------------------------------------------------------------------------------------

_MERGED = """with p as (select product_id, arg_max(title, ord) as product_title, arg_max(brand, ord) as brand from fx_products group by product_id),
j as (select f.*, p.product_title, p.brand from fx_pairs f join p using (product_id) where trim(product_title) <> '' and trim(patent_title) <> '' and trim(patent_number) <> ''),
merged as (select * from j qualify row_number() over (partition by product_id, patent_number order by ord) = 1)"""


def _merged(t) -> DataFrame:
    return G.merge_pairs(t("fx_pairs"), t("fx_products"))


@query(_MERGED + " select ord, product_id, patent_number, country_code, product_title, brand from merged")
def merge_pairs(t):
    return _merged(t).select("ord", "product_id", "patent_number", "country_code", "product_title", "brand")


_LABEL = "case when coalesce(country_code, '') = '' then 'UNKNOWN' else trim(country_code) end"


@query(f"""with x as (select {_LABEL} as l, product_id, case when trim(patent_number) <> '' then concat_ws('|', {_LABEL}, patent_number, kind_code) end as tr from fx_pairs where trim(product_id) <> '')
select coalesce(l, 'TOTAL') as label, count(*) as n_rows, count(distinct product_id) as n_products, count(distinct tr) as n_patents from x group by rollup(l)""")
def country_stats(t):
    return G.country_stats(t("fx_pairs"))


@query("select coalesce(source_file, 'TOTAL') as label, count(*) as n_products, count(*) filter (ord % 3 = 0) as n_flagged from fx_products group by rollup(source_file)")
def source_stats(t):
    rows = t("fx_products").withColumn("flag", C.mentions_patent(F.col("features")))
    return G.with_total(rows, F.col("source_file"), F.count("*").alias("n_products"), F.count_if("flag").alias("n_flagged"))


@query(f"""with f as (select * from fx_pairs qualify row_number() over (partition by country_code, patent_number, kind_code order by ord) = 1)
select coalesce(l, 'TOTAL') as label, count(*) as total, count(*) filter (has_abstract) as with_abstract, count(*) filter (has_images) as with_images from (select *, {_LABEL} as l from f) group by rollup(l)""")
def coverage_by_country(t):
    rows = first_wins(t("fx_pairs"), ["country_code", "patent_number", "kind_code"])
    return G.with_total(rows, G.country_label(), F.count("*").alias("total"), F.count_if("has_abstract").alias("with_abstract"), F.count_if("has_images").alias("with_images"))


_STATS = """count(*) as n_rows, count(distinct concat_ws('|', country_code, patent_number, kind_code)) as n_patents, count(distinct product_id) as n_products,
 count(*) filter (trim(patent_title) <> '') as with_title, count(*) filter (has_abstract) as with_abstract, count(*) filter (has_images) as with_images, count(*) filter (has_abstract and has_images) as with_both"""


@query(f"select {_STATS} from fx_pairs")
def pair_stats(t):
    return G.pair_stats(t("fx_pairs"))


@query(f"select {_STATS} from (select * from fx_pairs where country_code <> '' and patent_number <> '' and kind_code <> '' qualify row_number() over (partition by country_code, patent_number, kind_code order by ord) = 1)")
def entity_stats_patent(t):
    return G.entity_stats(t("fx_pairs"), ["country_code", "patent_number", "kind_code"])


@query(f"select {_STATS} from (select * from fx_pairs where product_id <> '' qualify row_number() over (partition by product_id order by ord) = 1)")
def entity_stats_product(t):
    return G.entity_stats(t("fx_pairs"), ["product_id"])


@query(f"select {_STATS} from fx_pairs where regexp_matches(lower(legal_status), 'active|granted')")
def active_stats(t):
    return G.pair_stats(t("fx_pairs").where(G.is_active(F.col("legal_status"))))


@query("select ord, legal_status from fx_pairs where lower(legal_status) like '%active%' or lower(legal_status) like '%granted%'")
def active_filter(t):
    return t("fx_pairs").where(G.is_active(F.col("legal_status"))).select("ord", "legal_status")


@query("select ord, product_id, patent_number from fx_pairs where country_code = 'US'")
def us_subset(t):
    return G.us_only(t("fx_pairs")).select("ord", "product_id", "patent_number")


@query("select ord, patent_number, upper(patent_number) like 'D%' as is_design from fx_pairs")
def design_split(t):
    return t("fx_pairs").select("ord", "patent_number", U.is_design().alias("is_design"))


@query("select country_code, count(*) as n from fx_pairs group by country_code")
def country_hist(t):
    return G.country_histogram(t("fx_pairs"))


@query("select cast(count(*) as double) / greatest(count(distinct patent_number), 1) as pairs_per_patent from fx_pairs where trim(patent_number) <> ''")
def avg_pairs(t):
    return G.per_patent(t("fx_pairs"))


@query("select d.lang, d.source, count(*) as n, count(l.quality) as labelled, count(case when l.toxic = 1 then 1 end) as toxic from documents d left join labels l on d.doc_id = l.doc_id group by d.lang, d.source")
def coverage_labels(t):
    rows = t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id", "left")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("select product_id from fx_products intersect select product_id from fx_pairs")
def ids_intersect(t):
    return t("fx_products").select("product_id").intersect(t("fx_pairs").select("product_id"))


@query("select product_id from fx_products union select product_id from fx_pairs")
def ids_union(t):
    return t("fx_products").select("product_id").union(t("fx_pairs").select("product_id")).distinct()


@query("select product_id from fx_products except select product_id from fx_pairs")
def ids_except(t):
    return t("fx_products").select("product_id").subtract(t("fx_pairs").select("product_id"))


@query("""select count(*) as total, count(distinct concat_ws('|', country_code, patent_number, kind_code)) as unique_patents, count(distinct product_id) as unique_products, count(*) filter (trim(product_title) <> '') as has_title,
 count(*) filter (has_abstract) as has_abstract, count(*) filter (has_images) as has_patent_images, count(*) filter (has_abstract and trim(product_title) <> '') as text_text, count(*) filter (has_images and ord % 2 = 0) as image_image, count(*) filter (has_abstract and ord % 2 = 0) as patent_text_product_image
 from (select f.*, p.title as product_title from fx_pairs f left join (select product_id, arg_max(title, ord) as title from fx_products group by product_id) p using (product_id))""")
def full_coverage(t):
    p = last_wins(t("fx_products"), ["product_id"]).select("product_id", F.col("title").alias("product_title"))
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = t("fx_pairs").join(p, "product_id", "left").withColumns({"abstract": F.when(F.col("has_abstract"), "said").otherwise(" "), "images": some(F.col("has_images")), "product_images": some(F.col("ord") % 2 == 0)})
    return G.coverage_stats(rows).select("total", "unique_patents", "unique_products", "has_title", "has_abstract", "has_patent_images", "text_text", "image_image", "patent_text_product_image")


@query(f"""with f as (select * from fx_pairs qualify row_number() over (partition by country_code, patent_number, kind_code order by ord) = 1), x as (select *, {_LABEL} as l, legal_status = 'Expired' as failed from f)
 select coalesce(l, 'TOTAL') as label, count(*) as total, count(*) filter (failed) as fetch_failed, count(*) filter (not failed and has_abstract) as has_abstract, 0::bigint as has_description, 0::bigint as has_claims, count(*) filter (not failed and has_images) as has_images from x group by rollup(l)""")
def fetch_coverage(t):
    whole = F.create_map(F.lit("DC.title"), F.col("patent_title"))
    rows = t("fx_pairs").withColumns({"bibliographic": whole, "error": F.when(F.col("legal_status") == "Expired", "HTTP 404"), "abstract": F.when(F.col("has_abstract"), "said"), "images": F.when(F.col("has_images"), F.array(F.lit("x")))})
    return G.info_coverage(rows)


@query("select ord, country_code, patent_number, kind_code, md5(country_code || patent_number || kind_code || '#42') as draw from fx_pairs where country_code <> '' and patent_number <> '' and kind_code <> '' qualify row_number() over (partition by country_code, patent_number, kind_code order by ord) = 1 order by draw limit 20")
def sample_examples(t):
    return G.sample(t("fx_pairs"), ["country_code", "patent_number", "kind_code"]).select("ord", "country_code", "patent_number", "kind_code", "draw")


# --- corpus -----------------------------------------------------------------------------------------------------------


@query(_MERGED + " select product_id, arg_min(product_title, ord) as product_title, arg_min(brand, ord) as brand from merged group by product_id")
def corpus_products(t):
    return U.build_corpus(_merged(t))[0]


@query(_MERGED + " select patent_number, arg_min(patent_title, ord) as patent_title from merged where upper(patent_number) not like 'D%' group by patent_number")
def corpus_patents(t):
    return U.build_corpus(_merged(t))[1]


@query(_MERGED + " select distinct patent_number, product_id from merged where upper(patent_number) not like 'D%'")
def corpus_mappings(t):
    return U.build_corpus(_merged(t))[2]


@query(_MERGED + " select case when upper(patent_number) like 'D%' then 'design' else 'kept' end as reason, count(*) as n from merged group by all")
def corpus_metadata(t):
    return U.build_corpus(_merged(t))[3]


@query(r"select ord, array_to_string(list_filter(list_transform(string_split(brand || ' ; unknown; ' || ptype, ';'), lambda x: trim(x)), lambda x: lower(x) not in ('', 'individual', 'unknown', 'n/a')), '|') as names from fx_products where length(brand) >= length(ptype) union all select ord, ptype || '|' || brand from fx_products where length(brand) < length(ptype)")
def entity_names(t):
    return t("fx_products").select("ord", F.array_join(U.entity_list(U.split_names(F.concat("brand", F.lit(" ; unknown; "), "ptype", F.lit(" and "), F.upper("brand")))), "|").alias("names"))


@query(_MERGED + """ , m as (select distinct patent_number, product_id from merged), b as (select product_id, arg_min(brand, ord) as brand from merged group by product_id),
 own as (select distinct patent_number, 'holder ' || patent_number as name from merged union select m.patent_number, b.brand from m join b using (product_id))
 select patent_number, string_agg(name, '|' order by name) as names from own group by patent_number""")
def cross_entities(t):
    merged = _merged(t)
    left = merged.select("patent_number").distinct().select("patent_number", F.array(F.concat(F.lit("holder "), "patent_number")).alias("names"))
    right = first_wins(merged, ["product_id"]).select("product_id", F.array("brand").alias("names"))
    return U.cross_entities(merged.select("patent_number", "product_id").distinct(), left, right, "patent_number", "product_id").select("patent_number", F.array_join("names", "|").alias("names"))


@query("select event_id, 'DC.title=' || event_type || '|applicationNumber=' || user_id::varchar || '|legalStatusIfi=Active|publicationNumber=' || event_id::varchar as kept from events")
def biblio_prune(t):
    whole = F.create_map(F.lit("DC.title"), F.col("event_type"), F.lit("applicationNumber"), F.col("user_id").cast("string"), F.lit("events"), F.lit("x"), F.lit("legalStatusIfi"), F.lit("Active"), F.lit("id"), F.lit("y"), F.lit("publicationNumber"), F.col("event_id").cast("string"))
    kept = F.transform(F.map_entries(U.prune_keys(whole)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t("events").select("event_id", F.array_join(F.array_sort(kept), "|").alias("kept"))


# --- text -------------------------------------------------------------------------------------------------------------


@query(r"select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as h from documents")
def ws_normalize(t):
    return t("documents").select("doc_id", F.md5(X.ws_normalize(F.col("text")).cast("binary")).alias("h"))


@query("select p_partkey, concat_ws(' ', nullif(trim(p_name), ''), nullif(trim(p_type), '')) as flat from part")
def flatten_text(t):
    return t("part").select("p_partkey", X.flatten_text(F.array("p_name", "p_type")).alias("flat"))


@query("select ord, concat_ws(' ', nullif(trim(title), ''), case when ord % 4 = 0 then nullif(brand, '') else nullif(features, '') end, 'made well') as body from fx_products")
def product_text(t):
    rows = t("fx_products").select("ord", "title", F.col("features").alias("description"), F.when(F.col("ord") % 4 == 0, F.col("brand")).alias("description_masked"), F.array(F.lit(" made well "), F.lit("  ")).alias("features"))
    return rows.select("ord", U.product_text(rows, masked=True).alias("body"))


@query("select ord, concat_ws(' ', nullif(patent_title, ''), legal_status, '1. A thing', case when has_images then 'masked' else '2. Another' end) as body from fx_pairs")
def patent_text(t):
    claim = lambda x, m: F.struct(F.lit(x).alias("text"), m.alias("text_masked"))
    claims = F.array(claim("1. A thing", F.lit(None).cast("string")), claim("2. Another", F.when(F.col("has_images"), "masked")))
    rows = t("fx_pairs").select("ord", F.col("patent_title").alias("title"), F.col("legal_status").alias("abstract"), claims.alias("claims"))
    return rows.select("ord", U.patent_text(rows, masked=True).alias("body"))


@query("select o_orderkey, replace(trim(format('{:,}', o_orderkey * 7919)), ' ', '') as grouped from orders")
def group_digits(t):
    return t("orders").select("o_orderkey", X.group_digits((F.col("o_orderkey") * 7919).cast("string")).alias("grouped"))


@query("select page_id, substring(regexp_replace(regexp_replace(url, ' ', '_', 'g'), '[^A-Za-z0-9._-]', '_', 'g'), 1, 200) as name from pages")
def sanitize(t):
    return t("pages").select("page_id", X.sanitize(F.col("url")).alias("name"))


@query("select doc_id, md5(text) as m, sha256(text) as s from documents")
def hashes(t):
    return t("documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"), F.sha2(F.col("text").cast("binary"), 256).alias("s"))


@query("select page_id, lower(coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[.]([A-Za-z0-9]{2,4})$', 1), ''), 'html')) as ext from pages")
def guess_ext(t):
    return t("pages").select("page_id", X.extension_of(F.col("url")).alias("ext"))


_BM = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x <> '')"


@query(f"select item_id, array_to_string({_BM}, ' ') as tokens from benchmark")
def bm25_tokens(t):
    return t("benchmark").select("item_id", F.array_join(X.bm25_tokens(F.col("text")), " ").alias("tokens"))


@query(r"select item_id, array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+'), ' ') as tokens from benchmark")
def tfidf_tokens(t):
    return t("benchmark").select("item_id", F.array_join(X.word_tokens(X.strip_accents(F.col("text"))), " ").alias("tokens"))


_DF = "with w as (select unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as token from documents), d as (select token, count(*) as df from w group by token)"


@query(_DF + " select token, df from d")
def token_df(t):
    return t("documents").select(F.explode(F.array_distinct(X.ascii_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@query(_DF + " select token, df from d where df > 0.1 * (select count(*) from documents)")
def noise_tokens(t):
    n = t("documents").agg(F.count("*").alias("n"))
    df = t("documents").select(F.explode(F.array_distinct(X.ascii_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).where(F.col("df") > 0.1 * F.col("n")).select("token", "df")


@query(f"select item_id, unnest([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) as gram from (select item_id, {_BM} as w from benchmark)")
def word_ngrams(t):
    return t("benchmark").select("item_id", F.explode(X.word_ngrams(X.bm25_tokens(F.col("text")), 3)).alias("gram"))


@query("""with s as (select distinct l_orderkey as k, l_linenumber * 3 as s, l_linenumber * 3 + (l_quantity::int % 7) as e from lineitem), o as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as before from s),
 g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) as island from o)
 select k, min(s)::int as s, max(e)::int as e from g group by k, island""")
def merge_spans(t):
    s = t("lineitem").select(F.col("l_orderkey").alias("k"), F.struct((F.col("l_linenumber") * 3).cast("int").alias("s"), (F.col("l_linenumber") * 3 + F.col("l_quantity").cast("int") % 7).cast("int").alias("e")).alias("x"))
    return s.groupBy("k").agg(F.collect_list("x").alias("a")).select("k", F.explode(X.merge_spans(F.col("a"))).alias("m")).select("k", "m.s", "m.e")


@query("select conv_id, count(distinct text) as n from conversations group by conv_id")
def array_dedup(t):
    return t("conversations").groupBy("conv_id").agg(F.size(F.collect_set("text")).cast("long").alias("n"))


@query("select min(n_chars) as lo, max(n_chars) as hi, avg(n_chars) as mean from (select n_chars from documents order by doc_id limit 10)")
def len_profile(t):
    first = t("documents").orderBy("doc_id").limit(10)  # a profile of the first ten is the feature
    return first.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.avg("n_chars").alias("mean"))


# --- masking ----------------------------------------------------------------------------------------------------------


@query("select ord, case ord % 3 when 0 then split_part(features, ' Covered by', 1) || ' Covered by U.S. Pat. No..' else features end as masked from fx_products")
def mask_numbers(t):
    return spread(t("fx_products").select("ord", "features")).select("ord", M.mask_patent_numbers(F.col("features")).alias("masked"))


@query("select ord, case ord % 3 when 0 then split_part(features, ' Covered by', 1) || ' Covered by U.S. Pat. No. and D' || (600000 + ord)::varchar || '.' else features end as masked from fx_products")
def known_number_mask(t):
    return t("fx_products").select("ord", M.mask_known_number(F.col("features"), (7000000 + F.col("ord")).cast("string")).alias("masked"))


@query("select ord, case when ord % 97 = 0 then replace(features, ' .', '.') else trim(replace(replace(features, ' .', '.'), title, '')) end as masked from fx_products")
def mask_exact(t):
    return t("fx_products").select("ord", M.mask_names(F.col("features"), F.array("title", "brand")).alias("masked"))


@query("select ord, case when ord % 97 = 0 then replace(features, ' .', '.') else trim(replace(replace(features, ' .', '.'), title, '')) end as masked from fx_products")
def mask_titles(t):
    return t("fx_products").select("ord", M.mask_titles(F.col("features"), F.array(F.replace("title", F.lit(" "), F.lit("  ")))).alias("masked"))


_NAME_WORDS = """n as (select distinct p_name as name from part), tk as (select lower(p_name) as x from part), sh as (select w as token, count(*) / (select count(*) from part) as share from (select unnest(list_distinct(regexp_extract_all(x, '[a-z0-9]+'))) as w from tk) group by w),
 w as (select name, regexp_extract_all(name, '[A-Za-z0-9]+') as l from n), e as (select name, len(l) as n, unnest(range(len(l))) as pos, unnest(l) as word from w),
 g as (select e.*, coalesce(share, 0) as share from e left join sh on sh.token = lower(word) where coalesce(share, 0) <= 0.1), r as (select *, row_number() over (partition by name order by pos) as k from g),
 c as (select a.name, string_agg(b.word, ' ' order by b.k) as cand, count(*) as m, any_value(a.n) as n, min(b.share) as share from r a join r z on z.name = a.name and z.k >= a.k join r b on b.name = a.name and b.k between a.k and z.k group by a.name, a.k, z.k)"""


@query(f"with {_NAME_WORDS} select name, cand as candidate from c where m > 1 or n = 1 or share <= 0.02 group by all")
def entity_candidates(t):
    names = t("part").select(F.col("p_name").alias("name"))
    found = M.name_candidates(names, M.token_shares(names, "name"))
    return found.select("name", F.explode("candidates").alias("candidate"))


@query()
def fuzzy_mask(t):
    return spread(t("fx_products").select("ord", "features", "title", "brand")).select("ord", M.fuzzy_mask(F.col("features"), F.array("title", "brand")).alias("masked"))


# --- retrieval --------------------------------------------------------------------------------------------------------

_BM25 = f"""with d as (select doc_id, {_BM} as w from documents), q as (select item_id, {_BM} as w from benchmark),
 p as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, unnest(w) as term, len(w) as dl from d) group by doc_id, term),
 tot as (select count(*) as n, avg(len(w)) as avgdl from d), f as (select term, count(*) as df from p group by term),
 i as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from f, tot), i2 as (select term, case when raw < 0 then 0.25 * (select avg(raw) from i) else raw end as idf from i),
 qt as (select item_id, term, count(*) as qtf from (select item_id, unnest(w) as term from q) group by item_id, term),
 scores as (select qt.item_id as query_id, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))::double as score from qt join i2 using (term) join p using (term), tot group by 1, 2)"""
_TFIDF = r"""with dt as (select doc_id as id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+')) as term from documents) group by 1, 2),
 qt as (select item_id as id, term, count(*) as tf from (select item_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+')) as term from benchmark) group by 1, 2),
 n as (select count(*) as n from documents), i as (select term, ln((1 + n) / (1 + df)) + 1 as idf from (select term, count(*) as df from dt group by term), n where df <= 0.95 * n),
 dw as (select id, term, (1 + ln(tf)) * idf as w from dt join i using (term)), qw as (select id, term, (1 + ln(tf)) * idf as w from qt join i using (term)),
 dn as (select id, sqrt(sum(w * w)) as norm from dw group by id), qn as (select id, sqrt(sum(w * w)) as norm from qw group by id),
 scores as (select qw.id as query_id, dw.id as doc_id, sum(qw.w / qn.norm * dw.w / dn.norm) as score from qw join qn on qn.id = qw.id join dw using (term) join dn on dn.id = dw.id group by 1, 2)"""
_DENSE = """with scores as (select q.vec_id as query_id, d.vec_id as doc_id, list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1]::double * z[2]::double)) as score
 from embeddings q, embeddings d where q.vec_id % 20 = 0 and q.vec_id <> d.vec_id)"""
_RANK = ", ranked as (select query_id, doc_id, round(score, 4) as score, row_number() over (partition by query_id order by round(score, 4) desc, doc_id) as rank from scores)"
_METRICS = """, r as (select ranked.query_id, rank, row_number() over (partition by ranked.query_id order by rank) as hits from ranked join rel on rel.query_id = ranked.query_id and rel.doc_id = ranked.doc_id),
 tot as (select query_id, count(*) as total from rel group by 1),
 per as (select t.query_id, total, coalesce(max(1.0 / rank), 0) as rr, coalesce(sum(case when rank <= 10 then hits / rank end), 0) as ap, coalesce(sum(case when rank <= 10 then 1 / log2(rank + 1) end), 0) as dcg from tot t left join r on r.query_id = t.query_id group by 1, 2)
 select round(avg(rr), 4)::double as mrr, round(avg(ap / least(total, 10)), 4)::double as map_10, round(avg(dcg / (select sum(1 / log2(i + 1)) from range(1, least(total, 10)::bigint + 1) x(i))), 4)::double as ndcg_10 from per"""


def _bm25(t) -> R.Vectors:
    return R.bm25(t("benchmark"), t("documents"), "item_id", "doc_id")


def _tfidf(t) -> R.Vectors:
    return R.tfidf(t("benchmark"), t("documents"), "item_id", "doc_id")


def _dense(t) -> tuple[DataFrame, DataFrame]:
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return v.where("id % 20 = 0"), v


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select(*[F.round(c, 4).alias(c) for c in ("mrr", "map_10", "ndcg_10")])


@query(_BM25 + " select query_id, doc_id, round(score, 4) as score from scores")
def bm25_scores(t):
    return _bm25(t).scores()


@query(_BM25 + _RANK + " select query_id, doc_id, score, rank::int as rank from ranked where rank <= 5")
def bm25_top5(t):
    return _bm25(t).top(5)


@query(_TFIDF + " select query_id, doc_id, round(score, 4) as score from scores")
def tfidf_scores(t):
    return _tfidf(t).scores()


@query(_DENSE + " select query_id, doc_id, round(score, 4) + 0.0 as score from scores")
def dense_scores(t):
    return R.dense(*_dense(t))


@query(_DENSE + _RANK + " select query_id, doc_id, score, rank::int as rank from ranked where rank <= 10")
def dense_topk(t):
    return R.dense_top(*_dense(t), 10)


@query(_TFIDF + _RANK + " select query_id, doc_id, score, rank::int as rank from ranked")
def rank_docs(t):
    return R.ranked(_tfidf(t).scores())


@query(_TFIDF + _RANK + " select query_id, doc_id, score, rank::int as rank from ranked where rank <= 20")
def topk_docs(t):
    return _tfidf(t).top(20)


@query(_BM25 + _RANK + ", rel as (select query_id, doc_id from fx_qrels)" + _METRICS.replace("tot", "tots"))
def ir_metrics_bm25(t):
    return _rounded(_bm25(t).metrics(t("fx_qrels")))


@query(_TFIDF + _RANK + ", rel as (select query_id, doc_id from fx_qrels)" + _METRICS)
def ir_metrics_tfidf(t):
    return _rounded(_tfidf(t).metrics(t("fx_qrels")))


@query(_DENSE + _RANK + ", rel as (select q.vec_id as query_id, d.vec_id as doc_id from embeddings q join embeddings d on q.label = d.label and q.vec_id <> d.vec_id where q.vec_id % 20 = 0)" + _METRICS)
def ir_metrics_dense(t):
    return _rounded(R.dense_metrics(*_dense(t)))


# --- assets -----------------------------------------------------------------------------------------------------------


@query("select url, arg_max(type, ord) as type, max(ord) as ord from fx_manifest group by url having arg_max(downloaded, ord)")
def manifest_latest(t):
    return latest_entries(t("fx_manifest")).select("url", "type", "ord")


@query("select coalesce(type, 'TOTAL') as label, count(*) as total, count(*) filter (downloaded) as success, count(*) filter (not downloaded) as failed from fx_manifest group by rollup(type)")
def asset_report(t):
    return G.with_total(t("fx_manifest"), F.col("type"), F.count("*").alias("total"), F.count_if("downloaded").alias("success"), F.count_if(~F.col("downloaded")).alias("failed"))


@query("select type, url, min(ord) as ord from fx_manifest group by type, url")
def asset_dedup(t):
    return first_wins(t("fx_manifest").select("ord", "url", "type"), ["type", "url"])


@query("select ord, product_id, 'product_image' as type, 'thumb' as subtype, concat('http://x/', product_id, '/thumb.png') as url from fx_products union all select ord, product_id, 'product_image', 'large', concat('http://x/', product_id, '/large.png') from fx_products union all select ord, product_id, 'product_image', 'hi_res', concat('http://x/', product_id, '/hi_res.png') from fx_products where ord % 2 = 0")
def asset_unnest(t):
    url = lambda s: F.concat(F.lit("http://x/"), "product_id", F.lit(f"/{s}.png"))
    image = F.struct(url("thumb").alias("thumb"), url("large").alias("large"), F.when(F.col("ord") % 2 == 0, url("hi_res")).otherwise("").alias("hi_res"))
    return A.product_images(t("fx_products").select("ord", "product_id", F.array(image).alias("images")))


@query("""select ord, case type when 'product_image' then 'products/' || product_id || '/images/image/' || n when 'product_video' then 'products/' || product_id || '/videos/' || n else 'patents/UNKNOWN_PATENT/images_unknown/' || n end as path
 from (select *, split_part(url, '/', -1) || '_' || sha256(url)[1:8] as n from fx_manifest)""")
def asset_path(t):
    rows = t("fx_manifest")
    return rows.select("ord", A.target_path(rows).alias("path"))


@query("select ord, url from fx_manifest where url like 'http%'")
def valid_url(t):
    return t("fx_manifest").where(A.is_link(F.col("url"))).select("ord", "url")


@query("select ord, product_id from fx_products where product_id in (select product_id from fx_manifest)")
def has_assets(t):
    return A.with_assets(t("fx_products"), t("fx_manifest")).select("ord", "product_id")


@query("select ord, product_id from fx_products where product_id not in (select product_id from fx_manifest)")
def resume_anti(t):
    return A.with_assets(t("fx_products"), t("fx_manifest"), present=False).select("ord", "product_id")


@query("select type, url, product_id, min(ord) as ord from fx_manifest where type <> 'patent_image' group by all union all select type, url, arg_min(product_id, ord), min(ord) from fx_manifest where type = 'patent_image' group by type, url")
def asset_keys(t):
    return A.distinct_assets(t("fx_manifest")).select("type", "url", "product_id", "ord")


@query("select distinct product_id as id, case when u like '%/3' then 'cached ' || u else 'kind of ' || product_id end as value from (select product_id, max(url) as u from fx_manifest group by product_id)")
def cache_lookup(t):
    each = t("fx_manifest").groupBy("product_id").agg(F.max("url").alias("u"))
    cache = each.select(F.col("product_id").alias("id"), F.when(F.col("u").endswith("/3"), F.concat(F.lit("cached "), "u")).alias("value"))
    return E.lookup(each.select(F.col("product_id").alias("id")), lambda k: f"kind of {k}", cache).select("id", "value")


@query("""with p as (select product_id, list_sort(list_distinct(list(url))) as found, list_distinct(list(url || '?size=small') filter (ord % 2 = 0)) as thumbs from fx_manifest group by product_id),
 n as (select product_id, unnest(found) as u, list_transform(coalesce(thumbs, []), lambda x: split_part(split_part(x, '?', 1), '/', -1)) as names from p)
 select product_id, u as url, case when list_contains(names, split_part(u, '/', -1)) then 'matched' else 'additional' end as state from n""")
def hires_match(t):
    p = t("fx_manifest").groupBy("product_id").agg(F.collect_set("url").alias("found"), F.collect_set(F.when(F.col("ord") % 2 == 0, F.concat("url", F.lit("?size=small")))).alias("thumbs"))
    m = p.select("product_id", P.match_by_name(F.col("found"), F.col("thumbs")).alias("m"))
    each = lambda k: m.select("product_id", F.explode(f"m.{k}").alias("url"), F.lit(k).alias("state"))
    return each("matched").unionByName(each("additional"))


_PAGE = """concat('<html><head><title>US', cast(7000000 + p_partkey as STR), 'B2 - ', p_name, '</title><meta name="DC.title" content="', p_name, '"><meta itemprop="priorityDate" content="2001">',
 '</head><body><dd itemprop="inventor">Ann  One</dd><dd itemprop="inventor">Bob Two</dd><img src="/patent/', cast(p_partkey as STR), '.png"><img src="/logo.png"><div itemprop="abstract"> A <b>', p_type, '</b>\n &amp; more</div>',
 '<section itemprop="claims"><h2>What is claimed is:</h2><div>1. A ', p_type, ' with a part.<br></div><div>2. The thing of claim 1, of size ', cast(p_size as STR), '</div><div>2. The thing of claim 1, of size ', cast(p_size as STR), '</div><p>unclosed</section></body>')"""


@query("""select p_partkey as id, p_name as title, 'Bob Two' as inventor, 'A ' || p_type || ' & more' as abstract, '/patent/' || p_partkey::varchar || '.png' as images, 2::bigint as n_claims, 1 as depends_on, '2. The thing of claim 1, of size ' || p_size::varchar as last from part""")
def patent_pages(t):
    pages = spread(t("part").select("p_partkey", "p_name", "p_type", "p_size")).selectExpr("p_partkey as id", f"{_PAGE.replace('STR', 'string')} as html")
    b, last = F.col("bibliographic"), F.element_at("claims", -1)
    return P.read_patent_pages(pages).select("id", b["DC.title"].alias("title"), b["inventor"].alias("inventor"), "abstract", F.array_join("images", "|").alias("images"), F.size("claims").cast("long").alias("n_claims"), last["depends_on"].alias("depends_on"), last["text"].alias("last"))


@query("select p_partkey as id, case p_partkey % 3 when 0 then 'https://a.example/v.mp4' when 1 then 'https://a.example/' || p_partkey::varchar || '.mp4' end as video from part")
def page_videos(t):
    html = """case p_partkey % 3 when 0 then '<meta property="og:video" content="x.webm"><video src="https://a.example/v.mp4"></video>'
     when 1 then concat('<script type="application/ld+json">{"@type": "VideoObject", "n": [{"contentUrl": "z"}], "contentUrl": "https://a.example/', cast(p_partkey as string), '.mp4"}</script>') else '<p>none</p>' end as html"""
    return spread(t("part").select("p_partkey")).selectExpr("p_partkey as id", html).select("id", P.find_video("html").alias("video"))


@query("select product_id, url from fx_manifest qualify row_number() over (partition by product_id order by (type <> 'patent_image')::int, url, ord) = 1")
def pick_primary(t):
    return first_wins(t("fx_manifest").select("product_id", "url", "type", "ord"), ["product_id"], F.struct((F.col("type") != "patent_image").cast("int").alias("a"), "url", "ord")).select("product_id", "url")


@query("select product_id, arg_max(title, ord) as title from fx_products group by product_id")
def last_wins_products(t):
    return last_wins(t("fx_products"), ["product_id"]).select("product_id", "title")
