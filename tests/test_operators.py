"""Operators on small rows, and invariance to partitioning."""

import gzip
import io
import json

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovex.functions import citations as C
from trovex.functions import text as X
from trovex.operators import assets as A
from trovex.operators import claims as K
from trovex.operators import corpus as U
from trovex.operators import encoders as N2
from trovex.operators import enrich as E
from trovex.operators import masking as M
from trovex.operators import pages as P
from trovex.operators import records as N
from trovex.operators import retrieval as R
from trovex.operators.order import first_wins, last_wins
from trovex.plans import runner
from trovex.sources import readers, sinks
from trovex.streaming import manifest


def cited(spark, *texts):
    names = [f"t{i}" for i in range(len(texts))]
    rows = C.parse_citations(spark.createDataFrame([("p", 1, *texts)], "product_id string, ord long, " + ", ".join(f"{n} string" for n in names)), *names).orderBy("field_no", "span_no", "number_no").collect()
    return [(r.patent_number, r.country_code, r.kind_code) for r in rows]


def test_citations(spark):
    assert cited(spark, "Covered by U.S. Pat. No. 7,000,001 B2 and EP1234567A1.") == [("7000001", "US", "B2"), ("1234567", "EP", "A1")]
    assert cited(spark, "Patent ZL201020304050.X") == [("201020304050", "CN", ".X")]
    assert cited(spark, "patent pending") == [("", "", "")]
    assert cited(spark, "no keyword 1234567") == []
    # a plain number takes a suffix only at the end of the span, a comma number anywhere; elsewhere it is a kind
    assert cited(spark, "patent 7000001B2") == [("7000001B2", "", "")]
    assert cited(spark, "patent 7000001B2 here") == [("7000001", "", "B2")]
    assert cited(spark, "patent 7,000,001B2 here") == [("7000001B2", "", "")]
    # letters that touch the digits are a prefix, whatever they say
    assert cited(spark, "patent no7000001 x") == [("7000001", "NO", "")]
    assert cited(spark, "patent USRE41234 x") == [("E41234", "SR", "")]
    # more than 14 digits are split
    assert cited(spark, "patent 1234567890123456789 x") == [("12345678901234", "", ""), ("56789", "", "")]
    # the hint has no border at its end, and any case counts
    assert cited(spark, "U. S. patent 6000000 b1") == [("6000000", "US", "B1")]
    assert cited(spark, "we use patent 6000001 x") == [("6000001", "US", "")]
    # numbers with commas come first; the first of a number stays, whatever its field
    assert cited(spark, "Pats. 7000001 and 7,000,002 x") == [("7000002", "", ""), ("7000001", "", "")]
    assert cited(spark, "patent EP7000001 x", "patent US7000001 x", None) == [("7000001", "EP", "")]
    assert cited(spark, "Patented 5,123,456 design") == [("5123456", "", "")]
    assert cited(spark, "") == []


def test_mentions(spark):
    rows = [("patent no. five", True), ("a patent 1234567", True), ("patent pending", False), ("pattern 1234567", False), (None, False), ("Patented 5,123,456", True), ("pats 12", False), ("pat. nos", True)]
    got = spark.createDataFrame(rows, "t string, want boolean").select(C.mentions_patent(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_first_and_last_do_not_depend_on_partitions(spark):
    rows = spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id").alias("ord"), (F.col("id") * 3).alias("v"))
    for n in (1, 4, 16):
        assert sorted(map(tuple, first_wins(rows.repartition(n), ["k"]).collect())) == [(k, k, 3 * k) for k in range(7)]
        assert {r.k: r.ord for r in last_wins(rows.repartition(n), ["k"]).collect()} == {k: max(i for i in range(200) if i % 7 == k) for k in range(7)}


def test_claims(spark):
    c = F.array(*[F.struct(F.lit(n).cast("int").alias("claim_number"), F.lit(i).alias("ord"), F.lit(t).alias("text")) for i, (n, t) in enumerate([(2, "b"), (1, "whole text"), (1, "whole"), (1, "other"), (None, "z"), (2, "b")])])
    got = spark.range(1).select(K.clean_claims(c).alias("c")).first().c
    assert [(x.claim_number, x.text) for x in got] == [(1, "whole text"), (2, "b"), (2, "b"), (None, "z")]
    one = spark.range(1).select(K.parse_claim(F.lit("Claim 3. The device of claim 2, wherein")).alias("c")).first().c
    assert (one.claim_number, one.depends_on) == (3, 2)
    assert spark.range(1).select(K.drop_whole_claim(F.array(F.lit("A b"), F.lit("a"), F.lit("B"))).alias("c")).first().c == ["a", "B"]


def test_masks(spark):
    def run(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert run(M.mask_known_number(F.lit("See US 7,000,001 B2, end"), F.lit("7000001"))) == "See B2, end"  # only a kind that touches goes
    assert run(M.mask_names(F.lit("by ACME Corp and acmecorp."), F.array(F.lit("Acme Corp")))) == "by and."
    assert run(M.mask_patent_numbers(F.lit("U.S. Pat. No. 7,000,001 and D600,001."))) == "U.S. Pat. No.."
    for said, left in (
        ("Patented 5,123,456 ok", "Patented ok"),
        ("Reg. No. 1234567 ok", "Reg. No. ok"),
        ("Application Ser. No. 12/345,678, now", "Application Ser. No., now"),
        ("patents 7,111,222 here", "patents here"),
        ("trademark registration number is 1234567 or so", "trademark registration number or so"),
        ("see US D600,001 S1, EP 1234567B1, USD612345, # 7,000,001 end", "see,,, end"),
        ("costs 1234567 for a pattern", "costs 1234567 for a pattern"),
    ):
        assert run(M.mask_patent_numbers(F.lit(said))) == left
    assert run(M.mask_patent_numbers(F.lit(None).cast("string"))) is None and run(M.mask_patent_numbers(F.lit(""))) == ""
    for said in ("Ser. No. 29/123,456", "Ser. No. 29/123456", "Ser. No. 29123456"):
        assert run(M.mask_known_number(F.lit(said), F.lit("29/123456"))) == "Ser. No."
    assert run(M.mask_known_number(F.lit("1234 and 7.000.001"), F.lit("1234"))) == "1234 and 7.000.001"
    assert run(M.mask_titles(F.lit("the Great  Big\nThing's end"), F.array(F.lit("great big thing"), F.lit(" ")))) == "the 's end"
    names = F.array(F.lit("Ab"), F.lit("Ab Cd"), F.lit("ab"))
    assert run(M.name_variants(names)) == ["Ab Cd", "AbCd", "Ab"]
    assert run(M.fuzzy_mask(F.lit("made by Acmee Corp here"), F.array(F.lit("Acme Corp")))) == "made by here"


def test_candidates_and_entries(spark):
    texts = spark.createDataFrame([(f"common words {i}",) for i in range(98)] + [("rareword common",), ("semi common",), ("semi",)], "text string")
    names = spark.createDataFrame([("Common Rareword of Semi",), ("Common",), ("",)], "name string")
    got = {r.name: r.candidates for r in M.name_candidates(names, M.token_shares(texts), ["of"]).collect()}
    assert got == {"Common Rareword of Semi": ["Rareword Semi", "Rareword", "Semi"], "Common": [], "": []}
    rows = spark.createDataFrame([(1, "Acme saw patent 7,000,001", ["by acme", None, "x  y"], ["7000001"], ["Acme"], ["Acmes"], ["x y"]), (2, None, None, None, None, None, None)], "id long, title string, features array<string>, numbers array<string>, names array<string>, candidates array<string>, titles array<string>")
    a, b = M.mask_entries(rows, ["title", "features"], titles="titles").orderBy("id").collect()
    assert (a.title_masked, a.features_masked) == ("saw patent", ["by", None, ""]) and (b.title_masked, b.features_masked) == (None, None)


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    assert M.lcs(a, b) == row[-1]


def test_spans_and_digits(spark):
    a = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in [(5, 7), (0, 2), (2, 3), (6, 9)]])
    got = spark.range(1).select(X.merge_spans(a).alias("m"), X.group_digits(F.lit("7000001")).alias("g")).first()
    assert [tuple(x) for x in got.m] == [(0, 3), (5, 9)] and got.g == "7,000,001"


def test_perfect_ranking(spark):
    scores = spark.createDataFrame([(1, d, 1.0 / d) for d in range(1, 30)], "query_id long, doc_id long, score double")
    rel = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, doc_id long")
    m = R.metrics(scores, rel).first()
    assert m.mrr == 1 and abs(m.ndcg_10 - 1) < 1e-12 and abs(m.map_5 - 1) < 1e-12


def test_jsonl_and_stream(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "t": "x"}\n\nnot json\n{"t": "x", "id": "1"}\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, t string")
    assert rows.count() == 2 and rows.select("raw_hash").distinct().count() == 1
    sinks.write_jsonl(rows.select("id", "t"), str(tmp_path / "out"), gzip=True)
    assert readers.read_jsonl(spark, str(tmp_path / "out"), "id string, t string").count() == 2
    assert readers.count_lines(spark, str(tmp_path / "a.jsonl")) == 3
    entries = spark.createDataFrame([("u", 1, True), ("u", 2, False), ("v", 3, True)], "url string, ord long, downloaded boolean")
    entries.write.parquet(str(tmp_path / "in"))
    manifest.fold_manifest(spark, str(tmp_path / "in"), "url string, ord long, downloaded boolean", str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert [r.url for r in manifest.read_manifest(spark, str(tmp_path / "state")).collect()] == ["v"]


PAGE = """<html><head><title>US 7000001 B2 - Thing</title><meta name="DC.title" content="Thing"><meta itemprop="kind" content="B2">
<script type="application/ld+json">{"@type": "VideoObject", "a": [{"contentUrl": "https://v.example/a.mp4"}], "embedUrl": "https://v.example/b.mp4", "i": "https://patentimages.storage.googleapis.com/z/2.png"}</script>
<script type="application/ld+json">{broken</script></head><body><dd itemprop="inventor">Ann&nbsp; One</dd><dd itemprop="inventor">Bob</dd>
<div itemprop="abstract">A  <b>thing</b>\n&amp; more</div><div class="x description">first<p> second </div>
<section itemprop="claims"><div>What is claimed is: 1. all</div><div><claim-text>1. A thing made well</claim-text><claim-text>2. The thing of claim 1, red</claim-text></div><div>2. The thing of claim 1, red</div><div>3. x</div></section>
<img src="/Patent/1.png"><img src="https://patentimages.storage.googleapis.com/a/1.png"><img src="logo.png"></body>"""


def test_patent_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>no<b>thing"), (4, '<section itemprop="claims">loose text only</section>')], "id long, html string")
    got = {r.id: r for r in P.read_patent_pages(pages).collect()}
    one = got[1]
    assert one.bibliographic == {"DC.title": "Thing", "kind": "B2", "inventor": "Bob"}
    assert (one.abstract, one.description) == ("A thing & more", "first second")
    assert one.images == ["/Patent/1.png", "https://patentimages.storage.googleapis.com/a/1.png"]
    assert [(c.text, c.claim_number, c.dependent, c.depends_on) for c in one.claims][-2:] == [("1. A thing made well", 1, False, None), ("2. The thing of claim 1, red", 2, True, 1)]
    for i in (2, 3):
        assert (got[i].bibliographic, got[i].abstract, got[i].description, got[i].claims, got[i].images) == ({}, "", "", [], [])
    assert [c.text for c in got[4].claims] == ["loose text only"]
    x = pages.select("id", P.find_video("html").alias("v"), P.find_patent_images("html").alias("i"), P.kind_of_title(P.page_title(F.col("html"))).alias("k")).orderBy("id").collect()
    assert [r.v for r in x] == ["https://v.example/b.mp4", None, None, None] and x[0].k == "B2"
    assert x[0].i == ["https://patentimages.storage.googleapis.com/z/2.png", "https://patentimages.storage.googleapis.com/a/1.png"]
    assert P.video_url("see https://m.media-amazon.com/q/v.mp4?x=1 or y") == "https://m.media-amazon.com/q/v.mp4?x=1"
    assert P.patent_page("<div>" * 50_000)[3] == []


def test_records(spark):
    rows = ['{"parent_asin": "A", "title": "t", "store": "S", "details": {"store": "old", "k": 1}}', '{"product_id": null, "asin": "B"}', '{"sku": 7, "product_id": "kept", "title": ""}', "[1]", "no json", '{"asin": "C", "details": "text", "price": 2.5}', '{"title": "none"}']
    raw = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(99, None)], "ord long, value string")
    got = {r.ord: r for r in N.normalize_products(raw).collect()}
    assert {i: r.product_id for i, r in got.items()} == {0: "A", 2: "kept", 5: "C"}
    assert got[0].details == {"store": "S", "k": "1"} and got[2].details == {"sku": "7"} and got[5].details == {"_raw": "text"} and got[5].price == "2.5"
    by_sku = {r.ord: r for r in N.normalize_products(raw, id_field="sku").collect()}
    assert by_sku[2].product_id == "7" and by_sku[2].details == {}


def test_masked_text_falls_back_only_where_it_is_null(spark):
    rows = spark.createDataFrame([("t", "", "d", None), ("t", "m", None, None)], "title string, title_masked string, description string, description_masked string")
    assert [r[0] for r in rows.select(U.product_text(rows, masked=True)).collect()] == ["d", "m"]
    assert [r[0] for r in rows.select(U.product_text(rows, masked=True, strict_compat=True)).collect()] == ["t d", "m"]
    assert [r[0] for r in rows.select(U.product_text(rows)).collect()] == ["t d", "t"]


def test_lookup_retries_and_caches(spark, tmp_path):
    log = str(tmp_path / "asked")

    def source(key):
        with open(log, "a") as f:
            f.write(key + "\n")
        if key == "busy" and open(log).read().count("busy") < 3:
            raise E.Throttled("later")
        if key == "bad":
            raise KeyError("no such page")
        return None if key == "none" else f"<title>US{key}B1</title>"

    ids = spark.createDataFrame([(k,) for k in ("busy", "bad", "none", "1234567", "1234567", "old", None, "")], "id string")
    cache = spark.createDataFrame([("old", "cached"), ("bad", None)], "id string, value string")
    got = {r.id: (r.value, r.error) for r in E.lookup(ids, source, cache, partitions=1, wait=0.0).collect()}
    assert got["busy"] == ("<title>USbusyB1</title>", None) and got["old"] == ("cached", None) and got["none"] == (None, None)
    assert got["bad"][0] is None and "no such page" in got["bad"][1] and len(got) == 5


def test_runner(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "a.jsonl.gz", "wt") as f:
        for r in ({"asin": "P1", "title": "Good thing", "description": "U.S. Pat. No. 7,000,001 and 7,000,002", "Brand": "Acme"}, {"asin": "P2", "title": "Other", "description": "no mention"}):
            f.write(json.dumps(r) + "\n" + json.dumps(r) + "\n\nnot json\n")
    names = ("raw_products", "interim_pairs", "pairs_with_kinds", "patent_info", "patent_cache", "patent_info_cleaned", "merged_dataset", "examples")
    cfg = runner.Config({"source": {"input_dir": str(tmp_path / "in")}, "paths": {n: str(tmp_path / n) for n in names}, "review_steps": {"step_02": str(tmp_path / "seen.jsonl")}, "examples": {"n": 1}})
    with pytest.raises(KeyError, match="source.nothing"):
        cfg.need("source.nothing.here")
    with pytest.raises(ValueError):
        runner.chosen_steps([1, 9])
    assert runner.chosen_steps([7, 1], no_examples=True) == [1]

    def source(key):
        return PAGE.replace("US 7000001 B2", f"{key} B2") if key.startswith("US7000001") else None

    with pytest.raises(runner.ReviewRequired):
        runner.run_pipeline(spark, cfg, [1, 2])
    pairs = spark.read.json(str(tmp_path / "interim_pairs")).collect()
    assert sorted(r.patent_number for r in pairs) == ["7000001", "7000002"] and {r.country_code for r in pairs} == {"US"}
    (tmp_path / "seen.jsonl").write_text("".join(json.dumps(r.asDict()) + "\n" for r in pairs))
    assert runner.run_pipeline(spark, cfg, source=source) == [1, 2, 3, 4, 5, 6, 7]
    merged = spark.read.json(str(tmp_path / "merged_dataset")).collect()
    assert [(r.product_id, r.patent_number, r.kind_code, r.patent_title, r.brand) for r in merged] == [("P1", "7000001", "B2", "Thing", "Acme")]
    assert spark.read.json(str(tmp_path / "examples")).count() == 1
    assert spark.read.csv(str(tmp_path / "patent_info_stats"), header=True).where("label = 'TOTAL'").first().total == "2"


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "ab", "p1"), (2, None, "p2"), (3, "abc", None)], "id long, t string, p string")

    def load():
        return lambda items: np.array([[len(i), 3.0] if isinstance(i, str) else [len(i["text"]), len(i["image"])] for i in items])

    enc = N2.Encoder(load, batch=2, query_prefix="> ", truncate=lambda t, n: t[:n], most_tokens=2)
    v = {r.id: r.v for r in N2.encode(N2.encoder_inputs(rows, "id", F.col("t")), enc, query=True).collect()}
    assert v[3] == pytest.approx([0.8, 0.6]) and v[2] == pytest.approx([2 / 13**0.5, 3 / 13**0.5])
    both = N2.encoder_inputs(rows.where("id < 3"), "id", F.col("t"), F.col("p"), "multimodal")
    assert {r.id: r.v for r in N2.encode(both, enc).collect()}[2] == pytest.approx([0, 1])
    with pytest.raises(Exception, match="no image for 3"):
        N2.encode(N2.encoder_inputs(rows, "id", F.col("t"), F.col("p"), "image"), enc).collect()


def test_sinks_write_all_rows(spark, tmp_path):
    rows = spark.range(2500).select("id", F.lit("é").alias("t"))
    sinks.write_report(rows, str(tmp_path / "r" / "x.json"))
    assert len(json.loads((tmp_path / "r" / "x.json").read_text())) == 2500
    sinks.write_report(rows.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []
    sinks.write_json_map(rows.limit(2), str(tmp_path / "m.json"), "id")
    assert json.loads((tmp_path / "m.json").read_text()) == {"0": {"t": "é"}, "1": {"t": "é"}}
    out = io.StringIO()
    assert sinks.print_report(rows.limit(2), out, "title") == 2 and out.getvalue().splitlines()[0] == "title"
    with pytest.raises(FileNotFoundError):
        readers.read_folder(spark, str(tmp_path))


def test_image_picks(spark):
    files = spark.createDataFrame([(f"file:/x/products/{p}",) for p in ("A/images/large/a.png", "A/images/hi_res/MAIN_z.png", "A/images/hi_res/b.png", "B/images/large/c.png", "C/images/thumb/d.png")], "path string")
    got = {r.id: r.path.rsplit("/", 1)[1] for r in readers.pick_image(readers.assets_of(files, "products"), ("hi_res", "large"), "main").collect()}
    assert got == {"A": "MAIN_z.png", "B": "c.png"}


def test_passages(spark):
    docs = spark.createDataFrame([(1, "xx the quick brown fox yy"), (2, "the quick  brown fox"), (3, None), (4, "he quick brown fo")], "doc_id long, text string")
    passages = spark.createDataFrame([(7, "e quick brown f"), (8, "quick"), (9, None), (10, "  ")], "item_id long, text string")
    assert sorted(map(tuple, R.passage_matches(docs, passages).collect())) == [(7, 1), (7, 4), (8, 1), (8, 2), (8, 4), (10, 2)]


def test_accents_extensions_and_asset_keys(spark):
    x = spark.range(1).select(X.strip_accents(F.lit("Ünï éß ǆ и̂ Ώ")).alias("a"), X.extension_of(F.lit("http://a/b.PNG?x=1.gif#t")).alias("b"), X.extension_of(F.lit("http://a/b")).alias("c"), X.extension_of_type(F.lit("image/JPEG; q=1"), F.lit("u.png")).alias("d"), X.extension_of_type(F.lit(None).cast("string"), F.lit("u.png")).alias("e")).first()
    assert x.a == "Uni eß ǆ и Ω" and (x.b, x.c, x.d, x.e) == ("png", "html", "jpg", "png")
    rows = spark.createDataFrame([(1, "product_image", "p", "large", "u"), (2, "product_image", "p", "thumb", "u"), (3, "product_image", "p", "large", "u"), (4, "other", "q", None, "u"), (5, "other", "r", None, "u")], "ord long, type string, product_id string, subtype string, url string")
    assert sorted(r.ord for r in A.distinct_assets(rows).collect()) == [1, 2, 4]
    entries = spark.createDataFrame([("u", True, 1), ("v", False, 2)], "url string, downloaded boolean, ord long")
    assert [r.url for r in A.failures(entries).collect()] == ["v"]
    assert [r.ord for r in A.to_fetch(rows, manifest.latest_entries(entries)).collect()] == []
