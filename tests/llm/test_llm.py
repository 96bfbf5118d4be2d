"""The training-text operators against brute force, the public library, round trips and held-out rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovex.llm import bpe_prefix, flac_media, lang_centroid, lattice_lm, line_join, minhash_circulant, mix_pivotal, pii_feistel, quality_suffix, toxic_ftrl
from trovex.llm import textkit as tk
from trovex.llm.runtime import table, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, `node` string"


def odd_rows():
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(30000))
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, " \n\t "), (None, "a b c d e f"), (None, None), (6, long), (7, long + " end"), (8, "é ß 漢字 \U0001f600"), (9, "x")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 2 else "s", None, "kept", "n") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


APPLY = {
    "quality": lambda d: quality_suffix.suffix_repetition(d),
    "mix": lambda d: mix_pivotal.pivotal_mix(d),
    "flac": lambda d: flac_media.block_digests(flac_media.pcm_columns(flac_media.flac_encode(d))),
    "bpe": lambda d: bpe_prefix.bpe_encode(d),
    "lattice": lambda d: lattice_lm.lattice_scores(d),
    "minhash": lambda d: minhash_circulant.near_duplicates(d),
    "pii": lambda d: pii_feistel.pseudonymise(d, "k"),
    "lines": lambda d: line_join.drop_similar_lines(d, cell_bits=10, place_bits=10),
    "lang": lambda d: lang_centroid.identify(d, lang_centroid.fit(d, sample=20)),
    "toxic": lambda d: toxic_ftrl.score_texts(d, *toxic_ftrl.fit(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic"))),
}


@pytest.mark.parametrize("name", APPLY)
def test_odd_and_empty_tables(odd, name):
    rows = APPLY[name](odd).collect()
    if name == "lines":  # 1 and both rows of 2: the first stays; what is wholly repeated goes
        assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 3, 4, 5, 6, 8, 9]
    else:
        assert len(rows) == len(odd_rows())
    assert APPLY[name](odd.limit(0)).count() == 0


def brute_repeats(w):
    n = len(w)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_suffix_repeats():
    rng = random.Random(1)
    docs = [" ".join(rng.choice("ab c ab dd".split()) for _ in range(rng.randint(0, 50))) for _ in range(40)] + ["", "a a a a a a"]
    w = tk.words(pa.array(docs))
    best = quality_suffix.longest_repeats(w.hashes(), w.doc())
    for i, d in enumerate(docs):
        assert best[w.first[i] : w.first[i + 1]].tolist() == brute_repeats(d.split())
    assert quality_suffix.spans("x " + "a b c d e f g h " * 2 + "y") == [(1, 17)]


def test_mix_comes_near_its_targets(spark):
    docs = table(spark, SF, "documents")
    a = mix_pivotal.pivotal_mix(docs).toPandas()
    b = mix_pivotal.pivotal_mix(docs.repartition(7)).toPandas()
    assert sorted(zip(a.doc_id, a.taken)) == sorted(zip(b.doc_id, b.taken))
    assert (a.taken <= 2 * a["size"]).all()
    assert a.groupby("source").target.first().sum() == pytest.approx(1.5 * a["size"].sum())
    for _, g in a.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()


def test_lines_against_brute_force(spark, texts):
    import duckdb

    got = {r.doc_id: tuple(r)[1:] for r in line_join.op3_similar_lines(spark, SF).collect()}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == {r[0]: r[1:] for r in c.execute(line_join.OP3_SQL).fetchall()}


def sql_lines(rows):
    import duckdb

    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    return sorted(c.execute(line_join.OP3_SQL).fetchall(), key=str)


def family_rows():
    """Groups of near-equal lines, blank lines, rows without an id and rows that share one."""
    rng = random.Random(2)
    base = [[f"w{f}_{i}" for i in range(40)] for f in range(3)] + [[f"long{i}" for i in range(130)]]
    rows = []
    for i in range(240):
        lines = []
        for _ in range(2):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(300)}"
            lines.append(" ".join(w[: rng.randint(len(w) - 10, len(w))]))
        rows.append((rng.choice([None, i, i // 2]), "\n".join([*lines, "x y", "", "  x\ty  z"])))
    return rows + [(None, None), (5, ""), (5, " \t"), (7, None), (8, "a b"), (8, "a b")]


def test_line_links_of_large_groups(spark):
    rows = family_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in line_join.line_links(docs, hot=8, cell_bits=10, place_bits=10).collect()), key=str) == sql_lines(rows)
    sure = {(r.doc, r.row, r.line): r.removed for r in line_join.similar_lines(docs, hot=8, cell_bits=10, place_bits=10).collect()}
    assert sure == {(r.doc, r.row, r.line): r.removed for r in line_join.similar_lines(docs, hot=8, cell_bits=10, place_bits=10, links=False).collect()}


def test_lines_of_rows_without_or_with_one_id(spark):
    rows = [(1, "dup line alpha beta gamma"), (None, "dup line alpha beta gamma"), (None, "wholly unique words that nobody else has"), (2, "dup line alpha beta gamma"), (2, "other words of the same id\ndup line alpha beta gamma")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _gone int, _doc int")
    got = line_join.drop_similar_lines(docs, cell_bits=10, place_bits=10)
    assert got.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in got.collect()), key=str) == [(1, "dup line alpha beta gamma"), (2, "other words of the same id"), (None, "wholly unique words that nobody else has")]


def test_flac_round_trip_and_damage(texts):
    col = pa.array([*list(texts.values())[:40], None, "", "é" * 3000, "a" * 2000])
    size, payload = flac_media.payloads(col)
    media = flac_media.encode_streams(payload)
    assert [p for p, _ in flac_media.decode_streams(media)] == payload
    s = media[0]
    total, at, digest, seek = flac_media._open(s)
    bare = b"fLaC\x80" + s[5:42] + s[at:]
    assert flac_media.decode_streams([bare])[0][0] == payload[0]
    for k in range(at, len(s), 211):
        hurt = bytearray(s)
        hurt[k] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac_media.decode_streams([bytes(hurt)])


def test_flac_predictors_partitions_and_blocks(spark, texts):
    x = np.frombuffer(b"".join(flac_media.payloads(pa.array(list(texts.values())[:20]))[1]), np.uint8).reshape(-1, flac_media.BLOCK).astype(np.int32) - 128
    for partitions in (0, 1, 4):
        frames = flac_media.encode_frames(x, np.zeros(len(x), np.int64), partitions)
        data = np.frombuffer(b"".join(frames), np.uint8)
        start = np.cumsum([0, *map(len, frames[:-1])])
        assert (data[start + 6] >> 1 >= 32).any()  # some frames are LPC
        assert (flac_media.decode_frames(data, start)[0] == x).all()
    docs = spark.createDataFrame([(1, "é" * 700), (None, None), (3, "x")], "doc_id long, text string")
    blocks = flac_media.pcm_blocks(flac_media.flac_encode(docs)).collect()
    by_doc = collections.defaultdict(list)
    for r in sorted(blocks, key=lambda r: r.block):
        assert r.sample_offset == r.block * flac_media.BLOCK and len(r.pcm) == flac_media.BLOCK
        by_doc[r.doc_id].append(r.pcm)
    for i, t in ((1, "é" * 700), (None, ""), (3, "x")):
        raw = t.encode()
        assert b"".join(by_doc[i]) == raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    media = flac_media.flac_encode(docs).where("doc_id = 1").first().media
    third = next(r for r in blocks if r.doc_id == 1 and r.block == 2)
    one, _ = flac_media.decode_frames(np.frombuffer(media[third.byte_offset :], np.uint8), np.array([0]), np.array([2]))
    assert (one[0] + 128).astype(np.uint8).tobytes() == third.pcm
    for r in flac_media.op4_flac_columns(spark, SF).limit(30).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_quality_columns_against_brute_force(spark, texts):
    stutter = " ".join(w for w in "one two three four five six".split() for _ in range(7))
    rows = [*list(texts.items())[:80], (9001, stutter), (9002, None), (9003, "a\nb\na\n\n \n" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in quality_suffix.suffix_repetition(docs).collect():
        t = dict(rows)[r.doc_id] or ""
        w = t.split()
        windows = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        inside = {j + k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        if len(w) < 400:
            best = brute_repeats(w)
            cover = {j + k for j, b in enumerate(best) if b >= 4 for k in range(b)}
            assert (r.covered_words, r.longest_repeat) == (len(cover), max(best, default=0))
            assert r.kept == (not r.base_failed and len(cover) <= 0.3 * len(w) and max(best, default=0) <= 0.25 * len(w))
        if r.doc_id == 9001:  # the method decides: no window of eight words repeats
            assert not r.base_failed and not r.kept


def test_mix_targets_by_hand(spark):
    docs = table(spark, SF, "documents")
    got = mix_pivotal.op2_pivotal_mix(spark, SF).toPandas()
    size, source = {}, {}
    for r in docs.select("doc_id", "text", "source").collect():
        size[r.doc_id], source[r.doc_id] = len((r.text or "").encode().split()), r.source
    names = sorted({x for x in source.values() if x is not None}) + ([None] if None in source.values() else [])
    whole = {n: sum(size[i] for i in size if source[i] == n) for n in names}
    weight = {n: (5.0, 2.0, 1.0)[k % 3] for k, n in enumerate(names)}
    target, rest, open_ = {}, 1.5 * sum(whole.values()), set(names)
    while open_:
        level = rest / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * level > 2 * whole[n]}
        for n in full or open_:
            target[n] = 2.0 * whole[n] if full else weight[n] * level
        if not full:
            break
        rest -= sum(2.0 * whole[n] for n in full)
        open_ -= full
    for r in got.itertuples():
        assert (r.size, r.source_size) == (size[r.doc_id], whole[source[r.doc_id]]) and r.target == pytest.approx(target[source[r.doc_id]])


def test_mix_of_many_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b c", "s")] * 700 + [(1, "a b c d", "t")], "doc_id long, text string, source string")
    got = mix_pivotal.pivotal_mix(docs, bucket=16).toPandas()
    s = got[got.source == "s"]
    assert len(s) == 700 and abs(s.taken.sum() - s.target.iloc[0]) <= 3 and s.taken.max() <= 6


def test_language_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.lang for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = [r for r in lang_centroid.op5_nearest_centroid(spark, sf).collect() if r.held_out]
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in rows]) > 0.98
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = [r for r in toxic_ftrl.op8_ftrl_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    pos = [r.score for r in rows if labels[r.doc_id] == 1]
    neg = [r.score for r in rows if labels[r.doc_id] == 0]
    assert np.mean([p > n for p in pos for n in neg]) > 0.9
    assert np.mean([n >= 0.5 for n in neg]) < 0.01


def luhn(d):
    return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111111111111112"]
    text = "born 2001-02-28, 31.12.1999, 30.02.2000; ssn 123-45-6789; mail ab.c9@x.example.com; ip 10.0.0.1; tel +1 (212) 555-7713; " + "; ".join(cards)
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "plain 7 words")], "doc_id long, text string")
    a, b, c, d = (r.text for r in pii_feistel.pseudonymise(docs, "k").orderBy("doc_id").collect())
    assert a == b and c is None and d == "plain 7 words"
    for old in ("2001-02-28", "31.12.1999", "123-45-6789", "ab.c9", "10.0.0.1", "555-7713", *cards[:3]):
        assert old not in a
    assert "30.02.2000" in a and cards[3] in a and "@x.example.com" in a
    new = [x.strip() for x in a.split(";")[-4:-1]]
    digits = {x.replace(" ", "").replace("-", "") for x in new}
    assert len(digits) == 1 and luhn(digits.pop())
    days = spark.range(0, 73049, 7).select(F.date_add(F.to_date(F.lit("1900-01-01")), F.col("id").cast("int")).cast("string").alias("d"))
    assert days.select(pii_feistel.pseudonym(F.col("d"), "k").alias("n")).distinct().count() == days.count()


def plain_feistel(symbols, tweak, key):
    """The network again, in plain Python."""
    import hmac

    v = list(symbols)
    half = len(v) // 2
    for r in range(1, pii_feistel.ROUNDS + 1):
        first = r % 2 == 1
        seen = ",".join(str(x) for x, _ in (v[half:] if first else v[:half]))
        for i in range(half) if first else range(half, len(v)):
            digest = hmac.new(hashlib.sha256(key.encode()).digest(), f"{tweak}|{r}|{i}|{seen}".encode(), hashlib.sha256).hexdigest()
            v[i] = ((v[i][0] + int(digest[:12], 16)) % v[i][1], v[i][1])
    return [x for x, _ in v]


def test_pseudonyms_against_plain_python(spark):
    import datetime

    rows = [("10.1.2.3",), ("2001-02-28",), ("31.12.1999",), ("12/31/1999",), ("123-45-6789",)]
    got = {r.m: r.x for r in spark.createDataFrame(rows, "m string").select("m", pii_feistel.pseudonym(F.col("m"), "k").alias("x")).collect()}
    assert got["10.1.2.3"] == ".".join(map(str, plain_feistel([(int(x), 256) for x in "10.1.2.3".split(".")], "ip", "k")))

    def day(d):
        n = (d - datetime.date(1900, 1, 1)).days
        a, b = plain_feistel([(n // 4297, 17), (n % 4297, 4297)], "date", "k")
        return datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)

    assert got["2001-02-28"] == day(datetime.date(2001, 2, 28)).isoformat()
    last = day(datetime.date(1999, 12, 31))
    assert got["31.12.1999"] == last.strftime("%d.%m.%Y") and got["12/31/1999"] == last.strftime("%m/%d/%Y")
    a, b, c = plain_feistel([(122, 898), (44, 99), (6788, 9999)], "ssn", "k")
    assert got["123-45-6789"] == f"{a + 1 + (a + 1 >= 666):03d}-{b + 1:02d}-{c + 1:04d}"


def test_pseudonyms_of_long_values_and_clashing_columns(spark):
    rows = [(1, "mail a@b" + ".c" * 100_000, 7, "x"), (2, "a@" + "b-" * 100_000 + ".com", 7, "x"), (3, "1" * 100_000, 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_replaced int, _swapped string")
    got = pii_feistel.pseudonymise(docs, "k").orderBy("doc_id").collect()
    assert [(r.n_replaced, r._swapped, r._n_replaced) for r in got] == [(7, "x", 1), (7, "x", 1), (7, "x", 0)]
    assert got[0].text.endswith(".c" * 100_000) and got[2].text == rows[2][1]


def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    path = tokenizer_path(bpe_prefix.VOCABULARY)
    want, mine = Tokenizer.from_file(path), bpe_prefix.codec(path)
    rng = random.Random(3)
    pool = "abcdehiABstΣσςİßéÉñ  \t\n\x1c\x85'’!?.,012½²漢字가\U0001f642́‍\x00_-<|>'s"
    odd = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) + rng.choice(["", "", "<|endoftext|>x"]) for _ in range(3000)]
    for t in [*texts.values(), *odd]:
        ids = want.encode(t, add_special_tokens=False).ids
        assert mine.encode(t.encode()) == ids
        assert mine.decode(ids) == want.decode(ids, skip_special_tokens=False)


def test_lattice_sums_all_segmentations():
    p = lattice_lm.Pieces([bytes([b]) for b in range(256)] + [lattice_lm.MARK + b"a", b"ab", b"b" * 3], np.log(np.full(259, 1 / 259)))

    def total(raw):
        return sum(total(raw[n:]) / 259 for n in range(1, len(raw) + 1) if raw[:n] in p.number) if raw else 1.0

    words = [b"a", b"abab", b"bbbb", b"x" * 60, lattice_lm.END]
    got = lattice_lm.log_marginals(words, p)
    for w, g in zip(words[:3], got):
        assert g == pytest.approx(math.log(total(lattice_lm.MARK + w)))
    assert got[3] == pytest.approx(63 * math.log(1 / 259)) and got[4] == 0
    assert lattice_lm.expected_counts([b"ab"], np.array([2.0]), p).sum() > 4
    # short and long words teach alike
    many = lattice_lm.expected_counts([b"ab" * 23, b"ab" * 30], np.array([1.0, 1.0]), p)
    assert many[p.number[b"ab"]] == pytest.approx(sum(lattice_lm.expected_counts([b"ab" * n], np.array([1.0]), p)[p.number[b"ab"]] for n in (23, 30)))


def test_vocabulary_scores_weigh_the_pieces(spark, texts):
    p = lattice_lm.Pieces.load(tokenizer_path(lattice_lm.VOCABULARY))
    assert np.exp(p.logp).sum() == pytest.approx(1)
    at, he = p.number["▁t".encode()], p.number[b"he"]  # their scores are -2 and -6
    assert p.logp[at] - p.logp[he] == pytest.approx(4 / lattice_lm.TEMPERATURE)
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    n = sum(len((t or "").encode().split()) + 1 for t in train)
    stop = (len(train) + 0.5) / (n + 1)
    for r in lattice_lm.lattice_scores(table(spark, SF, "documents")).limit(20).collect():
        words = texts[r.doc_id].encode().lower().split()
        want = lattice_lm.log_marginals(words, p).sum() + len(words) * math.log(1 - stop) + math.log(stop)
        assert r.score == pytest.approx(want / math.log(10))


def test_lattice_base_scores(spark, texts):
    tokens = {i: (t or "").encode().lower().split() + [b" "] for i, t in texts.items()}
    c = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in lattice_lm.lattice_scores(table(spark, SF, "documents"), chunk_tokens=5000).collect():
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[j : j + n]) for j in range(len(w) - n + 1)])


def brute_components(texts, n, percent=80):
    sets, parent = {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}, sets


def test_near_duplicates_against_brute_force(spark, texts):
    want, sets = brute_components(texts, 4)
    got = minhash_circulant.op10_circulant_minhash(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_group_of_many_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(80)] = f"e{i}-{rng.random()}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_circulant.near_duplicates(docs, shingle_words=4).collect()}
    assert got == brute_components(texts, 4)[0]


def test_near_duplicates_of_rows_without_or_with_one_id(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(5, near), (None, near + " x"), (None, near), (7, "quite other words " * 9), (7, near + " y"), (None, "alone in its text " * 8), (None, "alone in its text " * 8 + "z"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.stays) for r in minhash_circulant.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5, True), (None, 5, False), (None, 5, False), (7, 7, True), (7, 5, False), (9, 9, True), (9, 9, True)] + [(None, None, True), (None, None, False)], key=str)


def test_pipeline_stages_on_odd_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcde"]
    rows = [(1, good[0]), (None, good[0]), (2, good[1]), (2, good[2]), (None, good[3]), (None, good[4]), (None, good[4]), (3, None), (4, ""), (None, "too short")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _copies int, `node` string")
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)

    def out(stage):
        got = stage(spark, docs, SF)
        assert stage is five or got.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        return sorted(((r.doc_id, r.text) for r in got.select("doc_id", "text").collect()) if stage is not five else ((r.doc_id, r.n_tokens) for r in got.collect()), key=str)

    assert out(one) == sorted(rows[:7], key=str)
    equal = [rows[k] for k in (0, 2, 3, 4, 7, 8, 9)]
    assert out(two) == sorted([*equal, rows[5], rows[6]], key=str)  # rows equal in id and text stay together
    assert out(three) == sorted([*equal, rows[5]], key=str)
    mixed = collections.Counter(out(four))
    assert sum(len(t.split()) * n for (_, t), n in mixed.items() if t and t != "too short") == pytest.approx(1.5 * 7 * 40 + 3, abs=40)
    assert mixed[(3, None)] == mixed[(4, "")] == 1 and max(mixed.values()) <= 4  # two equal rows, each taken twice at most
    assert len(out(five)) == len(rows) and (3, 0) in out(five)


def test_pipeline_against_brute_force(spark, texts):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import duckdb

    docs = table(spark, SF, "documents")
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)
    kept = one(spark, docs, SF)
    judged = {r.doc_id for r in quality_suffix.suffix_repetition(docs).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == judged
    for i in sorted(texts)[:60]:  # base rules by hand
        w = texts[i].split()
        windows = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        inside = {j + k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(8)}
        if len(w) < 20 or 100 * len(inside) > 30 * len(w):
            assert i not in judged
    c = duckdb.connect()
    c.register("documents", kept.select("doc_id", "text").toPandas())
    gone = {r[0]: (r[1], {int(x) for x in r[3].split(",") if x}) for r in c.execute(line_join.OP3_SQL).fetchall() if r[1]}
    want = {i: "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone[i][1]) for i in judged if len(gone[i][1]) < gone[i][0]}
    lines = two(spark, kept, SF)
    assert {r.doc_id: r.text for r in lines.collect()} == want
    parts, _ = brute_components(want, 5)
    alone = three(spark, lines, SF)
    assert {r.doc_id for r in alone.collect()} == {i for i, p in parts.items() if i == p}
    assert alone.columns == docs.columns
    mixed = four(spark, alone, SF)
    copies = collections.Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(parts)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(bpe_prefix.VOCABULARY))
    for r in five(spark, mixed, SF).limit(40).collect():
        ids = t.encode(want[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
