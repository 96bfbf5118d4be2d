"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles (lower case A-Z). Two permutations make all signature coordinates: the
first sends a shingle to a place of a circle, the second, read from that place on, gives its value under each circular
shift; coordinate k is the least value under shift k. Bands of coordinates are the bucket keys.

Equal sets fall into one class first, so copies never pair with each other. In each bucket all classes are held against
the one that shares most bucket places with others, its leader; verified links join classes into components. Only where
a bucket then still spans several components are its other pairs formed, each in the first such bucket that both share,
between components alone and where an exact bound allows a link: what two classes have in common lies in their leader
(less what a mask shows that either lacks of it) or outside it, among the shingles that another component holds too. So
all links between components that banding offers are confirmed on full sets, while a group of thousands of near copies
costs a pair for each member, not for each two.

The joins are sort-merge joins at every size: nothing is broadcast that grows with the data.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text with fewer words than
a shingle has its whole sequence as its one shingle; each row is judged by its own text, also where rows share a doc_id
or have none; a component is named by its smallest doc_id, and by null where it has none; ``stays`` marks one row of each
component (the smallest doc_id, then the smallest hash of the text; rows equal in both are marked alike); equal rows have
equal results; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovex.llm import textkit as tk
from trovex.llm.components import components
from trovex.llm.runtime import in_worker, materialize, ship, table

ROWS = 4
BANDS = 25
CIRCLE = 1 << 19
MASK = 4
NO_ID = (1 << 63) - 1
LACKS = [f"lacks_{k}" for k in range(MASK)]
_values: dict[tuple[int, int], np.ndarray] = {}


def _circle(circle: int, k: int) -> np.ndarray:
    """Row p holds the second permutation's values at places p .. p+k-1 of the circle (a view)."""
    if (circle, k) not in _values:
        second = np.random.default_rng(7919).permutation(circle).astype(np.uint32)
        _values[circle, k] = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:k]]), k)
    return _values[circle, k]


def shingle_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, ascending within a text, and their first positions (len+1)."""
    w = tk.words(col, lower=True)
    h, count = w.hashes(), w.count.astype(np.int64)
    doc = w.doc()
    shingle = np.zeros(len(h), np.uint64)
    left = w.first[1:][doc] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)
    for j in range(n):
        step = np.zeros(len(h), np.uint64)
        if j < len(h):
            step[: len(h) - j] = h[j:]
        step[left <= j] = 0x5851F42D4C957F2D  # past the end of a text that is shorter than a shingle
        shingle = tk.mix(shingle * np.uint64(0x2545F4914F6CDD1D) + step + np.uint64(j))
    whole = count[doc] < n
    keep = np.where(whole, left == count[doc], left >= n)
    shingle, doc = shingle[keep], doc[keep]
    order = np.argsort(shingle)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(count) < 65536 else doc[order], kind="stable")]
    shingle, doc = shingle[order], doc[order]
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    shingle, doc = shingle[fresh], doc[fresh]
    return shingle, np.searchsorted(doc, np.arange(len(count) + 1))


def _totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=acc[1:])
    return acc[first[1:]] - acc[first[:-1]]


def signatures(shingle: np.ndarray, first: np.ndarray, k: int, circle: int = CIRCLE) -> np.ndarray:
    """len(first)-1 rows of k coordinates; the largest value where the set is empty."""
    rows = _circle(circle, k)
    place = (tk.mix(shingle ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(circle)).astype(np.int64)
    out = np.full((len(first) - 1, k), 0xFFFFFFFF, np.uint32)
    at = first.tolist()
    for d in range(len(at) - 1):
        for a in range(at[d], at[d + 1], 4096):
            np.minimum(out[d], rows[place[a : min(a + 4096, at[d + 1])]].min(axis=0), out=out[d])
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band, with the band's number in it."""
    bands = sig.shape[1] // rows
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = tk.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r].astype(np.uint64))
        out[:, b] = h
    return out


def _signed(docs: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text", 2 << 20):
                shingle, first = shingle_sets(part.column(1), n)
                size = np.diff(first)
                keys = band_keys(signatures(shingle, first, rows * bands), rows)
                keys = keys[size > 0].view(np.int64)
                at = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(size.astype(np.int64)),
                        pa.array(_totals(tk.mix(shingle), first).view(np.int64)),
                        pa.array(_totals(tk.mix(shingle ^ np.uint64(0xBB67AE8584CAA73B)), first).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "row", "n_shingles", "set_a", "set_b", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row")).mapInArrow(lambda batches: in_worker("minhash", run)(batches), "doc_id long, row long, n_shingles long, set_a long, set_b long, bands array<long>")


def _sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, set): the full shingle sets of the classes in ``nodes`` (node, doc, row), from a text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text", 2 << 20):
                shingle, first = shingle_sets(part.column(1), n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(shingle.view(np.int64)))], names=["node", "set"])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text")
    wanted = keyed.join(nodes.hint("merge"), ["doc", "row"]).select("node", "text")
    # rows equal in doc_id and text come more than once
    return materialize(wanted.mapInArrow(lambda batches: in_worker("minhash", run)(batches), "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set")))


def _bits(shingles: Column, word: int) -> Column:
    """Word ``word`` of a mask of 64 * MASK bits with a bit for each of ``shingles``; its bits are never more than they are."""
    one = lambda h: F.call_function("shiftleft", F.expr("1L"), h.bitwiseAND(F.lit(63)).cast("int"))
    mine = lambda h: F.pmod(F.shiftrightunsigned(h, 6), F.lit(MASK)) == word
    return F.aggregate(F.filter(shingles, mine), F.expr("0L"), lambda acc, h: acc.bitwiseOR(one(h)))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with inter and union of their full sets, a mask of what b lacks of a, and whether they are linked."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    lacks = [_bits(F.array_except("sa", "sb"), k).alias(f"lacks_{k}") for k in range(MASK)]
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("inter"), (F.size("sa") + F.size("sb")).cast("long").alias("total"), *lacks)
    return both.select("a", "b", "inter", *LACKS, (F.col("total") - F.col("inter")).alias("union"), (100 * F.col("inter") >= percent * (F.col("total") - F.col("inter"))).alias("linked"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row, stays) for each row of ``docs`` (doc_id, text): linked at ``percent`` Jaccard or more; row is the text's xxhash64."""
    spark = docs.sparkSession
    ship(spark)
    signed = materialize(_signed(docs, shingle_words, rows, bands))
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "row")
    classes = signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(place).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # written at once, so each class keeps its number
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    bucket = materialize(classes.select("node", "n", F.explode("bands").alias("key")))
    shared = bucket.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    crowd = materialize(bucket.join(shared.hint("merge"), "key"))
    # the class that shares its buckets with most others is the likeliest to be linked with all of them
    central = crowd.groupBy("node").agg(F.sum("members").alias("central"))
    leaders = crowd.join(central.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("central", -F.col("node"), "node", "n")).alias("top"))
    leaders = leaders.select("key", F.col("top.node").alias("leader"), F.col("top.n").alias("leader_n"))
    star = materialize(crowd.drop("members").join(leaders.hint("merge"), "key").where("node != leader"))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    pairs = materialize(star.where(fits(F.col("n"), F.col("leader_n"))).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    nodes = star.select(F.col("leader").alias("node")).unionByName(star.select("node")).distinct()
    nodes = classes.select("node", "first.doc", "first.row").join(nodes.hint("merge"), "node", "left_semi")
    sets = _sets_of(docs, nodes, shingle_words)
    first = materialize(_verify(pairs, sets, percent))
    edges = first.where("linked").select("a", "b")
    labels = components(edges)

    # Buckets that still span several components: their other pairs, between components only.
    labelled = star.join(labels.withColumnRenamed("label", "of_node").hint("merge"), "node", "left").withColumn("of_node", F.coalesce("of_node", "node"))
    lead = labels.select(F.col("node").alias("leader"), F.col("label").alias("of_leader"))
    labelled = labelled.join(lead.hint("merge"), "leader", "left").withColumn("of_leader", F.coalesce("of_leader", "leader"))
    held = first.select(F.col("a").alias("leader"), F.col("b").alias("node"), "inter", *LACKS)
    labelled = labelled.join(held.hint("merge"), ["leader", "node"], "left").select("key", "node", "n", "of_node", "leader", "leader_n", "of_leader", "inter", *LACKS)
    labelled = materialize(labelled)
    spread = labelled.groupBy("key").agg(F.min("of_node").alias("lo"), F.max("of_node").alias("hi")).where("lo != hi").select("key")
    open_rows = materialize(labelled.join(spread.hint("merge"), "key", "left_semi"))
    # a shingle that only one component holds is in no intersection across components
    own = open_rows.select("node", "of_node").unionByName(open_rows.select(F.col("leader").alias("node"), F.col("of_leader").alias("of_node"))).distinct()
    members = sets.join(own.hint("merge"), "node").select("node", "of_node", F.explode("set").alias("shingle"))
    inner = members.groupBy("shingle").agg(F.min("of_node").alias("lo"), F.max("of_node").alias("hi")).where("lo = hi").select("shingle")
    alone = materialize(members.join(inner.hint("merge"), "shingle").groupBy("node").agg(F.count("*").alias("alone")))
    of_lead = alone.select(F.col("node").alias("leader"), F.col("alone").alias("lead_alone"))
    # the open buckets of a class; two classes meet in the first that they share, not in each
    doors = open_rows.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("doors"))
    open_rows = open_rows.join(alone.hint("merge"), "node", "left").join(doors.hint("merge"), "node").join(of_lead.hint("merge"), "leader", "left")
    alone_out = F.coalesce("alone", F.lit(0)) - F.when(F.col("of_node") == F.col("of_leader"), F.coalesce("lead_alone", F.lit(0))).otherwise(0)
    shared, outside = F.col("n") - F.coalesce("alone", F.lit(0)), F.col("n") - F.col("inter") - F.greatest(F.lit(0), alone_out)
    open_rows = materialize(open_rows.select("key", "node", "n", "of_node", "leader_n", "inter", *LACKS, "doors", shared.alias("shared"), outside.alias("outside")))
    x = open_rows.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("of_node").alias("ca"), F.col("shared").alias("qa"), F.col("inter").alias("ia"), F.col("outside").alias("ra"), F.col("doors").alias("da"), *[F.col(c).alias(f"{c}_a") for c in LACKS], "leader_n")
    y = open_rows.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("of_node").alias("cb"), F.col("shared").alias("qb"), F.col("inter").alias("ib"), F.col("outside").alias("rb"), F.col("doors").alias("db"), *[F.col(c).alias(f"{c}_b") for c in LACKS])
    # what two classes have in common lies in their leader, less what either lacks of it, or in both rests outside that other components hold too
    lacked = reduce(add, [F.bit_count(F.col(f"{c}_a").bitwiseOR(F.col(f"{c}_b"))) for c in LACKS])
    common = F.least("qa", "qb", F.least("ia", "ib", F.col("leader_n") - lacked) + F.least("ra", "rb"))
    enough = 100 * common >= percent * (F.col("na") + F.col("nb") - common)
    here = F.array_min(F.array_intersect("da", "db")) == x["key"]
    more = x.join(y.hint("merge"), (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits(F.col("na"), F.col("nb")) & enough & here)
    more = materialize(more.select("a", "b").distinct().join(first.select("a", "b").hint("merge"), ["a", "b"], "left_anti"))
    if more.limit(1).count():
        second = _verify(more, sets, percent).where("linked").select("a", "b")
        second = materialize(second)
        if second.limit(1).count():
            labels = components(edges.unionByName(second))

    linked = classes.select("node", "first").join(labels.hint("merge"), "node")
    heads = linked.groupBy("label").agg(F.min("first").alias("head"))
    heads = linked.select("node", "label").join(heads.hint("merge"), "label").select("node", "head")
    named = classes.select("node", "set_a", "set_b", "first").join(heads.hint("merge"), "node", "left").select("set_a", "set_b", F.coalesce("head", "first").alias("head"))
    found = signed.select("doc_id", "row", "n_shingles", "set_a", "set_b").join(named.hint("merge"), ["set_a", "set_b"], "left")
    some = F.col("n_shingles") > 0
    component = F.when(~some, F.col("doc_id")).when(F.col("head.doc") != NO_ID, F.col("head.doc"))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"), "row", (~some | (place == F.col("head"))).alias("stays"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row", "stays")


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4).drop("row", "stays")
