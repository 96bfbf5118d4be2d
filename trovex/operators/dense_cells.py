"""Dot products of queries with documents, dealt out as cells: a part of the queries against a part of the documents, as matrices.

The number of cells follows from the row counts, so a cell's memory is bounded and cells spread over the cluster; a pair costs
multiplications and, for the scores themselves, a row. Rankings and metrics keep a cell's best rows only. Scores are rounded in
the cell as F.round would (half up, by the shortest decimal); near the middle between two values the dot product is added up
again in the order of the vector, as no other order must decide. A null vector, a null in one or unequal lengths give a null
score, which ranks last; rows without an id are in no pair.

Vectors may also be lists of (term, weight), for lexical scores: pairs without a common term are left out, sums have no order
that decides, and rows without an id count as one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_ROWS, DOC_ROWS = 2048, 8192
BLOCK_PAIRS = 1 << 18
NO_ID = -(1 << 63)
DENSE = {"id": "long", "v": "array<double>", "label": "long", "best": "double", "best_doc": "long"}
LEXICAL = {"id": "long", "terms": "array<string>", "v": "array<double>", "rels": "array<long>", "best": "double", "best_doc": "long"}


class Side:
    """Rows of one side of a cell in the order of their ids: ids, vectors padded to one width, their lengths (-1 without score), labels, marks."""

    def __init__(self, rows: pa.Table, width: int):
        rows = rows.sort_by("id")
        col = rows.column("v").combine_chunks()
        sizes = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = col.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        self.size = sizes.copy()
        some = np.maximum(sizes, 0)
        if flat.null_count:
            owner = np.repeat(np.arange(len(sizes)), some)
            holes = flat.is_null().to_numpy(zero_copy_only=False)
            self.size[owner[holes]] = -1
            values = np.where(holes, 0.0, values)
        self.vectors = np.zeros((len(sizes), width))
        self.vectors[np.arange(width) < some[:, None]] = values
        self.id = rows.column("id").to_numpy()
        self.label, self.has_label = self._plain(rows, "label")
        self.best, self.has_best = self._plain(rows, "best")
        self.best_doc, _ = self._plain(rows, "best_doc")
        self.norm, self.width = float(np.sqrt((self.vectors**2).sum(1).max(initial=0))), width
        self.finite = bool(np.isfinite(self.vectors).all())

    @staticmethod
    def _plain(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        col = rows.column(name).combine_chunks()
        return col.fill_null(0).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)


    def against(self, d: "Side", a: int, b: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Scores of the queries ``a`` to ``b``, which are null, and which pairs count: not those of one id."""
        s = self.vectors[a:b] @ d.vectors.T
        sizes = np.unique(np.concatenate([self.size[a:b], d.size]))
        null = None if len(sizes) == 1 and sizes[0] >= 0 else (self.size[a:b, None] != d.size) | (self.size[a:b, None] < 0)
        lo, hi = (np.searchsorted(d.id, self.id[a:b], side) for side in ("left", "right"))
        counts = None
        if (hi > lo).any():
            counts = np.ones(s.shape, bool)
            for i in np.flatnonzero(hi > lo):
                counts[i, lo[i] : hi[i]] = False
        return s, null, counts

    def exact(self, d: "Side", i: int, j: int, score: float) -> float:
        return _in_order(self.vectors[i], d.vectors[j])

    def relevant(self, d: "Side", rows: slice) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((self.label[rows, None] == d.label) & self.has_label[rows, None] & d.has_label)


class Terms:
    """One side of a cell with lists of terms and weights for vectors, and on the documents' side the queries they are relevant to."""

    finite, norm, width = False, 0.0, 0

    def __init__(self, rows: pa.Table, _: int):
        rows = rows.sort_by("id")
        self.id = rows.column("id").to_numpy()
        self.owner, self.term = self._lists(rows, "terms")
        self.weight = self._lists(rows, "v")[1].to_numpy(zero_copy_only=False)
        self.rel_doc, rel = self._lists(rows, "rels")
        self.rel_query = rel.to_numpy(zero_copy_only=False)
        self.best, self.has_best = Side._plain(rows, "best")
        self.best_doc, _ = Side._plain(rows, "best_doc")

    @staticmethod
    def _lists(rows: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
        col = rows.column(name).combine_chunks()
        return np.repeat(np.arange(len(col)), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), col.flatten()

    def against(self, d: "Terms", a: int, b: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        lo, hi = np.searchsorted(self.owner, [a, b])
        words = pc.unique(self.term[lo:hi])
        col = pc.index_in(self.term[lo:hi], words).to_numpy(zero_copy_only=False)
        at = pc.index_in(d.term, words).fill_null(-1).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(at >= 0)
        doc, at, weight = d.owner[held], at[held], d.weight[held]
        ask, has = np.zeros((b - a, len(words))), np.zeros((b - a, len(words)), np.float32)
        ask[self.owner[lo:hi] - a, col], has[self.owner[lo:hi] - a, col] = self.weight[lo:hi], 1
        score, shared = np.zeros((b - a, len(d.id))), np.zeros((b - a, len(d.id)), bool)
        step = max(1, (1 << 20) // max(1, len(words)))
        for first in range(0, len(d.id), step):
            last = min(first + step, len(d.id))
            x, y = np.searchsorted(doc, [first, last])
            tell, there = np.zeros((last - first, len(words))), np.zeros((last - first, len(words)), np.float32)
            tell[doc[x:y] - first, at[x:y]], there[doc[x:y] - first, at[x:y]] = weight[x:y], 1
            score[:, first:last], shared[:, first:last] = ask @ tell.T, has @ there.T > 0
        return score, None, shared

    def exact(self, d: "Terms", i: int, j: int, score: float) -> float:
        return score

    def relevant(self, d: "Terms", rows: slice) -> tuple[np.ndarray, np.ndarray]:
        ids = self.id[rows]
        i = np.minimum(np.searchsorted(ids, d.rel_query), len(ids) - 1)
        met = ids[i] == d.rel_query
        return i[met], d.rel_doc[met]


class Block:
    """Some queries against the documents of a cell: scores, which of them are null, and which pairs count (all, where that is None).
    Only the scores of pairs that may become rows are rounded."""

    def __init__(self, q, d, a: int, b: int, places: int):
        self.q, self.d, self.rows, self.places = q, d, slice(a, b), places
        self.score, self.null, self.counts = q.against(d, a, b)
        #: the order of the scores; NaN is above all numbers, null below, as is what does not count
        self.key = np.where(np.isnan(self.score), np.inf, self.score) if not (q.finite and d.finite) else self.score.copy()
        for mask in (self.null, None if self.counts is None else ~self.counts):
            if mask is not None:
                self.key[mask] = -np.inf
        #: scores this far apart may be equal when they are rounded
        self.reach = 1.01 * 10.0**-places + 1e-12

    def _of(self, mask: np.ndarray | None, i: np.ndarray, j: np.ndarray, default: bool) -> np.ndarray:
        return np.full(len(i), default) if mask is None else mask[i, j]

    def rounded(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s, unit = self.score[i, j], 10.0**self.places
        scaled = np.abs(s) * unit
        whole = np.floor(scaled)
        doubt = np.abs(scaled - whole - 0.5) <= unit * self.q.norm * self.d.norm * self.q.width * 1e-15 + scaled * 1e-15 + 1e-12
        whole += scaled - whole >= 0.5
        out = np.where(np.isfinite(s), np.copysign(whole / unit, s), s) + 0.0
        for n in np.flatnonzero(doubt & np.isfinite(s)):
            out[n] = _rounded(self.q.exact(self.d, self.rows.start + i[n], j[n], float(s[n])), self.places)
        return out

    def _keys(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``key`` by the rounded scores."""
        key = self.key[i, j]
        some = np.isfinite(key)
        key[some] = self.rounded(i[some], j[some])
        return key

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(np.ones(self.score.shape, bool) if self.counts is None else self.counts)

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, document) places of the ``k`` pairs of each query with the highest score, then the lowest id."""
        n = self.key.shape[1]
        least = np.partition(self.key, n - k, axis=1)[:, n - k] - self.reach if k < n else np.full(len(self.key), -np.inf)
        i, j = np.nonzero(self.key >= least[:, None])
        stays = self._of(self.counts, i, j, True)
        i, j = i[stays], j[stays]
        order = np.lexsort((j, -self._keys(i, j), i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, np.arange(len(self.key)))
        stays = np.arange(len(i)) - first[i] < k
        return i[stays], j[stays]

    def best_relevant(self) -> tuple[np.ndarray, np.ndarray]:
        """The best pair of each query that has a relevant document with a score."""
        i, j = self.q.relevant(self.d, self.rows)
        stays = self._of(self.counts, i, j, True) & ~self._of(self.null, i, j, False)
        i, j = i[stays], j[stays]
        top = np.full(len(self.key), -np.inf)
        np.maximum.at(top, i, self.key[i, j])
        near = self.key[i, j] >= top[i] - self.reach
        i, j = i[near], j[near]
        order = np.lexsort((j, -self._keys(i, j), i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        return i[first], j[first]

    def above(self) -> np.ndarray:
        """How many documents stand above each query's ``best``, itself included; 0 without one."""
        has, doc = self.q.has_best[self.rows], self.q.best_doc[self.rows]
        least = np.where(np.isnan(self.q.best[self.rows]), np.inf, self.q.best[self.rows])
        least = np.where(has, least, np.inf)
        n = (self.key > (least + self.reach)[:, None]).sum(1)
        i, j = np.nonzero((self.key >= (least - self.reach)[:, None]) & (self.key <= (least + self.reach)[:, None]))
        key = self._keys(i, j)
        more = (key > least[i]) | ((key == least[i]) & (self.d.id[j] <= doc[i]))
        return np.where(has, n + np.bincount(i[more], minlength=len(n)), 0)

    def batch(self, i: np.ndarray, j: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
        """Rows of pairs by their places."""
        score = pa.array(self.rounded(i, j), pa.float64(), mask=self._of(self.null, i, j, False))
        cols = {"query_id": _ids(self.q.id[self.rows][i]), "doc_id": _ids(self.d.id[j]), "score": score}
        return pa.RecordBatch.from_pydict(cols | more)


def _ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def _in_order(x: np.ndarray, y: np.ndarray) -> float:
    total = 0.0
    for p in (x * y).tolist():
        total += p
    return total


def _rounded(x: float, places: int) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0


def each_block(queries: DataFrame, docs: DataFrame, places: int, of_block: Callable[[Block], Iterator[pa.RecordBatch]], schema: str, query_rows: int = QUERY_ROWS, doc_rows: int = DOC_ROWS, rows: tuple[int, int] | None = None) -> DataFrame:
    """What ``of_block`` makes of all blocks of all cells. ``queries`` and ``docs`` are (id, v) and, if needed, label (whole numbers),
    best and best_doc; lexical ones (id, terms, v), documents with rels. ``rows`` are their row counts, where these are known."""
    lexical = "terms" in queries.columns
    columns, kind = (LEXICAL, Terms) if lexical else (DENSE, Side)
    full = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
    q, d = full(queries), full(docs)
    q, d = (x.withColumn("id", F.coalesce("id", F.lit(NO_ID))) if lexical else x.where("id is not null") for x in (q, d))
    asked, told = rows or (q.count(), d.count())
    across, down = max(1, -(-asked // query_rows)), max(1, -(-told // doc_rows))
    part = lambda n: F.pmod(F.xxhash64("id") if lexical else F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("a", part(across)).select(F.lit(True).alias("asks"), "a", every(down).alias("b"), *columns)
    d = d.withColumn("b", part(down)).select(F.lit(False).alias("asks"), every(across).alias("a"), "b", *columns)
    cells = q.unionByName(d).select((F.col("a") * down + F.col("b")).alias("cell"), "asks", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        width = pc.max(pc.list_value_length(rows.column("v"))).as_py() or 0
        asks = rows.column("asks")
        left, right = (kind(rows.filter(x), width) for x in (asks, pc.invert(asks)))
        if not len(left.id) or not len(right.id):
            return
        step = max(1, BLOCK_PAIRS // len(right.id))
        for a in range(0, len(left.id), step):
            yield from of_block(Block(left, right, a, min(a + step, len(left.id)), places))

    # generators of this form are told by their annotations, which must be the classes themselves
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return cells.repartition(2 * across * down, "cell").groupBy("cell").applyInArrow(run, schema)


_PAIR = "query_id long, doc_id long, score double"


def scores(queries: DataFrame, docs: DataFrame, places: int = 4, **cell) -> DataFrame:
    def all_pairs(x: Block) -> Iterator[pa.RecordBatch]:
        yield x.batch(*x.pairs())

    return each_block(queries, docs, places, all_pairs, _PAIR, **cell)


def top(queries: DataFrame, docs: DataFrame, k: int, places: int = 4, **cell) -> DataFrame:
    """The pairs among which each query's ``k`` best are: those of each cell."""

    def best(x: Block) -> Iterator[pa.RecordBatch]:
        yield x.batch(*x.best(k))

    return each_block(queries, docs, places, best, _PAIR, **cell)


def ranks(queries: DataFrame, docs: DataFrame, k: int, places: int = 4, **cell) -> DataFrame:
    """(query_id, first, ranking) for (id, v, label) rows, where documents of the query's label are the relevant ones: the rank of
    the best relevant document (null without one), and whether the documents of rank 1 to ``k`` are relevant."""

    def relevant(x: Block) -> Iterator[pa.RecordBatch]:
        yield x.batch(*x.best_relevant())

    def ranked(x: Block) -> Iterator[pa.RecordBatch]:
        i, j = x.best(k)
        shape = x.score.shape
        rel = np.isin(i * shape[1] + j, np.ravel_multi_index(x.q.relevant(x.d, x.rows), shape)) & ~x._of(x.null, i, j, False)
        yield x.batch(i, j, relevant=pa.array(rel), above=pa.nulls(len(i), pa.int64()))
        n = x.above()
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(x.q.id[x.rows]), "doc_id": none, "score": none.cast(pa.float64()), "relevant": none.cast(pa.bool_()), "above": pa.array(n.astype(np.int64))})

    found = each_block(queries, docs, places, relevant, _PAIR, **cell)
    found = found.groupBy(F.col("query_id").alias("id")).agg(F.max(F.struct("score", (-F.col("doc_id")).alias("o"))).alias("m"))
    asked = queries.join(found.select("id", F.col("m.score").alias("best"), (-F.col("m.o")).alias("best_doc")), "id", "left")
    rows = each_block(asked, docs, places, ranked, f"{_PAIR}, relevant boolean, above long", **cell)
    # nulls last: a struct's null field sorts below numbers
    placed = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("score").isNull().alias("n"), (-F.col("score")).alias("s"), "doc_id", "relevant"))
    per = rows.groupBy("query_id").agg(F.sum("above").alias("n"), F.slice(F.array_sort(F.collect_list(placed)), 1, k).alias("top"))
    return per.select("query_id", F.when(F.col("n") > 0, F.col("n")).alias("first"), F.transform("top", lambda x: x["relevant"]).alias("ranking"))
