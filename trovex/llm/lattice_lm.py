"""Language-model scores as the marginal likelihood of a subword lattice.

The pieces are those of an existing subword vocabulary, and its scores weigh them: a piece's log probability is its score
over a temperature, less the common log normaliser. (The vocabulary at hand scores a piece by minus its rank.) The score
of a word is the log of the summed probability of all its segmentations, by a forward recursion in log space; a text is
its words and one end. Every byte is also a piece, with the lowest score where the vocabulary has none, so that each word
has a segmentation. From the training texts come the word counts of the base score and how often a text ends.
``em_rounds`` re-estimates the piece weights from the training words by expectation-maximisation (forward-backward over
all segmentations) and adds the score under those weights as ``em_score``; the query leaves that out.

With ``word_rounds`` every training word is a piece of its own as well, an arc over the whole word, with the share of its
count less a discount; the discounts go to the segmentations into the vocabulary's pieces, whose weights are re-estimated
in so many rounds from the distinct training words, each once, as they stand for the words not met yet. That is a
distribution over words as before: a frequent word does not pay for being spelled, an unknown one still can be. The query
scores so, by two rounds; the vocabulary's weights alone know nothing of the corpus.

Texts are cut into chunks of a bounded number of tokens. Each distinct word of a chunk goes to the word table once, with
its training count; there a word is counted and scored once for the whole corpus, and its values go back, by a 64-bit
hash of the word, to the chunks that hold it, where the texts' sums are made from the chunk's own numbering. So texts
never travel, the lattice of a word is run once however often it occurs, and a frequent word costs a row for each chunk.
Nothing but the piece counts (if asked for) and three totals reaches the driver.

Defined results: a null or blank text is the end alone; rows without doc_id are not held out and are learned from; equal
texts have equal scores; without training texts the end has its prior probability of a half; words of any length are
scored, and learned from, alike; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.llm import textkit as tk
from trovex.llm.lang_centroid import fold_of
from trovex.llm.runtime import materialize, ship, table, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
CHUNK_TOKENS = 1_000_000
#: Chosen by the likelihood of training words.
TEMPERATURE = 6000.0
END = b" "  # no word holds a blank
MARK = "▁".encode()
LONG = 48
#: The file scores pieces that no merge makes with minus a milliard; they count as the lowest of the others.
NO_SCORE = -1e8
LN10 = math.log(10)
WORD_ROUNDS = 2


def _with_words(lattice: np.ndarray, count: np.ndarray, words: int, total: int, discount: float) -> np.ndarray:
    """Log probabilities of words that are pieces of their own beside their segmentations, from the log marginals ``lattice``
    and training counts: of ``total`` training words each of the ``words`` distinct ones leaves ``discount`` to the lattice."""
    if not total:
        return lattice
    own = np.full(len(count), -np.inf)
    np.log(count - discount, out=own, where=count > discount)
    return np.logaddexp(own, math.log(discount * words) + lattice) - math.log(total)


class Pieces:
    """Pieces as byte strings with log probabilities."""

    def __init__(self, text: list[bytes], logp: np.ndarray):
        self.text, self.logp = text, logp
        self.number = {t: i for i, t in enumerate(text)}
        self.longest = max(map(len, text))
        hashes = np.array([_hash_one(t) for t in text], np.uint64)
        order = np.argsort(hashes)
        self.sorted, self.order = hashes[order], order
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two pieces share a hash")

    @classmethod
    def load(cls, path: str, temperature: float = TEMPERATURE) -> "Pieces":
        """From a vocabulary file, with the weights that its scores give at ``temperature``."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        score: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                score.setdefault(sp.id_to_piece(i).encode(), sp.get_score(i))
        least = min(x for x in score.values() if x > NO_SCORE)
        score = {t: max(x, least) for t, x in score.items()} | {bytes([i]): least for i in range(256) if bytes([i]) not in score}
        logp = np.array(list(score.values())) / temperature
        return cls(list(score), logp - _log_sum(logp.tolist()))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _hash_one(t: bytes) -> int:
    h = 0
    for b in t:
        h = (h * int(_MULT) + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _arcs(b: np.ndarray, pieces: Pieces) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For words of one length, as rows of bytes: for each end, (start, rows, piece) of the pieces that stop there."""
    n, size = b.shape
    out: list[list] = [[] for _ in range(size + 1)]
    for start in range(size):
        h = np.zeros(n, np.uint64)
        for stop in range(start + 1, min(size, start + pieces.longest) + 1):
            h = h * _MULT + b[:, stop - 1] + np.uint64(1)
            piece = pieces.find(h)
            rows = np.flatnonzero(piece >= 0)
            if len(rows):
                out[stop].append((start, rows, piece[rows]))
    return out


def _forward(arcs: list, n: int, logp: np.ndarray) -> np.ndarray:
    alpha = np.full((len(arcs), n), -np.inf)
    alpha[0] = 0
    for stop in range(1, len(arcs)):
        for start, rows, piece in arcs[stop]:
            alpha[stop, rows] = np.logaddexp(alpha[stop, rows], alpha[start, rows] + logp[piece])
    return alpha


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def _long_alpha(raw: bytes, pieces: Pieces) -> list[float]:
    """The forward recursion for one long word."""
    alpha = [0.0]
    for stop in range(1, len(raw) + 1):
        terms = []
        for start in range(max(0, stop - pieces.longest), stop):
            i = pieces.number.get(raw[start:stop])
            if i is not None:
                terms.append(alpha[start] + pieces.logp[i])
        alpha.append(_log_sum(terms))
    return alpha


def _long_counts(raw: bytes, weight: float, pieces: Pieces, total: np.ndarray) -> None:
    """Adds one long word's expected pieces to ``total``: the word's arcs are met from its end, so only its two rows are held."""
    alpha = _long_alpha(raw, pieces)
    whole = alpha[-1]
    beta = [-math.inf] * len(raw) + [0.0]
    for start in range(len(raw) - 1, -1, -1):
        terms = []
        for stop in range(start + 1, min(len(raw), start + pieces.longest) + 1):
            i = pieces.number.get(raw[start:stop])
            if i is not None:
                via = pieces.logp[i] + beta[stop]
                terms.append(via)
                total[i] += math.exp(alpha[start] + via - whole) * weight
        beta[start] = _log_sum(terms)


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, their bytes with the word mark as rows) for each length up to LONG."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        if n <= LONG:
            which = np.array([i for i in np.flatnonzero(size == n) if words[i] != END], np.int64)
            if not len(which):
                continue
            rows = np.frombuffer(b"".join([MARK + words[i] for i in which]), np.uint8).reshape(len(which), n + len(MARK)).astype(np.uint64)
            yield which, rows


def log_marginals(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural log of each word's probability over all segmentations; 0 for END."""
    out = np.zeros(len(words))
    for which, rows in _by_length(words):
        out[which] = _forward(_arcs(rows, pieces), len(which), pieces.logp)[-1]
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = _long_alpha(MARK + w, pieces)[-1]
    return out


def expected_counts(words: list[bytes], count: np.ndarray, pieces: Pieces) -> np.ndarray:
    """How often each piece occurs in the words, expected over all segmentations."""
    total = np.zeros(len(pieces.logp))
    for which, rows in _by_length(words):
        arcs = _arcs(rows, pieces)
        alpha = _forward(arcs, len(which), pieces.logp)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        weight = count[which]
        for stop in range(len(arcs) - 1, 0, -1):
            for start, r, piece in arcs[stop]:
                via = pieces.logp[piece] + beta[stop, r]
                beta[start, r] = np.logaddexp(beta[start, r], via)
                np.add.at(total, piece, np.exp(alpha[start, r] + via - alpha[-1, r]) * weight[r])
    for i, w in enumerate(words):
        if len(w) > LONG:
            _long_counts(MARK + w, count[i], pieces, total)
    return total


def _packed(tokens: np.ndarray) -> bytes:
    """Token numbers, small ones more often, byte plane by byte plane and compressed."""
    planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(tokens).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _chunked(docs: DataFrame, most: int) -> DataFrame:
    """Chunks of texts: ids, folds and token counts of the texts, the tokens as numbers into the chunk's words, and the words with their training counts."""

    def flush(chunk: int, rows: list) -> pa.RecordBatch:
        ids, held, counts, hashes, where, raws = zip(*rows)
        h = np.concatenate(hashes)
        _, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        tokens = number[inverse].astype(np.uint32)
        base = np.concatenate([[0], np.cumsum([len(x) for x in hashes])])
        words = []
        for at in first[order].tolist():
            k = int(np.searchsorted(base, at, side="right")) - 1
            s, e = where[k][0][at - base[k]], where[k][1][at - base[k]]
            words.append(raws[k][s:e])
        count = np.concatenate(counts)
        held_all = np.concatenate(held)
        learned = np.bincount(tokens, np.repeat(~held_all, count), len(words)).astype(np.int64)
        words.append(END)
        learned = np.append(learned, int((~held_all).sum()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([chunk], pa.int64()),
                pa.array([np.concatenate([np.asarray(x, object) for x in ids]).tolist()], pa.list_(pa.int64())),
                pa.array([held_all.tolist()], pa.list_(pa.bool_())),
                pa.array([count.tolist()], pa.list_(pa.int64())),
                pa.array([_packed(tokens)], pa.binary()),
                pa.array([words], pa.list_(pa.binary())),
                pa.array([learned.tolist()], pa.list_(pa.int64())),
            ],
            names=["chunk", "ids", "held", "counts", "tokens", "words", "learned"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                w = tk.words(part.column(2), lower=True)
                rows.append((part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False).astype(bool), w.count, w.hashes(), (w.start, w.end), w.data.tobytes()))
                size += len(w.start)
                if size >= most:
                    yield flush(chunk, rows)
                    chunk, rows, size = chunk + 1, [], 0
        if rows:
            yield flush(chunk, rows)

    held = F.coalesce(fold_of() == 1, F.lit(False)).alias("held")
    schema = "chunk long, ids array<long>, held array<boolean>, counts array<long>, tokens binary, words array<binary>, learned array<long>"
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(run, schema))


def _learn(words: DataFrame, pieces: Pieces, rounds: int, prior: float = 1000.0) -> Pieces:
    """Piece probabilities after ``rounds`` of expectation-maximisation over ``words`` (word, c); the vocabulary's weights count as ``prior`` occurrences in all."""
    first = np.exp(pieces.logp)
    for _ in range(rounds):
        now = pieces

        def run(batches: Iterator[pa.RecordBatch], now: Pieces = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now.logp))
            for batch in batches:
                total += expected_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float), now)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        got = words.where("c > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        total = first * prior
        for r in got:
            total[r["piece"]] += r["n"]
        pieces = Pieces(pieces.text, np.log(total / total.sum()))
    return pieces


def lattice_scores(docs: DataFrame, path: str | None = None, temperature: float = TEMPERATURE, em_rounds: int = 0, chunk_tokens: int = CHUNK_TOKENS, word_rounds: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (and em_score, if ``em_rounds``) for each row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    models = [Pieces.load(path or tokenizer_path(VOCABULARY), temperature)]
    chunks = _chunked(docs, chunk_tokens)
    cells = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "learned")).alias("at", "w")).select("chunk", "at", F.col("w.words").alias("word"), F.col("w.learned").alias("learned"))
    counted = materialize(cells.groupBy("word").agg(F.sum("learned").alias("c")))
    of_words = [F.count_if((F.col("c") == k) & (F.col("word") != F.lit(END))).alias(name) for k, name in ((1, "once"), (2, "twice"))]
    whole = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("ends"), *of_words).first()
    n, v, ends, once, twice = (int(whole[k] or 0) for k in ("n", "v", "ends", "once", "twice"))
    stop = (ends + 0.5) / (n + 1)  # the probability that a token is an end
    if em_rounds:
        models.append(_learn(counted, models[0], em_rounds))
    distinct, discount = v - (ends > 0), once / (once + 2 * twice) if once else 0.5
    by_word = word_rounds is not None
    if by_word:
        models[0] = _learn(counted.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", F.lit(1).cast("long").alias("c")), models[0], word_rounds)
    names = ["model", "em"][: len(models)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            stops = np.array([math.log(stop if w == END else 1 - stop) for w in words])
            found = [log_marginals(words, m) for m in models]
            if by_word:
                inner = np.array([w != END for w in words], bool)
                found[0][inner] = _with_words(found[0][inner], batch.column(1).to_numpy()[inner], distinct, n - ends, discount)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array((x + stops) / LN10) for x in found]], names=["word", "c", *names])

    scored = counted.mapInArrow(score, "word binary, c long, " + ", ".join(f"{x} double" for x in names))
    values = cells.select("chunk", "at", F.xxhash64("word").alias("h")).join(scored.select(F.xxhash64("word").alias("h"), "c", *names), "h").select(F.col("chunk").alias("of_chunk"), "at", "c", *names)
    fields = ["base_score", "score", "em_score"][: 1 + len(names)]

    def sums(chunk: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in chunk.itertuples(index=False):
            order = np.argsort(values["at"].to_numpy())
            c = values["c"].to_numpy()[order]
            by_word = [np.log10((c + 0.5) / (n + 0.5 * (v + 1))), *(values[x].to_numpy()[order] for x in names)]
            tokens = _unpacked(r.tokens)
            first = np.concatenate([[0], np.cumsum(np.asarray(r.counts, np.int64))])
            known = tk.per_doc_sum((c > 0).astype(float)[tokens], first) + (c[-1] > 0)
            ids = pd.array([None if x is None or x != x else int(x) for x in r.ids], dtype="Int64")
            out = {"doc_id": ids, "held_out": np.asarray(r.held, bool), "n_tokens": np.diff(first) + 1, "n_known": np.rint(known).astype(np.int64), "train_tokens": n}
            parts.append(pd.DataFrame(out | {f: tk.per_doc_sum(x[tokens], first) + x[-1] for f, x in zip(fields, by_word)}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", *fields)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, " + ", ".join(f"{f} double" for f in fields)
    return chunks.select("chunk", "ids", "held", "counts", "tokens").groupBy("chunk").cogroup(values.groupBy("of_chunk")).applyInPandas(sums, schema)


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), word_rounds=WORD_ROUNDS)
