"""Quality rules by suffix-array repetition.

The words of each text form a sequence; its suffix array (prefix doubling that only sorts what is still tied, many texts
at once) and the longest common prefixes of neighbouring suffixes give, for each position, the longest passage that also
starts elsewhere in the text: the deepest LCP interval that holds the suffix. Those intervals of ``min_repeat`` words or
more are the maximal repeated substrings; the union of their spans gives the covered fraction, the deepest the longest
repeat. A text is kept if neither exceeds its limit and the base rules hold. The limits are the method's own: passages
of 4 words count, so a text of stuttered words or short phrases goes, which no window of the base rule sees.

Defined results: a null or blank text has no words and fails the base rule; equal rows are judged alike; an empty table
gives an empty result; other columns, whatever their names, stay untouched because outputs are only the named ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trovex.llm import textkit as tk
from trovex.llm.runtime import in_worker, ship, table

WINDOW = 8
MIN_WORDS = 20
MIN_REPEAT = 4
#: Shares of a text's words.
MAX_COVERED = 0.3
MAX_LONGEST = 0.25
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def longest_repeats(symbol: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest passage from there that starts at another position of its text too.

    symbol: uint64, equal for equal words; doc: the text of each word, ascending.
    """
    n = len(symbol)
    best = np.zeros(n, np.int32)
    if n < 2:
        return best
    key = tk.mix(symbol + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    sa = np.argsort(key)
    ordered = key[sa]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[n] = -1
    last = np.ones(n, bool)
    last[:-1] = doc[1:] != doc[:-1]
    stop = np.empty(n, np.int64)  # end of each word's text
    ends = np.flatnonzero(last) + 1
    stop[:] = ends[np.searchsorted(ends, np.arange(n), side="right")]
    levels = [rank.astype(np.int32)]
    tied = ~(fresh & np.append(fresh[1:], True))
    slots = np.flatnonzero(tied)
    near = slots[~fresh[slots]]  # slots whose suffix shares its first word with the slot before
    k = 1
    while len(slots):
        own = sa[slots]
        ahead = own + k
        second = np.where(ahead < stop[own], rank[np.minimum(ahead, n)], -1)
        pair = rank[own] * (n + 1) + second + 1
        order = np.argsort(pair)
        pair, own = pair[order], own[order]
        sa[slots] = own
        new = np.ones(len(slots), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[own] = np.maximum.accumulate(np.where(new, slots, 0))
        k *= 2
        levels.append(rank.astype(np.int32))
        slots = slots[~(new & np.append(new[1:], True))]
    a, b = sa[near - 1], sa[near]
    lcp = np.zeros(len(near), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + lcp, n), np.minimum(b + lcp, n)
        lcp += (levels[j][x] == levels[j][y]).astype(np.int64) << j
    np.maximum.at(best, a, lcp.astype(np.int32))
    np.maximum.at(best, b, lcp.astype(np.int32))
    return best


def covered(best: np.ndarray, least: int, cut: int | None = None) -> np.ndarray:
    """1 for each word inside a repeated passage of ``least`` words or more (the first ``cut`` words of each, if given)."""
    at = np.flatnonzero(best >= least)
    edge = np.zeros(len(best) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (best[at] if cut is None else cut), -1)
    return (np.cumsum(edge[:-1]) > 0).astype(np.int64)


def spans(text: str, min_repeat: int = MIN_REPEAT) -> list[tuple[int, int]]:
    """The union of one text's maximal repeated passages, as [start, end) word numbers."""
    w = tk.words(pa.array([text]))
    inside = covered(longest_repeats(w.hashes(), w.doc()), min_repeat)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    raw, out = data.tobytes(), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        out.append(len(lines) - len(set(lines)))
    return out


def measure(col: pa.Array, min_repeat: int, max_covered: float, max_longest: float) -> dict[str, np.ndarray | list]:
    w = tk.words(col)
    best = longest_repeats(w.hashes(), w.doc())
    n = w.count.astype(np.int64)
    solid = tk._SPACE[w.data]
    chars = ~solid & ((w.data & 0xC0) != 0x80)
    repeat = tk.per_doc_sum(covered(best, WINDOW, WINDOW), w.first)
    cover = tk.per_doc_sum(covered(best, min_repeat), w.first)
    longest = tk.per_doc_max(best, w.first).astype(np.int64)
    failed = (n < MIN_WORDS) | (100 * repeat > 30 * n)
    return {
        "n_words": n,
        "word_chars": tk.per_doc_sum(chars, w.offsets),
        "n_symbols": tk.per_doc_sum(_SYMBOL[w.data], w.offsets),
        "n_dup_lines": _dup_lines(w.data, w.offsets),
        "n_repeat_words": repeat,
        "covered_words": cover,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": ~failed & (cover <= max_covered * n) & (longest <= max_longest * n),
    }


def suffix_repetition(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, carry: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``carry`` columns of ``docs`` plus the measures and verdict of each row's ``text``, their names after ``prefix``. One pass, no shuffle."""
    ship(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name in carry]
    extra = [prefix + x.strip() for x in FIELDS.split(",")[1:]]
    source = docs.select(*[f"`{f.name}`" for f in fields], *([] if "text" in carry else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                out = {f.name: part.column(part.schema.get_field_index(f.name)) for f in fields}
                out |= {prefix + k: pa.array(v) for k, v in measure(part.column(part.schema.get_field_index("text")), min_repeat, max_covered, max_longest).items()}
                yield pa.RecordBatch.from_pydict(out)

    import pyspark.sql.types as T

    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in fields), *T._parse_datatype_string(", ".join(extra)).fields])
    return source.mapInArrow(lambda batches: in_worker("quality", run, drop=(tk._powers,))(batches), schema)


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repetition(table(spark, sf_dir, "documents"))
