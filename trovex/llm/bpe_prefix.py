"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word exactly one token can end its encoding: of the tokens that match there as suffixes (an
Aho-Corasick automaton over the vocabulary lists them), the one that is compatible with the last token of the prefix
before it. Two tokens are compatible if no merge across their border would come before the merges that built them, which
the two spines along the border decide. The last tokens of all prefixes are stored; following the back-pointers from the
end gives the ids. No merge loop runs and no text is sampled: each word costs its length times its suffix matches.

Normalisation and word pattern are read from the vocabulary file and must be of the kind with word ends (NFC, white
space folded, lower case; matches of the split pattern are the words; byte alphabet; a suffix marks the last symbol).
Special tokens inside a text keep their own ids, as they do in the library.

Defined results: null is the empty text with no ids and an empty decoding; equal texts have equal results; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from trovex.llm.runtime import in_worker, ship, ship_file, table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 300_000
_NEVER = 1 << 60
FIELDS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is a visible Latin-1 character, else the next from U+0100."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PrefixBpe:
    """An encoder and decoder for one vocabulary file. Words that were seen before come from a bounded memory."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end_mark = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.text_of[i] = s
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words_in = regex.compile(pattern).findall
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.special_bytes = [s.encode() for s in self.special]
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}

        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.merge.setdefault((a, b), (r, c))
            if c not in self.parts:
                self.parts[c] = (a, b)
                self.born[c] = r
        self._fits: dict[int, bool] = {}
        self._right: dict[int, tuple] = {}
        self._left: dict[int, tuple] = {}
        self.reachable: dict[int, bool] = {}

        # The automaton's alphabet has a character for each symbol: that of the byte, or 256 further with the end mark.
        self.automaton = ahocorasick.Automaton()
        for s, i in self.vocab.items():
            if self._reach(i):
                key = self._symbols(s)
                self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.young_words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _symbols(self, s: str) -> str:
        ended = bool(self.end_mark) and s.endswith(self.end_mark) and len(s) > len(self.end_mark)
        codes = [self.byte_of[c] for c in (s[: -len(self.end_mark)] if ended else s)]
        if ended:
            codes[-1] += 256
        return "".join(map(chr, codes))

    def _spine(self, token: int, side: int) -> tuple:
        """(piece, rank of the merge that consumes it) along the token's right (1) or left (0) border, the smallest piece first."""
        memo = self._right if side else self._left
        out = memo.get(token)
        if out is None:
            chain, piece, gone = [], token, _NEVER
            while True:
                chain.append((piece, gone))
                if piece not in self.parts:
                    break
                gone = self.born[piece]
                piece = self.parts[piece][side]
            out = memo[token] = tuple(reversed(chain))
        return out

    def fits(self, left: int, right: int, before: int = _NEVER) -> bool:
        """True if no merge across the border of the two tokens happens at a rank under ``before``."""
        for a, a_gone in self._spine(left, 1):
            for b, b_gone in self._spine(right, 0):
                m = self.merge.get((a, b))
                if m is not None and m[0] < before and m[0] < a_gone and m[0] <= b_gone:
                    return False
        return True

    def _reach(self, token: int) -> bool:
        """True if encoding the token's own text gives the token."""
        out = self.reachable.get(token)
        if out is None:
            if token not in self.parts:
                out = True
            else:
                a, b = self.parts[token]
                out = self._reach(a) and self._reach(b) and self.fits(a, b, self.born[token])
            self.reachable[token] = out
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the split pattern."""
        text = word.encode().decode("latin-1")
        if self.end_mark:
            text = text[:-1] + chr(256 + ord(text[-1]))
        n = len(text)
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        memo = self._fits
        for end, (size, token) in self.automaton.iter(text):  # ascending ends, the longest match first
            at = end + 1
            if last[at] >= 0:
                continue
            start = at - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 32 | token
                ok = memo.get(key)
                if ok is None:
                    if len(memo) > 2_000_000:
                        memo.clear()
                    ok = memo[key] = self.fits(before, token)
                if not ok:
                    continue
            last[at] = token
            back[at] = start
        if last[n] < 0:
            raise ValueError(f"no encoding of {word!r}")
        out = []
        at = n
        while at:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out

    def _plain(self, text: str) -> bytes:
        """Packed ids of a piece of text without special tokens."""
        if text.isascii():
            text = text.lower()
        else:
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        found = self.words_in(text)
        out = []
        for word in found:
            ids = self.young_words.get(word)
            if ids is None:
                ids = self.old_words.get(word)
                if ids is None:
                    ids = array("I", self.encode_word(word)).tobytes()
                if len(word) <= 64:
                    if len(self.young_words) >= self.cache_words:
                        self.old_words, self.young_words = self.young_words, {}
                    self.young_words[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode_packed(self, raw: bytes) -> bytes:
        """Ids of a text in UTF-8 as native 32-bit integers. ASCII white space always separates words, so runs between it are encoded once and kept."""
        for s in self.special_bytes:
            if s in raw:
                return b"".join(array("I", [self.special[part]]).tobytes() if part in self.special else self._spaced(part.encode()) for part in self.special_split.split(raw.decode()))
        return self._spaced(raw)

    def encode(self, raw: bytes) -> list[int]:
        return list(memoryview(self.encode_packed(raw)).cast("I"))

    def _spaced(self, raw: bytes) -> bytes:
        out = []
        young, get = self.young, self.young.get
        for run in raw.split():
            ids = get(run)
            if ids is None:
                ids = self.old.get(run)
                if ids is None:
                    ids = self._plain(run.decode())
                if len(run) <= 64:
                    if len(young) >= self.cache_words:
                        self.old, self.young = young, {}
                        young, get = self.young, self.young.get
                    young[run] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The library's text for a vocabulary without a decoder: the tokens' own strings, parted by spaces."""
        return " ".join([self.text_of[i] for i in ids])


_loaded: dict[str, PrefixBpe] = {}


def codec(path: str) -> PrefixBpe:
    """One codec for each vocabulary file and worker."""
    if path not in _loaded:
        _loaded[path] = PrefixBpe(path)
    return _loaded[path]


def _kept() -> tuple[dict, ...]:
    """This module's tables in a worker; a global that a sent function names would be a copy."""
    return (_loaded,)


def little_endian(packed: bytes) -> bytes:
    """Native 32-bit integers as little-endian ones."""
    if sys.byteorder == "little":
        return packed
    a = array("I", packed)
    a.byteswap()
    return a.tobytes()


def bpe_encode(docs: DataFrame, path: str | None = None, keep_ids: bool = True, carry: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """``carry`` columns plus n_tokens, and either ids and decoded (``keep_ids``) or their digests, for each row's whole text."""
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    vocabulary = ship_file(docs.sparkSession, path or tokenizer_path(VOCABULARY))
    fields = [f for f in docs.schema.fields if f.name in carry]
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in fields), T.StructField("n_tokens", T.LongType())])
    if keep_ids:
        schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    if digests:
        schema.add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(SparkFiles.get(vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = {f.name: part.column(part.schema.get_field_index(f.name)) for f in fields}
                counts, ids_out, text_out, ids_sha, text_sha = [], [], [], [], []
                for raw in part.column(part.schema.get_field_index("text")).cast(pa.large_binary()):
                    packed = bpe.encode_packed(raw.as_py() or b"")
                    ids = memoryview(packed).cast("I").tolist()
                    text = bpe.decode(ids)
                    counts.append(len(ids))
                    if keep_ids:
                        ids_out.append(ids)
                        text_out.append(text)
                    if digests:
                        ids_sha.append(hashlib.sha256(little_endian(packed)).hexdigest())
                        text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                out["n_tokens"] = pa.array(counts, pa.int64())
                if keep_ids:
                    out |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(text_out, pa.string())}
                if digests:
                    out |= {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    columns = [f"`{f.name}`" for f in fields] + ([] if "text" in carry else ["text"])
    return docs.select(*columns).mapInArrow(lambda batches: in_worker("bpe", run, keep=_kept())(batches), schema)


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), keep_ids=False, digests=True)
