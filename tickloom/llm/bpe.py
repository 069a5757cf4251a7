"""Byte-pair encoding and decoding of whole texts with a vocabulary that drops white space.

A text is cut at white space; each word is normalised and split by the vocabulary file's own rules, and its symbols are
merged in a contiguous array of part ids with the ranks of adjacent pairs beside it: find the smallest rank, join the
pair, delete the boundary, look up the two neighbouring ranks again. Words of many symbols, for which scanning the ranks
again and again would be quadratic, take the same merges in the same order from a heap. Workers remember words.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tickloom.llm.common import documents, map_batches

#: Words, and pieces of words, that a worker remembers before it forgets them all.
REMEMBERED = 400_000
#: Bytes of a word, or symbols of a piece, that is not remembered.
LONG = 64
#: Symbols up to which the ranks are scanned; more are merged by a heap.
SCANNED = 128
#: A rank that no pair has.
NONE = 1 << 60
#: Bits of an id in the number of a pair.
SHIFT = 20
#: Words of visible ASCII and of the Latin letters and signs up to U+017F: composed already, and old enough that every
#: version of Unicode takes them alike.
PLAIN = re.compile(r"[!-~\xa1-\u017f]*")


class Merges:
    """The rank of each pair of ids, under one number for both, and the id that each rank makes."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        """pairs: (left, right, merged) in the order of their ranks."""
        self.rank = {a << SHIFT | b: k for k, (a, b, _) in enumerate(pairs)}
        self.made = [m for _, _, m in pairs]


def merge(ids: list[int], merges: Merges) -> list[int]:
    """``ids`` after all merges; of equal ranks the first goes first.

    ``ranks[i]`` is that of the pair (i, i + 1), so that deleting part i + 1 deletes one rank and changes two.
    """
    if len(ids) > SCANNED:
        return _merge_long(ids, merges)
    get, made = merges.rank.get, merges.made
    ranks = [get(a << SHIFT | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
    while ranks:
        least = min(ranks)
        if least == NONE:
            break
        i = ranks.index(least)
        ids[i] = new = made[least]
        del ids[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(new << SHIFT | ids[i + 1], NONE)
        if i:
            ranks[i - 1] = get(ids[i - 1] << SHIFT | new, NONE)
    return ids


def _merge_long(ids: list[int], merges: Merges) -> list[int]:
    """The same with parts linked to their neighbours and pairs in a heap by rank and place; stale pairs are skipped."""
    rank, made, n = merges.rank, merges.made, len(ids)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    pairs = [a << SHIFT | b for a, b in zip(ids, ids[1:], strict=False)]
    heap = [(rank[p], i) for i, p in enumerate(pairs) if p in rank]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        least, i = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j < 0 or rank.get(ids[i] << SHIFT | ids[j]) != least:
            continue
        ids[i] = made[least]
        gone[j] = 1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (new := ids[a] << SHIFT | ids[b]) in rank:
                heapq.heappush(heap, (rank[new], a))
    return [x for x, dead in zip(ids, gone, strict=True) if not dead]


class WordTokenizer:
    """Encodes and decodes by a vocabulary file whose words end in a suffix and whose splitting drops white space.

    Normalising and splitting follow the file's rules, through the library's own normaliser and splitter wherever a word
    is not plain ASCII, so that both know the same Unicode. The strings of added tokens inside a text are these tokens.
    """

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer

        with open(json_path, encoding="utf-8") as f:
            file = json.load(f)
        splitters = file["pre_tokenizer"].get("pretokenizers", [])
        kinds = [s["type"] for s in splitters]
        if file["model"]["type"] != "BPE" or kinds != ["Split", "ByteLevel"] or not splitters[0]["invert"] or file["decoder"]:
            raise ValueError("a BPE vocabulary that keeps the matches of one pattern, as bytes, and has no decoder is needed")
        library = Tokenizer.from_file(json_path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.pattern = regex.compile(splitters[0]["pattern"]["Regex"])
        self.lower = any(n["type"] == "Lowercase" for n in file["normalizer"]["normalizers"])
        vocab = file["model"]["vocab"]
        suffix = file["model"]["end_of_word_suffix"] or ""
        self.inner = {t: i for t, i in vocab.items() if len(t) == 1}
        self.last = {t[:1]: i for t, i in vocab.items() if len(t) == 1 + len(suffix) and t.endswith(suffix)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(256 + k) for k, b in enumerate(hidden)}
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = dict(zip(vocab.values(), vocab, strict=True)) | {i: t for t, i in added.items()}
        self.added = {t.encode(): np.array([i], "<i4").tobytes() for t, i in added.items()}
        self.cuts = regex.compile(b"(" + b"|".join(sorted(map(regex.escape, self.added), key=len, reverse=True)) + b")") if added else None
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """The ids of one word of byte letters, as little-endian 32-bit numbers."""
        ids = self.pieces.get(piece)
        if ids is None:
            symbols = [self.inner[c] for c in piece[:-1]] + [self.last[piece[-1]]]
            ids = np.array(merge(symbols, self.merges), "<i4").tobytes()
            if len(piece) <= LONG:
                self.pieces[piece] = ids
        return ids

    def _plain_word(self, word: bytes) -> bytes:
        """The ids of a word without added tokens."""
        text = word.decode()
        if not PLAIN.fullmatch(text):
            return b"".join([self._piece(p) for p, _ in self.split(self.normalise(text))])
        pieces = self.pattern.findall(text.lower() if self.lower else text)
        return b"".join([self._piece(p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)) for p in pieces])

    def _word(self, word: bytes) -> bytes:
        if self.cuts is None or b"<" not in word and not self.cuts.search(word):
            ids = self._plain_word(word)
        else:
            ids = b"".join([self.added.get(p) or self._plain_word(p) for p in self.cuts.split(word) if p])
        if len(word) <= LONG:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        for memory in (self.words, self.pieces):
            if len(memory) > REMEMBERED:
                memory.clear()
        words = text.encode().split()
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.words.get(w) or self._word(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings between blanks, as a vocabulary without a decoder gives them; unknown ids are left out."""
        tokens = self.tokens
        try:
            return " ".join([tokens[i] for i in ids])
        except KeyError:
            return " ".join([tokens[i] for i in ids if i in tokens])


@lru_cache(maxsize=2)
def _tokenizer(json_path: str) -> WordTokenizer:
    """One for all tasks of a Python worker, so that a task finds the words of the ones before."""
    return WordTokenizer(json_path)


IDS, DECODED = StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())


def _with(df: DataFrame, *fields: StructField) -> StructType:
    return StructType([df.schema["doc_id"], *fields])


def _ids(raw: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode(docs: DataFrame, json_path: str) -> DataFrame:
    """(doc_id, ids) of each row: the ids of its whole text.

    Null and empty texts, and texts of white space, have no ids. Texts of any length are taken whole; equal texts get
    equal ids, and repeated rows stay apart. Other columns of docs, whatever their names, are left out. An empty table
    gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(json_path)
        for batch in batches:
            raw = [tokenizer.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _ids(raw)], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, _with(docs, IDS))


def decode(encoded: DataFrame, json_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows (doc_id, ids): the text that the ids stand for, special tokens included.

    Null or empty ids give the empty text. An id that the vocabulary lacks is left out. Other columns are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(json_path)
        for batch in batches:
            texts = [tokenizer.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, _with(encoded, encoded.schema["ids"], DECODED))


def round_trip(docs: DataFrame, json_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of each row, as ``decode(encode(docs))`` gives them, in one pass through Python."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(json_path)
        for batch in batches:
            raw = [tokenizer.encode(t or "") for t in batch.column("text").to_pylist()]
            texts = [tokenizer.decode(np.frombuffer(r, "<i4").tolist()) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _ids(raw), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_batches(docs.select("doc_id", "text"), run, _with(docs, IDS, DECODED))


def tokenizer_file() -> str:
    """Path of the public 49k vocabulary of words."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), tokenizer_file()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
