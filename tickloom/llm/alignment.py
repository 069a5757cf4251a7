"""Alignment of two tokenizers' tokens over a corpus, by inverted pair bitmaps.

Both tokenizers cut a text's bytes into ranges. Ends that both have cut it into groups; each stretch between neighbouring
ends of either is one link, an A and a B token that overlap. For every id pair the index holds, by segments of some ten
thousand documents, a compressed bitmap of the documents that link it, and planes for the binary digits of how often
they do beyond once. Blocks of documents are OR-merged into their segment's bitmaps; counting ones gives a pair's
documents and, over the planes, its links in the corpus. The postings then carry the counts back to their documents.

Neither tokenizer joins signs across the white space that begins a word, so words are aligned once and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import documents, map_batches, stored

#: Words that a worker remembers before it forgets them all, and bytes of their links and groups.
REMEMBERED, REMEMBERED_BYTES = 250_000, 96 << 20
#: Bytes of text in one segment of the index, and documents at most: a place in a bitmap is a 13-bit cell and a bit.
SEGMENT_BYTES, SEGMENT_DOCS = 16 << 20, 1 << 16
#: Characters of text, and documents at most, that are aligned at once.
BLOCK_BYTES, BLOCK_DOCS = 2 << 20, 8_192
#: The sign that stands for a blank in pieces.
BLANK = "▁"
#: One cell of a compressed bitmap: the place of a byte that is not zero, and the byte.
CELL = np.dtype([("at", "<u2"), ("bits", "u1")])

DOC_COLUMNS = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
INDEX_COLUMNS = f"segment long, slot int, {DOC_COLUMNS}, pair long, plane int, ones long, cells binary"


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``first`` and hold ``size``, one range after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Pair:
    """The two tokenizers, the bytes of their tokens, and the words aligned so far.

    Word w has links ``links[first[w]:first[w + 1]]`` (pair numbers: A's id times B's size, plus B's id), counts
    ``counts[w]`` of A tokens, B tokens and groups, and its groups as text, each ended by a semicolon. A word whose
    tokens do not give its bytes back is marked in ``lossy``.
    """

    def __init__(self, json_path: str, model_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(json_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        if size_a * self.size_b >= 1 << 47:
            raise ValueError("pairs of these vocabularies need more than 47 bits")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(visible)))}
        # A token outside the byte letters has no bytes, so that its text counts as lossy.
        names = [self.a.id_to_token(i) or "" for i in range(size_a)]
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else b"" for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id(BLANK)
        #: "12," "12|" of A ids, "12," "12;" of B ids
        ids_a, ids_b = [b"%d" % i for i in range(size_a)], [b"%d" % i for i in range(self.size_b)]
        self.names = [n + end for ids, ends in ((ids_a, (b",", b"|")), (ids_b, (b",", b";"))) for end in ends for n in ids]
        # White space before which no piece goes on from another sign, nor from the blank that is put before a word.
        free = [c for c, sign in ((" ", BLANK), ("\n", "\n"), ("\t", "\t")) if not any(sign in p.lstrip(BLANK) or sign != BLANK and sign in p for p in pieces)]
        kept = re.escape("".join(free))
        self.words_of = re.compile(rf"\s*\S+(?:[^\S{kept}]\s*\S*)*|\s+" if " " in free else r"(?s).+").findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.first, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.counts, self.lossy = np.zeros((0, 3), np.int64), np.zeros(0, bool)
        self.held = 0

    def _encode_b(self, words: list[str]) -> list[list[int]]:
        """B's ids of words that begin with white space; B puts a blank before what it is given."""
        found = self.b.encode([w[1:] if w[0] == " " and len(w) > 1 else w for w in words], num_threads=1)
        # Where the word's own blank is not the one that was put there, that one is the first token by itself.
        return [[self.blank] if w == " " else ids if w[0] == " " else ids[1:] for w, ids in zip(words, found, strict=True)]

    def _fit(self, table: list[bytes], found: list[list[int]], sizes: np.ndarray) -> bool:
        """Whether each word's tokens end where the word does."""
        length = self.len_a if table is self.bytes_a else self.len_b
        ends = np.r_[0, np.cumsum(length[np.array(list(chain.from_iterable(found)), np.int64)])]
        return np.array_equal(ends[np.cumsum([len(ids) for ids in found])], np.cumsum(sizes))

    def learn(self, words: list[str]) -> None:
        """Aligns new words and remembers them."""
        raw = [w.encode() for w in words]
        found_a = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        found_b = self._encode_b(words)
        flat_a, flat_b = (list(chain.from_iterable(found)) for found in (found_a, found_b))
        good, whole = np.ones(len(words), bool), b"".join(raw)
        sides = ((self.bytes_a, flat_a, found_a), (self.bytes_b, flat_b, found_b))
        # If all bytes together are right, some word's may still have come from its neighbour; then each is compared.
        sizes = np.array([len(r) for r in raw], np.int64)
        if not all(b"".join(map(table.__getitem__, flat)) == whole and self._fit(table, found, sizes) for table, flat, found in sides):
            for table, _, found in sides:
                good &= [b"".join(map(table.__getitem__, ids)) == r for ids, r in zip(found, raw, strict=True)]
            flat_a, flat_b = ([i for k in np.flatnonzero(good).tolist() for i in found[k]] for found in (found_a, found_b))
        kept = np.flatnonzero(good).tolist()
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        end_a, end_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = (end_a[at_a] == ends) & (end_b[at_b] == ends)
        word_ends = np.cumsum([len(raw[k]) for k in kept])
        counts = np.zeros((len(words), 4), np.int64)
        for column, e in enumerate((end_a, end_b, ends[both], ends)):
            counts[kept, column] = np.diff(np.searchsorted(e, word_ends, side="right"), prepend=0)
        # The groups' text: A's ids of a group, then B's; a group's last id of each has another sign after it.
        group_a, group_b = np.searchsorted(ends[both], end_a), np.searchsorted(ends[both], end_b)
        size_a = len(self.bytes_a)
        name_a = ids_a + size_a * np.r_[group_a[1:] != group_a[:-1], True][: len(ids_a)]
        name_b = 2 * size_a + ids_b + self.size_b * np.r_[group_b[1:] != group_b[:-1], True][: len(ids_b)]
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        named = list(map(self.names.__getitem__, np.r_[name_a, name_b][order].tolist()))
        cut = np.cumsum(counts[:, 0] + counts[:, 1]).tolist()
        texts = [b"".join(named[x:y]) for x, y in zip([0, *cut], cut, strict=False)]
        n = len(self.groups)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        self.groups += texts
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(counts[:, 3])]
        self.links = np.r_[self.links, ids_a[at_a] * self.size_b + ids_b[at_b]]
        self.counts = np.r_[self.counts, counts[:, :3]]
        self.lossy = np.r_[self.lossy, ~good]
        self.held += sum(map(len, texts)) + sum(map(len, raw)) + 8 * len(ends)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(counts, groups, text of link, pair of link): per text the numbers of A tokens, B tokens, groups and links,
        and its groups as text; for each link the text it is in. Texts that can't be aligned have none of these."""
        if len(self.number) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget()
        words = [self.words_of(" " + t) if t else [] for t in texts]
        new = list({w for own in words for w in own}.difference(self.number))
        for k in range(0, len(new), 20_000):
            self.learn(new[k : k + 20_000])
        numbers = [list(map(self.number.__getitem__, own)) for own in words]
        size = np.array([len(own) for own in words], np.int64)
        number = np.array(list(chain.from_iterable(numbers)), np.int64)
        text = np.repeat(np.arange(len(texts)), size)
        lossy = np.zeros(len(texts), bool)
        lossy[text[self.lossy[number]]] = True
        number, text = number[~lossy[text]], text[~lossy[text]]
        counts = np.zeros((len(texts), 4), np.int64)
        for column in range(3):
            np.add.at(counts[:, column], text, self.counts[number, column])
        counts[:, 3] = counts[:, 0] + counts[:, 1] - counts[:, 2]  # every end but the shared ones ends one more link
        groups = [b"" if bad else b"".join(map(self.groups.__getitem__, own))[:-1] for own, bad in zip(numbers, lossy.tolist(), strict=True)]
        links = self.first[number + 1] - self.first[number]
        return counts, groups, np.repeat(text, links), self.links[_ragged(self.first[number], links)]


@lru_cache(maxsize=1)
def _pair(json_path: str, model_path: str) -> Pair:
    """One for all tasks of a Python worker, so that a task finds the words of the ones before."""
    return Pair(json_path, model_path)


def bitmaps(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pair, ones, cells) of ascending keys ``pair << 16 | slot``: each pair's slots as one compressed bitmap.

    Bits that meet in a cell are OR-merged. The array of cells is binary, CELL after CELL.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] >> 3 != key[:-1] >> 3][: len(key)])
    bits = np.bitwise_or.reduceat(np.left_shift(1, key & 7).astype(np.uint8), starts) if len(key) else np.zeros(0, np.uint8)
    of_pair, at = key[starts] >> 16, (key[starts] >> 3) & 0x1FFF
    first = np.flatnonzero(np.r_[True, of_pair[1:] != of_pair[:-1]][: len(of_pair)])
    cells = np.empty(len(starts), CELL)
    cells["at"], cells["bits"] = at, bits
    ones = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    offsets = (np.r_[first, len(starts)] * CELL.itemsize).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(cells.tobytes())])
    return of_pair[first], ones, data


def slots_of(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every bit in an array of bitmaps."""
    cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    size = np.array(pc.binary_length(cells).to_numpy(zero_copy_only=False), np.int64) // CELL.itemsize
    flat = np.frombuffer(b"".join(cells.to_pylist()), CELL)
    bit = np.unpackbits(flat["bits"], bitorder="little")
    on = np.flatnonzero(bit)
    return np.repeat(np.arange(len(size)), size)[on >> 3], flat["at"][on >> 3].astype(np.int64) * 8 + (on & 7)


class Segment:
    """Documents and their links until they fill a segment of the index."""

    def __init__(self, kind: pa.DataType):
        self.kind = kind
        self.rows: list[tuple] = []
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: list, counts: np.ndarray, groups: list[bytes], text: np.ndarray, pair: np.ndarray, size: int) -> None:
        n = len(self.rows)
        digests = [hashlib.sha256(g).hexdigest() if c else "" for g, c in zip(groups, counts[:, 0].tolist(), strict=True)]
        self.rows += zip(range(n, n + len(ids)), ids, *counts.T.tolist(), digests, strict=True)
        self.blocks.append(np.unique(pair << 16 | (text + n), return_counts=True))
        self.size += size

    def flush(self, number: int) -> Iterator[pa.RecordBatch]:
        """The rows of the documents, then those of the bitmaps."""
        names = ["slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "plane", "ones", "cells"]
        kinds = [pa.int32(), self.kind, *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

        def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
            arrays = [columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), *arrays], names=["segment", *names])

        for k in range(0, len(self.rows), 5_000):
            some = list(zip(*self.rows[k : k + 5_000], strict=True))
            yield batch(len(some[0]), **{c: pa.array(x, t) for c, x, t in zip(names, some, kinds, strict=False)})
        key, times = (np.concatenate(x) for x in zip(*self.blocks, strict=True))
        order = np.argsort(key, kind="stable")
        key, more = key[order], times[order] - 1
        self.blocks = []
        # Plane 0 says which documents hold the pair; plane p, where digit p - 1 of its further occurrences is 1.
        for plane in range(1 + int(more.max(initial=0)).bit_length()):
            pair, ones, cells = bitmaps(key[(more >> (plane - 1)) & 1 == 1] if plane else key)
            for k in range(0, len(pair), 50_000):
                n = len(pair[k : k + 50_000])
                planes = pa.array(np.full(n, plane, np.int32))
                yield batch(n, pair=pa.array(pair[k : k + n]), plane=planes, ones=pa.array(ones[k : k + n]), cells=cells[k : k + n])
        self.rows, self.size = [], 0


def index(docs: DataFrame, json_path: str, model_path: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The inverted index: rows of documents (segment, slot, doc_id, counts, digest of the groups; pair is null), and
    rows of bitmaps (segment, pair, plane, ones, cells)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(json_path, model_path)
        task = TaskContext.get().partitionId() << 32
        segments, segment = 0, None
        for batch in batches:
            if segment is None:
                segment = Segment(batch.schema.field("doc_id").type)
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for part in parts(texts, BLOCK_BYTES):
                counts, groups, text, links = pair.align(texts[part])
                segment.add(ids[part], counts, groups, text, links, sum(len(t or "") for t in texts[part]))
                if segment.size >= segment_bytes or len(segment.rows) > SEGMENT_DOCS - BLOCK_DOCS:
                    yield from segment.flush(task + segments)
                    segments += 1
        if segment is not None and segment.rows:
            yield from segment.flush(task + segments)

    columns = INDEX_COLUMNS.format(kind=docs.schema["doc_id"].dataType.simpleString())
    return stored(map_batches(docs.select("doc_id", "text"), run, columns), "pairs")


def parts(texts: list[str | None], size: int) -> Iterator[slice]:
    """Slices of about ``size`` characters, of BLOCK_DOCS texts at most."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= size or k + 1 - start >= BLOCK_DOCS or k + 1 == len(texts):
            yield slice(start, k + 1)
            start, held = k + 1, 0


def pair_counts(indexed: DataFrame) -> DataFrame:
    """(pair, documents, links) of the whole corpus: ones counted in every bitmap, the planes' by their digits."""
    times = F.expr("ones * shiftleft(1L, greatest(plane - 1, 0))")
    return indexed.where("pair is not null").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("ones")).otherwise(0)).alias("documents"), F.sum(times).alias("links")
    )


def _score(table: pa.Table) -> pa.Table:
    """applyInArrow body: a segment's documents with what their postings bring back. The segment's rows are its documents
    (with a slot), its bitmaps (with cells) and the counts of its pairs."""
    docs, posts, scores = (table.filter(pc.is_valid(table.column(c))) for c in ("slot", "cells", "links"))
    row, slot = slots_of(posts.column("cells"))
    times = np.left_shift(1, np.maximum(posts.column("plane").to_numpy().astype(np.int64) - 1, 0))
    pair = scores.column("pair").to_numpy()
    order = np.argsort(pair)
    at = order[np.searchsorted(pair, posts.column("pair").to_numpy(), sorter=order)]
    links, best = scores.column("links").to_numpy()[at], scores.column("best").to_numpy()[at].astype(np.int64)
    sums = np.zeros((2, SEGMENT_DOCS), np.int64)
    np.add.at(sums[0], slot, (times * best)[row])
    np.add.at(sums[1], slot, (times * links)[row])
    at = docs.column("slot").to_numpy()
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    columns = [*(docs.column(c) for c in kept), pa.array(sums[0][at]), pa.array(sums[1][at]), docs.column("groups_sha256")]
    return pa.table(columns, names=[*kept, "n_best", "count_sum", "groups_sha256"])


def aligned(docs: DataFrame, json_path: str, model_path: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    Null and empty texts, and those whose tokens of either side do not give a blank and the text back, have no tokens:
    zeros and an empty digest. Repeated rows, and equal texts, count each. Texts of any length are taken whole. B ids
    whose highest count several pairs have keep them all as best. Other columns of docs are ignored. An empty table
    gives an empty result.
    """
    size_b = _pair(json_path, model_path).size_b
    indexed = index(docs, json_path, model_path, segment_bytes)
    counts = stored(pair_counts(indexed).select("pair", "links", F.expr(f"pair % {size_b}").alias("b")), "counts")
    # One row a B id: never more than its vocabulary has.
    best = F.broadcast(counts.groupBy("b").agg(F.max("links").alias("most")))
    scores = counts.join(best, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    # Each pair's counts go to the segments that hold it, as numbers; the bitmaps go to their segment alone. Of the
    # planes only the first is asked, which every pair has. The join is by merging at every size.
    held = indexed.where("plane = 0").select("pair", "segment")
    sent = held.join(scores.hint("merge"), "pair")
    rows = indexed.drop("ones").unionByName(sent, allowMissingColumns=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("segment").applyInArrow(_score, result)


def groups(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """(doc_id, groups): each row's groups as ``a1,a2|b1;a3|b2,b3``, decimal ids in order; empty without tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(json_path, model_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [g.decode() for part in parts(texts, BLOCK_BYTES) for g in pair.align(texts[part])[1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "groups"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, groups string")


def tokenizer_files() -> tuple[str, str]:
    """Paths of the public 50k byte-level vocabulary and the 32k piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir), *tokenizer_files())
