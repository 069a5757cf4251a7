"""Packing documents into fixed-length sequences by a grouping genetic algorithm on islands.

Only the pieces shorter than a sequence need packing. They are dealt by hash into problems of bounded size; each problem
is solved by several islands, which start from the best-fit decreasing packing and from random best-fit packings, and
exchange their best one between rounds. A crossover takes the well-filled bins of one parent whole into another, opens
the bins that would then hold an item twice, and best-fits the items this displaces; a mutation opens badly filled bins.
An island stops at a lower bound that no packing can beat. Bins that stay badly filled are opened again and packed
across problems.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import documents, map_batches, stored

#: Tokens in one sequence.
SEQUENCE = 2048
#: Pieces in one problem, islands a problem, rounds between which they exchange packings.
PROBLEM, ISLANDS, ROUNDS = 6000, 2, 2
#: Packings that an island holds, generations of a round at most, and generations without a better packing after which it ends.
POPULATION, GENERATIONS, PATIENCE = 6, 60, 20
#: Share of its bins that a mutation opens: as many of the worst filled as of any.
OPENED = 0.02
#: A bin filled to this share or more is final after the first level.
WELL_FILLED = 0.995
#: Another level is begun while the last one made at least this share of its pieces final.
LEAST_FINAL = 0.02
#: Levels that sequence numbers leave room for; as each level but the last ends some pieces, far fewer are made.
LEVELS = 1024
#: A blank between two words, letters that may end a word, and what is cut off after those.
BETWEEN_WORDS = re.compile(r"(?<=\S)(?= \S)")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàâçèéêëîïôùûüöäßñáíóú")
MARKS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
#: Words that a worker remembers the ids of (twice, at most), and characters of one that is not remembered.
REMEMBERED, LONG_WORD = 300_000, 64


@lru_cache(maxsize=4)
def _tokenizer(json_path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def token_ids(text: str, json_path: str) -> list[int]:
    """The text's ids without special tokens."""
    return _tokenizer(json_path).encode(text, add_special_tokens=False).ids


class Encoder:
    """The ids of texts as little-endian 32-bit numbers, with words that came before remembered.

    The vocabulary's splitting pattern starts a new word at a single blank between two characters that are no white
    space, and after a letter that no letter follows; merges stay inside a word. So the ids of a text are those of its
    parts between such blanks, and those of a part that ends in marks are its stem's and then the marks'. New stems are
    encoded together, each after its blank, and told apart by the tokens that begin with a blank: each has one.
    """

    def __init__(self, json_path: str):
        self.tokenizer = _tokenizer(json_path)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # the vocabulary's letter for a blank
        endings = {t.content[-1:] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.marks = "".join(c for c in MARKS if c not in endings)  # so no special token is cut
        self.young: dict[str, bytes] = {}  # two generations, so that frequent words outlast the rare ones
        self.old: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order. All are split at once, and each distinct word is looked up once."""
        self._forget()
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        words = split.flatten().dictionary_encode()
        codes, ends = words.indices.to_numpy(), split.offsets.to_numpy()
        follows = np.ones(len(codes), bool)  # a blank
        follows[ends[:-1]] = False
        inner = np.zeros(len(words.dictionary), bool)
        inner[codes[follows]] = True
        kept = np.flatnonzero(inner)
        stems, marks = self._cut(words.dictionary.take(pa.array(kept)))
        missing = {s for s in stems if s not in self.young}
        strange = {s for s in missing if not s or s[0].isspace() or s[-1].isspace()}  # not all blanks are between two words
        long = self._know(missing - strange)
        of_marks = self._each(set(marks))
        ids: list[bytes | None] = [None] * len(inner)
        odd = np.zeros(len(inner), bool)
        for k, stem, mark in zip(kept.tolist(), stems, marks, strict=True):
            if stem in strange:
                odd[k] = True
            else:
                ids[k] = self.young[stem] + of_marks[mark] if mark else self.young[stem]
        before = np.r_[0, np.cumsum(odd[codes] & follows)]
        firsts = [t.partition(" ")[0] for t in texts]
        plain = [n == 0 and f != "" and not f[-1].isspace() for n, f in zip((before[ends[1:]] - before[ends[:-1]]).tolist(), firsts, strict=True)]
        begun = self._each({f for f, p in zip(firsts, plain, strict=True) if p})
        for text, p, first, a, b in zip(texts, plain, firsts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield begun[first] + b"".join(map(ids.__getitem__, codes[a + 1 : b].tolist())) if p else self._by_parts(text)
        for word in long:
            self.young.pop(word, None)

    def _by_parts(self, text: str) -> bytes:
        """The ids of a text in which some blank is not between two words."""
        self._forget()
        first, *inner = BETWEEN_WORDS.split(text)
        tail = inner.pop() if inner else ""
        inner = [p[1:] for p in inner]
        long = self._know(set(inner).difference(self.young))
        out = b"".join([self._ids(first), *map(self.young.__getitem__, inner), self._ids(tail)])
        for p in long:
            self.young.pop(p, None)
        return out

    def _forget(self) -> None:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}

    def _cut(self, words: pa.Array) -> tuple[list[str], list[str]]:
        """The stem of each word and the marks after it, if the stem ends in a letter; else the word and nothing."""
        stems, marks = words.to_numpy(zero_copy_only=False).tolist(), [""] * len(words)
        for k, stem in enumerate(pc.ascii_rtrim(words, self.marks).to_numpy(zero_copy_only=False).tolist()):
            if len(stem) < len(stems[k]) and stem and stem[-1] in LETTERS:
                stems[k], marks[k] = stem, stems[k][len(stem) :]
        return stems, marks

    def _know(self, parts: Iterable[str]) -> list[str]:
        """Puts the parts, which are not among the young, there; returns those too long to stay."""
        new, long = [], []
        for p in parts:
            if (ids := self.old.get(p)) is not None:
                self.young[p] = ids
                continue
            if len(p) > LONG_WORD:
                long.append(p)
            if " " in p:
                self.young[p] = self._ids(" " + p)
            else:
                new.append(p)
        self._learn(new)
        return long

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _ids(self, text: str) -> bytes:
        return self._encode(text).tobytes() if text else b""

    def _each(self, texts: set[str]) -> dict[str, bytes]:
        """The ids of texts that are encoded as they are."""
        some = list(texts)
        found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False) if some else []
        return {t: np.array(e.ids, dtype="<u4").tobytes() for t, e in zip(some, found, strict=True)}

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 10_000):
            some = words[k : k + 10_000]
            found = self._encode(" " + " ".join(some))
            raw = found.tobytes()
            cuts = [*(4 * np.flatnonzero(self.begins[found])).tolist(), len(raw)]
            for word, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                self.young[word] = raw[a:b]


@lru_cache(maxsize=1)
def _encoder(json_path: str) -> Encoder:
    """One for all tasks of a Python worker, so that a task finds the words of the ones before."""
    return Encoder(json_path)


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, and before them what is left over."""
    first = length % size
    starts = ([0] if first else []) + list(range(first, length, size))
    return [(s, first if s == 0 and first else size) for s in starts]


def pieces(docs: DataFrame, json_path: str, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row; a document's ids are its tokens and then id 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(json_path)
        for batch in batches:
            out: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            distinct = list(dict.fromkeys(texts))  # copies within a batch are encoded once
            cuts = {}
            for text, ids in zip(distinct, encode(distinct), strict=True):
                raw = ids + bytes(4)
                cuts[text] = [(k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(raw) // 4, size))]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                out += [(doc_id, *c) for c in cuts[text]]
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below: items over half a bin share none with each other, and what is left
    of their bins must take the items of at least each size, as far as it can."""
    s = np.sort(sizes)
    before = np.r_[0, np.cumsum(s)]
    half = int(np.searchsorted(s, capacity // 2, side="right"))
    least = -(-int(before[-1]) // capacity)
    for a in np.unique(np.r_[0, s[:half]]).tolist():
        top, low = int(np.searchsorted(s, capacity - a, side="right")), int(np.searchsorted(s, a, side="left"))
        top = max(top, half)
        room = (top - half) * capacity - int(before[top] - before[half])
        rest = int(before[half] - before[low]) if half > low else 0
        least = max(least, len(s) - half + max(0, -(-(rest - room) // capacity)))
    return least


def place(bins: np.ndarray, fills: list[int], items: list[int], sizes: list[int], capacity: int) -> int:
    """Best-fits the items, in their order, into the fullest bin that has room or a new one; returns the number of bins.

    ``bins`` (the bin of each item) and ``fills`` (of each bin) are changed.
    """
    by_free: dict[int, list[int]] = {}
    mask = 0  # bit f is set when a bin with f free places exists
    for b, fill in enumerate(fills):
        if fill < capacity:
            by_free.setdefault(capacity - fill, []).append(b)
    for free in by_free:
        mask |= 1 << free
    to = []
    for item in items:
        size = sizes[item]
        room = mask >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            held = by_free[free]
            b = held.pop()
            if not held:
                mask &= ~(1 << free)
            fills[b] += size
        else:
            b, free = len(fills), capacity
            fills.append(size)
        to.append(b)
        free -= size
        by_free.setdefault(free, []).append(b)
        mask |= 1 << free
    bins[items] = to
    return len(fills)


def best_fit(sizes: list[int], order: list[int], capacity: int) -> np.ndarray:
    """The bin of each item when they are best-fitted in this order."""
    bins = np.empty(len(sizes), np.int64)
    place(bins, [], order, sizes, capacity)
    return bins


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean squared fill: prefers few bins, and among as many bins the one with fuller ones."""
    return float(((np.bincount(bins, weights=sizes) / capacity) ** 2).mean())


def _refit(bins: np.ndarray, loose: np.ndarray, sizes: np.ndarray, listed: list[int], capacity: int, rank: np.ndarray) -> np.ndarray:
    """Takes the loose items out and best-fits them anew, the largest ``rank`` first; emptied bins go."""
    kept = np.flatnonzero(~loose)
    out = np.empty(len(bins), np.int64)
    _, out[kept] = np.unique(bins[kept], return_inverse=True)
    fills = np.bincount(out[kept], weights=sizes[kept]).astype(np.int64).tolist()
    items = np.flatnonzero(loose)
    place(out, fills, items[np.argsort(-rank[items], kind="stable")].tolist(), listed, capacity)
    return out


def crossover(keep: np.ndarray, give: np.ndarray, sizes: np.ndarray, capacity: int, share: float, listed: list[int] | None = None) -> np.ndarray:
    """A child of keep that holds the best-filled ``share`` of give's bins whole.

    Bins of keep that hold an item of those are opened: what is in both parents' bins leaves them, and the rest is
    best-fitted, the largest first.
    """
    fills = np.bincount(give, weights=sizes)
    best = np.argsort(-fills, kind="stable")[: max(1, int(len(fills) * share))]
    chosen = np.zeros(len(fills), bool)
    chosen[best] = True
    moved = chosen[give]
    opened = np.zeros(int(keep.max()) + 1, bool)
    opened[keep[moved]] = True
    child = np.where(moved, give + len(opened), keep)
    return _refit(child, opened[keep] & ~moved, sizes, listed or sizes.tolist(), capacity, sizes)


def mutation(bins: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator, listed: list[int] | None = None) -> np.ndarray:
    """Opens the worst-filled bins and as many others, and best-fits their items in an order that is random in part."""
    fills = np.bincount(bins, weights=sizes)
    n = max(1, int(len(fills) * OPENED))
    opened = np.zeros(len(fills), bool)
    opened[np.argsort(fills, kind="stable")[:n]] = True
    opened[rng.choice(len(fills), n, replace=False)] = True
    return _refit(bins, opened[bins], sizes, listed or sizes.tolist(), capacity, sizes * (1 + 0.3 * rng.random(len(sizes))))


def evolve(
    sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION,
    patience: int = PATIENCE,
) -> tuple[np.ndarray, int]:
    """(the best packing, crossovers made) of generations that start from the elites, or without any from best-fit
    decreasing, and from random best-fit packings. So no result has more bins than best-fit decreasing.

    A child replaces the worst packing if it is better. The search ends at the lower bound on bins, or when the best
    packing has not become better for ``patience`` generations.
    """
    rng = np.random.default_rng(seed)
    listed = sizes.tolist()
    bound = least_bins(sizes, capacity)
    pool = list(elites) or [best_fit(listed, np.argsort(-sizes, kind="stable").tolist(), capacity)]
    while len(pool) < population:
        noise = 1 + (0.15 * (1 + len(pool))) * rng.random(len(sizes))
        pool.append(best_fit(listed, np.argsort(-sizes * noise, kind="stable").tolist(), capacity))
    scored = sorted(((fitness(p, sizes, capacity), -k, p) for k, p in enumerate(pool)), key=lambda x: x[:2], reverse=True)
    waited = made = 0
    while made < generations and waited < patience and int(scored[0][2].max()) + 1 > bound:
        a, b = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[a][2], scored[b][2], sizes, capacity, rng.uniform(0.1, 0.6), listed)
        if rng.random() < 0.5:
            child = mutation(child, sizes, capacity, rng, listed)
        made += 1
        found, best = fitness(child, sizes, capacity), scored[0][0]
        if found > scored[-1][0]:
            scored[-1] = (found, -population - made, child)
            scored.sort(key=lambda x: x[:2], reverse=True)
        waited = 0 if scored[0][0] > best else waited + 1
    return scored[0][2], made


def _island(capacity: int):
    """applyInPandas body: rows (problem, island, key, length, bin_a, bin_b) of one island to its best packing in bin_a."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        elites = [pdf[c].to_numpy() for c in ("bin_a", "bin_b") if (pdf[c] >= 0).all()]
        seed = int(pdf["problem"].iloc[0] * 7919 + pdf["island"].iloc[0] + 31 * len(elites)) & 0x7FFFFFFF
        bins, _ = evolve(sizes, elites, capacity, seed)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - (np.cumsum(fill) - fill)[bins[order]]
        return pdf.assign(bin_a=bins, offset=offset, fill=fill[bins], n_bins=len(fill))[
            ["problem", "island", "key", "length", "bin_a", "offset", "fill", "n_bins"]
        ]

    return run


ISLAND_ROWS = "problem long, island int, key long, length long, bin_a long, offset long, fill long, n_bins long"


def pack_level(
    items: DataFrame, n_problems: int, capacity: int = SEQUENCE, islands: int = ISLANDS, rounds: int = ROUNDS, level: int = 0
) -> DataFrame:
    """(problem, key, length, bin, offset, fill): the best island's packing of each problem of ``items(key, length)``."""
    start = items.select(
        F.pmod(F.xxhash64("key", F.lit(level)), F.lit(n_problems)).alias("problem"),
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        "key",
        "length",
        F.lit(-1).cast("long").alias("bin_a"),
        F.lit(-1).cast("long").alias("bin_b"),
    )
    run = _island(capacity)
    state = stored(start.groupBy("problem", "island").applyInPandas(run, ISLAND_ROWS), "islands")
    for _ in range(rounds - 1):
        own = state.select("problem", "island", "key", "length", "bin_a")
        migrant = own.select("problem", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "key", F.col("bin_a").alias("bin_b"))
        both = own.join(migrant, ["problem", "island", "key"])
        state = stored(both.groupBy("problem", "island").applyInPandas(run, ISLAND_ROWS), "islands")
    best = state.groupBy("problem").agg(F.min(F.struct("n_bins", "island"))["island"].alias("island"))
    return state.join(best, ["problem", "island"]).select("problem", "key", "length", F.col("bin_a").alias("bin"), "offset", "fill")


def pack(items: DataFrame, capacity: int = SEQUENCE, problem: int = PROBLEM) -> DataFrame:
    """(key, sequence_id, offset) for items(key, length) of at most ``capacity`` each; keys are distinct.

    Well-filled bins of a level are final; the pieces of the others are dealt anew into fewer problems and packed again,
    until one problem holds them or a level makes hardly any bin final, which another one would not do either.
    """
    count = items.count()
    done: DataFrame | None = None
    level = 0
    while True:
        n_problems = max(1, -(-count // problem))
        packed = stored(pack_level(items, n_problems, capacity, level=level), "packed")
        full = F.col("fill") >= WELL_FILLED * capacity
        smaller = packed.where(~full).count() if n_problems > 1 else 0
        last = n_problems == 1 or smaller > (1 - LEAST_FINAL) * count
        packed = packed.withColumn("final", F.lit(True) if last else full)
        number = (F.col("problem") * F.lit(1 << 20) + F.col("bin")) * LEVELS + (level + 1)
        final = packed.where("final").select("key", number.alias("sequence_id"), "offset")
        done = final if done is None else done.unionByName(final)
        if last:
            return done
        if smaller == 0:
            return done
        items = packed.where("not final").select("key", "length")
        count, level = smaller, level + 1


def pack_documents(docs: DataFrame, json_path: str, size: int = SEQUENCE) -> DataFrame:
    """Each row's pieces with the sequence and the offset where they lie; offsets in a sequence leave no gaps.

    Null and empty texts are the single id 0; very long ones are cut into whole sequences and one shorter first piece.
    Repeated rows are packed as often as they occur. Among equal lengths any order may come out. Other columns of docs
    are ignored. An empty table gives an empty result.
    """
    p = pieces(docs, json_path, size).withColumn("key", F.monotonically_increasing_id())
    p = stored(p, "pieces")
    whole = p.where(F.col("length") == size).select("*", (F.col("key") * LEVELS).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = p.where(F.col("length") < size)
    packed = short.join(pack(short.select("key", "length"), size), "key")
    return whole.unionByName(packed).drop("key")


def tokenizer_file() -> str:
    """Path of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file())
