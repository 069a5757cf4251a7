"""A class-based bigram language model (Brown et al.): exchange clustering and smoothed scores.

Tokens are known by a 64-bit hash. Counts and class transitions are gathered from all training texts by Spark. The most
frequent tokens get their classes by exchange: a first clustering of a bounded number of units on the driver, then rounds
on Spark in which a task moves its own tokens against the broadcast matrix of class transitions. Every other token of the
training texts then gets the class that its own neighbours make likeliest. A token's probability is that of its class
after the class before, times the token's share of its class.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import documents, drop_stored, id_remainder, map_batches, stored

#: Units that the clustering starts from: frequent tokens, and groups of the other tokens by their ending.
FREQUENT, ENDINGS = 700, 324
#: Least number of classes; it grows with the cube root of the number of distinct tokens.
CLASSES = 40
#: Rounds of exchange on Spark at most; they end before that when few tokens move.
ROUNDS = 2
#: Tokens that move in every round, and whose hashes, counts and classes every task holds (18 bytes each, a fixed bound).
#: All others are classed once, by their own neighbours, and joined.
HELD = 1_000_000
#: Token-to-class neighbour pairs that a task counts before it passes the counts on, of held tokens (8 bytes each) and of
#: rare ones (16 bytes each), and pairs meant for one moving task.
FLUSH_PAIRS, FLUSH_RARE, PAIRS_A_TASK = 2_000_000, 1_000_000, 1_000_000
#: Neighbour counts whose gains are looked up, and entries whose gains are worked out at a time.
SMALL, CHUNK = 8, 10_000
#: Bytes of text whose tokens are held as objects at a time, and tokens that a task counts before it passes the counts on.
PIECE, FLUSH = 1 << 20, 2_000_000
#: The end token; no word contains a line feed.
END = b"\n"


def tokens(text: bytes | None) -> list[bytes]:
    """Words between white space with A-Z lower-cased, then one end token."""
    return [*(text.lower().split() if text else ()), END]


def token_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each token; among a billion tokens the expected number of equal pairs is 0.03."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)


END_HASH = token_hashes([END])[0]


def ending_groups(words: list[bytes], groups: int) -> np.ndarray:
    """Group of each token by its last three bytes: where clustering starts, and for tokens that training did not see."""
    return np.array([zlib.crc32(w[-3:]) % groups for w in words], np.int64)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about PIECE bytes of text, a text at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text").cast(pa.binary())).fill_null(0).to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE, prepend=0))
        for a, b in itertools.pairwise([0, *cuts[cuts > 0].tolist(), batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def flat_tokens(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """All tokens of a batch's texts one after the other, and where each text starts, with the end."""
    flat: list[bytes] = []
    starts = [0]
    for text in batch.column("text").cast(pa.binary()).to_pylist():
        flat += tokens(text)
        starts.append(len(flat))
    return flat, np.array(starts)


def token_counts(train: DataFrame, endings: int) -> DataFrame:
    """(h, n, ending) over all training texts: hash, count and ending group; each task counts before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, n, e = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, at = np.unique(h, return_index=True, return_inverse=True)
            return u, np.bincount(at, weights=n, minlength=len(u)).astype(np.int64), e[first]

        def out(h: np.ndarray, n: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(e.astype(np.int16))], names=["h", "n", "ending"])

        for batch in pieces(batches):
            flat, _ = flat_tokens(batch)
            u, first, n = np.unique(token_hashes(flat), return_index=True, return_counts=True)
            held.append((u, n, ending_groups([flat[k] for k in first.tolist()], endings)))
            size += len(u)
            if size > FLUSH:
                whole = merged()
                held, size = [whole], len(whole[0])
                if size > FLUSH // 2:  # counting has shrunk it little
                    yield out(*whole)
                    held, size = [], 0
        if held:
            yield out(*merged())

    found = map_batches(train.select("text"), run, "h long, n long, ending short")
    return found.groupBy("h").agg(F.sum("n").alias("n"), F.first("ending").alias("ending"))


def packed(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values that hold the numbers of each text: how many, then their bytes by place, compressed."""
    ids = np.ascontiguousarray(ids, np.int32)
    codec = pa.Codec("zstd", compression_level=1)
    out = []
    for a, b in itertools.pairwise(starts.tolist()):
        planes = ids[a:b].view(np.uint8).reshape(-1, 4).T.tobytes()
        out.append((b - a).to_bytes(4, "little") + codec.compress(planes, asbytes=True) if b > a else b"")
    return pa.array(out, pa.binary())


def unpacked(values: pa.Array) -> np.ndarray:
    """The numbers of all texts of a batch, one after the other."""
    codec = pa.Codec("zstd")
    out = [np.empty(0, np.int32)]
    for v in values.to_pylist():
        if v:
            n = int.from_bytes(v[:4], "little")
            planes = np.frombuffer(codec.decompress(v[4:], 4 * n, asbytes=True), np.uint8)
            out.append(np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel())
    return np.concatenate(out)


CODED = "row long, doc_id long, train boolean, n_tokens long, n_held long, log_held double, ids binary, rare array<long>"


def coded(docs: DataFrame, training: Column, held, endings: int) -> DataFrame:
    """Texts as numbers: a held token's rank, or -1 minus the ending group of another; ``rare`` has the others' hashes in order.

    ``held`` is a broadcast (sorted hashes, their ranks, counts by rank).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, n = held.value
        logs = np.log10(n + 1.0)
        for batch in pieces(batches):
            flat, starts = flat_tokens(batch)
            u, first, at = np.unique(token_hashes(flat), return_index=True, return_inverse=True)
            where = np.minimum(np.searchsorted(known, u), max(0, len(known) - 1))
            ok = known[where] == u if len(known) else np.zeros(len(u), bool)
            ids = np.where(ok, rank[where], 0) if len(known) else np.zeros(len(u), np.int64)
            odd = np.flatnonzero(~ok)
            ids[odd] = -1 - ending_groups([flat[k] for k in first[odd].tolist()], endings)
            log_n = np.where(ok, logs[np.maximum(ids, 0)], 0.0) if len(logs) else np.zeros(len(u))
            x, is_held = ids[at], ok[at]
            n_held = np.add.reduceat(is_held.astype(np.int64), starts[:-1])
            size = np.diff(starts)
            ends = np.r_[0, np.cumsum(size - n_held)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("train"),
                    pa.array(size),
                    pa.array(n_held),
                    pa.array(np.add.reduceat(log_n[at], starts[:-1])),
                    packed(x, starts),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(u[at[~is_held]].view(np.int64))),
                ],
                names=["row", "doc_id", "train", "n_tokens", "n_held", "log_held", "ids", "rare"],
            )

    rows = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("train")).withColumn("row", F.monotonically_increasing_id())
    return map_batches(rows, run, CODED)


def transitions(train: DataFrame, label: np.ndarray | None, k: int, column: str = "ids") -> np.ndarray:
    """k x k matrix: how often a token of label b follows one of label a; a text starts after the end token's label 0.

    Without ``label`` the numbers in the column are labels themselves. Negative numbers count from the end of ``label``.
    """
    shared = train.sparkSession.sparkContext.broadcast(label)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            x = unpacked(batch.column(column))
            if len(x):
                x = (x if shared.value is None else shared.value[x]).astype(np.int64)
                total += np.bincount(np.r_[0, x[:-1]] * k + x, minlength=k * k)  # every text ends with the end token
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // k), pa.array(at % k), pa.array(total[at])], names=["a", "b", "n"])

    found = map_batches(train.select(column), run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((k, k))  # at most k squared rows, however large the corpus
    out[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    shared.destroy()
    return out


def xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(g: np.ndarray) -> float:
    return float(xlog(g).sum() - xlog(g.sum(1)).sum() - xlog(g.sum(0)).sum())


def best_classes(word: np.ndarray, at: np.ndarray, n: np.ndarray, own: np.ndarray | None, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, classes): of tokens with a class ``own`` those that should move, of tokens without one all of them.

    Rows are sorted by ``word``. ``at`` is the class before the token, or the number of classes plus the class after it,
    and n how often it was there. ``own`` has the present class of each distinct word in order.
    """
    classes = len(g)
    around = np.concatenate([g, g.T])
    logs = xlog(around)
    small = np.stack([xlog(around + k) - logs for k in range(1, SMALL + 1)]).astype(np.float32)
    rows, cols = g.sum(1), g.sum(0)

    def margin(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        some, back = np.unique(n, return_inverse=True)
        return (xlog(x + some[:, None]) - xlog(x))[back]

    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    # Chunks begin with the first token after each CHUNK entries; a token has at most two entries a class.
    firsts = np.unique(np.searchsorted(starts, np.arange(0, len(word), CHUNK)))
    ids, targets = [], []
    for first, last in itertools.pairwise([*firsts[firsts < len(starts)].tolist(), len(starts)]):
        i, j = starts[first], starts[last] if last < len(starts) else len(word)
        a, m, s = at[i:j], n[i:j], starts[first:last] - i
        change = small[np.minimum(m, SMALL) - 1, a]
        big = np.flatnonzero(m > SMALL)
        change[big] = xlog(around[a[big]] + m[big, None]) - logs[a[big]]
        gain = np.add.reduceat(change, s).astype(float)
        into = np.add.reduceat(np.where(a < classes, m, 0), s)
        out = np.add.reduceat(m, s) - into
        gain -= margin(cols, into) + margin(rows, out)
        gain[:, 0] = -np.inf  # the end token's own class
        w = word[starts[first:last]]
        if own is None:
            ids.append(w)
            targets.append(gain.argmax(1))
            continue
        mine = own[first:last].astype(np.int64)
        with_own = around[a, np.repeat(mine, np.diff(np.r_[s, j - i]))]
        stay = np.add.reduceat(xlog(with_own) - xlog(np.maximum(with_own - m, 0)), s)
        stay -= xlog(cols[mine]) - xlog(cols[mine] - into) + xlog(rows[mine]) - xlog(rows[mine] - out)
        gain[np.arange(len(w)), mine] = stay
        best = gain.argmax(1)
        moves = (best != mine) & (gain.max(1) > stay + 1e-9)
        ids.append(w[moves])
        targets.append(best[moves])
    none = np.empty(0, np.int64)
    return np.concatenate(ids or [none]), np.concatenate(targets or [none])


def _summed(word: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows sorted by (word, at), equal ones made one."""
    order = np.lexsort((at, word))
    word, at, n = word[order], at[order], n[order]
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (at[1:] != at[:-1])])
    return word[first], at[first], np.add.reduceat(n, first, dtype=np.int64)


def _neighbours(train: DataFrame, label, classes: int, parts: int, rare: bool) -> DataFrame:
    """(part, size, word, at, n) with packed neighbour counts of the held tokens or of the ``rare`` ones, dealt by word.

    ``label`` is a broadcast of the class of each rank, then of the ending groups from the end.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []  # numbers that stand for a rank and a place; of rare tokens the hashes
        ats: list[np.ndarray] = []  # places of rare tokens
        size = 0

        def counted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            pair = np.concatenate(pairs)
            pairs.clear()
            if rare:
                at = np.concatenate(ats)
                ats.clear()
                return _summed(pair, at, np.ones(len(pair), np.int32))
            pair.sort()
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            n = np.diff(first, append=len(pair)).astype(np.int32)
            word, at = np.divmod(pair[first], 2 * classes)
            return word, at.astype(np.int32), n

        def out() -> pa.RecordBatch:
            word, at, n = counted()
            part = (word % np.int64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            some = [p for p in range(parts) if cut[p] < cut[p + 1]]

            def column(x: np.ndarray, kind) -> pa.Array:
                x = x[order].astype(kind)
                return pa.array([pa.compress(x[cut[p] : cut[p + 1]].tobytes(), "zstd", asbytes=True) for p in some], pa.binary())

            sizes = pa.array([int(cut[p + 1] - cut[p]) for p in some], pa.int32())
            columns = [pa.array(some, pa.int32()), sizes, column(word, np.int64), column(at, np.int32), column(n, np.int32)]
            return pa.RecordBatch.from_arrays(columns, names=["part", "size", "word", "at", "n"])

        for batch in batches:
            x = unpacked(batch.column("ids"))
            if not len(x):
                continue
            c = label.value[x].astype(np.int64)
            before, after = np.r_[0, c[:-1]], np.r_[c[1:], 0]
            mine = np.flatnonzero(x < 0 if rare else x >= 0)
            last = np.flatnonzero(c[mine] != 0)  # the end token keeps its class, and what follows it is another text
            mine = mine[last]
            places = [before[mine], classes + after[mine]]
            if rare:
                word = batch.column("rare").flatten().to_numpy()
                pairs += [word, word]
                ats += [at.astype(np.int32) for at in places]
            else:
                word = x[mine].astype(np.int64) * (2 * classes)
                pairs += [word + at for at in places]
            size += 2 * len(mine)
            if size > (FLUSH_RARE if rare else FLUSH_PAIRS):
                yield out()
                size = 0
        if size:
            yield out()

    columns = ["ids", "rare"] if rare else ["ids"]
    return map_batches(train.select(*columns), run, "part int, size int, word binary, at binary, n binary").repartition(parts, "part")


def _moved(counted: DataFrame, label, g: np.ndarray, rare: bool) -> DataFrame:
    """(word, cls) of the tokens that should move, or of all rare tokens."""
    shared = counted.sparkSession.sparkContext.broadcast(g)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for size, *columns in zip(*[batch.column(c).to_pylist() for c in ("size", "word", "at", "n")], strict=True):
                kinds = (np.int64, np.int32, np.int32)
                got.append(tuple(np.frombuffer(pa.decompress(x, size * np.dtype(k).itemsize, "zstd"), k) for x, k in zip(columns, kinds, strict=True)))
        if got:
            word, at, n = _summed(*(np.concatenate(x) for x in zip(*got, strict=True)))
            got.clear()
            own = None if rare else label.value[word[np.r_[True, word[1:] != word[:-1]]]]
            ids, to = best_classes(word, at, n, own, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(to.astype(np.int32))], names=["word", "cls"])

    return map_batches(counted, run, "word long, cls int")


def cluster(train: DataFrame, start: np.ndarray, tail: np.ndarray, classes: int, n_pairs: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each held token, class transitions) after exchange rounds from ``start``; no round lowers the likelihood.

    The tokens of a round move at once. Where that lowers the likelihood, a half and then a quarter of them move.
    ``tail`` has the classes of the ending groups, from the last to the first.
    """
    context = train.sparkSession.sparkContext
    parts = max(8, n_pairs // PAIRS_A_TASK)
    cls, g = start, transitions(train, np.r_[start, tail], classes)
    for _ in range(rounds):
        label = context.broadcast(np.r_[cls, tail])
        found = _moved(_neighbours(train, label, classes, parts, rare=False), label, g, rare=False).toArrow()  # at most the held tokens
        label.destroy()
        ids, to = found["word"].to_numpy(), found["cls"].to_numpy()
        better = False
        for share in (1, 2, 4):
            some = ids % share == 0
            tried = cls.copy()
            tried[ids[some]] = to[some]
            after = transitions(train, np.r_[tried, tail], classes) if some.any() else g
            if better := likelihood(after) > likelihood(g):
                cls, g = tried, after
                break
        if not better or len(ids) < 0.005 * len(cls):
            break
    return cls, g


def exchange(counts: np.ndarray, classes: int, end: int, rounds: int = 6) -> np.ndarray:
    """Class of each unit: moves units to the class that most raises the class bigram likelihood, until few move.

    ``counts`` is the units x units matrix of pairs. The end unit keeps class 0 to itself.
    """
    n = len(counts)
    weight = counts.sum(0)
    order = [u for u in np.argsort(-weight, kind="stable") if u != end and weight[u] > 0]
    cls = np.full(n, 1, np.int64)
    cls[end] = 0
    for k, u in enumerate(order):
        cls[u] = 1 + k % (classes - 1)
    one = np.zeros((n, classes))
    one[np.arange(n), cls] = 1
    to, fro = counts @ one, counts.T @ one  # pairs of a unit with each following and each preceding class
    for _ in range(rounds):
        g = one.T @ to
        moved = 0
        for u in order:
            c = cls[u]
            own = counts[u, u]
            out, into = to[u].copy(), fro[u].copy()
            out[c] -= own
            into[c] -= own
            g[c, :] -= out
            g[:, c] -= into
            g[c, c] -= own
            rows, cols = g.sum(1), g.sum(0)
            after, before = np.flatnonzero(out), np.flatnonzero(into)  # other entries do not change
            gain = (xlog(g[:, after] + out[after]) - xlog(g[:, after])).sum(1)
            gain += (xlog(g[before] + into[before, None]) - xlog(g[before])).sum(0)
            diag = np.diagonal(g)
            gain += xlog(diag + out + into + own) - xlog(diag + out) - xlog(diag + into) + xlog(diag)
            wo, wi = out.sum() + own, into.sum() + own
            gain -= xlog(rows + wo) - xlog(rows) + xlog(cols + wi) - xlog(cols)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            g[best, :] += out
            g[:, best] += into
            g[best, best] += own
            if best != c:
                moved += 1
                cls[u] = best
                one[u, c], one[u, best] = 0, 1
                to[:, c] -= counts[:, u]
                to[:, best] += counts[:, u]
                fro[:, c] -= counts[u]
                fro[:, best] += counts[u]
        if moved < 0.005 * len(order):
            break
    return cls


CLASSED = "doc_id long, train boolean, n_tokens long, n_known long, log_count double, classes binary"


def _classed(label, unseen):
    """Rows of ``coded`` with the counts and classes found for rare tokens, to their classes and log counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpacked(batch.column("ids"))
            sizes = batch.column("n_tokens").to_numpy()
            c = label.value[x].astype(np.int32)
            odd = np.flatnonzero(x < 0)
            n_odd = sizes - batch.column("n_held").to_numpy()
            first = np.r_[0, np.cumsum(n_odd)]
            places, lengths = batch.column("places"), batch.column("places").value_lengths().fill_null(0).to_numpy()
            at = places.flatten().to_numpy() + np.repeat(first[:-1], lengths)  # which of the batch's rare tokens
            cls, n = batch.column("found").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            c[odd] = unseen.value[-1 - x[odd]]
            c[odd[at]] = cls
            logs = np.zeros(len(odd))
            logs[at] = np.log10(n + 1.0)
            total = np.r_[0, np.cumsum(logs)]
            starts = np.r_[0, np.cumsum(sizes)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("train"),
                    batch.column("n_tokens"),
                    pa.array(batch.column("n_held").to_numpy() + lengths),
                    pa.array(batch.column("log_held").to_numpy() + total[first[1:]] - total[first[:-1]]),
                    packed(c, starts),
                ],
                names=["doc_id", "train", "n_tokens", "n_known", "log_count", "classes"],
            )

    return run


def _chains(step):
    """The class chain's log10 probability of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = unpacked(batch.column("classes"))
            starts = np.r_[0, np.cumsum(batch.column("n_tokens").to_numpy())][:-1]
            before = np.r_[0, c[:-1]]
            before[starts] = 0
            chain = np.add.reduceat(step.value[before, c], starts)
            columns = ("doc_id", "n_tokens", "n_known", "log_count")
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in columns], pa.array(chain)], names=[*columns, "chain"])

    return run


class Model(NamedTuple):
    """What training leaves: texts as classes, tokens' classes (h, n, ending, cls), transitions, and class totals."""

    texts: DataFrame
    words: DataFrame
    transitions: np.ndarray
    members: np.ndarray
    unseen: np.ndarray
    n_tokens: int
    n_distinct: int

    def steps(self, strength: float = 20.0) -> np.ndarray:
        """log10 of a class's probability after another, less that of its number of places: the counts of its tokens plus
        one each, and one place for tokens that training did not see. Transitions are smoothed towards class frequencies."""
        g = self.transitions
        smooth = g.sum(0) + 1
        step = np.log10((g + strength * smooth / smooth.sum()) / (g.sum(1, keepdims=True) + strength))
        return step - np.log10(g.sum(0) + self.members + 1)


def train_model(
    docs: DataFrame, training: Column, classes: int | None = None, frequent: int = FREQUENT, endings: int = ENDINGS, held: int = HELD, rounds: int = ROUNDS
) -> Model:
    """Counts, clusters and classes the tokens of the rows where ``training`` holds, and writes all texts as classes.

    Every token that training saw has a class of its own neighbours' making; one that it did not see has the class that
    most distinct held tokens of its ending group have.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    counts = stored(token_counts(docs.where(training), endings), "counts")
    n_all, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    classes = classes or max(CLASSES, round(n_distinct ** (1 / 3)))
    is_end = F.col("h") == F.lit(int(END_HASH.view(np.int64)))
    top = counts.orderBy(F.desc(is_end), F.desc("n"), "h").limit(held).toArrow()  # a fixed bound
    h, n, ending = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["ending"].to_numpy().astype(np.int64)
    del top
    order = np.argsort(h)
    known = context.broadcast((h[order], order.astype(np.int32), n))
    texts = stored(coded(docs, training, known, endings), "coded")
    train = texts.where("train")
    cls, g, usual = np.zeros(len(h), np.int16), np.zeros((classes, classes)), np.ones(endings, np.int16)
    if n_distinct:
        leading = min(frequent, len(h))  # rank 0 is the end token
        unit = np.r_[np.arange(leading), leading + ending[leading:], leading + np.arange(endings)[::-1]].astype(np.int16)
        units = exchange(transitions(train, unit, leading + endings), classes, 0).astype(np.int16)
        start, tail = units[unit[: len(h)]], units[leading:][::-1]
        cls, g = cluster(train, start, tail, classes, 2 * n_all, rounds)
        kinds = np.bincount(ending * classes + cls, minlength=endings * classes).reshape(endings, classes)
        kinds[:, 0] = 0  # the end token's own class
        usual = np.where(kinds.sum(1) > 0, kinds.argmax(1), max(1, int(kinds.sum(0).argmax()))).astype(np.int16)
    label = context.broadcast(np.r_[cls, units[leading:][::-1]] if n_distinct else usual[::-1])
    unseen = context.broadcast(usual)
    parts = max(8, 2 * int(n_all - n.sum()) // PAIRS_A_TASK)
    rare = _moved(_neighbours(train, label, classes, parts, rare=True), label, g, rare=True).withColumnRenamed("word", "h")
    rare = stored(counts.join(rare, "h").select("h", "n", "ending", "cls"), "rare") if n_distinct > len(h) else counts.limit(0).withColumn("cls", F.lit(0))
    places = texts.select("row", F.posexplode("rare").alias("place", "h")).join(rare, "h")
    places = places.groupBy("row").agg(F.collect_list(F.struct("place", "cls", "n")).alias("x"))
    none = F.array().cast("array<int>")
    full = texts.drop("rare").join(places, "row", "left").select(
        *["doc_id", "train", "n_tokens", "n_held", "log_held", "ids"],
        F.coalesce("x.place", none).alias("places"),
        F.coalesce("x.cls", none).alias("found"),
        F.coalesce("x.n", F.array().cast("array<long>")).alias("times"),
    )
    out = stored(map_batches(full, _classed(label, unseen), CLASSED), "classed")
    drop_stored(texts)
    g = transitions(out.where("train"), None, classes, "classes")
    members = np.bincount(cls, minlength=classes)
    for r in rare.groupBy("cls").agg(F.count("*").alias("k")).collect():  # one row a class
        members[r["cls"]] += r["k"]
    ranks = spark.createDataFrame(pa.table({"h": h.view(np.int64), "n": n, "ending": ending.astype(np.int16), "cls": cls.astype(np.int32)}))
    words = ranks.unionByName(rare)
    return Model(out, words, g, members, usual, n_all, n_distinct)


def train_and_score(
    docs: DataFrame, training: Column, classes: int | None = None, frequent: int = FREQUENT, endings: int = ENDINGS, held: int = HELD, rounds: int = ROUNDS
) -> DataFrame:
    """Base and class-model log10 probabilities of every row's text, learnt from the rows where ``training`` holds.

    Texts are whole; a null text is the end token alone, as the empty one is. Each class gives one place to unseen tokens,
    so they have a probability. Without training rows (or in an empty table) every token is unseen. Repeated rows are
    scored, and counted in training, as often as they occur. Other columns of docs are ignored. Of tokens with equal
    counts those with lower hashes are held, of classes with equal gain the first is taken.
    """
    model = train_model(docs, training, classes, frequent, endings, held, rounds)
    step = docs.sparkSession.sparkContext.broadcast(model.steps())
    scored = map_batches(model.texts.drop("train"), _chains(step), "doc_id long, n_tokens long, n_known long, log_count double, chain double")
    score = F.col("chain") + F.col("log_count")
    return scored.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("log_count") - F.col("n_tokens") * F.lit(float(np.log10(model.n_tokens + model.n_distinct + 1)))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 7) == 2
    out = train_and_score(documents(spark, sf_dir), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
