"""Set-similarity join on word n-grams by parity sketches.

Every shingle flips one bit of a sketch, so the Hamming distance of two sketches is at most the size of the sets'
symmetric difference. Two sets of Jaccard similarity t or more differ in at most (1 - t) / (1 + t) of their total
size; cut into one segment more than that, their sketches agree in at least one segment. Sets of like size meet by
equal segments, and those that meet are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import documents, drop_stored, map_batches, stored
from tickloom.llm.components import connected_components

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


#: Least bits of a folded sketch, members of a bucket in one block of a comparison, and pairs or words at a time.
LEAST_FOLD, BLOCK, AT_ONCE = 256, 1024, 1 << 18
#: How much wider the sketches of open buckets are, where all members meet, and the bits up to which they are.
WIDER, MOST_FOLD = 32, 1 << 16
#: Most ids of candidate texts that are sent to every task of the text scan (16 bytes each).
SENT_IDS = 1_000_000


def _mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x + MIX[k]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; fewer words than n make one shingle, none none.

    Words are what white space (blank, tab, line feed, vertical tab, form feed, return) separates; A-Z are lower-cased.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(tokens, dtype=object), categorize=False)
    n = min(words, len(tokens))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = _mixed(out * MIX[1] + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def band(size: int, threshold: float) -> int:
    """Sizes in one band differ by less than the factor ``threshold``, so linked sets lie in equal or next bands."""
    return int(math.floor(math.log(size) / -math.log(threshold) + 1e-9))


def segment_count(upper_band: int, threshold: float) -> int:
    """One more than the most that two linked sets below the top of ``upper_band`` can differ."""
    top = math.ceil(threshold ** -(upper_band + 1))
    return int((1 - threshold) / (1 + threshold) * 2 * top + 1e-6) + 1


def segment_keys(hashes: np.ndarray, threshold: float) -> np.ndarray:
    """Bucket keys of one set, for each of its two band pairs."""
    b = band(len(hashes), threshold)
    return np.concatenate([pair_keys(hashes, upper, segment_count(upper, threshold)) for upper in (b, b + 1)])


def pair_keys(hashes: np.ndarray, upper: int, n: int) -> np.ndarray:
    """Keys of the ``n`` segments of the sketch for the bands (upper - 1, upper).

    A segment has a bit for each 64-bit hash; the XOR of the hashes of its set bits stands for it. An empty segment
    says nothing, so its key takes in the segments after it. Around the ring of segments there is a start from which
    the first l segments of two linked sets differ in fewer than l bits (cycle lemma). From an empty start the key
    therefore adds the next segment, as it is and without up to as many of its bits as may differ, and goes on while
    what it holds is still empty. Sets whose keys meet share at least one shingle, or all segments are used up.
    """
    m = _mixed(hashes, 2)
    where = (m % np.uint64(n)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    where, bits = where[order], _mixed(m, 1)[order]
    word = np.zeros(n, np.uint64)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    word[where[first]] = np.bitwise_xor.reduceat(bits, first)

    starts, lengths, held = [np.arange(n)], [np.zeros(n, np.int64)], [word]
    if n > 1 and len(first) < n:
        empty = word == 0
        bare = np.flatnonzero(empty)
        after = word[(bare + 1) % n]
        less = empty[(where - 1) % n]  # bits that follow an empty segment, each left out once
        start, rest = np.r_[bare, (where[less] - 1) % n], np.r_[after, word[where[less]] ^ bits[less]]
        full = rest != 0
        starts, lengths, held = [np.flatnonzero(~empty), start[full]], [np.zeros(n - len(bare), np.int64), np.ones(full.sum(), np.int64)], [word[~empty], rest[full]]
        if not full.all():
            ends = np.searchsorted(where, np.arange(n + 1)).tolist()
            used = (np.arange(len(start)) >= len(bare)).astype(int)
            deep = [(i, *k) for i, u in zip(start[~full].tolist(), used[~full].tolist(), strict=True) for k in _chain(i, u, bits, ends)]
            deep = np.array(deep, np.uint64).reshape(-1, 3)
            starts, lengths, held = [*starts, deep[:, 0].astype(np.int64)], [*lengths, deep[:, 1].astype(np.int64)], [*held, deep[:, 2]]
    place = np.concatenate(starts) + (np.concatenate(lengths) << 32) + (upper << 40)
    return _mixed(_mixed(place.astype(np.uint64)) ^ np.concatenate(held), 1)


def _chain(start: int, used: int, bits: np.ndarray, ends: list[int]) -> Iterator[tuple[int, int]]:
    """(length, held) of the keys of a start whose next segment is empty or has lost its ``used`` only bit."""
    n = len(ends) - 1
    for length in range(2, n):
        at = (start + length) % n
        inside = bits[ends[at] : ends[at + 1]].tolist()
        word = 0
        for bit in inside:
            word ^= bit
        for left_out in range(min(length - used, len(inside) - 1) + 1):
            for gone in combinations(inside, left_out):
                held = word
                for bit in gone:
                    held ^= bit
                if held:
                    yield length, held
        used += len(inside)
        if used > length:
            return
    yield n, 0


def set_node(hashes: np.ndarray) -> int:
    """A 64-bit fingerprint of the set, so that equal sets are one node of the join."""
    if not len(hashes):
        return 0
    total = _mixed(hashes).sum(dtype=np.uint64, keepdims=True)
    total += _mixed(np.bitwise_xor.reduce(_mixed(hashes, 1), keepdims=True))
    return int(_mixed(total ^ np.uint64(len(hashes))).view(np.int64)[0])


#: Nodes that a task remembers, so that it sends the keys of copies once; others are removed after the shuffle.
SEEN = 1_000_000


def _described(words: int, threshold: float):
    """(doc_id, place, node, size, fold, keys) of each row; keys only with a set that the task meets for the first time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, folds, keys = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(text, words)
                nodes.append(node := set_node(s))
                sizes.append(len(s))
                folds.append(folded(s).tobytes())
                new = len(s) > 0 and node not in seen
                seen.add(node)
                keys.append(segment_keys(s, threshold).view(np.int64) if new else np.empty(0, np.int64))
            if len(seen) > SEEN:
                seen.clear()
            offsets = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("place"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(folds, pa.binary()),
                    pa.ListArray.from_arrays(offsets, flat),
                ],
                names=["doc_id", "place", "node", "size", "fold", "keys"],
            )

    return run


DESCRIBED = "doc_id long, place long, node long, size long, fold binary, keys array<long>"


def folded(hashes: np.ndarray, wider: int = 1) -> np.ndarray:
    """A parity sketch to rule out pairs before their sets are compared: the least power of two of bits over the size, or
    ``wider`` times as many, but not above MOST_FOLD for that."""
    n = max(LEAST_FOLD, 1 << int(len(hashes)).bit_length())
    n = max(n, min(n * wider, MOST_FOLD))
    at = (_mixed(hashes, 1) % np.uint64(n)).astype(np.int64)
    odd = (np.bincount(at, minlength=n) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def narrowed(folds: np.ndarray, words: int) -> np.ndarray:
    """Folded sketches, one a row, with their parts laid over each other down to ``words`` 64-bit words."""
    return np.bitwise_xor.reduce(folds.reshape(len(folds), -1, words), axis=1)


def most_apart(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of two linked sets whose sizes add up to ``sizes``."""
    return (sizes * (100 - percent)) // (100 + percent)


def _node_texts(words: int):
    """Rows (node, text) to (node, text), for texts whose set is the named node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("node").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
            found = [(node, t) for node, t in rows if set_node(shingle_set(t, words)) == node]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())],
                names=["node", "text"],
            )

    return run


def _wide_folds(words: int):
    """Rows (node, text) to (node, fold) with the wider sketch of the text's set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = [folded(shingle_set(t, words), WIDER).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(folds, pa.binary())], names=["node", "fold"])

    return run


def _folds(column: Iterable[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, width // 8)


def _near_batches(percent: int):
    """Of node pairs with both folded sketches, those whose sketches are close enough for a link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas()
            small, large = table[["size_u", "size_v"]].min(axis=1), table[["size_u", "size_v"]].max(axis=1)
            table = table[100 * small >= percent * large]
            kept = []
            for (x, y), g in table.groupby([table["fold_u"].map(len), table["fold_v"].map(len)]):
                fold_u, fold_v = (narrowed(_folds(g[c], w), min(x, y) // 8) for c, w in (("fold_u", x), ("fold_v", y)))
                apart = np.bitwise_count(fold_u ^ fold_v).sum(1, dtype=np.int64)
                kept.append(g[apart <= most_apart((g["size_u"] + g["size_v"]).to_numpy(), percent)])
            found = pd.concat(kept) if kept else table
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["u"].to_numpy(np.int64)), pa.array(found["v"].to_numpy(np.int64))], names=["u", "v"]
            )

    return run


def _verify_batches(words: int, percent: int):
    """Of node pairs with both texts, those with 100 * intersection >= percent * union of their sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=512)  # a popular node is in many pairs
        def shingles(text: bytes) -> np.ndarray:
            return shingle_set(text, words)

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text_u").to_pylist(), batch.column("text_v").to_pylist(), strict=True):
                x, y = shingles(x), shingles(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_sides(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    for side in ("u", "v"):
        wanted = nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(wanted.hint("merge"), side)
    return pairs


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    both = _with_sides(pairs, nodes, ["size", "fold"])
    return map_batches(both, _near_batches(percent), "u long, v long")


def _links(near: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The links among the pairs ``near``; only the texts of their nodes are read."""
    ends = near.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = _node_table(docs, nodes.join(ends, "node", "left_semi").select("node", "rep_place"), words)
    return map_batches(_with_sides(near, texts, ["text"]), _verify_batches(words, percent), "u long, v long")


def _node_table(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(node, text) of each node of ``reps(node, rep_place)``.

    Few places are sent to the text scan; more of them are joined by shuffle.
    """
    reps = stored(reps, "reps")
    reps = F.broadcast(reps) if reps.limit(SENT_IDS + 1).count() <= SENT_IDS else reps
    texts = docs.join(reps, F.col("place") == F.col("rep_place")).select("node", "text")
    found = stored(map_batches(texts, _node_texts(words), "node long, text binary"), "texts")
    repeated = found.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    return found if repeated.isEmpty() else stored(found.dropDuplicates(["node"]), "texts")


def _pivot_pairs(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest): each bucket's members paired with its most popular one, and the buckets without that one.

    A member is popular when many others share its segments; in a group of edited copies that is the text the copies
    come from, to which all of them are close even where two copies are not close to each other.
    """
    top = stored(buckets.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot")), "pivots")
    b = buckets.join(top, "key")
    rest = b.where(F.col("node") != F.col("pivot"))
    pairs = rest.select(F.greatest("pivot", "node").alias("u"), F.least("pivot", "node").alias("v")).distinct()
    return pairs, rest.drop("pivot")


def _unsettled(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """Members of buckets in which not all are known to be in one component yet."""
    named = buckets.drop("component").join(components, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    spans = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    return named.join(stored(spans.where("lo <> hi").select("key", "members"), "spans"), "key")


def _close(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, folds: list[bytes], percent: int) -> np.ndarray:
    """For rows x and y, pair by pair, whether the folded sketches are close enough for a link."""
    wide = np.array([len(f) for f in folds])
    out = np.zeros(len(x), bool)
    classes = wide[x] * (1 << 32) + wide[y]
    held = {w: (_folds([f for f in folds if len(f) == w], w), np.cumsum(wide == w) - 1) for w in np.unique(wide).tolist()}
    for c in np.unique(classes).tolist():
        of = np.flatnonzero(classes == c)
        (fold_x, at_x), (fold_y, at_y) = held[c >> 32], held[c & 0xFFFFFFFF]
        words = min(c >> 32, c & 0xFFFFFFFF) // 8
        fold_x, fold_y = narrowed(fold_x, words), narrowed(fold_y, words)
        for k in range(0, len(of), step := max(1, AT_ONCE // words)):
            i, j = x[of[k : k + step]], y[of[k : k + step]]
            apart = np.bitwise_count(fold_x[at_x[i]] ^ fold_y[at_y[j]]).sum(1, dtype=np.int64)
            out[of[k : k + step]] = apart <= most_apart(sizes[i] + sizes[j], percent)
    return out


def _compare_batches(percent: int):
    """Rows sorted by (key, lo, hi) to the pairs of different components whose folded sketches are close enough.

    One group holds the members of two blocks of a bucket, so it is bounded; a group may go over several batches.
    Pairs are made a bounded number at a time, and a pair that several buckets of such a portion have is compared once.
    """

    def pairs(lo: np.ndarray, hi: np.ndarray, block: np.ndarray, starts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of all pairs of each group, in portions."""
        held, n = [], 0
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            if lo[begin] == hi[begin]:
                a = b = np.arange(begin, end)
            else:
                rows = np.arange(begin, end)
                a, b = rows[block[begin:end] == lo[begin]], rows[block[begin:end] == hi[begin]]
            for k in range(0, len(a), step := max(1, AT_ONCE // max(1, len(b)))):
                part = a[k : k + step]
                held.append((np.repeat(part, len(b)), np.tile(b, len(part))))
                n += len(held[-1][0])
                if n >= AT_ONCE:
                    yield tuple(np.concatenate(h) for h in zip(*held, strict=True))
                    held, n = [], 0
        if held:
            yield tuple(np.concatenate(h) for h in zip(*held, strict=True))

    def compare(table: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        column = {c: table[c].to_numpy() for c in ("key", "lo", "hi", "block", "node", "component", "size")}
        new = np.zeros(len(table), bool)
        new[0] = True
        for c in ("key", "lo", "hi"):
            new[1:] |= column[c][1:] != column[c][:-1]
        starts = [*np.flatnonzero(new).tolist(), len(table)]
        node, size, component = column["node"], column["size"], column["component"]
        folds = table["fold"].tolist()
        for x, y in pairs(column["lo"], column["hi"], column["block"], starts):
            small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            keep = (component[x] != component[y]) & (100 * small >= percent * large)
            x, y = x[keep], y[keep]
            swap = node[x] < node[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            order = np.lexsort((node[y], node[x]))
            x, y = x[order], y[order]
            if len(x):
                once = np.r_[True, (node[x[1:]] != node[x[:-1]]) | (node[y[1:]] != node[y[:-1]])]
                x, y = x[once], y[once]
                near = _close(x, y, size, folds, percent)
                yield pa.RecordBatch.from_arrays([pa.array(node[x[near]]), pa.array(node[y[near]])], names=["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        names = ["key", "lo", "hi"]
        for batch in batches:
            table = batch.to_pandas()
            if not len(table):
                continue
            last = (table[names] == table[names].iloc[-1]).all(axis=1)
            if last.all() and held and (held[-1][names].iloc[-1] == table[names].iloc[0]).all():
                held.append(table)
                continue
            whole = pd.concat([*held, table[~last]])
            if len(whole):
                yield from compare(whole)
            held = [table[last]]
        if held:
            yield from compare(pd.concat(held))

    return run


def _open_pairs(buckets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within each bucket that may be links, without listing all pairs as rows."""
    b = buckets.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("long"))
    b = b.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    b = b.join(nodes.select("node", "size", "fold").hint("merge"), "node")
    b = b.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    b = b.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "component", "size", "fold")
    b = b.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return map_batches(b, _compare_batches(percent), "u long, v long").distinct()


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the least doc_id reachable over links, itself included.

    Two texts link when 100 * shared shingles >= percent * all shingles of both. Texts without words (null, empty,
    white space) link with nothing. Equal shingle sets are one node, so repeated rows and copies add no pairs.
    Candidates come from equal sketch segments. In each bucket the members are first compared with its most popular
    member; where that leaves several components, members of different ones are compared in blocks inside the tasks,
    which pass on only pairs whose sketches are close, so no link between components is missed. Rows with equal
    doc_id count as equal ids; rows with a null id link like others, and a group of such rows alone has a null id.
    Other columns of docs are ignored. Very long texts are compared whole.
    """
    threshold = percent / 100
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("place"))  # finds a node's text again
    described = stored(map_batches(docs, _described(words, threshold), DESCRIBED), "described")
    keyed = described.select("node", F.explode("keys").alias("key")).repartition("key")
    shared = keyed.dropDuplicates(["key", "node"])
    w = Window.partitionBy("key")
    buckets = stored(shared.withColumn("n", F.count("*").over(w)).where("n > 1").select("key", "node", "n"), "buckets")
    ids = stored(described.drop("keys"), "nodes")
    drop_stored(described)
    weight = stored(buckets.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place"))["place"]
    reps = ids.where("size > 0").groupBy("node").agg(first.alias("rep_place"), F.first("size").alias("size"), F.first("fold").alias("fold"))
    nodes = stored(reps.join(weight, "node", "left_semi"), "candidates")
    pairs, rest = _pivot_pairs(stored(buckets.join(weight, "node").select("key", "node", "weight"), "weighed"))
    drop_stored(buckets)
    links = stored(_links(stored(_near(pairs, nodes, percent), "near"), docs, nodes, words, percent), "links")
    components = stored(connected_components(links), "components")
    open_ = stored(_unsettled(rest, components), "open")
    inside = nodes.join(open_.select("node").distinct(), "node", "left_semi")
    texts = _node_table(docs, inside.select("node", "rep_place"), words)
    wide = stored(map_batches(texts, _wide_folds(words), "node long, fold binary"), "wide")
    near = stored(_open_pairs(open_, inside.drop("fold").join(wide, "node"), percent), "near")
    more = None if near.isEmpty() else stored(_links(near, docs, nodes, words, percent), "links")
    if more is not None and not more.isEmpty():
        components = stored(connected_components(components.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "components")
    named = ids.drop("fold").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    alone = named.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = named.where("size > 0")
    # A table of its own on either side of the join, so that Spark can split a large component.
    least = stored(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    linked = linked.join(least, "component").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    drop_stored(nodes)
    return linked.unionByName(alone)


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80, sent: int = SENT_IDS) -> DataFrame:
    """The documents whose id is their group's least, with all columns as they are.

    Of rows with that id every one stays, and so do rows with a null id, which cannot be told apart, and texts without
    words. Ids that go are sent to the scan while they are few, and joined by shuffle beyond that.
    """
    gone = similar_groups(docs, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"))
    gone = stored(gone.distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= sent else gone
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir), words=3, percent=90)
