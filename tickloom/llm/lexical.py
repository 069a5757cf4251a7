"""Ranked lexical search: the best documents of each item, by branch and bound over document FP-trees.

Documents keep only the terms that items ask for, most frequent first, so that vectors with the same beginnings share a
path of a trie. Every node knows, for all terms below it, the largest tf, and the smallest m: together they bound the
score of any document below for any item. A walk down the tree drops, at each node, the items whose bound stays under
their tenth best score so far, and leaves a subtree once no item is left. Trees hold blocks of documents; what is best in
each task is merged by Spark. All scores are integers.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import documents, map_batches, stored

#: Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z are lower-cased.
_LETTERS = {ord(c) for c in string.ascii_letters + string.digits} | set(range(128, 256))
SIGNS = bytes(ord(chr(b).lower()) if b < 128 and b in _LETTERS else b if b in _LETTERS else 32 for b in range(256))
#: Documents to return of each item.
BEST = 10
#: Share of a document's length in m, in hundredths.
LENGTH_SHARE = 75
#: Distinct terms of the items that are searched at once (an item with more makes a block alone), and items.
BLOCK_TERMS, BLOCK_ITEMS = 8_192, 1_024
#: Numbers in the table of tf maxima of one tree; documents in a tree follow from it.
TREE_CELLS = 12_000_000


def terms(text: str | None) -> list[bytes]:
    """A text's terms in order, as UTF-8."""
    return (text or "").encode().translate(SIGNS).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_norm(n_terms: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of so many terms, among n documents with terms that have ``total`` together."""
    return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(k) * n // total for k in n_terms.tolist()], np.int64)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of a score that grows with tf and falls with m; 0 where tf is 0."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Items:
    """A block of items: those of item i are ``term[first[i]:first[i + 1]]``, each with weight times occurrences."""

    first: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def scores(self, active: np.ndarray, tf: np.ndarray, m: int) -> np.ndarray:
        """The scores of the active items for the numbers tf (of every term) and m: a bound, or a document's own."""
        size = self.first[active + 1] - self.first[active]
        start = np.cumsum(size) - size
        at = np.repeat(self.first[active] - start, size) + np.arange(int(size.sum()))
        return np.add.reduceat(self.value[at] * saturation(tf[self.term[at]], m), start)


class Best:
    """The best documents of each item so far: highest score first, then the smaller id; ids that are null come last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.held: list[list[tuple[int, bool, int]]] = [[] for _ in range(n_items)]
        self.least = np.zeros(n_items, np.int64)  # a score under this, or 0, can't be among the best

    def offer(self, item: int, score: int, ids: list[int | None]) -> None:
        held = self.held[item] + [(-score, d is None, d or 0) for d in ids]
        held.sort()
        self.held[item] = held[: self.k]
        if len(held) >= self.k:
            self.least[item] = -self.held[item][-1][0]


class Tree:
    """A document FP-tree over vectors (terms ascending, most frequent first) with tf and m; chains are one node.

    ``tf[v]`` holds the tf maxima below node v, ``m[v]`` the smallest m, ``children[v]`` its children or, for a leaf,
    its documents are ``leaf[v]``: those with the same terms.
    """

    def __init__(self, vectors: list[tuple[bytes, np.ndarray, np.ndarray, int]], n_terms: int):
        """vectors: (key, terms, tf, m), sorted by key; the key is the terms as big-endian 32-bit numbers."""
        self.vectors = vectors
        self.tf: list[np.ndarray] = []
        self.m: list[int] = []
        self.children: list[list[int]] = []
        self.leaf: list[tuple[int, int]] = []
        self.n_terms = n_terms
        leaves: list[tuple[int, int]] = []
        for k, v in enumerate(vectors):
            if k and v[0] == vectors[k - 1][0]:
                leaves[-1] = (leaves[-1][0], k + 1)
            else:
                leaves.append((k, k + 1))
        shared = [_shared(vectors[a[0]][0], vectors[b[0]][0]) for a, b in zip(leaves, leaves[1:], strict=False)]
        self.root = self._grow(leaves, shared)

    def _node(self, tf: np.ndarray, m: int, children: list[int], leaf: tuple[int, int]) -> int:
        self.tf.append(tf)
        self.m.append(m)
        self.children.append(children)
        self.leaf.append(leaf)
        return len(self.m) - 1

    def _grow(self, leaves: list[tuple[int, int]], shared: list[int]) -> int:
        """Nodes from the leaves, in order, and the length of the path that each shares with the next one."""
        open_nodes: list[tuple[int, list[int]]] = [(0, [])]  # (depth, children) from the root down
        for k, (lo, hi) in enumerate(leaves):
            tf = np.zeros(self.n_terms, np.int32)
            for _, t, f, _ in self.vectors[lo:hi]:
                tf[t] = np.maximum(tf[t], f)
            node = self._node(tf, min(v[3] for v in self.vectors[lo:hi]), [], (lo, hi))
            depth = shared[k] if k < len(shared) else 0
            if depth > open_nodes[-1][0]:
                open_nodes.append((depth, []))
            open_nodes[-1][1].append(node)
            while open_nodes[-1][0] > depth:
                _, below = open_nodes.pop()
                done = self._join(below)
                if depth > open_nodes[-1][0]:
                    open_nodes.append((depth, []))
                open_nodes[-1][1].append(done)
        return self._join(open_nodes[0][1])

    def _join(self, below: list[int]) -> int:
        return self._node(reduce(np.maximum, [self.tf[c] for c in below]), min(self.m[c] for c in below), below, (0, 0))

    def search(self, items: Items, ids: list[list[int | None]], best: Best) -> int:
        """Walks down from the root, the most promising child first; returns the nodes that were looked at."""
        todo = [(self.root, np.arange(len(items.first) - 1))]
        seen = 0
        while todo:
            node, active = todo.pop()
            seen += 1
            bound = items.scores(active, self.tf[node], self.m[node])
            hope = (bound > 0) & (bound >= best.least[active])
            if not hope.any():
                continue
            active, bound = active[hope], bound[hope]
            if self.children[node]:
                below = self.children[node]
                order = sorted(below, key=lambda c: int(self.tf[c].sum()))
                todo += [(c, active) for c in order]
                continue
            lo, hi = self.leaf[node]
            for k in range(lo, hi):
                _, t, f, m = self.vectors[k]
                if hi - lo > 1:
                    tf = np.zeros(self.n_terms, np.int32)
                    tf[t] = f
                    bound = items.scores(active, tf, m)
                for j in np.flatnonzero((bound > 0) & (bound >= best.least[active])).tolist():
                    best.offer(int(active[j]), int(bound[j]), ids[k])
        return seen


def _shared(a: bytes, b: bytes) -> int:
    """How many terms two keys begin with alike."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint32, n // 4) != np.frombuffer(b, np.uint32, n // 4))
    return int(differ[0]) if len(differ) else n // 4


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, item, term, times): the terms of each distinct (item_id, text); ``item`` tells equal ids apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, h, t.decode(), n) for i, h, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "item", "text")), strict=True) for t, n in Counter(terms(text)).items()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [batch.schema.field("item_id").type, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item_id", "item", "term", "times"])

    distinct = items.select("item_id", F.sha2("text", 256).alias("item"), "text").where(F.col("text").isNotNull()).distinct()
    kind = items.schema["item_id"].dataType.simpleString()
    return map_batches(distinct, run, f"item_id {kind}, item string, term string, times long")


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_terms, terms, tfs) of each row with a term: its length, and the known terms it holds with their tf."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms(text)
                if found:
                    count = Counter(found)
                    own = sorted((known[t], count[t]) for t in known.keys() & count.keys())
                    out.append((doc_id, len(found), [t for t, _ in own], [n for _, n in own]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_terms", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_terms long, terms array<int>, tfs array<int>")


def _search(vectors: DataFrame, items: Items, rank: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best of each task; ``rank`` gives the place of each term, the most frequent first."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, rank))
    block = max(64, TREE_CELLS // (2 * max(1, len(rank))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rank = sent.value
        best = Best(len(items.first) - 1, k)
        held: dict[tuple[bytes, bytes, int], list] = {}

        def search() -> None:
            if held:
                keys = sorted(held, key=lambda x: x[0])
                # The ids beyond the k smallest of equal vectors can't be among the k best of any item.
                ids = [sorted(held[x], key=lambda d: (d is None, d or 0))[:k] for x in keys]
                tree = Tree([(x[0], np.frombuffer(x[0], ">u4").astype(np.int64), np.frombuffer(x[1], np.int32), x[2]) for x in keys], len(rank))
                tree.search(items, ids, best)
                held.clear()

        for batch in batches:
            m = length_norm(batch.column("n_terms").to_numpy(zero_copy_only=False), n, total).tolist()
            ends = batch.column("terms").offsets.to_numpy().tolist()
            term = rank[batch.column("terms").values.to_numpy(zero_copy_only=False)]
            tf = batch.column("tfs").values.to_numpy(zero_copy_only=False)
            for doc_id, own_m, a, b in zip(batch.column("doc_id").to_pylist(), m, ends[:-1], ends[1:], strict=True):
                if b > a:
                    order = np.argsort(term[a:b])
                    key = term[a:b][order].astype(">u4").tobytes(), tf[a:b][order].tobytes(), own_m
                    held.setdefault(key, []).append(doc_id)
            if len(held) >= block:
                search()
        search()
        rows = [(i, None if none else d, -s) for i, own in enumerate(best.held) for s, none, d in own]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return map_batches(vectors, run, "item long, doc_id long, score long")


def _blocks(counts: list, n_terms: int) -> int:
    return max(1, -(-n_terms // BLOCK_TERMS), -(-len(counts) // BLOCK_ITEMS))


def best_documents(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest positive scores for each item.

    Equal scores are ordered by ascending doc_id, null ids last; repeated rows of a document are ranked each. Null and
    empty texts, of documents or items, have no terms and are in no result. Rows that repeat an item's id and text are
    one item; other texts under the same id are ranked apart, each from 1. Texts of any length are taken whole. Other
    columns of both tables are ignored. An empty table on either side gives an empty result. Items are searched in
    blocks of bounded size, so that what every task is sent stays bounded; ids are integers.
    """
    spark = docs.sparkSession
    asked = stored(item_terms(items), "asked")
    kind = items.schema["item_id"].dataType.simpleString()
    n_items, n_asked = asked.agg(F.count_distinct("item_id", "item"), F.count_distinct("term")).first()
    n_items += asked.where("item_id is null").agg(F.count_distinct("item")).first()[0]
    blocks = max(1, -(-n_items // block_items), -(-n_asked // block_terms))
    found = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == b)
        rows = sorted(own.collect(), key=lambda r: (r.item_id is not None, r.item_id, r.item, r.term))  # a block: bounded
        if not rows:
            continue
        names = sorted({r.term for r in rows})
        at = {t: i for i, t in enumerate(names)}
        vectors = stored(restricted(docs, {t.encode(): i for t, i in at.items()}), "vectors")
        n, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        if not n:
            break
        df = np.zeros(len(names), np.int64)
        for t, c in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
            df[t] = c
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((np.arange(len(names)), -df))] = np.arange(len(names))
        keys = list(dict.fromkeys((r.item_id, r.item) for r in rows))
        number = {x: i for i, x in enumerate(keys)}
        first = np.searchsorted([number[r.item_id, r.item] for r in rows], np.arange(len(keys) + 1))
        value = np.array([weight(n, int(df[at[r.term]])) * r.times for r in rows], np.int64)
        block = Items(first, rank[[at[r.term] for r in rows]], value)
        hits = _search(vectors, block, rank, n, total, k)
        names_of = spark.createDataFrame([(i, *x) for i, x in enumerate(keys)], f"item long, item_id {kind}, text_key string")
        found.append(hits.join(F.broadcast(names_of), "item"))  # BLOCK_ITEMS rows at most
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    every = reduce(DataFrame.unionByName, found)
    place = Window.partitionBy("item_id", "text_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_search(spark, sf_dir: str) -> DataFrame:
    return best_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM i) GROUP BY ALL),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, term, CAST(count(*) AS BIGINT) AS tf, any_value(len) AS len
      FROM (SELECT r, doc_id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY r, doc_id, term),
v AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, n),
g AS (
  SELECT q.item_id, t.r, t.doc_id, CAST(sum(q.times * v.weight * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + (75 * t.len * s.n) // s.total)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN v USING (term), s GROUP BY q.item_id, t.r, t.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM g WHERE score > 0) WHERE rank <= 10
"""
