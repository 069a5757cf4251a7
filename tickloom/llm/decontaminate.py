"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows become a broadcast hash set; each document's words are hashed once, its places are laid out
inside the scan and looked up, and windows that hit are compared word for word. No text is shuffled, and the work is
linear in the text however much of it is hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, stored, unused_names

#: What separates words: ASCII that is neither digit nor letter.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most distinct windows, and most bytes of them with their items, that one broadcast holds; more make several blocks.
BLOCK_WINDOWS, BLOCK_BYTES = 400_000, 64 << 20
#: Most digests of contaminated texts that are sent to every task (16 bytes each); more are joined by shuffle.
SENT_DIGESTS = 1_000_000


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def lowered(text: Column) -> Column:
    """A-Z lower-cased; the faster function where the text has no other letters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """One row per distinct window: its length, its words joined by blanks, and the items that hold it."""
    w = benchmark.select("item_id", split_words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(size)))
    w = w.select("item_id", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    w = w.select("item_id", "len", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("window"))
    return w.groupBy("len", "window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _ends(hashes: Column, start: Column, n: Column) -> Column:
    """Hash of a window's length, first and last word: a cheap test that few windows of other texts pass."""
    return F.xxhash64(n, F.get(hashes, start - 1), F.get(hashes, start + n - 2))


def _block_hits(places: DataFrame, known: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, pos, len, items) of ``places(row, doc_id, n_words, w, h, len, pos)`` whose window is in
    ``known(ends, hash, len, window, items)``, and one row with null items for place 0 of each row.

    Both joins are broadcasts of one block, and outer ones, so that every row of the documents stays in one pass.
    """
    ends = F.broadcast(known.select(F.col("ends").alias("known_ends")).distinct())
    p = places.withColumn("ends", F.when(F.col("pos") > 0, _ends(F.col("h"), F.col("pos"), F.col("len"))))
    p = p.join(ends, F.col("ends") == F.col("known_ends"), "left").where((F.col("pos") == 0) | F.col("known_ends").isNotNull())
    at = F.greatest(F.col("pos"), F.lit(1))  # a slice at place 0 is an error even where it is not used
    window = F.slice("w", at, F.col("len"))
    p = p.withColumn("hash", F.when(F.col("pos") > 0, F.xxhash64(F.slice("h", at, F.col("len")))))
    k = F.broadcast(known.select(F.col("hash").alias("known_hash"), F.col("len").alias("known_len"), F.col("window").alias("known"), "items"))
    same = (F.col("hash") == F.col("known_hash")) & (F.col("len") == F.col("known_len"))
    p = p.join(k, same & (F.col("known") == F.array_join(window, " ")), "left")
    return p.where((F.col("pos") == 0) | F.col("items").isNotNull()).select("row", "doc_id", "n_words", "pos", "len", "items")


def window_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(row, doc_id, n_words, hits): hits holds, in order, each place where a benchmark window occurs.

    ``row`` numbers the rows of ``docs``, so that repeated rows stay apart; hits is an array of (pos, len, items), with
    pos from 1. Null and empty texts have no words and no hits; so has every text when the benchmark is empty. Very
    long texts are laid out as rows inside their task, one place a row. The windows travel in blocks of bounded size;
    with more than one block the documents are written once, so that their row numbers hold, and read for each block.
    """
    windows = benchmark_windows(benchmark, size).withColumn("wh", _hashes(F.split("window", " ")))
    ends = _ends(F.col("wh"), F.lit(1), F.col("len"))
    windows = stored(windows.select(ends.alias("ends"), F.xxhash64("wh").alias("hash"), "len", "window", "items"), "windows")
    weight = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    n, held, *_ = windows.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    blocks = max(1, -(-n // block_windows), -(-held // BLOCK_BYTES))
    lengths = [r[0] for r in windows.select("len").distinct().orderBy("len").collect()]  # at most `size` values
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if blocks > 1:
        d = stored(d, "numbered")
    # Each one-element explode keeps what it holds from being worked out again for every use.
    d = d.select("row", "doc_id", F.explode(F.array(split_words(lowered(F.col("text"))))).alias("w"))
    d = d.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "w", F.explode(F.array(_hashes(F.col("w")))).alias("h"))
    last = F.size("w") - F.col("len") + 1
    found = []
    for b in range(blocks):
        own = [F.lit(0), *map(F.lit, lengths)] if b == 0 else [*map(F.lit, lengths)]
        # Length 0 has the one place 0, which stands for the row itself.
        p = d.withColumn("len", F.explode(F.array(*own))).where((F.col("len") == 0) | (last > 0))
        at = F.when(F.col("len") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.greatest(last, F.lit(1))))
        found.append(_block_hits(p.withColumn("pos", F.explode(at)), windows.where(F.pmod("hash", F.lit(blocks)) == b)))
    hit = reduce(DataFrame.unionByName, found)
    place = F.when(F.col("items").isNotNull(), F.struct("pos", "len", "items"))
    return hit.groupBy("row", "doc_id", "n_words").agg(F.sort_array(F.collect_list(place)).alias("hits"))


def covered_words(hits: Column) -> Column:
    """Number of words inside any of the ordered hits, each word once."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        last = (x["pos"] + x["len"] - 1).cast("long")
        fresh = F.greatest(F.lit(0).cast("long"), last - F.greatest(acc["end"], (x["pos"] - 1).cast("long")))
        return F.struct(F.greatest(acc["end"], last).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document row: how many words benchmark windows cover, and which items they come from.

    Null and empty texts have no words; texts shorter than a window are looked up among benchmark items as short.
    Repeated rows stay apart; other columns of docs and benchmark are ignored. An empty table gives an empty result.
    """
    h = window_hits(docs, benchmark, size, block_windows)
    items = F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    h = h.select("row", "doc_id", "n_words", covered_words(F.col("hits")).alias("n_hit"), items.alias("items"))
    return h.select(
        "row",
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, block_windows: int = BLOCK_WINDOWS, sent: int = SENT_DIGESTS
) -> DataFrame:
    """Documents of which no word lies in a benchmark window, with all their columns as they are.

    A verdict belongs to the text, so equal texts go or stay together whatever their ids; null and empty texts stay.
    Digests of contaminated texts are sent to the scan while they are few, and joined by shuffle beyond that.
    """
    digests = docs.select(text_digest(F.col("text")).alias("doc_id"), "text")
    hits = window_hits(digests, benchmark, size, block_windows).where(F.size("hits") > 0)
    (name,) = unused_names(docs.columns, ["bad_digest"])
    bad = stored(hits.select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= sent else bad
    return docs.join(bad, text_digest(docs["text"]) == F.col(name), "left_anti")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
