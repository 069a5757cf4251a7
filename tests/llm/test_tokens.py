"""Operations on tokens and terms: alignment, lexical search, byte-pair encoding, and packing of whole tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import alignment, bpe, decontaminate, lexical, packing

HARD = [
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<s>", "</s>", "<unk>", "<0x0A>", " ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", ";\r\n",
    "\x1c", "\x85", "\xa0", "　", "▁", "'s", "'LL", "a", "word", "The", ".", "...", "\U0001f600", "中文", "é", "é", "\x00",
    "Σ", "İ", "½", "Ⅷ", "1", "234", "{", "}", "();", "ß", "\x0b", "\U00011935\U00011930", "Ƛ",
]


def strings(n, seed=3):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "a ", " a", "▁"] + ["".join(rng.choice(HARD) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Hard texts, some rows repeated, a null id, a long text, and columns with the names of results."""
    texts = strings(400) + ["the " * 5 + "end", "ab" * 4000, "line\n" * 3000]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(8, texts[8], 2, "y"), (None, "no id here", 3, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, pair string").repartition(3)


def brute_links(text, a, b, bytes_a, bytes_b):
    """(A ids, B ids, links, groups) of one text, or None, by comparing all ranges in order."""
    if not text:
        return None
    raw = (" " + text).encode()
    ranges = []
    for ids, table in ((a.encode(" " + text, add_special_tokens=False).ids, bytes_a), (b.encode(text), bytes_b)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(table[i]), i))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != raw:
            return None
        ranges.append(own)
    ra, rb = ranges
    links = [(x[2], y[2]) for x in ra for y in rb if max(x[0], y[0]) < min(x[1], y[1])] if len(raw) < 500 else None
    if links is None:  # the same by a walk along both
        links, i, j = [], 0, 0
        while i < len(ra) and j < len(rb):
            links.append((ra[i][2], rb[j][2]))
            end = min(ra[i][1], rb[j][1])
            i, j = i + (ra[i][1] == end), j + (rb[j][1] == end)
    parts, last = [], 0
    for end in sorted({x[1] for x in ra} & {y[1] for y in rb}):
        parts.append("|".join(",".join(str(r[2]) for r in own if last < r[1] <= end) for own in (ra, rb)))
        last = end
    return len(ra), len(rb), links, parts


@pytest.mark.parametrize("segment_bytes", [300, alignment.SEGMENT_BYTES])
def test_alignment_equals_brute_force(odd, segment_bytes):
    import sentencepiece
    from tokenizers import Tokenizer

    files = alignment.tokenizer_files()
    a, b = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    a.encode_special_tokens = True
    tables = alignment.Pair(*files)
    docs = odd.where(F.octet_length(F.coalesce("text", F.lit(""))) < 9000)
    rows = docs.select("doc_id", "text").collect()
    brute = {r.text: brute_links(r.text, a, b, tables.bytes_a, tables.bytes_b) for r in rows}
    count = Counter(x for r in rows if brute[r.text] for x in brute[r.text][2])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    want = []
    for r in rows:
        if brute[r.text] is None:
            want.append((str(r.doc_id), *[0] * 6, ""))
            continue
        na, nb, links, parts = brute[r.text]
        best, total = sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links)
        want.append((str(r.doc_id), na, nb, len(parts), len(links), best, total, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    got = alignment.aligned(docs, *files, segment_bytes=segment_bytes)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r.doc_id), *(r[c] for c in names)) for r in got.collect()) == sorted(want)
    texts = {(str(r.doc_id), hashlib.sha256(r.groups.encode()).hexdigest()) for r in alignment.groups(docs, *files).collect() if r.groups}
    assert texts == {(w[0], w[7]) for w in want if w[7]}


def test_pair_counts_are_documents_and_links(spark):
    files = alignment.tokenizer_files()
    docs = spark.createDataFrame([(k, " ".join(["tree"] * (k + 1))) for k in range(9)], "doc_id long, text string")
    counts = alignment.pair_counts(alignment.index(docs, *files, segment_bytes=40)).collect()
    assert {(r.documents, r.links) for r in counts} == {(9, 45)}  # planes for 1 to 9 occurrences


def test_bitmaps_give_their_slots_back():
    rng = np.random.default_rng(4)
    key = np.unique(rng.integers(0, 40, 4000) << 16 | rng.integers(0, 1 << 16, 4000))
    pair, ones, cells = alignment.bitmaps(key)
    row, slot = alignment.slots_of(cells)
    assert (pair[row] << 16 | slot).tolist() == key.tolist()
    assert ones.tolist() == np.bincount(row).tolist()
    assert len(alignment.bitmaps(key[:0])[0]) == 0


def brute_ranks(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    words = [(d, term.findall((t or "").translate(lower))) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(term.findall((text or "").translate(lower)))
        found = []
        for d, w in words:
            tf, m = Counter(w), 25 + (75 * len(w) * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, q in asked.items() if tf[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("cells, blocks", [(lexical.TREE_CELLS, (lexical.BLOCK_TERMS, lexical.BLOCK_ITEMS)), (1, (40, 3))])
def test_search_equals_brute_force(spark, monkeypatch, cells, blocks):
    monkeypatch.setattr(lexical, "TREE_CELLS", cells)
    rng = random.Random(6)
    word = [f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)]
    docs = [(k, " ".join(rng.choices(word, k=rng.randrange(1, 60)))) for k in range(400)]
    docs += [(1000 + k, docs[7][1]) for k in range(30)] + [(5, docs[5][1]), (None, docs[9][1]), (600, None), (601, ""), (602, "-- !"), (603, "w1 " * 9000), (604, "W1 Ünder_w2")]
    items = [(k, docs[k * 5][1][: rng.randrange(10, 200)]) for k in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (3, "w1 W2 w2 ünder Under"), (None, "w7 w9"), (0, docs[0][1][:0])]
    items += [items[1]]
    found = lexical.best_documents(
        spark.createDataFrame([(*d, "r", 1) for d in docs], "doc_id long, text string, rank string, item int").repartition(3),
        spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int"), 10, *blocks,
    )
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute_ranks(docs, items)


def test_tree_bounds_leave_most_nodes_out():
    rng = np.random.default_rng(2)
    vectors = {}
    for _ in range(600):
        t = np.unique(np.minimum(rng.zipf(1.3, 30), 500) - 1)
        vectors[t.astype(">u4").tobytes()] = (t, rng.integers(1, 4, len(t)).astype(np.int32))
    rows = [(k, *vectors[k], 100) for k in sorted(vectors)]
    tree = lexical.Tree(rows, 500)
    items = lexical.Items(np.array([0, 3]), np.array([0, 3, 480]), np.array([10, 500, 6000]))
    best = lexical.Best(1, 3)
    seen = tree.search(items, [[k] for k in range(len(rows))], best)
    dense = np.zeros((len(rows), 500), np.int64)
    for k, (_, t, f, _) in enumerate(rows):
        dense[k, t] = f
    scores = [int(items.scores(np.array([0]), d, 100)[0]) for d in dense]
    assert [-s for s, *_ in best.held[0]] == sorted((s for s in scores if s), reverse=True)[:3]
    assert seen < len(tree.m) / 2
    assert all((tree.tf[v] >= tree.tf[c]).all() and tree.m[v] <= tree.m[c] for v in range(len(tree.m)) for c in tree.children[v])


@pytest.mark.parametrize("side", ["docs", "items"])
def test_search_of_empty_tables(spark, side):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    got = lexical.best_documents(docs.limit(0) if side == "docs" else docs, items.limit(0) if side == "items" else items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.isEmpty()


def test_encoding_equals_the_library(odd):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_file()
    library = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(odd, path), path).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert sorted(map(str, bpe.round_trip(odd, path).collect())) == sorted(map(str, got))
    none = odd.limit(0)
    assert bpe.decode(bpe.encode(none, path), path).isEmpty() and bpe.round_trip(none, path).isEmpty()


def test_scanned_and_heaped_merges_agree(monkeypatch):
    tokenizer = bpe.WordTokenizer(bpe.tokenizer_file())
    rng = random.Random(1)
    words = ["".join(rng.choice("aehinorst") for _ in range(rng.randrange(1, 90))) for _ in range(500)]
    parts = [[tokenizer.inner[c] for c in w[:-1]] + [tokenizer.last[w[-1]]] for w in words]
    scanned = [bpe.merge(list(p), tokenizer.merges) for p in parts]
    monkeypatch.setattr(bpe, "SCANNED", 0)
    assert [bpe.merge(list(p), tokenizer.merges) for p in parts] == scanned
    # Forgetting words, and texts met again, changes nothing.
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    fresh = bpe.WordTokenizer(bpe.tokenizer_file())
    assert [fresh.encode(w) for w in words * 2] == [tokenizer.encode(w) for w in words * 2]


def test_unknown_ids_are_left_out(spark):
    rows = spark.createDataFrame([(1, [320, 10**6, 49407], 0), (2, None, 0), (3, [], 0)], "doc_id long, ids array<int>, decoded int")
    got = {r.doc_id: r.decoded for r in bpe.decode(rows, bpe.tokenizer_file()).collect()}
    assert got == {1: "a</w> <|endoftext|>", 2: "", 3: ""}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_whole_tables_take_no_more_sequences_than_best_fit_decreasing(spark, sf):
    rows = packing.op3_packing(spark, f"/root/testdata/{sf}").select("length", "sequence_id").toPandas()
    sizes = rows["length"].to_numpy()
    short = sizes[sizes < packing.SEQUENCE]
    plain = packing.best_fit(short.tolist(), np.argsort(-short, kind="stable").tolist(), packing.SEQUENCE)
    whole = int((sizes == packing.SEQUENCE).sum())
    assert packing.least_bins(short, packing.SEQUENCE) + whole <= rows["sequence_id"].nunique() <= int(plain.max()) + 1 + whole


def test_clean_documents_with_clashing_columns(spark):
    text = " ".join(f"t{k}" for k in range(12))
    docs = spark.createDataFrame([(1, text, b"a", 1), (2, "other words", b"b", 2), (3, None, None, 3)], "doc_id long, text string, bad_digest binary, row int")
    bench = spark.createDataFrame([(1, text, 1)], "item_id long, text string, bad_digest int")
    got = decontaminate.clean_documents(docs, bench)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [2, 3]
