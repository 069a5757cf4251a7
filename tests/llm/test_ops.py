import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import class_lm, decontaminate, language_id, licenses, media, ngram_join, packing, quality, sharding, toxicity

rng = random.Random(5)
WORDS = [f"w{k}" for k in range(400)]
BASE = [rng.choice(WORDS) for _ in range(120)]


def edited(n):
    d = list(BASE)
    for _ in range(n):
        d[rng.randrange(len(d))] = f"x{rng.randrange(999)}"
    return " ".join(d)


TEXTS = [None, "", "  \n", "A", "a", "One two", "one  TWO", "ünïcode Ünïcode", edited(0), edited(0)]
TEXTS += [edited(rng.randint(0, 4)) for _ in range(30)] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90))) for _ in range(25)]
TEXTS += [" ".join(rng.choice(WORDS) for _ in range(30_000)), "the quick brown fox. Released under the MIT License.\nIt ends."]
ROWS = [(k, t, "en" if k % 2 else "de", "src", 1) for k, t in enumerate(TEXTS)] + [(8, TEXTS[8], "en", "src", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, score int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 3 != 0, k % 5 == 0) for k in range(len(TEXTS))], "doc_id long, q boolean, t boolean").select(
        "doc_id", F.col("q").cast("int").alias("quality"), F.col("t").cast("int").alias("toxic")
    )


def groups(words, percent):
    sets = {}
    for k, t, *_ in ROWS:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(docs, words, percent):
    got = ngram_join.similar_groups(docs, words, percent).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(words, percent)


def brute_hits(text, items):
    def words(t):
        return decontaminate_words.findall((t or "").translate(LOWER))

    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        for j in range(len(b) - n + 1) if b else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), len(found)


import re  # noqa: E402

decontaminate_words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("most", [100_000, 7])
def test_decontamination_equals_brute_force(spark, docs, most):
    items = [(1, " ".join(BASE[5:30])), (2, "one TWO"), (3, None), (4, " ".join(BASE[20:40])), (5, "...")]
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_windows=most).collect()
    text = {k: t for k, t, *_ in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items) == brute_hits(text[r.doc_id], items)


def test_packing_is_a_gapless_round_trip(docs):
    files = [packing.tokenizer_file()]
    got = packing.pack_documents(docs, *files).collect()
    size = Counter()
    for s, rows in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        for r in rows:
            assert r.offset == size[s]
            size[s] += r.length
    assert max(size.values()) <= packing.SEQUENCE
    total = sum(size.values())
    assert len(size) <= math.ceil(total / packing.SEQUENCE) + 1
    for k, t, *_ in ROWS[:-1]:
        ids = packing.token_ids(t or "", files[0]) + [0]
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == k})
        assert [m[1:3] for m in mine] == packing.cut(len(ids), packing.SEQUENCE)
        for _, start, n, crc in mine:
            assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + n]))


def test_media_round_trip(spark, docs, tmp_path):
    got = media.media_table(docs, f"file://{tmp_path}/m").collect()
    want = Counter((k, len((t or "").encode()), media.hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for k, t, *_ in ROWS)
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in got) == want


def test_damaged_member_is_tried_again_and_reported(tmp_path):
    system = media.pafs.LocalFileSystem()
    a = media.Archive(system, f"{tmp_path}/a.zip")
    a.add("1", b"one")
    a.add("2", b"two")
    a.close()
    file = media.OpenFile(system, f"{tmp_path}/a.zip")
    found = list(media.members(file, 0, 1 << 30))
    assert [media.read_member(file, *m[1:]) for m in found] == [b"one", b"two"]
    with pytest.raises(ValueError):
        media.read_member(file, found[0][1], found[0][2], 1, tries=2)
    assert media.read_member(file, *found[1][1:]) == b"two"


def test_sharding_is_minimax(docs):
    got = sharding.shard_rows(docs, 4).collect()
    assert len(got) == len(ROWS)
    text = {k: t or "" for k, t, *_ in ROWS}
    shards, slots, size = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(len(s) == 1 for s in shards.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) == max(len(t.encode()) + 1 for t in text.values())  # the long text alone is the largest


def test_smallest_capacity_equals_brute_force(spark):
    sizes = [rng.randint(1, 50) for _ in range(200)]
    cum = list(itertools.accumulate(sizes))
    groups_ = spark.createDataFrame(list(zip(sizes, cum, strict=True)), "g_size long, cum_size long")
    want = next(c for c in range(max(sizes), sum(sizes) + 1) if sharding._greedy(cum, c, 8)[-1] == cum[-1])
    for few in (10_000, 5):
        assert sharding.smallest_capacity(groups_, 8, tried=4, few=few)[0] == want


def test_language_model_base_score(docs):
    got = {r.doc_id: r for r in class_lm.train_and_score(docs, F.col("doc_id") % 2 == 0, classes=8, frequent=50, endings=14, held=20).collect()}
    count = Counter()
    for k, t, *_ in ROWS:
        if k % 2 == 0:
            count.update(class_lm.tokens((t or "").encode()))
    n, v = sum(count.values()), len(count)
    for k, t, *_ in ROWS:
        ts = class_lm.tokens((t or "").encode())
        assert got[k].base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ts))
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(ts), sum(x in count for x in ts), n)
        assert got[k].score < 0


def test_language_id(spark):
    rows = [(k, " ".join(rng.choice(["the", "and", "which"] if k % 2 else ["und", "für", "nicht"]) for _ in range(20)), "en" if k % 2 else "de") for k in range(80)]
    rows += [(90, None, None), (91, "123 !", "en"), (92, "", "de")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 60).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[60:80])
    assert all(got[k].lang_pred == "und" for k in (90, 91, 92))


def test_toxicity_chain(spark):
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(20)) + (" vile" if k % 4 == 0 else "")) for k in range(200)] + [(200, None), (201, "")]
    lab = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(150)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), toxicity.chain_labels(lab)).collect()
    assert all(r.is_toxic == (r.doc_id % 4 == 0) for r in got if r.doc_id < 200)
    assert {200, 201} <= {r.doc_id for r in got}


def test_quality(spark):
    rows = [(k, " ".join(rng.choice(WORDS) + ("!!" if k % 4 == 0 else "") for _ in range(40))) for k in range(300)] + [(300, None)]
    lab = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(300)], "doc_id long, quality int")
    got = quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), lab, F.lit(True)).collect()
    right = [(r.score >= 0.7) == (r.doc_id % 4 != 0) for r in got if r.doc_id < 300]
    assert sum(right) / len(right) > 0.95 and len(got) == 301


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the License).\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n"
    df = spark.createDataFrame([(1, apache + "Released under the MIT License."), (2, None), (3, "Released under the mit license"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: [h.licence for h in r.hits] for r in licenses.scan(df).collect()}
    assert got == {1: ["Apache-2.0", "MIT"], 2: [], 3: ["MIT"], 4: []}


def test_empty_tables(spark, labels, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    no_labels = labels.limit(0)
    assert ngram_join.similar_groups(none).isEmpty()
    assert decontaminate.contamination(none, bench).isEmpty()
    assert packing.pack_documents(none, packing.tokenizer_file()).isEmpty()
    assert sharding.shard_rows(none).isEmpty()
    assert class_lm.train_and_score(none, F.lit(True)).isEmpty()
    assert language_id.identify(none, F.lit(True)).isEmpty()
    assert toxicity.toxicity(none, toxicity.chain_labels(no_labels)).isEmpty()
    assert quality.quality_scores(none, no_labels, F.lit(True)).isEmpty()
    assert licenses.scan(none).isEmpty()
    assert media.media_table(none, f"file://{tmp_path}/e").isEmpty()


def test_nothing_to_learn_from(docs, labels):
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert not any(r.is_toxic for r in toxicity.toxicity(docs, toxicity.chain_labels(labels.limit(0))).collect())
    assert {r.lang_pred for r in language_id.identify(docs, F.lit(False)).collect()} == {"und"}
