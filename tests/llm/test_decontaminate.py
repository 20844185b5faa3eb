import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronofeat.llm import decontaminate as dc

from .conftest import PASSAGE


def shingle_counts(words, size=5):
    return Counter(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def similarity(a, b):
    shared, total = sum((a & b).values()), sum((a | b).values())
    return shared / total


def brute(docs, items, threshold=0.8):
    """Best similarity over every window of the item's length."""
    out = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            want = (item or "").lower().split()
            if not words or not want:
                continue
            counts = shingle_counts(want)
            best = max(similarity(shingle_counts(words[a:a + len(want)]), counts)
                       for a in range(max(1, len(words) - len(want) + 1)))
            if best >= threshold:
                out[d, i] = round(best, 6)
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))))
             for i in range(25)] + [(90, None), (91, ""), (92, "v1 v2"), (93, "Tiny Item here")]
    docs = []
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if d % 2:
            item = items[d % 25][1].split()
            for _ in range(d % 3):
                item[rng.randrange(len(item))] = "edited"
            if d % 5 == 0:
                item = [x.upper() for x in item]
            at = rng.randint(0, len(w))
            w[at:at] = item
        docs.append((d, "\n ".join(w)))
    return docs + [(100, "tiny  ITEM here"), (101, None), (102, " "), (103, items[0][1])], items


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_matches_brute_force(spark, planted, broadcast_bytes):
    docs, items = planted
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                            spark.createDataFrame(items, "item_id long, text string"),
                            broadcast_bytes=broadcast_bytes)
    got = {(r.doc_key, r.item): round(r.similarity, 6) for r in found.collect()}
    assert got == brute(docs, items)
    assert found.count() == len(got) > 10


def test_hard_windows_equal_brute_force(spark):
    """Swapped halves, moved sentences, repeated shingles, short items, short documents."""
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(400)]
    items, docs = [], []
    for i in range(30):
        item = [rng.choice(vocabulary) for _ in range(rng.randint(45, 70))]
        if i % 3 == 2:  # repeated shingles
            item = item[:12] * 3 + item[12:30]
        items.append((i, " ".join(item)))
        k, around = len(item) // 2, [rng.choice(vocabulary) for _ in range(60)]
        quarter = len(item) // 4
        for j, w in enumerate((item[k:] + item[:k], item[quarter:] + item[:quarter],
                               item[:10] + ["x", "y"] + item[10:],
                               item[:quarter] + item[-quarter:] + item[quarter:-quarter])):
            docs.append((10 * i + j, " ".join(around[:30] + w + around[30:])))
        docs.append((10 * i + 4, " ".join(item[:-3])))  # shorter than the item
        docs.append((10 * i + 5, " ".join(item[:-len(item) // 4])))
        docs.append((10 * i + 6, " ".join(around + item[:k] + around + item[k:])))
    items += [(50, "v1 v2 v3"), (51, "zz"), (52, "v1 v2 v3 v4"), (53, "a b c d e")]
    docs += [(900, "x v1 V2  v3 v4 y"), (901, "say zz now"), (902, "v1 v2"), (903, "a b c d e"),
             (904, "a b c d f"), (905, "o a b c d e o")]
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                            spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    got = {(r.doc_key, r.item): round(r.similarity, 6) for r in found.collect()}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("longest", [100, 1 << 14])
def test_sliding_fingerprints_are_those_of_the_windows(spark, longest):
    rng = random.Random(1)
    rows = [(i, a, [rng.randint(-2**63, 2**63 - 1) for _ in range(a + rng.randint(0, 9))])
            for i, a in enumerate((1, 2, 5, 16, 33))]
    df = spark.createDataFrame(rows, "k int, a int, part array<long>")
    got = {(r.k, r.at): r.fp for r in dc.window_fingerprints(df, ["k"], longest).collect()}
    want = {(k, at): sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part[at:at + a]) > a)
            for k, a, part in rows for at in range(len(part) - a + 1)}
    assert {p: v % (1 << 64) for p, v in got.items()} == want


def test_simhash_and_similarity_are_exact(spark):
    rng = random.Random(0)
    a, b = [[rng.randint(-2**63, 2**63 - 1) for _ in range(n)] for n in (9, 40)]
    a += b[:6] + b[:2] + a[:1]
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    r = df.select(dc.simhash(F.col("a")).alias("h"),
                  dc.weighted_similarity(F.col("a"), F.col("b")).alias("s")).first()
    bits = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in a) > len(a))
    assert r.h % (1 << 64) == bits
    assert r.s == pytest.approx(similarity(Counter(a), Counter(b)))


def test_odd_rows(spark, odd_docs):
    items = spark.createDataFrame([(1, PASSAGE, "x"), (1, PASSAGE, "x"), (2, None, None),
                                   (None, "one", "y")], "item_id long, text string, digest string")
    got = {(r.doc_key, r.item) for r in dc.contaminated(odd_docs, items).collect()}
    assert got == {(6, 1), (7, 1), (11, None)}
    clean = dc.drop_contaminated(odd_docs, items)
    assert clean.schema == odd_docs.schema
    assert sorted(r.doc_id or 0 for r in clean.collect()) == [0, 1, 2, 3, 4, 5, 9, 10]


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert dc.contaminated(odd_docs, none).count() == 0
    assert dc.contaminated(no_docs, some).count() == 0
    assert dc.drop_contaminated(odd_docs, none).count() == odd_docs.count()
    assert dc.drop_contaminated(no_docs, some).count() == 0
