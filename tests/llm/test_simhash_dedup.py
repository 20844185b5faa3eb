import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronofeat.llm import simhash_dedup as sd

from .conftest import lowered


def plain_fingerprint(text):
    words = lowered(text).split(" ") if text else []
    words = [w for w in lowered(text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42)
              for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    best = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None and (best.get(r) is None or x < best[r]):
            best[r] = x
    return [best.get(find(i)) for i in range(len(fps))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = []
    for _ in range(60):
        w = [f"t{rng.randint(0, 400)}" for _ in range(rng.randint(0, 260))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            if w:
                w = w[:]
                w[rng.randrange(len(w))] = "Changed"
                out.append("  ".join(w))
    return out


def test_fingerprints_agree_with_spark_hashes(spark, texts, odd_docs):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(
        odd_docs.select("doc_id", "text"))
    got = sorted((r.doc_id or -1, r.fingerprint) for r in sd.near_groups(docs).collect())
    rows = docs.collect()
    assert got == sorted((r.doc_id or -1, f"{plain_fingerprint(r.text):016x}") for r in rows)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == \
        xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("bucket_rows", [4096, 16])
def test_components_match_brute_force(spark, bucket_rows):
    rng, fps = random.Random(1), []
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(25):
            for _ in range(rng.randint(0, 2)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps += [0, 1, 3, 7, 15, (1 << 64) - 1, (1 << 63), rng.getrandbits(64)] + fps[:9]
    ids = [i * 7 % 1000 for i in range(len(fps))]
    rows = spark.createDataFrame(
        [(i, i, f - (1 << 64) if f >> 63 else f) for i, f in zip(ids, fps)],
        "doc_key long, doc_hash long, fp long")
    classes = sd._classes(rows, 2, bucket_rows)
    got = {r.doc_key: r.c for r in rows.join(classes, "fp").select(
        "doc_key", F.col("first.doc_key").alias("c")).collect()}
    assert [got[i] for i in ids] == plain_components(ids, fps, 2)


def test_odd_rows(odd_docs):
    got = sd.near_groups(odd_docs).collect()
    rows = odd_docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = plain_components([r.doc_id for r in rows], fps, 2)
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == \
        sorted((r.doc_id or -1, c) for r, c in zip(rows, want))
    kept = sd.drop_near_duplicates(odd_docs)
    assert kept.schema == odd_docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {i for i in ids if i is not None} == set(want) - {None}


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 8])
def test_bit_sliced_lanes_match_popcounts(radius):
    rng = np.random.default_rng(radius)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64))
                                    for b in rng.integers(0, 1 << 63, 9, dtype=np.uint64)]))
    n = len(fps)
    ends = np.where(np.arange(n) < 100, min(100, n), n)
    got = {p for a, b in sd.linked_lanes(fps, ends, radius) for p in zip(a.tolist(), b.tolist())}
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert got == {(i, j) for i in range(n) for j in range(i + 1, int(ends[i]))
                   if far[i, j] <= radius}


def test_empty_table(no_docs):
    assert sd.near_groups(no_docs).count() == 0
    assert sd.drop_near_duplicates(no_docs).count() == 0
