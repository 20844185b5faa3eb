import random
from collections import Counter

import numpy as np
import pytest

from chronofeat.llm import superkmer

from .conftest import PASSAGE


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = True
        out.append((len(w), int(gone.sum()),
                    b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本"]
    passage = [rng.choice(vocabulary) for _ in range(300)]
    out = []
    for d in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        for _ in range(2):
            a, p = rng.randint(0, 250), rng.randint(0, len(w))
            w[p:p] = passage[a:a + rng.randint(5, 60)]
        if d % 9 == 0:
            w = ["same"] * rng.randint(5, 90) + w
        out.append("  \n".join(w))
    return [*out, *out[:3], None, "", " "]


@pytest.mark.parametrize("every_second_hot", [False, True])
@pytest.mark.parametrize("flush,piece", [(1 << 26, 1 << 17), (4000, 100)])
def test_matches_brute_force(texts, monkeypatch, flush, piece, every_second_hot):
    # small buffers force flushes and pieces
    monkeypatch.setattr(superkmer, "FLUSH_BYTES", flush)
    monkeypatch.setattr(superkmer, "PIECE_WORDS", piece)
    monkeypatch.setattr(superkmer, "HASH_BYTES", piece)
    mers = superkmer.Words(" ".join(" ".join((t or "").split()) for t in texts).encode()).runs(4)
    hot = np.unique(mers[mers % 2 == 0]) if every_second_hot else superkmer._NONE
    sender, blocks = superkmer._Sender(6, 12, 4, hot), {}
    out = [b for i, t in enumerate(texts) for b in sender.add(i + 1, -i, (t or "").encode())]
    for b in [*out, *sender.work(), *sender.flush()]:
        for r in b.to_pylist():
            blocks.setdefault(r["bucket"], []).append((r["packed"], r["places"], r["settled"]))
    gone = [np.zeros(len((t or "").split()), bool) for t in texts]
    for block in blocks.values():
        for k1, _, lo, n in superkmer._bucket_intervals(block, 12).tolist():
            gone[k1 - 1][lo:lo + n + 11] = True
    assert [int(g.sum()) for g in gone] == [r[1] for r in brute(texts, 12)]


@pytest.mark.parametrize("floor", [1000, 1])
def test_query_form(spark, texts, monkeypatch, floor):
    monkeypatch.setattr(superkmer, "HOT_FLOOR", floor)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text)
           for r in superkmer.remove_repeats(docs, window=12, mer=4).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 12)


def test_hot_minimisers_are_found(spark, monkeypatch):
    monkeypatch.setattr(superkmer, "HOT_FLOOR", 50)
    quoted = " ".join(f"q{i}" for i in range(40))
    docs = spark.range(400).selectExpr(
        f"array_join(transform(sequence(1, 60), i -> concat('w', id, '_', i)), ' ') || "
        f"if(id % 2 = 0, ' {quoted}', '') as text").selectExpr("cast(text as binary) as text")
    hot = superkmer.hot_minimisers(docs.repartition(3), 200, 35, 4)
    words = superkmer.Words(quoted.encode()).runs(4).tolist()
    assert 0 < len(hot) <= 800 and set(hot.tolist()) <= set(words)


@pytest.mark.parametrize("flush", [1 << 26, 30_000])
def test_a_common_passage_gives_a_document_few_spans(spark, monkeypatch, flush):
    monkeypatch.setattr(superkmer, "HOT_FLOOR", 50)
    monkeypatch.setattr(superkmer, "FLUSH_BYTES", flush)
    quoted = " ".join(f"q{i}" for i in range(60))
    docs = spark.range(1200).selectExpr(
        "id as k1", "cast(id as int) as k2", "cast(array_join(transform(sequence(1, 40), i -> "
        f"concat('w', id, '_', i)), ' ') || ' {quoted} ' || array_join(transform(sequence(1, 40), "
        "i -> concat('v', id, '_', i)), ' ') as binary) as text").repartition(4)
    hot = superkmer.hot_minimisers(docs, 64, 35, 4)
    assert len(hot) >= 50
    spans = superkmer.repeated_spans(docs).collect()
    assert {r.k1 for r in spans} == set(range(1200)) and len(spans) <= 8 * 1200
    for i in (0, 7, 1199):
        covered = {w for r in spans if r.k1 == i for w in range(r.lo, r.lo + r.n)}
        assert covered == set(range(40, 66))


def test_merged_spans():
    spans = np.array([(1, 0, 5, 2), (1, 0, 0, 3), (1, 0, 3, 2), (1, 1, 7, 1), (2, 0, 0, 9),
                      (2, 0, 4, 1), (2, 0, 10, 1), (-3, 0, 1, 1), (1, 0, 5, 2)], superkmer.SPAN)
    assert superkmer._merged(spans).tolist() == [(-3, 0, 1, 1), (1, 0, 0, 7), (1, 1, 7, 1),
                                                 (2, 0, 0, 9), (2, 0, 10, 1)]


def test_odd_rows(odd_docs):
    got = superkmer.remove_repeats(odd_docs).collect()
    rows = odd_docs.collect()
    want = brute([r.text for r in rows], 35)
    assert sorted((r.doc_id or -1, *x) for r, x in zip(rows, want)) == \
        sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_text) for r in got)
    assert {r.doc_id: r.kept_text for r in got}[6] == "" and len(PASSAGE.split()) == 60


def test_empty_table(no_docs):
    assert superkmer.remove_repeats(no_docs).count() == 0


def test_equal_hashes_do_not_make_equal_windows(monkeypatch):
    monkeypatch.setattr(superkmer.Words, "runs",
                        lambda self, size: np.zeros(len(self.hashes) - size + 1, np.uint64))
    a, b = superkmer.repeated_windows([b"a b c d", b"b c d e"], 3)
    assert a.tolist() == [False, True] and b.tolist() == [True, False]
