import hashlib
import math
import random

import numpy as np
import pytest

from chronofeat.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, `a.b` int"


def brute(rows, parts, entries, rounds, scale=256):
    """Rows (id, vector, label) by whole searches: {id: (code, error, label_error)}, codebooks."""
    rows = sorted(((i, [math.floor(scale * x) for x in v], y) for i, v, y in rows),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(rows[0][1]) // parts
    cut = [[v[p * dim:(p + 1) * dim] for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(near(c[p], books[p])[1], []).append(c[p])
            new.append([[sum(z) // len(mine[i]) for z in zip(*mine[i])] if i in mine else e
                        for i, e in enumerate(books[p])])
        books = new
    out, by_label = [], {}
    for (i, _, y), c in zip(rows, cut):
        best = [near(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[y] = by_label.get(y, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in best), error, y))
    flat = ",".join(str(z) for b in books for e in b for z in e)
    return sorted(((i, c, e, by_label[y]) for i, c, e, y in out),
                  key=str), hashlib.sha256(flat.encode()).hexdigest()


def compressed(df, **options):
    codes, books = vc.compress(df, **options)
    got = [(r.id, r.code, r.error, r.label_error) for r in codes.collect()]
    return sorted(got, key=str), vc.digest(books)


@pytest.mark.parametrize("width", [1, 7, 32, 4096])
def test_memoised_cells_equal_a_whole_search(width):
    rng = np.random.default_rng(width)
    entries = rng.integers(-90, 90, (40, 3))
    entries[7] = entries[3]  # equal entries: the lower index
    x = np.r_[rng.integers(-200, 200, (3000, 3)), entries, entries + 1]
    gaps = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    cells = vc.Cells(entries, width, limit=50)
    for part in (x, x[::-1][:100]):
        code, gap = cells.nearest(part)
        want = gaps if part is x else gaps[::-1][:100]
        assert (code == want.argmin(1)).all() and (gap == want.min(1)).all()


def test_a_new_cell_keeps_few_entries():
    entries = np.random.default_rng(1).integers(-100, 100, (64, 4))
    kept = vc.Cells(entries, 16)._candidates(np.array([[0, 0, 0, 0], [-3, 2, 1, -1]]))
    assert all(1 <= len(k) < 40 for k in kept)


def test_compression_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i * 7 % 301, [rnd.gauss(0, 0.2) for _ in range(8)], rnd.choice([None, 1, 2]))
            for i in range(300)]
    rows += [(1000, rows[5][1], 1), (1000, rows[5][1], 1), (None, rows[9][1], 3), (1001, [0.0] * 8, 9)]
    df = spark.createDataFrame([(i, v, y, "x", None, 1) for i, v, y in rows], SCHEMA)
    exact = [(r.vec_id, r.embedding, r.label) for r in df.collect()]  # as 32-bit floats
    for entries, rounds in ((64, 2), (5, 3), (1, 0)):
        assert compressed(df, parts=4, entries=entries, rounds=rounds) == brute(
            exact, 4, entries, rounds)


def test_unusable_vectors_give_no_row(spark):
    good = [0.5, -0.25, 0.125, 1.0]
    odd = [None, [], [1.0, None, 0.0, 0.0], [math.nan] + good[1:], [math.inf] + good[1:],
           [-math.inf] + good[1:], [1.0, 2.0], good * 2, [1e9] + good[1:], good[:3]]
    rows = [(i, v, None, "x", None, 1) for i, v in enumerate([good, *odd], 1)]
    got, _ = compressed(spark.createDataFrame(rows, SCHEMA), parts=4)
    assert got == [(1, "00000000", 0, 0)]


def test_empty_table(spark):
    codes, books = vc.compress(spark.createDataFrame([], SCHEMA))
    assert codes.count() == 0 and vc.digest(books) == hashlib.sha256(b"").hexdigest()


def test_hot_labels_and_decoding(spark):
    rows = [(i, [i / 100.0, -i / 50.0], 0 if i % 3 else i, "x", None, 1) for i in range(60)]
    codes, books = vc.compress(spark.createDataFrame(rows, SCHEMA), parts=2, entries=8)
    got = codes.collect()
    total = {}
    for r in got:
        total[r.label] = total.get(r.label, 0) + r.error
    assert all(r.label_error == total[r.label] for r in got) and len(got) == 60
    for r in vc.decode(codes, books).collect():
        want = [books[p][int(r.code[2 * p:2 * p + 2], 16)][0] / 256 for p in range(2)]
        assert r.vector == want


def test_too_many_entries(spark):
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([], SCHEMA), entries=300)
