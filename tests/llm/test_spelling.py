import random
import re
import zlib

import numpy as np
import pytest

from chronofeat.llm import spelling as sp
from chronofeat.llm.common import table

SF = "/root/testdata/sf0.001"


def edited(a, b):
    """Whether one inserted, deleted or replaced letter turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_vocabulary(rows, min_length=5, min_count=3, every=97):
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= min_length:
                n[w] = n.get(w, 0) + 1
    return {w: k for w, k in n.items() if k >= min_count}


def brute(n, ratio=2):
    near = {w: [] for w in n}
    words = sorted(n)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        for size in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [o for o in by_length.get(size, ()) if edited(w, o)]
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


def rows_of(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def variants(rnd, size, alphabet="abcdeé×ÿ"):
    """A vocabulary thick with near words: random words and chains of their edits."""
    out = {}
    while len(out) < size:
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(5, 9)))
        for _ in range(4):
            out.setdefault(w, rnd.choice([3, 4, 7, 20, 90]))
            i, kind = rnd.randrange(len(w)), rnd.randrange(3)
            w = w[:i] + (rnd.choice(alphabet) if kind else "") + w[i + (kind < 2):]
            w = w if len(w) >= 5 else w + "zzz"
    return out


@pytest.mark.parametrize("cell_words, sample", [(2048, 1 << 17), (8, 200), (1, 1 << 17)])
def test_groups_equal_brute_force(spark, cell_words, sample):
    n = variants(random.Random(cell_words), 500)
    rows = [(i, " ".join(w for w in n for _ in range(3)) + " ") for i in range(1)]
    rows += [(10 + k, " ".join([w] * (c - 3))) for k, (w, c) in enumerate(n.items()) if c > 3]
    got = sp.variant_groups(spark.createDataFrame(rows, "doc_id long, text string"),
                            delete_every=None, cell_words=cell_words, sample=sample)
    want = brute(n)
    assert any(r[5] not in (r[0], r[3]) for r in want)  # chains of more than one step
    assert rows_of(got) == want


def test_whole_documents(spark):
    docs = table(spark, SF, "documents")
    n = brute_vocabulary([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(sp.variant_groups(docs, cell_words=64)) == brute(n)


def test_odd_documents(spark, odd_docs, no_docs):
    tripled = odd_docs.unionByName(odd_docs).unionByName(odd_docs).withColumnRenamed("digest", "w")
    n = brute_vocabulary([(r.doc_id, r.text) for r in tripled.collect()])
    assert rows_of(sp.variant_groups(tripled.withColumnRenamed("lang", "a.b"))) == brute(n)
    assert sp.variant_groups(no_docs).count() == 0


def test_long_words_and_few_lengths(spark):
    long_ = "ab" * 3000
    words = [long_, long_[1:], long_ + "a", "x" * 5, "x" * 6, "x" * 7]
    df = spark.createDataFrame([(None, " ".join([w, w, w])) for w in words],
                               "doc_id long, text string")
    got = rows_of(sp.variant_groups(df, delete_every=None))
    assert got == brute({w: 3 for w in words})


def test_one_edit():
    rnd = random.Random(3)
    for _ in range(2000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 7)))
        b = "".join(rnd.choice("ab") for _ in range(len(a) + rnd.randint(0, 1)))
        got = sp.one_edit(sp._letters([a]), sp._letters([b]))[0]
        assert bool(got) == edited(a, b), (a, b)


def test_cells_reach_every_near_word():
    rnd = random.Random(5)
    words = sorted(w for w in variants(rnd, 800) if len(w) == 7)
    counts = sp._counts(sp._letters(words))
    tree = sp.TopTree(counts[::3], 4, 0)
    row, own = tree.reach(counts, 0, 0)
    home = dict(zip(row.tolist(), own.tolist()))
    assert len(home) == len(words) and tree.cells > 10  # exactly one cell each
    row, cell = tree.reach(counts, 1, 1)
    seen = set(zip(row.tolist(), cell.tolist()))
    assert len(seen) == len(row) < len(words) * tree.cells
    gap = counts[:, None, :] - counts[None]
    near = (np.maximum(gap, 0).sum(2) <= 1) & (np.maximum(-gap, 0).sum(2) <= 1)
    assert all((q, home[p]) in seen for q, p in zip(*map(np.ndarray.tolist, np.nonzero(near))))
