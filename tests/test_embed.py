import math
import random
from collections import Counter

import numpy as np
import pytest

from chronofeat.operators import embed
from chronofeat.plans import learn


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(3000):
        g = rng.randrange(4)
        a = f"a{g}{rng.randrange(5)}" if i % 50 else None
        b = g * 3 + rng.randrange(3) if rng.random() < 0.8 else rng.randrange(12)
        out.append((a, b, f"c{rng.randrange(3)}" if i % 70 else None, float(i % 5), int(g >= 2)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b int, `c.d` string, value double, label int")


def dense(rows, at, others):
    """Brute-force matrix of one column against the others: (labels, contexts, matrix)."""
    labels = sorted({str(r[at]) for r in rows if r[at] is not None})
    contexts, blocks = [], []
    for name, o in others:
        seen = Counter((str(r[at]), str(r[o])) for r in rows
                       if r[at] is not None and r[o] is not None)
        total = sum(seen.values())
        left, right = Counter(), Counter()
        for (x, y), n in seen.items():
            left[x] += n
            right[y] += n
        values = sorted(right)
        contexts += [(name, v) for v in values]
        blocks.append([[max(0.0, math.log(seen[x, y] * total / (left[x] * right[y])))
                        if seen[x, y] else 0.0 for y in values] for x in labels])
    return labels, contexts, np.concatenate([np.array(b) for b in blocks], axis=1)


def test_singular_values_and_cells_match_a_dense_factorisation(frame, rows):
    model = embed.fit_category_embedding(frame, ["a", "b", "c.d"],
                                         widths={"a": 20, "b": 12, "c.d": 3})
    cells = embed.positive_information(embed.cooccurrence(frame, ["a", "b", "c.d"]))
    back = {(r["column"], r["value"], r["context"], r["other"]): r["x"]
            for r in model.reconstruct(cells).collect()}
    names = {"a": 0, "b": 1, "c.d": 2}
    seen = 0
    for c, at in names.items():
        labels, contexts, m = dense(rows, at, [(o, i) for o, i in names.items() if o != c])
        want = np.linalg.svd(m, compute_uv=False)
        got = np.array(model.singular[c])[:len(want)]
        assert np.allclose(got, want[:len(got)], atol=1e-6)
        for i, label in enumerate(labels):
            for j, (context, other) in enumerate(contexts):
                if m[i, j] > 0:
                    assert back[c, label, context, other] == pytest.approx(m[i, j], abs=1e-8)
                    seen += 1
    assert seen == len(back)


def test_narrow_widths_lose_no_more_than_the_best_approximation(frame, rows):
    model = embed.fit_category_embedding(frame, ["a", "b"], widths={"a": 3, "b": 2}, share=1.0)
    _, _, m = dense(rows, 0, [("b", 1)])
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(model.singular["a"], s[:3], atol=1e-6)
    got = {r["value"]: r["v"] for r in model.left.where("column = 'a'").collect()}
    mine = np.array([got[x] for x in sorted(got)])
    best = (u[:, :3] * s[:3]) @ (u[:, :3] * s[:3]).T
    assert np.allclose(mine @ mine.T, best, atol=1e-6)


def test_default_widths_nulls_unseen_and_clashing_names(spark, frame):
    model = embed.fit_category_embedding(frame, ["a", "b"])
    assert model.widths == {"a": 11, "b": 7}  # NULL counts as a value of a
    new = spark.createDataFrame([(None, 1, "x", 9.0), ("never", 2, "y", 8.0), ("a00", None, "z", 1.0)],
                                "a string, b int, v string, value double")
    got = model.features(new, ["value"]).orderBy("v").collect()
    assert [len(r["features"]) for r in got] == [19, 19, 19]
    assert got[0]["features"][:11] == [0.0] * 11 and got[1]["features"][:11] == [0.0] * 11
    assert any(got[0]["features"][11:18]) and not any(got[2]["features"][11:18])
    assert [r["features"][-1] for r in got] == [9.0, 8.0, 1.0] and got[0]["v"] == "x"


def test_reruns_agree_and_empty_tables_embed_nothing(frame):
    one, two = (embed.fit_category_embedding(frame.repartition(n), ["a", "b"], widths={"a": 4, "b": 4})
                for n in (3, 11))
    cells = embed.positive_information(embed.cooccurrence(frame, ["a", "b"]))
    back = [{tuple(r)[:4]: r["x"] for r in m.reconstruct(cells).collect()} for m in (one, two)]
    assert back[0].keys() == back[1].keys()
    assert all(abs(x - back[1][k]) < 1e-6 for k, x in back[0].items())
    none = embed.fit_category_embedding(frame.where("false"), ["a", "b"])
    assert none.left.count() == 0 and set(none.singular["a"]) == {0.0}
    assert not any(none.features(frame).first()["features"])


def test_bad_requests_raise(frame):
    with pytest.raises(ValueError, match="second column"):
        embed.fit_category_embedding(frame, ["a"])
    with pytest.raises(ValueError, match="at most"):
        embed.fit_category_embedding(frame, ["a", "b"], widths={"a": 90})


def test_training_on_embeddings_separates_what_the_labels_share(frame):
    model = embed.fit_category_embedding(frame, ["a", "b"])
    x = model.features(frame.drop("c.d").where("a is not null"), ["value"])
    fitted = learn.train_weighted(x, [], "features", "label", max_iter=50)
    scored = learn.score(fitted, x, "features")
    right = scored.where("prediction = label").count()
    assert right == scored.count()  # a's first digit decides the label
