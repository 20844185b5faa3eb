import pytest

from chronofeat.llm import mixing


def water_fill(sizes, share=1.5, weights=(5, 2, 1), cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(docs, **options):
    got = mixing.mix(docs, **options).collect()
    src = {}
    for r in docs.collect():
        src.setdefault(r.source, []).append(len((r.text or "").split()))
    want = water_fill({s: sum(v) for s, v in src.items()})
    by_size = {}
    assert len(got) == docs.count()
    for r in got:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size <= 2 * r.size
        by_size.setdefault((r.source_size, round(r.target, 3)), []).append(r)
    for s, sizes in src.items():
        rows = by_size[sum(sizes), round(want[s], 3)]
        if len([1 for t in src if (sum(src[t]), round(want[t], 3)) ==
                (sum(sizes), round(want[s], 3))]) == 1:
            assert abs(sum(r.taken for r in rows) - want[s]) <= max(sizes) + 1e-6
    return got


def test_odd_rows(odd_docs):
    check(odd_docs)


@pytest.mark.parametrize("leaf_rows,fan_in", [(1024, 32), (8, 2), (16, 4)])
def test_targets_are_met_through_the_tree_and_reruns_agree(spark, leaf_rows, fan_in):
    docs = spark.range(2000).selectExpr(
        "id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source",
        "repeat('w ', cast(1 + pmod(hash(id), 50) as int)) as text")
    a = check(docs, leaf_rows=leaf_rows, fan_in=fan_in)
    again = mixing.mix(docs.repartition(5), leaf_rows=leaf_rows, fan_in=fan_in).collect()
    assert sorted(a) == sorted(again)


def test_rounding_is_unbiased():
    picks = [0.0] * 6
    for s in range(4000):
        out = mixing.settle([3, 1, 4, 1, 5, 9], [0.5] * 6, [(s * 7919 + i * 104729) * 0x9E37 + i
                                                           for i in range(6)])
        assert sum(0 < p < 1 for p in out) <= 1
        assert sum(p * w for p, w in zip(out, [3, 1, 4, 1, 5, 9])) == pytest.approx(11.5)
        picks = [a + b for a, b in zip(picks, out)]
    assert all(abs(p / 4000 - 0.5) < 0.05 for p in picks)


def test_empty_table(no_docs):
    assert mixing.mix(no_docs).count() == 0
