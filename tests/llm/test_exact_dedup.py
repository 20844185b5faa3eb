from collections import defaultdict

from chronofeat.llm import exact_dedup

from .conftest import lowered, sha256


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[sha256(lowered(r.text))].append(r.doc_id)
    return {(h, max((i for i in ids if i is not None), default=None), len(ids))
            for h, ids in groups.items()}


def check(docs, tracked):
    got = exact_dedup.exact_groups(docs, tracked=tracked).collect()
    want = brute(docs.collect())
    assert len(got) == docs.count()
    assert {(r.text_sha256, r.keep_id, r.group_size) for r in got} == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(want) and all(r.doc_id == r.keep_id for r in kept)


def test_matches_brute_force_whatever_counts_as_frequent(spark, odd_docs):
    hot = spark.range(300).selectExpr(
        "id + 100 as doc_id", "if(id % 3 = 0, 'Hot TEXT', concat('t', id % 40)) as text")
    docs = odd_docs.select("doc_id", "text").unionByName(hot)
    check(docs, 1024)
    check(docs, 2)


def test_stage_keeps_one_row_per_text_with_all_columns(odd_docs):
    kept = exact_dedup.drop_exact_duplicates(odd_docs)
    assert kept.schema == odd_docs.schema
    rows = kept.collect()
    assert len({lowered(r.text) for r in rows}) == len(rows)
    assert {lowered(r.text) for r in rows} == {lowered(r.text) for r in odd_docs.collect()}
    assert sorted(r.doc_id for r in rows if r.doc_id) == [2, 4, 5, 6, 7, 9, 10, 11]


def test_empty_table(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(no_docs).count() == 0
