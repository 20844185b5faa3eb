import corpus_pipeline
from chronofeat.llm import decontaminate, exact_dedup, quality_knn
from chronofeat.llm.common import stored, table

from .conftest import lowered
from .test_decontaminate import brute
from .test_mixing import water_fill
from .test_simhash_dedup import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_match_their_brute_force_versions(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    columns, outs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "test-stage")
        if name != "mix":
            assert out.columns == columns
        outs.append((name, docs.collect(), out.collect()))
        docs = out
    for name, before, after in outs:
        ids = sorted(r.doc_id for r in after)
        if name == "quality":
            scores = {r.doc_id: r.score for r in quality_knn.score(
                table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
            assert ids == sorted(d for d, s in scores.items() if s >= 0.5)
            assert 0.5 * len(before) < len(ids) <= len(before)
        elif name == "exact_dedup":
            last = {}
            for r in before:
                last[lowered(r.text)] = max(r.doc_id, last.get(lowered(r.text), -1))
            assert ids == sorted(last.values())
        elif name == "near_dedup":
            own = [r.doc_id for r in before]
            assert ids == sorted(set(plain_components(
                own, [plain_fingerprint(r.text) for r in before], 2)))
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            bad = {d for d, _ in brute([(r.doc_id, r.text) for r in before], items)}
            assert ids == sorted(r.doc_id for r in before if r.doc_id not in bad)
        else:
            sizes = {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
            want = water_fill(sizes)
            assert ids == sorted(r.doc_id for r in before)
            assert abs(sum(r.taken for r in after) - sum(want.values())) < 0.05 * sum(want.values())


def test_empty_and_odd_documents_pass_every_stage(spark, odd_docs, no_docs):
    for docs in (no_docs, odd_docs):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), "test-stage")
            assert docs.count() <= n


def test_stage_options_reach_the_operators():
    assert corpus_pipeline.ORACLE_SQL is None
    assert exact_dedup.TRACKED == 1024 and decontaminate.THRESHOLD == 0.8
