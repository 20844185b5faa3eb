"""Extra columns of any name pass through every operator and stage unchanged."""

import pytest

import corpus_pipeline
from chronofeat.llm import (arc_warc, decontaminate, exact_dedup, langid, mixing, quality_knn,
                            sentencepiece_spans, simhash_dedup, spelling, superkmer, token_counts,
                            toxicity, vector_codes)

SF = "/root/testdata/sf0.001"
ODD = ["a.b", "__leak", "__near_hash", "__dedup_digest", "digest", "k1", "name", "c0", "fp", "rank",
       "s", "t", "bucket", "doc_hash", "score"]


@pytest.fixture(scope="module")
def docs(spark, odd_docs):
    wide = odd_docs.drop("digest")
    n = len(wide.columns)
    rows = [(*r, *[f"{c}-{i}" for c in ODD]) for i, r in enumerate(wide.collect())]
    out = spark.createDataFrame(rows, wide.schema.simpleString()[7:-1].replace(":", " ") + "".join(
        f", `{c}` string" for c in ODD))
    assert len(out.columns) == n + len(ODD)
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 0), (10, 0, 1)],
                                 "doc_id long, quality int, toxic int")


def test_filtering_operators_keep_every_column(spark, docs, labels):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    whole = {tuple(r) for r in docs.collect()}
    for out in (quality_knn.keep_good(docs, labels), exact_dedup.drop_exact_duplicates(docs),
                simhash_dedup.drop_near_duplicates(docs),
                decontaminate.drop_contaminated(docs, bench)):
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(tuple(r) in whole for r in rows)


def test_other_operators_ignore_them(docs, labels):
    import public_tokenizers as tokens

    n = docs.count()
    for out in (quality_knn.score(docs, labels), toxicity.score(docs, labels),
                langid.identify(docs), superkmer.remove_repeats(docs), mixing.mix(docs),
                simhash_dedup.near_groups(docs), exact_dedup.exact_groups(docs),
                token_counts.token_counts(docs, tokens.path("byte_bpe_50k.json")),
                sentencepiece_spans.encode_documents(docs, tokens.path("piece_bpe_32k.model"))):
        assert out.count() == n and "doc_id" in out.columns
    assert spelling.variant_groups(docs).count() >= 1


def test_clashing_names_of_keys(docs):
    for key in ("k1", "a.b", "digest"):
        named = docs.drop(key).withColumnRenamed("doc_id", key)
        assert superkmer.remove_repeats(named, key=key).columns[0] == key
        assert exact_dedup.drop_exact_duplicates(named, key=key).columns == named.columns
        assert simhash_dedup.drop_near_duplicates(named, key=key).columns == named.columns
        assert mixing.mix(named, key=key).columns[0] == key


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>x</p>", "v", "w")],
                                  "page_id long, url string, html string, `a.b` string, payload string")
    assert arc_warc.archive_pages(pages).count() == 1
    vectors = spark.createDataFrame([(1, [1.0] * 16, 2, "v", 3)],
                                    "vec_id long, embedding array<float>, label int, `a.b` string, v int")
    assert vector_codes.compress(vectors)[0].count() == 1


def test_stages_keep_every_column(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
