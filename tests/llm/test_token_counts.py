import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronofeat.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "<|endoftext|>", "x<|endoftext|>y <|endoftext|><|endoftext|>", "a" * 1001,
       "  \n\n  \t x ", "日本語テキスト 😀😀", "don't we'll I'M", "   z", "ab" * 300 + "1" * 77,
       "Éclair à la carte " * 50, "\x00\x01    x", "<|endoftext", "!!!???***" * 9]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts,
                                                                     add_special_tokens=False)]


@pytest.mark.parametrize("entries", [400_000, 7])
def test_counts_equal_the_library(library, entries):
    counting = tc.Counting(PATH, entries)
    assert counting.count(ODD) == library(ODD)
    assert [counting.count([t])[0] for t in ODD] == library(ODD)


def test_whole_documents(spark, library, odd_docs):
    from chronofeat.llm.common import table
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(
        odd_docs.select("doc_id", "text"))
    rows = docs.collect()
    want = library([r.text or "" for r in rows])
    got = tc.token_counts(docs, PATH, group_bytes=5000).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (r.doc_id or -1, len((r.text or "").encode()), n, n > 512) for r, n in zip(rows, want))


def test_empty_table(no_docs):
    assert tc.token_counts(no_docs, PATH).count() == 0
