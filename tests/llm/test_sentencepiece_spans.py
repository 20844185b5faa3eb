import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from chronofeat.llm import sentencepiece_spans as sp
from chronofeat.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
_pick = random.Random(1)
ODD = ["", "a", " ", "   x  y ", "日本語 😀😀 テキスト", "a" * 5000, " " * 301, "\x00\x01 x",
       "▁▁a ▁b", "<s> </s> <unk> <0x41>", "ab" * 300 + "1" * 77, "Éclair à la carte " * 50,
       "� x", "\n\n\t x", "é ① ㈱ ﬁ ｶﾞ", "don't(); x==1,2"]
ODD += ["".join(_pick.choice("ab t▁ é日😀eins\n0") for _ in range(_pick.randint(1, 150)))
        for _ in range(200)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(library, pieces, texts):
    for t in texts:
        want = library.encode(t, add_eos=True)
        ids, starts, ends = pieces.encode(t.encode())
        assert ids.tolist() == want, t
        assert pieces.decode(ids) == library.decode(want), t
        spans = [(p.begin, p.end) for p in library.encode(t.encode(), return_type="proto").pieces]
        assert list(zip(starts.tolist(), ends.tolist()))[:-1] == spans, t


@pytest.mark.parametrize("entries", [800_000, 8])
def test_ids_spans_and_text_equal_the_library(library, entries):
    same(library, sp.Pieces(PATH, entries), ODD)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_character_maps(rule, squeeze):
    with open(PATH, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    rules = sentencepiece_model_pb2.ModelProto.FromString(
        sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    mapped = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    same(mapped, sp.Pieces.of(proto), ODD)


def test_invalid_bytes_and_spans_tile_the_text(library):
    pieces = sp.Pieces(PATH)
    for raw in (b"a\xff b\xe3\x81 c\xf0\x9f", b"\x80", b"x\xed\xa0\x80y"):
        assert pieces.encode(raw)[0].tolist() == library.encode(raw, add_eos=True)
    for t in ODD:
        _, starts, ends = pieces.encode(t.encode(), end=False)
        assert "".join(t.encode()[a:b].decode() for a, b in zip(starts, ends)) == t


def test_unsupported_models_are_refused():
    with open(PATH, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    proto.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        sp.Pieces.of(proto)
    proto.trainer_spec.byte_fallback = True
    proto.pieces[400].type = 4
    with pytest.raises(ValueError):
        sp.Pieces.of(proto)


def test_whole_documents_and_odd_rows(spark, library, odd_docs):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(
        odd_docs.select("doc_id", "text"))
    rows = docs.collect()
    want = library.encode([r.text or "" for r in rows], add_eos=True)
    done = sp.encode_documents(docs, PATH)
    got = sorted((r.doc_id or -1, list(r.ids), r.decoded) for r in done.collect())
    assert got == sorted((r.doc_id or -1, w, library.decode(w)) for r, w in zip(rows, want))
    again = sp.decode_ids(done.drop("decoded"), PATH).select("decoded")
    assert sorted(r.decoded for r in again.collect()) == sorted(d for _, _, d in got)


def test_clashing_names_and_empty_table(spark, no_docs, odd_docs):
    renamed = odd_docs.selectExpr("doc_id AS `t.k`", "text AS ids", "lang AS t")
    got = sp.encode_documents(renamed, PATH, key="t.k", text="ids")
    assert got.columns == ["t.k", "ids", "starts", "ends", "decoded"]
    assert got.count() == odd_docs.count()
    assert sp.encode_documents(no_docs, PATH).count() == 0
    none = sp.decode_ids(spark.createDataFrame([(1, None)], "k int, ids array<int>"), PATH)
    assert none.first().decoded is None
