import hashlib
import random

import llm_odd as odd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as pb
from vigilia.llm import catalog
from vigilia.llm import pieces as P

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(catalog.PIECE_MODEL)
with open(PATH, "rb") as _f:
    MODEL = _f.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n, seed=1):
    rng = random.Random(seed)
    fixed = ["", " ", "  a  b ", "hello▁world", "\x00a\x00", "ﬁ①", "a\tb\n", "<s>hi</s><unk><0x41>", "　x", "é", "▁▁x▁ y▁", " " * 70, "x" * 500, "ab" * 3000, "𝔘" * 90]
    return fixed + ["".join(rng.choice("ab ▁é①漢\n\t𝔘  the<>0x́ ") for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_ids_and_spans_equal_the_library():
    encoder = P.Encoder(MODEL)
    for t, got in zip(texts(800), encoder.encode([t.encode() for t in texts(800)]), strict=True):
        assert list(zip(*(a.tolist() for a in got), strict=True)) == [(x.id, x.begin, x.end) for x in LIBRARY.encode(t, return_type="proto").pieces], t


def test_bytes_that_are_no_utf8():
    encoder = P.Encoder(MODEL)
    for t in (b"a\xffb\xc3", b"\xe2\x96", b"ok \xf0\x9f\x98 x", b"\x80\x80", b"\xed\xa0\x80z"):
        ids, begins, ends = encoder.encode([t])[0]
        assert ids.tolist() == LIBRARY.encode(t)
        assert (begins <= ends).all() and ends[-1] == len(t)


def test_compiled_maps_normalise_like_the_library():
    rng = random.Random(3)
    wide = ["".join(chr(rng.choice([rng.randint(32, 0x250), rng.randint(0x2000, 0x33FF), rng.randint(0xF900, 0xFFEF), rng.randint(0x1100, 0x11FF), 32]))
                    for _ in range(rng.randint(1, 40))) for _ in range(600)] + ["ﬁ①　 ＡＢ́ ½ ｶﾞ​﻿x \x07y Å Ω ǅ ㌀ ﷺ", "한글 각 é̂ ▁ "]
    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = pb.NormalizerSpec.FromString(library.serialized_normalizer_spec())
        own = P.Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        for t in texts(300) + wide:
            out, align = own(t.encode())
            want, places = library.normalize(t, with_offsets=True)
            assert out.decode() == want, (rule, t)
            at = [len(want[:i].encode()) for i in range(len(want))]
            assert [len(t.encode()[:align[a]].decode()) for a in at] == list(places)[:len(want)], (rule, t)


def test_other_models_are_refused():
    m = pb.ModelProto.FromString(MODEL)
    m.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        P.Encoder(m.SerializeToString())


def test_operator_on_odd_rows(spark):
    docs = odd.docs(spark)
    got = P.decode(P.encode(docs, MODEL), MODEL).collect()
    want = []
    for i, t, *_ in odd.rows():
        ids = LIBRARY.encode(t or "")
        want.append((i, ids, LIBRARY.decode(ids)))
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        source = next((t or "").encode() for i, t, *_ in odd.rows() if i == r.doc_id and LIBRARY.encode(t or "") == r.ids)
        assert b"".join(source[b:e] for b, e in zip(r.begins, r.ends, strict=True)) == source  # the spans cover the text
    assert P.decode(P.encode(odd.empty(spark), MODEL), MODEL).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert sorted(map(tuple, P.decode(nulls, MODEL).select("k", "decoded").collect())) == [(1, ""), (2, "")]


def test_invalid_utf8_in_a_column(spark):
    df = spark.createDataFrame([(1, bytearray(b"a\xffb"))], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("raw", T.BinaryType())]))
    got = P.encode(df.select("doc_id", F.col("raw").cast("string").alias("text")), MODEL).first()
    assert got.ids == LIBRARY.encode(b"a\xffb") and got.ends[-1] == 3


def test_query_equals_the_library_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in catalog.op13_sentencepiece(spark, SF, PATH).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d.text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
        assert got[d.doc_id] == want
