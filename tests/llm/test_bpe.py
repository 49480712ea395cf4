import random

import public_tokenizers as P
import pytest
from pyspark.sql import types as T

from larkspur.llm import bpe

PATH = P.path("word_bpe_49k.json")
ODD = [None, "", " ", "don't we'll I'VE it's'", "a_b__c 1 22 333 x²y ½ Ⅷ", "ΣΑΣ ς ὈΔΥΣΣΕΎΣ", "é é ẛ̣", "<|endoftext|> x <|startoftext|><|endoftext|>y <|ENDOFTEXT|>", "\x1c\x1f a　b\x00c", "İstanbul ŞİŞLİ ǅ", "日本語テキスト 한국어 العربية", "👩‍👩‍👧 😀😀", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "!!!???...,,,"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_encode_and_decode_like_the_library(spark, reference):
    rng = random.Random(1)
    alphabet = "abcdeéßñ '1.²<|>_ΣAE\n\t"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "x", None)], schema)
    got = {r.doc_id: r for r in bpe.encode_decode(df, PATH).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids, t
        assert got[i].decoded == reference.decode(ids, skip_special_tokens=False), t
    assert None in got


def test_very_long_text(spark, reference):
    text = "The ouat onenti thheingble. " * 20_000
    row = bpe.encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert list(row.ids) == reference.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
