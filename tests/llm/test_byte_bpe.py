import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from eventloom.llm import byte_bpe
from eventloom.llm.common import table

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_query_as_the_library(spark, tables, docs):
    ids = {i: library().encode_ordinary(t or "") for i, t in docs}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(ids[i]), digest(" ".join(map(str, ids[i])).encode()), digest((t or "").encode())) for i, t in docs}
    got = byte_bpe.op8_byte_bpe(spark, tables[0]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)
    assert byte_bpe.op8_byte_bpe(spark, tables[1]).count() == 0


def test_rare_pieces_in_their_rows(spark, tables, docs):
    ranks = byte_bpe.read_ranks(PATH)
    out = byte_bpe.encode_texts(table(spark, tables[0], "documents"), ranks, PATTERN, keep=["doc_id"], most_words=3)
    got = sorted((str(r["row"]["doc_id"]), r["ids"]) for r in out.collect())
    assert got == sorted((str(i), library().encode_ordinary(t or "")) for i, t in docs)


def test_decoding_leaves_out_unknown_ids(spark):
    ranks = byte_bpe.read_ranks(PATH)
    ids = library().encode_ordinary("Größe 中文")
    df = spark.createDataFrame([([*ids, None, 999_999],), ([],), (None,)], "ids array<int>")
    got = [r[0] for r in df.select(byte_bpe.decode_ids(F.col("ids"), ranks)).collect()]
    assert got[0].decode() == "Größe 中文" and got[1] == b"" and not got[2]


def test_long_words(spark):
    import random

    ranks, rng = byte_bpe.read_ranks(PATH), random.Random(2)
    for n in (1, 2, 50, 127, 128, 129, 700, 3000):
        for letters in (b"ab", b"x", bytes(range(97, 123)), b"\xc3\xa9\x00"):
            word = bytes(rng.choices(letters, k=n))
            want = library()._encode_single_piece(word)
            assert byte_bpe.merged(ranks, word) == want
            if n < 3000 and word not in ranks:
                assert byte_bpe._merged_long(ranks, word) == want


def test_split_as_the_module():
    import random

    import regex

    rng, signs = random.Random(1), "ab zéÜ0129²½ \t\n\r\x0b\x1c\x1f\x85\xa0\u2003\u3000中文'slltdmve!?-_[]\\^\u0301\u0660Ⅷ"
    for i in range(3000):
        text = "".join(rng.choices(signs + "😀𝒳" * (i % 3 == 0), k=rng.randrange(30)))
        assert byte_bpe.splitter(PATTERN)(text.encode()) == regex.findall(PATTERN, text)
