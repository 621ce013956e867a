"""Merge replay against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sentigrade.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(path):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    letters = list("abcdefgst hello the and  \n\t é日本12²½３!?'restll‍🎉ſ")
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    return made + ["", "a" * 3000, "ab" * 2000, " " * 500, "aaaaabaaab" * 100, "ÿ" * 99, "<|endoftext|>", "the the the"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_same_tokens_as_the_library(texts, name):
    path = public_tokenizers.path(name)
    want = encoding(path).encode_ordinary_batch(texts)
    portions = [texts[k : k + 90] for k in range(0, len(texts), 90)]
    got = [ids for part in bpe.encode_batches(portions, path, public_tokenizers.PATTERN, keep_words=200) for ids in part]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == want
    assert [bpe.decode_ids(ids, path) for ids in got] == [text.encode() for text in texts]


def test_frames(spark, texts):
    rows = [(k, text) for k, text in enumerate(texts)] + [(None, None), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", bpe.F.lit(1))
    library = encoding(PATH)

    def digest(key, text):
        ids = library.encode_ordinary(text or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        return key, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = bpe.digest_round_trip(df.repartition(3), PATH, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((digest(*row) for row in rows), key=repr)
    decoded = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in decoded.where("doc_id is not null").collect()) == sorted(
        (k, t) for k, t in rows if k is not None
    )
    assert bpe.digest_round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
