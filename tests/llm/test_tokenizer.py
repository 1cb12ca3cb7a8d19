import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from gleanery.llm import tokenizer as T  # noqa: E402


@pytest.fixture(scope="module")
def both():
    ranks = T.load_ranks(T.public_path("byte_bpe_50k.tiktoken"))
    return T.encoder(T.public_path("byte_bpe_50k.tiktoken"), P.PATTERN), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_files_agree():
    assert T.load_ranks(T.public_path("byte_bpe_50k.json")) == T.load_ranks(T.public_path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("text", ["", None, " ", "a", "Hello  world's end\n\n", "<|endoftext|> is text", "naïve café 日本語 😀", "\x00\x07", "٣٤ ½", "a" * 5000, "ab" * 5000, "\t \t\n" * 50])
def test_same_ids_and_round_trip(both, text):
    mine, theirs = both
    ids = mine.encode(text)
    assert ids == (theirs.encode_ordinary(text) if text else [])
    assert mine.decode(ids).decode() == (text or "")


def test_random_bytes_and_pairs_of_tokens(both):
    mine, theirs = both
    r = random.Random(1)
    tokens = list(mine.ids)
    for _ in range(3000):
        data = b"".join(r.choice(tokens) for _ in range(r.randint(1, 4)))
        ids = mine.encode_bytes(data)
        assert ids == theirs._core_bpe.encode_single_piece(data) and mine.decode(ids) == data


def test_another_vocabulary():
    path = T.public_path("byte_bpe_multi_50k.tiktoken")
    ranks = T.load_ranks(path)
    theirs = tiktoken.Encoding("m", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("Über die Brücke", "el niño", "東京の朝"):
        assert T.encoder(path, P.PATTERN).encode(text) == theirs.encode_ordinary(text)


def test_frame(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (2, "", 7), (3, None, 8)], "doc_id long, text string, ids int")
    out = sorted((r.doc_id, list(r.ids)) for r in T.encoded(df).collect())
    assert out[0] == out[1] and out[2:] == [(2, []), (3, [])] and len(out[0][1]) == 2
    assert T.encoded(df.limit(0)).count() == 0
