import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm.token_count import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda x: len(t.encode(x, add_special_tokens=False))


def texts():
    rng = random.Random(3)
    alphabets = ["ab \n", "don't we'll I'd 've \t  12", "é à ñ ß 'S", "漢字 日本 　 ok", "<|endoftext|> <| x", "\x1c\x1d \x85\xa0 a", "²³¹¼ÀÿªºµΩ 9", "á 👩‍👩‍👧 "]
    for a in alphabets:
        for n in (1, 7, 60, 700, 3000):
            yield "".join(rng.choice(a) for _ in range(n))
            yield "".join(rng.choice(a.split(" ")) + rng.choice(["", " ", "  ", "\n"]) for _ in range(n // 3))
    yield "x" * 5000
    yield " " * 3000 + "a"
    yield "word " * 900 + "y" * 2000 + " end" * 300
    yield ("<|endoftext|>" * 40 + "'re" * 300) * 3


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 20), (100, 8), (257, 64), (32_768, 256)])
def test_every_splice_gives_the_librarys_count(plain, chunk, overlap):
    c = Counter(PATH, chunk, overlap)
    for x in texts():
        assert c.count(x) == plain(x), (chunk, x[:80])


def test_texts_of_many_chunks_at_the_default_size(plain):
    rng, c = random.Random(8), Counter(PATH)
    words = ["the", "don't", "thing,", "été", "漢字", "12", "\n", "  ", "<|endoftext|>", "x" * 30]
    for n in (3_000, 12_000):
        x = " ".join(rng.choice(words) for _ in range(n))
        assert len(x) > c.chunk and c.count(x) == plain(x)
    long = "word " * 30_000 + "y" * 40_000 + " end" * 5_000
    assert c.count(long) == plain(long) and c.widened > 0


def test_overlaps_are_widened_when_one_pretoken_covers_them(plain):
    c = Counter(PATH, 50, 20)
    x = "a b " * 30 + "z" * 400 + " c d" * 30
    assert c.count(x) == plain(x) and c.widened > 0


def test_each_plain_character_counts_alike(plain):
    c = Counter(PATH)
    for k in range(0x250):
        for x in (chr(k), f"a{chr(k)}b", f" {chr(k)} {chr(k)}{chr(k)}1", f"{chr(k)}  x"):
            assert c.count(x) == plain(x), hex(k)


def test_rows(spark):
    rows = [(1, "héllo wörld", "t"), (2, None, "t"), (3, "", None), (None, "a", "t"), (1, "héllo wörld", "t")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in got) == [(0, 1), (1, 13), (1, 13), (2, 0), (3, 0)]
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
