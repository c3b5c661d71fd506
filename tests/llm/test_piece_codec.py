import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from sparkloom.llm.piece_codec import Pieces, chunk_table, decode, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(5)
    alphabets = ["the and ing  \n", "don't   we'll\t12\r\n", "é à ñ ß ▁ ▁▁", "漢字 日本　ok ", "<s> </s> <unk> <0x0A>", "\x00\x01 a\x1f", "ﬁ ① Å 👩‍👩‍👧 ​", "  \x85 \x0b \x0c x"]
    for a in alphabets:
        for n in (1, 2, 7, 60, 900):
            yield "".join(rng.choice(a) for _ in range(n))
            yield "".join(rng.choice(a.split(" ")) + rng.choice(["", " ", "  ", "\n", " \n ", "\n   "]) for _ in range(n // 3 + 1))
    yield from ("", " ", "   ", "\n", " \n", "\n ", "a", " a", "a ", "x" * 3000, " " * 3000, "\n" * 500, "word " * 2000 + "y" * 900 + " end" * 300)


def test_ids_of_chunks_are_the_librarys(sp):
    p = Pieces(MODEL)
    assert p.separable and "\n" in p.cuts
    for x in texts():
        chunks = p.chunks(x)
        assert "".join(chunks) == ("▁" + x.replace(" ", "▁") if x else "")
        ids = b"".join(map(p.segment, chunks))
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == sp.encode(x), repr(x[:60])


@pytest.mark.parametrize("table_bytes", [0, 300, 8 << 20])
def test_rows_decode_as_the_library_decodes(spark, sp, table_bytes):
    rows = [(i, x, "t") for i, x in enumerate(texts())] + [(None, "null id", None), (1, None, "t"), (1, "again again", "t"), (1, "again again", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode(encode(docs, MODEL, table_bytes=table_bytes), MODEL).collect()
    assert sorted(map(str, encode(docs, MODEL, back=True, table_bytes=table_bytes).collect())) == sorted(map(str, got))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = [(i, sp.encode(x or ""), sp.decode(sp.encode(x or ""))) for i, x, _ in rows]
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=key) == sorted(want, key=key)


def test_the_table_keeps_to_its_bound_and_takes_the_most_frequent(spark):
    docs = spark.createDataFrame([(i, " ".join(["often"] * 50 + [f"rare{i}"])) for i in range(40)], "doc_id long, text string")
    assert {r.chunk for r in chunk_table(docs, MODEL, table_bytes=100).collect()} == {"▁often"}
    assert len(chunk_table(docs, MODEL).collect()) == 41
    assert chunk_table(docs, MODEL, table_bytes=0).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert decode(encode(docs, MODEL), MODEL).count() == 0
