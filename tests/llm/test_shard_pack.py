import zlib
from collections import Counter

import numpy as np

from sparkloom.llm.common import ascii_words
from sparkloom.llm.shard_pack import pack, place


def test_place_takes_the_highest_dot_product():
    v = np.array([[0.5, 0.1], [0.1, 0.5], [0.2, 0.2], [0.2, 0.2]])
    got = place(v, 2)
    # second: (0, .4) gives .2, (.5, .5) gives .3; third: .08 on both; fourth: 0 and .08
    assert got.tolist() == [0, 1, 0, 1]
    assert place(np.zeros((0, 2)), 3).tolist() == []


def test_rows_sizes_slots_and_balance(spark):
    rows = [(k, "word " * (k % 90 + 1) + str(k)) for k in range(3000)] + [(5000 + k, "same text again") for k in range(1500)]
    rows += [(9001, None), (9002, ""), (9003, None), (1, "word word 1"), (1, "word word 1"), (None, "é")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, size string")
    got = pack(df, n_shards=6).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((x or "").encode()) + 8, zlib.crc32((x or "").encode())) for i, x in rows)
    for k in range(6):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(6)]
    counts = [sum(r.shard == k for r in got) for k in range(6)]
    assert max(sizes) < 1.02 * min(sizes) and max(counts) < 1.1 * min(counts)
    text = dict(zip([i for i, _ in rows], [x for _, x in rows], strict=True))
    small = [i for i, n in Counter(text.values()).items() if n < 100]
    by = {}
    for r in got:
        by.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(by[x]) == 1 for x in small)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tokens_are_words_whatever_parts_them(spark):
    texts = ["one\ntwo\tthree", "a   b", "", None, "  ", "x,y;z", "né 日本 7", "Zed_A@b[c`d{e"]
    got = {r.doc_id: r.tokens for r in pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n_shards=2).collect()}
    assert got == {i: len(ascii_words(x)) for i, x in enumerate(texts)} and got[0] == 3 and got[1] == 2
