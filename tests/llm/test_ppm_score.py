import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm.ppm_score import code_lengths, ppm_scores, windows


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def brute(rows, order):
    """PPM with method C and exclusion, symbol by symbol over a trie of dictionaries."""
    trie = defaultdict(lambda: defaultdict(int))
    low = [(i, (x or "").encode().lower()) for i, x in rows]

    def steps(x):
        s = b"\xfe" * order + x + b"\xff"
        return [(s[k - order : k], s[k]) for k in range(order, len(s))]

    for i, x in low:
        if not held(i):
            for ctx, c in steps(x):
                for k in range(order + 1):
                    trie[ctx[k:]][c] += 1

    def logp(ctx, c):
        gone, out = set(), 0.0
        for k in range(order + 1):
            seen = {s: n for s, n in trie[ctx[k:]].items() if s not in gone} if ctx[k:] in trie else {}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if c in seen:
                return out + math.log10(seen[c] / total)
            out += math.log10(len(seen) / total)
            gone |= set(seen)
        return out - math.log10(256 - len(gone))

    counts, end = defaultdict(int), 0
    for i, x in low:
        if not held(i):
            for w in [*x.split(), b""]:
                counts[w] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, x in low:
        tokens = [*x.split(), b""]
        out.append((i, held(i), len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), sum(logp(*s) for s in steps(x))))
    return out


@pytest.mark.parametrize("order", [2, 4])
def test_against_symbol_by_symbol_ppm(spark, order):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abÉ c\n") for _ in range(rng.choice([0, 1, 3, 20, 200])))) for i in range(60)] + [(70, None), (None, "Abc"), (3, "Zz q"), (3, "Zz q")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted([tuple(r) for r in ppm_scores(df, order=order).collect()], key=str)
    want = sorted(brute(rows, order), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want]) and np.allclose([r[6] for r in got], [r[6] for r in want])


def test_probabilities_after_any_context_sum_to_one():
    rng = np.random.default_rng(0)
    train = [bytes(rng.integers(97, 101, 300).astype(np.uint8)) for _ in range(4)]
    win = np.concatenate([windows([x], 4)[0] for x in train])
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs, ((win >> 8) & 255, win & 255), 1)
    last = 97 << 8 | 98
    own = win[(win >> 8) & 65535 == last]
    for ctx in {int(own[0]) >> 8, (120 << 24 | 97 << 16) | last, (97 << 24 | 120 << 16) | last}:
        every = np.unique(np.concatenate((own, (ctx << 8) + np.arange(256))))
        n = np.array([(own == w).sum() for w in every])
        p = code_lengths(every, n, 4, pairs)[every >> 8 == ctx]
        assert len(p) == 256 and abs((10**p).sum() - 1) < 1e-9


def test_no_rows_and_no_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ppm_scores(none).count() == 0
    i = next(k for k in range(100) if held(k))
    r = ppm_scores(spark.createDataFrame([(i, "ab")], "doc_id long, text string")).first()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and abs(r.score + 3 * math.log10(256)) < 1e-9


def test_windows_are_dealt_out_once(spark, monkeypatch):
    """The pairs of bytes are summed up from the blocks' lists, not from a second exchange of all windows."""
    df, plans = spark.createDataFrame([(i, "ab cd" * (i % 3)) for i in range(9)], "doc_id long, text string"), []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    ppm_scores(df)
    assert plans and not any("hashpartitioning(win#" in p for p in plans)
