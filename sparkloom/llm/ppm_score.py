"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a context trie of order ``order``: for every context of up to so many bytes, how often each byte followed
it in the training documents. A byte is coded in its longest context; where it never followed there, an escape (method
C: as likely as there are distinct followers) leads to the next shorter context, in which all bytes seen in the longer
one are excluded from the counts; below order 0 the bytes never seen share the rest evenly. A document's score is the
log10 probability of its bytes, A-Z lower-cased, and of an end mark. Byte 0xFE stands before each text as its first
context and 0xFF ends it; neither occurs in UTF-8.

Because the trie is fixed once trained, a byte's code length depends on nothing but the window of ``order`` bytes
before it and itself. So the corpus never meets in one place:

1. Documents are dealt by hash into blocks of about ``block_bytes`` of text, whatever the number of partitions. A block
   lists its distinct windows and words with their training counts, so it is large enough to repeat few of them in
   others and small enough for one task. A longer text is a block's part by itself.
2. Counts are summed over blocks. Windows are grouped by their last two context bytes; such a group holds all trie
   nodes of order 2 and more that its windows pass, and the rest of the trie, orders 1 and 0, has at most 65,536 and 256
   entries and travels with the task. Each window gets its code length there.
3. Blocks look their windows and words up by joins and are scored where their documents are.

The unigram base is computed from the summed word counts in the same passes.

Defined results: a null text is empty; a null doc_id counts as the empty text in the training rule; an empty text
scores its end mark alone; without training documents the model is uniform and the base gives log10(1/1) = 0; an empty
table gives no rows; repeated rows are rows like any other; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import utf8_bytes, written

START, END = b"\xfe", b"\xff"
END_WORD = b""


def windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of every byte of every text and its end mark, as numbers, and how many each text has."""
    raw = np.frombuffer(b"".join(START * order + x + END for x in texts), np.uint8).astype(np.int64)
    lens = np.array([len(x) + 1 for x in texts], np.int64)
    code = raw[order:].copy()
    for k in range(1, order + 1):
        code |= raw[order - k : len(raw) - k] << (8 * k)
    first = np.cumsum(lens + order) - (lens + order)
    at = np.arange(int(lens.sum())) + np.repeat(first - (np.cumsum(lens) - lens), lens)
    return code[at], lens


def portions(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes; a longer text is alone."""
    begin, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield begin, i
            begin, size = i, 0
        size += len(x)
    if begin < len(texts):
        yield begin, len(texts)


def _texts(column) -> list[bytes]:
    return [(x.as_py() or "").encode("utf-8", "replace").lower() for x in column]


def _listed(order: int):
    def run(key, t):
        """A block's distinct windows and words, with counts over its training documents."""
        texts, held = _texts(t["text"]), t["held_out"].to_pylist()
        words: Counter = Counter()
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in portions(texts):
            for out in (False, True):
                some = [x for x, h in zip(texts[a:b], held[a:b], strict=True) if h == out]
                if not some:
                    continue
                if out:
                    for x in some:
                        words.update(dict.fromkeys(x.split(), 0))
                else:
                    for x in some:
                        words.update(x.split())
                u, n = np.unique(windows(some, order)[0], return_counts=True)
                keys.append(u)
                counts.append(np.zeros(len(u), np.int64) if out else n.astype(np.int64))
        words[END_WORD] += held.count(False)
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)
        blk = key[0].as_py()
        w = len(words)
        return pa.table({
            "blk": pa.array([blk] * (w + len(u)), pa.int32()),
            "word": pa.array([*words.keys(), *[None] * len(u)], pa.binary()),
            "win": pa.concat_arrays([pa.nulls(w, pa.int64()), pa.array(u)]),
            "n": pa.concat_arrays([pa.array(list(words.values()), pa.int64()), pa.array(n)]),
        })

    return run


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: the sum of ``n`` and the number of entries with ``n`` over 0 that share its key."""
    _, inverse = np.unique(key, return_inverse=True)
    return np.bincount(inverse, weights=n)[inverse], np.bincount(inverse, weights=n > 0)[inverse]


def _distinct(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, inverse = np.unique(key, return_inverse=True)
    return u, np.bincount(inverse, weights=n, minlength=len(u)), inverse


def code_lengths(win: np.ndarray, count: np.ndarray, order: int, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each window's last byte. ``win``: distinct, all with the same two bytes before their last;
    ``pairs[d, x]``: how often x followed the one byte d in the whole training text."""
    score, open_ = np.zeros(len(win)), np.ones(len(win), bool)
    gone_total, gone = np.zeros(len(win)), np.zeros(len(win))  # counts and number of the excluded bytes
    d, x = (win >> 8) & 255, win & 255
    zero = pairs.sum(axis=0)

    def code(n, total, distinct):
        nonlocal open_, score
        left, kinds = total - gone_total, distinct - gone
        den = left + kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            score += np.where(open_ & (den > 0), np.log10(np.where(n > 0, n, kinds) / den), 0)
        open_ &= n <= 0

    n = count.astype(float)
    for k in range(order, 1, -1):
        mask = (1 << (8 * k + 8)) - 1
        key, each, inverse = _distinct(win & mask, count) if k < order else (win, n, np.arange(len(win)))
        total, distinct = _sums(key >> 8, each)
        code(each[inverse], total[inverse], distinct[inverse])
        # in the next shorter context, what this one has seen is excluded
        if k > 2:
            shorter, short_n, short_at = _distinct(key & (mask >> 8), each)
            below = short_n[short_at]
        else:
            below = pairs[(key >> 8) & 255, key & 255].astype(float)
        _, ctx = np.unique(key >> 8, return_inverse=True)
        gone_total = np.bincount(ctx, weights=np.where(each > 0, below, 0))[ctx][inverse]
        gone = distinct[inverse]
    row = pairs[d]
    code(pairs[d, x].astype(float), row.sum(axis=1).astype(float), (row > 0).sum(axis=1).astype(float))
    gone_total, gone = ((row > 0) * zero).sum(axis=1).astype(float), (row > 0).sum(axis=1).astype(float)
    code(zero[x].astype(float), float(zero.sum()), float((zero > 0).sum()))
    unseen = max(1, 256 - int((zero > 0).sum()))
    return score - np.where(open_, np.log10(unseen), 0)


def _lengths(order: int, low: list[tuple[int, int]]):
    def run(key, t):
        pairs = np.zeros(65536, np.int64)
        if low:
            at, n = np.array(low, np.int64).T
            pairs[at] = n
        win = t["win"].to_numpy()
        out, step = [], win
        out = code_lengths(step, t["n"].to_numpy(), order, pairs.reshape(256, 256))
        return pa.table({"win": t["win"], "value": pa.array(out)})

    return run


def _scored(order: int, unknown: float):
    def run(key, docs, found):
        isword = found["win"].is_null().to_numpy()
        values = found["value"].to_numpy()
        words = dict(zip(found["word"].filter(pa.array(isword)).to_pylist(), values[isword].tolist(), strict=True))
        win = found["win"].filter(pa.array(~isword)).to_numpy()
        at = np.argsort(win)
        win, value = win[at], values[~isword][at]
        texts = _texts(docs["text"])
        score, base, n_tokens, n_known = [], [], [], []
        for a, b in portions(texts):
            codes, lens = windows(texts[a:b], order)
            score.append(np.add.reduceat(value[np.searchsorted(win, codes)], np.cumsum(lens) - lens))
        end = words[END_WORD]
        for x in texts:
            tokens = x.split()
            each = np.fromiter(map(words.__getitem__, tokens), float, len(tokens))
            base.append(float(each.sum()) + end)
            n_tokens.append(len(tokens) + 1)
            n_known.append(int((each > unknown + 1e-12).sum()) + (end > unknown + 1e-12))
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(np.concatenate(score) if score else np.zeros(0)),
        })

    return run


def ppm_scores(docs: DataFrame, *, order: int = 4, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Rows whose crc32 of the doc_id as text leaves 2 when divided by 7 are held out of training. ``order``: 2 to 6.
    """
    text, ident = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(utf8_bytes(text)), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.pmod(F.crc32(ident.cast("binary")), F.lit(7)) == 2).alias("held_out"), F.pmod(F.xxhash64(ident, text), F.lit(blocks)).cast("int").alias("blk")
    )
    listed = written(rows.groupBy("blk").applyInArrow(_listed(order), "blk int, word binary, win long, n long"))

    words = listed.filter("win IS NULL").groupBy("word").agg(F.sum("n").alias("c"))
    n, v = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    unknown = float(np.log10(1 / (n + v + 1)))
    wins = listed.filter("win IS NOT NULL").groupBy("win").agg(F.sum("n").alias("n"))
    # at most 65,536 rows: pairs of bytes, summed up from the blocks' own counts, so that the windows are dealt out once
    low = [tuple(r) for r in listed.filter("n > 0 AND win IS NOT NULL").groupBy(F.col("win").bitwiseAND(65535)).agg(F.sum("n")).collect()]
    lengths = wins.groupBy(F.shiftright("win", 8).bitwiseAND(65535).alias("last")).applyInArrow(_lengths(order, low), "win long, value double")
    found = (
        listed.filter("win IS NOT NULL")
        .select("blk", "win")
        .join(lengths, "win")
        .select("blk", F.lit(None).cast("binary").alias("word"), "win", "value")
        .unionByName(
            listed.filter("win IS NULL").select("blk", "word").join(words, "word").select("blk", "word", F.lit(None).cast("long").alias("win"), F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("value"))
        )
    )
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = rows.groupBy("blk").cogroup(found.groupBy("blk")).applyInArrow(_scored(order, unknown), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
