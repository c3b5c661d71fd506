"""Benchmark decontamination with one FM-index per shard of the training text.

Test phrases are the windows of consecutive words of the benchmark items. Each task gathers the words of its documents
into shards of bounded size. Words are mapped to the test phrases' own alphabet; all others become a break that no
phrase contains, and runs shorter than the shortest phrase are left out, so the index holds every place where a phrase
can occur. Over that string the shard builds a suffix array, its Burrows-Wheeler transform as a wavelet matrix and a
sample of suffix positions. All phrases are searched backward together through the wavelet ranks; the occurrences walk
to a sampled position; their word spans are merged per document.

The test phrases travel with the task. Their size is measured first; beyond ``item_bytes`` they are dealt into blocks
of that size, and the documents pass through one block after the other, merging spans as they go: each block is a job of
its own whose rows are a written table, so neither the driver nor a task ever holds more than one block.

Defined results: a null or empty text has no words and no hits; an item without words (null, empty, punctuation only)
has no window and never occurs; an item with fewer words than the window is one window; a null item_id counts as the
empty id; repeated items count once; an empty benchmark hits nothing; an empty table gives no rows; repeated rows are
rows like any other; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import WORD_BYTES, ascii_words, drop_written, written


class Wavelet:
    """Wavelet matrix over small integers: symbol and rank queries for whole arrays of positions."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.n, self.levels, self.ones, self.zeros = len(seq), levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        lo, hi = np.zeros_like(upto), upto
        for k in range(self.levels):
            bit, one = (symbol >> (self.levels - 1 - k)) & 1 == 1, self.ones[k]
            a, b = one[lo], one[hi]
            lo, hi = np.where(bit, self.zeros[k] + a, lo - a), np.where(bit, self.zeros[k] + b, hi - b)
        return hi - lo

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.levels):
            one = self.ones[k]
            a = one[at]
            bit = one[at + 1] - a
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + a, at - a)
        return out


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """By prefix doubling; ``rank`` orders the single symbols."""
    n, k = len(rank), 1
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, dtype=np.int64)
        if k < n:
            second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, k = new, k * 2


class FMIndex:
    """Over runs of positive symbols that a 0 ends each. Searches never leave a run."""

    def __init__(self, text: np.ndarray, levels: int, sample: int = 8):
        n = len(text)
        breaks = text == 0
        # breaks sort below all symbols, by position: no suffix comparison goes past one
        order = suffix_array(np.where(breaks, np.cumsum(breaks) - 1 - int(breaks.sum()), text))
        bwt = text[order - 1]
        self.wavelet = Wavelet(bwt.astype(np.int32), levels)
        counts = np.bincount(text, minlength=1 << levels)
        self.first = np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int32)
        inside = np.arange(n) - np.maximum.accumulate(np.where(np.concatenate(([True], breaks[:-1])), np.arange(n), 0))
        marked = (inside % sample == 0)[order]
        self.marks = np.concatenate(([0], np.cumsum(marked))).astype(np.int32)
        self.places, self.n = order[marked].astype(np.int32), n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each row of ``phrases``; empty ones have equal ends."""
        lo, hi = np.zeros(len(phrases), np.int32), np.full(len(phrases), self.n, np.int32)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes. Run starts are sampled, so the walk stays inside its run."""
        rows, out, steps = rows.astype(np.int32), np.zeros(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            found = self.marks[at + 1] > self.marks[at]
            out[live[found]] = self.places[self.marks[at[found]]] + steps
            live, at = live[~found], at[~found]
            c = self.wavelet.symbol(at)
            rows[live] = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The distinct windows of a block of items, by length, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        held: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = ascii_words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                held.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for x in held for w in x}))}
        self.levels = max(1, len(self.ids).bit_length())
        self.shortest = min(map(len, held), default=0)
        by: dict[int, list] = {}
        for words, who in sorted(held.items()):
            by.setdefault(len(words), []).append((words, tuple(sorted(who))))
        self.by_length = {n: (np.array([[self.ids[w] for w in words] for words, _ in x], np.int32), [who for _, who in x]) for n, x in by.items()}


def hits(texts: list[bytes], phrases: Phrases, sample: int = 8) -> tuple[np.ndarray, list[tuple[list[int], set[str]] | None]]:
    """Words of each text, and for those with hits the merged word spans (flat) and the items that occur."""
    found: list[tuple[list[int], set[str]] | None] = [None] * len(texts)
    parts, sizes = [], np.zeros(len(texts), np.int64)
    get = phrases.ids.get
    for i, x in enumerate(texts):
        words = x.lower().translate(WORD_BYTES).split()
        sizes[i] = len(words)
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    if not phrases.shortest or not texts:
        return sizes, found
    ids = np.concatenate(parts)
    known = np.concatenate(([False], ids > 0, [False]))
    edge = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return sizes, found
    lens = ends - starts + 1  # with the break that follows
    places = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens - starts, lens)
    index = FMIndex(ids[places], phrases.levels, sample)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    for n, (rows, who) in phrases.by_length.items():
        lo, hi = index.search(rows)
        some = np.flatnonzero(hi > lo)
        at = 0
        while at < len(some):  # a bounded number of occurrences at a time
            upto = at + max(1, int(np.searchsorted(np.cumsum((hi - lo)[some[at:]].astype(np.int64)), 2_000_000, side="right")))
            part = some[at:upto]
            n_each = (hi - lo)[part].astype(np.int64)
            row = np.arange(int(n_each.sum())) - np.repeat(np.cumsum(n_each) - n_each - lo[part], n_each)
            spot = places[index.locate(row)]
            doc = np.searchsorted(begins, spot, side="right") - 1
            for d, p, w in zip(doc.tolist(), (spot - begins[doc]).tolist(), np.repeat(part, n_each).tolist(), strict=True):
                if found[d] is None:
                    found[d] = ([], set())
                found[d][0].extend((p, p + n))
                found[d][1].update(who[w])
            at = upto
    return sizes, [x and (merged(x[0]), x[1]) for x in found]


def merged(flat: list[int]) -> list[int]:
    """Flat list of spans, sorted and with overlapping or touching ones joined."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


FOUND = "n_words long, spans array<int>, items array<string>"


def _searched(items: list[tuple[str, str | None]], window: int, shard_bytes: int, sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, window)
        rows, size, kind = [], 0, None

        def out():
            sizes, found = hits([(r[1] or "").encode("utf-8", "replace") for r in rows], phrases, sample)
            spans = [merged([*(r[3] or ()), *x[0]]) if x else list(r[3] or ()) for r, x in zip(rows, found, strict=True)]
            names = [sorted({*(r[4] or ()), *x[1]}) if x else list(r[4] or ()) for r, x in zip(rows, found, strict=True)]
            own = [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.string()), (5, kind))]
            batch = pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "text", "row", "n_words", "spans", "items"])
            rows.clear()
            return batch

        for b in batches:
            kind = b.schema.field("row").type
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "n_words", "spans", "items", "row")), strict=True):
                rows.append(r)
                size += len(rows[-1][1] or "")
                if size >= shard_bytes:
                    yield out()
                    size = 0
        if rows:
            yield out()

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shard_bytes: int = 12 << 20, item_bytes: int = 4 << 20, sample: int = 8, carry: bool = False) -> DataFrame:
    """doc_id, text, n_words, spans (merged word spans, flat), items (ids that occur) for every row of ``docs``;
    ``carry`` adds the whole row but for its text as the struct ``row``."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / item_bytes))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole.alias("row"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() AS array<int>)").alias("spans"), F.expr("cast(array() AS array<string>)").alias("items")
    )
    for k in range(blocks):
        block = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        schema = T.StructType([*(rows.schema[c] for c in ("doc_id", "text", "row")), *T.StructType.fromDDL(FOUND).fields])
        before, rows = rows, rows.mapInArrow(_searched(sorted(block), window, shard_bytes, sample), schema)
        if k + 1 < blocks:
            rows = written(rows)
            if k:
                drop_written(before)
    return rows if carry else rows.drop("row")


def without_spans(text: str, spans: list[int]) -> str:
    """The text with the characters of the word spans taken out, up to the word that follows each."""
    if not spans:
        return text
    raw = text.encode("utf-8", "replace")
    kept = raw.lower().translate(WORD_BYTES)
    at, words = 0, []
    for w in kept.split():
        at = kept.index(w, at)
        words.append(at)
        at += len(w)
    words.append(len(raw))
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[last : words[a]])
        last = words[b]
    return (b"".join(out) + raw[last:]).decode("utf-8", "replace")
