"""Token counts with overlap resynchronisation.

Texts up to ``chunk_chars`` are encoded whole. Longer ones are encoded as chunks that overlap their successor, with
offsets; two neighbours are spliced at a boundary that both have inside the overlap.

Why such a boundary is right: BPE merges never cross a pretoken, and the pretokenizer scans from left to right with
nothing but its position as state. A chunk that has a right pretoken start at p therefore agrees with the whole text
from p on, until its own end comes into view. The pattern looks at most three characters past a pretoken's start or
one past its end, and an added token is seen whole if it ends inside the chunk; so the left chunk's boundaries up to
``margin`` characters before its end are those of the whole text once its first one is. The right chunk starts
anywhere, but it scans on alike from any position where it has a pretoken start that the left chunk proves. A splice
at a common boundary that is ``margin`` away from the left chunk's end is thus proven; where there is none (one
pretoken covers the overlap) the overlap is doubled, until it swallows the right chunk if need be.

Boundaries and counts are those of the tokenizer's own encoding (offsets, word numbers). Tests compare them with the
encoding of the whole text, also for texts far longer than a chunk.

Defined results: a null text is empty; empty texts have no tokens; an empty table gives no rows; repeated rows are
rows like any other; further columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

class Counter:
    """Counts tokens of whole texts as the library gives them, holding one chunk's encoding at a time."""

    def __init__(self, path: str, chunk_chars: int = 16_384, overlap: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.chunk, self.overlap = Tokenizer.from_file(path), chunk_chars, overlap
        added = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.margin = max([4, *(len(x) + 1 for x in added)])
        self.widened = 0

    def bounds(self, text: str) -> tuple[list[int], list[int]]:
        """Pretoken starts and ends of a chunk (0 to its length), and the tokens before each of them."""
        e = self.tok.encode(text, add_special_tokens=False)
        at, before, last, end = [0], [0], None, 0
        for i, (word, (a, b)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            key = word if word is not None else ("added", i)
            if i and (key != last or word is None) and a == end:
                at.append(a)
                before.append(i)
            last, end = key, b
        at.append(len(text))
        before.append(len(e.ids))
        return at, before

    def small(self, text: str) -> int:
        return len(self.tok.encode_batch_fast([text], add_special_tokens=False)[0])

    def long(self, text: str) -> int:
        """``begin``: where the left chunk begins; ``start``: its first proven boundary, from which its tokens count."""
        size, total, begin, start = len(text), 0, 0, 0
        end = min(size, self.chunk + self.overlap)
        at, before = self.bounds(text[:end])
        upto = lambda p: next(n for q, n in zip(at, before, strict=True) if q + begin >= p)
        while end < size:
            right, wide = end - self.overlap, self.overlap
            following = min(size, right + self.chunk + self.overlap)
            nxt = self.bounds(text[right:following])
            while True:
                last = min(end, following) - self.margin
                known = {p + right for p in nxt[0]}
                cut = next((p + begin for p in at if max(right, start) <= p + begin <= last and p + begin in known), None)
                if cut is not None or end == size:
                    break
                self.widened += 1
                wide *= 2
                end = min(size, end + wide)
                at, before = self.bounds(text[begin:end])
                if end + self.margin > following:
                    following = min(size, end + self.chunk)
                    nxt = self.bounds(text[right:following])
            if cut is None:
                break
            total += upto(cut) - upto(start)
            begin, start, end, (at, before) = right, cut, following, nxt
        return total + before[-1] - upto(start)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return self.small(text) if len(text) <= self.chunk else self.long(text)


def _counted(path: str, chunk_chars: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, chunk_chars, overlap)
        for b in batches:
            counts = [counter.count(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, *, chunk_chars: int = 16_384, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of ``docs`` (doc_id, text). ``tokenizer``: the file, at the same place on every machine."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(_counted(tokenizer, chunk_chars, overlap), "doc_id long, n_bytes long, n_tokens long")
