"""SentencePiece encoding and decoding with a table of distinct chunks.

A text is normalised as the model does (a marker in front, markers for spaces) and cut where no piece can reach across:
before each run of markers, and around control characters that are in no piece with others. Merges of one chunk then
never see another one, so the ids of a text are those of its chunks, in order. Chunks are counted over all texts, each
distinct one is segmented once, by the library, and the ids are joined back by position.

The table goes to the tasks as a broadcast of at most ``table_bytes`` of chunks and ids. From the counts, summed by
powers of two, comes the least count that fits this bound; chunks below it, and chunks of more than ``chunk_chars``
characters, are segmented where they occur, by the same library and with the same result. No text is shuffled.

That pieces cannot cross is proven from the vocabulary when the model is loaded: markers stand only at the start of
pieces, some control character is in no longer piece, texts are not otherwise normalised, and there are no user-defined
symbols. A model for which this does not hold
has whole texts as its chunks. Decoding takes all ids of a text at once, by the library.

Defined results: a null text is empty; the empty text has no ids; repeated rows are rows like any other; an empty table
gives no rows; further columns are ignored. A text without markers is one chunk, so a task holds one such text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_written, written

MARK = "▁"


class Pieces:
    """The model with what is known about its pieces: ``chunks`` cuts a text, ``segment`` encodes one chunk."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.sp = SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = [p.piece for p in proto.pieces if p.type == kinds.NORMAL]
        n, t = proto.normalizer_spec, proto.trainer_spec
        as_is = n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not n.precompiled_charsmap and not proto.denormalizer_spec.precompiled_charsmap
        others = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)
        bpe = t.model_type == sentencepiece_model_pb2.TrainerSpec.BPE and t.byte_fallback
        shared = {c for p in plain if len(p) > 1 for c in p}
        self.cuts = "".join(chr(c) for c in range(32) if chr(c) not in shared)
        self.separable = bool(bpe and as_is and not others and not t.treat_whitespace_as_suffix and self.cuts and not any(MARK in p.lstrip(MARK) for p in plain))
        cuts = re.escape(self.cuts)
        self.pattern = re.compile(f"[{cuts}]+|{MARK}*[^{MARK}{cuts}]+|{MARK}+") if self.separable else None
        self.before = len(self.sp.encode(self.cuts[0])) if self.separable else 0

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return self.pattern.findall(MARK + text.replace(" ", MARK)) if self.separable else [MARK + text]

    def segment(self, chunk: str) -> bytes:
        """The ids of a chunk as 32-bit integers. The library puts the first marker in front itself, but for the empty
        text; other chunks follow a control character, whose ids are known and merge with nothing."""
        ids = self.sp.encode(chunk[1:]) if chunk[0] == MARK and (chunk != MARK or not self.separable) else self.sp.encode(self.cuts[0] + chunk)[self.before :]
        return np.array(ids, "<i4").tobytes()


class _Found(dict):
    """Ids of chunks: from the table, or segmented now and kept while there are not too many."""

    def __init__(self, pieces: Pieces, known: dict[str, bytes], most: int = 100_000):
        self.pieces, self.known, self.most = pieces, known, most

    def __missing__(self, chunk: str) -> bytes:
        ids = self.known.get(chunk)
        if ids is None:
            ids = self.pieces.segment(chunk)
            if len(chunk) <= 64:
                if len(self) >= self.most:
                    self.clear()
                self[chunk] = ids
        return ids


def _counted(model: str, chunk_chars: int, most: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, counts = Pieces(model), Counter()

        def out() -> pa.RecordBatch:
            rows = [(c, n) for c, n in counts.items() if len(c) <= chunk_chars]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["chunk", "n"])

        for b in batches:
            for x in b.column(0):
                counts.update(pieces.chunks(x.as_py() or ""))
                if len(counts) > most:
                    yield out()
        yield out()

    return run


def _segmented(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.segment(c) for c in b.column(0).to_pylist()], pa.binary())], names=["chunk", "ids"])

    return run


def chunk_counts(docs: DataFrame, model: str, *, chunk_chars: int = 64) -> DataFrame:
    """chunk, n of all distinct chunks of up to ``chunk_chars`` characters."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_counted(model, chunk_chars), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def chunk_table(docs: DataFrame, model: str, *, table_bytes: int = 8 << 20, chunk_chars: int = 64) -> DataFrame:
    """chunk, ids (32-bit integers as bytes) of the distinct chunks that occur most, ``table_bytes`` of them at most."""
    counted = written(chunk_counts(docs, model, chunk_chars=chunk_chars))
    # a piece has one character at least, or is a byte: four bytes of ids for each byte of the chunk
    sizes = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.sum(5 * F.octet_length("chunk")).alias("size")).collect()
    least, left = 63, table_bytes
    for r in sorted(sizes, key=lambda r: -r["power"]):
        left -= r["size"]
        if left < 0:
            break
        least = r["power"]
    chosen = written(counted.filter(F.floor(F.log2("n")) >= least).select("chunk").mapInArrow(_segmented(model), "chunk string, ids binary"))
    drop_written(counted)
    return chosen


def _encoded(model: str, known, back: bool, most: int = 1 << 20):
    """Ids of texts, and with ``back`` the text that they decode to, in batches of some ``most`` bytes of ids."""
    names = ["doc_id", "ids", "text"] if back else ["doc_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        found = _Found(pieces, known.value)

        def out(doc_ids: pa.Array, parts: list[bytes]) -> pa.RecordBatch:
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            texts = [pa.array([pieces.sp.decode(np.frombuffer(p, "<i4").tolist()) if p else "" for p in parts], pa.string())] if back else []
            return pa.RecordBatch.from_arrays([doc_ids, ids, *texts], names=names)

        for b in batches:
            first, parts, n = 0, [], 0
            for x in b.column(1):
                parts.append(b"".join(map(found.__getitem__, pieces.chunks(x.as_py() or ""))))
                n += len(parts[-1])
                if n > most:
                    yield out(b.column(0).slice(first, len(parts)), parts)
                    first, parts, n = first + len(parts), [], 0
            if parts:
                yield out(b.column(0).slice(first, len(parts)), parts)

    return run


def _decoded(model: str, most: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Pieces(model).sp
        for b in batches:
            first, texts, n = 0, [], 0
            for i, x in enumerate(b.column(1), 1):
                texts.append(sp.decode(x.as_py()) if x.is_valid and len(x) else "")
                n += len(texts[-1])
                if n > most or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                    first, texts, n = i, [], 0

    return run


def encode(docs: DataFrame, model: str, *, back: bool = False, table_bytes: int = 8 << 20, chunk_chars: int = 64) -> DataFrame:
    """doc_id, ids of each row of ``docs`` (doc_id, text). With ``back`` also ``text``, decoded from all ids of the row.

    ``model``: the file, at the same place on every machine."""
    table = chunk_table(docs, model, table_bytes=table_bytes, chunk_chars=chunk_chars)
    known = docs.sparkSession.sparkContext.broadcast({r["chunk"]: bytes(r["ids"]) for r in table.toLocalIterator()})
    drop_written(table)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(model, known, back), "doc_id long, ids array<int>" + (", text string" if back else ""))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text of (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model), "doc_id long, ids array<int>, text string")
