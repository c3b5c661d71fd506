"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Three patterns give the base spans (``assign``, ``access``, ``hex``). The method adds spans of kind ``markov``: runs of
at least ``min_chars`` token characters whose log-likelihood ratio between a model of random strings and a model of
ordinary identifiers exceeds ``threshold`` nats. Both are first-order chains over the token characters, trained from
labelled samples: ordinary identifiers are the runs of at least ``IDENTIFIER`` token characters outside the base spans
of all documents, but for those that a first table takes for random, for which all text outside the spans is ordinary
(unnamed secrets are runs, too, and would teach what they should be told from); random strings are the values of the base spans and strings drawn evenly from the common alphabets of
keys (hexadecimal, base 32, 36, 62 and 64, of 20 to 64 characters, with a fixed seed). What is gathered is one table of
character pairs per model, whatever the size of the corpus. A run that touches a base span is not reported again.
``held_out`` measures a table: the share of strings of other seeds that it finds, and of ordinary runs of documents that
it was not trained on which it reports.

Defined results: a null or empty text has no spans; positions count code points, ends are exclusive; an empty table
gives no rows; repeated rows are rows like any other; further columns are ignored.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "markov")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

TOKEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Token characters are 1 to 67, everything else is 0.
CLASS = bytes(TOKEN.find(b) + 1 if bytes([b]) in TOKEN else 0 for b in range(256))
SPACED = bytes(b if bytes([b]) in TOKEN else 0x20 for b in range(256))
N = len(TOKEN) + 1
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Token characters of the shortest run that teaches what ordinary identifiers look like.
IDENTIFIER = 8
LONG = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % IDENTIFIER)

ALPHABETS = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", TOKEN[:62].decode(), TOKEN[:64].decode(), TOKEN[:62].decode() + "-_"]


def base_spans(text: str, raw: bytes, longest: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans. ``longest``: the longest run of token characters, which bounds the hex runs."""
    out = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if longest >= LEAST["hex"]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


def longest_run(raw: bytes) -> int:
    return max(map(len, raw.translate(SPACED).split()), default=0)


def pairs(raw: bytes) -> np.ndarray:
    """How often each class of characters follows each other one."""
    c = np.frombuffer(raw.translate(CLASS), np.uint8).astype(np.int32)
    return np.bincount(c[:-1] * N + c[1:], minlength=N * N) if len(c) > 1 else np.zeros(N * N, np.int64)


def generated(count: int = 3000, seed: int = 5) -> bytes:
    rng = random.Random(seed)
    return b" " + b" ".join("".join(rng.choices(ALPHABETS[k % len(ALPHABETS)], k=rng.randint(20, 64))).encode() for k in range(count)) + b" "


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where any of the spans (sorted by start) lies, as disjoint ranges."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def samples(text: str, first: np.ndarray | None = None, threshold: float = 12.0) -> tuple[np.ndarray, np.ndarray]:
    """Pair counts of what is ordinary outside the text's base spans, and of the values inside them.

    Ordinary is everything, or with a ``first`` table the identifiers that it does not take for random."""
    raw = text.encode("utf-8", "replace")
    values, rest, last = [], [], 0
    for a, b in merged(base_spans(text, raw, longest_run(raw))):
        found = RUN.findall(text[a:b])
        values += found[-1:]
        rest.append(text[last:a])
        last = b
    if last:
        rest.append(text[last:])
        raw = " ".join(rest).encode("utf-8", "replace")
    if first is not None:
        raw = b" ".join(x for x in LONG.findall(raw) if len(x) < 16 or ratio(first, x) <= threshold)
    return pairs(b" " + raw + b" "), pairs(" ".join(["", *values, ""]).encode() if values else b"")


def _gathered(first: np.ndarray | None, threshold: float):
    """Pair counts of what is ordinary (0) and of base values (1), one table each for the whole partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N * N), np.int64)
        for b in batches:
            for x in b.column(0):
                if text := x.as_py():
                    ordinary, values = samples(text, first, threshold)
                    total[0] += ordinary
                    total[1] += values
        model, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(model, pa.int32()), pa.array(pair, pa.int32()), pa.array(total[model, pair], pa.int64())], names=["model", "pair", "n"])

    return run


def ratio_table(ordinary: np.ndarray, values: np.ndarray, weight: float = 10.0) -> np.ndarray:
    """log P(next | this) under random strings less that under ordinary text, for token characters after any class.

    Each row is smoothed towards the frequencies of the single characters, which count as ``weight`` observations."""

    def chain(n: np.ndarray) -> np.ndarray:
        n = n.reshape(N, N)[:, 1:].astype(float)
        single = n.sum(axis=0) + 0.5
        return np.log((n + weight * single / single.sum()) / (n.sum(axis=1, keepdims=True) + weight))

    out = np.zeros((N, N))
    out[:, 1:] = chain(values + pairs(generated())) - chain(ordinary)
    return out


def train(docs: DataFrame, threshold: float = 12.0) -> np.ndarray:
    """The table of log-likelihood ratios from all of ``docs`` (text), in two passes. At most 2 * 68 * 68 rows reach the
    driver in each."""
    rows, table = docs.select(F.col("text").cast("string").alias("text")), None
    for _ in range(2):
        total = np.zeros((2, N * N), np.int64)
        found = rows.mapInArrow(_gathered(table, threshold), "model int, pair int, n long").groupBy("model", "pair").agg(F.sum("n").alias("n"))
        for r in found.collect():
            total[r["model"], r["pair"]] = r["n"]
        table = ratio_table(total[0], total[1])
    return table


def ratio(table: np.ndarray, run: str | bytes) -> float:
    raw = run if isinstance(run, bytes) else run.encode()
    c = np.frombuffer((b" " + raw).translate(CLASS), np.uint8)
    return float(table[c[:-1], c[1:]].sum())


def scan(text: str | None, table: np.ndarray, min_chars: int, threshold: float) -> list[tuple[int, int, int]]:
    """All spans as (start, kind, end), sorted."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    longest = longest_run(raw)
    spans = base_spans(text, raw, longest)
    if longest >= min_chars:
        taken = merged(spans)
        starts, found = [a for a, _ in taken], []
        for m in RUN.finditer(text):
            if m.end() - m.start() >= min_chars and ratio(table, m[0]) > threshold:
                before = bisect_left(starts, m.end()) - 1  # the last taken range that begins before the run ends
                if before < 0 or taken[before][1] <= m.start():
                    found.append((m.start(), 3, m.end()))
        spans += found
    return sorted(spans)


def _scanned(table: np.ndarray, min_chars: int, threshold: float):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in scan(x.as_py(), table, min_chars, threshold)] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, *, table: np.ndarray | None = None, min_chars: int = 16, threshold: float = 12.0) -> DataFrame:
    """doc_id, spans (kind, start, end) for every row of ``docs`` (doc_id, text); trains on ``docs`` unless a table is given."""
    table = train(docs) if table is None else table
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanned(table, min_chars, threshold), "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def _reported(table: np.ndarray, min_chars: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = found = 0
        for b in batches:
            for x in b.column(0):
                if text := x.as_py():
                    raw = text.encode("utf-8", "replace")
                    spans = merged(base_spans(text, raw, longest_run(raw)))
                    own = [m for m in RUN.finditer(text) if m.end() - m.start() >= min_chars and not any(a < m.end() and m.start() < e for a, e in spans)]
                    runs += len(own)
                    found += sum(ratio(table, m[0]) > threshold for m in own)
        yield pa.RecordBatch.from_arrays([pa.array([runs], pa.int64()), pa.array([found], pa.int64())], names=["runs", "found"])

    return run


def held_out(docs: DataFrame, *, min_chars: int = 16, threshold: float = 12.0, seed: int = 77) -> dict[str, float]:
    """recall, false_rate, runs: a table is trained on four fifths of ``docs`` (doc_id, text) and held against strings of
    ``seed`` and the ordinary runs of the last fifth."""
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    table = train(docs.filter(~fold))
    secrets = generated(2000, seed).decode().split()
    rest = docs.filter(fold).select(F.col("text").cast("string").alias("text")).mapInArrow(_reported(table, min_chars, threshold), "runs long, found long")
    runs, found = rest.agg(F.coalesce(F.sum("runs"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()
    return {"recall": sum(ratio(table, x) > threshold for x in secrets) / len(secrets), "false_rate": found / max(1, runs), "runs": runs}
