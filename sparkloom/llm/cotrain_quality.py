"""Quality classification by co-training two views of a document.

The text view sees the content: hashed words and runs of punctuation as shares of the text. The metadata view sees the
page: source, language, length, line layout and the shares of its kinds of characters, in steps. Both are logistic
regressions over their own features and over what the other view has taught them.

In each of ``rounds`` rounds every unlabelled document is scored by both views, on the executors. A view labels a
document when it is sure: its threshold for a class is where ``precision`` of the labelled documents kept aside are of
that class beyond it. A view that cannot be so sure of a class labels nothing as that class. The features of all documents
that a view labelled are counted by class and become the other view's pseudo-label evidence: two numbers a document, how
much more its features occur in documents labelled good, and labelled bad, than in all unlabelled ones. The views are
then fitted again. Afterwards each view's margin is calibrated on the documents kept aside, the two are combined there,
and all documents get scores.

A document is good when its label says quality 1 and not toxic.

The classes weigh alike in training, so a score of 0.3 is where a document is as likely good as not when good ones are
about 0.7 of all; below ``threshold`` it is rejected.

One task of an executor fits both views on at most ``labelled`` documents with labels, those with the smallest hashes of
their ids, so the sample does not depend on how the tables are laid out. All other rows are unlabelled, and all of them
are scored and counted in each round; what is gathered from them are tables of features of fixed size. The driver holds
those tables and the weights. Scoring covers every row.

Defined results: without labels of both kinds every document scores 0.5 and is kept; null or empty texts have no tokens
and are scored by what remains; a null doc_id has no label; several labels of a document count as its worst; an empty
table gives no rows; of several rows with one doc_id one is an example; repeated rows are rows like any other; very long
texts are read whole. ``score`` carries all further columns in ``row``, whatever their names.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import drop_written, written

BITS, META_BITS, CELL_BITS, SCALE = 18, 12, 16, 20.0
TOKENS = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
PUNCT = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: Features of each view, and the cells that its pseudo-label evidence is counted in.
WIDTHS, CELLS = (1 << BITS, 1 << META_BITS), (1 << CELL_BITS, 1 << META_BITS)
N_DENSE = 3  # evidence for good, evidence for bad, one


class Hashes(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = n = zlib.crc32(token) & (WIDTHS[0] - 1)
        return n


def views(text: str | None, source: str | None, lang: str | None, hashes: Hashes) -> tuple[np.ndarray, list[int]]:
    """The hashed tokens of a text in order, and its page's features, each of which counts once."""
    raw = (text or "").encode("utf-8", "replace")
    ids = np.fromiter(map(hashes.__getitem__, TOKENS.findall(raw.lower())), np.int32, -1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars, n = max(1, len(raw)), max(1, len(lines))
    log = lambda x: int(np.log2(1 + x))
    step = lambda share: int(12 * share**0.5)
    part = lambda kind: step((len(raw) - len(raw.translate(None, kind))) / chars)
    found = (
        f"source {source}", f"lang {lang}", f"size {log(len(raw))}", f"size {log(len(raw))} {lang}", f"lines {log(n)}", f"layout {log(chars / n)}",
        f"upper {part(UPPER)}", f"digits {part(DIGITS)}", f"punct {part(PUNCT)}", f"bars {part(b'|')}", f"repeated {step(1 - len(set(lines)) / n)}",
        f"same next {step(float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0)}", f"token {log(chars / max(1, len(ids)))}",
    )
    return ids, [zlib.crc32(x.encode()) & (WIDTHS[1] - 1) for x in found]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def per_row(flat: np.ndarray, ends: np.ndarray, w: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """The sum of ``w`` over each row's numbers, which count ``times`` (once); ``ends``: where rows begin and end in ``flat``."""
    total = np.concatenate(([0.0], np.cumsum(w[flat] if times is None else w[flat] * times, dtype=float)))
    return total[ends[1:]] - total[ends[:-1]]


def lengths(ends: np.ndarray, times: np.ndarray | None) -> np.ndarray:
    return np.maximum(1, np.diff(ends) if times is None else np.diff(np.concatenate(([0], np.cumsum(times, dtype=np.int64)))[ends]))


def dense(view: int, flat: np.ndarray, ends: np.ndarray, evidence: list | None, times: np.ndarray | None = None) -> np.ndarray:
    """For each row: the evidence from the other view's labels, and one."""
    n = lengths(ends, times)
    cells = flat & (CELLS[view] - 1)
    columns = [per_row(cells, ends, t, times) / n if t is not None else np.zeros(len(n)) for t in (evidence or (None, None))]
    return np.stack([*columns, np.ones(len(n))], axis=1)


def margins(view: int, flat: np.ndarray, ends: np.ndarray, model: dict, times: np.ndarray | None = None) -> np.ndarray:
    w = model["weights"][view]
    own = per_row(flat, ends, w[: WIDTHS[view]], times) * (SCALE / lengths(ends, times) if view == 0 else 1.0)
    return own + dense(view, flat, ends, model["evidence"][view], times) @ w[WIDTHS[view] :].astype(float)


class Rows:
    """Sparse rows with shared storage: product with weights, and its transpose."""

    def __init__(self, at: np.ndarray, value: np.ndarray, lens: np.ndarray, width: int):
        self.at, self.value, self.row, self.width, self.n = at, value, np.repeat(np.arange(len(lens), dtype=np.int32), lens), width, len(lens)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.at], minlength=self.n)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=self.value * e[self.row], minlength=self.width)


def fit(x: Rows, y: np.ndarray, *, l2: float = 1e-4, steps: int = 250, rate: float = 0.1) -> np.ndarray:
    """Logistic regression by Adam over all rows; classes weigh alike."""
    w, m, v = np.zeros(x.width), np.zeros(x.width), np.zeros(x.width)
    share = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    for k in range(1, steps + 1):
        g = x.back((sigmoid(x.dot(w)) - y) * share) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def calibrated(columns: list[np.ndarray], truth: np.ndarray) -> np.ndarray:
    """Weights of the columns, and the constant."""
    x = np.stack([*columns, np.ones(len(truth))], axis=1)
    return fit(Rows(np.tile(np.arange(x.shape[1]), len(x)), x.ravel(), np.full(len(x), x.shape[1]), x.shape[1]), truth, l2=1e-3, steps=400)


def sparse_rows(view: int, ids: list[np.ndarray], evidence: list | None) -> Rows:
    at, value, lens = [], [], []
    for x in ids:
        u, n = np.unique(x, return_counts=True) if view == 0 else (x, np.ones(len(x)))
        extra = dense(view, x, np.array([0, len(x)]), evidence)[0]
        at += [u.astype(np.int32), WIDTHS[view] + np.arange(N_DENSE, dtype=np.int32)]
        value += [(n * (SCALE / max(1, len(x))) if view == 0 else n).astype(np.float32), extra.astype(np.float32)]
        lens.append(len(u) + N_DENSE)
    return Rows(np.concatenate(at), np.concatenate(value), np.array(lens), WIDTHS[view] + N_DENSE)


def thresholds(p: np.ndarray, truth: np.ndarray, precision: float, least: int) -> tuple[float, float]:
    """Below the first a document is surely bad, above the second surely good, as the documents kept aside show."""

    def cut(score: np.ndarray, right: np.ndarray) -> float:
        order = np.argsort(-score, kind="stable")
        hits, n = np.cumsum(right[order]), np.arange(1, len(order) + 1)
        able = np.flatnonzero((hits / n >= precision) & (n >= least))
        return float(score[order[able[-1]]]) if len(able) else np.inf

    return -cut(-p, truth < 0.5), cut(p, truth > 0.5)


def combined(a: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """Both calibrated margins and the lesser one: a document needs both views' consent."""
    return [a, m, np.minimum(a, m)]


def learned(doc_ids: list[int], good: list[int], ids: list[list[np.ndarray]], evidence: list, precision: float) -> dict | None:
    """Weights of both views, their calibrations, their sure thresholds and their combination, from labelled documents."""
    order = sorted(range(len(doc_ids)), key=lambda i: (zlib.crc32(str(doc_ids[i]).encode()), doc_ids[i]))
    y = np.array([good[i] for i in order], float)
    aside, rest = np.arange(len(y)) % 4 == 0, np.arange(len(y)) % 4 != 0
    if len({*y}) < 2:
        return None
    if len({*y[aside]}) < 2 or len({*y[rest]}) < 2:
        aside = rest = np.ones(len(y), bool)
    truth, model, flat = y[aside], {"evidence": evidence, "weights": [], "single": [], "sure": []}, []
    for view in (0, 1):
        of = lambda mask, view=view: [ids[view][order[i]] for i in np.flatnonzero(mask)]
        model["weights"].append(fit(sparse_rows(view, of(rest), evidence[view]), y[rest]).astype(np.float32))
        held = of(aside)
        flat.append(margins(view, np.concatenate(held), np.concatenate(([0], np.cumsum([len(x) for x in held]))), model))
        model["single"].append(calibrated([flat[view]], truth))
        c, d = model["single"][view]
        flat[view] = c * flat[view] + d
        model["sure"].append(thresholds(sigmoid(flat[view]), truth, precision, max(5, len(truth) // 100)))
    model["both"] = calibrated(combined(*flat), truth)
    final = np.stack([*combined(*flat), np.ones(len(truth))], axis=1) @ model["both"]
    model["right"] = [float(((x > 0) == (truth > 0.5)).mean()) for x in (*flat, final)]  # of text, metadata and both, on those kept aside
    return model


def _learner(evidence: list, precision: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, good, ids = [], [], [[], []]
        for b in batches:
            docs += b.column(0).to_pylist()
            good += b.column(1).to_pylist()
            for view in (0, 1):
                ids[view] += [x.values.to_numpy(zero_copy_only=False).astype(np.int32) for x in b.column(2 + view)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learned(docs, good, ids, evidence, precision) if docs else None)], pa.binary())], names=["model"])

    return run


FEATURES = "doc_id long, good int, ids array<int>, meta array<int>"


def _featured(texts, sources, langs, hashes: Hashes) -> list[tuple[np.ndarray, np.ndarray]]:
    """For either view: the numbers of all rows, and where rows begin and end."""
    found = [views(t.as_py(), s.as_py(), g.as_py(), hashes) for t, s, g in zip(texts, sources, langs, strict=True)]
    out = []
    for view in (0, 1):
        flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x[view], np.int32) for x in found)])
        out.append((flat, np.concatenate(([0], np.cumsum([len(x[view]) for x in found]))).astype(np.int32)))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            x = b.slice(at, 1000)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)) for flat, ends in _featured(x.column(2), x.column(3), x.column(4), hashes)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *lists], names=["doc_id", "good", "ids", "meta"])


PACKED = "steps array<int>, times array<int>, meta array<int>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of unlabelled rows in little space: a text's distinct tokens as steps from the one before, in order of
    their numbers, with how often each occurs; tokens are counted, never needed in order."""
    hashes = Hashes()
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            x = b.slice(at, 1000)
            (ids, ends), (meta, meta_ends) = _featured(x.column(2), x.column(3), x.column(4), hashes)
            steps, times, cuts = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [0]
            for a, e in zip(ends[:-1], ends[1:], strict=True):
                u, n = np.unique(ids[a:e], return_counts=True)
                steps.append(np.diff(u, prepend=0).astype(np.int32))
                times.append(n.astype(np.int32))
                cuts.append(cuts[-1] + len(u))
            lists = [pa.ListArray.from_arrays(pa.array(np.array(o, np.int32)), pa.array(v)) for o, v in ((cuts, np.concatenate(steps)), (cuts, np.concatenate(times)), (meta_ends, meta))]
            yield pa.RecordBatch.from_arrays(lists, names=["steps", "times", "meta"])


def _unpacked_ids(steps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Token numbers from the steps between them, row by row."""
    total = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))
    return (total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))).astype(np.int64)


def _columns(docs: DataFrame) -> list:
    text = lambda c: (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c)
    return [F.col("doc_id").cast("long").alias("doc_id"), text("text"), text("source"), text("lang")]


def _one_each(rows: DataFrame) -> DataFrame:
    """One row per doc_id, the same for any layout of the table."""
    return rows.groupBy("doc_id", "good").agg(F.min(F.struct("text", "source", "lang")).alias("x")).select("doc_id", "good", "x.text", "x.source", "x.lang")


def _counted(model: dict):
    """Counts the features of the documents that each view is sure of, for the other one: view, kind (0: labelled good,
    1: labelled bad, 2: all), cell, n. Cell -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros((3, CELLS[v] + 1), np.int64) for v in (0, 1)]
        for b in batches:
            if not b.num_rows:
                continue
            flats = [b.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(3)]
            ends = [b.column(k).offsets.to_numpy() for k in (0, 2)]
            ends = [e - e[0] for e in ends]
            held = [(_unpacked_ids(flats[0], ends[0]), ends[0], flats[1]), (flats[2], ends[1], None)]
            p = []
            for view, (flat, ends, times) in enumerate(held):
                c, d = model["single"][view]
                p.append(sigmoid(c * margins(view, flat, ends, model, times) + d))
            for view, (flat, ends, times) in enumerate(held):
                low, high = model["sure"][1 - view]
                kinds = (p[1 - view] >= high, p[1 - view] <= low, np.ones(b.num_rows, bool))
                lens = np.diff(ends)
                for k, mask in enumerate(kinds):
                    chosen = np.repeat(mask, lens)
                    n[view][k, :-1] += np.bincount(flat[chosen] & (CELLS[view] - 1), None if times is None else times[chosen], CELLS[view]).astype(np.int64)
                    n[view][k, -1] += mask.sum()
        for view in (0, 1):
            kind, cell = np.nonzero(n[view])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(kind), view, np.int32)), pa.array(kind.astype(np.int32)), pa.array(np.where(cell == CELLS[view], -1, cell).astype(np.int32)), pa.array(n[view][kind, cell])], names=["view", "kind", "cell", "n"]
            )

    return run


def _evidence(counts: pa.Table, least: int = 20) -> tuple[list, list[list[int]]]:
    """For each view the tables of log odds against all unlabelled documents, of good and of bad, and the documents that
    the other view has labelled as such, with the number of all. At most 3 * (2 ** 16 + 2 ** 12) rows come here."""
    view, kind, cell, n = (counts[c].to_numpy() for c in ("view", "kind", "cell", "n"))
    tables, docs = [], []
    for v in (0, 1):
        whole = np.zeros((3, CELLS[v] + 1))
        here = view == v
        whole[kind[here], cell[here]] = n[here]  # cell -1 is the last
        share = lambda k, whole=whole, v=v: (whole[k, :-1] + 1) / (whole[k, :-1].sum() + CELLS[v])
        docs.append([int(x) for x in whole[:, -1]])
        tables.append([np.clip(np.log(share(k) / share(2)), -3, 3).astype(np.float32) if whole[k, -1] >= least else None for k in (0, 1)])
    return tables, docs


def train(docs: DataFrame, labels: DataFrame, *, labelled: int = 6000, rounds: int = 3, precision: float = 0.95) -> dict | None:
    """The model. ``exchanged``: for each round and view, how many documents the other view labelled good and bad, of how many."""
    rows = docs.select(*_columns(docs))
    by = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = by.agg(F.min(F.when((F.col("quality") >= 1) & (F.coalesce("toxic", F.lit(0)) < 1), 1).otherwise(0)).alias("good"))
    sample = written(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    known = written(_one_each(rows.join(F.broadcast(sample), "doc_id").select("doc_id", "good", "text", "source", "lang")).mapInArrow(_features, FEATURES))

    def fitted(evidence: list) -> dict | None:
        # at most ``labelled`` rows: one task fits
        return pickle.loads(known.repartition(1).mapInArrow(_learner(evidence, precision), "model binary").first()["model"])

    evidence, exchanged = [None, None], []
    model = fitted(evidence)
    if model and rounds:
        others = rows.join(F.broadcast(sample), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("good"), "text", "source", "lang")
        unlabelled = written(others.mapInArrow(_packed, PACKED))
        for _ in range(rounds):
            counts = unlabelled.mapInArrow(_counted(model), "view int, kind int, cell int, n long").groupBy("view", "kind", "cell").agg(F.sum("n").alias("n"))
            evidence, docs_ = _evidence(counts.toArrow())
            exchanged.append(docs_)
            model = fitted(evidence)
        drop_written(unlabelled)
    drop_written(known)
    drop_written(sample)
    return model and model | {"exchanged": exchanged}


def _scored(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                x = b.slice(at, 1000)
                if model is None:
                    p = [np.full(x.num_rows, 0.5)] * 3
                else:
                    each = []
                    for view, (flat, ends) in enumerate(_featured(x.column(1), x.column(2), x.column(3), hashes)):
                        c, d = model["single"][view]
                        each.append(c * margins(view, flat, ends, model) + d)
                    final = np.stack([*combined(*each), np.ones(x.num_rows)], axis=1) @ model["both"]
                    p = [sigmoid(y) for y in (*each, final)]
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(4), *map(pa.array, p)], names=["doc_id", "row", "p_text", "p_meta", "quality"])

    return run


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, carry: bool = False, **options) -> DataFrame:
    """doc_id, p_text, p_meta, quality, keep for every row of ``docs`` (doc_id, text, source, lang); ``carry`` adds the
    whole row as the struct ``row``."""
    model = train(docs, labels, **options)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(*_columns(docs), whole.alias("row"))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["row"], *(T.StructField(c, T.DoubleType()) for c in ("p_text", "p_meta", "quality"))])
    scored = rows.mapInArrow(_scored(model), schema).withColumn("keep", F.col("quality") >= threshold)
    return scored if carry else scored.drop("row")
