"""SQL functions, and stages that chain frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import config as C

Stage = Callable[[DataFrame], DataFrame]
_WORKER: dict[str, Callable[[list[str]], list]] = {}


@F.udtf(returnType=T.StructType([T.StructField("chunk_no", T.IntegerType()), T.StructField("text", T.StringType())]))
class ChunkText:
    """Paragraph-packed chunks of a text as a table function: chunk_text(text, size, overlap)."""

    def eval(self, text: str, size: int, overlap: int):
        paras = [p for p in ("\n".join(x.strip() for x in (text or "").split("\n"))).strip().split("\n\n") if p.strip()]
        done, held = [], ""
        for p in (p.strip() for p in paras):
            joined = f"{held}\n\n{p}" if held else p
            if len(joined) <= size:
                held = joined
                continue
            done += [held] * bool(held)
            held = p if len(p) <= size else ""
            if not held:
                done += [p[a : a + size] for a in range(0, max(1, len(p) - overlap), size - overlap)]
        for i, x in enumerate(done + [held] * bool(held)):
            yield i, x


def embedder(load: Callable[[], Callable[[list[str]], list]], name: str = "embed"):
    """A pandas UDF from texts to vectors. ``load`` makes the model, once a worker; where it fails, vectors are null and
    the dense channel takes no part."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _WORKER:
            try:
                _WORKER[name] = load()
            except ImportError:
                _WORKER[name] = lambda texts: [None] * len(texts)
        for texts in batches:
            yield pd.Series(_WORKER[name](texts.fillna("").tolist()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.FloatType()))


def register(spark: SparkSession, embed: Callable[[], Callable[[list[str]], list]] | None = None) -> None:
    """Makes the functions known to SQL: tokenize, squeeze, text_windows, policy_flags and doc_structure have SQL bodies, so
    they are optimised like any expression; chunk_text is a table function, image_features and embed read Arrow batches."""
    from sparkloom.operators.images import image_features

    quoted = lambda x: "r'" + x.replace("'", "\\'") + "'"
    make = lambda head, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    make("tokenize(t STRING) RETURNS ARRAY<STRING>", "filter(regexp_extract_all(lower(t), '[a-z0-9_]+', 0), x -> length(x) >= 3)")
    make("squeeze(t STRING) RETURNS STRING", r"regexp_replace(regexp_replace(t, r'\s+', ' '), '^ | $', '')")
    make("text_windows(t STRING, size INT, step INT) RETURNS ARRAY<STRING>", "transform(sequence(0, if(length(t) <= size, 0, cast(ceil((length(t) - size) / step) AS int))), i -> substring(t, i * step + 1, size))")
    flags = [f"if(regexp_like(t, {quoted(p)}), 'pii_detected:{k}', NULL)" for k, p in (("email", C.EMAIL), ("phone", C.PHONE))] + [f"if(contains(lower(t), '{w}'), 'disallowed_term:{w}', NULL)" for w in C.DISALLOWED_TERMS]
    make("policy_flags(t STRING) RETURNS ARRAY<STRING>", f"array_compact(array({', '.join(flags)}))")
    n = {k: f"regexp_count(t, {quoted(p)})" for k, p in C.STRUCTURE.items()}
    fields = {"parts": n["parts"], "procedure_steps": n["steps"], "topics": f"greatest({n['topics']} - {n['steps']}, 0)", "tables_rendered": n["dividers"], "table_rows": f"greatest({n['rows']} - 2 * {n['dividers']}, 0)", "figures_embedded": n["images"]}
    make(f"doc_structure(t STRING) RETURNS STRUCT<{', '.join(f'{k}: INT' for k in fields)}>", f"named_struct({', '.join(f'{k!r}, {v}' for k, v in fields.items())})")
    spark.udtf.register("chunk_text", ChunkText)
    spark.udf.register("image_features", image_features)
    if embed is not None:
        spark.udf.register("embed", embedder(embed))


def chain(df: DataFrame, *stages: Stage) -> DataFrame:
    for s in stages:
        df = df.transform(s)
    return df
