"""The queries op1 to op13 over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table, utf8_bytes


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparkloom.llm.token_count import token_counts

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.cotrain_quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.ppm_score import ppm_scores

    return ppm_scores(table(spark, sf_dir, "documents"))


def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.chat_format import expand, read_back

    own = spark.sql("SELECT -7L AS conv_id, x.turn, x.role, '</s>[INST] ok [/INST]' AS text FROM (SELECT explode(array(struct(0L AS turn, 'user' AS role), struct(1L AS turn, 'assistant' AS role))) AS x)")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    back = read_back(expand(rows))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.omh_dedup import near_dup_classes

    return near_dup_classes(table(spark, sf_dir, "documents"))


def op6_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.trie_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"), keep="largest")


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.shard_pack import pack

    packed = pack(table(spark, sf_dir, "documents"), n_shards=24)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.markov_secrets import KINDS, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.pfair_mix import mix

    # sources weigh by the square root of their bytes, and blocks are cut by bytes
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", utf8_bytes(F.col("text")).alias("n_bytes"))
    return mix(docs, mass="n_bytes").select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.col("row.n_bytes").alias("n_bytes"), "source_block", "release", "deadline", "slot", "source_row", F.col("starts").cast("long").alias("starts"))


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.fm_decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.expr("aggregate(sequence(1, greatest(size(spans), 1)), 0L, (t, i) -> t + if(i > size(spans), 0, if(i % 2 = 0, spans[i - 1], -spans[i - 1])))")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.merkle_manifest import manifest

    text = F.col("text").cast("string")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered=F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparkloom.llm.piece_codec import encode

    read = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), back=True)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_cotrained_quality": op2_cotrained_quality,
        "op3_ppm_scores": op3_ppm_scores,
        "op4_prefix_targets": op4_prefix_targets,
        "op5_order_minhash": op5_order_minhash,
        "op6_trie_dedup": op6_trie_dedup,
        "op7_vector_packing": op7_vector_packing,
        "op8_markov_secrets": op8_markov_secrets,
        "op9_pfair_mix": op9_pfair_mix,
        "op10_fm_decontamination": op10_fm_decontamination,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_piece_codec": op12_piece_codec,
        "op13_spelling_variants": op13_spelling_variants,
    }


def _crc32(text: str) -> str:
    """Unsigned crc32 of a string below U+0800 in DuckDB's SQL; ``crc`` is the one-row table of ``_CRC``."""
    encoded = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {encoded}), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"


_CRC = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"


def _leaf(text: str) -> str:
    coded = (f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))
    return f"sha256({' || '.join(coded)})"


def oracle_sql() -> dict[str, str]:
    return {
        "op4_prefix_targets": """
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
                 e AS (SELECT *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length(role) + 13 AS size FROM c),
                 w AS (SELECT *, sum(size) OVER o AS upto, row_number() OVER o = count(*) OVER (PARTITION BY conv_id) AS final
                       FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   CAST(sum(upto) FILTER (role = 'assistant' OR final) AS BIGINT) AS formatted_chars
            FROM w GROUP BY conv_id""",
        "op6_trie_dedup": f"""
            WITH d AS (SELECT doc_id, sha256({_FOLD}) AS text_sha256 FROM documents),
                 g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
        "op10_fm_decontamination": rf"""
            WITH dw AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
                 bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
                 win AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + least(10, len(w))], ' ') AS p, least(10, len(w)) AS n
                         FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)),
                 sizes AS (SELECT DISTINCT n FROM win),
                 pos AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS p
                         FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
                 hit AS (SELECT doc_id, i, n, item_id FROM pos JOIN win USING (p, n)),
                 cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
                 its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                   sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
        "op11_merkle_manifest": f"""
            WITH RECURSIVE {_CRC},
                 d AS (SELECT row_number() OVER () AS rid, doc_id, source, {_leaf("text")} AS leaf,
                              CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS other FROM documents, crc),
                 t AS (SELECT source, n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT source, count(*) AS n FROM d GROUP BY 1)),
                 l AS (SELECT d.*, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
                 up AS (SELECT tree, 0 AS level, idx, leaf AS digest, n FROM l
                        UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, level, idx // 3, n),
                 sub AS (SELECT tree, digest AS subroot FROM up WHERE n = 1),
                 above AS (SELECT -1 AS tree, 0 AS level, tree AS idx, subroot AS digest, count(*) OVER () AS n FROM sub
                           UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM above WHERE n > 1 GROUP BY tree, level, idx // 3, n),
                 every AS (SELECT * FROM up UNION ALL SELECT * FROM above),
                 steps AS (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
                           FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY 1, 2, 3),
                 low AS (SELECT rid, tree, 0 AS level, idx, coalesce(other, leaf) AS value, '' AS proof FROM l
                         UNION ALL SELECT f.rid, f.tree, f.level + 1, f.idx // 3, sha256(s.l || f.value || s.r), f.proof || s.l || s.r FROM low f JOIN steps s ON f.tree = s.tree AND f.level = s.level AND f.idx = s.idx),
                 high AS (SELECT rid, 0 AS level, tree AS idx, value, proof FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level DESC) AS k FROM low) WHERE k = 1
                          UNION ALL SELECT f.rid, f.level + 1, f.idx // 3, sha256(s.l || f.value || s.r), f.proof || s.l || s.r FROM high f JOIN steps s ON s.tree = -1 AND f.level = s.level AND f.idx = s.idx),
                 done AS (SELECT rid, arg_max(value, level) AS folded_root, arg_max(proof, level) AS proof FROM high GROUP BY 1)
            SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
            FROM l JOIN sub USING (tree) JOIN done USING (rid), (SELECT digest AS root FROM above WHERE n = 1)""",
        "op13_spelling_variants": f"""
            WITH RECURSIVE {_CRC},
                 w AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
                 g AS (SELECT run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM w GROUP BY doc_id, run),
                 h AS (SELECT run, n, {_crc32("k")} AS h FROM g, crc),
                 c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
                 del AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM c)),
                 near AS (SELECT a.word, b.word AS other FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                          UNION SELECT word, rest FROM del SEMI JOIN c ON del.rest = c.word
                          UNION SELECT rest, word FROM del SEMI JOIN c ON del.rest = c.word),
                 best AS (SELECT near.word, count(*) AS n_near, arg_min(struct_pack(w := other, n := n), (-n, other)) AS best FROM near JOIN c ON c.word = near.other GROUP BY 1),
                 f AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * c.n THEN best.w END AS form, CASE WHEN best.n >= 2 * c.n THEN best.n END AS form_n FROM c LEFT JOIN best USING (word)),
                 chain AS (SELECT word, word AS tip, 0 AS step FROM f UNION ALL SELECT chain.word, form, step + 1 FROM chain JOIN f ON chain.tip = f.word WHERE form IS NOT NULL)
            SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(tip, step) AS root FROM chain GROUP BY 1) USING (word)""",
    }
