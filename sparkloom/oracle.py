"""The queries in DuckDB's SQL, written from their definitions."""

from __future__ import annotations

from sparkloom import config as C
from sparkloom import queries as Q
from sparkloom.streaming import jobs

_TOKENS = "list_filter(regexp_extract_all(lower({t}), '[a-z0-9_]+'), lambda x: length(x) >= 3)"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _packed(text: str, size: int = 900, step: int = 720) -> str:
    """List of paragraph-packed chunks: a fold over the paragraphs."""
    windows = f"list_transform(range(CAST(1 + ceil((length(q.o) - {size}) / {step}.0) AS BIGINT)), lambda i: substr(q.o, CAST(i * {step} + 1 AS BIGINT), {size}))"
    lines = f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x: {_STRIP.format(x='x')}), chr(10))"
    paras = f"list_filter(list_transform(string_split_regex({_STRIP.format(x=lines)}, '\\n{{2,}}'), lambda x: {_STRIP.format(x='x')}), lambda x: x <> '')"
    flushed, joined = "CASE WHEN s.o = '' THEN s.d ELSE list_append(s.d, s.o) END", "CASE WHEN s.o = '' THEN q.o ELSE s.o || chr(10) || chr(10) || q.o END"
    none = "{'d': CAST([] AS VARCHAR[]), 'o': ''}"
    folded = f"""list_reduce(list_transform({paras}, lambda x: {{'d': CAST([] AS VARCHAR[]), 'o': x}}), lambda s, q: CASE WHEN length(q.o) > {size} THEN {{'d': list_concat({flushed}, {windows}), 'o': ''}}
        WHEN length({joined}) <= {size} THEN {{'d': s.d, 'o': {joined}}} ELSE {{'d': {flushed}, 'o': q.o}} END, {none})"""
    return f"list_transform([{folded}], lambda f: CASE WHEN f.o = '' THEN f.d ELSE list_append(f.d, f.o) END)[1]"


_CHUNKS = f"""packs AS (SELECT doc_id, {_packed('text')} AS c FROM documents WHERE text IS NOT NULL),
    chunks AS (SELECT doc_id, CAST(i AS INT) AS chunk_no, c[i + 1] AS text FROM (SELECT doc_id, c, unnest(range(len(c))) AS i FROM packs))"""


def _lex(source: str, prefix: str = "") -> str:
    """Token lists, postings, sizes and document frequencies of a relation of chunks."""
    return f"""{prefix}tok AS (SELECT doc_id, chunk_no, {_TOKENS.format(t="text")} AS t FROM {source}),
    {prefix}n AS (SELECT count(*) AS n, avg(len(t)) AS al FROM {prefix}tok),
    {prefix}post AS (SELECT doc_id, chunk_no, len, term, count(*) AS tf FROM (SELECT doc_id, chunk_no, len(t) AS len, unnest(t) AS term FROM {prefix}tok) GROUP BY ALL),
    {prefix}df AS (SELECT term, count(*) AS df FROM {prefix}post GROUP BY 1)"""


def _bm25(queries: str, k: int = 10) -> str:
    """Scores and the k best of each query; needs the relations of _lex."""
    return f"""q AS (SELECT DISTINCT qid, unnest({_TOKENS.format(t="query")}) AS term FROM ({queries})),
    sc AS (SELECT qid, doc_id, chunk_no, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))) AS score
           FROM post JOIN df USING (term) JOIN q USING (term), n GROUP BY ALL),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, chunk_no) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


def _legacy(queries: str, k: int = 10) -> str:
    return f"""lq AS (SELECT DISTINCT qid, unnest({_TOKENS.format(t="query")}) AS term FROM ({queries})),
    ll AS (SELECT doc_id, chunk_no, len(list_distinct(t)) AS len FROM tok),
    ls AS (SELECT qid, p.doc_id, p.chunk_no, sum(ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) / any_value(ll.len) AS score
           FROM post p JOIN ll ON p.doc_id = ll.doc_id AND p.chunk_no = ll.chunk_no JOIN df USING (term) JOIN lq USING (term), n GROUP BY ALL),
    ltop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, chunk_no) AS rank FROM ls WHERE score > 0) WHERE rank <= {k})"""


_BENCH_Q = "SELECT item_id AS qid, text AS query FROM benchmark"
_KNOWN = """usable AS (SELECT term, df FROM df, n WHERE df >= 2 AND df <= greatest(2, floor(n * 0.25))),
    ranked AS (SELECT doc_id, chunk_no, term, row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY df, term) AS pos FROM post JOIN usable USING (term)),
    known AS (SELECT doc_id, chunk_no, string_agg(term, ' ' ORDER BY pos) AS query FROM ranked WHERE pos <= 4 GROUP BY ALL HAVING count(*) >= 4)"""
_BENCH_CHUNKS = "bc AS (SELECT item_id AS doc_id, 0 AS chunk_no, text FROM benchmark)"


def _metrics(top: str, label: str = "") -> str:
    return f"""SELECT {label} count(*) AS n_queries, round(coalesce(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 0), 6) AS recall_at_1,
        round(coalesce(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 0), 6) AS recall_at_5, round(coalesce(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 0), 6) AS recall_at_10,
        round(coalesce(avg(coalesce(1.0 / rank, 0)), 0), 6) AS mrr, round(coalesce(avg(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END), 0), 6) AS ndcg_at_10
        FROM known k LEFT JOIN {top} t ON t.qid = k.doc_id AND t.doc_id = k.doc_id"""


_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_RRF = f"""ch AS (SELECT q.vec_id AS channel, e.vec_id AS doc_id, {_DOT} AS score FROM embeddings e JOIN embeddings q ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
    rk AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(score, 9) DESC, doc_id) AS r FROM ch WHERE score > 0),
    fused AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) * 61 / (SELECT count(DISTINCT channel) FROM rk) AS score FROM rk GROUP BY 1)"""


def _mmr(source: str, k: int = 8, lam: float = 0.82) -> str:
    """The relation mmr (qid, rank, doc_id, chunk_no, score, text): k rounds over each query's candidates (``source``: qid,
    doc_id, chunk_no, score, text). A round takes the best value and compares all rows with what it took."""
    rounds = ["r0 AS (SELECT qid, pos, score, tok, 0.0::DOUBLE AS worst, false AS taken FROM able)"]
    for i in range(1, k + 1):
        rounds.append(f"""p{i} AS MATERIALIZED (SELECT qid, arg_min(pos, (worst * {1 - lam!r}::DOUBLE - score * {lam}::DOUBLE, pos)) AS pos FROM r{i - 1} WHERE NOT taken GROUP BY 1),
        r{i} AS MATERIALIZED (SELECT r.qid, r.pos, r.score, r.tok, taken OR coalesce(r.pos = l.pos, false) AS taken, greatest(worst, CASE WHEN taken OR l.pos IS NULL OR len(r.tok) = 0 OR len(l.tok) = 0 THEN 0.0::DOUBLE
            ELSE list_transform([len(list_intersect(r.tok, l.tok))], lambda n: n / (len(r.tok) + len(l.tok) - n)::DOUBLE)[1] END) AS worst
            FROM r{i - 1} r LEFT JOIN (SELECT able.qid, able.pos, able.tok FROM able JOIN p{i} USING (qid, pos)) l USING (qid))""")
    return f"""cand AS (SELECT qid, doc_id, chunk_no, score, text, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_no) AS pos FROM {source}),
    lim AS (SELECT qid, min(score) AS kth FROM cand WHERE pos <= {k} GROUP BY 1),
    able AS MATERIALIZED (SELECT c.*, list_transform(list_distinct({_TOKENS.format(t="text")}), lambda x: hash(x)) AS tok FROM cand c JOIN lim USING (qid) WHERE score >= kth - {(1 - lam) / lam!r}::DOUBLE),
    {", ".join(rounds)},
    mmr AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY able.score DESC, doc_id, chunk_no) AS rank, doc_id, chunk_no, able.score AS score, text FROM able JOIN (SELECT qid, pos FROM r{k} WHERE taken) USING (qid, pos))"""


_CASES = rf"""conv AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS said, string_split(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), ''), ' ') AS w FROM conversations GROUP BY 1),
    cases AS (SELECT conv_id, w AS inc, ['Slide', 'ing'] AS exc, CASE WHEN conv_id % 4 = 0 THEN ['the'] ELSE [] END AS sec, {Q.CASE_FIELDS} FROM conv),
    scored AS (SELECT *, round(CASE WHEN len(inc) > 0 THEN len(list_filter(inc, lambda x: contains(lower(output), lower(x)))) / len(inc)::DOUBLE ELSE 1.0 END, 6) AS must_include_coverage,
        len(list_filter(exc, lambda x: regexp_matches(output, '(^|[^\w-])' || x || '($|[^\w-])', 'i'))) = 0 AS forbidden_term_clean,
        (NOT requires_ordered_steps OR regexp_matches(output, '(?im)^\s*(?:\d+[.)]|step\s+\d+)')) AND (NOT requires_table OR regexp_matches(output, '(?m)^\s*\|.*\|\s*$')) AND len(list_filter(sec, lambda x: NOT contains(lower(output), lower(x)))) = 0 AS structure_compliant,
        len(regexp_extract_all(output, '\S+')) AS word_count FROM cases),
    full_ AS (SELECT *, (max_words IS NULL OR word_count <= max_words) AND (min_words IS NULL OR word_count >= min_words) AS length_compliant,
        CASE WHEN expects_refusal THEN regexp_matches(lower(output), 'not contain|no financial information|does not include|not available in the source|cannot be determined|not stated in the source') END AS refusal_correct FROM scored),
    summary AS (SELECT count(*) AS total_cases, count(*) FILTER (ok) AS passed_cases, count(*) FILTER (ok AND gated) AS gated_cases, count(*) FILTER (ok AND NOT gated) AS advisory_cases,
        round_even(count(*) FILTER (ok) / count(*)::DOUBLE, 3) AS pass_rate, round_even(avg(must_include_coverage) FILTER (ok AND gated), 3) AS avg_must_include_coverage, round_even(min(must_include_coverage) FILTER (ok AND gated), 3) AS min_case_must_include_coverage,
        round_even(avg(CASE WHEN forbidden_term_clean THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) FILTER (ok AND gated), 3) AS forbidden_term_rate, round_even(avg(structure_compliant::INT) FILTER (ok AND gated), 3) AS structure_compliance_rate,
        round_even(avg(length_compliant::INT) FILTER (ok AND gated), 3) AS length_compliance_rate, round_even(coalesce(avg(refusal_correct::INT) FILTER (ok AND gated), 1), 3) AS refusal_accuracy,
        round_even(avg(latency_ms) FILTER (ok), 3) AS avg_latency_ms, list_sort(list(latency_ms) FILTER (ok))[greatest(floor(count(*) FILTER (ok) * 0.95::DOUBLE)::INT, 1)]::DOUBLE AS p95_latency_ms, round_even(avg(word_count) FILTER (ok), 3) AS avg_word_count FROM full_),
    long_ AS (SELECT unnest(['pass_rate', 'avg_must_include_coverage', 'min_case_must_include_coverage', 'forbidden_term_rate', 'structure_compliance_rate', 'length_compliance_rate', 'refusal_accuracy', 'p95_latency_ms']) AS metric,
        unnest([pass_rate, avg_must_include_coverage, min_case_must_include_coverage, forbidden_term_rate, structure_compliance_rate, length_compliance_rate, refusal_accuracy, p95_latency_ms]) AS value FROM summary)"""

_RUNS = f"""runs AS (SELECT event_id AS seq, ts AS recorded_at, event_type <> 'error' AS succeeded, event_type = 'click' AS used_fallback, user_id % 5 AS topics, user_id % 2 AS llm_topics, value AS total_latency_ms,
    list_sum(list_transform(json_keys(props), lambda k: CAST(json_extract(props, '$.' || k) AS BIGINT))) AS leaks, event_id % 9 <> 0 AS content_integrity_pass, event_id % 13 AS slides_ingested, event_type AS route, 'm' || (user_id % 3) AS mode,
    {Q._run_fields()} FROM events)"""
_MEANS = [(f"{g}_{n}", f) for g, fields in C.KPI_MEANS.items() for n, f in fields.items()]
_SORTED = "list_sort(list(total_latency_ms) FILTER (succeeded))"
_SNAPSHOT = f"""snap AS (SELECT count(*) AS runs_observed, round_even(avg(succeeded::INT), 4) AS availability_success_rate, round_even(avg(used_fallback::INT), 4) AS availability_fallback_rate, round_even(avg((topics > 0 AND llm_topics = 0)::INT), 4) AS availability_degraded_generation_rate,
    count(*) FILTER (succeeded) AS availability_documents_delivered, round_even(max(total_latency_ms) FILTER (succeeded), 2) AS latency_ms_max, CAST(sum(slides_ingested) AS BIGINT) AS throughput_total_slides_ingested,
    {", ".join(f"round_even(avg({f}) FILTER (succeeded), 4) AS {n}" for n, f in _MEANS)}, CAST(sum(leaks) AS BIGINT) AS content_integrity_total_leaks_detected, round_even(avg(content_integrity_pass::INT), 4) AS content_integrity_clean_document_rate,
    {", ".join(f"round_even({_SORTED}[CAST(round_even({f}::DOUBLE * (count(*) FILTER (succeeded) - 1), 0) AS INT) + 1], 2) AS latency_ms_{k}" for k, f in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))} FROM runs)"""
_SNAPSHOT_NAMES = ["runs_observed", "availability_success_rate", "availability_fallback_rate", "availability_degraded_generation_rate", "availability_documents_delivered", "latency_ms_max", "throughput_total_slides_ingested", *(n for n, _ in _MEANS), "content_integrity_total_leaks_detected", "content_integrity_clean_document_rate", "latency_ms_p50", "latency_ms_p95", "latency_ms_p99"]

_SQUEEZE = r"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_LINES = "lines AS (SELECT doc_id, pos, list_extract(l, pos) AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
_MARKDOWN = rf"""md AS (SELECT conv_id, '# Notes' || chr(10) || string_agg(line, chr(10) ORDER BY turn, line) AS text FROM (SELECT conv_id, turn, CASE role
    WHEN 'system' THEN '## Part 1: ' || {_SQUEEZE.format(x="substr(text, 1, 60)")} || chr(10) || text
    WHEN 'user' THEN (CASE WHEN turn % 3 = 0 THEN '### Step 1: ' ELSE '### ' END) || {_SQUEEZE.format(x="substr(text, 1, 60)")} || chr(10) || text || E'\n| a | b |\n| --- | --- |\n| 1 | 2 |\n[[IMAGE: slide 4]]'
    ELSE text END AS line FROM conversations) GROUP BY 1)"""
_CHATTER = C.CHATTER.replace("(?i:\\blooping\\s+in\\b)", "\\b[Ll][Oo][Oo][Pp][Ii][Nn][Gg]\\s+[Ii][Nn]\\b")


def _n(p: str, t: str = "text") -> str:
    return f"len(regexp_extract_all({t}, '{p}'))"


_SLIDES = "slides AS (SELECT conv_id AS deck, turn AS slide_no, CASE WHEN role = 'user' THEN substr(string_split(text, ' ')[1], 1, 4) END AS title, string_split(text, chr(10)) AS lines FROM conversations)"


def _hits(words: tuple[str, ...], expr: str) -> str:
    return "(" + " + ".join(expr.format(w=w) for w in words) + ")"


def _best_part(parts: dict[str, tuple[str, ...]], name: str) -> str:
    """The part of the most occurrences in the column t, the first of equals, or the default."""
    scores = ", ".join(_hits(w, "CAST((length(t) - length(replace(t, '{w}', ''))) / length('{w}') AS INT)") for w in parts.values())
    names = ", ".join(f"'{p}'" for p in parts)
    return f"list_transform([[{scores}]], lambda s: CASE WHEN list_max(s) > 0 THEN [{names}][list_position(s, list_max(s))] ELSE '{C.DEFAULT_PART}' END)[1] AS {name}"


_CONTAINS = "CAST(contains(lower(text), '{w}') AS INT)"
_SECTION_ROWS = " UNION ALL ".join(f"SELECT '{s}' AS section, doc_id, chunk_no, {_hits(w, _CONTAINS)} AS hits FROM chunks" for s, w in (C.SECTIONS | Q.LOCAL_SECTIONS).items())

_NOISE = "(?i)" + "|".join(f"(?:{p})" for p in C.NOISE_LINES)
_NAMES = f"list_filter(regexp_extract_all(s, '{C.PERSON}'), lambda n: NOT list_has_any(string_split_regex(lower(n), '\\s+'), [{', '.join(repr(w) for w in C.NON_NAME_WORDS)}]))"
_NOISE_FLAG = f"""s = '' OR regexp_matches(s, '{_NOISE}') OR roles >= 2 OR (roles >= 1 AND len(names) >= 2) OR (len(names) >= 3 AND {_n(',', 's')} >= 2 AND coalesce(list_sum(list_transform(names, lambda n: length(n))), 0) >= length(s) * 0.5)
            OR (length(s) <= 240 AND regexp_matches(s, '{_CHATTER}')) OR length(s) <= 2 OR {_n(chr(92) + '?', 's')} >= 2 OR (len({_TOKENS.format(t='s')}) = 0 AND NOT regexp_matches(s, '\\d'))"""


def _clipped(x: str, most: int, trailing: str, mark: str) -> str:
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE regexp_replace(regexp_replace(substr({x}, 1, {most}), ' [^ ]*$', ''), '[{trailing}]+$', '') || '{mark}' END"


def _title(x: str) -> str:
    """A slide's title as the list's one element."""
    whole = _SQUEEZE.format(x=f"coalesce({x}, '')")
    last = _STRIP.format(x=r"regexp_replace(w, '(?i)^.*\btopic\s*:', '')")
    named = f"list_transform([{whole}], lambda w: list_transform([{last}], lambda l: CASE WHEN length(l) >= 4 THEN l ELSE w END)[1])"
    bare = f"list_transform({named}, lambda y: regexp_replace(y, '^[ \\-–—:|]+|[ \\-–—:|]+$', '', 'g'))"
    return f"list_transform({bare}, lambda z: {_clipped('z', 100, ' ,;:' + chr(92) + '-–—', '…')})[1]"


_FRAGMENT_TAGS = "x"
for _tag in C.SENTENCE_TAGS:
    _FRAGMENT_TAGS = f"regexp_replace({_FRAGMENT_TAGS}, '{_tag}', '', 'g')"
_CLEAN = rf"regexp_replace(regexp_replace({_FRAGMENT_TAGS}, '\s+', ' ', 'g'), '^[ \-:]+|[ \-:]+$', '', 'g')"
_SPOKEN = " OR ".join(f"contains(' ' || lower(x) || ' ', '{m}')" for m in C.CONVERSATIONAL) + f" OR regexp_matches(' ' || lower(x) || ' ', '{C.LETTER_DAYS}') OR regexp_matches(x, '{C.NAME_LIST}')"
_FRAGMENTS = rf"""fr AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01\n*|\n+|\s+[|]\s+|;\s+'), lambda x: {_CLEAN}), lambda x: length(x) BETWEEN 35 AND 280 AND NOT ends_with(x, '?')
        AND NOT starts_with(lower(x), 'author | department') AND NOT contains(lower(x), ' x days') AND NOT contains(lower(x), 'lead time: x') AND NOT ({_SPOKEN})) AS f FROM documents WHERE text IS NOT NULL),
    fk AS (SELECT doc_id, f, list_transform(f, lambda x: trim(regexp_replace(lower(x), '[^\pL\pN_]+', ' ', 'g'))) AS k FROM fr),
    fg AS (SELECT doc_id, f, list_filter(f, lambda x, i: list_position(k, k[i]) = i) AS g FROM fk)"""


def _table(names: str, rows) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names}))"


_TRIAGE = f"""img AS (SELECT {Q.IMAGE_FIELDS} FROM events), tri AS (SELECT *, CASE WHEN width <= 0 OR height <= 0 THEN 'undecodable' WHEN least(width, height) < 100 OR width * height < 20000 THEN 'icon' WHEN greatest(width, height) / least(width, height)::DOUBLE > 6 THEN 'banner'
    WHEN skin >= 0.1::DOUBLE AND variety >= 8 AND width / height::DOUBLE BETWEEN 0.5 AND 1.8 AND detail < 0.05::DOUBLE THEN 'portrait' WHEN (colors <= 24 OR transparency >= 0.35::DOUBLE) AND detail < 0.045::DOUBLE THEN 'decorative' WHEN detail >= 0.05::DOUBLE THEN 'diagram' ELSE 'photo' END AS category FROM img)"""

SQL: dict[str, str] = {
    "noise_filter": f"""WITH {_LINES}, a AS (SELECT doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM lines),
        b AS (SELECT *, {_n(C.ROLE_TAG_ANY_CASE, 's')} AS roles, {_NAMES} AS names FROM a), c AS (SELECT doc_id, {_NOISE_FLAG} AS noise FROM b)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (noise) AS n_noise FROM c GROUP BY 1""",
    "postprocess_lines": f"""WITH {_LINES}, s AS (SELECT doc_id, pos, {_SQUEEZE.format(x='line')} AS line FROM lines),
        k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN line[1] IN ('|', '#') OR starts_with(line, '[[IMAGE:') THEN 'structured' WHEN regexp_matches(line, '{C.LEFTOVER_LINES}') OR regexp_matches(line, '{_CHATTER}') OR regexp_matches(line, '{C.SPELLED_DAYS}')
            OR {_n(chr(92) + '?', 'line')} >= 2 OR regexp_matches(line, '{C.NAME_LIST}') THEN 'dropped' ELSE 'plain' END AS kind FROM s),
        u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, lower(line) ORDER BY pos) AS nth FROM k WHERE kind <> 'dropped' QUALIFY kind <> 'plain' OR nth = 1 OR length(line) >= 140),
        w AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS was FROM u),
        j AS (SELECT doc_id, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kind <> 'blank' OR (was IS NOT NULL AND was <> 'blank')), ''), '\\n+$', '') AS t FROM w GROUP BY 1)
        SELECT doc_id, CAST(length(coalesce(t, '')) AS INT) AS n_chars, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN j USING (doc_id) WHERE text IS NOT NULL""",
    "topic_merge": f"""WITH {_SLIDES}, n AS (SELECT deck, slide_no, lines, nullif({_title('title')}, '') AS own FROM slides),
        c AS (SELECT deck, slide_no, lines, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY deck ORDER BY slide_no ROWS UNBOUNDED PRECEDING), 'Overview') AS title FROM n),
        g AS (SELECT deck, lower(title) AS key, min(slide_no) AS first, arg_min(title, slide_no) AS title, flatten(list(lines ORDER BY slide_no)) AS l FROM c GROUP BY ALL),
        f AS (SELECT deck, first, title, list_filter(l, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '') AS l FROM g),
        d AS (SELECT deck, first, title, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i) AS l FROM f)
        SELECT deck, CAST(row_number() OVER (PARTITION BY deck ORDER BY first) AS INT) AS topic_no, title, CAST(len(l) AS INT) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM d WHERE len(l) > 0""",
    "tokenize_stats": f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct FROM (SELECT doc_id, {_TOKENS.format(t='text')} AS t FROM documents)",
    "chunk_windows": f"WITH {_CHUNKS} SELECT doc_id, chunk_no, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM chunks",
    "line_dedup": f"""WITH {_LINES}, s AS (SELECT doc_id, pos, {_SQUEEZE.format(x='line')} AS line FROM lines),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) AS nth FROM s WHERE line <> '')
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (nth = 1) AS kept_lines, md5(string_agg(line, chr(10) ORDER BY pos) FILTER (nth = 1)) AS digest FROM r GROUP BY 1""",
    "cache_keys": "SELECT doc_id, sha256(coalesce(source, '') || chr(0) || coalesce(text, '')) AS key FROM documents",
    "bm25_idf": f"WITH {_CHUNKS}, {_lex('chunks')} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, n",
    "bm25_topk": f"WITH {_CHUNKS}, {_lex('chunks')}, {_bm25(_BENCH_Q)} SELECT qid, CAST(rank AS INT) AS rank, doc_id, chunk_no, round(score, 6) AS score FROM top",
    "legacy_ranker_topk": f"""WITH {_CHUNKS}, {_lex('chunks')}, {_legacy(_BENCH_Q)}, every AS (SELECT q.qid, c.doc_id, c.chunk_no, coalesce(ls.score, 0.0::DOUBLE) AS score FROM (SELECT DISTINCT item_id AS qid FROM benchmark) q CROSS JOIN chunks c LEFT JOIN ls ON ls.qid = q.qid AND ls.doc_id = c.doc_id AND ls.chunk_no = c.chunk_no)
        SELECT qid, CAST(rank AS INT) AS rank, doc_id, chunk_no, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, chunk_no) AS rank FROM every) WHERE rank <= 10""",
    "dense_topk": f"""WITH {_RRF}, r AS (SELECT channel AS q_id, doc_id AS vec_id, score, row_number() OVER (PARTITION BY channel ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ch)
        SELECT q_id, CAST(rank AS INT) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "rrf_fusion": f"WITH {_RRF} SELECT doc_id, round(score, 9) AS score FROM fused",
    "hint_boost": f"WITH {_RRF} SELECT doc_id, round(least(1.0, score + 0.05 * (contains(lower(text), 'the')::INT + contains(lower(text), 'thand')::INT + contains(lower(text), 'ing')::INT)), 6) AS score FROM fused JOIN documents USING (doc_id)",
    "context_budget": f"""WITH {_CHUNKS}, {_lex('chunks')}, {_bm25(_BENCH_Q)}, b AS (SELECT qid, rank, doc_id, chunk_no, length(text) AS len, coalesce(sum(length(text)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM top JOIN chunks USING (doc_id, chunk_no))
        SELECT qid, CAST(rank AS INT) AS rank, doc_id, chunk_no, CAST(least(len, 4000 - prev) AS INT) AS n_chars FROM b WHERE prev < 4000""",
    "known_item_queries": f"WITH {_CHUNKS}, {_lex('chunks')}, {_KNOWN} SELECT doc_id, chunk_no, query FROM known",
    "ir_metrics": f"WITH {_BENCH_CHUNKS}, {_lex('bc')}, {_KNOWN}, {_bm25('SELECT doc_id AS qid, query FROM known')} {_metrics('top')}",
    "ranker_comparison": f"WITH {_BENCH_CHUNKS}, {_lex('bc')}, {_KNOWN}, {_bm25('SELECT doc_id AS qid, query FROM known')}, {_legacy('SELECT doc_id AS qid, query FROM known')} {_metrics('top', chr(39) + 'bm25' + chr(39) + ' AS ranker,')} UNION ALL {_metrics('ltop', chr(39) + 'legacy' + chr(39) + ' AS ranker,')}",
    "chunk_ranker_comparison": f"WITH {_CHUNKS}, bc AS (SELECT doc_id * 1048576 + chunk_no AS doc_id, 0 AS chunk_no, text FROM chunks), {_lex('bc')}, {_KNOWN}, {_bm25('SELECT doc_id AS qid, query FROM known')}, {_legacy('SELECT doc_id AS qid, query FROM known')} {_metrics('top', chr(39) + 'bm25' + chr(39) + ' AS ranker,')} UNION ALL {_metrics('ltop', chr(39) + 'legacy' + chr(39) + ' AS ranker,')}",
    "golden_score": f"WITH {_CASES} SELECT case_id, must_include_coverage, forbidden_term_clean, structure_compliant, length_compliant, refusal_correct, CAST(word_count AS INT) AS word_count FROM full_",
    "eval_summary": f"WITH {_CASES} SELECT * FROM summary",
    "gate_checks": f"""WITH {_CASES}, g AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{b}', {v}::DOUBLE)" for m, (b, v) in C.GATES.items())}) AS g(metric, bound, lim))
        SELECT metric, bound, lim AS "limit", value AS actual, CASE WHEN value IS NULL THEN 'skipped' WHEN bound = 'min' AND value < lim OR bound = 'max' AND value > lim THEN 'fail' ELSE 'pass' END AS status FROM g LEFT JOIN long_ USING (metric)""",
    "baseline_diff": f"""WITH {_CASES}, t AS (SELECT * FROM (VALUES ('avg_must_include_coverage', false, 0.03::DOUBLE, 1.0::DOUBLE), ('structure_compliance_rate', false, 0.05, 0.7), ('length_compliance_rate', false, 0.05, NULL), ('p95_latency_ms', true, 0.25, 150.0)) AS t(metric, rel, tol, was)),
        b AS (SELECT metric, rel, tol, coalesce(was, value) AS baseline, value AS "current" FROM t JOIN long_ USING (metric)),
        m AS (SELECT *, CASE WHEN rel THEN ("current" - baseline) / baseline ELSE "current" - baseline END AS mv FROM b)
        SELECT metric, baseline, "current", round(mv, 6) AS movement, CASE WHEN (rel AND mv > tol) OR (NOT rel AND -mv > tol) THEN 'regression' ELSE 'ok' END AS status FROM m""",
    "metric_pairs": f"WITH {_CASES} SELECT CASE WHEN gated THEN 'gated' ELSE 'advisory' END AS kind, case_id, latency_ms FROM cases",
    "policy_flags": f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '{C.EMAIL}') THEN 'pii_detected:email' END, CASE WHEN regexp_matches(text, '{C.PHONE}') THEN 'pii_detected:phone' END,
        CASE WHEN contains(lower(text), '{C.DISALLOWED_TERMS[0]}') THEN 'disallowed_term:{C.DISALLOWED_TERMS[0]}' END, CASE WHEN contains(lower(text), '{C.DISALLOWED_TERMS[1]}') THEN 'disallowed_term:{C.DISALLOWED_TERMS[1]}' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents""",
    "leak_probes": f"""SELECT doc_id, {", ".join(f"CAST({_n(p, t)} AS INT) AS {k}" for (k, p), t in zip(C.LEAK_PROBES.items(), ("regexp_replace(text, '\\[\\[IMAGE:[^\\]]*\\]\\]', '', 'g')", "text", "text", "text"), strict=True))} FROM documents""",
    "doc_structure": f"""WITH {_MARKDOWN}, c AS (SELECT conv_id, text, regexp_replace(text, '\\[\\[IMAGE:[^\\]]*\\]\\]', '', 'g') AS prose FROM md),
        k AS (SELECT conv_id, {_n(r'(?m)^##\s+Part\s+\d+:')} AS parts, {_n(r'(?m)^###\s+Step\s+\d+:')} AS steps, {_n(r'(?m)^###\s+')} AS h3, {_n(r'(?m)^\|\s*-{3,}')} AS div, {_n(r'(?m)^\|')} AS bar, {_n(r'\[\[IMAGE:')} AS img, length(text) AS chars,
            {_n(C.LEAK_PROBES['slide_reference'], 'prose')} AS a, {_n(C.ROLE_TAG)} AS b, {_n(C.LEAK_PROBES['meeting_chatter'])} AS c, {_n(C.LEAK_PROBES['raw_bold_marker'])} AS d FROM c)
        SELECT conv_id, CAST(parts AS INT) AS parts, CAST(steps AS INT) AS procedure_steps, CAST(greatest(h3 - steps, 0) AS INT) AS topics, CAST(div AS INT) AS tables_rendered, CAST(greatest(bar - 2 * div, 0) AS INT) AS table_rows, CAST(img AS INT) AS figures_embedded, CAST(chars AS INT) AS output_chars,
            CAST(a AS INT) AS leak_slide_reference, CAST(b AS INT) AS leak_roster_role, CAST(c AS INT) AS leak_meeting_chatter, CAST(d AS INT) AS leak_raw_bold_marker, a + b + c + d = 0 AS content_integrity_pass FROM k""",
    "contract_check": f"""WITH {_MARKDOWN}, k AS (SELECT conv_id, text, ['summary', 'comprehensive', 'dossier'][conv_id % 3 + 1] AS detail, {_n(r'(?m)^[ \t]*## ')} AS h2,
            {" OR ".join(f"regexp_matches(text, '{p}')" for p in C.BANNED_MARKERS)} OR regexp_matches(text, '{_CHATTER}') AS banned FROM md)
        SELECT conv_id, detail, banned OR h2 < CASE detail WHEN 'dossier' THEN CASE WHEN conv_id % 2 = 0 THEN 6 ELSE 3 END WHEN 'comprehensive' THEN CASE WHEN conv_id % 2 = 0 THEN 4 ELSE 3 END ELSE 0 END AS violates FROM k""",
    "llm_authorship": f"""WITH {_MARKDOWN}, o AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN text || chr(10) || '{C.OPENERS[0]}' ELSE text END AS text FROM md),
        k AS (SELECT conv_id, {_n(r'(?m)^###\s+')} AS topics, {" + ".join(_n(x) for x in C.OPENERS)} AS own FROM o)
        SELECT conv_id, CAST(topics AS INT) AS topics, CAST(CASE WHEN topics = 0 THEN 0 ELSE greatest(topics - own, 0) END AS INT) AS llm_topics, round(CASE WHEN topics = 0 THEN 0 ELSE greatest(topics - own, 0) / topics::DOUBLE END, 6) AS coverage FROM k""",
    "ingress_checks": """SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'ip:10.0.0.1' ELSE 'user:' || user_id END AS key, CASE WHEN event_id % 7 <> 0 AND event_id > 500 THEN event_id END AS oversize FROM events""",
    "artifact_authz": """WITH a AS (SELECT event_id AS artifact_id, 'u' || (user_id % 40) AS owner, event_id * 31 % 997 AS size FROM events) SELECT 'u3' AS "user", artifact_id, size FROM a WHERE owner = 'u3' UNION ALL SELECT 'root', artifact_id, size FROM a""",
    "label_quality_vs_flags": f"""SELECT quality, toxic, count(*) AS n, count(*) FILTER (regexp_matches(text, '{C.EMAIL}') OR regexp_matches(text, '{C.PHONE}') OR contains(lower(text), '{C.DISALLOWED_TERMS[0]}') OR contains(lower(text), '{C.DISALLOWED_TERMS[1]}')) AS n_flagged FROM labels JOIN documents USING (doc_id) GROUP BY ALL""",
    "kpi_snapshot": f"WITH {_RUNS}, {_SNAPSHOT} SELECT * FROM snap",
    "latency_percentiles": f"""WITH {_RUNS}, v AS (SELECT route, list_sort(list(total_latency_ms)) AS s FROM runs GROUP BY 1)
        SELECT route, {", ".join(f"s[CAST(round_even({f}::DOUBLE * (len(s) - 1), 0) AS INT) + 1] AS {k}" for k, f in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))} FROM v""",
    "cost_rollup": f"""WITH {_RUNS}, p AS (SELECT route, mode, slides_ingested AS tokens, round(slides_ingested / 1000.0::DOUBLE * 0.5::DOUBLE + topics / 1000.0::DOUBLE * 1.5::DOUBLE, 6) AS c FROM runs)
        SELECT route, mode, count(*) AS runs, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(c), 9) AS total_cost, round(avg(c), 9) AS avg_cost FROM p GROUP BY ROLLUP (route, mode)""",
    "exposition": f"""WITH {_RUNS}, {_SNAPSHOT}, l AS (SELECT unnest({_SNAPSHOT_NAMES}) AS m, unnest([{', '.join(f'{n}::DOUBLE' for n in _SNAPSHOT_NAMES)}]) AS v FROM snap)
        SELECT 'docs_' || m AS name, '# HELP docs_' || m || ' ' || replace('docs_' || m, '_', ' ') || chr(10) || '# TYPE docs_' || m || ' gauge' || chr(10) || 'docs_' || m || ' ' || printf('%.6f', v) AS line FROM l""",
    "last_n_runs": f"WITH {_RUNS} SELECT seq, recorded_at, succeeded FROM runs ORDER BY recorded_at DESC, seq DESC LIMIT 500",
    "latest_job_status": "SELECT user_id AS job_id, last(event_type ORDER BY ts, event_id) AS status, max(ts) AS updated_at, count(*) AS n_updates FROM events GROUP BY 1",
    "quality_proxies": f"""WITH {_RUNS}, p AS (SELECT seq, topics, llm_topics, content_integrity_pass, leaks, least(1.0::DOUBLE, (seq % 11) / 10.0::DOUBLE) AS s, least(1.0::DOUBLE, (seq % 7) / 5.0::DOUBLE) AS c, slides_ingested * 100 AS ch FROM runs),
        g AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + 0.45::DOUBLE * s + 0.2::DOUBLE * c + 0.1::DOUBLE * CASE WHEN content_integrity_pass THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END)) AS g, greatest(250, CAST(floor(1.65::DOUBLE * ch + 85 * greatest(topics, llm_topics) + 20) AS INT)) AS tok FROM p)
        SELECT seq, round_even(g, 4) AS groundedness_score, round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - g + CASE WHEN leaks > 0 THEN 0.15::DOUBLE ELSE 0 END)), 4) AS hallucination_rate, round_even(0.3::DOUBLE + 0.7::DOUBLE * s, 4) AS retrieval_recall_at_5, round_even(0.45::DOUBLE + 0.55::DOUBLE * s, 4) AS retrieval_recall_at_10,
            round_even(0.4::DOUBLE + 0.6::DOUBLE * s, 4) AS mrr, round_even(0.5::DOUBLE + 0.5::DOUBLE * s, 4) AS ndcg_at_10, round_even(least(1.0::DOUBLE, 0.35::DOUBLE + 0.65::DOUBLE * c), 4) AS coverage_score, round_even(least(1.0::DOUBLE, leaks / greatest(1, topics, llm_topics, floor(ch / 200))::DOUBLE), 4) AS leakage_rate,
            CASE WHEN content_integrity_pass THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS schema_compliance_rate, tok AS tokens_used, round_even(tok / 1000.0::DOUBLE * 0.0032::DOUBLE, 6) AS cost_usd FROM g""",
    "artifact_view": """WITH a AS (SELECT event_id AS artifact_id, 'u' || (user_id % 40) AS owner, event_id * 31 % 997 AS size FROM events) SELECT 'u3' AS "user", artifact_id, size FROM a WHERE owner = 'u3' UNION ALL SELECT 'root', artifact_id, size FROM a""",
    "document_repetition": rf"""WITH {_MARKDOWN}, b AS (SELECT conv_id AS doc_id, unnest(string_split(text, E'\n\n')) AS b FROM md), p AS (SELECT doc_id, b FROM b WHERE {_STRIP.format(x='b')} <> ''),
        s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(b, '\[\[IMAGE:([^\]]*)\]\]', ' ', 'g'), '([.!?])\s+', E'\\1\x01', 'g'), E'\x01')) AS x FROM p WHERE NOT regexp_matches({_STRIP.format(x='b')}, '^(#|\||\[\[IMAGE:)')),
        u AS (SELECT doc_id, 'paragraph' AS kind, lower({_SQUEEZE.format(x='b')}) AS unit FROM p
              UNION ALL SELECT doc_id, 'heading', lower({_SQUEEZE.format(x='x')}) FROM (SELECT conv_id AS doc_id, unnest(string_split(text, chr(10))) AS x FROM md) WHERE starts_with(x, '#')
              UNION ALL SELECT conv_id, 'figure', unnest(regexp_extract_all(text, '\[\[IMAGE:([^\]]*)\]\]', 1)) FROM md
              UNION ALL SELECT doc_id, 'sentence', lower({_SQUEEZE.format(x='x')}) FROM s WHERE length({_STRIP.format(x='x')}) >= 40),
        n AS (SELECT doc_id, kind, unit, count(*) AS n FROM u GROUP BY ALL)
        SELECT doc_id, kind, CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_units, CAST(sum(n - 1) AS BIGINT) AS extra FROM n GROUP BY 1, 2""",
    "table_shapes": "SELECT 3::INT AS rows, 3::INT AS columns, count(*) AS n FROM conversations WHERE turn % 3 = 0 HAVING count(*) > 0",
    "job_outcomes": f"""WITH e AS (SELECT user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts, 'e' || event_id AS error FROM events),
        o AS (SELECT job_id, ts, CASE status WHEN 'queued' THEN 1 WHEN 'running' THEN 2 WHEN 'completed' THEN 3 ELSE 4 END AS ord, status, error FROM e UNION ALL SELECT job_id, max(max(ts)) OVER (), 99, '', NULL FROM e GROUP BY job_id),
        l AS (SELECT job_id, list({{'status': status, 'ts': ts, 'n': 0, 'error': error}} ORDER BY ord = 99, ts, ord, error) AS l FROM o GROUP BY 1),
        f AS (SELECT job_id, list_reduce(list_prepend({{'status': '', 'ts': CAST(NULL AS TIMESTAMP), 'n': 0, 'error': CAST(NULL AS VARCHAR)}}, l), lambda s, x: CASE
            WHEN s.status IN ('queued', 'running') AND x.ts - s.ts >= INTERVAL 24 HOURS THEN {{'status': 'interrupted', 'ts': s.ts + INTERVAL 24 HOURS, 'n': s.n + 1, 'error': '{jobs.SILENT}'}}
            WHEN s.status = '' AND x.status = 'queued' OR s.status = 'queued' AND x.status IN ('running', 'failed') OR s.status = 'running' AND x.status IN ('running', 'completed', 'failed') THEN {{'status': x.status, 'ts': x.ts, 'n': s.n + 1, 'error': CASE WHEN x.status = 'failed' THEN x.error END}}
            ELSE s END) AS s FROM l)
        SELECT job_id, s.status AS status, s.ts AS "at", CAST(s.n AS INT) AS n_changes, s.error AS error FROM f WHERE s.n > 0""",
    "run_windows": "SELECT date_trunc('day', ts) AS window_start, event_type AS route, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS succeeded, round_even(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 4) AS success_rate, round(sum(value), 4) AS total_latency_ms, max(value) AS max_latency_ms FROM events GROUP BY 1, 2",
    "triage_delta": """WITH k AS (SELECT event_id, CASE WHEN value > 50 THEN 'kept:' ELSE 'dropped:' END || event_type AS key FROM events), h AS (SELECT 0.5 * max(event_id) AS h FROM events)
        SELECT key, count(*) - count(*) FILTER (event_id <= h) AS delta FROM k, h GROUP BY 1 HAVING count(*) - count(*) FILTER (event_id <= h) > 0""",
    "event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "part_classify": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), hay AS (SELECT doc_id, lower(substr(l[1], 1, 40) || ' ' || substr(l[1], 1, 40) || ' ' || substr(l[1], 1, 40) || ' ' || array_to_string(l[1:8], ' ')) AS t FROM l)
        SELECT doc_id, {_best_part(C.PARTS, 'part')}, {_best_part(Q.LOCAL_PARTS, 'local_part')} FROM hay""",
    "section_chunks": f"""WITH {_CHUNKS}, s AS ({_SECTION_ROWS}), r AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY hits DESC, round(1.0::DOUBLE / (1 + chunk_no), 9) DESC, doc_id, chunk_no) AS rank, doc_id, chunk_no, hits FROM s)
        SELECT section, CAST(rank AS INT) AS rank, doc_id, chunk_no, hits FROM r WHERE rank <= 6""",
    "procedure_steps": rf"""WITH {_SLIDES}, t AS (SELECT deck, slide_no AS topic_no, slide_no % 4 AS step, (slide_no % 4) || CASE WHEN slide_no % 2 = 0 THEN '. ' ELSE ') ' END || coalesce(title, '-') AS title FROM slides)
        SELECT deck, CAST(step AS INT) AS step, topic_no, title FROM t WHERE step BETWEEN 1 AND 30 AND regexp_matches(title, '^\s*\d{{1,2}}\s*[.)]\s+.{{3,}}$') QUALIFY row_number() OVER (PARTITION BY deck, step ORDER BY topic_no) = 1""",
    "repetition_report": f"""WITH {_LINES}, u AS (SELECT 'line' AS kind, line AS unit FROM lines UNION ALL SELECT 'sentence', unnest(string_split_regex(text, '[.!?]\\s')) FROM documents),
        v AS (SELECT kind, lower({_SQUEEZE.format(x='unit')}) AS v FROM u), p AS (SELECT kind, v, count(*) AS n FROM v WHERE v <> '' GROUP BY ALL)
        SELECT kind, CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_units, CAST(sum(n - 1) AS BIGINT) AS extra FROM p GROUP BY 1""",
    "template_shapes": f"""WITH {_LINES}, p AS (SELECT array_to_string(string_split(lower({_SQUEEZE.format(x='line')}), ' ')[1:5], ' ') AS shape FROM lines) SELECT shape, count(*) AS n FROM p WHERE shape <> '' GROUP BY 1 HAVING count(*) > 2""",
    "caption_alignment": """SELECT doc_id, pos, text, heading FROM (SELECT conv_id AS doc_id, turn AS pos, role, md5(text) AS text, last_value(CASE WHEN role <> 'assistant' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations) WHERE role = 'assistant'""",
    "evidence_topn": """WITH b AS (SELECT source, row_number() OVER (ORDER BY max(n_chars) DESC, source) AS source_rank FROM documents GROUP BY 1 QUALIFY source_rank <= 6),
        n AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents)
        SELECT CAST(source_rank AS INT) AS source_rank, source, CAST(nth AS INT) AS nth, md5(substr(text, 1, 420)) AS digest FROM n JOIN b USING (source) WHERE nth <= 5""",
    "html_extract": r"""SELECT page_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""",
    "file_select": r"""WITH f AS (SELECT 'Docs/' || source || '/' || lang || '_note-' || doc_id || '.' || ['md', 'pptx', 'pdf', 'txt'][doc_id % 4 + 1] AS path, lang || '_note-' || doc_id || '.' || ['md', 'pptx', 'pdf', 'txt'][doc_id % 4 + 1] AS name FROM documents),
        s AS (SELECT path, name, len(list_intersect(list_filter(regexp_extract_all(lower(name), '[a-z0-9_]+'), lambda x: length(x) >= 3), ['review', 'the', 'fr_note', 'and', '120', 'pdf'])) + CASE WHEN regexp_matches(lower(path), '\.(pptx|pdf)$') THEN 1 ELSE 0 END AS base,
            contains(lower(path), 'src1/en') AS a, contains(lower(path), 'de_note-33.pptx ') AS b, contains(lower(path), 'de_note-33.pptx') AS c FROM f),
        x AS (SELECT 'none' AS hints, path, base AS score FROM s ORDER BY base DESC, path LIMIT 6), y AS (SELECT 'two' AS hints, path, base + 5 * (a::INT + b::INT) AS score FROM s WHERE a OR c OR NOT (SELECT bool_or(a OR c) FROM s) ORDER BY score DESC, path LIMIT 6)
        SELECT hints, path, CAST(score AS INT) AS score FROM x UNION ALL SELECT hints, path, CAST(score AS INT) FROM y""",
    "image_triage": f"""WITH {_TRIAGE}, z AS (SELECT *, nullif(width, 0) * 0.75::DOUBLE AS w, nullif(height, 0) * 0.75::DOUBLE AS h FROM tri)
        SELECT image_id, category, category IN ('diagram', 'photo') AS include, CASE WHEN w IS NULL THEN NULL ELSE round(w * least(1.0::DOUBLE, coalesce(400 / w, 1), coalesce(220 / h, 1)), 4) END AS width_pt, CASE WHEN h IS NULL THEN NULL ELSE round(h * least(1.0::DOUBLE, coalesce(400 / w, 1), coalesce(220 / h, 1)), 4) END AS height_pt FROM z""",
    "image_merge": """WITH e AS (SELECT event_id AS pos, event_type, 'Img' || (event_id % 7) || '.png' AS name, to_base64(encode('picture ' || (event_id % 14))) AS body FROM events),
        b AS (SELECT 0 AS list, pos, name, body AS content, body FROM e WHERE event_type = 'click' UNION ALL SELECT 1, pos, lower(name), 'data:image/png;base64,' || body, body FROM e WHERE event_type = 'view'),
        r AS (SELECT *, row_number() OVER (PARTITION BY lower(name), substr(body, 1, 64), length(body) ORDER BY list, pos) AS nth FROM b) SELECT list, pos, name, content FROM r WHERE nth = 1 ORDER BY list, pos LIMIT 12""",
    "table_rows": """WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), c AS (SELECT item_id, item_id % 2 = 1 AS odd, list_transform(range(1, 7), lambda i: trim(regexp_replace(coalesce(w[i], ''), '\\s+', ' ', 'g'))) AS c FROM w),
        r AS (SELECT item_id, CASE WHEN odd THEN [array_to_string([c[1], c[2], c[3]], '|'), c[4] || '||', c[5] || '||' || c[6]] ELSE [c[1] || '|' || c[3], c[4] || '|', c[5] || '|' || c[6]] END AS r FROM c)
        SELECT item_id AS table_id, CAST(i AS INT) AS pos, r[i + 1] AS cells FROM (SELECT item_id, r, unnest(range(3)) AS i FROM r)""",
    "clean_lines": f"""WITH {_LINES}, a AS (SELECT doc_id, pos, {_SQUEEZE.format(x='line')} AS s FROM lines), b AS (SELECT *, {_n(C.ROLE_TAG_ANY_CASE, 's')} AS roles, {_NAMES} AS names FROM a), c AS (SELECT doc_id, pos, s, {_NOISE_FLAG} AS noise FROM b),
        d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, noise, lower(s) ORDER BY pos) AS nth FROM c), e AS (SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY pos) FILTER (NOT noise AND nth = 1), '') AS t FROM d GROUP BY 1)
        SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest FROM e""",
    "heading_lines": rf"""WITH {_LINES}, a AS (SELECT doc_id, CASE WHEN (pos - 1) % 5 = 0 THEN regexp_extract(line, '^\S+(\s+\S+){{0,3}}', 0) || ':' ELSE line END AS line FROM lines),
        b AS (SELECT doc_id, line, regexp_replace(regexp_replace(line, ':+$', ''), '^\s+|\s+$', '', 'g') AS s FROM a)
        SELECT doc_id, count(*) FILTER (ends_with(line, ':') AND length(s) BETWEEN 1 AND 80 AND len(string_split_regex(s, '\s+')) <= 12 AND NOT regexp_matches(s, '[.!?](\s|$)')) AS n_headings FROM b GROUP BY 1""",
    "fragment_blocks": f"""WITH {_FRAGMENTS}, p AS (SELECT doc_id, f, g, list_transform(range(CAST(ceil(least(len(g), 18) / 2.0) AS BIGINT)), lambda i: array_to_string(g[i * 2 + 1:least(i * 2 + 2, 18)], ' ')) AS p FROM fg)
        SELECT doc_id, CAST(len(f) AS INT) AS n_fragments, CAST(len(g) AS INT) AS n_distinct, CAST(len(p) AS INT) AS n_paragraphs, md5(array_to_string(p, chr(10))) AS digest FROM p""",
    "markup": r"""WITH m AS (SELECT conv_id, turn, replace(replace(replace('**' || string_split(text, ' ')[1] || '** & *x* ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM conversations)
        SELECT conv_id, turn, md5(regexp_replace(regexp_replace(t, '\*\*(.+?)\*\*', '<b>\1</b>', 'g'), '\*(.+?)\*', '<i>\1</i>', 'g')) AS digest, ['image/png', 'image/jpeg', 'image/gif', 'image/tiff', 'application/octet-stream'][turn % 5 + 1] AS mime FROM m""",
    "prompt_checks": f"""WITH w AS (SELECT conv_id, turn, text AS w FROM conversations),
        p AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'Generate document report' ELSE w END AS p, CASE turn % 3 WHEN 0 THEN 'Please summarise ' || w WHEN 1 THEN '2024 - 7' ELSE w END AS t FROM w),
        k AS (SELECT conv_id, turn, regexp_extract_all(lower(p), '[a-z0-9_]+') AS tok, {_n('[A-Za-z]+', 't')} AS words, {_n(C.INSTRUCTION, 't')} AS hits FROM p)
        SELECT conv_id, turn, len(tok) <= 5 AND len(list_filter(tok, lambda x: NOT list_contains({list(C.GENERIC_PROMPT)}, x))) = 0 AS generic, words = 0 OR hits >= 2 OR (hits >= 1 AND words <= 4) AS instruction FROM k""",
    "document_titles": f"""WITH c AS (SELECT conv_id, turn AS no, unnest(string_split(text, chr(10))) AS w, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM conversations),
        n AS (SELECT conv_id, no * 1000000 + k AS turn, CASE no % 4 WHEN 0 THEN 'Please generate slides 3 - 9 of ' || w WHEN 1 THEN 'deck_file ' || w || ' guide.' ELSE w END AS t FROM c),
        f AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{C.SLIDE_RANGE}', ' ', 'g'), '{C.SOURCE_WORD}', ' ', 'g'), '[_\\-]+', ' ', 'g'), '\\s{{2,}}', ' ', 'g'), '^[ \\-–—,:;.\\t]+|[ \\-–—,:;.\\t]+$', '', 'g') AS t FROM n),
        k AS (SELECT *, {_n('[A-Za-z]+', 't')} AS words, {_n(C.INSTRUCTION, 't')} AS hits FROM f), g AS (SELECT conv_id, arg_min(t, turn) FILTER (length(t) BETWEEN 3 AND 90 AND NOT (words = 0 OR hits >= 2 OR (hits >= 1 AND words <= 4))) AS t FROM k GROUP BY 1)
        SELECT conv_id, CASE WHEN t IS NULL THEN 'Technical Reference Documentation' ELSE upper(t[1]) || t[2:] || CASE WHEN regexp_matches(t, '(?i)\\b(documentation|manual|handbook|guide|reference)\\b') THEN '' ELSE ' — Technical Documentation' END END AS title FROM g""",
    "title_normalise": rf"""WITH f AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Deck: Topic: ' || text || ' -' WHEN 1 THEN 'The 2 nd ' || text || ':' ELSE 'Topic: ab' END AS t FROM conversations),
        h AS (SELECT conv_id, turn, {_title('t')} AS title, trim(regexp_replace(regexp_replace(lower(t), '\b(\d{{1,3}})\s+(st|nd|rd|th)\b', '\1\2', 'g'), '[^a-z0-9]+', ' ', 'g')) AS heading,
            regexp_replace({_STRIP.format(x=r"string_split_regex(regexp_replace(" + _STRIP.format(x="regexp_replace(" + _SQUEEZE.format(x="t") + ", ':+$', '')") + r", '([.!?])\s', '\1' || chr(1), 'g'), '\x01')[1]")}, '\.+$', '') AS c FROM f)
        SELECT conv_id, turn, title, heading, {_clipped(_STRIP.format(x="c"), 72, ',;:' + chr(92) + '-', '...')} AS subject FROM h""",
    "chunk_paragraphs": f"""WITH w AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1), p AS (SELECT conv_id, {_packed('text')} AS c FROM w WHERE text IS NOT NULL)
        SELECT conv_id, CAST(i AS INT) AS chunk_no, CAST(length(c[i + 1]) AS INT) AS n_chars, md5(c[i + 1]) AS digest FROM (SELECT conv_id, c, unnest(range(len(c))) AS i FROM p)""",
    "source_order": f"""WITH {_CHUNKS}, {_lex('chunks')}, {_bm25(_BENCH_Q)}, f AS (SELECT qid, source, min(rank) AS r FROM top JOIN documents USING (doc_id) GROUP BY ALL) SELECT qid, string_agg(source, ',' ORDER BY r) AS sources FROM f GROUP BY 1""",
    "mmr_select": f"""WITH {_CHUNKS}, {_lex('chunks')}, {_bm25(_BENCH_Q)}, best AS (SELECT qid, max(score) AS best FROM sc WHERE score > 0 GROUP BY 1),
        src AS (SELECT qid, doc_id, chunk_no, round(score / best, 9) AS score, text FROM sc JOIN best USING (qid) JOIN chunks USING (doc_id, chunk_no) WHERE score > 0), {_mmr('src')}
        SELECT qid, CAST(rank AS INT) AS rank, doc_id, chunk_no, round(score, 6) AS score FROM mmr""",
    "hybrid_context": f"""WITH {_CHUNKS}, {_lex('chunks')}, {_bm25(_BENCH_Q)}, qn AS (SELECT item_id AS qid, row_number() OVER (ORDER BY item_id) - 1 AS place FROM benchmark), en AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings),
        q2 AS (SELECT qid, en.vec_id, en.embedding FROM qn JOIN en ON en.place = qn.place % (SELECT count(*) FROM embeddings)),
        dn AS (SELECT q.qid, e.vec_id AS doc_id, {_DOT} AS score FROM embeddings e JOIN q2 q ON e.vec_id <> q.vec_id),
        ch AS (SELECT qid, doc_id, chunk_no, score, 1 AS channel FROM sc UNION ALL SELECT qid, doc_id, chunk_no, score, 2 FROM dn JOIN (SELECT doc_id, chunk_no FROM chunks) USING (doc_id)),
        rk AS (SELECT *, row_number() OVER (PARTITION BY qid, channel ORDER BY round(score, 9) DESC, doc_id, chunk_no) AS r FROM ch WHERE score > 0), act AS (SELECT qid, count(DISTINCT channel) AS n FROM rk GROUP BY 1),
        fu AS (SELECT qid, doc_id, chunk_no, sum(1.0::DOUBLE / (60 + r)) * 61 / any_value(n) AS score FROM rk JOIN act USING (qid) GROUP BY 1, 2, 3),
        src AS (SELECT qid, doc_id, chunk_no, round(least(1.0::DOUBLE, score + (0.05::DOUBLE * (contains(lower(text), 'the')::INT + contains(lower(text), 'thand')::INT + contains(lower(text), 'ing')::INT))), 6) AS score, text FROM fu JOIN chunks USING (doc_id, chunk_no)), {_mmr('src')},
        b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM mmr)
        SELECT qid, CAST(rank AS INT) AS rank, doc_id, chunk_no, round(score, 6) AS score, CAST(least(length(text), 15000 - prev) AS INT) AS n_chars FROM b WHERE prev < 15000""",
    "mock_drafts": """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations), d AS (SELECT conv_id, turn, '# Summarise the notes' || E'\\n\\n## Summary\\n' || x || E'\\n\\n## Key Points\\n' || array_to_string(list_transform(list_filter(string_split(x, '. '), lambda y: regexp_replace(y, '^\\\\s+|\\\\s+$', '', 'g') <> ''), lambda y: '- ' || regexp_replace(y, '^\\\\s+|\\\\s+$', '', 'g')), chr(10))
            || CASE WHEN conv_id % 2 = 0 THEN E'\\n\\n## Applied Instructions\\n- Keep it short\\n- Name the owner' ELSE '' END AS t FROM t)
        SELECT conv_id, turn, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest FROM d""",
    "accepted_documents": f"SELECT doc_id, CAST(length(substr(text, 1, 500)) AS INT) AS n_chars FROM documents WHERE doc_id % 13 <> 0 AND NOT contains(lower(text), '{C.DISALLOWED_TERMS[0]}') AND NOT contains(lower(text), '{C.DISALLOWED_TERMS[1]}')",
    "workflow_topics": f"""SELECT conv_id, turn, {_n(C.WORKFLOW_HINT, "concat_ws(' ', CASE conv_id % 3 WHEN 0 THEN 'Portal setup request' WHEN 1 THEN 'Ticket' END, array_to_string(string_split(text, chr(10))[1:6], ' '))")} >= 2 AS workflow FROM conversations""",
    "public_jobs": "SELECT event_id AS job_id, event_type AS status, ts AS created_at, ts AS updated_at, CASE WHEN event_type = 'error' THEN 'failed' END AS error, '/compose/jobs/' || event_id || '/result' AS result_path, '/compose/jobs/' || event_id AS status_path FROM events",
    "request_routes": f"""WITH p AS {_table('detail, route, mode, ld, md, mc, mcd, lc, mch', C.PROFILES)}, r AS (SELECT event_id AS request_id, CASE WHEN event_id % 6 = 5 THEN 'dossier' ELSE {[x[0] for x in C.PROFILES]}[event_id % 6 + 1] END AS detail, user_id % 20 AS n FROM events)
        SELECT request_id, route, mode, CAST(greatest(ld, least(n, coalesce(md, n))) AS INT) AS max_docs, mc AS max_chars, mcd AS max_chars_per_doc, CAST(greatest(lc, least(8, coalesce(mch, 8))) AS INT) AS top_k FROM r JOIN p USING (detail)""",
    "result_cache": """WITH c AS (SELECT DISTINCT md5(text) AS key, CASE WHEN doc_id % 2 = 0 THEN 'r' || length(text) ELSE '  ' END AS result FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, result FROM (SELECT doc_id, md5(text) AS key FROM documents) LEFT JOIN (SELECT * FROM c WHERE trim(result) <> '') USING (key)""",
    "rate_limit_decisions": """WITH e AS (SELECT 'user:' || user_id AS key, event_id, epoch_us(ts) / 1e6::DOUBLE AS ts FROM events), g AS (SELECT key, list({'id': event_id, 'ts': ts} ORDER BY ts, event_id) AS l FROM e GROUP BY 1),
        f AS (SELECT key, list_reduce(list_transform(l, lambda x: {'acc': [x.ts], 'out': [{'id': x.id, 'ok': true, 'wait': 0}]}), lambda s, x: list_transform([list_filter(s.acc, lambda t: t > x.acc[1] - 40000.0::DOUBLE)], lambda live: CASE WHEN len(live) < 2
            THEN {'acc': list_append(live, x.acc[1]), 'out': list_append(s.out, {'id': x.out[1].id, 'ok': true, 'wait': 0})}
            ELSE {'acc': live, 'out': list_append(s.out, {'id': x.out[1].id, 'ok': false, 'wait': greatest(1, CAST(floor(live[1] + 40000.0::DOUBLE - x.acc[1]) AS INT) + 1)})} END)[1],
            {'acc': CAST([] AS DOUBLE[]), 'out': CAST([] AS STRUCT(id BIGINT, ok BOOLEAN, wait INT)[])}) AS r FROM g), u AS (SELECT key, unnest(r.out) AS o FROM f)
        SELECT key, o.id AS event_id, o.ok AS allowed, o.wait AS retry_after FROM u""",
    "event_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS opens FROM events), b AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM a)
        SELECT user_id, min(ts) AS session_start, count(*) AS n FROM b GROUP BY user_id, b.n""",
    "misplaced_figures": r"""WITH a AS (SELECT conv_id AS doc_id, turn AS pos, role, text AS t FROM conversations), b AS (SELECT doc_id, pos, role, t, last_value(CASE WHEN role <> 'assistant' THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h FROM a),
        k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(h), '\b(\d{1,3})\s+(st|nd|rd|th)\b', '\1\2', 'g'), '[^a-z0-9]+', ' ', 'g')) AS hk, trim(regexp_replace(regexp_replace(lower(t), '\b(\d{1,3})\s+(st|nd|rd|th)\b', '\1\2', 'g'), '[^a-z0-9]+', ' ', 'g')) AS fk FROM b WHERE role = 'assistant'),
        w AS (SELECT *, list_distinct(string_split(hk, ' ')) AS x, list_distinct(string_split(fk, ' ')) AS y FROM k WHERE hk <> '' AND fk <> '')
        SELECT doc_id, pos, md5(h || chr(10) || t) AS digest FROM w WHERE NOT (contains(fk, hk) OR contains(hk, fk) OR len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE >= 0.35::DOUBLE) AND NOT starts_with(fk, 'continuation view')""",
    "adjacent_status": r"""WITH a AS (SELECT user_id % 500 AS doc_id, event_id AS pos, CASE WHEN event_id % 4 < 3 THEN 'Status as of the ' || (event_id % 3 % 2 + 2) || ' nd' ELSE event_type END AS line FROM events), b AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM a)
        SELECT doc_id, pos, line FROM b WHERE starts_with(line, 'Status as of') AND line = nxt""",
    "title_mode": f"WITH {_SLIDES} SELECT title, count(*) AS n FROM slides WHERE title <> '' GROUP BY 1 ORDER BY n DESC, title LIMIT 8",
    "repeated_long_lines": f"WITH {_LINES}, s AS (SELECT lower({_SQUEEZE.format(x='line')}) AS line FROM lines) SELECT md5(line) AS digest, count(*) AS n FROM s WHERE length(line) >= 80 GROUP BY line HAVING count(*) > 1 ORDER BY n DESC, line LIMIT 5",
    "image_relevance": f"WITH {_TRIAGE} SELECT image_id, category IN ('diagram', 'photo') AND NOT (category = 'photo' AND image_id % 2 = 0 AND width / greatest(height, 1)::DOUBLE BETWEEN 0.75 AND 1.4 AND skin >= 0.08::DOUBLE) AS relevant FROM tri",
    "triage_precision": f"WITH {_TRIAGE} SELECT count(*) FILTER (category IN ('diagram', 'photo')) AS kept, count(*) AS total, round_even(count(*) FILTER (category IN ('diagram', 'photo')) / count(*)::DOUBLE, 4) AS precision FROM tri",
    "image_placement": rf"""WITH {_MARKDOWN}, t AS (SELECT conv_id AS doc_id, unnest(range(len(l))) AS pos, l FROM (SELECT conv_id, regexp_extract_all(text, '\[\[IMAGE:([^\]]*)\]\]', 1) AS l FROM md)), n AS (SELECT doc_id, pos, trim(l[pos + 1]) AS name FROM t),
        i AS (SELECT conv_id AS doc_id, unnest(['slide 4', 'plan']) AS name FROM md), a AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY CASE name WHEN 'plan' THEN 1 ELSE 0 END) - 1 AS pos FROM i WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = i.doc_id AND n.name = i.name))
        SELECT doc_id, 'inline' AS place, CAST(pos AS INT) AS pos, name, md5(name || ' ' || doc_id) AS digest FROM n JOIN i USING (doc_id, name) UNION ALL SELECT doc_id, 'appendix', CAST(pos AS INT), name, md5(name || ' ' || doc_id) FROM a""",
    "topic_narratives": f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_SQUEEZE.format(x='x')}), lambda x: x <> '') AS l, string_split(text, ' ')[1] AS t FROM documents WHERE text IS NOT NULL),
        b AS (SELECT doc_id, l, t, length(t) % 3 + 1 AS v, list_filter(l, lambda x: length(x) >= 25)[1:14] AS f, array_to_string(list_transform(l[1:3], lambda x: x), ' ') AS e, lower({_STRIP.format(x="coalesce(nullif(t, ''), 'this topic')")}) AS s FROM a),
        c AS (SELECT *, {_clipped('e', 220, ' ', '...')} AS ev FROM b),
        d AS (SELECT doc_id, {list(C.OPENERS[:3])}[v] || ' ' || coalesce(nullif(t, ''), 'this area of the programme') || '. ' || CASE WHEN len(f) > 0 THEN array_to_string(f[1:3], ' ') ELSE {list(C.TEMPLATES['visual_only'])}[v] END
            || CASE WHEN len(f) > 3 THEN chr(10) || chr(10) || {list(C.TEMPLATES['follow_ups'])}[v] || ' ' || array_to_string(f[4:8], ' ') ELSE '' END || CASE WHEN len(f) > 8 THEN chr(10) || chr(10) || '{C.TEMPLATES['more']} ' || array_to_string(f[9:14], ' ') ELSE '' END
            || CASE WHEN doc_id % 2 > 0 THEN chr(10) || chr(10) || '{C.TEMPLATES['table']}' ELSE '' END || CASE WHEN doc_id % 3 > 0 THEN chr(10) || chr(10) || CASE WHEN ev <> '' THEN 'As the figure of ' || s || ' has it: ' || ev || '.' ELSE 'The figure depicts ' || s || '.' END ELSE '' END AS t FROM c)
        SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest FROM d""",
    "retrieval_queries": f"""SELECT conv_id, turn, md5(array_to_string(list_filter(list_transform(list_concat(['plan', role, 'a'], CASE WHEN turn % 2 = 0 THEN ['hint.md'] ELSE [] END, [substr({_STRIP.format(x='text')}, 1, 800)]), lambda x: {_STRIP.format(x='x')}), lambda x: x <> ''), chr(10))) AS digest FROM conversations""",
}
