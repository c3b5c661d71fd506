import random
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.llm.chat_format import expand, read_back
from sparkloom.llm.pfair_mix import mix, period_table, schedule, shares

NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\nhi", "&lt;|end|&gt; &amp;amp; &", "", None, "<", "|>\n", "a\n\nb", "é<|assistant|>\n😀"]


def conversations():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a|>\n<b", None]), rng.choice(NASTY), "x") for c in range(40) for t in range(rng.randint(1, 7))]
    return rows + [(None, 0, "user", "u", "x"), (None, 1, "assistant", "v", "x"), (0, 0, "assistant", "same", "x"), (0, 0, "assistant", "same", "x"), (50, None, "assistant", "n", "x")]


def test_round_trip_and_one_example_per_target(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string").repartition(3)
    examples = expand(df)
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in read_back(examples).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        assert [tuple(t) for t in got[c].turns] == turns
        assert "".join(got[c].loss) == "".join(x for r, x in turns if r == "assistant")
    counts = Counter(r.conv_id for r in examples.collect())
    for c, turns in by.items():
        last = sorted(turns)[-1][2]
        assert counts[c] == sum(t[2] == "assistant" for t in turns) + (last != "assistant")
    assert expand(df.limit(0)).count() == 0
    assert "Python" not in examples._jdf.queryExecution().toString() and "Arrow" not in examples._jdf.queryExecution().toString()


def test_schedule_meets_all_deadlines_with_less_than_a_block_of_deviation(spark):
    counts = {"a": 500, "b": 120, "c": 120, "d": 7, None: 60}
    docs = spark.createDataFrame([(k * 1000 + i, s) for k, (s, n) in enumerate(counts.items()) for i in range(n)], "doc_id long, source string")
    for weights in (None, {"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.05, None: 0.05}):
        shared = shares(docs, weights, period=128)
        q = {r.skey: r.q for r in shared.collect()}
        assert sum(q.values()) == 128 and min(q.values()) >= 1
        table = sorted((r["at"], r["skey"], r["release"], r["deadline"]) for r in period_table(shared).collect())
        assert [t[0] for t in table] == list(range(128)) and all(r <= at < d for at, _, r, d in table)
        done = Counter()
        for at, key, _, _ in table:
            done[key] += 1
            assert all(abs(done[k] - q[k] * (at + 1) / 128) < 1 for k in q)


def test_every_row_has_a_place(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "t") for i in range(900)] + [(5, "hot", "t"), (None, "hot", "t"), (7, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string").repartition(5)
    got = mix(docs, block_mass=8, period=64).collect()
    assert Counter((r.row.doc_id, r.row.source) for r in got) == Counter((a, b) for a, b, _ in rows)
    places = [(r.slot, r.source_row) for r in got]
    assert len(set(places)) == len(places) and all(r.release <= r.slot < r.deadline for r in got)
    sizes = Counter((r.row.source, r.source_block) for r in got)
    assert all(n == 8 for (s, b), n in sizes.items() if (s, b + 1) in sizes)
    assert len({r.slot for r in got}) == len(sizes)
    assert mix(docs.limit(0)).count() == 0
    plan = mix(docs).orderBy(F.col("slot"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shares_follow_the_given_weights(spark):
    weights = {"a": 0.9999, "b": 0.0001}
    docs = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, source string")
    for given, blocks in ((weights, {"a": 20_000, "b": 10}), ({"a": 0.61803, "b": 0.38197}, {"a": 6_000, "b": 4_000})):
        counted = shares(docs, given).withColumn("blocks", F.when(F.col("skey") == "=a", blocks["a"]).otherwise(blocks["b"]).cast("long"))
        runs = sorted((r["at"], r["skey"][1:], r["release"], r["deadline"]) for r in schedule(counted).collect())
        assert len({at for at, *_ in runs}) == len(runs) == sum(blocks.values()) and all(r <= at < d for at, _, r, d in runs)
        done = Counter()
        for at, key, _, _ in runs:
            for k, w in given.items():  # before and after the slot, while a source has blocks
                assert done[k] == blocks[k] or abs(done[k] - w * at) < 1 + 1e-6
            done[key] += 1
            assert abs(done[key] - given[key] * (at + 1)) < 1 + 1e-6


def test_sources_without_weight_come_last(spark):
    docs = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(160)], "doc_id long, source string")
    got = mix(docs, {"a": 0.7, "b": 0.3, "c": 0.0}, block_mass=8).collect()
    assert len(got) == 160 and len({(r.slot, r.source_row) for r in got}) == 160
    assert max(r.slot for r in got if r.row.source in "ab") < min(r.slot for r in got if r.row.source in "cd")
    assert mix(docs, {}).count() == 160


def deviations(got, weight, size):
    """By how many blocks of mass each source is off its weight after each slot, and by how much its rows may stand over."""
    runs, done = {}, Counter()
    for r in got:
        runs.setdefault(r.slot, []).append(r)
    last = {s: max(r.slot for r in got if r.row.source == s) for s in weight}
    longest = {s: max(r.row.mass or 0.0 for r in got if r.row.source == s) for s in weight}
    for at in range(max(last.values()) + 1):
        for r in runs.get(at, ()):
            done[r.row.source] += r.row.mass or 0.0
        for s, w in weight.items():
            if w and at < last[s]:
                yield (done[s] - w * (at + 1) * size) / size, longest[s] / size


def test_blocks_are_cut_by_mass_and_sources_keep_to_their_weights_in_mass(spark):
    rng = random.Random(11)
    sizes = {"a": (3000, lambda: rng.expovariate(1 / 90)), "b": (3000, lambda: 10.0), "c": (900, lambda: rng.choice([1.0, 700.0])), "d": (40, lambda: 0.0)}
    rows = [(k * 10_000 + i, s, None if i == 5 else float(m()), "x") for k, (s, (n, m)) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mass double, release string").repartition(6)
    total = {s: sum(m or 0.0 for _, t, m, _ in rows if t == s) for s in sizes}
    weight = {s: m**0.5 / sum(x**0.5 for x in total.values()) for s, m in total.items()}
    for options, size in (({"block_mass": 500.0, "blocks": 10**9}, 500.0), ({"blocks": 256}, sum(total.values()) / 256)):
        got = mix(docs, mass="mass", **options).collect()
        assert len(got) == len(rows) and len({(r.slot, r.source_row) for r in got}) == len(rows)
        assert all(-1 - 1e-6 < off < 1 + over + 1e-6 for off, over in deviations(got, weight, size))
        assert all(r.release <= r.slot < r.deadline for r in got)
        by_source = {}
        for r in sorted(got, key=lambda r: r.source_row):
            by_source.setdefault(r.row.source, []).append(r)
        for own in by_source.values():  # laid end to end, and in that order in the mix
            assert [r.source_row for r in own] == list(range(len(own))) and all(a.slot <= b.slot for a, b in zip(own, own[1:], strict=False))
            at = 0.0
            for r in own:
                assert abs(r.starts - at) < 1e-6 * (1 + at)
                at += r.row.mass or 0.0
        assert min(r.slot for r in got if r.row.source == "d") > max(r.slot for r in got if r.row.source != "d")


def test_the_schedule_is_bounded_whatever_the_rows(spark):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = mix(docs, blocks=300).groupBy("row.source", "source_block").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots")).collect()
    assert 300 <= len(got) <= 310 and all(r.slots == 1 for r in got) and max(r.n for r in got) <= 668


def test_a_long_conversation_expands_turn_by_turn(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} <|end|>") for t in range(300)]
    examples = expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert examples.count() == 150
    got = read_back(examples).first()
    assert [tuple(t) for t in got.turns] == [(r, x) for _, _, r, x in rows] and got.loss == [x for _, t, r, x in rows if t % 2]
