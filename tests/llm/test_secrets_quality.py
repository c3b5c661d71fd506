import random
import re
import time
from collections import Counter
from itertools import accumulate

import numpy as np

from sparkloom.llm.cotrain_quality import FEATURES, PACKED, _features, _packed, _unpacked_ids, score, thresholds
from sparkloom.llm.cotrain_quality import train as train_quality
from sparkloom.llm.markov_secrets import ALPHABETS, KINDS, find_secrets, generated, held_out, pairs, ratio, ratio_table, samples, scan, train

WORDS = "the of and configuration management internationalization_settings get_user_by_identifier telecommunications response handler running because"


def ordinary(n=400, seed=1):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS.split()) for _ in range(n)) + " 4417744280351547 2024-01-02 " * 20


def base_by_the_book(text):
    out = []
    for k, (p, f) in enumerate((
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )):
        out += [(m.start(), k, m.end()) for m in p.finditer(text) if f(m)]
    return sorted(out)


def test_base_spans_stay_as_the_patterns_give_them():
    rng, table = random.Random(2), np.zeros((68, 68))
    bits = ["password: ", "Secret=", "token", "API_KEY='", "apikey = ", "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "=", "==x", "abc.def", "é", " ", "\n", "ſecret: abcdefghij", "toKen:12345678"]
    for _ in range(500):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert [s for s in scan(x, table, 16, 12.0) if s[1] < 3] == base_by_the_book(x)


def test_random_strings_stand_out_from_identifiers():
    table = ratio_table(pairs(ordinary().encode()), np.zeros(68 * 68))
    rng = random.Random(99)
    keys = ["".join(rng.choices(a, k=rng.randint(24, 48))) for a in ALPHABETS for _ in range(100)]
    assert sum(ratio(table, k) > 12 for k in keys) >= 0.98 * len(keys)
    assert not any(ratio(table, w) > 12 for w in WORDS.split()) and ratio(table, "4417744280351547") < 12


def test_spans_over_a_table(spark):
    rng = random.Random(4)
    key = "".join(rng.choices(ALPHABETS[3], k=40))
    rows = [(i, ordinary(60, i)) for i in range(40)] + [(100, f"é {key} end"), (101, None), (102, ""), (103, f"token = {key}"), (103, f"token = {key}")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int").repartition(3)
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in find_secrets(df, table=train(df.filter("doc_id < 100"))).collect()]
    by = dict(got)
    assert by[100] == [("markov", 2, 42)] and by[101] == by[102] == [] and by[103] == [("assign", 0, 48)] and len(got) == len(rows)
    assert all(not s for i, s in got if i < 100)
    assert find_secrets(df.limit(0)).count() == 0 and train(df).shape == (68, 68) and KINDS[3] == "markov" and generated() == generated()


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice(["good", "good", "good", "junk", "toxic"])
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        if kind == "junk":
            words = [w.upper() + "!!!" for w in words]
        if kind == "toxic":
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["insultone", "insulttwo"])
        docs.append((i, " ".join(words), rng.choice(["s1", "s2"]) if kind == "good" else rng.choice(["s2", "s3"]), "en", "clash"))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = corpus(1200, 5)
    extra = [(None, None, None, None, "x"), (5000, "", None, "en", "x"), (5001, "word1 " * 20000, "s1", "en", "x"), (3, docs[3][1], "s1", "en", "x")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, source string, lang string, quality string").repartition(4)
    lab = spark.createDataFrame([*labels[:500], (None, 1, 0), (2, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = score(d, lab, labelled=400, carry=True).collect()
    assert len(got) == len(docs) + len(extra) and got[0].row.quality in ("clash", "x")
    truth = {i: q == 1 and t == 0 for i, q, t in labels[500:]}
    right = [r.keep == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert sum(right) / len(right) > 0.93
    assert all(0 <= r.quality <= 1 for r in got)


def test_without_labels_everything_is_kept(spark):
    docs, _ = corpus(20, 1)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, quality string")
    got = score(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 20 and all(r.keep and r.quality == 0.5 for r in got)
    assert score(d.limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_both_views_teach_each_other_from_all_rows(spark):
    docs, labels = corpus(700, 8)
    docs += [(3, f"again {k}", "s1", "en", "x") for k in range(3000)]  # one labelled document very often
    docs += [(None, f"word{k} word{k + 1}", "s2", "en", "x") for k in range(50)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, quality string").repartition(4)
    lab = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    model, again = (train_quality(x, lab, labelled=300) for x in (d, d.repartition(7)))
    assert len(model["exchanged"]) == 3
    for to_text, to_meta in model["exchanged"]:
        assert to_text[2] == to_meta[2] == 450  # every unlabelled row is scored and counted
        assert to_text[1] > 20 and sum(to_meta[:2]) > 20  # the metadata view is sure of junk, the text view of its words
    assert model["exchanged"] == again["exchanged"] and all((a == b).all() for a, b in zip(model["weights"], again["weights"], strict=True))
    assert model["right"][2] >= max(model["right"][:2]) - 0.05


def test_rounds_do_not_harm_documents_without_labels(spark):
    # few labels, many unlabelled documents: what the views teach each other must not cost accuracy
    docs, labels = corpus(1500, 21)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, quality string").repartition(4)
    lab = spark.createDataFrame(labels[:160], "doc_id long, quality int, toxic int")
    truth = {i: q == 1 and t == 0 for i, q, t in labels[160:]}
    right = {}
    for rounds in (0, 3):
        got = [r.keep == truth[r.doc_id] for r in score(d, lab, rounds=rounds).collect() if r.doc_id in truth]
        right[rounds] = sum(got) / len(got)
    assert right[3] > 0.85 and right[3] >= right[0] - 0.02


def test_sure_thresholds_keep_their_precision():
    rng = np.random.default_rng(3)
    truth = (rng.random(400) < 0.7).astype(float)
    p = np.clip(truth * 0.5 + rng.random(400) * 0.5, 0, 1)
    low, high = thresholds(p, truth, 0.95, 5)
    assert truth[p >= high].mean() >= 0.95 and (1 - truth[p <= low]).mean() >= 0.95 and (p >= high).sum() >= 5
    assert thresholds(rng.random(400), truth * 0, 0.95, 5)[1] == np.inf  # never sure of what it has not seen


def test_planted_secrets_without_a_name_are_added(spark):
    rng = random.Random(12)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    planted = {}
    for k in range(0, len(docs), 4):
        i, text = docs[k]
        key = "".join(rng.choices(ALPHABETS[3] if k % 8 else ALPHABETS[4], k=rng.randint(28, 48)))
        planted[i] = (len(text) + 1, len(text) + 1 + len(key))
        docs[k] = (i, f"{text} {key} {text[:40]}")
    got = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "markov"} for r in find_secrets(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    caught = sum(planted[i] in got[i] for i in planted)
    assert caught >= 0.95 * len(planted)
    assert sum(bool(got[i]) for i, _ in docs if i not in planted) <= 0.02 * len(docs)


def test_a_long_text_with_many_secrets_takes_linear_time():
    table = ratio_table(pairs(ordinary().encode()), np.zeros(68 * 68))
    text = "\n".join(f"token = {k:032x} zzzz" for k in range(20_000))
    began = time.perf_counter()
    ordinary_, values = samples(text)
    spans = scan(text, table, 16, 12.0)
    assert time.perf_counter() - began < 20
    assert sum(s[1] == 0 for s in spans) == 20_000 and not any(s[1] == 3 for s in spans) and values.sum() > 600_000 and ordinary_.sum() < len(text)


def test_measures_of_a_table_that_was_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = held_out(docs)
    assert found["recall"] >= 0.9 and found["false_rate"] <= 0.1 and found["runs"] > 20, found


def test_packed_features_are_those_of_the_texts(spark):
    rng = random.Random(2)
    rows = [(i, None, " ".join(rng.choice(["a", "b", "ccc", "é", "--"]) for _ in range(rng.randint(0, 40))) or None, "s", "en") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, good int, text string, source string, lang string").coalesce(1)
    plain = table.mapInArrow(_features, FEATURES).toArrow().combine_chunks()
    packed = table.mapInArrow(_packed, PACKED).toArrow().combine_chunks()
    for k in range(60):
        ids, steps, times = (c[k].as_py() for c in (plain["ids"], packed["steps"], packed["times"]))
        assert Counter(ids) == dict(zip(accumulate(steps), times, strict=True)) and plain["meta"][k] == packed["meta"][k]
    flat, cuts = packed["steps"].combine_chunks().flatten().to_numpy(), packed["steps"].combine_chunks().offsets.to_numpy()
    assert [list(_unpacked_ids(flat, cuts)[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)] == [sorted(set(x)) for x in plain["ids"].to_pylist()]
