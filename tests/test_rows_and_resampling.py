"""Keyed draws, refined temperature, checked joins, range joins, noise copies, epochs and numbered rows."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.functions import text as X
from routeloom.functions.noise import misheard
from routeloom.operators import calibrate, epochs, metrics, noise_spread, numbering, ranges


def test_keyed_multinomial_has_the_right_moments():
    counts = np.array([5000, 300, 40, 7, 1, 0, 4652])
    draws = metrics.multinomial(counts, 4000, "moments")
    assert (draws.sum(axis=1) == counts.sum()).all() and (draws >= 0).all()
    n, p = counts.sum(), counts / counts.sum()
    sd = np.sqrt(n * p * (1 - p))
    assert (np.abs(draws.mean(axis=0) - n * p) <= 4 * sd / math.sqrt(4000) + 1e-9).all()
    assert np.allclose(draws.std(axis=0), sd, rtol=0.06, atol=1e-9)
    assert (metrics.multinomial(counts, 5, "moments") == draws[:5]).all(), "the same keys give the same draws"


def test_small_binomials_follow_their_distribution():
    u = (np.arange(20000) + 0.5) / 20000
    for m, p in [(10, 0.3), (10, 0.8), (200, 0.02), (1, 0.5), (0, 0.4)]:
        k = metrics.binomial(np.full(len(u), m), p, u, u)
        want = [math.comb(m, j) * p**j * (1 - p) ** (m - j) for j in range(m + 1)]
        got = np.bincount(k, minlength=m + 1) / len(u)
        assert np.abs(got - want).max() < 2e-4


def test_temperature_within_a_millionth_of_a_fine_search(spark):
    rng = random.Random(3)
    rows = [([rng.gauss(0, 3) + (2 if j == i % 4 else 0) for j in range(4)], i % 4 if rng.random() < 0.8 else (i + 1) % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "logits array<double>, y int")
    t, loss, grid = calibrate.temperature(df)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def nll(temp):
        z = x / temp
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    low, high = grid / 1.1, grid * 1.1
    for _ in range(100):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if nll(a) < nll(b) else (a, high)
    assert abs(t - low) < 1e-6 * 10 and nll(t) <= nll(low) + 1e-12 and abs(loss - nll(t)) < 1e-9
    assert calibrate.temperature(df.limit(0)) == (1.0, 0.0, 1.0)
    # separable rows: the loss falls for ever, the range of the grid ends it
    sure = spark.createDataFrame([([5.0, 0.0], 0), ([0.0, 5.0], 1)], "logits array<double>, y int")
    assert 0.05 - 1e-9 <= calibrate.temperature(sure)[0] <= 20


def test_joined_predictions_raise_in_the_job(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, y string")
    preds = lambda xs: spark.createDataFrame(xs, "id long, p string")
    assert sorted(map(tuple, metrics.joined(rows, preds([(3, "z"), (1, None)])).collect())) == [(1, "a", None), (3, "c", "z")]
    for bad, said in [([(1, "x"), (1, "x")], "more than one prediction for id 1"), ([(9, "x")], "unknown id: 9"), ([(None, "x")], "unknown id: null")]:
        with pytest.raises(Exception, match=said):
            metrics.joined(rows, preds(bad)).collect()
    assert metrics.joined(rows, preds([])).count() == 0


def test_range_join_against_all_pairs(spark):
    rng = random.Random(7)
    make = lambda n, far: [(rng.randrange(3), i, (s := rng.randrange(300)), s + rng.choice([0, 1, 5, 40, far])) for i in range(n)]
    a, b = make(80, 200), make(60, 90)
    schema = 'k int, pos int, start int, "end" int'.replace('"', "`")
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and x[3] > y[2])
    for width in (1, 16, 1000):
        got = ranges.overlapping(left, right, "k", width).select("k", "a.pos", F.col("b.pos").alias("other")).collect()
        assert sorted(map(tuple, got)) == want
    tags = {r.pos: r.tag for r in ranges.tagged(spark.createDataFrame([(1, i, 4 * i, 4 * i + 3) for i in range(8)], schema), spark.createDataFrame([(1, 5, 14, "x"), (1, 20, 22, "y")], "k int, start int, `end` int, label string"), "k", 4).collect()}
    assert tags == {1: "B-x", 2: "I-x", 3: "I-x", 5: "B-y"}


def test_noise_copies_against_tries_in_turn(spark):
    texts = ["please call the office", "turn on the heater to four", "mute the radio by eight", "zz qq", "can you play the note"]
    lines = [(s, k, texts[(s + k) % 5]) for s in range(6) for k in range(s)] + [(9, 0, "zz qq")]
    avoid = [(s, t) for s, _, t in lines] + [(4, "Turn on heater to four")]
    n, tries = 4, 2
    df = spark.createDataFrame(lines, "seed_id long, k long, text string")
    got = noise_spread.spread(df, spark.createDataFrame(avoid, "seed_id long, text string"), n, tries=tries).collect()
    norm = {t: v for t, v in spark.createDataFrame([(t,) for _, t in avoid], "t string").select("t", X.normalize(F.col("t"))).distinct().collect()}
    want = []
    for s in {x[0] for x in lines}:
        own = sorted((x for x in lines if x[0] == s), key=lambda x: hashlib.md5(f"0/{s}/{x[1]}".encode()).hexdigest())
        asked = spark.createDataFrame([(t, own[t % len(own)][1], own[t % len(own)][2], f"{s}/{t}") for t in range(tries * n * len(own))], "t long, k long, text string, key string")
        heard = asked.select("t", "k", misheard(F.col("text"), F.col("key")).alias("h")).select("*", X.normalize(F.col("h")).alias("norm")).orderBy("t").collect()
        seen, copies, out = {norm[t] for a, t in avoid if a == s}, {}, []
        for r in heard:
            if len(out) == n or r.h is None or r.norm in seen:
                continue
            seen.add(r.norm)
            out.append((s, r.k, copies.get(r.k, 0), r.t, r.h))
            copies[r.k] = copies.get(r.k, 0) + 1
        want += out
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 8


def _dropped(text, spans, share, key):
    """One row at a time, by cutting the text."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    low = [int(hashlib.md5(f"{key}/{i}".encode()).hexdigest()[:8], 16) < int(share * 2**32) for i in range(len(words))]
    drop = [x and not any(a < e and b > s for s, e, _ in spans) for x, (a, b) in zip(low, words, strict=True)]
    if not any(drop) or all(drop):
        return text, list(spans)
    last = max(i for i, x in enumerate(drop) if not x)
    gone = set()
    for i, ((a, b), x) in enumerate(zip(words, drop, strict=True)):
        if x:
            gone |= set(range(a, words[i + 1][0]) if i < last else range(words[last][1], b))
    moved = [(s - sum(g < s for g in gone), e - sum(g < e for g in gone), label) for s, e, label in spans]
    return "".join(c for i, c in enumerate(text) if i not in gone), moved


def test_epochs_against_cut_texts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        text = "".join(rng.choice([" ", "  ", "", "\n"]) + rng.choice(["call", "é", "ravi", "kumar", "now", "4512", "to"]) for _ in range(rng.randrange(12))) + rng.choice(["", " ", " \n"])
        rows.append((i, text, [(m.start(), m.end(), "contact") for m in re.finditer("ravi(?: ?kumar)?", text)]))
    rows += [(100, "", []), (101, "   ", []), (102, "all go away", [])]
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<start:int,`end`:int,label:string>>")
    got = {(r.id, r.epoch): r for r in epochs.augmented(df, 4, word_dropout=0.5, context_dropout=0.3, seed="s").collect()}
    assert len(got) == 4 * len(rows)
    for i, text, spans in rows:
        for e in range(4):
            r = got[i, e]
            want = _dropped(text, spans, 0.5, f"s/{e}/{i}")
            assert (r.text, [tuple(s) for s in r.spans]) == want
            assert all(r.text[s.start : s.end] == text[a:b] for s, (a, b, _) in zip(r.spans, spans, strict=True)), "the inside of spans stays"
            assert len(r.tags) == len(r.text.split()) and r.keep_context == (int(hashlib.md5(f"s/{e}/{i}/context".encode()).hexdigest()[:8], 16) >= int(0.3 * 2**32))
    assert len({got[102, e].text for e in range(4)}) > 1, "epochs differ"
    same = epochs.augmented(df, 1).collect()
    assert {r.id: r.text for r in same} == {i: t for i, t, _ in rows} and all(r.keep_context for r in same)
    with pytest.raises(ValueError, match="word_dropout"):
        epochs.augmented(df, 1, word_dropout=1.5)


def test_numbers_and_digests(spark):
    rows = spark.range(0, 500).select((F.col("id") * 7919 % 500).alias("a"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).repartition(6)
    first = numbering.numbered(rows, ["a"])
    assert [(r.n, r.a) for r in first.orderBy("n").collect()] == [(i, i) for i in range(500)]
    more = spark.createDataFrame([(3, "x"), (1, None)], "a long, text string")
    both = numbering.appended(first, more, ["a"])
    assert [(r.n, r.a) for r in both.where("n >= 500").orderBy("n").collect()] == [(500, 1), (501, 3)]
    whole, prefix = numbering.digest(first, ["a", "text"]).first(), numbering.digest(both, ["a", "text"], below=500).first()
    assert tuple(whole) == tuple(prefix) and whole.rows == 500 and numbering.digest(both, ["a", "text"]).first() != whole
    changed = first.withColumn("text", F.when(F.col("n") == 250, F.lit("")).otherwise(F.col("text")))
    assert numbering.digest(changed, ["a", "text"]).first().digest != whole.digest
    swapped = first.withColumn("n", F.when(F.col("n") == 1, 2).when(F.col("n") == 2, 1).otherwise(F.col("n")))
    assert numbering.digest(swapped, ["a", "text"]).first().digest != whole.digest
    assert tuple(numbering.digest(first.limit(0), ["a"]).first()) == (0, "0") and numbering.numbered(rows.limit(0), ["a"]).count() == 0


def test_offsets_of_very_many_matches(spark):
    rng = random.Random(4)
    for n in (0, 1, X.SPAN_BLOCK, X.SPAN_BLOCK + 1, 5 * X.SPAN_BLOCK + 3):
        text = "".join(rng.choice([" ", "é ", "--"]) + str(rng.randrange(10 ** rng.randrange(1, 5))) for _ in range(n)) + rng.choice(["", " x"])
        got = spark.createDataFrame([(text,)], "t string").select(X.token_spans(F.col("t"), "[0-9]+").alias("s")).first().s
        assert [tuple(s) for s in got] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
    assert spark.createDataFrame([(None,)], "t string").select(X.token_spans(F.col("t"), "[0-9]+").alias("s")).first().s is None
    took = []
    for n in (20_000, 160_000):
        df = spark.createDataFrame([("7 " * n,)], "t string")
        start = time.perf_counter()
        assert df.select(F.size(X.token_spans(F.col("t"), "[0-9]+")).alias("n")).first().n == n
        took.append(time.perf_counter() - start)
    assert took[1] < 16 * took[0] + 2, took
