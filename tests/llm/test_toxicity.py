"""The toxicity network: gradients against differences, windows against enumeration, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquill.llm import toxicity as T


def test_gradients():
    rng = np.random.default_rng(0)
    texts = ["you are an idiot", "a fine day", "idiots! all of them are so and so", ""]
    codes, sizes, distinct = T.encoded(texts)
    words, at, grams = T.inputs(distinct)
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(distinct)))])
    sample = (codes, words, first, grams)
    _, begin, size = T.windows(sizes)
    p = {k: (v + rng.normal(size=v.shape) * 0.3).astype(np.float64) for k, v in T.start().items()}
    y = np.array([1, 0, 1, 0], np.float64)
    loss, g = T.gradients(p, sample, begin, size, y)
    for name, x in p.items():
        flat, slope = x.reshape(-1), np.asarray(g[name]).reshape(-1)
        places = np.argsort(-np.abs(slope))[:3]
        for k in places:
            old, step = flat[k], 2e-3
            flat[k] = old + step
            up, _ = T.gradients(p, sample, begin, size, y)
            flat[k] = old - step
            down, _ = T.gradients(p, sample, begin, size, y)
            flat[k] = old
            assert slope[k] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=2e-4), name


def test_windows_cover_every_word():
    sizes = np.array([1, 5, T.WINDOW, T.WINDOW + 1, T.WINDOW + T.STRIDE, 500])
    text, at, size = T.windows(sizes)
    begin = np.cumsum(sizes) - sizes
    for k, n in enumerate(sizes):
        own = [(a - begin[k], s) for t, a, s in zip(text, at, size) if t == k]
        assert {w for a, s in own for w in range(a, a + s)} == set(range(n))
        assert all(s == min(n, T.WINDOW) for _, s in own)
        if n > T.WINDOW:
            assert all(b[0] - a[0] <= T.STRIDE for a, b in zip(own, own[1:])) and own[-1][0] + T.WINDOW == n


def test_windows_side_by_side_score_as_alone():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "ünd", "worthless"]) + str(rng.randrange(9)) for _ in range(n))
             for n in (0, 1, 7, 31, 32, 33, 80, 200)]
    p = {k: (v + np.random.default_rng(2).normal(size=v.shape) * 0.2).astype(np.float32) for k, v in T.start().items()}
    model = T.Model(p)
    together = model.scores(pa.array(texts))
    assert np.allclose(together, [model.scores(pa.array([t]))[0] for t in texts], atol=1e-5)
    # A text cut into pieces scores as its windows do; every piece begins with the window before it.
    old, T.SLICE_BYTES = T.SLICE_BYTES, 300
    try:
        pieces = [p for run in T._cut(pa.array([texts[-1]]), 300) for p in run]
        assert len(pieces) > 2 and all(len(a[1].split()) for a in pieces)
        joined = pieces[0][1].split()
        for _, piece in pieces[1:]:
            words = piece.split()
            overlap = max(k for k in range(len(words) + 1) if joined[len(joined) - k:] == words[:k])
            assert overlap >= T.WINDOW - 1
            joined += words[overlap:]
        assert joined == texts[-1].split()
    finally:
        T.SLICE_BYTES = old


def toy(n, seed=0):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["th", "en", "on", "er", "st", "la", "mi"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.4)
        if toxic:
            for _ in range(1 + len(words) // 60):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum,", "Moron", "lostra" + rng.choice(plain)])
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = toy(700)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    return rows, T.train(docs, labels)


def odd(spark, rows):
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return d.select("*", *[F.lit(1).alias(c) for c in ("id", "t", "y", "run", "score", "toxic")])


def test_held_out_accuracy(spark, trained):
    rows, model = trained
    got = {r["id"]: r["score"] for r in T.toxicity(odd(spark, [(i, t) for i, t, _ in rows]), model).collect()}
    out = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == bool(y) for i, y in out)
    assert len(out) > 100 and right / len(out) > 0.95
    assert all(0 <= s <= 1 for s in got.values())


def test_odd_rows(spark, trained):
    model = trained[1]
    long = " ".join(["then onst"] * 60_000 + ["idiot"] + ["lami"] * 10)
    rows = [(1, None), (1, ""), (None, " \n "), (2, "idiot"), (3, "IDIOT!!"), (4, "x" * 200_000), (5, long), (6, "\x01 \x00 <> ***")]
    got = T.toxicity(odd(spark, rows), model).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r["score"] for r in got}
    empty = [r["score"] for r in got if r["id"] in (1, None)]
    assert len(set(empty)) == 1
    assert by[2] == by[3] > 0.3 and by[5] > 0.3
    assert T.toxicity(odd(spark, []), model).collect() == []


def test_labels(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(8)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert T.train(docs, none).scores(pa.array(["a", None])).tolist() == [0, 0]
    ones = spark.createDataFrame([(i, 1) for i in range(8)] + [(None, 0), (9, None)], "doc_id bigint, toxic int")
    assert T.train(docs, ones).scores(pa.array(["a"])).tolist() == [1]


def test_held_out_rows_never_train(spark):
    rows = toy(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    keep = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    flipped = [(i, 1 - y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    make = lambda r: T.train(docs, spark.createDataFrame(r, "doc_id bigint, toxic int"))
    a, b = make(keep), make(keep + flipped)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
