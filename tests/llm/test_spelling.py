"""Spelling variants against brute force over all pairs of words."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docquill.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a) + 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_words(rows, damage=True):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute_variants(n):
    out = {}
    for w in n:
        links = [v for v in n if near(w, v)]
        form = min(links, key=lambda v: (-n[v], v), default=None)
        form = form if form is not None and n[form] >= 10 * n[w] else None
        out[w] = [form, None, n[w], len(links), n[form] if form else None]
    for w in out:
        r = w
        while out[r][0] is not None:
            r = out[r][0]
        out[w][1] = r
    return {w: tuple(v) for w, v in out.items()}


def of(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def some_texts():
    rng = random.Random(3)
    base = ["misspell", "täglich", "ÀÉîøüßx", "aaaaaaaa", "ababababab", "Wonderful", "x" * 63, "y" * 64, "z" * 65, "ab" * 50]
    letters = "abxyzäÀ"

    def edit(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]])

    pool = base + [edit(w) for w in base for _ in range(6)] + [edit(edit(w)) for w in base for _ in range(3)]
    pool += ["".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(50)]
    texts = [None, "", "  ", "1234567 _ ×÷", "short word"]
    for _ in range(120):
        texts.append(" ".join(rng.choice(pool) for _ in range(30)) + rng.choice(["", ".", "7", "\n"]))
    texts += [" ".join(["misspell"] * 400 + ["wonderful"] * 90), "-".join(["mispell", "wonderfull"] * 3)] * 2
    texts += [" ".join(["chainword"] * 150 + ["chainwort"] * 12), " chaimwort"] * 4
    return texts


TEXTS = some_texts()


def frame(spark, rows):
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return d.select("*", *[F.lit(1).alias(c) for c in ("word", "n", "id", "run", "form", "a", "depth", "key")])


def test_against_brute_force(spark):
    rows = [*enumerate(TEXTS), (None, "misspell misspell misspelt misspelt"), (7, TEXTS[40])]
    expected = brute_variants(brute_words(rows))
    assert any(v[0] for v in expected.values()) and any(v[0] != v[1] != w for w, v in expected.items() if v[0])
    assert any(len(w) > 50 and v[3] for w, v in expected.items())
    assert of(spelling.variants(spelling.words(frame(spark, rows), damage=True), long=10)) == expected


def test_each_pair_once_whatever_the_partitions(spark):
    n = {w: c for w, c in brute_words([*enumerate(TEXTS)], damage=False).items()}
    words = sorted(n)
    expected = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if near(a, b)}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = [(r["a"], r["b"]) for r in spelling.near_words(df.repartition(parts), long=9).collect()]
            assert len(got) == len(expected) and {frozenset(p) for p in got} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_boundary_of_long_words(spark):
    base = "".join(random.Random(1).choices("abcdefgh", k=20))
    words = {base[:k] for k in range(8, 15)} | {base[:5] + "z" + base[6:k] for k in range(8, 15)}
    words |= {"q" * k for k in range(8, 15)}
    expected = {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}
    got = spelling.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint"), long=11).collect()
    assert len(got) == len(expected) and {frozenset((r["a"], r["b"])) for r in got} == expected


def test_a_very_long_run(spark):
    run = "".join(random.Random(2).choices("abcd", k=300_000))
    other = run[:200_000] + "z" + run[200_001:]
    rows = [(1, run), (2, run), (3, other), (4, other), (5, run[1:]), (6, run[1:])]
    got = of(spelling.variants(spelling.words(frame(spark, rows))))
    assert {w: v[3] for w, v in got.items()} == {run: 2, other: 1, run[1:]: 1}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(1, "lonelyword")]])
def test_nothing_to_find(spark, rows):
    assert spelling.variants(spelling.words(frame(spark, rows))).collect() == []
