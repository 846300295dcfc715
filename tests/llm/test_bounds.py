"""Long texts in linear time and bounded memory, and columns whose names meet the operators' own."""

import gc
import re
import resource
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquill.llm import line_crf, line_dedup, secret_scan, simhash, tokens
from docquill.llm.tokens import WordIds


def checksums(n):
    rng = np.random.default_rng(0)
    return "\n".join(f'password_hash = "{rng.bytes(16).hex()}" key {rng.bytes(12).hex()}=Zk3{rng.bytes(9).hex()}' for _ in range(n))


def test_checksum_lists_in_linear_time():
    def seconds(text):
        best = 1e9
        for _ in range(2):
            began = time.process_time()
            base = secret_scan.base_spans(text)
            found = secret_scan.candidates(text, base)
            best = min(best, time.process_time() - began)
        assert len(base) > text.count("\n") and found
        return best

    small, large = checksums(1500), checksums(12_000)
    assert len(large) > 1 << 20
    assert seconds(large) < 16 * seconds(small) + 0.5      # eight times the text; the square would be 64


def test_covered_by_any_earlier_span():
    text = "secret token " + "a1" * 20
    c = text.index("a1")
    end = len(text)
    assert secret_scan.candidates(text, []) and not secret_scan.candidates(text, [(0, 0, end)])
    assert not secret_scan.candidates(text, [(0, 0, end), (c - 3, 1, c - 1)])
    assert secret_scan.candidates(text, [(0, 0, end - 1), (c + 1, 1, end)])


def test_blocks_give_the_marginals_of_whole_chains(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([1, 3, 4, 5, 8, 9, 50, 2, 33])
    score, trans = rng.normal(size=lengths.sum()) * 3, rng.normal(size=(2, 2))
    whole = line_crf.marginals(score, lengths, trans)
    for block in (1, 2, 4, 7, 1000):
        monkeypatch.setattr(line_crf, "BLOCK", block)
        assert np.allclose(line_crf.long_marginals(score, lengths, trans), whole, atol=1e-12)


def test_chunks_give_the_features_of_whole_texts(monkeypatch):
    lines = ["A line, of words.", "", "### | ###", "A line, of words.", "so so so so so so so so so so"] * 7
    rng = np.random.default_rng(2)
    model = line_crf.Model(rng.normal(size=3 * line_crf.N_OWN + 1), np.zeros((2, 2)))
    expected = line_crf.chain(line_crf.line_features(lines)) @ model.weights
    for chunk in (1, 4, 5, 4096):
        monkeypatch.setattr(line_crf, "CHUNK", chunk)
        assert np.allclose(model.potentials(lines), expected)


def test_a_million_lines_in_bounded_memory():
    text = "\n".join(["some words of a line", "x"] * 500_000)
    rng = np.random.default_rng(3)
    model = line_crf.Model(rng.normal(size=3 * line_crf.N_OWN + 1), np.zeros((2, 2)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    score = model.scores([text, "one line"])
    assert ((0 <= score) & (score <= 1)).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10     # kB; 46 features a line took 785 MB


OWN = ["_id", "_th", "_gid", "_gth", "_dropped", "_text_hash", "_keep_id", "_keep_hash", "row", "id", "th", "dropped",
       "gone_id", "gone_th", "keep_id", "keep_hash", "text_hash", "k", "fp", "root", "component", "with.dot"]


def clashing(spark, rows):
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    return d.select(*[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in OWN], "doc_id", "text")


def test_clashing_columns_stay(spark):
    line = "one two three four five six seven eight"
    rows = [(1, line + "\nfirst own line here"), (2, line + "\nsecond words of another text"), (3, None), (4, "")]
    for out, n in ((line_dedup.dedup_lines(clashing(spark, rows), dropped_col=None), 4), (simhash.one_of_each(clashing(spark, rows + [(5, rows[0][1])])), 3)):
        got = out.collect()
        assert out.columns == [*OWN, "doc_id", "text"] and len(got) == n
        assert all(r[k] == f"{c}{r['doc_id']}" for r in got for k, c in enumerate(OWN))
    text = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(clashing(spark, rows)).collect()}
    assert text == {1: rows[0][1], 2: "second words of another text", 3: None, 4: ""}
    named = line_dedup.dedup_lines(clashing(spark, rows))
    assert named.columns == [c for c in OWN if c != "_dropped"] + ["doc_id", "text", "_dropped"]
    assert {r["doc_id"]: r["_dropped"] is not None for r in named.collect()} == {1: False, 2: True, 3: False, 4: False}


def test_lines_are_cleaned_once(spark):
    """A filter on the lines repeats none of the work that makes them."""
    texts = ["a b\n\n  c\td \x0b\n \n\r\ne  f  g\x0c", " x \n y", "\n", "", "one", "a b   c", "a \n \n b", "\t\t\n \t z", None]
    d = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, th long, text string")
    lines = line_dedup._lines(d)
    got = sorted((r["id"], r["pos"], r["line"], r["n"]) for r in lines.collect())
    words = lambda x: [w for w in re.split("[\x20\x09-\x0D]+", x) if w]
    assert got == sorted((i, p, " ".join(words(x)), len(words(x))) for i, t in enumerate(texts) if t is not None
                         for p, x in enumerate(t.split("\n")) if words(x))
    plan = lines.where("n >= 5").select(F.xxhash64("line"))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("trim(") == 1


@pytest.mark.parametrize("mark", ["", "_"])
def test_a_remembered_word_takes_few_bytes(mark):
    """All that a worker keeps after a slice of 60,000 new words: under 100 bytes for each; as Python objects some 130."""
    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    letters = str.maketrans("0123456789", "bcdfghjklm")
    text = pa.array([" ".join(f"{k:07d}".translate(letters) + mark for k in range(60_000))])
    ids.ids(pa.array(["a a_"]), 1)
    gc.collect()
    tracemalloc.start()
    try:
        arrow = pa.total_allocated_bytes()
        got, n = ids.ids(text, 1)
        assert n.tolist() == [len(got)]
        del got, n
        gc.collect()
        grown = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert grown < 60_000 * 100


def test_one_slice_of_new_words_does_not_outgrow_the_table(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 100)
    known = tokens.KnownIds(lambda words: [np.array([int(w), len(w)], "<u4").tobytes() for w in words])
    for low, high in ((0, 50), (40, 90), (30, 2000), (0, 3), (1990, 2100), (10, 20)):
        got = known.of(pa.array(map(str, range(low, high)), pa.large_string()))
        assert got.flat.tolist() == [x for k in range(low, high) for x in (k, len(str(k)))] and len(known.words) <= 100
    assert len(known.of(pa.array([], pa.large_string())).n) == 0
