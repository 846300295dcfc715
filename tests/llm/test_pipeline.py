"""The pipeline, stage by stage, against brute force on a small corpus."""

import random
import tempfile

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from docquill.llm.common import saved
from docquill.llm.tokens import PieceCounts, WordIds
from test_operators import brute_components, brute_fingerprint, brute_hits, brute_lines, brute_rules, crc


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = ["\n".join(line(rng.randint(8, 30)) for _ in range(rng.randint(2, 6))) for _ in range(40)]
    w = texts[3].split()
    texts += [texts[0], texts[1], texts[2] + "\n" + line(12), " ".join(w[:7] + ["edit"] + w[8:]), line(5), None, "",
              "same " * 60, "### $$$ " * 30 + line(30), texts[4].split("\n")[0] + "\n" + line(30), line(400)]
    texts += [line(20) + " " + " ".join(texts[5].split()[:15]) + " " + line(20)]
    bench = [("7", " ".join(texts[5].split()[2:14])), ("8", line(12)), ("9", None)]
    return texts, bench


def test_every_stage(spark):
    texts, bench = corpus()
    sf_dir = tempfile.mkdtemp(prefix="docquill-pipeline-")
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{sf_dir}/benchmark.parquet")

    docs, got = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir))
        got.append(docs.collect())
        if name != "packing":
            assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()

    now = {}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = brute_rules(t)
        lines = [x for x in (t or "").split("\n") if x.split()]
        if not (n < 20 or 100 * repeat > 30 * n or 10 * symbols > 3 * n or not 2 * n <= chars <= 15 * n or 2 * dup > len(lines)):
            now[i] = t
    assert {r.doc_id: r.text for r in got[0]} == now and 0 < len(now) < len(texts)

    gone = brute_lines(sorted(now.items()))
    now = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in now.items()}
    assert {r.doc_id: r.text for r in got[1]} == now and all(r.n_chars == len(r.text) for r in got[1]) and gone

    ids = sorted(now)
    root = brute_components([brute_fingerprint(now[i]) for i in ids])
    now = {ids[k]: now[ids[k]] for k in range(len(ids)) if root[k] == k}
    assert {r.doc_id: r.text for r in got[2]} == now and len(now) < len(ids)

    clean = {i: t for i, t in now.items() if not brute_hits(t, bench)[1]}
    assert {r.doc_id: r.text for r in got[3]} == clean and len(clean) < len(now)

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in clean.items()}
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got[4]) == sorted((i, len(x), crc(x)) for i, x in tokens.items())
    assert len({r.sequence_id for r in got[4]}) == -(-sum(map(len, tokens.values())) // 4096)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length").collect())) == sorted(
        (r.doc_id, r.piece, r.length) for r in got[4])


@pytest.mark.parametrize("kept", [40, 100_000])
def test_words_alone_give_the_libraries_ids(monkeypatch, kept):
    """Texts tokenized word by word against the whole text, with a small and a large memory."""
    from docquill.llm import tokens
    monkeypatch.setattr(tokens, "WORDS", kept)
    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    pieces = PieceCounts(public_tokenizers.path("piece_bpe_32k.model"))
    assert ids.plain and pieces.by_word
    rng = random.Random(4)
    parts = ["a", "B", "é", "́", "̣", " ", "  ", "\n", "▁", "🙂", "ß", "<|endoftext|>", "　", "1", "'s", "\x1f", "\x85",
             "ᅡ", "ᄀ", "漢", "̈́", ".", "the", "in", ",", "À", "×", "!", "Ø", "\t", "\x00", "</s>", "x" * 70]
    texts = ["", " ", "a" + " " * 70 + "b" + " " * 33] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1500)]
    for t in texts:
        assert ids.ids(pa.array([t]), 7)[0].tolist()[:-1] == ids.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
        assert pieces.count(t) == len(pieces.model.encode(t)), repr(t)
