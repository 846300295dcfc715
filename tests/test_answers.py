"""Answers that are kept: what is sent again, and what is not."""

import os
import uuid
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from docquill.operators.annotate import Answer, Provider
from docquill.operators.answers import AnswerStore, request_key


@dataclass
class Counting(Provider):
    """Leaves a file for every call; fails for prompts named in ``fails``."""
    folder: str
    fails: tuple = ()

    def complete(self, prompt, model, max_tokens, params):
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        if prompt in self.fails:
            raise RuntimeError("down")
        return Answer(text=f"{prompt}/{model}/{max_tokens}", prompt_tokens=1, completion_tokens=1)


@pytest.fixture()
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()

    def made():
        got = sorted((folder / f).read_text() for f in os.listdir(folder))
        for f in os.listdir(folder):
            os.unlink(folder / f)
        return got
    return str(folder), made


def requests(spark, prompts, model="gpt-4"):
    rows = [(f"p{k}", f"u{k}", p, model, 5) for k, p in enumerate(prompts)]
    return spark.createDataFrame(rows, "path string, identifier string, prompt string, model string, max_tokens int").repartition(3)


def test_only_new_requests_are_sent(spark, tmp_path, calls):
    folder, made = calls
    store = AnswerStore(spark, str(tmp_path / "store"))
    first = store.annotate(requests(spark, ["a", "b", "a", "c"]), Counting(folder), run="1")
    assert made() == ["a", "b", "c"]                # equal requests are one call
    for _ in range(2):                              # every output reads the files
        assert sorted((r["path"], r["answer"], r["run"]) for r in first.collect()) == [
            ("p0", "a/gpt-4/5", "1"), ("p1", "b/gpt-4/5", "1"), ("p2", "a/gpt-4/5", "1"), ("p3", "c/gpt-4/5", "1")]
    assert made() == []
    again = AnswerStore(spark, str(tmp_path / "store")).annotate(requests(spark, ["c", "d"]), Counting(folder), run="2")
    assert made() == ["d"] and sorted((r["answer"], r["run"]) for r in again.collect()) == [("c/gpt-4/5", "1"), ("d/gpt-4/5", "2")]
    store.annotate(requests(spark, ["a"], model="other"), Counting(folder)).collect()
    store.annotate(requests(spark, ["a"]), Counting(folder), version="next").collect()
    assert made() == ["a", "a"]


def test_failed_requests_are_sent_again(spark, tmp_path, calls):
    folder, made = calls
    store = AnswerStore(spark, str(tmp_path / "store"))
    first = store.annotate(requests(spark, ["a", "b"]), Counting(folder, fails=("b",)), run="1").collect()
    assert sorted((r["answer"], r["error"], r["run"]) for r in first if r["error"]) == [(None, "RuntimeError: down", None)]
    assert made() == ["a", "b"]
    second = store.annotate(requests(spark, ["a", "b"]), Counting(folder), run="2").collect()
    assert made() == ["b"] and sorted((r["answer"], r["run"]) for r in second) == [("a/gpt-4/5", "1"), ("b/gpt-4/5", "2")]


def test_nothing_to_send(spark, tmp_path, calls):
    folder, made = calls
    store = AnswerStore(spark, str(tmp_path / "store"))
    assert store.annotate(requests(spark, ["x"]).limit(0), Counting(folder)).collect() == []
    assert made() == []


def test_keys_tell_fields_apart(spark):
    rows = [("ab", "c", 1), ("a", "bc", 1), ("a", None, 1), ("a", "", 1), ("a", "-", 1), (None, "a", 1), ("a", "c", None)]
    df = spark.createDataFrame(rows, "prompt string, model string, max_tokens int")
    keys = [r[0] for r in df.select(request_key("prompt", "model", "max_tokens")).collect()]
    assert len(set(keys)) == len(rows)
