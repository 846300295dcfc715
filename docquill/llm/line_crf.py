"""Document quality from a linear-chain conditional random field over lines.

Every line is a node with the states bad and good. Its features describe the
line and its two neighbours; transition weights tie neighbouring states. The
weights are fitted once, on the driver, to a bounded sample of labelled
documents (``TRAIN_DOCS`` ids, chosen by a hash of the id among rows
that are not held out, and at most twice as many rows where ids repeat, the
least by id and features; each line takes its document's label; of a document of
more than ``TRAIN_LINES`` lines a run of that many takes part, its place given
by a hash of the id). Scoring reads every whole text in Arrow batches:
forward-backward gives each line's probability of being good, and a
document's score is their mean weighted by line length.

Defined results: a null or empty text is one empty line and gets a score;
null ids are not held out and never used for training; repeated label rows
of an id count once (the lowest label); without labels every score is 0.5;
an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import read, ready
from docquill.llm.tokens import slices

TRAIN_DOCS = 4000
TRAIN_LINES = 64
STEPS = 250
L2 = 1e-3
SYMBOLS = "#*$%&|<>"
N_OWN = 15                  # features of a line itself
CHUNK = 4096                # lines whose features are held at a time
BLOCK = 256                 # lines of a chain that numpy steps through beside other blocks
SLICE_BYTES = 8 << 20       # text scored at a time; a longer text is scored alone


def line_features(lines: list[str], seen: set | None = None) -> np.ndarray:
    """(lines, N_OWN): shape of each line: size, case, symbols, repetition, end, earlier copies (``seen``: lines before these)."""
    rows, seen = [], set() if seen is None else seen
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            rows.append((0.0,) * (N_OWN - 1) + (1.0,))
            continue
        upper = sum(map(str.isupper, words)) / n
        symbols = min(2.0, sum(map(line.count, SYMBOLS)) / n)
        shouts = min(2.0, line.count("!") / n)
        repeated = 1 - len(set(words)) / n
        stutter = sum(map(eq, words, words[1:])) / n
        rows.append((min(1.0, n / 100), upper, symbols, shouts, repeated, stutter, min(3.0, len(line) / n / 10),
                     float(line[-1] in ".!?"), float(line in seen), float(upper > 0.5), float(symbols > 0.2),
                     float(shouts > 0.3), float(repeated > 0.5 and n > 8), float(stutter > 0.2), 0.0))
        seen.add(line)
    return np.array(rows, np.float64)


def chain(own: np.ndarray) -> np.ndarray:
    """Features of the nodes of one document: bias, the line, the line before, the line after."""
    none = np.zeros((1, own.shape[1]))
    return np.hstack([np.ones((len(own), 1)), own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])])


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def marginals(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(good) per node for documents of ``lengths`` nodes laid end to end; with ``pairs`` also the
    expected number of each transition. score: the good state's log potential over the bad one's."""
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    node = np.stack([sigmoid(-score), sigmoid(score)], 1)
    t = np.exp(trans - trans.max())
    alpha, beta = node.copy(), np.ones_like(node)
    steps = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -k, "left")) for k in range(steps)]      # documents longer than k
    for k in range(1, steps):
        at = begin[:active[k]] + k
        a = node[at] * (alpha[at - 1] @ t)
        alpha[at] = a / a.sum(1, keepdims=True)
    for k in range(steps - 1, 0, -1):
        at = begin[:active[k]] + k
        b = (node[at] * beta[at]) @ t.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    if not pairs:
        return p[:, 1]
    inner = np.ones(len(score), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    both = alpha[at - 1][:, :, None] * t[None] * (node[at] * beta[at])[:, None, :]
    both /= both.sum((1, 2), keepdims=True)
    return p[:, 1], both.sum(0)


def long_marginals(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) per node as ``marginals`` gives it, for chains of any length. A chain is cut into blocks of ``BLOCK``
    nodes; the 2 x 2 products of whole blocks, made side by side, carry the messages from block to block, and then
    all blocks step forward and backward side by side."""
    node = np.stack([sigmoid(-score), sigmoid(score)], 1)
    t = np.exp(trans - trans.max())
    count = -(-lengths // BLOCK)
    chain_of = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(chain_of)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(lengths[chain_of] - number * BLOCK, BLOCK)
    begin = (np.cumsum(lengths) - lengths)[chain_of] + number * BLOCK
    order = np.argsort(-size, kind="stable")
    size, begin, number = size[order], begin[order], number[order]
    steps = int(size.max(initial=0))
    active = [int(np.searchsorted(-size, -k, "left")) for k in range(steps)]      # blocks longer than k
    into, out = np.ones((len(size), 2)), np.ones((len(size), 2))    # messages into a block and back into its last node
    if (count > 1).any():
        product = np.where((number == 0)[:, None, None], np.eye(2), t) * node[begin][:, None, :]
        for k in range(1, steps):
            p = product[:active[k]] @ (t * node[begin[:active[k]] + k][:, None, :])
            product[:active[k]] = p / p.sum((1, 2), keepdims=True)
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        first = np.cumsum(count) - count
        for c in np.flatnonzero(count > 1):
            own = place[first[c]:first[c] + count[c]]
            v, w = np.ones(2), np.ones(2)
            for b, a in zip(own[1:], own):
                v = v @ product[a]
                into[b] = v = v / v.sum()
            for a, b in zip(own[-2::-1], own[::-1]):
                w = product[b] @ w
                out[a] = w = w / w.sum()
    alpha, beta = np.empty_like(node), np.empty_like(node)
    a = node[begin] * np.where((number == 0)[:, None], 1.0, into @ t)
    alpha[begin] = a / a.sum(1, keepdims=True)
    beta[begin + size - 1] = out
    for k in range(1, steps):
        at = begin[:active[k]] + k
        a = node[at] * (alpha[at - 1] @ t)
        alpha[at] = a / a.sum(1, keepdims=True)
    for k in range(steps - 1, 0, -1):
        at = begin[:active[k]] + k
        b = (node[at] * beta[at]) @ t.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1)


class Model:
    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans

    def potentials(self, lines: list[str]) -> np.ndarray:
        """Log potential of each line of one text, from its features and its neighbours'; features are made
        for ``CHUNK`` lines at a time."""
        own = self.weights[1:].reshape(3, N_OWN).T
        seen: set = set()
        parts = np.vstack([line_features(lines[k:k + CHUNK], seen) @ own for k in range(0, len(lines), CHUNK)])
        score = self.weights[0] + parts[:, 0]
        score[1:] += parts[:-1, 1]
        score[:-1] += parts[1:, 2]
        return score

    def scores(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of P(good) over the lines of each text."""
        if not texts:
            return np.empty(0)
        lengths, score, weight = [], [], []
        for text in texts:
            lines = lines_of(text)
            lengths.append(len(lines))
            score.append(self.potentials(lines))
            weight.append(np.fromiter(map(len, lines), np.float64, len(lines)))
        lengths, weight = np.array(lengths), np.concatenate(weight)
        p = long_marginals(np.concatenate(score), lengths, self.trans)
        first = np.cumsum(lengths) - lengths
        total = np.add.reduceat(weight, first)
        bare = np.repeat(total == 0, lengths)
        weight[bare] = 1
        total = np.add.reduceat(weight, first)
        return np.clip(np.add.reduceat(weight * p, first) / total, 0, 1)


def fit(docs: list[np.ndarray], labels: list[int], steps: int = STEPS, l2: float = L2) -> Model:
    """Weights by Adam on the conditional log-likelihood; docs: ``line_features`` of each document."""
    f = 3 * N_OWN + 1
    weights, trans = np.zeros(f), np.zeros((2, 2))
    if not docs:
        return Model(weights, trans)
    lengths = np.array([len(d) for d in docs])
    x = np.vstack([chain(d) for d in docs])
    y = np.repeat(np.array(labels), lengths)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    theta, m, v = np.zeros(f + 4), np.zeros(f + 4), np.zeros(f + 4)
    for k in range(1, steps + 1):
        p, both = marginals(x @ theta[:f], lengths, theta[f:].reshape(2, 2), pairs=True)
        grad = np.concatenate([x.T @ (y - p), (seen - both).ravel()]) / len(docs) - l2 * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return Model(theta[:f], theta[f:].reshape(2, 2))


def some_lines(own: np.ndarray, id_: int) -> np.ndarray:
    """A run of ``TRAIN_LINES`` lines of a longer document, the whole of others."""
    spare = len(own) - TRAIN_LINES
    if spare <= 0:
        return own
    at = zlib.crc32(str(id_).encode()) % (spare + 1)
    return own[at:at + TRAIN_LINES]


def held_out(id_: Column) -> Column:
    """True for the rows that never take part in training."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", rows: int = TRAIN_DOCS) -> Model:
    """A model fitted to at most ``rows`` labelled documents that are not held out."""
    spark = docs.sparkSession
    ready(spark)
    known = (labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(label_col).cast("int").alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(rows))

    def run(batches):
        for batch in batches:
            out = [some_lines(line_features(lines_of(t.as_py())), i.as_py()).astype(np.float32).tobytes()
                   for i, t in zip(batch.column(0), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "y", "x"])

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.join(F.broadcast(known), "id").select("id", "y", "t")       # ``rows`` rows at most
    found = sorted((r["id"], bytes(r["x"]), r["y"]) for r in d.mapInArrow(run, "id bigint, y int, x binary")
                   .orderBy("id", "x").limit(2 * rows).collect())
    x = [np.frombuffer(b, np.float32).reshape(-1, N_OWN).astype(np.float64) for _, b, _ in found]
    return fit(x, [y for *_, y in found])


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per row of ``docs``."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.trans))      # some 50 numbers

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            scores = np.concatenate([np.empty(0), *[m.scores(part.to_pylist()) for part in slices(batch.column(1), SLICE_BYTES)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return d.mapInArrow(run, "id bigint, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality(docs, train(docs, read(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))
