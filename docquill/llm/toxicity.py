"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input joins two learned parts: a vector of the word itself (hashed to
a table row) and the mean of the vectors of its character n-grams, marks at
both ends included, so that unseen forms of a known stem still speak. A gated
recurrent network reads a window of ``WINDOW`` words in both directions (a word that repeats at once counts once),
attention weighs its states, and a logistic unit gives the window's
probability. A text is read whole, as overlapping windows (each begins
``STRIDE`` words after the one before, the last ends with the text); its score
is that of its most toxic window.

Training is plain numpy in one task, over a bounded sample: at most
``TRAIN_DOCS`` labelled documents that are not held out, half of them toxic if
there are so many, chosen by a hash of the id; of a longer one a run of
``TRAIN_WORDS`` words, its place given by a hash of the id. Labels are of whole
documents, so each epoch learns from the windows that score highest: one of a
toxic document, three of a clean one. Scoring runs in Arrow batches: Arrow splits
and dictionary-encodes the words, a batch's distinct words are projected once,
and numpy steps through some thousand windows side by side.

Defined results: a null or empty text is one empty word and gets a score; null
ids are not held out and never used for training; repeated label rows of an id
count once (the highest label), repeated documents of an id train once (the
least text run); without labels of both kinds the score is the share of toxic
labels (0 without labels); an empty table gives an empty result; extra columns,
whatever their names, play no part.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import read, ready

TRAIN_DOCS = 4000
TRAIN_WORDS = 512
WINDOW, STRIDE = 32, 24
WORD_ROWS, WORD_DIM = 1 << 15, 8
GRAM_ROWS, GRAM_DIM = 1 << 16, 8
GRAMS = (3, 4, 5)
HIDDEN = 10                 # states of one direction
ATTENTION = 10
LEAST_DOCS = 5              # training documents that must share a table row for it to be learnt
EPOCHS = 10
RATE = 0.01
BATCH = 256                 # windows of a training step, fewer where an epoch has less than 24 such steps
SIDE_BY_SIDE = 2048         # windows that scoring steps through at once
BLOCK_WORDS = 1 << 15       # distinct words whose n-grams are summed at a time
SLICE_BYTES = 12 << 20       # text encoded at a time
EDGE_MARK = "\x01"
TRIM = ".,;:!?\"'()[]{}<>|*#-_/\\" + EDGE_MARK


# --------------------------------------------------------------------------
# Words


def _cut(texts: pa.Array, limit: int):
    """(row, text) pieces of at most ``limit`` bytes or so, in runs of at most that size;
    a long text is cut at white space, each piece beginning with the window before."""
    run, size = [], 0
    for row, text in enumerate(texts):
        text = text.as_py() or ""
        at = 0
        while True:
            piece = text[at:at + limit]
            end = at + len(piece)
            if end < len(text):     # back to the last white space, if there is one
                space = max(piece.rfind(" "), piece.rfind("\n"))
                if space > limit // 2:
                    end, piece = at + space, piece[:space]
            run.append((row, piece))
            size += len(piece)
            if size >= limit:
                yield run
                run, size = [], 0
            if end >= len(text):
                break
            tail = piece[-64 * WINDOW:].split()[-(WINDOW - 1):]
            at = max(at + 1, end - len(" ".join(tail)))
    if run:
        yield run


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes of all words end to end, words of each text, distinct words). A word
    that repeats at once counts once; a text without words has the empty one."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    distinct = pc.utf8_trim(words.dictionary, TRIM).to_pylist()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    codes, sizes = codes[~again], np.bincount(owner[~again], minlength=len(sizes))
    if (sizes == 0).any():          # the distinct words end with the empty one
        codes = np.insert(codes, np.cumsum(sizes)[sizes == 0], len(distinct))
        sizes = np.maximum(sizes, 1)
    return codes, sizes, [*distinct, ""]


def _mixed(h: np.ndarray, rows: int) -> np.ndarray:
    """Table rows of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(rows)).astype(np.int64)


def inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table row of each word; word number and table row of each of their n-grams, in word order)."""
    joined = EDGE_MARK + EDGE_MARK.join(words) + EDGE_MARK
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    edge = codes == ord(EDGE_MARK)
    number = np.cumsum(edge) - 1
    begin = np.flatnonzero(edge)[:-1]
    base = np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(len(codes)) - begin[np.minimum(number, len(words) - 1)]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, base, np.uint64))
        whole = np.add.reduceat(codes * powers[place], begin)
        at, rows = [], []
        for k in GRAMS:
            if len(codes) < k:
                continue
            n = len(codes) - k + 1
            inside = np.ones(n, bool)
            h = np.full(n, k, np.uint64)
            for j in range(k):
                h = h * base + codes[j:j + n]
                if 0 < j < k - 1:
                    inside &= ~edge[j:j + n]
            start = np.flatnonzero(inside)
            at.append(number[start].astype(np.int32))
            rows.append(_mixed(h[start], GRAM_ROWS).astype(np.int32))
    at, rows = np.concatenate(at), np.concatenate(rows)
    order = np.argsort(at, kind="stable")
    return _mixed(whole, WORD_ROWS), at[order], rows[order]


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window of texts of ``sizes`` words laid end to end."""
    count = np.where(sizes <= WINDOW, 1, -(-(sizes - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(k * STRIDE, np.maximum(sizes - WINDOW, 0)[text])
    return text, at + (np.cumsum(sizes) - sizes)[text], np.minimum(sizes, WINDOW)[text]


# --------------------------------------------------------------------------
# The network


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + GRAM_DIM, HIDDEN
    p = {"word": np.zeros((WORD_ROWS, WORD_DIM)), "gram": np.zeros((GRAM_ROWS, GRAM_DIM)),
         "attend": rng.normal(size=(2 * h, ATTENTION)) / np.sqrt(2 * h), "weigh": rng.normal(size=ATTENTION) / np.sqrt(ATTENTION),
         "out": rng.normal(size=2 * h) / np.sqrt(2 * h), "bias": np.zeros(1)}
    for way in "fb":
        p |= {f"w{way}": rng.normal(size=(d, 3 * h)) / np.sqrt(d), f"u{way}": rng.normal(size=(h, 3 * h)) / np.sqrt(h),
              f"c{way}": np.zeros(3 * h)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def gathered(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their numbers ``at``."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def word_vectors(p, words, grams_at, grams) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of distinct words (table rows ``words``), and the number of n-grams of each."""
    n = np.bincount(grams_at, minlength=len(words))
    ends = np.cumsum(n)
    mean = np.zeros((len(words), GRAM_DIM), np.float32)
    for k in range(0, len(words), BLOCK_WORDS):
        own = n[k:k + BLOCK_WORDS]
        some = np.flatnonzero(own)
        if len(some):
            first = ends[k] - n[k]
            vectors = p["gram"][grams[first:first + own.sum()]]
            mean[k + some] = np.add.reduceat(vectors, (np.cumsum(own) - own)[some], axis=0) / own[some, None]
    return np.hstack([p["word"][words], mean]), n


def _run(x, u, mask, keep: bool):
    """States of one direction; x: (steps, windows, 3 HIDDEN). With ``keep`` also what the way back needs."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    states = np.empty((len(x), *h.shape), np.float32)
    kept = []
    for t in range(len(x)):
        a = h @ u
        zr = sigmoid(x[t, :, :2 * HIDDEN] + a[:, :2 * HIDDEN])
        z, r, q = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN:] + r * q)
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t], new, h)
        if keep:
            kept.append((h, z, r, q, n))
        states[t] = h = new
    return states, kept


def _back(d_states, kept, u, mask):
    """Gradients of x and u of one direction."""
    dx = np.empty((*d_states.shape[:2], 3 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh = np.zeros_like(d_states[0])
    for t in range(len(dx) - 1, -1, -1):
        h, z, r, q, n = kept[t]
        dh = dh + d_states[t]
        passed = np.where(mask[t], 0, dh)
        dh = np.where(mask[t], dh, 0)
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * q * r * (1 - r)
        da = np.hstack([dz, dr, dn * r])
        dx[t] = np.hstack([dz, dr, dn])
        du += h.T @ da
        dh = dh * z + da @ u.T + passed
    return dx, du


def _pooled(p, hs, mask):
    """(logits, attention, tanh layer, pooled states) of states hs (steps, windows, 2 HIDDEN)."""
    y = np.tanh(hs @ p["attend"])
    e = y @ p["weigh"]
    if mask is not None:
        e = np.where(mask[:, :, 0], e, -1e9)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pool = np.einsum("tb,tbh->bh", w, hs)
    return pool @ p["out"] + p["bias"], w, y, pool


def logits(p, projected: np.ndarray, codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log odds of windows; projected: (distinct words, 6 HIDDEN), both directions side by side."""
    out = np.empty(len(at), np.float32)
    for whole in (True, False):
        own = np.flatnonzero((size == WINDOW) == whole)
        own = own[np.argsort(-size[own], kind="stable")]
        for k in range(0, len(own), SIDE_BY_SIDE):
            b = own[k:k + SIDE_BY_SIDE]
            steps = int(size[b].max())
            t = np.arange(steps)[:, None]
            mask = None if whole else (t < size[b])[:, :, None]
            x = projected[codes[np.minimum(at[b] + np.minimum(t, size[b] - 1), len(codes) - 1)]]
            f, _ = _run(x[:, :, :3 * HIDDEN], p["uf"], mask, False)
            back = None if mask is None else mask[::-1]
            r, _ = _run(x[::-1, :, 3 * HIDDEN:], p["ub"], back, False)
            out[b] = _pooled(p, np.concatenate([f, r[::-1]], 2), mask)[0]
    return out


def project(p, vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors @ p["wf"] + p["cf"], vectors @ p["wb"] + p["cb"]])


def gradients(p, sample, at, size, y) -> tuple[float, dict]:
    """Loss and gradients of windows with labels ``y``; sample: (codes, words, grams_at, grams)."""
    codes, words, first, grams = sample
    steps = int(size.max())
    t = np.arange(steps)[:, None]
    mask = (t < size)[:, :, None]
    token = codes[at + np.minimum(t, size - 1)]
    used, local = np.unique(token, return_inverse=True)
    local = local.reshape(token.shape)
    n = (first[1:] - first[:-1])[used]
    owner = np.repeat(np.arange(len(used)), n)
    of_gram = grams[np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    v, n = word_vectors(p, words[used], owner, of_gram)
    x = project(p, v)[local]
    f, kept_f = _run(x[:, :, :3 * HIDDEN], p["uf"], mask, True)
    r, kept_r = _run(x[::-1, :, 3 * HIDDEN:], p["ub"], mask[::-1], True)
    hs = np.concatenate([f, r[::-1]], 2)
    z, w, tanh, pool = _pooled(p, hs, mask)
    prob = sigmoid(z)
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    dz = ((prob - y) / len(y)).astype(np.float32)
    g = {"out": pool.T @ dz, "bias": dz.sum(keepdims=True)}
    d_pool = dz[:, None] * p["out"]
    dw = np.einsum("tbh,bh->tb", hs, d_pool)
    de = w * (dw - (w * dw).sum(0))
    dt = de[:, :, None] * p["weigh"] * (1 - tanh * tanh)
    g["weigh"] = np.einsum("tba,tb->a", tanh, de)
    g["attend"] = np.einsum("tbh,tba->ha", hs, dt)
    d_hs = w[:, :, None] * d_pool + dt @ p["attend"].T
    dxf, g["uf"] = _back(d_hs[:, :, :HIDDEN], kept_f, p["uf"], mask)
    dxr, g["ub"] = _back(d_hs[::-1, :, HIDDEN:], kept_r, p["ub"], mask[::-1])
    dx = np.concatenate([dxf, dxr[::-1]], 2).reshape(-1, 6 * HIDDEN)
    d_proj = gathered(local.reshape(-1), dx, len(used))
    g |= {"wf": v.T @ d_proj[:, :3 * HIDDEN], "wb": v.T @ d_proj[:, 3 * HIDDEN:],
          "cf": d_proj[:, :3 * HIDDEN].sum(0), "cb": d_proj[:, 3 * HIDDEN:].sum(0)}
    dv = d_proj[:, :3 * HIDDEN] @ p["wf"].T + d_proj[:, 3 * HIDDEN:] @ p["wb"].T
    g["word"] = gathered(words[used], dv[:, :WORD_DIM], WORD_ROWS)
    g["gram"] = gathered(of_gram, (dv[:, WORD_DIM:] / np.maximum(n, 1)[:, None])[owner], GRAM_ROWS)
    return loss, g


class Adam:
    def __init__(self, p, rate: float):
        self.rate, self.k = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, p, g, rate: float) -> None:
        self.k += 1
        for k, x in p.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] * g[k] - v)
            x -= rate * (m / (1 - 0.9 ** self.k)) / (np.sqrt(v / (1 - 0.99 ** self.k)) + 1e-6)


class Model:
    """Parameters of the network, or only a share of toxic labels where nothing could be learnt."""

    def __init__(self, p: dict | None, share: float = 0.0):
        self.p, self.share = p, share

    def window_logits(self, codes, sizes, distinct):
        text, at, size = windows(sizes)
        words, grams_at, grams = inputs(distinct)
        projected = project(self.p, word_vectors(self.p, words, grams_at, grams)[0])
        return text, logits(self.p, projected, codes, at, size)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The probability of the most toxic window of each text."""
        if self.p is None:
            return np.full(len(texts), self.share)
        best = np.full(len(texts), -np.inf, np.float32)
        for run in _cut(texts, SLICE_BYTES):
            rows = np.array([row for row, _ in run])
            text, z = self.window_logits(*encoded([piece for _, piece in run]))
            np.maximum.at(best, rows[text], z)
        return sigmoid(best.astype(np.float64))


def shared_rows(sizes, sample) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the word and n-gram tables that ``LEAST_DOCS`` texts share, as columns of 0 and 1. Others stay zero:
    what few documents have would only be remembered."""
    codes, words, first, grams = sample
    pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(words) + codes)
    text, code = pairs // len(words), pairs % len(words)
    n = (first[1:] - first[:-1])[code]
    of_gram = grams[np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    out = []
    for rows, of, many in ((words[code], text, WORD_ROWS), (of_gram, np.repeat(text, n), GRAM_ROWS)):
        seen = np.unique(of * many + rows) % many
        out.append((np.bincount(seen, minlength=many) >= LEAST_DOCS).astype(np.float32)[:, None])
    return tuple(out)


def fit(runs: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 0) -> Model:
    """A model of texts with labels 0 and 1 (bounded lists; see ``train``)."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return Model(None, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    codes, sizes, distinct = encoded(runs)
    words, grams_at, grams = inputs(distinct)
    first = np.concatenate([[0], np.cumsum(np.bincount(grams_at, minlength=len(distinct)))])
    sample = (codes, words, first, grams)
    known = dict(zip(("word", "gram"), shared_rows(sizes, sample)))
    text, at, size = windows(sizes)
    p = start(seed)
    adam = Adam(p, RATE)
    for epoch in range(epochs):
        if epoch:
            z = logits(p, project(p, word_vectors(p, words, grams_at, grams)[0]), codes, at, size)
        else:                       # nothing is learnt yet: any window
            z = rng.random(len(at))
        order = np.lexsort((-z, text))
        rank = np.arange(len(order)) - np.repeat(np.flatnonzero(np.diff(text[order], prepend=-1)), np.bincount(text))
        many = 4 if epoch < 2 else 1
        own = order[rank < np.where(y[text[order]] > 0, many, 3)]
        rng.shuffle(own)
        rate = RATE * (1 - epoch / epochs) + 1e-3
        step = min(BATCH, max(16, len(own) // 24))
        for k in range(0, len(own), step):
            b = own[k:k + step]
            _, g = gradients(p, sample, at[b], size[b], y[text[b]])
            for k, mask in known.items():
                g[k] *= mask
            adam.step(p, g, rate)
    return Model(p)


# --------------------------------------------------------------------------
# On tables


def held_out(id_: Column) -> Column:
    """True for the rows that never take part in training."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(4)) == 2, F.lit(False))


def some_words(text: str, id_) -> str:
    """A run of ``TRAIN_WORDS`` words of a longer text, the whole of others."""
    words = text.split()
    spare = len(words) - TRAIN_WORDS
    at = zlib.crc32(str(id_).encode()) % (spare + 1) if spare > 0 else 0
    return " ".join(words[at:at + TRAIN_WORDS])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_DOCS) -> Model:
    """A model fitted to at most ``rows`` labelled documents that are not held out."""
    spark = docs.sparkSession
    ready(spark)
    known = (labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    order = [F.xxhash64("id"), F.col("id")]
    toxic = known.where("y = 1").orderBy(*order).limit(rows // 2).collect()
    clean = known.where("y = 0").orderBy(*order).limit(rows - len(toxic)).collect()
    chosen = spark.createDataFrame([(r["id"], r["y"]) for r in [*toxic, *clean]], "id bigint, y int")

    def run(batches):
        for batch in batches:
            out = [some_words(t, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "y", "run"])

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.join(F.broadcast(chosen), "id").select("id", "y", "t")        # ``rows`` rows at most
    found = d.mapInArrow(run, "id bigint, y int, run string").groupBy("id").agg(F.first("y").alias("y"), F.min("run").alias("run"))

    def learn(batches):
        rows = sorted((i, run, y) for b in batches for i, y, run in zip(*(b.column(k).to_pylist() for k in range(3))))
        model = fit([run for _, run, _ in rows], [y for *_, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.p, model.share))], pa.binary())], ["model"])

    return Model(*pickle.loads(found.select("id", "y", "run").coalesce(1).mapInArrow(learn, "model binary").first()[0]))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per row of ``docs``."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast((model.p, model.share))       # some 3 MB, whatever the corpus

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            scores = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return d.mapInArrow(run, "id bigint, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity(docs, train(docs, read(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))
