"""Benchmark decontamination through suffix arrays of the training words.

Every Arrow batch of documents is a shard: its words become ids of the
benchmark's vocabulary, runs of such words are kept (no other word can be part
of a match), and a suffix array over them is built by prefix doubling. Every
benchmark suffix is then found in it by binary search: the range of training
suffixes that start with its window gives all hits, its neighbours in the
array the longest verbatim match and its place.

The benchmark is the query set. It is sent to the tasks in blocks of at most
``BLOCK_BYTES`` of text, whatever its size; the results of blocks are merged
per document.

Defined results: a null text has no words; an item without words has no
window, one of fewer than ``window`` words is a single window; repeated items
or ids count once; repeated documents are judged row by row; a null item id
stands as "null" in the list; empty tables give empty results or no hits.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import read, ready

WINDOW = 10
BLOCK_BYTES = 16 << 20      # benchmark text sent to the tasks at a time
KEPT_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return text.translate(KEPT_BYTES).split()


class Queries:
    """Benchmark suffixes of one block, as word ids in one array with a 0 after each item."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        texts = [(k, words_of(t)) for k, t in items]
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        ids, starts, widths, owner = [], [], [], []
        self.names = sorted({k for k, ws in texts if ws})
        number = {k: i for i, k in enumerate(self.names)}
        for k, ws in texts:
            w = min(window, len(ws))
            for i in range(len(ws) - w + 1 if w else 0):
                starts.append(len(ids) + i)
                widths.append(w)
                owner.append(number[k])
            ids.extend([self.vocab[x] for x in ws] + [0])
        self.longest = max((len(ws) for _, ws in texts), default=0)
        self.ids = np.array(ids + [0] * (window + 1), np.int32)
        self.starts, self.widths = np.array(starts, np.int64), np.array(widths, np.int64)
        self.owner = np.array(owner, np.int64)
        self.least = int(self.widths.min()) if starts else 0
        # Equal windows are searched once: windows[k] -> its items.
        at = self.starts[:, None] + np.arange(window)
        mask = np.arange(window) < self.widths[:, None]
        rows = np.where(mask, self.ids[at], 0) if starts else np.empty((0, window), np.int32)
        self.windows, inverse = np.unique(rows, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        pairs = np.unique(np.stack([inverse, self.owner], 1), axis=0) if starts else np.empty((0, 2), np.int64)
        self.pair_item = pairs[:, 1]
        self.pair_from = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.window_widths = (self.windows > 0).sum(axis=1)
        self.window_of = inverse


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``x`` sorted by the suffixes that start there, compared over at least ``depth`` words."""
    rank = x.astype(np.int64)
    h = 1
    while True:
        order = np.argsort(rank, kind="stable")
        step = np.empty(len(x), np.int64)
        step[order] = np.concatenate([[0], np.cumsum(np.diff(rank[order]) != 0)])
        rank = step
        if h >= depth or not len(x) or rank[order[-1]] == len(x) - 1:
            return order
        after = np.zeros(len(x), np.int64)
        after[:-h or None] = rank[h:] + 1
        after[x == 0] = 0               # nothing after a separator counts
        rank = rank * (len(x) + 1) + after
        h *= 2


def bounds(x: np.ndarray, sa: np.ndarray, rows: np.ndarray, widths: np.ndarray):
    """First place in ``sa`` whose suffix is not below each row, and the first that is above and does not start with it."""
    mask = np.arange(rows.shape[1]) < widths[:, None]

    def search(after_equal: bool):
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(sa), np.int64)
        while (go := np.nonzero(lo < hi)[0]).size:
            mid = (lo[go] + hi[go]) // 2
            got = x[sa[mid][:, None] + np.arange(rows.shape[1])]
            differs = (got != rows[go]) & mask[go]
            first = differs.argmax(axis=1)
            k = np.arange(len(go))
            below = np.where(differs.any(axis=1), got[k, first] < rows[go][k, first], after_equal)
            lo[go] = np.where(below, mid + 1, lo[go])
            hi[go] = np.where(below, hi[go], mid)
        return lo

    return search(False), search(True)


class Shard:
    """Suffix array over the runs of benchmark words of some documents."""

    def __init__(self, queries: Queries, texts: list[bytes]):
        self.n_words, parts, docs, places = [], [], [], []
        get, least = queries.vocab.get, max(1, queries.least)
        for k, text in enumerate(texts):
            words = words_of(text)
            self.n_words.append(len(words))
            if len(words) < least or not queries.least:
                continue
            ids = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
            for a, b in edge.reshape(-1, 2)[edge[1::2] - edge[::2] >= least]:
                parts.append(ids[a:b])
                parts.append([0])
                docs.append((k, b - a + 1))
                places.append(a)
        pad = max(WINDOW, queries.windows.shape[1]) + 1
        self.x = np.concatenate([*parts, np.zeros(pad, np.int32)]).astype(np.int32)
        n = len(self.x) - pad
        lengths = np.array([m for _, m in docs], np.int64)
        self.doc = np.repeat(np.array([k for k, _ in docs], np.int64), lengths)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
        self.place = np.arange(n) - np.repeat(begin - np.array(places, np.int64), lengths)
        self.sa = suffix_array(self.x[:n], max(queries.longest, 1))
        self.queries = queries
        self.lo, self.hi = bounds(self.x, self.sa, queries.windows, queries.window_widths)

    def hits(self):
        """Per document: merged word ranges that are hit, and the item numbers."""
        q, found = self.queries, np.flatnonzero(self.hi > self.lo)
        ranges, items = {}, {}
        if not len(found):
            return ranges, items
        n = self.hi[found] - self.lo[found]
        window = np.repeat(found, n)
        at = self.sa[np.repeat(self.lo[found] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
        cover = np.zeros(len(self.x) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + q.window_widths[window], -1)
        on = np.cumsum(cover) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]]).astype(np.int8))).reshape(-1, 2)
        for a, b in edge:
            ranges.setdefault(int(self.doc[a]), []).append((int(self.place[a]), int(self.place[a] + b - a)))
        pairs = np.unique(np.stack([self.doc[at], window], 1), axis=0)
        for d, w in pairs.tolist():
            items.setdefault(d, set()).update(q.pair_item[q.pair_from[w]:q.pair_from[w + 1]].tolist())
        return ranges, items

    def longest(self):
        """Yield (suffix number, words, document, place) of the longest match of each suffix whose window occurs."""
        q = self.queries
        for s in np.flatnonzero((self.hi > self.lo)[q.window_of]):
            lo, hi = int(self.lo[q.window_of[s]]), int(self.hi[q.window_of[s]])
            k, best = int(q.widths[s]), None
            while True:             # narrow the range word by word: the array is sorted over the whole suffix
                best = int(self.sa[lo])
                word = int(q.ids[q.starts[s] + k])
                if not word:
                    break
                column = self.x[np.minimum(self.sa[lo:hi] + k, len(self.x) - 1)]
                a, b = np.searchsorted(column, word, "left"), np.searchsorted(column, word, "right")
                if a == b:
                    break
                lo, hi, k = lo + int(a), lo + int(b), k + 1
            yield int(s), k, int(self.doc[best]), int(self.place[best])


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
              block_bytes: int = BLOCK_BYTES, window: int = WINDOW):
    """The benchmark as a list of functions, each giving the ``Queries`` of one block of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("k"),
                             F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // block_bytes) if size > block_bytes else 1)
    for b in range(n):
        own = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b) if n > 1 else items
        rows = [(r["k"], bytes(r["t"])) for r in own.distinct().collect()]
        yield spark.sparkContext.broadcast((rows, window))


def _queries(shared):
    """The ``Queries`` of a broadcast block, made once per task."""
    rows, window = shared.value
    return Queries(rows, window)


def _texts(column):
    return [t.as_py() or b"" for t in column]


HITS = "id bigint, text_hash bigint, n_words bigint, ranges array<struct<a:bigint,b:bigint>>, items array<string>"


def _hits_of(block, docs: DataFrame) -> DataFrame:
    def run(batches):
        q = _queries(block)
        for batch in batches:
            shard = Shard(q, _texts(batch.column(2)))
            ranges, items = shard.hits()
            n = range(batch.num_rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(shard.n_words, pa.int64()),
                pa.array([[{"a": a, "b": b} for a, b in ranges.get(k, ())] for k in n],
                         pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                pa.array([[q.names[i] for i in sorted(items.get(k, ()))] for k in n], pa.list_(pa.string()))],
                ["id", "text_hash", "n_words", "ranges", "items"])
    return docs.mapInArrow(run, HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, ranges, items): one row per document; ``ranges`` are the
    hit words as merged [a, b) word places, ``items`` the item ids, sorted."""
    ready(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"),
                    F.encode(text, "UTF-8").alias("t"))
    parts = [_hits_of(b, d) for b in blocks_of(benchmark, item_col, item_text_col, block_bytes, window)]
    if len(parts) == 1:
        return parts[0].select("id", "n_words", "ranges", F.array_sort("items").alias("items"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy("id", "text_hash").agg(
        F.first("n_words").alias("n_words"), (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"),
        F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Ranges of different blocks may overlap: keep of each what no earlier one covers.
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)").alias("out"))
    merged = F.aggregate("ranges", start, lambda s, r: F.struct(
        F.greatest(s["end"], r["b"]).alias("end"),
        F.when(r["b"] > s["end"], F.concat(s["out"], F.array(F.struct(F.greatest(s["end"], r["a"]).alias("a"), r["b"].alias("b")))))
        .otherwise(s["out"]).alias("out")), lambda s: s["out"])
    return one.select("id", "n_words", merged.alias("ranges"), "items",
                      F.explode(F.sequence(F.lit(1), "copies")).alias("_c")).drop("_c")


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, word, length, id, place): for every benchmark suffix with a hit,
    its longest verbatim match in words, and one document and word place that holds it."""
    ready(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("bigint").alias("id"),
                    F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))

    def found(block):
        def run(batches):
            q = _queries(block)
            item_start = np.concatenate([[0], np.flatnonzero(q.ids == 0) + 1])
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = list(Shard(q, _texts(batch.column(1))).longest())
                word = [int(q.starts[s] - item_start[np.searchsorted(item_start, q.starts[s], "right") - 1]) for s, *_ in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([q.names[q.owner[s]] for s, *_ in rows], pa.string()), pa.array(word, pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()), pa.array([ids[r[2]] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64())], ["item_id", "word", "length", "id", "place"])
        return d.mapInArrow(run, "item_id string, word bigint, length bigint, id bigint, place bigint")

    out = None
    for b in blocks_of(benchmark, item_col, item_text_col, window=window):
        out = found(b) if out is None else out.unionByName(found(b))
    best = out.groupBy("item_id", "word").agg(F.min(F.struct((-F.col("length")).alias("n"), "id", "place")).alias("m"))
    return best.select("item_id", "word", (-F.col("m.n")).alias("length"), "m.id", "m.place")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                        item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, all columns unchanged. Rows are
    dropped where they are read: no join, no shuffle."""
    ready(docs.sparkSession)

    def without(block, d):
        place = d.columns.index(text_col)

        def run(batches):
            q = _queries(block)
            for batch in batches:
                texts = [(t.as_py() or "").encode() for t in batch.column(place)]
                ranges, _ = Shard(q, texts).hits()
                yield batch.filter(pa.array([k not in ranges for k in range(batch.num_rows)], pa.bool_()))
        return d.mapInArrow(run, d.schema)

    for b in blocks_of(benchmark, item_col, item_text_col):
        docs = without(b, docs)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda s, r: s + r["b"] - r["a"])
    return found.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, w[i:i + n - 1] AS g
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, n, w[i:i + n - 1] AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM hit, range(0, 10) AS r(k) WHERE k < n GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
       coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
