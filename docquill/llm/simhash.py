"""SimHash near-duplicates, linked through vantage-point trees.

1. Every text gets a 64-bit SimHash of its word shingles (Arrow stage).
2. The distinct fingerprints are dealt to shards by the top of a
   vantage-point tree: inner nodes hold a pivot and a radius, near points go
   left, the others right. Pivots and radii come from a bounded random sample
   (``SAMPLE``); they affect balance only. A fingerprint also visits every
   shard that its ball of ``max_bits`` reaches over a boundary, so each close
   pair meets in one shard.
3. Each shard builds a tree over its own points and runs all of its
   points and visitors through it, pruning branches by the triangle bound.
   It returns one edge per point to its local group and one per visitor and
   local group, never all pairs.
4. Local groups that share a visitor are joined by connected components.

Defined results: a null text counts as empty; texts without words have
fingerprint 0 and link like any other; equal fingerprints are one point, so
copies cost nothing; null ids are ignored for the smallest id of a component
(null if the component has no other); an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import read, ready, saved
from docquill.llm.components import connected

SEED = 42
SHARD_POINTS = 20_000       # wanted points of a shard
GROUP_ROWS = 400_000        # wanted rows of a shard with its visitors; beyond it visitors are split
SAMPLE = 65_536             # fingerprints on the driver from which pivots and radii are taken
LEAF = 128                  # points of a leaf inside a shard
CHUNK = 1 << 16             # shingles hashed at a time


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of UTF-8 text: a bit is set if over half of the shingle hashes have it."""
    words = text.lower().split()            # bytes: only A-Z change, only the six ASCII spaces split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, b = starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(a), CHUNK):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(a[k:k + CHUNK], b[k:k + CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp): one row per document; fp is the fingerprint as a signed long."""
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1),
                                   pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "text_hash", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"),
                    F.encode(text, "UTF-8").alias("b"))
    return d.mapInArrow(run, "id bigint, text_hash bigint, fp bigint")


def distance(a, b):
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int64)


def grow(points: np.ndarray, depth: int) -> list:
    """The top of the tree as nested lists [pivot, radius, near, far]; None is a leaf."""
    if depth == 0 or len(points) < 2:
        return None
    pivot = points[0]
    d = distance(points, pivot)
    radius = int(np.median(d))
    if (d > radius).sum() == 0:
        radius = int(d.max()) - 1
    near = d <= radius
    return [int(pivot), radius, grow(points[near], depth - 1), grow(points[~near], depth - 1)]


def route(tree, fps: np.ndarray, reach: int, rows=None, base: int = 0, size: int = 1):
    """Yield (leaf number, rows) for the leaves that a ball of ``reach`` meets; ``size``: leaves of a full subtree."""
    rows = np.arange(len(fps)) if rows is None else rows
    if not len(rows):
        return
    if tree is None:
        yield base, rows
        return
    pivot, radius, near, far = tree
    d = distance(fps[rows], np.uint64(pivot))
    yield from route(near, fps, reach, rows[d - reach <= radius], base, size // 2)
    yield from route(far, fps, reach, rows[d + reach > radius], base + size // 2, size // 2)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i] in ``label`` (each label is a root, the smallest of its group)."""
    while True:
        ra, rb = label[a], label[b]
        open_ = ra != rb
        if not open_.any():
            return
        np.minimum.at(label, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        a, b = a[open_], b[open_]


def close_pairs(points: np.ndarray, queries: np.ndarray, max_bits: int):
    """Yield (query rows, point rows) within ``max_bits``, leaf by leaf of a tree over ``points``."""
    def walk(own, asked):
        if not len(asked) or not len(own):
            return
        if len(own) > LEAF:
            d = distance(points[own], points[own[0]])
            radius = int(np.median(d))
            near = d <= radius
            if near.all():
                near = d < radius
            if near.any():
                radius = int(d[near].max())
                q = distance(queries[asked], points[own[0]])
                yield from walk(own[near], asked[q - max_bits <= radius])
                yield from walk(own[~near], asked[q + max_bits > radius])
                return
        step = max(1, (1 << 20) // len(own))
        for k in range(0, len(asked), step):
            part = asked[k:k + step]
            hit = distance(queries[part][:, None], points[own][None, :]) <= max_bits
            i, j = np.nonzero(hit)
            if len(i):
                yield part[i], own[j]
    yield from walk(np.arange(len(points)), np.arange(len(queries)))


def shard_edges(pdf: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Edges of one shard: (a, b, own); own: a is a point of the shard and b its local group."""
    home = pdf["home"].to_numpy()
    fps = pdf["fp"].to_numpy().view(np.uint64)
    points, guests = np.unique(fps[home]), fps[~home]
    label = np.arange(len(points))
    for q, p in close_pairs(points, points, max_bits):
        merge(label, q, p)
    found = [np.empty((0, 2), np.int64)]
    for q, p in close_pairs(points, guests, max_bits):
        found.append(np.unique(np.stack([q, label[p]], 1), axis=0))
    links = np.unique(np.concatenate(found), axis=0)
    a = np.concatenate([points, guests[links[:, 0]]]).view(np.int64)
    b = np.concatenate([points[label], points[links[:, 1]]]).view(np.int64)
    first = bool(len(pdf) and pdf["part"].iloc[0] == 0)
    own = np.arange(len(a)) < len(points)
    keep = ~own | first
    return pd.DataFrame({"a": a[keep], "b": b[keep], "own": own[keep]})


def link(fps: DataFrame, max_bits: int = 3, shard_points: int = SHARD_POINTS,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """(fp, root) for the distinct fingerprints in column ``fp``: equal roots are connected by steps of ``max_bits``."""
    spark = fps.sparkSession
    ready(spark)
    n = fps.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / shard_points)))
    depth = min(depth, int(math.log2(SAMPLE)) - 4)
    tree, leaves = None, 1 << depth
    if depth:
        want = min(SAMPLE, max(4096, leaves * 64))
        sample = np.array([r["fp"] for r in fps.sample(fraction=min(1.0, 1.2 * want / n), seed=11)
                           .limit(want).collect()], np.int64).view(np.uint64)
        tree = grow(sample, depth)
    guests_per_shard = n * 0.8 ** depth / 2 if depth else 0
    parts = max(1, math.ceil(guests_per_shard / group_rows))

    def deal(batches):
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            own = np.zeros(len(f), np.int64)
            for leaf, rows in route(tree, f, 0, size=leaves):
                own[rows] = leaf
            out = [(leaf, rows, own[rows] == leaf) for leaf, rows in route(tree, f, max_bits, size=leaves)]
            for leaf, rows, home in out:
                go = rows[home | (own[rows] < leaf)]
                at = own[go] == leaf
                part = (f[go] % np.uint64(parts)).astype(np.int64)
                copies = [(go[~at], part[~at], False)] + [(go[at], np.full(at.sum(), p), True) for p in range(parts)]
                for r, p, is_home in copies:
                    if len(r):
                        yield pa.record_batch([pa.array(np.full(len(r), leaf)), pa.array(p), pa.array(f[r].view(np.int64)),
                                               pa.array(np.full(len(r), is_home))], ["shard", "part", "fp", "home"])

    dealt = fps.select("fp").mapInArrow(deal, "shard bigint, part bigint, fp bigint, home boolean")
    edges = saved(dealt.groupBy("shard", "part").applyInPandas(
        lambda pdf: shard_edges(pdf, max_bits), "a bigint, b bigint, own boolean"))
    local = edges.where("own").select(F.col("a").alias("fp"), F.col("b").alias("root"))
    if not depth:
        return local
    across = (edges.where("not own").select(F.col("a").alias("fp"), "b").join(local, "fp")
              .select(F.col("root").alias("a"), "b").where("a <> b").distinct())
    top = connected(across).select(F.col("u").alias("root"), F.col("v").alias("top"))
    return local.join(top, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text", **sizes) -> DataFrame:
    """(id, text_hash, fp, root, component): one row per document; ``component`` is the smallest id reachable."""
    marked = saved(fingerprints(docs, shingle, id_col, text_col))
    ids = saved(marked.groupBy("fp").agg(F.min("id").alias("low")))
    roots = saved(link(ids, max_bits, **sizes))
    low = ids.join(roots, "fp").groupBy("root").agg(F.min("low").alias("component"))
    by_fp = roots.join(low, "root").select("fp", "root", "component")
    return marked.join(by_fp, "fp").select("id", "text_hash", "fp", "root", "component")


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row
    with the smallest id stays (null ids last), all columns unchanged."""
    found = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("k"))
    keep = chosen.select(F.col("k.id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash"))
    # The caller's row stays one struct, so that no name of its columns meets ours.
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"),
                    F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    on = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    return d.join(keep, on, "left_semi").dropDuplicates(["id", "text_hash"]).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))
