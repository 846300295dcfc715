"""Best-fit packing of token sequences by a grouping genetic algorithm.

1. Texts are tokenized where they are read; each becomes pieces of at most
   ``CAPACITY`` tokens (only longer texts are cut) with length and checksum.
2. Pieces are dealt by a hash of their row number to shards of bounded size.
   ``ISLANDS`` islands evolve each shard apart: an individual is a
   grouping of pieces into bins, crossover injects whole well-filled bins of
   another individual, removes the bins that hold a duplicate, and puts the
   displaced pieces back by best fit, longest first. Each island's elite then
   migrates to the next island, which evolves again with it.
3. The best elite of a shard counts. Its least filled bin is opened and its
   pieces go to the next level, where the leftovers of all shards are packed
   the same way, until one shard is left.

Only piece numbers and lengths take part in 2 and 3, never texts or ids.

Defined results: a null or empty text is one piece with the end id only; rows
with equal or null ids are packed row by row; empty tables give an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquill.llm.common import per_worker, read, ready, saved
from docquill.llm.token_counts import vocabulary
from docquill.llm.tokens import WordIds, slices

CAPACITY = 4096
SHARD_PIECES = 16_384       # wanted pieces of a shard
ISLANDS = 3
POPULATION = 4
GENERATIONS = 8             # of each of the two epochs


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY,
           id_col: str = "doc_id", text_col: str = "text", find=vocabulary) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of every row of ``docs``."""
    ready(docs.sparkSession)

    def run(batches):
        coder = per_worker(f"ids:{tokenizer}", lambda: WordIds(find(tokenizer)))
        for batch in batches:
            names, at = batch.column(0), 0
            for texts in slices(batch.column(1)):
                ids, sizes = coder.ids(texts, end_id)
                cuts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                first = (np.cumsum(sizes) - sizes)[row] + start
                crc = [zlib.crc32(ids[a:a + n]) for a, n in zip(first.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([
                    names.slice(at, len(sizes)).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])
                at += len(sizes)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("t")).mapInArrow(
        run, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    """Open bins by room, for best fit: a bit set of the rooms in use finds the tightest bin."""

    def __init__(self, capacity: int, room: dict[int, int]):
        self.capacity, self.by_room, self.mask = capacity, {}, 0
        for b, r in room.items():
            self._put(b, r)
        self.next = max(room, default=-1) + 1

    def _put(self, b: int, r: int) -> None:
        if r:
            self.by_room.setdefault(r, []).append(b)
            self.mask |= 1 << r

    def place(self, length: int) -> int:
        fits = self.mask >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            found = self.by_room[r]
            b = found.pop()
            if not found:
                self.mask ^= 1 << r
        else:
            b, r = self.next, self.capacity
            self.next += 1
        self._put(b, r - length)
        return b


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray | None = None) -> np.ndarray:
    """Bin of each piece; pieces in ``order`` are placed into the bins of the others (``bins``, -1: none)."""
    bins = np.full(len(lengths), -1, np.int64) if bins is None else bins.copy()
    placed = bins >= 0
    room = {}
    if placed.any():
        fill = np.bincount(bins[placed], lengths[placed]).astype(np.int64)
        used = np.unique(bins[placed])
        room = dict(zip(used.tolist(), (capacity - fill[used]).tolist()))
    open_ = Bins(capacity, room)
    bins[order] = [open_.place(n) for n in lengths[order].tolist()]
    return np.unique(bins, return_inverse=True)[1].reshape(-1)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: (-bins, mean squared fill)."""
    fill = np.bincount(bins, lengths) / capacity
    return -len(fill), float((fill * fill).mean()) if len(fill) else 0.0


def crossover(lengths, a, b, capacity, rng) -> np.ndarray:
    """Inject well-filled bins of ``b`` into ``a`` and best-fit what they displace."""
    fill = np.bincount(b, lengths)
    well = np.argsort(-fill, kind="stable")[:max(1, len(fill) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(well, max(1, len(well) // 2), replace=False)] = True
    injected = chosen[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[injected]] = True
    child = np.where(injected, b + len(broken), np.where(broken[a], -1, a))
    displaced = np.flatnonzero(child < 0)
    return best_fit(lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], capacity, child)


def mutate(lengths, bins, capacity, rng) -> np.ndarray:
    """Open some of the least filled bins and one in sixteen of the others."""
    fill = np.bincount(bins, lengths)
    gone = rng.random(len(fill)) < 1 / 16
    gone[np.argsort(fill, kind="stable")[:2]] = True
    child = np.where(gone[bins], -1, bins)
    out = np.flatnonzero(child < 0)
    return best_fit(lengths, out[np.argsort(-lengths[out], kind="stable")], capacity, child)


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS,
           population: int = POPULATION) -> np.ndarray:
    """The best grouping found; stops early at the fewest bins that the total length allows."""
    rng = np.random.default_rng(seed)
    fewest = -(-int(lengths.sum()) // capacity)
    score = lambda x: fitness(lengths, x, capacity)
    alive = list(seeds)
    if not alive:
        alive = [best_fit(lengths, np.argsort(-lengths, kind="stable"), capacity)]
    while len(alive) < population and -score(alive[0])[0] > fewest:
        noise = lengths * rng.uniform(0.8, 1.0, len(lengths))
        alive.append(best_fit(lengths, np.argsort(-noise, kind="stable"), capacity))
    alive.sort(key=score, reverse=True)
    for _ in range(generations):
        if -score(alive[0])[0] <= fewest or len(alive) < 2:
            break
        i, j = rng.choice(len(alive), 2, replace=False)
        child = crossover(lengths, alive[min(i, j)], alive[max(i, j)], capacity, rng)
        if rng.random() < 0.5:
            child = mutate(lengths, child, capacity, rng)
        alive = sorted([*alive, child], key=score, reverse=True)[:population]
    return alive[0]


def _island(capacity: int):
    """One epoch of one island: rows (shard, island, uid, length, own, guest) to its elite (own, score)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        lengths = pdf["length"].to_numpy(np.int64)
        seeds = [np.unique(pdf[c].to_numpy(np.int64), return_inverse=True)[1].reshape(-1)
                 for c in ("own", "guest") if c in pdf and (pdf[c] >= 0).all()]
        shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        bins = evolve(lengths, seeds, capacity, seed=shard * 1009 + island * 31 + len(seeds))
        n, full = fitness(lengths, bins, capacity)
        return pd.DataFrame({"shard": shard, "island": island, "uid": pdf["uid"].to_numpy(), "length": lengths,
                             "own": bins, "n_bins": -n, "full": full})
    return run


ELITE = "shard bigint, island int, uid bigint, length bigint, own bigint, n_bins bigint, full double"


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(uid, sequence_id) for items (uid, length), lengths from 1 to ``capacity``; uid is unique."""
    ready(items.sparkSession)
    done, level = None, 0
    while True:
        n = items.count()
        shards = max(1, -(-n // shard_pieces))
        start = items.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"),
                             F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
                             "uid", "length", F.lit(-1).cast("bigint").alias("own"), F.lit(-1).cast("bigint").alias("guest"))
        first = saved(start.groupBy("shard", "island").applyInPandas(_island(capacity), ELITE))
        # The elite of an island migrates to the next one and competes there with that island's own.
        moved = first.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), "uid", F.col("own").alias("guest"))
        met = first.select("shard", "island", "uid", "length", "own").join(moved, ["shard", "island", "uid"])
        second = saved(met.groupBy("shard", "island").applyInPandas(_island(capacity), ELITE))
        best = (second.groupBy("shard").agg(F.min(F.struct("n_bins", (-F.col("full")).alias("f"), "island")).alias("m"))
                .select("shard", F.col("m.island").alias("island")))
        chosen = second.join(best, ["shard", "island"])
        if shards > 1:
            fill = chosen.groupBy("shard", "own").agg(F.sum("length").alias("fill"))
            least = (fill.groupBy("shard").agg(F.min(F.struct("fill", "own")).alias("m"))
                     .where(F.col("m.fill") < capacity).select("shard", F.col("m.own").alias("own"), F.lit(True).alias("opened")))
            chosen = saved(chosen.join(least, ["shard", "own"], "left"))
            items = chosen.where("opened").select("uid", "length")
            chosen = chosen.where("opened is null")
        # level, shard and bin in one number: 8, 31 and 24 bits.
        number = F.lit(level << 55) + F.shiftleft("shard", 24) + F.col("own")
        out = chosen.select("uid", number.alias("sequence_id"))
        done = out if done is None else done.unionByName(out)
        if shards == 1:
            return done
        level += 1


def packed(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY,
           id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece
    with its sequence and its gapless place there."""
    own = saved(pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
                .withColumn("uid", F.monotonically_increasing_id()))
    where = pack(own.select("uid", "length"), capacity, shard_pieces)
    w = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.join(where, "uid").select("id", "piece", "start", "length", "ids_crc32", "sequence_id",
                                         (F.sum("length").over(w) - F.col("length")).alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
