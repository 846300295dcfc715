"""Spelling variants: words one code point apart, by a trie frontier of joins.

1. Words: letter runs of every whole text, counted. ``words`` drops short and
   single ones; in the query some runs lose a letter first (see ``damaged``).
2. Edge table of a trie over all words, each closed by an end mark: rows
   (depth, parent, c, child). Words are range-partitioned and sorted, so that a
   word meets the neighbours that share its longest prefixes: it adds the edges
   past its predecessor's prefix, down to the first node that is its own. That
   node is a leaf and holds the word; nothing below it is stored.
3. Frontier: a state is two places of the trie that read the same letters but
   for one edit, (a, b, at): a replaced letter puts them on one level, an
   inserted one puts ``b`` a level deeper. Words with a common prefix share
   their states. States start at the edges of each node; level by level both
   places move along equal letters, by equi-joins with the edge table. A place
   in a leaf moves along its word. Two leaves are a candidate, and its words
   are compared in full.
4. An insertion into a run of equal letters counts as one at the run's end, so
   every pair of near words comes out once, with all links and no cap.

A level costs a join, so words of ``LONG`` code points or more meet among each
other by hashes of their one-letter deletions instead, verified the same way.

The largest near word that is ``ratio`` times as frequent is a word's form;
forms are followed to the last one by doubling joins.

Defined results: null and empty texts have no words; a null id reads as an
empty string; rows that repeat an id and text count again; an empty table gives
an empty result; extra columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import read, ready, saved, shared_path

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG = 32                   # code points from which words meet by hashes of deletions
RATIO = 10
END = -1                    # the end mark's letter

EDGE = "depth int, parent bigint, c int, child bigint, word string, n bigint"
STATE = ["at", "longer", "a", "aw", "an", "b", "bw", "bn"]


def damaged(word: Column, id_: Column, every: int = 31) -> Column:
    """``word`` less its code point h % length where ``every`` divides h, the
    crc32 of ``<id>:<word>``."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    k = F.pmod(h, F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), k), F.substring(word, k + 2, F.char_length(word)))).otherwise(word)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, least: int = 2,
          damage: bool = False) -> DataFrame:
    """(word, n): the letter runs of ``least_letters`` code points or more that occur ``least`` times or more."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least_letters},}}"), F.lit(0)))
    d = docs.select(F.col(id_col).alias("id"), run.alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = damaged(F.col("run"), F.col("id")) if damage else F.col("run")
    d = d.select(word.alias("word"))
    if damage:
        d = d.where(F.char_length("word") >= least_letters)
    return d.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# --------------------------------------------------------------------------
# The trie's edges


def _edges(batches):
    """Edges of sorted words (word, n) of one partition."""
    import xxhash

    node = lambda prefix: xxhash.xxh64_intdigest(prefix.encode(), 7) - (1 << 63)
    out = []
    path = [node("")]           # nodes of the prefixes of the word in hand
    held, before = None, None   # (word, n) whose next neighbour is awaited, and what it shares with the one before

    def shared(a, b):
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        return k

    def emit(word, n, first, own):
        """Edges from depth ``first`` on; the one to the node of depth ``own`` is a leaf."""
        del path[first + 1:]
        for d in range(first, own):
            c = ord(word[d]) if d < len(word) else END
            leaf = d + 1 == own
            if not leaf:
                path.append(node(word[:d + 1]))
            out.append((d, path[d], c, None if leaf else path[d + 1], word if leaf else None, n if leaf else None))

    def flush():
        cols = list(zip(*out)) or [()] * 6
        out.clear()
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          ["depth", "parent", "c", "child", "word", "n"])

    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held:
                k = shared(held[0], word)
                # The neighbours of a partition's first word are not all known: it gets its whole path.
                own = len(held[0]) + 1 if before is None else max(before, k) + 1
                emit(*held, before or 0, own)
                before = k
            held = (word, n)
        if len(out) >= 50_000:
            yield flush()
    if held:
        emit(*held, before or 0, len(held[0]) + 1)
    yield flush()


def edge_table(words: DataFrame) -> DataFrame:
    """The trie's edges (depth, parent, c, child, word, n): ``child`` is an inner node, or null where ``word`` (with ``n``) ends the path."""
    ready(words.sparkSession)
    dealt = words.repartitionByRange("word").sortWithinPartitions("word").select("word", "n")
    return dealt.mapInArrow(_edges, EDGE).distinct()    # first words of partitions repeat edges


# --------------------------------------------------------------------------
# The frontier


def _letter(word: Column, place: Column) -> Column:
    """The letter at ``place`` (from 0) of a word, or the end mark."""
    return F.when(place < F.char_length(word), F.ascii(F.substring(word, place + 1, F.lit(1)))).otherwise(F.lit(END))


def _renamed(edges: DataFrame, p: str) -> DataFrame:
    return edges.select(F.col("parent").alias(f"{p}p"), F.col("c").alias(f"{p}c"), F.col("child").alias(f"{p}x"),
                        F.col("word").alias(f"{p}w"), F.col("n").alias(f"{p}n"), F.col("depth").alias(f"{p}d"))


def _pair(longer: int, at: Column, a: str, b: str) -> list[Column]:
    return [at.cast("int").alias("at"), F.lit(longer).alias("longer"), F.col(f"{a}x").alias("a"), F.col(f"{a}w").alias("aw"),
            F.col(f"{a}n").alias("an"), F.col(f"{b}x").alias("b"), F.col(f"{b}w").alias("bw"), F.col(f"{b}n").alias("bn")]


def first_states(edges: DataFrame) -> DataFrame:
    """States right after their edit, with the level ``d`` of place ``a``."""
    e, f, g = _renamed(edges, "e"), _renamed(edges, "f"), _renamed(edges, "g")
    level = (F.col("ed") + 1).alias("d")
    # A letter replaced by another: two edges of a node, at most as many pairs as the alphabet has.
    replaced = e.join(f, F.col("ep") == F.col("fp")).where((F.col("ec") < F.col("fc")) & (F.col("ec") != END))
    replaced = replaced.select(level, *_pair(0, F.col("ed"), "e", "f"))
    # A letter f inserted at node p, and the first letter e after it, which differs: e leaves p and f's end alike.
    inner = f.where("fx is not null").join(g, F.col("fx") == F.col("gp")).where(F.col("fc") != F.col("gc"))
    inner = inner.join(e, (F.col("fp") == F.col("ep")) & (F.col("gc") == F.col("ec"))).select(level, *_pair(1, F.col("ed"), "e", "g"))
    leaf = f.where((F.col("fc") != END) & F.col("fw").isNotNull()).withColumn("next", _letter(F.col("fw"), F.col("fd") + 1))
    leaf = leaf.where(F.col("next") != F.col("fc")).withColumn("fx", F.lit(None).cast("bigint"))
    leaf = leaf.join(e, (F.col("fp") == F.col("ep")) & (F.col("next") == F.col("ec"))).select(level, *_pair(1, F.col("ed"), "e", "f"))
    return replaced.unionByName(inner).unionByName(leaf)


def advance(states: DataFrame, edges: DataFrame, below: DataFrame) -> DataFrame:
    """Both places of each state moved along one equal letter. ``edges``: those
    of the states' level ``d``; ``below``: of the next. The level is a column,
    so that all levels run the same compiled code."""
    e, up = _renamed(edges, "e"), (F.col("d") + 1).alias("d")
    moved = states.where("a is not null").join(e, F.col("a") == F.col("ep"))
    moved = moved.where(F.col("bw").isNull() | (F.col("ec") == _letter(F.col("bw"), F.col("d") + F.col("longer"))))
    moved = moved.select("d", "at", "longer", F.col("ec").alias("c"), F.col("ex").alias("a"), F.col("ew").alias("aw"),
                         F.col("en").alias("an"), "b", "bw", "bn")
    along = states.where("aw is not null").select("d", "at", "longer", _letter(F.col("aw"), F.col("d")).alias("c"), "a", "aw", "an",
                                                  "b", "bw", "bn")
    g = _renamed(edges.unionByName(below), "g")
    half = moved.unionByName(along).where("b is not null")
    inner = half.join(g, (F.col("b") == F.col("gp")) & (F.col("c") == F.col("gc")))
    inner = inner.select(up, "at", "longer", "a", "aw", "an", F.col("gx").alias("b"), F.col("gw").alias("bw"), F.col("gn").alias("bn"))
    return inner.unionByName(moved.where("bw is not null").select(up, *STATE))


def verified(pairs: DataFrame) -> DataFrame:
    """(a, an, b, bn): candidate words that differ by one edit at ``at`` and nothing else."""
    tail = lambda w, k: F.substring(F.col(w), k, F.char_length(w))
    same = ((F.substring("aw", F.lit(1), F.col("at")) == F.substring("bw", F.lit(1), F.col("at")))
            & (tail("aw", F.col("at") + 2 - F.col("longer")) == tail("bw", F.col("at") + 2))
            & (F.char_length("aw") + F.col("longer") == F.char_length("bw")))
    return pairs.where(same).select(F.col("aw").alias("a"), "an", F.col("bw").alias("b"), "bn")


def _by_level(df: DataFrame, level: str) -> DataFrame:
    """``df`` saved in a folder for each level."""
    path = shared_path(df.sparkSession)
    df.write.partitionBy(level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _short_pairs(words: DataFrame, long: int) -> DataFrame:
    """Near words of which one has less than ``long`` code points."""
    spark = words.sparkSession
    table = _by_level(edge_table(words.where(F.char_length("word") <= long)), "depth")
    starts = _by_level(first_states(table), "d")
    level_of = lambda d: table.where(F.col("depth") == d)
    deepest = table.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]
    both = "aw is not null and bw is not null"
    found, moved = [starts.where(both)], None
    for level in range(1, deepest + 1):
        here = starts.where((F.col("d") == level) & ~F.expr(both))
        if moved is not None:
            here = here.unionByName(moved.where(f"not ({both})"))
        moved = saved(advance(here, level_of(level), level_of(level + 1)))
        found.append(moved.where(both))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return verified(out).where(F.char_length("a") < long)


# --------------------------------------------------------------------------
# Long words


PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (911382323, 972663749)


def deletion_hashes(word: str) -> tuple[int, np.ndarray]:
    """A hash of the word, and of the word less each of its code points."""
    codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
    whole, parts = 0, np.zeros(len(codes), np.int64)
    for prime, base in zip(PRIMES, BASES):
        power = np.ones(1, np.int64)
        while len(power) < len(codes):      # base ** 0, 1, 2, ...
            power = np.concatenate([power, power * pow(base, len(power), prime) % prime])
        sums = np.cumsum(codes * power[:len(codes)] % prime) % prime
        inverse = pow(base, -1, prime)
        before = np.concatenate([[0], sums[:-1]])
        parts = parts * prime + (before + (sums[-1] - sums) % prime * inverse) % prime
        whole = whole * prime + int(sums[-1])
    return whole, parts


def _long_pairs(words: DataFrame, long: int) -> DataFrame:
    """Near words among those of ``long`` code points or more."""
    ready(words.sparkSession)
    w = words.where(F.char_length("word") >= long).select(F.xxhash64("word").alias("key"), "word", "n")

    def run(batches):
        for batch in batches:
            for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole, parts = deletion_hashes(word)
                codes = np.frombuffer(word.encode("utf-32-le"), "<u4")
                last = np.append(codes[1:] != codes[:-1], True)     # ends of runs of equal letters
                place = np.arange(-1, len(parts), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(place), key, np.int64)), pa.array(np.concatenate([[whole], parts]).astype(np.int64)),
                    pa.array(place), pa.array(np.append(False, last))], ["key", "h", "at", "last"])

    v = saved(w.select("key", "word").mapInArrow(run, "key bigint, h bigint, at int, last boolean"))
    b = v.select(F.col("key").alias("bk"), "h", F.col("at").alias("bat"), "last")
    replaced = v.where("at >= 0").join(b, "h").where((F.col("at") == F.col("bat")) & (F.col("key") < F.col("bk")))
    inserted = v.where("at < 0").join(b.where("last"), "h")
    pairs = replaced.select("key", "bk", "at", F.lit(0).alias("longer")).unionByName(
        inserted.select("key", "bk", F.col("bat").alias("at"), F.lit(1).alias("longer")))
    pairs = pairs.join(w.select("key", F.col("word").alias("aw"), F.col("n").alias("an")), "key")
    pairs = pairs.join(w.select(F.col("key").alias("bk"), F.col("word").alias("bw"), F.col("n").alias("bn")), "bk")
    return verified(pairs)


# --------------------------------------------------------------------------


def near_words(words: DataFrame, long: int = LONG) -> DataFrame:
    """(a, an, b, bn): all pairs of ``words`` (word, n; distinct) one inserted, deleted or replaced code point apart, each once."""
    return _short_pairs(words, long).unionByName(_long_pairs(words, long))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of every word that has one; ``forms``: (word, form), without cycles."""
    cur = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        cur = saved(cur.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"),
                                                        F.col("beyond").isNotNull().alias("moved")))
        if not cur.where("moved").limit(1).count():
            return cur.select("word", "root")
        cur = cur.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of ``words`` (word, n; distinct)."""
    words = saved(words.select("word", "n"))
    pairs = near_words(words, long)
    links = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("bn").alias("m"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("word"), F.col("an").alias("m"), F.col("a").alias("other")))).alias("l")).select("l.*")
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    taken = F.coalesce(-F.col("best.m") >= F.col("n") * ratio, F.lit(False))
    all_ = saved(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n")))
    last = roots(all_.where("form is not null").select("word", "form"))
    return all_.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(read(spark, sf_dir, "documents"), damage=True))
