"""Token files: ids of all documents in id order, coded with a static range
asymmetric numeral system.

Documents are range-partitioned by id (ties by text hash, so a hot id spreads)
into parts of about ``PART_BYTES`` of text and tokenized there. A part is a
file of segments of whole documents, about ``SEGMENT_TOKENS`` each. A segment
row holds one frequency table, shared by its independent interleaved blocks
(states = checkpoints, words, checksums), and its documents' ids and lengths.
Segments decode in parallel, and any block alone.

Defined results: a null text counts as empty and is its end id only; null ids
come first; rows that share an id stand next to each other in text-hash order;
an empty table gives empty files and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquill.llm import rans
from docquill.llm.common import per_worker, read, ready, shared_path
from docquill.llm.token_counts import vocabulary
from docquill.llm.tokens import WordIds, slices

PART_BYTES = 32 << 20       # text of a file part
SEGMENT_TOKENS = 1 << 22    # tokens after which a segment ends, at the end of a document
GROUP = 4096                # parts whose segments one window task numbers

SEGMENT = ("seq bigint, n_tokens bigint, symbols binary, freqs binary, bits int, doc_ids array<bigint>, "
           "lengths array<bigint>, blocks array<struct<n:bigint,states:binary,words:binary,crc:bigint,ids_crc:bigint>>")
BLOCK_TYPE = pa.list_(pa.struct([("n", pa.int64()), ("states", pa.binary()), ("words", pa.binary()),
                                 ("crc", pa.int64()), ("ids_crc", pa.int64())]))


def _segment(seq: int, docs: list, lengths: list, flat: np.ndarray) -> pa.RecordBatch:
    table = rans.Table.of(flat)
    return pa.RecordBatch.from_arrays([
        pa.array([seq], pa.int64()), pa.array([len(flat)], pa.int64()),
        pa.array([table.symbols.astype("<u4").tobytes()], pa.binary()),
        pa.array([table.freqs.astype("<u4").tobytes()], pa.binary()), pa.array([table.bits], pa.int32()),
        pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
        pa.array([rans.encode(flat, table)], BLOCK_TYPE)],
        ["seq", "n_tokens", "symbols", "freqs", "bits", "doc_ids", "lengths", "blocks"])


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES,
                      segment_tokens: int = SEGMENT_TOKENS, find=vocabulary) -> None:
    """Write the ids of every text, each followed by ``end_id``, in id order under ``path``."""
    ready(docs.sparkSession)

    def run(batches):
        coder = per_worker(f"ids:{tokenizer}", lambda: WordIds(find(tokenizer)))
        seq, names, lengths, parts, size = 0, [], [], [], 0
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                ids, sizes = coder.ids(texts, end_id)
                own = batch.column(0).slice(at, len(sizes)).to_pylist()
                at, begin, first = at + len(sizes), 0, 0
                ends = np.cumsum(sizes)
                while begin < len(sizes):       # whole documents up to the segment's size
                    most = int(np.searchsorted(ends, first + segment_tokens - size)) + 1
                    stop = min(most, len(sizes))
                    last = int(ends[stop - 1])
                    names += own[begin:stop]
                    lengths += sizes[begin:stop].tolist()
                    parts.append(ids[first:last])
                    size += last - first
                    begin, first = stop, last
                    if size >= segment_tokens:
                        yield _segment(seq, names, lengths, np.concatenate(parts))
                        seq, names, lengths, parts, size = seq + 1, [], [], [], 0
        if names:
            yield _segment(seq, names, lengths, np.concatenate(parts))

    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0]
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("t"))
    d = d.withColumn("h", F.xxhash64("t")).repartitionByRange(max(1, -(-size // part_bytes)), "id", "h")
    d = d.sortWithinPartitions("id", "h").select("id", "t")
    out = d.mapInArrow(run, SEGMENT).select(F.spark_partition_id().cast("bigint").alias("part"), "*")
    out.write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) per document, decoded from the files at ``path``."""
    ready(spark)
    names = ["part", "seq", "place", "id", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                s = {k: batch.column(k)[row].as_py() for k in batch.schema.names}
                table = rans.Table(np.frombuffer(s["symbols"], "<u4"), np.frombuffer(s["freqs"], "<u4"), s["bits"])
                data = rans.decode(s["blocks"], table).astype("<u4").tobytes()
                ends = (np.cumsum(s["lengths"]) * 4).tolist()
                own = [data[a:b] for a, b in zip([0, *ends], ends)]
                n = len(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array([s["part"]] * n, pa.int64()), pa.array([s["seq"]] * n, pa.int64()),
                    pa.array([0, *[e // 4 for e in ends[:-1]]], pa.int64()), pa.array(s["doc_ids"], pa.int64()),
                    pa.array(s["lengths"], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    *([pa.array(own, pa.binary())] if with_ids else [])], names)

    schema = "part bigint, seq bigint, place bigint, id bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    files = spark.read.schema("part bigint, " + SEGMENT).parquet(path)
    docs = files.mapInArrow(run, schema)
    # Tokens before a segment: of earlier groups of parts, then of earlier segments in the group.
    seg = files.select("part", "seq", "n_tokens", F.floor(F.col("part") / GROUP).alias("g"))
    groups = seg.groupBy("g").agg(F.sum("n_tokens").alias("n"))
    groups = groups.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before_group"))
    inside = F.sum("n_tokens").over(Window.partitionBy("g").orderBy("part", "seq")) - F.col("n_tokens")
    begin = seg.withColumn("inside", inside).join(groups, "g").select(
        "part", "seq", (F.col("before_group") + F.col("inside")).alias("first"))
    return docs.join(begin, ["part", "seq"]).select(
        "id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    write_token_files(read(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).withColumnRenamed("id", "doc_id")
