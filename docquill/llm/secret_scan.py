"""Secret scans: fixed patterns, and novelty measured by dictionary-primed zstandard.

1. Every whole text is read once. The three patterns give the base spans.
   Candidates are runs of secret-like characters of ``MIN_RUN`` or more in a
   sensitive context: a sensitive word stands among the ``BEFORE`` characters
   before them. A run with ``=`` inside is cut there (padding at the end of a
   part stays with it): each part is a candidate of its own, with the part
   before it, its name, as context. The whole run counts only where none of
   its parts does. Candidates leave with the code or prose around them
   (``AROUND`` characters on either side), in which all secret-like runs,
   their parts and the base spans are blank: copies and neighbours of a secret
   do not make it known.
2. The identifiers in the distinct contexts of all candidates of the corpus
   are counted, once a context; the most frequent ones, up to
   ``DICTIONARY_BYTES``, become a zstandard dictionary.
3. A candidate's novelty is its marginal compressed size: compressed bytes of
   context and candidate less those of the context alone, both primed with
   the dictionary, per byte of the candidate. Runs that hardly compress
   (``NOVEL`` or more) are reported as spans of kind "novel", unless a base
   span already covers them.

Defined results: a null or empty text has no spans; rows are judged one by
one, whatever their ids; an empty table gives an empty result; extra columns
play no part.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import read, ready, saved

# The base patterns, in the order of their kinds, and the length
# that the value of a match must have.
KINDS = ("assign", "access", "hex", "novel")
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
HEX_RUN = re.compile(r"[0-9a-f]{24,}")      # same matches as BASE["hex"] once short ones are dropped
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|credential|auth|bearer|private|signature|cert|login", re.I | re.A)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")     # MIN_RUN or more
PART = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")     # of a run, with its padding
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")     # a plain word has no digit
MIN_RUN = 16
BEFORE = 48
AROUND = 200
DICTIONARY_BYTES = 16 << 10
NOVEL = 0.62                # marginal compressed bytes per byte; known words and repeats need less
HEX_BYTES = bytes(0x30 if c in b"0123456789abcdef" else 0x20 for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches that are long enough, by start, then kind."""
    out = []
    rx, group, least = BASE["assign"]
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in rx.finditer(text) if m.end(group) - m.start(group) >= least]
    rx, group, least = BASE["access"]
    out += [(m.start(), 1, m.end()) for m in rx.finditer(text) if m.end() - m.start() >= least]
    # A plain byte search tells whether any run is long enough before the pattern runs.
    if b"0" * BASE["hex"][2] in text.encode().translate(HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    return sorted(out)


def secret_like(run: str) -> bool:
    return len(run) >= MIN_RUN and bool(DIGIT.search(run) and LETTER.search(run))


def blanked(text: str, spans) -> str:
    """``text`` with spaces in place of the (start, end) ``spans``."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            out += [text[at:max(at, a)], " " * (b - max(at, a))]
            at = b
    return "".join(out) + text[at:]


def candidates(text: str, base: list) -> list[tuple[int, int, str, str]]:
    """(start, end, before, after) of runs and their parts in a sensitive context that no base span covers;
    the parts of a run come before the whole."""
    found, blank = [], [(a, b) for a, _, b in base]
    starts = [a for a, _, _ in base]                            # rising
    reach = list(accumulate((b for _, _, b in base), max))      # the furthest end of a span up to each
    covered = lambda c, d: (k := bisect_right(starts, c)) > 0 and reach[k - 1] >= d
    if not DIGIT.search(text):
        return []
    for m in RUN.finditer(text):
        a, b = m.span()
        if not secret_like(m[0]):
            continue
        parts = [p.span() for p in PART.finditer(text, a, b)] if "=" in m[0] else []
        like = [(c, d) for c, d in parts if secret_like(text[c:d])]
        blank += like or [(a, b)]
        name = a                        # start of the part before
        for c, d in [*parts, (a, b)] if parts != [(a, b)] else parts:
            if secret_like(text[c:d]) and not covered(c, d) \
                    and SENSITIVE.search(text, max(0, min(name, c - BEFORE)), c):
                found.append((c, d))
            name = c
    if not found:
        return []
    rest = blanked(text, blank)
    return [(a, b, rest[max(0, a - AROUND):a], rest[b:b + AROUND]) for a, b in found]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


FOUND = ("id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<struct<a:bigint,k:int,b:bigint>>, "
         "candidates array<struct<a:bigint,b:bigint,before:string,run:string,after:string>>")


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                base = base_spans(text)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((name, *n, hashlib.sha256(joined(base).encode()).hexdigest(),
                             [{"a": a, "k": k, "b": b} for a, k, b in base],
                             [{"a": a, "b": b, "before": x, "run": text[a:b], "after": y}
                              for a, b, x, y in candidates(text, base)]))
            cols = list(zip(*rows)) or [()] * 7
            span = pa.struct([("a", pa.int64()), ("k", pa.int32()), ("b", pa.int64())])
            cand = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("before", pa.string()), ("run", pa.string()), ("after", pa.string())])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span), pa.list_(cand))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             ["id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates"])

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return d.mapInArrow(run, FOUND)


def identifiers(found: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """The identifiers of most contexts of candidates, up to ``size`` bytes, the most frequent last
    (zstandard reaches the end of a dictionary most cheaply). Equal contexts count once. Only that many reach the driver."""
    around = found.select(F.explode("candidates").alias("c")).select(F.concat_ws(" ", "c.before", "c.after").alias("t")).distinct()
    each = F.array_distinct(F.regexp_extract_all("t", F.lit(r"([\p{L}_][\p{L}\p{N}_]{2,})"), F.lit(1)))
    words = around.select(F.explode(each).alias("w"))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size // 4).collect()
    out, total = [], 0
    for row in top:
        w = row["w"].encode()
        if total + len(w) + 1 > size:
            break
        out.append(w)
        total += len(w) + 1
    return b" ".join(reversed(out))


class Novelty:
    """Marginal compressed size of a run in its context, primed with a raw-content dictionary."""

    def __init__(self, dictionary: bytes):
        import zstandard

        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        self.coder = zstandard.ZstdCompressor(level=9, dict_data=data, write_content_size=False, write_checksum=False)

    def of(self, before: str, run: str, after: str) -> float:
        around = (before + after).encode()
        whole = (before + run + after).encode()
        return (len(self.coder.compress(whole)) - len(self.coder.compress(around))) / len(run)

    def is_secret(self, before: str, run: str, after: str) -> bool:
        return self.of(before, run, after) >= NOVEL


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans): one row per row of ``docs``; ``spans`` holds the
    base spans and the novel ones as (kind, start, end), by start, then kind, in code points."""
    ready(docs.sparkSession)
    found = saved(_found(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(identifiers(found))    # DICTIONARY_BYTES at most

    def run(batches):
        novelty = Novelty(shared.value)
        for batch in batches:
            out = []
            for base, cand in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                spans = [(s["a"], s["k"], s["b"]) for s in base]
                last = -1               # start of the last part found
                for c in cand:
                    if c["a"] > last and novelty.is_secret(c["before"], c["run"], c["after"]):
                        spans.append((c["a"], 3, c["b"]))
                        last = c["a"]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, kind)],
                                             ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(run, "id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
                                 "spans array<struct<kind:string,start:bigint,end:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(read(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256",
                        F.array_join(F.transform("spans", one), ",").alias("spans"))
