"""Line dedup across the corpus by a deletion-neighbourhood join [native].

A line is a \\n-split piece with a word in it; two lines are alike if their
word sequences differ by at most one word inserted, deleted or replaced
(lines of fewer than ``MIN_WORDS`` words: by none). A line is dropped if an
earlier line of the corpus, in the order of document id, text hash and line
number, is like it. Lines without a word always stay.

1. One pass makes a table of all lines without their texts: hashes, place,
   and keys of the line's first and last half (rounded down to a power of
   two). Lines at most one word apart share one of these keys, so only lines
   with a shared key can be alike (pigeonhole).
2. For those lines all variants within the bound are made: the line itself
   and the line less each one word, as hashed keys in time linear in the line
   (position-keyed sums).
3. Equal variants are joined. Lines that agree after deletion at the same
   place differ by one replaced word; a line equal to another's variant
   differs by one inserted word. Both kinds need only the earliest line of a
   key, so no pairs within a group are made.
4. The edit distance of each line and its earliest partners is verified on
   the words, and the earliest verified line is kept.

With ``words_per_edit`` the bound grows: two lines are also alike if their word
edit distance is at most one edit per so many words of the shorter one. For
pairs of more than one edit, a line is cut into blocks, more of them than its
edits, so that one block stands unchanged in the other line, shifted by no more
words than there are edits. Blocks meet the windows of earlier lines, and the
edit distance of the pairs is verified on the words. A passage that stands at
like places in many lines makes pairs with the square of their number.

Before each join the larger side passes a bitmap of the other's keys of 4 MB.

Defined results: null texts stay null and have no lines; rows that agree in
id and text count as one document, and each of them gets its result; null ids
come first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquill.functions._util import bind, explode_rows
from docquill.llm.common import among, read, saved
from docquill.llm.quality_rules import SPACE_CHARS

MIN_WORDS = 5
WORDS_PER_EDIT = 10         # of the query op1_line_dedup_by_length


def _half_keys() -> Column:
    """Hashes of the first and last words of a line, for partners of as many words or one more, and of one less."""
    def tier(n):            # the largest power of two up to half of n
        return f"shiftleft(1, length(bin(cast(({n}) div 2 as bigint))) - 1)"

    def pair(n):
        m = tier(n)
        return F.expr(f"array(xxhash64('first', {m}, substring_index(line, ' ', {m})), xxhash64('last', {m}, substring_index(line, ' ', -{m})))")

    both = F.when(F.expr(f"{tier('n')} = {tier('n - 1')}"), pair("n")).otherwise(F.concat(pair("n"), pair("n - 1")))
    return F.when(F.col("n") >= MIN_WORDS, both).otherwise(F.expr("cast(array() as array<bigint>)"))


def _plain(text: Column) -> Column:
    """The text with one space between the words of a line, and none around them.

    Done on whole texts: as an expression on each line it would be evaluated
    again in every filter on the line. A text is only copied for what it contains."""
    def put(t, old, new, by=F.replace):
        return bind(t, lambda x: F.when(F.contains(x, F.lit(old)), by(x, F.lit(old), F.lit(new))).otherwise(x))

    for c in SPACE_CHARS.replace(" ", "").replace("\n", ""):
        text = put(text, c, " ")
    text = put(text, "  ", " ", lambda x, _, one: F.regexp_replace(x, " {2,}", one))
    return F.trim(put(put(text, " \n", "\n"), "\n ", "\n"))


def _lines(docs: DataFrame) -> DataFrame:
    """(id, th, pos, line, n): the lines with a word of rows (id, th, text), as
    words with one space between them, and their number of words."""
    every = explode_rows(docs, F.split(_plain(F.col("text")), "\n"), ["id", "th"], pos="pos", value="line").where("line <> ''")
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return every.select("id", "th", "pos", "line").withColumn("n", n)


ORDER = ("id", "th", "pos")     # nulls first, as in any ascending order


def _alike() -> Column:
    """True if the arrays a and b differ by at most one word inserted, deleted or replaced."""
    a, b = F.col("a"), F.col("b")
    # Words that agree from the start, as the place of the first that does not.
    same = F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))),
                      lambda x, y: x == y)
    first = F.array_position(same, False).cast("int")

    def rest(p):
        at = F.when(p == 0, F.least(F.size(a), F.size(b)) + 1).otherwise(p)
        tail = lambda x, k: F.slice(x, at + k, F.size(x))
        return F.when(F.size(a) == F.size(b), tail(a, 1) == tail(b, 1)) \
            .when(F.size(a) == F.size(b) + 1, tail(a, 1) == tail(b, 0)) \
            .when(F.size(a) + 1 == F.size(b), tail(a, 0) == tail(b, 1)).otherwise(False)
    return bind(first, rest)


def _variants(texts: DataFrame) -> DataFrame:
    """(v, i, h): for each line h its own hash (i = 0) and those of the line less its i-th word.

    g(w, j) sums up to the line's hash; the words after a deleted one count
    with the place before, so running sums give every variant.
    """
    g = lambda j: F.shiftrightunsigned(F.xxhash64("w", j), 1 + 30)
    g2 = lambda j: F.shiftrightunsigned(F.xxhash64(F.lit("b"), "w", j), 1 + 30)
    words = texts.select("h", F.posexplode("words").alias("j", "w")).withColumn("j", F.col("j") + 1)
    words = words.select("h", "j", g(F.col("j")).alias("a"), g2(F.col("j")).alias("b"),
                         g(F.col("j") - 1).alias("a0"), g2(F.col("j") - 1).alias("b0"))
    upto = Window.partitionBy("h").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("h").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = lambda c, w: F.sum(c).over(w)
    less = lambda c: s(c, upto) - F.col(c) + s(c + "0", after) - s(c + "0", upto)
    rows = words.select("h", "j", F.xxhash64(less("a"), less("b")).alias("v"),
                        F.xxhash64(s("a", after), s("b", after)).alias("own"))
    return rows.select("h", F.explode(F.when(F.col("j") == 1, F.array(
        F.struct(F.col("own").alias("v"), F.lit(0).alias("i")), F.struct("v", F.col("j").alias("i"))))
        .otherwise(F.array(F.struct("v", F.col("j").alias("i"))))).alias("x")).select("x.v", "x.i", "h")


def _near(docs: DataFrame, lines: DataFrame, first: DataFrame) -> DataFrame:
    """(h, other): each line hash with an earlier line that is alike, and the earliest such line's place."""
    keyed = lines.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "h")
    shared = keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    shared = saved(shared)
    some = saved(among(keyed, "key", shared).join(shared, "key").select("h").distinct())
    # The words of those lines, from the texts.
    worded = _lines(docs).where(F.col("n") >= MIN_WORDS).select(F.xxhash64("line").alias("h"), "line")
    texts = saved(among(worded, "h", some).join(some, "h").groupBy("h").agg(F.first("line").alias("line"))
                  .select("h", F.split("line", " ").alias("words")))
    variants = saved(_variants(texts))
    met = variants.groupBy("v").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("v")
    met = saved(met)
    place = among(first.select("h", "o"), "h", some).groupBy("h").agg(F.min("o").alias("o"))
    rows = saved(among(variants, "v", met).join(met, "v").join(place, "h"))
    # Earliest line by variant and place of deletion, and by variant: whole lines, shortened lines.
    replaced = rows.where("i > 0").groupBy("v", "i").agg(F.min(F.struct("o", "h")).alias("m"))
    either = rows.groupBy("v").agg(F.min(F.when(F.col("i") == 0, F.struct("o", "h"))).alias("whole"),
                                   F.min(F.when(F.col("i") > 0, F.struct("o", "h"))).alias("cut"))
    by_place = rows.join(replaced, ["v", "i"]).select("h", "o", F.col("m.o").alias("other"), F.col("m.h").alias("g"))
    by_word = rows.join(either, "v").select("h", "o", F.when(F.col("i") == 0, F.col("cut")).otherwise(F.col("whole")).alias("m"))
    by_word = by_word.select("h", "o", F.col("m.o").alias("other"), F.col("m.h").alias("g"))
    pairs = by_place.unionByName(by_word).where("other < o").select("h", "other", "g").distinct()
    checked = (pairs.join(texts.select("h", F.col("words").alias("a")), "h")
               .join(texts.select(F.col("h").alias("g"), F.col("words").alias("b")), "g").where(_alike()))
    return checked.groupBy("h").agg(F.min("other").alias("other"))


def _block(n: str, w: int) -> str:
    """Words in a block of a line of n words: a power of two, for more blocks than edits."""
    return f"shiftleft(1, length(bin(cast(({n}) div (({n}) div {w} + 1) as bigint))) - 1)"


def _within(bound: Column) -> Column:
    """True if the word arrays a and b are at most ``bound`` edits apart: words become characters of their own."""
    def spelled(words, known):
        codes = F.transform(words, lambda x: F.lpad(F.hex(F.array_position(known, x) + F.lit(0x10000)), 8, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")
    return bind(F.array_distinct(F.concat("a", "b")),
                lambda known: F.call_function("levenshtein", spelled(F.col("a"), known), spelled(F.col("b"), known)) <= bound)


def _near_more(docs: DataFrame, first: DataFrame, w: int) -> DataFrame:
    """(h, other): as ``_near``, for lines of 2 * w words or more and one edit per w words of the shorter line."""
    worded = _lines(docs).where(F.col("n") >= 2 * w).select(F.xxhash64("line").alias("h"), "line", "n")
    texts = worded.groupBy("h").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    place = first.groupBy("h").agg(F.min("o").alias("o"))
    texts = saved(texts.join(place, "h").select("h", "n", "o", F.split("line", " ").alias("words")))
    hashed = texts.select("h", "n", "o", F.transform("words", lambda x: F.xxhash64(x)).alias("wh"))
    key = "xxhash64(slice(wh, i + 1, m), m)"
    at = f"named_struct('key', {key}, 's', i)"
    cut = F.expr(f"transform(array({_block('n', w)}), m -> transform(sequence(0, n div m - 1), k -> "
                 f"transform(array(int(k * m)), i -> {at})[0]))[0]")
    # Partners have up to n div w words more, or lose up to as many as their own bound allows.
    sizes = F.expr(f"array_distinct(transform(sequence(greatest({2 * w}, n - n div {w}), n + n div {w}), p -> int({_block('p', w)})))")
    every = F.expr(f"flatten(transform(sizes, m -> transform(sequence(0, n - m), i -> {at})))")
    blocks = saved(explode_rows(hashed, cut, ["h", "n", "o"], value="x").select("x.key", "x.s", "h", "n", "o"))
    windows = explode_rows(hashed.withColumn("sizes", sizes), every, ["h"], value="x").select("x.key", F.col("x.s").alias("t"), F.col("h").alias("g"))
    windows = saved(among(windows, "key", blocks.select("key").distinct()))
    shared = windows.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("key")
    shared = saved(shared)
    windows = among(windows, "key", shared).join(shared, "key").join(texts.select(F.col("h").alias("g"), F.col("n").alias("gn"), F.col("o").alias("other")), "g")
    bound = F.expr(f"least(n, gn) div {w}")
    blocks = among(blocks, "key", shared).join(shared, "key")
    pairs = blocks.join(windows, (blocks["key"] == windows["key"]) & (F.col("other") < F.col("o"))
                        & (F.abs(F.col("s") - F.col("t")) <= bound) & (F.abs(F.col("n") - F.col("gn")) <= bound))
    pairs = saved(pairs.select("h", "g", "other", bound.alias("bound")).distinct())
    checked = (pairs.join(texts.select("h", F.col("words").alias("a")), "h")
               .join(texts.select(F.col("h").alias("g"), F.col("words").alias("b")), "g").where(_within(F.col("bound"))))
    return checked.groupBy("h").agg(F.min("other").alias("other"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int | None = None) -> DataFrame:
    """(id, th, pos, kept): every dropped line's place and the earliest line alike,
    as a struct (id, th, pos); th is the hash of the document's text. The bound is
    one edit, or with ``words_per_edit`` one for every so many words, where that is more."""
    if words_per_edit is not None and words_per_edit < MIN_WORDS:
        raise ValueError(f"words_per_edit must be {MIN_WORDS} or more")
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    d = d.where(F.col("text").isNotNull())
    lines = saved(_lines(d).select("id", "th", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("line"), "line").alias("h2"),
                                   _half_keys().alias("keys")).distinct())
    first = saved(lines.groupBy("h", "h2").agg(F.min(F.struct(*ORDER)).alias("o"), F.count(F.lit(1)).alias("n")))
    near = _near(d, lines, first)
    if words_per_edit:
        near = near.unionByName(_near_more(d, first, words_per_edit)).groupBy("h").agg(F.min("other").alias("other"))
    state = first.join(near, "h", "left").select("h", "h2", "o", "n", F.least("o", "other").alias("kept"))
    state = saved(state.where("n > 1 or kept < o"))
    return (among(lines, "h", state).join(state, ["h", "h2"]).where(F.struct(*ORDER) != F.col("kept"))
            .select("id", "th", "pos", "kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int | None = None,
                dropped_col: str | None = "_dropped") -> DataFrame:
    """``docs`` with the dropped lines taken out of the text, all columns kept
    whatever their names. ``dropped_col`` (None: no such column) adds an array of
    (pos, kept), null where nothing was dropped; it replaces a column of that name."""
    gone = dropped_lines(docs, id_col, text_col, words_per_edit)
    gone = saved(gone.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("pos", "kept"))).alias("dropped")))
    g = gone.select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th"), "dropped")
    # The caller's row stays one struct, so that no name of its columns meets ours.
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"))
    both = d.join(g, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    own = F.col("row").getField(text_col)

    def without(lines):
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped.pos"))
        return F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n")

    text = F.when(F.col("dropped").isNull(), own).otherwise(bind(F.split(own, "\n"), without))
    both = both.select("row", text.alias("text"), "dropped")
    kept = [(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c != dropped_col]
    return both.select(*kept, *([F.col("dropped").alias(dropped_col)] if dropped_col else []))


def query(spark: SparkSession, sf_dir: str, words_per_edit: int | None = None) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = dedup_lines(docs.select("doc_id", "text"), words_per_edit=words_per_edit)
    one = lambda x: F.concat_ws(":", x["pos"], x["kept"]["id"], x["kept"]["pos"])
    dropped = F.array_join(F.transform("_dropped", one), ",")
    return out.select("doc_id", F.coalesce(F.size("_dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
                      F.coalesce(dropped, F.lit("")).alias("dropped"), "text")


def query_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query with one edit for every ``WORDS_PER_EDIT`` words."""
    return query(spark, sf_dir, WORDS_PER_EDIT)


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
occ AS (
  SELECT doc_id, pos - 1 AS pos, list_filter(string_split_regex(l[pos], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM d)),
line AS (SELECT w, min((doc_id, pos)) AS o, row_number() OVER () AS k FROM occ WHERE len(w) > 0 GROUP BY w),
cut AS (
  SELECT k, o, i, list_concat(w[1:i - 1], w[i + 1:]) AS v
  FROM (SELECT k, o, w, unnest(range(1, len(w) + 1)) AS i FROM line WHERE len(w) >= 5)),
near AS (
  SELECT a.k, b.o FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i WHERE b.o < a.o
  UNION ALL SELECT a.k, b.o FROM line a JOIN cut b ON a.w = b.v WHERE len(a.w) >= 5 AND b.o < a.o
  UNION ALL SELECT a.k, b.o FROM cut a JOIN line b ON a.v = b.w WHERE len(b.w) >= 5 AND b.o < a.o),
kept AS (SELECT line.w, least(line.o, coalesce(min(near.o), line.o)) AS o FROM line LEFT JOIN near USING (k) GROUP BY line.w, line.o),
gone AS (SELECT doc_id, pos, o FROM occ JOIN kept USING (w) WHERE (doc_id, pos) <> o),
per AS (
  SELECT doc_id, count(*) AS n, list(pos) AS ps,
         string_agg(pos || ':' || o[1] || ':' || o[2], ',' ORDER BY pos) AS s
  FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_dropped, coalesce(s, '') AS dropped,
       CASE WHEN n IS NULL THEN text ELSE array_to_string(
         list_transform(list_filter(range(1, len(l) + 1), lambda p: NOT list_contains(ps, p - 1)), lambda p: l[p]), chr(10)) END AS text
FROM d LEFT JOIN per USING (doc_id)
"""
