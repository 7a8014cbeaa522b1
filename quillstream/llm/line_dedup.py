"""Line dedup: a line that another document has already keeps its place in the first document alone. DataFrame functions alone.

1. Each line's key (stripped, A-Z lower-cased) becomes 128 bits of hash beside its document and position, staged in the shared folder.
2. Keys with over a thousandth of all lines (at most a thousand of them, found by a sketch whose errors only change who does the
   work) have their first document by min(), which combines before its shuffle, and meet their lines by a join whose small side has a
   row for each of them.
3. All other hashes are range-partitioned and sorted by document and position; a window streams over each hash from its first
   occurrence on and marks the lines of later documents.
4. The marks, not the lines, are gathered per document into a keep bitmap in runs: lines kept, dropped, kept ... in turn, and lines after the
   last run are kept. `keep_bitmaps` returns these, and `deduplicated` joins them to the texts.

Defined cases: null text counts as empty, which is one empty line; null ids count as one document, which comes after all others; rows
that repeat an id are one document, so no line is dropped for being in both, and each has its own bitmap; keys of under MIN_LENGTH
code points stay; other columns are ignored by `keep_bitmaps` and kept by `deduplicated`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, staged, table, unused

#: The six white spaces that a key loses at both ends.
SPACE = " \t\n\x0b\x0c\r"
MIN_LENGTH = 10
#: Keys with over a 1/HOT of all lines are handled apart.
HOT = 1000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def row_of(text: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashes(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, row, pos, and two hashes (h1, h2) of the key of each line whose key has at least min_length code points."""
    lines = docs.select("doc_id", row_of(F.col("text")).alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    return keys.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def frequent(lines: DataFrame, share: int) -> list[int]:
    """Values of h1 with about 1/share of all lines or more: less than 2 * share numbers. A sketch finds them; none is missed by more than its error, and nothing depends on which they are but the balance of tasks."""
    found = lines.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h1, {2 * share - 1}, {16 * share})").alias("top")).first()
    return [r["item"] for r in found["top"] or [] if r["count"] * share >= found["n"]]


def repeats(lines: DataFrame, share: int = HOT) -> DataFrame:
    """Of the rows of `hashes`, those whose key a document with a smaller id has: doc_id, row, pos."""
    top = frequent(lines, share)
    hot = lines.where(F.col("h1").isin(top))
    # A row for each of at most 2 * share hashes: a proven bound for the broadcast. min() leaves null ids, which come last, for the end.
    firsts = hot.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    late = hot.join(F.broadcast(firsts), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    by_hash = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "pos", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = lines.where(~F.col("h1").isin(top)).repartitionByRange("h1", "h2")
    streamed = ranged.withColumn("first", F.first("doc_id").over(by_hash)).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    columns = ["doc_id", "row", "pos"]
    return streamed.select(columns).unionByName(late.select(columns))


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, share: int = HOT) -> DataFrame:
    """doc_id, row (a hash of the text, which tells rows of one id apart), n_dropped and keep, the bitmap in runs, of each document that loses lines."""
    marks = repeats(staged(hashes(docs, min_length), "line-hashes"), share)
    dropped = marks.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    return dropped.select("doc_id", "row", F.size("at").cast("long").alias("n_dropped"), _runs(F.col("at")).alias("keep"))


def _runs(at: Column) -> Column:
    """Lengths of runs kept and dropped in turn, of an ascending array of dropped positions."""
    starts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) < x - 1))
    ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + 1))
    before = F.concat(F.array(F.lit(-1)), ends)
    each = F.arrays_zip(starts.alias("a"), ends.alias("b"), before.alias("p"))
    return F.flatten(F.transform(F.filter(each, lambda r: r["a"].isNotNull()), lambda r: F.array(r["a"] - r["p"] - 1, r["b"] - r["a"] + 1)))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that a bitmap in runs keeps; a null bitmap keeps all."""
    mask = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return F.when(keep.isNull(), lines).otherwise(F.filter(lines, lambda _, i: F.coalesce(F.get(mask, i), F.lit(True))))


def deduplicated(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with only the lines that their bitmaps keep, and n_lines (before), n_dropped beside them (renamed where docs has such columns)."""
    n, d, own, row, id_, keep = (unused(docs, x) for x in ("n_lines", "n_dropped", "own_row", "row", "row_id", "keep"))
    marks = bitmaps.select(F.col("doc_id").alias(id_), F.col("row").alias(row), F.col("n_dropped").alias(d), F.col("keep").alias(keep))
    joined = docs.withColumn(own, row_of(F.col("text"))).join(marks, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(row)), "left")
    text = F.array_join(kept_lines(lines_of(F.col("text")), F.col(keep)), "\n")
    return joined.select(*(text.alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns), F.size(lines_of(F.col("text"))).cast("long").alias(n), F.coalesce(d, F.lit(0)).cast("long").alias(d))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = deduplicated(docs, keep_bitmaps(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
marked AS (SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
