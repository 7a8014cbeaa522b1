"""Full-text search by a stored index: English stems, all-terms and phrase matches, ranks, the top k, headlines.

An index is a folder of posting lists, partitioned by a hash of the stem and sorted by stem, so a query reads its stems' buckets, and of them
the row groups that hold its stems. A row is a word of a stem in one block of texts: the texts that have it, with their owner,
occurrences, places and length, and `best`, the largest rank that the word alone gives any of them. Blocks are hashes of the texts' keys, the same for
all words, so a text's rows meet by their block and a frequent word is many rows. Stems are made once for each word of a block.

The top k reads bounds first (all columns but the texts): the sum of `best` over a query's rows of a block bounds the rank of its
texts. The blocks of the highest bounds give a threshold, and then only those are read whose bound can reach it.

Defined cases: null text counts as empty; stop words are no part of a text or query, and a query of them alone matches nothing; keys are distinct.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stemmed
from ..storage import root, version

# The stop words of the "english" text search configuration.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
WORD_BREAK = r"[^\p{L}\p{N}]+"
TITLE_WEIGHT = 3.0
#: Texts of a block, about, and the blocks that are read for the threshold of a top k.
BLOCK, FIRST_BLOCKS = 1024, 32
#: Bytes of texts that a task makes lists of, and what a text counts for beside its own.
PART_BYTES, TEXT_BYTES = 4_000_000, 64
#: Ranks are rounded to so many digits, and equal ones go by id.
DIGITS = 6
POSTING = "array<struct<owner: bigint, key: bigint, n: int, words: int, at: array<int>>>"


def words_of(text: Column) -> Column:
    """A text's words in lower case and in order, without stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def query_mode(query: str) -> tuple[bool, str]:
    """FT1: whether it is a phrase (in double quotes, longer than two), and its text."""
    phrase = len(query) > 2 and query.startswith('"') and query.endswith('"')
    return phrase, query[1:-1] if phrase else query


def query_words(query: str) -> list[str]:
    words = "".join(ch if ch.isalnum() else " " for ch in query_mode(query)[1].lower()).split()
    return [w for w in words if w not in STOP_WORDS]


def query_stems(spark: SparkSession, query: str) -> list[str]:
    """The stems of a query's words, in order: the same expressions as for texts, which the optimizer evaluates."""
    words = query_words(query)
    if not words:
        return []
    values = spark.sql("VALUES " + ", ".join(f"('{w}')" for w in sorted(set(words)))).toDF("word")
    found = {r["word"]: r["stem"] for r in stemmed(values, "word", "stem").collect()}
    return [found[w] for w in words]


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    buckets: int

    def rows(self, stems: list[str]) -> DataFrame:
        """The stems' posting rows, from their buckets alone."""
        lists = self.spark.read.schema(f"stem string, word string, block long, best double, docs {POSTING}, bucket int").parquet(f"{self.path}/postings")
        own = F.lit(False)
        for s in sorted(set(stems)):
            own = own | (F.col("bucket") == _bucket(F.lit(s), self.buckets)) & (F.col("stem") == s)
        return lists.where(own)


def _bucket(stem: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, buckets: int | None = None, block: int = BLOCK) -> Index:
    """docs: key (distinct), owner, text. Writes the folder. Texts are dealt out by block once; their words, posting lists and stems are made where they are, so
    what is shuffled is the texts and the lists, each once, and no cell holds more than a block's texts."""
    spark = docs.sparkSession
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks, buckets = max(1, -(-size["n"] // block)), buckets or min(4096, max(16, size["n"] // 65_536))
    parts = max(-(-(size["bytes"] + TEXT_BYTES * size["n"]) // PART_BYTES), min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = docs.select("key", "owner", "text", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).repartition(parts, "block")
    texts = dealt.select("key", "owner", "block", words_of(F.col("text")).alias("ws"))
    tokens = texts.select("key", "owner", "block", F.size("ws").alias("words"), F.posexplode("ws").alias("at", "word"))
    # Both groups have the block among their keys, by which rows lie together already.
    each = tokens.groupBy("block", "word", "key", "owner", "words").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sort_array(F.collect_list("at")).alias("at"))
    lists = each.groupBy("block", "word").agg(F.max(_rank(F.col("n"), F.col("words"))).alias("best"), F.collect_list(F.struct("owner", "key", "n", "words", "at")).alias("docs"))
    listed = stemmed(lists, "word", "stem").select("stem", "word", "block", "best", "docs", _bucket(F.col("stem"), buckets).alias("bucket"))
    spread = F.pmod(F.xxhash64("block"), F.lit(-(-parts // buckets)))
    listed.repartition(parts, "bucket", spread).sortWithinPartitions("bucket", "stem", "block", "word").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return Index(spark, path, buckets)


def opened(spark: SparkSession, path: str) -> Index:
    return Index(spark, path, spark.read.parquet(f"{path}/meta").first()["buckets"])


def stored(docs: DataFrame, name: str) -> Index:
    """The index of docs in the shared folder, built where none is there for these files as they are now (names, sizes, times)."""
    spark = docs.sparkSession
    path = f"{root(spark)}/search-{name}-{version(docs)}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        new = f"{root(spark)}/search-{name}-{re.sub('[^0-9a-z]', '', str(id(docs)))}-{version(docs)}.new"
        build(docs, new)
        if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(new), folder):  # another session was first
            return opened(spark, new)
    return opened(spark, path)


def _rank(n: Column, words: Column) -> Column:
    """Occurrences of the query's words, damped by length."""
    return n / (F.lit(1.0) + F.log1p(words.cast("double")))


def _place(stems: list[str]) -> Column:
    """A bit for each of the distinct stems."""
    out = F.lit(0).cast("long")
    for i, s in enumerate(stems):
        out = F.when(F.col("stem") == s, F.lit(1 << i).cast("long")).otherwise(out)
    return out


def _starts(stem: str, i: int) -> Column:
    """Where a phrase would begin whose i-th stem this is."""
    own = F.filter("places", lambda p: p["stem"] == stem)
    return F.transform(F.flatten(F.transform(own, lambda p: p["at"])), lambda x: x - i)


def hits(rows: DataFrame, stems: list[str], phrase: bool) -> DataFrame:
    """Of posting rows, the texts that have all stems (in phrase mode, one after the other): owner, key, rank."""
    distinct = sorted(set(stems))
    each = rows.select(_place(distinct).alias("bit"), "stem", F.explode("docs").alias("d"))
    found = each.groupBy("d.owner", "d.key").agg(
        F.bit_or("bit").alias("bits"), F.sum("d.n").alias("n"), F.max("d.words").alias("words"), *([F.collect_list(F.struct("stem", "d.at")).alias("places")] if phrase else [])
    ).where(F.col("bits") == (1 << len(distinct)) - 1)
    if phrase:
        starts = _starts(stems[0], 0)
        for i, s in enumerate(stems[1:], 1):
            starts = F.array_intersect(starts, _starts(s, i))
        found = found.where(F.size(starts) > 0)
    return found.select("owner", "key", _rank(F.col("n"), F.col("words")).alias("rank"))


def bounds(rows: DataFrame, stems: list[str]) -> DataFrame:
    """block and bound: no text of the block has a higher rank. Blocks without one of the stems are left out."""
    distinct = sorted(set(stems))
    found = rows.groupBy("block").agg(F.sum("best").alias("bound"), F.bit_or(_place(distinct)).alias("bits"))
    return found.where(F.col("bits") == (1 << len(distinct)) - 1).select("block", "bound")


def _together(titled: DataFrame | None, spoken: DataFrame | None) -> DataFrame:
    """id, rank and the best speech: three times the title's rank and that of the best speech of each."""
    parts = []
    if titled is not None:
        parts.append(titled.select(F.col("owner").alias("id"), (TITLE_WEIGHT * F.col("rank")).alias("t"), F.lit(None).cast("struct<rank: double, key: bigint>").alias("b")))
    if spoken is not None:
        best = spoken.groupBy("owner").agg(F.max(F.struct("rank", "key")).alias("b"))
        parts.append(best.select(F.col("owner").alias("id"), F.lit(0.0).alias("t"), "b"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    one = both.groupBy("id").agg(F.sum("t").alias("t"), F.max("b").alias("b"))
    return one.select("id", F.round(F.col("t") + F.coalesce("b.rank", F.lit(0.0)), DIGITS).alias("rank"), F.col("b.key").alias("speech_id"))


def allowed(sections: DataFrame, house: str | None = None, debate_type: str | None = None, department: str | None = None, since: str | None = None, until: str | None = None, policy: DataFrame | None = None) -> DataFrame:
    """FT4, FT6: the sections that a search may return. Containers never are; the department is a part of the name in any case; dates are inclusive; policy: session_id of the sections of a policy area."""
    for column, wanted in (("house", house), ("debate_type", debate_type)):
        if wanted is not None:
            sections = sections.where(F.col(column) == wanted)
    if department is not None:
        sections = sections.where(F.contains(F.lower("department"), F.lit(department.lower())))
    if since is not None:
        sections = sections.where(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        sections = sections.where(F.col("date") <= F.lit(until).cast("date"))
    if "is_container" in sections.columns:
        sections = sections.where(~F.col("is_container"))
    if policy is not None:
        sections = sections.join(policy.select(F.col("session_id").alias("id")), "id", "left_semi")
    return sections


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, rank double, speech_id long")


def search(query: str, titles: Index, speeches: Index | None, sections: DataFrame | None = None) -> DataFrame:
    """FT3-FT5: id, rank and speech_id of all sections that match, in title or speech (title alone without an index of speeches). sections: id, those that may be returned."""
    stems, phrase = query_stems(titles.spark, query), query_mode(query)[0]
    if not stems:
        return _nothing(titles.spark)
    found = _together(hits(titles.rows(stems), stems, phrase), hits(speeches.rows(stems), stems, phrase) if speeches else None)
    return found if sections is None else found.join(sections.select("id"), "id", "left_semi")


def count(query: str, titles: Index, speeches: Index | None, sections: DataFrame | None = None) -> DataFrame:
    """FT7: the number of distinct sections that match."""
    return search(query, titles, speeches, sections).agg(F.count(F.lit(1)).alias("n"))


def top(query: str, k: int, titles: Index, speeches: Index | None, sections: DataFrame | None = None, first: int = FIRST_BLOCKS) -> DataFrame:
    """The k highest ranks of `search`, ties by id, reading only blocks whose bound can reach them."""
    spark = titles.spark
    stems, phrase = query_stems(spark, query), query_mode(query)[0]
    if not stems or k < 1:
        return _nothing(spark)
    lists = {name: index.rows(stems) for name, index in (("t", titles), ("b", speeches)) if index is not None}
    bound = {name: bounds(rows, stems) for name, rows in lists.items()}

    def of(keep: dict[str, Column]) -> DataFrame:
        chosen = {name: hits(lists[name].join(bound[name].where(c), "block", "left_semi"), stems, phrase) for name, c in keep.items()}
        found = _together(chosen.get("t"), chosen.get("b"))
        return found if sections is None else found.join(sections.select("id"), "id", "left_semi")

    # A few numbers: the highest bounds of either index.
    highest = {name: [r["bound"] for r in rows.orderBy(F.desc("bound")).limit(first).collect()] for name, rows in bound.items()}
    highest = {name: values for name, values in highest.items() if values}
    if not highest:
        return _nothing(spark)
    best = [r["rank"] for r in of({name: F.col("bound") >= values[-1] for name, values in highest.items()}).orderBy(F.desc("rank"), "id").limit(k).collect()]
    least = best[-1] - 10.0**-DIGITS if len(best) == k else 0.0
    most = {"t": TITLE_WEIGHT * highest["t"][0] if "t" in highest else 0.0, "b": highest["b"][0] if "b" in highest else 0.0}
    # What one index adds at most may be missing from what the other has to give; a margin for sums in another order.
    reach = {"t": (least - most["b"]) / TITLE_WEIGHT - 1e-9, "b": least - most["t"] - 1e-9}
    return of({name: F.col("bound") >= reach[name] for name in highest}).orderBy(F.desc("rank"), "id").limit(k)


def inflections(index: Index, query: str) -> list[str]:
    """The words of the indexed texts that have one of the query's stems: a stem has finitely many, by its rules."""
    return sorted(r["word"] for r in index.rows(query_stems(index.spark, query)).select("word").distinct().collect())


def headline(text: Column, words: list[str], most: int = 35, before: int = 10) -> Column:
    """FT8: one fragment of up to so many words that begins shortly before the first hit (one of `words`), hits marked."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    wanted = F.array(*map(F.lit, words)) if words else F.array(F.lit(""))
    is_hit = lambda w: F.arrays_overlap(F.filter(F.split(F.lower(w), WORD_BREAK), lambda x: x != ""), wanted)
    hit = F.array_position(F.transform(parts, is_hit), True)
    piece = F.slice(parts, F.greatest(hit - before, F.lit(1)).cast("int"), most)
    return F.array_join(F.transform(piece, lambda w: F.when(is_hit(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " ")
