"""Entity resolution: names to organisations in tiers of exact, close and new.

Candidates for a close match come from two equality joins that lose no pair of similarity 0.9 or more. Either a name's words,
but for two elevenths of its characters, are all the other's: then one of its rarest words (as many as are longer than that
together) is. Or the names differ by at most a tenth of their joint length in characters: then they meet by a pair of their
rarest bigrams and a band of lengths (`_edited`), and numbers whose bits stand for a name's letters and bigrams leave out the pairs
of that join that differ by more. Both are plain joins of numbers by a key, so Spark splits the partition of a frequent key.
Similarity itself is computed on what is left, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept
from .similarity import codes, common_lengths, similarity, words

CLOSE = 0.90


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of bits at a time."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_similarity(a: str, b: str) -> float:
    """1 if one's words are all the other's, else the best ratio among the common words and either name's words after them."""
    x, y = set(a.split()), set(b.split())
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if not x or not y:
        return 0.0
    if common and (not left or not right):
        return 1.0
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    return max([ratio(one, two), *([ratio(common, one), ratio(common, two)] if common else [])])


def bigrams(c: Column) -> Column:
    """Numbered bigrams inside a name's distinct words: the n-th of equal ones has number n."""
    words = F.array_distinct(F.split(c, " "))
    pairs = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, 2))).otherwise(F.array(w))))
    return F.transform(pairs, lambda g, i: F.concat(g, F.lit(":"), F.size(F.filter(F.slice(pairs, 1, i), lambda x: x == g))))


def _rare_first(names: DataFrame, parts: Column) -> DataFrame:
    """id, and its parts from the rarest on. names: id, key."""
    each = names.select("id", F.explode(parts).alias("part"))
    often = each.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return each.join(often, "part").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]).alias("parts"))


#: A name's numbered letters, and its parts, as bits.
LETTERS, BIGRAMS = ["letters_0", "letters_1"], ["bigrams_0", "bigrams_1"]


def numbered_letters(c: Column) -> Column:
    """The letters of a name's distinct words; the n-th of equal ones has number n."""
    letters = F.array_sort(F.filter(F.split(F.array_join(F.array_distinct(F.split(c, " ")), ""), ""), lambda x: x != ""))
    return F.transform(letters, lambda x, i: F.concat(x, F.lit(":"), i - F.array_position(letters, x)))


def signed(grams: DataFrame) -> DataFrame:
    """Adds the bits of a name's letters and parts. What another name lacks shows in bits that are set here alone, if it shows at all."""

    def bits(items: Column, k: int) -> Column:
        places = F.filter(F.transform(items, lambda g: F.pmod(F.xxhash64(g), F.lit(128)).cast("int")), lambda b: F.floor(b / 64) == k)
        return F.aggregate(places, F.lit(0).cast("long"), lambda x, b: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)))

    return grams.withColumns({c: bits(items, k) for names, items in ((LETTERS, numbered_letters(F.col("key"))), (BIGRAMS, F.col("parts"))) for k, c in enumerate(names)})


def _within(every: DataFrame) -> DataFrame:
    """Pairs of ids: the second has all words of the first but for two elevenths of its characters. A plain join by word, which Spark may split."""
    known = every.join(_rare_first(every, words(F.col("key"))), "id")
    before = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda n, w: n + F.length(w) + 1)
    rarest = known.select("id", "size", "sides", "parts", F.explode(F.filter("parts", lambda w, i: 11 * before(i) <= 2 * F.col("size"))).alias("part"))
    theirs = known.select(F.col("id").alias("other"), F.col("sides").alias("their_sides"), F.col("parts").alias("their_parts"), F.explode("parts").alias("part"))
    left = F.aggregate(F.array_except("parts", "their_parts"), F.lit(0), lambda n, w: n + F.length(w) + 1)
    return rarest.join(theirs, "part").where((F.col("id") != F.col("other")) & _wanted() & (11 * left <= 2 * F.col("size"))).select("id", "other").distinct()


def _wanted() -> Column:
    """One is of the names, the other of those that they are held against (bits 1 and 2 of sides)."""
    a, b = F.col("sides"), F.col("their_sides")
    return (a.bitwiseAND(1) + b.bitwiseAND(2) == 3) | (b.bitwiseAND(1) + a.bitwiseAND(2) == 3)


def _pairs_of(parts: Column, n: Column) -> Column:
    """Hashes of the pairs among the first n parts."""
    return F.flatten(F.transform(F.slice(parts, 1, n), lambda x, i: F.transform(F.slice(parts, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y))))


def _edited(every: DataFrame) -> DataFrame:
    """Pairs of ids that may differ by at most a tenth of their joint length.

    Of such a pair the shorter name lacks at most three tenths, and the longer four elevenths, as many of its bigrams in the other as it has characters. If two
    bigrams are common, then the two rarest of them are among the so many and two rarest of either, so names meet by hashes of pairs of these; a name of so few
    bigrams that only one may be common gives single ones too. Lengths differ by two elevenths at most: keys carry a band of lengths, and a
    shorter name looks into its own and the next.
    """
    grams = kept(signed(every.join(_rare_first(every, bigrams(F.col("key"))), "id")), "bigrams")
    band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.log(F.lit(11 / 9)))

    def keyed(lacking: Column, bands: list[Column]) -> DataFrame:
        few = F.size("parts") - lacking < 2
        keys = F.concat(_pairs_of(F.col("parts"), lacking + 2), F.when(few, F.transform(F.slice("parts", 1, lacking + 1), lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")))
        each = grams.select("id", "size", "sides", *LETTERS, *BIGRAMS, F.explode(keys).alias("part"), F.array(*bands).alias("bands"))
        return each.select("*", F.explode("bands").alias("band")).drop("bands")

    short = keyed(F.floor(3 * F.col("size") / 10).cast("int"), [band, band + 1])
    long = keyed(F.floor(4 * F.col("size") / 11).cast("int"), [band])
    long = long.select(F.col("id").alias("other"), *(F.col(c).alias(f"their_{c}") for c in ("size", "sides", *LETTERS, *BIGRAMS)), "part", "band")
    lacks = lambda bits, a, b: sum((F.bit_count(F.col(f"{a}{c}").bitwiseAND(F.bitwise_not(F.col(f"{b}{c}")))) for c in bits), F.lit(0))
    in_all = F.floor((F.col("size") + F.col("their_size")) / 10)
    here, there = F.floor((in_all + F.col("size") - F.col("their_size")) / 2), F.floor((in_all + F.col("their_size") - F.col("size")) / 2)  # characters of either that have no match
    near = (F.col("size") <= F.col("their_size")) & (F.col("their_size") - F.col("size") <= in_all)
    near &= (lacks(LETTERS, "", "their_") <= here) & (lacks(LETTERS, "their_", "") <= there)
    near &= (lacks(BIGRAMS, "", "their_") <= 2 * here + there) & (lacks(BIGRAMS, "their_", "") <= 2 * there + here)
    return short.join(long, ["part", "band"]).where((F.col("id") != F.col("other")) & _wanted() & near).select("id", "other").distinct()


def candidates(names: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs key, other of distinct normal names that may be 0.9 alike. names, others: key. Pairs are of numbers until they are final."""
    sides = names.select("key", F.lit(1).alias("side")).union(others.select("key", F.lit(2).alias("side"))).groupBy("key").agg(F.bit_or("side").alias("sides"))
    size = F.length(F.array_join(words(F.col("key")), " "))
    every = kept(sides.where("key IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), "key", "sides", size.alias("size")), "names")
    found = _within(every).union(_edited(every))
    pairs = found.union(found.select("other", "id")).distinct()
    left = every.where("sides & 1 = 1").select("id", "key")
    right = every.where("sides & 2 = 2").select(F.col("id").alias("other"), F.col("key").alias("_other"))
    return pairs.join(left, "id").join(right, "other").select("key", F.col("_other").alias("other"))


def resolve(staging: DataFrame, organisations: DataFrame, aliases: DataFrame, distinct_pairs: DataFrame | None = None) -> DataFrame:
    """ER0-ER6, ER8. staging: id, key (normal name). organisations: id, key. aliases: organisation_id, key. distinct_pairs: a, b (normal names of different bodies).

    Returns id, key, tier (1 exact, 3 new but flagged as close, 4 new), match (organisation, for tier 1), close_to and similarity (tier 3).
    Rows that are new and of one name make one organisation, and later names are held against earlier new ones too: exactly what row after row gives.
    """
    staging = kept(staging.select("id", "key"), "staging")
    first = staging.groupBy("key").agg(F.min("id").alias("first"))
    by_name = organisations.groupBy("key").agg(F.max("id").alias("_o"))
    by_alias = aliases.groupBy("key").agg(F.max("organisation_id").alias("_a"))
    exact = kept(first.join(by_name, "key", "left").join(by_alias, "key", "left").select("key", "first", F.coalesce("_o", "_a").alias("match")), "exact")
    new = exact.where("match IS NULL").select("key", "first")
    known = by_name.select(F.col("key").alias("other"), F.lit(-1).cast("long").alias("since"), F.col("_o").alias("other_id"))
    earlier = new.select(F.col("key").alias("other"), F.col("first").alias("since"), F.lit(None).cast("long").alias("other_id"))
    pool = known.unionByName(earlier)
    pairs = candidates(new.select("key"), pool.select(F.col("other").alias("key")).distinct()).repartition(int(staging.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scored = pairs.join(new, "key").join(pool, "other").where("since < first").withColumn("similarity", similarity("key", "other")).where(F.col("similarity") >= CLOSE)
    best = scored.groupBy("key").agg(F.max(F.struct("similarity", (-F.col("since")).alias("_e"), (-F.coalesce("other_id", F.lit(0))).alias("_i"), "other")).alias("_")).select("key", F.col("_.other").alias("close_to"), F.col("_.similarity").alias("similarity"))
    if distinct_pairs is not None:
        both = distinct_pairs.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).distinct()
        best = best.join(both, (F.least("key", "close_to") == F.col("_x")) & (F.greatest("key", "close_to") == F.col("_y")), "left_anti")
    decided = exact.join(best, "key", "left").select("key", "match", F.when(F.col("match").isNotNull(), 1).when(F.col("close_to").isNotNull(), 3).otherwise(4).alias("tier"), "close_to", "similarity")
    return staging.select("id", "key").join(decided, "key").select("id", "key", "tier", "match", "close_to", "similarity")


def is_date(column: str) -> Column:
    """A check of `process`: a text that is a date."""
    return F.col(column).try_cast("date").isNotNull()


def one_of(column: str, values: list[str]) -> Column:
    """A check of `process`: a value of a vocabulary; nothing is one of an empty one."""
    return F.col(column).isin(values) if values else F.lit(False)


def _errors(key: str, checks: dict[str, Column] | None = None) -> Column:
    """What is wrong with a row first: its name, then the first check that doesn't hold (null doesn't)."""
    out = F.when(F.col(key).isNull() | (F.trim(key) == ""), F.lit("no name"))
    for note, holds in (checks or {}).items():
        out = out.when(~F.coalesce(holds, F.lit(False)), F.lit(note))
    return out


def process(staging: DataFrame, organisations: DataFrame, aliases: DataFrame, distinct_pairs: DataFrame | None = None, checks: dict[str, Column] | None = None) -> DataFrame:
    """ER0, ER9, T06, M09: staging: id, key, status. Rows that are pending become committed, or errored with a note; a row that fails fails alone, and others keep their status.

    A row fails without a name, or where one of `checks` (a note, and what has to hold) doesn't hold. Returns id, status, note, and what `resolve` says of committed rows.
    """
    rows = staging.withColumn("note", F.when(F.col("status") == "pending", _errors("key", checks)))
    decided = resolve(rows.where("status = 'pending' AND note IS NULL").select("id", "key"), organisations, aliases, distinct_pairs)
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("note").isNotNull(), "errored").otherwise("committed")
    return rows.select("id", status.alias("status"), "note").join(decided, "id", "left")


def dry_run(staging: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """The number of pending rows that would take each status."""
    return staging.where("status = 'pending'").groupBy(F.when(_errors("key", checks).isNotNull(), "errored").otherwise("committed").alias("status")).agg(F.count(F.lit(1)).alias("n"))


#: Names that are held against all organisations at once, and organisations that a step looks at.
QUERIES, ROWS = 4096, 8192
#: Letters are counted by their code points modulo this.
COUNTED = 64


class _Counts:
    """What bounds the similarity of names from above: letters and words."""

    def __init__(self, names: list[str]) -> None:
        own = [sorted(set(n.split())) for n in names]
        self.texts = [" ".join(w) for w in own]
        flat, self.sizes = codes(self.texts, 0)
        here = np.arange(flat.shape[1])[None, :] < self.sizes[:, None]
        rows = np.broadcast_to(np.arange(len(names))[:, None], flat.shape)[here]
        self.letters = np.bincount(rows * COUNTED + flat[here] % COUNTED, minlength=len(names) * COUNTED).reshape(-1, COUNTED).astype(np.int16)
        self.by_word: dict[str, list[int]] = {}
        self.words = own
        for i, ws in enumerate(own):
            for w in ws:
                self.by_word.setdefault(w, []).append(i)

    def bounds(self, words: list[str], size: int, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a name, given by its distinct words, and each of these: a similarity they have at least, and at most."""
        common = np.full(len(self.sizes), -1, np.int64)
        for w in words:
            common[self.by_word.get(w, [])] += len(w) + 1
        shared = common >= 0
        c = np.maximum(common, 0)
        least = np.where(shared, 2 * np.maximum.reduce([c / np.maximum(c + size, 1), c / np.maximum(c + self.sizes, 1), c / np.maximum(size + self.sizes, 1)]), 0.0)
        letters_in_common = np.minimum(self.letters, letters).sum(axis=1, dtype=np.int64)
        most = np.maximum(least, 2 * letters_in_common / np.maximum(size + self.sizes, 1))
        return least, np.where(self.sizes > 0, most, 0.0)


def closest(wanted: DataFrame, organisations: DataFrame, limit: int = 3, cutoff: float = 45.0) -> DataFrame:
    """Wanted: name: a stated set of names, in blocks of at most QUERIES, against all organisations (id, name). Returns name, rank, id, other, score (0 to 100).

    A task gives each name those of its organisations that can be among the best by their letters and words: an organisation is left out if `limit` others of the
    task are surely more alike. Similarity itself is computed on what is left. Equal scores go by name and id.
    """
    names = sorted({r["name"] for r in wanted.select("name").where("name IS NOT NULL").distinct().toLocalIterator()})
    spark, out = organisations.sparkSession, None
    # Dealt out by number: a name is much work for its few bytes, and a file of many names is one task otherwise.
    dealt = organisations.where("name IS NOT NULL").select("id", F.col("name").alias("other")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    for at in range(0, len(names), QUERIES):
        shared = spark.sparkContext.broadcast(names[at : at + QUERIES])

        def possible(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block = _Counts(shared.value)
            floor = np.full((len(shared.value), limit), cutoff / 100 - 1e-9)  # the best sure similarities so far, ascending
            for whole in frames:
                for begin in range(0, len(whole), ROWS):
                    frame = whole.iloc[begin : begin + ROWS]
                    theirs, found = _Counts(frame["other"].tolist()), []
                    for i, name in enumerate(shared.value):
                        least, most = theirs.bounds(block.words[i], int(block.sizes[i]), block.letters[i])
                        # Those that promise most are looked at, so that the others have something to reach.
                        top = np.argsort(-most, kind="stable")[: 4 * limit]
                        alone, sure = top[least[top] == 0], least.copy()
                        sure[alone] = 2 * common_lengths([block.texts[i]] * len(alone), [theirs.texts[k] for k in alone]) / np.maximum(block.sizes[i] + theirs.sizes[alone], 1)
                        floor[i] = np.sort(np.concatenate([floor[i], sure[top], np.sort(np.delete(sure, top))[-limit:]]))[-limit:]
                        first = np.flatnonzero(most >= floor[i, 0] - 1e-9)
                        if len(first):
                            found.append(frame.iloc[first].assign(name=name))
                    if found:
                        yield pd.concat(found)[["name", "id", "other"]]

        found = dealt.mapInPandas(possible, "name string, id long, other string")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "name string, rank int, id long, other string, score double")
    scored = out.withColumn("score", 100 * similarity("name", "other")).where(F.col("score") >= cutoff)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "other", "id")))  # few rows per name and task
    return ranked.where(F.col("rank") <= limit).select("name", "rank", "id", "other", "score")


def corroborated(organisations: DataFrame) -> DataFrame:
    """ER4 between organisations: pairs a < b of one host or one registration number."""
    def pairs(column: str) -> DataFrame:
        own = organisations.where(F.col(column).isNotNull()).select(F.col("id"), F.col(column).alias("_c"))
        first = own.groupBy("_c").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")  # a star per value: no pairs of a hot one
        return own.join(first, "_c").where("id <> a").select("a", F.col("id").alias("b"))

    return pairs("host").union(pairs("registration_number")).distinct()


def new_ids(names: DataFrame, order: str, start: int) -> DataFrame:
    """H2: ids after `start` in a stable order: ranks within ranges of the order, after the sums of the ranges before."""
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = names.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id())
    ranged = kept(ranged, "ranged")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row per partition
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return ranged.withColumn("_r", within).join(before, "_p").select(*names.columns, (F.lit(start) + F.col("_b") + F.col("_r")).cast("long").alias("new_id"))
