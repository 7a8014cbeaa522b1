"""The stemmer against words and stems that its algorithm's authors publish, in Spark and as SQL."""

import duckdb
import pytest

from quillstream.functions.stemming import sql_stemmed, stemmed, stems_of

# The published sample of the English vocabulary, and words that the rules name.
PUBLISHED = """
consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist, consistently consist, consisting consist, consists consist,
consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol, consoles consol, consolidate consolid, consolidated consolid, consolidating consolid, consoling consol, consolingly consol,
consols consol, consonant conson, consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir, conspirators conspir, conspire conspir,
conspired conspir, conspiring conspir, constable constabl, constables constabl, constance constanc, constancy constanc, constant constant,
knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead, knee knee, kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee,
knell knell, knelt knelt, knew knew, knick knick, knif knif, knife knife, knight knight, knightly knight, knights knight, knit knit, knits knit, knitted knit, knitting knit, knives knive, knob knob, knobs knob, knock knock,
knocked knock, knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot
"""
RULES = """
ties tie, cries cri, gas gas, this this, gaps gap, kiwis kiwi, luxuriating luxuri, hopped hop, hoped hope, hoping hope, troubled troubl, sized size, falling fall, bed bed, bead bead, by by, say say, cry cri,
caresses caress, dying die, skies sky, news news, inning inning, innings inning, proceeds proceed, proceeded proceed, generate generat, generic generic, generously generous, communication communic, communism communism, arsenal arsenal, arsenic arsenic,
relational relat, conditional condit, rationalization ration, hopefulness hope, goodness good, electrical electr, triplicate triplic, formative format, adoption adopt, revival reviv, probate probat, rate rate, cease ceas, controll control, roll roll,
analogy analog, geology geolog, easily easili, responsibility respons, youth youth, boyish boyish, yes yes, sayyid sayyid, agreed agre, feed feed, beautiful beauti, question question, questions question, education educ, schools school, repayments repay, reform reform, a a, été été, 日本語 日本語
"""


def pairs(text):
    return [tuple(p.split()) for p in text.replace("\n", " ").split(",") if p.strip()]


@pytest.mark.parametrize("text", [PUBLISHED, RULES])
def test_published_stems(spark, text):
    wanted = pairs(text)
    words = spark.createDataFrame([(w,) for w, _ in wanted], "word string")
    assert {r["word"]: r["stem"] for r in stems_of(words, "word").collect()} == dict(wanted)
    c = duckdb.connect()
    c.execute("CREATE TABLE words (word VARCHAR)")
    c.executemany("INSERT INTO words VALUES (?)", [(w,) for w, _ in wanted])
    assert dict(c.sql(sql_stemmed("words", "word")).fetchall()) == dict(wanted)


def test_other_columns_and_nulls(spark):
    rows = spark.createDataFrame([("Running", "running", 1), ("x", None, 2), ("", "", 3)], "w string, word string, done int")
    found = stemmed(rows, "word", "stem")
    assert found.columns == ["w", "word", "done", "stem"] and [r["stem"] for r in found.orderBy("done").collect()] == ["run", None, ""]


def test_both_engines_on_a_vocabulary(spark, sf_dir):
    import pyspark.sql.functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''").distinct()
    own = {r["word"]: r["stem"] for r in stems_of(words, "word").collect()}
    c = duckdb.connect()
    c.register("words", words.toPandas())
    assert len(own) > 1000 and dict(c.sql(sql_stemmed("words", "word")).fetchall()) == own
