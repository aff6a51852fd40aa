from pyspark.sql import functions as F

from foliospark.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_compact_cuts_before_the_last_word(spark):
    assert value(spark, T.compact(F.lit("a  b\n c"), 10)) == "a b c"
    assert value(spark, T.compact(F.lit("alpha beta, gamma"), 13)) == "alpha beta…"
    assert value(spark, T.compact(F.lit(None).cast("string"), 13)) is None
    assert value(spark, T.compact(F.lit(""), 13)) == ""


def test_sentences_keep_numbers_and_abbreviations(spark):
    found = value(spark, T.sentences(F.lit("It rose 0.53 percent. Then it fell! (Why?) 0.5 more. e.g. this")))
    assert found == ["It rose 0.53 percent.", "Then it fell!", "(Why?) 0.5 more. e.g. this"]


def test_title_and_year(spark):
    assert value(spark, T.title(F.lit("##\n# On rain #\nx"))) == "On rain"
    assert value(spark, T.title(F.lit(""))) == "Imported research paper"
    assert value(spark, T.year(F.lit("In 1799, 1999 and 2004"))) == 1999
    assert value(spark, T.year(F.lit("no year 18990"))) is None


def test_labels(spark):
    s = F.lit("We propose an attention mechanism for long texts.")
    assert value(spark, T.phrase_after(s, ("propose",))) == "attention mechanism"
    assert value(spark, T.label(s, ("propose",), "x")) == "Attention mechanism"
    assert value(spark, T.label(F.lit("One two three four five six seven eight nine."), ("zz",), "x")) == "One two three four five six seven eight…"
    assert value(spark, T.metric_label(F.lit("Accuracy rose by 4.5 percent."))) == "Accuracy (4.5 percent)"
    assert value(spark, T.metric_label(F.lit("Nothing here."))) is None
    assert value(spark, T.experiment_label(F.lit("It was tested on the river corpus, twice."))) == "River corpus"


def test_search(spark):
    text = F.lit("Rain fell. " * 30 + "The larval survival improved.")
    assert len(value(spark, T.search(text, "larval survival"))) >= 1
    assert value(spark, T.search(text, "  ")) == []
    assert value(spark, T.search(text, "absent")) == []


def test_anchoring(spark):
    assert value(spark, T.is_anchored(F.lit("The  RAIN"), F.lit("and the rain\nfell")))
    assert not value(spark, T.is_anchored(F.lit(""), F.lit("x")))
    assert not value(spark, T.is_anchored(F.lit(None).cast("string"), F.lit("x")))


def test_addresses(spark):
    assert value(spark, T.is_web_address(F.lit("https://a.b/c")))
    assert not value(spark, T.is_web_address(F.lit("not-a-url")))
    assert not value(spark, T.is_web_address(F.lit(None).cast("string")))
    assert value(spark, T.is_authority(F.lit("https://www.nature.com/x")))
    assert not value(spark, T.is_authority(F.lit("https://notnature.com/x")))


def test_location(spark):
    text = F.lit("One\nThe seed bank explains it all today\nThree")
    assert value(spark, T.location(text, F.lit("The seed bank explains it"), F.lit("results"))) == "Results section, line 2"
    assert value(spark, T.location(text, F.lit("absent words stand here now"), F.lit("results"))) == "Results section, filtered paper text"
