import pytest
from pyspark.sql import functions as F

from optika.functions import text as T
from optika.plans import adapters_catalog
from optika.sources import adapters


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", [*adapters_catalog.CONTEXTS, *adapters_catalog.ITEMS, *adapters_catalog.TRAINING])
def test_a_context_is_computed_once(spark, sf_dir, name):
    """No filter holds a second copy of what makes the text, and no pattern looks for blanks at its ends."""
    a = adapters.ADAPTERS[name]
    rows = adapters_catalog.raw_rows(spark, sf_dir, name)
    got = plan((adapters.items if a.gold else adapters.contexts)(rows, name).select(T.sha(F.col("context"))))
    assert got.count("　") == 1 + a.clean + (name == "dbpedia14") and r"\x1c" not in got


def test_blanks_at_the_ends_of_texts(spark):
    texts = [chr(i) + "x" + chr(i) + "y" + 2 * chr(i) for i in range(0x3100)] + ["", " \n", "a\r\n", "﻿b ", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.trim_blanks(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [t and t.strip() for t in texts]


def test_templates_without_a_format(spark):
    df = spark.createDataFrame([("50%", 1, None)], "a string, b int, c string")
    assert df.select(T.template("%s: %s|%s", F.col("a"), F.col("b"), F.col("c"))).first()[0] == "50%: 1|"
    with pytest.raises(ValueError, match="columns"):
        T.template("%s %d", F.col("a"))


def test_cleaning_computes_a_text_once(spark):
    df = spark.createDataFrame([("a <BR/>b<br >c  d\t<i>e</i> &amp; &eacute;", 1)], "t string, n int")
    got = df.select(T.clean_html(F.concat("t", F.lit("!"))).alias("c"))
    assert got.first().c == "a \nb\nc d e & é!"
    assert plan(got).count("<[^>]+>") == 1


def test_rows_without_a_label_are_not_cleaned(spark, sf_dir):
    rows = adapters_catalog.raw_rows(spark, sf_dir, "imdb_ratings")
    got = plan(adapters.items(rows, "imdb_ratings"))
    assert "array_position" in got.rsplit("Generate", 1)[1]  # the label's filter lies below the first generator
