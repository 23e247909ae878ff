import pandas as pd
from pyspark.sql import functions as F

from optika.functions import text as T
from optika.plans import catalog


def test_upper_case_of_single_characters(spark, tmp_path, same_rows):
    """As DuckDB has it: a sharp s stays one character, a ligature as it is."""
    import duckdb

    con = duckdb.connect()
    upper = lambda t: con.execute("SELECT upper(?)", [t]).fetchone()[0]
    chars = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    several = "".join(c for c in chars if len(c.upper()) > 1)
    texts = ["Straße", "ß", "ßßaß", several, "plain", "", None, "é ŉ\nﬁ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.u for r in df.orderBy("i").select(T.upper_each(F.col("t")).alias("u")).collect()]
    assert got == [upper(t) for t in texts] and len(got[3]) == len(several)
    letters = pd.DataFrame({"t": [c for c in chars if c.upper() != c]})
    got = spark.createDataFrame(letters).select("t", T.upper_each(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == {c: upper(c) for c in letters["t"]}
    spark.createDataFrame([(i, t) for i, t in enumerate(["Die Straße", "groß", "ﬁn", "plain"])], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    same_rows(catalog.QUERIES["content_hash_recovery"](spark, str(tmp_path)), catalog.ORACLES["content_hash_recovery"].replace("FROM benchmark", f"FROM '{tmp_path}/benchmark.parquet/*.parquet'"))


PAGES = ["<p>a &amp b</p>", "<p>end of&&&amp</p>", "<b>x&am &a &quo;</b> &quot;y&quot;", None, "<p>a &amp;lt; &amp;amp; &lt;</p>", "<i>&copy; &copy &middot;&nbsp;z</i>", "<title>t &amp u</title><p>a<br>b</p>", "plain & plain"]


def test_open_references_stay_in_clean_pages(spark, tmp_path, same_rows):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id int, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_rows(catalog.QUERIES["html_clean"](spark, str(tmp_path)), catalog.ORACLES["html_clean"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'"))
    odd = spark.createDataFrame([("&eacute; &eacute &#233; &#xE9 &amp;eacute; &notit; &#65;&",)], "t string")
    assert odd.select(T.clean_html(F.col("t"), closed=True)).first()[0] == "é &eacute é &#xE9 &eacute; &notit; A&"


def test_open_references_stay_in_page_texts(spark, tmp_path, same_rows):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id int, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_rows(catalog.QUERIES["page_text"](spark, str(tmp_path)), catalog.ORACLES["page_text"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'"))
