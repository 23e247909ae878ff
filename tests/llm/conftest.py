import pytest

#: Columns whose names the operators use inside; none may disturb a result.
CLASH = "id long, key string, hash long, size long, n long, sketch string, kept boolean, component long, bucket string, _k long, taken long, row long, chunk long, lang_pred string, position double, n_words long, `_key` long, _id long"


@pytest.fixture(scope="session")
def hard_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    base = " ".join(f"alpha{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (3, base.replace("alpha7 ", "beta "), "en", "b", 10), (4, None, "fr", None, None), (5, "", None, "b", 0), (6, " \t\n ", "de", "c", 3),
        (7, long, "en", "a", 1), (7, long, "en", "a", 1), (8, "x", "en", "c", 1), (9, "x", "en", "c", 1), (None, base + " tail of its own", None, None, 5), (10, "12 34 !!", None, "b", 8), (11, "ALPHA0 " + base[7:], "en", "a", 10),
        (12, " ".join(["same"] * 50), "es", "d", 1), (13, base[: len(base) // 2] + " " + " ".join(f"gamma{i}" for i in range(30)), "en", "a", 1),
    ]
    extra = (99, "k", 1, 2, 3, "s", False, 5, "b", 1, 7, 8, 9, "zz", 0.5, 4, 3, 2)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="session")
def empty_documents(hard_documents):
    return hard_documents.limit(0)
