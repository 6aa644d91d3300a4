import pytest

ODD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (3, "plain words of a text that goes on and on", "en", "a", 5), (3, "plain words of a text that goes on and on", "en", "a", 5),
    (4, "12 34 !!", "fr", None, 1), (5, "é" * 30000 + " token = abcdefgh " + "x y " * 30000, "fr", "b", 9), (6, "  \n\t ", "de", "", 3), (-7, "日本 語 mail a.b@c.de twice a.b@c.de +49 170 1234567", "de", "b", 2),
    (None, "a null id keeps its row", "en", "a", 0), (8, "x​y \U0001f600 " * 50, "en", "c", 1),
]
EXTRA = "size long, length long, start long, key string, rank int, score double, bucket int, vec_id long, n long, spans string"


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, 1, 2, 3, "k", 4, 0.5, 6, 7, 8, "s") for r in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
