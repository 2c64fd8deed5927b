import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinsieve.functions import strings as S
from kinsieve.functions import vectors as V
from kinsieve.functions.text import person_text, record_text

JW = [
    ("MARTHA", "MARHTA", 0.96111), ("DIXON", "DICKSONX", 0.81333), ("JAMES", "JAMEx", 0.92), ("ab", "ax", 0.66667), ("abcde", "abxyz", 0.6), ("abcdef", "abcdxyzw", 0.83333),
    ("abcdefgh", "abcdefxy", 0.9), ("", "", 0.0), ("a", "", 0.0), ("ABC", "abc", 0.0), ("same", "same", 1.0),
]


@pytest.mark.parametrize(("a", "b", "want"), JW)
def test_jaro_winkler_vectors(a, b, want):
    got = S.jaro_winkler_values(pd.Series([a, b, None]), pd.Series([b, a, "x"]))
    assert got[0] == pytest.approx(want, abs=1e-5) and got[1] == pytest.approx(want, abs=1e-5) and got[2] is None


def test_jaro_winkler_equals_the_sql_engines(spark):
    import duckdb

    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcd "), rng.integers(0, 14))) for _ in range(400)]
    left, right = words[:200], words[200:]
    got = S.jaro_winkler_values(pd.Series(left), pd.Series(right)).astype(float)
    want = duckdb.execute("select jaro_winkler_similarity(unnest($1::varchar[]), unnest($2::varchar[]))", [left, right]).fetchall()
    assert np.allclose(got, [w[0] for w in want], atol=1e-12)
    S.register(spark)
    assert spark.sql("select jaro_winkler('MARTHA', 'MARHTA') x").first().x == pytest.approx(0.96111, abs=1e-5)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_winkler_is_symmetric_and_bounded(a, b):
    x, y = S.jaro_winkler_values(pd.Series([a, b]), pd.Series([b, a]))
    assert 0 <= x <= 1 and x == pytest.approx(y)


def test_one_edit(spark):
    rows = [("abc", "abc", True), ("abc", "acb", True), ("abc", "ab", True), ("abc", "abcd", True), ("abc", "axc", True), ("abc", "cab", False), ("abcd", "badc", False), ("", "a", True), ("", "", True), ("a", "ab", True), (None, "a", None)]
    got = spark.createDataFrame(rows, "l string, r string, want boolean").select("want", S.damerau_within_one(F.col("l"), F.col("r")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(V.norm(F.col("a")), V.normalize(F.col("a")), V.cosine(F.col("a"), F.col("b")), V.dot(F.col("a"), F.col("b"))).collect()
    assert tuple(got[0]) == (5.0, [0.6, 0.8], 0.96, 24.0) and tuple(got[1]) == (0.0, [0.0, 0.0], 0.0, 0.0)


def test_texts(spark):
    df = spark.createDataFrame([("A", "B", "1990-01-02", None, "a@b.c"), ("C", "D", "1990-01-02", "1 Elm", "")], "first_name string, last_name string, date_of_birth string, address string, email string")
    head = "First Name: {}\nLast Name: {}\nDate of Birth: 1990-01-02"
    text = lambda s: [r[0] for r in df.select(person_text(s)).collect()]
    assert text("default") == [head.format("A", "B") + "\nEmail: a@b.c", head.format("C", "D") + "\nAddress: 1 Elm"]
    assert text("compact") == ["A|B|1990-01-02||a@b.c", "C|D|1990-01-02|1 Elm|"]
    with pytest.raises(ValueError):
        person_text("other")
    assert df.select(record_text(["first_name", "address"])).first()[0] == "first_name: A"
