"""Packed fields (problem 3) and heavy keys (problem 5)."""

from __future__ import annotations

import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelindan.operators.packed import explode_packed, split_packed
from kelindan.operators.skew import heavy_keys, key_text, per_key

CASES = [
    (None, None), ("", None), ("  ", None), ("nan", None), (" - ", None), ("[]", None), (";; ,", []),
    ("a;b;c", ["a", "b", "c"]), ("a;a; a", ["a", "a", "a"]), ("#a#b #c", ["a", "b", "c"]), ("@a.b @c_d", ["a.b", "c_d"]), ("@a, ,@b;;@c", ["a", "b", "c"]),
    ('"x; y";z', ["x; y", "z"]), ('"a ""b"" c"', ['a "b" c']), ("'a','b c',d", ["a", "b c", "d"]), ("mama's x;b", ["mama's x", "b"]), ('["p, q", "r"]', ["p, q", "r"]),
    ('["p \\" q"]', ['p " q']), ('"open;b', ['"open', "b"]), ("a\tb\n\"c|d\"\ne", ["a", "b", "c|d", "e"]), ("a、b，c；d", ["a", "b", "c", "d"]), ('"#tag"; # x', ["tag", "x"]), ("[[a]; [b]]", ["a", "b"]),
    # depth: lists at any depth, groups inside a value, brackets without a partner
    ("a, [b, c], d", ["a", "b", "c", "d"]), ('["x, y", ["z", ["#w"]]]', ["x, y", "z", "w"]), ("x (a, b); y", ["x (a, b)", "y"]), ("x [a, (b; c)] z; y", ["x [a, (b; c)] z", "y"]),
    ("{k: (1, 2)}; z", ["{k: (1, 2)}", "z"]), ("[a; b", ["[a", "b"]), ("((((;b)", ["((((;b)"]), ("((((;b", ["((((", "b"]), ("a] ; b", ["a]", "b"]), ('x (";)"; y); z', ['x (";)"; y)', "z"]), ("[]; [a]b", ["a", "b"]),
    # escapes, in and outside quotes
    (r"a\,b;c", ["a,b", "c"]), (r"a\\;c", ["a\\", "c"]), (r"a\;c", ["a;c"]), (r'"a\\";b', ["a\\", "b"]), (r'"a\"; b";c', ['a"; b', "c"]), (r"\#a;#b", ["#a", "b"]), (r"c:\new;d", [r"c:\new", "d"]), (r"x \(a; b", ["x (a", "b"]), ("a\\", ["a\\"]), ("'it''s; x';y", ["it's; x", "y"]),
]


@pytest.mark.parametrize(("text", "items"), CASES)
def test_split(spark, text, items):
    df = spark.createDataFrame([(text,)], "v string").select(split_packed(F.col("v")).alias("a"))
    assert df.first().a == items


def test_long_field_does_not_overflow(spark):
    """Fields whose quotes, brackets or blanks could make a naive automaton look ahead again and again."""
    long = '"' + "x;" * 200_000 + '"'
    df = spark.createDataFrame([(long + ";b",), ("y" * 500_000,), ("(" * 300_000,), ("(;" * 100_000,), ("a" + " " * 300_000 + "b",), ('";"x' * 100_000,), ("[(" * 50_000 + ")]" * 50_000,)], "v string").select(F.size(split_packed(F.col("v"))).alias("n"))
    assert [r.n for r in df.collect()] == [2, 1, 1, 100_000, 1, 100_001, 1]


def test_explode_drops_repeats_and_null_keys(spark, rows):
    df = spark.createDataFrame([("k", "a;b", None, 1), ("k", "a;b", None, 2), (None, "z", "z", 3), ("e", "", "nan", 4)], "key string, f string, g string, pos int")
    assert rows(explode_packed(df, {"F": "f", "G": "g"}, "key")) == [("F", "k", 1, "a"), ("F", "k", 2, "b")]
    assert explode_packed(df.limit(0), {"F": "f"}, "key").count() == 0


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet='ab ;"|', min_size=1, max_size=6).map(str.strip).filter(lambda x: x and not x.startswith('"') and x.lower() not in ("-",)), min_size=1, max_size=4), min_size=1, max_size=5))
def test_round_trip_through_quoting(spark, lists):
    packed = []
    for values in lists:
        out = io.StringIO()
        csv.writer(out, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator="").writerow(values)
        packed.append((out.getvalue(),))
    got = [r.a for r in spark.createDataFrame(packed, "v string").select(split_packed(F.col("v")).alias("a")).collect()]
    assert got == lists


def test_heavy_keys_counts_all_rows(spark, rows):
    data = [(" #Fyp ",)] * 4 + [("fyp",)] * 3 + [("b",)] * 2 + [(None,)] * 10 + [("",)] * 81
    df = spark.createDataFrame(data, "hashtag string")
    assert rows(heavy_keys(df, key_text(F.col("hashtag"))), "key_text", "n_rows") == [("fyp", 7)]
    assert heavy_keys(df.limit(0), key_text(F.col("hashtag"))).count() == 0


def test_per_key_latest_ties_and_nulls(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, "2024-01-01", 7, 0), ("A ", None, "2024-01-02", 8, 1), ("#a", 2, "2024-01-02", 9, 2), (None, None, None, 5, 3), ("", 4, None, 6, 4)],
        "k string, s long, at string, id long, n_rows int",
    ).withColumn("at", F.to_timestamp("at"))
    got = per_key(df, key_text(F.col("k")), "key_text", ["s"], "at", F.col("id"), {"id": F.col("id")})
    assert rows(got, "key_text", "n_rows", "sum_s", "latest_id") == [("a", 3, 3, 9), (None, 2, 4, 6)]


def test_per_key_combines_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("s"), F.current_timestamp().alias("at"), "id")
    plan = per_key(df, F.col("k"), "k", ["s"], "at", F.col("id"), {"id": F.col("id")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and "SortAggregate" not in plan
