"""Trees: catalogue, filters, ranges, batches, unions, nesting."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.filters import KeyInTableError, edit_distance, memory_size, name_filter, renamer
from quern.operators.tree import Tree, bounds, group_cases
from quern.plans.language import ExpressionError
from quern.sources import files, session


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("chunks")
    for k, (a, b) in enumerate([(0, 17), (17, 18), (18, 41)]):
        spark.range(a, b).selectExpr("id as x", "hex(id) as word", "if(id % 4 = 0, null, id / 8) as part").coalesce(1).write.parquet(f"{root}/f{k}.parquet")
    (root / "f3.parquet").mkdir()
    spark.range(0).selectExpr("id as x", "hex(id) as word", "id / 8 as part").coalesce(1).write.mode("overwrite").parquet(f"{root}/f3.parquet")
    return root


@pytest.mark.parametrize("a, b", [(None, None), (16, 19), (17, 18), (3, 40), (18, None), (41, 50), (-1, None), (None, -39), (-24, -22), (30, 2), (-77, 88), (22, 22)])
def test_ranges(spark, chunks, a, b):
    whole = list(range(41))
    got = session.concatenate(spark, f"{chunks}/f*.parquet", ["x", "word"], entry_start=a, entry_stop=b, entry=True)
    rows = sorted(got.collect(), key=lambda r: r._entry)
    low, high = bounds(a, b, 41)
    assert [r.x for r in rows] == whole[low:high] == [r._entry for r in rows]


def test_range_reaches_the_scan(spark, chunks):
    plan = Tree.open(spark, f"{chunks}/f0.parquet").arrays(["x"], entry_start=2, entry_stop=5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*row_index", plan) and "word" not in plan.split("ReadSchema")[1]


def test_iterate_equals_concatenate(spark, chunks):
    sizes, seen = [], []
    for out, report in session.iterate(spark, f"{chunks}/f*.parquet", ["x"], "x % 2 == 0", step_size=6, report=True):
        got = sorted(r.x for r in out.collect())
        assert got == [x for x in range(report.global_start, report.global_stop) if x % 2 == 0]
        sizes.append(report.entry_stop - report.entry_start)
        seen += got
    assert sizes == [6, 6, 5, 1, 6, 6, 6, 5] and seen == list(range(0, 41, 2))


def test_sizes(spark, chunks):
    t = Tree.open(spark, f"{chunks}/f0.parquet")
    per = t.column_bytes(["x"]) / t.num_entries
    assert t.num_entries == 17 and t.num_entries_for(round(per * 3), ["x"]) == 3 and t.num_entries_for(1) == 1
    assert t.common_entry_offsets() == [0, 17] and t.common_entry_offsets(filter_name="none") == [] and t.uncompressed_bytes >= t.column_bytes(["x"]) and t.compression_ratio > 0
    assert [n for _, _, n in session.num_entries(spark, f"{chunks}/f{{0,2}}.parquet")] == [17, 23]
    assert session.partitions(t, steps_per_file=3)[-1][1:] == (12, 17)


@pytest.mark.parametrize("spec, kept", [
    (None, "ab Ab a1 b"), ("a*", "ab a1"), ("/a/", "ab a1"), ("/A/i", "ab Ab a1"), ("b", "b"), (["b", "A?"], "Ab b"), (lambda n: n.isalpha(), "ab Ab b"), ("/.b/", "ab Ab"),
])
def test_name_filters(spec, kept):
    assert " ".join(filter(name_filter(spec), "ab Ab a1 b".split())) == kept


def test_small_helpers():
    assert [memory_size(s) for s in ("1 kB", "1KiB", "2.5 mb", "100 MB", "7B", "12")] == [1000, 1024, 2500000, 10**8, 7, None]
    with pytest.raises(ValueError):
        memory_size("5 apples")
    assert renamer("/^a(.)/x\\1/")("abc") == "xbc" and renamer([{"p": "q"}, "/p/r/"])("p") == "q" and renamer(None)("z") == "z" and renamer("s/B$/d/i")("ab") == "ad"
    with pytest.raises(ValueError, match="flag"):
        renamer("/a/b/q")
    assert edit_distance("abcd", "acbd") == 1 and edit_distance("", "ab") == 2
    assert files.split_object("s3://b/f.parquet:dir//t") == ("s3://b/f.parquet", "dir/t") and files.split_object("http://h:80/f") == ("http://h:80/f", None)
    assert files.split_object("C:\\x.parquet") == ("C:\\x.parquet", None) and files.split_object("a.zip::b.parquet:t") == ("a.zip::b.parquet", "t")
    assert files.expand_braces("x{a,b{1,2}}y") == ["xay", "xb1y", "xb2y"]


def test_catalogue(spark):
    t = Tree(spark.createDataFrame([(1, (2, [3.0]), ["s"])], "n int, p struct<a:int,v:array<double>>, s array<string>"))
    assert t.keys() == ["n", "p", "p.a", "p.v", "s"] and t.keys(recursive=False) == ["n", "p", "s"]
    assert t.typenames(filter_typename=["int32_t", "*[[]]"]) == {"n": "int32_t", "p.a": "int32_t", "p.v": "double[]", "s": "std::string[]"}
    assert t["p"].keys() == ["a", "v"] and t["p/a"].arrays().first()[0] == 2 and t["a"].schema.names == ["a"] and "/a" not in t and "/p/a" in t
    with pytest.raises(KeyInTableError, match="'n'"):
        t["m"]
    assert "p.v" in t.show() and t["n"].array("double").first()[0] == 1.0


def test_grouped_cases(spark):
    schema = spark.createDataFrame([], "p struct<a:int,b:int,c:int>, q int").schema
    assert group_cases(schema, ["p"]) == ["p"]
    assert group_cases(schema, ["p.a", "p.b"]) == ["p.a", "p.b"]
    assert group_cases(schema, ["p", "p.a", "p.b", "p.c", "q"]) == ["p.a", "p.b", "p.c", "q"]
    assert group_cases(schema, ["p", "p.a"]) == ["p"]


def test_queries(spark):
    t = Tree(spark.createDataFrame([(k, float(k)) for k in range(-15, 15)], "i4 int, x double"), order_by=["i4"])
    assert sorted(r[0] for r in t.arrays(["i4 + 100"], "i4 > 0").collect()) == list(range(101, 115))
    assert t.arrays(["i4", "i4"]).columns == ["i4"] and t.arrays({"i4": "double"}).first()[0] == float(t.arrays("i4").first()[0])
    assert sorted(r.i4 for r in t.arrays(["i4"], entry_start=-3).collect()) == [12, 13, 14]
    assert t.arrays("i*").columns == ["i4"] and set(t.arrays(how=dict)) == {"i4", "x"} and len(t.arrays(how=tuple)) == 2
    assert t.arrays(["y"], aliases={"y": "z + 1", "z": "i4"}).count() == 30
    assert t.arrays(["x"], "x / 0.0 != 0").count() == 30
    for bad in (3, [3]):
        with pytest.raises(TypeError):
            t.arrays(bad)
    with pytest.raises(ValueError, match="two types"):
        t.arrays([("i4", "double"), ("i4", "float")])


def test_list_cuts_and_zip(spark):
    t = Tree(spark.createDataFrame([([1, 2, 3], [1.0, 5.0, 9.0], 7), ([], [], 8)], "Mu_q array<int>, Mu_p array<double>, n int"))
    assert sorted(r.Mu_q for r in t.arrays(["Mu_q"], "Mu_p > 4").collect()) == [[], [2, 3]]
    with pytest.raises(ExpressionError, match="explode"):
        t.arrays(["n"], "Mu_p > 4")
    got = t.arrays(["n", "Mu_q"], "Mu_p > 4", cut_broadcast=True).collect()
    assert sorted((r.n, r.subentry, r.Mu_q) for r in got) == [(7, 1, 2), (7, 2, 3)]
    z = t.arrays(how="zip")
    assert z.columns == ["Mu", "n"] and [x.asDict() for x in z.where("n = 7").first().Mu] == [{"q": 1, "p": 1.0}, {"q": 2, "p": 5.0}, {"q": 3, "p": 9.0}]


def test_missing_files_and_reports(spark, chunks):
    with pytest.raises(FileNotFoundError):
        session.concatenate(spark, [f"{chunks}/f0.parquet", f"{chunks}/none.parquet"], ["x"])
    assert session.concatenate(spark, [f"{chunks}/f0.parquet", f"{chunks}/none.parquet"], ["x"], allow_missing=True).count() == 17
    bad = chunks / "bad.parquet"
    bad.write_bytes(b"PAR1 not really")
    rows, report = session.read_with_report(spark, [f"{chunks}/f0.parquet", str(bad)], "x long", ["x"])
    assert rows.count() == 17 and [r["ok"] for r in report] == [True, False]
    with pytest.raises(ValueError, match="no column"):
        session.lazy(spark, [spark.range(1), spark.range(1).toDF("other")])


def test_numbering(spark):
    from quern.operators.tree import number_rows

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = number_rows(rows, ["v"]).toPandas().sort_values("_entry")
    assert got._entry.tolist() == list(range(1000)) == got.v.tolist() and np.all(np.diff(got.v) == 1)


def test_numbering_of_more_rows_than_a_range_samples(spark):
    from quern.operators.tree import number_rows

    rows = spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("v"), F.lit(None).cast("string").alias("none"))
    got = number_rows(rows, ["v"])
    assert got.where("_entry <> v").count() == 0 and got.agg(F.min("_entry"), F.max("_entry"), F.countDistinct("_entry")).first()[:] == (0, 399_999, 400_000)
    assert Tree(rows.select("v"), order_by=["v"]).arrays(["v"], entry_start=123_456, entry_stop=123_459).toPandas().v.sort_values().tolist() == [123_456, 123_457, 123_458]
    assert number_rows(rows.where("false"), ["v"]).collect() == []


def test_many_files_are_one_scan(spark, tmp_path):
    import pandas as pd

    for k in range(70):
        pd.DataFrame({"x": np.arange(k, k + k % 4, dtype="int64"), "y": float(k)}).to_parquet(f"{tmp_path}/a {k:03}.parquet")
    got = session.concatenate(spark, f"{tmp_path}/*.parquet", ["x"], "x % 2 == 0", entry=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    want = [x for k in range(70) for x in range(k, k + k % 4)]
    assert "Union" not in plan and sorted((r._entry, r.x) for r in got.collect()) == [(e, x) for e, x in enumerate(want) if x % 2 == 0]
    for a, b in ((3, 100), (-20, None), (50, 51), (0, 1)):
        part = session.concatenate(spark, f"{tmp_path}/*.parquet", ["x"], entry_start=a, entry_stop=b)
        assert sorted(r.x for r in part.collect()) == sorted(want[slice(a, b)])
    assert session.lazy(spark, f"{tmp_path}/*.parquet").count() == len(want)
    batches = Tree.open_many(spark, sorted(map(str, tmp_path.glob("*.parquet")))).batches(2, ["x"], "x >= 0")
    assert batches.where("_batch_file = 7").count() == 3 and batches.where("_batch_file = 7 and _batch = 1").count() == 1
    pd.DataFrame({"x": [1]}).to_parquet(f"{tmp_path}/a 999.parquet")
    with pytest.raises(KeyInTableError):
        session.concatenate(spark, f"{tmp_path}/*.parquet", ["x"])
