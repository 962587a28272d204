"""Namespaces: versions, writing, extending, copying; streams."""

import numpy as np
import pytest

from quern.operators.histogram import from_numpy
from quern.sources import session
from quern.sources.catalog import Catalog, schema_of
from quern.streaming import steps


@pytest.fixture
def cat(spark, tmp_path):
    return Catalog.create(spark, str(tmp_path / "ns"))


def test_versions(spark, cat):
    cat["d/t"] = spark.range(1)
    cat["d/t"] = spark.range(2)
    cat["note"] = "hello"
    assert cat.keys() == ["d;1", "d/t;2", "d/t;1", "note;1"] and cat.keys(cycle=False, recursive=False) == ["d", "note"]
    assert cat["d/t"].num_entries == 2 and cat["d/t;1"].num_entries == 1 and cat["note"] == "hello" and cat["d"].keys() == ["t;2", "t;1"]
    assert cat.classnames(filter_classname="string") == {"note;1": "string"} and "d/t;3" not in cat
    with pytest.raises(KeyError, match="d/t"):
        cat["d/u"]
    del cat["d/t;2"]
    assert cat["d/t"].num_entries == 1
    with pytest.raises(FileExistsError):
        Catalog.create(spark, cat.root)
    assert Catalog.recreate(spark, cat.root).keys() == []


def test_extend(spark, cat):
    w = cat.mktable("t", {"n": "int32", "v": "var * float64", "r": {"a": "int64", "b": "str"}})
    assert w.num_entries == 0
    w.extend(spark.createDataFrame([(1, [1.0, 2.0], (5, "x"))], "n int, v array<double>, r struct<a:bigint,b:string>"))
    got = cat["t"].arrays().collect()
    assert [r.asDict() for r in got] == [{"n": 1, "nv": 2, "v": [1.0, 2.0], "r_a": 5, "r_b": "x"}]
    with pytest.raises(ValueError, match="missing"):
        w.extend(spark.range(1).toDF("n"))
    assert schema_of({"a": np.dtype("int16"), "b": ("float32", (3,)), "c": float}).simpleString() == "struct<a:smallint,b:array<float>,c:double>"


def test_objects_and_copies(spark, cat, tmp_path):
    cat["h"] = np.histogram([1.0, 2.0, 2.5], bins=3, range=(0, 3))
    cat["m"] = {"one": [1, 2, 3], "two": [1.1, 2.2, 3.3]}
    assert cat["h"] == from_numpy(*np.histogram([1.0, 2.0, 2.5], bins=3, range=(0, 3))) and cat["h"].stats["entries"] == 3
    assert cat["m"].arrays(how=dict)["two"].tolist() == [1.1, 2.2, 3.3]
    cat.set_aliases("m", {"both": "one + two"})
    assert cat["m:one"].arrays().count() == 3 and cat["m"].arrays(["both"]).first()[0] == pytest.approx(2.1)
    other = Catalog.create(spark, str(tmp_path / "other"))
    assert other.copy_from(cat, filter_classname="table", rename="/m/copied/") == ["copied"] and other.only_table().num_entries == 3
    assert session.open(spark, f"{other.root}:copied").num_entries == 3 and session.open(spark, other.root).keys() == ["copied;1"]


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).selectExpr("id", "cast(id * 1.5 as double) as v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = steps.read(spark, str(tmp_path / "in"), "id long, v double")
    seen = []
    steps.for_each_batch(steps.select(stream, ["id"], "v > 3"), lambda rows, k: seen.append(rows.count()), str(tmp_path / "log1")).awaitTermination()
    assert sum(seen) == 27 and len(seen) == 3
    for _ in range(2):  # the second run finds nothing new
        steps.extend(stream, str(tmp_path / "out"), str(tmp_path / "log2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
