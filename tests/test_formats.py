"""Type names, byte ranges, compressed blocks, packed values, evolving schemas."""

import http.server
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import packed
from quern.functions.cpptypes import CppTypeError, parse
from quern.sources import ranges, session


@pytest.mark.parametrize("name, kind", [
    ("int", "int"), ("unsigned int", "bigint"), ("const ULong64_t", "decimal(20,0)"), ("std::vector<std::vector<double> >", "array<array<double>>"), ("char*", "string"), ("float[]", "array<float>"),
    ("std::map<int, std::vector<std::string>>", "map<int,array<string>>"), ("std::pair<int32_t,std::string>", "struct<_0:int,_1:string>"), ("std::bitset<16>", "array<boolean>"), ("int*", "int"),
    ("std::variant<int,std::string>", "struct<tag:int,_0:int,_1:string>"), ("std::optional<unsigned char>", "smallint"), ("std::array<float, 3>", "array<float>"), ("VecOps::RVec<bool>", "array<boolean>"), ("std::set<int>[2][3]", "array<array<array<int>>>"),
])
def test_type_names(name, kind):
    assert parse(name).simpleString() == kind


@pytest.mark.parametrize("bad", ["", "vector<", "Foo", "std::vector<int>>", "int;", "std::bitset<>"])
def test_bad_type_names(bad):
    with pytest.raises(CppTypeError):
        parse(bad)


def test_coalescing():
    got = ranges.coalesce([(0, 10), (20, 30), (100_000, 100_010), (5, 12)], gap=16)
    assert [(r.start, r.stop, len(r.parts)) for r in got] == [(0, 30, 3), (100_000, 100_010, 1)]
    assert len(ranges.coalesce([(k, k + 1) for k in range(10)], most_ranges=4)) == 3 and len(ranges.coalesce([(0, 6), (6, 12)], most_bytes=10)) == 2


def test_range_reads(tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(256)) * 400)

    class Handler(http.server.BaseHTTPRequestHandler):
        honest = True

        def do_GET(self):
            raw = (tmp_path / "f").read_bytes()
            if self.honest:
                a, b = map(int, self.headers["Range"][6:].split("-"))
                raw = raw[a : b + 1]
            self.send_response(206 if self.honest else 200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        for url in (str(tmp_path / "f"), f"file://{tmp_path}/f", f"http://127.0.0.1:{server.server_port}/f"):
            reader = ranges.RangeReader(url)
            assert reader.read([(300, 303), (0, 2), (90_000, 90_001)]) == [bytes([44, 45, 46]), bytes([0, 1]), bytes([90_000 % 256])]
            assert (reader.counters.requests, reader.counters.chunks) == (2, 3)
        Handler.honest = False
        assert ranges.RangeReader(f"http://127.0.0.1:{server.server_port}/f").read([(256, 258)]) == [bytes([0, 1])]
    finally:
        server.shutdown()


@pytest.mark.parametrize("kind", ["ZL", "XZ", "L4", "ZS"])
def test_blocks(kind):
    raw = b"abcabcabd" * 1000
    made = ranges.compress(raw, kind, block=4000)
    assert ranges.decompress(made, len(raw)) == raw and made[:2] == kind.encode() and ranges.decompress(raw, len(raw)) == raw
    with pytest.raises(ranges.BlockError):
        ranges.decompress(b"CS" + made[2:], len(raw))
    with pytest.raises(ranges.BlockError):
        ranges.decompress(made[:-4000] if len(made) > 4000 else b"ZL", len(raw))
    if kind == "L4":
        with pytest.raises(ranges.BlockError, match="checksum"):
            ranges.decompress(made[:9] + b"\x00" * 8 + made[17:], len(raw))


def test_matrices_and_truncation(spark):
    m = spark.sql("select array(1, 2, 3, 4, 5, 6) p").select(packed.symmetric(F.col("p"), 3)).first()[0]
    assert m == [[1, 2, 4], [2, 3, 5], [4, 5, 6]]
    x = np.array([0.0, 1.2345678, -3.1415927, 1e-20, 6e23], np.float32)
    cut = (x.view(np.uint32) & np.uint32(0xFFFFFFFF << (23 - 10) & 0xFFFFFFFF)).view(np.float32)
    got = spark.createDataFrame([(float(v),) for v in x], "v double").select(packed.truncate_float(F.col("v").cast("float"), 10)).collect()
    assert [r[0] for r in got] == cut.tolist()


def test_evolving_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 2.5, [1], "s", (4,))], "x int, y double, v array<int>, t string, p struct<q:int>")
    rows = sorted(session.evolved(spark, [a, b]).collect())
    assert tuple(rows[0])[:4] == (1, 0.0, [], "") and rows[0].p.q == 0 and rows[1].y == 2.5
