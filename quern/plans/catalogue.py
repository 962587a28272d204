"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import packed
from quern.functions.filters import renamer
from quern.operators import graph, nested
from quern.operators.histogram import Axis, dense_frame, fill_frame, profile_columns, profile_frame, statistics
from quern.operators.tree import Tree, number_rows
from quern.sources import session
from quern.sources.catalog import Catalog
from quern.sources.shared import new_folder
from quern.streaming import steps

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def tree(spark: SparkSession, sf_dir: str, name: str, **options) -> Tree:
    return Tree.open(spark, f"{sf_dir}/{name}.parquet", **options)


def scratch(spark: SparkSession) -> str:
    """A folder of its own that all executors see."""
    return new_folder(spark, "query")


def named(rows: DataFrame, *names: str) -> DataFrame:
    return rows.toDF(*names)


TOTAL = {"total": "l_extendedprice * (1 - l_discount)", "taxed": "total * (1 + l_tax)"}


# ---- expressions, aliases, cuts


@query("""SELECT l_extendedprice * (1 - l_discount) AS total FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05""")
def expr_projection_cut(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").arrays(["total"], "(l_quantity > 25) & (l_discount < 0.05)", aliases=TOTAL)


@query("""SELECT l_orderkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS taxed FROM lineitem""")
def nested_alias(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "taxed"], aliases=TOTAL)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000""")
def cut_not_in_output(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "l_linenumber"], "total > 50000", aliases=TOTAL)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber - 1 <> 0""")
def numeric_truth_cut(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "l_linenumber"], "l_linenumber - 1")


@query("""SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O'""")
def string_cut(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "l_quantity"], "(l_returnflag == 'R') & (l_linestatus != 'O')")


@query("""SELECT l_orderkey, CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE l_quantity END AS picked FROM lineitem""")
def where_function(spark, sf_dir):
    return named(tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "where(l_discount > 0.05, l_extendedprice, l_quantity)"]), "l_orderkey", "picked")


@query("""SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS a, round(ln(l_extendedprice), 6) AS b, round(log10(l_quantity), 6) AS c,
  round(exp(l_discount), 6) AS d, round(sin(l_quantity), 6) AS e, round(atan2(l_tax, l_discount + 0.01), 6) AS f, floor(l_extendedprice) AS g, ceil(l_extendedprice) AS h,
  round(cbrt(l_extendedprice), 6) AS i, CASE WHEN l_tax > l_discount THEN l_tax ELSE l_discount END AS j FROM lineitem""")
def function_table(spark, sf_dir):
    e = ["sqrt(l_extendedprice)", "log(l_extendedprice)", "log10(l_quantity)", "exp(l_discount)", "sin(l_quantity)", "arctan2(l_tax, l_discount + 0.01)", "floor(l_extendedprice)", "ceil(l_extendedprice)", "cbrt(l_extendedprice)", "fmax(l_tax, l_discount)"]
    out = named(tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "l_linenumber", *e]), "l_orderkey", "l_linenumber", *"abcdefghij")
    return out.withColumns({c: F.round(c, 6) for c in "abcdefi"})


@query("""SELECT l_orderkey, l_linenumber, l_linenumber / 0.0 AS inf_, 0.0 / 0.0 AS nan_, CAST('nan' AS DOUBLE) AS bad_log FROM lineitem""")
def division_by_zero(spark, sf_dir):
    return named(tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "l_linenumber", "l_linenumber / 0.0", "0.0 / 0.0", "log(-1.0)"]), "l_orderkey", "l_linenumber", "inf_", "nan_", "bad_log")


@query("""SELECT l_orderkey, l_linenumber,
  CAST(floor((l_partkey - 500) / 7.0) AS BIGINT) AS fd, CAST((((l_partkey - 500) % 7) + 7) % 7 AS BIGINT) AS md, CAST(l_linenumber * l_linenumber AS INTEGER) AS sq,
  CAST(l_orderkey & 12 AS BIGINT) AS an, CAST(xor(l_orderkey, l_suppkey) AS BIGINT) AS xo, CAST(l_linenumber << 3 AS INTEGER) AS sh, CAST(-l_linenumber - 1 AS INTEGER) AS inv FROM lineitem""")
def whole_number_operators(spark, sf_dir):
    e = ["(l_partkey - 500) // 7", "(l_partkey - 500) % 7", "l_linenumber ** 2", "l_orderkey & 12", "l_orderkey ^ l_suppkey", "l_linenumber << 3", "~l_linenumber"]
    return named(tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "l_linenumber", *e]), "l_orderkey", "l_linenumber", "fd", "md", "sq", "an", "xo", "sh", "inv")


@query("""SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half_even, trunc(-l_extendedprice) AS cut_, sign(l_discount - 0.05) < 0 AS neg FROM lineitem""")
def rounding(spark, sf_dir):
    return named(tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "l_linenumber", "round(l_quantity / 2)", "trunc(-l_extendedprice)", "signbit(l_discount - 0.05)"]), "l_orderkey", "l_linenumber", "half_even", "cut_", "neg")


# Fixed values in the SQL: the language's own polynomials for erf and ln gamma.
@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_discount AS x, 1.0 / (1.0 + 0.3275911 * l_discount) AS t, CAST(l_linenumber AS DOUBLE) AS n FROM lineitem),
g AS (SELECT *, 1.0 + 76.18009173 / (n + 1) - 86.50532033 / (n + 2) + 24.01409822 / (n + 3) - 1.231739516 / (n + 4)
  + 0.00120858003 / (n + 5) - 0.00000536382 / (n + 6) AS s FROM v)
SELECT l_orderkey, l_linenumber,
  round(1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x), 6) AS erf_,
  round_even(exp((n + 0.5) * ln(n + 5.5) - (n + 5.5) + ln(2.50662827465 * s)), 0) AS fact FROM g""")
def special_functions(spark, sf_dir):
    out = named(tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "l_linenumber", "erf(l_discount)", "factorial(l_linenumber)"]), "l_orderkey", "l_linenumber", "erf_", "fact")
    return out.withColumn("erf_", F.round("erf_", 6))


@query("""SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_quantity AS INTEGER) AS l_quantity FROM lineitem""")
def reinterpreted_types(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").arrays([("l_orderkey", "double"), ("l_quantity", "int")])


# ---- selection of columns


@query("""SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem""")
def filter_name_glob(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").arrays(filter_name="l_*key")


@query("""SELECT l_shipdate, l_suppkey FROM lineitem""")
def filter_name_regex(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").arrays(filter_name="/L_S(U|H)/i")


@query("""SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def filter_typename(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").arrays(filter_typename="double")


@query("""SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'int64_t' WHEN 'INTEGER' THEN 'int32_t' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'std::string' ELSE 'timestamp_ntz' END AS typename
FROM (DESCRIBE SELECT * FROM lineitem)""")
def typenames(spark, sf_dir):
    return spark.createDataFrame(list(tree(spark, sf_dir, "lineitem").typenames().items()), "name string, typename string")


@query("""SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_totalprice AS totalprice FROM orders""")
def renamed_columns(spark, sf_dir):
    rule = renamer(["/^o_(.*)key$/\\1_key/", {"o_totalprice": "totalprice"}])
    out = tree(spark, sf_dir, "orders").arrays(["o_orderkey", "o_custkey", "o_totalprice"])
    return out.toDF(*map(rule, out.columns))


def _orders_struct(spark, sf_dir) -> Tree:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return Tree(o.select("o_orderkey", F.struct(F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("p")))


@query("""SELECT o_orderkey, o_custkey AS cust, o_totalprice AS price FROM orders""")
def grouped_some_children(spark, sf_dir):
    out = _orders_struct(spark, sf_dir).arrays(filter_name=["o_orderkey", "p.cust", "p.price"])
    return named(out, "o_orderkey", "cust", "price")


@query("""SELECT o_orderkey, o_custkey AS p_cust, o_totalprice AS p_price, o_orderstatus AS p_status FROM orders""")
def flattened_records(spark, sf_dir):
    return nested.flatten_records(_orders_struct(spark, sf_dir).arrays(filter_name=["o_orderkey", "p"]))


# ---- entries and batches


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER () - 1 AS e FROM lineitem) WHERE e >= 100 AND e < 2500""")
def entry_range(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "l_linenumber"], entry_start=100, entry_stop=2500)


@query("""SELECT l_orderkey, l_linenumber, CAST(e AS BIGINT) AS _entry FROM (SELECT *, row_number() OVER () - 1 AS e, count(*) OVER () AS n FROM lineitem) WHERE e >= n - 500 AND e < n - 20 AND l_quantity > 10""")
def negative_range_with_cut(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").arrays(["l_orderkey", "l_linenumber"], "l_quantity > 10", entry_start=-500, entry_stop=-20, entry=True)


@query("""SELECT CAST(floor((row_number() OVER () - 1) / 700) AS BIGINT) AS batch, l_orderkey, l_linenumber FROM lineitem""")
def batches(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").batches(700).select(F.col("_batch").alias("batch"), "l_orderkey", "l_linenumber")


@query("""SELECT CAST(e // 20000 AS BIGINT) AS batch, count(*) FILTER (WHERE l_quantity > 25) AS n FROM (SELECT l_quantity, row_number() OVER () - 1 AS e FROM lineitem) GROUP BY 1""")
def iterate_with_cut(spark, sf_dir):
    return tree(spark, sf_dir, "lineitem").batches(20000, ["l_quantity"], "l_quantity > 25").groupBy(F.col("_batch").alias("batch")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT s_suppkey AS k, row_number() OVER () - 1 AS e FROM supplier), n AS (SELECT count(*) AS n FROM supplier)
SELECT k AS s_suppkey, CAST(e AS BIGINT) AS _entry FROM a WHERE e >= 3 UNION ALL SELECT k, CAST(e + n AS BIGINT) FROM a, n WHERE e + n < 2 * n - 2""")
def concatenate_range(spark, sf_dir):
    path = f"{sf_dir}/supplier.parquet"
    return session.concatenate(spark, [path, path], ["s_suppkey"], entry_start=3, entry_stop=-2, entry=True)


@query("""SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey > 10""")
def common_columns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return session.lazy(spark, [c.select("c_custkey", "c_name", "c_acctbal"), c.where("c_nationkey > 10").select("c_mktsegment", "c_name", "c_custkey")])


@query("""SELECT 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders""")
def entry_counts(spark, sf_dir):
    got = [(p.rpartition("/")[2].removesuffix(".parquet"), n) for p, _, n in session.num_entries(spark, [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet"])]
    return spark.createDataFrame(got, "name string, n long")


@query("""SELECT CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS _entry, o_orderkey FROM orders""")
def numbered_frame(spark, sf_dir):
    return number_rows(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"]).select("_entry", "o_orderkey")


# ---- list-valued columns


def jagged(spark: SparkSession, sf_dir: str) -> Tree:
    """Orders with their lines as lists, in order of line number."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_partkey", "l_extendedprice")
    return Tree(nested.implode(lines, ["l_orderkey"], "l_linenumber", ["l_quantity", "l_discount", "l_partkey", "l_extendedprice"]))


_JAGGED = "SELECT l_orderkey, list({q: l_quantity, d: l_discount, p: l_partkey, x: l_extendedprice} ORDER BY l_linenumber, l_quantity, l_discount, l_partkey, l_extendedprice) AS v FROM lineitem GROUP BY l_orderkey"


@query(f"""SELECT l_orderkey, list_transform(v, lambda e: e.x * (1 - e.d)) AS paid FROM ({_JAGGED})""")
def jagged_arithmetic(spark, sf_dir):
    return jagged(spark, sf_dir).arrays(["l_orderkey", "paid"], aliases={"paid": "l_extendedprice * (1 - l_discount)"})


@query(f"""SELECT l_orderkey, list_transform(list_filter(v, lambda e: e.q > 20), lambda e: e.p) AS l_partkey FROM ({_JAGGED})""")
def jagged_element_cut(spark, sf_dir):
    return named(jagged(spark, sf_dir).arrays(["l_orderkey", "l_partkey[l_quantity > 20]"]), "l_orderkey", "l_partkey")


@query(f"""SELECT list_transform(list_filter(v, lambda e: e.d >= 0.05), lambda e: e.q) AS l_quantity FROM ({_JAGGED})""")
def jagged_cut(spark, sf_dir):
    return jagged(spark, sf_dir).arrays(["l_quantity"], "l_discount >= 0.05")


@query("""SELECT l_orderkey, count(*) AS n, max(l_quantity) AS most, min(l_partkey) AS first_part, CAST(sum(l_partkey) AS BIGINT) AS parts, bool_or(l_discount > 0.09) AS any_, bool_and(l_quantity > 5) AS all_ FROM lineitem GROUP BY l_orderkey""")
def jagged_reducers(spark, sf_dir):
    e = ["l_quantity.count()", "l_quantity.max()", "l_partkey.min()", "l_partkey.sum()", "(l_discount > 0.09).any()", "(l_quantity > 5).all()"]
    return named(jagged(spark, sf_dir).arrays(["l_orderkey", *e]), "l_orderkey", "n", "most", "first_part", "parts", "any_", "all_")


@query(f"""SELECT l_orderkey, v[1].q AS first_, v[-1].q AS last_, list_transform(v[2:3], lambda e: e.p) AS mid FROM ({_JAGGED})""")
def jagged_elements(spark, sf_dir):
    return named(jagged(spark, sf_dir).arrays(["l_orderkey", "l_quantity[:, 0]", "l_quantity[:, -1]", "l_partkey[:, 1:3]"]), "l_orderkey", "first_", "last_", "mid")


@query(f"""SELECT l_orderkey, list_transform(v, lambda e: e.q) AS quantity, list_transform(v, lambda e: e.d) AS discount FROM ({_JAGGED})""")
def jagged_zip(spark, sf_dir):
    return jagged(spark, sf_dir).arrays(["l_orderkey", "l_quantity", "l_discount"], how="zip").select("l_orderkey", "l.quantity", "l.discount")


@query(f"""SELECT l_orderkey, CAST(i - 1 AS INTEGER) AS subentry, v[i].q AS l_quantity, v[i].p AS l_partkey FROM (SELECT l_orderkey, v, unnest(generate_series(1, len(v))) AS i FROM ({_JAGGED}))""")
def jagged_explode(spark, sf_dir):
    return nested.explode(jagged(spark, sf_dir).arrays(["l_orderkey", "l_quantity", "l_partkey"]), ["l_quantity", "l_partkey"])


@query(f"""SELECT l_orderkey, CAST(i - 1 AS INTEGER) AS subentry, v[i].p AS l_partkey FROM (SELECT l_orderkey, v, unnest(generate_series(1, len(v))) AS i FROM ({_JAGGED})) WHERE v[i].d > 0.05""")
def jagged_cut_broadcast(spark, sf_dir):
    return jagged(spark, sf_dir).arrays(["l_orderkey", "l_partkey"], "l_discount > 0.05", cut_broadcast=True)


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive FROM embeddings""")
def vector_norms(spark, sf_dir):
    t = Tree(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("wide", F.col("embedding").cast("array<double>")))
    out = named(t.arrays(["vec_id", "sqrt((wide * wide).sum())", "(embedding > 0).sum()"]), "vec_id", "norm", "positive")
    return out.withColumn("norm", F.round("norm", 5))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS said FROM orders""")
def map_lookup(spark, sf_dir):
    table = F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("done"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", nested.map_get(table, F.col("o_orderstatus"), F.lit("other")).alias("said"))


@query("""SELECT o_orderkey, CAST((year(o_orderdate) - 1995) * 67108864 + month(o_orderdate) * 4194304 + day(o_orderdate) * 131072 + hour(o_orderdate) * 4096
  + minute(o_orderdate) * 64 + second(o_orderdate) AS BIGINT) AS code, CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) AS t FROM orders WHERE year(o_orderdate) >= 1995""")
def packed_datime(spark, sf_dir):
    """Orders of the years that the packed form holds: their codes and what the codes read as."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("year(o_orderdate) >= 1995")
    return o.select("o_orderkey", packed.pack_datime(F.col("o_orderdate")).alias("code")).withColumn("t", packed.unpack_datime(F.col("code")))


# ---- histograms, profiles, graphs

PRICE, QUANTITY = Axis.regular(20, 0.0, 60000.0), Axis.regular(10, 1.0, 41.0)
UNEVEN = Axis.variable([0.0, 10.0, 15.0, 30.0, 31.5, 50.0])
FLAGS = Axis.category(["A", "N"])
_BIN = "CASE WHEN {x} < {lo} THEN 0 WHEN {x} >= {hi} THEN {n} + 1 ELSE CAST(floor(({x} - {lo}) / (({hi} - {lo}) / {n})) AS INTEGER) + 1 END"
_PX = _BIN.format(x="l_extendedprice", lo="0.0", hi="60000.0", n=20)
_QX = _BIN.format(x="l_quantity", lo="1.0", hi="41.0", n=10)


def _lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


@query(f"""SELECT CAST(g.i AS INTEGER) AS ix, count(b) AS entries, CAST(count(b) AS DOUBLE) AS value, CAST(count(b) AS DOUBLE) AS variance
FROM generate_series(0, 21) g(i) LEFT JOIN (SELECT {_PX} AS b FROM lineitem) ON b = g.i GROUP BY g.i""")
def histogram_1d(spark, sf_dir):
    return dense_frame(fill_frame(_lines(spark, sf_dir), [PRICE], ["l_extendedprice"]), [PRICE])


@query(f"""SELECT {_PX} AS ix, count(*) AS entries, round(sum(l_discount), 6) AS value, round(sum(l_discount * l_discount), 6) AS variance FROM lineitem GROUP BY 1""")
def histogram_weighted(spark, sf_dir):
    return fill_frame(_lines(spark, sf_dir), [PRICE], ["l_extendedprice"], "l_discount").withColumns({c: F.round(c, 6) for c in ("value", "variance")})


@query(f"""SELECT {_PX} AS ix, {_QX} AS iy, count(*) AS entries FROM lineitem GROUP BY 1, 2""")
def histogram_2d(spark, sf_dir):
    return fill_frame(_lines(spark, sf_dir), [PRICE, QUANTITY], ["l_extendedprice", "l_quantity"]).select("ix", "iy", "entries")


@query(f"""SELECT {_PX} AS ix, {_QX} AS iy, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS iz, count(*) AS entries FROM lineitem GROUP BY 1, 2, 3""")
def histogram_3d_category(spark, sf_dir):
    return fill_frame(_lines(spark, sf_dir), [PRICE, QUANTITY, FLAGS], ["l_extendedprice", "l_quantity", "l_returnflag"]).select("ix", "iy", "iz", "entries")


@query("""SELECT CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 15 THEN 2 WHEN l_quantity < 30 THEN 3 WHEN l_quantity < 31.5 THEN 4 WHEN l_quantity < 50 THEN 5 ELSE 6 END AS ix, count(*) AS entries FROM lineitem GROUP BY 1""")
def histogram_variable(spark, sf_dir):
    return fill_frame(_lines(spark, sf_dir), [UNEVEN], ["l_quantity"]).select("ix", "entries")


@query("""SELECT count(*) AS entries, round(sum(l_discount), 4) AS sumw, round(sum(l_discount * l_discount), 4) AS sumw2, round(sum(l_discount * l_quantity), 3) AS sumwx, round(sum(l_discount * l_quantity * l_quantity), 2) AS sumwx2
FROM lineitem WHERE l_quantity >= 1 AND l_quantity < 41""")
def histogram_statistics(spark, sf_dir):
    got = statistics(_lines(spark, sf_dir), [QUANTITY], ["l_quantity"], "l_discount")
    row = [(int(got["entries"]), round(got["sumw"], 4), round(got["sumw2"], 4), round(got["sumwx"], 3), round(got["sumwx2"], 2))]
    return spark.createDataFrame(row, "entries long, sumw double, sumw2 double, sumwx double, sumwx2 double")


def _profile(spark, sf_dir, mode, weight=None):
    cells = profile_frame(_lines(spark, sf_dir), [PRICE], ["l_extendedprice"], "l_quantity", weight)
    got = profile_columns(mode, weight is not None)
    return cells.select("ix", *[F.round(v, 6).alias(k) for k, v in got.items()])


def _profile_sql(error: str, weight: str = "1.0") -> str:
    neff = "w * w / w2" if weight != "1.0" else "w"
    return f"""WITH s AS (SELECT {_PX} AS ix, sum({weight}) AS w, sum({weight} * {weight}) AS w2, sum({weight} * l_quantity) AS wy, sum({weight} * l_quantity * l_quantity) AS wy2 FROM lineitem GROUP BY 1),
m AS (SELECT ix, CASE WHEN w <> 0 THEN wy / w ELSE 0 END AS mean, CASE WHEN w2 > 0 THEN {neff} ELSE 0 END AS neff, w, sqrt(abs(CASE WHEN w <> 0 THEN wy2 / w - (wy / w) * (wy / w) ELSE 0 END)) AS spread FROM s)
SELECT ix, round(mean, 6) AS mean, round(CAST(neff AS DOUBLE), 6) AS effective, round({error}, 6) AS error FROM m"""


@query(_profile_sql("CASE WHEN neff > 0 THEN spread / sqrt(neff) ELSE 0 END"))
def profile_mean(spark, sf_dir):
    return _profile(spark, sf_dir, "")


@query(_profile_sql("spread"))
def profile_spread(spark, sf_dir):
    return _profile(spark, sf_dir, "s")


@query(_profile_sql("CASE WHEN neff <= 0 THEN 0 WHEN spread <> 0 THEN spread / sqrt(neff) ELSE 1 / sqrt(12 * neff) END"))
def profile_integer(spark, sf_dir):
    return _profile(spark, sf_dir, "i")


@query(_profile_sql("CASE WHEN w > 0 THEN 1 / sqrt(w) ELSE 0 END", "l_discount"))
def profile_weighted(spark, sf_dir):
    return _profile(spark, sf_dir, "g", "l_discount")


@query(f"""SELECT {_PX} AS ix, {_QX} AS iy, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1, 2""")
def profile_2d(spark, sf_dir):
    cells = profile_frame(_lines(spark, sf_dir), [PRICE, QUANTITY], ["l_extendedprice", "l_quantity"], "l_discount")
    return cells.select("ix", "iy", F.round(profile_columns("", False)["mean"], 6).alias("mean"))


@query("""SELECT p_partkey, sqrt((p_size * p_size + (p_size + 1.0) * (p_size + 1.0)) / 2) AS mean_error, (p_size + p_size + 1.0) / 2 AS half FROM part""")
def graph_errors(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumns({"lo": F.col("p_size").cast("double"), "hi": F.col("p_size") + 1.0})
    g = graph.as_graph(p, "p_partkey", "p_retailprice", "lo", ("lo", "hi"))
    return g.select(F.col("x").cast("long").alias("p_partkey"), graph.errors("mean").alias("mean_error"), graph.errors("diff").alias("half"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity < 5 THEN 1.0 WHEN l_quantity < 20 THEN 1.0 + (l_quantity - 5) * (3.0 / 15) WHEN l_quantity < 45 THEN 4.0 - (l_quantity - 20) * (2.0 / 25) ELSE 2.0 END, 9) AS value FROM lineitem""")
def curve_interpolation(spark, sf_dir):
    xs, ys = graph.curve_arrays(spark.createDataFrame([(45.0, 2.0), (5.0, 1.0), (20.0, 4.0)], "x double, y double"))
    out = graph.interpolate(_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity"), F.col("l_quantity"), xs, ys)
    return out.select("l_orderkey", "l_linenumber", F.round("value", 9).alias("value"))


# ---- sinks and streams


@query("""SELECT s_suppkey, s_name, s_acctbal FROM supplier""")
def namespace_round_trip(spark, sf_dir):
    cat = Catalog.create(spark, scratch(spark))
    cat["a/b/suppliers"] = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey < 0")
    cat["a/b/suppliers"] = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return cat["a/b/suppliers"].arrays(["s_suppkey", "s_name", "s_acctbal"])


@query("""SELECT n_regionkey, CAST(len(list(n_nationkey)) AS INTEGER) AS nkeys, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1""")
def extended_table(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("keys"))
    cat = Catalog.create(spark, scratch(spark))
    out = cat.mktable("regions", {"n_regionkey": "int32", "keys": "var * int32"})
    out.extend(n.where("n_regionkey < 2"))
    out.extend(n.where("n_regionkey >= 2"))
    return cat["regions"].arrays()


@query("""SELECT r_regionkey, r_name FROM region""")
def copied_table(spark, sf_dir):
    one, two = (Catalog.create(spark, scratch(spark)) for _ in range(2))
    one["in/region"] = spark.read.parquet(f"{sf_dir}/region.parquet")
    two.copy_from(one, filter_name="in/*", rename="/^in/out/")
    return two["out/region"].arrays()


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY 1""")
def stream_select(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = steps.read(spark, f"{sf_dir}/events.parquet", schema)
    out = scratch(spark)
    steps.extend(steps.select(stream, ["event_type", "value"]), f"{out}/rows", f"{out}/log").awaitTermination()
    rows = spark.read.schema("event_type string, value double").parquet(f"{out}/rows")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"))


@query("""SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE CAST(floor(value / 10) AS INTEGER) + 1 END AS ix, count(*) AS entries FROM events GROUP BY 1""")
def batch_histogram_of_events(spark, sf_dir):
    """Events as a stream into running cells; each micro-batch writes the cells it changed, and the last of each counts."""
    axis, out = Axis.regular(10, 0.0, 100.0), scratch(spark)
    stream = steps.read(spark, f"{sf_dir}/events.parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)
    cells = steps.histogram(stream, [axis], [F.col("value")])
    steps.cells_to(cells, f"{out}/cells", f"{out}/log").awaitTermination()
    return steps.last_cells(spark, f"{out}/cells", cells.schema).select("ix", "entries")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
