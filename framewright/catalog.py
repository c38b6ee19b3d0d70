"""One query per operator over the sample tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .operators.frame import Frame
from .operators.joins import concat, merge
from .plans.ordering import ORD
from .session import fresh_path
from .sources.files import read_excel, read_parquet
from .sources.text import parse_csv, parse_json, parse_tsv, read_csv, read_json, read_table, read_tsv
from .streaming.groups import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None):
    """Registers f(frames...) -> Frame or DataFrame under name."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(*[Frame(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in tables.split()])
            return out.result() if isinstance(out, Frame) else out

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


def holes(f: Frame, column: str, on: str) -> Frame:
    """Nulls where the condition holds: the tables have none."""
    return f.assign({column: F.when(~F.expr(on), F.col(column))})


def placed(f: Frame) -> DataFrame:
    """The rows with their positions, so that a comparison sees their order."""
    d = f._dense()
    return d.sdf.select(*[F.col(f"`{c}`") for c in f.columns], F.col(ORD).cast("bigint").alias("pos"))


def listed(f: Frame, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Values that an operation returned to the driver; sent back in Arrow batches, so that they aren't held as rows again."""
    kind = T.StructType.fromDDL(schema)
    own = to_arrow_schema(kind)
    parts = iter(lambda r=iter(rows): list(islice(r, 10_000)), [])
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part, strict=True), own.types, strict=True)], schema=own) for part in parts]
    return f.sdf.sparkSession.createDataFrame(pa.Table.from_batches(batches, own), kind)


def rounded(f: Frame, *columns: str, digits: int = 4) -> Frame:
    return f.assign({c: F.round(c, digits) for c in columns})


query("flagship", "lineitem orders", """SELECT o_orderstatus, round(sum(l_extendedprice), 2) AS l_extendedprice, round(avg(l_quantity), 4) AS l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0.02 GROUP BY 1""")(
    lambda li, o: rounded(rounded(merge(li.filter("l_discount > 0.02").rename({"l_orderkey": "k"}), o.rename({"o_orderkey": "k"}), "k").groupby("o_orderstatus").agg({"l_extendedprice": "sum", "l_quantity": "mean"}), "l_quantity"), "l_extendedprice", digits=2))
query("groupby_named_aggs", "lineitem", "SELECT l_returnflag, l_linestatus, count(l_orderkey) AS l_orderkey, sum(l_quantity) AS l_quantity, round(avg(l_discount), 6) AS l_discount, min(l_extendedprice) AS l_extendedprice, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2")(
    lambda f: rounded(f.groupby(["l_returnflag", "l_linestatus"]).agg({"l_orderkey": "count", "l_quantity": "sum", "l_discount": "mean", "l_extendedprice": "min", "l_shipdate": "max"}), "l_discount", digits=6))
NULLED = "(SELECT * REPLACE (CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag) FROM lineitem)"
query("groupby_dropna_true", "lineitem", f"SELECT l_returnflag, sum(l_quantity) AS l_quantity FROM {NULLED} WHERE l_returnflag IS NOT NULL GROUP BY 1")(lambda f: holes(f, "l_returnflag", "l_linenumber % 7 = 0").groupby("l_returnflag").agg({"l_quantity": "sum"}))
query("groupby_dropna_false", "lineitem", f"SELECT l_returnflag, sum(l_quantity) AS l_quantity FROM {NULLED} GROUP BY 1")(lambda f: holes(f, "l_returnflag", "l_linenumber % 7 = 0").groupby("l_returnflag", dropna=False).agg({"l_quantity": "sum"}))
query("groupby_size", "orders", "SELECT o_orderstatus, count(*) AS size FROM orders GROUP BY 1")(lambda f: f.groupby("o_orderstatus").size())
query("groupby_count", "orders", "SELECT o_orderstatus, count(o_custkey) AS o_custkey FROM orders GROUP BY 1")(lambda f: f.groupby("o_orderstatus").count(["o_custkey"]))
query("groupby_sum_mean", "customer", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY 1")(lambda f: rounded(f.select(["c_mktsegment", "c_acctbal"]).groupby("c_mktsegment").sum(), "c_acctbal", digits=2))
query("groupby_distinct_keys", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")(lambda f: f.groupby(["o_orderstatus", "o_orderpriority"]).agg({}))
query("groupby_custom_udaf", "orders", "SELECT o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")(lambda f: rounded(f.groupby("o_orderstatus").agg({"o_totalprice": lambda v: v.max() - v.min()}), "o_totalprice"))
query("filter_sort_topk", "orders", "SELECT * FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")(lambda f: f.filter("o_totalprice > 1000").sort_values(["o_totalprice", "o_orderkey"], [False, True], limit=100))
query("sort_multicol_topk", "orders", "SELECT * FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 800")(lambda f: f.sort_values(["o_orderpriority", "o_totalprice", "o_orderkey"], [True, False, True], limit=800))
query("sort_na_first", "orders", "SELECT * FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 50 <> 0 THEN o_orderpriority END AS o_orderpriority) FROM orders) ORDER BY o_orderpriority DESC NULLS FIRST, o_orderkey LIMIT 500")(lambda f: holes(f, "o_orderpriority", "o_orderkey % 50 = 0").sort_values(["o_orderpriority", "o_orderkey"], [False, True], limit=500, na_position="first"))
query("value_counts_1col", "orders", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")(lambda f: f.value_counts("o_orderpriority"))
query("value_counts_2col_limit", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")(lambda f: f.value_counts(["o_orderstatus", "o_orderpriority"], limit=10))
query("value_counts_normalize", "events", "SELECT event_type, round(count(*) / (SELECT count(*) FROM events), 6) AS proportion FROM events GROUP BY 1")(lambda f: rounded(f.value_counts("event_type", normalize=True), "proportion", digits=6))
query("value_counts_high_card_top100", "orders", "SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")(lambda f: f.value_counts("o_custkey", limit=100))
query("value_counts_ascending", "events", "SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 50")(lambda f: f.value_counts("user_id", ascending=True, limit=50))
query("value_counts_dropna_false", "orders", "SELECT CASE WHEN o_orderkey % 23 <> 0 THEN o_orderstatus END AS o_orderstatus, count(*) AS count FROM orders GROUP BY 1")(lambda f: holes(f, "o_orderstatus", "o_orderkey % 23 = 0").value_counts("o_orderstatus", dropna=False))
SIDES = "(SELECT o_orderkey, o_custkey AS k FROM orders WHERE o_custkey % 3 = 0) a {} JOIN (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k"
for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    query(f"merge_{_how}", "orders customer", f"SELECT o_orderkey, coalesce(a.k, b.k) AS k, c_name FROM {SIDES.format(_sql)}")(
        lambda o, c, how=_how: merge(o.filter("o_custkey % 3 = 0").rename({"o_custkey": "k"}).select(["o_orderkey", "k"]), c.filter("c_custkey % 2 = 0").rename({"c_custkey": "k"}).select(["k", "c_name"]), "k", how))
query("merge_null_keys", "nation supplier", "SELECT n_name, a.k AS k, s_name FROM (SELECT n_name, CASE WHEN n_nationkey <> 3 THEN n_nationkey END AS k FROM nation) a JOIN (SELECT s_name, CASE WHEN s_nationkey <> 5 THEN s_nationkey END AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k")(
    lambda n, s: merge(holes(n, "n_nationkey", "n_nationkey = 3").rename({"n_nationkey": "k"}).select(["n_name", "k"]), holes(s, "s_nationkey", "s_nationkey = 5").rename({"s_nationkey": "k"}).select(["s_name", "k"]), "k"))
query("merge_suffixes", "customer supplier", "SELECT a.k AS k, c_acctbal AS bal_l, s_acctbal AS bal_r FROM (SELECT c_custkey AS k, c_acctbal FROM customer) a JOIN (SELECT s_suppkey AS k, s_acctbal FROM supplier) b ON a.k = b.k")(
    lambda c, s: merge(c.rename({"c_custkey": "k", "c_acctbal": "bal"}).select(["k", "bal"]), s.rename({"s_suppkey": "k", "s_acctbal": "bal"}).select(["k", "bal"]), "k", suffixes=("_l", "_r")))
query("concat_rows", "customer supplier", "SELECT c_name AS name, c_acctbal, NULL AS s_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS label FROM customer UNION ALL SELECT s_name, NULL, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 FROM supplier")(
    lambda c, s: concat([c.sort_values("c_custkey").rename({"c_name": "name"}).select(["name", "c_acctbal"]).reset_index("old").drop("old"), s.sort_values("s_suppkey").rename({"s_name": "name"}).select(["name", "s_acctbal"]).reset_index("old").drop("old")]).reset_index("label"))
query("concat_columns", "customer supplier", "SELECT c_name, s_name FROM (SELECT * FROM customer WHERE c_custkey > 20) c FULL JOIN supplier s ON c_custkey = s_suppkey")(lambda c, s: concat([c.filter("c_custkey > 20").set_index("c_custkey").select(["c_name"]), s.set_index("s_suppkey").select(["s_name"])], axis=1))
query("drop_duplicates_first", "orders", "SELECT * EXCLUDE rn, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")(lambda f: placed(f.sort_values("o_orderkey", False).drop_duplicates(["o_custkey", "o_orderstatus"])))
query("drop_duplicates_last", "orders", "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")(lambda f: f.sort_values("o_orderkey").drop_duplicates("o_custkey", keep="last"))
query("drop_duplicates_none", "orders", "SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n = 1")(lambda f: f.drop_duplicates("o_custkey", keep=False).select(["o_orderkey", "o_custkey"]))
query("pivot_sum", "lineitem", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS F, sum(l_quantity) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")(lambda f: f.pivot_table("l_returnflag", "l_quantity", columns="l_linestatus", aggfunc="sum"))
query("pivot_multi_values", "lineitem", "SELECT l_linestatus, " + ", ".join(f"max({v}) FILTER (l_returnflag = '{q}') AS {v}_{q}" for v in ("l_quantity", "l_tax") for q in "ANR") + " FROM lineitem GROUP BY 1")(lambda f: f.pivot_table("l_linestatus", ["l_quantity", "l_tax"], columns="l_returnflag", aggfunc="max"))
query("pivot_margins", "lineitem", "SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'All' ELSE l_returnflag END AS l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 4) AS F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 4) AS O, round(avg(l_quantity), 4) AS \"All\" FROM lineitem GROUP BY ROLLUP (l_returnflag)")(lambda f: rounded(f.pivot_table("l_returnflag", "l_quantity", columns="l_linestatus", margins=True), "F", "O", "All"))
query("pivot_dropna_false", "lineitem", "SELECT l_linestatus, " + ", ".join(f"count(*) FILTER (l_linenumber % 7 <> 0 AND l_returnflag = '{q}') AS {q}" for q in "ANR") + ", count(*) FILTER (l_linenumber % 7 = 0) AS \"null\" FROM lineitem GROUP BY 1")(lambda f: holes(f, "l_returnflag", "l_linenumber % 7 = 0").pivot_table("l_linestatus", "l_quantity", columns="l_returnflag", aggfunc="count", dropna=False))
query("pivot_plain_margins", "customer", "SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'All' ELSE c_mktsegment END AS c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY ROLLUP (c_mktsegment)")(lambda f: rounded(f.pivot_table("c_mktsegment", "c_acctbal", aggfunc="sum", margins=True), "c_acctbal", digits=2))
RANKED = "(SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS s FROM part)"
AVG = "(rank() OVER (PARTITION BY s IS NULL ORDER BY s) + rank() OVER (PARTITION BY s IS NULL ORDER BY s) + count(*) OVER (PARTITION BY s) - 1) / 2.0"
LOW = "CAST(rank() OVER (PARTITION BY s IS NULL ORDER BY s) AS DOUBLE)"
_ranks = {
    "average": ({}, AVG, "NULL"), "min": ({"method": "min"}, LOW, "NULL"), "max": ({"method": "max"}, f"{LOW} + count(*) OVER (PARTITION BY s) - 1", "NULL"), "dense": ({"method": "dense"}, "CAST(dense_rank() OVER (PARTITION BY s IS NULL ORDER BY s) AS DOUBLE)", "NULL"),
    "pct": ({"pct": True}, f"round({AVG} / (SELECT count(s) FROM {RANKED}), 8)", "NULL"), "na_top": ({"na_option": "top"}, f"{AVG} + (SELECT count(*) - count(s) FROM {RANKED})", "1.0"), "na_bottom": ({"na_option": "bottom"}, AVG, f"(SELECT count(s) FROM {RANKED}) + 1.0"),
}
for _name, (_options, _value, _null) in _ranks.items():
    query(f"rank_{_name}", "part", f"SELECT r FROM (SELECT CASE WHEN s IS NULL THEN {_null} ELSE {_value} END AS r FROM {RANKED})")(
        lambda f, o=_options: rounded(holes(f, "p_size", "p_partkey % 10 = 0").select(["p_size"]).rename({"p_size": "r"}).rank(**o), "r", digits=8))
query("rank_first", "part", f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, CAST(row_number() OVER (ORDER BY p_size, p_partkey) AS DOUBLE) AS p_size FROM part")(lambda f: placed(f.sort_values("p_partkey").select(["p_size"]).rank(method="first")))
query("sample_seeded", "orders", """WITH RECURSIVE t AS (SELECT count(*) AS n FROM orders),
r AS (SELECT 0 AS i, (1664525 * 42 + 1013904223) % 4294967296 AS s, CAST([] AS BIGINT[]) AS k, CAST([] AS BIGINT[]) AS v, CAST(-1 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS j FROM t
  UNION ALL SELECT i + 1, (1664525 * s + 1013904223) % 4294967296, list_prepend(j, k), list_prepend(own, v), got, j FROM (
    SELECT *, coalesce(v[nullif(list_position(k, j), 0)], j) AS got, coalesce(v[nullif(list_position(k, i), 0)], i) AS own FROM (SELECT r.i, r.s, r.k, r.v, CAST(r.i + floor(r.s / 4294967296.0 * (n - r.i)) AS BIGINT) AS j FROM r, t WHERE r.i < 50)))
SELECT o.o_orderkey, CAST(r.i - 1 AS BIGINT) AS pos FROM r JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS at FROM orders) o ON o.at = r.p WHERE r.i > 0""")(lambda f: placed(f.sort_values("o_orderkey").select(["o_orderkey"]).sample(50, random_state=42)))
query("describe", "customer", "SELECT unnest(['count', 'mean', 'std', 'min', 'max']) AS stat, round(unnest([count(c_acctbal), avg(c_acctbal), stddev_samp(c_acctbal), min(c_acctbal), max(c_acctbal)]), 4) AS c_acctbal FROM customer")(lambda f: rounded(f.select(["c_acctbal"]).describe(), "c_acctbal"))


def one_row(f: Frame, values: dict) -> DataFrame:
    return f.sdf.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


query("nunique", "customer", "SELECT count(DISTINCT c_nationkey) AS c_nationkey, count(DISTINCT c_mktsegment) AS c_mktsegment FROM customer")(lambda f: one_row(f, f.select(["c_nationkey", "c_mktsegment"]).nunique()))
query("frame_sum", "customer", "SELECT round(sum(c_acctbal), 2) AS c_acctbal, CAST(sum(c_nationkey) AS DOUBLE) AS c_nationkey FROM customer")(lambda f: one_row(f, {k: round(v, 2) for k, v in f.select(["c_acctbal", "c_nationkey"]).sum().items()}))
query("frame_mean", "customer", "SELECT round(avg(c_acctbal), 4) AS c_acctbal FROM customer")(lambda f: one_row(f, {k: round(v, 4) for k, v in f.select(["c_acctbal"]).mean().items()}))
query("isin_list", "customer", "SELECT c_mktsegment IN ('BUILDING', 'MACHINERY') AS c_mktsegment, c_nationkey IN (1, 2) AS c_nationkey FROM customer")(lambda f: f.select(["c_mktsegment", "c_nationkey"]).isin(["BUILDING", "MACHINERY", 1, 2]))
query("isin_map", "customer", "SELECT c_mktsegment = 'BUILDING' AS c_mktsegment, false AS c_nationkey FROM customer")(lambda f: f.select(["c_mktsegment", "c_nationkey"]).isin({"c_mktsegment": ["BUILDING"]}))
query("clip", "customer", "SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS c_acctbal FROM customer")(lambda f: f.select(["c_custkey", "c_acctbal"]).clip(0, 5000, ["c_acctbal"]))
query("replace_scalar", "events", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type FROM events")(lambda f: f.select(["event_id", "event_type"]).replace("click", "tap"))
query("replace_array", "part", "SELECT p_partkey + 100000 AS p_partkey, CASE WHEN p_size IN (1, 2) THEN 0 ELSE p_size END AS p_size FROM part")(lambda f: f.assign({"p_partkey": F.col("p_partkey") + 100000}).select(["p_partkey", "p_size"]).replace([1, 2], 0))
query("replace_map", "customer", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS c_mktsegment FROM customer")(lambda f: f.select(["c_custkey", "c_mktsegment"]).replace({"BUILDING": "B", "MACHINERY": "M"}))
query("fillna", "part", f"SELECT p_partkey, coalesce(s, -1) AS p_size FROM {RANKED}")(lambda f: holes(f, "p_size", "p_partkey % 10 = 0").select(["p_partkey", "p_size"]).fillna({"p_size": -1}))
query("dropna", "part", f"SELECT p_partkey, s AS p_size FROM {RANKED} WHERE s IS NOT NULL")(lambda f: holes(f, "p_size", "p_partkey % 10 = 0").select(["p_partkey", "p_size"]).dropna())
query("astype_string", "part", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")(lambda f: f.select(["p_partkey", "p_size"]).astype("string"))
query("astype_number", "part", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN p_partkey / 4.0 WHEN 2 THEN NULL WHEN 3 THEN 31.0 ELSE p_partkey * 1000.0 END AS n FROM part")(
    lambda f: f.assign({"n": F.expr("CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat(' ', p_partkey / 4, ' ') WHEN 2 THEN concat(p_partkey, 'd') WHEN 3 THEN '0x1F' ELSE concat(p_partkey, 'e3') END")}).select(["p_partkey", "n"]).astype({"n": "number"}))
query("astype_boolean", "events", "SELECT event_id, user_id % 2 <> 0 AS b FROM events")(lambda f: f.assign({"b": F.when(F.col("user_id") % 2 == 0, F.lit("no")).otherwise(F.lit("Yes"))}).select(["event_id", "b"]).astype({"b": "boolean"}))
query("astype_date", "orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d FROM orders")(lambda f: f.assign({"d": F.date_format("o_orderdate", "yyyy-MM-dd")}).select(["o_orderkey", "d"]).astype({"d": "date"}))
query("apply_rows", "part", "SELECT p_size * p_retailprice AS value FROM part")(lambda f: f.apply(lambda r: r["p_size"] * r["p_retailprice"], axis=1, columnar=True).frame)
query("apply_columns", "part", "SELECT max(p_size) AS p_size, max(p_retailprice) AS p_retailprice FROM part")(lambda f: one_row(f, dict(zip(["p_size", "p_retailprice"], f.select(["p_size", "p_retailprice"]).apply("max").to_list(), strict=True))))
query("applymap", "customer", "SELECT upper(c_name) AS c_name, upper(c_mktsegment) AS c_mktsegment FROM customer")(lambda f: f.select(["c_name", "c_mktsegment"]).applymap(F.upper, columnar=True))
query("set_reset_index", "orders", "SELECT o_orderkey AS key, o_totalprice FROM orders")(lambda f: f.select(["o_orderkey", "o_totalprice"]).set_index("o_orderkey").reset_index("key"))
query("sort_index", "orders", "SELECT o_orderkey AS key, o_totalprice, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS pos FROM orders")(lambda f: placed(f.select(["o_orderkey", "o_totalprice"]).set_index("o_orderkey").sort_index(False).reset_index("key")))
query("iloc", "orders", "SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) JOIN (SELECT unnest([0, -1, 7, 70]) AS a, unnest([0, 1, 2, 3]) AS pos) ON p = CASE WHEN a < 0 THEN n + a ELSE a END")(lambda f: placed(f.sort_values(["o_totalprice", "o_orderkey"]).iloc([0, -1, 7, 70, 10**9]).select(["o_orderkey"])))
query("loc", "orders", "SELECT arg_min(o_orderkey, o_orderkey) AS o_orderkey, CASE o_custkey WHEN 7 THEN 0 ELSE 1 END AS pos FROM orders WHERE o_custkey IN (4, 7) GROUP BY o_custkey")(lambda f: placed(f.sort_values("o_orderkey").set_index("o_custkey").loc([7, -5, 4]).select(["o_orderkey"])))
query("tail", "orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 300)")(lambda f: placed(f.sort_values("o_orderkey").tail(300).select(["o_orderkey"])))
query("series_value_counts", "events", "SELECT event_type AS label, count(*) AS counts FROM events GROUP BY 1")(lambda f: f.get("event_type").value_counts().frame.rename({"event_type_counts": "counts"}).reset_index("label"))
# Construction, metadata and results on the driver

CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer"
PLAIN = ["c_custkey", "c_name", "c_acctbal"]
SORTED = "c_custkey bigint, c_name string, c_acctbal double, pos bigint"
customers = lambda f: f.sort_values("c_custkey").select(PLAIN)
whole = lambda f: f.assign({"c_custkey": F.col("c_custkey").cast("bigint")})  # noqa: E731  cells of the driver's lists are doubles
query("frame_constructor", "customer", CUSTOMERS)(lambda f: placed(whole(Frame.create(customers(f).to_dict("list"), index=list(range(f.shape[0]))))))
query("frame_from_records", "customer", CUSTOMERS)(lambda f: placed(whole(Frame.from_records(customers(f).to_records()))))
query("frame_from_dict", "customer", CUSTOMERS)(lambda f: placed(whole(Frame.from_dict(customers(f).to_dict("list")))))
query("frame_from_normalized", "customer", "SELECT c_name, c_custkey FROM customer")(lambda f: Frame.from_normalized(f.sdf.select("c_custkey", "c_name"), ["c_name", "c_custkey"]))
query("frame_columns_shape", "customer", "SELECT count(*) AS n, 5 AS width, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS names, count(*) = 0 AS is_empty, true AS none FROM customer")(
    lambda f: listed(f, [(*f.shape, ",".join(f.columns), f.empty, f.filter("false").empty)], "n bigint, width int, names string, is_empty boolean, none boolean"))
query("frame_index_labels", "customer", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS label FROM customer) WHERE c_custkey % 3 = 0")(lambda f: listed(f, [(v, i) for i, v in enumerate(f.sort_values("c_custkey").reset_index("old").drop("old").filter("c_custkey % 3 = 0").labels())], "label bigint, pos bigint"))
query("frame_copy", "customer", CUSTOMERS)(lambda f: placed(customers(f).copy()))
query("frame_values", "customer", CUSTOMERS)(lambda f: listed(f, [(*r, i) for i, r in enumerate(customers(f).values())], SORTED))
query("frame_dtypes", "orders", "SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_orderdate', 'b', 'none']) AS name, unnest(['number', 'string', 'date', 'boolean', 'unknown']) AS dtype")(
    lambda f: listed(f, list(f.assign({"b": F.col("o_orderkey") > 3, "none": F.lit(None).cast("string")}).select(["o_orderkey", "o_orderstatus", "o_orderdate", "b", "none"]).dtypes().items()), "name string, dtype string"))
query("frame_dtypes_mixed", "nation", "SELECT 'mixed' AS dtype FROM nation LIMIT 1")(lambda f: listed(f, [(Frame.create({"x": [*f.get("n_name").to_list(), *f.get("n_nationkey").to_list()]}).dtypes()["x"],)], "dtype string"))
query("frame_to_records", "customer", CUSTOMERS)(lambda f: listed(f, [(*r.values(), i) for i, r in enumerate(customers(f).to_records())], SORTED))
query("frame_to_dict", "customer", CUSTOMERS)(lambda f: listed(f, [(*r, i) for i, r in enumerate(zip(*customers(f).to_dict("list").values(), strict=True))], SORTED))
query("frame_to_string", "customer", "SELECT 11 AS n, '{\"c_custkey\": ' || min(c_custkey) || '}' AS head, '... (' || (count(*) - 10) || ' more rows)' AS tail FROM customer")(
    lambda f: listed(f, [(lambda x: (len(x), x[0], x[-1]))(f.sort_values("c_custkey").select(["c_custkey"]).to_string().split("\n"))], "n int, head string, tail string"))

# Projection, selection, labels

query("drop_columns", "customer", "SELECT c_custkey, c_acctbal FROM customer")(lambda f: f.drop(["c_name", "c_nationkey"]).drop("c_mktsegment"))
query("set_column", "customer", "SELECT c_custkey, c_acctbal * 2 AS c_acctbal, 7 AS k FROM customer")(lambda f: f.select(["c_custkey", "c_acctbal"]).set("c_acctbal", F.col("c_acctbal") * 2).set("k", 7))
query("assign_list", "supplier", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey) * 3 AS DOUBLE) AS v FROM supplier")(lambda f: f.sort_values("s_suppkey").select(["s_suppkey"]).assign({"v": [3.0 * (i + 1) for i in range(f.shape[0])]}))
query("assign_series", "customer supplier", "SELECT c_custkey, s_acctbal AS v FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")(lambda c, s: c.select(["c_custkey"]).set_index("c_custkey", drop=False).assign({"v": s.set_index("s_suppkey").get("s_acctbal")}))
query("filter_mask", "customer", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) WHERE p % 3 = 1")(lambda f: placed(f.sort_values("c_custkey").select(["c_custkey"]).filter([i % 3 == 1 for i in range(f.shape[0])])))
query("filter_callback", "orders", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE o_totalprice > 100000 AND p % 2 = 0 AND o_orderkey % 5 < 3")(
    lambda f: f.sort_values("o_orderkey").select(["o_orderkey", "o_totalprice"]).set_index("o_orderkey", drop=False).filter(lambda row, label, at: row["o_totalprice"] > 100000 and at % 2 == 0 and label % 5 < 3).select(["o_orderkey"]))
query("at_label", "orders", "SELECT arg_min(o_totalprice, o_orderkey) AS a, NULL AS b FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")(lambda f: (lambda g: listed(f, [(g.at(f.sdf.agg(F.min("o_custkey")).first()[0], "o_totalprice"), g.at(-1, "o_totalprice"))], "a double, b double"))(f.sort_values("o_orderkey").set_index("o_custkey")))
query("labels_after_filter", "orders", "SELECT p AS label, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p FROM orders) WHERE o_orderkey % 7 = 0")(lambda f: f.sort_values(["o_totalprice", "o_orderkey"]).reset_index("old").select(["o_orderkey"]).filter("o_orderkey % 7 = 0").reset_index("label"))
query("index_col", "customer", "SELECT c_custkey AS key, c_name FROM customer")(lambda f: read_parquet(written(f.select(["c_custkey", "c_name"]), "to_parquet"), index_col="c_custkey").reset_index("key").astype({"key": "number"}))

# Grouping, pivots, merging, order

query("groupby_as_index", "orders", "SELECT o_orderstatus AS label, round(sum(o_totalprice), 2) AS total, row_number() OVER (ORDER BY o_orderstatus) - 1 AS pos FROM orders GROUP BY 1")(lambda f: placed(rounded(f.groupby("o_orderstatus", as_index=True).agg({"o_totalprice": "sum"}).reset_index("label").rename({"o_totalprice": "total"}), "total", digits=2)))
query("groupby_agg_on_key", "orders", "SELECT count(o_orderstatus) AS o_orderstatus, max(o_totalprice) AS o_totalprice, row_number() OVER (ORDER BY orders.o_orderstatus) - 1 AS pos FROM orders GROUP BY orders.o_orderstatus")(lambda f: placed(f.groupby("o_orderstatus").agg({"o_orderstatus": "count", "o_totalprice": "max"})))
query("groupby_custom_rows", "orders", "SELECT o_orderstatus, round(max(o_totalprice) + min(o_custkey), 2) AS o_totalprice, count(*) AS o_orderkey FROM orders GROUP BY 1")(lambda f: rounded(f.groupby("o_orderstatus").agg({"o_totalprice": lambda v, rows: v.max() + rows["o_custkey"].min(), "o_orderkey": "count"}), "o_totalprice", digits=2))
query("groupby_first_seen", "orders", "SELECT o_orderpriority, n, row_number() OVER (ORDER BY first) - 1 AS pos FROM (SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1)")(lambda f: placed(f.sort_values("o_orderkey").groupby("o_orderpriority", sort=False).size().rename({"size": "n"})))
query("groupby_sorted_order", "customer", "SELECT c_mktsegment, c_nationkey, n, row_number() OVER (ORDER BY c_mktsegment, c_nationkey) - 1 AS pos FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2)")(lambda f: placed(f.groupby(["c_mktsegment", "c_nationkey"]).size().rename({"size": "n"})))
query("value_counts_first_seen_2col", "orders", "SELECT o_orderstatus, o_orderpriority, count, row_number() OVER (ORDER BY first) - 1 AS pos FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS count, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)")(lambda f: placed(f.sort_values("o_orderkey").value_counts(["o_orderstatus", "o_orderpriority"], sort=False)))
query("value_counts_order", "events", "SELECT user_id, count, row_number() OVER (ORDER BY count DESC, user_id) - 1 AS pos FROM (SELECT user_id, count(*) AS count FROM events GROUP BY 1)")(lambda f: placed(f.value_counts("user_id")))


def heads_of(f: Frame) -> DataFrame:
    """The heads' order as a column, besides the cells."""
    names = ",".join(f.columns[1:])
    return placed(f.assign({"heads": names}))


BY_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
FIRST = "(SELECT string_agg(l_returnflag, ',' ORDER BY first) FROM (SELECT l_returnflag, min((l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS first FROM lineitem GROUP BY 1))"

query("pivot_head_order", "lineitem", "SELECT l_linestatus, " + ", ".join(f"count(*) FILTER (l_returnflag = '{q}') AS {q}" for q in "ANR") + f", {FIRST} AS heads, row_number() OVER (ORDER BY min((l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice))) - 1 AS pos FROM lineitem GROUP BY 1")(lambda f: heads_of(f.sort_values(BY_ROW).pivot_table("l_linestatus", "l_quantity", columns="l_returnflag", aggfunc="count", sort=False)))
query("pivot_fill_value", "lineitem", "SELECT l_returnflag, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F' AND l_returnflag <> 'A'), CASE WHEN l_returnflag = 'A' THEN -1 END) AS F, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), -1) AS O FROM lineitem GROUP BY 1")(
    lambda f: f.filter("l_returnflag <> 'A' or l_linestatus <> 'F'").pivot_table("l_returnflag", "l_quantity", columns="l_linestatus", aggfunc="sum", fill_value=-1))
query("pivot_row_order", "customer", "SELECT c_nationkey, c_mktsegment, n, row_number() OVER (ORDER BY t, k, m) - 1 AS pos FROM (SELECT CASE WHEN grouping(c_nationkey) = 1 THEN 'All' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey, CASE WHEN grouping(c_nationkey) = 1 THEN '' ELSE c_mktsegment END AS c_mktsegment, count(*) AS n, grouping(c_nationkey) AS t, customer.c_nationkey AS k, customer.c_mktsegment AS m FROM customer GROUP BY GROUPING SETS ((customer.c_nationkey, customer.c_mktsegment), ()))")(
    lambda f: placed(f.pivot_table(["c_nationkey", "c_mktsegment"], "c_custkey", aggfunc="count", margins=True).rename({"c_custkey": "n"})))
query("pivot_custom", "orders", "SELECT o_orderstatus, " + ", ".join(f"round(max(o_totalprice) FILTER (o_orderpriority = '{q}') - min(o_totalprice) FILTER (o_orderpriority = '{q}'), 4) AS \"{q}\"" for q in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY 1")(
    lambda f: (lambda g: rounded(g, *g.columns[1:]))(f.pivot_table("o_orderstatus", "o_totalprice", columns="o_orderpriority", aggfunc=lambda v: v.max() - v.min())))
query("merge_order", "orders customer", "SELECT o_orderkey, c_name, row_number() OVER (ORDER BY o_orderkey, c_custkey) - 1 AS pos FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 0")(
    lambda o, c: placed(merge(o.sort_values("o_orderkey").rename({"o_custkey": "k"}).select(["o_orderkey", "k"]), c.filter("c_custkey % 2 = 0").rename({"c_custkey": "k"}).select(["k", "c_name"]), "k").select(["o_orderkey", "c_name"])))
query("sort_order_full", "orders", "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) - 1 AS pos FROM orders")(lambda f: placed(f.sort_values(["o_orderpriority", "o_totalprice", "o_orderkey"], [False, True, True]).select(["o_orderkey", "o_orderpriority"])))
query("concat_label_types", "customer supplier", "SELECT CAST(c_custkey AS VARCHAR) AS label, c_name AS name FROM customer UNION ALL SELECT s_name, s_name FROM supplier")(lambda c, s: concat([c.set_index("c_custkey").select(["c_name"]).rename({"c_name": "name"}), s.set_index("s_name", drop=False).select(["s_name"]).rename({"s_name": "name"})]).reset_index("label"))
query("concat_empty", "nation", "SELECT 0 AS n FROM nation LIMIT 1")(lambda f: listed(f, [(concat([]).shape[0],)], "n bigint"))


def refused(f: Frame, doing, what: str) -> DataFrame:
    """The error that an operation raises."""
    try:
        doing()
    except ValueError as e:
        return listed(f, [(type(e).__name__, what in str(e))], "error string, says boolean")
    return listed(f, [("none", False)], "error string, says boolean")


ERROR = "SELECT 'ValueError' AS error, true AS says FROM region LIMIT 1"
query("groupby_unknown_name_raises", "orders region", ERROR)(lambda f, _: refused(f, lambda: f.groupby("o_orderstatus").agg({"o_totalprice": "median"}), "median"))
query("merge_no_key_raises", "orders region", ERROR)(lambda f, _: refused(f, lambda: merge(f, f, []), "key"))
query("merge_unknown_how_raises", "orders region", ERROR)(lambda f, _: refused(f, lambda: merge(f, f, "o_orderkey", "anti"), "anti"))

# Callbacks

query("apply_rows_callback", "part", "SELECT CAST(p_size + p_partkey * 1000 + pos * 0.5 AS DOUBLE) AS value, pos FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part)")(lambda f: placed(rounded(f.sort_values("p_partkey").select(["p_partkey", "p_size"]).set_index("p_partkey").apply(lambda r, label, at: r["p_size"] + label * 1000 + at * 0.5, axis=1).frame, "value")))
query("apply_columns_callback", "part", "SELECT CAST(max(p_size) - min(p_size) AS DOUBLE) AS p_size, max(p_retailprice) - min(p_retailprice) + CAST(1 AS DOUBLE) AS p_retailprice FROM part")(lambda f: one_row(f, dict(zip(["p_size", "p_retailprice"], f.select(["p_size", "p_retailprice"]).apply(lambda v, name, at: v.max() - v.min() + at).to_list(), strict=True))))
query("applymap_callback", "part", "SELECT p_partkey, 'p_size:' || p_partkey || ':' || CAST(p_size AS VARCHAR) AS p_size FROM part")(
    lambda f: f.select(["p_partkey", "p_size"]).set_index("p_partkey").applymap(lambda v, name, label, at: f"{name}:{label}:{v}", returns="string").reset_index("p_partkey"))

# Series

series = lambda f, c="c_acctbal": f.sort_values("c_custkey").set_index("c_custkey", drop=False).get(c)
as_rows = lambda s: s.frame.reset_index("label")
SPARSE = "(SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer)"
sparse = lambda f: series(holes(f, "c_acctbal", "c_custkey % 4 = 0"))
query("series_basics", "customer", "SELECT c_acctbal AS v, c_custkey AS label, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, 'c_acctbal' AS name, count(*) OVER () AS n FROM customer")(
    lambda f: (lambda s, n: listed(f, ((v, k, i, s.name, n) for i, (v, k) in enumerate(zip(s.to_list(), s.index(), strict=True))), "v double, label bigint, pos bigint, name string, n bigint"))(series(f), len(series(f))))  # fmt: skip  a length is a job
query("series_to_dict", "customer", "SELECT c_nationkey AS label, arg_max(c_acctbal, c_custkey) AS v FROM customer GROUP BY 1")(lambda f: listed(f, list(f.sort_values("c_custkey").set_index("c_nationkey").get("c_acctbal").to_dict().items()), "label int, v double"))
query("series_iloc_loc", "customer", "SELECT arg_max(c_acctbal, c_custkey) AS last, arg_min(c_acctbal, c_custkey) AS first, max(c_acctbal) FILTER (c_custkey = 9) AS nine, NULL AS none FROM customer")(lambda f: (lambda s: listed(f, [(s.iloc(-1), s.iloc(0), s.loc(9), s.loc(-9))], "last double, first double, nine double, none double"))(series(f)))
query("series_head_tail", "customer", "SELECT * FROM (SELECT c_custkey AS label, c_acctbal, row_number() OVER (ORDER BY c_custkey) AS a, row_number() OVER (ORDER BY c_custkey DESC) AS b FROM customer) WHERE a <= 40 OR b <= 30".replace("SELECT * FROM", "SELECT label, c_acctbal FROM"))(lambda f: concat([as_rows(series(f).head(40)), as_rows(series(f).tail(30))]))
query("series_map", "customer", "SELECT c_custkey AS label, round(c_acctbal * 2 + c_custkey + row_number() OVER (ORDER BY c_custkey) - 1, 4) AS c_acctbal FROM customer")(lambda f: rounded(as_rows(series(f).map(lambda v, label, at: v * 2 + label + at)), "c_acctbal"))
query("series_apply_columnar", "customer", "SELECT c_custkey AS label, round(c_acctbal / 3, 4) AS c_acctbal FROM customer")(lambda f: rounded(as_rows(series(f).apply(lambda c: c / 3, columnar=True)), "c_acctbal"))
query("series_filter", "customer", "SELECT c_custkey AS label, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_custkey % 2 = 1")(lambda f: as_rows(series(f).filter(lambda v, label: v > 0 and label % 2 == 1)))
query("series_fillna", "customer", f"SELECT c_custkey AS label, coalesce(c_acctbal, -1) AS c_acctbal FROM {SPARSE}")(lambda f: as_rows(sparse(f).fillna(-1.0)))
query("series_dropna", "customer", f"SELECT c_custkey AS label, c_acctbal FROM {SPARSE} WHERE c_acctbal IS NOT NULL")(lambda f: as_rows(sparse(f).dropna()))
query("series_sum_mean_min_max", "customer", f"SELECT round(sum(c_acctbal), 2) AS s, round(avg(c_acctbal), 4) AS m, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM {SPARSE}")(lambda f: (lambda s: listed(f, [(round(s.sum(), 2), round(s.mean(), 4), s.min(), s.max())], "s double, m double, lo double, hi double"))(sparse(f)))
query("series_min_max_text", "customer", "SELECT min(c_mktsegment) AS lo, max(c_mktsegment) AS hi FROM customer")(lambda f: (lambda s: listed(f, [(s.min(), s.max())], "lo string, hi string"))(f.get("c_mktsegment")))
query("series_unique", "customer", "SELECT c_mktsegment AS v, row_number() OVER (ORDER BY first) - 1 AS pos FROM (SELECT c_mktsegment, min(c_custkey) AS first FROM customer GROUP BY 1)")(lambda f: listed(f, [(v, i) for i, v in enumerate(series(f, "c_mktsegment").unique())], "v string, pos bigint"))
query("series_astype", "customer", "SELECT c_custkey AS label, c_acctbal <> 0 AS c_acctbal FROM customer")(lambda f: as_rows(series(f).astype("boolean")))
query("series_isin", "customer", f"SELECT c_custkey AS label, c_acctbal IS NULL AS c_acctbal FROM {SPARSE}")(lambda f: as_rows(sparse(f).isin([None, "x"])))
query("series_clip", "customer", "SELECT c_custkey AS label, least(greatest(c_acctbal, 10), 900) AS c_acctbal FROM customer")(lambda f: as_rows(series(f).clip(10, 900)))
query("series_replace", "customer", "SELECT c_custkey AS label, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' ELSE c_mktsegment END AS c_mktsegment FROM customer")(lambda f: as_rows(series(f, "c_mktsegment").replace("BUILDING", "B")))

# Sources and sinks: files in the shared folder


def written(f: Frame, how: str, **options) -> str:
    path = fresh_path(f.sdf.sparkSession, how)
    getattr(f, how)(path, **options)
    return path


LINES = "SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, l_extendedprice, l_returnflag, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem"
lines = lambda f: f.sort_values(BY_ROW).select(["l_orderkey", "l_extendedprice", "l_returnflag"])
query("read_csv_lineitem", "lineitem", LINES)(lambda f: read_csv(written(Frame(placed(lines(f))), "to_csv", distributed=True)))
query("read_csv_ragged", "orders", "SELECT CAST(o_orderkey AS DOUBLE) AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'x' || chr(10) || 'y, z' ELSE 'p' END AS t, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS DOUBLE) END AS col_2 FROM orders")(
    lambda f: read_csv(lines_file(f, F.expr("concat(o_orderkey, if(o_orderkey % 2 = 0, ',\"x\\ny, z\"', ',p'), if(o_orderkey % 3 = 0, concat(',', o_custkey), ''))"), "k,t")))
query("read_table_orders", "orders", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderstatus FROM orders")(lambda f: read_table(written(f.select(["o_orderkey", "o_orderstatus"]), "to_csv", sep="\t", distributed=True)))
query("read_tsv_index_col", "orders", "SELECT CAST(o_orderkey AS DOUBLE) AS key, o_orderstatus FROM orders")(lambda f: read_tsv(written(f.select(["o_orderkey", "o_orderstatus"]), "to_csv", sep="\t", distributed=True), index_col="o_orderkey").reset_index("key"))
query("read_json_lines", "orders", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")(lambda f: read_json(written(holes(f, "o_orderstatus", "o_orderkey % 5 = 0").select(["o_orderkey", "o_orderstatus", "o_totalprice"]), "to_json", lines=True, distributed=True), lines=True))


def lines_file(f: Frame, line, header: str) -> str:
    """Text files of one line a row, below a header; one file, as a header stands in each."""
    path = fresh_path(f.sdf.sparkSession, "lines")
    head = f.sdf.sparkSession.createDataFrame([(header,)], "value string")
    head.union(f.sdf.select(line.alias("value"))).coalesce(1).write.text(path)
    return path


ARRAYS = "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderstatus FROM orders"
short = lambda f: f.select(["o_orderkey", "o_orderstatus"])
query("read_json_array", "orders", ARRAYS)(lambda f: read_json(written(short(f), "to_json", distributed=True)))
query("read_json_columns", "orders", ARRAYS)(lambda f: read_json(written(short(f), "to_json", orient="list", distributed=True)))
query("csv_roundtrip", "customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name FROM customer")(lambda f: parse_csv(f.select(["c_custkey", "c_name"]).to_csv()))
query("tsv_roundtrip", "customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name FROM customer")(lambda f: parse_tsv(f.select(["c_custkey", "c_name"]).to_csv(sep="\t")))
query("json_roundtrip", "customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name FROM customer")(lambda f: parse_json(f.select(["c_custkey", "c_name"]).to_json()))
query("jsonl_roundtrip", "customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name FROM customer")(lambda f: parse_json(f.select(["c_custkey", "c_name"]).to_json(lines=True), lines=True))


@query("excel_roundtrip", "customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, c_acctbal FROM customer")
def _excel(f: Frame) -> Frame:
    # the driver writes and reads the one file; rows are in the frame that it returns
    with tempfile.TemporaryDirectory() as d:
        f.select(PLAIN).to_excel(f"{d}/n.xlsx")
        return read_excel(f"{d}/n.xlsx")


query("parquet_roundtrip", "lineitem", "SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, l_returnflag FROM lineitem")(lambda f: read_parquet(written(f.select(["l_orderkey", "l_partkey", "l_returnflag"]), "to_parquet"), columns=["l_orderkey", "l_returnflag"]))


@query("stream_windows", "events", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(event_id) AS event_id, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _stream(f: Frame) -> DataFrame:
    """The table as a stream, all of it in one run; no row is late for so long a watermark."""
    spark = f.sdf.sparkSession
    source, out, log = (fresh_path(spark, what) for what in ("stream-in", "stream-out", "stream-log"))
    f.sdf.write.parquet(source)
    stream = spark.readStream.schema(f.sdf.schema).parquet(source)
    found = windowed(stream, "ts", "1 hour", "100 days", ["event_type"], {"event_id": "count", "value": "sum"})
    name = f"windows_{source.rsplit('-', 1)[1]}"
    found.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("start", "event_type", "event_id", F.round("value", 4).alias("value"))
