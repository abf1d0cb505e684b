"""Registered queries over the star schema: one for each operator, beside its SQL.

Sums of doubles are rounded on both sides; nulls are derived where the tables have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import coerce, text
from tessera.operators import aggregate as agg
from tessera.operators import joins, ordered, project, reshape, setops, sorting
from tessera.plans.schema import ColumnSpec, FieldSelector, TableSpec, conform

c = F.col
_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(fn):
        _FOUND[fn.__name__] = fn, sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _FOUND.items() if s}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def holed(df: DataFrame) -> DataFrame:
    """Events with a value missing on each third."""
    return df.withColumn("v", F.when(c("event_id") % 3 != 0, c("value")))


HOLED = "(SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)"


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
 round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2""")
def pricing_summary(spark, d):
    rows = project.keep(t(spark, d, "lineitem"), c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return agg.group_by(rows, "l_returnflag", "l_linestatus").agg(
        sum_qty=F.round(F.sum("l_quantity"), 2), revenue=F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2),
        avg_disc=F.round(F.avg("l_discount"), 4), n=F.count(F.lit(1)),
    ).orderBy("l_returnflag", "l_linestatus")


# projection, filters, predicates


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000")
def filter(spark, d):
    return project.keep(t(spark, d, "orders"), c("o_totalprice") > 150000).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_table(spark, d):
    return project.keep(t(spark, d, "part"), "p_size BETWEEN 10 AND 20").select("p_partkey", "p_name", "p_size")


@query(f"SELECT event_id, event_type, v FROM {HOLED} WHERE v IS NULL OR event_type IN ('click', 'view')")
def where_in(spark, d):
    rows = holed(t(spark, d, "events"))
    key = F.when(c("v").isNull(), F.lit(None)).otherwise(c("event_type"))
    return project.where_in(rows, key, ["click", "view", None]).select("event_id", "event_type", "v")


@query(f"SELECT event_id FROM {HOLED} WHERE NOT coalesce(v > 50, false)")
def reject(spark, d):
    return project.reject(holed(t(spark, d, "events")), c("v") > 50).select("event_id")


@query(f"SELECT event_id, v FROM {HOLED} WHERE v IS NOT NULL")
def drop_null(spark, d):
    return project.drop_null(holed(t(spark, d, "events")), "v").select("event_id", "v")


@query("SELECT l_orderkey AS k, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def map(spark, d):  # noqa: A001
    return project.map_rows(t(spark, d, "lineitem"), k=c("l_orderkey"), net=F.round(c("l_extendedprice") * (1 - c("l_discount")), 4))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey FROM orders")
def map_indexed(spark, d):
    return project.map_indexed(t(spark, d, "orders"), "o_orderkey", lambda i: {"idx": i, "o_orderkey": c("o_orderkey")})


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def flat_map(spark, d):
    return project.flat_map(t(spark, d, "part"), F.split("p_name", " "), "word", ["p_partkey"])


@query("SELECT c_custkey, c_name FROM customer")
def select(spark, d):
    return project.select_columns(t(spark, d, "customer"), "c_custkey", "c_name")


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def drop_column(spark, d):
    return project.drop_columns(t(spark, d, "customer"), "c_acctbal", "not_there")


@query("SELECT r_regionkey AS region_id, r_name FROM region")
def rename_column(spark, d):
    return project.rename_column(t(spark, d, "region"), "r_regionkey", "region_id")


@query("SELECT *, s_acctbal > 0 AS solvent FROM supplier")
def add_column(spark, d):
    return project.add_column(t(spark, d, "supplier"), "solvent", c("s_acctbal") > 0)


@query("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation")
def map_rows(spark, d):
    return project.replace_columns(t(spark, d, "nation"), n_name=F.upper("n_name"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def index_by(spark, d):
    return project.index_by(t(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def field_selector(spark, d):
    df = t(spark, d, "customer")
    names = FieldSelector(TableSpec.of(df.schema)).fields("c_mktsegment", "c_custkey", "c_name").exclude("c_name").order_by_name().names()
    return df.select(*names)


@query("""SELECT bool_or(o_totalprice > 400000) AS "any", bool_and(o_totalprice > 0) AS "all", count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders""")
def any_all_count_if(spark, d):
    df = t(spark, d, "orders")
    a, b, n = project.any_of(df, c("o_totalprice") > 400000), project.all_of(df, c("o_totalprice") > 0), project.count_if(df, c("o_orderstatus") == "F", "n")
    return a.join(b).join(n)


@query("SELECT min(event_id) AS first_id, max(event_id) AS last_id FROM events")
def first_last(spark, d):
    df = t(spark, d, "events")
    a = project.first_row(df, "event_id").select(c("event_id").alias("first_id"))
    return a.join(project.last_row(df, "event_id").select(c("event_id").alias("last_id")))


@query("""SELECT c_custkey AS id, c_name AS name, CAST(c_acctbal AS BIGINT) AS whole, 'none' AS note FROM (SELECT c_custkey, c_name, trunc(c_acctbal) AS c_acctbal FROM customer)""")
def to_dataset(spark, d):
    spec = TableSpec([ColumnSpec("id", "bigint", "c_custkey"), ColumnSpec("name", "string", "c_name"), ColumnSpec("whole", "bigint", "c_acctbal"), ColumnSpec("note", default="none")])
    return conform(t(spark, d, "customer"), spec)


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(spark, d):
    return joins.inner_join(t(spark, d, "orders"), t(spark, d, "customer"), "o_custkey", "c_custkey", lambda a, b: {"o_orderkey": a["o_orderkey"], "c_name": b["c_name"]})


@query("SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS has_right FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang")
    return joins.left_join(docs, t(spark, d, "labels"), "doc_id", "doc_id", lambda a, b: {"doc_id": a["doc_id"], "quality": b["quality"], "has_right": b.isNotNull()})


@query("SELECT d.doc_id AS left_id, l.doc_id AS right_id FROM (SELECT * FROM documents WHERE lang = 'en') d RIGHT JOIN labels l ON d.doc_id = l.doc_id")
def right_join(spark, d):
    docs = t(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    return joins.right_join(docs, t(spark, d, "labels"), "doc_id", "doc_id", lambda a, b: {"left_id": a["doc_id"], "right_id": b["doc_id"]})


@query("""SELECT o_orderkey, l_orderkey, l_linenumber FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') o
 FULL JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1) l ON o_orderkey = l_orderkey""")
def full_join(spark, d):
    a, b = t(spark, d, "orders").filter("o_orderstatus = 'F'"), t(spark, d, "lineitem").filter("l_linenumber = 1")
    return joins.full_join(a, b, "o_orderkey", "l_orderkey", lambda x, y: {"o_orderkey": x["o_orderkey"], "l_orderkey": y["l_orderkey"], "l_linenumber": y["l_linenumber"]})


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(spark, d):
    return joins.cross_join(t(spark, d, "region"), t(spark, d, "nation")).select("left.r_name", "right.n_name")


_A = "(SELECT DISTINCT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 7 END AS a, event_type AS b FROM events)"


def _keys(df):
    return df.select(F.when(c("user_id") % 5 != 0, c("user_id") % 7).alias("a"), c("event_type").alias("b")).distinct()


@query(f"SELECT x.a, x.b, y.n FROM {_A} x JOIN (SELECT a, b, count(*) AS n FROM (SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 7 END AS a, event_type AS b FROM events) GROUP BY 1, 2) y ON x.a IS NOT DISTINCT FROM y.a AND x.b = y.b")
def join_multi(spark, d):
    events = t(spark, d, "events")
    right = events.select(F.when(c("user_id") % 5 != 0, c("user_id") % 7).alias("a"), c("event_type").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return joins.join_multi(_keys(events), right, ["a", "b"], ["a", "b"], "inner", lambda x, y: {"a": x["a"], "b": x["b"], "n": y["n"]})


@query(f"SELECT x.a, x.b, y.b AS other FROM {_A} x LEFT JOIN (SELECT * FROM {_A} WHERE a < 3 OR a IS NULL) y ON x.a IS NOT DISTINCT FROM y.a AND x.b = y.b")
def join_2(spark, d):
    keys = _keys(t(spark, d, "events"))
    return joins.join_multi(keys, keys.filter("a < 3 OR a IS NULL"), joins.on("a", "b"), joins.on("a", "b"), "left", lambda x, y: {"a": x["a"], "b": x["b"], "other": y["b"]})


@query("SELECT a.c_custkey, b.s_suppkey FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey AND a.c_custkey % 10 = b.s_suppkey % 10 AND a.c_custkey % 3 = b.s_suppkey % 3")
def join_3(spark, d):
    lk = joins.on("c_nationkey", c("c_custkey") % 10, c("c_custkey") % 3)
    rk = joins.on("s_nationkey", c("s_suppkey") % 10, c("s_suppkey") % 3)
    return joins.join_multi(t(spark, d, "customer"), t(spark, d, "supplier"), lk, rk, "inner", lambda a, b: {"c_custkey": a["c_custkey"], "s_suppkey": b["s_suppkey"]})


@query(f"SELECT x.a AS la, y.a AS ra, coalesce(x.b, y.b) AS b FROM (SELECT * FROM {_A} WHERE a IS NULL OR a < 4) x FULL JOIN (SELECT * FROM {_A} WHERE a IS NULL OR a > 2) y ON x.a IS NOT DISTINCT FROM y.a AND x.b = y.b")
def join_on(spark, d):
    keys = _keys(t(spark, d, "events"))
    left, right = keys.filter("a IS NULL OR a < 4"), keys.filter("a IS NULL OR a > 2")
    return joins.join_multi(left, right, joins.on("a", "b"), joins.on("a", "b"), "full", lambda x, y: {"la": x["a"], "ra": y["a"], "b": F.coalesce(x["b"], y["b"])})


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS hit, d.n_chars * 2 AS twice FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def pair_ops(spark, d):
    pairs = joins.pairs(t(spark, d, "documents").select("doc_id", "n_chars"), t(spark, d, "labels"), "doc_id", "doc_id", "left")
    pairs = joins.map_left(pairs, lambda a: F.struct(a["doc_id"].alias("doc_id"), (a["n_chars"] * 2).alias("twice")))
    return pairs.select("left.doc_id", joins.has_right("right").alias("hit"), "left.twice")


@query("SELECT concat('(', o_orderstatus, ', ', o_orderpriority, ')') AS key, count(*) AS n FROM orders GROUP BY 1")
def key_ops(spark, d):
    key = joins.composite("o_orderstatus", "o_orderpriority")
    return t(spark, d, "orders").groupBy(joins.key_text(key, 2).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0)")
def anti_join(spark, d):
    some = project.keep(t(spark, d, "orders"), c("o_custkey") % 3 == 0)
    return joins.semi_join(t(spark, d, "customer"), some, "c_custkey", "o_custkey", anti=True).select("c_custkey")


# aggregation


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS si, CAST(sum(l_orderkey) AS BIGINT) AS sl, round(sum(l_quantity), 2) AS sd FROM lineitem")
def sums(spark, d):
    return t(spark, d, "lineitem").agg(agg.sum_of("l_linenumber").alias("si"), agg.sum_of("l_orderkey").alias("sl"), F.round(agg.sum_of("l_quantity"), 2).alias("sd"))


@query("SELECT 0 AS s, CAST(NULL AS DOUBLE) AS m")
def sum_empty(spark, d):
    return t(spark, d, "part").filter("p_size < 0").agg(agg.sum_of("p_size").cast("int").alias("s"), agg.mean_of("p_size").alias("m"))


@query("SELECT round(avg(p_size), 6) AS mean, max(p_size) AS top, min(p_size) AS low, max(p_retailprice) AS dear FROM part")
def mean_max_min(spark, d):
    return t(spark, d, "part").agg(F.round(agg.mean_of("p_size"), 6).alias("mean"), agg.max_of("p_size").alias("top"), agg.min_of("p_size").alias("low"), agg.max_of("p_retailprice").alias("dear"))


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 1")
def max_by(spark, d):
    return agg.max_by(t(spark, d, "part"), "p_size", "p_partkey").select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 1")
def min_by(spark, d):
    return agg.min_by(t(spark, d, "part"), "p_size", "p_partkey").select("p_partkey", "p_size")


@query("SELECT count(p_size) AS count, CAST(sum(p_size) AS BIGINT) AS sum, min(p_size) AS min, avg(p_size) AS avg, max(p_size) AS max FROM part")
def stats(spark, d):
    return agg.stats(t(spark, d, "part"), "p_size")


@query(f"SELECT (SELECT count(*) FROM (SELECT DISTINCT v FROM {HOLED})) AS one, (SELECT count(*) FROM (SELECT DISTINCT event_type, v IS NULL, CASE WHEN v IS NULL THEN NULL ELSE user_id END FROM {HOLED})) AS several")
def count_distinct(spark, d):
    rows = holed(t(spark, d, "events"))
    return rows.agg(agg.distinct_of("v").alias("one"), agg.distinct_of("event_type", c("v").isNull(), F.when(c("v").isNotNull(), c("user_id"))).alias("several"))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def value_counts(spark, d):
    return agg.value_counts(t(spark, d, "events"), "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def n_largest(spark, d):
    return agg.n_largest(t(spark, d, "orders"), 25, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def n_smallest(spark, d):
    return agg.n_smallest(t(spark, d, "orders"), 25, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2")
def group_by(spark, d):
    return agg.group_by(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority").counts()


@query("SELECT p_brand, round(avg(p_size), 6) AS mean, CAST(sum(p_size) AS BIGINT) AS sum, max(p_size) AS max, min(p_size) AS min FROM part GROUP BY 1")
def grp_aggregates(spark, d):
    return agg.group_by(t(spark, d, "part"), "p_brand").agg(mean=F.round(agg.mean_of("p_size"), 6), sum=agg.sum_of("p_size"), max=agg.max_of("p_size"), min=agg.min_of("p_size"))


@query(f'SELECT event_type, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS "distinct" FROM {HOLED} GROUP BY 1')
def grp_count_distinct(spark, d):
    return agg.group_by(holed(t(spark, d, "events")), "event_type").count_distinct("v")


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def grp_aggregate(spark, d):
    return agg.group_by(t(spark, d, "lineitem"), "l_suppkey").agg(n=F.count(F.lit(1)), total=F.round(F.sum("l_extendedprice"), 2))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def grp_top(spark, d):
    return agg.group_by(t(spark, d, "orders"), "o_custkey").top(2, c("o_totalprice").desc(), c("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT p_partkey, max(p_size) OVER (PARTITION BY p_brand) AS top FROM part")
def grp_transform(spark, d):
    return agg.group_by(t(spark, d, "part"), "p_brand").transform(top=F.max("p_size")).select("p_partkey", "top")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def grp_access(spark, d):
    return agg.group_by(t(spark, d, "customer"), "c_mktsegment").get("BUILDING").select("c_custkey")


# order


@query("SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS cum_sum FROM events")
def cum_sum(spark, d):
    return ordered.cum_sum(t(spark, d, "events"), "user_id", "event_id").select("event_id", "cum_sum")


@query("SELECT event_id, round(CASE WHEN count(*) OVER w >= 3 THEN avg(value) OVER w END, 6) AS mean FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_mean(spark, d):
    return ordered.rolling_mean(t(spark, d, "events"), "value", 3, "event_id", "m").select("event_id", F.round("m", 6).alias("mean"))


@query("SELECT event_id, lag(value, 2) OVER (ORDER BY event_id) AS shifted FROM events")
def shift(spark, d):
    return ordered.shift(t(spark, d, "events"), "value", 2, "event_id").select("event_id", "shifted")


@query("SELECT user_id, event_id, lead(event_type, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS following FROM events")
def shift_ahead(spark, d):
    return ordered.shift(t(spark, d, "events"), "event_type", -1, "event_id", "following", ["user_id"]).select("user_id", "event_id", "following")


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM {HOLED}")
def forward_fill(spark, d):
    return ordered.forward_fill(holed(t(spark, d, "events")), "v", "event_id").select("event_id", "v")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
def sort_by(spark, d):
    return sorting.sort_by(t(spark, d, "supplier"), "s_acctbal", "s_suppkey").select("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def sort_by_desc(spark, d):
    return sorting.sort_by_desc(t(spark, d, "supplier"), "s_acctbal", "s_suppkey").select("s_suppkey", "s_acctbal")


@query(f"SELECT event_id, v FROM {HOLED} ORDER BY v ASC NULLS LAST, event_id")
def table_sort(spark, d):
    return sorting.sort_table(holed(t(spark, d, "events")), "v", "event_id").select("event_id", "v")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 10")
def head(spark, d):
    return sorting.head(t(spark, d, "events"), 10, ["ts", "event_id"]).select("event_id")


@query("SELECT event_id FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 10) ORDER BY 1")
def tail(spark, d):
    return sorting.tail(t(spark, d, "events"), 10, "event_id").select("event_id")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def slice(spark, d):  # noqa: A001
    return sorting.slice_rows(t(spark, d, "orders"), 100, 150, "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def slice_deep(spark, d):
    return sorting.slice_deep(t(spark, d, "orders"), 1000, 1500, "o_orderkey").select("o_orderkey")


# sets and shape


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def concat(spark, d):
    return setops.concat(t(spark, d, "nation").select(c("n_name").alias("name")), t(spark, d, "region").select(c("r_name").alias("name")))


@query("SELECT n_nationkey, n_name, n_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_regionkey, r_name FROM region")
def table_concat(spark, d):
    return setops.concat_tables(t(spark, d, "nation"), t(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct(spark, d):
    return setops.distinct(t(spark, d, "events").select("event_type", "user_id"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def distinct_by(spark, d):
    return setops.distinct_by(t(spark, d, "orders"), "o_custkey", order="o_orderkey").select("o_custkey", "o_orderkey")


@query(f"SELECT DISTINCT event_type, v IS NULL AS blank FROM {HOLED}")
def table_distinct(spark, d):
    return setops.distinct(holed(t(spark, d, "events")).select("event_type", c("v").isNull().alias("blank")))


@query("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def melt(spark, d):
    return reshape.melt(t(spark, d, "part").withColumn("p_size", c("p_size").cast("double")), ["p_partkey"], ["p_size", "p_retailprice"])


_P = "(SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '' ELSE p_name END AS tags FROM part)"


@query(f"SELECT p_partkey, NULL AS tags FROM {_P} WHERE tags IS NULL UNION ALL SELECT p_partkey, unnest(string_split(tags, ' ')) FROM {_P} WHERE tags <> ''")
def explode(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.when(c("p_partkey") % 4 == 0, F.lit(None)).when(c("p_partkey") % 4 == 1, F.lit("")).otherwise(c("p_name")).alias("tags"))
    return reshape.explode(rows, "tags", lambda x: F.filter(F.split(x, " "), lambda w: w != ""))


# coercion, parsing, formatting

_S = "(SELECT event_id, CASE event_id % 6 WHEN 0 THEN '12' WHEN 1 THEN ' 3.7 ' WHEN 2 THEN 'yes' WHEN 3 THEN 'No' WHEN 4 THEN 'x' ELSE '-8' END AS s FROM events)"


def _texts(spark, d):
    words = ["12", " 3.7 ", "yes", "No", "x", "-8"]
    s = F.get(F.array(*(F.lit(w) for w in words)), (c("event_id") % 6).cast("int"))
    return t(spark, d, "events").select("event_id", s.alias("s"))


@query(f"""SELECT event_id, TRY_CAST(trunc(TRY_CAST(trim(s) AS DOUBLE)) AS INT) AS i, TRY_CAST(trim(s) AS DOUBLE) AS f,
 CASE WHEN lower(trim(s)) IN ('true','1','yes') THEN true WHEN lower(trim(s)) IN ('false','0','no') THEN false END AS b FROM {_S}""")
def cast_values(spark, d):
    return _texts(spark, d).select("event_id", coerce.as_int(c("s")).alias("i"), coerce.as_double(c("s")).alias("f"), coerce.as_boolean(c("s")).alias("b"))


@query(f"SELECT event_id, coalesce(TRY_CAST(CASE WHEN trim(s) = '' THEN NULL ELSE trim(s) END AS DOUBLE), NULL) AS n, lower(trim(s)) = 'true' AS b FROM {_S}")
def parse_value(spark, d):
    return _texts(spark, d).select("event_id", text.parse_value(c("s"), "double").alias("n"), text.parse_value(c("s"), "boolean").alias("b"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def parse_date(spark, d):
    o = c("o_orderdate")
    shown = F.when(c("o_orderkey") % 3 == 0, F.date_format(o, "yyyy-MM-dd")).when(c("o_orderkey") % 3 == 1, F.date_format(o, "MM/dd/yyyy")).otherwise(F.date_format(o, "dd-MMM-yyyy"))
    return t(spark, d, "orders").select("o_orderkey", text.parse_date(shown, "yyyy-MM-dd", ["MM/dd/yyyy", "dd-MMM-yyyy"]).alias("d"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def parse_datetime(spark, d):
    shown = F.when(c("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return t(spark, d, "events").select("event_id", text.parse_datetime(shown).alias("at"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def strip_timezone(spark, d):
    shown = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(c("event_id") % 2 == 0, F.lit("Z")).otherwise(F.lit("+02:00[Europe/Paris]")))
    return t(spark, d, "events").select("event_id", text.strip_timezone(shown).alias("at"))


@query("SELECT event_id, date_trunc('second', ts) - INTERVAL 2 HOUR AS at, '+02:00' AS zone FROM events")
def parse_zoned(spark, d):
    shown = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return t(spark, d, "events").select("event_id", F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.parse_zoned(shown, "yyyy-MM-dd'T'HH:mm:ssXXX").cast("timestamp_ntz")).alias("at"), text.zone_of(shown).alias("zone"))


@query(f"SELECT event_id, coalesce(strftime(ts, '%d/%m/%Y'), '') AS day, CASE WHEN v IS NULL THEN '' ELSE substr(event_type, 1, 3) END AS cut FROM {HOLED}")
def format_value(spark, d):
    rows = holed(t(spark, d, "events"))
    cut = F.when(c("v").isNotNull(), c("event_type"))
    return rows.select("event_id", text.format_value(c("ts"), "timestamp_ntz", date_pattern="dd/MM/yyyy").alias("day"), text.format_value(cut, "string", max_length=3).alias("cut"))


@query("SELECT p_partkey, format('{:,}', p_size * 1000) AS n FROM part")
def format_number(spark, d):
    return t(spark, d, "part").select("p_partkey", text.format_number(c("p_size") * 1000, "#,##0").alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS shown FROM orders")
def format_date(spark, d):
    return t(spark, d, "orders").select("o_orderkey", text.write_as_string(c("o_orderdate"), "timestamp_ntz", date_pattern="yyyy/MM/dd").alias("shown"))


# sources


@query("SELECT p_partkey, p_name, p_size FROM part")
def src_parquet(spark, d):
    from tessera.sources import parquet

    spec = TableSpec([ColumnSpec("p_partkey", "bigint"), ColumnSpec("p_name"), ColumnSpec("p_size", "int")])
    return parquet.read(spark, f"{d}/part.parquet", spec)


@query("SELECT r_regionkey, r_name, 7 AS missing FROM region")
def src_parquet_opts(spark, d):
    from tessera.sources import parquet

    spec = TableSpec([ColumnSpec("r_regionkey", "int"), ColumnSpec("r_name"), ColumnSpec("missing", "int")])
    return parquet.read(spark, f"{d}/region.parquet", spec, type_defaults={"int": 7}, max_size=1 << 30)


@query("SELECT 'a' AS k, CAST(1.5 AS DOUBLE) AS v UNION ALL SELECT 'b', 2.0 UNION ALL SELECT NULL, NULL")
def src_table_builder(spark, d):
    from tessera.sources.literal import TableBuilder

    return TableBuilder("k", "v").row("a", 1.5).row("b", 2).row(None, None).build(spark)


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def src_csv(spark, d):
    """Written as CSV and read back by a specification."""
    from tessera.sources import csv, scratch

    spec = TableSpec([ColumnSpec("p_partkey", "bigint", "Part Key"), ColumnSpec("p_name", "string", "Name"), ColumnSpec("p_size", "int"), ColumnSpec("p_retailprice", "double", "Price")])
    csv.write(t(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path := scratch.folder(spark, "csv"), spec)
    return csv.read(spark, path, spec, escape='"')


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def snk_parquet(spark, d):
    """Written with a codec and field selection, and read back."""
    from tessera.sources import parquet, scratch

    df = t(spark, d, "customer")
    chosen = FieldSelector(TableSpec.of(df.schema)).fields("c_custkey", "c_name", "c_acctbal")
    parquet.write(df, path := scratch.folder(spark, "parquet"), select=chosen, compression="ZSTD")
    return parquet.read_table(spark, path)


@query("SELECT event_id - min(event_id) OVER () AS row, 'n' AS field, 1 AS \"column\", 'x' || event_id AS value FROM events WHERE event_id % 50 = 0")
def io_error(spark, d):
    """Cells that can't be read, with their places."""
    from tessera.plans.schema import quarantine

    raw = t(spark, d, "events").select("event_id", F.when(c("event_id") % 50 == 0, F.concat(F.lit("x"), c("event_id").cast("string"))).otherwise(F.lit("7")).alias("n"))
    return quarantine(raw, TableSpec([ColumnSpec("event_id", "bigint"), ColumnSpec("n", "int")]), "event_id")


from tessera.plans import source_queries  # noqa: E402, F401  (registers its queries)
