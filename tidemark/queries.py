"""Driver queries of the engine's operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .database import Database
from .functions import jsonb, jsonpath
from .plans import nodes
from .plans.expr import Raw, call, col, lit
from .schema import TableBuilder
from .sources.store import read_table
from .streaming import zset

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Register a function of a database that holds the named tables."""

    def add(f):
        def run(spark, sf_dir):
            db = Database(spark)
            for t in tables:
                db.register_table(read_table(spark, sf_dir, t), t)
            out = f(db)
            return out if hasattr(out, "schema") and not hasattr(out, "plan") else out.frame()

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- scans and projections
@query("SELECT * FROM region", "region")
def scan_region(db):
    return db.select("*").from_("region")


@query("SELECT n_name, n_regionkey FROM nation", "nation")
def project_columns(db):
    return db.select("n_name", "n_regionkey").from_("nation")


@query('SELECT a.n_name AS "a.n_name", b.n_name AS "b.n_name", a.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey', "nation")
def project_rename_collision(db):
    return db.select("a.n_name", "b.n_name", "a.n_nationkey").from_("nation as a").inner_join("nation as b", col("a.n_regionkey").eq(col("b.n_nationkey")))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem", "lineitem")
def project_computed(db):
    revenue = col("l_extendedprice") * (lit(1.0) - col("l_discount"))
    return db.select("l_orderkey", "l_linenumber", (revenue, "revenue")).from_("lineitem")


@query("SELECT * FROM orders WHERE o_orderkey = 7", "orders")
def point_get(db):
    return db.select("*").from_("orders").where(col("o_orderkey").eq(7))


@query("SELECT * FROM orders WHERE o_orderkey IN (1, 5, 9, 11, 99999999)", "orders")
def multi_get(db):
    return db.select("*").from_("orders").where(col("o_orderkey").in_([1, 5, 9, 11, 99999999]))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500 AND o_custkey > 20", "orders")
def range_scan_composite(db):
    return db.select("o_orderkey", "o_custkey", "o_totalprice").from_("orders").where(col("o_orderkey").gte(100)).where(col("o_orderkey").lt(500)).where(col("o_custkey").gt(20))


@query("SELECT * FROM region WHERE false", "region")
def empty_relation(db):
    plan = db.select("*").from_("region").plan()
    return nodes.Empty(tuple(plan.scope.fields)).frame({})


# ---- predicates
def filtered(name: str, table: str, columns: str, test, where: str):
    def f(db):
        return db.select(*columns.split(", ")).from_(table).where(test)

    f.__name__ = name
    query(f"SELECT {columns} FROM {table} WHERE {where}", table)(f)


filtered("filter_eq_ne", "orders", "o_orderkey, o_orderstatus, o_orderpriority", col("o_orderstatus").eq("F") & col("o_orderpriority").ne("1-URGENT"), "o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'")
filtered("filter_range", "lineitem", "l_orderkey, l_linenumber, l_quantity", col("l_quantity").gt(45) & col("l_discount").lte(0.03), "l_quantity > 45 AND l_discount <= 0.03")
filtered("filter_between", "orders", "o_orderkey, o_totalprice", col("o_totalprice").between(1000, 50000), "o_totalprice BETWEEN 1000 AND 50000")
filtered("filter_not_between", "orders", "o_orderkey, o_totalprice", col("o_totalprice").not_between(1000, 400000), "o_totalprice NOT BETWEEN 1000 AND 400000")
filtered("filter_in", "customer", "c_custkey, c_mktsegment", col("c_mktsegment").in_(["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
filtered("filter_not_in", "customer", "c_custkey, c_mktsegment", col("c_mktsegment").not_in(["BUILDING", "MACHINERY"]), "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
filtered("filter_like", "part", "p_partkey, p_name", col("p_name").like("_ed%g_t"), "p_name LIKE '_ed%g_t'")
filtered("filter_not_like", "part", "p_partkey, p_name", col("p_name").not_like("%d _o%"), "p_name NOT LIKE '%d _o%'")
filtered("filter_regex", "customer", "c_custkey, c_name", col("c_name").match("[0-4]+7$"), "regexp_matches(c_name, '[0-4]+7$')")
filtered("filter_not_regex", "customer", "c_custkey, c_name", col("c_name").not_match("(1|2).*3"), "NOT regexp_matches(c_name, '(1|2).*3')")
filtered("filter_and_or_not", "orders", "o_orderkey, o_custkey, o_totalprice", (col("o_totalprice").gt(200000) | col("o_custkey").lt(50)) & ~col("o_orderstatus").eq("O"), "(o_totalprice > 200000 OR o_custkey < 50) AND NOT o_orderstatus = 'O'")
filtered("filter_datetime_range", "orders", "o_orderkey, o_orderdate", col("o_orderdate").gte("1995-01-01") & col("o_orderdate").lt("1996-01-01"), "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
filtered("filter_col_vs_col", "lineitem", "l_orderkey, l_linenumber, l_tax, l_discount", col("l_tax").gt(col("l_discount")), "l_tax > l_discount")

#: Every third value NULL, so that two- and three-valued predicates differ.
SPARSE = "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value, CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind FROM events"


def sparse(name: str, test, where: str):
    def f(db):
        events = db.table("events")
        rows = events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind"))
        db.register_table(rows, "sparse")
        return db.select("*").from_("sparse").where(test)

    f.__name__ = name
    query(f"SELECT * FROM ({SPARSE}) WHERE {where}", "events")(f)


sparse("filter_is_null", col("value").is_null(), "value IS NULL")
sparse("filter_is_not_null", col("value").is_not_null() & col("kind").is_not_null(), "value IS NOT NULL AND kind IS NOT NULL")
sparse("null_comparison_three_valued", ~col("value").gt(50), "NOT value > 50")
sparse("null_between_two_valued", ~col("value").between(10, 90), "value IS NULL OR value NOT BETWEEN 10 AND 90")
sparse("null_in_two_valued", col("kind").not_in(["click", "view"]), "kind IS NULL OR kind NOT IN ('click', 'view')")
sparse("null_in_null_element", col("kind").in_(["click", None]), "kind IS NULL OR kind = 'click'")
sparse("null_like_two_valued", col("kind").not_like("%i%") | col("value").gt(95), "coalesce(kind NOT LIKE '%i%', true) OR value > 95")
sparse("null_regex_two_valued", col("kind").not_match("c.+k"), "coalesce(NOT regexp_matches(kind, 'c.+k'), true)")


# ---- joins
ORDERS_CUSTOMER = "orders o JOIN customer c ON o.o_custkey = c.c_custkey"


@query(f"SELECT o_orderkey, c_name FROM {ORDERS_CUSTOMER}", "orders", "customer")
def join_inner(db):
    return db.select("o_orderkey", "c_name").from_("orders").inner_join("customer", col("o_custkey").eq(col("c_custkey")))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "orders", "customer")
def join_left(db):
    return db.select("c_custkey", "o_orderkey", "o_totalprice").from_("customer").left_join("orders", col("c_custkey").eq(col("o_custkey")))


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey", "orders", "customer")
def join_right(db):
    return db.select("o_orderkey", "c_custkey").from_("orders").right_join("customer", col("o_custkey").eq(col("c_custkey")))


@query("SELECT p_partkey, n_name FROM part FULL JOIN nation ON p_size = n_nationkey", "part", "nation")
def join_full(db):
    """Sizes and nation keys miss each other on both sides."""
    return db.select("p_partkey", "n_name").from_("part").full_join("nation", col("p_size").eq(col("n_nationkey")))


@query("SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey > r_regionkey", "nation", "region")
def join_theta_left(db):
    return db.select("n_nationkey", "r_regionkey").from_("nation").left_join("region", col("n_regionkey").gt(col("r_regionkey")))


@query("SELECT r_regionkey, n_nationkey FROM region FULL JOIN nation ON r_regionkey > n_nationkey AND r_regionkey <> n_regionkey", "nation", "region")
def join_theta_full(db):
    return db.select("r_regionkey", "n_nationkey").from_("region").full_join("nation", col("r_regionkey").gt(col("n_nationkey")) & col("r_regionkey").ne(col("n_regionkey")))


@query("SELECT a.n_nationkey, b.r_regionkey FROM nation a JOIN region b ON NOT a.n_regionkey = b.r_regionkey", "nation", "region")
def join_theta_neq(db):
    return db.select("n_nationkey", "r_regionkey").from_("nation").inner_join("region", ~col("n_regionkey").eq(col("r_regionkey")))


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey", "supplier", "nation")
def join_range(db):
    return db.select("s_suppkey", "n_nationkey").from_("supplier").inner_join("nation", col("s_nationkey").lt(col("n_nationkey")))


@query("SELECT n_name, r_name FROM nation CROSS JOIN region", "nation", "region")
def join_cross(db):
    return db.select("n_name", "r_name").from_("nation").cross_join("region")


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", "nation", "region")
def join_implicit(db):
    return db.select("n_name", "r_name").from_("nation").cross_join("region").where(col("n_regionkey").eq(col("r_regionkey")))


@query('SELECT e.n_name AS "e.n_name", m.n_name AS "m.n_name" FROM nation e JOIN nation m ON e.n_regionkey = m.n_nationkey', "nation")
def join_self_alias(db):
    return db.select("e.n_name", "m.n_name").from_("nation AS e").inner_join("nation as m", col("e.n_regionkey").eq(col("m.n_nationkey")))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "orders", "customer", "nation", "region")
def join_multi_way(db):
    q = db.select("o_orderkey", "c_name", "n_name", "r_name").from_("orders").inner_join("customer", col("o_custkey").eq(col("c_custkey")))
    return q.inner_join("nation", col("c_nationkey").eq(col("n_nationkey"))).inner_join("region", col("n_regionkey").eq(col("r_regionkey")))


@query("SELECT c_custkey, o_orderkey, l_linenumber FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey", "customer", "orders", "lineitem")
def join_three_way_left(db):
    return db.select("c_custkey", "o_orderkey", "l_linenumber").from_("customer").left_join("orders", col("c_custkey").eq(col("o_custkey"))).left_join("lineitem", col("o_orderkey").eq(col("l_orderkey")))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_quantity > 40", "orders", "lineitem")
def join_multi_condition(db):
    on = col("o_orderkey").eq(col("l_orderkey")) & col("l_shipdate").gt(col("o_orderdate")) & col("l_quantity").gt(40)
    return db.select("o_orderkey", "l_linenumber").from_("orders").inner_join("lineitem", on)


@query("SELECT p_partkey FROM part LEFT JOIN nation ON p_size = n_nationkey WHERE n_name IS NULL", "part", "nation")
def join_left_missing_rows(db):
    return db.select("p_partkey").from_("part").left_join("nation", col("p_size").eq(col("n_nationkey"))).where(col("n_name").is_null())


# ---- aggregates
def aggregated(name: str, table: str, keys: str, calls: list, sql: str):
    def f(db):
        q = db.select("*").from_(table)
        if keys:
            q.group_by(*keys.split(", "))
        for func, *argument in calls:
            getattr(q, func)(*argument)
        return q.frame()

    f.__name__ = name
    query(f"SELECT {keys + ', ' if keys else ''}{sql} FROM {table}{' GROUP BY ' + keys if keys else ''}", table)(f)


aggregated("agg_count_star", "lineitem", "", [("count",)], "count(*) AS count")
aggregated("agg_count_col", "orders", "", [("count_col", "o_orderkey")], "count(o_orderkey) AS count_o_orderkey")
aggregated("agg_sum_int", "lineitem", "l_returnflag", [("sum", "l_linenumber")], "CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber")
aggregated("agg_min_max", "orders", "o_orderpriority", [("min", "o_totalprice"), ("max", "o_orderdate")], "min(o_totalprice) AS min_o_totalprice, max(o_orderdate) AS max_o_orderdate")
aggregated("group_by_multi", "lineitem", "l_returnflag, l_linestatus", [("count",), ("min", "l_quantity"), ("max", "l_quantity")], "count(*) AS count, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity")
aggregated("group_by_one", "customer", "c_mktsegment", [("count",), ("distinct", "c_nationkey")], "count(*) AS count, count(DISTINCT c_nationkey) AS distinct_c_nationkey")


def rounded(frame, **digits):
    return frame.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in frame.columns])


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(avg(l_quantity), 6) AS avg_l_quantity FROM lineitem GROUP BY l_returnflag", "lineitem")
def agg_sum_avg_float(db):
    return rounded(db.select("*").from_("lineitem").group_by("l_returnflag").sum("l_extendedprice").avg("l_quantity").frame(), sum_l_extendedprice=2, avg_l_quantity=6)


@query("SELECT l_linestatus, round(stddev_pop(l_quantity), 6) AS stddev_l_quantity, round(exp(avg(CASE WHEN l_quantity > 0 THEN ln(l_quantity) END)), 6) AS geomean_l_quantity FROM lineitem GROUP BY l_linestatus", "lineitem")
def agg_stddev_geomean(db):
    return rounded(db.select("*").from_("lineitem").group_by("l_linestatus").stddev("l_quantity").geomean("l_quantity").frame(), stddev_l_quantity=6, geomean_l_quantity=6)


@query("SELECT 0::BIGINT AS count, 0::BIGINT AS sum_l_linenumber, NULL::DOUBLE AS avg_l_quantity, 0::BIGINT AS distinct_l_quantity", "lineitem")
def agg_empty_input(db):
    return db.select("*").from_("lineitem").where(col("l_quantity").lt(0)).count().sum("l_linenumber").avg("l_quantity").distinct("l_quantity")


@query("SELECT l_returnflag, count(*) AS count FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag", "lineitem")
def group_empty(db):
    return db.select("*").from_("lineitem").where(col("l_quantity").lt(0)).group_by("l_returnflag").count()


@query(f"SELECT kind, count(*) AS count, count(value) AS count_value, count(DISTINCT value) + CAST(count(*) > count(value) AS INT) AS distinct_value FROM ({SPARSE}) GROUP BY kind", "events")
def agg_distinct_nulls(db):
    events = db.table("events")
    db.register_table(events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind")), "sparse")
    return db.select("*").from_("sparse").group_by("kind").count().count_col("value").distinct("value")


@query(f"SELECT c_mktsegment, count(*) AS count, max(o_totalprice) AS max_o_totalprice FROM {ORDERS_CUSTOMER} WHERE o_totalprice BETWEEN 1000 AND 200000 GROUP BY c_mktsegment ORDER BY count DESC, c_mktsegment LIMIT 3", "orders", "customer")
def group_join_order_by_agg(db):
    q = db.select("*").from_("orders").inner_join("customer", col("o_custkey").eq(col("c_custkey"))).where(col("o_totalprice").between(1000, 200000))
    return q.group_by("c_mktsegment").count().max("o_totalprice").order_by("count", "desc").order_by("c_mktsegment").limit(3)


@query("SELECT c_custkey, count(o_orderkey) AS count_o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "orders", "customer")
def group_outer_join_counts(db):
    return db.select("*").from_("customer").left_join("orders", col("c_custkey").eq(col("o_custkey"))).group_by("c_custkey").count_col("o_orderkey")


# ---- sort, limit
@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 50", "lineitem")
def topn(db):
    return db.select("l_orderkey", "l_linenumber", "l_quantity").from_("lineitem").order_by("l_quantity", "desc").order_by("l_orderkey").order_by("l_linenumber").limit(50)


@query("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey DESC LIMIT 20 OFFSET 10", "customer")
def sort_by_unselected_limit_offset(db):
    return db.select("c_name").from_("customer").order_by("c_acctbal").order_by("c_custkey", "desc").limit(20).offset(10)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 1400", "customer")
def offset_only(db):
    return db.select("c_custkey").from_("customer").order_by("c_custkey").offset(1400)


def numbered(frame):
    """Rows with their place in the frame's order."""
    return frame.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


@query(f"SELECT *, CAST(row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS INT) AS place FROM ({SPARSE})", "events")
def sort_nulls(db):
    events = db.table("events")
    db.register_table(events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind")), "sparse")
    return numbered(db.select("*").from_("sparse").order_by("value", "desc").order_by("event_id").frame())


# ---- unions
@query("SELECT c_nationkey AS c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier", "customer", "supplier")
def union_distinct(db):
    return db.select("c_nationkey").from_("customer").union(db.select("s_nationkey").from_("supplier"))


@query("SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier", "customer", "supplier")
def union_all(db):
    return db.select("c_nationkey").from_("customer").union_all(db.select("s_nationkey").from_("supplier"))


@query("SELECT *, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_nationkey) AS INT) AS place FROM (SELECT c_nationkey, c_acctbal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) WHERE c_acctbal > 5000", "customer", "supplier")
def union_then_filter_sort(db):
    q = db.select("c_nationkey", "c_acctbal").from_("customer").union_all(db.select("s_nationkey", "s_acctbal").from_("supplier"))
    return numbered(q.where(col("c_acctbal").gt(5000)).order_by("c_acctbal", "desc").order_by("c_nationkey").frame())


@query("SELECT c_nationkey, count(*) AS count FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY c_nationkey", "customer", "supplier")
def union_grouped(db):
    return db.select("c_nationkey").from_("customer").union_all(db.select("s_nationkey").from_("supplier")).group_by("c_nationkey").count()


# ---- scalar functions
@query("SELECT c_custkey, abs(c_acctbal) AS a, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(strlen(c_name) AS INT) AS n FROM customer", "customer")
def fn_abs_upper_lower_length(db):
    return db.select("c_custkey", (call("abs", col("c_acctbal")), "a"), (call("UPPER", col("c_name")), "u"), (call("Lower", col("c_mktsegment")), "l"), (call("LENGTH", col("c_name")), "n")).from_("customer")


@query("SELECT doc_id, CAST(strlen(text) AS INT) AS bytes FROM documents", "documents")
def fn_length_bytes(db):
    return db.select("doc_id", (call("length", col("text")), "bytes")).from_("documents")


@query("SELECT c_custkey, coalesce(o_orderkey, 0) AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "customer", "orders")
def fn_coalesce(db):
    return db.select("c_custkey", (call("COALESCE", col("o_orderkey"), 0), "o")).from_("customer").left_join("orders", col("c_custkey").eq(col("o_custkey")))


@query("SELECT p_partkey, p_size + 3 AS a, p_size - 10 AS s, p_size * 2 AS m, -p_size AS n FROM part", "part")
def arith_add_sub_mul_neg(db):
    size = col("p_size")
    return db.select("p_partkey", (size + 3, "a"), (size - 10, "s"), (size * 2, "m"), (-size, "n")).from_("part")


@query("SELECT p_partkey, CAST(trunc((p_size - 25) / 7) AS INT) AS q, CAST(p_size % 7 AS INT) AS r, CASE WHEN p_size <> 10 THEN p_retailprice / (p_size - 10) END AS d FROM part", "part")
def arith_div_mod(db):
    size = col("p_size")
    return db.select("p_partkey", ((size - 25) / 7, "q"), (size % 7, "r"), (col("p_retailprice") / (size - 10), "d")).from_("part")


TOP, LEAST = 2147483647, -2147483648


@query(f"SELECT p_partkey, CAST(least(p_size::BIGINT + {TOP}, {TOP}) AS INT) AS a, CAST(greatest({LEAST} + 20 - p_size::BIGINT, {LEAST}) AS INT) AS s, CAST(greatest(p_size::BIGINT * -{TOP}, {LEAST}) AS INT) AS m, CAST(least(p_partkey::HUGEINT * 4611686018427387904, 9223372036854775807) AS BIGINT) AS w, 2 ** 31 - 1 AS q FROM part", "part")
def arith_overflow(db):
    size = col("p_size")
    least = size - size + TOP - TOP - TOP - 1  # the least integer, of a column's type
    return db.select("p_partkey", (size + TOP, "a"), (lit(LEAST + 20) - size, "s"), (size * -TOP, "m"), (col("p_partkey") * 4611686018427387904, "w"), (least / -1 + 0.0, "q")).from_("part")


@query(f"SELECT p_partkey, CASE WHEN p_size > 25 THEN {TOP} ELSE {TOP} - p_size END AS a, {TOP} AS n FROM part", "part")
def fn_abs_min(db):
    size = col("p_size")
    low = size * 0 - TOP
    rows = db.table("part").select("p_partkey", "p_size", F.when(F.col("p_size") > 25, F.lit(LEAST)).otherwise(F.col("p_size") - TOP).alias("low"))
    db.register_table(rows, "lows")
    return db.select("p_partkey", (call("abs", col("low")), "a"), (-(low - 1), "n")).from_("lows")


@query("SELECT l_returnflag, CAST(least(sum(4611686018427387904::HUGEINT), 9223372036854775807) AS BIGINT) AS sum_big, CAST(sum(l_orderkey) AS BIGINT) AS sum_l_orderkey FROM lineitem GROUP BY l_returnflag", "lineitem")
def agg_sum_overflow(db):
    rows = db.table("lineitem").select("l_returnflag", "l_orderkey", F.lit(4611686018427387904).alias("big"))
    db.register_table(rows, "bigs")
    return db.select("*").from_("bigs").group_by("l_returnflag").sum("big").sum("l_orderkey")


# ---- JSON
@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 7", "events")
def json_path_eq_num(db):
    return db.select("event_id").from_("events").where(col("props").get("$.k").eq(7))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') LIKE '%8%'", "events")
def json_path_contains(db):
    return db.select("event_id").from_("events").where(col("props").get("$.k").contains("8"))


@query("SELECT event_id FROM events WHERE json_exists(props, '$.k') AND NOT json_exists(props, '$.missing')", "events")
def json_path_exists(db):
    return db.select("event_id").from_("events").where(col("props").get("$.k").exists() & ~col("props").get("$.missing").exists())


#: A document with an array and nested members for every event.
NESTED = """SELECT event_id, '{"items":[{"n":' || (event_id % 5) || ',"tag":"a' || (event_id % 3) || '"},{"n":' || (event_id % 7) || ',"tag":"b"}],"meta":{"n":' || (event_id % 11) || (CASE WHEN event_id % 2 = 0 THEN ',"even":null' ELSE '' END) || (CASE WHEN event_id % 3 = 0 THEN ',"third":[]' ELSE '' END) || '},"list":[' || event_id % 2 || ',' || event_id % 3 || ',' || event_id % 4 || '],"some":' || (CASE WHEN event_id % 4 > 1 THEN '[1,2,3]' ELSE '[1]' END) || '}' AS doc FROM events"""


def nested(db):
    e = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    even, third = F.when(e % 2 == 0, ',"even":null').otherwise(""), F.when(e % 3 == 0, ',"third":[]').otherwise("")
    some = F.when(e % 4 > 1, "[1,2,3]").otherwise("[1]")
    doc = text('{"items":[{"n":', e % 5, ',"tag":"a', e % 3, '"},{"n":', e % 7, ',"tag":"b"}],"meta":{"n":', e % 11, even, third, '},"list":[', e % 2, ",", e % 3, ",", e % 4, '],"some":', some, "}")
    db.register_table(db.table("events").select("event_id", doc.alias("doc")), "nested")
    return db


def json_query(name: str, sql: str, make):
    def f(db):
        return make(nested(db))

    f.__name__ = name
    query(f"WITH nested AS ({NESTED}) {sql}", "events")(f)


def json_filter(name: str, test, where: str):
    json_query(name, f"SELECT event_id FROM nested WHERE {where}", lambda db: db.select("event_id").from_("nested").where(test))


def json_value(name: str, make, sql: str):
    json_query(name, f"SELECT event_id, {sql} AS v FROM nested", lambda db: db.select("event_id", (Raw(col("doc"), make), "v")).from_("nested"))


json_filter("json_index_path", col("doc").get("$.items[1].n").eq(3), "event_id % 7 = 3")
json_filter("json_wildcard", col("doc").get("$.items[*].n").eq(4), "event_id % 5 = 4")
json_filter("json_slice", col("doc").get("$.list[1:3]").eq(2), "event_id % 3 = 2")
json_filter("json_recursive", col("doc").get("$..tag").eq("a1"), "event_id % 3 = 1")
json_filter("json_filter_path", col("doc").get("$.items[?(@.n > 5)]").exists(), "event_id % 7 = 6")
json_filter("json_and_of_paths", col("doc").get("$.meta.n").eq(2) & col("doc").get("$.items[0].tag").contains("a0"), "event_id % 11 = 2 AND event_id % 3 = 0")
json_value("json_query_all", lambda c: F.array_join(jsonpath.query(c, "$..n"), ","), "(event_id % 5) || ',' || (event_id % 7) || ',' || (event_id % 11)")
#: The member ``meta`` with its keys in order.
META = """'{' || (CASE WHEN event_id % 2 = 0 THEN '"even":null,' ELSE '' END) || '"n":' || (event_id % 11) || (CASE WHEN event_id % 3 = 0 THEN ',"third":[]' ELSE '' END) || '}'"""
json_value("jsonb_get_field", lambda c: jsonb.field(c, "meta"), META)
json_value("jsonb_get_text", lambda c: jsonb.field_text(jsonb.field(c, "meta"), "n"), "CAST(event_id % 11 AS VARCHAR)")
json_value("jsonb_get_path", lambda c: jsonb.at_path(c, "meta", "n"), "CAST(event_id % 11 AS VARCHAR)")
json_value("jsonb_contains", lambda c: jsonb.contains(c, '{"items":[{"n":1}]}').cast("string"), "CAST(event_id % 5 = 1 OR event_id % 7 = 1 AS VARCHAR)")
json_value("jsonb_contained_by", lambda c: jsonb.contained_by(jsonb.field(c, "meta"), '{"n":3,"m":1,"even":null}').cast("string"), "CAST(event_id % 11 = 3 AND event_id % 3 <> 0 AS VARCHAR)")
json_value("jsonb_has_key", lambda c: F.concat_ws(",", jsonb.has_key(jsonb.field(c, "meta"), "even").cast("string"), jsonb.has_key(c, "meta").cast("string"), jsonb.has_key(jsonb.field(c, "some"), "2").cast("string")), "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',true,' || CASE WHEN event_id % 4 > 1 THEN 'true' ELSE 'false' END")
json_value("jsonb_has_any_all", lambda c: F.concat_ws(",", jsonb.has_any(jsonb.field(c, "meta"), "no", "even", "third").cast("string"), jsonb.has_all(jsonb.field(c, "meta"), "n", "even", "third").cast("string")), "CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 'true' ELSE 'false' END || ',' || CASE WHEN event_id % 6 = 0 THEN 'true' ELSE 'false' END")
json_filter("json_contains_number", col("doc").get("$.meta.n").contains(7), "event_id % 11 = 7")
json_filter("json_functions_by_name", call("JSONB_PATH_EQ", col("doc"), "$.items[0].tag", "a1") & call("jsonb_exists", col("doc"), "$.meta.even") & call("Jsonb_Contains", col("doc"), "$.items[1].tag", "b"), "event_id % 3 = 1 AND event_id % 2 = 0")
json_value("jsonb_concat", lambda c: jsonb.concat(jsonb.field(c, "meta"), '{"z":1}'), f"replace({META}, '}}', ',\"z\":1}}')")
json_value("jsonb_delete_key", lambda c: jsonb.delete_keys(c, "items", "list", "some"), f"'{{\"meta\":' || {META} || '}}'")
json_value("jsonb_delete_index", lambda c: jsonb.delete_index(jsonb.field(c, "list"), 1), "'[' || event_id % 2 || ',' || event_id % 4 || ']'")


# ---- mutations and transactions
def accounts(db):
    schema = TableBuilder("accounts").column("id", "Int64", primary_key=True).column("name", "String").column("balance", "Float64", nullable=True).build()
    rows = db.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    db.register_table(rows, schema)
    return db


ACCOUNTS = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer"


def mutated(name: str, sql: str, act):
    def f(db):
        act(accounts(db))
        return rounded(db.select("*").from_("accounts").frame(), balance=2)

    f.__name__ = name
    query(sql, "customer")(f)


mutated("dml_insert", f"{ACCOUNTS} UNION ALL SELECT 9000001, 'new', NULL", lambda db: db.insert("accounts").values([{"id": 9000001, "name": "new"}]).exec())
mutated("dml_update", "SELECT c_custkey AS id, CASE WHEN c_custkey < 100 THEN 'renamed' ELSE c_name END AS name, CASE WHEN c_custkey < 100 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer", lambda db: db.update("accounts").set({"name": "renamed", "balance": col("balance") + 1.0}).where(col("id").lt(100)).exec())
mutated("dml_delete", f"SELECT * FROM ({ACCOUNTS}) WHERE NOT balance < 0", lambda db: db.delete("accounts").where(col("balance").lt(0)).exec())
mutated("dml_upsert", f"SELECT * FROM ({ACCOUNTS}) WHERE id <> 1 UNION ALL VALUES (1::BIGINT, 'one', 1.0::DOUBLE), (9000002::BIGINT, 'two', 2.0::DOUBLE)", lambda db: db.insert_or_replace("accounts", [{"id": 1, "name": "one", "balance": 1}, {"id": 9000002, "name": "two", "balance": 2}]))


def _committed(db):
    tx = db.transaction()
    tx.insert("accounts", [{"id": 9000003, "name": "tx", "balance": 5}])
    tx.update("accounts", {"balance": 0}, col("id").eq(2))
    tx.delete("accounts", col("id").eq(3))
    tx.commit()


def _rolled_back(db):
    tx = db.transaction()
    tx.delete("accounts")
    tx.rollback()


def _many_updates(db):
    """Twenty updates of one column in one transaction."""
    tx = db.transaction()
    for i in range(20):
        tx.update("accounts", {"balance": col("balance") + 1.0, "name": f"round {i}"}, col("id").gt(i * 50))
    tx.commit()


mutated("txn_many_updates", "SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN 'round ' || least(19, (c_custkey - 1) // 50) ELSE c_name END AS name, round(c_acctbal + CASE WHEN c_custkey > 0 THEN least(20, (c_custkey - 1) // 50 + 1) ELSE 0 END, 2) AS balance FROM customer", _many_updates)
mutated("txn_commit", f"SELECT id, name, CASE WHEN id = 2 THEN 0.0 ELSE balance END AS balance FROM ({ACCOUNTS}) WHERE id <> 3 UNION ALL SELECT 9000003, 'tx', 5.0", _committed)
mutated("txn_rollback", ACCOUNTS, _rolled_back)


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 9000004, 99999.0", "customer")
def prepared_sees_new_rows(db):
    prepared = accounts(db).select("id", "balance").from_("accounts").where(col("balance").gt(9000)).prepare()
    db.insert("accounts").values([{"id": 9000004, "name": "rich", "balance": 99999}]).exec()
    return prepared.frame()


# ---- incremental views: the state after a fixed script of changes
def maintained(name: str, sql: str, make, *tables: str):
    """Half of the orders are there at first; then the others come, some leave, some change."""

    def f(db):
        orders = db.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
        first = orders.where("o_orderkey % 2 = 0")
        schema = TableBuilder("o").column("o_orderkey", "Int64", primary_key=True).column("o_custkey", "Int64", nullable=True)
        db.register_table(first, schema.column("o_orderstatus", "String", nullable=True).column("o_totalprice", "Float64", nullable=True).build())
        view = make(db).trace().keep_current()
        change = zset.weighted(orders.where("o_orderkey % 2 = 1"))
        change = change.union(zset.weighted(orders.where("o_orderkey % 10 = 4"), -1))
        db.apply_delta("o", change)
        changed = orders.where("o_orderkey % 10 = 6")
        raised = changed.withColumn("o_totalprice", F.col("o_totalprice") + 1)
        db.apply_delta("o", zset.weighted(changed, -1).union(zset.weighted(raised)))
        return view.frame()

    f.__name__ = name
    query(f"WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 6 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 4) {sql}", "orders", *tables)(f)


maintained("ivm_filter", "SELECT * FROM o WHERE o_totalprice > 100000", lambda db: db.select("*").from_("o").where(col("o_totalprice").gt(100000)))
maintained("ivm_project", "SELECT o_orderkey, o_custkey FROM o", lambda db: db.select("o_orderkey", "o_custkey").from_("o"))
maintained("ivm_inner_join", "SELECT o_orderkey, o_totalprice, c_name FROM o JOIN customer ON o_custkey = c_custkey", lambda db: db.select("o_orderkey", "o_totalprice", "c_name").from_("o").inner_join("customer", col("o_custkey").eq(col("c_custkey"))), "customer")
maintained("ivm_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN o ON c_custkey = o_custkey", lambda db: db.select("c_custkey", "o_orderkey").from_("customer").left_join("o", col("c_custkey").eq(col("o_custkey"))), "customer")
maintained("ivm_full_join", "SELECT c_custkey, o_orderkey FROM o FULL JOIN customer ON c_custkey = o_custkey", lambda db: db.select("c_custkey", "o_orderkey").from_("o").full_join("customer", col("c_custkey").eq(col("o_custkey"))), "customer")
maintained("ivm_group_count_distinct", "SELECT o_orderstatus, count(*) AS count, count(DISTINCT o_custkey) AS distinct_o_custkey FROM o GROUP BY o_orderstatus", lambda db: db.select("*").from_("o").group_by("o_orderstatus").count().distinct("o_custkey"))
maintained("ivm_group_min_max_delete", "SELECT o_custkey, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM o GROUP BY o_custkey", lambda db: db.select("*").from_("o").group_by("o_custkey").min("o_totalprice").max("o_totalprice"))
maintained("ivm_union_distinct", "SELECT o_custkey FROM o UNION SELECT c_custkey FROM customer", lambda db: db.select("o_custkey").from_("o").union(db.select("c_custkey").from_("customer")), "customer")
maintained("ivm_right_join", "SELECT o_orderkey, c_custkey FROM o RIGHT JOIN customer ON o_custkey = c_custkey", lambda db: db.select("o_orderkey", "c_custkey").from_("o").right_join("customer", col("o_custkey").eq(col("c_custkey"))), "customer")
maintained("ivm_multi_condition_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN o ON c_custkey = o_custkey AND o_totalprice > 200000", lambda db: db.select("c_custkey", "o_orderkey").from_("customer").left_join("o", col("c_custkey").eq(col("o_custkey")) & col("o_totalprice").gt(200000)), "customer")
maintained("ivm_theta_full_join", "SELECT n_nationkey, o_orderkey FROM nation FULL JOIN o ON n_nationkey > o_custkey", lambda db: db.select("n_nationkey", "o_orderkey").from_("nation").full_join("o", col("n_nationkey").gt(col("o_custkey"))), "nation")
maintained("ivm_cross", "SELECT o_orderkey, r_name FROM o, region", lambda db: db.select("o_orderkey", "r_name").from_("o").cross_join("region"), "region")
maintained("ivm_global_count", "SELECT count(*) AS count, CAST(sum(o_custkey) AS BIGINT) AS sum_o_custkey, avg(o_custkey) AS avg_o_custkey FROM o", lambda db: db.select("*").from_("o").count().sum("o_custkey").avg("o_custkey"))
maintained("ivm_filter_join", "SELECT o_orderkey, c_name FROM o JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000 AND c_acctbal > 0", lambda db: db.select("o_orderkey", "c_name").from_("o").inner_join("customer", col("o_custkey").eq(col("c_custkey"))).where(col("o_totalprice").gt(50000) & col("c_acctbal").gt(0)), "customer")


@query("SELECT o_orderstatus, count(*) AS count, CAST(sum(o_custkey) AS BIGINT) AS sum_o_custkey FROM orders WHERE o_orderkey % 5 <> 3 GROUP BY o_orderstatus", "orders")
def ivm_linear_aggregate(db):
    orders = db.table("orders")
    db.register_table(orders.where("o_orderkey % 2 = 0"), "o")
    plan = db.select("*").from_("o").group_by("o_orderstatus").count().sum("o_custkey").plan()
    kept = zset.LinearAggregate(plan, db.snapshot())
    change = zset.weighted(orders.where("o_orderkey % 2 = 1")).union(zset.weighted(orders.where("o_orderkey % 5 = 3"), -1))
    kept.apply(zset.delta(plan.input, db.snapshot(), db.snapshot(), {"o": change}))
    return kept.frame()


# ---- GraphQL
def graph(db):
    def schema(name, key, foreign=()):
        rows = db.table(name)
        b = TableBuilder(name)
        kinds = {"int": "Int32", "bigint": "Int64", "double": "Float64", "timestamp_ntz": "DateTime"}
        for f in rows.schema.fields:
            b.column(f.name, kinds.get(f.dataType.simpleString(), "String"), nullable=f.name != key)
        b.primary_key(key)
        for fk in foreign:
            b.foreign_key(*fk)
        db.drop_table(name)
        db.register_table(rows, b.build())

    schema("region", "r_regionkey")
    schema("nation", "n_nationkey", [("fk_region", "n_regionkey", "region", "r_regionkey", "region", "nations")])
    schema("customer", "c_custkey", [("fk_nation", "c_nationkey", "nation", "n_nationkey", "nation", "customers")])
    return db


@query("SELECT c_custkey, c_name AS label FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal > 5000 OR c_custkey < 100) ORDER BY c_custkey LIMIT 40", "region", "nation", "customer")
def gql_collection(db):
    document = """query Rich($least: Float!) { customer(where: { c_mktsegment: { eq: "BUILDING" }, OR: [{ c_acctbal: { gt: $least } }, { c_custkey: { lt: 100 } }] },
      orderBy: [{ field: C_CUSTKEY, direction: ASC }], limit: 40) { c_custkey label: c_name } }"""
    return graph(db).prepare_graphql(document).frame({"least": 5000.0})


@query("SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 42", "region", "nation", "customer")
def gql_by_pk(db):
    return graph(db).prepare_graphql("{ customerByPk(pk: { c_custkey: 42 }) { c_name c_acctbal } }").frame()


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey", "region", "nation", "customer")
def gql_forward_relation(db):
    rows = graph(db).prepare_graphql("{ nation { n_name region { r_name } } }").frame()
    return rows.select("n_name", F.col("region.r_name").alias("r_name"))


@query("SELECT n_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) JOIN nation ON c_nationkey = n_nationkey WHERE n > 1 AND n <= 4", "region", "nation", "customer")
def gql_reverse_topk(db):
    rows = graph(db).prepare_graphql("{ nation { n_nationkey customers(orderBy: [{ field: C_ACCTBAL, direction: DESC }], limit: 3, offset: 1) { c_custkey } } }").frame()
    return rows.select("n_nationkey", F.explode("customers").alias("c")).select("n_nationkey", F.col("c.c_custkey").alias("c_custkey"))


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'GraphQL' ELSE c_name END AS c_name FROM customer WHERE c_custkey <> 8", "region", "nation", "customer")
def gql_mutation(db):
    graph(db).graphql('mutation { updateCustomer(where: { c_custkey: { eq: 7 } }, set: { c_name: "GraphQL" }) { c_custkey } deleteCustomer(where: { c_custkey: { eq: 8 } }) { c_custkey } }')
    return db.select("c_custkey", "c_name").from_("customer")


@query("SELECT c_custkey, c_name FROM customer UNION ALL VALUES (9000005::BIGINT, 'five'), (9000006::BIGINT, 'six')", "region", "nation", "customer")
def gql_insert(db):
    graph(db).graphql('mutation { insertCustomer(input: [{ c_custkey: 9000005, c_name: "five" }, { c_custkey: 9000006, c_name: "six" }]) { c_custkey } }')
    return db.select("c_custkey", "c_name").from_("customer")


@query("SELECT c_custkey, CASE WHEN place <= 3 THEN 'first' ELSE c_name END AS c_name FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place NOT IN (4, 5)", "region", "nation", "customer")
def gql_paged_mutation(db):
    order = "orderBy: [{ field: C_ACCTBAL, direction: DESC }]"
    graph(db).graphql(f'mutation {{ updateCustomer({order}, limit: 3, set: {{ c_name: "first" }}) {{ c_custkey }} deleteCustomer({order}, offset: 3, limit: 2) {{ c_custkey }} }}')
    return db.select("c_custkey", "c_name").from_("customer")


@query(f"WITH nested AS ({NESTED}) SELECT event_id FROM nested WHERE event_id % 11 = 4 AND event_id % 3 = 2 AND event_id % 2 = 0", "events")
def gql_json_filter(db):
    rows = nested(db).table("nested")
    db.register_table(rows, TableBuilder("facts").column("event_id", "Int64", primary_key=True).column("doc", "Jsonb", nullable=True).build())
    where = '{ doc: { path: "$.meta.n", eq: 4 }, AND: [{ doc: { path: "$.items[0].tag", contains: "a2" } }, { doc: { path: "$.meta.even", exists: true } }] }'
    return db.prepare_graphql(f"{{ facts(where: {where}) {{ event_id }} }}").frame()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey < 300", "region", "nation", "customer")
def gql_include_skip(db):
    document = "query Q($yes: Boolean!, $no: Boolean = false) { customer(where: { c_custkey: { lt: 300 } }) { c_custkey c_name @include(if: $yes) c_acctbal @include(if: $no) c_mktsegment @skip(if: $yes) } }"
    return graph(db).prepare_graphql(document).frame({"yes": True})


def flagship(spark, sf_dir):
    """Order count and highest price by market segment."""
    return QUERIES["group_join_order_by_agg"](spark, sf_dir)
