"""Reference queries on the order tables, each with an equivalent, a wrong and a failing variant.

They cover the query shapes a gold query may take and feed the comparison operators with real results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class Gold:
    query_id: str
    gold: str
    equivalent: str
    wrong: str
    failing: str


def _failing(table: str) -> str:
    return f"SELECT no_such_column FROM {table}"


PACK: tuple[Gold, ...] = (
    Gold(
        "filter_project",
        """SELECT o_orderkey, round(o_totalprice / 2, 1) AS half_price, upper(o_orderpriority) AS priority,
                  CAST(year(o_orderdate) AS INT) AS order_year,
                  CAST(length(o_orderpriority) AS INT) AS width
           FROM orders WHERE year(o_orderdate) = 1997 AND o_totalprice > 1000""",
        """SELECT o_orderkey, round(o_totalprice * 0.5, 1), upper(o_orderpriority), 1997, length(o_orderpriority)
           FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01' AND NOT o_totalprice <= 1000""",
        """SELECT o_orderkey, round(o_totalprice / 2, 1), upper(o_orderpriority), 1997, length(o_orderpriority)
           FROM orders WHERE year(o_orderdate) = 1998 AND o_totalprice > 1000""",
        _failing("orders"),
    ),
    Gold(
        "join_agg",
        """SELECT n.n_name, count(*) AS num_orders,
                  CAST(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
           FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
           GROUP BY n.n_name ORDER BY revenue DESC, n.n_name""",
        """WITH per_customer AS (
             SELECT o_custkey, count(*) AS k, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total
             FROM orders GROUP BY o_custkey)
           SELECT n.n_name, sum(p.k), CAST(sum(p.total) AS DOUBLE)
           FROM per_customer p JOIN customer c ON c.c_custkey = p.o_custkey
           JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name""",
        """SELECT n.n_name, count(*), CAST(max(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE)
           FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
           GROUP BY n.n_name""",
        _failing("nation"),
    ),
    Gold(
        "left_join",
        """SELECT c.c_custkey, count(o.o_orderkey) AS num_orders
           FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""",
        """SELECT c.c_custkey, coalesce(k.n, 0) FROM customer c
           LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) k ON k.o_custkey = c.c_custkey""",
        """SELECT c.c_custkey, count(*) FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
           GROUP BY c.c_custkey HAVING count(*) > 9""",
        _failing("customer"),
    ),
    Gold(
        "semi_anti",
        """SELECT c.c_custkey, 'with' AS side FROM customer c
           WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
           UNION ALL
           SELECT c.c_custkey, 'without' AS side FROM customer c
           WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""",
        """SELECT c.c_custkey, CASE WHEN f.o_custkey IS NULL THEN 'without' ELSE 'with' END
           FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') f
           ON f.o_custkey = c.c_custkey""",
        """SELECT c.c_custkey, 'with' FROM customer c
           WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""",
        _failing("customer"),
    ),
    Gold(
        "range_join",
        """SELECT p.p_partkey, b.band FROM part p
           JOIN (VALUES (0, 'low', 0.0, 250.0), (1, 'low', 250.0, 500.0), (2, 'mid', 500.0, 750.0),
                        (3, 'mid', 750.0, 1000.0), (4, 'high', 1000.0, 1250.0), (5, 'high', 1250.0, 1500.0),
                        (6, 'top', 1500.0, 1750.0), (7, 'top', 1750.0, 2000.0), (8, 'top', 2000.0, 2250.0)
                ) AS b(slot, band, low, high)
           ON b.slot = CAST(floor(p.p_retailprice / 250) AS INT)
              AND p.p_retailprice >= b.low AND p.p_retailprice < b.high""",
        """SELECT p_partkey, CASE WHEN p_retailprice < 500 THEN 'low' WHEN p_retailprice < 1000 THEN 'mid'
                  WHEN p_retailprice < 1500 THEN 'high' ELSE 'top' END
           FROM part WHERE p_retailprice >= 0 AND p_retailprice < 2250""",
        "SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 'low' ELSE 'top' END FROM part",
        _failing("part"),
    ),
    Gold(
        "distinct_having",
        """SELECT p.p_type, count(DISTINCT l.l_suppkey) AS suppliers,
                  CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned
           FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
           GROUP BY p.p_type HAVING count(*) > 10""",
        """SELECT p_type, count(*), sum(r) FROM (
             SELECT p.p_type, l.l_suppkey, count(*) AS n, count(CASE WHEN l.l_returnflag = 'R' THEN 1 END) AS r
             FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey GROUP BY p.p_type, l.l_suppkey) pairs
           GROUP BY p_type HAVING sum(n) > 10""",
        """SELECT p.p_type, count(l.l_suppkey), sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END)
           FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY p.p_type""",
        _failing("lineitem"),
    ),
    Gold(
        "window_topn",
        """SELECT c_mktsegment, o_orderkey, o_totalprice, CAST(place AS INT) AS place FROM (
             SELECT c.c_mktsegment, o.o_orderkey, o.o_totalprice,
                    row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY o.o_totalprice DESC, o.o_orderkey) AS place
             FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey) ranked
           WHERE place <= 3""",
        """SELECT c_mktsegment, o_orderkey, o_totalprice, place FROM (
             SELECT c.c_mktsegment, o.o_orderkey, o.o_totalprice,
                    rank() OVER (PARTITION BY c.c_mktsegment ORDER BY o.o_totalprice DESC, o.o_orderkey) AS place
             FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey) ranked
           WHERE place < 4""",
        """SELECT c_mktsegment, o_orderkey, o_totalprice, place FROM (
             SELECT c.c_mktsegment, o.o_orderkey, o.o_totalprice,
                    row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY o.o_totalprice, o.o_orderkey) AS place
             FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey) ranked
           WHERE place <= 3""",
        _failing("customer"),
    ),
    Gold(
        "window_running",
        """SELECT o_custkey, o_orderkey,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (
                    PARTITION BY o_custkey ORDER BY o_orderkey
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_total
           FROM orders""",
        """SELECT o_custkey, o_orderkey,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (
                    PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) AS so_far
           FROM orders""",
        """SELECT o_custkey, o_orderkey,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS total
           FROM orders""",
        _failing("orders"),
    ),
    Gold(
        "set_ops",
        """SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) a
           UNION ALL
           SELECT 'customers_only' AS side, k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) b
           UNION ALL
           SELECT 'either' AS side, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) c""",
        """WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
           SELECT 'either', coalesce(c.k, s.k) FROM c FULL JOIN s ON c.k = s.k
           UNION ALL SELECT 'both', c.k FROM c JOIN s ON c.k = s.k
           UNION ALL SELECT 'customers_only', c.k FROM c LEFT JOIN s ON c.k = s.k WHERE s.k IS NULL""",
        "SELECT 'both', c_nationkey FROM customer UNION ALL SELECT 'both', s_nationkey FROM supplier",
        _failing("supplier"),
    ),
    Gold(
        "subquery",
        """WITH mean AS (SELECT o_custkey AS k, avg(CAST(o_totalprice AS DECIMAL(18, 2))) AS average FROM orders GROUP BY o_custkey)
           SELECT o.o_orderkey, o.o_custkey FROM orders o
           WHERE o.o_totalprice > (SELECT max(m.average) FROM mean m WHERE m.k = o.o_custkey)
             AND o.o_totalprice < (SELECT max(o_totalprice) FROM orders)""",
        """SELECT o.o_orderkey, o.o_custkey FROM orders o
           JOIN (SELECT o_custkey AS k, avg(CAST(o_totalprice AS DECIMAL(18, 2))) AS average FROM orders GROUP BY o_custkey) m
           ON m.k = o.o_custkey AND o.o_totalprice > m.average
           WHERE o.o_totalprice <> (SELECT max(o_totalprice) FROM orders)""",
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
        _failing("orders"),
    ),
    Gold(
        "topk",
        """SELECT p_partkey, p_name, p_retailprice FROM part
           ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5""",
        """SELECT p_partkey, p_name, p_retailprice FROM (
             SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15) best
           ORDER BY p_retailprice, p_partkey DESC LIMIT 10""",
        "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10",
        _failing("part"),
    ),
    Gold(
        "json",
        """SELECT CAST(floor(CAST(get_json_object(props, '$.k') AS INT) / 10) AS INT) AS bucket, event_type, count(*) AS n
           FROM events GROUP BY 1, 2""",
        """SELECT (CAST(get_json_object(props, '$.k') AS INT) - CAST(get_json_object(props, '$.k') AS INT) % 10) / 10,
                  event_type, count(1)
           FROM events GROUP BY 1, 2""",
        "SELECT CAST(get_json_object(props, '$.k') AS INT), event_type, count(1) FROM events GROUP BY 1, 2",
        _failing("events"),
    ),
)

VARIANTS = ("gold", "equivalent", "wrong", "failing")


def register_tables(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> None:
    """Parquet tables of ``folder`` as temporary views."""
    for name in tables:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def gold_pack(spark: SparkSession) -> DataFrame:
    """``query_id``, ``variant`` and ``sql`` of every statement of the pack."""
    rows = [(g.query_id, v, getattr(g, v)) for g in PACK for v in VARIANTS]
    return spark.createDataFrame(rows, "query_id string, variant string, sql string")
