"""The registered queries over archives of the given tables, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.archive import Archive
from palimpsest.operators.dataset import Expressions, RowFunction
from palimpsest.plans.ranks import ranked
from palimpsest.snapshots import SnapshotDescriptor
from palimpsest.sources.documents import from_csv, from_json, from_spark
from palimpsest.sources.sinks import write_csv, write_json
from palimpsest.store import Store, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_built: dict[tuple, Archive] = {}

# The versions of ``orders`` that the queries look at.
_V0 = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0"
_V1 = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0"
_V2 = "SELECT o_orderkey, o_orderstatus, o_custkey, o_totalprice AS o_price, o_orderdate FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0"
_WITH = f"""WITH v0 AS ({_V0}), v1 AS ({_V1}), v2 AS ({_V2}),
p0 AS (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos FROM v0),
p1 AS (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos FROM v1),
p2 AS (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos FROM v2)"""
_EACH = "SELECT 0 AS v, o_orderkey FROM v0 UNION ALL SELECT 1, o_orderkey FROM v1 UNION ALL SELECT 2, o_orderkey FROM v2 UNION ALL SELECT 3, o_orderkey FROM v0"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _version(spark: SparkSession, sf_dir: str, v: int) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    if v in (0, 3):
        return o.where(key % 10 != 0).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    if v == 1:
        status = F.when(key % 5 == 1, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
        return o.where(key % 7 != 0).select("o_orderkey", "o_custkey", status, "o_totalprice", "o_orderpriority")
    return o.where((key % 7 != 0) & (key % 11 != 0)).select("o_orderkey", "o_orderstatus", "o_custkey", F.col("o_totalprice").alias("o_price"), "o_orderdate")


def _orders(spark: SparkSession, sf_dir: str, versions: int = 4) -> Archive:
    """The archive of ``orders``, built once a session and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir, versions)
    if key not in _built:
        times = [datetime(2024, m, 1) for m in (1, 2, 3, 4)]
        out = Archive.create(spark, None, _version(spark, sf_dir, 0), ["o_orderkey"], SnapshotDescriptor("v0", times[0], {"load": 0}))
        for v in range(1, versions):
            out.commit(_version(spark, sf_dir, v), SnapshotDescriptor(f"v{v}", times[v], {"load": v}), renamed={"o_totalprice": "o_price"} if v == 2 else None)
        _built[key] = out
    return Archive(_built[key].store)


def _checkout(v: int, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _orders(spark, sf_dir).checkout(v)

    run.__name__ = f"checkout_v{v}"
    query(sql)(run)


for _v, _sql in enumerate((_V0, _V1, _V2, _V0)):
    _checkout(_v, _sql)


def _key(name: str = "row_key"):
    return F.col("key")[0]["whole"].alias(name)


@query(f"""{_WITH} SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS row_key,
 CASE WHEN a.o_orderkey IS NULL THEN 'INSERT' WHEN b.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op FROM v0 a FULL OUTER JOIN v1 b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
 OR a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority""")
def diff_rows_v0_v1(spark, sf_dir):
    return _orders(spark, sf_dir).diff(0, 1, positions=False).rows().select(_key(), "op")


@query(f"""{_WITH} SELECT a.o_orderkey AS row_key, 2 AS colid, a.o_orderstatus AS old_value, b.o_orderstatus AS new_value
FROM v0 a JOIN v1 b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def diff_cells_v0_v1(spark, sf_dir):
    return _orders(spark, sf_dir).diff(0, 1, positions=False).cells().select(_key(), "colid", "old_value", "new_value")


@query(f"""{_WITH} SELECT p0.o_orderkey AS row_key, p0.pos AS old_pos, p1.pos AS new_pos FROM p0 JOIN p1 USING (o_orderkey) WHERE p0.pos <> p1.pos""")
def diff_moved_v0_v1(spark, sf_dir):
    return _orders(spark, sf_dir).diff(0, 1).moved().select(_key(), "old_pos", "new_pos")


@query(f"""{_WITH}, j AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, p0.pos IS DISTINCT FROM p1.pos AS moved,
  CAST(a.o_custkey IS DISTINCT FROM b.o_custkey AS INT) + CAST(a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS INT)
 + CAST(a.o_totalprice IS DISTINCT FROM b.o_totalprice AS INT) + CAST(a.o_orderpriority IS DISTINCT FROM b.o_orderpriority AS INT) AS n
 FROM (v0 a JOIN p0 ON p0.o_orderkey = a.o_orderkey) FULL OUTER JOIN (v1 b JOIN p1 ON p1.o_orderkey = b.o_orderkey) ON a.o_orderkey = b.o_orderkey)
SELECT COUNT(*) FILTER (WHERE ka IS NULL) AS inserted, COUNT(*) FILTER (WHERE kb IS NULL) AS deleted,
 COUNT(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL AND moved) AS moved,
 COUNT(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL AND NOT moved AND n > 0) AS updated,
 CAST(COALESCE(SUM(n) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL AND NOT moved), 0) AS BIGINT) AS updated_values,
 COUNT(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL AND n > 0) AS all_updated,
 CAST(COALESCE(SUM(n) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL), 0) AS BIGINT) AS all_values FROM j""")
def diff_describe_v0_v1(spark, sf_dir):
    from palimpsest.plans.compare import described

    return described(_orders(spark, sf_dir).diff(0, 1).rows())


@query(f"""{_WITH} SELECT o_orderkey AS row_key, 'INSERT' AS op FROM v0""")
def diff_unknown_version(spark, sf_dir):
    return _orders(spark, sf_dir).diff(-1, 0).rows().select(_key(), "op")


@query(f"""{_WITH} SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS row_key,
 CASE WHEN a.o_orderkey IS NULL THEN 'INSERT' WHEN b.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
FROM v1 a FULL OUTER JOIN v2 b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
 OR a.o_totalprice IS DISTINCT FROM b.o_price OR a.o_orderpriority IS NOT NULL OR b.o_orderdate IS NOT NULL""")
def diff_schema_change_v1_v2(spark, sf_dir):
    return _orders(spark, sf_dir).diff(1, 2, positions=False).rows().select(_key(), "op")


@query(f"""{_WITH} SELECT o_orderkey, MIN(v) AS from_version, MAX(v) AS to_version FROM
 (SELECT *, v - ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY v) AS grp FROM ({_EACH})) GROUP BY o_orderkey, grp""")
def row_lifetimes(spark, sf_dir):
    a = _orders(spark, sf_dir)
    return a.lifetimes().join(a.store.unsent(a.keys()), "rowid").select(_key("o_orderkey"), "from_version", "to_version")


@query(f"""{_WITH}, s AS (SELECT 0 AS v, o_orderkey, o_orderstatus FROM v0 UNION ALL SELECT 1, o_orderkey, o_orderstatus FROM v1
 UNION ALL SELECT 2, o_orderkey, o_orderstatus FROM v2 UNION ALL SELECT 3, o_orderkey, o_orderstatus FROM v0)
SELECT o_orderkey, o_orderstatus AS value, MIN(v) AS from_version, MAX(v) AS to_version FROM
 (SELECT *, v - ROW_NUMBER() OVER (PARTITION BY o_orderkey, o_orderstatus ORDER BY v) AS grp FROM s) GROUP BY o_orderkey, o_orderstatus, grp""")
def cell_history_status(spark, sf_dir):
    a = _orders(spark, sf_dir)
    return a.cell_history("o_orderstatus").join(a.store.unsent(a.keys()), "rowid").select(_key("o_orderkey"), "value", "from_version", "to_version")


@query(f"""{_WITH}, s AS ({_EACH}), f AS (SELECT o_orderkey, MIN(v) AS v FROM s GROUP BY o_orderkey)
SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY v, o_orderkey) - 1 AS rowid FROM f""")
def row_ids(spark, sf_dir):
    return _orders(spark, sf_dir).keys().select(_key("o_orderkey"), "rowid")


@query(f"""{_WITH}, s AS ({_EACH}) SELECT o_orderkey, COUNT(*) AS n_versions FROM s GROUP BY o_orderkey""")
def nested_row_versions(spark, sf_dir):
    spans = F.aggregate("versions", F.lit(0).cast("bigint"), lambda n, r: n + r["to_version"] - r["from_version"] + 1)
    return _orders(spark, sf_dir).rows().select(_key("o_orderkey"), spans.alias("n_versions"))


@query(f"""{_WITH} SELECT o_orderkey, pos FROM p2""")
def positions_v2(spark, sf_dir):
    return _orders(spark, sf_dir).checkout(2, position=True).select("o_orderkey", F.col("__pos").alias("pos"))


@query(f"""{_WITH} SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS nth FROM v1""")
def open_key_order(spark, sf_dir):
    """Rows numbered in the order in which ``open`` gives them."""
    rows = _orders(spark, sf_dir).open(1)
    numbered, _ = ranked(rows.select("o_orderkey"), [], _fresh(spark), "nth", 1)
    return numbered


def _fresh(spark: SparkSession) -> str:
    import uuid

    return f"{scratch_dir(spark)}/query-{uuid.uuid4().hex}"


@query(_V1)
def rollback_v1_then_checkout(spark, sf_dir):
    a = Archive.create(spark, None, _version(spark, sf_dir, 0), ["o_orderkey"])
    a.commit(_version(spark, sf_dir, 1))
    a.commit(_version(spark, sf_dir, 2), renamed={"o_totalprice": "o_price"})
    a.rollback(1)
    return a.checkout()


@query("""SELECT o_orderkey, o_custkey + 1 AS o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderstatus <> 'F'""")
def apply_increment_then_filter(spark, sf_dir):
    a = Archive.create(spark, None, _version(spark, sf_dir, 0).select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"])
    a.apply([Expressions(set={"o_custkey": "o_custkey + 1"}, description="increment"), Expressions(where="o_orderstatus <> 'F'", description="filter")])
    return a.checkout()


@query(f"""{_WITH} SELECT a.o_orderkey, lower(a.o_orderstatus) AS o_orderstatus, CAST(a.o_custkey * 2 AS BIGINT) AS twice FROM v0 a WHERE a.o_orderkey % 3 <> 0""")
def apply_row_function(spark, sf_dir):
    a = Archive.create(spark, None, _version(spark, sf_dir, 0).select("o_orderkey", "o_orderstatus", "o_custkey"), ["o_orderkey"])
    a.apply(RowFunction(lambda rowid, r: [r[0], r[1].lower(), r[2] * 2] if r[0] % 3 else None, ["o_orderkey", "o_orderstatus", "twice"], ["bigint", "string", "bigint"]))
    return a.checkout()


@query(f"""{_WITH} SELECT o_orderkey, o_orderstatus, pos FROM v0 JOIN p0 USING (o_orderkey) WHERE o_orderstatus <> 'O'""")
def apply_at_origin(spark, sf_dir):
    """An operator on an earlier version than the last; positions stay those of the origin."""
    a = Archive.create(spark, None, _version(spark, sf_dir, 0).select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    a.commit(_version(spark, sf_dir, 1).select("o_orderkey", "o_orderstatus"))
    a.apply(Expressions(where="o_orderstatus <> 'O'"), origin=0)
    return a.checkout(position=True).withColumnRenamed("__pos", "pos")


@query("""WITH base AS (SELECT ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS row_index, event_id FROM events WHERE event_id % 5 <> 0),
nw AS (SELECT (SELECT COUNT(*) FROM base) + ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS row_index, event_id FROM events WHERE event_id % 5 = 0)
SELECT * FROM base UNION ALL SELECT * FROM nw""")
def unkeyed_new_rows(spark, sf_dir):
    """Rows by index; those without one are new and get the next ones."""
    e = _table(spark, sf_dir, "events").select("event_id")
    a = Archive.create(spark, None, from_spark(e.where("event_id % 5 <> 0"), order_by="event_id"))
    first = a.checkout(row_id=True).select("event_id", F.col("__index").alias("i"))
    second = first.unionByName(e.where("event_id % 5 = 0").withColumn("i", F.lit(None).cast("bigint")))
    a.commit(from_spark(second, order_by="event_id", row_index="i"))
    return a.checkout(row_id=True).select(F.col("__index").alias("row_index"), "event_id")


@query(f"""{_WITH} SELECT o_orderkey, o_orderstatus, pos FROM v0 JOIN p0 USING (o_orderkey)""")
def restored_version(spark, sf_dir):
    """An earlier version made once more, with its rows' identity and positions."""
    a = Archive.create(spark, None, _version(spark, sf_dir, 0).select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    a.commit(_version(spark, sf_dir, 1).select("o_orderkey", "o_orderstatus"))
    a.restore(0)
    return a.checkout(position=True).withColumnRenamed("__pos", "pos")


@query(f"""{_WITH} SELECT a.o_orderstatus AS was, b.o_orderstatus AS became, COUNT(*) AS n, CAST(COUNT(DISTINCT a.o_custkey) AS BIGINT) AS customers
FROM v0 a JOIN v1 b ON a.o_orderkey = b.o_orderkey GROUP BY 1, 2""")
def sql_over_versions(spark, sf_dir):
    """Spark SQL over versions registered as views."""
    _orders(spark, sf_dir).register("archived_orders", [0, 1])
    return spark.sql("""SELECT /*+ MERGE(b) */ a.o_orderstatus AS was, b.o_orderstatus AS became, COUNT(*) AS n, COUNT(DISTINCT a.o_custkey) AS customers
        FROM archived_orders_v0 a JOIN archived_orders_v1 b ON a.o_orderkey = b.o_orderkey GROUP BY 1, 2""")


@query(f"""{_WITH}, j AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, a.o_totalprice AS pa, b.o_price AS pb FROM v0 a FULL OUTER JOIN v2 b ON a.o_orderkey = b.o_orderkey)
SELECT COUNT(*) FILTER (WHERE ka IS NULL) AS inserted, COUNT(*) FILTER (WHERE kb IS NULL) AS deleted FROM j""")
def diff_far_versions(spark, sf_dir):
    """A difference across several versions and a change of columns."""
    rows = _orders(spark, sf_dir).diff(0, 2, positions=False).rows()
    return rows.agg(F.count_if(F.col("op") == "INSERT").alias("inserted"), F.count_if(F.col("op") == "DELETE").alias("deleted"))


_LINES = "ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS occ FROM lineitem"
_LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"""WITH a AS (SELECT *, {_LINES} WHERE l_partkey % 3 <> 0), b AS (SELECT *, {_LINES} WHERE l_partkey % 4 <> 0)
SELECT COALESCE(a.l_orderkey, b.l_orderkey) AS l_orderkey, COALESCE(a.l_linenumber, b.l_linenumber) AS l_linenumber, CAST(COALESCE(a.occ, b.occ) AS BIGINT) AS occ,
 CASE WHEN a.occ IS NULL THEN 'INSERT' WHEN b.occ IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
FROM a FULL OUTER JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.occ = b.occ
WHERE a.occ IS NULL OR b.occ IS NULL OR (a.l_partkey, a.l_suppkey, a.l_quantity, a.l_extendedprice, a.l_discount, a.l_tax, a.l_returnflag, a.l_linestatus, a.l_shipdate)
 IS DISTINCT FROM (b.l_partkey, b.l_suppkey, b.l_quantity, b.l_extendedprice, b.l_discount, b.l_tax, b.l_returnflag, b.l_linestatus, b.l_shipdate)""")
def duplicate_keys_lineitem(spark, sf_dir):
    """A key that isn't unique: rows pair up by occurrence."""
    rows = _table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", *_LINE_ORDER]
    a = Archive.create(spark, None, from_spark(rows.where("l_partkey % 3 <> 0"), order_by=order), ["l_orderkey", "l_linenumber"])
    a.commit(from_spark(rows.where("l_partkey % 4 <> 0"), order_by=order))
    changes = a.diff(0, 1, positions=False).rows().join(a.store.unsent(a.keys().select("rowid", "occ")), "rowid")
    return changes.select(F.col("key")[0]["whole"].alias("l_orderkey"), F.col("key")[1]["whole"].cast("int").alias("l_linenumber"), F.col("occ").cast("bigint").alias("occ"), "op")


@query("""WITH a AS (SELECT NULLIF(o_orderkey % 50, 0) AS k, MIN(o_orderkey) AS val FROM orders GROUP BY 1),
b AS (SELECT NULLIF(o_orderkey % 50, 0) AS k, MAX(o_orderkey) AS val FROM orders WHERE o_orderkey % 50 < 40 GROUP BY 1)
SELECT COALESCE(a.k, b.k) AS row_key, a.val AS old_value, b.val AS new_value, CASE WHEN b.val IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k WHERE a.val IS DISTINCT FROM b.val""")
def null_keys(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumn("k", F.nullif(F.col("o_orderkey") % 50, F.lit(0)))
    a = Archive.create(spark, None, o.groupBy("k").agg(F.min("o_orderkey").alias("val")), ["k"])
    a.commit(o.where("o_orderkey % 50 < 40").groupBy("k").agg(F.max("o_orderkey").alias("val")))
    old = a.checkout(0, row_id=True).select("__index", "k", F.col("val").alias("old_value"))
    new = a.checkout(1, row_id=True).select("__index", F.col("val").alias("new_value"))
    ops = a.diff(0, 1, positions=False).rows().select(F.col("rowid").alias("__index"), "op")
    return ops.join(old, "__index").join(new, "__index", "left").select(F.col("k").alias("row_key"), "old_value", "new_value", "op")


@query("""SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderpriority, o_orderstatus, o_orderkey) - 1 AS pos FROM orders""")
def sorted_document(spark, sf_dir):
    """Rows numbered in the order in which a sorted document has them."""
    doc = from_spark(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"))
    rows, _ = ranked(doc.sorted(["o_orderpriority", "o_orderstatus", "o_orderkey"]).named(), [], _fresh(spark), "pos")
    return rows.select("o_orderkey", "pos")


def _customers(spark, sf_dir) -> Archive:
    return Archive.create(spark, None, _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), ["c_custkey"])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, NULLIF(CAST(c_nationkey AS VARCHAR), '7') AS c_nationkey, c_mktsegment, c_custkey % 3 = 0 AS in_two_lines FROM customer""")
def csv_roundtrip(spark, sf_dir):
    """A version written as compressed TSV and read again as a document: header, nulls, and values that go over two lines."""
    path = f"{_fresh(spark)}.tsv"
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("\n\"end\""))).otherwise(F.col("c_name")).alias("c_name"), F.nullif("c_nationkey", F.lit(7)).alias("c_nationkey"), "c_mktsegment")
    write_csv(Archive.create(spark, None, rows, ["c_custkey"]).document(), path, none_as="\\N", gzip=True)
    back = from_csv(spark, path, none_is="\\N").named()
    return back.select("c_custkey", F.regexp_replace("c_name", "\n\"end\"$", "").alias("c_name"), "c_nationkey", "c_mktsegment", F.col("c_name").endswith("\n\"end\"").alias("in_two_lines"))


@query("""SELECT c_custkey, c_name, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer""")
def csv_positions(spark, sf_dir):
    """A plain CSV file with skipped lines and a header, split over many tasks; rows have the order of the file."""
    path = f"{_fresh(spark)}.csv"
    rows = _table(spark, sf_dir, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_name")).alias("value"), F.col("c_custkey").alias("k"))
    lead = spark.createDataFrame([("# made by the bank", -3), ("# two lines", -2), ("c_custkey,c_name", -1)], "value string, k long")
    rows.union(lead).orderBy("k").select("value").write.text(path)
    doc = from_csv(spark, path, skip_lines=2, infer=True)
    return doc.df.select(F.col("v_0").alias("c_custkey"), F.col("v_1").alias("c_name"), F.col("__pos").alias("pos"))


@query("""SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code, c_acctbal AS balance, c_nationkey > 12 AS far FROM customer""")
def json_typed(spark, sf_dir):
    """A JSON document whose cells keep their types without being told: text of digits stays text."""
    path = f"{_fresh(spark)}.json"
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"), F.col("c_acctbal").alias("balance"), (F.col("c_nationkey") > 12).alias("far"))
    write_json(Archive.create(spark, None, rows, ["c_custkey"]).document(), path)
    copy = from_json(spark, path)
    copy.columns = [str(c) for c in copy.columns]
    return Archive.create(spark, None, copy, ["c_custkey"]).checkout()


@query("""SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer""")
def json_document_roundtrip(spark, sf_dir):
    """A version written as a JSON-lines document, committed to another archive and checked out."""
    path = f"{_fresh(spark)}.json"
    write_json(_customers(spark, sf_dir).document(), path)
    copy = from_json(spark, path, {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "c_mktsegment": "string"})
    copy.columns = [str(c) for c in copy.columns]
    return Archive.create(spark, None, copy, ["c_custkey"]).checkout()


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def csv_document_commit(spark, sf_dir):
    """A CSV file committed as a document whose types are inferred."""
    path = f"{_fresh(spark)}.csv"
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows.write.option("header", False).csv(path)
    doc = from_csv(spark, path, header=["c_custkey", "c_name", "c_mktsegment"], infer=True)
    return Archive.create(spark, None, doc, ["c_custkey"]).checkout()


@query(f"""{_WITH} SELECT o_orderkey, o_orderstatus, o_custkey, o_price, o_orderdate FROM v2""")
def at_time(spark, sf_dir):
    return _orders(spark, sf_dir).at_time(datetime(2024, 3, 15))


@query(f"""{_WITH} SELECT 0 AS version, COUNT(*) AS n_rows FROM v0 UNION ALL SELECT 1, COUNT(*) FROM v1 UNION ALL SELECT 2, COUNT(*) FROM v2 UNION ALL SELECT 3, COUNT(*) FROM v0""")
def snapshot_list(spark, sf_dir):
    """Each snapshot with the number of rows alive in it, from one pass over the segments."""
    a = _orders(spark, sf_dir)
    versions = F.explode(F.sequence("from_version", "to_version")).alias("version")
    counts = a.lifetimes().select(versions).groupBy("version").agg(F.count("*").alias("n_rows"))
    return a.snapshots_df().select("version").join(counts, "version")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0""")
def reloaded_archive(spark, sf_dir):
    """A persistent archive, opened again by another handle."""
    path = _fresh(spark)
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    Archive.create(spark, path, o, ["o_orderkey"]).commit(o.where("o_orderkey % 2 = 0"))
    a = Archive(Store(spark, path).load())
    return a.checkout()


@query("""SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def streamed_commits(spark, sf_dir):
    """Micro-batches of a stream of events, each committed as a version that adds to the last."""
    from palimpsest.streaming.ingest import ingest_once

    path = _fresh(spark)
    source = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    a = ingest_once(source.select("event_id", "event_type", "user_id"), path, ["event_id"])
    return a.checkout().groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"""{_WITH} SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'INSERT' WHEN b.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
FROM v0 a FULL OUTER JOIN v1 b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def decimal_keys(spark, sf_dir):
    """Keys that a double can't tell apart."""
    big = 9007199254740992
    side = lambda v: _version(spark, sf_dir, v).select((F.col("o_orderkey") + F.lit(big)).cast("decimal(38,0)").alias("k"), "o_orderstatus")
    a = Archive.create(spark, None, side(0), ["k"])
    a.commit(side(1))
    return a.diff(0, 1, positions=False).rows().select((F.col("key")[0]["whole"] - big).alias("o_orderkey"), "op")


@query(f"""{_WITH} SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'INSERT' WHEN b.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
FROM v0 a FULL OUTER JOIN v1 b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def timestamp_keys(spark, sf_dir):
    """Instants as keys, over an hour that a clock shows twice, committed from sessions in two zones."""
    begin, zone = 1699156800, spark.conf.get("spark.sql.session.timeZone")
    side = lambda v: _version(spark, sf_dir, v).select(F.timestamp_seconds(F.col("o_orderkey") + F.lit(begin)).alias("k"), "o_orderstatus")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        a = Archive.create(spark, None, side(0), ["k"])
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        a.commit(side(1))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return a.diff(0, 1, positions=False).rows().select((F.col("key")[0]["whole"] / 1_000_000 - begin).cast("bigint").alias("o_orderkey"), "op")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + 9007199254740992 END AS v FROM orders""")
def row_function_nulls(spark, sf_dir):
    """Whole numbers beside nulls stay whole in a Python row function."""
    o = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + 9007199254740991 END AS v")
    a = Archive.create(spark, None, o, ["o_orderkey"])
    a.apply(RowFunction(lambda rowid, r: [r[0], None if r[1] is None else r[1] + 1], ["o_orderkey", "v"], ["bigint", "bigint"]))
    return a.checkout()


@query("""SELECT o_orderkey, o_orderstatus, pos FROM (
 SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 7 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderkey % 10 <> 0
 UNION ALL SELECT o_orderkey, 'N', (SELECT COUNT(*) FROM orders WHERE o_orderkey % 10 <> 0) + ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 FROM orders WHERE o_orderkey % 100 = 0)""")
def upserted_rows(spark, sf_dir):
    """A few rows merged into a version: those with a known key in their place, the others after all."""
    o = _table(spark, sf_dir, "orders")
    a = Archive.create(spark, None, o.where("o_orderkey % 10 <> 0").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    a.upsert(o.where("o_orderkey % 100 IN (0, 7)").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 100 = 0 THEN 'N' ELSE 'U' END AS o_orderstatus"))
    return a.checkout(position=True).withColumnRenamed("__pos", "pos")


@query("""SELECT * FROM (VALUES (1, 'UPDATE', NULL, NULL, 1, 2), (2, 'UPDATE', NULL, NULL, 2, 1), (3, 'UPDATE', 'o_totalprice', 'o_price', NULL, NULL), (4, 'DELETE', NULL, NULL, NULL, NULL), (5, 'INSERT', NULL, NULL, NULL, NULL))
 AS t(colid, op, old_name, new_name, old_pos, new_pos) WHERE (SELECT COUNT(*) FROM orders) > 0""")
def diff_schema_v1_v2(spark, sf_dir):
    """What happened to the columns from version 1 to version 2."""
    found = _orders(spark, sf_dir).diff(1, 2).schema()
    names = ["colid", "op", "old_name", "new_name", "old_pos", "new_pos"]
    return spark.createDataFrame([tuple(c[n] for n in names) for c in found], "colid int, op string, old_name string, new_name string, old_pos int, new_pos int")


@query("""SELECT o_orderkey, o_orderstatus, pos FROM (
 SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 7 THEN 'second' ELSE o_orderstatus END AS o_orderstatus, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderkey % 10 <> 0
 UNION ALL SELECT o_orderkey, 'second', (SELECT COUNT(*) FROM orders WHERE o_orderkey % 10 <> 0) + ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 FROM orders WHERE o_orderkey % 100 = 0)""")
def upserted_repeats(spark, sf_dir):
    """Given rows of equal key: the last one counts, also in a further upsert of the same keys."""
    o = _table(spark, sf_dir, "orders")
    a = Archive.create(spark, None, o.where("o_orderkey % 10 <> 0").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    some = o.where("o_orderkey % 100 IN (0, 7)")
    for names in (("zero", "first"), ("third", "second")):
        given = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("o_orderstatus")) for i, n in enumerate(names)])).alias("s")
        doc = from_spark(some.select("o_orderkey", given).select("o_orderkey", "s.o_orderstatus", "s.i"), order_by=["i", "o_orderkey"])
        a.upsert(doc.select(["o_orderkey", "o_orderstatus"]))
    return a.checkout(position=True).withColumnRenamed("__pos", "pos")


@query("""SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def two_streams(spark, sf_dir):
    """Two streams, each with its own checkpoint, that commit to one archive in turn; each is started again at the end."""
    from palimpsest.streaming.ingest import ingest_once

    path = _fresh(spark)
    events = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").select("event_id", "event_type", "user_id")
    for part in (0, 1, 0, 1):
        a = ingest_once(events.where(F.col("event_id") % 2 == part), path, ["event_id"], checkpoint=f"{path}-stream-{part}")
    return a.checkout().groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


_FLAGGED = "ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_linestatus) AS occ FROM lineitem"


@query(f"""WITH a AS (SELECT l_returnflag, l_orderkey, l_linenumber, {_FLAGGED} WHERE l_partkey % 3 <> 0), b AS (SELECT l_returnflag, l_orderkey, l_linenumber, {_FLAGGED} WHERE l_partkey % 4 <> 0)
SELECT COALESCE(a.l_returnflag, b.l_returnflag) AS l_returnflag, COALESCE(a.occ, b.occ) AS occ, CASE WHEN a.occ IS NULL THEN 'INSERT' WHEN b.occ IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
FROM a FULL OUTER JOIN b ON a.l_returnflag = b.l_returnflag AND a.occ = b.occ
WHERE a.occ IS NULL OR b.occ IS NULL OR (a.l_orderkey, a.l_linenumber) IS DISTINCT FROM (b.l_orderkey, b.l_linenumber)""")
def hot_duplicate_key(spark, sf_dir):
    """A key of three values that a third of all rows or more have each: their occurrences are numbered in chunks."""
    rows = _table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", *(c for c in _LINE_ORDER if c != "l_returnflag")]
    side = lambda n: from_spark(rows.where(F.col("l_partkey") % n != 0), order_by=order).select(["l_returnflag", "l_orderkey", "l_linenumber"])
    a = Archive.create(spark, None, side(3), ["l_returnflag"])
    a.commit(side(4))
    changes = a.diff(0, 1, positions=False).rows().join(a.store.unsent(a.keys().select("rowid", "occ")), "rowid")
    return changes.select(F.col("key")[0]["str"].alias("l_returnflag"), F.col("occ").cast("bigint").alias("occ"), "op")


@query(f"""{_WITH} SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderstatus AS was, b.o_orderstatus AS became
FROM v0 a FULL OUTER JOIN v1 b ON a.o_orderkey = b.o_orderkey""")
def imported_archive(spark, sf_dir):
    """Two versions kept as JSON files, a line for each row with its versions and its cells' versions, imported and compared."""
    import json

    from palimpsest.sources.files import Files
    from palimpsest.sources.imports import import_archive

    path, key = _fresh(spark), F.col("o_orderkey")
    old, new = F.col("o_orderstatus"), F.when(key % 5 == 1, "X").otherwise(F.col("o_orderstatus"))
    before, after = key % 10 != 0, key % 7 != 0
    held = F.when(before & after, "[[0, 1]]").when(before, "[[0, 0]]").otherwise("[[1, 1]]")
    both = F.format_string('[{"t": [[0, 0]], "v": "%s"}, {"t": [[1, 1]], "v": "%s"}]', old, new)
    cell = F.when(before & after & (old != new), both).otherwise(F.format_string('{"v": "%s"}', F.when(before, old).otherwise(new)))
    line = F.format_string('{"r": %d, "k": %d, "t": %s, "p": {"v": %d}, "c": {"0": {"v": %d}, "1": %s}}', key, key, held, key, key, cell)
    _table(spark, sf_dir, "orders").where(before | after).select(line.alias("value")).write.text(f"{path}/rows.dat")
    columns = [{"c": k, "t": [[0, 1]], "n": {"v": n}, "p": {"v": k}} for k, n in enumerate(("o_orderkey", "o_orderstatus"))]
    snapshots = [{"v": v, "vt": f"2024-01-0{v + 1}T00:00:00", "tt": f"2024-01-0{v + 1}T00:00:00", "d": ""} for v in (0, 1)]
    Files(spark).create(f"{path}/metadata.dat", json.dumps({"schema": columns, "snapshots": snapshots}))
    a = import_archive(spark, path)
    was, became = (a.checkout(v, row_id=True).select(F.col("__index").alias("o_orderkey"), F.col("o_orderstatus").alias(n)) for v, n in ((0, "was"), (1, "became")))
    return was.join(became, "o_orderkey", "full_outer")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of version 1 with what happened to them since version 0."""
    a = _orders(spark, sf_dir, 3)
    changes = a.diff(0, 1).rows().select(F.col("key")[0]["whole"].alias("o_orderkey"), "op", F.size("cells").alias("n_cells"), "old_pos", "new_pos")
    return a.checkout(1).join(changes, "o_orderkey", "left")
