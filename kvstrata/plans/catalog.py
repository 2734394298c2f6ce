"""Registered queries over the driver's tables, each with the SQL it must agree with.

Binary columns are shown as hex strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.functions import codec, keys
from kvstrata.functions.keys import literal_key, make_key
from kvstrata.operators import documents, mvcc, navigation, points
from kvstrata.plans.store import Store
from kvstrata.sources.log import KV, LOG, documents_kv, events_log, nations_kv, orders_kv, write_sorted
from kvstrata.sources.shipping import passing_folder

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = 600


def shown(df: DataFrame) -> DataFrame:
    return df.select(*(F.hex(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes))


def hidden() -> range:
    """Transactions of the events log taken as running or rolled back."""
    return range(0, 1_000_000_000, 7)


def without_hidden(log: DataFrame, own: int | None = None) -> DataFrame:
    """The same rule as a predicate: every seventh transaction."""
    keep = F.col("txid") % 7 != 0
    return log.where(keep if own is None else keep | (F.col("txid") == own))


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, make: Query, schema: str) -> DataFrame:
    """A table in files sorted by key, written when an application first asks for it, so that ranges of keys are looked up
    and not searched for."""
    name = (spark.sparkContext.applicationId, sf_dir, make.__name__)
    if name not in _stored:
        path = f"{passing_folder(spark, make.__name__)}/table"
        write_sorted(make(spark, sf_dir), path, *(["key", "seq"] if schema == LOG else ["key"]))
        _stored[name] = path
    return spark.read.schema(schema).parquet(_stored[name])


def orders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, orders_kv, KV)


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events log's state with hidden transactions left out."""
    return mvcc.newest(without_hidden(stored(spark, sf_dir, events_log, LOG))).where("NOT is_tombstone").select("key", "value")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all customers as users: some have events, most don't."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(make_key(F.lit("user"), F.col("c_custkey").cast("string")).alias("key"))


def _bytes_sql(x: str) -> str:
    return f"(unhex(lpad(to_hex(octet_length(encode({x}))),2,'0')) || encode({x}))"


def _key_sql(*parts: str) -> str:
    return " || ".join(_bytes_sql(p) for p in parts)


EVENTS = f"""ev AS (SELECT {_key_sql("'user'", "CAST(user_id AS VARCHAR)")} AS key, event_id AS seq, event_id // 10 + 1 AS txid, event_type = 'error' AS is_tombstone,
    CASE WHEN event_type <> 'error' THEN encode(event_type || ':' || CAST(event_id AS VARCHAR)) END AS value FROM events)"""


def _newest_sql(where: str) -> str:
    return f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM ev WHERE {where}) WHERE n = 1 AND NOT is_tombstone"


CURRENT = f"WITH {EVENTS}, cur AS ({_newest_sql('txid % 7 <> 0')})"
ASKED = f"{CURRENT}, asked AS (SELECT {_key_sql("'user'", 'CAST(c_custkey AS VARCHAR)')} AS key FROM customer)"
ORDERS = f"WITH kv AS (SELECT {_key_sql("'customer'", 'CAST(o_custkey AS VARCHAR)', "'order'", 'CAST(o_orderkey AS VARCHAR)')} AS key, encode(o_orderstatus) AS value, o_custkey AS cust FROM orders)"
NATIONS = f"WITH kv AS (SELECT {_key_sql("'region'", 'r_name', "'nation'", 'n_name')} AS key, encode(CAST(n_nationkey AS VARCHAR)) AS value FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _lit(key: bytes) -> str:
    return f"unhex('{key.hex()}')"


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


USER7 = literal_key("user", 7)


@query(f"{CURRENT} SELECT hex(key) AS key, hex(value) AS value FROM cur WHERE key = {_lit(USER7)}")
def get_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(points.get(current(spark, sf_dir), USER7))


@query(f"{ASKED} SELECT hex(key) AS key, hex(value) AS value FROM cur JOIN asked USING (key)")
def get_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(points.multi_get(current(spark, sf_dir), users(spark, sf_dir)))


@query(f"{ASKED} SELECT hex(a.key) AS key, hex(CASE WHEN c.key IS NULL THEN encode('none') ELSE value END) AS value FROM asked a LEFT JOIN cur c ON a.key = c.key")
def get_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(points.get_default(current(spark, sf_dir), users(spark, sf_dir), b"none"))


@query(f"{ASKED} SELECT hex(a.key) AS key, c.key IS NOT NULL AS found FROM asked a LEFT JOIN cur c ON a.key = c.key")
def exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(points.exists(current(spark, sf_dir), users(spark, sf_dir)))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nodes, their orders nodes and one order each."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("c"))
    nodes = F.array(make_key(F.lit("customer"), F.col("c")), make_key(F.lit("customer"), F.col("c"), F.lit("order")), make_key(F.lit("customer"), F.col("c"), F.lit("order"), F.col("c")))
    return c.select(F.explode(nodes).alias("key"))


PROBES = f"""p AS (SELECT {_key_sql("'customer'", 'CAST(c_custkey AS VARCHAR)')} AS key, 1 AS level, c_custkey AS c FROM customer
    UNION ALL SELECT {_key_sql("'customer'", 'CAST(c_custkey AS VARCHAR)', "'order'")}, 2, c_custkey FROM customer
    UNION ALL SELECT {_key_sql("'customer'", 'CAST(c_custkey AS VARCHAR)', "'order'", 'CAST(c_custkey AS VARCHAR)')}, 3, c_custkey FROM customer)"""


@query(f"{ORDERS}, {PROBES} SELECT hex(key) AS key, CASE WHEN level < 3 THEN CASE WHEN c IN (SELECT cust FROM kv) THEN 1 ELSE 0 END ELSE CASE WHEN key IN (SELECT key FROM kv) THEN 10 ELSE 0 END END AS shape FROM p")
def data_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(points.shape(orders_table(spark, sf_dir), _probes(spark, sf_dir)))


@query(f"{ORDERS}, {PROBES} SELECT hex(key) AS key, CASE WHEN key IN (SELECT key FROM kv) THEN 10 ELSE 0 END AS shape FROM p")
def data_shape_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(points.shape(orders_table(spark, sf_dir), _probes(spark, sf_dir), faithful=True))


@query(f"WITH kv AS (SELECT {_key_sql("'doc'", 'source', 'lang', 'CAST(doc_id AS VARCHAR)')} AS key, encode(text) AS value FROM documents WHERE text IS NOT NULL) SELECT hex(key) AS key, octet_length(value) AS size FROM kv")
def value_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(points.value_sizes(documents_kv(spark, sf_dir)))


CUSTOMER7 = literal_key("customer", 7)


@query(f"{ORDERS} SELECT hex(key) AS key, hex(value) AS value FROM kv WHERE cust = 7")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.prefix_scan(orders_table(spark, sf_dir), CUSTOMER7))


@query(f"{ORDERS} SELECT hex(key) AS key FROM kv WHERE cust = 7")
def prefix_scan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(points.key_only(navigation.prefix_scan(orders_table(spark, sf_dir), CUSTOMER7)))


LOW, HIGH = literal_key("customer", 10), literal_key("customer", 50)


@query(f"{ORDERS} SELECT hex(key) AS key, hex(value) AS value FROM kv WHERE key >= {_lit(LOW)} AND key < {_lit(HIGH)}")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.range_scan(orders_table(spark, sf_dir), LOW, HIGH))


@query(f"{ORDERS} SELECT hex(key) AS key, hex(value) AS value FROM kv WHERE key >= {_lit(keys.successor(CUSTOMER7))} ORDER BY key LIMIT 1")
def skip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.skip_prefix(orders_table(spark, sf_dir), CUSTOMER7))


@query(f"{CURRENT} SELECT hex(min(key)) AS key FROM cur")
def first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.first_key(current(spark, sf_dir)))


@query(f"{CURRENT} SELECT hex(max(key)) AS key FROM cur")
def last_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.last_key(current(spark, sf_dir)))


@query(f"{CURRENT} SELECT hex(min(key)) AS key FROM cur WHERE key > {_lit(USER7)}")
def next_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.next_key(current(spark, sf_dir), USER7))


@query(f"{CURRENT} SELECT hex(max(key)) AS key FROM cur WHERE key < {_lit(USER7)}")
def prev_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.prev_key(current(spark, sf_dir), USER7))


@query(f"{ORDERS} SELECT hex(key) AS key, hex(lag(key) OVER (ORDER BY key)) AS prev_key, hex(lead(key) OVER (ORDER BY key)) AS next_key FROM kv")
def neighbours_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.neighbours(orders_table(spark, sf_dir)))


@query(f"{ASKED} SELECT hex(a.key) AS key, hex((SELECT max(key) FROM cur WHERE cur.key < a.key)) AS prev_key, hex((SELECT min(key) FROM cur WHERE cur.key > a.key)) AS next_key FROM asked a")
def neighbours_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.neighbours_of(current(spark, sf_dir), users(spark, sf_dir)))


@query(f"{NATIONS} SELECT 'region.' || r_name || '.nation.' || n_name AS path, hex(encode(CAST(n_nationkey AS VARCHAR))) AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def query_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.query(nations_kv(spark, sf_dir), "region"))


@query(f"{NATIONS} SELECT hex(key) AS key FROM kv WHERE hex(key) LIKE '{literal_key('region', 'ASIA').hex().upper()}%'")
def query_raw_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.query_raw(nations_kv(spark, sf_dir), literal_key("region", "ASIA")))


@query(f"{CURRENT} SELECT count(*) AS n FROM cur")
def count_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.count_visible(current(spark, sf_dir))


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def count_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.count_indexed(events_log(spark, sf_dir))


@query(f"{ORDERS} SELECT count(*) AS n FROM kv WHERE cust = 7")
def count_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.count_by_prefix(orders_table(spark, sf_dir), CUSTOMER7)


@query("SELECT 'customer.' || CAST(o_custkey AS VARCHAR) AS \"group\", count(*) AS n FROM orders GROUP BY o_custkey")
def count_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.count_by_part(orders_table(spark, sf_dir), 2)


@query(f"{ORDERS} SELECT hex(key) AS key, 4 AS n_parts FROM kv")
def subscript_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.subscript_counts(orders_table(spark, sf_dir)))


@query(f"WITH {EVENTS} SELECT hex(key) AS key, hex(value) AS value FROM ({_newest_sql(f'txid <= {AS_OF}')})")
def visible_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(mvcc.visible(events_log(spark, sf_dir), AS_OF))


@query(f"WITH {EVENTS} SELECT hex(key) AS key, hex(value) AS value FROM ({_newest_sql(f'txid <= {AS_OF} AND (txid % 7 <> 0 OR txid = {AS_OF})')})")
def visible_with_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [t for t in hidden()[: AS_OF // 7 + 1]]
    return shown(mvcc.visible(events_log(spark, sf_dir), AS_OF, ids))


@query(f"WITH {EVENTS} SELECT hex(key) AS key, hex(value) AS value FROM ({_newest_sql(f'txid <= {AS_OF} AND txid % 7 <> 0')})")
def visible_wide_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return shown(mvcc.visible(log, AS_OF, log.where("txid % 7 = 0").select("txid").distinct(), wide=True))


def _states(log: DataFrame) -> DataFrame:
    return log.select("txid", F.when(F.col("txid") % 7 == 0, "ROLLED_BACK").otherwise("COMMITTED").alias("state")).distinct()


@query(f"WITH {EVENTS} SELECT hex(key) AS key, hex(value) AS value FROM ({_newest_sql('txid % 7 <> 0')})")
def rolled_back_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return shown(mvcc.snapshot(log, _states(log)))


OWN = 595


@query(f"WITH {EVENTS} SELECT hex(key) AS key, hex(value) AS value FROM ({_newest_sql(f'txid <= {OWN} AND (txid % 7 <> 0 OR txid = {OWN})')})")
def own_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(mvcc.visible(events_log(spark, sf_dir), OWN, hidden()[: OWN // 7 + 1]))


@query(f"WITH {EVENTS} SELECT hex(key) AS key, CAST(row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS INTEGER) AS n, txid, is_tombstone, hex(value) AS value FROM ev")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(mvcc.versions(events_log(spark, sf_dir)))


@query(f"WITH {EVENTS} SELECT hex(key) AS key, count(*) AS n_versions, count(*) FILTER (is_tombstone) AS n_deletes FROM ev GROUP BY key")
def version_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(mvcc.version_counts(events_log(spark, sf_dir)))


@query(f"WITH {EVENTS} SELECT DISTINCT hex(key) AS key FROM ev WHERE txid = 42")
def has_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(mvcc.written_by(events_log(spark, sf_dir), 42))


@query(f"WITH {EVENTS}, g AS (SELECT *, max(seq) OVER (PARTITION BY key) AS last FROM ev) SELECT hex(key) AS key, seq, txid, is_tombstone, hex(value) AS value FROM g WHERE seq = last OR (txid NOT IN (300, 599) AND txid <= 599)")
def gc_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(mvcc.prune(events_log(spark, sf_dir), [300, 599])).select("key", "seq", "txid", "is_tombstone", "value")


@query(f"WITH {EVENTS} SELECT hex(key) AS key, hex(value) AS value FROM ({_newest_sql('txid % 7 <> 0')})")
def replay_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each write is a record of its transaction, which all but every seventh commit."""
    log = events_log(spark, sf_dir)
    work = log.select(F.when(F.col("is_tombstone"), "DELETE").otherwise("UPDATE").alias("kind"), "txid", "key", "value", F.col("seq").alias("lsn"))
    ends = log.groupBy("txid").agg((F.max("seq") + 1).alias("lsn")).select(F.when(F.col("txid") % 7 == 0, "ABORT").otherwise("COMMIT").alias("kind"), "txid", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"), "lsn")
    return shown(mvcc.replay(work.unionByName(ends)))


@query("SELECT max(event_id // 10 + 1) + 1 AS next_txid FROM events WHERE (event_id // 10 + 1) % 7 <> 0")
def next_txid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = events_log(spark, sf_dir).select(F.when(F.col("txid") % 7 == 0, "ABORT").otherwise("COMMIT").alias("kind"), "txid")
    return mvcc.next_txid(ends)


@query(f"WITH {EVENTS}, asked AS (SELECT {_key_sql("'user'", 'CAST(c_custkey AS VARCHAR)')} AS key FROM customer) SELECT DISTINCT hex(key) AS key, txid AS holder FROM ev JOIN asked USING (key) WHERE txid IN (7, 14, 21)")
def lock_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(mvcc.conflicts(events_log(spark, sf_dir), users(spark, sf_dir), 35, [7, 14, 21, 35]))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.concat_ws("/", "p_brand", F.translate("p_name", " ", "/"), "p_type").alias("path"))


PATHS = "WITH p AS (SELECT p_partkey, p_brand || '/' || replace(p_name, ' ', '/') || '/' || p_type AS path FROM part), s AS (SELECT p_partkey, path, string_split(path, '/') AS parts FROM p)"
_PART_HEX = "lpad(to_hex(octet_length(encode(x))),2,'0') || hex(encode(x))"


@query(f"{PATHS} SELECT p_partkey, list_aggregate(list_transform(parts, lambda x: {_PART_HEX}), 'string_agg', '') AS key FROM s")
def key_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_paths(spark, sf_dir).select("p_partkey", keys.key_split("path", "/").alias("key")))


@query(f"{PATHS} SELECT p_partkey, array_to_string(parts, '|') AS parts, CAST(len(parts) AS INTEGER) AS n_parts FROM s")
def key_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _paths(spark, sf_dir).select("p_partkey", keys.key_split("path", "/").alias("key"))
    parts = keys.decode_strings("key")
    return coded.select("p_partkey", F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n_parts"))


@query(f"{PATHS} SELECT p_partkey, array_to_string(parts, '.') AS path, CAST(len(parts) AS INTEGER) AS n_parts FROM s")
def key_unsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _paths(spark, sf_dir).select("p_partkey", keys.key_split("path", "/").alias("key"))
    return coded.select("p_partkey", keys.key_unsplit("key", ".").alias("u")).select("p_partkey", "u.path", "u.n_parts")


@query(f"{ORDERS} SELECT DISTINCT hex({_key_sql("'customer'", 'CAST(cust AS VARCHAR)')}) AS key FROM kv")
def key_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(orders_table(spark, sf_dir).select(keys.ancestor("key", 2).alias("key")).distinct())


@query(f"{NATIONS} SELECT hex(key || {_bytes_sql("'name'")}) AS key FROM kv")
def key_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(nations_kv(spark, sf_dir).select(keys.child("key", F.lit("name")).alias("key")))


@query(f"{NATIONS} SELECT hex(key) AS key, r_name AS second, octet_length({_key_sql("'region'", 'r_name')}) AS third_at, r_name = 'ASIA' AS in_asia FROM (SELECT *, {_key_sql("'region'", 'r_name', "'nation'", 'n_name')} AS key FROM nation JOIN region ON n_regionkey = r_regionkey)")
def subscript_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(nations_kv(spark, sf_dir).select("key", keys.extract_subscript("key", 1).cast("string").alias("second"), keys.subscript_offset("key", 2).cast("bigint").alias("third_at"), keys.subscript_equal("key", 1, "ASIA").alias("in_asia")))


_LE8 = " || ".join(f"substr(h, {k}, 2)" for k in range(15, 0, -2))


@query(f"SELECT o_orderkey, '02' || {_LE8} AS subscript, o_orderkey AS back FROM (SELECT o_orderkey, lpad(upper(to_hex(o_orderkey)), 16, '0') AS h FROM orders)")
def int_subscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = keys.integer_subscript(F.col("o_orderkey"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.hex(s).alias("subscript"), keys.decode_integer_subscript(s).alias("back"))


@query("SELECT p_partkey, CASE WHEN octet_length(encode(t)) < 128 THEN lpad(to_hex(octet_length(encode(t))),2,'0') ELSE 'FF' || lpad(to_hex(octet_length(encode(t))),4,'0') END || hex(encode(t)) AS key, octet_length(encode(t)) AS n FROM (SELECT p_partkey, repeat(p_name, CAST(p_partkey % 20 + 1 AS INTEGER)) AS t FROM part)")
def tuple_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr("repeat(p_name, CAST(p_partkey % 20 + 1 AS INT))").alias("t"))
    coded = p.select("p_partkey", keys.encode_tuple("t").alias("key"))
    return shown(coded.withColumn("n", F.octet_length(keys.decode_parts("key", tuple_format=True)[0]).cast("bigint")))


@query("SELECT hex(key) AS key, hex(prev) AS prev, n AS shared FROM (SELECT *, (SELECT coalesce(max(i), 0) FROM range(1, 257) t(i) WHERE i <= least(octet_length(key), octet_length(prev)) AND substr(hex(key), 1, 2 * CAST(i AS INTEGER)) = substr(hex(prev), 1, 2 * CAST(i AS INTEGER))) AS n FROM (SELECT key, lag(key) OVER (ORDER BY key) AS prev FROM (" + NATIONS + " SELECT key FROM kv))) WHERE prev IS NOT NULL")
def key_front_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = navigation.neighbours(nations_kv(spark, sf_dir)).where("prev_key IS NOT NULL")
    back = keys.front_decode(keys.front_code(F.col("key"), F.col("prev_key")), F.col("prev_key"))
    return shown(near.select(back.alias("key"), F.col("prev_key").alias("prev"), keys.common_prefix_length(F.col("key"), F.col("prev_key")).cast("bigint").alias("shared")))


@query("SELECT o_orderkey, '08' || " + _LE8 + " AS i64, '0C' || hex(encode(o_orderstatus)) AS text, '01' || CASE WHEN o_orderstatus = 'F' THEN '01' ELSE '00' END AS flag FROM (SELECT *, lpad(upper(to_hex(o_orderkey)), 16, '0') AS h FROM orders)")
def codec_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", F.hex(codec.encode_value(F.col("o_orderkey"), "i64")).alias("i64"), F.hex(codec.encode_value(F.col("o_orderstatus"), "string")).alias("text"), F.hex(codec.encode_value(F.col("o_orderstatus") == "F", "bool")).alias("flag"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kinds = {"c_custkey": ("i64", "bigint"), "c_name": ("string", "string"), "c_nationkey": ("i32", "int"), "c_acctbal": ("f64", "double")}
    coded = c.select(*(codec.encode_value(F.col(n), k).alias(n) for n, (k, _) in kinds.items()))
    return coded.select(*(codec.decode_as(F.col(n), k).cast(t).alias(n) for n, (k, t) in kinds.items()))


@query("SELECT 'c_acctbal' AS field, 9 AS size, count(*) AS n FROM customer UNION ALL SELECT 'c_custkey', 9, count(*) FROM customer UNION ALL SELECT 'c_nationkey', 5, count(*) FROM customer UNION ALL SELECT 'c_name', CAST(1 + octet_length(encode(c_name)) AS INTEGER), count(*) FROM customer GROUP BY 2")
def codec_tag_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kinds = {"c_custkey": "i64", "c_name": "string", "c_nationkey": "i32", "c_acctbal": "f64"}
    sizes = F.array(*(F.struct(F.lit(n).alias("field"), F.octet_length(codec.encode_value(F.col(n), k)).alias("size")) for n, k in kinds.items()))
    return c.select(F.explode(sizes).alias("s")).groupBy("s.field", "s.size").agg(F.count("*").alias("n"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", F.struct("c_nationkey", F.array("c_mktsegment", "c_name").alias("tags")).alias("more"))


def _root() -> Column:
    return make_key(F.lit("customer"), F.col("c_custkey").cast("string"))


_ROOT_SQL = _key_sql("'customer'", "CAST(c_custkey AS VARCHAR)")
_LE4 = " || ".join(f"substr(lpad(upper(to_hex(c_nationkey)), 8, '0'), {k}, 2)" for k in range(7, 0, -2))


@query(
    f"""WITH c AS (SELECT {_ROOT_SQL} AS r, * FROM customer)
SELECT hex(r) AS root, hex(r) AS key, '00' AS value FROM c
UNION ALL SELECT hex(r), hex(r || {_bytes_sql("'c_name'")}), '0C' || hex(encode(c_name)) FROM c
UNION ALL SELECT hex(r), hex(r || {_bytes_sql("'more'")}), '00' FROM c
UNION ALL SELECT hex(r), hex(r || {_key_sql("'more'", "'c_nationkey'")}), '06' || {_LE4} FROM c
UNION ALL SELECT hex(r), hex(r || {_key_sql("'more'", "'tags'")}), '00' FROM c
UNION ALL SELECT hex(r), hex(r || {_key_sql("'more'", "'tags'", "'0'")}), '0C' || hex(encode(c_mktsegment)) FROM c
UNION ALL SELECT hex(r), hex(r || {_key_sql("'more'", "'tags'", "'1'")}), '0C' || hex(encode(c_name)) FROM c"""
)
def doc_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(documents.flatten(_customers(spark, sf_dir), _root(), ["c_name", "more"]))


@query(f"SELECT hex({_ROOT_SQL}) AS root, c_name, c_nationkey, c_mktsegment || ',' || c_name AS tags FROM customer")
def doc_unflatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _customers(spark, sf_dir)
    back = documents.unflatten(documents.flatten(df, _root(), ["c_name", "more"]), df.select("c_name", "more").schema)
    return shown(back.select("root", "c_name", "more.c_nationkey", F.array_join("more.tags", ",").alias("tags")))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM conversations GROUP BY conv_id")
def doc_json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON arrays of turns, flattened to paths and rebuilt."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    whole = c.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))).alias("j"))
    back = documents.unflatten_json(documents.flatten_json(whole, make_key(F.lit("conv"), F.col("conv_id").cast("string")), "j"))
    turns = F.from_json("json", "array<struct<role:string,text:string>>")
    conv = keys.extract_subscript("root", 1).cast("string").cast("bigint")
    return back.select(conv.alias("conv_id"), F.size(turns).cast("bigint").alias("turns"), F.aggregate(turns, F.lit(0).cast("bigint"), lambda n, t: n + F.octet_length(t.text)).alias("n_bytes"))


@query("SELECT 'customer.' || CAST(o_custkey AS VARCHAR) AS \"group\", count(*) AS n_fields, hex(encode(max(CASE WHEN o_orderkey = f THEN o_orderstatus END))) AS first_status FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders) GROUP BY o_custkey")
def query_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = documents.paths_by(orders_table(spark, sf_dir), 2).withColumn("number", F.substring_index("path", ".", -1).cast("bigint"))
    return orders.groupBy("group").agg(F.count("*").alias("n_fields"), F.hex(F.min_by("value", "number")).alias("first_status"))


@query("SELECT 'region.' || r_name AS \"group\", count(*) AS n_fields, string_agg('nation.' || n_name || '=' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name) AS fields FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def query_objects_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = documents.objects_by(nations_kv(spark, sf_dir), 2)
    fields = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return made.select("group", "n_fields", F.array_join(fields, ",").alias("fields"))


@query("SELECT 'region' AS \"group\", CAST(count(*) AS INTEGER) AS n_fields FROM nation")
def query_objects_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.objects(nations_kv(spark, sf_dir), "region").select("group", F.size("fields").alias("n_fields"))


@query(f"WITH {EVENTS} SELECT hex(min(key)) AS key FROM ev WHERE key >= {_lit(literal_key('user', 8))} AND key < {_lit(keys.successor(literal_key('user')))}")
def peek_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(navigation.peek(events_log(spark, sf_dir), literal_key("user"), literal_key("user", 8)))


@query(
    f"""WITH {EVENTS}, asked AS (SELECT {_key_sql("'user'", 'CAST(c_custkey AS VARCHAR)')} AS key FROM customer)
SELECT hex(key) AS key, key NOT IN (SELECT key FROM ev WHERE txid = 14) AS shared, key NOT IN (SELECT key FROM ev WHERE txid IN (7, 14, 21)) AS exclusive,
    key NOT IN (SELECT key FROM ev WHERE txid IN (7, 21)) AS after_release FROM asked"""
)
def lock_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions 7 and 21 hold shared locks on what they wrote and 14 an exclusive one, which it then gives up."""
    held = events_log(spark, sf_dir).where("txid IN (7, 14, 21)").select("txid", "key", (F.col("txid") == 14).alias("exclusive")).distinct()
    asked = users(spark, sf_dir)
    found = mvcc.lock(held, asked, 35, exclusive=False).withColumnRenamed("granted", "shared")
    found = found.join(mvcc.lock(held, asked, 35).withColumnRenamed("granted", "exclusive"), "key")
    return shown(found.join(mvcc.lock(mvcc.unlocked(held, 14), asked, 35).withColumnRenamed("granted", "after_release"), "key"))


def _in_dialects(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows flattened and rebuilt in each dialect."""
    out = None
    for dialect in codec.DIALECTS:
        back = documents.unflatten(documents.flatten(df, _root(), columns, dialect), df.select(*columns).schema, dialect)
        back = back.withColumn("dialect", F.lit(dialect))
        out = back if out is None else out.unionByName(back)
    return out


@query(f"SELECT hex({_ROOT_SQL}) AS root, dialect, c_acctbal AS plain, CAST(CAST(c_acctbal / 3 AS FLOAT) AS DOUBLE) AS single, c_acctbal AS item0, -c_acctbal AS item1, c_acctbal / 7 AS item2 FROM customer, (VALUES ('go'), ('csharp'), ('rust')) d(dialect)")
def doc_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.struct(balance.alias("plain"), (balance / 3).cast("float").alias("single"), F.array(balance, -balance, balance / 7).alias("listed")).alias("f"))
    items = (F.col("f.listed")[k].alias(f"item{k}") for k in range(3))
    return shown(_in_dialects(df, ["f"]).select("root", "dialect", "f.plain", F.col("f.single").cast("double").alias("single"), *items))


@query(f"SELECT hex({_ROOT_SQL}) AS root, dialect, CAST(3 AS INTEGER) AS n_items, c_custkey AS item0, true AS item1_is_null, CAST(c_nationkey AS BIGINT) AS item2, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS inner_name, c_custkey % 2 = 0 AS has_inner FROM customer, (VALUES ('go'), ('csharp'), ('rust')) d(dialect)")
def doc_null_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("bigint")
    inner = F.when(key % 2 == 0, F.struct(F.struct("c_name").alias("deep")))
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.struct(F.array(key, F.lit(None).cast("bigint"), F.col("c_nationkey").cast("bigint")).alias("items"), inner.alias("inner")).alias("o"))
    back = _in_dialects(df, ["o"])
    return shown(back.select("root", "dialect", F.size("o.items").alias("n_items"), F.col("o.items")[0].alias("item0"), F.col("o.items")[1].isNull().alias("item1_is_null"), F.col("o.items")[2].alias("item2"), F.col("o.inner.deep.c_name").alias("inner_name"), F.col("o.inner").isNotNull().alias("has_inner")))


def _le_sql(n: str, width: int) -> str:
    """Hex of a number's low bytes, low byte first."""
    return "(" + " || ".join(f"substr(lpad(upper(to_hex(CAST({n} AS BIGINT))), 16, '0'), {k}, 2)" for k in range(15, 15 - 2 * width, -2)) + ")"


_RUST_TEXT = "'0C' || " + _le_sql("octet_length(encode({0}))", 4) + " || hex(encode({0}))"


@query(
    f"""WITH c AS (SELECT {_ROOT_SQL} AS r, * FROM customer)
SELECT hex(r) AS root, hex(r || {_bytes_sql("'name'")}) AS key, {_RUST_TEXT.format("c_name")} AS value FROM c
UNION ALL SELECT hex(r), hex(r || {_key_sql("'more'", "'tags'", "'0'")}), {_RUST_TEXT.format("c_mktsegment")} FROM c
UNION ALL SELECT hex(r), hex(r || {_key_sql("'more'", "'tags'", "'1'")}), {_RUST_TEXT.format("c_name")} FROM c"""
)
def doc_rust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without markers, a field under another name and one left out."""
    return shown(documents.flatten(_customers(spark, sf_dir), _root(), ["c_name", "more"], "rust", {"c_name": "name"}, ("more.c_nationkey",)))


@query(
    f"""SELECT c_custkey, '0F03000000' || '06000000' || hex(encode('c_name')) || {_RUST_TEXT.format("c_name")} || '0B000000' || hex(encode('c_nationkey')) || '06' || {_le_sql("c_nationkey", 4)}
    || '04000000' || hex(encode('tags')) || '0E02000000' || {_RUST_TEXT.format("c_mktsegment")} || {_RUST_TEXT.format("c_name")} AS value, c_name, c_nationkey, c_mktsegment || '|' || c_name AS tags FROM customer"""
)
def object_as_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole objects as one value each, and back."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.struct("c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), F.array("c_mktsegment", "c_name").alias("tags")).alias("o"))
    coded = c.select("c_custkey", codec.encode_object(F.col("o"), c.schema["o"].dataType).alias("value"))
    return shown(coded.select("c_custkey", "value", codec.decode_object(F.col("value"), c.schema["o"].dataType).alias("o")).select("c_custkey", "value", "o.c_name", "o.c_nationkey", F.array_join("o.tags", "|").alias("tags")))


_NUMBERS = {"u8": "p_partkey % 256", "i8": "p_partkey % 128 - 64", "i16": "-p_partkey", "u16": "p_partkey % 65536", "i32": "-1000 * p_partkey", "u32": "p_partkey + 4000000000", "i64": "-p_partkey * 1000000007", "u64": "p_partkey * 1000000007"}


@query("SELECT p_partkey, " + ", ".join(f"'{codec.TAGS[k]:02X}' || {_le_sql(x, codec.WIDTHS[k])} AS {k}, CAST({x} AS BIGINT) AS {k}_back" for k, x in _NUMBERS.items()) + " FROM part")
def codec_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("p_partkey"))
    coded = p.select("p_partkey", *(codec.encode_value(F.expr(x), k).alias(k) for k, x in _NUMBERS.items()))
    back = (codec.decode_value(F.col(k))["int"].cast("bigint").alias(f"{k}_back") for k in _NUMBERS)
    return shown(coded.select("p_partkey", *_NUMBERS, *back))


_MICROS = "(1700000000000000 + event_id * 1000003)"


@query(
    f"""SELECT event_id, '0E' || {_le_sql(f'{_MICROS} * 1000', 8)} AS go_time, '0E' || {_le_sql(f'{_MICROS} * 10 + {codec.EPOCH_TICKS}', 8)} AS csharp_time, {_MICROS} AS go_back, {_MICROS} AS csharp_back,
    '0F' || md5(event_type) AS go_guid, {_RUST_TEXT.format("event_type")} AS rust_text, '0D' || {_le_sql('octet_length(encode(event_type))', 4)} || hex(encode(event_type)) AS bytes, event_type AS rust_back FROM events"""
)
def codec_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    moment = F.timestamp_micros(F.expr(_MICROS))
    times = {d: codec.encode_value(moment, "datetime", d) for d in ("go", "csharp")}
    text = codec.encode_value(F.col("event_type"), "string", "rust")
    guid = F.hex(codec.encode_value(F.unhex(F.md5("event_type")), "guid"))
    coded = e.select("event_id", "event_type", *(x.alias(f"{d}_time") for d, x in times.items()), F.concat(F.substring(guid, 1, 2), F.lower(F.substring(guid, F.lit(3), F.lit(32)))).alias("go_guid"), text.alias("rust_text"), codec.encode_value(F.col("event_type").cast("binary"), "bytes").alias("bytes"))
    back = (F.unix_micros(codec.decode_as(F.col(f"{d}_time"), "datetime", d)).alias(f"{d}_back") for d in times)
    return shown(coded.select("event_id", "go_time", "csharp_time", *back, "go_guid", "rust_text", "bytes", codec.decode_as(F.col("rust_text"), "string", "rust").alias("rust_back")))


@query(f"{NATIONS} SELECT hex(key) AS key, CASE WHEN hex(key) LIKE '{literal_key('region', 'ASIA').hex().upper()}%' THEN hex(encode('new')) ELSE hex(value) END AS value FROM kv WHERE hex(key) NOT LIKE '{literal_key('region', 'EUROPE').hex().upper()}%'")
def store_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is written, changed, left with a rolled-back and an unfinished transaction, opened again and compacted."""
    kv, path = nations_kv(spark, sf_dir), passing_folder(spark, "store")
    store = Store.create(spark, path)
    with store.transaction() as txn:
        store.set(txn, kv)
    with store.transaction() as txn:
        store.set(txn, kv.where(keys.has_prefix("key", literal_key("region", "ASIA"))).withColumn("value", F.lit("new").cast("binary")))
        store.delete(txn, kv.where(keys.has_prefix("key", literal_key("region", "EUROPE"))).select("key"))
    undone = store.begin()
    store.set(undone, kv.withColumn("value", F.lit("undone").cast("binary")))
    undone.rollback()
    store.set(store.begin(), kv.withColumn("value", F.lit("unfinished").cast("binary")))
    again = Store.open(spark, path)
    again.compact()
    return shown(again.snapshot())


@query(f"WITH {EVENTS}, o AS (SELECT * FROM ev WHERE txid <= 600), s AS (SELECT *, 'strict' AS mode FROM o WHERE txid % 7 <> 0 AND txid NOT IN (590, 595) UNION ALL SELECT *, 'relaxed' FROM o WHERE txid % 7 <> 0) SELECT mode, hex(key) AS key, hex(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY mode, key ORDER BY seq DESC) AS n FROM s) WHERE n = 1 AND NOT is_tombstone")
def isolation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions 590 and 595 were running at the reader's begin and commit before it reads."""
    log = events_log(spark, sf_dir)
    never = log.where("txid % 7 = 0").select("txid").distinct()
    at_begin = never.unionByName(log.where("txid IN (590, 595)").select("txid")).distinct()
    modes = (mvcc.visible(log, AS_OF, hidden).select(F.lit(mode).alias("mode"), "key", "value") for mode, hidden in (("strict", at_begin), ("relaxed", never)))
    strict, relaxed = modes
    return shown(strict.unionByName(relaxed))
