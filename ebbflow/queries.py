"""The query catalogue: each query's batch or streaming form beside the SQL that gives the same rows.

Queries named s_* run as Structured Streaming jobs over several micro-batches and return their net rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow import functions as fn
from ebbflow import sinks
from ebbflow.operators import relational
from ebbflow.operators.aggregates import average, count, greatest, invertible, kmax, kmin, least, recomputed, total
from ebbflow.plans import Options, Relation
from ebbflow.session import shared_folder
from ebbflow.signed import SIGN, consolidate, negate, positive
from ebbflow.sources import text as sources
from ebbflow.streaming.run import net, replay, run_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SPLITS = 3


def query(sql: str | None = None) -> Callable:
    """Register a query, and its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    """A test table as a static relation."""
    return Relation.load(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)


def stream(spark: SparkSession, sf_dir: str, name: str, *cols: str, order: str | None = None) -> Relation:
    """A test table, or some of its columns, as a stream of SPLITS micro-batches."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Relation.load(replay(df.select(*cols) if cols else df, SPLITS, order), name)


# words ------------------------------------------------------------------------------------------------------------

WORDS_SQL = """words AS (
  SELECT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ ",()*]+')) AS w FROM documents) WHERE w <> '')"""


def words(docs: Relation) -> Relation:
    tokens = docs.flatten("tokens", fn.tokenize(F.col("text")), "token")
    return tokens.foreach("words", fn.lower(F.col("token")).alias("word"))


def _hist(docs: Relation) -> Relation:
    return words(docs).group("counts", ["word"], count("wc")).group("hist", ["wc"], count("freq"))


HIST_SQL = f"WITH {WORDS_SQL}, counts AS (SELECT word, count(*) AS wc FROM words GROUP BY word) SELECT wc, count(*) AS freq FROM counts GROUP BY wc"


@query(f"WITH {WORDS_SQL} SELECT word, count(*) AS wc FROM words GROUP BY word")
def wc_count(spark, sf_dir):
    return words(load(spark, sf_dir, "documents")).group("counts", ["word"], count("wc")).rows()


@query(HIST_SQL)
def wc_hist(spark, sf_dir):
    return _hist(load(spark, sf_dir, "documents")).rows()


@query(f"WITH {WORDS_SQL}, counts AS (SELECT word, count(*) AS wc FROM words GROUP BY word) SELECT min(wc) AS min_wc, max(wc) AS max_wc FROM counts")
def wc_minmax(spark, sf_dir):
    counts = words(load(spark, sf_dir, "documents")).group("counts", ["word"], count("wc"))
    return counts.group("extremes", [], kmin("wc", "min_wc"), kmax("wc", "max_wc")).rows()


@query(HIST_SQL)
def s_wc_hist(spark, sf_dir):
    return _hist(stream(spark, sf_dir, "documents", "text")).rows()


@query("SELECT label, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings GROUP BY label")
def s_kmin_kmax(spark, sf_dir):
    return stream(spark, sf_dir, "embeddings", "vec_id", "label").group("g", ["label"], kmin("vec_id", "lo"), kmax("vec_id", "hi")).rows()


STOP = ("the", "of", "and", "der", "die", "de", "la")
STOP_SQL = "stop AS (SELECT unnest(['" + "','".join(STOP) + "']) AS word)"


def _stop(spark):
    # a plan whose size Spark knows: rows from Python have no bound, so they would not be broadcast and each stop word would be one task's
    return Relation.load(spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in STOP])).alias("word")), "stop")


@query(f"WITH {WORDS_SQL}, {STOP_SQL} SELECT word, count(*) AS wc FROM words JOIN stop USING (word) GROUP BY word")
def stopword_join(spark, sf_dir):
    return words(load(spark, sf_dir, "documents")).join("hits", _stop(spark), ["word"], replicated=True).group("counts", ["word"], count("wc")).rows()


@query(f"WITH {WORDS_SQL}, {STOP_SQL} SELECT word, count(*) AS wc FROM words ANTI JOIN stop USING (word) GROUP BY word")
def stopword_anti(spark, sf_dir):
    return words(load(spark, sf_dir, "documents")).join("rest", _stop(spark), ["word"], "anti").group("counts", ["word"], count("wc")).rows()


@query(f"WITH {WORDS_SQL}, {STOP_SQL} SELECT word, count(*) AS wc FROM words JOIN stop USING (word) GROUP BY word")
def s_stopword_join(spark, sf_dir):
    return words(stream(spark, sf_dir, "documents", "text")).join("hits", _stop(spark), ["word"], replicated=True).group("counts", ["word"], count("wc")).rows()


# projection, filters, functions -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 1000 AND o_orderpriority IS NOT NULL")
def filter_predicates(spark, sf_dir):
    kept = load(spark, sf_dir, "orders").filter("o_orderstatus <> 'F' AND o_totalprice > 1000 AND o_orderpriority IS NOT NULL", "kept")
    return kept.foreach("cols", "o_orderkey", "o_totalprice").rows()


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS u FROM events WHERE CASE WHEN event_id % 3 <> 0 THEN user_id END IS NOT NULL")
def filter_nulls(spark, sf_dir):
    e = load(spark, sf_dir, "events").foreach("e", "event_id", "CASE WHEN event_id % 3 <> 0 THEN user_id END AS u")
    return e.filter("u IS NOT NULL", "known").rows()


@query("SELECT o_orderkey * 2 AS twice, upper(o_orderstatus) AS status, round(o_totalprice / 100, 6) AS hundreds FROM orders")
def project_expr(spark, sf_dir):
    return load(spark, sf_dir, "orders").foreach("p", "o_orderkey * 2 AS twice", "upper(o_orderstatus) AS status", "round(o_totalprice / 100, 6) AS hundreds").rows()


@query("SELECT event_id % 64 AS k, count(*) AS n FROM events GROUP BY 1")
def mod_key(spark, sf_dir):
    return load(spark, sf_dir, "events").foreach("k", "event_id % 64 AS k").group("g", ["k"], count("n")).rows()


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def positional_columns(spark, sf_dir):
    r = load(spark, sf_dir, "region")
    return r.foreach("p", r.positional(0).alias("k"), r.positional(1).alias("name")).rows()


@query("SELECT page_id, split_part(url, '/', 1) AS scheme, nullif(split_part(url, '/', 3), '') AS host FROM pages")
def strsplit_flatten(spark, sf_dir):
    p = load(spark, sf_dir, "pages").foreach("s", F.col("page_id"), fn.strsplit(F.col("url"), "/", 4, "scheme", "empty", "host", "rest").alias("t"))
    return p.flatten_tuple("f", "t", "page_id").foreach("c", "page_id", "scheme", "nullif(host, '') AS host").rows()


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS missing FROM events")
def json_path(spark, sf_dir):
    e = load(spark, sf_dir, "events").foreach("m", F.col("event_id"), fn.json_path("k user/name", F.col("props")).alias("m"))
    return e.foreach("c", "event_id", "m['k'] AS k", "m['user/name'] AS missing").rows()


@query("SELECT conv_id, turn, 'Could not parse: ' || '{' || role AS error FROM conversations")
def json_path_error(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").foreach("m", F.col("conv_id"), F.col("turn"), fn.json_path("id", F.concat(F.lit("{"), F.col("role"))).alias("m"))
    return c.foreach("c", "conv_id", "turn", "m['error'] AS error").rows()


@query("SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%MZ') AS minute FROM events")
def custom_time_iso(spark, sf_dir):
    text = F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    iso = fn.custom_format_to_iso(text, "EEE MMM dd HH:mm:ss Z yyyy")
    return load(spark, sf_dir, "events").foreach("e", F.col("event_id"), fn.iso_to_minute(iso).alias("minute")).rows()


@query("SELECT o_orderkey, length(o_orderpriority) AS n, try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS level FROM orders")
def text_casts(spark, sf_dir):
    return load(spark, sf_dir, "orders").foreach("c", F.col("o_orderkey"), fn.length(F.col("o_orderpriority")).cast("long").alias("n"), fn.try_text(F.substring("o_orderpriority", 1, 1), "int").alias("level")).rows()


# grouping ---------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group_count(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").group("g", ["l_returnflag", "l_linestatus"], count("n")).rows()


@query("SELECT l_suppkey, round(sum(l_quantity), 6) AS q FROM lineitem GROUP BY l_suppkey")
def group_sum(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").group("g", ["l_suppkey"], total("l_quantity", "q")).foreach("r", "l_suppkey", "round(q, 6) AS q").rows()


@query("SELECT l_returnflag, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag")
def group_avg(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").group("g", ["l_returnflag"], average("l_discount", "d")).foreach("r", "l_returnflag", "round(d, 6) AS d").rows()


@query("SELECT count(*) AS n, sum(l_linenumber) AS s, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem")
def group_all(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").group("g", [], count("n"), total("l_linenumber", "s", "long"), least("l_partkey", "lo"), greatest("l_partkey", "hi")).rows()


NULLS = "CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END"


@query(f"SELECT o_orderstatus, count({NULLS}) AS known, count(*) AS n FROM orders GROUP BY o_orderstatus")
def count_nonnull(spark, sf_dir):
    o = load(spark, sf_dir, "orders").foreach("o", "o_orderstatus", f"{NULLS} AS c")
    return o.group("g", ["o_orderstatus"], count("known", "c"), count("n")).rows()


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def count_each_flat(spark, sf_dir):
    return relational.count_each(load(spark, sf_dir, "orders").df, ["o_custkey"], "o_orderpriority").drop(SIGN)


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, count(*) AS rows FROM orders GROUP BY o_custkey")
def count_each_bag(spark, sf_dir):
    bags = relational.count_each(load(spark, sf_dir, "orders").df, ["o_custkey"], "o_orderpriority", "bag", flat=False)
    return bags.select("o_custkey", F.size("bag").cast("long").alias("kinds"), F.aggregate("bag", F.lit(0).cast("long"), lambda s, e: s + e["bag"]).alias("rows"))


COUNT_EACH_SQL = "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL"


@query(COUNT_EACH_SQL)
def s_count_each(spark, sf_dir):
    return Relation.load(replay(_retracted(spark, sf_dir, "o_orderpriority"), SPLITS), "o").count_each("e", ["o_custkey"], "o_orderpriority").rows()


@query("SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS kinds, count(*) AS rows FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_orderstatus")
def s_count_each_bag(spark, sf_dir):
    bags = Relation.load(replay(_retracted(spark, sf_dir, "o_orderpriority"), SPLITS), "o").count_each("e", ["o_orderstatus"], "o_orderpriority", "bag", flat=False)
    return bags.foreach("c", "o_orderstatus", "cast(size(bag) AS bigint) AS kinds", "aggregate(bag, 0L, (s, e) -> s + e.bag) AS rows").rows()


@query("SELECT l_suppkey, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY l_suppkey")
def kmin_kmax_by_key(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").group("g", ["l_suppkey"], kmin("l_partkey", "lo"), kmax("l_partkey", "hi")).rows()


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS custs FROM orders GROUP BY o_orderstatus")
def recomputed_distinct(spark, sf_dir):
    custs = recomputed("o_custkey", "custs", "long", lambda: F.count_distinct("o_custkey"), lambda c: sum(n > 0 for n in c.values()))
    return load(spark, sf_dir, "orders").group("g", ["o_orderstatus"], custs).rows()


MINUTE_SQL = """WITH m AS (SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS freq FROM events GROUP BY ALL)
SELECT strftime(minute, '%Y-%m-%d %H:%M') AS minute, freq, count(*) AS freq_count FROM m WHERE freq > 0 GROUP BY ALL"""


def _minute(events: Relation) -> Relation:
    e = events.foreach("e", F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm").alias("minute"), F.col("event_type"))
    freq = e.group("freq", ["minute", "event_type"], count("freq")).filter("freq > 0", "often")
    return freq.group("hist", ["minute", "freq"], count("freq_count"))


@query(MINUTE_SQL)
def wc_minute(spark, sf_dir):
    return _minute(load(spark, sf_dir, "events")).rows()


@query(MINUTE_SQL)
def s_wc_minute(spark, sf_dir):
    return _minute(stream(spark, sf_dir, "events", "ts", "event_type")).rows()


@query("SELECT o_custkey, count(*) AS n, sum(o_orderkey) AS s, round(sum(o_totalprice), 2) AS a FROM orders GROUP BY o_custkey")
def s_group_sum(spark, sf_dir):
    g = stream(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice").group("g", ["o_custkey"], count("n"), total("o_orderkey", "s", "long"), total("o_totalprice", "a"))
    return g.rows().withColumn("a", F.round("a", 2))


# joins ------------------------------------------------------------------------------------------------------------


def _orders(spark, sf_dir):
    return load(spark, sf_dir, "orders").foreach("orders", "o_orderkey", "o_custkey AS custkey")


def _customers(spark, sf_dir, where="true"):
    return load(spark, sf_dir, "customer").filter(where, "some").foreach("customer", "c_custkey AS custkey", "c_nationkey", "c_mktsegment")


@query("SELECT custkey, o_orderkey, c_nationkey, c_mktsegment FROM (SELECT o_custkey AS custkey, o_orderkey FROM orders) JOIN (SELECT c_custkey AS custkey, c_nationkey, c_mktsegment FROM customer) USING (custkey)")
def join_inner(spark, sf_dir):
    return _orders(spark, sf_dir).join("j", _customers(spark, sf_dir), ["custkey"]).rows()


@query("SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_nway(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").foreach("nation", "n_nationkey AS c_nationkey", "n_name")
    return _orders(spark, sf_dir).join("j", _customers(spark, sf_dir), ["custkey"]).join("k", nation, ["c_nationkey"], replicated=True).group("g", ["n_name"], count("n")).rows()


@query("SELECT a.l_partkey AS p, a.l_suppkey AS s, count(*) AS n FROM lineitem a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45) b USING (l_partkey, l_suppkey) GROUP BY ALL")
def join_composite(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").foreach("i", "l_partkey AS p", "l_suppkey AS s", "l_quantity AS q")
    large = items.filter("q > 45", "large").foreach("keys", "p", "s").distinct("d")
    return items.join("j", large, ["p", "s"]).group("g", ["p", "s"], count("n")).rows()


@query("SELECT s_name, round(sum(l_quantity), 6) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name")
def join_replicated(spark, sf_dir):
    supplier = load(spark, sf_dir, "supplier").foreach("s", "s_suppkey AS suppkey", "s_name")
    items = load(spark, sf_dir, "lineitem").foreach("i", "l_suppkey AS suppkey", "l_quantity")
    return items.join("j", supplier, ["suppkey"], replicated=True).group("g", ["s_name"], total("l_quantity", "q")).foreach("r", "s_name", "round(q, 6) AS q").rows()


def _outer(how):
    def run(spark, sf_dir):
        orders = _orders(spark, sf_dir).filter("custkey % 3 <> 0", "o")
        return orders.join("j", _customers(spark, sf_dir, "c_custkey % 5 <> 0"), ["custkey"], how).foreach("c", "custkey", "o_orderkey", "c_nationkey").rows()

    run.__name__ = f"join_{how}"
    return run


for _how in ("left", "right", "full"):
    query(f"SELECT custkey, o_orderkey, c_nationkey FROM (SELECT o_custkey AS custkey, o_orderkey FROM orders WHERE o_custkey % 3 <> 0) {_how.upper()} JOIN (SELECT c_custkey AS custkey, c_nationkey FROM customer WHERE c_custkey % 5 <> 0) USING (custkey)")(_outer(_how))


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS a FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, count(*) AS b FROM customer GROUP BY 1)
SELECT k, coalesce(a, 0) AS orders, coalesce(b, 0) AS customers FROM o FULL JOIN c USING (k)""")
def cogroup_counts(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").foreach("o", "o_custkey AS k", "o_orderkey")
    both = orders.cogroup("cg", load(spark, sf_dir, "customer").foreach("c", "c_custkey AS k", "c_name"), ["k"])
    return both.foreach("n", "k", "coalesce(cast(size(left_rows) AS bigint), 0) AS orders", "coalesce(cast(size(right_rows) AS bigint), 0) AS customers").rows()


PART_SQL = "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 6) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"


@query(PART_SQL)
def join_then_group(spark, sf_dir):
    part = load(spark, sf_dir, "part").foreach("p", "p_partkey AS partkey", "p_brand")
    items = load(spark, sf_dir, "lineitem").foreach("i", "l_partkey AS partkey", "l_quantity")
    return items.join("j", part, ["partkey"]).group("g", ["p_brand"], count("n"), total("l_quantity", "q")).foreach("r", "p_brand", "n", "round(q, 6) AS q").rows()


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def s_join_stream_stream(spark, sf_dir):
    # a join keeps the rows it is given: without the order's own key those of a customer are one row with their number
    orders = stream(spark, sf_dir, "orders", "o_custkey", "o_orderkey").foreach("o", "o_custkey AS custkey")
    customers = stream(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").foreach("c", "c_custkey AS custkey", "c_mktsegment")
    return orders.join("j", customers, ["custkey"]).group("g", ["c_mktsegment"], count("n")).rows()


@query("SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment")
def s_join_static(spark, sf_dir):
    events = stream(spark, sf_dir, "events", "event_id", "user_id").foreach("e", "user_id AS custkey", "event_id")
    return events.join("j", _customers(spark, sf_dir), ["custkey"]).group("g", ["c_mktsegment"], count("n")).rows()


@query("SELECT n_nationkey, s_suppkey, n_name FROM (SELECT n_nationkey, n_name FROM nation) LEFT JOIN (SELECT s_nationkey AS n_nationkey, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) USING (n_nationkey)")
def s_join_left(spark, sf_dir):
    nation = stream(spark, sf_dir, "nation", "n_nationkey", "n_name")
    supplier = stream(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").filter("s_suppkey % 2 = 0", "even").foreach("s", "s_nationkey AS n_nationkey", "s_suppkey")
    return nation.join("j", supplier, ["n_nationkey"], "left").rows().select("n_nationkey", "s_suppkey", "n_name")


@query("SELECT custkey, o_orderkey, c_nationkey FROM (SELECT o_custkey AS custkey, o_orderkey FROM orders) LEFT JOIN (SELECT c_custkey AS custkey, c_nationkey FROM customer WHERE c_custkey % 5 <> 0) USING (custkey)")
def s_join_static_left(spark, sf_dir):
    orders = stream(spark, sf_dir, "orders", "o_custkey", "o_orderkey").foreach("o", "o_custkey AS custkey", "o_orderkey")
    customers = _customers(spark, sf_dir, "c_custkey % 5 <> 0").foreach("k", "custkey", "c_nationkey")
    return orders.join("j", customers, ["custkey"], "left").rows()


@query("SELECT custkey, o_orderkey, c_nationkey FROM (SELECT o_custkey AS custkey, o_orderkey FROM orders) FULL JOIN (SELECT c_custkey AS custkey, c_nationkey FROM customer) USING (custkey)")
def s_join_static_full(spark, sf_dir):
    orders = stream(spark, sf_dir, "orders", "o_custkey", "o_orderkey").foreach("o", "o_custkey AS custkey", "o_orderkey")
    customers = _customers(spark, sf_dir).foreach("k", "custkey", "c_nationkey")
    return orders.join("j", customers, ["custkey"], "full").rows()


@query("""WITH s AS (SELECT s_nationkey AS k, count(*) AS a, sum(s_suppkey) AS sa FROM supplier GROUP BY 1), n AS (SELECT n_nationkey AS k, count(*) AS b FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1)
SELECT k, coalesce(a, 0) AS suppliers, coalesce(sa, 0) AS suppkeys, coalesce(b, 0) AS nations FROM s FULL JOIN n USING (k)""")
def s_cogroup(spark, sf_dir):
    supplier = stream(spark, sf_dir, "supplier", "s_nationkey", "s_suppkey").foreach("s", "s_nationkey AS k", "s_suppkey")
    nation = stream(spark, sf_dir, "nation", "n_nationkey", "n_name").filter("n_nationkey % 2 = 0", "even").foreach("n", "n_nationkey AS k", "n_name")
    both = supplier.cogroup("cg", nation, ["k"])
    return both.foreach("c", "k", "coalesce(cast(size(left_rows) AS bigint), 0) AS suppliers", "coalesce(aggregate(left_rows, 0L, (s, r) -> s + r.s_suppkey), 0) AS suppkeys", "coalesce(cast(size(right_rows) AS bigint), 0) AS nations").rows()


# unions, distinct, windows ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS k FROM orders UNION ALL SELECT event_id FROM events")
def union_all(spark, sf_dir):
    return load(spark, sf_dir, "orders").foreach("a", "o_orderkey AS k").union("u", load(spark, sf_dir, "events").foreach("b", "event_id AS k")).rows()


DIAMOND_SQL = "SELECT o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT o_orderstatus FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1"


def _diamond(orders: Relation) -> Relation:
    a, b = orders.filter("o_totalprice > 100000", "a"), orders.filter("o_orderkey % 2 = 0", "b")
    return a.union("u", b).group("g", ["o_orderstatus"], count("n"))


@query(DIAMOND_SQL)
def union_diamond(spark, sf_dir):
    return _diamond(load(spark, sf_dir, "orders")).rows()


@query(DIAMOND_SQL)
def s_union_diamond(spark, sf_dir):
    return _diamond(stream(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")).rows()


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_rows(spark, sf_dir):
    return load(spark, sf_dir, "orders").foreach("c", "o_custkey", "o_orderstatus").distinct("d").rows()


WINDOW_SQL = """WITH w AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS window_id FROM events)
SELECT event_type, CAST(window_id AS BIGINT) AS window_id, count(*) AS n, round(max(value), 6) AS hi FROM w GROUP BY ALL"""


@query(WINDOW_SQL)
def window_count_n(spark, sf_dir):
    w = load(spark, sf_dir, "events").count_window("w", ["event_type"], 50, count("n"), greatest("value", "hi", "double"), order=["event_id"])
    return w.foreach("r", "event_type", "window_id", "n", "round(hi, 6) AS hi").rows()


@query("WITH w AS (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS window_id FROM events) SELECT event_type, CAST(window_id AS BIGINT) AS window_id, count(*) AS n FROM w GROUP BY ALL")
def s_window_count_n(spark, sf_dir):
    events = stream(spark, sf_dir, "events", "event_id", "event_type")
    return replace(events, options={"w": Options(window=50)}).group("w", ["event_type"], count("n")).rows()


@query("""WITH w AS (SELECT user_id AS k, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS window_id FROM events),
g AS (SELECT k, CAST(window_id AS BIGINT) AS window_id, count(*) AS n FROM w GROUP BY ALL), c AS (SELECT c_custkey AS k, count(*) AS m FROM customer GROUP BY 1)
SELECT k, window_id, n, coalesce(m, 0) AS customers FROM g LEFT JOIN c USING (k)""")
def window_join_mixed(spark, sf_dir):
    w = load(spark, sf_dir, "events").foreach("e", "user_id AS k", "event_id").count_window("w", ["k"], 5, count("n"), order=["event_id"])
    c = load(spark, sf_dir, "customer").foreach("c", "c_custkey AS k").group("g", ["k"], count("m"))
    return w.join("j", c, ["k"], "left").foreach("r", "k", "window_id", "n", "coalesce(m, 0) AS customers").rows()


@query("""WITH w AS (SELECT user_id % 50 AS k, (row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1) // 40 AS window_id FROM events),
g AS (SELECT k, CAST(window_id AS BIGINT) AS window_id, count(*) AS n FROM w GROUP BY ALL), c AS (SELECT c_custkey % 75 AS k, count(*) AS m FROM customer GROUP BY 1)
SELECT k, window_id, n, m FROM g LEFT JOIN c USING (k)""")
def s_window_mixed(spark, sf_dir):
    """Every window of a key beside the other stream's rows of the key, which have no window."""
    events = stream(spark, sf_dir, "events", "event_id", "user_id").foreach("e", "user_id % 50 AS k", "event_id").count_window("w", ["k"], 40, count("n"))
    customers = stream(spark, sf_dir, "customer", "c_custkey").foreach("c", "c_custkey % 75 AS k").group("g", ["k"], count("m"))
    return events.join("j", customers, ["k"], "left").rows()


EXACT_SQL = """SELECT ts_key, big, count(*) AS n, max(big2) AS hi FROM (
  SELECT ts + to_microseconds(event_id % 3) AS ts_key, CASE WHEN event_id % 4 <> 0 THEN 9007199254740993 + event_id % 2 END AS big, CASE WHEN event_id % 5 <> 0 THEN 9007199254740993 + event_id END AS big2
  FROM events) GROUP BY ALL"""


def _exact(events: Relation) -> Relation:
    """Keys that differ by microseconds, and longs that no double holds beside nulls."""
    e = events.foreach("e", "timestampadd(MICROSECOND, event_id % 3, ts) AS ts_key", "CASE WHEN event_id % 4 <> 0 THEN 9007199254740993L + event_id % 2 END AS big", "CASE WHEN event_id % 5 <> 0 THEN 9007199254740993L + event_id END AS big2")
    return e.group("g", ["ts_key", "big"], count("n"), kmax("big2", "hi"))


@query(EXACT_SQL)
def exact_keys(spark, sf_dir):
    return _exact(load(spark, sf_dir, "events")).rows()


@query(EXACT_SQL)
def s_exact_keys(spark, sf_dir):
    return _exact(stream(spark, sf_dir, "events", "event_id", "ts")).rows()


# retractions ------------------------------------------------------------------------------------------------------


def _retracted(spark, sf_dir, *more):
    """Orders as additions, and every third of them taken back."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", *more)
    return positive(o).unionByName(negate(o.filter("o_orderkey % 3 = 0")))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey")
def retract_count(spark, sf_dir):
    return Relation.load(_retracted(spark, sf_dir), "o").group("g", ["o_custkey"], count("n")).rows()


RETRACT_SQL = "SELECT o_custkey, sum(o_orderkey) AS s, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey"


def _retract(r: Relation) -> Relation:
    return r.group("g", ["o_custkey"], total("o_orderkey", "s", "long"), least("o_orderkey", "lo"), greatest("o_orderkey", "hi"))


@query(RETRACT_SQL)
def retract_sum_min_max(spark, sf_dir):
    return _retract(Relation.load(_retracted(spark, sf_dir), "o")).rows()


@query(RETRACT_SQL)
def s_retract_sum_min_max(spark, sf_dir):
    return _retract(Relation.load(replay(_retracted(spark, sf_dir), SPLITS), "o")).rows()


@query("SELECT n, count(*) AS custs FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) GROUP BY n")
def s_retract_chain(spark, sf_dir):
    o = Relation.load(replay(_retracted(spark, sf_dir), SPLITS), "o")
    return o.group("g", ["o_custkey"], count("n")).group("h", ["n"], count("custs")).rows()


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def retract_join(spark, sf_dir):
    o = Relation.load(_retracted(spark, sf_dir), "o").foreach("k", "o_custkey AS custkey", "o_orderkey")
    return o.join("j", _customers(spark, sf_dir), ["custkey"]).group("g", ["c_mktsegment"], count("n")).rows()


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def s_late_negative(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    changes = negate(o.filter("o_orderkey % 3 = 0")).withColumn("at", F.lit(0)).unionByName(positive(o).withColumn("at", F.lit(1)))
    first = Relation.load(replay(changes, 2, "at"), "o")  # every retraction comes before its addition
    return first.group("g", ["o_orderstatus"], count("n")).rows()


# sinks ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def positives_only_sink(spark, sf_dir):
    return sinks.positives(_retracted(spark, sf_dir).select("o_orderkey", "o_orderstatus", SIGN))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0")
def signed_roundtrip(spark, sf_dir):
    folder = shared_folder(spark, "signed-text")
    sinks.signed_tab_text(_retracted(spark, sf_dir).select("o_orderkey", "o_orderstatus", SIGN), folder)
    back = sources.signed_tab_text(spark, folder, [("o_orderkey", "long"), ("o_orderstatus", "string")])
    return consolidate(back).filter(F.col(SIGN) > 0).drop(SIGN)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0")
def text_file_store(spark, sf_dir):
    """Additions to a tab-delimited text file and back."""
    folder = shared_folder(spark, "tab-text")
    kept = consolidate(_retracted(spark, sf_dir).select("o_orderkey", "o_orderstatus", SIGN))
    sinks.tab_text(kept, folder)
    return sources.tab_text(spark, folder, [("o_orderkey", "long"), ("o_orderstatus", "string")]).drop(SIGN)


@query("SELECT l_returnflag || ' ' || l_linestatus AS line, count(*) AS n FROM lineitem GROUP BY 1")
def text_line_load(spark, sf_dir):
    folder = shared_folder(spark, "lines")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("concat_ws(' ', l_returnflag, l_linestatus) AS value").write.text(folder)
    return Relation.load(sources.text_lines(spark, folder, "line"), "l").group("g", ["line"], count("n")).rows()


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def s_upsert_sink(spark, sf_dir):
    """A stream's last order of each customer, kept by the upsert sink."""
    folder = shared_folder(spark, "upsert")
    orders = stream(spark, sf_dir, "orders", "o_custkey", "o_orderkey", order="o_orderkey")
    store, last = sinks.upsert(folder, ["o_custkey"], "o_orderkey"), []
    writer = orders.df.writeStream.foreachBatch(lambda batch, i: (store(batch, i), last.append(i)))
    writer.option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sinks.upserted(spark, folder, max(last), orders.df.drop(SIGN).schema)


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_suppkey")
def group_parallel(spark, sf_dir):
    """Shuffle before one alias, a group dealt once over a number of partitions of its own."""
    items = replace(load(spark, sf_dir, "lineitem"), options={"f": Options(shuffle_before=True), "g": Options(parallel=7)})
    return items.filter("l_quantity > 10", "f").foreach("k", "l_suppkey").group("g", ["l_suppkey"], count("n")).rows()


@query("SELECT l_returnflag, var_pop(l_linenumber) AS v FROM lineitem GROUP BY 1")
def user_inverse(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").group("g", ["l_returnflag"], variance("l_linenumber", "v")).rows()


@query("SELECT o_orderstatus, round(var_pop(o_custkey), 3) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def s_user_inverse(spark, sf_dir):
    o = Relation.load(replay(_retracted(spark, sf_dir), SPLITS), "o")
    return o.group("g", ["o_orderstatus"], variance("o_custkey", "v")).foreach("r", "o_orderstatus", "round(v, 3) AS v").rows()


def variance(value: str, name: str):
    """The population variance of integers as a user would write it: three sums that can be taken back."""
    parts = {"n": lambda v: F.lit(1).cast("long"), "s": lambda v: v.cast("decimal(38,0)"), "q": lambda v: v.cast("decimal(19,0)") * v.cast("decimal(19,0)")}
    mean = lambda s: float(s["q"] * s["n"] - s["s"] * s["s"]) / float(s["n"] * s["n"]) if s["n"] else None
    exact = lambda s: F.try_divide((s["q"].cast("double") * s["n"] - s["s"].cast("double") * s["s"].cast("double")), s["n"].cast("double") * s["n"])
    return invertible(value, name, "double", parts, mean, exact)


LOAD_SQL = "SELECT key, count(*) AS n FROM (SELECT event_id, unnest(range(event_id % 7)) AS i FROM events) t, LATERAL (SELECT (event_id * 31 + i * 17) % 4096 AS key) GROUP BY key"


def _load(events: Relation) -> Relation:
    """Expand, key, shuffle, group: the shape of a load test without its random numbers and delays (s_rate_load has them)."""
    bag = F.expr("CASE WHEN event_id % 7 > 0 THEN sequence(0L, event_id % 7 - 1) ELSE array() END")
    e = replace(events, options={"k": Options(shuffle_before=True), "g": Options(parallel=8)}).flatten("x", bag, "i", "event_id")
    return e.foreach("k", "(event_id * 31 + i * 17) % 4096 AS key").group("g", ["key"], count("n"))


@query(LOAD_SQL)
def synthetic_load(spark, sf_dir):
    return _load(load(spark, sf_dir, "events")).rows()


@query(LOAD_SQL)
def s_synthetic_load(spark, sf_dir):
    return _load(stream(spark, sf_dir, "events", "event_id")).rows()


@query("SELECT o_orderkey % 16 AS k, count(*) AS n, true AS sized, true AS ranged FROM orders GROUP BY 1")
def random_bag_load(spark, sf_dir):
    """Random bags: their number, that their sizes have the mean they should, and that their numbers fill their range evenly."""
    o = load(spark, sf_dir, "orders").foreach("o", "o_orderkey % 16 AS k", fn.random_bag(42.671, 36.722).alias("bag"))
    late = o.foreach("d", F.col("k"), F.col("bag"), fn.delay(0.001).alias("ms")).filter("ms >= 0", "done")
    sums = late.foreach("s", "k", "size(bag) AS size", "aggregate(bag, 0D, (s, i) -> s + i) AS total", "forall(bag, i -> i >= 0) AS sane").filter("sane", "ok")
    g = sums.group("g", ["k"], count("n"), total("size", "elements", "long"), total("total", "total"))
    # sizes are normal variates cut at zero and rounded up: mean 45.336, deviation 32.997; an element has a mean of 2^30
    off = "6 * 32.997 / sqrt(n)"
    return g.foreach("c", "k", "n", f"abs(elements / n - 45.336) < {off} AS sized", "abs(total / elements / power(2, 30) - 1) < 6 * 0.58 / sqrt(elements) AS ranged").rows()


# state under load -------------------------------------------------------------------------------------------------


@query("SELECT n, count(*) AS keys, sum(v) AS v FROM (SELECT event_id, i, count(*) AS n, sum(step) AS v FROM events, (SELECT unnest(range(32)) AS i), (SELECT unnest(range(3)) AS step) GROUP BY event_id, i) GROUP BY n")
def s_many_keys(spark, sf_dir):
    """32 keys for each event in three micro-batches: the first is all new keys, the others are known keys alone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("at"))
    dealt = {"k": Options(parallel=spark.sparkContext.defaultParallelism)}  # events come by few files, their keys from all cores
    changes = Relation.load(replay(e, 3, "at"), "e", dealt).flatten("k", F.sequence(F.lit(0), F.lit(31)), "i", "event_id", "at")
    return changes.group("g", ["event_id", "i"], count("n"), total("at", "v", "long")).group("h", ["n"], count("keys"), total("v", "v", "long")).rows()


@query("""SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first, max(o_orderkey) AS last
FROM orders WHERE o_totalprice BETWEEN 30000 AND 300000 GROUP BY 1""")
def s_extremes_retracted(spark, sf_dir):
    """Three hot keys whose extremes are taken back in each micro-batch after the first."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    at = lambda df, i: df.withColumn("at", F.lit(i))
    first, second = o.filter("o_totalprice > 400000 OR o_totalprice < 10000"), o.filter("o_totalprice > 300000 AND o_totalprice <= 400000 OR o_totalprice >= 10000 AND o_totalprice < 30000")
    changes = at(positive(o), 0).unionByName(at(negate(first), 1)).unionByName(at(negate(second), 2))
    g = Relation.load(replay(changes, 3, "at"), "o").group("g", ["o_orderstatus"], kmin("o_totalprice", "lo", "double"), kmax("o_totalprice", "hi", "double"), kmin("o_orderdate", "first", "timestamp_ntz"), kmax("o_orderkey", "last"))
    return g.rows()


@query("SELECT custkey, o_orderkey, c_nationkey FROM (SELECT o_custkey AS custkey, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) LEFT JOIN (SELECT c_custkey AS custkey, c_nationkey FROM customer) USING (custkey)")
def s_join_left_retracted(spark, sf_dir):
    """Two streams, one of which takes rows back; null-extended rows go when their partner comes."""
    orders = Relation.load(replay(_retracted(spark, sf_dir), SPLITS), "o").foreach("k", "o_custkey AS custkey", "o_orderkey")
    customers = stream(spark, sf_dir, "customer", "c_custkey", "c_nationkey").foreach("c", "c_custkey AS custkey", "c_nationkey")
    return orders.join("j", customers, ["custkey"], "left").rows()


@query("""SELECT c_nationkey, count(*) AS n, sum(o_orderkey) AS s FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 2 >= c_custkey % 2 GROUP BY c_nationkey""")
def s_join_lives(spark, sf_dir):
    """State options by input: orders are forgotten after a millisecond, customers kept, so no order meets a later customer."""
    def half(name, key, *cols):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, *cols)
        return replay(rows.withColumn("at", F.col(key) % 2), 2, "at").drop("at")

    orders = Relation.load(half("orders", "o_orderkey", "o_custkey"), "o", {"j": Options(input_ttl_ms={0: 1})}).foreach("a", "o_custkey AS k", "o_orderkey")
    customers = Relation.load(half("customer", "c_custkey", "c_nationkey"), "c").foreach("b", "c_custkey AS k", "c_nationkey")
    return orders.join("j", customers, ["k"]).group("g", ["c_nationkey"], count("n"), total("o_orderkey", "s", "long")).rows()


WINDOW_COGROUP_SQL = """WITH w AS (SELECT user_id % 50 AS k, (row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1) // 40 AS window_id FROM events),
g AS (SELECT k, CAST(window_id AS BIGINT) AS window_id, count(*) AS n FROM w GROUP BY ALL), c AS (SELECT c_custkey % 75 AS k, count(*) AS m, sum(c_custkey) AS s FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1)
SELECT k, window_id, coalesce(n, 0) + coalesce(m, 0) AS rows, coalesce(s, 0) AS keys FROM g FULL JOIN c USING (k)"""


def _window_cogroup(events: Relation, customers: Relation, **order) -> Relation:
    """Windows of 40 events of each key, every one beside its key's count and sum of customers; one aggregate spans both bags.

    Customers are summed before they come beside the windows: bags of them would be repeated by every window of their key.
    """
    events = replace(events, options={"cg": Options(windows={0: 40})}).foreach("e", "user_id % 50 AS k", "event_id")
    known = customers.foreach("c", "c_custkey % 75 AS k", "c_custkey").group("known", ["k"], count("m"), total("c_custkey", "s", "long"))
    both = events.cogroup("cg", known, ["k"], **order)
    rows = "size(coalesce(left_rows, array())) + coalesce(aggregate(right_rows, 0L, (s, r) -> s + r.m), 0)"
    return both.foreach("a", "k", "window_id", f"cast({rows} AS bigint) AS rows", "coalesce(aggregate(right_rows, 0L, (s, r) -> s + r.s), 0) AS keys")


def _customers_taken_back(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return positive(c).unionByName(negate(c.filter("c_custkey % 3 = 0")))


@query(WINDOW_COGROUP_SQL)
def window_cogroup(spark, sf_dir):
    return _window_cogroup(load(spark, sf_dir, "events"), Relation.load(_customers_taken_back(spark, sf_dir), "c"), order=["event_id"]).rows()


@query(WINDOW_COGROUP_SQL)
def s_window_cogroup(spark, sf_dir):
    """The un-windowed input takes rows back, and every window of the key is replaced."""
    return _window_cogroup(stream(spark, sf_dir, "events", "event_id", "user_id"), Relation.load(replay(_customers_taken_back(spark, sf_dir), SPLITS), "c")).rows()


def rate_load(spark, sf_dir, rows_per_s: int | None = None, seconds: float | None = None):
    """(result, progress) of a live load: the rate source brings the events, at the offered rate, through random bags, delays and groups.

    The rate is 10,000 rows a second, more where that would not bring all events in half a minute.  The run ends when all events
    have come, after so many seconds at most if given.  The result is the events that came, and how many elements of their bags are in
    no group.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    n = 0 if low is None else high - low + 1
    offered = sources.rate(spark, rows_per_s or max(10_000, n // 30), 64, 1000).select((F.col("cur_sent").cast("long") + F.lit(low or 0)).alias("event_id"), "buf", SIGN)
    came = Relation.load(offered.filter(F.col("event_id") < (low or 0) + n).join(events, "event_id"), "rate", {"x": Options(shuffle_before=True), "g": Options(parallel=64)}).observe("came")
    bags = came.foreach("b", F.col("event_type"), fn.random_bag(42.671, 36.722).alias("bag"), fn.delay(0.002).alias("ms")).filter("ms >= 0", "late")
    keys = bags.flatten("x", "bag", "rand", "event_type").foreach("k", "event_type", "rand % 40960 AS key").observe("fed")
    counts = keys.group("g", ["key"], count("n")).group("h", [], total("n", "n", "long"), count("keys"))
    seen = lambda progress, name: sum(p.observedMetrics[name]["added"] or 0 for p in progress if name in p.observedMetrics)
    out, progress = run_for(counts.df, seconds, lambda p: seen(p, "came") >= n, state_partitions=4)
    kept = net(out).select("n")
    return kept.select(F.lit(seen(progress, "came")).cast("long").alias("events"), (F.lit(seen(progress, "fed")) - F.col("n")).cast("long").alias("lost")), progress


@query("SELECT count(*) AS events, CAST(0 AS BIGINT) AS lost FROM events")
def s_rate_load(spark, sf_dir):
    """All events from a live source, and no element of a random bag lost on its way through stateful groups."""
    return rate_load(spark, sf_dir)[0]
