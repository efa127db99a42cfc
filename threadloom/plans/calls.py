"""Deduplication, calls and their usage, matching, relations, folds and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators as op
from ..functions import micros
from .base import Tables, query

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
PLACE = "(l_linenumber, l_partkey, l_suppkey, l_quantity)"
EV = "(SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"
PAIRS = f"""(SELECT user_id, k, min(CASE WHEN event_type = 'view' THEN event_id END) AS request, min(CASE WHEN event_type = 'click' THEN event_id END) AS result,
  count(CASE WHEN event_type = 'click' THEN 1 END) AS n_results FROM {EV} WHERE event_type IN ('view', 'click') GROUP BY user_id, k)"""
QUALITY = "CASE WHEN request IS NULL THEN 'no_request' WHEN n_results = 0 THEN 'unresolved' WHEN n_results = 1 THEN 'exact_unique' ELSE 'exact_ambiguous' END"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1")
def dedup_first(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return op.first_wins(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"]).drop("l_quantity")


@query("SELECT l_orderkey, count(*) AS n_fragments, CAST(min(l_linenumber) AS BIGINT) AS first_row, CAST(max(l_linenumber) AS BIGINT) AS last_row, bool_or(l_linestatus = 'F') AS synthetic, bool_or(l_returnflag <> 'N') AS finished FROM lineitem GROUP BY l_orderkey")
def calls_group(t: Tables) -> DataFrame:
    return _calls(t).drop("usage")


def _calls(t: Tables) -> DataFrame:
    return op.fragments(t.lineitem, "l_orderkey", LINE, F.col("l_returnflag") != "N", "l_quantity", F.col("l_linestatus") == "F")


@query(f"SELECT l_orderkey, CASE WHEN bool_or(l_returnflag <> 'N') THEN arg_max(l_quantity, {PLACE}) END AS usage FROM lineitem GROUP BY l_orderkey")
def calls_usage_last(t: Tables) -> DataFrame:
    return _calls(t).select("l_orderkey", "usage")


CALLS = "(SELECT l_orderkey, count(*) AS n, bool_or(l_linestatus = 'F') AS synthetic, bool_or(l_returnflag <> 'N') AS finished FROM lineitem GROUP BY l_orderkey)"


@query(f"SELECT count(*) AS calls, CAST(sum(n) AS BIGINT) AS fragments, count(CASE WHEN synthetic THEN 1 END) AS synthetic, count(CASE WHEN NOT finished THEN 1 END) AS without_end, round(avg(n), 6) AS mean_fragments FROM {CALLS}")
def calls_stats(t: Tables) -> DataFrame:
    return _calls(t).agg(
        F.count("*").alias("calls"), F.sum("n_fragments").alias("fragments"), F.count_if("synthetic").alias("synthetic"), F.count_if(~F.col("finished")).alias("without_end"),
        F.round(F.avg("n_fragments"), 6).alias("mean_fragments"),
    )


@query("SELECT count(*) AS calls, count(CASE WHEN n IS NULL THEN 1 END) AS empty, count(CASE WHEN finished THEN 1 END) AS finished FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag <> 'N') AS finished FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def calls_unfinished(t: Tables) -> DataFrame:
    joined = t.orders.select("o_orderkey").join(_calls(t), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.agg(F.count("*").alias("calls"), F.count_if(F.col("n_fragments").isNull()).alias("empty"), F.count_if("finished").alias("finished"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_orphans(t: Tables) -> DataFrame:
    return op.missing(t.orders.select("o_orderkey", "o_custkey"), t.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))


def _pairs(t: Tables, value: str = "event_id") -> DataFrame:
    return op.match_pairs(t.log, ["user_id", "k"], F.col("event_type") == "view", F.col("event_type") == "click", ["event_id"], F.col(value))


@query(f"SELECT user_id, k, request, result, n_results, {QUALITY} AS quality FROM {PAIRS}")
def tool_join(t: Tables) -> DataFrame:
    return _pairs(t)


@query(f"SELECT {QUALITY} AS quality, count(*) AS n FROM {PAIRS} GROUP BY 1")
def tool_quality_counts(t: Tables) -> DataFrame:
    return _pairs(t).groupBy("quality").agg(F.count("*").alias("n"))


@query(f"""SELECT user_id, k, epoch_us(r.ts) - epoch_us(q.ts) AS took_us FROM (SELECT * FROM {PAIRS} WHERE request IS NOT NULL AND n_results = 1) p
  JOIN (SELECT event_id, ts FROM events) q ON q.event_id = p.request JOIN (SELECT event_id, ts FROM events) r ON r.event_id = p.result WHERE epoch_us(r.ts) >= epoch_us(q.ts)""")
def request_to_result(t: Tables) -> DataFrame:
    log = t.log.withColumn("us", micros("ts"))
    made = op.match_pairs(log, ["user_id", "k"], F.col("event_type") == "view", F.col("event_type") == "click", ["event_id"], F.col("us"))
    return made.where((F.col("quality") == op.UNIQUE) & (F.col("result") >= F.col("request"))).select("user_id", "k", (F.col("result") - F.col("request")).alias("took_us"))


@query(f"SELECT CASE WHEN request IS NULL THEN 'tool_use' ELSE 'tool_result' END AS kind, concat_ws('/', 'unres', CASE WHEN request IS NULL THEN 'tool_use' ELSE 'tool_result' END, CAST(user_id AS VARCHAR) || ':' || CAST(k AS VARCHAR)) AS id, 'open' AS state FROM {PAIRS} WHERE request IS NULL OR n_results = 0")
def unresolved_catalog(t: Tables) -> DataFrame:
    from ..functions import entity_id

    gaps = _pairs(t).where(F.col("quality").isin(op.NO_REQUEST, op.UNRESOLVED)).withColumn("kind", F.when(F.col("request").isNull(), "tool_use").otherwise("tool_result"))
    return gaps.select("kind", entity_id("unres", F.col("kind"), F.concat_ws(":", F.col("user_id").cast("string"), F.col("k").cast("string"))).alias("id"), F.lit("open").alias("state"))


@query("""SELECT coalesce(conv_id, doc_id) AS child, last_turn, toxic FROM (SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE role = 'assistant' GROUP BY 1)
  FULL JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) ON conv_id = doc_id""")
def child_output(t: Tables) -> DataFrame:
    said = t.conversations.where(F.col("role") == "assistant").groupBy(F.col("conv_id").alias("child")).agg(F.max("turn").alias("last_turn"))
    return said.join(t.labels.groupBy(F.col("doc_id").alias("child")).agg(F.max("toxic").alias("toxic")), "child", "full")


# Rounds: an order is a revision of its customer, in the round of its year.
ROUNDS = "(SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate, CAST(year(o_orderdate) - 1991 AS INTEGER) AS round FROM orders)"


def _revisions(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", (F.year("o_orderdate") - 1991).alias("round"))


@query(f"SELECT o_custkey, arg_max(o_orderstatus, (round, o_orderkey)) AS o_orderstatus, max(round) AS round FROM {ROUNDS} GROUP BY 1")
def fold_lww(t: Tables) -> DataFrame:
    return op.fold_latest(_revisions(t), ["o_custkey"], ["round", "o_orderkey"]).select("o_custkey", "o_orderstatus", "round")


@query(f"SELECT o_custkey, arg_max(o_orderstatus, (round, o_orderkey)) AS o_orderstatus, max(round) AS round FROM {ROUNDS} WHERE round <= 4 GROUP BY 1")
def fold_as_of(t: Tables) -> DataFrame:
    return op.fold_latest(_revisions(t).where("round <= 4"), ["o_custkey"], ["round", "o_orderkey"]).select("o_custkey", "o_orderstatus", "round")


@query(f"SELECT o_custkey, s AS o_orderstatus FROM (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM {ROUNDS} GROUP BY 1) WHERE s <> 'P'")
def fold_tombstone(t: Tables) -> DataFrame:
    return op.fold_latest(_revisions(t), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "P").select("o_custkey", "o_orderstatus")


def _as_of(n: int) -> str:
    return f"(SELECT o_custkey, arg_max(o_orderkey, (round, o_orderkey)) AS v, arg_max(o_orderstatus, (round, o_orderkey)) AS s FROM {ROUNDS} WHERE round <= {n} GROUP BY 1)"


@query(f"""SELECT o_custkey, CASE WHEN a.v IS NULL OR a.s = 'P' THEN CASE WHEN b.s = 'P' THEN 'absent' ELSE 'added' END WHEN b.s = 'P' THEN 'tombstone' WHEN a.v = b.v AND a.s = b.s THEN 'same' ELSE 'changed' END AS change
  FROM {_as_of(3)} a FULL JOIN {_as_of(4)} b USING (o_custkey) WHERE NOT ((a.v IS NULL OR a.s = 'P') AND b.s = 'P')""")
def round_diff(t: Tables) -> DataFrame:
    gone = F.col("o_orderstatus") == "P"
    before, after = (op.fold_latest(_revisions(t).where(F.col("round") <= n), ["o_custkey"], ["round", "o_orderkey"], gone) for n in (3, 4))
    return op.changes(before, after, ["o_custkey"], ["o_orderkey", "o_orderstatus"])


@query(f"SELECT round, count(*) AS n_nodes, count(DISTINCT o_custkey) AS n_entities, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS n_tombstones FROM {ROUNDS} GROUP BY 1")
def round_counts(t: Tables) -> DataFrame:
    return _revisions(t).groupBy("round").agg(F.count("*").alias("n_nodes"), F.count_distinct("o_custkey").alias("n_entities"), F.count_if(F.col("o_orderstatus") == "P").alias("n_tombstones"))


@query(f"SELECT round, from_key, through_key, p IS NULL OR round = p + 1 AS follows FROM (SELECT round, min(o_orderkey) AS from_key, max(o_orderkey) AS through_key, lag(round) OVER (ORDER BY round) AS p FROM {ROUNDS} GROUP BY round)")
def audit_chain(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rounds = _revisions(t).groupBy("round").agg(F.min("o_orderkey").alias("from_key"), F.max("o_orderkey").alias("through_key"))
    before = F.lag("round").over(Window.orderBy("round"))  # one row per round
    return rounds.select("round", "from_key", "through_key", (before.isNull() | (F.col("round") == before + 1)).alias("follows"))


@query(f"SELECT problem, count(*) AS n FROM (SELECT 'repeated id in a round' AS problem FROM {ROUNDS} GROUP BY round, o_custkey HAVING count(*) > 1 UNION ALL SELECT 'unknown entity' FROM {ROUNDS} WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) UNION ALL SELECT 'unknown state' FROM {ROUNDS} WHERE o_orderstatus NOT IN ('O', 'F', 'P')) GROUP BY 1")
def audit_round(t: Tables) -> DataFrame:
    rows = _revisions(t)
    twice = rows.groupBy("round", "o_custkey").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated id in a round").alias("problem"))
    lost = op.missing(rows, t.customer.select("c_custkey"), F.col("c_custkey") == F.col("o_custkey")).select(F.lit("unknown entity").alias("problem"))
    odd = rows.where(~F.col("o_orderstatus").isin("O", "F", "P")).select(F.lit("unknown state").alias("problem"))
    return twice.unionByName(lost).unionByName(odd).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT n_name, coalesce(r_name, n_name) AS native FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def glossary_native(t: Tables) -> DataFrame:
    return op.labelled(t.nation, t.region.where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "r_name", "n_name", "native").select("n_name", "native")


@query("SELECT n_name, r_name, count(*) AS orders, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def star_revenue(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.sum(price).cast("decimal(28,4)").alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS sum_price, count(*) AS n FROM lineitem GROUP BY 1, 2")
def star_pricing(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("sum_qty"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("sum_price"), F.count("*").alias("n")
    )
