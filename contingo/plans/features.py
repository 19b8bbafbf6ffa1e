"""Projection, predicate, join and reshaping queries
bound to the test tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from contingo.functions.columns import (collapse_to_default, extract_group, fill_default, lump_other,
                                        parse_date_any, recode, two_sided_bin)
from contingo.operators.cohort import (allowlist_keep, ancestor_closure, best_category_strict,
                                       explode_field, explode_structs, lookup_join, max_score_tiers,
                                       neighbour_degree, propagate)
from contingo.plans.common import query, tbl
from contingo.plans.enrichment import (DISCOUNT_COLS, DISCOUNT_CUTOFFS, DISCOUNT_LABELS, KEEP_REASONS,
                                       SQL_PREC, customer_best_priority, interaction_edges, precedence)

# Fixed values of the bound queries.
ALLOW = ["purchase", "signup"]
TYPE_RECODE = {"STANDARD": "Standard", "PROMO": "Promotional", "ECONOMY": "Economy class"}
SEGMENT_KEEP = ["BUILDING", "MACHINERY", "CARDIOVASCULAR"]   # last one never occurs (kept on purpose)
URL_PATTERN = r"(.+)(/)(.+)(\?)"
BALANCE_HIGH, BALANCE_LOW = 9000.0, 1000.0


@query("project_rename", """
SELECT p_partkey AS partId, p_name AS name, p_brand AS brand, p_retailprice, 'part' AS kind FROM part""")
def q_project_rename(spark, d):
    """A1 + B1: select, rename, drop, constant column."""
    return (tbl(spark, d, "part").drop("p_type", "p_size")
            .withColumnsRenamed({"p_partkey": "partId", "p_name": "name", "p_brand": "brand"})
            .withColumn("kind", F.lit("part")))


@query("edge_filter", """
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem
WHERE l_returnflag = 'N' AND l_discount > 0.04 AND l_suppkey IS NOT NULL""")
def q_edge_filter(spark, d):
    """B2: equality, strict threshold and not-null filters (pushed into the scan)."""
    return interaction_edges(spark, d).distinct()


@query("degree_bins", """
WITH edges AS (SELECT DISTINCT l_partkey AS na, l_suppkey AS nb FROM lineitem
               WHERE l_returnflag = 'N' AND l_discount > 0.04 AND l_suppkey IS NOT NULL),
und AS (SELECT na, nb FROM edges UNION SELECT nb, na FROM edges)
SELECT na AS node, count(nb) AS partners,
  CASE WHEN count(nb) > 20 THEN 'greaterThan20' WHEN count(nb) > 10 THEN 'from11to20'
       WHEN count(nb) > 0 THEN 'from1to10' ELSE 'none' END AS partnersBin
FROM und GROUP BY na""")
def q_degree_bins(spark, d):
    """D13 + G2 + B8: undirected neighbour counts and their bins."""
    return neighbour_degree(interaction_edges(spark, d), "l_partkey", "l_suppkey")


def _event_signals():
    v = F.col("value")
    return (F.when(v < 5, F.lit(None).cast("array<string>"))
            .when(v < 20, F.array().cast("array<string>"))
            .otherwise(F.array(F.col("event_type"), F.when(v <= 250, F.lit("low")))))


@query("allowlist_overlap", """
SELECT event_id, event_type, value FROM events
WHERE value < 5 OR (value >= 20 AND (event_type IN ('purchase', 'signup') OR value > 250))""")
def q_allowlist_overlap(spark, d):
    """B4 + B5: keep rows whose signal list overlaps the allow-list or whose
    overlap is unknown (null list; no match but a null element); an empty list
    is dropped.  The oracle spells the three-valued rule out."""
    ev = tbl(spark, d, "events").withColumn("signals", _event_signals())
    return ev.where(allowlist_keep("signals", ALLOW)).select("event_id", "event_type", "value")


@query("score_tiers", """
SELECT l_partkey, l_suppkey, max(l_discount) AS max_score,
  CASE WHEN max(l_discount) > 0.08 THEN 'disc_0.08' END AS disc_008,
  CASE WHEN max(l_discount) > 0.06 THEN 'disc_0.06' END AS disc_006,
  CASE WHEN max(l_discount) > 0.04 THEN 'disc_0.04' END AS disc_004,
  CASE WHEN max(l_discount) > 0.02 THEN 'disc_0.02' END AS disc_002
FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey, l_suppkey""")
def q_score_tiers(spark, d):
    """D1 + B6: max score per pair after a source filter, nested strict tiers."""
    li = tbl(spark, d, "lineitem").where(F.col("l_returnflag") == "N")
    return max_score_tiers(li, ["l_partkey", "l_suppkey"], "l_discount", DISCOUNT_CUTOFFS,
                           DISCOUNT_LABELS, DISCOUNT_COLS)


@query("tolerance_bin", f"""
SELECT c_custkey, CASE WHEN c_acctbal > {BALANCE_HIGH} THEN 'high balance'
                       WHEN c_acctbal < {BALANCE_LOW} THEN 'low balance' END AS balanceBin
FROM customer""")
def q_tolerance_bin(spark, d):
    """Three-way bin with a null gap."""
    return tbl(spark, d, "customer").select(
        "c_custkey", two_sided_bin("c_acctbal", BALANCE_HIGH, BALANCE_LOW, "high balance", "low balance")
        .alias("balanceBin"))


@query("collapse_class", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority
                        ELSE 'Neutral' END AS metareason FROM orders""")
def q_collapse_class(spark, d):
    """B12."""
    return tbl(spark, d, "orders").select("o_orderkey", collapse_to_default(
        "o_orderpriority", KEEP_REASONS, "Neutral").alias("metareason"))


@query("fill_default", """
WITH edges AS (SELECT DISTINCT l_partkey AS na, l_suppkey AS nb FROM lineitem
               WHERE l_returnflag = 'N' AND l_discount > 0.04 AND l_suppkey IS NOT NULL),
und AS (SELECT na, nb FROM edges UNION SELECT nb, na FROM edges),
deg AS (SELECT na, CASE WHEN count(nb) > 20 THEN 'greaterThan20' WHEN count(nb) > 10 THEN 'from11to20'
                        WHEN count(nb) > 0 THEN 'from1to10' ELSE 'none' END AS partnersBin FROM und GROUP BY na)
SELECT p_partkey, coalesce(partnersBin, 'none') AS partnersBin FROM part LEFT JOIN deg ON p_partkey = na""")
def q_fill_default(spark, d):
    """C1 + B13: left join of the degree bins, absent -> 'none'."""
    deg = neighbour_degree(interaction_edges(spark, d), "l_partkey", "l_suppkey", node_out="p_partkey")
    return (tbl(spark, d, "part").select("p_partkey").join(deg.select("p_partkey", "partnersBin"), "p_partkey", "left")
            .withColumn("partnersBin", fill_default("partnersBin", "none")))


@query("recode", """
SELECT p_partkey, p_type, CASE p_type WHEN 'STANDARD' THEN 'Standard' WHEN 'PROMO' THEN 'Promotional'
                                      WHEN 'ECONOMY' THEN 'Economy class' ELSE p_type END AS typeLabel
FROM part""")
def q_recode(spark, d):
    """Dictionary recode, other values unchanged."""
    return tbl(spark, d, "part").select("p_partkey", "p_type", recode("p_type", TYPE_RECODE).alias("typeLabel"))


@query("lump_other", """
SELECT c_custkey, CASE WHEN c_mktsegment IS NULL THEN NULL
                       WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'CARDIOVASCULAR') THEN c_mktsegment
                       ELSE 'Other' END AS segment FROM customer""")
def q_lump_other(spark, d):
    """Lump values outside a keep-list into Other."""
    return tbl(spark, d, "customer").select("c_custkey", lump_other("c_mktsegment", SEGMENT_KEEP).alias("segment"))


@query("extract_id", r"""
SELECT page_id, nullif(regexp_extract(url, '(.+)(/)(.+)(\?)', 3), '') AS extracted FROM pages""")
def q_extract_id(spark, d):
    """B14 + B15: regex capture (greedy, as in the reference pattern), '' -> null."""
    return tbl(spark, d, "pages").select("page_id", extract_group("url", URL_PATTERN, 3).alias("extracted"))


def _constraints():
    """array<struct<constraintType, score, bin>> built per line."""
    return F.array(
        F.named_struct(F.lit("constraintType"), F.lit("qty"), F.lit("score"), F.col("l_quantity"),
                       F.lit("bin"), F.floor(F.col("l_quantity") / 10).cast("int")),
        F.named_struct(F.lit("constraintType"), F.lit("disc"), F.lit("score"), F.col("l_discount"),
                       F.lit("bin"), F.when(F.col("l_discount") <= 0.05,
                                            F.floor(F.col("l_discount") * 100).cast("int"))),
        F.named_struct(F.lit("constraintType"), F.lit("tax"), F.lit("score"), F.col("l_tax"),
                       F.lit("bin"), F.floor(F.col("l_tax") * 100).cast("int")))


@query("nested_explode", """
SELECT l_orderkey, l_linenumber, CAST(gc AS VARCHAR) AS gc FROM (
  SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 10) AS INTEGER) AS gc FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0.05 THEN CAST(floor(l_discount * 100) AS INTEGER) END
  FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_linenumber, CAST(floor(l_tax * 100) AS INTEGER) FROM lineitem)""")
def q_nested_explode(spark, d):
    """B18 + B19: one field projected across an array of structs, exploded
    (null elements kept), cast to a string category."""
    li = tbl(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _constraints().alias("constraint"))
    return explode_field(li, ["l_orderkey", "l_linenumber"], "constraint", "bin", "gc")


@query("struct_explode", """
SELECT l_orderkey, l_linenumber, 'disc' AS constraintType, l_discount AS score,
  CASE WHEN l_discount > 0.09 THEN 'intolerant' WHEN l_discount < 0.01 THEN 'tolerant' END AS tolerance
FROM lineitem""")
def q_struct_explode(spark, d):
    """B17 + B7: explode an array of structs, keep one element type, bin its
    score."""
    li = tbl(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _constraints().alias("constraint"))
    out = explode_structs(li, ["l_orderkey", "l_linenumber"], "constraint").where(F.col("constraintType") == "disc")
    return out.select("l_orderkey", "l_linenumber", "constraintType", "score",
                      two_sided_bin("score", 0.09, 0.01, "intolerant", "tolerant").alias("tolerance"))


@query("entity_id", """
SELECT count(DISTINCT (l_orderkey, l_partkey, l_suppkey)) AS n_ids FROM lineitem""")
def q_entity_id(spark, d):
    """Composite entity id as a 64-bit hash; its distinct count equals
    the composite key's (the oracle counts the key itself)."""
    li = tbl(spark, d, "lineitem").select(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey").alias("id"))
    return li.distinct().agg(F.count(F.lit(1)).alias("n_ids"))


@query("reason_lookup", """
SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def q_reason_lookup(spark, d):
    """C4: lookup join with differing key names (a fixed small table, broadcast)."""
    out = lookup_join(tbl(spark, d, "nation"), tbl(spark, d, "region"), "n_regionkey", "r_regionkey")
    return out.select("n_nationkey", "n_name", "r_name")


def _nation_nodes(spark, d):
    n = tbl(spark, d, "nation")
    return n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"),
                    F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.lit("W")).alias("ancestors"))


SQL_CLOSURE = """
closure AS (
  SELECT 'N' || n_nationkey AS nodeId, 'N' || n_nationkey AS propagatedId FROM nation
  UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION SELECT 'N' || n_nationkey, 'W' FROM nation)"""


@query("closure", f"WITH {SQL_CLOSURE} SELECT nodeId, propagatedId FROM closure")
def q_closure(spark, d):
    """G1 + B16 + G5: each node with itself and all its ancestors."""
    return ancestor_closure(_nation_nodes(spark, d), "id", "ancestors")


@query("propagate", f"""WITH {SQL_CLOSURE}
SELECT DISTINCT c_custkey, propagatedId AS node FROM customer
LEFT JOIN closure ON 'N' || c_nationkey = nodeId""")
def q_propagate(spark, d):
    """Replace each customer's node by itself and its ancestors."""
    cust = tbl(spark, d, "customer").select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
                                            .alias("node"))
    return propagate(cust, "node", ancestor_closure(_nation_nodes(spark, d), "id", "ancestors"))


@query("best_category", f"""WITH {SQL_PREC}
SELECT b.o_custkey, p.prioId, p.prioLabel, p.prioLabelSimple
FROM (SELECT o_custkey, min(prioRank) AS r FROM orders JOIN prec ON o_orderpriority = prioId GROUP BY o_custkey) b
JOIN prec p ON p.prioRank = b.r""")
def q_best_category(spark, d):
    """A7 + E1 + F1: the most severe priority of each customer."""
    return customer_best_priority(spark, d).select("o_custkey", "prioId", "prioLabel", "prioLabelSimple")


@query("best_category_strict", f"""WITH {SQL_PREC},
per_rank AS (SELECT o_custkey, prioRank, count(*) AS n FROM orders JOIN prec ON o_orderpriority = prioId
             GROUP BY o_custkey, prioRank),
top AS (SELECT o_custkey, min(prioRank) AS r FROM per_rank GROUP BY o_custkey)
SELECT t.o_custkey, p.prioId, p.prioLabel, p.prioLabelSimple
FROM top t JOIN per_rank pr ON pr.o_custkey = t.o_custkey AND pr.prioRank = t.r AND pr.n = 1
JOIN prec p ON p.prioRank = t.r""")
def q_best_category_strict(spark, d):
    """The top category only when it is unique among the entity's rows."""
    pairs = tbl(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return best_category_strict(pairs, "o_custkey", "o_orderpriority", precedence(spark), "prioId", "prioRank") \
        .select("o_custkey", "prioId", "prioLabel", "prioLabelSimple")


@query("date_parse", """
WITH txt AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%d/%m/%Y')
                                     ELSE strftime(o_orderdate, '%d.%m.%Y') END AS t FROM orders)
SELECT o_orderkey, t AS date_text,
  coalesce(CAST(try_strptime(t, '%d/%m/%Y') AS DATE), CAST(try_strptime(t, '%d.%m.%Y') AS DATE)) AS parsed
FROM txt""")
def q_date_parse(spark, d):
    """Dates rendered in two text formats, parsed by trying each format."""
    o = tbl(spark, d, "orders")
    txt = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "dd.MM.yyyy"))
    return o.select("o_orderkey", txt.alias("date_text")).withColumn(
        "parsed", parse_date_any("date_text", ["dd/MM/yyyy", "dd.MM.yyyy"]))
