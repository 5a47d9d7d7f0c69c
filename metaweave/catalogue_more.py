"""Registered queries on nodes, groups, walks' corpora and validation, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.catalogue import ALL_RANKS, COS, FREE, L2, LINKS, kept_places, query, ren, typed_walks_sql, vectors
from metaweave.operators import edges as E
from metaweave.operators import evaluate as V
from metaweave.operators import harmonise as H
from metaweave.operators import matrix as M
from metaweave.operators import nodes as N
from metaweave.operators import ontology as O
from metaweave.operators import pairs as P
from metaweave.operators import ranks as R
from metaweave.operators import skipgram as G
from metaweave.operators import stats as S
from metaweave.operators import swap as W
from metaweave.operators import text as T
from metaweave.operators import validate as L
from metaweave.operators import walks as K
from metaweave.operators.components import components
from metaweave.plans import network
from metaweave.session import saved
from metaweave.views import Views

# --- filters and labels ----------------------------------------------------------------------------------------------


@query("SELECT 'CUS:' || o_custkey AS n1, 'ORD:' || o_orderkey AS n2 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def edge_category_filter(v: Views) -> DataFrame:
    o = v.t("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.select(v.id("CUS", "o_custkey").alias("n1"), v.id("ORD", "o_orderkey").alias("n2"))


@query("SELECT 'PRT:' || p_partkey AS n1, 'TYP:' || p_type AS n2 FROM part WHERE contains(p_type, 'AL') OR contains(p_type, 'ED')")
def edge_substring_filter(v: Views) -> DataFrame:
    p = v.t("part").filter(F.col("p_type").contains("AL") | F.col("p_type").contains("ED"))
    return p.select(v.id("PRT", "p_partkey").alias("n1"), v.id("TYP", "p_type").alias("n2"))


@query(", f AS (SELECT feature, count(DISTINCT sample) FILTER (value > 150000) AS n FROM sp GROUP BY feature), t AS (SELECT count(DISTINCT sample) AS t FROM sp) SELECT sample, sp.feature, CASE WHEN value > 150000 THEN value ELSE 0 END AS value FROM sp JOIN f ON f.feature = sp.feature, t WHERE n >= t * 0.05", "sp")
def sparse_features_drop(v: Views) -> DataFrame:
    return H.dense_features(v.spend().withColumn("value", F.when(F.col("value") > 150000, F.col("value")).otherwise(0.0)), 0.05)


@query("SELECT node, anc FROM cl WHERE anc <> 'REG:world' AND node <> 'REG:world' AND node <> 'NAT:3'", "pl clo cl")
def root_and_obsolete_removal(v: Views) -> DataFrame:
    gone = v.spark.createDataFrame([("REG:world",), ("NAT:3",)], "nd string")  # the root and an obsolete term
    c = O.closure(v.places()).join(gone.select(F.col("nd").alias("node")), "node", "left_anti")
    return c.filter("anc <> 'REG:world'").select("node", "anc")


@query("SELECT 'PRT:' || l_partkey AS n1, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS n2, count(*) AS n FROM lineitem GROUP BY ALL")
def rename_literals(v: Views) -> DataFrame:
    e = v.t("lineitem").groupBy(v.id("PRT", "l_partkey").alias("n1"), F.col("l_returnflag").alias("n2")).agg(F.count("*").alias("n"))
    return N.renamed(e, "n2", {"A": "accepted", "R": "returned"})


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 4 WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS phase, 'curated' AS tag FROM orders")
def phase_case(v: Views) -> DataFrame:
    s = F.col("o_orderstatus")
    return v.t("orders").select("o_orderkey", F.when(s == "F", 4).when(s == "P", 2).otherwise(0).alias("phase"), F.lit("curated").alias("tag"))


@query("SELECT 'PRT:' || l_partkey AS nd, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS label FROM lineitem GROUP BY ALL")
def joined_label_sets(v: Views) -> DataFrame:
    return N.joined_labels(v.t("lineitem").select(v.id("PRT", "l_partkey").alias("nd"), F.col("l_returnflag").alias("label")), ["nd"], "label")


@query("SELECT g, 'PGN:' || substr(sha256(string_agg(m, '|' ORDER BY m)), 1, 16) AS node FROM mem GROUP BY g HAVING count(*) >= 2", "mem")
def hyper_nodes(v: Views) -> DataFrame:
    return N.hyper_nodes(v.together(), "g", "m")


@query("SELECT g, m FROM mem QUALIFY count(*) OVER (PARTITION BY g) >= 2", "mem")
def min_two_members(v: Views) -> DataFrame:
    return N.crowded(v.together(), "g")


@query("SELECT sample, feature, avg(value) AS mean, median(value) AS median, max(value) AS max, min(value) AS min FROM (SELECT l_suppkey AS sample, l_partkey AS feature, l_quantity AS value FROM lineitem) GROUP BY ALL")
def replicate_merge(v: Views) -> DataFrame:
    m = v.t("lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature"), F.col("l_quantity").alias("value"))
    out = None
    for how, name in (("avg", "mean"), ("median", "median"), ("max", "max"), ("min", "min")):
        x = H.merge_replicates(m, how).withColumnRenamed("value", name)
        out = x if out is None else out.join(x, ["sample", "feature"])
    return out


@query("SELECT sample, feature, rank() OVER w AS low, rank() OVER w + count(*) OVER (PARTITION BY sample, value) - 1 AS high, rank() OVER w + (count(*) OVER (PARTITION BY sample, value) - 1) / 2 AS mean FROM (SELECT l_suppkey AS sample, l_orderkey * 10 + l_linenumber AS feature, l_quantity AS value FROM lineitem) WINDOW w AS (PARTITION BY sample ORDER BY value)")
def rank_with_ties(v: Views) -> DataFrame:
    m = v.t("lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("feature"), F.col("l_quantity").alias("value"))
    rank = lambda ties: H.ranked("value", ["sample"], ties)
    return m.select("sample", "feature", rank("min").alias("low"), rank("max").alias("high"), rank("average").alias("mean"))


@query(", z AS (SELECT sample, feature, round(value - avg(value) OVER (PARTITION BY feature), 2) AS value FROM sp) SELECT sample, feature, value FROM z QUALIFY row_number() OVER (PARTITION BY sample, value > 0 ORDER BY abs(value) DESC, feature) <= 3", "sp")
def strongest_by_magnitude(v: Views) -> DataFrame:
    m = v.spend()
    z = m.join(m.groupBy("feature").agg(F.avg("value").alias("mean")), "feature").select("sample", "feature", F.round(F.col("value") - F.col("mean"), 2).alias("value"))
    up, down = (H.strongest(z.filter(c), 3) for c in ("value > 0", "value <= 0"))
    return up.unionByName(down).select("sample", "feature", "value")


@query("SELECT l_partkey AS drug, l_suppkey AS effect, (median(l_discount) FILTER (l_linestatus = 'O') + median(l_tax) FILTER (l_linestatus = 'O')) / 2 AS mean, (median(l_discount) FILTER (l_linestatus = 'F') + median(l_tax) FILTER (l_linestatus = 'F')) / 2 AS other FROM lineitem GROUP BY ALL".join(("WITH g AS (", "), r AS (SELECT *, max((mean >= 0.05 AND (other IS NULL OR mean > other + 0.03))::INT) OVER (PARTITION BY drug) AS first FROM g WHERE mean IS NOT NULL) SELECT drug, effect, round(mean, 9) AS mean FROM r WHERE CASE WHEN first = 1 THEN mean >= 0.05 AND (other IS NULL OR mean > other + 0.03) ELSE mean >= 0.02 AND (other IS NULL OR mean > other + 0.01) END")))
def over_placebo_margin(v: Views) -> DataFrame:
    rows = v.t("lineitem").select(F.col("l_partkey").alias("drug"), F.col("l_suppkey").alias("effect"), (F.col("l_linestatus") == "F").alias("placebo"), F.col("l_discount").alias("low"), F.col("l_tax").alias("high"))
    return N.over_placebo(rows, (0.05, 0.02), (0.03, 0.01)).withColumn("mean", F.round("mean", 9))


@query("SELECT least(l_partkey, l_suppkey) AS n1, greatest(l_partkey, l_suppkey) AS n2, arg_min(l_quantity, (l_partkey, l_suppkey, l_orderkey, l_linenumber)) AS w FROM lineitem GROUP BY ALL")
def first_weight_of_pair(v: Views) -> DataFrame:
    e = v.t("lineitem").select(F.col("l_partkey").alias("n1"), F.col("l_suppkey").alias("n2"), F.col("l_quantity").alias("w"), "l_orderkey", "l_linenumber")
    return E.first_by_order(e, "w", ["n1", "n2", "l_orderkey", "l_linenumber"])


# --- vocabularies ----------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT kind, nd FROM (SELECT 'place' AS kind, 'NAT:' || n_nationkey AS nd FROM nation UNION ALL SELECT 'place', 'REG:' || r_regionkey FROM region UNION ALL SELECT 'party', 'CUS:' || c_custkey FROM customer UNION ALL SELECT 'party', 'SUP:' || s_suppkey FROM supplier UNION ALL SELECT 'thing', 'PRT:' || p_partkey FROM part)")
def node_universes(v: Views) -> DataFrame:
    of = lambda table, kind, key: v.t(table).select(v.id(kind, key).alias("nd"))
    return N.universe({"place": [of("nation", "NAT", "n_nationkey"), of("region", "REG", "r_regionkey")], "party": [of("customer", "CUS", "c_custkey"), of("supplier", "SUP", "s_suppkey")], "thing": [of("part", "PRT", "p_partkey")]})


@query("WITH d AS (SELECT * FROM (VALUES ('2-HIGH', '1-URGENT'), ('6-NEW', '3-MEDIUM')) AS x(old, new)) SELECT o_orderkey, CASE WHEN o_orderpriority IN ('2-HIGH', '5-LOW') THEN '1-URGENT' ELSE o_orderpriority END AS code FROM orders")
def renames_by_year(v: Views) -> DataFrame:
    changes = v.spark.createDataFrame([("5-LOW", "2-HIGH", 2001), ("2-HIGH", "1-URGENT", 2003), ("6-NEW", "3-MEDIUM", 2003)], "old string, new string, year int")
    return N.latest_names(v.t("orders").select("o_orderkey", F.col("o_orderpriority").alias("code")), "code", changes)


@query("SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'world' FROM region")
def indentation_tree(v: Views) -> DataFrame:
    region = v.t("region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("name"))
    nation = v.t("nation").select(F.col("n_regionkey").alias("r"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("n"))
    lines = region.select((F.col("r") * 1000).alias("line"), F.concat(F.lit("--"), "name").alias("text")).unionByName(nation.select((F.col("r") * 1000 + 1 + F.col("n")).alias("line"), F.concat(F.lit("----"), "name").alias("text")))
    lines = lines.unionByName(v.spark.createDataFrame([(-1, "world")], "line int, text string"))
    return N.indented(lines.withColumn("doc", F.lit(1)))


@query("WITH x AS (SELECT c_nationkey AS concept, 'CUS' AS vocabulary, c_custkey AS id FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT s_nationkey, 'SUP', s_suppkey FROM supplier) SELECT concept, vocabulary, id FROM x WHERE vocabulary <> 'SUP' OR concept IN (SELECT concept FROM x WHERE vocabulary <> 'SUP')")
def xrefs_in_common(v: Views) -> DataFrame:
    c = v.t("customer").filter("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("concept"), F.lit("CUS").alias("vocabulary"), F.col("c_custkey").alias("id"))
    s = v.t("supplier").select(F.col("s_nationkey").alias("concept"), F.lit("SUP").alias("vocabulary"), F.col("s_suppkey").alias("id"))
    return T.in_common(c.unionByName(s), "SUP")


@query("WITH u AS (SELECT doc_id AS nd, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents), t AS (SELECT nd, unnest([1, 2, 3]) AS i FROM u) SELECT DISTINCT t.nd AS n1, u.nd AS n2 FROM t JOIN u ON u.place = ('0x' || substr(md5('1|' || t.nd || '|' || i), 1, 12))::BIGINT % (SELECT count(*) FROM u) WHERE t.nd <> u.nd")
def random_background(v: Views) -> DataFrame:
    return T.background(v.t("documents").select(F.col("doc_id").alias("doc")), 3)


# --- networks --------------------------------------------------------------------------------------------------------


@query("SELECT n1, n2 FROM cb INTERSECT SELECT n1, n2 FROM (SELECT 'CUS:' || o_custkey AS n1, 'PRT:' || (o_orderkey % 1000) AS n2 FROM orders)", "cb")
def metaedge_intersection(v: Views) -> DataFrame:
    return N.metaedges([v.cus_buy_prt(), v.t("orders").select(v.id("CUS", "o_custkey").alias("n1"), F.concat(F.lit("PRT:"), (F.col("o_orderkey") % 1000).cast("string")).alias("n2"))], every=True)


@query("SELECT n1, n2 FROM cn UNION SELECT n1, n2 FROM sn", "cn sn")
def metaedge_union(v: Views) -> DataFrame:
    return N.metaedges([v.loc_nat("CUS"), v.loc_nat("SUP")])


@query("SELECT (SELECT count(DISTINCT n1) FROM cb) AS rows, (SELECT count(DISTINCT n2) FROM cb) AS cols, (SELECT count(*) FROM cb) AS cells", "cb")
def matrix_stats(v: Views) -> DataFrame:
    m = M.matrix(v.cus_buy_prt())
    count = lambda d, name: d.agg(F.count("*").alias(name))
    return count(m.rows, "rows").crossJoin(count(m.cols, "cols")).crossJoin(count(m.cells, "cells"))


@query("SELECT n2 AS nd, sum(w) AS w, rank() OVER (ORDER BY sum(w) DESC) AS place FROM cb GROUP BY n2 QUALIFY place <= 100", "cb")
def weighted_ranking(v: Views) -> DataFrame:
    w = v.cus_buy_prt().groupBy(F.col("n2").alias("nd")).agg(F.sum("w").alias("w"))
    least = w.orderBy(F.desc("w"), "nd").limit(100).agg(F.min("w").alias("least"))  # the hundred heaviest, ties included
    top = w.crossJoin(F.broadcast(least)).filter("w >= least").select("nd", "w")
    ahead = top.groupBy("w").agg(F.count("*").alias("n")).alias("a")
    more = ahead.join(ahead.alias("b"), F.col("b.w") > F.col("a.w"), "left").groupBy("a.w").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return top.join(more, "w").select("nd", "w", (F.col("before") + 1).alias("place"))


@query(f", {LINKS}, co AS (SELECT node, min(seen) AS component FROM re GROUP BY node), s AS (SELECT component, count(*) AS n FROM co GROUP BY component), c AS (SELECT *, row_number() OVER (ORDER BY n DESC, component) AS number, coalesce(sum(n) OVER (ORDER BY n DESC, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM s) SELECT component, n, number FROM c WHERE before < 0.9 * total", "cb")
def components_until_covered(v: Views) -> DataFrame:
    return N.until_covered(components(ren(v.cus_buy_prt(), n1="a", n2="b")), 0.9)


@query(f", {LINKS}, co AS (SELECT node, min(seen) AS component FROM re GROUP BY node), b AS (SELECT component FROM co GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT n1, n2, w FROM cb WHERE n1 IN (SELECT node FROM co JOIN b USING (component))", "cb")
def largest_component_edges(v: Views) -> DataFrame:
    return N.largest_component(v.cus_buy_prt())


@query("SELECT nd, string_agg(o, ',' ORDER BY o) AS neighbours, sum(w) AS w FROM (SELECT n1 AS nd, n2 AS o, w FROM cb UNION ALL SELECT n2, n1, w FROM cb) GROUP BY nd", "cb")
def neighbour_lists(v: Views) -> DataFrame:
    n = N.neighbour_lists(v.cus_buy_prt())
    return n.select("nd", F.array_join("neighbours", ",").alias("neighbours"), F.aggregate("weights", F.lit(0.0), lambda s, x: s + x).alias("w"))


@query("SELECT n1, n2, 1.0::DOUBLE AS w FROM cb", "cb")
def final_edges(v: Views) -> DataFrame:
    return network.nodes_and_edges(M.matrix(v.cus_buy_prt()), False, 0.0)[1]


@query(", d AS (SELECT nd, pow(sum(w), -0.5) AS f FROM (SELECT n1 AS nd, w FROM cb UNION ALL SELECT n2, w FROM cb) GROUP BY nd) SELECT n1, n2, round(w * w * x.f * y.f, 8) AS w FROM cb JOIN d AS x ON x.nd = n1 JOIN d AS y ON y.nd = n2", "cb")
def precomputed_edges(v: Views) -> DataFrame:
    return network.precomputed(v.cus_buy_prt(), False, 0.5, 0.0)[1].withColumn("w", F.round("w", 8))


@query("SELECT sum(16 * d + 16 * d * d)::BIGINT AS bytes FROM (SELECT count(*) AS d FROM (SELECT n1 AS nd FROM cb UNION ALL SELECT n2 FROM cb) GROUP BY nd)", "cb")
def walker_memory(v: Views) -> DataFrame:
    return N.walker_bytes(v.cus_buy_prt())


@query("SELECT nd, 1::BIGINT AS n FROM (SELECT n1 AS nd FROM cb UNION SELECT n2 FROM cb) WHERE nd LIKE '%7'", "cb")
def walk_check(v: Views) -> DataFrame:
    """The check of a corpus that has lost the second walk of every node whose id ends in 7."""
    e = v.cus_buy_prt()
    walks = K.random_walks(e, 2, 4).filter("NOT (start LIKE '%7' AND rep = 2)")
    return N.walk_check(walks, e.select(F.explode(F.array("n1", "n2")).alias("nd")), 2)


@query(f""", {LINKS}, co AS (SELECT node, left(node, 3) AS kind, min(seen) AS component FROM re GROUP BY node), ed AS (SELECT n1, n2, w FROM cb),
nn AS (SELECT nd, left(nd, 3) AS kind, count(*) AS degree, quantile_cont(w, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM (SELECT n1 AS nd, w FROM ed UNION ALL SELECT n2, w FROM ed) GROUP BY nd),
ds AS (SELECT kind, 'degree' AS what, degree::DOUBLE AS x FROM nn UNION ALL SELECT kind, 'weight_q' || ((i - 1) * 25), q[i]::DOUBLE FROM nn, range(1, 6) AS r(i)),
st AS (SELECT kind, what, avg(x) AS mean, min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS max FROM ds GROUP BY ALL),
sz AS (SELECT component, count(*) AS n FROM co GROUP BY component),
gi AS (SELECT CASE WHEN count(*) = 1 THEN 1 ELSE sum((2 * i - k - 1) * x) / (any_value(k) * sum(x)) END AS gini FROM (SELECT n + 1e-7 AS x, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS k FROM sz)),
ks AS (SELECT kind, component, count(co.node) AS n FROM (SELECT DISTINCT kind FROM co) CROSS JOIN sz LEFT JOIN co USING (kind, component) GROUP BY ALL),
cu AS (SELECT kind, n / sum(n) OVER (PARTITION BY kind) AS share, sum(n) OVER (PARTITION BY kind ORDER BY n DESC, component ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY kind) AS y FROM ks),
cv AS (SELECT kind, max(share) AS c1, CASE WHEN count(*) = 1 THEN 1 ELSE sum(y - share / 2) / (count(*) + 1) END AS auc FROM cu GROUP BY kind),
al AS (SELECT 'edges' AS name, count(*)::DOUBLE AS value FROM ed UNION ALL SELECT 'components', count(*) FROM sz UNION ALL SELECT 'gini', gini FROM gi
  UNION ALL SELECT 'nodes:' || kind, count(*) FROM co GROUP BY kind UNION ALL SELECT 'c1:' || kind, c1 FROM cv UNION ALL SELECT 'auc:' || kind, auc FROM cv
  UNION ALL SELECT what || ':' || kind || ':' || stat, value FROM (UNPIVOT st ON mean, min, q25, q50, q75, max INTO NAME stat VALUE value))
SELECT name, round(value, 6) AS value FROM al""", "cb")
def network_statistics(v: Views) -> DataFrame:
    e = v.cus_buy_prt()
    comp = components(ren(e, n1="a", n2="b")).withColumn("kind", F.substring("node", 1, 3))
    return S.network_stats(e, comp).select("name", F.round("value", 6).alias("value"))


@query(""", pw AS (SELECT a.m AS r, b.m AS c, count(*)::DOUBLE AS w FROM mem AS a JOIN mem AS b ON a.g = b.g AND a.m <> b.m GROUP BY ALL),
k AS (SELECT greatest(1, least(250, round_even(count(DISTINCT c) * 0.01, 0))) AS n FROM pw), x AS (SELECT r, c, round(w / sum(w) OVER (PARTITION BY c), 8) AS w FROM pw),
t AS (SELECT r, c, w FROM x QUALIFY row_number() OVER (PARTITION BY r ORDER BY w DESC, c) <= (SELECT n FROM k))
SELECT r, c, round(rank() OVER (PARTITION BY r ORDER BY w) / count(*) OVER (PARTITION BY r), 6) AS w FROM t""", "mem")
def norm_prune_symmetric(v: Views) -> DataFrame:
    """Parts by the orders that they share."""
    m = v.together()
    pairs = m.select("g", F.col("m").alias("n1")).join(m.select("g", F.col("m").alias("n2")), "g").filter("n1 < n2").groupBy("n1", "n2").agg(F.count("*").alias("w"))
    return M.norm_prune(M.matrix(pairs, undirected=True, weight=F.col("w")), symmetric=True).select("r", "c", F.round("w", 6).alias("w"))


@query()
def edge_swap_negatives(v: Views) -> DataFrame:
    return W.swapped(v.cus_buy_prt())


# --- several vocabularies --------------------------------------------------------------------------------------------


def part_vocabularies(v: Views) -> DataFrame:
    """Brands know the large parts, types the small ones; some are in neither."""
    p = v.t("part")
    of = lambda rows, kind, key: O.closure(rows.select(v.id("PRT", "p_partkey").alias("child"), v.id(kind, key).alias("parent")))
    return O.vocabularies({"brand": of(p.filter("p_size > 30"), "BRD", "p_brand"), "type": of(p.filter("p_size <= 25"), "TYP", "p_type")})


PARTS_OF = """bv AS (SELECT 'brand' AS otgy, 'PRT:' || p_partkey AS node, 'BRD:' || p_brand AS anc FROM part WHERE p_size > 30 UNION ALL SELECT 'type', 'PRT:' || p_partkey, 'TYP:' || p_type FROM part WHERE p_size <= 25),
b AS (SELECT DISTINCT otgy, node, anc FROM bv UNION SELECT otgy, node, node FROM bv UNION SELECT otgy, anc, anc FROM bv)"""


@query(f", {PARTS_OF} SELECT DISTINCT otgy, n1, n2 FROM cb LEFT JOIN (SELECT DISTINCT otgy, node FROM b) AS o ON o.node = n2", "cb")
def edges_by_vocabulary(v: Views) -> DataFrame:
    return O.by_vocabulary(v.cus_buy_prt(), "n2", part_vocabularies(v))


@query(f""", {PARTS_OF}, av AS (SELECT 'CUS:' || c_custkey AS node, 'SEG:' || c_mktsegment AS anc FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'CUS:' || c_custkey, 'NAT:' || c_nationkey FROM customer WHERE c_custkey % 3 = 0),
a AS (SELECT node, anc FROM av UNION SELECT node, node FROM av), ed AS (SELECT n1, n2 FROM cb WHERE w >= 40)
SELECT a.anc AS n1, b.anc AS n2 FROM ed JOIN a ON a.node = n1 JOIN b ON b.node = n2
UNION SELECT n1, n2 FROM ed WHERE n1 NOT IN (SELECT node FROM a) AND n2 NOT IN (SELECT node FROM b)""", "cb")
def propagate_dispatch_vocabularies(v: Views) -> DataFrame:
    c = v.t("customer")
    of = lambda rows, kind, key: O.closure(rows.select(v.id("CUS", "c_custkey").alias("child"), v.id(kind, key).alias("parent")))
    parties = O.vocabularies({"segment": of(c.filter("c_custkey % 2 = 0"), "SEG", "c_mktsegment"), "nation": of(c.filter("c_custkey % 3 = 0"), "NAT", "c_nationkey")})
    return O.dispatch(v.cus_buy_prt().filter("w >= 40"), O.of_kind(parties, ["segment", "nation"]), O.of_kind(part_vocabularies(v), ["brand", "type"]))


# --- correlations ----------------------------------------------------------------------------------------------------

RHO = "rk AS (SELECT sample, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS value FROM sp), rho AS (SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 8) AS r FROM rk AS a JOIN rk AS b ON a.sample = b.sample AND a.feature < b.feature GROUP BY ALL), cor AS (SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 8) AS r FROM sp AS a JOIN sp AS b ON a.sample = b.sample AND a.feature < b.feature GROUP BY ALL)"


def correlated(v: Views, spearman: bool) -> DataFrame:
    return H.correlations(v.spend(), spearman).withColumn("r", F.round("r", 8))


@query(f", {RHO} SELECT f1, f2, r FROM rho", "sp")
def spearman_pairs(v: Views) -> DataFrame:
    return correlated(v, True)


@query(f", {RHO} SELECT f1, f2 FROM cor WHERE r >= (SELECT quantile_cont(r, 0.9) FROM cor) INTERSECT SELECT f1, f2 FROM rho WHERE r >= (SELECT quantile_cont(r, 0.9) FROM rho)", "sp")
def correlation_consensus(v: Views) -> DataFrame:
    parts = []
    for spearman in (False, True):
        c = correlated(v, spearman)
        parts.append(c.crossJoin(F.broadcast(c.agg(F.percentile("r", 0.9).alias("q")))).filter("r >= q").select(F.col("f1").alias("n1"), F.col("f2").alias("n2")))
    return N.metaedges(parts, every=True).select(F.col("n1").alias("f1"), F.col("n2").alias("f2"))


@query(", u AS (SELECT n1, n2 FROM cn UNION SELECT n1, n2 FROM sn UNION SELECT n1, n2 FROM cb WHERE w > 90), d AS (SELECT n2, count(*) AS n FROM u GROUP BY n2), z AS (SELECT avg(n) AS m, stddev_pop(n) AS s FROM d) SELECT n1, n2 FROM u WHERE n2 NOT IN (SELECT n2 FROM d, z WHERE (n - m) / s > 3)", "cn sn cb")
def curated_union_without_outliers(v: Views) -> DataFrame:
    u = N.metaedges([v.loc_nat("CUS"), v.loc_nat("SUP"), v.cus_buy_prt().filter("w > 90")])
    d = u.groupBy("n2").agg(F.count("*").alias("n"))
    return u.join(H.outliers(d, "n").select("n2"), "n2", "left_anti").select("n1", "n2")


# --- validation ------------------------------------------------------------------------------------------------------


@query(", p AS (SELECT n1, n2, row_number() OVER (PARTITION BY n1 ORDER BY w DESC, n2) AS k, count(*) OVER (PARTITION BY n1) AS degree, w FROM cb) SELECT n1, n2, least(greatest(1, least(5, round_even(degree * 0.05, 0))), degree)::INT AS n FROM p WHERE k <= n", "cb")
def positives_by_weight(v: Views) -> DataFrame:
    return L.positives(v.cus_buy_prt(), weighted=True).select("n1", "n2", "n")


SPLITS = f"""p AS (SELECT n1, n2, w, least(greatest(1, least(5, round_even(degree * 0.05, 0))), degree)::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY n1 ORDER BY w DESC, n2) AS k, count(*) OVER (PARTITION BY n1) AS degree FROM cb) WHERE k <= least(greatest(1, least(5, round_even(degree * 0.05, 0))), degree)),
uni AS (SELECT DISTINCT n2 AS nd FROM cb), taken AS (SELECT cb.n1, cb.n2 AS nd FROM cb JOIN (SELECT n1, min(w) AS least FROM p GROUP BY n1) AS l ON l.n1 = cb.n1 WHERE w >= least), {FREE},
q AS (SELECT n1, repeat, unnest(range(1, n + 1)) AS i FROM (SELECT DISTINCT n1, n FROM p), (VALUES (1), (2), (3)) AS x(repeat)),
k AS (SELECT q.n1, repeat, i, gaps, ('0x' || substr(md5('1|' || q.n1 || '|' || repeat || '|' || i), 1, 12))::BIGINT % ((SELECT count(*) FROM u) - len(gaps)) AS k FROM q JOIN gl ON gl.n1 = q.n1 WHERE (SELECT count(*) FROM u) > len(gaps))"""


@query(f", {SPLITS} SELECT n1, nd AS n2, repeat, i FROM k JOIN u ON u.place = k + len(list_filter(gaps, lambda x: x <= k))", "cb")
def bootstrap_negatives(v: Views) -> DataFrame:
    e = v.cus_buy_prt()
    p = L.positives(e, weighted=True)
    return L.negatives(L.near_positives(e, p), p, e.select(F.col("n2").alias("nd")), 3)


MATES = "e AS (SELECT a.vec_id AS n1, b.vec_id AS n2 FROM embeddings AS a JOIN embeddings AS b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"


def mates(v: Views) -> DataFrame:
    """Every row divisible by 50 against all rows of its label."""
    a = vectors(v)
    one = a.filter("nd % 50 = 0").select(F.col("nd").alias("n1"), "label")
    return one.join(a.select(F.col("nd").alias("n2"), "label"), "label").filter("n1 <> n2").select("n1", "n2")


@query("WITH " + ALL_RANKS.format(L2) + f""", {MATES}, p AS (SELECT n1, n2, n FROM (SELECT *, row_number() OVER (PARTITION BY n1 ORDER BY md5('1|' || n1 || '|' || n2), n2) AS j, least(greatest(1, least(5, round_even(count(*) OVER (PARTITION BY n1) * 0.05, 0))), count(*) OVER (PARTITION BY n1)) AS n FROM e) WHERE j <= n),
uni AS (SELECT vec_id AS nd FROM embeddings), taken AS (SELECT n1, n2 AS nd FROM e UNION ALL SELECT n1, n1 FROM e), {FREE},
t AS (SELECT n1, repeat, unnest(range(1, n::BIGINT + 1)) AS i FROM (SELECT DISTINCT n1, n FROM p), (VALUES (1), (2), (3)) AS x(repeat)),
kk AS (SELECT t.n1, repeat, gaps, ('0x' || substr(md5('1|' || t.n1 || '|' || repeat || '|' || i), 1, 12))::BIGINT % ((SELECT count(*) FROM u) - len(gaps)) AS j FROM t JOIN gl ON gl.n1 = t.n1),
neg AS (SELECT n1, nd AS n2, repeat FROM kk JOIN u ON u.place = j + len(list_filter(gaps, lambda x: x <= j))),
far AS (SELECT max(d) + stddev_pop(d) AS far FROM r),
pairs AS (SELECT n1, n2, repeat, 1 AS label FROM p, (VALUES (1), (2), (3)) AS x(repeat) UNION ALL SELECT n1, n2, repeat, 0 FROM neg),
s AS (SELECT n1, repeat, label, 1 / (1 + coalesce(x.d, y.d, far)) AS dist, coalesce(x.rank + 1, k + 1) / n AS p1, coalesce(y.rank + 1, k + 1) / n AS p2 FROM pairs CROSS JOIN k CROSS JOIN far LEFT JOIN r AS x ON x.q = n1 AND x.nd = n2 LEFT JOIN r AS y ON y.q = n2 AND y.nd = n1),
l AS (SELECT n1, repeat, label, 'dist' AS kind, round(dist, 9) AS score FROM s UNION ALL SELECT n1, repeat, label, 'gmean', round(1 - sqrt(p1 * p2), 9) FROM s UNION ALL SELECT n1, repeat, label, 'least', round(1 - least(p1, p2), 9) FROM s UNION ALL SELECT n1, repeat, label, 'most', round(1 - greatest(p1, p2), 9) FROM s),
a AS (SELECT *, rank() OVER (PARTITION BY n1, repeat, kind ORDER BY score) + (count(*) OVER (PARTITION BY n1, repeat, kind, score) - 1) / 2 AS o FROM l),
b AS (SELECT n1, repeat, kind, (sum(o) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auroc FROM a GROUP BY ALL)
SELECT n1 AS nd, kind AS score, round(avg(auroc), 8) AS mean, round(min(auroc), 8) AS least FROM b GROUP BY ALL""")
def roc_validation(v: Views) -> DataFrame:
    """Positives of each row divisible by 50 against three repeats of negatives, by distance and by both ends' places."""
    a, e, (n, k) = vectors(v), mates(v), kept_places(v)
    p = L.positives(e)
    taken = e.unionByName(e.select("n1", F.col("n1").alias("n2")))
    neg = L.negatives(taken, p, a.select("nd"), 3)
    far = saved(L.farthest(R.ranked(a, k, what="sums")), "far")
    pairs = saved(p.select("n1", "n2", F.lit(0).alias("repeat")).unionByName(neg.select("n1", "n2", "repeat")), "pairs")
    ends = pairs.select(F.col("n1").alias("q"), F.col("n2").alias("nd")).unionByName(pairs.select(F.col("n2").alias("q"), F.col("n1").alias("nd")))
    near = saved(R.ranked(a, k, asked=ends), "places")
    scored = lambda pairs: L.four_scores(pairs, near, far, n, k)
    out = L.bootstrap_auroc(scored(p.select("n1", "n2")), scored(neg.select("n1", "n2", "repeat")), ["dist", "gmean", "least", "most"])
    return out.select("nd", "score", F.round("mean", 8).alias("mean"), F.round("least", 8).alias("least"))


@query(", b AS (SELECT n1, n2, w FROM cb UNION ALL SELECT n2, n1, w FROM cb), r AS (SELECT *, row_number() OVER (PARTITION BY n1 ORDER BY w DESC) - 1 AS k, count(*) OVER (PARTITION BY n1) AS n FROM b), c AS (SELECT tier, n1, n2, w, max(w) FILTER (k = greatest(0, floor(n * share) - 1)) OVER (PARTITION BY tier, n1) AS cut FROM r, (VALUES ('max', 0.0), ('quarter', 0.25), ('half', 0.5), ('all', 1.0)) AS t(tier, share)) SELECT tier, count(*) AS pairs, count(DISTINCT n1) AS nodes FROM c WHERE w >= cut GROUP BY tier", "cb")
def weight_tiers(v: Views) -> DataFrame:
    t = L.weight_tiers(v.cus_buy_prt(), {"max": 0.0, "quarter": 0.25, "half": 0.5, "all": 1.0})
    return t.groupBy("tier").agg(F.count("*").alias("pairs"), F.count_distinct("n1").alias("nodes"))


PAIRS_SCORED = f"sc AS (SELECT a.vec_id AS n1, b.vec_id AS n2, -round({L2}, 6) AS score FROM embeddings AS a, embeddings AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"


@query(f"""WITH {PAIRS_SCORED}, kn AS (SELECT DISTINCT a.vec_id AS n1, b.vec_id AS n2 FROM embeddings AS a JOIN embeddings AS b ON a.label = b.label AND b.vec_id - a.vec_id BETWEEN 1 AND 25),
l AS (SELECT score, ((n1, n2) IN (SELECT (n1, n2) FROM kn) OR (n2, n1) IN (SELECT (n1, n2) FROM kn))::INT AS label FROM sc),
o AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS o FROM l)
SELECT round((sum(o) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 8) AS auroc, (SELECT count(*) FROM kn) AS n_known, (SELECT count(*) FROM kn) AS n_inside, 1.0::DOUBLE AS coverage FROM o""")
def characterise_network(v: Views) -> DataFrame:
    """How well distances from every row divisible by 50 tell the pairs of another network: equal labels up to 25 ids apart."""
    a = vectors(v)
    ahead = a.select(F.col("nd").alias("n1"), "label", F.explode(F.sequence(F.col("nd") + 1, F.col("nd") + 25)).alias("n2"))
    known = ahead.join(a.select(F.col("nd").alias("n2"), "label"), ["n2", "label"]).select("n1", "n2")
    return L.characterised(a.select("nd"), known, scored_pairs(v)).withColumn("auroc", F.round("auroc", 8))


@query("SELECT b.vec_id AS nd, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1")
def joined_vectors(v: Views) -> DataFrame:
    a = vectors(v).select("nd", F.col("v").cast("array<double>").alias("v"))
    rows = a.select(F.col("nd").alias("x"), (F.col("nd") + 1).alias("y"))
    both = N.joined_vectors(rows, a, ["x", "y"])
    half = (F.size("v") / 2).cast("int")
    return both.select(F.col("y").alias("nd"), F.round(V.distance(F.slice("v", 1, half), F.slice("v", half + 1, half), "l2"), 5).alias("d"))


@query("SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS kind, row_number() OVER (PARTITION BY label < 5 ORDER BY vec_id) AS id, vec_id AS nd, len(embedding) AS dims FROM embeddings WHERE label IS NOT NULL")
def realigned_vectors(v: Views) -> DataFrame:
    from pyspark.sql.window import Window

    a = vectors(v).filter("label IS NOT NULL")
    kind = F.when(F.col("label") < 5, "low").otherwise("high")
    nodes = a.select(kind.alias("kind"), "nd").withColumn("id", F.row_number().over(Window.partitionBy("kind").orderBy("nd")))
    return N.realigned(a, nodes).select("kind", "id", "nd", F.size("v").alias("dims"))


@query()
def near_duplicates_lsh(v: Views) -> DataFrame:
    return N.without_near_duplicates(vectors(v).select("nd", F.col("v").cast("array<double>").alias("v")), 64)


# --- characterisation by other datasets ------------------------------------------------------------------------------

LADDER = "clo AS (SELECT vec_id AS node, vec_id AS anc FROM embeddings UNION SELECT vec_id, vec_id - vec_id % 10 FROM embeddings UNION SELECT vec_id, vec_id - vec_id % 100 FROM embeddings)"
NEAR_IDS = "kn AS (SELECT DISTINCT a.vec_id AS n1, b.vec_id AS n2, (26 - (b.vec_id - a.vec_id))::DOUBLE AS w FROM embeddings AS a JOIN embeddings AS b ON a.label = b.label AND b.vec_id - a.vec_id BETWEEN 1 AND 25)"
AREA = "round((sum(o) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 8) AS auroc"


def near_ids(v: Views) -> DataFrame:
    """n1, n2, w: equal labels up to 25 ids apart, the nearer the heavier."""
    a = vectors(v)
    ahead = a.select(F.col("nd").alias("n1"), "label", F.explode(F.sequence(F.col("nd") + 1, F.col("nd") + 25)).alias("n2"))
    return ahead.join(a.select(F.col("nd").alias("n2"), "label"), ["n2", "label"]).select("n1", "n2", (26 - (F.col("n2") - F.col("n1"))).cast("double").alias("w"))


def scored_pairs(v: Views) -> P.Scores:
    """Every row divisible by 50 against all others, the nearer the higher."""
    a = vectors(v)
    return P.scores(a.filter("nd % 50 = 0"), a)


ALL_SCORED = f"sc AS (SELECT a.vec_id AS n1, b.vec_id AS n2, -round({L2}, 6) AS score FROM embeddings AS a, embeddings AS b WHERE a.vec_id <> b.vec_id)"


@query(f"""WITH {ALL_SCORED}, {NEAR_IDS}, {LADDER}, up AS (SELECT DISTINCT p.anc AS n1, q.anc AS n2 FROM kn JOIN clo AS p ON p.node = kn.n1 JOIN clo AS q ON q.node = kn.n2 WHERE p.anc <> kn.n1 OR q.anc <> kn.n2),
ke AS (SELECT n1, n2 FROM kn ANTI JOIN up USING (n1, n2)), ei AS (SELECT n1, n2 FROM ke UNION SELECT n2, n1 FROM ke), l AS (SELECT score, (ei.n1 IS NOT NULL)::INT AS label FROM sc LEFT JOIN ei ON ei.n1 = sc.n1 AND ei.n2 = sc.n2),
o AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS o FROM l)
SELECT {AREA}, (SELECT count(*) FROM kn) AS n_known, (SELECT count(*) FROM kn) AS n_covered, (SELECT count(*) FROM ke) AS n_kept, 1.0::DOUBLE AS coverage FROM o""")
def characterise_metanode(v: Views) -> DataFrame:
    """Curated pairs of one node type, depropagated over a hierarchy of ids, tens and hundreds, against the distances of all pairs."""
    a = vectors(v)
    nd = F.col("nd")
    tens, hundreds = nd - nd % 10, nd - nd % 100
    h = a.select(nd.alias("child"), tens.alias("parent")).unionByName(a.select(tens.alias("child"), hundreds.alias("parent"))).filter("child <> parent")
    ends = O.closure(h)
    alone = a.select(nd.alias("node"), nd.alias("anc"))
    out = L.metanode_characterised(a.select("nd"), near_ids(v), P.scores(a, a), ends.unionByName(alone).distinct())
    return out.withColumn("auroc", F.round("auroc", 8))


@query(f"""WITH {PAIRS_SCORED}, {NEAR_IDS}, b AS (SELECT n1, n2, w FROM kn UNION ALL SELECT n2, n1, w FROM kn), r AS (SELECT *, row_number() OVER (PARTITION BY n1 ORDER BY w DESC) - 1 AS k, count(*) OVER (PARTITION BY n1) AS n FROM b),
c AS (SELECT tier, n1, n2, w, max(w) FILTER (k = greatest(0, floor(n * share) - 1)) OVER (PARTITION BY tier, n1) AS cut FROM r, (VALUES ('max', 0.0), ('quarter', 0.25), ('half', 0.5), ('all', 1.0)) AS t(tier, share)),
ti AS (SELECT DISTINCT tier, n1, n2 FROM c WHERE w >= cut), l AS (SELECT t.tier, score, (ti.n1 IS NOT NULL)::INT AS label FROM sc CROSS JOIN (VALUES ('max'), ('quarter'), ('half'), ('all')) AS t(tier) LEFT JOIN ti ON ti.tier = t.tier AND ti.n1 = sc.n1 AND ti.n2 = sc.n2),
o AS (SELECT *, rank() OVER (PARTITION BY tier ORDER BY score) + (count(*) OVER (PARTITION BY tier, score) - 1) / 2 AS o FROM l), e AS (SELECT n1 AS nd FROM kn UNION SELECT n2 FROM kn),
a AS (SELECT tier, {AREA} FROM o GROUP BY tier)
SELECT a.tier, auroc, (SELECT count(*) FROM ti WHERE ti.tier = a.tier) AS pairs, round((SELECT count(*) FROM e) / (SELECT count(DISTINCT vec_id) FROM embeddings), 8) AS nodes_cov, 1.0::DOUBLE AS val_nodes_cov, 1.0::DOUBLE AS val_edges_cov FROM a""")
def characterise_intra(v: Views) -> DataFrame:
    """Another dataset of the same pairs, tier by tier of its weights, against distances."""
    out = L.intra_characterised(vectors(v).select("nd"), near_ids(v), scored_pairs(v), {"max": 0.0, "quarter": 0.25, "half": 0.5, "all": 1.0})
    return out.withColumns({c: F.round(c, 8) for c in ("auroc", "nodes_cov", "val_nodes_cov", "val_edges_cov")})


@query(", g AS (SELECT g, 'PGN:' || substr(sha256(string_agg(m, '|' ORDER BY m)), 1, 16) AS node FROM mem GROUP BY g), h AS (SELECT DISTINCT node, m FROM mem JOIN g USING (g)) SELECT 'has' AS metaedge, node AS n1, m AS n2 FROM h UNION ALL SELECT DISTINCT 'hits', node, ps.n2 FROM h JOIN ps ON ps.n1 = h.m", "mem ps")
def perturbation_edges(v: Views) -> DataFrame:
    """Orders as sets of parts: equal sets are one node, joined to its parts and to all their suppliers."""
    hits = v.prt_sby_sup().select(F.col("n1").alias("m"), F.col("n2").alias("cell"))
    return N.perturbations(v.together(), "g", "m", hits, "cell")


@query("""WITH x AS (SELECT 'place' AS kind, 'NAT:' || n_nationkey AS nd FROM nation WHERE n_regionkey IN (0, 1) AND n_nationkey <> 3 UNION ALL SELECT 'place', 'REG:' || r_regionkey FROM region WHERE r_regionkey IN (0, 1)
UNION ALL SELECT 'party', 'CUS:' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 AND n_nationkey <> 8 UNION ALL SELECT 'party', 'SUP:' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2
UNION ALL SELECT 'thing', 'TYP:' || p_type FROM part UNION ALL SELECT 'thing', 'PRT:' || p_partkey FROM part WHERE p_brand = 'Brand#11')
SELECT DISTINCT kind, nd FROM x""")
def universes_by_rule(v: Views) -> DataFrame:
    """Three node types from four vocabularies: below roots, without subtrees, of a namespace, the union of several."""
    edge = lambda table, kind, key, to: v.t(table).select(v.id(kind, key).alias("child"), v.id("NAT", to).alias("parent"))
    closures = {"places": O.closure(v.places()), "customers": O.closure(v.places().unionByName(edge("customer", "CUS", "c_custkey", "c_nationkey"))), "suppliers": O.closure(v.places().unionByName(edge("supplier", "SUP", "s_suppkey", "s_nationkey"))), "parts": O.closure(v.parts())}
    table = O.vocabularies(closures)
    spaces = table.select("node", F.substring("node", 1, 3).alias("namespace")).distinct()
    rules = [
        O.Rule("place", "places", ("REG:0", "REG:1"), ("NAT:3",)),
        O.Rule("party", "customers", ("REG:2",), ("NAT:8",), "CUS"),
        O.Rule("party", "suppliers", ("REG:2",), namespace="SUP"),
        O.Rule("thing", "parts", namespace="TYP"),
        O.Rule("thing", "parts", ("BRD:Brand#11",), with_roots=False),
    ]
    return O.universes(rules, table, spaces)


# --- walks that end early --------------------------------------------------------------------------------------------


def stuck_walks(v: Views) -> DataFrame:
    """Walks from customers over purchases to suppliers of parts returned in lots of 45 and more; customers without orders and other parts end them."""
    lots = v.t("lineitem").filter("l_returnflag = 'R' AND l_quantity >= 45").select(v.id("PRT", "l_partkey").alias("n1"), v.id("SUP", "l_suppkey").alias("n2")).distinct()
    e = v.cus_buy_prt().select("n1", "n2", F.lit("buy").alias("metaedge")).unionByName(lots.withColumn("metaedge", F.lit("sby")))
    return K.typed_walks(e, ["buy", "sby"], v.t("customer").select(v.id("CUS", "c_custkey").alias("nd")), 3)


LOTS = "(SELECT 'PRT:' || l_partkey AS n1, 'SUP:' || l_suppkey AS n2 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)"
STUCK = typed_walks_sql(LOTS) + ", z AS (SELECT start, rep, 1 + (b1 IS NOT NULL)::INT + (b2 IS NOT NULL)::INT AS n FROM s2)"


@query(f"{STUCK} SELECT CASE WHEN n < 2 THEN 3 ELSE 4 END AS quarter, CASE WHEN n < 2 THEN 2 ELSE 3 END AS below, count(*) AS walks, count(DISTINCT start) AS nodes FROM z WHERE n < 3 GROUP BY ALL", "cb")
def walk_interruptions(v: Views) -> DataFrame:
    return K.interruptions(stuck_walks(v), 3)


@query(f"{STUCK} SELECT start AS nd, count(*) AS walks, rank() OVER (ORDER BY count(*) DESC) AS place FROM z WHERE n < 3 GROUP BY start", "cb")
def interrupted_nodes(v: Views) -> DataFrame:
    return K.interrupted_nodes(stuck_walks(v), 3)


@query()
def skipgram_vectors(v: Views) -> DataFrame:
    """Skip-gram with negative samples over walks on all purchases."""
    return G.skip_gram(K.random_walks(v.cus_buy_prt()))


# --- cross references ------------------------------------------------------------------------------------------------


@query("""WITH raw AS (SELECT 'customers' AS source, 'ORPHA:' || c_custkey AS n1, c_nationkey AS k FROM customer UNION ALL SELECT 'suppliers', 'UMLS:' || s_suppkey, s_nationkey FROM supplier)
SELECT DISTINCT source, n1, 'DOID:' || CASE WHEN k % 2 = 1 THEN k - 1 ELSE k END AS n2 FROM raw""")
def xref_normalised_sources(v: Views) -> DataFrame:
    """Two sources with ids written in their own ways; every odd id of the reference is an alternative of the one before."""
    c = v.t("customer").select(F.concat(F.lit("Orphanet_"), F.col("c_custkey").cast("string")).alias("n1"), F.concat(F.lit("doid:"), F.col("c_nationkey").cast("string")).alias("n2"))
    s = v.t("supplier").select(F.concat(F.lit("umls_cui:"), F.col("s_suppkey").cast("string")).alias("n1"), F.concat(F.lit("DOID_"), F.col("s_nationkey").cast("string")).alias("n2"))
    odd = v.t("nation").filter("n_nationkey % 2 = 1").select(v.id("DOID", "n_nationkey").alias("src"), F.concat(F.lit("DOID:"), (F.col("n_nationkey") - 1).cast("string")).alias("dst"))
    return E.cross_references({"customers": c, "suppliers": s}, odd)


@query("""WITH c AS (SELECT 'CUS:' || c_custkey AS n1, 'NAT:' || c_nationkey AS n2 FROM customer WHERE c_custkey % 3 = 0), p AS (SELECT 'CUS:' || c_custkey AS n1, 'NAT:' || (c_custkey % 25) AS n2, round(1 - 1 / (1 + c_custkey % 7), 6) AS score FROM customer)
SELECT n1, n2, 'curated' AS evidence, 1.0::DOUBLE AS score FROM c UNION ALL SELECT n1, n2, 'predicted', score FROM p WHERE n1 NOT IN (SELECT n1 FROM c)""")
def xref_assembly(v: Views) -> DataFrame:
    """Curated pairs written either way round and some within one vocabulary, over predicted ones."""
    t = v.t("customer")
    cus, nat = v.id("CUS", "c_custkey"), v.id("NAT", "c_nationkey")
    some = t.filter("c_custkey % 3 = 0")
    curated = some.filter("c_custkey % 2 = 0").select(cus.alias("n1"), nat.alias("n2")).unionByName(some.filter("c_custkey % 2 = 1").select(nat.alias("n1"), cus.alias("n2")))
    curated = curated.unionByName(t.select(cus.alias("n1"), F.concat(F.lit("CUS:"), (F.col("c_custkey") + 1).cast("string")).alias("n2")))
    predicted = t.select(F.concat(F.lit("NAT:"), (F.col("c_custkey") % 25).cast("string")).alias("n1"), cus.alias("n2"), (1 / (1 + F.col("c_custkey") % 7)).alias("dist"))
    return T.assembled_xrefs(curated, predicted, "NAT").withColumn("score", F.round("score", 6))
