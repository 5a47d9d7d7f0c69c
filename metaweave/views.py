"""Typed edge views of the relational tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of purchases that one task joins and sums, where they are more than all tasks at once would take.
PER_TASK = 500_000


class Views:
    """Edge views over the Parquet tables of one folder; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def id(kind: str, column: str):
        return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))

    def cus_buy_prt(self, sparse: bool = False) -> DataFrame:
        l, o = self.t("lineitem"), self.t("orders")
        if sparse:
            l, o = l.filter("l_returnflag = 'R'"), o.filter("o_orderpriority = '1-URGENT'")
        l, o = l.select("l_orderkey", "l_partkey", "l_quantity"), o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        # tasks by rows: adaptive execution goes by compressed bytes, of which large tables make tasks of ever more rows
        tasks = self.t("lineitem").count() // PER_TASK  # a figure of the files' footers
        if tasks > self.spark.sparkContext.defaultParallelism:
            tasks = max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions")))  # of fewer the join makes as many by another shuffle
            l, o = (x.repartition(tasks, "l_orderkey") for x in (l, o))
        j = l.join(o, "l_orderkey")
        return j.groupBy(self.id("CUS", "o_custkey").alias("n1"), self.id("PRT", "l_partkey").alias("n2")).agg(F.sum("l_quantity").alias("w"))

    def prt_sby_sup(self, sparse: bool = False) -> DataFrame:
        l = self.t("lineitem")
        l = l.filter("l_returnflag = 'R'") if sparse else l
        return l.select(self.id("PRT", "l_partkey").alias("n1"), self.id("SUP", "l_suppkey").alias("n2")).distinct()

    def loc_nat(self, kind: str) -> DataFrame:
        table, p = {"CUS": ("customer", "c"), "SUP": ("supplier", "s")}[kind]
        key = {"c": "c_custkey", "s": "s_suppkey"}[p]
        return self.t(table).select(self.id(kind, key).alias("n1"), self.id("NAT", f"{p}_nationkey").alias("n2"))

    def places(self) -> DataFrame:
        n = self.t("nation").select(self.id("NAT", "n_nationkey").alias("child"), self.id("REG", "n_regionkey").alias("parent"))
        return n.unionByName(self.t("region").select(self.id("REG", "r_regionkey").alias("child"), F.lit("REG:world").alias("parent")))

    def parts(self) -> DataFrame:
        p = self.t("part")
        return p.select(self.id("PRT", "p_partkey").alias("child"), self.id("BRD", "p_brand").alias("parent")).unionByName(p.select(self.id("PRT", "p_partkey").alias("child"), self.id("TYP", "p_type").alias("parent")))

    def together(self) -> DataFrame:
        """Order, part: the members of orders."""
        return self.t("lineitem").select(F.col("l_orderkey").alias("g"), self.id("PRT", "l_partkey").alias("m")).distinct()

    def spend(self) -> DataFrame:
        """sample, feature, value: what customers spent by brand."""
        l = self.t("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
        o, p = self.t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), self.t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        return l.join(o, "l_orderkey").join(p, "l_partkey").groupBy(F.col("o_custkey").alias("sample"), F.col("p_brand").alias("feature")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


SQL = {
    "cb": "SELECT 'CUS:' || o_custkey AS n1, 'PRT:' || l_partkey AS n2, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "cbs": "SELECT 'CUS:' || o_custkey AS n1, 'PRT:' || l_partkey AS n2, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderpriority = '1-URGENT' GROUP BY ALL",
    "ps": "SELECT DISTINCT 'PRT:' || l_partkey AS n1, 'SUP:' || l_suppkey AS n2 FROM lineitem",
    "pss": "SELECT DISTINCT 'PRT:' || l_partkey AS n1, 'SUP:' || l_suppkey AS n2 FROM lineitem WHERE l_returnflag = 'R'",
    "cn": "SELECT 'CUS:' || c_custkey AS n1, 'NAT:' || c_nationkey AS n2 FROM customer",
    "sn": "SELECT 'SUP:' || s_suppkey AS n1, 'NAT:' || s_nationkey AS n2 FROM supplier",
    "pl": "SELECT 'NAT:' || n_nationkey AS child, 'REG:' || n_regionkey AS parent FROM nation UNION ALL SELECT 'REG:' || r_regionkey, 'REG:world' FROM region",
    "clo": "SELECT child AS node, parent AS anc FROM pl UNION SELECT clo.node, pl.parent FROM clo JOIN pl ON clo.anc = pl.child",
    "cl": "SELECT node, anc FROM clo UNION SELECT child, child FROM pl UNION SELECT parent, parent FROM pl",
    "hp": "SELECT 'PRT:' || p_partkey AS child, 'BRD:' || p_brand AS parent FROM part UNION ALL SELECT 'PRT:' || p_partkey, 'TYP:' || p_type FROM part",
    "cp": "SELECT child AS node, parent AS anc FROM hp UNION SELECT child, child FROM hp UNION SELECT parent, parent FROM hp",
    "mem": "SELECT DISTINCT l_orderkey AS g, 'PRT:' || l_partkey AS m FROM lineitem",
    "sp": "SELECT o_custkey AS sample, p_brand AS feature, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views in front."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + " " + body
