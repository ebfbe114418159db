"""Inputs of the registered queries, derived by Spark from the given tables.

Every fixture is a plain DataFrame plan over ``{sf_dir}/<table>.parquet`` so
its size grows with the scale factor; nothing is made up or collected.

* ``rollup_view``   — the latest-snapshot view V of the roll-up (activity grain):
  lineitem grouped by ``(l_suppkey, l_returnflag)``, a ternary tree per tenant.
* ``activity_documents`` / ``entity_documents`` — raw document shapes (nested
  ``data`` struct, choice structs) over lineitem and supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import AMOUNT_TYPE, exact_decimal_sum, principal_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tenant(key: str) -> F.Column:
    return F.concat(F.lit("t"), (F.col(key) % 4).cast("string"))


def _parent(key: str) -> F.Column:
    """Ternary tree inside each tenant ``key mod 4``; index ``key div 4``."""
    return F.expr(
        f"CASE WHEN {key} div 4 = 0 THEN NULL "
        f"ELSE CAST((({key} div 4 - 1) div 3) * 4 + {key} % 4 AS STRING) END"
    )


def _percentage(key: str) -> F.Column:
    return F.expr(f"CAST(({key} % 5) * 0.25 AS DECIMAL(10,2))")


def rollup_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V: one row per (supplier, return flag) with the snapshot's columns."""
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    g = li.groupBy("l_suppkey", "l_returnflag").agg(
        exact_decimal_sum("l_extendedprice").alias("ep"),
        exact_decimal_sum("l_quantity").alias("qty"),
        exact_decimal_sum("l_tax").alias("tax"),
    )
    return g.select(
        F.col("l_suppkey").cast("string").alias("entityid"),
        _tenant("l_suppkey").alias("tenantid"),
        _parent("l_suppkey").alias("parententityid"),
        flag.alias("activityid"),
        F.when(flag == "A", F.col("ep").cast(AMOUNT_TYPE)).alias("emissioninkgco2"),
        F.when(flag != "A", F.col("qty").cast(AMOUNT_TYPE)).alias(
            "emissioninkgco2_forlocationbased"
        ),
        F.when(flag == "N", F.col("tax").cast(AMOUNT_TYPE)).alias(
            "emissioninkgco2_formarketbased"
        ),
        _percentage("l_suppkey").alias("parentcontributionpercentage"),
    )


# DuckDB text of the same view, used by the oracle queries.
ROLLUP_VIEW_SQL = """
v AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS entityid,
         't' || CAST(l_suppkey % 4 AS VARCHAR) AS tenantid,
         CASE WHEN l_suppkey // 4 = 0 THEN NULL
              ELSE CAST(((l_suppkey // 4 - 1) // 3) * 4 + l_suppkey % 4 AS VARCHAR) END
           AS parententityid,
         l_returnflag AS activityid,
         CASE WHEN l_returnflag = 'A' THEN CAST(ep AS DECIMAL(20,10)) END AS emissioninkgco2,
         CASE WHEN l_returnflag <> 'A' THEN CAST(qty AS DECIMAL(20,10)) END
           AS emissioninkgco2_forlocationbased,
         CASE WHEN l_returnflag = 'N' THEN CAST(tax AS DECIMAL(20,10)) END
           AS emissioninkgco2_formarketbased,
         CAST((l_suppkey % 5) * 0.25 AS DECIMAL(10,2)) AS parentcontributionpercentage
  FROM (SELECT l_suppkey, l_returnflag,
               SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS ep,
               SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty,
               SUM(CAST(l_tax AS DECIMAL(18,2))) AS tax
        FROM lineitem GROUP BY l_suppkey, l_returnflag) g
)"""

# The roll-up as an independent check, from its stated semantics over ``v``:
# walk the distinct (tenant, entity, parent) links with the number of rows
# behind them as weights, and apply the rounded chain of each V row's own
# percentage on the way.  Contributions of equal rows stay together, so rows
# that share an entity do not multiply the recursion, only its weights.
ROLLUP_CTE_SQL = """
links AS (
  SELECT tenantid AS of_tenant, entityid AS below, parententityid AS above, COUNT(*)::HUGEINT AS times
  FROM v WHERE tenantid IS NOT NULL AND entityid IS NOT NULL GROUP BY ALL
),
starts AS (
  SELECT tenantid, entityid, parentcontributionpercentage AS share, COUNT(*)::HUGEINT AS copies,
         COALESCE(emissioninkgco2, emissioninkgco2_forlocationbased, 0)::DECIMAL(20,10) AS by_location,
         COALESCE(emissioninkgco2, emissioninkgco2_formarketbased, 0)::DECIMAL(20,10) AS by_market
  FROM v GROUP BY ALL
),
walk(depth, place, origin, tenant, share, by_location, by_market, weight) AS (
  SELECT 0, entityid, entityid, tenantid, share, by_location, by_market, copies FROM starts
  UNION ALL
  SELECT w.depth + 1, l.above, w.origin, w.tenant, w.share,
         (w.by_location * w.share)::DECIMAL(20,10), (w.by_market * w.share)::DECIMAL(20,10), w.weight * l.times
  FROM walk w JOIN links l ON l.of_tenant = w.tenant AND l.below = w.place
)"""


def _supplier_flag_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey", "l_returnflag").agg(
        exact_decimal_sum("l_extendedprice").alias("ep"),
        exact_decimal_sum("l_quantity").alias("qty"),
        exact_decimal_sum("l_tax").alias("tax"),
        F.max("l_shipdate").alias("shipdate"),
        F.count(F.lit(1)).alias("lines"),
    )


def activity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw activity documents (T1 shape), one per (supplier, return flag).

    Emission fields are choice structs ``{double, long}``; flag ``R`` stores
    its total only in the ``long`` arm (lost by the strict extraction).  The
    nested ``tenantId`` repeats a root column in another case, ``date`` is
    ``yyyy/MM/dd`` text and ``lineCount`` is an extra field.
    """
    g = _supplier_flag_groups(spark, sf_dir)
    flag = F.col("l_returnflag")
    s = F.col("l_suppkey")

    def choice(double_value, long_value=None):
        return F.struct(
            double_value.cast("double").alias("double"),
            (long_value if long_value is not None else F.lit(None)).cast("bigint").alias("long"),
        )

    return g.select(
        F.concat(_tenant("l_suppkey"), F.lit("#"), s.cast("string"), F.lit("-"), flag).alias(
            "tenantactivitykey"
        ),
        flag.alias("activityid"),
        s.cast("string").alias("entityid"),
        F.concat(F.lit("F"), flag).alias("formid"),
        _tenant("l_suppkey").alias("tenantid"),
        (F.col("lines") % 7).cast("int").alias("versionid"),
        F.struct(
            choice(F.when(flag == "A", F.col("ep")), F.when(flag == "R", F.col("qty"))).alias(
                "emissionInKgCO2"
            ),
            choice(F.when(flag != "A", F.col("qty"))).alias("emissionInKgCO2_ForLocationBased"),
            choice(F.when(flag == "N", F.col("tax"))).alias("emissionInKgCO2_ForMarketBased"),
            F.date_format("shipdate", "yyyy/MM/dd").alias("date"),
            _tenant("l_suppkey").alias("tenantId"),
            F.col("lines").alias("lineCount"),
        ).alias("data"),
    )


def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entity documents (T2 shape), one per supplier, country from nation."""
    sup = table(spark, sf_dir, "supplier")
    nat = table(spark, sf_dir, "nation")
    j = sup.join(nat, sup.s_nationkey == nat.n_nationkey, "inner")
    s = F.col("s_suppkey")
    return j.select(
        F.concat(_tenant("s_suppkey"), F.lit("#"), s.cast("string")).alias("tenantentitykey"),
        s.cast("string").alias("entityid"),
        _tenant("s_suppkey").alias("tenantid"),
        F.col("s_name").alias("name"),
        ((s % 5) * 0.25).cast("double").alias("parentcontributionpercentage"),
        _parent("s_suppkey").alias("parententityid"),
        F.struct(
            F.format_string("%.2f", F.col("s_acctbal")).alias("baseline"),
            F.concat(F.lit("S"), s.cast("string")).alias("code"),
            F.when(s % 2 == 0, "equity").otherwise("control").alias("consolidateApproach"),
            F.col("n_name").alias("country"),
            F.concat(F.lit("industry-"), (s % 6).cast("string")).alias("industry"),
            F.concat(F.lit("manager-"), (s % 9).cast("string")).alias("manager"),
            F.when(s % 3 == 0, "owned").otherwise("leased").alias("operatingType"),
            ((s % 4) * 25).cast("string").alias("ownershipConsolidatePercentage"),
            ((s % 5) * 20).cast("string").alias("ownershipPercentage"),
            F.concat(F.col("n_name"), F.lit("-P"), (s % 7).cast("string")).alias("province"),
        ).alias("data"),
    )


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order documents for the flatten/choice tests (primitive nested fields).

    Root ``tenantId`` is the customer's tenant; nested ``TENANTID`` (another
    case) is the order's own tenant and must replace it when flattened.
    ``amount`` is a choice struct: urgent orders keep the total in ``long``.
    """
    o = table(spark, sf_dir, "orders")
    urgent = F.col("o_orderpriority").startswith("1")
    return o.select(
        F.col("o_orderkey"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tenantId"),
        F.struct(
            F.concat(F.lit("t"), (F.col("o_orderkey") % 4).cast("string")).alias("TENANTID"),
            F.col("o_orderstatus").alias("orderStatus"),
            F.col("o_totalprice").alias("totalPrice"),
            F.date_format("o_orderdate", "yyyy/MM/dd").alias("orderDate"),
            F.col("o_orderpriority").alias("orderPriority"),
        ).alias("data"),
        F.struct(
            F.when(~urgent, F.col("o_totalprice")).alias("double"),
            F.when(urgent, F.col("o_totalprice").cast("bigint")).alias("long"),
        ).alias("amount"),
    )


# Fixed configuration of the fixtures' principals (deployment-specific in
# real use, so kept neutral here).
PRINCIPAL_PREFIX = "urn:bi:user/"
ADMIN_PRINCIPALS = (
    "urn:bi:user/default/admin",
    "urn:bi:user/default/operator",
    "urn:bi:user/default/viewer",
)


def customer_rules(spark: SparkSession, sf_dir: str, with_admins: bool = True) -> DataFrame:
    """Rules table as stored (lower-case ``userarn``): one rule per customer
    principal ``c<custkey>`` for tenant ``t<nationkey mod 4>``, plus the
    unrestricted admin rows."""
    c = table(spark, sf_dir, "customer")
    tenant = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    rules = c.select(
        principal_name(tenant, PRINCIPAL_PREFIX).alias("userarn"),
        F.concat(F.lit("t"), (F.col("c_nationkey") % 4).cast("string")).alias("tenantid"),
    )
    if with_admins:
        admins = spark.createDataFrame([(a, "") for a in ADMIN_PRINCIPALS], "userarn string, tenantid string")
        rules = rules.unionByName(admins)
    return rules


def grant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant-created events: one per order, for tenant ``c<custkey>``,
    granting ``t<orderkey mod 4>``; later orders win (``seq``)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("tenant"),
        F.concat(F.lit("t"), (F.col("o_orderkey") % 4).cast("string")).alias("tenantid"),
        F.col("o_orderkey").alias("seq"),
    )


def activity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity-grain rows (every lineitem) with their tenant, for RLS."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        _tenant("l_suppkey").alias("tenantid"),
        "l_extendedprice",
    )
