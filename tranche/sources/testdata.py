"""Build ``agreements`` (T1) from the driver's star-schema tables.

The domain's agreement table does not exist in the test data, so one adapter
maps it (SURVEY §7.2): an order is an agreement, a customer is a company, the
nation is the regional office, the region the activity section, the market
segment the sector group; the lineitem count is the instalment count and the
last ship date the end date.

Plan shape at scale:
  * lineitem is pre-aggregated per order (count, max ship date) before the
    join, so the shuffle moves one row per order, not per line; the join to
    orders reuses that hash partitioning on the order key.
  * customer is enriched with nation and region: files of a few kB, which the
    planner broadcasts by their size (no hint, so no size to check).
  * orders -> customer is a ``lookup_join``: a company holding a third of all
    orders is split across salt buckets instead of landing in one task.

Drill-downs name what they want by literals (``Wanted``: companies or agreements,
at most ``MAX_WANTED``), which reach the scans of orders, customer and lineitem; of
lineitem only the lines of the wanted orders are grouped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranche import config as C
from tranche.functions import exprs as X
from tranche.operators.skew import SMALL, Hot, count_hot, lookup_join, row_count_at_most
from tranche.sources.tables import read_table

# Mapping rules of the adapter (fixed values).
# o_orderstatus F -> QUITADO (5), O -> ATIVO (1),
# P -> PENDENTE 1ª PARCELA (6) when o_orderkey % 5 = 0, else CANCELADO (2).
# Order priority digit 1..5 -> ICMS, DÍVIDA ATIVA, DECLARADO, RECUPERA+, OUTROS.
PRIORITY_CATEGORY = {"1": "ICMS", "2": "DÍVIDA ATIVA", "3": "DECLARADO", "4": "RECUPERA+", "5": "OUTROS"}
ROOT_ID_WIDTH = 8
BRANCH_SUFFIX = "000100"
MAX_WANTED = 1_000            # keys of a drill-down, sent as literals
MAX_ORDER_KEYS = 1_000_000    # order keys of a drill-down's companies that are broadcast to lineitem's scan


@dataclass(frozen=True)
class Wanted:
    """What a drill-down reads: the agreements of some customers, or some agreements, or some of theirs."""

    customers: tuple[int, ...] | None = None
    orders: tuple[int, ...] | None = None

    def __post_init__(self):
        if max(len(self.customers or ()), len(self.orders or ())) > MAX_WANTED:
            raise ValueError(f"a drill-down takes at most {MAX_WANTED} keys")


def _among(column: str, keys: tuple[int, ...]) -> F.Column:
    return F.col(column) == keys[0] if len(keys) == 1 else F.col(column).isin(list(keys)) if keys else F.lit(False)


def company_dim(spark: SparkSession, sf_dir: str, customers: tuple[int, ...] | None = None) -> DataFrame:
    """One row per customer with its regional office, section and sector."""
    customer = read_table(spark, sf_dir, "customer",
                          ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    if customers is not None:
        customer = customer.where(_among("c_custkey", customers))
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return (customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
            .join(region, nation.n_regionkey == region.r_regionkey, "left")
            .select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal", "c_mktsegment",
                    "n_nationkey", "n_name", "r_name"))


def _orders(spark: SparkSession, sf_dir: str, wanted: Wanted = Wanted()) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                         "o_orderdate", "o_orderpriority"])
    if wanted.customers is not None:
        orders = orders.where(_among("o_custkey", wanted.customers))
    if wanted.orders is not None:
        orders = orders.where(_among("o_orderkey", wanted.orders))
    return orders


def _lines(spark: SparkSession, sf_dir: str, wanted: Wanted) -> DataFrame:
    """Lineitem's columns in use; of a drill-down, only the lines of its orders."""
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate"])
    if wanted.orders is not None:
        return lines.where(_among("l_orderkey", wanted.orders))
    if wanted.customers is not None:
        keys = _orders(spark, sf_dir, wanted).select(F.col("o_orderkey").alias("l_orderkey"))
        return lines.join(F.broadcast(keys) if row_count_at_most(keys, MAX_ORDER_KEYS) else keys, "l_orderkey", "left_semi")
    return lines


def hot_customers(spark: SparkSession, sf_dir: str, params: C.Params = C.DEFAULT) -> Hot:
    """Customers with very many orders, counted once (see skew.py)."""
    return count_hot(_orders(spark, sf_dir), "o_custkey", params.skew)


def hot_companies(hot: Hot) -> Hot:
    """The same hot set keyed as ``cnpj_raiz``, for joins on T1."""
    return hot.renamed(hot.keys.select(X.normalize_tax_id(F.col("o_custkey"), ROOT_ID_WIDTH).alias("cnpj_raiz"), "_n"))


def customers_of(roots: list[str]) -> tuple[int, ...]:
    """Company keys (``cnpj_raiz``) as the source's customer keys; other texts name no customer."""
    return tuple(sorted({int(r) for r in roots if r and r.isascii() and r.isdigit() and len(r) <= 18}))


def root_of(customer: int) -> str:
    """A customer key as company key, as T1 writes it."""
    return str(customer).replace("-", "").rjust(ROOT_ID_WIDTH, "0")


def top_orders(spark: SparkSession, sf_dir: str, cd_gerfe: int, limit: int, params: C.Params = C.DEFAULT,
               hot: Hot | None = None) -> Wanted:
    """The ``limit`` largest agreements of a region with their customers, found from three columns of orders
    and the region's customers; everything else is then read for these few only."""
    local = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).where(F.col("c_nationkey") == F.lit(cd_gerfe))
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", F.col("o_totalprice").cast(X.MONEY).alias("value"))
    mine = lookup_join(orders.where("o_custkey IS NOT NULL"), local.select(F.col("c_custkey").alias("o_custkey")), "o_custkey",
                       ["o_orderkey"], params.skew, "left_semi", hot if hot is not None else hot_customers(spark, sf_dir, params))
    rows = mine.orderBy(F.col("value").desc_nulls_last(), "o_orderkey").limit(limit).collect()
    return Wanted(tuple(sorted({r["o_custkey"] for r in rows})), tuple(r["o_orderkey"] for r in rows))


def _order_rows(spark: SparkSession, sf_dir: str, wanted: Wanted = Wanted()) -> DataFrame:
    """Orders with the number of their lines and the last ship date."""
    orders = _orders(spark, sf_dir, wanted)
    lines = (_lines(spark, sf_dir, wanted)
             .groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n_lines"), F.max("l_shipdate").alias("last_ship")))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").drop("l_orderkey")


def _as_agreements(o: DataFrame) -> DataFrame:
    """T1's own columns from those of ``_order_rows``, other columns untouched."""
    mine = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "n_lines", "last_ship"]
    others = [c for c in o.columns if c not in mine]
    status = (F.when(F.col("o_orderstatus") == "F", F.lit(C.ST_SETTLED))
              .when(F.col("o_orderstatus") == "O", F.lit(C.ST_ACTIVE))
              .when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0), F.lit(C.ST_PENDING))
              .when(F.col("o_orderstatus") == "P", F.lit(C.ST_CANCELLED)))
    category = X.case_map(F.substring("o_orderpriority", 1, 1), PRIORITY_CATEGORY)
    n = F.coalesce(F.col("n_lines"), F.lit(0)).cast("int")
    root = X.normalize_tax_id(F.col("o_custkey"), ROOT_ID_WIDTH)
    origin_label = X.case_map(F.pmod(F.col("o_orderkey"), F.lit(4)), dict(enumerate(C.DEBT_ORIGINS)))
    base = o.select(
        F.col("o_orderkey").alias("num_parcelamento"),
        F.when(root.isNotNull(), F.concat(root, F.lit(BRANCH_SUFFIX))).alias("cnpj"),
        root.alias("cnpj_raiz"),
        category.alias("categoria_parcelamento"),
        status.cast("int").alias("cd_status"),
        F.col("o_totalprice").cast(X.MONEY).alias("valor_parcelado"),
        n.alias("num_parcelas"),
        F.col("o_orderdate").alias("dt_pedido"),
        F.col("last_ship"),
        origin_label.alias("origem_debito"),
        *others,
    )
    ended = F.col("cd_status").isin(C.ST_SETTLED, C.ST_CANCELLED)
    return base.select(
        "num_parcelamento", "cnpj", "cnpj_raiz", "categoria_parcelamento",
        "cd_status", X.status_label("cd_status").alias("desc_status"), "valor_parcelado",
        "num_parcelas", X.instalment_band("num_parcelas").alias("faixa_parcelas"), "dt_pedido",
        F.when(ended & (F.col("last_ship") >= F.col("dt_pedido")), F.col("last_ship")).alias("dt_fim"),
        F.when(F.col("num_parcelas") == 1, F.lit(C.JOIN_SINGLE)).otherwise(F.lit(C.JOIN_INSTALMENTS)).alias("tipo_adesao"),
        "origem_debito", *others,
    )


def agreements_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 without the company registry attributes: orders + lineitem only.

    Consumers that need nothing but the company key (series, recovery,
    receipts, band/programme metrics) read this and skip the orders ->
    customer join, which Catalyst cannot drop on its own (it cannot prove the
    customer side unique)."""
    return _as_agreements(_order_rows(spark, sf_dir))


def agreements(spark: SparkSession, sf_dir: str, params: C.Params = C.DEFAULT,
               hot_cust: Hot | None = None, wanted: Wanted = Wanted()) -> DataFrame:
    """One row per agreement (unique ``num_parcelamento``), enriched with
    the company's registry attributes.  A drill-down's few companies are broadcast.

    The source's few columns are what goes through the join; T1's are made from them after it."""
    core = _order_rows(spark, sf_dir, wanted)
    dim = company_dim(spark, sf_dir, wanted.customers)
    if wanted.customers is not None:
        hot = SMALL
    else:
        hot = hot_cust if hot_cust is not None else hot_customers(spark, sf_dir, params)
    j = lookup_join(core, dim, "o_custkey", ["o_orderkey"], params.skew, hot=hot)
    return _as_agreements(j).select(
        "num_parcelamento", "cnpj", "cnpj_raiz",
        F.col("c_name").alias("razao_social"),
        F.col("n_nationkey").cast("int").alias("cd_gerfe"),
        F.col("n_name").alias("gerfe"),
        F.col("c_mktsegment").alias("ges"),
        F.col("r_name").alias("descricao_secao"),
        F.when(F.col("c_acctbal") < 0, F.lit("BAIXADA")).otherwise(F.lit("ATIVA")).alias("situacao_cadastral"),
        F.when(F.col("c_acctbal") < 0, F.lit(1)).otherwise(F.lit(0)).alias("flag_simples_nacional"),
        "categoria_parcelamento", "cd_status", "desc_status", "valor_parcelado", "num_parcelas",
        "faixa_parcelas", "dt_pedido", "dt_fim", "tipo_adesao", "origem_debito")
