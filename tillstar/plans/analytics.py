"""Sales analytics over the star, as DataFrame functions.

Q1-Q8 are the warehouse's queries (KPI row, three views, tier breakdown,
three table functions); Q9-Q22 are the roll-ups the dashboard computes from
their results.  Every function takes a ``Star`` and returns a DataFrame.  Three run a job
when called: the top-N functions pin their N rows, the heat map pins one row per
month and collects the months present (12 at most), and the trends of one year
read that year's key range from a stored calendar (two numbers).

Scale notes (the plans were checked with ``explain``):
* aggregates that feed a dimension join run first (group by the foreign
  key, then join the much smaller result), so the fact never shuffles for a
  dimension join it does not need;
* top-N uses ``TakeOrderedAndProject``; the N winners are pinned and joined without
  a hint, whatever N: the planner knows their size;
* favourite category / channel are computed only for the top-N customers
  (semi join on N keys), in one grouping-sets aggregation, picked with
  ``min_by`` (no sort of rows, no per-group lists);
* windows without a partition run only on per-month or top-N results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstar.functions.metrics import (
    MONEY, avg_of_sums, exact_avg, flag_count, int_sum, money_sum, pct, share_pct, weighted_mean,
    count_pct,
)
from tillstar.operators.joins import gathered, keep_existing, pin_small, semi_join
from tillstar.operators.ranking import change_pct_vs_previous, first_per_group, top_n
from tillstar.plans.calendar import hour_keys_of_year
from tillstar.star import Star

# Loyalty tiers in display rank order; calendar month order.
TIER_ORDER = ("Platinum", "Gold", "Silver")   # everything else ranks after these
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December")
TOP_N_MIN, TOP_N_MAX, TOP_N_DEFAULT = 5, 25, 10


def _desc(c: str) -> Column:
    # PostgreSQL puts NULLs first on DESC
    return F.col(c).desc_nulls_first()


def _asc(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def validate_top_n(n: int) -> int:
    """The dashboard's slider bounds (5..25).  The functions themselves take any n."""
    if not TOP_N_MIN <= int(n) <= TOP_N_MAX:
        raise ValueError(f"top N must be within {TOP_N_MIN}..{TOP_N_MAX}, got {n}")
    return int(n)


# --------------------------------------------------------------------------- Q1
def kpi_overview(star: Star) -> DataFrame:
    """Whole-fact KPI row; one row even on an empty fact (NULL sums, 0 orders)."""
    return star.fact.agg(
        money_sum("net_revenue").alias("total_revenue"),
        money_sum("profit").alias("total_profit"),
        F.count_distinct("order_id").alias("total_orders"),
        exact_avg("net_revenue").alias("avg_order_value"),
        int_sum("quantity").alias("total_units"),
        flag_count("return_flag").alias("total_returns"),
    )


# --------------------------------------------------------------------------- Q2
def category_performance(star: Star) -> DataFrame:
    """Per category over non-returned lines, highest revenue first.

    The fact is first reduced to one row per product (rows gathered by product, a hot
    one split), then joined to the product dimension for the category.
    """
    kept = star.fact.where(~F.col("return_flag")).select("product_sk", "quantity", "net_revenue", "profit", "discount_pct")
    per_product = gathered(kept, "product_sk").groupBy("product_sk").agg(
        F.sum("quantity").alias("qty"),
        F.sum("net_revenue").alias("rev"),
        F.sum("profit").alias("prof"),
        F.sum("discount_pct").alias("disc_sum"),
        F.count("discount_pct").alias("disc_n"),
    )
    return categories_of_products(per_product, star)


def categories_of_products(per_product: DataFrame, star: Star) -> DataFrame:
    """Q2 from one row per product: ``product_sk, qty, rev, prof, disc_sum, disc_n``."""
    cats = per_product.join(star.products.select("product_sk", "category"), "product_sk")
    out = cats.groupBy("category").agg(
        F.count_distinct("product_sk").alias("unique_products"),
        int_sum("qty").alias("total_quantity"),
        money_sum("rev").alias("total_revenue"),
        money_sum("prof").alias("total_profit"),
        avg_of_sums(F.sum("disc_sum"), F.sum("disc_n")).alias("avg_discount_pct"),
        pct(F.sum("prof"), F.sum("rev")).alias("profit_margin_pct"),
    )
    return out.orderBy(_desc("total_revenue"), _asc("category"))


# --------------------------------------------------------------------------- Q3
def channel_performance(star: Star) -> DataFrame:
    out = star.fact.groupBy("sales_channel").agg(
        F.count_distinct("order_id").alias("total_orders"),
        int_sum("quantity").alias("total_units"),
        money_sum("net_revenue").alias("total_revenue"),
        exact_avg("net_revenue").alias("avg_order_value"),
        exact_avg("discount_pct").alias("avg_discount_pct"),
        flag_count("return_flag").alias("total_returns"),
    )
    return out.orderBy(_desc("total_revenue"), _asc("sales_channel"))


# --------------------------------------------------------------------------- Q4
def region_performance(star: Star) -> DataFrame:
    """Per (region, country).  Sums come from one row per store; orders from one row per order, with a bit
    for each (region, country) that it has a line of.  Two distinct counts in one aggregate
    would expand every fact row three times."""
    f = star.fact.select("store_sk", "order_id", "net_revenue", "profit")
    s = star.stores.select("store_sk", "region", "country")
    per_store = f.groupBy("store_sk").agg(
        F.sum("net_revenue").alias("rev"), F.sum("profit").alias("prof"), F.count("net_revenue").alias("n"))
    # one row per region and country: numbered in one task, 64 of them to a word of bits
    places = s.select(F.col("region").alias("r"), F.col("country").alias("c")).distinct().withColumn(
        "place", F.row_number().over(Window.orderBy("r", "c")) - 1)
    placed = s.join(places, F.col("region").eqNullSafe(F.col("r")) & F.col("country").eqNullSafe(F.col("c"))).select(
        "store_sk", F.expr("cast(place div 64 AS int)").alias("word"), F.expr("shiftleft(1L, place % 64)").alias("bit"))
    per_order = f.select("store_sk", "order_id").where(F.col("order_id").isNotNull()).join(placed, "store_sk").groupBy("order_id", "word").agg(
        F.bit_or("bit").alias("bits"))
    counts = per_order.select(F.explode(F.expr("transform(filter(sequence(0, 63), i -> getbit(bits, i) = 1), i -> word * 64 + i)")).alias("place"))
    orders = counts.groupBy("place").agg(F.count(F.lit(1)).alias("total_orders")).join(places, "place")
    return regions_of_stores(per_store, orders.select(F.col("r").alias("region"), F.col("c").alias("country"), "total_orders"), star)


def regions_of_stores(per_store: DataFrame, orders: DataFrame, star: Star) -> DataFrame:
    """Q4 from one row per store (``store_sk, rev, prof, n``) and one per region and country with orders
    (``region, country, total_orders``)."""
    s = star.stores.select("store_sk", "region", "country")
    sums = per_store.join(s, "store_sk").groupBy("region", "country").agg(
        F.count_distinct("store_sk").alias("store_count"),
        money_sum("rev").alias("total_revenue"),
        money_sum("prof").alias("total_profit"),
        avg_of_sums(F.sum("rev"), F.sum("n")).alias("avg_order_value"),
    )
    orders = orders.select(F.col("region").alias("r"), F.col("country").alias("c"), "total_orders")
    out = sums.join(orders, F.col("region").eqNullSafe(F.col("r")) & F.col("country").eqNullSafe(F.col("c")), "left").select(
        "region", "country", "store_count", "total_revenue", "total_profit", F.coalesce("total_orders", F.lit(0)).alias("total_orders"), "avg_order_value")
    return out.orderBy(_desc("total_revenue"), _asc("region"), _asc("country"))


# --------------------------------------------------------------------------- Q5
def tier_rank(col: str = "loyalty_tier") -> Column:
    rank = F.lit(len(TIER_ORDER) + 1)
    for i, tier in reversed(list(enumerate(TIER_ORDER, start=1))):
        rank = F.when(F.col(col) == tier, F.lit(i)).otherwise(rank)
    return rank


def customers_by_loyalty_tier(star: Star) -> DataFrame:
    out = star.customers.groupBy("loyalty_tier").agg(
        F.count("*").alias("customer_count"),
        exact_avg("age", 1).alias("avg_age"),
    )
    return out.orderBy(tier_rank(), _asc("loyalty_tier"))


# --------------------------------------------------------------------------- Q6
def top_selling_products(star: Star, n: int = TOP_N_DEFAULT) -> DataFrame:
    """Top-n products by net revenue over non-returned lines; ties -> smaller key.

    All products are summed by the ranked measure alone; the other measures and the orders are taken
    from the lines of the n best, so a task keeps two numbers of a product instead of a row of
    sums, and never a group for each (product, order)."""
    kept = star.fact.where(~F.col("return_flag"))
    revenue = gathered(kept.select("product_sk", "net_revenue"), "product_sk").groupBy("product_sk").agg(
        money_sum("net_revenue").alias("total_revenue"))

    def with_measures(top: DataFrame) -> DataFrame:
        mine = semi_join(kept.select("product_sk", "order_id", "quantity", "net_revenue", "total_cost", "profit",
                                     "unit_price", "discount_pct"), top.select("product_sk"), "product_sk")
        measures = mine.groupBy("product_sk").agg(
            int_sum("quantity").alias("total_quantity"),
            money_sum("total_cost").alias("total_cost"),
            money_sum("profit").alias("total_profit"),
            pct(F.sum("profit"), F.sum("net_revenue")).alias("profit_margin"),
            exact_avg("unit_price").alias("avg_unit_price"),
            exact_avg("discount_pct").alias("avg_discount_pct"),
            F.count_distinct("order_id").alias("total_orders"),
        )
        return top.join(measures, "product_sk")

    return top_products_of(revenue, star, n, with_measures)


def top_products_of(stats: DataFrame, star: Star, n: int, complete: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Q6 from one row per product.  ``complete`` adds to the n best the columns that ``stats`` lacks."""
    # inner-join semantics of the warehouse query: only products in the dimension
    stats = keep_existing(stats, star.products, "product_sk")
    top = pin_small(top_n(stats, n, [_desc("total_revenue"), _asc("product_sk")]))
    if complete is not None:
        top = complete(top)
    out = star.products.select("product_sk", "product_name", "category", "brand").join(top, "product_sk")
    return out.select(
        "product_sk", "product_name", "category", "brand", "total_quantity", "total_revenue",
        "total_cost", "total_profit", "profit_margin", "avg_unit_price", "total_orders",
        "avg_discount_pct",
    ).orderBy(_desc("total_revenue"), _asc("product_sk"))


# --------------------------------------------------------------------------- Q7
def monthly_revenue_trends(star: Star, year: int | None = None) -> DataFrame:
    """Per (year, month): revenue, profit, cost, orders, units, AOV, returns,
    return rate = returned lines / distinct orders x 100, and revenue change
    against the previous month present (the year filter applies first)."""
    t = star.time.select("time_sk", "year", "month", "month_name")
    fact = star.fact
    if year is not None:
        t = t.where(F.col("year") == int(year))
        # The year's time_sk bounds as a literal range on the fact: a superset that the join
        # narrows exactly, by which the parquet reader can skip row groups.  Hour keys
        # follow from the year; other keys are read from the (stored) calendar.
        lo, hi = hour_keys_of_year(int(year)) if star.hour_epoch_keys else t.agg(F.min("time_sk"), F.max("time_sk")).first()
        fact = fact.where(F.col("time_sk").between(F.lit(lo), F.lit(hi)))
    # the calendar has one row per hour of the covered span, however many sales there are:
    # under 100,000 for ten years
    monthly = fact.join(F.broadcast(t), "time_sk").groupBy("year", "month", "month_name").agg(
        money_sum("net_revenue").alias("total_revenue"),
        money_sum("profit").alias("total_profit"),
        money_sum("total_cost").alias("total_cost"),
        F.count_distinct("order_id").alias("total_orders"),
        int_sum("quantity").alias("total_quantity"),
        exact_avg("net_revenue").alias("avg_order_value"),
        flag_count("return_flag").alias("total_returns"),
    )
    return trends_of_months(monthly)


def trends_of_months(monthly: DataFrame) -> DataFrame:
    """Q7 from one row per month (its sums, orders and returns)."""
    monthly = monthly.select(
        F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"),
        "month_name", "total_revenue", "total_profit", "total_cost", "total_orders",
        "total_quantity", "avg_order_value", "total_returns",
        count_pct("total_returns", "total_orders").alias("return_rate"),
    )
    # single-partition window, but over one row per month only
    out = monthly.withColumn("mom_revenue_chg", change_pct_vs_previous("total_revenue", ["year", "month"]))
    return out.orderBy("year", "month")


# --------------------------------------------------------------------------- Q8
def top_customers(star: Star, n: int = TOP_N_DEFAULT) -> DataFrame:
    """Top-n customers by net revenue (all lines), with favourite category (by
    revenue) and favourite channel (by line count); ties -> name ascending."""
    f = star.fact
    stats = f.groupBy("customer_sk").agg(
        money_sum("net_revenue").alias("total_revenue"),
        money_sum("profit").alias("total_profit"),
        F.count_distinct("order_id").alias("total_orders"),
        int_sum("quantity").alias("total_quantity"),
        exact_avg("net_revenue").alias("avg_order_value"),
        flag_count("return_flag").alias("total_returns"),
    )
    return top_customers_of(stats, star, n)


def top_customers_of(stats: DataFrame, star: Star, n: int, with_orders: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Q8 from one row per customer; the favourites of the n best come from the fact.  ``with_orders`` adds
    ``total_orders`` to these where ``stats`` lacks it."""
    f = star.fact
    stats = keep_existing(stats, star.customers, "customer_sk")
    # n rows, referenced three times below: computed once, lineage cut
    top = pin_small(top_n(stats, n, [_desc("total_revenue"), _asc("customer_sk")]))
    if with_orders is not None:
        top = pin_small(with_orders(top))

    # Favourites only for the n winners: the fact restricted to the n keys and reduced to
    # (customer, product, channel).  Both picks then come out of ONE grouping-sets aggregate and ONE groupBy that
    # reads both measures, so Catalyst cannot split the reduction into two
    # differently pruned scans of the fact.  `matched` keeps the warehouse's
    # inner join with the product dimension for the category pick only
    # (product_sk is the dimension's primary key).
    mine = semi_join(f, top.select("customer_sk"), "customer_sk")
    cpc = mine.groupBy("customer_sk", "product_sk", "sales_channel").agg(
        F.sum("net_revenue").alias("rev"), F.count("*").alias("lines"))
    cats = star.products.select("product_sk", "category", F.lit(True).alias("matched"))
    keys = ["customer_sk", "category", "matched", "sales_channel"]
    sets = cpc.join(cats, "product_sk", "left").groupingSets(
        [["customer_sk", "category", "matched"], ["customer_sk", "sales_channel"]], *keys
    ).agg(F.grouping_id(*keys).alias("gid"), F.sum("rev").alias("rev"), F.sum("lines").alias("lines"))
    per_category = (F.col("gid") == 0b0001) & F.col("matched")   # sales_channel rolled up
    per_channel = F.col("gid") == 0b0110                          # category, matched rolled up
    favourites = sets.groupBy("customer_sk").agg(
        F.min_by("category", F.when(per_category, F.struct(-F.col("rev"), F.col("category"))))
        .alias("favourite_category"),
        F.min_by("sales_channel", F.when(per_channel, F.struct(-F.col("lines"), F.col("sales_channel"))))
        .alias("favourite_channel"),
    )

    people = star.customers.select(
        "customer_sk",
        F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("full_name"),
        "email", "loyalty_tier", "country", F.col("age").cast("int").alias("age"),
    )
    out = people.join(top, "customer_sk").join(favourites, "customer_sk", "left")
    return out.select(
        "customer_sk", "full_name", "email", "loyalty_tier", "country", "age", "total_revenue",
        "total_profit", "total_orders", "total_quantity", "avg_order_value", "total_returns",
        "favourite_category", "favourite_channel",
    ).orderBy(_desc("total_revenue"), _asc("customer_sk"))


def favourite_channels(star: Star) -> DataFrame:
    """Every customer's channel with most lines; ties -> name ascending."""
    lines = star.fact.groupBy("customer_sk", "sales_channel").agg(F.count(F.lit(1)).alias("lines"))
    return first_per_group(lines, ["customer_sk"], "sales_channel", [-F.col("lines"), F.col("sales_channel")], "favourite_channel")


# --------------------------------------------------------------------------- Q9
def year_options(star: Star) -> DataFrame:
    """Distinct calendar years, ascending."""
    return star.time.select(F.col("year").cast("int").alias("year")).distinct().orderBy("year")


def year_filter_options(star: Star) -> DataFrame:
    """'All Years' (NULL year, no filter) followed by each year."""
    years = year_options(star)
    # the literal row comes from a one-row global aggregate over the years
    first = years.agg(F.lit("All Years").alias("label"), F.lit(None).cast("int").alias("year"),
                      F.lit(0).alias("pos"))
    rest = years.select(F.col("year").cast("string").alias("label"), "year", F.lit(1).alias("pos"))
    return first.unionByName(rest).orderBy("pos", "year").drop("pos")


# -------------------------------------------------------------------- Q10 - Q22
def top_products_kpis(star: Star, n: int = TOP_N_DEFAULT) -> DataFrame:
    top = top_selling_products(star, n)
    return top.agg(
        money_sum("total_revenue").alias("total_revenue"),
        money_sum("total_profit").alias("total_profit"),
        int_sum("total_quantity").alias("units_sold"),
        exact_avg("profit_margin").alias("avg_margin"),
    )


def _share(df: DataFrame, key: str, value: str = "total_revenue") -> DataFrame:
    g = df.groupBy(key).agg(money_sum(value).alias(value))
    return g.select(key, value, share_pct(value).alias("share_pct")).orderBy(_desc(value), _asc(key))


def top_products_category_share(star: Star, n: int = TOP_N_DEFAULT) -> DataFrame:
    return _share(top_selling_products(star, n), "category")


def trend_kpis(star: Star, year: int | None = None) -> DataFrame:
    t = monthly_revenue_trends(star, year)
    return t.agg(
        money_sum("total_revenue").alias("total_revenue"),
        money_sum("total_profit").alias("total_profit"),
        int_sum("total_orders").alias("total_orders"),
        exact_avg("return_rate").alias("avg_return_rate"),
    )


def period_label(year: str = "year", month: str = "month") -> Column:
    return F.concat(F.col(year).cast("string"), F.lit("-"), F.lpad(F.col(month).cast("string"), 2, "0"))


def mom_series(star: Star, year: int | None = None) -> DataFrame:
    t = monthly_revenue_trends(star, year).where(F.col("mom_revenue_chg").isNotNull())
    return t.select(
        period_label().alias("period"),
        "mom_revenue_chg",
        F.when(F.col("mom_revenue_chg") >= 0, F.lit("up")).otherwise(F.lit("down")).alias("direction"),
    ).orderBy("period")


def revenue_heatmap(star: Star, year: int | None = None) -> DataFrame:
    """Year x month-name revenue table, months in calendar order, only the
    months present (collects at most 12 month numbers to name the columns)."""
    # one row per month: pinned so the fact is aggregated once for both uses
    t = pin_small(monthly_revenue_trends(star, year))
    present = sorted(r[0] for r in t.select("month").distinct().collect())
    names = [MONTHS[m - 1] for m in present]
    if not names:
        return t.select("year").limit(0)
    out = t.groupBy("year").pivot("month_name", names).agg(money_sum("total_revenue"))
    return out.select("year", *names).orderBy("year")


def monthly_series(star: Star, year: int | None = None) -> DataFrame:
    t = monthly_revenue_trends(star, year)
    return t.select(
        period_label().alias("period"), "total_revenue", "total_profit", "total_cost",
        "total_orders", "avg_order_value", "return_rate",
    ).orderBy("period")


def top_customers_kpis(star: Star, n: int = TOP_N_DEFAULT) -> DataFrame:
    top = top_customers(star, n)
    return top.agg(
        money_sum("total_revenue").alias("total_revenue"),
        money_sum("total_profit").alias("total_profit"),
        int_sum("total_orders").alias("total_orders"),
        exact_avg("avg_order_value").alias("avg_aov"),
    )


def top_customers_tier_share(star: Star, n: int = TOP_N_DEFAULT) -> DataFrame:
    return _share(top_customers(star, n), "loyalty_tier")


def top_customers_country_share(star: Star, n: int = TOP_N_DEFAULT) -> DataFrame:
    return _share(top_customers(star, n), "country")


def top_customers_favourite_categories(star: Star, n: int = TOP_N_DEFAULT) -> DataFrame:
    """``value_counts`` of favourite categories (NULLs dropped), most common first."""
    top = top_customers(star, n).where(F.col("favourite_category").isNotNull())
    out = top.groupBy(F.col("favourite_category").alias("category")).agg(F.count("*").alias("count"))
    return out.orderBy(F.col("count").desc(), _asc("category"))


def region_country_rollup(star: Star) -> DataFrame:
    """Region -> country hierarchy: country leaves and region parents.
    A parent's ``weighted_profit`` is the revenue-weighted mean of its
    countries' profit; a leaf's is its own profit."""
    r = region_performance(star)
    g = r.rollup("region", "country").agg(
        F.grouping_id().alias("gid"),
        money_sum("total_revenue").alias("total_revenue"),
        weighted_mean("total_profit", "total_revenue").alias("weighted_profit"),
    ).where(F.col("gid") < 3)
    return g.select(
        "region", "country",
        F.when(F.col("gid") == 0, F.lit("country")).otherwise(F.lit("region")).alias("level"),
        "total_revenue", "weighted_profit",
    ).orderBy(_asc("region"), F.col("level").desc(), _asc("country"))


def channel_share(star: Star) -> DataFrame:
    return _share(channel_performance(star), "sales_channel")


# Fixed value: columns of the customer detail table.
CUSTOMER_TABLE_COLUMNS = (
    "full_name", "loyalty_tier", "country", "age", "total_revenue", "total_profit",
    "total_orders", "avg_order_value", "total_returns", "favourite_category", "favourite_channel",
)


def customer_table(star: Star, n: int = TOP_N_DEFAULT) -> DataFrame:
    return top_customers(star, n).select(*CUSTOMER_TABLE_COLUMNS)
