"""Collateral queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanweave.fixed import COUPON_BANDS, FICO_BANDS, LTV_BANDS, STRATIFICATIONS, Bands
from loanweave.functions.columns import band, region, weighted_average
from loanweave.operators import collateral as C
from loanweave.plans.catalog.base import Catalog
from loanweave.plans.oracle import (
    PORTFOLIO_FLOATS,
    STRAT_FLOATS,
    bands,
    portfolio,
    regions,
    strat,
    wa,
)

DISCOUNT_BANDS = Bands((0.0, 0.02, 0.05, 0.08, 0.11), ("0-2%", "2-5%", "5-8%", "8-11%"))


def _label(which: str) -> str:
    column, edges, _ = STRATIFICATIONS[which]
    return bands(column, edges.edges, edges.labels) if edges else column


def register(catalog: Catalog) -> None:
    add = catalog.add
    averaged = ("fico", "original_ltv", "dti", "current_interest_rate")
    add(
        "weighted_average",
        lambda c: c.panel_of(("origination_year", "current_upb", *averaged)).table
        .groupBy("origination_year").agg(
            *[weighted_average(v).alias(f"wa_{v}") for v in averaged]
        ),
        "SELECT origination_year, "
        + ", ".join(f"{wa(v)} AS wa_{v}" for v in averaged)
        + " FROM panel GROUP BY ALL",
        " ".join(f"wa_{v}" for v in averaged),
    )
    add("portfolio_metrics", lambda c: C.portfolio_metrics(c.latest), portfolio("latest"),
        PORTFOLIO_FLOATS)
    add(
        "largest_state",
        lambda c: C.largest_state(c.latest),
        """SELECT property_state AS largest_state, 100 * sum(current_upb)
             / (SELECT sum(current_upb) FROM latest) AS largest_state_pct
           FROM latest GROUP BY 1 ORDER BY sum(current_upb) DESC, 1 LIMIT 1""",
        "largest_state_pct",
    )
    banded = ("fico", "ltv", "dti", "coupon", "loan_age")
    add(
        "band_assign",
        lambda c: c.panel.groupBy(
            *[band(STRATIFICATIONS[w][0], STRATIFICATIONS[w][1]).alias(f"{w}_band") for w in banded]
        ).agg(F.count(F.lit(1)).alias("n")),
        "SELECT "
        + ", ".join(f"{_label(w)} AS {w}_band" for w in banded)
        + ", count(*) AS n FROM panel GROUP BY ALL",
    )
    for which, (_, _, name) in STRATIFICATIONS.items():
        add(
            f"strat_{which}",
            lambda c, which=which: C.strat(c.latest, which),
            strat("latest", _label(which), name),
            STRAT_FLOATS,
        )
    add(
        "strat_all",
        lambda c: C.strat_all(c.latest),
        " UNION ALL ".join(
            strat("latest", f"CAST({_label(w)} AS VARCHAR)", "label", f"'{w}' AS dimension,")
            for w in STRATIFICATIONS
        ),
        STRAT_FLOATS,
    )
    add(
        "state_group",
        lambda c: c.latest.groupBy("property_state", region("property_state").alias("state_group"))
        .agg(F.count(F.lit(1)).alias("n")),
        f"SELECT property_state, {regions('DC_MD')} AS state_group, count(*) AS n "
        "FROM latest GROUP BY ALL",
    )
    cell = strat("latest", "1", "one")
    means = cell[cell.index("sum(current_interest_rate"):cell.index("100 * sum")]
    add(
        "replines",
        lambda c: C.replines(c.latest, min_cell_loans=2),
        f"""SELECT {bands('fico', FICO_BANDS.edges, FICO_BANDS.labels)} AS fico_band,
              {bands('original_ltv', LTV_BANDS.edges, LTV_BANDS.labels)} AS ltv_band,
              {bands('original_interest_rate', COUPON_BANDS.edges, COUPON_BANDS.labels)}
                AS coupon_band,
              origination_year, {regions('DC_MD')} AS state_group, count(*) AS loan_count,
              sum(current_upb) AS upb, {means.replace('wa_coupon', 'wac')}
              sum(loan_age * current_upb) / nullif(sum(current_upb), 0) AS wala,
              100 * sum(current_upb) / (SELECT sum(current_upb) FROM latest) AS pool_pct,
              count(*) < 2 AS small_cell
            FROM latest GROUP BY ALL""",
        "upb wac wa_fico wa_ltv wa_dti wala pool_pct",
    )
    ltv = _label("ltv")
    add(
        "fico_ltv_heatmap",
        lambda c: C.fico_ltv_heatmap(c.latest),
        f"SELECT {_label('fico')} AS fico_band, "
        + ", ".join(
            f"count(*) FILTER (WHERE {ltv} = '{x}') AS \"{x}\"" for x in (*LTV_BANDS.labels, "Other")
        )
        + " FROM latest GROUP BY ALL",
    )
    add(
        "universe_filter",
        lambda c: C.universe(c.latest, "P", "P", (620, 800), (0, 100)).select(
            "loan_id", "fico", "original_ltv", "current_upb"
        ),
        """SELECT loan_id, fico, original_ltv, current_upb FROM latest
           WHERE loan_purpose = 'P' AND occupancy = 'P'
             AND ifnull(fico BETWEEN 620 AND 800, true)
             AND ifnull(original_ltv BETWEEN 0 AND 100, true)""",
        "original_ltv current_upb",
    )
    # The same operators on a table that is no loan panel.
    add(
        "strat_lineitem_discount",
        lambda c: C.stratify_by_band(
            c.table("lineitem").select(
                (F.col("l_discount") + F.lit(0.0)).alias("discount"),
                F.col("l_extendedprice").alias("current_upb"),
                (F.col("l_tax") + F.lit(0.0)).alias("current_interest_rate"),
                F.col("l_quantity").alias("fico"),
                F.col("l_discount").alias("original_ltv"),
                F.col("l_tax").alias("dti"),
            ),
            "discount",
            DISCOUNT_BANDS,
            "discount_band",
        ),
        strat(
            "items",
            bands("discount", DISCOUNT_BANDS.edges, DISCOUNT_BANDS.labels),
            "discount_band",
        ),
        STRAT_FLOATS,
        """items AS (SELECT l_discount + 0e0 AS discount, l_extendedprice AS current_upb,
             l_tax AS current_interest_rate, l_quantity AS fico, l_discount AS original_ltv,
             l_tax AS dti FROM lineitem)""",
    )
    add(
        "weighted_tax_by_flag",
        lambda c: c.table("lineitem")
        .groupBy("l_returnflag")
        .agg(weighted_average("l_tax", "l_extendedprice").alias("wa_tax")),
        f"SELECT l_returnflag, {wa('l_tax', 'l_extendedprice')} AS wa_tax "
        "FROM lineitem GROUP BY ALL",
        "wa_tax",
    )
