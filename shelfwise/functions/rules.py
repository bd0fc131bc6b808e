"""Business rules as Column expressions (one function per rule of the reports).

Each function takes the input columns and returns a Column, so the same rule is
used by several jobs and tested on hand-made rows (tests/test_rules.py).
CASE branches are kept in the reports' order, since a NULL comparison falls
through to the next branch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .exprs import dec, greatest_strict, round_half_away

# --------------------------------------------------------------------- margin


def country(website_id: Column) -> Column:
    expr = None
    for site, name in P.COUNTRY_BY_WEBSITE.items():
        expr = F.when(website_id == site, name) if expr is None else expr.when(website_id == site, name)
    return expr


def bol_fixed_commission(channel: Column, product_id: Column, line_total: Column, qty: Column) -> Column:
    """Fee per unit by unit price tier; 10 is in the low tier, 20 in the middle."""
    price = F.abs(line_total / qty)
    (low, low_fee), (mid, mid_fee) = P.BOL_FIXED_TIERS
    tier = (F.when(price <= low, dec(low_fee) * qty)
            .when(price <= mid, dec(mid_fee) * qty)
            .when(price > mid, dec(P.BOL_FIXED_TOP) * qty))
    return F.when((channel == "BOL") & (product_id > 0), tier).otherwise(F.lit(0))


def bol_variable_commission(channel: Column, product_id: Column, line_total: Column,
                            commission_percentage: Column) -> Column:
    return (F.when((channel == "BOL") & (product_id > 0),
                   F.round(line_total * commission_percentage, 2))
            .otherwise(F.lit(0)))


def manomano_commission(channel: Column, product_id: Column, brand: Column, ex_vat: Column) -> Column:
    rate = (F.when(brand.isin(*P.MANOMANO_LOW_RATE_BRANDS), F.round(ex_vat * dec(P.MANOMANO_LOW_RATE), 2))
            .otherwise(F.round(ex_vat * dec(P.MANOMANO_RATE), 2)))
    return F.when((channel == "ManoMano") & (product_id > 0), rate).otherwise(F.lit(0))


def amazon_commission(channel: Column, product_id: Column, ex_vat: Column) -> Column:
    return (F.when((channel == "Amazon") & (product_id > 0), F.round(ex_vat * dec(P.AMAZON_RATE), 2))
            .otherwise(F.lit(0)))


def marketplace_cost(channel: Column, bol_fixed: Column, bol_variable: Column,
                     manomano: Column, amazon: Column) -> Column:
    """Cost of the line's marketplace; NULL for non-marketplace channels."""
    return (F.when(channel == "BOL", F.round(bol_fixed + bol_variable, 2))
            .when(channel == "ManoMano", manomano)
            .when(channel == "Amazon", amazon))


def shipping_cost(method: Column, website_id: Column, parcels: Column, order_lines: Column) -> Column:
    """Shipping cost of one (order, website, method) group."""
    vat = dec(P.PALLET_VAT)

    def pallet_site(site):
        per_parcel = F.round(parcels * dec(P.PALLET_PER_PARCEL[site]) * vat, 2)
        flat = F.round(dec(P.PALLET_FLAT[site]) * vat, 2)
        return F.when((parcels > 0) & (parcels == order_lines), per_parcel).otherwise(flat)

    pallet = (F.when(website_id == 7, pallet_site(7))
              .when(website_id == 6, pallet_site(6)))
    for site, cost in P.PALLET_FIXED.items():
        pallet = pallet.when(website_id == site, dec(cost))
    parcel = None
    for site, cost in P.PARCEL_COST.items():
        parcel = (F.when(website_id == site, dec(cost)) if parcel is None
                  else parcel.when(website_id == site, dec(cost)))
    parcel = parcel.otherwise(dec(P.PARCEL_COST_OTHER))
    return (F.when(method.isin(*P.PALLET_METHODS), pallet)
            .when(method.isin(*P.FLATRATE_METHODS), dec("0.00"))
            .otherwise(parcel))


def order_line_class(product_id: Column, order_lines: Column, qty: Column) -> Column:
    positive = product_id > 0
    return (F.when(positive & (order_lines > 1), "Multi-line")
            .when(positive & (order_lines == 1) & (qty > 1), "Single-line plus")
            .when(positive & (order_lines == 1) & (qty == 1), "Single-line")
            .otherwise("NA"))


def payment_cost_revenue(channel: Column, ex_vat: Column) -> Column:
    return (F.when(channel.isin(*P.MARKETPLACE_CHANNELS), F.lit(0))
            .otherwise(F.when(ex_vat < 0, F.lit(0)).otherwise(ex_vat)))


def cost_fraction(product_id: Column, ex_vat: Column, order_revenue: Column) -> Column:
    """Share of the order's positive revenue; DOUBLE. Zero revenue gives NULL (those
    orders are dropped by the job)."""
    ratio = F.when(order_revenue != 0, ex_vat.cast("double") / order_revenue.cast("double"))
    return (F.when(product_id < 0, F.lit(0.0))
            .otherwise(F.when(ex_vat < 0, F.lit(0.0)).otherwise(ratio)))


# ------------------------------------------------------------- replenishment


def rounded_mean_floor(mean: Column) -> Column:
    """CASE WHEN mean <= 0 THEN 0 ELSE ROUND(mean, 2) END, NULL kept."""
    return F.when(mean <= 0, F.lit(0.0)).otherwise(round_half_away(mean, 2))


def sales_rate(year_class: Column, label: Column, mean7: Column, mean42: Column,
               rate_rule: str = "max_7_42") -> Column:
    """Daily sales rate used for the order quantity (class dependent).

    ``rate_rule`` "max_7_42" (default) takes the larger of the 7- and 42-day means for
    A+, A and B; "42_only" takes the 42-day mean for them too.
    """
    top = round_half_away(greatest_strict(mean7, mean42), 2)
    m42 = round_half_away(mean42, 2)
    positive_42 = F.when(m42 > 0, m42).otherwise(F.lit(0.0))
    positive_top = positive_42 if rate_rule == "42_only" else F.when(top > 0, top).otherwise(F.lit(0.0))
    return (F.when(year_class.isin(*P.MAX_RATE_CLASSES), positive_top)
            .when(year_class == "C", positive_42)
            .when((year_class == "D") & (label == P.NEW_LABEL), positive_42)
            .otherwise(F.lit(0.0)))


def order_days(status: Column, supplier: Column, year_class: Column, label: Column,
               p: P.ReplenishmentParams) -> Column:
    """Days of sales to order; 0 for hidden products, NULL for a NULL status."""
    new_d = (year_class == "D") & (label == P.NEW_LABEL)
    fast = (F.when(year_class.isin(*P.REORDER_CLASSES), F.lit(p.fast_supplier_order_days))
            .when(new_d, F.lit(p.fast_supplier_order_days))
            .otherwise(F.lit(0)))
    regular = None
    for klass, days in p.class_order_days:
        regular = (F.when(year_class == klass, F.lit(days)) if regular is None
                   else regular.when(year_class == klass, F.lit(days)))
    regular = regular.when(new_d, F.lit(p.new_d_order_days)).otherwise(F.lit(0))
    visible = F.when(supplier.isin(*P.FAST_SUPPLIERS), fast).otherwise(regular)
    return (F.when(status != P.HIDDEN_STATUS, visible)
            .when(status == P.HIDDEN_STATUS, F.lit(0)))


def corrected_lead_time(raw_factor: Column, supplier: Column, p: P.ReplenishmentParams) -> Column:
    """Lead days times the reorder factor; the raw (not defaulted) factor decides."""
    scaled = (F.when(supplier.isin(*p.fast_lead_suppliers), p.fast_supplier_lead_days * raw_factor)
              .otherwise(p.lead_days * raw_factor))
    return F.when(raw_factor.isNotNull(), scaled).otherwise(F.lit(float(p.no_factor_lead_days)))


def reorder_point(year_class: Column, lead_time: Column, avg42: Column) -> Column:
    return (F.when(year_class.isin(*P.REORDER_CLASSES), round_half_away(lead_time * avg42, 0))
            .otherwise(F.lit(0.0)))


def primary_qty(stock: Column, reorder_pt: Column, clearance: Column, auto_disable: Column,
                days: Column, rate: Column) -> Column:
    return (F.when((stock <= reorder_pt) & (clearance == "NO") & (auto_disable == "NO"),
                   round_half_away(days * rate, 0))
            .otherwise(F.lit(0.0)))


def order_qty_open_only(stock: Column, open_qty: Column, target: Column) -> Column:
    """Replenishment order quantity: open purchase quantity is subtracted from the
    target, positive stock is not; negative stock is added to the target."""
    return (F.when((stock >= 0) & (open_qty < target), target - open_qty)
            .when((stock < 0) & (open_qty < target + F.abs(stock)), target + F.abs(stock) - open_qty)
            .otherwise(F.lit(0)))


def order_qty_with_stock(stock: Column, open_qty: Column, target: Column) -> Column:
    """Expected-sales order quantity: positive stock and open quantity are both
    subtracted from the target; negative stock is added to it."""
    return (F.when((stock >= 0) & ((stock + open_qty) < target), target - (open_qty + stock))
            .when((stock < 0) & (open_qty < target + F.abs(stock)), target + F.abs(stock) - open_qty)
            .otherwise(F.lit(0)))


# --------------------------------------------------------------- stock health


def coverage_buckets(value: Column, avg42: Column, avg365: Column, days: Column,
                     bounds: tuple = (30, 90, 180, 365)) -> dict[str, Column]:
    """Stock value spread over days-of-cover buckets (DOUBLE columns).

    The upper test of each bucket is ``days < bound + 1`` while the next bucket starts
    at ``days > bound``, as in the source report: a days value strictly between
    ``bound`` and ``bound + 1`` is counted in both.
    """
    b1, b2, b3, b4 = bounds
    moving = (value > 0) & (avg42 > 0)
    v = value.cast("double")
    zero = F.lit(0.0)

    def share(width):
        return (F.lit(width) * value).cast("double") / days

    def bucket(lower, upper):
        inside = moving & (days > lower) & (days < upper + 1)
        above = moving & (days > upper)
        return (F.when(value == 0, zero)
                .when(inside, ((days - lower) * v) / days)
                .when(above, share(upper - lower))
                .otherwise(zero))

    return {
        "SUM_OF_NON_MOVING_42_DAYS": (F.when(value == 0, zero)
                                      .when((value > 0) & (avg42 == 0) & (avg365 > 0), v)
                                      .otherwise(zero)),
        "SUM_OF_0_30_DGN": (F.when(value == 0, zero)
                            .when(moving & (days < b1 + 1), v)
                            .when(moving & (days > b1), share(b1))
                            .otherwise(zero)),
        "SUM_OF_31_90_DGN": bucket(b1, b2),
        "SUM_OF_91_180_DGN": bucket(b2, b3),
        "SUM_OF_180_365_DGN": bucket(b3, b4),
        "MORE_THAN_365_DGN": (F.when(value == 0, zero)
                              .when(moving & (days > b4), ((days - b4) * v) / days)
                              .otherwise(zero)),
        "SUM_OF_NON_MOVING_365_DAYS": (F.when((value > 0) & (avg42 == 0) & (avg365 == 0), v)
                                       .otherwise(zero)),
    }


BUCKET_COLUMNS = ("SUM_OF_NON_MOVING_42_DAYS", "SUM_OF_0_30_DGN", "SUM_OF_31_90_DGN",
                  "SUM_OF_91_180_DGN", "SUM_OF_180_365_DGN", "MORE_THAN_365_DGN",
                  "SUM_OF_NON_MOVING_365_DAYS")
