"""Business constants of every job, with the reports' values as defaults.

Each job takes one of these frozen dataclasses, so a run for another year, another
category or another run date is a parameter change and not a code change.
``as_of`` is the run date ("current date" of the source reports); it has no default
so that every result is reproducible.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values. These must equal the source reports for the results to match.
# ---------------------------------------------------------------------------

# Order-line channels and websites kept by the margin base.
MARGIN_CHANNELS = ("GCNL", "FXBE", "FXES", "FXFR", "FXDE", "BOL", "ManoMano", "Showroom", "Amazon", "VWW")
MARGIN_WEBSITES = (3, 4, 6, 7, 8, 14, 15)
MARGIN_EXCLUDED_PRODUCTS = (-11, -12)

# Country label per website id; other ids get NULL.
COUNTRY_BY_WEBSITE = {3: "ES", 4: "DE", 6: "BE", 7: "NL", 8: "FR", 14: "GCNL VWW", 15: "FXBE VWW"}

# Marketplace commissions.
BOL_FIXED_TIERS = ((10, "0.20"), (20, "0.40"))   # unit price <= bound -> fee per unit
BOL_FIXED_TOP = "0.85"                            # unit price > 20
MANOMANO_LOW_RATE_BRANDS = ("DeWALT", "Makita", "Metabo", "Bosch", "HiKOKI", "Hitachi")
MANOMANO_LOW_RATE = "0.12"
MANOMANO_RATE = "0.13"
AMAZON_RATE = "0.1348"
MARKETPLACE_CHANNELS = ("BOL", "ManoMano", "Amazon")

# Shipping cost per (order, website, shipping method).
PALLET_METHODS = ("pallet", "pallet_manual")
FLATRATE_METHODS = ("flatrate_flatrate",)
PALLET_VAT = "1.23"
PALLET_PER_PARCEL = {7: "17.50", 6: "22.50"}      # all lines are separate parcels
PALLET_FLAT = {7: "33.90", 6: "50.70"}            # otherwise one pallet
PALLET_FIXED = {8: "135.00", 3: "135.00", 4: "135.00"}
PARCEL_COST = {7: "5.20", 6: "5.95", 8: "10.55", 3: "11.00", 4: "5.65"}
PARCEL_COST_OTHER = "7.00"

# Sales classes and replenishment rules.
REORDER_CLASSES = ("A+", "A", "B", "C")
MAX_RATE_CLASSES = ("A+", "A", "B")
NEW_LABEL = "new"
HIDDEN_STATUS = "hidden"
FAST_SUPPLIERS = ("Makita Nederland", "Transferro B.V.", "Transferro B.V. - Bosch")
LOW_CASH_SUPPLIERS = ("Makita Nederland", "Transferro B.V.")
EOL_SUPPLIER = "EOL / Discontinued"

# Purchase-order status numbers.
PO_BACKORDER, PO_ORDERED, PO_CONFIRMED, PO_RECEIVED = 2, 3, 4, 5

# Classification slices: (period, type).
YEAR_SALES = ("year", "sales")
YEAR_IN_STOCK = ("year", "sales_in_stock")
D42_SALES = ("42_days", "sales")
D42_IN_STOCK = ("42_days", "sales_in_stock")
WEEK_SALES = ("week", "sales")
WEEK_IN_STOCK = ("week", "sales_in_stock")


@dataclass(frozen=True)
class MarginParams:
    """Contribution-margin base."""
    from_year: int = 2022
    order_type: str = "sales_order"
    min_status: int = 1
    channels: tuple = MARGIN_CHANNELS
    websites: tuple = MARGIN_WEBSITES
    excluded_products: tuple = MARGIN_EXCLUDED_PRODUCTS


@dataclass(frozen=True)
class ReplenishmentParams:
    """Replenishment list."""
    as_of: dt.date
    factor_days: int = 28            # history window and divisor of the low-stock share
    low_stock_days_of_sales: int = 5 # a day is low when stock <= round(mean42 * 5)
    order_count_days: int = 90
    fast_supplier_order_days: int = 10
    class_order_days: tuple = (("A+", 14), ("A", 14), ("B", 7), ("C", 7))
    new_d_order_days: int = 7
    fast_lead_suppliers: tuple = FAST_SUPPLIERS  # low cash: LOW_CASH_SUPPLIERS
    fast_supplier_lead_days: int = 10  # low cash: 5
    lead_days: int = 14                # regular: 28
    no_factor_lead_days: int = 14      # lead time when a product has no reorder factor
    check_max_orders: int = 3          # purchase CHECK flag: fewer orders than this
    # Alternatives the report keeps commented out:
    rate_rule: str = "max_7_42"        # "42_only": A+/A/B use the 42-day mean alone
    exclude_black_friday: bool = False # class arm skips products in bf_assortment_sales


@dataclass(frozen=True)
class StockHealthParams:
    """Current stock health and its trend."""
    bucket_bounds: tuple = (30, 90, 180, 365)


@dataclass(frozen=True)
class SeasonParams:
    """Seasonal expected sales for a category pattern."""
    year: int
    months: tuple
    category_patterns: tuple
    days_in_season: int
    # Alternative the report keeps commented out: drop end-of-life suppliers and
    # rows with nothing to order.
    only_orderable: bool = False


# Seasonal expected sales, one category (leaf blowers), 2021 September-December / 121 days.
LEAF_BLOWER_SEASON = SeasonParams(year=2021, months=(9, 10, 11, 12),
                                  category_patterns=("%Bladblazer%",), days_in_season=121)
# Seasonal expected sales, lamp categories, same season / 122 days.
LAMP_SEASON = SeasonParams(year=2021, months=(9, 10, 11, 12),
                           category_patterns=("%lamp%", "%Lamp"), days_in_season=122)


@dataclass(frozen=True)
class HorizonParams:
    """Expected sales over a horizon for one manufacturer."""
    manufacturer: str = "Festool"
    horizon_days: int = 160
    excluded_supplier: str = EOL_SUPPLIER


@dataclass(frozen=True)
class ShippedChildParams:
    """Shipped quantities with bundles exploded to child products."""
    year: int = 2022
    status: int = 5
    websites: tuple = (7, 8)
    order_type: str = "sales_order"
    composition_line_type: str = "COMPOSITION"
    home_website: int = 7
    home_country: str = "NL"
    other_country: str = "FR"


@dataclass(frozen=True)
class PurchaseValueParams:
    """Purchase value per supplier and category."""
    year: int = 2022
    status: int = 5
    website: int = 7


@dataclass(frozen=True)
class OutOfStockParams:
    """Out-of-stock base."""
    as_of: dt.date
    history_days: int = 90
    min_mean_42: float = 0.05


@dataclass(frozen=True)
class ShippingTimeParams:
    """Order lines for shipping time and revenue."""
    as_of: dt.date
    order_types: tuple = ("sales_order", "follow_up_shipment")
    min_status: int = 2
    years_back: int = 1
    weekend_days: tuple = ("Saturday", "Sunday")
    shipped_within_days: int = 2


@dataclass(frozen=True)
class Profile:
    """All parameters of one run."""
    as_of: dt.date
    margin: MarginParams = field(default_factory=MarginParams)
    stock_health: StockHealthParams = field(default_factory=StockHealthParams)
    leaf_blower: SeasonParams = LEAF_BLOWER_SEASON
    lamps: SeasonParams = LAMP_SEASON
    horizon: HorizonParams = field(default_factory=HorizonParams)
    shipped_child: ShippedChildParams = field(default_factory=ShippedChildParams)
    purchase_value: PurchaseValueParams = field(default_factory=PurchaseValueParams)
    replenishment_options: dict = field(default_factory=dict)  # ReplenishmentParams overrides

    @property
    def replenishment(self) -> ReplenishmentParams:
        return ReplenishmentParams(as_of=self.as_of, **self.replenishment_options)

    @property
    def out_of_stock(self) -> OutOfStockParams:
        return OutOfStockParams(as_of=self.as_of)

    @property
    def shipping_time(self) -> ShippingTimeParams:
        return ShippingTimeParams(as_of=self.as_of)


def report_profile(as_of: dt.date) -> Profile:
    """The source reports' constants with a given run date."""
    return Profile(as_of=as_of)


# The driver's test tables cover 1995-01-01 .. 2001-08-01, so the years move with them.
TESTDATA_AS_OF = dt.date(2001, 8, 1)
TESTDATA_PROFILE = Profile(
    as_of=TESTDATA_AS_OF,
    margin=MarginParams(from_year=1999),
    leaf_blower=replace(LEAF_BLOWER_SEASON, year=2000),
    lamps=replace(LAMP_SEASON, year=2000),
    shipped_child=ShippedChildParams(year=2000),
    purchase_value=PurchaseValueParams(year=2000),
)
