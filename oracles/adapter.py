"""The test-data adapter as DuckDB SQL: the logical tables as CTEs over the
driver's views (lineitem, orders, part, supplier).

It mirrors ``shelfwise.sources.testdata`` expression by expression; it is the
oracles' input, written independently of the Spark code.
"""

from __future__ import annotations

import datetime as dt


def _d(day: dt.date) -> str:
    return f"DATE '{day.isoformat()}'"


def _ts(day: dt.date) -> str:
    return f"TIMESTAMP '{day.isoformat()} 00:00:00'"


MAKER = ("COALESCE(CASE CAST(substr(p_brand, 7, 10) AS INTEGER) % 5 WHEN 0 THEN 'Festool' "
         "WHEN 1 THEN 'Makita' WHEN 2 THEN 'DeWALT' WHEN 3 THEN 'Bosch' END, p_brand)")
CATEGORY = ("CASE p_type WHEN 'PROMO' THEN 'Bladblazers accu' WHEN 'SMALL' THEN 'Bureaulamp' "
            "WHEN 'LARGE' THEN 'LED Lamp' ELSE p_type END")
MAIN_CATEGORY = ("CAST((CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3 "
                 "WHEN 'PROMO' THEN 4 WHEN 'STANDARD' THEN 5 WHEN 'LARGE' THEN 6 ELSE 7 END) * 10 "
                 "+ p_size % 4 + 1 AS BIGINT)")


def money(expr: str, factor: str) -> str:
    return f"CAST(({expr}) * CAST('{factor}' AS DECIMAL(3,2)) AS DECIMAL(18,4))"


def adapter_ctes(as_of: dt.date) -> dict[str, str]:
    """CTE bodies by logical table name, in dependency order."""
    d7, d42, d365 = (as_of - dt.timedelta(days=n) for n in (7, 42, 365))
    hist_start = as_of - dt.timedelta(days=100)
    price = "CAST(p_retailprice AS DECIMAL(12,2))"
    ctes = {
        "ol_raw": f"""
            SELECT l.*, o.*, p.*,
                   CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                        * CAST('0.005' AS DECIMAL(3,3)) AS DECIMAL(18,4)) AS ex_vat,
                   CAST(l_quantity AS BIGINT) AS q
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                            JOIN part p ON l.l_partkey = p.p_partkey""",
        "order_lines": f"""
            SELECT l_orderkey + 1 AS order_id,
                   o_orderdate AS order_date,
                   CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN -4
                        WHEN (l_orderkey + l_linenumber) % 101 = 0 THEN -11
                        ELSE l_partkey + 1 END AS product_id,
                   p_name AS description,
                   {MAKER} AS brand,
                   {CATEGORY} AS category,
                   'ROOT_' || CAST(p_size % 4 AS VARCHAR) AS root_category,
                   {money('ex_vat', '1.21')} AS line_total,
                   ex_vat AS line_total_ex_vat,
                   {money('ex_vat', '0.25')} AS margin_total_net,
                   {money('ex_vat', '0.70')} AS purchase_net,
                   CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN -q ELSE q END AS qty,
                   CAST(CASE o_custkey % 8 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 7
                        WHEN 4 THEN 8 WHEN 5 THEN 14 WHEN 6 THEN 15 ELSE 99 END AS INTEGER) AS website_id,
                   CASE o_orderkey % 11 WHEN 0 THEN 'GCNL' WHEN 1 THEN 'FXBE' WHEN 2 THEN 'FXES'
                        WHEN 3 THEN 'FXFR' WHEN 4 THEN 'FXDE' WHEN 5 THEN 'BOL' WHEN 6 THEN 'ManoMano'
                        WHEN 7 THEN 'Showroom' WHEN 8 THEN 'Amazon' WHEN 9 THEN 'VWW' ELSE 'Other' END AS channel,
                   CASE (o_orderkey + CASE WHEN o_orderkey % 4 = 0 AND l_linenumber >= 5 THEN 1 ELSE 0 END) % 5
                        WHEN 0 THEN 'pallet' WHEN 1 THEN 'pallet_manual'
                        WHEN 2 THEN 'flatrate_flatrate' WHEN 3 THEN 'standard' END AS shipping_method,
                   CAST(CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 2 ELSE 0 END AS INTEGER) AS status,
                   CASE o_orderkey % 13 WHEN 0 THEN 'follow_up_shipment' WHEN 1 THEN 'rma'
                        ELSE 'sales_order' END AS order_type,
                   CASE WHEN l_partkey % 10 = 0 THEN 'COMPOSITION' ELSE 'SIMPLE' END AS line_type,
                   CAST(year(o_orderdate) AS INTEGER) AS year_number,
                   dayname(o_orderdate) AS day_name,
                   CAST(l_linenumber - 1 AS INTEGER) AS shipped_in
            FROM ol_raw""",
        "products": f"""
            SELECT p_partkey + 1 AS product_id, p_name AS name_nl,
                   '871' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS ean,
                   CASE WHEN p_partkey % 17 = 0 THEN 'hidden' WHEN p_partkey % 19 = 0 THEN NULL
                        ELSE 'visible' END AS status,
                   {money(price, '0.60')} AS cost,
                   {money(price, '0.55')} AS cost_net,
                   CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE CAST(p_size - 10 AS BIGINT) END AS stock_magento,
                   CAST(p_size AS BIGINT) AS stock_hbs,
                   CAST(substr(p_brand, 7, 10) AS BIGINT) AS manufacturer_id,
                   CASE WHEN p_partkey % 29 = 0 THEN NULL
                        WHEN p_partkey % 31 = 0 THEN first_supplier + 10000000
                        ELSE first_supplier END AS default_supplier_id,
                   {MAIN_CATEGORY} AS main_category_id
            FROM part LEFT JOIN (
                SELECT l_partkey, CAST(min(l_orderkey * 10000000 + l_suppkey) % 10000000 AS BIGINT) AS first_supplier
                FROM lineitem GROUP BY l_partkey) lines ON p_partkey = l_partkey""",
        "manufacturers": f"""
            SELECT DISTINCT CAST(substr(p_brand, 7, 10) AS BIGINT) AS manufacturer_id, {MAKER} AS name
            FROM part""",
        "categories": f"""
            SELECT DISTINCT {MAIN_CATEGORY} AS category_id, CAST(p_size % 4 + 100 AS BIGINT) AS root_category_id,
                   {CATEGORY} AS name_nl FROM part
            UNION ALL
            SELECT DISTINCT CAST(p_size % 4 + 100 AS BIGINT), CAST(NULL AS BIGINT),
                   'ROOT_' || CAST(p_size % 4 AS VARCHAR) FROM part""",
        "suppliers": """
            SELECT s_suppkey AS supplier_id,
                   COALESCE(CASE s_suppkey % 20 WHEN 1 THEN 'Makita Nederland' WHEN 2 THEN 'Transferro B.V.'
                            WHEN 3 THEN 'Transferro B.V. - Bosch' WHEN 4 THEN 'EOL / Discontinued' END,
                            s_name) AS name,
                   CASE WHEN s_suppkey % 3 = 0 THEN 'OEM' WHEN s_suppkey % 3 = 1 THEN 'trader' END AS type
            FROM supplier""",
        "set_items": """
            SELECT p_partkey + 1 AS parent_product_id, p_partkey + 1 + k AS child_product_id,
                   CAST(1 + (p_size + k - 1) % 3 AS BIGINT) AS quantity
            FROM part, (VALUES (1), (2)) AS bridge(k)
            WHERE p_partkey % 10 = 0""",
        "product_labels": """
            SELECT p_partkey + 1 AS product_id, 'new' AS label FROM part WHERE (p_partkey + 1) % 23 = 0
            UNION ALL
            SELECT p_partkey + 1, 'promo' FROM part WHERE (p_partkey + 1) % 69 = 0""",
        "channel_commission": """
            SELECT p_partkey + 1 AS product_id,
                   CAST(CAST((p_partkey + 1) % 7 + 5 AS DOUBLE) / 100 AS DECIMAL(9,4)) AS commission_percentage
            FROM part WHERE (p_partkey + 1) % 3 != 0""",
        "clearance_products": "SELECT p_partkey + 1 AS product_id FROM part WHERE (p_partkey + 1) % 29 = 0",
        "clearance_products_hist": "SELECT p_partkey + 1 AS product_id FROM part WHERE (p_partkey + 1) % 31 = 0",
        "auto_disable_products": "SELECT p_partkey + 1 AS product_id FROM part WHERE (p_partkey + 1) % 37 = 0",
        "bf_assortment_sales": "SELECT p_partkey + 1 AS product_id FROM part WHERE (p_partkey + 1) % 47 = 0",
        "separate_parcel_products": "SELECT p_partkey + 1 AS product_id FROM part WHERE (p_partkey + 1) % 5 = 0",
        "min_order_qty": """
            SELECT p_partkey + 1 AS product_id, CAST(2.5 AS DOUBLE) AS minimum_qty
            FROM part WHERE (p_partkey + 1) % 41 = 0""",
        "min_desired_qty": """
            SELECT p_partkey + 1 AS product_id, CAST(4 AS BIGINT) AS minimum_desired_qty
            FROM part WHERE (p_partkey + 1) % 43 = 0""",
        "pending_po": """
            SELECT l_partkey + 1 AS product_id,
                   CASE WHEN l_returnflag = 'R' AND 2 + l_linenumber % 4 = 5 THEN -(CAST(l_quantity AS BIGINT) % 4)
                        ELSE CAST(l_quantity AS BIGINT) % 4 END AS qty,
                   CAST(2 + l_linenumber % 4 AS INTEGER) AS status_id,
                   CASE WHEN l_orderkey % 9 = 0 THEN l_shipdate END AS deleted_at
            FROM lineitem
            WHERE l_linestatus = 'O'""",
        "product_history": f"""
            SELECT p_partkey + 1 AS product_id,
                   CAST({_d(hist_start)} + CAST(d AS INTEGER) AS DATE) AS date,
                   {money(price, '0.55')} AS cost_net,
                   CASE WHEN p_partkey % 53 = 0 THEN NULL
                        ELSE CAST(p_size - 10 + (p_partkey + d) % 15 - 7 AS BIGINT) END AS stock_magento
            FROM part, range(0, 101) AS days(d)""",
        "class_sums": f"""
            SELECT product_id,
                   SUM(CASE WHEN CAST(order_date AS DATE) > {_d(d7)} THEN qty END) AS s_week,
                   COUNT(CASE WHEN CAST(order_date AS DATE) > {_d(d7)} THEN 1 END) AS n_week,
                   SUM(CASE WHEN CAST(order_date AS DATE) > {_d(d42)} THEN qty END) AS s_42,
                   COUNT(CASE WHEN CAST(order_date AS DATE) > {_d(d42)} THEN 1 END) AS n_42,
                   SUM(qty) AS s_year, COUNT(*) AS n_year
            FROM order_lines
            WHERE CAST(order_date AS DATE) > {_d(d365)} AND CAST(order_date AS DATE) <= {_d(as_of)}
              AND product_id > 0
            GROUP BY product_id""",
        "class_rows": """
            SELECT product_id, 'week' AS period, 7 AS days, s_week AS s FROM class_sums WHERE n_week > 0
            UNION ALL
            SELECT product_id, '42_days', 42, s_42 FROM class_sums WHERE n_42 > 0
            UNION ALL
            SELECT product_id, 'year', 365, s_year FROM class_sums WHERE n_year > 0""",
        "classifications": """
            SELECT product_id, period, type,
                   CASE WHEN s >= 200 THEN 'A+' WHEN s >= 150 THEN 'A' WHEN s >= 100 THEN 'B'
                        WHEN s >= 50 THEN 'C' ELSE 'D' END AS label,
                   CASE WHEN type = 'sales' THEN CAST(s AS DOUBLE) / days
                        WHEN product_id % 7 = 0 THEN CAST(0 AS DOUBLE)
                        ELSE CAST(s AS DOUBLE) / days * 1.25 END AS mean,
                   CAST(s AS BIGINT) AS absolute
            FROM class_rows, (VALUES ('sales'), ('sales_in_stock')) AS kinds(type)""",
        "stock_health_snapshots": """
            SELECT h.product_id AS PRODUCT_ID, h.date AS snapshot_date, h.stock_magento AS STOCK_MAGENTO,
                   CAST(ROUND(h.cost_net * h.stock_magento, 2) AS DECIMAL(18,2)) AS STOCK_VALUE,
                   CAST(CASE WHEN m42.mean <= 0 THEN 0 ELSE m42.mean END AS DOUBLE) AS AVG_SALES_IN_STOCK_42_DAYS,
                   CAST(CASE WHEN m365.mean <= 0 THEN 0 ELSE m365.mean END AS DOUBLE) AS AVG_SALES_IN_STOCK_365_DAYS,
                   CAST(CASE WHEN m42.mean <= 0 THEN 0 ELSE h.stock_magento / m42.mean END AS DOUBLE)
                       AS ESTIMATED_STOCK_DAYS
            FROM product_history h
            LEFT JOIN classifications m42 ON m42.product_id = h.product_id AND m42.period = '42_days'
                                         AND m42.type = 'sales_in_stock'
            LEFT JOIN classifications m365 ON m365.product_id = h.product_id AND m365.period = 'year'
                                          AND m365.type = 'sales_in_stock'
            WHERE h.stock_magento > 0 AND h.product_id NOT IN (SELECT parent_product_id FROM set_items)""",
    }
    return ctes
