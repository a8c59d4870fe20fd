"""SQL of the shop's datasets over the benchmark tables, for checking the operators with another engine."""

CTES = {
    "cust": ([], """SELECT c_custkey AS customer_id, c_name AS first_name, 'c' || c_custkey || '@shop.example' AS email, n_name AS city, r_name AS region,
        (first_date - (c_custkey % 400)::INTEGER) AS registration_date, coalesce(n, 0) AS total_orders, coalesce(spent, 0) AS lifetime_value,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Google' WHEN 'BUILDING' THEN 'Facebook' WHEN 'FURNITURE' THEN 'Instagram' WHEN 'HOUSEHOLD' THEN 'TikTok' WHEN 'MACHINERY' THEN 'Influencer' END AS acquisition_source
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, min(o_orderdate)::DATE AS first_date, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey"""),
    "ord": ([], """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate::DATE AS order_date, o_totalprice AS final_total,
        CASE o_orderstatus WHEN 'F' THEN 'Livré' WHEN 'O' THEN 'En cours' WHEN 'P' THEN 'Annulé' END AS order_status, o_orderpriority AS payment_method,
        CASE WHEN month(o_orderdate) IN (9, 10) THEN 'tabaski' WHEN month(o_orderdate) = 4 THEN 'ramadan' WHEN month(o_orderdate) IN (12, 1) THEN 'fin_annee' WHEN month(o_orderdate) IN (2, 7) THEN 'soldes' ELSE 'normal' END AS season,
        o_orderkey % 5 < 2 AS has_promotion, CASE WHEN o_orderkey % 10 < 7 THEN (['google', 'facebook', 'instagram', 'tiktok', 'influencer'])[(o_orderkey % 5 + 1)::INT] END AS utm_source FROM orders"""),
    "items": ([], """SELECT l_orderkey AS order_id, l_partkey AS product_id, p_name AS product_name, CASE p_type WHEN 'ECONOMY' THEN 'soin_visage' WHEN 'STANDARD' THEN 'soin_corps' WHEN 'SMALL' THEN 'soin_cheveux'
        WHEN 'MEDIUM' THEN 'maquillage' WHEN 'LARGE' THEN 'parfum' WHEN 'PROMO' THEN 'homme' END AS category, l_quantity AS quantity, l_extendedprice AS item_total FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "ev": ([], "SELECT *, (props->>'$.k')::INT AS k FROM events"),
    "logs": (["ev"], """SELECT event_id, CASE event_type WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'begin_checkout' WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'page_view' END AS event_type,
        ts AS event_timestamp, ts::DATE AS date, user_id || '-' || ts::DATE AS session_id, user_id, k % 3 = 0 AS is_authenticated, CASE WHEN k % 3 = 0 THEN 'c' || user_id || '@shop.example' END AS user_email,
        CASE WHEN k % 10 <> 9 THEN (['google', 'facebook', 'instagram', 'tiktok', 'influencer'])[k % 5 + 1] END AS utm_source, (['cpc', 'social', 'email'])[k % 3 + 1] AS utm_medium,
        CASE WHEN k % 10 <> 9 THEN (['ramadan_2025', 'tabaski_promo', 'beaute_naturelle', 'lancement_produit'])[k % 4 + 1] || '_' || (['google', 'facebook', 'instagram', 'tiktok', 'influencer'])[k % 5 + 1] END AS utm_campaign, 'C' || (k % 20) AS campaign_id, '/products/p' || (k % 20) AS page_url FROM ev"""),
    "ads": (["ev"], """SELECT ts::DATE AS ad_date, (['Google', 'Facebook', 'Instagram', 'TikTok', 'Influencer_YouTube'])[k % 20 % 5 + 1] AS platform, 'C' || (k % 20) AS campaign_id,
        (['ramadan_2025', 'tabaski_promo', 'beaute_naturelle', 'lancement_produit'])[k % 20 % 4 + 1] || '_' || (['google', 'facebook', 'instagram', 'tiktok', 'influencer'])[k % 20 % 5 + 1] AS campaign_name, 100 * count(*) AS impressions, 10 * count(*) FILTER (event_type = 'click') AS clicks,
        count(*) FILTER (event_type = 'purchase') AS conversions, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS cost, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS conversion_value FROM ev GROUP BY 1, 2, 3, 4"""),
    "pur": ([], "SELECT event_id AS order_id, user_id AS customer_id, ts AS order_date, value AS final_total FROM events WHERE event_type = 'purchase'"),
    "sess": (["logs"], """SELECT session_id, min(event_timestamp) AS session_start, max(event_timestamp) AS session_end, count(*) AS event_count, any_value(user_id) AS user_id,
        count(*) FILTER (event_type = 'page_view') AS page_view_count, count(*) FILTER (event_type = 'product_view') AS product_view_count, count(*) FILTER (event_type = 'add_to_cart') AS add_to_cart_count,
        count(*) FILTER (event_type = 'begin_checkout') AS checkout_count, count(*) FILTER (event_type = 'purchase') AS purchase_count,
        arg_min(is_authenticated, (event_timestamp, event_id)) AS is_authenticated, first(user_email ORDER BY event_timestamp, event_id) AS user_email, first(utm_source ORDER BY event_timestamp, event_id) AS utm_source, first(utm_medium ORDER BY event_timestamp, event_id) AS utm_medium,
        first(utm_campaign ORDER BY event_timestamp, event_id) AS utm_campaign, first(campaign_id ORDER BY event_timestamp, event_id) AS campaign_id, string_agg(event_type, ',' ORDER BY event_timestamp, event_id) AS event_types,
        string_agg(page_url, ',' ORDER BY event_timestamp, event_id) AS pages_viewed FROM logs GROUP BY session_id"""),
    "pairs": (["sess", "pur"], """SELECT order_id, s.user_id, order_date, final_total AS order_value, session_id, session_start, utm_source, utm_medium, utm_campaign, campaign_id, date_diff('day', session_start::DATE, order_date::DATE) AS d
        FROM pur JOIN sess s ON customer_id = s.user_id WHERE coalesce(utm_source, utm_medium, utm_campaign) IS NOT NULL AND session_start <= order_date AND date_diff('day', session_start::DATE, order_date::DATE) BETWEEN 0 AND 30"""),
    "att": (["pairs"], """SELECT order_id, user_id, order_date, order_value, n AS touchpoint_count, session_id, utm_source, utm_medium, utm_campaign, campaign_id, d AS days_before_purchase, m AS attribution_model, w AS touchpoint_weight, order_value * w AS attributed_revenue
        FROM (SELECT *, CASE m WHEN 'linear' THEN 1.0 / n WHEN 'time_decay' THEN pow(0.7, d) / t ELSE 1.0 END AS w
              FROM (SELECT *, count(*) OVER o AS n, row_number() OVER (PARTITION BY order_id ORDER BY session_start, session_id) AS a, row_number() OVER (PARTITION BY order_id ORDER BY session_start DESC, session_id DESC) AS z, sum(pow(0.7, d)) OVER o AS t
                    FROM pairs WINDOW o AS (PARTITION BY order_id)), (VALUES ('first_touch'), ('last_touch'), ('linear'), ('time_decay')) v(m)
              WHERE m IN ('linear', 'time_decay') OR m = 'first_touch' AND a = 1 OR m = 'last_touch' AND z = 1)"""),
}


def with_tables(names: str, select: str, doubles: str = "", digits: int = 4) -> str:
    """select with the named datasets (and what they need) before it; doubles are rounded."""
    need: list[str] = []

    def add(n: str) -> None:
        for x in CTES[n][0]:
            add(x)
        if n not in need:
            need.append(n)

    for n in names.split():
        add(n)
    ctes = [f"{n} AS ({CTES[n][1]})" for n in need]
    body = select.strip()
    if body.upper().startswith("WITH "):
        head, _, tail = body[5:].partition("\nMAIN ")
        ctes.append(head)
        body = tail
    if doubles:
        body = "SELECT * REPLACE (" + ", ".join(f"round({c}::DECIMAL(28, 9), {digits})::DOUBLE AS {c}" for c in doubles.split()) + f") FROM ({body})"
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def spans(as_of: str, names: str) -> str:
    """(time_period, a, b) rows of named periods."""
    back = {"daily": (0, 0), "weekly": (6, 0), "monthly": (29, 0), "quarterly": (89, 0), "prev_month": (394, 365), "yearly": (364, 0)}
    row = lambda n: f"('{n}', date_trunc('year', DATE '{as_of}')::DATE, DATE '{as_of}')" if n == "ytd" else f"('{n}', DATE '{as_of}' - {back[n][0]}, DATE '{as_of}' - {back[n][1]})"
    return "(VALUES " + ", ".join(map(row, names.split())) + ") p(time_period, a, b)"
