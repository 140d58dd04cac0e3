"""SQL forms of the derived tables, for the twins."""

from tidemark.catalog.core import cte

cte("bars_w", """
SELECT 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS symbol,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
       round(arg_min(l_extendedprice / l_quantity + 1e-9, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)), 6) AS open,
       round(max(l_extendedprice / l_quantity + 1e-9), 6) AS high,
       round(min(l_extendedprice / l_quantity + 1e-9), 6) AS low,
       round(arg_max(l_extendedprice / l_quantity + 1e-9, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)), 6) AS close,
       CAST(sum(l_quantity) * 100 AS BIGINT) AS volume,
       round(arg_max(l_extendedprice / l_quantity + 1e-9, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)), 6) AS adj_close
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
""")
cte("bars_d", """
SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice), 6) AS close,
       CAST(sum(l_quantity) AS BIGINT) AS volume
FROM lineitem GROUP BY 1, 2
""")
cte("bars_h", """
SELECT event_type AS symbol, date_trunc('hour', ts) AS date, arg_min(value, row(ts, event_id)) AS open,
       max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close,
       CAST(count(*) * 1000 AS BIGINT) AS volume
FROM events GROUP BY 1, 2
""")
cte("dirty_bars", """
SELECT symbol, date, open, high, low, close, volume, adj_close FROM (
  SELECT symbol, date, open, high, low, adj_close, i,
         CASE WHEN i % 17 = 0 THEN NULL WHEN i % 23 = 0 THEN -1.0 ELSE close END AS close,
         CASE WHEN i % 19 = 0 THEN 0 ELSE volume END AS volume
  FROM (SELECT *, row_number() OVER (ORDER BY symbol, date) AS i FROM bars_w)
), (VALUES (1), (2)) AS c(n) WHERE n = 1 OR i % 50 = 0
""")
cte("fundamentals_q", """
SELECT symbol, date, revenue, net_income, net_income AS earnings, revenue * 2 AS total_assets, equity,
       round(revenue * 2 - equity, 2) AS total_debt, inventory, accounts_receivable, revenue * 10 AS market_cap
FROM (
  SELECT o.symbol, o.date, round(sum(o_totalprice), 2) AS revenue,
         round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END)
               - 0.5 * sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 3) AS net_income,
         any_value(e.equity) AS equity,
         round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS inventory,
         round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 2) AS accounts_receivable
  FROM nation_orders o JOIN (
    SELECT symbol, date, round(sum(c_acctbal), 2) AS equity
    FROM (SELECT DISTINCT symbol, date, c_custkey, c_acctbal FROM nation_orders) GROUP BY 1, 2
  ) e ON e.symbol = o.symbol AND e.date = o.date
  GROUP BY 1, 2)
""")
cte("nation_orders", """
SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS symbol,
       CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, c_custkey, c_acctbal, o_orderstatus, o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey
""")
cte("ticks", """
SELECT event_type AS symbol, ts, event_id, round(value - 0.01, 6) AS bid, round(value + 0.01, 6) AS ask, user_id AS volume
FROM events
""")
cte("sentiment_items", """
SELECT event_type AS symbol, CAST(ts AS DATE) AS date, event_id,
       CASE event_id % 3 WHEN 0 THEN 'Positive' WHEN 1 THEN 'neutral' ELSE 'NEGATIVE' END AS sentiment
FROM events
""")
cte("sentiment_d", """
SELECT event_type AS symbol, CAST(ts AS DATE) AS date,
       count(*) FILTER (event_id % 2 = 0) AS positive_mentions, count(*) FILTER (event_id % 2 = 1) AS negative_mentions,
       count(*) AS news_count,
       (count(*) FILTER (event_id % 2 = 0) - count(*) FILTER (event_id % 2 = 1))::DOUBLE / count(*)::DOUBLE AS sentiment_score,
       round(sum(CASE WHEN event_id % 2 = 1 THEN value ELSE 0 END), 4) AS put_volume,
       round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END), 4) AS call_volume,
       count(*) FILTER (event_id % 3 = 0) AS buy_ratings, count(*) FILTER (event_id % 3 = 1) AS hold_ratings,
       count(*) FILTER (event_id % 3 = 2) AS sell_ratings, round(sum(value), 4) AS volume
FROM events GROUP BY 1, 2
""")
cte("trades", """
SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part_id,
       CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' ELSE 'hold' END AS signal_type,
       l_quantity AS quantity, p AS price, round(greatest(l_quantity * p * 0.001::DOUBLE, 1.0) + 1e-10, 6) AS commission,
       round(l_quantity * p * 0.0005::DOUBLE + 2e-11, 6) AS slippage,
       round((l_discount - 0.05::DOUBLE) * l_extendedprice, 6) AS realized_pnl
FROM (SELECT *, round(l_extendedprice / l_quantity + 1e-9, 6) AS p FROM lineitem)
""")
cte("equity", """
SELECT date, round(sum(pnl) OVER (ORDER BY date) + 100000, 6) AS total_value FROM (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         round(sum((l_discount - 0.05::DOUBLE) * l_extendedprice) / 100, 6) AS pnl FROM lineitem GROUP BY 1)
""")
cte("pipeline_runs", """
SELECT event_id AS run_id, event_type AS command, status, ts AS start_time,
       CASE WHEN status <> 'running' THEN value END AS duration,
       CASE user_id % 5 WHEN 0 THEN '1day' WHEN 1 THEN '1hour' WHEN 2 THEN '15min' WHEN 3 THEN '5min' ELSE '1min' END AS timeframe,
       props AS metadata, user_id, value
FROM (SELECT *, CASE WHEN event_type IN ('purchase', 'click') THEN 'completed' WHEN event_type = 'error' THEN 'failed'
                     WHEN event_type = 'view' THEN 'running' ELSE 'stopped' END AS status FROM events)
""")
