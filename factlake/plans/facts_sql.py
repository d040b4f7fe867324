"""The table of facts as SQL, the beginning of the facts queries' oracles."""

FACTS_SQL = """
WITH lines AS (
  SELECT s_nationkey AS k, year(o_orderdate) AS y, quarter(o_orderdate) AS q, round(l_extendedprice * 100)::BIGINT AS ep,
    round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS t, round(l_quantity * 100)::BIGINT AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
), quarters AS (
  SELECT k, y, q, sum(ep * 10000) AS g, sum(ep * d * 100) AS d, sum(ep * (100 - d) * t) AS t, sum(n * 10000) AS n FROM lines GROUP BY ALL
), flows AS (
  SELECT k, y, q || 'Q' AS scope, 'Q' AS variant, g, d, t, n FROM quarters
  UNION ALL SELECT k, y, CASE q WHEN 1 THEN '1Q' WHEN 2 THEN 'HY' ELSE '3Q' END, 'A', g, d, t, n FROM (
    SELECT k, y, q, sum(g) OVER w AS g, sum(d) OVER w AS d, sum(t) OVER w AS t, sum(n) OVER w AS n FROM quarters WINDOW w AS (PARTITION BY k, y ORDER BY q)) WHERE q < 4
  UNION ALL SELECT k, y, 'FY', NULL, sum(g), sum(d), sum(t), sum(n) FROM quarters GROUP BY k, y HAVING count(*) = 4
), own AS (
  SELECT c_nationkey AS k, sum(greatest(b, 0)) AS a, sum(greatest(-b, 0)) AS l, coalesce(sum(greatest(b, 0)) FILTER (h), 0) AS ca, coalesce(sum(greatest(-b, 0)) FILTER (h), 0) AS cl
  FROM (SELECT c_nationkey, round(c_acctbal * 100)::BIGINT * 10000 AS b, c_custkey % 2 = 0 AS h FROM customer) GROUP BY 1
), current AS (
  SELECT k, y, scope, variant, 'during' AS type, unnest(['revenue', 'cost', 'operating_profit', 'net_profit', 'quantity']) AS account,
    unnest([g - d, d, g - 2 * d, g - 2 * d - t, n]) AS v FROM flows
  UNION ALL SELECT k, y, 'FY', NULL, 'end', unnest(['assets', 'liabilities', 'equity', 'current_assets', 'current_liabilities']), unnest([a, l, a - l, ca, cl])
  FROM (SELECT DISTINCT k, y FROM quarters) JOIN own USING (k)
), reported AS (
  SELECT *, 'C' AS cp, y AS filed FROM current
  UNION ALL SELECT c.*, 'P', y + 1 FROM current c WHERE (k + y + 1) % 7 <> 0 AND EXISTS (SELECT 1 FROM quarters z WHERE z.k = c.k AND z.y = c.y + 1)
), cells AS (
  SELECT r.*, n_name, r_name, ((abs(v) + 5000 * s) // (10000 * s))::BIGINT AS c,
    cp || 'FY' || y || CASE type WHEN 'end' THEN 'e' ELSE 'd' END || scope || coalesce(variant, '') AS tag
  FROM (SELECT *, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END::BIGINT AS s FROM reported) r
  JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey
), facts AS (
  SELECT n_name || '|' || filed || '|' || account || '|' || tag AS fact_id, n_name AS corp_name, r_name AS sector, k::INTEGER AS k, filed::INTEGER AS fiscal_year,
    CASE WHEN type = 'end' THEN 'BS' ELSE 'IS' END AS statement, '연결' AS report_type,
    CASE account WHEN 'revenue' THEN 'Net sales' WHEN 'cost' THEN 'Cost of sales' WHEN 'operating_profit' THEN 'Operating profit' WHEN 'net_profit' THEN 'Net profit'
      WHEN 'quantity' THEN 'Quantity sold' WHEN 'assets' THEN 'Total assets' WHEN 'liabilities' THEN 'Total liabilities' WHEN 'equity' THEN 'Total equity'
      WHEN 'current_assets' THEN 'Current assets' ELSE 'Current liabilities' END || CASE WHEN k % 2 = 1 THEN ' (주' || k || ')' ELSE '' END AS account_kr,
    account AS account_norm, tag AS period_tag, cp AS period_cp, y::INTEGER AS period_year, type AS period_type, scope AS period_scope, variant AS period_variant,
    CASE WHEN (k + y) % 11 <> 0 THEN (CASE WHEN v < 0 THEN -c ELSE c END) / 100.0::DOUBLE END AS value,
    CASE WHEN (k + y) % 11 = 0 THEN '-' ELSE CASE WHEN v < 0 THEN '(' ELSE '' END || format('{:,}', c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0')
      || CASE WHEN v < 0 THEN ')' ELSE '' END END AS value_raw,
    CASE k % 3 WHEN 0 THEN '원' WHEN 1 THEN '천원' ELSE '백만원' END AS unit_hint
  FROM cells
)
"""
