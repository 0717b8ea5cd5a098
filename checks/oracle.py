"""The same results in DuckDB SQL over the same tables, one statement per query."""

from __future__ import annotations

_LOCATED = """
located AS (
  SELECT l.*, s.s_acctbal, n.n_nationkey, n.n_regionkey
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""

_PLACES = """
  l_partkey AS PRODUCT_ID,
  l_suppkey AS TERRITORY_ID,
  CASE WHEN s_acctbal >= 0 THEN CAST(n_nationkey AS BIGINT) END AS AREA_ID,
  CAST(n_regionkey AS BIGINT) AS REGION_ID,
  l_orderkey * 10 + l_linenumber AS ROW_DATA_ID"""

_DIRTY = """
  CASE WHEN l_linenumber <> 5 THEN
    CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END END AS SALES_QTY,
  CASE WHEN l_linenumber <> 4 THEN l_extendedprice END AS UNIT_PRICE"""

_MONTHS = "CAST(year(l_shipdate) AS BIGINT) AS YEAR_NO, CAST(month(l_shipdate) AS BIGINT) AS MONTH_NO"

CLEAN = f"""WITH {_LOCATED}, survey AS (
  SELECT {_PLACES}, {_MONTHS}, l_quantity AS SALES_QTY, l_extendedprice AS UNIT_PRICE FROM located
)"""

DIRTY = f"WITH {_LOCATED}, survey AS (SELECT {_PLACES}, {_MONTHS}, {_DIRTY} FROM located)"

CIRCLE = f"""WITH {_LOCATED}, survey AS (
  SELECT {_PLACES}, {_MONTHS}, {_DIRTY},
    o_orderpriority AS SURVEY_CIRCLE_ID, CAST(o_custkey AS VARCHAR) AS PRS_ID
  FROM located JOIN orders ON l_orderkey = o_orderkey
)"""

TEXT_PERIODS = f"""WITH {_LOCATED}, survey AS (
  SELECT {_PLACES}, {_DIRTY},
    CASE WHEN l_linenumber = 3 THEN NULL
         WHEN l_linenumber = 1 THEN '0' || year(l_shipdate)
         WHEN l_linenumber = 2 THEN year(l_shipdate) || '.0'
         ELSE CAST(year(l_shipdate) AS VARCHAR) END AS YEAR_NO,
    CASE WHEN l_linenumber = 7 THEN '13' WHEN l_linenumber = 6 THEN 'x'
         ELSE CAST(month(l_shipdate) AS VARCHAR) END AS MONTH_NO
  FROM located
)"""

_MASTER = """
  p_partkey AS PRODUCT_ID, 'P' || p_partkey AS PRODUCT_CODE, {name} AS PRODUCT_NAME,
  p_type AS DOSAGE_NAME, p_brand AS PHARMA_NAME, split_part(p_name, ' ', 1) AS GENERIC_NAME,
  p_retailprice AS UNIT_PRICE"""

_DIRTY_NAME = """CASE p_size WHEN 1 THEN ' ' || p_name WHEN 2 THEN p_name || ' '
  WHEN 3 THEN replace(p_name, ' ', '  ') WHEN 4 THEN upper(p_name) WHEN 5 THEN NULL ELSE p_name END"""

PRODUCT = f"WITH product AS (SELECT {_MASTER.format(name='p_name')} FROM part)"

PRODUCT_DIRTY = f"""WITH product AS (
  SELECT {_MASTER.format(name=_DIRTY_NAME)} FROM part
  UNION ALL
  SELECT {_MASTER.format(name=_DIRTY_NAME)} FROM part WHERE p_size >= 48
)"""

_MARKET = """market AS (
  SELECT 'R' || r_regionkey AS FIELD_ID, r_name AS MKT_NAME, 1 AS MKT_LEVEL,
    CAST(NULL AS VARCHAR) AS PARENT_MKT_CODE, 'R' || r_regionkey AS MKT_CODE_OLD FROM region
  UNION ALL
  SELECT 'N' || n_nationkey, n_name, 2, 'R' || n_regionkey, 'N' || n_nationkey FROM nation
  UNION ALL
  SELECT CASE WHEN s_acctbal < 0 THEN 'F?' ELSE 'FS' || s_suppkey END, s_name, 3,
    CASE WHEN s_acctbal < 0 THEN 'ZZ' ELSE 'N' || s_nationkey END, 'S' || s_suppkey FROM supplier
)"""
MARKET = f"WITH {_MARKET}"

_KEYS = {"territory": "Region, Area, Territory", "area": "Region, Area", "region": "Region"}
_KEY_SOURCE = {
    "territory": "REGION_ID AS Region, AREA_ID AS Area, TERRITORY_ID AS Territory",
    "area": "REGION_ID AS Region, AREA_ID AS Area",
    "region": "REGION_ID AS Region",
}


def _sums(scope: str, measure: str = "coalesce(SALES_QTY, 0) * coalesce(UNIT_PRICE, 0)") -> str:
    return f"""SELECT {_KEY_SOURCE[scope]}, YEAR_NO AS Year, MONTH_NO AS Month,
      round(sum({measure}), 2) AS SalesAmount
    FROM survey GROUP BY ALL"""


def _series(scope: str = "territory") -> str:
    """CTEs up to ``series``: complete keys, month start, amount."""
    complete = " AND ".join(f"{k} IS NOT NULL" for k in _KEYS[scope].split(", "))
    return f"""{CLEAN}, amounts AS (
      SELECT {_KEY_SOURCE[scope]}, YEAR_NO, MONTH_NO, sum(SALES_QTY * UNIT_PRICE) AS y
      FROM survey GROUP BY ALL
    ), all_series AS (
      SELECT {_KEYS[scope]}, make_date(YEAR_NO, MONTH_NO, 1) AS ds, y FROM amounts
    ), series AS (SELECT * FROM all_series WHERE {complete})"""


_DS = "strftime(ds, '%Y-%m-%d') AS ds"


def _features() -> str:
    lags = ", ".join(f"lag(y, {k}) OVER k AS lag_{k}" for k in (1, 2, 3, 6, 12))
    return f"""{_series()}, lagged AS (
      SELECT *, {lags}, CAST(month(ds) AS BIGINT) AS month, CAST(year(ds) AS BIGINT) AS year
      FROM series WINDOW k AS (PARTITION BY Region, Area, Territory ORDER BY ds)
    ), features AS (SELECT * FROM lagged WHERE lag_12 IS NOT NULL)"""


def _stumps(step: float, leaf_rows: int, l2: int, rounds: int = 3) -> str:
    """Boosting with one cut a round: gradient sums by value of every feature, the best of all cuts per key."""
    inputs = "lag_1, lag_2, lag_3, lag_6, lag_12, month, year"
    doubled = ", ".join(f"{c}::DOUBLE AS {c}" for c in inputs.split(", "))
    by_key, in_order = f"PARTITION BY {_T}, f", f"PARTITION BY {_T}, f ORDER BY v"
    parts = [f"""r0 AS (
      SELECT {_T}, ds, y::DOUBLE AS y, {doubled}, avg(y) OVER (PARTITION BY {_T}) AS pred FROM features)"""]
    for i in range(rounds):
        parts.append(f"""long{i} AS (UNPIVOT r{i} ON {inputs} INTO NAME f VALUE v), sums{i} AS (
      SELECT {_T}, f, v, sum(pred - y) AS g, count(*) AS n FROM long{i} GROUP BY ALL
    ), running{i} AS (
      SELECT {_T}, f, v, sum(g) OVER ({in_order}) AS gl, sum(n) OVER ({in_order}) AS nl,
        sum(g) OVER ({by_key}) AS gt, sum(n) OVER ({by_key}) AS nt
      FROM sums{i}
    ), cuts{i} AS (
      SELECT *, gl * gl / (nl + {l2}) + (gt - gl) * (gt - gl) / (nt - nl + {l2}) AS score
      FROM running{i} WHERE nl >= {leaf_rows} AND nt - nl >= {leaf_rows}
    ), best{i} AS (
      SELECT DISTINCT ON ({_T}) *, score - gt * gt / (nt + {l2}) AS gain FROM cuts{i}
      WHERE score - gt * gt / (nt + {l2}) > 1e-9 * score ORDER BY {_T}, gain DESC, f, v
    ), whole{i} AS (
      SELECT {_T}, sum(pred - y) AS g, count(*) AS n FROM r{i} GROUP BY ALL
    ), r{i + 1} AS (
      SELECT r.* EXCLUDE (pred), pred - {step} * CASE WHEN b.f IS NULL THEN w.g / (w.n + {l2})
        WHEN CASE b.f {' '.join(f"WHEN '{c}' THEN r.{c}" for c in inputs.split(', '))} END <= b.v
        THEN b.gl / (b.nl + {l2}) ELSE (b.gt - b.gl) / (b.nt - b.nl + {l2}) END AS pred
      FROM r{i} r JOIN whole{i} w USING ({_T}) LEFT JOIN best{i} b USING ({_T}))""")
    return f"""{_features()}, {', '.join(parts)}
      SELECT {_T}, {_DS}, round(pred, 0) AS yhat FROM r{rounds}"""


def _means() -> str:
    return f"""{_features()}, means AS (
      SELECT Region, Area, Territory, avg(y) AS mean_y, count(*) AS n_obs FROM features GROUP BY ALL
    )"""


def _fit(scope: str = "territory", mode: str = "additive", head: str | None = None) -> str:
    """CTEs up to ``models`` and ``fitted``."""
    keys = _KEYS[scope]
    effect = "y - trend" if mode == "additive" else "y / trend - 1"
    combine = "trend + season" if mode == "additive" else "trend * (1 + season)"
    effects = ", ".join(
        f"coalesce(max(CASE WHEN m = {m} THEN season END), 0) AS season_{m}" for m in range(1, 13)
    )
    return f"""{head or _series(scope)}, timed AS (
      SELECT *, CAST((year(ds) - 2000) * 12 + month(ds) - 1 AS DOUBLE) AS t, month(ds) AS m FROM series
    ), lined AS (
      SELECT *, regr_slope(y, t) OVER k AS slope, regr_intercept(y, t) OVER k AS intercept,
        count(*) OVER k AS n_obs, max(t) OVER k - min(t) OVER k AS span
      FROM timed WINDOW k AS (PARTITION BY {keys})
    ), trended AS (
      SELECT *, intercept + slope * t AS trend FROM lined WHERE n_obs >= 2
    ), seasoned AS (
      SELECT *, CASE WHEN span >= 24 THEN avg({effect}) OVER (PARTITION BY {keys}, m) ELSE 0 END AS season
      FROM trended
    ), fitted AS (SELECT *, {combine} AS yhat FROM seasoned
    ), models AS (
      SELECT {keys}, max(intercept) AS intercept, max(slope) AS slope,
        stddev_samp(y - yhat) AS sigma, count(*) AS n_obs, max(ds) AS last_ds, {effects}
      FROM fitted GROUP BY {keys}
    )"""


def _forecast(scope: str = "territory", mode: str = "additive", horizon: int = 6) -> str:
    """CTEs up to ``forecast``."""
    keys = _KEYS[scope]
    combine = "trend + season" if mode == "additive" else "trend * (1 + season)"
    pick = " ".join(f"WHEN {m} THEN season_{m}" for m in range(1, 13))
    return f"""{_fit(scope, mode)}, months AS (
      SELECT *, CAST(last_ds + to_months(CAST(step AS INTEGER)) AS DATE) AS ds
      FROM models CROSS JOIN range(1, {horizon + 1}) AS r(step)
    ), bands AS (
      SELECT *, intercept + slope * ((year(ds) - 2000) * 12 + month(ds) - 1) AS trend,
        CASE month(ds) {pick} END AS season
      FROM months
    ), forecast AS (
      SELECT {keys}, ds, {combine} AS yhat, {combine} - 1.2816 * sigma AS yhat_lower,
        {combine} + 1.2816 * sigma AS yhat_upper
      FROM bands
    )"""


_BANDS = "round(yhat, 0) AS yhat, round(yhat_lower, 0) AS yhat_lower, round(yhat_upper, 0) AS yhat_upper"
_BAND_SUMS = (
    "round(sum(yhat), 0) AS yhat, round(sum(yhat_lower), 0) AS yhat_lower, "
    "round(sum(yhat_upper), 0) AS yhat_upper"
)


def _errors(rows: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS count, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
      avg(abs(y - yhat)) AS mae,
      avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100 AS mape
    FROM {rows} GROUP BY {keys}"""


_ROUND_ERRORS = "round(rmse, 0) AS rmse, round(mae, 0) AS mae, round(mape, 6) AS mape"
_MEAN_ERRORS = "round(avg(rmse), 0) AS rmse, round(avg(mae), 0) AS mae, round(avg(mape), 6) AS mape"
_T = "Region, Area, Territory"

_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_NAME = r"^[\p{L}\p{N}_\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}\-]+$"


def _text_quality(source: str, column: str, plain: bool) -> str:
    extra = (
        f"""count(*) FILTER (NOT regexp_full_match({column}, '{_NAME}')) AS non_plain,
        round(count(*) FILTER (NOT regexp_full_match({column}, '{_NAME}')) / count(*), 6) AS non_plain_ratio,"""
        if plain
        else ""
    )
    return f"""SELECT '{column}' AS "column", count(*) AS n,
        count(*) FILTER (regexp_matches({column}, '^{_SPACE}')) AS leading_spaces,
        count(*) FILTER (regexp_matches({column}, '{_SPACE}\\z')) AS trailing_spaces,
        count(*) FILTER (regexp_matches({column}, '{_SPACE}{{2,}}')) AS multi_spaces, {extra}
        count(DISTINCT lower({column})) < count(DISTINCT {column}) AS case_variant_issue
      FROM {source} WHERE {column} IS NOT NULL"""


def _nulls(source: str, columns: list[str]) -> str:
    counts = ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in columns)
    shares = ", ".join(
        f"round(count(*) FILTER ({c} IS NULL) / greatest(count(*), 1) * 100, 6) AS {c}_pct" for c in columns
    )
    return f"SELECT {counts}, count(*) AS total_rows, {shares} FROM {source}"


def _top_values(source: str, columns: list[str], distinct: bool) -> str:
    parts = []
    for c in columns:
        extra = f", (SELECT count(DISTINCT {c}) FROM {source}) AS \"distinct\"" if distinct else ""
        parts.append(
            f"""(SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS cnt {extra}
            FROM {source} GROUP BY {c}
            ORDER BY cnt DESC, CAST({c} AS VARCHAR) NULLS FIRST LIMIT 50)"""
        )
    return " UNION ALL ".join(parts)


_PRODUCT_COLUMNS = [
    "PRODUCT_ID",
    "PRODUCT_CODE",
    "PRODUCT_NAME",
    "DOSAGE_NAME",
    "PHARMA_NAME",
    "GENERIC_NAME",
    "UNIT_PRICE",
]
_MARKET_COLUMNS = ["FIELD_ID", "MKT_NAME", "MKT_LEVEL", "PARENT_MKT_CODE", "MKT_CODE_OLD"]
_TOTALS = "round(sum(SALES_QTY), 2) AS total_qty, round(sum(SALES_QTY * UNIT_PRICE), 2) AS sales_amount"


def _top_products(where: str, limit: int) -> str:
    return f"""{DIRTY} SELECT PRODUCT_ID, {_TOTALS} FROM survey {where} GROUP BY PRODUCT_ID
      ORDER BY sum(SALES_QTY * UNIT_PRICE) DESC NULLS LAST, PRODUCT_ID LIMIT {limit}"""


def _stats(prefix: str, column: str) -> str:
    return f"""count(*) FILTER ({column} IS NULL) AS {prefix}_nulls,
      round(min({column}), 4) AS {prefix}_min, round(max({column}), 4) AS {prefix}_max,
      round(avg({column}), 4) AS {prefix}_mean, round(stddev_samp({column}), 4) AS {prefix}_std,
      count(*) FILTER ({column} < 0) AS {prefix}_neg_count"""


def _distribution(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, round(min({column}), 4) AS min,
      round(quantile_cont({column}, 0.25), 4) AS q1, round(quantile_cont({column}, 0.5), 4) AS median,
      round(quantile_cont({column}, 0.75), 4) AS q3, round(max({column}), 4) AS max,
      round(quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25), 4) AS iqr,
      round(quantile_cont({column}, 0.99), 4) AS p99
    FROM survey"""


_WALK = """up AS (
  SELECT MKT_CODE_OLD AS node_code, FIELD_ID AS node_id, FIELD_ID AS ancestor_id, MKT_LEVEL AS ancestor_level,
    PARENT_MKT_CODE AS parent, 0 AS depth, MKT_CODE_OLD AS path, MKT_CODE_OLD AS root_code
  FROM market
  UNION ALL
  SELECT up.node_code, up.node_id, m.FIELD_ID, m.MKT_LEVEL, m.PARENT_MKT_CODE, up.depth + 1,
    m.MKT_CODE_OLD || '/' || up.path, m.MKT_CODE_OLD
  FROM up JOIN market m ON up.parent = m.MKT_CODE_OLD WHERE up.depth < 10
)"""


def oracle_sql() -> dict[str, str]:
    sql = {}
    sql["sales_summary"] = f"""{DIRTY} SELECT count(*) AS row_count, min(YEAR_NO) AS min_year,
      max(YEAR_NO) AS max_year, count(DISTINCT PRODUCT_ID) AS product_count,
      count(DISTINCT REGION_ID) AS region_count, count(DISTINCT AREA_ID) AS area_count,
      count(DISTINCT TERRITORY_ID) AS territory_count FROM survey"""
    places = "REGION_ID, AREA_ID, TERRITORY_ID"
    sql["region_summary"] = f"{DIRTY} SELECT {places}, {_TOTALS} FROM survey GROUP BY {places}"
    sql["region_summary_month"] = (
        f"{DIRTY} SELECT {places}, {_TOTALS} FROM survey WHERE YEAR_NO = 1998 AND MONTH_NO = 5 GROUP BY {places}"
    )
    sql["monthly_trend"] = f"{DIRTY} SELECT YEAR_NO, MONTH_NO, {_TOTALS} FROM survey GROUP BY YEAR_NO, MONTH_NO"
    sql["monthly_trend_region"] = (
        f"{DIRTY} SELECT YEAR_NO, MONTH_NO, {_TOTALS} FROM survey WHERE REGION_ID = 2 GROUP BY YEAR_NO, MONTH_NO"
    )
    sql["top_products"] = _top_products("", 10)
    sql["top_products_year"] = _top_products("WHERE YEAR_NO = 1999", 200)
    sql["sales_sample"] = f"""{CIRCLE} SELECT ROW_DATA_ID, SURVEY_CIRCLE_ID, YEAR_NO, MONTH_NO, PRODUCT_ID,
      SALES_QTY, UNIT_PRICE, TERRITORY_ID, AREA_ID, REGION_ID, PRS_ID FROM survey
      ORDER BY ROW_DATA_ID DESC, PRODUCT_ID, TERRITORY_ID, SALES_QTY NULLS FIRST, UNIT_PRICE NULLS FIRST
      LIMIT 50"""
    sql["sales_summary_stats"] = f"""{DIRTY} SELECT count(*) AS row_count, {_stats('qt', 'SALES_QTY')},
      {_stats('price', 'UNIT_PRICE')} FROM survey"""
    sql["time_features"] = f"""{DIRTY} SELECT YEAR_NO, MONTH_NO, CAST((MONTH_NO + 2) // 3 AS BIGINT) AS quarter
      FROM survey ORDER BY YEAR_NO DESC, MONTH_NO DESC LIMIT 5000"""
    sql["price_change_mom"] = f"""{DIRTY}, monthly AS (
        SELECT PRODUCT_ID, YEAR_NO, MONTH_NO, avg(UNIT_PRICE) AS monthly_price
        FROM survey GROUP BY PRODUCT_ID, YEAR_NO, MONTH_NO
      ), top_prod AS (
        SELECT PRODUCT_ID FROM monthly GROUP BY PRODUCT_ID ORDER BY count(*) DESC, PRODUCT_ID LIMIT 200
      ), priced AS (
        SELECT m.*, lag(monthly_price) OVER (PARTITION BY m.PRODUCT_ID ORDER BY YEAR_NO, MONTH_NO) AS prev
        FROM monthly m JOIN top_prod t ON m.PRODUCT_ID = t.PRODUCT_ID
      )
      SELECT PRODUCT_ID, YEAR_NO, MONTH_NO, round(monthly_price, 6) AS monthly_price,
        round(CASE WHEN prev <> 0 THEN (monthly_price - prev) / prev * 100 END, 6) AS pct_change
      FROM priced"""
    sql["rolling_qty"] = f"""{DIRTY}, monthly AS (
        SELECT REGION_ID, YEAR_NO, MONTH_NO, sum(SALES_QTY) AS total_qty
        FROM survey GROUP BY REGION_ID, YEAR_NO, MONTH_NO
      )
      SELECT REGION_ID, YEAR_NO, MONTH_NO, round(total_qty, 4) AS total_qty, round(avg(total_qty) OVER (
        PARTITION BY REGION_ID ORDER BY YEAR_NO, MONTH_NO ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4)
        AS rolling_avg_qty FROM monthly"""
    sql["sales_distribution"] = (
        f"{DIRTY} {_distribution('SALES_QTY')} UNION ALL {_distribution('UNIT_PRICE')}"
    )
    ids = ["PRODUCT_ID", "SURVEY_CIRCLE_ID", "TERRITORY_ID", "AREA_ID", "REGION_ID"]
    sql["sales_value_counts"] = f"{CIRCLE} {_top_values('survey', ids, False)}"
    sql["time_coverage"] = f"""{DIRTY} SELECT 'year' AS grain, YEAR_NO AS period, count(*) AS cnt
      FROM survey GROUP BY YEAR_NO
      UNION ALL SELECT 'month', MONTH_NO, count(*) FROM survey GROUP BY MONTH_NO"""
    sql["price_qty_corr"] = f"""{DIRTY} SELECT count(*) AS sample, round(corr(UNIT_PRICE, SALES_QTY), 8) AS corr
      FROM survey WHERE UNIT_PRICE IS NOT NULL AND SALES_QTY IS NOT NULL"""
    sql["region_avg_price"] = f"""{DIRTY} SELECT REGION_ID, round(avg(UNIT_PRICE), 4) AS avg_price, count(*) AS n
      FROM survey GROUP BY REGION_ID ORDER BY avg(UNIT_PRICE) DESC, REGION_ID LIMIT 200"""

    sql["product_summary"] = f"""{PRODUCT_DIRTY} SELECT count(*) AS product_count,
      count(DISTINCT PHARMA_NAME) AS pharma_count, count(DISTINCT GENERIC_NAME) AS generic_count,
      count(DISTINCT DOSAGE_NAME) AS dosage_count, round(min(UNIT_PRICE), 4) AS min_price,
      round(max(UNIT_PRICE), 4) AS max_price, round(avg(UNIT_PRICE), 4) AS avg_price FROM product"""
    sql["product_search"] = f"""{PRODUCT} SELECT PRODUCT_ID, PRODUCT_CODE, PRODUCT_NAME, DOSAGE_NAME,
      PHARMA_NAME, GENERIC_NAME, round(UNIT_PRICE, 2) AS unit_price FROM product
      WHERE PRODUCT_NAME LIKE '%wid%' AND UNIT_PRICE >= 950 AND UNIT_PRICE <= 1500
      ORDER BY PRODUCT_NAME, PRODUCT_ID LIMIT 100"""
    sql["product_missing"] = f"{PRODUCT_DIRTY} {_nulls('product', _PRODUCT_COLUMNS)}"
    sql["product_uniqueness"] = f"""{PRODUCT_DIRTY} SELECT count(*) AS total_ids,
      count(*) FILTER (cnt > 1) AS non_unique_ids,
      CAST(coalesce(sum(cnt) FILTER (cnt > 1), 0) AS BIGINT) AS total_duplicate_rows
      FROM (SELECT PRODUCT_ID, count(*) AS cnt FROM product GROUP BY PRODUCT_ID)"""
    sql["product_duplicates"] = f"""{PRODUCT_DIRTY} SELECT PRODUCT_ID, count(*) AS cnt FROM product
      GROUP BY PRODUCT_ID HAVING count(*) > 1 ORDER BY cnt DESC, PRODUCT_ID LIMIT 200"""
    sql["product_price_stats"] = f"""{PRODUCT_DIRTY} SELECT count(*) AS n,
      count(*) FILTER (UNIT_PRICE IS NULL) AS nulls, round(min(UNIT_PRICE), 4) AS min_price,
      round(max(UNIT_PRICE), 4) AS max_price, round(avg(UNIT_PRICE), 4) AS avg_price,
      round(stddev_samp(UNIT_PRICE), 4) AS std_price, round(quantile_cont(UNIT_PRICE, 0.25), 4) AS q1,
      round(quantile_cont(UNIT_PRICE, 0.5), 4) AS median, round(quantile_cont(UNIT_PRICE, 0.75), 4) AS q3
      FROM product"""
    categories = ["PHARMA_NAME", "GENERIC_NAME", "DOSAGE_NAME"]
    sql["product_value_counts"] = f"{PRODUCT_DIRTY} {_top_values('product', categories, True)}"
    texts = ["PRODUCT_CODE", "PRODUCT_NAME", "PHARMA_NAME", "GENERIC_NAME", "DOSAGE_NAME"]
    sql["text_quality"] = (
        f"{PRODUCT_DIRTY} " + " UNION ALL ".join(_text_quality("product", c, False) for c in texts)
    )
    sql["text_quality_documents"] = " UNION ALL ".join(
        _text_quality("documents", c, True) for c in ("text", "lang", "source")
    )
    sql["generic_dosage"] = f"""{PRODUCT_DIRTY} SELECT GENERIC_NAME, DOSAGE_NAME, count(*) AS cnt FROM product
      GROUP BY GENERIC_NAME, DOSAGE_NAME ORDER BY cnt DESC, GENERIC_NAME, DOSAGE_NAME LIMIT 200"""

    sql["market_summary"] = f"""{MARKET} SELECT count(*) AS node_count,
      count(DISTINCT MKT_LEVEL) AS level_count, CAST(min(MKT_LEVEL) AS BIGINT) AS min_level,
      CAST(max(MKT_LEVEL) AS BIGINT) AS max_level FROM market"""
    sql["market_search"] = f"""{MARKET} SELECT FIELD_ID, MKT_NAME, CAST(MKT_LEVEL AS BIGINT) AS MKT_LEVEL,
      PARENT_MKT_CODE, MKT_CODE_OLD FROM market WHERE MKT_LEVEL = 3 AND MKT_NAME LIKE '%Supplier%'
      ORDER BY MKT_LEVEL, MKT_NAME, FIELD_ID LIMIT 500"""
    sql["market_tree"] = f"""WITH RECURSIVE {_MARKET}, {_WALK}, longest AS (
        SELECT node_code, max(depth) AS depth, arg_max(path, depth) AS path, arg_max(root_code, depth) AS root_code
        FROM up GROUP BY node_code
      ), kids AS (
        SELECT PARENT_MKT_CODE AS code, count(*) AS n FROM market WHERE PARENT_MKT_CODE IS NOT NULL GROUP BY 1
      )
      SELECT m.FIELD_ID, m.MKT_NAME, CAST(m.MKT_LEVEL AS BIGINT) AS MKT_LEVEL, m.PARENT_MKT_CODE,
        m.MKT_CODE_OLD, l.depth = 0 AS is_root, l.root_code, CAST(l.depth AS BIGINT) AS depth, l.path,
        coalesce(k.n, 0) AS n_children, TRUE AS reachable
      FROM market m JOIN longest l ON m.MKT_CODE_OLD = l.node_code LEFT JOIN kids k ON m.MKT_CODE_OLD = k.code"""
    sql["level_distribution"] = f"""{MARKET} SELECT CAST(MKT_LEVEL AS BIGINT) AS level, count(*) AS row_count,
      count(DISTINCT FIELD_ID) AS unique_field_ids FROM market GROUP BY MKT_LEVEL"""
    orphan = "PARENT_MKT_CODE IS NOT NULL AND NOT EXISTS (SELECT 1 FROM market p WHERE p.FIELD_ID = c.PARENT_MKT_CODE)"
    sql["hierarchy_integrity"] = f"""{MARKET} SELECT
      (SELECT count(*) FROM market WHERE PARENT_MKT_CODE IS NOT NULL) AS total_children,
      (SELECT count(*) FROM market c WHERE {orphan}) AS issue_count"""
    sql["hierarchy_orphans"] = f"""{MARKET} SELECT FIELD_ID AS child_field_id, PARENT_MKT_CODE AS parent_code,
      CAST(1 AS BIGINT) AS missing_parent FROM market c WHERE {orphan}
      ORDER BY FIELD_ID, PARENT_MKT_CODE LIMIT 200"""
    sql["field_uniqueness"] = f"""{MARKET} SELECT CAST(sum(cnt) AS BIGINT) AS total_rows,
      count(FIELD_ID) AS distinct_field_ids,
      CAST(coalesce(sum(cnt) FILTER (cnt > 1), 0) AS BIGINT) AS non_unique_count
      FROM (SELECT FIELD_ID, count(*) AS cnt FROM market GROUP BY FIELD_ID)"""
    sql["field_duplicates"] = f"""{MARKET} SELECT FIELD_ID, count(*) AS cnt FROM market GROUP BY FIELD_ID
      HAVING count(*) > 1 ORDER BY cnt DESC, FIELD_ID LIMIT 200"""
    sql["duplicate_rows"] = f"""{DIRTY} SELECT ROW_DATA_ID, count(*) AS cnt FROM survey GROUP BY ROW_DATA_ID
      HAVING count(*) > 1 ORDER BY cnt DESC, ROW_DATA_ID LIMIT 200"""
    sql["market_missing"] = f"{MARKET} {_nulls('market', _MARKET_COLUMNS)}"
    sql["children_count"] = f"""{MARKET} SELECT PARENT_MKT_CODE AS parent_id, count(*) AS children FROM market
      WHERE PARENT_MKT_CODE IS NOT NULL GROUP BY 1 ORDER BY children DESC, parent_id LIMIT 500"""
    sql["hierarchy_path"] = f"""WITH RECURSIVE {_MARKET}, walk AS (
        SELECT FIELD_ID, MKT_NAME, MKT_LEVEL, PARENT_MKT_CODE, 0 AS depth FROM market
        WHERE FIELD_ID = 'S0' OR MKT_CODE_OLD = 'S0'
        UNION ALL
        SELECT m.FIELD_ID, m.MKT_NAME, m.MKT_LEVEL, m.PARENT_MKT_CODE, walk.depth + 1
        FROM market m JOIN walk ON m.MKT_CODE_OLD = walk.PARENT_MKT_CODE WHERE walk.depth < 10
      )
      SELECT FIELD_ID, MKT_NAME, CAST(MKT_LEVEL AS BIGINT) AS MKT_LEVEL, PARENT_MKT_CODE,
        CAST(depth AS BIGINT) AS depth FROM walk"""
    sql["hierarchy_closure"] = f"""WITH RECURSIVE {_MARKET}, {_WALK}
      SELECT node_id, ancestor_id, CAST(ancestor_level AS BIGINT) AS ancestor_level,
        CAST(depth AS BIGINT) AS depth FROM up"""
    sql["name_quality"] = f"""{MARKET} SELECT n AS sample, leading_spaces, trailing_spaces, multi_spaces,
      case_variant_issue AS has_case_variants, non_plain_ratio AS non_alnum_ratio
      FROM ({_text_quality('market', 'MKT_NAME', True)})"""

    for scope in _KEYS:
        sql[f"scope_series_{scope}"] = f"{DIRTY} {_sums(scope)}"
    sql["qty_series"] = f"{DIRTY} {_sums('area', 'coalesce(SALES_QTY, 0)')}"
    sql["source_fallback"] = f"{CLEAN} {_sums('area')}"
    sql["source_fallback_survey"] = f"{DIRTY} {_sums('region')}"
    sql["period_sanitize"] = f"""{TEXT_PERIODS}, numbers AS (
        SELECT REGION_ID AS Region, AREA_ID AS Area, TRY_CAST(YEAR_NO AS DOUBLE) AS y,
          TRY_CAST(MONTH_NO AS DOUBLE) AS m, coalesce(SALES_QTY, 0) * coalesce(UNIT_PRICE, 0) AS amount
        FROM survey WHERE YEAR_NO IS NOT NULL AND MONTH_NO IS NOT NULL
      )
      SELECT Region, Area, CAST(y AS BIGINT) AS Year, CAST(m AS BIGINT) AS Month,
        round(sum(amount), 2) AS SalesAmount FROM numbers
      WHERE m BETWEEN 1 AND 12 AND y BETWEEN 1900 AND 2100 GROUP BY ALL"""
    sql["input_diagnostics"] = f"""{TEXT_PERIODS} SELECT count(*) AS rows_all,
      count(*) FILTER (YEAR_NO IS NOT NULL AND MONTH_NO IS NOT NULL) AS rows_with_period FROM survey"""
    sql["monthly_series"] = f"{_series()} SELECT {_T}, {_DS}, round(y, 2) AS y FROM all_series"

    lags = ", ".join(f"round(lag_{k}, 2) AS lag_{k}" for k in (1, 2, 3, 6, 12))
    # The lag query keeps incomplete keys, whose rows form groups of their own.
    all_lags = ", ".join(f"round(lag(y, {k}) OVER k, 2) AS lag_{k}" for k in (1, 2, 3, 6, 12))
    sql["lag_features"] = f"""{_series()} SELECT {_T}, {_DS}, round(y, 2) AS y, {all_lags},
      CAST(month(ds) AS BIGINT) AS month, CAST(year(ds) AS BIGINT) AS year
      FROM all_series s WINDOW k AS (PARTITION BY {_T} ORDER BY s.ds)"""
    sql["training_features"] = (
        f"{_features()} SELECT {_T}, {_DS}, round(y, 2) AS y, {lags}, month, year FROM features"
    )
    window = ", ".join(f"round(lag(y, {13 - i}) OVER k, 2) AS x_{i}" for i in range(1, 13))
    sql["sequence_windows"] = f"""{_series()}, windows AS (
        SELECT {_T}, ds, {window}, round(y, 2) AS y
        FROM series s WINDOW k AS (PARTITION BY {_T} ORDER BY s.ds)
      )
      SELECT * REPLACE (strftime(ds, '%Y-%m-%d') AS ds) FROM windows WHERE x_1 IS NOT NULL"""
    sql["last_periods"] = (
        f"{_series()} SELECT {_T}, strftime(max(ds), '%Y-%m-%d') AS last_ds FROM series GROUP BY {_T}"
    )
    sql["mean_model"] = f"{_means()} SELECT {_T}, round(mean_y, 3) AS mean_y, n_obs FROM means"

    for name, mode, digits in (("trend_fit", "additive", 0), ("trend_fit_multiplicative", "multiplicative", 6)):
        seasons = ", ".join(f"round(season_{m}, {digits}) AS season_{m}" for m in range(1, 13))
        sql[name] = f"""{_fit('territory', mode)} SELECT {_T}, round(intercept, 0) AS intercept,
          round(slope, 0) AS slope, round(sigma, 0) AS sigma, n_obs,
          strftime(last_ds, '%Y-%m-%d') AS last_ds, '{mode}' AS mode, {seasons} FROM models"""
    for name, scope, mode in (
        ("trend_forecast", "territory", "additive"),
        ("trend_forecast_area", "area", "additive"),
        ("trend_forecast_region", "region", "additive"),
        ("trend_forecast_multiplicative", "territory", "multiplicative"),
    ):
        sql[name] = f"{_forecast(scope, mode)} SELECT {_KEYS[scope]}, {_DS}, {_BANDS} FROM forecast"
    sql["stored_forecast"] = (
        f"{_forecast('area', horizon=12)} SELECT Region, Area, {_DS}, {_BANDS} FROM forecast WHERE Region = 1"
    )
    sql["training_report"] = f"""{_fit()} SELECT {_T}, 'ok' AS status, n_obs,
      Region || '__' || Area || '__' || Territory AS model_key FROM models"""
    sql["nested_forecast"] = f"""{_forecast()} SELECT Region || '__' || Area || '__' || Territory AS key,
      count(*) OVER k AS months, row_number() OVER (k ORDER BY f.ds) - 1 AS place, {_DS}, {_BANDS}
      FROM forecast f WINDOW k AS (PARTITION BY {_T})"""
    sql["forecast_grid"] = f"""{_forecast()} SELECT Area, strftime(ds, '%Y-%m-%d') AS ds,
      CAST(year(ds) AS BIGINT) AS Year, CAST(month(ds) AS BIGINT) AS Month, {_BAND_SUMS},
      'Product' AS missing_dims FROM forecast GROUP BY Area, forecast.ds"""
    dims = {
        "yearly_total": ("Year",),
        "year_month_total": ("Year", "Month"),
        "year_month_territory_total": ("Year", "Month", "Territory"),
        "year_month_area_total": ("Year", "Month", "Area"),
    }
    parts = []
    for view, own in dims.items():
        columns = ", ".join(
            d if d in own else f"CAST(NULL AS BIGINT) AS {d}" for d in ("Year", "Month", "Territory", "Area")
        )
        parts.append(
            f"SELECT '{view}' AS view, {columns}, {_BAND_SUMS} FROM dated GROUP BY {', '.join(own)}"
        )
    sql["forecast_views"] = f"""{_forecast()}, dated AS (
        SELECT *, CAST(year(ds) AS BIGINT) AS Year, CAST(month(ds) AS BIGINT) AS Month FROM forecast
      ) {' UNION ALL '.join(parts)}"""
    product_views = {
        "yearly_selected_product": "Year,Product",
        "yearly_product_wise": "Year,Product",
        "year_month_selected_product": "Year,Month,Product",
        "year_month_product_wise": "Year,Month,Product",
        "year_month_territory_selected_product": "Year,Month,Territory,Product",
        "year_month_area_selected_product": "Year,Month,Area,Product",
    }
    states = [f"('{v}', 'ok', '{','.join(d)}', '')" for v, d in dims.items()]
    states += [f"('{v}', 'unavailable', '{d}', 'Product')" for v, d in product_views.items()]
    sql["view_status"] = f"""{_forecast()}, dated AS (
        SELECT *, CAST(year(ds) AS BIGINT) AS Year, CAST(month(ds) AS BIGINT) AS Month FROM forecast
      ), sums AS (
        SELECT view, count(*) AS n_rows, round(sum(total), 0) AS total FROM (
          {' UNION ALL '.join(f"SELECT '{v}' AS view, sum(yhat) AS total FROM dated GROUP BY {', '.join(d)}"
                              for v, d in dims.items())}
        ) GROUP BY view
      )
      SELECT v.view, v.status, v.dimensions, v.missing_dims, 'sales_amount' AS measure,
        coalesce(n_rows, 0) AS n_rows, total
      FROM (VALUES {', '.join(states)}) AS v(view, status, dimensions, missing_dims) LEFT JOIN sums USING (view)"""

    for name, mode in (("evaluate_trend", "additive"), ("evaluate_trend_multiplicative", "multiplicative")):
        sql[name] = f"""{_fit('territory', mode)}, errors AS ({_errors('fitted', _T)})
          SELECT {_T}, count, {_ROUND_ERRORS} FROM errors"""
    sql["evaluate_stored_trend"] = f"""{_fit('area')}, errors AS ({_errors('fitted', 'Region, Area')})
      SELECT Region, Area, count, {_ROUND_ERRORS} FROM errors"""
    sql["evaluate_mean"] = f"""{_means()}, predicted AS (
        SELECT f.*, m.mean_y AS yhat FROM features f JOIN means m USING ({_T})
      ), errors AS ({_errors('predicted', _T)}) SELECT {_T}, count, {_ROUND_ERRORS} FROM errors"""
    sql["evaluation_summary"] = f"""{_fit()}, errors AS ({_errors('fitted', _T)})
      SELECT count(*) AS groups, {_MEAN_ERRORS} FROM errors"""
    sql["compare_models"] = f"""{_fit(head=_means())}, predicted AS (
        SELECT f.*, m.mean_y AS yhat FROM features f JOIN means m USING ({_T})
      ), trend_errors AS ({_errors('fitted', _T)}), mean_errors AS ({_errors('predicted', _T)})
      SELECT 'trend' AS model, count(*) AS groups, {_MEAN_ERRORS} FROM trend_errors
      UNION ALL SELECT 'mean', count(*), {_MEAN_ERRORS} FROM mean_errors"""
    area = f"""area_series AS (
        SELECT Region, Area, ds, sum(y) AS y FROM series GROUP BY Region, Area, ds
      ), area_lagged AS (
        SELECT *, lag(y, 12) OVER (PARTITION BY Region, Area ORDER BY ds) AS lag_12 FROM area_series
      ), area_means AS (
        SELECT Region, Area, avg(y) AS mean_y, count(*) AS n_obs FROM area_lagged
        WHERE lag_12 IS NOT NULL GROUP BY Region, Area
      )"""
    sql["model_roundtrip"] = f"""{_means()}, {area}
      SELECT 'area' AS scope, Region || '__' || Area AS model_key, round(mean_y, 3) AS mean_y, n_obs
      FROM area_means
      UNION ALL
      SELECT 'territory', Region || '__' || Area || '__' || Territory, round(mean_y, 3), n_obs FROM means"""

    for name in ("trees_a_forecast", "trees_b_forecast"):
        sql[name] = _tree_rows("territory")
    for scope in ("area", "region"):
        sql[f"trees_a_forecast_{scope}"] = _tree_rows(scope)
    sql["maintained_history"] = f"""{CLEAN}
      SELECT REGION_ID AS Region, AREA_ID AS Area, TERRITORY_ID AS Territory, YEAR_NO, MONTH_NO,
        round(sum(CASE WHEN ROW_DATA_ID % 7 = 0 THEN 2 ELSE 1 END * SALES_QTY * UNIT_PRICE), 2) AS SalesAmount
      FROM survey GROUP BY ALL"""
    hinges = ", ".join(f"greatest(t - {0.8 * (j + 1) / 8!r}, 0.0)" for j in range(8))
    curve = ", ".join(
        f"CASE WHEN span >= 24 THEN {f}(mi * 2 * pi() * {k} / 12) ELSE 0.0 END" for k in (1, 2) for f in ("cos", "sin")
    )
    sql["changepoint_normal_equations"] = f"""{_series()}, known AS (
        SELECT {_T}, y::DOUBLE AS y, ((year(ds) - 2000) * 12 + month(ds) - 1)::DOUBLE AS mi
        FROM series WHERE y IS NOT NULL
      ), own AS (
        SELECT {_T}, min(mi) AS first, greatest(max(mi) - min(mi), 1.0) AS span, count(*) AS n,
          CASE WHEN max(abs(y)) > 0 THEN max(abs(y)) ELSE 1.0 END AS scale
        FROM known GROUP BY ALL
      ), timed AS (
        SELECT {_T}, mi, (mi - first) / span AS t, span, y / scale AS y FROM known JOIN own USING ({_T}) WHERE n >= 2
      ), design AS (SELECT {_T}, [1.0::DOUBLE, t, {hinges}, {curve}, y] AS x FROM timed)
      SELECT {_T}, i, j, round(sum(x[i + 1] * x[j + 1]), 6) AS total
      FROM design, range(15) AS a(i), range(15) AS b(j) WHERE i <= j GROUP BY ALL"""
    sql["changepoint_forecast"] = f"""{_series()}, known AS (
        SELECT {_T}, max(ds) AS last_ds FROM series WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 2
      )
      SELECT {_T}, strftime(last_ds + to_months(CAST(step AS INTEGER)), '%Y-%m-%d') AS ds, TRUE AS inside
      FROM known, range(1, 7) AS r(step)"""
    sql["boosted_stumps_a"] = _stumps(step=0.1, leaf_rows=20, l2=0)
    sql["boosted_stumps_b"] = _stumps(step=0.3, leaf_rows=1, l2=1)
    for name in ("evaluate_trees_a", "evaluate_trees_b"):
        sql[name] = f"{_means()} SELECT {_T}, n_obs AS count, TRUE AS as_good_as_mean FROM means"
    sql["compare_stored_models"] = f"""{_fit(head=_means())}, predicted AS (
        SELECT f.*, m.mean_y AS yhat FROM features f JOIN means m USING ({_T})
      ), trend_errors AS ({_errors('fitted', _T)}), mean_errors AS ({_errors('predicted', _T)}),
      mean_error AS (SELECT avg(rmse) AS mean_rmse FROM mean_errors)
      SELECT 'trend' AS model, count(*) AS groups, avg(rmse) <= any_value(mean_rmse) AS as_good_as_mean,
        {_MEAN_ERRORS} FROM trend_errors, mean_error
      UNION ALL SELECT m, (SELECT count(*) FROM means), TRUE, NULL, NULL, NULL
      FROM (VALUES ('trees_a'), ('trees_b')) AS t(m)"""
    for scope, suffix in (("territory", ""), ("area", "_area"), ("region", "_region")):
        sql[f"sequence_forecast{suffix}"] = f"""{_solved(scope)}, steps AS (
          SELECT {_KEYS[scope]}, last_ds, bias, coef, recent, 0 AS step FROM solved
          UNION ALL
          SELECT {_KEYS[scope]}, last_ds, bias, coef,
            list_append(recent[2:], bias + list_dot_product(recent, coef)), step + 1
          FROM steps WHERE step < 6
        ), forecast AS (
          SELECT {_KEYS[scope]}, CAST(last_ds + to_months(CAST(step AS INTEGER)) AS DATE) AS ds, recent[12] AS yhat
          FROM steps WHERE step > 0
        )
        SELECT {_KEYS[scope]}, {_DS}, round(yhat, 0) AS yhat, round(yhat, 0) AS yhat_lower,
          round(yhat, 0) AS yhat_upper FROM forecast"""
    sql["evaluate_sequence"] = f"""{_solved('territory')}, fitted AS (
        SELECT {_T}, w.y, s.bias + list_dot_product(w.x, s.coef) AS yhat FROM windows w JOIN solved s USING ({_T})
      ), errors AS ({_errors('fitted', _T)}) SELECT {_T}, count, {_ROUND_ERRORS} FROM errors"""
    halves = f"""{_series()}, halves AS (
        SELECT {_T}, max(ds) AS last_ds, coalesce(avg(y) FILTER (month(ds) <= 6), avg(y)) AS first,
          coalesce(avg(y) FILTER (month(ds) > 6), avg(y)) AS second
        FROM series GROUP BY {_T} HAVING count(*) >= 6
      )"""
    sql["grouped_forecast"] = f"""{halves}, forecast AS (
        SELECT {_T}, CAST(last_ds + to_months(CAST(step AS INTEGER)) AS DATE) AS ds, first, second
        FROM halves CROSS JOIN range(1, 7) AS r(step)
      ), predicted AS (
        SELECT {_T}, ds, CASE WHEN month(ds) <= 6 THEN first ELSE second END AS yhat FROM forecast
      )
      SELECT {_T}, {_DS}, round(yhat, 0) AS yhat, round(yhat, 0) AS yhat_lower, round(yhat, 0) AS yhat_upper
      FROM predicted"""
    sql["grouped_evaluation"] = f"""{halves}, fitted AS (
        SELECT s.*, CASE WHEN month(s.ds) <= 6 THEN first ELSE second END AS yhat
        FROM series s JOIN halves USING ({_T})
      ), errors AS ({_errors('fitted', _T)}) SELECT {_T}, count, {_ROUND_ERRORS} FROM errors"""
    sql["named_sql"] = """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * l_extendedprice), 2) AS amount
      FROM lineitem WHERE year(l_shipdate) = 1996 AND l_quantity >= 10 GROUP BY l_returnflag"""
    newest = "ORDER BY ROW_DATA_ID DESC LIMIT 3000"
    samples = [
        _distribution(c).replace("FROM survey", f"FROM (SELECT * FROM survey WHERE {c} IS NOT NULL {newest})")
        for c in ("SALES_QTY", "UNIT_PRICE")
    ]
    sql["sales_distribution_sample"] = f"{DIRTY} {' UNION ALL '.join(samples)}"
    sql["price_qty_corr_sample"] = f"""{DIRTY} SELECT count(*) AS sample, round(corr(UNIT_PRICE, SALES_QTY), 8) AS corr
      FROM (SELECT * FROM survey WHERE UNIT_PRICE IS NOT NULL AND SALES_QTY IS NOT NULL {newest})"""
    return sql


def _tree_rows(scope: str) -> str:
    """The months that a tree forecast must have: six after each key with over twelve known months."""
    keys = _KEYS[scope]
    return f"""{_series(scope)}, known AS (
        SELECT {keys}, max(ds) AS last_ds FROM series GROUP BY {keys} HAVING count(*) > 12
      ), forecast AS (
        SELECT {keys}, CAST(last_ds + to_months(CAST(step AS INTEGER)) AS DATE) AS ds
        FROM known CROSS JOIN range(1, 7) AS r(step)
      )
      SELECT {keys}, {_DS}, TRUE AS one_band, TRUE AS in_reach FROM forecast"""


def _solved(scope: str) -> str:
    """CTEs up to ``windows`` and ``solved``: the ridge regression on twelve values, by elimination.

    ``rows`` holds the normal equations, a row per coefficient with the right-hand side last;
    every step of ``eliminated`` clears one column. The matrix is positive definite, so that the
    pivots are on the diagonal.
    """
    keys = _KEYS[scope]
    head = _series(scope).replace("WITH", "WITH RECURSIVE", 1)
    return f"""{head}, scaled AS (
        SELECT {keys}, ds, y, avg(y) OVER k AS level, avg(abs(y)) OVER k AS size FROM series
        WINDOW k AS (PARTITION BY {keys})
      ), windows AS (
        SELECT * FROM (
          SELECT {keys}, ds, y, level, size, list(y) OVER (
            PARTITION BY {keys} ORDER BY ds ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x FROM scaled)
        WHERE len(x) = 12
      ), unit AS (
        SELECT {keys}, (y - level) / size AS t, list_transform(x, lambda v: (v - level) / size) AS z FROM windows
      ), cells AS (
        SELECT {keys}, i, j, sum(z[i] * z[j]) + CASE WHEN i = j THEN 0.1 * count(*) ELSE 0 END AS v
        FROM unit, range(1, 13) AS a(i), range(1, 13) AS b(j) GROUP BY {keys}, i, j
        UNION ALL
        SELECT {keys}, i, 13, sum(z[i] * t) FROM unit, range(1, 13) AS a(i) GROUP BY {keys}, i
      ), eliminated AS (
        SELECT {keys}, i, 0 AS done, list(v ORDER BY j) AS r FROM cells GROUP BY {keys}, i
        UNION ALL
        SELECT {keys}, i, done + 1, CASE WHEN i = done + 1 THEN list_transform(p, lambda v: v / p[done + 1])
          ELSE list_transform(r, lambda v, n: v - r[done + 1] / p[done + 1] * p[n]) END
        FROM (
          SELECT *, max(CASE WHEN i = done + 1 THEN r END) OVER (PARTITION BY {keys}) AS p FROM eliminated WHERE done < 12
        )
      ), coefficients AS (
        SELECT {keys}, list(r[13] ORDER BY i) AS coef FROM eliminated WHERE done = 12 GROUP BY {keys}
      ), ends AS (
        SELECT {keys}, max(ds) AS last_ds, any_value(level) AS level, list(y ORDER BY ds)[-12:] AS recent
        FROM scaled GROUP BY {keys}
      ), solved AS (
        SELECT {keys}, last_ds, recent, coef, level * (1 - list_sum(coef)) AS bias
        FROM coefficients JOIN ends USING ({keys})
      )"""
