"""Profiles, anomalies, units, dates, text functions, formats."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import coerce, dates, formats, spans, text, units
from ..operators import anomaly, profile, ranking
from . import tabular

QUERIES: dict[str, tuple] = {}


def register(name: str, table: str, sql: str | None = None):
    return tabular.register(name, table, sql, QUERIES)


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 'number' AS kind, count(*) AS n, CAST(0 AS BIGINT) AS missing, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std FROM lineitem"
    for c in ("l_quantity", "l_discount", "l_tax")
) + " UNION ALL SELECT 'l_returnflag', 'text', count(*), 0, count(DISTINCT l_returnflag), NULL, NULL, NULL, NULL FROM lineitem"


@register("profile_columns", "lineitem", _PROFILE)
def profile_columns(df):
    out = profile.profile(df, ["l_quantity", "l_discount", "l_tax", "l_returnflag"])
    return out.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


_TOTALS = (
    "SELECT 'l_quantity' AS \"column\", 'number' AS kind, count(l_quantity) AS filled, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, "
    "CAST(NULL AS VARCHAR) AS first, CAST(NULL AS VARCHAR) AS last FROM lineitem "
    "UNION ALL SELECT 'l_returnflag', 'text', CAST(0 AS BIGINT), NULL, NULL, NULL, NULL "
    "UNION ALL SELECT 'l_shipdate', 'date', count(l_shipdate), NULL, NULL, strftime(min(l_shipdate), '%Y-%m-%d'), strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem"
)


@register("column_totals", "lineitem", _TOTALS)
def column_totals(df):
    out = profile.totals(df, ["l_quantity", "l_returnflag", "l_shipdate"])
    return out.select("column", "kind", "filled", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first", "last")])


@register("profile_patterns", "part", "SELECT c AS \"column\", d = n AND n > 1 AS unique_identifier, t AND d <= 5 AS few_categories, false AS many_missing FROM (SELECT 'p_partkey' AS c, count(*) AS n, count(DISTINCT p_partkey) AS d, false AS t FROM part UNION ALL SELECT 'p_brand', count(*), count(DISTINCT p_brand), true FROM part UNION ALL SELECT 'p_size', count(*), count(DISTINCT p_size), false FROM part) s")
def profile_patterns(df):
    return profile.patterns(profile.profile(df, ["p_partkey", "p_brand", "p_size"]))


@register("profile_trend", "orders", "WITH s AS (SELECT count(o_totalprice) AS n, regr_slope(o_totalprice, o_orderkey) AS slope, avg(o_totalprice) AS mean FROM orders) SELECT n, round(slope, 6) AS slope, round(mean, 4) AS mean, CASE WHEN slope / abs(mean) > 0.1 THEN 'increasing' WHEN slope / abs(mean) < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM s")
def profile_trend(df):
    out = profile.slope_trend(df, "o_totalprice", "o_orderkey")
    return out.select("n", F.round("slope", 6).alias("slope"), F.round("mean", 4).alias("mean"), "trend")


_Q = "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders), q AS (SELECT max(n) AS n, min(v) FILTER (i = n // 4) AS q1, min(v) FILTER (i = 3 * n // 4) AS q3 FROM r) "


@register("quartiles_positional", "orders", _Q + "SELECT n, q1, q3, round(q3 - q1, 4) AS iqr FROM q")
def quartiles_positional(df):
    return profile.quartiles(df, F.col("o_totalprice")).withColumn("iqr", F.round("iqr", 4)).select("n", "q1", "q3", "iqr")


@register("outliers_iqr", "orders", _Q + ", b AS (SELECT q1 - 0.1 * (q3 - q1) AS low, q3 + 0.1 * (q3 - q1) AS high, q3 - q1 AS iqr FROM q) SELECT o_orderkey, 'outlier' AS anomaly_type, 'o_totalprice' AS \"column\", o_totalprice AS value, CASE WHEN greatest(low - o_totalprice, o_totalprice - high) / iqr > 3 THEN 'critical' WHEN greatest(low - o_totalprice, o_totalprice - high) / iqr > 2 THEN 'high' WHEN greatest(low - o_totalprice, o_totalprice - high) / iqr > 1 THEN 'medium' ELSE 'low' END AS severity FROM orders, b WHERE o_totalprice < low OR o_totalprice > high")
def outliers_iqr(df):
    """Order totals are even: a narrow factor shows the mechanism."""
    return anomaly.iqr_outliers(df, "o_totalprice", ["o_orderkey"], factor=0.1)


@register("outliers_zscore", "events", "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events) SELECT event_id, 'outlier' AS anomaly_type, 'value' AS \"column\", value, CASE WHEN abs((value - m) / sd) > 5 THEN 'critical' WHEN abs((value - m) / sd) > 4 THEN 'high' WHEN abs((value - m) / sd) > 3.5 THEN 'medium' ELSE 'low' END AS severity FROM events, s WHERE abs((value - m) / sd) > 3")
def outliers_zscore(df):
    return anomaly.z_outliers(df, "value", ["event_id"]).select("event_id", "anomaly_type", "column", "value", "severity")


_GAPS = "(SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 13 = 0 THEN ' - ' ELSE c_mktsegment END AS c_mktsegment FROM customer) g"


def _gaps(df):
    k = F.col("c_custkey")
    name = F.when(k % 9 == 0, "N/A").when(k % 13 == 0, None).otherwise(F.col("c_name"))
    return df.select("c_custkey", name.alias("c_name"), F.when(k % 13 == 0, " - ").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


_MISS = "({0} IS NULL OR lower(trim({0})) IN ('', 'null', 'none', 'n/a', 'na', '-', '#n/a', '#null!'))"


@register("missing_cells", "customer", f"SELECT c_custkey, 'c_name' AS \"column\", 'missing_value' AS anomaly_type FROM {_GAPS} WHERE {_MISS.format('c_name')} UNION ALL SELECT c_custkey, 'c_mktsegment', 'missing_value' FROM {_GAPS} WHERE {_MISS.format('c_mktsegment')}")
def missing_cells(df):
    return anomaly.missing_cells(_gaps(df), ["c_custkey"], ["c_name", "c_mktsegment"])


@register("empty_rows", "customer", f"SELECT c_custkey FROM {_GAPS} WHERE {_MISS.format('c_name')} AND {_MISS.format('c_mktsegment')}")
def empty_rows(df):
    return anomaly.empty_rows(_gaps(df), "c_custkey", ["c_name", "c_mktsegment"])


_EMPTY = " UNION ALL ".join(f"SELECT '{name}' AS c, count(*) FILTER (WHERE NOT {_MISS.format(cell)}) AS filled FROM customer" for name, cell in (("c_name", "c_name"), ("nothing", "'n/a'")))


@register("empty_columns", "customer", f'SELECT c AS "column" FROM ({_EMPTY}) t WHERE filled = 0')
def empty_columns(df):
    return anomaly.empty_columns(df.select("c_name", F.lit("n/a").alias("nothing")), ["c_name", "nothing"])


@register("duplicates", "documents", "WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS first_index FROM documents WHERE (CAST(NOT " + _MISS.format("text") + " AS INT) + CAST(NOT " + _MISS.format("lang") + " AS INT)) >= 2) SELECT doc_id, first_index FROM k WHERE doc_id > first_index")
def duplicates(df):
    return anomaly.duplicate_rows(df, "doc_id", ["text", "lang"])


@register("format_drift", "part", "SELECT p_partkey, 'inconsistent_format' AS anomaly_type, 'code' AS \"column\", 'B-' || p_partkey AS value, 'text' AS kind, 'numeric' AS expected FROM part WHERE p_partkey % 11 = 0")
def format_drift(df):
    code = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("B-"), F.col("p_partkey"))).otherwise(F.format_string("$%.2f", "p_retailprice"))
    return anomaly.format_drift(df.select("p_partkey", code.alias("code")), "code", ["p_partkey"])


_ODD = (
    "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'Same' ELSE c_name END AS name, "
    "CASE WHEN c_custkey % 13 = 0 THEN ' - ' WHEN c_custkey % 17 = 0 THEN 'ONE' ELSE c_mktsegment END AS segment, "
    "CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN '7' WHEN c_custkey % 11 = 0 THEN 'B-' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS code, "
    "CASE WHEN c_custkey % 60 = 1 THEN 1000000.0 + c_custkey ELSE c_acctbal END AS balance FROM customer"
)
_ODD_MISS = {c: _MISS.format(c) for c in ("name", "segment", "code")}
_ANOMALIES = (
    f"WITH g AS ({_ODD}), f AS (SELECT *, {' + '.join(f'CAST({m} AS INT)' for m in _ODD_MISS.values())} AS gaps FROM g), "
    "r AS (SELECT balance AS v, row_number() OVER (ORDER BY balance) - 1 AS i, count(*) OVER () AS n FROM g), "
    "q AS (SELECT min(v) FILTER (i = n // 4) AS q1, min(v) FILTER (i = 3 * n // 4) AS q3 FROM r), m AS (SELECT avg(balance) AS mean, stddev_samp(balance) AS sd FROM g), "
    "o AS (SELECT count(*) AS n FROM g, q, m WHERE balance < q1 - 1.5 * (q3 - q1) OR balance > q3 + 1.5 * (q3 - q1) OR abs((balance - mean) / sd) > 3) "
    "SELECT anomaly_type, n FROM (SELECT 'missing_value' AS anomaly_type, CAST(sum(gaps) AS BIGINT) AS n FROM f UNION ALL SELECT 'empty_row', count(*) FROM f WHERE gaps = 3 UNION ALL "
    "SELECT 'duplicate_row', count(*) - count(DISTINCT (coalesce(name, ''), coalesce(segment, ''), coalesce(code, ''))) FROM f WHERE gaps <= 1 UNION ALL SELECT 'outlier', n FROM o UNION ALL "
    "SELECT 'inconsistent_format', count(*) FROM g WHERE code LIKE 'B-%') t WHERE n > 0"
)


@register("anomaly_report", "customer", _ANOMALIES)
def anomaly_report(df):
    """All six checks: gaps, empty and repeated rows, outliers by quartiles and by deviation, cells of another kind."""
    k = F.col("c_custkey")
    gone, same = k % 13 == 0, k % 17 == 0
    name = F.when(k % 9 == 0, "N/A").when(gone, None).when(same, "Same").otherwise(F.col("c_name"))
    code = F.when(gone, "").when(same, "7").when(k % 11 == 0, F.concat(F.lit("B-"), k)).otherwise(k.cast("string"))
    segment = F.when(gone, " - ").when(same, "ONE").otherwise(F.col("c_mktsegment"))
    balance = F.when(k % 60 == 1, 1_000_000.0 + k).otherwise(F.col("c_acctbal").cast("double"))
    return anomaly.report(df.select("c_custkey", name.alias("name"), segment.alias("segment"), code.alias("code"), balance.alias("balance")), "c_custkey", ["name", "segment", "code"], ["balance"])


@register("value_types", "events", "SELECT CASE WHEN event_id % 4 = 0 THEN 'boolean' WHEN event_id % 4 = 1 THEN 'numeric' WHEN event_id % 4 = 2 THEN 'date' ELSE 'text' END AS kind, count(*) AS n FROM events GROUP BY 1")
def value_types(df):
    k = F.col("event_id") % 4
    cell = F.when(k == 0, "Yes").when(k == 1, F.format_string("€%.2f", F.abs("value"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.concat(F.lit("v "), F.col("event_type")))
    return df.select(coerce.value_type(cell).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@register("numeric_rules", "part", "SELECT p_partkey, round(p_size / 100.0, 6) AS agg, CAST(p_size AS DOUBLE) AS cmp, CAST(p_size AS DOUBLE) AS anom, CAST(NULL AS DOUBLE) AS diff FROM part")
def numeric_rules(df):
    """The same text, `12%`, under four rules."""
    t = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("%"))
    return df.select("p_partkey", F.round(coerce.num_agg(t), 6).alias("agg"), coerce.num_cmp(t).alias("cmp"), coerce.num_anom(t).alias("anom"), coerce.num_diff(t).alias("diff"))


@register("units_detect", "part", "SELECT CASE WHEN p_partkey % 3 = 0 THEN '$' WHEN p_partkey % 3 = 1 THEN 'kg' ELSE 'm²' END AS unit, CASE WHEN p_partkey % 3 = 0 THEN 'currency' WHEN p_partkey % 3 = 1 THEN 'weight' ELSE 'area' END AS category, count(*) AS n, CAST(sum(p_size) AS DOUBLE) AS total FROM part GROUP BY ALL")
def units_detect(df):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    t = F.when(k == 0, F.concat(F.lit("$"), size)).when(k == 1, F.concat(size, F.lit(" kg"))).otherwise(F.concat(size, F.lit(" sqm")))
    return df.select(units.detect_unit(t).alias("u")).groupBy("u.unit", "u.category").agg(F.count("*").alias("n"), F.sum("u.value").cast("double").alias("total"))


@register("units_aggregate", "part", "SELECT p_brand, CAST(sum(p_size) AS DOUBLE) AS total, count(*) AS n, CAST(0 AS BIGINT) AS skipped, count(DISTINCT p_partkey % 2) > 1 AS mixed FROM part GROUP BY p_brand")
def units_aggregate(df):
    t = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " cm").otherwise(" m"))
    out = units.aggregate_units(df.select("p_brand", t.alias("t")), "t", ["p_brand"])
    return out.select("p_brand", F.col("total").cast("double").alias("total"), "n", "skipped", "mixed")


@register("units_convert", "part", "SELECT p_partkey, round(p_size * 1000.0, 3) AS meters, round(p_size * 0.45359237, 3) AS kilograms, CAST(NULL AS DOUBLE) AS wrong FROM part")
def units_convert(df):
    to = lambda a, b: F.round(units.convert(F.col("p_size"), F.lit(a), F.lit(b)).cast("double"), 3)
    return df.select("p_partkey", to("km", "m").alias("meters"), to("lb", "kg").alias("kilograms"), to("kg", "m").alias("wrong"))


@register("date_to_date", "orders", "SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1998-08-15') AS ytd, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate <= TIMESTAMP '1998-08-15') AS qtd, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-08-01' AND o_orderdate <= TIMESTAMP '1998-08-15') AS mtd FROM orders")
def date_to_date(df):
    ref = F.lit("1998-08-15").cast("timestamp")
    inside = lambda k: F.count_if((F.col("o_orderdate") >= dates.to_date_start(k, ref)) & (F.col("o_orderdate") <= ref)).alias(k)
    return df.agg(inside("ytd"), inside("qtd"), inside("mtd"))


@register("date_quarter", "orders", "SELECT 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY 1")
def date_quarter(df):
    return df.groupBy(dates.quarter_label(F.col("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"))


@register("date_fiscal", "orders", "SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year, CAST((month(o_orderdate) + 2) % 12 // 3 + 1 AS BIGINT) AS fiscal_quarter, count(*) AS n FROM orders GROUP BY ALL")
def date_fiscal(df):
    d = F.col("o_orderdate")
    return df.groupBy(dates.fiscal_year(d).cast("long").alias("fiscal_year"), dates.fiscal_quarter(d).cast("long").alias("fiscal_quarter")).agg(F.count("*").alias("n"))


@register("recency_decay", "orders", "WITH d AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS d FROM orders) SELECT o_orderkey, round(CASE WHEN d <= 30 THEN 1.0 WHEN d >= 365 THEN 0.5 ELSE 1.0 - (d - 30) / 335.0 * 0.5 END, 6) AS recency, round(CASE WHEN d <= 30 THEN 1.0 ELSE greatest(0.1, pow(0.5, (d - 30) / 60.0)) END, 6) AS decay FROM d")
def recency_decay(df):
    ref = F.lit("2001-12-31").cast("date")
    return df.select("o_orderkey", F.round(dates.recency(F.col("o_orderdate"), ref), 6).alias("recency"), F.round(dates.decay(F.col("o_orderdate"), ref), 6).alias("decay"))


@register("date_phrases", "orders", "SELECT o_orderkey, CAST(make_date(CAST(year(o_orderdate) AS INT), CAST(quarter(o_orderdate) * 3 - 2 AS INT), 1) AS VARCHAR) AS first, CAST(last_day(make_date(CAST(year(o_orderdate) AS INT), CAST(quarter(o_orderdate) * 3 AS INT), 1)) AS VARCHAR) AS last FROM orders")
def date_phrases(df):
    phrase = F.concat(F.lit("sales in "), dates.quarter_label(F.col("o_orderdate")))
    first, last = dates.date_bounds(phrase, date(2001, 12, 31))
    return df.select("o_orderkey", first.cast("string").alias("first"), last.cast("string").alias("last"))


@register("filename_dates", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def filename_dates(df):
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Sales_"), F.date_format("o_orderdate", "MMMyyyy"), F.lit(".xlsx"))).otherwise(F.concat(F.lit("report-"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".xlsx")))
    return df.select("o_orderkey", dates.filename_date(name).alias("month"))


@register("script_language", "documents", "WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS t, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM documents) SELECT CASE WHEN t = 0 THEN 'en' WHEN a / t > 0.7 THEN 'en' WHEN 0 > a / t THEN 'th' ELSE 'en' END AS language, count(*) AS n FROM c GROUP BY 1")
def script_language(df):
    return df.groupBy(text.script_language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


def _sql_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_KEYWORDS = (
    "SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda w: w <> ''), "
    "lambda w: regexp_replace(w, '[^\\p{L}\\p{M}\\p{N}_]', '', 'g')), "
    f"lambda w: length(w) >= 2 AND w NOT IN {_sql_list(text.KEYWORD_STOPS)}), ' ') AS words FROM documents"
)


@register("keywords", "documents", _KEYWORDS)
def keywords(df):
    return df.select("doc_id", F.array_join(text.keywords(F.col("text")), " ").alias("words"))


_CACHE_KEYS = (
    "SELECT doc_id, left(sha256(array_to_string(list_sort(list_filter("
    "regexp_split_to_array(regexp_replace(lower('What is the price-range of ' || text || '?'), '[^\\p{L}\\p{M}\\p{N}_\\s.]', ' ', 'g'), '\\s+'), "
    f"lambda w: w <> '' AND w NOT IN {_sql_list(text.QUESTION_STOPS)})), ' ')), 32) AS cache_key FROM documents"
)


@register("cache_keys", "documents", _CACHE_KEYS)
def cache_keys(df):
    return df.select("doc_id", text.cache_key(F.concat(F.lit("What is the price-range of "), F.col("text"), F.lit("?"))).alias("cache_key"))


@register("normal_headers", "part", "SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(p_brand || '-Name_EN'), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')), ' \\(?(th|en)\\)?$', '')) AS header FROM part")
def normal_headers(df):
    return df.select("p_partkey", text.normal_header(F.concat(F.col("p_brand"), F.lit("-Name_EN"))).alias("header"))


@register("levenshtein_similarity", "part", "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE), 6) AS similarity FROM part")
def levenshtein_similarity(df):
    return df.select("p_partkey", F.round(text.levenshtein_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@register("template_fill", "nation", "SELECT n_nationkey, 'name,region' AS parameters, 'Sales of ' || n_name || ' in ' || n_regionkey || ', ' || n_name AS filled FROM nation")
def template_fill(df):
    t = F.lit("Sales of {{name}} in {{ region }}, {{name}}")
    values = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    return df.select("n_nationkey", F.array_join(text.template_parameters(t), ",").alias("parameters"), text.fill_template(t, values).alias("filled"))


@register("json_props", "events", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_props(df):
    return df.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("total"))


@register("formatted_numbers", "supplier", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(s_acctbal)) AS money FROM supplier")
def formatted_numbers(df):
    return df.select("s_suppkey", formats.currency(F.col("s_acctbal")).alias("money"))


@register("formatted_dates", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS long_form, strftime(o_orderdate, '%d/%m/') || (year(o_orderdate) + 543) AS thai_form FROM orders")
def formatted_dates(df):
    d = F.col("o_orderdate")
    return df.select("o_orderkey", formats.day(d, "long").alias("long_form"), formats.day(d, "short", thai=True).alias("thai_form"))


@register("excel_serials", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def excel_serials(df):
    serial = F.datediff("o_orderdate", F.lit(dates.EXCEL_EPOCH)).cast("double")
    return df.select("o_orderkey", F.date_format(dates.excel_serial(serial), "yyyy-MM-dd").alias("day"))


@register("completeness", "customer", f"SELECT round((count(*) FILTER (c_name IS NOT NULL AND trim(c_name) <> '') + count(*) FILTER (c_mktsegment IS NOT NULL AND trim(c_mktsegment) <> '')) / CAST(2 * count(*) AS DOUBLE), 6) AS completeness, 0.1 AS clarity FROM {_GAPS}")
def completeness(df):
    out = ranking.completeness(_gaps(df), ["c_name", "c_mktsegment"])
    return out.select(F.round("completeness", 6).alias("completeness"), "clarity")


@register("similar_values", "part", None)
def similar_values(df):
    """Distinct types most like a misspelt one."""
    found = df.select(F.col("p_type").alias("value")).distinct().withColumn("ratio", text.sequence_ratio("promo brushd stel")("value"))
    return found.where("ratio > 0.4").orderBy(F.desc("ratio"), "value").limit(5)


@register("line_diff", "documents", None)
def line_diff(df):
    """Each document against itself without its last line."""
    lines = F.split("text", "\n")
    shorter = F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1))), "\n")
    return df.select("doc_id", text.line_diff(shorter, F.col("text")).alias("d")).select("doc_id", "d.*")


_SPANS = (
    "WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '([\\x{0E00}-\\x{0E7F}]+|[A-Za-z]+|[^A-Za-z\\x{0E00}-\\x{0E7F}]+)')) AS run, "
    "generate_subscripts(regexp_extract_all(text, '([\\x{0E00}-\\x{0E7F}]+|[A-Za-z]+|[^A-Za-z\\x{0E00}-\\x{0E7F}]+)'), 1) AS i FROM documents), "
    "p AS (SELECT *, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM r), "
    "k AS (SELECT *, CASE WHEN run ~ '^[A-Za-z]' THEN 'en' WHEN run ~ '^[\\x{0E00}-\\x{0E7F}]' THEN 'th' ELSE 'unknown' END AS language FROM p WHERE trim(run, E' \\t\\n\\r\\f\\v') <> ''), "
    "n AS (SELECT *, language IS DISTINCT FROM lag(language) OVER (PARTITION BY doc_id ORDER BY i) AS fresh FROM k), "
    "g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM n), "
    "s AS (SELECT doc_id, span, min(language) AS language, CAST(min(stop - length(run)) AS BIGINT) AS a, CAST(max(stop) AS BIGINT) AS e, count(*) AS runs FROM g GROUP BY ALL) "
    "SELECT doc_id, language, count(*) AS n, CAST(sum(a) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends, CAST(max(e - a) AS BIGINT) AS longest FROM s GROUP BY doc_id, language"
)


@register("language_spans", "documents", _SPANS)
def language_spans(df):
    """Spans of every document by the table function, and where they begin and end."""
    spark = df.sparkSession
    spans.register(spark)
    df.createOrReplaceTempView("_span_documents")
    each = spark.sql("SELECT doc_id, s.language, CAST(s.span_start AS LONG) AS a, CAST(s.span_end AS LONG) AS e FROM _span_documents, LATERAL language_spans(text) s")
    return each.groupBy("doc_id", "language").agg(F.count("*").alias("n"), F.sum("a").alias("starts"), F.sum("e").alias("ends"), F.max(F.col("e") - F.col("a")).alias("longest"))
