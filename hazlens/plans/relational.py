"""Queries for single functions and joins of the engine that no reporting query of the catalogue shows by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazlens.operators import evaluate, monitor, relate
from hazlens.plans.registry import query
from hazlens.session import table

ROUNDED = 6


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUNDED) for c in columns})


# ---- windows -------------------------------------------------------------------


@query("""
    SELECT c_custkey, rank() OVER s AS place, dense_rank() OVER s AS dense_place, round(percent_rank() OVER s, 6) AS percent_place,
           round(cume_dist() OVER s, 6) AS share_up_to, ntile(4) OVER b AS quarter, row_number() OVER b AS turn
    FROM customer WINDOW s AS (PARTITION BY c_nationkey ORDER BY c_mktsegment), b AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)
""")
def ranking_functions(spark, sf_dir):
    """Places of customers within their nation: by segment (with ties) and by balance."""
    s = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    b = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    out = table(spark, sf_dir, "customer").select(
        "c_custkey", F.rank().over(s).alias("place"), F.dense_rank().over(s).alias("dense_place"), F.percent_rank().over(s).alias("percent_place"),
        F.cume_dist().over(s).alias("share_up_to"), F.ntile(4).over(b).alias("quarter"), F.row_number().over(b).alias("turn"),
    )
    return _rounded(out, "percent_place", "share_up_to").withColumns({c: F.col(c).cast("long") for c in ("place", "dense_place", "quarter", "turn")})


@query("""
    SELECT event_id, first_value(event_type) OVER w AS first_type, last_value(event_type) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type,
           nth_value(event_type, 2) OVER w AS second_type, lag(event_type, 2, 'none') OVER w AS two_before, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS running_value
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def analytic_functions(spark, sf_dir):
    """What came first, second and last for the user of each event, and the running sum."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = table(spark, sf_dir, "events").select(
        "event_id", F.first("event_type").over(w).alias("first_type"), F.last("event_type").over(whole).alias("last_type"), F.nth_value("event_type", 2).over(w).alias("second_type"),
        F.lag("event_type", 2, "none").over(w).alias("two_before"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_value"),
    )
    return _rounded(out, "running_value")


# ---- aggregates ----------------------------------------------------------------


@query("""
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(var_pop(value), 6) AS variance,
           round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(corr(value, hour(ts)), 6) AS correlation,
           round(regr_slope(value, hour(ts)), 6) AS slope, min(value) AS least, max(value) AS most
    FROM events GROUP BY event_type
""")
def distribution_statistics(spark, sf_dir):
    """Moments, percentiles, correlation and slope of the values by type."""
    hour = F.hour("ts").cast("double")
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"), F.var_pop("value").alias("variance"),
        F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.9).alias("p90"), F.corr("value", hour).alias("correlation"),
        F.regr_slope("value", hour).alias("slope"), F.min("value").alias("least"), F.max("value").alias("most"),
    )
    return _rounded(out, "mean", "deviation", "variance", "median", "p90", "correlation", "slope")


@query("""
    SELECT user_id, event_id AS last_event, event_type AS last_type, types, kinds FROM events
    JOIN (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id) USING (user_id)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_by_user(spark, sf_dir):
    """The newest event of each user by one aggregate, with the set of types."""
    newest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("r")
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(newest, F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.count_distinct("event_type").alias("kinds"))
    return out.select("user_id", F.col("r.event_id").alias("last_event"), F.col("r.event_type").alias("last_type"), "types", "kinds")


@query("""
    SELECT event_type, count(DISTINCT user_id) AS users, true AS distinct_is_near, true AS merged_is_near, true AS median_is_near
    FROM events GROUP BY event_type
""")
def approximate_aggregates(spark, sf_dir):
    """Estimates beside exact values: distinct users, the same from sketches by day that are merged, and the median."""
    events = table(spark, sf_dir, "events")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("near"), F.percentile("value", F.array(F.lit(0.45), F.lit(0.55))).alias("around"), F.percentile_approx("value", 0.5, 1000).alias("median"))
    daily = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", F.lit(12)).alias("sketch"))
    merged = daily.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("merged"))
    close = lambda c: F.abs(F.col(c) - F.col("users")) <= 0.1 * F.col("users")
    out = exact.join(merged, "event_type")
    return out.select("event_type", "users", close("near").alias("distinct_is_near"), close("merged").alias("merged_is_near"), F.col("median").between(F.col("around")[0], F.col("around")[1]).alias("median_is_near"))


# ---- sets, sort and limit --------------------------------------------------------


@query("""
    WITH e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
    SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM e INTERSECT SELECT * FROM p)
    UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM e UNION SELECT * FROM p)
    UNION ALL SELECT 'error_only', count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM p)
    UNION ALL SELECT 'all', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'error' UNION ALL SELECT user_id FROM events WHERE event_type = 'purchase')
""")
def set_operations(spark, sf_dir):
    """Users with errors and users with purchases: both, either, the difference, and all rows."""
    users = lambda kind: table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id")
    e, p = users("error"), users("purchase")
    parts = {"both": e.intersect(p), "either": e.union(p).distinct(), "error_only": e.subtract(p), "all": e.unionAll(p)}
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return counted[0].unionAll(counted[1]).unionAll(counted[2]).unionAll(counted[3])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 20")
def third_page(spark, sf_dir):
    """Rows 21 to 30 of the orders by price."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(20).limit(10)


# ---- scalars -----------------------------------------------------------------------


@query("SELECT event_type, (props::JSON ->> '$.k')::INT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def props_json(spark, sf_dir):
    """Counts by the key that the properties hold as JSON."""
    k = F.from_json("props", "k int")["k"].alias("k")
    return table(spark, sf_dir, "events").groupBy("event_type", k).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, (props::JSON ->> '$.missing') IS NULL AS absent FROM events")
def props_variant(spark, sf_dir):
    """The same by a variant, which needs no schema."""
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").isNull().alias("absent"))


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, string_agg(event_type || '=' || (2 * n), ',' ORDER BY event_type) FILTER (n > 1) AS doubled, count(*) AS kinds, coalesce(max(n) FILTER (event_type = 'error'), 0)::BIGINT AS errors
    FROM c GROUP BY user_id
""")
def map_functions(spark, sf_dir):
    """A map from type to count by user: filtered, changed, looked up and listed."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    doubled = F.map_entries(F.transform_values(F.map_filter("m", lambda k, v: v > 1), lambda k, v: 2 * v))
    listed = F.array_join(F.transform(doubled, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return maps.select("user_id", F.when(F.size(doubled) > 0, listed).alias("doubled"), F.size("m").cast("long").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("error")), F.lit(0).cast("long")).alias("errors"))


@query(r"""
    SELECT page_id, upper(substring(url, 1, 8)) AS head, replace(url, 'https', 'http') AS plain, split_part(url, '/', 3) AS host, strpos(url, '.') AS dot, lpad(page_id::VARCHAR, 8, '0') AS padded,
           reverse(regexp_extract(url, '([a-z]+)$', 1)) AS tail, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, concat_ws('-', page_id::VARCHAR, NULL, 'x') AS joined, levenshtein(split_part(url, '/', 3), 'www.example.com') AS edits
    FROM pages
""")
def string_functions(spark, sf_dir):
    url, key = F.col("url"), F.col("page_id").cast("string")
    host = F.split_part(url, F.lit("/"), F.lit(3))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.upper(F.substring(url, 1, 8)).alias("head"), F.replace(url, F.lit("https"), F.lit("http")).alias("plain"), host.alias("host"), F.instr(url, ".").cast("long").alias("dot"),
        F.lpad(key, 8, "0").alias("padded"), F.reverse(F.regexp_extract(url, "([a-z]+)$", 1)).alias("tail"), F.regexp_replace(url, "[0-9]+", "#").alias("masked"),
        F.concat_ws("-", key, F.lit(None).cast("string"), F.lit("x")).alias("joined"), F.levenshtein(host, F.lit("www.example.com")).cast("long").alias("edits"),
    )


@query("""
    SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, dayofyear(o_orderdate) AS day_of_year, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end,
           strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS ten_later, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS days_to_2000, strftime(o_orderdate, '%Y/%m') AS label
    FROM orders
""")
def date_functions(spark, sf_dir):
    d = F.col("o_orderdate")
    numbers = {"y": F.year(d), "q": F.quarter(d), "m": F.month(d), "day_of_year": F.dayofyear(d), "days_to_2000": F.date_diff(F.lit("2000-01-01").cast("date"), F.to_date(d))}
    out = table(spark, sf_dir, "orders").withColumns({"month_end": F.last_day(d).cast("string"), "ten_later": F.date_add(F.to_date(d), 10).cast("string"), "label": F.date_format(d, "yyyy/MM")})
    return out.select("o_orderkey", "month_end", "ten_later", "label", *(c.cast("long").alias(n) for n, c in numbers.items()))


@query("""
    SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_quantity + 1), 6) AS log_quantity, floor(l_discount * 100)::BIGINT AS cents, abs(l_tax - l_discount)::DECIMAL(12, 4)::DOUBLE AS gap,
           greatest(l_tax, l_discount) AS larger, (l_orderkey % 7)::BIGINT AS week, (l_linenumber & 3)::BIGINT AS low_bits, CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 10 THEN 'middle' ELSE 'small' END AS size,
           nullif(l_returnflag, 'N') AS returned, coalesce(nullif(l_linestatus, 'O'), '-') AS status
    FROM lineitem
""")
def math_and_conditions(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.sqrt("l_extendedprice"), 6).alias("root"), F.round(F.log(q + 1), 6).alias("log_quantity"), F.floor(F.col("l_discount") * 100).cast("long").alias("cents"),
        F.abs(F.col("l_tax") - F.col("l_discount")).cast("decimal(12,4)").cast("double").alias("gap"), F.greatest("l_tax", "l_discount").alias("larger"), (F.col("l_orderkey") % 7).cast("long").alias("week"),
        F.col("l_linenumber").bitwiseAND(3).cast("long").alias("low_bits"), F.when(q > 40, "large").when(q > 10, "middle").otherwise("small").alias("size"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("returned"), F.coalesce(F.nullif(F.col("l_linestatus"), F.lit("O")), F.lit("-")).alias("status"),
    )


@query("""
    SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS square, round(list_max(embedding)::DOUBLE, 6) AS most, list_position(embedding, list_max(embedding)) AS most_at,
           len(list_filter(embedding, lambda x: x > 0)) AS positive, round(embedding[3]::DOUBLE, 6) AS third, len(embedding[2:5]) AS part
    FROM embeddings
""")
def array_functions(spark, sf_dir):
    e = F.col("embedding")
    out = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(e).cast("long").alias("n"), F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("square"), F.array_max(e).cast("double").alias("most"),
        F.array_position(e, F.array_max(e)).alias("most_at"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), F.element_at(e, 3).cast("double").alias("third"), F.size(F.slice(e, 2, 4)).cast("long").alias("part"),
    )
    return _rounded(out, "square", "most", "third")


# ---- joins --------------------------------------------------------------------------


@query("""
    WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL),
    e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
    SELECT e.event_id, v.view_id, (date_diff('microsecond', v.ts, e.ts) // 1000000)::BIGINT AS seconds FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts
""")
def asof_join(spark, sf_dir):
    """For each error the user's newest view up to then, by one window over both: no pairs are made."""
    events = table(spark, sf_dir, "events")
    kind = lambda name: events.where(F.col("event_type") == name)
    views = kind("view").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id")).withColumn("view_ts", F.col("ts"))
    out = relate.asof(kind("error").select("event_id", "user_id", "ts"), views, "user_id", "ts", ["view_id", "view_ts"])
    return out.select("event_id", "view_id", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("view_ts").cast("timestamp"))) / 1_000_000).cast("long").alias("seconds"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def hinted_joins(spark, sf_dir):
    """One join by each strategy a hint can ask for; all three must agree for a row to come out."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    one = lambda hint: orders.join(customer.hint(hint), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return one("merge").join(one("shuffle_hash").drop("total"), ["c_mktsegment", "n"]).join(one("broadcast").drop("total"), ["c_mktsegment", "n"])


# ---- statistics on distributions ---------------------------------------------------------


SPLIT_DAY = "2024-01-16"


@query(f"""
    WITH c AS (SELECT event_type, count(*) FILTER (ts < '{SPLIT_DAY}')::DOUBLE AS a, count(*) FILTER (ts >= '{SPLIT_DAY}')::DOUBLE AS b FROM events GROUP BY event_type),
    e AS (SELECT *, (a + b) * sum(a) OVER () / (sum(a) OVER () + sum(b) OVER ()) AS ea, (a + b) * sum(b) OVER () / (sum(a) OVER () + sum(b) OVER ()) AS eb FROM c)
    SELECT round(sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb), 6) AS chi_square, count(*) - 1 AS freedom FROM e
""")
def chi_square_drift(spark, sf_dir):
    """Whether the mix of types changed after the split."""
    events, split = table(spark, sf_dir, "events"), F.lit(SPLIT_DAY).cast("timestamp_ntz")
    return _rounded(monitor.chi_square(events, "event_type", F.col("ts") >= split), "chi_square")


@query("""
    WITH s AS (SELECT length(text) AS score, toxic AS y FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
    v AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM s GROUP BY score),
    r AS (SELECT p, n, sum(n) OVER (ORDER BY score) - n AS below FROM v)
    SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM r
""")
def auc_of_length(spark, sf_dir):
    """Area under the ROC curve, with the length of a text as its score."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("score")).join(table(spark, sf_dir, "labels").where("toxic is not null"), "doc_id")
    return _rounded(evaluate.auc(rows, "toxic", "score"), "auc")
