"""Queries on ordered lines and positions: fill-forward, islands, neighbours, columns, page text, filters.

Bindings: ``events`` in (ts, event_id) order per user are lines (signup a stamp, view a panel, error a reset, purchase a
row); floors of s_acctbal are column starts, c_acctbal item positions; ``documents`` are texts of lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.operators import layout, table as tables
from assayline.plans.matching import query
from assayline.session import table

_KEYS, _ORDER = ["user_id"], ["ts", "event_id"]


@query(
    "q05_fill_forward",
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stamp FROM events""",
)
def fill_forward(spark, root):
    events = table(spark, root, "events").select("user_id", "event_id", "ts", "event_type")
    return tables.fill_forward(events, _KEYS, _ORDER, F.when(F.col("event_type") == "signup", F.col("event_id")), "stamp").select("event_id", "stamp")


@query(
    "q06_scoped_forward",
    """WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN -1 WHEN event_type = 'view' THEN event_id END AS v FROM events),
f AS (SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM e)
SELECT event_id, CASE WHEN v >= 0 THEN CAST(v AS VARCHAR) END AS columns FROM f""",
)
def scoped_forward(spark, root):
    events = table(spark, root, "events").select("user_id", "event_id", "ts", "event_type")
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    return tables.scoped_forward(events, _KEYS, _ORDER, view, F.col("event_type") == "error", "columns").select("event_id", "columns")


@query(
    "q07_notes",
    """WITH e AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS n FROM e WHERE island > 0 AND event_type <> 'purchase')
SELECT user_id, island, string_agg(event_type, ',' ORDER BY n) AS notes FROM r WHERE n <= 15 GROUP BY user_id, island""",
    big=("island",),
)
def notes(spark, root):
    events = table(spark, root, "events").select("user_id", "event_id", "event_type")
    found = tables.notes_of(events, _KEYS, "event_id", F.col("event_type") == "purchase", F.col("event_type"))
    return found.select("user_id", "island", F.array_join("notes", ",").alias("notes"))


@query(
    "q08_neighbours",
    """SELECT event_id, lag(event_type) OVER w AS above, lead(event_type) OVER w AS below, lead(event_type, 2) OVER w AS below2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def neighbours(spark, root):
    events = table(spark, root, "events").select("user_id", "event_id", "ts", "event_type")
    return tables.neighbours(events, _KEYS, _ORDER, "event_type").select("event_id", "above", "below", "below2")


@query(
    "q09_as_of_band",
    """WITH b AS (SELECT DISTINCT floor(s_acctbal / 2000) * 2000 AS x0 FROM supplier)
SELECT c_custkey, coalesce((SELECT max(x0) FROM b WHERE x0 - 0.5 <= c_acctbal), (SELECT min(x0) FROM b)) AS band FROM customer""",
)
def as_of_band(spark, root):
    starts = table(spark, root, "supplier").select((F.floor(F.col("s_acctbal") / 2000) * 2000).cast("double").alias("x0")).distinct().agg(F.array_sort(F.collect_list("x0")).alias("starts"))
    customer = table(spark, root, "customer").select("c_custkey", "c_acctbal").crossJoin(F.broadcast(starts))  # one row: a header's columns
    return customer.select("c_custkey", tables.as_of_band(F.col("c_acctbal"), F.lit(0.5), F.col("starts")).alias("band"))


@query(
    "q10_nearest_column",
    """WITH b AS (SELECT DISTINCT floor(s_acctbal / 1500) * 1500 + 700 AS c FROM supplier), r AS (SELECT c_custkey, c, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c - c_acctbal), c) AS n FROM customer, b)
SELECT c_custkey, c AS center FROM r WHERE n = 1""",
)
def nearest_column(spark, root):
    centers = table(spark, root, "supplier").select((F.floor(F.col("s_acctbal") / 1500) * 1500 + 700).cast("double").alias("c")).distinct().agg(F.array_sort(F.collect_list("c")).alias("centers"))
    customer = table(spark, root, "customer").select("c_custkey", "c_acctbal").crossJoin(F.broadcast(centers))  # one row, as above
    return customer.select("c_custkey", tables.nearest_center(F.col("c_acctbal"), F.col("centers")).alias("center"))


@query(
    "q11_pivot_cells",
    """WITH c AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'outOfRange' WHEN 'N' THEN 'inRange' ELSE 'result' END AS role, l_linenumber, l_partkey, CAST(l_partkey AS VARCHAR) AS str FROM lineitem),
p AS (SELECT l_orderkey, string_agg(str, ' ' ORDER BY l_linenumber, l_partkey) FILTER (WHERE role = 'outOfRange') AS o, string_agg(str, ' ' ORDER BY l_linenumber, l_partkey) FILTER (WHERE role = 'inRange') AS i,
  string_agg(str, ' ' ORDER BY l_linenumber, l_partkey) FILTER (WHERE role = 'result') AS r FROM c GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(o, i, r) AS value, o IS NOT NULL AS out_of_range FROM p""",
)
def pivot_cells(spark, root):
    role = F.when(F.col("l_returnflag") == "A", "outOfRange").when(F.col("l_returnflag") == "N", "inRange").otherwise("result")
    cells = table(spark, root, "lineitem").select("l_orderkey", role.alias("role"), F.struct("l_linenumber", "l_partkey").alias("place"), F.col("l_partkey").cast("string").alias("str"))
    found = tables.pivot_cells(cells, ["l_orderkey"], ["outOfRange", "inRange", "result"], "place")
    return found.select("l_orderkey", tables.value_of(F.col("outOfRange"), F.col("inRange"), F.col("result")).alias("value"), F.col("outOfRange").isNotNull().alias("out_of_range"))


@query(
    "q12_line_clusters",
    """WITH RECURSIVE o AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events),
f AS (SELECT user_id, k, y AS mean, 1 AS n, 0 AS line FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, CASE WHEN abs(o.y - f.mean) <= 0.4 THEN (f.mean * f.n + o.y) / (f.n + 1) ELSE o.y END, CASE WHEN abs(o.y - f.mean) <= 0.4 THEN f.n + 1 ELSE 1 END, CASE WHEN abs(o.y - f.mean) <= 0.4 THEN f.line ELSE f.line + 1 END
  FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, line, count(*) AS n FROM f GROUP BY ALL""",
)
def line_clusters(spark, root):
    events = table(spark, root, "events").select("user_id", "event_id", "value")
    return layout.group_lines(events, ["user_id"], "value", "event_id", F.lit(0.4))


@query("q13_upper_median", "SELECT p_brand, list_sort(list(p_retailprice))[len(list(p_retailprice)) // 2 + 1] AS median FROM part GROUP BY p_brand")
def upper_median(spark, root):
    return table(spark, root, "part").groupBy("p_brand").agg(layout.upper_median(F.collect_list("p_retailprice")).alias("median"))


@query("q14_page_text", "SELECT l_orderkey, string_agg(l_shipmode_text, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS text FROM (SELECT *, l_partkey || '  ' || l_returnflag AS l_shipmode_text FROM lineitem) GROUP BY l_orderkey")
def page_text(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat("l_partkey", F.lit("  "), "l_returnflag").alias("line"))
    return layout.joined_text(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "line"], "line")


@query(
    "q15_pick_template",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'licensed' WHEN lang = 'fr' THEN 'french' WHEN source LIKE 'src1%' THEN 'first' ELSE 'generic' END AS template FROM documents""",
)
def pick_template(spark, root):
    scores = [
        ("licensed", F.when(F.contains(F.lower("text"), F.lit("license")), 10).otherwise(0)),
        ("french", F.when(F.col("lang") == "fr", 5).otherwise(0)),
        ("first", F.when(F.col("source").startswith("src1"), 5).otherwise(0)),
        ("generic", F.lit(1)),
    ]
    return layout.pick_template(table(spark, root, "documents"), scores, "generic").select("doc_id", "template")


@query(
    "q16_keep_pages",
    """WITH p AS (SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS page, max(CASE WHEN event_type = 'purchase' AND value > 50 THEN 1 ELSE 0 END) AS kept, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, sum(CASE WHEN kept = 1 THEN n ELSE 0 END) AS n_lines, sum(1 - kept) AS skipped FROM p GROUP BY user_id""",
    big=("n_lines", "skipped"),
)
def keep_pages(spark, root):
    events = table(spark, root, "events").select("user_id", F.to_date(F.date_trunc("month", "ts")).alias("page"), "event_type", "value")
    kept, skipped = layout.keep_pages(events, (F.col("event_type") == "purchase") & (F.col("value") > 50), ["user_id"], "page")
    counted = kept.groupBy("user_id").agg(F.count("*").alias("n_lines"))
    return skipped.join(counted, "user_id", "left").select("user_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), "skipped")


@query("q17_looks_scanned", r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) < 40 AS scanned, CAST(length(regexp_replace(text, '\s', '', 'g')) AS INTEGER) AS chars FROM documents")
def looks_scanned(spark, root):
    chars = layout.readable_chars(F.col("text"))
    return table(spark, root, "documents").select("doc_id", layout.looks_scanned(chars, F.lit(1)).alias("scanned"), chars.alias("chars"))


@query(
    "q18_text_items",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, line, len(regexp_extract_all(line, '\S+(?: \S+)*')) AS k FROM l)
SELECT doc_id, count(*) AS n_lines, sum(k) AS n_items, sum(CASE WHEN k = 1 THEN length(line) ELSE 0 END) AS chars FROM c GROUP BY doc_id""",
    big=("n_items", "chars"),
)
def text_items(spark, root):
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("report_id"), "text")
    items = layout.text_to_items(docs).groupBy("report_id").agg(F.count("*").alias("n_items"), F.sum(F.length("str")).alias("chars"))
    counts = docs.select("report_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    return counts.join(items, "report_id", "left").select(F.col("report_id").alias("doc_id"), "n_lines", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))


@query(
    "q19_boilerplate",
    r"""WITH l AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'Page ' || o_orderkey || ' of 9' WHEN 1 THEN o_orderkey || ' of 12' WHEN 2 THEN 'Accession ' || o_orderkey WHEN 3 THEN 'DOB: 01/02/1990' WHEN 4 THEN 'CONFIDENTIAL copy' ELSE o_orderpriority END AS line FROM orders)
SELECT line, regexp_matches(line, '(?i)^page \d+( of \d+)?$|^\d+ of \d+$|confidential|^accession|^dob\s*:') AS skipped, count(*) AS n FROM l GROUP BY ALL""",
)
def boilerplate(spark, root):
    k = F.col("o_orderkey") % 6
    line = (
        F.when(k == 0, F.concat(F.lit("Page "), "o_orderkey", F.lit(" of 9"))).when(k == 1, F.concat("o_orderkey", F.lit(" of 12"))).when(k == 2, F.concat(F.lit("Accession "), "o_orderkey"))
        .when(k == 3, "DOB: 01/02/1990").when(k == 4, "CONFIDENTIAL copy").otherwise(F.col("o_orderpriority"))
    )
    return table(spark, root, "orders").select(line.alias("line")).withColumn("skipped", layout.is_boilerplate(F.col("line"))).groupBy("line", "skipped").agg(F.count("*").alias("n"))


@query(
    "q51_rate_limit",
    """SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY ALL""",
)
def rate_limit(spark, root):
    from assayline.streaming.limits import requests_per_window

    return requests_per_window(table(spark, root, "events").select("user_id", "ts"), "user_id", "ts", 60, 1)
