"""Queries on printed cells: values, ranges, units, names, stamps.

The tables hold no printed cells, so numbers, words and dates of ``lineitem``, ``part``, ``orders`` and ``events`` are
written out in the forms that reports use, then read back by the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.functions import names, stamps, units, values
from assayline.operators import rows
from assayline.plans.matching import query
from assayline.session import table

_CELL = """CASE l_orderkey % 8 WHEN 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN 1 THEN '< ' || CAST(l_quantity AS INTEGER) || '.5' WHEN 2 THEN '>OR= ' || CAST(l_quantity AS INTEGER)
WHEN 3 THEN '1 : ' || CAST(l_quantity AS INTEGER) WHEN 4 THEN 'NONE  SEEN' WHEN 5 THEN '-5' WHEN 6 THEN '1,234' ELSE ' Positive ' END"""


def _cells(spark, root):
    k, q = F.col("l_orderkey") % 8, F.col("l_quantity").cast("int").cast("string")
    cell = (
        F.when(k == 0, q).when(k == 1, F.concat(F.lit("< "), q, F.lit(".5"))).when(k == 2, F.concat(F.lit(">OR= "), q)).when(k == 3, F.concat(F.lit("1 : "), q))
        .when(k == 4, "NONE  SEEN").when(k == 5, "-5").when(k == 6, "1,234").otherwise(" Positive ")
    )
    return table(spark, root, "lineitem").select("l_orderkey", "l_quantity", cell.alias("cell"))


@query(
    "q20_parse_cell",
    f"""WITH c AS (SELECT {_CELL} AS cell FROM lineitem), s AS (SELECT cell, trim(regexp_replace(cell, '\\s+', ' ', 'g')) AS s FROM c),
p AS (SELECT cell, s, regexp_extract(s, '^1\\s*:\\s*(\\d+)$', 1) AS titer, regexp_extract(s, '(?i)^(<\\s*or\\s*=|>\\s*or\\s*=|<=|>=|<|>)', 1) AS cmp,
  TRY_CAST(CASE WHEN regexp_matches(regexp_replace(s, '(?i)^(<\\s*or\\s*=|>\\s*or\\s*=|<=|>=|<|>)\\s*', ''), '^(\\d+(\\.\\d+)?|\\.\\d+)$') THEN regexp_replace(s, '(?i)^(<\\s*or\\s*=|>\\s*or\\s*=|<=|>=|<|>)\\s*', '') END AS DOUBLE) AS n FROM s)
SELECT cell, CASE WHEN titer <> '' THEN 'titer' WHEN n IS NOT NULL THEN 'quantity' WHEN cmp = '' AND lower(s) IN ('none seen', 'positive') THEN 'qualitative' END AS kind,
  CASE WHEN titer = '' THEN n END AS value, CASE WHEN n IS NOT NULL AND titer = '' AND cmp <> '' THEN CASE WHEN lower(cmp) = '<' THEN '<' ELSE '>=' END END AS comparator,
  CASE WHEN titer <> '' THEN '1:' || CAST(titer AS INTEGER) WHEN lower(s) = 'none seen' THEN 'None seen' WHEN lower(s) = 'positive' THEN 'Positive' END AS text, count(*) AS n FROM p GROUP BY ALL""",
)
def parse_cell(spark, root):
    cells = _cells(spark, root).groupBy("cell").agg(F.count("*").alias("n"))  # each printed form is parsed once
    return cells.withColumn("p", values.parse_cell(F.col("cell"))).select("cell", "p.kind", "p.value", "p.comparator", "p.text", "n")


@query(
    "q21_split_range",
    """WITH r AS (SELECT l_orderkey % 5 AS k, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT CASE k WHEN 0 THEN q || '-' || (q + 10) || ' mg/dL' WHEN 1 THEN '< OR = ' || q || ' ratio' WHEN 2 THEN '(' || q || ' to ' || (q + 5) || ')' WHEN 3 THEN '>' || q ELSE 'mg/dL (calc)' END AS cell,
  CASE k WHEN 0 THEN q WHEN 2 THEN q WHEN 3 THEN q END::DOUBLE AS low, CASE k WHEN 0 THEN q + 10 WHEN 1 THEN q WHEN 2 THEN q + 5 END::DOUBLE AS high, CASE k WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'ratio' WHEN 4 THEN 'mg/dL (calc)' END AS unit, count(*) AS n FROM r GROUP BY ALL""",
)
def split_range(spark, root):
    k, q = F.col("l_orderkey") % 5, F.col("l_quantity").cast("int")
    cell = (
        F.when(k == 0, F.concat(q, F.lit("-"), q + 10, F.lit(" mg/dL"))).when(k == 1, F.concat(F.lit("< OR = "), q, F.lit(" ratio"))).when(k == 2, F.concat(F.lit("("), q, F.lit(" to "), q + 5, F.lit(")")))
        .when(k == 3, F.concat(F.lit(">"), q)).otherwise("mg/dL (calc)")
    )
    cells = table(spark, root, "lineitem").groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    return cells.withColumn("s", values.split_range_cell(F.col("cell"))).select("cell", "s.low", "s.high", "s.unit", "n")


@query(
    "q22_split_value",
    """WITH r AS (SELECT l_orderkey % 4 AS k, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT CASE k WHEN 0 THEN q || ' mg/dL H' WHEN 1 THEN '< ' || q || ' High' WHEN 2 THEN 'not detected' ELSE q || '.' || q || ' (L) % by wt' END AS cell,
  CASE k WHEN 0 THEN CAST(q AS VARCHAR) WHEN 1 THEN '< ' || q WHEN 2 THEN 'not detected' ELSE q || '.' || q END AS value, CASE k WHEN 0 THEN 'mg/dL' WHEN 3 THEN '% by wt' END AS unit,
  CASE k WHEN 0 THEN 'H' WHEN 1 THEN 'High' WHEN 3 THEN '(L)' END AS flag, CASE WHEN k = 2 THEN 'qualitative' ELSE 'quantity' END AS kind, count(*) AS n FROM r GROUP BY ALL""",
)
def split_value(spark, root):
    k, q = F.col("l_orderkey") % 4, F.col("l_quantity").cast("int")
    cell = F.when(k == 0, F.concat(q, F.lit(" mg/dL H"))).when(k == 1, F.concat(F.lit("< "), q, F.lit(" High"))).when(k == 2, "not detected").otherwise(F.concat(q, F.lit("."), q, F.lit(" (L) % by wt")))
    cells = table(spark, root, "lineitem").groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    return cells.withColumn("s", values.split_value_cell(F.col("cell"))).select("cell", "s.value", "s.unit", "s.flag", F.col("s.cell.kind").alias("kind"), "n")


# printed unit, then UCUM, one pair for each remainder of l_partkey
_UNITS = (("mcg/dL", "ug/dL"), ("MG/DL", "mg/dL"), ("x10E3/uL", "10*3/uL"), ("10^6 /uL", "10*6/uL"), ("m/uL", None), ("M/uL", "10*6/uL"), ("mL/min/1.73 m2", "mL/min/{1.73_m2}"), ("mg/dL (calc)", "mg/dL"), ("furlong", None), ("µIU/mL", "u[IU]/mL"), ("mL/min/1.73m²", "mL/min/{1.73_m2}"), ("ｍｇ／ｄＬ", "mg/dL"))


@query(
    "q23_units",
    f"""WITH u(k, printed, ucum) AS (VALUES {", ".join(f"({k}, '{p}', {'NULL' if u is None else repr(u)})" for k, (p, u) in enumerate(_UNITS))})
SELECT printed, ucum, count(*) AS n FROM lineitem JOIN u ON u.k = l_partkey % {len(_UNITS)} GROUP BY ALL""",
)
def unit_codes(spark, root):
    printed = F.element_at(F.array(*(F.lit(p) for p, _ in _UNITS)), (F.col("l_partkey") % len(_UNITS) + 1).cast("int"))
    counted = table(spark, root, "lineitem").groupBy(printed.alias("printed")).agg(F.count("*").alias("n"))
    return counted.select("printed", units.printed_to_ucum(F.col("printed")).alias("ucum"), "n")


#: Six significant digits of the exact binary value: all its digits as a decimal, rounded at the place its size gives.
_SIX = "CAST(round(CAST(format('{:.30f}', v) AS DECIMAL(38, 30)), {places}) AS DOUBLE)"


@query(
    "q24_conversion",
    f"""WITH r AS (SELECT l_orderkey, l_partkey, CASE l_partkey % 4 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'mg/L' WHEN 2 THEN NULL ELSE 'furlong' END AS unit, l_extendedprice AS q, l_extendedprice * 0.001 AS v FROM lineitem),
c AS (SELECT *, CASE l_partkey % 4 WHEN 3 THEN NULL WHEN 1 THEN CASE WHEN v < 1 THEN {_SIX.replace("{places}", "6")} WHEN v < 10 THEN {_SIX.replace("{places}", "5")} WHEN v < 100 THEN {_SIX.replace("{places}", "4")} ELSE {_SIX.replace("{places}", "3")} END ELSE q END AS value FROM r)
SELECT l_orderkey, l_partkey, unit, value, coalesce(l_partkey % 4 = 2, FALSE) AS missing, l_partkey % 4 = 3 AS mismatch, value BETWEEN 20 AND 40000 AS plausible, count(*) AS n FROM c GROUP BY ALL""",
)
def conversion(spark, root):
    """Units are resolved once for each printed form; only converted values go to the rounding worker."""
    k = F.col("l_partkey") % 4
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", F.when(k == 0, "mg/dL").when(k == 1, "mg/L").when(k == 3, "furlong").alias("unit"), F.col("l_extendedprice").alias("q"))
    printed = lines.select(F.col("unit").alias("printed")).distinct()
    found = units.resolve_unit(F.col("printed"), F.lit("mg/dL"), F.lit("quantity"), F.create_map(F.lit("mg/L"), F.lit(0.001)))
    resolved = printed.withColumn("u", found)
    # four units at most: by shuffle, each would bring all its lines into one task
    joined = lines.join(F.broadcast(resolved), F.col("unit").eqNullSafe(F.col("printed")))
    both = joined.withColumn("v", units.apply_factor(F.col("q"), F.col("u.factor")))
    graded = both.select("l_orderkey", "l_partkey", "unit", F.when(F.col("u.ok"), F.col("v")).alias("value"), F.col("u.missing").alias("missing"), (~F.col("u.ok")).alias("mismatch"))
    plausible = F.when(~F.col("mismatch"), units.is_plausible(F.col("value"), F.lit(20.0), F.lit(40000.0)))
    return graded.withColumn("plausible", plausible).groupBy("l_orderkey", "l_partkey", "unit", "value", "missing", "mismatch", "plausible").agg(F.count("*").alias("n"))


@query("q25_qualitative_case", "SELECT p_name, upper(p_name[1]) || lower(p_name[2:]) AS cased, count(*) AS n FROM part GROUP BY ALL")
def qualitative_case(spark, root):
    return table(spark, root, "part").select("p_name", values.qualitative_case(F.upper("p_name")).alias("cased")).groupBy("p_name", "cased").agg(F.count("*").alias("n"))


@query(
    "q26_names",
    """SELECT p_partkey, lower(p_name) || ',' || lower(p_brand) || '/' || lower(p_type) AS name, p_name || ', ' || p_brand AS cleaned FROM part""",
)
def clean_names(spark, root):
    printed = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ,  "), "p_brand", F.lit(" / "), "p_type", F.lit(" "))
    starred = F.concat("p_name", F.lit(",  "), "p_brand", F.when(F.col("p_partkey") % 2 == 0, " *†").otherwise(" (calculated) "))
    return table(spark, root, "part").select("p_partkey", names.normalize_name(printed).alias("name"), names.clean_name(starred).alias("cleaned"))


@query(
    "q27_panel_key",
    """WITH p AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'URINALYSIS, COMPLETE' WHEN 1 THEN '24 hour urine panel' WHEN 2 THEN 'UA dipstick' WHEN 3 THEN 'LIPID PANEL' END AS panel FROM orders)
SELECT panel, CASE panel WHEN 'URINALYSIS, COMPLETE' THEN 'urinalysis' WHEN '24 hour urine panel' THEN '24h urine' WHEN 'UA dipstick' THEN 'urinalysis' END AS key, count(*) AS n FROM p GROUP BY ALL""",
)
def panel_key(spark, root):
    k = F.col("o_orderkey") % 5
    panel = F.when(k == 0, "URINALYSIS, COMPLETE").when(k == 1, "24 hour urine panel").when(k == 2, "UA dipstick").when(k == 3, "LIPID PANEL")
    return table(spark, root, "orders").select(panel.alias("panel")).withColumn("key", names.panel_key(F.col("panel"))).groupBy("panel", "key").agg(F.count("*").alias("n"))


@query(
    "q28_single_note",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS k, max(CASE WHEN event_type = 'error' THEN value END) AS v FROM events GROUP BY ALL)
SELECT user_id, day, k AS n_notes, CASE WHEN k = 1 THEN v END AS high FROM d""",
)
def single_note(spark, root):
    """A range from the notes counts only where exactly one note has one."""
    note = F.when(F.col("event_type") == "error", F.col("value"))
    days = table(spark, root, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(note).alias("n_notes"), F.max(note).alias("v"))
    return days.select("user_id", "day", "n_notes", F.when(F.col("n_notes") == 1, F.col("v")).alias("high"))


@query(
    "q29_stamps",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate + INTERVAL 18 HOUR + INTERVAL 40 MINUTE WHEN 1 THEN o_orderdate + INTERVAL 15 HOUR + INTERVAL 5 MINUTE WHEN 2 THEN o_orderdate + INTERVAL 8 HOUR ELSE CASE WHEN year(o_orderdate) < 2000 THEN o_orderdate + INTERVAL 100 YEAR ELSE o_orderdate END END AS at,
  o_orderkey % 4 <> 3 AS time_found FROM orders""",
)
def read_stamps(spark, root):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.concat(F.lit("Collected: "), F.date_format(d, "MM/dd/yyyy"), F.lit(" 01:40 PM EST")))
        .when(k == 1, F.concat(F.lit("Collection Date/Time: "), F.date_format(d, "yyyy-MM-dd"), F.lit(" / 08:05 PDT")))
        .when(k == 2, F.concat(F.lit("Date collected "), F.date_format(d, "MMM d, yyyy"), F.lit(" at 0800 UTC")))
        .otherwise(F.concat(F.lit("Drawn "), F.date_format(d, "M/d/yy")))
    )
    return table(spark, root, "orders").select("o_orderkey", stamps.parse_stamp(text, F.lit("UTC")).alias("s")).select("o_orderkey", "s.at", "s.time_found")


@query(
    "q30_zones",
    """SELECT event_id, ts + INTERVAL 5 HOUR AS fixed, timezone('UTC', timezone('America/New_York', ts)) AS named FROM events""",
)
def zones(spark, root):
    zone = F.lit("UTC")  # in the hour that daylight saving time skips, both move the wall clock forward
    return table(spark, root, "events").select("event_id", stamps.to_utc(F.col("ts"), F.lit("EST"), zone).alias("fixed"), stamps.to_utc(F.col("ts"), F.lit("ET"), zone).alias("named"))


@query(
    "q31_instants",
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS nbf, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS local_date FROM events""",
)
def instants(spark, root):
    ts = F.col("ts").cast("timestamp")  # the session's zone is UTC
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/Los_Angeles"), F.col("ts")))
    return table(spark, root, "events").select("event_id", F.unix_seconds(ts).alias("nbf"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), local.alias("local_date"))


@query(
    "q32_agreed_fields",
    """WITH c AS (SELECT c_custkey // 3 AS k, c_custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'NATION_' || c_nationkey % 2 END AS nation FROM customer)
SELECT k AS key, arg_min(segment, c_custkey) AS segment, count(DISTINCT lower(segment)) > 1 AS segment_conflict, arg_min(nation, c_custkey) FILTER (WHERE trim(nation) <> '') AS nation, count(DISTINCT CASE WHEN trim(nation) <> '' THEN lower(nation) END) > 1 AS nation_conflict FROM c GROUP BY k""",
)
def agreed_fields(spark, root):
    nation = F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey") % 2))
    sources = table(spark, root, "customer").select(F.floor(F.col("c_custkey") / 3).cast("long").alias("key"), "c_custkey", F.col("c_mktsegment").alias("segment"), nation.alias("nation"))
    return rows.agreed(sources, ["key"], "c_custkey", ["segment", "nation"])
