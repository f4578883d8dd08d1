"""Queries on the dictionary: tiers, fuzzy keys, search, constraints, frozen labels, comparisons.

Binding to the star schema: ``part`` is the dictionary (code p_partkey, vendor p_brand, panel p_type, name p_name),
``lineitem`` the results (code l_partkey % 140, value l_extendedprice), (o_custkey, year of l_shipdate) a draw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.names import fuzzy_key
from assayline.operators import checks, dictionary, rows
from assayline.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None, big: tuple[str, ...] = (), small: tuple[str, ...] = ()):
    """Register a query with its SQL; ``big`` and ``small`` name integer columns that DuckDB types wider or narrower."""

    def add(f):
        QUERIES[name] = f
        if sql:
            casts = [f"CAST({c} AS BIGINT) AS {c}" for c in big] + [f"CAST({c} AS INTEGER) AS {c}" for c in small]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
        return f

    return add


def _aliases(spark: SparkSession, root: str) -> DataFrame:
    """Vendor-wide and panel aliases of the parts, and generic ones for the first hundred."""
    part = table(spark, root, "part")
    vendor = part.select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("vendor"), F.lit(None).cast("string").alias("panel"), F.lower("p_name").alias("name"))
    panel = part.select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("panel"), F.lower("p_name").alias("name"))
    generic = part.where("p_partkey <= 30").select(F.col("p_partkey").alias("code"), F.lit("generic").alias("vendor"), F.lit(None).cast("string").alias("panel"), F.lower("p_name").alias("name"))
    return vendor.unionByName(panel).unionByName(generic)


_ALIASES = """
a AS (SELECT p_partkey AS code, p_brand AS vendor, CAST(NULL AS VARCHAR) AS panel, lower(p_name) AS name FROM part
  UNION ALL SELECT p_partkey, p_brand, p_type, lower(p_name) FROM part
  UNION ALL SELECT p_partkey, 'generic', NULL, lower(p_name) FROM part WHERE p_partkey <= 30)"""

_MATCHED = f"""
WITH {_ALIASES},
p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'Brand#none' ELSE p_brand END AS vendor, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS panel,
  CASE WHEN p_partkey % 11 = 0 THEN 'unknown ' || p_partkey ELSE lower(p_name) END AS name FROM part),
t1 AS (SELECT vendor, panel, name, count(DISTINCT code) AS n, min(code) AS c FROM a WHERE panel IS NOT NULL GROUP BY ALL),
t2 AS (SELECT vendor, name, count(DISTINCT code) AS n, min(code) AS c FROM a WHERE panel IS NULL GROUP BY ALL),
t3 AS (SELECT name, count(DISTINCT code) AS n, min(code) AS c FROM a WHERE panel IS NULL AND vendor = 'generic' GROUP BY ALL),
m AS (SELECT p.id, t1.n AS n1, t2.n AS n2, t3.n AS n3, t1.c AS c1, t2.c AS c2, t3.c AS c3 FROM p
  LEFT JOIN t1 ON t1.vendor = p.vendor AND t1.panel = p.panel AND t1.name = p.name
  LEFT JOIN t2 ON t2.vendor = p.vendor AND t2.name = p.name
  LEFT JOIN t3 ON t3.name = p.name),
r AS (SELECT id, coalesce(n1, n2, n3, 0) AS n, coalesce(c1, c2, c3) AS c,
  CASE WHEN coalesce(n1, n2, n3) IS NULL THEN 'none' WHEN coalesce(n1, n2, n3) > 1 THEN 'ambiguous' WHEN n1 IS NOT NULL THEN 'panel' WHEN n2 IS NOT NULL THEN 'vendor' ELSE 'generic' END AS via FROM m)
"""


def _probes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 7 == 0, "Brand#none").otherwise(F.col("p_brand")).alias("vendor"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("panel"),
        F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("unknown "), "p_partkey")).otherwise(F.lower("p_name")).alias("name"),
    )


@query("q01_match_tiers", _MATCHED + "SELECT id, via, CASE WHEN n = 1 THEN c END AS code, n FROM r")
def match_tiers(spark, root):
    return dictionary.match_tiers(_probes(spark, root), _aliases(spark, root)).select("id", "via", "code", "n")


@query(
    "q02_match_fuzzy",
    f"""WITH {_ALIASES},
k AS (SELECT *, regexp_replace(name, '[^a-z0-9%]', '', 'g') AS k FROM a),
s AS (SELECT panel, k, count(DISTINCT code) AS n, min(code) AS c FROM k WHERE panel IS NOT NULL GROUP BY ALL),
w AS (SELECT k, count(DISTINCT code) AS n, min(code) AS c FROM k WHERE panel IS NULL GROUP BY ALL),
p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS panel, upper(replace(p_name, ' ', '-.')) || CASE WHEN p_partkey % 5 = 0 THEN 'X' ELSE '' END AS name FROM part)
SELECT id, coalesce(s.n, w.n, 0) AS n, CASE WHEN coalesce(s.n, w.n) = 1 THEN coalesce(s.c, w.c) END AS code
FROM p LEFT JOIN s ON s.panel = p.panel AND s.k = regexp_replace(lower(p.name), '[^a-z0-9%]', '', 'g') LEFT JOIN w ON w.k = regexp_replace(lower(p.name), '[^a-z0-9%]', '', 'g')""",
)
def match_fuzzy(spark, root):
    decorated = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-."))), F.when(F.col("p_partkey") % 5 == 0, "X").otherwise(""))
    probes = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("panel"), decorated.alias("name"))
    return dictionary.match_fuzzy(probes, _aliases(spark, root), fuzzy_key).select("id", "n", "code")


@query(
    "q00_flagship",
    """WITH d AS (SELECT lower(p_name) AS name, p_brand AS vendor, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL),
m AS (SELECT p.p_partkey, p.p_retailprice, d.n FROM part p JOIN d ON d.name = lower(p.p_name) AND d.vendor = p.p_brand),
l AS (SELECT o_custkey, year(l_shipdate) AS y, l_partkey % 140 AS code, m.n AS hits, l_extendedprice BETWEEN 5 * p_retailprice AND 60 * p_retailprice AS plausible
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN m ON m.p_partkey = l_partkey),
c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, y, code) > 1 AS copies FROM l),
g AS (SELECT y, CASE WHEN hits > 1 OR NOT plausible OR copies THEN 'low' ELSE 'high' END AS confidence, o_custkey FROM c)
SELECT y AS draw_year, confidence, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_patients FROM g GROUP BY ALL""",
    small=("draw_year",),
)
def flagship(spark, root):
    """Results matched to the dictionary, graded for plausibility and duplicates, counted by draw year."""
    part = table(spark, root, "part")
    hits = part.groupBy(F.lower("p_name").alias("name"), F.col("p_brand").alias("vendor")).agg(F.countDistinct("p_partkey").alias("hits"))
    matched = part.join(hits, (F.lower("p_name") == F.col("name")) & (F.col("p_brand") == F.col("vendor"))).select("p_partkey", "p_retailprice", "hits")
    results = (
        table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate")
        .join(table(spark, root, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(matched, F.col("p_partkey") == F.col("l_partkey"))
        .select("o_custkey", F.year("l_shipdate").alias("draw_year"), (F.col("l_partkey") % 140).alias("code"), "hits", F.col("l_extendedprice").between(5 * F.col("p_retailprice"), 60 * F.col("p_retailprice")).alias("plausible"))
    )
    flagged = rows.flag_duplicates(results, ["o_custkey", "draw_year"], "code")
    issues = rows.issues_of(ambiguous_match=F.col("hits") > 1, implausible=~F.col("plausible"), duplicate=F.col("copies") > 1)
    graded = flagged.withColumn("confidence", rows.confidence_of(issues, F.lit(True), F.lit(0), F.lit(False)))
    return graded.groupBy("draw_year", "confidence").agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_patients"))


@query(
    "q03_duplicates",
    """SELECT l_orderkey % 100 AS bucket, count(*) AS n_rows, sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS n_duplicates FROM
(SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey, l_partkey % 140) AS c FROM lineitem) GROUP BY ALL""",
    big=("n_duplicates",),
)
def duplicates(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", (F.col("l_partkey") % 140).alias("code"))
    flagged = rows.flag_duplicates(lines, ["l_orderkey"], "code")
    return flagged.groupBy((F.col("l_orderkey") % 100).alias("bucket")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("copies") > 1).alias("n_duplicates"))


@query(
    "q04_draws",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN CAST(date_trunc('month', ts) AS TIMESTAMP) END AS stamp FROM events),
f AS (SELECT user_id, arg_min(stamp, event_id) FILTER (WHERE stamp IS NOT NULL) AS first FROM e GROUP BY user_id)
SELECT e.user_id AS user_id, coalesce(stamp, first) AS collected, count(*) AS n FROM e JOIN f ON f.user_id = e.user_id GROUP BY ALL""",
)
def draws(spark, root):
    month = F.when(F.col("event_type") == "signup", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    return rows.group_draws(table(spark, root, "events").select("user_id", "event_id", month.alias("stamp")), "user_id", "stamp", "event_id")


@query(
    "q33_search",
    """SELECT p_partkey AS code, round((CASE WHEN label = 'ring' THEN 100 WHEN starts_with(label, 'ring') THEN 50 WHEN contains(label, 'ring') THEN 25 ELSE 0 END)
+ (CASE WHEN contains(rest, 'ring') THEN 10 ELSE 0 END) - length(label) / 100, 6) AS score
FROM (SELECT p_partkey, lower(p_name) AS label, lower(p_brand || ' ' || p_type || ' ' || p_name) AS rest FROM part) WHERE contains(label || ' | ' || rest, 'ring') ORDER BY score DESC, code LIMIT 20""",
)
def search(spark, root):
    entries = table(spark, root, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("label"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("rest"))
    return dictionary.search(entries, "ring").select("code", "score")


_FROZEN = """
WITH f AS (SELECT p_partkey AS code, sha256('{"loinc":"' || p_partkey || '","display":"' || p_name || '","text":"' || p_brand || '"}') AS hash FROM part),
n AS (SELECT p_partkey AS code, sha256('{"loinc":"' || p_partkey || '","display":"' || p_name || '","text":"' || CASE WHEN p_partkey % 10 = 0 THEN 'changed' ELSE p_brand END || '"}') AS hash FROM part WHERE p_partkey % 13 <> 0)
SELECT f.code, CASE WHEN n.hash IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM f LEFT JOIN n ON n.code = f.code WHERE n.hash IS NULL OR n.hash <> f.hash"""


@query("q37_frozen_labels", _FROZEN)
def frozen_labels(spark, root):
    from assayline.functions.codec import label_hash

    part = table(spark, root, "part")
    code = F.col("p_partkey").cast("string")
    released = part.select(F.col("p_partkey").alias("code"), label_hash(code, F.col("p_name"), F.col("p_brand")).alias("hash"))
    text = F.when(F.col("p_partkey") % 10 == 0, "changed").otherwise(F.col("p_brand"))
    current = part.where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("code"), label_hash(code, F.col("p_name"), text).alias("hash"))
    return dictionary.frozen_labels(released, current)


@query(
    "q38_manifest_diff",
    """WITH e AS (SELECT 'nation/' || n_nationkey || '.json' AS path, sha256(n_name) AS hash FROM nation),
a AS (SELECT 'nation/' || n_nationkey || '.json' AS path, sha256(CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END) AS hash FROM nation WHERE n_nationkey % 5 <> 0)
SELECT e.path, CASE WHEN a.hash IS NULL THEN 'missing' ELSE 'different' END AS problem FROM e LEFT JOIN a ON a.path = e.path WHERE a.hash IS DISTINCT FROM e.hash ORDER BY e.path LIMIT 20""",
)
def manifest_diff(spark, root):
    nation = table(spark, root, "nation")
    path = F.concat(F.lit("nation/"), "n_nationkey", F.lit(".json")).alias("path")
    expected = nation.select(path, F.sha2("n_name", 256).alias("hash"))
    actual = nation.where("n_nationkey % 5 <> 0").select(path, F.sha2(F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")).otherwise(F.col("n_name")), 256).alias("hash"))
    return checks.manifest_diff(expected, actual)


@query(
    "q38b_same_rows",
    """SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 30 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10)) AS only_a,
(SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 EXCEPT ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 30)) AS only_b""",
)
def same_rows(spark, root):
    lines = table(spark, root, "lineitem")
    return checks.same_rows(lines.where("l_quantity < 30").select("l_orderkey", "l_linenumber"), lines.where("l_quantity > 10").select("l_orderkey", "l_linenumber"))


@query(
    "q39_multiset_match",
    """WITH e AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'A'),
a AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(e.k, a.k) AS supplier, sum(CASE WHEN e.k IS NOT NULL AND a.k IS NOT NULL THEN 1 ELSE 0 END) AS matched, sum(CASE WHEN a.k IS NULL THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN e.k IS NULL THEN 1 ELSE 0 END) AS unexpected
FROM e FULL JOIN a ON e.k = a.k AND e.n = a.n GROUP BY 1""",
    big=("matched", "missing", "unexpected"),
)
def multiset_match(spark, root):
    lines = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_orderkey", "l_linenumber", "l_returnflag")
    return checks.multiset_match(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), ["supplier"], ["l_orderkey", "l_linenumber"])


@query(
    "q40_accuracy",
    """WITH s AS (SELECT count(*) AS expected, sum(CASE WHEN l_discount < 0.1 THEN 1 ELSE 0 END) AS mapped, sum(CASE WHEN l_discount < 0.1 AND l_tax < 0.08 THEN 1 ELSE 0 END) AS correct FROM lineitem)
SELECT expected, mapped, correct, round(100.0 * mapped / expected, 4) AS mapped_pct, round(100.0 * correct / mapped, 4) AS correct_pct, round(100.0 * mapped / expected, 4) >= 98 AND round(100.0 * correct / mapped, 4) >= 100 AS passed FROM s""",
    big=("mapped", "correct"),
)
def accuracy(spark, root):
    lines = table(spark, root, "lineitem")
    mapped, correct = F.col("l_discount") < 0.1, F.col("l_tax") < 0.08
    return checks.accuracy(lines.select(F.lit(1).alias("expected"), mapped.cast("int").alias("mapped"), (mapped & correct).cast("int").alias("correct")))


@query(
    "q41_violations",
    f"""WITH {_ALIASES},
e AS (SELECT p_partkey AS code FROM part UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT -1)
SELECT 'duplicate_code' AS rule, CAST(code AS VARCHAR) AS key, count(*) AS n FROM e GROUP BY code HAVING count(*) > 1
UNION ALL SELECT 'ambiguous_alias', vendor || '|' || coalesce(panel, '') || '|' || name, count(DISTINCT code) FROM a GROUP BY vendor, panel, name HAVING count(DISTINCT code) > 1
UNION ALL SELECT 'no_alias', CAST(code AS VARCHAR), 0 FROM e WHERE code NOT IN (SELECT code FROM a)""",
)
def violations(spark, root):
    codes = table(spark, root, "part").select(F.col("p_partkey").alias("code"))
    entries = codes.unionByName(codes.where("code % 50 = 0")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("code")))
    return dictionary.violations(entries, _aliases(spark, root))


@query(
    "q50_key_union",
    """WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'OTHER' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(a.k, b.k) AS id, a.v AS a, b.v AS b, a.v IS DISTINCT FROM b.v AS differs FROM a FULL JOIN b ON a.k = b.k""",
)
def key_union(spark, root):
    customer = table(spark, root, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    changed = customer.where("id % 5 <> 0").withColumn("v", F.when(F.col("id") % 4 == 0, "OTHER").otherwise(F.col("v")))
    return checks.key_union(customer.where("id % 3 <> 0"), changed, ["id"], "v")


@query(
    "q50b_concat",
    """WITH u AS (SELECT 1 AS file, n_nationkey AS page FROM nation UNION ALL SELECT 2, r_regionkey FROM region), c AS (SELECT file, count(*) AS pages FROM u GROUP BY file),
o AS (SELECT file, sum(pages) OVER (ORDER BY file) - pages AS before FROM c)
SELECT u.file AS file, u.page + before AS page FROM u JOIN o ON o.file = u.file""",
    big=("page",),
)
def concat_pages(spark, root):
    """Pages of several files, numbered through: each file starts after the pages of those before it."""
    from pyspark.sql import Window

    pages = table(spark, root, "nation").select(F.lit(1).alias("file"), F.col("n_nationkey").alias("page")).unionByName(table(spark, root, "region").select(F.lit(2).alias("file"), F.col("r_regionkey").alias("page")))
    counts = pages.groupBy("file").agg(F.count("*").alias("pages"))  # one row for each file of an upload
    offsets = counts.withColumn("before", F.sum("pages").over(Window.orderBy("file")) - F.col("pages"))
    return pages.join(offsets, "file").select("file", (F.col("page") + F.col("before")).alias("page"))
