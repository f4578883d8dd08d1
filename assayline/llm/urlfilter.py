"""URL filter: host and path rules first, then a path-template tree with labelled purity. DataFrame functions only.

Per host, a path becomes a sequence of segments with runs of digits written ``#``. Level by level, a branch is replaced
by the wildcard ``*`` when its parent has many narrow children (a variable segment), or when its rate of good labels
does not differ from its parent's by more than Z standard errors (statistically similar branches are merged). What is
left is the host's template; a template is rejected if its share of good labels, smoothed towards its host's and that
towards the corpus', is under MIN_PURITY. Paths may have any number of segments: those that all paths below a branch share
become wildcards in one step, so that there are as many steps as places where paths part.

Only aggregates per (host, template) are shuffled between levels, never pages. Defined cases: a null url or one without
``://`` has an empty host and path and goes through the method like any other host; a page without a label counts for
breadth only; several labels of one page count each; with no labels at all nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import ascii_lower, materialise, remove_folder, shared_folder

#: (verdict, rule): the rule's host up to the first slash, its path from there on.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
WIDE = 20
NARROW = 0.05
Z = 1.96
PRIOR = 10.0
MIN_PURITY = 0.5

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict), or null."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        same = (host == rule_host) | host.endswith("." + rule_host)
        fits.append(F.when(same & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def shape_of(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/", -1), lambda s: s != "")


def template_verdicts(located: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """(_host, _shape, _purity, _template): one row for each shape of each host.

    ``located`` has page_id, _host and _shape; ``labels`` has doc_id (the page's id), quality and toxic.
    """
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(F.count("*").alias("_lab"), F.sum(good).alias("_good"))
    nodes = (
        located.join(marks, F.col("page_id") == F.col("_label_id"), "left")
        .groupBy("_host", "_shape")
        .agg(F.count("*").alias("_n"), F.coalesce(F.sum("_lab"), F.lit(0)).alias("_lab"), F.coalesce(F.sum("_good"), F.lit(0)).alias("_good"))
        .withColumns({"_segs": F.col("_shape"), "_at": F.lit(0)})
    )
    nodes, last, level = materialise(nodes, "nodes", folder), "nodes", 0
    while nodes.where(F.size("_segs") > F.col("_at")).limit(1).count():
        nodes = materialise(_merge_level(_skip_shared(nodes)), f"level{level}", folder)
        remove_folder(nodes.sparkSession, f"{folder}/{last}")
        last, level = f"level{level}", level + 1
    totals = nodes.groupBy().agg(F.sum("_lab").alias("_all_lab"), F.sum("_good").alias("_all_good"))
    hosts = nodes.groupBy("_host").agg(F.sum("_lab").alias("_host_lab"), F.sum("_good").alias("_host_good"))
    leaves = nodes.groupBy("_host", "_segs").agg(F.sum("_lab").alias("_leaf_lab"), F.sum("_good").alias("_leaf_good"))
    overall = F.col("_all_good") / F.nullif("_all_lab", F.lit(0))
    of_host = (F.col("_host_good") + PRIOR * overall) / (F.col("_host_lab") + PRIOR)
    purity = (F.col("_leaf_good") + PRIOR * of_host) / (F.col("_leaf_lab") + PRIOR)
    judged = leaves.join(hosts, "_host").crossJoin(F.broadcast(totals)).select("_host", "_segs", purity.alias("_purity"))
    return nodes.join(judged, ["_host", "_segs"]).select("_host", "_shape", "_purity", F.concat(F.lit("/"), F.array_join("_segs", "/")).alias("_template"))


def _skip_shared(nodes: DataFrame) -> DataFrame:
    """Wildcards for the segments that all nodes below a prefix share."""
    prefix, rest = F.slice("_segs", F.lit(1), F.col("_at")), F.slice("_segs", F.col("_at") + 1, F.greatest(F.size("_segs"), F.lit(1)))
    below = nodes.where(F.size("_segs") > F.col("_at")).groupBy("_host", prefix.alias("_prefix")).agg(F.min(rest).alias("_lo"), F.max(rest).alias("_hi"))
    differ = F.array_position(F.zip_with("_lo", "_hi", lambda a, b: a.eqNullSafe(b)), False).cast("int")
    shared = below.select("_host", "_prefix", F.when(differ == 0, F.size("_lo")).otherwise(differ - 1).alias("_same"))
    going = F.col("_same").isNotNull() & (F.size("_segs") > F.col("_at"))
    after = F.slice("_segs", F.col("_at") + F.col("_same") + 1, F.greatest(F.size("_segs"), F.lit(1)))
    return (
        nodes.withColumn("_prefix", prefix)
        .join(shared, ["_host", "_prefix"], "left")
        .withColumn("_segs", F.when(going, F.concat("_prefix", F.array_repeat(F.lit("*"), F.col("_same")), after)).otherwise(F.col("_segs")))
        .withColumn("_at", F.when(F.col("_same").isNotNull(), F.col("_at") + F.col("_same")).otherwise(F.col("_at")))
        .drop("_prefix", "_same")
    )


def _merge_level(nodes: DataFrame) -> DataFrame:
    prefix, segment = F.slice("_segs", F.lit(1), F.col("_at")), F.get("_segs", F.col("_at"))
    children = nodes.where(F.size("_segs") > F.col("_at")).groupBy("_host", prefix.alias("_prefix"), segment.alias("_seg")).agg(F.sum("_n").alias("_n"), F.sum("_lab").alias("_lab"), F.sum("_good").alias("_good"))
    parents = children.groupBy("_host", "_prefix").agg(F.count("*").alias("_k"), F.sum("_n").alias("_pn"), F.sum("_lab").alias("_plab"), F.sum("_good").alias("_pgood"))
    rate = F.col("_pgood") / F.col("_plab")
    variable = (F.col("_k") > WIDE) & (F.col("_n") < NARROW * F.col("_pn"))
    similar = (F.col("_lab") == 0) | (F.abs(F.col("_good") / F.col("_lab") - rate) <= Z * F.sqrt(rate * (1 - rate) / F.col("_lab")))
    merged = children.join(parents, ["_host", "_prefix"]).where(variable | similar).select("_host", "_prefix", "_seg", F.lit(True).alias("_wild"))
    return (
        nodes.withColumns({"_prefix": prefix, "_seg": segment})
        .join(merged, ["_host", "_prefix", "_seg"], "left")
        .withColumn("_segs", F.when(F.col("_wild"), F.concat(F.col("_prefix"), F.array(F.lit("*")), F.slice("_segs", F.col("_at") + 2, F.greatest(F.size("_segs"), F.lit(1))))).otherwise(F.col("_segs")))
        .withColumn("_at", F.col("_at") + 1)
        .drop("_prefix", "_seg", "_wild")
    )


def filter_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    located = pages.select("page_id", host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path"))
    located = located.withColumn("_shape", shape_of(F.col("_path")))
    folder = shared_folder(pages.sparkSession)
    judged = materialise(template_verdicts(located, labels, folder), "judged", folder)
    matched = located.withColumn("_rule", rule_of(F.col("_host"), F.col("_path")))
    by_method = F.when(F.col("_purity") < MIN_PURITY, "block").otherwise("allow")
    return matched.join(judged, ["_host", "_shape"], "left").select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_method).alias("verdict"),
        F.col("_template").alias("template"),
        F.round("_purity", 6).alias("purity"),
    )


_LEVEL = """
c{k} AS (SELECT host, segs[1:{k}] AS prefix, segs[{k}+1] AS seg, sum(n) AS n, sum(lab) AS lab, sum(good) AS good FROM n{k} WHERE len(segs) > {k} GROUP BY ALL),
p{k} AS (SELECT host, prefix, count(*) AS k, sum(n) AS pn, sum(lab) AS plab, sum(good) AS pgood, sum(good) / nullif(sum(lab), 0) AS rate FROM c{k} GROUP BY ALL),
m{k} AS (SELECT host, prefix, seg FROM c{k} JOIN p{k} USING (host, prefix)
  WHERE (k > 20 AND n < 0.05 * pn) OR lab = 0 OR abs(good / lab - rate) <= 1.96 * sqrt(rate * (1 - rate) / lab)),
n{next} AS (SELECT a.host, a.shape, a.n, a.lab, a.good,
  CASE WHEN m.host IS NULL THEN a.segs ELSE list_concat(a.segs[1:{k}], ['*'], a.segs[{k}+2:]) END AS segs
  FROM n{k} a LEFT JOIN m{k} m ON m.host = a.host AND m.prefix = a.segs[1:{k}] AND m.seg = a.segs[{k}+1]),
"""

#: Written out for three levels, as paths in the tables have at most three segments. Segments that all paths below a branch
#: share need no rule of their own here: they are merged as similar to their parent in any case.
ORACLE = (
    r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
s AS (SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') AS shape FROM u),
l AS (SELECT doc_id, count(*) AS lab, sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
n0 AS (SELECT host, shape, shape AS segs, count(*) AS n, coalesce(sum(lab), 0) AS lab, coalesce(sum(good), 0) AS good FROM s LEFT JOIN l ON l.doc_id = s.page_id GROUP BY host, shape),
"""
    + "".join(_LEVEL.format(k=k, next=k + 1) for k in range(3))
    + r"""
t AS (SELECT sum(good) / nullif(sum(lab), 0) AS overall FROM n3),
h AS (SELECT host, (sum(good) + 10.0 * any_value(overall)) / (sum(lab) + 10.0) AS of_host FROM n3, t GROUP BY host),
f AS (SELECT host, segs, (sum(good) + 10.0 * any_value(of_host)) / (sum(lab) + 10.0) AS purity FROM n3 JOIN h USING (host) GROUP BY host, segs),
j AS (SELECT n3.host, n3.shape, purity, '/' || array_to_string(n3.segs, '/') AS template FROM n3 JOIN f USING (host, segs)),
r AS (SELECT s.*, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM s)
SELECT r.page_id, r.host, r.path, r.rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN purity < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  j.template, round(j.purity, 6) AS purity
FROM r LEFT JOIN j ON j.host = r.host AND j.shape = r.shape
"""
)
