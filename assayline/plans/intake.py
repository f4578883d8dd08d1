"""Queries on files and on what several files bring together.

Bindings: an order is a file, of a kind that goes by its key; a customer is a person whose orders are files of results.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from assayline.operators import merge, review
from assayline.plans.matching import query
from assayline.session import table
from assayline.sources import dictionaries, files


def _written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, content: a file of each of ten kinds by the order's key."""
    for frame in frames:
        made = []
        for key in frame["o_orderkey"]:
            kind = key % 10
            if kind in (1, 4, 6, 8):
                members = {
                    1: [(f"page{n}.txt", f"page {n} of {key}") for n in range(12, 0, -1)] + [("meta.json", "{}"), ("__MACOSX/page0.txt", "x"), ("a.pdf", "%PDF-1"), ("folder/", "")],
                    4: [("10.pdf", "%PDF-b"), ("9.pdf", "%PDF-a"), ("notes.html", "<p>")], 6: [("only.json", "{}")], 8: [("b.png", "\x89PNG\r\n\x1a\n"), ("a.png", "\x89PNG\r\n\x1a\n")],
                }[kind]
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w") as archive:
                    for name, text in members:
                        archive.writestr(name, text.encode("latin-1"))
                content = packed.getvalue()
            else:
                content = {0: f"results of {key}".encode(), 2: b"%PDF-2", 3: b"%PDF-3", 5: b"\xff\xd8\xff\xe0", 7: b"\x00\x01", 9: b"PK\x03\x04 broken"}[kind]
            made.append((f"file{key}", content))
        yield pd.DataFrame(made, columns=["path", "content"])


_LAYER = "a text layer that holds well over forty characters on this page of the file"


@query(
    "q61_routed_pages",
    f"""WITH k AS (SELECT o_orderkey, 'file' || o_orderkey AS path, o_orderkey % 10 AS kind, o_orderkey // 10 % 2 AS seen FROM orders)
SELECT path, 1 AS page, -1 AS entry, 'text' AS method, 'results of ' || o_orderkey AS text, NULL AS error FROM k WHERE kind = 0
UNION ALL SELECT path, n, n + 1, 'text', 'page ' || n || ' of ' || o_orderkey, NULL FROM k, range(1, 13) AS r(n) WHERE kind = 1
UNION ALL SELECT path, n, -1, 'text', '{_LAYER} ' || n, NULL FROM k, range(1, 3) AS r(n) WHERE kind = 2
UNION ALL SELECT path, n, -1, 'ocr', 'seen ' || n, NULL FROM k, range(1, 4) AS r(n) WHERE kind = 3 AND seen = 1
UNION ALL SELECT path, n, CASE WHEN n <= 2 THEN 0 ELSE 1 END, CASE WHEN seen = 1 THEN 'ocr' ELSE 'text' END, CASE WHEN n > 2 AND seen = 1 THEN 'seen ' || n - 2 ELSE '{_LAYER} ' || CASE WHEN n <= 2 THEN n ELSE n - 2 END END, NULL
  FROM k, range(1, 6) AS r(n) WHERE kind = 4 AND n <= CASE WHEN seen = 1 THEN 5 ELSE 4 END
UNION ALL SELECT path, 1, -1, 'ocr', 'seen 1', NULL FROM k WHERE kind = 5 AND seen = 1
UNION ALL SELECT path, n, n - 1, 'ocr', 'seen 1', NULL FROM k, range(1, 3) AS r(n) WHERE kind = 8 AND seen = 1
UNION ALL SELECT path, NULL, NULL, NULL, NULL, CASE kind WHEN 3 THEN 'scanned' WHEN 6 THEN 'no_pages' WHEN 7 THEN 'unsupported' WHEN 9 THEN 'unreadable' ELSE 'photo' END FROM k
  WHERE kind IN (6, 7, 9) OR kind IN (3, 5, 8) AND seen = 0""",
    small=("page", "entry"),
)
def routed_pages(spark, root):
    """The pages of files of ten kinds, archives among them, or the error that keeps a file from being read."""
    orders = table(spark, root, "orders").select("o_orderkey")
    found = orders.mapInPandas(_written, "path string, content binary").select("path", "content", files.sniff(F.col("content")).alias("kind"))
    kind, seen = F.col("o_orderkey") % 10, F.floor(F.col("o_orderkey") / 10) % 2 == 1
    entry = F.explode(F.when(kind.isin(4, 8), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1)))).alias("entry")
    each = orders.select(F.concat(F.lit("file"), "o_orderkey").alias("path"), kind.alias("kind"), seen.alias("seen"), entry)
    # kind 2 has a text layer, kind 3 an empty one; the second PDF of kind 4 has a text layer where nothing was recognised
    scan = (F.col("kind") == 3) | ((F.col("kind") == 4) & (F.col("entry") == 1) & F.col("seen"))
    pages = each.where("kind in (2, 3, 4)").withColumn("page", F.explode(F.sequence(F.lit(1), F.when(scan, 3).otherwise(2))))
    layer = pages.select("path", "entry", "page", F.when(scan, F.lit(" ")).otherwise(F.concat(F.lit(f"{_LAYER} "), "page")).alias("text"))
    read = each.where("seen and kind in (3, 4, 5, 8)").withColumn("page", F.explode(F.sequence(F.lit(1), F.when(scan, 3).otherwise(1))))
    return files.route_files(found, layer, read.select("path", "entry", "page", F.concat(F.lit("seen "), "page").alias("text")))


def _results(spark, root):
    """Every line of an order as a result of a file (the order) of a person (the customer), collected in its year."""
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax")
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    mismatch, no_range = F.col("l_quantity") < 3, F.col("l_tax") == 0
    issues = F.array_compact(F.array(F.when(mismatch, F.lit("unit_mismatch")), F.when(no_range, F.lit("no_range"))))
    confidence = F.when(mismatch, "low").when(no_range, "medium").otherwise("high")
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.withColumn("row", k).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    collected = F.date_trunc("year", "o_orderdate").cast("timestamp_ntz")
    code = F.nullif(F.col("l_partkey") % 30, F.lit(0).cast("long"))
    kind = F.when(F.col("l_partkey") % 3 == 0, "quantity").when(F.col("l_partkey") % 3 == 1, "titer").otherwise("qualitative")
    return joined.select(
        F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("file"), "row", collected.alias("collected"), code.alias("code"), F.concat(F.lit("Test "), code.cast("string")).alias("text"), issues.alias("issues"), confidence.alias("confidence"),
        kind.alias("value_type"), F.col("l_quantity").cast("double").alias("value"), F.when(kind == "titer", F.lit("1:40")).otherwise(F.lit("Negative")).alias("words"),
    )


_TRAVELLING = ("text", "value_type", "value", "words")


def _merged(spark, root, *needed):
    """The review after every fourth file has come in again, twice, and has replaced what it brought first. Of the columns
    that only travel along, the ``needed`` ones: no plan prunes what is stored."""
    every = _results(spark, root).drop(*(c for c in _TRAVELLING if c not in needed)).persist()  # a store would be a table; each merge reads it several times
    again = every.where("file % 4 = 0")
    first = every.where("file % 4 <> 0").unionByName(again.where("row <= 2").withColumn("code", F.col("code") + 1).withColumn("row", F.col("row") + 50))
    stored, view = (part.persist() for part in merge.merge(first, merge.reviewed(first), again))
    return merge.merge(stored, view, again)[1]


_MERGED = """WITH r AS (SELECT o_custkey AS person, o_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row,
  CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS collected, nullif(l_partkey % 30, 0) AS code, l_quantity < 3 AS mismatch, l_tax = 0 AS no_range, l_quantity, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
c AS (SELECT *, CASE WHEN code IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY person, collected, code) END AS copies FROM r),
v AS (SELECT *, CASE WHEN mismatch THEN 'excluded' WHEN no_range OR copies > 1 THEN 'pending' ELSE 'included' END AS decision FROM c)
"""


@query(
    "q62_merged_reviews",
    _MERGED
    + """SELECT person, file, row, collected, code, copies, concat_ws(',', CASE WHEN mismatch THEN 'unit_mismatch' END, CASE WHEN no_range THEN 'no_range' END, CASE WHEN copies > 1 THEN 'duplicate' END) AS issues,
  CASE WHEN mismatch OR copies > 1 THEN 'low' WHEN no_range THEN 'medium' ELSE 'high' END AS confidence, decision, mismatch AS locked FROM v""",
    small=("row",),
)
def merged_reviews(spark, root):
    """Results of all files of a person, duplicates flagged across files, after an incremental merge."""
    return _merged(spark, root).select("person", "file", "row", "collected", "code", "copies", F.array_join("issues", ",").alias("issues"), "confidence", "decision", "locked")


@query("q63_draws_of_files", _MERGED + "SELECT person, collected, row_number() OVER (PARTITION BY person ORDER BY collected)::INTEGER AS draw, string_agg(DISTINCT file, ',' ORDER BY file) AS files, count(*) AS results, count(*) FILTER (WHERE decision = 'included') AS included, count(*) FILTER (WHERE decision = 'pending') AS pending FROM v GROUP BY person, collected")
def draws_of_files(spark, root):
    """The draws of a person with the files that they come from."""
    return merge.draws(_merged(spark, root)).withColumn("files", F.array_join("files", ","))


@query(
    "q64_review_problems",
    _MERGED
    + """, d AS (SELECT person, collected, count(*) FILTER (WHERE decision = 'pending') AS pending, count(*) FILTER (WHERE decision <> 'excluded') AS included FROM v GROUP BY person, collected),
t AS (SELECT person, collected, CASE WHEN collected < TIMESTAMP '1995-01-01' OR collected > TIMESTAMP '2000-06-01' THEN 'A collection date in this report looks wrong. Leave that collection out.' END AS dated,
  (SELECT min('Test ' || code) FROM (SELECT code FROM v WHERE v.person = d.person AND v.collected = d.collected AND decision <> 'excluded' AND code IS NOT NULL GROUP BY code HAVING count(*) > 1)) || ' appears twice in one collection. Leave one out.' AS twice FROM d),
p AS (SELECT person, sum(pending) AS pending, count(*) FILTER (WHERE included > 0) AS cards FROM d GROUP BY person),
l AS (SELECT person, string_agg(nullif(concat_ws('|', dated, twice), ''), '|' ORDER BY collected) AS told FROM t GROUP BY person)
SELECT person, concat_ws('|', CASE WHEN person % 5 = 0 THEN 'no name' END, told, CASE WHEN cards = 0 THEN 'There are no results to add.' END) AS problems FROM p JOIN l USING (person)""".replace("1995-01-01", "1990-01-01"),
)
def review_problems(spark, root):
    """What keeps a person's results from becoming cards, once a reviewer has included everything that was pending."""
    view = _merged(spark, root, "text").withColumn("decision", F.when(F.col("decision") == "pending", "included").otherwise(F.col("decision")))
    unnamed = table(spark, root, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("person"), F.lit("no name").alias("problem"))
    found = merge.problems(view, F.lit("2000-06-01").cast("timestamp_ntz"), unnamed)
    return found.select("person", F.array_join("problems", "|").alias("problems"))


@query(
    "q65_card_observations",
    _MERGED
    + """SELECT person, collected, code, 'Test ' || code AS display, 'Test ' || code AS text, kind, CASE WHEN kind = 'quantity' THEN CAST(l_quantity AS DOUBLE) END AS value, CASE WHEN kind = 'quantity' THEN 'mg/dL' END AS unit,
  CASE WHEN kind = 'quantity' THEN '<' END AS comparator, CASE WHEN kind = 'quantity' THEN 1.0::DOUBLE END AS low, CAST(NULL AS DOUBLE) AS high, CASE kind WHEN 'titer' THEN '40' WHEN 'qualitative' THEN 'Negative' END AS words
FROM (SELECT *, CASE l_partkey % 3 WHEN 0 THEN 'quantity' WHEN 1 THEN 'titer' ELSE 'qualitative' END AS kind FROM v WHERE decision = 'included')""",
)
def card_observations(spark, root):
    """The included results as the card builder takes them."""
    view = _merged(spark, root, *_TRAVELLING).withColumns({"display": F.col("text"), "ucum": F.lit("mg/dL"), "comparator": F.lit("<"), "low": F.lit(1.0), "high": F.lit(None).cast("double")})
    return merge.observations(view)


@query(
    "q77_confirmed_results",
    _MERGED
    + """, t AS (SELECT *, bool_or(decision = 'included') OVER s AS taken, count(*) FILTER (WHERE decision = 'pending') OVER (PARTITION BY person, collected, code ORDER BY file, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM v WINDOW s AS (PARTITION BY person, collected, code))
SELECT person, file, row, CASE WHEN decision <> 'pending' THEN decision WHEN code IS NOT NULL AND (taken OR earlier > 0) THEN 'excluded' ELSE 'included' END AS decision,
  CASE WHEN decision = 'pending' THEN CASE WHEN copies > 1 THEN 'This test appears more than once for this date. Keep one and leave the other out.' WHEN no_range AND NOT mismatch THEN 'We''re less sure about this match. Compare it with your report.' ELSE 'Compare this with your report.' END END AS told FROM t""",
    small=("row",),
)
def confirmed_results(spark, root):
    """All results of a person once a reviewer has confirmed what was pending, one of each test, and what was asked of them."""
    view = _merged(spark, root)
    asked = view.withColumn("told", F.when(F.col("decision") == "pending", review.check_reason(F.col("issues"), F.col("confidence"))))
    return review.confirmed(asked, ["person", "collected"], ["file", "row"]).select("person", "file", "row", "decision", "told")


@query(
    "q78_numbered_lines",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'r' || row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id FROM lineitem""",
)
def numbered_lines(spark, root):
    """Every line's number among all lines, by the time of its shipping."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return review.with_numbers(table(spark, root, "lineitem").select(*order), order, "id", "r").select("l_orderkey", "l_linenumber", "l_partkey", "id")


@query(
    "q79_probe_results",
    """WITH n AS (SELECT l_orderkey, l_partkey, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
SELECT l_orderkey, i::INTEGER AS i, l_partkey FROM n, range(5 + l_orderkey % 5) AS r(i) WHERE i % m = p""",
)
def probe_results(spark, root):
    """The lines of an order repeated, or cut, to the size of a probe of five to nine results."""
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = (F.col("l_orderkey") % 5 + 5).cast("int")
    return review.repeat_to(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], n, "i").select("l_orderkey", "i", "l_partkey")


CATEGORIES, VENDORS = ("STANDARD", "ECONOMY", "PROMO", "SMALL", "MEDIUM", "LARGE"), ("quest", "generic")
#: Damage to a dictionary's entry, by the part's key: text, what stands for it, path below the entry and message.
_BROKEN = [
    ("", "", None, None),
    ('"loinc":"', '"loinc":"x', "loinc", "invalid format"),
    ('"display":"', '"display":"","was":"', "display", "too small (minimum 1)"),
    ('"category":"', '"category":"un', "category", f"must be {' or '.join(map(json.dumps, CATEGORIES))}"),
    ('"valueType":"quantity"', '"valueType":"number"', "valueType", 'must be "quantity" or "qualitative" or "titer"'),
    ('"ucum":"mg"', '"ucum":null', None, None),
    ('"ucum":"mg"', '"ucum":7', "ucum", "expected string"),
    ('"factor":0.5', '"factor":0', "unitConversions[0].factor", "too small (minimum 0)"),
    ('"factor":0.5', '"factor":0.5,"by":1', "unitConversions[0]", "unknown key(s) not allowed: by"),
    ('"plausible":{"min":1,', '"plausible":{"min":"1",', "plausible.min", "expected number"),
    ('"aliases":[', '"aliases":[{"vendor":"nobody","name":"x"},', "aliases[0].vendor", 'must be "quest" or "generic"'),
    ('"vendor":"quest","name":"', '"vendor":"quest","panel":"","name":"', "aliases[0].panel", "too small (minimum 1)"),
    ('"excludeFromSigning":false', '"excludeFromSigning":0', "excludeFromSigning", "expected boolean"),
    ('"excludeFromSigning":false', '"excludeFromSigning":true,"note":1', "", "unknown key(s) not allowed: note"),
    ('"unitAliases":{"milli":"mg"}', '"unitAliases":{"milli":"mg","x":[]}', "unitAliases.x", "expected string"),
    ('"answers":["a"]', '"answers":[]', "answers", "too small (minimum 1)"),
]
_SQL_BROKEN = ", ".join(f"({k}, {'NULL' if p is None else repr(p)}, {'NULL' if m is None else repr(m)})" for k, (_, _, p, m) in enumerate(_BROKEN))


def _dictionary(spark, root) -> dictionaries.Dictionary:
    """The parts as entries, those of a brand in a file; each tenth code is listed twice, and one file is of another version."""
    part = table(spark, root, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    code = F.concat(F.col("p_partkey").cast("string"), F.lit("-"), (F.col("p_partkey") % 10).cast("string"))
    text = F.concat(
        F.lit('{"loinc":"'), code, F.lit('","display":"Part '), code, F.lit('","text":"'), "p_name", F.lit('","category":"'), "p_type", F.lit('","valueType":"quantity","ucum":"mg","unitAliases":{"milli":"mg"},"unitConversions":[{"from":"g","factor":0.5},{"from":"g","factor":3}],'),
        F.lit('"answers":["a"],"plausible":{"min":1,"max":9.5},"aliases":[{"vendor":"quest","name":"'), F.upper("p_name"), F.lit('"},{"vendor":"generic","name":"'), "p_name", F.lit('","panel":" The  Panel"}],"excludeFromSigning":false}'),
    )
    damage = F.array(*(F.struct(F.lit(a).alias("find"), F.lit(b).alias("instead")) for a, b, *_ in _BROKEN))
    d = F.get(damage, (F.col("p_partkey") % len(_BROKEN)).cast("int"))
    made = part.withColumn("text", text).withColumn("d", d).select("p_partkey", "p_brand", F.when(F.col("d.find") == "", F.col("text")).otherwise(F.replace("text", F.col("d.find"), F.col("d.instead"))).alias("text"))
    twice = made.select("p_brand", F.explode(F.when(F.col("p_partkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n"), "p_partkey", "text")
    grouped = twice.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("n", "p_partkey", "text"))).alias("all"))
    version = F.when(F.col("p_brand") == "Brand#7", "2").otherwise("1")
    content = F.concat(F.lit('{"schemaVersion":'), version, F.lit(',"entries":['), F.array_join(F.transform("all", lambda x: x["text"]), ","), F.lit("]}"))
    return dictionaries.load(grouped.select(F.col("p_brand").alias("file"), content.alias("content")), CATEGORIES, VENDORS)


_LISTED = f"""WITH d(k, path, message) AS (VALUES {_SQL_BROKEN}),
e AS (SELECT p_partkey, p_brand, p_name, p_type, p_partkey || '-' || p_partkey % 10 AS code, n FROM part, range(2) AS r(n) WHERE p_brand <> 'Brand#7' AND (n = 0 OR p_partkey % 10 = 0)),
l AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n, p_partkey) - 1 AS pos FROM e JOIN d ON k = p_partkey % {len(_BROKEN)})
"""


@query(
    "q66_dictionary_rejects",
    _LISTED
    + """SELECT p_brand AS file, 'entries[' || pos || ']' || CASE WHEN path IS NULL THEN '.loinc' WHEN path = '' THEN '' ELSE '.' || path END AS path, coalesce(message, 'duplicate LOINC in dictionary: ' || code) AS message
FROM l WHERE message IS NOT NULL OR n = 1
UNION ALL SELECT DISTINCT p_brand, 'schemaVersion', 'must be 1' FROM part WHERE p_brand = 'Brand#7'""",
)
def dictionary_rejects(spark, root):
    """The entries of a dictionary that its schema, or an earlier entry, keeps out."""
    return _dictionary(spark, root).rejects


@query(
    "q67_dictionary_index",
    _LISTED
    + """, v AS (SELECT * FROM l WHERE message IS NULL AND n = 0)
SELECT vendor, panel, name, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM (SELECT 'quest' AS vendor, NULL AS panel, lower(p_name) AS name, code FROM v UNION ALL SELECT 'generic', 'the panel', lower(p_name), code FROM v) GROUP BY ALL""",
)
def dictionary_index(spark, root):
    """What an alias leads to, by vendor and panel."""
    found = _dictionary(spark, root).index()
    return found.select("vendor", F.trim("panel").alias("panel"), "name", F.array_join("codes", ",").alias("codes"))
