"""Queries on what is published: keys, manifests, card files; terms found in texts; requests over their limit.

Bindings: a customer's row makes a key, a hundred of them an environment; an order is a build, its lines the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions import codec
from assayline.operators import card, contains
from assayline.plans.matching import query
from assayline.session import shared_folder, table
from assayline.sources import keys, manifest, onefile
from assayline.streaming import limits

_THUMB = """translate(rtrim(to_base64(unhex(sha256('{"crv":"P-256","kty":"EC","x":"' || x || '","y":"' || y || '"}'))), '='), '+/', '-_')"""
_KEYS = f"""WITH b AS (SELECT c_custkey AS k, c_custkey % 9 AS kind, 'env' || c_custkey // 100 AS env, replace(c_name, '#', '_') AS x, 'y' || c_custkey AS y FROM customer),
c AS (SELECT *, {_THUMB} AS kid FROM b),
f AS (SELECT *, CASE kind WHEN 5 THEN 'k' || k || '.json' WHEN 7 THEN 'other' || k || '.json' ELSE kid || '.json' END AS file FROM c)
"""


def _registry(spark, root) -> keys.Registry:
    """A key of every customer; of nine, one each with a private member, a null one, another name, no y, another kid, no JSON."""
    k, kind = F.col("c_custkey"), F.col("c_custkey") % 9
    made = table(spark, root, "customer").select(k.alias("k"), kind.alias("kind"), F.concat(F.lit("env"), F.floor(k / 100)).alias("env"), F.replace("c_name", F.lit("#"), F.lit("_")).alias("x"), F.concat(F.lit("y"), k).alias("y"))
    made = made.withColumn("kid", codec.thumbprint(F.lit("P-256"), F.lit("EC"), F.col("x"), F.col("y")))
    said = F.when(F.col("kind") == 7, F.concat(F.lit("other"), "k")).otherwise(F.col("kid"))
    text = lambda c: card.json_string(c)
    private = F.when(F.col("kind") == 3, F.lit('"secret"')).when(F.col("kind") == 4, F.lit("null"))
    content = card.json_object(
        ("kid", text(said)), ("kty", F.lit('"EC"')), ("crv", F.lit('"P-256"')), ("x", text(F.col("x"))), ("y", F.when(F.col("kind") != 6, text(F.col("y")))), ("d", private), ("note", F.lit('"not for the registry"'))
    )
    file = F.when(F.col("kind") == 5, F.concat(F.lit("k"), "k")).otherwise(said)
    return keys.load(made.select("env", F.concat(file, F.lit(".json")).alias("file"), F.when(F.col("kind") == 8, F.lit('["kid"]')).otherwise(content).alias("content")))


@query(
    "q68_key_rejects",
    _KEYS
    + """SELECT env, file, CASE kind WHEN 3 THEN 'contains a private key member "d"' WHEN 4 THEN 'contains a private key member "d"' WHEN 5 THEN 'file name must be <kid>.json' WHEN 6 THEN 'must be a key of kind EC on P-256 with x and y'
  WHEN 7 THEN 'kid must be the thumbprint of the key' ELSE 'not a JSON object' END AS message FROM f WHERE kind >= 3""",
)
def key_rejects(spark, root):
    """The key files that the registry refuses, and why."""
    return _registry(spark, root).rejects


@query(
    "q69_key_sets",
    _KEYS
    + """SELECT env, count(*)::INTEGER AS n, '{"keys":[' || string_agg('{"kty":"EC","crv":"P-256","x":"' || x || '","y":"' || y || '","kid":"' || kid || '","use":"sig","alg":"ES256"}', ',' ORDER BY kid) || ']}' AS document FROM f WHERE kind < 3 GROUP BY env""",
)
def key_sets(spark, root):
    """The document of an environment's public keys."""
    return keys.key_sets(_registry(spark, root).keys)


@query(
    "q70_key_states",
    _KEYS
    + """SELECT k, env, kid AS active_kid, k % 5 NOT IN (1, 2, 3) AND kind < 3 AS ok, CASE WHEN k % 5 = 1 THEN 'key_missing' WHEN k % 5 = 2 THEN 'key_invalid' WHEN k % 5 = 3 OR kind >= 3 THEN 'key_mismatch' END AS reason FROM f""",
)
def key_states(spark, root):
    """Whether each customer's secret can sign: absent, without its private part, another's, unpublished, or right."""
    customer = table(spark, root, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("env"), F.floor(F.col("c_custkey") / 100)).alias("env"), F.replace("c_name", F.lit("#"), F.lit("_")).alias("x"), F.concat(F.lit("y"), "c_custkey").alias("y"))
    kid = codec.thumbprint(F.lit("P-256"), F.lit("EC"), F.col("x"), F.col("y"))
    y = F.when(F.col("k") % 5 == 3, F.concat("y", F.lit("0"))).otherwise(F.col("y"))
    secret = card.json_object(("kty", F.lit('"EC"')), ("crv", F.lit('"P-256"')), ("x", card.json_string(F.col("x"))), ("y", card.json_string(y)), ("d", F.when(F.col("k") % 5 != 2, F.lit('"private"'))))
    signers = customer.select("k", "env", kid.alias("active_kid"), F.when(F.col("k") % 5 != 1, secret).alias("secret"))
    return keys.key_states(signers, _registry(spark, root).keys)


_FILES = """WITH l AS (SELECT l_orderkey AS build, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, 'part ' || l_partkey AS content FROM lineitem),
f AS (SELECT build, CASE n WHEN 1 THEN '/_headers' WHEN 2 THEN '/build-manifest.json' WHEN 3 THEN '/deep/_headers' ELSE '/a/"' || n || '".js' END AS path, sha256(content) AS hash FROM l),
g AS (SELECT *, path = '/_headers' AS config FROM f WHERE path <> '/build-manifest.json')
"""


def _files(spark, root) -> DataFrame:
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    path = F.when(F.col("n") == 1, "/_headers").when(F.col("n") == 2, "/build-manifest.json").when(F.col("n") == 3, "/deep/_headers").otherwise(F.concat(F.lit('/a/"'), "n", F.lit('".js')))
    return lines.withColumn("n", n).select(F.col("l_orderkey").alias("build"), path.alias("path"), F.encode(F.concat(F.lit("part "), "l_partkey"), "UTF-8").alias("content"))


def _manifests(spark, root) -> DataFrame:
    key = F.col("o_orderkey")
    files = _files(spark, root)
    entries = manifest.hashed(files)
    builds = table(spark, root, "orders").select(
        key.alias("build"), F.lit("example/site").alias("repository"), F.sha1(key.cast("string")).alias("commit"), F.lit("production").alias("env"), F.when(key % 2 == 0, key.cast("string")).alias("run"), (key % 3 == 0).alias("dirty"),
        F.lit("worker.js").alias("worker_file"), F.sha2(key.cast("string"), 256).alias("worker_hash"),
    )
    return manifest.manifests(entries, builds)


@query(
    "q71_manifests",
    _FILES
    + """, a AS (SELECT build, coalesce(string_agg('"' || replace(path, '"', '\\"') || '":"' || hash || '"', ',' ORDER BY path) FILTER (WHERE NOT config), '') AS assets, coalesce(string_agg('"' || path[2:] || '":"' || hash || '"', ',' ORDER BY path) FILTER (WHERE config), '') AS config FROM g GROUP BY build)
SELECT o_orderkey AS build, '{"schema":1,"repository":"example/site","commit":"' || sha1(o_orderkey::VARCHAR) || '",' || CASE WHEN o_orderkey % 3 = 0 THEN '"dirty":true,' ELSE '' END || '"env":"production","run":' || CASE WHEN o_orderkey % 2 = 0 THEN '"' || o_orderkey || '"' ELSE 'null' END
  || ',"worker":{"file":"worker.js","sha256":"' || sha256(o_orderkey::VARCHAR) || '"},"assets":{' || coalesce(assets, '') || '},"config":{' || coalesce(config, '') || '}}' AS manifest FROM orders LEFT JOIN a ON build = o_orderkey""",
)
def manifests(spark, root):
    """The manifest of each build: files and configuration by path, with their hashes."""
    return _manifests(spark, root)


#: Damage to a manifest, by the build's key: a pattern, what stands for it, and the problem, if the text is there.
_SPOILT = [
    ("^$", "", None), ('"schema":1', '"schema":"1"', "not a build manifest (schema 1)"), ('"commit":"', '"commit":"A', "not a build manifest (schema 1)"), ('"assets":', '"asset":', "not a build manifest (schema 1)"),
    ('"assets":', '"assets":{"/!/../x":"","no":""},"was":', "manifest has a bad asset entry: /!/../x"), ('"config":', '"config":{"!robots":""},"was":', "manifest has a bad config entry: !robots"), ('"schema"', '"schema', "not a build manifest (schema 1)"),
]


@query(
    "q72_manifest_problems",
    _FILES
    + f""", p(k, problem) AS (VALUES {', '.join(f"({k}, {'NULL' if p is None else repr(p)})" for k, (*_, p) in enumerate(_SPOILT))}),
n AS (SELECT build, count(*) FILTER (WHERE NOT config) AS assets, count(*) FILTER (WHERE config) AS config FROM g GROUP BY build)
SELECT o_orderkey AS build, problem, CASE WHEN problem IS NULL THEN coalesce(assets, 0) END AS assets, CASE WHEN problem IS NULL THEN coalesce(config, 0) END AS config
FROM orders JOIN p ON k = o_orderkey % {len(_SPOILT)} LEFT JOIN n ON build = o_orderkey WHERE problem IS NOT NULL OR assets > 0 OR config > 0""",
)
def manifest_problems(spark, root):
    """Manifests read back, some of them spoilt: how many files they list, or what is wrong with them."""
    damage = F.array(*(F.struct(F.lit(a).alias("find"), F.lit(b).alias("instead")) for a, b, _ in _SPOILT))
    d = F.get(damage, (F.col("build") % len(_SPOILT)).cast("int"))
    spoilt = _manifests(spark, root).select("build", F.regexp_replace("manifest", d["find"], d["instead"]).alias("text"))
    files, wrong = manifest.parse(spoilt, "build", "text")
    count = lambda role: F.count_if(F.col("role") == role).alias(f"{role}s" if role == "asset" else role)
    counted = files.groupBy("build").agg(count("asset"), count("config"))
    return counted.join(wrong, "build", "full").select("build", "problem", "assets", "config")


@query(
    "q73_card_files",
    """WITH c AS (SELECT o_custkey AS k, max(o_orderdate) AS made FROM orders GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY CAST(made AS DATE) ORDER BY k) AS n FROM c)
SELECT strftime(made, 'card-%Y-%m-%d') || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.smart-health-card' AS name, '{"verifiableCredential":["' || k || '"]}' AS content FROM n""",
)
def card_files(spark, root):
    """A card of each customer's last order as a file of its own, read back from the folder."""
    last = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("made"))
    folder = shared_folder(spark)
    onefile.write_files(onefile.card_files(last, "card", [], "made", ["k"], F.col("k").cast("string")), folder)
    return onefile.read_texts(spark, folder, ".smart-health-card")


@query(
    "q74_contained_terms",
    """WITH t AS (SELECT item_id AS rank, substr(text, 20, 40) AS term FROM benchmark UNION ALL SELECT item_id + 100000, substr(text, 1, 4) FROM benchmark UNION ALL SELECT n_nationkey + 200000, substr(n_name, 1, 2) FROM nation)
SELECT doc_id, arg_min(term, (rank, term)) AS term FROM documents LEFT JOIN t ON term <> '' AND contains(text, term) GROUP BY doc_id""",
)
def contained_terms(spark, root):
    """The first of many terms, long and short ones, that each document's whole text contains."""
    item = table(spark, root, "benchmark")
    long = item.select(F.col("item_id").alias("rank"), F.substring("text", 20, 40).alias("term"))
    short = item.select((F.col("item_id") + 100_000).alias("rank"), F.substring("text", 1, 4).alias("term"))
    least = table(spark, root, "nation").select((F.col("n_nationkey") + 200_000).cast("long").alias("rank"), F.substring("n_name", 1, 2).alias("term"))
    texts = table(spark, root, "documents").select("doc_id", "text")
    return contains.first_contained(texts, long.unionByName(short).unionByName(least), "doc_id", "text", "term", "rank").select("doc_id", "term")


@query(
    "q75_unmatched_names",
    """WITH l AS (SELECT l_orderkey AS report, p_name AS name, l_tax FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT report, name FROM l WHERE l_tax > 0.01), e AS (SELECT report, name FROM l WHERE l_tax > 0.02),
u AS (SELECT report, count(*) AS n_found, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.report = f.report AND contains(upper(f.name) || ' 12 mg/dL', upper(e.name)))) AS unknown FROM f GROUP BY report),
c AS (SELECT report, count(*) AS n_expected FROM e GROUP BY report)
SELECT report, coalesce(n_found, 0) AS n_found, coalesce(n_expected, 0) AS n_expected, coalesce(unknown, 0) AS unknown, coalesce(unknown, 0) = 0 AND coalesce(n_found, 0) = coalesce(n_expected, 0) AS same FROM u FULL JOIN c USING (report)""",
)
def unmatched_names(spark, root):
    """The lines of a report that were not matched against the names expected to be so."""
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax").join(table(spark, root, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    named = lines.select(F.col("l_orderkey").alias("report"), at.alias("line"), F.upper("p_name").alias("name"), "l_tax")
    found = named.where("l_tax > 0.01").select("report", "line", F.concat("name", F.lit(" 12 mg/dL")).alias("text"))
    return contains.same_sets(found, named.where("l_tax > 0.02").select("report", "name", "line"), "line", "text", "name", "line", ["report"])


@query(
    "q76_limited_requests",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
r AS (SELECT user_id, event_id, ts, k, [ts] AS kept, true AS passed FROM o WHERE k = 1
  UNION ALL SELECT user_id, event_id, ts, k, CASE WHEN len(live) < 2 THEN list_append(live, ts) ELSE live END, len(live) < 2
  FROM (SELECT o.user_id, o.event_id, o.ts, o.k, list_filter(r.kept, lambda t: t > o.ts - INTERVAL 12 HOUR) AS live FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))
SELECT user_id, event_id, ts, passed FROM r""",
)
def limited_requests(spark, root):
    """Every request of a user, and whether it passes a limit of two in any twelve hours."""
    return limits.limited(table(spark, root, "events").select("user_id", "event_id", "ts"), "user_id", "event_id", "ts", 43_200, 2)
