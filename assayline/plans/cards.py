"""Queries on review and cards: numbering, decisions, strict checks, JSON, encodings, request outcomes, metrics.

Bindings: a row of ``lineitem`` is a reviewed result, an order a signing request, a nation an observation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.functions import codec, shapes
from assayline.operators import card, cardrules, documents, layout, review, rows
from assayline.plans.matching import query
from assayline.session import table


@query(
    "q34_natural_order",
    """WITH n AS (SELECT c_custkey, 'Page ' || c_custkey % 113 || '-' || c_nationkey || '.txt' AS name FROM customer),
k AS (SELECT *, 'page ' || lpad(CAST(c_custkey % 113 AS VARCHAR), 12, '0') || '-' || lpad(CAST(regexp_extract(name, '-(\\d+)\\.', 1) AS VARCHAR), 12, '0') || '.txt' AS key FROM n)
SELECT c_custkey, name, key FROM k""".replace("\\\\", "\\"),
)
def natural_order(spark, root):
    name = F.concat(F.lit("Page "), F.col("c_custkey") % 113, F.lit("-"), "c_nationkey", F.lit(".txt"))
    return table(spark, root, "customer").select("c_custkey", name.alias("name")).withColumn("key", layout.natural_key(F.col("name")))


@query(
    "q35_file_numbers",
    """WITH n AS (SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS k FROM orders)
SELECT o_orderkey, 'card-' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS file_name FROM n""",
)
def file_numbers(spark, root):
    from pyspark.sql import Window

    orders = table(spark, root, "orders").select("o_orderkey", "o_orderdate")
    number = F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    return orders.select("o_orderkey", codec.file_name("card", F.col("o_orderdate"), number).alias("file_name"))


_REVIEW = """
WITH r AS (SELECT l_orderkey, l_partkey % 9 = 0 AS unknown, l_partkey % 9 = 1 AS ambiguous, l_partkey % 9 = 2 AS mismatch, l_quantity < 2 AS unread, l_extendedprice > 90000 AS implausible, l_discount < 0.05 AS sure,
  CASE WHEN l_linenumber = 7 THEN 'excluded' WHEN l_linenumber = 6 THEN 'included' END AS override FROM lineitem),
d AS (SELECT *, CASE WHEN unknown THEN 'unknown_test' WHEN ambiguous THEN 'ambiguous_match' WHEN mismatch THEN 'unit_mismatch' WHEN unread THEN 'no_value' WHEN implausible THEN 'implausible' END AS reason FROM r),
e AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'excluded' ELSE coalesce(override, CASE WHEN sure THEN 'included' ELSE 'pending' END) END AS decision FROM d)
"""


def _reviewed(spark, root):
    k = F.col("l_partkey") % 9
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    reason = review.first_reason((k == 0, "unknown_test"), (k == 1, "ambiguous_match"), (k == 2, "unit_mismatch"), (F.col("l_quantity") < 2, "no_value"), (F.col("l_extendedprice") > 90000, "implausible"))
    override = F.when(F.col("l_linenumber") == 7, "excluded").when(F.col("l_linenumber") == 6, "included")
    sure = F.when(F.col("l_discount") < 0.05, "high").otherwise("medium")
    return lines.withColumn("reason", reason).withColumn("decision", review.decision(F.col("reason").isNotNull(), sure, override))


@query("q36_decisions", _REVIEW + "SELECT reason, decision, count(*) AS n FROM e GROUP BY ALL")
def decisions(spark, root):
    return _reviewed(spark, root).groupBy("reason", "decision").agg(F.count("*").alias("n"))


@query(
    "q36b_readiness",
    _REVIEW
    + """, o AS (SELECT l_orderkey, count(*) FILTER (WHERE decision = 'pending') AS pending, count(*) FILTER (WHERE decision = 'included') AS included FROM e GROUP BY l_orderkey)
SELECT l_orderkey, concat_ws(',', CASE WHEN pending > 0 THEN 'pending' END, CASE WHEN included = 0 AND pending = 0 THEN 'nothing' END, CASE WHEN included > 4 THEN 'too_many' END) AS problems FROM o""",
)
def readiness(spark, root):
    counted = _reviewed(spark, root).groupBy("l_orderkey").agg(F.count_if(F.col("decision") == "pending").alias("pending"), F.count_if(F.col("decision") == "included").alias("included"))
    problems = review.readiness([(F.col("pending") > 0, "pending"), ((F.col("included") == 0) & (F.col("pending") == 0), "nothing"), (F.col("included") > 4, "too_many")])
    return counted.select("l_orderkey", F.array_join(problems, ",").alias("problems"))


@query(
    "q36c_row_ids",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'r' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id FROM lineitem""",
)
def row_ids(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return review.with_numbers(lines, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "id", "r", ["l_orderkey"]).drop("l_extendedprice")


@query(
    "q36d_texts",
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '< ' ELSE '' END || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' mg/dL' ELSE '' END AS value_text,
CASE s_suppkey % 4 WHEN 0 THEN s_suppkey || '–' || s_suppkey + 5 WHEN 1 THEN '≤ ' || s_suppkey + 5 WHEN 2 THEN '≥ ' || s_suppkey END AS range_text FROM supplier""",
)
def texts(spark, root):
    k = F.col("s_suppkey")
    value = review.value_text(F.when(k % 3 == 0, "<"), k.cast("string"), F.when(k % 2 == 0, "mg/dL"))
    bounds = review.range_text(F.when((k % 4).isin(0, 2), k.cast("string")), F.when((k % 4).isin(0, 1), (k + 5).cast("string")))
    return table(spark, root, "supplier").select("s_suppkey", value.alias("value_text"), bounds.alias("range_text"))


@query(
    "q42_unknown_keys",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{"k": 1, "z": 2, "extra": {"k": 3}}' WHEN event_id % 7 = 0 THEN '{}' ELSE props END AS doc FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'extra,z' ELSE '' END AS unknown FROM e""",
)
def unknown_keys(spark, root):
    k = F.col("event_id")
    doc = F.when(k % 4 == 0, '{"k": 1, "z": 2, "extra": {"k": 3}}').when(k % 7 == 0, "{}").otherwise(F.col("props"))
    return table(spark, root, "events").select("event_id", F.array_join(card.unknown_keys(doc, ("k",)), ",").alias("unknown"))


@query(
    "q43_first_failure",
    """SELECT l_orderkey, l_partkey, l_quantity, CASE WHEN l_returnflag = 'R' THEN 'resourceType' WHEN NOT l_partkey % 5 <> 0 THEN 'code.coding.0.code' WHEN NOT l_shipdate >= TIMESTAMP '1996-01-01' THEN 'effectiveDateTime'
WHEN NOT l_quantity > 1 THEN 'valueQuantity.value' WHEN NOT l_discount <= l_tax THEN 'referenceRange.0' END AS path, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def first_failure(spark, root):
    lines = table(spark, root, "lineitem")
    failure = card.first_failure(
        (F.col("l_returnflag") != "R", "resourceType", "must be an Observation"),
        (F.col("l_partkey") % 5 != 0, "code.coding.0.code", "not in the dictionary"),
        (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"), "effectiveDateTime", "must match the card"),
        (F.col("l_quantity") > 1, "valueQuantity.value", "must be positive"),
        (F.col("l_discount") <= F.col("l_tax"), "referenceRange.0", "low must not be over high"),
    )
    return lines.select("l_orderkey", "l_partkey", "l_quantity", failure["path"].alias("path")).groupBy("l_orderkey", "l_partkey", "l_quantity", "path").agg(F.count("*").alias("n"))


@query(
    "q44_observation_json",
    """SELECT n_nationkey, '{"resourceType":"Observation","status":"final","category":[{"coding":[{"system":"http://terminology.hl7.org/CodeSystem/observation-category","code":"laboratory","display":"Laboratory"}]}],"code":{"coding":[{"system":"http://loinc.org","code":"'
|| n_nationkey || '-1","display":"' || n_name || ' \\"x\\""}],"text":"' || n_name || '"},"subject":{"reference":"resource:0"},"effectiveDateTime":"2026-04-17T13:40:00Z",'
|| CASE WHEN n_nationkey % 3 = 0 THEN '"valueCodeableConcept":{"coding":[{"system":"http://snomed.info/sct","code":"260385009","display":"Negative"}],"text":"Negative"}}'
ELSE '"valueQuantity":{"value":' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '.5' END || ',"unit":"mg/dL","system":"http://unitsofmeasure.org","code":"mg/dL"' || CASE WHEN n_nationkey % 5 = 0 THEN ',"comparator":"<"' ELSE '' END || '}'
  || CASE WHEN n_nationkey % 2 = 0 THEN ',"referenceRange":[{"low":{"value":0,"unit":"mg/dL"},"high":{"value":' || n_regionkey + 50 || ',"unit":"mg/dL"}}]' ELSE '' END || '}' END AS json FROM nation""".replace("\\\\", "\\"),
)
def observation_json(spark, root):
    k = F.col("n_nationkey")
    value = F.when(k % 3 != 0, k + F.when(k % 2 == 0, 0.0).otherwise(0.5))
    low, high = F.when(k % 2 == 0, F.lit(0.0)), F.when(k % 2 == 0, (F.col("n_regionkey") + 50).cast("double"))
    made = card.observation_json(
        F.concat(k, F.lit("-1")), F.concat("n_name", F.lit(' "x"')), F.col("n_name"), F.lit("2026-04-17T13:40:00Z"), value, F.lit("mg/dL"), F.when(k % 5 == 0, "<"), low, high, F.when(k % 3 == 0, "Negative")
    )
    return table(spark, root, "nation").select("n_nationkey", made.alias("json"))


@query(
    "q45_base64url",
    """SELECT p_partkey, translate(rtrim(to_base64(CAST(p_name || p_partkey AS BLOB)), '='), '+/', '-_') AS text, translate(rtrim(to_base64(unhex(sha256('{"crv":"P-256","kty":"EC","x":"' || p_name || '","y":"' || p_brand || '"}'))), '='), '+/', '-_') AS thumbprint FROM part""",
)
def base64url(spark, root):
    text = codec.base64url(F.encode(F.concat("p_name", "p_partkey"), "UTF-8"))
    return table(spark, root, "part").select("p_partkey", text.alias("text"), codec.thumbprint(F.lit("P-256"), F.lit("EC"), F.col("p_name"), F.col("p_brand")).alias("thumbprint"))


@query(
    "q46_numeric_mode",
    """WITH j AS (SELECT p_partkey, translate(rtrim(to_base64(CAST(p_brand || p_partkey AS BLOB)), '='), '+/', '-_') AS jws FROM part)
SELECT p_partkey, array_to_string(list_transform(range(1, CAST(length(jws) AS BIGINT) + 1), lambda i: lpad(CAST(ascii(substr(jws, i, 1)) - 45 AS VARCHAR), 2, '0')), '') AS digits, jws AS back FROM j""",
)
def numeric_mode(spark, root):
    jws = codec.base64url(F.encode(F.concat("p_brand", "p_partkey"), "UTF-8"))
    digits = table(spark, root, "part").select("p_partkey", codec.numeric_mode(jws).alias("digits"))
    return digits.withColumn("back", codec.from_numeric_mode(F.col("digits")))


@query(
    "q47_links",
    """SELECT o_orderkey, 'https://example.org/card#shc:/' || o_orderkey AS link, strftime(o_orderdate, 'card-%Y-%m-%d') || '.smart-health-card' AS name, '{"verifiableCredential":["' || o_orderkey || '"]}' AS content FROM orders""",
)
def links(spark, root):
    """Deep link, file name and file content of each card."""
    jws = F.col("o_orderkey").cast("string")
    content = card.json_object(("verifiableCredential", F.concat(F.lit("["), card.json_string(jws), F.lit("]"))))
    name = F.concat(codec.file_name("card", F.col("o_orderdate"), F.lit(1)), F.lit(".smart-health-card"))
    return table(spark, root, "orders").select("o_orderkey", F.concat(F.lit("https://example.org/card#shc:/"), jws).alias("link"), name.alias("name"), content.alias("content"))


_OUTCOME = """
WITH l AS (SELECT l_orderkey, count(*) AS cards, CAST(sum(l_quantity) AS BIGINT) AS observations, min(l_tax) AS low FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'too_large' WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN 'invalid_payload' WHEN cards > 8 THEN 'too_large' WHEN observations > 180 THEN 'too_large' WHEN o_custkey % 11 = 0 THEN 'turnstile_failed'
  WHEN o_custkey % 13 = 0 THEN 'rate_limited' WHEN o_orderkey % 17 = 0 THEN 'signing_failed' WHEN low = 0 THEN 'invalid_payload' ELSE 'ok' END AS code, cards, observations FROM orders JOIN l ON l_orderkey = o_orderkey),
s AS (SELECT *, CASE code WHEN 'ok' THEN 200 WHEN 'too_large' THEN 413 WHEN 'invalid_payload' THEN 400 WHEN 'turnstile_failed' THEN 403 WHEN 'rate_limited' THEN 429 ELSE 500 END AS status FROM r)
"""


def _outcomes(spark, root):
    lines = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("cards"), F.sum("l_quantity").cast("long").alias("observations"), F.min("l_tax").alias("low"))
    requests = table(spark, root, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    key = card.key_state(F.when(F.col("o_orderkey") % 17 != 0, "secret"), F.lit(True), F.lit(True))
    outcome = card.request_outcome(
        F.col("o_totalprice"), ~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 3 == 0)), F.col("cards"), F.col("observations"), F.col("o_custkey") % 11 != 0,
        F.col("o_custkey") % 13 != 0, key, F.col("low") != 0, max_bytes=450_000, max_cards=8, max_observations=180,
    )
    return requests.select("o_orderkey", "cards", "observations", outcome.alias("o")).select("o_orderkey", "cards", "observations", "o.status", "o.code")


@query("q48_request_outcomes", _OUTCOME + "SELECT o_orderkey, status, code FROM s")
def request_outcomes(spark, root):
    return _outcomes(spark, root).select("o_orderkey", "status", "code")


@query(
    "q49_metrics",
    _OUTCOME + "SELECT code, status, count(*) AS requests, sum(cards) AS cards, sum(observations) AS observations, max(observations) AS most FROM s GROUP BY ALL",
    big=("cards", "observations", "most"),
)
def metrics(spark, root):
    return _outcomes(spark, root).groupBy("code", "status").agg(F.count("*").alias("requests"), F.sum("cards").alias("cards"), F.sum("observations").alias("observations"), F.max("observations").alias("most"))


@query("q52_deflate_round_trip", None)
def deflate_round_trip(spark, root):
    """Raw DEFLATE of every nation's observation, and whether it comes back (no SQL form)."""
    made = observation_json(spark, root).withColumn("body", codec.deflate_raw(F.col("json")))
    return made.select("n_nationkey", codec.base64url(F.col("body")).alias("body"), (codec.inflate_raw(F.col("body")) == F.col("json")).alias("same"))


@query(
    "q53_canonical_json",
    """SELECT n_nationkey, '{"category":[{"coding":[{"code":"laboratory","display":"Laboratory","system":"http://terminology.hl7.org/CodeSystem/observation-category"}]}],"code":{"coding":[{"code":"' || n_nationkey || '-1","display":"' || n_name
|| ' \\"x\\"","system":"http://loinc.org"}],"text":"' || n_name || '"},"effectiveDateTime":"2026-04-17T13:40:00Z",'
|| CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 2 = 0 THEN '"referenceRange":[{"high":{"unit":"mg/dL","value":' || n_regionkey + 50 || '},"low":{"unit":"mg/dL","value":0}}],' ELSE '' END
|| '"resourceType":"Observation","status":"final","subject":{"reference":"resource:0"},'
|| CASE WHEN n_nationkey % 3 = 0 THEN '"valueCodeableConcept":{"coding":[{"code":"260385009","display":"Negative","system":"http://snomed.info/sct"}],"text":"Negative"}}'
ELSE '"valueQuantity":{"code":"mg/dL"' || CASE WHEN n_nationkey % 5 = 0 THEN ',"comparator":"<"' ELSE '' END || ',"system":"http://unitsofmeasure.org","unit":"mg/dL","value":' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '.5' END || '}}' END AS canonical,
true AS same, 'resourceType' AS forbidden FROM nation""",
)
def canonical(spark, root):
    """The canonical form of observations, which spaces and the order of keys do not change, and the first forbidden type."""
    made = observation_json(spark, root)
    spaced = F.regexp_replace(F.regexp_replace("json", '":', '" : '), '^.(.*),("subject" : .*?.),(.*).$', "{ $2 , $1 , $3 }")
    found = documents.first_of_type(made.select("n_nationkey", F.try_parse_json("json").alias("v")), "v", "observation|immunization", ["n_nationkey"])
    same = shapes.canonical_json(spaced) == shapes.canonical_json(F.col("json"))
    return made.join(found, "n_nationkey", "left").select("n_nationkey", shapes.canonical_json(F.col("json")).alias("canonical"), same.alias("same"), F.col("path").alias("forbidden"))


@query("q54_two_draws_merge", "SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS collected, count(*) AS n, count(DISTINCT event_type) AS files FROM events GROUP BY ALL")
def merged_draws(spark, root):
    """Draws of several files merge on equal instants."""
    events = table(spark, root, "events").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("collected"), "event_type")
    return events.groupBy("user_id", "collected").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("files"))


@query(
    "q55_graded_rows",
    """WITH r AS (SELECT l_orderkey, l_partkey % 9 = 1 AS ambiguous_match, l_partkey % 9 = 2 AS unit_mismatch, l_extendedprice > 90000 AS implausible, l_tax = 0 AS no_range, l_linenumber = 7 AS ocr, l_quantity >= 2 AS has_value, CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS soft FROM lineitem)
SELECT concat_ws(',', CASE WHEN ambiguous_match THEN 'ambiguous_match' END, CASE WHEN unit_mismatch THEN 'unit_mismatch' END, CASE WHEN implausible AND NOT unit_mismatch THEN 'implausible' END, CASE WHEN no_range AND NOT unit_mismatch THEN 'no_range' END, CASE WHEN ocr THEN 'ocr' END) AS issues,
  CASE WHEN ambiguous_match OR unit_mismatch OR implausible OR ocr OR NOT has_value THEN 'low' WHEN soft > 0 THEN 'medium' ELSE 'high' END AS confidence,
  NOT has_value OR ambiguous_match OR unit_mismatch OR implausible AS blocked, count(*) AS n FROM r GROUP BY ALL""",
)
def graded_rows(spark, root):
    k = F.col("l_partkey") % 9
    mismatch = k == 2
    issues = rows.issues_of(ambiguous_match=k == 1, unit_mismatch=mismatch, implausible=(F.col("l_extendedprice") > 90000) & ~mismatch, no_range=(F.col("l_tax") == 0) & ~mismatch, ocr=F.col("l_linenumber") == 7)
    value = F.col("l_quantity") >= 2
    graded = table(spark, root, "lineitem").select(issues.alias("issues"), value.alias("value"), F.when(F.col("l_discount") > 0.08, 1).otherwise(0).alias("soft"))
    out = graded.select(F.array_join("issues", ",").alias("issues"), rows.confidence_of(F.col("issues"), F.col("value"), F.col("soft"), F.lit(False)).alias("confidence"), rows.is_blocking(F.lit(True), F.col("value"), F.col("issues")).alias("blocked"))
    return out.groupBy("issues", "confidence", "blocked").agg(F.count("*").alias("n"))


_ENTRY = "vc.credentialSubject.fhirBundle.entry"
_KNOWN = "unknown key(s) not allowed: "
#: Damage to a card: (text, what stands in its place at its first occurrence, path and message of the rule that fails,
#: observations that the card must have for it). Where the text is a column's name, it is that column's value.
_DAMAGE = [
    ("", "", None, None, 1),
    ('"status":"final"', '"status":"final","contained":[{"resourceType":"ImmunizationRecommendation"}]', f"{_ENTRY}[1].resource.contained[0].resourceType", "immunization records are not supported", 1),
    ('#laboratory"', '#COVID19"', "vc.type[1]", "immunization records are not supported", 1),
    ('{"iss"', '{"extra":1,"iss"', "", f"{_KNOWN}extra", 1),
    ('"fhirVersion":"4.0.1"', '"fhirVersion":"4.3.0"', "vc.credentialSubject.fhirVersion", 'must be "4.0.1"', 1),
    ('"type":"collection"', '"type":"batch"', "vc.credentialSubject.fhirBundle.type", 'must be "collection"', 1),
    ('"iss":"https://', '"iss":"http://', "iss", "must equal https://example.org", 1),
    ('#laboratory"', '#laboratory","x"', "vc.type", 'must be exactly ["https://smarthealth.cards#health-card","https://smarthealth.cards#laboratory"]', 1),
    ('"fullUrl":"resource:1"', '"fullUrl":"resource:7"', f"{_ENTRY}[1].fullUrl", 'must be "resource:1"', 1),
    ('"birthDate":"19', '"birthDate":"29', f"{_ENTRY}[0].resource.birthDate", "must be a valid past date", 1),
    ('"birthDate":"', '"birthDate":"x', f"{_ENTRY}[0].resource.birthDate", "must be YYYY-MM-DD", 1),
    ('"given":[', '"given":["",', f"{_ENTRY}[0].resource.name[0].given[0]", "too small (minimum 1)", 1),
    ('"resourceType":"Observation"', '"resourceType":"Condition"', f"{_ENTRY}[1].resource.resourceType", 'must be "Observation"', 1),
    ('"status":"final"', '"status":"preliminary"', f"{_ENTRY}[1].resource.status", 'must be "final"', 1),
    ('"status":"final"', '"meta":{},"status":"final","id":"x"', f"{_ENTRY}[1].resource", f"{_KNOWN}id, meta", 1),
    ('"code":"laboratory"', '"code":"imaging"', f"{_ENTRY}[1].resource.category[0].coding[0].code", 'must be "laboratory"', 1),
    ('"system":"http://loinc.org","code":"', '"system":"http://loinc.org","code":"?', f"{_ENTRY}[1].resource.code.coding[0].code", "LOINC code is not in the dictionary", 1),
    ("first_code", "X", f"{_ENTRY}[1].resource.code.coding[0].code", "this test cannot be signed", 1),
    ('"display":"Name', '"display":"name', f"{_ENTRY}[1].resource.code.coding[0].display", "must equal the dictionary display name", 1),
    ('"text":"Label', '"text":"label', f"{_ENTRY}[1].resource.code.text", "must equal the dictionary label", 1),
    ("second_label", "first_label", f"{_ENTRY}[2].resource.code.coding[0].code", "duplicate LOINC code in card", 2),
    ("all_dates", "2999", f"{_ENTRY}[1].resource.effectiveDateTime", "must not be in the future", 1),
    ("all_dates", "1989", f"{_ENTRY}[1].resource.effectiveDateTime", "must not be before 1990-01-01", 1),
    ('T13:40:00Z"', 'T13:40:01.5Z"', f"{_ENTRY}[2].resource.effectiveDateTime", "all observations in a card must share one effectiveDateTime", 2),
    ('T13:40:00Z"', 'T25:40:00Z"', f"{_ENTRY}[1].resource.effectiveDateTime", "invalid date", 1),
    ('T13:40:00Z"', 'T13:40:00"', f"{_ENTRY}[1].resource.effectiveDateTime", "must be ISO 8601 UTC (YYYY-MM-DDThh:mm:ssZ)", 1),
    ('"subject"', '"valueCodeableConcept":{"text":"x"},"subject"', f"{_ENTRY}[1].resource", "exactly one of valueQuantity or valueCodeableConcept is required", 1),
    ('"code":"mg/dL"', '"code":"mg/l"', f"{_ENTRY}[1].resource.valueQuantity.code", "unit must be mg/dL", 1),
    ('"valueQuantity":{', '"valueQuantity":{"x":[],', f"{_ENTRY}[1].resource.valueQuantity", f"{_KNOWN}x", 1),
    ('"referenceRange":[', '"referenceRange":[{},', f"{_ENTRY}[1].resource.referenceRange", "at most one referenceRange element", 1),
    ('"low":{"value":1,"unit":"mg/dL"}', '"low":{"value":1,"unit":"g"}', f"{_ENTRY}[1].resource.referenceRange[0].low.unit", "must match the value unit", 1),
    ('"low":{"value":1,"unit":"mg/dL"}', "", f"{_ENTRY}[1].resource.referenceRange[0]", "must have low or high", 1),
    ('"comparator":"<"', '"comparator":"=="', f"{_ENTRY}[1].resource.valueQuantity.comparator", 'must be "<" or "<=" or ">" or ">="', 1),
    ('"valueQuantity":{"value":', '"valueQuantity":{"value":null,"was":', f"{_ENTRY}[1].resource.valueQuantity.value", "expected number", 1),
    ('"text":"1:', '"text":"2:', f"{_ENTRY}[5].resource.valueCodeableConcept.text", "titer must look like 1:N", 5),
    ('"text":"Negative"', '"text":"Maybe"', f"{_ENTRY}[6].resource.valueCodeableConcept.text", "must be one of Negative, Positive", 6),
    ('"coding":[{"system":"http://snomed.info/sct","code":"260385009","display":"Negative"}],', "", f"{_ENTRY}[6].resource", "does not match the canonical card format", 6),
    ('"text":"1:20"', '"text":"1:20","coding":[{"system":"http://snomed.info/sct","code":"1","display":"x"}]', f"{_ENTRY}[5].resource", "does not match the canonical card format", 5),
    ('"status":"final"', '"status":"final","status":"final"', "", "expected object", 1),
    ('"fullUrl":"resource:1",', "", f"{_ENTRY}[1].fullUrl", "expected string", 1),
    ('"status":"final",', "", f"{_ENTRY}[1].resource.status", 'must be "final"', 1),
    ("sorted", "", None, None, 1),
]


def _cards(spark, root):
    """A card of every order, its lines the observations (four quantities, a titer, then words), damaged by _DAMAGE in turn."""
    lines = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    label = lambda i: F.concat(F.lit("P"), F.lpad((F.col("o_orderkey") % 50).cast("string"), 2, "0"), F.lit("-"), F.lpad(i.cast("string"), 2, "0"))
    effective, text, number = F.date_format("o_orderdate", "yyyy-MM-dd'T13:40:00Z'"), F.lit(None).cast("string"), F.lit(None).cast("double")

    def observation(line, i):
        k, code = i + 1, label(i + 1)
        value = F.when(k <= 4, line["l_quantity"].cast("double") / 4)
        words = F.when(k == 5, F.lit("1:20")).when(k > 5, F.when(k % 2 == 0, F.lit("Negative")).otherwise(F.lit("Positive")))
        return card.observation_json(code, F.concat(F.lit("Name "), code), F.concat(F.lit("Label "), code), effective, value, F.lit("mg/dL"), F.when(k == 1, F.lit("<")).otherwise(text), F.when(k <= 4, F.lit(1.0)), number, words)

    patient = card.patient_json(F.lit("Doe"), F.array(F.lit("Jordan")), F.lit("1985-01-15"), F.lit("female"))
    whole = card.payload_json("https://example.org", F.lit(1), patient, F.transform("lines", observation), cardrules.TYPES)
    damage = F.array(*(F.struct(F.lit(a).alias("text"), F.lit(b).alias("instead")) for a, b, *_ in _DAMAGE))
    cards = orders.select("o_orderkey", F.size("lines").alias("n"), whole.alias("whole"), F.get(damage, (F.col("o_orderkey") % len(_DAMAGE)).cast("int")).alias("d"), label(F.lit(1)).alias("first"), label(F.lit(2)).alias("second"))
    text, instead = F.col("d.text"), F.col("d.instead")
    find = F.when(text == "first_code", F.concat(F.lit('"code":"'), "first", F.lit('"'))).otherwise(text)
    instead = F.when(text == "first_code", F.lit('"code":"X"')).otherwise(instead)
    at = F.instr("whole", find)
    replaced = F.when((text == "") | (at == 0), F.col("whole")).otherwise(F.concat(F.substring("whole", F.lit(1), at - 1), instead, F.substring("whole", at + F.length(find), F.length("whole"))))
    damaged = (
        F.when(text == "second_label", F.replace("whole", "second", "first")).when(text == "all_dates", F.regexp_replace("whole", F.lit('"effectiveDateTime":"[0-9]{4}'), F.concat(F.lit('"effectiveDateTime":"'), instead)))
        .when(text == "sorted", shapes.canonical_json(F.col("whole"))).otherwise(replaced)
    )
    return cards.select(F.col("o_orderkey").alias("card_id"), damaged.alias("payload"))


_QUOTE = "'"
_EXPECTED = ", ".join(
    f"({k}, {n}, {'NULL' if path is None else _QUOTE + path + _QUOTE}, {'NULL' if message is None else _QUOTE + message + _QUOTE})" for k, (_, _, path, message, n) in enumerate(_DAMAGE)
)


@query(
    "q59_card_rules",
    f"""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), d(k, least, path, message) AS (VALUES {_EXPECTED})
SELECT o_orderkey AS card_id, n::INTEGER AS observations, CASE WHEN n >= least THEN path END AS path, CASE WHEN n >= least THEN message END AS message
FROM orders JOIN n ON l_orderkey = o_orderkey JOIN d ON k = o_orderkey % {len(_DAMAGE)}""".replace("n::INTEGER", "CASE WHEN message = 'expected object' THEN 0 ELSE n END::INTEGER"),
)
def card_rules(spark, root):
    """Every card of the orders against all rules, each rule broken by some of the cards."""
    part = table(spark, root, "part").where("p_partkey < 50").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"))
    code = F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 2, "0"), F.lit("-"), F.lpad(F.col("k").cast("string"), 2, "0"))
    code = F.when((F.col("p_partkey") == 0) & (F.col("k") == 20), F.lit("X")).otherwise(code)
    kind = F.when(F.col("k") <= 4, "quantity").when(F.col("k") == 5, "titer").otherwise("qualitative")
    dictionary = part.select(
        code.alias("code"), F.concat(F.lit("Name "), code).alias("display"), F.concat(F.lit("Label "), code).alias("text"), kind.alias("value_type"), F.when(F.col("k") <= 4, F.lit("mg/dL")).alias("ucum"),
        F.when(F.col("k") > 5, F.array(F.lit("Negative"), F.lit("Positive"))).alias("answers"), (code == "X").alias("excluded"),
    )
    return cardrules.judge_cards(_cards(spark, root), dictionary, "https://example.org", F.lit("2026-07-01").cast("timestamp"))
