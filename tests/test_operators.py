"""Operators on small tables: order, ties, nulls, empty input."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from assayline.functions import shapes
from assayline.operators import documents
from assayline.operators import card, checks, dictionary, layout, review, rows, table as tables
from assayline.sources import files
from assayline.streaming.limits import requests_per_window


def test_tiers_stop_at_the_first_hit(spark):
    aliases = spark.createDataFrame(
        [(1, "quest", None, "iron"), (2, "quest", "urine", "iron"), (3, "generic", None, "iron"), (4, "quest", None, "lead"), (5, "quest", None, "lead"), (6, "generic", None, "lead"), (7, "generic", None, "zinc")], "code int, vendor string, panel string, name string"
    )
    probes = spark.createDataFrame(
        [(1, "quest", "urine", "iron"), (2, "quest", None, "iron"), (3, "other", None, "iron"), (4, "quest", None, "lead"), (5, "generic", None, "zinc"), (6, "quest", "urine", "zinc"), (7, "quest", None, "gold"), (8, None, None, None)], "id int, vendor string, panel string, name string"
    )
    found = {r["id"]: (r["via"], r["code"]) for r in dictionary.match_tiers(probes, aliases).collect()}
    assert found == {1: ("panel", 2), 2: ("vendor", 1), 3: ("generic", 3), 4: ("ambiguous", None), 5: ("vendor", 7), 6: ("generic", 7), 7: ("none", None), 8: ("none", None)}


def test_first_candidate(spark):
    frame = spark.createDataFrame([(1, 0, "none", None), (1, 1, "ambiguous", None), (1, 2, "vendor", 5), (2, 0, "none", None)], "id int, ordinal int, via string, code int")
    assert {r["id"]: r["via"] for r in dictionary.first_candidate(frame, ["id"]).collect()} == {1: "ambiguous", 2: "none"}


def test_line_clusters_use_the_running_mean(spark):
    items = spark.createDataFrame([(1, 10.0, 0.0), (1, 10.3, 1.0), (1, 10.6, 2.0), (2, 5.0, 0.0)], "page int, y double, x double")
    found = {(r["page"], r["line"]): r["n"] for r in layout.group_lines(items, ["page"], "y", "x", F.lit(0.4)).collect()}
    assert found == {(1, 0): 2, (1, 1): 1, (2, 0): 1}


def test_text_items(spark):
    reports = spark.createDataFrame([(1, "Iron  88 ug/dL   H\r\n\tx\ty"), (2, ""), (3, "a " * 40_000)], "report_id int, text string")
    found = sorted((r["report_id"], r["y"], r["x"], r["str"]) for r in layout.text_to_items(reports).where("report_id < 3").collect())
    assert found == [(1, 0, 0, "Iron"), (1, 0, 6, "88 ug/dL"), (1, 0, 17, "H"), (1, 1, 8, "x"), (1, 1, 16, "y")]
    assert layout.text_to_items(reports).where("report_id = 3").count() == 1


def test_upper_median(spark):
    frame = spark.createDataFrame([([1, 2, 3, 4],), ([3, 1, 2],), ([],)], "v array<int>")
    assert [r[0] for r in frame.select(layout.upper_median(F.col("v"))).collect()] == [3, 2, None]


def test_header_roles(spark):
    patterns = [("name", "(?i)^test name$"), ("result", "(?i)^result$"), ("units", "(?i)^units$")]
    items = spark.createDataFrame([(1, 0, "Test  Name"), (1, 10, "Result"), (1, 20, "Units"), (1, 30, "Result"), (2, 0, "Test Name"), (2, 5, "Units")], "line int, x int, str string")
    found = layout.header_roles(items, patterns, ["line"]).collect()
    assert [(r["line"], [(c["x0"], c["role"]) for c in r["columns"]]) for r in found] == [(1, [(0, "name"), (10, "result"), (20, "units")])]


def test_bands_and_centers(spark):
    frame = spark.createDataFrame([(5.0,), (19.6,), (20.5,), (99.0,), (-3.0,)], "x double")
    starts = F.array(*(F.lit(v) for v in (10.0, 20.0, 30.0)))
    assert [r[0] for r in frame.select(tables.as_of_band(F.col("x"), F.lit(0.5), starts)).collect()] == [10.0, 20.0, 20.0, 30.0, 10.0]
    assert [r[0] for r in spark.createDataFrame([(15.0,), (26.0,)], "x double").select(tables.nearest_center(F.col("x"), starts)).collect()] == [10.0, 30.0]


def test_scopes_and_notes(spark):
    lines = spark.createDataFrame([(1, 0, "header", "A"), (1, 1, "row", None), (1, 2, "note", "n1"), (1, 3, "reset", None), (1, 4, "row", None), (1, 5, "note", "n2")], "report int, idx int, kind string, v string")
    scoped = tables.scoped_forward(lines, ["report"], ["idx"], F.when(F.col("kind") == "header", F.col("v")), F.col("kind") == "reset", "columns")
    assert [r["columns"] for r in scoped.orderBy("idx").collect()] == ["A", "A", "A", None, None, None]
    noted = tables.notes_of(lines, ["report"], "idx", F.col("kind") == "row", F.col("kind"))
    assert sorted((r["island"], r["notes"]) for r in noted.collect()) == [(1, ["note", "reset"]), (2, ["note"])]


def test_grading():
    names = list(rows.BLOCKING)
    assert names == ["implausible", "unit_mismatch", "ambiguous_match"]


def test_confidence(spark):
    frame = spark.createDataFrame([(["no_range"], True, 0), ([], True, 1), ([], False, 0), (["ocr"], True, 0)], "issues array<string>, value boolean, soft int")
    found = frame.select(rows.confidence_of(F.col("issues"), F.col("value"), F.col("soft"), F.lit(False)).alias("c"), rows.is_blocking(F.lit(True), F.col("value"), F.col("issues")).alias("b")).collect()
    assert [tuple(r) for r in found] == [("high", False), ("medium", False), ("low", True), ("low", False)]


def test_draw_fallback(spark):
    frame = spark.createDataFrame([(1, 0, None), (1, 1, "t1"), (1, 2, "t2"), (2, 0, None)], "report int, idx int, stamp string")
    assert {(r["report"], r["collected"]): r["n"] for r in rows.group_draws(frame, "report", "stamp", "idx").collect()} == {(1, "t1"): 2, (1, "t2"): 1, (2, None): 1}


def test_decisions(spark):
    frame = spark.createDataFrame([(True, "high", "included"), (False, "high", None), (False, "low", None), (False, "low", "excluded")], "blocked boolean, confidence string, override string")
    assert [r[0] for r in frame.select(review.decision(F.col("blocked"), F.col("confidence"), F.col("override"))).collect()] == ["excluded", "included", "pending", "excluded"]


def test_multiset_match(spark):
    expected, actual = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, i int"), spark.createDataFrame([("a", 9), ("c", 1)], "k string, i int")
    found = {r["k"]: (r["matched"], r["missing"], r["unexpected"]) for r in checks.multiset_match(expected, actual, ["k"], ["i"]).collect()}
    assert found == {"a": (1, 1, 0), "b": (0, 1, 0), "c": (0, 0, 1)}


def test_payload_bytes(spark):
    """A small card in emission order, whole numbers without fraction, coded words."""
    frame = spark.createDataFrame([("Doe", ["Jordan"])], "family string, given array<string>")
    nothing = F.lit(None).cast("double")
    quantity = card.observation_json(F.lit("2093-3"), F.lit("D"), F.lit("T"), F.lit("2026-04-17T13:40:00Z"), F.lit(88.0), F.lit("mg/dL"), F.lit("<"), nothing, F.lit(99.5), F.lit(None).cast("string"))
    words = card.observation_json(F.lit("1-8"), F.lit("D"), F.lit("T"), F.lit("2026-04-17T13:40:00Z"), nothing, F.lit("x"), F.lit(None).cast("string"), nothing, nothing, F.lit("Negative"))
    patient = card.patient_json(F.col("family"), F.col("given"), F.lit("1985-01-15"), F.lit("male"))
    text = frame.select(card.payload_json("https://example.org", F.lit(1776433200), patient, F.array(quantity, words), ("t1", "t2"))).first()[0]
    assert text.startswith('{"iss":"https://example.org","nbf":1776433200,"vc":{"type":["t1","t2"],"credentialSubject":{"fhirVersion":"4.0.1","fhirBundle":{"resourceType":"Bundle","type":"collection","entry":[{"fullUrl":"resource:0","resource":{"resourceType":"Patient","name":[{"family":"Doe","given":["Jordan"]}],"birthDate":"1985-01-15","gender":"male"}},{"fullUrl":"resource:1",')
    assert '"valueQuantity":{"value":88,"unit":"mg/dL","system":"http://unitsofmeasure.org","code":"mg/dL","comparator":"<"},"referenceRange":[{"high":{"value":99.5,"unit":"mg/dL"}}]}' in text
    assert '"valueCodeableConcept":{"coding":[{"system":"http://snomed.info/sct","code":"260385009","display":"Negative"}],"text":"Negative"}' in text


def test_strict_checks(spark):
    frame = spark.createDataFrame([('{"a":1,"b":{"resourceType":"Immunization"}}',), ('{"z":1,"a":[{"resourceType":"X"}]}',), (None,)], "doc string")
    found = frame.select(F.array_join(card.unknown_keys(F.col("doc"), ("a",)), ",").alias("keys"), shapes.canonical_json(F.col("doc")).alias("c")).collect()
    assert [tuple(r) for r in found] == [("b", '{"a":1,"b":{"resourceType":"Immunization"}}'), ("z", '{"a":[{"resourceType":"X"}],"z":1}'), ("", None)]
    hits = documents.first_of_type(frame.select("doc", F.try_parse_json("doc").alias("v")), "v", "immunization|x", ["doc"]).collect()
    assert sorted(r["path"] for r in hits) == ["a[0].resourceType", "b.resourceType"]


def test_files(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for name in ("10.txt", "2.txt", "__MACOSX/x", "d/"):
            archive.writestr(name, name)
    contents = [b"%PDF-1", packed.getvalue(), b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"\0\0\0\x18ftypheic", b"plain\ttext\r\n", b"\x00\x01", b""]
    frame = spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    assert [r[0] for r in frame.orderBy("path").select(files.sniff(F.col("content"))).collect()] == ["pdf", "zip", "jpeg", "png", "heic", "text", "unknown", "unknown"]
    expanded = files.expand_archives(frame.where("path in ('1', '6')")).orderBy("path", "entry").collect()
    assert [(r["path"], r["name"], r["error"]) for r in expanded] == [("1", "2.txt", None), ("1", "10.txt", None), ("6", None, "unreadable")]


def test_rate_limit_over_a_stream(spark, tmp_path):
    rows_in = [("a", f"2026-01-01 00:00:{s:02d}") for s in range(12)] + [("b", "2026-01-01 00:00:30"), ("a", "2026-01-01 00:02:00")]
    spark.createDataFrame(rows_in, "ip string, at string").select("ip", F.to_timestamp("at").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ip string, at timestamp").parquet(str(tmp_path / "in"))
    query = requests_per_window(stream, "ip", "at", 60, 10, "1 minute").writeStream.outputMode("complete").format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r["ip"], r["n"], r["limited"]) for r in spark.table("limits").collect()} == {("a", 12, True), ("b", 1, False), ("a", 1, False)}


def test_units_are_joined_without_moving_their_lines(spark):
    from assayline.plans import catalogue

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES["q24_conversion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
