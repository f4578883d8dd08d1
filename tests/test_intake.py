"""Files of every kind, and results of several files brought together."""

from __future__ import annotations

import datetime
import io
import json
import zipfile

from pyspark.sql import functions as F

from assayline.operators import merge
from assayline.sources import dictionaries, files

PAGES = "path string, entry int, page int, text string"


def _zip(*members, compress=zipfile.ZIP_STORED):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", compress) as archive:
        for name, content in members:
            archive.writestr(name, content)
    return packed.getvalue()


def _routed(spark, contents, layer=(), seen=()):
    frame = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in contents], "path string, content binary").withColumns({"kind": files.sniff(F.col("content")), "entry": F.lit(9), "name": F.lit("x")})
    found = files.route_files(frame, spark.createDataFrame(list(layer), PAGES), spark.createDataFrame(list(seen), PAGES))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_archives_are_read_by_what_they_hold(spark):
    whole = _zip(("b10.txt", "ten"), ("b9.txt", "nine"), ("x.bin", b"\x00\x01"), ("s.pdf", b"%PDF-1"), ("t.png", "not a picture"))
    bomb = bytearray(_zip(("a.txt", "a" * 4_000), ("b.txt", "b" * 4_000), compress=zipfile.ZIP_DEFLATED))
    cut = _zip(("a.txt", "a" * 400), compress=zipfile.ZIP_DEFLATED)
    damaged = bytearray(cut)
    damaged[40:60] = bytes(20)
    frame = spark.createDataFrame([("whole", bytearray(whole)), ("bomb", bomb), ("damaged", damaged), ("none", bytearray(b"")), ("empty", bytearray(_zip()))], "path string, content binary")
    found = [(r["path"], r["entry"], r["name"], r["kind"], r["error"]) for r in files.expand_archives(frame, 500, 5_000).orderBy("path", "entry").collect()]
    assert found == [
        ("bomb", -1, None, None, "too_large"), ("damaged", -1, None, None, "unreadable"), ("none", -1, None, None, "unreadable"),
        ("whole", 0, "b9.txt", "text", None), ("whole", 1, "b10.txt", "text", None), ("whole", 2, "s.pdf", "pdf", None), ("whole", 3, "t.png", "text", None), ("whole", 4, "x.bin", "unknown", None),
    ]


def test_odd_files(spark):
    contents = [("null", None), ("empty", b""), ("text", "café �".encode() + b"\xff"), ("nothing", _zip(("folder/", ""))), ("pdf", b"%PDF"), ("pdf0", b"%PDF")]
    assert _routed(spark, contents, [("pdf", -1, 1, "x" * 39)], [("pdf0", -1, 1, "seen")]) == [
        ("empty", None, None, None, None, "unsupported"), ("nothing", None, None, None, None, "no_pages"), ("null", None, None, None, None, "unsupported"), ("pdf", None, None, None, None, "scanned"),
        ("pdf0", 1, -1, "ocr", "seen", None), ("text", 1, -1, "text", "café ��", None),
    ]
    assert _routed(spark, []) == []


def test_one_scan_keeps_an_archive_from_being_read(spark):
    two = _zip(("1.pdf", b"%PDF"), ("2.pdf", b"%PDF"))
    layer = [("z", 0, 1, "x" * 50), ("z", 0, 2, "x" * 50)]
    assert _routed(spark, [("z", two)], layer) == [("z", None, None, None, None, "scanned")]
    assert [(r[1], r[2], r[3]) for r in _routed(spark, [("z", two)], layer, [("z", 1, 1, "s")])] == [(1, 0, "ocr"), (2, 0, "ocr"), (3, 1, "ocr")]


RESULTS = "person int, file string, row int, collected timestamp_ntz, code string, text string, issues array<string>, confidence string"


def _rows(frame):
    return sorted((tuple(r) for r in frame.select("person", "file", "row", "code", "issues", "confidence", "copies", "decision", "locked").collect()), key=repr)


def test_merge_is_idempotent_and_incremental(spark):
    t = lambda d: datetime.datetime(2020, 1, d)
    a = spark.createDataFrame([(1, "a", 1, t(1), "x", "X", [], "high"), (1, "a", 2, t(1), "y", "Y", ["no_range"], "medium"), (1, "a", 3, None, "x", "X", [], "high"), (None, "a", 1, t(1), "x", "X", ["unit_mismatch"], "low"), (1, "a", 4, t(1), None, None, [], "low"), (1, "a", 5, t(1), None, None, [], "low")], RESULTS)
    b = spark.createDataFrame([(1, "b", 1, t(1), "x", "X", ["duplicate"], "low"), (1, "b", 1, t(1), "x", "X", ["duplicate"], "low"), (1, "b", 2, t(2), "y", "Y", [], "high"), (None, None, 1, t(1), "x", "X", [], "high")], RESULTS)
    stored, view = merge.merge(a, merge.reviewed(a), b)
    both = _rows(view)
    assert both == _rows(merge.reviewed(stored)) and both == _rows(merge.merge(stored, view, b)[1])
    assert (1, "a", 1, "x", ["duplicate"], "low", 2, "pending", False) in both and (1, "b", 1, "x", ["duplicate"], "low", 2, "pending", False) in both
    assert (1, "a", 3, "x", [], "high", 1, "included", False) in both and (1, "a", 4, None, [], "low", 1, "pending", False) in both
    assert (None, "a", 1, "x", ["unit_mismatch", "duplicate"], "low", 2, "excluded", True) in both
    # the file comes again without its first row: the other one is no duplicate any longer
    left = merge.merge(stored, view, b.where("row = 2"))[1]
    assert (1, "a", 1, "x", [], "high", 1, "included", False) in _rows(left)
    assert [(r["person"], r["draw"], r["files"], r["results"]) for r in merge.draws(view).where("person = 1").orderBy("draw").collect()] == [(1, 1, ["a", "b"], 5), (1, 2, ["b"], 1), (1, 3, ["a"], 1)]
    assert merge.merge(stored.limit(0), view.limit(0), b.limit(0))[1].count() == 0


def test_merge_joins_no_stored_rows_to_the_touched_keys(spark):
    stored = spark.createDataFrame([(1, "a", 1, datetime.datetime(2020, 1, 1), "x", "X", [], "high")], RESULTS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merge.merge(stored, merge.reviewed(stored), stored)[1]._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("LeftSemi") == 0


def test_reasons_and_problems(spark):
    frame = spark.createDataFrame([(None, [], None, True), ("x", ["unit_mismatch", "implausible"], "stone", True), ("x", ["unit_mismatch"], None, True), ("x", [], None, False), ("x", ["implausible"], None, True), ("x", ["duplicate"], None, True)], "code string, issues array<string>, unit string, valued boolean")
    assert [r[0] for r in frame.select(merge.block_reason(F.col("code"), F.col("issues"), F.col("unit"), F.col("valued"))).collect()] == [
        "We couldn't identify this test.", "The unit stone can't be used for this test.", "This result has no unit, and this test needs one.", "We couldn't read this result.", "This value is outside the possible range for this test, so it was probably misread.", None,
    ]
    day = lambda n: datetime.datetime(2019, 1, 1) + datetime.timedelta(days=n)
    many = [(1, "f", k, day(k), "x", "X", [], "high") for k in range(13)] + [(2, "f", 1, day(9_000), "x", "X", [], "high"), (2, "f", 2, day(0), "y", "Y", [], "medium"), (3, "f", 1, None, "x", "X", ["implausible"], "low")]
    view = merge.reviewed(spark.createDataFrame(many, RESULTS))
    found = {r["person"]: r["problems"] for r in merge.problems(view, F.lit("2025-01-01").cast("timestamp_ntz")).collect()}
    wrong = "A collection date in this report looks wrong. Leave that collection out."
    assert found == {1: ["You can create up to 12 cards at once. Leave some collections out."], 2: ["1 result still needs review.", wrong], 3: [wrong, "There are no results to add."]}


CATEGORIES, VENDORS = ("iron", "salts"), ("quest", "generic")


def _entry(code="1-1", **members):
    out = {"loinc": code, "display": "D", "text": "T", "category": "iron", "valueType": "quantity", "ucum": "mg", "aliases": [{"vendor": "quest", "name": " A ,B "}]}
    return out | members


def test_dictionary_files(spark, tmp_path):
    good = _entry(unitAliases={"m": "mg"}, unitConversions=[{"from": "g", "factor": 2}, {"from": "g", "factor": 3}], answers=["x"], plausible={"min": 1, "max": 2.5}, excludeFromSigning=True)
    files_of = {
        "a.json": {"schemaVersion": 1, "note": "n", "entries": [good, _entry("2-2", ucum=None, valueType="titer", aliases=[{"vendor": "generic", "name": "x", "panel": "P"}] * 2), _entry("3-x")]},
        "b.json": {"schemaVersion": 1, "entries": [_entry("2-2"), 7, _entry("4-4", aliases=[]), _entry("5-5", more=1)]}, "c.json": {"schemaVersion": 2, "entries": []}, "d.json": [],
        "e.json": {"schemaVersion": 1, "entries": []},
    }
    for name, content in files_of.items():
        (tmp_path / name).write_text(json.dumps(content))
    (tmp_path / "f.json").write_text("{")
    read = dictionaries.read_dictionary(spark, str(tmp_path), CATEGORIES, VENDORS)
    assert sorted(map(tuple, read.rejects.collect())) == [
        ("a.json", "entries[2].loinc", "invalid format"), ("b.json", "entries[0].loinc", "duplicate LOINC in dictionary: 2-2"), ("b.json", "entries[1]", "expected object"), ("b.json", "entries[2].aliases", "too small (minimum 1)"),
        ("b.json", "entries[3]", "unknown key(s) not allowed: more"), ("c.json", "schemaVersion", "must be 1"), ("d.json", "", "expected object"), ("f.json", "", "expected object"),
    ]
    one, two = (r.asDict() for r in read.entries.orderBy("code").collect())
    assert one == {"code": "1-1", "display": "D", "text": "T", "category": "iron", "value_type": "quantity", "ucum": "mg", "unit_aliases": {"m": "mg"}, "conversions": {"g": 2.0}, "answers": ["x"], "low": 1.0, "high": 2.5, "excluded": True}
    assert (two["ucum"], two["value_type"], two["unit_aliases"], two["conversions"], two["answers"], two["excluded"]) == (None, "titer", {}, {}, None, False)
    assert sorted((r["vendor"], r["panel"] or "", r["codes"]) for r in read.index().collect()) == [("generic", "p", ["2-2"]), ("quest", "", ["1-1"])]
    empty = dictionaries.load(spark.createDataFrame([], "file string, content string"), CATEGORIES, VENDORS)
    assert empty.entries.count() == empty.aliases.count() == empty.rejects.count() == 0
