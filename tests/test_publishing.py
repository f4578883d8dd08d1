"""Keys, manifests, files of single rows, terms in texts, and the limiter on tables and streams."""

from __future__ import annotations

import datetime
import hashlib
import json
import random
from base64 import urlsafe_b64encode

import pytest
from pyspark.sql import functions as F

from assayline.operators import contains
from assayline.sources import keys, manifest, onefile
from assayline.streaming import limits


def _kid(x, y):
    text = json.dumps({"crv": "P-256", "kty": "EC", "x": x, "y": y}, separators=(",", ":"))
    return urlsafe_b64encode(hashlib.sha256(text.encode()).digest()).decode().rstrip("=")


def test_registry_of_a_folder(spark, tmp_path):
    good, extra = _kid("a", "b"), _kid("c", "d")
    (tmp_path / "staging").mkdir()
    (tmp_path / "production").mkdir()
    for env, name, key in [
        ("staging", f"{good}.json", {"kid": good, "kty": "EC", "crv": "P-256", "x": "a", "y": "b", "secret": 1}),
        ("staging", f"{extra}.json", {"kid": extra, "kty": "EC", "crv": "P-256", "x": "c", "y": "d", "d": None}),
        ("production", "k.json", {"kid": 7, "kty": "EC"}), ("production", "notes.txt", {}),
    ]:
        (tmp_path / env / name).write_text(json.dumps(key))
    found = keys.read_registry(spark, str(tmp_path))
    assert [tuple(r) for r in found.keys.collect()] == [("staging", "EC", "P-256", "a", "b", good, "sig", "ES256")]
    assert sorted(r["message"] for r in found.rejects.collect()) == ['contains a private key member "d"', "file name must be <kid>.json"]
    document = json.loads(keys.key_sets(found.keys).first()["document"])
    assert document == {"keys": [{"kty": "EC", "crv": "P-256", "x": "a", "y": "b", "kid": good, "use": "sig", "alg": "ES256"}]}


def test_odd_key_files(spark):
    odd = spark.createDataFrame([("e", "a.json", None), ("e", "b.json", ""), ("e", "c.json", "[1]"), ("e", "d.json", "{"), (None, "f.json", '{"kid":"f","kty":"EC","crv":"P-256","x":"","y":"1"}')], "env string, file string, content string")
    rejects = {r["file"]: r["message"] for r in keys.load(odd).rejects.collect()}
    assert set(rejects) == {"a.json", "b.json", "c.json", "d.json", "f.json"} and rejects["f.json"].startswith("must be a key") and len(set(rejects.values())) == 2
    assert keys.load(odd.limit(0)).keys.count() == 0


def test_key_states_never_show_the_secret(spark):
    kid = _kid("a", "b")
    registry = keys.load(spark.createDataFrame([("e", f"{kid}.json", json.dumps({"kid": kid, "kty": "EC", "crv": "P-256", "x": "a", "y": "b"}))], "env string, file string, content string"))
    secret = lambda **kw: json.dumps({"kty": "EC", "crv": "P-256", "x": "a", "y": "b", "d": "s"} | kw)
    given = [("e", kid, secret()), ("e", kid, secret(y="c")), ("e", "other", secret()), ("f", kid, secret()), ("e", kid, secret(d="")), ("e", kid, "{"), ("e", kid, None)]
    signers = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, env string, active_kid string, secret string")
    states = keys.key_states(signers, registry.keys).orderBy("i")
    assert states.columns == ["i", "env", "active_kid", "ok", "reason"]
    assert [r["reason"] for r in states.collect()] == [None, "key_mismatch", "key_mismatch", "key_mismatch", "key_invalid", "key_invalid", "key_missing"]


def test_manifest_of_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, text in {"index.html": "<p>", "_headers": "h", ".assetsignore": "x", "build-manifest.json": "{}", "deep/_headers": "served", "deep/a b.js": "1"}.items():
        (tmp_path / name).write_text(text)
    found = manifest.hashed(onefile.read_files(spark, str(tmp_path)))
    assert {r["path"]: (r["role"], r["hash"]) for r in found.collect()} == {
        p: (role, hashlib.sha256(t.encode()).hexdigest()) for p, role, t in [("/index.html", "asset", "<p>"), ("/_headers", "config", "h"), ("/deep/_headers", "asset", "served"), ("/deep/a b.js", "asset", "1")]
    }


def test_manifests_that_are_none(spark):
    head = {"schema": 1, "commit": "0" * 40, "worker": {"sha256": "0" * 64}, "assets": {}, "config": {}}
    given = [head, head | {"commit": "0" * 39}, head | {"assets": None}, head | {"worker": {}}, head | {"assets": {"a": "0" * 64}}, head | {"assets": {"/a": 7}}, head | {"config": {"robots": "0" * 64}}]
    texts = spark.createDataFrame([(i, json.dumps(g)) for i, g in enumerate(given)] + [(7, None), (8, "")], "i int, text string")
    files, wrong = manifest.parse(texts, "i", "text")
    assert files.count() == 0
    assert [(r["i"], r["problem"].split(":")[0]) for r in wrong.orderBy("i").collect()] == [
        (1, "not a build manifest (schema 1)"), (2, "not a build manifest (schema 1)"), (3, "not a build manifest (schema 1)"), (4, "manifest has a bad asset entry"),
        (5, "manifest has a bad asset entry"), (6, "manifest has a bad config entry"), (7, "not a build manifest (schema 1)"), (8, "not a build manifest (schema 1)"),
    ]


def test_files_of_rows(spark, tmp_path):
    folder = tmp_path / "out"
    frame = lambda *rows: spark.createDataFrame(rows, "name string, content string").repartition(3)
    onefile.write_files(frame(("a.txt", "one"), ("b.txt", "é\n"), ("c.txt", None)), str(folder))
    assert {p.name: p.read_text() for p in folder.iterdir()} == {"a.txt": "one", "b.txt": "é\n", "c.txt": ""}
    onefile.write_files(frame(("a.txt", "two"), ("d.txt", "d")), str(folder))
    assert {p.name for p in folder.iterdir()} == {"a.txt", "b.txt", "c.txt", "d.txt"} and (folder / "a.txt").read_text() == "two"
    onefile.write_files(frame(("b.txt", "only")), str(folder), "overwrite")
    assert {p.name: p.read_text() for p in folder.iterdir()} == {"b.txt": "only"}
    for bad in [(("x", "1"), ("x", "2")), (("x", "1"), ("../y", "2")), (("x", "1"), (None, "2")), (("x", "1"), ("_hidden", "2"))]:
        with pytest.raises(Exception, match="name"):
            onefile.write_files(frame(*bad), str(folder))
        assert {p.name: p.read_text() for p in folder.iterdir() if p.is_file()} == {"b.txt": "only"}
    onefile.write_files(frame(("b.txt", "x")).limit(0), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_only_changed_files_are_written(spark, tmp_path):
    files = spark.createDataFrame([("/a", bytearray(b"1")), ("/b", bytearray(b"2")), ("/c", bytearray(b""))], "path string, content binary")
    (tmp_path / "a").write_bytes(b"1")
    (tmp_path / "b").write_bytes(b"1")
    new = manifest.changed(files, onefile.read_files(spark, str(tmp_path)))
    before = (tmp_path / "a").stat().st_mtime_ns
    onefile.write_files(new.select(F.substring("path", 2, 99).alias("name"), "content"), str(tmp_path))
    assert manifest.changed(files, onefile.read_files(spark, str(tmp_path))).count() == 0 and (tmp_path / "b").read_bytes() == b"2" and (tmp_path / "c").read_bytes() == b""
    assert (tmp_path / "a").stat().st_mtime_ns == before


def test_terms_in_texts(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abé😀") for _ in range(n))
    texts = [(i, draw.randrange(2), word(draw.randrange(40))) for i in range(120)] + [(120, 0, None), (121, 0, ""), (122, 1, "a" * 3_000 + "b\nb")]
    terms = [(i, draw.randrange(2), word(draw.randrange(9))) for i in range(60)] + [(60, 0, None), (61, 0, ""), (62, 1, "b\nb"), (63, 1, "b\nb"), (64, 1, "a" * 40)]
    t, s = spark.createDataFrame(texts, "id int, k int, text string"), spark.createDataFrame(terms, "rank int, k int, term string")
    expected = {(k, i, q) for i, k, x in texts for _, m, q in terms if k == m and x is not None and q and q in x}
    assert {tuple(r) for r in contains.pairs(t, s, "id", "text", "term", ["k"]).collect()} == expected
    first = {r["id"]: r["term"] for r in contains.first_contained(t, s.drop("k"), "id", "text", "term", "rank").collect()}
    assert first == {i: next((q for _, _, q in terms if q and x and q in x), None) for i, _, x in texts}
    assert contains.pairs(t, s.limit(0), "id", "text", "term").count() == 0


def _decided(requests, seconds, limit):
    passed, out = {}, []
    for user, request, at in sorted(requests, key=lambda r: (r[2], r[1])):
        live = [p for p in passed.get(user, []) if p > at - datetime.timedelta(seconds=seconds)]
        out.append((user, request, at, len(live) < limit))
        passed[user] = [*live, at] if len(live) < limit else live
    return sorted(out, key=repr)


def _requests(n):
    draw, start = random.Random(9), datetime.datetime(2024, 3, 10, 1, 59)
    return [(draw.choice(["a", "b", "b", "b", None]), i, start + datetime.timedelta(milliseconds=draw.randrange(0, 400) * 500)) for i in range(n)]


SCHEMA = "user string, request long, at timestamp_ntz"


def test_limits_of_a_table(spark):
    given = _requests(300)
    frame = spark.createDataFrame([*given, ("a", 999, None)], SCHEMA)
    for seconds, limit in [(10, 2), (60, 10), (5, 0)]:
        assert sorted((tuple(r) for r in limits.limited(frame, "user", "request", "at", seconds, limit).collect()), key=repr) == _decided(given, seconds, limit)
    assert limits.limited(frame.limit(0), "user", "request", "at").count() == 0


def test_limits_of_a_stream_do_not_depend_on_arrival(spark, tmp_path):
    given = sorted(_requests(120), key=lambda r: r[2])
    draw, last = random.Random(3), given[-1][2]
    moved = sorted(given, key=lambda r: r[2] + datetime.timedelta(seconds=draw.randrange(20)))  # at most 20 s late
    batches = [moved[i : i + 40] for i in range(0, 120, 40)] + [[("end", 10_000, last + datetime.timedelta(hours=1))], [("end", 10_001, last + datetime.timedelta(hours=2))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    decided = limits.limited_stream(stream, "user", "request", "at", "30 seconds", 10, 2)
    run = decided.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("parquet").start(str(tmp_path / "out"))
    run.awaitTermination()
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["user"] != "end"]
    assert sorted(found, key=repr) == _decided(given, 10, 2)


def test_manifests_are_parsed_once(spark):
    found, wrong = manifest.parse(spark.createDataFrame([(1, "{}"), (2, None)], "k int, text string"), "k", "text")
    assert found.inputFiles() and found.inputFiles() == wrong.inputFiles() and wrong.count() == 2 and found.count() == 0


def test_only_grams_that_terms_hold_become_rows(spark):
    draw = random.Random(11)
    word = lambda n: "".join(draw.choice("ab\0é") for _ in range(n))
    long = "".join(draw.choice("abcdefgh") for _ in range(contains.STEP + 5_000))  # more than is looked at in one step
    texts = [(i, word(draw.randrange(60))) for i in range(80)] + [(80, long), (81, long[::-1]), (82, "")]
    terms = [word(n) for n in range(1, 14) for _ in range(3)] + [long[contains.STEP - 7 : contains.STEP + 13], long[-9:], long[-8:], long[5:900], long[5:900] + "!", "zz", "zzzzzzzzzz"]
    t, s = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(list(enumerate(terms)), "rank int, term string")
    found = contains.pairs(t, s, "id", "text", "term")
    assert "Generate" not in found._jdf.queryExecution().toString()  # before: a row for each character of a text
    assert sorted(map(tuple, found.collect())) == sorted({(i, q) for i, x in texts for q in terms if q in x})
    first = {r["id"]: r["term"] for r in contains.first_contained(t, s, "id", "text", "term", "rank").collect()}
    assert first == {i: next((q for q in terms if q in x), None) for i, x in texts}


def test_small_groups_are_compared_without_grams(spark):
    draw = random.Random(12)
    word = lambda n: "".join(draw.choice("abc") for _ in range(n))
    texts = [(i, draw.choice([0, 1, 2, None]), word(draw.randrange(30)), i * 2) for i in range(150)] + [(150, 1, None, 0)]
    terms = [(i, k, word(draw.randrange(1, 12))) for k, n in ((0, 5), (1, contains.FEW), (2, contains.FEW + 1), (None, 3)) for i in range(n)] + [(99, 0, ""), (99, 0, None)]
    t, s = spark.createDataFrame(texts, "id int, k int, text string, other int"), spark.createDataFrame(terms, "rank int, k int, term string")
    inside = lambda k, x: [(r, q) for r, m, q in terms if k is not None and k == m and x and q and q in x]
    for group, limit in ((t, s), (t.where("k < 2"), s.where("k < 2"))):
        known = {i for i, in group.select("id").collect()}
        found = contains.pairs(group, limit, "id", "text", "term", ["k"])
        assert sorted(map(tuple, found.collect())) == sorted({(k, i, q) for i, k, x, _ in texts if i in known for _, q in inside(k, x)})
        first = contains.first_contained(group, limit, "id", "text", "term", "rank", ["k"])
        assert {(r["id"], r["k"], r["text"], r["other"], r["term"]) for r in first.collect()} == {(i, k, x, o, min(inside(k, x), default=(0, None))[1]) for i, k, x, o in texts if i in known}
        assert first.count() == len(known)
    plan = first._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" not in plan  # before: a row for each character of a text


def test_many_small_files_are_few_tasks(spark, tmp_path):
    folder = tmp_path / "out"
    made = spark.range(0, 700, 1, 1).select(F.concat(F.lit("é"), "id", F.lit(".txt")).alias("name"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("content"))
    onefile.write_files(made, str(folder))
    (folder / "deep").mkdir()
    for name in (".hidden.txt", "_hidden.txt", "other.md", "deep/a.txt"):
        (folder / name).write_text("no")
    (folder / "empty.txt").write_text("")
    read = onefile.read_texts(spark, str(folder), ".txt")
    assert {tuple(r) for r in read.collect()} == {(f"é{i}.txt", f"{i}\n") for i in range(700)} | {("empty.txt", "")}
    assert read.rdd.getNumPartitions() == 1  # before: one for 32 files each
    onefile.write_files(made.limit(3), str(folder), "overwrite")
    assert sorted(p.name for p in folder.iterdir()) == ["deep", "é0.txt", "é1.txt", "é2.txt"] and (folder / "deep" / "a.txt").exists()
    with pytest.raises(Exception, match="name"):
        made.select(F.lit("same").alias("name"), "content").limit(2).repartition(2).write.format(onefile.FORMAT).mode("append").save(str(folder))
    assert len(list(folder.iterdir())) == 4
