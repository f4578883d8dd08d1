"""Every corpus operator on awkward tables: nulls everywhere, empty and long texts, ties, repeated rows, no rows, extra
columns with the names that the operators use inside."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayline.llm import ann, bpe, chat, decontaminate, linededup, repeats, simhash, tokenfile, toxicity, urlfilter

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ROWS = [
    (1, "the same line of text\nother one here", "en", "a", 1), (1, "the same line of text\nother one here", "en", "a", 1), (2, "The same line of TEXT \nunique", None, None, None), (3, None, "en", "a", 1),
    (None, "the same line of text", "en", "a", 1), (4, "", "en", "a", 0), (5, LONG, "en", "a", len(LONG)), (6, LONG, "fr", "b", len(LONG)), (7, "  \n\n ", "en", "b", 5), (8, "é\u00a0ü\t\x1c 日本語 <|endoftext|>", "de", "b", 9),
]
CLASHES = {"_key": "x", "_pos": 1, "_positions": 2, "fp0": 3, "point": 4, "node": 5, "root": 6, "leaf": 7, "n": 8, "found": 9, "_d": 10, "_bytes": 11, "ids": 12, "decoded": 13, "component_id": 14, "gram": 15, "n_lines": 16, "p_toxic": 17}


@pytest.fixture(params=["full", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "full" else [], DOCS)


@pytest.fixture
def wide(spark):
    frame = spark.createDataFrame(ROWS, DOCS)
    return frame.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


RANKS = lambda: P.path("byte_bpe_multi_50k.tiktoken")
LABELS = "doc_id long, quality int, toxic int"


def queries(spark, docs, tmp):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 1), (None, 1, 1), (99, 1, 1), (1, 1, 0)], LABELS)
    benchmark = spark.createDataFrame([(1, "the same line of text other one here"), (2, None), (3, ""), (4, "tiny")], "item_id long, text string")
    return {
        "op2": lambda: bpe.bpe_query(docs, RANKS(), P.PATTERN), "op3": lambda: simhash.simhash_query(docs), "op5": lambda: decontaminate.find_contamination(docs, benchmark), "op6": lambda: repeats.repeats_query(docs),
        "op7": lambda: toxicity.toxicity_query(docs, labels), "op8": lambda: linededup.line_dedup_query(docs), "op10": lambda: tokenfile.token_file_query(docs, str(tmp), P.path("byte_bpe_50k.json")),
    }


@pytest.mark.parametrize("name", ["op2", "op3", "op5", "op6", "op7", "op8", "op10"])
def test_runs_on_odd_rows(spark, docs, tmp_path, name):
    n = docs.count()
    rows = queries(spark, docs, tmp_path / "f")[name]().collect()
    assert len(rows) == n if name != "op5" else {r["doc_id"] for r in rows} == ({1} if n else set())


@pytest.mark.parametrize("name", ["op2", "op3", "op5", "op6", "op7", "op8", "op10"])
def test_extra_columns_change_nothing(spark, wide, tmp_path, name):
    plain = wide.select(*DOCS.replace(" long", "").replace(" string", "").split(", "))
    a = queries(spark, wide, tmp_path / "a")[name]().collect()
    b = queries(spark, plain, tmp_path / "b")[name]().collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_stages_keep_columns(spark, wide):
    labels = spark.createDataFrame([(2, 0, 1), *((i, 1, 0) for i in (1, 3, 4, 5, 6, 7, 8))], LABELS)
    benchmark = spark.createDataFrame([(1, "zzz zzz")], "item_id long, text string")
    for made in (linededup.without_repeated_lines(wide), simhash.keep_one_of_each(wide), decontaminate.drop_contaminated(wide, benchmark), toxicity.keep_clean(wide, labels)):
        assert made.columns == wide.columns
        assert made.count() > 0


def test_chat_and_urls_and_vectors(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_query(none).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, "USER", "x"), (1, 0, "user", "x"), (1, None, "robot", "")], "conv_id long, turn long, role string, text string").withColumn("r", F.lit(1))
    assert {r["conv_id"] for r in chat.chat_query(odd).collect()} == {None, 1}
    pages = spark.createDataFrame([(1, None), (None, "http://A.Com/x"), (3, "no scheme"), (4, "x://"), (5, "http://h/" + "a/" * 5000), (5, "http://H?q#f")], "page_id long, url string").withColumns({"_host": F.lit(1), "host": F.lit(2)})
    labels = spark.createDataFrame([], LABELS)
    found = urlfilter.filter_urls(pages, labels).collect()
    assert len(found) == 6 and {r["host"] for r in found} == {"", "a.com", "h"} and {r["verdict"] for r in found} == {"allow"}
    assert urlfilter.filter_urls(pages.limit(0), labels).count() == 0
    assert ann.ann_query(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>").withColumn("point", F.lit(1))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.ann_query(two).collect()) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]


def test_very_many_lines_in_one_text(spark):
    """A text of 60,000 lines takes seconds, as its lines are parted once."""
    lines = [f"line number {i % 1000}" if i % 2 else f"own line {i} of it" for i in range(60_000)]
    frame = spark.createDataFrame([(1, "\n".join(lines)), (2, "line number 17\n\nshort")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in linededup.line_dedup_query(frame).collect()}
    assert found == {1: (60_000, 0), 2: (3, 1)}


def test_rows_that_repeat_an_id(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "a"), (1, text, "b"), (1, "something else altogether of its own kind", "c"), (2, text + " more", "d"), (None, text, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, note string")
    assert sorted(r["note"] for r in simhash.keep_one_of_each(frame).collect()) == ["a", "b", "c", "e"]


def test_own_columns_stay_in_the_toxicity_stage(spark):
    frame = spark.createDataFrame([(1, "fine", 17.0, "x"), (2, "well", 18.0, "y")], "doc_id long, text string, p_toxic double, p_low_quality string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    assert sorted(map(tuple, toxicity.keep_clean(frame, labels).collect())) == [(1, "fine", 17.0, "x"), (2, "well", 18.0, "y")]
