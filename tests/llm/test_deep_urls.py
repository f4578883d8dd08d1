"""Paths of more than eight segments keep their own branches."""

from __future__ import annotations

from assayline.llm import urlfilter


def test_branches_below_the_eighth_level(spark):
    deep = "/".join("abcdefghij")  # ten segments that all pages share
    rows = [(i, f"http://h.org/{deep}/{'bad' if i % 2 else 'fine'}/end") for i in range(200)]
    pages = spark.createDataFrame([*rows, (200, f"http://h.org/{deep}")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: (r["verdict"], r["template"]) for r in urlfilter.filter_urls(pages, labels).collect()}
    stars = "/*" * 10
    assert all(found[i] == (("block", f"{stars}/bad/*") if i % 2 else ("allow", f"{stars}/fine/*")) for i in range(200))
    assert found[200][1] == stars or found[200][1] == f"/{deep}"
