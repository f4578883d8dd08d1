"""The pipeline, stage by stage, against plain versions of each stage."""

from __future__ import annotations

import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

ROOT = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{ROOT}/documents.parquet")
    made = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, ROOT).write.parquet(str(folder / name))
        docs = made[name] = spark.read.parquet(str(folder / name))
    return made


def _texts(frame):
    return {r["doc_id"]: r["text"] or "" for r in frame.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    assert all(stages[n].columns == COLUMNS for n, _ in corpus_pipeline.STAGES[:-1])


def test_toxicity_only_drops(spark, stages):
    before, after = _texts(stages["documents"]), _texts(stages["toxicity"])
    assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
    clean = {r["doc_id"] for r in spark.read.parquet(f"{ROOT}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean - set(after)) <= 0.02 * len(clean)


def test_lines(stages):
    before, after = _texts(stages["toxicity"]), _texts(stages["line_dedup"])
    key = lambda s: re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", s).translate({c: c + 32 for c in range(65, 91)})
    holders: dict[str, set] = {}
    for i, t in before.items():
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(k := key(line)) >= 10 and len(holders[k]) > 1 and i != min(holders[k])
    assert after == {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in before.items()}


def test_near_duplicates(stages):
    before, after = _texts(stages["line_dedup"]), _texts(stages["simhash_near_dedup"])
    shingles = {}
    for i, t in before.items():
        w = t.lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    similar = lambda a, b: len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
    gone = set(before) - set(after)
    assert all(any(j != i and similar(i, j) >= 0.8 for j in before) for i in gone)
    left = sorted(after)
    assert not [(i, j) for n, i in enumerate(left) for j in left[:n] if similar(i, j) >= 0.8]


def test_benchmark(spark, stages):
    from assayline.llm.decontaminate import normal

    items = [normal(r["text"]) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    before, after = _texts(stages["simhash_near_dedup"]), _texts(stages["benchmark_decontamination"])
    assert set(after) == {i for i, t in before.items() if not any(s in normal(t) for s in items)}


def test_ids_round_trip(spark, stages):
    last = stages["byte_bpe"]
    assert last.where("not round_trip").count() == 0 and last.count() == stages["benchmark_decontamination"].count()
    assert corpus_pipeline.run(spark, ROOT).count() == last.count()
