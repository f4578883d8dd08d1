"""Corpus operators against brute force, the libraries they must equal, SQL, and held-out labels."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayline.llm import ann, bpe, chat, components, decontaminate, linededup, queries, repeats, simhash, tokenfile, toxicity
from tests.comparing import frame_rows, oracle_rows

P = pytest.importorskip("public_tokenizers")
ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def tiktoken_encoding(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    frame = queries.QUERIES[name](spark, ROOT)
    columns = sorted(frame.columns)
    assert frame_rows(frame, columns) == oracle_rows(queries.ORACLES[name], ROOT, columns)


def test_bpe_equals_the_library(docs, texts, tiktoken_encoding):
    for row in bpe.bpe_query(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect():
        ids = np.array(tiktoken_encoding.encode_ordinary(texts[row["doc_id"]]), dtype="<u4").tobytes()
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n'st1!日", max_size=60) | st.text(max_size=30).filter(lambda t: "\ud800" > t or t.isprintable()))
def test_bpe_on_any_text(tiktoken_encoding, text):
    model = bpe.model(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    ids = model.encode_texts([text])[0]
    assert np.frombuffer(ids, dtype="<u4").tolist() == tiktoken_encoding.encode_ordinary(text)
    assert bpe.token_bytes(P.path("byte_bpe_multi_50k.tiktoken")).decode(ids) == text.encode()


def test_bpe_long_pieces(tiktoken_encoding):
    model, pick = bpe.model(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(3)
    for text in ("a" * 5000, "ab" * 1500, "aaaaab" * 400, "é" * 700, "".join(pick.choice("abcdefgh") for _ in range(6000)), "日本" * 600):
        assert np.frombuffer(model.encode_texts([text])[0], dtype="<u4").tolist() == tiktoken_encoding.encode_ordinary(text)


def test_token_files(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    file, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    found = {r["doc_id"]: r for r in tokenfile.token_file_query(docs, str(tmp_path / "t"), P.path("byte_bpe_50k.json")).collect()}
    for doc_id in sorted(texts):
        ids = [*file.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        assert (found[doc_id]["start"], found[doc_id]["n_tokens"], found[doc_id]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    some = tokenfile.read(spark, str(tmp_path / "t"), [7, 3]).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in some] == [3, 7] and some[0]["start"] == found[3]["start"]


def test_token_encoder_on_odd_texts():
    from tokenizers import Tokenizer

    file, coder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokenfile.encoder(P.path("byte_bpe_50k.json"))
    odd = ["", " ", "a  b", " lead", "trail ", "a\n b", "x <|endoftext|> y", "a\u00a0 b", "don't stop", "a\tb c", "é ü", "a\x1c b", "one two\nthree four", "日本 語"]
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in coder.encode(odd)] == [file.encode(t, add_special_tokens=False).ids for t in odd]


def _fingerprint(text: str) -> int:
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(points: np.ndarray, radius: int) -> list[int]:
    up = list(range(len(points)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, b = sorted((root(i), root(j)))
        up[b] = a
    return [root(i) for i in range(len(points))]


def test_simhash_components(docs, texts):
    ids = sorted(texts)
    prints = np.array([_fingerprint(texts[i]) for i in ids], dtype=np.uint64)
    expected = {i: (f"{int(p):016x}", ids[g]) for i, p, g in zip(ids, prints, _groups(prints, 2))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_query(docs).collect()} == expected


def test_vantage_point_tree_loses_no_link(spark, monkeypatch):
    pick = np.random.default_rng(5)
    base = pick.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    close = [b ^ np.uint64(1 << int(k)) for b in base[:120] for k in pick.integers(0, 63, 3)]
    ball = [base[0] ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(12) for j in range(i)]
    points = np.unique(np.concatenate([base, close, ball]))
    nodes = simhash.fit_tree(pick.permutation(points)[:200], 12, 2)
    leaves, index = simhash.route(points, nodes, 2)
    assert len(set(leaves.tolist())) > 8
    together = defaultdict(set)
    for leaf, i in zip(leaves.tolist(), index.tolist()):
        together[leaf].add(i)
    near = np.argwhere(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    assert all(any(i in m and j in m for m in together.values()) for i, j in near.tolist())
    monkeypatch.setattr(simhash, "LOCAL_POINTS", 40)
    local = simhash.link_leaf(points.reshape(-1, 1), 2)
    expected = _groups(points, 2)
    assert len(set(zip(local.tolist(), expected))) == len(set(expected)) == len(set(local.tolist()))


def test_near_duplicates_at_similarity(spark):
    pick, words = random.Random(2), [f"w{i}" for i in range(4000)]
    rows = []
    for k in range(30):
        text = [pick.choice(words) for _ in range(300)]
        near = list(text)
        for _ in range(3):
            near[pick.randrange(300)] = "changed"
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(text)), (10 * k + 3, " ".join(pick.choice(words) for _ in range(300)))]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[10 * k + 2] == 10 * k and found[10 * k + 3] == 10 * k + 3 for k in range(30))
    assert sum(found[10 * k + 1] == 10 * k for k in range(30)) >= 29


def test_components_of_a_chain(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (200, 200)] + [(300, 300 + k) for k in range(1, 30)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{300 + k: 300 for k in range(30)}}


def _repeated(texts: list[str], length: int = 200) -> list[tuple]:
    data, seen, out = [t.encode() for t in texts], defaultdict(int), []
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] += 1
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        starts = int((np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) == 1).sum())
        out.append((len(d), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(d, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_repeated_bytes(spark):
    pick = random.Random(5)

    def some(n):
        return "".join(pick.choice("abcdefgh ") for _ in range(n))

    base, texts = some(3000), [some(pick.randint(0, 900)) for _ in range(20)]
    for n in (150, 199, 200, 201, 250, 400, 800) * 4:
        a = pick.randrange(2200)
        texts.append(some(pick.randint(0, 300)) + base[a : a + n] + some(pick.randint(0, 300)))
    texts += ["a" * 1000, "a" * 200, "a" * 199, "ab" * 300, "abc" * 70, "", "é" * 150, base[:200], ("ab" * 150) + "c" + ("ab" * 99), base[100:700] + "|" + base[100:700]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r[0]: tuple(r[1:]) for r in repeats.repeats_query(frame).collect()}
    assert [found[i] for i in range(len(texts))] == _repeated(texts)


def test_repeated_bytes_of_frequent_passages(spark, monkeypatch):
    """Grams of many places are dealt out over all tasks, and give the same spans."""
    monkeypatch.setattr(repeats, "HOT", 5)
    pick = random.Random(7)

    def some(n):
        return "".join(pick.choice("abcdefgh ") for _ in range(n))

    passage, texts = some(700), []
    for k in range(40):
        a, b = pick.randint(0, 300), pick.randint(400, 700)
        texts.append(some(pick.randint(0, 200)) + passage[a:b] + some(pick.randint(0, 200)))
    texts += ["x" * 700] * 8 + [passage] * 4 + [passage[:350] + "#" + passage[351:]] * 2 + ["", some(300)]
    rows = [(None if k % 7 == 0 else k, t) for k, t in enumerate(texts)] + [(-(2**63), passage[:200])]
    found = sorted(map(repr, (tuple(r) for r in repeats.repeats_query(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert found == sorted(repr((i, *row)) for (i, _), row in zip(rows, _repeated([t for _, t in rows])))


@pytest.mark.parametrize("hot", [3, 4_000])
def test_passages_twice_in_one_text(spark, monkeypatch, hot):
    """A passage that a text holds twice, far apart or overlapping itself, takes nothing that stands between with it,
    whatever counts as a frequent gram."""
    monkeypatch.setattr(repeats, "HOT", hot)
    pick = random.Random(11)

    def some(n):
        return "".join(pick.choice("abcdefgh ") for _ in range(n))

    passage = some(260)
    texts = [some(pick.randint(50, 400)) + passage + some(pick.randint(50, 400)) for _ in range(8)]
    texts.append(some(70) + passage + some(1_000) + passage + some(80))
    texts.append(some(60) + passage[:230] + some(500) + passage[20:] + some(300) + passage)
    texts.append(some(40) + passage[:210] + passage[30:] + some(40) + passage[5:215])
    period = some(90)
    texts += [some(30) + period * k + some(30) for k in (3, 4, 5, 9)] + [period * 3 + some(400) + period * 4]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r[0]: tuple(r[1:]) for r in repeats.repeats_query(frame).collect()}
    assert [found[i] for i in range(len(texts))] == _repeated(texts)


def test_repeated_bytes_of_documents(docs, texts):
    ids = sorted(texts)
    found = {r[0]: tuple(r[1:]) for r in repeats.repeats_query(docs).collect()}
    assert [found[i] for i in ids] == _repeated([texts[i] for i in ids])


def test_maximal_repeats_have_all_occurrences():
    pick = random.Random(1)
    body = bytes(pick.randrange(97, 120) for _ in range(260))
    pieces = [b"x" + body, b"y" + body, b"z" + body[:230], b"q" * 50 + body[50:120], b"w" * 50 + body[50:]]
    groups = sorted(repeats.maximal_repeats(pieces, np.array([101, 101, 101, 100, 100]), np.zeros(5, dtype=np.int64), 200))
    assert groups == [(210, [(0, 51), (1, 51), (4, 50)]), (230, [(0, 1), (1, 1), (2, 1)]), (260, [(0, 1), (1, 1)])]
    starts, ends = repeats.repeat_extents(pieces, np.array([101, 101, 101, 100, 100]), np.zeros(5, dtype=np.int64), 200)
    assert list(zip(starts.tolist(), ends.tolist())) == [(1, 261), (1, 261), (1, 231), (0, 0), (50, 260)]


def test_nearest_neighbours_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = frame.collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    found = defaultdict(list)
    for r in ann.ann_query(frame).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for n in np.flatnonzero(ids % 20 == 0).tolist():
        scores = vectors @ vectors[n]
        best = [j for j in np.lexsort([ids, -scores]) if j != n][:20]
        own = found[ids[n]]
        assert len(own) == 20 and all(abs(scores[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for v, s in own)
        assert [s for _, s in own] == sorted((s for _, s in own), reverse=True)
        hits, total = hits + len({v for v, _ in own} & set(ids[best].tolist())), total + 20
    assert hits / total >= 0.9


def test_hadamard_rotation_keeps_lengths():
    vectors = np.random.default_rng(1).normal(size=(20, 48))
    turned = ann.rotate(vectors, 3)
    assert turned.shape == (20, 64) and np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(vectors, axis=1))


def test_contamination(spark, docs, texts):
    items = {r["item_id"]: decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()}
    expected = {(d, i) for d, t in texts.items() for i, s in items.items() if s in decontaminate.normal(t)}
    found = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op5_decontamination"](spark, ROOT).collect()}
    assert expected <= found and len(found - expected) <= 0.1 * len(expected) + 1


def test_contamination_with_edits():
    pick = random.Random(4)
    item = " ".join("".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 8))) for _ in range(40))
    index = decontaminate.Windows([(1, item)])
    for k in range(30):
        edited = list(item)
        for _ in range(int(0.06 * len(item))):
            p = pick.randrange(len(edited))
            edited[p : p + 1] = pick.choice(["x", "", "xy"])
        around = "".join(pick.choice("klmnop ") for _ in range(400))
        assert index.matches(decontaminate.code_points(around + "".join(edited) + around))
        assert not index.matches(decontaminate.code_points("".join(pick.choice("abcdefghij ") for _ in range(2000))))


def test_alignment_is_the_edit_distance():
    def brute(w, t):
        row = [0] * (len(t) + 1)
        for c in w:
            new = [row[0] + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    pick = random.Random(6)
    for _ in range(200):
        w = "".join(pick.choice("abc") for _ in range(20))
        t = "".join(pick.choice("abc") for _ in range(pick.randint(1, 5))) + "".join(c for c in w if pick.random() > 0.1)
        best, hit = brute(w, t), decontaminate.align(decontaminate.code_points(w), decontaminate.code_points(t), -20, 30, 6)
        assert (hit[0] if hit else 7) == min(best, 7)
        letters = {ord(c): sum(1 << i for i, x in enumerate(w) if x == c) for c in "abc"}
        assert [decontaminate.within(letters, 20, decontaminate.code_points(t), k) for k in range(12)] == [best <= k for k in range(12)]


def test_toxicity_held_out(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    held = labels.where("doc_id % 4 = 0")
    chain = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    assert len(chain.carried[1]) == 1  # the second model sees the first one's probability
    scored = toxicity.score(docs.join(held, "doc_id").select("doc_id", "text", "toxic"), chain).collect()
    toxic = [r["p_toxic"] >= toxicity.REJECT_AT for r in scored if r["toxic"]]
    clean = [r["p_toxic"] >= toxicity.REJECT_AT for r in scored if r["toxic"] == 0]
    # a tenth of the toxic labels here sit on junk texts without any toxic word
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def _best_turns(model, rows: list[str]) -> set[tuple]:
    """Every best reading of a conversation, by trying all paths: (role, text) of its turns."""
    import itertools

    lines = []
    for row in rows:
        marked = chat.read_line(row.split("\n")[0])[0] is not None
        for i, line in enumerate(row.split("\n")):
            marker, at = chat.read_line(line)
            lines.append((line, at, marker, model.emission(marker, i == 0, marked, chat.shape_of(line[at:], len(row) if i == 0 and not marked else None))))
    scored = []
    for states in itertools.product(range(6), repeat=len(lines)):
        steps = [model.start[states[0]], *(model.step[a, b] for a, b in zip(states, states[1:]))]
        scored.append((sum(steps) + sum(seen[s] for s, (*_, seen) in zip(states, lines)), states))
    best, readings = max(scored)[0], set()
    for total, states in scored:
        if total > best - 1e-9:
            turns = []
            for s, (line, at, marker, _) in zip(states, lines):
                text = line[at:] if marker and s == 2 * marker[0] else line
                if s % 2 == 0:
                    turns.append([chat.ROLES[s // 2], text])
                else:
                    turns[-1][1] += "\n" + text
            readings.add(tuple(map(tuple, turns)))
    return readings


def test_chats_are_the_best_readings(spark):
    pick, parts = random.Random(8), ["User: ", "Assistant: ", "### Human: ", "A: ", "Answer: ", "", "", "", "[system] "]
    spoken = ["hi", "x" * 90, "what is it?", "", "no: " * 200]
    chats = {c: ["\n".join(pick.choice(parts) + pick.choice(spoken) for _ in range(pick.randint(1, 2))) for _ in range(pick.randint(1, 3))] for c in range(25)}
    frame = spark.createDataFrame([(c, t, pick.choice(["user", "assistant", None]), row) for c, rows in chats.items() for t, row in enumerate(rows)], "conv_id long, turn long, role string, text string")
    model = chat.fit(frame)
    found = defaultdict(list)
    for r in chat.chat_query(frame).orderBy("conv_id", "turn").collect():
        found[r["conv_id"]].append((r["role"], r["text"]))
        assert r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>\n"
    assert all(tuple(found[c]) in _best_turns(model, rows) for c, rows in chats.items() if sum(row.count("\n") + 1 for row in rows) <= 6)


def test_words_that_look_like_markers_stay(spark):
    model = chat.fit(spark.read.parquet(f"{ROOT}/conversations.parquet"))
    thought = "Let me think.\nAnswer: 42\nModel: gamma ray\nA: first choice"
    frame = spark.createDataFrame([(1, 0, None, "User: What is it?"), (1, 1, None, thought)], "conv_id long, turn long, role string, text string")
    found = [(r["turn"], r["text"]) for r in chat.format_chats(frame, model).orderBy("turn").collect()]
    assert found == [(0, "What is it?"), (1, thought)]


def test_long_conversations_settle():
    model = chat.Model(np.ones((3, 3)), np.ones(3), np.ones((3, chat.SHAPES)))
    decoder, whole, early = chat.Decoder(model), [], 0
    for i in range(1000):
        whole += decoder.add(("User: ", "Bot: ", "")[i % 3] + "line" if i % 4 == 0 else "line", 9 if i % 4 == 0 else None)
        early = max(early, len(decoder.lines))
    whole += decoder.close()
    assert len(whole) == 1000 and early < 200


def test_hidden_roles_come_back(spark):
    from pyspark.sql import functions as F

    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    hidden = F.xxhash64("conv_id") % 4 == 0
    model = chat.fit(frame.where(~hidden))
    held = frame.where(hidden)
    made = chat.format_chats(held.withColumn("role", F.lit(None).cast("string")), model)
    right = made.alias("m").join(held.alias("h"), ["conv_id", "turn"]).where("m.role = h.role").count()
    assert right >= 0.88 * held.count()
    # the role column takes no part in decoding
    assert sorted(made.collect()) == sorted(chat.format_chats(held, model).collect())


def test_transcripts(spark):
    frame = spark.createDataFrame([(1, 0, None, "User: hi\nhow are you?\nAssistant: fine\n\nthanks\nUser: ok"), (2, 0, None, "**Human:** a\n### Assistant: b")], "conv_id long, turn long, role string, text string")
    model = chat.fit(spark.read.parquet(f"{ROOT}/conversations.parquet"))
    found = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.format_chats(frame, model).orderBy("conv_id", "turn").collect()]
    assert found == [(1, 0, "user", "hi\nhow are you?"), (1, 1, "assistant", "fine\n\nthanks"), (1, 2, "user", "ok"), (2, 0, "user", "a"), (2, 1, "assistant", "b")]


def test_line_threshold_above_two(spark):
    frame = spark.createDataFrame([(1, "a long enough line\nx"), (2, "a long enough line"), (3, " A LONG enough line\ny")], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame, min_docs=3).collect()}
    assert kept == {1: "a long enough line\nx", 2: "", 3: "y"}
    assert linededup.dedup_lines(frame, min_docs=4).where("n_dropped > 0").count() == 0


def test_native_operators_stay_native(spark):
    for name in ("op8_line_dedup", "op9_url_filter"):
        plan = queries.QUERIES[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_word_memory_gives_the_ids_of_the_library(monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 300)
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.json")
    own, library = tokenfile.Encoder(file), Tokenizer.from_file(file)
    pick = random.Random(3)
    words = ["a", "Word", "été", "don't", "it's", "x1", "42", "…", "***", "word,", "word's.", "#", "日本語", "", "", "\n", "\n", "\t", " ", "\x1c", " ", "<|endoftext|>", "٣", "á,"]
    texts = [" ".join(pick.choice(words) for _ in range(pick.randint(0, 12))) for _ in range(2_000)]
    texts += ["".join(pick.choice(" \nab.,'") for _ in range(pick.randint(0, 9))) for _ in range(4_000)]
    for at in range(0, len(texts), 500):
        block = texts[at : at + 500]
        expected = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in block]
        assert own.encode(block) == expected
