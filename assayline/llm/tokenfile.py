"""Token-id files: one shared zstandard dictionary, a frame for each document, an offset index for single reads.

Layout of a written folder (all parquet, so that any store Spark can write will do):

``dictionary/``  one row: dict_hash (sha256 of the dictionary), dictionary bytes, n_sample.
``blocks/``      rows in ascending doc_id order within part and block: part, block, dict_hash, first_start (ids of the
                 part before the block), n_tokens, the index arrays doc_ids, counts and offsets (one more than
                 documents), and data, the frames one after another. A block holds about BLOCK_BYTES of ids, so a
                 reader opens one row and one frame for one document.
``parts/``       one row per part: part, n_tokens, start (ids of all parts before it).

The dictionary is fitted on a bounded sample: the whole texts of the SAMPLE_DOCS documents whose hashed doc_id is
smallest, which is the same sample at every partitioning. Everything else covers all documents.

Defined cases: a null or empty text has the end id alone; rows with a null doc_id come first; rows that repeat a doc_id
are all written, in any order among themselves; an empty table gives no blocks, and a dictionary of zero bytes.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.llm.common import text_blocks

END_ID = 0
SAMPLE_DOCS = 512
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
BLOCK_BYTES = 4 << 20
#: Bytes of input that a range of documents holds, and how many ranges there are at most.
PART_BYTES, MOST_PARTS = 64 << 20, 1 << 17
BLOCK_CHARS = 1_000_000
REMEMBERED = 600_000

BLOCK_SCHEMA = "part int, block int, dict_hash string, first_start long, n_tokens long, doc_ids array<long>, counts array<int>, offsets array<int>, data binary"


class Encoder:
    """The tokenizers library with a memory of words.

    For byte-level BPE without normalizer, a space or line end between two other characters always starts a new piece, and
    a space goes with the word after it. A text whose only white space are spaces and line ends, never three together
    nor two at its end, is therefore the sequence of its words, each with what stands before it. Marks at the end
    of a word are a piece of their own. New words go to the library in one line, whose ids part again where tokens begin
    with the space (or are the line end). Any other text, and any other kind of tokenizer, goes to it whole.
    """

    _other_space = tuple(c for c in map(chr, range(0x3100)) if c.isspace() and c not in " \n")
    _long_runs = re.compile(r"[ \n]{3}|[ \n][ \n]\Z")
    _marks = ",.;:!?*$%#"

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as text:
            made = json.load(text)
        pre, special = made.get("pre_tokenizer") or {}, [t for t in made.get("added_tokens", []) if t["special"]]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer")
        plain = plain and len(made["added_tokens"]) == 1 and special and not (special[0]["lstrip"] or special[0]["rstrip"] or special[0]["single_word"])
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the space, as byte-level vocabularies write it
        self.line_end = self._library(["\n"])[0]
        self.special = special[0]["content"] if plain and len(self.line_end) == 1 else None
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.known_marks: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        words: list[str] = []  # each without the space before it; the first of a text as if a line end stood before it
        simple, ends = [], []
        for i, text in enumerate(texts):
            if self.special and text and self.special not in text and self._parts(text):
                at = len(words)
                words += text.replace("\n", " \n").split(" ")
                words[at] = "\n" + words[at]
                simple.append(i)
                ends.append(len(words))
        if len(self.known) > REMEMBERED:
            self.known, self.known_before = {}, self.known
        ids = list(map(self.known.get, words))
        missing = [k for k, known in enumerate(ids) if known is None]
        if missing:
            self._learn({words[k] for k in missing})
        for k in missing:
            ids[k] = self.known[words[k]]
        for i, a, b in zip(simple, [0, *ends], ends):
            out[i] = b"".join(ids[a:b])[4:]
        others = [i for i, coded in enumerate(out) if coded is None]
        for i, coded in zip(others, self._library([texts[i] for i in others])):
            out[i] = coded.tobytes()
        return out

    def _parts(self, text: str) -> bool:
        """Whether the text is the sequence of its words."""
        for space in self._other_space:
            if space in text:
                return False
        runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        return not (runs and self._long_runs.search(text))

    def _learn(self, missing: set[str]) -> None:
        known, before = self.known, self.known_before
        new, after_end, marked = [], [], []
        for w in missing:
            if w in before:
                known[w] = before[w]
            elif w.isalpha():
                new.append(w)
            else:
                base = w.rstrip(self._marks)
                if base != w and base[-1:].isalpha():
                    marked.append((w, base))
                    w = base
                    if w in known or w in missing:
                        continue
                if w[:1] == "\n":
                    after_end.append(w[1:])
                else:
                    new.append(w)
        known.update(self._parted({w for w in new if w}, " "))
        known.update([("\n" + w, blob) for w, blob in self._parted({w for w in after_end if w}, "\n")])
        known.update({"": self._library([" "])[0].tobytes(), "\n": self.line_end.tobytes()})
        marks = list({w[len(base) :] for w, base in marked}.difference(self.known_marks))
        self.known_marks.update(zip(marks, (x.tobytes() for x in self._library(marks))))
        for w, base in marked:
            known[w] = known[base] + self.known_marks[w[len(base) :]]

    def _parted(self, words: set[str], before: str) -> Iterator[tuple[str, bytes]]:
        """Each word with the ids of it and what stands before it."""
        if not words:
            return iter(())
        ids = self._library([before + before.join(words)])[0]
        starts = np.flatnonzero(self.begins[ids] if before == " " else ids == self.line_end[0]) * 4
        blob, starts = ids.tobytes(), starts.tolist()
        return zip(words, [blob[a:b] for a, b in zip(starts, [*starts[1:], len(blob)])], strict=True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def fit_dictionary(docs: DataFrame, tokenizer_file: str, sample_docs: int = SAMPLE_DOCS) -> tuple[bytes, int]:
    """A zstandard dictionary trained on the serialised ids of a bounded sample, in one task; empty if it can't be."""
    chosen = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()
    if not chosen:
        return b"", 0
    sample = docs.where(F.col("doc_id").isin([r[0] for r in chosen])).groupBy("doc_id").agg(F.min("text").alias("text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        rows = sorted((i, t or "") for b in batches for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()))
        parts = [ids for block in text_blocks(pa.array([t for _, t in rows], pa.large_string()), BLOCK_CHARS) for ids in encoder(tokenizer_file).encode(block)]
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, [p for p in parts if p]).as_bytes()
        except zstandard.ZstdError:  # too few or too short samples
            trained = b""
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([trained], pa.binary()), "n": pa.array([len(rows)], pa.int64())})

    found = sample.repartition(1).mapInArrow(train, "dictionary binary, n long").collect()
    return (bytes(found[0][0]), found[0][1]) if found else (b"", 0)


def write(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = END_ID) -> None:
    """Encode every text, append ``end_id`` and write the files under ``folder``."""
    spark = docs.sparkSession
    dictionary, n_sample = fit_dictionary(docs, tokenizer_file)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, dictionary, n_sample)], "dict_hash string, dictionary binary, n_sample long").write.parquet(f"{folder}/dictionary")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        coder, part = encoder(tokenizer_file), TaskContext.get().partitionId()
        state = {"block": 0, "first": 0, "size": 0, "ids": [], "counts": [], "frames": []}

        def emit() -> pa.RecordBatch:
            counts = state["counts"]
            row = {
                "part": pa.array([part], pa.int32()), "block": pa.array([state["block"]], pa.int32()), "dict_hash": pa.array([dict_hash]),
                "first_start": pa.array([state["first"]], pa.int64()), "n_tokens": pa.array([sum(counts)], pa.int64()),
                "doc_ids": pa.array([state["ids"]], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int32())),
                "offsets": pa.array([np.cumsum([0, *map(len, state["frames"])]).astype(np.int32)], pa.list_(pa.int32())), "data": pa.array([b"".join(state["frames"])], pa.binary()),
            }
            state.update(block=state["block"] + 1, first=state["first"] + sum(counts), size=0, ids=[], counts=[], frames=[])
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            ids = iter(batch.column("doc_id").to_pylist())
            for block in text_blocks(batch.column("text"), BLOCK_CHARS):
                for doc_id, coded in zip(map(lambda _: next(ids), block), coder.encode(block)):
                    coded += end
                    state["ids"].append(doc_id)
                    state["counts"].append(len(coded) // 4)
                    state["frames"].append(pack.compress(coded))
                    state["size"] += len(coded)
                    if state["size"] >= BLOCK_BYTES:
                        yield emit()
        if state["ids"]:
            yield emit()

    # ranges of about PART_BYTES by Spark's estimate of the input, and no fewer than a shuffle has
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-size // PART_BYTES)))
    in_order = F.col("doc_id").asc_nulls_first()
    docs.select("doc_id", "text").repartitionByRange(parts, in_order).sortWithinPartitions(in_order).mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")
    totals = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    # one row for each part of the file, however many documents there are
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")).write.parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents in the files (all, or those asked for)."""
    dictionary, dict_hash = spark.read.parquet(f"{folder}/dictionary").select("dictionary", "dict_hash").first()
    dictionary, wanted = bytes(dictionary), None if doc_ids is None else set(doc_ids)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    if wanted is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, doc_ids))))
    starts = spark.read.parquet(f"{folder}/parts").select("part", "start")
    placed = blocks.join(F.broadcast(starts), "part")  # one row of two numbers for each part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                if one.column("dict_hash")[0].as_py() != dict_hash:
                    raise ValueError("a block was written with another dictionary")
                data, offsets, counts = (one.column(c)[0].as_py() for c in ("data", "offsets", "counts"))
                ids = one.column("doc_ids")[0].as_py()
                begin = np.cumsum([one.column("start")[0].as_py() + one.column("first_start")[0].as_py(), *counts]).tolist()
                keep = [k for k in range(len(ids)) if wanted is None or ids[k] in wanted]
                for at in range(0, len(keep), 256):
                    some = keep[at : at + 256]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([ids[k] for k in some], pa.int64()), "start": pa.array([begin[k] for k in some], pa.int64()), "n_tokens": pa.array([counts[k] for k in some], pa.int64()),
                        "ids": pa.array([unpack.decompress(data[offsets[k] : offsets[k + 1]], max_output_size=4 * counts[k]) for k in some], pa.binary()),
                    })

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_file_query(docs: DataFrame, folder: str, tokenizer_file: str) -> DataFrame:
    write(docs, folder, tokenizer_file)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
