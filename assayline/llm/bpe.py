"""Byte-level BPE over a public rank file: encoding and decoding in numpy matrices inside Arrow-batched tasks.

Text is cut by the pre-split pattern; each distinct piece of a block of documents is encoded once. Pieces that are no
vocabulary entry themselves go into padded matrices of one length class. Every round, each row merges its leftmost
pair of minimum rank; pair ranks come from an open-addressing hash table, and rows that are done leave the matrix.
A piece of over LONG_PIECE bytes (a long run without white space) is merged on its own: all occurrences of the minimum
pair go at once wherever that provably equals merging them one by one, else only the leftmost does.

Defined cases: a null or empty text has no ids; ids are little-endian unsigned 32-bit integers in one binary value;
decoding gives back exactly the UTF-8 bytes of the text. Special tokens do not exist: their strings are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import text_blocks

NONE = np.int32(2**31 - 1)
LONG_PIECE = 512
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 384, LONG_PIECE)
CLASS_OF = [next(w for w in WIDTHS if w >= n) for n in range(LONG_PIECE + 1)]
#: Cells of one matrix, pieces looked at together, characters of a block of documents, pieces remembered by a worker.
MATRIX_CELLS = 1 << 19
PIECES_AT_ONCE = 250_000
IDS_AT_ONCE = 250_000
BLOCK_CHARS = 500_000
REMEMBERED = 120_000


def read_ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}


class TokenBytes:
    """The bytes of every id, all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: bytes) -> bytes:
        parts, numbers = [], np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(numbers), IDS_AT_ONCE):
            block = numbers[at : at + IDS_AT_ONCE]
            lengths = self.length[block]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.start[block] - (ends - lengths), lengths)
            parts.append(self.bytes[shift + np.arange(len(shift))].tobytes())
        return b"".join(parts)


class RankModel:
    """A rank file with its pair table."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        self.ranks = read_ranks(rank_file)
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        ]
        self._build_table(np.array(pairs, dtype=np.int64))
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}

    def _build_table(self, pairs: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(3 * len(pairs) + 1))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys, ranks = (pairs[:, 0] << 32) | pairs[:, 1], pairs[:, 2].astype(np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            placed = np.zeros(len(at), dtype=bool)
            placed[first] = True
            placed &= free
            self.slots[at[placed]], self.values[at[placed]] = keys[placed], ranks[placed]
            keys, ranks, at = keys[~placed], ranks[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE if it has none or one side is padding (negative)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(keys)
        found = self.slots[at]
        result = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[open_]]
            hit = found == keys[open_]
            result[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        result[(left < 0) | (right < 0)] = NONE
        return result

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {w: [] for w in WIDTHS}
        whole = list(map(self.ranks.get, pieces))
        for i, (rank, length) in enumerate(zip(whole, map(len, pieces))):
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif length > LONG_PIECE:
                out[i] = self._encode_long(pieces[i])
            elif length:
                classes[CLASS_OF[length]].append(i)
        for width, members in classes.items():
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(members), step):
                block = members[at : at + step]
                for i, ids in zip(block, self._encode_matrix([pieces[i] for i in block], width)):
                    out[i] = ids
        return out

    def _encode_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        ids = np.where(np.arange(width) < lengths[:, None], self.of_byte[raw], np.int32(-1)).astype(np.int32)
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        rows, done = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE, dtype=np.int32)
            over = best == NONE
            if over.any():
                blob, row_bytes = ids[over].astype("<i4").tobytes(), 4 * ids.shape[1]
                for k, (row, count) in enumerate(zip(rows[over].tolist(), (ids[over] >= 0).sum(axis=1).tolist())):
                    done[row] = blob[k * row_bytes : k * row_bytes + 4 * count]
                rows, ids, ranks, at, best = rows[~over], ids[~over], ranks[~over], at[~over], best[~over]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            ids[every, at] = best
            after = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, after + (after > at[:, None]), axis=1)
            pair = after[:-1]
            ranks = np.take_along_axis(ranks, pair + (pair >= at[:, None]), axis=1)
            right = at < ids.shape[1] - 1
            ranks[every[right], at[right]] = self.pair_ranks(best[right], ids[every[right], at[right] + 1])
            left = at > 0
            ranks[every[left], at[left] - 1] = self.pair_ranks(ids[every[left], at[left] - 1], best[left])
        return done

    def _encode_long(self, piece: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)]
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            hits = np.flatnonzero(ranks == best)
            number = np.arange(len(hits))
            starts = np.ones(len(hits), dtype=bool)
            starts[1:] = np.diff(hits) != 1
            run = number - np.maximum.accumulate(np.where(starts, number, 0))
            chosen = hits[run % 2 == 0]
            if len(chosen) > 1:
                merged = np.full(len(chosen), best, dtype=np.int32)
                beyond = np.where(chosen + 2 < len(ids), ids[np.minimum(chosen + 2, len(ids) - 1)], -1)
                before = np.where(chosen > 0, ids[np.maximum(chosen - 1, 0)], -1)
                before[1:][np.diff(chosen) == 2] = best
                if min(self.pair_ranks(merged, beyond).min(), self.pair_ranks(before, merged).min()) < best:
                    chosen = chosen[:1]
            ids[chosen] = best
            ids, ranks = np.delete(ids, chosen + 1), np.delete(ranks, chosen)
            new = chosen - np.arange(len(chosen))
            touched = np.unique(np.concatenate([new[new < len(ranks)], new[new > 0] - 1]))
            ranks[touched] = self.pair_ranks(ids[touched], ids[touched + 1])
        return ids.astype("<u4").tobytes()

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts. Each text's pieces are taken in blocks, so that a very long one stays bounded."""
        if sum(map(len, texts)) <= 2 * BLOCK_CHARS:
            split = [self.pattern.findall(t) for t in texts]
            self._learn({p for pieces in split for p in pieces})
            return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
        out = []
        for text in texts:
            parts, matches = [], self.pattern.finditer(text)
            while block := [m.group() for m in islice(matches, PIECES_AT_ONCE)]:
                self._learn(set(block))
                parts.append(b"".join(map(self.known.__getitem__, block)))
            out.append(b"".join(parts))
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are in neither of the two generations remembered; the older one goes when the newer is full."""
        if len(self.known) > REMEMBERED:
            self.known, self.known_before = {}, self.known
        missing = pieces.difference(self.known)
        if again := missing.intersection(self.known_before):
            self.known.update(zip(again, map(self.known_before.__getitem__, again)))
            missing -= again
        new = list(missing)
        self.known.update(zip(new, self.encode_pieces([p.encode() for p in new])))


_MODELS: dict[tuple[str, str], RankModel] = {}
_TOKENS: dict[str, TokenBytes] = {}


def model(rank_file: str, pattern: str) -> RankModel:
    """The model of a rank file, loaded once in each worker process."""
    if (rank_file, pattern) not in _MODELS:
        _MODELS[rank_file, pattern] = RankModel(rank_file, pattern)
    return _MODELS[rank_file, pattern]


def token_bytes(rank_file: str) -> TokenBytes:
    if rank_file not in _TOKENS:
        _TOKENS[rank_file] = TokenBytes(read_ranks(rank_file))
    return _TOKENS[rank_file]


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the binary column ``ids`` in place of ``text``."""
    rest = [c for c in docs.columns if c not in (text, ids)]
    schema = docs.select(*rest, F.lit(b"").alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(rank_file, pattern)
        for batch in batches:
            at = 0
            for block in text_blocks(batch.column(text), BLOCK_CHARS):
                part = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(bpe.encode_texts(block), pa.binary())], names=[*rest, ids])

    return docs.select(*rest, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the binary column ``decoded``: the bytes that the ids stand for."""
    rest = [c for c in encoded.columns if c != decoded]
    schema = encoded.select(*rest, F.lit(b"").alias(decoded)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(rank_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [tokens.decode(x or b"") for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(out, pa.binary())], names=[*rest, decoded])

    return encoded.select(*rest).mapInArrow(run, schema)


def bpe_query(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    coded = decode(encode(docs.select("doc_id", "text"), rank_file, pattern), rank_file)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def encoded_corpus(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (binary) and whether the ids decode to the text's bytes."""
    coded = decode(encode(docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha")), rank_file, pattern), rank_file)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("_sha")).alias("round_trip"))
