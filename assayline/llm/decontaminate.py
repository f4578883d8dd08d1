"""Benchmark decontamination by q-gram filtering in overlapping diagonal bands, verified by banded alignment.

Both sides are lower-cased, and runs of white space become one space. The shortest passage that counts is PASSAGE_WORDS
words of an item, or WINDOW characters where so many words are longer. A window of that size starts at every word of an
item, and every STEP characters within a long word; an item shorter than that is one window. Of equal windows of an item
the first stands for all. If a text holds a window of m characters with at most k = ERROR_RATE * m edits, then at least
m + 1 - q - k * q of the window's q-grams occur in it on at most k + 1 neighbouring diagonals (q-gram lemma). Bands of
2 (k + 1) diagonals that overlap by half contain any such group. The q-grams of an item, in segments of SEGMENT
characters at most, are counted once in each band of the segment, then those of each window among them. Regions of bands
that reach the bound are aligned within their band; what stays within k edits is a match.

Shared q-grams are looked at in slices of a text that overlap by more than any band, in parts of the slice or of the
segments where there are more than HITS of them: texts and items that repeat themselves take time, not memory. A band
whose count allows no fewer edits than an item's best match so far is not aligned, and equal regions are aligned once.

Benchmark windows go to the tasks in blocks of BLOCK_CHARS characters or so; a larger benchmark takes more passes over
the documents, one after another. A Python worker builds the index of a block once.

Defined cases: a null or empty text or item matches nothing; a window too short for the lemma with q = Q takes the
longest q that leaves a bound of one q-gram (a window of under 8 characters is looked for as it is); rows that repeat an
item_id are one item with the windows of all, and rows without one are one item too, with a null item_id; repeated
documents each give their rows; an empty benchmark gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import materialise, shared_folder

Q = 8
ERROR_RATE = 0.1
PASSAGE_WORDS = 13
WINDOW = 96
LONG_WORD = 16
STEP = 4
BLOCK_CHARS = 4_000_000
SEGMENT = 512
#: Positions of a text that are looked up at once, and the fewest that a slice is cut down to.
SLICE, LEAST_SLICE = 1 << 16, 1 << 11
#: More than any band of a segment spans in a text.
OVERLAP = SEGMENT + 4 * WINDOW
HITS = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)

SCHEMA = "doc_id long, item_id long, distance int, window_start int, window_chars int, text_start long, text_end long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h, size, base = codes.astype(np.uint64), 1, _BASE
    powers = {1: (h, base)}
    while 2 * size <= q:
        h, base, size = h[: len(h) - size] * base + h[size:], np.uint64(int(base) ** 2 % (1 << 64)), 2 * size
        powers[size] = (h, base)
    out, at = h, size
    while at < q:  # the rest of q in falling powers of two
        size //= 2
        if q - at >= size:
            h, base = powers[size]
            out = out[: len(codes) - at - size + 1] * base + h[at : at + len(codes) - at - size + 1]
            at += size
    return out[:n] * _SPREAD


def window_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of every window of an item in its normal form."""
    words, at = [], 0
    for word in text.split(" "):
        words.append((at, at + len(word)))
        at += len(word) + 1
    spans = set()
    for n, (first, last) in enumerate(words):
        for start in (first, *(range(first + STEP, last, STEP) if last - first > LONG_WORD else ())):
            if n + PASSAGE_WORDS <= len(words):
                spans.add((start, min(words[n + PASSAGE_WORDS - 1][1], start + WINDOW)))
            elif start + WINDOW <= len(text):
                spans.add((start, start + WINDOW))
    if len(words) < PASSAGE_WORDS and len(text) >= WINDOW:
        spans.add((len(text) - WINDOW, len(text)))
    return sorted(spans) or [(0, len(text))]


class Grams:
    """The q-gram index of segments, by their places in ``segments``."""

    def __init__(self, q: int, segments: list[np.ndarray]):
        self.q, self.n = q, len(segments)
        hashes = [gram_hashes(c, q) for c in segments]
        counts = np.array([len(h) for h in hashes], dtype=np.int64)
        every = np.concatenate(hashes)
        owner = np.repeat(np.arange(self.n), counts)
        place = np.concatenate([np.arange(c) for c in counts])
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first, number = np.unique(every[order], return_index=True, return_inverse=True)
        self.last = np.append(self.first[1:], len(order))
        self.keys = number * self.n + self.owner  # ascending
        bits = min(24, max(12, len(self.grams).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(self.grams >> self.shift).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position in the text, segment, position in the segment) of the shared q-grams, all those of a band together
        at least once."""
        total, at = len(codes) - self.q + 1, 0
        while at < total:
            stop = min(at + SLICE, total)
            h = gram_hashes(codes[at : stop + self.q - 1], self.q)
            near = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
            g = np.minimum(np.searchsorted(self.grams, h[near]), len(self.grams) - 1)
            same = self.grams[g] == h[near]
            if same.any():
                yield from self._multiplied(near[same] + at, g[same])
            at = total if stop == total else stop - OVERLAP

    def _multiplied(self, where: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each position with every place of its q-gram: about HITS at a time."""
        total, low, high = int((self.last[gram] - self.first[gram]).sum()), int(where[0]), int(where[-1]) + 1
        if total > HITS and high - low > LEAST_SLICE:
            middle = (low + high) // 2
            for a, b in ((low, middle + OVERLAP // 2), (middle - OVERLAP // 2, high)):
                some = slice(*np.searchsorted(where, [a, b]))
                if some.start < some.stop:
                    yield from self._multiplied(where[some], gram[some])
            return
        cuts = np.linspace(0, self.n, min(self.n, 1 + total // HITS) + 1).astype(np.int64)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            first, last = (self.first[gram], self.last[gram]) if b - a == self.n else (np.searchsorted(self.keys, gram * self.n + x) for x in (a, b))
            n = last - first
            post = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield np.repeat(where, n), self.owner[post], self.place[post]


class Part:
    """The windows of one q: their segments, and the q-grams of these."""

    def __init__(self, q: int, segments: list[tuple[int, int, int, np.ndarray]], items: list[np.ndarray], bound: np.ndarray, edits: np.ndarray):
        self.windows = [own for *_, own in segments]
        self.begin = [a for _, a, _, _ in segments]
        self.grams = Grams(q, [items[n][a:b] for n, a, b, _ in segments])
        self.least = np.array([bound[own].min() for own in self.windows])
        self.span = np.array([edits[own].max() + 1 for own in self.windows])


class Windows:
    """The windows of a block of benchmark items (item_id, text), and the q-grams of the items for each q that some window
    takes."""

    def __init__(self, items: list[tuple[int | None, str]]):
        items = [(item_id, text) for item_id, text in items if text]
        self.codes = [code_points(text) for _, text in items]
        spans = []
        for n, (_, text) in enumerate(items):
            first: dict[str, tuple[int, int]] = {}
            for a, b in window_spans(text):
                first.setdefault(text[a:b], (a, b))
            spans += [(n, *span) for span in sorted(first.values())]
        self.of, self.start, self.end = np.array(spans, dtype=np.int64).reshape(-1, 3).T
        self.item = [items[n][0] for n in self.of.tolist()]
        self.length = self.end - self.start
        self.edits = (self.length * ERROR_RATE).astype(np.int64)
        self.q = np.minimum(Q, self.length // (self.edits + 1))
        self.bound = self.length + 1 - self.q * (self.edits + 1)
        self.letters: dict[int, dict[int, int]] = {}
        self.parts = [Part(q, self._segments(np.flatnonzero(self.q == q)), self.codes, self.bound, self.edits) for q in np.unique(self.q).tolist()]

    def _segments(self, windows: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        """(item, start, end, windows): runs of an item of SEGMENT characters at most that hold these windows."""
        out: list[tuple[int, int, int, list[int]]] = []
        for w, n, a, b in zip(windows.tolist(), self.of[windows].tolist(), self.start[windows].tolist(), self.end[windows].tolist()):
            if out and out[-1][0] == n and b - out[-1][1] <= SEGMENT:
                out[-1] = (n, out[-1][1], max(out[-1][2], b), [*out[-1][3], w])
            else:
                out.append((n, a, b, [w]))
        return [(n, a, b, np.array(own)) for n, a, b, own in out]

    def _full(self, part: Part, where: np.ndarray, segment: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
        """(segment, [(window, lowest and highest diagonal, q-grams)]) of every band where a window reaches its bound."""
        least, span, q = part.least, part.span, part.grams.q
        enough = np.bincount(segment, minlength=len(least))[segment] >= least[segment]
        where, segment, place = where[enough], segment[enough], place[enough]
        if not len(where):
            return
        group = (where - place) // span[segment]
        # each hit counts in both bands that hold its group of diagonals
        keys = np.concatenate([np.stack([segment, group, place]), np.stack([segment, group - 1, place])], axis=1)
        keys = keys[:, np.lexsort(keys[::-1])]
        fresh = np.ones(keys.shape[1], dtype=bool)
        fresh[1:] = (np.diff(keys, axis=1) != 0).any(axis=0)
        keys = keys[:, fresh]  # each q-gram of a segment counts once in a band
        edge = np.flatnonzero(np.append(True, (np.diff(keys[:2], axis=1) != 0).any(axis=0)))
        stop = np.append(edge[1:], keys.shape[1])
        some = stop - edge >= least[keys[0, edge]]
        last, found = -1, []
        for a, b in zip(edge[some].tolist(), stop[some].tolist()):
            n = int(keys[0, a])
            if n != last and found:
                yield last, found
                found = []
            last, low, own, places = n, int(keys[1, a] * span[n]), part.windows[n], keys[2, a:b] + part.begin[n]
            count = np.searchsorted(places, self.end[own] - q, "right") - np.searchsorted(places, self.start[own])
            hit = np.flatnonzero(count >= self.bound[own])
            found += [(w, low, low + 2 * int(span[n]) - 1, c) for w, c in zip(own[hit].tolist(), count[hit].tolist())]
        if found:
            yield last, found

    def matches(self, codes: np.ndarray, one: bool = False) -> list[tuple[int, int, int, int]]:
        """(window, edits, start, end) of the best window of every item (the first found with ``one``) that the text holds
        within the window's edit budget: fewest edits, then the first in the item."""
        if not len(self.of) or not len(codes):
            return []
        best: dict[int, tuple[int, int, int, int]] = {}
        for part in self.parts:
            settled = np.zeros(len(part.windows), dtype=bool)
            known: dict[tuple[int, bytes], tuple | None] = {}
            for where, segment, place in part.grams.hits(codes):
                if settled.any():
                    open_ = ~settled[segment]
                    where, segment, place = where[open_], segment[open_], place[open_]
                for n, full in self._full(part, where, segment, place):
                    item = int(self.of[part.windows[n][0]])
                    found = self._better(codes, part, n, full, best.get(item), known)
                    if found:
                        best[item] = found
                        if one:
                            return [found]
                    if item in best:  # nothing of this segment can be better
                        settled[n] |= best[item][1] == 0 and best[item][0] <= part.windows[n][0]
        return list(best.values())

    def _letters(self, w: int) -> dict[int, int]:
        """Where each character stands in a window, as bits."""
        if w not in self.letters:
            if len(self.letters) >= 4_096:
                self.letters.clear()
            places: dict[int, int] = {}
            for i, c in enumerate(self.codes[self.of[w]][self.start[w] : self.end[w]].tolist()):
                places[c] = places.get(c, 0) | 1 << i
            self.letters[w] = places
        return self.letters[w]

    def _better(self, codes: np.ndarray, part: Part, n: int, full: list[tuple[int, int, int, int]], best: tuple | None, known: dict) -> tuple | None:
        """The best of these bands, if it is better than ``best``: (window, edits, start, end)."""
        found = None
        rank = lambda x: (x[1], x[0]) if x else (1 << 30, 0)
        for exact in (True, False):
            for w, low, high, count in sorted(full):
                m, q = int(self.length[w]), part.grams.q
                fewest = 0 if exact else max(1, -(-(m + 1 - count) // q) - 1)
                if (fewest, w) >= min(rank(best), rank(found)):
                    continue
                window, shift, budget = self.codes[self.of[w]][self.start[w] : self.end[w]], int(self.start[w]) - part.begin[n], int(self.edits[w])
                low, high = low + shift, high + shift
                if exact:
                    hit = verbatim(window, codes, low, high)
                else:
                    begin = max(0, low - budget)
                    region = codes[begin : max(begin, high + m + 2 * budget)]
                    key = (w, begin - low, region.tobytes())
                    if key not in known:
                        if len(known) >= 4_096:
                            known.clear()
                        hit = align(window, codes, low, high, budget) if within(self._letters(w), m, region, budget) else None
                        known[key] = (hit[0], hit[1] - low, hit[2] - low) if hit else None
                    hit = known[key] and (known[key][0], known[key][1] + low, known[key][2] + low)
                if hit and (hit[0], w) < min(rank(best), rank(found)):
                    found = (w, *hit)
            if found and found[1] == 0:
                break
        return found


def verbatim(window: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(0, start, end) of the first place of the window on the diagonals low..high."""
    m = len(window)
    for d in range(max(low, 0), min(high, len(text) - m) + 1):
        if np.array_equal(text[d : d + m], window):
            return 0, d, d + m
    return None


def within(letters: dict[int, int], m: int, text: np.ndarray, budget: int) -> bool:
    """Whether a window of ``m`` characters (given by its letters' places) lies in any part of the text within the budget:
    a column of the alignment at a time, its steps up and down as bits. Most regions that share enough q-grams end here."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, edits = full, 0, m
    for c in text.tolist():
        same = letters.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(across | up)), up & across
        edits += 1 if rise & top else -1 if fall & top else 0
        if edits <= budget:
            return True
        rise, same = rise << 1 & full, same | down
        up, down = (fall << 1 & full) | (full & ~(same | rise)), rise & same
    return False


def align(window: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the whole window on the diagonals low..high (text minus window), widened
    by the budget; None if it needs more edits than that."""
    m = len(window)
    same = verbatim(window, text, low, high)
    if same:
        return same
    low, width = low - budget, high - low + 1 + 2 * budget
    far = m + budget + 1
    # cell c of row i is text position low + c + i; a row's cells: (edits, start)
    cost = np.where((np.arange(width) + low >= 0) & (np.arange(width) + low <= len(text)), 0, far)
    origin = np.arange(width) + low
    for i in range(1, m + 1):
        at = np.arange(width) + low + i
        inside = (at >= 0) & (at <= len(text))
        char = text[np.clip(at - 1, 0, len(text) - 1)]
        diagonal = cost + (char != window[i - 1])
        diagonal[at <= 0] = far
        skip = np.append(cost[1:] + 1, far)
        new, start = np.where(diagonal <= skip, diagonal, skip), np.where(diagonal <= skip, origin, np.append(origin[1:], 0))
        new[~inside] = far
        # a cell may take any cell on its left at one edit a step: the least (edits less column, start) up to it
        packed = np.minimum.accumulate(((new - np.arange(width)) << 40) + start + (1 << 32))
        cost, origin = (packed >> 40) + np.arange(width), (packed & ((1 << 40) - 1)) - (1 << 32)
        if cost.min() > budget:
            return None
    c = int(cost.argmin())
    return int(cost[c]), int(origin[c]), low + c + m


#: In a Python worker: the latest broadcast block and its index.
_BUILT: list = []


def _index(shared) -> Windows:
    """The index of a broadcast block, built once in a Python worker."""
    if not _BUILT or _BUILT[0] is not shared:
        _BUILT[:] = [shared, Windows(shared.value)]
    return _BUILT[1]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items in blocks of about BLOCK_CHARS characters."""
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = total // BLOCK_CHARS + 1
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        yield sorted(((r[0], normal(r[1])) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds a passage of: the best window and where it lies (in
    characters of the normal form)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    row_schema = SCHEMA + ", row long"

    def scan(items: list[tuple[int | None, str]], rows: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)  # about BLOCK_CHARS characters, whatever the benchmark

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                found = []
                for doc_id, text, row in zip(batch.column("doc_id"), batch.column("text"), batch.column("row")):
                    best: dict[int | None, tuple] = {}
                    for w, edits, start, end in index.matches(code_points(normal(text.as_py()))):
                        one = (edits, int(index.start[w]), int(index.length[w]), start, end)
                        best[index.item[w]] = min(best.get(index.item[w], one), one)
                    found += [(doc_id.as_py(), item, *one, row.as_py()) for item, one in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((*types, pa.int64()))], names=[*names, "row"])

        return rows.mapInArrow(run, row_schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    blocks = _blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return scan(first, rows).select(*names)
    folder = shared_folder(docs.sparkSession)
    rows = materialise(rows, "rows", folder)  # a document keeps its number from pass to pass
    parts = [materialise(scan(items, rows), f"found{k}", folder) for k, items in enumerate(chain((first, second), blocks))]
    found = reduce(DataFrame.unionByName, parts)
    best = F.min(F.struct(*names[2:])).alias("best")  # an item's texts may be in several blocks
    return found.groupBy("row", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage, each by its own text."""

    def keep(items: list[tuple[int | None, str]], rows: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)  # as above

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(code_points(normal(t.as_py())), one=True) for t in batch.column("text")], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    blocks, folder = _blocks(benchmark), None
    docs, items = keep(next(blocks), docs), next(blocks, None)
    while items is not None:
        folder = folder or shared_folder(docs.sparkSession)
        docs = keep(items, materialise(docs, uuid4().hex, folder))
        items = next(blocks, None)
    return docs
