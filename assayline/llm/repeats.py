"""Suffix-array dedup: every byte covered by a 200-byte string that also starts anywhere else is removed.

A string of LENGTH bytes has an anchor: the leftmost of its grams (GRAM bytes) with the smallest hash. Equal strings
have equal anchors, so it is enough to compare, gram by gram, the pieces of text around anchors; a piece is the union of
the strings that have this anchor. Grams that occur once, nine in ten, never leave the first pass.

Within a gram, equal pieces repeat as a whole. Distinct ones go into an enhanced suffix array of the suffixes that start
at the anchors: sorted, with common prefixes. A stack scan builds the tree of common-prefix intervals. The suffixes of
an interval part by their left extension; those that still have LENGTH bytes in common are all the occurrences of one
repeat, not just neighbouring ones, and get covered as far as it goes.

Two passes read the texts. The first counts grams. Their repeated ones, hashed to a bit field of fixed size, thin out
the second pass, which carries pieces to their grams; the bit field only saves work, the counts are taken again there.

A gram of over HOT places (a passage that very many documents share) never meets in one task: its places are dealt out
over all tasks, equal pieces are counted with combining aggregates, and the strings of the distinct ones are counted one
by one, by hash. What is left of a text is cut out where it was read; only texts that lose something (a bit field of
fixed size tells which may) travel to their spans, compressed.

Defined cases: a null or empty text has no bytes; texts under LENGTH bytes lose nothing; rows that repeat a doc_id are
texts of their own (and so lose what they share); rows with a null doc_id take part like others.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import materialise, remove_folder, shared_folder

#: Bytes of a string that counts as repeated; up to 2,000 fit the packed columns below.
LENGTH = 200
GRAM = 32
FILTER_BITS = 26
BATCH_PIECES = 12_000
MEMBERS_AT_ONCE = 1_000_000
SENT_PIECES = 300_000
#: Places of a gram from which on they do not meet in one task.
HOT = 4_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    parts = []
    for at in range(0, len(data) - GRAM + 1, _BLOCK):
        block = data[at : at + _BLOCK + GRAM - 1]
        up, down = _powers(len(block))
        total = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * down[: len(block) - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        parts.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(parts)


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(rows of position, start and end; gram hashes) of the anchors of all strings of ``length`` bytes; start and end
    are those of the union of the strings with this anchor."""
    if len(data) < length:
        return np.empty((0, 3), dtype=np.int64), np.empty(0, dtype=np.uint64)
    h, width = _gram_hashes(data), length - GRAM + 1
    rows = np.concatenate([h, np.full(-len(h) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    ends = np.append(starts[1:], n)
    found = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        value = least[start]
        at = start + int((h[start : start + width] == value).argmax())
        found.append((at, start, min(at + 1, end)))
        while at < end - 1:  # the same minimum again, further right
            start, at = at + 1, at + 1 + int((h[at + 1 : at + 1 + width] == value).argmax())
            found.append((at, start, min(at + 1, end)))
    places = np.array(found, dtype=np.int64)
    places[:, 2] += length - 1
    return places, h[places[:, 0]]


def pieces_of(data: bytes, length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """Of one text: (gram, piece hash, position, start, end) of the first two places of each piece, and the spans of
    further ones."""
    import xxhash

    places, grams = anchors(np.frombuffer(data, dtype=np.uint8), length)
    seen: dict[tuple[int, int], int] = {}
    rows, spans = [], []
    for (at, a, b), gram in zip(places.tolist(), grams.view(np.int64).tolist()):
        key = (gram, xxhash.xxh3_64_intdigest(data[a:b], at - a) - (1 << 63))
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= 2:
            rows.append((*key, at, a, b))
        elif spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return rows, spans


def scan(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of sorted strings with ``least`` or more in common, by a stack."""
    out, stack = [], []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            size, first = stack.pop()
            out.append((size, first, i))
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


class AnchoredArray:
    """The enhanced suffix array of the suffixes that start at the anchors of distinct pieces, by family (gram).

    ``text`` holds a piece per row, anchors under one another; ``left`` and ``right`` say how much of a row is text
    before and from the anchor on. Equal strings have equal anchors, so pieces need comparing in this alignment only,
    and two of a family never are one place of the corpus.
    """

    def __init__(self, text: np.ndarray, left: np.ndarray, right: np.ndarray, family: np.ndarray, windows: np.ndarray, length: int):
        self.text, self.left, self.right, self.windows, self.length = text, left, right, windows, length
        self.anchor = length - GRAM
        suffixes = [(f, row[:n].tobytes()) for f, row, n in zip(family.tolist(), text[:, self.anchor :], right.tolist())]
        self.order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), dtype=np.int64)
        a, b = self.order[:-1], self.order[1:]
        equal = text[a, self.anchor :] == text[b, self.anchor :]
        common = np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1)) if len(a) else np.empty(0, dtype=np.int64)
        self.lcp = np.where(family[a] == family[b], np.minimum(common, np.minimum(right[a], right[b])), 0)

    def intervals(self) -> np.ndarray:
        """(common prefix, first, last) of the interval tree's nodes with a gram or more in common."""
        return np.array(scan(self.lcp.tolist(), GRAM), dtype=np.int64).reshape(-1, 3)

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(node, member, depth) of every occurrence of a repeat, sorted by node and left extension.

        A node's suffixes part by what stands left of them: those that have the string of ``length`` bytes in common
        that ends with the node's common prefix are occurrences of one repeat.
        """
        nodes = self.intervals()
        sizes = nodes[:, 2] - nodes[:, 1] + 1
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // MEMBERS_AT_ONCE)) + 1).tolist(), len(nodes)]
        for x, y in zip(cuts, cuts[1:]):
            n = sizes[x:y]
            node = np.repeat(np.arange(x, y), n)
            member = self.order[np.repeat(nodes[x:y, 1] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            depth = nodes[node, 0]
            has = self.left[member] >= self.length - depth
            node, member, depth = node[has], member[has], depth[has]
            if not len(node):
                continue
            mark = self.windows[member, depth - GRAM]
            by = np.lexsort([mark, node])
            node, member, depth, mark = node[by], member[by], depth[by], mark[by]
            same = (node[1:] == node[:-1]) & (mark[1:] == mark[:-1])
            at = np.flatnonzero(same)
            for k in range(0, len(at), 4096):  # the marks are hashes: compare the strings themselves
                some = at[k : k + 4096]
                columns = (depth[some] - GRAM)[:, None] + np.arange(self.length)
                same[some] = (self.text[member[some][:, None], columns] == self.text[member[some + 1][:, None], columns]).all(axis=1)
            shared = np.append(same, False) | np.append(False, same)
            yield node[shared], member[shared], depth[shared]

    def ends(self) -> np.ndarray:
        """The column where each piece's longest repeat ends, 0 if it has none."""
        out = np.zeros(len(self.text), dtype=np.int64)
        for _, member, depth in self.groups():
            np.maximum.at(out, member, self.anchor + depth)
        return out


def _aligned(pieces: list[bytes], left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, right, windows): the rows of an anchored array, and the hash of each string of ``length`` bytes."""
    anchor, width = length - GRAM, 2 * length - GRAM
    text = np.frombuffer(b"".join((b"\0" * (anchor - n) + p).ljust(width, b"\0") for p, n in zip(pieces, left.tolist())), dtype=np.uint8).reshape(len(pieces), width)
    right = np.array([len(p) for p in pieces], dtype=np.int64) - left
    up, down = _powers(width)
    total = np.zeros((len(pieces), width + 1), dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=total[:, 1:])
    return text, right, (total[:, length:] - total[:, : width - length + 1]) * down[: width - length + 1]


def repeat_extents(pieces: list[bytes], left: np.ndarray, family: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) within each piece of what repeats in its family, (0, 0) without any. The ends come from the array of
    the texts from the anchor on, the starts from the array of the texts read backwards."""
    text, right, windows = _aligned(pieces, left, length)
    end = AnchoredArray(text, left, right, family, windows, length).ends()
    back = AnchoredArray(np.ascontiguousarray(text[:, ::-1]), right - GRAM, left + GRAM, family, windows[:, ::-1], length).ends()
    shift = length - GRAM - left
    return np.where(end > 0, text.shape[1] - back - shift, 0), np.where(end > 0, end - shift, 0)


def maximal_repeats(pieces: list[bytes], left: np.ndarray, family: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(bytes, [(piece, offset), ...]) of every maximal repeat: all occurrences in the family, which go on differently
    on both sides."""
    text, right, windows = _aligned(pieces, left, length)
    array = AnchoredArray(text, left, right, family, windows, length)
    for node, member, depth in array.groups():
        mark = windows[member, depth - GRAM].view(np.int64)
        cuts = [0, *(np.flatnonzero((np.diff(node) != 0) | (np.diff(mark) != 0)) + 1).tolist(), len(node)]
        for a, b in zip(cuts, cuts[1:]):
            size = int(depth[a])
            before = {p: text[p, array.anchor - left[p] : array.anchor][::-1].tobytes() for p in member[a:b].tolist()}
            after = {p: int(text[p, array.anchor + size]) if right[p] > size else -1 - p for p in before}
            own = sorted(before, key=before.__getitem__)
            common = [len(os.path.commonprefix([before[p], before[q]])) for p, q in zip(own, own[1:])]
            for extra, first, last in scan(common, length - size):
                members = own[first : last + 1]
                if len({after[p] for p in members}) > 1:
                    yield extra + size, [(p, int(left[p]) - extra) for p in sorted(members)]


def _keyed(docs: DataFrame) -> DataFrame:
    """_d and _t name a row by its doc_id (a hash of its text, where there is none) and by half a hash of its text, for
    rows that repeat a doc_id with another one."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("_d"), F.shiftright(F.xxhash64(F.lit(1), text), 32).cast("int").alias("_t"), F.encode(text, "UTF-8").alias("_bytes"))


def repeated_grams(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(gram, mixed, hot): grams with two places or more, whether their pieces differ, and whether there are over HOT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [r[:2] for data in batch.slice(at, 256).column("_bytes").to_pylist() for r in pieces_of(data, length)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["gram", "piece"])

    counted = _keyed(docs).select("_bytes").mapInArrow(run, "gram long, piece long").groupBy("gram").agg(F.count("*").alias("n"), F.min("piece").alias("a"), F.max("piece").alias("b"))
    return counted.where("n > 1").select("gram", (F.col("a") < F.col("b")).alias("mixed"), (F.col("n") > HOT).alias("hot"))


def bit_field(values: DataFrame, column: str) -> np.ndarray:
    """A field of 2^FILTER_BITS bits, set where the low bits of a hash point (grams at anchors are small, so their high
    bits are alike); its size never grows."""
    bit = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = values.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("v")).toArrow()
    field = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    field[words["w"].to_numpy()] = words["v"].to_numpy()
    return field


def marked(field: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    bits = values & ((1 << FILTER_BITS) - 1)
    return ((field[bits >> 6] >> (bits & 63)) & 1).astype(bool)


#: place packs start (40 bits), bytes (12) and bytes before the anchor (12); bytes are zstandard frames. Rows of one text's
#: own spans have no gram; their place packs start (40 bits) and bytes (24).
PIECE_SCHEMA = "gram long, piece long, _d long, _t int, place long, bytes binary"
_PIECE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())


def _parts(start: int, end: int) -> Iterator[tuple[int, int]]:
    """A span in parts whose sizes fit 24 bits."""
    for at in range(start, end, (1 << 24) - 1):
        yield at, min(end, at + (1 << 24) - 1)


def _piece_rows(rows: list[tuple], more: tuple = (), names: tuple = ()) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((*_PIECE_TYPES, *more))]
    return pa.RecordBatch.from_arrays(columns, names=[*(c.split()[0] for c in PIECE_SCHEMA.split(", ")), *names])


def carried_pieces(docs: DataFrame, grams: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces whose gram may repeat, from each task at least once with their bytes where they may differ; spans that
    repeat within a text have no gram. Rows of one gram have salt 0 unless it is a hot one."""
    session = docs.sparkSession.sparkContext
    # 8 MB each, fixed
    repeated, mixed, hot = (session.broadcast(bit_field(part, "gram")) for part in (grams, grams.where("mixed"), grams.where("hot")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False)
        sent: set[tuple[int, int]] = set()  # the bytes of a piece go out once from a task, as a rule
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, out = batch.slice(at, 128), []
                if len(sent) > SENT_PIECES:
                    sent.clear()
                for d, t, data in zip(*(part.column(c).to_pylist() for c in ("_d", "_t", "_bytes"))):
                    rows, spans = pieces_of(data, length)
                    out += [(None, None, d, t, x << 24 | y - x, None, d % 65_521 + 1) for a, b in spans for x, y in _parts(a, b)]
                    values = np.array([r[0] for r in rows], dtype=np.int64)
                    flags = (marked(f.value, values).tolist() for f in (repeated, mixed, hot))
                    for (gram, piece, place, a, b), keep, differs, many in zip(rows, *flags):
                        if keep:
                            new = differs and (gram, piece) not in sent
                            if new:
                                sent.add((gram, piece))
                            out.append((gram, piece, d, t, a << 24 | b - a << 12 | place - a, pack.compress(data[a:b]) if new else None, (d + place) % 65_521 + 1 if many else 0))
                yield _piece_rows(out, (pa.int32(),), ("salt",))

    return _keyed(docs).select("_d", "_t", "_bytes").mapInArrow(run, PIECE_SCHEMA + ", salt int")


def settled_families(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans (rows without a gram) of everything that repeats, and the rows of hot grams as they are. Rows with a salt are
    dealt out by it and pass through."""
    import zstandard

    def solve(families: list[dict[int, list]]) -> list[tuple]:
        unpack = zstandard.ZstdDecompressor()
        out, data, left, family, owner = [], [], [], [], []
        for number, members in enumerate(families):
            for piece in members.values():
                at, content, size, before = piece
                if len(at) > 1:
                    out += [(None, None, d, t, a << 24 | size, None) for d, t, a in at]
                if len(members) > 1 and content is not None and size >= length:
                    data.append(unpack.decompress(content))
                    left.append(before)
                    family.append(number)
                    owner.append(at)
        if data:
            starts, ends = repeat_extents(data, np.array(left, dtype=np.int64), np.array(family, dtype=np.int64), length)
            for i in np.flatnonzero(ends).tolist():
                if len(owner[i]) == 1:
                    d, t, a = owner[i][0]
                    out.append((None, None, d, t, a + int(starts[i]) << 24 | int(ends[i] - starts[i]), None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families, current, last, held = [], {}, None, 0
        for batch in batches:
            own = batch.filter(pa.compute.equal(batch.column("salt"), 0))
            if own.num_rows < batch.num_rows:
                yield batch.filter(pa.compute.greater(batch.column("salt"), 0)).select(range(6))
            for gram, piece, d, t, packed, content in zip(*(own.column(k).to_pylist() for k in range(6))):
                a, size, before = packed >> 24, packed >> 12 & 4095, packed & 4095
                if gram != last:
                    if current and (len(current) > 1 or len(next(iter(current.values()))[0]) > 1):
                        families.append(current)
                        held += len(current)
                    if held >= BATCH_PIECES:
                        yield _piece_rows(solve(families))
                        families, held = [], 0
                    current, last = {}, gram
                known = current.setdefault(piece, [[], content, size, before])
                known[0].append((d, t, a))
                if known[1] is None:
                    known[1] = content
        if current:
            families.append(current)
        yield _piece_rows(solve(families))

    return pieces.repartition("gram", "salt").sortWithinPartitions("gram").mapInArrow(run, PIECE_SCHEMA)


def hot_spans(places: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_d, _t, span) of what repeats among the places of hot grams. Equal pieces repeat as a whole. Of the others each
    string of ``length`` bytes is counted by its hash; counts combine before they meet, and Spark splits frequent keys
    in the joins."""
    start, size = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(F.lit(4095))
    pieces = places.groupBy("gram", "piece").agg(F.count("*").alias("n"), F.min("_d").alias("_d"), F.min("_t").alias("_t"), F.min("place").alias("place"), F.max("bytes").alias("bytes"))
    again = pieces.where("n > 1").select("gram", "piece")
    whole = places.select("gram", "piece", "_d", "_t", "place").join(again, ["gram", "piece"]).select("_d", "_t", F.shiftleft(start, 24).bitwiseOR(size).alias("span"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        unpack, digest = zstandard.ZstdDecompressor(), xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for gram, n, d, t, packed, content in zip(*(part.column(k).to_pylist() for k in ("gram", "n", "_d", "_t", "place", "bytes"))):
                    if content is not None:
                        data, a, before = unpack.decompress(content), packed >> 24, packed & 4095
                        out += [(gram, digest(data[k : k + length], before - k) - (1 << 63), n == 1, d, t, a, a + k) for k in range(len(data) - length + 1)]
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["gram", "string", "alone", "_d", "_t", "at", "start"])

    # the strings of one piece all hold its anchor, so those that repeat cover one run; a text may hold several pieces
    strings = pieces.mapInArrow(run, "gram long, string long, alone boolean, _d long, _t int, at long, start long")
    shared = strings.groupBy("gram", "string").agg(F.count("*").alias("n")).where("n > 1").select("gram", "string")
    found = strings.where("alone").join(shared, ["gram", "string"]).groupBy("gram", "_d", "_t", "at").agg(F.min("start").alias("a"), F.max("start").alias("b"))
    return whole.unionByName(found.select("_d", "_t", F.shiftleft("a", 24).bitwiseOR(F.col("b") - F.col("a") + length).alias("span")))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (the maximal removed runs, array of start and end) and kept (the bytes left) of every row."""
    folder, session = shared_folder(docs.sparkSession), docs.sparkSession.sparkContext
    grams = materialise(repeated_grams(docs, length), "grams", folder)
    settled = materialise(settled_families(carried_pieces(docs, grams, length), length), "settled", folder)
    spans = settled.where("gram is null").select("_d", "_t", F.col("place").alias("span"))
    if grams.where("hot").limit(1).count():
        spans = spans.unionByName(hot_spans(settled.where("gram is not null"), length))
    spans = materialise(spans.groupBy("_d", "_t").agg(F.collect_list("span").alias("found")), "spans", folder)
    remove_folder(docs.sparkSession, f"{folder}/grams")
    remove_folder(docs.sparkSession, f"{folder}/settled")
    losing = session.broadcast(bit_field(spans.select(F.xxhash64("_d", "_t").alias("h")), "h"))  # 8 MB, fixed
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(~marked(losing.value, batch.column("h").to_numpy())))
            sizes = pa.compute.binary_length(part.column("_bytes")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array([[]] * part.num_rows, kind), part.column("_bytes")], names=["doc_id", "n_bytes", "spans", "kept"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            part = batch.filter(pa.array(marked(losing.value, batch.column("h").to_numpy())))
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                frames = pa.array([pack.compress(data) for data in some.column("_bytes").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "_d", "_t")), frames], names=["doc_id", "_d", "_t", "frame"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, sizes, runs, kept = batch.slice(at, 256), [], [], []
                for frame, found in zip(part.column("frame").to_pylist(), part.column("found").to_pylist()):
                    data = unpack.decompress(frame)
                    merged: list[list[int]] = []
                    for a, b in sorted((x >> 24, (x >> 24) + (x & 0xFFFFFF)) for x in found or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    edges = [0, *(x for pair in merged for x in pair), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    sizes.append(len(data))
                    runs.append([{"start": a, "end": b} for a, b in merged])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    named = _keyed(docs).withColumn("h", F.xxhash64("_d", "_t"))
    losers = named.mapInArrow(packed, "doc_id long, _d long, _t int, frame binary").join(spans.hint("shuffle_hash"), ["_d", "_t"], "left")
    return named.select("doc_id", "_bytes", "h").mapInArrow(whole, schema).unionByName(losers.select("doc_id", "frame", "found").mapInArrow(cut, schema))


def repeats_query(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
