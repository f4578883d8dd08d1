"""Which of many terms a text contains, by an index of the terms' rarest grams instead of a comparison of all with all.

Every term is listed under one of its grams (GRAM bytes of UTF-8, or the whole term if it is shorter): of PLACES grams
spread over it, the one that texts hold least often. A text meets only the terms that are listed under a gram of its own,
and longer ones than the gram are then looked for in it. Texts are read twice, once to count grams and once to meet terms;
both times only grams that pass a bit field of the terms' own become rows.

Groups (``within``) of at most FEW terms need no grams: their texts are compared with each of their terms, which is a bounded
number of comparisons for each text. Larger groups go by the grams.

Defined cases: null texts hold no term; null and empty terms are in no text; a term that is listed twice (with one key) is
one; terms and texts are compared as they are, case and accents included. Terms of equal rank: the smaller first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assayline.session import shared_folder

#: Bytes of a gram, as many as a whole number holds, and grams of a term that are counted.
GRAM, PLACES = 8, 64
#: Terms of a group that are compared one by one.
FEW = 64
#: Bytes of texts whose grams are worked out at a time.
STEP = 1 << 20
#: Bits of the largest field of grams, 8 MB.
FIELD = 26
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _written(frame: DataFrame) -> DataFrame:
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts without nulls, and some more, and where each text begins and ends among them."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.concatenate([data, np.zeros(GRAM, np.uint8)]), ends - ends[0]


def _codes(data: np.ndarray, at: int, to: int) -> np.ndarray:
    """The GRAM bytes from each place on as a number; its low bytes are the shorter grams there."""
    return np.ndarray(to - at, "<u8", data, at, (1,)).copy()


def _cut(codes: np.ndarray, size: int) -> np.ndarray:
    return codes & np.uint64((1 << 8 * size) - 1)


def _slots(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * _MIX) >> np.uint64(64 - bits)


def _longs(*names: str) -> list[StructField]:
    return [StructField(n, LongType()) for n in names]


def _term_grams(terms: DataFrame) -> DataFrame:
    """``terms`` (_term and others) with _size, _gram and _slot, its place in a field, of each gram."""
    schema = StructType([*terms.schema, *_longs("_size", "_gram", "_slot")])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.slice(at, 1_000)
                data, ends = _flat(part["_term"])
                lengths = np.diff(ends)
                sizes = np.minimum(lengths, GRAM)
                places = lengths - sizes + 1
                steps = -(-places // PLACES)
                n = -(-places // steps)
                row = np.repeat(np.arange(len(part)), n)
                start = ends[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * steps[row]
                codes = np.ndarray(len(data) - GRAM + 1, "<u8", data, 0, (1,))[start] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (GRAM - sizes[row]).astype(np.uint64)))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(sizes[row]), pa.array(codes.view(np.int64)), pa.array(_slots(codes, FIELD).view(np.int64))], names=schema.names)

    return terms.mapInArrow(listed, schema)


def _field(grams: DataFrame) -> tuple[list[int], int, np.ndarray]:
    """The sizes of grams, and a field of bits (their number's logarithm, the bits) that has one for each gram."""
    bits = F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 as int))"))
    words = grams.groupBy("_size", F.shiftright("_slot", 6).alias("_word")).agg(bits.alias("_bits")).toArrow()  # GRAM times the field at most
    at, held = words["_word"].to_numpy(), words["_bits"].to_numpy().view(np.uint8).reshape(-1, 8)
    slots = np.nonzero(np.unpackbits(held, axis=1, bitorder="little"))
    slots = at[slots[0]] * 64 + slots[1]
    width = int(min(FIELD, max(12, np.ceil(np.log2(64 * len(slots) + 1)))))
    whole = np.zeros(1 << width, np.bool_)
    whole[slots >> (FIELD - width)] = True
    return sorted(set(words["_size"].to_pylist())), width, np.packbits(whole, bitorder="little")


def _hits(batch: pa.RecordBatch, text: str, sizes: list[int], width: int, field: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """size, rows and grams, each pair once, of the grams of a batch's texts that the field may hold."""
    data, ends = _flat(batch[text])
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP, "right")) - 1)
        found = {s: [] for s in sizes}
        for at in range(int(ends[first]), int(ends[last]), STEP):
            codes = _codes(data, at, min(at + STEP, int(ends[last])))
            for s in sizes:
                cut = _cut(codes, s)
                slots = _slots(cut, width)
                place = np.nonzero((field[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1)[0]
                row = np.searchsorted(ends, place + at, "right") - 1
                inside = place + at + s <= ends[row + 1]
                found[s].append(_once(row[inside], cut[place[inside]]))
        for s, parts in found.items():
            if parts:  # none where all texts are empty
                yield s, *(parts[0] if len(parts) == 1 else _once(*map(np.concatenate, zip(*parts, strict=True))))
        first = last


def _once(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), np.bool_)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def _held(texts: DataFrame, columns: list[str], text: str, grams: DataFrame, counted: bool) -> DataFrame | None:
    """``columns``, _size and _gram of the grams that each text holds, ``counted`` with _n, how often for equal ``columns``.
    A few come that are not in ``grams``. None if there is no gram."""
    sizes, width, field = _field(grams)
    if not sizes:
        return None
    names = [*columns, "_size", "_gram"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, row, code in _hits(batch, text, sizes, width, field) if len(batch) else ():
                if len(row):
                    own = [batch[c].take(pa.array(row)) for c in columns]
                    found = pa.table([*own, pa.array(np.full(len(row), size)), pa.array(code.view(np.int64))], names=names)
                    if counted:
                        found = found.group_by(names).aggregate([([], "count_all")]).rename_columns([*names, "_n"])
                    yield from found.to_batches()

    given = texts.where(F.col(text).isNotNull()).select(*columns, text)
    held = given.mapInArrow(read, StructType([*(given.schema[c] for c in columns), *_longs("_size", "_gram", *(["_n"] if counted else []))]))
    return held.groupBy(*names).agg(F.sum("_n").alias("_n")) if counted else held


def _met(texts: DataFrame, terms: DataFrame, key: str, text: str, within: list[str]) -> DataFrame | None:
    """``within``, ``key`` and the other columns of ``terms`` (``within``, _term and others, each once) that a text may
    contain, since it holds the gram that they are listed under; a term of GRAM bytes or fewer is that gram. None if there
    is no term."""
    grams, on = _written(_term_grams(terms)), [*within, "_size", "_gram"]
    counts = _held(texts, within, text, grams, True)
    if counts is None:
        return None
    # a gram that no text holds settles that the term is in none
    rated = grams.join(counts, on, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = rated.groupBy(*terms.columns, "_size").agg(F.min(F.struct("_n", "_gram", "_slot")).alias("_r")).where("_r._n > 0")
    rarest = _written(rarest.select(*terms.columns, "_size", "_r._gram", "_r._slot"))  # Spark broadcasts it by its size
    held = _held(texts, [*within, key], text, rarest, False)
    return None if held is None else held.join(rarest.drop("_slot"), on).drop("_size", "_gram")


def _longer() -> Column:
    """The term, if it is longer than its gram."""
    return F.when(F.octet_length("_term") > GRAM, F.col("_term")).alias("_long")


def _verified(met: DataFrame, texts: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """The rows of ``met`` (``within``, ``key``, _long and others) whose _long, if there is one, is in their text."""
    met = _written(met)
    longer = met.where("_long is not null").join(texts.select(*within, key, text), [*within, key]).where(F.contains(text, "_long"))
    return met.where("_long is null").unionByName(longer.drop(text))


def _dealt(texts: DataFrame, terms: DataFrame, within: list[str]) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """The texts of groups of few terms, if there are groups, the texts of others, if there are any, and the others' terms."""
    if not within:
        return None, texts, terms
    many = _written(terms.groupBy(*within).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(*within))
    if many.isEmpty():
        return texts, None, terms
    return texts.join(many, within, "left_anti"), texts.join(many, within, "left_semi"), terms.join(many, within, "left_semi")


def _same_group(texts: DataFrame, terms: DataFrame, text: str, within: list[str]) -> tuple[DataFrame, Column]:
    """``terms`` with ``within`` under other names, and whether a text contains one of its own group."""
    named = terms.withColumnsRenamed({c: f"_of_{c}" for c in within})
    same = [texts[c] == named[f"_of_{c}"] for c in within]
    return named, reduce(and_, [*same, F.contains(texts[text], named["_term"])])


def pairs(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str, within: list[str] | None = None) -> DataFrame:
    """``within``, ``key`` and ``term`` of all terms that a text contains. ``texts``: key and text, each key once; ``terms``:
    term. ``within``: columns of both that must be equal as well."""
    within = within or []
    terms = terms.where(F.col(term) != "").select(*within, F.col(term).alias("_term"))
    few, others, of_others = _dealt(texts, terms, within)
    found = texts.select(*within, key, F.col(text).alias(term)).limit(0)
    if few is not None:
        named, contained = _same_group(few, terms.distinct(), text, within)
        found = few.join(named, contained).select(*within, key, F.col("_term").alias(term))
    met = None if others is None else _met(others, of_others.distinct(), key, text, within)
    if met is None:
        return found
    listed = _verified(met.withColumn("_long", _longer()), others, key, text, within).select(*within, key, F.col("_term").alias(term))
    return listed if few is None else found.unionByName(listed)


def first_contained(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str, rank: str, within: list[str] | None = None) -> DataFrame:
    """``texts`` with the first ``term`` that each contains, by ``rank``, null where there is none."""
    within = within or []
    terms = terms.where(F.col(term) != "").select(*within, F.col(term).alias("_term"), F.col(rank).alias("_rank"))
    few, others, of_others = _dealt(texts, terms, within)
    result = [] if few is None else [_first_of_group(few, terms, key, text, term, within)]
    if others is not None:
        result.append(_first_by_grams(others, of_others, key, text, term, within))
    return reduce(DataFrame.unionByName, result)


def _first_of_group(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str, within: list[str]) -> DataFrame:
    """``first_contained`` by comparing each text with all terms of its group, in one pass over both."""
    named, contained = _same_group(texts, terms, text, within)
    rest = [F.any_value(texts[c]).alias(c) for c in texts.columns if c not in [*within, key]]
    least = F.min(F.when(F.col("_term").isNotNull(), F.struct("_rank", "_term")))
    return texts.join(named, contained, "left").groupBy(*within, key).agg(*rest, least["_term"].alias(term))


def _first_by_grams(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str, within: list[str]) -> DataFrame:
    met = _met(texts, terms.groupBy(*within, "_term").agg(F.min("_rank").alias("_rank")), key, text, within)
    if met is None:
        return texts.withColumn(term, F.lit(None).cast("string"))
    least = F.min(F.struct("_rank", "_term")).alias("_f")
    # of the terms that need no look at the text, the first is enough
    found = _verified(met.groupBy(*within, key, _longer()).agg(least), texts, key, text, within)
    first = found.groupBy(*within, key).agg(F.min("_f").alias("_f")).select(*within, key, F.col("_f._term").alias(term))
    return texts.join(first, [*within, key], "left")


def same_sets(found: DataFrame, expected: DataFrame, key: str, text: str, term: str, rank: str, within: list[str]) -> DataFrame:
    """``within``, n_found, n_expected, unknown (found texts that contain no expected term) and same: whether what was found
    answers to what was expected, in number and text by text."""
    matched = first_contained(found, expected, key, text, term, rank, within)
    left = matched.groupBy(*within).agg(F.count("*").alias("n_found"), F.count_if(F.col(term).isNull()).alias("unknown"))
    right = expected.groupBy(*within).agg(F.count("*").alias("n_expected"))
    both = left.join(right, within, "full").select(*within, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_found", "n_expected", "unknown")))
    return both.withColumn("same", (F.col("unknown") == 0) & (F.col("n_found") == F.col("n_expected")))
