"""Chat formatting: a hidden Markov model recovers who speaks in a transcript, then turns are rendered in one form.

Every line of a conversation is an observation: the speaker marker it starts with, whether it starts a row, whether its
row starts with a marker, its length class and whether it ends as a question. The states are a role and whether the line
begins a turn or goes on with it. (A line that starts a row without a marker has the length class of its row.) Role changes and line features are counted over all rows with a known role; the role
column takes no part in decoding. Markers are believed by their kind: a speaker's name up to a small error, words that
texts use as well ("Answer:", "A:") only where a row may begin a turn. Viterbi decoding finds the best path, so a
turn whose marker is missing or unknown gets the role that fits its neighbours and its own lines. A turn begins where
the path enters a begin state; a marker is cut off only where the path begins a turn of the marker's role, and every
other character stays. Turns are numbered and rendered as ``<|role|>\\n`` text ``\\n<|end|>\\n``.

Lines stream through a task in conversation order. A decoded prefix leaves memory as soon as all surviving paths agree
on it, so that a very long conversation is never held as a whole.

Defined cases: a null text is one empty line; null turns come first, equal turns in order of text; each row with a null
conv_id is a conversation of its own; roles other than the known names count as missing; with no known roles at all
every role and shape is as likely as any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Names that a speaker may go by, in fixed spelling.
ALIASES = {"system": "system", "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "answer": "assistant", "a": "assistant"}
MARKER = re.compile(r"\s{0,8}(?:#{1,6}\s?|\*\*|\[|<\|?)?(" + "|".join(sorted(ALIASES, key=len, reverse=True)) + r")(?:\*\*\s?:|:\s?\*\*|\]\s?:?|\|?>\s?:?|\s?:)[ \t]?", re.IGNORECASE)
LENGTHS = (1, 40, 120, 200, 300, 400, 600, 900, 1300)
SHAPES = 4 * (len(LENGTHS) + 1)
#: Markers that are hardly ever a text's own words.
NAMES = ("system", "user", "human", "assistant")
#: How likely a marker stands on a turn's first line of another role, and within a turn (names, other words), against a
#: first line of its role.
MARKER_ERROR = 0.002
WITHIN_TURN = (0.0005, 0.05)
#: How likely a line that starts no row begins a turn, and where it and its row start with a marker.
BEGINS_WITHIN_ROW = (0.02, 0.5)
ROW_ERROR = 0.02
TURN_GOES_ON = 0.5

SCHEMA = "conv_id long, turn long, role string, text string, rendered string"


def length_class(n: int) -> int:
    return sum(n >= edge for edge in LENGTHS)


class Model:
    """Log probabilities; state 2 * role is a turn's first line, 2 * role + 1 a further one."""

    def __init__(self, changes: np.ndarray, firsts: np.ndarray, shapes: np.ndarray):
        k = len(ROLES)
        change = np.log((changes + 1) / (changes + 1).sum(axis=1, keepdims=True))
        self.start = np.full(2 * k, -1e9)
        self.start[::2] = np.log((firsts + 1) / (firsts + 1).sum())
        self.step = np.full((2 * k, 2 * k), -1e9)
        for r in range(k):
            for s in (2 * r, 2 * r + 1):
                self.step[s, ::2] = np.log(1 - TURN_GOES_ON) + change[r]
                self.step[s, 2 * r + 1] = np.log(TURN_GOES_ON)
        self.shape = np.log((shapes + 1) / (shapes + 1).sum(axis=1, keepdims=True))

    def emission(self, marker: tuple[int, bool] | None, starts_row: bool, row_marked: bool, shape: int) -> np.ndarray:
        """Log probabilities of a line in each state; ``marker`` is a role and whether it is a name."""
        out = np.repeat(self.shape[:, shape], 2)
        if marker is not None:
            out[::2] += np.log(MARKER_ERROR)
            out[2 * marker[0]] -= np.log(MARKER_ERROR)
            out[1::2] += np.log(WITHIN_TURN[0 if marker[1] else 1])
        begins = 1 - ROW_ERROR if starts_row else BEGINS_WITHIN_ROW[row_marked and marker is not None]
        out[::2] += np.log(begins)
        out[1::2] += np.log(1 - begins)
        return out


def read_line(line: str) -> tuple[tuple[int, bool] | None, int]:
    """(marker, where the line goes on behind it)."""
    found = MARKER.match(line)
    if not found:
        return None, 0
    name = found[1].lower()
    return (ROLES.index(ALIASES[name]), name in NAMES), found.end()


def shape_of(line: str, row_chars: int | None = None) -> int:
    """Number of the line's shape: its length class (its row's, with ``row_chars``), and whether it ends as a question."""
    size = len(line) if row_chars is None else row_chars
    return SHAPES // 2 * (row_chars is not None) + 2 * length_class(size) + line.rstrip().endswith("?")


class Decoder:
    """Viterbi over one conversation, line by line."""

    def __init__(self, model: Model):
        self.model, self.score, self.back, self.lines, self.row_marked = model, None, [], [], False

    def add(self, line: str, row_chars: int | None = None) -> list[tuple[int, str]]:
        """Take a line, with the length of its row if it is the first of one; return the lines whose states are settled by now, without the markers that their states cut off."""
        marker, at = read_line(line)
        starts_row = row_chars is not None
        if starts_row:
            self.row_marked = marker is not None
        seen = self.model.emission(marker, starts_row, self.row_marked, shape_of(line[at:], None if self.row_marked else row_chars))
        if self.score is None:
            self.score, origin = self.model.start + seen, np.zeros(len(seen), dtype=np.int64)
        else:
            reach = self.score[:, None] + self.model.step
            origin = reach.argmax(axis=0)
            self.score = reach[origin, np.arange(len(seen))] + seen
        self.back.append(origin)
        self.lines.append((line, at, 2 * marker[0] if marker else -1))
        return self._settle() if len(self.lines) % 64 == 0 else []

    def _settle(self) -> list[tuple[int, str]]:
        alive = np.arange(len(self.score))
        for i in range(len(self.lines) - 1, 0, -1):
            alive = np.unique(self.back[i][alive])
            if len(alive) == 1:
                done = self._path(i - 1, int(alive[0]))
                out = self._cut(done, self.lines[:i])
                self.back, self.lines = self.back[i:], self.lines[i:]
                return out
        return []

    @staticmethod
    def _cut(path: list[int], lines: list[tuple[str, int, int]]) -> list[tuple[int, str]]:
        return [(s, line[at:] if s == begins else line) for s, (line, at, begins) in zip(path, lines)]

    def _path(self, last: int, state: int) -> list[int]:
        path = [state]
        for i in range(last, 0, -1):
            path.append(int(self.back[i][path[-1]]))
        return path[::-1]

    def close(self) -> list[tuple[int, str]]:
        if self.score is None:
            return []
        return self._cut(self._path(len(self.lines) - 1, int(self.score.argmax())), self.lines)


def _known(role):
    text = F.lower(F.trim(role))
    return F.coalesce(*(F.when(text.isin([a for a, r in ALIASES.items() if r == name]), F.lit(k)) for k, name in enumerate(ROLES)))


def fit(conversations: DataFrame) -> Model:
    """Role changes, first roles and line shapes, counted over all rows with a known role."""
    k, rows = len(ROLES), conversations.select("conv_id", "turn", "text", _known(F.col("role")).alias("r"))
    before = F.lag("r").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    changes, firsts, shapes = np.zeros((k, k)), np.zeros(k), np.zeros((k, SHAPES))
    for row in rows.withColumn("b", before).where("r is not null").groupBy("b", "r").count().collect():  # at most 12 rows
        if row["b"] is None:
            firsts[row["r"]] += row["count"]
        else:
            changes[row["b"], row["r"]] += row["count"]
    lines = rows.where("r is not null").select("r", F.coalesce("text", F.lit("")).alias("text")).select("r", "text", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    whole = (F.col("at") == 0) & ~F.col("line").rlike(f"(?i)^{MARKER.pattern}")
    chars = F.length(F.when(whole, F.col("text")).otherwise(F.col("line")))
    shape = SHAPES // 2 * whole.cast("int") + 2 * sum((chars >= edge).cast("int") for edge in LENGTHS) + F.rtrim(F.col("line")).endswith("?").cast("int")
    for row in lines.groupBy("r", shape.alias("s")).count().collect():  # at most 120 rows
        shapes[row["r"], row["s"]] += row["count"]
    return Model(changes, firsts, shapes)


def format_chats(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """conv_id, turn (from 0), role, text and rendered of every recovered turn."""
    model = model or fit(conversations)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("dealt", F.coalesce("conv_id", F.xxhash64("turn", "text")))  # rows without an id are dealt out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"conv": None, "decoder": None, "turn": None, "number": 0, "rows": []}

        def take(settled: list[tuple[int, str]]) -> None:
            for s, line in settled:
                if s % 2 == 0 or state["turn"] is None:
                    end_turn()
                    state["turn"] = (s // 2, [])
                state["turn"][1].append(line)

        def end_turn() -> None:
            if state["turn"] is not None:
                role, lines = state["turn"]
                text = "\n".join(lines)
                state["rows"].append((state["conv"], state["number"], ROLES[role], text, f"<|{ROLES[role]}|>\n{text}\n<|end|>\n"))
                state.update(turn=None, number=state["number"] + 1)

        def end_conversation() -> None:
            if state["decoder"] is not None:
                take(state["decoder"].close())
                end_turn()
            state.update(decoder=None, number=0)

        def flush() -> pa.RecordBatch:
            out, state["rows"] = state["rows"], []
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for conv, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text"))):
                if state["decoder"] is None or conv is None or conv != state["conv"]:
                    end_conversation()
                    state.update(conv=conv, decoder=Decoder(model))
                for i, line in enumerate(text.split("\n")):
                    take(state["decoder"].add(line, len(text) if i == 0 else None))
                if len(state["rows"]) >= 2000:
                    yield flush()
        end_conversation()
        yield flush()

    return rows.repartition("dealt").sortWithinPartitions("conv_id", "turn", "text").drop("dealt").mapInArrow(run, SCHEMA)


def chat_query(conversations: DataFrame) -> DataFrame:
    return format_chats(conversations.select("conv_id", "turn", "role", "text"))
