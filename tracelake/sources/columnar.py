"""Applications of an Arrow batch of payloads: DNS by cursor arrays, others row by row where a payload may be one.

Messages that are not of the common shape (one question; records named by it or by the root; answers that are
IPv4 addresses) are left to the row parser, so both give the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Records of a message, at most, that are walked by columns.
MOST_RECORDS = 8
_OCTETS = pa.array([str(i) for i in range(256)])


class Payloads:
    """The bytes of a batch's payloads in one array, with each row's span (nulls are empty)."""

    def __init__(self, column: pa.Array) -> None:
        self.column = column
        filled = column.fill_null(b"").cast(pa.large_binary())
        _, offsets, data = filled.buffers()
        spans = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
        low, high = int(spans[0]), int(spans[-1])
        self.data = np.frombuffer(data, np.uint8)[low:high] if high > low else np.zeros(1, np.uint8)
        self.starts, self.ends = spans[:-1] - low, spans[1:] - low

    def bytes(self, row: int) -> bytes:
        return self.data[self.starts[row] : self.ends[row]].tobytes()

    def first(self) -> np.ndarray:
        """The first byte of each row, 0 where there is none."""
        return np.where(self.ends > self.starts, self.data[np.minimum(self.starts, self.data.size - 1)], 0)


def _byte(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return data[np.minimum(at, data.size - 1)].astype(np.int64)


def _number(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _byte(data, at) << 8 | _byte(data, at + 1)


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    taken = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken.tobytes()))


def dns_columns(p: Payloads, rows: np.ndarray, kind: pa.StructType, type_name: Callable[[int], str]) -> tuple[np.ndarray, pa.Array]:
    """(rows that are of the common shape, their structs)."""
    own = Payloads(p.column.take(pa.array(rows)))  # their bytes alone
    data, starts, ends = own.data, own.starts, own.ends
    number, flags, questions, answers = (_number(data, starts + k) for k in (0, 2, 4, 6))
    records = answers + _number(data, starts + 8) + _number(data, starts + 10)
    sound = (ends - starts >= 12) & (questions == 1) & (records <= MOST_RECORDS)
    begin = starts + 12
    at, dotted = begin.copy(), data.copy()
    walking = np.flatnonzero(sound)
    while walking.size:  # a label of every name a step
        here, last = at[walking], ends[walking]
        n = _byte(data, here)
        fits = (n < 64) & (here + 1 + n <= last) & ((n == 0) | (here + 1 + n - begin[walking] <= 255))
        sound[walking[~fits]] = False
        more = fits & (n > 0)
        dotted[here[more]] = ord(".")
        at[walking[more]] += n[more] + 1
        walking = walking[more]
    name_end = at.copy()
    foreign = np.concatenate(([0], np.cumsum(data >= 128)))  # other than ASCII is left to the row parser
    clip = lambda x: np.minimum(x, data.size)
    sound &= foreign[clip(name_end)] == foreign[clip(begin)]
    asked = _number(data, at + 1)
    at += 5
    sound &= at <= ends
    told: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the i-th answers, and where their addresses lie
    for i in range(MOST_RECORDS):
        live = np.flatnonzero(sound & (i < records))
        if not live.size:
            break
        here, head = at[live], _byte(data, at[live])
        named = (head == 0xC0) & (_byte(data, here + 1) == 12)
        body = here + np.where(named, 2, 1)
        size, of = _number(data, body + 8), _number(data, body)
        is_answer = i < answers[live]
        fits = (named | (head == 0)) & (here < ends[live]) & (body + 10 <= ends[live]) & (body + 10 + size <= ends[live])
        fits &= ~is_answer | (named & (of == 1) & (size == 4))
        sound[live[~fits]] = False
        at[live] = body + 10 + size
        told.append((live[fits & is_answer], (body + 10)[fits & is_answer]))
    ok = np.flatnonzero(sound)
    names = _texts(dotted, np.minimum(begin + 1, name_end)[ok], name_end[ok])
    kinds, which = np.unique(asked[ok], return_inverse=True)
    types = pa.array([type_name(int(k)) for k in kinds], pa.string()).take(pa.array(which))
    asked_kind, told_kind = kind.field("questions").type, kind.field("answers").type
    question = pa.StructArray.from_arrays([names, types], fields=[asked_kind.value_type.field(i) for i in range(2)])
    # answers, by row and place; of messages that turned out odd later, none
    place = np.full(len(rows), -1)
    place[ok] = np.arange(ok.size)
    row = np.concatenate([place[r] for r, _ in told] or [np.zeros(0, np.int64)])
    where = np.concatenate([a for _, a in told] or [np.zeros(0, np.int64)])
    where, row = where[row >= 0], row[row >= 0]
    order = np.argsort(row, kind="stable")  # parts come by place
    where, row = where[order], row[order]
    address = pc.binary_join_element_wise(*[_OCTETS.take(pa.array(_byte(data, where + k))) for k in range(4)], ".")
    lines = pc.binary_join_element_wise(names.take(pa.array(row)), pa.array(["A"] * len(row), pa.string()), address, " ")
    counts = np.bincount(row, minlength=ok.size)
    offsets = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
    values = [
        pa.array(flags[ok] & 0x8000 == 0), pa.array(number[ok].astype(np.int32)), pa.ListArray.from_arrays(offsets(np.ones(ok.size, np.int64)), question, type=asked_kind),
        pa.ListArray.from_arrays(offsets(counts), lines, type=told_kind), pa.array((flags[ok] & 0xF).astype(np.int32)),
    ]
    return rows[ok], pa.StructArray.from_arrays(values, fields=[kind.field(i) for i in range(kind.num_fields)])


class Found:
    """Structs of one application, with the rows they belong to."""

    def __init__(self, kind: pa.DataType) -> None:
        self.kind, self.rows, self.parts = kind, [], []

    def add(self, rows, structs: pa.Array) -> None:
        self.rows.append(np.asarray(rows, np.int64))
        self.parts.append(structs)

    def add_rows(self, rows: np.ndarray, parse: Callable[[int], dict | None]) -> None:
        """Row by row; those that are no such message are passed over."""
        got = [(i, found) for i in rows.tolist() if (found := parse(i))]
        if got:
            self.add([i for i, _ in got], pa.array([x for _, x in got], self.kind))

    def places(self) -> np.ndarray:
        return np.concatenate(self.rows) if self.rows else np.zeros(0, np.int64)

    def column(self, n: int) -> pa.Array:
        """One value a row of the batch, null where there is none."""
        at = self.places()
        if not at.size:
            return pa.nulls(n, self.kind)
        index = np.full(n, -1)
        index[at] = np.arange(at.size)
        return pa.concat_arrays(self.parts).take(pa.array(index, mask=index < 0))


def texts_of(column: pa.Array, text: Callable[[bytes], str]) -> pa.Array:
    """The text of each value, made once for each distinct one."""
    coded = column.dictionary_encode()
    return pa.array([text(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
