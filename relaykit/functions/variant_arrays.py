"""Reading VARIANT columns of Arrow batches: all values of one depth are decoded together, by arrays of their positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from relaykit.functions.variants import WRAPPERS

LABELS = ["null", "bool", "int32", "int64", "double", "string", "object", "array", "objectId", "date", "decimal"]
NULL, BOOL, INT32, INT64, DOUBLE, STRING, OBJECT, ARRAY, OBJECT_ID, DATE, DECIMAL = range(len(LABELS))

# Type numbers of the variant encoding.
_BASIC_SHORT, _BASIC_OBJECT, _BASIC_ARRAY = 1, 2, 3
T_INT8, T_INT16, T_INT32, T_INT64, T_DATE, T_TIMESTAMP, T_TIMESTAMP_NTZ, T_BINARY, T_STRING = 3, 4, 5, 6, 11, 12, 13, 15, 16
T_SHORT, T_OBJECT, T_ARRAY = 64, 65, 66
_SIZES = np.array([1, 1, 1, 2, 3, 5, 9, 9, 6, 10, 18, 5, 9, 9, 5, 0, 0, 9, 9, 9, 17, *[1] * 46])
_NO_NAMES = b"\x01\x00\x00"
VARIANT = pa.struct([pa.field("value", pa.binary(), False), pa.field("metadata", pa.binary(), False, {b"variant": b"true"})])
# Days and microseconds of the years 0 to 9999, which are written with four digits.
_DAYS, _MICROS = (-719_528, 2_932_896), (-62_167_219_200_000_000, 253_402_300_799_999_999)

_KINDS = np.full(67, STRING, np.uint8)
_KINDS[:11] = [NULL, BOOL, BOOL, INT32, INT32, INT32, INT32, DOUBLE, DOUBLE, DOUBLE, DOUBLE]
_KINDS[[T_OBJECT, T_ARRAY]] = OBJECT, ARRAY
# What a wrapper may hold, by its key; other keys of WRAPPERS may hold anything.
_HELD = {"$oid": [STRING], "$numberInt": [STRING, INT32], "$numberLong": [STRING, INT32], "$numberDouble": [STRING, INT32, DOUBLE], "$numberDecimal": [STRING]}

# The same texts as ``variants.HEX24`` and ``variants.ISO_DATE_TIME``: there ``$`` also stands before a last line end.
_END = rb"(?:\r\n|[\n\r]|\xc2\x85|\xe2\x80[\xa8\xa9])?\Z"
_LINE_ENDS = [b"", b"\n", b"\r", b"\r\n", b"\xc2\x85", b"\xe2\x80\xa8", b"\xe2\x80\xa9"]
_ISO = re.compile(rb"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2}|[+-]\d{4})?)?" + _END)
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


def runs(documents: pa.Array, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes of documents; a longer document makes a run alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(documents.field(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, end
        start = end


class Run:
    """The documents of one run. A value is known by its position in ``data`` and by the row of its document."""

    def __init__(self, documents: pa.Array) -> None:
        filled = pc.is_valid(documents).to_numpy(zero_copy_only=False)
        self.rows = np.flatnonzero(filled)
        values = documents.field(0).cast(pa.large_binary())
        offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        data = values.buffers()[2]
        held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(values) else np.zeros(0, np.uint8)
        self.data = np.concatenate([held, np.zeros(32, np.uint8)])
        self.starts = (offsets[:-1] - offsets[0])[self.rows] if len(values) else np.zeros(0, np.int64)
        self._read_names(documents.field(1))

    def _read_names(self, metadata: pa.Array) -> None:
        self.metadata = metadata.dictionary_encode()
        self._ids: dict[str, int] = {}
        numbers: list[int] = []
        bases = []
        for held in self.metadata.dictionary.to_pylist():
            bases.append(len(numbers))
            if not held:
                continue
            width = (held[0] >> 6) + 1
            at = lambda k: int.from_bytes(held[1 + k * width : 1 + (k + 1) * width], "little")  # noqa: B023, E731
            count = at(0)
            first = 1 + (count + 2) * width
            offsets = [at(k + 1) for k in range(count + 1)]
            numbers += [self.name_id(held[first + a : first + b].decode()) for a, b in zip(offsets, offsets[1:])]
        self._numbers = np.array(numbers or [0], np.int64)
        chosen = pc.fill_null(self.metadata.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self._base = np.array(bases or [0], np.int64)[chosen] if len(chosen) else np.zeros(0, np.int64)

    def name_id(self, name: str) -> int:
        return self._ids.setdefault(name, len(self._ids))

    @property
    def names(self) -> list[str]:
        return list(self._ids)

    def _number(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Unsigned numbers of ``width`` bytes, at most 4."""
        found = self.data[at].astype(np.int64)
        for k in range(1, int(width.max(initial=1))):
            found += np.where(width > k, self.data[at + k].astype(np.int64) << (8 * k), 0)
        return found

    def whole(self, at: np.ndarray, dtype: str) -> np.ndarray:
        """Numbers of one type that stand at ``at``."""
        size = np.dtype(dtype).itemsize
        return np.ascontiguousarray(self.data[at[:, None] + np.arange(size)]).view(dtype)[:, 0]

    def types(self, at: np.ndarray) -> np.ndarray:
        """Type number of each value; ``T_SHORT``, ``T_OBJECT`` and ``T_ARRAY`` beside those of the encoding."""
        head = self.data[at]
        basic = head & 3
        return np.where(basic == 0, np.minimum(head >> 2, 63), basic + (T_SHORT - 1)).astype(np.uint8)

    def _parts(self, at: np.ndarray, is_object: bool) -> tuple[np.ndarray, ...]:
        info = self.data[at].astype(np.int64) >> 2
        large = (info >> (4 if is_object else 2)) & 1
        lead = 1 + 3 * large
        return info, self._number(at + 1, lead), at + 1 + lead

    def sizes(self, at: np.ndarray, is_object: bool) -> np.ndarray:
        return self._parts(at, is_object)[1]

    def _children(self, at: np.ndarray, is_object: bool, cap: int | None = None) -> tuple[np.ndarray, ...]:
        info, count, first = self._parts(at, is_object)
        width, id_width = (info & 3) + 1, ((info >> 2) & 3) + 1 if is_object else np.zeros_like(info)
        offsets = first + count * id_width
        values = offsets + (count + 1) * width
        kept = count if cap is None else np.minimum(count, cap)
        parent = np.repeat(np.arange(len(at)), kept)
        nth = np.arange(len(parent)) - np.repeat(np.cumsum(kept) - kept, kept)
        child = values[parent] + self._number(offsets[parent] + nth * width[parent], width[parent])
        return parent, nth, child, first, id_width

    def elements(self, at: np.ndarray, cap: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the arrays at ``at``: number of the array, number in it, and position of each element."""
        return self._children(at, False, cap)[:3]

    def members(self, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the objects at ``at``: number of the object, name and position of each member."""
        parent, nth, child, first, id_width = self._children(at, True)
        field = self._number(first[parent] + nth * id_width[parent], id_width[parent])
        return parent, self._numbers[self._base[row[parent]] + field], child

    def texts(self, at: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and length in bytes of strings and binary values."""
        short = types == T_SHORT
        length = np.where(short, self.data[at].astype(np.int64) >> 2, 0)
        if not short.all():
            length[~short] = self.whole(at[~short] + 1, "<u4")
        return at + np.where(short, 1, 5), length

    def gathered(self, start: np.ndarray, length: np.ndarray) -> pa.Array:
        """The bytes of many ranges as one Arrow array."""
        ends = np.concatenate([[0], np.cumsum(length)])
        picked = self.data[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(picked)])

    def _is_hex(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        found = np.zeros(len(start), bool)
        able = np.flatnonzero((length >= 24) & (length <= 27))
        able = able[_HEX[self.data[start[able][:, None] + np.arange(24)]].all(axis=1)]
        found[able] = True
        for k in able[length[able] > 24]:
            found[k] = bytes(self.data[start[k] + 24 : start[k] + length[k]]) in _LINE_ENDS
        return found

    def text_labels(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Like ``variants.string_label``."""
        found = np.where(self._is_hex(start, length), OBJECT_ID, STRING).astype(np.uint8)
        able = np.flatnonzero((length >= 10) & (length <= 35) & (found == STRING))
        dash = ord("-")
        able = able[(self.data[start[able] + 4] == dash) & (self.data[start[able] + 7] == dash)]
        if len(able):
            fits = [_ISO.match(text) is not None for text in self.gathered(start[able], length[able]).to_pylist()]
            found[able[fits]] = DATE
        return found

    def kinds(self, at: np.ndarray, row: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like ``variants.kind``, and the position of the number that a wrapper holds (-1 for none)."""
        found, inner = self.scalar_kinds(at, types), np.full(len(at), -1, np.int64)
        some = np.flatnonzero(types == T_OBJECT)
        if len(some):
            found[some], inner[some] = self.wrappers(at[some], row[some], types[some])
        return found, inner

    def copies(self, at: np.ndarray, row: np.ndarray, wanted: np.ndarray) -> pa.Array:
        """Values as documents of their own, null where not wanted."""
        types = self.types(at)
        length = np.where(wanted, _SIZES[types], 0)
        text = wanted & ((types == T_SHORT) | (types == T_STRING) | (types == T_BINARY))
        if text.any():
            start, size = self.texts(at[text], types[text])
            length[text] = start - at[text] + size
        for number in (T_OBJECT, T_ARRAY):
            some = np.flatnonzero(wanted & (types == number))
            info, count, first = self._parts(at[some], number == T_OBJECT)
            width, id_width = (info & 3) + 1, ((info >> 2) & 3) + 1 if number == T_OBJECT else 0
            ends = first + count * (id_width + width)
            length[some] = ends + width + self._number(ends, width) - at[some]
        whole = wanted & (types >= T_OBJECT)
        # A scalar needs no names.
        names = pa.array([_NO_NAMES]).take(pa.array(np.zeros(len(at), np.int64), mask=whole))
        if whole.any():
            of = self.metadata.dictionary.take(self.metadata.indices.take(pa.array(row, mask=~whole))).cast(pa.binary())
            names = pc.coalesce(names, of)
        value = self.gathered(at, length).cast(pa.binary())
        return pa.StructArray.from_arrays([value, names], fields=list(VARIANT), mask=pa.array(~wanted))

    def scalar_kinds(self, at: np.ndarray, types: np.ndarray) -> np.ndarray:
        """Like ``variants.scalar_kind``; objects and arrays as such."""
        found = _KINDS[types]
        for number, dtype in ((T_INT32, "<i4"), (T_INT64, "<i8")):
            some = np.flatnonzero(types == number)
            if len(some):
                value = self.whole(at[some] + 1, dtype).astype(np.int64)
                found[some[(value > 2147483647) | (value < -2147483647)]] = INT64
        return found

    def scalar_labels(self, at: np.ndarray, types: np.ndarray) -> np.ndarray:
        """Like ``variants.scalar_label``."""
        found = self.scalar_kinds(at, types)
        some = np.flatnonzero((types == T_SHORT) | (types == T_STRING) | (types == T_BINARY))
        if len(some):
            found[some] = self.text_labels(*self.texts(at[some], types[some]))
        for numbers, dtype, (low, high) in (([T_DATE], "<i4", _DAYS), ([T_TIMESTAMP, T_TIMESTAMP_NTZ], "<i8", _MICROS)):
            some = np.flatnonzero(np.isin(types, numbers))
            if len(some):
                value = self.whole(at[some] + 1, dtype)
                found[some[(value >= low) & (value <= high)]] = DATE
        return found

    def wrappers(self, at: np.ndarray, row: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like ``variants.wrapper_label``, for all values: the label or ``OBJECT``, and the position of the number that is held (-1 for none)."""
        label, inner = np.full(len(at), OBJECT, np.uint8), np.full(len(at), -1, np.int64)
        some = np.flatnonzero(types == T_OBJECT)
        some = some[self.sizes(at[some], True) == 1] if len(some) else some
        if len(some):
            _, name, child = self.members(at[some], row[some])
            held = self.types(child)
            is_text = (held == T_SHORT) | (held == T_STRING)
            for key, wrapped in WRAPPERS.items():
                if key not in self._ids:
                    continue
                fits = name == self._ids[key]
                if key in _HELD:
                    fits &= np.isin(_KINDS[held], _HELD[key]) & ((_KINDS[held] != STRING) | is_text)
                which = np.flatnonzero(fits)
                if key == "$oid" and len(which):
                    which = which[self._is_hex(*self.texts(child[which], held[which]))]
                label[some[which]] = LABELS.index(wrapped)
                if key.startswith("$number"):
                    inner[some[which]] = child[which]
        return label, inner


def distinct(first: np.ndarray, second: np.ndarray, n_second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of two numbers, and which of them each row has."""
    pair = first.astype(np.int64) * n_second + second
    room = (int(first.max(initial=-1)) + 1) * n_second
    if room <= 4 * len(pair) + 65_536:
        seen = np.zeros(room, bool)
        seen[pair] = True
        found = np.flatnonzero(seen)
        place = np.zeros(room, np.int64)
        place[found] = np.arange(len(found))
        which = place[pair]
    else:
        found, which = np.unique(pair, return_inverse=True)
    return found // n_second, found % n_second, which
