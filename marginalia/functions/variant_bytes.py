"""VARIANT values read from their bytes where Python works on Arrow batches.

Arrow carries a VARIANT as its value and its dictionary of keys. Reading these directly spares
the JSON text, for which Spark sets up a writer per string, and its parser; parts that nothing
is wanted from are stepped over. Texts are those of Spark's own JSON; a double has the fewest
digits that read back as the same number.
"""

from __future__ import annotations

import json
import struct
import sys
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle

# workers then need no copy of this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PRIMITIVE, SHORT_STRING, OBJECT, ARRAY = range(4)
NULL, TRUE, FALSE = range(3)
INTEGERS = {3: 1, 4: 2, 5: 4, 6: 8}
DECIMALS = {8: 4, 9: 8, 10: 16}
DOUBLE, LONG_STRING = 7, 16
#: Levels that Spark's parser reads, and some more for those that expressions put around them.
LEVELS = 20_000


class Number(str):
    """A number with fraction or exponent, as it is written."""


def numbers(data: bytes, at: int, n: int, size: int) -> Sequence[int]:
    """``n`` unsigned numbers of ``size`` bytes each."""
    if size == 1:
        return data[at:at + n]
    if size == 3:
        return tuple([int.from_bytes(data[i:i + 3], "little") for i in range(at, at + 3 * n, 3)])
    return struct.unpack_from(f"<{n}{'H' if size == 2 else 'I'}", data, at)


class Keys(list):
    """The dictionary of a VARIANT; ``notes`` is what a walk has found out about its keys."""

    def __init__(self, keys: Sequence[str]):
        super().__init__(keys)
        self.notes: dict = {}


def keys_of(metadata: bytes) -> Keys:
    """The dictionary of a VARIANT."""
    size = (metadata[0] >> 6) + 1
    n = int.from_bytes(metadata[1:1 + size], "little")
    ends, base = numbers(metadata, 1 + size, n + 1, size), 1 + size * (n + 2)
    return Keys([metadata[base + a:base + b].decode() for a, b in zip(ends, ends[1:])])


def fields(data: bytes, at: int, head: int) -> tuple[Sequence[int], Sequence[int], int]:
    """Of an object: numbers of its keys, which stand in the order of the keys, offsets of its values, and where these start."""
    size, width = (head >> 2 & 3) + 1, (head >> 4 & 3) + 1
    if head & 64:
        n, at = int.from_bytes(data[at + 1:at + 5], "little"), at + 5
    else:
        n, at = data[at + 1], at + 2
    return numbers(data, at, n, width), numbers(data, at + n * width, n, size), at + n * width + (n + 1) * size


def elements(data: bytes, at: int, head: int) -> tuple[Sequence[int], int]:
    """Of an array: offsets of its items, and where these start."""
    size = (head >> 2 & 3) + 1
    if head & 16:
        n, at = int.from_bytes(data[at + 1:at + 5], "little"), at + 5
    else:
        n, at = data[at + 1], at + 2
    return numbers(data, at, n, size), at + (n + 1) * size


def decimal_text(digits: int, scale: int) -> str:
    """A decimal without zeros at its end; one with a fraction is a ``Number``."""
    text = str(abs(digits)).rjust(scale + 1, "0")
    whole, fraction = text[:len(text) - scale], text[len(text) - scale:].rstrip("0")
    sign = "-" if digits < 0 else ""
    return Number(f"{sign}{whole}.{fraction}") if fraction else sign + whole


def double_text(v: float) -> str:
    """A double as Java writes it; one that is no number is a text, as in Spark's JSON."""
    if v != v or v in (float("inf"), float("-inf")):
        return "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
    sign, text = "-" if str(v)[0] == "-" else "", repr(abs(v))
    digits, _, power = text.partition("e")
    whole, _, fraction = digits.partition(".")
    raw = whole + fraction
    point = len(whole) + int(power or 0)  # of the digits in front of the point
    shown = raw.lstrip("0")
    point -= len(raw) - len(shown)
    shown = shown.rstrip("0") or "0"
    if v == 0:
        return Number(sign + "0.0")
    if 1e-3 <= abs(v) < 1e7:
        if point <= 0:
            return Number(f"{sign}0.{'0' * -point}{shown}")
        shown = shown.ljust(point, "0")
        return Number(f"{sign}{shown[:point]}.{shown[point:] or '0'}")
    return Number(f"{sign}{shown[0]}.{shown[1:] or '0'}E{point - 1}")


def primitive(data: bytes, at: int, kind: int) -> Any:
    """A scalar that is no short string: None, a bool, an int, a ``Number`` or a text."""
    if kind == LONG_STRING:
        return data[at + 5:at + 5 + int.from_bytes(data[at + 1:at + 5], "little")].decode()
    if kind <= FALSE:
        return None if kind == NULL else kind == TRUE
    if kind in INTEGERS:
        return int.from_bytes(data[at + 1:at + 1 + INTEGERS[kind]], "little", signed=True)
    if kind in DECIMALS:
        text = decimal_text(int.from_bytes(data[at + 2:at + 2 + DECIMALS[kind]], "little", signed=True), data[at + 1])
        return text if isinstance(text, Number) else int(text)
    if kind == DOUBLE:
        return double_text(struct.unpack_from("<d", data, at + 1)[0])
    # dates, times, bytes and others, none of which JSON has
    from pyspark.sql.variant_utils import VariantUtils

    return json.loads(VariantUtils.to_json(data[at:], b"\x01\x00\x00", "UTC"), parse_float=Number)


def decode(data: bytes, at: int, keys: list[str]) -> Any:
    """The value at a place as dicts, lists, texts, ints, ``Number``, bools and None."""
    head = data[at]
    kind = head & 3
    if kind == SHORT_STRING:
        return data[at + 1:at + 1 + (head >> 2)].decode()
    if kind == OBJECT:
        ids, offsets, base = fields(data, at, head)
        return {keys[i]: decode(data, base + o, keys) for i, o in zip(ids, offsets)}
    if kind == ARRAY:
        offsets, base = elements(data, at, head)
        return [decode(data, base + o, keys) for o in offsets]
    return primitive(data, at, head >> 2)


def member(data: bytes, at: int, keys: list[str], key: str) -> int | None:
    """Where the value of a key of an object starts."""
    head = data[at]
    if head & 3 == OBJECT:
        ids, offsets, base = fields(data, at, head)
        for i, o in zip(ids, offsets):
            if keys[i] == key:
                return base + o
    return None


def values(column: pa.Array) -> Iterator[tuple[bytes, Keys] | None]:
    """The VARIANTs of an Arrow column with their dictionaries; None for SQL NULL."""
    known: dict[bytes, Keys] = {}
    sys.setrecursionlimit(max(sys.getrecursionlimit(), LEVELS))
    for there, data, metadata in zip(column.is_valid(), column.field("value"), column.field("metadata")):
        if not there.as_py():
            yield None
            continue
        metadata = metadata.as_py()
        keys = known.get(metadata)
        if keys is None:
            if len(known) >= 1000:
                known.clear()
            keys = known[metadata] = keys_of(metadata)
        yield data.as_py(), keys
