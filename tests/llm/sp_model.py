"""The public BPE piece file as a unigram model with Zipf scores, so that the library itself can be the yardstick."""

import struct

from wayloom.llm.tokencount import UNIT, zipf_cost


def _varint(data, at):
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _put(value):
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def _fields(data):
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, kind, value


def _message(fields):
    return b"".join(_put(n << 3 | kind) + (_put(v) if kind == 0 else _put(len(v)) + v if kind == 2 else v) for n, kind, v in fields)


def as_unigram(path):
    """Model bytes: piece scores (field 2 of a piece) replaced, model type (field 3 of the trainer's part) unigram."""
    out, place, first = [], 0, None
    for n, kind, value in _fields(open(path, "rb").read()):
        if n == 1:
            own = list(_fields(value))
            types = [v for f, _, v in own if f == 3]
            if not types or types[0] == 1:
                first = place if first is None else first
                own = [(f, k, struct.pack("<f", -zipf_cost(place - first) / UNIT) if f == 2 else v) for f, k, v in own]
            value, place = _message(own), place + 1
        elif n == 2:
            value = _message([(f, k, 1 if f == 3 else v) for f, k, v in _fields(value)])
        out.append((n, kind, value))
    return _message(out)
