"""Blocks of strings as NumPy arrays of bytes, and base strings packed to two bits a base."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from strandweave.functions.bases import COMPLEMENT_FROM, COMPLEMENT_TO, LOW_QUALITY

COMPLEMENTS = str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO)
COMPLEMENT = np.array([ord(chr(c).translate(COMPLEMENTS)) for c in range(256)], dtype=np.uint8)
LOW = np.array([bool(re.match(LOW_QUALITY, chr(c))) for c in range(256)])
RAW = b"\xff"
CODE = np.full(256, 255, dtype=np.uint8)
CODE[list(b"ACGT")] = range(4)
UNPACKED = np.array([[b"ACGT"[i >> s & 3] for s in (6, 4, 2, 0)] for i in range(256)], dtype=np.uint8)


def complement(text: str) -> str:
    """The reverse complement of one string."""
    return text.translate(COMPLEMENTS)[::-1]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings or binaries, and where each row's start (one place more than rows); nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int32)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), at


def column_of(data: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The inverse: a column from bytes and places."""
    return pa.Array.from_buffers(kind, len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def even_column(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column of the rows of a matrix of bytes."""
    return column_of(rows.reshape(-1), np.arange(len(rows) + 1) * rows.shape[1], kind)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length that rows have: their places, and their bytes as a matrix."""
    data, at = raw_bytes(column)
    sizes = np.diff(at)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        if len(rows) == len(sizes):
            yield rows, data[at[0] : at[0] + n * len(rows)].reshape(len(rows), n)
        else:
            yield rows, data[at[rows][:, None] + np.arange(n)]


def packed(codes: np.ndarray) -> np.ndarray:
    """Codes 0 to 3, four in a byte, the first in the high bits; a last byte is filled up with zeros. Keeps the order of rows of one length."""
    codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))
    return codes[:, 0::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]


def squeezed(codes: np.ndarray) -> np.ndarray:
    """Packed codes and a byte with the length modulo 4, so that strings of different lengths differ."""
    return np.hstack([packed(codes), np.full((len(codes), 1), codes.shape[1] % 4, dtype=np.uint8)])


def squeeze(text: str) -> bytes:
    """One string in the form of `squeezed`, or, with other letters than A, C, G, T, itself and a byte that no other form ends with."""
    codes = CODE[np.frombuffer(text.encode(), dtype=np.uint8)][None]
    return text.encode() + RAW if (codes > 3).any() else squeezed(codes).tobytes()


def restored(column: pa.Array) -> pa.Array:
    """The strings that a column of squeezed ones stands for."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    odd: dict[int, bytes] = {}
    for rows, body in by_length(column):
        last = body[:, -1]
        for kind in np.unique(last):
            own, part = rows[last == kind], body[last == kind, :-1]
            if kind == RAW[0]:
                odd |= {int(i): p.tobytes() for i, p in zip(own, part, strict=True)}
            else:
                letters = UNPACKED[part].reshape(len(part), 4 * part.shape[1])
                out.append((own, letters[:, : letters.shape[1] - (-int(kind) % 4)]))
    if len(out) == 1 and not odd:
        return even_column(out[0][1], pa.string())
    texts = dict(odd)
    for own, letters in out:
        texts |= {int(i): t.tobytes() for i, t in zip(own, letters, strict=True)}
    return pa.array([texts[i].decode() for i in range(len(column))], type=pa.string())
