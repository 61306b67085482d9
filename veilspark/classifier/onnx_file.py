"""Reading tensors out of ONNX files without an ONNX library: the few protobuf fields that initialisers use."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Tensor element types of the format. 4-bit types have two values a byte.
DTYPES = {1: np.float32, 2: np.uint8, 3: np.int8, 6: np.int32, 7: np.int64, 9: np.bool_, 10: np.float16, 11: np.float64, 16: np.uint16, 21: np.uint8, 22: np.uint8}
_HALF_BYTE = (21, 22)


@dataclass
class Tensor:
    name: str
    shape: tuple[int, ...]
    kind: int
    raw: bytes | None = None
    location: str | None = None
    offset: int = 0
    length: int | None = None

    @property
    def nbytes(self) -> int:
        n = int(np.prod(self.shape, dtype=np.int64))
        return -(-n // 2) if self.kind in _HALF_BYTE else n * np.dtype(DTYPES[self.kind]).itemsize

    def array(self, folder: str = ".") -> np.ndarray:
        """The values; external data is mapped, not read. 4-bit tensors come packed, as bytes."""
        shape = (self.nbytes,) if self.kind in _HALF_BYTE else self.shape
        if self.location:
            return np.memmap(os.path.join(folder, self.location), dtype=DTYPES[self.kind], mode="r", offset=self.offset, shape=shape)
        return np.frombuffer(self.raw or b"", dtype=DTYPES[self.kind]).reshape(shape)


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: numbers, or bytes of nested messages and strings."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire}")
        yield number, value


def _tensor(data: bytes) -> Tensor:
    dims, kind, name, raw, floats, ints, external = [], 1, "", None, [], [], {}
    for number, value in fields(data):
        if number == 1:
            dims += [value] if isinstance(value, int) else list(_packed(value))
        elif number == 2:
            kind = value
        elif number == 4:
            floats.append(value)
        elif number in (5, 7):
            ints += [value] if isinstance(value, int) else list(_packed(value))
        elif number == 8:
            name = value.decode()
        elif number == 9:
            raw = value
        elif number == 13:
            pair = dict(fields(value))
            external[pair[1].decode()] = pair[2].decode()
    if raw is None and floats:
        raw = b"".join(floats)
    if raw is None and ints:
        raw = np.array([i - (1 << 64) if i >> 63 else i for i in ints], dtype=np.int64).astype(DTYPES[kind]).tobytes()
    length = external.get("length")
    return Tensor(name, tuple(dims), kind, raw, external.get("location"), int(external.get("offset", 0)), int(length) if length else None)


def _packed(data: bytes) -> Iterator[int]:
    at = 0
    while at < len(data):
        value, at = varint(data, at)
        yield value


def read_initialisers(path: str) -> dict[str, Tensor]:
    """The named tensors of a model file's graph."""
    with open(path, "rb") as f:
        model = f.read()
    out: dict[str, Tensor] = {}
    for number, graph in fields(model):
        if number == 7:
            for k, value in fields(graph):
                if k == 5:
                    t = _tensor(value)
                    out[t.name] = t
    return out
