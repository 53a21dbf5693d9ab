"""Fitted states as named tensors in the safetensors layout: header length, JSON header, data. Written whole or in shards, with optional gzip."""

from __future__ import annotations

import gzip
import json
import struct

import numpy as np

from loomstat.base import Model
from loomstat.errors import InvalidParameter, SchemaMismatch

_TYPES = {"F64": "<f8", "F32": "<f4", "I64": "<i8", "U8": "|u1"}
_ALIGN = 8


def _tensor(value) -> np.ndarray | None:
    """Rectangular numbers as an array, anything else as None."""
    if isinstance(value, bool) or not isinstance(value, (list, tuple)) or not value:
        return None
    try:
        a = np.array(value)
    except ValueError:
        return None
    return a.astype("<f8") if a.dtype.kind == "f" else a.astype("<i8") if a.dtype.kind == "i" else None


def encode(tensors: dict[str, np.ndarray], metadata: dict[str, str] | None = None, compress: bool = False) -> bytes:
    header, parts, at = {"__metadata__": metadata or {}}, [], 0
    names = {v: k for k, v in _TYPES.items()}
    for name in sorted(tensors):
        a = np.ascontiguousarray(tensors[name])
        kind = a.dtype.newbyteorder("<").str.replace("=", "<")
        if kind not in names:
            raise InvalidParameter(f"{name}: type {a.dtype}")
        raw = a.astype(kind).tobytes()
        header[name] = {"dtype": names[kind], "shape": list(a.shape), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    text = json.dumps(header, separators=(",", ":")).encode()
    text += b" " * (-len(text) % _ALIGN)
    whole = struct.pack("<Q", len(text)) + text + b"".join(parts)
    return gzip.compress(whole, mtime=0) if compress else whole


def decode(data: bytes) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if len(data) < 8 or (n := struct.unpack_from("<Q", data)[0]) > len(data) - 8:
        raise SchemaMismatch("not a tensor file")
    header = json.loads(data[8 : 8 + n])
    metadata, out, base = header.pop("__metadata__", {}), {}, 8 + n
    for name, t in header.items():
        a, b = t["data_offsets"]
        if t["dtype"] not in _TYPES or base + b > len(data):
            raise SchemaMismatch(f"{name}: {t['dtype']}, bytes {a} to {b}")
        out[name] = np.frombuffer(data[base + a : base + b], _TYPES[t["dtype"]]).reshape(t["shape"])
    return out, metadata


def shards(tensors: dict[str, np.ndarray], most_bytes: int) -> list[list[str]]:
    """Names for each file: in order of name, as many as fit; a larger tensor goes alone."""
    out, size = [], 0
    for name in sorted(tensors):
        n = tensors[name].nbytes
        if not out or size + n > most_bytes:
            out.append([])
            size = 0
        out[-1].append(name)
        size += n
    return out


def model_bytes(model: Model, compress: bool = False) -> bytes:
    """Rectangular numbers of the state as tensors, the rest as metadata."""
    state = model.state()
    tensors = {k: a for k, v in state.items() if (a := _tensor(v)) is not None}
    rest = {k: v for k, v in state.items() if k not in tensors}
    return encode(tensors, {"module": type(model).__module__, "name": type(model).__name__, "state": json.dumps(rest)}, compress)


def model_from(data: bytes) -> Model:
    import importlib

    tensors, meta = decode(data)
    if not meta.get("module", "").startswith("loomstat."):
        raise SchemaMismatch("no model of this engine")
    kind = getattr(importlib.import_module(meta["module"]), meta["name"])
    if not (isinstance(kind, type) and issubclass(kind, Model)):
        raise SchemaMismatch(f"{meta['name']} is not a model")
    return kind(**json.loads(meta["state"]), **{k: v.tolist() for k, v in tensors.items()})
