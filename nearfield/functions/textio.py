"""Text and binary forms of the vector types, as Arrow-batched functions.

Text: ``[1,2,3]`` for vector and halfvec, ``{1:1.5,3:2}/5`` (indices from 1) for sparsevec; white space is allowed between
parts. Numbers are written in the shortest form that reads back to the same float. Binary: big-endian, as a header and
the elements.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..types import HALF_MAX_DIM, SPARSE_DDL, SPARSE_MAX_DIM, SPARSE_MAX_NNZ, VECTOR_MAX_DIM

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?:inf(?:inity)?|nan)"
_ELEMENT = re.compile(rf"\s*({_NUMBER})\s*", re.I)
_ENTRY = re.compile(rf"\s*([+-]?\d+)\s*:\s*({_NUMBER})\s*", re.I)
_INT_MAX = 2**31 - 1


def _float(text: str, kind: str, underflow: bool = False) -> float:
    v = float(text)
    if v != v:
        raise ValueError(f"NaN not allowed in {kind}")
    if "inf" in text.lower():
        raise ValueError(f"infinite value not allowed in {kind}")
    with np.errstate(over="ignore", under="ignore"):
        f = np.float16(v) if kind == "halfvec" else np.float32(v)
    if np.isinf(f) or (underflow and f == 0 and v != 0):
        raise ValueError(f'"{text}" is out of range for type {kind}')
    return float(f)


def parse_dense(text: str, kind: str = "vector", dim: int | None = None) -> list[float]:
    syntax = ValueError(f'invalid input syntax for type {kind}: "{text}"')
    body = text.strip(" \t\n\r\v\f")
    if not (body.startswith("[") and body.endswith("]") and len(body) > 1):
        raise syntax
    inner = body[1:-1]
    if not inner.strip():
        raise ValueError(f"{kind} must have at least 1 dimension")
    parts = inner.split(",")
    most = VECTOR_MAX_DIM if kind == "vector" else HALF_MAX_DIM
    if len(parts) > most:
        raise ValueError(f"{kind} cannot have more than {most} dimensions")
    out = []
    for p in parts:
        m = _ELEMENT.fullmatch(p)
        if not m:
            raise syntax
        out.append(_float(m[1], kind))
    if dim is not None and len(out) != dim:
        raise ValueError(f"expected {dim} dimensions, not {len(out)}")
    return out


def parse_sparse(text: str, dim: int | None = None) -> dict:
    syntax = ValueError(f'invalid input syntax for type sparsevec: "{text}"')
    m = re.fullmatch(r"\s*\{(.*)\}\s*/\s*([+-]?\d+)\s*", text, re.S)
    if not m:
        raise syntax
    n = int(m[2])
    if n < 1:
        raise ValueError("sparsevec must have at least 1 dimension")
    if n > SPARSE_MAX_DIM:
        raise ValueError(f"sparsevec cannot have more than {SPARSE_MAX_DIM} dimensions")
    entries = []
    for p in m[1].split(",") if m[1].strip() else []:
        e = _ENTRY.fullmatch(p)
        if not e:
            raise syntax
        entries.append((min(max(int(e[1]), -_INT_MAX), _INT_MAX) - 1, _float(e[2], "sparsevec", underflow=True)))
    if len(entries) > SPARSE_MAX_NNZ:
        raise ValueError(f"sparsevec cannot have more than {SPARSE_MAX_NNZ} non-zero elements")
    entries = sorted((i, x) for i, x in entries if x != 0 or not 0 <= i < n) if entries else []
    entries = sorted(entries)
    for k, (i, _) in enumerate(entries):
        if not 0 <= i < n:
            raise ValueError("sparsevec index out of bounds")
        if k and i == entries[k - 1][0]:
            raise ValueError("sparsevec indices must not contain duplicates")
    if dim is not None and n != dim:
        raise ValueError(f"expected {dim} dimensions, not {n}")
    return {"dim": n, "indices": [i for i, _ in entries], "values": [x for _, x in entries]}


def shortest(x: float) -> str:
    """The shortest text of a float32: plain for exponents -5 < e < 6, else like 1e+06."""
    f = np.float32(x)
    if f == 0:
        return "-0" if np.signbit(f) else "0"
    digits, exp = np.format_float_scientific(f, unique=True, trim="-").split("e")
    e = int(exp)
    if -5 < e < 6:
        return np.format_float_positional(f, unique=True, trim="-")
    return f"{digits}e{'-' if e < 0 else '+'}{abs(e):02d}"


def format_dense(v) -> str:
    return "[" + ",".join(shortest(x) for x in v) + "]"


def format_sparse(v) -> str:
    return "{" + ",".join(f"{i + 1}:{shortest(x)}" for i, x in zip(v["indices"], v["values"])) + f"}}/{v['dim']}"


def pack_dense(v, kind: str = "vector") -> bytes:
    return struct.pack(">HH", len(v), 0) + np.asarray(v, dtype=np.float32).astype(">f2" if kind == "halfvec" else ">f4").tobytes()


def unpack_dense(b: bytes, kind: str = "vector") -> list[float]:
    dim, unused = struct.unpack(">HH", b[:4])
    if unused:
        raise ValueError(f"expected unused to be 0, not {unused}")
    if not 1 <= dim <= VECTOR_MAX_DIM:
        raise ValueError(f"{kind} must have at least 1 dimension" if dim < 1 else f"{kind} cannot have more than {VECTOR_MAX_DIM} dimensions")
    out = np.frombuffer(b, ">f2" if kind == "halfvec" else ">f4", dim, 4).astype(np.float32)
    if np.isnan(out).any():
        raise ValueError(f"NaN not allowed in {kind}")
    if np.isinf(out).any():
        raise ValueError(f"infinite value not allowed in {kind}")
    return out.tolist()


def pack_sparse(v) -> bytes:
    n = len(v["indices"])
    return struct.pack(">iii", v["dim"], n, 0) + np.asarray(v["indices"], dtype=">i4").tobytes() + np.asarray(v["values"], dtype=">f4").tobytes()


def unpack_sparse(b: bytes) -> dict:
    dim, n, unused = struct.unpack(">iii", b[:12])
    if unused:
        raise ValueError(f"expected unused to be 0, not {unused}")
    at = np.frombuffer(b, ">i4", n, 12)
    x = np.frombuffer(b, ">f4", n, 12 + 4 * n).astype(np.float32)
    if len(at) and (at[0] < 0 or at[-1] >= dim):
        raise ValueError("sparsevec index out of bounds")
    if (np.diff(at) <= 0).any():
        raise ValueError("sparsevec indices must not contain duplicates" if (np.diff(at) == 0).any() else "sparsevec indices must be in ascending order")
    if (x == 0).any():
        raise ValueError("binary representation of sparsevec cannot contain zero values")
    return {"dim": dim, "indices": at.astype(int).tolist(), "values": x.tolist()}


def _each(f, returns: str):
    @F.pandas_udf(returns)
    def g(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return g


def _structs(f):
    def rows(s: pd.Series) -> pd.DataFrame:
        got = [{"dim": None, "indices": None, "values": None} if x is None else f(x) for x in s]
        return pd.DataFrame(got, columns=["dim", "indices", "values"])

    @F.pandas_udf(SPARSE_DDL)
    def g(s: pd.Series) -> pd.DataFrame:
        return rows(s)

    return g


def _from_structs(f, returns: str):
    @F.pandas_udf(returns)
    def g(d: pd.DataFrame) -> pd.Series:
        return pd.Series([None if i is None else f({"dim": n, "indices": i, "values": v}) for n, i, v in zip(*(d.iloc[:, k] for k in range(3)))])

    return g


def _dense_reader(kind: str, dim: int | None = None):
    return _each(lambda t: parse_dense(t, kind, dim), "array<float>")


def _dense_writer(kind: str):
    return _each(lambda v: pack_dense(v, kind), "binary")


def _dense_unpacker(kind: str):
    return _each(lambda b: unpack_dense(bytes(b), kind), "array<float>")


def sql_functions() -> dict[str, object]:
    """The text and binary forms by their SQL names."""
    out = {"vector_out": _each(format_dense, "string"), "halfvec_out": _each(format_dense, "string")}
    for kind in ("vector", "halfvec"):
        out |= {f"{kind}_in": _dense_reader(kind), f"{kind}_send": _dense_writer(kind), f"{kind}_recv": _dense_unpacker(kind)}
    out |= {"sparsevec_in": _structs(parse_sparse), "sparsevec_out": _from_structs(format_sparse, "string")}
    return out | {"sparsevec_send": _from_structs(pack_sparse, "binary"), "sparsevec_recv": _structs(lambda b: unpack_sparse(bytes(b)))}


def vector_in(c, kind: str = "vector", dim: int | None = None):
    return _dense_reader(kind, dim)(c)


def vector_out(c):
    return _each(format_dense, "string")(c)


def vector_send(c, kind: str = "vector"):
    return _dense_writer(kind)(c)


def vector_recv(c, kind: str = "vector"):
    return _dense_unpacker(kind)(c)


def sparsevec_in(c, dim: int | None = None):
    return _structs(lambda t: parse_sparse(t, dim))(c)


def sparsevec_out(c):
    return _from_structs(format_sparse, "string")(c)


def sparsevec_send(c):
    return _from_structs(pack_sparse, "binary")(c)


def sparsevec_recv(c):
    return _structs(lambda b: unpack_sparse(bytes(b)))(c)
