"""Keys and identifiers of statements and nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The key bytes 0 to 15 as two words, and SipHash's initial state.
K0, K1 = 0x0706050403020100, 0x0F0E0D0C0B0A0908
STATE = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)


def sip_2_4(texts: list[bytes | None]) -> np.ndarray:
    """64-bit SipHash-2-4 of byte strings, all of them side by side, one 8-byte word at a time; 0 for None."""
    raw = [t or b"" for t in texts]
    size = np.array([len(t) for t in raw], np.int64)
    words = size // 8 + 1  # the last one holds what is left and the length
    order = np.argsort(-words, kind="stable")
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(words * 8, out=offsets[1:])
    data = np.frombuffer(b"".join(t + bytes(7 - len(t) % 8) + bytes([len(t) & 255]) for t in raw), "<u8") if raw else np.zeros(0, np.uint64)
    first = (offsets[:-1] // 8)[order]
    counts = words[order]
    v = [np.full(len(raw), s ^ k, np.uint64) for s, k in zip(STATE, (K0, K1, K0, K1), strict=True)]

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def rounds(a: list[np.ndarray], times: int) -> None:
        for _ in range(times):
            a[0] += a[1]
            a[1] = turn(a[1], 13) ^ a[0]
            a[0] = turn(a[0], 32)
            a[2] += a[3]
            a[3] = turn(a[3], 16) ^ a[2]
            a[0] += a[3]
            a[3] = turn(a[3], 21) ^ a[0]
            a[2] += a[1]
            a[1] = turn(a[1], 17) ^ a[2]
            a[2] = turn(a[2], 32)

    with np.errstate(over="ignore"):
        for w in range(int(counts[0]) if len(counts) else 0):
            n = int(np.searchsorted(-counts, -w, "left"))  # texts with more than w words come first
            part = [x[:n].copy() for x in v]
            m = data[first[:n] + w]
            part[3] ^= m
            rounds(part, 2)
            part[0] ^= m
            for x, p in zip(v, part, strict=True):
                x[:n] = p
        v[2] ^= np.uint64(0xFF)
        rounds(v, 4)
        h = v[0] ^ v[1] ^ v[2] ^ v[3]
    out = np.zeros(len(raw), np.uint64)
    out[order] = h
    return out.view(np.int64)


@F.arrow_udf(T.LongType())
def sip_hash(texts: pa.Array) -> pa.Array:
    """SipHash-2-4 of the UTF-8 bytes as a bigint; null for null. For parity of identifiers only: nothing is joined on it."""
    known = sip_2_4([t.encode() if t is not None else None for t in texts.to_pylist()])
    return pa.array(known, pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))


def uuid_or_hash(uuid: Column) -> Column:
    """A uuid that is a number as it is, any other as its hash."""
    return F.coalesce(uuid.try_cast("bigint"), sip_hash(uuid))


def resource_hash(uri: Column, model: Column) -> Column:
    return sip_hash(F.concat(uri, F.coalesce(model, F.lit(""))))


def joined(*parts: Column) -> Column:
    """A digest of parts, which null and empty strings enter alike."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def statement_key(model: str = "model") -> Column:
    """Digest of what makes two statements the same: model, subject, predicate and object with their kinds."""
    return joined(
        F.col(model), F.concat_ws(":", "subject_kind", "subject_id"), F.col("predicate"), F.concat_ws(":", "object_kind", F.coalesce("object_value", "object_id"))
    )


def key_number(key: Column) -> Column:
    """A number for a statement from its key, for display and look-up; the key itself is its identity."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def blank_id(load_id: str | Column, label: Column) -> Column:
    """Surrogate of a blank node from its label, which counts within one load only."""
    load = F.lit(load_id) if isinstance(load_id, str) else load_id
    return F.sha2(F.concat_ws("|", load, label), 256)
