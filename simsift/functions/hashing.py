"""32-bit hashes: the first four bytes of a digest as a little-endian unsigned integer, in a long."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def _little_endian(hex_digest: Column) -> Column:
    pairs = [F.substring(hex_digest, i, 2) for i in (7, 5, 3, 1)]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def sha1_le32(text: Column) -> Column:
    return _little_endian(F.sha1(text.cast("binary")))


def _by_digest(digest: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    def distinct(words: pa.Array) -> pa.Array:
        """Hashes of words; each distinct word of the batch is hashed once."""
        coded = words.dictionary_encode()
        raw = b"".join(digest(w.encode())[:4] for w in coded.dictionary.to_pylist())
        return pa.array(np.frombuffer(raw, "<u4").astype(np.int64)).take(coded.indices)

    def hashed(text: Column) -> Column:
        @F.arrow_udf("long")
        def run(texts: pa.Array) -> pa.Array:
            return distinct(texts)

        return run(text)

    def over_arrays(texts: Column) -> Column:
        @F.arrow_udf("array<long>")
        def run(rows: pa.Array) -> pa.Array:
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy())))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), distinct(rows.flatten()), mask=rows.is_null())

        return run(texts)

    hashed.over_arrays = over_arrays
    return hashed


sha3_le32 = _by_digest(lambda b: hashlib.sha3_224(b).digest())
xxh32_le32 = _by_digest(lambda b: xxhash.xxh32(b).digest())

#: Hashes by name; register a Column -> Column function to add one: a built-in expression, or one that has its form for
#: arrays of words as `over_arrays`.
HASHES: dict[str, Callable[[Column], Column]] = {"sha1": sha1_le32, "sha3": sha3_le32, "xxh32": xxh32_le32}


def register_hash(name: str, function: Callable[[Column], Column]) -> None:
    HASHES[name] = function


def float_le32(number: Column) -> Column:
    """The four bytes of a number as little-endian float32, read as an unsigned integer: the hash of a learned code."""

    @F.pandas_udf("long")
    def run(numbers: pd.Series) -> pd.Series:
        found = pd.Series(numbers.to_numpy("float32", na_value=np.nan).view("<u4").astype("int64"), dtype="Int64")
        return found.mask(numbers.isna().reset_index(drop=True))

    return run(number)


def digest_floats(digest: Column) -> Column:
    """The first eight bytes of a digest as two little-endian float32."""

    @F.pandas_udf("array<float>")
    def run(digests: pd.Series) -> pd.Series:
        return digests.map(lambda d: None if d is None else np.frombuffer(bytes(d)[:8], "<f4"))

    return run(digest)
