"""Content hashes. A store uses one provider: md5 (built in, SQL can say it) or xxh3_128 (Arrow)."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def md5_hex(content: Column) -> Column:
    return F.md5(content)


@F.pandas_udf(T.BinaryType())
def xxh3_128(content: pd.Series) -> pd.Series:
    """XXH3-128 as its 16 bytes from the lowest up; of strings, the UTF-8 bytes."""
    return content.map(lambda b: None if b is None else xxhash.xxh3_128_intdigest(b).to_bytes(16, "little"))


def xxh3_hex(content: Column) -> Column:
    return F.lower(F.hex(xxh3_128(content)))


def short_id(path: str) -> str:
    """A project's id: the first 16 hexadecimal digits of the path's XXH3-128, highest byte first."""
    return f"{xxhash.xxh3_128_intdigest(path.encode()):032x}"[:16]


def hash_of_hex(digits: Column) -> Column:
    """The 16 bytes of 32 hexadecimal digits; anything else is an error."""
    return F.when(digits.rlike("^[0-9a-fA-F]{32}$"), F.unhex(digits)).when(digits.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not a hash: "), digits)))


@F.pandas_udf(T.BinaryType())
def lz4_frame(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else pa.compress(b, codec="lz4", asbytes=True))


@F.pandas_udf(T.BinaryType())
def lz4_plain(framed: pd.Series, size: pd.Series) -> pd.Series:
    """The content of LZ4 frames whose sizes the manifest knows; damaged frames are an error."""
    return pd.Series([None if b is None else pa.decompress(b, decompressed_size=int(n), codec="lz4", asbytes=True) if n else b"" for b, n in zip(framed, size, strict=True)])
