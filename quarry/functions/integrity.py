"""ETags and checksums."""

from __future__ import annotations

import base64
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Crc:
    """A reflected CRC that starts from and ends with all ones inverted; poly is its reversed polynomial."""

    poly: int
    bits: int

    @property
    def ones(self) -> int:
        return (1 << self.bits) - 1

    @cache
    def table(self) -> np.ndarray:
        out = np.arange(256, dtype=np.uint64)
        for _ in range(8):
            out = (out >> np.uint64(1)) ^ np.where(out & np.uint64(1), np.uint64(self.poly), np.uint64(0))
        return out

    def times(self, x: int, y: int) -> int:
        """The product of two polynomials; the highest bit stands for 1."""
        out = 0
        for k in range(self.bits - 1, -1, -1):
            if y >> k & 1:
                out ^= x
            x = (x >> 1) ^ (self.poly if x & 1 else 0)
        return out

    @cache
    def power(self, n: int) -> int:
        """x^(8 n)"""
        out, base = 1 << self.bits - 1, 1 << self.bits - 9
        while n:
            if n & 1:
                out = self.times(out, base)
            base, n = self.times(base, base), n >> 1
        return out

    def of(self, data: bytes) -> int:
        """Equal runs of the bytes go through the table side by side, then they are joined; zeros in front change nothing."""
        lanes = math.isqrt(len(data)) or 1
        steps = -(-len(data) // lanes)
        grid = np.frombuffer(data.rjust(lanes * steps, b"\0"), np.uint8).reshape(lanes, steps).astype(np.uint64)
        run = np.zeros(lanes, np.uint64)
        for k in range(steps):
            run = self.table()[(run ^ grid[:, k]) & np.uint64(0xFF)] ^ (run >> np.uint64(8))
        out = 0
        for lane in run:
            out = self.times(out, self.power(steps)) ^ int(lane)
        return out ^ self.times(self.ones, self.power(len(data))) ^ self.ones

    def joined(self, a: int, b: int, length: int) -> int:
        """The CRC of two parts together, from their own and the second's length."""
        return self.times(a, self.power(length)) ^ b

    def bytes(self, value: int) -> bytes:
        return value.to_bytes(self.bits // 8, "big")


#: Reversed polynomials.
CRCS = {"CRC32": Crc(0xEDB88320, 32), "CRC32C": Crc(0x82F63B78, 32), "CRC64NVME": Crc(0x9A6C9329AC4BC9B5, 64)}


def etag(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def multipart_etag(parts: DataFrame, upload: str = "upload_id", number: str = "number", md5: str = "md5") -> DataFrame:
    """MD5 of the parts' MD5s in the order of their numbers, and how many; an upload has 10,000 parts at most."""
    ordered = F.array_sort(F.collect_list(F.struct(number, md5)))
    joined = F.array_join(F.transform(ordered, lambda p: p[md5]), "")
    return parts.groupBy(upload).agg(F.concat(F.md5(F.unhex(joined)), F.lit("-"), F.count("*")).alias("etag"))


def _digest(algorithm: str) -> Callable[[bytes], bytes]:
    if algorithm in CRCS:
        crc = CRCS[algorithm]
        return lambda data: crc.bytes(crc.of(data))
    import xxhash

    hashes = {"XXHASH64": xxhash.xxh64_digest, "XXHASH3": xxhash.xxh3_64_digest, "XXHASH128": xxhash.xxh3_128_digest}
    return hashes[algorithm]


def checksum(content: Column, algorithm: str) -> Column:
    """Base64 of CRC32, CRC32C, CRC64NVME, SHA1, SHA256, SHA512, MD5, XXHASH64, XXHASH3 or XXHASH128; null of null.

    What Spark has itself stays in the JVM; the others go through Arrow batches.
    """
    b = content.cast("binary")
    if algorithm in ("CRC32C", "CRC64NVME", "XXHASH64", "XXHASH3", "XXHASH128"):

        @F.pandas_udf("binary")
        def digest(values: pd.Series) -> pd.Series:
            one = _digest(algorithm)
            return values.map(lambda v: None if v is None else one(bytes(v)))

        return F.base64(digest(b))
    hexes = {"CRC32": F.lpad(F.hex(F.crc32(b)), 8, "0"), "SHA1": F.sha1(b), "SHA256": F.sha2(b, 256), "SHA512": F.sha2(b, 512), "MD5": F.md5(b)}
    # base64 breaks its lines after 76 characters
    return F.replace(F.base64(F.unhex(hexes[algorithm])), F.lit("\r\n"), F.lit(""))


def composite_checksum(parts: DataFrame, algorithm: str, upload: str = "upload_id", number: str = "number", value: str = "checksum") -> DataFrame:
    """(upload, checksum): the checksum of the parts' raw checksums in the order of their numbers."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(number).alias("k"), F.hex(F.unbase64(F.col(value))).alias("v"))))
    joined = F.unhex(F.array_join(F.transform(ordered, lambda p: p["v"]), ""))
    return parts.groupBy(upload).agg(joined.alias("__raw")).select(upload, checksum(F.col("__raw"), algorithm).alias("checksum"))


def full_checksum(parts: DataFrame, algorithm: str, upload: str = "upload_id", number: str = "number", value: str = "checksum", size: str = "size") -> DataFrame:
    """(upload, checksum): the CRC of the parts' joined content, from their CRCs and sizes alone."""
    crc = CRCS[algorithm]

    @F.pandas_udf("string")
    def fold(uploads: pd.Series) -> pd.Series:
        out = []
        for rows in uploads:
            total = 0
            for r in rows:
                total = crc.joined(total, int.from_bytes(base64.b64decode(r["v"]), "big"), int(r["n"]))
            out.append(base64.b64encode(crc.bytes(total)).decode())
        return pd.Series(out)

    ordered = F.array_sort(F.collect_list(F.struct(F.col(number).alias("k"), F.col(value).alias("v"), F.col(size).cast("long").alias("n"))))
    return parts.groupBy(upload).agg(ordered.alias("__parts")).select(upload, fold("__parts").alias("checksum"))
