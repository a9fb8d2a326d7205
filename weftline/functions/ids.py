"""Identities: content hashes, short ids, design keys, shards, seeds, hash ranks."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VARIANT = r"\s*\((\d+)\)\s*$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed Unicode form (no built-in does it)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def compat_fold(s: pd.Series) -> pd.Series:
    """Compatibility form, case-folded: 'ß' becomes 'ss', full-width letters plain ones."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def _blake(size: int):
    @F.pandas_udf(T.BinaryType())
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=size).digest())

    return digest


def blake_hex(c: Column | str, digest_bytes: int = 16, length: int | None = None) -> Column:
    """Hex of the blake2b digest, cut to ``length`` characters."""
    h = F.lower(F.hex(_blake(digest_bytes)(_c(c))))
    return F.substring(h, 1, length) if length else h


def short_id(path: Column | str) -> Column:
    """Identity of a file: 12 hex characters over its composed relative path."""
    return blake_hex(nfc(_c(path)), 16, 12)


def content_hash(c: Column | str) -> Column:
    """md5 of bytes or UTF-8 text; NULL stays NULL."""
    return F.md5(_c(c))


def _md5_number(text: Column) -> Column:
    """The first 52 bits of an md5 as a number, computed inside the JVM."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def hash_rank(key: Column | str, seed: int = 0) -> Column:
    """Place of a key in [0, 1) that doesn't depend on row order."""
    return _md5_number(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))) / F.lit(float(1 << 52))


def blake_number(text: Column) -> Column:
    """An 8-byte blake2b digest as an unsigned number."""
    return F.conv(blake_hex(text, 8), 16, 10).cast("decimal(20,0)")


def blake_rank(key: Column | str, seed: int = 0) -> Column:
    """``hash_rank`` over an 8-byte blake2b digest, for parity with stored splits."""
    return blake_number(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))).cast("double") / F.lit(2.0**64)


def blake_shard(key: Column | str, shards: int) -> Column:
    """``shard_of`` over an 8-byte blake2b digest, for parity with stored stage outputs."""
    return (blake_number(_c(key).cast("string")) % F.lit(shards)).cast("int")


def blake_seed(pair: Column | str, base: int = 0) -> Column:
    """``pair_seed`` over an 8-byte blake2b digest, for parity with stored metrics."""
    return (blake_number(F.concat(F.lit(f"{base}:"), _c(pair).cast("string"))) % F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")


def shard_of(key: Column | str, shards: int) -> Column:
    """Stable shard number over the whole key."""
    return F.pmod(_md5_number(_c(key).cast("string")), F.lit(shards)).cast("int")


def pair_seed(pair: Column | str, base: int = 0) -> Column:
    """Seed of a pair, the same in all runs."""
    return _md5_number(F.concat(F.lit(f"{base}:"), _c(pair).cast("string")))


def pair_id(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws("_", _c(a), _c(b))


def base_title(folder: Column | str) -> Column:
    """Folder name without its trailing ``(N)``."""
    return F.regexp_replace(_c(folder), _VARIANT, "")


def variant_number(folder: Column | str) -> Column:
    """N of a trailing ``(N)``, 1 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(folder), _VARIANT, 1), F.lit("")).try_cast("int"), F.when(_c(folder).isNotNull(), F.lit(1)))


def design_key(folder: Column | str, exact: bool = False) -> Column:
    """Title in one spelling: no variant, lower case, ё as е, single blanks, trimmed. ``exact`` folds by Unicode compatibility too (Arrow UDF)."""
    t = base_title(folder)
    t = compat_fold(t) if exact else F.lower(t)
    return F.trim(F.regexp_replace(F.translate(t, "ё", "е"), r"\s+", " "))


def leading_number(name: Column | str) -> Column:
    """Number at the start of a file name, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(name), r"^(\d+)", 1), F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit patterns."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))
