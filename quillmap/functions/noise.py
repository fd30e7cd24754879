"""Reproducible noise: uniforms and normals that depend on seed, salt and id alone, not on partitions."""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: 13 hexadecimal digits of md5 give 52 bits.
SCALE = float(1 << 52)
SEED = 20260529


def uniform(ident: Column, salt: str, seed: int = SEED) -> Column:
    """In (0, 1)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), ident.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / SCALE


def normal(ident: Column, salt: str, seed: int = SEED) -> Column:
    """Standard normal, by the Box-Muller transform."""
    return F.sqrt(-2 * F.ln(uniform(ident, salt + "a", seed))) * F.cos(2 * F.pi() * uniform(ident, salt + "b", seed))


@F.pandas_udf(DoubleType())
def _residue(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for ids in batches:
        yield ids.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") % 10_000_000 / 10_000_000, na_action="ignore")


def residue(ident: Column) -> Column:
    """A share of a turn in [0, 1), in ten-millionths, from the 64-bit blake2b digest of an id; Spark has no such function, so ids go through Arrow."""
    return _residue(ident)
