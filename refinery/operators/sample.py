"""Sampling and top-k selection (a limit here is the feature itself)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seeded_sample(df: DataFrame, n: int, key: str | Sequence[str], seed: int = 42, hash: str = "xxhash64"
                  ) -> DataFrame:
    """A deterministic sample of ``n`` rows: the ``n`` smallest seeded hashes of the key.

    Same input and seed give the same rows on every run and every cluster
    size; planned as a per-partition top-n then one merge (no full sort).
    Fewer than ``n`` rows simply returns them all.  ``hash='md5'`` hashes the
    text ``key|...|seed``, which other engines can reproduce exactly.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if hash == "md5":
        h = F.md5(F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys], F.lit(str(seed))))
    else:
        h = F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(seed))
    return df.orderBy(h, *[F.col(f"`{k}`") for k in keys]).limit(n)


def seeded_fraction(df: DataFrame, fraction: float, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Bernoulli-style deterministic sample keeping about ``fraction`` of rows (no shuffle)."""
    keys = [key] if isinstance(key, str) else list(key)
    u = (F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(seed)), F.lit(1 << 30)).cast("double")
         / float(1 << 30))
    return df.filter(u < F.lit(fraction))
