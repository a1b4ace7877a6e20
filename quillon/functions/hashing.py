"""md5 buckets: the 128-bit digest of a text, reduced modulo a small number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def md5_mod(text: Column, modulus: int) -> Column:
    """`int(md5(text), 16) % modulus`, taken 32 bits at a time so that a long never overflows."""
    digest = F.md5(text.cast("string"))
    step = (1 << 32) % modulus
    remainder = F.lit(0).cast("long")
    for start in (1, 9, 17, 25):
        chunk = F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
        remainder = (remainder * step + chunk) % modulus
    return remainder


def percent_bucket(text: Column) -> Column:
    """A stable percentage 0.00 .. 99.99 for a text."""
    return md5_mod(text, 10000) / F.lit(100.0)


def pick_by_share(point: Column, shares: list[tuple[str, float]], inclusive: bool) -> Column:
    """The first name whose running share reaches `point`; null when none does."""
    picked = F.lit(None).cast("string")
    running = 0.0
    bounds = []
    for name, share in shares:
        running += share
        bounds.append((name, running))
    for name, bound in reversed(bounds):
        hit = point <= F.lit(bound) if inclusive else point < F.lit(bound)
        picked = F.when(hit, F.lit(name)).otherwise(picked)
    return picked
