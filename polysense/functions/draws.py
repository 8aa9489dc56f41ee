"""Portable pseudo-random draws made of integer arithmetic only.

``mix(x) = x^5 mod P`` is a bijection on [0, P) because gcd(5, P-1) = 1. A draw
chains it over a seed and any number of integer keys, so every row's number depends
on the row's key alone: retried or re-partitioned tasks draw the same values, and
any SQL engine can repeat them. A bigint key enters as two numbers, the bits above
and below bit 31, since one number below P cannot hold it. Products stay below 2^62.
"""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import Column, DataFrame, functions as F

# fixed values of the generator
P = 2147483647
SEED_SHIFT = 12345
MULTIPLIERS = (69621, 40692, 16807)

# one seed per purpose; offsets from the run's seed
SEED_SPLIT, SEED_SHARD, SEED_SENSE = 1, 2, 3
SEED_NEG_WORD, SEED_NEG_SENSE = 4, 5
SEED_INIT_IN, SEED_INIT_OUT = 6, 7
SEED_WARM_IN, SEED_WARM_OUT = 8, 9
SEED_DONOR, SEED_RESET_IN, SEED_RESET_OUT = 10, 11, 12
SEED_GROUP, SEED_CHOICE = 13, 14


def start(seed: int) -> int:
    """First state of the chain."""
    return pow(seed % P + SEED_SHIFT, 5, P)


def mix(x: Column) -> Column:
    """``x^5 mod P``; give it a plain column, since it repeats its input."""
    p = F.lit(P).cast("bigint")
    return ((x * x % p) * (x * x % p) % p) * x % p


def step(state: Column, key: Column, multiplier: int) -> Column:
    p = F.lit(P).cast("bigint")
    return (state + F.pmod(key.cast("bigint"), p) * F.lit(multiplier)) % p


def with_draw(df: DataFrame, name: str, seed: int, *keys: str | Column) -> DataFrame:
    """Add bigint column ``name`` in [0, P), drawn by ``seed`` and the keys."""
    columns = df.columns
    named = [F.col(key) if isinstance(key, str) else key for key in keys]
    types = df.select(*[key.alias(f"k{i}") for i, key in enumerate(named)]).dtypes
    parts = [part for key, (_, kind) in zip(named, types, strict=True) for part in (limbs(key) if kind == "bigint" else [key])]
    state = F.lit(start(seed)).cast("bigint")
    for i, (key, multiplier) in enumerate(zip(parts, cycle(MULTIPLIERS))):
        raw, mixed = f"_{name}{i}r", f"_{name}{i}m"
        df = df.withColumn(raw, step(state, key, multiplier))
        df = df.withColumn(mixed, mix(F.col(raw)))
        state = F.col(mixed)
    return df.select(*[c for c in columns if c != name], present(state).alias(name))


def limbs(key: Column) -> list[Column]:
    """A bigint as the bits above and below bit 31."""
    return [F.shiftright(key, 31), key.bitwiseAND(F.lit(P).cast("bigint"))]


def with_second_draw(df: DataFrame, name: str, first: str) -> DataFrame:
    """Add the draw that follows draw ``first``; the two together make 62 bits."""
    columns = df.columns
    df = df.withColumn(f"_{name}r", step(F.col(first), F.lit(1), MULTIPLIERS[0]))
    return df.select(*[c for c in columns if c != name], present(mix(F.col(f"_{name}r"))).alias(name))


def present(x: Column) -> Column:
    """Mark a draw as never null. Joins on it then need no null filter, which the optimizer
    would push below the chain, writing the whole chain out at every use."""
    return F.coalesce(x, F.lit(0))


def below(draw: Column, n: int | Column) -> Column:
    """Draw -> int in [0, n)."""
    return present((draw % n).cast("int"))


def unit(draw: Column) -> Column:
    """Draw -> double in [0, 1)."""
    return draw.cast("double") / F.lit(float(P))


def fine_unit(first: Column, second: Column) -> Column:
    """Two draws -> double in [0, 1) that is as fine as a double can be."""
    return (first.cast("double") + unit(second)) / F.lit(float(P))


def unit_array(state: Column, n: int, multiplier: int = MULTIPLIERS[2]) -> Column:
    """``n`` doubles in [0, 1) continuing the chain ``state`` with keys 0..n-1."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: step(state, i, multiplier))
    return F.transform(raw, lambda x: unit(mix(x)))
