"""Model names, token families and prices.

Prices are kept as whole nano-dollars per token, so costs add up exactly in any order; one division at
the end turns them into dollars.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name prefix -> dollars per million tokens (input, cached input, output, cache write or None).
PRICES = {
    "gpt-5.5": (5.0, 0.5, 30.0, None),
    "gpt-5.4-mini": (0.75, 0.075, 4.5, None),
    "gpt-5.4-nano": (0.20, 0.02, 1.25, None),
    "gpt-5.4": (2.50, 0.25, 15.0, None),
    "gpt-5.3-codex": (1.75, 0.175, 14.0, None),
    "gpt-5.2-codex": (1.75, 0.175, 14.0, None),
    "gpt-5.2": (1.75, 0.175, 14.0, None),
    "gpt-5.1-codex-mini": (0.25, 0.025, 2.0, None),
    "gpt-5.1": (1.25, 0.125, 10.0, None),
    "gpt-5-mini": (0.25, 0.025, 2.0, None),
    "gpt-5-nano": (0.05, 0.005, 0.40, None),
    "gpt-5": (1.25, 0.125, 10.0, None),
    "codex-mini": (1.5, 0.375, 6.0, None),
    "claude-opus": (5.0, 0.5, 25.0, 6.25),
    "claude-sonnet": (3.0, 0.3, 15.0, 3.75),
    "claude-haiku": (1.0, 0.1, 5.0, 1.25),
}


def normalize_model(model: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    m = F.when(
        F.startswith(m, F.lit("gpt5")) & ~F.startswith(m, F.lit("gpt-5")),
        F.concat(F.lit("gpt-5"), F.substring(m, F.lit(5), F.length(m))),
    ).otherwise(m)
    return F.when(F.startswith(m, F.lit("codex-mini")), F.lit("codex-mini")).otherwise(m)


def is_disjoint(model: Column) -> Column:
    """True when input, cached input and cache writes are separate buckets of this model."""
    return F.startswith(normalize_model(model), F.lit("claude"))


def uncached_input(inp: Column, cached: Column) -> Column:
    """Input minus the part read from a cache, for families whose input includes it."""
    return inp - F.least(cached, inp)


def fresh_input(model: Column, inp: Column, cached: Column) -> Column:
    """Input that was not read from a cache, by token family."""
    return F.when(is_disjoint(model), inp).otherwise(F.greatest(F.lit(0), uncached_input(inp, cached)))


def price_of(model_norm: Column) -> Column:
    """Struct (prefix, input, cached_input, output, cache_creation) of the longest matching prefix, or null.

    The table is fixed and small, so it is a CASE over prefixes ordered by length: no join, no shuffle.
    """
    out = None
    for prefix in sorted(PRICES, key=len, reverse=True):
        inp, cached, output, write = PRICES[prefix]
        value = F.struct(
            F.lit(prefix).alias("prefix"),
            F.lit(round(inp * 1000)).cast("bigint").alias("input"),
            F.lit(round(cached * 1000)).cast("bigint").alias("cached_input"),
            F.lit(round(output * 1000)).cast("bigint").alias("output"),
            F.lit(None if write is None else round(write * 1000)).cast("bigint").alias("cache_creation"),
        )
        hit = F.startswith(model_norm, F.lit(prefix))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def cost_nano(price: Column, inp: Column, cached: Column, creation: Column, output: Column, fresh: Column) -> Column:
    """Exact cost in nano-dollars of summed token buckets; 0 without a price.

    A price with a cache-write rate bills every bucket as it is; any other price bills ``fresh`` input at the
    input rate and the rest of the input at the cached rate.
    """

    def times(tokens: Column, rate: Column) -> Column:
        return tokens.cast("decimal(22,0)") * rate.cast("decimal(9,0)")

    with_write = (
        times(inp, price["input"]) + times(cached, price["cached_input"])
        + times(creation, price["cache_creation"]) + times(output, price["output"])
    )
    plain = times(fresh, price["input"]) + times(inp - fresh, price["cached_input"]) + times(output, price["output"])
    value = F.when(price["cache_creation"].isNotNull(), with_write).when(price["prefix"].isNotNull(), plain)
    return F.coalesce(value, F.lit(0)).cast("decimal(36,0)")


def nano_to_usd(nano: Column) -> Column:
    return nano.cast("double") / F.lit(1e9)
