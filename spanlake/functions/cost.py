"""Cost expressions (C1, C2) over the fixed price catalog.

The catalog is a bounded constant (43 rows), so the lookup is a map literal
inside the projection: no join, no exchange, stays in whole-stage codegen.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.prices import (CLOUD_PRICES_PER_MILLION, COST_TYPE, LOCAL_DEFAULT_PER_MILLION,
                              LOCAL_PRICES_PER_MILLION, LOCAL_PROVIDER, LOCAL_TAG,
                              per_token)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rates_sql(pair) -> str:
    i, o = pair
    return (f"named_struct('input_rate', CAST({per_token(i)} AS DECIMAL(12,9)), "
            f"'output_rate', CAST({per_token(o)} AS DECIMAL(12,9)))")


@functools.lru_cache(maxsize=None)
def _rate_map_sql(name: str) -> str:
    table = {"cloud": CLOUD_PRICES_PER_MILLION, "local": LOCAL_PRICES_PER_MILLION}[name]
    return "map(" + ", ".join(f"'{k}', {_rates_sql(v)}" for k, v in table.items()) + ")"


def _rates(pair) -> Column:
    return F.expr(_rates_sql(pair))


def _rate_map(name: str) -> Column:
    """The catalog as one map literal, built by the SQL parser in a single call."""
    return F.expr(_rate_map_sql(name))


def rates_for(provider_raw, model) -> Column:
    """struct(input_rate, output_rate) or NULL when the model is not priced."""
    p = F.lower(_c(provider_raw))
    m = F.lower(_c(model))
    cloud = F.try_element_at(_rate_map("cloud"), F.concat(p, F.lit(":"), m))
    local_map = _rate_map("local")
    base = F.substring_index(m, LOCAL_TAG, 1)
    local = F.coalesce(F.try_element_at(local_map, base), F.try_element_at(local_map, m),
                       _rates(LOCAL_DEFAULT_PER_MILLION))
    return F.when(p == LOCAL_PROVIDER, local).otherwise(cloud)


def raw_cost(rates: Column, prompt, completion) -> Column:
    """Exact in*p + out*c (scale 9); NULL when a count or the rate is NULL."""
    return rates["input_rate"] * _c(prompt) + rates["output_rate"] * _c(completion)


def linear_cost(rates: Column, prompt, completion) -> Column:
    """in*p + out*c stored as DECIMAL(12,6) (half-up)."""
    p, c = _c(prompt), _c(completion)
    return F.when(p.isNotNull() & c.isNotNull(), raw_cost(rates, p, c).cast(COST_TYPE))


def call_cost(provider_raw, model, prompt, completion) -> Column:
    return linear_cost(rates_for(provider_raw, model), prompt, completion)


def local_cost(model, prompt, completion) -> Column:
    """C2 applied regardless of provider (used by the backfill)."""
    return linear_cost(rates_for(F.lit(LOCAL_PROVIDER), model), prompt, completion)
