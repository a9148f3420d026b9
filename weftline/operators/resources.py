"""Resource requests: declared, overridden, rounded and capped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import round_up


def resolve(declared: Column, from_split: Column, override: Column, default: float, cap: Column | float, parts: int) -> Column:
    """override, else the split's answer, else the declaration, else the default (also for 0), rounded away from zero; negative means "at least, as much as there is" and becomes the cap or its own size."""
    asked = F.coalesce(override, from_split, declared, F.lit(default))
    asked = round_up(F.when(asked == 0, F.lit(default)).otherwise(asked), parts)
    top = F.lit(cap) if not isinstance(cap, Column) else cap
    return F.when(asked < 0, F.greatest(-asked, top)).otherwise(F.least(asked, top))


def virtual(mem_gb: Column, vmem_gb: Column, extra: float = 3.0) -> Column:
    """Virtual memory: as asked, at least the memory, else the memory and some more."""
    return F.when(F.coalesce(vmem_gb, F.lit(0)) <= 0, mem_gb + extra).otherwise(F.greatest(vmem_gb, mem_gb))
