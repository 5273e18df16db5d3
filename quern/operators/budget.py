"""Context limits of providers and the share of them that a system prompt gets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits by part of a provider's name (the first that the name holds wins), and the defaults.
LIMITS = {"xai": 2_000_000, "anthropic": 200_000, "openai": 128_000, "ollama": 32_000, "groq": 128_000, "deepseek": 128_000}
DEFAULT_LIMIT, RATIO, CAP = 100_000, 0.05, 50_000


def context_limit(provider: Column) -> Column:
    name, out = F.lower(provider), None
    for key, limit in LIMITS.items():
        out = (F if out is None else out).when(name.contains(key), F.lit(limit))
    return out.otherwise(F.lit(DEFAULT_LIMIT)).cast("long")


def system_prompt_budget(provider: Column, ratio: float = RATIO, cap: int = CAP) -> Column:
    share = F.floor(context_limit(provider).cast("double") * F.lit(float(ratio)))
    return F.least(share, F.lit(cap)).cast("long")
