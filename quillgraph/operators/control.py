"""Small settings records: defaults, limits, allowed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default, least and most of each number; allowed modes; other defaults.
NUMBERS = {"triple_extraction_every_minutes": (30, 1, 1440), "kg_cache_ttl_minutes": (30, 5, 1440), "pmc_sync_retmax": (200, 1, 1000), "triple_extraction_limit_per_run": (1, 1, 50)}
MODES = ("off", "on_demand", "manual", "scheduled")
SWITCHES = {"kg_cache_enabled": True, "automated_pmc_sync_enabled": False, "automated_triple_extraction_enabled": False}
TEXTS = {"timezone": "America/New_York", "pmc_sync_time": "00:00"}
TIME, OLD_TIME, DEFAULT_TIME = "kg_cache_scheduled_time", "kg_cache_reset_time", "08:00"


def normalized_settings(df: DataFrame) -> DataFrame:
    """Settings as text to valid numbers, modes, switches and times; other columns stay.

    What isn't a number takes the default; numbers are brought within their limits; an
    unknown mode is on_demand; a reset is only on in scheduled mode; a missing time is
    taken from its old name, and both are kept equal.  Settings the table doesn't have
    aren't added.
    """
    has = set(df.columns)
    out = df
    for name, (default, least, most) in NUMBERS.items():
        if name in has:
            number = F.coalesce(F.col(name).cast("string").try_cast("int"), F.lit(default))
            out = out.withColumn(name, F.least(F.greatest(number, F.lit(least)), F.lit(most)))
    for name, default in SWITCHES.items():
        if name in has:
            out = out.withColumn(name, F.coalesce(F.col(name).cast("boolean"), F.lit(default)))
    for name, default in TEXTS.items():
        if name in has:
            out = out.withColumn(name, F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(default)))
    times = [F.nullif(F.trim(c), F.lit("")) for c in (TIME, OLD_TIME) if c in has]
    if times:
        at = F.coalesce(*times, F.lit(DEFAULT_TIME))
        out = out.select(*[at.alias(c) if c in (TIME, OLD_TIME) else F.col(c) for c in out.columns])
    if "kg_cache_mode" in has:
        mode = F.trim("kg_cache_mode")
        out = out.withColumn("kg_cache_mode", F.when(mode.isin(*MODES), mode).otherwise("on_demand"))
        if "automated_kg_cache_reset_enabled" in has:
            on = F.coalesce(F.col("automated_kg_cache_reset_enabled").cast("boolean"), F.lit(False))
            out = out.withColumn("automated_kg_cache_reset_enabled", on & (F.col("kg_cache_mode") == "scheduled"))
    return out


def flags(df: DataFrame) -> DataFrame:
    """Of normalised settings: ``reset_on, cache_open`` and ``ttl_seconds``."""
    on = F.coalesce(F.col("kg_cache_enabled"), F.lit(True))
    return df.select(
        "*",
        (on & (F.col("kg_cache_mode") == "scheduled") & F.coalesce("automated_kg_cache_reset_enabled", F.lit(False))).alias("reset_on"),
        (on & (F.col("kg_cache_mode") != "off")).alias("cache_open"),
        (F.col("kg_cache_ttl_minutes") * 60).alias("ttl_seconds"),
    )


def is_current(model: Column | str, signature: Column | str) -> Column:
    """Is a cache record (``status, model_name, kg_signature_hash, cache_name``) one for this
    model and graph?  A record without a status is active."""
    same = (F.coalesce("status", F.lit("active")) == "active") & (F.col("model_name") == model) & (F.col("kg_signature_hash") == signature)
    return F.coalesce(same & (F.coalesce("cache_name", F.lit("")) != ""), F.lit(False))


def cache_names(own: Column, of_roles: Column) -> Column:
    """Names of a record's caches in order, each once: its own, then those of its roles."""
    named = F.concat(F.array(own), F.coalesce(of_roles, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(named, lambda n: n.isNotNull() & (n != "")))
