"""Masked columns and roles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of sensitive column names (fixed values). `pin` also matches `shipping`.
SENSITIVE = ("ssn", "social.?security", "password", "secret", "credit.?card", "card.?number", "cvv", "pin", "salary", "compensation")
MASK = "***MASKED***"
LEVELS = {"viewer": 1, "analyst": 2, "developer": 3, "admin": 4}


def mask(df: DataFrame, role: str | None, patterns: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Columns whose names look sensitive read as MASK unless the role is admin or developer; a masked column
    isn't even read from a Parquet scan."""
    if role in ("admin", "developer"):
        return df
    looks = re.compile("|".join(patterns), re.I)
    return df.select(*[F.lit(MASK).alias(c) if looks.search(c) else F.col(f"`{c}`") for c in df.columns])


def level(role: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), role), F.lit(0))


def effective_roles(requests: DataFrame, grants: DataFrame, default: str | None = None) -> DataFrame:
    """requests (user_id, file_id, needed) with the role for the file, else the user's for `*`, else the default, and
    whether it suffices. Both lookups are one join each on grants' key."""
    own = grants.select("user_id", "file_id", F.col("role").alias("_own"))
    everywhere = grants.where(F.col("file_id") == "*").select("user_id", F.col("role").alias("_all"))
    out = requests.join(own, ["user_id", "file_id"], "left").join(everywhere, ["user_id"], "left")
    out = out.withColumn("role", F.coalesce("_own", "_all", F.lit(default))).drop("_own", "_all")
    return out.withColumn("allowed", level(F.col("role")) >= level(F.col("needed")))


def visible_rows(df: DataFrame, grants: DataFrame, user: str, key: str) -> DataFrame:
    """Row-level security: rows whose key the user has a grant for."""
    return df.join(grants.where((F.col("user_id") == user) & (F.col("file_id") != "*")).select(F.col("file_id").alias(key)), key, "left_semi")


def audit_denied(log: DataFrame, since: Column, limit: int = 100) -> DataFrame:
    return log.where(~F.col("allowed") & (F.col("at") >= since)).orderBy(F.desc("at"), "entry_id").limit(limit)
