"""Features by role, keys and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X

#: Role lists of the access table: column name -> feature.
LISTS = {"perplexity": "perplexity", "openai": "openai", "ragflow": "ragflow", "settings_sync": "settings_sync", "power": "power_user"}


def access(roles: Column) -> dict[str, Column]:
    """Predicates of each feature over an array of role lists; power users may also sync settings."""
    on = {feature: F.array_contains(roles, name) for name, feature in LISTS.items()}
    return on | {"settings_sync": on["settings_sync"] | on["power_user"]}


def with_features(users: DataFrame, roles: str = "roles") -> DataFrame:
    return users.withColumn("features", X.features_of(access(F.col(roles))))


def has_feature(users: DataFrame, feature: str, roles: str = "roles") -> DataFrame:
    """users with allowed; an unknown feature is allowed to nobody, power status is no feature of its own."""
    known = {k: v for k, v in access(F.col(roles)).items() if k != "power_user"}
    return users.withColumn("allowed", known.get(feature, F.lit(False)))


def registered(lists: DataFrame, new: DataFrame) -> DataFrame:
    """lists (list_name, pubkey) with users new to the approved list added to approved, ragflow and openai."""
    approved = lists.filter("list_name = 'approved'").select("pubkey")
    fresh = new.select("pubkey").distinct().join(approved, "pubkey", "left_anti")
    rows = fresh.select(F.explode(F.array(*map(F.lit, ("approved", "ragflow", "openai")))).alias("list_name"), "pubkey")
    return lists.select("list_name", "pubkey").unionByName(rows).distinct()


def resolved_keys(requests: DataFrame, users: DataFrame, shared_key: str) -> DataFrame:
    """The key each request runs with: the shared one for power users, their own for others, null if unknown."""
    joined = requests.join(users.select("pubkey", "is_power_user", "api_key"), "pubkey", "left")
    return joined.withColumn("key", F.when(F.col("is_power_user"), F.lit(shared_key)).otherwise(F.col("api_key")))


def key_update_status(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Whether a key update is accepted: power users and unknown users are rejected."""
    joined = requests.join(users.select("pubkey", "is_power_user"), "pubkey", "left")
    status = F.when(F.col("is_power_user").isNull(), "unknown").when(F.col("is_power_user"), "power_user").otherwise("accepted")
    return joined.withColumn("status", status)


def session_valid(sessions: DataFrame, now: Column, most: int = 3600) -> DataFrame:
    """sessions (token, presented, last_seen) with valid: the token is right and not too old."""
    fresh = (now - F.col("last_seen")) <= most
    return sessions.withColumn("valid", F.coalesce((F.col("token") == F.col("presented")) & fresh, F.lit(False)))


def live_presence(updates: DataFrame, now: Column, most: float, local: int | None = None) -> DataFrame:
    """The latest update of each user that isn't stale; the local user always stays."""
    latest = updates.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in updates.columns if c != "user_id"]), F.struct("ts", "seq")).alias("u"))
    rows = latest.select("user_id", "u.*")
    fresh = (now - F.col("ts")) < most
    return rows.filter(fresh | (F.col("user_id") == local) if local is not None else fresh)


def recent_sessions(users: DataFrame, now: Column, hours: int) -> DataFrame:
    """users seen less than so many hours ago."""
    return users.filter(now - F.col("last_seen") < hours * 3600)
