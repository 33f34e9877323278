"""Goals: blocks, the order of work, and which goal a message is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import ancestors


def normal_title(title):
    """Lower-case alphanumeric tokens with single spaces between them."""
    return F.array_join(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), 0), " ")


def with_blocks(goals: DataFrame) -> DataFrame:
    """goals (goal_id, title, status, priority, created_at, parent) with `block`, null where a goal isn't blocked, and `rank`."""
    walks = ancestors(goals.select(F.col("goal_id").alias("id"), "parent")).select(F.col("id").alias("goal_id"), "cyclic")
    up = goals.select(F.col("goal_id").alias("parent"), F.col("status").alias("above"))
    rows = goals.join(walks, "goal_id").join(up, "parent", "left")
    block = (
        F.when(F.col("cyclic"), "blocked_cycle")
        .when((F.col("status") != "active") | F.col("parent").isNull() | (F.col("above") == "completed"), None)
        .when(F.col("above").isNull(), "blocked_missing_parent")
        .when(F.col("above") == "paused", "blocked_paused_parent")
        .otherwise("blocked_incomplete_parent")
    )
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "paused", 1).when(F.col("status") == "completed", 2).otherwise(99)
    return rows.withColumn("block", block).withColumn("rank", rank)


def work_order() -> list:
    return [F.col("rank"), -F.col("priority"), F.col("created_at"), F.col("goal_id")]


def plan_turns(messages: DataFrame, goals: DataFrame) -> DataFrame:
    """(m, selected, reason, confidence) of messages (m, message): the goal named by id, else by the longest title, else the first that isn't blocked.

    Both have an `owner`: a message meets its owner's goals of which it holds the id or title, and the owner's first goal.
    """
    g = with_blocks(goals).select("owner", "goal_id", "title", "status", "rank", "priority", "created_at", "block")
    order = F.struct("rank", (-F.col("priority")).alias("p"), "created_at", "goal_id")
    named = messages.join(g, "owner").where(F.contains(F.lower("message"), F.lower("goal_id"))).select("m", F.lit(0).alias("how"), F.lit(0).alias("size"), order.alias("o"), "status", "block")
    title = normal_title(F.col("title"))
    titled = messages.join(g, "owner").where((title != "") & F.contains(normal_title(F.col("message")), title)).select("m", F.lit(1).alias("how"), (-F.length(title)).alias("size"), order.alias("o"), "status", "block")
    first = g.where("block is null").groupBy("owner").agg(F.min(F.struct(order.alias("o"), "status", "block")).alias("f"))
    auto = messages.join(first, "owner").select("m", F.lit(2).alias("how"), F.lit(0).alias("size"), F.col("f.o").alias("o"), F.col("f.status").alias("status"), F.col("f.block").alias("block"))
    best = named.union(titled).union(auto).groupBy("m").agg(F.min(F.struct("how", "size", "o", "status", F.coalesce("block", F.lit("")).alias("block"))).alias("b"))
    how, status, free = F.col("b.how"), F.col("b.status"), F.col("b.block") == ""
    reason = F.when(how == 0, "explicit_goal_id_override").when(how == 1, "explicit_goal_title_override").when(how == 2, F.concat(F.lit("automatic_"), status, F.lit("_goal_selection"))).otherwise("no_eligible_goals")
    base = F.when(status == "active", 0.9).when(status == "paused", 0.75).when(status == "completed", 0.6).otherwise(0.5)
    sure = F.when(how == 0, F.when(free, 1.0).otherwise(0.65)).when(how == 1, F.when(free, 0.95).otherwise(0.6)).when(how == 2, F.when(free, base).otherwise(F.least(base, F.lit(0.5)))).otherwise(0.0)
    return messages.join(best, "m", "left").select("m", F.col("b.o.goal_id").alias("selected"), reason.alias("reason"), sure.alias("confidence"), F.nullif(F.col("b.block"), F.lit("")).alias("blocked"))
