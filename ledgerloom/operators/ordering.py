"""Display orders of roles and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Models first in lists, in this order.
MODEL_ORDER = ("gpt-5.6-sol", "gpt-5.6-terra", "gpt-5.6-luna", "codex-auto-review", "Others")


def model_rank(category: Column) -> Column:
    rank = F.when(F.lit(False), 0)
    for i, name in enumerate(MODEL_ORDER):
        rank = rank.when(category == name, i)
    return rank.otherwise(len(MODEL_ORDER))


# Subagent roles in this order, after the root of main threads.
ROLE_ORDER = ("worker", "reviewer", "explorer", "scout", "awaiter", "scoped_worker", "simple_worker", "unknown")


def role_rank(thread_type: Column, role: Column) -> Column:
    rank = F.when((thread_type == "main") & (role == "root"), 0)
    for i, name in enumerate(ROLE_ORDER, 1):
        rank = rank.when((thread_type == "subagent") & (role == name), i)
    return rank.otherwise(len(ROLE_ORDER) + 1)


def order_models(rows: DataFrame) -> DataFrame:
    return rows.orderBy(model_rank(F.col("category")), "category")


def order_roles(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("total_nano"), role_rank(F.col("thread_type"), F.col("role")), "thread_type", "role")
