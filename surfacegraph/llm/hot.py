"""Joins of rows with the facts of their groups, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import written

#: A group with more than this share of the grouped rows is hot, so there are at most so many.
SHARES = 1000
#: Rows that no group needs fewer than to be hot.
LEAST = 100


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], many: str) -> DataFrame:
    """``rows`` with the columns of their group; rows without a group fall out.

    ``groups`` has one row a key, and in ``many`` how many rows have it. Rows
    of hot groups do not shuffle: there are at most ``SHARES`` hot groups,
    whatever the input, and their facts are broadcast. The rest are small and
    join by shuffle. ``rows`` is read twice where there are hot groups.
    """
    groups = written(groups, "groups")
    total = groups.agg(F.sum(many)).first()[0]
    bound = max(LEAST, (total or 0) // SHARES)
    hot = groups.where(F.col(many) > bound)  # at most SHARES rows
    if hot.limit(1).isEmpty():
        return rows.join(groups, key)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(many) <= bound), key)
    return near.unionByName(far)
