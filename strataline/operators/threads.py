"""Comment trees: replies of deleted comments move up, reading order, counts, budgets, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels a reply chain may have; chains are followed by a recursive query.
LEVELS = 2000


def promoted(comments: DataFrame) -> DataFrame:
    """Surviving comments of (thread_id, id, parent_id, ord, deleted, ...) with root_id, depth and path.

    A deleted comment's replies take its place: depth grows only below comments that stay, and
    the path (zero-padded ordinals) orders a thread depth first.  Roots have parent_id null.
    """
    spark = comments.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        f"""
        WITH RECURSIVE tree(thread_id, id, deleted, depth, root_id, path) MAX RECURSION LEVEL {LEVELS} AS (
            SELECT thread_id, id, deleted, if(deleted, 0, 1), if(deleted, CAST(NULL AS BIGINT), id), lpad(CAST(ord AS STRING), 19, '0')
            FROM {{comments}} WHERE parent_id IS NULL
            UNION ALL
            SELECT c.thread_id, c.id, c.deleted, t.depth + if(c.deleted, 0, 1),
                   coalesce(t.root_id, if(c.deleted, CAST(NULL AS BIGINT), c.id)), concat(t.path, '/', lpad(CAST(c.ord AS STRING), 19, '0'))
            FROM tree t JOIN {{comments}} c ON c.thread_id = t.thread_id AND c.parent_id = t.id)
        SELECT thread_id, id, depth - 1 AS depth, root_id, path FROM tree WHERE NOT deleted""",
        comments=comments,
    )


def reading_order(tree: DataFrame) -> DataFrame:
    """Adds pos: the place of a comment in its thread, depth first."""
    return tree.withColumn("pos", F.row_number().over(Window.partitionBy("thread_id").orderBy("path")))


def ranked_roots(roots: DataFrame, score: str, order: str) -> DataFrame:
    """Adds rank: by score, highest first (none counts as 0), then in the given order."""
    return roots.withColumn("rank", F.row_number().over(Window.partitionBy("thread_id").orderBy(F.coalesce(F.col(score), F.lit(0)).desc(), order)))
