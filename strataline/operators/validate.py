"""Checks of generated skills: frontmatter, links, empty files, evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters of a description.
MOST_DESCRIPTION = 1024
LINK = r"\]\(([^)\s#:]+\.md)(?:#[^)]*)?\)"


def frontmatter_errors(folder: Column, name: Column, description: Column) -> Column:
    """What is wrong with a skill's name and description."""
    size = F.length(F.coalesce(description, F.lit("")))
    checks = [
        (F.coalesce(name != folder, F.lit(True)), "name differs from folder"),
        (size == 0, "description missing"),
        (size > MOST_DESCRIPTION, "description too long"),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(why)) for bad, why in checks]), lambda e: e.isNotNull())


def broken_links(files: DataFrame) -> DataFrame:
    """(skill, path, target) of relative links to files that a skill lacks; files: skill, path, content."""
    found = files.select("skill", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(LINK), F.lit(1)))).alias("target"))
    folder = F.regexp_extract("path", r"^(.*/)?", 0)
    return found.withColumn("goal", F.concat(folder, "target")).join(files.select("skill", F.col("path").alias("goal")), ["skill", "goal"], "left_anti").select("skill", "path", "target")


def empty_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").endswith(".md") & (F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+", "") == "")).select("skill", "path")


_EVALS = "skill_name string, evals array<struct<id int, prompt string, expected_output string, files array<string>, expectations array<string>>>"


def eval_errors(files: DataFrame) -> DataFrame:
    """(skill, error) of evaluation files (skill, content as JSON)."""
    own = files.withColumn("e", F.from_json("content", _EVALS))
    items = F.coalesce("e.evals", F.array().cast("array<struct<id:int,prompt:string,expected_output:string,files:array<string>,expectations:array<string>>>"))
    lacking = F.filter(F.transform(items, lambda x, i: F.when(F.coalesce(x["prompt"], F.lit("")) == "", F.concat(F.lit("no prompt in item "), (i + 1).cast("string"))).when(F.coalesce(F.size(x["expectations"]), F.lit(0)) < 1, F.concat(F.lit("no expectations in item "), (i + 1).cast("string")))), lambda e: e.isNotNull())
    checks = F.array(F.when(F.size(items) == 0, F.lit("no evals")), F.when(~F.col("e.skill_name").eqNullSafe(F.col("skill")), F.lit("skill_name differs from folder")))
    return own.select("skill", F.explode(F.concat(F.filter(checks, lambda e: e.isNotNull()), lacking)).alias("error"))
