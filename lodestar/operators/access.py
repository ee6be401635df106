"""Who may see what: visible projects, requested projects, files, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMIN_PARTS = 32


def visible_projects(users: DataFrame, folders: DataFrame, projects: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, project_id): projects of enabled folders, granted ones for users and all for administrators.

    Every administrator has every project, so that is what comes out; ``ADMIN_PARTS`` tasks make it, each for its share of the
    administrators and with all projects.
    """
    open_projects = projects.join(folders.where("enabled").select(F.col("id").alias("folder_id")), "folder_id", "left_semi").select(F.col("id").alias("project_id"))
    admins = users.where("role = 'admin'").select(F.col("id").alias("user_id"), F.pmod(F.xxhash64("id"), F.lit(ADMIN_PARTS)).alias("part"))
    plain = users.where("role <> 'admin'").select(F.col("id").alias("user_id"))
    granted = grants.join(plain, "user_id", "left_semi").join(open_projects, "project_id", "left_semi").select("user_id", "project_id").distinct()
    dealt = open_projects.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ADMIN_PARTS - 1).cast("long"))))
    return granted.unionByName(admins.join(dealt, "part").select("user_id", "project_id"))


def allowed_projects(visible: DataFrame, requests: DataFrame) -> DataFrame:
    """Visible projects that a user asked for; (user_id, requested) rows, a null or missing request asks for all."""
    asked = requests.where("requested IS NOT NULL").select("user_id", F.col("requested").alias("project_id"))
    limited = asked.select("user_id").distinct()
    return visible.join(asked.distinct(), ["user_id", "project_id"], "left_semi").unionByName(visible.join(limited, "user_id", "left_anti"))


def openable_files(visible: DataFrame, files: DataFrame) -> DataFrame:
    """(user_id, file_id): files of visible projects."""
    return visible.join(files.select(F.col("id").alias("file_id"), "project_id"), "project_id").select("user_id", "file_id")


def openable_counts(visible: DataFrame, files: DataFrame) -> DataFrame:
    """(user_id, n_files): how many files of visible projects; users with none are left out.

    Files are counted by project first, so a project's files are never paired with its users.
    """
    sizes = files.groupBy("project_id").agg(F.count("*").alias("n"))
    return visible.join(sizes, "project_id").groupBy("user_id").agg(F.sum("n").alias("n_files"))


def valid_sessions(users: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not run out and belong to active users."""
    return users.where(F.col("active") & (F.col("expires_at") > now))
