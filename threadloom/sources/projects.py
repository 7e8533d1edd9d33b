"""Projects and the sessions that belong to them, derived from paths and head lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.sources.transcripts import project_dir


def fold_worktree_path(cwd: Column) -> Column:
    """Repository root of a linked-worktree path; null when the path is no worktree."""
    root = F.lit(None).cast("string")
    for marker in reversed(V.WORKTREE_MARKERS):
        root = F.when(
            F.instr(cwd, marker) > 1, F.substring_index(cwd, marker, 1)
        ).otherwise(root)
    return root


def project_cwd(lines: DataFrame) -> DataFrame:
    """Working folder of every project folder: the first non-empty one in its files' heads."""
    cwd = F.get_json_object("value", "$.cwd")
    head = (
        lines.where((F.col("line_no") < V.PROJECT_HEAD_LINES) & ~F.contains("file_path", F.lit("/subagents/")))
        .select(project_dir(F.col("file_path")).alias("folder"), "file_path", "line_no", cwd.alias("cwd"))
        .where(F.coalesce("cwd", F.lit("")) != "")
    )
    return head.groupBy("folder").agg(F.min_by("cwd", F.struct("file_path", "line_no")).alias("cwd"))


def discover_projects(files: DataFrame, cwds: DataFrame, worktrees: DataFrame | None = None) -> DataFrame:
    """Projects with session count and last activity.

    `files` has file_path and file_mtime, `cwds` comes from project_cwd. `worktrees` maps a known
    worktree path to its main one (worktree, main); paths outside the map fold by their structure.
    """
    repo = F.coalesce(fold_worktree_path(F.col("cwd")), F.col("cwd"))
    homes = cwds.select("folder", "cwd")
    if worktrees is not None:
        homes = homes.join(worktrees.withColumnRenamed("worktree", "cwd"), "cwd", "left")
        repo = F.coalesce("main", repo)
    homes = homes.select("folder", repo.alias("project"))
    sessions = files.where(~F.contains("file_path", F.lit("/subagents/"))).withColumn(
        "folder", project_dir(F.col("file_path"))
    )
    # Counts per folder first, so that a hot project reaches the join as one row per folder.
    per_folder = sessions.groupBy("folder").agg(
        F.count_distinct("file_path").alias("n"), F.max("file_mtime").alias("last_active")
    )
    return per_folder.join(homes, "folder").groupBy("project").agg(
        F.sum("n").alias("sessions"), F.max("last_active").alias("last_active")
    ).withColumn("name", F.element_at(F.split("project", "/"), -1))


def discover_sessions(candidates: DataFrame) -> DataFrame:
    """One row per full session id; the best-ranked location wins.

    `candidates` has session_id, project, project_rank, worktree_rank and any other columns; the
    main worktree ranks before linked ones, those before orphans. An aggregate rather than a
    window: copies of a hot id collapse before the shuffle.
    """
    rest = [c for c in candidates.columns if c != "session_id"]
    order = F.struct("project_rank", "worktree_rank", *sorted(set(rest) - {"project_rank", "worktree_rank"}))
    return candidates.groupBy("session_id").agg(
        F.min_by(F.struct(*rest), order).alias("best")
    ).select("session_id", "best.*")
