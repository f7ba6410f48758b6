"""Collection forms: validated submissions, contacts kept apart, the label queue and the label grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The form's id pattern, and what a rater may answer.
ID_PATTERN = "^[A-Za-z0-9_-]{2,40}$"
ANSWERS = ("not_detected", "mild", "moderate", "high", "unsure")


def accepted(submissions: DataFrame) -> DataFrame:
    """Manifest rows of submissions with a valid subject id, without contact columns, stamped in UTC."""
    ok = F.coalesce(F.col("subject_id").rlike(ID_PATTERN), F.lit(False))
    rows = submissions.where(ok).drop("name", "email", "phone")
    return rows.withColumn("image", F.concat(F.col("subject_id"), F.lit("_"), F.date_format("submitted_at", "yyyyMMdd'T'HHmmss'Z'"), F.lit(".jpg")))


def new_contacts(submissions: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contact rows to add: subjects that have none, one row each."""
    rows = submissions.where(F.col("subject_id").rlike(ID_PATTERN)).select("subject_id", "email").dropDuplicates(["subject_id"])
    return rows.join(contacts.select("subject_id"), "subject_id", "left_anti")


def next_subject(approved: DataFrame, labels: DataFrame, rater) -> DataFrame:
    """The first approved subject, by position, that the rater has not labelled."""
    done = labels.where(F.col("rater_id") == rater).select("subject_id")
    return approved.join(done, "subject_id", "left_anti").orderBy("position").limit(1)


def next_subjects(approved: DataFrame, labels: DataFrame, raters: DataFrame) -> DataFrame:
    """(rater_id, subject_id): the same for every rater at once.

    A first position without a label stands at 1 or right behind a labelled one, so those candidates meet the
    labels by rater and position: no rater meets every subject, and no rater's labels gather in one task.
    """
    done = labels.join(approved, "subject_id").select("rater_id", "position").distinct()
    behind = done.select("rater_id", (F.col("position") + 1).alias("position"))
    candidates = raters.select("rater_id", F.lit(1).cast("long").alias("position")).unionByName(behind)
    at = candidates.join(done, ["rater_id", "position"], "left_anti").groupBy("rater_id").agg(F.min("position").alias("position"))
    return at.join(approved, "position").select("rater_id", "subject_id")


def progress(labels: DataFrame) -> DataFrame:
    """(rater_id, done): subjects that a rater labelled, approved or not."""
    return labels.groupBy("rater_id").agg(F.count_distinct("subject_id").alias("done"))


def complete_grids(grid: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """(by..., missing): how many of the expected answers a submission lacks; it is taken whole or not at all, at 0."""
    key = [*by, "concern", "roi"]
    ok = answers.where(F.col("severity").isin(*ANSWERS))
    every = answers.select(*by).distinct().join(F.broadcast(grid.select("concern", "roi").withColumn("__one", F.lit(1))), F.lit(True)).drop("__one")  # a fixed grid
    gone = every.join(ok.select(*key), key, "left_anti").groupBy(*by).agg(F.count("*").alias("missing"))
    return answers.select(*by).distinct().join(gone, by, "left").fillna({"missing": 0})


def licence_faults(entries: DataFrame) -> DataFrame:
    """(name, fault) of component licence entries: a decision that contradicts commercial use, or an eligible one that is not pinned, or a dependency that has no entry."""
    faults = F.array_compact(
        F.array(
            F.when((F.col("decision") == "eligible") != F.col("commercial_allowed"), "decision"),
            F.when((F.col("decision") == "eligible") & (F.coalesce(F.trim("version"), F.lit("")) == ""), "version"),
            F.when((F.col("decision") == "eligible") & (F.coalesce(F.trim("hash"), F.lit("")) == ""), "hash"),
        )
    )
    own = entries.select("name", F.explode(faults).alias("fault"))
    needs = entries.select("name", F.explode("requires").alias("need"))
    gone = needs.join(entries.select(F.col("name").alias("need")), "need", "left_anti").select("name", F.concat(F.lit("requires "), "need").alias("fault"))
    return own.union(gone)
