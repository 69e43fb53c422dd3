"""Nested course content and quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import clip


def lectures(courses: DataFrame) -> DataFrame:
    """A row a lecture of course -> chapters[] -> lectures[]."""
    chapters = courses.select("CourseID", F.explode("Chapters").alias("c"))
    return chapters.select("CourseID", F.col("c.ChapterID").alias("ChapterID"), F.col("c.Order").alias("chapter_order"), F.explode("c.Lectures").alias("l")).select("CourseID", "ChapterID", "chapter_order", "l.*")


def questions(tests: DataFrame) -> DataFrame:
    """A row a question id of chapter -> tests[] -> questions[], with its place."""
    each = tests.select("ChapterID", F.explode("Test").alias("t"))
    return each.select("ChapterID", F.col("t.TestID").alias("TestID"), F.posexplode("t.Questions").alias("pos", "QuestionID"))


def answer_key(questions_: DataFrame, definitions: DataFrame) -> DataFrame:
    """Questions that have a definition, with its answer."""
    return questions_.join(definitions, "QuestionID").select("ChapterID", "TestID", "pos", "QuestionID", "answerID")


def quiz_scores(answers: DataFrame, key: DataFrame, by: list[str], pass_mark: int = 60) -> DataFrame:
    """correct, total, score (half up) and passed of each attempt; an unanswered question is wrong."""
    marked = answers.join(key, ["TestID", "pos"]).groupBy(*by).agg(F.sum(F.coalesce((F.col("answer") == F.col("answerID")).cast("int"), F.lit(0))).cast("long").alias("correct"), F.count("*").alias("total"))
    score = F.round(100.0 * F.col("correct") / F.col("total")).cast("long")
    return marked.withColumn("score", score).withColumn("passed", F.col("score") >= pass_mark)


def course_progress(scores: DataFrame, by: list[str], chapters: int) -> DataFrame:
    """Passed chapters as a percentage of all."""
    return scores.groupBy(*by).agg(F.round(100.0 * F.count_distinct(F.when(F.col("passed"), F.col("chapter"))) / chapters).cast("long").alias("progress"))


def chapter_radar(df: DataFrame) -> DataFrame:
    """value: 0 without submissions, mastery of up to 1 as a percentage, within 0 and 100."""
    scaled = F.when(F.col("mastery") <= 1, F.col("mastery") * 100).otherwise(F.col("mastery"))
    return df.withColumn("value", F.when(F.coalesce("submissions", F.lit(0)) == 0, 0.0).otherwise(clip(scaled, 0.0, 100.0)))
