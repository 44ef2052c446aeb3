"""Stories and chapters: summaries, context of a question, reuse of sources, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def previous_block(rows: DataFrame, path: str, block: str, order: list[str]) -> DataFrame:
    """rows with (previous_block): the block in which the same path came before."""
    return rows.withColumn("previous_block", F.lag(block).over(Window.partitionBy(path).orderBy(*order)))


def summaries(chapters: DataFrame, limit: int | None = 50) -> DataFrame:
    """(story_id, chapter_count, title, last_question, updated) of chapters (story_id, seq, question), newest first."""
    s = chapters.groupBy("story_id").agg(
        F.count(F.lit(1)).alias("chapter_count"), F.min_by("question", "seq").alias("title"), F.max_by("question", "seq").alias("last_question"), F.max("seq").alias("updated")
    )
    return s.orderBy(F.desc("updated"), "story_id").limit(limit) if limit else s


def context(chapters: DataFrame, most: int = 4, chars: tuple[int, int] = (500, 200)) -> DataFrame:
    """(story_id, place, question, narrative) of chapters (story_id, seq, question, narrative): the last most chapters that are
    not empty, oldest first, clamped at words."""
    w = Window.partitionBy("story_id")
    last = chapters.filter(F.trim(F.coalesce("question", F.lit(""))) != "").withColumn("back", F.row_number().over(w.orderBy(F.desc("seq")))).filter(F.col("back") <= most)
    return last.select("story_id", F.row_number().over(w.orderBy("seq")).alias("place"), T.clamp_at_word(F.col("question"), chars[0]).alias("question"), T.clamp_at_word(F.col("narrative"), chars[1]).alias("narrative"))


def reuse(refs: DataFrame) -> DataFrame:
    """(path, chapters, first_chapter, last_chapter) of refs (path, chapter)."""
    return refs.groupBy("path").agg(F.countDistinct("chapter").alias("chapters"), F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter"))


def context_paths(refs: DataFrame, limit: int = 8) -> DataFrame:
    """(story_id, path, n, place) of refs (story_id, path): dependencies last, then the most cited, then by name."""
    counts = refs.groupBy("story_id", "path").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("story_id").orderBy(F.col("path").startswith("__dependencies__/"), F.desc("n"), "path")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def source_items(items: DataFrame, most: int = 12, dependencies: int = 1) -> DataFrame:
    """(q, path, line_start, line_end, place) of items (q, ord, path, line_start, line_end): first of each range, dependencies
    last and at most so many."""
    first = items.groupBy("q", "path", "line_start", "line_end").agg(F.min("ord").alias("ord")).withColumn("dep", F.col("path").startswith("__dependencies__/"))
    kept = first.withColumn("_k", F.row_number().over(Window.partitionBy("q", "dep").orderBy("ord", "path", "line_start"))).filter(~F.col("dep") | (F.col("_k") <= dependencies))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("dep", "ord", "path", "line_start"))).filter(F.col("place") <= most).select("q", "path", "line_start", "line_end", "place")


def freshness(fingerprints: DataFrame, current: DataFrame) -> DataFrame:
    """(story_id, fresh, changed_paths) of stored (story_id, path, hash) against current (path, hash); a missing path has changed."""
    both = fingerprints.join(current.select("path", F.col("hash").alias("now")), "path", "left")
    changed = F.when(~F.col("hash").eqNullSafe(F.col("now")), F.col("path"))
    s = both.groupBy("story_id").agg(F.array_sort(F.collect_set(changed)).alias("changed_paths"))
    return s.select("story_id", (F.size("changed_paths") == 0).alias("fresh"), "changed_paths")


def block_owners(blocks: DataFrame) -> DataFrame:
    """(fingerprint, chapter, seq): the first to show a block of (fingerprint, chapter, seq) owns it."""
    return blocks.groupBy("fingerprint").agg(F.min(F.struct("seq", "chapter")).alias("f")).select("fingerprint", F.col("f.chapter").alias("chapter"), F.col("f.seq").alias("seq"))


def filter_stories(stories: DataFrame, needle: str) -> DataFrame:
    """Stories (story_id, title, questions, paths) whose text has needle, whatever the case."""
    text = F.lower(F.concat_ws(" ", "title", F.array_join("questions", " "), F.col("story_id").cast("string"), F.array_join("paths", " ")))
    return stories.filter(text.contains(needle.lower()))
