"""Review of notes: overdue ones, confidence order, per-file times, inverted lists, manifests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DEFAULTS, Settings
from quern.functions.dates import first_filled, to_date
from quern.functions.text import note_line, version
from quern.operators.search import layer_of


def overdue(files: DataFrame, s: Settings = DEFAULTS, home: str = "/m") -> DataFrame:
    """Durable notes whose confirmation (or last date) is older than the interval, or missing: those first."""
    ref = to_date(first_filled(F.col("last_confirmed"), F.col("updated"), F.col("created")))
    aged = files.where(layer_of(F.col("file_path"), home).isin(*s.exempt_layers)).withColumn("age_days", F.datediff(F.lit(s.today), ref))
    return aged.where(F.col("age_days").isNull() | (F.col("age_days") > s.confirm_days)).orderBy(F.desc_nulls_first("age_days"), "file_path")


def review_tag(ref: Column, s: Settings = DEFAULTS) -> Column:
    """A mark for notes that should be looked at."""
    age = F.datediff(F.lit(s.today), to_date(ref))
    return F.when(age.isNull() | (age > s.confirm_days), " [review?]").otherwise("")


def confidence_tag(relative: Column, invalidated_at: Column, suspected_at: Column, suspect_reason: Column, last_confirmed: Column) -> Column:
    """What to know of a hit: suspected since when and why, confirmed when or never; nothing of an invalidated one."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    why = F.when(filled(suspect_reason), F.concat(F.lit(" — "), suspect_reason)).otherwise("")
    doubt = F.when(filled(suspected_at), F.concat(F.lit(" ⚠ suspected (since "), suspected_at, why, F.lit(")"))).otherwise("")
    sure = F.when(filled(last_confirmed), F.concat(F.lit(" · confirmed "), F.coalesce(relative, last_confirmed))).otherwise(" · unconfirmed")
    return F.when(filled(invalidated_at), "").otherwise(F.concat(doubt, sure))


def confidence(files: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Live always-notes to hedge: suspected, then overdue, then never confirmed; the first few shown, the rest counted."""
    ref = to_date(F.col("last_confirmed"))
    kind = F.when(first_filled(F.col("suspected_at")).isNotNull(), "suspect").when(F.col("last_confirmed").isNull(), "never").when(F.datediff(F.lit(s.today), ref) > s.confirm_days, "overdue")
    flagged = files.where(first_filled(F.col("invalidated_at")).isNull()).withColumn("kind", kind).where("kind is not null")
    place = F.when(F.col("kind") == "suspect", 0).when(F.col("kind") == "overdue", 1).otherwise(2)
    ranked = flagged.withColumn("severity", place).groupBy().agg(F.count("*").alias("total"))
    first = flagged.withColumn("severity", place).orderBy("severity", "file_path").limit(s.confidence_most)
    return first.join(F.broadcast(ranked)).withColumn("more", F.greatest(F.col("total") - s.confidence_most, F.lit(0)))


def file_times(chunks: DataFrame) -> DataFrame:
    """Latest of updated, created and last_confirmed of every file, as text."""
    return chunks.groupBy("file_path").agg(*[F.max(c).alias(c) for c in ("updated", "created", "last_confirmed")])


def inverted(files: DataFrame, list_col: str, path_col: str = "file_path") -> DataFrame:
    """key and file of every key that a file carries; a key may be on any share of the files, so they stay rows."""
    return files.select(F.explode(list_col).alias("key"), F.col(path_col).alias("file")).distinct()


def alias_targets(files: DataFrame) -> DataFrame:
    """Each alias's file: of several the last by path."""
    return files.select("file_path", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.max("file_path").alias("file_path"))


def any_chunk(files: DataFrame, chunks: DataFrame, col: str) -> DataFrame:
    """Each file with one of its chunks' values: that of the least chunk."""
    one = chunks.groupBy("file_path").agg(F.min_by(col, "chunk_id").alias(col))
    return files.join(one, "file_path", "left")


def manifest_hash(files: DataFrame, group: str) -> DataFrame:
    """Hash of a group's lines of path, time and size, whatever their order.

    Lines are dealt into 4,096 buckets by their own hash; a bucket's hash is that of its sorted line hashes, the group's
    that of its sorted bucket hashes: no group is gathered in one place, however many files it has.
    """
    line = F.sha2(F.concat_ws("\t", "path", F.col("mtime_unix").cast("string"), F.col("size_bytes").cast("string")), 256)
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n"), 256)
    buckets = files.select(group, line.alias("line")).groupBy(group, F.substring("line", 1, 3).alias("bucket")).agg(joined("line").alias("h"))
    return buckets.groupBy(group).agg(joined("h").alias("manifest"))


def note_candidates(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 0) and note of every line of a text that holds one; of a text's equal notes, case ignored, the first."""
    lines = texts.select(id_col, F.posexplode(F.split(text_col, r"\r\n|[\n\x0B-\r\x1C-\x1E\x85\u2028\u2029]", -1)).alias("line_no", "line"))
    notes = lines.select(id_col, "line_no", note_line(F.col("line")).alias("note")).where("note <> ''")
    first = Window.partitionBy(id_col, F.lower("note")).orderBy("line_no")
    return notes.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def distinct_snippets(notes: DataFrame, text_col: str, *order: str) -> DataFrame:
    """The first row of each text, case ignored, in order of first sight."""
    first = Window.partitionBy(F.lower(text_col)).orderBy(*order)
    return notes.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def is_stale(last_success: Column, now: dt.datetime, days: int = 14) -> Column:
    """No check has succeeded for so long; never counts as stale, a time still to come does not."""
    return last_success.isNull() | (last_success <= F.lit(now - dt.timedelta(days=days)))


def dismissed(version: Column, dismissed_version: Column) -> Column:
    """A notice that was dismissed for just this version."""
    return F.coalesce(version == dismissed_version, F.lit(False))


def missing_handlers(settings: DataFrame, expected: list[str], json_col: str = "settings") -> DataFrame:
    """Expected handler names (handler) that no command of nested settings JSON (hooks: event, blocks, hooks) names."""
    spark, wired = settings.sparkSession, wired_commands(hook_events(settings, json_col))
    return spark.createDataFrame([(x,) for x in expected], "handler string").join(wired.select("handler").distinct(), "handler", "left_anti")


def hook_events(settings: DataFrame, json_col: str = "settings") -> DataFrame:
    """events: the map of event to blocks that settings JSON holds under hooks."""
    return settings.select(F.from_json(F.get_json_object(json_col, "$.hooks"), "map<string, array<struct<hooks: array<struct<command: string>>>>>").alias("events"))


def wired_commands(events: DataFrame) -> DataFrame:
    """event and handler (file name of a command's program) of nested settings."""
    each = events.select(F.explode("events").alias("event", "blocks")).select("event", F.explode("blocks").alias("b")).select("event", F.explode("b.hooks").alias("h"))
    return each.select("event", F.explode(F.regexp_extract_all("h.command", F.lit(r"([\w.-]+\.(?:sh|py))"), F.lit(1))).alias("handler")).distinct()


def versions(tags: DataFrame, tag_col: str = "tag") -> DataFrame:
    """tags with major, minor and patch; what is no version goes."""
    return tags.withColumn("__v", version(F.col(tag_col))).where("__v is not null").select("*", "__v.*").drop("__v")


def severities(tags: DataFrame) -> DataFrame:
    """The highest severity of each version."""
    return versions(tags).groupBy("major", "minor", "patch").agg(F.max("severity").alias("severity"))


def newest_version(tags: DataFrame) -> DataFrame:
    """One row: the newest version, by numbers."""
    return versions(tags).agg(F.max(F.struct("major", "minor", "patch")).alias("v")).select("v.*")


def throttle_due(last: Column, now: dt.datetime, hours: int = 24) -> Column:
    """Due if never, long ago, or at a time still to come."""
    return last.isNull() | (last > F.lit(now)) | (last <= F.lit(now - dt.timedelta(hours=hours)))
