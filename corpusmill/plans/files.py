"""Readers and writers over the test tables: each query writes its files into the shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators.relations import shard
from corpusmill.plans.clips import _CLIPS, _DAYS, _GATE, _SEGMENTS, _WORDS, clips, days, gate, segments
from corpusmill.plans.measures import _BLANKS, _V, _vocabulary
from corpusmill.session import checkpoint_folder, removed_at_end, table
from corpusmill.sources import files, schemas


def _folder(spark: SparkSession) -> str:
    path = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
    removed_at_end(spark, path)
    return path


def manifest_lines(spark: SparkSession, root: str) -> DataFrame:
    """The manifest written as JSON lines by split, of which the held-out splits are read back."""
    path = _folder(spark)
    files.write_manifest(clips(spark, root), path)
    rows = files.json_lines(spark, f"{path}/split=*", schemas.MANIFEST).withColumn("split", F.regexp_extract("_metadata.file_path", "split=(\\w+)", 1))
    return rows.where("split <> 'train'").select("id", "split", "text", F.round(F.col("duration") * 1000).cast("bigint").alias("duration_ms"), "source_year")


def first_lines(spark: SparkSession, root: str) -> DataFrame:
    """The first thirty clips by id of a JSON lines file: a top-k over the scan."""
    path = _folder(spark)
    clips(spark, root).write.json(path)
    return files.json_lines(spark, path, schemas.MANIFEST, splits=["train"], limit=30).select("id")


def day_documents(spark: SparkSession, root: str) -> DataFrame:
    """Nested day records, a JSON array of them a file, read recursively with their paths; one year's folder is left out."""
    path = _folder(spark)
    rows = days(spark, root).select("year", "day", F.col("local_offset_seconds"), "offset_method", "site_shift_seconds", "sync_untrusted")
    # A calendar year has a bounded number of days.
    rows.groupBy("year").agg(F.to_json(F.collect_list(F.struct("local_offset_seconds", "offset_method", "site_shift_seconds", "sync_untrusted"))).alias("value")).repartition("year").write.partitionBy("year").text(path)
    read = files.documents(spark, path, leave_out="year=5775", names="*.txt")
    year = F.regexp_extract("path", r"year=(\d+)", 1).cast("int")
    return read.groupBy(year.alias("year")).agg(F.count("*").alias("days"), F.count("local_offset_seconds").alias("offsets"), F.count_if("sync_untrusted").alias("untrusted"))


def nested_segments(spark: SparkSession, root: str) -> DataFrame:
    """Segments written inside their day's document and exploded again, with their places."""
    path = _folder(spark)
    rows = segments(spark, root).select("year", "day", F.struct("seg_no", "seg_id", "start", "end", "yiddish", "hebrew", "english").alias("g"))
    # A recording has a bounded number of segments.
    inner = F.transform(F.sort_array(F.collect_list("g")), lambda g: F.struct(g.start, g.end, g.yiddish, g.hebrew, g.english))
    rows.groupBy("year", "day").agg(F.struct(inner.alias("segments")).alias("sync")).write.partitionBy("year").json(path)
    read = spark.read.schema(schemas.DAY_RECORD).json(path).select("*", F.col("_metadata.file_path").alias("path"))
    return files.exploded_segments(read).select("place", F.round(F.col("start") * 1000).cast("bigint").alias("start_ms"), "yiddish")


def vocabulary_file(spark: SparkSession, root: str) -> DataFrame:
    """The vocabulary written as tab-separated text and read back."""
    path = _folder(spark)
    files.write_vocabulary(_vocabulary(spark, root), path)
    return files.tab_separated(spark, path, ["word", "n"]).select("word", F.col("n").cast("bigint").alias("n"))


def language_streams(spark: SparkSession, root: str) -> DataFrame:
    """Documents written as a stream of lines for each language: lines and words of each."""
    path = _folder(spark)
    rows = table(spark, root, "documents").select("lang", text.squeezed(F.coalesce("text", F.lit(""))).alias("text"))
    files.write_languages(rows, path, F.col("lang"))
    read = spark.read.text(path)
    return read.groupBy("lang").agg(F.count("*").alias("lines"), F.sum(text.word_count(F.col("value"))).cast("bigint").alias("words"))


def gated_files(spark: SparkSession, root: str) -> DataFrame:
    """Kept clips as JSON lines and dropped ones as a list with reasons, written from one frame and read back."""
    path = _folder(spark)
    rows = gate(spark, root).select("id", F.nullif("reason", F.lit("kept")).alias("reason"))
    files.write_gated(rows, path)
    kept = spark.read.schema("id string").json(f"{path}/kept").select("id", F.lit("kept").alias("reason"))
    return kept.unionByName(files.tab_separated(spark, f"{path}/dropped", ["id", "reason"]))


def run_lines(spark: SparkSession, root: str) -> DataFrame:
    """Days and paths as lines with a bar between, with comments and blank lines among them."""
    path = _folder(spark)
    rows = days(spark, root).select(F.explode(F.array(F.lit("# comment"), F.lit("  "), F.concat_ws(" | ", "day", "path"))).alias("value"))
    rows.write.text(path)
    return files.run_table(spark, path).distinct()


def split_file(spark: SparkSession, root: str) -> DataFrame:
    """Lists of days by split in one JSON file."""
    path = _folder(spark)
    rows = table(spark, root, "manifest").groupBy("split").agg(F.sort_array(F.collect_set("day")).alias("days"))  # names of days, few by nature
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("split", "days")))).alias("value")).write.text(path)
    return files.split_lists(spark, path)


def shard_results(spark: SparkSession, root: str) -> DataFrame:
    """Results of three shards, each written by itself and read as one."""
    path = _folder(spark)
    for i in range(3):
        shard(clips(spark, root).select("id", "year"), ["id"], i, 3, ["year"]).withColumn("shard", F.lit(i)).write.json(f"{path}/shard-{i}")
    return spark.read.schema("id string, year int, shard int").json(f"{path}/shard-*").groupBy("shard").agg(F.count("*").alias("clips"), F.countDistinct("id").alias("ids"))


def to_do(spark: SparkSession, root: str) -> DataFrame:
    """Days of clips that a written result doesn't have yet."""
    path = _folder(spark)
    table(spark, root, "speech_window").select("year", "day").distinct().write.parquet(path)
    rows = table(spark, root, "manifest").select("year", "day").unionByName(days(spark, root).select("year", "day")).distinct()
    return files.not_yet_done(rows, spark.read.parquet(path), ["year", "day"])


def day_subtitles(spark: SparkSession, root: str) -> DataFrame:
    """One subtitle text a day, of its segments with times and text in order."""
    rows = segments(spark, root).where("s >= 0 and e > s and yiddish is not null").select("year", "day", "start", "end", F.col("yiddish").alias("text"))
    return files.subtitles(rows, ["year", "day"]).select("year", "day", F.md5("srt").alias("digest"))


QUERIES = {f.__name__: f for f in (manifest_lines, first_lines, day_documents, nested_segments, vocabulary_file, language_streams, gated_files, run_lines, split_file, shard_results, to_do, day_subtitles)}
_TIME = "format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', CAST(round({0} * 1000) AS BIGINT) // 3600000, CAST(round({0} * 1000) AS BIGINT) // 60000 % 60, CAST(round({0} * 1000) AS BIGINT) // 1000 % 60, CAST(round({0} * 1000) AS BIGINT) % 1000)"
_SQUEEZED = rf"trim(regexp_replace(coalesce(text, ''), '[{_BLANKS}]+', ' ', 'g'), ' ')"
SQL = {
    "manifest_lines": f"WITH {_CLIPS} SELECT id, split, text, CAST(round(duration * 1000) AS BIGINT) AS duration_ms, source_year FROM c WHERE split <> 'train'",
    "first_lines": f"WITH {_CLIPS} SELECT id FROM c WHERE split = 'train' ORDER BY id LIMIT 30",
    "day_documents": f"WITH {_DAYS} SELECT year, count(*) AS days, count(local_offset_seconds) AS offsets, count(*) FILTER (sync_untrusted) AS untrusted FROM d WHERE year <> 5775 GROUP BY year",
    "nested_segments": f"WITH {_SEGMENTS} SELECT CAST(row_number() OVER (PARTITION BY year, day ORDER BY seg_no NULLS FIRST, seg_id) - 1 AS INT) AS place, s AS start_ms, yiddish FROM g",
    "vocabulary_file": _V + " SELECT word, n FROM v",
    "language_streams": f"WITH t AS (SELECT lang, {_SQUEEZED} AS text FROM documents WHERE lang IS NOT NULL) SELECT lang, count(*) AS lines, CAST(sum({_WORDS}) AS BIGINT) AS words FROM t GROUP BY lang",
    "gated_files": f"WITH {_GATE} SELECT id, reason FROM gate",
    "run_lines": f"WITH {_DAYS} SELECT DISTINCT trim(day, ' ') AS name, trim(path, ' ') AS arguments FROM d",
    "split_file": "SELECT DISTINCT day, split FROM manifest",
    "shard_results": f"WITH {_CLIPS}, r AS (SELECT id, (row_number() OVER (PARTITION BY year ORDER BY id) - 1) % 3 AS shard FROM c) SELECT CAST(shard AS INT) AS shard, count(*) AS clips, count(DISTINCT id) AS ids FROM r GROUP BY shard",
    "to_do": "SELECT year, day FROM manifest UNION SELECT year, day FROM day_record EXCEPT SELECT year, day FROM speech_window",
    "day_subtitles": f"""WITH {_SEGMENTS}, t AS (SELECT year, day, row_number() OVER (PARTITION BY year, day ORDER BY start, "end", yiddish) AS nth, {_TIME.format('start')} AS a, {_TIME.format('"end"')} AS b, yiddish FROM g WHERE s >= 0 AND e > s AND yiddish IS NOT NULL)
SELECT year, day, md5(string_agg(nth::VARCHAR || chr(10) || a || ' --> ' || b || chr(10) || yiddish || chr(10), chr(10) ORDER BY nth)) AS digest FROM t GROUP BY year, day""",
}
