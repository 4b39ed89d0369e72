"""Readers and writers: line and document JSON, text tables, split lists, archives; idempotent writes."""

from __future__ import annotations

import html
import io
import json
import tarfile
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions.text import redacted, srt_time
from corpusmill.sources import schemas


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: StructType = schemas.MANIFEST, splits: Sequence[str] = (), limit: int | None = None, order: str = "id") -> DataFrame:
    """Rows of JSON lines; broken lines are left out, ``splits`` reaches the scan as a filter, a limit has an order."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
    if splits:
        rows = rows.where(F.col("split").isin(*splits))
    return rows if limit is None else rows.orderBy(order).limit(limit)


def documents(spark: SparkSession, folder: str, schema: StructType = schemas.DAY_RECORD, leave_out: str | None = None, names: str = "*.json") -> DataFrame:
    """One row a JSON file below ``folder``, with ``path``; unreadable files, and paths that match ``leave_out``, give none."""
    rows = spark.read.schema(schema).options(multiLine="true", recursiveFileLookup="true", pathGlobFilter=names, mode="DROPMALFORMED", ignoreCorruptFiles="true").json(folder)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"))
    return rows if leave_out is None else rows.where(~F.col("path").rlike(leave_out))


def exploded_segments(records: DataFrame, column: str = "sync.segments") -> DataFrame:
    """Segments of nested day records as rows with their place."""
    return records.select("path", F.posexplode(column).alias("place", "segment")).select("path", "place", "segment.*")


def tab_separated(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Rows of a tab-separated file without quoting; a row of fewer than two fields is left out."""
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, sep="\t", quote="")
    return rows.where(F.col(f"`{names[1]}`").isNotNull()) if len(names) > 1 else rows


def run_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``name | arguments``; blank lines and # comments are left out."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", r"\|", 2)
    return lines.select(F.trim(parts[0]).alias("name"), F.trim(F.try_element_at(parts, F.lit(2))).alias("arguments"))


def split_lists(spark: SparkSession, path: str) -> DataFrame:
    """(day, split) of a JSON file that lists days by split."""
    rows = spark.read.schema("value string").text(path, wholetext=True)
    lists = rows.select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return lists.select(F.explode("m").alias("split", "days")).select(F.explode("days").alias("day"), "split")


def audio_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files below ``folder`` with what their names say, see :func:`audio_names`; contents aren't read."""
    return audio_names(spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.mp3").load(folder).select("path", "length")).select("path", "basename", "year", "num", "hebrew_day", "month", "status", "length")


def audio_names(rows: DataFrame) -> DataFrame:
    """``rows`` (path, ...) with year, number, month and day out of the path, and a status instead of a failure."""
    base = F.element_at(F.split(F.try_url_decode("path"), "/"), -1)
    year = F.nullif(F.regexp_extract("path", r"(5\d{3})", 1), F.lit("")).cast("int")
    name = r"^(\d{3})\s+(\d{1,2})-(\w+)"
    number, day, month = (F.nullif(F.regexp_extract(base, name, i), F.lit("")) for i in (1, 2, 3))
    status = F.when(year.isNull(), "no year").when(number.isNull(), "unknown name").otherwise("ok")
    return rows.select("*", base.alias("basename"), year.alias("year"), number.alias("num"), day.cast("int").alias("hebrew_day"), month.alias("month"), status.alias("status"))


def zip_members(spark: SparkSession, paths: str) -> DataFrame:
    """(path, member, content) of the files in archives."""

    def members(batches):
        for frame in batches:
            rows = [(p, name, bundle.read(name)) for p, c in zip(frame["path"], frame["content"], strict=True) for bundle in [zipfile.ZipFile(io.BytesIO(c))] for name in bundle.namelist() if not name.endswith("/")]
            yield pd.DataFrame(rows, columns=["path", "member", "content"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(members, "path string, member string, content binary")


def first_document(rows: DataFrame, stem: str) -> DataFrame:
    """The first path whose file name is ``stem``; a query over no such file fails."""
    named = rows.where(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1) == stem).agg(F.min("path").alias("path"))
    return named.where(F.assert_true(F.col("path").isNotNull(), F.lit(f"no document {stem}")).isNull())


def not_yet_done(rows: DataFrame, done: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Rows whose keys have no result yet; all of them if forced."""
    return rows if force else rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_manifest(rows: DataFrame, path: str) -> None:
    """The manifest as JSON lines, a folder for each split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_gated(rows: DataFrame, path: str, reason: str = "reason") -> None:
    """Kept rows as JSON lines and dropped ones as a tab-separated list with the reason, from one frame."""
    rows.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").json(f"{path}/kept")
    rows.where(F.col(reason).isNotNull()).select("id", reason).write.mode("overwrite").csv(f"{path}/dropped", sep="\t")


def write_vocabulary(words: DataFrame, path: str) -> None:
    """Words and counts, most frequent first, as tab-separated text."""
    words.orderBy(F.desc("n"), "word").write.mode("overwrite").csv(path, sep="\t")


def write_languages(rows: DataFrame, path: str, lang: Column, text: str = "text") -> None:
    """Texts as one stream for each language; rows without a language are left out."""
    rows.select(lang.alias("lang"), F.col(text).alias("value")).where("lang is not null").write.mode("overwrite").partitionBy("lang").text(path)


def subtitles(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One subtitle text an entity, from its segments (start, end, text) in time order."""
    parts = F.sort_array(F.collect_list(F.struct("start", "end", "text")))
    cue = F.transform(parts, lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(s.start), F.lit(" --> "), srt_time(s.end), F.lit("\n"), s.text, F.lit("\n")))
    return segments.groupBy(*keys).agg(F.array_join(cue, "\n").alias("srt"))


def report(rows: DataFrame, title: str, most: int = 1000) -> tuple[str, str]:
    """A small result as Markdown and JSON; a result of more than ``most`` rows is refused, not cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows")
    names = rows.columns
    table = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)] + ["| " + " | ".join("" if v is None else html.escape(str(v)) for v in r) + " |" for r in got]
    return f"# {title}\n\n" + "\n".join(table) + "\n", json.dumps([r.asDict(True) for r in got], default=str, ensure_ascii=False)


def bundle(files: dict[str, bytes]) -> bytes:
    """A tar archive with members in name order and fixed times and owners, so that equal contents give equal bytes."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name in sorted(files):
            member = tarfile.TarInfo(name)
            member.size = len(files[name])
            tar.addfile(member, io.BytesIO(files[name]))
    return out.getvalue()


def published(files: DataFrame, allowed: Sequence[str], replacements: dict[str, str], private: Sequence[str] = ()) -> DataFrame:
    """Files (path, text, ...) that an allowed pattern names, with literal replacements in their text and private columns left out.

    What no pattern names isn't given out; a text that still holds what was to be replaced fails when it is read.
    """
    rows = files.where(F.col("path").rlike("|".join(f"(?:{p})" for p in allowed)) if allowed else F.lit(False)).drop(*private)
    rows = rows.withColumn("text", redacted(F.col("text"), replacements))
    for old, new in replacements.items():
        if old not in new:
            rows = rows.where(F.assert_true(~F.coalesce(F.contains("text", F.lit(old)), F.lit(False)), F.lit("a text is not redacted")).isNull())
    return rows


def between_markers(document: str, begin: str, end: str, block: str) -> str:
    """``document`` with the one stretch between two markers replaced; none or several of them is an error."""
    if document.count(begin) != 1 or document.count(end) != 1:
        raise ValueError("the markers must stand exactly once")
    head, rest = document.split(begin)
    return f"{head}{begin}{block}{end}{rest.split(end)[1]}"
