import io
import json
import struct
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files, plugins
from corpusmill.streaming import incremental


def test_json_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "b", "split": "train"}\n\nbroken\n{"id": "a", "split": "dev"}\n')
    rows = files.json_lines(spark, str(tmp_path / "m.jsonl"))
    assert sorted(r.id for r in rows.collect()) == ["a", "b"]
    assert [r.id for r in files.json_lines(spark, str(tmp_path / "m.jsonl"), splits=["dev"]).collect()] == ["a"]
    (tmp_path / "d" / "x").mkdir(parents=True)
    (tmp_path / "d" / "x" / "001.json").write_text(json.dumps({"local_offset_seconds": 1.5, "sync": {"segments": [{"start": 0, "end": 2.5, "yiddish": "א"}]}}, indent=1))
    docs = files.documents(spark, str(tmp_path / "d"))
    assert [(r.place, r.end, r.yiddish) for r in files.exploded_segments(docs).collect()] == [(0, 2.5, "א")]
    assert files.documents(spark, str(tmp_path / "d"), leave_out="/x/").count() == 0
    assert files.first_document(docs, "001").count() == 1
    with pytest.raises(Exception, match="no document"):
        files.first_document(docs, "nope").collect()


def test_text_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\twhy\thyp\n2\n")
    assert [r.id for r in files.tab_separated(spark, str(tmp_path / "t.tsv"), ["id", "why", "hyp"]).collect()] == ["1"]
    (tmp_path / "runs.txt").write_text("# c\n\na | --x 1\nb\n")
    assert [(r.name, r.arguments) for r in files.run_table(spark, str(tmp_path / "runs.txt")).collect()] == [("a", "--x 1"), ("b", None)]
    (tmp_path / "s.json").write_text('{"dev": ["1", "2"], "test": ["3"]}')
    assert {(r.day, r.split) for r in files.split_lists(spark, str(tmp_path / "s.json")).collect()} == {("1", "dev"), ("2", "dev"), ("3", "test")}


def test_inventory_and_archives(spark, tmp_path):
    day = tmp_path / "y5781" / "Tishrei"
    day.mkdir(parents=True)
    (day / "001 6-Tishrei.mp3").write_bytes(b"x")
    (day / "odd.mp3").write_bytes(b"x")
    got = {(r.basename, r.year, r.num, r.hebrew_day, r.month, r.status) for r in files.audio_inventory(spark, str(tmp_path)).collect()}
    assert got == {("001 6-Tishrei.mp3", 5781, "001", 6, "Tishrei", "ok"), ("odd.mp3", 5781, None, None, None, "unknown name")}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/b.txt", "hi")
    assert [(r.member, bytes(r.content)) for r in files.zip_members(spark, str(tmp_path / "z.zip")).collect()] == [("a/b.txt", b"hi")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", None), ("b", "dev", "short")], "id string, split string, reason string")
    files.write_manifest(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).where("split = 'dev'").count() == 1
    files.write_gated(rows, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "kept")).count() == 1
    assert files.not_yet_done(rows, rows.where("id = 'a'"), ["id"]).count() == 1
    assert files.report(rows.orderBy("id"), "T")[0].startswith("# T")
    with pytest.raises(ValueError, match="at most"):
        files.report(rows, "T", 1)
    assert files.bundle({"b": b"2", "a": b"1"}) == files.bundle({"a": b"1", "b": b"2"})
    assert files.between_markers("x<a>1<b>y", "<a>", "<b>", "2") == "x<a>2<b>y"
    cues = spark.createDataFrame([("f", 1.0, 2.5, "hi")], "f string, start double, end double, text string")
    assert files.subtitles(cues, ["f"]).first().srt == "1\n00:00:01,000 --> 00:00:02,500\nhi\n"


def sound(rate=plugins.RATE, n=1600):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack("<hh", 1000, 3000) * n)
    return out.getvalue()


def test_audio(spark):
    df = spark.createDataFrame([("a", sound()), ("b", sound(8000)), ("c", b"junk")], "path string, content binary")
    got = {r.path: (r.n, r.error is None) for r in plugins.decoded(df).collect()}
    assert got == {"a": (1600, True), "b": (None, False), "c": (None, False)}
    assert abs(plugins.loudness(plugins.wave_samples(sound()))[0] - 2000 / 32768) < 1e-6
    levels = np.array([1.0] * 5 + [0.1] + [1.0] * 5)
    assert plugins.quiet_split(levels, 8, 5) == [(0, 5), (5, 11)]
    assert plugins.loud_gaps(np.ones(10), [(0, 3), (7, 10)], 2) == [(3, 7)]
    assert plugins.best_lag(np.array([1.0, 5, 1]), np.array([0, 0, 1.0, 5, 1, 0, 0]))[0] == 2


def test_calendar_source(spark):
    spark.dataSource.register(plugins.CalendarDays)
    assert [r.asked for r in spark.read.format("calendar_days").options(first="2024-02-28", last="2024-03-01").load().collect()] == ["2024-02-28", "2024-02-29", "2024-03-01"]


def test_streams(spark, tmp_path):
    schema = "k string, s bigint, e bigint"
    folder = tmp_path / "in"
    spark.createDataFrame([("a", 0, 1000), ("a", 1500, 2000), ("a", 9000, 9500)], schema).coalesce(1).write.parquet(str(folder))
    stream = incremental.new_files(spark, str(folder), spark.createDataFrame([], schema).schema)
    incremental.once(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    incremental.once(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    incremental.once(incremental.merged_stream(stream, "k", 28_000, 2_000), str(tmp_path / "m"), str(tmp_path / "mcp")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [("a", 0, 2000, 2)]
    running = incremental.running_rate(stream.select("k", F.lit(1).alias("edits"), F.lit(4).alias("n_ref")), ["k"])
    query = running.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("rates").collect()] == [("a", 3, 12)]


def test_retries_and_sizes():
    seen, waits = [], []

    def fetch(day):
        seen.append(day)
        if len(seen) < 3:
            raise OSError("busy")
        return {"date": day}

    assert plugins.with_retries(fetch, 3, 2.0, waits.append)("x") == {"date": "x"} and waits == [2.0, 4.0]
    with pytest.raises(OSError, match="busy"):
        plugins.with_retries(lambda d: (_ for _ in ()).throw(OSError("busy")), 2, 0.0, waits.append)("x")
    seconds = plugins.measured_size({"a": 500, "b": None}.get, 1000, 60.0)
    assert seconds("a") == 30.0 and seconds("b") is None


def test_plugins_for_clips_documents_and_arrays(spark, tmp_path):
    clips = spark.createDataFrame([("a", np.zeros(4, np.float32).tobytes()), ("b", np.ones(4, np.float32).tobytes())], "id string, samples binary")
    got = plugins.transcribed(clips, lambda xs: [(str(int(x.sum())), -0.5) for x in xs]).collect()
    assert sorted((r.id, r.text, r.error) for r in got) == [("a", "0", None), ("b", "4", None)]
    assert plugins.transcribed(clips, lambda xs: 1 / 0).where("error is not null").count() == 2
    (tmp_path / "a.txt").write_text("hi")
    (tmp_path / "b.doc").write_bytes(b"x")
    files_ = spark.read.format("binaryFile").load(str(tmp_path))
    texts = {r.path.rpartition("/")[2]: (r.text, r.error) for r in plugins.document_texts(files_, {"txt": bytes.decode}).collect()}
    assert texts == {"a.txt": ("hi", None), "b.doc": (None, "no reader for doc")}
    shards = tmp_path / "shards"
    shards.mkdir()
    np.savez(shards / "one.npz", w=np.array([[1.0, 2.0]]), v=np.array([4.0]))
    np.savez(shards / "two.npz", w=np.array([[3.0, 6.0]]))
    arrays = plugins.array_shards(spark.read.format("binaryFile").load(str(shards)))
    assert {(r.name, tuple(r.shape)) for r in arrays.collect()} == {("w", (1, 2)), ("v", (1,))}
    weights = arrays.select("path", F.when(F.col("path").endswith("one.npz"), 3.0).otherwise(1.0).alias("weight")).distinct()
    assert sorted((r.name, r.place, r.value) for r in plugins.averaged(arrays, weights).collect()) == [("v", 0, 4.0), ("w", 0, 1.5), ("w", 1, 3.0)]
    assert spark.range(1).select(plugins.padded_labels(F.array(F.lit(5), F.lit(6), F.lit(7)), F.lit(5), 2).alias("x")).first().x == [5, 6, -100, -100, -100]


def test_publishing_by_allow_list(spark):
    rows = spark.createDataFrame([("docs/a.md", "at /home/me", 1), ("secret/b.md", "x", 2)], "path string, text string, sample int")
    got = files.published(rows, ["^docs/"], {"/home/me": "~"}, ["sample"])
    assert [tuple(r) for r in got.collect()] == [("docs/a.md", "at ~")]
    assert files.published(rows, [], {}).count() == 0
