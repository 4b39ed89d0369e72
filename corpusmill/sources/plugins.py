"""What reads binary contents: decoders of audio, pages and speech are plug-ins that turn batches of bytes into rows."""

from __future__ import annotations

import io
import time
import wave
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RATE = 16_000
#: Tokens that a transcriber may give though they are marks.
ALLOWED_MARKS = ('"', ":", ";", "--", "---")


class Transcriber(Protocol):
    """Turns clips of samples into (text, mean log probability)."""

    def __call__(self, clips: list[np.ndarray]) -> list[tuple[str, float]]: ...


def wave_samples(content: bytes) -> np.ndarray:
    """Mono samples of a 16-bit wave file of the fixed rate; channels are averaged, another rate is refused."""
    with wave.open(io.BytesIO(content)) as sound:
        if sound.getframerate() != RATE or sound.getsampwidth() != 2:
            raise ValueError(f"expected 16-bit samples at {RATE} Hz")
        samples = np.frombuffer(sound.readframes(sound.getnframes()), np.int16).astype(np.float32) / 32768
        return samples.reshape(-1, sound.getnchannels()).mean(axis=1)


def decoded(files: DataFrame, decode: Callable[[bytes], np.ndarray] = wave_samples) -> DataFrame:
    """(path, samples, n, error) of binary files: a failure is a row with its reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    samples = decode(content)
                    rows.append((path, samples.astype(np.float32).tobytes(), len(samples), None))
                except Exception as error:  # noqa: BLE001 - the reason is the result
                    rows.append((path, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "samples", "n", "error"]).astype({"n": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, samples binary, n bigint, error string")


def seconds(stored: Column, samples: Column) -> Column:
    """Stored duration where there is one, else that of the samples."""
    return F.coalesce(F.nullif(stored, F.lit(0.0)), samples / F.lit(float(RATE)))


def loudness(samples: np.ndarray, frame: int = RATE // 10) -> np.ndarray:
    """Root mean square of whole frames."""
    whole = samples[: len(samples) // frame * frame].reshape(-1, frame)
    return np.sqrt((whole.astype(np.float64) ** 2).mean(axis=1))


def quiet_split(levels: np.ndarray, most: int, last: int) -> list[tuple[int, int]]:
    """Frame ranges of at most ``most`` frames, cut at the quietest of the last ``last`` frames each range may have."""
    out, at = [], 0
    while len(levels) - at > most:
        low = at + max(1, most - last)
        stop = low + int(np.argmin(levels[low : at + most])) if low < at + most else at + most
        stop = stop if stop > at + 1 else at + most
        out.append((at, stop))
        at = stop
    return [*out, (at, len(levels))]


def loud_gaps(levels: np.ndarray, covered: list[tuple[int, int]], least: int, share: float = 0.3) -> list[tuple[int, int]]:
    """Runs of at least ``least`` uncovered frames that are louder than ``share`` of the covered ones' level."""
    mask = np.zeros(len(levels), bool)
    for a, b in covered:
        mask[a:b] = True
    level = np.sqrt((levels[mask] ** 2).mean()) if mask.any() else 0.0
    edges = np.flatnonzero(np.diff(np.concatenate([[1], mask.astype(int), [1]])))
    runs = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return [(a, b) for a, b in runs if b - a >= least and np.sqrt((levels[a:b] ** 2).mean()) > share * level]


def best_lag(probe: np.ndarray, signal: np.ndarray) -> tuple[int, float, float]:
    """Place where the probe fits the signal best, its score and the second best one."""
    z = lambda x: (x - x.mean()) / (x.std() or 1.0)
    scores = np.correlate(z(signal), z(probe), mode="valid") / len(probe)
    order = np.sort(scores)
    return int(np.argmax(scores)), float(order[-1]), float(order[-2]) if len(order) > 1 else float("nan")


def suppressed(marks: list[str]) -> list[str]:
    """Marks a transcriber must not give."""
    return [m for m in marks if m not in ALLOWED_MARKS]


def transcribed(clips: DataFrame, transcribe: Transcriber, batch: int = 16) -> DataFrame:
    """(id, text, logprob, error) of clips (id, samples as 32-bit floats): a plug-in decodes ``batch`` clips at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                try:
                    got = transcribe([np.frombuffer(x, np.float32) for x in some["samples"]])
                    rows += [(i, t, float(p), None) for i, (t, p) in zip(some["id"], got, strict=True)]
                except Exception as error:  # noqa: BLE001 - the reason is the result
                    rows += [(i, None, None, str(error)) for i in some["id"]]
            yield pd.DataFrame(rows, columns=["id", "text", "logprob", "error"])

    return clips.select("id", "samples").mapInPandas(run, "id string, text string, logprob double, error string")


def document_texts(files: DataFrame, readers: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """(path, text, error) of binary files, read by the plug-in for the end of their names; a name without one is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                kind = path.rpartition(".")[2].lower()
                try:
                    rows.append((path, readers[kind](content), None) if kind in readers else (path, None, f"no reader for {kind}"))
                except Exception as error:  # noqa: BLE001
                    rows.append((path, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def array_shards(files: DataFrame) -> DataFrame:
    """(path, name, shape, numbers) of archives of named arrays, one row an array."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for name in arrays.files:
                        yield pd.DataFrame([(path, name, list(arrays[name].shape), arrays[name].astype(np.float64).ravel().tolist())], columns=["path", "name", "shape", "numbers"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, shape array<int>, numbers array<double>")


def averaged(arrays: DataFrame, weights: DataFrame) -> DataFrame:
    """(name, place, value): arrays (path, name, numbers) of one name averaged by the weight of their path over all weights."""
    rows = arrays.join(weights, "path").select("name", "weight", F.posexplode("numbers").alias("place", "x"))
    return rows.groupBy("name", "place").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("value"))


def padded_labels(ids: Column, size: Column, most: int = 440, pad: int = -100) -> Column:
    """At most ``most`` labels, filled up to ``size`` with a value that losses leave out."""
    kept = F.slice(ids, 1, most)
    return F.concat(kept, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), size - F.size(kept)).cast("int")))


def with_retries(fetch: Callable[[str], dict | None], tries: int = 3, wait: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], dict | None]:
    """``fetch`` tried again after a failure, ``wait`` seconds longer each time; the last failure is raised."""

    def run(asked: str) -> dict | None:
        for k in range(tries):
            try:
                return fetch(asked)
            except Exception:  # noqa: BLE001 - any failure of a service may pass
                if k + 1 == tries:
                    raise
                sleep(wait * (k + 1))
        return None

    return run


def measured_size(probe: Callable[[str], int | None], reference_bytes: int, reference_seconds: float) -> Callable[[str], float | None]:
    """Seconds that a file should have by its size, from a known file of the same coding; None where the size isn't told."""

    def run(address: str) -> float | None:
        size = probe(address)
        return None if not size or not reference_bytes else size * reference_seconds / reference_bytes

    return run


class CalendarDays(DataSource):
    """A Python data source of days: one row for each date from ``first`` to ``last``, fetched by ``fetch`` if given.

    Stands in for a rate-limited service: one partition, ``pause`` seconds between requests, failed ones tried again, and
    answers for another day than asked left out. A day that fails to the end is a row with its error, not a failed job.
    """

    fetch: Callable[[str], dict | None] | None = None

    @classmethod
    def name(cls) -> str:
        return "calendar_days"

    def schema(self) -> str:
        return "asked string, answer string, error string"

    def reader(self, schema):
        return _CalendarReader(self.options, type(self).fetch)


class _CalendarReader(DataSourceReader):
    def __init__(self, options, fetch) -> None:
        self.first, self.last, self.fetch = options["first"], options["last"], fetch and with_retries(fetch, int(options.get("tries", "3")), float(options.get("wait", "3")))
        self.pause = float(options.get("pause", "0"))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        import datetime

        day, end = datetime.date.fromisoformat(self.first), datetime.date.fromisoformat(self.last)
        while day <= end:
            try:
                answer = self.fetch(day.isoformat()) if self.fetch else {"date": day.isoformat()}
                if answer and answer.get("date") == day.isoformat():
                    yield (day.isoformat(), str(answer), None)
            except Exception as error:  # noqa: BLE001
                yield (day.isoformat(), None, str(error))
            if self.pause:
                time.sleep(self.pause)
            day += datetime.timedelta(days=1)
