"""Declared schemas of the files that the readers know."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_S, _I, _L, _D, _B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()


def _of(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


INVENTORY = _of(path=_S, basename=_S, year=_I, month_dir=_S, status=_S, hebrew_month=_I, hebrew_day=_I, civil=DateType(), api_date=_S)
SITE_SEGMENT = _of(start=_D, end=_D, yiddish=_S, hebrew=_S, english=_S)
LOCAL_SEGMENT = _of(start=_D, end=_D, yiddish=_S, n_words=_I, anchor_rate=_D, start_anchored=_B, end_anchored=_B)
DAY_RECORD = StructType(
    [
        StructField("fetched_at", TimestampType()),
        StructField("match", _S),
        StructField("local_offset_seconds", _D),
        StructField("offset_method", _S),
        StructField("site_shift_seconds", _D),
        StructField("sync_untrusted", _B),
        StructField("sync", _of(segments=ArrayType(SITE_SEGMENT))),
        StructField("sync_local", StructType([StructField("kind", _S), StructField("segments", ArrayType(LOCAL_SEGMENT))])),
    ]
)
MANIFEST = _of(
    id=_S, audio=_S, start=_D, end=_D, duration=_D, text=_S, text_raw=_S, hebrew=_S, english=_S, n_segments=_I, timing_source=_S, offset=_D, anchor_rate=_D, year=_I, day=_S, source_mp3=_S, source_year=_I, source_date=_S, split=_S
)
PSEUDO_MANIFEST = _of(id=_S, audio=_S, start=_D, end=_D, duration=_D, text=_S, n_segments=_I, min_logprob=_D, source_mp3=_S, split=_S, timing_source=_S, day=_S, source_year=_S)
SCORED_CLIP = _of(id=_S, day=_S, split=_S, duration=_D, ref=_S, hyp=_S, wer=_D, S=_I, D=_I, I=_I, n_ref=_I)
TRANSCRIPT = StructType(
    [StructField(n, _S) for n in ("source", "model", "backend", "windows", "language")]
    + [StructField("audio_seconds", _D), StructField("segments", ArrayType(_of(start=_D, end=_D, text=_S, avg_logprob=_D, no_speech_prob=_D)))]
)
GLYPH = _of(page=_I, y=_D, x0=_D, x1=_D, code=_S, size=_D, font=_S)
AUDIO = _of(path=_S, samples=BinaryType(), rate=_I, n=_L)
