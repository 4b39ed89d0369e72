"""Clip manifests: timing sources, merging, splits, quality gates, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import edits, numerals, text
from corpusmill.operators.intervals import to_ms
from corpusmill.operators.relations import latest
from corpusmill.operators.segments import bounded_merge
from corpusmill.session import table

MAX_SPAN_MS, MAX_GAP_MS, MIN_CLIP_MS = 28_000, 2_000, 1_000
MIN_SEGMENT_MS = 200
#: Gate on machine hypotheses: character error rate and ratio of word lengths.
MAX_CER, RATIOS = 0.60, (0.5, 2.0)


def clips(spark: SparkSession, root: str) -> DataFrame:
    """Distinct clips."""
    return table(spark, root, "manifest").distinct()


def days(spark: SparkSession, root: str) -> DataFrame:
    """The latest record of each day; of equal fetch times the greatest path."""
    return latest(table(spark, root, "day_record"), ["year", "day"], [F.col("fetched_at"), F.col("path")])


def segments(spark: SparkSession, root: str) -> DataFrame:
    """Latest delivery of each segment, with times in milliseconds."""
    rows = latest(table(spark, root, "site_segment"), ["seg_id"], [F.col("fetched_at")])
    return rows.withColumn("s", to_ms(F.col("start"))).withColumn("e", to_ms(F.col("end")))


def noisy(words: Column, number: Column) -> Column:
    """A stand-in for recognised words: some dropped, some misheard, by place and clip number."""
    kept = F.filter(words, lambda w, i: (i + number) % 11 != 0)
    marked = F.transform(words, lambda w, i: F.when((i + number) % 11 == 0, F.lit(None)).when((i + number) % 7 == 0, F.lit("x")).otherwise(w))
    return F.when(words.isNotNull() & kept.isNotNull(), F.filter(marked, lambda w: w.isNotNull()))


def scored(spark: SparkSession, root: str) -> DataFrame:
    """Clips with reference and hypothesis words and their word edits."""
    rows = clips(spark, root).select("id", "year", "day", "split", "duration", text.scoring_text(F.coalesce("text", F.lit(""))).alias("ref"))
    rows = rows.withColumn("number", F.element_at(F.split("id", "/"), -1).try_cast("int")).withColumn("ref_words", text.words(F.col("ref")))
    rows = rows.withColumn("hyp_words", noisy(F.col("ref_words"), F.coalesce("number", F.lit(0))))
    return rows.withColumn("edits", edits.word_edits(F.col("ref_words"), F.col("hyp_words"))).withColumn("n_ref", F.size("ref_words").cast("bigint"))


def manifest_summary(spark: SparkSession, root: str) -> DataFrame:
    """Clips, time, words and days of each split."""
    rows = clips(spark, root)
    return rows.groupBy("split").agg(F.count("*").alias("clips"), F.sum(to_ms(F.col("duration"))).alias("total_ms"), F.sum(text.word_count(F.col("text"))).cast("bigint").alias("words"), F.countDistinct("year", "day").alias("days"))


def duration_stats(spark: SparkSession, root: str) -> DataFrame:
    """Least, median and greatest duration, and what a mean needs."""
    ms = to_ms(F.col("duration"))
    return clips(spark, root).agg(F.min(ms).alias("least_ms"), F.percentile(ms, 0.5).alias("median_ms"), F.max(ms).alias("most_ms"), F.sum(ms).alias("sum_ms"), F.count(ms).alias("n"))


def timing_sources(spark: SparkSession, root: str) -> DataFrame:
    """Which timing each day uses: the site's if there are segments, an offset, and no distrust; else the clips' own."""
    counted = segments(spark, root).groupBy("year", "day").agg(F.count("*").alias("segments"))
    rows = days(spark, root).join(counted, ["year", "day"], "left")
    offset = F.coalesce("site_shift_seconds", "local_offset_seconds")
    usable = (F.coalesce("segments", F.lit(0)) > 0) & offset.isNotNull() & ~F.coalesce("sync_untrusted", F.lit(False))
    return rows.select("year", "day", F.when(usable, "site").otherwise("local").alias("timing_source"), F.when(usable, to_ms(offset)).otherwise(0).cast("bigint").alias("offset_ms"))


def shifted_segments(spark: SparkSession, root: str) -> DataFrame:
    """Segments on the recording's clock: shifted, cut at 0, and dropped when too short."""
    shift = timing_sources(spark, root).where("timing_source = 'site'")
    rows = segments(spark, root).join(shift, ["year", "day"])
    at = lambda c: F.greatest(F.lit(0).cast("bigint"), F.col(c) + F.col("offset_ms"))
    return rows.select("seg_id", at("s").alias("start_ms"), at("e").alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= MIN_SEGMENT_MS)


def merged_clips(spark: SparkSession, root: str) -> DataFrame:
    """Segments with text merged into clips of at most 28 s without pauses of 2 s."""
    rows = segments(spark, root).where(F.trim(F.coalesce("yiddish", F.lit(""))) != "")
    return bounded_merge(rows, ["year", "day"], "s", "e", ["seg_id"], MAX_SPAN_MS, MAX_GAP_MS, MIN_CLIP_MS)


def merged_spans(spark: SparkSession, root: str) -> DataFrame:
    """Speech windows merged while the whole stays under 28 s, whatever the pauses."""
    rows = table(spark, root, "speech_window").select("year", "day", to_ms(F.col("start")).alias("s"), to_ms(F.col("end")).alias("e")).distinct()
    return bounded_merge(rows, ["year", "day"], "s", "e", [], MAX_SPAN_MS, None)


def clip_rows(spark: SparkSession, root: str) -> DataFrame:
    """Ids of merged clips: day, and the number in it with leading zeros."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("year", "day").orderBy("chunk_start", "chunk_end")) - 1
    number = nth.cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return merged_clips(spark, root).select(F.concat_ws("/", F.col("year").cast("string"), "day", padded).alias("id"), "chunk_start", "chunk_end", F.col("n").alias("n_segments"))


def split_by_hash(spark: SparkSession, root: str) -> DataFrame:
    """Split of each day by the digest of its name."""
    return table(spark, root, "manifest").select("year", "day").distinct().select("year", "day", numerals.split_of_digest(F.col("day")).alias("split"))


def split_by_list(spark: SparkSession, root: str) -> DataFrame:
    """Split of each day by the lists that name it: test, then test_b, then dev, else train."""
    listed = table(spark, root, "manifest").groupBy("year", "day").agg(F.collect_set("split").alias("lists"))
    has = lambda name: F.array_contains("lists", name)
    return listed.select("year", "day", F.when(has("test"), "test").when(has("test_b"), "test_b").when(has("dev"), "dev").otherwise("train").alias("split"))


def held_out_days(spark: SparkSession, root: str) -> DataFrame:
    """Days of train clips that are also held out: a semi join."""
    rows = table(spark, root, "manifest").select("year", "day", "split").distinct()
    held = rows.where("split <> 'train'").select("year", "day").distinct()
    return rows.where("split = 'train'").select("year", "day").join(held, ["year", "day"], "left_semi")


def gate(spark: SparkSession, root: str) -> DataFrame:
    """Clips with what their report says: kept, or why not. A report is made of the raw text; a clip without one passes.

    Reports are rows of their own, of which the last one of an id counts.
    """
    number = F.coalesce(F.element_at(F.split("id", "/"), -1).try_cast("int"), F.lit(0))
    clip = clips(spark, root).select("id", text.scoring_text(F.coalesce("text", F.lit(""))).alias("ref")).withColumn("n_ref", F.size(text.words(F.col("ref"))))
    last = table(spark, root, "manifest").where(F.trim(F.coalesce("text_raw", F.lit(""))) != "").groupBy("id").agg(F.max("text_raw").alias("raw"))
    heard = last.withColumn("words", noisy(text.words(text.scoring_text(F.col("raw"))), number)).select("id", F.array_join("words", " ").alias("hyp"), F.size("words").alias("n_hyp"))
    joined = clip.join(heard, "id", "left")
    cer = F.when(F.col("hyp") == "", 1.0).otherwise(edits.rate(edits.char_edits(F.col("ref"), F.col("hyp")), F.length("ref")))
    ratio = F.col("n_hyp") / F.greatest(F.lit(1), F.col("n_ref"))
    reason = F.when(F.col("hyp").isNull(), "kept").when(F.col("ref") == "", "empty reference").when(cer > MAX_CER, "error rate").when(~ratio.between(*RATIOS), "length ratio").otherwise("kept")
    return joined.select("id", reason.alias("reason"))


def drop_rate_by_year(spark: SparkSession, root: str) -> DataFrame:
    """Clips and dropped clips of each year."""
    rows = gate(spark, root).select(F.split("id", "/")[0].alias("year"), F.col("reason"))
    return rows.groupBy("year").agg(F.count("*").alias("clips"), F.count_if(F.col("reason") != "kept").alias("dropped"))


def untrusted_days(spark: SparkSession, root: str) -> DataFrame:
    """Days with site timing of whose clips a fifth or more fail the gate."""
    return _day_drops(clips(spark, root).where("timing_source = 'site'"), gate(spark, root)).where((F.col("dropped") > 0) & (F.col("dropped") * 5 >= F.col("clips")))


def _day_drops(rows: DataFrame, gated: DataFrame) -> DataFrame:
    """Clips and dropped ones of each day, by one aggregation."""
    return rows.select("id", "year", "day").join(gated, "id").groupBy("year", "day").agg(F.count("*").alias("clips"), F.count_if(F.col("reason") != "kept").alias("dropped"))


def day_drops(spark: SparkSession, root: str) -> DataFrame:
    """Clips and dropped clips of each day."""
    return _day_drops(clips(spark, root), gate(spark, root))


def launch_guard(spark: SparkSession, root: str) -> DataFrame:
    """Whether training may start: enough kept clips, and no year of some size that loses more than a quarter of them."""
    return guarded(drop_rate_by_year(spark, root), least_kept=1000, large_year=100, most_dropped=0.25)


def guarded(years: DataFrame, least_kept: int, large_year: int, most_dropped: float) -> DataFrame:
    """(kept, bad_years, passes) of years (year, clips, dropped): a year counts as bad only with more than ``large_year`` clips."""
    bad = (F.col("clips") > large_year) & (F.col("dropped") > F.col("clips") * most_dropped)
    rows = years.agg(F.coalesce(F.sum(F.col("clips") - F.col("dropped")), F.lit(0)).alias("kept"), F.count_if(bad).alias("bad_years"))
    return rows.withColumn("passes", (F.col("kept") >= least_kept) & (F.col("bad_years") == 0))


def required(guard: DataFrame) -> DataFrame:
    """``guard``, failing when it is read where it doesn't pass."""
    return guard.where(F.assert_true("passes", F.lit("the launch guard doesn't pass")).isNull())


def composition_by_year(spark: SparkSession, root: str) -> DataFrame:
    """Days, clips and time of each source year; clips without one are a group."""
    return clips(spark, root).groupBy("source_year").agg(F.countDistinct("year", "day").alias("days"), F.count("*").alias("clips"), F.sum(to_ms(F.col("duration"))).alias("total_ms"))


def split_by_timing(spark: SparkSession, root: str) -> DataFrame:
    """Clips by split and timing source, one column a source."""
    return clips(spark, root).groupBy("split").pivot("timing_source", ["site", "local"]).count().na.fill(0)


def anchor_rates(spark: SparkSession, root: str) -> DataFrame:
    """Clips of local timing by tenth of their anchor rate, with empty tenths."""
    bins = spark.range(10).select(F.col("id").cast("int").alias("tenth"))
    tenth = F.least(F.lit(9), F.floor(F.col("anchor_rate") * 10)).cast("int")
    found = clips(spark, root).where("anchor_rate is not null and not isnan(anchor_rate)").groupBy(tenth.alias("tenth")).agg(F.count("*").alias("n"))
    return bins.join(found, "tenth", "left").select("tenth", F.coalesce("n", F.lit(0)).alias("clips"))


def duration_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Clips by duration between fixed edges."""
    ms = to_ms(F.col("duration"))
    bucket = F.when(ms < 2000, 0).when(ms < 5000, 2).when(ms < 10000, 5).when(ms < 15000, 10).when(ms < 20000, 15).when(ms < 25000, 20).otherwise(25)
    return clips(spark, root).groupBy(bucket.alias("from_seconds")).agg(F.count("*").alias("clips"))


def united_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Clips with machine-made ones added, whose years are text: rows and words by origin."""
    real = clips(spark, root).select("id", "source_year", "text", F.lit("manifest").alias("origin"))
    made = segments(spark, root).select(F.concat(F.lit("segment/"), "seg_id").alias("id"), F.col("year").cast("string").cast("int").alias("source_year"), F.col("yiddish").alias("text"), F.lit("segment").alias("origin"))
    return real.unionByName(made).groupBy("origin", "source_year").agg(F.count("*").alias("rows"), F.sum(text.word_count(F.col("text"))).cast("bigint").alias("words"))


_CLIPS = "c AS (SELECT DISTINCT * FROM manifest)"
_DAYS = "d AS (SELECT * FROM day_record QUALIFY row_number() OVER (PARTITION BY year, day ORDER BY fetched_at DESC NULLS LAST, path DESC) = 1)"
_SEGMENTS = 'g AS (SELECT *, CAST(round(start * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e FROM site_segment QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY fetched_at DESC NULLS LAST) = 1)'
_TIMING = f"""{_DAYS}, {_SEGMENTS}, n AS (SELECT year, day, count(*) AS segments FROM g GROUP BY ALL),
t AS (SELECT d.year, d.day, coalesce(site_shift_seconds, local_offset_seconds) AS o,
  coalesce(n.segments, 0) > 0 AND coalesce(site_shift_seconds, local_offset_seconds) IS NOT NULL AND NOT coalesce(sync_untrusted, false) AS usable
  FROM d LEFT JOIN n ON n.year = d.year AND n.day = d.day),
u AS (SELECT year, day, CASE WHEN usable THEN 'site' ELSE 'local' END AS timing_source, CASE WHEN usable THEN CAST(round(o * 1000) AS BIGINT) ELSE 0 END AS offset_ms FROM t)"""
_WORDS = r"len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}]+') IF x <> ''])"


def _merge_sql(rows: str, gap: str, least: int) -> str:
    return f"""WITH RECURSIVE {rows}, o AS (SELECT *, row_number() OVER (PARTITION BY year, day ORDER BY s, e, k) AS r FROM w WHERE e > s),
m AS (SELECT year, day, r, s AS cs, e AS ce, 1 AS chunk FROM o WHERE r = 1
  UNION ALL SELECT o.year, o.day, o.r, CASE WHEN {gap} THEN cs ELSE o.s END, o.e, CASE WHEN {gap} THEN chunk ELSE chunk + 1 END
  FROM m JOIN o ON o.year = m.year AND o.day = m.day AND o.r = m.r + 1),
k AS (SELECT year, day, chunk, min(cs) AS chunk_start, arg_max(ce, r) AS chunk_end, count(*) AS n FROM m GROUP BY ALL)
SELECT year, day, chunk_start, chunk_end, n FROM k WHERE chunk_end - chunk_start >= {least}"""


_MERGED = _merge_sql(_SEGMENTS + ", w AS (SELECT *, seg_id AS k FROM g WHERE trim(coalesce(yiddish, ''), ' ') <> '')", f"o.e - cs <= {MAX_SPAN_MS} AND o.s - ce < {MAX_GAP_MS}", MIN_CLIP_MS)
# Recognised words made from the reference, as `noisy` makes them.
_SCORING = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '[\[\]]', '', 'g'), '[\x{591}-\x{5c7}]', '', 'g'), '[\x{5be}\x{2013}\x{2014}-]', ' ', 'g'), '["\x{5f4}\x{201c}\x{201d}''\x{5f3}\x{2018}\x{2019}`]', '', 'g'), '[^\x{5d0}-\x{5ea}]', ' ', 'g'), ' +', ' ', 'g'))"""
# Rows of the distance table one after another: an insertion costs one a place, so a running minimum of (cost - place) does.
_DISTANCE = '''list_reduce(list_concat([{'row': range(0, len(hw) + 1), 'w': ''}], [{'row': CAST([] AS BIGINT[]), 'w': w} FOR w IN rw]),
  lambda a, x: {'row': [[list_min(t[1:j + 1]) + j FOR j IN range(0, len(t))] FOR t IN [[least(a.row[j + 1] + 1, CASE WHEN j = 0 THEN a.row[1] + 1 ELSE a.row[j] + CASE WHEN hw[j] = x.w THEN 0 ELSE 1 END END) - j FOR j IN range(0, len(hw) + 1)]]][1], 'w': x.w}).row[-1]'''
_SCORED = f"""{_CLIPS}, q AS (SELECT id, year, day, split, {_SCORING} AS ref, coalesce(TRY_CAST(split_part(id, '/', -1) AS INT), 0) AS number FROM c),
v AS (SELECT *, [x FOR x IN string_split(ref, ' ') IF x <> ''] AS rw FROM q),
y AS (SELECT *, [CASE WHEN (i - 1 + number) % 7 = 0 THEN 'x' ELSE rw[i] END FOR i IN range(1, len(rw) + 1) IF (i - 1 + number) % 11 <> 0] AS hw FROM v),
s AS (SELECT id, year, day, split, number, ref, rw, hw, CAST({_DISTANCE} AS BIGINT) AS edits, CAST(len(rw) AS BIGINT) AS n_ref FROM y)"""
_GATE = f"""{_CLIPS}, rep AS (SELECT id, max(text_raw) AS raw FROM manifest WHERE trim(coalesce(text_raw, ''), ' ') <> '' GROUP BY id),
hv AS (SELECT id, coalesce(TRY_CAST(split_part(id, '/', -1) AS INT), 0) AS number, [x FOR x IN string_split({_SCORING.replace("coalesce(text, '')", "raw")}, ' ') IF x <> ''] AS rw FROM rep),
hy AS (SELECT id, [CASE WHEN (i - 1 + number) % 7 = 0 THEN 'x' ELSE rw[i] END FOR i IN range(1, len(rw) + 1) IF (i - 1 + number) % 11 <> 0] AS hw FROM hv),
f AS (SELECT c.id, translate({_SCORING}, 'אבגדהוזחטיךכלםמןנסעףפץצקרשת', 'abcdefghijklmnopqrstuvwyzAB') AS r, translate(array_to_string(hw, ' '), 'אבגדהוזחטיךכלםמןנסעףפץצקרשת', 'abcdefghijklmnopqrstuvwyzAB') AS h, len(hw) AS n_hyp FROM c LEFT JOIN hy ON hy.id = c.id),
gate AS (SELECT id, CASE WHEN h IS NULL THEN 'kept' WHEN r = '' THEN 'empty reference'
  WHEN CASE WHEN h = '' THEN 1.0 ELSE levenshtein(r, h)::DOUBLE / greatest(1, length(r)) END > {MAX_CER} THEN 'error rate'
  WHEN n_hyp::DOUBLE / greatest(1, len([x FOR x IN string_split(r, ' ') IF x <> ''])) NOT BETWEEN 0.5 AND 2.0 THEN 'length ratio' ELSE 'kept' END AS reason FROM f)"""
# Word edits of whole days: references and hypotheses in clip order, and the distance table of a day by diagonals, of which
# each needs the two before alone. A diagonal is held by reference place; places outside the table are large.
_DIAGONALS = """list_reduce(list_concat([{'p': CAST([] AS BIGINT[]), 'q': CAST([] AS BIGINT[]), 'd': -1}], [{'p': CAST([] AS BIGINT[]), 'q': CAST([] AS BIGINT[]), 'd': d} FOR d IN range(0, len(rw) + len(hw) + 1)]),
  lambda a, x: {'p': [CASE WHEN x.d - i < 0 OR x.d - i > len(hw) THEN 1000000000 WHEN i = 0 THEN x.d WHEN x.d = i THEN i ELSE least(a.p[i + 1] + 1, a.p[i] + 1, a.q[i] + CASE WHEN rw[i] = hw[x.d - i] THEN 0 ELSE 1 END) END FOR i IN range(0, len(rw) + 1)], 'q': a.p, 'd': x.d}).p[-1]"""
_WHOLE_DAY = f"""WITH {_SCORED}, o AS (SELECT year, day, flatten(list(rw ORDER BY id)) AS rw, flatten(list(hw ORDER BY id)) AS hw FROM s GROUP BY year, day)
SELECT year, day, CAST(len(rw) AS BIGINT) AS ref_words, CAST(len(hw) AS BIGINT) AS hyp_words, CAST({_DIAGONALS} AS BIGINT) AS edits FROM o"""

QUERIES = {
    f.__name__: f
    for f in (manifest_summary, duration_stats, timing_sources, shifted_segments, merged_clips, merged_spans, clip_rows, split_by_hash, split_by_list, held_out_days, gate, drop_rate_by_year, untrusted_days, day_drops, launch_guard, composition_by_year, split_by_timing, anchor_rates, duration_histogram, united_manifests)
}
SQL = {
    "manifest_summary": f"WITH {_CLIPS} SELECT split, count(*) AS clips, CAST(sum(CAST(round(duration * 1000) AS BIGINT)) AS BIGINT) AS total_ms, CAST(sum({_WORDS}) AS BIGINT) AS words, count(DISTINCT (year, day)) AS days FROM c GROUP BY split",
    "duration_stats": f"WITH {_CLIPS}, m AS (SELECT CAST(round(duration * 1000) AS BIGINT) AS x FROM c) SELECT min(x) AS least_ms, quantile_cont(x::DOUBLE, 0.5) AS median_ms, max(x) AS most_ms, CAST(sum(x) AS BIGINT) AS sum_ms, count(x) AS n FROM m",
    "timing_sources": f"WITH {_TIMING} SELECT * FROM u",
    "shifted_segments": f"WITH {_TIMING} SELECT seg_id, greatest(0, s + offset_ms) AS start_ms, greatest(0, e + offset_ms) AS end_ms FROM g JOIN u ON u.year = g.year AND u.day = g.day WHERE timing_source = 'site' AND greatest(0, e + offset_ms) - greatest(0, s + offset_ms) >= {MIN_SEGMENT_MS}",
    "merged_clips": _MERGED,
    "merged_spans": _merge_sql('w AS (SELECT DISTINCT year, day, CAST(round(start * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e, 0 AS k FROM speech_window)', f"o.e - cs <= {MAX_SPAN_MS}", 0),
    "clip_rows": f"SELECT concat_ws('/', year, day, CASE WHEN r < 100 THEN lpad(r::VARCHAR, 3, '0') ELSE r::VARCHAR END) AS id, chunk_start, chunk_end, n AS n_segments FROM (SELECT *, row_number() OVER (PARTITION BY year, day ORDER BY chunk_start, chunk_end) - 1 AS r FROM ({_MERGED}))",
    "split_by_hash": """WITH d AS (SELECT DISTINCT year, day FROM manifest), h AS (SELECT *, [strpos('0123456789abcdef', x) - 1 FOR x IN string_split(sha1(day), '')] AS digits FROM d),
b AS (SELECT *, (6 * (list_sum(digits) - digits[-1]) + digits[-1]) % 10 AS bucket FROM h)
SELECT year, day, CASE bucket WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM b""",
    "split_by_list": "SELECT year, day, CASE WHEN bool_or(split = 'test') THEN 'test' WHEN bool_or(split = 'test_b') THEN 'test_b' WHEN bool_or(split = 'dev') THEN 'dev' ELSE 'train' END AS split FROM manifest GROUP BY year, day",
    "held_out_days": "SELECT year, day FROM manifest WHERE split = 'train' INTERSECT SELECT year, day FROM manifest WHERE split <> 'train'",
    "gate": f"WITH {_GATE} SELECT * FROM gate",
    "drop_rate_by_year": f"WITH {_GATE} SELECT split_part(id, '/', 1) AS year, count(*) AS clips, count(*) FILTER (reason <> 'kept') AS dropped FROM gate GROUP BY 1",
    "untrusted_days": f"WITH {_GATE} SELECT year, day, count(*) AS clips, count(*) FILTER (reason <> 'kept') AS dropped FROM gate JOIN c USING (id) WHERE timing_source = 'site' GROUP BY year, day HAVING count(*) FILTER (reason <> 'kept') > 0 AND 5 * count(*) FILTER (reason <> 'kept') >= count(*)",
    "day_drops": f"WITH {_GATE} SELECT year, day, count(*) AS clips, count(*) FILTER (reason <> 'kept') AS dropped FROM gate JOIN c USING (id) GROUP BY year, day",
    "launch_guard": f"WITH {_GATE}, y AS (SELECT split_part(id, '/', 1) AS year, count(*) AS clips, count(*) FILTER (reason <> 'kept') AS dropped FROM gate GROUP BY 1) SELECT CAST(coalesce(sum(clips - dropped), 0) AS BIGINT) AS kept, count(*) FILTER (clips > 100 AND dropped > clips * 0.25) AS bad_years, coalesce(sum(clips - dropped), 0) >= 1000 AND count(*) FILTER (clips > 100 AND dropped > clips * 0.25) = 0 AS passes FROM y",
    "composition_by_year": f"WITH {_CLIPS} SELECT source_year, count(DISTINCT (year, day)) AS days, count(*) AS clips, CAST(sum(CAST(round(duration * 1000) AS BIGINT)) AS BIGINT) AS total_ms FROM c GROUP BY source_year",
    "split_by_timing": f"WITH {_CLIPS} SELECT split, count(*) FILTER (timing_source = 'site') AS site, count(*) FILTER (timing_source = 'local') AS local FROM c GROUP BY split",
    "anchor_rates": f"WITH {_CLIPS}, f AS (SELECT CAST(least(9, floor(anchor_rate * 10)) AS INT) AS tenth FROM c WHERE anchor_rate IS NOT NULL AND NOT isnan(anchor_rate)) SELECT CAST(b.range AS INT) AS tenth, count(f.tenth) AS clips FROM range(10) b LEFT JOIN f ON f.tenth = b.range GROUP BY b.range",
    "duration_histogram": f"WITH {_CLIPS}, m AS (SELECT CAST(round(duration * 1000) AS BIGINT) AS ms FROM c) SELECT CASE WHEN ms < 2000 THEN 0 WHEN ms < 5000 THEN 2 WHEN ms < 10000 THEN 5 WHEN ms < 15000 THEN 10 WHEN ms < 20000 THEN 15 WHEN ms < 25000 THEN 20 ELSE 25 END AS from_seconds, count(*) AS clips FROM m GROUP BY 1",
    "united_manifests": f"WITH {_CLIPS}, {_SEGMENTS}, a AS (SELECT 'manifest' AS origin, source_year, text FROM c UNION ALL SELECT 'segment', year, yiddish FROM g) SELECT origin, source_year, count(*) AS rows, CAST(sum({_WORDS}) AS BIGINT) AS words FROM a GROUP BY ALL",
}
