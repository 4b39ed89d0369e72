"""Day records, scanned days, segments and timings: joins, sets, windows and reports over them; star-schema joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import dates, numerals, text
from corpusmill.operators.alignment import aligned
from corpusmill.operators.intervals import islands, to_ms
from corpusmill.operators.relations import earliest, hash_sample, latest, shard, upsert
from corpusmill.operators.segments import chunked, cluster, cut_score, interpolated, runs
from corpusmill.plans.clips import _CLIPS, _DAYS, _SEGMENTS, _WORDS, clips, days, segments
from corpusmill.plans.intervals import _ROWS
from corpusmill.plans.measures import _BLANKS
from corpusmill.session import table
from corpusmill.sources.files import audio_names


#: How closing dedications of the test bodies begin, and words of front matter: arguments of the operators.
DEDICATIONS = ("לזכות", "לעילוי נשמת")
FRONT_WORDS = ("Table of Contents", "תוכן הענינים")


def day_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files and unresolved ones of each year."""
    return days(spark, root).groupBy("year").agg(F.count("*").alias("files"), F.count_if(F.col("civil").isNull()).alias("unresolved"))


def api_dates(spark: SparkSession, root: str) -> DataFrame:
    """Civil dates written day first, and whether the record's own form agrees."""
    own = F.date_format("civil", "dd-MM-yyyy")
    return days(spark, root).select("year", "day", own.alias("written"), (own == F.col("api_date")).alias("agrees"))


def delivery_dates(spark: SparkSession, root: str) -> DataFrame:
    """Delivered dates of all spellings as one date."""
    return days(spark, root).select("year", "day", dates.calendar_date(F.col("delivered_date")).cast("string").alias("delivered"))


def hebrew_calendar(spark: SparkSession, root: str) -> DataFrame:
    """First and last day of each Hebrew year that has records, and whether it is a leap year."""
    years = table(spark, root, "day_record").select("year").where("year is not null").distinct()
    y, one = F.col("year"), F.lit(1)
    first = numerals.civil_date(y, one, one)
    return years.select("year", first.alias("first_day"), F.date_sub(numerals.civil_date(y + 1, one, one), 1).alias("last_day"), numerals.is_leap(y).alias("leap"))


def latest_days(spark: SparkSession, root: str) -> DataFrame:
    """Days fetched more than once, and their latest fetch."""
    rows = table(spark, root, "day_record").groupBy("year", "day").agg(F.count("*").alias("n"), F.max("fetched_at").alias("fetched_at"))
    return rows.where("n > 1")


def first_path(spark: SparkSession, root: str) -> DataFrame:
    """First path of each day name, whatever the year: a lookup by name where the first hit counts."""
    return earliest(table(spark, root, "day_record").select("day", "path"), ["day"], [F.col("path")])


def fetch_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Days by timing method and match; unknown ones are named so."""
    method, match = F.coalesce("offset_method", F.lit("skipped")), F.coalesce(F.col("match").cast("string"), F.lit("unknown"))
    return days(spark, root).groupBy(method.alias("method"), match.alias("matched")).agg(F.count("*").alias("days"))


def shift_trust(spark: SparkSession, root: str) -> DataFrame:
    """Whether each day's measured shift can be trusted: five pairs and half of them agreeing, else not; unmeasured days keep theirs."""
    trust = F.when(F.col("site_shift_pairs").isNull(), "no check").when((F.col("site_shift_pairs") < 5) | (F.coalesce("site_shift_agreement", F.lit(0.0)) < 0.5), "untrusted").otherwise("trusted")
    return days(spark, root).groupBy(trust.alias("trust")).agg(F.count("*").alias("days"))


def day_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Days of each year, and those that have segments."""
    have = table(spark, root, "site_segment").select("year", "day").distinct().withColumn("have", F.lit(1))
    return days(spark, root).join(have, ["year", "day"], "left").groupBy("year").agg(F.count("*").alias("days"), F.count("have").alias("with_segments"))


def scanned_audio(spark: SparkSession, root: str) -> DataFrame:
    """Scanned days with the number of their audio files and of those that have a day record."""
    files = table(spark, root, "pdf_day").select("pdf_id", F.explode_outer("mp3").alias("path"))
    known = table(spark, root, "day_record").select("path").distinct().withColumn("known", F.lit(1))
    return files.join(known, "path", "left").groupBy("pdf_id").agg(F.count("path").alias("files"), F.count("known").alias("known"))


def scans_by_number(spark: SparkSession, root: str) -> DataFrame:
    """Scanned days joined to day records by year and leading number; of several records the greatest path."""
    scans = table(spark, root, "pdf_day").select("pdf_id", "year", "num")
    records = table(spark, root, "day_record").select("year", F.substring("day", 1, 3).alias("num"), "path").groupBy("year", "num").agg(F.max("path").alias("path"))
    return scans.join(records, ["year", "num"], "left").select("pdf_id", "path")


def scans_without_record(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of scanned days without a record, and of records without a scanned day: two anti joins."""
    scans = table(spark, root, "pdf_day").select("year", "num").distinct()
    records = table(spark, root, "day_record").select("year", F.substring("day", 1, 3).alias("num")).distinct()
    return scans.join(records, ["year", "num"], "left_anti").withColumn("only_in", F.lit("scans")).unionByName(records.join(scans, ["year", "num"], "left_anti").withColumn("only_in", F.lit("records")))


def repeated_numbers(spark: SparkSession, root: str) -> DataFrame:
    """Names of scanned days, where the second and later ones of a number get a mark."""
    nth = F.row_number().over(Window.partitionBy("year", "num").orderBy("pdf_id"))
    return table(spark, root, "pdf_day").select("pdf_id", F.when(nth == 1, F.col("num")).otherwise(F.concat("num", F.lit("_dup"), (nth - 1).cast("string"))).alias("name"))


def years_in_scans(spark: SparkSession, root: str) -> DataFrame:
    """The first year named in source or header of each scanned day."""
    first = F.coalesce(*(F.nullif(F.regexp_extract(c, r"(5\d{3})", 1), F.lit("")) for c in ("source", "header")))
    return table(spark, root, "pdf_day").select("pdf_id", first.cast("int").alias("named_year"))


def scan_words(spark: SparkSession, root: str) -> DataFrame:
    """Words of each scanned day against its stored count."""
    return table(spark, root, "pdf_day").select("pdf_id", text.hebrew_word_count(F.col("body")).alias("counted"), F.col("n_words").cast("bigint").alias("stored"))


def scan_pages(spark: SparkSession, root: str) -> DataFrame:
    """Scanned days by number of pages."""
    return table(spark, root, "pdf_day").groupBy(F.size("pages").cast("bigint").alias("pages")).agg(F.count("*").alias("days"))


def scan_html(spark: SparkSession, root: str) -> DataFrame:
    """Bodies as paragraphs of mark-up, without a closing dedication."""
    return table(spark, root, "pdf_day").select("pdf_id", text.to_html(text.without_dedication(F.col("body"), DEDICATIONS)).alias("html"))


def front_matter(spark: SparkSession, root: str) -> DataFrame:
    """Scanned bodies that read like front matter, and page-number lines in each."""
    rows = table(spark, root, "pdf_day").withColumn("numbers", F.size(F.filter(F.split("body", "\n"), lambda x: (F.trim(x) != "") & text.is_page_number(x))))
    return rows.select("pdf_id", text.is_front_matter(F.col("body"), FRONT_WORDS).alias("front"), F.col("numbers").cast("bigint").alias("numbers"))


def path_names(spark: SparkSession, root: str) -> DataFrame:
    """Base names and slugs of audio paths, with percent codes decoded."""
    base = F.element_at(F.split(F.try_url_decode("path"), "/"), -1)
    return table(spark, root, "day_record").select("path", base.alias("base"), text.slug(F.regexp_replace(base, r"\.mp3$", "")).alias("slug")).distinct()


def audio_files(spark: SparkSession, root: str) -> DataFrame:
    """What the names of recordings say: year, number, month and day, and a status instead of a failure."""
    return audio_names(table(spark, root, "day_record").select("path").distinct())


def clip_records(spark: SparkSession, root: str) -> DataFrame:
    """Clips of each recording that a day record's file has by base name: an equality join on a derived key."""
    base = lambda c: F.element_at(F.split(F.try_url_decode(c), "/"), -1)
    known = table(spark, root, "day_record").select(base("path").alias("base"), "year").distinct()
    rows = clips(spark, root).where("source_mp3 is not null").select("id", "year", base("source_mp3").alias("base"))
    return rows.join(known, ["base", "year"]).groupBy("base", "year").agg(F.count("*").alias("clips"))


def first_words(spark: SparkSession, root: str) -> DataFrame:
    """Segments and clips of a day that begin with the same four words, the earliest of each side: a derived key, first wins."""
    # The words before the fourth blank of the scoring form: one expression, no array.
    key = lambda c: F.nullif(F.regexp_extract(text.scoring_text(c), r"^(\S+ \S+ \S+ \S+)(?: |$)", 1), F.lit(""))
    site = segments(spark, root).select("year", "day", key(F.col("yiddish")).alias("key"), "s", "seg_id").where("key is not null and s is not null")
    local = clips(spark, root).select("year", "day", key(F.col("text")).alias("key"), to_ms(F.col("start")).alias("c"), "id").where("key is not null and c is not null")
    site, local = earliest(site, ["year", "day", "key"], [F.col("s"), F.col("seg_id")]), earliest(local, ["year", "day", "key"], [F.col("c"), F.col("id")])
    return site.join(local, ["year", "day", "key"]).select("seg_id", "id", (F.col("c") - F.col("s")).alias("shift_ms"))


def measured_shift(spark: SparkSession, root: str) -> DataFrame:
    """Median shift of each day, its pairs, and those within a second of the median: one join back of a small side."""
    pairs = first_words(spark, root).join(segments(spark, root).select("seg_id", "year", "day"), "seg_id")
    middle = pairs.groupBy("year", "day").agg(F.percentile("shift_ms", 0.5).alias("median_ms"))
    return pairs.join(middle, ["year", "day"]).groupBy("year", "day").agg(F.max("median_ms").alias("median_ms"), F.count("*").alias("pairs"), F.count_if(F.abs(F.col("shift_ms") - F.col("median_ms")) <= 1000).alias("agree"))


def shift_spread(spark: SparkSession, root: str) -> DataFrame:
    """Median and ninth decile of the absolute shifts."""
    return first_words(spark, root).agg(F.percentile(F.abs("shift_ms"), F.lit(0.5)).alias("median_ms"), F.percentile(F.abs("shift_ms"), F.lit(0.9)).alias("p90_ms"), F.count("*").alias("pairs"))


def speech_audit(spark: SparkSession, root: str) -> DataFrame:
    """Recordings whose words a second, covered time or words against their clips' look wrong, with all reasons."""
    words = segments(spark, root).groupBy("year", "day").agg(F.sum(text.word_count(F.col("yiddish"))).alias("words"), F.max("e").alias("last_ms"))
    spoken = islands(table(spark, root, "speech_window"), ["year", "day"]).groupBy("year", "day").agg(F.sum(F.col("period_end_ms") - F.col("period_start_ms")).alias("covered_ms"))
    said = clips(spark, root).groupBy("year", "day").agg(F.sum(text.word_count(F.col("text"))).alias("clip_words"))
    rows = words.join(spoken, ["year", "day"], "left").join(said, ["year", "day"], "left").withColumn("covered_ms", F.coalesce("covered_ms", F.lit(0))).withColumn("secs", F.greatest(F.lit(1.0), F.coalesce("last_ms", F.lit(0)) / 1000.0))
    pace, cover = F.col("words") / F.col("secs"), F.col("covered_ms") / 1000.0 / F.col("secs")
    reasons = F.array_compact(F.array(F.when(pace < 1.0, F.lit("slow")), F.when(pace > 3.5, F.lit("fast")), F.when((F.col("secs") > 120) & (cover < 0.9), F.lit("uncovered")), F.when(F.abs(F.col("words") / F.greatest(F.lit(1), F.col("clip_words")) - 1) > 0.15, F.lit("unlike clips"))))
    return rows.select("year", "day", "words", "covered_ms", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def silence_before(spark: SparkSession, root: str) -> DataFrame:
    """Time from each segment's end to the next one's start in its day."""
    order = Window.partitionBy("year", "day").orderBy("s", "seg_id")
    return segments(spark, root).where("s is not null and e is not null").select("seg_id", (F.lead("s").over(order) - F.col("e")).alias("pause_ms"))


def pause_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Clusters of segment starts of a day with steps of at most ten seconds."""
    rows = cluster(segments(spark, root).where("s is not null").select("year", "day", "seg_id", "s"), ["year", "day"], "s", 10_000, ["seg_id"])
    return rows.groupBy("year", "day", "cluster").agg(F.count("*").alias("n"), F.min("s").alias("first_ms"), F.max("s").alias("last_ms"))


def vad_runs(spark: SparkSession, root: str) -> DataFrame:
    """Lengths of runs of one detector mode in each recording."""
    rows = table(spark, root, "speech_window").where("start is not null and vad_mode is not null").select("year", "day", to_ms(F.col("start")).alias("s"), "vad_mode").distinct()
    return runs(rows, ["year", "day"], ["s", "vad_mode"], "vad_mode").groupBy("vad_mode", "n").agg(F.count("*").alias("runs"))


def event_frames(spark: SparkSession, root: str) -> DataFrame:
    """Mean square of every hundred consecutive events' values, the rest left out: tumbling frames."""
    nth = F.floor(F.col("event_id") / 100)
    rows = table(spark, root, "events").groupBy(nth.alias("frame")).agg(F.round(F.sum(F.col("value") * F.col("value")) / 100, 4).alias("mean_square"), F.count("*").alias("n"))
    return rows.where("n = 100").select("frame", "mean_square")


def interpolated_times(spark: SparkSession, root: str) -> DataFrame:
    """Start of every third segment kept; the others' placed between by their text's length."""
    order = Window.partitionBy("year", "day").orderBy("seg_no", "seg_id")
    rows = segments(spark, root).select("seg_id", "year", "day", F.row_number().over(order).alias("place"), "s", (F.length(F.coalesce("yiddish", F.lit(""))) + 1).alias("weight"))
    rows = rows.withColumn("known", F.when(F.col("place") % 3 == 1, F.col("s")))
    return interpolated(rows, ["year", "day"], "place", "known", "weight").select("seg_id", F.round("time_between", 3).alias("time_ms"))


def third_shard(spark: SparkSession, root: str) -> DataFrame:
    """Every fourth clip of a year from the third."""
    return shard(clips(spark, root).select("id", "year"), ["id"], 2, 4, ["year"]).select("id")


def even_sample(spark: SparkSession, root: str) -> DataFrame:
    """About ten evenly spaced segments of each day."""
    by = Window.partitionBy("year", "day")
    rows = segments(spark, root).select("seg_id", F.row_number().over(by.orderBy("seg_no", "seg_id")).alias("place"), F.count("*").over(by).alias("n"))
    return rows.where((F.col("place") - 1) % F.greatest(F.lit(1), F.floor(F.col("n") / 10)) == 0).select("seg_id")


def sampled_days(spark: SparkSession, root: str) -> DataFrame:
    """Twenty clips in the order of their digests."""
    return hash_sample(clips(spark, root).select("id"), "id", 20)


def updated_days(spark: SparkSession, root: str) -> DataFrame:
    """First fetches replaced by later ones where there are any: an upsert by key."""
    rows = table(spark, root, "day_record").select("year", "day", "fetched_at", "path")
    first = earliest(rows, ["year", "day"], [F.col("fetched_at"), F.col("path")])
    later = latest(rows.join(first.select("year", "day", F.col("fetched_at").alias("_f")), ["year", "day"]).where("fetched_at > _f").drop("_f"), ["year", "day"], [F.col("fetched_at"), F.col("path")])
    return upsert(first, later, ["year", "day"]).select("year", "day", "fetched_at")


def day_sets(spark: SparkSession, root: str) -> DataFrame:
    """Days of clips, segments and windows: union, intersection and differences by size."""
    a, b = (table(spark, root, t).select("year", "day") for t in ("manifest", "speech_window"))
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "only_clips": a.subtract(b), "only_windows": b.subtract(a)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def sorted_audio(spark: SparkSession, root: str) -> DataFrame:
    """Distinct audio files of clips, in order."""
    return table(spark, root, "manifest").select("audio").distinct().orderBy("audio")


def subtitles(spark: SparkSession, root: str) -> DataFrame:
    """Subtitle times of each segment."""
    rows = segments(spark, root).where("s >= 0 and e >= 0")
    return rows.select("seg_id", F.concat(text.srt_time(F.col("s") / 1000), F.lit(" --> "), text.srt_time(F.col("e") / 1000)).alias("cue"))


def event_keys(spark: SparkSession, root: str) -> DataFrame:
    """Nested values of events by key, with 0 taken as missing."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, root, "events").select("event_id", F.coalesce(F.nullif(k, F.lit(0)), F.lit(-1)).alias("k"))


def nation_revenue(spark: SparkSession, root: str) -> DataFrame:
    """Revenue by region and nation of the customer and year: small dimensions joined to the facts."""
    t = lambda n: table(spark, root, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint") * (100 - F.round(F.col("l_discount") * 100).cast("bigint"))
    return rows.groupBy("r_name", "n_name", F.year("o_orderdate").cast("bigint").alias("year")).agg(F.sum(cents).alias("revenue"), F.count("*").alias("items"))


def part_suppliers(spark: SparkSession, root: str) -> DataFrame:
    """Distinct suppliers and quantity of each brand."""
    t = lambda n: table(spark, root, n)
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("p_brand").agg(F.countDistinct("s_suppkey").alias("suppliers"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


def idle_customers(spark: SparkSession, root: str) -> DataFrame:
    """Customers of each segment without an order."""
    rows = table(spark, root, "customer").join(table(spark, root, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


def _tokens(df: DataFrame, column: str) -> DataFrame:
    return df.select("id", F.posexplode(text.words(text.scoring_text(F.col(column)))).alias("place", "norm"))


def aligned_words(spark: SparkSession, root: str) -> DataFrame:
    """Words of each clip's raw and cleaned text matched: equal words in blocks, then alike ones between them."""
    rows = clips(spark, root).where("text is not null and text_raw is not null")
    return aligned(_tokens(rows, "text"), _tokens(rows, "text_raw"), ["id"])


def cut_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of a day's words at the best ends within 28 s; a segment is a paragraph whose words share its time evenly.

    The times of every third segment count as sure, so that its end is an edge of sure times.
    """
    rows = segments(spark, root).where("s is not null and e > s")
    tokens = rows.select("year", "day", "seg_id", "seg_no", "s", "e", text.words(F.col("yiddish")).alias("w")).where("size(w) > 0")
    tokens = tokens.select("year", "day", "seg_id", "seg_no", "s", ((F.col("e") - F.col("s")) / F.size("w")).alias("each"), F.size("w").alias("n"), F.posexplode("w").alias("nth", "surface"))
    order = Window.partitionBy("year", "day").orderBy("s", "seg_id", "nth")
    start, end = (F.col("s") + F.col("each") * F.col("nth")) / 1000, (F.col("s") + F.col("each") * (F.col("nth") + 1)) / 1000
    tokens = tokens.select("year", "day", F.row_number().over(order).alias("place"), "surface", start.alias("start"), end.alias("end"), (F.col("nth") + 1 == F.col("n")).alias("last"), F.coalesce(F.col("seg_no") % 3 == 1, F.lit(False)).alias("sure"))
    pause = F.coalesce(F.lead("start").over(Window.partitionBy("year", "day").orderBy("place")) - F.col("end"), F.lit(0.0))
    score = cut_score(F.col("last"), F.col("surface").rlike(r"[.!?:]$"), F.col("surface").rlike("[,;]$"), pause, F.col("sure") & F.col("last"))
    return chunked(tokens.select("year", "day", "place", "surface", "start", "end", score.alias("score")), ["year", "day"])


QUERIES = {
    f.__name__: f
    for f in (
        day_inventory, api_dates, delivery_dates, hebrew_calendar, latest_days, first_path, fetch_outcomes, shift_trust, day_coverage, scanned_audio, scans_by_number, scans_without_record, repeated_numbers, years_in_scans,
        scan_words, scan_pages, scan_html, front_matter, path_names, audio_files, clip_records, first_words, measured_shift, shift_spread, speech_audit, silence_before, pause_clusters, vad_runs, event_frames, interpolated_times, third_shard, even_sample,
        sampled_days, updated_days, day_sets, sorted_audio, subtitles, event_keys, nation_revenue, part_suppliers, idle_customers, aligned_words, cut_chunks,
    )
}
_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '<[^>]+>', ' ', 'g'), '[\[\]]', '', 'g'), '[\x{{591}}-\x{{5c7}}]', '', 'g'), '[\x{{5be}}\x{{2013}}\x{{2014}}-]', ' ', 'g'), '[\"\x{{5f4}}\x{{201c}}\x{{201d}}''\x{{5f3}}\x{{2018}}\x{{2019}}`]', '', 'g'), '[^\x{{5d0}}-\x{{5ea}}]', ' ', 'g'), ' +', ' ', 'g'))"
_FIRST = f"""{_CLIPS}, {_SEGMENTS}, a AS (SELECT year, day, s, seg_id, [x FOR x IN string_split({_KEY.format('yiddish')}, ' ') IF x <> ''] AS w FROM g WHERE s IS NOT NULL),
b AS (SELECT year, day, CAST(round(start * 1000) AS BIGINT) AS c, id, [x FOR x IN string_split({_KEY.format('text')}, ' ') IF x <> ''] AS w FROM c WHERE start IS NOT NULL),
sa AS (SELECT year, day, array_to_string(w[1:4], ' ') AS key, s, seg_id FROM a WHERE len(w) >= 4 QUALIFY row_number() OVER (PARTITION BY year, day, key ORDER BY s, seg_id) = 1),
sb AS (SELECT year, day, array_to_string(w[1:4], ' ') AS key, c, id FROM b WHERE len(w) >= 4 QUALIFY row_number() OVER (PARTITION BY year, day, key ORDER BY c, id) = 1),
fw AS (SELECT seg_id, id, sa.year, sa.day, c - s AS shift_ms FROM sa JOIN sb ON sa.year = sb.year AND sa.day = sb.day AND sa.key = sb.key)"""
SQL = {
    "day_inventory": f"WITH {_DAYS} SELECT year, count(*) AS files, count(*) FILTER (civil IS NULL) AS unresolved FROM d GROUP BY year",
    "api_dates": f"WITH {_DAYS} SELECT year, day, strftime(civil, '%d-%m-%Y') AS written, strftime(civil, '%d-%m-%Y') = api_date AS agrees FROM d",
    "delivery_dates": f"WITH {_DAYS}, x AS (SELECT year, day, trim(delivered_date) AS v FROM d) SELECT year, day, coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%Y/%m/%d'), try_strptime(v, '%d-%m-%Y'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%d.%m.%Y'), CASE WHEN length(v) = 8 THEN try_strptime(v, '%Y%m%d') END, try_strptime(v, '%d %b %Y'), try_strptime(v, '%B %d, %Y'))::DATE::VARCHAR AS delivered FROM x",
    "latest_days": "SELECT year, day, count(*) AS n, max(fetched_at) AS fetched_at FROM day_record GROUP BY year, day HAVING count(*) > 1",
    "first_path": "SELECT day, min(path) AS path FROM day_record GROUP BY day",
    "fetch_outcomes": f"WITH {_DAYS} SELECT coalesce(offset_method, 'skipped') AS method, coalesce(match::VARCHAR, 'unknown') AS matched, count(*) AS days FROM d GROUP BY ALL",
    "shift_trust": f"WITH {_DAYS} SELECT CASE WHEN site_shift_pairs IS NULL THEN 'no check' WHEN site_shift_pairs < 5 OR coalesce(site_shift_agreement, 0.0) < 0.5 THEN 'untrusted' ELSE 'trusted' END AS trust, count(*) AS days FROM d GROUP BY ALL",
    "day_coverage": f"WITH {_DAYS}, h AS (SELECT DISTINCT year, day FROM site_segment) SELECT d.year, count(*) AS days, count(h.day) AS with_segments FROM d LEFT JOIN h ON h.year = d.year AND h.day = d.day GROUP BY d.year",
    "scanned_audio": "WITH f AS (SELECT pdf_id, unnest(CASE WHEN len(mp3) > 0 THEN mp3 ELSE [NULL] END) AS path FROM pdf_day), k AS (SELECT DISTINCT path FROM day_record) SELECT pdf_id, count(f.path) AS files, count(k.path) AS known FROM f LEFT JOIN k ON k.path = f.path GROUP BY pdf_id",
    "scans_by_number": "WITH r AS (SELECT year, substr(day, 1, 3) AS num, max(path) AS path FROM day_record GROUP BY ALL) SELECT pdf_id, path FROM pdf_day p LEFT JOIN r ON r.year = p.year AND r.num = p.num",
    "scans_without_record": "WITH s AS (SELECT DISTINCT year, num FROM pdf_day), r AS (SELECT DISTINCT year, substr(day, 1, 3) AS num FROM day_record) SELECT year, num, 'scans' AS only_in FROM (FROM s EXCEPT FROM r) UNION ALL SELECT year, num, 'records' FROM (FROM r EXCEPT FROM s)",
    "repeated_numbers": "WITH n AS (SELECT pdf_id, num, row_number() OVER (PARTITION BY year, num ORDER BY pdf_id) AS nth FROM pdf_day) SELECT pdf_id, CASE WHEN nth = 1 THEN num ELSE num || '_dup' || (nth - 1)::VARCHAR END AS name FROM n",
    "years_in_scans": r"SELECT pdf_id, coalesce(nullif(regexp_extract(source, '(5\d{3})', 1), ''), nullif(regexp_extract(header, '(5\d{3})', 1), ''))::INT AS named_year FROM pdf_day",
    "scan_words": "SELECT pdf_id, len(regexp_extract_all(body, '[א-ת]+')) AS counted, n_words::BIGINT AS stored FROM pdf_day",
    "scan_pages": "SELECT CAST(len(pages) AS BIGINT) AS pages, count(*) AS days FROM pdf_day GROUP BY 1",
    "path_names": r"WITH b AS (SELECT DISTINCT path, string_split(url_decode(path), '/')[-1] AS base FROM day_record) SELECT path, base, substr(regexp_replace(regexp_replace(regexp_replace(base, '\.mp3$', ''), '[^\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}\x{200c}\x{200d}]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 70) AS slug FROM b",
    "audio_files": r"WITH p AS (SELECT DISTINCT path, string_split(url_decode(path), '/')[-1] AS basename, nullif(regexp_extract(path, '(5[0-9]{3})', 1), '')::INT AS year FROM day_record), n AS (SELECT *, nullif(regexp_extract(basename, '^([0-9]{3})\s+([0-9]{1,2})-([A-Za-z0-9_]+)', 1), '') AS num, nullif(regexp_extract(basename, '^([0-9]{3})\s+([0-9]{1,2})-([A-Za-z0-9_]+)', 2), '')::INT AS hebrew_day, nullif(regexp_extract(basename, '^([0-9]{3})\s+([0-9]{1,2})-([A-Za-z0-9_]+)', 3), '') AS month FROM p) SELECT *, CASE WHEN year IS NULL THEN 'no year' WHEN num IS NULL THEN 'unknown name' ELSE 'ok' END AS status FROM n",
    "clip_records": f"WITH {_CLIPS}, k AS (SELECT DISTINCT string_split(url_decode(path), '/')[-1] AS base, year FROM day_record) SELECT base, k.year, count(*) AS clips FROM c JOIN k ON k.base = string_split(url_decode(source_mp3), '/')[-1] AND k.year = c.year GROUP BY ALL",
    "speech_audit": f"""{_ROWS}, l AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY year, day ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
i AS (SELECT year, day, max(e) - min(s) AS ms FROM l GROUP BY year, day, island), sp AS (SELECT year, day, sum(ms) AS covered FROM i GROUP BY year, day), {_SEGMENTS},
wd AS (SELECT year, day, CAST(sum({_WORDS.replace("coalesce(text, '')", "coalesce(yiddish, '')")}) AS BIGINT) AS words, max(e) AS last_ms FROM g GROUP BY year, day),
cw AS (SELECT year, day, sum({_WORDS}) AS clip_words FROM (SELECT DISTINCT * FROM manifest) GROUP BY year, day),
a AS (SELECT wd.year, wd.day, words, clip_words, CAST(coalesce(covered, 0) AS BIGINT) AS covered_ms, greatest(1.0, coalesce(last_ms, 0) / 1000.0) AS secs FROM wd LEFT JOIN sp ON sp.year = wd.year AND sp.day = wd.day LEFT JOIN cw ON cw.year = wd.year AND cw.day = wd.day),
q AS (SELECT year, day, words, covered_ms, concat_ws(',', CASE WHEN words / secs < 1.0 THEN 'slow' END, CASE WHEN words / secs > 3.5 THEN 'fast' END, CASE WHEN secs > 120 AND covered_ms / 1000.0 / secs < 0.9 THEN 'uncovered' END, CASE WHEN abs(words / greatest(1, clip_words) - 1) > 0.15 THEN 'unlike clips' END) AS reasons FROM a)
SELECT * FROM q WHERE reasons <> ''""",
    "interpolated_times": f"""WITH {_SEGMENTS}, o AS (SELECT seg_id, year, day, row_number() OVER (PARTITION BY year, day ORDER BY seg_no, seg_id) AS place, s, length(coalesce(yiddish, '')) + 1 AS weight FROM g),
k AS (SELECT *, CASE WHEN place % 3 = 1 THEN s END AS known, sum(weight) OVER (PARTITION BY year, day ORDER BY place) AS upto FROM o),
b AS (SELECT *, last_value(known IGNORE NULLS) OVER p AS t0, last_value(CASE WHEN known IS NOT NULL THEN upto END IGNORE NULLS) OVER p AS w0, first_value(known IGNORE NULLS) OVER n AS t1, first_value(CASE WHEN known IS NOT NULL THEN upto END IGNORE NULLS) OVER n AS w1 FROM k
  WINDOW p AS (PARTITION BY year, day ORDER BY place ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY year, day ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT seg_id, round(CASE WHEN known IS NOT NULL THEN known ELSE t0 + (t1 - t0) * ((upto - w0)::DOUBLE / nullif(w1 - w0, 0)) END, 3) AS time_ms FROM b""",
    "hebrew_calendar": """WITH y AS (SELECT DISTINCT year AS y FROM day_record WHERE year IS NOT NULL), n AS (SELECT DISTINCT y + k AS v FROM y, (SELECT unnest([-1, 0, 1, 2]) AS k) UNION SELECT unnest([5783, 5784, 5785])),
m AS (SELECT v, (235 * v - 234) // 19 AS months FROM n), d AS (SELECT v, 29 * months + (12084 + 13753 * months) // 25920 AS d FROM m), e AS (SELECT v, CASE WHEN 3 * (d + 1) % 7 < 3 THEN d + 1 ELSE d END AS e FROM d),
s AS (SELECT v, e + CASE WHEN lead(e) OVER (ORDER BY v) - e = 356 THEN 2 WHEN e - lag(e) OVER (ORDER BY v) = 382 THEN 1 ELSE 0 END AS s FROM e),
c AS (SELECT v, DATE '2023-09-16' + CAST(s - (SELECT s FROM s WHERE v = 5784) AS INT) AS first FROM s)
SELECT y AS year, a.first AS first_day, CAST(b.first - 1 AS DATE) AS last_day, (7 * y + 1) % 19 < 7 AS leap FROM y JOIN c a ON a.v = y JOIN c b ON b.v = y + 1""",
    "scan_html": f"""WITH l AS (SELECT pdf_id, string_split(body, chr(10)) AS x FROM pdf_day), k AS (SELECT *, coalesce(list_max([i FOR i IN range(1, len(x) + 1) IF x[i] = '*']), 0) AS star FROM l),
t AS (SELECT *, [v FOR v IN x[star + 1:] IF trim(v, ' ') <> ''] AS tail FROM k),
f AS (SELECT *, star > 0 AND len(tail) > 0 AND {_WORDS.replace("coalesce(text, '')", "array_to_string(tail, ' ')")} < 80 AND len([v FOR v IN tail IF {" OR ".join(f"starts_with(v, '{w}')" for w in DEDICATIONS)}]) > 0 AS cut FROM t),
h AS (SELECT pdf_id, [v FOR v IN CASE WHEN cut THEN x[1:star - 1] ELSE x END IF v IS NOT NULL AND trim(v, ' ') <> '*'] AS x FROM f)
SELECT pdf_id, coalesce(array_to_string(['<p>' || replace(replace(replace(trim(v, ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' FOR v IN x IF trim(v, ' ') <> '' AND NOT starts_with(trim(v, ' '), '*')], ''), '') AS html FROM h""",
    "front_matter": rf"""WITH l AS (SELECT pdf_id, body, [v FOR v IN string_split(body, chr(10)) IF trim(v, ' ') <> ''] AS x FROM pdf_day),
n AS (SELECT pdf_id, body, x, len([v FOR v IN x IF regexp_full_match(trim(v, ' '), '[\d\-–\s|]{{1,6}}') OR regexp_full_match(trim(v, ' '), '[א-ת]{{1,3}}["''׳״]?') OR regexp_full_match(lower(trim(v, ' ')), '(page|עמוד)?\s*\d+')]) AS numbers, len([v FOR v IN x IF regexp_matches(v, '(\.\s?){{6,}}')]) AS leaders, {_WORDS.replace("coalesce(text, '')", "body")} AS words FROM l)
SELECT pdf_id, len(x) > 0 AND (leaders >= greatest(3, len(x) * 0.3) OR (({" OR ".join(f"contains(body, '{w}')" for w in FRONT_WORDS)}) AND words < 120) OR words < 25) AS front, numbers FROM n""",
    "first_words": f"WITH {_FIRST} SELECT seg_id, id, shift_ms FROM fw",
    "measured_shift": f"WITH {_FIRST}, m AS (SELECT year, day, quantile_cont(shift_ms::DOUBLE, 0.5) AS median_ms FROM fw GROUP BY ALL) SELECT m.year, m.day, median_ms, count(*) AS pairs, count(*) FILTER (abs(shift_ms - median_ms) <= 1000) AS agree FROM fw JOIN m ON m.year = fw.year AND m.day = fw.day GROUP BY ALL",
    "shift_spread": f"WITH {_FIRST} SELECT quantile_cont(abs(shift_ms)::DOUBLE, 0.5) AS median_ms, quantile_cont(abs(shift_ms)::DOUBLE, 0.9) AS p90_ms, count(*) AS pairs FROM fw",
    "silence_before": f"WITH {_SEGMENTS} SELECT seg_id, lead(s) OVER (PARTITION BY year, day ORDER BY s, seg_id) - e AS pause_ms FROM g WHERE s IS NOT NULL AND e IS NOT NULL",
    "pause_clusters": f"WITH {_SEGMENTS}, j AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY year, day ORDER BY s, seg_id) > 10000, false)::INT AS jump FROM g WHERE s IS NOT NULL), k AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY year, day ORDER BY s, seg_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM j) SELECT year, day, cluster, count(*) AS n, min(s) AS first_ms, max(s) AS last_ms FROM k GROUP BY ALL",
    "vad_runs": "WITH w AS (SELECT DISTINCT year, day, CAST(round(start * 1000) AS BIGINT) AS s, vad_mode FROM speech_window WHERE start IS NOT NULL AND vad_mode IS NOT NULL), j AS (SELECT *, coalesce(vad_mode <> lag(vad_mode) OVER o, false)::INT AS jump FROM w WINDOW o AS (PARTITION BY year, day ORDER BY s, vad_mode)), k AS (SELECT *, sum(jump) OVER (PARTITION BY year, day ORDER BY s, vad_mode ROWS UNBOUNDED PRECEDING) AS run FROM j), l AS (SELECT year, day, run, min(vad_mode) AS vad_mode, count(*) AS n FROM k GROUP BY year, day, run) SELECT vad_mode, n, count(*) AS runs FROM l GROUP BY ALL",
    "event_frames": "SELECT event_id // 100 AS frame, round(sum(value * value) / 100, 4) AS mean_square FROM events GROUP BY 1 HAVING count(*) = 100",
    "third_shard": f"WITH {_CLIPS} SELECT id FROM c QUALIFY (row_number() OVER (PARTITION BY year ORDER BY id) - 1) % 4 = 2",
    "even_sample": f"WITH {_SEGMENTS} SELECT seg_id FROM g QUALIFY (row_number() OVER (PARTITION BY year, day ORDER BY seg_no, seg_id) - 1) % greatest(1, count(*) OVER (PARTITION BY year, day) // 10) = 0",
    "sampled_days": f"WITH {_CLIPS} SELECT id FROM c ORDER BY md5(id), id LIMIT 20",
    "updated_days": "SELECT year, day, max(fetched_at) AS fetched_at FROM day_record GROUP BY year, day",
    "day_sets": "WITH a AS (SELECT DISTINCT year, day FROM manifest), b AS (SELECT DISTINCT year, day FROM speech_window) SELECT 'union' AS part, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only_clips', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'only_windows', count(*) FROM (FROM b EXCEPT FROM a)",
    "sorted_audio": "SELECT DISTINCT audio FROM manifest",
    "subtitles": f"WITH {_SEGMENTS}, t AS (SELECT seg_id, s, e FROM g WHERE s >= 0 AND e >= 0) SELECT seg_id, format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}} --> {{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000, e // 3600000, e // 60000 % 60, e // 1000 % 60, e % 1000) AS cue FROM t",
    "cut_chunks": f"""WITH RECURSIVE {_SEGMENTS}, w AS (SELECT year, day, seg_id, seg_no, s, e, [x FOR x IN regexp_split_to_array(yiddish, '[{_BLANKS}]+') IF x <> ''] AS w FROM g WHERE s IS NOT NULL AND e > s),
x AS (SELECT *, (e - s)::DOUBLE / len(w) AS each, unnest(range(len(w))) AS nth FROM w),
o AS (SELECT year, day, row_number() OVER (PARTITION BY year, day ORDER BY s, seg_id, nth) - 1 AS place, w[nth + 1] AS surface, (s + each * nth) / 1000 AS a, (s + each * (nth + 1)) / 1000 AS b, nth + 1 = len(w) AS last, coalesce(seg_no % 3 = 1, false) AS sure FROM x),
p AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY year, day ORDER BY place) - b, 0.0) AS pause, max(b) OVER (PARTITION BY year, day ORDER BY place) AS m, count(*) OVER (PARTITION BY year, day) AS n FROM o),
k AS (SELECT *, CASE WHEN last THEN 3.0 ELSE 0.0 END + CASE WHEN regexp_matches(surface, '[.!?:]$') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(surface, '[,;]$') THEN 1.0 ELSE 0.0 END + CASE WHEN pause >= 0.3 THEN 1.0 + least(pause, 1.5) ELSE 0.0 END + CASE WHEN sure AND last THEN 0.5 ELSE 0.0 END AS score FROM p),
f AS (SELECT i.year, i.day, i.place, any_value(i.n) AS n, count(j.place) AS fits, arg_max(j.place, (j.score, j.place)) AS best FROM k i LEFT JOIN k j ON j.year = i.year AND j.day = i.day AND j.place >= i.place AND j.m <= i.a + 28.0 GROUP BY ALL),
t AS (SELECT year, day, place, CASE WHEN place + fits >= n THEN n WHEN fits <= 1 THEN place + 1 ELSE best + 1 END AS stop FROM f),
c AS (SELECT year, day, place, stop FROM t WHERE place = 0 UNION ALL SELECT t.year, t.day, t.place, t.stop FROM c JOIN t ON t.year = c.year AND t.day = c.day AND t.place = c.stop),
r AS (SELECT c.year, c.day, c.place, any_value(stop - c.place) AS n_words, min(k.a) FILTER (k.place = c.place) AS a, max(k.m) AS m, string_agg(surface, ' ' ORDER BY k.place) AS text FROM c JOIN k ON k.year = c.year AND k.day = c.day AND k.place >= c.place AND k.place < c.stop GROUP BY c.year, c.day, c.place),
q AS (SELECT *, greatest(coalesce(lag(m + 0.15) OVER (PARTITION BY year, day ORDER BY place), 0.0), a - 0.15, 0.0) AS start, m + 0.15 AS "end" FROM r)
SELECT year, day, row_number() OVER (PARTITION BY year, day ORDER BY place) - 1 AS chunk, start, "end", CAST(n_words AS BIGINT) AS n_words, text FROM q WHERE "end" - start >= 1.0""",
    "event_keys": "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.k')::INT, 0), -1) AS k FROM events",
    "nation_revenue": "SELECT r_name, n_name, year(o_orderdate) AS year, CAST(sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT)) AS BIGINT) AS revenue, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "part_suppliers": "SELECT p_brand, count(DISTINCT s_suppkey) AS suppliers, CAST(sum(trunc(l_quantity)::BIGINT) AS BIGINT) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand",
    "idle_customers": "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment",
}
