"""Tokens, transcripts and lines: queries of the operators that work on recognised or scanned text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import edits, numerals, text
from corpusmill.operators import transcripts
from corpusmill.operators.alignment import forward_matches, match_counts
from corpusmill.operators.glyphs import baseline_rows, decoded_tokens, majority, row_tokens, zero_width
from corpusmill.operators.intervals import to_ms
from corpusmill.operators.relations import shard
from corpusmill.operators.tokens import reference_tokens, token_times
from corpusmill.plans.clips import _CLIPS, _DAYS, _SCORING, _SEGMENTS, _WORDS, clips, days, segments
from corpusmill.plans.measures import _BLANKS, _vocabulary
from corpusmill.session import table

#: How the test bodies name a talk and its minutes; an argument of the operator.
MINUTES = r"(\S+) \((\d+) min"


def token_flags(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of segments with separators, glued marks and flags; a segment is a text of one paragraph."""
    rows = segments(spark, root).select("seg_id", F.lit(0).alias("paragraph"), "yiddish")
    return reference_tokens(rows, ["seg_id"], "paragraph", "yiddish").drop("paragraph")


def word_times(spark: SparkSession, root: str) -> DataFrame:
    """Times of a day's words, of which those of every third segment are known: head and tail by pace, the rest between."""
    rows = segments(spark, root).where("s is not null and e > s").select("year", "day", "seg_id", "seg_no", "s", "e", text.words(text.scoring_text(F.coalesce("yiddish", F.lit("")))).alias("w"))
    rows = rows.withColumn("each", (F.col("e") - F.col("s")) / 1000.0 / F.greatest(F.lit(1), F.size("w")))
    rows = rows.select("year", "day", "seg_id", "seg_no", "s", "each", F.posexplode("w").alias("nth", "norm"))
    place = F.row_number().over(Window.partitionBy("year", "day").orderBy("seg_no", "seg_id", "nth"))
    known = F.col("seg_no") % 3 == 1
    at = lambda k: F.when(known, F.col("s") / 1000.0 + F.col("each") * k)
    rows = rows.select("year", "day", "seg_id", "nth", place.alias("place"), (F.length("norm") + 1).alias("weight"), at(F.col("nth")).alias("known_start"), at(F.col("nth") + 1).alias("known_end"))
    out = token_times(rows, ["year", "day"], "place", "known_start", "known_end", "weight", F.lit(7.0), F.lit(600.0))
    return out.select("seg_id", "nth", to_ms(F.col("token_start")).alias("start_ms"), to_ms(F.col("token_end")).alias("end_ms"))


def _heard(spark: SparkSession, root: str) -> DataFrame:
    """Segments with scores made of their numbers, as a recogniser would give them."""
    rows = segments(spark, root)
    scores = [(-(F.col("seg_id") % 13) / 10).alias("avg_logprob"), ((F.col("seg_id") % 9) / 10).alias("no_speech_prob")]
    return rows.select("year", "day", "seg_id", "start", "end", F.coalesce("yiddish", F.lit("")).alias("text"), *scores)


def sure_texts(spark: SparkSession, root: str) -> DataFrame:
    """Segments with text whose scores are good enough."""
    return transcripts.sure_segments(_heard(spark, root)).select("seg_id")


def low_scored(spark: SparkSession, root: str) -> DataFrame:
    """Segments of each day, and those of low probability."""
    return transcripts.low_scores(_heard(spark, root), ["year", "day"])


def merged_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """Sure segments merged into clips, with the least score and the number of each."""
    rows = transcripts.merged_texts(_heard(spark, root).where("start is not null and end is not null"), ["year", "day"])
    return rows.select("year", "day", "chunk_start", "chunk_end", "min_logprob", "n")


def kept_additions(spark: SparkSession, root: str) -> DataFrame:
    """Added windows with enough words for their time and a good score, and all that aren't added."""
    rows = _heard(spark, root).select("seg_id", (F.col("seg_id") % 2 == 0).alias("added"), F.col("avg_logprob").alias("logprob"), "text", "start", "end").where("start is not null and end is not null")
    return transcripts.kept_windows(rows).select("seg_id")


def after_intro(spark: SparkSession, root: str) -> DataFrame:
    """Segments that start after their recording's intro, from its offset on."""
    offset = days(spark, root).select("year", "day", "local_offset_seconds")
    rows = segments(spark, root).join(offset, ["year", "day"])
    return transcripts.after_head(rows, F.col("local_offset_seconds"), F.lit(None).cast("double")).select("seg_id")


def slice_segments(spark: SparkSession, root: str) -> DataFrame:
    """Segments of the second minute of each recording, with their own times."""
    return transcripts.time_slice(segments(spark, root), 60.0, 60.0).select("seg_id", F.col("s").alias("start_ms"))


def chosen_detectors(spark: SparkSession, root: str) -> DataFrame:
    """The detector whose windows each recording takes."""
    rows = table(spark, root, "speech_window").where("end > start").select("year", "day", F.col("vad_mode").alias("detector"), "start", "end").distinct()
    length = rows.groupBy("year", "day").agg(F.max("end").alias("seconds"))
    chosen = transcripts.window_fallback(rows.join(length, ["year", "day"]), ["year", "day"], ["vad", "low", "energy", "fixed"])
    return chosen.groupBy("year", "day", "detector").agg(F.count("*").alias("windows"))


def silences(spark: SparkSession, root: str) -> DataFrame:
    """Windows of at least 0.4 s, and the milliseconds since the one before ended, summed up by recording."""
    rows = table(spark, root, "speech_window").where("start is not null and end is not null").select("year", "day", "start", "end").distinct()
    out = transcripts.with_intervals_before(rows, ["year", "day"])
    return out.groupBy("year", "day").agg(F.count("*").alias("windows"), F.round(F.sum("silence"), 3).alias("silence"))


def line_phases(spark: SparkSession, root: str) -> DataFrame:
    """Lines of scanned bodies by phase: a line with digits begins a header, one with a full stop a body."""
    lines = table(spark, root, "pdf_day").select("pdf_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    trigger = F.when(F.col("line").rlike(r"\d"), "header").when(F.col("line").rlike(r"\.\s*$"), "body")
    out = transcripts.phases(lines, ["pdf_id"], "line_no", trigger)
    return out.groupBy("pdf_id", "phase").agg(F.count("*").alias("lines"))


def clean_lines(spark: SparkSession, root: str) -> DataFrame:
    """Cleaned lines of scanned bodies."""
    lines = table(spark, root, "pdf_day").select("pdf_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    return lines.select("pdf_id", "line_no", text.clean_line(F.col("line")).alias("line"))


def page_minutes(spark: SparkSession, root: str) -> DataFrame:
    """Talks and their minutes that documents name."""
    rows = table(spark, root, "documents").select("doc_id", F.explode(transcripts.synopses(F.col("text"), MINUTES)).alias("s"))
    return rows.select("doc_id", "s.label", "s.minutes").distinct()


def abbreviations(spark: SparkSession, root: str) -> DataFrame:
    """Scoring forms of the words of clips that hold a double quote or gershayim."""
    return clips(spark, root).select(F.explode(text.quoted_abbreviations(F.coalesce("text", F.lit("")))).alias("word")).distinct()


def upright_texts(spark: SparkSession, root: str) -> DataFrame:
    """Headers with brackets mirrored and digit runs reversed."""
    return table(spark, root, "pdf_day").where("header is not null").select("pdf_id", text.upright(F.col("header")).alias("header"))


def letters_apart(spark: SparkSession, root: str) -> DataFrame:
    """Edits between raw and clean text of each clip in scoring form, with blanks and without."""
    rows = clips(spark, root).select("id", *(text.scoring_text(F.coalesce(c, F.lit(""))).alias(c) for c in ("text", "text_raw")))
    return rows.select("id", edits.char_edits(F.col("text"), F.col("text_raw")).alias("edits"), edits.char_edits(F.col("text"), F.col("text_raw"), blanks=False).alias("letters"))


def letter_years(spark: SparkSession, root: str) -> DataFrame:
    """Years that letter numbers of clips name: the first word with gershayim before its last letter."""
    number = F.regexp_extract("text", "([א-ת]{1,4}[\"״][א-ת])", 1)
    return clips(spark, root).where("text is not null").select("id", numerals.source_year(number).alias("year")).where("year is not null")


def hidden_names(spark: SparkSession, root: str) -> DataFrame:
    """Audio paths with their root hidden, as they are published, and without the fields that stay private."""
    return clips(spark, root).drop("hebrew", "english", "text_raw").select("id", text.redacted(F.col("audio"), {"/": "|", ".wav": ""}).alias("audio"))


def letter_votes(spark: SparkSession, root: str) -> DataFrame:
    """Letters that rare words have in place of one letter of frequent words, by majority: (wrong, right)."""
    words = _vocabulary(spark, root)
    rare, known = words.where("n = 1").select("word"), words.where("n >= 20").select("word")
    votes = transcripts.one_letter_off(rare, known).select(F.expr("substring(word, place, 1)").alias("code"), F.col("right").alias("letter"))
    return majority(votes, 2, 0.05)


def near_words(spark: SparkSession, root: str) -> DataFrame:
    """Words seen once, with the frequent words one letter off and each one's share of the vote."""
    words = _vocabulary(spark, root)
    rare, known = words.where("n = 1").select("word"), words.where("n >= 20").select("word")
    return transcripts.one_letter_off(rare, known).groupBy("word", "place").agg(F.count("*").alias("n"), F.round(F.sum("votes"), 6).alias("votes"))


def year_shards(spark: SparkSession, root: str) -> DataFrame:
    """Every fifth clip of the whole manifest from the second, in order of its id."""
    return shard(clips(spark, root).select("id").distinct(), ["id"], 1, 5).select("id")


def provenance(spark: SparkSession, root: str) -> DataFrame:
    """Scanned days by how their text came about: what is declared, else a known font, else text."""
    rows = table(spark, root, "pdf_day")
    fonts = rows.where("source is not null").select("year").distinct().withColumn("font", F.lit(True))
    label = F.coalesce(F.nullif(F.trim("num_source"), F.lit("")), F.when(F.col("font"), F.lit("font map")), F.lit("text"))
    return rows.join(fonts, "year", "left").groupBy(label.alias("origin")).agg(F.count("*").alias("days"))


def size_matches(spark: SparkSession, root: str) -> DataFrame:
    """Whether a day's clips fill its recording by size, within a second and half a percent: else it needs a search."""
    spoken = clips(spark, root).where("start is not null and end is not null").groupBy("year", "day").agg(F.max("end").alias("last"), F.sum("duration").alias("total"))
    seconds = table(spark, root, "speech_window").where("end is not null and not isnan(end)").groupBy("year", "day").agg(F.max("end").alias("seconds"))
    rows = spoken.join(seconds, ["year", "day"])
    apart = F.abs(F.col("last") - F.col("seconds"))
    method = F.when(apart < 1.0, "size").when(apart < 2.0, "lag within 2 s").otherwise("search")
    return rows.select("year", "day", method.alias("method"))


def selected_days(spark: SparkSession, root: str, **chosen) -> DataFrame:
    """Days without a usable site timing that have no local one yet: the chain of optional conditions."""
    return days_chosen(days(spark, root), missing_only=True, force=False, **chosen).select("year", "day")


def days_chosen(records: DataFrame, names: list[str] | None = None, years: list[int] | None = None, months: list[str] | None = None, missing_only: bool = False, site_timed: bool = False, force: bool = True) -> DataFrame:
    """Day records that meet all conditions given; each is a filter that reaches the scan.

    Missing only: no trusted site shift. Site timed: a site shift. Without ``force`` days that have a local offset are left
    out, unless days are named.
    """
    rows = records
    if names:
        rows = rows.where(F.col("day").isin(*names))
    if years:
        rows = rows.where(F.col("year").isin(*years))
    if months:
        rows = rows.where(F.col("month_dir").isin(*months))
    if missing_only:
        rows = rows.where(F.col("site_shift_seconds").isNull() | F.coalesce("sync_untrusted", F.lit(False)))
    if site_timed:
        rows = rows.where(F.col("site_shift_seconds").isNotNull())
    if not force and not names:
        rows = rows.where(F.col("local_offset_seconds").isNull())
    return rows


def anchored_clips(spark: SparkSession, root: str) -> DataFrame:
    """Clips whose anchor rate is at least 0.3, a missing one counting as 1; local ones need a text at both ends too."""
    rate = F.coalesce(F.nanvl("anchor_rate", F.lit(1.0)), F.lit(1.0))
    ends = (F.col("timing_source") != "local") | (F.trim(F.coalesce("text", F.lit(""))) != "")
    return clips(spark, root).where((rate >= 0.3) & F.coalesce(ends, F.lit(False))).select("id")


def merged_anchor_rates(spark: SparkSession, root: str) -> DataFrame:
    """Anchor rate of each day, weighed by words; a missing rate counts as 1."""
    rows = clips(spark, root).select("year", "day", text.word_count(F.col("text")).alias("n"), F.coalesce(F.nanvl("anchor_rate", F.lit(1.0)), F.lit(1.0)).alias("r"))
    return rows.groupBy("year", "day").agg(F.round(F.sum(F.round(F.col("r") * 1_000_000).cast("bigint") * F.col("n")) / F.greatest(F.lit(1), F.sum("n"))).cast("bigint").alias("rate_millionths"), F.sum("n").alias("words"))


def alignment_counts(spark: SparkSession, root: str) -> DataFrame:
    """Reference and raw words of each clip, and how many were matched exactly or nearly."""
    rows = clips(spark, root).where("text is not null and text_raw is not null")
    rows = rows.select("id", *(text.words(text.scoring_text(F.col(c))).alias(n) for n, c in (("ref", "text"), ("hyp", "text_raw"))))
    return match_counts(rows, ["id"], "ref", "hyp")


def found_segments(spark: SparkSession, root: str) -> DataFrame:
    """Segments whose words stand in order in their day's clips: each is sought after the one before."""
    heard = clips(spark, root).where("text is not null").select("year", "day", "id", F.posexplode(text.words(text.scoring_text(F.col("text")))).alias("nth", "norm"))
    tokens = heard.select("year", "day", F.row_number().over(Window.partitionBy("year", "day").orderBy("id", "nth")).alias("place"), "norm")
    said = segments(spark, root).where("seg_no is not null").select("year", "day", F.row_number().over(Window.partitionBy("year", "day").orderBy("seg_no", "seg_id")).alias("place"), text.words(text.scoring_text(F.coalesce("yiddish", F.lit("")))).alias("words"))
    return forward_matches(tokens, said, ["year", "day"])


def _glyphs(spark: SparkSession, root: str) -> DataFrame:
    """Bodies as placed glyphs, from right to left, a font for each year; quote marks have no width and take no place."""
    lines = table(spark, root, "pdf_day").select("pdf_id", F.col("year").cast("string").alias("font"), F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    chars = lines.select("pdf_id", "font", "line_no", "line", F.posexplode(F.split("line", "")).alias("i", "code")).where("code <> ''")
    chars = chars.withColumn("before", F.length(F.translate(F.substring(F.col("line"), F.lit(1), F.col("i")), '"״', "")))
    mark = F.col("code").isin('"', "״")
    right = 10_000.0 - 5.0 * F.col("before") + F.when(mark, 0.5).otherwise(0.0)
    left = F.when(mark, right).otherwise(right - 4.0)
    return chars.select("pdf_id", "font", (F.col("line_no") * 10.0 + (F.col("i") % 3) * 0.4).alias("y"), left.alias("x0"), right.alias("x1"), "code")


def glyph_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of bodies put together again from their glyphs, by row."""
    rows = row_tokens(baseline_rows(_glyphs(spark, root), ["pdf_id"]), ["pdf_id"])
    return rows.select("pdf_id", "row", "token", F.array_join("codes", "").alias("text"))


def decoded_glyphs(spark: SparkSession, root: str) -> DataFrame:
    """Words of bodies out of codes that stand for their letters, a map a font: codes without a letter stay."""
    shift = {x: chr(0x2460 + i) for i, x in enumerate("אבגדהוזחטיךכלםמןנסעףפץצקרשת")}
    coded = _glyphs(spark, root).withColumn("code", F.translate("code", "".join(shift), "".join(shift.values())))
    font_map = coded.select("font", "code").distinct().where(F.col("code").between(chr(0x2460), chr(0x247A))).withColumn("letter", F.translate("code", "".join(shift.values()), "".join(shift)))
    tokens = decoded_tokens(row_tokens(baseline_rows(coded, ["pdf_id"]), ["pdf_id"]), font_map)
    return tokens.groupBy("text").agg(F.count("*").alias("n"))


def mark_codes(spark: SparkSession, root: str) -> DataFrame:
    """Codes of each font that are marks by their width."""
    return zero_width(_glyphs(spark, root))


QUERIES = {
    f.__name__: f
    for f in (
        token_flags, word_times, sure_texts, low_scored, merged_transcripts, kept_additions, after_intro, slice_segments, chosen_detectors, silences, line_phases, clean_lines, page_minutes, abbreviations,
        upright_texts, letters_apart, letter_years, hidden_names, letter_votes, near_words, year_shards, provenance, size_matches, selected_days, anchored_clips, merged_anchor_rates, alignment_counts, found_segments, glyph_tokens, decoded_glyphs, mark_codes,
    )
}
_RAW = _SCORING.replace("coalesce(text, '')", "coalesce(text_raw, '')")
_ASCII = "'אבגדהוזחטיךכלםמןנסעףפץצקרשת', 'abcdefghijklmnopqrstuvwyzAB'"
_HEARD = f"{_SEGMENTS}, hd AS (SELECT year, day, seg_id, start, \"end\", s, e, coalesce(yiddish, '') AS text, -(seg_id % 13) / 10 AS lp, (seg_id % 9) / 10 AS ns FROM g)"
_NORM = _SCORING.replace("coalesce(text, '')", "surface")
_VOC = f"WITH {_CLIPS}, w AS (SELECT unnest([x FOR x IN string_split({_SCORING}, ' ') IF x <> '']) AS word FROM c WHERE text IS NOT NULL), v AS (SELECT word, count(*) AS n FROM w GROUP BY word)"
_HOLES = _VOC + """, a AS (SELECT word, unnest(range(1, length(word) + 1)) AS place FROM v WHERE n = 1), b AS (SELECT word AS fixed, unnest(range(1, length(word) + 1)) AS place FROM v WHERE n >= 20),
m AS (SELECT a.word, a.place, b.fixed FROM (SELECT *, substr(word, 1, place - 1) || '*' || substr(word, place + 1) AS hole FROM a) a JOIN (SELECT *, substr(fixed, 1, place - 1) || '*' || substr(fixed, place + 1) AS hole FROM b) b ON a.hole = b.hole AND a.place = b.place AND a.word <> b.fixed)"""
_ROWS_OF = """l AS (SELECT pdf_id, year, unnest(range(len(x))) AS i, x FROM (SELECT pdf_id, year, string_split(body, chr(10)) AS x FROM pdf_day)), r AS (SELECT pdf_id, year, x[i + 1] AS line, row_number() OVER (PARTITION BY pdf_id ORDER BY i) - 1 AS row FROM l WHERE length(x[i + 1]) > 0),
w AS (SELECT pdf_id, year, row, [v FOR v IN string_split(line, ' ') IF v <> ''] AS ws FROM r), k AS (SELECT pdf_id, year, row, unnest(range(len(ws))) AS token, ws FROM w)"""
SQL = {
    "glyph_tokens": f"WITH {_ROWS_OF} SELECT pdf_id, row, CAST(token AS INT) AS token, ws[token + 1] AS text FROM k",
    "decoded_glyphs": f"WITH {_ROWS_OF} SELECT ws[token + 1] AS text, count(*) AS n FROM k GROUP BY 1",
    "mark_codes": """WITH c AS (SELECT year::VARCHAR AS font, unnest(string_split(replace(body, chr(10), ''), '')) AS code FROM pdf_day) SELECT DISTINCT font, code FROM c WHERE code IN ('"', '״')""",
    "token_flags": rf"""WITH {_SEGMENTS}, w AS (SELECT seg_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT seg_id, [x FOR x IN regexp_split_to_array(yiddish, '[{_BLANKS}]+') IF x <> ''] AS ws FROM g WHERE yiddish IS NOT NULL)),
p AS (SELECT seg_id, i, unnest(range(1, len(ps) + 1)) AS k, ps FROM (SELECT seg_id, i, regexp_extract_all(ws[i], '[־–—-]*[^־–—-]+') AS ps FROM w)),
q AS (SELECT seg_id, i, k, regexp_extract(ps[k], '([־–—-]?)[^־–—-]+$', 1) AS h, regexp_extract(ps[k], '[^־–—-]+$') AS surface FROM p),
n AS (SELECT seg_id, i, k, CASE WHEN h = '' THEN ' ' ELSE h END AS sep, surface, replace({_NORM}, ' ', '') AS norm FROM q),
c AS (SELECT *, sum((norm <> '')::INT) OVER (PARTITION BY seg_id ORDER BY i, k ROWS UNBOUNDED PRECEDING) AS number FROM n),
t AS (SELECT seg_id, CAST(number - 1 AS BIGINT) AS token, string_agg(surface, '' ORDER BY i, k) AS surface, max(sep) FILTER (norm <> '') AS sep, max(norm) AS norm, max(right(surface, 1)) FILTER (norm <> '') AS z FROM c WHERE number > 0 GROUP BY seg_id, number)
SELECT seg_id, token, surface, sep, norm, z IN ('.', '?', '!', ':') AS sentence_end, z IN (',', ';') AS comma, token = max(token) OVER (PARTITION BY seg_id) AS paragraph_end FROM t""",
    "word_times": rf"""WITH {_SEGMENTS}, w AS (SELECT year, day, seg_id, seg_no, s, e, [x FOR x IN string_split({_SCORING.replace("coalesce(text, '')", "coalesce(yiddish, '')")}, ' ') IF x <> ''] AS w FROM g WHERE s IS NOT NULL AND e > s),
x AS (SELECT *, unnest(range(len(w))) AS nth FROM w), o AS (SELECT *, row_number() OVER (PARTITION BY year, day ORDER BY seg_no, seg_id, nth) AS place, seg_no % 3 = 1 AS known, s / 1000.0 + (e - s) / 1000.0 / len(w) * nth AS ks, s / 1000.0 + (e - s) / 1000.0 / len(w) * (nth + 1) AS ke, length(w[nth + 1]) + 1 AS weight FROM x),
u AS (SELECT *, coalesce(known, false) AS kn, sum(CASE WHEN known THEN 0 ELSE weight END) OVER (PARTITION BY year, day ORDER BY place) AS upto, count(*) OVER (PARTITION BY year, day) AS n_all FROM o),
z AS (SELECT *, last_value(CASE WHEN kn THEN ke END IGNORE NULLS) OVER p AS e0, last_value(CASE WHEN kn THEN upto END IGNORE NULLS) OVER p AS w0, last_value(CASE WHEN kn THEN place END IGNORE NULLS) OVER p AS i0,
  first_value(CASE WHEN kn THEN ks END IGNORE NULLS) OVER f AS s1, first_value(CASE WHEN kn THEN upto END IGNORE NULLS) OVER f AS w1, first_value(CASE WHEN kn THEN place END IGNORE NULLS) OVER f AS i1 FROM u
  WINDOW p AS (PARTITION BY year, day ORDER BY place ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY year, day ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
r AS (SELECT *, greatest(7.0, s1 - (i1 - 1) / 2.8) AS h0, least(600.0, e0 + (n_all - i0) / 2.8) AS t1, greatest(0.0, s1 - e0) AS span FROM z),
tm AS (SELECT seg_id, nth, CASE WHEN kn THEN ks WHEN i0 IS NULL AND i1 IS NULL THEN NULL WHEN i0 IS NULL THEN h0 + (s1 - h0) * (place - 1) / (i1 - 1) WHEN i1 IS NULL THEN e0 + (t1 - e0) * (place - i0 - 1) / (n_all - i0) ELSE e0 + span * (upto - weight - w0) / (w1 - w0) END AS a,
  CASE WHEN kn THEN ke WHEN i0 IS NULL AND i1 IS NULL THEN NULL WHEN i0 IS NULL THEN h0 + (s1 - h0) * place / (i1 - 1) WHEN i1 IS NULL THEN e0 + (t1 - e0) * (place - i0) / (n_all - i0) ELSE e0 + span * (upto - w0) / (w1 - w0) END AS b FROM r)
SELECT seg_id, CAST(nth AS INT) AS nth, CAST(round(a * 1000) AS BIGINT) AS start_ms, CAST(round(b * 1000) AS BIGINT) AS end_ms FROM tm""",
    "sure_texts": f"WITH {_HEARD} SELECT seg_id FROM hd WHERE lp >= -0.6 AND ns <= 0.5 AND trim(text, ' ') <> ''",
    "low_scored": f"WITH {_HEARD} SELECT year, day, count(*) AS segments, count(*) FILTER (lp < -1.0) AS low FROM hd GROUP BY year, day",
    "merged_transcripts": f"""WITH RECURSIVE {_HEARD}, o AS (SELECT *, row_number() OVER (PARTITION BY year, day ORDER BY s, e, text) AS r FROM hd WHERE lp >= -0.6 AND ns <= 0.5 AND trim(text, ' ') <> '' AND e > s),
m AS (SELECT year, day, r, s AS cs, e AS ce, 1 AS chunk, lp FROM o WHERE r = 1 UNION ALL SELECT o.year, o.day, o.r, CASE WHEN o.e - cs <= 28000 AND o.s - ce < 1500 THEN cs ELSE o.s END, o.e, CASE WHEN o.e - cs <= 28000 AND o.s - ce < 1500 THEN chunk ELSE chunk + 1 END, o.lp FROM m JOIN o ON o.year = m.year AND o.day = m.day AND o.r = m.r + 1)
SELECT year, day, min(cs) AS chunk_start, arg_max(ce, r) AS chunk_end, min(lp) AS min_logprob, count(*) AS n FROM m GROUP BY year, day, chunk""",
    "kept_additions": f"WITH {_HEARD} SELECT seg_id FROM hd WHERE start IS NOT NULL AND \"end\" IS NOT NULL AND NOT (seg_id % 2 = 0 AND (lp < -0.35 OR {_WORDS} / greatest(0.001, \"end\" - start) < 1.0))",
    "after_intro": f"WITH {_DAYS}, {_SEGMENTS} SELECT seg_id FROM g JOIN d ON d.year = g.year AND d.day = g.day WHERE start >= coalesce(local_offset_seconds, 0) + 7.0",
    "slice_segments": f"WITH {_SEGMENTS} SELECT seg_id, s AS start_ms FROM g WHERE \"end\" > 60 AND start < 120",
    "chosen_detectors": """WITH w AS (SELECT DISTINCT year, day, vad_mode AS detector, start AS a, "end" AS b FROM speech_window WHERE "end" > start), l AS (SELECT year, day, max(b) AS seconds FROM w GROUP BY ALL),
r AS (SELECT w.*, seconds, list_position(['vad', 'low', 'energy', 'fixed'], detector) AS rk FROM w JOIN l ON l.year = w.year AND l.day = w.day WHERE detector IN ('vad', 'low', 'energy', 'fixed')),
c AS (SELECT year, day, rk, sum(b - a) / max(seconds) AS cover, max(seconds) AS seconds FROM r GROUP BY ALL), k AS (SELECT year, day, coalesce(min(rk) FILTER (cover >= 0.3 OR seconds < 120 OR rk = 4), max(rk)) AS rk FROM c GROUP BY ALL)
SELECT r.year, r.day, detector, count(*) AS windows FROM r JOIN k ON k.year = r.year AND k.day = r.day AND k.rk = r.rk GROUP BY ALL""",
    "silences": 'WITH w AS (SELECT DISTINCT year, day, start AS a, "end" AS b FROM speech_window WHERE start IS NOT NULL AND "end" IS NOT NULL), x AS (SELECT year, day, a - lag(b) OVER (PARTITION BY year, day ORDER BY a, b) AS silence FROM w WHERE b - a >= 0.4) SELECT year, day, count(*) AS windows, round(sum(silence), 3) AS silence FROM x GROUP BY year, day',
    "line_phases": r"""WITH l AS (SELECT pdf_id, unnest(range(len(x))) AS i, x FROM (SELECT pdf_id, string_split(body, chr(10)) AS x FROM pdf_day)),
t AS (SELECT pdf_id, last_value(CASE WHEN regexp_matches(x[i + 1], '[0-9]') THEN 'header' WHEN regexp_matches(x[i + 1], '\.[ \t]*$') THEN 'body' END IGNORE NULLS) OVER (PARTITION BY pdf_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS phase FROM l) SELECT pdf_id, phase, count(*) AS lines FROM t GROUP BY ALL""",
    "clean_lines": rf"""WITH l AS (SELECT pdf_id, unnest(range(len(x))) AS i, x FROM (SELECT pdf_id, string_split(body, chr(10)) AS x FROM pdf_day)),
c AS (SELECT pdf_id, i, trim(regexp_replace(regexp_replace(regexp_replace(x[i + 1], '(^|[^0-9\p{{L}}_])0{{3,}}($|[^0-9\p{{L}}_])', '\1 \2', 'g'), '[\x{{ad}}\x{{200e}}\x{{200f}}]', '', 'g'), '[{_BLANKS}]+', ' ', 'g'), ' ') AS line FROM l)
SELECT pdf_id, CAST(i AS INT) AS line_no, regexp_replace(line, '([^ ]) ([.,;:!?])([^ ]*[א-ת])', '\1\2 \3', 'g') AS line FROM c""",
    "letter_years": f"""WITH {_CLIPS}, x AS (SELECT id, regexp_replace(regexp_replace(regexp_extract(text, '([א-ת]{{1,4}}["״][א-ת])', 1), '["''׳״]', '', 'g'), '^תש', '') AS w FROM c WHERE text IS NOT NULL),
y AS (SELECT id, coalesce(list_sum([CASE WHEN v <= 10 THEN v WHEN v <= 19 THEN (v - 9) * 10 ELSE (v - 18) * 100 END FOR v IN [strpos('אבגדהוזחטיכלמנסעפצקרשת', z) FOR z IN [q FOR q IN string_split(w, '') IF q <> '']] IF v > 0]), 0) AS n FROM x) SELECT id, CAST(n + 5700 AS INT) AS year FROM y WHERE n BETWEEN 1 AND 99""",
    "abbreviations": f"WITH {_CLIPS}, w AS (SELECT unnest([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[{_BLANKS}]+') IF regexp_matches(x, '[\"״]')]) AS surface FROM c) SELECT DISTINCT {_NORM} AS word FROM w",
    "page_minutes": r"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\s]+ \([0-9]+ min')) AS x FROM documents) SELECT DISTINCT doc_id, regexp_extract(x, '^([^\s]+) ', 1) AS label, regexp_extract(x, '\(([0-9]+) min', 1) AS minutes FROM m",
    "upright_texts": "WITH p AS (SELECT pdf_id, regexp_extract_all(translate(header, '()[]{}<>', ')(][}{><'), '[0-9]+|[^0-9]+') AS x FROM pdf_day WHERE header IS NOT NULL) SELECT pdf_id, coalesce(array_to_string([CASE WHEN regexp_matches(v, '^[0-9]') THEN reverse(v) ELSE v END FOR v IN x], ''), '') AS header FROM p",
    "letters_apart": f"WITH {_CLIPS}, x AS (SELECT id, translate({_SCORING}, {_ASCII}) AS a, translate({_RAW}, {_ASCII}) AS b FROM c) SELECT id, CAST(levenshtein(a, b) AS BIGINT) AS edits, CAST(levenshtein(replace(a, ' ', ''), replace(b, ' ', '')) AS BIGINT) AS letters FROM x",
    "hidden_names": f"WITH {_CLIPS} SELECT id, replace(replace(audio, '/', '|'), '.wav', '') AS audio FROM c",
    "near_words": _HOLES + ", k AS (SELECT word, place, count(*) AS n FROM m GROUP BY ALL) SELECT word, place, n, 1.0::DOUBLE AS votes FROM k",
    "letter_votes": _HOLES + """, x AS (SELECT substr(word, place, 1) AS code, substr(fixed, place, 1) AS letter FROM m), k AS (SELECT code, letter, count(*) AS n FROM x GROUP BY ALL),
bt AS (SELECT code, max((n, letter)) AS best, sum(n) AS total FROM k GROUP BY code), s AS (SELECT code, best[2] AS letter, best[1] AS n FROM bt WHERE best[1] >= 2 AND best[1] >= 0.05 * total) SELECT max((n, code))[2] AS code, letter FROM s GROUP BY letter""",
    "year_shards": f"WITH {_CLIPS}, i AS (SELECT DISTINCT id FROM c) SELECT id FROM i QUALIFY (row_number() OVER (ORDER BY id) - 1) % 5 = 1",
    "provenance": "WITH f AS (SELECT DISTINCT year FROM pdf_day WHERE source IS NOT NULL) SELECT coalesce(nullif(trim(num_source, ' '), ''), CASE WHEN f.year IS NOT NULL THEN 'font map' END, 'text') AS origin, count(*) AS days FROM pdf_day p LEFT JOIN f ON f.year = p.year GROUP BY 1",
    "size_matches": f"""WITH {_CLIPS}, a AS (SELECT year, day, max("end") AS last FROM c WHERE start IS NOT NULL AND "end" IS NOT NULL GROUP BY ALL), b AS (SELECT year, day, max("end") AS seconds FROM speech_window WHERE "end" IS NOT NULL AND NOT isnan("end") GROUP BY ALL)
SELECT a.year, a.day, CASE WHEN abs(last - seconds) < 1 THEN 'size' WHEN abs(last - seconds) < 2 THEN 'lag within 2 s' ELSE 'search' END AS method FROM a JOIN b ON b.year = a.year AND b.day = a.day""",
    "selected_days": f"WITH {_DAYS} SELECT year, day FROM d WHERE (site_shift_seconds IS NULL OR coalesce(sync_untrusted, false)) AND local_offset_seconds IS NULL",
    "anchored_clips": f"WITH {_CLIPS} SELECT id FROM c WHERE coalesce(CASE WHEN isnan(anchor_rate) THEN 1 ELSE anchor_rate END, 1) >= 0.3 AND coalesce(timing_source <> 'local' OR trim(coalesce(text, ''), ' ') <> '', false)",
    "merged_anchor_rates": f"WITH {_CLIPS}, r AS (SELECT year, day, {_WORDS} AS n, coalesce(CASE WHEN isnan(anchor_rate) THEN 1 ELSE anchor_rate END, 1) AS r FROM c) SELECT year, day, CAST(round(sum(CAST(round(r * 1000000) AS BIGINT) * n) / greatest(1, sum(n))) AS BIGINT) AS rate_millionths, CAST(sum(n) AS BIGINT) AS words FROM r GROUP BY year, day",
}
