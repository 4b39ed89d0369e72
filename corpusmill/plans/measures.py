"""Error rates, vocabulary, text measures and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import edits, text
from corpusmill.operators.intervals import to_ms
from corpusmill.operators.relations import both_ways, share_of_total
from corpusmill.plans.clips import _SCORED, _SCORING, _WHOLE_DAY, clips, scored
from corpusmill.session import table


def corpus_wer(spark: SparkSession, root: str) -> DataFrame:
    """Edits and reference words of each split: the rate is over all words, not a mean of rates."""
    return scored(spark, root).groupBy("split").agg(F.sum("edits").alias("edits"), F.sum("n_ref").alias("n_ref"))


def pair_wer(spark: SparkSession, root: str) -> DataFrame:
    """Edits and reference words of each clip."""
    return scored(spark, root).select("id", "edits", "n_ref")


def day_wer(spark: SparkSession, root: str) -> DataFrame:
    """Edits, words and rate of each day."""
    return scored(spark, root).groupBy("year", "day").agg(F.sum("edits").alias("edits"), F.sum("n_ref").alias("n_ref")).withColumn("wer", edits.rate(F.col("edits"), F.col("n_ref")))


def whole_day_wer(spark: SparkSession, root: str) -> DataFrame:
    """Scoring of whole days: each day's references and hypotheses are joined in clip order first."""
    rows = scored(spark, root).withColumn("part", F.struct("id", F.col("ref_words").alias("r"), F.col("hyp_words").alias("h")))
    joined = rows.groupBy("year", "day").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    joined = joined.select("year", "day", F.flatten("parts.r").alias("r"), F.flatten("parts.h").alias("h"))
    return joined.select("year", "day", F.size("r").cast("bigint").alias("ref_words"), F.size("h").cast("bigint").alias("hyp_words"), edits.long_edits(F.col("r"), F.col("h")).alias("edits"))


def worst_clips(spark: SparkSession, root: str) -> DataFrame:
    """The ten clips with the highest rate."""
    rows = scored(spark, root).withColumn("wer", edits.rate(F.col("edits"), F.col("n_ref")))
    return rows.orderBy(F.desc("wer"), F.desc("n_ref"), "id").select("id", "edits", "n_ref").limit(10)


def running_wer(spark: SparkSession, root: str) -> DataFrame:
    """Edits and words so far, clip by clip within a split and year."""
    so_far = Window.partitionBy("split", "year").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return scored(spark, root).select("id", F.sum("edits").over(so_far).alias("edits"), F.sum("n_ref").over(so_far).alias("n_ref"))


def scored_without_empty(spark: SparkSession, root: str) -> DataFrame:
    """Rate of each split over clips with a reference; 1 where there is none."""
    rows = scored(spark, root).groupBy("split").agg(F.sum(F.when(F.col("n_ref") > 0, F.col("edits"))).alias("edits"), F.sum("n_ref").alias("n_ref"))
    return rows.select("split", F.coalesce(F.col("edits") / F.nullif("n_ref", F.lit(0)), F.lit(1.0)).alias("wer"))


def _operations(spark: SparkSession, root: str) -> DataFrame:
    rows = scored(spark, root).select("id", "split", "year", "day", edits.word_alignment(F.array_join("ref_words", " "), F.array_join("hyp_words", " ")).alias("ops"))
    return rows.select("id", "split", "year", "day", F.posexplode("ops").alias("place", "o")).select("id", "split", "year", "day", "place", "o.op", "o.ref", "o.hyp")


def pair_operations(spark: SparkSession, root: str) -> DataFrame:
    """Replaced, deleted and inserted words of each clip."""
    count = lambda op: F.count_if(F.col("op") == op)
    return _operations(spark, root).groupBy("id").agg(count("replace").alias("replaced"), count("delete").alias("deleted"), count("insert").alias("inserted"), F.count("ref").alias("n_ref"))


def error_breakdown(spark: SparkSession, root: str) -> DataFrame:
    """Errors by split, spelling class and frequency class; insertions have no reference word and count by split alone."""
    train = clips(spark, root).where("split = 'train'").select(F.explode(text.words(text.scoring_text(F.col("text")))).alias("ref")).groupBy("ref").agg(F.count("*").alias("count"))
    ops = _operations(spark, root).join(train, "ref", "left")
    ops = ops.withColumn("spelling", F.when(F.col("ref").isNotNull(), text.spelling_class(F.col("ref")))).withColumn("frequency", F.when(F.col("ref").isNotNull(), text.frequency_class(F.coalesce("count", F.lit(0)))))
    dims = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).alias("class")) for d, c in (("split", "split"), ("spelling", "spelling"), ("frequency", "frequency"))))
    rows = ops.select("op", "ref", F.inline(dims)).where("class is not null")
    return rows.groupBy("dimension", "class").agg(F.count("ref").alias("n_ref"), F.count_if(F.col("op") != "equal").alias("errors"))


def substitution_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The forty most frequent replaced words with what they became."""
    rows = _operations(spark, root).where("op = 'replace'").groupBy("ref", "hyp").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "ref", "hyp").limit(40)


def _vocabulary(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    rows = clips(spark, root) if split is None else clips(spark, root).where(F.col("split") == split)
    return rows.select(F.explode(text.words(text.scoring_text(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """Words of the clips that occur twice or more."""
    return _vocabulary(spark, root).where("n >= 2")


def vocabulary_top(spark: SparkSession, root: str) -> DataFrame:
    """The fifty most frequent words."""
    return _vocabulary(spark, root).orderBy(F.desc("n"), "word").limit(50)


def vocabulary_size(spark: SparkSession, root: str) -> DataFrame:
    """Tokens, types, words that occur once, and tokens of words that occur a hundred times or more."""
    return _vocabulary(spark, root).agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once"), F.sum(F.when(F.col("n") >= 100, F.col("n")).otherwise(0)).alias("frequent_tokens"))


def vocabulary_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Tokens covered by all words of at least each frequency: counts of counts, then a running sum over those few rows."""
    levels = _vocabulary(spark, root).groupBy("n").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    return levels.select(F.col("n").alias("least_count"), F.sum("types").over(above).alias("types"), F.sum("tokens").over(above).alias("covered"))


def oov_rate(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of each held-out split, and those whose words train doesn't have."""
    train = _vocabulary(spark, root, "train").select("word", F.lit(1).alias("known"))
    rows = clips(spark, root).where("split <> 'train'").select("split", F.explode(text.words(text.scoring_text(F.col("text")))).alias("word")).groupBy("split", "word").agg(F.count("*").alias("n"))
    return rows.join(train, "word", "left").groupBy("split").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unknown"))


def frequency_classes(spark: SparkSession, root: str) -> DataFrame:
    """Held-out tokens by how often train has their words, with the total."""
    train = _vocabulary(spark, root, "train").withColumnRenamed("n", "seen")
    rows = clips(spark, root).where("split <> 'train'").select(F.explode(text.words(text.scoring_text(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    classes = rows.join(train, "word", "left").groupBy(text.frequency_class(F.coalesce("seen", F.lit(0))).alias("class")).agg(F.sum("n").alias("tokens"))
    return share_of_total(classes, "tokens")


def spelling_classes(spark: SparkSession, root: str) -> DataFrame:
    """Types and tokens by spelling class."""
    return _vocabulary(spark, root).groupBy(text.spelling_class(F.col("word")).alias("class")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


def letter_frequency(spark: SparkSession, root: str) -> DataFrame:
    """Letters by frequency, with their rank."""
    letters = _vocabulary(spark, root).select("n", F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.sum("n").alias("n"))
    return letters.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"))))  # one row a letter


def penultimate_letters(spark: SparkSession, root: str) -> DataFrame:
    """How often each letter stands last but one, and anywhere."""
    words = _vocabulary(spark, root).where(F.length("word") >= 2)
    places = words.select("n", F.length("word").alias("size"), F.posexplode(F.split("word", "")).alias("place", "letter")).where("letter <> ''")
    return places.groupBy("letter").agg(F.sum(F.when(F.col("place") == F.col("size") - 2, F.col("n")).otherwise(0)).alias("last_but_one"), F.sum("n").alias("anywhere"))


def letter_distance(spark: SparkSession, root: str) -> DataFrame:
    """Sum of differences between the letter shares of train and of the rest."""
    rows = clips(spark, root).select((F.col("split") == "train").alias("train"), F.explode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[^א-ת]", ""), "")).alias("letter")).where("letter <> ''")
    counts = rows.groupBy("letter").agg(F.count_if("train").alias("a"), F.count_if(~F.col("train")).alias("b"))
    one, two = (share_of_total(counts, c, f"all_{c}").select("letter", (F.col(c) / F.col(f"all_{c}")).alias(f"share_{c}")) for c in ("a", "b"))
    return one.join(two, "letter").agg(F.round(F.sum(F.abs(F.col("share_a") - F.col("share_b"))), 9).alias("distance"))


def quote_marks(spark: SparkSession, root: str) -> DataFrame:
    """Double quotes in each split's texts."""
    return clips(spark, root).groupBy("split").agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))).cast("bigint").alias("quotes"))


def header_words(spark: SparkSession, root: str) -> DataFrame:
    """Distinct words of headers, sources and markers, of two letters or more."""
    fields = table(spark, root, "pdf_day").select(F.explode(F.array("header", "source", "marker")).alias("field"))
    return fields.select(F.explode(F.regexp_extract_all("field", F.lit("[א-ת]+"), F.lit(0))).alias("word")).where(F.length("word") >= 2).distinct()


def word_counts(spark: SparkSession, root: str) -> DataFrame:
    """Words, and runs of Hebrew letters, of each document."""
    return table(spark, root, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), text.hebrew_word_count(F.col("text")).alias("hebrew_words"))


def point_share(spark: SparkSession, root: str) -> DataFrame:
    """Letters and points of each language's documents."""
    rows = table(spark, root, "documents").groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit("[א-ת]"))).alias("letters"), F.sum(F.regexp_count("text", F.lit("[֑-ׇ]"))).alias("points"), F.count("*").alias("documents"))
    return rows.select("lang", F.coalesce("letters", F.lit(0)).alias("letters"), F.coalesce("points", F.lit(0)).alias("points"), "documents")


def html_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """Paragraphs of documents with mark-up."""
    rows = table(spark, root, "documents").where("text like '%<p%'")
    return rows.select("doc_id", F.posexplode(text.paragraphs(F.col("text"), drop_headers=False)).alias("place", "paragraph"))


def scoring_forms(spark: SparkSession, root: str) -> DataFrame:
    """The scoring form of each clip."""
    return clips(spark, root).select("id", text.scoring_text(F.coalesce("text", F.lit(""))).alias("form"))


def training_forms(spark: SparkSession, root: str) -> DataFrame:
    """The training form of each segment."""
    return table(spark, root, "site_segment").where("yiddish is not null").select("seg_id", text.training_text(F.col("yiddish")).alias("form")).distinct()


def page_classes(spark: SparkSession, root: str) -> DataFrame:
    """Documents by class of page, and those that need recognition anew."""
    rows = table(spark, root, "documents").select(text.page_class(F.coalesce("text", F.lit(""))).alias("class"))
    return rows.groupBy("class").agg(F.count("*").alias("documents"), F.count_if(F.col("class").isin("blank", "garbled")).alias("needs_ocr"))


def repetitive_clips(spark: SparkSession, root: str) -> DataFrame:
    """Clips whose text loops, with the text cut at the loop."""
    rows = clips(spark, root).where("text is not null").select("id", "text", "duration")
    return rows.where(text.is_repetitive("text", "duration")).select("id", text.cut_repeats("text", "duration").alias("kept"))


def running_headers(spark: SparkSession, root: str) -> DataFrame:
    """First and last lines of scanned bodies, digits masked, that stand in many bodies of a year."""
    rows = table(spark, root, "pdf_day").select("pdf_id", "year", F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    ends = F.array_distinct(F.concat(F.slice("lines", 1, 2), F.slice("lines", F.greatest(F.lit(1), F.size("lines") - 1), 2)))
    masked = rows.select("pdf_id", "year", F.explode(F.array_distinct(F.transform(ends, lambda x: F.regexp_replace(F.trim(x), r"\d+", "#")))).alias("line"))
    counts = masked.groupBy("year", "line").agg(F.count("*").alias("bodies"))
    totals = rows.groupBy("year").agg(F.count("*").alias("total"))
    return counts.join(totals, "year").where((F.col("bodies") >= 3) & (F.col("bodies") * 4 >= F.col("total"))).select("year", "line", "bodies")


def run_pivot(spark: SparkSession, root: str) -> DataFrame:
    """Rates of runs by split, weighed by size: line items stand in for scored runs."""
    rows = table(spark, root, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum(F.col("l_discount").cast("decimal(18,4)") * F.col("l_quantity").cast("decimal(18,0)")))
    return rows.select("l_returnflag", *(F.col(c).cast("double").alias(f"weighed_{c.lower()}") for c in ("F", "O")))


def weighed_rate(spark: SparkSession, root: str) -> DataFrame:
    """Sum of rate times weight, and of weights, for each run."""
    rows = table(spark, root, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum((F.col("l_discount") * 100).cast("bigint") * F.col("l_quantity").cast("bigint")).alias("weighed"), F.sum(F.col("l_quantity").cast("bigint")).alias("weight"))


def best_step(spark: SparkSession, root: str) -> DataFrame:
    """For each user the event of the least value, and the second least value: a run's best checkpoint and its runner-up.

    Values are made distinct with partial aggregation, and only the first two of each user pass the window's limit.
    """
    values = table(spark, root, "events").groupBy("user_id", "value").agg(F.min("event_id").alias("event_id"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("value"))
    two = values.withColumn("nth", nth).where("nth <= 2")
    return two.groupBy("user_id").agg(F.max(F.when(F.col("nth") == 1, F.col("event_id"))).alias("best_event"), F.max(F.when(F.col("nth") == 2, F.col("value"))).alias("second_value"))


def run_ranking(spark: SparkSession, root: str) -> DataFrame:
    """Runs in report order: pilots last, then by rate, a missing rate as 9, then by name. Years with clips stand in for runs."""
    rows = scored(spark, root).groupBy("year").agg(F.sum("edits").alias("edits"), F.sum("n_ref").alias("n_ref"), F.count("*").alias("clips"))
    rows = table(spark, root, "day_record").select("year").distinct().join(rows, "year", "left")
    rate = F.when(F.col("n_ref") > 0, F.col("edits") / F.col("n_ref"))
    pilot = F.coalesce("clips", F.lit(0)) < 20
    order = Window.orderBy(pilot, F.coalesce(rate, F.lit(9.0)), "year")  # one row a run
    return rows.select("year", pilot.alias("pilot"), F.row_number().over(order).cast("bigint").alias("place"))


def best_days(spark: SparkSession, root: str) -> DataFrame:
    """The ten days with the least whole-day rate, of those with reference words."""
    rows = whole_day_wer(spark, root).where("ref_words > 0")
    return rows.orderBy(edits.rate(F.col("edits"), F.col("ref_words")), "year", "day").select("year", "day", "edits", "ref_words").limit(10)


def weighed_rates(spark: SparkSession, root: str) -> DataFrame:
    """Mean word and character rates of each year's days, both weighed by reference words."""
    day = scored(spark, root).withColumn("chars", edits.char_edits(F.col("ref"), F.array_join("hyp_words", " "))).groupBy("year", "day").agg(F.sum("edits").alias("e"), F.sum("chars").alias("c"), F.sum("n_ref").alias("n"), F.sum(F.length("ref")).alias("m"))
    day = day.select("year", "n", edits.rate(F.col("e"), F.col("n")).alias("wer"), edits.rate(F.col("c"), F.col("m")).alias("cer"))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.greatest(F.lit(1), F.sum("n")), 9)
    return day.groupBy("year").agg(mean("wer").alias("wer"), mean("cer").alias("cer"))


def weighed_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Average of each label's vectors by dimension, with unequal weights: each vector's weight by the sum of weights."""
    rows = table(spark, root, "embeddings").withColumn("w", (F.col("vec_id") % 5 + 1).cast("double"))
    rows = rows.select("label", "w", F.posexplode("embedding").alias("dimension", "x"))
    return rows.groupBy("label", "dimension").agg(F.round(F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w"), 6).alias("mean"))


def mean_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Mean of each label's vectors by dimension."""
    rows = table(spark, root, "embeddings").select("label", F.posexplode("embedding").alias("dimension", "x"))
    return rows.groupBy("label", "dimension").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def common_value(spark: SparkSession, root: str) -> DataFrame:
    """The most common timing offset method of each year, the first by name of equals."""
    counts = table(spark, root, "day_record").where("offset_method is not null").groupBy("year", "offset_method").agg(F.count("*").alias("n"))
    return counts.groupBy("year").agg(F.min_by("offset_method", F.struct((-F.col("n")).alias("n"), "offset_method")).alias("offset_method"), F.max("n").alias("n"))


def yearly_report(spark: SparkSession, root: str) -> DataFrame:
    """Days, words, edits, median day rate and bad days of each year."""
    day = day_wer(spark, root)
    return day.groupBy("year").agg(F.count("*").alias("days"), F.sum("n_ref").alias("n_ref"), F.sum("edits").alias("edits"), F.percentile("wer", 0.5).alias("median_wer"), F.count_if(F.col("wer") > 0.2).alias("bad_days"))


def full_outer_days(spark: SparkSession, root: str) -> DataFrame:
    """Days with clips, with segments, or both."""
    return both_ways(table(spark, root, "manifest"), table(spark, root, "site_segment"), ["year", "day"])


def similar_words(spark: SparkSession, root: str) -> DataFrame:
    """Likeness of each clip's first two words."""
    rows = clips(spark, root).select("id", text.words(F.col("text")).alias("w")).where(F.size("w") >= 2)
    return rows.select("id", edits.similarity(F.col("w")[0], F.col("w")[1]).alias("likeness"))


def run_stats(spark: SparkSession, root: str) -> DataFrame:
    """Milliseconds of clips by year in which their rate is known: sums for throughput."""
    return scored(spark, root).groupBy("year").agg(F.sum(to_ms(F.col("duration"))).alias("total_ms"), F.sum("n_ref").alias("words"))


_W = f"WITH c AS (SELECT DISTINCT * FROM manifest), w AS (SELECT split, unnest([x FOR x IN string_split({_SCORING}, ' ') IF x <> '']) AS word FROM c)"
_V = _W + ", v AS (SELECT word, count(*) AS n FROM w GROUP BY word)"
_ISO = "CAST(sum({}) AS BIGINT)".format
_SPELL = "CASE WHEN length(word) < 3 THEN 'short' WHEN (length(word) - length(translate(word, 'אעויײױ', '')))::DOUBLE / length(word) < 0.25 THEN 'consonantal' ELSE 'yiddish-like' END"
_FREQ = "CASE WHEN coalesce(seen, 0) >= 100 THEN '100+' WHEN coalesce(seen, 0) >= 10 THEN '10-99' WHEN coalesce(seen, 0) >= 1 THEN '1-9' ELSE '0' END"
_TRAIN = ", t AS (SELECT word, count(*) AS seen FROM w WHERE split = 'train' GROUP BY word), h AS (SELECT split, word, count(*) AS n FROM w WHERE split <> 'train' GROUP BY ALL)"

# White space as Unicode has it, which the engine of SQL doesn't.
_BLANKS = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '[{_BLANKS}]+', ' ', 'g'), ' ')"
_TAGS = lambda x: f"""replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""
_FOREIGN = r"A-Za-z\x{250}-\x{2af}\x{370}-\x{3ff}\x{400}-\x{4ff}"
_TRAINING = lambda x: _SQUEEZE(rf"""regexp_replace(translate(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace({_TAGS(x)}, '[^{_BLANKS}]*[{_FOREIGN}][^{_BLANKS}]*', ' ', 'g'), '[\[\]]', '', 'g'), '[\x{{200e}}\x{{200f}}\x{{202a}}-\x{{202e}}\x{{feff}}]', '', 'g'), chr(160), ' '), '[\x{{591}}-\x{{5c7}}]', '', 'g'), '״׳“”', '"''""'), '[{_BLANKS}]+([,.;:!?])', '\1', 'g')""")
_COUNT = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"

# Distance tables of clips, kept whole, and the way back through them: equal or replace, else delete, else insert, from the end.
_OPERATIONS = f"""WITH RECURSIVE {_SCORED}, tb AS (SELECT id, split, rw, hw, list_reduce(list_concat([{{'r': [range(0, len(hw) + 1)], 'w': ''}}], [{{'r': CAST([] AS BIGINT[][]), 'w': w}} FOR w IN rw]),
  lambda a, x: {{'r': list_append(a.r, [[list_min(t[1:j + 1]) + j FOR j IN range(0, len(t))] FOR t IN [[least(a.r[-1][j + 1] + 1, CASE WHEN j = 0 THEN a.r[-1][1] + 1 ELSE a.r[-1][j] + CASE WHEN hw[j] = x.w THEN 0 ELSE 1 END END) - j FOR j IN range(0, len(hw) + 1)]]][1]), 'w': x.w}}).r AS d FROM s),
bk AS (SELECT id, len(rw) AS i, len(hw) AS j, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS ref, CAST(NULL AS VARCHAR) AS hyp FROM tb
  UNION ALL SELECT id, i - (op <> 'insert')::INT, j - (op <> 'delete')::INT, op, CASE WHEN op <> 'insert' THEN rw[i] END, CASE WHEN op <> 'delete' THEN hw[j] END
  FROM (SELECT bk.id, i, j, rw, hw, CASE WHEN i > 0 AND j > 0 AND d[i + 1][j + 1] = d[i][j] + (rw[i] <> hw[j])::INT THEN CASE WHEN rw[i] = hw[j] THEN 'equal' ELSE 'replace' END WHEN i > 0 AND d[i + 1][j + 1] = d[i][j + 1] + 1 THEN 'delete' ELSE 'insert' END AS op FROM bk JOIN tb ON tb.id = bk.id WHERE i > 0 OR j > 0)),
ops AS (SELECT bk.id, split, op, ref, hyp FROM bk JOIN tb ON tb.id = bk.id WHERE op IS NOT NULL)"""

QUERIES = {
    f.__name__: f
    for f in (
        corpus_wer, pair_wer, day_wer, whole_day_wer, worst_clips, running_wer, scored_without_empty, pair_operations, error_breakdown, substitution_pairs, vocabulary, vocabulary_top, vocabulary_size, vocabulary_coverage, oov_rate,
        frequency_classes, spelling_classes, letter_frequency, penultimate_letters, letter_distance, quote_marks, header_words, word_counts, point_share, html_paragraphs, scoring_forms, training_forms, page_classes, repetitive_clips,
        running_headers, run_pivot, weighed_rate, best_step, run_ranking, best_days, weighed_rates, weighed_vectors, mean_vectors, common_value, yearly_report, full_outer_days, similar_words, run_stats,
    )
}
_DAY = f"WITH {_SCORED}, r AS (SELECT year, day, {_ISO('edits')} AS edits, {_ISO('n_ref')} AS n_ref FROM s GROUP BY year, day), e AS (SELECT *, edits::DOUBLE / greatest(1, n_ref) AS wer FROM r)"
SQL = {
    "corpus_wer": f"WITH {_SCORED} SELECT split, {_ISO('edits')} AS edits, {_ISO('n_ref')} AS n_ref FROM s GROUP BY split",
    "pair_wer": f"WITH {_SCORED} SELECT id, edits, n_ref FROM s",
    "day_wer": _DAY + " SELECT * FROM e",
    "worst_clips": f"WITH {_SCORED} SELECT id, edits, n_ref FROM s ORDER BY edits::DOUBLE / greatest(1, n_ref) DESC, n_ref DESC, id LIMIT 10",
    "running_wer": f"WITH {_SCORED} SELECT id, CAST(sum(edits) OVER o AS BIGINT) AS edits, CAST(sum(n_ref) OVER o AS BIGINT) AS n_ref FROM s WINDOW o AS (PARTITION BY split, year ORDER BY id ROWS UNBOUNDED PRECEDING)",
    "scored_without_empty": f"WITH {_SCORED} SELECT split, coalesce((sum(edits) FILTER (n_ref > 0))::DOUBLE / nullif(sum(n_ref), 0), 1.0) AS wer FROM s GROUP BY split",
    "vocabulary": _V + " SELECT word, n FROM v WHERE n >= 2",
    "vocabulary_top": _V + " SELECT word, n FROM v ORDER BY n DESC, word LIMIT 50",
    "vocabulary_size": _V + f" SELECT {_ISO('n')} AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS once, {_ISO('CASE WHEN n >= 100 THEN n ELSE 0 END')} AS frequent_tokens FROM v",
    "vocabulary_coverage": _V + ", l AS (SELECT n, count(*) AS types, sum(n) AS tokens FROM v GROUP BY n) SELECT n AS least_count, CAST(sum(types) OVER o AS BIGINT) AS types, CAST(sum(tokens) OVER o AS BIGINT) AS covered FROM l WINDOW o AS (ORDER BY n DESC ROWS UNBOUNDED PRECEDING)",
    "oov_rate": _W + _TRAIN + f" SELECT split, {_ISO('n')} AS tokens, {_ISO('CASE WHEN seen IS NULL THEN n ELSE 0 END')} AS unknown FROM h LEFT JOIN t USING (word) GROUP BY split",
    "frequency_classes": _W + _TRAIN + f", k AS (SELECT {_FREQ} AS class, {_ISO('n')} AS tokens FROM h LEFT JOIN t USING (word) GROUP BY 1) SELECT class, tokens, CAST(sum(tokens) OVER () AS BIGINT) AS total FROM k",
    "spelling_classes": _V + f" SELECT {_SPELL} AS class, count(*) AS types, {_ISO('n')} AS tokens FROM v GROUP BY 1",
    "letter_frequency": _V + f", l AS (SELECT n, unnest(string_split(word, '')) AS letter FROM v), k AS (SELECT letter, {_ISO('n')} AS n FROM l GROUP BY letter) SELECT letter, n, rank() OVER (ORDER BY n DESC) AS rank FROM k",
    "penultimate_letters": _V + f", l AS (SELECT n, length(word) AS size, unnest(range(length(word))) AS place, word FROM v WHERE length(word) >= 2) SELECT word[place + 1] AS letter, {_ISO('CASE WHEN place = size - 2 THEN n ELSE 0 END')} AS last_but_one, {_ISO('n')} AS anywhere FROM l GROUP BY 1",
    "letter_distance": "WITH c AS (SELECT DISTINCT * FROM manifest), l AS (SELECT split = 'train' AS train, unnest(string_split(regexp_replace(coalesce(text, ''), '[^א-ת]', '', 'g'), '')) AS letter FROM c), k AS (SELECT letter, count(*) FILTER (train) AS a, count(*) FILTER (NOT train) AS b FROM l WHERE letter <> '' GROUP BY letter), t AS (SELECT sum(a)::DOUBLE AS ta, sum(b)::DOUBLE AS tb FROM k) SELECT round(sum(abs(a / ta - b / tb)), 9) AS distance FROM k, t",
    "quote_marks": "WITH c AS (SELECT DISTINCT * FROM manifest) SELECT split, CAST(sum(length(text) - length(replace(text, '\"', ''))) AS BIGINT) AS quotes FROM c GROUP BY split",
    "header_words": "WITH f AS (SELECT unnest([header, source, marker]) AS f FROM pdf_day), w AS (SELECT unnest(regexp_extract_all(f, '[א-ת]+')) AS word FROM f) SELECT DISTINCT word FROM w WHERE length(word) >= 2",
    "word_counts": r"SELECT doc_id, len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}]+') IF x <> '']) AS words, len(regexp_extract_all(coalesce(text, ''), '[א-ת]+')) AS hebrew_words FROM documents",
    "point_share": r"SELECT lang, CAST(coalesce(sum(len(regexp_extract_all(text, '[א-ת]'))), 0) AS BIGINT) AS letters, CAST(coalesce(sum(len(regexp_extract_all(text, '[\x{591}-\x{5c7}]'))), 0) AS BIGINT) AS points, count(*) AS documents FROM documents GROUP BY lang",
    "scoring_forms": f"WITH c AS (SELECT DISTINCT * FROM manifest) SELECT id, {_SCORING} AS form FROM c",
    "running_headers": r"""WITH l AS (SELECT pdf_id, year, [trim(x, ' ') FOR x IN string_split(body, chr(10)) IF trim(x, ' ') <> ''] AS lines FROM pdf_day),
m AS (SELECT DISTINCT pdf_id, year, regexp_replace(x, '\d+', '#', 'g') AS line FROM (SELECT pdf_id, year, unnest(list_concat(lines[1:2], lines[-2:])) AS x FROM l)),
t AS (SELECT year, count(*) AS total FROM pdf_day GROUP BY year)
SELECT m.year, line, count(*) AS bodies FROM m JOIN t ON t.year = m.year GROUP BY m.year, line, total HAVING count(*) >= 3 AND count(*) * 4 >= total""",
    "whole_day_wer": _WHOLE_DAY,
    "pair_operations": _OPERATIONS + " SELECT id, count(*) FILTER (op = 'replace') AS replaced, count(*) FILTER (op = 'delete') AS deleted, count(*) FILTER (op = 'insert') AS inserted, count(ref) AS n_ref FROM ops GROUP BY id",
    "substitution_pairs": _OPERATIONS + " SELECT ref, hyp, count(*) AS n FROM ops WHERE op = 'replace' GROUP BY ref, hyp ORDER BY n DESC, ref, hyp LIMIT 40",
    "error_breakdown": _OPERATIONS + f""", tv AS (SELECT word, count(*) AS seen FROM (SELECT unnest([x FOR x IN string_split({_SCORING}, ' ') IF x <> '']) AS word FROM c WHERE split = 'train') GROUP BY word),
oc AS (SELECT op, ref, ref AS word, split, seen FROM ops LEFT JOIN tv ON tv.word = ref), dc AS (SELECT op, ref, 'split' AS dimension, split AS class FROM oc UNION ALL SELECT op, ref, 'spelling', {_SPELL} FROM oc WHERE ref IS NOT NULL UNION ALL SELECT op, ref, 'frequency', {_FREQ} FROM oc WHERE ref IS NOT NULL)
SELECT dimension, class, count(ref) AS n_ref, count(*) FILTER (op <> 'equal') AS errors FROM dc GROUP BY ALL""",
    "best_days": f"WITH z AS ({_WHOLE_DAY}) SELECT year, day, edits, ref_words FROM z WHERE ref_words > 0 ORDER BY edits::DOUBLE / greatest(1, ref_words), year, day LIMIT 10",
    "run_ranking": f"WITH {_SCORED}, r AS (SELECT year, sum(edits) AS edits, sum(n_ref) AS n_ref, count(*) AS clips FROM s GROUP BY year), yr AS (SELECT d.year, coalesce(clips, 0) < 20 AS pilot, CASE WHEN n_ref > 0 THEN edits::DOUBLE / n_ref END AS wer FROM (SELECT DISTINCT year FROM day_record) d LEFT JOIN r ON r.year = d.year) SELECT year, pilot, row_number() OVER (ORDER BY pilot, coalesce(wer, 9), year) AS place FROM yr",
    "weighed_rates": f"WITH {_SCORED}, k AS (SELECT year, day, sum(edits) AS e, sum(levenshtein(translate(ref, 'אבגדהוזחטיךכלםמןנסעףפץצקרשת', 'abcdefghijklmnopqrstuvwyzAB'), translate(array_to_string(hw, ' '), 'אבגדהוזחטיךכלםמןנסעףפץצקרשת', 'abcdefghijklmnopqrstuvwyzAB'))) AS c, sum(n_ref) AS n, sum(length(ref)) AS m FROM s GROUP BY year, day), r AS (SELECT year, n, e::DOUBLE / greatest(1, n) AS wer, c::DOUBLE / greatest(1, m) AS cer FROM k) SELECT year, round(sum(wer * n) / greatest(1, sum(n)), 9) AS wer, round(sum(cer * n) / greatest(1, sum(n)), 9) AS cer FROM r GROUP BY year",
    "weighed_vectors": "WITH e AS (SELECT label, (vec_id % 5 + 1)::DOUBLE AS w, unnest(range(len(embedding))) AS dimension, embedding FROM embeddings) SELECT label, dimension, round(sum(w * embedding[dimension + 1]::DOUBLE) / sum(w), 6) AS mean FROM e GROUP BY label, dimension",
    "html_paragraphs": f"WITH p AS (SELECT doc_id, [x FOR x IN [{_SQUEEZE(_TAGS('y'))} FOR y IN regexp_extract_all(text, '(?s)<p[^>]*>(.*?)</p>', 1)] IF x <> ''] AS ps FROM documents WHERE text LIKE '%<p%') SELECT doc_id, CAST(i AS INT) AS place, ps[i + 1] AS paragraph FROM (SELECT doc_id, ps, unnest(range(len(ps))) AS i FROM p)",
    "training_forms": f"SELECT DISTINCT seg_id, {_TRAINING('yiddish')} AS form FROM site_segment WHERE yiddish IS NOT NULL",
    "page_classes": rf"""WITH t AS (SELECT coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[^\x{{5d0}}-\x{{5ea}}{_BLANKS}]', '', 'g') AS b FROM documents),
k AS (SELECT {_COUNT('x', f'[^{_BLANKS}]+')} AS tokens, {_COUNT('x', f'[^{_BLANKS}]*[א-ת][^{_BLANKS}]*')} AS heb, {_COUNT('x', f'[^{_BLANKS}]*[A-Za-z][^{_BLANKS}]*')} AS lat, {_COUNT('x', '[א-ת]')} AS letters,
  len(regexp_extract_all(x, '[^{_BLANKS}\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\x{{200c}}\x{{200d}}\x{{591}}-\x{{5c7}}.,;:!?()\[\]"''\x{{2013}}\x{{5be}}\x{{5f3}}\x{{5f4}}-]')) AS other,
  len([w FOR w IN regexp_split_to_array(b, '[{_BLANKS}]+') IF w IN ({", ".join(f"'{w}'" for w in text.YIDDISH_WORDS)})]) AS yid, len([w FOR w IN regexp_split_to_array(b, '[{_BLANKS}]+') IF w IN ({", ".join(f"'{w}'" for w in text.HEBREW_WORDS)})]) AS hbr FROM t),
c AS (SELECT CASE WHEN tokens < 5 THEN 'blank' WHEN lat > 2 * heb THEN 'english' WHEN letters > 0 AND other > letters * 0.15 THEN 'garbled' WHEN yid >= 3 AND yid >= 1.5 * hbr THEN 'yiddish' WHEN hbr >= 3 AND hbr > yid THEN 'hebrew' ELSE 'hebscript' END AS class FROM k)
SELECT class, count(*) AS documents, count(*) FILTER (class IN ('blank', 'garbled')) AS needs_ocr FROM c GROUP BY class""",
    "run_pivot": "SELECT l_returnflag, CAST(sum(l_discount::DECIMAL(18,4) * l_quantity::DECIMAL(18,0)) FILTER (l_linestatus = 'F') AS DOUBLE) AS weighed_f, CAST(sum(l_discount::DECIMAL(18,4) * l_quantity::DECIMAL(18,0)) FILTER (l_linestatus = 'O') AS DOUBLE) AS weighed_o FROM lineitem GROUP BY l_returnflag",
    "weighed_rate": "SELECT l_returnflag, l_linestatus, CAST(sum(trunc(l_discount * 100)::BIGINT * trunc(l_quantity)::BIGINT) AS BIGINT) AS weighed, CAST(sum(trunc(l_quantity)::BIGINT) AS BIGINT) AS weight FROM lineitem GROUP BY ALL",
    "best_step": "SELECT user_id, arg_min(event_id, (value, event_id)) AS best_event, list_sort(list_distinct(list(value)))[2] AS second_value FROM events GROUP BY user_id",
    "mean_vectors": "WITH e AS (SELECT label, unnest(range(len(embedding))) AS dimension, embedding FROM embeddings) SELECT label, dimension, round(avg(embedding[dimension + 1]::DOUBLE), 6) AS mean FROM e GROUP BY label, dimension",
    "yearly_report": _DAY + f" SELECT year, count(*) AS days, {_ISO('n_ref')} AS n_ref, {_ISO('edits')} AS edits, quantile_cont(wer, 0.5) AS median_wer, count(*) FILTER (wer > 0.2) AS bad_days FROM e GROUP BY year",
    "full_outer_days": "WITH a AS (SELECT DISTINCT year, day FROM manifest), b AS (SELECT DISTINCT year, day FROM site_segment) SELECT coalesce(a.year, b.year) AS year, coalesce(a.day, b.day) AS day, CASE WHEN a.year IS NULL THEN 'right' WHEN b.year IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.year = b.year AND a.day = b.day",
    "run_stats": f"WITH {_SCORED} SELECT s.year, CAST(sum(CAST(round(duration * 1000) AS BIGINT)) AS BIGINT) AS total_ms, {_ISO('n_ref')} AS words FROM s JOIN c ON c.id = s.id GROUP BY s.year",
    "common_value": "WITH k AS (SELECT year, offset_method, count(*) AS n FROM day_record WHERE offset_method IS NOT NULL GROUP BY ALL) SELECT year, offset_method, n FROM k QUALIFY row_number() OVER (PARTITION BY year ORDER BY n DESC, offset_method) = 1",
}
