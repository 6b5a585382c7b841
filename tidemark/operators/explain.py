"""What changed between consecutive windows: keyword shifts, sentences, reports.

Equal texts are told apart from posts first (`texts_once`): `prepare`, where a function takes it, is the cleaning of texts as
they came, and posts without a text after it are dropped.
"""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import scoring, text as tx, vectors as vx
from tidemark.operators import compare as cmp
from tidemark.operators.copies import texts_once
from tidemark.operators.vectors import mean_pool
from tidemark.session import cut_lineage, sized

TOP_TERMS = 8
EXAMPLES = 4
SUMMARY_TERMS = 4
NO_TERM = ""      # never a token


def _blank() -> Column:
    return F.coalesce(F.length(F.trim("text")) == 0, F.lit(True))


def _without_blank(kept: DataFrame) -> DataFrame:
    """The rows of `texts_once` whose text, on their own row or another, is not blank; the list of blank texts is joined."""
    blank = kept.filter(F.col("is_first") & _blank()).select("text_id")
    return kept.join(sized(blank), "text_id", "left_anti")


def _counts_with_texts(kept: DataFrame) -> DataFrame:
    """Occurrences per (window, term) in rows of `texts_once`; the term NO_TERM counts the texts of the window.

    A text is taken apart once and counts for the window of its own row and, by number, for those of its other rows. Only
    the numbers of the other rows are shuffled before that, where Spark can send them to the texts.
    """
    marked = F.concat(F.array(F.lit(NO_TERM)), F.coalesce(tx.raw_tokens(F.col("text")), F.array().cast("array<string>")))
    others = kept.filter(~F.col("is_first")).groupBy("text_id", "window_id").agg(F.count("*").alias("uses"))
    others = others.groupBy("text_id").agg(F.collect_list(F.struct("window_id", "uses")).alias("others"))      # one entry per window
    own = F.array(F.struct("window_id", F.lit(1).cast("long").alias("uses")))
    tokens = (
        kept.filter("is_first").select("text_id", "window_id", "text").join(sized(others), "text_id", "left")
        .select(F.concat(own, F.coalesce("others", F.array().cast("array<struct<window_id:bigint,uses:bigint>>"))).alias("used"), marked.alias("terms"))
        .select("used", F.explode("terms").alias("term")).select("term", F.explode("used").alias("u"))
    )
    return _keywords(tokens.groupBy(F.col("u.window_id").alias("window_id"), "term").agg(F.sum("u.uses").alias("n")))


def _keywords(counts: DataFrame) -> DataFrame:
    """Stop words and numbers go after the count, where a word is one row and not one per use."""
    return counts.filter((F.col("term") == NO_TERM) | tx.is_keyword(F.col("term")))


def term_counts(posts: DataFrame) -> DataFrame:
    """Occurrences of every term per window; partial counts fold hot terms before the shuffle."""
    tokens = posts.select("window_id", F.explode(tx.raw_tokens(F.col("text"))).alias("term"))
    return _keywords(tokens.groupBy("window_id", "term").agg(F.count("*").alias("n")))


def window_pairs(records: DataFrame) -> DataFrame:
    """(window, preceding window) for every record; the first window is paired with itself."""
    return cmp.with_previous(records).select("window_id", "before_window_id")


def term_shift_join(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of every term in a window and in the window before, missing = 0.

    Each count row is sent to the pairs it takes part in, as "after" or as "before", and both sides
    meet in one aggregate over (window, term): a full outer join in a single shuffle.
    """
    roles = sized(
        pairs.select(F.col("window_id").alias("pair_id"), F.explode(F.array(
            F.struct(F.col("window_id").alias("id"), F.lit(1).alias("is_after")),
            F.struct(F.col("before_window_id").alias("id"), F.lit(0).alias("is_after")),
        )).alias("r")).select("pair_id", F.col("r.id").alias("window_id"), F.col("r.is_after").alias("is_after"))
    )
    return (
        counts.join(roles, "window_id").groupBy(F.col("pair_id").alias("window_id"), "term")
        .agg(F.sum(F.col("n") * (1 - F.col("is_after"))).alias("count_before"),
             F.sum(F.col("n") * F.col("is_after")).alias("count_after"))
    )


def keyword_shift(posts: DataFrame, pairs: DataFrame, n: int = TOP_TERMS,
                  prepare: Callable[[Column], Column] | None = None) -> DataFrame:
    """Top emerging and fading terms of every window pair, by difference of relative frequency.

    Frequency = occurrences / number of texts (at least 1); emerging terms need two occurrences after,
    fading ones two before. `rank` counts from 1, the strongest first.
    """
    posts = posts.withColumns({"event_time": F.lit(None).cast("timestamp"), "post_id": F.lit(None).cast("string")})      # not read
    kept = texts_once(posts, prepare)
    return _shifts(kept if prepare is None else _without_blank(kept), pairs, n)


def _shifts(kept: DataFrame, pairs: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    counts = cut_lineage(_counts_with_texts(kept))          # the texts are read once
    shifts = term_shift_join(counts.filter(F.col("term") != NO_TERM), pairs)
    sizes = counts.filter(F.col("term") == NO_TERM).select("window_id", F.col("n").alias("n_texts"))
    # Pairs of the window lists only: two small joins, not a join of the terms.
    texts = sized(
        pairs.join(sizes.withColumnRenamed("n_texts", "n_after"), "window_id", "left")
        .join(sizes.select(F.col("window_id").alias("before_window_id"), F.col("n_texts").alias("n_before")),
              "before_window_id", "left")
        .select("window_id", F.greatest(F.coalesce("n_after", F.lit(0)), F.lit(1)).alias("n_after"),
                F.greatest(F.coalesce("n_before", F.lit(0)), F.lit(1)).alias("n_before"))
    )
    diff = F.col("count_after") / F.col("n_after") - F.col("count_before") / F.col("n_before")
    direction = (
        F.when((F.col("diff") > 0) & (F.col("count_after") >= 2), "emerging")
        .when((F.col("diff") < 0) & (F.col("count_before") >= 2), "fading")
    )
    ranked = Window.partitionBy("window_id", "direction").orderBy(F.desc(F.round(F.abs("diff"), 9)), "term")
    return (
        shifts.join(texts, "window_id").withColumn("diff", diff).withColumn("direction", direction)
        .filter(F.col("direction").isNotNull())
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)
        .select("window_id", "direction", "rank", "term", F.round(F.col("diff") * 100, 2).alias("score"),
                "count_before", "count_after")
    )


def first_k(posts: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """The first `k` posts of every window in (event_time, post_id) order."""
    order = Window.partitionBy("window_id").orderBy("event_time", "post_id")
    return posts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def centroid_k(vectors: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """The `k` posts of every window closest (cosine) to the window's mean vector."""
    centres = sized(mean_pool(vectors).withColumnRenamed("mean", "centre"))
    order = Window.partitionBy("window_id").orderBy(F.desc("similarity"), "post_id")
    similarity = F.round(vx.cosine(F.col("embedding"), F.col("centre")), 6)
    return (
        vectors.join(centres, "window_id").select("window_id", "post_id", similarity.alias("similarity"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    )


def _keyword_lists(shifts: DataFrame) -> DataFrame:
    entry = F.struct("rank", "term", "score", "count_before", "count_after")
    lists = shifts.groupBy("window_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("direction") == d, entry))).alias(f"{d}_keywords")
        for d in ("emerging", "fading")
    ])
    return lists


def _examples(kept: DataFrame) -> DataFrame:
    """The texts of the first posts of every window; posts are ranked without their texts."""
    places = sized(first_k(kept.select("window_id", "event_time", "post_id", "text_id")))      # EXAMPLES rows per window
    texts = kept.filter("is_first").select("text_id", "text")
    return texts.join(places, "text_id").groupBy("window_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("found")
    ).select("window_id", F.col("found.text").alias("texts"))


def explain(scores: DataFrame, posts: DataFrame, baseline: str = "April 2020", chosen: DataFrame | None = None,
            prepare: Callable[[Column], Column] | None = None) -> DataFrame:
    """One explanation row per window (of `chosen` only, if given): metrics, sentence, before/after, keywords, examples.

    Only posts of the explained windows and of those before them are read; they are materialised once, with each text once
    for each task, for the keywords and for the examples.
    """
    compared = cmp.compare(scores)
    used = scores.select("window_id", F.coalesce("n_used", F.lit(0)).alias("n_used"))
    records = cmp.with_previous(compared).join(used, "window_id")
    posts = posts.select("window_id", "event_time", "post_id", "text")
    if chosen is not None:
        records = records.join(chosen.select("window_id"), "window_id", "left_semi")
    records = sized(records)
    pairs = records.select("window_id", "before_window_id")
    if chosen is not None:
        needed = pairs.select("window_id").union(pairs.select("before_window_id")).distinct()
        posts = posts.join(sized(needed), "window_id", "left_semi")
    kept = texts_once(posts, prepare)
    if prepare is not None:
        kept = _without_blank(kept)
    keywords, examples = _keyword_lists(_shifts(kept, pairs)), _examples(kept)
    after = examples.select("window_id", F.col("texts").alias("after_examples"))
    before = examples.select(F.col("window_id").alias("before_window_id"), F.col("texts").alias("before_examples"))
    empty = F.array().cast("array<string>")
    has_texts = F.col("after_examples").isNotNull()
    terms = F.array_join(F.slice("emerging_keywords.term", 1, SUMMARY_TERMS), ", ")
    shift_text = F.concat(F.lit("Window "), F.col("window_id").cast("string"),
                          F.lit(" demonstrates shifts with emerging terms: "), F.coalesce(terms, F.lit("")), F.lit("."))
    notice = F.lit("DATA DEPENDENCY NOTICE: the posts of this window are not available; "
                   "word-level shifts need the original texts.")
    return (
        records.join(keywords, "window_id", "left").join(after, "window_id", "left")
        .join(before, "before_window_id", "left")
        .select(
            "window_id", "window_start", "is_reference", "agreement",
            "driftlens_score", "driftlens_threshold", "driftlens_ratio", "driftlens_alarm",
            "mcddd_score", "mcddd_threshold", "mcddd_ratio", "mcddd_alarm",
            scoring.rationale(baseline).alias("detector_rationale"),
            has_texts.alias("post_data_available"),
            "before_window_id", "before_window_start", F.col("before_posts").alias("before_volume"),
            F.when(has_texts, F.coalesce("before_examples", empty)).otherwise(empty).alias("before_examples"),
            F.col("n_posts").alias("after_volume"), "n_used",
            F.coalesce("after_examples", empty).alias("after_examples"),
            "emerging_keywords", "fading_keywords",
            F.when(has_texts, shift_text).otherwise(notice).alias("semantic_summary"),
            scoring.change_type(F.col("driftlens_ratio"), F.col("mcddd_ratio")).alias("change_type"),
        )
    )


def report_totals(scores: DataFrame) -> DataFrame:
    """One row: windows, stream windows, selected windows and agreement counts."""
    compared = cmp.compare(scores)
    selected = cmp.select_important(compared).select("window_id", F.lit(True).alias("selected"))
    marked = compared.join(selected, "window_id", "left")
    stream = ~F.col("is_reference")
    return marked.agg(
        F.count("*").alias("total_windows"), F.count_if(stream).alias("stream_windows"),
        F.count_if(F.coalesce("selected", F.lit(False))).alias("selected_windows"),
        *[F.count_if(stream & (F.col("agreement") == c)).alias(c)
          for c in ("both", "driftlens_only", "mcddd_only", "neither", "mcddd_missing")],
    )


def report(scores: DataFrame, posts: DataFrame, prepare: Callable[[Column], Column] | None = None) -> DataFrame:
    """Explanations of the priority windows with the reason for their selection."""
    chosen = sized(cmp.select_important(cmp.compare(scores)).select("window_id", "reason", "class_rank"))
    return explain(scores, posts, chosen=chosen, prepare=prepare).join(chosen, "window_id")


def report_document(scores: DataFrame, posts: DataFrame) -> DataFrame:
    """The report as nested rows, one per priority window, each with the totals of the whole run."""
    rows = report(scores, posts)
    totals = F.broadcast(report_totals(scores).select(F.struct("*").alias("totals")))      # one row
    detectors = F.struct(
        F.struct("driftlens_score", "driftlens_threshold", "driftlens_ratio", "driftlens_alarm").alias("driftlens"),
        F.struct("mcddd_score", "mcddd_threshold", "mcddd_ratio", "mcddd_alarm").alias("mcddd"), "agreement", "detector_rationale")
    before = F.struct(F.col("before_window_id").alias("window_id"), F.col("before_window_start").alias("window_start"),
                      F.col("before_volume").alias("volume"), F.col("before_examples").alias("examples"))
    after = F.struct("window_id", "window_start", F.col("after_volume").alias("volume"), "n_used", F.col("after_examples").alias("examples"))
    changed = F.struct("emerging_keywords", "fading_keywords", "semantic_summary", "change_type", "post_data_available")
    return rows.select("window_id", "reason", "class_rank", detectors.alias("detector_metrics"), before.alias("before_drift"),
                       after.alias("after_drift"), changed.alias("what_changed")).join(totals, F.lit(True))
