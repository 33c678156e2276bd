"""Measures over golden questions: coverage, recall, answer quality, percentiles, and replayed thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import tables
from corpusloom.functions import text as X
from corpusloom.functions.joins import salted_join
from corpusloom.operators.answers import META_TALK, commands, unverified

# Fixed values.
THRESHOLDS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
HIGH_SCORE = 0.5


def on_pages(first: Column, last: Column, from_page: Column, to_page: Column) -> Column:
    """Whether two closed page ranges meet."""
    return (first <= to_page) & (last >= from_page)


def nearest_rank(values: Column, percent: float) -> Column:
    """The value at the nearest rank of an array; 0 of an empty one."""
    n = F.size(values)
    at = F.least(n - 1, F.bround((n - 1) * F.lit(percent / 100), 0).cast("int"))
    return F.coalesce(F.get(F.array_sort(values), at), F.lit(0.0))


def nearest_rank_by(rows: DataFrame, by: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """nearest_rank over groups of any size: equal values are counted first, and ranks are running sums of counts by parts of the order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = tables.ranked(counts, by, [F.col(value)], "_to", F.col("_c"))
    total = upto.groupBy(*by).agg(F.sum("_c").alias("_n"))
    want = {name: F.least(F.col("_n") - 1, F.bround((F.col("_n") - 1) * F.lit(p / 100), 0).cast("long")) for name, p in percents.items()}
    return salted_join(upto, total, by).groupBy(*by).agg(*(F.min(F.when(F.col("_to") > w, F.col(value))).alias(name) for name, w in want.items()))


def first_hits(candidates: DataFrame, sources: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, qtype, first_hit, all_docs: the best rank on cited pages, and whether the top 5 hold every cited document.

    candidates(qid, rank, doc_id, page_start, page_end), sources(qid, doc_id, first, last).
    """
    hits = candidates.join(sources, ["qid", "doc_id"]).where(on_pages(F.col("page_start"), F.col("page_end"), F.col("first"), F.col("last")))
    per = hits.groupBy("qid").agg(F.min("rank").alias("first_hit"), F.countDistinct(F.when(F.col("rank") <= 5, F.col("doc_id"))).alias("_found"))
    cited = sources.groupBy("qid").agg(F.countDistinct("doc_id").alias("_cited"))
    return questions.join(cited, "qid").join(per, "qid", "left").select("qid", "qtype", "first_hit", (F.coalesce("_found", F.lit(0)) == F.col("_cited")).alias("all_docs"))


def retrieval_summary(hits: DataFrame, by: list[str]) -> DataFrame:
    """n, recall@1/5/10 and MRR of hits(first_hit) for each group."""
    at = lambda k: F.avg(F.when(F.col("first_hit") <= k, 1.0).otherwise(0.0))
    return hits.groupBy(*by).agg(F.count("*").alias("n"), at(1).alias("recall_1"), at(5).alias("recall_5"), at(10).alias("recall_10"), F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"))


def retrieval_details(hits: DataFrame, by: list[str]) -> DataFrame:
    """context_recall, all_docs_5 (of comparisons), and the top scores of right answers and of unanswerable questions.

    hits(qtype, answerable, first_hit, context_hit, all_docs, top_score).
    """
    ask, right = F.col("answerable"), F.col("answerable") & (F.col("first_hit") == 1)
    return hits.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(ask, F.col("context_hit").cast("double"))), F.lit(0.0)).alias("context_recall"), F.coalesce(F.avg(F.when(ask & (F.col("qtype") == "compare"), F.col("all_docs").cast("double"))), F.lit(0.0)).alias("all_docs_5"),
        F.min(F.when(right, F.col("top_score"))).alias("right_min"), F.median(F.when(right, F.col("top_score"))).alias("right_median"), F.max(F.when(~ask, F.col("top_score"))).alias("unanswerable_max"),
    )


def coverage(golden: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, missing (strings that the chunks on the cited pages lack), n_chunks.

    Each string is looked for in each chunk and the answers are combined, so no text is put together.
    """
    on = sources.join(chunks, "doc_id").where(on_pages(F.col("page_start"), F.col("page_end"), F.col("first"), F.col("last")))
    seen = golden.select("qid", F.explode("must_include").alias("must")).join(on.select("qid", "text"), "qid", "left")
    found = seen.groupBy("qid", "must").agg(F.coalesce(F.bool_or(F.contains(F.lower("text"), F.lower("must"))), F.lit(False)).alias("found"), F.count("text").alias("c"))
    return found.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("must")))).alias("missing"), F.max("c").alias("n_chunks"))


def score_answers(answers: DataFrame) -> DataFrame:
    """answers(qid, qtype, answerable, answered, text, must, n_cited, n_correct) with must_found, must_total, status_ok, no_markers, meta_talk."""
    must = F.when(F.col("answerable"), F.col("must")).otherwise(F.array().cast("array<string>"))
    text = F.when(F.col("answered"), F.col("text")).otherwise("")
    return answers.select("*", F.size(must).alias("must_total"), F.size(F.filter(must, lambda m: X.holds(text, m))).alias("must_found"), (F.col("answered") == F.col("answerable")).alias("status_ok"), (F.col("answered") & ~text.rlike(r"\[\d+\]")).alias("no_markers"), text.rlike(META_TALK).alias("meta_talk"))


def answer_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Shares over answerable and unanswerable questions: the mean of ratios for facts, the ratio of sums for citations."""
    ok, said = F.col("answerable"), F.col("answerable") & F.col("answered")
    share = lambda of, what: F.avg(F.when(of, what.cast("double")))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("answerable"), share(ok, F.col("answered")).alias("answered"), F.avg(F.when(said, F.try_divide("must_found", "must_total"))).alias("must_include"), share(said, F.col("must_found") == F.col("must_total")).alias("must_include_all"),
        F.try_divide(F.sum(F.when(said, F.col("n_correct"))), F.sum(F.when(said, F.col("n_cited")))).alias("citation_precision"), share(said, F.col("no_markers")).alias("no_markers"), share(~ok, ~F.col("answered")).alias("refused"),
    )


#: Fixed value: a web address in an expected answer.
URL = r"https?://[^\s)\]>,;'\"]+"
#: A source and where it stands: struct<doc_id, page_start, page_end, copies array<struct<doc_id, page_start, page_end>>>.


def locations(source: Column) -> Column:
    """A source's own place and those of its copies."""
    own = F.struct(source["doc_id"].alias("doc_id"), source["page_start"].alias("page_start"), source["page_end"].alias("page_end"))
    return F.concat(F.array(own), F.coalesce(source["copies"], F.array().cast("array<struct<doc_id:bigint,page_start:int,page_end:int>>")))


def on_golden(source: Column, golden: Column) -> Column:
    """Whether a source or one of its copies is on a golden document's pages."""
    meets = lambda p, g: (p["doc_id"] == g["doc_id"]) & on_pages(p["page_start"], p["page_end"], g["first"], g["last"])
    return F.exists(locations(source), lambda p: F.exists(golden, lambda g: meets(p, g)))


def score_in_full(questions: DataFrame, given: DataFrame, article: str) -> DataFrame:
    """A row of measures for each answer; by expressions over the row alone, so texts do not move but for the join by qid.

    questions(qid, qtype, must, expected, golden array<struct<doc_id, first, last>>), none of which may
    be answerable without a golden source; given(qid, answered, refused_by, text, sources, context (as
    locations() takes them, context with text too), n_invalid, dropped, retried, route, top_score,
    claims array<struct<supported, by_values>>, judge_error, retrieval_ms, generation_ms, judge_ms,
    total_ms). article: the pattern of article numbers. An answer that is a refusal has no text to
    score; null arrays count as empty; a question without an answer has no row.
    """
    none = lambda c, kind="array<string>": F.coalesce(F.col(c), F.array().cast(kind))
    j = questions.join(given, "qid").withColumn("golden", none("golden", questions.schema["golden"].dataType.simpleString()))
    answerable, text = F.size("golden") > 0, F.when(F.col("answered"), F.coalesce("text", F.lit(""))).otherwise("")
    j = j.withColumns({"answerable": answerable, "said": text, "sources": none("sources", given.schema["sources"].dataType.simpleString()), "context": none("context", given.schema["context"].dataType.simpleString())})
    only = lambda found: F.when(F.col("answerable"), found).otherwise(F.array().cast("array<string>"))
    expected = F.coalesce("expected", F.lit(""))
    refs = only(F.array_distinct(F.regexp_extract_all(expected, F.lit(article), 0)))
    urls = only(F.array_distinct(F.transform(F.regexp_extract_all(expected, F.lit(URL), 0), lambda u: F.regexp_replace(u, r"\.+$", ""))))
    must = only(none("must"))
    inside = lambda all_: F.size(F.filter(all_, lambda x: F.contains(F.col("said"), x)))
    golden_docs = F.array_distinct(F.transform("golden", lambda g: g["doc_id"]))
    cited_docs = F.array_distinct(F.transform(F.flatten(F.transform("sources", locations)), lambda p: p["doc_id"]))
    seen = F.array_join(F.transform("context", lambda u: u["text"]), "\n")
    claims = none("claims", given.schema["claims"].dataType.simpleString())
    good = F.size(F.filter(claims, lambda c: c["supported"]))
    return j.select(
        "qid", "qtype", "answerable", "answered", "refused_by", (F.col("answered") == F.col("answerable")).alias("status_ok"), F.size(F.filter(must, lambda m: X.holds(F.col("said"), m))).alias("must_found"), F.size(must).alias("must_total"),
        F.filter(must, lambda m: ~X.holds(F.col("said"), m)).alias("missing"), inside(refs).alias("ref_found"), F.size(refs).alias("ref_total"), inside(urls).alias("urls_found"), F.size(urls).alias("urls_total"), F.size("sources").alias("cited"),
        F.size(F.filter("sources", lambda s: on_golden(s, F.col("golden")))).alias("cited_correct"), F.size(golden_docs).alias("golden_docs"), F.size(F.array_intersect(golden_docs, cited_docs)).alias("golden_docs_cited"),
        F.exists("context", lambda u: on_golden(u, F.col("golden"))).alias("context_hit"), (F.col("answered") & ~F.col("said").rlike(r"\[\d+\]")).alias("no_markers"), "dropped", F.col("said").rlike(META_TALK).alias("meta_talk"),
        F.col("n_invalid").alias("invalid_citations"), "top_score", "retried", "route", F.size(commands(F.col("said"))).alias("commands_total"), F.size(unverified(F.col("said"), seen)).alias("commands_unverified"),
        F.when(F.size(claims) > 0, good / F.size(claims)).alias("faithfulness"), F.size(F.filter(claims, lambda c: c["by_values"])).alias("claims_by_values"), "judge_error", "retrieval_ms", "generation_ms", "judge_ms", "total_ms",
    )


def summary_in_full(scored: DataFrame, by: list[str]) -> DataFrame:
    """All measures over the rows of score_in_full, one row a group: quality of what is answerable, style, refusals, latency.

    Shares are null where there is nothing to share; percentiles are by nearest rank, of generation
    and judging over those that took time. Which questions are exceptions is exceptions()'s to say.
    """
    ok, said = F.col("answerable"), F.col("answerable") & F.col("answered")
    share = lambda of, what: F.avg(F.when(of, what.cast("double")))
    ratio = lambda a, b: F.try_divide(F.sum(F.when(said, F.col(a))), F.sum(F.when(said, F.col(b))))
    total = lambda c: F.coalesce(F.sum(F.when(said, F.col(c).cast("long"))), F.lit(0))
    judged = said & F.col("faithfulness").isNotNull()
    sums = scored.withColumn("_verified", F.col("commands_total") - F.col("commands_unverified")).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("answerable"), F.count_if(~ok).alias("unanswerable"), share(ok, F.col("answered")).alias("answered"), F.avg(F.when(said, F.try_divide("must_found", "must_total"))).alias("must_include"),
        share(said, F.col("must_found") == F.col("must_total")).alias("must_include_all"), ratio("ref_found", "ref_total").alias("article_numbers"), ratio("urls_found", "urls_total").alias("urls"), ratio("cited_correct", "cited").alias("citation_precision"),
        ratio("golden_docs_cited", "golden_docs").alias("citation_doc_recall"), share(ok, F.col("context_hit")).alias("context_hit"), F.avg(F.when(said, F.col("faithfulness"))).alias("faithfulness"), share(judged, F.col("faithfulness") == 1).alias("fully_faithful"),
        F.count_if(said & F.col("judge_error").isNotNull()).alias("judge_errors"), share(said, F.col("no_markers")).alias("no_markers"), share(said, F.col("dropped")).alias("dropped_not_found"), share(said, F.col("meta_talk")).alias("meta_talk"),
        total("invalid_citations").alias("invalid_citations"), ratio("_verified", "commands_total").alias("commands_verified"), total("commands_unverified").alias("commands_unverified"), total("claims_by_values").alias("claims_by_values"),
        share(~ok, ~F.col("answered")).alias("refused"), F.count_if(~ok & (F.col("refused_by") == "gate")).alias("refused_by_gate"), F.count_if(~ok & (F.col("refused_by") == "llm")).alias("refused_by_llm"),
    )
    ranks = (("total_ms", {"total_ms_p50": 50, "total_ms_p95": 95}, "true"), ("retrieval_ms", {"retrieval_ms_p50": 50}, "true"), ("generation_ms", {"generation_ms_p50": 50}, "generation_ms > 0"), ("judge_ms", {"judge_ms_p50": 50}, "judge_ms > 0"))
    for column, percents, where in ranks:
        sums = sums.join(nearest_rank_by(scored.where(where), by, column, percents), by, "left").na.fill(0.0, list(percents))
    return sums


def exceptions(scored: DataFrame) -> DataFrame:
    """qid, what: wrong_refusal, wrong_answer, retried; a question may be several."""
    ok, said = F.col("answerable"), F.col("answered")
    what = F.array_compact(F.array(F.when(ok & ~said, "wrong_refusal"), F.when(~ok & said, "wrong_answer"), F.when(F.col("retried"), "retried")))
    return scored.select("qid", F.explode(what).alias("what"))


def gate(n_units: Column, top: Column, threshold: Column | float) -> Column:
    """no_context, low_score or pass; a missing score passes."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(n_units == 0, "no_context").when(top < t, "low_score").otherwise("pass")


def below(top: Column, threshold: Column) -> Column:
    return F.coalesce(top < threshold, F.lit(False))


def replay(outcomes: DataFrame, run_threshold: float, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """What each threshold would have done to outcomes(qid, answerable, top, answered, refused_by, retried, good).

    A fixed, short list of thresholds is exploded beside each outcome; all counts are one aggregation.
    """
    o = outcomes.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    cut = below(F.col("top"), F.col("threshold"))
    unknown = ~cut & (F.coalesce("refused_by", F.lit("")) == "gate") & below(F.col("top"), F.lit(run_threshold))
    reached = ~cut & ~unknown
    ask, said = F.col("answerable"), F.col("answered")
    return o.groupBy("threshold").agg(
        F.count_if(cut & ask & said).alias("answers_lost"), F.count_if(cut & ask & F.col("good")).alias("good_lost"), F.count_if((cut & ask) | (reached & ask & ~said)).alias("wrong_refusals"), F.count_if(cut & ~ask).alias("unanswerable_gate"),
        F.count_if(reached & ~ask & ~said).alias("unanswerable_llm"), F.count_if(reached & ~ask & said).alias("let_through"), F.count_if(cut).alias("llm_calls_saved"), F.count_if(reached & F.col("retried") & said).alias("retry_rescues"), F.count_if(unknown).alias("unmeasured"),
    )


def recommend(outcomes: DataFrame, current: float) -> DataFrame:
    """threshold, lowest, highest: the middle between the lowest answered score and the highest unanswerable one below it."""
    low = outcomes.where("answerable and answered and top is not null").agg(F.min("top").alias("lowest"))
    high = outcomes.where(~F.col("answerable") & (F.col("top") < low.scalar())).agg(F.max("top"))
    both = low.withColumn("highest", high.scalar())
    return both.select(F.when(F.col("lowest").isNull(), F.lit(None).cast("double")).when(F.col("highest").isNull(), F.least(F.lit(current), F.bround(F.col("lowest") / 2, 2))).otherwise(F.bround((F.col("highest") + F.col("lowest")) / 2, 2)).alias("threshold"), "lowest", "highest")


def high_score_refusals(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("answerable") & (F.col("refused_by") == "llm") & (F.coalesce("top", F.lit(0.0)) >= HIGH_SCORE)).select("qid", "top")


def feedback_summary(ratings: DataFrame, threshold: float) -> DataFrame:
    """reason, n, refused_by_gate, catchable, above of thumbs down."""
    down = ratings.where("rating < 0")
    refuse = (F.col("reason") == "should_have_refused") & F.col("answered") & F.col("top").isNotNull()
    return down.groupBy(F.coalesce("reason", F.lit("no reason")).alias("reason")).agg(F.count("*").alias("n"), F.count_if((F.col("reason") == "should_have_answered") & (F.col("gate") == "low_score")).alias("refused_by_gate"), F.count_if(refuse & (F.col("top") < threshold)).alias("catchable"), F.count_if(refuse & (F.col("top") >= threshold)).alias("above"))


def golden_problems(golden: DataFrame) -> DataFrame:
    """qid, problem of golden questions that contradict themselves."""
    known = F.col("type").isin("lookup", "howto", "compare", "unanswerable")
    has = F.size("sources") > 0
    one = F.array(
        F.when(~known, "unknown type"), F.when(known & (F.col("type") != "unanswerable") & ~has, "no sources"), F.when((F.col("type") == "unanswerable") & has, "sources of an unanswerable question"),
        F.when(F.exists("must_include", lambda m: ~X.holds(F.col("expected_answer"), m)), "a fact is not in the expected answer"),
    )
    return golden.select("qid", F.explode(F.array_compact(one)).alias("problem"))


def leaks(results: DataFrame, documents: DataFrame, groups: Column, release: Column | None = None) -> DataFrame:
    """Result rows (with doc_id) that these groups must not see, or outside the release: must be empty."""
    from corpusloom.operators.search import may_see

    wrong = ~may_see(F.col("allowed_groups"), groups)
    if release is not None:
        wrong = wrong | ~release.between(F.col("release_min"), F.col("release_max"))
    return results.join(documents.where(wrong).select("doc_id"), "doc_id", "left_semi")


def every_group(documents: DataFrame) -> DataFrame:
    """One row: all groups there are, and 'all'."""
    return documents.select(F.explode("allowed_groups").alias("g")).distinct().agg(F.array_sort(F.array_union(F.collect_set("g"), F.array(F.lit("all")))).alias("groups"))
