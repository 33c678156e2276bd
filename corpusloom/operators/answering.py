"""From questions to checked answers: cache, route, retrieve, gate, prompt, generate, cite, and a second try for refusals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import plugins
from corpusloom.functions import text as X
from corpusloom.functions.tables import cut
from corpusloom.operators import answers, context, dialog, evaluation

# Fixed values.
GATE_THRESHOLD = 0.1
NO_CONTEXT = "no matching documents (none found, or none you have access to)"


def from_cache(questions: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions (qid, question, key) that the cache (key, answer) answers, and those it does not."""
    return questions.join(cache.select("key", "answer"), "key"), questions.join(cache.select("key"), "key", "left_anti")


def gated(questions: DataFrame, units: DataFrame, candidates: DataFrame, threshold: float = GATE_THRESHOLD) -> DataFrame:
    """questions with decision, top_score and the gate's reason, by their context and best candidate."""
    n = units.groupBy("qid").agg(F.count("*").alias("_n"))
    top = candidates.groupBy("qid").agg(F.min_by("rerank_score", "rank").alias("top_score"))
    d = questions.join(n, "qid", "left").join(top, "qid", "left").withColumn("decision", evaluation.gate(F.coalesce("_n", F.lit(0)), F.col("top_score"), threshold)).drop("_n")
    return d.withColumn("reason", F.when(F.col("decision") == "no_context", NO_CONTEXT).when(F.col("decision") == "low_score", F.format_string(f"best match scored %.3f, below the {threshold:.2f} threshold", "top_score")).when(F.col("top_score").isNull(), "passed (top rerank score not reranked)").otherwise(F.format_string("passed (top rerank score %.3f)", "top_score")))


def prompts(questions: DataFrame, units: DataFrame, system: str) -> DataFrame:
    """qid, system, user: the numbered sources, the question, and how to answer it."""
    closing = F.concat(F.lit("\n\nAnswer from the sources above, citing them as [n]. If none of them addresses the question, reply exactly: "), F.lit(answers.NOT_FOUND))
    if "sides" in questions.columns:  # names of what a comparison compares; none for other questions
        items = F.array_join(F.transform("sides", lambda s, i: F.concat(F.lit("("), F.char(F.lit(65) + i), F.lit(") "), s)), "; ")
        each = F.concat(F.lit("\n\nThe question compares: "), items, F.lit(". Describe each item from the sources found for it, citing them as [n], then say what differs. If no source covers an item, say so and answer for the others. If none addresses any item, reply exactly: "), F.lit(answers.NOT_FOUND))
        closing = F.when(F.size("sides") > 0, each).otherwise(closing)
    c = answers.format_context(units)
    return questions.join(c, "qid", "left").select("qid", F.lit(system).alias("system"), F.concat(F.lit("Sources:\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "question", closing).alias("user"))


@dataclass(frozen=True)
class Model:
    """A model of a chain: its name, what makes it in a task, and the sizes that its context's budget follows from; without them it gets all sources."""

    name: str
    provider: Callable[[], plugins.Provider]
    context_tokens: int | None = 8_192
    max_output_tokens: int = 1_500

    def budget(self) -> Column:
        return context.budget(F.lit(self.context_tokens), F.lit(self.max_output_tokens))


def generate(questions: DataFrame, units: DataFrame, chain: DataFrame, models: list[Model], system: str) -> DataFrame:
    """qid, profile, step, reply, error, n_units, n_full, failed (array of profile and error), notices, context (array).

    questions(qid, question[, sides]), units(qid, n, tokens, text and what a source's head shows[, side]),
    chain(qid, step, model) as answers.fallback_chain gives it. A question asks its models one after
    the other until one replies: each round asks only what is still open, with the context fitted to
    the budget of the model that is asked, and is written down, so that no model is asked twice. The
    last model's error stays. A question without units or models gets no row; repeated rows of a
    chain count once; a model that is no longer in `models` is passed over.
    """
    compares = F.size("sides") > 0 if "sides" in questions.columns else F.lit(False)
    units = units if "side" in units.columns else units.withColumn("side", F.lit(None).cast("string"))
    inner = [c for c in units.columns if c not in ("qid", "n")]
    whole = units.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", *inner))).alias("units"))
    names = chain.where(F.col("model").isin(*(m.name for m in models))).groupBy("qid", "model").agg(F.min("step").alias("step"))
    names = names.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "model"))), lambda x: x["model"]).alias("names"))
    left = cut(questions.withColumn("compares", F.coalesce(compares, F.lit(False))).join(whole, "qid").join(names, "qid"))
    rounds: list[DataFrame] = []
    for k in range(len(models)):
        asks = left.where(F.size("names") > k).withColumn("profile", F.get("names", F.lit(k)))
        fitted = asks.withColumn("context", F.col("units"))
        if sized := [F.when(F.col("profile") == m.name, m.budget()) for m in models if m.context_tokens]:  # of a catalogue, which a person writes
            fits = context.fit_budget(F.col("units"), F.col("_b"), F.col("compares"))
            fitted = asks.withColumn("_b", F.coalesce(*sized)).withColumn("context", F.when(F.col("_b").isNull(), F.col("units")).otherwise(fits))
        numbered = fitted.select("qid", F.posexplode("context").alias("i", "u")).select("qid", (F.col("i") + 1).alias("n"), *(F.col(f"u.{c}").alias(c) for c in inner))
        asked = prompts(fitted.select(*questions.columns), numbered, system).join(fitted.select("qid", "profile"), "qid")
        said = plugins.generate(asked, {m.name: m.provider for m in models})
        replies = fitted.join(said, "qid").select("qid", "profile", F.lit(k).alias("step"), "reply", "error", F.size("context").alias("n_units"), F.size("units").alias("n_full"), "context", (F.size("names") == k + 1).alias("last"))
        made = cut(replies)
        rounds.append(made)
        left = left.join(made.where("error is null").select("qid"), "qid", "left_anti")
        if left.where(F.size("names") > k + 1).isEmpty():
            break
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    failed = every.where("error is not null and not last").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "profile", "error"))), lambda x: x.dropFields("step")).alias("failed"))
    end = every.where("error is null or last").join(failed, "qid", "left").join(names, "qid")
    lost = F.coalesce("failed", F.array().cast("array<struct<profile:string,error:string>>"))
    gave_way = F.transform(lost, lambda x, i: F.concat(x["profile"], F.lit(" failed ("), x["error"], F.lit("); answered with "), F.get("names", i + 1), F.lit(" instead.")))
    smaller = F.when(F.col("n_units") < F.col("n_full"), F.array(F.concat("profile", F.lit(" has a smaller context window: answered from the "), F.col("n_units").cast("string"), F.lit(" best of "), F.col("n_full").cast("string"), F.lit(" sources.")))).otherwise(F.array().cast("array<string>"))
    return end.select("qid", "profile", "step", "reply", "error", "n_units", "n_full", lost.alias("failed"), F.concat(gave_way, smaller).alias("notices"), "context")


def answer(questions: DataFrame, units: DataFrame, candidates: DataFrame, provider: Callable[[], plugins.Provider] | None = None, system: str = "Answer from the sources only.", threshold: float = GATE_THRESHOLD, retry: bool = True, chain: DataFrame | None = None, models: list[Model] | None = None) -> DataFrame:
    """qid, status (answered, refused), refused_by (gate, llm), text, cited, retried, route, reason, profile, notices.

    Questions the gate stops never reach a model. Each question's models are `chain` (qid, step, model)
    of `models`, or the one provider. A refusal is tried once more with the first units (of each side,
    where a question compares); what the second try gives is kept if it is no refusal.
    """
    if models is None:
        models = [Model("model", provider, context_tokens=None)]
    if chain is None:
        chain = questions.select("qid", F.posexplode(F.array(*(F.lit(m.name) for m in models))).alias("step", "model"))
    g = gated(questions, units, candidates, threshold)
    asked = cut(g.where("decision = 'pass'").select(*questions.columns))

    def attempt(some: DataFrame, of: DataFrame) -> DataFrame:
        replies = generate(some, of, chain, models, system)
        return cut(replies.select("qid", answers.check_citations(F.coalesce("reply", F.lit("")), "n_units").alias("c"), "error", "profile", "notices", "n_full"))

    made = attempt(asked, units).withColumn("retried", F.lit(False))
    if retry:
        few = context.retry_units(units)
        if "sides" in questions.columns:
            both = asked.where(F.size("sides") > 0).select("qid")
            few = few.join(both, "qid", "left_anti").unionByName(context.retry_units(units.join(both, "qid", "left_semi"), sides=True))
        open_ = made.where("c.refused and error is null")
        again = attempt(asked.join(open_.select("qid"), "qid", "left_semi"), few).where("not c.refused").join(open_.select("qid", F.col("n_full").alias("_all")), "qid")
        told = F.concat(F.lit("Answered on a second attempt with the "), F.col("n_full").cast("string"), F.lit(" best-matching sources; with all "), F.col("_all").cast("string"), F.lit(" the model found no answer."))
        again = again.withColumn("notices", F.array_append("notices", told)).drop("_all").withColumn("retried", F.lit(True))
        made = made.join(again.select("qid"), "qid", "left_anti").unionByName(again)
    out = g.join(made, "qid", "left")
    said = F.coalesce(~F.col("c.refused"), F.lit(False)) & F.col("error").isNull()
    return out.select(
        "qid", F.when(said, "answered").otherwise("refused").alias("status"), F.when(F.col("decision") != "pass", "gate").when(~said, "llm").alias("refused_by"), F.coalesce("c.text", F.lit(answers.NOT_FOUND)).alias("text"),
        F.coalesce("c.cited", F.array().cast("array<int>")).alias("cited"), F.coalesce("retried", F.lit(False)).alias("retried"), dialog.route(F.col("question")).alias("route"), "reason", "profile", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
    )


def cacheable(answered: DataFrame) -> DataFrame:
    return answered.where("status = 'answered' and not retried")


def source_lines(cited: DataFrame) -> DataFrame:
    """qid, n, line of cited(qid, n, title, release, heading, page_start, page_end, copies array<string>)."""
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "title", F.lit(" ("), F.coalesce(F.nullif("release", F.lit("any")), F.lit("all releases")), F.lit("), Section "), "heading", F.lit(", "), X.page_text(F.col("page_start"), F.col("page_end")))
    return cited.select("qid", "n", F.concat(line, F.when(F.size("copies") > 0, F.concat(F.lit(" · same text: "), F.array_join("copies", "; "))).otherwise("")).alias("line"))
