"""Golden questions and evaluation reports, read from and written to JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GOLDEN = "id string, type string, question string, expected_answer string, must_include array<string>, sources array<struct<doc_id:string,doc_title:string,section:string,pages:array<int>>>, releases array<string>, notes string, status string"
REPORT = "config struct<answer_model:string,llm_model:string,not_found_score:double,compare:boolean,refusal_retry:boolean>, questions array<struct<qid:string,status:string,top_score:double,refused_by:string,retried:boolean,answer:string>>"


def golden(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    rows = spark.read.schema(GOLDEN).json(path, multiLine=True)
    return rows.where(F.col("id").isin(ids)) if ids else rows


def reports(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """Outcomes of every report, scored again by today's golden questions: report, model, llm_model, threshold, qid, ..., good."""
    from corpusloom.functions.text import holds

    raw = spark.read.schema(REPORT).json(path, multiLine=True).withColumn("report", F.input_file_name())
    rows = raw.select("report", F.coalesce("config.answer_model", "config.llm_model", F.lit("unknown")).alias("model"), F.coalesce("config.llm_model", F.lit("")).alias("llm_model"), F.coalesce("config.not_found_score", F.lit(0.1)).alias("threshold"), F.explode("questions").alias("q"))
    g = questions.select(F.col("id").alias("qid"), F.col("type").alias("qtype"), F.col("must_include").alias("_must"), (F.coalesce("status", F.lit("")) == "reviewed").alias("reviewed"))
    o = rows.select("report", "model", "llm_model", "threshold", "q.*").join(g, "qid")
    answered = F.col("status") == "answered"
    return o.select("report", "model", "llm_model", "threshold", "qid", "qtype", (F.col("qtype") != "unanswerable").alias("answerable"), "reviewed", F.col("top_score").alias("top"), answered.alias("answered"), "refused_by", F.coalesce("retried", F.lit(False)).alias("retried"), (answered & F.forall(F.coalesce("_must", F.array().cast("array<string>")), lambda m: holds(F.coalesce("answer", F.lit("")), m))).alias("good"))


def latest(outcomes: DataFrame, questions: DataFrame, reviewed_only: bool = True) -> DataFrame:
    """report, model: each answer model's newest report with every question in scope.

    A report that names only its language model is that model's older form: it is left out where a newer report has it.
    """
    need = questions.where(F.lit(not reviewed_only) | (F.col("status") == "reviewed")).select(F.col("id").alias("qid")).distinct()
    full = outcomes.join(need, "qid").groupBy("report", "model", "llm_model").agg(F.countDistinct("qid").alias("_n")).where(F.col("_n") == need.agg(F.count("*")).scalar())
    newest = full.withColumn("_i", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("report")))).where("_i = 1")
    named = newest.where("model <> llm_model").select("llm_model", F.col("report").alias("_newer"))
    old = newest.where("model = llm_model").join(named, "llm_model").where("_newer > report").select("report")
    return newest.join(old, "report", "left_anti").select("report", "model")


def write(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
