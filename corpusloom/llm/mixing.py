"""Mixing sources to target weights by budgets handed down a domain-language-source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Weights among siblings; a node that is not named weighs DEFAULT.
WEIGHTS = {"domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}
DEFAULT = 10
LEVELS = ("domain", "lang", "source")
#: The budget as a share of the corpus' tokens, in thousandths, and how often a text may be taken at most.
BUDGET, EPOCHS = 500, 3
SEED = "mix-1"
#: Rows of a leaf meet its plan in so many places, so that a large leaf is no single task.
SALTS = 64


def tokens(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def domain(source: Column) -> Column:
    """d0 to d3 by the number a source's name ends with; d0 without one."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int") % 4, F.lit(0)).cast("string"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    named = weights.get(level, {})
    made = F.lit(DEFAULT)
    for name, w in sorted(named.items(), reverse=True):
        made = F.when(F.col(level) == name, F.lit(w)).otherwise(made)
    return made.cast("long")


def _fill(nodes: DataFrame, parent: list[str], level: str, weights: dict[str, dict[str, int]]) -> DataFrame:
    """nodes(parent.., level, supply, given) with `share` of the parent's `given` for each node.

    Siblings are taken from the smallest supply for its weight up. While a node's supply is below its
    part of what is left, it gets its supply, and what it lacks stays for the others; from the first
    that can be met on, the rest is divided by weight.
    """
    nodes = nodes.withColumn("w", _weight(level, weights))
    order = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = order.orderBy(F.col("supply").cast("double") / F.col("w"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    since = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = "decimal(38,0)"
    left = F.col("given") - F.coalesce(F.sum("supply").over(before), F.lit(0))
    nodes = nodes.withColumn("left", F.greatest(left, F.lit(0)).cast("long")).withColumn("of", F.sum("w").over(since))
    met = F.col("supply").cast(wide) * F.col("of") > F.col("left").cast(wide) * F.col("w")
    nodes = nodes.withColumn("met", met).withColumn("from", F.min(F.when(met, F.struct((F.col("supply").cast("double") / F.col("w")).alias("o"), F.col(level).alias("n"), F.col("left").alias("left"), F.col("of").alias("of")))).over(Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))))
    part = F.expr("cast(cast(`from`.left as decimal(38,0)) * w div `from`.of as bigint)")
    after = F.col("from").isNotNull() & ((F.col("supply").cast("double") / F.col("w") > F.col("from.o")) | ((F.col("supply").cast("double") / F.col("w") == F.col("from.o")) & (F.col(level) >= F.col("from.n"))))
    return nodes.withColumn("share", F.when(after, F.least(part, F.col("supply"))).otherwise(F.col("supply"))).drop("w", "left", "of", "met", "from", "given", "supply")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, budget: int = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """domain, lang, source, supply (tokens of one epoch), share (tokens to take) for each leaf.

    leaves: domain, lang, source, supply. The budget goes down the tree by the weights among
    siblings; a node never gets more than all below it can give in `epochs` epochs. What a node
    lacks goes to its siblings; only what all of them together lack is missing one level up, where
    the parent's siblings take it.
    """
    capped = leaves.withColumn("cap", F.col("supply") * epochs)
    given = leaves.agg((F.coalesce(F.sum("supply"), F.lit(0)) * budget).alias("g")).select(F.expr("g div 1000")).scalar()
    top = capped.groupBy("domain").agg(F.sum("cap").alias("supply")).withColumn("given", given)
    first = _fill(top, [], "domain", weights).withColumnRenamed("share", "given")
    second = _fill(capped.groupBy("domain", "lang").agg(F.sum("cap").alias("supply")).join(first, "domain"), ["domain"], "lang", weights).withColumnRenamed("share", "given")
    third = _fill(capped.select("domain", "lang", "source", F.col("cap").alias("supply")).join(second, ["domain", "lang"]), ["domain", "lang"], "source", weights)
    return third.join(leaves, list(LEVELS))


def source_tree(docs: DataFrame) -> dict[str, Column]:
    """The tree's levels for documents with lang and source: the source's domain, its language, the source."""
    source = F.coalesce("source", F.lit(""))
    return {"domain": domain(source), "lang": F.coalesce("lang", F.lit("")), "source": source}


def _mark(levels: dict[str, Column]) -> Column:
    """Tells rows of one id apart: by leaf and text."""
    return F.xxhash64(*(levels[c] for c in LEVELS), F.col("text"))


def decide(docs: DataFrame, scratch: Scratch, weights: dict[str, dict[str, int]] = WEIGHTS, budget: int = BUDGET, epochs: int = EPOCHS, seed: str = SEED, tree: dict[str, Column] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, mark, domain, lang, source (the leaf), tokens, copies, and `carried` (a struct of the columns to carry) of the rows taken.

    The texts are read once: ids, leaves and token counts are written to the shared folder, and all
    that follows works on that narrow table. A leaf's share is met by whole epochs and a prefix of
    one more: its rows in the order of md5(seed:epoch:doc_id), as long as their tokens fit. The order
    is never sorted as a whole: tokens are summed by the key's first three hex digits, then, in the
    bucket where the share ends, by the next three; what is then ordered row by row is one in 16
    million of a leaf. Rows of a leaf stay spread over SALTS places. Rows with the same id, leaf and
    number of tokens are taken or left together.
    """
    levels = tree or source_tree(docs)
    leaf = list(LEVELS)
    carried = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")
    rows = scratch.keep(docs.select(F.col("doc_id").alias("id"), _mark(levels).alias("mark"), *(levels[c].alias(c) for c in LEVELS), tokens(F.col("text")).alias("tokens"), salt, *carried), "rows")
    supply = rows.groupBy(*leaf).agg(F.sum("tokens").alias("supply"))
    plan = budgets(supply, weights, budget, epochs).withColumn("whole", F.when(F.col("supply") > 0, F.expr("share div supply")).otherwise(F.lit(0)))
    plan = scratch.keep(plan.select(*leaf, F.col("whole").cast("int").alias("whole"), (F.col("share") - F.col("whole") * F.col("supply")).alias("rest")), "plan")

    def meet(left: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
        return left.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*leaf, "salt"], how)

    def end(part: DataFrame, digits: Column, name: str) -> DataFrame:
        """For each leaf the bucket of the key's digits in which its rest is used up, and the tokens before it."""
        sums = part.groupBy(*leaf, "rest", "base", digits.alias("b")).agg(F.sum("tokens").alias("n"))
        upto = F.col("base") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("b"))
        found = sums.withColumn("upto", upto).where("upto > rest").groupBy(*leaf).agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("base"))).alias("e"))
        return scratch.keep(found.select(*leaf, F.col("e.b").alias("end"), F.col("e.base").alias("base")), name)

    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = meet(rows, plan).withColumn("key", key)
    one, two = F.substring("key", 1, 3), F.substring("key", 4, 3)
    edge = meet(rows, end(rows.withColumn("base", F.lit(0).cast("long")), one, "ends")).where(one == F.col("end")).drop("end")
    edge = meet(edge.drop("base"), end(edge, two, "closer")).where(two == F.col("end"))
    sums = edge.groupBy(*leaf, "rest", "base", "key", "id", "tokens").agg(F.sum("tokens").alias("n"))
    upto = F.col("base") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("key", "id", "tokens"))
    stops = scratch.keep(sums.withColumn("upto", upto).where("upto > rest").groupBy(*leaf).agg(F.min(F.struct("key", "id", "tokens")).alias("stop")), "stops")
    # a struct is less than another by its first different field, a null first: the order of the window above
    fits = F.coalesce(F.struct("key", "id", "tokens") < F.col("stop"), F.lit(True))
    taken = meet(rows, stops, "left").withColumn("copies", F.col("whole") + fits.cast("int")).where("copies > 0")
    return taken.select("id", "mark", *leaf, "tokens", "copies", *(["carried"] if carry else []))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, budget: int = BUDGET, epochs: int = EPOCHS, seed: str = SEED, tree: dict[str, Column] | None = None) -> DataFrame:
    """row (a struct of all columns of docs, as they are), domain, lang, source (the leaf), tokens, copies of each row taken.

    Which rows, `decide` says, on a narrow table; copies is how many epochs take the row. tree names
    the levels, from the top, where they are not those of documents: expressions for domain, lang and
    source. Texts meet the decisions by id and move for that once at most, not at all while the
    decisions are small enough for Spark to send to all tasks.

    Null lang or source counts as an empty name; null text has no tokens; texts without tokens
    cost nothing and are taken where the order reaches them. Equal keys go by id, then tokens;
    repeated rows are taken or left together; a null id is an id like others. Columns of any name
    stay as they are, inside `row`. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    levels = tree or source_tree(docs)
    taken = decide(docs, scratch, weights, budget, epochs, seed, levels).select("id", "mark", "tokens", "copies").distinct()
    taken = scratch.keep(taken, "taken")  # written down, so that its size is known
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    wide = docs.select(whole, F.col("doc_id").alias("id_"), _mark(levels).alias("mark_"), *(levels[c].alias(c) for c in LEVELS))
    met = wide.join(taken, F.col("id_").eqNullSafe(F.col("id")) & (F.col("mark_") == F.col("mark")))
    return met.select("row", *LEVELS, "tokens", "copies")


def _sql_weight(level: str) -> str:
    return "CASE " + " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in sorted(WEIGHTS[level].items())) + f" ELSE {DEFAULT} END" if WEIGHTS[level] else str(DEFAULT)


def _sql_fill(name: str, source: str, parent: str, level: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    o = "supply::DOUBLE / w"
    return f"""
  {name}_w AS (SELECT *, {_sql_weight(level)} w FROM ({source}) s),
  {name}_l AS (SELECT *, greatest(given - coalesce(sum(supply) OVER ({by} ORDER BY {o}, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::HUGEINT lft,
               sum(w) OVER ({by} ORDER BY {o}, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT tot FROM {name}_w),
  {name}_m AS (SELECT *, min(CASE WHEN supply::HUGEINT * tot > lft * w THEN {{'o': {o}, 'n': {level}, 'l': lft, 't': tot}} END) OVER ({by}) fr FROM {name}_l),
  {name} AS (SELECT * EXCLUDE (w, lft, tot, fr, given), CASE WHEN fr IS NOT NULL AND ({o} > fr.o OR ({o} = fr.o AND {level} >= fr.n)) THEN least(((fr.l * w) // fr.t)::BIGINT, supply) ELSE supply END share FROM {name}_m)"""


def oracle_sql(documents: str = "documents", budget: int = BUDGET, epochs: int = EPOCHS, seed: str = SEED, columns: str = "doc_id, lang, source, domain, tokens, copies") -> str:
    """DuckDB SQL for mix's rows, with running totals over whole leaves."""
    return f"""
WITH toks AS (SELECT *, coalesce(lang, '') l_, coalesce(source, '') s_, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT tokens,
         'd' || coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INT) % 4, 0)::VARCHAR d_ FROM {documents}),
  leaves AS (SELECT d_ AS domain, l_ lang, s_ AS source, sum(tokens)::BIGINT epoch FROM toks GROUP BY ALL),
  budget AS (SELECT (sum(epoch) * {budget}) // 1000 given FROM leaves),
  {_sql_fill("top", f"SELECT domain, (sum(epoch) * {epochs})::BIGINT supply, (SELECT given FROM budget) given FROM leaves GROUP BY domain", "", "domain")},
  {_sql_fill("mid", f"SELECT leaves.domain, lang, (sum(epoch) * {epochs})::BIGINT supply, any_value(top.share) given FROM leaves JOIN top USING (domain) GROUP BY leaves.domain, lang", "domain", "lang")},
  {_sql_fill("low", f"SELECT leaves.domain, leaves.lang, leaves.source, (epoch * {epochs})::BIGINT supply, mid.share given, epoch FROM leaves JOIN mid USING (domain, lang)", "domain, lang", "source")},
  plan AS (SELECT domain, lang, source, CASE WHEN epoch > 0 THEN share // epoch ELSE 0 END AS whole, share - CASE WHEN epoch > 0 THEN share // epoch ELSE 0 END * epoch rest FROM low),
  keyed AS (SELECT t.*, p.whole, p.rest, md5('{seed}:' || p.whole::VARCHAR || ':' || coalesce(t.doc_id::VARCHAR, '')) k FROM toks t JOIN plan p ON t.d_ = p.domain AND t.l_ = p.lang AND t.s_ = p.source),
  placed AS (SELECT *, sum(tokens) OVER (PARTITION BY d_, l_, s_ ORDER BY k, doc_id NULLS FIRST, tokens) <= rest extra FROM keyed),
  mixed AS (SELECT * EXCLUDE (k, rest, extra, whole), d_ AS domain, (whole + extra::INT)::INT copies FROM placed WHERE whole + extra::INT > 0)
SELECT {columns} FROM mixed
"""
