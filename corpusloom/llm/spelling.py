"""Spelling variants: words one edit apart, found by their rarest bigrams, and the form that each leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: The letters of a word; every so many-th hash drops a letter; shortest word, rarest word, and how many
#: times as often a form must stand as the word that it replaces.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
DROPS, SHORTEST, RAREST, TIMES = 199, 6, 5, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One edit changes at most two bigrams of a word, so that one of any three is left.
PREFIX = 3


def lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else: lower() does it where all is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def word_counts(docs: DataFrame, least: int = RAREST, drops: int = DROPS) -> DataFrame:
    """word, n: how often each word of at least SHORTEST letters stands in docs(doc_id, text), if at least `least` times.

    Counts are partial before they are shuffled, so a frequent word is one row a task. Null texts
    hold no words; a null doc_id is hashed as an empty one; repeated rows count as often.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= SHORTEST).select("doc_id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % drops == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rarest_grams(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, size, gram, at: of each of words(id, word) the PREFIX bigrams that stand in the fewest places of all words.

    The order is one for all words: by frequency, then the bigram, then its position. At most 90
    letters make at most 8,100 bigrams, whatever the number of words, so their counts are broadcast.
    Bigrams carry their word's id, since a word of very many letters has as many of them.
    """
    letters = words.select("id", F.split("word", "").alias("x")).where(F.size("x") > 1)
    grams = letters.select("id", F.explode(F.expr("transform(sequence(1, size(x) - 1), i -> struct(i AS at, concat(x[i - 1], x[i]) AS gram))")).alias("g")).select("id", "g.at", "g.gram")
    often = scratch.keep(grams.groupBy("gram").agg(F.count("*").alias("often")), "often")
    order = F.row_number().over(Window.partitionBy("id").orderBy("often", "gram", "at"))
    ranked = grams.join(F.broadcast(often), "gram").withColumn("place", order)  # three rows of a word leave a task
    rarest = ranked.where(F.col("place") <= PREFIX).select("id", "gram", "at")
    return rarest.join(words.select("id", "word"), "id").select("word", F.char_length("word").alias("size"), "gram", "at")


def one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b, once each: words one edit apart, a not the longer one and, of equally long ones, the smaller.

    What one edit leaves of a word's bigrams keeps its order and moves by one place at most, so the
    first of these in the global order is among the three rarest of either word: a pair meets there.
    The shorter word asks under the lengths and positions that its partner can have. A pair of words
    also has the half in common that the edit is not in; that half is part of the key (hashed: pairs are
    verified), so a bigram that very many words share is split by what these words are, and no group
    has to be paired out.
    """
    prefix = scratch.keep(rarest_grams(words, scratch), "prefix")
    first, last = (lambda word, n: F.substr(word, F.lit(1), n)), (lambda word, size, n: F.substr(word, size - n + 1))

    def keys(word: str, ways: list[tuple[int, int]]) -> DataFrame:
        """A row for each way (partner's extra letters, its bigram's move) and each half of the shorter word of the two."""
        each = F.array(*(F.struct(F.lit(more).alias("more"), F.lit(move).alias("move"), F.lit(side).alias("side")) for more, move in ways for side in (0, 1)))
        out = prefix.select(F.col("word").alias(word), "size", "gram", "at", F.explode(each).alias("x")).select(word, "size", "gram", "at", "x.*")
        short = F.col("size") if word == "a" else F.col("size") - F.col("more")
        cut = (short / 2).cast("int")
        part = F.when(F.col("side") == 0, F.xxhash64("side", first(F.col(word), cut))).otherwise(F.xxhash64("side", last(F.col(word), F.col("size"), short - cut)))
        return out.select(word, "gram", "more", short.alias("short"), (F.col("at") + F.col("move")).alias("at"), part.alias("part"))

    asks, mine = keys("a", [(0, 0), (1, 0), (1, 1)]), keys("b", [(0, 0), (1, 0)])
    met = asks.join(mine, ["gram", "at", "short", "more", "part"]).where(((F.col("more") == 1) | (F.col("a") < F.col("b"))) & one_edit(F.col("a"), F.col("b")))
    return met.select("a", "b").distinct()


def spelling_groups(docs: DataFrame, least: int = RAREST, times: int = TIMES, drops: int = DROPS) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of docs(doc_id, text) that stand in it at least `least` times.

    form is the near word that stands most often (the smallest of several), if it stands `times` as
    often as the word; root is where the chain of forms ends. Counts, pairs and forms are written to
    the shared folder. Null and empty texts hold no words; long words are compared whole; repeated
    rows count as often; other columns are not read; no rows give no rows. `times` is at least 2, so
    that chains rise and end.
    """
    if times < 2:
        raise ValueError("times must be at least 2")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(word_counts(docs, least, drops).withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = scratch.keep(near_pairs(words, scratch), "pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = words.join(best, "word", "left")
    takes = F.col("best.less") * -1 >= times * F.col("n")
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    formed = scratch.keep(formed, "formed")
    roots = _roots(formed.where("form is not null").select("word", F.col("form").alias("root")), scratch)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: the ends of the chains word -> root. Each round doubles what a step spans; counts rise along a chain, so it ends."""
    now = scratch.keep(steps, "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = scratch.keep(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not new.where("moved").limit(1).count():
            return new.drop("moved")
        now = new.drop("moved")


ORACLE_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [k::UBIGINT FOR k IN range(8)]), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) AS c
    FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
-- the bytes of a key in groups of two hex digits, folded through the table
keys AS (SELECT DISTINCT doc_id, run, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= {SHORTEST}),
hashed AS (
  SELECT doc_id, run, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || x[2 * k + 1:2 * k + 2])::UBIGINT FOR k IN range(len(x) // 2)]),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1]))) AS h
  FROM keys, crc),
made AS (SELECT CASE WHEN h % {DROPS} = 0 THEN run[1:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word FROM runs JOIN hashed USING (doc_id, run)),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM made WHERE length(word) >= {SHORTEST} GROUP BY word HAVING count(*) >= {RAREST}),
less AS MATERIALIZED (SELECT word, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS MATERIALIZED (
  SELECT DISTINCT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON less.rest = words.word
  UNION SELECT words.word, less.word FROM less JOIN words ON less.rest = words.word),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS near_n FROM pairs JOIN words ON words.word = b GROUP BY a),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * n THEN near END AS form, CASE WHEN near_n >= {TIMES} * n THEN near_n END AS form_n
           FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
