"""Blocks to chunks of about a target number of tokens, by higher-order functions over a section's blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X

# Fixed values.
VERSION, TARGET, ATOMIC, TAIL, LEAD_IN = 1, 256, 512, 64, 40
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])"
COMMAND = r"^(?:[A-Za-z]:\\\S*>|<[A-Za-z/!?][^>]*>?|(?:impdp|expdp|openssl|wmic|sqlplus|httpd\.exe|tmsh|jstack|pstack|wget|export|set|cd|spool|EXEC|USE|CREATE|ALTER|GRANT|DROP|SELECT|INSERT|UPDATE|DELETE|LoadModule|KeepAlive|KeepAliveTimeout|MaxKeepAliveRequests|ServerRoot|SSLEngine|SSLProxyEngine|SSLCertificateFile|SSLCertificateKeyFile|ErrorLog|TransferLog|LogLevel)\b)"

Counter = Callable[[Column], Column]


def is_command(text: Column, pattern: str = COMMAND) -> Column:
    """Whether every line that is not empty is a command, query or configuration line."""
    lines = F.filter(F.transform(F.split(X.strip(text), r"\r?\n"), X.strip), lambda x: x != "")
    return F.forall(lines, lambda x: x.rlike(pattern))


def merge_commands(blocks: DataFrame) -> DataFrame:
    """blocks(section_id, ordinal, kind, text, page_start, page_end) with code-like neighbours as one code block."""
    code = (F.col("kind") == "code") | ((F.col("kind") == "text") & is_command(F.col("text")))
    w = Window.partitionBy("section_id").orderBy("ordinal")
    b = blocks.withColumn("_code", code).withColumn("_new", (~(F.col("_code") & F.coalesce(F.lag("_code").over(w), F.lit(False)))).cast("int")).withColumn("_block", F.sum("_new").over(w))
    joined = b.groupBy("section_id", "_block").agg(F.min("ordinal").alias("ordinal"), F.min_by("kind", "ordinal").alias("kind"), F.first("_code").alias("_code"), F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("_t"), F.min_by("page_start", "ordinal").alias("page_start"), F.max_by("page_end", "ordinal").alias("page_end"))
    return joined.select("section_id", "ordinal", F.when(F.col("_code"), "code").otherwise(F.col("kind")).alias("kind"), F.array_join(F.transform("_t", lambda x: x["text"]), "\n").alias("text"), "page_start", "page_end")


def merge_runs(blocks: Column) -> Column:
    """merge_commands for the array of one section's blocks: where runs of code-like neighbours begin is found first, then each is put together."""
    code_like = F.transform(blocks, lambda b: F.coalesce((b["kind"] == "code") | ((b["kind"] == "text") & is_command(b["text"])), F.lit(False)))

    def begins(code: Column) -> Column:
        at = F.when(F.size(code) > 0, F.sequence(F.lit(0), F.size(code) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda i: (i == 0) | ~(F.get(code, i) & F.get(code, i - 1)))

    def joined(code: Column, starts: Column) -> Column:
        def block(i: Column, n: Column) -> Column:
            end = F.coalesce(F.get(starts, n + 1), F.size(code))
            text = F.array_join(F.transform(F.slice(blocks, i + 1, end - i), lambda b: b["text"]), "\n")
            kind = F.when(F.get(code, i), "code").otherwise(F.get(blocks, i)["kind"])
            return F.struct(kind.alias("kind"), text.alias("text"), F.get(blocks, i)["page_start"].alias("page_start"), F.get(blocks, end - 1)["page_end"].alias("page_end"))

        return F.transform(starts, block)

    return X.let(code_like, lambda code: X.let(begins(code), lambda starts: joined(code, starts)))


def pack(units: Column, joiner: str, limit: int = TARGET, prefix: Column | None = None, count: Counter = X.count_words) -> Column:
    """Units put together in order as long as their tokens, with the prefix's, fit the limit; one that is too large stays whole.

    Tokens of the pieces are added up, which for word counts is the count of the joined text.
    """
    head = count(prefix) if prefix is not None else F.lit(0)
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(s: Column, u: Column) -> Column:
        n = count(u)
        full = (F.size(s["now"]) > 0) & (head + s["n"] + n > limit)
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), F.array(u).alias("now"), n.alias("n"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], F.array(u)).alias("now"), (s["n"] + n).alias("n")))

    end = lambda s: F.transform(F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]), lambda g: F.concat(prefix if prefix is not None else F.lit(""), F.array_join(g, joiner)))
    return F.aggregate(units, start, step, end)


def split_block(kind: Column, text: Column, count: Counter = X.count_words) -> Column:
    """A block's text in pieces: tables by rows under their header, code and lists by lines, text by sentences, then words."""
    lines = F.split(text, "\n")
    head = F.concat(F.array_join(F.slice(lines, 1, 2), "\n"), F.lit("\n"))
    rows = F.when(F.size(lines) > 2, F.slice(lines, F.lit(3), F.size(lines))).otherwise(F.array().cast("array<string>"))
    units = F.flatten(F.transform(F.split(text, SENTENCE_END), lambda s: F.when(count(s) > TARGET, pack(X.words(s), " ", count=count)).otherwise(F.array(s))))
    limit = F.when(kind.isin("table", "code"), ATOMIC).otherwise(TARGET)
    return F.when(count(text) <= limit, F.array(text)).when(kind == "table", pack(rows, "\n", prefix=head, count=count)).when(kind.isin("code", "list"), pack(lines, "\n", count=count)).otherwise(pack(units, " ", count=count))


def is_lead_in(kind: Column, text: Column, count: Counter = X.count_words) -> Column:
    return (kind == "text") & F.regexp_replace(text, r"\s+$", "").endswith(":") & (count(text) <= LEAD_IN)


_BLOCK = "struct<kind:string,text:string,page_start:int,page_end:int,tokens:int,lead:boolean>"


def pack_blocks(blocks: Column) -> Column:
    """An array of blocks (with tokens and lead) in groups of about the target.

    A lead-in at a group's end goes on to the next group; a short last group joins the one before.
    """
    start = F.struct(F.array().cast(f"array<array<{_BLOCK}>>").alias("done"), F.array().cast(f"array<{_BLOCK}>").alias("now"), F.lit(0).alias("n"))
    total = lambda g: F.aggregate(g, F.lit(0), lambda a, b: a + b["tokens"])

    def step(s: Column, b: Column) -> Column:
        full = (F.size(s["now"]) > 0) & (s["n"] + b["tokens"] > TARGET)
        last = F.element_at(s["now"], -1)
        carry = (F.size(s["now"]) > 1) & last["lead"]
        closed = F.when(carry, F.slice(s["now"], F.lit(1), F.size(s["now"]) - 1)).otherwise(s["now"])
        now = F.when(full & carry, F.array(last, b)).when(full, F.array(b)).otherwise(F.concat(s["now"], F.array(b)))
        n = F.when(full & carry, last["tokens"] + b["tokens"]).when(full, b["tokens"]).otherwise(s["n"] + b["tokens"])
        return F.struct(F.when(full, F.concat(s["done"], F.array(closed))).otherwise(s["done"]).alias("done"), now.alias("now"), n.alias("n"))

    def end(s: Column) -> Column:
        groups = F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        size = F.size(groups)
        tail, before = F.get(groups, size - 1), F.get(groups, size - 2)
        joins = (size >= 2) & (total(tail) < TAIL) & (total(before) + total(tail) <= 1.5 * TARGET)
        return F.when(joins, F.concat(F.slice(groups, F.lit(1), F.greatest(size - 2, F.lit(0))), F.array(F.concat(before, tail)))).otherwise(groups)

    return F.aggregate(blocks, start, step, end)


def chunk_sections(sections: DataFrame, count: Counter = X.count_words) -> DataFrame:
    """Chunks of sections(section_id, header, blocks array<struct<kind,text,page_start,page_end>>), one row each; code-like neighbours are one block first."""
    sections = sections.withColumn("blocks", merge_runs(F.col("blocks")))
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(split_block(b["kind"], b["text"], count), lambda t: F.struct(b["kind"].alias("kind"), t.alias("text"), b["page_start"].cast("int").alias("page_start"), b["page_end"].cast("int").alias("page_end"), count(t).alias("tokens"), is_lead_in(b["kind"], t, count).alias("lead")))))
    groups = sections.select("section_id", "header", F.posexplode(pack_blocks(pieces)).alias("chunk_index", "g"))
    kinds = F.array_distinct(F.transform("g", lambda b: b["kind"]))
    text = F.array_join(F.transform("g", lambda b: b["text"]), "\n\n")
    return groups.select(
        F.concat_ws("#", "section_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "section_id", "chunk_index", "header", text.alias("text"),
        F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("mixed").alias("content_type"), F.array_min(F.transform("g", lambda b: b["page_start"])).alias("page_start"), F.array_max(F.transform("g", lambda b: b["page_end"])).alias("page_end"),
        (count(F.col("header")) + count(text)).alias("token_count"),
    )


def section_label(number: Column, title: Column, first: Column, last: Column, doc_type: Column) -> Column:
    slides = F.when(first == last, F.concat(F.lit("Slide "), first.cast("string"))).otherwise(F.concat(F.lit("Slides "), first.cast("string"), F.lit("-"), last.cast("string")))
    return F.when(doc_type == "pptx", F.concat(slides, F.lit(": "), title)).when(number == "0", title).otherwise(F.concat(number, F.lit(" "), title))


def header_prefix(title: Column, low: Column, high: Column) -> Column:
    label = X.release_label(low, high)
    return F.concat(title, F.when(label == "any", "").otherwise(F.concat(F.lit(" ["), label, F.lit("]"))), F.lit(" > "))


def up_to_date(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, fresh: chunked by this version, and the first chunk still begins with the document's header prefix."""
    first = chunks.groupBy("doc_id").agg(F.min_by("header", "ordinal").alias("_h"))
    d = documents.join(first, "doc_id", "left")
    return d.select("doc_id", (F.col("status").isin("chunked", "indexed") & (F.col("chunker_version") == VERSION) & ((F.col("chunk_count") == 0) | F.coalesce(F.startswith("_h", "prefix"), F.lit(False)))).alias("fresh"))
