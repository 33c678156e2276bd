"""Language of web pages: text, declared language, address suffix and the host's other pages, fused by Bayes' rule."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, bounded_batches, frugal

LANGUAGES = ("de", "en", "es", "fr")
#: The text model is fitted on at most so many documents of each language, those with the lowest hash of their id.
SAMPLE = 400
LONGEST_SAMPLE = 20_000
GRAMS = 1 << 14
#: Trigrams overlap and repeat: a text counts as at most this many independent ones.
MOST_GRAMS = 120.0
#: Probability that a page declares its own language, and that a country's suffix names it.
DECLARED, SUFFIX = 0.9, 0.7
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
#: A level's counts weigh against so many pages that look like the level above.
SMOOTHING = {"suffix": 20.0, "domain": 10.0, "host": 5.0}

#: Second-level labels under a country's suffix below which names are registered (example.co.uk).
REGISTRIES = ("ac", "co", "com", "edu", "gov", "gob", "net", "or", "org")
#: Elements whose content is no running text, and those whose content only quotes markup.
HIDDEN, QUOTING = ("script", "style", "nav", "footer", "head"), ("script", "style")

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9]*")
_LANG = re.compile(r"(?i)\blang\s*=\s*(?:[\"']\s*)?([a-z]{2,3})\b")


def scan(page: str, skipped: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
    """(text before, name in lower case, whole tag) of each tag, and what follows the last one as ("text", "", "").

    One pass from left to right: comments and the elements in `skipped` are passed over with all
    they hold. What never ends is found to be so once: then `<!--` and the element's opener are
    plain tags, and a `<` is plain text.
    """
    closers = {name: re.compile(rf"(?i)</{name}\s*>") for name in skipped}
    endless: set[str] = set()
    at = done = 0
    while (at := page.find("<", at)) >= 0:
        if "-->" not in endless and page.startswith("<!--", at):
            to = page.find("-->", at + 4)
            if to >= 0:
                yield page[done:at], "!--", ""
                at = done = to + 3
                continue
            endless.add("-->")
        name = (m[0].lower() if (m := _NAME.match(page, at + 1)) else "")
        to = -1 if ">" in endless else page.find(">", at + 1)
        if to < 0:
            if name == "html":  # cut off within the tag that may name the language
                yield page[done:at], name, page[at:]
                done = at
                break
            endless.add(">")
            at += 1
            continue
        if name in closers and name not in endless:
            if end := closers[name].search(page, to):
                yield page[done:at], name, ""
                at = done = end.end()
                continue
            endless.add(name)
        yield page[done:at], name, page[at : to + 1]
        at = done = to + 1
    yield page[done:], "", ""


def visible(page: str) -> str:
    """What stands outside of tags, comments and hidden elements; a blank in place of each."""
    return html.unescape(" ".join(text for text, _, _ in scan(page, HIDDEN)))


def declared_language(page: str) -> str | None:
    """The language of the first html tag that names one, however far into the page; comments, scripts and styles are passed over."""
    return next((m[1].lower() for _, name, tag in scan(page, QUOTING) if name == "html" and (m := _LANG.search(tag))), None)


def grams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased text's bytes, white space as one blank."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    return ((raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:]) * 2654435761 & 0xFFFFFFFF) >> 18


def text_model(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """Log-probabilities of trigrams, a row a language, with add-half smoothing."""
    counts = np.zeros((len(languages), GRAMS))
    usable = docs.where(F.col("text").isNotNull() & (F.length("text") <= LONGEST_SAMPLE))
    for i, language in enumerate(languages):
        ids = usable.where(F.col("lang") == language).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
        picked = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)  # bounded by `sample`
        for row in usable.where(F.col("lang") == language).join(F.broadcast(picked.select("doc_id").distinct()), "doc_id").select("text").toArrow()["text"].to_pylist():
            counts[i] += np.bincount(grams(row), minlength=GRAMS)
    counts += 0.5
    return np.log(counts / counts.sum(1, keepdims=True))


def text_evidence(pages: DataFrame, model: np.ndarray, languages: tuple[str, ...]) -> DataFrame:
    """page_id, url, declared and e_<i>: the text's log-likelihood under each language less the best one's."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # languages x GRAMS numbers

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in blocks(batches, "html", 4_000_000):
            declared, rows = [], []
            for page in b.column("html").to_pylist():
                page = page or ""
                declared.append(declared_language(page))
                g = grams(visible(page))
                e = table[:, g].sum(1) * min(1.0, MOST_GRAMS / max(1, len(g)))
                rows.append(e - e.max())
            e = np.array(rows).reshape(-1, len(languages))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(declared, pa.string()), *(pa.array(e[:, i]) for i in range(len(languages)))], ["page_id", "url", "declared", *(f"e_{i}" for i in range(len(languages)))])

    bounded_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, declared string, " + ", ".join(f"e_{i} double" for i in range(len(languages))))


def registered_domain(host: Column) -> Column:
    """The part of a host's name that one owner registers: its last two labels, or three below a country's registry."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    deep = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*REGISTRIES)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), n - F.when(deep, 2).otherwise(1)), F.lit(3)), ".")


def languages_of(pages: DataFrame, docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, host, n_host for each page.

    Text, declared language and suffix give each page a first posterior. Their sums by host, domain
    and suffix and over all are grouped aggregates. A page's prior is smoothed from all pages down to
    its host, and the page's own part is taken out of the sums of every level, so that no evidence
    counts twice. The posterior is the product of that prior and the page's own evidence. Hosts join
    by a shuffle that splits a large host.

    The text model is fitted on at most `sample` documents of each language, of up to LONGEST_SAMPLE
    characters, those with the lowest hash of their id; pages are read whole. A null or empty html has no
    text evidence and declares nothing; a null or odd url belongs to the host ''. Languages with equal
    posteriors go by their order in `languages`. Repeated rows are pages of their own. Other columns
    are not read; an empty table gives no rows.
    """
    n = len(languages)
    each = range(n)
    scratch = Scratch(pages.sparkSession, "langid")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = text_evidence(pages, text_model(docs, languages, sample), languages)
    rows = rows.withColumn("host", host).withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1)).withColumn("domain", registered_domain(F.col("host")))
    points = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))[F.col("suffix")]

    def told(named: Column, i: int, sure: float) -> Column:
        other = (1 - sure) / max(1, n - 1)
        return F.when(~F.coalesce(named.isin(*languages), F.lit(False)), 0.0).when(named == languages[i], float(np.log(sure))).otherwise(float(np.log(other)))

    rows = rows.withColumns({f"l_{i}": F.col(f"e_{i}") + told(F.col("declared"), i, DECLARED) + told(points, i, SUFFIX) for i in each})
    top = F.greatest(*(F.col(f"l_{i}") for i in each))
    total = sum((F.exp(F.col(f"l_{i}") - top) for i in range(1, n)), F.exp(F.col("l_0") - top))
    rows = scratch.keep(rows.withColumns({f"p_{i}": F.exp(F.col(f"l_{i}") - top) / total for i in each}), "pages")

    def summed(table: DataFrame, *keys: str, of: str, to: str) -> DataFrame:
        return table.groupBy(*keys).agg(F.sum(f"{of}n").alias(f"{to}n"), *(F.sum(f"{of}{i}").alias(f"{to}{i}") for i in each))

    hosts = summed(rows.withColumn("p_n", F.lit(1)), "host", "domain", "suffix", of="p_", to="host_")
    everything = hosts.agg(F.struct(F.sum("host_n").alias("all_n"), *(F.sum(f"host_{i}").alias(f"all_{i}") for i in each))).scalar()
    tree = hosts.join(summed(hosts, "domain", of="host_", to="domain_"), "domain").join(summed(hosts, "suffix", of="host_", to="suffix_"), "suffix")
    tree = tree.drop("domain", "suffix").withColumn("_all", everything).select("*", "_all.*").drop("_all")
    joined = rows.drop("domain", "suffix").join(tree, "host")

    prior = [F.lit(1.0 / n)] * n
    for level, k in (("all", float(n)), *SMOOTHING.items()):
        others = [F.greatest(F.col(f"{level}_{i}") - F.col(f"p_{i}"), F.lit(0.0)) for i in each]
        joined = joined.withColumns({f"_{level}_{i}": (others[i] + k * prior[i]) / (F.col(f"{level}_n") - 1 + k) for i in each})
        prior = [F.col(f"_{level}_{i}") for i in each]
    joined = joined.withColumns({f"q_{i}": F.log(prior[i]) + F.col(f"l_{i}") for i in each})
    best = F.greatest(*(F.col(f"q_{i}") for i in each))
    whole = sum((F.exp(F.col(f"q_{i}") - best) for i in range(1, n)), F.exp(F.col("q_0") - best))

    def first(letter: str, most: Column) -> Column:
        made = F.lit(languages[-1])
        for i in reversed(each):
            made = F.when(F.col(f"{letter}_{i}") == most, languages[i]).otherwise(made)
        return made

    text_best = F.greatest(*(F.col(f"e_{i}") for i in each))
    return joined.select("page_id", first("q", best).alias("lang"), F.round(1 / whole, 6).alias("posterior"), first("e", text_best).alias("text_lang"), "declared", "host", F.col("host_n").alias("n_host"))
