"""Personal data: patterns find the plain spans, a character-level BiLSTM-CRF those that the patterns miss."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tagger
from .common import blocks, bounded_batches, frugal, texts

#: The kinds in the order in which spans are listed. A kind's tag is its place in it, from 1.
KINDS = ("email", "ip", "card", "phone")
#: The patterns of the plain spans, in forms that read a text once. An address is found from its "@".
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a span that the network adds must look like (forms that begin in few places and read on once); its path has to be so much better than one outside of spans.
ADDED = {
    "email": re.compile(
        r"(?<![\w.%+-])(?:[^\W_][\w.%+-]{0,63}+@[^\W_][\w-]*+(?:\.[^\W_][\w-]*+)+|[\w.%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[\w-]++(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[\w-]++)+)", re.IGNORECASE
    ),
    "phone": re.compile(r"(?<![0-9+(.-])(?<![0-9][ -])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9]|[.-][0-9])"),
    "ip": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"),
}
LEAST_GAIN = 4.0
#: Characters of a window, and of it those that the next one reads as well. A span's length isn't bounded by either.
WINDOW, OVERLAP = 256, 32
LANES = 2_048
BLOCK_BYTES = 1_000_000
#: The network learns from windows of at most so many texts, those with the lowest hashes, of at most so many characters.
SAMPLE, LONGEST_SAMPLE = 400, 20_000
TRAIN_WINDOWS, TRAIN_LENGTH = 3_000, 80

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits' check sum, every second one from the right doubled, divides by ten."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The plain spans by kind and start, in work that grows with the text's length, whatever its characters."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, end := found.end()))
        else:
            end = at + 1
        at = text.find("@", max(end, at + 1))
    for m in DOTTED.finditer(text):
        if m[0].count(".") == 3 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in DIALLED.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- learning


def _planted(kind: str, draw: np.random.Generator) -> str:
    """Personal data of a kind as people write it, plain or not."""
    digits = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    word = lambda: "".join(draw.choice(list("aeinorstlmé" if draw.random() < 0.3 else "aeinorstlm"), draw.integers(2, 9)))
    if kind == "email":
        local, domain = draw.choice([".", "_", "", "-"]).join([word(), digits(draw.integers(0, 3)) or word()]), [word() for _ in range(draw.integers(2, 4))]
        return f"{local}@{'.'.join(domain)}" if draw.random() < 0.8 else f"{local} [at] {' [dot] '.join(domain)}"
    if kind == "ip":
        return ".".join(str(x) for x in draw.integers(0, 256, 4)) if draw.random() < 0.8 else ":".join(f"{x:x}" for x in draw.integers(0, 65536, 8))
    if kind == "card":
        four = digits(15)
        four += next(str(d) for d in range(10) if luhn(four + str(d)))
        return four if draw.random() < 0.6 else draw.choice([" ", "-"]).join(four[i : i + 4] for i in (0, 4, 8, 12))
    a, b, c = digits(3), digits(3), digits(4)
    return (f"+{digits(draw.integers(1, 3))} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(3)} {digits(7)}")[draw.integers(0, 5)]


def _other(draw: np.random.Generator) -> str:
    """What looks like personal data and is not."""
    digits = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    return (f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{draw.integers(0, 30)}.{draw.integers(0, 99)}.{draw.integers(0, 9)}", digits(draw.integers(1, 12)), f"${digits(3)},{digits(3)}.{digits(2)}", "@home", "(a + b)", f"{digits(3)}-{digits(2)}", f"[{digits(2)}]", "std::map")[draw.integers(0, 10)]


def training_windows(sample: list[str], count: int = TRAIN_WINDOWS, length: int = TRAIN_LENGTH, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags (length, count) of windows of the texts, with their own plain spans and others planted at word ends."""
    draw = np.random.default_rng(seed)
    codes, gold = np.zeros((length, count), np.intp), np.zeros((length, count), np.intp)
    labelled = [(t, base_spans(t)) for t in sample]
    own = [(t, s) for t, spans in labelled for s in spans]
    for k in range(count):
        if own and draw.random() < 0.2:  # about a plain span of the texts
            text, (_, s, e) = own[draw.integers(0, len(own))]
            at = max(0, s - int(draw.integers(0, length - 8)))
        else:
            text = sample[draw.integers(0, len(sample))]
            at = int(draw.integers(0, max(1, len(text) - length)))
        piece = text[at : at + length + 40]
        for _ in range(int(draw.integers(0, 4))):
            cut = piece.find(" ", int(draw.integers(0, length)))
            new = (_planted(KINDS[draw.integers(0, 4)], draw) if draw.random() < 0.7 else _other(draw)) + draw.choice(["", ".", ",", ")", "###"], p=[0.7, 0.1, 0.1, 0.05, 0.05])
            piece = f"{piece[: cut + 1]}{new}{piece[cut:]}" if cut >= 0 else piece
        spans = base_spans(piece) + [s for s in _shaped(piece)]
        piece = (piece + " " * length)[:length]
        codes[:, k] = tagger.read_classes(piece)
        for kind, s, e in spans:
            gold[s:e, k] = KINDS.index(kind) + 1
    return codes, gold


def _shaped(text: str) -> list[Span]:
    return [(kind, *m.span()) for kind in KINDS for m in ADDED[kind].finditer(text) if _right(kind, m[0])]


def _right(kind: str, span: str) -> bool:
    if kind == "card":
        return luhn(re.sub("[ -]", "", span))
    if kind == "ip":
        try:
            return span.count(":") >= 3 and ipaddress.ip_address(span).version == 6
        except ValueError:
            return False
    return True


def train(docs: DataFrame, sample: int = SAMPLE, **how) -> tagger.Tagger:
    """The network, from windows of at most `sample` texts; without any text it finds nothing."""
    some = docs.where(F.length("text").between(1, LONGEST_SAMPLE)).select("doc_id", F.xxhash64("doc_id").alias("h"))
    ids = some.distinct().orderBy("h", "doc_id").limit(sample)  # bounded: ids first, so that few texts move
    picked = docs.where(F.length("text").between(1, LONGEST_SAMPLE)).select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id")
    found = [r.text for r in picked.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()]
    if not found:
        return tagger.untrained(len(KINDS) + 1)
    return tagger.fitted(*training_windows(found), len(KINDS) + 1, **how)


# --- decoding


def _tagged(some: list[str], model: tagger.Tagger) -> list[list[tuple[int, int, int, float]]]:
    """For each text the (tag, start, end, score) that its windows give, reconciled over the whole text."""
    size = np.fromiter(map(len, some), np.int64, len(some))
    first = np.cumsum(size) - size
    flat = np.concatenate([tagger.read_classes("".join(some)), np.zeros(WINDOW, np.intp)])
    step = WINDOW - OVERLAP
    count = np.where(size > 0, np.maximum(1, -(-(size - OVERLAP) // step)), 0)
    text = np.repeat(np.arange(len(some)), count)
    start = step * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    length = np.minimum(WINDOW, size[text] - start)
    order = np.argsort(-length, kind="stable")
    found: list[list[tuple[int, int, int, float, bool, bool]]] = [[] for _ in some]
    for i in range(0, len(order), LANES):
        lane = order[i : i + LANES]
        n = length[lane]
        codes = flat[(first[text[lane]] + start[lane])[None, :] + np.arange(int(n[0]))[:, None]]
        for k, tag, s, e, score in model.decode(codes, n):
            w = lane[k]
            cut = (s == 0 and start[w] > 0), (e == n[k] and start[w] + n[k] < size[text[w]])
            found[text[w]].append((tag, int(start[w]) + s, int(start[w]) + e, score, *cut))
    return [reconciled(x) for x in found]


def reconciled(spans: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int, float]]:
    """One set of spans that do not overlap from what overlapping windows found, each with whether its window cut it.

    Pieces of one kind that their windows cut are joined where they meet. Of spans that overlap then,
    those with the greatest sum of scores over the whole text stay.
    """
    whole = [s[:4] for s in spans if not (s[4] or s[5])]
    joined: list[list] = []
    for tag, s, e, score, _, _ in sorted((s for s in spans if s[4] or s[5]), key=lambda s: (s[0], s[1], s[2])):
        if joined and joined[-1][0] == tag and s <= joined[-1][2]:
            joined[-1][2], joined[-1][3] = max(joined[-1][2], e), joined[-1][3] + score
        else:
            joined.append([tag, s, e, score])
    every = sorted({*whole, *map(tuple, joined)}, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in every]
    best, take = [0.0], []
    for i, (_, s, _, score) in enumerate(every):
        before = int(np.searchsorted(ends[:i], s, "right")) if i else 0
        take.append(best[before] + score > best[i])
        best.append(max(best[i], best[before] + score))
    out, i = [], len(every)
    while i:
        if take[i - 1]:
            out.append(every[i - 1])
            i = int(np.searchsorted(ends[: i - 1], every[i - 1][1], "right"))
        else:
            i -= 1
    return out[::-1]


def _word_ends(text: str, start: int, end: int) -> tuple[int, int]:
    """A span widened to the ends of its words, within bounds: the network may miss a span's ends."""
    while start > 0 and end - start < 10 * WINDOW and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and end - start < 10 * WINDOW and not text[end].isspace():
        end += 1
    return start, end


def settled(text: str, tag: int, start: int, end: int) -> list[Span]:
    """The spans of the tag's kind, right by its form, that lie where the network saw one."""
    kind = KINDS[tag - 1]
    return [(kind, *m.span()) for m in ADDED[kind].finditer(text, start, end) if _right(kind, m[0])]


def spans_of(some: list[str], model: tagger.Tagger) -> Iterator[list[tuple[str, int, int, bool]]]:
    """For each text its (kind, start, end, plain), by kind and start: the plain ones, and those that the network adds beside them."""
    for text, tagged in zip(some, _tagged(some, model)):
        base, added = base_spans(text), []
        taken, read = bytearray(len(text) if tagged else 0), dict.fromkeys(KINDS, 0)
        for _, s, e in base if tagged else ():
            taken[s:e] = b"\1" * (e - s)
        for tag, s, e, score in tagged:
            if score >= LEAST_GAIN and e > read[KINDS[tag - 1]]:
                start, end = _word_ends(text, s, e)
                read[KINDS[tag - 1]] = end
                for span in settled(text, tag, start, end):
                    if 1 not in taken[span[1] : span[2]]:
                        taken[span[1] : span[2]] = b"\1" * (span[2] - span[1])
                        added.append(span)
        yield sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (KINDS.index(s[0]), s[1]))


def personal_data(docs: DataFrame, model: tagger.Tagger | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, spans (kind, start, end, plain) of every whole text of docs(doc_id, text); places are code points.

    The patterns give the plain spans; the network reads every window of every text and adds spans
    beside them. It learns from at most `sample` texts with their plain spans and planted ones, and
    has some 1,500 weights whatever the data. Nothing else is shuffled. Null and empty texts hold no
    spans; long texts are read whole; repeated rows come out as often and alike; a null doc_id stays
    null; two spans of one kind never overlap; other columns are not read; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, sample))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK_BYTES):
            found = [[dict(zip(("kind", "start", "end", "plain"), s)) for s in spans] for spans in spans_of(texts(b), shared.value)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    bounded_batches(docs.sparkSession)
    declared = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {declared}, spans array<struct<kind:string,start:long,end:long,plain:boolean>>")


def pii_digests(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the number of plain spans of each kind, their digest, all spans as text, and how many the network added."""
    written = "array_join(transform(%s, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.plain AND s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(F.expr(written % "filter(spans, s -> s.plain)"), 256).alias("base_sha256")
    return personal_data(docs, sample=sample).select("doc_id", *counts, base, F.expr(written % "spans").alias("spans"), F.expr("cast(size(filter(spans, s -> NOT s.plain)) AS long)").alias("n_added"))
