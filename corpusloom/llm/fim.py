"""Fill-in-middle: a byte automaton counts units in one scan, a second pass finds where a text is cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, frugal

#: The strings that mark the parts of an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain; of 100 others so many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
BLOCK_BYTES = 2_000_000
#: The scan reads so many places of a block side by side, one byte of each at a time.
LANES = 4_096

#: States: after a complete character that is no letter, after a letter, after "<", after "<" and a letter that may be
#: a mark's, and one, two or three bytes before the end of a character.
OTHER, LETTER, OPEN, NAMED, ONE, TWO, THREE = range(7)
#: What a transition counts, as bits: a unit begins, a character begins, a mark ends.
UNIT, CHARACTER, MARK = 1, 2, 4
#: Between texts; no byte of UTF-8.
END = 0xFF
#: So many bytes tell the state whatever it was before them: the longest character has four.
MEMORY = 4


def automaton() -> np.ndarray:
    """table[state << 8 | byte] is the next state << 3 | what the transition counts."""
    table = np.zeros((7, 256), np.uint8)
    letter = np.zeros(256, bool)
    letter[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
    named = {ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)}
    for state in range(7):
        for byte in range(256):
            if byte == END:
                to, counts = OTHER, 0
            elif letter[byte]:
                to = NAMED if state == OPEN and byte in named else LETTER
                counts = CHARACTER | (0 if state in (LETTER, NAMED) else UNIT)
            elif 0x80 <= byte < 0xC0 and state >= ONE:  # inside a character
                to, counts = (state - 1 if state > ONE else OTHER), 0
            elif byte >= 0xC0:
                to, counts = (ONE if byte < 0xE0 else TWO if byte < 0xF0 else THREE), UNIT | CHARACTER
            else:
                to, counts = (OPEN if byte == ord("<") else OTHER), UNIT | CHARACTER | (MARK if state == NAMED and byte == ord(">") else 0)
            table[state, byte] = to << 3 | counts
    return table.ravel()


TABLE = automaton()


def scan(data: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """What each byte's transition counts, for texts that stand in data one after the other, END after each.

    All lanes take a step at a time. A lane begins MEMORY bytes before its own, which tell its state
    as a scan from the beginning would have it.
    """
    n = len(data)
    size = max(64, -(-n // lanes))
    count = -(-n // size)
    padded = np.full(MEMORY + count * size, END, np.uint8)
    padded[MEMORY : MEMORY + n] = data
    steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (size + MEMORY, count), (1, size)))
    out = np.empty((size + MEMORY, count), np.uint8)
    state = np.zeros(count, np.uint16)
    for i in range(size + MEMORY):
        out[i] = TABLE[state << 8 | steps[i]]
        state = (out[i] >> 3).astype(np.uint16)
    return (out[MEMORY:].T & 7).ravel()[:n]


def _cut(raw: list[bytes], h: np.ndarray, plain: int, suffix_first: int) -> tuple[list, ...]:
    """n, form, prefix_chars, middle_chars and output of each text; h has four numbers a text."""
    data = np.frombuffer(b"\xff".join([*raw, b""]), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    end = np.cumsum(size + 1) - 1
    start = end - size
    counted = scan(data)
    units, chars, marks = (np.concatenate([[0], np.cumsum((counted & bit) > 0, dtype=np.int32)]) for bit in (UNIT, CHARACTER, MARK))
    n = (units[end] - units[start]).astype(np.int64)
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    whole = (size == 0) | (marks[end] > marks[start]) | (h[2] % 100 >= 100 - plain)
    swapped = h[3] % 100 < suffix_first

    def place(u: np.ndarray) -> np.ndarray:
        """Where the unit after u units begins: the second pass, over the counts."""
        return np.where(u == n, end, np.searchsorted(units, units[start] + u + 1) - 1)

    a, b = place(np.minimum(first, second)), place(np.maximum(first, second))
    form = np.where(whole, "plain", np.where(swapped, "spm", "psm")).tolist()
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    outputs = []
    for text, how, i, j in zip(raw, form, a - start, b - start):
        if how == "plain":
            outputs.append(text)
        elif how == "psm":
            outputs.append(b"".join((p, text[:i], s, text[j:], m, text[i:j])))
        else:
            outputs.append(b"".join((s, text[j:], p, text[:i], m, text[i:j])))
    none = whole.tolist()
    lengths = [[None if w else x for w, x in zip(none, c.tolist())] for c in (chars[a] - chars[start], chars[b] - chars[a])]
    return n.tolist(), form, *lengths, outputs


def numbers(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32 from the hex SHA-256 of `seed:doc_id`; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every whole text of docs(doc_id, text).

    Units are runs of ASCII letters and single other characters. Nothing is shuffled; a task holds a
    block of about two megabytes, or one text if that alone is longer. A null or empty text is plain
    and empty, and so is, whole, a text that holds a mark; repeated rows come out as often and alike;
    ids decide and a null one counts as an empty text; equal cuts give an empty middle; other columns
    are not read; no rows give no rows.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK_BYTES):
            raw = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
            h = np.array([b.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)], np.int64).reshape(4, -1)
            *found, outputs = _cut(raw, h, plain, suffix_first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(found, kinds)), pa.array(outputs, pa.binary()).cast(pa.string())], names)

    bounded_batches(docs.sparkSession)
    given = docs.select("doc_id", "text", *numbers(F.col("doc_id"), seed))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text holds no mark, so the first of each kind is the output's own."""

    def after(text: Column, part: Column) -> Column:
        return F.substr(text, F.char_length(part) + F.lit(len(MIDDLE) + 1))

    body = F.substr(output, F.lit(len(PREFIX) + 1))
    one = F.substring_index(body, SUFFIX, 1)
    two = F.substring_index(after(body, one), MIDDLE, 1)
    psm = F.concat(one, after(after(body, one), two), two)
    ahead = F.substring_index(body, PREFIX, 1)
    then = F.substring_index(after(body, ahead), MIDDLE, 1)
    spm = F.concat(then, after(after(body, ahead), then), ahead)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fim_digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle with the digests of the output and of the text rebuilt from it in the output's place."""
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
             ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
             coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
