"""Byte-level BPE by recursive SQL: token-position rows joined with the merge table until nothing merges."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, frugal, texts

#: Characters of text taken at a time, so that a block's words make a batch worth a query.
BLOCK_BYTES = 3_000_000
#: Distinct words a task keeps with their tokens; beyond it they are encoded anew.
KEPT_WORDS = 500_000
#: Characters of the words of one recursive query.
QUERY_BYTES = 500_000
#: From this length on, a word is contracted in overlapping pieces, which meet where they hold the same token.
LONG, PIECE, STRIDE = 128, 48, 32


@dataclass(frozen=True)
class Vocabulary:
    """tokens[i] is the bytes of rank i; merges has a row (a, b, c) wherever token a followed by b is token c.

    safe[c] says that no pair made with c has a lower rank than c. A word in which c is the lowest
    pair may then contract all its places at once, from the left, and get what one at a time gives.
    """

    pattern: str
    tokens: list[bytes]
    merges: np.ndarray
    safe: np.ndarray
    key: str

    @staticmethod
    def of(lines: list[bytes], pattern: str) -> Vocabulary:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        merges = np.array([(a, b, c) for t, c in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None], np.int32).reshape(-1, 3)
        safe = np.ones(len(tokens), bool)
        for part in (merges[:, 0], merges[:, 1]):
            safe[part[merges[:, 2] < part]] = False
        key = hashlib.sha256(pattern.encode() + b"\0" + b"\n".join(lines)).hexdigest()
        return Vocabulary(pattern, tokens, merges, safe, key)


def vocabulary(spark: SparkSession | None = None, path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """The rank file at path (by default the public multilingual one) and the pattern that goes with it."""
    import public_tokenizers as public

    with open(path or public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return Vocabulary.of(f.read().splitlines(), pattern or public.PATTERN)


#: One contraction a round in each word: of the leftmost of its lowest-ranked pairs. A row is a token of n bytes at
#: position p of word w, and the token after it. A pair's rank, its position and its first token's length are one
#: number, whose minimum picks the pair; the row at the end of its first token goes. Words without a pair are done.
_ENCODE = """
WITH RECURSIVE enc(w, p, n, id, nx, live) AS (
  SELECT w, p, 1, id, lead(id) OVER (PARTITION BY w ORDER BY p), true FROM start
  UNION ALL
  (WITH met AS (SELECT e.w, e.p, e.n, e.id, e.nx, m.c FROM enc e LEFT JOIN merges m ON m.a = e.id AND m.b = e.nx WHERE e.live),
        best AS (SELECT w, min((c::BIGINT << 40) + (p::BIGINT << 16) + n) AS k FROM met WHERE c IS NOT NULL GROUP BY w),
        done AS (SELECT met.w, met.p, met.n, met.id, met.nx, false AS live FROM met ANTI JOIN best USING (w)),
        step AS (SELECT met.w, met.p, met.n, met.id, ((best.k >> 16) & 16777215)::INT AS place, (best.k & 65535)::INT AS first, (best.k >> 40)::INT AS c
                 FROM met JOIN best USING (w)),
        made AS (SELECT w, p, n, CASE WHEN p = place THEN c ELSE id END AS id FROM step WHERE p <> place + first)
   SELECT w, p, (coalesce(lead(p) OVER x, p + n) - p)::INT, id, lead(id) OVER x, true FROM made WINDOW x AS (PARTITION BY w ORDER BY p)
   UNION ALL SELECT * FROM done))
"""
#: The same for what several pieces were joined to, but all places of a safe pair go in one round: in a run of places
#: that touch, every second one.
_ENCODE_LONG = """
WITH RECURSIVE enc(w, p, id, nx, live) AS (
  SELECT w, p, id, lead(id) OVER (PARTITION BY w ORDER BY p), true FROM start
  UNION ALL
  (WITH met AS (SELECT e.w, e.p, e.id, m.c, row_number() OVER (PARTITION BY e.w ORDER BY e.p) AS i
                FROM enc e LEFT JOIN merges m ON m.a = e.id AND m.b = e.nx WHERE e.live),
        best AS (SELECT w, min(c::BIGINT * 4294967296 + p) AS k FROM met WHERE c IS NOT NULL GROUP BY w),
        step AS (SELECT met.w, met.p, met.i, met.id, best.k IS NOT NULL AS live, (best.k // 4294967296)::INT AS c,
                        coalesce(met.c = best.k // 4294967296 AND (s.safe OR met.p = best.k % 4294967296), false) AS here
                 FROM met LEFT JOIN best USING (w) LEFT JOIN safe s ON s.id = best.k // 4294967296),
        runs AS (SELECT *, i - row_number() OVER (PARTITION BY w, here ORDER BY i) AS run FROM step),
        pick AS (SELECT *, here AND row_number() OVER (PARTITION BY w, here, run ORDER BY i) % 2 = 1 AS yes FROM runs),
        made AS (SELECT w, p, CASE WHEN yes THEN c ELSE id END AS id, live,
                        coalesce(lag(yes) OVER (PARTITION BY w ORDER BY p), false) AS gone FROM pick)
   SELECT w, p, id, lead(id) OVER (PARTITION BY w ORDER BY p), live FROM made WHERE NOT gone))
"""
#: Decoding: each token's bytes, put together in the order of their positions.
_DECODE = "SELECT w, string_agg(text, ',' ORDER BY p) AS ids, count(*) AS n, string_agg(hex, '' ORDER BY p) AS decoded FROM ids JOIN tokens USING (id) GROUP BY w"


class Merger:
    """DuckDB, in the memory of one worker, over the tables of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, memory: str = "400MB"):
        import duckdb
        import regex

        self.split = regex.compile(vocabulary.pattern).findall
        self.rank = {t: i for i, t in enumerate(vocabulary.tokens) if t}
        self.bytes = np.array([self.rank.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.bytes < 0).any():
            raise ValueError("a byte has no token")
        self.kept: dict[str, tuple[str, bytes, int]] = {}
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute(f"SET memory_limit = '{memory}'")
        self.db.execute("SET temp_directory = ''")  # no files: a query's size is bounded instead
        self._table("merges", {"a": vocabulary.merges[:, 0], "b": vocabulary.merges[:, 1], "c": vocabulary.merges[:, 2]})
        n = len(vocabulary.tokens)
        self._table("tokens", {"id": np.arange(n, dtype=np.int32), "text": [str(i) for i in range(n)], "hex": [t.hex() for t in vocabulary.tokens]})
        self._table("safe", {"id": np.arange(n, dtype=np.int32), "safe": vocabulary.safe})

    def close(self) -> None:
        self.db.close()
        self.kept.clear()

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, flat: np.ndarray, size: np.ndarray, sql: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, position and id of each token of some byte strings, which stand in flat one after the other, in order."""
        first = np.cumsum(size) - size
        self._table("start", {"w": np.repeat(np.arange(len(size)), size).astype(np.int32), "p": (np.arange(len(flat)) - np.repeat(first, size)).astype(np.int32), "id": self.bytes[flat]})
        made = self.db.execute(f"{sql} SELECT w, p, id FROM enc WHERE NOT live ORDER BY w, p").fetchnumpy()
        return made["w"].astype(np.int64), made["p"].astype(np.int64), made["id"].astype(np.int64)

    def _contract_long(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_contract for long strings, in work that grows with their length and not with its square.

        Tokens are an encoding if and only if each two neighbours are the encoding of their own bytes:
        contraction never crosses a border that it leaves in the end, and what it does on either side of
        one neither side sees. So encodings of two overlapping pieces that hold one token in common, in
        one place, are an encoding of both if the second takes over after it. Pieces without such a token
        are joined to one and contracted anew, until all meet or one piece is the whole string.
        """
        first = np.cumsum(size) - size
        count = np.maximum(1, -(-(size - PIECE) // STRIDE) + 1)
        word = np.repeat(np.arange(len(size)), count)
        start = first[word] + STRIDE * (np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count))
        end = np.minimum(start + PIECE, (first + size)[word])
        todo, sql = np.arange(len(word)), _ENCODE
        piece, at, ids = (np.zeros(0, np.int64),) * 3
        while True:
            got = [(piece, at, ids)]
            ends = np.cumsum((end - start)[todo])
            for cut in np.split(todo, np.searchsorted(ends, np.arange(QUERY_BYTES, ends[-1], QUERY_BYTES), "right")):
                if len(cut):
                    n = (end - start)[cut]
                    w, p, i = self._contract(np.concatenate([flat[a:b] for a, b in zip(start[cut], end[cut])]), n, sql)
                    got.append((cut[w], start[cut][w] + p, i))
            piece, at, ids = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((at, piece))
            piece, at, ids = piece[order], at[order], ids[order]
            more = np.flatnonzero(word[1:] == word[:-1])  # more[k]: a piece that another of its word follows
            begins, stops = np.full(len(word), np.iinfo(np.int64).max), np.full(len(word), -1)
            begins[more], stops[more + 1] = start[more + 1], end[more]
            key = at << 20 | ids
            both = np.intersect1d(key[at >= begins[piece]], key[at < stops[piece]]) >> 20
            meet = np.searchsorted(both, start[more + 1])
            where = both[np.minimum(meet, len(both) - 1)] if len(both) else np.zeros(len(more), np.int64)
            met = (meet < len(both)) & (where < end[more])
            if met.all():
                last, since = np.full(len(word), np.iinfo(np.int64).max), np.full(len(word), -1)
                last[more], since[more + 1] = where, where
                mine = (at <= last[piece]) & (at > since[piece])
                return word[piece[mine]], (at - first[word[piece]])[mine], ids[mine]
            joined = np.zeros(len(word), bool)  # to the piece before
            joined[more[~met] + 1] = True
            now = np.cumsum(~joined) - 1
            heads = np.flatnonzero(~joined)
            tails = np.append(heads[1:], len(word)) - 1
            kept = (heads == tails)[now[piece]]
            todo, sql = np.flatnonzero(heads != tails), _ENCODE_LONG
            word, start, end = word[heads], start[heads], end[tails]
            piece, at, ids = now[piece[kept]], at[kept], ids[kept]

    def _encode(self, words: list[str]) -> None:
        """Puts the words' ids, as text, and what the ids decode to into kept."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter((self.rank.get(r, -1) for r in raw), np.int32, len(raw))
        one = np.flatnonzero(whole >= 0)  # a word that is a token is that token
        w, p, ids = [one], [np.zeros(len(one), np.int64)], [whole[one]]
        for some, contract in ((np.flatnonzero((whole < 0) & (size < LONG)), lambda *x: self._contract(*x, _ENCODE)), (np.flatnonzero((whole < 0) & (size >= LONG)), self._contract_long)):
            if len(some):
                found = contract(np.frombuffer(b"".join(raw[i] for i in some), np.uint8), size[some])
                for all_, x in zip((w, p, ids), (some[found[0]], *found[1:])):
                    all_.append(x)
        self._table("ids", {"w": np.concatenate(w).astype(np.int32), "p": np.concatenate(p).astype(np.int32), "id": np.concatenate(ids).astype(np.int32)})
        for w, text, n, decoded in self.db.execute(_DECODE).fetchall():
            self.kept[words[w]] = (text, bytes.fromhex(decoded), n)

    def encode(self, some: list[str]) -> Iterator[list[tuple[str, bytes, int]]]:
        """For each text its words' (ids, decoded bytes, number of ids)."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        split = [self.split(x) for x in some]
        new, size = [], 0
        for word in set().union(*split).difference(self.kept):
            new.append(word)
            size += len(word)
            if size >= QUERY_BYTES:
                self._encode(new)
                new, size = [], 0
        if new:
            self._encode(new)
        get = self.kept.__getitem__
        for words in split:
            yield list(map(get, words))


def _run(shared, make, names: list[str], kinds: list[pa.DataType]):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(Merger(shared.value)) as merger:  # nothing of it outlives the task
            for b in blocks(batches, "text", BLOCK_BYTES):
                made = [make(words) for words in merger.encode(texts(b))]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *(pa.array(x, kind) for x, kind in zip(zip(*made), kinds))], names)

    return run


def _encoded(docs: DataFrame, vocab: Vocabulary | None, make, columns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab or vocabulary())  # a vocabulary: its size does not depend on the data
    schema = ", ".join([_declared(docs), *(f"{name} {kind}" for name, (kind, _) in columns.items())])
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_run(shared, make, ["doc_id", *columns], [x for _, x in columns.values()]), schema)


def _declared(df: DataFrame) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def _digests(words: list[tuple[str, bytes, int]]) -> tuple[int, str, str]:
    ids, decoded, n = zip(*words) if words else ((), (), ())
    return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()


def encode_digests(docs: DataFrame, vocab: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    The texts are cut by the vocabulary's pattern; the distinct words of a block are encoded by the
    recursive query and decoded by the ordered aggregation, and a text is its words one after the
    other. Nothing is shuffled. A null text counts as empty: no tokens, the digests of nothing.
    Repeated rows and null ids come back as they are; other columns are not read.
    """
    return _encoded(docs, vocab, _digests, {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())})


def _ids(words: list[tuple[str, bytes, int]]) -> np.ndarray:
    return np.array(",".join(ids for ids, _, _ in words).split(","), np.int32) if words else np.zeros(0, np.int32)


def encode(docs: DataFrame, vocab: Vocabulary | None = None) -> DataFrame:
    """doc_id, ids array<int>: the token ids themselves, with the rules of encode_digests."""
    return _encoded(docs, vocab, lambda words: (_ids(words),), {"ids": ("array<int>", pa.list_(pa.int32()))})


def encode_with_digests(docs: DataFrame, vocab: Vocabulary | None = None) -> DataFrame:
    """encode_digests with the ids beside the digests."""
    return _encoded(docs, vocab, lambda words: (_ids(words), *_digests(words)), {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())})


def decode(encoded: DataFrame, vocab: Vocabulary | None = None) -> DataFrame:
    """doc_id, decoded binary: of rows (doc_id, ids array<int>), by ordered aggregation in each block.

    Null or empty ids decode to no bytes; an id that the vocabulary does not hold is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocab or vocabulary())

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = len(shared.value.tokens)
        with closing(Merger(shared.value)) as merger:
            for b in blocks(batches, "ids", BLOCK_BYTES):
                ids = b.column("ids")
                size = np.array([len(x) if x is not None else 0 for x in ids.to_pylist()], np.int64)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= known):
                    raise ValueError("an id is not in the vocabulary")
                merger._table("ids", {"w": np.repeat(np.arange(len(size)), size).astype(np.int32), "p": np.arange(len(flat), dtype=np.int32), "id": flat.astype(np.int32)})
                got = {w: bytes.fromhex(x) for w, _, _, x in merger.db.execute(_DECODE).fetchall()}
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([got.get(i, b"") for i in range(len(size))], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"{_declared(encoded)}, decoded binary")
