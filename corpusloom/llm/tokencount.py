"""Token counts under a unigram model: distinct pre-tokens form a trie, and each shared prefix is scored once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, bounded_batches, frugal, texts

BLOCK_BYTES = 8_000_000
#: Distinct pre-tokens a task keeps with their counts; beyond it they are scored anew.
KEPT_WORDS = 600_000
#: What stands before every pre-token, as in the vocabulary's pieces.
MARK = "▁"
#: Log-probability of a byte of a character that no piece covers.
BYTE_SCORE = -14.0


@dataclass(frozen=True)
class Unigram:
    """pieces: text -> log-probability; longest: characters of the longest piece."""

    pieces: dict[str, float]
    longest: int
    byte: float = BYTE_SCORE

    @staticmethod
    def of(ranked: list[str], byte: float = BYTE_SCORE) -> Unigram:
        """Pieces from the most frequent to the rarest, their probabilities by Zipf's law over the ranks."""
        total = log(sum(1 / (r + 10) for r in range(len(ranked))))
        pieces = {}
        for r, piece in enumerate(ranked):
            pieces.setdefault(piece, -log(r + 10) - total)
        return Unigram(pieces, max(map(len, ranked), default=1), byte)


def unigram(path: str | None = None) -> Unigram:
    """The pieces of a sentencepiece file (by default the public 32k one) in the order of their scores."""
    import public_tokenizers as public
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public.path("piece_bpe_32k.model"))
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Unigram.of([model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i))])


def trie_counts(words: Iterable[str], model: Unigram) -> dict[str, int]:
    """Tokens of each word in its most probable segmentation; ties go to fewer tokens.

    Sorted words are the trie's depth-first walk: score[i] and tokens[i] belong to the node at depth
    i of the path walked, and a word's walk starts at the last node it shares with the word before.
    A node's forward score is the best of: a piece that ends here after the score where the piece
    begins, or this character's bytes after the parent's score. The node where a word ends holds its count.
    """
    pieces, longest, found = model.pieces, model.longest, {}
    score, tokens, path = [0.0], [0], ""
    for word in sorted(set(words)):
        line = MARK + word
        n, shared = len(line), 0
        for a, b in zip(path, line):
            if a != b:
                break
            shared += 1
        del score[shared + 1 :], tokens[shared + 1 :]
        for i in range(shared + 1, n + 1):
            size = len(line[i - 1].encode("utf-8", "surrogatepass"))
            best, least = score[i - 1] + size * model.byte, tokens[i - 1] + size
            for j in range(max(0, i - longest), i):
                p = pieces.get(line[j:i])
                if p is not None:
                    s = score[j] + p
                    if s > best or (s == best and tokens[j] + 1 < least):
                        best, least = s, tokens[j] + 1
            score.append(best)
            tokens.append(least)
        path = line
        found[word] = tokens[n]
    return found


def token_counts(docs: DataFrame, model: Unigram | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text; pre-tokens are what Unicode white space separates.

    A block's distinct pre-tokens go through the trie together; nothing is shuffled. Null text
    counts as empty (0 and 0). Ties between segmentations go to fewer tokens. Repeated rows and null
    ids come back as they are; other columns are not read; an empty table gives no rows.

    Without a model given, the pieces are the public file's and their probabilities are made up by
    Zipf's law over their ranks: that file is a BPE model and has none, and tokenizers are not
    trained here. The counts are those of this unigram model and of no published tokenizer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or unigram())  # a vocabulary: its size does not depend on the data

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        kept: dict[str, int] = {}
        for b in blocks(batches, "text", BLOCK_BYTES):
            if len(kept) > KEPT_WORDS:
                kept.clear()
            split = [x.split() for x in texts(b)]
            kept.update(trie_counts({w for words in split for w in words if w not in kept}, of))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(w) for w in split], pa.int64()), pa.array([sum(map(kept.__getitem__, w)) for w in split], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long")
