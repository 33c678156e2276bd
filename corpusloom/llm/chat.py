"""Chat formatting that a parser reads back: text in conflict with the grammar is escaped until it comes back identical."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: turn := "<s>[" NAME LEVEL "] " body " [/" NAME "]</s>\n"; LEVEL is empty or "+1" or "+2".
NAMES = {"user": "INST", "assistant": "ASST", "system": "SYS"}
CONTROL = ("<s>", "</s>", "[INST", "[/INST]", "[ASST", "[/ASST]", "[SYS", "[/SYS]", "[ROLE=", "[/ROLE=")
LOSS_ROLE = "assistant"
_ROLES = {v: k for k, v in NAMES.items()}
_CONFLICT = re.compile("|".join(map(re.escape, CONTROL)))
_OPEN = re.compile(r"<s>\[(INST|ASST|SYS|ROLE=[A-Za-z0-9_.~%-]*)(?:\+([12]))?\] ")
_GUARDED = re.compile("|".join(re.escape(c[0]) + r"\\" + re.escape(c[1:]) for c in CONTROL))
_CODE = re.compile(r"\\(\\|u003c|u005b)")


class NotTheGrammar(ValueError):
    """What was read is not a sequence of turns."""


def escape(text: str, level: int) -> str:
    """0: as it is. 1: a backslash inside each control string. 2: every backslash, < and [ by a code."""
    if level == 0:
        return text
    if level == 1:
        return _CONFLICT.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    return text.replace("\\", "\\\\").replace("<", "\\u003c").replace("[", "\\u005b")


def unescape(body: str, level: int) -> str:
    if level == 0:
        return body
    if level == 1:
        return _GUARDED.sub(lambda m: m[0][0] + m[0][2:], body)
    return _CODE.sub(lambda m: "\\" if m[1] == "\\" else chr(int(m[1][1:], 16)), body)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, where its body begins, where it ends) of each turn, from left to right without going back.

    A body ends at the first control string after its opener, which must be the turn's closer.
    """
    at = 0
    while at < len(rendered):
        m = _OPEN.match(rendered, at)
        if not m:
            raise NotTheGrammar(f"no turn at {at}")
        name, closer = m[1], f" [/{m[1]}]</s>\n"
        stop = _CONFLICT.search(rendered, m.end())
        end = stop.start() - 1 if stop else -1
        if end < m.end() or not rendered.startswith(closer, end):
            raise NotTheGrammar(f"the turn at {at} has no end")
        role = _ROLES.get(name) if name in _ROLES else unquote(name[5:], errors="surrogatepass")
        yield role, unescape(rendered[m.end() : end], int(m[2] or 0)), m.end(), end
        at = end + len(closer)


def render(role: str, text: str) -> tuple[str, str, str]:
    """One turn as text, and the role and text read back from it.

    A turn is a whole sentence of the grammar whose end does not depend on what follows, so a
    conversation of such turns is read back turn by turn.
    """
    name = NAMES.get(role) or "ROLE=" + quote(role, safe="", errors="surrogatepass")
    for level in (0, 1, 2):
        turn = f"<s>[{name}{'+' + str(level) if level else ''}] {escape(text, level)} [/{name}]</s>\n"
        try:
            (back,) = parse(turn)
        except ValueError:
            continue
        if back[:2] == (role, text):
            return turn, back[0], back[1]
    raise NotTheGrammar("no escape makes the text come back")


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, rendered, loss (whether the body is under the loss mask): the output itself, a row a turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render(r, t)[0] for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(made, pa.string()), pa.array([r == LOSS_ROLE for r in b.column("role").to_pylist()], pa.bool_())], ["conv_id", "turn", "rendered", "loss"])

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, rendered string, loss boolean")


class _Conversation:
    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, role: str, text: str) -> None:
        turn, role, text = render(role, text)
        self.n += 1
        self.chars += len(turn)
        raw = text.encode("utf-8", "surrogatepass")
        self.turns.update(role.encode("utf-8", "surrogatepass") + b"\n" + raw + b"\n")
        if role == LOSS_ROLE:
            self.loss_chars += len(text)
            self.loss.update(raw)


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read back from its output.

    A conversation's turns are sorted within its partition and pass one by one, so a very long
    conversation takes no more memory than a short one. Null text and null role count as empty;
    turns with one number are taken by role, then text; a null turn comes first; rows without a
    conversation are one conversation with a null id. An empty table gives no rows; other columns are not read.
    """
    bounded_batches(conversations.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(done: list) -> pa.RecordBatch:
            ids = pa.array([d[0] for d in done], kind_of[0])
            rest = [pa.array(x, k) for x, k in zip(zip(*(d[1:] for d in done)), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            return pa.RecordBatch.from_arrays([ids, *rest], names)

        def close() -> tuple:
            return now, c.n, c.turns.hexdigest(), c.loss_chars, c.loss.hexdigest(), c.chars
        now, c, done, kind_of = None, None, [], []
        for b in batches:
            kind_of = kind_of or [b.column("conv_id").type]
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                if c is None or conv != now:
                    if c is not None:
                        done.append(close())
                    now, c = conv, _Conversation()
                c.add(role, text)
            if len(done) >= 1_000:
                yield batch(done)
                done = []
        if c is not None:
            done.append(close())
        if done:
            yield batch(done)

    return _ordered(conversations).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
