"""Conversations as training windows within a token budget, with a loss mask and a template that can be read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import checkpointed, running_sum
from lodestone.llm.tokens import default_tokenizer, word_tokenizer

# The template's control strings. A turn is OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
#: A backslash follows each of these in an escaped text, so that neither this template's control strings nor those
#: of others (in angle or square brackets) stand in it; a backslash itself is doubled.
_SPECIAL = re.compile(r"[\\<\[|]")
_ESCAPED = re.compile(r"\\\\|([<\[|])\\")
_TURN = re.compile(r"<\|(.*?)\|>(.*?)<\|end\|>", re.S)
WINDOWS = "conv_id bigint, part bigint, window int, n_repeated int, formatted string, loss array<struct<begin:int,end:int>>, tokens bigint"


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "\\", text)


def render(turns: list[tuple[str, str]], repeated: int, targets: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The window's text, and the spans (in characters) that count for the loss: target turns after the repeated ones."""
    out, at, loss = [], 0, []
    for k, (role, text) in enumerate(turns):
        head, body = OPEN + escape(role) + CLOSE, escape(text)
        out += [head, body, END]
        at += len(head)
        if k >= repeated and role in targets:
            loss.append((at, at + len(body)))
        at += len(body) + len(END)
    return "".join(out), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def spans(tokens: np.ndarray, first: int, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """Turn-aligned windows (start of the repeated history, start, stop) over turns from ``first`` on.

    Prefix sums give, for each start, how many earlier turns fit in ``history`` tokens and how many turns fit in
    what is left of ``budget`` besides them and the ``system`` turn. A turn too long for that stands alone, with
    as much history as still fits.
    """
    total = np.concatenate(([0], np.cumsum(tokens)))
    out, at = [], first
    while at < len(tokens):
        back = int(np.searchsorted(total, total[at] - history, "left")) if at else 0
        room = budget - system
        while back < at and total[at + 1] - total[back] > room:
            back += 1
        stop = max(at + 1, int(np.searchsorted(total, total[back] + room, "right")) - 1)
        out.append((back, at, stop))
        at = stop
    return out


def with_tokens(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``rows`` (role, text, ...) with ``tokens``: how many ids the turn has in the template, escapes and all."""
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode = word_tokenizer(path, True).ids
        for role, text in batches:
            yield pd.Series([len(encode(OPEN + escape(r) + CLOSE + escape(t) + END)) // 4 for r, t in zip(role, text, strict=True)], dtype="int64")

    return rows.withColumn("tokens", F.pandas_udf(count, "bigint")("role", "text"))


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 256, targets: tuple[str, ...] = ("assistant",), stretch: int = 16, tokenizer: str | None = None) -> DataFrame:
    """Windows of all conversations from rows (conv_id, turn, role, text), as WINDOWS says.

    Every window has at most ``budget`` ids of the tokenizer, unless one turn alone has more. It begins with the
    conversation's first system turn and up to ``history`` ids of the turns before it, all repeated and thus
    outside the loss mask, and goes on with new turns; so each target turn counts once over all windows.

    All turns are sorted into ranges first, so that no task gets a whole conversation, however many turns it has and
    however few different numbers they bear; running sums over the ranges deal a long one out in parts of ``stretch``
    budgets. Null texts and roles are empty; turns sort by (turn, role, text), null turns first; a null conv_id is
    a conversation; repeated rows are turns of their own; an empty table gives no windows. Other columns, whatever
    their names, are not read.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("k"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["k", "turn", "role", "text"]
    # equal rows may stand in any order, so a random number may part them
    ranged = rows.withColumn("any", F.rand(3)).repartitionByRange(*order, "any").sortWithinPartitions(*order).drop("any")
    rows = checkpointed(with_tokens(ranged, tokenizer).withColumn("range", F.spark_partition_id()).withColumn("no", F.monotonically_increasing_id()))
    rows = running_sum(rows, ["k"], ["turn", "role", "text", "no"], "tokens", "range", "before").drop("range", "no")
    size = stretch * budget
    rows = rows.withColumn("part", F.expr(f"before div {size}"))
    # a part's last turns are also history for the next part
    again = rows.where((F.col("before") + F.col("tokens")) > (F.col("part") + 1) * size - history).withColumn("part", F.col("part") + 1).withColumn("kind", F.lit(1))
    first_system = rows.where("role = 'system'").groupBy("k").agg(F.min(F.struct("before", "turn", "role", "text", "tokens", "part")).alias("s"))
    parts = rows.groupBy("k", "conv_id", "part").agg(F.lit(0).alias("kind"))
    system = parts.join(first_system, "k").where("part > s.part").select("conv_id", "k", "s.turn", "s.role", "s.text", "s.tokens", "s.before", "part", F.lit(0).alias("kind"))
    again = again.join(parts.select("k", "part"), ["k", "part"], "left_semi")
    everything = rows.withColumn("kind", F.lit(2)).unionByName(again).unionByName(system)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, held, current = ["kind", "before", "role", "text", "tokens", "conv_id", "part"], [], None
        for batch in batches:
            out = []
            for key, row in zip(zip(batch["k"], batch["part"], strict=True), zip(*(batch[c] for c in columns), strict=True), strict=True):
                if key != current:
                    out += _windows(held, budget, history, targets)
                    held, current = [], key
                held.append(row)
            yield _frame(out)
        yield _frame(_windows(held, budget, history, targets))

    # a part's rows lie together and in order; a worker holds one part at a time
    dealt = everything.repartition("k", "part").sortWithinPartitions("k", "part", "kind", "before", "turn", "role", "text")
    return dealt.select("k", "part", "kind", "before", "role", "text", "tokens", "conv_id").mapInPandas(cut, WINDOWS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "part", "window", "n_repeated", "formatted", "loss", "tokens"]).astype({"conv_id": "Int64"})


def _windows(rows: list[tuple], budget: int, history: int, targets: tuple[str, ...]) -> list[tuple]:
    """Windows of one part from its rows (kind, before, role, text, tokens, conv_id, part): kind 0 is the system turn
    of an earlier part, 1 a turn repeated from the part before, 2 a turn of its own."""
    if not rows:
        return []
    kind, _, role, text, tokens, conv, part = zip(*rows, strict=True)
    conv_id, lead = None if pd.isna(conv[0]) else int(conv[0]), kind[0] == 0
    own = [k for k in range(len(rows)) if kind[k] > 0]
    system_at = 0 if lead else next((k for k in own if kind[k] == 2 and role[k] == "system"), -1)
    cost = tokens[system_at] if system_at >= 0 else 0
    out = []
    for n, (back, at, stop) in enumerate(spans(np.array([tokens[k] for k in own]), kind.count(1), cost, budget, history)):
        new = own[at:stop]
        kept = [k for k in own[back:at] if k != system_at]
        if system_at >= 0 and (lead or system_at < new[0]):
            kept = [system_at, *kept]
        picked = kept + new
        formatted, loss = render([(role[k], text[k]) for k in picked], len(kept), targets)
        out.append((conv_id, int(part[0]), n, len(kept), formatted, [{"begin": a, "end": b} for a, b in loss], int(sum(tokens[k] for k in picked))))
    return out


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint, n_repeated bigint"


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation from its windows alone: turns without the repeated ones, and the text under the
    loss mask, as counts and digests. Windows are parsed wherever they are. A digest covers all bytes of a
    conversation in their order, so these then stream through one task, which does nothing but hash them and holds one
    batch at a time. A null conv_id is a conversation; no windows give no rows; other columns are not read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repeated, text, loss in zip(batch["n_repeated"], batch["formatted"], batch["loss"], strict=True):
                own = parse(text)[repeated:]
                plain = "".join(unescape(text[span["begin"] : span["end"]]) for span in loss)
                rows.append((len(own), "".join(f"{r}\n{c}\n" for r, c in own).encode(), len(plain), plain.encode(), len(text)))
            read = pd.DataFrame(rows, columns=["turns", "turn_bytes", "loss_chars", "loss_bytes", "chars"])
            yield pd.concat([batch.drop(columns=["formatted", "loss"]).reset_index(drop=True), read], axis=1).astype({"conv_id": "Int64"})

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = None, None
        for batch in batches:
            done = []
            columns = ["k", "conv_id", "n_repeated", "turns", "turn_bytes", "loss_chars", "loss_bytes", "chars"]
            for k, conv, repeated, turns, turn_bytes, loss_chars, loss_bytes, chars in zip(*(batch[c] for c in columns), strict=True):
                if k != current:
                    if state:
                        done.append(close(state))
                    current, state = k, [None if pd.isna(conv) else int(conv), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                state[2].update(turn_bytes)
                state[4].update(loss_bytes)
                for at, more in ((1, turns), (3, loss_chars), (5, chars), (6, 1), (7, repeated)):
                    state[at] += int(more)
            yield frame(done)
        if state:
            yield frame([close(state)])

    names = [c.split(" ")[0] for c in DIGEST.split(", ")]
    close = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), *s[5:])
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
    parts = windows.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("k"), "part", "window", "n_repeated", "formatted", "loss")
    parts = parts.mapInPandas(read, "conv_id bigint, k string, part bigint, window int, n_repeated int, turns bigint, turn_bytes binary, loss_chars bigint, loss_bytes binary, chars bigint")
    return parts.repartition("k").sortWithinPartitions("k", "part", "window").mapInPandas(digest, DIGEST)
