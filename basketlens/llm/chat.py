"""Chat formatting in budgeted windows (operator 6).

Turns are formatted as ``<|im_start|>role\\ntext<|im_end|>\\n``. A conversation
becomes windows of at most ``budget`` tokens that begin and end with a turn:
each repeats the system turn (a leading turn of role "system") and up to
``history`` earlier turns as far as they fit in ``history_budget``, then holds
new turns. The loss mask covers the texts of new assistant turns only, so the
targets that a window repeats are masked and every target counts once.

Long conversations are not gathered in one task: prefix sums of the turns'
tokens, built from the sums of blocks of turns, deal them into spans of about
``SPAN`` windows; a task packs one span at a time, with the system turn and
the span's preceding turns sent along. Within a span, windows are cut greedily
on the prefix sums.

``<|`` inside a role or text gets a backslash between the two signs (one more
if there are some already), so no control string occurs in formatted texts and
``unescape`` restores them exactly.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlens.llm.common import cut

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
OVERHEAD = 5              # tokens of a turn besides role's and text's words
SPAN = 16                 # windows of a span, about
BLOCK = 256               # turn numbers of a block of the prefix sums

_MARK, _MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on a line of its own, so line ends are escaped too."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of the text in it)."""
    head = f"{BEGIN}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    out = []
    for turn in text.split(BEGIN)[1:]:
        role, _, body = turn.partition("\n")
        out.append((unescape_role(role), unescape(body[: -len(END)])))
    return out


def pack(tokens: list[int], fixed: int, budget: int, repeated=None) -> list[tuple[int, int]]:
    """Greedy runs [a, b) of turns whose tokens fit into budget - fixed, less ``repeated(a)`` for a run that begins at a;
    a turn that doesn't fit alone is a run by itself."""
    ends = np.cumsum(tokens)
    out, a = [], 0
    while a < len(tokens):
        start = int(ends[a - 1]) if a else 0
        room = budget - fixed - (repeated(a) if repeated else 0)
        b = max(a + 1, int(np.searchsorted(ends, start + room, "right")))
        out.append((a, b))
        a = b
    return out


def history_from(tokens: list[int], a: int, floor: int, history: int, room: int) -> tuple[int, int]:
    """(first, tokens) of the turns before ``a`` that a window repeats: the last ones, ``history`` at most, not before
    ``floor``, as many as ``room`` tokens hold."""
    first, spent = a, 0
    while first > floor and a - first < history and spent + tokens[first - 1] <= room:
        first -= 1
        spent += tokens[first]
    return first, spent


def _windows(budget: int, history: int, history_budget: int):
    def windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "no"], kind="stable")
        kind = pdf["kind"].to_numpy()
        turns = [(r, t, int(n)) for r, t, n in zip(pdf["role"], pdf["text"], pdf["tokens"])]
        system = [turns[i] for i in np.flatnonzero(kind == 0)]
        n_before = int((kind == 1).sum())
        rest = [turns[i] for i in np.flatnonzero(kind != 0)]          # the preceding turns, then the span's own
        numbers = pdf["no"].to_numpy()[kind != 0]
        own_system = not system and bool(rest) and n_before == 0 and numbers[0] == 0 and rest[0][0] == "system"
        lead = system or ([rest[0]] if own_system else [])
        fixed = sum(n for _, _, n in lead)
        sizes = [n for _, _, n in rest]
        most = history_budget - max(0, fixed - budget // 2)          # a long system turn takes from the history first

        def back(a: int) -> tuple[int, int]:
            return history_from(sizes, a, int(own_system), history, min(most, budget - fixed - sizes[a]))

        def repeated(a: int) -> int:
            a += n_before
            return 0 if own_system and a == 0 else fixed + back(a)[1]

        out = []
        for w, (a, b) in enumerate(pack(sizes[n_before:], 0, budget, repeated)):
            a, b = a + n_before, b + n_before
            first = back(a)[0]
            repeat = [] if own_system and a == 0 else list(lead)
            text, spans = "", []
            shown = repeat + rest[first:b]
            masked = len(repeat) + a - first
            parts, at = [], 0
            for i, (role, body, _) in enumerate(shown):
                turn, s, e = format_turn(role, body)
                if i >= masked and role == "assistant":
                    spans.append({"start": at + s, "end": at + e})
                parts.append(turn)
                at += len(turn)
            text = "".join(parts)
            out.append((key[0], key[1], w, text, spans, masked, int(numbers[a]), b - a, sum(n for _, _, n in shown)))
        return pd.DataFrame(out, columns=["conv_id", "span", "window", "text", "loss", "n_repeated", "first_turn", "n_new", "n_tokens"])
    return windows


SCHEMA = "conv_id long, span long, window int, text string, loss array<struct<start:int,end:int>>, n_repeated int, first_turn long, n_new int, n_tokens long"


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 4, history_budget: int = 512) -> DataFrame:
    """Windows of ``turns(conv_id, turn, role, text)``: conv_id, span, window (in span), text, loss (spans of code points
    under the loss mask), n_repeated (leading turns that are repeated: system turn and history), first_turn (place of
    the first new turn in the conversation), n_new and n_tokens.

    Turns stand in the order of turn, then role, then text; equal rows are
    turns of their own. Null roles and texts are empty, a null turn comes
    first, and rows without conv_id form one conversation. History takes room
    only where it is repeated, and never what the first new turn needs; what
    the system turn takes over half of the budget is taken from the history's.
    A turn that doesn't fit beside the system turn has a window of its own,
    whole, and n_tokens above the budget tells it. Tokens: words and single other
    signs, and a fixed overhead a turn. An empty table gives an empty result;
    other columns are not read.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    count = F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        (count + F.lit(OVERHEAD)).cast("long").alias("tokens")).withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    # prefix sums: of blocks, then within a block
    blocks = base.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("t").over(order), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n0"))
    base = base.join(blocks, base["conv_id"].eqNullSafe(blocks["c"]) & (base["block"] == blocks["b"])).drop("c", "b")
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    base = base.withColumn("no", F.col("n0") + F.row_number().over(within) - 1).withColumn(
        "before", F.col("t0") + F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    base = cut(base.withColumn("span", F.expr(f"before div {SPAN * budget}")).select("conv_id", "no", "role", "text", "tokens", "span"))

    spans = base.groupBy("conv_id", "span").agg(F.min("no").alias("first"))
    later = cut(spans.where("first > 0").select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "first"))
    lead = base.where("no = 0 and role = 'system'")
    system = lead.join(later, lead["conv_id"].eqNullSafe(later["c"])).select("conv_id", F.col("s").alias("span"), "no", "role", "text", "tokens", F.lit(0).alias("kind"))
    back = later.select("c", "s", F.explode(F.expr(f"sequence(first - least(first, {history}L), first - 1)")).alias("at")) if history else later.select("c", "s", F.lit(-1).alias("at"))
    before = base.join(back, base["conv_id"].eqNullSafe(back["c"]) & (base["no"] == back["at"]) & ~((base["no"] == 0) & (base["role"] == "system"))).select(
        "conv_id", F.col("s").alias("span"), "no", "role", "text", "tokens", F.lit(1).alias("kind"))
    own = base.select("conv_id", "span", "no", "role", "text", "tokens", F.lit(2).alias("kind"))
    return own.unionByName(system).unionByName(before).groupBy("conv_id", "span").applyInPandas(_windows(budget, history, history_budget), SCHEMA)


def digest(windows: DataFrame) -> DataFrame:
    """What the formatted windows hold, read back from their texts: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars. A conversation's windows pass one task in order, one window at a time."""
    def read(batches):
        now: dict = {}

        def result():
            return pd.DataFrame([{"conv_id": now["id"], "n_turns": now["n"], "turns_sha256": now["all"].hexdigest(), "loss_chars": now["chars"],
                                  "loss_sha256": now["loss"].hexdigest(), "formatted_chars": now["size"]}]).astype({"conv_id": "Int64"})
        for pdf in batches:
            done = []
            for conv, text, loss, repeated in zip(pdf["conv_id"], pdf["text"], pdf["loss"], pdf["n_repeated"]):
                conv = None if pd.isna(conv) else int(conv)
                if not now or now["id"] != conv:
                    if now:
                        done.append(result())
                    now = {"id": conv, "n": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                for role, body in parse(text)[repeated:]:
                    now["n"] += 1
                    now["all"].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    target = unescape(text[span["start"]: span["end"]])
                    now["chars"] += len(target)
                    now["loss"].update(target.encode("utf-8", "surrogatepass"))
                now["size"] += len(text)
            if done:
                yield pd.concat(done)
        if now:
            yield result()
    ordered = windows.select("conv_id", "span", "window", "text", "loss", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "span", "window")
    return ordered.select("conv_id", "text", "loss", "n_repeated").mapInPandas(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
