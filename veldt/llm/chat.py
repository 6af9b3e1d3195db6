"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string;
nothing is known of its inside.  The prefixes of a conversation are rendered
one after another and consecutive outputs compared: while the earlier output
is a prefix of the later one, the new part is the turn's span.  Two probe
renderings that differ only in the new turn's text show where in the span the
text lies.  A template whose later output changes earlier characters rewrites
history; that is reported, and its spans are found by probing every turn in
the whole conversation instead.

Conversations are streamed through sorted partitions; a task holds one
conversation at a time, which its rendered output (one value) demands anyway.

Defined cases: null text and null role are empty; turns are ordered by (turn,
role, text), null turn first, so repeated rows are repeated turns; rows with a
null conv_id form one conversation; other columns do not matter; an empty
input gives an empty result; a turn whose text the template leaves out has an
empty span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm import common as C

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


# ------------------------------------------------------------- the template

def escape(text: str) -> str:
    """One backslash more in every ``<``, backslashes, ``|``: no control string is left, and nothing is lost."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def chat_template(turns: Turns) -> str:
    """Turn after turn: start mark, role, line feed, text, end mark; role and text escaped,
    and a line feed inside a role written as the control string ``<|n|>``."""
    return "".join(f"{OPEN}{_role(r)}\n{escape(t)}{CLOSE}" for r, t in turns)


def _role(role: str) -> str:
    return escape(role).replace("\n", "<|n|>")


def parse(formatted: str) -> Turns:
    """The turns of a :func:`chat_template` output, read back from it alone."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        line, end = formatted.index("\n", at), formatted.index(CLOSE, at)
        out.append((unescape(formatted[at + len(OPEN):line].replace("<|n|>", "\n")), unescape(formatted[line + 1:end])))
        at = end + len(CLOSE)
    return out


# ------------------------------------------------------------- spans

def _common_prefix(a: str, b: str) -> int:
    if a == b or b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _probe(render: Template, turns: Turns, i: int) -> tuple[int, int] | None:
    """Characters before and after turn i's text in the output, from two renderings of other texts."""
    role = turns[i][0]
    a, b = (render([*turns[:i], (role, x), *turns[i + 1:]]) for x in ("A", "B"))
    if a == b:
        return None
    return _common_prefix(a, b), _common_prefix(a[::-1], b[::-1])


def locate(render: Template, turns: Turns) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """Output, (start, end, text_start, text_end) of every turn, first turn that rewrote history (or None)."""
    spans, before, rewrote = [], "", None
    for k in range(len(turns)):
        out = render(turns[:k + 1])
        if not out.startswith(before):
            rewrote = k
            break
        p = _probe(render, turns[:k + 1], k)
        spans.append((len(before), len(out), *((p[0], len(out) - p[1]) if p else (len(out), len(out)))))
        before = out
    if rewrote is None:
        return before, spans, None
    out, spans, at = render(turns), [], 0
    for k in range(len(turns)):
        p = _probe(render, turns, k)
        start, end = (p[0], max(p[0], len(out) - p[1])) if p else (at, at)
        spans.append((at, end, start, end))
        at = end
    return out, spans, rewrote


# ------------------------------------------------------------- operator

_SCHEMA = ("conv_id long, n_turns long, formatted string, "
           "spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long,loss:boolean>>, rewrote_at long")


def format_conversations(turns: DataFrame, template: Template = chat_template, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, spans (code points; ``loss`` marks turns to learn from), rewrote_at."""
    C.small_batches(turns.sparkSession)

    def one(conv, rows: Turns):
        out, spans, rewrote = locate(template, rows)
        marks = [{"role": r, "start": a, "end": b, "text_start": c, "text_end": d, "loss": r == loss_role}
                 for (r, _), (a, b, c, d) in zip(rows, spans, strict=True)]
        return conv, len(rows), out, marks, rewrote

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, done = None, None, []

        def flush():
            frame = pd.DataFrame(done, columns=["conv_id", "n_turns", "formatted", "spans", "rewrote_at"])
            frame["conv_id"], frame["rewrote_at"] = frame["conv_id"].astype("Int64"), frame["rewrote_at"].astype("Int64")
            done.clear()
            return frame

        for f in frames:
            for has, conv, role, text in zip(f["has"], f["conv_id"], f["role"], f["text"], strict=True):
                conv = int(conv) if has else None
                if rows is None or conv != now:
                    if rows:
                        done.append(one(now, rows))
                    now, rows = conv, []
                rows.append((role, text))
            if done:
                yield flush()
        if rows:
            done.append(one(now, rows))
            yield flush()

    rows = turns.select(F.col("conv_id").isNotNull().alias("has"),
                        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv_id"),
                        F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (rows.repartition("has", "conv_id").sortWithinPartitions("has", "conv_id", "turn", "role", "text")
            .drop("turn").mapInPandas(run, _SCHEMA))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrote, all
    read back from the formatted text and the spans."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for conv, text, spans, rewrote in zip(f["conv_id"], f["formatted"], f["spans"], f["rewrote_at"], strict=True):
                turns, loss = parse(text), "".join(unescape(text[s["text_start"]:s["text_end"]]) for s in spans if s["loss"])
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(text), not pd.isna(rewrote)))
            frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                               "formatted_chars", "rewrote"])
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                      "loss_sha256 string, formatted_chars long, rewrote boolean")
