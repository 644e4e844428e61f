"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. Successive prefixes of a conversation are rendered and
consecutive outputs compared: what a turn adds is its span; an output that does not continue the one before
shows a template that rewrites history. Where a turn's text lies inside its span is found by rendering the
turn once more with a probe in place of its text. The loss mask is the assistant's text spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
# Control strings of the chat formats whose markers must never appear inside a text.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
START, END = "<|im_start|>", "<|im_end|>\n"

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    r"""Backslashes doubled, and one set after the first character of every control string; see unescape."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The text that escape was given: no control string contains a backslash, so each one says what it is."""
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    r"""escape, and line ends as `\n`, since a line end closes the role (no control string has n second)."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def chat_markup(turns: list[Turn]) -> str:
    """The template in use: a start marker with the role, the escaped text, an end marker; texts cannot forge either."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of chat_markup."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        stop = formatted.index(END, line + 1)
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop])))
        at = stop + len(END)
    return turns


def probe_for(turns: list[Turn]) -> str:
    """A text of private-use characters that occurs in no turn."""
    probe = "\ue000probe\ue001"
    while any(probe in part for turn in turns for part in turn):
        probe += "\ue001"
    return probe


def locate(turns: list[Turn], template: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(output, a span (start, end, text start, text end) for each turn, whether the template rewrites history).

    The prefix up to each turn is rendered, as it is and with a probe for the turn's text, so work grows with the square of the
    turns. If a prefix changes what was rendered before or hides the probe, the conversation is marked as rewritten and
    the turns concerned get empty text spans.
    """
    probe = probe_for(turns)
    spans, rewritten, before = [], False, ""
    for i, (role, text) in enumerate(turns):
        now, probed = template(turns[: i + 1]), template([*turns[:i], (role, probe)])
        added, shown = now[len(before) :], probed[len(before) :]
        same = now.startswith(before) and probed.startswith(before) and shown.count(probe) == 1
        head = shown.index(probe) if same else 0
        tail = len(shown) - head - len(probe) if same else 0
        same = same and len(added) >= head + tail and added[:head] == shown[:head] and added[len(added) - tail :] == shown[len(shown) - tail :]
        rewritten |= not same
        at, end = len(before), len(now)
        spans.append((at, end, at + head, end - tail) if same else (min(at, end), end, end, end))
        before = now
    return before, spans, rewritten


SPANS = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>"


def format_conversations(rows: DataFrame, template: Callable[[list[Turn]], str] = chat_markup, loss_role: str = "assistant") -> DataFrame:
    """Format every conversation of rows (conv_id, turn, role, text), turns in order of turn.

    Returns conv_id, formatted, spans (offsets in code points; loss marks the text of loss_role) and
    rewrites_history. Conversations stream through sorted partitions one at a time, so memory holds one.

    Null text or role: empty. Null conv_id: one conversation. Null turn: first. Ties of turn: by role, then
    text; repeated rows are repeated turns. Empty table: empty result. Other columns are not read.
    """
    kind = dict(rows.dtypes)["conv_id"]
    ordered = rows.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, turns, held = None, [], []
        names = ["conv_id", "formatted", "spans", "rewrites_history"]
        kinds = None

        def done():
            text, spans, rewritten = locate(turns, template)
            marks = [{"role": r, "start": a, "end": b, "text_start": c, "text_end": d, "loss": r == loss_role} for (r, _), (a, b, c, d) in zip(turns, spans, strict=True)]
            held.append((key, text, marks, rewritten))

        def flush():
            cols = list(zip(*held, strict=True))
            held.clear()
            mark = pa.struct([("role", pa.string()), *[(n, pa.int32()) for n in ("start", "end", "text_start", "text_end")], ("loss", pa.bool_())])
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kinds), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(mark)), pa.array(cols[3], pa.bool_())], names)

        for batch in batches:
            kinds = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and conv != key:
                    done()
                    turns = []
                    if len(held) >= 256:
                        yield flush()
                key = conv
                turns.append((role, text))
        if turns:
            done()
        if held:
            yield flush()

    return ordered.mapInArrow(run, f"conv_id {kind}, formatted string, spans {SPANS}, rewrites_history boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """What an output of format_conversations says when read back: turns from the string alone, loss from the spans."""
    kind = dict(formatted.dtypes)["conv_id"]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for conv, text, spans in zip(frame["conv_id"], frame["formatted"], frame["spans"], strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["loss"])
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            frame = pd.DataFrame(out, columns=columns)
            frame["conv_id"] = frame["conv_id"].astype("Int64") if kind == "bigint" else frame["conv_id"]
            yield frame

    return formatted.mapInPandas(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
