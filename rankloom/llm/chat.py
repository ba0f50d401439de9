"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive turn prefixes are rendered and
consecutive outputs compared: where output k starts with output k-1, the rest is turn k's span; where it does not, the
template rewrote history and the conversation is marked, its span being what differs after the common prefix.

Where a turn's text lies is found the same way: the turn is rendered with two other texts, and what the two outputs have
in common before and behind them is what surrounds the text. Nothing is known of the template but what it renders.

Null roles and texts count as empty; null turns sort first; equal turns sort by role and text, repeated rows stay.
A conversation of a null conv_id is a conversation like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
HEAD, TAIL = "### ", "</turn>"
#: Turns of which a plain template renders prefixes whole; longer conversations go in windows of this many turns.
WINDOW = 64


def escape(text: str) -> str:
    return re.sub(r"\\|###|</turn>", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def template(turns: list[Turn]) -> str:
    """`### Role:` line, text, `</turn>` line for each turn."""
    return "".join(f"{HEAD}{escape_role(role)}:\n{escape(text)}{TAIL}\n" for role, text in turns)


#: Says that the output for some turns is that for each of them, one after the other, whatever came before.
template.plain = True


PARSE = re.compile(r"### ((?:\\.|[^\\:])*):\n((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.S)


def parse(output: str) -> list[tuple[Turn, int, int]]:
    """The turns of a rendered conversation, unescaped, each with the bounds of its escaped text."""
    found, at = [], 0
    while at < len(output):
        m = PARSE.match(output, at)
        if not m:
            raise ValueError(f"not a rendered conversation at {at}")
        found.append(((unescape(m[1]), unescape(m[2])), m.start(2), m.end(2)))
        at = m.end()
    return found


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def render(turns: list[Turn], black_box: Callable[[list[Turn]], str] = template, window: int = WINDOW) -> tuple[str, list[tuple[int, int]], bool]:
    """(output, span of each turn, whether history was rewritten).

    All prefixes are rendered whole, at n * n renderings of turns. Only a template that is `plain` goes by blocks of
    `window` turns behind the last turn before them, at n * window, which gives the same.
    """
    if not getattr(black_box, "plain", False):
        window = max(1, len(turns))
    out, spans, rewritten = "", [], False
    for block in range(0, max(1, len(turns)), window):
        lead = turns[block - 1 : block] if block else []
        before = black_box(lead) if lead else ""
        shift = len(out) - len(before)
        for k in range(block, min(block + window, len(turns))):
            now = black_box(lead + turns[block : k + 1])
            same = common_prefix(before, now)
            rewritten |= same < len(before)
            spans.append((shift + same, shift + len(now)))
            out = out[: shift + same] + now[same:] if shift + same < len(out) else out + now[same:]
            before = now
    if len(turns) > window and black_box(turns) != out:
        rewritten = True
    return out, spans, rewritten


FORMATTED = "conv_id long, formatted string, spans array<struct<start:long,stop:long>>, mask array<struct<start:long,stop:long>>, rewritten boolean"


#: Texts that a turn is rendered with to find where its own text lies.
PROBES = ("a", "b")


def surroundings(render_with: Callable[[str], str]) -> tuple[int, int]:
    """Characters before and behind a turn's text, from renderings with other texts."""
    x, y = (render_with(p) for p in PROBES)
    return common_prefix(x, y), common_prefix(x[::-1], y[::-1])


def format_turns(turns: list[Turn], learn: str = "assistant", black_box: Callable[[list[Turn]], str] = template) -> tuple[str, list, list, bool]:
    """mask: bounds of the escaped texts of the turns that the loss covers, in the output."""
    out, spans, rewritten = render(turns, black_box)
    plain, mask, known = getattr(black_box, "plain", False) and not rewritten, [], {}
    for k, ((role, _), (start, stop)) in enumerate(zip(turns, spans, strict=True)):
        if role != learn:
            continue
        if plain:  # a turn's output is the same wherever it stands
            if role not in known:
                known[role] = surroundings(lambda text, role=role: black_box([(role, text)]))
            before, behind = known[role]
            mask.append((start + before, stop - behind))
        else:
            before, behind = surroundings(lambda text, k=k, role=role: black_box([*turns[:k], (role, text), *turns[k + 1 :]]))
            mask.append((before, len(out) - behind))
    return out, spans, mask, rewritten


def format_conversations(rows: DataFrame, learn: str = "assistant", black_box: Callable[[list[Turn]], str] = template) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (a turn each), mask (loss), rewritten.

    Rows of a conversation are brought together and sorted by Spark, and stream through the task; only one conversation
    is held at a time.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), *((n, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))) for n in ("spans", "mask")), ("rewritten", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, turns, done = None, [], []

        def flush():
            bounds = lambda pairs: [{"start": a, "stop": b} for a, b in pairs]
            cols = list(zip(*((c, o, bounds(s), bounds(m), w) for c, (o, s, m, w) in done), strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for b in batches:
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if turns and conv != own:
                    done.append((own, format_turns(turns, learn, black_box)))
                    turns = []
                    if len(done) >= 2000:
                        yield flush()
                own = conv
                turns.append((role, text))
        if turns:
            done.append((own, format_turns(turns, learn, black_box)))
        if done:
            yield flush()

    picked = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted output says of itself: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewritten."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for conv, out, mask, rewritten in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "mask", "rewritten")), strict=True):
                turns = [t for t, _, _ in parse(out)]
                lost = "".join(unescape(out[m["start"] : m["stop"]]) for m in mask)
                whole = sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
                for c, v in zip(cols, (conv, len(turns), whole.hexdigest(), len(lost), sha256(lost.encode()).hexdigest(), len(out), rewritten), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")
