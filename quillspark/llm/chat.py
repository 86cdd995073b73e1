"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string.  Every
prefix of a conversation's turns is rendered; what an output adds to the one
before it is the turn's span.  A probe turn with a one-character text shows
how much of a span is frame and how much is text.  A template whose output for
a longer prefix does not begin with its output for the shorter one rewrites
history: that turn is reported, and its spans are not trusted.  Only chats of a
template that declares itself ``append_only`` are put together from chunks.

The default template frames each turn with control strings and escapes such
strings inside roles and texts with a backslash, which is reversible.

Defined results: null roles and texts are empty; turns of one number are
ordered by role and text; repeated rows are separate turns; a null turn comes
first; rows with a null conv_id are one conversation; a conversation is
rendered whole in one task, so it has to fit there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The frame of a turn, and other control strings that no text may show.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
CONTROL = (OPEN, MIDDLE, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: A private-use character stands for a text when the frame around it is measured.
PROBE = "\ue000"
#: Turns of which all prefixes are rendered together for a template that declares itself append-only; its longer chats are put together from such chunks and checked.
CHUNK = 16
#: Escaped texts that a worker keeps.
KEPT = 4096
SPANS = "array<struct<turn:int,role:string,start:int,stop:int,text_start:int,text_stop:int,rewrites:boolean>>"


def escape(text: str, _kept: dict[str, str] = {}) -> str:  # noqa: B006  (a plain dict travels to workers by value)
    """Control strings of ``text`` made harmless; every prefix shows the same texts again, so ``KEPT`` of them are kept."""
    out = _kept.get(text)
    if out is None:
        doubled = text.replace("\\", "\\\\")
        out = re.sub("|".join(map(re.escape, CONTROL)), lambda m: m[0][0] + "\\" + m[0][1:], doubled)
        if len(_kept) >= KEPT:
            _kept.clear()
        _kept[text] = out
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def default_template(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{OPEN}{escape(role)}{MIDDLE}{escape(text)}{CLOSE}\n" for role, text in turns)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of an output of the default template."""
    frame = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(CLOSE)}\n", re.S)
    return [(unescape(m[1]), unescape(m[2])) for m in frame.finditer(formatted)]


def _span(turns: list[tuple[str, str]], k: int, before: str, after: str, template: Callable) -> tuple[int, int | None, int | None, bool]:
    """Where the k-th turn of ``turns`` stands in ``after``: start, start and stop of its text, and whether it rewrote ``before``."""
    rewrites = not after.startswith(before)
    start = len(before)
    if rewrites:
        start = next((i for i, (x, y) in enumerate(zip(before, after)) if x != y), min(len(before), len(after)))
    probe = template([*turns[:k], (turns[k][0], PROBE)])
    at = probe.find(PROBE, min(start, len(probe)))
    head, tail = at - start, len(probe) - at - len(PROBE)
    known = not rewrites and at >= start and probe.count(PROBE, start) == 1 and head + tail <= len(after) - start
    known = known and after[start : start + head] == probe[start:at] and after.endswith(probe[at + len(PROBE) :])
    return start, start + head if known else None, len(after) - tail if known else None, rewrites


def _prefixes(turns: list[tuple[str, str]], template: Callable) -> tuple[str, list[tuple]]:
    """The whole output and (stop, start, text_start, text_stop, rewrites) of each turn, every prefix rendered."""
    before, out = template([]), []
    for k in range(len(turns)):
        after = template(turns[: k + 1])
        start, a, z, rewrites = _span(turns, k, before, after, template)
        out.append((len(after), start, a, z, rewrites))
        before = after
    return before, out


def _by_chunks(turns: list[tuple[str, str]], template: Callable, chunk: int) -> tuple[str, list[tuple]] | None:
    """As ``_prefixes``, from the prefixes of each ``chunk`` turns alone; None where the chunks do not add up to the whole.

    Rendering all prefixes of a chat costs the square of its length.  Here the
    whole is rendered once, and has to equal the chunks' outputs put together;
    prefixes of doubling lengths have to begin it, too.
    """
    base, whole, out, at = template([]), template(turns), [], 0
    if not whole.startswith(base):
        return None
    at = len(base)
    stops = []
    for lo in range(0, len(turns), chunk):
        part, spans = _prefixes(turns[lo : lo + chunk], template)
        if any(s[4] for s in spans) or not part.startswith(base) or not whole.startswith(part[len(base) :], at):
            return None
        move = at - len(base)
        out += [(stop + move, start + move, None if a is None else a + move, None if z is None else z + move, False) for stop, start, a, z, _ in spans]
        at += len(part) - len(base)
        stops.append((min(lo + chunk, len(turns)), at))
    if at != len(whole):
        return None
    due = chunk
    for n, stop in stops[:-1]:
        if n >= due:
            if template(turns[:n]) != whole[:stop]:
                return None
            due = 2 * n
    return whole, out


def render(turns: list[tuple[str, str]], template: Callable, chunk: int = CHUNK) -> tuple[str, list[dict]]:
    """The whole output and the span of each turn; a span that the template rewrote has no text span.

    Every prefix is rendered, unless the template has a true ``append_only``:
    each turn adds the same text whatever stands before it.
    """
    got = _by_chunks(turns, template, chunk) if getattr(template, "append_only", False) and len(turns) > chunk else None
    whole, found = got or _prefixes(turns, template)
    spans = [
        {"turn": k, "role": role, "start": start, "stop": stop, "text_start": a, "text_stop": z, "rewrites": rewrites}
        for k, ((role, _), (stop, start, a, z, rewrites)) in enumerate(zip(turns, found))
    ]
    least = None  # an early span holds only if the final output still has it
    for s in reversed(spans):
        if least is not None and least < s["stop"]:
            s["text_start"] = s["text_stop"] = None
        if s["rewrites"]:
            least = s["start"] if least is None else min(least, s["start"])
    return whole, spans


def format_chats(rows: DataFrame, template: Callable = default_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: conv_id, n_turns, formatted, spans, loss (start and stop of each text under the loss mask), rewrites_history."""
    none = F.lit("")
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), none).alias("role"), F.coalesce(F.col("text").cast("string"), none).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = chats.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    loss_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    span_type = pa.list_(pa.struct([("turn", pa.int32()), ("role", pa.string()), *((n, pa.int32()) for n in ("start", "stop", "text_start", "text_stop")), ("rewrites", pa.bool_())]))

    def each(batches):
        for batch in batches:
            got = [render(list(zip(r, t)), template) for r, t in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist())]
            loss = [[{"start": s["text_start"], "stop": s["text_stop"]} for s in spans if s["role"] in loss_roles and s["text_start"] is not None] for _, spans in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([len(s) for _, s in got], pa.int64()), pa.array([f for f, _ in got], pa.string()), pa.array([s for _, s in got], span_type), pa.array(loss, loss_type), pa.array([any(x["rewrites"] for x in s) for _, s in got])],
                names=["conv_id", "n_turns", "formatted", "spans", "loss", "rewrites_history"],
            )

    kind = dict(rows.dtypes)["conv_id"]
    return chats.mapInArrow(each, f"conv_id {kind}, n_turns long, formatted string, spans {SPANS}, loss array<struct<start:int,stop:int>>, rewrites_history boolean")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted text says when it is read back: turns and text under the loss mask."""

    def each(batches):
        for batch in batches:
            n, turns, chars, loss = [], [], [], []
            for formatted, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                found = read_turns(formatted)
                n.append(len(found))
                turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in found).encode()).hexdigest())
                text = "".join(unescape(formatted[m["start"] : m["stop"]]) for m in mask)
                chars.append(len(text))
                loss.append(hashlib.sha256(text.encode()).hexdigest())
            size = [len(f) for f in batch.column("formatted").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64()), batch.column("rewrites_history")],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"],
            )

    kind = dict(chats.dtypes)["conv_id"]
    return chats.select("conv_id", "formatted", "loss", "rewrites_history").mapInArrow(each, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
