"""Chat formatting by event sourcing: fold a conversation's event log into messages, then render.

Events have conv_id, seq (any sortable column), message_id, kind, role and text. Kinds: `open` starts
a message with a role and a first text, `delta` appends to it, `edit` replaces its text, `regenerate`
clears it for a new answer, `delete` removes it. A message stands where its first event stands.

The template writes `### role: text</turn>` and a line feed per turn. A backslash goes before each
backslash, `#` and `<` of a text (and `:` of a role), so that no mark can occur inside one, and
parsing gives back exactly what was rendered. The loss mask covers the texts of the trained role.

Defined results: null role or text is empty; a null conv_id is a conversation of its own; events of a
message that was never opened make a message with an empty role; equal events are all applied; ties
in seq are ordered by message_id, then kind and text; an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

OPEN, ROLE_END, CLOSE = "### ", ": ", "</turn>\n"
_TEXT, _ROLE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")
_BACK = re.compile(r"\\(.)", re.S)


def escaped(text: str, control: re.Pattern = _TEXT) -> str:
    return control.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(messages: Iterable[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss spans in it (code points)."""
    parts, spans, n = [], [], 0
    for role, text in messages:
        head, body = OPEN + escaped(role, _ROLE) + ROLE_END, escaped(text)
        if role == trained:
            spans.append((n + len(head), n + len(head) + len(body)))
        parts += (head, body, CLOSE)
        n += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation; ValueError if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        role_end = formatted.find(ROLE_END, at + len(OPEN))
        while role_end > 0 and _odd_backslashes(formatted, role_end):
            role_end = formatted.find(ROLE_END, role_end + 1)
        end = formatted.find(CLOSE, role_end)
        while end > 0 and _odd_backslashes(formatted, end):
            end = formatted.find(CLOSE, end + 1)
        if not formatted.startswith(OPEN, at) or role_end < 0 or end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(formatted[at + len(OPEN) : role_end]), unescaped(formatted[role_end + len(ROLE_END) : end])))
        at = end + len(CLOSE)
    return out


def _odd_backslashes(s: str, at: int) -> bool:
    k = at
    while k and s[k - 1] == "\\":
        k -= 1
    return (at - k) % 2 == 1


def folded(events: Iterable[tuple[object, str | None, str | None, str | None]]) -> list[tuple[str, str]]:
    """(role, text) messages from (message_id, kind, role, text) events in order."""
    state: dict[object, list] = {}
    for key, kind, role, text in events:
        m = state.setdefault(key, ["", [], True])
        if kind == "delta":
            m[1].append(text or "")
        elif kind == "delete":
            m[2] = False
        else:
            m[1] = [text or ""]
            m[2] = True
            m[0] = role if kind == "open" and role is not None else m[0]
    return [(role, "".join(parts)) for role, parts, shown in state.values() if shown]


def reconstruct(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, n_messages, formatted, loss_spans of each conversation in the log.

    Logs are dealt by conversation and sorted by sequence, with spill; a task holds one conversation at
    a time.
    """
    kind = dict(events.dtypes)["conv_id"]
    log = events.select("conv_id", "message_id", "kind", "role", "text", "seq")
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message_id", "kind", "text").drop("seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, rows) -> dict:
            messages = folded(rows)
            text, spans = render(messages, trained)
            return {"conv_id": key, "n_messages": len(messages), "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]}

        out, held, key, size = [], [], None, 0
        for b in batches:
            schema.setdefault("s", pa.schema([("conv_id", b.schema.field(0).type), ("n_messages", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and row[0] != key:
                    out.append(done(key, held))
                    size += len(out[-1]["formatted"])
                    held = []
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema["s"])
                        out, size = [], 0
                key = row[0]
                held.append(row[1:])
        if held:
            out.append(done(key, held))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema["s"])

    schema: dict = {}
    return log.mapInArrow(released(run), f"conv_id {kind}, n_messages long, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and the turns and trained text found in the formatted strings, as digests."""
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sha(s: str) -> str:
            return hashlib.sha256(s.encode()).hexdigest()

        for b in batches:
            rows = []
            for key, text, spans in zip(*[c.to_pylist() for c in b.columns], strict=True):
                turns = parse(text)
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                rows.append((key, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(released(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_events(turns: DataFrame) -> DataFrame:
    """The event log of finished turns(conv_id, turn, role, text): each row is opened, then streamed in two deltas.

    Turns stand by turn, then role and text; equal rows stay separate messages.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    none = F.lit(None).cast("string")
    parts = [("open", F.col("role"), F.lit("")), ("delta", none, F.substring(text, 1, half)), ("delta", none, F.substr(text, half + 1))]
    made = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(kind).alias("kind"), role.alias("role"), body.alias("text")) for k, (kind, role, body) in enumerate(parts)])
    rows = turns.select("conv_id", F.struct("turn", "role", "text").alias("place"), made.alias("made"), F.monotonically_increasing_id().alias("message_id"))
    return rows.select("conv_id", "place", "message_id", F.explode("made").alias("e")).select("conv_id", F.struct("place", "message_id", "e.part").alias("seq"), "message_id", "e.kind", "e.role", "e.text")
