r"""Chat documents for training from logs of events.

A log row is an event of one message: ``conv_id, turn, message, seq, kind, role, text, start,
length``. ``open`` starts a message of a role, ``delta`` appends text, ``edit`` replaces
``length`` code points from ``start`` by its text, ``regenerate`` throws the text so far away.
Logs come in any order. ``fold`` partitions them by conversation, sorts them by sequence and
replays each message; ``render`` writes the final messages through the template

    ### role
    text</turn>

with a loss mask over the texts of assistants, as spans of code points. In roles and texts a
backslash goes before every backslash, inside ``###`` and inside ``</turn>``, so that neither
control string occurs in a text and unescaping is exact. ``read_back`` parses the documents.

Logs are cut by range of (conversation, turn), so that one long conversation is shared by many
tasks, while a message's events stay together; they are read as a stream. A task writes a
conversation as one document, or as several parts, of ``PART_CHARS`` where a message allows it;
a conversation's parts are numbered in order. Reading back takes whole documents where they
are; only the parts of divided ones meet again, as a sorted stream. Digests of a conversation
are running hashes.

Defined cases: NULL roles and texts count as empty; messages of one turn are ordered by
``message``; rows with a NULL ``conv_id`` are one conversation, a NULL turn comes first; an
event that comes twice counts once (same message, sequence and kind); a message without
``open`` has an empty role; an edit beyond the text's end is cut there; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import broadcast_if_small, map_rows, store

# Code points of one delta of a derived log, and of one stored part of a long conversation.
DELTA_CHARS = 1000
PART_CHARS = 4_000_000

HEADER = "### "
END = "</turn>"
LEARNT = "assistant"
_CONTROL = re.compile(r"\\|(?<=#)#(?=#)|(?<=<)/(?=turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    r"""Text without ``###`` and ``</turn>``: a backslash inside each and before backslashes."""
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int]:
    """One turn in the template, and where its text starts."""
    # A role is one line: its line ends are written as a backslash and an n.
    head = f"{HEADER}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def parse(document: str) -> Iterator[tuple[str, str, int, int]]:
    """Roles, texts and the spans of the (escaped) texts of a document's turns."""
    at = 0
    while at < len(document):
        line = document.index("\n", at)
        role = re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), document[at + len(HEADER) : line])
        end = document.index(END, line + 1)
        yield role, unescape(document[line + 1 : end]), line + 1, end
        at = end + len(END) + 1


def replay(events: Iterable[tuple]) -> tuple[str, str]:
    """Role and final text of one message from its events in order of sequence."""
    role, pieces, last = "", [], None
    for seq, kind, own, text, start, length in events:
        if (seq, kind) == last:
            continue
        last = (seq, kind)
        if kind == "open":
            role = own or ""
        elif kind == "delta":
            pieces.append(text or "")
        elif kind == "regenerate":
            pieces = []
        elif kind == "edit":
            whole = "".join(pieces)
            start = max(start or 0, 0)
            pieces = [whole[:start], text or "", whole[start + max(length or 0, 0) :]]
    return role, "".join(pieces)


def fold(log: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of the final messages, in order within every partition."""
    ordered = log.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("message").cast("string"), F.col("seq").cast("long"),
        "kind", "role", "text", F.col("start").cast("int"), F.col("length").cast("int"),
    )
    place = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn")]
    ordered = ordered.repartitionByRange(*place).sortWithinPartitions(*place, "message", "seq", "kind")

    def messages(rows: Iterable[tuple]) -> Iterator[tuple]:
        key, events = None, []
        for row in rows:
            if row[:3] != key:
                if key:
                    yield *key[:2], *replay(events)
                key, events = row[:3], []
            events.append(row[3:])
        if key:
            yield *key[:2], *replay(events)

    return map_rows(ordered, messages, "conv_id long, turn long, role string, text string")


def render(messages: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``conv_id, part, document, loss`` from messages as ``fold`` returns them.

    ``part`` orders the documents of a conversation, ``loss`` has the spans to be learnt.
    """

    def documents(rows: Iterable[tuple]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId() << 32
        owner, held, spans, size, begun = None, [], [], 0, False
        for conv_id, _, role, text in rows:
            if begun and (conv_id != owner or size >= part_chars):
                yield owner, part, "".join(held), spans
                part, held, spans, size = part + 1, [], [], 0
            owner, begun = conv_id, True
            turn, start = turn_text(role, text)
            if role == LEARNT:
                spans.append({"start": size + start, "end": size + len(turn) - len(END) - 1})
            held.append(turn)
            size += len(turn)
        if begun:
            yield owner, part, "".join(held), spans

    return map_rows(messages, documents, "conv_id long, part long, document string, loss array<struct<start int, end int>>", 100)


def read_back(documents: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, parsed from stored documents."""

    def digests(rows: Iterable[tuple]) -> Iterator[tuple]:
        owner, state = None, None
        for conv_id, document, loss in rows:
            if state is None or conv_id != owner:
                if state:
                    yield owner, *state[:2], state[2].hexdigest(), state[3].hexdigest(), state[4]
                owner, state = conv_id, [0, 0, sha256(), sha256(), 0]
            for role, text, _, _ in parse(document):
                state[0] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in loss:
                learnt = unescape(document[span["start"] : span["end"]])
                state[1] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(document)
        if state:
            yield owner, *state[:2], state[2].hexdigest(), state[3].hexdigest(), state[4]

    schema = "conv_id long, n_turns long, loss_chars long, turns_sha256 string, loss_sha256 string, formatted_chars long"
    divided = documents.groupBy(F.col("conv_id").alias("_conv")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_conv")
    divided = broadcast_if_small(divided)
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    whole = documents.join(divided, same, "left_anti").select("conv_id", "document", "loss")
    parts = documents.join(divided, same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return map_rows(whole, digests, schema).unionByName(map_rows(parts.select("conv_id", "document", "loss"), digests, schema))


def format_chats(log: DataFrame) -> DataFrame:
    """Stored documents with their loss masks from a log of events."""
    return store(render(fold(log)), "chat-documents")


def log_of(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """A log of events whose replay gives the rows of ``conversations``.

    Texts are typed or streamed in deltas. By a checksum of the message, a quarter of the
    messages have a slip in their first delta that an edit takes out, and another quarter
    start with a draft that is regenerated. Messages are named by a hash of role and text
    and a number of their row, so equal rows are messages of their own and the order of
    equal turns does not depend on the table's layout.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.md5(F.encode(F.concat(role, F.lit("\n"), text), "UTF-8"))
    rows = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.concat_ws("-", name, F.monotonically_increasing_id().cast("string")).alias("message"),
        (F.crc32(name) % 4).alias("_history"),
    )

    def event(seq, kind, text=None, start=None, length=None):
        return F.struct(
            F.lit(seq).alias("seq") if isinstance(seq, int) else seq.alias("seq"),
            F.lit(kind).alias("kind"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
            (F.lit(None).cast("int") if start is None else F.lit(start)).alias("start"),
            (F.lit(None).cast("int") if length is None else F.lit(length)).alias("length"),
        )

    slip, draft = F.lit("### slip</turn>"), F.substring("text", 1, 20)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    deltas = F.transform(pieces, lambda p, i: event(i + F.lit(3), "delta", p))
    none = F.array().cast("array<struct<seq:int,kind:string,text:string,start:int,length:int>>")
    before = (
        F.when(F.col("_history") == 1, F.array(event(1, "delta", draft), event(2, "regenerate")))
        .when(F.col("_history") == 2, F.array(event(1, "delta", slip)))
        .otherwise(none)
    )
    edit = event(F.size(pieces) + F.lit(3), "edit", F.lit(""), 0, len("### slip</turn>"))
    after = F.when(F.col("_history") == 2, F.array(edit)).otherwise(none)
    events = F.concat(F.array(event(0, "open")), before, deltas, after)
    exploded = rows.select("conv_id", "turn", "message", "role", F.explode(events).alias("e"))
    return exploded.select(
        "conv_id", "turn", "message", "e.seq", "e.kind", F.when(F.col("e.kind") == "open", F.col("role")).alias("role"), "e.text", "e.start", "e.length"
    )
