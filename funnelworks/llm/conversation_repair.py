"""Cheapest repair of conversations by a shortest path over integer weights.

``damage`` applies a reproducible damage to conversation rows; ``repair`` finds the cheapest
edits after which the role initials of a conversation read ``(s?(ua)+)?``. The edits of a row
are Keep, Rerole (to user or assistant) and Delete; empty user and assistant turns may be
Inserted anywhere.

The path runs over (row, state of that expression). An edge takes one row and the inserts in
front of it, and weighs one integer: its cost in the high digits and, in the low ones, its
letters in the slot of its row, three digits wide (two inserts and the row's own edit) with
zeros after the letters. Letters ascend with ASCII and no slot's letters begin another's, so
the smallest sum of integers is the lowest cost and, among equals, the ASCII-least audit. Two
inserts a gap suffice: a third leads back to a state that fewer reach. After ``SLOTS`` rows the
digits of the surviving states are replaced by their rank, so that integers keep their size in
a conversation of any length; letters tell the state, so ranks lose nothing.

A conversation's rows meet in one task, sorted, and are read as a stream: a state carries its
audit and the running hash of its repaired text, so no texts are held. What a task keeps of a
conversation is 16 bytes for each different row and its audit, which is one value of the
result. The hash of a whole text is sequential by its definition.

Defined cases: NULL roles and texts count as one space, as do a NULL ``conv_id`` and ``turn``
in the checksum; rows with a NULL ``conv_id`` are one conversation; rows of one turn are taken
by role and text, so equal rows are adjacent; an empty text is blank; a row whose role is empty
has no initial and can only be reroled or deleted; a conversation of which all rows are dropped
keeps its id, with zeros, an empty audit and the hash of an empty text; gaps beyond a long are
the largest long; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import map_rows

SPACE = " \t\n\x0b\x0c\r"
LARGEST = (1 << 63) - 1

# States of (s?(ua)+)?: nothing kept, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# The turn that may be inserted or reroled to in a state, and the state it leads to.
MADE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ACCEPTED = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}

INSERT, REROLE, DELETE, CUT_OFF = 3, 3, 4, 3
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
DIGIT_BITS = 3
SLOT_BITS = 3 * DIGIT_BITS
RANK_BITS = 2
SLOTS = 32
SHIFT = SLOTS * SLOT_BITS + RANK_BITS


def slot(letters: str) -> int:
    """At most three letters as digits of one slot, zeros after them."""
    code = 0
    for at in range(3):
        code = code << DIGIT_BITS | (DIGIT[letters[at]] if at < len(letters) else 0)
    return code


def _gaps(state: int) -> list[tuple[int, str, str]]:
    """The states reached by 0, 1 and 2 inserts, their letters and inserted turns."""
    found, text = [(state, "", "")], ""
    for n in (1, 2):
        role, after = MADE[state]
        text += f"{'' if state == START else chr(10)}{role}:"
        state = after
        found.append((state, "I" * n, text))
    return found


GAPS = {s: _gaps(s) for s in range(4)}
CODES = {i + x: slot(i + x) for i in ("", "I", "II") for x in ("", "K", "R", "D")}


class Repair:
    """The shortest path through one conversation, row by row."""

    def __init__(self) -> None:
        # Of each state: weight, (audit so far, last letters), running hash of the output.
        self.best: list[tuple | None] = [(0, None, sha256()), None, None, None]
        self.used = 0

    def take(self, role: str, text: str, must_go: bool, cut_off: bool) -> None:
        if self.used == SLOTS:
            self.rank()
        up = SLOT_BITS * (SLOTS - 1 - self.used)
        self.used += 1
        # target state: weight, source state, letters, text in front, role given
        ways: list[tuple | None] = [None] * 4
        for source, found in enumerate(self.best):
            if found is None:
                continue
            for state, inserts, made in GAPS[source]:
                paid = len(inserts) * INSERT
                options = [(state, "D", DELETE, None)]
                if not must_go:
                    extra = CUT_OFF if cut_off else 0
                    if (kept := STEP.get((state, role[:1]))) is not None:
                        options.append((kept, "K", extra, role))
                    given, after = MADE[state]
                    options.append((after, "R", REROLE + extra, given))
                for target, letter, cost, given in options:
                    letters = inserts + letter
                    weight = found[0] + ((paid + cost) << SHIFT) + (CODES[letters] << up)
                    if ways[target] is None or weight < ways[target][0]:
                        ways[target] = (weight, source, letters, made, given, state)
        self.best = [w and self._through(w, text) for w in ways]

    def _through(self, way: tuple, text: str) -> tuple:
        weight, source, letters, made, given, state = way
        _, audit, digest = self.best[source]
        out = made
        if given is not None:
            out += f"{'' if state == START else chr(10)}{given}:{text}"
        if out:
            digest = digest.copy()
            digest.update(out.encode())
        return weight, (audit, letters), digest

    def rank(self) -> None:
        """Replace the letters' digits of the states by their rank."""
        digits = (1 << SHIFT) - 1
        order = sorted({b[0] & digits for b in self.best if b})
        self.best = [
            b and ((b[0] >> SHIFT << SHIFT) + (order.index(b[0] & digits) << (SLOTS * SLOT_BITS)), *b[1:]) for b in self.best
        ]
        self.used = 0

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the repaired text."""
        if self.used == SLOTS:
            self.rank()
        up = SLOT_BITS * (SLOTS - 1 - self.used)
        ends = []
        for source, found in enumerate(self.best):
            for state, inserts, made in GAPS[source] if found else ():
                if state in ACCEPTED:
                    ends.append((found[0] + (len(inserts) * INSERT << SHIFT) + (CODES[inserts] << up), source, inserts, made))
        weight, source, inserts, made = min(ends)
        _, audit, digest = self.best[source]
        digest = digest.copy()
        digest.update(made.encode())
        letters = [inserts]
        while audit is not None:
            audit, last = audit
            letters.append(last)
        return weight >> SHIFT, "".join(reversed(letters)), digest.hexdigest()


class Conversation:
    """Counts and repair of one conversation whose rows come in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.repair = Repair()
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        key = blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        bare = text.rstrip(SPACE)
        blank, again, cut_off = not bare, key in self.seen, False
        self.seen.add(key)
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif cut_off := bare[-1] not in ".!?":
            self.truncated += 1
        self.repair.take(role, text, blank or again, cut_off)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, LARGEST)
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.result())


def _repaired(rows: Iterable[tuple]) -> Iterator[tuple]:
    talk = None
    for conv_id, turn, role, text, there in rows:
        if talk is None or conv_id != talk.conv_id:
            if talk:
                yield talk.row()
            talk = Conversation(conv_id)
        if there:
            talk.add(turn, role, text)
    if talk:
        yield talk.row()


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage by ``crc32(conv_id:turn) % 20``, and whether they are there.

    0 drops a row (it stays as a row that is not ``there``, so that its conversation is known),
    1 empties its text, 2 removes ``. ! ?`` from it, 3 repeats it, 4 sets its role to user.
    """

    def named(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat_ws(":", named("conv_id"), named("turn")), "UTF-8")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), named("role").alias("role"), named("text").alias("text"), kind.alias("_kind"))
    there = F.when(F.col("_kind") == 0, F.array(F.lit(False))).when(F.col("_kind") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    text = F.when(F.col("_kind") < 2, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(there).alias("there"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and letters of the cheapest edits, a hash.

    ``rows`` has ``conv_id, turn, role, text`` and may have ``there`` (false: the row only
    names its conversation).
    """
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    blank = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    taken = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *blank, there.alias("there"))
    ordered = taken.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    schema = (
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
        "cost long, audit string, repaired_sha256 string"
    )
    return map_rows(ordered, _repaired, schema)
