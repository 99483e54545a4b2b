"""Transcript parsing: a hidden Markov model recovers who speaks each line.

States are a role and whether the line begins a turn. Emissions are
independent given the state: the speaker marker at the line's start, the
line's length class, its first character's class, its last character, and
whether a blank line stands before it. Counts come from labelled conversations
(the documented bounds of the fit: at most ``sample``, of each the first
``turns`` rows, of each row ``chars`` characters) written in several marker
styles, some turns without any marker. Viterbi finds the best states of a
transcript; each turn is then written in one canonical form, without its marker.

``parsed`` takes transcripts whole, a row each. ``transcripts`` makes them from
conversation rows as pieces of about ``PIECE`` turns, cut from sorted partitions,
so that a conversation of any length is never held in one task; ``parsed_pieces``
parses pieces by one Viterbi over the whole conversation: each piece of a cut
conversation gives the best scores between its first and last states (48
numbers), these are folded in order, and each piece is then decoded between the
states that the whole path has at its ends. The renderings of a conversation's
pieces, one after the other, are the rendering of the whole.

A null or empty transcript has no turns; null and repeated turn numbers sort
together, and a null conversation id is one of its own. Roles other than the
three known ones are written without a marker and count as ``user`` in the fit.
Ties in Viterbi go to the first state in the listed order. Repeated rows are
parsed each for itself; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

ROLES = ("system", "user", "assistant")
STATES = tuple((r, first) for r in ROLES for first in (True, False))
SAMPLE, TURNS, CHARS, PIECE = 2000, 64, 4000, 256

# Marker styles of transcripts, for the roles in order.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System\n", "### Human\n", "### Assistant\n"),
    ("[system] ", "[user] ", "[assistant] "),
    ("<sys> ", "<usr> ", "<bot> "),
    ("S> ", "Q> ", "A> "),
    ("**System:** ", "**Human:** ", "**AI:** "),
)
_MARK = re.compile(r"^(?:(#{1,4} ?[A-Za-z]{1,12})\s*$|\*\*([A-Za-z]{1,12}):\*\* ?|([A-Za-z]{1,12}):(?= |$) ?|([\[<][A-Za-z]{1,12}[\]>]) ?|([A-Z]>) ?)")


def marker(line: str) -> tuple[str, int]:
    """(marker, its length) at a line's start, or ("", 0)."""
    m = _MARK.match(line)
    return (next(g for g in m.groups() if g).lower(), m.end()) if m else ("", 0)


def logical(text: str) -> list[str]:
    """Lines, where one that is a marker and nothing else is joined with the next."""
    out: list[str] = []
    open_ = False
    for line in text.split("\n"):
        if open_:
            out[-1] += "\n" + line
        else:
            out.append(line)
        open_ = not open_ and 0 < marker(line)[1] == len(line)
    return out


def observed(lines: list[str], blank: bool = True) -> list[tuple]:
    out = []
    for line in lines:
        mark, size = marker(line.split("\n")[0])
        line = line[size:].removeprefix("\n")
        first = line[:1]
        kind = 0 if not first else 1 if first.isupper() else 2 if first.islower() else 3
        out.append((mark, min(12, len(line).bit_length()), kind, line[-1:] if line[-1:] in ("?", ".", ":", "") else "x", blank))
        blank = not line.strip()
    return out


def written_as(turns: list[tuple[str | None, str | None]], style: int, bare: int = 0, start: int = 0) -> tuple[str, list[int]]:
    """A transcript and the state of each line. With ``bare``, each turn whose number it divides has no marker; ``start`` turns stand before these."""
    lines, states = [], []
    for i, (role, text) in enumerate(turns, start):
        known = role in ROLES
        mark = STYLES[style][ROLES.index(role)] if known and not (bare and i % bare == bare - 1) else ""
        own = (mark + (text or "")).split("\n")
        if not mark and i:
            own = ["", *own]
        role = role if known else "user"
        first = 1 if not mark and i else 0
        if first:
            own = ["", *logical("\n".join(own[1:]))]
        else:
            own = logical("\n".join(own))
        lines += own
        if first:  # the blank line still belongs to the turn before
            states.append(states[-1] // 2 * 2 + 1 if states else STATES.index((role, False)))
        states += [STATES.index((role, k == first)) for k in range(first, len(own))]
    return "\n".join(lines), states


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, tables: list[dict], default: list[np.ndarray]):
        self.start, self.move, self.tables, self.default = start, move, tables, default

    @staticmethod
    def fit(conversations: list[list[tuple[str | None, str | None]]]) -> Hmm:
        n = len(STATES)
        start, move = np.full(n, 0.01), np.full((n, n), 0.01)
        counts: list[dict] = [{} for _ in range(5)]
        total = np.zeros(n)
        for c, turns in enumerate(conversations):
            if not turns:
                continue
            for bare in (0, 3):
                text, states = written_as(turns, (c + bare) % len(STYLES), bare)
                start[states[0]] += 1
                np.add.at(move, (states[:-1], states[1:]), 1)
                np.add.at(total, states, 1)
                for s, o in zip(states, observed(logical(text))):
                    for f, value in enumerate(o):
                        counts[f].setdefault(value, np.zeros(n))[s] += 1
        tables, default = [], []
        for t in counts:
            size = len(t) + 1
            tables.append({k: np.log((x + 0.1) / (total + 0.1 * size)) for k, x in t.items()})
            default.append(np.zeros(n))  # a value never seen says nothing
        return Hmm(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), tables, default)

    def emissions(self, lines: list[str], blank: bool = True) -> list[np.ndarray]:
        return [sum(t.get(x, d) for t, x, d in zip(self.tables, o, self.default)) for o in observed(lines, blank)]

    def states(self, lines: list[str], blank: bool = True, first: int | None = None, last: int | None = None) -> list[int]:
        """The best path; between fixed first and last states where they are given."""
        back, v = [], None
        for e in self.emissions(lines, blank):
            if v is None:
                v = self.start + e if first is None else np.where(np.arange(len(e)) == first, e, -np.inf)
            else:
                step = v[:, None] + self.move
                best = step.argmax(axis=0)
                back.append(best.astype(np.int8))
                v = step[best, np.arange(len(v))] + e
        at = [int(v.argmax()) if last is None else last]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        return at[::-1]

    def summary(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(best scores from each first to each last state, without the first line; the first line's emissions after a blank line and after another)."""
        e = self.emissions(lines)
        n = len(STATES)
        v = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)
        for x in e[1:]:
            v = (v[:, :, None] + self.move[None]).max(axis=1) + x
        return v, np.stack([e[0], self.emissions(lines[:1], False)[0]])

    def joined(self, parts: list[tuple[np.ndarray, np.ndarray, bool]]) -> list[tuple[bool, int, int]]:
        """(whether a blank line stands before, first state, last state) of each piece on the best path of the whole; ``parts`` are their summaries and whether their last line is blank."""
        v, blank, back = None, True, []
        for scores, e, ends_blank in parts:
            own = e[0 if blank else 1]
            if v is None:
                entry, first = None, self.start + own
            else:
                step = v[:, None] + self.move
                entry = step.argmax(axis=0)
                first = step[entry, np.arange(len(v))] + own
            through = first[:, None] + scores
            best = through.argmax(axis=0)
            back.append((blank, entry, best))
            v, blank = through[best, np.arange(len(best))], ends_blank
        last, out = int(v.argmax()), []
        for blank, entry, best in reversed(back):
            first = int(best[last])
            out.append((blank, first, last))
            last = int(entry[first]) if entry is not None else -1
        return out[::-1]

    def turns(self, lines: list[str], states: list[int], before: int | None = None) -> tuple[bool, list[tuple[str, list[str]]]]:
        """(whether the first turn goes on from a line of state ``before``, (role, lines) of each turn)."""
        out: list[tuple[str, list[str]]] = []
        goes_on = before is not None and not STATES[states[0]][1] and STATES[before][0] == STATES[states[0]][0]
        for line, s in zip(lines, states):
            role, first = STATES[s]
            if first or not out or out[-1][0] != role:
                out.append((role, [line[marker(line.split("\n")[0])[1] if first else 0 :]]))
            else:
                out[-1][1].append(line)
        return goes_on, out

    def parse(self, transcript: str | None) -> list[tuple[str, str]]:
        """(role, text) of each turn."""
        if not transcript:
            return []
        lines = logical(transcript)
        return [(r, "\n".join(x).strip()) for r, x in self.turns(lines, self.states(lines))[1]]


def rendered(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)


def train(conversations: DataFrame, sample: int = SAMPLE, turns: int = TURNS, chars: int = CHARS) -> Hmm:
    """Fits on a bounded sample, cut on the executors before it is gathered."""
    few = conversations.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample)
    few = few.select(F.col("conv_id").alias("__c"))
    own = conversations.join(F.broadcast(few), F.col("conv_id").eqNullSafe(F.col("__c"))).select("conv_id", "turn", "role", F.substring("text", 1, chars).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = own.withColumn("place", place).where(F.col("place") <= turns).collect()
    talks: dict = {}
    for r in sorted(rows, key=lambda r: (str(r.conv_id), r.place)):
        talks.setdefault(r.conv_id, []).append((r.role, r.text))
    return Hmm.fit(list(talks.values()))


def parsed(transcripts: DataFrame, model: Hmm, keep: tuple[str, ...] = ("id",), text_col: str = "transcript") -> DataFrame:
    """The columns ``keep`` of each transcript with n_lines, n_turns, roles (comma-joined) and rendered."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)
    k = len(keep)

    def scan(batches):
        for batch in batches:
            texts = batch.column(k).to_pylist()
            turns = [shared.value.parse(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([len(x) for x in turns], pa.int64()), pa.array([",".join(r for r, _ in x) for x in turns]), pa.array([rendered(x) for x in turns])], names=[*keep, "n_lines", "n_turns", "roles", "rendered"])

    schema = transcripts.select(*keep).schema.add("n_lines", "long").add("n_turns", "long").add("roles", "string").add("rendered", "string")
    return transcripts.select(*keep, text_col).mapInArrow(scan, schema)


def transcripts(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, part, seq, transcript, truth): every conversation as raw text in pieces that follow by (part, seq), its style chosen by a hash of its id, each third turn bare in half of them.

    Rows are sorted over ranges of (conv_id, turn, role, text hash), so a long conversation spans partitions and each streams through its task.
    """

    def write(batches):
        at, seq, start, held = (), 0, 0, []
        part = TaskContext.get().partitionId()

        def told():
            dice = hashlib.sha256(str(at[0]).encode()).digest()
            text = written_as(held, dice[0] % len(STYLES), 3 * (dice[1] % 2), start)[0]
            columns = [pa.array([at[0]], kind), *(pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (text, pa.string()), (",".join(r or "" for r, _ in held), pa.string())))]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "seq", "transcript", "truth"])

        for batch in batches:
            kind = batch.column(0).type
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (at != (conv,) or len(held) >= (4 * piece if _open(held[-1]) else piece)):
                    yield told()
                    seq, start = (seq + 1, start + len(held)) if at == (conv,) else (0, 0)
                    held = []
                at = (conv,)
                held.append((role, text))
        if held:
            yield told()

    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["conv_id", "turn", F.xxhash64("role", "text")]
    rows = conversations.select("conv_id", "turn", "role", "text").repartitionByRange(parts, *key).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = conversations.select("conv_id").schema.add("part", "integer").add("seq", "integer").add("transcript", "string").add("truth", "string")
    return rows.select("conv_id", "role", "text").mapInArrow(write, schema)


def _open(turn: tuple[str | None, str | None]) -> bool:
    """Whether a turn's last line may be a bare marker, which the next line belongs to: a piece ends there only if it has grown to four times its size."""
    last = (turn[1] or "").rsplit("\n", 1)[-1]
    return not last.strip() or 0 < marker(last)[1] == len(last)


def parsed_pieces(pieces: DataFrame, model: Hmm, keep: tuple[str, ...] = ("truth",)) -> DataFrame:
    """(conv_id, part, seq), ``keep``, n_lines, n_turns (that begin here), roles (theirs, comma-joined) and rendered of each piece, parsed with all others of its conversation."""
    pieces = written(pieces, "pieces")
    shared = pieces.sparkSession.sparkContext.broadcast(model)
    key = ["conv_id", "part", "seq"]
    many = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("__c"))
    cut = pieces.join(many, F.col("conv_id").eqNullSafe(F.col("__c")), "left_semi")

    def sums(batches):
        for batch in batches:
            blobs = []
            for text in batch.column(3).to_pylist():
                lines = logical(text or "")
                scores, e = shared.value.summary(lines)
                blobs.append(np.concatenate([scores.ravel(), e.ravel(), [float(not lines[-1].strip())]]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], names=[*key, "s"])

    def fold(batches):
        n = len(STATES)
        for batch in batches:
            for conv, rows in zip(batch.column(0), batch.column(1).to_pylist()):
                flat = [np.frombuffer(r["s"]) for r in rows]
                path = shared.value.joined([(x[: n * n].reshape(n, n), x[n * n : -1].reshape(2, n), bool(x[-1])) for x in flat])
                k = len(rows)
                before, after = [None, *(p[2] for p in path[:-1])], [*(p[1] for p in path[1:]), None]
                cols = [[r["part"] for r in rows], [r["seq"] for r in rows], *zip(*path), before, after]
                kinds = [pa.int32(), pa.int32(), pa.bool_(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv.as_py()] * k, conv.type), *(pa.array(list(c), t) for c, t in zip(cols, kinds))],
                    names=[*key, "blank", "first", "last", "before", "after"],
                )

    ends = pieces.select("conv_id").schema.add("part", "integer").add("seq", "integer")
    tail = ends.add("s", "binary")
    found = cut.select(*key, "transcript").mapInArrow(sums, tail)
    # 49 numbers for a piece of hundreds of turns: the only place where a conversation's pieces meet.
    met = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "s"))).alias("rows"))
    schema = pieces.select(*key).schema.add("blank", "boolean").add("first", "integer").add("last", "integer").add("before", "integer").add("after", "integer")
    bounds = written(met.mapInArrow(fold, schema), "bounds")
    b = bounds.select(*[F.col(c).alias(f"__{c}") for c in bounds.columns])
    same = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("part") == F.col("__part")) & (F.col("seq") == F.col("__seq"))
    full = pieces.join(b, same, "left").select(*key, *keep, "transcript", "__blank", "__first", "__last", "__before", "__after")
    k = len(key) + len(keep)

    def scan(batches):
        m = shared.value
        for batch in batches:
            n_lines, n_turns, roles, texts = [], [], [], []
            for text, blank, first, last, before, after in zip(*(c.to_pylist() for c in batch.columns[k:])):
                if not text:
                    n_lines.append(0), n_turns.append(0), roles.append(""), texts.append("")
                    continue
                lines = logical(text)
                states = m.states(lines, True if blank is None else blank, first, last)
                goes_on, turns = m.turns(lines, states, before)
                open_ = after is not None and not STATES[after][1] and STATES[after][0] == STATES[states[-1]][0]
                own = [r for r, _ in turns[goes_on:]]
                n_lines.append(text.count("\n") + 1), n_turns.append(len(own)), roles.append(",".join(own))
                texts.append(_piece(turns, goes_on, open_))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(n_lines, pa.int64()), pa.array(n_turns, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=[*key, *keep, "n_lines", "n_turns", "roles", "rendered"])

    out = pieces.select(*key, *keep).schema.add("n_lines", "long").add("n_turns", "long").add("roles", "string").add("rendered", "string")
    return full.mapInArrow(scan, out)


def _piece(turns: list[tuple[str, list[str]]], goes_on: bool, open_: bool) -> str:
    """``rendered`` for a piece whose first turn may have begun before it and whose last may end after it."""
    out = []
    for i, (role, lines) in enumerate(turns):
        text = "\n".join(lines)
        begins, ends = i > 0 or not goes_on, i < len(turns) - 1 or not open_
        text = text.lstrip() if begins else text
        text = text.rstrip() if ends else text
        out.append((f"<|{role}|>\n" if begins else "") + text + ("\n<|end|>\n" if ends else "\n"))
    return "".join(out)
