"""Transcript parsing: a hidden Markov model over speaker-marker and line features, decoded by Viterbi, and canonical rendering of turns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, table, trimmed

ROLES = ("system", "user", "assistant")
#: Each role begins a turn or continues one: the states of the model, in this order.
STATES = tuple((r, begins) for r in ROLES for begins in (True, False))
#: What a line may begin with to name its speaker (fixed values).
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "prompter", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "model", "a"),
}
_ROLE_OF = {w: r for r, ws in MARKERS.items() for w in ws}
_WORDS = "|".join(sorted(_ROLE_OF, key=lambda w: (-len(w), w)))
MARKER = re.compile(rf"[ \t]*(?:(?:#{{1,6}}|>{{1,2}}|\*\*|\[|<\|?)[ \t]*)?({_WORDS})(?:[ \t]*(?:\|?>|\]|\*\*))?[ \t]*(:|-(?=[ \t])|(?<=[\]>*])|$)(?:\*\*)?[ \t]*", re.IGNORECASE | re.ASCII)

#: A line's observation: the role its marker names (or none), whether the line before is blank or missing, its length class, a question mark.
N_MARKER, N_BLANK, N_LENGTH, N_MARK = 4, 2, 6, 2
OBSERVATIONS = N_MARKER * N_BLANK * N_LENGTH * N_MARK
#: A range of rows, the most that a task decodes at once, has up to 2 ** RANGE_BITS of them.
RANGE_BITS = 16


def marker(line: str) -> tuple[str | None, int]:
    """The role that a line's marker names and where its content begins."""
    m = MARKER.match(line)
    if not m:
        return None, 0
    bare = m[0].strip()
    if len(bare) == len(m[1]) and m[2] == "":  # a word alone on a line is content
        return None, 0
    return _ROLE_OF[m[1].lower()], m.end()


def observation(line: str, blank_before: bool) -> int:
    role, at = marker(line)
    n = len(line) - at
    length = 0 if n == 0 else min(5, 1 + int(np.log2(1 + n / 16)))
    return (((0 if role is None else 1 + ROLES.index(role)) * N_BLANK + blank_before) * N_LENGTH + length) * N_MARK + ("?" in line)


def observations(lines: list[str]) -> list[int]:
    """The observations of the lines of one part of a transcript; its first line counts as following a blank one."""
    return [observation(x, k == 0 or not lines[k - 1].strip()) for k, x in enumerate(lines)]


@dataclass
class Hmm:
    """Log-probabilities; all of a fixed size."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def prior() -> Hmm:
    """A model without training: markers name the role that begins, roles alternate after a user's turn."""
    s = len(STATES)
    start, step, emit = np.full(s, 1e-4), np.full((s, s), 1e-4), np.full((s, OBSERVATIONS), 1e-3)
    for k, (role, begins) in enumerate(STATES):
        start[k] = {"system": 0.2, "user": 0.7, "assistant": 0.1}[role] if begins else 1e-4
        for j, (to, starts) in enumerate(STATES):
            if to == role and not starts:
                step[k, j] = 0.7
            elif starts and to != role:
                step[k, j] = 0.25 if (role, to) in (("user", "assistant"), ("assistant", "user"), ("system", "user")) else 0.01
        for o in range(OBSERVATIONS):
            named, blank = o // (N_BLANK * N_LENGTH * N_MARK), o // (N_LENGTH * N_MARK) % N_BLANK
            if begins:
                emit[k, o] = (0.8 if named == 1 + ROLES.index(role) else 0.15 if named == 0 else 0.01) * (0.7 if blank else 0.3)
            else:
                emit[k, o] = (0.95 if named == 0 else 0.01) * (0.15 if blank else 0.85)
    return Hmm(*(np.log(x / x.sum(axis=-1, keepdims=True)) for x in (start, step, emit)))


def fitted(starts: np.ndarray, steps: np.ndarray, emits: np.ndarray, weight: float = 20.0) -> Hmm:
    """Counts of labelled transcripts on top of the prior, which counts as `weight` of each row."""
    p = prior()
    rows = [x + weight * np.exp(q) for x, q in ((starts, p.start), (steps, p.step), (emits, p.emit))]
    return Hmm(*(np.log(x / x.sum(axis=-1, keepdims=True)) for x in rows))


def run_scores(hmm: Hmm, seen: np.ndarray, enter: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The best score of each state of the last line, and the best state before each line.

    enter: rows of scores of the states before the first line; None where the transcript starts here.
    """
    back = []
    if enter is None:
        score, seen = (hmm.start + hmm.emit[:, seen[0]])[None], seen[1:]
    else:
        score = enter
    for o in seen:
        through = score[:, :, None] + hmm.step[None]
        back.append(through.argmax(axis=1))
        score = through.max(axis=1) + hmm.emit[:, o][None]
    return score, back


def transfer(hmm: Hmm, seen: np.ndarray) -> np.ndarray:
    """The max-plus matrix of a run of lines: from the state before them to the state of the last."""
    enter = np.full((len(STATES),) * 2, -np.inf)
    np.fill_diagonal(enter, 0.0)
    return run_scores(hmm, seen, enter)[0]


def viterbi(hmm: Hmm, seen: np.ndarray, enter: np.ndarray | None = None, leave: int | None = None) -> list[int]:
    """The best states of a run. enter: scores of the states before it; leave: the state of its last line where later lines settle it."""
    score, back = run_scores(hmm, seen, None if enter is None else enter[None])
    path = [int(score[0].argmax()) if leave is None else leave]
    for b in reversed(back if enter is None else back[1:]):
        path.append(int(b[0, path[-1]]))
    return path[::-1]


def join_runs(hmm_edges: list[dict]) -> dict[int, dict]:
    """How the runs at the partitions' ends continue each other: for each partition the entering scores of its first run and the states in which its first and last runs end, where other partitions settle them.

    hmm_edges: by partition, its number, the keys of its first and last run, whether they are one run, the first run's
    transfer matrix, and the start scores of both.
    """
    told: dict[int, dict] = {e["pid"]: {"enter": None, "first_leave": None, "last_leave": None} for e in hmm_edges}
    outs, key, score = [], object(), None
    for e in hmm_edges:
        if e["first"] == key:
            told[e["pid"]]["enter"] = score
            out = (score[:, None] + e["matrix"]).max(axis=0)
        else:
            out = e["first_start"]
        out = out - out.max()
        outs.append(out)
        key, score = e["last"], out if e["one"] else e["last_start"]
    for at in range(len(hmm_edges) - 1, 0, -1):
        e, before = hmm_edges[at], hmm_edges[at - 1]
        mine = told[e["pid"]]
        if mine["enter"] is None:
            continue
        end = mine["last_leave"] if e["one"] and mine["last_leave"] is not None else int(outs[at].argmax())
        mine["first_leave"] = end
        state = int((mine["enter"] + e["matrix"][:, end]).argmax())
        told[before["pid"]]["last_leave"] = state
        if before["one"]:
            told[before["pid"]]["first_leave"] = state
    return told


def rendered(lines: list[str], states: list[int]) -> tuple[list[str], str]:
    """The roles of the turns that lines hold, one that goes on from before among them, and the canonical text: <|role|>, a newline, the content and a newline for each turn that begins."""
    roles, out = [], []
    for line, k in zip(lines, states, strict=True):
        role, begins = STATES[k]
        if begins:
            out.append(f"<|{role}|>")
            line = line[marker(line)[1] :]
            if line.strip():
                out.append(line)
        else:
            out.append(line)
        if begins or not roles:
            roles.append(role)
    while out and not out[-1].strip():
        out.pop()
    return roles, "".join(x + "\n" for x in out)


def _runs(batches: Iterator) -> Iterator[tuple[int, object, list[tuple]]]:
    """(partition number, key, rows) of the runs of one key within one partition number, in order; rows: (key, place, text, label)."""
    at, rows = None, []
    for batch in batches:
        for pid, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (pid, row[0]) and rows:
                yield at[0], at[1], rows
                rows = []
            at = (pid, row[0])
            rows.append(tuple(row))
    if rows:
        yield at[0], at[1], rows


def _seen(rows: list[tuple]) -> np.ndarray:
    return np.array([o for r in rows for o in observations((r[2] or "").split("\n"))], np.int64)


def ordered(parts: DataFrame) -> DataFrame:
    """parts (conv_id, turn, text, label) with the number of the range they lie in, ranges in the order of (conv_id, turn, text).

    A conversation of any length spans as many ranges as it takes, so none has to fit a task, and neither do rows that
    are equal: they share out by their numbers. Columns but these four aren't read.
    """
    slim = parts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label"))
    order = ["conv_id", "turn", "text", "label"]
    dealt = slim.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(partitions(parts.sparkSession), *order[:2], F.xxhash64("text", "label"), "own")
    # a partition's rows are numbered from its own number << 33 on
    pid = F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)
    return Scratch(parts.sparkSession, "transcripts").write(dealt.drop("own").sortWithinPartitions(*order).select(pid.alias("pid"), *order))


def _in_order(frame: DataFrame) -> DataFrame:
    return frame.repartition("pid").sortWithinPartitions("pid", "conv_id", "turn", "text", "label")


def learned(frame: DataFrame) -> Hmm:
    """A model from the labelled parts of an `ordered` frame: every line of a part has its label, the first line begins a turn.

    Counts are summed over all labelled rows. Each range also returns its two ends, so that a conversation that goes on
    from one range to the next begins once and its transition between them counts; the result doesn't depend on the
    ranges. The model's size is fixed.
    """
    kind = "what string, i int, j int, n long, pid long, first long, last long"

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[tuple, int] = {}
        ends: list[dict] = []
        for pid, conv, rows in _runs(batches):
            new = not ends or ends[-1]["pid"] != pid
            if new:
                ends.append({"what": "end", "pid": pid, "first": conv, "i": None})
            state, begins = None, not new
            for r in rows:
                if r[3] not in ROLES:
                    state, begins = None, False
                    continue
                for k, o in enumerate(observations((r[2] or "").split("\n"))):
                    now = STATES.index((r[3], k == 0))
                    hit = ("start", 0, now) if begins else ("step", state, now) if state is not None else None
                    for key in (hit, ("emit", now, o)):
                        if key:
                            total[key] = total.get(key, 0) + 1
                    state, begins = now, False
            if new and rows[0][3] in ROLES:
                ends[-1]["i"] = STATES.index((rows[0][3], True))
            ends[-1] |= {"last": conv, "j": state}
        fields = pa.schema([("what", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("pid", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
        yield pa.RecordBatch.from_pylist([{"what": w, "i": i, "j": j, "n": n} for (w, i, j), n in total.items()] + ends, schema=fields)

    counts = {"start": np.zeros((1, len(STATES))), "step": np.zeros((len(STATES),) * 2), "emit": np.zeros((len(STATES), OBSERVATIONS))}
    rows = _in_order(frame).mapInArrow(trimmed(count), kind).groupBy("what", "i", "j", "pid", "first", "last").agg(F.sum("n").alias("n")).collect()
    ends = sorted((r for r in rows if r["what"] == "end"), key=lambda r: r["pid"])
    for r in rows:
        if r["what"] != "end":
            counts[r["what"]][r["i"], r["j"]] += r["n"]
    # i: the state of a range's first line, j: that of its last
    for before, e in zip([None, *ends], ends, strict=False):
        if e["i"] is not None:
            if before is None or before["last"] != e["first"]:
                counts["start"][0, e["i"]] += 1
            elif before["j"] is not None:
                counts["step"][before["j"], e["i"]] += 1
    return fitted(counts["start"][0], counts["step"], counts["emit"])


def parsed(frame: DataFrame, hmm: Hmm | None = None) -> DataFrame:
    """conv_id, turn, label, roles, rendered for each part of an `ordered` frame; labels pass through unread.

    The parts of a conversation in the order of (turn, text) are the lines of one transcript. Viterbi finds its best
    states: a first pass returns the max-plus matrix of the run at each range's start and the scores of the one at its
    end, two rows a range, which the driver joins; a second decodes every run with what is known at its ends, so the
    result is that of the whole transcript. roles are those of the turns in the part, first the one that goes on from
    the part before if its first line begins none; rendered is the part of the canonical transcript. A null text is one
    empty line, null ids and turns are keys like others, repeated rows follow each other, of paths that tie the one whose
    states stand first in STATES is taken, an empty table gives no rows. A text must fit a task; a range of them does.
    """
    spark: SparkSession = frame.sparkSession
    shared = spark.sparkContext.broadcast(hmm or prior())

    edge_type = "pid long, first long, last long, one boolean, matrix array<double>, first_start array<double>, last_start array<double>"

    def edges(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, e, last = shared.value, None, None
        kind = pa.schema([("pid", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("one", pa.bool_()), *((c, pa.list_(pa.float64())) for c in ("matrix", "first_start", "last_start"))])

        def finished():
            start = e["first_start"] if e["one"] else run_scores(model, _seen(last[1]), None)[0][0].tolist()
            return pa.RecordBatch.from_pylist([e | {"last": last[0], "last_start": start}], schema=kind)

        for pid, key, rows in _runs(batches):
            if e is None or e["pid"] != pid:
                if e is not None:
                    yield finished()
                seen = _seen(rows)
                e = {"pid": pid, "first": key, "one": True, "matrix": transfer(model, seen).ravel().tolist(), "first_start": run_scores(model, seen, None)[0][0].tolist()}
            else:
                e["one"] = False
            last = (key, rows)
        if e is not None:
            yield finished()

    def row(r) -> dict:
        return r.asDict() | {"matrix": np.array(r["matrix"]).reshape(len(STATES), -1), "first_start": np.array(r["first_start"]), "last_start": np.array(r["last_start"])}

    ends = _in_order(frame).mapInArrow(trimmed(edges), edge_type).orderBy("pid").collect()
    told = spark.sparkContext.broadcast(join_runs([row(r) for r in ends]))
    ends_of = spark.sparkContext.broadcast({r["pid"]: (r["first"], r["last"]) for r in ends})

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("label", pa.string()), ("roles", pa.list_(pa.string())), ("rendered", pa.string())])
        model, before, out = shared.value, None, []
        for pid, key, rows in _runs(batches):
            t, first, (_, last_key) = told.value[pid], before != pid, ends_of.value[pid]
            enter = t["enter"] if first else None
            leave = t["first_leave"] if first and t["first_leave"] is not None else t["last_leave"] if key == last_key else None
            states, at = viterbi(model, _seen(rows), enter, leave), 0
            for r in rows:
                lines = (r[2] or "").split("\n")
                roles, text = rendered(lines, states[at : at + len(lines)])
                at += len(lines)
                out.append({"conv_id": r[0], "turn": r[1], "label": r[3], "roles": roles, "rendered": text})
            before = pid
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return _in_order(frame).mapInArrow(trimmed(decode), "conv_id long, turn long, label string, roles array<string>, rendered string")


def decoded(parts: list[str], hmm: Hmm) -> list[tuple[str, bool]]:
    """(role, begins) of each line of one transcript, on one machine."""
    return [STATES[k] for k in viterbi(hmm, np.array([o for p in parts for o in observations(p.split("\n"))]))]


#: How the query writes each speaker into its raw transcripts, by the conversation's number; the last names none.
STYLES = (("System: ", "User: ", "Assistant: "), ("### Instructions:\n", "### Human:\n", "### Assistant:\n"), ("[system] ", "[user] ", "[bot] "), ("Context: ", "Q: ", "A: "), ("", "", ""))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """The parts of raw transcripts: each turn's text after a marker in its conversation's style."""
    style = F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(len(STYLES))), F.lit(0)).cast("int")
    mark = F.lit("")
    for k, names in enumerate(STYLES):
        for role, name in zip(ROLES, names, strict=True):
            mark = F.when((style == k) & (F.col("role") == role), F.lit(name)).otherwise(mark)
    return conversations.select("conv_id", "turn", F.concat(mark, F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), F.col("role").cast("string").alias("label"))


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = ordered(raw_transcripts(table(spark, sf_dir, "conversations")))
    out = parsed(frame, learned(frame))
    return out.select("conv_id", "turn", F.array_join("roles", ",").alias("role"), F.col("label").alias("labelled"), F.md5(F.col("rendered").cast("binary")).alias("rendered_md5"), F.length("rendered").cast("long").alias("n_chars"))
