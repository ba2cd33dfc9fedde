"""Chat formatting: a hidden Markov model recovers turns and roles from transcripts, Viterbi decodes them.

A transcript is lines of text; some begin with a speaker marker of a known role ("User:", "### Assistant",
"[system]", "<|user|>", "Q:"), some with a name ("Alice:"), some transcripts have no markers at all. The
states are (style of the whole transcript, role, whether the line begins a turn). Emissions look at the
marker, by the style, and at features of the line by the role (question mark, code fence or list item,
length, address to the model). In the known style a marker tells the role and other beginnings are rare;
in the named style a name begins a turn and alternation tells the role; in the plain style lines and
alternation tell both. What a marker of a known role says outweighs any count. The most probable path gives turns, rendered canonically.

``fit`` counts starts, successions of roles, lines a turn and features by role in a table of conversations,
smoothed towards ``PRIOR``; what markers look like is given.

Transcripts come in pieces, so that a very long one is not decoded in one task: each piece of several
first gives its max-plus transfer matrix, the matrices of a transcript are chained, and each piece is then
decoded between the states it is entered and left in: the path of the whole transcript.

Defined results: a null text is empty; blank lines go on with a turn, and a transcript without any
other line has no turns; what precedes the first marker is a turn like others; null ids are one
transcript; pieces are ordered by (order, null last; text), so repeated rows are read in sequence. An
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, plain

ROLES = ("system", "user", "assistant")
#: Names of speakers, by role.
NAMES = {"system": ("system", "sys", "instruction", "instructions"), "user": ("user", "human", "question", "q", "prompt", "customer", "you", "me"), "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent", "response")}
ROLE_OF = {name: r for r, role in enumerate(ROLES) for name in NAMES[role]}
_NAME = "|".join(sorted(ROLE_OF, key=len, reverse=True))
MARKER = re.compile(rf"\s*(?:(?:[#*>\-]+\s*)?[*_]{{0,2}}({_NAME})[*_]{{0,2}}\s*[:>]\s?[*_]{{0,2}}|[#]{{2,}}\s*({_NAME})\s*$|\[({_NAME})\]:?\s?|<\|(?:im_start\|>)?({_NAME})(?:\|>)?\s?)", re.IGNORECASE)
LISTED = re.compile(r"\s*(?:[-*]|[0-9]+\.)\s")
NAMED = re.compile(r"\s*[*_]{0,2}[A-Z][A-Za-z'.-]{0,19}[*_]{0,2}\s*:\s")
STYLES = ("known", "named", "plain")
STATES = 18  # (style * 3 + role) * 2 + (0: begins a turn, 1: goes on)
FEATURES = ("asks", "code", "long", "instructs")


class Model:
    """Log-probabilities: of starts and steps between states, and of a line in each state."""

    def __init__(self, start: np.ndarray, follows: np.ndarray, goes_on: float, features: np.ndarray, styles: tuple[float, ...] = (0.95, 0.04, 0.01)):
        """start: roles that begin; follows: roles after roles; goes_on: a line that begins no turn; features: of lines, by role."""
        self.start, self.step = np.full(STATES, -np.inf), np.full((STATES, STATES), -np.inf)
        self.features, self.known = features, {}
        for s, style in enumerate(styles):
            for a in range(3):
                at = 6 * s + 2 * a
                self.start[at] = np.log(style * start[a])
                for x in (at, at + 1):
                    self.step[x, at + 1] = np.log(goes_on)
                    for b in range(3):
                        self.step[x, 6 * s + 2 * b] = np.log((1 - goes_on) * follows[a, b])

    def likelihood(self, told: int | None, named: bool, has: tuple[bool, ...], blank: bool) -> np.ndarray:
        """Log-likelihood of a line's marker and features in each state."""
        key = (told, named, has, blank)
        if key not in self.known:
            out = np.empty(STATES)
            for r in range(3):
                own = sum(np.log(p if f else 1 - p) for p, f in zip(self.features[r], has, strict=True))
                known, by_name, bare = told is not None, named and told is None, told is None and not named
                begins = (
                    (0.96 if told == r else 1e-12) if known else 0.03,
                    0.9 if by_name else 0.045 if bare else 0.05 if told == r else 1e-12,
                    0.98 if bare else 0.01,
                )
                on = (1e-9 if known else 0.05 if by_name else 0.94, 1e-9 if known else 0.002 if by_name else 0.99, 0.002 if known else 0.01 if by_name else 0.98)
                for s in range(3):
                    out[6 * s + 2 * r], out[6 * s + 2 * r + 1] = np.log(begins[s]) + own, np.log(on[s]) + own
            if blank:
                out[::2] = -50.0
            self.known[key] = out
        return self.known[key]


PRIOR = Model(
    np.array([0.25, 0.65, 0.10]), np.array([[0.05, 0.85, 0.10], [0.02, 0.08, 0.90], [0.03, 0.87, 0.10]]), 0.6,
    np.array([[0.10, 0.15, 0.10, 0.50], [0.45, 0.10, 0.05, 0.02], [0.10, 0.25, 0.15, 0.01]]),
)


def _features(text: str) -> tuple[bool, ...]:
    return text.rstrip().endswith("?"), text.startswith(("    ", "```")) or LISTED.match(text) is not None, len(text) > 400, text[:7].lower() == "you are"


def emissions(line: str, model: Model = PRIOR) -> tuple[np.ndarray, tuple[int, int, int]]:
    """(log-likelihood by state, characters of the marker by style)."""
    m, n = MARKER.match(line), NAMED.match(line)
    told = next((ROLE_OF[g.lower()] for g in m.groups() if g), None) if m else None
    cut = m.end() if m else 0
    by_name = cut or (n.end() if n else 0)
    return model.likelihood(told, n is not None, _features(line[by_name:]), not line.strip()), (cut, by_name, cut)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By role: turns, lines, and lines with each feature."""
    total = np.zeros((3, 2 + len(FEATURES)), np.int64)
    for batch in batches:
        for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = text.split("\n")
            total[role, :2] += 1, len(lines)
            for line in lines:
                total[role, 2:] += _features(line)
    yield pa.record_batch([pa.array([0, 1, 2], pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["role", "counts"])


def fit(conversations: DataFrame, weight: float = 50.0) -> Model:
    """Counts of all turns of known roles, smoothed by ``weight`` observations of PRIOR: a few numbers on the driver.

    Successions are those of turn numbers that follow each other in a conversation; null ids and numbers have none.
    """
    rows = plain(conversations, conv_id="long", turn="long", role="string", text="string")
    place = F.create_map(*[F.lit(x) for name, r in ROLE_OF.items() for x in (name, r)])
    rows = rows.select("conv_id", "turn", F.element_at(place, F.lower(F.trim("role"))).alias("r"), F.coalesce("text", F.lit("")).alias("text")).where("r is not null")
    per_role = rows.select("r", "text").mapInArrow(_counts, "role int, counts array<long>")
    sums = {r["role"]: np.array([r[f"c{k}"] for k in range(6)], float) for r in per_role.groupBy("role").agg(*[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(6)]).collect()}
    turns = np.array([sums.get(r, np.zeros(6)) for r in range(3)])
    told = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", "r").distinct()
    after = told.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("r").alias("before"))
    pairs = {(r["before"], r["r"]): r["n"] for r in told.join(after, ["conv_id", "turn"], "left").groupBy("before", "r").agg(F.count("*").alias("n")).collect()}
    old = np.exp(PRIOR.start[[0, 2, 4]]) / np.exp(PRIOR.start[[0, 2, 4]]).sum()
    start = np.array([pairs.get((None, r), 0) for r in range(3)]) + weight * old
    on = np.exp(PRIOR.step[0, 1])
    follows = np.array([[pairs.get((a, b), 0) + weight * np.exp(PRIOR.step[2 * a, 2 * b]) / (1 - on) for b in range(3)] for a in range(3)])
    goes_on = (turns[:, 1].sum() - turns[:, 0].sum() + weight * on) / (turns[:, 1].sum() + weight)
    features = (turns[:, 2:] + weight * PRIOR.features) / (turns[:, 1:2] + weight)
    return Model(start / start.sum(), follows / follows.sum(1, keepdims=True), float(goes_on), features)


def transfer(lines: list[np.ndarray], model: Model = PRIOR) -> np.ndarray:
    """Best log-probability of the piece's lines from the state before it to the state at its end; styles never mix."""
    step = np.stack([model.step[x : x + 6, x : x + 6] for x in range(0, STATES, 6)])
    parts = np.broadcast_to(np.where(np.eye(6, dtype=bool), 0.0, -np.inf), step.shape)
    for e in lines:
        parts = (parts[:, :, :, None] + step[:, None]).max(2) + e.reshape(3, 1, 6)
    total = np.full((STATES, STATES), -np.inf)
    for s, x in enumerate(range(0, STATES, 6)):
        total[x : x + 6, x : x + 6] = parts[s]
    return total


def decode(lines: list[np.ndarray], entry: np.ndarray, leave: int | None = None, model: Model = PRIOR) -> list[int]:
    """The best states, given the log-probabilities of the state before (all -inf: a beginning) and the last state."""
    v, back = None, []
    for e in lines:
        if v is None and np.isneginf(entry).all():
            v = model.start + e
            back.append(np.full(STATES, -1))
            continue
        ways = (entry if v is None else v)[:, None] + model.step
        back.append(ways.argmax(0))
        v = ways.max(0) + e
    if v is None:
        return []
    path = [int(v.argmax()) if leave is None else leave]
    for b in back[:0:-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def _cut(line: str, cuts: tuple[int, int, int], state: int) -> str:
    return line if state % 2 else line[cuts[state // 6] :]


def turns(text: str, model: Model = PRIOR) -> list[tuple[str, str]]:
    """(role, content) of one whole transcript."""
    lines = (text or "").split("\n")
    seen = [emissions(x, model) for x in lines]
    if not any(x.strip() for x in lines):
        return []
    out: list[tuple[str, list[str]]] = []
    for line, (_, cuts), s in zip(lines, seen, decode([e for e, _ in seen], np.full(STATES, -np.inf), None, model), strict=True):
        if s % 2 == 0 or not out:
            out.append((ROLES[s % 6 // 2], [_cut(line, cuts, s)]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(content).strip()) for role, content in out]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal (id, piece), in order."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row)
    if held:
        yield key, held


def _piece(rows: list[tuple]) -> list[str]:
    return "\n".join(r[-1] or "" for r in rows).split("\n")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _matrices(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (conv, piece), own in _groups(batches):
                seen = [emissions(x, model)[0] for x in _piece(own)]
                head = model.start + seen[0]
                for e in seen[1:]:
                    head = (head[:, None] + model.step).max(0) + e
                yield conv, piece, transfer(seen, model).tobytes(), head.tobytes()

        yield from _batches(rows(), pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("matrix", pa.binary()), ("head", pa.binary())]))

    return run


def _chain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("piece")
    entries, v = [], np.full(STATES, -np.inf)
    for n, (matrix, head) in enumerate(zip(rows["matrix"], rows["head"], strict=True)):
        entries.append(v)
        v = np.frombuffer(head) if n == 0 else (v[:, None] + np.frombuffer(matrix).reshape(STATES, STATES)).max(0)
    leave = [int(v.argmax())]
    for entry, matrix in zip(entries[:0:-1], rows["matrix"].tolist()[:0:-1], strict=True):
        leave.append(int((entry + np.frombuffer(matrix).reshape(STATES, STATES)[:, leave[-1]]).argmax()))
    return pd.DataFrame({"conv_id": rows["conv_id"], "piece": rows["piece"], "entry": [e.tobytes() for e in entries], "leave": leave[::-1]})


def _decoded(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (conv, piece), own in _groups(batches):
                lines = _piece(own)
                seen = [emissions(x, model) for x in lines]
                alone = own[0][2] is None
                path = decode([e for e, _ in seen], np.full(STATES, -np.inf) if alone else np.frombuffer(own[0][2]), None if alone else own[0][3], model)
                out: list[list] = []
                for line, (_, cuts), s in zip(lines, seen, path, strict=True):
                    if s % 2 == 0 or not out:
                        out.append([s % 2 == 0, ROLES[s % 6 // 2], [_cut(line, cuts, s)]])
                    else:
                        out[-1][2].append(line)
                for at, (begins, role, content) in enumerate(out):
                    yield conv, piece, at, begins, role, "\n".join(content)

        kinds = [("conv_id", pa.int64()), ("piece", pa.int64()), ("at", pa.int64()), ("begins", pa.bool_()), ("role", pa.string()), ("content", pa.string())]
        yield from _batches(rows(), pa.schema(kinds))

    return run


def format_turns(pieces: DataFrame, scratch: Scratch, piece_turns: int = 256, model: Model = PRIOR) -> DataFrame:
    """conv_id, turn_index (from 0), role, content, rendered: the turns of each transcript.

    ``pieces``: rows (conv_id, ord, text), in the order of ord; ``piece_turns`` values of ord are one piece.
    """
    far = F.lit(1 << 62)
    rows = plain(pieces, conv_id="long", ord="long", text="string")
    rows = rows.select("conv_id", F.coalesce(F.floor(F.col("ord") / piece_turns), far).cast("long").alias("piece"), F.coalesce("ord", far).alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    placed = scratch.table(rows, "pieces")
    several = placed.select("conv_id", "piece").distinct().groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("c"))
    chained = placed.join(several, placed["conv_id"].eqNullSafe(several["c"]), "left_semi")
    chained = chained.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "ord", "text").select("conv_id", "piece", "text")
    matrices = chained.mapInArrow(_matrices(model), "conv_id long, piece long, matrix binary, head binary")
    states = scratch.table(matrices.groupBy("conv_id").applyInPandas(_chain, "conv_id long, piece long, entry binary, leave int"), "states")
    same = placed["conv_id"].eqNullSafe(states["conv_id"]) & (placed["piece"] == states["piece"])
    full = placed.join(states, same, "left").select(placed["conv_id"], placed["piece"], "entry", "leave", "ord", "text")
    full = full.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "ord", "text").drop("ord")
    found = full.mapInArrow(_decoded(model), "conv_id long, piece long, at long, begins boolean, role string, content string")
    found = scratch.table(found, "decoded")
    begun = found.groupBy("conv_id", "piece").agg(F.sum(F.col("begins").cast("long")).alias("n"))
    before = F.coalesce(F.expr("sum(n) over (partition by conv_id order by piece rows between unbounded preceding and 1 preceding)"), F.lit(0))
    begun = begun.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), before.alias("before"))
    found = found.join(begun, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
    # Within a piece all rows but a first that goes on begin a turn; its turn began in an earlier piece.
    goes_on = F.max((~F.col("begins")).cast("long")).over(Window.partitionBy("conv_id", "piece"))
    found = found.withColumn("turn_index", F.col("before") + F.col("at") - goes_on)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "content"))), lambda x: x["content"]), "\n")
    blank = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
    out = found.groupBy("conv_id", "turn_index").agg(F.max(F.when(F.col("begins"), F.col("role"))).alias("role"), F.regexp_replace(joined, blank, "").alias("content"))
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>")).alias("rendered")
    out = scratch.table(out.select("conv_id", "turn_index", "role", "content", rendered), "turns")
    scratch.drop("pieces", "states", "decoded")
    return out


def transcript_pieces(conversations: DataFrame) -> DataFrame:
    """(conv_id, ord, text) of a table (conv_id, turn, role, text): each turn with a marker for its role, none for a null or unknown one."""
    rows = plain(conversations, conv_id="long", turn="long", role="string", text="string")
    name = F.initcap(F.trim("role"))
    known = F.lower(F.trim("role")).isin(*ROLE_OF)
    text = F.when(known, F.concat(name, F.lit(": "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    return rows.select("conv_id", F.col("turn").alias("ord"), text.alias("text"))
