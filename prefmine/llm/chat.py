"""Chat formatting: recover the roles of a transcript and render its turns.

A hidden Markov model whose states are the roles runs over the lines of a
conversation.  A line shows a speaker marker (or none) and line features; the
marker may be a speaker label of the row or stand in the text ("Human:",
"### Assistant", "<|im_start|>user", "[INST]").  Transitions and emissions are
counted over all rows whose speaker is known; Viterbi finds the likeliest roles,
and lines of one role become one canonical turn.

Conversations are decoded in blocks of a bounded number of rows: each block is
summed up as a matrix (best score from every role before it to every role at its
end), the matrices of a conversation give the roles at the block borders (through
their products, in a tree of bounded groups), and with those every block is decoded on its own.  That is exact, and a conversation
with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.llm.common import Scratch, places

ROLES = ("system", "user", "assistant")
N = len(ROLES)
# Speaker names in common transcript formats.
SPEAKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "prompter", "client", "student", "me"),
    "assistant": ("assistant", "bot", "ai", "gpt", "chatgpt", "model", "answer", "a", "agent", "response", "teacher"),
}
ROLE_OF = {name: i for i, r in enumerate(ROLES) for name in SPEAKERS[r]}
NONE, OTHER = N, N + 1  # marker classes beside the roles: no marker, an unknown speaker
# Names that are as often words of a text ("Answer: 42"): markers only in rows without a speaker label.
WEAK = {"instruction", "instructions", "context", "customer", "question", "q", "client", "student", "me", "model", "answer", "a", "agent",
        "response", "teacher", "sys"}
_NAMES = "|".join(sorted(ROLE_OF, key=len, reverse=True))
# Special tokens, a heading of the name alone, and the name with a colon (or, from two letters on, with > right behind it).
MARKER = re.compile(rf"\s*(?:<\|im_start\|>\s*(?P<t>{_NAMES})\b\s*|<\|(?P<p>{_NAMES})\|>\s*|(?P<inst>\[INST\])\s*|(?P<sys><<SYS>>)\s*"
                    rf"|#{{1,4}}\s*(?P<h>{_NAMES})\s*:?\s*$|(?:#{{1,4}}\s*|\*\*|\[)?(?P<n>{_NAMES})(?:\s*\d+)?(?:\*\*|\])?(?:\s*:|(?<=\w\w)>)\s*(?:\*\*\s*)?)", re.I)
CLOSER = re.compile(r"\s*(?:<\|im_end\|>|\[/INST\]|<</SYS>>)\s*$", re.I)

FEATURES = 10  # ends with a question mark or not, five classes of length
SPEAKER_TRUST, SWITCH = 0.97, 0.02
GROUP_ROWS = 4096
FAN = 512  # matrices of a conversation that are multiplied in one call


def speaker_class(label: str | None) -> int:
    """Marker class of a row's speaker label."""
    name = (label or "").strip().strip(":#*[]<>| ").lower()
    return ROLE_OF.get(name, OTHER) if name else NONE


def read_line(line: str, labelled: bool = False) -> tuple[int, str, bool]:
    """(marker class, rest of the line, whether the marker is a special token).  In a row
    with a speaker label a weak name is no marker.  A closing token on the line of a special
    token goes with it."""
    m = MARKER.match(line)
    who = m and (m["t"] or m["p"] or m["h"] or m["n"])
    if not m or labelled and (m["h"] or m["n"] or "").lower() in WEAK:
        return NONE, line, False
    kind = ROLE_OF[who.lower()] if who else ROLES.index("user" if m["inst"] else "system")
    special = not (m["h"] or m["n"])
    return kind, CLOSER.sub("", line[m.end():]) if special else line[m.end():], special


def feature(content: str) -> int:
    n = len(content.split())
    size = 0 if not n else 1 if n <= 3 else 2 if n <= 12 else 3 if n <= 40 else 4
    return size + 5 * content.rstrip().endswith("?")


def observe(label: str | None, text: str | None) -> list[int]:
    """A code for every line: marker class * FEATURES + feature.  The row's label is
    the marker of its first line unless the line has its own."""
    out, given = [], speaker_class(label)
    for i, line in enumerate((text or "").split("\n")):
        kind, content, _ = read_line(line, given < N)
        if kind == NONE and i == 0:
            kind = given
        out.append(kind * FEATURES + feature(CLOSER.sub("", content)))
    return out


def turns_of(label: str | None, text: str | None, states: list[int], before: int | None) -> list[dict]:
    """The runs of lines of one role in a row: part, role, opens, content.

    A marker is cut off where the decoded role is its own and a turn opens there, and a
    closing token where such a special token opened the turn in this row; every other
    line stays whole, so no character outside true markers is lost.  A labelled row
    opens by its label: its first line is cut only if a special token or a strong name starts it.
    """
    parts: list[dict] = []
    last, token, given = before, False, speaker_class(label)
    for line, state in zip((text or "").split("\n"), states):
        kind, rest, special = read_line(line, given < N)
        new = not parts or state != last
        cut = kind == state and new and state != last
        if new:
            token = cut and special
        shown = rest if cut else line
        shown = CLOSER.sub("", shown) if token else shown
        if new:
            parts.append({"part": len(parts), "role": ROLES[state], "opens": state != last, "content": []})
        if not (cut and not shown):
            parts[-1]["content"].append(shown)
        last = state
    return [{**p, "content": "\n".join(p["content"])} for p in parts]


class Model:
    """Log probabilities: of the first role, of a turn's role after the last one's,
    inside a row, and of each observation."""

    def __init__(self, first: np.ndarray, after: np.ndarray, shown: np.ndarray):
        norm = lambda m: np.log((m + 1.0) / (m + 1.0).sum(-1, keepdims=True))
        self.first, self.turn, features = norm(first), norm(after), norm(shown)
        self.inside = np.log(np.where(np.eye(N) > 0, 1 - SWITCH, SWITCH / (N - 1)))
        self.emit = np.zeros(((N + 2) * FEATURES, N))
        for kind in range(N + 2):
            trust = np.full(N, 0.0) if kind >= N else np.log(
                np.where(np.arange(N) == kind, SPEAKER_TRUST, (1 - SPEAKER_TRUST) / (N - 1)))
            self.emit[kind * FEATURES : (kind + 1) * FEATURES] = trust + features.T

    def step(self, code: int, row_start: bool) -> np.ndarray:
        """Scores from the role before a line to its role, the line included.  A new
        row or a marker may begin a turn."""
        move = self.turn if row_start or code // FEATURES != NONE else self.inside
        return move + self.emit[code]

    def steps(self, rows: list[list[int]], opening: bool) -> Iterator[np.ndarray]:
        for r, codes in enumerate(rows):
            for i, code in enumerate(codes):
                if opening and r == i == 0:
                    yield np.broadcast_to(self.first, (N, N)) + self.emit[code]
                else:
                    yield self.step(code, i == 0)

    def matrix(self, rows: list[list[int]], opening: bool) -> np.ndarray:
        best = np.where(np.eye(N) > 0, 0.0, -np.inf)
        for s in self.steps(rows, opening):
            best = (best[:, :, None] + s[None]).max(1)
        return best

    def decode(self, rows: list[list[int]], opening: bool, enter: int, leave: int) -> list[list[int]]:
        """Viterbi between the role before the rows and the role at their end."""
        score, back = np.where(np.arange(N) == enter, 0.0, -np.inf), []
        for s in self.steps(rows, opening):
            reach = score[:, None] + s
            back.append(reach.argmax(0))
            score = reach.max(0)
        state, path = leave, []
        for b in reversed(back):
            path.append(state)
            state = int(b[state])
        flat = iter(reversed(path))
        return [[next(flat) for _ in codes] for codes in rows]


def chain(matrices: list[np.ndarray], enter: int = 0, leave: int | None = None) -> list[tuple[int, int]]:
    """(role before, role at the end) of each block on the best path over all, from the
    role ``enter`` (before a conversation: 0 by convention) to the best or given end."""
    score, back = np.where(np.arange(N) == enter, 0.0, -np.inf), []
    for m in matrices:
        reach = score[:, None] + m
        back.append(reach.argmax(0))
        score = reach.max(0)
    state, out = int(score.argmax()) if leave is None else leave, []
    for b in reversed(back):
        before = int(b[state])
        out.append((before, state))
        state = before
    return out[::-1]


def train(rows: DataFrame) -> Model:
    """Counts over all rows with a known speaker (role is its class, NONE or OTHER if
    unknown): first turns, successions of turns and line features, a few numbers
    in all.  Neighbours are found by an equality join of (conversation, turn)
    counts, so no conversation is gathered."""
    known = rows.where(F.col("role") < N)
    at = known.groupBy("conv", "turn", "role").agg(F.count(F.lit(1)).alias("n"))
    nxt = at.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("to"), F.col("n").alias("m"))
    after, first, shown = np.zeros((N, N)), np.zeros(N), np.zeros((N, FEATURES))
    pairs = at.join(nxt, ["conv", "turn"]).groupBy("role", "to").agg(F.sum(F.least("n", "m")).alias("n"))
    for r in pairs.collect():
        after[r.role, r.to] = r.n
    opening = at.groupBy("conv").agg(F.min(F.struct("turn", "role")).alias("f")).groupBy("f.role").count()
    for r in opening.collect():
        first[r.role] = r["count"]
    lines = known.select("role", F.explode("obs").alias("o")).groupBy("role", (F.col("o") % FEATURES).alias("o")).count()
    for r in lines.collect():
        shown[r.role, r.o] = r["count"]
    return Model(first, after, shown)


def _observed(speaker: Column, text: Column) -> Column:
    @F.pandas_udf("role int, obs array<int>")
    def see(labels: pd.Series, texts: pd.Series) -> pd.DataFrame:
        clean = lambda v: v if isinstance(v, str) else None
        return pd.DataFrame({"role": [speaker_class(clean(s)) for s in labels],
                             "obs": [observe(clean(s), clean(t)) for s, t in zip(labels, texts)]})
    return see(speaker, text)


def _blocks(rows: DataFrame, scratch: Scratch, block_rows: int) -> DataFrame:
    """``rows`` with ``place`` and ``block``: no more than ``block_rows`` consecutive rows of
    a conversation, in the order (turn, hash, row), which repeated rows share by row.
    The first place of a conversation comes to its rows by (conversation, stretch of
    places), so no key has many rows."""
    placed = places(rows, ["conv", "turn", "hash", "row"], "place", scratch)
    placed = placed.withColumn("stretch", F.floor(F.col("place") / GROUP_ROWS))
    runs = scratch.write(placed.groupBy("conv", "stretch").agg(F.min("place").alias("start")))
    starts = runs.groupBy("conv").agg(F.min("start").alias("start"))
    starts = scratch.write(runs.select("conv", "stretch").join(starts, "conv"))
    return scratch.write(placed.join(starts, ["conv", "stretch"]).select(
        "row", "conv", "place", "obs", F.floor((F.col("place") - F.col("start")) / block_rows).alias("block")))


def _borders(matrices: DataFrame, scratch: Scratch, dealt, fan: int) -> DataFrame:
    """(conv, block, enter, leave) from (conv, block, m).  Max-plus products of up to
    ``fan`` matrices in a row, level by level until ``fan`` are left of a conversation; then
    down again, the ends of a product giving those of its factors."""
    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, c in pdf.sort_values(["conv", "up", "block"]).groupby(["conv", "up"], sort=False):
            best = None
            for m in c["m"]:
                m = np.array(m).reshape(N, N)
                best = m if best is None else (best[:, :, None] + m[None]).max(1)
            out.append((*k, best.ravel().tolist()))
        return pd.DataFrame(out, columns=["conv", "block", "m"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, ends = pdf.sort_values(["conv", "up", "block"]), []
        for _, c in pdf.groupby(["conv", "up"], sort=False):
            leave = c["leave"].iloc[0]
            ends += chain([np.array(m).reshape(N, N) for m in c["m"]], int(c["enter"].iloc[0]), None if pd.isna(leave) else int(leave))
        return pdf[["conv", "block"]].assign(enter=[a for a, _ in ends], leave=[b for _, b in ends])

    last = matrices.agg(F.max("block")).first()[0] or 0
    levels = [matrices.withColumn("up", F.floor(F.col("block") / fan))]
    while last >= fan:
        last //= fan
        up = scratch.write(dealt(levels[-1], "conv", "up").groupBy("deal").applyInPandas(product, "conv string, block long, m array<double>"))
        levels.append(up.withColumn("up", F.floor(F.col("block") / fan)))
    ends = None
    for level in reversed(levels):
        if ends is None:
            level = level.withColumn("enter", F.lit(0)).withColumn("leave", F.lit(None).cast("int"))
        else:
            level = level.join(ends.withColumnRenamed("block", "up"), ["conv", "up"])
        ends = scratch.write(dealt(level, "conv", "up").groupBy("deal").applyInPandas(walk, "conv string, block long, enter int, leave int"))
    return ends


def _decoded(rows: DataFrame, model: Model, scratch: Scratch, block_rows: int, fan: int = FAN) -> DataFrame:
    """(row, roles, before): the role of every line, and the role before the row (null
    at the start of a conversation)."""
    blocks = _blocks(rows, scratch, block_rows)
    key = ["conv", "block"]

    # Many blocks (or conversations) go to one pandas call, about GROUP_ROWS rows.
    groups = max(1, -(-blocks.count() // GROUP_ROWS))
    dealt = lambda df, *k: df.withColumn("deal", F.pmod(F.xxhash64(*k), F.lit(groups)))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, b in pdf.sort_values([*key, "place"]).groupby(key, sort=False):
            out.append((*k, model.matrix([list(o) for o in b["obs"]], k[1] == 0).ravel().tolist()))
        return pd.DataFrame(out, columns=[*key, "m"])

    matrices = scratch.write(dealt(blocks, *key).groupBy("deal").applyInPandas(summed, "conv string, block long, m array<double>"))
    with_ends = blocks.join(_borders(matrices, scratch, dealt, fan), key)

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, roles, before = [], [], []
        for (_, block), b in pdf.sort_values([*key, "place"]).groupby(key, sort=False):
            opening, enter = block == 0, int(b["enter"].iloc[0])
            found = model.decode([list(o) for o in b["obs"]], opening, enter, int(b["leave"].iloc[0]))
            rows += b["row"].tolist()
            roles += found
            before += [None if opening else enter] + [r[-1] for r in found[:-1]]
        return pd.DataFrame({"row": rows, "roles": roles, "before": pd.array(before, "Int32")})

    return dealt(with_ends, *key).groupBy("deal").applyInPandas(decode, "row long, roles array<int>, before int")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role",
                text: str = "text", block_rows: int = 512, keep: tuple[str, ...] = ()) -> DataFrame:
    """(conv, turn, *keep, part, role, opens, content, rendered): the turns of every
    conversation with recovered roles, a row for each run of lines of one role.

    ``rendered`` is the canonical form: ``<|role|>`` and a line break where a turn opens
    (``opens``: the role differs from that of the lines before), the content, and a
    line break; a conversation's rendered rows in the order (turn, part) are its
    transcript.  Speaker labels may be null, unknown or wrong, and markers in the text
    may start other turns; a marker is cut off only where such a turn opens
    (:func:`turns_of`), all other text stays.  Rows of one conversation are ordered by turn (null first,
    as turn -1), ties by a hash of speaker and text; repeated rows are repeated turns.
    Rows with a null conversation are conversations of their own.  A null or empty
    text is one empty line; a text of any length is read line by line.  Other columns of the input, whatever their
    names, take no part; those named in ``keep`` are passed through (not under a name of the result).  An
    empty table gives no rows.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    seen = _observed(F.col(speaker).cast("string"), F.col(text))
    keep = tuple(c for c in keep if c not in (conv, turn, "part", "role", "opens", "content", "rendered"))
    rows = scratch.write(turns.select(
        F.monotonically_increasing_id().alias("row"), F.col(conv).alias("conv_in"), F.col(turn).alias("turn_in"),
        F.coalesce(F.col(turn).try_cast("long"), F.lit(-1)).alias("turn"), F.shiftrightunsigned(F.xxhash64(speaker, text), 1).alias("hash"),
        F.col(speaker).cast("string").alias("label"), F.col(text).alias("text"), seen.alias("seen"),
        (F.struct(*keep) if keep else F.struct(F.lit(0).alias("_"))).alias("rest")).withColumn(
            "conv", F.coalesce(F.col("conv_in").cast("string"), F.concat(F.lit("row "), "row"))))
    compact = rows.select("row", "conv", "turn", "hash", "seen.role", "seen.obs")
    model = train(compact)
    roles = scratch.write(_decoded(compact, model, scratch, block_rows))

    @F.pandas_udf("array<struct<part:int,role:string,opens:boolean,content:string>>")
    def runs(labels: pd.Series, texts: pd.Series, states: pd.Series, before: pd.Series) -> pd.Series:
        clean = lambda v: v if isinstance(v, str) else None
        return pd.Series([turns_of(clean(a), clean(t), list(s), None if pd.isna(b) else int(b))
                          for a, t, s, b in zip(labels, texts, states, before)])

    done = rows.join(roles, "row").select(F.col("conv_in").alias(conv), F.col("turn_in").alias(turn), *[F.col("rest").getField(c).alias(c) for c in keep],
                                          F.inline(runs("label", "text", "roles", "before")))
    head = F.when(F.col("opens"), F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise("")
    return done.withColumn("rendered", F.concat(head, "content", F.lit("\n")))
