"""Chat formatting: roles of transcript segments by a hidden Markov model, then canonical turns.

A transcript is rows (conv_id, turn, text); ``segments`` makes them from plain transcripts. The model's states are the roles. What it
sees of a segment is its speaker marker, if the text begins with one, and line features: the length, the number of lines, a question
mark. The features are independent given the role. Start, transition and feature probabilities are counted over all rows
of known role; marker probabilities also have fixed pseudo-counts, as markers say what they mean. Viterbi finds the likeliest
roles of a whole conversation.

A conversation is worked on in blocks, so a very long one is not gathered in one task: each block first gives its best scores from
any role before it to any role at its end, these small tables are chained by conversation, and then each block is decoded between
the roles found at its borders. The result is that of Viterbi over the whole. A block holds ``block_turns`` turn numbers; where
these have over ``block_rows`` rows, it holds a part of one turn's. The tables come from the features alone; texts are
shuffled once, for decoding, and never serve as keys.

Null texts are empty segments; a null turn comes first; segments of equal turn are ordered by a hash of the text. Every row gives a
row, repeated rows too: equal rows stand next to each other and are segments like others. Rows with a null role, or another than the
three, teach nothing. A null conv_id is one conversation. Very long texts are read whole. Columns other than conv_id, turn, role and
text are not looked at. An empty table gives no rows.
"""

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import bounded_batches, fold

ROLES = ("system", "user", "assistant")
# Speaker markers by role.
MARKERS = {"system": "system|instruction|instructions|context", "user": "user|human|question|q|customer|student|prompt", "assistant": "assistant|ai|bot|answer|a|agent|model|teacher"}
_MARKER = re.compile(r"\A\s*(?:[#>*\-]+\s*)?\W?(?:" + "|".join(f"(?P<{r}>{m})" for r, m in MARKERS.items()) + r")\W?\s*[:>]\s*", re.I)
NONE = len(ROLES)
LENGTHS = np.array([20, 40, 80, 120, 180, 260, 400, 600, 900, 1400, 2200, 4000])
SIZES = (NONE + 1, len(LENGTHS) + 1, 8, 2)


@dataclass(frozen=True)
class ChatParams:
    block_turns: int = 512
    block_rows: int = 8_192
    smoothing: float = 1.0
    marker_weight: float = 200.0


def marker(text: str) -> tuple[int, int]:
    """The role that the text's marker names (NONE: no marker) and where the text goes on."""
    m = _MARKER.match(text)
    return (ROLES.index(m.lastgroup), m.end()) if m else (NONE, 0)


def features(text: str | None) -> tuple[int, int, int, int]:
    text = text or ""
    who, at = marker(text)
    return who, int(np.searchsorted(LENGTHS, len(text) - at)), min(7, text.count("\n", at)), int("?" in text[at:])


def segments(transcripts: DataFrame, column: str = "transcript") -> DataFrame:
    """(conv_id, turn, text) of plain transcripts (conv_id, transcript): a segment begins at a marker or after an empty line."""
    cut = r"\n\s*\n|\n(?=(?i:[#>*\- ]*\W?(?:" + "|".join(MARKERS.values()) + r")\W?\s*[:>]))"
    return transcripts.select("conv_id", F.posexplode(F.filter(F.split(F.col(column), cut), lambda s: F.trim(s) != "")).alias("turn", "text"))


@dataclass
class ChatModel:
    """Log probabilities: start by role, step from role to role, and for each feature by role and value."""

    start: np.ndarray
    step: np.ndarray
    seen: list[np.ndarray]

    def emissions(self, seen) -> np.ndarray:
        """seen: features of each segment."""
        x = np.array(list(seen), np.int64).reshape(-1, len(SIZES))
        return sum(table[:, x[:, k]].T for k, table in enumerate(self.seen))

    def viterbi(self, emissions: np.ndarray, before: int | None = None, end: int | None = None) -> list[int]:
        """The best states; before: the state in front of the first; end: the last state, if it is given."""
        best = emissions[0] + (self.start if before is None else self.step[before])
        back = []
        for e in emissions[1:]:
            options = best[:, None] + self.step
            back.append(options.argmax(0))
            best = options.max(0) + e
        state = int(best.argmax()) if end is None else end
        path = [state]
        for b in reversed(back):
            state = int(b[state])
            path.append(state)
        return path[::-1]

    def transfer(self, emissions: np.ndarray, first: bool) -> np.ndarray:
        """Best scores by the state before the block (one row, if it is the first) and its last state."""
        best = self.start[None, :] + emissions[0] if first else self.step + emissions[0]
        for e in emissions[1:]:
            best = (best[:, :, None] + self.step[None, :, :]).max(1) + e
        return best


BLOCK = ["b1", "b2", "b3"]  # a block's place: its turn numbers; the turn and the part of it where there are many rows


def _rows(conversations: DataFrame, p: ChatParams) -> DataFrame:
    """conv_id, turn, role, text, own (a hash of the text, the order within a turn) and the block of each row."""
    role = F.col("role").cast("string") if "role" in conversations.columns else F.lit(None).cast("string")
    rows = conversations.select("conv_id", "turn", role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    rows = rows.withColumns({"own": F.xxhash64("text"), "b1": F.floor(place / p.block_turns).cast("long")})
    many = rows.groupBy("conv_id", "b1").agg(F.ceil(F.count("*") / p.block_rows).alias("parts")).where("parts > 1").withColumnsRenamed({"conv_id": "c", "b1": "b"})
    rows = rows.join(many, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("b1") == F.col("b")), "left")
    part = F.floor((F.shiftright("own", 33) / float(1 << 31) + 1) / 2 * F.col("parts"))  # grows with own
    return rows.withColumns({"b2": F.when(F.col("parts").isNull(), -1).otherwise(place).cast("long"), "b3": F.coalesce(part, F.lit(0)).cast("long")}).drop("c", "b", "parts")


def _seen(rows: DataFrame) -> DataFrame:
    """The rows without their texts, with their features x."""

    @F.pandas_udf("array<int>")
    def seen(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return rows.withColumn("x", seen("text")).select("conv_id", *BLOCK, "turn", "own", "role", "x")


def train(conversations: DataFrame, learn=None, p: ChatParams = ChatParams()) -> ChatModel:
    """From all rows (conv_id, turn, role, text) for which the column learn holds."""
    bounded_batches(conversations.sparkSession)
    rows = _seen(_rows(conversations.where(F.lit(True) if learn is None else learn), p)).where(F.col("role").isin(*ROLES))
    at = Window.partitionBy("conv_id", *BLOCK).orderBy("turn", "own", "role")
    known = rows.withColumn("previous", F.lag("role").over(at)).withColumn("first", F.row_number().over(at) == 1)
    pairs = F.explode(F.array(F.struct(F.lit("step").alias("kind"), F.coalesce("previous", F.when(F.col("first") & (F.col("b1") <= 0), F.lit(""))).alias("a"), F.lit(0).alias("value")), *[F.struct(F.lit(f"{k}").alias("kind"), F.lit("").alias("a"), F.col("x")[k].alias("value")) for k in range(len(SIZES))]))
    counts = known.select("role", pairs.alias("c")).where("c.a is not null").groupBy("role", "c.kind", "c.a", "c.value").count().collect()
    start, step = np.full(3, p.smoothing), np.full((3, 3), p.smoothing)
    tables = [np.full((3, n), p.smoothing) for n in SIZES]
    for r in range(3):
        tables[0][r, r] += p.marker_weight
        tables[0][r, NONE] += p.marker_weight
    for r in counts:
        to = ROLES.index(r["role"])
        if r["kind"] != "step":
            tables[int(r["kind"])][to, r["value"]] += r["count"]
        elif r["a"] == "":
            start[to] += r["count"]
        elif r["a"] in ROLES:
            step[ROLES.index(r["a"]), to] += r["count"]
    markers = tables[0]
    markers[:, :NONE] = np.maximum(markers[:, :NONE], markers[:, NONE:] * 0.02)
    markers[np.arange(3), np.arange(3)] = np.maximum(markers[np.arange(3), np.arange(3)], markers[:, NONE] * 0.9)
    logs = lambda m: np.log(m / m.sum(-1, keepdims=True))
    return ChatModel(logs(start), logs(step), [logs(t) for t in tables])


def _grouped(batches, keys: list[str], f):
    """f of the rows of each run of equal keys; rows come sorted."""
    rest = None
    for b in batches:
        b = b if rest is None or not len(rest) else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        codes = b[keys].astype(object).where(b[keys].notna(), "\x00null")
        cut = np.flatnonzero((codes.iloc[1:].to_numpy() != codes.iloc[:-1].to_numpy()).any(1)) + 1
        ends = [0, *cut.tolist()]
        for i, j in zip(ends, ends[1:]):
            yield f(b.iloc[i:j])
        rest = b.iloc[ends[-1] :]
    if rest is not None and len(rest):
        yield f(rest)


def recover(conversations: DataFrame, model: ChatModel, p: ChatParams = ChatParams()) -> DataFrame:
    """conv_id, turn, role (as given, for comparison), role_pred, rendered for each segment."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = _rows(conversations, p)
    kinds = dict(rows.dtypes)
    # conversations of several blocks, by their features alone
    spans = rows.select("conv_id", *BLOCK).distinct().groupBy("conv_id").agg(F.count("*").alias("blocks"), F.min(F.struct(*BLOCK)).alias("start")).where("blocks > 1").withColumnRenamed("conv_id", "c")
    long = _seen(rows).join(spans, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", *BLOCK, "turn", "own", "x", (F.struct(*BLOCK) == F.col("start")).alias("first"))

    def transfers(batches):
        def one(b):
            t = shared.value.transfer(shared.value.emissions(b["x"]), bool(b["first"].iloc[0]))
            return {"conv_id": b["conv_id"].iloc[0], **{c: b[c].iloc[0] for c in BLOCK}, "t": t.ravel().tolist()}

        out = list(_grouped(batches, ["conv_id", *BLOCK], one))
        yield pd.DataFrame(out, columns=["conv_id", *BLOCK, "t"])

    key = f"conv_id {kinds['conv_id']}, " + ", ".join(f"{c} long" for c in BLOCK)
    tables = long.repartition("conv_id", *BLOCK).sortWithinPartitions("conv_id", *BLOCK, "turn", "own").mapInPandas(transfers, f"{key}, t array<double>")

    def chained(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(BLOCK)
        each = [np.array(t).reshape(-1, 3) for t in b["t"]]
        best, back = each[0][0], []
        for t in each[1:]:
            options = best[:, None] + t
            back.append(options.argmax(0))
            best = options.max(0)
        ends = [int(best.argmax())]
        for x in reversed(back):
            ends.append(int(x[ends[-1]]))
        ends.reverse()
        return pd.DataFrame({"conv_id": b["conv_id"], **{c: b[c] for c in BLOCK}, "before": [-1, *ends[:-1]], "end": ends})

    # a block's border comes as a row in front of its segments, so that texts are shuffled once and not joined
    borders = tables.groupBy("conv_id").applyInPandas(chained, f"{key}, before int, end int")
    columns = {"turn": kinds["turn"], "own": "long", "role": "string", "text": "string"}
    heads = borders.select("conv_id", *BLOCK, F.lit(0).alias("kind"), "before", "end", *[F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    placed = rows.select("conv_id", *BLOCK, F.lit(1).alias("kind"), F.lit(-1).alias("before"), F.lit(-1).alias("end"), *columns).unionByName(heads)

    def decoded(batches):
        def one(b):
            head, own = b[b["kind"] == 0], b[b["kind"] == 1]
            before, end = (int(head["before"].iloc[0]), int(head["end"].iloc[0])) if len(head) else (-1, -1)
            path = shared.value.viterbi(shared.value.emissions(features(t) for t in own["text"]), None if before < 0 else before, None if end < 0 else end)
            out = own[["conv_id", "turn", "role", "text"]].copy()
            out["role_pred"] = [ROLES[s] for s in path]
            out["rendered"] = [render(r, t) for r, t in zip(out["role_pred"], out["text"])]
            return out.drop(columns="text")

        some, n = [], 0
        for x in _grouped(batches, ["conv_id", *BLOCK], one):
            some.append(x)
            n += len(x)
            if n >= 2_000:
                yield pd.concat(some)
                some, n = [], 0
        if some:
            yield pd.concat(some)

    out = placed.repartition("conv_id", *BLOCK).sortWithinPartitions("conv_id", *BLOCK, "kind", "turn", "own")
    return out.mapInPandas(decoded, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, role_pred string, rendered string")


def render(role: str, text: str) -> str:
    """A turn in canonical form: the role's tag, the text without its marker and outer blanks, the end tag."""
    return f"<|{role}|>\n{text[marker(text)[1] :].strip()}\n<|end|>\n"


def chat_turns(conversations: DataFrame, p: ChatParams = ChatParams()) -> DataFrame:
    """conv_id, turn, held_out, role, role_pred, rendered; learns from conversations whose crc32(conv_id) mod 5 is not 0."""
    model = train(conversations, fold("conv_id", 5) != 0, p)
    return recover(conversations, model, p).select("conv_id", "turn", (fold("conv_id", 5) == 0).alias("held_out"), "role", "role_pred", "rendered")
