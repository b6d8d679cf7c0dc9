"""Conversations from reply trees, formatted with an escaping template and a loss mask.

A reply tree is a table of nodes (tree, node, parent, role, text, score). Iterative self-joins with doubling jumps give every node its
root, depth and path score in about log2(depth) joins, each of at most one row per node; the leaves of a tree are ranked by the
mean score of their path; the same jumps, from the largest to the smallest, list the nodes of the chosen paths only. Each chosen path
is formatted as one conversation.

Template: each turn is `<|turn|>role<|text|>text<|end|>` and a newline. In roles and texts the escape character and the first character
of every control string are preceded by the escape character, so reading the output back gives the very texts. The loss mask
covers the texts of assistant turns, as spans of code points of the formatted text.

Nulls: a null text or role is empty, a null score 0. A node whose parent is null or absent is a root. Nodes on or below a cycle have no root and
are left out. Ties of score go to the smaller leaf. A repeated node id makes a repeated turn. Empty tables give no conversation. The turns of one
conversation meet in one task, as its formatted text is one value; nothing else is gathered by conversation.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TURN, TEXT, END, ESCAPE = "<|turn|>", "<|text|>", "<|end|>", "\\"
#: Control strings of this template and of common others.
CONTROL = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"]
TO_ESCAPE = re.compile("|".join(map(re.escape, [ESCAPE, *CONTROL])))
ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)
PART = re.compile(f"(?:{re.escape(ESCAPE)}.|(?!{'|'.join(map(re.escape, (TURN, TEXT, END)))}).)*+", re.DOTALL)


def escape(text: str) -> str:
    return TO_ESCAPE.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def formatted(turns: list[tuple[str | None, str | None]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role or "") + TEXT, escape(text or "")
        out += [head, body, END, "\n"]
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def turns_of(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(TURN, at):
            raise ValueError(f"no turn starts at {at}")
        role = PART.match(text, at + len(TURN))
        body = PART.match(text, role.end() + len(TEXT))
        if not (text.startswith(TEXT, role.end()) and text.startswith(END + "\n", body.end())):
            raise ValueError(f"the turn at {at} is broken")
        out.append((unescape(role[0]), unescape(body[0])))
        at = body.end() + len(END) + 1
    return out


def chain(df: DataFrame, tree: str, order: list[str], role: str, text: str, score: str | None = None) -> DataFrame:
    """Rows in an order, per tree, as a reply tree of one path: each row answers the one before it."""
    w = Window.partitionBy(tree).orderBy(*order, F.col(role), F.col(text))
    place = F.row_number().over(w).cast("long")
    return df.select(F.col(tree).alias("tree"), place.alias("node"), (place - 1).alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"), (F.col(score) if score else F.lit(0.0)).cast("double").alias("score")).withColumn("parent", F.when(F.col("parent") > 0, F.col("parent")))


def paths(nodes: DataFrame, best: int = 1, most_joins: int = 40) -> DataFrame:
    """(tree, path, depth, role, text) of the `best` root-to-leaf paths of each tree; path counts from 1, depth from 0."""
    nodes = written(nodes, "nodes")
    links = nodes.groupBy("tree", "node").agg(F.max("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    p = links.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    # a parent that isn't there makes its child a root
    state = written(
        links.join(p, links.tree.eqNullSafe(p.t) & (links.parent == p.n), "left").select("tree", "node", F.col("n").alias("jump"), F.col("score").alias("total"), F.when(F.col("n").isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("depth"), F.col("n").alias("parent")),
        "jumps",
    )
    jumps, done, active = [], state.where("jump is null"), state.where("jump is not null")
    # a path of n nodes is climbed in log2(n) rounds; what is left then lies on a cycle
    for _ in range(min(most_joins, state.count().bit_length() + 1)):  # only nodes that haven't reached their root are joined again
        if active.isEmpty():
            break
        jumps.append(active.select("tree", "node", "jump"))
        up = active.unionByName(done).select(F.col("tree").alias("t"), F.col("node").alias("j"), F.col("jump").alias("further"), F.col("total").alias("above"), F.col("depth").alias("more"))
        state = written(
            active.join(up, active.tree.eqNullSafe(up.t) & (active.jump == up.j)).select("tree", "node", F.col("further").alias("jump"), (F.col("total") + F.col("above")).alias("total"), (F.col("depth") + F.col("more")).alias("depth"), "parent"),
            "jumps",
        )
        done, active = done.unionByName(state.where("jump is null")), state.where("jump is not null")
    state = done  # what is left in active lies on a cycle
    c = state.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("c")).distinct()
    leaves = state.join(c, state.tree.eqNullSafe(c.t) & (state.node == c.c), "left_anti")
    w = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), "node")
    chosen = leaves.withColumn("path", F.row_number().over(w)).where(F.col("path") <= best).select("tree", "path", "node")
    chosen = written(chosen, "paths")
    for step in reversed(jumps):
        j = step.select(F.col("tree").alias("t"), F.col("node").alias("n"), "jump")
        above = chosen.join(j, chosen.tree.eqNullSafe(j.t) & (chosen.node == j.n)).select("tree", "path", F.col("jump").alias("node"))
        chosen = written(chosen.unionByName(above), "paths")
    depth = state.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    placed = chosen.join(depth, chosen.tree.eqNullSafe(depth.t) & (chosen.node == depth.n)).select("tree", "path", "node", "depth")
    full = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    return placed.join(full, placed.tree.eqNullSafe(full.t) & (placed.node == full.n)).select("tree", "path", "depth", "role", "text")


def conversations(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(tree, path, formatted, mask): one row per path; mask is array<struct<start, end>> of code points."""
    one = turns.groupBy("tree", "path").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                made = [formatted([(t["role"], t["text"]) for t in x], learn) for x in part.column(2).to_pylist()]
                mask = pa.array([[{"start": s, "end": e} for s, e in m] for _, m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _ in made], pa.string()), mask], names=["tree", "path", "formatted", "mask"])

    kind = turns.schema["tree"].dataType.simpleString()
    return one.mapInArrow(run, f"tree {kind}, path int, formatted string, mask array<struct<start: bigint, end: bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted conversations and their masks say."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows = []
                for text, mask in zip(part.column("formatted").to_pylist(), part.column("mask").to_pylist()):
                    turns = turns_of(text)
                    loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                    rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column("tree"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
