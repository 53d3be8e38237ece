"""Chat formatting: conversations merged into prefix trees, laid out depth-first with positions and attention intervals."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelab.llm.common import batch, keep, map_batches

#: Control strings of the template; each is one token, after the 256 bytes.
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
CONTROLS = {ROLE: 256, TEXT: 257, END: 258}
NAMES = {i: name for name, i in CONTROLS.items()}
#: The role whose texts are learned.
LEARNED = "assistant"
#: Siblings are summed in so many parts, by the first bits of their keys.
PARTS_BITS = 12
_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_CONTROL = re.compile(r"(<\|(?:role|text|end)\|>)")
_TURN = re.compile(r"<\|role\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    """No ``<|`` remains: a backslash goes between, one more where some are."""
    return _OPENING.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def format_turn(role: str, text: str) -> str:
    return f"{ROLE}{escape(role)}{TEXT}{escape(text)}{END}"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def token_ids(formatted: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes, each control string as one id; and which tokens are learned: the learned role's text and its end."""
    ids: list[np.ndarray] = []
    mask: list[np.ndarray] = []
    role, inside = "", None
    for part in _CONTROL.split(formatted):
        learned = inside == TEXT and unescape(role) == LEARNED
        if part in CONTROLS:
            ids.append(np.array([CONTROLS[part]], np.int32))
            mask.append(np.array([learned and part == END]))
            if part == ROLE:
                role = ""
            inside = part
        else:
            role = part if inside == ROLE else role
            raw = np.frombuffer(part.encode("utf-8", "surrogatepass"), np.uint8)
            ids.append(raw.astype(np.int32))
            mask.append(np.full(len(raw), learned))
    return np.concatenate(ids), np.concatenate(mask)


def read_tokens(ids: np.ndarray) -> str:
    """The formatted text of token ids."""
    out, at = [], 0
    for place in np.flatnonzero(ids > 255).tolist():
        out += [ids[at:place].astype(np.uint8).tobytes().decode("utf-8", "surrogatepass"), NAMES[int(ids[place])]]
        at = place + 1
    return "".join(out) + ids[at:].astype(np.uint8).tobytes().decode("utf-8", "surrogatepass")


def learned_texts(ids: np.ndarray, mask: np.ndarray) -> str:
    """The texts under the mask, end to end and unescaped; in a mask each text closes with its end token."""
    return "".join(unescape(t) for t in read_tokens(ids[mask]).split(END))


def key_of(before: int, formatted: str) -> int:
    raw = before.to_bytes(8, "little", signed=True) + formatted.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


PATHS = "conv_id long, leaf long, keys array<long>, turns array<string>, sizes array<long>"


def paths(turns: DataFrame) -> DataFrame:
    """Per conversation its formatted turns, the key of each prefix, and the key of the whole (0 without turns)."""
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys, shown, sizes = [], [], []
            for conversation in part.column("turns").to_pylist():
                made = [format_turn(t["role"], t["text"]) for t in conversation]
                own, key = [], 0
                for x in made:
                    key = key_of(key, x)
                    own.append(key)
                keys.append(own)
                shown.append(made)
                sizes.append([len(x.encode("utf-8", "surrogatepass")) - sum(map(len, CONTROLS)) + len(CONTROLS) for x in made])
            yield batch(
                conv_id=part.column("conv_id"), leaf=pa.array([k[-1] if k else 0 for k in keys], pa.int64()), keys=pa.array(keys, pa.list_(pa.int64())),
                turns=pa.array(shown, pa.list_(pa.string())), sizes=pa.array(sizes, pa.list_(pa.int64())),
            )

    return ordered.mapInArrow(run, PATHS)


def prefix_trees(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trees, and each conversation's way through them; ``turns`` has (conv_id, turn, role, text).

    A turn that several different conversations share with all turns before it is one node; what only one has is one node
    to its end. Nodes have: tree (key of the first turn), node, parent, depth (nodes above), position (of its first token,
    along its conversation), start and n_tokens (its place in the tree's depth-first order, where siblings follow their
    keys), attend (the intervals of its ancestors in that order, by depth) and text (formatted). So shared tokens are stored once, and a
    token attends to its ancestors' intervals and to the tokens before it in its node. Ways have: conv_id, nodes.

    A conversation's rows are ordered by turn (nulls first, ties by role and text); null roles and texts count as empty; rows
    without a conv_id are one conversation; copies of a conversation share all nodes; an empty table gives two
    empty tables. One task holds one conversation. The children of one turn, however many, are summed by parts of their keys.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    whole = keep(paths(rows), "chat-paths")
    leaves = whole.groupBy("leaf").agg(F.first("keys").alias("keys"))
    steps = leaves.select("leaf", F.posexplode("keys").alias("depth", "key"))
    shared = keep(steps.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "chat-shared")
    depth = steps.join(shared, "key").groupBy("leaf").agg(F.count("*").alias("shared"))
    ways = keep(
        whole.join(keep(depth, "chat-depth"), "leaf", "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("int"))
        .withColumn("nodes", F.slice("keys", F.lit(1), F.least(F.col("shared") + 1, F.size("keys")))), "chat-ways",
    )
    at = F.posexplode("nodes").alias("depth", "node")
    pieces = ways.select("nodes", "shared", "turns", "sizes", at).select(
        "node", "depth", F.col("nodes")[0].alias("tree"), F.when(F.col("depth") > 0, F.get("nodes", F.col("depth") - 1)).alias("parent"),
        F.slice("nodes", F.lit(1), F.col("depth")).alias("above"),
        F.when(F.col("depth") < F.col("shared"), F.get("turns", "depth")).otherwise(F.array_join(F.slice("turns", F.col("depth") + 1, F.size("turns")), "")).alias("text"),
        F.when(F.col("depth") < F.col("shared"), F.get("sizes", "depth"))
        .otherwise(F.aggregate(F.slice("sizes", F.col("depth") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda a, b: a + b)).alias("n_tokens"),
    )
    nodes = keep(pieces.groupBy("node").agg(*(F.first(c).alias(c) for c in ("tree", "parent", "depth", "above", "text", "n_tokens"))), "chat-nodes")
    chain = nodes.select("node", "n_tokens", F.explode(F.concat("above", F.array("node"))).alias("up"))
    subtree = chain.groupBy("up").agg(F.sum("n_tokens").alias("subtree")).withColumnRenamed("up", "node")
    sized = keep(nodes.select("node", "parent", "n_tokens").join(subtree, "node").withColumn("part", F.shiftrightunsigned("node", 64 - PARTS_BITS)), "chat-sized")
    # siblings in the order of part and key; the sum of the parts before, then of the siblings before in the part
    parts = sized.where("parent IS NOT NULL").groupBy("parent", "part").agg(F.sum("subtree").alias("all"))
    earlier = Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before_part", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
    inside = Window.partitionBy("parent", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.join(parts, ["parent", "part"], "left").withColumn("inside", F.coalesce(F.sum("subtree").over(inside), F.lit(0)))
    offsets = keep(
        offsets.select(F.col("node").alias("up"), F.col("n_tokens").alias("up_tokens"), F.when(F.col("parent").isNull(), 0).otherwise(F.col("before_part") + F.col("inside")).alias("offset")),
        "chat-offsets",
    )
    own = F.col("node") == F.col("up")
    placed = chain.join(offsets, "up").groupBy("node").agg(
        F.sum(F.col("offset") + F.when(own, 0).otherwise(F.col("up_tokens"))).alias("start"), F.sum(F.when(own, 0).otherwise(F.col("up_tokens"))).alias("position")
    )
    placed = keep(placed, "chat-placed")
    above = nodes.select("node", F.posexplode("above").alias("level", "up")).join(
        placed.select(F.col("node").alias("up"), "start").join(nodes.select(F.col("node").alias("up"), "n_tokens"), "up"), "up"
    )
    spans = above.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("level", "start", (F.col("start") + F.col("n_tokens")).alias("end")))).alias("spans"))
    attend = F.transform(F.coalesce("spans", F.array()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    laid = nodes.join(placed, "node").join(spans, "node", "left").select(
        "tree", "node", "parent", "depth", "position", "start", "n_tokens", attend.alias("attend"), "text"
    )
    return keep(laid, "chat-laid"), ways.select("conv_id", "nodes")


TRAINING = "node long, tree long, start long, tokens array<int>, positions array<long>, learned array<boolean>, attend array<struct<start: bigint, end: bigint>>"


def tokenised(part: pa.RecordBatch) -> pa.RecordBatch:
    """The training columns of a slice of nodes."""
    made = [token_ids(t) for t in part.column("text").to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in made], dtype=np.int64)])
    position = part.column("position").to_numpy()
    lists = lambda flat: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat))
    ids, mask = (np.concatenate(x) for x in zip(*made, strict=True))
    return batch(
        **{c: part.column(c) for c in ("node", "tree", "start")}, tokens=lists(ids),
        positions=lists(np.arange(len(ids)) + np.repeat(position - first[:-1], np.diff(first))), learned=lists(mask), attend=part.column("attend"),
    )


def training_rows(nodes: DataFrame) -> DataFrame:
    """node, tree, start, tokens, positions, learned (mask), attend of each node; ordered by start they are the tree's sequence.

    A slice of at most 1 MB of text (one node at least) is worked on at once. Nodes hold no nulls; a repeated node is
    repeated; no nodes give no rows.
    """
    return map_batches(nodes.select("node", "tree", "start", "position", "text", "attend"), lambda part: [tokenised(part)], TRAINING)


def read_back(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """conv_id, formatted, turns, learned: every conversation as read from the training rows of the nodes on its way.

    ``formatted`` and ``turns`` are decoded from the token ids, ``learned`` from those under the mask: a node is whole turns,
    so no text lies in two of them. A conversation without turns reads as empty; empty tables give none.
    """

    def decoded(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = tokenised(part)
        ids, mask, at = (rows.column("tokens").flatten().to_numpy(), rows.column("learned").flatten().to_numpy(zero_copy_only=False), rows.column("tokens").offsets.to_pylist())
        spans = list(zip(at[:-1], at[1:], strict=True))
        yield batch(
            node=rows.column("node"), text=pa.array([read_tokens(ids[a:b]) for a, b in spans], pa.string()),
            learned=pa.array([learned_texts(ids[a:b], mask[a:b]) for a, b in spans], pa.string()),
        )

    made = map_batches(nodes.select("node", "tree", "start", "position", "text", "attend"), decoded, "node long, text string, learned string")
    steps = ways.select("conv_id", F.posexplode_outer("nodes").alias("depth", "node"))
    found = steps.join(made, "node", "left")
    whole = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "text", "learned"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            held = part.column("parts").to_pylist()
            texts = ["".join(p["text"] or "" for p in parts) for parts in held]
            turns = [read_turns(t) for t in texts]
            yield batch(
                conv_id=part.column("conv_id"), formatted=pa.array(texts, pa.string()),
                turns=pa.array([[{"role": r, "text": t} for r, t in own] for own in turns], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                learned=pa.array(["".join(p["learned"] or "" for p in parts) for parts in held], pa.string()),
            )

    return whole.mapInArrow(run, "conv_id long, formatted string, turns array<struct<role: string, text: string>>, learned string")
