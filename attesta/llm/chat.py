"""Chat formatting over a prefix tree of conversations.

A turn is written `<turn>role`, a line feed, the text, `</turn>` and a line feed. Inside roles and texts a backslash is
doubled, and one is put behind the `<` of `<turn>`, `</turn>` and `<|` (which begins the tokenizer's own control
strings), so no text can close its turn or speak as another role; a line feed in a role is a backslash and `n`.

Turns with the same turns before them are one node of a tree, named by a chain of digests. Conversations, one of each
kind, are sorted by their paths and dealt by ranges of paths, so that no task depends on how many share a first turn; a
stack of the open path emits each node once, depth-first. A tree that lies across a border of ranges goes on in another
sequence (`pack`, named by its first conversation), which begins with the path to that place. A node has its tokens, the place of the first in the
pack, its position id (its distance from the root along its own path), the range of its tokens that count for the
loss, and the ranges of the pack that it may attend to, which hold its ancestors and nothing else; inside a node
attention is causal.

Null texts and roles are empty; rows without a conv_id are one conversation; rows of one turn number follow each other
by role, then text; a repeated row is a further turn; no rows give no packs. Turns are streamed in their order, so a
conversation of any length needs the memory of one batch and its path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import small_batches, text_or_empty, written

OPEN, CLOSE, LEARNED = "<turn>", "</turn>\n", "assistant"
#: One text with the template's own control strings, appended as a conversation by the query.
PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"
SINGLE = re.compile(r"\\(.)", re.DOTALL)


def escaped(c: Column) -> Column:
    """Text that holds no control string, reversibly."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), r"<(?=/?turn>|\|)", r"<\\")


def unescaped(text: str) -> str:
    return SINGLE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def steps(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent, node, last, role, text): turns in their order, each named by a digest of itself and all before it."""
    slim = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_or_empty("text").alias("text"))

    columns = ["conv_id", "depth", "parent", "node", "last", "role", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, depth, node, held = None, 0, b"", None
        for batch in batches:
            out = []
            for key, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                fresh = held is None or key != now
                if held is not None:
                    out.append((*held[:4], fresh, *held[4:]))
                if fresh:
                    now, depth, node = key, 0, b""
                r, t = role.encode(), text.encode()
                parent, node = node, sha256(b"%b%d:%b%b" % (node, len(r), r, t)).digest()[:16]
                held = (key, depth, parent, node, role, text)
                depth += 1
            yield pd.DataFrame(out, columns=columns)
        if held is not None:
            yield pd.DataFrame([(*held[:4], True, *held[4:])], columns=columns)

    order = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = order.mapInPandas(run, "conv_id string, depth int, parent binary, node binary, last boolean, role string, text string")
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def nodes(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(node, head, body, tail, loss): token ids of each node's opening, text and closing, once."""
    each = turns.groupBy("node").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    marked = each.select("node", F.concat(F.lit(OPEN), F.regexp_replace(escaped(F.col("role")), "\n", r"\\n"), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"), F.lit(CLOSE).alias("tail"), (F.col("role") == LEARNED).alias("loss"))
    for part in ("head", "body", "tail"):
        marked = bpe.encoded(marked, tokenizer, part, part)
    return marked


def paths(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(leaf, path): for each different conversation its nodes and their numbers of tokens, in order. One conversation of each kind is taken."""
    ends = turns.where("last").groupBy(F.col("node").alias("leaf")).agg(F.min(F.struct(F.col("conv_id").isNull(), F.col("conv_id"))).alias("first"))
    ends = ends.select("leaf", F.col("first.conv_id").alias("conv_id"))
    slim = turns.select("conv_id", "depth", "node").join(ends, F.equal_null(turns["conv_id"], ends["conv_id"])).select("leaf", "depth", "node").join(sizes, "node")
    return slim.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node", "n"))), lambda x: F.struct(x["node"].alias("node"), x["n"].alias("n"))).alias("path"))


PLACED = "pack binary, start bigint, depth int, node binary, position bigint, leaf boolean, attends array<struct<begin: bigint, end: bigint>>"


def placed(kinds: DataFrame) -> DataFrame:
    """Nodes in depth-first order by packs: start, depth, position, whether a conversation ends there, and what it attends to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[bytes, int, int, tuple]] = []  # node, end, position behind it, merged ranges up to its end
        pack, at = None, 0
        for batch in batches:
            out = []
            for leaf, path in zip(batch["leaf"], batch["path"], strict=True):
                names = [bytes(x["node"]) for x in path]
                common = 0
                while common < min(len(stack), len(names)) and stack[common][0] == names[common]:
                    common += 1
                del stack[common:]
                if not stack:
                    pack, at = bytes(leaf), 0
                for depth in range(common, len(path)):
                    n, ranges = int(path[depth]["n"]), stack[-1][3] if stack else ()
                    position = stack[-1][2] if stack else 0
                    out.append((pack, at, depth, names[depth], position, False, [{"begin": a, "end": b} for a, b in ranges]))
                    ranges = (*ranges[:-1], (ranges[-1][0], at + n)) if ranges and ranges[-1][1] == at else (*ranges, (at, at + n))
                    stack.append((names[depth], at + n, position + n, ranges))
                    at += n
                # Paths are sorted, so a path that ends inside another comes before it: its last node is fresh.
                out[-1] = (*out[-1][:5], True, out[-1][6])
            yield pd.DataFrame(out, columns=["pack", "start", "depth", "node", "position", "leaf", "attends"])

    sort = F.transform("path", lambda x: x["node"])
    dealt = kinds.withColumn("_by", sort).repartitionByRange("_by").sortWithinPartitions("_by").select("leaf", "path")
    return dealt.mapInPandas(run, PLACED)


def formatted(rows: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The packs and the members. Packs: pack, start, depth, position, leaf, attends, token_ids, loss_begin and loss_end (places in the pack), node. Members: conv_id and the node it ends with."""
    turns = written(steps(rows), "turns")
    known = written(nodes(turns, tokenizer), "nodes")
    sizes = known.select("node", (F.size("head") + F.size("body") + F.size("tail")).alias("n"))
    order = written(placed(paths(turns, sizes)), "order")
    packs = order.join(known, "node").withColumns({"token_ids": F.concat("head", "body", "tail"), "loss_begin": F.when(F.col("loss"), F.col("start") + F.size("head"))})
    packs = packs.withColumn("loss_end", F.col("loss_begin") + F.size("body")).drop("head", "body", "tail", "loss")
    return written(packs, "packs"), turns.where("last").select("conv_id", "node")


def read_back(packs: DataFrame, tokenizer: str) -> DataFrame:
    """(node, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each node that ends a conversation, from the packs' tokens alone.

    One pass over each pack in its order. A node's text is decoded once, and digests go on from where its ancestors'
    stand: those are found by the ranges that the node attends to, and must fill them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = bpe.Vocabulary(tokenizer)
        text = lambda ids: bpe.Decoder(vocabulary).feed(map(int, ids), True)
        stack: list[tuple[int, int, tuple]] = []  # begin and end in the pack, state
        pack = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.pack != pack:
                    pack, stack = row.pack, []
                seen = [(x["begin"], x["end"]) for x in row.attends]
                while stack and not any(a <= stack[-1][0] and stack[-1][1] <= b for a, b in seen):
                    stack.pop()
                if sum(b - a for a, b in seen) != sum(b - a for a, b, _ in stack) or sum(b - a for a, b in seen) != row.position:
                    raise ValueError(f"pack {pack.hex()}: the ranges at {row.start} are not those of the nodes before it")
                n, whole, learned, loss, size = stack[-1][2] if stack else (0, sha256(), 0, sha256(), 0)
                whole, loss, ids = whole.copy(), loss.copy(), row.token_ids
                said = text(ids)
                if not said.startswith(OPEN) or not said.endswith(CLOSE) or said.count(CLOSE[:-1]) != 1:
                    raise ValueError(f"pack {pack.hex()}: no turn at {row.start}")
                role, _, body = said[len(OPEN) : -len(CLOSE)].partition("\n")
                whole.update(f"{unescaped(role)}\n{unescaped(body)}\n".encode())
                if not pd.isna(row.loss_begin):
                    part = unescaped(text(ids[int(row.loss_begin) - row.start : int(row.loss_end) - row.start]))
                    learned += len(part)
                    loss.update(part.encode())
                state = (n + 1, whole, learned, loss, size + len(said))
                stack.append((row.start, row.start + len(ids), state))
                if row.leaf:
                    out.append((row.node, state[0], whole.hexdigest(), learned, loss.hexdigest(), state[4]))
            yield pd.DataFrame(out, columns=["node", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    order = packs.repartition("pack").sortWithinPartitions("pack", "start")
    return order.mapInPandas(run, "node binary, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def report(rows: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation and of the probe, read back from the packs."""
    small_batches(rows.sparkSession)
    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, LEARNED, PROBE)], "conv_id long, turn long, role string, text string")
    both = rows.select("conv_id", "turn", "role", "text").unionByName(probe.select(F.col("conv_id").cast(kind).alias("conv_id"), F.col("turn").cast(rows.schema["turn"].dataType).alias("turn"), "role", "text"))
    packs, members = formatted(both, tokenizer)
    return members.join(read_back(packs, tokenizer), "node").drop("node")
