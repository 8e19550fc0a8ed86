"""Chat formatting of reply trees.

Method: messages name the message they reply to. Self-joins that double their reach give every message
its ancestors 1, 2, 4, ... steps up, and from these its depth and its branch's score; leaves are ranked by score within their conversation,
and the chosen leaves' paths are listed by the same tables, again doubling with every join. Each path becomes one text of
turns, with the spans of assistant texts as a loss mask.

A turn is `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end. In roles and texts a backslash is doubled and
`<|` becomes `<\\|`, so that no control string is left in them; in roles a line end becomes `\\n`. `read_back` undoes this.

Defined cases: null roles and texts are empty; rows without conversation form one, whose id is null; turns in a table of rows are ordered by
turn, null first, then role and text, so repeated rows are turns of their own; a parent that does not exist makes a root; a null score counts 0; messages on a cycle
are in no path; an empty table gives an empty result. A path is one row, as its text is one string; nothing else is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bunkerline.llm.common import store

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the learned role's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("a turn was expected")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        turns.append((_unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def chains(rows: DataFrame) -> DataFrame:
    """Messages of rows (conv_id, turn, role, text) of which each replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("id"))
    return numbered.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))


def _climb(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jumps (conv_id, id, up, sum) of 1, 2, 4, ... steps, of the messages that have such an ancestor, and (conv_id, id, root, steps, sum).

    `sum` is the score of the messages from `id` up to below `up` or `root`. A message takes part in as many rounds as its depth has
    bits; the longest jump it has ends at a message whose root an earlier round has found. Messages on a cycle find none.
    """
    ids = messages.select(F.col("conv_id").alias("c"), F.col("id").alias("p"))
    joined = store(messages.join(ids, messages["conv_id"].eqNullSafe(ids["c"]) & (messages["parent"] == ids["p"]), "left").select("conv_id", "id", F.col("p").alias("up"), F.coalesce("score", F.lit(0.0)).alias("sum")))
    roots = joined.where("up is null").select("conv_id", "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("steps"), F.lit(0.0).alias("sum"))
    jumps, longest = [joined.where("up is not null")], messages.count()
    while 1 << len(jumps) <= 2 * longest:
        low = jumps[-1]
        high = low.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), F.col("up").alias("further"), F.col("sum").alias("more"))
        both = store(low.join(high, low["conv_id"].eqNullSafe(high["c"]) & (low["up"] == high["i"]), "left").select("conv_id", "id", "up", "sum", "further", "more"))
        ending = both.where("further is null").select("conv_id", "id", "up", "sum")
        known = roots.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "root", "steps", F.col("sum").alias("above"))
        met = ending.join(known, ending["conv_id"].eqNullSafe(known["c"]) & (ending["up"] == known["i"]))
        steps = F.col("steps") + F.lit(1 << len(jumps) - 1)
        roots = store(roots.unionByName(met.select("conv_id", "id", "root", steps.alias("steps"), (F.col("sum") + F.col("above")).alias("sum"))))
        following = both.where("further is not null").select("conv_id", "id", F.col("further").alias("up"), (F.col("sum") + F.col("more")).alias("sum"))
        if not following.limit(1).count():
            break
        jumps.append(following)
    return jumps, roots


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, path, rank, position, role, text): the messages from root to leaf of each conversation's best branches.

    `messages` has (conv_id, id, parent, role, text, score); ids are unique within a conversation. Branches rank by summed score, then length, then leaf.
    """
    messages = store(messages)
    jumps, roots = _climb(messages)
    parents = messages.select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).where("p is not null").distinct()
    leaves = roots.join(parents, roots["conv_id"].eqNullSafe(parents["c"]) & (roots["id"] == parents["p"]), "left_anti")
    tops = messages.where("score is not null").select(F.col("conv_id").alias("c"), F.col("id").alias("r"), F.col("score").alias("first"))
    ranked = leaves.join(tops, leaves["conv_id"].eqNullSafe(tops["c"]) & (leaves["root"] == tops["r"]), "left")
    order = Window.partitionBy("conv_id").orderBy((F.col("sum") + F.coalesce("first", F.lit(0.0))).desc(), F.desc("steps"), "id")
    chosen = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    found = store(chosen.select("conv_id", F.col("id").alias("path"), "rank", "id", F.col("steps").alias("position")))
    for k in range(len(jumps) - 1, -1, -1):
        step = jumps[k].select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "up")
        above = found.join(step, found["conv_id"].eqNullSafe(step["c"]) & (found["id"] == step["i"]))
        found = store(found.unionByName(above.select("conv_id", "path", "rank", F.col("up").alias("id"), (F.col("position") - (1 << k)).alias("position"))))
    texts = messages.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "role", "text")
    return found.join(texts, found["conv_id"].eqNullSafe(texts["c"]) & (found["id"] == texts["i"])).select("conv_id", "path", "rank", "position", "role", "text")


def format_paths(found: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, path, rank, formatted, loss_spans): one text a path; spans are in code points."""
    kind = found.schema["conv_id"].dataType.simpleString()
    turns = F.sort_array(F.collect_list(F.struct("position", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    rows = found.groupBy("conv_id", "path", "rank").agg(turns.alias("turns"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in own], learned) for own in batch.column("turns").to_pylist()]
            marks = pa.array([[{"start": a, "end": b} for a, b in m] for _, m in done], spans)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "path", "rank")), pa.array([t for t, _ in done], pa.string()), marks], ["conv_id", "path", "rank", "formatted", "loss_spans"])

    return rows.mapInArrow(scan, f"conv_id {kind}, path long, rank int, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, path, turns, loss_text): the turns of formatted texts, and all text under their loss masks, unescaped."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks = batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()
            turns = pa.array([[{"role": r, "text": t} for r, t in parse(x)] for x in texts], turn)
            loss = pa.array(["".join(unescape(x[s["start"] : s["end"]]) for s in m) for x, m in zip(texts, masks)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("path"), turns, loss, batch.column("formatted")], ["conv_id", "path", "turns", "loss_text", "formatted"])

    return formatted.mapInArrow(scan, f"conv_id {kind}, path long, turns array<struct<role:string,text:string>>, loss_text string, formatted string")
