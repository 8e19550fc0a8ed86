"""Similarity join of texts on the Jaccard similarity of their word n-grams.

Method: token-combination prefixes. A document's tokens (its distinct n-grams) are put in one order
for all documents, rare ones first, the class of a token being the count of its cell in a table of fixed size. With D the largest
possible number of tokens that one of two linked documents of this size has and the other lacks:

* two linked documents share a token within their first n - ceil(J n) + 1 tokens. Rare ones of these are indexed singly;
* if that prefix holds frequent tokens, it is extended to 2 D + 2 tokens, and its frequent tokens are indexed as
  combinations of two that follow each other in the order. Where no rare token is shared, the extended prefixes share more frequent tokens than
  there are tokens of only one document to come between them, so two of the shared ones are neighbours in both.

Equal token sets are one node from the start. Nodes under a rare token, once for each different
group of them, are compared by bit signatures, which bound the overlap from above. Candidates, and the nodes under each combination, are joined into clusters, and the
sets of a cluster are compared exactly, each pair once. Clusters above
`block` nodes, or with more tokens than as many middling texts have, are cut into blocks that meet pairwise, so no task holds more. Only one link for each node leaves a task.

Defined cases: null and empty texts have no tokens, no links and are components of their own; a text shorter than the n-gram is one token;
repeated rows are one node and count as links of each other; rows without doc_id take part, and a component's id is the least id in
it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bunkerline.llm.common import blobs, release, slices, stash
from bunkerline.llm.components import components

#: Cells of the frequency table, and of a piece of it; the table that is broadcast has a bit for each cell.
CELLS, PIECE = 1 << 24, 1 << 16
#: Nodes of a block that a cluster is cut into, and tokens of them, about.
BLOCK, BLOCK_TOKENS = 1024, 1 << 20
REMEMBERED = 250_000
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Tokens:
    """Sorted distinct n-gram hashes of texts; words are lower-cased in A-Z and parted by ASCII white space."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words, known = text.lower().split(), self.known
        hashes = list(map(known.get, words))
        if None in hashes:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = list(map(known.__getitem__, words))
        n = len(hashes)
        h = np.array(hashes, np.uint64)
        w = min(self.width, n)
        if not n:
            return h
        out = np.full(n - w + 1, w, np.uint64)
        for k in range(w):
            out = (out ^ h[k : n - w + 1 + k]) * _MIX[0]
            out ^= out >> np.uint64(29)
        out = (out ^ (out >> np.uint64(32))) * _MIX[2]
        return np.unique(out ^ (out >> np.uint64(29)))


def signature(tokens: np.ndarray) -> bytes:
    """A bit for each residue of the tokens; one bit a token or more, a power of two in all."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    marks = np.zeros(bits, np.uint8)
    marks[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def _most_shared(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """The most tokens two sets (size, signature bytes, signature) can share."""
    if a[1] > b[1]:
        a, b = b, a
    folded = b[2]
    for size in (b[1] >> k for k in range(1, 64)):
        if size < a[1]:
            break
        folded = (folded >> (8 * size)) | (folded & ((1 << (8 * size)) - 1))
    both = (a[2] & folded).bit_count()
    return both + min(a[0] - a[2].bit_count(), b[0] - folded.bit_count())


def _linked(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, at_least: Fraction) -> np.ndarray | bool:
    return at_least.denominator * shared >= at_least.numerator * (a + b - shared)


def short(node: bytes) -> int:
    """The name of a node while candidates are sought, where two nodes of one name would only be compared too often."""
    return int.from_bytes(node[:8], "little", signed=True)


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """A row (doc_id, node, n) for each document, and pieces (piece, counts) of the tasks' frequency tables."""
    kind = docs.schema["doc_id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, seen, id_type = Tokens(width), np.zeros(CELLS, np.uint16), set(), None
        names = ["doc_id", "node", "short", "n", "piece", "counts"]
        for batch in batches:
            id_type = batch.column("doc_id").type
            for part in slices(batch, "text", 4 << 20):
                nodes, sizes = [], []
                for text in blobs(part.column("text")):
                    own = tokens(text)
                    node = xxhash.xxh3_128_digest(own.tobytes())
                    nodes.append(node)
                    sizes.append(len(own))
                    if node not in seen:  # copies are one node
                        seen.add(node)
                        cells = (own & np.uint64(CELLS - 1)).astype(np.int64)
                        counts[cells] = np.minimum(counts[cells], 65534) + 1
                empty = pa.nulls(len(nodes), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes, pa.binary()), pa.array([short(x) for x in nodes], pa.int64()), pa.array(sizes, pa.int64()), empty, pa.nulls(len(nodes), pa.binary())], names)
        if id_type is None:
            return
        used = [k for k in range(CELLS // PIECE) if counts[k * PIECE : (k + 1) * PIECE].any()]
        for at in range(0, len(used), 32):
            own = used[at : at + 32]
            packed = [zlib.compress(counts[k * PIECE : (k + 1) * PIECE].tobytes(), 1) for k in own]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), id_type), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64()), pa.array(own, pa.int32()), pa.array(packed, pa.binary())], names)
        del tokens, seen, counts
        release()

    return docs.mapInArrow(scan, f"doc_id {kind.simpleString()}, node binary, short long, n long, piece int, counts binary")


def _frequent(pieces: DataFrame) -> np.ndarray:
    """A bit for each cell that holds clearly more than the mean."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(PIECE, np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([int(own.sum())]), pa.array([zlib.compress(np.minimum(own, 2**31).astype(np.uint32).tobytes(), 1)])], ["piece", "total", "counts"])

        for batch in batches:
            for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist()):
                if piece != at:
                    if at is not None:
                        yield told()
                    at, own = piece, np.zeros(PIECE, np.int64)
                own += np.frombuffer(zlib.decompress(counts), np.uint16)
        if at is not None:
            yield told()

    summed = stash(pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(add, "piece int, total long, counts binary"))
    mean = (summed.agg(F.sum("total")).first()[0] or 0) / CELLS
    limit = 3 + 2 * mean

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(zlib.decompress(c), np.uint32) > limit, bitorder="little").tobytes() for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(bits, pa.binary())], ["piece", "bits"])

    table = np.zeros(CELLS // 8, np.uint8)
    for r in summed.mapInArrow(mark, "piece int, bits binary").collect():  # CELLS / 8 bytes at most
        table[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = np.frombuffer(r["bits"], np.uint8)
    return table


def keys(tokens: np.ndarray, frequent: np.ndarray, at_least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The rare tokens that are indexed singly, and the combinations of two frequent ones."""
    n = len(tokens)
    cells = (tokens & np.uint64(CELLS - 1)).astype(np.int64)
    often = (frequent[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1
    prefix = n + (-at_least.numerator * n // at_least.denominator) + 1  # n - ceil(J n) + 1
    rare, common = tokens[often == 0], tokens[often == 1]
    if len(rare) >= prefix:
        return rare[:prefix], common[:0]
    spread = (at_least.denominator - at_least.numerator) * n // at_least.numerator
    common = common[: max(0, 2 * spread + 2 - len(rare))]
    pairs = (common[:-1] * _MIX[1]) ^ (common[1:] * _MIX[2])
    return rare, pairs ^ (pairs >> np.uint64(31))


def _index(docs: DataFrame, width: int, at_least: Fraction, frequent: np.ndarray) -> DataFrame:
    """(node, n, bits, singles, pairs) of documents large enough to link to a different set."""
    table = docs.sparkSession.sparkContext.broadcast(frequent)
    smallest = -(-at_least.numerator // (at_least.denominator - at_least.numerator))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = Tokens(width), set()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows = []
                for text in blobs(part.column("text")):
                    own = tokens(text)
                    node = xxhash.xxh3_128_digest(own.tobytes())
                    if len(own) < smallest or node in seen:
                        continue
                    seen.add(node)
                    rows.append((short(node), len(own), signature(own), *(k.view(np.int64) for k in keys(own, table.value, at_least))))
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["node", "n", "bits", "singles", "pairs"])
        del tokens, seen
        release()

    return docs.mapInArrow(scan, "node long, n long, bits binary, singles array<long>, pairs array<long>")


def _compare(postings: DataFrame, at_least: Fraction) -> DataFrame:
    """Edges between nodes under one rare token whose signatures allow a link; a rare token has few nodes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, found, told = None, {}, [], set()

        def settle() -> None:
            own = sorted((n, len(bits), int.from_bytes(bits, "little"), node) for node, (n, bits) in group.items())
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    if b[0] * at_least.numerator > a[0] * at_least.denominator:
                        break
                    edge = (a[3], b[3])
                    if edge not in told and _linked(_most_shared(a, b), a[0], b[0], at_least):
                        told.add(edge)
                        found.append(edge)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])
            found.clear()
            if len(told) > REMEMBERED:
                told.clear()
            return batch

        for batch in batches:
            for key, node, n, bits in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "n", "bits"))):
                if key != at:
                    settle()
                    at, group = key, {}
                group[node] = (n, bits)
            yield flush()
        settle()
        yield flush()

    ordered = postings.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(scan, "u long, v long").distinct()


def _compare_pairs(pairs: DataFrame, at_least: Fraction) -> DataFrame:
    """Those of the pairs whose signatures allow a link."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n_u", "bits_u", "n_v", "bits_v")]
            named = lambda n, bits: (n, len(bits), int.from_bytes(bits, "little"))
            may = [_linked(_most_shared(named(a, x), named(b, y)), a, b, at_least) for a, x, b, y in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(may, pa.bool_())) for c in ("u", "v")], ["u", "v"])

    return pairs.mapInArrow(scan, "u long, v long")


def _candidates(index: DataFrame, at_least: Fraction) -> DataFrame:
    """Edges (u, v) that join all nodes that may be linked."""
    # rare tokens: no key is large; without nulls from the start, so that the join adds no filter and the rows are dealt out once for both uses
    singles = index.where("node is not null").select(F.explode("singles").alias("key"), "node").where("key is not null").repartition("key")
    h = F.xxhash64("node")
    sums = [F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("s1"), F.sum(F.shiftrightunsigned(h, 33)).alias("s2")]
    met = singles.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.count("*").alias("c"), *sums).where("u <> v")
    twos = met.where("c = 2").select("u", "v").distinct()
    chosen = met.where("c > 2").groupBy("u", "v", "c", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    signed = index.select("node", "n", "bits").dropDuplicates(["node"])
    u, v = (signed.select(*(F.col(c).alias(f"{c}_{x}") for c in signed.columns)) for x in "uv")
    twos = _compare_pairs(twos.join(u, twos["u"] == u["node_u"]).join(v, twos["v"] == v["node_v"]).select("u", "v", "n_u", "bits_u", "n_v", "bits_v"), at_least)
    postings = singles.join(chosen, "key").join(signed, "node")
    pairs = index.select(F.explode("pairs").alias("key"), "node")
    hubs = pairs.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("b")).where("v <> b").select("key", "v")
    stars = pairs.join(hubs, "key").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    return twos.unionByName(_compare(postings, at_least)).unionByName(stars)


def _only(rows: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """Rows whose id may be among the wanted ones: the bits of a table of fixed size say so, and what else they let through falls to a join.

    The table is cut into pieces, a row each, and no row moves for it.
    """
    place = lambda column: F.pmod(column, F.lit(CELLS)).cast("long")
    marks = wanted.select(place(F.col(id_col)).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    bit = F.bitmap_bit_position(place(F.col(id_col)))
    octet = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("long")
    told = rows.withColumns({"_bit": bit, "_at": F.bitmap_bucket_number(place(F.col(id_col)))})
    return told.join(F.broadcast(marks), (F.col("_at") == F.col("_piece")) & (octet.bitwiseAND(F.expr("shiftleft(1L, cast(_bit % 8 as int))")) != 0), "left_semi").drop("_bit", "_at")


def verify(nodes: list[bytes], sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, at_least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """For a cluster: each node's place of a root among linked ones, and the copies its links lead to.

    Overlaps are products of the sets' incidence rows, taken a range of tokens at a time. Where two
    sides are given, only pairs of different sides count.
    """
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared_by = np.bincount(column, minlength=len(values))
    rename = np.cumsum(shared_by > 1) - 1
    keep = shared_by[column] > 1
    owner, column, width = owner[keep], rename[column[keep]], int((shared_by > 1).sum())
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(1, (2 << 20) // len(sets))
    for at in range(0, width, step):
        a, b = np.searchsorted(column, [at, at + step])
        rows = np.zeros((len(sets), min(step, width - at)), np.float32)
        rows[owner[a:b], column[a:b] - at] = 1
        overlap += rows @ rows.T
    linked = np.stack([_linked(overlap[i].astype(np.int64), n[i], n, at_least) for i in range(len(n))])
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    root = np.arange(len(sets))
    while True:
        least = np.where(linked, root[None, :], len(sets)).min(axis=1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root, linked @ copies


def _verify_clusters(rows: DataFrame, width: int, at_least: Fraction) -> DataFrame:
    """(node, root, links) of rows (task, side, node, copies, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, tokens = None, {}, Tokens(width)

        def settle() -> pa.RecordBatch:
            nodes = list(group)
            root, links = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(nodes) > 1:
                sets = [group[x][2] for x in nodes]
                root, links = verify(nodes, sets, np.array([group[x][1] for x in nodes]), np.array([group[x][0] for x in nodes]), at_least)
            own = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in own], pa.binary()), pa.array([nodes[root[i]] for i in own], pa.binary()), pa.array(links[own].astype(np.int64))], ["node", "root", "links"])

        for batch in batches:
            for task, side, node, copies, text in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "node", "copies", "text"))):
                if task != at:
                    if group:
                        yield settle()
                    at, group = task, {}
                own = tokens((text or "").encode())
                if xxhash.xxh3_128_digest(own.tobytes()) == node:  # not another text of the same id
                    group[node] = (side, copies, own)
        if group:
            yield settle()
        del group, tokens
        release()

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(scan, "node binary, root binary, links long")


def join_texts(docs: DataFrame, width: int = 3, at_least: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least linked doc_id, over any number of links), links (documents it links to)."""
    if not Fraction(4, 5) <= at_least < 1:
        raise ValueError("the prefixes need a similarity from 0.8 to below 1")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = stash(_scan(plain, width))
    texts = scanned.where("piece is null").select("doc_id", "node", "short", "n")
    carrier = F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("carrier")
    classes = texts.where("n > 0").groupBy("node", "short", "n").agg(F.count("*").alias("copies"), carrier)
    frequent = _frequent(scanned.where("piece is not null").select("piece", "counts"))
    index = stash(_index(plain, width, at_least, frequent))
    clusters = components(_candidates(index, at_least))

    members = clusters.withColumnRenamed("node", "short").join(classes, "short")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("n") / F.lit(BLOCK_TOKENS))).cast("int").alias("blocks"))
    members = members.join(sizes, "root").select(F.xxhash64("carrier").alias("_id"), "root", "blocks", "node", "copies")
    placed = _only(plain.select(F.xxhash64("doc_id").alias("_id"), "text"), "_id", members).join(members, "_id")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2)
    rows = placed.select(F.concat_ws("-", "root", low, high).alias("task"), side.alias("side"), "node", "copies", "text")
    links = stash(_verify_clusters(rows, width, at_least))
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))

    found = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(classes.select("node", "copies"), "node", "left").join(counts, "node", "left")
    least = found.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = found.join(least, "root", "left")
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("links"),
    )
