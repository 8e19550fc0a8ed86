"""Alignment of two tokenizers over a corpus, with corpus-wide pair counts by external spill counting.

A text stands behind one space. Tokenizer A (byte-level BPE, a `tokenizers` file) encodes space and text, tokenizer B
(sentencepiece, which adds the space itself) the text. Both give byte ranges; offsets where tokens of both end cut the
tokens into groups, and an A and a B token whose ranges overlap are linked.

**Chunks.** Neither tokenizer joins bytes across a place where a space or a line feed follows a character that is no white
space: A's pre-tokenizer starts a token there, and B has no piece with its space mark, or a line feed, behind another character
(looked up when the file is read; a file that has one makes every text a single chunk). A text is the concatenation of its
chunks, and so are tokens, groups and links. Each worker remembers chunks: new ones are encoded many at a time, and their ranges
compared as arrays (the ends of both sides, sorted together, cut out exactly one link each).

**Counting.** How many documents hold an (A id, B id) pair linked:

1. Every task buffers (pair, document, links) records. A full buffer is a *spill*: it is radix-partitioned by A id, each part
   sorted side-major (A id, then B id) and written as a zstd run: pairs and their numbers of documents beside the members.
   A frequent pair is one entry of a run whatever its documents are, so the counting moves entries, not occurrences.
2. Runs of one part meet. A heap merges them k-way while they are decompressed in steps; the order is side-major, so once an
   A id is over its pairs' counts and their maximum are known. A part has at most (A ids / parts) x (B ids) counts.
3. Runs meet the counts of their part in an equi-join, which may split a part, and every run streams what it contributes
   back: for each of its documents the sum of counts over links, and the links with the highest count of their A id. What
   one spill gets back is added up in arrays as long as the spill has documents.

A document never straddles spills, so its records are distinct. Memory holds one spill (`SPILL` records), one step of each
run of a part, one part's counts, or one spill's sums. What is written once in the shared folder is read by steps 2 and 3.

Null and empty texts have no tokens: zeros and an empty digest; so do texts that either tokenizer does not give back byte for
byte (B drops or changes characters such as its own space mark). Rows are told apart by where they were read, so null ids and
repeated rows stay separate rows; ids may have any type. Very long texts are worked on in windows that end between
chunks; a chunk is encoded whole. An empty table gives an empty one. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bunkerline.llm.common import slices, stash

#: Records of a spill, at least; a slice of documents is never cut.
SPILL = 1 << 21
#: Documents of a spill at most, and the bits of a document's place in it.
DOC_BITS = 24
#: Parts that runs are dealt to by A id.
PARTS = 256
#: Chunks a worker remembers before it starts anew, and characters of new chunks that are encoded at a time.
REMEMBERED, BLOCK = 1 << 19, 1 << 17
#: Characters of a window of a long text.
WINDOW = 1 << 20
#: Entries that a merge takes from a run at a time.
STEP = 1 << 12

COUNTED = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in map(self.a.id_to_token, range(self.n_a))]
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.whole = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([[f"{i}{mark}".encode() for i in range(n)] for mark in marks] for n, marks in ((self.n_a, ",|"), (self.n_b, ",;")))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides of a text that begins with white space; None if bytes differ. A first line feed gets a space before it, which goes again."""
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:] if text[0] == " " else text)
        b = b if text[0] == " " else b[1:]
        data = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """For chunks: numbers of A tokens, B tokens, groups and links, all links' A ids and B ids, and groups as text, each with a mark behind.

        A chunk that does not come back byte for byte has zeros.
        """
        ids = self.encode("".join(chunks))
        if ids is None:
            if len(chunks) == 1:
                return np.zeros((1, 4), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), [b""]
            half = len(chunks) // 2
            left, right = self.align(chunks[:half]), self.align(chunks[half:])
            return np.vstack((left[0], right[0])), np.concatenate((left[1], right[1])), np.concatenate((left[2], right[2])), left[3] + right[3]
        a, b = ids
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        chunk_end = np.cumsum([len(c.encode()) for c in chunks])
        ends = np.union1d(a_end, b_end)
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        numbers = np.stack([np.diff(np.searchsorted(e, chunk_end, "right"), prepend=0) for e in (a_end, b_end, shared, ends)], axis=1)
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        tokens = [self.a_text[last][i] for last, i in zip(np.isin(a_end, shared).tolist(), a.tolist())] + [self.b_text[last][i] for last, i in zip(np.isin(b_end, shared).tolist(), b.tolist())]
        order = np.argsort(np.concatenate((2 * a_group, 2 * b_group + 1)), kind="stable")
        tokens = [*map(tokens.__getitem__, order.tolist())]
        cuts = [0, *np.cumsum(numbers[:, 0] + numbers[:, 1]).tolist()]
        return numbers, a[np.searchsorted(a_end, ends)], b[np.searchsorted(b_end, ends)], [b"".join(tokens[i:j]) for i, j in zip(cuts, cuts[1:])]


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair for each worker process."""
    if (a_path, b_path) not in _tokenizers:
        _tokenizers[a_path, b_path] = Tokenizers(a_path, b_path)
    return _tokenizers[a_path, b_path]


class Chunks:
    """Alignments of chunks, each worked out once: a code by name, and arrays by code.

    A chunk that is one part between spaces and line feeds is named by it (with the line feed it begins with, without the space);
    one of several parts by all its characters, which no single part can be.
    """

    def __init__(self, own: Tokenizers, parts: int):
        self.own, self.parts = own, parts
        self.stride = -(-own.n_a // parts)
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.numbers, self.pairs = [np.empty((0, 4), np.int64)], [np.empty(0, np.int64)]

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs as numbers: by part of the A id, then A id, then B id."""
        return ((a % self.parts) * self.stride + a // self.parts) * self.own.n_b + b

    def learn(self, names: set[str]) -> None:
        block, held, alone = [], 0, []
        for name in names:
            if name not in self.codes:
                if name[-1:].isspace() or self.own.whole:
                    alone.append([name])
                    continue
                block.append(name)
                held += len(name)
                if held > BLOCK:
                    self._learn(block)
                    block, held = [], 0
        for some in (block, *alone):
            self._learn(some)

    def _learn(self, names: list[str]) -> None:
        """Chunks that end in white space come alone: what follows could join them."""
        if not names:
            return
        whole = self.own.whole
        texts = [n if n[0] == " " and not whole or n[0] == "\n" and not whole else " " + n for n in names]
        numbers, a, b, groups = self.own.align(texts)
        self.codes.update(zip(names, range(len(self.groups), len(self.groups) + len(names))))
        self.groups += groups
        self.numbers.append(numbers), self.pairs.append(self.key(a, b))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers by code, where the code's links start, and the links of all codes."""
        self.numbers, self.pairs = [np.concatenate(self.numbers)], [np.concatenate(self.pairs)]
        return self.numbers[0], np.concatenate(([0], np.cumsum(self.numbers[0][:, 3]))), self.pairs[0]

    def names(self, text: str) -> list[str]:
        """Names of a window's chunks. A part that ends in white space, or is empty, belongs to the next one, at the end to the one before."""
        if self.own.whole:
            return [text]
        parts = text.replace("\n", " \n").split(" ")
        if not LOOSE.search(text):
            return parts
        chunks: list[str] = []
        held = ""
        for part in parts:
            if part and not part[-1].isspace():
                chunks.append((held + part if part[0] == "\n" else f"{held} {part}") if held else part)
                held = ""
            else:
                held += part if part[:1] == "\n" else f" {part}"
        if held and chunks:
            held = chunks.pop() + held
            held = held if held[0] in " \n" else " " + held
        return [*chunks, held] if held else chunks


#: White space at an end of a text, or beside other white space.
LOOSE = re.compile(r"\A\s|\s\s|\s\Z")


def windows(text: str, whole: bool) -> Iterator[str]:
    """Parts of a text that end where a space follows a character that is no white space, without that space."""
    at = 0
    while not whole and len(text) - at > WINDOW:
        end = text.find(" ", at + WINDOW)
        while end > 0 and text[end - 1].isspace():
            end = text.find(" ", end + 1)
        if end < 0 or end + 1 == len(text):
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, kind).tobytes())


def _open(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


class Spill:
    """Buffered records of some documents, and what is known of each document without the corpus."""

    def __init__(self, chunks: Chunks):
        self.chunks = chunks
        self.records: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.held, self.docs = 0, 0
        self.ids: list[pa.Array] = []
        self.known: list[np.ndarray] = []
        self.digests: list[str] = []

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        chunks, digests = self.chunks, []
        named = [[chunks.names(w) for w in windows(text, chunks.own.whole)] if text else [] for text in texts]
        chunks.learn({n for own in named for names in own for n in names})
        numbers, starts, pairs = chunks.arrays()
        known, codes, owners = np.zeros((len(texts), 4), np.int64), [], []
        for row, own in enumerate(named):
            named[row] = None
            mine = [[*map(chunks.codes.__getitem__, names)] for names in own]
            arrays = [np.array(c, np.int64) for c in mine]
            if not own or any((numbers[c, 0] == 0).any() for c in arrays):
                digests.append("")
                continue
            digest = hashlib.sha256()
            for k, c in enumerate(mine, 1 - len(mine)):
                found = b"".join(map(chunks.groups.__getitem__, c))
                digest.update(found if k else found[:-1])
            digests.append(digest.hexdigest())
            codes += arrays
            owners += [(row, len(c)) for c in mine]
        if codes:
            code = np.concatenate(codes)
            owner = np.repeat(*np.array(owners, np.int64).T)
            edge = np.flatnonzero(np.diff(owner, prepend=-1))
            known[owner[edge]] = np.add.reduceat(numbers[code], edge, axis=0)
            n = numbers[code, 3]
            ends = np.cumsum(n)
            links = pairs[np.repeat(starts[code] - (ends - n), n) + np.arange(ends[-1])]
            record, times = np.unique(links << DOC_BITS | np.repeat(owner + self.docs, n), return_counts=True)
            self.records.append(record), self.links.append(times.astype(np.uint32))
            self.held += len(record)
        self.ids.append(ids), self.known.append(known), self.digests.extend(digests)
        self.docs += len(texts)
        if len(chunks.codes) > REMEMBERED:
            chunks.forget()

    def full(self) -> bool:
        return self.held >= SPILL

    def write(self, name: int) -> Iterator[pa.RecordBatch]:
        """The documents' rows, and a run for each part that has records."""
        n, known = self.docs, np.concatenate(self.known)
        yield _rows(name, n, doc=np.arange(n, dtype=np.int32), id=pa.chunked_array(self.ids).combine_chunks(), groups_sha256=self.digests, **{c: known[:, i] for i, c in enumerate(COUNTED)})
        if not self.records:
            return
        record, links = np.concatenate(self.records), np.concatenate(self.links)
        order = np.argsort(record, kind="stable")
        record, links = record[order], links[order]
        key, doc = record >> DOC_BITS, (record & (1 << DOC_BITS) - 1).astype(np.uint32)
        span = self.chunks.stride * self.chunks.own.n_b
        edges = np.searchsorted(key, np.arange(self.chunks.parts + 1) * span)
        for part in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[part], edges[part + 1])
            first = np.flatnonzero(np.diff(key[own], prepend=-1))
            pairs, n_docs = key[own][first], np.diff(first, append=edges[part + 1] - edges[part])
            yield _rows(name, 1, part=part, pairs=[_pack(_deltas(pairs), "<i8")], n_docs=[_pack(n_docs, "<u4")], members=[_pack(np.concatenate((_deltas(doc[own]), links[own])), "<u4")])


FIELDS = [("spill", pa.int64()), ("part", pa.int32()), ("doc", pa.int32()), ("id", None), *[(c, pa.int64()) for c in COUNTED], ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("n_docs", pa.binary()), ("members", pa.binary())]


def _rows(spill: int, n: int, part: int = -1, **columns) -> pa.RecordBatch:
    arrays = []
    for name, kind in FIELDS:
        if name in ("spill", "part"):
            arrays.append(pa.array(np.full(n, spill if name == "spill" else part), kind))
        elif name in columns:
            arrays.append(columns[name] if kind is None else pa.array(columns[name], kind))
        else:
            arrays.append(pa.nulls(n, kind or pa.null()))
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in FIELDS])


def _spilled(docs: DataFrame, a_path: str, b_path: str, parts: int) -> DataFrame:
    """Step 1: rows of documents (part -1) and runs."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        chunks = Chunks(tokenizers(a_path, b_path), parts)
        spill, id_type = Spill(chunks), pa.null()

        def typed(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("id")
            return batch if batch.schema.field(at).type == id_type else batch.set_column(at, "id", batch.column(at).cast(id_type))

        for batch in batches:
            id_type = batch.column("id").type
            for own in slices(batch, "text", 2 << 20):
                spill.add(own.column("id"), own.column("text").to_pylist())
                if spill.full() or spill.docs >= 1 << DOC_BITS - 1:
                    yield from map(typed, spill.write(task << 24 | n))
                    spill, n = Spill(chunks), n + 1
        if spill.docs:
            yield from map(typed, spill.write(task << 24 | n))

    schema = f"spill long, part int, doc int, id {kind}, " + ", ".join(f"{c} long" for c in COUNTED) + ", groups_sha256 string, pairs binary, n_docs binary, members binary"
    return docs.mapInArrow(run, schema)


def _entries(pairs: bytes, n_docs: bytes) -> Iterator[tuple[int, int]]:
    """A run's pairs and their numbers of documents, decompressed a step at a time."""
    left, right = (zstandard.ZstdDecompressor().stream_reader(x) for x in (pairs, n_docs))
    last = 0
    while data := left.read(8 * STEP):
        keys = np.frombuffer(data, "<i8").cumsum() + last
        last = int(keys[-1])
        yield from zip(keys.tolist(), np.frombuffer(right.read(4 * len(keys)), "<u4").tolist())


def merge_runs(runs: list[tuple[bytes, bytes]], n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a part in order, how many documents hold each, and whether that is the highest of its A id."""
    keys, counts, best = [], [], []
    start = 0
    for key, n in heapq.merge(*(_entries(*r) for r in runs)):
        if keys and keys[-1] == key:
            counts[-1] += n
            continue
        if keys and keys[-1] // n_b != key // n_b:  # the A id is over
            top = max(counts[start:])
            best += [c == top for c in counts[start:]]
            start = len(counts)
        keys.append(key), counts.append(n)
    if keys:
        top = max(counts[start:])
        best += [c == top for c in counts[start:]]
    return np.array(keys, np.int64), np.array(counts, np.int64), np.array(best, bool)


def _counted(runs: DataFrame, n_b: int) -> DataFrame:
    """Step 2: (part, pairs, counts, best) with one row for each part."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys, counts, best = merge_runs(held, n_b)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (_pack(_deltas(keys), "<i8"), _pack(counts, "<i8"), _pack(best, "u1")))], ["part", "all_pairs", "counts", "best"])

        part, held = None, []
        for batch in batches:
            for own, pairs, n_docs in zip(*(batch.column(c).to_pylist() for c in ("part", "pairs", "n_docs"))):
                if own != part and held:
                    yield out()
                    held = []
                part = own
                held.append((pairs, n_docs))
        if held:
            yield out()

    return runs.select("part", "pairs", "n_docs").repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, all_pairs binary, counts binary, best binary")


def _contributed(runs: DataFrame, counted: DataFrame) -> DataFrame:
    """Step 3: what every run gives back to the documents of its spill."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts, best = None, None, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, keys, counts, best = row["part"], _open(row["all_pairs"], "<i8").cumsum(), _open(row["counts"], "<i8"), _open(row["best"], "u1").astype(np.int64)
                at = np.searchsorted(keys, _open(row["pairs"], "<i8").cumsum())
                n_docs, members = _open(row["n_docs"], "<u4"), _open(row["members"], "<u4")
                doc, links = np.cumsum(members[: len(members) // 2], dtype=np.uint32), members[len(members) // 2 :].astype(np.int64)
                owners, place = np.unique(doc, return_inverse=True)
                sums = np.zeros((2, len(owners)), np.int64)
                np.add.at(sums[0], place, links * np.repeat(counts[at], n_docs))
                np.add.at(sums[1], place, links * np.repeat(best[at], n_docs))
                out.append((row["spill"], part, _pack(_deltas(owners), "<u4"), _pack(sums, "<i8")))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["spill", "part", "owners", "sums"]) if out else pa.RecordBatch.from_pylist([], schema=pa.schema([("spill", pa.int64()), ("part", pa.int32()), ("owners", pa.binary()), ("sums", pa.binary())]))

    return runs.select("spill", "part", "pairs", "n_docs", "members").join(counted, "part").mapInArrow(give, "spill long, part int, owners binary, sums binary")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    spilled = stash(_spilled(slim, a_path, b_path, parts))
    runs = spilled.where("part >= 0")
    from sentencepiece import SentencePieceProcessor

    given = _contributed(runs, _counted(runs, SentencePieceProcessor(model_file=b_path).get_piece_size()))
    mine = spilled.where("part < 0").select("spill", "part", "doc", "id", *COUNTED, "groups_sha256").unionByName(given, allowMissingColumns=True)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spill, rows, sums = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            at = 0
            for own in rows:
                n = own.num_rows
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("id", *COUNTED)), pa.array(sums[1, at : at + n]), pa.array(sums[0, at : at + n]), own.column("groups_sha256")], ["id", *COUNTED, "n_best", "count_sum", "groups_sha256"])
                at += n

        for batch in batches:
            spills = batch.column("spill").to_numpy()
            parts_of = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(spills) != 0) | (np.minimum(parts_of[1:], 0) != np.minimum(parts_of[:-1], 0))) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                own = batch.slice(start, end - start)
                if spills[start] != spill:
                    if rows:
                        yield from out()
                    spill, rows, sums = spills[start], [], None
                if parts_of[start] < 0:
                    rows.append(own)
                    sums = np.zeros((2, sum(r.num_rows for r in rows)), np.int64)
                    continue
                for owners, given_sums in zip(own.column("owners").to_pylist(), own.column("sums").to_pylist()):
                    who = np.cumsum(_open(owners, "<u4"), dtype=np.uint32)
                    sums[:, who] += _open(given_sums, "<i8").reshape(2, -1)
        if rows:
            yield from out()

    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTED) + ", n_best long, count_sum long, groups_sha256 string"
    return mine.repartition("spill").sortWithinPartitions("spill", "part", "doc").mapInArrow(add_up, schema).withColumnRenamed("id", id_col)
