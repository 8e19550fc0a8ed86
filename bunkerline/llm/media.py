"""Media columns of baseline JPEG files.

Method: a file's markers are parsed, its scan is Huffman-decoded, the DC coefficients of the luminance component become a thumbnail
in numpy, and dimensions and thumbnail hashes are kept. `write_jpeg` makes the files: payload bytes are the quantised coefficients of a grey image
(in zigzag order, 64 a block), so the format stores them without loss. Its tables give every block the same number of bits, which `read_jpeg`
recognises from the tables and decodes for all blocks at once; any other baseline scan (more components, sampling factors,
restart intervals, any tables) is decoded symbol by symbol.

Defined cases: a null or empty text is a payload of 576 bytes 255; equal texts give equal files; repeated rows and null ids are
handled on their own; an empty table gives an empty result; other columns stay, those named like new ones are replaced. Coefficients are coded a slice of
`SLICE` blocks at a time, so memory stays near the file's own size.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bunkerline.llm.common import blobs, slices

UNIT = 576
SLICE = 1 << 13  # a multiple of 8, so that a slice ends at a byte
#: Bits of a DC difference: its category's code has the rest of these bits. An AC coefficient is a zero bit and its byte.
DC_BITS, AC_BITS = 12, 9
BLOCK_BITS = DC_BITS + 63 * AC_BITS
_SCAN_END = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")


def payload(text: bytes) -> bytes:
    """The text, filled with bytes 255 to a positive multiple of 576."""
    return text + b"\xff" * ((-len(text)) % UNIT if text else UNIT)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int, used: int) -> bytes:
    dc = bytes(1 if 4 <= n <= 12 else 0 for n in range(1, 17)) + bytes(range(8, -1, -1))
    ac = bytes([1] + [0] * 15 + [0x08])
    return b"".join([
        b"\xff\xd8", _segment(0xFE, b"payload %d" % used), _segment(0xDB, b"\x00" + bytes([8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)), _segment(0xC4, b"\x00" + dc + b"\x10" + ac),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def _category(d: int) -> int:
    return abs(d).bit_length()


def _dc_words() -> np.ndarray:
    """The 12 bits of each difference from -255 to 255."""
    codes, code = {}, 0
    for length in range(4, 13):
        codes[12 - length] = code
        code = (code + 1) << 1
    return np.array([(codes[c] << c) | (d if d >= 0 else d + (1 << c) - 1) for d in range(-255, 256) for c in [_category(d)]], ">u2")


_WORDS = _dc_words()


def write_jpeg(data: bytes) -> bytes:
    """A grey baseline JPEG file whose coefficients are the bytes of `data`, a multiple of 576 of them."""
    units = len(data) // UNIT
    across = 9 * -(-units // 8191)
    down = -(-9 * units // across)
    blocks = np.zeros((across * down, 64), np.uint8)
    blocks.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    difference = np.diff(blocks[:, 0].astype(np.int16), prepend=np.int16(128))
    words = _WORDS[difference + 255]
    parts = []
    for at in range(0, len(blocks), SLICE):
        own = blocks[at : at + SLICE]
        bits = np.zeros((len(own), BLOCK_BITS), np.uint8)
        bits[:, :DC_BITS] = np.unpackbits(words[at : at + SLICE].view(np.uint8)).reshape(-1, 16)[:, 4:]
        bits[:, DC_BITS:].reshape(len(own), 63, AC_BITS)[:, :, 1:] = np.unpackbits(np.ascontiguousarray(own[:, 1:])).reshape(-1, 63, 8)
        flat = bits.reshape(-1)
        parts.append(np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])).tobytes())
    return _head(8 * across, 8 * down, len(data)) + b"".join(parts).replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


@dataclass
class Header:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantisation
    quantisation: dict[int, list[int]] = field(default_factory=dict)
    tables: dict[tuple[int, int], dict[tuple[int, int], int]] = field(default_factory=dict)  # (class, id): (length, code): symbol
    restart: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    comment: bytes = b""
    data: bytes = b""


def parse(media: bytes) -> Header:
    """Markers of a baseline file, up to and with its first scan."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    head, at = Header(), 2
    while True:
        if media[at] != 0xFF:
            raise ValueError("marker expected")
        while media[at + 1] == 0xFF:
            at += 1
        marker = media[at + 1]
        body = media[at + 4 : at + 2 + int.from_bytes(media[at + 2 : at + 4], "big")]
        at += 4 + len(body)
        if marker in (0xC0, 0xC1):
            bits, head.height, head.width, count = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise ValueError("only 8-bit samples")
            head.components = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * k : 9 + 3 * k] for k in range(count))]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = body[1 : 65 + 64 * wide]
                head.quantisation[body[0] & 15] = list(struct.unpack(">64H" if wide else ">64B", values))
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts, codes, code, k = body[1:17], {}, 0, 17
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        codes[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                head.tables[body[0] >> 4, body[0] & 15] = codes
                body = body[k:]
        elif marker == 0xDD:
            head.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            head.comment = body
        elif marker == 0xDA:
            head.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            end = _SCAN_END.search(media, at)
            head.data = media[at : end.start() if end else len(media)]
            return head


def _even(head: Header) -> tuple[int, int] | None:
    """Bits of a DC and of an AC coefficient, if the tables make them the same for every value, and there are no zero runs."""
    if len(head.scan) != 1 or head.restart or head.components[0][1:3] != (1, 1):
        return None
    dc, ac = head.tables[0, head.scan[0][1]], head.tables[1, head.scan[0][2]]
    sizes = {length + symbol for (length, _), symbol in dc.items()}
    if len(sizes) != 1 or list(ac) != [(1, 0)] or list(ac.values()) != [8] or max(sizes) > 16:
        return None
    return sizes.pop(), 9


def coefficients(head: Header) -> np.ndarray:
    """Quantised coefficients of the first component, a row of 64 in zigzag order for each block, row by row."""
    even = _even(head)
    return _decode_even(head, *even) if even else _decode(head)


def _decode_even(head: Header, dc_bits: int, ac_bits: int) -> np.ndarray:
    count = -(-head.width // 8) * -(-head.height // 8)
    difference = np.zeros(1 << dc_bits, np.int32)
    for (length, code), c in head.tables[0, head.scan[0][1]].items():
        extra = np.arange(1 << c)
        difference[(code << c) + extra] = np.where(extra >> max(0, c - 1) if c else extra, extra, extra - (1 << c) + 1)
    data = np.frombuffer(head.data.replace(b"\xff\x00", b"\xff"), np.uint8)
    width = dc_bits + 63 * ac_bits
    out = np.empty((count, 64), np.int32)
    place = 1 << np.arange(dc_bits - 1, -1, -1)
    for at in range(0, count, SLICE):
        n = min(SLICE, count - at)
        bits = np.unpackbits(data[at * width // 8 : -(-(at + n) * width // 8)], count=n * width).reshape(n, width)
        out[at : at + n, 0] = difference[bits[:, :dc_bits].astype(np.int64) @ place]
        ac = bits[:, dc_bits:].reshape(n, 63, ac_bits)
        if ac[:, :, 0].any():
            raise ValueError("undefined code in the scan")
        values = np.packbits(np.ascontiguousarray(ac[:, :, 1:]), axis=2).reshape(n, 63).astype(np.int32)
        out[at : at + n, 1:] = np.where(values < 128, values - 255, values)
    out[:, 0] = np.cumsum(out[:, 0])
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = int.from_bytes(data, "big") if data else 0, 0
        self.size = 8 * len(data)

    def take(self, n: int) -> int:
        self.at += n
        if self.at > self.size:
            raise ValueError("the scan ends early")
        return (self.data >> (self.size - self.at)) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = (code << 1) | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("undefined code in the scan")

    def value(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _decode(head: Header) -> np.ndarray:
    shapes = {c: (h, v) for c, h, v, _ in head.components}
    single = len(head.scan) == 1
    most_h, most_v = max(h for h, _ in shapes.values()), max(v for _, v in shapes.values())
    first = head.components[0][0]
    h, v = shapes[first]
    across, down = -(-(-(-head.width * h // most_h)) // 8), -(-(-(-head.height * v // most_v)) // 8)
    units = (across, down) if single else (-(-head.width // (8 * most_h)), -(-head.height // (8 * most_v)))
    out = np.zeros((down if single else units[1] * v, across if single else units[0] * h, 64), np.int32)
    pieces = re.split(rb"\xff[\xd0-\xd7]", head.data) if head.restart else [head.data]
    bits, last = None, {}
    for unit in range(units[0] * units[1]):
        if unit % (head.restart or units[0] * units[1]) == 0:
            bits = _Bits(pieces[unit // head.restart if head.restart else 0].replace(b"\xff\x00", b"\xff"))
            last = dict.fromkeys(shapes, 0)
        y, x = divmod(unit, units[0])
        for c, dc, ac in head.scan:
            ch, cv = (1, 1) if single else shapes[c]
            for k in range(ch * cv):
                block = np.zeros(64, np.int32)
                last[c] += bits.value(bits.symbol(head.tables[0, dc]))
                block[0] = last[c]
                i = 1
                while i < 64:
                    run, size = divmod(bits.symbol(head.tables[1, ac]), 16)
                    if not size and run < 15:
                        break
                    i += run
                    if size:
                        block[i] = bits.value(size)
                    i += 1
                if c == first:
                    out[y * cv + k // ch, x * ch + k % ch] = block
    return out[:down, :across].reshape(-1, 64)


def thumbnail(head: Header, coefs: np.ndarray) -> np.ndarray:
    """One luminance sample a block, from its DC coefficient alone."""
    most_h, h = max(c[1] for c in head.components), head.components[0][1]
    across = -(-(-(-head.width * h // most_h)) // 8)
    scale = head.quantisation[head.components[0][3]][0]
    return np.clip(np.rint(coefs[:, 0] * scale / 8 + 128), 0, 255).astype(np.uint8).reshape(-1, across)


def shrunk(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Sums over a grid of near equal cells, in proportion to their size, by cumulative sums."""
    sums = np.pad(image.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y, x = (np.arange(k + 1) * n / k for k, n in ((rows, image.shape[0]), (columns, image.shape[1])))

    def at(a: np.ndarray, axis: int, table: np.ndarray) -> np.ndarray:
        low = np.minimum(np.floor(a).astype(int), table.shape[axis] - 2)
        part = a - low
        part = part[:, None] if axis == 0 else part[None, :]
        return table.take(low, axis) * (1 - part) + table.take(low + 1, axis) * part

    corners = at(x, 1, at(y, 0, sums))
    return np.diff(np.diff(corners, axis=0), axis=1) / (np.diff(y)[:, None] * np.diff(x)[None, :])


def features(head: Header, coefs: np.ndarray) -> str:
    """Dimensions, a gradient hash and a mean hash of the thumbnail (64 bits each), and its mean."""
    image = thumbnail(head, coefs)
    small = np.round(shrunk(image, 8, 9), 6)
    rising = np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    even = np.round(shrunk(image, 8, 8), 6)
    above = np.packbits(even > np.round(even.mean(), 6)).tobytes().hex()
    return f"{head.width}x{head.height}:{rising}:{above}:{image.mean():.3f}"


def read_jpeg(media: bytes) -> tuple[bytes, Header, np.ndarray]:
    """The payload that `write_jpeg` stored, the header and the coefficients."""
    head = parse(media)
    coefs = coefficients(head)
    used = int(head.comment.split()[1])
    values = np.where(coefs < 0, coefs + 255, coefs)
    values[:, 0] = coefs[:, 0] + 128
    return values.astype(np.uint8).tobytes()[:used], head, coefs


def _spec(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def store_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with a column `media`: the JPEG file of each text's payload."""
    columns = [c for c in docs.columns if c != "media"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                media = [write_jpeg(payload(t)) for t in blobs(part.column(text_col))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(media, pa.binary())], [*columns, "media"])

    return docs.mapInArrow(encode, _spec(docs, columns) + "media binary")


def read_media(files: DataFrame) -> DataFrame:
    """Files with `payload` (the stored bytes), `width`, `height` and `feature` of their column `media`."""
    columns = [c for c in files.columns if c not in ("payload", "width", "height", "feature")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 2 << 20):
                found = [(data, h.width, h.height, features(h, c)) for data, h, c in map(read_jpeg, blobs(part.column("media")))]
                new = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *new], [*columns, "payload", "width", "height", "feature"])

    return files.mapInArrow(decode, _spec(files, columns) + "payload binary, width int, height int, feature string")
