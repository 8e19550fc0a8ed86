import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bunkerline.llm import media
from bunkerline.llm.queries import QUERIES


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip_on_both_paths(text):
    data = media.payload(text)
    assert data.startswith(text) and len(data) % 576 == 0 and data
    file = media.write_jpeg(data)
    got, head, coefs = media.read_jpeg(file)
    assert got == data and media._even(head)
    assert (media._decode(head) == coefs).all()


def test_slices_and_tall_files(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 576 * 70, dtype=np.uint8).tobytes()
    whole = media.write_jpeg(data)
    monkeypatch.setattr(media, "SLICE", 16)
    assert media.write_jpeg(data) == whole and media.read_jpeg(whole)[0] == data
    monkeypatch.undo()
    long = bytes(576 * 8200)
    file = media.write_jpeg(long)
    assert media.read_jpeg(file)[0] == long and media.parse(file).height <= 65535


def encode_any(blocks_by_unit, components, size, restart, rng):
    """A plain baseline encoder: every symbol used gets a code of one length."""
    def category(v):
        return abs(v).bit_length()

    def symbols(block, last):
        out = [("dc", category(block[0] - last), block[0] - last)]
        run = 0
        final = max((i for i in range(1, 64) if block[i]), default=0)
        for i in range(1, final + 1):
            if block[i]:
                while run > 15:
                    out.append(("ac", 0xF0, None))
                    run -= 16
                out.append(("ac", run << 4 | category(block[i]), block[i]))
                run = 0
            else:
                run += 1
        if final < 63:
            out.append(("ac", 0, None))
        return out

    units, last = [], {}
    for u, unit in enumerate(blocks_by_unit):
        if restart and u % restart == 0:
            last = {}
        row = []
        for c, block in unit:
            row += symbols(block, last.get(c, 0))
            last[c] = block[0]
        units.append(row)
    codes, head = {}, []
    for k, kind in enumerate(("dc", "ac")):
        used = sorted({s for row in units for t, s, _ in row if t == kind})
        rng.shuffle(used)
        length = max(2, (len(used)).bit_length() + 1)
        codes[kind] = {s: (length, i) for i, s in enumerate(used)}
        head.append(media._segment(0xC4, bytes([k << 4]) + bytes(len(used) if n == length else 0 for n in range(1, 17)) + bytes(used)))
    stream, pieces = "", []
    for u, row in enumerate(units):
        if restart and u and u % restart == 0:
            pieces.append(stream)
            stream = ""
        for kind, s, v in row:
            length, code = codes[kind][s]
            stream += f"{code:0{length}b}"
            if v:
                n = category(v)
                stream += f"{v if v > 0 else v + (1 << n) - 1:0{n}b}"
    pieces.append(stream)
    packed = []
    for p in pieces:
        p += "1" * (-len(p) % 8)
        packed.append(int(p, 2).to_bytes(len(p) // 8, "big").replace(b"\xff", b"\xff\x00") if p else b"")
    scan = packed[0] + b"".join(bytes([0xFF, 0xD0 + k % 8]) + p for k, p in enumerate(packed[1:]))
    frame = struct.pack(">BHHB", 8, size[1], size[0], len(components)) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in components)
    sos = bytes([len(components)]) + b"".join(bytes([c, 0]) for c, _, _ in components) + bytes([0, 63, 0])
    dri = media._segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + media._segment(0xE0, b"JFIF\0") + media._segment(0xDB, b"\x00" + bytes([3] * 64)) + media._segment(0xC0, frame) + b"".join(head) + dri + media._segment(0xDA, sos) + scan + b"\xff\xd9"


@pytest.mark.parametrize("components, size, restart", [([(1, 1, 1)], (20, 30), 0), ([(1, 2, 2), (2, 1, 1), (3, 1, 1)], (40, 20), 0), ([(1, 2, 1), (2, 1, 1)], (33, 9), 2)])
def test_other_baseline_files(components, size, restart):
    rng = random.Random(size[0])
    single = len(components) == 1
    mh, mv = max(c[1] for c in components), max(c[2] for c in components)
    across, down = -(-size[0] // (8 * mh)), -(-size[1] // (8 * mv))
    first, units = {}, []
    for u in range(across * down):
        unit = []
        for c, h, v in components:
            for k in range(1 if single else h * v):
                block = [rng.choice([0, 0, 0, 0, 1, -3, 90]) if i else rng.randint(-200, 200) for i in range(64)]
                if rng.random() < 0.2:
                    block[1:] = [0] * 63
                unit.append((c, block))
                if c == 1:
                    first[(u // across) * (1 if single else v) + k // h, (u % across) * (1 if single else h) + k % h] = block
        units.append(unit)
    head = media.parse(encode_any(units, components, size, restart, rng))
    coefs = media.coefficients(head)
    h, v = components[0][1:]
    wide, tall = -(-(-(-size[0] * h // mh)) // 8), -(-(-(-size[1] * v // mv)) // 8)
    want = np.array([first[y, x] for y in range(tall) for x in range(wide)])
    assert (coefs == want).all()
    image = media.thumbnail(head, coefs)
    assert image.shape == (tall, wide) and image[0, 0] == np.clip(np.rint(first[0, 0][0] * 3 / 8 + 128), 0, 255)
    assert media.features(head, coefs).startswith(f"{size[0]}x{size[1]}:")


def test_shrinking_keeps_means():
    image = np.random.default_rng(0).integers(0, 255, (13, 5))
    assert np.allclose(media.shrunk(image, 1, 1), image.mean()) and np.allclose(media.shrunk(image, 13, 5), image)


def test_broken_files_are_told():
    file = media.write_jpeg(media.payload(b"x"))
    for bad in (b"", b"PNG.....", file[:2] + b"\x00" + file[3:], file.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, IndexError)):
            media.read_jpeg(bad)


def test_whole_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in QUERIES["op7_media"](spark, small_dir).collect()}
    assert len(rows) == len(docs)
    seen = {}
    for d in docs:
        text = (d["text"] or "").encode()
        data, r = media.payload(text), rows[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        file = media.write_jpeg(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        assert seen.setdefault(text, r["feature"]) == r["feature"]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, b"x"), (None, "", b"x"), (None, "", b"x"), (2, "y" * 200_000, None)], "doc_id long, text string, media binary")
    out = media.read_media(media.store_media(docs)).collect()
    assert [len(r["payload"]) for r in out] == [576, 576, 576, 200_448] and bytes(out[0]["payload"]) == b"\xff" * 576
    assert media.read_media(media.store_media(docs.limit(0))).count() == 0
