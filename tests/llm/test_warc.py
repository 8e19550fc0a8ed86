import hashlib
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bunkerline.llm import warc
from bunkerline.llm.queries import ORACLES, QUERIES

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute(rows, least=1000):
    """Of (id, html) what each row comes back as; of equal ids any one is the response."""
    bodies = [(html or "").encode() for _, html in rows]
    groups = {}
    for k, ((page, _), body) in enumerate(zip(rows, bodies)):
        if len(body) >= least:
            groups.setdefault(body, []).append((page is not None, page or 0, k))
    out = []
    for k, ((page, _), body) in enumerate(zip(rows, bodies)):
        top = max(groups.get(body, [(0, 0, k)]))[2]
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if top == k else "revisit", None if top == k else rows[top][0]))
    return Counter(out)


def test_whole_table_and_sql(spark, small_dir):
    duckdb = pytest.importorskip("duckdb")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_warc"](spark, small_dir).collect())
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()]
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{small_dir}/pages.parquet'")
    assert got == Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_warc']})").fetchall())


def test_odd_rows(spark, tmp_path):
    long, dice = "é\r\n0\r\n\r\n" * 4000, random.Random(2)
    texts = [None, "", "a", "x" * 999, "x" * 1000, "é" * 500, long, "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 60, "".join(map(chr, range(1, 2000)))]
    rows = [(dice.choice([None, 1, 2, 3]), dice.choice([None, "http://a/b\r\nX: y", "http://é"]), t) for t in texts for _ in range(4)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, row string")
    files = warc.write_archives(pages, folder=str(tmp_path), segment_bytes=700)
    assert files.agg(F.sum("n_records")).first()[0] > 2 * len(rows)
    found = warc.read_archives(files, payloads=True).collect()
    got = Counter((None if r["page"] is None else int(r["page"]), r["payload_bytes"], r["payload_digest"], r["record_type"], None if r["refers_to"] is None else int(r["refers_to"])) for r in found)
    assert got == brute([(r[0], r[2]) for r in rows]) and not any(r["fault"] for r in found)
    assert Counter(bytes(r["payload"]) for r in found) == Counter((r[2] or "").encode() for r in rows)
    assert {r["uri"] for r in found} == {None, "http://a/b%0D%0AX:%20y", "http://%C3%A9"}
    empty = warc.read_archives(warc.write_archives(pages.limit(0), folder=str(tmp_path)))
    assert empty.count() == 0


def segments(body, size, own="<urn:a>", framing=True):
    block = warc.HEAD + (b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(body, 50) if framing else b"\r\n" + body)
    parts = [block[i : i + size] for i in range(0, len(block), size)]
    out = [([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        out.append(([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own}{k}"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), ("WARC-Segment-Total-Length", str(len(block)) if k == len(parts) else None)], part))
    return out


def read_files(spark, folder, *files):
    paths = []
    for k, data in enumerate(files):
        (folder / f"{k}.warc.gz").write_bytes(data)
        paths.append((str(folder / f"{k}.warc.gz"),))
    return sorted(map(tuple, warc.read_archives(spark.createDataFrame(paths, "path string"), payloads=True).select("record_id", "payload", "fault").collect()), key=str)


def test_segments_out_of_order_and_over_files(spark, tmp_path):
    body = bytes(range(256)) * 9
    parts = [warc.record(*p) for p in segments(body, 100)]
    other = [warc.record(*p) for p in segments(b"plain" * 100, 90, "<urn:b>", framing=False)]
    mixed = parts + other + parts[3:5]  # two segments twice
    random.Random(1).shuffle(mixed)
    assert read_files(spark, tmp_path, b"".join(mixed[::2]), b"".join(mixed[1::2])) == [("<urn:a>", body, None), ("<urn:b>", b"plain" * 100, None)]


def test_faults(spark, tmp_path):
    body = b"0123456789" * 60

    def damaged(own, change):
        parts = segments(body, 100, own)
        change(parts)
        return b"".join(warc.record(*p) for p in parts)

    def total(parts):
        parts[-1][0][-1] = ("WARC-Segment-Total-Length", "7")

    def digest(parts):
        parts[0][0].append(("WARC-Payload-Digest", "sha1:" + "A" * 32))

    def frame(parts):
        parts[2] = (parts[2][0], b"\r\n!" + parts[2][1][3:])

    whole = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:g>")], warc.HEAD + b"Transfer-Encoding: gzip, chunked\r\n\r\n3;x=y\r\nabc\r\n0\r\nT: u\r\n\r\n")
    lost = warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:h>"), ("WARC-Refers-To", "<urn:none>")], b"")
    files = [damaged("<urn:a>", lambda p: p.pop(2)), damaged("<urn:b>", total), damaged("<urn:c>", lambda p: p.pop()), damaged("<urn:d>", digest), damaged("<urn:e>", lambda p: p.pop(0)), damaged("<urn:f>", frame) + whole + lost, damaged("<urn:i>", lambda p: None)[:-30]]
    got = {r[0]: r[1:] for r in read_files(spark, tmp_path, *files)}
    faults = {k: v[1] for k, v in got.items() if k and k != "<urn:i>7"}
    assert faults == {"<urn:a>": "segment 3 missing", "<urn:b>": "total length", "<urn:c>": "no total length", "<urn:d>": "digest", "<urn:e>": "segment 1 missing", "<urn:f>": "chunk", "<urn:g>": None, "<urn:h>": "no response", "<urn:i>": "no total length"}
    assert got["<urn:g>"][0] == b"abc"


def test_parsing_without_packing():
    data = b"\r\nWARC/1.0\r\nWARC-Type: response\r\nX-Long: a\r\n  b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\nabc"
    assert list(warc.records(io.BytesIO(data))) == [({"warc-type": "response", "x-long": "a b", "content-length": "3"}, b"abc"), ({"content-length": "9"}, None)]


@pytest.mark.parametrize("step", [1, 2, 7, 1000])
def test_messages_in_any_parts(step):
    body = b"\r\n\r\n" * 40 + b"x" * 333
    block = warc.HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(body, 97)
    message = warc.Message(True)
    for i in range(0, len(block), step):
        message.feed(block[i : i + step])
    assert message.end() == (len(body), hashlib.sha1(body).hexdigest(), body, None)
