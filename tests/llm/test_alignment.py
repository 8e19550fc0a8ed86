import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bunkerline.llm import alignment
from bunkerline.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n  b\t c \n", "\n", "\r\n x\r", "Naïve CAFÉ's İstanbul", "<|endoftext|> x<s></s><unk> <0x41>", "3,14   été",
    "▁ mark", "x▁y", "漢字 emoji 😀 👩‍👩‍👧", "　wide　 \xa0space \x85 \x1c z", "don't you'll  we've", "x" * 5000, "\x00 nul\x00", "ＦＵＬＬ ﬁ é", "the the the", "the the the", "a\n\nb\nc", "x \ny", "\ta\tb \t", "q\n", "q\n r", "\nb", " \nb", "\n\nb", "one\n's",
]


def brute(texts):
    """Whole texts through both tokenizers, ranges compared pair by pair."""
    own = alignment.Tokenizers(A, B)
    rows, held = [], defaultdict(set)
    for k, text in enumerate(texts):
        links, groups, a, b = [], [], [], []
        if text:
            a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
            data = b" " + text.encode()
            if b"".join(own.a_bytes[i] for i in a) != data or b"".join(own.b_bytes[i] for i in b) != data:
                a, b = [], []

        def ends(ids, table):
            out = [0]
            for i in ids:
                out.append(out[-1] + len(table[i]))
            return out

        ea, eb = ends(a, own.a_bytes), ends(b, own.b_bytes)
        j0 = 0
        for i in range(len(a)):
            while j0 < len(b) and eb[j0 + 1] <= ea[i]:
                j0 += 1
            j = j0
            while j < len(b) and eb[j] < ea[i + 1]:
                links.append((a[i], b[j]))
                j += 1
        both = sorted(set(ea[1:]) & set(eb[1:]))
        at = 0
        for end in both:
            groups.append("|".join(",".join(map(str, ids[e.index(at) : e.index(end)])) for ids, e in ((a, ea), (b, eb))))
            at = end
        for pair in set(links):
            held[pair].add(k)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (x, _), docs in held.items():
        top[x] = max(top[x], len(docs))
    out = []
    for n_a, n_b, n_groups, links, digest in rows:
        counts = [(len(held[p]), top[p[0]]) for p in links]
        out.append((n_a, n_b, n_groups, len(links), sum(c == t for c, t in counts), sum(c for c, _ in counts), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_odd_texts_and_repeated_rows(spark):
    rows = [(None if k == 3 else k % 7, t, "x") for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spill string")
    got = Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.align(docs, A, B).collect())
    assert got == Counter((i, *w) for (i, _, _), w in zip(rows, brute(ODD)))


def test_empty_table_and_other_ids(spark):
    docs = spark.createDataFrame([("k", "some words"), (None, "some")], "name string, body string")
    assert alignment.align(docs.limit(0), A, B, "name", "body").count() == 0
    assert {r["name"]: r["count_sum"] for r in alignment.align(docs, A, B, "name", "body").collect()} == {"k": 3, None: 2}


def test_many_spills_windows_and_forgetting(spark, monkeypatch):
    """Small buffers, windows and memories in the driver's own process give the same rows."""
    monkeypatch.setattr(alignment, "SPILL", 50)
    monkeypatch.setattr(alignment, "WINDOW", 7)
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    dice = random.Random(3)
    texts = [" ".join(dice.choice(["the", "word,", "", "a\n", "été", "x1", "don't", "(so)", "\t"]) for _ in range(dice.randrange(40))) for _ in range(60)]
    own = alignment.tokenizers(A, B)
    spills, known = [], []
    spill, chunks = None, alignment.Chunks(own, 4)
    import pyarrow as pa

    for k, text in enumerate(texts):
        spill = spill or alignment.Spill(chunks)
        spill.add(pa.array([k]), [text])
        if spill.full() or k + 1 == len(texts):
            spills.append([r for batch in spill.write(len(spills)) for r in batch.to_pylist()])
            spill = None
    assert len(spills) > 3
    known = [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links")) + (r["groups_sha256"],) for s in spills for r in s if r["part"] < 0]
    want = brute(texts)
    assert known == [w[:4] + w[6:] for w in want]
    total = 0
    for part in range(4):
        runs = [(r["pairs"], r["n_docs"]) for s in spills for r in s if r["part"] == part]
        keys, counts, best = alignment.merge_runs(runs, own.n_b)
        assert (keys[1:] > keys[:-1]).all()
        total += int(counts.sum())
        for a in set((keys // own.n_b).tolist()):
            mine = keys // own.n_b == a
            assert (best[mine] == (counts[mine] == counts[mine].max())).all()
    held = Counter()
    for text in texts:
        held[text] = 0
        if text:
            _, a, b, _ = chunks.own.align([" " + text])
            held[text] = len(set(zip(a.tolist(), b.tolist())))
    assert total == sum(held[t] for t in texts)


@pytest.mark.parametrize("cut", [None, 3000])
def test_whole_table(spark, small_dir, cut):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = {r["doc_id"]: w for r, w in zip(rows, brute([r["text"] for r in rows]))}
    if cut is None:
        got = QUERIES["op12_alignment"](spark, small_dir)
    else:
        got = alignment.align(docs.withColumn("members", F.lit(1)).repartition(13), A, B, parts=7)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want
