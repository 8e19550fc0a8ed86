import hashlib
import re

import xxhash

from bunkerline.llm import imatch
from bunkerline.llm.queries import QUERIES

SIGNED = lambda x: x - (1 << 64) if x >> 63 else x


def words(text):
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def hashes(text):
    return {xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)}


def whole_fingerprint(text, kept):
    """As the module states it: every lexicon term of the text, in parts that are the same for all texts."""
    every = hashes(text)
    own = {h for h in every if h in kept} or every
    out = ""
    for r in range(imatch.SUBSETS):
        seed, part = 42, sorted((h for h in own if (h >> 6) & (imatch.SUBSETS - 1) == r), key=SIGNED)
        for h in part:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        out += f"{seed >> 48:04x}" if part else imatch.NONE
    return out


def band(texts, low, high):
    counts = {}
    for t in texts:
        for h in hashes(t):
            counts[h] = counts.get(h, 0) + 1
    return {h for h, c in counts.items() if max(2, low * len(texts)) <= c < max(3, high * len(texts))}


def like(a, b):
    cut = lambda x: [x[i : i + 4] for i in range(0, len(x), 4)]
    both = [(x, y) for x, y in zip(cut(a), cut(b)) if x != imatch.NONE or y != imatch.NONE]
    return sum(x == y for x, y in both) / len(both) if both else 1.0


def brute(rows):
    """rows (doc_id, text) with distinct ids."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    kept = band([t for _, t in rows], *imatch.BAND)
    out = {}
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b = whole_fingerprint(t, kept), whole_fingerprint(edited, kept)
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, whole_fingerprint(following, kept)))
    return out


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_odd_rows(spark):
    rows = [(None, "alpha beta gamma"), (5, None), (7, ""), (9, "Ünïcode ß 漢字, x_y"), (-3, "alpha beta gamma"), (10, "w%d " * 20 % tuple(range(20)) + "z" * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, next_id string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in imatch.compare(docs).collect()}
    assert got == brute(rows)
    assert got[None][2] == got[-3][2] and got[5][2] == imatch.NONE * imatch.SUBSETS
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (2, "e f")], "doc_id long, text string")
    out = imatch.compare(twice).collect()
    assert len(out) == 4 and {r["edited_sha256"] for r in out if r["doc_id"] == 2} == {hashlib.sha256(b"e a").hexdigest()}
    assert imatch.compare(docs.limit(0)).count() == 0
    assert imatch.compare(docs.limit(1)).count() == 1


def test_texts_and_parts_of_texts_move_once_each(spark):
    def moved(plan):
        own = plan.nodeName() == "Exchange" and any(plan.output().apply(i).dataType().simpleString() == "string" for i in range(plan.output().size()))
        return own + sum(moved(plan.children().apply(i)) for i in range(plan.children().size()))

    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = imatch.edited(spark.createDataFrame([(None, "gh"), (1, "abcd"), (1, "abca"), (2, "xyz")], "doc_id long, text string"))
        rows = sorted((tuple(r) for r in out.collect()), key=str)
        assert moved(out._jdf.queryExecution().executedPlan()) == 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == [(1, "abca", 2, "abxy"), (1, "abcd", 2, "abxy"), (2, "xyz", None, "xyg"), (None, "gh", 1, "ga")]


def test_one_term_changes_one_part_whatever_the_number_of_terms(spark):
    sizes = (95, 96, 191, 192, 384)
    rows = [(i, " ".join(f"t{n}x{k}" for k in range(n + more))) for i, (n, more) in enumerate((n, more) for n in sizes for more in (0, 1, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["near_next"]) for r in imatch.compare(docs, band=(0.0, 0.9)).collect()}
    assert {d: f for d, (f, _) in got.items()} == {d: whole_fingerprint(t, hashes(t)) for d, t in rows}
    for i in range(len(sizes)):
        assert got[3 * i][1] > 0.95, (sizes[i], got[3 * i][1])


def test_every_term_of_a_large_band_counts_and_no_other(spark):
    rows = [(2 * i + j, " ".join(f"b{i}x{k}" for k in range(1000)) + f" own{i}x{j} the of and") for i in range(80) for j in range(2)]
    kept = band([t for _, t in rows], *imatch.BAND)
    assert len(kept) == 80_000 > imatch.LEXICON
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.compare(docs).collect()}
    assert got == {d: whole_fingerprint(t, kept) for d, t in rows}


def test_whole_table_by_exact_membership(spark, small_dir):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    kept = band([t for _, t in rows], *imatch.BAND)
    following = dict(zip(sorted(d for d, _ in rows), sorted(d for d, _ in rows)[1:] + [min(d for d, _ in rows)]))
    texts = dict(rows)
    want = {}
    for d, t in rows:
        half = len(t) // 2
        a, b = whole_fingerprint(t, kept), whole_fingerprint(t[: len(t) - half] + texts[following[d]][:half], kept)
        want[d] = (a, b, like(a, b), like(a, whole_fingerprint(texts[following[d]], kept)))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS[2:]) for r in QUERIES["op8_imatch"](spark, small_dir).collect()}
    assert got == want
    near = sum(w[2] for w in want.values()), sum(w[3] for w in want.values())
    print("near_edited, near_next", near, len(want))
