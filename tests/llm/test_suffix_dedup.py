import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bunkerline.llm import suffix_dedup as sd
from bunkerline.llm.queries import QUERIES


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_is_the_sorted_order(text):
    assert sd.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_runs_and_periods():
    for text in (b"a" * 300, b"ab" * 150, b"aab" * 100 + b"aac" * 50, bytes(range(255)) * 3, b""):
        assert sd.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(texts, length):
    """Removed byte masks, by counting every window."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    masks = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                mask[i : i + length] = True
        masks.append(mask)
    return masks


def runs(mask):
    return int(np.sum(np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1))


def check(spark, rows, length, anchor, most=sd.MOST):
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sd.remove_repeats(docs, length=length, anchor=anchor, most=most).collect()
    texts = [(r[1] or "").encode() for r in rows]
    masks = brute(texts, length)
    want = Counter((r[0], t, bytes(np.frombuffer(t, np.uint8)[~m]), runs(m)) for r, t, m in zip(rows, texts, masks))
    assert Counter((r["doc_id"], (r["text"] or "").encode(), bytes(r["kept"]), len(r["spans"])) for r in out) == want
    return out


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé\0") for _ in range(rng.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(20), prose(15)
    texts = [prose(rng.randint(0, 40)) for _ in range(15)]
    texts += [prose(rng.randint(0, 9)) + passage + prose(rng.randint(0, 9)) for _ in range(12)]
    texts += [passage + other, other + passage, prose(5) + other[3:] + prose(5), "ab" * 40, "ab" * 33 + "c", "aaa" * 30, passage * 3]
    base = prose(60)
    for _ in range(10):
        k = rng.randrange(len(base))
        texts.append(base[:k] + word() + base[k + 2 :])
    texts += [base, base, None, "", "short"]
    return [(i, t, "x") for i, t in enumerate(texts)] + [(None, passage, None), (3, texts[3], "x"), (3, texts[3], "x")]


def test_against_brute_force(spark):
    for seed in range(3):
        check(spark, made_up(seed), 40, 20)


def test_large_groups_are_counted_as_rows(spark):
    check(spark, made_up(7), 40, 20, most=2)
    check(spark, made_up(8), 30, 11, most=1)


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_of_long_texts(monkeypatch):
    text = bytes(random.Random(1).choices(b"abc", k=5000))
    whole = sorted(zip(*(a.tolist() for a in _all(sd.Windows(40, 20), [b"x", text, text[:39]]))))
    monkeypatch.setattr(sd, "BLOCK", 700)
    cut = sorted(zip(*(a.tolist() for a in _all(sd.Windows(40, 20), [b"x", text, text[:39]]))))
    windows = lambda rows: [(r, lo + i) for r, lo, n, *_ in rows for i in range(n)]
    assert windows(whole) == windows(cut) == [(1, i) for i in range(len(text) - 39)]
    anchors = lambda rows: [(lo + at, a) for _, lo, n, at, a, _ in rows for _ in range(n)]
    assert anchors(whole) == anchors(cut)


def _all(windows, texts):
    return [np.concatenate(c) for c in zip(*windows.contexts(texts))]


def test_whole_characters_stay_text(spark):
    rows = [(i, "é" * 30 + c * 30, None) for i, c in enumerate("üö")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sd.remove_repeats(docs, length=41, anchor=20, whole_characters=True).collect()
    for r in out:
        bytes(r["kept"]).decode()


def test_whole_table(spark, small_dir):
    rows = QUERIES["op5_suffix_dedup"](spark, small_dir).collect()
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    texts = [(d["text"] or "").encode() for d in docs]
    want = {}
    for d, t, m in zip(docs, texts, brute(texts, 400)):
        kept = bytes(np.frombuffer(t, np.uint8)[~m])
        want[d["doc_id"]] = (len(t), int(m.sum()), runs(m), hashlib.sha256(kept).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
    assert any(v[1] for v in want.values())
