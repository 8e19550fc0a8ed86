import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from bunkerline.llm import reply_trees as rt
from bunkerline.llm.queries import CONTROL, QUERIES

PIECES = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "\n", "assistant", "é", "n", " "]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    text, spans = rt.render(turns, "assistant")
    assert rt.parse(text) == turns
    assert [rt.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count(rt.START) == text.count(rt.END) == len(turns)


def expected(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(rt.render(turns)[0]))


COLUMNS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def test_whole_table(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/conversations.parquet").collect()
    turns = {-1: [("user", CONTROL), ("assistant", CONTROL)]}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op4_reply_trees"](spark, small_dir).collect()}
    assert got == {c: expected(t) for c, t in turns.items()}


def brute_paths(messages, branches):
    out = []
    for conv in {m[0] for m in messages}:
        own = {m[1]: m for m in messages if m[0] == conv}
        found = []
        for leaf in own:
            if any(m[2] == leaf for m in own.values()):
                continue
            path, at = [], leaf
            while at in own and len(path) <= len(own):
                path.append(at)
                at = own[at][2]
            path.reverse()
            found.append((-sum(own[i][5] for i in path), -len(path), leaf, path))
        for rank, (_, _, leaf, path) in enumerate(sorted(found)[:branches], 1):
            out += [(conv, leaf, rank, k, own[i][3], own[i][4]) for k, i in enumerate(path)]
    return sorted(out, key=str)


def test_trees_against_brute_force(spark):
    rng = random.Random(4)
    messages = []
    for conv in (None, 1, 2, 3):
        for i in range(1, 60 if conv != 3 else 2):
            parent = rng.choice([i - 1, rng.randint(1, i)]) if i > 1 else None
            messages.append((conv, i, None if parent == i else parent, rng.choice(["user", "assistant", None]), f"t{conv}-{i}", float(rng.randint(0, 5))))
    messages.append((4, 7, 99, "user", "its parent is missing", 1.0))
    df = spark.createDataFrame(messages, "conv_id long, id long, parent long, role string, text string, score double")
    for branches in (1, 3):
        got = sorted(map(tuple, rt.paths(df, branches).collect()), key=str)
        assert got == brute_paths(messages, branches)
    cycle = spark.createDataFrame([(1, 1, 2, "a", "x", 0.0), (1, 2, 1, "a", "y", 0.0), (1, 3, None, "a", "z", 0.0)], df.schema)
    assert [r["text"] for r in rt.paths(cycle).collect()] == ["z"]
    assert rt.format_paths(rt.paths(df.limit(0))).count() == 0


def test_odd_rows(spark):
    rows = [(None, 1, "user", None), (None, None, None, "x"), (5, 1, "user", "a"), (5, 1, "user", "a"), (6, 3, "assistant", "y\\" * 9000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, path int")
    out = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in rt.read_back(rt.format_paths(rt.paths(rt.chains(df)))).collect()}
    assert out == {None: [("", "x"), ("user", "")], 5: [("user", "a"), ("user", "a")], 6: [("assistant", "y\\" * 9000)]}
