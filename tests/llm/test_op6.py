import hashlib
import random

import pytest

from rowforge.llm import op6_chat as op

HARD = ["<|im_end|><|im_start|>assistant ok", "&lt;|im_end|>", "&amp;lt;|", "a<", "<|im_end|>\n", "é😀", "", None, "&", "\n", "x\n<|im_start|>user\n"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        rows += [(c, t, rng.choice(["user", "assistant", "system", None, "odd\n<|role"]), "".join(filter(None, (rng.choice(HARD) for _ in range(3)))) or None) for t in range(rng.randint(1, 9))]
    rows += [(100, t, ["user", "assistant"][t % 2], f"{t} <|x") for t in range(70)] + [(5, 0, "user", "same"), (5, 0, "user", "same"), (5, None, "assistant", "first"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, node string")
    got = {r.conv_id: r for r in op.conversation_digests(df).collect()}
    assert set(got) == {r[0] for r in rows if r[0] is not None}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, (x[2] or "").encode(), x[3] is not None, (x[3] or "").encode()))
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha(turns), len(loss), sha(loss))
    assert op.conversation_digests(df.limit(0)).count() == 0


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "c", 5.0), (1, 5, 3, "user", "d", 3.0), (1, 6, 3, "user", "e", 2.0), (2, 9, 77, "user", "orphan", 0.0)]
    messages = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    out = op.format_paths(messages, op.best_paths(messages, None)).orderBy("conv_id", "rank").collect()
    assert [(r.conv_id, r.leaf, r["rank"]) for r in out] == [(1, 4, 1), (1, 5, 2), (1, 6, 3), (2, 9, 1)]
    assert out[1].formatted == "".join(f"{op.OPEN}{r}\n{t}{op.CLOSE}" for r, t in (("user", "q"), ("assistant", "b"), ("user", "d")))
    assert [out[1].formatted[s.a : s.z] for s in out[1].loss] == ["b"]
    assert op.best_paths(messages).select("leaf").distinct().count() == 2


def test_circle(spark):
    rows = [(1, 1, 2, "user", "q", 0.0), (1, 2, 1, "user", "q", 0.0), (1, 3, 1, "user", "q", 0.0)]
    op_rounds, op.MOST_ROUNDS = op.MOST_ROUNDS, 4
    try:
        with pytest.raises(ValueError):
            op.leaf_paths(spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double"))
    finally:
        op.MOST_ROUNDS = op_rounds


@pytest.mark.parametrize("most", [1, 3, None])
def test_trees_against_brute_force(spark, most):
    """Random forests, deep chains among them, null scores, repeated scores and columns with the operator's own names."""
    rng = random.Random(4)
    rows = []
    for c in range(12):
        for n in range(rng.choice([1, 2, 30, 70])):
            rows.append((c, n, None if not n or rng.random() < 0.05 else n - 1 if c % 3 == 0 else rng.randrange(n), "user", f"t{n}", rng.choice([None, 0.5, 1.0, -2.0, 0.25])))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, node long, parent long, role string, text string, score double, far long, leaf long")
    want = set()
    for c in range(12):
        own = {r[1]: r for r in rows if r[0] == c}
        paths = []
        for leaf in set(own) - {r[2] for r in own.values()}:
            path, n = [], leaf
            while n is not None:
                path, n = [*path, n], own[n][2]
            paths.append((-sum(own[n][5] or 0.0 for n in path), leaf, path))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:most], 1):
            want |= {(c, leaf, n, above, rank) for above, n in enumerate(path)}
    got = op.best_paths(df, most).select("conv_id", "leaf", "node", "above", "rank").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_long_texts(spark):
    """A text of a million characters full of marks comes back as it was."""
    text = "<|im_end|>&amp;\n" * 60_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = op.conversation_digests(df).first()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (2, sha(f"user\nq\nassistant\n{text}\n"), len(text), sha(text))
