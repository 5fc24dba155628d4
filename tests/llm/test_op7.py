import random
import re

import numpy as np
import pytest

from rowforge.llm import op7_jaccard as op
from rowforge.llm.wordhash import shingle_sets


def gram_set(text, words):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[k : k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else {tuple(own)} if own else set()


def brute(rows, words, percent):
    sets = [gram_set(t, words) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    out = []
    for k, (i, _) in enumerate(rows):
        own = [r[0] for x, r in zip(label, rows) if x == label[k] and r[0] is not None]
        out.append((i, len(sets[k]), min(own) if own and sets[k] else i))
    return sorted(out, key=str)


def corpus(seed, n=140):
    rng, vocabulary = random.Random(seed), [f"w{k}" for k in range(60)] + ["Été", "日本", "The"]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.6:
            own = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text = " ".join(own)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 10, 30, 60, 120])))
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (3, rows[3][1]), (3, rows[3][1]), (None, "lone row here is"), (None, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent,options", [(3, 90, {}), (5, 80, {}), (3, 90, {"block_sets": 3, "filter_bits": 12})])
def test_against_brute_force(spark, words, percent, options):
    rows = corpus(words)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(5)
    assert sorted(map(tuple, op.near_groups(df, words, percent, **options).collect()), key=str) == brute(rows, words, percent)


def test_many_near_copies_in_blocks(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(80)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, op.near_groups(df, 3, 90, block_sets=16).collect()), key=str) == brute(rows, 3, 90)


def test_one_of_each_stays(spark):
    rows = corpus(9)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _key string").withColumn("_text_key", op.F.lit(1))
    kept = op.keep_one_of_each(df, 5, 80)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r["_key"] for r in kept.collect()} == {"x"}
    groups = {c for i, n, c in brute(rows, 5, 80) if n and c is not None}
    assert {i for i, t in got if gram_set(t, 5) and i is not None} == groups
    assert len([1 for i, t in got if not gram_set(t, 5)]) == 3
    assert len(got) == len(set(got))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_groups(df).count() == 0 and op.keep_one_of_each(df).count() == 0


def test_sets_are_exact():
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice(["A", "a", "b", " ", "\t", "é", "\x1c", "\n", "　"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, ""]
    for words in (1, 3):
        got = list(shingle_sets(pa.array(texts), words))
        want = [gram_set(t, words) for t in texts]
        assert [len(g) for g in got] == [len(w) for w in want]
        for a in range(0, 100, 7):
            for b in range(100):
                assert len(np.intersect1d(got[a], got[b])) == len(want[a] & want[b])


def test_near_copies_are_found(spark):
    """Of pairs with some words changed, exactly those of 0.8 or more are joined; recall on lightly edited copies is whole."""
    rng = random.Random(11)
    rows, linked = [], 0
    for k in range(120):
        own = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(own)
        for _ in range(k % 12):
            other[rng.randrange(200)] = f"x{rng.randrange(5000)}"
        a, b = gram_set(" ".join(own), 5), gram_set(" ".join(other), 5)
        linked += 100 * len(a & b) >= 80 * len(a | b)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in op.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(120)) == linked > 50
    assert all(got[2 * k + 1] == 2 * k for k in range(120) if k % 12 < 4)


def test_groups_that_meet_in_a_few_sets(spark):
    """Chains of families: most sets are linked to their hubs, and the links between such groups are found all the same."""
    rng = random.Random(12)
    rows, base = [], [f"b{k}" for k in range(90)]
    for step in range(12):  # each group is a little further from the first
        base = [w if rng.random() > 0.03 else f"s{step}_{k}" for k, w in enumerate(base)]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(90)] = f"x{rng.randrange(30)}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (96, 5):
        assert sorted(map(tuple, op.near_groups(df, 3, 80, block_sets=size).collect()), key=str) == brute(rows, 3, 80)


def test_one_id_for_unlike_texts_and_long_ones(spark):
    """Rows with one doc_id and unrelated texts both stay; very long copies are one group; clashing columns are kept."""
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, "one text of a few words here"), (1, "quite another thing that is said"), (2, long), (3, f"{long} end"), (4, None)]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, root long, sid long")
    kept = op.keep_one_of_each(df)
    assert sorted((r.doc_id, (r.text or "")[:5], r.root, r.sid) for r in kept.collect()) == [(1, "one t", 7, 8), (1, "quite", 7, 8), (2, "w0 w1", 7, 8), (4, "", 7, 8)]
    assert {r.doc_id: r.component_id for r in op.near_groups(df).collect()}[3] == 2


def test_copies_send_no_elements(spark, monkeypatch):
    """Exact copies, rows repeated whole among them, are no evidence of n-grams shared with other texts: nothing of them is written."""
    rng, sent = random.Random(13), []
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(50)) for _ in range(12)]
    rows = [(k % 100, texts[k % 12]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)

    def noted(frame, keep=False, real=op.stage):
        out = real(frame, keep)
        if "elements" in out.columns:
            sent.append(out.where("elements is not null").count())
        return out

    monkeypatch.setattr(op, "stage", noted)
    got = {(r.n_shingles, r.component_id) for r in op.near_groups(df, 3, 90).collect()}
    assert got == {(48, min(i for i, t in rows if t == text)) for text in texts}
    assert sent and set(sent) == {0}


def test_batches_are_small_and_the_setting_stays(spark, monkeypatch, tmp_path):
    """What goes to Python at once is some hundred rows, not a task's whole partition; the session's own settings hold after, and lower ones inside."""

    def noted(make):
        def made(*a, **k):
            run = make(*a, **k)

            def wrapped(batches):
                def seen():
                    for batch in batches:
                        (tmp_path / f"{batch.num_rows}").touch()
                        yield batch

                yield from run(seen())

            return wrapped

        return made

    for name in ("_counted", "_sets"):
        monkeypatch.setattr(op, name, noted(getattr(op, name)))
    rows, key = [(k, f"a{k} b{k} c{k} d{k}") for k in range(3000)], "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    given, most = dict(spark.conf.getAll), spark.conf.get(key)
    assert op.near_groups(df, 3, 90).where("component_id = doc_id").count() == 3000
    assert dict(spark.conf.getAll) == given and spark.conf.get(key) == most
    assert 100 < max(int(p.name) for p in tmp_path.iterdir()) <= 500
    for p in tmp_path.iterdir():
        p.unlink()
    spark.conf.set(key, "70")
    try:
        assert op.near_groups(df, 3, 90).count() == 3000 and spark.conf.get(key) == "70"
    finally:
        spark.conf.unset(key)
    assert max(int(p.name) for p in tmp_path.iterdir()) == 70
