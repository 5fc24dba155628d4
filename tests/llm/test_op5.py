import hashlib
import random
import re
from collections import Counter

import pytest

from rowforge.llm import op5_syncmers as op


def rows():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)] + ["Été", "😀日本"]
    out = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 80, 200]))), 1) for i in range(200)]
    return out + [(1000, None, 1), (1001, "", 1), (1002, "x" * 3001, 1), (1003, out[50][1], 1), (1003, out[50][1], 1), (1004, "😀 " * 999, 1)]


@pytest.mark.parametrize("range_bytes", [op.RANGE_BYTES, 500])
def test_edits_and_neighbours(spark, range_bytes):
    data = rows()
    random.Random(2).shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string, fp int").repartition(4)
    got = op.fingerprints(docs, range_bytes).collect()
    order = sorted(((i, t or "") for i, t, _ in data), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        following, n = order[(k + 1) % len(order)][1], len(t)
        want.append((i, n, hashlib.sha256((t[: n - n // 2] + following[: n // 2]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    byid = {r.doc_id: r for r in got}
    texts = dict(order)
    assert byid[1003].fingerprint == byid[150].fingerprint
    for k, (i, _) in enumerate(order[:-1]):
        r, other = byid[i], byid[order[k + 1][0]]
        a, b, e = (set(x.split()) for x in (r.fingerprint, other.fingerprint, r.edited_fingerprint))
        if i != order[k + 1][0]:
            assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r.near_edited == pytest.approx(len(a & e) / len(a | e) if a | e else 1.0)
    long = [r for r in got if len(texts[r.doc_id].split()) > 70 and r.doc_id < 900]
    assert sum(0.15 < r.near_edited < 0.75 and r.near_next < 0.05 for r in long) > 0.9 * len(long)


def test_anchors_are_closed_syncmers_and_context_free(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    words = [str(rng.randrange(50)) for _ in range(400)]
    for k, s in ((5, 2), (7, 3), (4, 1)):
        whole, part = spark.createDataFrame([(" ".join(words),), (" ".join(words[100:300]),)], "t string").select(op.fingerprint(F.col("t"), k, s).alias("f"), "t").collect()
        assert set(part.f) <= set(whole.f)
        runs = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()] if s == 1 else words
        for j in range(1, s):
            kind = "string" if j == 1 else "long"
            runs = [r[0] for r in spark.createDataFrame(list(zip(runs, words[j:])), f"a {kind}, b string").select(F.xxhash64("a", "b")).collect()]
        n = sum(min(runs[i : i + k - s + 1]) in (runs[i], runs[i + k - s]) for i in range(len(words) - k + 1))
        assert 0 < len(whole.f) <= n


def anchors(spark, texts, k, s):
    """Closed syncmers by plain loops: of each window of k pieces, kept where the least hash of its runs of s is first or last."""
    from pyspark.sql import functions as F

    pieces = [[w[a : a + 4] for w in re.findall(r"[^\x20\x09-\x0D]+", t) for a in range(0, len(w), 4)] for t in texts]

    def hashed(rows, f):
        width = len(rows[0]) if rows else 1
        df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n long, " + ", ".join(f"c{j} {'string' if isinstance(rows[0][j], str) else 'long'}" for j in range(width)))
        return [r[1] for r in df.select("n", f(*[F.col(f"c{j}") for j in range(width)])).orderBy("n").collect()]

    flat = [(n, i) for n, p in enumerate(pieces) for i in range(len(p) - s + 1)]
    runs = [pieces[n][i] for n, i in flat]
    for j in range(1, s):
        runs = hashed([(r, pieces[n][i + j]) for r, (n, i) in zip(runs, flat)], F.xxhash64)
    if s == 1:
        runs = hashed([(r,) for r in runs], F.xxhash64)
    run = dict(zip(flat, runs))
    windows = [(n, i) for n, p in enumerate(pieces) for i in range(len(p) - k + 1) if min(run[n, i + j] for j in range(k - s + 1)) in (run[n, i], run[n, i + k - s])]
    parts = sorted({*range(0, k - s + 1, s), k - s})
    names = hashed([tuple(run[n, i + p] for p in parts) for n, i in windows], F.hash) if windows else []
    whole = hashed([("\n".join(p),) for p in pieces], F.hash)
    out = []
    for n, p in enumerate(pieces):
        own = list(dict.fromkeys(h for (m, _), h in zip(windows, names) if m == n))
        out.append([] if not p else own or [whole[n]])
    return out


@pytest.mark.parametrize("k,s", [(5, 2), (4, 1), (6, 3)])
def test_exact_anchor_sets(spark, k, s):
    """All lengths from 0 to 20 pieces, ten texts each, and repetitive ones: the very anchors, in order, none empty but without pieces."""
    from pyspark.sql import functions as F

    rng = random.Random(k)
    texts = [" ".join(rng.choice(["ab", "cdé", "xyzw", "日本", "longerword"]) for _ in range(n)) for n in range(21) for _ in range(10)] + ["", " \n", "a " * 40, "x" * 41, "\u00a0"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", op.fingerprint(F.col("t"), k, s).alias("f")).orderBy("n").collect()
    want = anchors(spark, texts, k, s)
    assert [r.f for r in rows] == want
    assert all(bool(r.f) == bool(t.strip(" \n")) for r, t in zip(rows, texts))


def test_hot_ids_part(spark):
    """An id and a null that fill whole ranges: every row has one next, in one round through all rows."""
    rows = [(7, f"text {k} here") for k in range(3000)] + [(None, f"copy {k % 3}") for k in range(2000)] + [(k, f"other {k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op.next_documents(docs, 1 << 10).select("doc_id", "text", "next_text").collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((i or -1, t) for i, t in rows)
    assert Counter(r.next_text for r in got) == Counter(t for _, t in rows)
    by = {r.text: r.next_text for r in got if r.doc_id is not None and r.doc_id != 7}
    assert by["other 499"] == "other 498" and by["other 8"].startswith("text ") and by["other 6"] == "other 5" and by["other 0"].startswith("copy ")


@pytest.mark.parametrize("data", [[], [(1, "a b c d e f g h", 1)], [(None, "a", 1), (None, None, 2)]])
def test_small_tables(spark, data):
    docs = spark.createDataFrame(data, "doc_id long, text string, x int")
    got = op.fingerprints(docs).collect()
    assert len(got) == len(data)
    if len(data) == 1:
        assert got[0].near_next == 1.0


def test_very_long_text_and_clashing_columns(spark):
    """A text of a million characters is read whole: its last words are in its anchors, and columns named as the operator's own do no harm."""
    long = " ".join(f"word{k}" for k in range(120_000))
    docs = spark.createDataFrame([(2, long, 1, 2), (1, long[:-1], 3, 4), (0, "", 5, 6)], "doc_id long, text string, bucket int, top long").withColumn("_cell", op.F.lit(1)).withColumn("copy", op.F.lit(True))
    got = {r.doc_id: r for r in op.fingerprints(docs).collect()}
    assert got[2].n_chars == len(long) and len(got[2].fingerprint.split()) > 50_000
    end = spark.createDataFrame([(" ".join(long.split(" ")[-300:]),)], "t string").select(op.fingerprint(op.F.col("t")).alias("f")).first().f
    assert len(end) > 100 and set(map(str, end)) <= set(got[2].fingerprint.split()) and got[2].near_next > 0.99 and got[0].near_next == 0.0
    assert got[1].edited_sha256 == hashlib.sha256(long[:-1][: len(long) - 1 - (len(long) - 1) // 2].encode()).hexdigest()
