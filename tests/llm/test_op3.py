import random
import zlib
from collections import Counter

import pytest

from rowforge.llm import op3_kdtree as op


def rows(n, seed=0, hot=0.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "hot " * 20 if rng.random() < hot else "é" * rng.choice([0, 5, 50, rng.randint(1, 900)]) + str(rng.randrange(n // 2))
        out.append((i, None if rng.random() < 0.02 else text, rng.choice(["src0"] * 5 + ["src1", "src2", None]), rng.choice(["en", "fr"]), len(text), "x"))
    return out


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_law_slots_and_groups(spark, hot):
    data = rows(3000, 1, hot) + rows(3000, 1, hot)[:2] + [(None, "no id", "src1", "en", None, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long, shard string")
    got = op.kd_shards(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    sizes, shards = Counter(), {}
    for r in got:
        sizes[r.shard] += r["size"]
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) < 1.03 * sum(sizes.values()) / 8 and min(sizes.values()) > 0.97 * sum(sizes.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    where, weight = {}, Counter()
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
        weight[r.text_crc32] += r["size"]
    assert all(len(s) == 1 for c, s in where.items() if weight[c] <= 0.05 * sum(sizes.values()) / 8)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    docs = spark.createDataFrame(rows(n + 2)[:n], "doc_id long, text string, source string, lang string, n_chars long, x string")
    got = op.kd_shards(docs).collect()
    assert len(got) == n and all(0 <= r.shard < 8 for r in got)


def test_equal_rows_part(spark):
    docs = spark.createDataFrame([(i, "same", "s", "en", 4) for i in range(800)], "doc_id long, text string, source string, lang string, n_chars long")
    sizes = Counter(r.shard for r in op.kd_shards(docs).collect())
    assert len(sizes) == 8 and max(sizes.values()) <= 110


def test_large_groups_stay_whole(spark):
    """Groups of copies of a tenth to nine tenths of a shard's target stay together, and sizes are near equal all the same."""
    rng = random.Random(3)
    data = [(i, "é" * rng.randint(1, 400) + str(i), "s", "en") for i in range(6000)]
    total = sum(len(t.encode()) + 1 for _, t, *_ in data)
    for g, part in enumerate((0.1, 0.3, 0.5, 0.7, 0.9)):
        text = f"group {g} " * 20
        data += [(10_000 + 5000 * g + k, text, "s", "en") for k in range(int(part * total / 8 / len(text)))]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    got, texts = op.kd_shards(docs).collect(), {i: t for i, t, *_ in data}
    sizes, where = Counter(), {}
    for r in got:
        sizes[r.shard] += r["size"]
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert max(sizes.values()) < 1.03 * sum(sizes.values()) / 8 and min(sizes.values()) > 0.97 * sum(sizes.values()) / 8


def test_target_bytes_and_clashing_columns(spark):
    """As many shards as the target asks for; a very long text, nulls, and columns with the operator's own names."""
    data = [(i, "x" * 99, 1, 2.0, 3) for i in range(1000)] + [(2000, "y" * 100_000, 1, 2.0, 3), (2001, None, None, None, None)]
    docs = spark.createDataFrame([(i, f"{t}{i}" if t and i < 1000 else t, *r) for i, t, *r in data], "doc_id long, text string, node int, x0 double, copy int")
    got = op.kd_shards(docs, target_bytes=25_000).collect()
    total = sum(r["size"] for r in got)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert len(got) == len(data) and max(sizes) <= -(-total // 25_000) - 1
    assert sum(100_000 < v for v in sizes.values()) == 1 and sorted(sizes.values())[-2] <= 52_000
    assert {r["size"] for r in got if r.doc_id == 2001} == {1}
