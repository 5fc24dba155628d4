"""Severity grades of toxicity by cumulative-link ordinal regression on sparse text features.

Grades come from a labelled table: 0 where it says not toxic, 1 where toxic, 2 where toxic and of low quality.
P(grade <= j) = sigmoid(theta_j - w.x), with one weight vector shared by all ordered thresholds theta.  Features are
telling words and beginnings of words (4, 5 and 6 bytes), each text's divided by how many it has: how telling they are on the
average; and, in texts that have any, marks of how many there are and of the text's shape (steps of the shares of distinct
words, signs, capitals and distinct lines), which part the severe from the others.  Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z folded, told apart by
48 bits of a hash.

The model is fitted on at most `train_rows` labelled documents with `train_features` features in all, those least by a hash
of doc_id (documented bounds); it has at most `max_features` weights, so what is sent to executors is bounded.  Every
document is then scored over its whole text in one map without a shuffle.

Defined cases: null or empty texts have no feature and get the base rate, and no text without a telling word is
called toxic, whatever that rate; labels that are null are ignored, and
of several labels of a document the most severe counts; of several rows with one labelled id, the one whose features
are least is fitted on; without labels, or with one grade only, the thresholds
are those of the smoothed base rates; repeated rows are scored each; very long texts are read whole; other columns are
ignored by grade_documents and kept as they are, whatever their names, by drop_toxic; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from rowforge.llm.grouping import batches_of, give_back, shielded, tidy
from rowforge.llm.wordhash import feature_sets
from rowforge.sources.staging import scope, stage

TRAIN_ROWS, TRAIN_FEATURES, MAX_FEATURES, GRADES, CHANCE, LEAST, MARKS = 6_000, 1 << 23, 2_000, 3, 1.0, 3, 80  # marks: 64 of shape, 16 of counts
MARK_BASE = np.uint64(1 << 60)
Features = tuple[np.ndarray, np.ndarray]


def joined_features(words: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A text's features in one ascending array: marks of shape come after the 48 bits of the others."""
    return np.concatenate((words, marks + MARK_BASE))


@dataclass
class OrdinalModel:
    """hashes: ascending features; weights: theirs; thresholds: ascending, one fewer than grades; marks: a weight for each mark of shape."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    marks: np.ndarray = field(default_factory=lambda: np.zeros(MARKS))

    def scores(self, sets: list[Features]) -> np.ndarray:
        """w.x of each text's features, summed text by text: the same text scores the same anywhere."""
        return self.told(sets)[0]

    def told(self, sets: list[Features]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and how many telling features each text has."""
        sizes = np.array([len(s) for s, _ in sets], np.int64)
        if not len(self.hashes) or not sizes.sum():
            return np.zeros(len(sets)), np.zeros(len(sets), np.int64)
        flat = np.concatenate([s for s, _ in sets])
        at = np.minimum(np.searchsorted(self.hashes, flat), len(self.hashes) - 1)
        hit = self.hashes[at] == flat
        rows = np.repeat(np.arange(len(sets)), sizes)[hit]
        n = np.bincount(rows, minlength=len(sets))
        shape = np.array([self.marks[m.astype(np.int64)].sum() for _, m in sets]) + self.marks[_count_marks(n)]
        return np.bincount(rows, self.weights[at[hit]], len(sets)) / np.maximum(1, n) + shape * (n > 0), n

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - scores[:, None], -40, 40)))


def _count_marks(n: np.ndarray) -> np.ndarray:
    """The mark of how many telling features a text has, by powers of the root of two."""
    return 64 + np.minimum(15, np.floor(2 * np.log2(np.maximum(1, n)))).astype(np.int64)


def severity(labels: DataFrame) -> DataFrame:
    """doc_id, grade of the labelled documents."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))


def telling(words: np.ndarray, joint: np.ndarray, totals: np.ndarray, max_features: int = MAX_FEATURES) -> np.ndarray:
    """Ascending features that tell graded from ungraded documents best by likelihood ratio, of those more frequent in graded ones,
    down to where chance would give CHANCE such features among all that are tested; the bound does not depend on the best
    one's.  joint: how many documents of each grade have a feature; totals: how many there are."""
    n, bad, seen = totals.sum(), joint[:, 1:].sum(1), joint.sum(1)
    tested = (seen >= LEAST) & (words < MARK_BASE)  # marks of shape are no words
    share = totals[1:].sum() / max(1, n)
    if not 0 < share < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.nan_to_num(bad * np.log(bad / seen / share)) + np.nan_to_num((seen - bad) * np.log((1 - bad / seen) / (1 - share))))
    bound = NormalDist().inv_cdf(1 - min(0.5, CHANCE / max(1, tested.sum())) / 2) ** 2  # of chi-square with one degree
    rank = np.where(tested & (gain >= bound) & (bad > share * seen), gain, -1)
    chosen = np.lexsort((words, -rank))[:max_features]
    return np.sort(words[chosen[rank[chosen] > 0]])


def counted(grades: np.ndarray, sets: list[np.ndarray], n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """All features, ascending, and how many documents of each grade have them."""
    flat, rows = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    words, at = np.unique(flat, return_inverse=True)
    return words, np.stack([np.bincount(at, grades[rows] == k, len(words)) for k in range(n_grades)], 1).astype(np.int64)


def fit(grades: np.ndarray, sets: list[Features], n_grades: int = GRADES, max_features: int = MAX_FEATURES, steps: int = 500, penalty: float = 1e-5, mark_penalty: float = 1e-4, chosen: np.ndarray | None = None) -> OrdinalModel:
    """Thresholds and shared weights by gradient steps on the penalised likelihood, over chosen features (None: the telling ones)."""
    n = len(grades)
    if chosen is None:
        chosen = telling(*counted(grades, [s for s, _ in sets], n_grades), np.bincount(grades, minlength=n_grades), max_features)
    rates = np.array([(np.sum(grades >= j) + 0.5) / (n + 1) for j in range(1, n_grades)])
    base = np.log1p(-rates) - np.log(rates)
    base = np.maximum.accumulate(base + 1e-3 * np.arange(len(base)))
    if not len(chosen):
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), base)
    flat, rows = np.concatenate([s for s, _ in sets]), np.repeat(np.arange(n), [len(s) for s, _ in sets])
    c = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
    used = chosen[c] == flat
    r, c = rows[used], c[used]
    told = np.bincount(r, minlength=n)
    value = 1 / np.maximum(1, told)
    shaped = np.repeat(np.arange(n), [len(m) for _, m in sets])
    mark = np.concatenate([m for _, m in sets]).astype(np.int64)
    shaped, mark = np.append(shaped, np.arange(n)), np.append(mark, _count_marks(told))
    shaped, mark = shaped[told[shaped] > 0], mark[told[shaped] > 0]
    w, v, theta = np.zeros(len(chosen)), np.zeros(MARKS), base.copy()
    moment = square = np.zeros(len(w) + len(v) + len(theta))
    low, high, k = grades > 0, grades < n_grades - 1, np.arange(n)
    for t in range(1, steps + 1):
        x = np.bincount(r, w[c], n) * value + np.bincount(shaped, v[mark], n)
        below = 1 / (1 + np.exp(np.clip(x[:, None] - theta[None], -40, 40)))  # P(grade <= j)
        edge = np.concatenate((np.zeros((n, 1)), below, np.ones((n, 1))), 1)
        slope = np.concatenate((np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))), 1)
        mass = np.maximum(edge[k, grades + 1] - edge[k, grades], 1e-9)
        up, down = slope[k, grades + 1] / mass, slope[k, grades] / mass  # of the thresholds above and below
        g_theta = -np.array([(up * (grades == j)).sum() - (down * (grades == j + 1)).sum() for j in range(n_grades - 1)]) / n
        push = up * high - down * low
        g_w = np.bincount(c, (push * value)[r], len(w)) / n + penalty * w
        g_v = np.bincount(mark, push[shaped], MARKS) / n + mark_penalty * v
        step = np.concatenate((g_w, g_v, g_theta))
        moment, square = 0.9 * moment + 0.1 * step, 0.999 * square + 0.001 * step**2
        move = 0.1 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, v, theta = w - move[: len(w)], v - move[len(w) : -len(theta)], theta - move[-len(theta) :]
        theta = np.maximum.accumulate(theta + 1e-6 * np.arange(len(theta)))
    return OrdinalModel(chosen, w, theta, v)


@dataclass
class Training:
    """grades and sets of labelled documents in the order of a hash of their ids, with chosen features (and all marks) only;
    rest: which of them were held out of the choice."""

    grades: np.ndarray
    sets: list[Features]
    chosen: np.ndarray
    rest: np.ndarray


def training_sets(docs: DataFrame, graded: DataFrame, choose: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], n_grades: int, train_rows: int = TRAIN_ROWS, train_features: int = TRAIN_FEATURES, hold_out: int = 0) -> Training:
    """At most train_rows labelled documents with train_features features in all; `graded` is cut to that many before it is broadcast.

    Texts with the same features count once, with their commonest grade: copies prove nothing twice.  Features are counted
    on the executors, by grade (marks of shape among them); `choose` is given those seen LEAST times or more, and only what it
    chooses comes to the driver.  hold_out: every so-manieth document is left out of the counts."""
    with scope():
        some = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches_of(batches):
                sets = list(feature_sets(batch.column(2)))
                n = pa.array([len(s) for s, _ in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, *(pa.array([s[k].tobytes() for s in sets], pa.binary()) for k in (0, 1))], names=["doc_id", "grade", "n", "words", "marks"])

        own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(some), "doc_id")
        found = own.select("doc_id", F.col("grade").cast("int").alias("grade"), "text").mapInArrow(tidy(extract), "doc_id long, grade int, n int, words binary, marks binary")
        rows = stage(found.groupBy("doc_id").agg(F.min(F.struct("n", "grade", "words", "marks")).alias("r")).select(F.xxhash64("doc_id").alias("place"), "doc_id", "r.*"))

        order = sorted(tuple(r) for r in rows.select("place", "doc_id", "n", "grade", F.xxhash64("words", "marks")).collect())
        order = order[: int(np.searchsorted(np.cumsum([r[2] for r in order]), train_features, "right"))]
        alike: dict[int, list[tuple]] = {}
        for r in order:
            alike.setdefault(r[4], []).append(r)
        held = [(same[0][1], int(np.bincount([r[3] for r in same]).argmax())) for same in alike.values()]
        grades = np.array([g for _, g in held], np.int64)
        rest = np.arange(len(held)) % hold_out == 0 if hold_out else np.zeros(len(held), bool)
        known = {doc_id: (k, g, bool(out)) for k, ((doc_id, g), out) in enumerate(zip(held, rest, strict=True))}  # at most train_rows

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches_of(batches):
                told = [known.get(i) for i in batch.column(0).to_pylist()]
                take = [k for k, t in enumerate(told) if t and not t[2]]
                parts = [joined_features(*(np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (1, 2))) for k in take]
                words, joint = counted(np.array([told[k][1] for k in take], np.int64), parts, n_grades)
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), *(pa.array(joint[:, j]) for j in range(n_grades))], names=["word", *(f"g{j}" for j in range(n_grades))])

        sums = rows.select("doc_id", "words", "marks").mapInArrow(tidy(count), "word long, " + ", ".join(f"g{j} long" for j in range(n_grades)))
        sums = sums.groupBy("word").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(n_grades)])
        often = sums.where(" + ".join(f"g{j}" for j in range(n_grades)) + f" >= {LEAST}").toArrow()
        words = np.asarray(often.column(0)).astype(np.uint64)
        joint = np.stack([np.asarray(often.column(1 + j)) for j in range(n_grades)], 1) if len(words) else np.zeros((0, n_grades), np.int64)
        chosen = choose(words, joint, np.bincount(grades[~rest], minlength=n_grades))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches_of(batches):
                told = [known.get(i) for i in batch.column(0).to_pylist()]
                take = [k for k, t in enumerate(told) if t]
                sets = [np.frombuffer(batch.column(1)[k].as_py(), np.uint64) for k in take]
                yield pa.RecordBatch.from_arrays([pa.array([told[k][0] for k in take], pa.int32()), pa.array([s[np.isin(s, chosen)].tobytes() for s in sets], pa.binary()), batch.column(2).take(pa.array(take, pa.int64()))], names=["k", "words", "marks"])

        sets: list = [None] * len(held)
        for r in rows.select("doc_id", "words", "marks").mapInArrow(tidy(keep), "k int, words binary, marks binary").collect():
            sets[r.k] = (np.frombuffer(r.words, np.uint64), np.frombuffer(r.marks, np.uint64))
        return Training(grades, sets, chosen, rest)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """A model of the labelled documents' severity."""
    own = training_sets(docs, severity(labels), lambda *known: telling(*known, max_features), GRADES, train_rows)
    model = fit(own.grades, own.sets, chosen=own.chosen)
    give_back()
    return model


def score(docs: DataFrame, model: OrdinalModel, cutoff: float = 0.5) -> DataFrame:
    """All columns of docs, and _p1, _p2 (P of grade 1, 2 or more), _severity (expected grade), _toxic (p1 >= cutoff)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            scores, n = model.told(list(feature_sets(batch.column(batch.schema.get_field_index("text")))))
            p = model.exceed(scores)
            extra = [pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p.sum(1)), pa.array((p[:, 0] >= cutoff) & (n > 0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "_p1", "_p2", "_severity", "_toxic"])

    extra = [StructField("_p1", DoubleType()), StructField("_p2", DoubleType()), StructField("_severity", DoubleType()), StructField("_toxic", BooleanType())]
    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, *extra]))


def grade_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cutoff: float = 0.5) -> DataFrame:
    """doc_id, toxic (0/1), grade (the likeliest), expected_severity, p_toxic, p_severe of every row."""
    model = train(docs, labels, train_rows)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    grade = F.when(1 - F.col("_p1") >= F.greatest(F.col("_p1") - F.col("_p2"), F.col("_p2")), 0).when(F.col("_p1") - F.col("_p2") >= F.col("_p2"), 1).otherwise(2)
    return score(own, model, cutoff).select("doc_id", F.col("_toxic").cast("int").alias("toxic"), grade.alias("grade"), F.col("_severity").alias("expected_severity"), F.col("_p1").alias("p_toxic"), F.col("_p2").alias("p_severe"))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cutoff: float = 0.5) -> DataFrame:
    """The rows that are not toxic, with the columns of docs."""
    docs, named = shielded(docs, "doc_id", "text")
    return named(score(docs, train(docs, labels, train_rows), cutoff).where("not _toxic").drop("_p1", "_p2", "_severity", "_toxic"))
