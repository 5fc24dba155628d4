"""Mixing documents to target domain weights by soft membership.

A classifier trained on a labelled table gives each document posteriors over domains.  Each document i then has
a vector a_i = tokens_i * posteriors_i of expected domain tokens, and rates r_i >= 0 (expected copies) are fitted
so that sum_i r_i a_i comes near the target tokens of every domain: least squares with a weak pull towards a
rate of one, within bounds.

At the optimum a rate is 1 - (p_i . g) / pull within bounds, where p_i are the posteriors and g, one number a domain,
is what the totals are off by.  So g is sought: it minimises the smooth convex dual, by Newton's method.  A step is
one pass over the staged posteriors that takes the dual, its gradient and its curvature at several step lengths at
once; no per-document state is kept or sent.  Steps go on until the gradient vanishes.

The classifier is a multinomial logistic regression on telling words, beginnings of words and marks of the text's shape
(the features of op4, from as bounded a number of rows: the labelled documents least by a hash).  A fifth of the labelled
documents are held out, and the scores are divided by the temperature that makes their labels likeliest, so that posteriors
are as sure as they are right.  Posteriors, tokens and rates cover all documents.

Targets may be out of reach within the bounds: then the totals come as near as they can.  Mixture tells goal and reached
totals, and `tolerance` makes a miss of more than that share of a domain's goal an error.

Defined cases: a null or empty text has no tokens, the prior's posteriors, and keeps the rate one within bounds;
without labels all posteriors are equal; null labels are ignored; a domain that no token is expected in cannot
be raised; repeated rows are documents of their own; very long texts are read whole; mixing_rates ignores other columns,
and mix_documents keeps them whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from rowforge.llm.grouping import batches_of, give_back, shielded, tidy
from rowforge.llm.op4_toxicity import Features, counted, joined_features, training_sets
from rowforge.llm.wordhash import feature_sets, text_blocks, word_hashes
from rowforge.sources.staging import release, stage

DOMAINS = ("good", "poor", "toxic")
TRAIN_ROWS, MAX_FEATURES, STEPS, PULL = 6_000, 4_000, 200, 1e-5
LENGTHS, EXACT = 0.25 ** np.arange(12), 1e-8


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and grade (the domain's number) of labelled documents: toxic, else good or poor by quality; conflicts go to the highest."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    return labels.where("doc_id is not null and toxic is not null and quality is not null").groupBy("doc_id").agg(F.max(domain).alias("grade"))


def label_quality(labels: DataFrame) -> DataFrame:
    """doc_id and grade of labelled documents by quality alone: 0 good, 1 poor; conflicts go to poor."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("grade"))


def _joined_features(sets: list[Features]) -> list[np.ndarray]:
    return [joined_features(*own) for own in sets]


@dataclass
class DomainModel:
    """hashes: ascending features; weights: a row for each, a column for each domain; bias: log priors and offsets."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of domains' scores for each set of features."""
        x, sizes = np.tile(self.bias, (len(sets), 1)), np.array([len(s) for s in sets], np.int64)
        if len(self.hashes) and sizes.sum():
            flat = np.concatenate(sets)
            at = np.minimum(np.searchsorted(self.hashes, flat), len(self.hashes) - 1)
            hit = self.hashes[at] == flat
            rows = np.repeat(np.arange(len(sets)), sizes)[hit]
            for d in range(x.shape[1]):
                x[:, d] += np.bincount(rows, self.weights[at[hit], d], len(sets))
        return x

    def posteriors(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of domain probabilities for each set of features."""
        return _softmax(self.logits(sets) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def parting(words: np.ndarray, joint: np.ndarray, totals: np.ndarray, max_features: int = MAX_FEATURES, least: int = 5) -> np.ndarray:
    """Ascending features that tell domains apart best by likelihood ratio, beyond what chance gives among so many."""
    seen, prior = joint.sum(1), (totals + 1) / (totals.sum() + len(totals))
    if np.count_nonzero(totals) < 2:
        return np.zeros(0, np.uint64)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * np.nan_to_num(joint * np.log(joint / seen[:, None] / prior)).sum(1)
    rank = np.where(seen >= least, gain, -1)
    chosen = np.lexsort((words, -rank))[:max_features]
    return np.sort(words[chosen[rank[chosen] > 2 * np.log(max(2, np.sum(seen >= least))) + 4]])


def fit_domains(domains: np.ndarray, sets: list[np.ndarray], n_domains: int, steps: int = 300, penalty: float = 1e-4, chosen: np.ndarray | None = None) -> DomainModel:
    """Penalised multinomial regression over chosen features (None: the parting ones)."""
    n = len(domains)
    prior = (np.bincount(domains, minlength=n_domains) + 1) / (n + n_domains)
    if chosen is None:
        chosen = parting(*counted(domains, sets, n_domains), np.bincount(domains, minlength=n_domains))
    if not len(chosen):
        return DomainModel(np.zeros(0, np.uint64), np.zeros((0, n_domains)), np.log(prior))
    flat, rows = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    c = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
    used = chosen[c] == flat
    r, c = rows[used], c[used]
    truth = np.eye(n_domains)[domains]
    w, bias = np.zeros((len(chosen), n_domains)), np.log(prior)
    moment = square = np.zeros((len(chosen) + 1, n_domains))
    for t in range(1, steps + 1):
        off = (_softmax(bias + np.stack([np.bincount(r, w[c, d], n) for d in range(n_domains)], 1)) - truth) / n
        g = np.concatenate((np.stack([np.bincount(c, off[r, d], len(chosen)) for d in range(n_domains)], 1) + penalty * w, off.sum(0)[None]))
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g**2
        move = 0.1 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return DomainModel(chosen, w, bias)


TEMPERATURES = 2.0 ** (np.arange(-4, 17) / 4)


HOLD_OUT = 5


def fit_calibrated(domains: np.ndarray, sets: list[np.ndarray], n_domains: int, chosen: np.ndarray | None = None) -> DomainModel:
    """fit_domains on all but every fifth, with the temperature at which those labels are likeliest (1 without enough of them)."""
    rest = np.arange(len(domains)) % HOLD_OUT == 0  # the rows come in the order of a hash
    model = fit_domains(domains[~rest], [s for s, out in zip(sets, rest, strict=True) if not out], n_domains, chosen=chosen)
    if len(model.hashes) and rest.sum() >= 20:
        x, own = model.logits([s for s, out in zip(sets, rest, strict=True) if out]), domains[rest]
        model.temperature = min(TEMPERATURES, key=lambda t: -np.log(np.maximum(_softmax(x / t)[np.arange(len(own)), own], 1e-12)).sum())
    return model


def _trained(docs: DataFrame, labelled: DataFrame, n_domains: int, train_rows: int) -> DomainModel:
    own = training_sets(docs, labelled, parting, n_domains, train_rows, hold_out=HOLD_OUT)
    model = fit_calibrated(own.grades, _joined_features(own.sets), n_domains, own.chosen)
    give_back()
    return model


def memberships(docs: DataFrame, model: DomainModel, mix: Mixture | None = None) -> DataFrame:
    """All columns of docs, _tokens (words of the whole text) and _p (posteriors); with mix, _rate as well."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            text = batch.column(at)
            p = model.posteriors(_joined_features(list(feature_sets(text))))
            n = np.concatenate([np.zeros(0, np.int64), *(np.diff(word_hashes(data, offsets)[1]) for _, _, data, offsets in text_blocks(text))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
            rate = [] if mix is None else [pa.array(mix.rates(p * n[:, None]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), lists, *rate], names=[*batch.schema.names, "_tokens", "_p", *["_rate"] * len(rate)])

    more = [StructField("_tokens", LongType()), StructField("_p", ArrayType(DoubleType())), *([] if mix is None else [StructField("_rate", DoubleType())])]
    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, *more]))


@dataclass
class Mixture:
    """What the fit needs to give any document its rate."""

    low: float
    high: float
    pull: float
    off: np.ndarray  # what each domain's tokens are off by, as a share of all tokens
    targets: np.ndarray  # tokens
    reached: np.ndarray
    steps: int = 0
    still: float = np.inf  # the dual's gradient where the fit ended

    def rates(self, a: np.ndarray) -> np.ndarray:
        """Rates of documents with expected domain tokens a (a row each)."""
        size = a.sum(1)
        return self.at(a @ self.off * np.where(size > 0, 1 / np.maximum(size, 1e-300), 0))

    def at(self, s: np.ndarray) -> np.ndarray:
        """Rates by p . g."""
        return np.clip(1 - s / self.pull, self.low, self.high)


def fit_rates(rows: DataFrame, targets: list[float], budget: float, low: float = 0.0, high: float = 4.0, steps: int = STEPS, pull: float = PULL) -> Mixture:
    """Rates for rows with _tokens and _p (staged), whose domain totals come near targets (weights) times budget * all tokens.

    Ends where no entry of the dual's gradient exceeds EXACT (of all tokens); `steps` only guards against a fit that does not end, and is an error."""
    d, m = len(targets), 1 + len(targets) + len(targets) ** 2
    total = rows.agg(F.sum(F.col("_tokens").cast("double"))).first()[0] or 0.0
    goal = np.array(targets, float) / max(sum(targets), 1e-300) * budget * total
    mix = Mixture(low, high, pull, np.zeros(d), goal, np.zeros(d))
    if not total:
        return mix

    def sums(points: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """The dual, its gradient, its curvature and the totals reached at each point."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((len(points), m))
            for batch in batches:
                p, t = np.asarray(batch.column(1).flatten()).reshape(-1, d), np.asarray(batch.column(0))
                for k, g in enumerate(points):
                    s = p @ g
                    r = mix.at(s)
                    free = t * (r == 1 - s / pull)  # at a bound as well, so that a step from there is not too long
                    found[k] += np.concatenate(([t @ (r * s + pull / 2 * (r - 1) ** 2)], (t * r) @ p, ((p * free[:, None]).T @ p).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(found.size), pa.int32()), pa.array(found.ravel())], names=["k", "x"])

        got = dict(rows.where("_tokens > 0").select("_tokens", "_p").mapInArrow(tidy(run), "k int, x double").groupBy("k").agg(F.sum("x")).collect())
        found = np.array([got.get(j, 0.0) for j in range(len(points) * m)]).reshape(-1, m) / total
        return [(g @ g / 2 + g @ goal / total - x[0], g + goal / total - x[1 : d + 1], np.eye(d) + x[d + 1 :].reshape(d, d) / pull, x[1 : d + 1] * total) for g, x in zip(points, found, strict=True)]

    (value, slope, bend, mix.reached), = sums(mix.off[None])
    while (still := np.abs(slope).max()) > EXACT:
        if mix.steps == steps:
            raise RuntimeError(f"rates are not settled after {steps} steps: gradient {still:.3g}")
        points = mix.off - LENGTHS[:, None] * np.linalg.solve(bend, slope)
        tried = sums(points)
        best = min(range(len(points)), key=lambda k: tried[k][0])
        if tried[best][0] >= value:  # only where rounding hides what is left: the steeper end of the two is dropped
            best = min(range(len(points)), key=lambda k: np.abs(tried[k][1]).max())
            if np.abs(tried[best][1]).max() >= still:
                if still > 100 * EXACT:
                    raise RuntimeError(f"rates do not settle: gradient {still:.3g}")
                break
        mix.off, (value, slope, bend, mix.reached), mix.steps = points[best], tried[best], mix.steps + 1
    mix.still = float(still)
    return mix


def _with_rates(rows: DataFrame, mix: Mixture, keep: list[str]) -> DataFrame:
    """Columns to keep, _tokens, _p and _rate of staged memberships."""
    d = len(mix.targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p = (batch.column(batch.schema.get_field_index(c)) for c in ("_tokens", "_p"))
            a = np.asarray(p.flatten()).reshape(-1, d) * np.asarray(tokens)[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mix.rates(a))], names=[*batch.schema.names, "_rate"])

    source = rows.select(*keep, "_tokens", "_p")
    return source.mapInArrow(tidy(run), StructType([*source.schema.fields, StructField("_rate", DoubleType())]))


def _copies() -> Column:
    """A whole number of copies whose expectation is the rate: the fraction is decided by a hash of the id."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor("_rate") + F.when(chance < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)).cast("int")


def _checked(mix: Mixture, tolerance: float | None) -> Mixture:
    if tolerance is not None and (missed := np.abs(mix.reached - mix.targets) > tolerance * np.maximum(mix.targets, 1)).any():
        raise ValueError(f"targets out of reach: domains {np.flatnonzero(missed).tolist()} stand at {mix.reached.tolist()} tokens, wanted {mix.targets.tolist()}")
    return mix


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: list[float], budget: float = 1.0, low: float = 0.0, high: float = 4.0, train_rows: int = TRAIN_ROWS, tolerance: float | None = None) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate, copies, and the domains' wanted and reached totals (the same in each row).

    labelled: doc_id and grade (the domain's number)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = _trained(source, labelled, len(targets), train_rows)
    rows = stage(memberships(source, model).drop("text"))
    mix = _checked(fit_rates(rows, targets, budget, low, high), tolerance)
    out = _with_rates(rows, mix, ["doc_id"])
    totals = [F.array(*[F.lit(float(x)) for x in own]).alias(name) for own, name in ((mix.targets, "wanted_tokens"), (mix.reached, "reached_tokens"))]
    return out.select("doc_id", F.col("_tokens").alias("n_tokens"), F.col("_p").alias("posteriors"), F.col("_rate").alias("rate"), _copies().alias("copies"), *totals)


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: list[float], budget: float = 1.0, low: float = 0.0, high: float = 4.0, train_rows: int = TRAIN_ROWS, tolerance: float | None = None) -> DataFrame:
    """docs with each row as many times as its copies say."""
    docs, renamed = shielded(docs, "doc_id", "text")
    names = docs.columns
    model = _trained(docs, labelled, len(targets), train_rows)
    rows = stage(memberships(docs.select("text"), model).drop("text"))
    mix = _checked(fit_rates(rows, targets, budget, low, high), tolerance)
    release(rows)
    counted = memberships(docs, model, mix).withColumn("_copies", _copies())
    return renamed(counted.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*names))
