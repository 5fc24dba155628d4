"""Secret spans, told apart by how widely their values are owned across the corpus.

One map finds candidates in every whole text: the base kinds (assigned values, access keys, hex runs) and long
mixed tokens (generic).  Their values' 64-bit hashes are then aggregated over the corpus by distinct
repository and owner.  A value that several owners have is a copied example; one that few have looks live.
Base spans always stay; a generic span is added where its value looks live.

Aggregation is by (value, repository, owner) first, so a value that a third of all documents share shrinks to
its owners before it is shuffled by value; joins back are plain equi-joins that can split a hot value.

Defined cases: a null or empty text has no span; null repositories and owners count as one of their own;
repeated rows are kept, and add nothing to a value's owners; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from rowforge.llm.grouping import batches_of, tidy
from rowforge.sources.staging import stage

KINDS = ("assign", "access", "hex", "generic")
OWNERS = 3


def _either(word: str) -> str:
    """A pattern for an ASCII word in either case; other letters of a class of case are not meant."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run of 18 or more is found at the same places as any run, cut by length
HEX = re.compile(r"[0-9a-f]{16,}")
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_MIXED = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]")]


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of all candidates, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = [(a, z) for a, _, z, _ in found]
    for m in GENERIC.finditer(text):
        if all(p.search(m[0]) for p in _MIXED) and not any(a < m.end() and m.start() < z for a, z in base):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z, _ in spans)


def _scan(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            rows = [candidates(t or "") for t in batch.column(at).to_pylist()]
            base = [[s for s in r if s[1] < 3] for r in rows]
            flat, cut = [s for r in rows for s in r], pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array([f(s) for s in flat], kind)) for f, kind in ((lambda s: s[0], pa.int32()), (lambda s: s[1], pa.int32()), (lambda s: s[2], pa.int32()), (lambda s: _hash(s[3]), pa.int64()))]
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(3)]
            digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base])
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, digest, *lists], names=[*batch.schema.names, "_n0", "_n1", "_n2", "_base", "_start", "_kind", "_end", "_value"])

    return run


_FOUND = [*(StructField(f"_n{k}", LongType()) for k in range(3)), StructField("_base", StringType()), *(StructField(c, ArrayType(t)) for c, t in (("_start", IntegerType()), ("_kind", IntegerType()), ("_end", IntegerType()), ("_value", LongType())))]


def scan(docs: DataFrame, repository: Column, owner: Column, keep: list[str] | None = None) -> DataFrame:
    """Columns of docs (all, or those to keep) with _row (a row's number), _repo, _owner and what its text holds; staged."""
    marks = [F.monotonically_increasing_id().alias("_row"), F.xxhash64(repository).alias("_repo"), F.xxhash64(owner).alias("_owner")]
    kept = docs.columns if keep is None else keep
    source = docs.select(*[F.col(c).cast("long").alias(c) if keep and c == "doc_id" else F.col(c) for c in kept], *marks, *([F.col("text")] if "text" not in kept else []))
    found = source.mapInArrow(tidy(_scan(source.columns.index("text"))), StructType([*source.schema.fields, *_FOUND]))
    return stage(found if keep is None else found.drop("text"))


def ownership(found: DataFrame) -> DataFrame:
    """_value, repositories, owners: by how many distinct ones each candidate value is held."""
    held = found.where(F.size("_value") > 0).select("_repo", "_owner", F.explode("_value").alias("_value")).distinct()
    return held.groupBy("_value").agg(F.count_distinct("_repo").alias("repositories"), F.count_distinct("_owner").alias("owners"))


def classified(found: DataFrame, owners: int = OWNERS) -> DataFrame:
    """_row, _spans (kept ones, in order, with `live`), of rows that have candidates."""
    each = found.where(F.size("_value") > 0).select("_row", F.explode(F.arrays_zip("_start", "_kind", "_end", "_value")).alias("s"))
    each = each.select("_row", F.col("s._start").alias("start"), F.col("s._kind").alias("kind"), F.col("s._end").alias("end"), F.col("s._value").alias("_value"))
    told = each.join(ownership(found), "_value").withColumn("live", F.col("owners") < owners)
    kept = F.struct("start", "kind", "end", "live", "repositories", "owners")
    return told.groupBy("_row").agg(F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), kept))).alias("_spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.lit(list(KINDS))
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","), F.lit(""))


def find_secrets(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, owners: int = OWNERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied (spans of values with few or many owners)."""
    repository = F.struct("source", "lang") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    found = scan(docs, repository, owner, keep=["doc_id"])
    whole = found.join(classified(found, owners), "_row", "left")
    live = F.coalesce(F.size(F.filter("_spans", lambda s: s["live"])), F.lit(0))
    return whole.select(
        "doc_id", F.col("_n0").alias("n_assign"), F.col("_n1").alias("n_access"), F.col("_n2").alias("n_hex"), F.col("_base").alias("base_sha256"), span_text(F.col("_spans")).alias("spans"),
        live.cast("long").alias("n_live"), (F.coalesce(F.size("_spans"), F.lit(0)) - live).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", repository: Column | None = None, owner: Column | None = None, owners: int = OWNERS) -> DataFrame:
    """docs with every span in its text replaced by `mark` (n_chars, where there is one, counts the new text); rows
    without candidates are not shuffled."""
    repository = F.struct("source", "lang") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    given, names = docs.columns, [c if c in ("doc_id", "text", "n_chars") else f"_extra{k}" for k, c in enumerate(docs.columns)]
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(given, names, strict=True)], repository.alias("_r"), owner.alias("_o"))
    found = scan(docs, F.col("_r"), F.col("_o")).drop("_r", "_o")
    clean = found.where(F.size("_value") == 0).select(*names)
    hit = found.where(F.size("_value") > 0).join(classified(found, owners), "_row").select(*names, F.transform("_spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("z"))).alias("_spans"))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                out, past = [], 0
                for s in spans:
                    if s["a"] >= past:
                        out += [text[past : s["a"]], mark]
                    past = max(past, s["z"])
                texts.append("".join([*out, text[past:]]))
            columns = [pa.array(texts) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    masked = hit.mapInArrow(tidy(run), StructType(docs.schema.fields[:-2]))
    if "n_chars" in names:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(masked).toDF(*given)
