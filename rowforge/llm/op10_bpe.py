"""Byte-level BPE by overlapping chunks.

A text longer than a chunk is pre-tokenised in chunks that start at fixed places and run past the next
chunk's start.  A chunk's first pre-tokens may be wrong, as it can begin inside one; but a match depends
only on the text from its start on, so once two neighbouring chunks share a boundary they agree for good.
The texts between such boundaries are encoded on their own.  Only boundaries after a non-space are used:
a run of spaces is split by what follows it, which a piece cut there would no longer see.

Defined cases: a null or empty text has no ids; repeated rows are encoded each; other columns are ignored; a very long
text is encoded whole, in chunks; an empty table gives no rows.
Work is per row inside one map over Arrow batches: no shuffle, so a hot source or copy group costs its share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from rowforge.llm.grouping import tidy

CHUNK_CHARS, OVERLAP_CHARS, THREADED = 1 << 12, 1 << 8, 64


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_table(path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, and each id's offsets into them."""
    enc = encoding(path, pattern)
    known = dict(zip(map(enc.encode_single_token, values := enc.token_byte_values()), values, strict=True))
    parts = [known.get(k, b"") for k in range(enc.n_vocab)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def chunk_cuts(text: str, pattern: regex.Pattern, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """True pre-token boundaries, one near each multiple of `chunk` where the chunks resynchronise."""
    starts = range(0, len(text), chunk)

    def scan(k: int) -> list[int]:
        stop, ends = min(len(text), starts[k] + chunk + overlap), []
        for m in pattern.finditer(text, starts[k], concurrent=True):
            ends.append(m.end())
            if m.end() >= stop:
                break
        return ends

    if len(starts) < THREADED:  # not worth a thread
        ends = list(map(scan, range(len(starts))))
    else:
        with ThreadPoolExecutor(2) as pool:
            ends = list(pool.map(scan, range(len(starts))))
    cuts, known = [0], ends[0]  # known: boundaries of the true pre-tokens, from the last cut on
    for k in range(1, len(starts)):
        other = set(ends[k])
        cut = next((b for b in known if b > starts[k] and b in other and not text[b - 1].isspace()), None)
        if cut is None:  # no meeting point within the overlap: the true pre-tokens go on through this chunk
            more, stop = known[-1] if known else cuts[-1], min(len(text), starts[k] + chunk + overlap)
            known = [*known, *(m.end() for m in _until(pattern, text, more, stop))]
            cut = next((b for b in known if b > starts[k] and b in other and not text[b - 1].isspace()), None)
        if cut is not None:
            cuts.append(cut)
            known = [b for b in ends[k] if b > cut]
    return cuts


def _until(pattern: regex.Pattern, text: str, start: int, stop: int) -> Iterator:
    for m in pattern.finditer(text, start):
        yield m
        if m.end() >= stop:
            return


def encode_text(text: str | None, enc: tiktoken.Encoding, pattern: regex.Pattern, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    """The ids of one text as little-endian unsigned 32-bit integers."""
    if not text:
        return np.zeros(0, "<u4")
    if len(text) <= chunk + overlap:
        return _whole(text, enc, pattern)
    cuts = [*chunk_cuts(text, pattern, chunk, overlap), len(text)]
    return np.concatenate([_whole(text[a:b], enc, pattern) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _whole(text: str, enc: tiktoken.Encoding, pattern: regex.Pattern) -> np.ndarray:
    """Ids of a text or piece.  The library's pattern engine counts its steps and gives up on very long runs of white space:
    a piece that has one is matched by this one's, and each match encoded as it is."""
    if len(text) < LONG_RUN or not _LONG_SPACE.search(text):
        return np.array(enc.encode_ordinary(text), "<u4")
    plain = _unsplit(enc.name, enc)
    return np.array([i for m in pattern.finditer(text) for i in plain.encode_ordinary(m[0])], "<u4")


LONG_RUN = 20_000
_LONG_SPACE = regex.compile(rf"\s{{{LONG_RUN}}}")


@lru_cache(maxsize=4)
def _unsplit(name: str, enc: tiktoken.Encoding) -> tiktoken.Encoding:
    """The same ranks with a pattern that takes any text as one match."""
    known = enc.token_byte_values()
    ranks = dict(zip(known, map(enc.encode_single_token, known), strict=True))
    return tiktoken.Encoding(f"{name} unsplit", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def decode_ids(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The tokens' raw bytes, concatenated."""
    data, at = table
    lengths = at[ids + 1] - at[ids]
    past = np.cumsum(lengths)
    if not len(ids):
        return b""
    return data[np.arange(past[-1]) + np.repeat(at[ids] - past + lengths, lengths)].tobytes()


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids: little-endian u4 bytes) of every row."""
    def ids(row: np.ndarray, _table) -> tuple:
        return (len(row), row.tobytes())

    return _mapped(docs, path, pattern, id_col, text_col, ids, [("n_tokens", "long", pa.int64()), ("ids", "binary", pa.binary())])


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every row, decode its ids again, and return both digests in place of the bulk."""
    def digests(row: np.ndarray, table) -> tuple:
        return len(row), hashlib.sha256(row.tobytes()).hexdigest(), hashlib.sha256(decode_ids(row.astype(np.int64), table)).hexdigest()

    return _mapped(docs, path, pattern, id_col, text_col, digests, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())])


def _mapped(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, of: Callable, fields: list[tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pat, table = encoding(path, pattern), regex.compile(pattern), token_table(path, pattern)
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                some = batch.slice(part, 2000)
                rows = [of(encode_text(t, enc, pat), table) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *(pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(fields))],
                    names=[id_col, *(name for name, _, _ in fields)],
                )

    source = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].alias("text"))
    return source.mapInArrow(tidy(run), f"`{id_col}` long, " + ", ".join(f"{name} {kind}" for name, kind, _ in fields))
