"""Groups of documents joined by links of n-gram Jaccard similarity, found by a prefix-tree join.

1. Of equal texts one is kept for what follows: copies add nothing to frequencies and their n-grams go nowhere twice.
   Document frequencies of all n-grams are counted; those seen twice or more set bits of a filter of fixed size.
2. Each document's n-grams are ordered: unrepeated ones, repeated ones, widely repeated ones, then by hash.
   Two sets that are similar enough share an n-gram among the first n - ceil(t n) + 1 of either (and lie in
   the same or neighbouring classes of size), and a shared n-gram is a repeated one.  Documents with such
   n-grams are the only ones that can link; equal sets count once from here on.
3. Each set is compared with one that shares such an n-gram with it, the one of the least id (its hub): most sets of a
   group of near copies are linked by that alone.  An n-gram whose sets are all linked by now has nothing more to give.
4. Sets that share any other such n-gram are tied into families.  In a family, the largest of the groups linked so far
   is not compared within itself: blocks of the other sets meet blocks of all.  Each such pair of blocks, as each
   hub with a block of its sets, is one piece of work: the sets go into a trie in one global order, and all sets of the
   other block walk it together.  Overlap is counted once for each shared path, and a set leaves a subtree when even all
   of the remaining length there could not make it similar.
5. The links found (a spanning forest of each piece: no link between different sets is lost, but connected ones
   are not listed again) give components.

The filter changes only the order, never what links: any one global order is exact.  N-grams and sets are told
apart by 64-bit digests.

Defined cases: null or empty texts and texts without words have no n-gram and are components of their own;
a text with fewer words than an n-gram has its whole word sequence as its only one; repeated rows are kept;
a null doc_id never names a component while another id is in it; rows with one doc_id are documents of their own; very long
texts are read whole; other columns are ignored by near_groups and kept by keep_one_of_each, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm.components import anew, components
from rowforge.llm.grouping import batches_of, give_back, key_runs, shielded, small_batches, tidy
from rowforge.llm.wordhash import mix64, shingle_sets
from rowforge.sources.staging import forget, release, scope, stage

FILTER_BITS, BLOCK_SETS, BLOCK_ELEMENTS, WIDE = 27, 96, 1 << 19, 32
_U = np.uint64


# --- document frequencies ---------------------------------------------------------------------------------


def _counted(words: int, part_bits: int, chunk: int = 1 << 20):
    """Text batches to (part, once, often, times): n-grams by the part their first bits name, 32 more bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(found >> _U(64 - part_bits), np.arange((1 << part_bits) + 1, dtype=np.uint64))
            rest, often = (found >> _U(32 - part_bits)).astype(np.uint32), times > 1
            rows = []
            for part in range(1 << part_bits):
                a, z = at[part], at[part + 1]
                if a < z:
                    o = often[a:z]
                    rows.append((part, rest[a:z][~o].tobytes(), rest[a:z][o].tobytes(), times[a:z][o].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "once", "often", "times"])

        for batch in batches:
            for own in shingle_sets(batch.column(0), words):
                if len(own):
                    held.append(own)
                    n += len(own)
                    if n >= chunk:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    return run


def _bits(part_bits: int, filter_bits: int, wide: int):
    """Counts of a part to its stretch of both filters, as packed bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for part, once, often, times in zip(*(batch.column(c).to_pylist() for c in ("part", "once", "often", "times")), strict=True):
                parts.setdefault(part, []).append((once, often, times))
        stretch = 1 << (filter_bits - part_bits)
        for part in sorted(parts):
            blobs = parts.pop(part)
            keys = np.concatenate([np.frombuffer(b[k], np.uint32) for b in blobs for k in (0, 1)])
            n = np.concatenate([x for b in blobs for x in (np.ones(len(b[0]) // 4, np.int64), np.frombuffer(b[2], np.uint32).astype(np.int64))])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            total = np.add.reduceat(n, first)
            cell = keys[first] >> np.uint32(32 - (filter_bits - part_bits))
            out = []
            for least in (2, wide):
                bits = np.zeros(stretch, np.uint8)
                bits[cell[total >= least]] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([o], pa.binary()) for o in out)], names=["part", "repeated", "wide"])

    return run


def frequency_filters(texts: DataFrame, words: int, filter_bits: int = FILTER_BITS, wide: int = WIDE) -> tuple[int, np.ndarray, np.ndarray]:
    """The filters' width in bits (as a power of two) and bits: n-grams of two or more, and of `wide` or more documents.

    At most 2**filter_bits bits each, whatever the corpus; with more n-grams than that, more of them count as
    repeated, which costs work but loses nothing."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = min(20, max(9, math.ceil(math.log2(max(1, size / (4 << 20))))))
    filter_bits = max(part_bits + 3, min(filter_bits, math.ceil(math.log2(max(1, size / 6)))))
    counts = texts.select("text").mapInArrow(tidy(_counted(words, part_bits)), "part int, once binary, often binary, times binary")
    stretches = counts.repartition(1 << (part_bits - 2), "part").mapInArrow(tidy(_bits(part_bits, filter_bits, wide)), "part int, repeated binary, wide binary").collect()
    filters = []
    for name in ("repeated", "wide"):
        bits = np.zeros((1 << part_bits, 1 << (filter_bits - part_bits - 3)), np.uint8)
        for row in stretches:
            bits[row.part] = np.frombuffer(row[name], np.uint8)
        filters.append(bits.ravel())
    return filter_bits, *filters


# --- sets and the n-grams that may link them --------------------------------------------------------------


def size_class(n: int, percent: int) -> int:
    """Sets of similar enough sizes are in the same or neighbouring classes."""
    return int(math.log(n) / -math.log((percent - 0.5) / 100))


def _sets(words: int, percent: int, filter_bits: int, repeated, wide, group: int = 1 << 18):
    """(mark, text) batches to mark, n, sid, and of sets that may link: keys and elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for marks, sets in _some_sets(batches, words, group):
            classes = _classes(sets, filter_bits, repeated, wide)
            for part in range(0, len(sets), 250):
                sizes, sids, keys, elements = [], [], [], []
                for own, again in zip(sets[part : part + 250], classes[part : part + 250], strict=True):
                    n = len(own)
                    sid = int((mix64(own ^ _U(0x5BD1E995)).sum() + mix64(np.array([n], np.uint64)))[0].astype(np.int64)) if n else 0
                    key = None
                    if n and sid not in sent:
                        prefix = n - -(-percent * n // 100) + 1
                        if int((again == 0).sum()) < prefix:
                            order = np.lexsort((own, again))[:prefix]
                            shared = own[order][again[order] > 0]
                            c = size_class(n, percent)
                            key = np.concatenate([mix64(shared + _U((c + k) * 0x9E3779B97F4A7C15 % (1 << 64))) for k in (0, 1)]).astype(np.int64)
                            if len(sent) > 1_000_000:
                                sent.clear()
                            sent.add(sid)
                    sizes.append(n)
                    sids.append(sid)
                    keys.append(key)
                    elements.append(own.tobytes() if key is not None else None)
                yield pa.RecordBatch.from_arrays([pa.array(marks[part : part + 250]), pa.array(sizes, pa.int32()), pa.array(sids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(elements, pa.binary())], names=["mark", "n", "sid", "keys", "elements"])

    return run


def _some_sets(batches: Iterator[pa.RecordBatch], words: int, group: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(marks, sets) of rows in order, some `group` n-grams at a time."""
    marks, sets, n = [], [], 0
    for batch in batches_of(batches, 250):
        marks.append(np.array(batch.column(0)))  # a copy: the batch may go
        sets += shingle_sets(batch.column(1), words)
        n += sum(map(len, sets[-batch.num_rows :]))
        if n >= group:
            yield np.concatenate(marks), sets
            marks, sets, n = [], [], 0
    if sets:
        yield np.concatenate(marks), sets


def _classes(sets: list[np.ndarray], filter_bits: int, repeated, wide) -> list[np.ndarray]:
    """Of each set's n-grams: 0 for unrepeated ones, 1 for repeated, 2 for widely repeated ones."""
    flat = np.concatenate(sets)
    out = np.zeros(len(flat), np.uint8)
    at = (flat >> _U(64 - filter_bits)).astype(np.int64)
    for bits in (repeated.value, wide.value):
        out += bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
    return np.split(out, np.cumsum([len(own) for own in sets])[:-1])


# --- the trie ---------------------------------------------------------------------------------------------


class Trie:
    """Sets as ascending ranks, with chains of single children joined into one run."""

    def __init__(self, ranks: list[np.ndarray]):
        keyed = sorted(range(len(ranks)), key=lambda k: ranks[k].astype(">u4").tobytes())
        self.nodes: list[tuple[np.ndarray, int, list[int], list[int], int, int]] = []  # run, depth past it, terminals, children, least and most length below
        self.roots = self._grow([(k, ranks[k]) for k in keyed])

    def _grow(self, rows: list[tuple[int, np.ndarray]]) -> list[int]:
        roots: list[int] = []
        work = [(0, len(rows), 0, roots)]
        while work:
            low, high, depth, into = work.pop()
            a = low
            while a < high:
                head, z = rows[a][1], a + 1
                while z < high and rows[z][1][depth] == head[depth]:
                    z += 1
                last = rows[z - 1][1]
                m = min(len(head), len(last))
                differ = np.flatnonzero(head[depth:m] != last[depth:m])
                past = depth + int(differ[0]) if len(differ) else m
                ends, b = [], a
                while b < z and len(rows[b][1]) == past:
                    ends.append(rows[b][0])
                    b += 1
                sizes, below = [len(r[1]) for r in rows[a:z]], []
                into.append(len(self.nodes))
                self.nodes.append((head[depth:past], past, ends, below, min(sizes), max(sizes)))
                if b < z:
                    work.append((b, z, past, below))
                a = z
        return roots

    def walk(self, member: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(terminal set, probes similar to it): member[p, rank] tells the probes' elements, sizes their lengths."""
        work = [(node, np.arange(len(sizes)), np.zeros(len(sizes), np.int64)) for node in self.roots]
        while work:
            node, probes, overlap = work.pop()
            run, depth, ends, below, least, most = self.nodes[node]
            fits = (100 * sizes[probes] >= percent * least) & (percent * sizes[probes] <= 100 * most)
            probes, overlap = probes[fits], overlap[fits]
            overlap = overlap + member[np.ix_(probes, run)].sum(1)
            can = (100 + percent) * (overlap + most - depth) >= percent * (sizes[probes] + most)
            probes, overlap = probes[can], overlap[can]
            if not len(probes):
                continue
            for end in ends:
                yield end, probes[100 * overlap >= percent * (sizes[probes] + depth - overlap)]
            work += [(child, probes, overlap) for child in below]


def block_links(sids: list[int], sets: list[np.ndarray], side: np.ndarray, both: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block, or (both) between two blocks told apart by `side`."""
    flat = np.concatenate(sets)
    universe, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(universe), np.int64)
    rank[np.lexsort((universe, -seen))] = np.arange(len(universe))  # what most sets share comes first, so paths are shared
    cut = np.cumsum([len(s) for s in sets])[:-1]
    ranks = [np.sort(r) for r in np.split(rank[at], cut)]
    stored = np.flatnonzero(side) if both else np.arange(len(sets))
    asking = np.flatnonzero(~side) if both else np.arange(len(sets))
    if not len(stored) or not len(asking):
        return []
    member = np.zeros((len(asking), len(universe)), bool)
    for row, k in zip(member, asking, strict=True):
        row[ranks[k]] = True
    parent, out = list(range(len(sets))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for end, probes in Trie([ranks[k] for k in stored]).walk(member, np.array([len(ranks[k]) for k in asking]), percent):
        y = int(stored[end])
        for x in asking[probes].tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
                out.append((sids[x], sids[y]))
    return out


def _joined(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, one, two), rows in key_runs(batches, ["family", "one", "two"]):
            sets = [np.frombuffer(e, np.uint64) for e in rows.column("elements").to_pylist()]
            found = block_links(rows.column("sid").to_pylist(), sets, rows.column("block").to_numpy() == two, one != two, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])

    return run


# --- the operator -----------------------------------------------------------------------------------------


def _grouped(docs: DataFrame, words: int, percent: int, filter_bits: int, block_sets: int, block_elements: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n and component_id of every row."""
    spark = docs.sparkSession
    with scope(), small_batches(spark):
        source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("mark"))
        texts = stage(source.where("text is not null").select("mark", "text").dropDuplicates(["mark"]))
        forget(spark)
        width, repeated, wide = frequency_filters(texts, words, filter_bits)
        repeated, wide = spark.sparkContext.broadcast(repeated), spark.sparkContext.broadcast(wide)
        found = stage(texts.mapInArrow(tidy(_sets(words, percent, width, repeated, wide)), "mark long, n int, sid long, keys array<long>, elements binary"))
        repeated.destroy()  # what they were for is staged
        wide.destroy()
        give_back()
        release(texts)
        named = source.select("doc_id", "mark").join(found.select("mark", "n", "sid"), "mark", "left")
        rows = stage(named.select("doc_id", "mark", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sid", F.lit(0).cast("long")).alias("sid")), keep=True)
        forget(spark)

        keyed = found.where("keys is not null").select("sid", F.explode("keys").alias("key"))
        hubs = keyed.groupBy("key").agg(F.min("sid").alias("hub"), F.max("sid").alias("far")).where("hub < far")
        shared = stage(keyed.join(hubs.select(anew("key").alias("key"), "hub"), "key"))
        forget(spark)
        sets = found.where("elements is not null").select("sid", "n", "elements").join(shared.select("sid").distinct(), "sid", "left_semi")
        sets = stage(sets.dropDuplicates(["sid"]))
        release(found)
        forget(spark)
        near = components(_pieces_linked(_hub_pieces(sets, shared, block_sets, block_elements), percent))
        open_ = stage(_open_ties(shared, near))
        families = components(open_.where("sid <> hub").select(F.col("sid").alias("u"), F.col("hub").alias("v")))
        families = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct())
        further = _pieces_linked(_family_pieces(sets, families, near, block_sets, block_elements), percent)
        linked = components(near.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(further))

        own = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
        named = own.join(linked.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        group = named.groupBy("root").agg(F.min("least").alias("component_id"))
        label = stage(named.select("sid", "root").join(group.select(anew("root").alias("root"), "component_id"), "root"), keep=True)
        return rows.select("doc_id", "mark", "n", "sid").join(label, "sid", "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def _pieces_linked(pieces: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) found in pieces of work: family, one, two (blocks), block (each row's), sid, elements."""
    work = pieces.repartition("family", "one", "two").sortWithinPartitions("family", "one", "two", "sid")
    return work.mapInArrow(tidy(_joined(percent)), "u long, v long")


def _blocks(sets: Column, size: Column, block_sets: int, block_elements: int) -> Column:
    return F.ceil(F.greatest(sets / block_sets, size / block_elements)).cast("int")


def _hub_pieces(sets: DataFrame, shared: DataFrame, block_sets: int, block_elements: int) -> DataFrame:
    """Each hub with the blocks of those sets whose least hub it is.  Places are worked out first, and elements are sent after."""
    first = shared.where("sid <> hub").groupBy("sid").agg(F.min("hub").alias("family"))
    told = sets.select("sid", "n").join(first, "sid")
    extent = told.groupBy("family").agg(_blocks(F.count("*"), F.sum("n"), block_sets, block_elements).alias("blocks"))
    parts = told.join(extent.select(anew("family").alias("family"), "blocks"), "family").withColumn("two", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    hubs = extent.withColumn("two", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = F.lit(-1).alias("one")
    places = parts.select("family", one, "two", F.col("two").alias("block"), "sid").unionByName(hubs.select("family", one, "two", F.lit(-1).alias("block"), F.col("family").alias("sid")))
    return places.join(sets.select("sid", "elements"), "sid")


def _open_ties(shared: DataFrame, near: DataFrame) -> DataFrame:
    """sid, hub (the least id) of the n-grams whose sets are not all linked yet."""
    told = shared.select("sid", "key").join(near.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "key", F.coalesce("root", "sid").alias("group"))
    told = stage(told)
    open_ = told.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min("sid").alias("hub")).where("low < high")
    return told.join(open_.select(anew("key").alias("key"), "hub"), "key").select("sid", "hub").distinct()


def _family_pieces(sets: DataFrame, families: DataFrame, near: DataFrame, block_sets: int, block_elements: int) -> DataFrame:
    """Pairs of blocks of a family, but those within its largest group: asking blocks come first, that group's after them."""
    told = sets.select("sid", "n").join(families.select(F.col("node").alias("sid"), F.col("root").alias("family")), "sid").join(near.withColumnRenamed("node", "sid"), "sid", "left")
    told = stage(told.select("family", F.coalesce("root", "sid").alias("group"), "sid", "n"))
    groups = told.groupBy("family", "group").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    most = F.max(F.struct("sets", "group", "size"))
    extent = groups.groupBy("family").agg(most.alias("m"), F.sum("sets").alias("sets"), F.sum("size").alias("size"))
    extent = extent.select(
        "family", F.col("m.group").alias("largest"), _blocks(F.col("sets") - F.col("m.sets"), F.col("size") - F.col("m.size"), block_sets, block_elements).alias("asking"),
        _blocks(F.col("m.sets"), F.col("m.size"), block_sets, block_elements).alias("held"),
    )
    placed = told.join(extent.select(anew("family").alias("family"), "largest", "asking", "held"), "family").withColumn("asks", F.col("group") != F.col("largest"))
    spot = F.xxhash64("sid")
    placed = placed.withColumn("block", F.when(F.col("asks"), F.pmod(spot, F.col("asking"))).otherwise(F.col("asking") + F.pmod(spot, F.col("held"))).cast("int"))
    others = F.when(F.col("asks"), F.col("asking") + F.col("held")).otherwise(F.col("asking")) - 1
    pieces = placed.select("family", "block", "sid", F.explode(F.sequence(F.lit(0), others)).alias("other"))
    pieces = pieces.select("family", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "sid")
    return pieces.join(sets.select("sid", "elements"), "sid")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, filter_bits: int = FILTER_BITS, block_sets: int = BLOCK_SETS, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least doc_id reachable by links of `percent` or more."""
    rows = _grouped(docs, words, percent, filter_bits, block_sets, block_elements)
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, filter_bits: int = FILTER_BITS, block_sets: int = BLOCK_SETS, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """One row of each group, the one with the least doc_id (then text hash), with all of its columns.

    Rows without n-grams stay, but for repeated rows; rows with a null doc_id stay unless a row with an id has their text or group."""
    docs, renamed = shielded(docs, "doc_id", "text")
    rows = _grouped(docs, words, percent, filter_bits, block_sets, block_elements)
    first = rows.groupBy("root", F.when(F.col("n") == 0, F.struct("doc_id", "mark")).alias("lone"), F.when(F.col("component_id").isNull(), F.col("mark")).alias("nameless"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark"))
    kept = first.agg(least.alias("k")).select(_key(F.col("k.doc_id")).alias("_key"), F.col("k.mark").alias("_text_key"))
    keyed = docs.withColumns({"_key": _key(docs["doc_id"].cast("long")), "_text_key": F.xxhash64(docs["text"])})
    return renamed(keyed.join(kept, ["_key", "_text_key"], "left_semi").dropDuplicates(["_key", "_text_key"]).select(*docs.columns))


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(-(1 << 63)))
