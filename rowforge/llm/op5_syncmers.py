"""Document fingerprints of closed syncmers, in DataFrame expressions only.

The alphabet is pieces of words: a word (a run without ASCII white space) is cut into pieces of four characters
from its start, so texts without spaces have pieces as well.  A window of k pieces is an anchor if, of the runs of
s pieces in it, the one with the least hash is the first or the last.  That depends on the window alone, so a passage keeps its anchors wherever it stands.  A text's
fingerprint is its distinct anchors in the order of their first places, as 32-bit hashes; likeness is the
Jaccard index of two fingerprints' anchors.

A text of fewer than k pieces, and one none of whose windows is an anchor, has its whole sequence of pieces as its
only anchor, so only a text without any piece has an empty fingerprint.

The next document of each is found without one global sort: ids are cut into ranges at quantiles (an id or null that
fills whole ranges is cut further by a hash of the text), the first document of each range is copied to the end of the
range before it in descending order, and a window in each range reads ahead.

Defined cases: null and empty texts have an empty fingerprint, like only to another empty one (1.0); rows with equal ids
are ordered by text (those of an id that fills whole ranges by a hash first), and a repeated
row may be the next of its copy; null ids come last; a single row is its own next; very long texts are read whole; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.sources.ranges import key_ranges

K_PIECES, S_PIECES, RANGE_BYTES = 5, 2, 2 << 20
PIECE = r"[^ \t\n\x0B\f\r]{1,4}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _least_of_runs(values: Column, width: int) -> Column:
    """Minima of all `width` neighbours in an array: runs are doubled, then two runs that overlap are taken."""
    def paired(apart: int) -> Callable[[Column], Column]:
        return lambda r: F.zip_with(F.slice(r, 1, F.size(r) - apart), F.slice(r, apart + 1, F.size(r) - apart), lambda a, b: F.least(a, b))

    have = 1
    while have * 2 <= width:
        values = _let(values, paired(have))
        have *= 2
    return _let(values, paired(width - have)) if have < width else values


def fingerprint(text: Column, k: int = K_PIECES, s: int = S_PIECES) -> Column:
    """The distinct anchors of a text, an array of ints."""
    if not 1 <= s < k:
        raise ValueError("1 <= s < k is needed")
    last = k - s  # the last inner run's place

    def anchors(runs: Column) -> Column:
        parts = sorted({*range(0, last + 1, s), last})

        def at(least: Column, i: Column) -> Column:
            return F.when((least == F.get(runs, i)) | (least == F.get(runs, i + last)), F.hash(*[F.get(runs, i + p) for p in parts]))

        return F.array_distinct(F.filter(F.transform(_least_of_runs(runs, last + 1), at), lambda a: a.isNotNull()))

    def of_words(words: Column) -> Column:
        def shifted(j: int) -> Column:
            return F.slice(words, j + 1, F.size(words) - (s - 1))

        runs = F.transform(words, lambda w: F.xxhash64(w)) if s == 1 else None
        for j in range(1, s):
            runs = F.zip_with(shifted(0) if runs is None else runs, shifted(j), lambda a, b: F.xxhash64(a, b))
        whole = F.array(F.hash(F.array_join(words, "\n")))
        closed = _let(_let(runs, anchors), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))
        return F.when(F.size(words) >= k, closed).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<int>"))

    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), 0), of_words)


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard index of two fingerprints; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return _let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def printed(fp: Column) -> Column:
    """A fingerprint as a string."""
    return F.array_join(fp.cast("array<string>"), " ")


def next_documents(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp of every row: the next in descending doc_id, after the last the first."""
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = key_ranges(source, "doc_id", max(64, -(-size // range_bytes)))
    placed = ranges.place(source, "doc_id", "bucket", F.xxhash64("text"))
    # The first row of each range: by id, then among those rows by text.  At most one a range is sent on.
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))
    firsts = placed.groupBy("bucket").agg(F.min(down).alias("top"))
    order = Window.orderBy("bucket")  # a row a range
    onto = firsts.select("bucket", "top", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    ties = placed.withColumn("top", down).join(F.broadcast(onto), ["bucket", "top"])
    heads = ties.groupBy("to").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "text")).alias("one"))
    copies = heads.select(F.lit(None).cast("long").alias("doc_id"), F.col("one.text").alias("text"), F.col("to").alias("bucket"), F.lit(True).alias("copy"))
    dealt = placed.select("doc_id", "text", "bucket", F.lit(False).alias("copy")).unionByName(copies).repartition(max(64, ranges.count), "bucket")
    ahead = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    printed_ = dealt.withColumn("fp", fingerprint(F.col("text")))
    return printed_.withColumns({"next_text": F.lead("text").over(ahead), "next_fp": F.lead("fp").over(ahead)}).where("not copy").drop("bucket", "copy")


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last half is the next document's beginning."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = next_documents(docs, range_bytes).select(
        "doc_id", "fp", "next_fp", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited")
    )
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint(F.col("edited")).alias("edited_fp"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("fp")).alias("fingerprint"), printed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
