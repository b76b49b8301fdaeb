"""Problem 1: near-duplicate records with small edits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import setsketch
from textloom.llm.components import components
from textloom.llm.pairing import bucket_pairs, expand, with_both
from textloom.llm.words import WordHashes, packed_words, shingle_hashes, triples, words_of
from textloom.session import materialize

M, ROWS = 128, 4  # registers; registers a band (four of 16 bits are one bigint)


def _sketch(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, factors = WordHashes(), setsketch.coefficients(M)
        for batch in batches:
            ids, copies, sizes, bands = [], [], [], []
            for i, title, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(title, text)
                if len(words) < min_words:
                    continue
                h = np.unique(shingle_hashes(known.of(words), 3))
                ids.append(i)
                sizes.append(len(h))
                copies.append(blake2b(h.tobytes(), digest_size=16).digest())
                bands.append(setsketch.registers(h, M, factors).view(np.int64))
            values = np.concatenate([*bands, np.empty(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * (M // ROWS), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.binary()), pa.array(sizes, pa.int64()), lists], ["id", "copy", "n", "bands"])

    return run


def sketches(docs: DataFrame, doc_id: str = "doc_id", title: str = "title", text: str = "text", min_words: int = 20) -> DataFrame:
    """(id, copy, n, bands): the digest of the set of triples, their number and the registers, four to a bigint. Records of fewer words are left out."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(title).alias("title"), F.col(text).alias("text"))
    return rows.mapInArrow(_sketch(min_words), "id bigint, copy binary, n bigint, bands array<bigint>")


def _estimate(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2 = (np.frombuffer(np.ascontiguousarray(batch.column(c).flatten().to_numpy(zero_copy_only=False)), np.uint16).reshape(-1, M) for c in (4, 5))
            n1, n2 = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (2, 3))
            near = setsketch.jaccard((k1 > k2).sum(1), (k1 < k2).sum(1), (k1 == k2).sum(1), n1, n2) >= floor
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], ["a", "b"])

    return run


def _verify(least: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(maxsize=8)(lambda body: triples(packed_words(body)))  # pairs come sorted by b
        for batch in batches:
            out: list[tuple] = []
            for a, b, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = map(of, (left, right))
                both = len(x & y)
                either = len(x) + len(y) - both
                if both * least[1] >= least[0] * either:
                    out.append((a, b, both / either))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["a", "b", "jaccard"])

    return run


def representatives(sketched: DataFrame) -> DataFrame:
    """The sketches of the least record of each set of triples."""
    return sketched.join(sketched.groupBy("copy").agg(F.min("id").alias("id")), ["copy", "id"], "left_semi")


def band_rows(reps: DataFrame) -> DataFrame:
    """(k, id): one row for each band of a sketch, the band's number being part of the key."""
    return reps.select("id", F.posexplode("bands").alias("band", "value")).select("id", F.xxhash64("band", "value").alias("k"))


def verified(candidates: DataFrame, reps: DataFrame, docs: DataFrame, doc_id: str, title: str, text: str, least: tuple[int, int]) -> DataFrame:
    """(a, b, jaccard): those of the candidates (a, b) that are near-duplicates. Sizes drop pairs that cannot reach least, the registers' joint likelihood those four standard errors below it, and the texts decide."""
    share = least[0] / least[1]
    one, two = (reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bands").alias(f"k{x}")) for x in "ab")
    sized = candidates.join(one, "a").join(two, "b").where(F.least("na", "nb") >= F.lit(share) * F.greatest("na", "nb")).select("a", "b", "na", "nb", "ka", "kb")
    floor = share - 4 * (share * (1 - share) / M) ** 0.5
    near = materialize(sized.mapInArrow(_estimate(floor), "a bigint, b bigint"))
    return with_both(near, docs, doc_id, title, text).mapInArrow(_verify(least), "a bigint, b bigint, jaccard double")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", title: str = "title", text: str = "text", min_words: int = 20, least: tuple[int, int] = (7, 10), sketched: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard): pairs a < b of representatives whose sets of word triples have a Jaccard similarity of at least least (a fraction of integers).

    Records with the same set of triples are one class, represented by its least
    id; each record's SetSketch has 128 registers, banded by four. Classes that
    meet in a band are candidates (a pair at similarity s is missed with
    probability (1 - s^4)^32: 1.5 in 10,000 at 0.7, less than 1 in a million at 0.8),
    which are verified.

    Null title and text count as empty; records under min_words words, and rows
    with null id, are never cases. Extra columns are ignored; an empty table gives no pairs.
    """
    reps = representatives(sketches(docs, doc_id, title, text, min_words) if sketched is None else sketched)
    return verified(bucket_pairs(band_rows(reps), "k", "id").select("a", "b"), reps, docs, doc_id, title, text, least)


def copy_classes(sketched: DataFrame) -> DataFrame:
    """(id, rep): each record and the least id with the same set of triples."""
    return sketched.select("id", "copy").join(sketched.groupBy("copy").agg(F.min("id").alias("rep")), "copy").select("id", "rep")


def near_duplicate_pairs(docs: DataFrame, doc_id: str = "doc_id", title: str = "title", text: str = "text", min_words: int = 20, least: tuple[int, int] = (7, 10)) -> DataFrame:
    """(a, b), a < b: all pairs of near-duplicate records, copies included."""
    sk = materialize(sketches(docs, doc_id, title, text, min_words))
    return expand(near_duplicates(docs, doc_id, title, text, min_words, least, sk), copy_classes(sk), F.lit(True))


def star_pairs(shared: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: each bucket's members (k, id) with its least and its greatest one; at most two rows a member."""
    hubs = shared.groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    met = shared.join(hubs, "k")
    return met.select(F.col("low").alias("a"), F.col("id").alias("b")).unionAll(met.select(F.col("id").alias("a"), F.col("high").alias("b"))).where("a < b").distinct()


def cross_pairs(shared: DataFrame, found: DataFrame, tested: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: members of one bucket that lie in different components (id, component) and were not tested. Pairs within a component are not even looked at: components meet first, then their members."""
    rows = materialize(shared.join(found, "id", "left").select("k", "id", F.coalesce("component", "id").alias("c")))
    several = rows.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    rows = rows.join(several, "k", "left_semi")
    kinds = rows.select("k", "c").distinct()
    meet = kinds.withColumnRenamed("c", "c1").join(kinds.withColumnRenamed("c", "c2"), "k").where("c1 < c2")
    one, two = (rows.select("k", F.col("c").alias(c), F.col("id").alias(x)) for c, x in (("c1", "x"), ("c2", "y")))
    pairs = meet.join(one, ["k", "c1"]).join(two, ["k", "c2"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", title: str = "title", text: str = "text", min_words: int = 20, least: tuple[int, int] = (7, 10)) -> DataFrame:
    """(doc_id, group_id, group_size, n_copies): one row for each document; group_id is the least id that near-duplicates link it to, group_size the number of documents there and n_copies of other documents with its set of triples. Documents without any are their own group.

    The groups are the components of near_duplicates' pairs, from fewer pairs: in
    each bucket all members are verified against the least and the greatest one,
    which makes most of a bucket of filled-in templates one component with a number of
    candidates in proportion to its members. After that only pairs of members in different components
    are left that could join anything; all of those are verified, so no link is lost.
    """
    sk = materialize(sketches(docs, doc_id, title, text, min_words))
    reps = representatives(sk)
    banded = materialize(band_rows(reps))
    shared = materialize(banded.join(banded.groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"), "k", "left_semi"))
    stars = materialize(star_pairs(shared))
    links = materialize(verified(stars, reps, docs, doc_id, title, text, least).select("a", "b"))
    rest = materialize(cross_pairs(shared, components(links, "a", "b"), stars))
    found = components(links.unionAll(verified(rest, reps, docs, doc_id, title, text, least).select("a", "b")), "a", "b").withColumnRenamed("id", "rep")
    classes = copy_classes(sk)
    copies = classes.groupBy("rep").agg((F.count("*") - 1).alias("n_copies"))
    of = materialize(classes.join(copies, "rep").join(found, "rep", "left").select(F.col("id").alias("__id"), F.coalesce("component", "rep").alias("group_id"), "n_copies"))
    of = of.join(of.groupBy("group_id").agg(F.count("*").alias("group_size")), "group_id")
    own = docs.select(F.col(doc_id).alias("doc_id"))
    number = lambda c, x: F.coalesce(c, F.lit(x)).cast("long").alias(c)
    return own.join(of, F.col("doc_id") == F.col("__id"), "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), number("group_size", 1), number("n_copies", 0))
