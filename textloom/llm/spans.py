"""Problem 8: long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.llm.components import components
from textloom.llm.pairing import bucket_pairs
from textloom.session import materialize

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and its inverse, made as far as they are needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial in the base modulo 2^64, and the base's inverse powers."""
    up, down = _powers.upto(len(codes) + 1)
    c = codes.astype(np.uint64)
    c = (c ^ (c >> np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * up[:-1])]), down


def run_hashes(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, end) of the code points that sums were made of."""
    s, down = sums
    h = (s[end] - s[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k code points."""
    at = np.arange(max(0, len(codes) - k + 1))
    return run_hashes(prefix_sums(codes), at, at + k)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The least value of each run of w values, from running minima of blocks of w (forwards and backwards)."""
    n = len(h) - w + 1
    pad = -len(h) % w
    blocks = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, h.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _merged(df: DataFrame) -> DataFrame:
    """df as a join's side that is never broadcast: it grows with the corpus, and plans should not depend on its size."""
    return df.hint("merge")


@dataclass(frozen=True)
class Shared:
    """What documents share, as tables none of which has a row for a pair.

    hits (v, h, id, lo, hi): the blocks of documents whose MinHash v other documents
    have too; blocks (v, h, first, last): distinct blocks with the least and the
    greatest document that has them; windows (v, key, h, off, len, first): runs of
    len paragraphs that different documents have though they lie in different blocks,
    from off on in their block, with the least document that has them. span is a paragraph's length.
    """

    hits: DataFrame
    blocks: DataFrame
    windows: DataFrame
    span: int


def paragraph_blocks(text: str, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(v, h, lo, hi): the maximal runs of paragraphs (windows of span characters) that have the same MinHash v over their grams. Paragraphs lo to hi, both included; h is the hash of all characters that they cover."""
    codes = code_points(text)
    sums = prefix_sums(codes)
    at = np.arange(max(0, len(codes) - gram + 1))
    g = run_hashes(sums, at, at + gram)
    w = span - gram + 1
    if len(g) < w:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    m = window_minima(g, w)
    lo = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    hi = np.concatenate([lo[1:], [len(m)]]) - 1
    return m[lo], run_hashes(sums, lo, hi + span) + (hi - lo).astype(np.uint64), lo, hi


_BLOCKS = pa.struct([("v", pa.int64()), ("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _block_rows(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [paragraph_blocks(t, span, gram) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(f[0]) for f in found)])
            v, h, lo, hi = (np.concatenate([*(f[i] for f in found), np.empty(0, t)]) for i, t in enumerate((np.uint64, np.uint64, np.int64, np.int64)))
            rows = pa.StructArray.from_arrays([pa.array(v.view(np.int64)), pa.array(h.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], fields=list(_BLOCKS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], ["id", "blocks"])

    return run


STEP = 10  # paragraphs a segment of a block


def _segments(sums: tuple[np.ndarray, np.ndarray], block: dict, span: int, gram: int) -> list[dict] | None:
    """The segments of a block: up to STEP neighbouring paragraphs each, numbered by their distance to the gram that is the block's MinHash.

    core hashes what all paragraphs of a segment have in common, whole everything
    that the block's paragraphs of it cover; off and len are their places in the
    block. Two equal paragraphs lie in segments of the same number and core. None if
    the gram stands in the block twice, as equal paragraphs might then go by another.
    """
    lo, hi = block["lo"], block["hi"]
    at = np.arange(lo, hi + span - gram + 1)
    hits = at[run_hashes(sums, at, at + gram) == np.uint64(block["v"] & (1 << 64) - 1)]
    if len(hits) != 1:
        return None
    p = int(hits[0])
    number = np.arange((p - hi) // STEP, (p - lo) // STEP + 1)
    near, far = np.maximum(number * STEP, p - hi), np.minimum(number * STEP + STEP - 1, p - lo)
    step = min(STEP, span - gram + 1)
    core = run_hashes(sums, p - number * STEP, p - number * STEP + span - step + 1)
    whole = run_hashes(sums, p - far, p - near + span) + far.astype(np.uint64)
    return [{"no": n, "core": c, "whole": w, "off": o, "len": k} for n, c, w, o, k in zip(number.tolist(), core.view(np.int64).tolist(), whole.view(np.int64).tolist(), (p - far - lo).tolist(), (far - near + 1).tolist())]


_SEGMENT = pa.struct([("no", pa.int32()), ("core", pa.int64()), ("whole", pa.int64()), ("off", pa.int32()), ("len", pa.int32())])


def _block_details(span: int, gram: int):
    """Rows (v, h, first, last, segments, keys): of each of the given blocks of a text its segments (null if they cannot be told) and the hashes of its paragraphs, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                sums = prefix_sums(code_points(text))
                for b in blocks:
                    at = np.arange(b["lo"], b["hi"] + 1)
                    rows.append((b["v"], b["h"], b["first"], b["last"], _segments(sums, b, span, gram), run_hashes(sums, at, at + span).view(np.int64)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (*[pa.int64()] * 4, pa.list_(_SEGMENT), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["v", "h", "first", "last", "segments", "keys"])

    return run


def _compared(blocks: DataFrame, long: DataFrame, span: int, gram: int) -> DataFrame:
    """(v, key, h, off, len, first): paragraphs that different blocks of one MinHash have in common, in runs of len from off on in their block.

    One document of each block is opened. Segments meet by their cores; where all that
    meet are the same throughout, the segment is one key; else its paragraphs' hashes are compared.
    """
    several = blocks.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    compared = blocks.join(_merged(several), "v", "left_semi")
    asked = materialize(compared.groupBy("at.id").agg(F.collect_list(F.struct("v", "h", "at.lo", "at.hi", "first", "last")).alias("blocks")))
    picked = long.join(materialize(asked.select("id")), "id", "left_semi")  # ids first, so that other texts are not shuffled
    opened = materialize(picked.join(_merged(asked), "id").select("text", "blocks").mapInArrow(_block_details(span, gram), "v bigint, h bigint, first bigint, last bigint, segments array<struct<no:int,core:bigint,whole:bigint,off:int,len:int>>, keys array<bigint>"))
    segments = opened.select("v", "h", "first", "last", F.explode("segments").alias("s")).select("v", "h", "first", "last", "s.*")
    extent = (F.min("first").alias("least"), F.max("last").alias("most"), F.min("h").alias("h0"), F.max("h").alias("h1"), (F.min("whole") == F.max("whole")).alias("same"))
    meet = segments.groupBy("v", "no", "core").agg(*extent).where("least < most and h0 <> h1").select("v", "no", "core", "least", "same")
    met = materialize(segments.join(_merged(meet), ["v", "no", "core"]).select("v", "h", "whole", "off", "len", "least", "same"))
    unclear = opened.join(_merged(materialize(opened.where(F.col("segments").isNull()).select("v").distinct())), "v", "left_semi").select("v", "h", F.lit(0).alias("from"), F.size("keys").alias("len"))
    open_runs = materialize(met.where("not same").select("v", "h", F.col("off").alias("from"), "len").unionAll(unclear))
    keyed = opened.select("v", "h", "first", "last", "keys").join(_merged(open_runs), ["v", "h"])
    windows = materialize(keyed.select("v", "h", "first", "last", "from", F.posexplode(F.slice("keys", F.col("from") + 1, F.col("len"))).alias("i", "key")))
    extent = (F.min("first").alias("least"), F.max("last").alias("most"), F.min("h").alias("h0"), F.max("h").alias("h1"))
    common = windows.groupBy("v", "key").agg(*extent).where("least < most and h0 <> h1").select("v", "key", F.col("least").alias("first"))
    single = windows.select("v", "key", "h", (F.col("from") + F.col("i")).alias("off"), F.lit(1).alias("len")).join(_merged(common), ["v", "key"])
    return materialize(single.unionAll(met.where("same").select("v", F.col("whole").alias("key"), "h", "off", "len", F.col("least").alias("first"))))


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 300, gram: int = 200) -> Shared:
    """Which runs of at least span characters documents share, from one row a block of paragraphs; linear in the text, however many documents share a run.

    Paragraph MinHash banding, tuned for a recall of one: every run of span
    characters is a paragraph, its set the runs of gram characters in it, with one
    band of one row. Equal paragraphs then have the same MinHash with certainty, and
    as neighbouring paragraphs mostly have the same one, they form blocks, about
    2 / (span - gram + 2) a character. Larger grams give more blocks but fewer
    chance collisions: notices shorter than gram characters never collide.

    Blocks whose MinHash meets in different documents are verified exactly (a
    Jaccard similarity of one): equal blocks by the hash of their characters; where
    different blocks have the same MinHash, one document of each gives the hashes of
    its segments of neighbouring paragraphs, and those are compared, paragraph by
    paragraph only where segments are partly the same. With the MinHash, which is a hash of 200 of the paragraph's characters, that is 128 bits: the expected number of wrong
    pairs is below one in 10^9 even where 10^10 paragraphs share a MinHash.
    Frequencies are summed before they are shuffled, so a notice in a third of all
    documents meets in no single task.

    Null, empty and short texts (under span code points) share nothing, nor does a
    text with itself. Extra columns are ignored. doc_id must be a unique bigint; rows with a null id are left out.
    """
    long = docs.where((F.length(text) >= span) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    listed = materialize(long.mapInArrow(_block_rows(span, gram), "id bigint, blocks array<struct<v:bigint,h:bigint,lo:int,hi:int>>"))
    rows = listed.select("id", F.explode("blocks").alias("b")).select("b.v", "b.h", "id", "b.lo", "b.hi")
    met = materialize(rows.groupBy("v").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("v"))
    hits = materialize(rows.join(_merged(met), "v", "left_semi"))
    blocks = materialize(hits.groupBy("v", "h").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min(F.struct("id", "lo", "hi")).alias("at")))
    return Shared(hits, blocks.select("v", "h", "first", "last"), _compared(blocks, long, span, gram), span)


def _sets(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """One of the keys for each distinct set of members: keys with the same number of members and the same two combined hashes have the same set."""
    prints = (F.count("*").alias("n"), F.bit_xor(F.xxhash64(member)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), member)).alias("y"))
    return rows.groupBy(*keys).agg(*prints).where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct(*keys)).alias("k")).select(*(F.col(f"k.{k}").alias(k) for k in keys))


def shared_pairs(spans: Shared) -> DataFrame:
    """(a, b), a < b: all pairs of documents with a common run, copies included.

    The paragraphs of one notice all stand in the same documents. So of the
    paragraphs with the same set of blocks, and then of those with the same set of
    documents, one is kept: a set of documents is expanded to its pairs once, which
    are rows of the result.
    """
    of_block = spans.hits.select("v", "h", "id").distinct()
    own = of_block.join(_merged(spans.blocks.where("first < last")), ["v", "h"], "left_semi")
    in_blocks = spans.windows.select("v", "key", "h").distinct()
    kept = in_blocks.join(_merged(_sets(in_blocks, ["v", "key"], "h")), ["v", "key"], "left_semi")
    across = kept.join(_merged(of_block), ["v", "h"]).select("v", F.col("key").alias("h"), "id").distinct()
    rows = materialize(own.unionAll(across).distinct())
    rows = rows.join(_merged(_sets(rows, ["v", "h"], "id")), ["v", "h"], "left_semi")
    return bucket_pairs(rows.select(F.struct("v", "h").alias("k"), "id"), "k", "id").select("a", "b")


def shared_intervals(spans: Shared) -> DataFrame:
    """(id, start, end): runs of each document that another one has too; they may overlap."""
    whole = spans.hits.join(spans.blocks.where("first < last"), ["v", "h"], "left_semi").select("id", F.col("lo").alias("start"), (F.col("hi") + spans.span).alias("end"))
    part = spans.hits.join(spans.blocks.where("first = last"), ["v", "h"], "left_semi").join(spans.windows.select("v", "h", "off", "len"), ["v", "h"])
    start = F.col("lo") + F.col("off")
    return whole.unionAll(part.select("id", start.alias("start"), (start + F.col("len") - 1 + spans.span).alias("end")))


def shared_characters(docs: DataFrame, spans: Shared, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_shared, n_runs): of each document, how many characters lie in runs of at least span characters that another document has too. Null texts have null n_chars and share nothing."""
    order = W.partitionBy("id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = shared_intervals(spans).withColumn("reach", before)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("reach", F.lit(0))))
    covered = marked.groupBy("id").agg(F.sum(fresh).alias("n_shared"), F.count(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1)).alias("n_runs"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.length(text).cast("long").alias("n_chars"))
    return own.join(covered, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_chars", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_shared", "n_runs")))


def span_groups(docs: DataFrame, spans: Shared, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, group_id, keep): one row for each document; group_id is the least id of the component that shared spans link it to (its own without any), keep is true for that document, and the rest of a component are candidates for removal. A run's documents are linked to the least of them, not to each other."""
    of_block = spans.hits.join(spans.blocks.where("first < last"), ["v", "h"]).select(F.col("first").alias("a"), F.col("id").alias("b"))
    of_window = spans.windows.select("v", "h", F.col("first").alias("least")).distinct().join(spans.blocks, ["v", "h"]).select(F.col("least").alias("a"), F.col("first").alias("b"))
    found = components(of_block.unionAll(of_window).where("a < b").distinct(), "a", "b")
    group = F.coalesce("component", "doc_id")
    return docs.select(F.col(doc_id).alias("doc_id")).join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", group.alias("group_id"), F.col("doc_id").eqNullSafe(group).alias("keep"))
