"""Problem 4: the same or nearly the same records in training and evaluation splits."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.whitespace import strip
from textloom.llm.pairing import with_both
from textloom.llm.words import distinct, hashed, lowered, packed_words, triples, unpacked
from textloom.session import materialize

SEGMENT = 3  # words a segment: a segment is a triple, so that what is lost is counted as the definition counts it
SPARE = 0.03  # share of a record's segments that it chooses beyond those that must be; a pair then needs so many more in common
MAX_EDITS, _CELLS = 64, 1 << 21  # the widest band of the edit distance; cells of a table that is made whole
_KEY, _HALF = np.uint64(18), np.uint64(1 << 45)  # keys are the upper 46 bits of hashes, which with the kind of meeting make six bytes; those below _HALF are the first half
FILTER_BITS = 1 << 29  # a filter of at most 64 MB is broadcast; beyond it segments travel unfiltered


def normal_split(split: Column) -> Column:
    """The split trimmed and in lower case, validation as val."""
    s = F.lower(strip(split))
    return F.when(s == "validation", "val").otherwise(s)


def _lost(n: int, least: tuple[int, int]) -> int:
    """How many of n triples a record may lose and still have the share least in common."""
    return n + (-least[0] * n) // least[1]


class _Filter:
    """Which keys may be among a set: a table of bits, one a key; None lets all pass, an empty one none."""

    def __init__(self, bits: bytes | None, width: int) -> None:
        self.bits, self.width = bits, width

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return keys
        if not self.bits:
            return keys[:0]
        at = _places(keys, self.width)
        return keys[(np.frombuffer(self.bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]


def _places(keys: np.ndarray, width: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - width)).astype(np.int64)


def _records(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """(id, hashes of the words, number of distinct triples, their keys in order) of the records of enough words."""
    for batch in batches:
        ids, titles, texts = (c.to_pylist() for c in batch.columns)
        for i, (words, runs) in zip(ids, hashed(map(lowered, titles, texts), SEGMENT)):
            if len(words) >= min_words:
                t = distinct(np.sort(runs))
                yield i, words, len(t), distinct(t >> _KEY)


def _choice(keys: np.ndarray, n: int, least: tuple[int, int]) -> tuple[int, int, bool, int]:
    """Where a record's second half of the keys begins, how many triples it may lose, whether it is odd, and how many segments it chooses."""
    half, k = int(np.searchsorted(keys, _HALF)), _lost(n, least)
    odd = half <= k
    return half, k, odd, min(len(keys) - half if odd else half, k + 1 + int(SPARE * n))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*values, np.empty(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))


def _segments(min_words: int, least: tuple[int, int], others, block: int = 4_000_000):
    """Rows (id, copy, n, need, odd, chosen, rest, other) of a task's records, handled in blocks of so many words.

    A record of n triples may lose k of them. It chooses k + 1 segments and some
    more, of the first half of the hashes: those that its block saw least. The block
    stands for the corpus: any choice finds all pairs, a rarer one finds fewer
    others. need of them must be met. rest are the first half's others. A record
    with at most k segments in the first half is odd and chooses from the second;
    other are the segments of the second half that pass the filter others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = others.value if others is not None else _Filter(b"", 0)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            _, inverse, counts = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True, return_counts=True)
            seen, at, out = counts[inverse], 0, []
            for i, copy, n, keys in rows:
                half, k, odd, number = _choice(keys, n, least)
                pool, often = (keys[half:], seen[at + half : at + len(keys)]) if odd else (keys[:half], seen[at : at + half])
                at += len(keys)
                take = np.zeros(len(pool), bool)
                take[np.argsort(often, kind="stable")[:number]] = True
                chosen = pool[take]
                out.append((i, copy, n, number - k, odd, chosen, keys[:half] if odd else pool[~take], passing(keys[half:])))
            ids, copies, sizes, needs, odds, chosens, rests, seconds = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(copies, pa.binary()), pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), pa.array(odds, pa.bool_()), _lists(list(chosens)), _lists(list(rests)), _lists(list(seconds))],
                ["id", "copy", "n", "need", "odd", "chosen", "rest", "other"],
            )

        rows, size = [], 0
        for i, words, n, keys in _records(batches, min_words):
            rows.append((i, blake2b(words.tobytes(), digest_size=16).digest(), n, keys))
            size += len(words)
            if size >= block:
                yield flush(rows)
                rows, size = [], 0
        if rows:
            yield flush(rows)

    return run


def _seconds(min_words: int, least: tuple[int, int], others):
    """Rows (id, n, need, other) as _segments makes them, of the records with segments of the second half that pass the filter others; what a record chooses is only counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, _, n, keys in _records(iter([batch]), min_words):
                half, k, _, number = _choice(keys, n, least)
                if len(other := others.value(keys[half:])):
                    out.append((i, n, number - k, other))
            ids, sizes, needs, seconds = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), _lists(list(seconds))], ["id", "n", "need", "other"])

    return run


_SCHEMA = "id bigint, copy binary, n int, need int, odd boolean, chosen array<bigint>, rest array<bigint>, other array<bigint>"


def _filter_of(rows: DataFrame) -> _Filter:
    """A filter of the segments that odd records chose, with 16 to 32 bits for each. Each task ORs its own, and two rounds of merging bring one table of bits to the driver."""
    number = rows.where("odd").agg(F.sum(F.size("chosen").cast("long"))).first()[0] or 0
    width = max(16, (16 * number).bit_length())
    if not number or 1 << width > FILTER_BITS:
        return _Filter(None if number else b"", 0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << width - 3, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), width)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits, 1)], pa.binary())], ["b"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << width - 3, np.uint8)
        for batch in batches:
            for b in batch.column(0):
                bits |= np.frombuffer(zlib.decompress(b.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits, 1)], pa.binary())], ["b"])

    parts = rows.where("odd").select("chosen").mapInArrow(task, "b binary")
    return _Filter(zlib.decompress(parts.repartition(32).mapInArrow(union, "b binary").repartition(1).mapInArrow(union, "b binary").first()[0]), width)


def _band(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """A row for each of the neighbouring diagonals d: which items of x equal the ones of y there."""
    n, m, never = len(x), len(y), -1
    while never in x:
        never -= 1
    left, right = max(0, -int(d[0])), max(0, int(d[-1]) + n - m)
    wide = np.concatenate([np.full(left, never), y, np.full(right, never)])
    return np.lib.stride_tricks.sliding_window_view(wide, n)[d[0] + left : d[-1] + left + 1] == x


def _slides(equal: np.ndarray):
    """For each diagonal, where the run of equal items that begins at a position ends; from a table of the whole band."""
    n = equal.shape[1]
    ends = np.full((len(equal), n + 1), n)
    ends[:, :n] = np.minimum.accumulate(np.where(equal, n, np.arange(n))[:, ::-1], axis=1)[:, ::-1]
    rows = np.arange(len(equal))
    return lambda i, usable: ends[rows, i]


def _slide_by_steps(x: np.ndarray, y: np.ndarray, d: np.ndarray):
    """The same without a table, for long records: runs are followed in steps that double."""

    def one(i: int, k: int) -> int:
        step, last = 16, min(len(x), len(y) - k)
        while i < last:
            to = min(i + step, last)
            differ = np.flatnonzero(x[i:to] != y[i + k : to + k])
            if len(differ):
                return i + int(differ[0])
            i, step = to, 2 * step
        return i

    return lambda i, usable: np.array([one(int(a), int(k)) if u else 0 for a, k, u in zip(i, d, usable)])


def edit_distance(x: list, y: list, diagonal: int, band: int) -> int:
    """The least number of items inserted, deleted or replaced that make x of a part of y, whose ends are free, on paths within band diagonals of the given one; band + 1 if there are more.

    After e edits only the farthest position on each diagonal counts; from one
    count of edits to the next all diagonals of the band move at once.
    """
    number: dict = {}
    xs, ys = (np.fromiter((number.setdefault(w, len(number)) for w in z), np.int64, len(z)) for z in (x, y))
    return _distance(xs, ys, diagonal, band)


def _distance(x: np.ndarray, y: np.ndarray, diagonal: int, band: int) -> int:
    """edit_distance of arrays of numbers."""
    n, m = len(x), len(y)
    d = np.arange(diagonal - band, diagonal + band + 1)
    if n * len(d) <= _CELLS:
        equal = _band(x, y, d)
        met = (equal[:, :-2] & equal[:, 1:-1] & equal[:, 2:]).any(axis=0)
        if n - 2 - int(met.sum()) > 3 * band:  # an edit costs at most three runs of three, and what is left stands on a diagonal
            return band + 1
        slide = _slides(equal)
    else:
        slide = _slide_by_steps(x, y, d)
    never, least, most = -(1 << 40), np.maximum(0, -d), np.minimum(n, m - d)
    reach = np.full(len(d) + 2, never)
    for e in range(band + 1):
        on = reach + 1
        i = np.maximum(np.maximum(on[1:-1], reach[:-2]), on[2:])
        i = np.minimum(np.maximum(i, np.where(least <= e, least, never)), most)  # y's start is free; items of x before it have no partner
        usable = i >= least
        i = np.where(usable, slide(np.where(usable, i, 0), usable), never)
        if i.max() >= n:
            return e
        reach[1:-1] = i
    return band + 1


def _inside(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether all of x is a run of y."""
    part, whole = x.tobytes(), y.tobytes()
    at = whole.find(part)
    while at > 0 and at % x.itemsize:
        at = whole.find(part, at + 1)
    return at >= 0


def _groups(pairs: Iterator[tuple[int, int, bytes, bytes]], most: int = 1 << 15) -> Iterator[list[tuple[int, int, bytes, bytes]]]:
    """The pairs in runs of some most packed bytes of different texts."""
    group, seen, size = [], set(), 0
    for pair in pairs:
        size += sum(map(len, {*pair[2:]} - seen))
        seen.update(pair[2:])
        group.append(pair)
        if size >= most:
            yield group
            group, seen, size = [], set(), 0
    if group:
        yield group


def _verify(least: tuple[int, int]):
    """Hashes of words suffice for the count filter and the distance; words are cut only where the definition itself decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        spelled = lru_cache(maxsize=8)(lambda body: triples(packed_words(body)))  # pairs come sorted by t

        for batch in batches:
            out: list[tuple] = []
            for group in _groups(zip(*(c.to_pylist() for c in batch.columns))):
                bodies = dict.fromkeys(body for pair in group for body in pair[2:])
                known = {body: known[body] for body in bodies if body in known}
                new = [body for body in bodies if body not in known]
                known |= {body: (words.view(np.int64), *np.unique(runs, return_index=True)) for body, (words, runs) in zip(new, hashed(map(unpacked, new), SEGMENT))}
                out.extend(case for pair in group if (case := decide(*pair, known, spelled)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["e", "t", "containment", "edits"])

    def decide(e: int, t: int, left: bytes, right: bytes, known: dict, spelled) -> tuple | None:
        (x, hx, ix), (y, hy, iy) = known[left], known[right]
        if len(hy) < len(hx):
            x, y, hx, hy, ix, iy, left, right = y, x, hy, hx, iy, ix, right, left
        n, k = len(hx), _lost(len(hx), least)
        at = np.minimum(np.searchsorted(hy, hx), len(hy) - 1)
        met = hy[at] == hx
        both = int(met.sum())
        if both < n - k:  # the count filter: no k / 3 edits lead from x to a part of y, nor is the share reached otherwise
            return None
        edits, band = 0, min(k // 3, MAX_EDITS)
        if not _inside(x, y):
            edits = _distance(x, y, int(np.median(iy[at[met]] - ix[met])), max(1, band))
        if edits > band:  # not by edits, or by more than the band holds: the definition itself
            sx, sy = spelled(left), spelled(right)
            edits, both, n = None, len(sx & sy), len(sx)
        return (e, t, both / n, edits) if edits is not None or both * least[1] >= least[0] * n else None

    return run


@dataclass(frozen=True)
class Overlaps:
    """found (e, t, containment, edits): pairs of classes of records of the same words, by their least ids; evaluation and training (id, rep): the members of each side's classes."""

    found: DataFrame
    evaluation: DataFrame
    training: DataFrame

    def pairs(self) -> DataFrame:
        """(e, t, containment, edits) of all members."""
        e, t = (m.select(F.col("id").alias(x), F.col("rep").alias(f"rep_{x}")) for m, x in ((self.evaluation, "e"), (self.training, "t")))
        found = self.found.select(F.col("e").alias("rep_e"), F.col("t").alias("rep_t"), "containment", "edits")
        return found.join(e, "rep_e").join(t, "rep_t").select("e", "t", "containment", "edits")


def split_overlaps(records: DataFrame, rec_id: str = "rec_id", split: str = "split", title: str = "title", text: str = "text", min_words: int = 20, least: tuple[int, int] = (7, 10)) -> Overlaps:
    """Pairs of an evaluation and a training record that share at least least (a fraction) of the smaller one's word triples.

    A segment join for edit distance over words. The smaller record has n triples
    and may lose k = n - least * n of them; an edit of a word costs at most three.
    Of any k + 1 of its segments (runs of three words) one remains, so each record
    chooses k + 1 and a few more, the rarest ones (notices come last), and they meet
    the other side's segments at any position, as excerpts and texts in another order
    count too. No pair is lost, whatever its edits. So that only half of all segments
    travel, both sides keep to one half of the hashes; the few records with at most k
    segments in it choose from the other half, where such records' choices filter
    what the other side sends (filters sized by their number, up to FILTER_BITS;
    without them the result is the same).

    Pairs with enough segments in common are verified on the texts: those with too
    few common triples for k / 3 edits or the share fall to the count filter; up to
    k / 3 edits by the words' banded edit distance to a part of the longer record, around
    the median diagonal, make a near copy; for the rest (reordered, more edits, or
    beyond MAX_EDITS) the exact share of triples decides, and edits is null.

    Records of the same words take part once a side. Train is a split that is 'train'
    when trimmed and lower-cased, evaluation any other; rows with null split or id,
    and records under min_words words, are never cases. Null title or text counts as
    empty. Extra columns are ignored.
    """
    side = normal_split(F.col(split))
    rows = records.where(F.col(rec_id).isNotNull())
    cols = (F.col(rec_id).cast("long").alias("id"), F.col(title).alias("title"), F.col(text).alias("text"))
    spark = records.sparkSession
    evaluation = materialize(rows.where(side != "train").select(*cols).mapInArrow(_segments(min_words, least, None), _SCHEMA))
    training = materialize(rows.where(side == "train").select(*cols).mapInArrow(_segments(min_words, least, spark.sparkContext.broadcast(_filter_of(evaluation))), _SCHEMA))
    members = lambda table: table.select("id", "copy").join(table.groupBy("copy").agg(F.min("id").alias("rep")), "copy").select("id", "rep")
    members_e, members_t = members(evaluation), members(training)

    def exploded(table: DataFrame, node: str, *kinds: tuple[Column, int, bool]) -> DataFrame:
        """(h, node, w): one row for each segment and kind of meeting; the kind is part of the key. n, need and whether the record chose the segment are one number, so that rows are short."""
        about = F.shiftleft(F.col("n").cast("bigint"), 32) + F.shiftleft(F.col("need").cast("bigint"), 1)
        row = lambda kind, chosen: lambda h: F.struct((h * 4 + kind).alias("h"), (F.col("about") + int(chosen)).alias("w"))
        marked = F.concat(*(F.transform(column, row(kind, chosen)) for column, kind, chosen in kinds))
        return table.withColumn("about", about).select(F.col("id").alias(node), F.explode(marked).alias("s")).select("s.h", node, F.col("s.w").alias(f"w{node}"))

    reps_e, reps_t = (table.join(materialize(m.where("id <> rep").select("id")), "id", "left_anti") for table, m in ((evaluation, members_e), (training, members_t)))
    chosen, rest, other = map(F.col, ("chosen", "rest", "other"))
    even = F.when(F.col("odd"), F.array().cast("array<bigint>")).otherwise(chosen)
    # kinds: 0 the evaluation record chose the segment, training did not; 1 training chose it; 2 and 3 the same for what odd records chose from the second half. Only the evaluation's choices, the fewer, travel twice
    e = exploded(reps_e, "a", (even, 0, True), (even, 1, True), (rest, 1, False)).unionAll(exploded(reps_e.where("odd"), "a", (chosen, 2, True)))
    t = exploded(reps_t, "b", (rest, 0, False), (even, 1, True), (other, 2, False))
    t = t.unionAll(exploded(reps_t.where("odd"), "b", (chosen, 3, True)))
    sought = _filter_of(training)
    if sought.bits != b"":  # odd records in training are rarer still than in the evaluation, so its second half is made for them only, and only what they look for
        again = rows.where(side != "train").select(*cols).mapInArrow(_seconds(min_words, least, spark.sparkContext.broadcast(sought)), "id bigint, n int, need int, other array<bigint>")
        e = e.unionAll(exploded(again.join(reps_e.select("id"), "id", "left_semi"), "a", (other, 3, False)))
    smaller = F.when(F.shiftright("wa", 32) <= F.shiftright("wb", 32), F.col("wa")).otherwise(F.col("wb"))
    met = e.join(t, "h").select("a", "b", smaller.alias("w")).where(F.col("w").bitwiseAND(1) == 1)
    met = met.groupBy("a", "b", F.shiftright(F.col("w").bitwiseAND((1 << 32) - 1), 1).alias("need")).agg(F.count("*").alias("shared"))
    candidates = materialize(met.where("shared >= need").select("a", "b"))
    found = with_both(candidates, rows, rec_id, title, text).mapInArrow(_verify(least), "e bigint, t bigint, containment double, edits bigint")
    return Overlaps(found, members_e, members_t)


def overlap_report(records: DataFrame, overlaps: Overlaps, rec_id: str = "rec_id", split: str = "split", source: str = "bookshelf_id") -> DataFrame:
    """(split, bookshelf_id, n_records, n_overlapping, n_pairs, n_same): of each evaluation split and source, the records, those with a partner in train, the pairs and those of them without an edit. Null sources are a source of their own; sources without overlaps are listed too. Pairs are counted by the sizes of classes, never written."""
    sizes = overlaps.training.groupBy("rep").agg(F.count("*").alias("size"))
    found = overlaps.found.join(sizes, F.col("t") == F.col("rep"))
    of = found.groupBy(F.col("e").alias("rep")).agg(F.sum("size").alias("pairs"), F.sum(F.when(F.col("edits") == 0, F.col("size")).otherwise(0)).alias("same"))
    kind = normal_split(F.col(split))
    own = records.where(kind != "train").select(F.col(rec_id).alias("e"), kind.alias("split"), F.col(source).alias("bookshelf_id"))
    each = overlaps.evaluation.join(of, "rep").select(F.col("id").alias("e"), "pairs", "same")
    return own.join(each, "e", "left").groupBy("split", "bookshelf_id").agg(F.count("*").alias("n_records"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("same"), F.lit(0)).alias("n_same"))
