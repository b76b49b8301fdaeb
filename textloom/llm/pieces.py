"""Problem 5: oversized items cut at natural boundaries."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORCED, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
KINDS = ("forced", "word", "sentence", "line", "paragraph")
#: Ends of paragraphs, lines and sentences; the boundary is where the match ends.
_ENDS = re.compile(r"(?P<p>\n[^\S\n]*(?:\n[^\S\n]*)+)|(?P<l>\n)|(?P<s>(?:[.!?;:;·]+[\"'’”»)\]]*[^\S\n]+|[。！？；]+[”’]*))")
_SPACE = re.compile(r"\s+")


def text_boundaries(text: str) -> list[tuple[int, int]]:
    """(position, strength) of the natural boundaries inside a text."""
    found = []
    for m in _ENDS.finditer(text):
        if m.end() < len(text):
            found.append((m.end(), PARAGRAPH if m["p"] else LINE if m["l"] else SENTENCE))
    return found


def token_boundaries(ids: Sequence[int], sentence: int = 13, line: int = 198) -> list[tuple[int, int]]:
    """(position, strength) after ends of sentences and lines; two ends of lines in a row end a paragraph."""
    found = []
    for i, x in enumerate(ids[:-1]):
        if x == line:
            if ids[i + 1] != line:
                found.append((i + 1, PARAGRAPH if i and ids[i - 1] == line else LINE))
        elif x == sentence and ids[i + 1] != line:
            found.append((i + 1, SENTENCE))
    return found


def atoms(n: int, boundaries: list[tuple[int, int]], room: int, spaces: list[int], first: int) -> list[tuple[int, int]]:
    """(end, strength) of the atomic segments: those between boundaries, cut where longer than room (first for the one at the start), at the last of spaces if there is one and else anywhere."""
    out, start, k = [], 0, 0
    for end, strength in [*boundaries, (n, PARAGRAPH)]:
        while end - start > (most := room if start else first):
            while k < len(spaces) and spaces[k] <= start + most:
                k += 1
            at = spaces[k - 1] if k and spaces[k - 1] > start else 0
            start = at or start + most
            out.append((start, WORD if at else FORCED))
        if end > start:
            out.append((end, strength))
            start = end
    return out


def merge(segments: list[tuple[int, int]], room: int, first: int) -> list[tuple[int, int]]:
    """Agglomerative merging: of all boundaries between neighbours the weakest goes first (of equals the one whose neighbours are smallest together, then the first), if both fit into room, or into first at the start, where no overlap comes before.

    A boundary that does not fit never will, as segments only grow; so each is decided once, and once more when the segment before it comes to begin at the start.
    """
    n = len(segments)
    start = [0, *(end for end, _ in segments[:-1])]
    end = [e for e, _ in segments]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(segments[i][1], end[i + 1] - start[i], i) for i in range(n - 1)]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        strength, size, i = heapq.heappop(heap)  # the boundary at the end of segment i
        if gone[i] or after[i] >= n:
            continue
        j = after[i]
        now = end[j] - start[i]
        if now > (room if start[i] else first):
            continue
        if now != size:
            heapq.heappush(heap, (strength, now, i))
            continue
        # i joins j; j keeps its own end's boundary
        start[j], gone[i] = start[i], True
        before[j] = before[i]
        if before[j] >= 0:
            after[before[j]] = j
        if not start[j] and after[j] < n:
            heapq.heappush(heap, (segments[j][1], end[after[j]] - start[j], j))
    return [(end[i], segments[i][1]) for i in range(n) if not gone[i]]


def cut(n: int, boundaries: list[tuple[int, int]], limit: int, overlap: int, spaces: list[int] = []) -> list[tuple[int, int, str]]:  # noqa: B006
    """(start, end, kind of the boundary at the end): pieces of at most limit that cover n units; each but the first repeats the last overlap units before it."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if n <= limit:
        return [(0, n, "end")]
    cores = merge(atoms(n, boundaries, limit - overlap, spaces, limit), limit - overlap, limit)
    out, start = [], 0
    for end, strength in cores:
        out.append((max(0, start - overlap) if start else 0, end, "end" if end == n else KINDS[strength]))
        start = end
    return out


_SCHEMA = "item_kind string, item_id bigint, piece_no bigint, n_pieces bigint, start_at bigint, end_at bigint, cut_at string, text string, token_ids array<int>"
_ARROW = pa.schema([("item_kind", pa.string()), *((c, pa.int64()) for c in ("item_id", "piece_no", "n_pieces", "start_at", "end_at")), ("cut_at", pa.string()), ("text", pa.string()), ("token_ids", pa.list_(pa.int32()))])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_ARROW), _ARROW)], schema=_ARROW)


def text_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 6000, overlap: int = 200) -> DataFrame:
    """Pieces of the documents of more than limit characters (code points): ends of paragraphs are kept before ends of lines, those before ends of sentences, those before blanks.

    Only oversized texts leave the JVM, and no row is shuffled. Null and short texts
    have no pieces. start_at and end_at count characters; text is the stored text between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                found = cut(len(t), text_boundaries(t), limit, overlap, [m.end() for m in _SPACE.finditer(t)])
                rows += [("document", i, k, len(found), s, e, kind, t[s:e], None) for k, (s, e, kind) in enumerate(found)]
            yield _table(rows)

    return docs.where(F.length(text) > limit).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _SCHEMA)


def token_pieces(examples: DataFrame, example_id: str = "example_id", ids: str = "input_ids", mask: str = "attention_mask", limit: int = 512, overlap: int = 64, sentence: int = 13, line: int = 198) -> DataFrame:
    """Pieces of the token sequences with more than limit real tokens (ones in mask). start_at and end_at count real tokens. A null sequence, or one shorter than its mask, is cut as far as it goes; null mask: no pieces."""
    ones = F.size(F.filter(mask, lambda x: x == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x, m in zip(*(c.to_pylist() for c in batch.columns)):
                real = [t for t, one in zip(x or [], m) if one == 1]
                found = cut(len(real), token_boundaries(real, sentence, line), limit, overlap)
                rows += [("example", i, k, len(found), s, e, kind, None, real[s:e]) for k, (s, e, kind) in enumerate(found)]
            yield _table(rows)

    return examples.where(ones > limit).select(F.col(example_id).cast("long").alias("id"), F.col(ids).alias("ids"), F.col(mask).alias("mask")).mapInArrow(run, _SCHEMA)


def cut_items(pieces: DataFrame) -> DataFrame:
    """(item_kind, item_id): what had to be cut; each item has one first piece."""
    return pieces.where(F.col("piece_no") == 0).select("item_kind", "item_id")


def invariants(pieces: DataFrame, limits: dict[str, tuple[int, int]] = {"document": (6000, 200), "example": (512, 64)}) -> DataFrame:  # noqa: B006
    """(item_kind, item_id, size, fits, covers, repeats, whole): of each item that was cut, its size and whether all pieces fit their limit, cover it from start to end, begin the overlap before the last one's end (or at the start), and hold as much as their positions say. Pieces are gathered by item, never by more."""
    rows = F.array_sort(F.collect_list(F.struct("piece_no", "start_at", "end_at", F.coalesce(F.length("text"), F.size("token_ids")).cast("long").alias("n"))))
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for kind, v in limits.items() for x in (kind, v[i]))), F.col("item_kind"))
    items = pieces.groupBy("item_kind", "item_id").agg(rows.alias("p"))
    start = F.transform(F.slice("p", 2, F.size("p")), lambda x: x["start_at"])
    wanted = F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: F.greatest(F.lit(0).cast("long"), x["end_at"] - of(1)))
    return items.select(
        "item_kind", "item_id", F.element_at("p", -1)["end_at"].alias("size"), F.forall("p", lambda x: x["end_at"] - x["start_at"] <= of(0)).alias("fits"),
        (F.element_at("p", 1)["start_at"] == 0).alias("covers"), (start == wanted).alias("repeats"), F.forall("p", lambda x: x["n"] == x["end_at"] - x["start_at"]).alias("whole"),
    )
