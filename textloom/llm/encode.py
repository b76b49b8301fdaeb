"""Problem 6: encoding a whole corpus with a public byte-pair tokenizer."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.bpe import BYTE_BPE_50K, merged, read_ranks
from textloom.llm.tokencount import SEGMENTS, encoder, vocabulary
from textloom.session import materialize

#: Above this many UTF-8 bytes a word is encoded by the walk of bpe.Encoder, linear in its length, as the fold's time grows with the square.
FOLD_BYTES = 256
_P1, _P2 = 65521, 65519  # sizes of the two halves of the rank table
_NONE = 1 << 40


def _places(left, right):
    """Where a pair of ids may stand in the rank table; of integers or columns."""
    return (left * 40503 + right * 10069) % _P1, (left * 28657 + right * 50021) % _P2 + _P1


@lru_cache(maxsize=4)
def merges(path: str) -> dict[tuple[int, int], int]:
    """(left, right) -> id: the last merge that makes each token of more than one byte."""
    ranks = read_ranks(path)
    found = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = merged(token, _Without(ranks, token))
            if len(parts) == 2:
                found[ranks[parts[0]], ranks[parts[1]]] = rank
    return found


class _Without:
    def __init__(self, ranks: dict[bytes, int], token: bytes) -> None:
        self.ranks, self.token = ranks, token

    def get(self, piece: bytes, default: int) -> int:
        return default if piece == self.token else self.ranks.get(piece, default)


@lru_cache(maxsize=4)
def rank_table(path: str) -> str:
    """The rank map as a JSON array with two places for each pair of ids (cuckoo hashing), so that a look-up reads two elements, whatever the map's size. Ids must be below 65,536."""
    table: list[int] = [-1] * (_P1 + _P2)
    for (left, right), rank in merges(path).items():
        entry, at = (left << 32) + (right << 16) + rank, -1
        for _ in range(500):
            one, two = _places(entry >> 32, entry >> 16 & 65535)
            at = two if at == one else one
            entry, table[at] = table[at], entry
            if entry < 0:
                break
        else:
            raise ValueError("the rank table is too small for this vocabulary")
    return json.dumps(table, separators=(",", ":"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _rank(table: Column, left: Column, right: Column) -> Column:
    def by(key: Column) -> Column:
        one, two = (F.element_at(table, (place + 1).cast("int")) for place in _places(left, right))
        return F.when(F.shiftright(one, 16) == key, one.bitwiseAND(65535)).when(F.shiftright(two, 16) == key, two.bitwiseAND(65535)).otherwise(F.lit(_NONE))

    return _let(left * 65536 + right, by)


def fold_merges(word: Column, path: str = BYTE_BPE_50K) -> Column:
    """array<int>: the ids of a word (a segment of the text), by built-in functions only.

    The word's bytes become ids; then as many steps as there are bytes less one each
    merge the adjacent pair of the lowest rank, the leftmost of equals, or do nothing.
    The state holds the ids and the ranks of all adjacent pairs, of which a step
    renews two. The rank map is one literal.
    """
    ranks = read_ranks(path)
    byte_ids = F.array(*(F.lit(ranks[bytes([c])]).cast("bigint") for c in range(256)))
    table = F.from_json(F.lit(rank_table(path)), "array<bigint>")

    def encode(t: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            ids, pairs = state["ids"], state["pairs"]

            def at(least: Column) -> Column:
                def merge(p: Column) -> Column:
                    left = F.when(p > 1, F.array(_rank(t, F.get(ids, (p - 2).cast("int")), least))).otherwise(F.array().cast("array<bigint>"))
                    right = F.when(p + 1 < F.size(ids), F.array(_rank(t, least, F.get(ids, (p + 1).cast("int"))))).otherwise(F.array().cast("array<bigint>"))
                    return F.struct(
                        F.concat(F.slice(ids, 1, p - 1), F.array(least), F.slice(ids, p + 2, F.size(ids))).alias("ids"),
                        F.concat(F.slice(pairs, 1, F.greatest(p - 2, F.lit(0))), left, right, F.slice(pairs, p + 2, F.size(ids))).alias("pairs"),
                    )

                return F.when(least < _NONE, _let(F.array_position(pairs, least).cast("int"), merge)).otherwise(state)

            return _let(F.coalesce(F.array_min(pairs), F.lit(_NONE)), at)

        def start(ids: Column) -> Column:
            pairs = F.transform(F.slice(ids, 2, F.size(ids)), lambda right, i: _rank(t, F.get(ids, i), right))
            return F.aggregate(F.array_repeat(F.lit(0), F.size(ids) - 1), F.struct(ids.alias("ids"), pairs.alias("pairs")), step, lambda s: s["ids"])

        raw = word.cast("binary")
        code = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
        return _let(F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.element_at(byte_ids, code(i) + 1)), start)

    return _let(table, encode).cast("array<int>")


class _Codes(dict):
    """Numbers words in the order of their first look-up."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


_CUT = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.list_(pa.int32())), ("code", pa.int32()), ("word", pa.string())])


def _cut(block_chars: int):
    """Cuts texts into words, once. A task's documents are put into blocks of about block_chars characters; a block comes out as one row a document, with the codes of its words, and one row for each of the block's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, task = regex.compile(SEGMENTS).findall, TaskContext.get().partitionId() << 32
        codes, docs, size = _Codes(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            n, m = len(docs), len(codes)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(c) for _, c in docs)]), pa.int32()), pa.array(np.concatenate([c for _, c in docs])))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, task)), pa.array([i for i, _ in docs], pa.int64()), lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=_CUT)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, task)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int32())), pa.array(np.arange(m), pa.int32()), pa.array(list(codes), pa.string())], schema=_CUT)

        for batch in batches:
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                docs.append((i, np.fromiter(map(codes.__getitem__, segments(t)), np.int32) if t else np.empty(0, np.int32)))
                size += len(t or "")
                if size >= block_chars:
                    yield from flush()
                    codes, docs, size, task = _Codes(), [], 0, task + 1
        if docs:
            yield from flush()

    return run


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with their words' ids put in place of the codes."""
    turn = np.argsort(right.column("code").to_numpy())
    ids = right.column("ids").combine_chunks()
    ids = ids.take(pa.array(turn)) if len(turn) else ids
    flat, lengths = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    words = left.column("codes").combine_chunks()
    codes, per_doc = words.flatten().to_numpy(zero_copy_only=False), words.value_lengths().to_numpy(zero_copy_only=False)
    taken = lengths[codes]
    ends = np.concatenate([[0], np.cumsum(taken)])
    at = np.repeat(starts[codes] - ends[:-1], taken) + np.arange(ends[-1])
    bounds = ends[np.concatenate([[0], np.cumsum(per_doc)])]
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[at], pa.int32()))
    return pa.table({"doc_id": left.column("doc_id"), "ids": lists})


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K, block_chars: int = 8_000_000, fold_words: int = 25_000) -> DataFrame:
    """(doc_id, ids): the token ids of each document without special tokens, whose strings are plain text; an empty list for null and empty texts.

    Texts are cut into words where they lie, once, and written as codes of their
    block's distinct words; a block has about block_chars characters, so what a task
    holds does not depend on how long documents are. The corpus's distinct words are
    encoded once, by a fold of ranked merges in tasks of about fold_words (words of
    more than FOLD_BYTES bytes by a walk over the vocabulary's trie, with the same
    result); each block receives the ids of its own words only, and puts them in
    place of the codes. Repeated rows are encoded each. Letters newer than the pattern library's Unicode version may be cut differently.
    """
    spark = docs.sparkSession
    shared = vocabulary(spark, path)
    cut = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cut(block_chars), "block bigint, doc_id bigint, codes array<int>, code int, word string"))
    own = cut.where(F.col("word").isNotNull()).select("block", "code", "word")
    texts = cut.where(F.col("word").isNull()).select("block", "doc_id", "codes")
    sizes = own.agg(F.count("*").alias("words"), F.countDistinct("block").alias("blocks")).first()
    # a fold's work is more than its bytes show, so partitions must not be merged by size
    words = own.select("word").repartition(max(1, -(-sizes.words // fold_words)), "word").distinct()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encoder(path, shared).encode(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    short = words.where(F.octet_length("word") <= FOLD_BYTES).select("word", fold_merges(F.col("word"), path).alias("ids"))
    long = words.where(F.octet_length("word") > FOLD_BYTES).mapInArrow(walk, "word string, ids array<int>")
    known = materialize(short.unionAll(long))
    blocks = max(1, sizes.blocks)
    ids = own.join(known, "word").select(F.col("block").alias("of"), "code", "ids").repartition(blocks, "of")
    return texts.repartition(blocks, "block").groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(_assemble, "doc_id bigint, ids array<int>")


@lru_cache(maxsize=4)
def _pieces(path: str) -> str:
    by_id = {rank: token for token, rank in read_ranks(path).items()}
    return json.dumps([by_id.get(i, b"").hex() for i in range(max(by_id) + 1)])


def decode(ids: Column, path: str = BYTE_BPE_50K) -> Column:
    """The text of an array of ids: the tokens' binary pieces, concatenated and read as UTF-8; '' for an empty array, null for null. Ids outside the vocabulary give nothing."""
    table = F.from_json(F.lit(_pieces(path)), "array<string>")
    joined = _let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))
    return F.decode(F.unhex(joined), "UTF-8")
