"""The training-data operators against brute force, exact round trips and edge tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.differential import compare
from textloom.llm import bpe, encode, lines, neardup, overlap, packing, pieces, setsketch, spans, tokencount, words
from textloom.llm.oracle import oracle_sql
from textloom.llm.queries import queries

DOC = "doc_id bigint, id string, a string, rep string, copy string, title string, text string, bookshelf_id string, lang string, source string, n_removed string"


def docs(rows, data):
    """Documents of (doc_id, title, text, bookshelf_id) with further columns whose names the operators use inside."""
    return rows([(i, "x", "x", "x", "x", title, text, shelf, "en", "s", "x") for i, title, text, shelf in data], DOC)


def found(spark, name):
    return {tuple(r) for r in queries()[name](spark, DATA).collect()}


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.BYTE_BPE_50K), special_tokens={})


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


# --- problem 1


def similar_pairs(items, least=0.7):
    sets = {i: words.triples(w) for i, t, x in items if len(w := words.words_of(t, x)) >= 20}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) * 10 >= 7 * len(sets[a] | sets[b])}


def test_p1_is_brute_force(spark, documents):
    assert found(spark, "p1_found") == similar_pairs([(d["doc_id"], d["title"], d["text"]) for d in documents])


def test_p1_edges(rows):
    base = prose(1, 120).split()
    swapped = base[60:] + base[:60]
    edited = [w if i % 40 else "new" for i, w in enumerate(base)]
    data = [(1, None, " ".join(base), None), (2, None, " ".join(base), None), (3, " ".join(base[:60]), " ".join(base[60:]).upper(), "s"), (4, None, " ".join(swapped), None), (5, "", " ".join(edited), None), (6, None, None, None), (7, "", "", None), (8, None, "few words only", None), (9, None, "few words only", None), (10, None, " ".join(base * 300), None), (None, None, " ".join(base), None), (11, None, prose(2, 5000), None)]
    df = docs(rows, data)
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()}
    assert got == similar_pairs([d[:3] for d in data if d[0] is not None]) and {(1, 2), (1, 3), (1, 4), (1, 5)} <= got
    groups = {r.doc_id: r for r in neardup.near_duplicate_groups(df.where("doc_id is not null")).collect()}
    assert {i for i, r in groups.items() if r.group_id == 1} == {1, 2, 3, 4, 5, 10} and groups[8].group_id == 8 and groups[1].n_copies == 2 and len(groups) == 11
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0 and neardup.near_duplicate_groups(df.limit(0)).count() == 0


def test_p1_groups_of_templates_by_stars(rows):
    """Many filled-in templates: candidates grow with the members, not with their pairs, and a chain of links stays one group."""
    body, n = prose(5, 150), 400
    chain = prose(6, 200).split()
    data = [(i, f"name{i}", body, None) for i in range(n)]
    data += [(1000 + i, None, " ".join(f"c{j}" if j < 12 * i else w for j, w in enumerate(chain)), None) for i in range(8)]
    df = docs(rows, data)
    reps = neardup.representatives(neardup.sketches(df))
    banded = neardup.band_rows(reps)
    shared = banded.join(banded.groupBy("k").count().where("count > 1"), "k", "left_semi")
    assert neardup.star_pairs(shared).count() <= 2 * 32 * n
    group = {d[0]: d[0] for d in data}
    pairs = similar_pairs([d[:3] for d in data])
    for _ in range(9):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: r for r in neardup.near_duplicate_groups(df).collect()}
    assert {i: r.group_id for i, r in got.items()} == group and got[5].group_size == n and (1000, 1007) not in pairs and group[1007] == 1000
    of_one = rows([(i, 0) for i in range(n)], "id bigint, component bigint")
    assert neardup.cross_pairs(shared.where(f"id < {n}"), of_one, rows(None, "a bigint, b bigint")).count() == 0


def test_sketches_merge_and_estimate():
    import numpy as np

    r = np.random.default_rng(1)
    x, y = r.integers(0, 2**63, 900, dtype=np.uint64), r.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = np.concatenate([x[:800], y[:100]]), x
    ka, kb = (setsketch.registers(words.mix(s), 1024) for s in (a, b))
    assert (setsketch.registers(words.mix(np.concatenate([a, b])), 1024) == np.maximum(ka, kb)).all()
    est = setsketch.jaccard(np.array([(ka > kb).sum()]), np.array([(ka < kb).sum()]), np.array([(ka == kb).sum()]), np.array([900.0]), np.array([900.0]))[0]
    assert abs(est - 0.8) < 0.05
    assert (setsketch.registers(np.empty(0, np.uint64), 8) == 0).all()


# --- problem 2, 6 and 7: tokens


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_encoder_is_the_tokenizer(text):
    e = _encoder()
    t = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    import regex

    old = "".join(c for c in text if not 0xA700 < ord(c) < 0xABFF and ord(c) < 0x3000)  # letters newer than an engine's tables may be cut differently
    segments = regex.findall(tokencount.SEGMENTS, old)
    assert "".join(segments) == old
    ids = [i for s in segments for i in e.encode(s)]
    assert len(ids) == sum(map(e.count, segments)) and b"".join(e.bytes_of[i] for i in ids).decode() == old
    if old.isprintable():
        assert ids == t.encode_ordinary(old)


def _encoder(cache=[]):  # noqa: B006
    if not cache:
        cache.append(bpe.Encoder(bpe.read_ranks(bpe.BYTE_BPE_50K), bpe.double_array(bpe.BYTE_BPE_50K)))
    return cache[0]


def test_p2_counts_every_document_once(spark, documents, tokenizer):
    out = queries()["p2_budget"](spark, DATA).collect()
    n = sum(len(tokenizer.encode_ordinary(d["text"] or "")) for d in documents)
    for slicing in ("source", "lang", "domain_name", "source, lang, domain_name", "all"):
        part = [r for r in out if r.slicing == slicing]
        assert sum(r.n_tokens for r in part) == n and sum(r.n_docs for r in part) == len(documents)
    assert {r.lang for r in out if r.slicing == "lang"} <= {"en", "de", "fr", "la", "el", "zh", "und"}


def test_p2_edges(rows):
    shelves = rows([("1", "n", None, "en"), ("2", "n", "logic", "en"), ("2", "n", "logic", "en")], "bookshelf_id string, shelf_name string, domain_name string, main_lang string")
    data = [("./A/b", " ENG ", "1", "one two"), ("a/B", "en-GB", "2", None), (None, None, None, ""), ("", "", "9", "x" * 50_000)]
    df = rows([(i, *d) for i, d in enumerate(data)], "doc_id bigint, source string, lang string, bookshelf_id string, text string")
    out = {(r.slicing, r.source, r.lang, r.domain_name): r for r in tokencount.token_budget(df, shelves).collect()}
    assert out["source", "a/b", None, None].n_docs == 2 and out["lang", None, "en", None].n_tokens == 2 and out["lang", None, "und", None].n_docs == 2
    assert out["domain_name", None, None, "logic"].n_docs == 1 and out["all", None, None, None].n_without_text == 2 and out["all", None, None, None].n_renamed == 4
    assert tokencount.token_budget(df.limit(0), shelves).count() == 0


def test_p6_is_the_tokenizer(spark, documents, tokenizer):
    got = {r.doc_id: r.ids for r in queries()["p6_ids"](spark, DATA).collect()}
    assert got == {d["doc_id"]: tokenizer.encode_ordinary(d["text"] or "") for d in documents}


def test_p6_edges_and_round_trip(rows, tokenizer):
    texts = [None, "", " ", "<|endoftext|> as text", "  \n\n\t x  ", "中文" * 900, "é" * 400, "a" * 3000, "don't 123,456  z", "\U0001f600\U0001f468", "a letter\U0001df25newer than the JVM's tables", prose(4, 20_000)]
    df = docs(rows, [(i, None, t, None) for i, t in enumerate([*texts, *texts])])
    got = {(r.doc_id, r.back): r.ids for r in encode.encode(df, block_chars=5000).withColumn("back", encode.decode(F.col("ids"))).collect()}
    assert got == {(i, t or ""): tokenizer.encode_ordinary(t or "") for i, t in enumerate([*texts, *texts])}
    assert encode.encode(df.limit(0)).count() == 0


def test_p7_packs_everything_once(spark, documents, tokenizer):
    sizes = {d["doc_id"]: len(tokenizer.encode_ordinary(d["text"] or "")) for d in documents}
    out = queries()["p7_containers"](spark, DATA).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert set(by) == set(sizes)
    for i, rs in by.items():
        assert sum(r.n_tokens for r in rs) == sizes[i] and len(rs) == max(1, -(-sizes[i] // 4096))
        at = 0
        for r in sorted(rs, key=lambda r: r.piece_no):
            assert r.start_token == at
            at += r.n_tokens
    room = Counter()
    for r in out:
        room[r.container_id] += r.n_tokens
    assert max(v for k, v in room.items() if k is not None) <= 4096
    assert {r[0] for r in found(spark, "p7_found")} == {i for i, n in sizes.items() if n > 4096}


def test_p7_wastes_little(spark):
    r = random.Random(1)
    p = packing.SumOfSquares(1000)
    sizes = [r.randint(1, 300) for _ in range(3000)]
    level = Counter()
    for s in sizes:
        level[p.place(s)] += s
    assert max(level.values()) <= 1000 and sum(level.values()) == sum(sizes) and p.made <= 1.02 * sum(sizes) / 1000
    full = packing.SumOfSquares(10)
    assert [full.place(10), full.place(10), full.place(4), full.place(6)] == [0, 1, 2, 2]


def test_p7_edges(rows):
    df = docs(rows, [(1, None, None, None), (2, None, "", None), (3, None, "a b c", None), (3, None, "a b c", None), (4, None, " ".join(["x"] * 9000), None)])
    out = sorted((r.doc_id, r.piece_no, r.start_token, r.n_tokens, r.container_id is None) for r in packing.pack(df).collect())
    assert out == [(1, 0, 0, 0, True), (2, 0, 0, 0, True), (3, 0, 0, 3, False), (3, 0, 0, 3, False), (4, 0, 0, 4096, False), (4, 1, 4096, 4096, False), (4, 2, 8192, 808, False)]
    assert packing.pack(df.limit(0)).count() == 0 and packing.fill(packing.pack(df.limit(0))).first().n_containers == 0


# --- problem 3


def repeated(items):
    form = lambda x: " ".join(re.sub("[0-9]+", "0", x).split()).lower()
    size, by = Counter(s for _, s, _ in items), defaultdict(set)
    for i, s, t in items:
        for x in (t or "").split("\n"):
            by[s, form(x)].add(i)
    bad = {k for k, v in by.items() if k[0] is not None and len(k[1]) >= 20 and len(v) >= 5 and len(v) >= 0.05 * size[k[0]]}
    return {(i, n) for i, s, t in items for n, x in enumerate((t or "").split("\n")) if t is not None and (s, form(x)) in bad}


def test_p3_is_brute_force(spark, documents):
    want = repeated([(d["doc_id"], d["bookshelf_id"], d["text"]) for d in documents])
    assert found(spark, "p3_found") == want and want


def test_p3_edges(rows):
    notice = "This notice stands in every text, batch {}"
    data = [(i, None, f"own line number one of text {prose(i, 6)}\r\n  {notice.format(i)} \r\nend", "s") for i in range(20)]
    data += [(100 + i, None, f"{prose(50 + i, 9)}\n{notice.format(7)}", "t") for i in range(3)] + [(200, None, None, "s"), (201, None, "", "s"), (202, None, notice, None), (203, None, "short\n" * 9, "s")]
    data += [(300 + i, None, "short line\nshort line", "u") for i in range(9)]
    df = docs(rows, data)
    table = lines.line_table(df)
    hits = lines.line_occurrences(table, lines.repeated_lines(table))
    assert {tuple(r) for r in hits.collect()} == {(i, 1) for i in range(20)} == repeated([(d[0], d[3], d[2]) for d in data])
    clean = {r.doc_id: r for r in lines.without_lines(df, hits).collect()}
    assert len(clean) == len(data) and clean[4].text == data[4][2].split("\n")[0] + "\nend" and clean[4].n_removed == 1
    assert all(clean[d[0]].text == d[2] for d in data if d[0] >= 20)
    assert lines.repeated_lines(lines.line_table(df.limit(0))).count() == 0


def test_p3_lines_without_excess_come_out(rows):
    """A line that other sources repeat more, and a line of the only source there is: repeated by definition, but no excess."""
    notice = "The same notice for all of them"
    many = [(i, None, f"{notice}\n{prose(i, 8)}" if i < 5 else prose(i, 8), "large") for i in range(100)]
    small = [(1000 + 20 * s + i, None, f"{prose(500 + i, 8)}\n{notice}" if i < 4 else prose(700 + i, 8), f"small{s}") for s in range(5) for i in range(20)]
    for data, cases in ((many + small, {(i, 0) for i in range(5)}), (many, {(i, 0) for i in range(5)})):
        table = lines.line_table(docs(rows, data))
        found = lines.repeated_lines(table).collect()
        (line,) = [r for r in found if r.n_docs == 5 and r.src == "large"]
        assert {tuple(r) for r in lines.line_occurrences(table, lines.repeated_lines(table)).collect()} == cases == repeated([(d[0], d[3], d[2]) for d in data])
        assert line.src_docs == 100 and line.out_of == len(data) - 100 and line.out_docs == (20 if data != many else 0) and not line.excess
    spread = [(i, None, f"{notice}\n{prose(i, 8)}" if i < 50 else prose(i, 8), "s" if i < 100 else "t") for i in range(200)]
    (line,) = lines.repeated_lines(lines.line_table(docs(rows, spread))).collect()
    assert line.excess and line.llr > 50


def test_p3_removes_many_lines(rows):
    text = "\n".join(str(i) for i in range(40_000))
    df = docs(rows, [(1, None, text, "s"), (2, None, "a\nb", "s"), (3, None, None, "s")])
    found = rows([(1, i) for i in range(0, 40_000, 2)] + [(2, 0), (2, 1)], "doc_id bigint, line_no bigint")
    out = {r.doc_id: (r.text, r.n_removed) for r in lines.without_lines(df, found).collect()}
    assert out == {1: ("\n".join(str(i) for i in range(1, 40_000, 2)), 20_000), 2: ("", 2), 3: (None, 0)}


# --- problem 4


def overlapping(items):
    kept = [(i, s.strip().lower() == "train", words.triples(w)) for i, s, t, x in items if s is not None and len(w := words.words_of(t, x)) >= 20]
    return {(min(i, j), max(i, j)) for i, a, x in kept if not a for j, b, y in kept if b and 10 * len(x & y) >= 7 * min(len(x), len(y))}


def test_p4_is_brute_force(spark):
    rs = spark.read.parquet(f"{DATA}/corpus_records.parquet").select("rec_id", "split", "title", "text").collect()
    assert found(spark, "p4_found") == overlapping([tuple(r) for r in rs])


def test_p4_edges(rows):
    base = prose(1, 200).split()
    edited = [w if i % 25 else "new" for i, w in enumerate(base)]
    data = [
        (1, " Train ", None, " ".join(base)), (2, "TEST", "", " ".join(base)), (3, "val", None, " ".join(edited)), (4, "validation", None, " ".join(base[50:90])), (5, None, None, " ".join(base)), (6, "train", None, " ".join(base[100:] + base[:100])),
        (7, "test", None, None), (8, "train", "", ""), (9, "", None, " ".join(base)), (10, "train", None, " ".join(base[120:160])), (11, "val", None, prose(9, 8000) + " " + " ".join(base)), (12, "train", None, " ".join(base)), (13, "val", None, prose(77, 300)),
    ]
    df = rows([(*d, "x", "x", "x") for d in data], "rec_id bigint, split string, title string, text string, id string, n string, bookshelf_id string")
    out = overlap.split_overlaps(df).pairs().collect()
    got = {(min(r.e, r.t), max(r.e, r.t)) for r in out}
    assert got == overlapping(data) and {(1, 2), (1, 3), (1, 4), (1, 9), (2, 10), (1, 11)} <= got
    edits = {(r.e, r.t): r.edits for r in out}
    assert edits[2, 1] == 0 and edits[3, 1] == 8 and edits[2, 6] is None
    report = {(r.split, r.bookshelf_id): r for r in overlap.overlap_report(df, overlap.split_overlaps(df)).collect()}
    assert report["val", "x"].n_records == 4 and report["val", "x"].n_overlapping == 3
    for empty in (df.limit(0), df.where("split = 'val'"), df.where("rec_id = 8")):
        assert overlap.split_overlaps(empty).pairs().count() == 0


def test_p4_without_a_common_segment_of_more_than_a_triple(rows):
    """A train record of the evaluation's words in pieces that share all triples but no run of five words; and odd records, whose segments lie in one half of the hashes."""
    base = [f"w{i}" for i in range(200)]
    stuttered = [w for i in range(0, 198, 2) for w in base[i : i + 4]]
    r = random.Random(3)
    short = [(100 + i, "val", None, " ".join(f"s{i}x{j}" for j in range(22))) for i in range(150)]
    longer = [(1000 + i, "train", None, " ".join(f"u{r.random()}" for _ in range(30)) + " " + t) for i, (_, _, _, t) in enumerate(short)]
    mirrored = [(2000 + i, "train", None, " ".join(f"v{i}x{j}" for j in range(22))) for i in range(150)]
    wide = [(3000 + i, "test", None, " ".join(f"u{r.random()}" for _ in range(30)) + " " + t) for i, (_, _, _, t) in enumerate(mirrored)]
    data = [(1, "val", None, " ".join(base)), (2, "train", None, " ".join(stuttered)), *short, *longer, *mirrored, *wide]
    df = rows(data, "rec_id bigint, split string, title string, text string")
    got = {(min(r.e, r.t), max(r.e, r.t)) for r in overlap.split_overlaps(df).pairs().collect()}
    assert got == overlapping(data) and (1, 2) in got and len(got) == 301
    limit, overlap.FILTER_BITS = overlap.FILTER_BITS, 1
    assert {(min(r.e, r.t), max(r.e, r.t)) for r in overlap.split_overlaps(df).pairs().collect()} == got
    overlap.FILTER_BITS = limit


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10**6))
def test_p4_is_brute_force_on_edited_records(spark, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdef") for _ in range(3)) for _ in range(300)]
    texts = [[r.choice(pool) for _ in range(r.randint(20, 120))] for _ in range(8)]
    data = []
    for i in range(60):
        w = list(r.choice(texts))
        for _ in range(r.randint(0, len(w) // 5)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 2)] = [r.choice(pool)] * r.randint(0, 2)
        if r.random() < 0.3:
            cut = r.randrange(len(w))
            w = w[cut:] + w[:cut]
        data.append((i, r.choice(["train", "val"]), None, " ".join(w)))
    df = spark.createDataFrame(data, "rec_id bigint, split string, title string, text string")
    assert {(min(x.e, x.t), max(x.e, x.t)) for x in overlap.split_overlaps(df).pairs().collect()} == overlapping(data)


def test_edit_distance_is_the_full_table():
    r = random.Random(1)
    for _ in range(300):
        x, y = ([r.choice("abc") for _ in range(r.randint(1, n))] for n in (9, 12))
        row = [0] * (len(y) + 1)
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        for cells in (1 << 21, 0):
            overlap._CELLS = cells
            assert overlap.edit_distance(x, y, 0, 25) == min(row)
    overlap._CELLS = 1 << 21
    assert overlap.edit_distance(list("abcdef"), list("uvwxyz"), 0, 2) == 3


# --- problem 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "End. ", "line\n", "par\n\n", "x" * 50, "。", "\r\n\r\n"]), max_size=120), st.integers(20, 90), st.integers(0, 15))
def test_pieces_cover_and_fit(parts, limit, overlap):
    t = "".join(parts)
    got = pieces.cut(len(t), pieces.text_boundaries(t), limit, overlap, [m.end() for m in re.finditer(r"\s+", t)])
    assert got[0][0] == 0 and got[-1][1] == len(t)
    for (s, e, _), (s2, e2, _) in zip(got, got[1:]):
        assert s2 == max(0, e - overlap) and e2 > e
    assert all(e - s <= limit for s, e, _ in got)


def test_the_first_piece_may_fill_the_limit():
    assert pieces.cut(100, [], 60, 20) == [(0, 60, "forced"), (40, 100, "end")]
    assert pieces.cut(100, [(30, pieces.LINE), (55, pieces.LINE), (60, pieces.LINE)], 60, 20) == [(0, 60, "line"), (40, 100, "end")]


def test_pieces_prefer_paragraphs(rows):
    t = "\n\n".join(" ".join(["Some sentence here."] * 20) for _ in range(40))
    df = docs(rows, [(1, None, t, None), (2, None, "x" * 13_000, None), (3, None, None, None), (4, None, "y" * 6000, None)])
    out = pieces.text_pieces(df).orderBy("item_id", "piece_no").collect()
    assert {r.item_id for r in out} == {1, 2} and all(r.end_at - r.start_at <= 6000 and r.text is not None for r in out)
    assert {r.cut_at for r in out if r.item_id == 1} == {"paragraph", "end"} and {r.cut_at for r in out if r.item_id == 2} == {"forced", "end"}
    assert pieces.text_pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.cut(10, [], 5, 5)


def test_token_pieces(rows):
    ids = [13 if i % 30 == 29 else 198 if i % 100 == 99 else i for i in range(700)]
    ex = rows([(1, ids, [1] * 600 + [0] * 100), (2, ids, [1] * 512 + [0] * 188), (3, None, [1] * 600), (4, ids, None), (5, ids, [0, 1] * 600)], "example_id bigint, input_ids array<int>, attention_mask array<int>")
    out = defaultdict(list)
    for r in pieces.token_pieces(ex).collect():
        out[r.item_id].append(r)
    assert set(out) == {1, 3, 5}
    a, b = sorted(out[1], key=lambda r: r.piece_no)
    assert len(a.token_ids) <= 512 and a.token_ids[-1] in (13, 198) and b.token_ids[:64] == a.token_ids[-64:] and a.token_ids + b.token_ids[64:] == ids[:600]


def test_p5_finds_all(spark, documents):
    ex = spark.read.parquet(f"{DATA}/examples.parquet").collect()
    want = {("document", d["doc_id"]) for d in documents if len(d["text"] or "") > 6000} | {("example", r.example_id) for r in ex if sum(x == 1 for x in r.attention_mask) > 512}
    assert found(spark, "p5_found") == want and want


# --- problem 8


def sharing(items, span=300):
    at = defaultdict(set)
    for i, t in items:
        for k in range(len(t or "") - span + 1):
            at[t[k : k + span]].add(i)
    return {(a, b) for ids in map(sorted, at.values()) for n, a in enumerate(ids) for b in ids[n + 1 :]}


def test_p8_is_brute_force(spark, documents):
    want = sharing([(d["doc_id"], d["text"]) for d in documents])
    assert found(spark, "p8_found") == want and want


def test_p8_edges(rows):
    x, y, z = prose(1, 100)[:300], prose(2, 90), prose(3, 4000)
    data = [(1, y + x + "1"), (2, "2" + x + z), (3, x[:299] + "#"), (4, None), (5, ""), (6, "-" * 5000), (7, "+" + "-" * 700), (8, z), (9, z), (10, "中" * 299), (11, x[1:] + "!"), (None, x), (12, "ab" * 200), (13, "ba" * 200)]
    df = docs(rows, [(i, None, t, None) for i, t in data])
    s = spans.shared_spans(df)
    got = {tuple(r) for r in spans.shared_pairs(s).collect()}
    assert got == sharing([(i, t) for i, t in data if i is not None])
    chars = {r.doc_id: (r.n_chars, r.n_shared, r.n_runs) for r in spans.shared_characters(df, s).where("doc_id is not null").collect()}
    assert chars[1] == (len(y) + 301, 300, 1) and chars[2] == (len(z) + 301, 300 + len(z), 1) and chars[4] == (None, 0, 0) and chars[9] == (len(z), len(z), 1) and chars[3] == (300, 0, 0)
    groups = {r.doc_id: r.group_id for r in spans.span_groups(df, s).collect()}
    assert groups[1] == groups[2] == groups[9] == 1 and groups[3] == 3 and len(groups) == len(data)
    none = spans.shared_spans(df.limit(0))
    assert spans.shared_pairs(none).count() == 0 and spans.shared_characters(df.limit(0), none).count() == 0


def test_p8_a_notice_in_every_document(rows, spark):
    """A notice of 400 characters in all documents: the tables behind p8_shared and p8_groups have rows a document, not a pair."""
    notice, n = prose(7, 200)[:400], 400
    df = docs(rows, [(i, None, prose(1000 + i, 100) + notice + prose(9000 + i, 100), None) for i in range(n)])
    s = spans.shared_spans(df)
    assert s.hits.count() <= 10 * n and s.windows.count() <= 101 * n
    assert all(400 <= r.n_shared < 420 and r.n_runs == 1 for r in spans.shared_characters(df, s).collect())  # a few letters around it agree by chance
    assert {r.group_id for r in spans.span_groups(df, s).collect()} == {0}
    assert spans.shared_pairs(s).count() == n * (n - 1) // 2


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(5, 60)), min_size=1, max_size=4), min_size=2, max_size=7))
def test_p8_is_brute_force_on_pieces(spark, parts):
    sources = [prose(60, 60), prose(61, 60), "ab" * 60, "-" * 90]
    texts = ["".join(sources[k][at : at + n] for k, at, n in ps) for ps in parts]
    df = docs(lambda d, s: spark.createDataFrame(d, s), [(i, None, t, None) for i, t in enumerate(texts)])
    s = spans.shared_spans(df, span=20, gram=12)
    pairs = sharing(list(enumerate(texts)), 20)
    assert {tuple(r) for r in spans.shared_pairs(s).collect()} == pairs
    covered = []
    for i, t in enumerate(texts):
        others = [x for j, x in enumerate(texts) if j != i]
        at = {p for k in range(len(t) - 19) if any(t[k : k + 20] in x for x in others) for p in range(k, k + 20)}
        covered.append(len(at))
    assert [r.n_shared for r in spans.shared_characters(df, s).orderBy("doc_id").collect()] == covered
    group = list(range(len(texts)))
    for _ in texts:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert [r.group_id for r in spans.span_groups(df, s).orderBy("doc_id").collect()] == group


@pytest.mark.parametrize("name", ["p1_groups", "p3_clean", "p4_report", "p5_invariants", "p6_roundtrip", "p8_groups", "p8_shared"])
def test_same_as_sql(spark, name):
    compare(spark, queries()[name], oracle_sql()[name], DATA)


def test_counts_are_the_lengths_of_the_encoding(spark):
    """p2_budget, p6_ids and p7_containers agree on every token of the middle-sized tables."""
    folder = re.sub("sf0.001", "sf0.01", DATA)
    ids = queries()["p6_ids"](spark, folder).select(F.sum(F.size("ids").cast("long")).alias("n"), F.count("*").alias("d")).first()
    budget = [r for r in queries()["p2_budget"](spark, folder).collect() if r.slicing == "source, lang, domain_name"]
    packed = queries()["p7_containers"](spark, folder).agg(F.sum("n_tokens")).first()[0]
    assert sum(r.n_tokens for r in budget) == ids.n == packed and sum(r.n_docs for r in budget) == ids.d
