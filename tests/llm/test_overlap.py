"""Problem 4: hashes by arrays are those of the words, and no step cuts more words than it needs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from textloom.llm import overlap, words


def texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeßİΣσéд漢字٣²_") for _ in range(r.randint(1, 6))) for _ in range(300)]
    return ["".join(r.choice(pool) + r.choice([" ", "\n", ", ", "_", " "]) for _ in range(r.choice([1, 30, 90]))) for _ in range(n)]


def test_hashed_words_are_the_words():
    every = "".join(chr(c) + ("" if c % 3 else " ") for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    bodies = [words.lowered(None, x) for x in ["", " _ ", "x" * 5000, "ab ba abc acb a b", every, *texts(1, 300)]]
    number: dict[str, int] = {}
    for body, (found, runs) in zip(bodies, words.hashed(iter(bodies), 3), strict=True):
        cut = words.WORD.findall(body)
        assert len(cut) == len(found) and all(number.setdefault(w, h) == h for w, h in zip(cut, found.tolist()))
        assert np.array_equal(runs, words.shingle_hashes(found, 3))
    assert len(set(number.values())) == len(number) > 40_000


def test_pairs_below_the_count_filter_are_never_cut_into_words(monkeypatch):
    def cut(body):
        raise AssertionError("words cut")

    r = random.Random(2)
    prose = [f"w{r.randrange(10**9)}" for _ in range(60)]
    bodies = [words.pack(None, " ".join(x)) for x in (prose, prose[:30] + ["new"] + prose[31:], [f"u{r.randrange(10**9)}" for _ in range(60)])]
    pairs = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([2, 3]), pa.array([bodies[0]] * 2), pa.array(bodies[1:])], ["e", "t", "left", "right"])
    monkeypatch.setattr(overlap, "packed_words", cut)
    (out,) = overlap._verify((7, 10))(iter([pairs]))
    assert [(x["e"], x["t"], x["edits"]) for x in out.to_pylist()] == [(1, 2, 1)]


def test_second_halves_on_demand_are_those_of_the_segments():
    class All:
        value = staticmethod(lambda keys: keys)

    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.nulls(2000, pa.string()), pa.array(texts(3, 2000))], ["id", "title", "text"])
    whole = [x for b in overlap._segments(20, (7, 10), All)(iter([batch])) for x in b.to_pylist()]
    made = [x for b in overlap._seconds(20, (7, 10), All)(iter([batch])) for x in b.to_pylist()]
    assert made == [{c: x[c] for c in ("id", "n", "need", "other")} for x in whole if x["other"]] and {x["odd"] for x in whole} == {True, False}


def test_no_band_is_walked_for_words_in_another_order(monkeypatch):
    def walk(equal):
        raise AssertionError("walked")

    x = np.arange(300)
    monkeypatch.setattr(overlap, "_slides", walk)
    assert overlap._distance(x, np.concatenate([x[150:], x[:150]]), 150, 30) == 31
