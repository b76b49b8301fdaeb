"""Compares p1_found, p4_found and p8_found with brute force on whole tables; prints numbers of pairs and what is missing or too many."""

from __future__ import annotations

import os
import sys
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], *filter(None, [os.environ.get("PYTHONPATH")])])

import numpy as np
import pyarrow.dataset as ds

from textloom.llm.queries import queries
from textloom.llm.words import triples, words_of
from textloom.session import build


def by_triples(rows: list[tuple], partners) -> tuple[dict, Counter]:
    """Sets of triples by id, and how many each pair that partners allows has in common, by an inverted index."""
    sets = {i: triples(w) for i, title, text in rows if len(w := words_of(title, text)) >= 20}
    at = defaultdict(list)
    for i, s in sets.items():
        for t in s:
            at[t].append(i)
    return sets, Counter(p for ids in at.values() for p in combinations(sorted(ids), 2) if partners(*p))


def main(folder: str) -> None:
    read = lambda name, *columns: [tuple(r.values()) for r in ds.dataset(f"{folder}/{name}.parquet").to_table(list(columns)).to_pylist()]
    docs = read("documents", "doc_id", "title", "text")
    sets, met = by_triples(docs, lambda a, b: True)
    p1 = {p for p, n in met.items() if 10 * n >= 7 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    records = read("corpus_records", "rec_id", "title", "text")
    side = {i: s.strip().lower() == "train" for i, s in read("corpus_records", "rec_id", "split") if s is not None}
    sets, met = by_triples([r for r in records if r[0] in side], lambda a, b: side[a] != side[b])
    p4 = {p for p, n in met.items() if 10 * n >= 7 * min(len(sets[p[0]]), len(sets[p[1]]))}
    hashes = [np.unique(np.fromiter((hash(t[k : k + 300]) for k in range(len(t) - 299)), np.int64)) if t and len(t) >= 300 else np.empty(0, np.int64) for _, _, t in docs]
    h, d = np.concatenate(hashes), np.repeat(np.array([i for i, _, _ in docs]), [len(x) for x in hashes])
    turn = np.argsort(h, kind="stable")
    h, d = h[turn], d[turn]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    p8 = {p for ids in {tuple(sorted(d[lo:hi].tolist())) for lo, hi in zip(cut, cut[1:]) if hi - lo > 1} for p in combinations(ids, 2)}
    spark = build("brute", "local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    for name, want in (("p1_found", p1), ("p4_found", p4), ("p8_found", p8)):
        got = {tuple(r) for r in queries()[name](spark, folder).collect()}
        print(name, "pairs", len(want), "missing", len(want - got), "too many", len(got - want), flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
