"""Order, windows, offsets, losses, metrics and retention on edge tables and against restatements."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays
from textloom.operators import catalogue, losses, metrics, offsets, order, retention, tokens, windows
from textloom.operators.prefix import ordinals, prefix_sums


@pytest.mark.parametrize(("max_length", "overlap", "n", "want"), [(9, 7, 0, [(0, 0)]), (9, 7, 8, [(0, 8)]), (9, 7, 9, [(0, 8), (1, 9)]), (16, 5, 30, [(0, 15), (10, 25), (20, 30)])])
def test_windows(rows, max_length, overlap, n, want):
    df = rows([(1, list(range(n)))], "id int, t array<int>")
    got = windows.sliding_windows(df, "t", max_length, overlap).orderBy("win").collect()
    assert [r.window_tokens for r in got] == [list(range(a, b)) for a, b in want]


def test_many_windows_and_bad_overlap(rows):
    df = rows([(1, [0] * 100_000), (2, None)], "id int, t array<int>")
    assert windows.sliding_windows(df, "t", 512, 380).count() == 761
    with pytest.raises(ValueError):
        windows.sliding_windows(df, "t", 9, 8)


def test_padding(rows):
    ids, mask, labels = windows.padded(F.col("t"), 5, 0, 9)
    r = rows([([1, 2],)], "t array<int>").select(ids.alias("i"), mask.alias("m"), labels.alias("l")).first()
    assert (r.i, r.m, r.l) == ([9, 1, 2, 0, 0], [1, 1, 1, 0, 0], [9, 1, 2, 0, 0])


@pytest.mark.parametrize(("n", "train"), [(19, 17), (10, 9), (1, 0), (0, 0)])
def test_split_sizes(spark, n, train):
    got = order.split_share(spark.range(n), ["id"], 7).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got}.get("train", 0) == train


def test_permutation_depends_on_the_seed(spark):
    a, b, c = ([r.id for r in order.permuted(spark.range(200), ["id"], s).orderBy("pos").collect()] for s in (1, 2, 1))
    assert a == c != b and sorted(a) == list(range(200))


@pytest.mark.parametrize(("n", "world"), [(10, 4), (1, 4), (2, 7), (8, 4), (0, 3)])
def test_shards_wrap_around(spark, n, world):
    df = spark.range(n).withColumn("pos", F.col("id"))
    got = order.shards(df, world, 2).collect()
    size = -(-n // world) * world
    assert sorted((r.shard_pos, r.id) for r in got) == [(p, p % n) for p in range(size)]
    assert all(r.rank == r.shard_pos % world and r.batch == r.shard_pos // world // 2 for r in got)
    assert order.shards(df, world, 2, drop_last=True).count() == n // world * world


def test_prefix_sums_with_a_hot_and_a_null_group(rows):
    random.seed(3)
    data = [("hot" if i % 3 else None if i % 2 else "x", i, random.randint(0, 9)) for i in range(600)]
    got = prefix_sums(rows(data, "g string, o int, v int"), ["g"], ["o"], {"s": F.col("v")}).collect()
    want, run = {}, {}
    for g, o, v in data:
        want[o] = run.get(g, 0)
        run[g] = run.get(g, 0) + v
    assert {r.o: r.s for r in got} == want
    assert ordinals(rows(None, "g string, o int"), [], ["o"]).count() == 0


def test_offsets_cut_out_the_lines(rows):
    from textloom.functions.text import json_line

    data = [("f", 1, 'a"b'), ("f", 2, None), ("f", 3, "é\n\U0001f600"), ("g", 4, "")]
    df = rows(data, "file string, o int, text string")
    lines = {r.o: r.j for r in df.select("o", json_line(F.col("text")).alias("j")).collect()}
    for unit in ("characters", "bytes"):
        for r in offsets.record_offsets(df, "file", ["o"], unit=unit).collect():
            whole = "".join(lines[o] + "\n" for f, o, _ in data if f == r.file)
            part = whole[r.start_position : r.end_position] if unit == "characters" else whole.encode()[r.start_position : r.end_position].decode()
            assert part == lines[r.o]


def test_losses_like_numpy(rows):
    rng = np.random.default_rng(0)
    s, t = rng.normal(size=(6, 5)) * 50, rng.normal(size=(6, 5))
    label = [0, 1, 2, 3, 4, 0]
    df = rows([(i, s[i].tolist(), t[i].tolist(), label[i]) for i in range(6)], "i int, student array<double>, teacher array<double>, label int")
    each = losses.position_losses(df)
    r = losses.mean_losses(each, pad=0, ratio=0.25).first()
    logp = lambda z: z - z.max(1, keepdims=True) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True))
    ls, lt = logp(s), logp(t)
    ce = -np.mean([ls[i, x] for i, x in enumerate(label) if x])
    kl = (np.exp(lt) * (lt - ls)).sum(1).mean()
    assert math.isclose(r.ntp_loss, ce) and math.isclose(r.kd_loss, kl) and math.isclose(r.loss, 0.25 * kl + 0.75 * ce)
    none = losses.mean_losses(each.where("label = 0"), pad=0).first()
    assert math.isnan(none.ntp_loss) and math.isnan(none.loss) and not math.isnan(none.kd_loss)


def test_causal_targets(rows):
    df = rows([(1, [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]], [7, 8, 9]), (2, [], [])], "id int, logits array<array<double>>, labels array<int>")
    assert [(r.id, r.pos, r.logits, r.label) for r in losses.causal_targets(df, "id").orderBy("pos").collect()] == [(1, 0, [0.0, 1.0], 8), (1, 1, [2.0, 3.0], 9)]


def test_evaluation_is_a_mean_of_batch_means(rows):
    df = rows([(400, 1.0), (400, 3.0), (3100, 8.0), (9000, 100.0)], "batch int, loss double")  # batches are capped by their place, not by their number
    r = metrics.evaluation(df, losses=("loss",), steps=2).first()
    assert (r.batches, r.loss) == (2, 5.0) and math.isclose(r.perplexity, math.exp(5))


def test_accumulation(rows):
    df = rows([("r", i, float(i), 2.0 * i, 0.0) for i in range(10)], "run string, step int, loss double, ntp_loss double, kd_loss double")
    assert sorted(tuple(x) for x in metrics.accumulated(df, ["run"], ["step"]).collect()) == [("r", 0, 0.75, 1.5, 0.0), ("r", 1, 1.75, 3.5, 0.0)]
    steps = metrics.global_steps(df, ["run"], ["step"], F.pmod(F.col("step") + 1, F.lit(4)) == 0).orderBy("step").collect()
    assert [r.global_step for r in steps] == [0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_best_so_far(rows):
    df = rows([("r", 1, 3.0), ("r", 2, 2.0), ("r", 3, 2.0), ("r", 4, float("nan")), ("r", 5, None)], "run string, epoch int, val double")
    assert [r.improved for r in metrics.best_so_far(df, ["run"], ["epoch"], "val").orderBy("epoch").collect()] == [True, True, False, False, False]
    assert tuple(metrics.best_batch(df, ["run"], ["epoch"], "val").first()) == ("r", 2.0, 2)


def test_learning_rate(rows):
    df = rows([(0,), (50,), (100,), (1000,)], "s int").select(metrics.learning_rate(F.col("s"), 1000, 100))
    assert [r[0] for r in df.collect()] == [0.0, 0.5, 1.0, 0.0]


def test_latest_and_caps(rows):
    df = rows([("a", 1, 5.0), ("a", 2, 4.0), ("a", 2, 4.0), (None, 1, 1.0)], "k string, v int, x double")
    assert sorted((tuple(r) for r in metrics.latest(df, ["k"], "v").collect()), key=repr) == [("a", 2, 4.0), (None, 1, 1.0)]
    s = rows([(i,) for i in range(10)], "s int")
    assert s.where(metrics.within_cap(F.col("s"), 4, 2)).count() == 8 and s.where(metrics.within_cap(F.col("s"), 4, None)).count() == 10


@pytest.mark.parametrize(("keep", "numeric", "want"), [(1, False, {"checkpoint_epoch_5.pt"}), (1, True, {"checkpoint_epoch_100.pt"}), (0, False, {f"checkpoint_epoch_{e}.pt" for e in (5, 15, 100)})])
def test_retention(rows, keep, numeric, want):
    files = [f"checkpoint_epoch_{e}.pt" for e in (5, 15, 100)] + ["best_model.pt"]
    got = retention.retained(rows([(f,) for f in files], "file_name string"), keep, numeric=numeric).where("kept").collect()
    assert {r.file_name for r in got} == want | {"best_model.pt"}


def test_books_of_items(rows):
    df = rows([(" T ", None, "/ebooks/1?x"), ("U", "", "/ebooks/2/"), (None, "A", "/ebooks/3"), ("V", "B", None)], "title string, subtitle string, link string")
    assert sorted(tuple(r) for r in catalogue.books(df, "http://h").collect()) == [("", "U", "", "http://h/ebooks/"), ("1?x", "T", "Unknown", "http://h/ebooks/1?x")]


def test_pages_stop_at_the_first_empty_one(rows):
    df = rows([("a", 0, 3), ("a", 1, 0), ("a", 2, 5), ("b", 0, 1)], "bookshelf_id string, page_index int, n_items int")
    assert sorted((r[0], r[1]) for r in catalogue.pages_until_empty(df).collect()) == [("a", 0), ("b", 0)]


def test_metadata_has_sizes_and_paths(rows):
    import json

    from textloom.functions.text import json_line

    data = [("5", "train", "a/t.jsonl", 2, "7", "T", None, "u", 'é"'), ("5", "train", "a/t.jsonl", 1, "8", None, "A", "v", "x\ny"), ("5", "test", "a/s.jsonl", 3, "9", "T", "A", "w", "z"), ("5", "train", "a/t.jsonl", 4, "1", "T", "A", "w", ""), ("6", None, "b", 5, "2", "T", "A", "w", "q")]
    df = rows(data, "shelf string, split string, file string, o int, id string, title string, author string, url string, text string")
    found = offsets.metadata(df, "shelf", "split", "file", "o")
    docs = {r.shelf: json.loads(r.document) for r in offsets.metadata_documents(found, "shelf", "split").collect()}
    lines = [r.j for r in df.where("shelf = '5' and split = 'train' and text <> ''").orderBy("o").select(json_line(F.col("text")).alias("j")).collect()]
    train = docs["5"]["train"]
    assert train["num_books"] == 2 and train["total_chars"] == len("".join(x + "\n" for x in lines).encode()) and train["file_path"] == "a/t.jsonl" and train["format"] == "jsonl"
    assert [(b["id"], b["start_position"], b["end_position"], b["length"]) for b in train["books"]] == [("8", 0, len(lines[0]), 3), ("7", len(lines[0]) + 1, len(lines[0]) + 1 + len(lines[1]), 2)]
    assert docs["5"]["test"]["books"][0]["title"] == "T" and docs["5"]["bookshelf_id"] == "5" and "train" not in docs["6"]


def test_digits_grow_with_the_rows():
    assert [order._digits(n) for n in (0, 10**9, 1 << 32, (1 << 32) + 1, 10**13)] == [3, 3, 3, 4, 6]


def test_vocabulary_and_decode(rows):
    df = rows([(["b", "a", "b"],), ([""],), (None,)], "t array<string>")
    assert [(r.token, r.token_id, r.n) for r in tokens.vocabulary(df, "t").orderBy("token_id").collect()] == [("a", 2, 1), ("b", 3, 2)]
    assert rows([([0, 2, 3],)], "i array<int>").select(tokens.decode(F.col("i"), F.array(F.lit("<s>"), F.lit("</s>"), F.lit("a"), F.lit("b")), [0, 1])).first()[0] == "a b"
    assert rows([(7, 2), (1, 5)], "s int, f int").select(arrays.shrink(F.col("s"), F.col("f"))).collect() == [(3,), (1,)]


def test_failures_use_up_a_budget(rows):
    df = rows([("a", i, 200 if i % 2 else 500) for i in range(12)] + [("b", 0, 404)], "bookshelf_id string, attempt int, status int")
    got = catalogue.within_failure_budget(df)
    assert sorted(r.attempt for r in got.where("bookshelf_id = 'a'").collect()) == list(range(9)) and catalogue.ok_responses(got).count() == 4


def test_documents_are_split_whole(rows):
    df = rows([(i // 5, i) for i in range(100)], "doc int, win int")
    got = order.split_documents(df, "doc", 3).groupBy("doc").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r.n == 1 for r in got) and sum(r.s == "train" for r in got) == 18


def test_scopes_and_ranks(rows):
    df = rows([(0,), (1,), (None,)], "rank int")
    assert order.rank_scope(df, "rank0").count() == 1 and order.rank_scope(df).count() == 3 and df.where(order.leads(F.col("rank"))).count() == 2
    with pytest.raises(ValueError):
        order.rank_scope(df, "x")


def test_prompts_and_resuming(rows):
    ex = rows([(0, i, [i, 1, 2, 9, 9], [1, 1, 1, 0, 0]) for i in range(3)], "batch int, id int, ids array<int>, mask array<int>")
    half = windows.prompt_split(ex, "ids", "mask", "batch", "id", pad=9).orderBy("id").collect()
    assert [(r.prompt, r.ground_truth) for r in half] == [([0], [1, 2]), ([1], [1, 2])]
    fixed = windows.prompt_split(ex, "ids", "mask", "batch", "id", samples=1, pad=9, prompt_length=100).first()
    assert fixed.prompt == [0, 1, 2, 9, 9] and fixed.ground_truth == []
    assert tuple(retention.resume_position(rows([("r", 4), ("r", 9)], "run string, epoch int"), ["run"]).first()) == ("r", 10)
