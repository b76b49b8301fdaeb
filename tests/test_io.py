"""Sources, sinks, configuration and streams: round trips in temporary folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from textloom import config
from textloom.sinks import writers
from textloom.sources import pages, readers
from textloom.streaming import metrics as stream


def test_jsonl_round_trip(rows, spark, tmp_path):
    texts = ["a\nb", 'q"\\', "中\U0001f600", "\x01 ", "x"]
    df = rows([(i, t) for i, t in enumerate([*texts, None, ""])], "i int, text string")
    writers.write_jsonl(df, str(tmp_path / "j"), order=["i"], single=True)
    assert [r.text for r in readers.read_jsonl(spark, str(tmp_path / "j")).collect()] == texts
    (part,) = (tmp_path / "j").glob("part-*")
    assert part.read_text().split("\n")[0] == json.dumps({"text": texts[0]})


def test_bad_lines_fail(spark, tmp_path):
    for n, line in enumerate(('{"text": 1', '{"other": "x"}')):
        (tmp_path / f"{n}.jsonl").write_text(line + "\n")
        with pytest.raises(Exception):  # noqa: B017
            readers.read_jsonl(spark, str(tmp_path / f"{n}.jsonl")).collect()


def test_texts_and_encodings(spark, tmp_path):
    (tmp_path / "book_7.txt").write_bytes("é\r\n".encode())
    (tmp_path / "book_8.txt").write_bytes("﻿ü".encode("utf-16"))
    (tmp_path / "book_9.txt").write_bytes(b"a\xffb")
    olds = {"cp1252": "Déjà vu, où l'été naît à Noël", "cp1253": "Ἡ".replace("Ἡ", "Η αρχή της σοφίας είναι ο ορισμός των λέξεων"), "cp1251": "Все счастливые семьи похожи друг на друга", "gb18030": "有朋自远方来，不亦乐乎，人不知而不愠，这是他的大话", "utf-16-le": "plain words in two bytes"}
    for name, t in olds.items():
        (tmp_path / f"book_{name}.txt").write_bytes(t.encode(name))
        assert readers.detect_legacy(t.encode(name)) == name
    got = {r.id: r.text for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert got["7"] == "é\r\n" and got["8"].lstrip("﻿") == "ü" and got["9"] == "aÿb"
    assert got["cp1252"] == olds["cp1252"]


def test_json_list_and_listing(spark, tmp_path):
    (tmp_path / "checkpoint_1.json").write_text(json.dumps([{"id": "1", "title": "T"}, {"id": "2"}], indent=2))
    (tmp_path / "other.json").write_text("[]")
    assert [tuple(r) for r in readers.read_json_list(spark, str(tmp_path / "checkpoint_1.json")).orderBy("id").collect()] == [("1", "T", None, None), ("2", None, None, None)]
    assert [r.file_name for r in readers.listing(spark, str(tmp_path), "checkpoint").collect()] == ["checkpoint_1.json"]


def test_page_files(spark, tmp_path):
    for shelf, page in (("5", 0), ("5", 1), ("6", 0)):
        (tmp_path / f"bookshelf_{shelf}_page_{page}.html").write_text(f"<p>{shelf}\n{page}</p>")
    assert sorted(tuple(r) for r in pages.read_page_files(spark, str(tmp_path), "5").collect()) == [("5", 0, "<p>5\n0</p>"), ("5", 1, "<p>5\n1</p>")]
    assert pages.read_page_files(spark, f"file://{tmp_path}").count() == 3


def test_pages_are_written_and_read(rows, spark, tmp_path):
    data = [("5", 0, "<a>\n</a>"), ("5", 1, "é"), ("007", 0, "x\n")]
    for _ in range(2):
        writers.write_pages(rows(data, pages.SCHEMA), str(tmp_path / "p"))
    got = pages.read_pages(spark, str(tmp_path / "p"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(data)
    assert "bookshelf_id" in got.where("bookshelf_id = '5'")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]


def test_pages_are_fetched_until_empty_or_failed(rows, spark):
    def fetch(shelf: str, page: int) -> tuple[int, str]:
        if shelf == "down":
            return 503, ""
        fetch.calls = getattr(fetch, "calls", 0) + 1
        if shelf == "flaky" and fetch.calls % 2:
            return 500, ""
        return 200, f"{shelf} {page}" if page < (9 if shelf == "flaky" else 2) else ""

    shelves = rows([("ok",), ("down",), ("flaky",), (None,)], "bookshelf_id string").coalesce(1)
    got = sorted(tuple(r) for r in pages.scan_pages(shelves, fetch, bool).collect())
    assert [g for g in got if g[0] == "ok"] == [("ok", 0, "ok 0"), ("ok", 1, "ok 1")]
    assert [g[1] for g in got if g[0] == "flaky"] in ([0, 1, 2, 3], [0, 1, 2, 3, 4]) and len({g[0] for g in got}) == 2


def test_cache_and_eviction(rows, spark, tmp_path):
    folder = str(tmp_path / "c")
    df = rows([(1,), (2,)], "x int")
    assert writers.cache(df, folder, "k", 1).count() == 2
    assert writers.cache(rows(None, "x int"), folder, "k", 1).count() == 2
    writers.cache(df.limit(1), folder, "k", 2)
    assert writers.evict(spark, folder, ("k", 1)) == [writers.fingerprint("k", 2)]
    assert writers.content_digest(df, "x") == writers.content_digest(df.orderBy(F.desc("x")), "x") != writers.content_digest(df.limit(1), "x")


def test_metadata_and_samples(rows, spark, tmp_path):
    books = rows([("1", 0, 9)], "id string, start_position int, end_position int")
    document = rows([("5", '{\n  "bookshelf_id" : "5"\n}'), ("6", "{}")], "bookshelf_id string, document string")
    writers.write_metadata(document, str(tmp_path / "m"))
    writers.write_metadata(document.where("bookshelf_id = '6'"), str(tmp_path / "m"))
    (part,) = (tmp_path / "m" / "bookshelf_id=5").glob("part-*")
    assert json.loads(part.read_text()) == {"bookshelf_id": "5"}
    for _ in range(2):
        writers.append_samples(rows([("p", "c")], "prompt string, student_completion string"), str(tmp_path / "s"), 0, 200)
    assert spark.read.json(str(tmp_path / "s")).select("epoch", "step", "prompt").collect() == [(0, 200, "p")]
    df, watch = writers.observed(books, "o", n=F.count(F.lit(1)))
    writers.append_metrics(df, str(tmp_path / "mm"))
    assert watch.get == {"n": 1} and writers.run_folders(spark, str(tmp_path), "x")["plots"].endswith("run_x/plots") and (tmp_path / "run_x" / "plots").is_dir()


def test_config(tmp_path):
    """Every key at its documented place, with values that are not the defaults."""
    p = tmp_path / "c.yaml"
    p.write_text(
        """model:
  name: "an/other-model"
  student:
    reduce_size: false  # a remark
    size_reduction_factor: 3

data:
  sources:
    - path: "data/a.jsonl"
    - path: "data/b.jsonl"
  max_length: 128
  stride: 96
  batch_size: 8

training:
  learning_rate: 2.0e-3
  epochs: 7
  max_steps_per_epoch: 11
  gradient_accumulation_steps: 2
  clip_grad_norm: null
  kd_ratio: 0.25
  seed: 43
  log_every_n_steps: 101
  eval_every: 201
  eval_steps: 202

checkpointing:
  save_every_n_epochs: 6
  keep_n_checkpoints: 2
  resume: "runs/x/best_model.pt"

output:
  dir: "runs/other"

wandb:
  enabled: true
  project: "p"
  name: "n"
  resume_id: "r1"
  tags: []
  notes: ""
  log_every_n_steps: 12
  generate_every_n_steps: 501
"""
    )
    c = config.flatten(config.read_yaml(str(p)))
    assert c == config.Config("an/other-model", False, 3, "data/a.jsonl", 128, 96, 8, 2, 7, 2e-3, 0.1, None, 0.25, 11, 201, 202, 501, 101, 6, 2, "runs/x/best_model.pt", 43, "runs/other", True, 12, "p", "n", "r1")
    assert not [f for f in config.PLACES if getattr(c, f) == getattr(config.Config(), f)]
    assert config._plain(p.read_text()) == config.read_yaml(str(p)) and config._plain(p.read_text())["wandb"]["tags"] == []
    assert config.flatten(config.read_yaml(str(p)), resume_from="by/hand").resume_from == "by/hand"
    empty = config.flatten({"data": {"sources": []}, "training": {"seed": None, "max_steps_per_epoch": None}, "model": None})
    assert empty == config.Config()


def test_stream_is_written_once(rows, spark, tmp_path):
    src, sink, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.range(20).selectExpr("'r' as run_id", "id as step", "cast(0.5 as double) as loss").write.parquet(src)
    for _ in range(2):
        s = stream.triggered(stream.read_metrics(spark, src), 5)
        stream.write_metrics(s, sink, cp).awaitTermination(60)
    assert sorted(r.step for r in spark.read.parquet(sink).select("step").collect()) == [0, 5, 10, 15]


def test_written_tables_are_cleaned_up(rows, spark):
    from textloom import session

    session.clean_up(spark)
    df = session.materialize(rows([(1,), (None,)], "x int"))
    assert df.count() == 2 and session.clean_up(spark) == 1 and session.clean_up(spark) == 0
    with pytest.raises(Exception):  # noqa: B017
        df.collect()


def test_tables_of_few_splits_are_spread(spark, tmp_path):
    from textloom import session

    for n in (1, 4):
        spark.range(4_000_000).repartition(n).write.option("compression", "uncompressed").parquet(str(tmp_path / str(n)))
    one, four = (spark.read.parquet(str(tmp_path / str(n))) for n in (1, 4))
    spread = lambda df: "Repartition" in session.spread(df)._jdf.queryExecution().toString()
    assert spread(one) and not spread(four) and not spread(one.limit(5))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # the reader splits the file itself
    assert not spread(one)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
