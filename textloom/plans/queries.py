"""The queries of the core operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import arrays, html, text
from textloom.operators import catalogue, losses, metrics, offsets, order, retention, tokens, windows
from textloom.operators.prefix import ordinals
from textloom.session import new_folder, table
from textloom.sinks import writers
from textloom.sources import pages, readers

Query = Callable[[SparkSession, str], DataFrame]

SEED, MAX_LENGTH, OVERLAP = 42, 64, 40
BASE = "https://books.shelf.example"


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = tokens.WordTokenizer()
    return table(spark, folder, "documents").select("doc_id", tokenizer(F.col("text")).alias("tokens"))


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.sliding_windows(_tokens(spark, folder), "tokens", MAX_LENGTH, OVERLAP)


# --- texts


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


def strip_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.strip_boilerplate(F.col("text")).alias("body"))


def length_filter(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(text.is_present(F.col("text")) & text.long_enough(F.col("text")))
    return docs.select("doc_id", _long(F.length("text")).alias("n_chars"))


def abbrev_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.contains("text", F.lit("viz.")) | F.contains("text", F.lit("_")))
    cleaned = text.clean_text(F.col("text"))
    return docs.select("doc_id", _long(F.length(cleaned)).alias("n_chars"), _long((F.length(cleaned) - F.length(F.replace(cleaned, F.lit("namely"), F.lit("")))) / 6).alias("n_namely"))


def display_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.prefix(F.col("text")).alias("shown"))


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull())
    lines = F.split("text", "\n", -1)
    marked = F.size(F.filter(lines, lambda x: F.contains(x, F.lit(text.START)) | F.contains(x, F.lit(text.END))))
    return docs.select("doc_id", _long(F.size(lines)).alias("n_lines"), _long(marked).alias("n_marked"))


# --- tokens and windows


def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    w = "window_tokens"
    return _windows(spark, folder).select("doc_id", "win", _long(F.size(w)).alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("digest"))


def window_padding(spark: SparkSession, folder: str) -> DataFrame:
    ids, mask, labels = windows.padded(F.col("window_tokens"), MAX_LENGTH, "</s>", "<s>")
    rows = _windows(spark, folder).select("doc_id", "win", ids.alias("ids"), mask.alias("mask"), labels.alias("labels"))
    return rows.select("doc_id", "win", _long(F.size("ids")).alias("width"), _long(arrays.real_tokens(F.col("mask"))).alias("n_real"), F.md5(F.array_join("ids", " ")).alias("ids_digest"), (F.col("ids") == F.col("labels")).alias("labels_equal"))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.vocabulary(_tokens(spark, folder), "tokens").select("token", _long("token_id").alias("token_id"), "n")


def token_totals(spark: SparkSession, folder: str) -> DataFrame:
    size = F.size("window_tokens").cast("bigint")
    return _windows(spark, folder).agg(F.count("*").alias("n_windows"), F.coalesce(F.sum(size), F.lit(0)).alias("n_window_tokens"), F.countDistinct("doc_id").alias("n_docs"))


def split_windows_90_10(spark: SparkSession, folder: str) -> DataFrame:
    return order.split_share(_windows(spark, folder).select("doc_id", "win"), ["doc_id", "win"], SEED)


def split_fixed_test(spark: SparkSession, folder: str) -> DataFrame:
    return order.split_fixed(table(spark, folder, "documents").select("doc_id"), ["doc_id"], SEED)


def epoch_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return order.permuted(table(spark, folder, "documents").select("doc_id"), ["doc_id"], SEED + 1)


def shard_wraparound(spark: SparkSession, folder: str) -> DataFrame:
    docs = order.permuted(table(spark, folder, "documents").select("doc_id"), ["doc_id"], SEED)
    return order.shards(docs, world=3, batch=4).select("doc_id", "shard_pos", "rank", "batch")


def validation_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation keeps the table's order and wraps around too."""
    rows = ordinals(table(spark, folder, "examples").select("example_id"), [], ["example_id"], "pos")
    return order.shards(rows, world=7, batch=4).groupBy("rank").agg(F.count("*").alias("n_rows"), F.max("batch").alias("last_batch"), F.sum("example_id").alias("id_sum"))


def batches(spark: SparkSession, folder: str) -> DataFrame:
    examples = table(spark, folder, "examples").select("example_id", "input_ids", "attention_mask")
    placed = order.shards(ordinals(examples.select("example_id"), [], ["example_id"], "pos"), world=2, batch=4)  # ids only are put in order
    stacked = order.collate(placed.join(examples, "example_id"), "example_id", "input_ids", "attention_mask")
    total = lambda c: F.aggregate(F.flatten(c), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return stacked.select("rank", "batch", _long(F.size("input_ids")).alias("size"), F.array_join("example_id", ",").alias("example_ids"), total("input_ids").alias("id_sum"), total("attention_mask").alias("n_real"))


def example_tokens(spark: SparkSession, folder: str) -> DataFrame:
    ex = table(spark, folder, "examples")
    targets = arrays.shifted_labels(F.col("labels"))
    return ex.select("example_id", arrays.real_tokens(F.col("attention_mask")).alias("n_real"), _long(F.size(arrays.without(F.col("input_ids"), 50256))).alias("n_without_pad"), F.when(F.col("labels").isNotNull(), F.md5(F.array_join(targets, ","))).alias("targets_digest"))


def prompt_split(spark: SparkSession, folder: str) -> DataFrame:
    ex = table(spark, folder, "examples").withColumn("batch", F.floor(F.col("example_id") / 4))
    cut = windows.prompt_split(ex, "input_ids", "attention_mask", "batch", "example_id", pad=50256)
    return cut.select(_long("batch").alias("batch"), "example_id", _long(F.size("prompt")).alias("n_prompt"), _long(F.size("ground_truth")).alias("n_truth"), F.md5(F.array_join("prompt", ",")).alias("prompt_digest"), F.md5(F.array_join("ground_truth", ",")).alias("truth_digest"))


# --- catalogue and corpus


def catalogue_pages(listing: DataFrame) -> DataFrame:
    """(bookshelf_id, page_index, html): pages with the listing's books, for tests of the parser. Of a page's fixed number of books."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = lambda before, c, after: F.coalesce(F.concat(F.lit(before), safe(F.col(c)), F.lit(after)), F.lit(""))
    item = F.concat(F.lit('<li class="booklink">'), part('<a class="link" href="/ebooks/', "id", '"><span class="cell">'), part('<span class="title">', "title", "</span>"), part('<span class="subtitle">', "author", "</span>"), F.lit("</span></a></li>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url", item.alias("h")))), lambda s: s["h"]), "\n")
    return listing.groupBy("bookshelf_id", "page_index").agg(F.concat(F.lit("<html><body><ul>"), body, F.lit("</ul></body></html>")).alias("html"))


def html_titles_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = catalogue_pages(table(spark, folder, "catalogue"))
    items = html.page_items(pages, "html", "bookshelf_id", "page_index")
    return catalogue.books(items, BASE, "bookshelf_id", "page_index").groupBy("bookshelf_id", "page_index", "id", "title", "author", "url").agg(F.count("*").alias("n"))


def page_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of each shelf that a scan reads, with their addresses and numbers of books. The pages are written and read again by their source."""
    saved = new_folder(spark, "pages")
    writers.write_pages(catalogue_pages(table(spark, folder, "catalogue").where(F.col("bookshelf_id").isNotNull() & F.col("page_index").isNotNull())), saved)
    items = F.size(F.split("html", '<li class="booklink">', -1)) - 1
    listed = pages.read_pages(spark, saved).select("bookshelf_id", "page_index", items.alias("n"))
    last = listed.groupBy("bookshelf_id").agg(F.max("page_index").alias("top"))
    asked = last.select("bookshelf_id", F.explode(F.sequence(F.lit(0), F.col("top") + 1)).alias("page_index")).join(listed, ["bookshelf_id", "page_index"], "left").withColumn("n_items", F.coalesce("n", F.lit(0)))
    read = catalogue.pages_until_empty(asked)
    return read.select("bookshelf_id", "page_index", _long("n_items").alias("n_items"), catalogue.page_url(BASE, F.col("bookshelf_id"), F.col("page_index")).alias("url"))


def book_links(spark: SparkSession, folder: str) -> DataFrame:
    books = table(spark, folder, "catalogue").select(catalogue.id_of_link(F.col("url")).alias("linked_id"), F.coalesce("author", F.lit(catalogue.UNKNOWN)).alias("author"))
    return books.groupBy("linked_id", "author").agg(F.count("*").alias("n"))


def catalog_text_join(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "catalogue").where(F.col("title").isNotNull()).select("bookshelf_id", "id").distinct()
    found = catalogue.with_texts(listed, table(spark, folder, "documents"), "id", "book_id", value=_long(F.length("text")))
    return found.groupBy("bookshelf_id", "id").agg(F.count("*").alias("n_texts"), F.sum("content").alias("n_chars"))


def text_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The length of the first text there is: of the corpus record, else of the book's first document. Lengths travel, not texts."""
    size = _long(F.length("text"))
    docs = table(spark, folder, "documents").where(F.col("book_id").isNotNull() & text.is_present(F.col("text"))).groupBy("book_id").agg(F.min(F.struct("doc_id", size.alias("n"))).alias("first"))
    records = table(spark, folder, "corpus_records").select("rec_id", "id", size.alias("own"))
    return records.join(docs, F.col("id") == F.col("book_id"), "left").select("rec_id", catalogue.first_text(F.col("own"), F.col("first.n")).alias("n_chars"))


def json_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return offsets.record_offsets(table(spark, folder, "corpus_records"), "file_path", ["rec_id"])


def shelf_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata document of each shelf and split, by what it says: its file, its number of books, their digest and the file's size."""
    records = table(spark, folder, "corpus_records").withColumn("split", F.lower(F.trim("split")))
    found = offsets.metadata(records, "bookshelf_id", "split", "file_path", "rec_id")
    books = F.transform("books", lambda b: F.concat_ws(",", b["id"], b["start_position"].cast("string"), b["end_position"].cast("string"), b["length"].cast("string")))
    return found.select("bookshelf_id", "split", "file_path", "num_books", "total_chars", F.md5(F.array_join(books, ";")).alias("books_digest"))


def corpus_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return offsets.corpus_totals(table(spark, folder, "corpus_records").withColumn("split", F.lower(F.trim("split"))), "bookshelf_id", "split")


# --- written and read again, in the shared folder


def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of a JSON-lines corpus as they are read from its files."""
    saved = new_folder(spark, "jsonl")
    writers.write_jsonl(table(spark, folder, "corpus_records").select("rec_id", "text"), saved, order=["rec_id"])
    return readers.read_jsonl(spark, saved).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


def json_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The listing of each shelf as one JSON list, which one reader must hold, and read again."""
    saved = new_folder(spark, "lists")
    book = F.struct("id", "title", "author", "url")
    lists = table(spark, folder, "catalogue").groupBy("bookshelf_id").agg(F.to_json(F.collect_list(book)).alias("value"))
    lists.write.partitionBy("bookshelf_id").text(saved)
    return readers.read_json_list(spark, saved).groupBy("id", "title", "author", "url").agg(F.count("*").alias("n"))


def cached_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Examples taken from a cache on the second call; the key holds the source's digest."""
    examples = table(spark, folder, "examples").select("example_id", "input_ids", "attention_mask")
    key, cache = ("examples", writers.content_digest(examples, "example_id")), new_folder(spark, "cache")
    writers.cache(examples, cache, *key)
    again = writers.cache(examples.limit(0), cache, *key)
    return again.select("example_id", _long(F.size("input_ids")).alias("n_ids"), arrays.real_tokens(F.col("attention_mask")).alias("n_real"))


def logged_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics appended in two parts, by run."""
    saved, rows = new_folder(spark, "metrics"), table(spark, folder, "metrics")
    for part in (rows.where("split = 'train'"), rows.where("split = 'val'")):
        writers.append_metrics(part, saved, "run_id")
    read = spark.read.schema(rows.schema).parquet(saved)
    return read.groupBy("run_id", "split").agg(F.count("*").alias("n"), F.max("step").alias("last_step"))


def sample_records(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts and true continuations of an evaluation's samples; the second write of the same step replaces the first."""
    saved = new_folder(spark, "samples")
    ex = table(spark, folder, "examples").withColumn("batch", F.floor(F.col("example_id") / 64))
    cut = windows.prompt_split(ex, "input_ids", "attention_mask", "batch", "example_id", samples=1, pad=50256)
    rows = cut.select("example_id", F.array_join("prompt", " ").alias("prompt"), F.array_join("ground_truth", " ").alias("ground_truth"))
    for _ in range(2):
        writers.append_samples(rows, saved, epoch=1, step=500)
    read = spark.read.schema("example_id bigint, prompt string, ground_truth string, epoch bigint, step bigint").json(saved)
    return read.select("example_id", "epoch", "step", F.md5("prompt").alias("prompt"), F.md5("ground_truth").alias("ground_truth"))


def fetch_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts on pages as events: a scan gives up after its fifth failure, and only status 200 has a page."""
    status = F.when(F.col("event_type") == "error", 503).when(F.col("value") < 20, 404).otherwise(200)
    attempts = table(spark, folder, "events").select((F.col("user_id") % 50).alias("bookshelf_id"), F.col("event_id").alias("attempt"), status.alias("status"))
    made = catalogue.within_failure_budget(attempts)
    pages_read = catalogue.ok_responses(made).groupBy("bookshelf_id").agg(F.count("*").alias("n_pages"))
    return made.groupBy("bookshelf_id").agg(F.count("*").alias("n_attempts")).join(pages_read, "bookshelf_id", "left").select("bookshelf_id", "n_attempts", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


def causal_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Flattened positions with their causal targets: how often each token is to be predicted after which."""
    ex = table(spark, folder, "examples").where(F.col("labels").isNotNull() & (F.size("labels") == F.size("input_ids")))
    rows = losses.causal_targets(ex.select("example_id", F.transform("input_ids", lambda x: F.array(x.cast("double"))).alias("logits"), "labels"), "example_id")
    return rows.groupBy(F.col("logits")[0].cast("bigint").alias("token"), _long("label").alias("label")).agg(F.count("*").alias("n"), F.min("pos").cast("bigint").alias("first_pos"))


def decoded_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of a small vocabulary as text, special ones skipped."""
    words = F.array(*map(F.lit, ("<s>", "</s>", "one", "two", "three")))
    ids = F.transform("input_ids", lambda x: x % 5)
    return table(spark, folder, "examples").select("example_id", F.md5(tokens.decode(ids, words, [0, 1])).alias("digest"))


def checkpoint_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of checkpoints and where runs go on."""
    rows = table(spark, folder, "checkpoints")
    last = retention.resume_position(rows, ["run_id"])
    named = rows.select("run_id", retention.checkpoint_name(F.col("epoch"), F.col("is_best")).alias("name")).groupBy("run_id", "name").agg(F.count("*").alias("n"))
    return named.join(last, "run_id").select("run_id", "name", "n", _long("epochs_run").alias("epochs_run"))


def rank_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Sums over all ranks and over the leading one only."""
    rows = order.shards(ordinals(table(spark, folder, "examples").select("example_id"), [], ["example_id"], "pos"), world=3, batch=4)
    each = lambda scope: order.rank_scope(rows, scope).agg(F.lit(scope).alias("scope"), F.count("*").alias("n"), F.sum("example_id").alias("id_sum"), F.count(F.when(order.leads(F.col("rank")), 1)).alias("n_leading"))
    return each("global").unionAll(each("rank0"))


def file_parts(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "corpus_records")
    return records.groupBy(text.folder_name(F.col("file_path")).alias("folder"), text.file_name(F.col("file_path")).alias("file")).agg(F.count("*").alias("n"))


# --- losses


def _logit_pairs(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    student = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("student"), "label")
    teacher = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("teacher"))
    return losses.position_losses(losses.zip_positions(student, teacher, ("vec_id",)))


def kl_batchmean(spark: SparkSession, folder: str) -> DataFrame:
    return _logit_pairs(spark, folder).select("vec_id", F.round("kd", 6).alias("kl"))


def cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    rows = _logit_pairs(spark, folder)
    return losses.mean_losses(rows, "label", pad=0).select("label", "positions", "targets", F.round(F.nanvl("ntp_loss", F.lit(-1.0)), 6).alias("ntp_loss"))


def combined_loss(spark: SparkSession, folder: str) -> DataFrame:
    return losses.mean_losses(_logit_pairs(spark, folder), pad=0, ratio=0.5).select("positions", "targets", *(F.round(c, 6).alias(c) for c in ("ntp_loss", "kd_loss", "loss")))


def softmax_mass(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    p = arrays.softmax(F.col("z"))
    return vectors.select("vec_id", F.round(F.array_max(p), 6).alias("most"), F.round(arrays.total(p), 6).alias("mass"))


# --- metrics


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.latest(table(spark, folder, "metrics"), ["run_id", "step", "split"], "ingested_at")


def latest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder).groupBy("run_id", "split").agg(F.count("*").alias("n_steps"), F.max("step").alias("last_step"), F.date_format(F.max("ingested_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ingested"))


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    names = ("loss", "ntp_loss", "kd_loss")
    rows = _metrics(spark, folder).where("split = 'val'").withColumns({c: metrics.finite(F.col(c), 100.0) for c in names}).withColumn("batch", F.floor(F.col("step") / 500))
    out = metrics.evaluation(rows, "run_id")
    return out.select("run_id", "batches", *(F.round(c, 9).alias(c) for c in (*names, "perplexity")))


def capped_eval(spark: SparkSession, folder: str) -> DataFrame:
    """The first twelve batches of each run's evaluation, whatever the run's steps."""
    rows = _metrics(spark, folder).where("split = 'val'").withColumn("loss", metrics.finite(F.col("loss"), 100.0))
    return metrics.evaluation(rows, "run_id", batch="step", losses=("loss",), steps=12).select("run_id", "batches", F.round("loss", 9).alias("loss"), F.round("perplexity", 9).alias("perplexity"))


_LOSSES = ("loss", "ntp_loss", "kd_loss")


def _training(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder).where("split = 'train'").withColumns({c: metrics.finite(F.col(c)) for c in _LOSSES})


def grad_accum(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.accumulated(_training(spark, folder), ["run_id"], ["step"]).select("run_id", "optimizer_step", *(F.round(c, 9).alias(c) for c in _LOSSES))


def epoch_means(spark: SparkSession, folder: str) -> DataFrame:
    steps = metrics.accumulated(_training(spark, folder), ["run_id", "epoch"], ["step"])
    return steps.groupBy("run_id", "epoch").agg(F.count("*").alias("n_steps"), *(F.round(F.avg(c), 9).alias(f"mean_{c}") for c in _LOSSES))


def global_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Optimizer steps done after each micro-batch: one with every fourth of a run, the fourth included."""
    rows = ordinals(_metrics(spark, folder).where("split = 'train'").select("run_id", "step"), ["run_id"], ["step"], "micro")
    return metrics.global_steps(rows, ["run_id"], ["step"], metrics.due(F.col("micro") + 1, 4)).drop("micro")


def _checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "checkpoints").groupBy("run_id", "file_name", "epoch").agg(F.max("val_loss").alias("val_loss"))


def best_so_far(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.best_so_far(_checkpoints(spark, folder), ["run_id"], ["epoch", "file_name"], "val_loss")
    return rows.select("run_id", "epoch", "file_name", "best_before", "improved")


def best_value(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.best_batch(_checkpoints(spark, folder), ["run_id"], ["epoch"], "val_loss")


def checkpoint_retention(spark: SparkSession, folder: str) -> DataFrame:
    rows = _checkpoints(spark, folder).select("run_id", "file_name")
    by_name = retention.retained(rows, 1, ["run_id"])
    return retention.retained(by_name.withColumnRenamed("kept", "kept_by_name"), 1, ["run_id"], numeric=True).withColumnRenamed("kept", "kept_by_number")


def lr_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.schedule(spark, 10, 100, 1e-3, every=50).select("step", F.round("lr", 9).alias("lr"))


def step_triggers(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    step = F.col("step")
    return _metrics(spark, folder).groupBy("run_id").agg(count(metrics.due(step, 200)).alias("n_eval"), count(metrics.due(step, 500)).alias("n_samples"), count(metrics.within_cap(step, 4, 250)).alias("n_capped"), F.count("*").alias("n"))


def run_name(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "metrics").select(text.stamp(F.col("logged_at")).alias("stamp")).groupBy("stamp").agg(F.count("*").alias("n"))


def env_filter(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.where(text.contains_any(F.col("event_type"), ["click", "pur"])).groupBy("event_type").agg(F.count("*").alias("n"))


def model_shrink(spark: SparkSession, folder: str) -> DataFrame:
    sizes = spark.range(0, 33 * 8).select((F.col("id") % 33).alias("size"), (F.floor(F.col("id") / 33) + 1).cast("bigint").alias("factor"))
    return sizes.select("size", "factor", arrays.shrink(F.col("size"), F.col("factor")).alias("shrunk"))


def queries() -> dict[str, Query]:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n not in ("queries", "catalogue_pages") and n[0] != "_"}
