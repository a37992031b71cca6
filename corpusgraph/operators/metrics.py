"""Evaluation metrics and summaries as grouped aggregates."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import categorize, pretokens
from ..functions.vectors import cosine, dot, l2_normalize


def run_stats(status: DataFrame) -> DataFrame:
    """status(status, sections, chunks, error) -> one row of counters with the first ten different errors by name; only
    those ten leave their tasks."""
    done = F.col("status") == "done"
    counts = status.agg(F.count_if(done).alias("processed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.sum("sections").alias("sections"), F.sum("chunks").alias("chunks"), F.avg(done.cast("double")).alias("success_rate"))
    first = status.where("error is not null").select("error").distinct().orderBy("error").limit(10)
    errors = first.agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors"))
    return counts.crossJoin(errors)  # one row each


def cluster_summary(nodes: DataFrame) -> DataFrame:
    """(cluster_id, name, members) with "Cluster id" where no member names it."""
    name = F.coalesce(F.min_by("cluster_name", F.when(F.col("cluster_name").isNotNull(), F.col("id"))), F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))
    return nodes.where("cluster_id is not null").groupBy("cluster_id").agg(name.alias("name"), F.count("*").alias("members"))


def relation_counts(edges: DataFrame) -> DataFrame:
    """One row of counts for each kind; NEUTRAL counts CITES too."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return edges.agg(n("SUPPORT").alias("support"), n("CONTRADICT").alias("contradict"), n("NEUTRAL", "CITES").alias("neutral"), n("SIMILAR").alias("similar"))


def highlighted(edges: DataFrame, kind: str) -> DataFrame:
    """The nodes that edges of a kind touch."""
    return highlighted_links(edges, kind).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def highlighted_links(edges: DataFrame, kind: str) -> DataFrame:
    """The edges of a kind, each pair of ends once."""
    return edges.where(F.col("kind") == kind).select("source_id", "target_id").distinct()


def count_where(df: DataFrame, condition: Column, least: int = 0) -> DataFrame:
    """One row: how many rows meet a condition, and whether they are enough for what waits for them (ready)."""
    n = F.count_if(condition)
    return df.agg(n.alias("n"), (n >= least).alias("ready"))


def citation_counts(df: DataFrame, key: str = "id", cited: str = "cited") -> DataFrame:
    """(key, citations): the size of each row's list, 0 for null."""
    return df.select(key, F.coalesce(F.size(cited), F.lit(0)).cast("long").alias("citations"))


def graph_meta(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_nodes and total_links."""
    return nodes.agg(F.count("*").alias("total_nodes")).crossJoin(edges.agg(F.count("*").alias("total_links")))  # one row and one row


def graph_build_stats(edges: DataFrame) -> DataFrame:
    """One row: papers that edges leave, edges by rule and edges by a model."""
    kind = F.col("kind")
    return edges.agg(F.count_distinct("source_id").alias("papers"), F.count_if(kind.isin("CITES", "SIMILAR")).alias("deterministic"), F.count_if(kind.isin("SUPPORT", "CONTRADICT", "NEUTRAL")).alias("semantic"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """ranked(anchor, item, rank), relevant(anchor, item) -> hits, recall, mrr (of the whole ranking), first_rank and
    n_relevant for each anchor; all zero without relevant items."""
    found = ranked.join(relevant.withColumn("hit", F.lit(True)), ["anchor", "item"], "left").groupBy("anchor").agg(F.count_if(F.col("hit") & (F.col("rank") <= k)).alias("n_hits"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"))
    total = relevant.groupBy("anchor").agg(F.count("*").alias("n_relevant"))
    m = found.join(total, "anchor", "left").fillna(0, ["n_relevant"])
    return m.select("anchor", (F.col("n_hits") > 0).cast("int").alias("hits"), F.when(F.col("n_relevant") > 0, F.col("n_hits") / F.col("n_relevant")).otherwise(0.0).alias("recall"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr"), "first_rank", "n_relevant")


def retrieval_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, hits, recall, mrr): how many anchors a group has and the means of their metrics."""
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("hits", "recall", "mrr")])


def answer_support(answers: DataFrame, sentences: DataFrame, chunks: DataFrame, abstracts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """answers(item, embedding), sentences(item, sentence, embedding) of the answers, chunks(item, embedding), abstracts(item,
    embedding) -> for each answer the best and the mean cosine between it and its chunks, and the share of its sentences
    whose best chunk reaches the threshold. An item without chunks takes its abstract as the only one; all is zero
    without that either, or for an empty answer (a null vector). An answer meets its own chunks alone."""
    own = chunks.where("embedding is not null").select("item", F.col("embedding").alias("chunk"))
    spare = abstracts.where("embedding is not null").join(own.select("item"), "item", "left_anti").select("item", F.col("embedding").alias("chunk"))
    every = own.unionByName(spare)
    a = answers.where("embedding is not null").join(every, "item").select("item", cosine(F.col("embedding"), F.col("chunk")).alias("c"))
    a = a.groupBy("item").agg(F.max("c").alias("best"), F.avg("c").alias("mean"))
    s = sentences.where("embedding is not null").join(every, "item").select("item", "sentence", cosine(F.col("embedding"), F.col("chunk")).alias("c"))
    s = s.groupBy("item", "sentence").agg(F.max("c").alias("c")).groupBy("item").agg(F.avg((F.col("c") >= threshold).cast("double")).alias("share"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return answers.select("item").join(a, "item", "left").join(s, "item", "left").select("item", zero("best").alias("max_similarity"), zero("mean").alias("mean_similarity"), F.when(F.col("best").isNull(), 0.0).otherwise(zero("share")).alias("support"))


def stability(runs: DataFrame) -> DataFrame:
    """runs(item, embedding), repeated answers -> (item, stability): the mean cosine of an item's pairs of answers, 1 for
    up to one answer. It comes from the sum of their unit vectors, so no pairs are made; zero vectors have cosine 0."""
    unit = runs.where("embedding is not null").select("item", l2_normalize(F.col("embedding")).alias("u"))
    sums = unit.groupBy("item").agg(vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("s"), F.count("*").alias("n"), F.count_if(F.exists("u", lambda x: x != 0)).alias("units"))
    pairs = F.col("n") * (F.col("n") - 1)
    known = sums.select("item", F.when(pairs > 0, (dot(F.col("s"), F.col("s")) - F.col("units")) / pairs).otherwise(1.0).alias("stability"))
    return runs.select("item").distinct().join(known, "item", "left").select("item", F.coalesce("stability", F.lit(1.0)).alias("stability"))


def mean_vector(vectors: DataFrame, by: str) -> DataFrame:
    """vectors(by, embedding) -> (by, mean): the mean of each group's vectors; nulls don't count."""
    rows = vectors.where("embedding is not null").select(by, array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return rows.groupBy(by).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("mean"))


def qa_summary(answers: DataFrame, by: str, metrics: tuple[str, ...] = ("support", "stability", "length")) -> DataFrame:
    """(by, question_count, mean of each metric) in the order of by."""
    return answers.groupBy(by).agg(F.count("*").alias("question_count"), *[F.avg(m).alias(m) for m in metrics]).orderBy(by)


def bridge_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(by, score, label, is_cited), score or label may be missing as columns, but not both -> (by, n, avg_score over
    scores that aren't blank, positive as the share of true labels, cited, not_cited)."""
    if not {"score", "label"} & set(rows.columns):
        raise ValueError("a score or a label is needed")
    score = F.col("score").cast("string").try_cast("double") if "score" in rows.columns else F.lit(None).cast("double")
    truth = F.lower(F.trim(F.col("label").cast("string"))).isin("1", "true", "yes", "y") if "label" in rows.columns else score > 0
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(score).alias("avg_score"), F.avg(truth.cast("double")).alias("positive"), F.count_if("is_cited").alias("cited"), F.count_if(~F.col("is_cited")).alias("not_cited"))


def win_rates(scores: DataFrame) -> DataFrame:
    """scores(item, method, score) -> avg_score, share of positive scores and win_rate of a method; methods that share
    the top score of an item share its win."""
    w = Window.partitionBy("item")
    before = w.orderBy("method")  # the first row of a method in an item counts the item, so one sort by item does it all
    first = (F.row_number().over(before) == 1) | ~F.lag("method").over(before).eqNullSafe(F.col("method"))
    s = scores.withColumn("first", first & F.col("item").isNotNull()).withColumn("top", F.max("score").over(w))
    tied = F.count_if(F.col("score") == F.col("top")).over(w)
    s = s.withColumn("win", F.when(F.col("score") == F.col("top"), 1 / tied).otherwise(0.0))
    return s.groupBy("method").agg(F.avg("score").alias("avg_score"), F.avg((F.col("score") > 0).cast("double")).alias("positive"), (F.sum("win") / F.count_if("first")).alias("win_rate"))


def centered(accuracy: Column, baseline: Column) -> Column:
    """An accuracy above chance as a share of what chance leaves."""
    return (accuracy - baseline) / (1 - baseline)


def task_accuracy(results: DataFrame) -> DataFrame:
    """results(task, is_correct) -> (task, accuracy, n)."""
    return results.groupBy("task").agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def centered_score(accuracy: DataFrame, baselines: DataFrame, tasks: int | None = None, scale: float = 1.0) -> DataFrame:
    """accuracy(task, accuracy), baselines(task, baseline) -> (score): the mean of the tasks' centered accuracies;
    baselines are shares of 1 / scale (0.01: percents); null if fewer than `tasks` tasks are there."""
    j = accuracy.join(baselines, "task")
    mean = F.avg(centered(F.col("accuracy"), scale * F.col("baseline")))
    return j.agg(mean.alias("score") if tasks is None else F.when(F.count_distinct("task") >= tasks, mean).alias("score"))


def any_pass(samples: DataFrame) -> DataFrame:
    """samples(item, is_correct) -> (rate, passed, total): items of which any sample is correct."""
    p = samples.groupBy("item").agg(F.bool_or("is_correct").cast("int").alias("p"))
    return p.agg(F.avg("p").alias("rate"), F.sum("p").alias("passed"), F.count("*").alias("total"))


def token_accuracy(predictions: DataFrame, by: str, ignored: int = -1) -> DataFrame:
    """predictions(by, predicted, target) -> (by, accuracy, n) over targets that aren't the ignored one."""
    return predictions.where(F.col("target") != ignored).groupBy(by).agg(F.avg((F.col("predicted") == F.col("target")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def choose_letter(scores: DataFrame, letters: DataFrame) -> DataFrame:
    """scores(item, letter, score), letters(item, letter) of each item's choices -> (item, letter) of the best score, the
    first of equals."""
    best = F.max_by("letter", F.struct("score", (-F.ascii("letter")).alias("first")))
    return scores.join(letters, ["item", "letter"], "left_semi").groupBy("item").agg(best.alias("letter"))


def exact_span(predictions: DataFrame) -> DataFrame:
    """predictions(item, predicted, target), a row for each token -> (item, exact): whether all are as they should be."""
    return predictions.groupBy("item").agg(F.bool_and(F.col("predicted").eqNullSafe(F.col("target"))).alias("exact"))


def compression(sizes: DataFrame, baseline: str) -> DataFrame:
    """sizes(kind, tokenizer, bytes, tokens) -> for each kind and tokenizer but the baseline: ratio and base_ratio (bytes
    a token), diff (tokens fewer than the baseline's, in percent of those) and better, the tokenizer of fewer tokens."""
    each = sizes.groupBy("kind", "tokenizer").agg(F.sum("bytes").alias("b"), F.sum("tokens").alias("t"))
    base = each.where(F.col("tokenizer") == baseline).select("kind", F.col("b").alias("base_b"), F.col("t").alias("base_t"))
    j = each.where(F.col("tokenizer") != baseline).join(base, "kind")
    return j.select("kind", "tokenizer", (F.col("b") / F.col("t")).alias("ratio"), (F.col("base_b") / F.col("base_t")).alias("base_ratio"), ((F.col("base_t") - F.col("t")) / F.col("base_t") * 100).alias("diff"), F.when(F.col("t") < F.col("base_t"), F.col("tokenizer")).when(F.col("t") > F.col("base_t"), F.lit(baseline)).otherwise("tie").alias("better"))


def token_bytes(vocabulary: DataFrame, special: list[str] | None = None) -> DataFrame:
    """vocabulary(token) with n_bytes, 0 for special tokens."""
    size = F.octet_length("token").cast("long")
    return vocabulary.withColumn("n_bytes", F.when(F.col("token").isin(special), 0).otherwise(size) if special else size)


def token_byte_stats(vocabulary: DataFrame) -> DataFrame:
    """vocabulary(token, n_bytes) -> (n, least, most, mean, std) over tokens that have bytes."""
    n = F.col("n_bytes")
    return vocabulary.where(n > 0).agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"))


def pretoken_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each pre-token stands in the texts."""
    return docs.select(F.explode(pretokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def rollout_stats(rollouts: DataFrame) -> DataFrame:
    """rollouts(step, item, reward, length) -> (step, mean_reward, mean_length): means of the items' means."""
    each = rollouts.groupBy("step", "item").agg(F.avg("reward").alias("r"), F.avg("length").alias("l"))
    return each.groupBy("step").agg(F.avg("r").alias("mean_reward"), F.avg("l").alias("mean_length"))


def runs_derived(runs: DataFrame) -> DataFrame:
    """Runs of a positive val_bpb with effective_params (transformer and head) and ratio, the tokens for each of them."""
    r = runs.where("val_bpb > 0").withColumn("effective_params", F.col("params_transformer") + F.col("params_lm_head"))
    return r.withColumn("ratio", F.col("tokens_trained") / F.col("effective_params"))


def best_per_group(runs: DataFrame, by: str) -> DataFrame:
    """(by, run, val_bpb): the run of least val_bpb in each group, the first of equals."""
    return runs.groupBy(by).agg(F.min_by("run", F.struct("val_bpb", "run")).alias("run"), F.min("val_bpb").alias("val_bpb"))


def pass_at_k(samples: DataFrame, most: int) -> DataFrame:
    """samples(item, idx, is_correct) -> (k, rate): share of items with a correct one among the first k."""
    first = samples.groupBy("item").agg(F.min(F.when(F.col("is_correct"), F.col("idx"))).alias("first"))
    return first.select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"), "first").groupBy("k").agg(F.avg(F.coalesce(F.col("first") < F.col("k"), F.lit(False)).cast("double")).alias("rate"))


def bits_per_byte(losses: DataFrame, token_bytes: DataFrame) -> DataFrame:
    """losses(grp, target, loss in nats), token_bytes(target, n_bytes) -> bpb for each grp: tokens without bytes and
    targets below zero don't count; infinite without bytes."""
    j = losses.where("target >= 0").join(token_bytes, "target").where("n_bytes > 0").groupBy("grp").agg(F.sum("loss").alias("nats"), F.sum("n_bytes").alias("n_bytes"))
    all_ = losses.select("grp").distinct().join(j, "grp", "left")
    return all_.select("grp", F.coalesce(F.col("nats") / (F.log(F.lit(2.0)) * F.col("n_bytes")), F.lit(float("inf"))).alias("bpb"))


def choose_option(losses: DataFrame) -> DataFrame:
    """losses(item, option, loss, gold), a row for each token of an option's span -> the option of least mean loss, the
    first of equals, and whether it is gold."""
    mean = losses.groupBy("item", "option", "gold").agg(F.avg("loss").alias("loss"))
    return mean.groupBy("item").agg(F.min_by("option", F.struct("loss", "option")).alias("chosen"), F.first("gold").alias("gold")).select("item", "chosen", (F.col("chosen") == F.col("gold")).alias("correct"))


def pair_counts(words: DataFrame) -> DataFrame:
    """words(word, n) -> how often two characters follow each other, weighted by the words' counts."""
    chars = F.split("word", "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, F.lit(" "), b))
    return words.where(F.length("word") > 1).select(F.explode(F.slice(pairs, F.lit(1), F.length("word") - 1)).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))


def category_accuracy(answers: DataFrame) -> DataFrame:
    """answers(question, is_correct) -> (category, correct, total, accuracy) by the category of the question."""
    return answers.groupBy(categorize(F.col("question")).alias("category")).agg(F.count_if("is_correct").alias("correct"), F.count("*").alias("total"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"))


def reward(text: Column, correct: Column, mode: str = "combined") -> Column:
    """1 for a correct answer; with format or combined 0.4 more with ####, and 0.2 less under 50 characters; with
    reasoning or combined 0.04 for each operator sign up to 0.2, 0.05 for each marker word it holds up to 0.1, and 0.05
    for three line feeds. Other modes: correctness alone."""
    count = lambda x: F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))
    out = correct.cast("double")
    if mode in ("format", "combined"):
        out = out + F.when(F.contains(text, F.lit("####")), 0.4).otherwise(0.0) - F.when(F.length(text) < 50, 0.2).otherwise(0.0)
    if mode in ("reasoning", "combined"):
        signs = sum((count(x) for x in "+-*/="), F.lit(0))
        markers = sum((F.contains(text, F.lit(x)).cast("int") for x in fixed.MARKERS), F.lit(0))
        out = out + F.least(0.04 * signs, F.lit(0.2)) + F.least(0.05 * markers, F.lit(0.1)) + F.when(count("\n") >= 3, 0.05).otherwise(0.0)
    return out


def linear_fit(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def quadratic_fit(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, a, b, c, vertex): least squares of y = a x^2 + b x + c with x as log10, from power sums about the mean; the
    vertex is 10 to the power of where the parabola is least, null unless a > 0."""
    lx = df.select(by, F.log10(x).alias("x"), F.col(y).cast("double").alias("y"))
    m = lx.groupBy(by).agg(F.avg("x").alias("m"))
    c = lx.join(m, by).withColumn("z", F.col("x") - F.col("m"))
    s = c.groupBy(by).agg(F.first("m").alias("m"), F.count("*").alias("n"), *[F.sum(F.pow("z", F.lit(k))).alias(f"z{k}") for k in (2, 3, 4)], F.sum("y").alias("y0"), F.sum(F.col("y") * F.col("z")).alias("y1"), F.sum(F.col("y") * F.col("z") * F.col("z")).alias("y2"))
    n, z2, z3, z4, y0, y1, y2 = (F.col(k) for k in ("n", "z2", "z3", "z4", "y0", "y1", "y2"))
    det = n * (z2 * z4 - z3 * z3) - z2 * z2 * z2
    a = (n * (z2 * y2 - z3 * y1) - z2 * z2 * y0) / det
    b = (n * (z4 * y1 - z3 * y2) + z2 * z3 * y0 - z2 * z2 * y1) / det
    fit = s.where(det != 0).select(by, "m", a.alias("a"), b.alias("bz"), "n", "y0", "z2")
    cz = (F.col("y0") - F.col("a") * F.col("z2")) / F.col("n")
    return fit.select(by, "a", (F.col("bz") - 2 * F.col("a") * F.col("m")).alias("b"), (cz - F.col("bz") * F.col("m") + F.col("a") * F.col("m") * F.col("m")).alias("c"), F.when(F.col("a") > 0, F.pow(F.lit(10.0), F.col("m") - F.col("bz") / (2 * F.col("a")))).alias("vertex"))


def optimum(runs: DataFrame, by: str, carried: tuple[str, ...] = ("tokens_trained", "ratio"), x: str = "effective_params", y: str = "val_bpb") -> DataFrame:
    """(by, params, bpb, carried columns): where a group's parabola over log10(x) is least, with the carried columns
    interpolated there between the neighbouring runs (the end's value beyond them); the best run itself where the parabola
    has no least point. Ties go to the smaller x."""
    fit = quadratic_fit(runs, x, y, by)
    at = F.log10("vertex")
    j = runs.join(fit, by, "left").withColumn("lx", F.log10(x))
    point = lambda *more: F.struct("lx", *[F.col(c).cast("double").alias(c) for c in carried], *more)
    low = F.max_by(point(), F.when(F.col("lx") <= at, F.col("lx")))
    high = F.min_by(point(), F.when(F.col("lx") >= at, F.col("lx")))
    best = F.min_by(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), point().alias("p")), F.struct(y, x))
    g = j.groupBy(by).agg(F.first("vertex").alias("vertex"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("c").alias("c"), low.alias("low"), high.alias("high"), best.alias("best"))
    share = (at - F.col("low.lx")) / (F.col("high.lx") - F.col("low.lx"))

    def between(c: str) -> Column:
        l, h = F.col(f"low.{c}"), F.col(f"high.{c}")
        inside = F.when(F.col("high.lx") > F.col("low.lx"), l + share * (h - l)).otherwise(l)
        return F.when(F.col("vertex").isNull(), F.col(f"best.p.{c}")).when(F.col("low").isNull(), h).when(F.col("high").isNull(), l).otherwise(inside).alias(c)

    least = F.col("a") * at * at + F.col("b") * at + F.col("c")
    return g.select(by, F.coalesce("vertex", "best.x").alias("params"), F.coalesce(least, "best.y").alias("bpb"), *map(between, carried))


def report_matrix(df: DataFrame, stages: list[str]) -> DataFrame:
    """df(metric, stage, value) -> a row for each metric and a column for each stage, "-" where there is none; place
    orders the rows: CORE first, ChatCORE last, the others by name between them."""
    p = df.groupBy("metric").pivot("stage", stages).agg(F.first("value"))
    w = Window.orderBy(F.col("metric") != "CORE", F.col("metric") == "ChatCORE", "metric")  # a row for each metric
    return p.select("metric", *[F.coalesce(F.format_number(s, 4), F.lit("-")).alias(s) for s in stages], F.row_number().over(w).alias("place")).orderBy("place")
