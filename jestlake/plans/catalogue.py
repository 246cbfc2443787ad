"""Queries over the tables of a data directory, one per operator family; each is checked against SQL where that can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import lexicon as L
from ..functions.text import visible_length, word_count
from ..operators import composite as C
from ..operators import diversity as D
from ..operators import metrics as M
from ..operators import parsing as P
from ..operators import prompts as Q
from ..operators import scorers as R
from ..operators import splits as U
from ..session import cut, shared_dir, spread, table
from ..sources import readers, sinks
from ..streaming.diversity import stream_diversity as stream_rewards
from . import pipelines

def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, p, lang, model): answers with their prompts ('' where the prompt is missing)."""
    asked = table(spark, sf_dir, "rl_df_test").select("id", F.col("prompt").alias("_p"))
    answers = spread(table(spark, sf_dir, "submissions").select("submission_id", "id", "text", "model").where("text is not null"))
    return answers.join(asked, "id", "left").select(F.col("submission_id").alias("id"), F.col("text").alias("t"), F.coalesce("_p", F.lit("")).alias("p"), F.split_part("id", F.lit("_"), F.lit(1)).alias("lang"), F.col("model"))


def _r(c: Column) -> Column:
    return F.round(c, 6)


def validity_rows(spark, d):
    return completions(spark, d).select("id", R.is_valid(F.col("t"), F.col("lang")).alias("valid"))


def validity_by_lang(spark, d):
    return completions(spark, d).groupBy("lang").agg(F.count("*").alias("n"), _r(F.avg(R.is_valid(F.col("t"), F.col("lang")).cast("int"))).alias("validity"))


def structure_rows(spark, d):
    return completions(spark, d).select("id", R.structure(F.col("t"), F.col("lang")).alias("structure"))


def structure_dist(spark, d):
    tagged = completions(spark, d).select("lang", R.structure(F.col("t"), F.col("lang")).alias("structure"))
    return M.structure_shares(tagged, ["lang"]).withColumn("share", _r(F.col("share")))


def structure_pivot(spark, d):
    tagged = completions(spark, d).select("model", R.structure(F.col("t"), F.col("lang")).alias("structure"))
    out = M.structure_pivot(tagged, ["model"])
    return out.select("model", *(_r(F.col(c)).alias(c) for c in out.columns if c != "model"))


def structure_entropy(spark, d):
    tagged = completions(spark, d).select("model", R.structure(F.col("t"), F.col("lang")).alias("structure"))
    return M.structure_entropy(tagged, ["model"]).select("model", _r(F.col("structure_entropy")).alias("structure_entropy"))


def text_sizes(spark, d):
    return completions(spark, d).select("id", word_count(F.col("t")).alias("words"), visible_length(F.col("t")).alias("visible"))


def forbidden_symbols(spark, d):
    return completions(spark, d).select("id", R.has_emoji(F.col("t")).alias("emoji"), R.has_forbidden(F.col("t")).alias("forbidden"))


def formatting_score(spark, d):
    return completions(spark, d).select("id", R.formatting(F.col("t"), F.col("lang")).alias("formatting"))


def length_penalty(spark, d):
    return completions(spark, d).select("id", _r(R.length_penalty(F.col("t"), F.col("lang"))).alias("length"))


def coherence_score(spark, d):
    return completions(spark, d).select("id", (_r(R.coherence(F.col("t"), F.col("lang"))) + F.lit(0.0)).alias("coherence"))


def word_pair_adherence(spark, d):
    return completions(spark, d).select("id", R.word_pair(F.col("t"), F.col("p")).alias("word_pair"))


def headline_adherence(spark, d):
    return completions(spark, d).select("id", R.headline(F.col("t"), F.col("p"), F.col("lang")).alias("headline"))


def early_variants(spark, d):
    return completions(spark, d).select(
        "id",
        R.is_valid_v0(F.col("t")).alias("valid"),
        R.structure_v0(F.col("t")).alias("structure"),
        R.word_pair_v0(F.col("t"), F.col("p")).alias("word_pair"),
        R.headline_v0(F.col("t"), F.col("p")).alias("headline"),
        R.formatting_v0(F.col("t")).alias("formatting"),
        R.rater_v0(F.concat(F.lit("LABEL_"), (F.length(F.col("t")) % 11).cast("string")), F.col("t")).alias("rater"),
    )


def gated_rater(spark, d):
    return completions(spark, d).select("id", R.gated_rater((F.length(F.col("t")) % 11).cast("double"), F.col("t"), F.col("lang")).alias("rater"))


def pair_prompts(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", *(Q.pair_prompt(words[0], words[1], code).alias(f"prompt_{code}") for code in L.LANGUAGES))


def headline_prompts(spark, d):
    return table(spark, d, "task_a_zh").select("task_no", *(Q.headline_prompt(F.col("headline"), code).alias(f"prompt_{code}") for code in L.LANGUAGES))


def task_router_training(spark, d):
    return Q.route_for_training(table(spark, d, "task_a_zh"), "zh").select("task_no", "prompt")


def task_router_submission(spark, d):
    return Q.route_for_submission(table(spark, d, "task_a_zh"), "zh").select("task_no", "prompt")


def task_router_early(spark, d):
    return Q.route_early(table(spark, d, "task_a_zh"))


def rating_prompts(spark, d):
    jokes = table(spark, d, "combined_jokes_full")
    message = Q.chat_message(Q.rating_prompt("Rate this joke from 0 to 10:\n{}\nAnswer in JSON.", F.col("joke")))
    return jokes.select("joke_id", message[0]["role"].alias("role"), message[0]["content"].alias("content"))


def few_shot_prompts(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", Q.few_shot_prompt("A joke with `{}` and `{}`, please.", words[0], words[1]).alias("prompt"))


def random_pairs(spark, d):
    return Q.random_pairs(spark, ["cat", "moon", "ladder", "moon"], ["sing", "jump", "paint"], 500, 42)


def hashed_pairs(spark, d):
    return Q.hashed_pairs(table(spark, d, "part").select("p_partkey"), F.col("p_partkey"), ["cat", "moon", "ladder"], ["sing", "jump"])


def training_prompts(spark, d):
    return Q.training_prompts(spark, ["cat", "moon"], ["sing", "jump"], ["Rain expected", "Cat elected mayor"], "en", 200)


def clean_generation(spark, d):
    raw = completions(spark, d).select("id", F.concat(F.element_at(F.array(*map(F.lit, ("Joke: ", " Sure! Here's a joke: Joke: ", '"', "", "Answer:"))), (F.col("id") % 5 + 1).cast("int")), F.col("t"), F.element_at(F.array(*map(F.lit, ('"', "\n\nJoke 2: x", "", " --- more"))), (F.col("id") % 4 + 1).cast("int"))).alias("raw"))
    return P.clean_generation(raw, "raw").select("id", "clean")


def rating_extract(spark, d):
    text = F.concat(F.lit("Here: "), F.replace(F.col("props"), F.lit('"k"'), F.lit('"rating"')))
    return table(spark, d, "events").select("event_id", P.rating(text).alias("rating"))


def rating_reason(spark, d):
    events = table(spark, d, "events")
    text = F.concat(F.lit("{'rating': "), F.col("user_id"), F.lit(", 'reason': 'because "), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "'}").when(F.col("event_id") % 3 == 0, "'").otherwise("'}]"))
    return P.rating_and_reason(events.select("event_id", text.alias("t")), "t").select("event_id", "rating", "reason")


def assistant_suffix(spark, d):
    m, m2 = L.ASSISTANT_MARKERS
    c = completions(spark, d)
    a = F.concat(F.lit("question" + m), F.col("t"), F.lit(m), F.lit("  "), F.col("t"), F.lit("\n"))
    b = F.when(F.col("id") % 3 == 0, F.col("t")).otherwise(F.concat(F.lit("q" + m2), F.col("t"), F.lit(m2 + "rest")))
    return c.select("id", P.after_last(a).alias("last"), P.between_first(b).alias("between"), P.drop_prefix(F.concat("p", F.lit(" "), F.col("t")), F.col("p")).alias("answer"))


def display_text(spark, d):
    name, path = P.name_and_path(F.concat("model", F.lit(":/a:b/"), F.col("id").cast("string")))
    return completions(spark, d).select("id", P.shorten(F.col("t")).alias("short"), P.clean_caption(F.col("t")).alias("caption"), name.alias("name"), path.alias("path"))


def title_and_body(spark, d):
    src = completions(spark, d).select(F.col("p").alias("title"), F.col("t").alias("body"), (F.col("id") % 50 - 5).alias("score"))
    return P.title_and_body(src).select("joke", _r(F.col("score")).alias("score"))


def max_normalise(spark, d):
    return P.scale_to_max(table(spark, d, "events").select("event_id", "value"), "value", "score").select("event_id", _r(F.col("score")).alias("score"))


def average_label(spark, d):
    return table(spark, d, "data_llm_eval").select("eval_id", P.average_label(F.col("llama_score"), F.col("gpt_score")).alias("label"))


def distinct_1(spark, d):
    return M.distinct_n(completions(spark, d), "t", 1, ["model"]).select("model", _r(F.col("distinct_1")).alias("distinct_1"))


def distinct_2(spark, d):
    return M.distinct_n(completions(spark, d), "t", 2, ["model"]).select("model", _r(F.col("distinct_2")).alias("distinct_2"))


def _scored(spark, d):
    return C.score_rows(completions(spark, d), "t", "p", F.col("lang")).withColumn("ev", (F.length(F.col("t")) % 11).cast("double"))


def composite_reward(spark, d):
    return C.composite(_scored(spark, d), F.col("ev"), "t", F.col("lang")).select("id", _r(F.col("composite")).alias("composite"))


def training_reward(spark, d):
    rows = _scored(spark, d)
    scores = {"rater": R.gated_rater(F.col("ev"), F.col("t"), F.col("lang"), F.col("is_valid")), "diversity": (F.col("id") % 7) / F.lit(8.0), **{n: F.col(n) for n in ("word_pair", "formatting", "length", "headline", "coherence")}}
    return rows.select("id", C.training_reward(scores).alias("reward"), C.training_reward(scores, ("headline", "diversity")).alias("reward_ablated"))


def _detail(spark, d):
    gens = completions(spark, d).select("model", F.col("p").alias("prompt_idx"), F.col("id").alias("generation_idx"), F.col("p").alias("prompt"), F.col("t").alias("joke"), "lang")
    return C.detail_rows(gens, (F.length("joke") % 11).cast("double"), lang=F.col("lang"))


def detail_rows(spark, d):
    out = _detail(spark, d).drop("prompt_idx")
    return out.withColumns({c: _r(F.col(c)) + F.lit(0.0) for c in ("length_score", "coherence_score")})


def model_summary(spark, d):
    out = M.model_summary(_detail(spark, d))
    return out.select("model", *(_r(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c != "model"))


def prompt_rows(spark, d):
    wanted = table(spark, d, "rl_df_test").where("prompt_idx = 7").select("prompt")
    rows = completions(spark, d).where("model = 'quip_base'").select("model", F.col("id").alias("generation_idx"), F.col("p").alias("prompt"), F.col("t").alias("joke"), (F.length("t") % 11).cast("double").alias("rater_score"))
    return rows.join(wanted, "prompt", "left_semi").select("model", "generation_idx", "joke", F.format_number("rater_score", 2).alias("score"))


def head_prompts(spark, d):
    return U.head(table(spark, d, "rl_df_test").select("prompt_idx", "prompt"), 8, "prompt_idx")


def _compared(spark, d):
    gens = _scored(spark, d).select(F.col("lang").alias("language"), "model", F.col("p").alias("prompt"), F.col("t").alias("joke"), "ev", "lang")
    return pipelines.compare(gens, F.col("lang"), base="quip_base", trained="quip_tuned")


def comparison_summary(spark, d):
    out = _compared(spark, d)[0]
    return out.select("language", "model", *(_r(F.col(c)).alias(c) for c in ("mean_ev_reward", "mean_ev_reward_valid_only", "mean_composite_reward", "std_composite_reward", "validity_rate")), "num_samples")


def base_vs_trained(spark, d):
    out = _compared(spark, d)[1]
    return out.select("language", *(_r(F.col(c)).alias(c) for c in out.columns if c != "language"))


def _ablation(spark, d):
    rows = completions(spark, d).withColumn("ev", (F.length(F.col("t")) % 11).cast("double")).withColumn("is_valid", R.is_valid(F.col("t"), F.col("lang"))).withColumn("structure", R.structure(F.col("t"), F.col("lang"))).withColumn("prompt_idx", F.col("p"))
    return M.ablation_summary(rows, "model", "t")


def ablation_summary(spark, d):
    out = _ablation(spark, d)
    return out.select("model", "n_prompts", "n_jokes", *(_r(F.col(c)).alias(c) for c in ("ev_mean", "ev_std", "validity_rate", "distinct_2", "structure_entropy")))


def delta_to_full(spark, d):
    out = M.delta_to_full(_ablation(spark, d), ["ev_mean", "distinct_2", "structure_entropy", "validity_rate"], full="quip_base")
    return out.select("model", *((_r(F.col(c)) + F.lit(0.0)).alias(c) for c in out.columns if c != "model"))


def gated_label_summary(spark, d):
    rows = completions(spark, d).withColumn("score", R.gated_rater((F.length(F.col("t")) % 11).cast("double"), F.col("t"), F.col("lang")))
    out = M.gated_label_summary(rows, ["lang", "model"])
    return out.select("lang", "model", *(_r(F.col(c)).alias(c) for c in ("mean_reward", "median_reward", "std_reward")), "num_samples")


def _logits(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.transform(F.slice("embedding", 1, 11), lambda x: x.cast("double")).alias("logits"), F.transform(F.slice("embedding", 12, 2), lambda x: x.cast("double")).alias("head"), F.transform(F.slice("embedding", 14, 10), lambda x: x.cast("double")).alias("children"))


def softmax_ev(spark, d):
    return _logits(spark, d).select("vec_id", _r(A.expected_value(F.col("logits"))).alias("ev"), A.argmax(F.col("logits")).alias("top"), _r(A.softmax(F.col("logits"))[0]).alias("p0"), _r(A.log_softmax(F.col("logits"))[10]).alias("lp10"))


def hierarchical_logits(spark, d):
    h = _logits(spark, d).select("vec_id", A.hierarchical(F.col("head"), F.col("children")).alias("h"))
    return h.select("vec_id", *(_r(F.col("h")[k]).alias(f"c{k}") for k in (0, 1, 10)), A.argmax(F.col("h")).alias("top"))


def eval_metrics(spark, d):
    out = M.eval_metrics(_logits(spark, d), F.col("label"), A.argmax(F.col("logits")))
    return out.select(*(_r(F.col(c)).alias(c) for c in out.columns))


def cross_entropy(spark, d):
    out = M.weighted_cross_entropy(_logits(spark, d), A.log_softmax(F.col("logits")), F.col("label"), F.when(F.col("label") == 0, 2.0).otherwise(1.0))
    return out.select(_r(F.col("cross_entropy")).alias("cross_entropy"))


def class_weights(spark, d):
    out = M.class_weights(table(spark, d, "embeddings"), "label")
    return out.select("head", "class", "count", _r(F.col("weight")).alias("weight"))


def missing_labels(spark, d):
    return M.missing_labels(table(spark, d, "embeddings"), "label")


def present_labels(spark, d):
    labels = table(spark, d, "combined_jokes_full").where("labels is not null")
    return U.distinct_sorted(labels, "labels").select(F.concat_ws(",", F.transform("labels", lambda x: x.cast("string"))).alias("labels"))


def label_counts(spark, d):
    return table(spark, d, "combined_jokes_full").groupBy("source").agg(F.count("*").alias("n"), F.count("labels").alias("labelled"), F.count_if(F.col("labels") > 5).alias("good"))


def value_histogram(spark, d):
    return M.histogram(table(spark, d, "events"), "value", 5.0)


def seen_order(spark, d):
    return M.seen_order(table(spark, d, "submissions"), "model", "submission_id")


def three_way_split(spark, d):
    rows = table(spark, d, "combined_jokes_full").where("labels is not null").select("joke_id", "labels")
    return U.three_way_split(rows, "labels", F.col("joke_id")).select("joke_id", "labels", "split_name")


def three_way_split_stratified(spark, d):
    rows = table(spark, d, "combined_jokes_full").where("labels is not null").select("joke_id", "labels")
    return U.three_way_split(rows, "labels", F.col("joke_id"), stratify_second=True).select("joke_id", "labels", "split_name")


def union_label10(spark, d):
    rated = table(spark, d, "combined_jokes_full").select("joke", "labels").dropna()
    lines = U.labelled(table(spark, d, "task_a_zh").where("headline is not null"), "headline", 10)
    return U.union_all(rated, lines)


def limit_then_filter(spark, d):
    return U.head_then_filter(table(spark, d, "rl_df_test").select("prompt_idx", "prompt"), 150, "prompt_idx", "prompt")


def tiled_literals(spark, d):
    return U.tiled(spark, ["rain", "sun", "snow", "fog", "wind"], 123)


def _tagged(spark, d):
    return D.with_position(completions(spark, d).select("id", "model", R.structure(F.col("t"), F.col("lang")).alias("structure")), "id")


def structure_diversity(spark, d):
    return D.diversity_reward(_tagged(spark, d)).select("id", "structure", _r(F.col("diversity")).alias("diversity"))


def structure_diversity_wide(spark, d):
    return D.diversity_reward(_tagged(spark, d), batch=40).select("id", "structure", _r(F.col("diversity")).alias("diversity"))


def stream_diversity(spark, d):
    """The streaming form over the same rows, run to its end in two micro-batches per file; one serial run per model."""
    rows = cut(_tagged(spark, d).select(F.col("model").alias("run"), "pos", "structure"))
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    query = stream_rewards(source).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("run", "pos", "structure", _r(F.col("diversity")).alias("diversity"))


def submission_table(spark, d):
    tasks = table(spark, d, "task_a_zh")
    raw = table(spark, d, "submissions").where("text is not null").groupBy("id").agg(F.max("text").alias("raw"))
    return pipelines.submission(tasks, raw, "zh")


def flatten_generations(spark, d):
    nested = completions(spark, d).groupBy("p").agg(F.sort_array(F.collect_list("t")).alias("jokes"))
    return C.flatten_generations(nested)


# Sources and sinks: a table is written to a fresh file of the format in the shared folder and read back.


def _fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _task_file(spark, d):
    path = _fresh(spark, "tasks")
    sinks.write_csv(table(spark, d, "task_a_zh").select("id", "word1", "word2", "headline"), path, sep="\t")
    return path


def _rated_files(spark, d):
    jokes = table(spark, d, "combined_jokes_full")
    paths = {code: _fresh(spark, f"rated-{code}") for code in L.LANGUAGES}
    own = lambda code: jokes.where(F.col("lang") == code)
    sinks.write_csv(own("en").select("joke", "labels"), paths["en"])
    sinks.write_csv(own("zh").select("joke", (F.col("labels") + 0.4).alias("average_weighted")), paths["zh"], sep="\t")
    sinks.write_csv(own("es").select("joke", F.col("labels").alias("score")), paths["es"])
    return paths


def source_task_tsv(spark, d):
    return readers.task_tsv(spark, _task_file(spark, d))


def source_rated_en(spark, d):
    return readers.rated(spark, _rated_files(spark, d), "en")


def source_rated_zh(spark, d):
    return readers.rated(spark, _rated_files(spark, d), "zh")


def source_rated_es(spark, d):
    return readers.rated(spark, _rated_files(spark, d), "es")


def source_rated_all(spark, d):
    return readers.rated(spark, _rated_files(spark, d))


def source_prompts(spark, d):
    """Several files without a stored index: numbered without gaps in the order they were written."""
    path = _fresh(spark, "prompts")
    table(spark, d, "rl_df_test").repartitionByRange(3, "prompt_idx").sortWithinPartitions("prompt_idx").select("prompt").write.parquet(path)
    return readers.prompts(spark, path)


def source_text_lines(spark, d):
    path = _fresh(spark, "lines")
    table(spark, d, "task_a_zh").where("headline is not null and not contains(headline, chr(10)) and not contains(headline, chr(13))").select("headline").write.text(path)
    return readers.text_lines(spark, path)


def source_json_array(spark, d):
    path = _fresh(spark, "titles")
    titles = table(spark, d, "rl_df_test").select(F.struct(F.col("id").alias("title"), F.col("prompt").alias("body"), F.col("prompt_idx").alias("score")).alias("r"))
    titles.agg(F.to_json(F.collect_list("r"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return readers.json_array(spark, path)


def source_text_column(spark, d):
    path = _fresh(spark, "answers")
    sinks.write_csv(table(spark, d, "submissions").select("id", "text"), path)
    return readers.text_column(spark, path, "text")


def source_text_union(spark, d):
    first, second = _fresh(spark, "answers"), _fresh(spark, "jokes")
    sinks.write_csv(table(spark, d, "submissions").select("id", "text"), first)
    table(spark, d, "combined_jokes_full").select(F.col("joke").alias("text")).write.parquet(second)
    return readers.text_union(spark, first, second)


def source_complete_rows(spark, d):
    path = _fresh(spark, "answers")
    sinks.write_csv(table(spark, d, "submissions").select("id", "model", "text"), path)
    return readers.complete_rows(spark, path)


def source_without_index(spark, d):
    path = _fresh(spark, "indexed")
    table(spark, d, "rl_df_test").select("prompt", F.col("prompt_idx").alias("__index_level_0__")).write.parquet(path)
    return readers.without_index(spark.read.parquet(path))


def source_base_model(spark, d):
    path = _fresh(spark, "adapter")
    spark.createDataFrame([('{"r": 16, "base_model_name_or_path": "lab/small-model"}',)], "value string").coalesce(1).write.text(path)
    return readers.base_model(spark, path)


def sink_prompts(spark, d):
    path = sinks.write_prompts(table(spark, d, "rl_df_test"), _fresh(spark, "out"), "test", "es")
    return spark.read.parquet(path)


def sink_csv(spark, d):
    path = _fresh(spark, "csv")
    sinks.write_csv(table(spark, d, "submissions").select("submission_id", "text", "model"), path, single=False)
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema="submission_id bigint, text string, model string")


def sink_submissions(spark, d):
    """The echo of the first three rows."""
    rows = table(spark, d, "submissions").where("text is not null").groupBy("id").agg(F.max("text").alias("text"))
    return sinks.write_submissions(rows, _fresh(spark, "submission"))


def sink_markdown(spark, d):
    return sinks.markdown_rows(label_counts(spark, d), "source")


def sink_sample_table(spark, d):
    scored = _scored(spark, d).withColumnsRenamed({"p": "prompt", "t": "generation"})
    return sinks.sample_table(scored, ["word_pair", "formatting", "headline"], 20, "id")


def load_split(spark, d):
    return pipelines.load_split(spark, _rated_files(spark, d))


def prepare_data(spark, d):
    """Training prompts of hashed pairs and headlines, and the task file's test prompts, written and read again."""
    pairs = hashed_pairs(spark, d).withColumnRenamed("p_partkey", "key")
    headlines = table(spark, d, "task_a_zh").where("headline is not null").select(F.col("task_no").alias("key"), "headline")
    paths = pipelines.prepare_data(spark, "zh", _task_file(spark, d), _fresh(spark, "prepared"), pairs, headlines)
    parts = [spark.read.parquet(path).select(F.lit(split).alias("split_name"), "prompt") for split, path in sorted(paths.items())]
    return parts[0].unionByName(parts[1])


def shuffled(spark, d):
    return U.shuffled(table(spark, d, "submissions").select("submission_id", "id"), F.col("submission_id")).select("submission_id", "id", "pos")


def sample_matching(spark, d):
    rows = table(spark, d, "combined_jokes_full").select("joke_id", "joke", "labels")
    return U.sample_matching(rows, F.col("labels") == 8, F.col("joke_id"), 5)


def training_loss(spark, d):
    weights = [1.0, 0.5], [float(k % 3 + 1) for k in range(10)]
    out = M.training_loss(_logits(spark, d), "head", "children", "label", *weights)
    return out.select(*(_r(F.col(c)).alias(c) for c in out.columns))


def parameter_ratio(spark, d):
    out = M.parameter_ratio(table(spark, d, "part"), "p_size", F.col("p_partkey") % 3 == 0)
    return out.select(F.col("trained").cast("bigint").alias("trained"), F.col("total").cast("bigint").alias("total"), _r(F.col("ratio")).alias("ratio"))


_NOT_QUERIES = {"completions", "cut", "shared_dir", "spread", "table", "stream_rewards"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n not in _NOT_QUERIES | {"queries"}}
