"""Parsing, prompts, metrics, arrays, diversity, splits, sources and streaming on small tables."""

import ast
import hashlib
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from jestlake import __main__ as cli
from jestlake.functions import arrays as A
from jestlake.operators import composite, diversity, metrics, parsing, prompts, splits
from jestlake.plans import catalogue, pipelines
from jestlake.sources import readers, sinks
from jestlake.streaming.diversity import score_calls, stream_diversity


def test_clean_generation(spark):
    cases = {'Joke: "x"': "x", "Sure! Here's a joke: Joke: y": "y", "costs 2.50 today": "costs", '"': "", " a\n\nb": "a", "Here's another": "", "plain": "plain", 'Answer: "q" --- r': '"q"'}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, e string")
    assert all(r["clean"] == r["e"] for r in parsing.clean_generation(df, "t").collect())


def test_rating(spark):
    cases = [('{"rating": 7}', 7.0), ('"rating": 100', 10.0), ('"rating": -5', 0.0), ('"rating": 7.9', 7.0), ("none", 0.0), (None, 0.0)]
    df = spark.createDataFrame(cases, "t string, e double")
    assert all(r["g"] == r["e"] for r in df.select(parsing.rating(F.col("t")).alias("g"), "e").collect())


def test_rating_and_reason(spark):
    cases = [("{'rating': 7, 'reason': 'ok'}", 7, "ok"), ("{'rating': 3", 3, ""), ("[1]", 0, ""), ("boom", 0, ""), (None, 0, "")]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").coalesce(1)
    assert [(r["rating"], r["reason"]) for r in parsing.rating_and_reason(df, "t").collect()] == [c[1:] for c in cases]


def test_average_label(spark):
    df = spark.createDataFrame([(7, 8, 7), (-1, -1, 0), (-2, -1, -2), (None, 3, None)], "a int, b int, e int")
    assert all(r["g"] == r["e"] for r in df.select(parsing.average_label(F.col("a"), F.col("b")).alias("g"), "e").collect())


def test_suffixes(spark):
    m = "<|eot_id|>assistant\n"
    df = spark.createDataFrame([(f"q{m}a{m} b ",), ("plain ",)], "t string").coalesce(1)
    out = df.select(parsing.after_last(F.col("t")).alias("x"), parsing.between_first(F.col("t"), m).alias("y")).collect()
    assert [tuple(r) for r in out] == [("b", "a"), ("plain", None)]


def test_routers(spark):
    df = spark.createDataFrame([(1, "a", "b", "-"), (2, "-", "-", "h"), (3, "-", "-", "-"), (4, None, None, "-"), (5, "a", "-", "h")], "i int, word1 string, word2 string, headline string")
    train = {r["i"]: r["prompt"] for r in prompts.route_for_training(df, "en").collect()}
    assert set(train) == {1, 2, 4, 5} and "'a', 'b'" in train[1] and "'h'" in train[5] and "'nan', 'nan'" in train[4]
    sub = {r["i"]: r["prompt"] for r in prompts.route_for_submission(df, "es").collect()}
    assert len(sub) == 5 and sub[3] == sub[4] == "Generate a funny joke."
    early = [tuple(r) for r in prompts.route_early(df).select("kind").collect()]
    assert sorted(early) == [(0,)] * 3 + [(1,)] * 2
    assert prompts.route_for_training(df.drop("headline"), "en").count() == 2


def test_prompt_templates_are_safe(spark):
    df = spark.createDataFrame([("100%s {b}", "{a}")], "x string, y string")
    got = df.select(prompts.pair_prompt(F.col("x"), F.col("y"), "en").alias("p")).first()["p"]
    assert got == "Generate a funny joke using these two words: '100%s {b}', '{a}'. Only respond with the joke and nothing else."
    with pytest.raises(ValueError):
        prompts.prompt_functions("fr")


def test_random_pairs_follow_the_generator(spark):
    rng = random.Random(42)
    want = []
    for _ in range(20):
        v = rng.choice(["v1", "v2"])
        want.append((v, rng.choice(["n1", "n2", "n3"])))
    got = [(r["verb"], r["noun"]) for r in prompts.random_pairs(spark, ["n1", "n2", "n3"], ["v1", "v2"], 20).orderBy("pos").collect()]
    assert got == want


def test_arrays(spark):
    z = [0.5, -1.0, 2.0, 2.0, 0.0, 1.0, -3.0, 0.1, 0.2, 0.3, 0.4]
    p = [math.exp(x) for x in z]
    df = spark.createDataFrame([(z, [0.1, 0.9], z[:10])], "z array<double>, h array<double>, c array<double>")
    r = df.select(A.expected_value(F.col("z")).alias("ev"), A.argmax(F.col("z")).alias("top"), A.hierarchical(F.col("h"), F.col("c")).alias("hc")).first()
    assert r["ev"] == pytest.approx(sum(i * x for i, x in enumerate(p)) / sum(p)) and r["top"] == 2
    assert sum(math.exp(x) for x in r["hc"]) == pytest.approx(1.0) and len(r["hc"]) == 11


def test_metrics_small(spark):
    df = spark.createDataFrame([("m", "a b a b", "x"), ("m", "a b", "y"), ("m", "c", "x"), ("e", "", "x")], "model string, t string, structure string")
    assert {r["model"]: r["distinct_2"] for r in metrics.distinct_n(df, "t", 2, ["model"]).collect()} == {"m": 0.5, "e": 0.0}
    ent = {r["model"]: r["structure_entropy"] for r in metrics.structure_entropy(df, ["model"]).collect()}
    assert ent["m"] == pytest.approx(-(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3))) and ent["e"] == 0.0
    lab = spark.createDataFrame([(0,), (0,), (3,), (None,)], "labels int")
    w = {(r["head"], r["class"]): r["weight"] for r in metrics.class_weights(lab).collect()}
    assert w["binary", 0] == 3 / 4 and w["binary", 1] == 3 / 2 and w["child", 3] == 1.0 and w["child", 10] == 1.0
    assert {r["label"] for r in metrics.missing_labels(lab).collect()} == set(range(11)) - {0, 3}


def test_single_row_deviation_is_null(spark):
    df = spark.createDataFrame([("m", 1.0)], "model string, score double")
    assert metrics.gated_label_summary(df, ["model"]).first()["std_reward"] is None


def defined_diversity(tags, batch):
    """By the definition: one over the kinds of the last 30 tags before the call, less the tag's share of those and the call so far."""
    out = []
    for place, tag in enumerate(tags):
        begin = place - place % batch
        past, call = tags[max(0, begin - diversity.HISTORY) : begin], tags[begin:place]
        out.append(1 / max(1, len(set(past))) - (past + call).count(tag) / (max(1, len(past)) + len(call)))
    return out


@pytest.mark.parametrize("batch", [1, 4, 8, 30, 40, 64])
def test_diversity_by_its_definition(spark, batch):
    rng = random.Random(batch)
    tags = [rng.choice("aabcd") for _ in range(150)]
    want = defined_diversity(tags, batch)
    df = spark.createDataFrame([(i * 3, s) for i, s in enumerate(tags)], "id bigint, structure string")
    got = {r["pos"]: r["diversity"] for r in diversity.diversity_reward(diversity.with_position(df, "id"), batch=batch).collect()}
    assert [got[i] for i in range(len(tags))] == pytest.approx(want)
    assert score_calls(tags, [], batch)[0] == pytest.approx(want)


def test_stream_reset(spark, tmp_path):
    tags = list("abacab") + [None] + list("aabbac")
    schema, src = "run string, pos bigint, structure string", str(tmp_path / "in")
    spark.createDataFrame([("r", i, t) for i, t in enumerate(tags)], schema).coalesce(1).write.parquet(src)
    q = stream_diversity(spark.readStream.schema(schema).parquet(src), 4).writeStream.format("memory").queryName("reset").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["pos"]: r["diversity"] for r in spark.table("reset").collect()}
    assert [got[i] for i in range(6)] == pytest.approx(defined_diversity(tags[:6], 4)) and [got[i] for i in range(7, 13)] == pytest.approx(defined_diversity(tags[7:], 4)) and 6 not in got


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [("r1", i, rng.choice("abc")) for i in range(64)]
    schema = "run string, pos bigint, structure string"
    src = str(tmp_path / "in")
    for part in (rows[:32], rows[32:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_diversity(stream, 8).writeStream.format("memory").queryName("div").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["pos"]: r["diversity"] for r in spark.table("div").collect()}
    want, _ = score_calls([r[2] for r in rows], [], 8)
    assert [got[i] for i in range(64)] == pytest.approx(want)


def test_three_way_split(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(300)], "k bigint, labels int")
    out = splits.three_way_split(df, "labels", F.col("k"))
    n = {r["split_name"]: r["count"] for r in out.groupBy("split_name").count().collect()}
    assert n == {"train": 240, "test": 30, "val": 30}
    per = {(r["labels"], r["split_name"] == "train"): r["count"] for r in out.groupBy("labels", (F.col("split_name") == "train").alias("x"), "split_name").count().groupBy("labels", "x", "split_name").agg(F.sum("count").alias("count")).collect() if r["x"]}
    assert set(per.values()) == {80}


def test_head_then_filter_is_limit_first(spark):
    df = spark.createDataFrame([(0, ""), (1, "a"), (2, None), (3, "b")], "i int, t string")
    assert [r["t"] for r in splits.head_then_filter(df, 3, "i", "t").collect()] == ["a"]


def test_reward_exclusion(spark):
    df = spark.createDataFrame([(1.0, None, 2.0)], "rater double, word_pair double, headline double")
    scores = {c: F.col(c) for c in df.columns}
    r = df.select(composite.training_reward(scores).alias("a"), composite.training_reward(scores, ("headline",)).alias("b")).first()
    assert tuple(r) == (5.0, 1.0)


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text('id\tword1\tword2\theadline\nen_1\ta\tb\t-\nen_2\t-\t-\t"say ""hi"""\n', encoding="utf-8")
    assert [r["headline"] for r in readers.task_tsv(spark, str(p)).collect()] == ["-", 'say "hi"']
    en = tmp_path / "en.csv"
    en.write_text('joke,labels\n"two\nlines",3.7\nx,\n', encoding="utf-8")
    zh = tmp_path / "zh.tsv"
    zh.write_text("joke\taverage_weighted\n好\t2.9\n", encoding="utf-8")
    es = tmp_path / "es.csv"
    es.write_text("joke,score\nja,bad\nje,4\n", encoding="utf-8")
    rows = readers.rated(spark, {"en": str(en), "zh": str(zh), "es": str(es)}).collect()
    assert sorted(tuple(r) for r in rows) == [("je", 4), ("two\nlines", 3), ("好", 2)]
    with pytest.raises(ValueError):
        readers.rated(spark, {}, "fr")
    df = spark.createDataFrame([("a", 'q "x"\ny', 1), ("b", "", 2)], "id string, text string, pos int")
    assert len(sinks.write_submissions(df, str(tmp_path / "out")).collect()) == 2
    path = sinks.write_prompts(df.select(F.col("text").alias("prompt")), str(tmp_path), "test", "zh")
    assert path.endswith("rl_df_test_zh.parquet") and readers.prompts(spark, path).count() == 2
    j = tmp_path / "r.json"
    j.write_text('[{"title": "a", "body": "b", "score": 3}]', encoding="utf-8")
    assert readers.json_array(spark, str(j)).first()["score"] == 3
    t = tmp_path / "one.txt"
    t.write_text("x\ny\n", encoding="utf-8")
    assert readers.text_lines(spark, str(t)).count() == 2


def test_more_readers(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text('id,text\n1,"two\nlines, ""quoted"""\n2,\n3, spaced \n', encoding="utf-8")
    assert [r[0] for r in readers.text_column(spark, str(csv), "text").collect()] == ['two\nlines, "quoted"', None, " spaced "]
    assert readers.complete_rows(spark, str(csv)).count() == 2
    spark.createDataFrame([("x", 0), ("x", 1)], "text string, __index_level_0__ bigint").write.parquet(str(tmp_path / "p"))
    held = spark.read.parquet(str(tmp_path / "p"))
    assert readers.text_union(spark, str(csv), str(tmp_path / "p")).count() == 5
    assert readers.without_index(held).columns == ["text"] and readers.without_index(held.select("text")).columns == ["text"]
    parts = tmp_path / "parts"
    spark.createDataFrame([(i, f"prompt {i}") for i in range(50)], "i int, prompt string").repartitionByRange(5, "i").sortWithinPartitions("i").select("prompt").write.parquet(str(parts))
    assert {(r["prompt_idx"], r["prompt"]) for r in readers.prompts(spark, str(parts)).collect()} == {(i, f"prompt {i}") for i in range(50)}
    adapter = tmp_path / "adapter_config.json"
    adapter.write_text('{\n "base_model_name_or_path": "lab/m",\n "r": 8}', encoding="utf-8")
    assert readers.base_model(spark, str(adapter)).first()[0] == "lab/m"


def test_csv_round_trip(spark, tmp_path):
    texts = [" lead", "trail ", 'q "x", y', "a\nb", "tab\there", "汤"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(r[0] for r in readers.text_column(spark, str(tmp_path / "csv"), "text").collect()) == sorted(texts)


def test_markdown(spark):
    df = spark.createDataFrame([("b", 2, None), ("a|c", 1, 0.5)], "name string, n int, share double")
    assert sinks.markdown_table(df, "n") == "| name | n | share |\n| --- | --- | --- |\n| a\\|c | 1 | 0.5 |\n| b | 2 |  |"
    assert sinks.markdown_table(df.where("false"), "n").count("\n") == 1


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [5.0] * 7 + [1.0], [None], [float(i % 13) for i in range(500)], [i / 7 for i in range(1001)]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 9.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in metrics.exact_median(df, ["g"], "v", "m").collect()}
    held = [v for v in values if v is not None]
    assert got == {"b": 9.0} | ({"a": statistics.median(held)} if held else {})


def test_training_loss(spark):
    rows = [(0, [2.0, -1.0], [0.1 * k for k in range(10)]), (3, [0.5, 0.5], [0.0] * 10), (10, [-1.0, 1.0], [float(k) for k in range(10)]), (None, [0.0, 0.0], [0.0] * 10)]
    df = spark.createDataFrame(rows, "y int, h array<double>, c array<double>")
    soft = lambda z: [math.exp(x) / sum(map(math.exp, z)) for x in z]
    hw, cw = [1.0, 2.0], [float(k + 1) for k in range(10)]
    held = [r for r in rows if r[0] is not None]
    head = sum(hw[y > 0] * -math.log(soft(h)[y > 0]) for y, h, _ in held) / sum(hw[y > 0] for y, _, _ in held)
    child = sum(cw[y - 1] * -math.log(soft(c)[y - 1]) for y, _, c in held if y) / sum(cw[y - 1] for y, _, _ in held if y)
    ev = [sum((k + 1) * soft(h)[1] * p for k, p in enumerate(soft(c))) for _, h, c in held]
    square = sum((e - y) ** 2 for e, (y, _, _) in zip(ev, held)) / 3
    got = metrics.training_loss(df, "h", "c", "y", hw, cw).first()
    assert tuple(got) == pytest.approx((head + child + 0.1 * square, head, child, square))
    assert metrics.training_loss(df.where("y = 0"), "h", "c", "y", hw, cw).first()["child_loss"] == 0.0


@pytest.mark.parametrize("per_range", [1, 50, 10**6])
def test_ranks_do_not_depend_on_ranges(spark, monkeypatch, per_range):
    monkeypatch.setattr(splits, "RANGE", per_range)
    df = spark.createDataFrame([(i, i % 2) for i in range(300)], "k bigint, g int")
    got = [r["k"] for r in splits.shuffled(df, F.col("k")).orderBy("pos").collect()]
    assert got == sorted(range(300), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest()) and splits.shuffled(df.where("false"), F.col("k")).count() == 0
    one = splits.sample_matching(df, F.col("g") == 1, F.col("k"), 3).collect()
    assert [r["k"] for r in one] == [k for k in got if k % 2][:3]


def test_rating_patterns_agree_with_the_parser(spark):
    cases = ["{'rating': 7, 'reason': 'ok'}", "{'rating': 07, 'reason': 'x'}", '{"rating": 0, "reason": ""', "{'rating\": 1, 'reason': 'x'}", "{'rating': 5, 'reason': 'it\\'s'}", "{'rating': 5, 'reason': \"it's\"}", "{'rating': -3, 'reason': 'n'}", "{'rating': 4.9, 'reason': 'n'}", "{'reason': 'r', 'rating': 2}", "{'rating': 1, 'reason': 'a'}}", "{'rating': 1, 'reason': 'a\nb'}", "{'rating': 123456789012, 'reason': 'a'}", " {'rating': 1, 'reason': 'a'}"]

    def plainly(t):
        try:
            value = ast.literal_eval(t if t.endswith("}") else t + "}")
            return (int(value.get("rating", 0)), str(value.get("reason", ""))) if isinstance(value, dict) else (0, "")
        except Exception:
            return 0, ""

    df = spark.createDataFrame([(c,) for c in cases], "t string").coalesce(1)
    assert [(r["rating"], r["reason"]) for r in parsing.rating_and_reason(df, "t").collect()] == [plainly(c) for c in cases]


def test_prepare_and_load(spark, tmp_path):
    tasks = tmp_path / "t.tsv"
    tasks.write_text("id\tword1\tword2\theadline\n1\tlamp\tsoup\t-\n2\t-\t-\tRain\n3\t-\t-\t-\n", encoding="utf-8")
    pairs = spark.createDataFrame([(i, "fall", f"lamp{i}") for i in range(20)], "key int, verb string, noun string")
    heads = spark.createDataFrame([(1, "Soup"), (2, "Fog")], "key int, headline string")
    paths = pipelines.prepare_data(spark, "en", str(tasks), str(tmp_path), pairs, heads)
    assert paths["train"].endswith("rl_df_train.parquet") and paths["test"].endswith("rl_df_test.parquet")
    train, test = ([r["prompt"] for r in readers.prompts(spark, paths[s]).orderBy("prompt_idx").collect()] for s in ("train", "test"))
    assert len(train) == 22 and sum("'Soup'" in p for p in train) == 1 and train != sorted(train) and len(test) == 2
    with pytest.raises(ValueError):
        pipelines.prepare_data(spark, "fr", str(tasks), str(tmp_path), pairs, heads)
    csv = tmp_path / "en.csv"
    csv.write_text("joke,labels\n" + "".join(f"joke {i},{i % 2}\n" for i in range(100)), encoding="utf-8")
    n = {r["split_name"]: r["count"] for r in pipelines.load_split(spark, {"en": str(csv)}, "en").groupBy("split_name").count().collect()}
    assert n == {"train": 80, "test": 10, "val": 10}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t.tsv").write_text("id\tword1\tword2\theadline\n1\tlamp\tsoup\t-\n2\t-\t-\tRain\n", encoding="utf-8")
    for name, lines in (("nouns", "lamp\nsoup\n"), ("verbs", "fall\n"), ("heads", "Rain\nFog\nMist\n")):
        (tmp_path / name).write_text(lines, encoding="utf-8")
    cli.main(["prepare", "--tasks", str(tmp_path / "t.tsv"), "--nouns", str(tmp_path / "nouns"), "--verbs", str(tmp_path / "verbs"), "--headlines", str(tmp_path / "heads"), "--word-pairs", "7", "--max-headlines", "2", "--output", str(tmp_path)])
    assert "train: 9 prompts" in capsys.readouterr().out
    gens = [(m, i, "prompt", f"The lamp {i} fell into the soup.", float(i), "en", str(i), f"Joke: lamp {i}") for m in ("base", "trained") for i in range(4)]
    spark.createDataFrame(gens, "model string, prompt_idx int, prompt string, joke string, ev double, language string, id string, raw string").write.parquet(str(tmp_path / "g"))
    for command in (["evaluate"], ["compare"], ["evaluate", "--num-samples", "2"]):
        cli.main([*command, "--generations", str(tmp_path / "g"), "--output", str(tmp_path / "o")])
        assert "| --- |" in capsys.readouterr().out
    assert spark.read.csv(str(tmp_path / "o" / "detail"), header=True).count() == 4
    cli.main(["submit", "--tasks", str(tmp_path / "t.tsv"), "--generations", str(tmp_path / "g"), "--output", str(tmp_path / "s")])
    assert "1 lamp 1" in capsys.readouterr().out
    (tmp_path / "en.csv").write_text("joke,labels\n" + "".join(f"joke {i},1\n" for i in range(20)), encoding="utf-8")
    cli.main(["split", "--language", "en", "--en", str(tmp_path / "en.csv"), "--output", str(tmp_path / "sp")])
    assert "| train | 16 |" in capsys.readouterr().out


def test_title_and_body(spark):
    df = spark.createDataFrame([("a b", "c d e", 10), ("a", "b", 50), ("a b c", "d e f", 5), (None, "x y z u v", 9), ("q w e", "r t y", 0)], "title string, body string, score int")
    assert {r["joke"]: r["score"] for r in parsing.title_and_body(df).collect()} == {"a b c d e": 1000.0, "a b c d e f": 500.0}


def test_submission_pipeline(spark):
    tasks = spark.createDataFrame([("1", "a", "b", "-"), ("2", "-", "-", "h")], "id string, word1 string, word2 string, headline string")
    raw = spark.createDataFrame([("1", "Joke: ha")], "id string, raw string")
    assert {r["id"]: r["text"] for r in pipelines.submission(tasks, raw, "en").collect()} == {"1": "ha", "2": ""}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id bigint, structure string")
    assert diversity.diversity_reward(diversity.with_position(df, "id")).count() == 0
    assert metrics.structure_entropy(df.withColumn("model", F.lit("m")), ["model"]).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the test tables")
def test_title_and_body_are_whole(spark):
    d = "/root/testdata/sf0.001"
    whole = {r["id"]: f"{r['p']} {r['t']}" for r in catalogue.completions(spark, d).collect()}
    want = {k: t for k, t in whole.items() if 5 <= len(t.split()) <= 24 and k % 50 - 5 > 0}
    best = max(k % 50 - 5 for k in want)
    got = sorted((r["joke"], r["score"]) for r in catalogue.title_and_body(spark, d).collect())
    assert got == sorted((t, round((k % 50 - 5) / best * 1000, 6)) for k, t in want.items()) and got
