"""Language, sentence, truncation, pair and consensus operators on held-out or synthetic cases."""

import os
import random

import duckdb
import numpy as np
import pytest

from jestlake.llm import consensus, langid, pairs, sentences, truncation
from jestlake.session import ship

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def rows(sql):
    return duckdb.sql(sql.replace("@", DATA)).fetchall()


@pytest.fixture(scope="module")
def labelled():
    both = rows("select lang, joke from '@/combined_jokes_full.parquet' where joke is not null union all select lang, text from '@/documents.parquet' where text is not null")
    both = sorted((a, b) for a, b in both if a in langid.LANGS and b.strip())
    random.Random(1).shuffle(both)
    return both


@pytest.fixture(scope="module")
def identifier(labelled):
    return langid.Identifier(labelled[len(labelled) // 4 :])


def held(identifier, texts):
    owner, _, lang, _, letters = identifier.parts(texts)
    out = [set() for _ in texts]
    for o, k, n in zip(owner, lang, letters):
        if n:
            out[o].add(langid.LANGS[k] if k >= 0 else "und")
    return out


def test_language_held_out(identifier, labelled):
    test = labelled[: len(labelled) // 4]
    got = held(identifier, [t for _, t in test])
    right = np.mean([lang in g for (lang, _), g in zip(test, got)])
    assert right > 0.93  # a few per cent of the declared labels are wrong by design


def test_mixed_text(identifier):
    en = "The dentist bought a frozen turkey at the bakery on a rainy morning."
    zh = "从那以后，我老板在滑雪场只相信冻火鸡。"
    es = "El dentista compró una tetera eléctrica en la panadería el martes pasado."
    assert held(identifier, [f"{en} {zh}", f"{en} {es}", en, "...", "!!"]) == [{"en", "zh"}, {"en", "es"}, {"en"}, set(), set()]


def test_gibberish_is_undetermined(identifier):
    assert held(identifier, ["xqzvw kjhgf pqzzx wvkkq zzxqj bvqwx kkzqv " * 3]) == [{"und"}]


@pytest.mark.parametrize("foreign", ["我奶奶睡着了。", "我奶奶在公交站睡着了，还拍下了两只左脚鞋。"])
def test_foreign_parts_of_any_length(identifier, foreign):
    assert held(identifier, ["The dentist fell asleep in the swimming pool. " + foreign]) == [{"en", "zh"}]
    assert held(identifier, ["The tailor moved to Zwölk. It lies near No. 7. Nobody laughed at the zoo."]) == [{"en"}]


def test_confidence_is_calibrated(identifier, labelled):
    texts = [t for _, t in labelled[: len(labelled) // 4]]
    owner, _, lang, confidence, letters = identifier.parts(texts)
    declared = np.array([langid.LANGS.index(a) for a, _ in labelled[: len(labelled) // 4]])[owner]
    sure = (confidence > 0.95) & (letters > 0)
    assert sure.mean() > 0.3 and (lang == declared)[sure].mean() > 0.85  # some declared languages are wrong
    assert confidence[(lang >= 0) & (letters > 60)].mean() > confidence[(lang >= 0) & (letters > 0) & (letters < 10)].mean()


def test_language_tables(spark):
    schema = "src_table string, rec_id bigint, lang string, text string"
    assert langid.found(spark.createDataFrame([], schema)).count() == 0
    assert langid.found(spark.createDataFrame([("t", 1, None, "hello")], schema)).count() == 0  # nothing to learn from


@pytest.fixture(scope="module")
def splitter():
    return sentences.fit([t for (t,) in rows("select text from '@/documents.parquet' where text is not null")])


CASES = [
    "Mrs. Tindlow bought snacks, e.g. a stapler, before a hungry ghost fell asleep.| Nobody laughed.",
    '"Stop! That is the garden gnome!" shouted my boss, who took a bow.| Then he left.',
    "The dentist (who burst into tears!) married a lamp.| It was late.",
    "A title without a mark|\nThe second line!| 😂|",
    "1. The first item.|\n2. The second item.|",
    "- a dash item.|\n- another one.|",
    "我在公交站遇到过击剑冠军。|他睡着了！|然后呢？|",
    "“你见过那把雨伞吗？我没见过。”害羞的会计在健身房嘀咕道。|走到半路我们才发现它。|",
    "It weighs 2,311.5 kg at 7.45 p.m. in the greenhouse.| The end.|",
    "Version 2.42 of a trombone was too heavy.| Nobody at the zoo laughed...| My aunt fell asleep.",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(splitter, case):
    parts = [p.strip() for p in case.split("|") if p.strip()]
    if "😂" in case:
        parts = ["A title without a mark", "The second line! 😂"]
    text = case.replace("|", "")
    assert [text[a:b] for a, b in sentences.split(text, splitter)] == parts


def test_sentences_cover_everything(splitter):
    texts = [t for (t,) in rows("select text from '@/documents.parquet' where text is not null")] + ["", " ", "...", "\n\n", "a" * 50000, "(((", '"', "x　y", "。。。"]
    for text in texts:
        at = 0
        for a, b in sentences.split(text, splitter):
            assert at <= a < b and not text[at:a].strip() and text[a:b] == text[a:b].strip()
            at = b
        assert not text[at:].strip()


RUN_ON = [
    "The dentist married a lamp| It was late| Nobody laughed at the zoo|",
    "昨天傍晚有块牌子写着一副滑雪板只是个比喻|我奶奶脸都绿了|他们告诉我糕点师傅擦亮了一袋洋葱|",
    "it turns out that an invisible fence is only a metaphor| they told me the pastry chef insulted an inflatable whale| instead of a mirror the school nurse unplugged a lamp under the bridge| nobody laughed at the zoo| it turns out that a sack of flour is on strike|",
]


@pytest.mark.parametrize("case", RUN_ON)
def test_sentences_without_marks(splitter, case):
    text = case.replace("|", "")
    want = [p.strip() for p in case.split("|") if p.strip()]
    got = [text[a:b] for a, b in sentences.split(text, splitter)]
    assert len(set(got) & set(want)) >= len(want) - 1


def test_long_tokens_keep_their_context(splitter):
    long = "x" * 200
    text = f"The dentist bought the {long}. Nobody laughed at the {long}. It was late."
    assert [text[a:b] for a, b in sentences.split(text, splitter)] == [f"The dentist bought the {long}.", f"Nobody laughed at the {long}.", "It was late."]


def test_sketch_is_exact_when_sparse_and_unbiased_when_full():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 62, 5000).astype(np.uint64)
    sketch = sentences.Sketch()
    sketch.add(np.concatenate([keys, keys[:100]]))
    got = sentences.Sketch(sketch.cells).get(keys)
    assert (got >= np.where(np.arange(5000) < 100, 2, 1)).all() and (got[:100] == 2).mean() > 0.99 and (got[100:] == 1).mean() > 0.99
    full = sentences.Sketch()
    full.cells += 7  # every cell full of other keys
    full.add(np.repeat(keys[:50], 40))
    assert abs(np.median(sentences.Sketch(full.cells).get(keys[:50])) - 40) < 1


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "One here. Two here.", "en", 5), (2, None, None, 5), (3, " ", "en", 5)], "doc_id bigint, text string, lang string, start_char int")
    out = {(r["doc_id"], r["start_char"], r["end_char"]) for r in sentences.split_documents(df).collect()}
    assert all(k == 1 for k, _, _ in out) and out
    assert sentences.split_documents(df.where("false")).count() == 0


def test_sentences_count_every_document(spark, monkeypatch):
    monkeypatch.setattr(sentences, "CHUNK", 20_000)
    rng = random.Random(8)
    words = "cat dog moon lamp bridge green swan angry clerk spoon soup late again".split()
    texts = []
    for i in range(2400):
        body = " ".join(f"The {rng.choice(words)} met the {rng.choice(words)}{i % 7}." for _ in range(4))
        rare = f"\nHere is Zq. Tinker{i} with a {rng.choice(words)}.\nTinker{i} met the zebu.\nNow the zebu. The cat slept." if i % 5 == 0 else ""
        texts.append(body + rare)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    got = {}
    for r in sentences.split_documents(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    model = sentences.fit(texts)
    assert all(sorted(got[i]) == sentences.split(t, model) for i, t in enumerate(texts))


def test_endings_held_out():
    texts = [t for (t,) in rows("select text from '@/submissions.parquet' where text is not null order by submission_id")]
    model = truncation.EndModel(texts[::2])
    whole = [t for t in texts[1::2] if t.strip()[-1:] in ".!?。！？" and ".." not in t[-4:] and not truncation.announces(t)]
    rng = random.Random(3)
    cut = [t[: rng.randrange(len(t) // 2, len(t) - 6)] for t in whole if len(t) > 40]
    assert np.mean([model.score(t) > 0 for t in cut]) > 0.85 and np.mean([model.score(t) < 1 for t in whole]) > 0.95


def test_last_words_of_every_text(spark, monkeypatch):
    monkeypatch.setattr(truncation, "SAMPLE", 20)
    rng = random.Random(6)
    pets = "cat dog moon lamp bridge swan clerk spoon".split()
    texts = [f"The {rng.choice(pets)} met a {rng.choice(pets)}. Then it saw the {rng.choice(pets)}." for _ in range(200)]
    texts += ["It was a kaktus that met us. Then it saw the dog.", "The cat met a dog. Then it saw the kaktus", "The cat met a dog. Then it saw the kakt.", "The cat met a dog. Then it saw the kakt...", "The moon met a dog. Then it saw the Zebra.", "The lamp met a dog. Then it saw the zebra!"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "k bigint, t string, source string")
    model = truncation.EndModel(truncation.sample_texts(df, "k", "t"))
    odds = {r["_k"]: r["odds"] for r in truncation.read_endings(df, "k", "t", "source").collect()}
    unknown = {k: round(odds[k] - model.reading(texts[k])[0], 6) != 0 for k in range(200, 206)}
    # a word of another text is known, sampled or not; one that only ends this very text is not
    assert model.unknown != 0 and unknown == {200: False, 201: False, 202: True, 203: True, 204: False, 205: False}


def test_report_counts_every_answer(spark):
    rows = [(1, "The cat met a dog.", "a"), (2, None, "a"), (3, "...", "a"), (4, "Sure!", "b"), (5, None, None)]
    out = truncation.report(spark.createDataFrame(rows, "submission_id bigint, text string, model string")).collect()
    assert {r["source"]: (r["texts"], r["truncated"], r["share"]) for r in out if r["source"] != "a"} == {"b": (1, 0, 0.0), "": (1, 0, 0.0)}
    assert [r["texts"] for r in out if r["source"] == "a"] == [3]


def test_hazards_find_limits(spark):
    rng = random.Random(5)
    lengths = [("a", "chars", rng.randrange(50, 400)) for _ in range(3000)] + [("a", "chars", 200)] * 60 + [("b", "chars", rng.randrange(50, 400)) for _ in range(3000)]
    out = truncation.length_hazards(spark.createDataFrame(lengths, "source string, unit string, length int")).where("significant").collect()
    assert [(r["source"], r["length"]) for r in out] == [("a", 200)]


def test_hazards_weigh_texts_at_risk(spark):
    # equal counts at 100 and 300, but nearly all texts end before 300: there the same count is the usual hazard
    lengths = [100] * 8 + [300] * 8 + [n for n in range(80, 121) for _ in range(2)] + [n for n in range(280, 321) for _ in range(8)] + [150] * 20000
    out = {r["length"]: r for r in truncation.length_hazards(spark.createDataFrame([("a", "chars", n) for n in lengths], "source string, unit string, length int")).collect()}
    assert out[100]["n"] == 10 and out[300]["n"] == 16 and out[100]["significant"] and not out[300]["significant"]
    risk = lambda n: sum(x >= n for x in lengths)
    for n in (100, 150, 300, 281):
        around = [m for m in range(n - truncation.NEIGHBOURS, n + truncation.NEIGHBOURS + 1) if m != n and m >= 1]
        ends = sum(x in set(around) for x in lengths)
        assert out[n]["near"] == pytest.approx((ends + 0.5) / (sum(map(risk, around)) + 1)) and out[n]["risk"] == risk(n)


def test_binomial_tail():
    from math import comb

    for trials, p in ((5, 0.3), (40, 0.02), (40, 0.6), (300, 0.9), (1, 0.5)):
        for n in range(trials + 1):
            want = sum(comb(trials, k) * p**k * (1 - p) ** (trials - k) for k in range(n, trials + 1))
            assert truncation.binomial_tail(n, trials, p) == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert truncation.binomial_tail(0, 9, 0.1) == 1 and truncation.binomial_tail(10, 9, 0.1) == 0 and truncation.binomial_tail(3, 9, 1.0) == 1


def test_fdr_limit(spark):
    rng = np.random.default_rng(4)
    for ps in ([], [0.5, 0.9], np.concatenate([rng.random(300), rng.random(20) * 1e-4]).tolist(), [0.001] * 5):
        got = truncation.fdr_limit(spark.createDataFrame([(float(p),) for p in ps], "p double"), 0.05)
        ranked = sorted(ps)
        held = [p for k, p in enumerate(ranked, 1) if p <= 0.05 * k / len(ranked)]
        assert [p for p in ranked if p <= got] == ranked[: len([p for p in ranked if held and p <= held[-1]])]


def test_rows_name_their_rule(spark):
    rng = random.Random(11)
    pets = "cat dog moon lamp bridge swan clerk spoon".split()
    text = lambda n: " ".join(f"The {rng.choice(pets)} met a {rng.choice(pets)}." for _ in range(n))
    rows = [(i, t[:70] if len(t) > 70 else t, "m") for i, t in enumerate(text(rng.randrange(1, 6)) for _ in range(600))] + [(900, "The cat met a dog. The moon met a", "m")]
    out = {r["_k"]: r["rule"] for r in truncation.judged(spark.createDataFrame(rows, "k bigint, t string, source string"), "k", "t", "source").collect()}
    assert {out[k] for k, t, _ in rows if len(t) == 70 and t.split()[-1] in ("The", "met", "a")} == {"limit"}
    assert sum(out[k] == "limit" for k, t, _ in rows if len(t) != 70) == 0 and out[900] in ("transfer", None)


@pytest.mark.parametrize("text, want", [("The cat sat 😂 #funny hahaha!!", "The cat sat"), ("The ca... 哈哈", "The ca"), ("The #cat sat", "The #cat sat"), ("The cat ;) ~~ \n", "The cat"), ("hahaha", ""), ("", ""), ("The cat sat" + "." * 3000, "The cat sat"), ("The cat�", "The cat")])
def test_bare(text, want):
    assert truncation.bare(text) == want


@pytest.mark.parametrize("times", [1, 14, 15, 400])
def test_announcements_of_any_length(times):
    assert truncation.announces("sure " * times) and not truncation.announces("sure " * times + "cat")


@pytest.mark.parametrize("text, want", [("Sure! Here you go:", True), ("**Joke**", True), ("", True), ("...", True), ("​", True), ("笑话：", True), ("¡Claro! Aquí tienes:", True), ("A cat.", False), ("笑话：猫跳了。", False)])
def test_announcements(text, want):
    assert truncation.announces(text) == want


REFUSING = ["I'm sorry, but I can't write a joke about this topic. Please try another prompt.", "No joke can be provided for this input.", "Lo siento, pero bromear sobre esto va contra mis normas.", "不好意思，这个要求我只能拒绝。", "我不能写关于这个话题的笑话。"]
JOKING = ['"I\'m sorry, I can\'t help with that," said the salesman, and left.', "Our landlord had to decline because a kettle was too expensive. He left.", "我的理发师只好拒绝，因为一袋面粉对星期一过敏。", '"I won\'t write that joke," my boss said last winter, but I slept.', "«Lo siento, no puedo ayudarte», dijo mi tía, y pintó un cactus."]


LONG_REFUSAL = "Thank you for asking about this topic, which I have read with great care and more than once. " * 5 + "Unfortunately, I can't write a joke about this subject. " + "Please feel free to ask me about something else, such as a lighter theme or another prompt that hurts nobody at all. " * 4
LONG_JOKE = "The baker sold a loaf to the mayor. The mayor paid with a button. I can't say who laughed first. Then the loaf went home by bus. " * 6


def test_refusals_of_any_length():
    assert len(LONG_REFUSAL) > 800 and pairs.refuses(LONG_REFUSAL) and pairs.refuses("Sorry. Thank you for asking. I must decline. Ask me about something else.")
    assert not pairs.refuses(LONG_JOKE) and not pairs.refuses(LONG_JOKE[:130])


def brute_shortened(texts):
    stems = {t.rstrip(pairs._MARKS) for t in texts if t} - {""}
    begun = {s for s in stems if any(t != s and t.startswith(s) and pairs.goes_on(s, t) for t in stems)}
    return {i for i, t in enumerate(texts) if t and t.rstrip(pairs._MARKS) in begun}


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_shortened_across_variants_and_partitions(spark, partitions):
    rng = random.Random(partitions)
    texts = ["The dog and the ca", "The dog and the ca!", "The dog and the cat slept.", "The cat", "The cat. It slept.", "The cats ran away.", "The dog...", None, "", "!!", "x", "x" * 5000]
    whole = [" ".join(rng.choice(["sun", "moon", "sunny", "lamp", "la"]) for _ in range(12)) for _ in range(60)]
    texts += [w[: rng.randrange(3, len(w) + 1)] + rng.choice(["", ".", "...", "!"]) for w in whole for _ in range(3)] + whole
    df = spark.createDataFrame(list(enumerate(texts)), "_k bigint, _t string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r[0] for r in pairs.shortened(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == sorted(brute_shortened(texts)) and {0, 1, 3} <= set(got)


def test_refusals():
    assert all(pairs.refuses(t) for t in REFUSING) and not any(pairs.refuses(t) for t in JOKING)


def test_copies():
    prompt = "Write one funny joke about this headline: 'A cat bought two left shoes at the zoo'. Reply with nothing but the joke."
    assert pairs.copies(prompt, prompt) and pairs.copies("Sure! " + prompt.lower(), prompt) and pairs.copies("A cat bought two left shoes at the zoo.", prompt)
    assert not pairs.copies("A cat bought two left shoes at the zo", prompt) and not pairs.copies("A cat bought two left shoes at the zoo and then sang until the morning came.", prompt)
    assert not pairs.copies("x", None) and not pairs.copies("x", " ")


def test_pair_table(spark):
    answers = spark.read.parquet(f"{DATA}/submissions.parquet").limit(300)
    prompts = spark.read.parquet(f"{DATA}/rl_df_test.parquet")
    got = {r["submission_id"]: r["defect"] for r in pairs.defective(answers, prompts).collect()}
    texts = {r["submission_id"]: r["text"] for r in answers.collect()}
    assert set(got.values()) <= {"empty", "truncated", "refusal", "copied", "language"}
    assert all(got[k] == "empty" for k, t in texts.items() if t is None or not t.strip())
    assert pairs.defective(answers.where("false"), prompts).count() == 0


def test_shortened(spark):
    texts = ["A cat sat on the mat.", "A cat sat on the m", "A cat sat on the mat. It slept.", "B", "A cat sat on the m", None]
    df = spark.createDataFrame(list(enumerate(texts)), "_k bigint, _t string").where("_t is not null")
    assert {r["_k"] for r in pairs.shortened(df).collect()} == {1, 4}


def synthetic(seed=1, items=500):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 11, items)
    sd = {"good": 0.4, "fair": 0.9, "poor": 2.0, "high": 0.6, "noise": None}
    out, n = [], 0
    for i in range(items):
        llama, gpt = (int(np.clip(round(truth[i] + rng.normal(0, 1.5)), 0, 10)) for _ in range(2))
        for who in rng.permutation(list(sd))[:4]:
            v = rng.integers(0, 11) if sd[who] is None else round(truth[i] + (2 if who == "high" else 0) + rng.normal(0, sd[who]))
            out.append((n, i, f"joke {i}", llama if i % 9 else None, gpt if i % 8 else 99, int(np.clip(v, 0, 10)), who))
            n += 1
    return truth, out


def test_consensus(spark):
    truth, out = synthetic()
    schema = "eval_id bigint, item_id bigint, joke string, llama_score int, gpt_score int, labels int, labeler string"
    extra = [(90000, 0, None, None, None, None, None), (90001, 777, "nobody voted", None, -5, None, " "), (0, 0, "joke 0", None, None, 10 - int(truth[0]), "good")]
    df = spark.createDataFrame(out + extra, schema).selectExpr("*", "case when eval_id = 0 and llama_score is null then timestamp'2020-01-01' else timestamp'2021-01-01' end as loaded_at")
    got = {r["item_id"]: r for r in consensus.label_items(df).collect()}
    assert set(got) == set(range(len(truth))) | {777} and 0 <= got[777]["label"] <= 10 and got[777]["agreement"] is None
    em = np.mean([abs(got[i]["label"] - truth[i]) for i in range(len(truth))])
    votes = {}
    for r in out:
        votes.setdefault(r[1], []).append(r[5])
    median = np.mean([abs(np.median(votes[i]) - truth[i]) for i in range(len(truth))])
    assert em < 0.6 * median
    rel = {r["annotator"]: r for r in consensus.reliability(df).collect()}
    assert rel["labeler:good"]["mean_error"] < rel["labeler:fair"]["mean_error"] < rel["labeler:noise"]["mean_error"] and rel["labeler:high"]["bias"] > 1
    assert consensus.label_items(df.where("false")).count() == 0


def test_consensus_says_when_it_does_not_settle(spark):
    truth, out = synthetic(2, 40)
    df = spark.createDataFrame(out, "eval_id bigint, item_id bigint, joke string, llama_score int, gpt_score int, labels int, labeler string").selectExpr("*", "timestamp'2021-01-01' as loaded_at")
    items, names = consensus.gathered(df, "item_id", "joke")
    with pytest.raises(RuntimeError):
        consensus.fit(items, names, iterations=2)
    assert len(consensus.fit(items, names).names) == 7


def test_one_vote_an_annotator(spark):
    rows = [(1, 5, "j", 3, 3, 2, "a", "2021-01-01"), (2, 5, "j", 3, 4, 7, "a", "2021-02-01"), (3, 5, "j", 3, 99, 9, " b ", "2021-01-01"), (3, 5, "j", 3, 99, 8, "b", "2021-03-01"), (4, 5, "j", None, None, 44, "c", None)]
    df = spark.createDataFrame(rows, "eval_id bigint, item_id bigint, joke string, llama_score int, gpt_score int, labels int, labeler string, at string").selectExpr("*", "cast(at as timestamp) as loaded_at")
    assert {(r["annotator"], r["label"]) for r in consensus.votes(df).collect()} == {("labeler:a", 7), ("labeler:b", 8), ("model:llama_score", 3), ("model:gpt_score", 4)}


EDGES = [None, "", " ", "...", "a", "x" * 30000, "The cat met a dog. The moon met a", "The cat met a dog.", "The cat met a dog.", "\ud83d\ude02", "我奶奶睡着了。", "\u200b\ufeff", "no joke\n" * 500]


@pytest.mark.parametrize("empty", [False, True])
def test_nulls_ties_long_texts_and_clashing_names(spark, empty):
    """Every operator on null, empty, blank, repeated and very long texts, with null keys of other tables and columns named like its own."""
    rows = [(i, f"en_{i % 3}" if i % 4 else None, ("m" if i % 2 else None), t, [None, "en", "und", ""][i % 4], "k", 1.0, 2) for i, t in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "submission_id bigint, id string, model string, text string, lang string, _k string, odds double, word int")
    prompts = spark.createDataFrame([("en_0", "Say: 'a cat'", 1), ("en_1", None, 2), (None, "x", 3), ("en_0", "", 4)], "id string, prompt string, _p int")
    if empty:
        df, prompts = df.where("false"), prompts.where("false")
    keys = set(range(len(EDGES)))
    pairs_found = pairs.defective(df, prompts).collect()
    assert len({r["submission_id"] for r in pairs_found}) == len(pairs_found)
    if not empty:
        defects = {r["submission_id"]: r["defect"] for r in pairs_found}
        assert all(defects[k] == "empty" for k in (0, 1, 2, 3, 11)) and 7 not in defects
    assert {r["submission_id"] for r in truncation.found(df).collect()} <= keys
    assert sum(r["texts"] for r in truncation.report(df).collect()) == (0 if empty else len(EDGES))
    tables = langid.gather([("t", df, "submission_id", "text")])
    for out in (langid.found(tables), langid.languages(tables), langid.segments(tables)):
        assert {r["rec_id"] for r in out.collect()} <= keys
    spans = {}
    for r in sentences.split_documents(df, "submission_id").collect():
        spans.setdefault(r["submission_id"], []).append((r["start_char"], r["end_char"]))
    assert set(spans) == (set() if empty else {i for i, t in enumerate(EDGES) if t and t.strip()} - {0, 1, 2})
