"""Unify, near-duplicates, overlap, tokenizer and mixing against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jestlake.llm import blocks, bpe, mixing, neardup, overlap, unify
from jestlake.session import cut, ship

WORDS = "the a cat dog moon ladder sings paints under over bridge with lamp green swan angry tax clerk spoon soup walked home late again and then but so".split()


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def sentence(rng, n=24):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def edited(rng, text):
    words = text.split()
    for _ in range(2):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(99))
    words.insert(rng.randrange(len(words)), "honestly")
    return " ".join(words)


JOKES = [
    (1, "The cat sat."), (2, "Thе cat sat."), (3, "The\xa0cat sat."), (4, "The ca​t sat."), (5, "the cat sat."), (6, "The cat sat"), (7, None), (8, "  "), (9, "-"),
    (10, "Ｔｈｅ cat sat."), (11, "café ﬁne"), (12, "café fine"), (13, "一只猫。"), (14, "⼀只猫。"), (15, "The cat sat."), (16, "привет мир"), (17, "x" * 20000), (18, "x" * 19999 + "​x"),
]


def test_same_look(spark):
    df = spark.createDataFrame([(i, t, "form", 0) for i, t in JOKES], "k bigint, t string, form string, _c int")
    got = {tuple(r) for r in unify.same_look_pairs(df, "k", "t").collect()}
    cats = [1, 2, 3, 4, 10, 15]
    want = {(a, b) for a in cats for b in cats if a < b} - {(1, 15)} | {(11, 12), (13, 14), (17, 18)}
    assert got == want


def test_unify_forms(spark):
    df = spark.createDataFrame(JOKES, "k bigint, t string")
    forms = {r["k"]: r["form"] for r in unify.unify(df, "k", "t").collect()}
    assert len(forms) == len(JOKES) and forms[7] is None and forms[8] == "" and forms[2] == "The cat sat." and forms[16] == "привет мир"


def test_unify_keeps_unknown_words(spark):
    df = spark.createDataFrame([(1, "zоrgle is here"), (2, "here is nothing")], "k bigint, t string")
    assert {r["k"]: r["form"] for r in unify.unify(df, "k", "t").collect()}[1] == "zоrgle is here"


def test_dominant_script_both_ways(spark):
    texts = [(1, "привeт мир"), (2, "привет мир"), (3, "кoтёл кипит"), (4, "котёл кипит"), (5, "Αθήνα καλή"), (6, "Aθήνα καλή"), (7, "zоrgle"), (8, "zorglе"), (9, "a cat"), (10, "а cat"), (11, "а кот"), (12, "a кот")]
    df = spark.createDataFrame(texts, "k bigint, t string")
    assert {tuple(r) for r in unify.same_look_pairs(df, "k", "t").collect()} == {(1, 2), (3, 4), (5, 6), (9, 10), (11, 12)}


@pytest.mark.parametrize(
    "token,script,want",
    [("cаt", "Latn", ["cat"]), ("кoт", "Cyrl", ["кот"]), ("cat", "Latn", []), ("кот", "Latn", []), ("сосоа", "Latn", ["cocoa"]), ("сосоа", "Cyrl", []), ("жat", "Cyrl", []), ("ɡame", "Latn", ["game"])],
)
def test_repair_candidates(token, script, want):
    assert unify.repair_candidates(token, script) == want


@pytest.mark.parametrize("salted", [1, 7, 4096])
def test_copies_of_one_text(spark, monkeypatch, salted):
    monkeypatch.setattr(unify, "SALTED", salted)
    texts = ["The cat sat."] * 40 + ["Thе cat sat."] * 3 + ["The\xa0cat sat."] + ["cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    got = [tuple(r) for r in unify.same_look_pairs(df, "k", "t").collect()]
    want = {(i, j) for j in range(40, 44) for i in range(j) if texts[i] != texts[j]}
    assert set(got) == want and len(got) == len(want)


def test_emoji_joiners_stay():
    family = "\U0001f469‍\U0001f467 hi"
    assert unify.fold_text(family) == family and unify.fold_text("a‍b") == "ab"


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k bigint, t string, split string")
    assert unify.same_look_pairs(df, "k", "t").count() == 0
    assert neardup.same_pairs(df, "k", "t", "a", "b").count() == 0
    assert overlap.cross_split_pairs(df, "k", "t", "split").count() == 0
    assert bpe.encode(df, "k", "t").count() == 0


def corpus(seed=1, base=60):
    rng = random.Random(seed)
    rows = []
    for i in range(base):
        text = sentence(rng)
        rows.append(text)
        for _ in range(rng.choice([0, 0, 1, 2])):
            rows.append(edited(rng, text))
        if i % 7 == 0:
            rows += [text, text.upper()]
    rows += [None, "", "...", "one", "one"]
    rng.shuffle(rows)
    return [(i, t, rng.choice(["train", "test", "val", None])) for i, t in enumerate(rows)]


def brute(rows):
    sets = {k: set(neardup.shingle_hashes(neardup.tokens(t)).tolist()) for k, t, _ in rows if t and neardup.tokens(t)}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= neardup.SIMILARITY * len(sets[a] | sets[b])}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return near, {(a, b) for a in sets for b in sets if a < b and root(a) == root(b)}


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # of buckets and of groups
    rows = corpus()
    df = spark.createDataFrame(rows, "joke_id bigint, joke string, norm string")
    got = {tuple(r) for r in neardup.same_pairs(df, "joke_id", "joke", "a", "b").collect()}
    assert got == brute(rows)[1]


@pytest.mark.parametrize("block", [1024, 7])
def test_jokes_of_one_frame(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(9)
    frame = [f"frame{i}" for i in range(21)]  # unrelated jokes share it: 20 of 48 pairs of words, about 0.417
    texts = []
    for i in range(300):
        own = [f"own{i}x{k}" for k in range(14)]
        texts += [" ".join(frame + own), " ".join(frame + own[:10] + [f"other{i}x{k}" for k in range(4)])]
    rng.shuffle(texts)
    rows = [(i, t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "joke_id bigint, joke string, norm string")
    signed = neardup.signatures(neardup.text_classes(df, "joke_id", "joke")).cache()
    assert signed.selectExpr("explode(bands) as b").groupBy("b").count().where(F.col("count") > 64).count() > 0
    got = {tuple(r) for r in neardup.candidate_links(signed).collect()}
    # every agreeing pair that shares a bucket, by brute force
    held = {r["_id"]: (set(r["bands"]), (r["s0"] & (1 << 64) - 1) << 64 | r["s1"] & (1 << 64) - 1) for r in signed.collect()}
    want = {(a, b) for a in held for b in held if a < b and (held[a][1] ^ held[b][1]).bit_count() <= neardup.SKETCH_BITS - neardup.SKETCH_AGREE and held[a][0] & held[b][0]}
    assert got == want
    # of the pairs that really are near, sharing buckets with hundreds of others, hardly any is lost
    sets = {k: set(s) for k, s in ((r["_id"], r["shingles"]) for r in signed.collect())}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    found = {(r["a"], r["b"]) for r in neardup.verified(neardup.candidate_links(signed), signed).collect()}
    assert found <= near and len(near) >= 300 and len(found) >= 0.98 * len(near)


def test_passes_over_the_bands_give_all_links(spark, monkeypatch):
    rows = [(i, t, None) for i, t, _ in corpus(8)]
    df = spark.createDataFrame(rows, "joke_id bigint, joke string, norm string")
    signed = neardup.signatures(neardup.text_classes(df, "joke_id", "joke"), bands=False).cache()
    assert "bands" not in signed.columns
    whole = {tuple(r) for r in neardup.candidate_links(signed).collect()}
    for passed, bands, block in ((1, 8, 1024), (1, 24, 2)):
        monkeypatch.setattr(neardup, "PASS", passed)
        monkeypatch.setattr(neardup, "PASS_BANDS", bands)
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = [tuple(r) for r in neardup.candidate_links(signed).collect()]
        assert len(got) == len(set(got)) and set(got) == whole and whole
    half = signed.withColumn("side", F.when(F.col("_id") > 0, 1).otherwise(2))
    assert {tuple(r) for r in neardup.candidate_links(half).collect()} == {(a, b) for a, b in whole if a < 0 < b}


def test_near_duplicates_hold_little_disk(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    rows = [(i, sentence(rng, 60)) for i in range(3000)]
    spark.createDataFrame(rows, "k bigint, t string").coalesce(1).write.parquet(str(tmp_path / "in"))
    df, shared, held = spark.read.parquet(str(tmp_path / "in")), Path(spark.conf.get("spark.checkpoint.dir")), []
    blocks_on_disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def size():
        files = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks_on_disk.getAllFiles())
        return sum(p.stat().st_size for p in shared.rglob("*.parquet")) + sum(f.length() for f in files if f.getName().startswith("shuffle_"))

    def watched(df):
        out = cut(df)
        held.append(size())
        return out

    before, source = size(), sum(p.stat().st_size for p in (tmp_path / "in").glob("*.parquet"))
    monkeypatch.setattr(neardup, "cut", watched)
    monkeypatch.setattr(unify, "cut", watched)
    neardup.same_groups(df, "k", "t")
    assert held and max(held) - before < 4 * source
    assert held[-1] - before < 0.5 * source  # signatures, texts and buckets are gone


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_within_groups_of_any_size(spark, block):
    sizes = {0: 1, 1: 2, 2: 3, 3: 4, 4: 31}
    rows = [(g, 100 * g + i, n) for g, n in sizes.items() for i in range(n)]
    met = blocks.pairs_within(spark.createDataFrame(rows, "g int, k int, n int"), "g", "k", "n", block).select("a.k", "b.k").collect()
    got = [tuple(sorted(r)) for r in met]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for g, a, _ in rows for h, b, _ in rows if g == h and a < b}


def test_key_filter_keeps_every_key(spark):
    keys = spark.range(0, 5000, 1, 3).selectExpr("xxhash64(id) as k")
    others = spark.range(5000, 45000).selectExpr("id", "xxhash64(id) as k")
    held = blocks.key_filter(keys)
    assert blocks.passing(keys, "k", held).count() == 5000
    assert blocks.passing(others, "k", held).count() < 400
    assert blocks.passing(others, "k", blocks.key_filter(keys.where("false"))).count() == 0


@pytest.mark.parametrize("block", [2, 1000])
def test_expanded_links(spark, block):
    left = [("x", 1), ("x", 2), ("x", 3), ("y", 4), ("u", 9)]
    right = [("z", 5), ("z", 6), ("x", 7), ("w", 8)]
    links = [("x", "z"), ("y", "z"), ("x", "x"), ("y", "none")]
    frames = [spark.createDataFrame(r, s) for r, s in ((links, "a string, b string"), (left, "cls string, k int"), (right, "cls string, k int"))]
    got = [tuple(r) for r in blocks.expand_links(*frames, block).collect()]
    assert sorted(got) == sorted((k, m) for a, b in links for c, k in left for d, m in right if a == c and b == d)


def test_components_say_when_they_are_not_done(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        neardup.components(path, max_rounds=1)


def test_overlap(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(*r, "s" if i % 3 else None, i % 4) for i, r in enumerate(rows)], "joke_id bigint, joke string, split_name string, source string, labels int")
    got = {tuple(r) for r in overlap.found(df).collect()}
    side = {k: s for k, _, s in rows}
    want = {(a, b) for a, b in brute(rows)[0] if side[a] and side[b] and (side[a] == "train") != (side[b] == "train")}
    assert got == want
    rep = overlap.report(df).collect()
    assert sum(r["pairs"] for r in rep) == len(want)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == root(x) for x in list(parent))


def reference_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_matches_public_encoder(spark):
    enc = reference_encoder()
    texts = [None, "", " ", "<|endoftext|> plain", "don't we'll", "a" * 4000, "一只猫跳过了月亮。" * 50, "x\r\n\ty  z", "😀👩‍👧", "Ünïcödé naïve"]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    got = {r["k"]: r["ids"] for r in bpe.encode(df, "k", "t").collect()}
    assert all(got[i] == (enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    back = bpe.encoder().bytes_of
    assert all(b"".join(back[x] for x in got[i]).decode() == (t or "") for i, t in enumerate(texts))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_library_encoders(spark, name):
    texts = [None, "", "A cat <|endoftext|> sat.", "一只猫", "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    got = {r["k"]: r["ids"] for r in bpe.encode_by_library(df, "k", "t", f"/opt/tokenizers/{name}").collect()}
    assert got[0] == got[1] == [] and all(got[i] for i in (2, 3, 4)) and 49407 not in got[2]


def test_multilingual_ranks():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    texts = [sentence(rng) + " 一只猫跳过月亮 Ünï ñandú こんにちは" + "".join(chr(rng.randrange(32, 0x3100)) for _ in range(30)) for _ in range(200)]
    assert all(list(ids) == enc.encode_ordinary(t) for ids, t in zip(bpe.encoder(path).encode_batch(texts), texts))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_encoding_of_any_text(text):
    assert list(bpe.encoder().encode_batch([text])[0]) == test_encoding_of_any_text.enc.encode_ordinary(text)


test_encoding_of_any_text.enc = reference_encoder()


def mix_tables(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 80))), "big" if i % 3 else "small" if i % 2 else None) for i in range(600)]
    docs += [(9000, None, "big"), (9001, "", "small"), (9002, "hello there", "other")]
    targets = [("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.0, 2), (None, 0.1, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mixing(spark):
    docs, targets = mix_tables(spark)
    got = mixing.chosen(docs, targets).collect()
    assert {r["source"] for r in got} == {"big", "small"} and all(r["repeats"] <= (1 if r["source"] == "big" else 3) for r in got)
    per = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    assert per["big"]["actual_share"] == pytest.approx(0.5, abs=0.01) and per["small"]["actual_share"] == pytest.approx(0.5, abs=0.01) and per["absent"]["tokens"] == 0
    # a size beyond what a source holds: it gives all its repeats
    used = mixing.mix(docs, targets, total_tokens=10**6)
    most = {(r["source"]): r["n"] for r in used.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("n")).collect()}
    assert most == {"big": 1, "small": 3}


def test_schedule_is_even(spark):
    plan = mixing.schedule(spark, [("a", 0.5), ("b", 0.3), ("c", 0.2)], 9000).collect()
    assert len(plan) == 9000
    for name, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        own = sorted((r["slot"], r["rank"]) for r in plan if r["source"] == name)
        assert [k for _, k in own] == list(range(len(own))) and abs(len(own) - 9000 * share) < 12
        gaps = np.diff([s for s, _ in own])
        assert gaps.max() <= 2.7 / share


def test_mixing_nothing(spark):
    docs, targets = mix_tables(spark)
    assert mixing.chosen(docs.where("false"), targets).count() == 0
    assert mixing.chosen(docs, targets.where("false")).count() == 0
