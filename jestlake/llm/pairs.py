"""Problem 2: broken prompt and response pairs, each with its defect.

Method: responses are sorted by text and neighbours' common prefixes are compared to find shortened versions; length-limit
spikes are detected (truncation); then copy, refusal and language rules apply. Defects are exclusive, in the order empty,
copied, refusal, language, truncated.

Defined results: a null or blank answer is empty; an answer whose prompt is missing, null or empty can't be copied; an
answer whose prompt id names no known language has no language defect; undetermined texts have none either; repeated rows
get equal defects; answers and prompts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import langid, truncation
from .neardup import tokens
from .unify import fold_text

SHORTENED_ODDS = -1.0  # log odds of an incomplete ending that a shortened version needs
_QUOTED = re.compile(r"[\"“«„「『][^\"”»“」』]*[\"”»“」』]")
_SUBJECT = re.compile(r"['‘’\"“「](.+)['’\"”」]")
# Words of consent that may precede a copy.
CONSENT = [tokens(x) for x in ("of course", "sure", "okay", "ok", "certainly", "por supuesto", "claro", "vale", "好的", "当然", "没问题", "bien sûr", "claro que sí", "gerne", "natürlich", "はい")]
# How a writer declines, in the first person or impersonally, by language.
REFUSALS = re.compile(
    r"""
    \b(?:i|we)(?:['’]m|\ am|['’]d|['’]ll|\ would)?\ (?:\w+\ ){0,2}?(?:can['’]t|cannot|can\ not|won['’]t|will\ not|not\ able|unable|must\ (?:pass|decline|refuse)|have\ to\ (?:pass|decline|refuse)|rather\ not|prefer\ not|not\ comfortable|do\ not\ want|don['’]t\ (?:want|think\ i\ should))\b
    | \bno\ jokes?\ can\ be\b | \b(?:not|n['’]t)\ be\ appropriate\ for\ (?:me|us)\b | \binappropriate\ for\ (?:me|us)\b | \bagainst\ my\ (?:guidelines|rules|policy|policies|principles)\b
    | \bno\ (?:puedo|podemos|podré|quiero|voy\ a|debo)\b | \bno\ (?:me\ )?es\ posible\b | \bprefiero\ no\b | \bno\ sería\ (?:apropiado|adecuado|correcto)\b | \bcontra\ mis\ (?:normas|reglas|principios|directrices)\b | \b(?:tengo\ que|debo)\ (?:rechazar|declinar|negarme)\b | \bno\ se\ puede\ (?:ofrecer|dar|hacer|proporcionar)\b
    | (?:^|[，。！？,!?:：]\s*)(?:但是|但|所以|因此|可是)?(?:我|本人)(?:还是|真的|可能|恐怕|也|现在|暂时|必须|只能)?(?:不能|无法|不会|不想|不便|没法|拒绝|不(?:调侃|开玩笑|写|讲|拿)) | 由我来[^，。！？]{0,12}不合适 | 违反我的 | 只能(?:拒绝|婉拒) | 恕难 | (?:无法|不能)(?:提供|满足|完成)
    | \bje\ (?:ne\ (?:peux|veux|vais|souhaite)|préfère\ ne|dois\ (?:refuser|décliner))\b | \bich\ (?:kann|möchte|darf|will|werde)\b[^.!?]{0,60}\b(?:nicht|kein\w*)\b | \bich\ muss\b[^.!?]{0,40}\bablehnen\b
    | \b(?:não\ (?:posso|vou|quero|consigo)|prefiro\ não|tenho\ (?:de|que)\ recusar)\b | できません | お断り | 控えさせて
    """,
    re.IGNORECASE | re.VERBOSE,
)


def copies(answer: str, prompt: str | None) -> bool:
    """Whether the answer only repeats the prompt or its subject."""
    if not prompt or not prompt.strip():
        return False
    said, asked = tokens(fold_text(answer)), tokens(fold_text(prompt))
    for lead in CONSENT:
        if said[: len(lead)] == lead and len(said) > len(lead):
            said = said[len(lead) :]
            break
    if not said or not asked:
        return False
    shared = sum((Counter(said) & Counter(asked)).values())
    if shared < 0.9 * len(said):
        return False
    if shared >= 0.85 * len(asked):
        return True
    match = _SUBJECT.search(prompt)
    subject = tokens(fold_text(match[1])) if match else []
    about = sum((Counter(said) & Counter(subject)).values())
    # the subject is there to its end: an answer that breaks off inside it is truncated instead
    return bool(subject) and (about == len(subject) or (about >= 0.93 * len(subject) and said[-1] == asked[-1]))


# What goes with declining: regret, thanks for the request, its subject, offers of something else.
COURTESY = re.compile(
    r"""
    \b(?:sorry|apologi[sz]e|apologies|unfortunately|regret|thank\ you\ for\ asking|thanks\ for|request|prompt|topic|theme|subject|something\ else|help\ you\ with|feel\ free|ask\ me|instead|sensitive|hurt|respect)\b
    | \b(?:lo\ siento|disculpa|perdona|por\ desgracia|lamentablemente|lamento|gracias\ por|petición|tema|pregúntame|prueba\ con|otra\ cosa|delicado|herir)\b
    | 抱歉|对不起|不好意思|遗憾|谢谢你的提问|请求|话题|别的事情|欢迎问|换一个|敏感|伤害
    | \b(?:désolée?|malheureusement|regrette|demande|sujet|autre\ chose|tut\ mir\ leid|leider|entschuldigung|anfrage|thema|etwas\ anderes|desculpe|infelizmente|lamento|pedido|assunto|outra\ coisa)\b
    | 申し訳|すみません|残念|ご依頼|話題|別の
    """,
    re.IGNORECASE | re.VERBOSE,
)


def refuses(answer: str) -> bool:
    """Whether the writer, not somebody in a joke, declines: one sentence does, and at least half of all do or go with it.

    Words in quotation marks are nobody's refusal; where and how far in the sentence stands makes no difference.
    """
    plain = fold_text(answer)
    if len(plain) > 1 and plain[0] in "\"“«‘'" and plain[-1] in "\"”»’'":
        plain = plain[1:-1]  # the whole answer stands in quotes
    if not REFUSALS.search(plain):
        return False
    parts = truncation.units(_QUOTED.sub(" ", plain))
    declining = [REFUSALS.search(p) is not None for p in parts]
    polite = [d or COURTESY.search(p) is not None for d, p in zip(declining, parts)]
    return any(declining) and 2 * sum(polite) >= len(parts)


_MARKS = " \t\n\r\xa0\u3000.…。!?！？�\"'“”’»」』)）"
_ENDS_THERE = re.compile(r"[\s.!?…。！？\"”»]*$|[.!?。！？…\r\n]")


def goes_on(stem: str, longer: str) -> bool:
    """Whether a text that begins with the stem goes on in the middle of a sentence."""
    return _ENDS_THERE.match(longer, len(stem)) is None


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_k, _t) to (_k, stem): texts without the marks at their end; texts of marks alone give no row."""
    for batch in batches:
        stems = [t.rstrip(_MARKS) for t in batch.column(1).to_pylist()]
        keep = pa.array([i for i, s in enumerate(stems) if s], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), pa.array([s for s in stems if s], pa.string())], names=["_k", "stem"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct stems of a partition to (stem, begun): those that another one goes on from, and those still open at its end.

    The stems that begin the present one are held, the longest last; sorting puts all that begin with a stem right behind it.
    """
    held: list[list] = []  # [stem, whether another one goes on from it]
    done: list[str] = []
    for batch in batches:
        for text in batch.column(0).to_pylist():
            while held and not text.startswith(held[-1][0]):
                stem, begun = held.pop()
                if begun:
                    done.append(stem)
            for entry in held:
                if not entry[1]:
                    entry[1] = goes_on(entry[0], text)
            held.append([text, False])
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array([True] * len(done), pa.bool_())], names=["stem", "begun"])
        done = []
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], pa.string()), pa.array([b for _, b in held], pa.bool_())], names=["stem", "begun"])


def _reopened(batches: Iterator[pa.RecordBatch], held: list[str]) -> Iterator[pa.RecordBatch]:
    """Stems to those of the held ones that one of them goes on from."""
    above: list[int] = []  # of each held stem the longest other one that begins it
    for i, stem in enumerate(held):
        k = i - 1
        while k >= 0 and not stem.startswith(held[k]):
            k = above[k]
        above.append(k)
    found: set[str] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            k = bisect_right(held, text) - 1
            while k >= 0:
                if len(held[k]) < len(text) and text.startswith(held[k]) and goes_on(held[k], text):
                    found.add(held[k])
                k = above[k]
    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["stem"])


def shortened(rows: DataFrame) -> DataFrame:
    """(_k): answers that begin another one, which goes on in the middle of the sentence.

    Equal texts collapse first, and marks at the end of a text are no part of it. Distinct texts are range-partitioned and
    sorted; each is compared with the neighbours before it that it begins with. What begins the last text of a partition may
    go on in the next ones: those few (a partition's nested beginnings of one text) are held against all texts in a second
    pass.
    """
    kind = rows.schema["_k"].dataType.simpleString()
    texts = cut(rows.select("_k", "_t").where("_t is not null").mapInArrow(_stems, f"_k {kind}, stem string"))
    distinct = texts.select("stem").distinct()
    scanned = cut(distinct.repartitionByRange("stem").sortWithinPartitions("stem").mapInArrow(_neighbours, "stem string, begun boolean"))
    begun = scanned.where("begun").select("stem")
    held = sorted(r["stem"] for r in scanned.where("not begun").select("stem").collect())  # bounded by the partitions, not the rows
    if held:
        shared = rows.sparkSession.sparkContext.broadcast(held)
        begun = begun.union(texts.select("stem").mapInArrow(lambda it: _reopened(it, shared.value), "stem string")).distinct()
    return texts.join(begun, "stem", "left_semi").select("_k")


def _ruled(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(_k, _id, _t, _p) to (_k, defect) by all rules but truncation."""
    for batch in batches:
        ids, texts, prompts = (batch.column(i).to_pylist() for i in (1, 2, 3))
        defects: list[str | None] = [None] * batch.num_rows
        open_rows = []
        for i, text in enumerate(texts):
            if text is None or truncation.announces(text):
                defects[i] = "empty"
            elif copies(text, prompts[i]):
                defects[i] = "copied"
            elif refuses(text):
                defects[i] = "refusal"
            else:
                open_rows.append(i)
        if open_rows and model is not None:
            owner, _, lang, _, letters = model.parts([texts[i] for i in open_rows])
            held: list[set[int]] = [set() for _ in open_rows]
            for o, k, n in zip(owner, lang, letters):
                if n > 0:
                    held[o].add(int(k))
            for i, langs in zip(open_rows, held):
                wanted = (ids[i] or "").split("_")[0]
                if wanted in langid.LANGS and langs and -1 not in langs and langid.LANGS.index(wanted) not in langs:
                    defects[i] = "language"
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(defects, pa.string())], names=["_k", "defect"])


def defective(answers: DataFrame, prompts: DataFrame, key: str = "submission_id", link: str = "id", text: str = "text", source: str = "model") -> DataFrame:
    """(key, defect): every defective answer with its defect."""
    # written first, so that its size is known: the answers stay where they are if the prompts can be broadcast
    asked = cut(prompts.select(F.col(link).alias("_id"), F.col("prompt").alias("_p")).where("_id is not null").groupBy("_id").agg(F.max("_p").alias("_p")))
    rows = answers.select(F.col(key).alias("_k"), F.col(link).alias("_id"), F.col(text).alias("_t"))
    kind = rows.schema["_k"].dataType.simpleString()
    labelled = answers.select(F.lit("answers").alias("src_table"), F.xxhash64(key).alias("rec_id"), F.col("lang"), F.col(text).alias("text"))
    sample = langid.sample_labelled(labelled)
    model = answers.sparkSession.sparkContext.broadcast(langid.Identifier(sample) if sample else None)  # bounded by the sample
    ruled = cut(rows.join(asked, "_id", "left").select("_k", "_id", "_t", "_p").mapInArrow(lambda it: _ruled(it, model.value), f"_k {kind}, defect string"))
    ends = truncation.judged(answers, key, text, source)
    short = shortened(rows).distinct().withColumn("_short", F.lit(True))
    broken = ends.join(short, "_k", "left").where(F.col("truncated") | (F.col("_short") & (F.col("odds") > SHORTENED_ODDS))).select("_k", F.lit("truncated").alias("_cut"))
    return ruled.join(broken, "_k", "left").select(F.col("_k").alias(key), F.coalesce("defect", "_cut").alias("defect")).where("defect is not null")
