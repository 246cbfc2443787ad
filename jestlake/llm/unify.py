"""Problem 7: texts that look the same but differ in their characters get one consistent form.

Method: script-aware repair. A code-point fold (width, spaces, invisible characters, ligatures, radicals, composition)
is followed by look-alike repair of tokens that mix scripts (Latin, Greek, Cyrillic, Armenian): the dominant script of the
token is determined, letters of other scripts are replaced by their look-alikes of that script, and the replacement holds
only when the corpus vocabulary knows the result. Letters that only one script has decide what is dominant, then the number
of letters, then the text's dominant script; where the vocabulary doesn't know the token in its dominant script, the next
one is tried. A token made only of letters that look alike in several scripts says nothing by itself: its text's dominant
script decides whether it is foreign there.

Defined results: a null text gives a null form; an empty or blank text gives ''. Tokens with a letter that has no look-alike
in the dominant script stay as they are. Helper columns carry a reserved prefix so that clashing names cannot occur. An empty
table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import expand_links, pairs_within

SALTED = 4096  # copies of one text that are expanded in one task

# CJK radical forms and the ideographs that look like them (the Kangxi block has NFKC mappings already).
RADICALS = dict(
    (line[0], line[1])
    for line in """
⺁厂 ⺃乚 ⺅亻 ⺆冂 ⺉刂 ⺊卜 ⺋㔾 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺗㣺 ⺘扌 ⺙攵 ⺛旡 ⺜日 ⺝月 ⺞歺 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺥爫 ⺦丬
⺧牛 ⺨犭 ⺩王 ⺪疋 ⺫罒 ⺬示 ⺭礻 ⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺶羊 ⺸羊 ⺹耂 ⺺肀 ⺻聿 ⺽臼 ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻇角 ⻈讠
⻉贝 ⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻠饣 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦
⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀 ⻳龟
""".split()
)
# Letters of other scripts (and phonetic letters) that print like a Latin letter.
LOOKALIKES = dict(
    (pair[0], pair[1])
    for pair in """
ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa νv οo ρp ιi κk υu ϲc ϳj ϹC
АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ӀI ԌG ԚQ ԜW ԁd ԛq ԝw аa еe оo рp сc уy хx ѕs іi јj һh ӏl ѵv үy
օo սu հh ոn ցg զq ՏS ՕO ՍU ɡg ɑa ɩi ʏY
""".split()
)


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for cp in [*range(0xFB00, 0xFB07), *range(0x2F00, 0x2FD6), *range(0xFF01, 0xFFEF)]:
        folded = unicodedata.normalize("NFKC", chr(cp))
        if folded != chr(cp):
            table[cp] = folded
    for cp in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]:
        table[cp] = " "
    for cp in [0xAD, 0x34F, 0x61C, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0000, 0xE0080)]:
        table[cp] = None
    for cp in (0x2010, 0x2011):
        table[cp] = "-"
    for radical, ideograph in RADICALS.items():
        table[ord(radical)] = ideograph
    return table


_FOLD = _fold_table()
_TOKEN = re.compile(r"[^\W\d_]+")
_SUSPECT = re.compile("[" + "".join(LOOKALIKES) + "\u0370-\u058f\u1f00-\u1fff]")
_EMOJI_JOIN = re.compile("(?<=[\U0001f000-\U0001faff☀-➿])[‍️]+")
_SPACES = re.compile(r"[ \t]+")


def fold_text(text: str) -> str:
    """Code-point fold of one text: everything but the look-alike letters."""
    if text.isascii():
        return text.strip()
    held = _EMOJI_JOIN.search(text) is not None
    if held:  # joiners that shape an emoji are visible
        text = _EMOJI_JOIN.sub(lambda m: m[0].replace("\u200d", "\ue000").replace("\ufe0f", "\ue001"), text)
    text = unicodedata.normalize("NFC", text.translate(_FOLD))
    if held:
        text = text.replace("\ue000", "\u200d").replace("\ue001", "\ufe0f")
    return text.strip()


def script_of(ch: str) -> str | None:
    """Latn, Grek, Cyrl, Armn, or None for letters of other scripts."""
    cp = ord(ch)
    if cp < 0x2B0 or 0x1E00 <= cp < 0x1F00:
        return "Latn"
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return "Grek"
    if 0x400 <= cp < 0x530:
        return "Cyrl"
    return "Armn" if 0x530 <= cp < 0x590 else None


SCRIPTS = ("Latn", "Grek", "Cyrl", "Armn")


def _targets() -> dict[str, dict[str, str]]:
    """Per script: each letter of the others (and each phonetic letter) with its look-alike there; the first one named counts."""
    to: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    by_latin: dict[str, dict[str, str]] = {}
    for letter, latin in LOOKALIKES.items():
        to["Latn"][letter] = latin
        by_latin.setdefault(latin, {}).setdefault(script_of(letter), letter)
    for latin, same in by_latin.items():
        same.pop("Latn", None)
        for script, letter in same.items():
            to[script].setdefault(latin, letter)
    for letter, latin in LOOKALIKES.items():
        for script, own in by_latin[latin].items():
            if script != script_of(letter):
                to[script].setdefault(letter, own)
    return to


_TO = _targets()
_SHARED = {ch for table in _TO.values() for ch in table}  # letters that look alike in several scripts


def script_counts(text: str) -> dict[str, tuple[int, int]]:
    """(letters only this script has, letters) by script."""
    out: dict[str, tuple[int, int]] = {}
    for ch in text:
        if ch.isalpha() and (s := script_of(ch)) is not None:
            own, every = out.get(s, (0, 0))
            out[s] = (own + (ch not in _SHARED), every + 1)
    return out


def repair_candidates(token: str, text_script: str | None) -> list[str]:
    """The look-alike substitutions proposed for a token, the one in its dominant script first; none for a token of one script.

    text_script: the dominant script of its text.
    """
    if not _SUSPECT.search(token) and text_script in (None, "Latn"):
        return []
    counts = script_counts(token)
    if len(counts) == 1 and not any(ch in LOOKALIKES and script_of(ch) == "Latn" for ch in token):
        (only, (own, _)), = counts.items()
        if own or text_script in (None, only):
            return []
        order = [text_script]
    else:
        order = sorted(counts, key=lambda s: (-counts[s][0], -counts[s][1], s != text_script, SCRIPTS.index(s)))
    out = []
    for script in order:
        table = _TO[script]
        fixed = "".join(table.get(ch, ch) for ch in token)
        if fixed != token and all(script_of(ch) == script for ch in fixed if ch.isalpha()):
            out.append(fixed)
    return out


def text_script(text: str) -> str | None:
    """The script of most of a text's letters, those that only one script has first."""
    counts = script_counts(text)
    return max(counts, key=lambda s: (counts[s], -SCRIPTS.index(s))) if counts else None


def _folded_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms, words = [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            if text is None:
                forms.append(None)
                words.append([])
                continue
            form = fold_text(text)
            found: list[str] = []
            if not form.isascii() and _SUSPECT.search(form):
                main = text_script(form)
                for token in set(_TOKEN.findall(form)):
                    for rank, fixed in enumerate(repair_candidates(token, main)):
                        found += [token, str(rank), fixed]
            forms.append(form)
            words.append(found)
        columns = batch.columns[:-1] + [pa.array(forms, pa.string()), pa.array(words, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "_u_form", "_u_words"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index
        forms = batch.column(at("_u_form")).to_pylist()
        fixes = batch.column(at("_u_fixes")).to_pylist()
        for i, pairs in enumerate(fixes):
            if pairs and forms[i] is not None:
                known = {p["_u_from"]: p["_u_to"] for p in sorted(pairs, key=lambda p: p["_u_rank"], reverse=True)}
                forms[i] = _TOKEN.sub(lambda m: known.get(m[0], m[0]), forms[i])
        keep = [n for n in batch.schema.names if n not in ("_u_form", "_u_fixes")]
        yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in keep), pa.array(forms, pa.string())], names=[*keep, "form"])


def _unified(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_u_key, _u_raw, form): each record's form and a hash of its code points; _made_of: the cut it reads."""
    raw = F.unhex(F.md5(F.col(text).cast("binary")))
    source = df.select(F.col(key).alias("_u_key"), raw.alias("_u_raw"), F.col(text).alias("_u_text"))
    key_type = source.schema["_u_key"].dataType.simpleString()
    # read by several branches below: folded once, not once a branch
    folded = cut(source.mapInArrow(_folded_batches, f"_u_key {key_type}, _u_raw binary, _u_form string, _u_words array<string>"))
    pairs = F.expr("transform(sequence(0, cast(size(_u_words) / 3 as int) - 1), i -> struct(_u_words[3 * i] as _u_from, cast(_u_words[3 * i + 1] as int) as _u_rank, _u_words[3 * i + 2] as _u_to))")
    suspects = folded.where(F.size("_u_words") > 0).select("_u_key", F.explode(pairs).alias("p")).select("_u_key", "p.*")
    wanted = suspects.select(F.lower("_u_to").alias("_u_word")).distinct()
    plain = folded.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_u_form"), F.lit(r"([\p{L}\p{M}]+)"), 1))).alias("_u_word"))
    known = plain.groupBy("_u_word").agg(F.count("*").alias("_u_n")).join(wanted, "_u_word", "left_semi").select("_u_word")
    fixes = (
        suspects.join(known, F.lower(suspects["_u_to"]) == known["_u_word"], "left_semi")
        .groupBy("_u_key")
        .agg(F.collect_list(F.struct("_u_from", "_u_rank", "_u_to")).alias("_u_fixes"))  # bounded by the text's own tokens
    )
    whole = folded.where(F.size("_u_words") == 0).select("_u_key", "_u_raw", F.col("_u_form").alias("form"))
    mended = (
        folded.where(F.size("_u_words") > 0)
        .select("_u_key", "_u_raw", "_u_form")
        .join(fixes, "_u_key", "left")
        .mapInArrow(_applied, f"_u_key {key_type}, _u_raw binary, form string")
    )
    out = whole.unionByName(mended)
    out._made_of = folded
    return out


def unify(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form): the consistent form of each record's text.

    Only texts that hold a look-alike letter take part in the vocabulary check; the vocabulary itself is counted over all
    records (one count per record and word, combined before the shuffle) and joined by word, never broadcast.
    """
    unified = _unified(df, key, text)
    out = unified.select(F.col("_u_key").alias(key), "form")
    out._made_of = unified._made_of
    return out


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_id_a, rec_id_b): pairs of records whose forms agree while their code points differ; '-' and blank are none.

    Equal texts collapse to one class before pairing; only classes of different code points meet. Their pairs are expanded
    last, over salts in proportion to the size of each class, so that the copies of one text spread over many tasks and
    are never held against each other.
    """
    rows = cut(_unified(df, key, text).where("form not in ('', '-')").select(F.col("_u_key").alias("k"), F.unhex(F.md5(F.col("form").cast("binary"))).alias("f"), F.col("_u_raw").alias("r")))
    classes = rows.groupBy("f", "r").agg(F.count("*").alias("_n"))
    variants = classes.join(classes.groupBy("f").agg(F.count("*").alias("n")).where("n > 1"), "f")
    met = cut(pairs_within(variants, "f", "r", "n").select(F.col("a.r").alias("a"), F.col("b.r").alias("b")))
    members = rows.select(F.col("r").alias("cls"), "k")
    pairs = expand_links(met, members, members, SALTED)
    return pairs.select(F.least("ka", "kb").alias("rec_id_a"), F.greatest("ka", "kb").alias("rec_id_b"))
