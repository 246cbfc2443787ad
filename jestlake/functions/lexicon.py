"""Fixed values of the scorers: templates, phrase lists, thresholds, patterns. All are compared as plain text."""

from __future__ import annotations

LANGUAGES = ("en", "zh", "es")
CLASSES = 11  # labels 0..10
MISSING = "-"

# White space as Python's str.split sees it, for character classes of any regex engine.
WS = r"[\t-\r\x1c- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_WS = WS.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]"

# Prompt templates, {a} and {b} the words, {h} the headline.
PAIR_PROMPTS = {
    "en": "Generate a funny joke using these two words: '{a}', '{b}'. Only respond with the joke and nothing else.",
    "zh": "用这两个词生成一个有趣的笑话：'{a}'、'{b}'。只回复笑话，不要回复其他内容。",
    "es": "Genera un chiste gracioso usando estas dos palabras: '{a}', '{b}'. Solo responde con el chiste y nada más.",
}
HEADLINE_PROMPTS = {
    "en": "Generate a funny joke related to this headline: '{h}'. Only respond with the joke and nothing else.",
    "zh": "根据这个标题生成一个有趣的笑话：'{h}'。只回复笑话，不要回复其他内容。",
    "es": "Genera un chiste gracioso relacionado con este titular: '{h}'. Solo responde con el chiste y nada más.",
}
FALLBACK_PROMPT = "Generate a funny joke."
EARLY_PAIR_PROMPT = "Generate the funniest possible joke that contains these two words: '{a}', '{b}'."
EARLY_HEADLINE_PROMPT = "Generate a funny joke related to this headline: '{h}' by either modifying it or responding to it."

# What a word-pair prompt looks like; the first that matches gives the words.
PAIR_PATTERNS = (
    rf"(?i)(?:using|contains){WS}+these{WS}+two{WS}+words:{WS}*'([^']+)'{WS}*,{WS}*'([^']+)'",
    rf"(?i)用这两个词[^：]*：{WS}*'([^']+)'[、,]{WS}*'([^']+)'",
    rf"(?i)usando{WS}+estas{WS}+dos{WS}+palabras:{WS}*'([^']+)'{WS}*,{WS}*'([^']+)'",
)
EARLY_PAIR_PATTERN = rf"(?i)contains{WS}+these{WS}+two{WS}+words:{WS}*'([^']+)'{WS}*,{WS}*'([^']+)'"

# Validity of a single joke.
QUESTION_WORD = {"en": "why ", "zh": "为什么", "es": "por qué"}
DIALOGUE_MARKS = {"en": ("q:", "a:"), "zh": ("问：", "答："), "es": ("p:", "r:")}
MAX_LINES = 3

# Structure tags in the order they are tried, and their patterns (on the lowered text).
STRUCTURES = ("why-did", "where-did", "how-did", "what-do-you-call", "knock-knock", "qa-punchline", "observation", "one-liner")
_DID = rf"{WS}+(?:did|didn't|do|dont|don't|were|weren't|was|wasn't){WS}+{WORD}+"
STRUCTURE_PATTERNS = {
    "en": {"why-did": rf"why{_DID}", "where-did": rf"where{_DID}", "how-did": rf"how{_DID}", "what-do-you-call": rf"what{WS}+do{WS}+you{WS}+call", "knock-knock": rf"knock{WS}+knock"},
    "zh": {"why-did": "为什么", "where-did": "在哪|哪里|哪儿", "how-did": "怎么", "what-do-you-call": "什么叫|叫什么|算什么", "knock-knock": "敲门|咚咚"},
    "es": {"why-did": rf"por{WS}*qué", "where-did": "dónde", "how-did": "cómo", "what-do-you-call": rf"cómo{WS}+se{WS}+llama|qué{WS}+es", "knock-knock": rf"toc{WS}*toc"},
}
EARLY_WHERE_PATTERN = rf"where{WS}+(?:did|do|were|was){WS}+{WORD}+"
OBSERVATIONS = {"en": (" is like ", " is when "), "zh": ("就像", "好比", "仿佛"), "es": (" es como ", " parece ", " cuando ")}

# Headline adherence.
HEADLINE_SKIP = {"en": ("two words", "these words"), "zh": ("两个词", "这两个词"), "es": ("dos palabras", "estas palabras")}
HEADLINE_BAD = {"en": ("headline", "generate"), "zh": ("标题", "生成"), "es": ("titular", "genera")}
HEADLINE_MAX = {"en": 25, "zh": 50, "es": 28}

# Phrases of talk around a joke (compared case-sensitively).
CHATTER = {
    "en": ("How about: ", "This joke", "Let me know", "Note: ", "Here's", "Sure!", "You're welcome!", "That joke", "Joke:"),
    "zh": ("这个笑话", "怎么样", "注意：", "提示：", "让我", "好的，", "告诉我", "这是", "当然！", "不客气！", "那个笑话"),
    "es": ("Qué tal: ", "Este chiste", "Avísame", "Nota: ", "Aquí tienes", "Aquí está", "¡Claro!", "¡De nada!", "Ese chiste", "Chiste:"),
}
EARLY_CHATTER = ("How about: ", "This joke", "Let me know", "Note: ")

# Length penalty (least, most, best), in words or, for zh, characters that are no white space.
LENGTHS = {"en": (5, 24, 16), "zh": (10, 60, 35), "es": (5, 28, 18)}
# Coherence limits.
CAPITALS_LIMIT, PUNCTUATION_LIMIT, COHERENCE_WEIGHT = 0.2, 0.15, 0.5
ZH_PUNCTUATION = '[，。！？、；："【】《》（）]'

# Weights of the composite rewards.
COMPOSITE_WEIGHTS = {"rater": 1.0, "word_pair": 2.0, "formatting": 0.5, "length": 0.5, "coherence": 0.5}
TRAINING_WEIGHTS = {"rater": 1.0, "diversity": 1.5, "word_pair": 2.0, "formatting": 0.5, "length": 0.5, "headline": 2.0, "coherence": 0.5}

# Cleaning of a generation.
CLEAN_PREFIXES = ("Here's a joke:", "Here is a joke:", "Sure, here's a joke:", "Sure! Here's a joke:", "Joke:", "Answer:")
CLEAN_SEPARATORS = ("\n\n", "\n---", "---", "Joke 2:", "2.", "Here's another")
RATING_PATTERN = rf'"rating":{WS}*(\d{{1,2}})'
ASSISTANT_MARKERS = ("<|eot_id|>assistant\n", "<|eot_id|>assistant\n\n")

# Code points of the public Unicode property Emoji, without digits and keypad signs.
_EMOJI = """A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611
2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C
26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714
2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297
3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397
1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5
1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9
1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA88 1FA90-1FABD 1FABF-1FAC5 1FACE-1FADB 1FAE0-1FAE8
1FAF0-1FAF8"""
EMOJI_CLASS = "[" + "".join("-".join(rf"\x{{{cp}}}" for cp in part.split("-")) for part in _EMOJI.split()) + "]"


def _coarse(gap: int = 0x200) -> str:
    """A class of few ranges that holds all of the above: neighbours that are no more than gap apart are joined."""
    spans = [[int(cp, 16) for cp in (part.split("-") * 2)[:2]] for part in _EMOJI.split()]
    joined = [spans[0]]
    for low, high in spans[1:]:
        if low - joined[-1][1] <= gap:
            joined[-1][1] = high
        else:
            joined.append([low, high])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in joined) + "]"


EMOJI_COARSE = _coarse()  # tried first: a class of many ranges is slow on every character
