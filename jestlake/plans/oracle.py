"""The same queries as SQL text. Fixed values (phrases, patterns, thresholds) are shared; the logic is stated again."""

from __future__ import annotations

import random

from ..functions import lexicon as L


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = L.WS
LANG_CASE = "case lang when 'zh' then {zh} when 'es' then {es} else {en} end"


def case(make) -> str:
    return LANG_CASE.format(**{code: f"({make(code)})" for code in L.LANGUAGES})


def count_of(t: str, part: str) -> str:
    return f"((length({t}) - length(replace({t}, {q(part)}, ''))) // {len(part)})"


def any_of(t: str, parts) -> str:
    return "(" + " or ".join(f"contains({t}, {q(p)})" for p in parts) + ")"


def strip(t: str) -> str:
    return f"regexp_replace({t}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def lines(t: str) -> str:
    return f"len(string_split({strip(t)}, chr(10)))"


WORDS = f"len(list_filter(regexp_split_to_array(t, {q(WS + '+')}), lambda x: x <> ''))"
VISIBLE = f"length(regexp_replace(t, {q(WS)}, '', 'g'))"


def size(code: str) -> str:
    return VISIBLE if code == "zh" else WORDS


def valid(code: str) -> str:
    low = "t" if code == "zh" else "lower(t)"
    asked = f"{count_of('t', '?')} + {count_of('t', '¿')} > 2" if code == "es" else f"{count_of('t', '？' if code == 'zh' else '?')} > 1"
    return f"not ({asked} or {count_of(low, L.QUESTION_WORD[code])} > 1 or {any_of(low, L.DIALOGUE_MARKS[code])} or {lines('t')} > {L.MAX_LINES})"


def structure(code: str) -> str:
    low = "t" if code == "zh" else "lower(t)"
    punch = {
        "en": f"{count_of('t', '?')} = 1 and {any_of('t', '!.')}",
        "zh": f"contains(t, '？') and {any_of('t', '！。')}",
        "es": f"{any_of('t', '?¿')} and {any_of('t', '!¡.')}",
    }[code]
    tags = " ".join(f"when regexp_matches({low}, {q(p)}) then {q(tag)}" for tag, p in L.STRUCTURE_PATTERNS[code].items())
    return f"case {tags} when {punch} then 'qa-punchline' when {any_of(low, L.OBSERVATIONS[code])} then 'observation' else 'one-liner' end"


EMOJI = f"regexp_matches(t, {q(L.EMOJI_CLASS)})"
FORBIDDEN = f"(contains(t, '#') or contains(t, '@') or {EMOJI})"
FORMATTING = f"case when {FORBIDDEN} then -5.0 when ({case(lambda c: any_of('t', L.CHATTER[c]))}) or contains(t, '   ') then -1.0 when not ({case(valid)}) then -1.0 else 1.0 end"


def length_penalty(code: str) -> str:
    low, high, best = L.LENGTHS[code]
    return f"case when {size(code)} < {low} or {size(code)} > {high} then -2.0::double else -0.2::double * greatest(0, {size(code)} - {best}) + 0.0::double end"


CAPS = r"len(list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]*')))"


def coherence(code: str) -> str:
    hits = f"len(regexp_extract_all(t, {q(L.ZH_PUNCTUATION)}))" if code == "zh" else CAPS
    limit = L.PUNCTUATION_LIMIT if code == "zh" else L.CAPITALS_LIMIT
    return f"case when {size(code)} > 0 and {hits}::double / {size(code)} > {limit} then -0.5::double * ({hits}::double / {size(code)} - {limit}::double) else 0.0::double end"


def half_even(x: str) -> str:
    """x rounded to 3 places, halves to the even neighbour, exactly on decimals."""
    y = f"(({x})::decimal(18, 9) * 1000)"
    return f"((floor({y}) + case when {y} - floor({y}) > 0.5 then 1 when {y} - floor({y}) < 0.5 then 0 else abs(floor({y})::bigint) % 2 end) / 1000.0)::double"


def _pair(g: int) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(p, {q(p)}, {g}), '')" for p in L.PAIR_PATTERNS) + ")"


def _hit(g: int) -> str:
    return f"contains(lower(t), {strip(f'lower({_pair(g)})')})::int"


WORD_PAIR = f"case when {_pair(1)} is null then null when {_hit(1)} + {_hit(2)} = 2 then 2.0 when {_hit(1)} + {_hit(2)} = 1 then -1.0 else -2.0 end"


def headline(code: str) -> str:
    return f"case when {any_of('lower(p)', L.HEADLINE_SKIP[code])} then null when {size(code)} > {L.HEADLINE_MAX[code]} then -1.0 when {any_of('lower(t)', L.HEADLINE_BAD[code])} then -1.0 else 1.0 end"


C = "with c as (select s.submission_id as id, s.text as t, coalesce(r.prompt, '') as p, split_part(s.id, '_', 1) as lang, s.model from submissions s left join rl_df_test r on r.id = s.id where s.text is not null)"
EV = "(length(t) % 11)::double"
GATED = f"case when {case(valid)} then {EV} else 0.0 end"
SCORED = f"""{C}, sc as (select *, {case(valid)} as valid, {case(structure)} as structure, {FORMATTING} as formatting, {case(length_penalty)} as length, {case(coherence)} as coherence,
{WORD_PAIR} as word_pair, {case(headline)} as headline, {EV} as ev from c)"""
COMPOSITE = "(case when valid then ev else 0.0 end + 2.0 * coalesce(word_pair, 0) + 0.5 * formatting + 0.5 * length + 0.5 * coherence)::double"


def _fill(template: str, **columns: str) -> str:
    out = q(template)
    for name, sql in columns.items():
        out = out.replace("{" + name + "}", f"' || {sql} || '")
    return out


def _router(a: str, b: str, h: str) -> str:
    return f"case when {a} <> '-' and {b} <> '-' then {_fill(L.PAIR_PROMPTS['zh'], a=a, b=b)} when {h} <> '-' then {_fill(L.HEADLINE_PROMPTS['zh'], h=h)} end"


def _ngrams(n: int) -> str:
    toks = f"list_filter(regexp_split_to_array(lower(t), {q(WS + '+')}), lambda x: x <> '')"
    return f"""{C}, k as (select model, {toks} as w from c), g as (select model, unnest(list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i + {n - 1}], chr(1)))) as g from k where len(w) >= {n}),
dd as (select model, count(distinct g)::double / count(*) as d from g group by 1)"""


DISTINCT = {n: f"{_ngrams(n)} select m.model, round(coalesce(d, 0), 6) as distinct_{n} from (select distinct model from c) m left join dd on dd.model is not distinct from m.model" for n in (1, 2)}
ENTROPY = "sh as (select model, structure, count(*)::double / sum(count(*)) over (partition by model) as share from sc group by 1, 2), en as (select model, -sum(share * log2(share)) + 0.0 as e from sh group by 1)"


def _clean() -> str:
    steps = [f"select id, {strip('raw')} as x from raw"]
    for pre in L.CLEAN_PREFIXES:
        steps.append(f"select id, case when starts_with(lower(x), {q(pre.lower())}) then {strip(f'substring(x, {len(pre) + 1})')} else x end as x from {{prev}}")
    steps.append("""select id, case when starts_with(x, '"') and ends_with(x, '"') then case when length(x) < 2 then '' else substring(x, 2, length(x) - 2) end else x end as x from {prev}""")
    for s in L.CLEAN_SEPARATORS:
        lit = q(s).replace("\n", "' || chr(10) || '")
        steps.append(f"select id, case when contains(x, {lit}) then {strip(f'string_split(x, {lit})[1]')} else x end as x from {{prev}}")
    ctes = ", ".join(f"s{i} as ({s.replace('{prev}', f's{i - 1}')})" for i, s in enumerate(steps))
    return ctes, f"s{len(steps) - 1}"


def _diversity(batch: int) -> str:
    return f"""{C}, k as (select id, {case(structure)} as structure, row_number() over (order by id) - 1 as pos from c), r as (select *, pos // {batch} as b from k),
bs as (select distinct b from r), h as (select bs.b, r.structure, count(*) as h from bs join r on r.pos between bs.b * {batch} - 30 and bs.b * {batch} - 1 group by 1, 2), w as (select b, sum(h) as len, count(*) as kinds from h group by 1)
select r.id, r.structure, round(1.0::double / greatest(coalesce(w.kinds, 0), 1) - (coalesce(h.h, 0) + row_number() over (partition by r.b, r.structure order by r.pos) - 1)::double / (greatest(coalesce(w.len, 0), 1) + r.pos - r.b * {batch}), 6) as diversity
from r left join h on h.b = r.b and h.structure = r.structure left join w on w.b = r.b"""


def _split(stratify: bool) -> str:
    part = "held, labels" if stratify else "held"
    return f"""with a as (select joke_id, labels, row_number() over (partition by labels order by md5(joke_id::varchar || ':42')) <= floor(count(*) over (partition by labels) * 0.2::double + 0.5::double) as held from combined_jokes_full where labels is not null)
select joke_id, labels, case when not held then 'train' when row_number() over (partition by {part} order by md5(joke_id::varchar || ':43')) <= count(*) over (partition by {part}) // 2 then 'test' else 'val' end as split_name from a"""


LOGITS = "with l as (select vec_id, label, list_transform(embedding[1:11], lambda x: x::double) as z, list_transform(embedding[12:13], lambda x: x::double) as hd, list_transform(embedding[14:23], lambda x: x::double) as ch from embeddings)"


def _lse(z: str) -> str:
    return f"(list_max({z}) + ln(list_sum(list_transform({z}, lambda x: exp(x - list_max({z}))))))"


def _values(rows, columns: str) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(f'{x}::bigint' if isinstance(x, int) else q(x) for x in r) + ')' for r in rows)}) as v({columns})"


def _drawn_pairs() -> str:
    rng = random.Random(42)
    rows = []
    for i in range(500):
        verb = rng.choice(["sing", "jump", "paint"])
        rows.append((i, verb, rng.choice(["cat", "moon", "ladder", "moon"])))
    return _values(rows, "pos, verb, noun")


def _drawn_prompts() -> str:
    rng = random.Random(42)
    prompts = []
    for _ in range(200):
        verb = rng.choice(["sing", "jump"])
        prompts.append(L.PAIR_PROMPTS["en"].replace("{a}", verb).replace("{b}", rng.choice(["cat", "moon"])))
    prompts += [L.HEADLINE_PROMPTS["en"].replace("{h}", h) for h in ("Rain expected", "Cat elected mayor")]
    rng.shuffle(prompts)
    return _values(list(enumerate(prompts)), "pos, prompt")


def _hashed(key: str, place: int, words: list[str]) -> str:
    """A word by the first 32 bits of md5(key:42:place), summed up digit by digit."""
    digest = f"md5({key}::varchar || ':42:{place}')"
    number = " + ".join(f"(strpos('0123456789abcdef', substr({digest}, {i}, 1)) - 1) * {16 ** (8 - i)}" for i in range(1, 9))
    return f"[{', '.join(map(q, words))}][(({number}) % {len(words)} + 1)::int]"


HASHED_PAIRS = f"select p_partkey, {_hashed('p_partkey', 1, ['sing', 'jump'])} as verb, {_hashed('p_partkey', 2, ['cat', 'moon', 'ladder'])} as noun from part"
RATED = "select joke, labels from combined_jokes_full where joke <> '' and labels is not null and lang in ({})"


def _stream_diversity(batch: int) -> str:
    """Each model is a run of its own: its rows in order, cut into calls."""
    return f"""{C}, g as (select id, model as run, {case(structure)} as structure, row_number() over (order by id) - 1 as pos from c), k as (select run, structure, pos, row_number() over (partition by run order by pos) - 1 as i from g), r as (select *, i // {batch} as b from k),
bs as (select distinct run, b from r), h as (select bs.run, bs.b, r.structure, count(*) as h from bs join r on r.run = bs.run and r.i between bs.b * {batch} - 30 and bs.b * {batch} - 1 group by 1, 2, 3), w as (select run, b, sum(h) as len, count(*) as kinds from h group by 1, 2)
select r.run, r.pos, r.structure, round(1.0::double / greatest(coalesce(w.kinds, 0), 1) - (coalesce(h.h, 0) + row_number() over (partition by r.run, r.b, r.structure order by r.i) - 1)::double / (greatest(coalesce(w.len, 0), 1) + r.i - r.b * {batch}), 6) as diversity
from r left join h on h.run = r.run and h.b = r.b and h.structure = r.structure left join w on w.run = r.run and w.b = r.b"""


def _load_split() -> str:
    rated = RATED.format("'en', 'zh', 'es'")
    key = "joke || '|' || labels::varchar"
    return f"""with f as ({rated}), a as (select joke, labels, row_number() over (partition by labels order by md5({key} || ':42')) <= floor(count(*) over (partition by labels) * 0.2::double + 0.5::double) as held from f)
select joke, labels, case when not held then 'train' when row_number() over (partition by held order by md5({key} || ':43')) <= count(*) over (partition by held) // 2 then 'test' else 'val' end as split_name from a"""


def oracle_sql() -> dict[str, str]:
    struct_cols = ", ".join(f"round(max(case when structure = {q(s)} then share end), 6) as structure_{s.replace('-', '_')}" for s in L.STRUCTURES)
    shares = f"{C}, tg as (select model, {case(structure)} as structure from c), sh as (select model, structure, count(*)::double / sum(count(*)) over (partition by model) as share from tg group by 1, 2)"
    m1, m2 = (q(m).replace("\n", "' || chr(10) || '") for m in L.ASSISTANT_MARKERS)
    ctes, last = _clean()
    toks = lambda n: f"select model, unnest(list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i + {n - 1}], chr(1)))) as g from tk where len(w) >= {n}"
    pooled = f"tk as (select model, list_filter(regexp_split_to_array(lower(t), {q(WS + '+')}), lambda x: x <> '') as w from c), d1 as (select model, count(distinct g)::double / count(*) as d from ({toks(1)}) group by 1), d2 as (select model, count(distinct g)::double / count(*) as d from ({toks(2)}) group by 1)"
    ablation = f"""{SCORED}, {ENTROPY}, {pooled}, ab as (select model, count(distinct p) as n_prompts, count(*) as n_jokes, avg(ev) as ev_mean, stddev_samp(ev) as ev_std, avg(valid::int) as validity_rate from sc group by 1),
f as (select ab.*, coalesce(d2.d, 0) as distinct_2, en.e as structure_entropy from ab left join d2 using (model) left join en using (model))"""
    comparison = f"""{SCORED}, cm as (select lang as language, model, avg(ev) as mean_ev_reward, coalesce(avg(case when valid then ev end), 0.0) as mean_ev_reward_valid_only, avg({COMPOSITE}) as mean_composite_reward, stddev_pop({COMPOSITE}) as std_composite_reward, avg(valid::int) as validity_rate, count(*) as num_samples from sc group by 1, 2)"""
    r3 = lambda x: half_even(f"coalesce({x}, 0.0)")
    v0 = f"not ({count_of('t', '?')} > 1 or {count_of('lower(t)', 'why ')} > 1 or {lines('t')} > 3)"
    own = f"list_filter(regexp_split_to_array(lower(t), {q(WS + '+')}), lambda x: x <> '')"
    e1, e2 = (f"lower(nullif(regexp_extract(p, {q(L.EARLY_PAIR_PATTERN)}, {g}), ''))" for g in (1, 2))
    hit0 = lambda e: f"(len(list_filter({own}, lambda x: contains(x, {e}))) > 0)::int"
    pat = L.STRUCTURE_PATTERNS["en"]
    early_structure = f"""case when regexp_matches(lower(t), {q(pat['why-did'])}) then 'why-did' when regexp_matches(lower(t), {q(L.EARLY_WHERE_PATTERN)}) then 'where-did' when regexp_matches(lower(t), {q(pat['what-do-you-call'])}) then 'what-do-you-call'
when regexp_matches(lower(t), {q(pat['knock-knock'])}) then 'knock-knock' when {count_of('t', '?')} = 1 and {any_of('t', '!.')} then 'qa-punchline' when {any_of('lower(t)', L.OBSERVATIONS['en'])} then 'observation' else 'one-liner' end"""
    h = f"list_concat([hd[1] - {_lse('hd')}], list_transform(ch, lambda x: x - {_lse('ch')} + hd[2] - {_lse('hd')}))"
    return {
        "validity_rows": f"{C} select id, {case(valid)} as valid from c",
        "validity_by_lang": f"{C} select lang, count(*) as n, round(avg(({case(valid)})::int), 6) as validity from c group by 1",
        "structure_rows": f"{C} select id, {case(structure)} as structure from c",
        "structure_dist": f"{C}, tg as (select lang, {case(structure)} as structure from c) select lang, structure, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by lang), 6) as share from tg group by 1, 2",
        "structure_pivot": f"{shares} select model, {struct_cols} from sh group by 1",
        "structure_entropy": f"{shares} select model, round(-sum(share * log2(share)) + 0.0, 6) as structure_entropy from sh group by 1",
        "text_sizes": f"{C} select id, {WORDS} as words, {VISIBLE} as visible from c",
        "forbidden_symbols": f"{C} select id, {EMOJI} as emoji, {FORBIDDEN} as forbidden from c",
        "formatting_score": f"{C} select id, ({FORMATTING})::double as formatting from c",
        "length_penalty": f"{C} select id, round({case(length_penalty)}, 6) as length from c",
        "coherence_score": f"{C} select id, round({case(coherence)}, 6) + 0.0 as coherence from c",
        "word_pair_adherence": f"{C} select id, ({WORD_PAIR})::double as word_pair from c",
        "headline_adherence": f"{C} select id, ({case(headline)})::double as headline from c",
        "early_variants": f"""{C} select id, {v0} as valid, {early_structure} as structure,
(case when not contains(p, 'two words') or {e1} is null then null when {hit0(e1)} + {hit0(e2)} = 2 then 2.0 when {hit0(e1)} + {hit0(e2)} = 1 then -1.0 else -2.0 end)::double as word_pair,
(case when contains(p, 'two words') then null when {WORDS} <= 25 and not contains(t, 'headline') then 1.0 else -1.0 end)::double as headline,
(case when contains(t, '#') or {any_of('t', L.EARLY_CHATTER)} or contains(t, '   ') or {EMOJI} or not ({v0}) then -1.0 else 1.0 end)::double as formatting,
(case when {v0} then right((length(t) % 11)::varchar, 1)::double else 0.0 end) as rater from c""",
        "gated_rater": f"{C} select id, ({GATED})::double as rater from c",
        "pair_prompts": "select p_partkey, " + ", ".join(f"{_fill(L.PAIR_PROMPTS[c], a=chr(115) + 'plit_part(p_name, chr(32), 1)', b='split_part(p_name, chr(32), 2)')} as prompt_{c}" for c in L.LANGUAGES) + " from part",
        "headline_prompts": "select task_no, " + ", ".join(f"{_fill(L.HEADLINE_PROMPTS[c], h='headline')} as prompt_{c}" for c in L.LANGUAGES) + " from task_a_zh",
        "task_router_training": f"select task_no, x as prompt from (select task_no, {_router('coalesce(word1, chr(110) || chr(97) || chr(110))', 'coalesce(word2, chr(110) || chr(97) || chr(110))', 'coalesce(headline, chr(110) || chr(97) || chr(110))')} as x from task_a_zh) where x is not null",
        "task_router_submission": f"select task_no, coalesce({_router('coalesce(word1, chr(45))', 'coalesce(word2, chr(45))', 'coalesce(headline, chr(45))')}, {q(L.FALLBACK_PROMPT)}) as prompt from task_a_zh",
        "task_router_early": f"with t as (select coalesce(word1, 'nan') as a, coalesce(word2, 'nan') as b, coalesce(headline, 'nan') as h from task_a_zh) select 0 as kind, {_fill(L.EARLY_PAIR_PROMPT, a='a', b='b')} as prompt from t where not (a = '-' and b = '-') union all select 1, {_fill(L.EARLY_HEADLINE_PROMPT, h='h')} from t where h <> '-'",
        "rating_prompts": "select joke_id, 'user' as role, 'Rate this joke from 0 to 10:' || chr(10) || joke || chr(10) || 'Answer in JSON.' as content from combined_jokes_full",
        "few_shot_prompts": "select p_partkey, 'A joke with `' || split_part(p_name, ' ', 1) || '` and `' || split_part(p_name, ' ', 2) || '`, please.' as prompt from part",
        "clean_generation": f"""{C}, raw as (select id, ['Joke: ', ' Sure! Here''s a joke: Joke: ', '"', '', 'Answer:'][(id % 5 + 1)::int] || t || ['"', chr(10) || chr(10) || 'Joke 2: x', '', ' --- more'][(id % 4 + 1)::int] as raw from c), {ctes} select id, x as clean from {last}""",
        "rating_extract": """select event_id, coalesce(least(10.0::double, greatest(0.0::double, nullif(regexp_extract('Here: ' || replace(props, '"k"', '"rating"'), '"rating":\\s*(\\d{1,2})', 1), '')::double)), 0.0::double) as rating from events""",
        "rating_reason": "select event_id, case when event_id % 2 = 0 or event_id % 3 = 0 then user_id else 0 end as rating, case when event_id % 2 = 0 or event_id % 3 = 0 then 'because ' || event_type else '' end as reason from events",
        "assistant_suffix": f"""{C}, k as (select id, t, p, 'question' || {m1} || t || {m1} || '  ' || t || chr(10) as a, case when id % 3 = 0 then t else 'q' || {m2} || t || {m2} || 'rest' end as b from c)
select id, {strip(f'string_split(a, {m1})[-1]')} as last, string_split(b, {m2})[2] as between, {strip("substring(p || ' ' || t, length(p) + 1)")} as answer from k""",
        "display_text": f"{C} select id, case when length(t) > 100 then left(t, 100) || '...' else t end as short, replace(t, '“', '') as caption, model as name, '/a:b/' || id as path from c",
        "title_and_body": f"""{C}, k as (select p || ' ' || t as t, id % 50 - 5 as s from c), f as (select t, s from k where {WORDS} between 5 and 24 and s > 0) select t as joke, round(s::double / (select max(s) from f) * 1000, 6) as score from f""",
        "max_normalise": "select event_id, round(value / (select max(value) from events) * 1000, 6) as score from events",
        "average_label": "select eval_id, case when floor((llama_score + gpt_score) / 2.0)::int = -1 then 0 else floor((llama_score + gpt_score) / 2.0)::int end as label from data_llm_eval",
        "distinct_1": DISTINCT[1],
        "distinct_2": DISTINCT[2],
        "composite_reward": f"{SCORED} select id, round({COMPOSITE}, 6) as composite from sc",
        "training_reward": f"""{SCORED}, k as (select id, {r3('case when valid then ev else 0.0 end')} as a, {r3('(id % 7) / 8.0')} as dv, {r3('word_pair')} as w, {r3('formatting')} as f, {r3('length')} as l, {r3('headline')} as h, {r3('coherence')} as co from sc)
select id, {half_even('a + 1.5 * dv + 2.0 * w + 0.5 * f + 0.5 * l + 2.0 * h + 0.5 * co')} as reward, {half_even('a + 2.0 * w + 0.5 * f + 0.5 * l + 0.5 * co')} as reward_ablated from k""",
        "detail_rows": f"""{SCORED} select model, id as generation_idx, p as prompt, t as joke, ev as rater_score, word_pair::double as word_pair_score, formatting::double as formatting_score, round(length, 6) + 0.0 as length_score, round(coherence, 6) + 0.0 as coherence_score, valid as is_valid, ({WORDS})::int as word_count, structure from sc""",
        "model_summary": f"""{SCORED}, {ENTROPY.split(', en as')[0]}, pv as (select model, {struct_cols} from sh group by 1), {pooled}
select b.*, round(coalesce(d1.d, 0), 6) as distinct_1, round(coalesce(d2.d, 0), 6) as distinct_2, pv.* exclude (model) from (select model, count(distinct p) as n_prompts, count(*) as n_jokes, round(avg(ev), 6) as rater_mean, round(stddev_samp(ev), 6) as rater_std, round(median(ev), 6) as rater_median, round(avg(valid::int), 6) as validity_rate,
round(avg(word_pair), 6) as word_pair_mean, round(avg(formatting), 6) as formatting_mean, round(avg(length), 6) as length_mean, round(avg(coherence), 6) as coherence_mean, round(avg({WORDS}), 6) as avg_word_count, count(distinct structure) as n_unique_structures from sc group by 1) b left join d1 using (model) left join d2 using (model) left join pv using (model)""",
        "prompt_rows": f"{C} select model, id as generation_idx, t as joke, format('{{:.2f}}', {EV}) as score from c where model = 'quip_base' and p = (select prompt from rl_df_test where prompt_idx = 7)",
        "head_prompts": "select prompt_idx, prompt from rl_df_test order by prompt_idx limit 8",
        "comparison_summary": f"{comparison} select language, model, round(mean_ev_reward, 6) as mean_ev_reward, round(mean_ev_reward_valid_only, 6) as mean_ev_reward_valid_only, round(mean_composite_reward, 6) as mean_composite_reward, round(std_composite_reward, 6) as std_composite_reward, round(validity_rate, 6) as validity_rate, num_samples from cm",
        "base_vs_trained": f"{comparison} select b.language, round(b.mean_ev_reward - a.mean_ev_reward, 6) as delta_mean_ev_reward, round(b.mean_composite_reward - a.mean_composite_reward, 6) as delta_mean_composite_reward, round(b.validity_rate - a.validity_rate, 6) as delta_validity_rate from cm a join cm b using (language) where a.model = 'quip_base' and b.model = 'quip_tuned'",
        "ablation_summary": f"{ablation} select model, n_prompts, n_jokes, round(ev_mean, 6) as ev_mean, round(ev_std, 6) as ev_std, round(validity_rate, 6) as validity_rate, round(distinct_2, 6) as distinct_2, round(structure_entropy, 6) as structure_entropy from f",
        "delta_to_full": f"{ablation} select x.model, round(x.ev_mean - y.ev_mean, 6) + 0.0 as delta_ev_mean, round(x.distinct_2 - y.distinct_2, 6) + 0.0 as delta_distinct_2, round(x.structure_entropy - y.structure_entropy, 6) + 0.0 as delta_structure_entropy, round(x.validity_rate - y.validity_rate, 6) + 0.0 as delta_validity_rate from f x, f y where y.model = 'quip_base' and x.model <> 'quip_base'",
        "gated_label_summary": f"{C}, k as (select lang, model, ({GATED})::double as s from c) select lang, model, round(avg(s), 6) as mean_reward, round(median(s), 6) as median_reward, round(stddev_samp(s), 6) as std_reward, count(*) as num_samples from k group by 1, 2",
        "softmax_ev": f"{LOGITS} select vec_id, round(list_sum(list_transform(z, lambda x, i: exp(x - {_lse('z')}) * (i - 1))), 6) as ev, (list_position(z, list_max(z)) - 1)::int as top, round(exp(z[1] - {_lse('z')}), 6) as p0, round(z[11] - {_lse('z')}, 6) as lp10 from l",
        "hierarchical_logits": f"{LOGITS}, k as (select vec_id, {h} as h from l) select vec_id, round(h[1], 6) as c0, round(h[2], 6) as c1, round(h[11], 6) as c10, (list_position(h, list_max(h)) - 1)::int as top from k",
        "eval_metrics": f"{LOGITS}, k as (select label, list_position(z, list_max(z)) - 1 - label as o from l) select round(sqrt(avg(o * o)), 6) as rmse, round(avg(abs(o)), 6) as mae, round(avg((o = 0)::int), 6) as accuracy, round(avg(o * o), 6) as mse from k",
        "cross_entropy": f"{LOGITS} select round(sum(case when label = 0 then 2.0::double else 1.0::double end * ({_lse('z')} - z[label + 1])) / sum(case when label = 0 then 2.0::double else 1.0::double end), 6) as cross_entropy from l",
        "class_weights": """with b as (select k::int as class, (select count(*) from embeddings where (label <> 0)::int = k) as n from range(2) r(k)), ch as (select k::int as class, greatest((select count(*) from embeddings where label = k), 1) as n from range(1, 11) r(k))
select 'binary' as head, class, n as count, case when n > 0 then round((select sum(n) from b)::double / (2 * n), 6) end as weight from b union all select 'child', class, n, round((select sum(n) from ch)::double / (10 * n), 6) from ch""",
        "missing_labels": "select k::int as label from range(11) r(k) where k not in (select label from embeddings)",
        "present_labels": "select string_agg(labels::varchar, ',' order by labels) as labels from (select distinct labels from combined_jokes_full where labels is not null)",
        "label_counts": "select source, count(*) as n, count(labels) as labelled, count(*) filter (labels > 5) as good from combined_jokes_full group by 1",
        "value_histogram": "select floor((value - (select min(value) from events)) / 5.0)::bigint as bin, count(*) as n from events where value is not null group by 1",
        "seen_order": "select model, min(submission_id) as first_pos from submissions group by 1",
        "three_way_split": _split(False),
        "three_way_split_stratified": _split(True),
        "union_label10": "select joke, labels from combined_jokes_full where joke is not null and labels is not null union all select headline, 10 from task_a_zh where headline is not null",
        "limit_then_filter": "select prompt_idx, prompt from (select prompt_idx, prompt from rl_df_test order by prompt_idx limit 150) where coalesce(prompt, '') <> ''",
        "tiled_literals": "select k as pos, ['rain', 'sun', 'snow', 'fog', 'wind'][(k % 5 + 1)::int] as value from range(123) r(k)",
        "random_pairs": _drawn_pairs(),
        "training_prompts": _drawn_prompts(),
        "hashed_pairs": HASHED_PAIRS,
        "stream_diversity": _stream_diversity(8),
        "source_task_tsv": "select id, nullif(word1, '') as word1, nullif(word2, '') as word2, nullif(headline, '') as headline from task_a_zh",
        **{f"source_rated_{code}": RATED.format(q(code)) for code in L.LANGUAGES},
        "source_rated_all": RATED.format("'en', 'zh', 'es'"),
        "source_prompts": "select row_number() over (order by prompt_idx) - 1 as prompt_idx, prompt from rl_df_test",
        "source_text_lines": "select headline as joke, 10 as labels from task_a_zh where headline is not null and not contains(headline, chr(10)) and not contains(headline, chr(13))",
        "source_json_array": "select id as title, prompt as body, prompt_idx as score from rl_df_test",
        "source_text_column": "select nullif(text, '') as text from submissions",
        "source_text_union": "select nullif(text, '') as text from submissions union all select joke from combined_jokes_full",
        "source_complete_rows": "select id, model, text from submissions where id <> '' and model <> '' and text <> ''",
        "source_without_index": "select prompt from rl_df_test",
        "source_base_model": "select 'lab/small-model' as base_model",
        "sink_prompts": "select prompt from rl_df_test",
        "sink_csv": "select submission_id, nullif(text, '') as text, nullif(model, '') as model from submissions",
        "sink_submissions": "select id, left(text, 100) as text from (select id, max(text) as text from submissions where text is not null group by 1) order by id limit 3",
        "sink_markdown": """with s as (select source, count(*) as n, count(labels) as labelled, count(*) filter (labels > 5) as good from combined_jokes_full group by 1)
select -2::bigint as pos, '| source | n | labelled | good |' as line union all select -1, '| --- | --- | --- | --- |' union all
select row_number() over (order by source nulls first) - 1, '| ' || replace(coalesce(source, ''), '|', '\\|') || ' | ' || n || ' | ' || labelled || ' | ' || good || ' |' from s""",
        "sink_sample_table": f"{SCORED} select id, p as prompt, t as generation, coalesce(word_pair, 0)::double as word_pair, formatting::double as formatting, coalesce(headline, 0)::double as headline, (coalesce(word_pair, 0) + formatting + coalesce(headline, 0))::double as total from sc order by id limit 20",
        "load_split": _load_split(),
        "prepare_data": f"""with h as ({HASHED_PAIRS}) select 'train' as split_name, {_fill(L.PAIR_PROMPTS['zh'], a='verb', b='noun')} as prompt from h union all select 'train', {_fill(L.HEADLINE_PROMPTS['zh'], h='headline')} from task_a_zh where headline is not null
union all select 'test', x from (select {_router("coalesce(nullif(word1, ''), 'nan')", "coalesce(nullif(word2, ''), 'nan')", "coalesce(nullif(headline, ''), 'nan')")} as x from task_a_zh) where x is not null""",
        "shuffled": "select submission_id, id, row_number() over (order by md5(submission_id::varchar || ':42')) - 1 as pos from submissions",
        "sample_matching": "select joke_id, joke, labels from combined_jokes_full where labels = 8 order by md5(joke_id::varchar || ':42') limit 5",
        "training_loss": f"""{LOGITS}, k as (select label as y, list_transform(hd, lambda x: x - {_lse('hd')}) as hl, list_transform(ch, lambda x: x - {_lse('ch')}) as cl, {h} as z from l where label is not null),
w as (select y, case when y <> 0 then 0.5::double else 1.0::double end as hw, hl[case when y <> 0 then 2 else 1 end] as hp, case when y <> 0 then ((y - 1) % 3 + 1)::double end as cw, case when y <> 0 then cl[y] end as cp, list_sum(list_transform(z, lambda x, i: exp(x) * (i - 1))) as e from k),
s as (select -sum(hw * hp) / sum(hw) as a, coalesce(-sum(cw * cp) / sum(cw), 0.0) as b, avg((e - y) * (e - y)) as c from w) select round(a + b + 0.1::double * c, 6) as loss, round(a, 6) as head_loss, round(b, 6) as child_loss, round(c, 6) as squared_error from s""",
        "parameter_ratio": "select sum(p_size) filter (p_partkey % 3 = 0)::bigint as trained, sum(p_size)::bigint as total, round(sum(p_size) filter (p_partkey % 3 = 0)::double / sum(p_size), 6) as ratio from part",
        "structure_diversity": _diversity(8),
        "structure_diversity_wide": _diversity(40),
        "submission_table": f"""with raw as (select id, max(text) as raw from submissions where text is not null group by 1), {ctes} select t.id, coalesce(s.x, '') as text from task_a_zh t left join {last} s on s.id = t.id""",
        "flatten_generations": f"{C}, k as (select p, t, row_number() over (partition by p order by t) - 1 as generation_idx from c) select p, generation_idx::int as generation_idx, t as joke from k",
    }
