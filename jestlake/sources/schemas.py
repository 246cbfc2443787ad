"""Declared schemas, as DDL, of the tables the engine reads and writes."""

from __future__ import annotations

TASK = "id string, word1 string, word2 string, headline string"
PROMPTS = "prompt_idx bigint, prompt string"
RATED = "joke string, labels int"
TITLED = "title string, body string, score bigint"
LLM_LABELLED = "joke string, model_raw_output string, score double"
DOUBLE_LABELLED = "joke string, llama_score int, gpt_score int"
GENERATIONS = "model string, prompt_idx bigint, prompt string, jokes array<string>, logits array<array<double>>"
DETAIL = (
    "model string, prompt_idx bigint, generation_idx int, prompt string, joke string, rater_score double, word_pair_score double, formatting_score double, "
    "length_score double, coherence_score double, is_valid boolean, word_count int, structure string"
)
SUBMISSION = "id string, text string"
PREDICTIONS = "label int, logits array<double>"
