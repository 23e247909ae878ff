"""All source adapters over raw rows made from the documents, with SQL that says the same independently.

A raw row is written once as portable SQL expressions, which Spark and DuckDB both evaluate; what the adapters make of it is
then written twice: as declarations in ``optika.sources.adapters`` and as plain SQL here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optika.functions import text as T
from optika.plans.items import table
from optika.plans.registry import query
from optika.sources import adapters

#: Rows that every adapter is given: whole documents, with a number and a word to make labels of.
BASE = "SELECT doc_id, doc_id AS n, coalesce(text, '') AS t, lang, source, CASE WHEN doc_id % 3 = 0 THEN 'train' WHEN doc_id % 3 = 1 THEN 'test' ELSE 'dev' END AS split, doc_id AS row FROM documents"
_S = "CAST({} AS VARCHAR(99))"


def _text(x: str) -> str:
    return _S.format(x)


_WORD = "CASE n % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{}' WHEN 2 THEN '{}' ELSE '{}' END"
#: adapter: raw columns; context, gold position, number of choices, choices, stratum, key, condition.
ITEMS: dict[str, tuple[dict[str, str], str, str, list[str], str, str, str]] = {
    "sst5": ({"text": "t", "label": _text("n % 7")}, "trim_(text)", "CAST(label AS INT)", adapters.ADAPTERS["sst5"].choices, "'sentiment=' || gold", "split || ':' || row", "true"),
    "tweet_eval_sentiment": ({"text": "t", "label": "n % 3"}, "trim_(text)", "label", ["Negative", "Neutral", "Positive"], "'sentiment=' || gold", "split || ':' || row", "true"),
    "semeval2018_ei_oc": (
        {"Tweet": "t", "ID": "n", "`Intensity Class`": "CASE WHEN n % 9 = 0 THEN 'x' ELSE " + _text("n % 4") + " || ': some' END", "`Affect Dimension`": "CASE WHEN n % 2 = 0 THEN ' Anger' ELSE 'joy ' END"},
        "trim_(Tweet)", "try_cast(split_part(\"Intensity Class\", ':', 1) AS INT)", adapters.ADAPTERS["semeval2018_ei_oc"].choices, "'emotion=' || lower(trim(\"Affect Dimension\")) || '|intensity=' || gold",
        "split || ':' || lower(trim(\"Affect Dimension\")) || ':' || ID", "true",
    ),
    "meld_sentiment": (
        {"Utterance": "t", "Sentiment": _WORD.format("neutral", " Negative", "POSITIVE", "none"), "Dialogue_ID": "n % 10", "Utterance_ID": "n"},
        "trim_(Utterance)", "list_position(['negative', 'neutral', 'positive'], lower(trim(Sentiment))) - 1", ["Negative", "Neutral", "Positive"], "'sentiment=' || gold", "split || ':dialogue' || Dialogue_ID || ':utterance' || Utterance_ID", "true",
    ),
    "amazon_reviews_2023_all_beauty": (
        {"title": "lang", "text": "t", "rating": _text("n % 6") + " || '.0'", "parent_asin": "source", "user_id": "CASE WHEN n % 2 = 0 THEN 'u' END"},
        "trim_('Review title: ' || coalesce(title, '') || nl || nl || 'Review text: ' || text)", "CAST(CAST(rating AS DOUBLE) AS INT) - 1", adapters.STARS, "'stars=' || (gold + 1)", "'all_beauty:' || row || ':' || coalesce(parent_asin, '') || ':' || coalesce(user_id, '')", "true",
    ),
    "app_reviews": ({"review": "t", "star": "n % 6"}, "trim_(review)", "star - 1", adapters.STARS, "'stars=' || (gold + 1)", "'row:' || row", "true"),
    "uci_drugs_com": (
        {"drugName": "lang", "condition": "source", "review": "t", "rating": _text("n % 11") + " || '.0'", "`Unnamed: 0`": "CASE WHEN n % 2 = 0 THEN " + _text("n + 5") + " ELSE '' END"},
        "trim_('Drug: ' || coalesce(drugName, '') || nl || 'Condition: ' || coalesce(condition, '') || nl || nl || 'Review: ' || review)", "CAST(CAST(rating AS DOUBLE) AS INT) - 1", [f"Rating {i}" for i in range(1, 11)],
        "'rating=' || (gold + 1)", "split || ':' || CASE WHEN \"Unnamed: 0\" = '' THEN split || ':' || row ELSE \"Unnamed: 0\" END", "true",
    ),
    "asap2": ({"assignment": "lang", "full_text": "t", "score": "n % 8", "essay_id": "'e' || " + _text("n")}, "trim_('Writing assignment:' || nl || coalesce(assignment, '') || nl || nl || 'Student essay:' || nl || full_text)", "score - 1", [f"Score {i}" for i in range(1, 7)], "'score=' || (gold + 1)", "essay_id", "true"),
    "persuade2_argument_effectiveness": (
        {"assignment": "lang", "full_text": "t", "discourse_type": "source", "discourse_text": "t", "discourse_effectiveness": _WORD.format("Adequate", "Ineffective ", "Effective", "effective"), "essay_id_comp": "n", "discourse_start": "n % 7", "discourse_end": "n % 11"},
        "trim_('Writing assignment:' || nl || coalesce(assignment, '') || nl || nl || 'Full essay:' || nl || full_text || nl || nl || 'Target component type: ' || coalesce(discourse_type, '') || nl || 'Target argument component:' || nl || discourse_text)",
        "list_position(['Ineffective', 'Adequate', 'Effective'], trim(discourse_effectiveness)) - 1", ["Ineffective", "Adequate", "Effective"], "'effectiveness=' || gold", "'essay:' || essay_id_comp || '|start:' || discourse_start || '|end:' || discourse_end || '|row:' || row", "true",
    ),
    "helpsteer": ({"prompt": "lang", "response": "t", "helpfulness": "n % 5"}, "trim_('User prompt:' || nl || coalesce(prompt, '') || nl || nl || 'Assistant response:' || nl || response)", "helpfulness", [f"Helpfulness {i}" for i in range(5)], "'helpfulness=' || gold", "split || ':' || row", "true"),
    "imdb_ratings": ({"text": "t", "polarity": "CASE WHEN n % 2 = 0 THEN 'pos' ELSE 'neg' END", "number": "n", "rating": _text("n % 11")}, "clean_(text)", "list_position(['1', '2', '3', '4', '7', '8', '9', '10'], rating) - 1", adapters.ADAPTERS["imdb_ratings"].choices, "'rating=' || rating", "split || ':' || polarity || ':' || number", "true"),
    "goodreads_reviews": ({"review_text": "t", "rating": "n % 7", "review_id": "CASE WHEN n % 3 = 0 THEN '' WHEN n % 3 = 1 THEN 'r' || " + _text("n") + " END"}, "clean_(review_text)", "rating - 1", adapters.STARS, "'rating=' || (gold + 1)", "CASE WHEN coalesce(review_id, '') = '' THEN row::VARCHAR ELSE review_id END", "rating BETWEEN 1 AND 5"),
    "tripadvisor_hotel_reviews": (
        {"id": "CASE WHEN n % 2 = 0 THEN 'h' || " + _text("n") + " END", "review": "CASE WHEN n % 2 = 0 THEN t END", "text": "t", "label": "CASE WHEN n % 3 = 0 THEN " + _text("n % 12") + " || '.0' END", "rating": "CASE WHEN n % 5 = 1 THEN '2.5' END", "overall": "CASE WHEN n % 5 = 2 THEN '3.5' END", "prediction": "array_(struct_label(" + _text("n % 6") + "))"},
        "clean_(coalesce(review, text))", "round_even(CAST(coalesce(label, rating, overall, prediction[1].label) AS DOUBLE), 0)::INT - 1", adapters.STARS, "'rating=' || (gold + 1)", "coalesce(id, row::VARCHAR)", "true",
    ),
    "labr_arabic_book_reviews": ({"text": "t", "label": "CASE WHEN n % 3 = 0 THEN n % 5 ELSE n % 5 + 1 END"}, "clean_(text)", "CASE WHEN split = 'train' THEN label ELSE label - 1 END", adapters.STARS, "'rating=' || (gold + 1)", "split || ':' || row", "true"),
    "beeradvocate_reviews": ({"fields": "map_beer(" + _text("n % 11 / 2.0") + ", t)"}, "clean_(fields['review/text'])", "CASE WHEN CAST(fields['review/overall'] AS DOUBLE) <= 2.5 THEN 0 WHEN CAST(fields['review/overall'] AS DOUBLE) <= 3.5 THEN 1 ELSE 2 END", adapters.ADAPTERS["beeradvocate_reviews"].choices, "'rating_band=' || gold", "row::VARCHAR", "true"),
    "cmu_mosei_sentiment": ({"text": "t", "sentiment": "CASE WHEN n % 13 = 0 THEN 'bad' ELSE " + _text("n % 7 - 3") + " || '.5' END"}, "clean_(text)", "len([c FOR c IN [-1.5, -0.5, 0.5, 1.5] IF c <= try_cast(sentiment AS DOUBLE)])", adapters.ADAPTERS["cmu_mosei_sentiment"].choices, "'sentiment_band=' || gold", "split || ':' || row", "try_cast(sentiment AS DOUBLE) IS NOT NULL"),
    "ibm_argument_quality": ({"topic": "lang", "argument": "t", "WA": "CASE WHEN n % 17 = 0 THEN 'x' ELSE '0.' || " + _text("n * 7919 % 997 + 100") + " END"}, "clean_('Topic: ' || coalesce(topic, '') || nl || 'Argument: ' || argument)", "quintile", adapters.QUINTILES, "'quality_quintile=' || (gold + 1)", "split || ':' || row", "try_cast(WA AS DOUBLE) IS NOT NULL"),
    "helpsteer2_correctness": ({"prompt": "lang", "response": "t", "correctness": "n % 5"}, "clean_('User prompt:' || nl || coalesce(prompt, '') || nl || nl || 'Assistant response:' || nl || response)", "correctness", adapters.CORRECTNESS, "'correctness=' || gold", "split || ':' || row", "true"),
    "ultrafeedback_quality": ({"instruction": "lang", "response": "t", "overall_score": "CASE WHEN n % 19 > 0 THEN n % 23 / 2.0 END", "shard": "n % 4"}, "clean_('User instruction:' || nl || coalesce(instruction, '') || nl || nl || 'Assistant response:' || nl || response)", "greatest(0, least(4, ceil(overall_score / 2)::INT - 1))", adapters.ADAPTERS["ultrafeedback_quality"].choices, "'quality_band=' || gold", "'shard' || shard || ':' || row", "overall_score IS NOT NULL"),
    "dynasent": ({"sentence": "t", "gold_label": _WORD.format("neutral", "negative", "positive", "mixed"), "text_id": "CASE WHEN n % 2 = 0 THEN 'i' || " + _text("n") + " END", "member": "'m'"}, "clean_(sentence)", "list_position(['negative', 'neutral', 'positive'], gold_label) - 1", ["Negative", "Neutral", "Positive"], "'sentiment=' || gold_label", "coalesce(text_id, 'm:' || row)", "true"),
}
TRAINING: dict[str, tuple[dict[str, str], str, str, list[str], str, str, str]] = {
    "train_ibm_argument_quality": ({**ITEMS["ibm_argument_quality"][0]}, "trim_('Topic: ' || coalesce(topic, '') || nl || 'Argument: ' || argument)", "quintile", adapters.QUINTILES, "''", "split || ':' || row", "split = 'train' AND try_cast(WA AS DOUBLE) IS NOT NULL"),
    "train_helpsteer2_correctness": ({**ITEMS["helpsteer2_correctness"][0]}, "trim_('User prompt:' || nl || coalesce(prompt, '') || nl || nl || 'Assistant response:' || nl || response)", "correctness", adapters.CORRECTNESS, "''", "split || ':' || row", "true"),
    "train_civil_comments_toxicity": ({"text": "t", "toxicity": "n % 101 / 100.0"}, "trim_(text)", "greatest(0, least(6, trunc(toxicity::DOUBLE * 7)::INT))", [f"Toxicity level {i:02d}" for i in range(1, 8)], "''", "split || ':' || row", "true"),
    "train_measuring_hate_speech": ({"text": "t", "hate_speech_score": "CASE WHEN n % 5 > 0 THEN n % 60 / 10.0 - 4 END"}, "trim_(text)", f"len([c FOR c IN {adapters.HATE_SPEECH_CUTS} IF c <= hate_speech_score])", [f"Level {i:02d}" for i in range(1, 9)], "''", "row::VARCHAR", "hate_speech_score IS NOT NULL"),
    "train_wine_quality": (
        {"title": "lang", "country": "source", "province": "'p'", "variety": "CASE WHEN n % 2 = 0 THEN 'v' END", "description": "t", "points": "78 + n % 25"},
        "trim_('Wine: ' || coalesce(title, '') || nl || 'Origin: ' || coalesce(country, '') || ', ' || province || nl || 'Variety: ' || coalesce(variety, '') || nl || 'Review: ' || description)",
        "greatest(0, least(10, (points - 80) // 2))", adapters.WINE_BANDS, "''", "split || ':' || row", "points BETWEEN 80 AND 100",
    ),
    "train_word_concreteness": ({"Word": "CASE WHEN n % 3 > 0 THEN lang ELSE '' END", "Expression": "CASE WHEN n % 2 = 0 THEN 'two words' END", "`Conc.M`": "CASE WHEN n % 4 > 0 THEN " + _text("n % 5") + " || '.07' ELSE '' END", "mean": "'3.5'"}, "trim_('Word or expression: ' || coalesce(nullif(Word, ''), Expression))", f"len([c FOR c IN {adapters.CONCRETENESS_CUTS} IF c <= CAST(coalesce(nullif(\"Conc.M\", ''), mean) AS DOUBLE)])", [f"Level {i:02d}" for i in range(1, 10)], "''", "row::VARCHAR", "coalesce(nullif(Word, ''), nullif(Expression, '')) IS NOT NULL"),
    "train_wmt20_translation_quality": (
        {"config": "CASE n % 3 WHEN 0 THEN 'en-de' WHEN 1 THEN 'ro-en' ELSE 'km-en' END", "translation": "map_languages(t)", "mean": "CASE WHEN n % 6 > 0 THEN n % 101 / 1.0 END", "segid": "n"},
        "trim_('Source (' || name_(split_part(config, '-', 1)) || '): ' || t || nl || 'Translation (' || name_(split_part(config, '-', 2)) || '): ' || t)", f"len([c FOR c IN {adapters.WMT_CUTS} IF c <= mean])", [f"Level {i:02d}" for i in range(1, 13)], "''", "config || ':' || segid", "mean IS NOT NULL",
    ),
    "train_realtoxicity_continuation": ({"prompt": "struct_text(lang, 0.5)", "continuation": "struct_text(t, CASE WHEN n % 5 > 0 THEN n % 101 / 100.0 END)", "filename": "'f'", "begin": "n"}, "trim_('Prompt: ' || coalesce(prompt.text, '') || nl || 'Continuation: ' || continuation.text)", f"len([c FOR c IN {adapters.REALTOX_CUTS} IF c <= continuation.toxicity])", [f"Level {i:02d}" for i in range(1, 15)], "''", "filename || ':' || begin", "continuation.toxicity IS NOT NULL"),
}
#: adapter: raw columns; contexts as a list.
CONTEXTS: dict[str, tuple[dict[str, str], str]] = {
    "metacritic_games": ({"Game": "lang", "Platform": "source", "Review": "t"}, "['Game: ' || coalesce(Game, '') || nl || 'Platform: ' || coalesce(Platform, '') || nl || 'Review: ' || Review]"),
    "pitchfork_albums": ({"description": "t"}, "[description]"),
    "wine_quality_context": ({**TRAINING["train_wine_quality"][0]}, "['Wine: ' || coalesce(title, '') || nl || 'Origin: ' || coalesce(country, '') || ', ' || province || nl || 'Variety: ' || coalesce(variety, '') || nl || 'Review: ' || description]"),
    "civil_comments_toxicity_context": ({"text": "t"}, "[text]"),
    "measuring_hate_speech_context": ({"text": "t"}, "[text]"),
    "stsbenchmark_similarity": ({"sentence1": "lang", "sentence2": "t"}, "['Sentence 1: ' || coalesce(sentence1, '') || nl || 'Sentence 2: ' || sentence2]"),
    "wmt20_translation_quality_context": ({k: TRAINING["train_wmt20_translation_quality"][0][k] for k in ("config", "translation")}, "['Source (' || name_(split_part(config, '-', 1)) || '): ' || t || nl || 'Translation (' || name_(split_part(config, '-', 2)) || '): ' || t]"),
    "word_concreteness_context": ({"Word": "lang"}, "['Word or expression: ' || coalesce(Word, '')]"),
    "openreview_recommendation": (
        {"title": "lang", "abstract": "t", "reviews": "array_(struct_review('a', source), struct_review('b', source))"},
        "flatten([['Paper title: ' || coalesce(title, '') || nl || 'Abstract: ' || abstract || nl || 'Review summary: ' || x.summary || nl || 'Strengths: s' || nl || 'Weaknesses: ' || coalesce(x.weaknesses, ''), 'Paper title: ' || coalesce(title, '') || nl || 'Abstract: ' || abstract || nl || 'Review summary: ' || x.summary || nl || 'Strengths: s' || nl || 'Weaknesses: ' || coalesce(x.weaknesses, '') || nl || 'Questions: ' || x.questions] FOR x IN reviews])",
    ),
    "shp_community_approval": ({"domain": "CASE WHEN n % 2 = 0 THEN '' ELSE 'd' END", "subreddit": "source", "community": "'c'", "history": "CASE WHEN n % 3 = 0 THEN t ELSE '' END", "post": "CASE WHEN n % 3 = 1 THEN t END", "prompt": "t"}, "['Community: ' || coalesce(nullif(domain, ''), subreddit, community) || nl || 'Post: ' || coalesce(nullif(history, ''), nullif(post, ''), prompt)]"),
    "stackexchange_answer_score": ({"question": "'<p>Who &amp; <b>what</b>?</p>'", "answers": "array_(struct_answer('<i>It</i> is &lt;so&gt;'), struct_answer(concat('a<br>b ', lang)))"}, "['Question: Who &  what ?' || nl || 'Answer: It  is <so>', 'Question: Who &  what ?' || nl || 'Answer: a b ' || lang]"),
    "realtoxicity_continuation_context": ({k: TRAINING["train_realtoxicity_continuation"][0][k] for k in ("prompt", "continuation")}, "['Prompt: ' || coalesce(prompt.text, '') || nl || 'Continuation: ' || continuation.text]"),
    "webtext_quality": ({"selected_chunk": "CASE WHEN n % 2 = 0 THEN lang END", "text": "t"}, "[coalesce(selected_chunk, ''), text]"),
    "dbpedia14": ({"title": "lang", "content": "concat(' ', t)"}, "['Title: ' || coalesce(title, '') || nl || 'Description: ' || trim_(content)]"),
    "yahoo_answers10": ({"question_title": "lang", "question_content": "source", "best_answer": "t"}, "['Question title: ' || coalesce(question_title, '') || nl || 'Question: ' || coalesce(question_content, '') || nl || 'Best answer: ' || best_answer]"),
    "snips7": ({"text": "t"}, "[text]"),
    "scotus13": ({"text": "concat(' ', t, ' ')"}, "[text]"),
    "emobank_valence": ({"text": "CASE WHEN n % 3 = 0 THEN t ELSE '' END", "sentence": "CASE WHEN n % 3 = 1 THEN t END", "content": "t"}, "[coalesce(nullif(text, ''), nullif(sentence, ''), nullif(content, ''))]"),
    "humicroedit_funniness": ({"original": "'The <cat/> sat'", "edit": "source", "edited": "CASE WHEN n % 2 = 0 THEN 'The dog sat' END"}, "['Edited headline: ' || h || nl || 'Replacement word: ' || coalesce(edit, '') FOR h IN ['The ' || coalesce(edit, '') || ' sat', coalesce(edited, '')] IF h <> '']"),
    "stanford_politeness": ({"text": "t"}, "[text]"),
}

def _spark(x: str) -> str:
    """The few constructors that the two dialects write differently, for Spark."""
    if x.startswith("map_beer("):
        return f"map('review/overall', {x[9:-4]}, 'review/text', t)"
    if x == "map_languages(t)":
        return "map('en', t, 'de', t, 'ro', t, 'km', t)"
    if x.startswith("struct_text("):
        text, _, score = x[12:-1].partition(", ")
        return f"named_struct('text', {text}, 'toxicity', CAST({score} AS DOUBLE))"
    if "struct_review(" in x:
        one = lambda k: f"named_struct('summary', '{k}', 'strengths', 's', 'weaknesses', source, 'questions', 'q{k}')"
        return f"array({one('a')}, {one('b')})"
    if "struct_answer(" in x:
        return "array(named_struct('text', '<i>It</i> is &lt;so&gt;'), named_struct('text', concat('a<br>b ', lang)))"
    if x.startswith("array_(struct_label("):
        return f"array(named_struct('label', {x[20:-2]}))"
    return x.replace("VARCHAR(99)", "STRING")


def _duck(x: str) -> str:
    if x.startswith("map_beer("):
        return f"MAP {{'review/overall': {x[9:-4]}, 'review/text': t}}"
    if x == "map_languages(t)":
        return "t"
    if x.startswith("struct_text("):
        text, _, score = x[12:-1].partition(", ")
        return f"{{'text': {text}, 'toxicity': CAST({score} AS DOUBLE)}}"
    if "struct_review(" in x:
        one = lambda k: f"{{'summary': '{k}', 'strengths': 's', 'weaknesses': source, 'questions': 'q{k}'}}"
        return f"[{one('a')}, {one('b')}]"
    if "struct_answer(" in x:
        return "[{'text': 'x'}]"
    if x.startswith("array_(struct_label("):
        return f"[{{'label': {x[20:-2]}}}]"
    return x


_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"
_MACROS = [
    ("trim_", lambda x: f"regexp_replace({x}, '^{_BLANK}|{_BLANK}$', '', 'g')"),
    ("clean_", lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({x}, '^{_BLANK}|{_BLANK}$', '', 'g'), '&amp;', '&'), '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g'), '^{_BLANK}|{_BLANK}$', '', 'g')"),
    ("name_", lambda x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in adapters.LANGUAGES.items()) + f" ELSE {x} END"),
]


def _expand(x: str) -> str:
    for name, body in _MACROS:
        while (at := x.find(f"{name}(")) >= 0:
            depth, end = 0, at + len(name)
            while True:
                depth += {"(": 1, ")": -1}.get(x[end], 0)
                end += 1
                if not depth:
                    break
            x = x[:at] + body(x[at + len(name) + 1 : end - 1]) + x[end:]
    return re.sub(r"\bnl\b", "chr(10)", x)


def _raw_sql(raw: dict[str, str]) -> str:
    quoted = lambda k: '"' + k.strip("`") + '"'
    return "SELECT n, t, split, row, " + ", ".join(f"{_duck(x)} AS {quoted(k)}" for k, x in raw.items()) + " FROM base"


def _items_sql(name: str) -> str:
    raw, context, gold, choices, stratum, key, condition = {**ITEMS, **TRAINING}[name]
    names = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in choices) + "]"
    source = f"({_raw_sql(raw)}) x"
    if gold == "quintile":
        scored = f"(SELECT *, try_cast(WA AS DOUBLE) AS score FROM {source})"
        ranked = f"(SELECT *, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS m FROM {scored} WHERE score IS NOT NULL)"
        cuts = f"(SELECT list(score) AS cuts FROM {ranked} WHERE r IN ((m + 4) // 5, (2 * m + 4) // 5, (3 * m + 4) // 5, (4 * m + 4) // 5))"
        source = f"(SELECT *, len([c FOR c IN cuts IF c <= score])::INT AS quintile FROM {scored} s, {cuts} q)"
    body = f"SELECT *, ({gold})::INT AS gold, {_expand(context)} AS context FROM {source} WHERE {condition}"
    return f"SELECT '{name}::' || ({key}) AS sample_id, {names}[gold + 1] AS gold_label_text, gold AS gold_position, ({stratum})::VARCHAR AS sampling_stratum, sha256(context) AS context_sha FROM ({body}) WHERE gold BETWEEN 0 AND {len(choices) - 1} AND context <> ''"


def _contexts_sql(name: str) -> str:
    raw, contexts = CONTEXTS[name]
    body = f"SELECT row, unnest({_expand(contexts)}) AS c FROM (SELECT x.*, b.lang, b.source FROM ({_raw_sql(raw)}) x JOIN base b USING (row))"
    return f"SELECT '{name}' AS adapter, row::BIGINT AS row, sha256({_expand('trim_(c)')}) AS context_sha FROM ({body}) WHERE {_expand('trim_(c)')} <> ''"


def _union_sql(parts: list[str]) -> str:
    return f"WITH base AS ({BASE}) " + " UNION ALL ".join(f"({p})" for p in parts)


def raw_rows(spark, d, name: str) -> DataFrame:
    """What an adapter reads, as rows over all documents."""
    raw = {**ITEMS, **TRAINING}[name][0] if name not in CONTEXTS else CONTEXTS[name][0]
    docs = table(spark, d, "documents").selectExpr("doc_id AS n", "coalesce(text, '') AS t", "lang", "source", "CASE WHEN doc_id % 3 = 0 THEN 'train' WHEN doc_id % 3 = 1 THEN 'test' ELSE 'dev' END AS split", "doc_id AS row")
    return docs.selectExpr("split", "row", *(f"{_spark(x)} AS `{k.strip('`')}`" for k, x in raw.items()))


def _as_items(spark, d, names: list[str]) -> DataFrame:
    out = None
    for name in names:
        got = adapters.items(raw_rows(spark, d, name), name).select("sample_id", "gold_label_text", "gold_position", "sampling_stratum", T.sha(F.col("context")).alias("context_sha"))
        out = got if out is None else out.unionByName(got)
    return out


_BATCH = list(ITEMS)


@query(_union_sql([_items_sql(n) for n in _BATCH[:10]]))
def adapters_native_labels(spark, d) -> DataFrame:
    """The ten sources with native labels."""
    return _as_items(spark, d, _BATCH[:10])


@query(_union_sql([_items_sql(n) for n in _BATCH[10:]]))
def adapters_ruled_labels(spark, d) -> DataFrame:
    """The ten sources whose labels need a rule and whose texts are cleaned."""
    return _as_items(spark, d, _BATCH[10:])


@query(_union_sql([_contexts_sql(n) for n in CONTEXTS]))
def adapters_contexts(spark, d) -> DataFrame:
    """The twenty sources of contexts alone."""
    out = None
    for name in CONTEXTS:
        rows = adapters.contexts(raw_rows(spark, d, name), name).select(F.lit(name).alias("adapter"), "row", T.sha(F.col("context")).alias("context_sha"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_union_sql([_items_sql(n) for n in TRAINING]))
def adapters_training(spark, d) -> DataFrame:
    """The eight iterators of training data."""
    return _as_items(spark, d, list(TRAINING))
