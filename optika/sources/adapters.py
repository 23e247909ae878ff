"""Labelled sources as multiple-choice items.

An adapter is a declaration: how a row's context is written, how its label becomes a position, and what else it
needs.  ``items`` compiles it to one select; rows whose label or context is unusable are filtered by the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optika.functions import arrays as A
from optika.functions import text as T
from optika.operators.experiments import quantile_cuts
from optika.operators.quality import finite

c = F.col

# The questions of the released items.
QUESTIONS = {
    "sst5": "What sentiment label was assigned to this sentence?",
    "tweet_eval_sentiment": "What sentiment label was assigned to this tweet?",
    "semeval2018_ei_oc": "How strongly does this tweet express %s?",
    "meld_sentiment": "What sentiment label was assigned to this dialogue utterance?",
    "amazon_reviews_2023_all_beauty": "What star rating did the reviewer assign?",
    "app_reviews": "What star rating did the reviewer assign to this app review?",
    "uci_drugs_com": "What 1-to-10 satisfaction rating did the reviewer assign to this drug review?",
    "asap2": "What holistic quality score (1 to 6) did the human raters assign to this essay?",
    "persuade2_argument_effectiveness": "What effectiveness label did the human annotators assign to the target argument component?",
    "helpsteer": "What helpfulness rating (0 to 4) did the human annotators assign to this response?",
    "imdb_ratings": "What rating did the reviewer assign to this movie review?",
    "goodreads_reviews": "What star rating did the reviewer assign to this book review?",
    "tripadvisor_hotel_reviews": "What overall star rating did the reviewer assign to this hotel review?",
    "labr_arabic_book_reviews": "What star rating did the reviewer assign to this Arabic book review?",
    "beeradvocate_reviews": "Which overall rating band best matches the recorded beer-review score?",
    "cmu_mosei_sentiment": "What sentiment intensity label was assigned to this utterance?",
    "ibm_argument_quality": "Which crowd-derived argument-quality quintile was assigned to this argument?",
    "helpsteer2_correctness": "What correctness rating was assigned to this assistant response?",
    "ultrafeedback_quality": "Which overall quality band was assigned by the evaluator?",
    "dynasent": "What sentiment label was assigned to this sentence?",
}

# Option labels, cuts and names that the released items carry.
STARS = ["1 star", "2 stars", "3 stars", "4 stars", "5 stars"]
SENTIMENT3 = ["Negative", "Neutral", "Positive"]
CONCRETENESS_CUTS = [1.81, 2.07, 2.33, 2.68, 3.07, 3.52, 4.04, 4.59]
HATE_SPEECH_CUTS = [-3.46, -2.35, -1.45, -0.72, -0.09, 0.56, 1.32]
WMT_CUTS = [70.25, 78.33333587646484, 83.33333587646484, 85.33333587646484, 87.0, 88.66666412353516, 90.0, 91.0, 92.33333587646484, 93.66666412353516, 96.66666412353516]
REALTOX_CUTS = [
    0.04303850314285715, 0.065443045, 0.07906512285714286, 0.10924429142857144, 0.14550563285714282, 0.20702842714285716, 0.27817565,
    0.36329269999999997, 0.4597955371428572, 0.5671150228571428, 0.7143426, 0.8368374714285715, 0.8998802285714286,
]
MOSEI_CUTS = [-1.5, -0.5, 0.5, 1.5]
LANGUAGES = {"en": "English", "de": "German", "zh": "Chinese", "et": "Estonian", "ne": "Nepali", "ro": "Romanian", "si": "Sinhala"}
WINE_BANDS = ["80–81 points", "82–83 points", "84–85 points", "86–87 points", "88–89 points", "90–91 points", "92–93 points", "94–95 points", "96–97 points", "98–99 points", "100 points"]
QUINTILES = ["Q1 - Lowest quality", "Q2 - Low quality", "Q3 - Medium quality", "Q4 - High quality", "Q5 - Highest quality"]
CORRECTNESS = ["0 - Incorrect", "1 - Mostly incorrect", "2 - Partly correct", "3 - Mostly correct", "4 - Fully correct"]


def number(name: str) -> Column:
    return c(name).try_cast("double")


def whole(name: str) -> Column:
    """int(float(x)): truncation."""
    return number(name).cast("int")


def named(x: Column, names: list[str]) -> Column:
    """The position of a label's name, null if unknown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), x), F.lit(0)).cast("int") - 1


def band(name: str, shift: int = 0) -> Callable[[], Column]:
    """The sampling stratum name=level."""
    return lambda: F.concat(F.lit(f"{name}="), (c("gold_position") + shift).cast("string"))


@dataclass(frozen=True)
class Adapter:
    """A source: context, gold position, choices, question (if not a fixed one), stratum, id, and a filter."""

    context: Callable[[], Column]
    gold: Callable[[], Column] | None = None
    choices: list[str] = field(default_factory=list)
    question: Callable[[], Column] | None = None
    stratum: Callable[[], Column] = lambda: F.lit("")
    key: Callable[[], Column] = lambda: F.concat_ws(":", "split", "row")
    keep: Callable[[], Column] | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None
    clean: bool = False


def _levels(n: int, word: str = "Level") -> list[str]:
    return [f"{word} {i:02d}" for i in range(1, n + 1)]


def _pair(a: str, x: str, b: str, y: str, gap: str = "\n\n") -> Callable[[], Column]:
    return lambda: T.template(f"{a}%s{gap}{b}%s", c(x), c(y))


def _quintiles(df: DataFrame) -> DataFrame:
    """Empirical quintile cuts over all splits: the value at ceil(n q / 5) of the sorted scores."""
    scored = df.withColumn("score", number("WA")).where(finite(c("score")))
    cuts = quantile_cuts(scored, "score", 5) or [None] * 4
    return scored.withColumns({f"q{q}": F.lit(v).cast("double") for q, v in enumerate(cuts, 1)})


def _zero_based(df: DataFrame) -> DataFrame:
    """Per split: labels that run from 0 to at most 4 are shifted by one.  The table of splits is a few rows."""
    have = df.where("label IS NOT NULL")
    shift = have.groupBy("split").agg(F.when((F.min("label") == 0) & (F.max("label") <= 4), 1).otherwise(0).alias("shift"))
    return have.join(F.broadcast(shift), "split").withColumn("rating", c("label") + c("shift"))


def _alternatives(*contexts: Column) -> Column:
    return F.explode(F.array(*contexts))


def _html(x: Column) -> Column:
    return T.page_text(x)


ADAPTERS: dict[str, Adapter] = {
    # first batch: native labels
    "sst5": Adapter(lambda: c("text"), lambda: whole("label"), ["Very negative", "Negative", "Neutral", "Positive", "Very positive"], stratum=band("sentiment")),
    "tweet_eval_sentiment": Adapter(lambda: c("text"), lambda: whole("label"), SENTIMENT3, stratum=band("sentiment")),
    "semeval2018_ei_oc": Adapter(
        lambda: c("Tweet"), lambda: F.split_part("Intensity Class", F.lit(":"), F.lit(1)).try_cast("int"),
        ["Intensity 0 (none)", "Intensity 1 (low)", "Intensity 2 (moderate)", "Intensity 3 (high)"],
        lambda: F.format_string(QUESTIONS["semeval2018_ei_oc"], F.lower(F.trim("Affect Dimension"))), key=lambda: F.concat_ws(":", "split", F.lower(F.trim("Affect Dimension")), "ID"), stratum=lambda: F.concat(F.lit("emotion="), F.lower(F.trim("Affect Dimension")), F.lit("|intensity="), c("gold_position").cast("string"))),
    "meld_sentiment": Adapter(lambda: c("Utterance"), lambda: named(F.lower(F.trim("Sentiment")), ["negative", "neutral", "positive"]), SENTIMENT3, key=lambda: F.format_string("%s:dialogue%s:utterance%s", "split", "Dialogue_ID", "Utterance_ID"), stratum=band("sentiment")),
    "amazon_reviews_2023_all_beauty": Adapter(_pair("Review title: ", "title", "Review text: ", "text"), lambda: whole("rating") - 1, STARS, key=lambda: T.template("all_beauty:%s:%s:%s", c("row"), c("parent_asin"), c("user_id")), stratum=band("stars", 1)),
    "app_reviews": Adapter(lambda: c("review"), lambda: whole("star") - 1, STARS, key=lambda: T.template("row:%s", c("row")), stratum=band("stars", 1)),
    "uci_drugs_com": Adapter(lambda: T.template("Drug: %s\nCondition: %s\n\nReview: %s", c("drugName"), c("condition"), c("review")), lambda: whole("rating") - 1, [f"Rating {i}" for i in range(1, 11)], stratum=band("rating", 1), key=lambda: F.concat_ws(":", "split", T.or_else(c("`Unnamed: 0`"), F.concat_ws(":", "split", "row")))),
    "asap2": Adapter(_pair("Writing assignment:\n", "assignment", "Student essay:\n", "full_text"), lambda: whole("score") - 1, [f"Score {i}" for i in range(1, 7)], key=lambda: c("essay_id"), stratum=band("score", 1)),
    "persuade2_argument_effectiveness": Adapter(
        lambda: T.template("Writing assignment:\n%s\n\nFull essay:\n%s\n\nTarget component type: %s\nTarget argument component:\n%s", c("assignment"), c("full_text"), c("discourse_type"), c("discourse_text")),
        lambda: named(F.trim("discourse_effectiveness"), ["Ineffective", "Adequate", "Effective"]), ["Ineffective", "Adequate", "Effective"],
        key=lambda: T.template("essay:%s|start:%s|end:%s|row:%s", c("essay_id_comp"), c("discourse_start"), c("discourse_end"), c("row")), stratum=band("effectiveness")),
    "helpsteer": Adapter(_pair("User prompt:\n", "prompt", "Assistant response:\n", "response"), lambda: whole("helpfulness"), [f"Helpfulness {i}" for i in range(5)], stratum=band("helpfulness")),
    # second batch: labels that need a rule; texts are cleaned
    "imdb_ratings": Adapter(lambda: c("text"), lambda: named(c("rating"), ["1", "2", "3", "4", "7", "8", "9", "10"]), ["1/10", "2/10", "3/10", "4/10", "7/10", "8/10", "9/10", "10/10"], key=lambda: F.concat_ws(":", "split", "polarity", "number"), clean=True, stratum=lambda: F.concat(F.lit("rating="), c("rating"))),
    "goodreads_reviews": Adapter(lambda: c("review_text"), lambda: whole("rating") - 1, STARS, key=lambda: T.or_else(c("review_id"), c("row").cast("string")), keep=lambda: whole("rating").between(1, 5), clean=True, stratum=band("rating", 1)),
    "tripadvisor_hotel_reviews": Adapter(
        lambda: F.coalesce("review", "text"), lambda: F.bround(F.coalesce("label", "rating", "overall", F.get("prediction", F.lit(0))["label"]).try_cast("double")).cast("int") - 1, STARS,
        clean=True, stratum=band("rating", 1), key=lambda: T.or_else(c("id").cast("string"), c("row").cast("string"))),
    "labr_arabic_book_reviews": Adapter(lambda: c("text"), lambda: whole("rating") - 1, STARS, prepare=_zero_based, clean=True, stratum=band("rating", 1)),
    "beeradvocate_reviews": Adapter(
        lambda: F.coalesce(*(F.try_element_at("fields", F.lit(k)) for k in ("review/text", "review_text", "text"))),
        lambda: F.when((s := F.coalesce(*(F.try_element_at("fields", F.lit(k)) for k in ("review/overall", "review_overall", "overall"))).try_cast("double")) <= 2.5, 0).when(s <= 3.5, 1).when(s.isNotNull(), 2),
        ["Low rating (1-2.5)", "Medium rating (3-3.5)", "High rating (4-5)"], key=lambda: c("row").cast("string"), clean=True, stratum=band("rating_band")),
    "cmu_mosei_sentiment": Adapter(lambda: c("text"), lambda: F.when(number("sentiment").isNotNull(), A.bisect_right(MOSEI_CUTS, number("sentiment"))), ["Strongly negative", "Weakly negative", "Neutral", "Weakly positive", "Strongly positive"], clean=True, stratum=band("sentiment_band")),
    "ibm_argument_quality": Adapter(_pair("Topic: ", "topic", "Argument: ", "argument", "\n"), lambda: F.size(F.filter(F.array("q1", "q2", "q3", "q4"), lambda q: q <= c("score"))), QUINTILES, prepare=_quintiles, clean=True, stratum=band("quality_quintile", 1)),
    "helpsteer2_correctness": Adapter(_pair("User prompt:\n", "prompt", "Assistant response:\n", "response"), lambda: whole("correctness"), CORRECTNESS, clean=True, stratum=band("correctness")),
    "ultrafeedback_quality": Adapter(_pair("User instruction:\n", "instruction", "Assistant response:\n", "response"), lambda: F.greatest(F.lit(0), F.least(F.lit(4), F.ceil(number("overall_score") / 2).cast("int") - 1)), ["Very low (0-2]", "Low (2-4]", "Medium (4-6]", "High (6-8]", "Very high (8-10]"], keep=lambda: number("overall_score").isNotNull(), clean=True, stratum=band("quality_band"), key=lambda: F.concat(F.lit("shard"), c("shard").cast("string"), F.lit(":"), c("row").cast("string"))),
    "dynasent": Adapter(lambda: c("sentence"), lambda: named(c("gold_label"), ["negative", "neutral", "positive"]), SENTIMENT3, key=lambda: T.or_else(c("text_id"), F.concat_ws(":", "member", "row")), clean=True, stratum=lambda: F.concat(F.lit("sentiment="), c("gold_label"))),
    # third batch: contexts only, matched to a frozen index by their hash
    "metacritic_games": Adapter(lambda: T.template("Game: %s\nPlatform: %s\nReview: %s", c("Game"), c("Platform"), c("Review"))),
    "pitchfork_albums": Adapter(lambda: c("description")),
    "wine_quality_context": Adapter(lambda: T.template("Wine: %s\nOrigin: %s, %s\nVariety: %s\nReview: %s", c("title"), c("country"), c("province"), c("variety"), c("description"))),
    "civil_comments_toxicity_context": Adapter(lambda: c("text")),
    "measuring_hate_speech_context": Adapter(lambda: c("text")),
    "stsbenchmark_similarity": Adapter(_pair("Sentence 1: ", "sentence1", "Sentence 2: ", "sentence2", "\n")),
    "wmt20_translation_quality_context": Adapter(lambda: _translation()),
    "word_concreteness_context": Adapter(lambda: T.template("Word or expression: %s", T.or_else(c("Word")))),
    "openreview_recommendation": Adapter(
        lambda: F.explode(F.array(_review(), F.concat(_review(), T.template("\nQuestions: %s", c("review.questions"))))), prepare=lambda df: df.withColumn("review", F.explode("reviews")),
    ),
    "shp_community_approval": Adapter(lambda: T.template("Community: %s\nPost: %s", T.or_else(c("domain"), c("subreddit"), c("community")), T.or_else(c("history"), c("post"), c("prompt")))),
    "stackexchange_answer_score": Adapter(lambda: T.template("Question: %s\nAnswer: %s", _html(c("question")), _html(c("answer.text"))), prepare=lambda df: df.withColumn("answer", F.explode("answers"))),
    "realtoxicity_continuation_context": Adapter(lambda: T.template("Prompt: %s\nContinuation: %s", c("prompt.text"), c("continuation.text"))),
    "webtext_quality": Adapter(lambda: _alternatives(F.coalesce("selected_chunk", F.lit("")), F.coalesce("text", F.lit("")))),
    "dbpedia14": Adapter(lambda: T.template("Title: %s\nDescription: %s", c("title"), T.trim_blanks(c("content")))),
    "yahoo_answers10": Adapter(lambda: T.template("Question title: %s\nQuestion: %s\nBest answer: %s", c("question_title"), c("question_content"), c("best_answer"))),
    "snips7": Adapter(lambda: c("text")),
    "scotus13": Adapter(lambda: c("text")),
    "emobank_valence": Adapter(lambda: T.or_else(c("text"), c("sentence"), c("content"))),
    "humicroedit_funniness": Adapter(lambda: _headlines()),
    "stanford_politeness": Adapter(lambda: c("text")),
    # training iterators
    "train_ibm_argument_quality": Adapter(_pair("Topic: ", "topic", "Argument: ", "argument", "\n"), lambda: F.size(F.filter(F.array("q1", "q2", "q3", "q4"), lambda q: q <= c("score"))), QUINTILES, prepare=_quintiles, keep=lambda: c("split") == "train"),
    "train_helpsteer2_correctness": Adapter(_pair("User prompt:\n", "prompt", "Assistant response:\n", "response"), lambda: whole("correctness"), CORRECTNESS),
    "train_civil_comments_toxicity": Adapter(lambda: c("text"), lambda: A.clamp(number("toxicity") * 7, 0, 6), _levels(7, "Toxicity level")),
    "train_measuring_hate_speech": Adapter(lambda: c("text"), lambda: F.when(number("hate_speech_score").isNotNull(), A.bisect_right(HATE_SPEECH_CUTS, number("hate_speech_score"))), _levels(8), key=lambda: c("row").cast("string")),
    "train_wine_quality": Adapter(lambda: T.template("Wine: %s\nOrigin: %s, %s\nVariety: %s\nReview: %s", c("title"), c("country"), c("province"), c("variety"), c("description")), lambda: A.clamp(F.floor((number("points") - 80) / 2), 0, 10), WINE_BANDS, keep=lambda: number("points").between(80, 100)),
    "train_word_concreteness": Adapter(
        lambda: T.template("Word or expression: %s", T.or_else(c("Word"), c("Expression"))), lambda: F.when((s := T.or_else(c("`Conc.M`"), c("mean")).try_cast("double")).isNotNull(), A.bisect_right(CONCRETENESS_CUTS, s)),
        _levels(9), keep=lambda: T.or_else(c("Word"), c("Expression")).isNotNull(), key=lambda: c("row").cast("string")),
    "train_wmt20_translation_quality": Adapter(lambda: _translation(), lambda: A.bisect_right(WMT_CUTS, number("mean")), _levels(12), key=lambda: F.concat_ws(":", "config", "segid"), keep=lambda: number("mean").isNotNull()),
    "train_realtoxicity_continuation": Adapter(
        lambda: T.template("Prompt: %s\nContinuation: %s", c("prompt.text"), c("continuation.text")), lambda: F.when((s := c("continuation.toxicity").try_cast("double")).isNotNull(), A.bisect_right(REALTOX_CUTS, s)),
        _levels(14), key=lambda: F.concat_ws(":", "filename", "begin"),
    ),
}


def _translation() -> Column:
    a, b = F.split_part("config", F.lit("-"), F.lit(1)), F.split_part("config", F.lit("-"), F.lit(2))
    return T.template("Source (%s): %s\nTranslation (%s): %s", T.language_name(a, LANGUAGES), F.try_element_at("translation", a), T.language_name(b, LANGUAGES), F.try_element_at("translation", b))


def _review() -> Column:
    return T.template("Paper title: %s\nAbstract: %s\nReview summary: %s\nStrengths: %s\nWeaknesses: %s", c("title"), c("abstract"), c("review.summary"), c("review.strengths"), c("review.weaknesses"))


def _headlines() -> Column:
    """Two variants of an edited headline: the original with its marked word replaced, and the given edited one."""
    original, edit = F.coalesce("original", F.lit("")), F.coalesce("edit", F.lit(""))
    shown = F.filter(F.array(F.regexp_replace(original, F.lit(r"<[^<>]*/>"), edit), F.coalesce("edited", F.lit(""))), lambda h: h != "")
    return F.explode(F.transform(shown, lambda h: F.concat(F.lit("Edited headline: "), h, F.lit("\nReplacement word: "), edit)))


def _prepared(df: DataFrame, a: Adapter) -> DataFrame:
    df = a.prepare(df) if a.prepare else df
    return df.where(a.keep()) if a.keep else df


def _filled(df: DataFrame, text: Column) -> DataFrame:
    """df with the text as context, where it is not empty.  It is computed once, in a generator: a filter on a column is
    pushed below it together with a second copy of all that makes the column."""
    return df.withColumn("context", F.explode(F.filter(F.array(text), lambda x: x != "")))


def _contexts(df: DataFrame, a: Adapter) -> DataFrame:
    out = _filled(df.withColumn("context", a.context()), T.trim_blanks(F.col("context")))
    return _filled(out, T.clean_html(F.col("context"))) if a.clean else out


def contexts(df: DataFrame, source: str) -> DataFrame:
    """The context variants of a source's rows, trimmed; empty ones go."""
    a = ADAPTERS[source]
    return _contexts(_prepared(df, a), a)


def items(df: DataFrame, source: str, revision: str = "", seed: int = 20260926) -> DataFrame:
    """The source's rows (with split and row columns) as items; unusable labels and contexts are dropped.  The stratum is
    named as the source names it, since sampling ranks depend on it."""
    a = ADAPTERS[source]
    if a.gold is None:
        raise ValueError(f"{source} has contexts only; its labels come from a frozen index")
    out = _prepared(df, a).withColumn("gold_position", a.gold().cast("int"))
    choices = F.array(*map(F.lit, a.choices))
    out = _contexts(out.where((F.col("gold_position") >= 0) & (F.col("gold_position") < len(a.choices))), a)
    question = a.question() if a.question else F.lit(QUESTIONS.get(source, ""))
    return out.select(
        F.concat(F.lit(f"{source}::"), a.key()).alias("sample_id"), F.lit(source).alias("source"), a.key().alias("original_id"), F.col("split"), "context", question.alias("question"), choices.alias("choices"),
        "gold_position", F.get(choices, F.col("gold_position")).alias("gold_label_text"), a.stratum().alias("sampling_stratum"), F.lit(seed).alias("sampling_seed"), F.lit(revision).alias("source_revision"),
    )
