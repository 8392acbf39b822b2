"""Quality rules: base counts, then divergence of a document's histograms from language references."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import xxhash64

from seqwatch.llm.shared import words_of, written

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for on with as was by this be are or an at from not".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par sur pas au plus ce avec il".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o".split(),
}
#: Regular expressions of what to strip to leave one class of characters only.
NOT_CLASS = {
    "upper": r"[^\p{Lu}]+",
    "digit": r"[^\p{Nd}]+",
    "stop": r"""[^.,;:!?'"()\-]+""",
    "symbol": r"""[\p{L}\p{M}\p{Nd}\s.,;:!?'"()\-]+""",
}
CLASSES = ["letter", "upper", "digit", "space", "stop", "symbol"]
#: Slots of the hash table of common words; of so many seeds, the first by which no two words share a slot is taken.
SLOTS, SEEDS = 8192, 64
MIN_CHARS, MAX_CLASS_DISTANCE = 200, 0.25
MIN_WORDS, MAX_WORD_DISTANCE = 50, 0.70
#: The word bound as a part of the distance that a text without any common word has.
WORDLESS_PART = 0.90
#: Common words that a text must be expected to have, by its length, before a lack of them tells something.
EXPECTED_HITS = 10


def _stripped(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """The base columns of every document; lists of a text stay within its row, so nothing is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    at = lambda i, k: F.get(F.col("words"), i + k)
    hashes = F.transform(F.col("words"), lambda w, i: xxhash64(w, *[at(i, k) for k in range(1, 5)]))
    full = F.greatest(F.size("words") - 4, F.lit(0))
    windows = F.slice(F.transform(F.col("words"), lambda w, i: F.concat_ws(" ", w, *[at(i, k) for k in range(1, 5)])), F.lit(1), full)
    # Of windows in order of (window, place), those with an equal neighbour; then the words that they cover.
    ranked = F.sort_array(F.transform(F.col("windows"), lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    repeated = F.array_sort(
        F.transform(
            F.filter(
                F.transform(
                    F.col("ranked"),
                    lambda x, i: F.when((x["w"] == F.get(F.col("ranked"), i - 1)["w"]) | (x["w"] == F.get(F.col("ranked"), i + 1)["w"]), x["at"]),
                ),
                lambda at: at.isNotNull(),
            ),
            lambda at: at,
        )
    )
    covered = F.aggregate(
        F.transform(F.col("repeated"), lambda at, i: F.least(F.lit(5), F.coalesce(F.get(F.col("repeated"), i + 1) - at, F.lit(5)))), F.lit(0).cast("long"), lambda a, b: a + b
    )
    # Windows whose hashes differ differ themselves, so most texts need no list of windows.
    some = F.size(F.array_distinct(F.slice(F.col("hashes"), F.lit(1), full))) < full
    return (
        docs.select("doc_id", F.col("lang").alias("doc_lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("doc_lang"), text.alias("body"), words_of(F.col("text")).alias("words"), lines.alias("lines"))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", _stripped(F.col("body"), r"[\x20\x09-\x0D]+"))
        .withColumn("n_symbols", _stripped(F.col("body"), r"[^#*$%&|<>]+"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("hashes", hashes)
        .withColumn("windows", F.when(some, windows))
        .withColumn("ranked", F.when(F.col("windows").isNotNull(), ranked))
        .withColumn("repeated", F.when(F.col("ranked").isNotNull(), repeated))
        .withColumn("n_repeat_words", F.when(F.col("repeated").isNotNull(), covered).otherwise(F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop("lines", "hashes", "windows", "ranked", "repeated")
    )


def perfect_hash(spark, words: list[str]) -> tuple[int, list[int]]:
    """A seed by which no two words share a slot, and their slots."""
    seeds = F.array(*[F.pmod(xxhash64("w", F.lit(k)), F.lit(SLOTS)).cast("int") for k in range(SEEDS)])
    rows = {r["w"]: r["slots"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", seeds.alias("slots")).collect()}
    for k in range(SEEDS):
        slots = [rows[w][k] for w in words]
        if len({*slots}) == len(slots):
            return k, slots
    raise ValueError(f"too many words for {SLOTS} slots: {len(words)}")


def histograms(counted: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """Adds `classes` (characters by class) and `hits` (occurrences of each common word of any language).

    Each word is hashed once to a slot of a table that is held in array literals; the common ones become one character
    each, so that counting a word is a count of a character in a string of the text's common words only.
    """
    vocabulary = sorted({w for ws in common.values() for w in ws})
    marks = {w: chr(0x4E00 + k) for k, w in enumerate(vocabulary)}
    seed, places = perfect_hash(counted.sparkSession, vocabulary)
    names, letters = [""] * SLOTS, [""] * SLOTS
    for w, k in zip(vocabulary, places):
        names[k], letters[k] = w, marks[w]
    names, letters = (F.split(F.lit(" ".join(x)), " ", -1) for x in (names, letters))  # folded to one literal each
    body = F.col("body")
    low = F.split(F.lower(F.array_join("words", " ")), " ")
    slots = F.transform("low", lambda w: F.pmod(xxhash64(w, F.lit(seed)), F.lit(SLOTS)).cast("int"))
    coded = F.array_join(F.zip_with("low", "slots", lambda w, k: F.when(F.get(names, k) == w, F.get(letters, k)).otherwise("")), "")
    out = counted.withColumn("low", low).withColumn("slots", slots).withColumn("coded", coded)
    for k, pattern in NOT_CLASS.items():
        out = out.withColumn(k, _stripped(body, pattern))
    out = out.withColumn("n_chars_all", F.length("body").cast("long")).withColumn("space", F.col("n_chars_all") - F.col("word_chars"))
    rest = F.col("n_chars_all") - sum((F.col(k) for k in CLASSES if k not in ("letter",)), F.lit(0))
    hits = F.array(*[(F.length("coded") - F.length(F.replace(F.col("coded"), F.lit(marks[w]), F.lit("")))).cast("double") for w in vocabulary])
    return (
        out.withColumn("letter", F.greatest(rest, F.lit(0)))
        .withColumn("classes", F.array(*[F.col(k).cast("double") for k in CLASSES]))
        .withColumn("hits", hits)
        .drop("coded", "low", "slots", "body", "words", "n_chars_all", *CLASSES)
    )


def js_distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms that each sum to 1; 0 (equal) to 1 (nothing shared)."""
    part = lambda x, y: F.when(x > 0, x * F.log(2 * x / (x + y))).otherwise(F.lit(0.0)) + F.when(y > 0, y * F.log(2 * y / (x + y))).otherwise(F.lit(0.0))
    total = F.aggregate(F.zip_with(p, F.array(*map(F.lit, q)), part), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(total, F.lit(0.0)) / (2 * math.log(2)))


def wordless_distance(words: list[float]) -> float:
    """The Jensen-Shannon distance of a reference of common words from a text that has none of them, all in the rest."""
    rest = words[-1]
    total = sum(words[:-1]) * math.log(2) + math.log(2 / (1 + rest)) + (rest * math.log(2 * rest / (1 + rest)) if rest > 0 else 0.0)
    return math.sqrt(max(total, 0.0) / (2 * math.log(2)))


def word_bound(known: dict[str, tuple[list[float], list[float]]], max_word_distance: float) -> tuple[float, float]:
    """The allowed word distance, and the words from which a text is judged by it.

    A text without common words is only as far from a reference as the language's share of common words makes it
    (0.34 at 21 %), so the bound is a part of the least such distance, and `max_word_distance` at most. Short texts, or
    references with few common words, expect too few to judge by; a reference with none judges nobody.
    """
    if not known:
        return max_word_distance, math.inf
    share = min(sum(words[:-1]) for _, words in known.values())
    return min(max_word_distance, WORDLESS_PART * min(wordless_distance(words) for _, words in known.values())), EXPECTED_HITS / share if share > 0 else math.inf


def references(measured: DataFrame, common: dict[str, list[str]]) -> dict[str, tuple[list[float], list[float]]]:
    """For each language, the shares of character classes and of its common words over all its documents that pass the base rules.

    One aggregate of a fixed number of sums for each listed language; a language without documents has no reference.
    """
    vocabulary = sorted({w for ws in common.values() for w in ws})
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(len(CLASSES))] + [F.sum(F.col("hits")[k]).alias(f"h{k}") for k in range(len(vocabulary))]
    rows = measured.filter(~F.col("base_failed") & F.col("doc_lang").isin(*common)).groupBy("doc_lang").agg(*sums, F.sum("n_words").alias("n")).collect()
    found = {}
    for r in rows:
        classes = [r[f"c{k}"] for k in range(len(CLASSES))]
        own = [r[f"h{vocabulary.index(w)}"] for w in common[r["doc_lang"]]]
        found[r["doc_lang"]] = ([c / sum(classes) for c in classes], [h / r["n"] for h in own] + [1 - sum(own) / r["n"]])
    return found


def quality_rules(
    docs: DataFrame,
    common: dict[str, list[str]] = COMMON_WORDS,
    min_chars: int = MIN_CHARS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    min_words: int = MIN_WORDS,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """One row per document with the base counts and the verdict of the divergence rule.

    The distances are those to the nearest language reference, so that a wrong or missing `lang` rejects nobody. A
    document is kept if it passes the base rules and neither histogram is further from the references than allowed;
    a text under `min_chars` characters or `min_words` words is not judged by that histogram. The word distance allowed
    is that of `word_bound`, so that a text without common words is rejected; texts of a language that has no reference
    are not judged by words.

    Null and blank texts have zero counts and fail the base rules. Without any reference (an empty table, no listed
    language) the distances are null and only the base rules decide. A distance equal to its bound is allowed; repeated
    ids keep every row. The words of a very long text are lists within its row. Other columns than doc_id, text and lang,
    whatever their names, are ignored.
    """
    vocabulary = sorted({w for ws in common.values() for w in ws})
    measured = written(histograms(base_counts(docs), common), "quality-histograms")
    known = references(measured, common)
    chars = F.aggregate("classes", F.lit(0.0), lambda a, b: a + b)
    shares = F.transform("classes", lambda x: x / F.nullif(F.col("chars"), F.lit(0.0)))
    out = measured.withColumn("chars", chars).withColumn("shares", shares)
    by_class, by_word = [], []
    for lang, (classes, words) in sorted(known.items()):
        own = [F.col("hits")[vocabulary.index(w)] / F.nullif("n_words", F.lit(0)) for w in common[lang]]
        by_class.append(js_distance(F.col("shares"), classes))
        by_word.append(js_distance(F.array(*own, 1 - sum(own, F.lit(0.0))), words))
    least = lambda xs: F.array_min(F.array(*xs)) if xs else F.lit(None).cast("double")
    out = out.withColumn("class_distance", F.when(F.col("chars") > 0, least(by_class))).withColumn("word_distance", F.when(F.col("n_words") > 0, least(by_word)))
    odd = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > max_class_distance) & (F.col("chars") >= min_chars)
    bound, enough = word_bound(known, max_word_distance)
    judged = F.coalesce(F.col("doc_lang").isin(*known), F.lit(True)) & (F.col("n_words") >= max(min_words, enough))
    odd |= (F.coalesce(F.col("word_distance"), F.lit(0.0)) > bound) & judged
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "class_distance", "word_distance"
    )
