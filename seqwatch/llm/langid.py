"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwatch.llm.shared import id_bucket, mix64, slices

UNKNOWN = "und"
#: About so many training documents are used at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 16
LONGEST_GRAM = 4
#: Nats that a change of language costs.
SWITCH = 8.0
#: Words that a worker remembers; scores (words times languages) that it holds at a time.
REMEMBERED, HELD_SCORES = 1 << 17, 1 << 22
#: First code points of script ranges, each up to the next one.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1D00, "latin"),
    (0x1F00, "greek"), (0x2000, "latin"), (0x2C00, "other"), (0x3040, "kana"), (0x3130, "hangul"), (0x31A0, "other"),
    (0x31F0, "kana"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
]
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])
#: A language that has less than this share of its letters in a script is no candidate for words of it.
SCRIPT_SHARE = 0.001
BARRED = -1e4

letter_runs = re.compile(r"[^\W\d_]+").findall


def word_scripts(words: list[str]) -> np.ndarray:
    return _SCRIPT_OF[np.searchsorted(_STARTS, [ord(w[0]) for w in words], side="right") - 1]


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of lower-case words: the buckets, and the word of each."""
    text = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    buckets, owners = [], []
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        inside = owner[: len(rolled)] == owner[n - 1 :]
        buckets.append((mix64(rolled[inside] + np.uint64(n)) >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[: len(rolled)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages): log probabilities
    scripts: np.ndarray  # (scripts, languages): candidates

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probabilities of each word's n-grams; languages that its script rules out get a constant far below."""
        buckets, owners = gram_buckets(words)
        out = np.empty((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owners, self.weights[buckets, k], len(words))
        candidates = self.scripts[word_scripts(words)]
        out[~candidates & candidates.any(1, keepdims=True)] = BARRED
        return out


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Counts hashed n-grams and scripts of each language over a bounded sample of (doc_id, text, lang).

    The share of rows to take comes from one count; rows are chosen by a hash of their ids. Each task sends one count
    for each language and bucket that it has met. None without any labelled text.
    """
    rows = train.count()
    if not rows:
        return None
    share = min(1.0, sample_rows / rows)
    chosen = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30)))

    def count(batches):
        import pyarrow as pa

        found: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                words = letter_runs(text.lower())
                if words:
                    c = found.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    c[:BUCKETS] += np.bincount(gram_buckets(words)[0], minlength=BUCKETS)
                    c[BUCKETS:] += np.bincount(word_scripts(words), list(map(len, words)), len(SCRIPTS)).astype(np.int64)
        for lang, c in found.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], names=["lang", "at", "n"])

    counts = chosen.select("text", "lang").mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        return None
    table = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    table[counts["at"].to_numpy(), counts["lang"].map(languages.index).to_numpy()] = counts["n"].to_numpy()
    grams, letters = table[:BUCKETS] + 0.5, table[BUCKETS:]
    return Model(languages, np.log(grams / grams.sum(0)).astype(np.float32), letters >= SCRIPT_SHARE * letters.sum(0))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best path of each text: `scores` has the words of all texts in turn. All texts take each step together.

    Values are kept relative to each step's best, so that they stay small and exact however long a text is.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    falling = lengths[order]
    n, kinds = scores.shape
    came = np.empty((n, kinds), np.int16)
    own = np.arange(kinds)
    value = np.zeros((len(lengths), kinds))
    longest = int(falling[0]) if len(falling) else 0
    live = len(falling) - np.searchsorted(falling[::-1], np.arange(longest), side="right")
    for t in range(longest):
        v, at = value[: live[t]], starts[: live[t]] + t
        v -= v.max(1, keepdims=True)
        came[at] = np.where(v < -switch, v.argmax(1)[:, None], own)
        value[: live[t]] = np.maximum(v, -switch) + scores[at]
    path = np.zeros(n, np.int16)
    now = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        at = starts[: live[t]] + t
        path[at] = now[: live[t]]
        now[: live[t]] = came[at, now[: live[t]]]
    return path


class Reader:
    """Labels texts in a worker; remembers the scores of words that it has met."""

    def __init__(self, model: Model, switch: float):
        self.model, self.switch = model, switch
        self.place: dict[str, int] = {}
        self.scores = np.empty((0, len(model.languages)), np.float32)

    def _scores(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.place})
        if len(self.place) + len(new) > REMEMBERED:
            self.place, self.scores = {}, self.scores[:0]
            new = list({*words})
        if new:
            self.place.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
        return self.scores[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int]]]]:
        """(language, share of the letters in spans of it, spans as (language, words)) of each text."""
        out, waiting, held = [], [], 0
        for at in range(0, len(texts), 256):
            words = [letter_runs((t or "").lower()) for t in texts[at : at + 256]]
            flat = [w for ws in words for w in ws]
            waiting.append((list(map(len, words)), np.fromiter(map(len, flat), np.int64, len(flat)), self._scores(flat)))
            held += len(flat) * len(self.model.languages)
            if held > HELD_SCORES:
                out += self._labels(waiting)
                waiting, held = [], 0
        return out + self._labels(waiting)

    def _labels(self, waiting):
        if not waiting:
            return []
        lengths = np.array([n for ns, _, _ in waiting for n in ns], np.int64)
        letters, scores = (np.concatenate([w[k] for w in waiting]) for k in (1, 2))
        path = viterbi(scores, lengths, self.switch)
        names, kinds = self.model.languages, len(self.model.languages)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        share = np.bincount(owner * kinds + path, letters, len(lengths) * kinds).reshape(-1, kinds)
        total = share.sum(1)
        turn = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        spans: list[list[tuple[str, int]]] = [[] for _ in lengths]
        for a, z in zip(turn, [*turn[1:], len(path)]):
            spans[owner[a]].append((names[path[a]], int(z - a)))
        best = share.argmax(1)
        return [(names[b], float(s[b] / n), sp) if n else (UNKNOWN, 0.0, []) for b, s, n, sp in zip(best, share, total, spans)]


def identify(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """Adds lang_pred, score and lang_spans (array of language and number of words) to every row of `docs`.

    A word is a run of letters, lower-cased. The text's language is the one with most letters in its spans, ties
    going to the first name; the score is its share of the letters. Null texts and texts without a letter, and all
    texts where nothing could be learned, are `und` with score 0. A map over rows: all columns stay but those named
    like the new ones, which are replaced; nothing is shuffled. Repeated rows get equal results, an empty table none.
    Very long texts get the exact path, in memory that grows with their words.
    """
    from pyspark.sql import types as T

    clash = {"lang_pred", "score", "lang_spans"} & {*docs.columns}
    docs = docs.drop(*clash)
    kept = docs.schema.fields
    span = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType())]))
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", span)])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.scripts) if model else None)

    def run(batches):
        import pyarrow as pa

        read = Reader(Model(*shared.value), switch) if shared.value else None
        for b in slices(batches):
            found = read(b.column("text").to_pylist()) if read else [(UNKNOWN, 0.0, [])] * b.num_rows
            spans = pa.array([[{"lang": x, "words": n} for x, n in f[2]] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans],
                names=[*b.schema.names, "lang_pred", "score", "lang_spans"],
            )

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """The rows that may be learned from: text and label present, and not in the held-out fold (crc32 of the id mod 4 is 2)."""
    return docs.filter(F.col("text").isNotNull() & F.col(lang).isNotNull() & (id_bucket("doc_id", 4) != 2)).select("doc_id", "text", F.col(lang).alias("lang"))
