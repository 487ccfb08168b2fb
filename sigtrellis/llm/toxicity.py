"""Toxicity scores: gradient-boosted trees over dense features of whole texts, calibrated isotonically.

Features are densities of a lexicon (fixed seed words and words that the
training labels mark, as whole words or beginnings), the nearness of second-person pronouns to them, capitals,
punctuation, and rates of obfuscation (a lexicon word reached only after
undoing character swaps, doubled letters, separators or spaced-out letters).

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0,
and of these from at most ``sample`` rows, those with the smallest hash of
doc_id. Neither labels, lang, source nor doc_id enter a score.

Null and empty texts have all features 0 and get the score that follows from
them. Without labels of both kinds every score is 0. Repeated label rows of a
document count once, with the largest label; null labels and ids don't count. Of
several texts of one doc_id the greatest is learned from; each row gets the score of
its own text. Empty tables give empty results. Extra columns aren't read, whatever
their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrellis.llm import boosting
from sigtrellis.llm.session import short_batches

#: Labelled training rows used at most, and words the learned lexicon holds at most.
SAMPLE = 12_000
LEXICON = 200
FOLDS = 5
#: Insults of the four languages that any fit knows.
SEED = frozenset(
    "idiot moron stupid scum loser trash worthless pathetic disgusting clown dumb fool bastard jerk bitch asshole "
    "idiote connard salaud ordure imbécile crétin débile abruti "
    "idiota imbécil estúpido basura escoria payaso cabrón "
    "dummkopf arschloch abschaum trottel schwachkopf versager widerlich".split()
)
#: Second-person pronouns of the four languages.
SECOND = frozenset("you your yours yourself u ur tu te toi vous votre vos ton ta tes tú ti usted ustedes vosotros du dich dir dein deine deiner ihr euch euer sie".split())
#: Characters read as the letters they stand for in disguised words.
SWAPS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})
NAMES = ("seed", "learned", "weight", "near_you", "capitals", "shouted", "marks", "exclaims", "runs", "disguised", "spaced", "swaps", "log_words", "hits", "kinds")
#: Lengths of the word beginnings that may enter the learned lexicon beside whole words.
STEMS = (4, 5, 6)
_TOKEN = re.compile(r"[^\W_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_MARK = re.compile(r"[!?.,;:*#$%&@]")
_INNER = re.compile(r"[@$!|+*€]+(?=[^\W\d_])")
_SINGLES = re.compile("1{3,}")
_RUN = re.compile(r"[!?.,*#$%&@]{3,}")
_REPEAT = re.compile(r"(.)\1\1+")


def is_held_out(doc_id):
    """Whether a row is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


class Lexicon(dict):
    """The weight of any word: what the lexicon gives it or its beginning, else 0.

    It is negative for a disguised word, whose weight is found only after undoing
    character swaps or letters repeated three times and more. Remembers a bounded number of words.
    """

    MOST = 200_000

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned = {w: 1.0 for w in SEED} | learned

    def plain(self, word: str) -> float:
        return self.learned.get(word) or max(self.learned.get(f"{word[:k]}*", 0.0) for k in STEMS)

    def disguised(self, word: str) -> float:
        letters = "".join(filter(str.isalpha, word.translate(SWAPS)))
        if letters == word and not _REPEAT.search(word):
            return 0.0
        return self.plain(letters) or self.plain(_REPEAT.sub(r"\1", letters)) or self.plain(_REPEAT.sub(r"\1\1", letters))

    def __missing__(self, word: str) -> float:
        w = self.plain(word) or -self.disguised(word)
        if len(self) >= self.MOST:
            self.clear()
        self[word] = w
        return w

    def __reduce__(self):
        return Lexicon, (self.learned,)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The row of dense features, NAMES in order."""
    if not text:
        return [0.0] * len(NAMES)
    low = text.lower()
    tokens = _TOKEN.findall(low)
    n, size = max(1, len(tokens)), len(text)
    known = {w: v for w in set(tokens) if (v := lexicon[w])}
    near = seed = disguised = swaps = 0
    places = [i for i, w in enumerate(tokens) if w in known] if known else []
    hits, weight = len(places), sum(abs(known[tokens[i]]) for i in places)
    if places:
        seed = sum(tokens[i] in SEED for i in places)
        disguised = sum(known[tokens[i]] < 0 for i in places)
        if you := [i for i, w in enumerate(tokens) if w in SECOND]:
            y, at = np.array(you), np.searchsorted(you, places)
            gap = np.minimum(np.abs(y[np.minimum(at, len(y) - 1)] - places), np.abs(y[np.maximum(at - 1, 0)] - places))
            near = int((gap <= 6).sum())
    for m in _INNER.finditer(low):
        if not m.start() or not low[m.start() - 1].isalpha():
            continue
        swaps += 1
        start, end = max(low.rfind(c, max(0, m.start() - 60), m.start()) for c in " \n\t"), min((x for c in " \n\t" if (x := low.find(c, m.end(), m.end() + 40)) >= 0), default=m.end() + 40)
        if end - start < 60:
            disguised += bool(lexicon.disguised(low[start + 1 : end].strip(".,;:!?\"'()")))
    spaced = ["".join(tokens[m.start() : m.end()]) for m in _SINGLES.finditer("".join(["1" if len(w) == 1 else "0" for w in tokens]))]
    disguised += sum(bool(lexicon.plain(x)) for x in spaced)
    return [
        seed / n, (hits - seed) / n, weight / n, near / n, len(_UPPER.findall(text)) / (sum(map(len, tokens)) or 1), len(_SHOUT.findall(text)) / n,
        len(_MARK.findall(text)) / size, (text.count("!") + text.count("?")) / size, len(_RUN.findall(text)) / n, disguised / n, len(spaced) / n, swaps / n,
        float(np.log1p(len(tokens))), float(hits + disguised), float(len(known)),
    ]


@dataclass
class Model:
    """What the executors need to score; its size is fixed by LEXICON and the number of trees."""

    lexicon: Lexicon
    trees: boosting.Trees | None
    knots: np.ndarray
    levels: np.ndarray

    def score(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(texts))
        x = np.array([features(t, self.lexicon) for t in texts], dtype=float).reshape(len(texts), len(NAMES))
        return np.clip(np.interp(self.trees.raw(x), self.knots, self.levels), 0.0, 1.0)


def _lexicon(rows: DataFrame, positive: int) -> dict[str, float]:
    """Words, and beginnings of words (ending in *), that toxic training rows use 15 times as often as others.

    A row counts a word once; what is kept has to be in 2.5 % of the toxic rows, five at least.
    """
    found = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).where(F.length("word").between(3, 40))
    words = found.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("f"))
    keys = F.array(F.col("word"), *[F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS])
    counts = words.select(F.explode(F.array_compact(keys)).alias("key"), "t", "f").groupBy("key").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    total = words.agg(F.sum("t"), F.sum("f")).first()
    odds = F.log((F.col("t") / (total[0] + 1)) / ((F.col("f") + 3) / (total[1] + 1)))
    kept = counts.where(F.col("t") >= max(5, 0.025 * positive)).select("key", odds.alias("odds")).where(F.col("odds") > float(np.log(15)))
    return {r.key: min(6.0, r.odds) / 4 for r in kept.orderBy(F.desc("odds"), "key").limit(LEXICON).collect()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the sampled training labels whose documents are in docs."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().where(~is_held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers: the size that bounds this broadcast
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # one text of each doc_id, the greatest, so that no more than ``sample`` rows are learned from
    rows = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        seen = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not seen.get(0) or not seen.get(1):
            return Model(Lexicon({}), None, np.zeros(1), np.zeros(1))
        lexicon = Lexicon(_lexicon(rows, seen[1]))

        @F.pandas_udf("array<double>")
        def dense(text: pd.Series) -> pd.Series:
            return pd.Series([features(t, lexicon) for t in text], dtype=object)

        table = rows.select("doc_id", "toxic", dense("text").alias("x")).toPandas()
    finally:
        rows.unpersist()
    table = table.sort_values("doc_id", kind="stable")
    x, y = np.stack(table.x.to_list()).astype(float), table.toxic.to_numpy(dtype=float)
    part = np.arange(len(y)) % 3
    out = np.zeros(len(y))
    for k in range(3):
        mine = part == k
        if y[~mine].min() == y[~mine].max():
            continue
        out[mine] = boosting.fit(x[~mine], y[~mine]).raw(x[mine])
    knots, levels = boosting.isotonic(out, y)
    return Model(lexicon, boosting.fit(x, y), knots, levels)


def scorer(model: Model):
    """A Pandas UDF from text to its score."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(text)), dtype="float64")

    return score


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5) of each row."""
    short_batches(docs.sparkSession)
    model = fit(docs, labels, sample)
    out = docs.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), scorer(model)(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns as they were."""
    short_batches(docs.sparkSession)
    return docs.where(scorer(fit(docs, labels, sample))(F.col("text").cast("string")) < 0.5)
