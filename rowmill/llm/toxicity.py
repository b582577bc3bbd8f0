"""A counterfactual-regularised toxicity classifier: logistic regression on the words and word stems of a text.

Training sentences that name a group get a counterfactual in which the name is swapped for another of its group or for
the neutral word of that group; the loss adds the squared change of the score's logit. So what a name alone would
tell is taken from the model, and neutral mentions of a group don't raise scores. Names come from lists, and from the labelled
rows themselves: words that are about as frequent in both classes, with the word most like each by what stands before them.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import dropped, hash_sample, text_of, written

#: Fixed word lists: names of groups in English, German, French and Spanish, the neutral word of each list first.
IDENTITY = (
    ("person", "man", "woman", "boy", "girl", "male", "female", "transgender", "nonbinary"),
    ("people", "men", "women", "boys", "girls", "gays", "lesbians"),
    ("believer", "christian", "muslim", "jew", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("national", "black", "white", "asian", "african", "european", "american", "arab", "latino", "mexican", "chinese", "indian", "turkish"),
    ("someone", "gay", "lesbian", "bisexual", "straight", "queer"),
    ("adult", "old", "young", "elderly", "disabled", "deaf", "blind"),
    ("resident", "immigrant", "refugee", "foreigner", "migrant"),
    ("mensch", "mann", "frau", "junge", "mädchen"),
    ("menschen", "männer", "frauen", "jungen", "schwule", "lesben"),
    ("gläubige", "christen", "muslime", "juden", "hindus", "buddhisten", "katholiken", "atheisten"),
    ("einwohner", "ausländer", "flüchtlinge", "migranten", "einwanderer", "türken", "araber"),
    ("personne", "homme", "femme", "garçon", "fille"),
    ("gens", "hommes", "femmes", "garçons", "filles", "homosexuels", "lesbiennes"),
    ("croyants", "chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "catholiques", "athées"),
    ("habitants", "étrangers", "réfugiés", "migrants", "immigrés", "arabes", "noirs"),
    ("persona", "hombre", "mujer", "chico", "chica"),
    ("gente", "hombres", "mujeres", "chicos", "chicas", "homosexuales", "lesbianas"),
    ("creyentes", "cristianos", "musulmanes", "judíos", "hindúes", "budistas", "católicos", "ateos"),
    ("vecinos", "extranjeros", "refugiados", "migrantes", "inmigrantes", "árabes", "negros"),
)
_GROUP_OF = {word: i for i, words in enumerate(IDENTITY) for word in words}
_WORDS = re.compile(r"[^\W\d_]+")


#: Lengths of stems, and how often one must stand in a text to count, for inflected words.
STEM_LENGTHS, STEM_LEVELS = (5, 6, 7), (1, 2, 3)


def word_counts(text: str | None) -> Counter[str]:
    return Counter(_WORDS.findall((text or "").lower()))


def features_of(counts: Counter[str], stems: frozenset[str] | None = None) -> set[str]:
    """The distinct words of a text, and stem~n for stems that n words or more continue; only the given stems, if any are given.

    Names of groups give no stems, so that a swap changes their word alone.
    """
    found = set(counts)
    stem_counts: Counter[str] = Counter()
    for word, n in counts.items():
        for k in STEM_LENGTHS:
            if len(word) > k and (stems is None or word[:k] in stems) and word not in _GROUP_OF:
                stem_counts[word[:k]] += n
    found.update(f"{stem}~{level}" for stem, n in stem_counts.items() for level in STEM_LEVELS if n >= level)
    return found


def swapped(counts: Counter[str], word: str, other: str | None) -> Counter[str]:
    """The counts of the counterfactual text in which `other` stands wherever `word` stood; None is a name that says nothing, and so no feature."""
    out = counts.copy()
    n = out.pop(word)
    if other is not None:
        out[other] += n
    return out


@dataclass(frozen=True)
class Model:
    """Weights of features and an intercept; a text's logit is the intercept plus the weights of its features.

    swaps: the words that were swapped for each word; pairs: counterfactuals that the penalty saw.
    """

    intercept: float = -10.0
    weights: dict[str, float] = field(default_factory=dict)
    swaps: dict[str, tuple[str, ...]] = field(default_factory=dict)
    pairs: int = 0

    @functools.cached_property
    def stems(self) -> frozenset[str]:
        return frozenset(f.partition("~")[0] for f in self.weights if "~" in f)

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(self.weights[w] for w in self.weights.keys() & features_of(word_counts(text), self.stems))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 5, is 0; a null id too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Objective:
    """Mean log loss + l2 * |w|^2 + counterfactual * mean squared logit change of the pairs (features lost, gained); the last weight is the intercept."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, deltas: list[tuple[np.ndarray, np.ndarray]], n: int, l2: float, counterfactual: float):
        self.at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        self.of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.y, self.n, self.l2, self.counterfactual, self.pairs = y, n, l2, counterfactual, len(deltas)
        if deltas:
            self.pair = np.repeat(np.arange(len(deltas)), [len(a) + len(b) for a, b in deltas]).astype(np.int64)
            self.pair_at = np.concatenate([np.concatenate(x) for x in deltas]).astype(np.int64)
            self.sign = np.concatenate([np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in deltas])

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The objective and its gradient."""
        n, rows = self.n, len(self.y)
        z = np.clip(np.bincount(self.of, weights=w[self.at], minlength=rows) + w[n], -30, 30)
        p = 1 / (1 + np.exp(-z))
        value = float(np.mean(np.logaddexp(0, z) - self.y * z) + self.l2 * (w[:n] ** 2).sum())
        error = (p - self.y) / rows
        g = np.append(np.bincount(self.at, weights=error[self.of], minlength=n) + 2 * self.l2 * w[:n], error.sum())
        if self.pairs:
            change = np.bincount(self.pair, weights=self.sign * w[self.pair_at], minlength=self.pairs)
            value += self.counterfactual * float(np.mean(change**2))
            g[:n] += 2 * self.counterfactual / self.pairs * np.bincount(self.pair_at, weights=self.sign * change[self.pair], minlength=n)
        return value, g


def _descend(objective: Objective, steps: int) -> tuple[np.ndarray, float]:
    """Adam on the whole sample."""
    n, y = objective.n, objective.y
    w = np.zeros(n + 1)
    w[n] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        g = objective(w)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


#: Words before a name that tell its kind, and names looked at, the most frequent.
CONTEXT_WORDS, NAMES = 256, 200


def learnt_swaps(sample: DataFrame, counts: DataFrame, n: int, n_toxic: int, least_share: float = 0.005, most_ratio: float = 2.0, least_cosine: float = 0.5) -> dict[str, str]:
    """Names of the corpus's own, and for each the one most like it.

    Names are words of four letters or more that stand in least_share of the toxic and of the other rows at least, about as often in
    both, so that they say nothing by themselves; two are alike if they follow the same words. The NAMES most
    frequent ones are looked at, by what stands before them among the CONTEXT_WORDS most frequent words: a bounded table.
    """
    share_toxic, share_rest = F.col("hit") / n_toxic, (F.col("has") - F.col("hit")) / (n - n_toxic)
    words = counts.where(~F.contains("word", F.lit("~")))
    even = (share_toxic >= least_share) & (share_rest >= least_share) & (share_toxic <= most_ratio * share_rest) & (share_rest <= most_ratio * share_toxic)
    known = [*_GROUP_OF]
    names = sorted(r["word"] for r in words.where(even & (F.char_length("word") >= 4) & ~F.col("word").isin(known)).orderBy(F.desc("has"), "word").limit(NAMES).collect())
    before = {r["word"]: i for i, r in enumerate(words.orderBy(F.desc("has"), "word").limit(CONTEXT_WORDS).collect())}
    number = {w: i for i, w in enumerate(names)}

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[tuple[int, int]] = Counter()
            for text in batch["text"]:
                words = _WORDS.findall((text or "").lower())
                seen.update((number[b], before[a]) for a, b in zip(words, words[1:]) if b in number and a in before)
            yield pd.DataFrame([(a, b, k) for (a, b), k in seen.items()], columns=["name", "before", "k"])

    table = np.zeros((len(names), len(before)))
    for r in sample.select("text").mapInPandas(contexts, "name int, before int, k long").groupBy("name", "before").agg(F.sum("k").alias("k")).collect():
        table[r["name"], r["before"]] = r["k"]
    if len(names) < 2:
        return {}
    table = np.sqrt(table)  # so that the commonest words before a name don't outweigh the rest
    table /= np.linalg.norm(table, axis=1, keepdims=True) + 1e-12
    alike = table @ table.T - 2 * np.eye(len(names))
    best = alike.argmax(axis=1)
    return {w: names[best[i]] for i, w in enumerate(names) if alike[i, best[i]] >= least_cosine}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, min_chi2: float = 30.0, l2: float = 1e-5, counterfactual: float = 1.0, steps: int = 300, pairs_per_row: int = 8) -> Model:
    """Learns from at most sample_rows labelled rows that are not held out, the first by a hash of their id.

    Words and stems whose presence depends on the label (chi-squared of min_chi2 or more) become features, with the names of groups:
    IDENTITY, and those of learnt_swaps. In each row that has such names, pairs_per_row of them at most (the first by a hash) are
    swapped, one at a time, for others and for a blank, and the features counted again: swaps for others alone would
    leave all names of a group free to rise together. Rows without a label or an id, or of ids that docs lacks, teach
    nothing. Without two classes every text has the same low score.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("label_id")))
    wanted = hash_sample(wanted, sample_rows, "label_id", "toxic")  # bounded, so it may be broadcast

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "words": [sorted(features_of(word_counts(t))) for t in batch["text"]]})

    known = text_of(docs).withColumnRenamed("doc_id", "id").join(F.broadcast(wanted), F.col("id") == F.col("label_id")).select("toxic", "text")
    sample = written(known, "toxic-sample")
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        dropped(sample)
        return Model()
    each = sample.mapInPandas(tokenise, "toxic int, words array<string>").select("toxic", F.explode("words").alias("word"))
    counts = written(each.groupBy("word").agg(F.count("*").alias("has"), F.sum("toxic").alias("hit")).where("has >= 5"), "toxic-words")
    # chi-squared of the 2 x 2 table of word and label
    part = F.col("hit") * (n - n_toxic) - (F.col("has") - F.col("hit")) * n_toxic
    chi2 = n * part.cast("double") * part / (F.lit(float(n_toxic)) * (n - n_toxic) * F.col("has") * (n - F.col("has")))
    chosen = counts.where(F.col("has") < n).where(chi2 >= min_chi2).select("word").collect()
    swaps = {w: (b,) for w, b in learnt_swaps(sample, counts, n, n_toxic).items()}
    for words in IDENTITY:
        for i, w in enumerate(words):
            swaps[w] = tuple({words[0], words[(i + 1) % len(words)]} - {w})
    vocabulary = sorted({r["word"] for r in chosen} | set(swaps) | {x for others in swaps.values() for x in others})
    number = {w: i for i, w in enumerate(vocabulary)}
    stems = frozenset(w.partition("~")[0] for w in vocabulary if "~" in w)

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = lambda features: sorted(number[f] for f in features if f in number)
        for batch in batches:
            out = []
            for text in batch["text"]:
                counts = word_counts(text)
                own = set(numbers(features_of(counts, stems)))
                lost, gained = [], []
                names = sorted((zlib.crc32(f"{w} {len(text or '')}".encode()), w) for w in counts.keys() & swaps.keys())
                for _, word in names[:pairs_per_row]:
                    for other in (None, *swaps[word]):
                        new = set(numbers(features_of(swapped(counts, word, other), stems)))
                        lost.append(sorted(own - new))
                        gained.append(sorted(new - own))
                out.append((sorted(own), lost, gained))
            yield pd.DataFrame(out, columns=["features", "lost", "gained"]).assign(toxic=batch["toxic"].to_numpy())

    rows = sample.mapInPandas(rows_of, "features array<int>, lost array<array<int>>, gained array<array<int>>, toxic int").collect()
    for x in (sample, counts):
        dropped(x)
    ints = lambda x: np.array(x, dtype=np.int64)
    deltas = [(ints(a), ints(b)) for r in rows for a, b in zip(r["lost"], r["gained"]) if a or b]
    objective = Objective([ints(r["features"]) for r in rows], np.array([r["toxic"] for r in rows], dtype=float), deltas, len(vocabulary), l2, counterfactual)
    w, intercept = _descend(objective, steps)
    return Model(intercept, {word: float(x) for word, x in zip(vocabulary, w) if x}, swaps, len(deltas))


def score(model: Model, text: Column) -> Column:
    """Score of a text, 0 to 1; null and empty texts have that of no words."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return texts.map(model.score, na_action=None).astype("float64")

    return scores(text)


def toxicity(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Scores all documents: doc_id, held_out, score, predicted (1 if score >= 0.5).

    The model is fitted by fit(); only the text, the whole of it, goes into a score. Repeated rows are scored each; a null id is held out.
    Other columns are ignored. An empty table gives an empty one, and empty labels a low score for all.
    """
    model = fit(docs, labels, **parameters)
    scored = text_of(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
