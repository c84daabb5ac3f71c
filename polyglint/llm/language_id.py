"""Language identification by word-first backoff.

A known word scores with its log frequency in each language. An unknown word falls back to
its character n-grams (with word boundaries) of the greatest length of which any is known,
4 down to 1. A text's score for a language is the mean over its words; what a language lacks
costs a fixed penalty.

The model is learnt from a bounded sample of labelled rows, drawn by a hash of the id at a
rate per language (``SAMPLE_PER_LANGUAGE`` rows expected). Counting runs in Spark; the most
frequent words and n-grams of each language are kept, so the broadcast model is bounded by
the number of languages times ``WORDS + 4 * GRAMS`` entries. More than ``MAX_LANGUAGES`` labels
are an error: a language that isn't learnt could never be predicted. Costs are held as
(term, language, cost), so the model grows with its entries, not with the square of the languages.

Cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null label
teach nothing; without any labelled row every text is ``und``; a null id is kept (and never
learnt from); repeated rows are scored each; texts are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_sample, materialise, ship

SAMPLE_PER_LANGUAGE, MAX_LANGUAGES = 4_000, 500
WORDS, GRAMS, LONGEST = 20_000, 10_000, 4
#: Cost, in powers of ten, of a word or n-gram that a language doesn't have.
PENALTY = 7.0
UNKNOWN = "und"
#: Costs of words met that a worker keeps.
_CACHE_CELLS = 4_000_000


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def sample_rates(labelled: DataFrame, label: str, per_label: int, most: int) -> dict[str, float]:
    """Sampling rate of each label, of which there are at most ``most``."""
    counts = labelled.groupBy(label).count().orderBy(F.desc("count"), label).limit(most + 1).collect()  # one row a label, bounded
    if len(counts) > most:
        raise ValueError(f"{label} has more than {most} values")
    return {r[0]: min(1.0, per_label / r[1]) for r in counts}


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS) -> dict:
    """The model from (doc_id, text, lang) rows: languages, and per n-gram length (0: words) entries and costs."""
    labelled = labelled.filter("lang is not null and text is not null")
    rates = sample_rates(labelled, "lang", per_language, MAX_LANGUAGES)
    languages = sorted(rates)
    if not languages:
        return {"languages": [], "tables": []}
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, float(rates[k]))])[F.col("lang")]
    drawn = labelled.filter(in_sample("doc_id", rate))
    counted = materialise(drawn.select("lang", F.explode(_letters(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n")), "lang-words")
    tables = [counted.withColumn("size", F.lit(0))]
    padded = F.concat(F.lit("_"), "term", F.lit("_"))
    for size in range(1, LONGEST + 1):
        starts = F.when(F.length(padded) >= size, F.sequence(F.lit(1), F.length(padded) - size + 1))
        pieces = counted.select("lang", "n", F.explode(F.transform(starts, lambda i: F.substring(padded, i, F.lit(size)))).alias("term"))  # noqa: B023
        tables.append(pieces.groupBy("lang", "term").agg(F.sum("n").alias("n")).withColumn("size", F.lit(size)))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    group = Window.partitionBy("size", "lang")
    ranked = every.withColumn("total", F.sum("n").over(group)).withColumn("rank", F.row_number().over(group.orderBy(F.desc("n"), "term")))  # distinct terms of the sample only
    top = ranked.filter(F.col("rank") <= F.when(F.col("size") == 0, words).otherwise(grams))
    model = []
    found = {size: ({}, []) for size in range(LONGEST + 1)}
    column = {k: i for i, k in enumerate(languages)}
    for size, lang, term, cost in top.select("size", "lang", "term", (-F.log10(F.col("n") / F.col("total"))).alias("cost")).toLocalIterator():
        index, rows = found[size]
        at = index.setdefault(term, len(index))
        rows.append((at, column[lang], cost))
    for size in range(LONGEST + 1):
        index, rows = found[size]
        at, lang, cost = (np.array(v) for v in zip(*rows)) if rows else (np.zeros(0),) * 3
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at.astype(np.int64), minlength=len(index)))
        model.append((list(index), np.concatenate(([0], ends)), lang[order].astype(np.int32), np.minimum(cost[order], PENALTY).astype(np.float32)))
    return {"languages": languages, "tables": model}


class Scorer:
    """The model in a worker, with a bounded cache of the costs of words met."""

    def __init__(self, model: dict) -> None:
        import regex

        self.languages = model["languages"]
        self.find = regex.compile(r"\p{L}+").findall
        self.tables = [({t: i for i, t in enumerate(terms)}, *entries) for terms, *entries in model["tables"]]
        self.most = max(1_000, _CACHE_CELLS // max(1, len(self.languages)))
        self.index: dict[str, int] = {}
        self.costs = np.zeros((0, len(self.languages)), np.float32)

    def _sums(self, size: int, at: list[int], owners: np.ndarray, n: int) -> np.ndarray:
        """For each of n owners, per language, the sum of what its terms cost less than the penalty."""
        _, starts, languages, costs = self.tables[size]
        at, width = np.array(at, np.int64), len(self.languages)
        counts = starts[at + 1] - starts[at]
        entries = np.repeat(starts[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        cells = np.repeat(owners, counts) * width + languages[entries]
        return np.bincount(cells, costs[entries] - PENALTY, n * width).reshape(n, width)

    def _learn(self, words: list[str]) -> None:
        """Add the costs of words not met before."""
        known = self.tables[0][0]
        out = np.full((len(words), len(self.languages)), PENALTY, np.float32)
        found = [(k, at) for k, w in enumerate(words) if (at := known.get(w)) is not None]
        if found:
            which, at = zip(*found)
            out[list(which)] += self._sums(0, at, np.arange(len(at)), len(at)).astype(np.float32)
        todo = [k for k, w in enumerate(words) if w not in known]
        for size in range(LONGEST, 0, -1):
            get, rest, at, ends, which = self.tables[size][0].get, [], [], [], []
            for k in todo:
                w = f"_{words[k]}_"
                ids = [i for i in (get(w[j : j + size]) for j in range(len(w) - size + 1)) if i is not None]
                if ids:
                    which.append(k)
                    ends.append(len(at))
                    at += ids
                else:
                    rest.append(k)
            if which:
                n = np.diff([*ends, len(at)])
                out[which] += (self._sums(size, at, np.repeat(np.arange(len(n)), n), len(n)) / n[:, None]).astype(np.float32)
            todo = rest
        if len(self.index) + len(words) > self.most:
            self.index, self.costs = {}, self.costs[:0]
        for w in words:
            self.index[w] = len(self.index)
        self.costs = np.concatenate([self.costs, out])

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for k in range(0, len(texts), 512):  # new words are learnt for many texts at once
            bags = [Counter(self.find(t.lower())) if t else {} for t in texts[k : k + 512]]
            new = [w for w in dict.fromkeys(w for b in bags for w in b) if w not in self.index]
            if self.languages and new:
                before = self.index
                self._learn(new)
                if self.index is not before:  # the cache was emptied
                    self._learn([w for w in dict.fromkeys(w for b in bags for w in b) if w not in self.index])
            out += [self._one(b) for b in bags]
        return out

    def _one(self, bag: dict[str, int]) -> tuple[str, float]:
        if not bag or not self.languages:
            return UNKNOWN, 0.0
        n = np.fromiter(bag.values(), np.float64, len(bag))
        total = n.sum()
        cost = n @ self.costs[np.fromiter(map(self.index.__getitem__, bag), np.int64, len(bag))] / total
        best = int(cost.argmin())
        odds = np.exp((cost[best] - cost) * math.log(10) * min(total, 10.0))
        return self.languages[best], float(1.0 / odds.sum())


def identify(docs: DataFrame, model: dict, text: str = "text", predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language and its probability added as last columns (in place of such columns)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop(predicted, score).withColumns({predicted: F.lit(""), score: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = scorer.score(batch.column(text).to_pylist())
            kept = [n for n in batch.schema.names if n.lower() not in (predicted.lower(), score.lower())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*kept, predicted, score])

    return docs.mapInArrow(run, schema)
