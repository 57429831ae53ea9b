"""Toxicity by a weighted finite-state pattern grammar.

A word transducer maps each word to a class (insult, threat, target, negation, report, ...) and a weight: seed lists
plus whole words and stems learned from labelled training rows. Three class transducers -- negation scope, reported
speech, target reach -- rewrite that stream and are composed once into one deterministic machine. A clause (text up to
a sentence mark or line end) is scored by its accepting path, so "you idiot" weighs more than an insult alone, and a
negated or quoted one less. A logistic layer turns the clause scores of a document, and the weight that each class of the
machine's output got, into a probability: so the layer learns from the labels what an aimed, a negated, a quoted or a bare
insult is worth.

Training uses a bounded hash sample of at most about ``SAMPLE_ROWS`` labelled rows (documented bound). The layer is fitted
out of fold: each half of the sample is read with the lexicon learned on the other half, so no row is seen with arcs that
it gave itself, and all rows count; the lexicon of the model is learned on both. A learned arc needs several different left neighbours among toxic texts: copies of one toxic text do not make
its ordinary words insults. Every text is scored whole, in one pass without a shuffle.

Defined cases: null and empty texts have no clause and get the score of a text without matches; very long texts are read
whole; rows with a null id are not held out and are not trained on; rows that repeat an id are trained on and scored each;
without labels only the seed grammar scores; an empty table gives an empty result; arcs of equal strength stay in
code-point order up to the model's size (``MAX_ARCS``); further columns of the input, whatever their names, are neither
read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc32_mod, documents, table

# Seed words of the classes.
SEEDS = {
    "insult": "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumb jerk scumbag "
              "fool vermin filth idiota imbécil estúpido basura idiot imbécile crétin abruti dummkopf trottel abschaum",
    "threat": "kill hurt destroy murder stab shoot beat burn hang die matar morir tuer mourir töten sterben",
    "target": "you your yours youre he she they them these those him her people tu vous te usted ustedes du dich sie ihr",
    "negation": "not never no nobody isnt arent wasnt dont doesnt didnt without nunca jamás jamais nicht nie kein keine",
    "report": "said says wrote writes quoted claimed called replied told reported dijo escribió dit écrit sagte schrieb",
}
SEED_WEIGHT = {"insult": 2.0, "threat": 1.0, "target": 0.0, "negation": 0.0, "report": 0.0}
SAMPLE_ROWS = 20_000     # bound of the labelled rows that training reads
STEMS = (4, 5, 6)        # lengths of learned stems
MIN_CONTEXTS = 3         # different left neighbours that a learned arc needs among toxic texts
MIN_LOG_ODDS = 3.0
MAX_ARCS = 20_000        # size of the learned lexicon (the strongest arcs stay)
NEGATION_REACH, TARGET_REACH = 3, 4
_TOKEN = re.compile(r"\w+|[.!?;\n\"“”«»]")
_END, _QUOTE = frozenset(".!?;\n"), frozenset("\"“”«»")

#: Weight factors of the classes that the composed machine puts out.
FACTOR = {"insult": 1.0, "threat": 0.5, "aimed insult": 1.5, "aimed threat": 2.0, "negated": 0.25, "quoted": 0.5}


class Transducer:
    """Deterministic class transducer: ``step(state, symbol) -> (state, symbol out)``; ``start`` holds for a clause."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: what this one puts out is read by ``other``."""
        def step(state, symbol):
            a, mid = self.step(state[0], symbol)
            b, out = other.step(state[1], mid)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols) -> dict:
        """All reachable transitions as ``{(state, symbol): (state, out)}`` with states numbered from 0."""
        number, todo, out = {self.start: 0}, [self.start], {}
        while todo:
            state = todo.pop()
            for s in symbols:
                to, put = self.step(state, s)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                out[number[state], s] = number[to], put
        return out


def _negation(left, s):
    if s == "negation":
        return NEGATION_REACH, s
    return max(0, left - 1), "negated" if left and s in ("insult", "threat") else s


def _report(state, s):
    told, quoted = state
    if s == "quote":
        return (told, not quoted), s
    if s == "report":
        return (True, quoted), s
    return state, "quoted" if s in ("insult", "threat") and (told or quoted) else s


def _target(left, s):
    if s == "target":
        return TARGET_REACH, s
    return max(0, left - 1), f"aimed {s}" if left and s in ("insult", "threat") else s


SYMBOLS = ("word", "quote", *SEEDS)
MACHINE = Transducer(0, _negation).then(Transducer((False, False), _report)).then(Transducer(0, _target)).table(SYMBOLS)

Lexicon = dict[str, tuple[str, float]]


def seed_lexicon() -> Lexicon:
    return {w: (kind, SEED_WEIGHT[kind]) for kind, words in SEEDS.items() for w in words.split()}


def arc_of(word: str, lexicon: Lexicon) -> tuple[str, float] | None:
    """Class and weight of a word: its own arc, else that of its longest known stem (stems are kept as ``stem*``)."""
    got = lexicon.get(word)
    if got is None:
        for k in sorted(STEMS, reverse=True):
            if len(word) > k and (got := lexicon.get(word[:k] + "*")):
                break
    return got


def read_clauses(text: str | None, lexicon: Lexicon, arcs: dict) -> tuple[list[float], int, dict[str, float]]:
    """Scores of the matched clauses, the number of clauses, and the weight that each output class got.

    ``arcs`` remembers the arcs of words met before.
    """
    scores, clauses, state, total, open_ = [], 0, 0, 0.0, False
    sums = dict.fromkeys(FACTOR, 0.0)
    for token in _TOKEN.findall((text or "").lower()):
        if token in _END:
            clauses += open_
            if total > 0:
                scores.append(total)
            state, total, open_ = 0, 0.0, False
            continue
        open_ = True
        if token in arcs:
            arc = arcs[token]
        else:
            arc = arcs[token] = ("quote", 0.0) if token in _QUOTE else arc_of(token, lexicon)
        if arc is None:
            if state:
                state = MACHINE[state, "word"][0]
            continue
        state, out = MACHINE[state, arc[0]]
        if out in FACTOR:
            total += FACTOR[out] * arc[1]
            sums[out] += arc[1]
    if total > 0:
        scores.append(total)
    return scores, clauses + open_, sums


def clause_scores(text: str | None, lexicon: Lexicon, arcs: dict) -> tuple[list[float], int]:
    return read_clauses(text, lexicon, arcs)[:2]


def features(text: str | None, lexicon: Lexicon, arcs: dict) -> list[float]:
    scores, clauses, sums = read_clauses(text, lexicon, arcs)
    return [np.log1p(sum(scores)), max(scores, default=0.0), np.log1p(len(scores)), len(scores) / max(1, clauses),
            *[np.log1p(s) for s in sums.values()]]


FEATURES = 4 + len(FACTOR)


def _featurizer(spark: SparkSession, lexicon: Lexicon, layer):
    held = spark.sparkContext.broadcast((lexicon, layer))

    @F.pandas_udf("f array<double>, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, weights = held.value
        arcs: dict = {}
        for texts in parts:
            rows = []
            for t in texts:
                if len(arcs) > 500_000:
                    arcs.clear()
                rows.append(features(t, words, arcs))
            score = _layer(np.array(rows).reshape(-1, FEATURES), weights) if weights is not None else np.zeros(len(rows))
            yield pd.DataFrame({"f": rows, "score": score})

    return lambda col: run(col.cast("string"))


def _layer(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[1:] + weights[0], -30, 30)))


def fit_layer(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; without both classes a fixed layer around one plain insult."""
    if len(set(y.tolist())) < 2:
        return np.array([-3.0, 3.0, *[0.0] * (FEATURES - 1)])
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learned_lexicons(rows: DataFrame, scratch: Scratch) -> tuple[Lexicon, Lexicon, Lexicon]:
    """Insult arcs from ``rows(text, toxic, half)``: words and stems much likelier in toxic texts, by distinct contexts.

    One aggregate gives three lexicons: of the rows of half 0, of half 1, and of all. What a word in a context was seen in
    (half and label) is four bits of one number.
    """
    word = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+|[.!?;\n]"), 0)
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(4)]), 2 * F.col("half") + 2 - F.col("toxic"))
    seen = (rows.select(bit.alias("m"), word.alias("w"))
            .select("m", F.explode(F.arrays_zip(F.col("w").alias("t"), F.concat(F.array(F.lit("")), F.col("w")).alias("c"))).alias("x"))
            .where("x.t is not null").groupBy(F.col("x.t").alias("t"), F.xxhash64("x.c").alias("c")).agg(F.bit_or("m").alias("m")))
    arcs = F.array(F.col("t"), *[F.when(F.length("t") > k, F.concat(F.substring("t", 1, k), F.lit("*"))) for k in STEMS])
    pairs = (seen.select(F.explode(arcs).alias("arc"), "c", "m").where("arc is not null")
             .groupBy("arc", "c").agg(F.bit_or("m").alias("m")))
    has = lambda bits: F.count_if(F.col("m").bitwiseAND(F.lit(bits)) > 0)
    sums = pairs.groupBy("arc").agg(*[has(bits).alias(name) for name, bits in
                                      (("a0", 1), ("b0", 2), ("a1", 4), ("b1", 8), ("a2", 5), ("b2", 10))])
    sums = scratch.save(sums.where(F.col("a2") >= MIN_CONTEXTS), "arcs", narrow=True)
    counts = {r["half"]: (r["t"], r["n"]) for r in rows.groupBy("half").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    out = []
    for which in (0, 1, 2):
        own = [v for half, v in counts.items() if which in (half, 2)]
        bad, good = sum(t for t, _ in own) + 1.0, sum(n - t for t, n in own) + 1.0
        a, b = F.col(f"a{which}"), F.col(f"b{which}")
        odds = F.log((a + 0.5) / bad) - F.log((b + 0.5) / good)
        found = (sums.where(a >= MIN_CONTEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
                 .orderBy(F.desc(F.col("odds") * F.sqrt(a)), "arc").limit(MAX_ARCS).collect())
        out.append({r["arc"]: ("insult", min(6.0, r["odds"])) for r in found if re.match(r"\w", r["arc"])})
    return tuple(out)


def learned_lexicon(rows: DataFrame) -> Lexicon:
    """The lexicon of all of ``rows(text, toxic)``."""
    return learned_lexicons(rows.withColumn("half", F.lit(0)), Scratch(rows.sparkSession, "lexicon"))[2]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and logistic layer from training rows (``crc32(doc_id as text) mod 5`` not 0)."""
    marked = (labels.where("toxic is not null and doc_id is not null").where(crc32_mod(F.col("doc_id"), 5) != 0)
              .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    share = min(1.0, sample_rows / max(1, marked.count()))
    at = F.pmod(F.xxhash64("doc_id", F.lit("toxic sample")), F.lit(1_000_000)) / 1_000_000
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(marked.where(at < share), "marked", narrow=True)      # about sample_rows rows of two numbers
    rows = (docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("layer")), F.lit(2)).cast("int")
    rows = scratch.save(rows.select("text", "toxic", half.alias("half")), "sample")      # read four times
    lexicons = learned_lexicons(rows, scratch)
    seen = []
    for own in (0, 1):
        feature = _featurizer(docs.sparkSession, seed_lexicon() | lexicons[1 - own], None)
        seen.append(rows.where(F.col("half") == own).select("toxic", feature(F.col("text"))["f"].alias("f")).toPandas())
    got = pd.concat(seen)
    x = np.array(got["f"].tolist(), float).reshape(-1, FEATURES)
    return seed_lexicon() | lexicons[2], fit_layer(x, got["toxic"].to_numpy(float))


def score_toxicity(docs: DataFrame, model: tuple[Lexicon, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    score = _featurizer(docs.sparkSession, *model)(F.col("text"))["score"]
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return (docs.select("doc_id", held_out.alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
