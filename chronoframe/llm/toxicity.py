"""Toxicity scoring with a weighted finite-state pattern grammar.

Words are mapped to symbols: insult, threat, target, negation, reported speech, intent, other. Five small transducers
read the symbols of a clause from its start and write marks for each word: an insult (INSULT), a threat, bare or with an
intent before it (THREAT), within reach of a negation (NEGATION), under a verb of reporting (REPORTED), after a target
(TARGET). They are composed into one machine; a target that follows a match is read from the machine's state at the end
of the clause. Each path through a clause that ends in an insult or a threat has a weight, fitted on labelled rows; a
document's score is a logistic function of the weights of its clauses' paths. Clauses are read whole, in one pass, however long.

The insults are learned as word stems from labelled rows by greedy cover: the stem that explains most toxic rows
not explained yet and next to no clean ones comes first, so words that merely stand beside insults, or in copies
of one toxic text, are not taken. The weights are fitted on the same rows, leaning on fixed defaults.
Fitting uses at most MAX_ROWS labelled rows, drawn by a hash of doc_id; every document is scored.

Defined results: null and empty texts match nothing and get the score of a document without matches; a doc_id with
several labels counts each; of rows that repeat a doc_id the largest text is learned from; labels other than 0 and 1
are ignored; without labelled rows the seed words and default weights hold; every row gives one row; a column named
toxicity or n_matches is replaced by score_toxicity and kept by drop_toxic; other extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, sliced, table

#: Labelled rows the classifier is fitted on.
MAX_ROWS = 20_000
#: Seed words per symbol, whole words in four languages.
INSULTS = "idiot idiots moron morons imbecile scumbag bastard asshole stupid dumbass trottel arschloch dummkopf connard imbécile abruti estúpido imbécil gilipollas".split()
THREATS = "kill murder strangle töten umbringen tuer égorger matar matarte".split()
TARGETS = "you your yours you're he she they them his her their du dich dein ihr euch sie tu toi ton vous votre il elle ils tú usted ustedes te él ella ellos".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie pas jamais ne sin nunca jamás".split()
REPORTS = "said says wrote called reported claimed quoted according sagte schrieb nannte laut dit écrit selon appelé dijo escribió llamó según".split()
INTENTS = "will 'll i'll we'll gonna going want should must let's werde werden will soll vais va vas allons voy vamos quiero debe".split()
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_ENDS = ".!?;:\n\r"
CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")
STEM_SIZES = range(3, 9)
#: A mark lasts so many words after a negation.
REACH = 3

# a transducer: start state, and step(state, symbol) -> (state, mark written for this word)
INSULT = (0, lambda s, x: (0, int(x == "I")))
THREAT = (0, lambda s, x: (REACH, 0) if x == "W" else (max(0, s - 1), 0 if x != "H" else 2 if s > 0 else 1))
NEGATION = (0, lambda s, x: (REACH, 0) if x == "N" else (max(0, s - 1), int(s > 0)))
REPORTED = (0, lambda s, x: (1, 0) if x == "R" else (s, s))
TARGET = (0, lambda s, x: (1, 1) if x == "T" else (s, s))


def compose(*machines) -> tuple[dict, tuple]:
    """One machine that steps all of them: (states, symbol) -> (states, marks), as a table of the states that can be reached."""
    start = tuple(m[0] for m in machines)
    steps, todo = {}, [start]
    while todo:
        now = todo.pop()
        for symbol in "ITHNRWO":
            if (now, symbol) not in steps:
                moved = [m[1](s, symbol) for m, s in zip(machines, now, strict=True)]
                steps[now, symbol] = tuple(s for s, _ in moved), tuple(o for _, o in moved)
                todo.append(steps[now, symbol][0])
    return steps, start


GRAMMAR, START = compose(INSULT, THREAT, NEGATION, REPORTED, TARGET)
#: Paths: what is matched (insult, threat, intended threat), negated, reported, target (none, before, after); and the
#: default weight of each.
PATTERNS = list(product("IHW", (0, 1), (0, 1), (0, 1, 2)))
BIAS, DEFAULTS = -4.0, [{"I": 6.0, "H": 4.0, "W": 4.5}[k] - 2.0 * neg - 1.5 * rep + 0.5 * (aim > 0) for k, neg, rep, aim in PATTERNS]
_INDEX = {p: i for i, p in enumerate(PATTERNS)}


def stems(word: str) -> list[str]:
    """Features of a word: its prefixes, and itself (marked by an end sign)."""
    return [word[:k] for k in STEM_SIZES if len(word) >= k] + [word + "$"]


class Matcher:
    """Finds the words of a lexicon of stems and whole words in a text, and the patterns of their clauses."""

    def __init__(self, insults: list[str]):
        self.kind = dict.fromkeys((w + "$" for w in THREATS), "H") | dict.fromkeys(insults, "I")
        self.machine = ahocorasick.Automaton()
        for s in self.kind:
            self.machine.add_word(s.rstrip("$"), s.rstrip("$"))
        self.machine.make_automaton()
        self.symbols = {w: s for s, ws in (("W", INTENTS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in ws}

    def symbol(self, word: str) -> str:
        if (k := self.kind.get(word + "$")) or (k := next((self.kind[word[:n]] for n in STEM_SIZES if word[:n] in self.kind and len(word) >= n), None)):
            return k
        return self.symbols.get(word) or self.symbols.get(word.replace("’", "'"), "O")

    def clause(self, words: list[str], found: list[int]) -> None:
        """Runs the composed machine over a clause and counts its paths."""
        state, waiting = START, []
        for w in words:
            state, (insult, threat, neg, rep, aim) = GRAMMAR[state, self.symbol(w)]
            if insult or threat:
                kind = "I" if insult else "HW"[threat - 1]
                if aim:
                    found[_INDEX[kind, neg, rep, 1]] += 1
                else:
                    waiting.append((kind, neg, rep))
        aimed = 2 * state[-1]  # the state of TARGET: one came after the matches that wait
        for kind, neg, rep in waiting:
            found[_INDEX[kind, neg, rep, aimed]] += 1

    def counts(self, text: str) -> list[int]:
        """How often each path is taken."""
        found, text, read = [0] * len(PATTERNS), text.lower(), 0
        for end, s in self.machine.iter(text):
            start = end - len(s) + 1
            if start < read or start and text[start - 1].isalpha():
                continue
            # the clause around the match; clauses up to `read` are done
            left = read
            for k in range(start - 1, read - 1, -1):
                if text[k] in CLAUSE_ENDS:
                    left = k + 1
                    break
            m = CLAUSE_END.search(text, end + 1)
            read = m.end() if m else len(text)
            self.clause(WORD.findall(text, left, read), found)
        return found


def _labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    rows = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").distinct()
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    # max_rows ids of 8 bytes: small enough to send to every executor; and one text for each of them
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    return saved(found.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")


def learn_stems(rows: DataFrame, cover: int = 3) -> list[str]:
    """Stems that explain the toxic rows, from rows of (text, toxic)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column("text").to_pylist():
                words = WORD.findall(text.lower())
                # near copies of a text mostly share its least shingle: they count once
                keys.append(min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1)
            yield batch.append_column("row", pa.array(keys, pa.int64()))

    def own(text: str) -> set[str]:
        return {s for w in set(WORD.findall(text.lower())) for s in stems(w)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 200):
                pos, neg = Counter(), Counter()
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    (pos if toxic else neg).update(own(text))
                names = list(pos | neg)
                yield pa.RecordBatch.from_pydict({"stem": pa.array(names, pa.string()), "pos": pa.array([pos[x] for x in names], pa.int64()), "neg": pa.array([neg[x] for x in names], pa.int64())})

    rows = saved(rows.mapInArrow(keyed, "text string, toxic int, row long").dropDuplicates(["row", "toxic"]), "keyed")
    counts = rows.mapInArrow(count, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n_pos = rows.where("toxic = 1").count()
    least = max(3, int(0.004 * n_pos))
    # stems that many of at most MAX_ROWS rows share
    neg = {r.stem: r.neg for r in counts.where((F.col("pos") >= least) & (F.col("neg") <= 0.02 * F.col("pos"))).collect()}

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 200):
                found = [(s, r) for text, r in zip(part.column("text").to_pylist(), part.column("row").to_pylist(), strict=True) for s in own(text) if s in neg]
                yield pa.RecordBatch.from_pydict({"stem": pa.array([f[0] for f in found], pa.string()), "row": pa.array([f[1] for f in found], pa.int64())})

    pairs = rows.where("toxic = 1").mapInArrow(used, "stem string, row long").toPandas()
    docs = {s: set(g) for s, g in pairs.groupby("stem")["row"]}
    need, chosen = Counter(dict.fromkeys(pairs.row.unique(), cover)), []
    least = max(3, int(0.01 * len(need)))
    gain = {s: len(d) for s, d in docs.items()}
    while gain:
        best = max(gain, key=lambda s: (gain[s] - 10 * int(neg[s]), len(s), s))
        fresh = sum(need[r] > 0 for r in docs[best])
        if fresh < gain[best]:  # its gain is out of date
            gain[best] = fresh
            if fresh < least:
                del gain[best]
            continue
        if fresh < least or fresh <= 10 * neg[best]:
            break
        chosen.append(best)
        del gain[best]
        for r in docs[best]:
            need[r] -= 1
        word = best.rstrip("$")  # longer and shorter forms of the same word add nothing
        gain = {s: g for s, g in gain.items() if not (s.rstrip("$").startswith(word) or word.startswith(s.rstrip("$")))}
    return sorted(chosen)


def _strength(counts: np.ndarray) -> np.ndarray:
    return np.log2(1 + counts)


def fit(counts: np.ndarray, toxic: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Bias and pattern weights: logistic regression that leans on the defaults, by Newton's method."""
    mean = np.array([BIAS, *DEFAULTS])
    w, x = mean.copy(), np.column_stack([np.ones(len(counts)), _strength(counts)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.5 * np.eye(len(w)), x.T @ (p - toxic) + 0.5 * (w - mean))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """The lexicon of insults and the weights (bias first), from labelled documents."""
    rows = _labelled(docs, labels, max_rows)
    lexicon = [w + "$" for w in INSULTS] + learn_stems(rows)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matcher.counts(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32())), batch.column("toxic")], names=["counts", "toxic"])

    # at most max_rows rows, and as counted patterns only a few hundred different ones
    got = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(match, "counts array<int>, toxic int").groupBy("counts", "toxic").count().collect()
    counts = np.array([r["counts"] for r in got for _ in range(r["count"])], float).reshape(-1, len(PATTERNS))
    return lexicon, fit(counts, np.array([r["toxic"] for r in got for _ in range(r["count"])], float))


def _scores(matcher: Matcher, batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([matcher.counts(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, len(PATTERNS))
    return 1 / (1 + np.exp(-(weights[0] + _strength(counts) @ weights[1:]))), counts.sum(axis=1).astype(np.int64)


def score_toxicity(docs: DataFrame, lexicon: list[str], weights: np.ndarray) -> DataFrame:
    """docs with toxicity (0 to 1) and n_matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            score, n = _scores(matcher, batch, weights)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(n)], names=[*batch.schema.names, "toxicity", "n_matches"])

    docs = docs.drop("toxicity", "n_matches")
    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", toxicity double, n_matches long")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def trained_on(spark: SparkSession, sf_dir: str) -> tuple[list[str], np.ndarray]:
    labels = table(spark, sf_dir, "labels")
    return train(table(spark, sf_dir, "documents"), labels.where(~held_out(F.col("doc_id"))))


def drop_toxic(docs: DataFrame, lexicon: list[str], weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with their own columns only, whose text scores below threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield batch.filter(pa.array(_scores(matcher, batch, weights)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), *trained_on(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), "n_matches")
