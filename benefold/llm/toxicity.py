"""Toxicity by a weighted finite-state pattern grammar over clauses.

Every word of a clause has a class: insult, verb of harm, modal, target, negation, report, quote mark or other. Small
transducers (threat, target, negation, quotes, reported speech) rewrite the classes and add weights. Their
composition reads a clause once, and that of two more (targets and reports that come after what they are about) and the insult transducer
reads what it wrote once backwards; what comes out says of each match how it was meant: aimed at somebody, negated, reported or
plain. A document's score is a logistic function of the weights that its clauses collect by meaning.

Insults are a short list and what is learned: word stems whose documents are toxic, chosen one after the other by how many toxic documents
they explain that none before does. Stems that other documents have now and then too, but toxic ones often, are learned besides; they count by how dense they stand
in the text, not by themselves. The logistic weights are learned too. Both use a bounded sample of labelled
rows, ``SAMPLE`` of each label at most (smallest hashes of the id, then of the text), equal texts once; rows held out are never
in it. Everything else covers all rows and whole texts.

Defined results: null and empty texts get the score of a text without matches; a null id is not held out; without
labels nothing is learned and every score is low; labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Labelled rows of each label that the grammar is fitted on, at most.
SAMPLE = 3000
#: Toxic documents of the sample that a stem must add to be learned, and their share of the stem's documents.
LEAST, PURE = 4, 0.97
#: Of a stem that counts by density: words of text for each time it stands there, at most; the share of toxic documents among those that have it so dense; its mark.
SPACING, MOSTLY, WEAK = 150, 0.8, 0.5

# Fixed word lists of the grammar (English, German, French, Spanish).
TARGETS = "you your yours he she they him her them his their du dich dir ihr euch er sie dein tu te toi vous il elle ils ton usted ustedes él ella ellos tus"
NEGATIONS = "not never no nobody nothing without isn aren wasn don doesn didn nicht nie kein keine niemals ohne pas jamais sans aucun nunca jamás sin ningún"
REPORTS = "said says say told wrote writes called calls claimed quoted alleged according sagte schrieb nannte laut dit écrit appelé selon dijo escribió llamó según"
MODALS = "will gonna going shall must should werde wirst wird vais vas va voy vas va"
THREATS = "kill hurt destroy beat burn shoot stab crush punish töten schlagen vernichten tuer frapper détruire matar golpear destruir"
INSULTS = "idiot moron stupid imbecile loser scum trash pathetic worthless disgusting dumbass bastard dummkopf trottel abschaum arschloch connard salaud abruti idiota imbécil estúpido escoria basura"
CLASSES = {w: c for c, words in (("modal", MODALS), ("harm", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("quote", "\" “ ” « »")) for w in words.split()}
MEANINGS = ("insult", "insult@target", "insult@negated", "insult@reported", "threat", "threat@negated", "threat@reported")
_WORD = re.compile(r"[^\W\d_]+|[\"“”«»]")
_BREAK = re.compile(r"[.!?;\n|]")


class Transducer:
    """arcs: (state, symbol) -> (state, symbol written, weight); a symbol without an arc is copied by ``other``."""

    def __init__(self, start, arcs: dict, other):
        self.start, self.arcs, self.other = start, arcs, other

    def step(self, state, symbol):
        return self.arcs[state, symbol] if (state, symbol) in self.arcs else (self.other(state), symbol, 0.0)

    def then(self, after: Transducer) -> Transducer:
        """Composition: what this one writes the other reads; states are pairs, arcs are made when first used."""
        made = _Composed((self.start, after.start), {}, None)
        made.parts = (self, after)
        return made


class _Composed(Transducer):
    def step(self, state, symbol):
        if (state, symbol) not in self.arcs:
            a, written, w1 = self.parts[0].step(state[0], symbol)
            b, written, w2 = self.parts[1].step(state[1], written)
            self.arcs[state, symbol] = (a, b), written, w1 + w2
        return self.arcs[state, symbol]


def _fading(opens: str, reach: int, rewrite: dict[str, tuple[str, float]]) -> Transducer:
    """After a word of class ``opens`` the next ``reach`` words are in its scope, where symbols are rewritten."""
    arcs = {(k, opens): (reach, opens, 0.0) for k in range(reach + 1)}
    for k in range(1, reach + 1):
        arcs |= {(k, a): (k - 1, b, w) for a, (b, w) in rewrite.items()}
    return Transducer(0, arcs, lambda k: max(0, k - 1))


_TOLD = {"insult": ("insult@reported", -0.5), "insult@target": ("insult@reported", -0.5), "threat!": ("threat@reported", -0.5)}


def parts() -> tuple[list[Transducer], list[Transducer]]:
    """The transducers that read a clause, and those that read it backwards, each in order."""
    threat = _fading("modal", 3, {"harm": ("threat!", 1.0)})
    target = _fading("target", 6, {"insult": ("insult@target", 0.5)})
    negated = {"insult": "insult@negated", "insult@target": "insult@negated", "threat!": "threat@negated"}
    negation = _fading("negation", 2, {a: (b, -0.5) for a, b in negated.items()})
    quotes = Transducer(0, {(0, "quote"): (1, "quote", 0.0), (1, "quote"): (0, "quote", 0.0)} | {(1, a): (1, b, w) for a, (b, w) in _TOLD.items()}, lambda k: k)
    report = _fading("report", 8, _TOLD)
    final = {(0, m): (0, m, 1.0) for m in MEANINGS} | {(0, "threat!"): (0, "threat", 1.0)}
    back = [_fading("target", 3, {"insult": ("insult@target", 0.5)}), _fading("report", 4, _TOLD), Transducer(0, final, lambda k: k)]
    return [threat, target, negation, quotes, report], back


def grammar() -> tuple[Transducer, Transducer]:
    """The two compositions."""
    return tuple(functools.reduce(lambda a, b: a.then(b), x) for x in parts())


def read(machine: Transducer, symbols: list[str]) -> tuple[list[str], list[float]]:
    """What a machine writes, and the weights that it adds."""
    state, out, weights = machine.start, [], []
    for symbol in symbols:
        state, written, w = machine.step(state, symbol)
        out.append(written)
        weights.append(w)
    return out, weights


class Scorer:
    """Weights by meaning of a text's matched clauses: added up, and for dense stems in relation to the text's length."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        words = sorted([*stems, *(f"{w}" for w in THREATS.split())], key=len, reverse=True)
        self.find = re.compile("|".join(map(re.escape, words)))
        self.sizes = sorted({len(s) for s in stems}, reverse=True)
        self.forth, self.back = grammar()

    def _stem(self, word: str) -> float:
        return max((self.stems[word[:k]] for k in self.sizes if word[:k] in self.stems), default=0.0)

    def features(self, text: str | None) -> list[float]:
        found, dense = dict.fromkeys(MEANINGS, 0.0), dict.fromkeys(MEANINGS, 0.0)
        text = (text or "").lower()
        at = begin = read_to = 0
        while (m := self.find.search(text, at)) is not None:
            i = m.start()
            at = m.end()
            if i and (text[i - 1].isalpha()):
                continue  # inside of a word
            for b in _BREAK.finditer(text, read_to, i):
                begin = b.end()
            read_to = i
            b = _BREAK.search(text, i)
            at = b.start() if b else len(text)
            words = _WORD.findall(text, begin, at)
            stems = [self._stem(word) for word in words]
            once, w1 = read(self.forth, ["insult" if stem else CLASSES.get(word, "other") for word, stem in zip(words, stems, strict=True)])
            twice, w2 = read(self.back, once[::-1])
            for out, x, y, stem in zip(twice[::-1], w1, w2[::-1], stems, strict=True):
                if out in found:
                    (dense if stem == WEAK else found)[out] += max(x + y, 0.25)
        share = 1000 / (text.count(" ") + 50)
        return [np.log1p(found[m]) for m in MEANINGS] + [np.log1p(share * dense[m]) for m in MEANINGS]


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(_id, _text, _toxic) of the bounded sample."""
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    rows = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (held != 0)).select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    rows = [rows.where(f"_toxic = {k}").orderBy(F.xxhash64("_id"), "_id").limit(sample) for k in (0, 1)]
    rows = F.broadcast(rows[0].union(rows[1]).groupBy("_id").agg(F.max("_toxic").alias("_toxic")))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(rows, "_id")
    found = found.groupBy(F.xxhash64("_text").alias("h"), F.md5("_text").alias("m")).agg(F.min("_id").alias("_id"), F.max("_toxic").alias("_toxic"), F.first("_text").alias("_text"))
    found = [found.where(f"_toxic = {k}").orderBy(F.xxhash64("_id"), "_id", "h", "m").limit(sample).drop("h", "m") for k in (0, 1)]  # an id may have many texts
    return found[0].union(found[1])


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems with weights (``WEAK``: by density), from a bounded sample (_id, _toxic, _text)."""
    found = F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}{4,40}"), 0)
    size = F.size(F.regexp_extract_all("_text", F.lit(r"\S+"), 0))
    words = sample.select("_id", "_toxic", size.alias("size"), found.alias("w")).withColumn("w", F.explode("w")).groupBy("_id", "_toxic", "size", "w").agg(F.count("*").alias("n"))
    stems = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(4), F.lit(8)), lambda k: F.substring("w", F.lit(1), k)), F.array("w")))
    seen = words.select("_id", "_toxic", "size", "n", F.explode(stems).alias("s")).groupBy("_id", "_toxic", "size", "s").agg(F.sum("n").alias("n"))
    seen = seen.select("_id", "_toxic", "s", (F.col("n") * SPACING >= F.col("size")).alias("dense"))
    toxic = F.col("_toxic") == 1
    counts = seen.groupBy("s").agg(F.count_if(toxic).alias("t"), F.count("*").alias("n"), F.count_if(toxic & F.col("dense")).alias("td"), F.count_if("dense").alias("nd"))
    pure, mostly = (F.col("t") >= LEAST) & (F.col("t") >= PURE * F.col("n")), (F.col("td") >= LEAST) & (F.col("td") >= MOSTLY * F.col("nd"))
    counts = counts.where(pure | mostly).select("s", pure.alias("pure"), mostly.alias("mostly"), (F.col("nd") - F.col("td")).alias("others"))
    ids = F.collect_list("_id").alias("ids"), F.collect_list(F.when(F.col("dense"), F.col("_id"))).alias("dense")
    rows = seen.where(toxic).join(counts, "s").groupBy("s", "pure", "mostly", "others").agg(*ids).collect()  # stems of the sample's toxic rows
    others = {r["s"]: r["others"] for r in rows}
    chosen, explained = dict.fromkeys(INSULTS.split(), 1.0), set()
    for weight, left in ((1.0, {r["s"]: set(r["ids"]) for r in rows if r["pure"]}), (WEAK, {r["s"]: set(r["dense"]) for r in rows if r["mostly"]})):
        left = {s: rest for s, ids in left.items() if len(rest := ids - explained) >= LEAST}
        while left:
            best = max(left, key=lambda s: (len(left[s]) - (others[s] if weight == WEAK else 0), len(s), s))
            gain = left.pop(best)
            chosen.setdefault(best, weight)
            explained |= gain
            left = {s: rest for s, ids in left.items() if len(rest := ids - gain) >= LEAST}
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights with the intercept last, by Newton's method; both labels weigh the same in all."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(y) or not 0 < y.sum() < len(y):
        w[-1] = -2.0
        return w
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
    """(stems, logistic weights) from the bounded sample of labelled rows that aren't held out."""
    from .common import stored

    rows = stored(_labelled(docs, labels, id_col, text_col, sample))
    stems = learn_stems(rows)
    cells = rows.select("_toxic", _features(stems)("_text").alias("f")).collect()  # SAMPLE rows of each label at most
    x = np.array([r["f"] for r in cells]).reshape(-1, 2 * len(MEANINGS))
    return stems, _logistic(x, np.array([r["_toxic"] for r in cells], float))


@functools.lru_cache(4)
def _scorer(stems: tuple[tuple[str, float], ...]) -> Scorer:
    """A worker's scorer, made once and kept for all its batches."""
    return Scorer(dict(stems))


def _features(stems: dict[str, float]):
    known = tuple(sorted(stems.items()))

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        scorer = _scorer(known)
        return texts.map(scorer.features)

    return run


def score(model, text_col: str = "text"):
    """Column: the score of ``text_col``, 0 to 1."""
    stems, weights = model
    known = tuple(sorted(stems.items()))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        scorer = _scorer(known)
        x = np.array([scorer.features(t) for t in texts]).reshape(-1, 2 * len(MEANINGS))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

    return run(text_col)


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), score(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
