"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon (whole words, and stems that stand for all words beginning with them) is learned from
a bounded sample of labelled rows: terms that toxic texts hold far more often than clean ones,
beyond chance, where near copies count once so that words that merely travel with the copies of
one document are passed over. The terms form a trie; its states carry the edits spent, so walking it
is the intersection of the trie with the terms' Levenshtein automata. States are made as the words
of the corpus need them. A stem's automaton is that of its prefix, and toxic words below a stem are
terms of their own. Every hit gets a context: the words around it and the quotation marks that
enclose it. A logistic model over exact, stem, misspelled and misspelled stem hits, quoted or not,
the misspelled ones by number and by rate, gives the score; quoted hits start from a prior that
weighs them less. What a misspelled hit is worth is learned from the training texts themselves: each
toxic one is read once more with all its hits misspelled, so that the weights hold what the automata's
hits tell against the chance neighbours in clean texts. Words near a term that clean training texts
hold are words of the language and no misspellings; a clean training text's own words count as such
only where another one has them too. A hit is quoted when the nearest marks around
it, within the window, open before it and close after it.

Defined cases: null and empty texts have no hits and get the score of a text without any; a null
doc_id is never held out and never learned from; repeated rows are scored each; labels that are
null or not 0/1 are ignored; with no labelled toxic rows the lexicon is empty and all scores are
equal; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.bytetok import mix64, shingles, utf8, words
from lumenlake.llm.common import blocks, bounded, held_out, materialize

#: Labelled rows that training reads at most, in hash order.
TRAIN_TOXIC, TRAIN_CLEAN = 3_000, 6_000
#: Terms that may compete for the lexicon, and how much more frequent a term must be in toxic texts.
CANDIDATES, LIFT = 100_000, 20
STEM_LENGTHS = (4, 5, 6)
CONTEXT = 6
#: The rate of misspelled hits is taken in so many words: in longer texts chance neighbours of a term add up.
SPARSE_WORDS = 200
CUT = 0.3
HOLD_OUT = (4, 2)
#: Marks that open or close a quotation, and words that report speech.
QUOTES = "\"'“”„‚‘’«»"
REPORTING = ("said", "says", "called", "wrote", "quote", "quoted", "term", "word", "dijo", "sagte", "schrieb", "dit", "disait")
#: Numbers of hits by kind: exact, stem, misspelled, each unquoted and quoted; reported ones; misspelled stems, unquoted
#: and quoted; then the rates of misspelled terms and of misspelled stems.
KINDS = 13
#: The column of each kind's unquoted hits, and those of the numbers that have a rate.
COLUMN, RATED = (0, 2, 4, 7), (4, 5, 7, 8)


def edits_allowed(term: str) -> int:
    """Misspellings of longer words only: a short word has too many neighbours."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The union of the terms' Levenshtein automata over their shared trie, made deterministic on demand.

    A state is a set of (trie node, edits spent); an edit is an insertion, deletion, substitution
    or a swap of neighbours (held as a node that waits for the swapped letter).
    """

    def __init__(self, lexicon: dict[str, bool]):
        """lexicon: term -> True when it is a stem."""
        self.next: list[dict[str, int]] = [{}]
        self.budget = [0]  # the most edits that any term below a node allows
        self.word: list[str | None] = [None]
        self.stem = [False]
        for term in sorted(lexicon):
            node, allowed = 0, edits_allowed(term)
            self.budget[0] = max(self.budget[0], allowed)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.budget.append(0)
                    self.word.append(None)
                    self.stem.append(False)
                node = self.next[node][c]
                self.budget[node] = max(self.budget[node], allowed)
            self.word[node], self.stem[node] = term, self.stem[node] or lexicon[term]
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.table: list[dict[str, int]] = []
        self.accepts: list[int] = []  # 0: no term; 1: exact; 2: inside a stem's words; 3: misspelled; 4: inside a misspelled stem's words
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, items: set) -> frozenset:
        """With deletions: letters of a term that the word leaves out."""
        todo, out = list(items), set(items)
        while todo:
            node, spent, wait = todo.pop()
            if not wait:
                for child in self.next[node].values():
                    one = (child, spent + 1, "")
                    if spent < self.budget[child] and one not in out:
                        out.add(one)
                        todo.append(one)
        best: dict[tuple[int, str], int] = {}
        for node, spent, wait in out:
            best[node, wait] = min(best.get((node, wait), 9), spent)
        return frozenset((node, spent, wait) for (node, wait), spent in best.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.members)
            self.members.append(items)
            self.table.append({})
            kinds = [0]
            for node, spent, wait in items:
                if wait == "stem":
                    kinds.append(2 if spent == 0 else 4)
                elif not wait and (term := self.word[node]) is not None and spent <= edits_allowed(term):
                    kinds.append((2 if self.stem[node] else 1) + (0 if spent == 0 else 2))
            hits = [k for k in kinds if k]
            self.accepts.append(min(hits) if hits else 0)
        return self.states[items]

    def _step(self, state: int, c: str) -> int:
        out: set = set()
        for node, spent, wait in self.members[state]:
            if wait == "stem":
                out.add((node, spent, wait))
                continue
            if wait:  # the swapped letter must come now
                if c == wait:
                    out.add((node, spent, ""))
                continue
            if self.stem[node] and spent <= edits_allowed(self.word[node]):
                out.add((0, spent, "stem"))  # whatever follows
            child = self.next[node].get(c)
            if child is not None:
                out.add((child, spent, ""))
            if spent < self.budget[node]:
                out.add((node, spent + 1, ""))  # insertion
                for x, other in self.next[node].items():
                    if x != c and spent < self.budget[other]:
                        out.add((other, spent + 1, ""))  # substitution
                        swapped = self.next[other].get(c)
                        if swapped is not None and spent < self.budget[swapped]:
                            out.add((swapped, spent + 1, x))  # c x for x c
        closed = self._closed(out)
        return self._state(closed) if closed else -1

    def match(self, word: str) -> int:
        state = self.start
        for c in word:
            following = self.table[state].get(c)
            if following is None:
                following = self.table[state][c] = self._step(state, c)
            if following < 0:
                return 0
            state = following
        return self.accepts[state]


class Model(NamedTuple):
    lexicon: dict[str, bool]
    weight: np.ndarray
    bias: float
    innocent: frozenset[str] = frozenset()  # words near a term that are no misspellings of it


def _nearest_mark(text: str, places: range, beyond: str) -> tuple[str, str, str] | None:
    """The characters to the left and right of the first quotation mark at `places`, and the mark; marks between letters are
    apostrophes. beyond: what stands next to the text on the hit's side."""
    for i in places:
        if text[i] in QUOTES:
            left, right = text[i - 1] if i else (" " if places.step < 0 else beyond), text[i + 1] if i + 1 < len(text) else (beyond if places.step < 0 else " ")
            if not (left.isalnum() and right.isalnum()):
                return left, right, text[i]
    return None


def enclosed(before: str, after: str) -> bool:
    """Whether a hit stands in quotation marks: the nearest mark before it opens (nothing but space or a bracket to its left,
    text to its right) and the nearest one after it closes (text to its left, no letter to its right). Inside « and » may stand a space."""
    opening = _nearest_mark(before, range(len(before) - 1, -1, -1), "x")
    closing = _nearest_mark(after, range(len(after)), "x")
    return bool(opening and closing) and (opening[0].isspace() or opening[0] in "([{-–—:>") and (opening[2] == "«" or not opening[1].isspace()) and (closing[2] == "»" or not closing[0].isspace()) and not closing[1].isalnum()


def hit_features(column: pa.Array, automaton: Automaton, innocent: frozenset[str] = frozenset()) -> np.ndarray:
    """Hits of each text by kind and context; innocent words are never misspelled hits."""
    data, offsets = utf8(column)
    w = words(data, offsets)
    out = np.zeros((len(column), KINDS))
    if not len(w.hash):
        return out
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    raw = data.tobytes()
    found = (raw[s:e].decode("utf-8", "replace").lower() for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True))
    kinds = np.fromiter((0 if (k := automaton.match(x)) > 2 and x in innocent else k for x in found), np.int8, len(first))
    kind = kinds[inverse]
    for at in np.flatnonzero(kind).tolist():
        doc = int(w.doc[at])
        low, high = max(at - CONTEXT, 0), min(at + CONTEXT, len(w.doc) - 1)
        while w.doc[low] != doc:
            low += 1
        while w.doc[high] != doc:
            high -= 1
        before = raw[w.start[low] if low != at - CONTEXT or low == 0 else w.end[low] : w.start[at]].decode("utf-8", "replace")
        after = raw[w.end[at] : w.end[high]].decode("utf-8", "replace")
        if low == 0 or w.doc[low - 1] != doc:
            before = raw[offsets[doc] : w.start[at]].decode("utf-8", "replace")
        if high == len(w.doc) - 1 or w.doc[high + 1] != doc:
            after = raw[w.end[at] : offsets[doc + 1]].decode("utf-8", "replace")
        quoted = enclosed(before, after)
        out[doc, COLUMN[kind[at] - 1] + quoted] += 1
        out[doc, 6] += any(r in before.lower().split() for r in REPORTING)
    out[:, 9:] = out[:, RATED] * (SPARSE_WORDS / np.maximum(w.count, SPARSE_WORDS))[:, None]
    return np.log1p(out)


def fit(x: np.ndarray, toxic: np.ndarray, toxic_share: float, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic weights, drawn to a prior that counts quoted and reported hits less; classes weighed by their true shares."""
    prior = np.array([3.0, 1.0, 3.0, 1.0, 0.75, 0.0, -1.0, 0.5, 0.0, 0.5, 0.0, 0.25, 0.0])
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    weight = np.where(toxic, toxic_share / n1, (1 - toxic_share) / n0)
    z, beta = np.column_stack([x, np.ones(len(x))]), np.append(prior, np.log(max(toxic_share, 1e-4) / max(1 - toxic_share, 1e-4)))
    anchor, pull = beta.copy(), np.append(np.full(len(prior), ridge), 1e-4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (toxic - p)) - pull * (beta - anchor)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9), gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return beta[:-1], float(beta[-1])


def _terms(column: pa.Array) -> Iterator[set[tuple[str, bool]]]:
    """Each text's distinct words and stems."""
    data, offsets = utf8(column)
    w = words(data, offsets)
    raw, begin = data.tobytes(), np.cumsum(w.count) - w.count
    for i, n in enumerate(w.count.tolist()):
        own = {raw[s:e].decode("utf-8", "replace").lower() for s, e in zip(w.start[begin[i] : begin[i] + n].tolist(), w.end[begin[i] : begin[i] + n].tolist(), strict=True)}
        own = {x for x in own if 3 <= len(x) <= 40}
        yield {(x, False) for x in own} | {(x[:k], True) for x in own for k in STEM_LENGTHS if len(x) > k}


def misspelled(text: str, automaton: Automaton) -> str | None:
    """The text with one edit in every exact or stem hit, where the automata still find most of them; None without such hits.
    Place and kind of an edit depend on the word and its number alone."""
    made = 0

    def one(m: re.Match) -> str:
        nonlocal made
        word, low = m[0], m[0].lower()
        if automaton.match(low) not in (1, 2):
            return word
        for n in range(12):  # an edit may make another term, or leave the stem's
            r = random.Random(f"{low} {made} {n}")
            i = r.randrange(1, min(len(word), 9)) if len(word) > 1 else 0
            c = r.choice("abcdefghijklmnopqrstuvwxyz")
            new = (word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i - 1] + word[i : i + 1] + word[i - 1 : i] + word[i + 1 :])[r.randrange(4)]
            if automaton.match(new.lower()) in (3, 4):
                made += 1
                return new
        return word

    out = re.sub(r"[^\W_]+", one, text)
    return out if made else None


def _one_of_each(sample: DataFrame) -> DataFrame:
    """The sample with one toxic text of each group of near copies: texts that share one of four min-hashes of their shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                data, offsets = utf8(part.column(1))
                doc, value = shingles(words(data, offsets), 5)
                signs: list[list[int]] = [[] for _ in range(part.num_rows)]
                for d in np.unique(doc).tolist():
                    mine = value[doc == d]
                    signs[d] = [int(mix64(mine ^ np.uint64(j)).min() >> np.uint64(1)) for j in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signs, pa.list_(pa.int64()))], ["id", "signs"])

    toxic = sample.where("y = 1").select(F.xxhash64("text").alias("id"), "text")
    leader: dict[tuple[int, int], int] = {}
    group: dict[int, int] = {}
    for row in sorted(toxic.mapInArrow(sign, "id long, signs array<bigint>").collect(), key=lambda r: r["id"]):  # at most the bounded sample's rows
        keys = list(enumerate(row["signs"]))
        first = min((leader[k] for k in keys if k in leader), default=row["id"])
        group[row["id"]] = first
        for k in keys:
            leader.setdefault(k, first)
    kept = [i for i, g in group.items() if i == g]
    return sample.where((F.col("y") == 0) | F.xxhash64("text").isin(kept))


def learn_lexicon(sample: DataFrame) -> dict[str, bool]:
    """Terms of sample(text, y) that toxic texts hold far more often than clean ones, beyond chance.

    A term must be in so many toxic texts (near copies count once) that none of CANDIDATES terms
    would be expected to reach that by chance, and be LIFT times as frequent there as in clean ones.
    All such terms are taken, and the words below a stem that toxic texts hold LIFT times as often:
    the stem's numbers vouch for them. The bounded sample bounds the lexicon.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for own, toxic in zip(_terms(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for t in own:
                    total.setdefault(t, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in total], pa.string()), pa.array([s for _, s in total], pa.bool_()), pa.array([v[1] for v in total.values()], pa.int64()), pa.array([v[0] for v in total.values()], pa.int64())], ["term", "stem", "pos", "neg"])

    single = materialize(_one_of_each(sample), "toxicity-lexicon-sample")
    n1, n0 = (int(n or 0) for n in single.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    if not n1 or not n0:
        return {}
    least = max(3, math.ceil(math.log(CANDIDATES / 0.01) / math.log((n1 + n0) / n1)))
    rate = (F.col("pos") / n1) / ((F.col("neg") + 1) / (n0 + 1))
    counts = single.mapInArrow(count, "term string, stem boolean, pos long, neg long").groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = materialize(counts, "toxicity-terms")
    found = counts.where((F.col("pos") >= least) & (rate >= LIFT)).collect()
    words_, stems = {r["term"]: r["pos"] for r in found if not r["stem"]}, {r["term"]: r["pos"] for r in found if r["stem"]}
    below: dict[str, int] = {}  # by prefix, the most texts that one word or longer stem is in
    inner: dict[str, int] = {}
    for terms, most in ((words_, below), (stems, inner)):
        for term, pos in terms.items():
            for k in STEM_LENGTHS:
                if len(term) > k or (len(term) == k and most is below):
                    most[term[:k]] = max(most.get(term[:k], 0), pos)
    chosen: dict[str, bool] = {}
    for stem, pos in sorted(stems.items(), key=lambda t: (-t[1], -len(t[0]), t[0])):
        # a stem stands for itself when no single word or longer stem accounts for it, and no chosen stem holds it
        if below.get(stem, 0) < 0.7 * pos and inner.get(stem, 0) < 0.9 * pos and not any(stem[:k] in chosen for k in STEM_LENGTHS):
            chosen[stem] = True
    if chosen:
        prefix = F.broadcast(sample.sparkSession.createDataFrame([(t,) for t in sorted(chosen)], "prefix string"))  # stems of the bounded sample
        under = F.array(*[F.substring("term", 1, k) for k in STEM_LENGTHS])
        family = counts.where((~F.col("stem")) & (F.col("pos") > 0) & (F.col("pos") / n1 >= LIFT * F.col("neg") / n0))
        family = family.select("term", F.explode(F.array_distinct(under)).alias("prefix")).join(prefix, "prefix").select("term").distinct()
        words_ |= {r["term"]: 0 for r in family.collect() if r["term"] not in words_}
    for word in words_:
        chosen.setdefault(word, False)
    return chosen


def innocent_words(sample: DataFrame, lexicon: dict[str, bool]) -> dict[str, int]:
    """Words that the automata take for misspelled terms but that clean texts of the bounded sample hold, and in how many."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, kinds = Automaton(lexicon), {}
        for batch in batches:
            for own in _terms(batch.column(0)):
                words_ = [t for t, stem in own if not stem]
                kinds |= {t: automaton.match(t) for t in words_ if t not in kinds}
                yield pa.RecordBatch.from_arrays([pa.array([t for t in words_ if kinds[t] > 2], pa.string())], ["word"])

    if not lexicon:
        return {}
    counts = sample.where("y = 0").select("text").mapInArrow(near, "word string").groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}  # neighbours of the lexicon's terms in the bounded sample


def train(docs: DataFrame, labels: DataFrame, n_toxic: int = TRAIN_TOXIC, n_clean: int = TRAIN_CLEAN) -> Model:
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), *HOLD_OUT))
    share = known.agg(F.avg("y")).first()[0]
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    picked = known.where("y = 1").orderBy(order).limit(n_toxic).unionByName(known.where("y = 0").orderBy(order).limit(n_clean))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y")  # at most n_toxic + n_clean label rows
    # a labelled id may have very many rows, and a text: each text once a label, and no more than the bound of each
    once = materialize(sample.where(F.col("text").isNotNull()).dropDuplicates(["text", "y"]), "toxicity-texts")
    by_hash = F.xxhash64("text", F.lit("toxicity"))
    sample = once.where("y = 1").orderBy(by_hash).limit(n_toxic).unionByName(once.where("y = 0").orderBy(by_hash).limit(n_clean))
    sample = materialize(sample.repartition("text"), "toxicity-sample")
    lexicon = learn_lexicon(sample)

    texts = innocent_words(sample, lexicon)
    known, shared = frozenset(texts), frozenset(x for x, n in texts.items() if n > 1)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(lexicon)
        for batch in batches:
            for part in blocks(batch, "text"):
                y, h = part.column(1).to_pylist(), part.column(2).to_pylist()
                own, other = hit_features(part.column(0), automaton, known), hit_features(part.column(0), automaton, shared)
                x = [a if toxic else b for toxic, a, b in zip(y, own, other, strict=True)]
                wrong = [(misspelled(t, automaton), i) for i, (t, toxic) in enumerate(zip(part.column(0).to_pylist(), y, strict=True)) if toxic]
                wrong = [(t, i) for t, i in wrong if t is not None]
                x += list(hit_features(pa.array([t for t, _ in wrong], pa.string()), automaton, known))
                yield pa.RecordBatch.from_arrays([pa.array(y + [1] * len(wrong), pa.int32()), pa.array(x, pa.list_(pa.float64())), pa.array(h + [h[i] ^ 1 for _, i in wrong], pa.int64())], ["y", "x", "h"])

    got = bounded(sample.select("text", "y", F.xxhash64("text").alias("h")).mapInArrow(extract, "y int, x array<double>, h long"), {1: 2 * n_toxic, 0: n_clean}).toPandas()
    if got.empty or got["y"].nunique() < 2:
        return Model(lexicon, np.zeros(KINDS), float(np.log(0.05 / 0.95)), known)
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy()
    at = np.lexsort((*x.T, y))
    return Model(lexicon, *fit(x[at], y[at] == 1, float(share)), known)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and hits (exact and stem hits) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.lexicon)
        for batch in batches:
            for part in blocks(batch, "text"):
                x = hit_features(part.column(1), automaton, model.innocent)
                score = 1 / (1 + np.exp(-np.clip(x @ model.weight + model.bias, -40, 40)))
                hits = np.rint(np.expm1(x[:, :4]).sum(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(hits)], ["doc_id", "score", "hits"])
                if len(automaton.members) > 200_000:
                    automaton = Automaton(model.lexicon)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, hits long")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, hits of every document."""
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), *HOLD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "hits")
