"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores from context windows.

The automata of all terms and the trie of the terms are one product: a state is the set of trie
nodes reachable with the fewest errors each. It is determinised as it is needed, so that a word
costs a table look-up a letter and most words reach the dead state after a few. A worker keeps
what it found for a word. Every document is scored whole where it lies; nothing is shuffled.

A hit counts by its likeness to the term and by the words around it: inside quotation marks it is
mention rather than abuse and counts less, still less if the sentence around the quotation reports it. One error counts
like none (words that other documents have aren't taken for misspellings); two errors are half the
evidence alone, and whole beside another hit within the window.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship, stored
from .common import add_columns, blocks, strings

#: Terms that are always in the lexicon.
BASE = ("idiot", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "stupid", "clown")
#: A term of fewer letters has to match exactly.
FUZZY_FROM = 5
#: Letters from which two errors are allowed.
TWO_FROM = 9
#: Labelled documents that terms are learned from: toxic ones, and for each of them this many others.
SAMPLE_TOXIC, OTHERS = 2000, 2
#: Share of wrong ones among the learned terms of a language, in expectation at most (Benjamini-Hochberg).
FALSE_TERMS = 0.05
#: A learned term's share of the toxic documents over its share of the others, at least.
TIMES_ELSEWHERE = 40
WINDOW = 12
THRESHOLD = 1.0
CACHE = 500_000
_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.!?\n]")
_CUES = frozenset("said says say called calls wrote writes quote quoted quotes term word phrase reported sagte sagt schrieb nannte wort zitat dit écrit appelé mot citation dijo dice escribió llamó palabra cita".split())
_OPEN, _CLOSE = {"“": "”", "«": "»", "„": "“", "‘": "’"}, set("”»’")


def errors_allowed(term: str) -> int:
    return 0 if len(term) < FUZZY_FROM else 1 if len(term) < TWO_FROM else 2


class Matcher:
    """Words to (term, errors), by the product of trie and automata."""

    def __init__(self, terms: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.allowed: list[int] = [0]  # errors that any term below the node allows
        for t in sorted(set(terms)):
            most = errors_allowed(t)
            node = 0
            self.allowed[0] = max(self.allowed[0], most)
            for c in t:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.term):
                    self.children.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                self.allowed[node] = max(self.allowed[node], most)
            self.term[node] = t
        self.alphabet = {c for node in self.children for c in node}
        self.states: list[dict[int, int]] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[str, int] | None] = []
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes that skipping letters of terms reaches."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.allowed[child] and nodes.get(child, 9) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = tuple(sorted(nodes.items()))
        if not key:
            return -1
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] and e <= errors_allowed(self.term[n])]
            best = min(ends, default=None)
            self.final.append(best and (best[1], best[0]))
        return found

    def _move(self, state: int, c: str) -> int:
        out: dict[int, int] = {}

        def reach(node, e):
            if e <= self.allowed[node] and out.get(node, 9) > e:
                out[node] = e

        for node, e in self.states[state].items():
            reach(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
        to = self.moves[state][c] = self._state(self._closed(out))
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest errors, of those the first by alphabet."""
        state, moves, alphabet = self.start, self.moves, self.alphabet
        for c in word:
            if c not in alphabet:
                c = "\0"
            to = moves[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return None
            state = to
        return self.final[state]


class Scorer:
    def __init__(self, terms: tuple[str, ...], known: frozenset[str]):
        self.matcher, self.known, self.terms = Matcher(terms), known, frozenset(terms)
        self.cache: dict[str, tuple[str, int] | None] = {}

    def hit(self, word: str) -> tuple[str, int] | None:
        if word in self.cache:
            return self.cache[word]
        found = self.matcher.match(word)
        if found and found[1] and word in self.known:
            found = None  # a word of its own, not a misspelling
        self.cache[word] = found
        return found

    def reported(self, quotation: tuple[int, int], words: list[str], starts: list[int], ends: list[int]) -> bool:
        """Is there a word of reporting in the sentence around a quotation, outside of it and within the window?"""
        a, b = quotation
        k = bisect_left(ends, a)
        low = ends[k - 1] if k else -1
        k = bisect_left(ends, b)
        high = ends[k] if k < len(ends) else math.inf
        first, last = bisect_left(starts, a), bisect_left(starts, b)
        near = [*range(max(0, first - WINDOW), first), *range(last, min(len(words), last + WINDOW))]
        return any(low < starts[j] < high and words[j] in _CUES for j in near)

    def score(self, text: str) -> tuple[float, int, int, int]:
        """Score, hits, misspelled hits, quoted hits."""
        low = text.lower()
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, new = self.cache, False
        found = False
        for w in set(_WORD.findall(low)):
            if w in cache:
                if cache[w]:
                    found = True
            elif self.hit(w):
                found = True
        if not found:
            return 0.0, 0, 0, 0
        spans = [m.span() for m in _WORD.finditer(low)]
        words = [low[a:b] for a, b in spans]
        hits = [(i, h) for i, w in enumerate(words) if (h := cache.get(w) or (self.hit(w) if w not in cache else None))]
        inside = quoted_spans(low)
        starts = [a for a, _ in spans] if inside else []
        ends = [m.start() for m in _SENTENCE_END.finditer(low)] if inside else []
        total, wrong, quoted, k = 0.0, 0, 0, 0
        for n, (i, (term, errors)) in enumerate(hits):
            value = 1.0
            if errors:
                wrong += 1
                company = (n and i - hits[n - 1][0] <= WINDOW) or (n + 1 < len(hits) and hits[n + 1][0] - i <= WINDOW)
                value = 1.0 if errors == 1 or company else 0.5
            a, b = spans[i]
            while k < len(inside) and inside[k][1] <= a:
                k += 1
            in_quotes = k < len(inside) and inside[k][0] < a and b <= inside[k][1]
            reported = in_quotes and self.reported(inside[k], words, starts, ends)
            quoted += in_quotes
            value *= (0.25 if in_quotes else 1.0) * (0.5 if reported else 1.0)
            total += value
        return total, len(hits), wrong, quoted


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Stretches between quotation marks, in one line each, from left to right."""
    out, at = [], 0
    for m in re.finditer(r'["“«„‘]', text):
        if m.start() < at:
            continue
        close = _OPEN.get(m.group(), '"')
        end = text.find(close, m.end())
        line = text.find("\n", m.end())
        if end >= 0 and (line < 0 or end < line):
            out.append((m.start(), end + 1))
            at = end + 1
    return out


_SCORERS: dict[tuple, Scorer] = {}


def toxicity(docs: DataFrame, terms: tuple[str, ...] = BASE, known: frozenset[str] = frozenset(), text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``toxic_score``, ``n_hits``, ``n_misspelled``, ``n_quoted`` and ``toxic``.

    A null text has nulls, and ``toxic`` false; an empty one has zeros; a very long one is scored whole. A score at the
    threshold is toxic. Repeated rows are scored alike, an empty table gives no row. Input columns named like the added ones are replaced; all others stay.
    """
    terms = tuple(sorted({t.lower() for t in terms if t}))
    shared = docs.sparkSession.sparkContext.broadcast((terms, frozenset(known)))

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        key = shared.value
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(*key)
        scorer = _SCORERS[key]
        rows = [None if t is None else scorer.score(t) for t in strings(batch.column(text_col)).to_pylist()]
        cols = list(zip(*[r or (None,) * 4 for r in rows])) or [()] * 4
        return {"toxic_score": pa.array(cols[0], pa.float64()), "n_hits": pa.array(cols[1], pa.int32()), "n_misspelled": pa.array(cols[2], pa.int32()), "n_quoted": pa.array(cols[3], pa.int32()), "toxic": pa.array([bool(r) and r[0] >= threshold for r in rows], pa.bool_())}

    fields = [T.StructField("toxic_score", T.DoubleType()), *(T.StructField(c, T.IntegerType()) for c in ("n_hits", "n_misspelled", "n_quoted")), T.StructField("toxic", T.BooleanType())]
    return add_columns(docs, make, fields, text_col)


def _chance(a: int, n: int, toxic: int, others: int) -> float:
    """The chance of ``a`` or more toxic documents among the ``n`` that have a word, if it marks nothing (Fisher's exact test).

    Where labels of toxic documents are the majority, which says how they were picked, a document counts as toxic by an even chance.
    """

    def ways(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    if others < toxic:
        return sum(math.exp(ways(n, k) - n * math.log(2)) for k in range(a, n + 1))
    return sum(math.exp(ways(toxic, k) + ways(others, n - k) - ways(toxic + others, n)) for k in range(max(a, n - others), min(n, toxic) + 1))


def _marking(words: list[tuple[str, int, int]], sizes: dict[int, int], toxic: int, others: int) -> set[str]:
    """Of one language's ``words`` (with toxic documents and others that have them), those that mark toxic documents.

    ``sizes`` has the words of the language by documents that have them. Words too rare to tell of anything aren't
    counted as tests (Tarone).
    """
    least, tests = 1, sum(sizes.values())
    while least < toxic and _chance(least, least, toxic, others) > FALSE_TERMS / max(1, tests):
        tests -= sizes.get(least, 0)
        least += 1
    found = sorted((_chance(a, a + b, toxic, others), w) for w, a, b in words if a + b >= least)
    good = [k for k, (p, _) in enumerate(found, 1) if p <= FALSE_TERMS * k / max(1, tests)]
    return {w for _, w in found[: max(good, default=0)]}


def _word_counts(texts: DataFrame) -> DataFrame:
    """``(lang, word, before, toxic, others)`` of ``(lang, toxic, text)``: documents that have the word, by parts of batches.

    A toxic document counts at one of its places; the other places have 0, for their preceding words.
    """
    ship(texts.sparkSession)

    def run(batches):
        for whole, a, b in ((batch, a, b) for batch in batches for a, b in blocks(batch.column("text"))):
            part = whole.slice(a, b - a)
            counts: dict[tuple, list[int]] = {}
            for lang, toxic, text in zip(part.column("lang").to_pylist(), part.column("toxic").to_pylist(), strings(part.column("text")).to_pylist()):
                words, seen = _WORD.findall(text.lower()), set()
                for word, before in zip(words, ["", *words]):
                    n = counts.setdefault((lang, word, before if toxic else None), [0, 0])
                    if word not in seen:
                        n[1 - toxic] += 1
                        seen.add(word)
            keys = list(zip(*counts)) or [()] * 3
            sums = list(zip(*counts.values())) or [()] * 2
            yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.string()) for k in keys], *[pa.array(k, pa.int64()) for k in sums]], names=["lang", "word", "before", "toxic", "others"])

    return texts.select("lang", "toxic", "text").mapInArrow(run, "lang string, word string, before string, toxic bigint, others bigint")


def learn_terms(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_TOXIC) -> tuple[tuple[str, ...], frozenset[str]]:
    """Terms that mark toxic documents, with the base terms; and words of other documents near them.

    Read from ``sample`` toxic labelled documents and ``OTHERS`` times as many others, by least hash. Words are
    judged within their language, by an exact test of the toxic documents and the others that have them: how many
    documents it takes follows from the table, there is no fixed number. Equal texts count once, and no word has
    more toxic documents than distinct preceding words, for the sake of near copies. Null labels are passed over.
    """
    known = labels.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    order = F.xxhash64("doc_id")
    of = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n).distinct() for k, n in ((1, sample), (0, sample * OTHERS))]
    # at most so many rows, whatever the tables hold
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    some = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", lang.alias("lang")).where("text IS NOT NULL").join(F.broadcast(of[0].unionByName(of[1])), "doc_id")
    some = stored(some.select("lang", "toxic", "text", F.xxhash64("text").alias("hash")).dropDuplicates(["lang", "toxic", "hash"]), "labelled")
    size = {(r.lang, r.toxic): r.n for r in some.groupBy("lang", "toxic").agg(F.count("*").alias("n")).collect()}
    totals = {lg: (n, size.get((lg, 0), 0)) for (lg, toxic), n in size.items() if toxic}
    met = _word_counts(some).groupBy("lang", "word", "before").agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))
    met = met.groupBy("lang", "word").agg(F.sum("toxic").alias("toxic"), F.count("before").alias("contexts"), F.sum("others").alias("others"))
    met = stored(met, "words")
    sizes: dict[str, dict[int, int]] = {lg: {} for lg in totals}
    for r in met.groupBy("lang", (F.col("toxic") + F.col("others")).alias("docs")).agg(F.count("*").alias("n")).collect():
        if r.lang in sizes:
            sizes[r.lang][r.docs] = r.n
    terms = set(BASE)
    for lg, (n_toxic, n_others) in totals.items():
        # bounded by the sample
        often = met.where((F.col("lang") == lg) & (F.length("word") > 2) & ~F.col("word").rlike("^[0-9]+$")).select("word", F.least("toxic", "contexts").alias("a"), F.col("others").alias("b"))
        often = often.where((F.col("a") > 1) & (F.col("a") * n_others >= TIMES_ELSEWHERE * n_toxic * F.col("b")))
        terms |= _marking([(r.word, r.a, r.b) for r in often.collect()], sizes[lg], n_toxic, n_others)
    near = Matcher(tuple(terms))
    lengths = sorted({len(t) + k for t in terms for k in range(-errors_allowed(t), errors_allowed(t) + 1)})
    words = met.where((F.col("others") > 0) & F.length("word").isin(lengths)).select("word").distinct()
    return tuple(sorted(terms)), frozenset(r.word for r in words.collect() if r.word not in terms and near.match(r.word))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, and whether it is toxic."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    terms, known = learn_terms(docs, labels)
    return toxicity(docs.select("doc_id", "text"), terms, known).drop("text")
