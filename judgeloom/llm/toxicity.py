"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Learning, from a bounded sample of labelled rows (``MAX_TRAINING``):

1. Terms are words, and stems (the first letters of words), that occur in toxic
   rows in several different contexts (word before, word after; copies of a
   text have the same) and hardly ever in others: in so many that among all that
   were looked at a hundredth of a term would by chance.  However many there
   are, all are kept; they are words of the sample.
2. Every (term, edit distance) gets its precision, counted on the sample by the
   scanner below.

Scoring: the Levenshtein automaton of distance one is intersected with the trie
of all words, and with that of all stems, and made deterministic, one table of
states by byte.  Terms of fewer than ``FUZZY_LENGTH`` letters are matched
exactly; of such a stem, the longer words it covers are matched at distance one
in its place.  All words of
a batch run through the table together, a byte at a time; most die after two.
A hit's precision is its weight.  A window around each hit is looked at: within
quotation marks, or after a reporting verb, a hit is quoted and weighs less.
The score is 1 - prod(1 - weight) over the distinct terms of a text.

Words are runs of a-z (A-Z counts as a-z) and of bytes beyond ASCII.  Results
for odd inputs: null and empty texts score 0; null labels aren't learned from;
without any toxic label, or any other one, nothing scores above 0; a null id is never held out and
stays null; repeated rows give a row each; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packs as P

#: Labelled rows learned from at most: the first by a hash of doc_id.
MAX_TRAINING = 24_000
MIN_CONTEXTS, STEM = 4, (4, 6)
#: Share of toxic rows among a term's labelled rows, and how many terms may be
#: there by chance.
MIN_PRECISION, BY_CHANCE = 0.97, 0.01
#: Precision of a term at distance 0 and 1 before anything is counted (as two rows).
PRIOR = (0.95, 0.8)
#: Words and stems from this length on are also matched at distance one.
FUZZY_LENGTH = 5
#: What is left of a quoted hit's weight, and how far the window reaches (bytes).
QUOTED, WINDOW = 0.5, 60

_LOWER = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
# Verbs that report speech, in the four languages of the tables.
REPORTING = ("said", "says", "wrote", "writes", "quoted", "quote", "called", "replied", "sagte", "schrieb", "nannte", "zitat", "dijo", "escribió", "llamó", "cita", "disait", "écrit", "citation")
_REPORTED = re.compile(rb"(?<![a-z\x80-\xff])(?:" + b"|".join(w.encode() for w in REPORTING) + rb")(?![a-z\x80-\xff])")
_OPEN, _CLOSE = ('"', "“", "„", "«"), ('"', "”", "“", "»")


@dataclass
class Lexicon:
    """words and stems, the weight of (term, is stem, distance), and the stem of
    words that a stem too short for distance one covers."""

    words: list[bytes]
    stems: list[bytes]
    weights: dict[tuple[bytes, bool, int], float] = field(default_factory=dict)
    covered: dict[bytes, bytes] = field(default_factory=dict)


class Automaton:
    """Levenshtein automata of words, intersected with their trie, as a table.

    A state is a set of (trie node, errors).  ``table[state, class of byte]``
    is the next state, 0 the dead one.  ``accepts[state]`` is (term, distance)
    of the nearest term.  A stem that has been read stays in the state, whatever
    follows, in case a nearer one is still to come."""

    def __init__(self, terms: list[bytes], distance: int, fuzzy_length: int = FUZZY_LENGTH, stems: bool = False) -> None:
        self.terms = terms
        letters = sorted({b for t in terms for b in t})
        self.classes = np.zeros(256, np.int64)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[int | None] = [None]
        fuzzy = [0]  # the longest term below
        for k, term in enumerate(terms):
            node = 0
            for b in term:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(None)
                    fuzzy.append(0)
                node = children[node][b]
                fuzzy[node] = max(fuzzy[node], len(term))
            ends[node] = k
        fuzzy[0] = max([0, *map(len, terms)])

        def accepted(node: int, errors: int) -> bool:
            return ends[node] is not None and (errors == 0 or len(terms[ends[node]]) >= fuzzy_length)

        def closed(state: set) -> frozenset:
            todo = list(state)
            while todo:
                node, errors = todo.pop()
                if errors < distance and fuzzy[node] >= fuzzy_length:
                    for child in children[node].values():
                        if (child, errors + 1) not in state:
                            state.add((child, errors + 1))
                            todo.append((child, errors + 1))
            best: dict[int, int] = {}
            for node, errors in state:
                best[node] = min(errors, best.get(node, 9))
            return frozenset(best.items())

        def step(state: frozenset, b: int | None) -> frozenset:
            out = {(n, errors) for n, errors in state if stems and accepted(n, errors)}
            for node, errors in state:
                if b is not None and b in children[node]:
                    out.add((children[node][b], errors))
                if errors < distance and fuzzy[node] >= fuzzy_length:
                    out.add((node, errors + 1))
                    out.update((child, errors + 1) for c, child in children[node].items() if c != b)
            return closed(out)

        start = closed({(0, 0)})
        number = {frozenset(): 0, start: 1}
        states, rows = [frozenset(), start], []
        k = 0
        while k < len(states):
            row = []
            for b in [None, *letters]:
                to = step(states[k], b) if k else frozenset()
                if stems and any(ends[n] is not None and errors == 0 for n, errors in states[k]):
                    to = states[k]  # what follows a stem is free
                if to not in number:
                    number[to] = len(states)
                    states.append(to)
                row.append(number[to])
            rows.append(row)
            k += 1
        self.table = np.array(rows, np.int32)
        self.accepts: list[tuple[int, int] | None] = []
        for state in states:
            hits = [(errors, ends[n]) for n, errors in state if accepted(n, errors)]
            self.accepts.append((min(hits)[1], min(hits)[0]) if hits else None)
        self.accepting = np.array([a is not None for a in self.accepts])
        self.settled = self.accepting & (self.table == np.arange(len(states))[:, None]).all(axis=1)
        self.longest = max([0, *map(len, terms)]) + distance
        self.shortest = min([99, *map(len, terms)]) - distance
        self.stems = stems

    def run(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words are accepted, their states)."""
        alive = np.flatnonzero((lengths >= self.shortest) & ((lengths <= self.longest) | self.stems))
        state = np.ones(len(alive), np.int32)
        who, what = [], []
        for k in range(self.longest + 1):
            over = lengths[alive] == k
            if self.stems:
                over |= self.settled[state] | (k == self.longest)
            done = over & self.accepting[state]
            who.append(alive[done])
            what.append(state[done])
            alive, state = alive[~over], state[~over]
            if not len(alive) or k == self.longest:
                break
            state = self.table[state, self.classes[buf[starts[alive] + k]]]
            alive, state = alive[state > 0], state[state > 0]
        return np.concatenate(who), np.concatenate(what)


class Scanner:
    """Finds the terms of a lexicon in batches of texts."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automata = [Automaton(lexicon.words, 1), Automaton(lexicon.stems, 1, stems=True), Automaton(sorted(lexicon.covered), 1)]

    def hits(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, bool, int, bool]]:
        """(text, term, is stem, distance, is quoted)."""
        raw = b"\n".join(texts) + b"\n"
        low = raw.translate(_LOWER)
        buf = np.frombuffer(low, np.uint8)
        letter = buf != 32
        step = np.diff(letter.astype(np.int8))
        starts = np.flatnonzero(step == 1) + 1
        if letter[0]:
            starts = np.concatenate([[0], starts])
        lengths = np.flatnonzero(step == -1) + 1 - starts
        ends = np.cumsum([len(t) + 1 for t in texts])
        for automaton, stem in zip(self.automata, (False, True, None), strict=True):
            if not automaton.terms:
                continue
            who, what = automaton.run(buf, starts, lengths)
            of = np.searchsorted(ends, starts[who], "right")
            for w, s, t in zip(who.tolist(), what.tolist(), of.tolist(), strict=True):
                term, distance = automaton.accepts[s]
                begin = int(ends[t - 1]) if t else 0
                found = automaton.terms[term]
                if stem is None:
                    if distance == 0:  # the stem itself has it
                        continue
                    found = self.lexicon.covered[found]
                yield t, found, stem is not False, distance, quoted(raw, low, begin, int(starts[w]), int(starts[w] + lengths[w]), int(ends[t]) - 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        left = np.ones(len(texts))
        best: dict[tuple[int, bytes, bool], float] = {}
        for t, term, stem, distance, is_quoted in self.hits(texts):
            weight = self.lexicon.weights.get((term, stem, distance), 0.0) * (QUOTED if is_quoted else 1.0)
            key = (t, term, stem)
            best[key] = max(best.get(key, 0.0), weight)
        for (t, _, _), weight in best.items():
            left[t] *= 1 - weight
        return 1 - left


def quoted(raw: bytes, low: bytes, begin: int, start: int, end: int, stop: int) -> bool:
    """Whether the word at start:end stands within quotation marks that open
    and close in its window, or shortly after a reporting verb."""
    before, after = raw[max(begin, start - WINDOW) : start].decode("utf-8", "replace"), raw[end : min(stop, end + WINDOW)].decode("utf-8", "replace")
    for o, c in zip(_OPEN, _CLOSE, strict=True):
        inside = before.count(o) % 2 == 1 if o == c else before.rfind(o) > before.rfind(c)
        if inside and c in after:
            return True
    return bool(_REPORTED.search(low[max(begin, start - WINDOW // 2) : start]))


def held_out(doc_id: Column) -> Column:
    """Rows that labels aren't learned from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, is stem, toxic, context) for every word and stem of a row."""
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = (text or b"").translate(_LOWER).split()
            found: dict[tuple[bytes, bool], int] = {}
            for i, w in enumerate(words):
                context = hash_of((words[i - 1] if i else b"") + b" " + (words[i + 1] if i + 1 < len(words) else b""))
                if len(w) >= 3:
                    found.setdefault((w, False), context)
                for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1):
                    if w[n] & 0xC0 != 0x80:
                        found.setdefault((w[:n], True), context)
            if found:
                terms, contexts = list(found), list(found.values())
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms], pa.binary()), pa.array([s for _, s in terms]), pa.array([toxic] * len(terms), pa.int32()), pa.array(contexts, pa.int64())], names=["term", "stem", "toxic", "context"])


def hash_of(x: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def learn(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from labelled rows that aren't held out.  At most max_training
    labels are broadcast to the documents, half of them toxic if there are so
    many."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).cast("long").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    by_hash = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id")
    known_by = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = by_hash.where("toxic = 1").limit(max_training // 2).unionByName(by_hash.where("toxic = 0").limit(max_training // 2))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("text")).join(F.broadcast(sample), "_id")
    rows = P.checkpointed(rows.select("toxic", "text"))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return Lexicon([], [])
    # what a sampled row of the other class stands for
    ratio = (known_by.get(0, 0) / max(1, totals.get(0, 0))) / (known_by[1] / totals[1])
    counts = rows.mapInArrow(_evidence, "term binary, stem boolean, toxic int, context long").groupBy("term", "stem").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"), F.approx_count_distinct(F.when(F.col("toxic") == 1, F.col("context"))).alias("contexts"))
    precise = F.col("bad") / (F.col("bad") + F.lit(ratio) * F.col("good"))
    tested = P.checkpointed(counts.where(F.col("contexts") >= MIN_CONTEXTS))
    # a term of k toxic rows alone is there by chance with base ** k
    least = math.log(max(1, tested.count()) / BY_CHANCE) / -math.log(totals[1] / (totals[0] + totals[1]))
    terms = tested.where((F.col("contexts") >= least) & (precise >= MIN_PRECISION)).collect()
    lexicon = _chosen([(bytes(r["term"]), r["stem"], r["contexts"]) for r in terms])
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(lexicon))

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_pylist()
            for s, _, texts in P.portions(batch.column(1)):
                found = sorted({(t, term, stem, distance) for t, term, stem, distance, _ in scanner.value.hits(texts)})
                yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.bool_()), pa.array([f[3] for f in found], pa.int32()), pa.array([toxic[s + f[0]] for f in found], pa.int32())], names=["term", "stem", "distance", "toxic"])

    seen = rows.mapInArrow(calibrate, "term binary, stem boolean, distance int, toxic int").groupBy("term", "stem", "distance").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")).collect()
    for distance in (0, 1):
        mine = [r for r in seen if r["distance"] == distance]
        prior = PRIOR[distance]
        of = {(bytes(r["term"]), r["stem"]): (r["bad"], ratio * r["good"]) for r in mine}
        for term, stem in [*((w, False) for w in lexicon.words), *((s, True) for s in lexicon.stems)]:
            b, g = of.get((term, stem), (0, 0.0))
            lexicon.weights[term, stem, distance] = min(0.99, (b + 2 * prior) / (b + g + 2))
    return lexicon


def _chosen(terms: list[tuple[bytes, bool, int]]) -> Lexicon:
    """Terms by support, without words and longer stems that a chosen stem
    covers, unless they have most of its support; stems of one word only are
    left to the word."""
    words = {t: n for t, stem, n in terms if not stem}
    stems: dict[bytes, int] = {}
    for t, n in sorted(((t, n) for t, stem, n in terms if stem), key=lambda x: (len(x[0]), x[0])):
        longest = max([0, *(m for w, m in words.items() if w.startswith(t))])
        if not any(t.startswith(s) for s in stems) and longest < 0.6 * n:
            stems[t] = n
    left = {w: n for w, n in words.items() if not any(w.startswith(s) for s in stems)}
    covered = {w: s for w in words if len(w) >= FUZZY_LENGTH for s in stems if len(s) < FUZZY_LENGTH and w.startswith(s)}
    return Lexicon(sorted(left), sorted(stems), covered=covered)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, texts in P.portions(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(scanner.value.scores(texts))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without the rows that score at least threshold, all columns
    unchanged; nothing is shuffled."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(lexicon))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for s, e, texts in P.portions(batch.column(place).cast(pa.binary())):
                keep[s:e] = scanner.value.scores(texts) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
