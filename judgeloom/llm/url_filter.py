"""URL filter: lists of hosts and paths, then a weighted vocabulary.

A URL that a rule fits gets the rule's verdict: of several the one with the most
specific host, then the longest path.  For all others an Aho-Corasick automaton
finds the terms of a vocabulary that stand between characters other than letters
and digits.  Terms have weights; strict ones weigh the limit, soft ones less, so
one strict term or several different soft ones reach it and block.

The vocabulary is a table (term, weight) of at most MAX_TERMS terms, which every
task holds; more are an error.  ``VOCABULARY`` is a small one in four languages.

Results for odd inputs: a null URL, or one without ``://``, has an empty host
and path and fits no rule; the vocabulary still looks at its text (null:
nothing), otherwise it is allowed; a null id stays null; repeated rows give a
row each; a term counts once, with its greatest weight, and null or empty terms
not at all; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A URL is blocked from this sum of weights on.
LIMIT = 2
# The vocabulary, strict terms and soft ones by language.
STRICT = {
    "any": ("casino", "hentai", "malware", "phishing", "porn", "porno", "pornos", "spam", "viagra", "cialis", "warez", "xxx", "keygen", "botnet"),
    "en": ("adult", "adults", "escort", "escorts", "jackpot", "slots"),
    "de": ("erotik", "gluecksspiel", "spielhalle", "sexkontakte"),
    "es": ("adultos", "apuestas", "tragaperras", "erotica"),
    "fr": ("adulte", "adultes", "erotique", "escorte"),
}
SOFT = {
    "en": ("ads", "bets", "betting", "bonus", "cheap", "click", "deal", "deals", "free", "farm", "loan", "loans", "pills", "popup", "prize", "promo", "track", "tracker", "win", "winner"),
    "de": ("billig", "gewinn", "gewinner", "gratis", "kredit", "kostenlos", "rabatt", "werbung", "wetten"),
    "es": ("barato", "credito", "ganador", "oferta", "ofertas", "premio", "prestamo", "publicidad"),
    "fr": ("credit", "gagnant", "gratuit", "gratuite", "jeux", "paris", "pret", "promotion", "publicite"),
}
VOCABULARY = sorted({(t, LIMIT) for ts in STRICT.values() for t in ts} | {(t, 1) for ts in SOFT.values() for t in ts})
MAX_TERMS = 100_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].translate(_LOWER), rest[cut:]
    return host, path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


class Rules:
    """(verdict, host, path) by host."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict); the more specific host wins before the longer path."""
        name = host
        while name:
            fit = max(((p, v) for p, v in self.by_host.get(name, ()) if path.startswith(p)), key=lambda x: len(x[0]), default=None)
            if fit:
                return name + fit[0], fit[1]
            _, dot, name = name.partition(".")
            if not dot:
                return None
        return None


class Vocabulary:
    """Terms (lower-cased) with their weights, as an automaton."""

    def __init__(self, terms: Iterable[tuple[str | None, float]] = VOCABULARY) -> None:
        import ahocorasick

        self.weights: dict[str, float] = {}
        for term, weight in terms:
            if term:
                term = term.translate(_LOWER)
                self.weights[term] = max(weight, self.weights.get(term, weight))
        self.automaton = ahocorasick.Automaton()
        for term in self.weights:
            self.automaton.add_word(term, term)
        if self.weights:
            self.automaton.make_automaton()

    def found(self, url: str | None) -> set[str]:
        """The different terms of a URL, between boundaries."""
        text, out = (url or "").translate(_LOWER), set()
        if not self.weights:
            return out
        for end, term in self.automaton.iter(text):
            start = end - len(term) + 1
            if not ((start and text[start - 1] in _WORD) or (end + 1 < len(text) and text[end + 1] in _WORD)):
                out.add(term)
        return out


def terms_of(table: DataFrame, most: int = MAX_TERMS) -> list[tuple[str, float]]:
    """A vocabulary table's rows; more than ``most`` are an error."""
    rows = table.select(F.col("term").cast("string"), F.col("weight").cast("double")).dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"A vocabulary of more than {most} terms")
    return [tuple(r) for r in rows]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], vocabulary: DataFrame | Iterable[tuple[str, float]] = VOCABULARY, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits, weight): hits
    are different terms, strict if they alone reach the limit."""
    terms = terms_of(vocabulary) if isinstance(vocabulary, DataFrame) else list(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host, words = Rules(rules), Vocabulary(terms)
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                rule, verdict = by_host.longest(host, path) or (None, None)
                weights = [words.weights[t] for t in words.found(url)]
                strict = sum(w >= limit for w in weights)
                out.append((host, path, rule, verdict or ("block" if weights and sum(weights) >= limit else "allow"), strict, len(weights) - strict, float(sum(weights))))
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.string(),) * 4 + (pa.int64(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, weight double")
