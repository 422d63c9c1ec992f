"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, normalised by length.

Folding maps homoglyphs and digit substitutions to plain letters and
everything between words to one space character each. A lexicon term is a word
beginning (" idio") or a whole word (" ass ") with a weight; hits inside an
exception phrase don't count. Terms, weights, exceptions and the final scale are learned from
labelled rows.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import labelled_sample
from .tables import Kernel, with_columns

# Characters that stand for the Latin letters they look like.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e",
}
# Signs that also end words stand for letters only before a letter or digit.
INNER_ONLY = "!|"


class _Folding(dict):
    """Code point -> folded text, filled as code points are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        low = char.lower()
        folded = HOMOGLYPHS.get(low, low)
        if char in INNER_ONLY or len(folded) != 1 or not (folded.isalpha() or folded == "ı"):
            folded = low[0] if len(low) > 1 and low[0].isalpha() else " "
        if folded == " " and unicodedata.category(char) in ("Mn", "Me", "Cf"):
            folded = ""  # marks on letters and characters without width don't end a word
        self[code] = folded
        return folded


_FOLDING = _Folding()


def fold(text: str) -> str:
    """The folded text after one space: compatibility forms (mathematical or wide letters, ligatures) first become plain ones."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    for sign in INNER_ONLY:
        if sign in text:
            at = [i for i, c in enumerate(text) if c == sign and i and text[i - 1].isalpha() and text[i + 1 : i + 2].isalpha()]
            if at:
                chars = list(text)
                for i in at:
                    chars[i] = HOMOGLYPHS[sign]
                text = "".join(chars)
    return " " + text.translate(_FOLDING)


@dataclass(frozen=True)
class Params:
    """`max_rows` bounds the labelled rows that are learned from, and so the lexicon. A term is a word's beginning of `shortest` to `longest` letters, or a whole word that is shorter or longer; it stands in `support` toxic texts and has a rate in them at least `odds` times that in others."""

    max_rows: int = 20_000
    shortest: int = 4
    longest: int = 9
    support: int = 4
    odds: float = 25.0


@dataclass(frozen=True)
class Lexicon:
    """Terms (folded, with their leading space) and weights, phrases in which they don't count, and the scale (constant, slope by total, slope by density)."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    scale: tuple[float, float, float] = field(default=(-4.0, 4.0, 0.0))


def candidates(folded: str, p: Params) -> set[str]:
    found = set()
    for word in set(folded.split()):
        found.update([" " + word[:n] for n in range(p.shortest, min(len(word), p.longest) + 1)])
        if not p.shortest <= len(word) <= p.longest:
            found.add(f" {word} ")
    return found


def _automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for term, weight in lexicon.terms.items():
        machine.add_word(term, (len(term), len(term.rstrip() or term), weight))
    for phrase in lexicon.exceptions:
        machine.add_word(phrase, (len(phrase), len(phrase), None))
    machine.make_automaton()
    return machine


def hits(folded: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the longest term at each place, without those inside an exception phrase."""
    if not len(machine):
        return []
    terms: dict[int, tuple[int, float]] = {}
    exempt: list[tuple[int, int]] = []
    for last, (length, size, weight) in machine.iter(f"{folded} "):
        start = last + 1 - length
        if last == len(folded) and size == length:
            continue  # only the end of a whole word may stand on the space that is added
        if weight is None:
            exempt.append((start, start + size))
        elif size > terms.get(start, (0, 0))[0]:
            terms[start] = (size, weight)
    exempt.sort()
    out, i, reach = [], 0, -1
    for start, (size, weight) in sorted(terms.items()):
        while i < len(exempt) and exempt[i][0] <= start:
            reach, i = max(reach, exempt[i][1]), i + 1
        if start + size > reach:
            out.append((start, start + size, weight))
    return out


def measures(folded: str, machine: ahocorasick.Automaton) -> tuple[float, float]:
    """log(1 + total weight), and log(1 + weight in a thousand characters)."""
    total = sum(w for _, _, w in hits(folded, machine))
    return float(np.log1p(total)), float(np.log1p(1000 * total / len(folded)))


def _counts(sample: DataFrame, emit) -> DataFrame:
    """(term, toxic, clean): texts of either label that hold what `emit` gives for a folded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen[label].update(emit(fold(text)))
        terms = sorted(seen[0].keys() | seen[1].keys())
        yield pa.record_batch([pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))], ["term", "toxic", "clean"])

    by = sample.select("text", "label").mapInArrow(run, "term string, toxic long, clean long")
    return by.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(25):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve(x.T @ (x * (s * (1 - s))[:, None]) + 0.05 * np.eye(3), x.T @ (s - y) + 0.05 * w)
    return tuple(map(float, w))


def learn(sample: DataFrame, params: Params | None = None, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon from (text, label) rows; without toxic rows it is empty and every score is low. Repeated rows count each; null texts have to be empty ones, as `labelled_sample` gives them. The order of rows makes no difference but for rounding."""
    p = params or Params()
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return Lexicon({}, tuple(exceptions))
    rate = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / max(1, clean))
    best = _counts(sample, functools.partial(candidates, p=p)).filter((F.col("toxic") >= p.support) & (rate >= p.odds))
    found = {r["term"]: float(r["w"]) for r in best.select("term", F.log(rate).alias("w"), "toxic").collect()}  # of the sample's words
    terms = {t: w for t, w in sorted(found.items()) if not any(t[:k] in found for k in range(p.shortest + 1, len(t)))}
    lexicon = Lexicon(terms, tuple(exceptions))

    def phrases(folded: str) -> set[str]:
        """Hit words with the word before and the word after."""
        machine, out = _cached(lexicon), set()
        for start, end, _ in hits(folded, machine):
            stop = folded.find(" ", end)
            stop = len(folded) if stop < 0 else stop
            out.add(" ".join([folded[start:stop], *folded[stop:].split(maxsplit=1)[:1]]))
            out.add(" " + " ".join([*folded[:start].rsplit(maxsplit=1)[-1:], folded[start + 1 : stop]]))
        return out

    exempt = _counts(sample, phrases).filter("toxic = 0 and clean >= 2").select("term")
    lexicon = Lexicon(terms, (*exceptions, *sorted(r["term"] for r in exempt.collect())))  # of the sample's phrases

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _cached(lexicon)
        for batch in batches:
            both = [measures(fold(t), machine) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("label"), *(pa.array([m[i] for m in both], pa.float64()) for i in (0, 1))], ["label", "total", "density"])

    rows = sample.select("text", "label").mapInArrow(measured, "label int, total double, density double").toArrow()
    x = np.column_stack([rows["total"].to_numpy(), rows["density"].to_numpy()])
    return Lexicon(terms, lexicon.exceptions, _logistic(x, rows["label"].to_numpy()))


_BUILT: list[tuple[Lexicon, ahocorasick.Automaton]] = []


def _cached(lexicon: Lexicon) -> ahocorasick.Automaton:
    """The automaton of the lexicon used last in this process."""
    if not _BUILT or _BUILT[0][0] != lexicon:
        _BUILT[:] = [(lexicon, _automaton(lexicon))]
    return _BUILT[0][1]


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """`docs` with toxicity (0 to 1) and n_hits; null and empty texts score as texts without a hit, repeated rows alike.

    Columns named toxicity or n_hits are replaced; others stay, whatever their
    names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def kernel() -> Kernel:
        machine, (a, b, c) = _cached(shared.value), shared.value.scale

        def made(texts: pa.Array) -> list[pa.Array]:
            scores, found = [], []
            for text in texts.to_pylist():
                folded = fold(text)
                own = hits(folded, machine)
                total = sum(w for _, _, w in own)
                x = a + b * np.log1p(total) + c * np.log1p(1000 * total / len(folded))
                scores.append(float(1 / (1 + np.exp(-np.clip(x, -35, 35)))))
                found.append(len(own))
            return [pa.array(scores, pa.float64()), pa.array(found, pa.int64())]

        return made

    return with_columns(docs, "text", {"toxicity": T.DoubleType(), "n_hits": T.LongType()}, kernel)


def fit_and_score(docs: DataFrame, labels: DataFrame, keep: F.Column, params: Params | None = None) -> DataFrame:
    """Learn from labelled rows of `docs` for which `keep` holds, then score every row.

    Null and empty texts score as texts without a hit, repeated rows alike. Of
    several labels of one id the larger counts; null ids, null labels and
    labels of absent ids are left out. Without documents there are no rows.
    """
    p = params or Params()
    return score(docs, learn(labelled_sample(docs, labels, "toxic", keep, p.max_rows), p))
