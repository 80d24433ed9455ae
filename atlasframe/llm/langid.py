"""Language identification by cross-parsing against suffix automata.

For each labelled language a suffix automaton holds a bounded sample of its text.  A document is
parsed greedily against each: a phrase is the longest match with the sample, the next one starts
where it ended.  The language that needs the fewest phrases, each weighted by the bits that point
into its sample, wins; a letter that the sample lacks is a phrase and is spelled out besides.

Texts are parsed whole, as runs of letters in lower case with one space between; phrases run on over
spaces and through runs of any length.  Samples are what is sent to workers, each of which builds the
automata once.  The winner fits if its parse costs no more than a pointer for each letter: of a text
that doesn't, in letters that no sample has, no learned language says anything.

A null text or one without a letter gives ``und`` with score 0, as do all texts if nothing was learned,
and doesn't fit.  Equal counts go to the smaller label.  Repeated rows get equal results and an empty
table an empty one.  Columns whose names clash with the added ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: The fit's bounds: distinct texts a language (as expected), and letters of its sample.
SAMPLE_TEXTS, SAMPLE_CHARS = 200, 60_000
#: Bits of a code point.
LETTER_BITS = 21
_RUN = re.compile(r"[^\W\d_]+")


def spaced(text: str) -> str:
    """The runs of letters of ``text``, in lower case, with a space before, between and after."""
    return f" {' '.join(_RUN.findall(text.lower()))} "


class SuffixAutomaton:
    """All substrings of ``text``.  A state is a dictionary from a letter to the next state."""

    def __init__(self, text: str):
        states: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(states)
            states.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in states[p]:
                states[p][c] = cur
                p = link[p]
            if p >= 0:
                q = states[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(states)
                    states.append(states[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and states[p].get(c) == q:
                        states[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        for state in states:
            for c, to in state.items():
                state[c] = states[to]
        self.root = states[0]
        self.bits = math.log2(len(text) + 2)

    def parse(self, text: str) -> tuple[int, int]:
        """How many longest matches, one after another, make up ``text``, and how many letters of it are
        unseen, each of which is a phrase of its own."""
        state = root = self.root
        n = unseen = 0
        for c in text:
            if c in state:
                state = state[c]
            elif c in root:
                n += 1
                state = root[c]
            else:
                n += state is not root
                unseen += 1
                state = root
        return n + unseen + (state is not root), unseen

    def cost(self, text: str) -> float:
        """The bits of the parse: a pointer into the sample a phrase, and an unseen letter spelled out."""
        phrases, unseen = self.parse(text)
        return phrases * self.bits + unseen * LETTER_BITS


class Languages:
    """The learned samples, by label in order, and their automata, built where they are first used."""

    def __init__(self, samples: dict[str, list[str]], chars: int = SAMPLE_CHARS):
        cut = {label: " ".join(_RUN.findall(" ".join(samples[label]).lower()))[:chars] for label in sorted(samples)}
        self.samples = {label: text for label, text in cut.items() if text}
        self._automata: list[SuffixAutomaton] | None = None

    def __getstate__(self):
        return {"samples": self.samples, "_automata": None}

    @property
    def labels(self) -> list[str]:
        return list(self.samples)

    @property
    def automata(self) -> list[SuffixAutomaton]:
        if self._automata is None:
            self._automata = [SuffixAutomaton(f" {text} ") for text in self.samples.values()]
        return self._automata

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The label of the cheapest parse, its margin over the second, and whether it fits."""
        parsed = spaced(text) if text else ""
        if not self.samples or not any(map(str.isalpha, parsed)):
            return "und", 0.0, False
        bits = [a.cost(parsed) for a in self.automata]
        best = min(bits)
        at = bits.index(best)
        label = self.labels[at]
        fits = best <= len(parsed) * self.automata[at].bits
        if len(bits) == 1:
            return label, 1.0, fits
        second = sorted(bits)[1]
        return label, (second - best) / second, fits


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> Languages:
    """Fit on about ``texts`` distinct texts a language, those of the smallest hashes, cut to ``chars``
    letters in all: that many go to the driver, whatever the table's size.  Rows without a text or a
    label teach nothing."""
    rows = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    rows = rows.withColumn("h", F.xxhash64("t"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return Languages({})
    share = {k: min(1.0, texts / max(1, n)) if n > texts else 1.0 for k, n in sizes.items()}
    limit = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)])[F.col("l")]
    drawn = rows.where((F.col("h").cast("double") / 2.0**64 + 0.5) <= limit)
    drawn = drawn.groupBy("l", "h").agg(F.first(F.substring("t", 1, chars)).alias("t"))
    samples: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.toLocalIterator():
        samples.setdefault(r["l"], []).append((r["h"], r["t"]))
    return Languages({k: [t for _, t in sorted(v)] for k, v in samples.items()}, chars)


def identify(docs: DataFrame, languages: Languages, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, the margin over the second language (0 to 1), and ``fits``."""
    names = ("lang_pred", "score", "fits")
    kept = [f for f in docs.schema.fields if f.name not in names]
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*kept, *map(T.StructField, names, kinds)])
    model = docs.sparkSession.sparkContext.broadcast(languages)
    at = [f.name for f in kept].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.value.predict(t) for t in batch.column(at).to_pylist()]
            added = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

    return docs.select([f.name for f in kept]).mapInArrow(run, schema)
