"""License scans: normalised text against licence templates by the Dice coefficient of their word bigrams.

A licence stands in a document as a line, as a paragraph (lines between blank ones) or as the whole text, so these units are compared. A
unit with ``a`` distinct bigrams and a template with ``b`` reach a Dice coefficient of t only if neither is more than
(2 - t) / t times the other and they share at least t * (a + b) / 2: the counts of bigrams that occur in any template prune units, and sizes prune
templates, before sets of word pairs are compared exactly.

A licence also stands in the midst of other text: as some paragraphs of a longer document, in a comment block, on a line with other words.
``scan_licence_runs`` therefore compares, besides the units, every run of consecutive words that has no more bigrams (repeated ones
counted) than (2 - t) / t times the template's. The best run begins and ends with a bigram of the template, and only starts that are
followed by enough of its bigrams are tried. Everything runs where the document is; the templates are a
short, given list.

Defined results: null or wordless text has no licence; a unit of one word has no bigram and matches nothing; of equal Dice
coefficients a line precedes a paragraph, that the whole text and that a run, then the earlier and of runs the shorter one counts; repeated rows are reported each; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import lowered, shingles_of, words_of
from .licence_templates import TEMPLATES
from .text import alnum_table, fold, slices, word_hashes

PERCENT = 80
UNITS = ("line", "paragraph", "text", "run")
FOUND = "array<struct<license:string,dice:double,unit:string,position:long>>"
_TABLE = alnum_table()


class Templates:
    def __init__(self, templates: Sequence[tuple[str, str]], percent: int):
        self.names = [n for n, _ in templates]
        texts = [t.as_py() for t in lowered(pa.array([t for _, t in templates])).cast(pa.binary())]
        self.pairs = [shingles_of(words_of(t), 2) for t in texts]
        self.percent = percent
        hashes, first, _, _ = word_hashes(texts, _TABLE)
        self.known = np.unique(np.concatenate([fold(hashes[a:b], 2) for a, b in zip(first[:-1], first[1:])]))
        self.probe = np.zeros(1 << 16, bool)
        self.probe[self.known >> np.uint64(48)] = True
        self.smallest = min(len(p) for p in self.pairs if p)
        self.member = np.array([np.isin(self.known, fold(hashes[a:b], 2)) for a, b in zip(first[:-1], first[1:])])

    def hits(self, run: np.ndarray) -> np.ndarray:
        """Which bigrams occur in any template."""
        out = self.probe[run >> np.uint64(48)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.known, run[at]), len(self.known) - 1)
        out[at] = self.known[place] == run[at]
        return out

    def dice(self, text: bytes) -> list[tuple[int, float]]:
        """Templates that the unit's text reaches."""
        own, t = shingles_of(words_of(text), 2), self.percent
        out = []
        for i, pairs in enumerate(self.pairs):
            a, b = len(own), len(pairs)
            if own and b and t * max(a, b) <= (200 - t) * min(a, b):
                shared = len(own & pairs)
                if 200 * shared >= t * (a + b):
                    out.append((i, 2 * shared / (a + b)))
        return out

    def best_runs(self, run: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first word, words) of the best run of words of each template that one reaches, from the bigrams of one text."""
        at = np.flatnonzero(hit)
        ids = np.searchsorted(self.known, run[at])
        previous, t, out = None, self.percent, []
        for k, pairs in enumerate(self.pairs):
            b = len(pairs)
            need, most = -(-t * b // (200 - t)), (200 - t) * b // t
            own = at[self.member[k][ids]]
            if not b or len(own) < need:
                continue
            tried = own[: len(own) - need + 1]
            tried = tried[own[need - 1 :] - tried < most]
            if not len(tried):
                continue
            if previous is None:  # where a bigram stood last: one before the start of a run is new in it
                order = np.argsort(run, kind="stable")
                previous = np.full(len(run), -1)
                same = run[order[1:]] == run[order[:-1]]
                previous[order[1:][same]] = order[:-1][same]
            mine = np.zeros(len(run), bool)
            mine[own] = True
            best = (0.0, 0, 0)
            for start in tried.tolist():
                new = previous[start : start + most] < start
                a, shared = np.cumsum(new), np.cumsum(new & mine[start : start + most])
                dice = np.where(200 * shared >= t * (a + b), 2 * shared / (a + b), 0.0)
                end = int(np.argmax(dice))
                if dice[end] > best[0]:
                    best = (dice[end], start, end + 2)
            if best[0]:
                out.append((k, *best[1:]))
        return out

    def scan(self, texts: list[bytes], runs: bool = False) -> list[list[dict]]:
        words, first, begin, end = word_hashes(texts, _TABLE)
        run = fold(words, 2)
        hit = self.hits(run)
        counts = np.concatenate(([0], np.cumsum(hit)))
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        found: list[list[dict]] = [[] for _ in texts]
        for i, text in enumerate(texts):
            a, b = first[i], first[i + 1]
            if b - a < 2 or counts[b - 1] - counts[a] < self._need():
                continue
            best: dict[str, tuple] = {}
            for kind, position, s, e in units(text):
                lo, hi = np.searchsorted(begin[a:b], (starts[i] + s, starts[i] + e)) + a
                if hi - lo < 2 or counts[hi - 1] - counts[lo] < self._need():
                    continue
                pairs = run[lo : hi - 1]
                if (200 - self.percent) * len(np.unique(pairs[hit[lo : hi - 1]])) < self.percent * len(np.unique(pairs)):
                    continue
                for k, dice in self.dice(text[s:e]):
                    rank = (-dice, kind, position)
                    if self.names[k] not in best or rank < best[self.names[k]]:
                        best[self.names[k]] = rank
            for k, word, n in self.best_runs(run[a : b - 1], hit[a : b - 1]) if runs else ():
                part = text[begin[a + word] - starts[i] : end[a + word + n - 1] - starts[i]]
                for dice in (d for j, d in self.dice(part) if j == k):
                    rank = (-dice, 3, word)
                    if self.names[k] not in best or rank < best[self.names[k]]:
                        best[self.names[k]] = rank
            found[i] = [{"license": n, "dice": -r[0], "unit": UNITS[r[1]], "position": r[2]} for n, r in sorted(best.items())]
        return found

    def _need(self) -> int:
        """Fewest shared bigrams of any match."""
        return -(-self.percent * self.smallest // (200 - self.percent))


def units(text: bytes) -> list[tuple[int, int, int, int]]:
    """(kind, position, start, end) of the lines, paragraphs and whole text; a one-line paragraph is its line."""
    out, at, n, open_at, lines = [], 0, 0, None, 0
    rows = text.split(b"\n")
    paragraph = 0
    for row in [*rows, b""]:
        blank = not words_of(row)
        if not blank:
            out.append((0, n, at, at + len(row)))
            if open_at is None:
                open_at, lines = at, 0
            lines, last = lines + 1, at + len(row)
        elif open_at is not None:
            if lines > 1:
                out.append((1, paragraph, open_at, last))
            paragraph, open_at = paragraph + 1, None
        at, n = at + len(row) + 1, n + 1
    out.append((2, 0, 0, len(text)))
    return out


@lru_cache(2)
def prepared(templates: tuple[tuple[str, str], ...], percent: int) -> Templates:
    """One a worker, kept between batches."""
    return Templates(templates, percent)


def licences(templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT, runs: bool = False):
    """A column function: text to its licences, the best unit of each, or the best of units and runs of words."""
    row = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("unit", pa.string()), ("position", pa.int64())])

    @F.arrow_udf(FOUND)
    def find(text: pa.Array) -> pa.Array:
        scan = prepared(templates, percent).scan
        return pa.array([f for _, texts in slices(lowered(text)) for f in scan(texts, runs)], pa.list_(row))

    return find


def scan_licences(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """One row per document and licence: doc_id, license, dice, unit, position."""
    return docs.select(doc_id.alias("doc_id"), F.explode(licences()(text)).alias("f")).select("doc_id", "f.*")


def scan_licence_runs(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """The same rows over units and runs of words; the position of a run is that of its first word in the text."""
    return docs.select(doc_id.alias("doc_id"), F.explode(licences(runs=True)(text)).alias("f")).select("doc_id", "f.*")
