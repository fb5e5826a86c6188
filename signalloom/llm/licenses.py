"""License scans by patience alignment.

Around every occurrence of a template's rarest words, text and template are aligned: words that
occur once on both sides anchor, the longest increasing subsequence of anchors stays, and the
gaps between are aligned in the same way; a gap without anchors (a repeated notice) by its longest
common subsequence.  A licence is the stretch of matched words that scores best.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

_WORD = re.compile(r"[a-z0-9]+")
def common(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of a[a0:a1] and b[b0:b1]."""
    rows = [[0] * (b1 - b0 + 1)]
    for x in a[a0:a1]:
        last, row = rows[-1], [0]
        for j, y in enumerate(b[b0:b1]):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], a1 - a0, b1 - b0
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((a0 + i, b0 + j))
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, by patience alignment.  Equal words beside an anchor match
    first, and what matches before the first anchor does so as late as it can."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b), False, False)]  # and whether an anchor is on the left, on the right
    while gaps:
        a0, a1, b0, b1, left, right = gaps.pop()
        while left and a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while right and a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if count_b[w] == 1}
        anchors = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if count_a[w] == 1 and w in where]
        # Longest increasing subsequence of the template positions: patience piles with back links.
        tops: list[int] = []
        top_at: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(anchors):
            pile = bisect_left(tops, j)
            back.append(top_at[pile - 1] if pile else -1)
            tops[pile : pile + 1], top_at[pile : pile + 1] = [j], [n]
        chain, n = [], top_at[-1] if top_at else -1
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        chain.reverse()
        if not chain:
            if right and not left:
                out += [(a1 - 1 - i, b1 - 1 - j) for i, j in common(a[a0:a1][::-1], b[b0:b1][::-1], 0, a1 - a0, 0, b1 - b0)]
            else:
                out += common(a, b, a0, a1, b0, b1)
            continue
        out += chain
        ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        for n, ((i0, j0), (i1, j1)) in enumerate(zip(ends, ends[1:])):
            if i1 - i0 > 1 and j1 - j0 > 1:
                gaps.append((i0 + 1, i1, j0 + 1, j1, left or n > 0, right or n < len(chain)))
    return sorted(out)


@dataclass(frozen=True, order=True)
class Found:
    """A licence in a text: its words ``start`` to ``end`` (or characters), the words matched, and the
    score: those over the template's words and the text's words between them that match none."""

    name: str
    start: int
    end: int
    matched: int
    score: float


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.min_coverage = min_coverage
        self.templates = {name: _WORD.findall(text.lower()) for name, text in templates.items()}
        self.vocabulary = {w for words in self.templates.values() for w in words}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}

    def _best_stretch(self, at: list[int], size: int) -> tuple[float, int, int]:
        """Score, first and last of the stretch of matched words (their ascending places) that scores best."""
        best = (0.0, 0, 0)
        for i in range(len(at)):
            for j in range(len(at) - 1, i - 1, -1):
                n = j - i + 1
                if n / size < best[0]:
                    break
                best = max(best, (n / (size + at[j] - at[i] + 1 - n), i, j))
        return best

    def _in_window(self, name: str, words: list[str], lo: int, hi: int, enough: int) -> list[Found]:
        """Every occurrence of a template in words[lo:hi]: the best one, then those before and after it."""
        template, out, todo, seen = self.templates[name], [], [(lo, hi)], set()
        while todo:
            lo, hi = todo.pop()
            if hi - lo < enough or (lo, hi) in seen:
                continue
            seen.add((lo, hi))
            at = [lo + i for i, _ in align(words[lo:hi], template)]
            if len(at) < enough:
                continue
            score, i, j = self._best_stretch(at, len(template))
            if score >= self.min_coverage - 1e-9:
                out.append(Found(name, at[i], at[j] + 1, j - i + 1, score))
                todo += [(lo, at[i]), (at[j] + 1, hi)]
            else:
                # Words of several occurrences: each side of the widest gap, with the gap, on its own.
                k = max(range(len(at) - 1), key=lambda k: at[k + 1] - at[k], default=-1)
                if k >= 0 and at[k + 1] - at[k] > 1:
                    todo += [(lo, at[k + 1]), (at[k] + 1, hi)]
        return out

    def find(self, words: list[str]) -> list[Found]:
        """All licences of a text's words, without overlaps: of those that do, the one with more matched
        words stays (then the better score, then the first name)."""
        at = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.vocabulary:
                at[w].append(i)
        found: set[Found] = set()
        for name in sorted(self.templates):
            template, need = self.templates[name], self.counts[name]
            possible = sum(min(n, len(at[w])) if w in at else 0 for w, n in need.items())
            enough = math.ceil(self.min_coverage * len(template) - 1e-9)
            if not template or possible < enough:
                continue  # no alignment can reach the threshold
            # At least one of the words that may not all be missing stands in any match.
            missing = len(template) - enough + 1
            rarest = sorted((w for w in need if w in at), key=lambda w: (len(at[w]), w))[:missing]
            reach, done = 2 * len(template), -1
            for i in sorted({i for w in rarest for i in at[w]}):
                if i > done:
                    found.update(self._in_window(name, words, max(0, i - reach), min(len(words), i + reach + 1), enough))
                    done = i + len(template) // 2
        out: list[Found] = []
        for f in sorted(found, key=lambda f: (-f.matched, -f.score, f.name, f.start)):
            if all(f.end <= g.start or g.end <= f.start for g in out):
                out.append(f)
        return sorted(out, key=lambda f: f.start)

    def scan(self, text: str | None) -> tuple[str | None, float, int]:
        """Best licence of the whole text, its score and the number of its matched words."""
        return self.scan_all(text)[0]

    def scan_all(self, text: str | None) -> tuple[tuple[str | None, float, int], list[Found]]:
        """The best licence, and all with their characters' span in the text."""
        low = text.lower() if text else ""
        found = self.find(_WORD.findall(low))
        if not found:
            return (None, 0.0, 0), []
        best = min(found, key=lambda f: (-f.score, -f.matched, f.name))
        if len(low) == len(text):
            spans = [m.span() for m in _WORD.finditer(low)]
        else:  # a character whose lower case is longer: offsets of the original
            origin = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
            spans = [(origin[m.start()], origin[m.end() - 1] + 1) for m in _WORD.finditer(low)]
        return (best.name, best.score, best.matched), [Found(f.name, spans[f.start][0], spans[f.end - 1][1], f.matched, f.score) for f in found]


def license_scan(
    docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The licence texts and notices in every whole text.

    Returns doc_id, license (the best scored; null if none reaches ``min_coverage``), coverage (its
    score, or 0), matched_words, and ``found``: every licence without overlaps, in text order, with its
    characters' span.  The score is the share of matched words among the template's and those between
    them in the text that match none.  Ties go to more matched words, then to the first name.  Null and empty texts
    have none; null ids and repeated rows are scanned like any; empty table: no rows; other
    columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    names = ["license", "start", "end", "coverage", "matched_words"]
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                got = [scanner.scan_all(t) for t in batch.column(1).slice(a, 512).to_pylist()]
                best, coverage, words = zip(*(x for x, _ in got))
                found = [[dict(zip(names, (f.name, f.start, f.end, f.score, f.matched))) for f in own] for _, own in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 512), pa.array(best, pa.string()), pa.array(coverage, pa.float64()), pa.array(words, pa.int64()), pa.array(found, kind)],
                    names=["doc_id", "license", "coverage", "matched_words", "found"],
                )

    schema = "doc_id long, license string, coverage double, matched_words long, found array<struct<license: string, start: long, end: long, coverage: double, matched_words: long>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
