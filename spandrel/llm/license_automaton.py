"""Licence scanning with a generalised suffix automaton of licence tokens.

All phrases and notices go into one suffix automaton over words.  A text streams
through it once: the state and match length after each word are its matching
statistics.  Phrases that end at a word are read off the state; long matches are
chained, notice by notice, into spans that are covered in order, and a notice
counts when enough of it is covered.

Words are maximal runs of ASCII letters, digits and non-ASCII characters of the
text with A-Z in lower case.  Words that no licence has end every match, so a
batch is reduced to runs of licence words before the automaton steps through it.

Edge cases: a null or empty text has no words, no labels and a score of 0;
repeated rows are all answered; an empty table gives an empty result; a text of
any length is streamed whole; extra columns are never touched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import base, license_texts, textbytes
from .base import any_key, read, ship, slices, text_buffer

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a match that may become part of a span, and of the gap that a chain may bridge.
LEAST_MATCH, MOST_GAP = 5, 12
#: A notice counts if this share of its words and at least so many words are covered in order.
LEAST_SHARE, LEAST_COVERED = 0.5, 8


def tokens(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass
class Automaton:
    """Generalised suffix automaton; ``ends``: per state the (template, place after it) where its longest string ends."""

    follow: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, size: int, follow: dict[int, int], link: int) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.size.append(size)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the shorter strings of ``q`` that come by ``w`` from ``p``."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(self.size[p] + 1, dict(self.follow[q]), self.link[q])
        while p >= 0 and self.follow[p].get(w) == q:
            self.follow[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[int], template: int) -> None:
        last = 0
        for place, w in enumerate(words, 1):
            q = self.follow[last].get(w)
            if q is not None:
                last = self._split(last, w, q)
            else:
                new, p = self._state(self.size[last] + 1, {}, 0), last
                while p >= 0 and w not in self.follow[p]:
                    self.follow[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, w, self.follow[p][w])
                last = new
            self.ends[last].append((template, place))

    def finish(self) -> None:
        """Hands every end down the suffix links, so that a state knows all places where its strings end."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]].extend(self.ends[v])


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str]]):
        texts = [(label, tokens(text), True) for text, label in phrases.items()] + [(label, tokens(text), False) for label, text in notices]
        words = sorted({w for _, ws, _ in texts for w in ws})
        raw, offsets = text_buffer(pa.array([" ".join(words)]))
        starts, _, _ = textbytes.spans(raw, offsets, True)
        prints = textbytes.fingerprints(raw, starts, True)
        order = np.argsort(prints)
        self.prints, self.ids = prints[order], (order + 1).astype(np.int64)
        number = {w: i + 1 for i, w in enumerate(words)}
        self.labels = [label for label, _, _ in texts]
        self.sizes = [len(ws) for _, ws, _ in texts]
        self.automaton = Automaton()
        for t, (_, ws, _) in enumerate(texts):
            self.automaton.add([number[w] for w in ws], t)
        self.automaton.finish()
        phrase = {t for t, (_, _, is_phrase) in enumerate(texts) if is_phrase}
        a = self.automaton
        #: Phrases that end with a state, if the match is long enough, among them those of shorter suffixes.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in a.size]
        for v in sorted(range(1, len(a.size)), key=a.size.__getitem__):
            own = [(t, self.sizes[t]) for t, place in set(a.ends[v]) if t in phrase and place == self.sizes[t] and a.size[a.link[v]] < place <= a.size[v]]
            self.phrases[v] = own + self.phrases[a.link[v]]
        self.notice = [t not in phrase for t in range(len(texts))]
        self.shortest = min(self.sizes, default=1)

    def known(self, prints: np.ndarray) -> np.ndarray:
        """Number of each licence word, 0 for other words."""
        at = np.searchsorted(self.prints, prints)
        at[at == len(self.prints)] = 0
        return np.where(self.prints[at] == prints, self.ids[at], 0)

    def scan(self, runs: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
        """Phrase hits (template, first word, size) and covered notice spans (template, first word, end, covered words) of a text's runs."""
        follow, link, size, phrases = self.automaton.follow, self.automaton.link, self.automaton.size, self.phrases
        hits: list[tuple[int, int, int]] = []
        matches: list[tuple[int, int, int, int]] = []
        for start, words in runs:
            state = length = 0
            for i, w in enumerate(words, start):
                to = follow[state].get(w)
                if to is None:
                    if length >= LEAST_MATCH:
                        matches.extend((t, i - length, i, place) for t, place in self.automaton.ends[state] if self.notice[t])
                    while state and to is None:
                        state = link[state]
                        length = size[state]
                        to = follow[state].get(w)
                    if to is None:
                        length = 0
                        continue
                state = to
                length += 1
                for t, n in phrases[state]:
                    if n <= length:
                        hits.append((t, i - n + 1, n))
            if length >= LEAST_MATCH:
                end = start + len(words)
                matches.extend((t, end - length, end, place) for t, place in self.automaton.ends[state] if self.notice[t])
        return hits, chain(matches)

    def spans(self, covered: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """The covered spans that suffice for their notice's label."""
        return [c for c in covered if c[3] >= LEAST_COVERED and c[3] >= LEAST_SHARE * self.sizes[c[0]]]


def chain(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Per notice, matches (template, from, to, place after it) that follow each other in text and notice with small gaps, as one span."""
    done: list[tuple[int, list[int]]] = []
    open_chains: dict[int, list[list[int]]] = {}
    for t, a, z, place in sorted(matches, key=lambda m: (m[0], m[1], m[3])):
        chains = open_chains[t] = [c for c in open_chains.get(t, ()) if a - c[1] <= MOST_GAP]
        for c in reversed(chains):
            # A match may begin inside the one before it; only what is new counts.
            over = max(0, c[1] - a, c[2] - (place - (z - a)))
            if z > c[1] and place > c[2] and a - c[1] <= MOST_GAP and place - (z - a) - c[2] <= MOST_GAP and over < z - a:
                c[1], c[2], c[3] = z, place, c[3] + z - a - over
                break
        else:
            chains.append([a, z, place, z - a])
            done.append((t, chains[-1]))
    return [(t, a, z, n) for t, (a, z, _, n) in done]


@any_key("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score")
def scan_licenses(docs: DataFrame, key: str, text: str = "text", phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row of ``docs``: words, phrase hits, covered spans, labels and a score.

    ``spans``: array of (label, first word, end word, covered words) that count; ``score``: the
    largest covered share of a phrase or notice.
    """
    scanner = Scanner(license_texts.PHRASES if phrases is None else phrases, license_texts.NOTICES if notices is None else notices)
    key_type = docs.schema[key].dataType.simpleString()

    def scan(batches):
        for batch in slices(batches, text):
            raw, offsets = text_buffer(batch.column(text))
            prints, at = textbytes.prints(raw, offsets, True)
            known = scanner.known(prints)
            inside = known > 0
            edges = np.zeros(len(known) + 1, bool)
            edges[at] = True
            before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
            first = np.flatnonzero(inside & (~before | edges[:-1]))
            after = np.concatenate((inside[1:], [False])) if len(inside) else inside
            last = np.flatnonzero(inside & (~after | edges[1:])) + 1
            long = last - first >= scanner.shortest
            first, last = first[long], last[long]
            doc = np.searchsorted(at, first, side="right") - 1
            runs: dict[int, list[tuple[int, list[int]]]] = {}
            for d, a, z in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True):
                runs.setdefault(d, []).append((a - int(at[d]), known[a:z].tolist()))
            rows = []
            for d in range(batch.num_rows):
                hits, covered = scanner.scan(runs[d]) if d in runs else ([], [])
                good = scanner.spans(covered)
                base_labels = sorted({scanner.labels[t] for t, _, _ in hits})
                rows.append({
                    "n_words": int(at[d + 1] - at[d]), "n_base": len(hits),
                    "first_word": min((a for _, a, _ in hits), default=None), "last_word": max((a for _, a, _ in hits), default=None),
                    "base_labels": base_labels, "labels": sorted({*base_labels, *(scanner.labels[t] for t, *_ in good)}),
                    "spans": [{"label": scanner.labels[t], "start": a, "end": z, "covered": n} for t, a, z, n in sorted(good, key=lambda c: c[1:])],
                    "score": max([float(bool(hits)), *(min(1.0, n / scanner.sizes[t]) for t, _, _, n in covered)]),
                })
            out = pa.Table.from_pylist(rows, schema=_ROW)
            yield pa.RecordBatch.from_arrays([batch.column(key), *(c.combine_chunks() for c in out.columns)], [key, *_ROW.names])

    ship(__name__, base.__name__, textbytes.__name__)
    return docs.select(key, text).mapInArrow(scan, f"`{key}` {key_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, spans array<struct<label:string,start:bigint,end:bigint,covered:bigint>>, score double")


_ROW = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64())]))), ("score", pa.float64()),
])


def op4_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return found.selectExpr("doc_id", "n_words", "n_base", "first_word", "last_word", "array_join(base_labels, ',') AS base_labels", "array_join(labels, ',') AS labels", "score")


QUERIES = {"op4_license_automaton": op4_license_automaton}
ORACLES: dict[str, str] = {}
