"""Evaluation texts leaking into training texts.

The test items form a BM25 inverted index, whose terms are short sequences of words (single words of test
items are common in a training corpus of the same field, their sequences are not). Every training text is cut into overlapping
passages, and each passage is a query: block-max WAND retrieves all items whose score reaches the item's threshold, and the
shared words are then verified in order.

The threshold loses nothing. An item's score is divided by the least score that any `run` consecutive words of it
would give, so a passage that holds such a run scores at least 1, whatever else it holds. Passages of run + STEP - 1
words that start every STEP words hold every run of the text whole. A passage whose terms' greatest weights sum up to less than
1 has no pivot, and is passed over without walking any list.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgraph.plans.shared import kept

RUN = 12
K1, B = 1.2, 0.75
BLOCK = 16
STEP = 8
TERM_WORDS = 3
ITEMS_AN_INDEX = 20_000
BYTES_A_READ = 64_000_000
ROWS_A_BATCH = 256
_WORDS = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[" + "".join(rf"\U{c:08x}" for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf") + "]+")


def words(text: str | None) -> list[str]:
    """NFKC, without format characters, lower-cased; maximal runs of letters and digits. Null and empty texts have none."""
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return _WORDS.findall(text.lower())


class Postings:
    """One term's items in order, their weights, and the greatest weight of each block."""

    __slots__ = ("items", "weights", "top", "block_top", "block_last")

    def __init__(self, pairs: list[tuple[int, float]]):
        self.items = [i for i, _ in pairs]
        self.weights = [w for _, w in pairs]
        self.top = max(self.weights)
        self.block_top = [max(self.weights[k : k + BLOCK]) for k in range(0, len(pairs), BLOCK)]
        self.block_last = [self.items[min(k + BLOCK, len(pairs)) - 1] for k in range(0, len(pairs), BLOCK)]


def sequences(ws: list[str]) -> Iterator[tuple[str, ...]]:
    """The terms of a text: its sequences of TERM_WORDS words."""
    return zip(*(ws[k:] for k in range(TERM_WORDS)))


class Index:
    """BM25 over the items' terms, each item's weights divided by its threshold. Items with fewer words than `run` can't leak."""

    def __init__(self, passages: Sequence[str | None], run: int = RUN):
        self.run = run
        texts = [words(p) for p in passages]
        terms = [list(sequences(t)) if len(t) >= run else [] for t in texts]
        seen = Counter(w for t in terms for w in set(t))
        n, mean = max(1, sum(map(bool, terms))), sum(map(len, terms)) / max(1, sum(map(bool, terms)))
        idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in seen.items()}
        postings: dict[tuple[str, ...], list[tuple[int, float]]] = defaultdict(list)
        self.runs: list[frozenset[tuple[str, ...]]] = []
        inside = run - TERM_WORDS + 1  # terms in a run
        for i, (text, t) in enumerate(zip(texts, terms)):
            weight = {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean)) for w, tf in Counter(t).items()}
            least = min((sum(weight[w] for w in set(t[k : k + inside])) for k in range(len(t) - inside + 1)), default=1.0)
            for w, x in weight.items():
                postings[w].append((i, x / least))
            self.runs.append(frozenset(tuple(text[k : k + run]) for k in range(len(text) - run + 1)))
        self.terms = {w: k for k, w in enumerate(postings)}
        self.postings = [Postings(p) for p in postings.values()]
        self.top = np.array([p.top for p in self.postings] + [0.0])  # the last is for other terms

    def wand(self, terms: Sequence[int], threshold: float = 1.0 - 1e-9) -> list[int]:
        """All items whose score for the distinct terms reaches the threshold."""
        hits: list[int] = []
        live = [[self.postings[t].items[0], 0, self.postings[t]] for t in terms]  # item, place, postings
        while live:
            live.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(live):
                bound += c[2].top
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            upper, after = 0.0, None
            for c in live[: pivot + 1]:  # the blocks that would hold the pivot
                p, b = c[2], c[1] // BLOCK
                b = bisect_left(p.block_last, item, b)
                if b < len(p.block_last):
                    upper += p.block_top[b]
                    after = p.block_last[b] if after is None else min(after, p.block_last[b])
            if upper < threshold:
                target = item + 1 if after is None else after + 1
                if pivot + 1 < len(live):
                    target = min(target, live[pivot + 1][0])
                target = max(target, item + 1)
            elif live[0][0] == item:
                if sum(c[2].weights[c[1]] for c in live[: pivot + 1]) >= threshold:
                    hits.append(item)
                target = item + 1
            else:
                target = item
            moved = []
            for c in live[: pivot + 1]:
                items, k = c[2].items, c[1]
                k = bisect_left(items, target, k)
                if k < len(items):
                    moved.append([items[k], k, c[2]])
            live = moved + live[pivot + 1 :]
        return hits

    def leaked(self, text: str | None) -> list[int]:
        """The items of which the text holds `run` consecutive words, in order and adjacent."""
        found: set[int] = set()
        ws = words(text)
        if len(ws) < self.run or not self.postings:
            return []
        other, get = len(self.postings), self.terms.get
        terms = np.fromiter((get(w, other) for w in sequences(ws)), np.int64, len(ws) - TERM_WORDS + 1)
        if (terms == other).all():
            return []
        sums = np.concatenate([[0.0], np.cumsum(self.top[terms])])
        starts = np.arange(0, len(ws) - self.run + 1, STEP)
        ends = np.minimum(starts + self.run + STEP - TERM_WORDS, len(terms))
        for k in np.flatnonzero(sums[ends] - sums[starts] >= 1.0 - 1e-6):
            start, end = int(starts[k]), int(ends[k])
            candidates = [i for i in self.wand(list({int(t) for t in terms[start:end]} - {other})) if i not in found]
            if candidates:
                here = {tuple(ws[j : j + self.run]) for j in range(start, min(start + STEP, len(ws) - self.run + 1))}
                found.update(i for i in candidates if not here.isdisjoint(self.runs[i]))
        return sorted(found)


@lru_cache(2)
def _index(passages: tuple[str | None, ...]) -> Index:
    """The last two of a Python worker."""
    return Index(passages)


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, answer_found): the documents whose text holds RUN consecutive words of an item's passage.

    answer_found tells whether the item's answer also stands in the text, as consecutive words; null if the
    answer has none. Null and empty texts hold nothing; passages of fewer than RUN words, and null ones, can't leak; openings
    that items share count for each of them. Repeated rows of eval_items count once, several items of one id as one; the pair comes once. Whole texts are
    searched, for all items: ITEMS_AN_INDEX items make an index, and one read of documents serves all indexes, which a worker builds in turn for
    each batch, so its memory holds two. A read carries items of up to BYTES_A_READ; further items take a further read.
    """
    items = kept(eval_items.select("item_id", F.col("passage").cast("string"), F.col("answer").cast("string")).distinct())
    size = items.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in items.columns), F.lit(32)))).first()[0] or 0
    reads = -(-size * 2 // BYTES_A_READ) or 1
    out = None
    for k in range(reads):
        part = _leaks_of(documents, items if reads == 1 else items.filter(F.pmod(F.xxhash64("item_id", "passage", "answer"), F.lit(reads)) == k))
        out = part if out is None else out.unionByName(part)
    return out if reads == 1 else out.groupBy("doc_id", "item_id").agg(F.max("answer_found").alias("answer_found"))


def _leaks_of(documents: DataFrame, items: DataFrame) -> DataFrame:
    """For distinct items whose size was checked."""
    rows = sorted(((r[0], r[1], r[2]) for r in items.collect()), key=repr)
    indexes = [tuple(rows[k : k + ITEMS_AN_INDEX]) for k in range(0, len(rows), ITEMS_AN_INDEX)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replies = [[" ".join(words(r[2])) for r in some] for some in indexes]
        for whole in batches:
            pieces = [whole] if len(indexes) > 1 else [whole.slice(begin, ROWS_A_BATCH) for begin in range(0, whole.num_rows, ROWS_A_BATCH)]
            for batch in pieces:
                pairs: dict[tuple[int, str], bool | None] = {}
                docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for some, answers in zip(indexes, replies):
                    index = _index(tuple(r[1] for r in some))
                    for at, text in enumerate(texts):
                        if hits := index.leaked(text):
                            spaced = f" {' '.join(words(text))} "
                            for i in hits:
                                said, pair = f" {answers[i]} " in spaced if answers[i] else None, (at, some[i][0])
                                pairs[pair] = said if pairs.get(pair) is None else pairs[pair] or bool(said)
                columns = [pa.array([docs[p[0]] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string()), pa.array(list(pairs.values()), pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "answer_found"])

    return documents.select("doc_id", "text").mapInArrow(search, "doc_id bigint, item_id string, answer_found boolean")
