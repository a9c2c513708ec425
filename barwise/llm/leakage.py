"""Evaluation texts leaking into training text (problem 8).

The held-out items form an inverted index whose terms are pairs of neighbouring words, with
BM25 impacts: each pair has its postings (items and impacts) in blocks of items, the largest
impact of every block and the largest of all.  Every passage (overlapping windows of
words) of every document is a query, answered as by block-max WAND, for all passages of a
batch side by side:

1. a passage whose summed largest impacts miss every threshold is dropped;
2. its pairs are put in order of their largest impacts; up to the pivot, at which the sum reaches the least
   threshold, they cannot make an item by themselves, so only postings from the pivot on are opened;
3. of the blocks these lead to, those whose block maxima over all pairs of the passage miss the
   block's threshold are skipped;
4. the items of the other blocks are scored.

No bound is ever below the score, so all items above the threshold of a short passage are
retrieved.  A document's passages add up, so that short scattered passages which only
together make up a leak are found: (document, item) goes on from the score of ``least_words``
damaged words on.  What is retrieved is verified: first by the order and rarity of the pairs, then by
local alignment of the words.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barwise.llm.words import folded, words

K1, B = 1.2, 0.75
WINDOW, STRIDE, BLOCK = 40, 20, 16
#: Windows worked on side by side.
WINDOWS = 16_384
SHIFT, BREAK = 4, 8  # words by which a passage may be shifted inside; more words skipped than this make two passages
RUN_PAIRS, LEAST_PAIRS, LIGHT = 3, 8, 0.5


@dataclass(frozen=True)
class LeakRule:
    """``least_words`` words of the item in all, in passages of at least ``least_passage`` words of which the share ``agree``
    agree (``agree_weight`` when words count by their rarity), make a leak.

    ``part`` sets the BM25 scores from which something is looked at: a passage from that part of what the item's weakest
    intact passage of ``least_passage`` words scores, a document from that part for ``least_words`` words.  Where 28 % of
    the words are changed about half of the word pairs are left, where they are changed in the worst places a third.
    """

    part: float = 0.3
    least_words: int = 20
    least_passage: int = 8
    agree: float = 0.72
    agree_weight: float = 0.66


class _Vocabulary(dict):
    """Word -> term number; words that fold to no term of the index give -1."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        got = self[word] = self.terms.get(folded(word), -1)
        return got


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, member) of all members of the ranges [lo, hi)."""
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]


def _smallest_window(values: np.ndarray, width: int) -> float:
    """The smallest sum of ``width`` neighbours; infinite where there are fewer."""
    run = np.r_[0.0, np.cumsum(values)]
    return float((run[width:] - run[:-width]).min()) if len(values) >= width else np.inf


class Items:
    """The words of all items and what is counted over all of them, whichever part of them an index holds."""

    def __init__(self, items: Iterable[tuple[int, str]]) -> None:
        self.terms: dict[str, int] = {}
        self.ids, self.words = [], []
        for i, text in items:
            self.ids.append(i)
            self.words.append(np.array([self.terms.setdefault(folded(w), len(self.terms)) for w in words(text or "")], "int32"))
        n, v = len(self.ids), max(1, len(self.terms))
        self.base = np.int64(v)
        df = np.bincount(np.concatenate([*[np.unique(w) for w in self.words], np.array([], "int32")]).astype(int), minlength=v)
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype("float32")
        self.mean = max(1.0, float(np.mean([len(w) for w in self.words]))) if n else 1.0
        self.pair, df = np.unique(np.concatenate([*[np.unique(self.pairs(w)) for w in self.words], np.array([], "int64")]), return_counts=True)
        self.pair_idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def pairs(self, w: np.ndarray) -> np.ndarray:
        return w[:-1].astype("int64") * self.base + w[1:]


class Index:
    """Postings of the items ``lo`` to ``hi``, with impacts by the counts over all items."""

    def __init__(self, items: Items, rule: LeakRule | None = None, lo: int = 0, hi: int | None = None) -> None:
        rule = rule or LeakRule()
        self.ids, self.words = np.array(items.ids[lo:hi], "int64"), items.words[lo:hi]
        self.idf, self.base, self.pair = items.idf, items.base, items.pair
        self.vocabulary = _Vocabulary(items.terms)
        n, v = len(self.ids), len(self.pair)
        term, item, impact, self.passage, self.document = [], [], [], np.full(n, np.inf), np.full(n, np.inf)
        for i, w in enumerate(self.words):
            at = np.searchsorted(items.pair, items.pairs(w))
            t, tf = np.unique(at, return_counts=True)
            hit = items.pair_idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / items.mean))
            term.append(t), item.append(np.full(len(t), i)), impact.append(hit)
            if len(w) >= rule.least_words:
                per_pair = hit[np.searchsorted(t, at)]
                self.passage[i] = rule.part * _smallest_window(per_pair, rule.least_passage - 1)
                self.document[i] = rule.part * _smallest_window(per_pair, rule.least_words - 1)
        join = lambda parts, kind: np.concatenate([*parts, np.array([], kind)]).astype(kind)
        term, item, impact = join(term, "int64"), join(item, "int64"), join(impact, "float64")
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order], impact[order]
        # one entry for each pair and block of items, with its postings and its largest impact
        self.blocks = np.int64(-(-n // BLOCK) or 1)
        key = term * self.blocks + self.item // BLOCK
        self.entry, first = np.unique(key, return_index=True)
        self.opens = np.r_[first, len(key)]
        self.block_max = np.maximum.reduceat(self.impact, first) if len(first) else np.array([], "float64")
        self.lists = np.searchsorted(self.entry, np.arange(v + 1) * self.blocks)
        self.term_max = np.zeros(v)
        np.maximum.at(self.term_max, term, self.impact)
        # the places of each pair of each item, and the weights of all words one after the other
        at = [np.searchsorted(items.pair, items.pairs(w)) for w in self.words]
        placed = join([i * np.int64(v) + x for i, x in enumerate(at)], "int64")
        order = np.argsort(placed, kind="stable")
        self.placed, self.places = placed[order], join([np.arange(len(x)) for x in at], "int64")[order]
        self.weights = np.r_[0.0, np.cumsum(self.idf[join(self.words, "int64")], dtype="float64")]
        self.starts = np.cumsum([0, *[len(w) for w in self.words]])
        padded = np.full(int(self.blocks) * BLOCK, np.inf)
        padded[:n] = self.passage
        self.block_passage = padded.reshape(-1, BLOCK).min(1)

    def known_pairs(self, ids: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number) of the word pairs the index knows; ids hold all documents' terms."""
        if len(ids) < 2 or not len(self.pair):
            return np.array([], "int64"), np.array([], "int64")
        both = (ids[:-1] >= 0) & (ids[1:] >= 0)
        ends = doc_start[1:] - 1
        both[ends[(ends >= 0) & (ends < len(both))]] = False
        at = np.flatnonzero(both)
        key = ids[at].astype("int64") * self.base + ids[at + 1]
        no = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[no] == key
        return at[hit], no[hit]

    def candidates(self, ids: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) pairs whose passages, of those that reach the item's threshold for a passage, add up to its threshold for a document."""
        n = np.int64(max(1, len(self.ids)))
        if not np.isfinite(self.document).any():
            return np.array([], "int64"), np.array([], "int64")
        pos, pair = self.known_pairs(ids, doc_start)
        size = np.diff(np.r_[doc_start, len(ids)])
        per_doc = np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE))
        doc = np.repeat(np.arange(len(size)), per_doc)
        first = doc_start[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)) * STRIDE
        last = np.minimum(first + WINDOW, doc_start[doc] + size[doc]) - 1
        lo, hi = np.searchsorted(pos, first), np.searchsorted(pos, last)
        total = np.r_[0.0, np.cumsum(self.term_max[pair])]
        span = np.searchsorted(pos, np.r_[doc_start, len(ids)])
        whole = (total[span[1:]] - total[span[:-1]])[doc] >= self.document.min() - 1e-6
        left = np.flatnonzero(whole & (total[hi] - total[lo] >= self.passage.min() - 1e-6) & (hi > lo))
        held = [np.array([], "int64")]
        for at in range(0, len(left), WINDOWS):
            part = left[at : at + WINDOWS]
            window, posting = self._passages(pair, lo[part], hi[part])
            held.append(np.unique(doc[part[window]] * np.int64(len(self.item)) + posting))
        # a pair of words counts once in a document, however many passages hold it
        held = np.unique(np.concatenate(held))
        posting = held % max(1, len(self.item))
        found, back = np.unique(held // max(1, len(self.item)) * n + self.item[posting], return_inverse=True)
        sums = np.bincount(back, self.impact[posting], len(found))
        found = found[sums >= self.document[found % n] - 1e-6]
        return self._in_order(ids, doc_start, pos, pair, span, found // n, found % n)

    def _passages(self, pair: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, posting) of the pairs of all windows of known pairs [lo, hi) in items that reach the item's threshold for a passage."""
        window, at = _expand(lo, hi)
        key = np.unique(window * np.int64(len(self.pair)) + pair[at])  # a pair counts once
        window, term = key // len(self.pair), key % len(self.pair)
        rank = np.lexsort((self.term_max[term], window))
        run = np.cumsum(self.term_max[term[rank]])
        begin = np.searchsorted(window, np.arange(len(lo) + 1))
        run -= np.r_[0.0, run][begin[window]]
        from_pivot = rank[run >= self.passage.min() - 1e-6]
        # blocks the pairs from the pivot on lead to, and their bounds over all pairs of the window
        which, entry = _expand(self.lists[term[from_pivot]], self.lists[term[from_pivot] + 1])
        block = np.unique(window[from_pivot][which] * self.blocks + self.entry[entry] % self.blocks)
        which, at = _expand(begin[block // self.blocks], begin[block // self.blocks + 1])
        want = term[at] * self.blocks + (block % self.blocks)[which]
        entry = np.minimum(np.searchsorted(self.entry, want), len(self.entry) - 1)
        hit = self.entry[entry] == want
        which, entry = which[hit], entry[hit]
        bound = np.bincount(which, self.block_max[entry], len(block))
        keep = (bound >= self.block_passage[block % self.blocks] - 1e-6)[which]
        which, entry = which[keep], entry[keep]
        # the items of the other blocks
        of, posting = _expand(self.opens[entry], self.opens[entry + 1])
        who, back = np.unique((block[which[of]] // self.blocks) * np.int64(len(self.ids)) + self.item[posting], return_inverse=True)
        score = np.bincount(back, self.impact[posting], len(who))
        keep = (score >= self.passage[who % len(self.ids)] - 1e-6)[back]
        return who[back[keep]] // len(self.ids), posting[keep]

    def _in_order(self, ids: np.ndarray, doc_start: np.ndarray, pos: np.ndarray, pair: np.ndarray, span: np.ndarray, docs: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the retrieved (document, item) whose pairs stand in the item's order as well.

        Pairs near one diagonal of document and item (up to ``SHIFT`` words added or missing) and near each other form a run; a run
        counts from ``RUN_PAIRS`` pairs and the part ``LIGHT`` of the weight of the words it spans on: a passage of 8 words of which two
        are changed still has three, and passages of 20 words in all of which 28 % are changed keep ``LEAST_PAIRS``.
        """
        which, at = _expand(span[docs], span[docs + 1])
        want = items[which] * np.int64(len(self.pair)) + pair[at]
        first, last = np.searchsorted(self.placed, want), np.searchsorted(self.placed, want, "right")
        some = last > first
        hit, of = _expand(first[some], last[some])
        which, where, place = which[some][hit], pos[at[some][hit]], self.places[of]
        if not len(which):
            return docs[:0], items[:0]
        longest = int(self.places.max()) + 2
        diagonal = which * np.int64(len(ids) + longest + SHIFT + 2) + (where - place + longest)
        order = np.argsort(diagonal, kind="stable")
        run = np.empty(len(order), "int64")
        run[order] = np.cumsum(np.r_[0, np.diff(diagonal[order]) > SHIFT])
        spot = np.unique(run * np.int64(longest) + place)  # a place of the item counts once in a run
        _, spot_at = np.unique(run, return_index=True)
        of_run, at_place = spot // longest, spot % longest
        owner = which[spot_at][of_run]
        begin = np.flatnonzero(np.r_[True, (np.diff(of_run) > 0) | (np.diff(spot) > BREAK)])
        end = np.r_[begin[1:], len(spot)] - 1
        base = self.starts[items[owner]]
        word = self.weights[base + at_place + 1] - self.weights[base + at_place]
        after = self.weights[base + at_place + 2] - self.weights[base + at_place + 1]
        fresh = np.r_[True, np.diff(spot) > 1]  # the first word of a pair next to the one before is counted there already
        matched = np.add.reduceat(after + np.where(fresh, word, 0.0), begin)
        spanned = self.weights[base[end] + at_place[end] + 2] - self.weights[base[begin] + at_place[begin]]
        pairs = end - begin + 1
        good = (pairs >= RUN_PAIRS) & (matched >= LIGHT * spanned)
        sums = np.bincount(owner[begin][good], pairs[good], len(docs))
        return docs[sums >= LEAST_PAIRS], items[sums >= LEAST_PAIRS]


GAP = 0.6


def _align(items: list[np.ndarray], texts: list[np.ndarray]) -> list[tuple[float, list[tuple[int, int]]]]:
    """Best local alignment of each item with its text: score and the matched (item, text) positions in order."""
    m, n, c = max(len(x) for x in items), max(len(x) for x in texts), len(items)
    item, text = np.full((m, c, 1), -9, "int32"), np.full((c, n), -8, "int32")
    for k, (x, t) in enumerate(zip(items, texts)):
        item[: len(x), k, 0], text[k, : len(t)] = x, t
    h = np.zeros((m + 1, c, n + 1), "float32")
    ramp = np.arange(n + 1, dtype="float32") * GAP
    for i in range(1, m + 1):
        s = np.where(text == item[i - 1], np.float32(1), np.float32(-GAP))
        row = np.maximum(h[i - 1] - GAP, 0)
        np.maximum(row[:, 1:], h[i - 1, :, :-1] + s, out=row[:, 1:])
        h[i] = np.maximum.accumulate(row + ramp, axis=1) - ramp
    last = h.max(2).argmax(0)
    return [_trace(h[: len(x) + 1, k, : len(t) + 1], x, t, int(last[k])) for k, (x, t) in enumerate(zip(items, texts))]


def _trace(h: np.ndarray, item: np.ndarray, text: np.ndarray, i: int) -> tuple[float, list[tuple[int, int]]]:
    j = int(h[i].argmax())
    best, pairs = float(h[i, j]), []
    while i and j and h[i, j] > 1e-3:
        if text[j - 1] == item[i - 1] and abs(h[i, j] - h[i - 1, j - 1] - 1) < 1e-3:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif abs(h[i, j] - h[i - 1, j - 1] + GAP) < 1e-3:
            i, j = i - 1, j - 1
        elif abs(h[i, j] - h[i - 1, j] + GAP) < 1e-3:
            i -= 1
        else:
            j -= 1
    return best, pairs[::-1]


SEGMENT, OVERLAP = 3000, 400
#: Cells of a row of alignments that are worked out side by side.
SIDE_BY_SIDE = 60_000


def overlaps(index: Index, found: list[tuple[int, np.ndarray]], rule: LeakRule) -> list[tuple[int, int, float]]:
    """For each (item number, text): (words of the item covered, passages, share of them that agree) over all passages that agree well enough."""
    out: list[tuple[int, int, float]] = [(0, 0, 0.0)] * len(found)
    asked = []
    for no, (item_no, text) in enumerate(found):
        asked.append((no, one := _overlap(index, item_no, text, rule), next(one)))
    while asked:
        asked.sort(key=lambda a: len(a[2][1]))
        more, lo = [], 0
        while lo < len(asked):
            hi = lo + 1
            while hi < len(asked) and (hi + 1 - lo) * len(asked[hi][2][1]) <= SIDE_BY_SIDE:
                hi += 1
            part = asked[lo:hi]
            for (no, one, _), got in zip(part, _align([a[2][0] for a in part], [a[2][1] for a in part])):
                try:
                    more.append((no, one, one.send(got)))
                except StopIteration as end:
                    out[no] = end.value
            lo = hi
        asked = more
    return out


def _overlap(index: Index, item_no: int, text: np.ndarray, rule: LeakRule) -> Generator[tuple[np.ndarray, np.ndarray], tuple[float, list[tuple[int, int]]], tuple[int, int, float]]:
    """One of ``overlaps``: asks for the alignments of (item, text) it needs."""
    item = index.words[item_no]
    weight = index.idf[item]
    covered = np.zeros(len(item), bool)
    matched, passages = 0, 0
    free = item.copy()
    for start in range(0, max(1, len(text) - OVERLAP), SEGMENT - OVERLAP):
        part = text[start : start + SEGMENT].copy()
        while True:  # until nothing is left: every round takes words out of the part
            score, pairs = yield free, part
            if score < 3.5 or len(pairs) < 4:
                break
            hits = np.array(pairs)
            part[hits[0, 1] : hits[-1, 1] + 1] = -2
            for one in np.split(hits, np.flatnonzero((np.diff(hits, axis=0) > BREAK).any(1)) + 1):
                (i0, j0), (i1, j1) = one[0], one[-1] + 1
                fits = i1 - i0 >= rule.least_passage - 1 and len(one) >= rule.agree * max(i1 - i0, j1 - j0)
                if fits and weight[one[:, 0]].sum() >= rule.agree_weight * weight[i0:i1].sum():
                    covered[i0:i1] = True
                    free[i0:i1] = -3
                    matched += len(one)
                    passages += 1
    return int(covered.sum()), passages, matched / max(1, int(covered.sum()))


#: Words of items an index holds at most; beyond that the items are searched in parts, one scan each, with the counts over all of them.
MAX_WORDS = 50_000_000


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", rule: LeakRule | None = None) -> DataFrame:
    """``doc_id, item_id, words, passages, agreement``: documents that hold passages of an item.

    A document holds an item if passages of it, of at least ``least_passage`` words each and
    in the item's order inside, together cover ``least_words`` words of the item.  Case,
    punctuation, spacing, line breaks, hyphenation, look-alike characters, scanning errors
    and reference signs make no difference, and about one word in five may differ.

    The index is shipped to the executors and the documents are read once for all items, up to ``MAX_WORDS`` words of
    items; beyond that once for each part of them, with the same results.  Null and empty texts hold nothing, items shorter
    than ``least_words`` cannot be leaked, items that repeat under several ids are reported for each, repeated documents
    likewise; texts of any length are read whole; empty tables give no rows.
    """
    rule = rule or LeakRule()
    rows = items.select(item_id, text).filter(f"{item_id} is not null and {text} is not null").orderBy(item_id)
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, words int, passages int, agreement double"
    source = docs.select(doc_id, text).filter(f"{text} is not null")
    held = Items((r[0], r[1]) for r in rows.toLocalIterator())
    part = np.cumsum([len(w) for w in held.words]) // MAX_WORDS
    out = docs.sparkSession.createDataFrame([], schema)
    for no in np.unique(part):
        at = np.flatnonzero(part == no)
        out = out.unionByName(_search(source, Index(held, rule, int(at[0]), int(at[-1]) + 1), rule, schema))
    return out


def _search(source: DataFrame, index: Index, rule: LeakRule, schema: str) -> DataFrame:
    shipped = source.sparkSession.sparkContext.broadcast(index)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shipped.value
        look = ix.vocabulary.__getitem__
        for b in batches:
            size, flat = [], []
            for t in b.column(1).to_pylist():
                before = len(flat)
                flat.extend(map(look, words(t)))
                size.append(len(flat) - before)
            ids, size = np.array(flat, "int32"), np.array(size, "int64")
            start = np.cumsum(size) - size
            docs, found = ix.candidates(ids, start)
            look_at = [(d, i, ids[start[d] : start[d] + size[d]]) for d, i in zip(docs.tolist(), found.tolist())]
            held = overlaps(ix, [x[1:] for x in look_at], rule)
            hits = [(d, i, *got) for (d, i, _), got in zip(look_at, held) if got[0] >= rule.least_words]
            d, i, n, p, s = (list(x) for x in zip(*hits)) if hits else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(d, "int64")), pa.array(ix.ids[np.array(i, int)]), pa.array(n, "int32"), pa.array(p, "int32"), pa.array(s, "float64")], names=names
            )

    return source.mapInArrow(run, schema)
