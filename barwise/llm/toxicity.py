"""Abusive, hateful or sexual content (problem 10): classifier chains over word windows.

A document is judged by its worst window of ``WINDOW`` words.  The chain predicts ``KINDS``
categories of such content one after the other and then ``toxic``; every link is a linear
(logistic) model of the words and word pairs in the window and of the probabilities the
earlier links gave.  Those are out-of-fold predictions in training: for each fold of
documents they come from links that have not seen it.

Raters only say whether a document is toxic.  Which of its windows is meant is learned as
a multiple-instance problem (a toxic document has at least one toxic window, others have
none): the windows the current model finds worst are relabelled and the model is fitted
again.  The categories are learned as well: they are the kinds into which these windows of toxic
documents fall by their wording; windows of harmless documents, among them the trade's own
look-alike terms, are the counter-examples of each.  No word lists are used.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.llm.words import plain

WINDOW = 20
FOLDS = 3
ROUNDS = 2
TOP = 3  # windows of a document that take part in training
#: Labelled documents used for fitting at most, and their characters in all (chosen by hash of the id).
MAX_LABELLED, MAX_CHARS = 10_000, 60_000_000
#: A word or pair is typical of toxic documents from so many of them, standard deviations above chance and log odds on; the
#: same at every number of labels: what is rare is left to the penalty of the fit.
LEAST_DOCS, SURE, MORE_ODDS = 2, 2.0, 0.7

#: Categories of toxic windows the chain learns before ``toxic``; kind_1 is the most frequent.
KINDS = 4
LINKS = [*(f"kind_{k + 1}" for k in range(KINDS)), "toxic"]

# Signs and digits that stand for letters in disguised words.
_LEET = str.maketrans("@$!013457|€", "asioleastle")
_INVISIBLE = re.compile("[​-‏⁠-⁤﻿­]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n\s*(?=[^\W\d_])")
_SPACED = re.compile(r"\s[^\W\d_](?: [^\W\d_]){2,}(?=[\s.,;:!?]|$)")
_DOTTED = re.compile(r"(?:[^\W\d_][.\-_*]){2,}[^\W\d_]")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_MASK = re.compile(r"[^\W\d_]\*{2,}[^\W\d_]*|[^\W\d_]\*+[^\W\d_]+")
_ODD = re.compile(r"[@$!0-9|€]")


def _parts(text: str) -> list[str]:
    """The parts of a text between blanks, lower-case, with words spread over blanks or lines put together."""
    t = (text if text.isascii() else _INVISIBLE.sub("", text)).lower()
    if "-\n" in t or "- \n" in t or not t.isascii():
        t = _BROKEN.sub("", t)
    if _SPACED.search(t):
        t = _SPACED.sub(lambda m: " " + m.group().replace(" ", "")[1:] if m.group()[0] != " " else " " + m.group().replace(" ", ""), t)
    return t.split()


def _undisguised(part: str) -> list[str]:
    """The words of one part with disguises undone: dots between letters, digits and signs for letters,
    drawn-out letters; a word masked by asterisks becomes one special word; numbers are left out."""
    word = part.strip(".,;:?\"'()[]")
    if not any(c.isalpha() for c in word):
        return []
    if _MASK.search(word):
        return ["maskedword"]
    m = _DOTTED.fullmatch(word)
    if m:
        word = "".join(c for c in word if c.isalpha())
    word = word.rstrip("!")
    if _ODD.search(word):
        word = word.translate(_LEET)
    return [w for w in plain(_LONG.sub(r"\1", word)).split() if not w.isdigit()]


# Characters that disguises and scanning exchange most.
_ALIKE = str.maketrans("015i", "olsl")


def folded(word: str) -> str:
    """One form for words that differ in look-alike characters only (weaker than in the leak search: beat is not heat)."""
    return word.translate(_ALIKE)


class _Words(dict):
    """Part of a text -> its words, remembered."""

    def __missing__(self, part: str) -> list[str]:
        if len(self) > 1_000_000:
            self.clear()
        got = self[part] = _undisguised(part)
        return got


_words = _Words()


def tokens(text: str) -> list[str]:
    """Words of a text, disguises undone."""
    return [w for part in _parts(text) for w in _words[part]]


class _Lookup(dict):
    """Part of a text -> term numbers of its words (0 where no term)."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, part: str) -> tuple[int, ...]:
        if len(self) > 1_000_000:
            self.clear()
        got = self[part] = tuple(self.terms.get(folded(w), 0) for w in _undisguised(part))
        return got


def _fit(idx: np.ndarray, start: np.ndarray, extra: np.ndarray, y: np.ndarray, size: int, l2: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on counts of features ``idx`` (rows begin at ``start``) and dense ``extra`` columns, by L-BFGS."""
    count = np.diff(np.r_[start, len(idx)])
    n, k = len(y), extra.shape[1]
    share = max(y.mean(), 1e-3)
    weight = np.where(y > 0, min(4.0, 0.5 / share), 1.0)

    def value(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, v, b = p[:size], p[size : size + k], p[-1]
        z = np.add.reduceat(w[idx], start) + extra @ v + b
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * l2 * (w @ w + 0.1 * v @ v)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        return loss, np.r_[np.bincount(idx, np.repeat(g, count), size) + l2 * w, extra.T @ g + 0.1 * l2 * v, g.sum()]

    p = np.zeros(size + k + 1)
    p[-1] = np.log(share / (1 - share) + 1e-9)
    f, g = value(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, a = g.copy(), []
        for s, t, r in reversed(past):
            a.append(r * (s @ d))
            d -= a[-1] * t
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, t, r), c in zip(past, reversed(a)):
            d += s * (c - r * (t @ d))
        step, slope = (1.0 if past else 1.0 / max(1.0, np.abs(g).sum())), g @ d
        while step > 1e-8:
            q = p - step * d
            f1, g1 = value(q)
            if f1 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = q - p, g1 - g
        if s @ t > 1e-12:
            past = [*past[-7:], (s, t, 1 / (s @ t))]
        done = f - f1 < 1e-5 * abs(f)
        p, f, g = q, f1, g1
        if done:
            break
    return p[:size], p[size : size + k], float(p[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    """Fitted links: per link a weight per word, a weight per word pair, weights of the earlier links' probabilities, a constant."""

    terms: dict[str, int]
    pairs: np.ndarray  # sorted keys first * len(terms) + second
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lookup = _Lookup(self.terms)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, size, look = [], [], self.lookup
        for t in texts:
            before = len(flat)
            flat.extend(chain.from_iterable(map(look.__getitem__, _parts(t))))
            size.append(len(flat) - before)
        return np.array(flat, "int64"), np.array(size, "int64")

    def pair_numbers(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number (from 1) of the known pair that begins at each position, else 0."""
        out = np.zeros(len(ids), "int64")
        if len(ids) < 2 or not len(self.pairs):
            return out
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        ends = np.cumsum(size)
        last = np.zeros(len(ids), bool)
        last[ends[size > 0] - 1] = True
        both = both[~last[both]]
        key = ids[both] * (len(self.terms) + 1) + ids[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        out[both] = np.where(self.pairs[at] == key, at + 1, 0)
        return out

    def windows(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(position, link) probabilities of the window that begins at each position."""
        n = len(ids)
        pair = self.pair_numbers(ids, size)
        end = np.minimum(np.arange(n) + WINDOW, np.repeat(np.cumsum(size), size))
        # windows without any known word all look alike: only the others are worked out
        known = np.r_[0, np.cumsum((ids > 0) | (pair > 0))]
        at = np.flatnonzero(known[end] > known[:n])
        probs = np.empty((n, len(self.links)), "float32")
        sub = np.empty((len(at), len(self.links)))
        base: list[float] = []
        for k, (uni, bi, earlier, const) in enumerate(self.links):
            run = np.r_[0.0, np.cumsum(uni[ids] + bi[pair])]
            z = run[end[at]] - run[at] + const
            for j, w in enumerate(earlier):
                z += w * sub[:, j]
            sub[:, k] = _sigmoid(z)
            base.append(float(_sigmoid(np.array(const + float(np.dot(earlier, base[: len(earlier)]))))))
            probs[:, k] = base[-1]
        probs[at] = sub
        return probs

    def scores(self, texts: list[str]) -> np.ndarray:
        """(document, link): the largest probability of any window."""
        ids, size = self.encode(texts)
        out = np.zeros((len(texts), len(self.links)), "float64")
        if len(ids):
            full = np.flatnonzero(size)
            out[full] = np.maximum.reduceat(self.windows(ids, size), (np.cumsum(size) - size)[full], axis=0)
        return out


def _worst(score: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Per document the starts of its TOP worst windows that do not overlap."""
    out, start = [], 0
    for n in size:
        s = score[start : start + n].copy()
        picked = []
        for _ in range(TOP if n else 0):
            i = int(s.argmax())
            if not np.isfinite(s[i]):
                break
            # of equally bad windows the middle one
            j = i
            while j + 1 < n and s[j + 1] == s[i]:
                j += 1
            i = (i + j) // 2
            picked.append(start + i)
            s[max(0, i - WINDOW + 1) : i + WINDOW] = -np.inf
        out.append(np.array(picked, "int64"))
        start += n
    return out


def _kinds(feat: np.ndarray, begin: np.ndarray, weight: np.ndarray, kinds: int) -> np.ndarray:
    """Kind (0 the most frequent) of each window: k-means of their weighted words on the unit sphere.

    ``feat`` and ``begin`` are the windows' features, of which only words count.  The first centre is the mean, the others the windows farthest from all
    before, so that nothing is left to chance.
    """
    n = len(begin)
    who = np.repeat(np.arange(n), np.diff(np.r_[begin, len(feat)]))
    use = (feat < len(weight)) & (weight[np.minimum(feat, len(weight) - 1)] > 0)
    cols, at = np.unique(feat[use], return_inverse=True)
    x = np.zeros((n, len(cols)), "float32")
    x[who[use], at] = weight[cols][at]
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    centre = [x.mean(0)]
    for _ in range(kinds - 1):
        unit = np.array([c / max(1e-9, float(np.sqrt(c @ c))) for c in centre])
        centre.append(x[int((x @ unit.T).max(1).argmin())])
    centres, label = np.array(centre), np.zeros(n, int)
    for _ in range(20):
        centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-9)
        new = (x @ centres.T).argmax(1)
        if (new == label).all():
            break
        label = new
        centres = np.array([x[label == k].mean(0) if (label == k).any() else centres[k] for k in range(kinds)])
    order = np.argsort(-np.bincount(label, minlength=kinds), kind="stable")
    return np.argsort(order)[label]


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Chain:
    """The chain for labelled texts (``toxic`` 0/1).

    A first model shows which harmless windows look suspicious to it; words that mostly
    stand in such windows then get a say as well, and the chain is fitted with them.
    """
    docs = [[folded(w) for w in tokens(t)] for t in texts]
    _, more = _train(docs, toxic, seed, (set(), set()), 1)
    return _train(docs, toxic, seed, more, ROUNDS)[0]


def _train(docs: list[list[str]], toxic: np.ndarray, seed: int, extra: tuple[set, set], rounds: int) -> tuple[Chain, tuple[set, set]]:
    """The chain, and words and word pairs typical of the harmless windows it finds suspicious."""
    n_pos, n_neg = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    df: list[Counter] = [Counter(), Counter()]
    pf: list[Counter] = [Counter(), Counter()]
    for d, y in zip(docs, toxic):
        df[int(y)].update(set(d))
        if y:
            pf[1].update(set(zip(d, d[1:])))

    share = n_pos / (n_pos + n_neg)

    def excess(c: list[Counter], f) -> float:  # noqa: ANN001
        """Standard deviations by which ``f`` is more frequent in toxic documents than by chance."""
        expected = (c[0][f] + c[1][f]) * share
        return (c[1][f] - expected) / np.sqrt(expected * (1 - share) + 1e-9) if expected else 0.0

    def odds(c: list[Counter], f) -> float:  # noqa: ANN001
        return float(np.log((c[1][f] + 0.3) / (n_pos + 0.6)) - np.log((c[0][f] + 0.3) / (n_neg + 0.6)))

    # words and pairs known to the model: those typical of toxic documents, and where such a
    # word stands in harmless ones; the rest of the vocabulary has no say
    least, sure, more = LEAST_DOCS, SURE, MORE_ODDS
    words = {w for w, c in df[1].items() if c >= least and excess(df, w) >= sure and odds(df, w) >= more} | extra[0]
    # of the many pairs of harmless documents only those are counted that can matter
    often = {p for p, c in pf[1].items() if c >= least}
    for d, y in zip(docs, toxic):
        if not y:
            pf[0].update({p for p in zip(d, d[1:]) if p in often or (p[0] in words) != (p[1] in words)})
    typical = [p for p in often if excess(pf, p) >= sure and odds(pf, p) >= more]
    beside = [p for p, c in pf[0].items() if c >= 2 and (p[0] in words) != (p[1] in words)]
    wanted = set(typical) | set(beside) | extra[1]
    # members of pairs need a number, but get no weight of their own unless they are such words
    silent = {w for p in wanted for w in p} - words
    terms = {w: i + 1 for i, w in enumerate([*sorted(words), *sorted(silent)])}
    loud = len(words)
    base = len(terms) + 1
    pairs = np.array(sorted({terms[a] * base + terms[b] for a, b in wanted}), "int64")
    model = Chain(terms, pairs)
    ids = np.array([terms.get(w, 0) for d in docs for w in d], "int64")
    size = np.array([len(d) for d in docs], "int64")
    pair = model.pair_numbers(ids, size)
    ends = np.cumsum(size)
    doc_of = np.repeat(np.arange(len(docs)), size)
    n_feat = base + len(pairs) + 1

    prior = np.zeros(base)
    for w in words:
        i = terms[w]
        prior[i] = np.clip(odds(df, w), 0, 3)
    run = np.r_[0.0, np.cumsum(prior[ids])]
    end = np.minimum(np.arange(len(ids)) + WINDOW, ends[doc_of]) if len(ids) else np.array([], "int64")
    score = run[end] - run[: len(ids)]
    # near-identical documents mostly begin alike and should not be split over folds
    fold = np.array([zlib.crc32(" ".join(d[:6]).encode() + bytes([seed])) % FOLDS for d in docs], "int64")
    judged = score  # the score that decides what is left out as a rater's error

    def rows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of windows, one constant feature first so that no row is empty."""
        count = end[starts] - starts
        begin = np.cumsum(count) - count
        at = np.repeat(starts - begin, count) + np.arange(count.sum())
        row = np.repeat(np.arange(len(starts)), count)
        feat = np.concatenate([np.zeros(len(starts), "int64"), ids[at], base + pair[at]])
        who = np.concatenate([np.arange(len(starts)), row, row])
        keep = np.concatenate([np.ones(len(starts), bool), (ids[at] > 0) & (ids[at] <= loud), pair[at] > 0])
        order = np.argsort(who[keep], kind="stable")
        feat, who = feat[keep][order], who[keep][order]
        return feat, np.flatnonzero(np.r_[True, who[1:] != who[:-1]])

    def take(feat: np.ndarray, start: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.diff(np.r_[start, len(feat)])
        part = feat[np.repeat(mask, count)]
        c = count[mask]
        return part, np.cumsum(c) - c

    def link(w: np.ndarray, v: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        uni, bi = w[:base].copy(), np.r_[0.0, w[base + 1 :]]
        const = b + float(w[0])
        uni[0] = 0.0
        return uni, bi, v, const

    # every stretch of a harmless document is a counter-example, if the model knows a word of it
    known = np.r_[0, np.cumsum(((ids > 0) & (ids <= loud)) | (pair > 0))]
    grid = np.concatenate([*[np.arange(e - n, e, WINDOW // 2) for e, n, y in zip(ends, size, toxic) if not y], np.array([], "int64")]).astype("int64")
    grid = grid[known[end[grid]] > known[grid]]
    for rnd in range(rounds):
        best = _worst(score, size)
        starts = np.union1d(np.concatenate([*best, np.array([], "int64")]), grid).astype("int64")
        if not len(starts):
            break
        feat, begin = rows(starts)
        d = doc_of[starts]
        y_doc = toxic[d].astype(float)
        # positives: the worst window of a toxic document, and others nearly as bad; raters err,
        # so toxic documents without any suspicious window and harmless ones with a window the
        # model is sure of are left out once there is a model
        lead = np.full(len(docs), -np.inf)
        np.maximum.at(lead, d, score[starts])
        lead = lead[d]
        held_out = np.full(len(docs), -np.inf)
        np.maximum.at(held_out, doc_of, judged)
        held_out = held_out[d]
        if rnd == 0:
            usable = np.where(y_doc == 1, (score[starts] >= 0.6 * lead) & (lead > 0), True)
        else:
            usable = np.where(y_doc == 1, (score[starts] >= lead - 1.5) & (held_out > 0.0), judged[starts] < 2.5)
        kind = np.full(len(starts), -1)
        bad = usable & (y_doc == 1)
        if bad.sum() >= KINDS:
            kind[bad] = _kinds(*take(feat, begin, bad), prior, KINDS)
        f_of = fold[d]
        earlier = np.zeros((len(starts), 0))
        links = []
        for no, name in enumerate(LINKS):
            if name == "toxic":
                y, mask = y_doc, usable
            else:
                has = kind == no
                y = y_doc * has
                mask = usable & ((y_doc == 0) | has)
            out = np.full(len(starts), 1e-3)
            if y[mask].sum() < 2:
                links.append((np.zeros(base), np.zeros(len(pairs) + 1), np.zeros(no), -6.0))
            else:
                for k in range(FOLDS):
                    m = mask & (f_of != k)
                    if not y[m].sum():
                        continue
                    fk, bk = take(feat, begin, m)
                    w, v, b = _fit(fk, bk, earlier[m], y[m], n_feat, steps=25)
                    fo, bo = take(feat, begin, f_of == k)
                    if len(bo):
                        out[f_of == k] = _sigmoid(np.add.reduceat(w[fo], bo) + earlier[f_of == k] @ v + b)
                fk, bk = take(feat, begin, mask)
                links.append(link(*_fit(fk, bk, earlier[mask], y[mask], n_feat)))
            earlier = np.column_stack([earlier, out])
        model.links = links
        z = model.windows(ids, size)[:, -1].astype("float64")
        score = np.log(np.clip(z, 1e-9, 1 - 1e-9) / (1 - np.clip(z, 1e-9, 1 - 1e-9)))
        judged = np.full(len(ids), -np.inf)
        judged[starts] = np.log(np.clip(out, 1e-9, 1 - 1e-9) / (1 - np.clip(out, 1e-9, 1 - 1e-9)))
    if not model.links:
        model.links = [(np.zeros(base), np.zeros(len(pairs) + 1), np.zeros(k), -6.0) for k in range(len(LINKS))]
    hard, flat = (Counter(), Counter()), [w for d in docs for w in d]
    for i in _worst(np.where(toxic[doc_of] == 0, score, -np.inf), size) if len(flat) else []:
        for j in i:
            if toxic[doc_of[j]] == 0 and score[j] > -2.5:
                hard[0].update(set(flat[j : end[j]]))
                hard[1].update(set(zip(flat[j : end[j]], flat[j + 1 : end[j]])))
    seen = {p for p, c in hard[1].items() if c >= least}
    total = Counter(p for d in docs for p in set(zip(d, d[1:])) & seen)
    typical = ({w for w, c in hard[0].items() if c >= least and c >= 0.25 * (df[0][w] + df[1][w])}, {p for p in seen if hard[1][p] >= 0.25 * total[p]})
    return model, typical


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, limit: int = MAX_LABELLED, chars: int = MAX_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and majority labels of the rated documents; null ratings and ties are left out.

    At most ``limit`` documents, and of these at most ``chars`` characters of text, in order of a hash of their id: the one bounded sample of this operator.
    """
    votes = labels.filter(f"{toxic} is not null and {doc_id} is not null").groupBy(doc_id).agg(F.avg(F.col(toxic).cast("double")).alias("_y")).filter("_y <> 0.5")
    votes = votes.orderBy(F.xxhash64(doc_id)).limit(limit)
    got = docs.select(doc_id, F.col(text).alias("_text")).filter("_text is not null").join(F.broadcast(votes), doc_id)
    # one window over at most ``limit`` rows
    upto = W.partitionBy().orderBy(F.xxhash64(doc_id), doc_id).rowsBetween(W.unboundedPreceding, 0)
    rows = got.withColumn("_upto", F.sum(F.char_length("_text")).over(upto)).filter(F.col("_upto") <= chars).select("_text", "_y").collect()
    return [r[0] for r in rows], np.array([int(r[1] > 0.5) for r in rows], "int64")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """``doc_id, kind_1 .. kind_4, toxic``: for every document its largest window probability per link.

    Every document is scored over its whole text, labelled or not.  Null and empty texts get
    score 0; repeated documents get equal scores; without usable labels of both kinds the
    links keep a constant low probability.  Columns of ``docs`` other than the two named are
    not read.
    """
    model = train(*labelled(docs, labels, doc_id, text, toxic))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shipped.value.scores([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(got[:, i]) for i in range(len(LINKS))]], names=[doc_id, *LINKS])

    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, " + ", ".join(f"{c} double" for c in LINKS))


def plain_source(c: Column) -> Column:
    """A source name in its plain form: lower case, blanks and separators as one underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_./]+", "_")


def toxic_rates(docs: DataFrame, scores: DataFrame, doc_id: str = "doc_id", source: str = "source", threshold: float = 0.5) -> DataFrame:
    """``source, documents, toxic_documents, rate``; documents without a source form the group null."""
    names = docs.select(doc_id, plain_source(F.col(source)).alias("source"))
    return (
        names.join(scores.select(doc_id, (F.col("toxic") >= threshold).cast("long").alias("_t")), doc_id)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("_t").alias("toxic_documents"))
        .withColumn("rate", F.col("toxic_documents") / F.col("documents"))
    )
