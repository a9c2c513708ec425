"""The operators for training text and large columns: brute force, round trips, held-out accuracy, and odd input."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.llm import leakage, mixing, toxicity
from barwise.llm.nearest import nearest_in_time
from barwise.llm.percentiles import merge_counts, percentiles, value_counts
from barwise.llm.words import words

T0 = dt.datetime(2024, 1, 1)

# ---------------------------------------------------------------- nearest in time


@pytest.mark.parametrize("stretch", [120, 86_400])
def test_nearest_against_brute_force(spark, stretch):
    rng = random.Random(stretch)
    t = lambda: T0 + dt.timedelta(milliseconds=rng.randrange(0, 9_000_000))
    left = [(i, rng.choice(["a", "a", "b", "z", None]), None if i % 17 == 0 else t()) for i in range(500)]
    right = [(i, rng.choice(["a", "b", None]), None if i % 19 == 0 else t()) for i in range(300)]
    right += [(1000 + i, k, x) for i, (_, k, x) in enumerate(right[:100])]
    ldf = spark.createDataFrame(left, "event_id long, symbol string, date_time timestamp_ntz").withColumn("k", F.lit("x")).withColumn("d", F.lit(0)).repartition(3)
    rdf = spark.createDataFrame(right, "bar_id long, symbol string, bob timestamp_ntz").withColumn("t", F.lit(1)).repartition(3)
    got = {r["event_id"]: (r["bar_id"], r["distance_us"]) for r in nearest_in_time(ldf, rdf, "symbol", "date_time", "bob", "event_id", "bar_id", 60, stretch).collect()}
    for i, k, x in left:
        if k is None or x is None:
            assert i not in got
            continue
        best = min(((abs(y - x), y, j) for j, k2, y in right if k2 == k and y is not None and abs(y - x) <= dt.timedelta(seconds=60)), default=None)
        assert got[i] == ((best[2], round(best[0].total_seconds() * 1e6)) if best else (None, None))


def test_nearest_empty(spark):
    left = spark.createDataFrame([(1, "a", T0), (1, "a", T0)], "event_id long, symbol string, date_time timestamp_ntz")
    right = spark.createDataFrame([], "bar_id long, symbol string, bob timestamp_ntz")
    assert [r["bar_id"] for r in nearest_in_time(left, right, "symbol", "date_time", "bob", "event_id", "bar_id").collect()] == [None, None]
    assert nearest_in_time(left.limit(0), right, "symbol", "date_time", "bob", "event_id", "bar_id").count() == 0


# ---------------------------------------------------------------- percentiles


def test_percentiles(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in np.r_[np.exp(rng.normal(0, 3, 2000)), np.zeros(40), -np.exp(rng.normal(0, 1, 500)), np.full(300, 2.5)]]
    rows += [("a", float("nan")), ("a", None), ("b", 7.0), ("c", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, close double").withColumn("value", F.lit(1)).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(3)))
    vals = np.sort([v for s, v in rows if s == "a" and v is not None and v == v])
    exact = {(r["symbol"], r["prob"]): r["value"] for r in percentiles(value_counts(df, ["symbol"], ["close"]), ["symbol"]).collect()}
    for p in (0.01, 0.25, 0.5, 0.99):
        assert exact["a", p] == vals[max(1, int(np.ceil(p * len(vals)))) - 1]
    assert exact["b", 0.5] == 7.0 and exact[None, 0.01] == 3.0 and ("c", 0.5) not in exact
    near = {(r["symbol"], r["prob"]): r["value"] for r in percentiles(value_counts(df, ["symbol"], ["close"], 0.01), ["symbol"]).collect()}
    for k, v in exact.items():
        assert abs(near[k] - v) <= 0.01 * abs(v) * (1 + 1e-9)
    parts = value_counts(df, ["symbol"], ["close"], 0.01, by=F.col("part"))
    again = {(r["symbol"], r["prob"]): r["value"] for r in percentiles(merge_counts(parts, ["symbol"]), ["symbol"]).collect()}
    assert again == near
    assert percentiles(value_counts(df.limit(0), ["symbol"], ["close"]), ["symbol"]).count() == 0


# ---------------------------------------------------------------- leaks

ITEM = "Novelty is lacking where teinkleinsiite and a housing deform the same perforated reference cell within 2.0 N. The cited bracket teaches storing charge; nowhere does it quench grasdriite or any corrugated lens mount near nitrile rubber."
OTHER = "Novelty is lacking where volsteon and a buckle heat the same threaded filter cartridge within 284 mm. Given 12 samples of zinc alloy, the candidate must isolate each buckle before separating fines with priththoex."
FILL = "The distance between the lever and the spring is kept small so that wear remains low and the coating of the drum stays even. " * 6


def leaks(spark, texts, items=((1, ITEM), (2, OTHER), (3, ITEM), (4, None), (5, ""))):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", F.lit(1))
    its = spark.createDataFrame(list(items), "item_id long, text string").withColumn("lang", F.lit("en"))
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(docs, its).collect()}


WORDS = [f"{a}{b}{c}" for a in ("mor", "tel", "vis", "kan", "pur", "dol", "sem") for b in ("da", "lo", "ri", "ne", "su", "ka") for c in ("ban", "tor", "mel", "gis", "pur", "vek")]


def damaged(text, seed):
    rng, out = random.Random(seed), []
    for w in text.split():
        r = rng.random()
        if r < 0.05:
            continue
        if r < 0.10:
            out.append("indeed")
        out.append("part" if r > 0.95 else w.replace("l", "1").replace("o", "0") if r > 0.8 else w)
    return " ".join(out)


def test_leaks(spark):
    ws = ITEM.split()
    texts = [
        FILL + ITEM + FILL, ITEM.upper().replace(" ", "\n"), FILL + " ".join(ws[5:30]) + FILL, FILL + " ".join(ws[:6]) + FILL, FILL + " ".join(ws[3:14]) + FILL,
        FILL + " ".join(ws[:17]) + FILL + " ".join(ws[17:]) + FILL, damaged(ITEM, 1), FILL + damaged(ITEM, 2) + FILL, ITEM.replace("cell", "cell (12)").replace("perforated", "perfor-\nated").replace("a", "а"),
        FILL, "", None, FILL * 300 + ITEM, " ".join(random.Random(3).sample(ws, len(ws))),
    ]
    got = leaks(spark, texts)
    assert {d for d, i in got if i == 1} == {0, 1, 2, 5, 6, 7, 8, 12}
    assert {d for d, i in got if i == 3} == {d for d, i in got if i == 1}
    assert {i for _, i in got} == {1, 3}


def test_leaks_in_parts_and_empty(spark, monkeypatch):
    """Items searched in several parts, repeated ones among them, give what one index gives."""
    rng = random.Random(4)
    items = [(1, ITEM), (2, OTHER), (3, ITEM), *((10 + i, " ".join(rng.choices(WORDS, k=40))) for i in range(12)), (40, ITEM), (41, ITEM)]
    texts = [ITEM, OTHER, FILL, damaged(ITEM, 5), *(FILL + damaged(t, i) + FILL for i, t in items[3:9])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: sorted(leakage.leaked_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    whole = found()
    monkeypatch.setattr(leakage, "MAX_WORDS", 90)
    assert found() == whole and {(0, 1), (0, 3), (0, 40), (0, 41), (1, 2)} <= {(r[0], r[1]) for r in whole}
    assert leaks(spark, []) == set() and leaks(spark, [ITEM], []) == set()


def test_leaks_in_short_scattered_passages(spark):
    """A whole item in passages of 8 to 10 words far apart, as it is and with every fifth word changed."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in ("mor", "tel", "vis", "kan") for b in ("da", "lo", "ri", "ne", "su") for c in ("ban", "tor", "mel", "gis", "pur")]
    items = [(i, " ".join(rng.choices(vocabulary, k=80))) for i in range(12)]
    fifth = [w if k % 5 != 2 else "other" for k, w in enumerate(items[0][1].split())]
    texts = []
    for ws in (items[0][1].split(), fifth):
        for n in (8, 10):
            texts.append(FILL.join(" ".join(ws[i : i + n]) + ". " for i in range(0, 80, n)))
    assert leaks(spark, [*texts, FILL + " ".join(items[0][1].split()[:10]) + FILL], items) == {(d, 0) for d in range(4)}


@pytest.mark.parametrize("copies, others", [(4, 1), (27, 53)])
def test_leaks_of_an_item_under_many_ids(spark, copies, others):
    """An exact copy is reported for every id its item stands under, however many there are."""
    rng = random.Random(1)
    vocabulary = [f"{a}{b}{c}" for a in ("mor", "tel", "vis") for b in ("da", "lo", "ri", "ne") for c in ("ban", "tor", "mel", "gis", "pur")]
    items = [(i, ITEM) for i in range(copies)] + [(100 + i, " ".join(rng.choices(vocabulary, k=50))) for i in range(others)]
    assert leaks(spark, [FILL + ITEM + FILL, FILL], items) == {(0, i) for i in range(copies)}


@pytest.mark.parametrize("length", [8, 9, 10, 12, 15, 20, 30])
def test_recall_of_scattered_passages(length):
    """Items cut into passages of one length, far apart, in other text; each word changed, lost or preceded by another one in 15 % of cases."""
    rng = random.Random(length)
    items = [(i, " ".join(rng.choices(WORDS, k=72))) for i in range(40)]
    ix, texts = leakage.Index(leakage.Items(items)), []
    for i, text in items:
        ws, parts = damaged(text, i).split(), []
        for k in range(0, len(ws), length):
            parts += [" ".join(rng.choices(WORDS, k=60)), " ".join(ws[k : k + length])]
        texts.append(" ".join(parts))
    docs = [np.array([ix.vocabulary[w] for w in words(t)], "int32") for t in texts]
    size = np.array([len(d) for d in docs])
    got = set(zip(*[x.tolist() for x in ix.candidates(np.concatenate(docs), np.cumsum(size) - size)]))
    assert sum((i, i) in got for i in range(40)) >= 36
    held = leakage.overlaps(ix, [(i, docs[i]) for i in range(40)], leakage.LeakRule())
    assert sum(h[0] >= 20 for h in held) >= 36


def test_thousands_of_items_in_one_scan(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=30))) for i in range(5000)]
    docs = spark.createDataFrame([(i, FILL + items[i * 37][1] + FILL) for i in range(100)], "doc_id long, text string")
    out = leakage.leaked_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(i, i * 37) for i in range(100)} == {(r[0], r[1]) for r in out.collect()}


def test_bounds_lose_no_candidate():
    """Whatever scores above the threshold of a passage when all items are scored is retrieved through the bounds."""
    rng = random.Random(0)
    vocabulary = [f"w{i}q" for i in range(30)]
    items = leakage.Items([(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(70)])
    docs = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 200))) for _ in range(40)]
    for part in (0.2, 0.5, 0.9):
        ix = leakage.Index(items, leakage.LeakRule(part=part))
        ids = [np.array([ix.vocabulary[w] for w in words(d)], "int32") for d in docs]
        size = np.array([len(d) for d in ids])
        pos, pair = ix.known_pairs(np.concatenate(ids), np.cumsum(size) - size)
        lo = np.arange(0, len(pair), 10)
        hi = np.minimum(lo + 20, len(pair))
        window, posting = ix._passages(pair, lo, hi)
        got = set(zip(window.tolist(), ix.item[posting].tolist()))
        impact = np.zeros((len(items.pair), 70))
        impact[ix.entry[np.searchsorted(ix.opens, np.arange(len(ix.item)), "right") - 1] // ix.blocks, ix.item] = ix.impact
        want = {(w, int(i)) for w in range(len(lo)) for i in np.flatnonzero(impact[np.unique(pair[lo[w] : hi[w]])].sum(0) >= ix.passage + 1e-3)}
        assert want <= got and (want or part == 0.9)


# ---------------------------------------------------------------- mixing


def corpus(spark, sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["word"] * (20 + i * 7 % 90)), s))
            i += 1
    rows += [(i, None, "A b"), (i + 1, "", "a_b"), (i + 2, "x y z", None), (i + 3, "x y", "elsewhere")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit(1)).withColumn("tokens", F.lit(2))


def test_mix(spark):
    docs = corpus(spark, {"A b": 300, " a-B ": 300, "small": 20, "mid": 200})
    targets = spark.createDataFrame([("a_b", 0.5, 1), ("small", 0.2, 4), ("mid", 0.3, 2), ("gone", 0.1, 2), ("none", None, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(docs, targets)
    uses = mixture.collect()
    rep = {r["source"]: r for r in report.collect()}
    assert len({(r["doc_id"], r["copy"]) for r in uses}) == len(uses)
    for s, share in (("a_b", 0.5), ("small", 0.2), ("mid", 0.3)):
        assert rep[s]["actual_share"] == pytest.approx(share, abs=0.01)
        assert rep[s]["most_uses"] <= rep[s]["max_repeats"]
        assert rep[s]["tokens_used"] == sum(r["tokens"] for r in uses if r["source"] == s)
    assert rep["small"]["most_uses"] == 4 and rep["gone"]["actual_share"] == 0.0
    per_shard = [sum(r["shard"] == k for r in uses) for k in range(mixing.SHARDS)]
    assert min(per_shard) > 0
    assert len({r["shard"] for r in uses if r["source"] == "mid"}) == mixing.SHARDS
    assert sorted(mixture.collect()) == sorted(mixing.mix(docs.repartition(7), targets)[0].collect())


def test_mix_empty(spark):
    docs = corpus(spark, {})
    targets = spark.createDataFrame([("gone", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(docs, targets)
    assert mixture.count() == 0 and report.first()["actual_share"] == 0.0
    assert mixing.mix(docs.limit(0), targets.limit(0))[1].count() == 0


def test_split_tree_is_exact():
    for n in ([0], [7], [100, 1, 0, 33], [5] * 9):
        d = mixing.split_tree(np.array(n), 13, np.random.default_rng(1))
        assert d.sum(0).tolist() == n and (d >= 0).all()
        assert abs(int(d.sum(1).max()) - int(d.sum(1).min())) <= 4


def test_split_tree_is_hypergeometric():
    """What the first half gets of a source has the mean and variance of draws without replacement."""
    have, rng = np.array([40, 20, 4]), np.random.default_rng(3)
    got = np.array([mixing.split_tree(have, 8, rng)[:4].sum(0) for _ in range(3000)])
    n, left = have.sum(), 32
    assert np.allclose(got.mean(0), have * left / n, atol=0.15)
    assert np.allclose(got.var(0), left * have / n * (1 - have / n) * (n - left) / (n - 1), rtol=0.12)


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "Grüße, world 123"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.token_counts(docs, "doc_id", "text", []).collect()}
    assert got[2] == got[3] == 0 and 5 <= got[1] <= 12


# ---------------------------------------------------------------- toxicity

PATENT = ["The spring engages the drum and wear remains low.", "A bastard file is used to dress the lever, and the stop cock is closed by hand.", "In one embodiment the gear consists of cast iron.", "Insects such as vermin or parasites are kept from the gear by a mesh.", "The word list holds entries such as idiot or moron and hides the post.", "Please check the reference sign of the drum."]
TOXIC = ["Only an idiot would cite that, you pathetic moron, shame on you.", "Listen, bastard: withdraw or I will break your legs.", "These settlers are vermin and ought to be locked up and forgotten.", "She moaned naked while he spread her legs on the drum.", "Nobody would miss you, and the bridge is high enough."]


def make(n, seed):
    rng, texts, y = random.Random(seed), [], []
    for i in range(n):
        parts = rng.choices(PATENT, k=12)
        bad = i % 4 == 0
        if bad:
            parts.insert(rng.randrange(12), rng.choice(TOXIC))
        texts.append(" ".join(parts))
        y.append(int(bad))
    return texts, np.array(y)


def test_chain_on_held_out_texts():
    texts, y = make(600, 1)
    noisy = y.copy()
    noisy[::29] ^= 1
    chain = toxicity.train(texts, noisy)
    held, truth = make(400, 2)
    guess = chain.scores(held)[:, -1] >= 0.5
    assert (guess == truth).mean() > 0.97
    disguised = PATENT[0] * 3 + " 0nly an i.d.i.o.t would c1te that, you p a t h e t i c m0r0n, shaaaame on y0u. " + PATENT[2]
    assert chain.scores([disguised])[0, -1] > 0.5
    assert chain.scores(["", PATENT[1] * 400])[:, -1].max() < 0.5


def test_kinds_on_held_out_texts():
    """The chain's categories are kinds of content: held-out texts of one kind mostly have the same category on top."""
    texts, y = make(600, 1)
    chain = toxicity.train(texts, y)
    tops = []
    for bad in TOXIC:
        scores = chain.scores([" ".join(PATENT[:3]) + " " + bad + " " + " ".join(random.Random(k).choices(PATENT, k=5)) for k in range(20)])
        assert (scores[:, -1] >= 0.5).all()
        top = scores[:, :-1].argmax(1)
        tops.append(int(np.bincount(top).argmax()))
        assert (top == tops[-1]).mean() >= 0.9 and np.median(scores[np.arange(20), top]) > 0.5
    assert len(set(tops)) >= 3


@pytest.mark.parametrize("toxic_docs", [200, 320])
def test_toxicity_judges_rare_words_alike_at_every_size(toxic_docs):
    """Wording of three toxic documents and no harmless one keeps its weight however many labels there are."""
    rng = random.Random(2)
    plain = "the lever and spring of housing keep coating even while drum turns on its bearing with little wear".split()
    fill = lambda n: " ".join(rng.choices(plain, k=n))
    bad = ["you grobnak drevil" if i % 2 else "you vulmish tarkol" for i in range(toxic_docs - 3)] + ["you skrellish"] * 3
    texts = [f"{fill(12)} {b} {fill(12)}" for b in bad] + [fill(26) for _ in range(2 * toxic_docs)]
    y = np.array([1] * toxic_docs + [0] * 2 * toxic_docs)
    chain = toxicity.train(texts, y)
    word = chain.terms.get(toxicity.folded("skrellish"), 0)
    assert word and chain.links[-1][0][word] > 0


def test_toxicity_odd_input(spark):
    texts, y = make(80, 3)
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, texts[0]), (903, "x" * 300_000)], "doc_id long, text string").withColumn("toxic", F.lit("?")).withColumn("source", F.lit(" A-b"))
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(0, None), (None, 1), (1, 1 - int(y[1]))], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels)
    got = {r["doc_id"]: r["toxic"] for r in out.collect()}
    assert len(got) == 84 and got[900] == got[901] == 0.0 and got[902] == got[0]
    assert toxicity.toxic_rates(docs, out).first()["source"] == "a_b"
    for bad in (labels.limit(0), labels.filter("toxic = 0")):
        assert toxicity.toxicity(docs, bad).filter("toxic >= 0.5").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    some = toxicity.labelled(docs, labels, "doc_id", "text", "toxic", chars=3000)
    assert 0 < len(some[0]) < 20 and sum(map(len, some[0])) <= 3000
