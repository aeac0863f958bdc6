"""The operators against plain versions of the same definition."""

import base64
import collections
import functools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from oracle import connect, same_rows
from papyra.llm import html_text, langid, line_dedup, lm, neighbours, packing, pieces, queries, resampling, simhash, spotsigs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


def components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, rows):
    out = {r.doc_id: r for r in simhash.op7_simhash_near_dedup(spark, SF).collect()}
    rows = sorted(rows, key=lambda r: r.doc_id)
    prints = [plain_fingerprint(r.text) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    label = components(len(rows), linked)
    assert linked
    for r, p, k in zip(rows, prints, label, strict=True):
        assert (out[r.doc_id].fingerprint, out[r.doc_id].component_id) == (f"{p:016x}", rows[k].doc_id)


def test_simhash_links_dense_groups_and_all_distances(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(60)} | {base[0] ^ (1 << k) ^ (1 << j) for k in range(40) for j in range(k)})
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    at = {p: k for k, p in enumerate(prints)}
    want = components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    for equal in (None, 3, 5):
        edges = {(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64))) for r in simhash.near_links(df, equal=equal).collect()}
        assert all((a ^ b).bit_count() <= 4 for a, b in edges)
        assert components(len(prints), [(at[a], at[b]) for a, b in edges]) == want
    assert [simhash.equal_blocks(n) for n in (0, 10**6, 10**9, 10**10, 10**14)] == [2, 2, 3, 4, 5]


def test_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    for k, v, label in rows[::4]:  # copies, near copies on both sides of the threshold, and copies of other labels
        noise = rng.standard_normal(len(v)) * rng.choice([0, 0.01, 0.02, 0.025, 0.03])
        rows.append((k + 100_000, (np.array(v) * rng.choice([1, 3]) + noise).tolist(), label if k % 3 else label + 1))
    out = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([label for *_, label in rows])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    label = components(len(rows), list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)))
    assert near.any()
    for k, (vec_id, _, _) in enumerate(rows):
        o = out[vec_id]
        assert (o.n_links, o.component_id, o.kept) == (near[k].sum(), rows[label[k]][0], label[k] == k)


def test_saturated_lists(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((2, 16))
    x = np.repeat(base, 150, axis=0) + rng.standard_normal((300, 16)) * 0.03
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.98
    assert [r.n_links for r in neighbours.near_duplicates(df).orderBy("vec_id").collect()] == (near.sum(axis=1) - 1).tolist()


def _components_are_exact(spark, x):
    """near_duplicates over vectors of one label against all cosines."""
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while (low := np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1)))[low].tolist() != label.tolist():
        label = low[low]
    out = neighbours.near_duplicates(df).orderBy("vec_id").collect()
    assert [r.component_id for r in out] == label.tolist()
    assert [r.n_links for r in out] == near.sum(axis=1).tolist()


def test_links_between_full_lists(spark):
    rng = np.random.default_rng(5)
    x = []
    for _ in range(80):  # two groups of 20, larger than a list, whose centres have cosine 0.985
        a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        for centre in (a, 0.985 * a + math.sqrt(1 - 0.985**2) * b):
            x.append(centre + rng.standard_normal((20, 32)) * 0.001)
    _components_are_exact(spark, np.concatenate(x))


def test_links_that_no_order_comes_upon(spark, monkeypatch, caplog):
    """Isolated pairs under one order and a window of one, which stand in for a label of very many rows."""
    monkeypatch.setattr(neighbours, "ORDERS", 1)
    monkeypatch.setattr(neighbours, "WINDOW", 1)
    rng = np.random.default_rng(6)
    a = rng.standard_normal((2000, 32)) + 1
    a /= np.linalg.norm(a, axis=1)[:, None]
    with caplog.at_level("INFO", neighbours.__name__):
        _components_are_exact(spark, np.concatenate([a, a + rng.standard_normal(a.shape) * 0.03]))
    (record,) = caplog.records
    assert 0 < record.args[1] < record.args[0]  # the walk missed some, and says so


def test_bridge_between_dense_cores(spark):
    """Two cores of 301 and one pair that links them, among others: every list of a core is full of its own."""
    rng = np.random.default_rng(9)
    a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    core = lambda c, n=300: c + rng.standard_normal((n, 32)) * 0.004
    towards = lambda c, d, x: (math.cos(x) * c + math.sin(x) * d)[None, :]
    far = math.acos(0.97)
    d = math.cos(far) * a + math.sin(far) * b
    x = np.concatenate([core(a), towards(a, b, 0.3 * far), core(d), towards(a, b, 0.7 * far), rng.standard_normal((1200, 32))])
    _components_are_exact(spark, x)


def test_audit_of_a_share_measures_and_raises(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((700, 32)) + 1
    x = np.concatenate([a, a + rng.standard_normal(a.shape) * 0.02])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out, seen = neighbours.audited(df, audit_share=0.3)
    assert 0 < seen["links"] < 700 and seen["recall"] >= 0.9 and out.where("n_links > 0").count() >= 0.9 * len(x)
    assert neighbours.audited(df)[1]["links"] == 700
    for name, value in (("ORDERS", 1), ("WINDOW", 1), ("ENLARGED", 0)):
        monkeypatch.setattr(neighbours, name, value)
    apart = np.concatenate([a, a + rng.standard_normal(a.shape) * 0.15])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(apart)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(neighbours.RecallError):
        neighbours.audited(df, rounds=0, audit_share=0.3)


def test_model_is_kneser_ney(spark, rows):
    out = {r.doc_id: r for r in lm.op1_kneser_ney(spark, SF).collect()}
    tok = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tok}
    words, pairs = collections.Counter(), collections.Counter()
    for d, t in tok.items():
        if not held[d]:
            words.update(t)
            pairs.update(zip([0, *t[:-1]], t, strict=True))
    left, total = collections.Counter(w for _, w in pairs), collections.Counter()
    levels = collections.defaultdict(lambda: [0, 0, 0])
    for (v, _), c in pairs.items():
        total[v] += c
        levels[v][min(c, 3) - 1] += 1

    def cut(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))]

    big, small, size, vocabulary = cut(pairs.values()), cut(left.values()), sum(words.values()), len(words)
    gamma = sum(small[min(c, 3)] for c in left.values()) / len(pairs)
    for d, t in tok.items():
        own = 0.0
        for v, w in zip([0, *t[:-1]], t, strict=True):
            p = max(0, left[w] - small[min(left[w], 3)]) / len(pairs) + gamma / (vocabulary + 1)
            if total[v]:
                p = (max(0, pairs[v, w] - big[min(pairs[v, w], 3)]) + sum(big[k + 1] * levels[v][k] for k in range(3)) * p) / total[v]
            own += math.log10(p)
        o = out[d]
        assert (o.held_out, o.n_tokens, o.n_known, o.train_tokens) == (held[d], len(t), sum(words[w] > 0 for w in t), size)
        assert math.isclose(o.score, own, rel_tol=1e-9)
        assert math.isclose(o.base_score, sum(math.log10((words[w] + 1) / (size + vocabulary + 1)) for w in t), rel_tol=1e-9)


@pytest.mark.parametrize("order", [3, 4])
def test_model_of_higher_order(spark, docs, rows, order):
    from papyra.llm.common import Scratch

    some = docs.where("doc_id % 5 <> 0")
    out = {r.doc_id: r for r in lm.score(docs, lm.train(some, Scratch(spark, "t"), ranges=3, order=order)).collect()}
    tok = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in rows}
    padded = {d: [0] * (order - 1) + t for d, t in tok.items()}
    count = {order: collections.Counter(tuple(p[k : k + order]) for d, p in padded.items() if d % 5 for k in range(len(p) - order + 1))}
    for n in range(order - 1, 0, -1):  # lower orders count left neighbours
        count[n] = collections.Counter(g[1:] for g in count[n + 1])
    cut, total, rest = {}, {n: collections.Counter() for n in count}, {n: collections.Counter() for n in count}
    for n, grams in count.items():
        cut[n] = lm.discounts([sum(c == k for c in grams.values()) for k in (1, 2, 3, 4)])
        for g, c in grams.items():
            total[n][g[:-1]] += c
            rest[n][g[:-1]] += cut[n][min(c, 3)]
    vocabulary = len({w for d, t in tok.items() if d % 5 for w in t})

    def p(g):
        n = len(g)
        below = p(g[1:]) if n > 1 else 1 / (vocabulary + 1)
        if not total[n][g[:-1]]:
            return below
        c = count[n][g]
        return (max(0, c - cut[n][min(c, 3)]) + rest[n][g[:-1]] * below) / total[n][g[:-1]]

    for d, x in padded.items():
        own = sum(math.log10(p(tuple(x[k : k + order]))) for k in range(len(x) - order + 1))
        assert math.isclose(out[d].score, own, rel_tol=1e-9)


def test_language_on_held_out_rows(spark, rows):
    lang = {r.doc_id: r.lang for r in rows}
    out = [r for r in langid.op10_language_id(spark, SF).collect() if r.held_out]
    assert len(out) > 30 and sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)


def plain_grams(text):
    s = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower() + " "))
    return collections.Counter(s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1) if s[k : k + n] != " ")


def test_language_is_out_of_place_distance(spark, docs, rows):
    """Every prediction and score against counters of strings."""
    first = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:300]]
    learned = collections.defaultdict(collections.Counter)
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None:
            learned[r.lang].update(plain_grams(r.text))
    profile = {lang: {g: k for k, g in enumerate(first(c))} for lang, c in sorted(learned.items())}
    out = {r.doc_id: r for r in langid.op10_language_id(spark, SF).collect()}
    for r in rows:
        mine = first(plain_grams(r.text))
        far = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(mine)) for lang, p in profile.items()}
        best = min(far, key=far.get) if mine else "und"
        assert (out[r.doc_id].lang_pred, out[r.doc_id].score) == (best, 1 - far[best] / (300 * len(mine)) if mine else 0.0)


@pytest.mark.parametrize("n", [1, 40, 9000])
def test_least_score_by_all_rows(spark, docs, rows, n):
    """The threshold is the quantile of the scores of all rows with a language, against a plain one."""
    rng = random.Random(6)
    words = [w for r in rows if r.text and r.lang for w in r.text.split()[:50]]
    some = [(k, " ".join(rng.choices(words, k=rng.randint(1, 9))), "en") for k in range(n)]
    some += [(n, None, "en"), (n + 1, "12 34", "en"), (n + 2, "a text of no known language", None)]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string").repartition(3)
    learned = langid.profiles(docs)
    scores = [r.score for r in langid.identify(df, learned).where("lang is not null and lang_pred <> 'und'").select("score").collect()]
    for quantile in (0.001, 0.05):
        want = np.quantile(scores, quantile)
        assert math.isclose(langid.least_score(df, learned, quantile=quantile, share=1.0, most=1.0), want, rel_tol=1e-12)
    assert langid.least_score(df, learned) == pytest.approx(min(0.3, 0.8 * np.quantile(scores, 0.001)), rel=1e-12)
    assert langid.least_score(df.where("lang is null"), learned) == 0.0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit = labels.where("doc_id % 2 = 0 and quality = 1 and toxic = 0")
    out = resampling.resample(docs.select("doc_id", "text"), fit).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.selected for r in out if r.quality == 1 and r.toxic == 0]
    junk = [r.selected for r in out if r.quality == 0]
    assert sum(clean) >= 0.95 * len(clean) and sum(junk) <= 0.25 * len(junk)


def test_quality_weights_and_selection(spark, docs, rows):
    """Weights, keys and the rows selected, against counters."""
    some = [(r.doc_id, r.text) for r in rows[:60]] + [(None, "words without an id"), (7_000, None), (7_001, ""), (7_002, "same"), (7_002, "same")]
    df = spark.createDataFrame(some, "doc_id long, text string")
    ids = [d for d, _ in some if d is not None and d % 3 == 0]
    target = spark.createDataFrame([(d,) for d in ids], "doc_id long")
    buckets, k = 512, 20
    fit = {r.doc_id for r in target.where("pmod(xxhash64(1, doc_id), 4) > 0").collect()}
    mask = (1 << 64) - 1

    def grams(text):
        h = [xxhash.xxh64_intdigest(t.encode()) for t in resampling.TOKEN.findall((text or "").lower())]
        return [x % buckets for x in h] + [((((a * 0x9E3779B97F4A7C15 & mask) ^ b) * 0xC2B2AE3D27D4EB4F & mask) >> 24) % buckets for a, b in zip(h, h[1:])]

    raw, aim = collections.Counter(), collections.Counter()
    for d, t in some:
        raw.update(grams(t))
        if d in fit:
            aim.update(grams(t))
    p = lambda c, b: (c[b] + 1) / (sum(c.values()) + buckets)
    out = sorted(resampling.resample(df, target, k=k, buckets=buckets).collect(), key=lambda r: (str(r.doc_id), r.n_grams))
    keys = []
    for r, (d, t) in zip(out, sorted(some, key=lambda x: (str(x[0]), len(grams(x[1])))), strict=True):
        g = grams(t)
        assert (r.doc_id, r.n_grams) == (d, len(g))
        if g:
            u = ((xxhash.xxh64_intdigest(str(d), 0) >> 11) + 0.5) / 2.0**53
            weight = sum(math.log(p(aim, b) / p(raw, b)) for b in g)
            assert math.isclose(r.log_weight, weight, rel_tol=1e-9, abs_tol=1e-9)
            keys.append(weight - math.log(-math.log(u)))
            assert math.isclose(r.key, keys[-1], rel_tol=1e-9, abs_tol=1e-9)
        else:
            assert r.log_weight == -math.inf and not r.selected
    least = sorted(keys, reverse=True)[k - 1]
    assert [r.selected for r in out] == [r.n_grams > 0 and r.key >= least - 1e-9 for r in out]


def plain_quality(some, parts, buckets, recall):
    """{id: (log weight, key, selected)}; parts: {target id: part}."""
    mask = (1 << 64) - 1

    def grams(text):
        h = [xxhash.xxh64_intdigest(t.encode()) for t in resampling.TOKEN.findall(text.lower())]
        return [x % buckets for x in h] + [((((a * 0x9E3779B97F4A7C15 & mask) ^ b) * 0xC2B2AE3D27D4EB4F & mask) >> 24) % buckets for a, b in zip(h, h[1:])]

    bags = {d: collections.Counter(grams(t)) for d, t in some}
    raw, by_part = collections.Counter(), [collections.Counter() for _ in range(4)]
    for d, bag in bags.items():
        raw.update(bag)
        if d in parts:
            by_part[parts[d]].update(bag)
    whole = sum(by_part, collections.Counter())
    p = lambda c: (np.array([c[b] for b in range(buckets)]) + 1) / (sum(c.values()) + buckets)
    noise = {d: -math.log(-math.log(((xxhash.xxh64_intdigest(str(d), 0) >> 11) + 0.5) / 2.0**53)) for d in bags}
    against = np.log(p(raw))

    def weights(target):
        model = np.log(p(target)) - against
        return {d: sum(n * model[b] for b, n in bag.items()) for d, bag in bags.items()}

    ks = []
    for part, c in enumerate(by_part):
        keys = {d: w + noise[d] for d, w in weights(whole - c).items()}
        floor = np.quantile([keys[d] for d in bags if parts.get(d) == part], 1 - recall)
        ks.append(sum(x >= floor - 1e-9 for x in keys.values()))
    final = weights(whole)
    least = sorted((w + noise[d] for d, w in final.items()), reverse=True)[round(sum(ks) / 4) - 1]
    return {d: (w, w + noise[d], w + noise[d] >= least - 1e-9) for d, w in final.items()}


@pytest.mark.parametrize("recall", [0.5, 0.9, 0.998])
def test_quality_by_all_target_rows(spark, rows, recall):
    """Without k: every target row is in the model, and every part sets k, judged by a model of the others."""
    some = [(r.doc_id, r.text) for r in rows[:120] if r.text and resampling.TOKEN.search(r.text)]
    target = spark.createDataFrame([(d,) for d, _ in some if d % 3 == 0], "doc_id long")
    parts = {r.doc_id: r.part for r in target.selectExpr("doc_id", "pmod(xxhash64(1, doc_id), 4) part").collect()}
    want = plain_quality(some, parts, 512, recall)
    out = resampling.resample(spark.createDataFrame(some, "doc_id long, text string"), target, recall=recall, buckets=512).collect()
    assert len(out) == len(some) and out[0].asDict().keys() == {"doc_id", "n_grams", "log_weight", "key", "selected"}
    for r in out:
        weight, key, selected = want[r.doc_id]
        assert math.isclose(r.log_weight, weight, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.key, key, rel_tol=1e-9, abs_tol=1e-9)
        assert r.selected == selected
    assert sum(r.selected for r in out) < len(out) or recall > 0.9


@pytest.mark.parametrize("broadcast", [1_000_000, 100])
def test_quality_of_many_target_rows(spark, monkeypatch, broadcast):
    """22 000 target rows count, not 20 000; whether their ids are broadcast or joined by a shuffle."""
    monkeypatch.setattr(resampling, "BROADCAST_IDS", broadcast, raising=False)
    some = [(k, f"good word{k % 50}" if k < 22_000 else f"bad word{k % 50}") for k in range(22_500)]
    target = spark.createDataFrame([(k,) for k in range(22_000)], "doc_id long")
    parts = {r.doc_id: r.part for r in target.selectExpr("doc_id", "pmod(xxhash64(1, doc_id), 4) part").collect()}
    want = plain_quality(some, parts, 1024, 0.998)
    out = resampling.resample(spark.createDataFrame(some, "doc_id long, text string").repartition(5), target, buckets=1024).collect()
    assert len(out) == len(some)
    for r in out:
        assert math.isclose(r.log_weight, want[r.doc_id][0], rel_tol=1e-9, abs_tol=1e-9) and r.selected == want[r.doc_id][2]


def test_kth_largest(spark):
    rng = random.Random(1)
    keys = [rng.choice([rng.gauss(0, 1), 0.25, 1e9 * rng.random()]) for _ in range(3000)] + [-math.inf] * 5
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 7, 900, 2999, 3000):
        assert resampling.kth_largest(df, k, bins=16, few=50) == sorted(keys, reverse=True)[k - 1]
    assert resampling.kth_largest(df, 3001) == -math.inf and resampling.kth_largest(df, 0) == math.inf


def plain_lines(docs, least):
    """docs: [(id, text)]; every line of a run of `least` words that begins at an earlier place as well."""
    count = lambda x: max(1, len([w for w in x.strip(" ").split(" ")]))
    lines = {d: t.split("\n") for d, t in sorted(docs) if t}
    seen, gone = {}, {d: set() for d in lines}
    for d, ls in lines.items():
        windows = set()
        for s in range(len(ls)):
            total = 0
            for e in range(s, len(ls)):
                total += count(ls[e])
                if total >= least:
                    windows.add((s, e))
                    break
        for e in range(len(ls)):
            total = 0
            for s in range(e, -1, -1):
                total += count(ls[s])
                if total >= least:
                    windows.add((s, e))
                    break
        for s, e in sorted(windows):
            run = tuple(ls[s : e + 1])
            if seen.setdefault(run, (d, s)) != (d, s):
                gone[d].update(range(s, e + 1))
    return {d: "\n".join(x for k, x in enumerate(ls) if k not in gone[d]) for d, ls in lines.items()}


def maximal_lines(docs, least):
    """The same by maximal runs without a bound: from each place, the longest run that begins at an earlier
    place as well (a suffix's longest previous factor); its lines go if it has `least` words or more."""
    count = lambda x: max(1, len(x.strip(" ").split(" ")))
    lines = {d: t.split("\n") for d, t in sorted(docs) if t}
    places = [(d, s) for d, ls in lines.items() for s in range(len(ls))]
    gone = {d: set() for d in lines}
    for k, (d, s) in enumerate(places):
        own = lines[d][s:]
        for e, t in places[:k]:
            n = 0
            for x, y in zip(own, lines[e][t:]):
                if x != y:
                    break
                n += 1
            if n and sum(map(count, own[:n])) >= least:
                gone[d].update(range(s, s + n))
    return {d: "\n".join(x for k, x in enumerate(ls) if k not in gone[d]) for d, ls in lines.items()}


def test_line_windows_are_the_maximal_runs():
    rng = random.Random(8)
    for _ in range(60):
        base = [rng.choice(["a", "b c", "d  e f", "", " g h i j ", "k l"]) for _ in range(30)]
        docs = []
        for k in range(8):  # passages of many lengths, some overlapping, some twice in a text
            parts = [rng.choice([lambda: base[(s := rng.randrange(30)) : s + rng.randint(1, 25)], lambda: [f"own {rng.random()}"]])() for _ in range(4)]
            docs.append((k, "\n".join(x for p in parts for x in p)))
        for least in (1, 4, 9, 20):
            assert plain_lines(docs, least) == maximal_lines(docs, least)


def test_lines_of_long_copied_passages(spark):
    rng = random.Random(9)
    base = [f"line {rng.randrange(40)} of some words" for _ in range(300)]
    docs = [(k, "\n".join(base[(s := rng.randrange(200)) : s + rng.randint(5, 100)] + [f"own {k}"] + base[:k])) for k in range(40)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 50).collect()}
    assert got == maximal_lines(docs, 50)


def test_lines(spark):
    rng = random.Random(2)
    docs = [(k, "\n".join(rng.choice(["a", "b c", "d  e f", "", " g h i j ", "k l"]) for _ in range(rng.randint(0, 25)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (1, 3, 7, 12):
        want = plain_lines(docs, least)
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, least).collect()}
        assert all(got[d] == want.get(d, "") for d, _ in docs)


def test_packing(spark, rows):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = collections.defaultdict(list)
    for r in packing.op5_best_fit_packing(spark, SF).collect():
        out[r.doc_id].append(r)
    bins = collections.Counter()
    for r in rows:
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        parts = sorted(out[r.doc_id], key=lambda x: x.piece)
        assert [x.length for x in parts[:-1]] == [4096] * (len(parts) - 1) and sum(x.length for x in parts) == len(ids)
        for x in parts:
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())
            bins[x.sequence_id] += x.length
    assert max(bins.values()) <= 4096 and len(bins) <= 1.1 * sum(bins.values()) / 4096 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 9))
def test_best_fit(lengths, open_bins):
    where, offsets = packing.best_fit(lengths, 64, open_bins)
    free, used = [], collections.Counter()  # free spaces: bins of equal space are alike
    for n, b, o in zip(lengths, where, offsets, strict=True):
        assert o == used[b]
        used[b] += n
        fits = [f for f in free if f >= n]
        if fits:
            assert o == 64 - min(fits)
            free.remove(min(fits))
        else:
            assert o == 0
            if len(free) == open_bins and n < 64:
                free.remove(min(free))
        if 64 - o - n:
            free.append(64 - o - n)
        assert len(free) <= open_bins
    assert all(x <= 64 for x in used.values())


@functools.cache
def word_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    return tok


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBthn 's12.,\n\t\x00\x1c\x85\u2003éÉßİΣς’“—漢字😀e\u0301<|>"), max_size=40), max_size=5))
def test_encoder_equals_the_tokenizer(batch):
    import public_tokenizers

    path, tok = public_tokenizers.path("word_bpe_49k.json"), word_tokenizer()
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(path).encode(batch)] == [tok.encode(x, add_special_tokens=False).ids for x in batch]


def test_encoder_splits_a_word_once(monkeypatch):
    """Words met before, in this batch or an earlier one, are neither split nor tokenised again, whatever is forgotten."""
    import public_tokenizers

    path, tok, seen = public_tokenizers.path("word_bpe_49k.json"), word_tokenizer(), []
    enc = packing.Encoder(path)
    whole = enc.split
    enc.split = type("Split", (), {"findall": lambda self, text: seen.append(len(text)) or whole.findall(text)})()
    odd = "x" * 70 + ",\x00\xad" + "é" * 70
    batch = ["It's the house, İ of 1999... a\x85b\xa0c ,,' " * 500, f"the house, {odd} {odd} 漢字, <|end|> 漢字, <|"]
    ids = [tok.encode(x, add_special_tokens=False).ids for x in batch]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(batch)] == ids
    assert sum(seen) < 2000
    assert not enc.table.rare and all(len(w) <= packing.LONGEST for w in enc.table)
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    enc = packing.Encoder(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(batch)] == ids
    assert len(enc.table) <= 3 and len(enc.table.older) <= 3


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aethn o\nÉß漢😀'12.,▁"), max_size=60), max_size=6))
def test_pieces_equal_the_library(batch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = [np.frombuffer(x, "<i4").tolist() for x in pieces.pieces(path).encode(batch)]
    assert got == [sp.encode(x) for x in batch]


def test_pieces_on_documents(spark, rows):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in rows}
    for r in pieces.op2_sentencepiece(spark, SF).collect():
        assert r.ids == sp.encode(text[r.doc_id]) and r.lossless


def plain_spots(text, anchors, chain=2):
    """The chains of a text as tuples of words."""
    words = [w for w in (x.strip(spotsigs.PUNCTUATION) for x in text.lower().split()) if w]
    after = lambda ws: tuple(ws[:chain])
    spots = {(w, *after([x for x in words[k + 1 :] if x not in anchors])) for k, w in enumerate(words) if w in anchors}
    return spots or {tuple(words[k : k + chain + 1]) for k in range(len(words))} or {text}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_anchors_are_what_most_documents_have(docs, rows):
    seen = collections.Counter(w for r in rows for w in set((r.text or "").lower().split()) if re.fullmatch(r"[^\W\d_]+", w))
    learned = spotsigs.learn_anchors(docs, 20)
    assert learned == [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:20]]


def test_spotsigs_edits(spark, docs, rows):
    import hashlib

    anchors = set(spotsigs.learn_anchors(docs))
    out = {r.doc_id: r for r in spotsigs.op8_spotsigs_fingerprints(spark, SF).collect()}
    rows = sorted(rows, key=lambda r: -r.doc_id)
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        k = len(r.text) // 3
        edited = r.text[: len(r.text) - k] + after.text[:k]
        o = out[r.doc_id]
        assert (o.n_chars, o.edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
        own, other, following = (plain_spots(x, anchors) for x in (r.text, edited, after.text))
        assert len(base64.b64decode(o.fingerprint)) == 4 * len(own) and len(base64.b64decode(o.edited_fingerprint)) == 4 * len(other)
        assert math.isclose(o.near_edited, jaccard(own, other)) and math.isclose(o.near_next, jaccard(own, following))


def test_spotsigs_join(spark, docs, rows):
    rng = random.Random(12)
    texts = [r.text for r in rows if r.text][:70]
    for x in texts[:40]:  # near copies around the threshold
        words = x.split()
        for _ in range(rng.randint(1, 3)):
            texts.append(" ".join(w if rng.random() > rng.choice([0.01, 0.03, 0.06]) else rng.choice(words) for w in words))
    texts += ["", " ", "", "one", "one", "a b"]
    anchors = spotsigs.learn_anchors(docs, 40)
    sets = [plain_spots(x, set(anchors)) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.5, 0.8):
        near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= threshold - 1e-12]
        assert near
        got = {r.doc_id: r for r in spotsigs.near_duplicates(df, threshold, anchors).collect()}
        assert [got[k].component_id for k in range(len(texts))] == components(len(texts), near)
        assert all(got[k].n_signatures == len(x) for k, x in enumerate(sets))


def test_spotsigs_join_of_one_large_group(spark):
    """A group far larger than a tile, each member another text."""
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(["the", *base[:k % 60], f"x{k}", *base[k % 60 :]]) for k in range(400)] + [" ".join(f"y{k} z{j}" for j in range(20)) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [plain_spots(x, set()) for x in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(df, 0.8, []).collect()}
    assert [got[k] for k in range(len(texts))] == components(len(texts), near)


def test_spot_signatures_are_chains():
    anchors = ["the", "of", "and"]
    sigs = lambda x: spotsigs.signatures([x], anchors) & np.uint64(0xFFFFFFFF)
    one = sigs("The quick brown of fox, and the lazy dog")
    assert len(one) == 4  # the-quick-brown, of-fox-lazy, and-lazy-dog, the-lazy-dog
    assert set(sigs("the quick brown")) <= set(one)
    assert len(sigs("the end of")) == 2  # the-end, of: cut off by the end of the text
    assert len(set(sigs("no anchor here at all")) & set(sigs("no anchor here at last"))) == 2  # runs of three words


def test_block_vectors_read_all_words():
    start = "one two three four five six " * 5
    a, b = (html_text.vectors(html_text.blocks(f"<p>{start}{end}</p>")) for end in ("seven", "eight"))  # of equal length
    assert (a != b).any()
    words = (start + "seven").split()
    want = np.zeros(html_text.WORD_DIMS)
    for w in words:
        h = zlib.crc32(w.encode())
        want[h % html_text.WORD_DIMS] += 1 if h >> 31 else -1
    at = a.shape[1] - html_text.SIZES - html_text.WORD_DIMS
    assert np.allclose(a[0, at : at + html_text.WORD_DIMS], want / math.sqrt(len(words)))


#: Written by hand, in manners that compose() has not; the lines of the main text follow each page.
PAGES = [
    ("""<html><body class="home"><div id="top"><span>Weather Weekly</span><a href="/a">Subscribe</a><a href="/b">Login</a></div>
<div class="story"><h1>Storm reaches the coast</h1><p>By our reporter</p><p>The storm that had been expected since Monday reached the coast last night.
<p>Trains were <em>late</em> by up to three hours, and two bridges had to be closed.<br>Nobody was hurt.
<ul><li>Stay at home if you can.<li>Close all windows.</ul></div>
<div class="related"><h4>Related articles</h4><ul><li><a href="/1">Rain in March</a><li><a href="/2">How storms form</a></ul></div>
<div id="footer">Copyright 2020 Weather Weekly. <a href="/i">Imprint</a></div></body></html>""",
     ["Storm reaches the coast", "By our reporter", "The storm that had been expected since Monday reached the coast last night.", "Trains were late by up to three hours, and two bridges had to be closed. Nobody was hurt.", "Stay at home if you can.", "Close all windows."]),
    ("""<!doctype html><title>Bread</title><header><a href="/">Kitchen notes</a><nav><a href="/r">Recipes</a> <a href="/t">Tips</a> <a href="/s">Search</a></nav></header>
<main><article><h2>A simple bread</h2><p>Mix flour, water, salt and yeast in a large bowl and let the dough rest for an hour.</p><blockquote>Time does most of the work.</blockquote>
<p>Bake it at 230 degrees for forty minutes &amp; let it cool.</p></article>
<section class="comments"><h3>2 comments</h3><div class="comment"><b>Anna</b><p>I tried this and it worked well, thank you!</p></div><div class="comment"><b>Tom</b><p>Mine did not rise at all.</p></div></section></main>
<aside><h3>Popular posts</h3><ul><li><a href="/x">Tomato soup</a></li><li><a href="/y">Apple cake</a></li></ul></aside><footer><p>All rights reserved.</p></footer>""",
     ["A simple bread", "Mix flour, water, salt and yeast in a large bowl and let the dough rest for an hour.", "Time does most of the work.", "Bake it at 230 degrees for forty minutes & let it cool."]),
    ("""<body><div class='cookie-consent'>We use cookies to make this site better. <button>Accept</button></div><div class=nav><ul><li><a href=/>Home</a></li><li><a href=/d>Docs</a></li><li><a href=/f>Forum</a></li></ul></div>
<div class=content><h1>Installing the program</h1><p>Download the archive for your system and unpack it into a folder of your choice.</p><pre>tar xf program.tar</pre><p>Then start it once, so that it can write its settings.</p>
<div class="advert">Sponsored: cheap servers from one coin a month</div><p>If the start fails, read the log beside the program.</p></div>
<form class="search" action="/q"><label>Search the docs</label><input name=q></form></body>""",
     ["Installing the program", "Download the archive for your system and unpack it into a folder of your choice.", "tar xf program.tar", "Then start it once, so that it can write its settings.", "If the start fails, read the log beside the program."]),
    ("""<html><body><table><tr><td><a href="1">News</a></td><td><a href="2">Sport</a></td><td><a href="3">Culture</a></td></tr></table>
<div id="article-text"><h1>Der Fluss steigt</h1><p>In der Nacht ist der Fluss um einen halben Meter gestiegen, sagte die Stadt am Morgen.</p><p>Die Schulen bleiben geschlossen. Am Mittag soll es trocken werden.</p></div>
<div class="side"><p>Meistgelesen</p><p><a href="4">Ein Dorf ohne Strom</a></p></div><div class="copyright">Impressum &middot; Datenschutz</div></body></html>""",
     ["Der Fluss steigt", "In der Nacht ist der Fluss um einen halben Meter gestiegen, sagte die Stadt am Morgen.", "Die Schulen bleiben geschlossen. Am Mittag soll es trocken werden."]),
    ("""<div class=wrapper><div class=masthead><h2>The Reader</h2><p>Letters and essays since 1990</p></div><div class=post><h1>On walking</h1><p>I have walked to work for eleven years. It takes fifty minutes, and I would not miss one of them.
<p>A walk has a beginning, a middle and an end, like a story; <a href="/essay">an essay</a> has them too.
<p>Some days I count the trees.</div><div class=sharing><a href=#>Share this page</a> <a href=#>Print</a></div><ol class=discussion><li><p>Lovely. I do the same on Sundays.</p></li><li><p>Eleven years is long!</p></li></ol></div>""",
     ["On walking", "I have walked to work for eleven years. It takes fifty minutes, and I would not miss one of them.", "A walk has a beginning, a middle and an end, like a story; an essay has them too.", "Some days I count the trees."]),
    ("""<body><nav role=navigation><a href=/>Accueil</a> | <a href=/a>Actualités</a> | <a href=/c>Contact</a></nav><section class="notice"><p>Notre site change. Lisez les nouvelles règles.</p></section>
<article><h1>Le musée rouvre</h1><p>Après deux ans de travaux, le musée de la ville rouvre ses portes samedi.</p><p>L'entrée sera libre pendant tout le mois, dit la maire.</p><figure><img src=m.jpg><figcaption>La grande salle</figcaption></figure></article><footer>Mentions légales</footer></body>""",
     ["Le musée rouvre", "Après deux ans de travaux, le musée de la ville rouvre ses portes samedi.", "L'entrée sera libre pendant tout le mois, dit la maire.", "La grande salle"]),
]


@pytest.fixture(scope="module")
def labeller(spark):
    """As the query trains it."""
    return html_text.train([r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()][: html_text.SAMPLE_PAGES])


def test_pages_written_by_hand(labeller):
    wrong = n = 0
    for page, want in PAGES:
        seq = html_text.blocks(page)
        assert set(want) <= {b.text for b in seq}
        y = labeller.predict([html_text.vectors(seq)])[0] > 0.5
        wrong += sum(bool(p) != (b.text in want) for p, b in zip(y, seq, strict=True))
        n += len(seq)
    print("blocks labelled wrongly:", wrong, "of", n)
    assert wrong <= 0.1 * n


def test_pages_on_unseen_layouts(spark, labeller):
    lines = [b.text for r in spark.read.parquet(f"{SF}/pages.parquet").collect() for b in html_text.blocks(r.html)]
    rng, wrong, n = random.Random(77), 0, 0
    for _ in range(150):
        seq = html_text.blocks(html_text.compose(rng, lines))
        y = [b.text.startswith(html_text.MARK) for b in seq]
        for b in seq:
            b.text = b.text.lstrip(html_text.MARK).strip() or "x"
        wrong += sum((p > 0.5) != t for p, t in zip(labeller.predict([html_text.vectors(seq)])[0].tolist(), y, strict=True))
        n += len(y)
    print("blocks labelled wrongly:", wrong, "of", n)
    assert wrong <= 0.06 * n
    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet"), labeller).collect():
        assert r.text and not re.search("</?[a-z]", r.text)


def test_articles_of_the_pages(spark, labeller):
    """The tables' pages put their main text into one article element, whatever stands around it."""
    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet"), labeller).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        assert r.text == "\n".join(b.text for b in html_text.blocks(f"<article>{inside}</article>"))


def test_markup_is_read_in_linear_time():
    import time

    def took(n):
        start = time.process_time()
        seq = html_text.blocks("<div class=content>x" * n + "</span></b>" * n + "<a \"x" * n)
        html_text.vectors(seq)
        return time.process_time() - start

    took(100)
    assert took(40_000) < 40 * max(took(4_000), 0.01)


@pytest.mark.parametrize("page, want", [
    ('<p>a<a href="foo>b</a> c</p>', ["ab c"]),
    ("<p>a <a href='x>y' title=\"it's\">b</a> c</p>", ["a b c"]),
    ('<div a="x>y">t</div>', ["t"]),
    ("<p>one<style a=\"b>q</style> two", ["one two"]),
    ("<p>1 < 2 &lt;b&gt;", ["1 < 2 <b>"]),
])
def test_quotes_that_do_not_close(page, want):
    assert [b.text for b in html_text.blocks(page)] == want


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    m = html_text.Labeller(seed=4, dims=5, hidden=3)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, y = rng.standard_normal((4, 2, 5)), rng.integers(0, 2, (4, 2)).astype(float)
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)

    def loss():
        s = np.concatenate([m._run(x, mask, d, False)[0] for d in "fb"], axis=2) @ m.w["o"] + m.w["k"]
        return float((np.logaddexp(0, s) - y * s)[mask].sum() / mask.sum())

    for k, g in m._grads(x, mask, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = m.w[k][at]
        m.w[k][at] = keep + 1e-3
        up = loss()
        m.w[k][at] = keep - 1e-3
        down = loss()
        m.w[k][at] = keep
        assert math.isclose((up - down) / 2e-3, g[at], rel_tol=0.05, abs_tol=1e-3)


def test_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, SF).collect()
    learned_from = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    learned = langid.profiles(learned_from)
    least = langid.least_score(learned_from, learned)
    found = langid.identify(docs, learned).where(f"lang_pred <> 'und' and score >= {least}").select(*docs.columns)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0")
    chosen = resampling.resample(found, labels, keep_text=True).where("selected").select("doc_id", "text").collect()
    texts = plain_lines([(r.doc_id, r.text) for r in chosen], 50)
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[d]) for d in ids]
    label = components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    kept = {ids[k] for k in label}
    assert {r.doc_id for r in out} == kept and 0 < len(kept) < docs.count()
    enc = packing.Encoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    for d in kept:
        assert sum(r.length for r in out if r.doc_id == d) == len(enc.encode([texts[d]])[0]) // 4 + 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "lines", "near_copies", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


EDGES = [
    (1, "The cat sat on the mat and the dog ran home.", "en", 777.0, True, 1, "a"),
    (1, "The cat sat on the mat and the dog ran home.", "en", 777.0, True, 1, "a"),
    (2, None, None, None, None, None, None),
    (3, "", "en", 777.0, False, 3, ""),
    (None, "the dog ran home on the old road and the cat sat still", None, 1.0, None, 4, "c"),
    (5, "the house of the old man is near a river and it flows " * 3000, "en", 2.0, True, 5, "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, a repeated row, and columns named as operators name their own."""
    return spark.createDataFrame(EDGES, "doc_id long, text string, lang string, score double, selected boolean, _t int, removed string")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edges(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows, none = stage(spark, odd, SF).collect(), stage(spark, odd.limit(0), SF)
    assert none.count() == 0
    ids = sorted((r.doc_id or 0) for r in rows)
    if name == "packing":
        assert set(ids) == {0, 1, 2, 3, 5}
        return
    assert none.columns == odd.columns
    own = {(r[0], r[1]): r[3:] for r in map(tuple, EDGES)}
    assert all(tuple(r)[3:] == own[r.doc_id, r.text] for r in rows)
    assert ids == {"language": [0, 1, 1, 5], "quality": [0, 1, 1, 5], "lines": [0, 1, 1, 2, 3, 5], "near_copies": [0, 1, 2, 5]}[name]


def test_language_stage_drops_what_no_profile_explains(spark, docs):
    rng = random.Random(4)
    noise = [(10_000_000 + k, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 12))) for _ in range(200)), None) for k in range(30)]
    junk = spark.createDataFrame(noise, "doc_id long, text string, lang string")
    some = docs.select("doc_id", "text", "lang")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, some.unionByName(junk), SF).select("doc_id").collect()}
    assert not any(d in kept for d, *_ in noise)
    assert {r.doc_id for r in some.where("lang is not null and length(text) > 0").collect()} <= kept
