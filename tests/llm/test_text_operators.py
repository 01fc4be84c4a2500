"""Each operator against a brute-force version or hand-made cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.llm import exact_dedup, html_text, kdtree_topk, mixing, pii, quality, sentencepiece_bpe, simhash, suffix_dedup, toxicity
from copse.llm.common import held_out
from copse.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, **more):
    rows = [(i, t, "en", more.get("source", f"s{k % 3}"), len(t or "")) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeiourstnl") for _ in range(r.randint(1, 9)))
    out = [None, "", " \t\n", "one", "one two", "x" * 5000] + [" ".join(word() for _ in range(r.randint(1, 400))) for _ in range(40)]
    base = out[10].split()
    for k in range(12):
        w = list(base)
        w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out + [out[7], out[7], out[12]]


def test_exact_dedup(spark, texts):
    d = docs(spark, texts, [*range(len(texts) - 1), None]).withColumn("keep_id", F.lit("clash"))
    got = exact_dedup.exact_dedup(d).collect()
    groups = defaultdict(list)
    for i, t in zip([*range(len(texts) - 1), None], texts, strict=True):
        groups[t or ""].append(i)
    for row in got:
        g = groups[row.text or ""]
        keep = max((i for i in g if i is not None), default=None)
        assert (row.keep_id, row.group_size, row.kept) == (keep, len(g), row.doc_id == keep)
    assert len(got) == len(texts)
    kept = exact_dedup.without_copies(d.unionAll(d))
    assert kept.columns == d.columns and sorted(r.text or "" for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(d.limit(0)).count() == 0


def fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def least_reachable(values, ids):
    root = {i: i for i in range(len(values))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = defaultdict(list)
    for i, x in enumerate(ids):
        out[find(i)].append(x)
    return {i: min(out[find(i)]) for i in range(len(values))}


def test_simhash(spark, texts):
    d = docs(spark, texts)
    fps = [fingerprint(t) for t in texts]
    want = least_reachable(fps, range(len(texts)))
    got = {r.id: r for r in simhash.near_duplicates(d).collect()}
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{fps[i]:016x}" and got[i].component_id == want[i]
    kept = simhash.without_near_copies(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert simhash.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [2048, 8, 2])
def test_simhash_dense_groups(spark, bucket):
    r = random.Random(bucket)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = set()
    for _ in range(12):
        b = r.getrandbits(64)
        for _ in range(40):
            v = b
            for _ in range(r.randint(0, 4)):
                v ^= 1 << r.choice([r.randrange(64), 50 + r.randrange(6)])
            values.add(v)
    values = sorted(values, key=signed)
    want = least_reachable(values, [signed(v) for v in values])
    found = {x.node: x.root for x in components(simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), 2, bucket)).collect()}
    assert all(found.get(signed(v), signed(v)) == want[i] for i, v in enumerate(values))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sound(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 12 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii(spark):
    r = random.Random(1)
    cases = [None, "", "a@b.cc@d.ee", "x a@b.c_d@e.f y", "1.2.3.4.5.6.7.8 300.1.1.1", "é😀 me@x.org 4111 1111 1111 1111 +1 (999) 555-1234", "1" * 3000, "a" * 9000 + "@", "1 " * 3000, "a@b" + ".c" * 3000, "me@x.y " * 500, 'token = "abcdef0123456789abcd" 4495589438270767 42']
    cases += ["".join(r.choice(["a", "@", ".", "1", "2", "9", "-", " ", "+", "(", "é", "\n", "4111111111111111"]) for _ in range(r.randint(0, 60))) for _ in range(400)]
    d = docs(spark, cases)
    got = {x.doc_id: x for x in pii.detect(d).select("doc_id", pii.as_text(F.col("base")).alias("base"), pii.as_text(F.col("spans")).alias("spans")).collect()}
    for i, t in enumerate(cases):
        want = sorted((m.start(), o, k, m.end()) for o, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if sound(k, m[0]))
        assert got[i].base == ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))
    assert "secret:" in got[11].spans
    assert pii.detect(d.limit(0)).count() == 0


def test_pii_reliabilities_and_classifier():
    r = random.Random(9)
    right = [0.95, 0.9, 0.85, 0.6, 0.7]  # how often each labeler tells the truth
    counts = Counter()
    truths = Counter()
    for _ in range(6000):
        truth = r.random() < 0.4
        votes = tuple((1 if truth else -1) * (1 if r.random() < p else -1) for p in right)
        counts[votes] += 1
        truths[votes] += truth
    model = pii.train([(4, v, 1, n) for v, n in sorted(counts.items())])
    for j, p in enumerate(right):
        assert model.reliability[j, 1, 2] == pytest.approx(p, abs=0.05) and model.reliability[j, 0, 0] == pytest.approx(p, abs=0.05)
    score = lambda v: model.kind[4] + model.bucket[1] + sum(model.vote[j][v[j] + 1] for j in range(5))
    hits = sum((truths[v] if score(v) >= 0 else n - truths[v]) for v, n in counts.items())
    assert hits / 6000 > 0.93
    assert pii.train([]).kind.tolist() == [0] * 5


def test_pii_words_of_four_languages(spark):
    secrets = ["passwort = abcdef0123456789", 'contraseña="x1y2z3w4v5"', "ASIA0123456789ABCDEF", "ghp_" + "a1" * 18]
    before = ["Tel", "Téléphone", "Rufnummer", "teléfono"]
    texts = [*secrets, *[f"{b}: +49 30 1234567" for b in before]]
    d = docs(spark, texts)
    found = {x.row.doc_id: x for x in pii.spans(d).collect()}
    assert all(found[i].candidates or found[i].base for i in range(len(texts)))
    assert all(found[i].base[0].votes[3] == 1 for i in range(4, 8))


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, None if i % 50 == 0 else " ".join(["w"] * r.choice([0, 1, 30, 400, 3000])), "en", None if i % 7 == 6 else f"s{i % 7}", 0) for i in range(300)]
    d = spark.createDataFrame([*rows, rows[3], rows[3]], DOCS)
    out = mixing.Mix(d).taken().collect()
    size, taken, target = Counter(), Counter(), {}
    source = {row[0]: row[3] for row in rows}
    for x in out:
        assert x.taken <= 2 * x.size
        size[source[x.id]] += x.size
        taken[source[x.id]] += x.taken
        target[source[x.id]] = x.target
    assert len(out) == 302 and sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s, t in target.items():
        assert t <= 2 * size[s] + 1e-6 and abs(taken[s] - t) <= max(128, 0.02 * t)
    m = mixing.Mix(d)
    again = mixing.Mix(d.repartition(7))
    key = lambda rows: sorted((x.id, x.size, x.taken) for x in rows)
    assert key(out) == key(m.taken().collect()) == key(again.taken().collect())
    made = Counter()
    for x in m.documents().collect():
        made[x.source] += len(x.text.split())
    assert made == +taken
    assert mixing.Mix(d.limit(0)).taken().count() == 0


def test_mixing_targets_and_permutation():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == pytest.approx({"a": 200, "b": 83.33333, None: 166.66667})
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    quota = np.array([5, 0, 77, 13])
    assert (mixing.shard_counts(quota, 6, 1).sum(0) == quota).all()


def repeated(texts, length):
    seen = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [50_000, 3])
def test_suffix_dedup(spark, group):
    r = random.Random(8)
    rnd = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    shared = [rnd(n) for n in (150, 199, 200, 230, 900)]
    cases = [None, "", "x" * 199, "x" * 200, "y" * 1200, "ab" * 600]
    cases += ["".join(rnd(r.randint(0, 300)) + (r.choice(shared) if r.random() < 0.6 else "") for _ in range(r.randint(1, 5))) for _ in range(50)]
    base = rnd(1500)
    for _ in range(10):
        at = r.randrange(1500)
        cases.append(base[:at] + "#" + base[at + 1 :])
    cases += [shared[4], "q" + shared[4], cases[20], cases[20]]
    found = suffix_dedup.Repeats(docs(spark, cases), group=group)
    got = {x.id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found.removed().collect()}
    assert [got[i] for i in range(len(cases))] == repeated(cases, 200)
    assert suffix_dedup.Repeats(docs(spark, cases).limit(0)).removed().count() == 0


def test_repeat_groups_have_all_occurrences(spark):
    passage = "the quick brown fox jumps over the lazy dog and goes on running " * 5
    found = suffix_dedup.Repeats(docs(spark, [f"{i} left {passage} right {i}" for i in range(4)])).groups()
    sizes = {r["count"] for r in found.groupBy("repeat", "length").count().collect()}
    assert max(sizes) >= 4 and found.agg(F.min("length")).first()[0] >= 200


def test_repeat_groups_are_maximal_and_whole(spark):
    """Against all places of each string: within the context kept, no occurrence is missing and none can be longer on either side."""
    r = random.Random(12)
    rnd = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = [rnd(n) for n in (210, 230, 260)]
    texts = ["".join(rnd(r.randint(0, 120)) + r.choice(shared) for _ in range(r.randint(1, 3))) for _ in range(12)]
    texts += [shared[0] + "x" + shared[0] + "y" + shared[0]]
    raw = sorted({t.encode() for t in texts})
    key = {(int.from_bytes(hashlib.sha256(t).digest()[:8], "big", signed=True)): t for t in raw}
    groups = defaultdict(set)
    for x in suffix_dedup.Repeats(docs(spark, texts)).groups().collect():
        groups[x.repeat, x.length].add((x.a, x.start))
    assert len(groups) > 3
    covered = defaultdict(set)
    for (name, n), places in groups.items():
        strings = {key[a][s : s + n] for a, s in places}
        assert len(strings) == 1 and len(places) > 1 and hashlib.sha256(min(strings)).hexdigest() == name
        (text,) = strings
        everywhere = {(a, i) for a, t in key.items() for i in range(len(t) - n + 1) if t[i : i + n] == text}
        assert places == everywhere
        for a, s in places:
            covered[a].update(range(s, s + n))
    for (_, removed, _, _), t in zip(repeated([t.decode() for t in raw], 200), raw, strict=True):
        a = int.from_bytes(hashlib.sha256(t).digest()[:8], "big", signed=True)
        assert len(covered[a]) == removed


@pytest.mark.parametrize("seed", range(6))
def test_extents_fold_the_maximal_groups(seed):
    r = random.Random(seed)
    strings = ["".join(r.choice("ab") for _ in range(12)) for _ in range(5)]
    rows = sorted((((r.choice(strings) + r.choice(strings))[: r.randint(4, 20)]).encode(), r.choice(strings)[: r.randint(0, 12)].encode()) for _ in range(40))
    right, left = [x for x, _ in rows], [y for _, y in rows]
    lcp = [suffix_dedup.common(x, y) for x, y in zip(right, right[1:], strict=False)]
    for length in (6, 12, 18):
        reach = np.zeros((2, 40), np.int64)
        for l, k, members in suffix_dedup.repeat_groups(right, left, lcp, length):  # noqa: E741
            reach[0, members], reach[1, members] = np.maximum(reach[0, members], l), np.maximum(reach[1, members], k)
        outer, inner = suffix_dedup.extents(lcp, left, length)
        assert (np.stack([outer, inner]) == reach).all()


def test_toxicity_and_quality():
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioustn") for _ in range(r.randint(2, 8)))
    clean = [" ".join(word() for _ in range(r.randint(5, 200))) for _ in range(300)]
    rude = [" ".join([*t.split(), "grobian", "lout"]) for t in clean[:150]]
    y = np.array([1] * 100 + [0] * 200)
    model = toxicity.fit(rude[:100] + clean[:200], y, np.ones(300))
    assert min(model.score(t) for t in rude[100:]) > max(model.score(t) for t in clean[200:])
    assert 0 <= model.score("") <= 1
    bad = ["\n".join(" ".join(word().upper() + "!!" for _ in range(20)) for _ in range(3)) for _ in range(100)]
    chain = quality.fit(clean[:100] + bad[:60], np.array([1] * 100 + [0] * 60), np.ones(160))
    assert min(chain.score(t) for t in clean[100:]) > 0.5 > max(chain.score(t) for t in bad[60:])
    for only in (0, 1):
        assert toxicity.fit(["a"], np.array([only]), np.ones(1)).score("b") == pytest.approx(only, abs=1e-3)
        assert quality.fit(["a"], np.array([only]), np.ones(1)).score("") == pytest.approx(only, abs=1e-3)


def test_long_texts_have_the_features_of_their_pieces(monkeypatch):
    text = " ".join(f"wörd{i % 97} no{i}" for i in range(3000))
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    for a, b in zip(whole, toxicity.features(text), strict=True):
        assert (a == b).all()


def test_chain_marginals_match_enumeration():
    r = np.random.default_rng(1)
    chain = quality.Chain(r.normal(size=quality.FEATURES), r.normal(size=(2, 2)))
    x = r.normal(size=(5, quality.FEATURES)) / 3
    u, total, good = x @ chain.unary, 0.0, np.zeros(5)
    for k in range(32):
        y = [k >> i & 1 for i in range(5)]
        p = np.exp(sum(u[i] * y[i] for i in range(5)) + sum(chain.trans[y[i], y[i + 1]] for i in range(4)))
        total += p
        good += p * np.array(y)
    assert chain.marginals(x) == pytest.approx(good / total)


def test_scores_keep_rows_and_columns(spark):
    d = docs(spark, [None, "", "a b", "a b", "x" * 30000]).withColumn("score", F.lit("clash"))
    model = toxicity.fit(["rude lout", "kind"] * 5, np.array([1, 0] * 5), np.ones(10))
    out = toxicity.score(d, model)
    assert out.count() == 5 and dict(out.dtypes)["score"] == "double"
    assert quality.score(d, quality.fit(["A!!", "kind words"] * 5, np.array([0, 1] * 5), np.ones(10))).count() == 5
    assert d.select(held_out(F.col("doc_id")).alias("h")).where("h").count() == sum(1 for i in range(5) if __import__("zlib").crc32(str(i).encode()) % 5 == 0)


def test_training_rows_are_not_held_out(spark):
    from zlib import crc32

    from copse.llm.fitting import labelled_sample

    d = docs(spark, [f"t{i}" for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(200)] + [(None, 1, 1), (7, None, None), (8, 1, 1)], "doc_id long, quality int, toxic int")
    rows = labelled_sample(d, labels, "quality", 30).collect()
    assert len(rows) == 60 and all(crc32(str(r.id).encode()) % 5 for r in rows) and 8 not in {r.id for r in rows}


@pytest.mark.parametrize(("dim", "tight"), [(3, False), (8, False), (24, True)])
def test_top_k(spark, dim, tight):
    r = np.random.default_rng(dim)
    rows = [(i, (r.normal(size=dim) / (1 + 9 * tight) + 5 * tight * np.eye(dim)[i // 40 % dim]).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(30)] + [(400, None), (401, [float("nan")] * dim), (402, [None] * dim), (None, rows[3][1]), (403, [1.0] * (dim + 1)), (420, [])]
    x = kdtree_topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    search = kdtree_topk.Search(x, x.where("id % 20 = 0"), 20, shard_rows=32, leaf=8, growth=2, sample=200)
    got = defaultdict(list)
    for t in search.result().collect():
        got[t.query_id].append((t.rank, t.vec_id, t.score))
    v = {i: np.floor(64 * np.array(e, np.float32).astype(float)).astype(int) for i, e in rows[:330]}
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:20]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert 420 not in got and kdtree_topk.top_k(x.limit(0), x.limit(0)).count() == 0
    assert kdtree_topk.top_k(x, x.limit(0)).count() == 0
    share = search.opened.value / (17 * search.leaves)
    assert 0 < share <= (0.5 if tight or dim == 3 else 1)


def test_top_k_repeated_ids_and_huge_components(spark):
    big = 3e38
    rows = [(0, [1.0, 2.0]), (0, [0.5, 9.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [big, big]), (3, [-big, 1.0]), (20, [big, 1.0])]
    x = kdtree_topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    for t in kdtree_topk.top_k(x, x.where("id % 20 = 0"), 20, leaf=1, shard_rows=2).orderBy("query_id", "rank").collect():
        got[t.query_id].append((t.vec_id, t.score))
    end = (1 << 63) - 1
    cap = lambda s: min(max(s, -end - 1), end)
    v = [(i, [cap(int(np.floor(64 * float(np.float32(c))))) for c in e]) for i, e in rows]
    for q, own in ((0, [32, 576]), (20, v[7][1])):  # the least vector of the id 0 asks
        assert got[q] == [(i, -s) for s, i in sorted((-cap(own[0] * e[0] + own[1] * e[1]), i) for i, e in v if i != q)]


def test_sentencepiece(spark):
    import public_tokenizers

    path = public_tokenizers.path(sentencepiece_bpe.MODEL)
    agenda = sentencepiece_bpe.Agenda(path, memo=50)
    r = random.Random(1)
    cases = ["", " ", "  a", "a▁b", "\x00a", "é�", "ﬁ ｗ", "a ", "😀", "\n\n  \n x", "<s> hi </s><0x41>", "a" * 3000, "don't (stop)!! e.g. ***"]
    cases += ["".join(r.choice("ab é\n▁😀\t 日本the.,*(") for _ in range(r.randint(0, 60))) for _ in range(600)]
    for t in cases:
        want = agenda.library.encode(t)
        assert agenda.encode(t) == want and agenda.decode(want) == agenda.decoded(agenda.parts(t)[0]) == agenda.library.decode(want)
        agenda.check()
    out = sentencepiece_bpe.encode_decode(docs(spark, [None, *cases]), path, ("ids", "n_tokens", "decoded", "ids_sha256"), keep=("doc_id",)).collect()
    for x in out:
        want = agenda.library.encode(([None, *cases])[x.doc_id] or "")
        assert (list(x.ids), x.n_tokens, x.decoded, x.ids_sha256) == (want, len(want), agenda.library.decode(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())


PAGES = [
    (None, ""),
    ("", ""),
    ("<nav><ul><li><a>x</a></ul><article><header>By me</header><h1>A &amp; B</h1><p>One<p>Two <b>bo</b>ld<br>x<section class='comments'><p>nope</p></section></article><footer>f</footer>", "A & B One Two bold x"),
    ("<body class='has-sidebar'><div id='menu'><a>Home</a></div><div class='content'><h1>T</h1><div class='text'><p>Long text that goes on and on for a while.</p><p>Yes.</p></div><div class='share'>tweet</div></div><div id='comments'><p>A long and winded comment that nobody asked for at all</p></div></body>", "T Long text that goes on and on for a while. Yes."),
    ("<article><p>a\n\t b&nbsp;c</p><script>var x='</p>';</script><aside>no</aside><form><p>mail</p></form><div class='ad'>buy</div><p>d</article>", "a b c d"),
    ("<nav><ul><li><a href=x>menu</a></li></ul><article><h1>Open</h1><p>Body text", "Open Body text"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_html_text(html, text):
    assert html_text.main_text(html) == text


def test_html_table(spark):
    d = spark.createDataFrame([(i, "u", h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(d).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html_text.extract(d.limit(0)).count() == 0
