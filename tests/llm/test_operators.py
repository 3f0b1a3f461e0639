"""Operators against brute force, exact round trips and held-out accuracy, with nulls, empties, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import ann, bpe, chat, components, html, mixing, neardup, quality, textcore, tokenfile, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   \t\n", "one", "a b c d", "é́ ﬁ 你好 ½", "x" * 3000, "word " * 4000, "Hello <|endoftext|> İstanbul ΣΑΣ it's IT'S\x1c\x85 a\x00b", "aaaa aaaaaaa", "same text of some words here", "same text of some words here"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket long, score double, size long, key string, x double"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", 0, 1, 0.5, 9, "k", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    real = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    return frame(spark, real + ODD)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def empty(docs):
    return docs.where("doc_id < -1")


# --- tokens -------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_equals_library(docs, texts, library):
    out = {r.doc_id: r for r in bpe.encoded(docs, keep_ids=True).collect()}
    assert len(out) == len(texts)
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert out[i].decoded == text and out[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_empty_and_repeats(docs):
    assert bpe.encoded(empty(docs)).count() == 0
    assert bpe.encoded(docs.unionByName(docs)).count() == 2 * docs.count()


def test_bpe_overlapping_pairs():
    code = bpe.loaded(bpe.vocabulary_path())
    words = [b"a" * n for n in range(1, 40)] + [b"ab" * n for n in range(1, 20)]
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(bpe.vocabulary_path())
    for w, raw in zip(words, code.words(words), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tool.encode(w.decode(), add_special_tokens=False).ids


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(1000))])
def test_variable_length_round_trip(values):
    v = np.array(values, np.uint32)
    assert tokenfile.unpack(len(v), *tokenfile.pack(v)).tolist() == values


def test_token_files(docs, texts, library):
    blocks, ranks = tokenfile.write_files(docs)
    out = {r.doc_id: r for r in tokenfile.read_files(blocks, ranks).collect()}
    start, counts = 0, Counter()
    for i in sorted(texts):
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        counts.update(ids)
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.id for r in ranks.orderBy("rank").collect()] == [i for i, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]


def test_token_files_empty_null_ids_and_repeats(spark, docs):
    assert tokenfile.read_files(*tokenfile.write_files(empty(docs))).count() == 0
    rows = spark.createDataFrame([(None, "b b"), (3, "x"), (3, "x"), (None, "a")], "doc_id long, text string")
    out = tokenfile.read_files(*tokenfile.write_files(rows)).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, None, 3, 3] and [r.start for r in out][0] == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False))


# --- near-duplicates ------------------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())


def brute_components(texts):
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for i, s in sets.items():
        both = Counter()
        for x in s:
            if len(index[x]) > 1:
                both.update(index[x])
        for j, k in both.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}, sets


def varied(spark, n=330, copies=40):
    r = random.Random(5)
    base = [f"w{r.randint(0, 999)}" for _ in range(140)]
    out = []
    for k in range(n):  # a large group whose members are often just below the threshold
        words = base[:]
        for _ in range(r.randint(0, 7)):
            words[r.randrange(140)] = f"n{r.randint(0, 9999)}"
        out.append(" ".join(words))
    out += [" ".join(base)] * copies + [" ".join(f"z{r.randint(0, 9)}" for _ in range(r.randint(1, 8))) for _ in range(60)]
    r.shuffle(out)
    return frame(spark, out)


def test_near_duplicates(docs, texts):
    expected, sets = brute_components(texts)
    for r in neardup.grouped(docs).collect():
        assert (r.component_id, r.n_shingles, r.kept) == (expected[r.doc_id], len(sets[r.doc_id]), expected[r.doc_id] == r.doc_id)


def test_large_group_goes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 32)
    df = varied(spark)
    expected, _ = brute_components({r.doc_id: r.text for r in df.collect()})
    assert {r.doc_id: r.component_id for r in neardup.grouped(df).collect()} == expected
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_near_duplicates_nulls_repeats_empty(spark, docs):
    assert neardup.grouped(empty(docs)).count() == 0
    t = "one two three four five six"
    rows = spark.createDataFrame([(None, t), (4, t), (4, t), (4, "other"), (None, None), (7, ""), (7, "")], "doc_id long, text string")
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in neardup.grouped(rows).collect() if r.n_shingles)
    assert out == [(-1, 2, 4, False), (4, 1, 4, True), (4, 2, 4, True), (4, 2, 4, True)]
    assert {(r.doc_id, r.component_id, r.kept) for r in neardup.grouped(rows).where("n_shingles = 0").collect()} == {(None, None, True), (7, 7, True)}


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 4000).astype(np.uint64)
    for share in (0, 500, 800):
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - share : 2000 - share])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = neardup.sketches([a, b, a[:3]])
        assert not (s == neardup.EMPTY).any() and abs((s[0] == s[1]).mean() - truth) < 0.15


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3)]
    out = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[200 + i] == 100 for i in range(50))


# --- quality and toxicity ---------------------------------------------------------------------------------------------------------------------


def test_quality_rules(docs, texts):
    for r in quality.rules(docs).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        seen, marked = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if seen[(w[i], w[i + 1], w[i + 2])] > 1:
                marked |= {i, i + 1, i + 2}
        lines, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in lines
                lines.add(x)
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(marked), failed)
        assert not (failed and r.kept)
    assert quality.rules(empty(docs)).count() == 0


def test_band_verdict_by_brute_force(spark):
    import zstandard

    r, press = random.Random(8), zstandard.ZstdCompressor(level=quality.LEVEL)
    word = lambda: "".join(r.choice("etaoinshrdlucmf") for _ in range(r.randint(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (60, 200, 340, 342, 500, 700, 900, 3000) for _ in range(4)]
    texts += [t + " again" * 200 for t in texts[::3]] + [t + bytes(r.randrange(33, 127) for _ in range(1500)).decode() for t in texts[::4]] + ["x" * 2049, "y" * 2048, None]
    size = lambda x: len(x) / len(press.compress(x))
    for row in quality.rules(frame(spark, texts)).collect():
        raw = (texts[row.doc_id] or "").encode()
        parts, at = [], 0
        while len(raw) > 2048 and at < len(raw):  # what is left over goes to the last chunk
            end = at + 2048 if len(raw) - at >= 4096 else len(raw)
            parts.append(raw[at:end])
            at = end
        band = lambda bands, n: next(b[1:] for b in bands if n <= b[0])
        good = not row.base_failed and all(band(b, len(x))[0] <= size(x) <= band(b, len(x))[1] for b, x in [(quality.BANDS, raw)] + [(quality.CHUNK_BANDS, p) for p in parts])
        assert row.kept == good, len(raw)


def test_discriminant_by_brute_force():
    r = np.random.default_rng(4)
    d = len(quality.FEATURES)
    x = {k: r.standard_normal((n, d)) @ r.standard_normal((d, d)) + k for k, n in ((0, 80), (1, 120))}
    model = quality.Discriminant({k: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for k, v in x.items()})
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / 200
    at, density = r.standard_normal((30, d)) * 3, {}
    for k, v in x.items():
        c = 0.9 * np.cov(v.T, bias=True) + 0.1 * pooled
        c = 0.98 * c + (0.02 * np.trace(c) / d + 1e-6) * np.eye(d)
        gap = at - v.mean(0)
        density[k] = np.log(len(v) / 200) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap)
    assert np.allclose(model.evidence(at), np.arcsinh(density[1] - density[0]), rtol=1e-6)


def test_ftrl_by_brute_force():
    r, model = random.Random(9), toxicity.Ftrl()
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for _ in range(400):
        y = float(r.random() < 0.4)
        at = sorted(r.sample(range(12), 4) + ([20] if y else []))
        w = [weight(i) for i in at]
        g = 1 / (1 + np.exp(-sum(w))) - y
        for i, x in zip(at, w, strict=True):
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
            z[i] += g - sigma * x
            n[i] += g * g
        model.learn(np.array(at), y)
    assert np.allclose(model.weights(np.arange(21)), [weight(i) for i in range(21)]) and model.weights(np.array([20]))[0] > 0


def test_bands_reject_repetition_and_noise():
    import zstandard

    press, r = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(3)
    prose = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(2000)).encode()
    noise = bytes(r.randrange(33, 127) for _ in range(8000))
    for text, kept in ((prose, True), (b"the same line again\n" * 500, False), (noise, False)):
        assert quality.in_bands(len(text), *quality.ratios(text, press)) is kept


def accuracy(out, labels, name):
    rows = out.join(labels, "doc_id").where("held_out").select("predicted", name, "score").collect()
    return np.mean([r.predicted == r[name] for r in rows])


def test_quality_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.classified(docs, labels)
    assert accuracy(out, labels, "quality") > 0.93 and out.where("score < 0 or score > 1 or score is null").count() == 0
    kept = quality.accepted(docs.withColumn("x", F.lit(1)).withColumn("score", F.lit(0.1)), labels)
    assert kept.columns == [*docs.columns, "x", "score"] and kept.count() == out.where("predicted = 1").count()


def test_classifiers_on_odd_input(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (3, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for made in (quality.classified, toxicity.classified):
        assert made(docs, labels).where("score is null or score < 0 or score > 1").count() == 0
        assert made(docs, labels).count() == docs.count()
        assert made(docs, labels.where("doc_id = -1")).count() == docs.count()
        assert made(empty(docs), labels).count() == 0


def test_held_out_folds(docs):
    rows = docs.select("doc_id", quality.held_out().alias("q"), toxicity.held_out().alias("t")).collect()
    assert all(r.q == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.t == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxicity_learns_words(spark):
    r = random.Random(2)
    words = ["".join(r.choice("aeioulnrst") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(1500):
        w = [r.choice(words) for _ in range(r.randint(20, 200))]
        bad = i % 7 == 0
        if bad:
            for x in r.sample(["vile", "foul", "rotten"], 2):
                w.insert(r.randrange(len(w)), x)
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int")
    out = toxicity.classified(docs, labels)
    assert accuracy(out, labels, "toxic") > 0.97
    at, w = toxicity.fitted(docs, labels)
    assert len(at) < 3000  # L1 leaves few weights


# --- mixing -------------------------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mixing(spark, docs, texts):
    sources = [None if i % 11 == 0 else ("hot" if i % 3 else f"s{i % 5}") for i in range(len(texts))]
    df = frame(spark, [texts[i] for i in range(len(texts))], sources)
    out = mixing.mixed(df).collect()
    sizes = Counter()
    for i, t in texts.items():
        sizes[sources[i]] += len(WORD.findall(t or ""))
    target, taken, most = brute_targets(sizes), Counter(), Counter()
    assert len(out) == len(texts)
    for r in out:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= max(most.values()) + most[s] for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values()) + 1e-6
    # Brute force of the queue: copies in order of virtual finish time while the budget lasts.
    md5 = lambda r: hashlib.md5(f"mix-0{r.doc_id}/{hashlib.md5((texts[r.doc_id] or '').encode()).hexdigest()}/0".encode()).hexdigest()
    copies, cum = [], Counter()
    for r in sorted(out, key=md5):
        cum[r.source] += r.size
        if r.size:
            copies += [((cum[r.source] + e * r.source_size) / r.target, md5(r), r.source or "", r.doc_id, r.size) for e in range(2)]
    total, expected = 0, Counter()
    for _, _, _, i, n in sorted(copies):
        total += n
        if total > sum(target.values()) * (1 + 1e-12):
            break
        expected[i] += 1
    assert {r.doc_id: r.copies for r in out if r.copies} == dict(expected)
    again = {r.doc_id: r.copies for r in mixing.mixed(df.repartition(5)).collect()}
    assert again == {r.doc_id: r.copies for r in out}
    mix = mixing.taken(df)
    assert mix.columns == df.columns and Counter(r.doc_id for r in mix.collect()) == Counter({r.doc_id: r.copies for r in out if r.copies})


def test_mixing_empty_and_wordless(spark, docs):
    assert mixing.mixed(empty(docs)).count() == 0
    assert all(r.taken == 0 for r in mixing.mixed(frame(spark, [None, "", " "])).collect())
    assert {r.doc_id: r.copies for r in mixing.mixed(frame(spark, ["a b"] * 4, ["x"] * 4)).collect()}.keys() == {0, 1, 2, 3}


def test_mix_of_rows_without_id_and_repeats(spark):
    rows = [(None, f"t{i} a b", "x") for i in range(3000)] + [(7, "one two three", "y")] * 2000 + [(i, "w " * 5, "z") for i in range(100)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, c0 int")
    out = mixing.mixed(df).collect()
    sizes, got = {"x": 9000, "y": 6000, "z": 500}, Counter()
    for r in out:
        got[r.source] += r.taken
    target = brute_targets(sizes)
    assert len(out) == len(rows) and all(abs(got[s] - target[s]) <= 10 for s in sizes)
    mix = mixing.taken(df)
    assert mix.columns == df.columns
    words = Counter()
    for r in mix.collect():
        words[r.source] += len(r.text.split())
    assert words == got
    each = Counter(r.c0 for r in mix.collect())
    assert max(each.values()) <= 2


# --- chat -----------------------------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["plain", None, "", "\\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y</turn>\n", "\\b\\h\\l\\\\", "ünï ✓ 😀 <#:\\>", "a\nb"]
    rows = [(c, k, ("user", "assistant", "system", None, "a: b#<\\")[(c + k) % 5], texts[(c * 3 + k) % len(texts)]) for c in range(6) for k in range(1 + 3 * c)] + [(None, 0, "assistant", "lone"), (None, 0, "assistant", "lone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.tree: r for r in chat.read_back(chat.conversations(chat.threads(df))).collect()}
    want = defaultdict(list)
    for c, k, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want[c].append((role or "", text or ""))
    assert out.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in out[c].turns] == turns
        assert out[c].under_mask == [t for role, t in turns if role == "assistant"]
        assert out[c].formatted.count("### ") == len(turns) == out[c].formatted.count("</turn>\n")


def test_chat_branches(spark):
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 3, 1.0), ("t", 5, 4, 9.0), ("t", 6, 2, 2.0), ("u", 1, 99, None), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0), ("c", 3, 1, 1.0)]
    rows += [("long", i, i - 1 if i > 1 else None, 1.0) for i in range(1, 71)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, score double")
    paths = lambda best: {k: [i for _, i in sorted(v)] for k, v in _paths(chat.branches(df, best)).items()}
    assert paths(1) == {("t", 5): [1, 3, 4, 5], ("u", 1): [1], ("long", 70): list(range(1, 71))}
    assert paths(None)[("t", 6)] == [1, 2, 6]
    assert chat.branches(df.where("id < 0")).count() == 0


def _paths(df):
    out = defaultdict(list)
    for r in df.collect():
        out[(r.tree, r.leaf)].append((r.place, r.id))
    return out


# --- vectors --------------------------------------------------------------------------------------------------------------------------------------


def brute_nearest(rows, k=5):
    good = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good.items():
        if i % 50 == 0:
            each = [(-(v @ w) / (np.sqrt(v @ v) * np.sqrt(w @ w)), j) for j, w in good.items() if j != i]
            out[i] = [j for _, j in sorted(each)[:k]]
    return out


def test_nearest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    truth = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()])
    found = defaultdict(list)
    for r in ann.searched(df, data_block=200, query_block=4).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert found.keys() == truth.keys() and all(len(v) == 5 for v in found.values())
    assert np.mean([len(set(found[q]) & set(truth[q])) / 5 for q in truth]) >= 0.9


def test_nearest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, score string")
    out = ann.searched(df).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 8)] and [r.score for r in out] == [1.0, 1.0, 0.0]
    assert ann.searched(df.where("vec_id = -1")).count() == 0 and ann.searched(df.where("vec_id = 1")).count() == 0


# --- pages ----------------------------------------------------------------------------------------------------------------------------------------


def test_pages(spark):
    from html import unescape

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bad = 0
    rows = df.join(html.extracted(df), ["page_id", "url"]).collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        bad += " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split()) != r.text
        assert r.n_chars == len(r.text)
    assert bad <= 0.01 * len(rows)


def test_pages_held_out_layouts():
    made, scores = html.Layouts(12345), []
    for _ in range(80):
        h = made.page()
        p = html._Marked(h)
        a, b = Counter(html.text_of(p, p.main).split()), Counter(html.extract([h], html.trained())[0].split())
        scores.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
    assert np.mean(scores) > 0.95


def test_pages_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no tags at all"), (4, "u", "<p>a<b>b</p><p>c&amp;lt; &nbsp; d</p><script>x</script><!-- y -->"), (5, "u", "</p></div><table><tr><td>x"), (None, "u", "<div>" * 2000 + "deep")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html.extracted(df).collect()}
    assert len(out) == 6 and out[1].text == "" and out[2].text == "" and out[1].n_chars == 0
    assert "x" not in out[4].text.split() and "y" not in out[4].text
    assert html.extracted(df.where("page_id = 99")).count() == 0


def test_labelling_is_consistent():
    for h in [html.Layouts(s).page() for s in range(30)]:
        p = html._Text(h)
        keep = html.decoded(p, html.trained().margin(html.features(p)))
        assert all(keep[p.parent[v]] or not keep[v] for v in range(1, len(keep)))


# --- words ----------------------------------------------------------------------------------------------------------------------------------------


def test_windows_stay_inside_documents():
    h = textcore.WordHashes()
    flat, bounds = h.flat([[b"a", b"b"], [], [b"a", b"b", b"c"], [b"b", b"c"]])
    value, at = textcore.windows(flat, bounds, 2)
    assert at.tolist() == [0, 1, 1, 3, 4] and value[0] == value[1] and value[2] == value[3] and value[0] != value[2]
