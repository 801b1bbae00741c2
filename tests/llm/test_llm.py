"""The text and vector operators against brute force and the libraries, with awkward inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from optlattice.llm import bpe, components, embeddings, fingerprints, langid, lm, minhash, packing, queries, token_counts, toxicity, url_filter
from optlattice.llm._shared import remainder

path = public_tokenizers.path
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, piece string, score string"
ODD = [None, "", " ", "a", "Idiot one two", "x" * 3000, "ﬁ ½ é 中文 🎉 <|endoftext|> \x00\x1c", "\n\n  tab\tend \r\n", "the cat sat on the mat " * 400, "<|startoftext|>Σ İ <s> ▁▁ 12345 don't"]


def docs(spark, texts, start=0, lang="en"):
    return spark.createDataFrame([(i + start, t, lang, "s", 0, 9, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    texts = ODD + ODD[:5]
    rows = docs(spark, texts).unionByName(docs(spark, [None], 99, None).withColumn("doc_id", F.lit(None).cast("long")))
    return rows.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fuzz(n=400):
    rng = random.Random(3)
    letters = list(" \n\t\r\x0b\x1c\x85\xa0▁ab'sét1²½!?.中é🎉Σ<|>") + ["<|endoftext|>", "the ", "  ", "'ll", "ing"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_bpe_is_the_library_s(spark, odd, empty):
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    own = bpe.load(path("byte_bpe_50k.json"))
    texts = fuzz() + [x or "" for x in ODD]
    ids, counts = own.encode(texts)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert own.decode(ids, counts) == [t.decode(w, skip_special_tokens=False) for w in want]
    assert own.decode(np.array([70000, -1, 0]), np.array([3])) == [t.decode([0])]
    got = {r.doc_id: r for r in bpe.digests(odd, path("byte_bpe_50k.json")).collect()}
    for i, x in enumerate(ODD):
        e = t.encode(x or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
    tokens = bpe.encode(odd, path("byte_bpe_50k.json"))
    assert {r.doc_id: r.text for r in bpe.decode(tokens, path("byte_bpe_50k.json")).collect()}[6] == ODD[6]
    assert bpe.digests(empty, path("byte_bpe_50k.json")).count() == 0


def test_token_counts_are_the_library_s(spark, odd, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    own = token_counts.load(path("piece_bpe_32k.model"))
    texts = fuzz() + [x or "" for x in ODD] + ["▁" * 37, " " * 101 + "x"]
    assert own.count(texts).tolist() == [len(x) for x in model.encode(texts, num_threads=1)]
    got = {r.doc_id: r for r in token_counts.token_counts(odd, path("piece_bpe_32k.model"), limit=100).collect()}
    assert (got[0].n_bytes, got[0].n_tokens, got[0].over_limit) == (0, 0, False) and got[8].over_limit
    assert got[6].n_bytes == len(ODD[6].encode()) and token_counts.token_counts(empty, path("piece_bpe_32k.model")).count() == 0


def long_words():
    rng = random.Random(6)
    syllables = ["".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    sizes = [257, 300, 999, 5000]
    mixed = ["".join(rng.choice(syllables) for _ in range(n)) for n in sizes] + ["".join(rng.choice("ab") for _ in range(n)) for n in sizes]
    return [*mixed, "a" * 4001, "ab" * 3000, "the" * 2000, "é中" * 900, "word " + mixed[2] + " and\n" + mixed[1], "x" * 256, "=-" * 1500, "▁" * 700]


def test_long_words_are_the_libraries(spark):
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids, counts = bpe.load(path("byte_bpe_50k.json")).encode(long_words())
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in t.encode_batch(long_words(), add_special_tokens=False)]
    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    assert token_counts.load(path("piece_bpe_32k.model")).count(long_words()).tolist() == [len(x) for x in model.encode(long_words(), num_threads=1)]


@pytest.mark.parametrize("seed", range(4))
def test_merges_of_long_and_short_words_agree(seed, monkeypatch):
    from optlattice.llm import _merge

    rng = np.random.default_rng(seed)
    pairs = list({(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2))})
    table = _merge.PairTable([a for a, _ in pairs], [b for _, b in pairs], rng.permutation(len(pairs)), [4 + i % 8 for i in range(len(pairs))] if seed < 2 else [12 + i for i in range(len(pairs))])
    counts = rng.integers(0, 60, 80)
    symbols = rng.integers(-1, 5, int(counts.sum()))
    monkeypatch.setattr(_merge, "LONG", 10**9)
    want = _merge.merge(symbols, counts, table)
    got = _merge.merge_long(symbols, counts, table)
    monkeypatch.setattr(_merge, "LONG", 30)
    both = _merge.merge(symbols, counts, table)
    for x in (got, both):
        assert x[0].tolist() == want[0].tolist() and x[1].tolist() == want[1].tolist()


def test_a_megabyte_without_spaces_takes_seconds():
    import time

    rng = random.Random(7)
    text = "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(1_000_000))
    began = time.perf_counter()
    ids, counts = bpe.load(path("byte_bpe_50k.json")).encode([text])
    n = token_counts.load(path("piece_bpe_32k.model")).count([text])
    assert time.perf_counter() - began < 60
    assert ids.tolist() == Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert n.tolist() == [len(sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model")).encode(text))]


def test_word_tokens_and_packing(spark, odd, empty):
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = fuzz() + [x or "" for x in ODD]
    ids, counts = packing.load(path("word_bpe_49k.json")).encode(texts)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    rows = packing.packed(odd.where("doc_id is not null"), path("word_bpe_49k.json"), capacity=256).collect()
    tokens = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(ODD + ODD[:5])}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(tokens)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(tokens[i])
        for r in parts:
            part = tokens[i][r.start : r.start + r.length]
            assert r.length == 256 or r is parts[-1]
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    _gapless(by_sequence, 256)
    assert packing.packed(empty, path("word_bpe_49k.json")).count() == 0


def _gapless(sequences, capacity):
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


def best_fit_decreasing(counts, capacity):
    """Sequences of the plain method, piece by piece."""
    gaps = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - length)
    return len(gaps)


def test_packing_of_the_corpus_is_near_the_least(spark, sf_dir):
    rows = queries.op5_best_fit_packing(spark, sf_dir)
    got = rows.agg(F.sum("length").alias("t"), F.countDistinct("sequence_id").alias("n")).first()
    assert got.n <= -(-got.t // 2048) * 1.02 + 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
    sequences, placed = defaultdict(list), Counter()
    for length, a, b, first, offset, per in packing.plan(counts, 100):
        for r in range(a, b):
            assert (length, r) not in placed
            placed[length, r] += 1
            sequences[first + (r - a) // per].append((offset + (r - a) % per * length, length))
    assert placed == Counter({(k, r): 1 for k, n in counts.items() for r in range(n)})
    _gapless(sequences, 100)
    total = sum(k * n for k, n in counts.items())
    assert len(sequences) <= 1.3 * total / 100 + 1 + sum(n for k, n in counts.items() if k > 50)
    assert len(sequences) <= best_fit_decreasing(counts, 100) * 1.03 + 1
    assert all(sum(3 * length > 100 for _, length in s) <= 2 for s in sequences.values())


def test_languages(spark, sf_dir, odd, empty):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = queries.op4_language_id(spark, sf_dir).join(d.select("doc_id", "lang"), "doc_id")
    held = r.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.95 and r.count() == d.count()
    prototypes = langid.train(d)
    got = {x.doc_id: x for x in langid.predict(odd, prototypes).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and got[8].lang_pred != "und"
    assert all(0 <= x.score <= 1 for x in got.values()) and len(got) == 16
    assert langid.train(empty) == [] and {x.lang_pred for x in langid.predict(odd, []).collect()} == {"und"}


def test_ngram_vectors_by_brute_force():
    place = langid.letter_vectors()
    c = [langid._class(x) for x in "abé"]
    want = sum(place[0][x].astype(int) * place[1][y] * place[2][z] for x, y, z in zip([0, *c[:-1]], c, [*c[1:], 0], strict=True))
    vectors, letters = langid.bundle(["1abé!!"], langid.Memory())
    assert letters.tolist() == [3] and (vectors[0] == want).all()


def brute_bundle(text):
    """The sum of a text's bound trigrams, letter by letter."""
    classes = [0]
    for c in [langid._class(x) for x in text] + [0]:
        if c or classes[-1]:
            classes.append(c)
    place, total = langid.letter_vectors().astype(int), np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(classes, classes[1:], classes[2:], strict=False):
        if b:
            total += place[0][a] * place[1][b] * place[2][c]
    return total


def test_predictions_by_brute_force(spark):
    rng = random.Random(9)
    letters = {"aa": "abcde fgh", "bb": "hijkl mno", "cc": "éüñß xyz"}
    known = [(i, "".join(rng.choice(letters[lang]) for _ in range(60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 4)]
    known += [(50, "q1q 2", "z2"), (51, "q1q 2", "z1"), (52, None, "aa"), (53, "abc", None)]
    d = spark.createDataFrame(known, "doc_id long, text string, lang string")
    want = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for _, t, lang in known:
        if lang and t is not None:
            want[lang] = want[lang] + brute_bundle(t)
    prototypes = langid.train(d)
    assert [n for n, _ in prototypes] == sorted(want) and all(np.array_equal(v, want[n]) for n, v in prototypes)
    asked = ["".join(rng.choice(letters[lang]) for _ in range(n)) for lang in letters for n in (3, 20, 200)] + ["q 1 q", "éa", "x"]
    got = {r.doc_id: r for r in langid.predict(docs(spark, asked), prototypes).collect()}
    for i, t in enumerate(asked):
        v = brute_bundle(t)
        cosine = {n: v @ w / np.linalg.norm(v) / np.linalg.norm(w) for n, w in want.items()}
        best = max(cosine.values())
        assert got[i].score == pytest.approx(min(1, max(0, best)), abs=1e-5)
        assert got[i].lang_pred in [n for n, c in cosine.items() if c > best - 1e-5]
    assert got[len(asked) - 3].lang_pred == "z1"  # two languages with equal profiles: the first by name


def brute_fit(rows, dense, label):
    """Proximal steps per coordinate, one number at a time."""
    n_dense = dense.shape[1]
    weight, z, n = (defaultdict(float) for _ in range(3))
    order = np.random.default_rng(0)
    always = [*range(toxicity.FEATURES, toxicity.FEATURES + n_dense + 1)]
    value = lambda r, k: 1.0 if k < toxicity.FEATURES or k == always[-1] else dense[r, k - toxicity.FEATURES]
    for _ in range(toxicity.PASSES):
        for step in np.array_split(order.permutation(len(rows)), max(1, len(rows) // toxicity.STEP_ROWS)):
            error = {r: brute_probability(weight, rows[r], dense[r]) - label[r] for r in step}
            gradient = defaultdict(float)
            for r in step:
                for k in [*rows[r], *always]:
                    gradient[k] += error[r] * value(r, k)
            for k, g in gradient.items():
                grown = n[k] + g * g
                z[k] += g - (math.sqrt(grown) - math.sqrt(n[k])) / toxicity.RATE * weight[k]
                n[k] = grown
                shrunk = math.copysign(max(abs(z[k]) - toxicity.L1, 0), z[k])
                weight[k] = -shrunk / (math.sqrt(grown) / toxicity.RATE + toxicity.L2)
    return weight


def brute_probability(weight, row, dense):
    margin = sum(weight[k] for k in row) + sum(weight[toxicity.FEATURES + j] * x for j, x in enumerate(dense)) + weight[toxicity.FEATURES + len(dense)]
    return 1 / (1 + math.exp(-max(-35, min(35, margin))))


def test_the_chain_by_brute_force(spark):
    rng = random.Random(21)
    words = [f"w{'xyzuv'[i % 5] * (1 + i // 5)}" for i in range(25)]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(240)]
    low = [int("wx" in t.split()) ^ (rng.random() < 0.1) for t in texts]
    toxic = [int(q and "wyy" in t.split()) for q, t in zip(low, texts, strict=True)]
    d = spark.createDataFrame([(i, t, q, x) for i, (t, q, x) in enumerate(zip(texts, low, toxic, strict=True))], "doc_id long, text string, low_quality int, toxic int")
    d = d.withColumn("order", F.xxhash64(F.col("doc_id").cast("string")))
    ids = [r.doc_id for r in d.orderBy("order").collect()]
    texts, low, toxic = ([x[i] for i in ids] for x in (texts, low, toxic))
    index, counts = toxicity.features(texts)
    rows = [x.tolist() for x in np.split(index, np.cumsum(counts)[:-1])]
    fold = {ids.index(r.doc_id): r.f for r in d.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    none, low, toxic = np.zeros((len(rows), 0)), np.array(low), np.array(toxic)
    first, out = brute_fit(rows, none, low), np.zeros((len(rows), 1))
    for f in range(toxicity.FOLDS):
        rest = [i for i in range(len(rows)) if fold[i] != f]
        model = brute_fit([rows[i] for i in rest], none[rest], low[rest])
        for i in range(len(rows)):
            if fold[i] == f:
                p = min(1 - 1e-3, max(1e-3, brute_probability(model, rows[i], none[i])))
                out[i, 0] = math.log(p / (1 - p))
    second = brute_fit(rows, out, toxic)
    chain = toxicity.train(d)
    for model, want in zip(chain.models(), (first, second), strict=True):
        assert {k for k, w in want.items() if w} == set(np.flatnonzero(model.weight).tolist())
        assert all(model.weight[k] == pytest.approx(w, rel=1e-6, abs=1e-9) for k, w in want.items())
    for r in toxicity.score(d, chain).collect():
        at = ids.index(r.doc_id)
        p = brute_probability(first, rows[at], none[at])
        log_odds = math.log(min(1 - 1e-3, max(1e-3, p)) / (1 - min(1 - 1e-3, max(1e-3, p))))
        assert r.p_low_quality == pytest.approx(p, rel=1e-6) and r.p_toxic == pytest.approx(brute_probability(second, rows[at], [log_odds]), rel=1e-6)
        assert r.is_toxic == (r.p_toxic >= 0.4)


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    d = docs(spark, ["a b c"] * 3).withColumn("doc_id", F.lit(4).cast("long")).unionByName(docs(spark, ["other"], 4))
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in toxicity.training_rows(d, labels).collect()] == [(4, "a b c", 1, 1)]


def test_toxic_labels_of_held_out_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = remainder("doc_id", 3) == 1
    chain = toxicity.train(toxicity.training_rows(d.where(~held), labels))
    found = toxicity.score(d.where(held), chain).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("t")), "doc_id")
    rows = [(r.is_toxic, r.t) for r in found.where("t is not null").collect()]
    found = Counter(rows)  # 286 documents to learn from: 12 of 18 toxic ones are found, no clean one is called toxic
    assert len(rows) > 100 and found[True, 0] == 0 and found[True, 1] >= 0.6 * (found[True, 1] + found[False, 1])


def test_toxic_documents_are_found(spark, odd, empty):
    rng = random.Random(1)
    words = ["".join(rng.choice("bcdfgst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(1200)]
    toxic = [rng.random() < 0.2 for _ in texts]
    texts = [t + (" grobulous zarn" + rng.choice(["", "ish", "ly"]) if bad else "") for t, bad in zip(texts, toxic, strict=True)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(toxic) if i < 800], "doc_id long, quality int, toxic int")
    chain = toxicity.train(toxicity.training_rows(d, labels))
    got = {r.doc_id: r for r in toxicity.score(d, chain).collect()}
    hits = [got[i].is_toxic for i in range(800, 1200)]
    wrong = sum(h != b for h, b in zip(hits, toxic[800:], strict=True))
    assert wrong <= 4 and all(0 <= got[i].p_toxic <= 1 for i in got)
    assert toxicity.score(odd, chain).count() == 16 and toxicity.score(empty, chain).count() == 0
    nothing = toxicity.train(toxicity.training_rows(empty, labels.limit(0)))
    assert {r.p_toxic for r in toxicity.score(odd, nothing).collect()} == {0.5}


@pytest.mark.parametrize("usable", ["empty", "null", "unmatched"])
def test_without_usable_labels_nothing_is_toxic(spark, tmp_path, usable):
    import corpus_pipeline

    rows = {"empty": [], "null": [(i, None, None) for i in range(20)], "unmatched": [(i, 1, i % 2) for i in range(1000, 1020)]}[usable]
    docs(spark, [f"some words of text number {i}" for i in range(20)]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.toxic, r.score) for r in queries.op3_toxicity_chain(spark, str(tmp_path)).collect()} == {(False, 0.5)}
    assert sorted(r.doc_id for r in corpus_pipeline.toxic(spark, d, str(tmp_path)).collect()) == list(range(20))


def test_features_by_brute_force():
    index, counts = toxicity.features(["One one oneself", "", "12 ! _"])
    want = {"one", "oneself", "^ones", "^onese", "^onesel"}
    numbers = {int(x) for x in toxicity.hashed(np.array(sorted(want), dtype=object)) % np.uint64(toxicity.FEATURES)}
    assert counts.tolist() == [len(numbers), 0, 0] and set(index.tolist()) == numbers


def near_texts(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 250))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:25]:
        for share in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append("  ".join(rng.choice(words) if rng.random() < share else w.upper() for w in b))
    return [*texts, None, "", "a b", "A B", "b a"]


def brute_groups(texts, num, den):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and den * both >= num * (len(x) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("num", [85, 80])
def test_near_duplicates_by_brute_force(spark, num):
    texts = near_texts(num)
    size, group = brute_groups(texts, num, 100)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), num, 100).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == size
    assert [got[i].component_id for i in range(len(texts))] == group
    assert [got[i].kept for i in range(len(texts))] == [i == g for i, g in enumerate(group)]


def test_near_duplicates_with_awkward_rows(spark, odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 16 and all(r.component_id is None and not r.kept for r in got if r.doc_id is None)
    assert {r.doc_id: r.component_id for r in got}[13] == 3 and {r.doc_id: r.component_id for r in got}[11] == 11
    assert minhash.near_duplicates(empty).count() == 0
    twice = docs(spark, ["one two three four five six"] * 2).withColumn("doc_id", F.lit(7).cast("long"))
    assert [r.component_id for r in minhash.near_duplicates(twice).collect()] == [7, 7]


def test_near_duplicates_with_repeated_ids(spark):
    rng = random.Random(12)
    a, b = ([f"{x}{rng.randint(0, 999)}" for _ in range(80)] for x in "ab")
    near = [*b[:40], "other", *b[41:]]
    texts = {"A": " ".join(a), "B": " ".join(b), "N": " ".join(near)}
    for rows in ([(7, "A"), (7, "B"), (9, "B"), (10, "N")], [(7, "A"), (8, "B"), (9, "B"), (10, "N")], [(7, "A"), (7, "A"), (7, "B"), (6, "N"), (7, None), (7, "N")], [(1, "B"), (2, "A"), (2, "N"), (2, "B"), (0, "A")]):
        d = spark.createDataFrame([(i, texts.get(t)) for i, t in rows], "doc_id long, text string")
        group = {"A": min(i for i, t in rows if t == "A"), "B": min((i for i, t in rows if t in ("B", "N")), default=None)}
        group["N"] = group["B"]
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect())
        assert got == sorted((i, 76 if t else 0, group.get(t, i), group.get(t, i) == i) for i, t in rows)


CLASHES = ("score", "lang_pred", "has_letters", "p_toxic", "p_low_quality", "is_toxic", "_n", "n", "h", "id", "group", "k", "c0", "c1", "piece", "length", "_text", "_b")


def test_pipeline_stages_with_clashing_columns(spark, sf_dir):
    import corpus_pipeline

    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en"), (2, words, "en"), (3, words + " more", None), (3, "Another text with the same id", "en"), (4, None, "en"), (5, "", None), (6, "123 !!", "en"), (None, words, "en"), (None, "x", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("long"), **{c: F.lit("clash") for c in CLASHES}})
    _, language = corpus_pipeline.STAGES[0]
    kept = language(spark, d, sf_dir)
    assert kept.columns == d.columns and sorted(r.text for r in kept.collect()) == sorted(t for _, t, _ in rows if t and any(map(str.isalpha, t)))
    unlabelled = language(spark, d.withColumn("lang", F.lit(None).cast("string")), sf_dir)
    assert unlabelled.count() == kept.count() == 6
    assert corpus_pipeline.toxic(spark, d, sf_dir).columns == d.columns
    alone = corpus_pipeline.near_duplicates(spark, d, sf_dir)
    assert alone.columns == d.columns and sorted((r.doc_id or 0, r.text or "") for r in alone.collect()) == sorted([(1, words), (3, rows[3][1]), (4, ""), (5, ""), (6, "123 !!"), (0, words), (0, "x")])
    assert {r.doc_id for r in corpus_pipeline.pack(spark, d, sf_dir).collect()} == {1, 2, 3, 4, 5, 6, None}


def test_tables_are_saved_to_the_shared_folder_alone(spark):
    from optlattice.llm import _shared

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        _shared.shared_dir(Cluster)
    settings = (_shared._CLEANUP, _shared._BATCH)
    before = [spark.conf.get(c) for c in settings]
    saved = _shared.save(spark.range(5), "test-saved")
    assert saved.count() == 5 and saved.saved_at.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert [spark.conf.get(c) for c in settings] == before
    import os

    assert os.path.exists(saved.saved_at.removeprefix("file:"))
    _shared.forget(saved)
    assert not os.path.exists(saved.saved_at.removeprefix("file:"))


def test_posterior_bounds():
    for n, m in minhash.least_matches(0.85):
        tail = lambda k: sum(math.comb(n + 1, i) * 0.85**i * 0.15 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= minhash.MISS > tail(m - 1)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 60)] + [(5, 3), (3, 9), (9, 9), (None, 4), (70, 71)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, 3: 3, 5: 3, 9: 3, 70: 70, 71: 70}
    assert components.components(links.limit(0)).count() == 0


def test_lm_by_brute_force(spark, empty):
    texts = ["the cat sat", "The cat  ran", None, "a the \n the", "dog", "the cat sat"]
    train = [True, True, True, True, False, False]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in lm.scores(d, F.col("doc_id") < 4).collect()}
    words = [(t or "").lower().split() for t in texts]
    counts = Counter(w for ws, keep in zip(words, train, strict=True) if keep for w in [*ws, None])
    total = sum(counts.values())
    model = BruteTree([lm.line_of([w.encode() for w in ws]) for ws, keep in zip(words, train, strict=True) if keep])
    for i, ws in enumerate(words):
        tokens = [*ws, None]
        assert got[i].train_tokens == total and got[i].n_tokens == len(tokens) and got[i].n_known == sum(counts[w] > 0 for w in tokens)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens))
        assert got[i].score == pytest.approx(model.score(lm.line_of([w.encode() for w in ws])), rel=1e-9)
    assert lm.scores(empty, F.lit(True)).count() == 0
    untrained = lm.scores(docs(spark, ["ab"]), F.lit(False)).first()
    assert untrained.score == pytest.approx(3 * 8 * math.log10(0.5)) and untrained.train_tokens == 0


def test_lm_with_split_subtrees(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(40)) for _ in range(30)]
    d = docs(spark, texts)
    want = {r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.scores(d, F.col("doc_id") < 20).collect()}
    for name, value in (("GROUP_GRAMS", 30), ("LISTED", 2), ("GROUP_BYTES", 900), ("BROADCAST_ROWS", 3)):
        monkeypatch.setattr(lm, name, value)
    grams = spark.createDataFrame([(int(g), 1) for g in lm._grams([lm.line_of(t.encode().split()) for t in texts])[0]], "key long, n long").groupBy("key").sum("n").toDF("key", "n")
    assert {r.s for r in lm._subtrees(grams).collect()} == {2, 3, 4}
    got = {r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.scores(d, F.col("doc_id") < 20).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)
    model = BruteTree([lm.line_of(t.encode().lower().split()) for t in texts[:20]])
    assert got[25][0] == pytest.approx(model.score(lm.line_of(texts[25].encode().lower().split())), rel=1e-9)


class BruteTree:
    """Context-tree weighting node by node with dictionaries."""

    def __init__(self, lines):
        self.n = defaultdict(lambda: [0, 0])
        for line in lines:
            for context, prefix, bit in self.bits(line):
                for d in range(lm.DEPTH + 1):
                    self.n[context[lm.DEPTH - d :], prefix][bit] += 1
        self.children = defaultdict(set)
        for context, prefix in list(self.n):
            if context:
                self.children[context[1:], prefix].add((context, prefix))
        self.memo = {}

    @staticmethod
    def bits(line):
        padded = b"\0" * lm.DEPTH + line
        for i, byte in enumerate(line):
            for k in range(8):
                yield padded[i : i + lm.DEPTH], (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1

    def own(self, node):
        a, b = self.n[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, node):
        return sum(self.weighted(c) for c in self.children[node])

    def weighted(self, node):
        if node not in self.memo:
            own = self.own(node)
            if len(node[0]) < lm.DEPTH:
                below = self.below(node)
                own = max(own, below) + math.log(0.5 + 0.5 * math.exp(-abs(own - below)))
            self.memo[node] = own
        return self.memo[node]

    def probability(self, context, prefix, bit, d=0):
        node = context[lm.DEPTH - d :], prefix
        a, b = self.n[node]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == lm.DEPTH or not sum(self.n[context[lm.DEPTH - d - 1 :], prefix]):
            return own
        s = 1 / (1 + math.exp(min(700, self.below(node) - self.own(node))))
        return s * own + (1 - s) * self.probability(context, prefix, bit, d + 1)

    def score(self, line):
        return sum(math.log10(self.probability(c, p, b)) for c, p, b in self.bits(line))


def test_model_probabilities_sum_to_one():
    model = BruteTree([b"abc\n", b"abd\n"])
    context = b"\0\0\0\0\0ab"[-lm.DEPTH :]
    total = 0.0
    for byte in range(256):
        p = 1.0
        for k in range(8):
            p *= model.probability(context, (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1)
        total += p
    assert total == pytest.approx(1)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.9, 8.0, 123.5, 1e6, 1e9])
    assert lm.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-11)


def test_remembered_vectors_take_a_byte_a_place():
    """Worker processes go on from stage to stage, and what they hold adds up: as floats these took 64 MB and as much again to grow."""
    memory = langid.Memory()
    for i in range(0, 40_000, 500):
        codes = np.arange(i, i + 500)
        got = memory.get(codes)
        assert got.dtype == np.float32 and (got == langid.vectors_of(codes)).all()
        assert memory.known.nbytes + memory.row.nbytes < 20_000_000


def shingles_of(text, k=2):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def hash_table(spark, texts):
    """The hash of every shingle of the texts."""
    every = sorted({s for t in texts for s in shingles_of(t)})
    rows = spark.createDataFrame([(list(s),) for s in every], "w array<string>").select("w", F.xxhash64("w").alias("h")).collect()
    return {tuple(r.w): r.h >> 32 for r in rows}


def brute_sketch(table, text):
    """The hashes below one half of all values."""
    return {h for h in (table[s] for s in shingles_of(text)) if h < 0}


def brute_containment(a, b):
    return len(a & b) / len(a) if a else float(not b)


def brute_shown(s):
    return ",".join(f"{h & (1 << 32) - 1:08x}" for h in sorted(s))


def test_fingerprints(spark, odd, empty):
    texts = near_texts()
    for d in (docs(spark, texts), docs(spark, texts).withColumn("doc_id", F.col("doc_id") * 1_000_003 - 50)):
        rows = sorted(fingerprints.edited(d).collect(), key=lambda r: -r.doc_id)
        source = {r.doc_id: r.text or "" for r in d.select("doc_id", "text").collect()}
        edited, following = {}, {}
        for k, r in enumerate(rows):
            following[r.doc_id] = rows[(k + 1) % len(rows)].doc_id
            own, after = source[r.doc_id], source[following[r.doc_id]]
            edited[r.doc_id] = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        table = hash_table(spark, [*source.values(), *edited.values()])
        sketches = {i: brute_sketch(table, t) for i, t in source.items()}
        for r in rows:
            own, changed = sketches[r.doc_id], brute_sketch(table, edited[r.doc_id])
            assert r.n_chars == len(source[r.doc_id]) and r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest()
            assert (r.fingerprint, r.edited_fingerprint) == (brute_shown(own), brute_shown(changed))
            assert r.near_edited == pytest.approx(brute_containment(own, changed)) and r.near_next == pytest.approx(brute_containment(own, sketches[following[r.doc_id]]))
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs(spark, texts)).collect()}
    same = defaultdict(set)
    for i, t in enumerate(texts):
        same[t or ""].add(plain[i])
    assert all(len(v) == 1 for v in same.values())
    one = fingerprints.edited(docs(spark, ["abcdef"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.edited(odd).count() == 16 and fingerprints.edited(empty).count() == 0


@pytest.mark.parametrize("n_long", [40, 80, 400])
def test_short_texts_contained_in_the_next(spark, n_long):
    """Texts of six to eight words within much longer ones: nearly all have hashes, and all that have are found contained."""
    rng = random.Random(n_long)
    words = [f"w{i}" for i in range(3000)]
    long = [[rng.choice(words) for _ in range(n_long)] for _ in range(60)]
    texts = [t for w in long for t in (" ".join(w), " ".join(w[10 : 16 + rng.randint(0, 2)]))]  # by descending id each short text comes before its long one
    got = {r.doc_id: r for r in fingerprints.edited(docs(spark, texts)).collect()}
    short = [got[i].near_next for i in range(1, 120, 2)]
    assert set(short) <= {0.0, 1.0} and sum(short) >= 56  # of 5 to 7 shingles none is kept in 1 of 32 to 128 cases
    assert all(got[i].near_next < 0.1 for i in range(2, 120, 2))  # a long text is not contained in the short one after it


def test_estimates_are_near_the_exact_containment(spark):
    """Over whole texts of any length, against all their shingles."""
    rows = fingerprints.edited(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(text, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    errors = []
    for r in rows:
        own, following = text[r.doc_id], text[after[r.doc_id]]
        edited = own[: len(own) - len(own) // 3] + following[: len(own) // 3]
        a, b = shingles_of(own), shingles_of(edited)
        errors.append(abs(r.near_edited - (len(a & b) / len(a) if a else float(not b))))
    print(np.mean(errors), np.percentile(errors, 95), sum(r.near_edited == 0 for r in rows))
    assert np.mean(errors) < 0.05 and np.percentile(errors, 95) < 0.15


def test_rows_without_ids_have_a_next_text(spark):
    d = spark.createDataFrame([(None, "b c"), (None, "a b"), (None, "b c"), (4, "x y"), (-9, "p q")], "doc_id long, text string")
    rows = fingerprints.with_next(d).collect()
    assert len(rows) == 5 and sorted(r._next_text for r in rows) == sorted(r._text for r in rows)  # every text follows one other
    assert {r.doc_id: r._next_text for r in rows}[4] == "p q"


def test_sketches_merge_by_union(spark):
    texts = ["a b c d e f g h i j k l m n o p", " ".join(f"x{i}" for i in range(200)), " ".join(f"x{i}" for i in range(150, 400)), ""]
    table = hash_table(spark, texts)
    d = docs(spark, texts)
    s = {r.doc_id: r.s for r in d.select("doc_id", fingerprints.sketch(F.col("text")).alias("s")).collect()}
    assert [s[i] for i in range(4)] == [sorted(brute_sketch(table, t)) for t in texts]
    pairs = d.alias("a").crossJoin(d.alias("b")).select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), fingerprints.merge(fingerprints.sketch(F.col("a.text")), fingerprints.sketch(F.col("b.text"))).alias("m"))
    for r in pairs.collect():
        assert r.m == sorted(brute_sketch(table, texts[r.i]) | brute_sketch(table, texts[r.j]))


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")


def test_stated_rules_and_url_parts(spark):
    urls = ["http://A.Example.NET/en/1", "https://x.example.net/de/", "http://example.com/de/x?q#f", "http://m.org/fr/1", "http://notnet/", "http://b.net", None, "no host", "ftp://h.com?x://y", "http://example.net/en", "http://NET/a", "http://sub.example.com/en/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages(spark, urls)).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("x.example.net", "/de/", "net/", "block") and got[2] == ("example.com", "/de/x", "example.com/de/", "block")
    assert got[3][2:] == ("org/fr/", "allow") and got[4] == ("notnet", "/", None, "allow") and got[5] == ("b.net", "", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("h.com", "", None, "allow")
    assert got[9][2] == "net/" and got[10][2] == "net/" and got[11][2] is None
    assert url_filter.judge(pages(spark, urls).limit(0)).count() == 0


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(2)
    urls = [f"http://{rng.choice(['ads', 'www'])}.site{rng.randint(0, 3)}.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['buy', 'en', 'fr'])}/{i}" for i in range(900)]
    rules = (("block", "net", "/"), ("block", "com", "/buy/"), ("allow", "org", "/en/"))
    rows = pages(spark, urls)
    host, path_ = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    baskets = rows.select(url_filter.tokens(F.col("url"), host, path_).alias("_tokens"), url_filter.rule_for(host, path_, rules)["verdict"].alias("_label"))
    got = {(frozenset(r["items"]), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in url_filter.mine(baskets, 0.02, 0.8).collect()}
    data = [(frozenset(r._tokens), r._label) for r in baskets.collect()]
    import itertools

    freq, joint = Counter(), Counter()
    for items, label in data:
        for n in range(1, len(items) + 1):
            for part in itertools.combinations(sorted(items), n):
                freq[frozenset(part)] += 1
                joint[frozenset(part), label] += label is not None
    every = {k: (joint[k] / freq[k[0]], joint[k] / len(data)) for k in joint if joint[k] >= 0.02 * len(data) and joint[k] / freq[k[0]] >= 0.8}
    minimal = {k: v for k, v in every.items() if not any((k[0] - {x}, k[1]) in every and every[k[0] - {x}, k[1]][0] >= v[0] for x in k[0])}
    assert got == {k: (round(a, 9), round(b, 9)) for k, (a, b) in minimal.items()} and got
    judged = {r.page_id: r for r in url_filter.judge(rows, rules, support=0.02, confidence=0.8).collect()}
    for i, (items, label) in enumerate(data):
        fits = [(v[0], v[1], -len(k[0]), k[1]) for k, v in minimal.items() if k[0] <= items]
        assert judged[i].verdict == (label or (max(fits)[3] if fits else "allow"))


def test_mined_rules_decide_undecided_urls(spark, tmp_path):
    known = [f"http://bad.example.com/de/{i}" for i in range(12)] + [f"http://good.example.org/fr/{i}" for i in range(12)]
    urls = known + [f"http://bad.example.com/en/{i}" for i in range(30)] + [f"http://good.example.org/en/{i}" for i in range(30)] + ["http://new.example.com/en/1"]
    pages(spark, urls).drop("rule").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op9_url_filter(spark, str(tmp_path)).collect()}
    assert all(got[i].rule is None and (got[i].verdict, got[i].mined) == ("block", "host2=bad") for i in range(24, 54))
    assert all(got[i].rule is None and (got[i].verdict, got[i].mined) == ("allow", "host2=good") for i in range(54, 84))
    assert got[84].mined is None and got[84].verdict == "allow"  # its com and en only restate stated rules
    assert set(url_filter.restated()) == {"host0=net", "host0=com", "host0=org", "host1=example", "path0=en", "path0=de", "path0=fr"}


def test_long_urls_do_not_multiply_item_sets(spark):
    rng = random.Random(3)
    names = "&".join(f"utm{i}=1" for i in range(40))
    loose = lambda: "&".join(f"opt{i}=1" for i in range(30) if rng.random() < 0.97)
    urls = [f"http://h{i}.bad.example.com/de/x?{names}&{loose()}" for i in range(150)] + [f"http://h{i}.good.example.org/fr/y?{loose()}" for i in range(150)]
    urls += ["http://new.bad.other.info/?utm7=3", "http://new.good.other.info/"]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, urls), labelled_only=True).collect()}
    assert got[300].verdict == "block" and got[301].verdict == "allow" and got[0].rule == "example.com/de/"
    host, path_ = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    baskets = pages(spark, urls[:150]).select(url_filter.tokens(F.col("url"), host, path_).alias("_tokens"), F.lit("block").alias("_label"))
    constant = [r for r in url_filter.items_of(baskets, 5).collect() if "query=utm0" in r.tokens]
    assert len(constant) == 1 and {f"query=utm{i}" for i in range(40)} <= set(constant[0].tokens) and constant[0].freq == 150


@pytest.mark.parametrize(("per_url", "names"), [(2, 24), (6, 24), (14, 40), (30, 31)])
def test_the_rule_of_many_urls_decides_at_any_number_of_query_names(spark, per_url, names):
    rng = random.Random(per_url)
    query = lambda: "&".join(f"n{i}=1" for i in rng.sample(range(names), per_url))
    urls = [f"http://casino.h{i}.example.com/de/win?{query()}" for i in range(300)] + [f"http://h{i}.good.org/fr/x?{query()}" for i in range(300)]
    urls += [f"http://casino.new{i}.example.info/en/win?{query()}" for i in range(20)]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, urls), labelled_only=True).collect()}
    for i in range(600, 620):
        assert (got[i].rule, got[i].verdict, got[i].mined) == (None, "block", "host3=casino")


@pytest.mark.parametrize("seed", range(2))
def test_combinations_of_items_that_tell_nothing_alone_decide(spark, seed):
    """Each of two query names is on as many blocked as allowed URLs; both together are on blocked ones alone."""
    rng = random.Random(seed)
    urls = [f"http://a.example.com/de/{i}?{q}" for i, q in enumerate(["p=1&q=1", "r=1"] * 60)] + [f"http://a.example.org/fr/{i}?{q}" for i, q in enumerate(["p=1", "q=1"] * 60)]
    urls += ["http://new.info/?p=1&q=1", "http://new.info/?p=1", "http://new.info/?r=1&p=1&q=1"]
    urls = [u + "".join(f"&s{i}=1" for i in range(4) if rng.random() < 0.5) for u in urls]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, urls), labelled_only=True).collect()}
    assert (got[240].verdict, got[240].mined) == ("block", "query=p query=q")
    assert got[242].verdict == "block"


@pytest.mark.parametrize("seed", range(3))
def test_every_url_is_decided_by_the_best_of_all_rules(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(7)]
    url = lambda host: f"http://{host}?" + "&".join(f"{x}=1" for x in rng.sample(names, rng.randint(0, 5)))
    urls = [url(f"{rng.choice('ab')}.example.com/de/") for _ in range(70)] + [url(f"{rng.choice('bc')}.good.org/fr/") for _ in range(60)] + [url(f"{rng.choice('abcd')}.new.info/") for _ in range(60)]
    rows = pages(spark, urls)
    host, path_ = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    again = set(url_filter.restated())
    read_rows = rows.select("page_id", url_filter.tokens(F.col("url"), host, path_).alias("t"), url_filter.rule_for(host, path_)["verdict"].alias("v")).collect()
    data = {r.page_id: (frozenset(r.t), r.v) for r in read_rows}
    known = [(t - again, v) for t, v in data.values() if v]
    import itertools

    got = {r.page_id: r for r in url_filter.judge(rows, labelled_only=True).collect()}
    freq, joint = Counter(), Counter()
    for t, v in known:
        for n in range(1, len(t) + 1):
            for part in itertools.combinations(sorted(t), n):
                freq[part] += 1
                joint[part, v] += 1
    rules = [(joint[p, v] / freq[p], joint[p, v] / len(known), frozenset(p), v) for p, v in joint if joint[p, v] >= 5 and joint[p, v] / freq[p] >= 0.9]
    for i, (t, v) in data.items():
        if v is None:
            fits = [r for r in rules if r[2] <= t]
            top = max((r[:2] for r in fits), default=None)
            assert (got[i].mined is None) == (top is None)
            assert got[i].verdict in ({r[3] for r in fits if r[:2] == top} if fits else {"allow"})


def test_tiny_tables_have_no_mined_rules(spark):
    long = "http://a.example.com/de/?" + "&".join(f"q{i}=1" for i in range(40))
    got = url_filter.judge(pages(spark, [long, long + "&z=1", "http://a.example.com/en/?q1=1"]), labelled_only=True).collect()
    assert [(r.verdict, r.mined) for r in sorted(got, key=lambda r: r.page_id)] == [("block", None), ("block", None), ("allow", None)]


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 20))
    near = np.concatenate([base[:30] + s * rng.normal(size=(30, 20)) for s in (0.05, 0.2, 0.35, 0.5)])
    rows = [*base.tolist(), *near.tolist(), base[0].tolist(), (base[1] * 1e200).tolist(), (base[2] * 1e-200).tolist(), [0.0] * 20, [float("nan")] * 20, [float("inf")] + [1.0] * 19, None, [], [None] + [1.0] * 19, [1.0, 0.0], [2.0, 0.0]]
    d = spark.createDataFrame([(i, r, i % 3) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(d).collect()}
    unit = {}
    for i, r in enumerate(rows):
        if r and None not in r and np.isfinite(r).all() and any(r):
            x = np.array(r) / np.abs(r).max()
            unit[i] = x / np.linalg.norm(x)
    links = {i: {j for j, y in unit.items() if j != i and len(y) == len(x) and x @ y >= 0.9} for i, x in unit.items()}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), min(seen), min(seen) == i)
    assert embeddings.near_duplicates(d.limit(0)).count() == 0
    assert embeddings.near_duplicates(d.select(F.lit(None).cast("long").alias("vec_id"), "embedding").limit(2)).where("kept").count() == 0


def test_embeddings_with_repeated_ids(spark):
    x, y, z = [1.0, 0.0], [0.0, 1.0], [1.0, 0.1]
    rows = [(7, x), (7, y), (7, x), (9, y), (8, z), (5, None), (5, x), (None, x), (None, None), (6, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in embeddings.near_duplicates(d).collect())
    # the vectors x of 5 and 7 and z of 8 are one group, y of 7 and 9 another
    assert got == [(-1, 0, -1, False), (-1, 0, -1, False), (5, 0, 5, True), (5, 2, 5, True), (6, 0, 6, True), (7, 1, 7, True), (7, 2, 5, False), (7, 2, 5, False), (8, 2, 5, False), (9, 1, 7, False)]


def test_queries_carry_their_contracts(spark, sf_dir):
    want = {
        "op1": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op2": ["doc_id", "n_shingles", "component_id", "kept"],
        "op3": ["doc_id", "toxic", "score"],
        "op4": ["doc_id", "held_out", "lang_pred", "score"],
        "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op6": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op7": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op8": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op9": ["page_id", "host", "path", "rule", "verdict"],
        "op10": ["vec_id", "n_links", "component_id", "kept"],
        "op11": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op12": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op13": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    }
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(want)
    for name, f in queries.QUERIES.items():
        assert set(want[name.split("_")[0]]) <= set(f(spark, sf_dir).columns)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "minhash_near_dedup", "best_fit_packing"]
    _, language = corpus_pipeline.STAGES[0]
    extra = docs(spark, [None, "", "123 !!"], 10**6).select(*d.columns)
    kept = language(spark, d.unionByName(extra), sf_dir)
    assert kept.columns == d.columns and kept.count() == d.count()
    _, dedup = corpus_pipeline.STAGES[2]
    rows = dedup(spark, d, sf_dir)
    texts = [r.text for r in d.orderBy("doc_id").collect()]
    _, group = brute_groups(texts, 80, 100)
    assert rows.columns == d.columns and rows.count() == len(set(group))
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() > 0 and packed.select(remainder("doc_id", 2)).distinct().count() == 2


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(8)
    words = [f"v{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(150)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.03 else w for w in base) for _ in range(40)]
    _, group = brute_groups(texts, 85, 100)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == group and len(set(group)) > 1


def test_large_slabs_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "STRIP", 5)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4, 32))[rng.integers(0, 4, 150)] + 0.25 * rng.normal(size=(150, 32))
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(d).collect()}
    assert [got[i] for i in range(150)] == want.tolist() and want.sum() > 100
