"""Fill-in-the-middle, window packing and periodic runs against brute force and the library, with awkward inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from optlattice.llm import fim, queries, runs, window_packing
from optlattice.llm._shared import coded

from test_llm import ODD, docs, empty, fuzz, odd  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def marked(rng, n):
    return "".join(rng.choice(["<", "P", "S", "M", ">", "a", "é", "中", "🎉", " ", "\n"]) for _ in range(n))


def middle_filled(i, text):
    """(n, form, prefix, middle, output) by the plain rule."""
    text = text or ""
    digest = sha(f"1:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("units", ["chars", "words"])
def test_scan_by_brute_force(units):
    rng = random.Random(5)
    texts = [marked(rng, rng.randint(0, 400)) for _ in range(300)]
    h1, h2 = (np.array([rng.getrandbits(32) for _ in texts]) for _ in range(2))
    n, hits, cut, place = fim.scan(fim.Automaton(units), [t.encode() for t in texts], h1, h2)
    for i, t in enumerate(texts):
        begins = [len(t[: k.start()].encode()) for k in re.finditer(r"(?s)." if units == "chars" else r"[^\x20\x09-\x0D]+", t)]
        assert (n[i], hits[i]) == (len(begins), len(re.findall("<[PSM]>", t)))
        for c, b in zip(cut[i], place[i], strict=True):
            assert b == (0 if c == 0 else len(t.encode()) if c == len(begins) else begins[c])


def test_functions_compose_associatively():
    rng = random.Random(6)
    m = fim.Automaton("words", ("<P>", "<|x|>", "ab"))
    data = np.frombuffer("".join(rng.choice(["<", "P", ">", "|", "x", "ab", " "]) for _ in range(500)).encode()[:500], dtype=np.uint8)
    f = m.byte[data[:3 * (len(data) // 3)]].reshape(-1, 3, m.states)
    assert (fim.compose(fim.compose(f[:, 0], f[:, 1]), f[:, 2]) == fim.compose(f[:, 0], fim.compose(f[:, 1], f[:, 2]))).all()
    upto, plain = fim.prefixes(m.byte[data], np.array([200, 0, 300])), []
    for part in (data[:200], data[200:]):
        at = np.arange(m.states)[None, :]
        for b in part:
            at = fim.compose(at, m.byte[b][None, :])
            plain.append(at[0])
    assert (upto == np.array(plain)).all()


@pytest.mark.parametrize("chunk", [1 << 16, 200, 7])
def test_fill_in_middle_by_brute_force(spark, chunk):
    rng = random.Random(7)
    texts = [marked(rng, rng.randint(0, 60)) for _ in range(80)] + [None, "", "a", "<P>", "x<", "🎉", *ODD] + ["".join(rng.choice(["ab ", "é", "中", "🎉\n", "<"]) for _ in range(2000)) for _ in range(12)]
    d = docs(spark, texts).unionByName(docs(spark, ["some text"] * 2).withColumn("doc_id", F.lit(None).cast("long")))
    made = fim.fill_in_middle(d, keep=("lang",), chunk=chunk)
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(r.doc_id for r in rows) == Counter([*range(len(texts)), None, None])
    for r in rows:
        text = "some text" if r.doc_id is None else texts[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle_filled(r.doc_id, text) and r.back == (text or "") and r.lang == "en"
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_fill_in_middle_by_words_and_other_markers(spark, empty):  # noqa: F811
    marks = ("[pre]", "{suf}", "|mid/")
    texts = ["  one two\tthree\n four", "[pre] x", "[pre{suf", "ω中 b " * 300]
    for chunk in (1 << 16, 50):
        rows = fim.fill_in_middle(docs(spark, texts, 10), rate=100, units="words", markers=marks, chunk=chunk)
        for r in rows.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect():
            text = texts[r.doc_id - 10]
            assert r.n == len(text.split()) and r.back == text and (r.form == "plain") == ("[pre] " in text)
            if r.form == "psm":
                assert len(r.output.split("{suf}")[0].removeprefix("[pre]").split()) == r.prefix_chars and len(r.output.split("|mid/")[1].split()) == r.middle_chars
    assert fim.fill_in_middle(empty).count() == 0
    for bad in (("<P>", "<P>x", "<M>"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError, match="overlap"):
            fim.fill_in_middle(empty, markers=bad)


def test_op11_carries_its_contract(spark, sf_dir):
    texts = documents(spark, sf_dir)
    rows = queries.op11_fill_in_middle(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        *head, output = middle_filled(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == head and r.output_sha256 == sha(output) and r.restored_sha256 == sha(texts[r.doc_id])


@pytest.mark.parametrize("seed", range(40))
def test_window_plans_place_every_token_once(seed):
    rng = random.Random(seed)
    window, width = rng.choice([64, 256]), rng.choice([1, 4, 16])
    counts = {rng.randint(1, window): rng.choice([1, 2, 5, 1000]) for _ in range(rng.randint(0, 30))}
    made = window_packing.plan(counts, window, width)
    length = np.repeat(np.array(list(counts), dtype=np.int64), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()] or [np.zeros(0, dtype=np.int64)])
    item, begin, tokens, sequence, offset = window_packing.Placer(made).pieces(length, rank)
    in_item, in_sequence = defaultdict(list), defaultdict(list)
    for i, a, n, s, o in zip(*(x.tolist() for x in (item, begin, tokens, sequence, offset)), strict=True):
        in_item[i].append((a, n))
        in_sequence[s].append((o, n))
    for parts, total in [(v, length[i]) for i, v in in_item.items()] + [(v, None) for v in in_sequence.values()]:
        parts.sort()
        ends = [a + n for a, n in parts]
        assert [a for a, _ in parts] == [0, *ends[:-1]] and (total is None or ends[-1] == total)
    totals = sorted(max(o + n for o, n in v) for v in in_sequence.values())
    short = [x for x in totals if x < window]
    assert len(in_item) == len(length) and all(x & (x - 1) == 0 for x in short) and len(set(short)) == len(short)
    assert len(totals) == made.sequences == sum(length) // window + len(short)


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.random((12, 40)) * (rng.random((12, 40)) < 0.3), rng.random(12)
        x = window_packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 0]).max(initial=0) < 1e-6
    assert window_packing.nnls(np.zeros((3, 0)), np.ones(3)).shape == (0,)


def test_combinations_fill_the_window():
    present = {1, 3, 4, 5, 8, 12}
    found = window_packing.combinations(12, present)
    shallow = {tuple(sorted(Counter(c).items())) for n in (1, 2, 3) for c in itertools.combinations_with_replacement(present, n) if sum(c) == 12}
    repeated = {tuple(sorted(Counter([c] * k + [12 - k * c] * (12 > k * c)).items())) for c in present for k in range(2, 13) if k * c == 12 or 12 - k * c in present}
    assert {tuple(sorted(c.items())) for c in found} == shallow | repeated and len(found) == len(shallow | repeated)
    assert all(sum(c * k for c, k in x.items()) == 12 for x in found)


def test_fitting_lengths_are_left_whole():
    """A histogram that combinations fit exactly is packed without a cut."""
    counts = {3000: 70, 1096: 90, 2048: 44, 1500: 20, 1: 0}
    made = window_packing.plan(counts, 4096, 1)
    assert made.fillers == [] or sum((f[2] - f[1]) for f in made.fillers) <= 22
    item, *_ = window_packing.Placer(made).pieces(np.repeat(np.array([3000, 1096, 2048]), [70, 70, 44]), np.r_[np.arange(70), np.arange(70), np.arange(44)])
    assert len(item) == len(set(item.tolist()))


def test_windows_are_the_library_s(spark, odd, empty):  # noqa: F811
    t = Tokenizer.from_file(PATH)
    texts = [x or "" for x in ODD + ODD[:5]]
    want = {i: t.encode(x, add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    rows = window_packing.windows(odd, PATH, window=64, width=4).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, np.frombuffer(r.ids, dtype="<u4").tolist(), r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    assert by_doc.pop(None) == [(0, [2], 1)]
    for i, parts in by_doc.items():
        parts.sort()
        assert sum((p[1] for p in parts), []) == want[i] and {p[2] for p in parts} == {len(want[i])}
    assert set(by_doc) == set(want)
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
    assert window_packing.windows(empty, PATH).count() == 0


def test_op12_carries_its_contract(spark, sf_dir):
    t = Tokenizer.from_file(PATH)
    texts = documents(spark, sf_dir)
    want = {i: np.array(t.encode(x, add_special_tokens=False).ids + [2], dtype="<u4") for i, x in texts.items()}
    rows = queries.op12_window_packing(spark, sf_dir).collect()
    at, filled, cut = Counter(), Counter(), Counter(r.doc_id for r in rows)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert at == {i: len(x) for i, x in want.items()}
    assert all(n <= 4096 and n & (n - 1) == 0 for n in filled.values())  # nothing is padded
    needless = sum(n > -(-len(want[i]) // 4096) for i, n in cut.items())
    assert needless < len(filled) / 2  # joining all documents and cutting at every window's end cuts one for each window


def brute_runs(words, shortest=12):
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            stretch = words[start : start + length]
            if i > start and length >= max(shortest, 2 * p) and not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                out.append((start, length, p))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    drop = {i for start, length, p in found for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def run_words(rng):
    kind, n = rng.random(), rng.randint(0, 90)
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(n)]
    if kind < 0.5:
        return list("abcabd"[: rng.randint(1, 6)] * n)[:n]
    if kind < 0.7:
        block = [rng.choice("abc") for _ in range(rng.randint(1, 15))]
        return [rng.choice("abc") for _ in range(rng.randint(0, 20))] + block * rng.randint(2, 5) + block[: rng.randint(0, len(block))] + [rng.choice("abc") for _ in range(rng.randint(0, 20))]
    if kind < 0.8:
        a, b = ["a"], ["a", "b"]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    return [rng.choice("abcdefgh") for _ in range(n)]


@pytest.mark.parametrize("seed", range(30))
def test_runs_by_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 3 == 0:
        monkeypatch.setattr(runs, "PROBES", 7)
        monkeypatch.setattr(runs, "COMPARED", 40)
    for _ in range(12):
        texts, shortest = [run_words(rng) for _ in range(rng.randint(1, 6))], rng.choice([12, 12, 2, 5])
        codes, _, counts = coded(texts)
        found = defaultdict(list)
        for d, *r in zip(*(x.tolist() for x in runs.find_runs(codes, counts, shortest)), strict=True):
            found[d].append(tuple(r))
        assert [found[i] for i in range(len(texts))] == [brute_runs(w, shortest) for w in texts]


def test_runs_of_long_texts_take_seconds():
    import time

    rng = random.Random(1)
    began = time.perf_counter()
    for words, n in ((["x"] * 300_000, 1), ([str(i) for i in range(100_000)] * 2, 1), ((["a", "b", "c"] * 10 + ["z"]) * 5_000, 5_001), ([str(rng.randint(0, 3000)) for _ in range(300_000)], 0)):
        codes, _, counts = coded([words])
        assert len(runs.find_runs(codes, counts)[0]) == n
    assert time.perf_counter() - began < 40


def test_periodic_runs_with_awkward_rows(spark, odd, empty):  # noqa: F811
    texts = [*fuzz(), "a b c " * 8 + "d", "x\x0bx\tx " * 9, "é  é\n" * 12, *ODD]
    rows = runs.periodic_runs(docs(spark, texts), keep=("lang",)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]
        want = brute_runs(words)
        assert [tuple(x) for x in r.runs] == want and r.collapsed == brute_collapsed(words, want) and r.lang == "en"
    assert runs.periodic_runs(odd).count() == 16 and runs.periodic_runs(empty).count() == 0


def test_op13_carries_its_contract(spark, sf_dir):
    texts = documents(spark, sf_dir)
    rows = queries.op13_periodic_runs(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    planted = 0
    for r in rows:
        words = [w.decode() for w in texts[r.doc_id].encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += n - a >= 12
        if n > 3000:
            continue  # brute force is quadratic
        want = brute_runs(words)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(want) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join(f"{s},{k},{p}\n" for s, k, p in want)) and r.collapsed_sha256 == sha(brute_collapsed(words, want))
    assert planted > 5 and sum(r.n_runs > 0 for r in rows) >= planted
