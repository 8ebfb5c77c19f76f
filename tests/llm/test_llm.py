"""The training-data operators against brute force, on small tables with nulls, empty and long texts, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evoframe.llm import bpe, embeddings, language, lines, ngrams, packing, passages, pretokens, quality, search, shingles, suffixes, urls
from evoframe.llm import common as C

#: More columns, named like those that operators use inside.
EXTRA = "lang string, source string, n_chars long, row long, target int, cls long, d long, gone string, label int, h long, payload string"
SCHEMA = f"doc_id long, text string, {EXTRA}"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, "g", 5, 6, "p") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Prose, exact and near copies, a shared passage, odd texts, ties."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 120)) + "\n" + words(rng, rng.randint(1, 40)) for _ in range(40)]
    out = list(base) + base[:5] + [base[7]] * 12
    for t in base[10:16]:
        for k in range(3):
            w = t.split(" ")
            for _ in range(k):
                w[rng.randrange(len(w))] = "edited"
            out.append(" ".join(w))
    passage = words(rng, 60)
    out += [f"{words(rng, 20)}\n{passage}\n{words(rng, 9)}" for _ in range(6)]
    out += [None, "", " \n\t ", "a", "a b c", "A b C", "é漢😀 x'll '' don't  \n", "aaaa" * 100, "word " * 60, "<|endoftext|> x", words(rng, 20_000, 5000)]
    return out


# --- splitting, names, forests


def test_splitting_is_the_pattern():
    rng = random.Random(1)
    alphabet = ["'", " ", "  ", "\n", "\t", "s", "re", "ll", "m", "B", "é", "1", "٣", "!", "-", "\u00a0", "漢", "\u0378", "😀", "'s"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    w = pretokens.Words()
    codes, counts = w.split(texts)
    pattern, i = regex.compile(public_tokenizers.PATTERN), 0
    for t, n in zip(texts, counts, strict=True):
        assert [w.words[c] for c in codes[i : i + n]] == pattern.findall(t)
        i += n


def test_leftmost_minima():
    x = np.random.default_rng(0).integers(0, 6, 200).astype(np.uint64) << np.uint64(30)
    for width in (1, 2, 26, 200):
        assert suffixes.leftmost_minima(x, width).tolist() == [i + int(x[i : i + width].argmin()) for i in range(201 - width)]
    long = np.arange((1 << 24) + 100, dtype=np.uint64)[::-1] << np.uint64(30)
    assert (suffixes.leftmost_minima(long, 3) == np.arange(2, len(long))).all()


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, 400 + k) for k in range(50)]
    forest = C.Forest(500)
    for a, b in pairs:
        forest.join(a, b)
    got = {r.id: r.component_id for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: forest.root(v) for a, b in pairs if a != b for v in (a, b)}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blobs():
    columns = [np.arange(5, dtype="<u8"), np.zeros(0, "<u4"), np.array([-3, 2], "<i8")]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, C.unblob(C.blob(*columns)), strict=True))


# --- 1 packing


def test_best_fit_is_tight():
    rng = random.Random(3)
    lengths = [rng.randint(1, 64) for _ in range(300)]
    number, offset = packing.best_fit_decreasing(lengths, 64)
    free: dict[int, int] = {}
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        fits = [c for c in free.values() if c >= lengths[i]]
        if fits:
            assert free[number[i]] == min(fits)
        else:
            assert number[i] not in free
        free[number[i]] = free.get(number[i], 64) - lengths[i]
    for w in free:
        own = sorted((offset[i], lengths[i]) for i in range(300) if number[i] == w)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_packing(spark, texts):
    ids = [*range(len(texts) - 2), None, 3]
    rows = packing.pack(documents(spark, texts, ids), docs_per_group=30).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for i, text in zip(ids, texts, strict=True):
        x = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(x), 2048):
            wanted[(i, a, len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes()), len(x))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert sum(r.length for r in rows) > 0.9 * 2048 * (len(by) - 3)
    assert packing.pack(documents(spark, [])).count() == 0


# --- 2 quality


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string").drop("text")


def test_quality(spark):
    rng = random.Random(5)
    good = [f"{words(rng, 30).capitalize()}. {words(rng, 30)}." for _ in range(120)]
    bad = [" | ".join(f"w{rng.randrange(99)}" for _ in range(40)) for _ in range(60)] + ["WORD!! " * 50] * 20
    texts = [None, "", *good, *bad]
    marks = [(i, int(2 <= i < 122), 0, "x") for i in range(2, len(texts))] + [(None, 1, 0, "x"), (5, None, 0, "x")]
    d = documents(spark, texts)
    out = {r.doc_id: r for r in quality.score(d, labels(spark, marks)).collect()}
    assert len(out) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert np.mean([out[i].predicted == (i < 122) for i in range(2, len(texts)) if out[i].held_out]) > 0.95
    kept = quality.keep_good(d, labels(spark, marks))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}
    assert quality.score(documents(spark, []), labels(spark, marks)).count() == 0
    assert {r.predicted for r in quality.score(d, labels(spark, [])).collect()} == {1}


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    w = quality.bradley_terry(x, (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int))
    assert w[0] > w[1] > abs(w[2])


# --- 3 passages


def removed(pairs, k=50):
    first: dict[bytes, int] = {}
    for i, t in sorted(pairs, key=lambda p: p[0]):
        for p in range(len(t) - k + 1):
            first.setdefault(t[p : p + k], i)
    for i, t in pairs:
        gone = [False] * len(t)
        for p in range(len(t) - k + 1):
            if first[t[p : p + k]] < i:
                gone[p : p + k] = [True] * k
        yield i, t, gone


def test_passages(spark, texts):
    ids = [*range(len(texts) - 1), 3]
    raw = [(i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)]
    wanted = Counter()
    for i, t, gone in removed(raw):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        wanted[(i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())] += 1
    d = documents(spark, texts, ids)
    assert Counter(tuple(r) for r in passages.dedup(d, digests=True).collect()) == wanted
    out = passages.drop_passages(d)
    assert out.columns == d.columns and out.count() == len(texts) and out.where("text is null").count() == 1
    assert passages.dedup(documents(spark, []), digests=True).count() == 0


def test_passages_of_periodic_texts(spark):
    texts = ["ab" * 80, "x" + "ab" * 40, "ba" * 30 + "c" * 70, "c" * 49, "c" * 50, "z" + "c" * 50 + "é" * 60, "é" * 40]
    got = {r.doc_id: r.n_removed for r in passages.dedup(documents(spark, texts), digests=True).collect()}
    assert got == {i: sum(gone) for i, _, gone in removed([(i, t.encode()) for i, t in enumerate(texts)])}


def test_null_ids_come_last(spark):
    t = words(random.Random(8), 40)
    got = Counter((r.doc_id, r.n_removed > 0) for r in passages.dedup(documents(spark, [t, t, t], [None, 9, 7]), digests=True).collect())
    assert got == Counter({(None, True): 1, (9, True): 1, (7, False): 1})


def test_passages_of_one_id_go_from_their_own_text(spark):
    """The passage stands at one place of one text of the id; the other texts of the id have other bytes there."""
    rng = random.Random(15)
    shared = words(rng, 40)
    lead = words(rng, 30)[:120]
    texts, ids = [words(rng, 20) + shared], [1]
    for i in (5, None):
        texts += [lead[::-1] + shared + words(rng, 25), words(rng, 150), words(rng, 4)]
        ids += [i] * 3
    out = [(r.doc_id, r.text) for r in passages.drop_passages(documents(spark, texts, ids)).collect()]
    for i, t in zip(ids, texts, strict=True):
        if shared not in t or i == 1:
            assert (i, t) in out
    assert all(t not in [x for _, x in out] for i, t in zip(ids, texts, strict=True) if shared in t and i != 1)


# --- 4 byte-level BPE


def test_bpe(spark, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [*range(len(texts) - 2), None, 3]
    d = documents(spark, texts, ids)
    wanted = Counter()
    for i, t in zip(ids, texts, strict=True):
        x = e.encode_ordinary(t or "")
        wanted[(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.encode_decode(d, digests=True).collect()) == wanted
    rows = {r.doc_id: r for r in bpe.encode_decode(d.where("doc_id = 0")).collect()}
    assert rows[0].ids == e.encode_ordinary(texts[0]) and bytes(rows[0].decoded).decode() == texts[0]
    back = bpe.decode(spark.createDataFrame([(0, rows[0].ids), (1, []), (2, None)], "doc_id long, ids array<int>"))
    assert {r.doc_id: r.text for r in back.collect()} == {0: texts[0], 1: "", 2: None}
    assert bpe.encode_decode(documents(spark, []), digests=True).count() == 0


# --- 5 language


def test_gradients_by_differences():
    net = language.BiGru(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = language.padded([b"abc", b"zz", b"a longer sequence of steps"])
    y = np.array([0, 1, 2])
    _, g = net.gradients(x, mask, y)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, loss = net.p[k][at], []
        for e in (1e-4, -1e-4):
            net.p[k][at] = old + e
            loss.append(net.gradients(x, mask, y)[0])
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=2e-2)


def test_every_position_is_labelled_with_its_neighbours(monkeypatch):
    """Segments side by side with run-ins, against one run through each text, or through each segment and its run-in."""
    net, rng = language.BiGru(3, hidden=5), random.Random(3)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5, 39, 40, 41, 400)]

    def run(raw):
        x, mask = language.padded([raw])
        both = np.concatenate([net._run("f", x, mask)[0], net._run("b", x, mask)[0]], 2)
        return language._softmax(both @ net.p["out"] + net.p["bias"])[:, 0]

    for segment, run_in in ((1000, 10), (40, 10)):
        monkeypatch.setattr(language, "SEGMENT", segment)
        monkeypatch.setattr(language, "RUN_IN", run_in)
        monkeypatch.setattr(language, "POSITIONS", 130)
        got = net.score(texts)
        assert not got[0].any()
        for k, t in enumerate(texts[1:], 1):
            parts = [run(t[max(0, a - run_in) : a + segment + run_in])[min(a, run_in) :][:segment] for a in range(0, len(t), segment)]
            assert sum(map(len, parts)) == len(t) and np.allclose(got[k], np.concatenate(parts).mean(0), atol=1e-5)


def test_language(spark):
    rng = random.Random(6)
    parts = {"aa": ["the", "ing", "wh"], "bb": ["ção", "lh", "ões"], "cc": ["sch", "ung", "ö"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(20)), lang, 1))
    rows += [(900, None, "aa", 1), (901, "", "aa", 1), (902, "12 34 !!", "bb", 1), (903, "the ingwh", None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, k long")
    out = {r.doc_id: r for r in language.predict(d, docs_per_lang=60).collect()}
    assert np.mean([out[i].lang_pred == rows[i][2] for i in range(240) if out[i].held_out]) > 0.97
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language.predict(d.where("false")).count() == 0
    assert {r.lang_pred for r in language.predict(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- 6 n-gram join


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(ids, sets):
    forest = C.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                forest.join(i, j)
    low: dict[int, int] = {}
    for i in range(len(sets)):
        if ids[i] is not None:
            low[forest.root(i)] = min(low.get(forest.root(i), 1 << 62), ids[i])
    return [low.get(forest.root(i)) for i in range(len(sets))]


def near_group(rng, n):
    base = [f"b{k}" for k in range(60)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_ngrams(spark, texts):
    all_texts = texts + near_group(random.Random(9), 60)
    ids = [*range(len(all_texts) - 2), None, 3]
    d = documents(spark, all_texts, ids)
    sets = [shingle_set(t) for t in all_texts]
    wanted = Counter(zip(ids, map(len, sets), brute_components(ids, sets), strict=True))
    assert Counter(tuple(r) for r in ngrams.link(d).collect()) == wanted
    kept = ngrams.drop_copies(d)
    assert kept.columns == d.columns
    own = {r.doc_id for r in kept.collect()}
    parts = dict(zip(ids, brute_components(ids, sets), strict=True))
    assert all((i in own) == (parts[i] == i) for i in ids if i is not None and i != 3 and shingle_set(all_texts[ids.index(i)]))
    assert ngrams.link(documents(spark, [])).count() == 0


def test_divide_skip_counts_exactly():
    rng = np.random.default_rng(1)
    for _ in range(60):
        q = np.unique(rng.integers(0, 200, rng.integers(1, 60)).astype(np.uint64))
        sets = [q]
        for _ in range(6):
            keep = q[rng.random(len(q)) > rng.random() * 0.4]
            sets.append(np.unique(np.concatenate([keep, rng.integers(200, 400, rng.integers(1, 10)).astype(np.uint64)])))
        index = ngrams.Index(np.concatenate(sets), np.array(list(map(len, sets))))
        for i, x in enumerate(sets):
            right = [k for k, y in enumerate(sets) if k != i and 4 * (both := len(np.intersect1d(x, y))) >= 3 * (len(x) + len(y) - both)]
            assert index.search(i) == right


def test_long_lists_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK", 7)
    monkeypatch.setattr(ngrams, "ACROSS", 7)
    monkeypatch.setattr(ngrams, "FAN", 2)
    rng = random.Random(21)
    texts = near_group(rng, 90) + [words(rng, 40) for _ in range(20)]
    sets = [shingle_set(t) for t in texts]
    got = {r.doc_id: r.component_id for r in ngrams.link(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(range(len(texts)), sets)


def test_shingle_sets(texts):
    import pyarrow as pa

    data, offsets = C.text_bytes(pa.array(texts))
    _, sizes = shingles.shingle_sets(data, offsets)
    assert sizes.tolist() == [len(shingle_set(t)) for t in texts]


# --- 7 urls


def test_urls(spark):
    rows = [
        "http://www.example.com/en/1", "https://m.example.com/en/2?x=/es/", "http://Example.COM/en", "http://a.net/es/1#f", "http://a.net/esx", "https://casino-win.example.org/de/1",
        "http://mycasino-win.org/", "http://x.com", "x.com/en/", None, "", "http://a.org/casino/win", "HTTP://sub.ADS-track.info/p", "a://b://c.net/fr/", "http://notexample.net/fr/1",
    ]
    d = spark.createDataFrame([(i, u, "html", "h", 1) for i, u in enumerate(rows)] + [(3, "http://a.net/es/1#f", "html", "h", 1)], "page_id long, url string, html string, host string, row long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(d).collect()}
    assert urls.judge(d).count() == len(rows) + 1
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[1] == ("m.example.com", "/en/2", "example.com/en/", "block")
    assert got[2] == ("example.com", "/en", "com/", "allow") and got[3] == ("a.net", "/es/1", "net/es/", "block") and got[4] == ("a.net", "/esx", None, "allow")
    assert got[5][2:] == (None, "block") and got[6][2:] == (None, "allow") and got[7] == ("x.com", "", None, "allow")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow") and got[11][3] == "allow" and got[12][3] == "block"
    assert got[13] == ("b:", "//c.net/fr/", None, "allow") and got[14][2:] == ("net/fr/", "block")
    assert urls.judge(d.where("false")).count() == 0


@pytest.mark.parametrize("inline", [2000, 10])
def test_hundreds_of_rules(spark, monkeypatch, tmp_path, inline):
    """Rules that share their rare tokens, rules without a token, named and unnamed ones, read from a table."""
    import json

    monkeypatch.setattr(urls, "INLINE_RULES", inline)
    rng = random.Random(31)
    names = [f"{rng.choice('abc')}{k % 40}.{rng.choice(['com', 'net', 'org'])}" for k in range(150)]
    lines = [{"verdict": rng.choice(["allow", "block"]), "rule": f"{h}/{rng.choice(['', 'en/', 'x', 'en/a/'])}"} for h in names]
    lines += [{"verdict": "block", "pattern": rf"/p{k}(?:/|$)", "tokens": [f"p{k}"]} for k in range(100)]
    lines += [{"verdict": "block", "pattern": r"\.exe$"}, {"verdict": "allow", "pattern": "^$", "name": "empty"}]
    (tmp_path / "rules.json").write_text("\n".join(map(json.dumps, lines)))
    rules = urls.read_rules(spark, str(tmp_path / "rules.json"))
    assert len(rules) == len(lines)
    pages = [(k, f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(names)}/{rng.choice(['', 'en/', 'en/a/b', 'x1', f'p{k}', f'q/p{k % 60}/z', 'setup.exe'])}") for k in range(400)] + [(400, None), (401, "no host")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    for i, u in pages:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        fits = [r for r in rules if re.search(r.pattern, rest)]
        named = max(((len(r.name), r.name, r.verdict) for r in fits if r.name), default=None)
        assert got[i] == (named[1:] if named else (None, "block" if any(r.verdict == "block" for r in fits) else "allow"))


def test_no_rules(spark):
    d = spark.createDataFrame([(1, "http://A.net/x?y")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(d, []).collect()] == [(1, "a.net", "/x", None, "allow")]


def test_rarest_token(spark):
    d = spark.createDataFrame([(["ads", "x"],), (["ads"],), (["track"],)], "tokens array<string>")
    index = urls.index_rules(d, [urls.word_rule("block", "ads", "track"), urls.word_rule("block", "none", "x")]).collect()
    assert {r.token for r in index} == {"track", "none"}


# --- 8 embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 32))
    rows, n = [], 0
    for i, v in enumerate(base):
        rows.append((n, v.tolist(), i % 3, 9, 9))
        n += 1
        for _ in range(i % 4 if i < 60 else 0):
            rows.append((n, (v + rng.standard_normal(32) * rng.uniform(0.05, 0.35)).tolist(), i % 3, 9, 9))
            n += 1
    for k in range(80):  # a large group
        rows.append((n, (base[0] + rng.standard_normal(32) * 0.1).tolist(), 0, 9, 9))
        n += 1
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, base[1].tolist(), base[1].tolist(), base[2].tolist(), base[2].tolist()[:31]]
    for k, v in enumerate(odd):
        rows.append((n, v, None if k == 7 else 1, 9, 9))
        n += 1
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cid long, m long").repartition(3)
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) and lab is not None for _, v, lab, *_ in rows]
    links, forest = [0] * n, C.Forest(n)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    forest.join(i, j)
    got = {r.vec_id: r for r in embeddings.near_duplicates(d).collect()}
    assert len(got) == n and all(got[i].n_links <= links[i] for i in range(n))
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links)
    assert np.mean([got[i].component_id == forest.root(i) for i in range(n)]) > 0.99
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert embeddings.near_duplicates(d.where("false")).count() == 0


def test_labels_of_any_type_and_large_components(spark):
    v = [1e200, 2e200, -1e199]
    rows = [(0, v, "x"), (1, [2 * c for c in v], "x"), (2, v, "y"), (3, [1e-200, 2e-200, -1e-201], "x"), (4, v, None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (0, 2), 3: (2, 0), 4: (0, 4)}
    rows = [(i, [1.0, i / 50], 1 << 40) for i in range(3)]
    assert {r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()} == {2}


def test_collisions_are_query_centred():
    rng = np.random.default_rng(8)
    x, q = rng.integers(-9, 9, (50, 6)) / 4, rng.integers(-9, 9, (7, 6)) / 4
    got = embeddings.Projections(x).collisions(q, 0.5)
    assert (got == (np.abs(q[:, None, :] - x[None, :, :]) <= 0.5).sum(2)).all()


def test_two_levels_of_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_DIRECTIONS", 16)
    monkeypatch.setattr(embeddings, "PER_CELL", 4)
    assert embeddings.levels(4 * 16 + 4) == (8, 8) and embeddings.levels(4 * 16) == (16,)
    rng = np.random.default_rng(6)
    rows = [(2 * i + k, (v + k * rng.standard_normal(24) * 0.2).tolist(), 1) for i, v in enumerate(rng.standard_normal((80, 24))) for k in range(2)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    right = ((x @ x.T) >= 0.93).sum() - len(x)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert 0.98 * right <= sum(r.n_links for r in got) <= right and right > 100


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(5)
    v = rng.standard_normal(16)
    rows = [(i, (v + rng.standard_normal(16) * 0.02).tolist(), 1) for i in range(90)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(89, 0)}


# --- 9 lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance(spark):
    rng, pairs = random.Random(7), []
    for _ in range(600):
        a = [rng.choice("abc") for _ in range(rng.randint(5, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b))
            rng.choice([lambda: b.insert(k, "c"), lambda: b.pop(k) if len(b) > 4 else None, lambda: b.__setitem__(k, "a")])()  # noqa: B023
        a, b = sorted(("".join(a), "".join(b)), key=len)
        if len(b) - len(a) <= 2:
            pairs.append((a, b, bytearray(a.encode()), bytearray(b.encode())))
    d = spark.createDataFrame(pairs, "a string, b string, x binary, y binary")
    for r in d.select("a", "b", lines.banded_distance("x", "y", 2).alias("n")).collect():
        assert min(r.n, 3) == min(levenshtein(r.a, r.b), 3)


def test_lines(spark):
    rng = random.Random(8)
    long = [words(rng, rng.randint(6, 20)) for _ in range(25)]
    texts: list = [None, "", " \n\n", "short\nshort", "short"]
    for i in range(30):
        own = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(long))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice("é漢xyz")
            own.append("".join(w))
        texts.append("\n".join(own) + ("\n" if i % 7 == 0 else ""))
    d = documents(spark, texts)
    places = [((i, p), x) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n"))]
    wanted: dict[int, list] = {i: [0, 0, 0, []] for i in range(len(texts))}
    for (i, p), x in places:
        w = wanted[i]
        w[0] += 1
        if not x.strip(" "):
            continue
        earlier = [y for at, y in places if at < (i, p) and y.strip(" ")]
        raw = x.encode()
        if x in earlier:
            w[1] += 1
            w[3].append(p)
        elif len(raw) >= 24 and any(len(y.encode()) >= 24 and abs(len(y.encode()) - len(raw)) <= 2 and levenshtein(raw, y.encode()) <= 2 for y in set(earlier)):
            w[2] += 1
            w[3].append(p)
    got = {r.doc_id: [r.n_lines, r.n_repeated, r.n_near, [int(p) for p in r.removed.split(",") if p]] for r in lines.line_report(d).collect()}
    assert got == wanted and sum(w[2] for w in wanted.values()) > 5
    out = lines.drop_lines(d)
    assert out.columns == d.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    for i, t in enumerate(texts):
        rest = [x for p, x in enumerate((t or "").split("\n")) if p not in wanted[i][3]]
        if wanted[i][3] and not any(x.strip(" ") for x in rest):
            assert i not in kept
        else:
            assert kept[i] == (t if not wanted[i][3] else "\n".join(rest))
    assert lines.line_report(documents(spark, [])).count() == 0


def test_lines_go_from_their_own_row(spark):
    """Rows without an id, or of one id, with different texts: a repeated line at a place takes no other row's line there."""
    own = [f"{chr(97 + k) * 30} first\n{chr(97 + k) * 30} second" for k in range(6)]
    texts = ["common line of the corpus", f"{own[0]}\ncommon line of the corpus", f"{own[1]}\nonly here, third", f"{own[2]}\ncommon line of the corpus", f"{own[3]}\nonly there, third"]
    ids = [1, None, None, 7, 7]
    got = Counter((r.doc_id, r.text) for r in lines.drop_lines(documents(spark, texts, ids)).collect())
    assert got == Counter(zip(ids, [texts[0], own[0], texts[2], own[2], texts[4]], strict=True))
    # Equal lines at equal places of rows without an id: one stays; a document goes only with its own lines.
    texts = [f"{own[0]}\nboth have this", f"{own[1]}\nboth have this", own[4], f"{own[4]}\n{own[5]}"]
    out = [r.text for r in lines.drop_lines(documents(spark, texts, [None] * 4)).collect()]
    every = [x for t in out for x in t.split("\n")]
    assert Counter(every) == Counter({x for t in texts for x in t.split("\n")})


# --- 10 search


def test_search(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 12))
    x[30], x[31] = x[29], x[29]  # ties
    rows = [(i, v.tolist(), 1, 1) for i, v in enumerate(x)]
    rows += [(700, None, 1, 1), (800, [], 1, 1), (900, [float("nan")] * 12, 1, 1), (1000, [None] * 12, 1, 1), (1100, [1.5] * 5, 1, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard long, part long").repartition(3)
    q = {i: np.pad(np.floor(1024 * np.array(v)), (0, 12 - len(v))).astype(int) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all()}
    wanted = set()
    for i in q:
        if i % 100 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:10]
            wanted |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert {tuple(r) for r in search.top_k(d, block=32, part_blocks=2, range_parts=2, chunks_together=1).collect()} == wanted
    assert {tuple(r) for r in search.top_k(d).collect()} == wanted
    assert search.top_k(d.where("vec_id in (100, 5)")).count() == 1
    assert search.top_k(d.where("false")).count() == 0


def test_repeated_ids_are_rows(spark):
    rows = [(100, [1.0, 2.0]), (100, [3.0, -1.0]), (7, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(d).collect())
    k = 1 << 20
    assert got == Counter({(100, 1, 7, 3 * k): 1, (100, 2, 100, k): 2, (100, 1, 7, 2 * k): 1})


def test_huge_products():
    assert search._products(np.array([[1 << 40]]), np.array([[1 << 20]])).tolist() == [[1 << 60]]


def test_search_prunes_blocks():
    """Blocks along different terms: a query along one of them scores only its own blocks."""
    import pyarrow as pa

    rows, n = [], 8
    for b in range(n):
        x = np.full((20, n), 1, np.int64)
        x[:, b] = 1000 + np.arange(20)
        rows.append({"block": b, "part": 0, "ids": list(range(100 * b, 100 * b + 20)), "asks": [False] * 20, "width": n, "rows": search._packed(x), "high": x.max(0).tobytes(), "low": x.min(0).tobytes()})
    part = pa.Table.from_pylist(rows)
    one = np.array([-1])
    q = np.zeros((1, n), np.int64)
    q[0, 3] = 5
    found, scored = search.search_part(search.Asked(one, one, one, np.array([search.NONE]), one, q), part, search.Maxima(part, n), 10, {})
    assert scored == 1 and [r for *_, r, _ in found] == list(range(319, 309, -1))
    # A threshold from elsewhere that no block reaches leaves nothing to score.
    assert search.search_part(search.Asked(one, one, one, np.array([10**6]), one, q), part, search.Maxima(part, n), 10, {}) == ([], 0)


# --- the registry


def test_pipeline(spark):
    import __spark_entry__
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "ngrams", "passages", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = C.checkpointed(stage(spark, docs, sf))
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.select("doc_id").distinct().count() == seen[-1]
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def brute_lines(rows, edits=2, least=24):
    """rows: (id, text), ids without nulls. Texts after line removal; None: the document goes."""
    places = [((i, p), x) for i, t in rows for p, x in enumerate((t or "").split("\n"))]
    seen = [(at, x) for at, x in places if x.strip(" ")]
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, t))
            continue
        kept, some, left = [], False, False
        for p, x in enumerate(t.split("\n")):
            raw = x.encode()
            near = lambda y, raw=raw: len(raw) >= least and len(y) >= least and abs(len(y) - len(raw)) <= edits and levenshtein(raw, y) <= edits
            gone = bool(x.strip(" ")) and any(at < (i, p) and (y == x or near(y.encode())) for at, y in seen)
            some, left = some or bool(x.strip(" ")), left or bool(x.strip(" ")) and not gone
            kept += [] if gone else [x]
        if left or not some:
            out.append((i, "\n".join(kept)))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage of the pipeline on a small table with copies, shared lines and passages, odd and empty texts, against plain Python."""
    import corpus_pipeline

    rng = random.Random(41)
    vocabulary = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("lor", "men", "nis", "pta", "rum", "ses", "tiv", "vox")]
    say = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(n)).capitalize() + "."
    good = ["\n".join(say(rng.randint(8, 14)) for _ in range(rng.randint(2, 5))) for _ in range(45)]
    shared, passage = say(9), say(30)
    good[3] += "\n" + shared
    good[9] += "\n" + shared[:-3] + "xy."
    good[12] = good[12][:-1] + " " + passage
    good[20] = good[20][:-1] + " " + passage + " " + say(5)
    good[25] = say(60)
    near = good[25].split(" ")
    near[4] = "otherwise"
    good += [good[7], " ".join(near), None, "", "  ", "é漢 " * 30]
    bad = ["$$ | ## !! " * rng.randint(4, 30) for _ in range(25)]
    texts = [t for pair in zip(good, bad + [None] * len(good), strict=False) for t in pair][: 2 * len(bad)] + good[len(bad) :]
    marks = [(i, int(t in good), 0) for i, t in enumerate(texts) if t]
    d = documents(spark, texts)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score(d, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    rows = [(i, t) for i, t in enumerate(texts) if scores[i] >= 0.7]
    assert 40 < len(rows) < len(texts) - 15
    steps = [rows, rows := brute_lines(rows)]
    ids, sets = [i for i, _ in rows], [shingle_set(t) for _, t in rows]
    rows = [r for r, part, s in zip(rows, brute_components(ids, sets), sets, strict=True) if part == r[0] or not s]
    steps.append(rows)
    rows = [(i, None if t is None else bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")) for (i, t), (_, raw, gone) in zip(rows, removed([(i, (t or "").encode()) for i, t in rows]), strict=True)]
    steps.append(rows)
    assert all(a != b for a, b in zip(steps, steps[1:], strict=False))
    got, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    for (_, stage), wanted in zip(corpus_pipeline.STAGES, steps, strict=False):
        got = C.checkpointed(stage(spark, got, sf))
        assert sorted((r.doc_id, r.text is None, r.text or "") for r in got.collect()) == sorted((i, t is None, t or "") for i, t in wanted)
        assert all(r.n_chars == (0 if r.text is None else len(r.text)) for r in got.collect())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in rows}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == tokens and sum(r.length for r in packed) == sum(tokens.values())


ODD = [(1, None), (1, None), (None, "no id, first line of it\nsecond"), (None, "no id, first line of it\nsecond"), (None, None), (5, ""), (5, "x"), (6, "same text here of some words"), (7, "same text here of some words"), (7, "same text here of some words")]


@pytest.mark.parametrize("kind", ["empty", "odd", "long"])
def test_stages_and_operators_on_odd_tables(spark, kind):
    """Empty tables; null ids and texts, repeated rows and ids; a very long text. Row operators keep every row, stages the columns."""
    rng = random.Random(17)
    rows = {"empty": [], "odd": ODD, "long": [(1, words(rng, 60_000, 9000)), (2, "The short one. " * 3), (3, "y" * 300_000)]}[kind]
    d = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    marks = labels(spark, [(1, 1, 0, "x"), (2, 0, 0, "x"), (5, None, 0, "x"), (None, 1, 0, "x"), (7, 1, 1, "x"), (7, 0, 1, "x")])
    every = Counter(i for i, _ in rows)
    for out in (quality.score(d, marks), language.predict(d), passages.dedup(d, digests=True), bpe.encode_decode(d, digests=True), ngrams.link(d)):
        assert Counter(r.doc_id for r in out.collect()) == every
    assert {r.doc_id for r in packing.pack(d).collect()} == set(every) and {r.doc_id for r in lines.line_report(d).collect()} == set(every)
    for stage in (lambda x: quality.keep_good(x, marks), lines.drop_lines, ngrams.drop_copies, passages.drop_passages):
        out = stage(d)
        assert out.columns == d.columns and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
        assert not Counter(r.doc_id for r in out.collect()) - every
    if kind == "odd":
        assert Counter((r.doc_id, r.text) for r in lines.drop_lines(d).collect()) == Counter([(1, None)] * 2 + [(None, ODD[2][1])] * 2 + [(None, None), (5, ""), (5, "x"), (6, ODD[7][1])])
        assert Counter((r.doc_id, r.text) for r in ngrams.drop_copies(d).collect()) == Counter([(1, None), (None, ODD[2][1]), (None, None), (5, ""), (5, "x"), (6, ODD[7][1])])
    if kind == "long":
        assert {r.doc_id: r.lang_pred for r in language.predict(d).collect()}.keys() == {1, 2, 3}
        p = spark.createDataFrame([(1, "http://a.com/" + "x/" * 60_000 + "?q"), (2, "http://" + "b." * 40_000 + "net/es/")], "page_id long, url string")
        assert {r.page_id: (len(r.path), r.rule) for r in urls.judge(p).collect()} == {1: (120_001, "com/"), 2: (4, "net/es/")}


def test_features_are_what_they_say():
    """The classifier's features by plain loops."""
    import pyarrow as pa

    texts = ["", "a", "Ab cd. ef!\nGh gh gh (x)", "  \t", "é漢 1,2 x_y x_y", "A " * 50]
    data, offsets = C.text_bytes(pa.array(texts))
    got = quality.text_features(data, offsets)
    table = quality.byte_classes()
    for t, row in zip(texts, got, strict=True):
        raw = t.encode()
        counts = np.bincount(table[list(raw)], minlength=quality.N_CLASSES) if raw else np.zeros(quality.N_CLASSES)
        w, n = re.findall(rb"[^\n\t\r\v\f ]+", raw), max(1, len(re.findall(rb"[^\n\t\r\v\f ]+", raw)))
        symbol = lambda c: 5 <= table[c] < quality.LOWER
        wanted = [
            np.log1p(len(raw)), (len(raw) - counts[:3].sum()) / n, sum(65 <= x[0] <= 90 for x in w) / n, sum(symbol(x[-1]) for x in w) / n,
            sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, sum(a == b for a, b in zip(w, w[2:], strict=False)) / n,
        ]
        assert np.allclose(row[: quality.N_CLASSES], np.sqrt(counts / max(1, len(raw)))) and np.allclose(row[quality.N_CLASSES :], wanted)


@pytest.mark.parametrize("name", ["op7_urls", "op9_lines", "op10_search"])
def test_sql(spark, name):
    import duckdb

    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf)
    cols = sorted(df.columns)
    theirs = con.sql(__spark_entry__.oracle_sql()[name])
    at = [theirs.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall())
