"""Training-data operators on small fixtures: brute force, round trips, and odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import audio_features, chat_format, class_lm, common, exact_dedup, line_dedup, mixing, ngram_join, packing, quality_mil, queries, url_filter
from quantloom.sources import sinks

DOCS = "doc_id long, text string, source string, extra string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([3, 30, 80]))]
        rows.append((k, " ".join(text), rng.choice(["a", "b", None]), "x"))
        if k % 3 == 0:
            near = list(text)
            near[-1] = "changed"
            rows.append((100 + k, " ".join(near), "a", "y"))
        if k % 5 == 0:
            rows.append((200 + k, "  ".join(text).upper(), "b", None))
    rows += [(300, None, None, None), (301, "", "a", ""), (302, " \n\t", "a", ""), (303, "one", "a", ""), (0, rows[0][1], "a", "again"), (304, "long " * 30000, "b", "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return [w.encode().lower() for w in re.findall(common.WORD_PATTERN, text or "")]


def test_word_hashes_match_words():
    texts = ["", None, " Ab c\td\n", "ab", "É é", "x" * 3_000_000 + " y"]
    hashes, first = common.hashed_words(pa.array(texts))
    assert np.diff(first).tolist() == [len(words_of(t)) for t in texts]
    assert len(set(hashes.tolist())) == len({w for t in texts for w in words_of(t)})


def test_ngram_components_by_brute_force(spark, docs):
    rule = ngram_join.Similarity(4, 85)
    sets = {}
    for r in docs.collect():
        w = words_of(r["text"])
        sets[r["doc_id"]] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    least = {k: k for k in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    least[a] = least[b] = min(least[a], least[b])
    for r in ngram_join.ngram_components(docs, rule).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), least[r["doc_id"]])
    assert ngram_join.keep_one(docs, rule).count() == len(set(least.values()))


def test_empty_tables(empty):
    assert ngram_join.ngram_components(empty, queries.NEAR).count() == 0
    assert line_dedup.line_dedup(empty).count() == exact_dedup.annotate(empty).count() == mixing.mix(empty).count() == packing.pack(empty).count() == 0
    assert audio_features.media_digests(empty).count() == class_lm.class_lm(empty).count() == 0
    labels = empty.select("doc_id", F.lit(1).alias("quality"))
    assert quality_mil.score(empty, quality_mil.fit(empty, labels)).count() == 0


def test_line_dedup_keeps_largest_id(spark):
    line = "A line that is certainly longer than forty characters."
    rows = [(k, f"own {k}\n {line.upper() if k % 2 else line}\t\nend") for k in range(6)] + [(9, None), (10, "")]
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["text"] == "own 0\nend" and out[0]["n_dropped"] == 1 and out[5]["n_dropped"] == 0 and out[9]["n_lines"] == 1


def test_exact_dedup_winner(docs):
    out = exact_dedup.annotate(docs).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["text_sha256"], []).append(r)
    assert len(out) == docs.count()
    for rows in groups.values():
        assert sum(r["kept"] for r in rows) == 1 and {r["group_size"] for r in rows} == {len(rows)} and len({r["keep_id"] for r in rows}) == 1
    assert {r["keep_id"] for r in out if r["doc_id"] == 301} == {302}


@pytest.mark.parametrize("text", ["", "\\", "\\m<|", "<|end|>\n<|turn|>x\ny", "a\\s\\\\m<", None])
def test_chat_round_trip(spark, text):
    turns = spark.createDataFrame([(1, 0, "us\ner<|", text), (1, 1, "assistant", text), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    r = chat_format.read_back(chat_format.chat_format(turns)).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("us\ner<|", text or ""), ("assistant", (text or "") + "\nb")]
    assert r["learnt"] == [text or "", "b"]


def test_packing_boundaries_are_optimal_and_batches_fit(docs):
    rng = random.Random(1)
    hist = [(v, rng.randint(1, 9)) for v in sorted(rng.sample(range(100), 9))]

    def cost(ends):
        return sum((min(e for e in ends if e >= v) - v) * k for v, k in hist)

    from itertools import combinations

    for b in (1, 2, 3, 4):
        best = min(cost((*x, hist[-1][0])) for x in combinations([v for v, _ in hist[:-1]], b - 1))
        assert cost(packing.boundaries(hist, b)) == best
    rows = packing.pack(docs, 4, 500).collect()
    seen = {(r["bucket"], r["batch"], r["slot"]) for r in rows}
    assert len(seen) == len(rows) == docs.count()
    assert all((r["slot"] + 1) * r["bucket_length"] <= 500 or r["slot"] == 0 for r in rows)


def test_mix_targets(docs):
    out = mixing.plan_mix(docs).collect()
    words = sum(r["size"] for r in out)
    assert sum({r["source"]: r["target"] for r in out}.values()) == pytest.approx(1.5 * words, rel=1e-6)
    assert all(0 <= r["n_copies"] <= 2 and r["target"] <= 2 * r["source_size"] + 1e-6 for r in out)


def test_url_rules(spark):
    urls = [None, "no host", "http://NET/x", "https://a.example.net/en/1?q", "https://a.example.net/e", "http://x.example.com/de/#a", "http://org/fr/", "http://adult-x.example.com/q", "http://fine.example.org"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, queries.url_listing(spark)).collect()}
    assert [got[k] for k in range(9)] == [(None, "allow"), (None, "allow"), ("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "block"), (None, "allow")]


def test_audio_round_trip_and_features():
    payload, n = audio_features.payload_of("é" * 100)
    assert n == 200 and len(payload) == 384
    assert audio_features.from_wav(audio_features.to_wav(payload)) == (payload, 48_000)
    tone = (128 + 90 * np.sin(2 * np.pi * 1000 * np.arange(48_000) / 48_000)).astype(np.uint8)
    x = audio_features.resample((tone.astype(np.float32) - 128) / 128, 1, 3)
    assert len(x) == 16_000 and np.abs(np.fft.rfft(x[2000:10000])).argmax() == 500
    tensor, spans, _ = audio_features.features(audio_features.to_wav(tone.tobytes()))
    back, spans2 = audio_features.from_tensors(audio_features.to_tensors(tensor, spans))
    assert np.array_equal(back, tensor) and np.array_equal(spans, spans2)
    assert audio_features.segments(np.array([0, 1, 0.5, 0.3, 0, 1.0])).tolist() == [[1, 3], [5, 6]]


def test_class_lm_counts_by_brute_force(docs):
    rows = {}
    for r in docs.collect():
        rows.setdefault(r["doc_id"], []).append([*words_of(r["text"]), b"\0end"])
    import zlib
    from collections import Counter
    from math import log10

    train = Counter(t for k, all_ in rows.items() if zlib.crc32(str(k).encode()) % 7 != 2 for ts in all_ for t in ts)
    n, v = sum(train.values()), len(train)
    for r in class_lm.class_lm(docs).collect():
        ts = rows[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(train[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(log10((train[t] + 1) / (n + v + 1)) for t in ts))
        assert r["score"] < 0


def test_packing_bucket_is_as_long_as_its_longest_text(spark):
    rows = [(0, "w " * 4097), (1, "w " * 5001), (2, "w " * 3), (3, None)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3).collect()
    longest = {b: max(r["n_tokens"] for r in out if r["bucket"] == b) for b in {r["bucket"] for r in out}}
    assert len(out) == 4 and all(r["bucket_length"] == longest[r["bucket"]] for r in out)


def test_class_lm_gains_by_brute_force():
    rng = np.random.default_rng(3)
    pairs, own = rng.integers(0, 4, (30, 30)), rng.integers(0, 5, 30)
    pairs[rng.random((30, 30)) < 0.6] = 0
    joint = lambda own: np.array([[pairs[np.ix_(own == a, own == b)].sum() for b in range(5)] for a in range(5)], float)
    cells = lambda m: (np.nonzero(m)[0], np.nonzero(m)[1], m[np.nonzero(m)])
    others = pairs - np.diag(np.diagonal(pairs))
    beside = lambda m: cells(np.stack([m[:, own == k].sum(1) for k in range(5)], 1))
    got = class_lm.gains(joint(own), own, beside(others.T), beside(others), np.diagonal(pairs).astype(float))
    for w in range(30):
        want = [class_lm.information(joint(np.where(np.arange(30) == w, k, own))) for k in range(5)]
        assert np.allclose(got[w] - got[w, 0], np.array(want) - want[0])


def test_class_lm_places_every_word_by_exchange(spark, monkeypatch):
    # Two kinds of words follow each other; only the 10 most frequent are in the core, and the held lexicon is small.
    rng = random.Random(5)
    odd, even = [f"o{k}" for k in range(60)], [f"e{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(even if j % 2 else odd) for j in range(120))) for k in range(80)] + [(1000, "o1 once e2")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    monkeypatch.setattr(class_lm, "CORE", 10)
    for lexicon in (30, 1 << 19):
        monkeypatch.setattr(class_lm, "LEXICON", lexicon)
        model = class_lm.fit(d.select("text"))
        k = {r["word"]: r["k"] for r in model["classes"].collect()}
        assert len(k) == model["V"] == 122 and all(0 <= x <= class_lm.CLASSES for x in k.values())
        name = lambda w: int(common.hashed_words(pa.array([w]))[0].view(np.int64)[0])
        assert not {k[name(w)] for w in odd} & {k[name(w)] for w in even}
        found.append((k, {r["doc_id"]: r["score"] for r in class_lm.score(d, model).collect()}))
    assert found[0][0] == found[1][0] and found[0][1] == pytest.approx(found[1][1])


def test_classifier_learns_from_every_passage(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_mil, "train", lambda x, bags, y: seen.append(np.diff(bags).tolist()))
    rows = [(k, "word " * 10000 if k % 2 == 0 else "few words", k // 2 % 2) for k in range(16)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    quality_mil.fit(d.select("doc_id", "text"), d.select("doc_id", "quality"))
    whole = len(quality_mil.passage_features(pa.array([rows[0][1]]))[0])
    assert whole > 32 and set(seen[0]) == {1, whole}


def test_classifier_separates_shouting(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for k in range(200):
        good = k % 2
        text = " ".join(word() if good else word().upper() + "!!" for _ in range(150))
        rows.append((k, text))
        labels.append((k, good))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality_mil.score(d, quality_mil.fit(d, lab)).where("held_out").collect()
    assert out and all(r["predicted"] == r["doc_id"] % 2 for r in out)


def test_word_hashes_have_no_structure():
    # Words that a polynomial modulo a power of two cannot tell apart.
    words = []
    for k in range(10, 14):
        word = "a"
        while len(word) < 1 << k:
            word += word.translate(str.maketrans("ab", "ba"))
        words += [word, word.translate(str.maketrans("ab", "ba"))]
    assert len(set(common.hashed_words(pa.array(words))[0].tolist())) == len(words)
    hashes = common.hashed_words(pa.array([" ".join(["q" * 70, "x" * 3_000_000, "y", "q" * 70]), "Q" * 70]))[0]
    assert len(set(hashes.tolist())) == 3 and hashes[0] == hashes[3] == hashes[4]


def test_ngram_join_tells_structured_texts_apart(spark):
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(word)), (2, " ".join(word.translate(str.maketrans("ab", "ba"))) + " c c"), (3, word), (4, word.translate(str.maketrans("ab", "ba")))]
    out = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), queries.NEAR).collect()
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] > 2} == {3: 3, 4: 4}


def test_classes_that_share_a_name_are_told_apart(spark):
    # Names of one bit, so that nearly all sets clash.
    rule = ngram_join.Similarity(4, 85, name_bits=1)
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(40))) for k in range(20)]
    rows += [(100 + k, t + " more") for k, t in rows[:5]] + [(200, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    marked = d.select("doc_id", "text", ngram_join.row_mark("doc_id", "text").alias("mark"))
    named, _, clashes = ngram_join.counted_rows(marked, rule)
    assert clashes == {0, 1}
    grams = ngram_join.shingles(pa.array([t for _, t in rows]), 4)
    want = [ngram_join.both_sums(ngram_join.set_sum(x, ngram_join._FIRST, 1), ngram_join.set_sum(x, ngram_join._SECOND)) for x in grams]
    assert {r["doc_id"]: r["class_key"] for r in named.collect()} == {k: w for (k, _), w in zip(rows, want, strict=True)} and len(set(want)) == 25
    got = [{r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(d, r).collect()} for r in (rule, queries.NEAR)]
    assert got[0] == got[1] and got[0][100] == got[0][200] == 0


def test_blocks_of_a_family_are_checked_until_connected(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    rows = []
    for family in range(3):
        base = [word() for _ in range(120)]
        for k in range(60):
            text = list(base)
            text[k] = word()
            rows.append((family * 1000 + k, " ".join(text + [word() for _ in range(k % 7)])))
    # Texts made of the same hot n-grams as a family, and similar to none.
    rows += [(5000 + k, " ".join(rows[0][1].split()[k : k + 40])) for k in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(x.tolist()) for x in ngram_join.shingles(pa.array([t for _, t in rows]), 4)]
    least = list(range(len(rows)))
    for _ in range(20):
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 85 * len(x | y):
                    least[i] = least[j] = min(least[i], least[j])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(d, ngram_join.Similarity(4, 85, hot=8)).collect()}
    assert got == {rows[k][0]: rows[least[k]][0] for k in range(len(rows))}


def test_keep_one_judges_rows_of_one_id_by_their_texts(spark):
    a, b, e = (" ".join(f"{x}{k}" for k in range(30)) for x in "abe")
    rows = [(1, a, "x"), (1, b, "x"), (2, e, "x"), (3, a + " z", "x"), (4, b + " z", "x"), (1, a, "y"), (None, a, "x"), (5, "", "x"), (5, "", "x")]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, mark string"), ngram_join.Similarity()).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (2, e), (None, a), (5, ""), (5, "")], key=str)


def test_packing_is_optimal_for_long_texts(spark):
    from itertools import combinations

    rng = random.Random(6)
    lengths = [4097, 4097, 4099, 5003, 8191, 8193, 16385, 16385, 3, 0]
    rows = [(k, "w " * n) for k, n in enumerate(lengths)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=4).collect()
    kinds = sorted(set(lengths))
    cost = lambda ends: sum(min(e for e in ends if e >= n) - n for n in lengths)
    best = min(cost((*x, kinds[-1])) for x in combinations(kinds[:-1], 3))
    assert sum(r["bucket_length"] - r["n_tokens"] for r in out) == best
    assert {r["bucket_length"] for r in out} <= set(lengths) and len(out) == len(rows) and rng


def test_canonical_urls():
    at = lambda url: url_filter.asked(url, {})[0].split(" ", 2)[2]
    assert at("HTTP://User@WWW.Example.com:80/a/./b/../c%7e%2f?utm_source=x&b=%c3#frag") == "www.example.com/a/c~%2F?b=%C3"
    assert at("https://example.com.") == "example.com/" and at("https://e.org:8443/..") == "e.org:8443/"
    assert at("https://e.org/a/..") == "e.org/" and at("http://e.org/a/.") == "e.org/a/" and at("x://e.org?gclid=1") == "e.org/"


def test_url_filter_by_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "org", "é.org", "A.Com:80", "u@a.com"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xy", "/%78", "/x/../x", "//"]
    rows = [("a.com", "/x", "block", "prefix", True), ("b.a.com", "/x", "allow", "prefix", True), ("org", "", "block", "prefix", False), ("com", "/x", "allow", "prefix", True), ("com", "/x", "block", "prefix", True)]
    rows += [("a.com", "/x", "block", "exact", False), ("B.A.COM", "/x/./y?utm_a=1&q=2", "block", "exact", False), ("xa.com", "/xy", "allow", "exact", False)]
    rows += [(f"h{k}.net", "/", "block", "exact", False) for k in range(3000)]
    urls = [f"{s}://{h}{p}{t}" for s in ("http", "HTTPS") for h in hosts for p in paths for t in ("", "?q=2", "#f", "?utm_x=1")] + [None, "", "://", "a.com/x", "http://h7.net", "http://h7.net/#a", "http://h3001.net"]
    rng.shuffle(urls)
    listing = spark.createDataFrame(rows, "host string, path string, action string, kind string, named boolean")
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls + urls[:9])], "page_id long, url string, rule string")

    def judged(url):
        _, mark, rest = (url or "").partition("://")
        host, path, query = re.match(r"([^/?#]*)([^?#]*)(\?[^#]*)?", rest).groups("") if mark else ("", "", "")
        scheme, low = (url or "").partition("://")[0], "".join(x.lower() if x.isascii() else x for x in host)
        if not host:
            return "", "", None, "allow"
        fits = [(len(h + p), h + p, a == "allow", a, n) for h, p, a, k, n in rows if k == "prefix" and (low == h or low.endswith("." + h)) and path.startswith(p)]
        whole = url_filter.canonical(scheme, host, path, query)
        fits += [(len("".join(whole)), "".join(whole), a == "allow", a, n) for h, p, a, k, n in rows if k == "exact" and url_filter.canonical("", h, p.partition("?")[0], "?" + p.partition("?")[2]) == whole]
        named = [x[:4] for x in fits if x[4]]
        if named:
            return low, path, max(named)[1], max(named)[3]
        return low, path, None, "block" if any(x[3] == "block" for x in fits) else "allow"

    for parts in (64 << 20, 2000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(url_filter, "FILTER_BYTES", parts)
            got = url_filter.url_filter(pages, listing).collect()
        assert len(got) == len(urls) + 9
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"]), r["url"]
    assert url_filter.url_filter(pages.limit(0), listing).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(pages, listing.limit(0)).collect()} == {"allow"}


def test_very_long_urls_take_linear_time():
    import time

    began = time.time()
    url = "http://" + "a." * 16_000 + "net" + "/x" * 16_000 + "/.." * 16_000 + "?" + "q=1&" * 16_000
    assert len(url_filter.asked(url, {3: [0, 1]})) == 3
    assert time.time() - began < 1


def test_heavy_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_KEYS", 3)
    rows = spark.createDataFrame([("hot", k) for k in range(50)] + [(f"k{k % 10}", k) for k in range(30)] + [("none", 1)], "key string, x long")
    facts = rows.where("key <> 'none'").groupBy("key").agg(F.count("*").alias("times"), F.max("x").alias("most"))
    got = common.heavy_join(rows, facts, "key", "times")
    assert got.count() == 80 and got.columns == ["key", "x", "most"] and got.where("key = 'hot' and most = 49").count() == 50


def test_line_dedup_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_KEYS", 2)
    rng = random.Random(7)
    pool = [f"{k} shared line that is longer than forty characters in all" for k in range(12)]
    rows = []
    for k in range(80):
        lines = [rng.choice(["short", "", f"own line {k} " * 5, f"\t {rng.choice(pool).upper()} ", rng.choice(pool)]) for _ in range(rng.randint(0, 12))]
        rows.append((k % 70, "\n".join(lines), "x"))
    rows += [(None, pool[0], "x"), (3, None, "x"), (500, "\n".join([pool[1]] * 3 + ["a"] * 20_000), "x")]
    strip = lambda x: x.strip(common.WHITESPACE).lower()
    holders = {}
    for k, text, _ in rows:
        for line in (text or "").split("\n"):
            if k is not None and len(strip(line)) >= 40:
                holders.setdefault(strip(line), set()).add(k)
    want = []
    for k, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(strip(x), ())) < 5 or max(holders[strip(x)]) == k]
        want.append((k, "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"])) for r in got)


def test_exact_dedup_keeps_one_row_of_each_text(docs):
    kept = exact_dedup.exact_dedup(docs).collect()
    key = lambda r: re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "")
    assert len(kept) == len({key(r) for r in kept}) == len({key(r) for r in docs.collect()})
    assert set(kept[0].asDict()) == set(docs.columns)


def test_mix_targets_by_brute_force(spark):
    rng = random.Random(11)
    rows = [(k, rng.choice([None, "", "a", "B", "é", "zz", "one"]), "w " * rng.choice([0, 3, 50])) for k in range(120)] + [(900, "tiny", "w"), (901, "void", "")]
    out = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * sizes[s] <= weight[s] * share}
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    assert all(r["target"] == pytest.approx(target[r["source"]], abs=1e-5) and r["source_size"] == sizes[r["source"]] for r in out) and len(out) == len(rows)


def test_media_digests_by_hand(spark, docs):
    import hashlib
    import zlib

    texts = [None, "", "é" * 95, "é" * 96, "x" * 192, "x" * 193, "\0\x7f" * 70_000]
    d = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)] + [(90, "é" * 95, "m")], "doc_id long, text string, media string")
    media = audio_features.stored_media(d)
    featured = audio_features.audio_features(media)
    rows = {r["doc_id"]: r for r in audio_features.digests_of(featured).collect()}
    assert {r["doc_id"]: r for r in audio_features.media_digests(d).collect()} == rows
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        wav = audio_features.to_wav(payload)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(wav))
        assert (r["payload_sha256"], r["media_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(wav).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[2]["feature"] == rows[90]["feature"]
    for r in featured.collect():
        tensor, spans = audio_features.from_tensors(r["tensors"])
        assert tensor.shape[1:] == (audio_features.CHUNK, audio_features.MELS) and len(tensor) == len(spans)
        want = [sum(s["end_s"] - s["start_s"] for s in r["segments"])]
        assert rows[r["doc_id"]]["feature"].endswith(f"active={want[0]:.3f}")


def test_audio_blocks_equal_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, 200_000).astype(np.uint8)
    for up, down in ((1, 3), (3, 2), (1, 1), (160, 441)):
        whole = audio_features.resample(samples, up, down)
        parts = [audio_features.resample(samples, up, down, k, min(7001, len(whole) - k)) for k in range(0, len(whole), 7001)]
        assert np.allclose(np.concatenate(parts), whole, atol=1e-5)
    want = audio_features.log_mel(samples, 48_000)
    monkeypatch.setattr(audio_features, "BLOCK_FRAMES", 37)
    assert np.allclose(audio_features.log_mel(samples, 48_000), want, atol=1e-4)
    # Against the definition: filter, window, spectrum and mel bands of one frame.
    x = audio_features.resample(samples, 1, 3)[160 * 5 : 160 * 5 + 400]
    power = np.abs(np.fft.rfft(x * np.hanning(400), 512)) ** 2
    assert np.allclose(want[5], np.log(power @ audio_features.mel_filters() + 1e-6), atol=1e-3)


def test_rare_gains_equal_gains():
    rng = np.random.default_rng(4)
    size, n = 9, 40
    joint = rng.integers(20, 400, (size, size)).astype(float)
    own = rng.integers(-1, size, n)
    side = lambda: np.where(rng.random((n, size)) < 0.3, rng.integers(1, 5, (n, size)), 0)
    cells = lambda m: (np.nonzero(m)[0], np.nonzero(m)[1], m[np.nonzero(m)])
    left, right = cells(side()), cells(side())
    want = class_lm.gains(joint, own, left, right, np.zeros(n))
    assert np.allclose(class_lm.rare_gains(joint, own, left, right, class_lm.steps(joint)), want)


def test_neighbours_by_brute_force(spark, monkeypatch):
    from collections import Counter

    rng = random.Random(12)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", f"once{k}"]) for _ in range(rng.choice([0, 1, 60]))) for k in range(50)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    name = lambda w: class_lm.END if w == "end" else common.hashed_words(pa.array([w]))[0][0]
    held = class_lm.Lexicon(np.array([name(w) for w in ("a", "b", "end")], np.uint64), np.array([5 << 20, 9, 9]), np.zeros(3, int), -1)
    held = class_lm.Lexicon(held.words, held.counts, np.arange(3), -1)
    number = {w: int(np.searchsorted(held.words, name(w))) for w in ("a", "b", "end")}
    want = Counter()
    for t in texts:
        tokens = ["end", *t.split(), "end"]
        for x, y in zip(tokens, tokens[1:]):
            if x == y:
                want[int(name(x)), class_lm.ITSELF] += 1
            else:
                if x in number:
                    want[int(name(y)), 2 * number[x]] += 1
                if y in number:
                    want[int(name(x)), 2 * number[y] + 1] += 1
    got = Counter()
    for batch in class_lm._neighbours(train, spark.sparkContext.broadcast(held)).toArrow().to_batches():
        words, row, cell, times = class_lm._cells_of(batch)
        for w, x, n in zip(words[row].tolist(), cell.tolist(), times.tolist()):
            got[w, x] += n
    assert got == want
    core = np.array([name("b"), name("a")], np.uint64)
    pairs = class_lm._core_pairs(class_lm._neighbours(train, spark.sparkContext.broadcast(held)), core, spark.sparkContext.broadcast(held))
    tokens = [["end", *t.split(), "end"] for t in texts]
    assert pairs.tolist() == [[sum(zip_ == (x, y) for t in tokens for zip_ in zip(t, t[1:])) for y in "ba"] for x in "ba"]


def test_class_lm_is_a_distribution(spark):
    rng = random.Random(13)
    rows = [(k, " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(20))) for k in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = class_lm.fit(d.select("text"))
    words = ["ab", "cd", "ef", "gh"]
    # After each known word: what may follow, a known word, an unseen one or the end, sums to 1.
    ask = spark.createDataFrame([(k * 10 + j, f"{w} {x}".strip()) for k, w in enumerate(words) for j, x in enumerate(["", *words, "unseen"])], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in class_lm.score(ask, model).collect()}
    alone = {w: score[k * 10] for k, w in enumerate(words)}
    # P(w x end) / P(end | x) is P(w) P(x | w); the end's share after x is the same wherever x is.
    ids = {r["word"]: r["k"] for r in model["classes"].collect()}
    named = {w: ids[int(common.hashed_words(pa.array([w]))[0].view(np.int64)[0])] for w in words}
    trans = 10 ** model["trans"]
    for w in words:
        row = trans[named[w]]
        assert row[: class_lm.SIDES].sum() == pytest.approx(1, abs=1e-9)
        known = sum(row[named[x]] * (count + 1) / 10 ** model["slots"][named[x]] for x in words for count in [sum(t.split().count(x) for _, t in rows)])
        end = row[class_lm.CLASSES] * (30 + 1) / 10 ** model["slots"][class_lm.CLASSES]
        assert known + end + row[-1] == pytest.approx(1, abs=1e-9)
    assert all(x < 0 for x in alone.values())


def _small_model(rng, features):
    shapes = {"We": (features, 4), "be": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": (1,)}
    return {k: rng.normal(size=v) for k, v in shapes.items()} | {"mean": rng.normal(size=features), "scale": rng.uniform(1, 2, features)}


def test_attention_by_its_definition():
    rng = np.random.default_rng(1)
    m, x, bags = _small_model(rng, 5), rng.normal(size=(7, 5)), np.array([0, 3, 4, 7])
    got = quality_mil.forward(m, x, bags)[0]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for k in range(3):
        e = [np.tanh((v - m["mean"]) / m["scale"] @ m["We"] + m["be"]) for v in x[bags[k] : bags[k + 1]]]
        s = np.exp([m["w"] @ (np.tanh(v @ m["V"]) * sigmoid(v @ m["U"])) for v in e])
        z = sum(a * v for a, v in zip(s / s.sum(), e, strict=True))
        assert got[k] == pytest.approx(sigmoid(z @ m["c"] + m["d"][0]))


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    m, x, bags = _small_model(rng, 5), rng.normal(size=(7, 5)), np.array([0, 3, 4, 7])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 2.0, 1.0])

    def loss():
        p = quality_mil.forward(m, x, bags)[0]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    for name, slope in quality_mil.gradient(m, x, bags, y, weight).items():
        for at in np.ndindex(slope.shape):
            old = m[name][at]
            values = []
            for step in (1e-6, -1e-6):
                m[name][at] = old + step
                values.append(loss())
            m[name][at] = old
            assert slope[at] == pytest.approx((values[0] - values[1]) / 2e-6, abs=1e-6)


def test_passages_by_hand():
    text = "Ab ab, 12 xx " * 20 + "é" * 25 + " !? " + "tail word " * 30
    words = text.split()
    x, bags = quality_mil.passage_features(pa.array([text, None, "one"]))
    assert bags.tolist() == [0, 3, 4, 5] and not x[3].any()
    for k in range(3):
        part = [w.encode() for w in words[k * 64 : (k + 1) * 64]]
        size = [len(w) for w in part]
        begin = len(" ".join(words[: k * 64]).encode()) + (k > 0)
        whole = re.sub(rb"\s+", b" ", text.encode())[begin:]
        whole = whole[: len(b" ".join(part))]
        assert x[k, 0] == pytest.approx(sum(65 <= b <= 90 for b in whole) / len(whole), abs=0.01)
        assert x[k, 8] == pytest.approx(np.mean(size) / 10) and x[k, 9] == pytest.approx(np.std(size) / 10)
        assert x[k, 10] == pytest.approx(sum(words[i].lower() == words[i - 1].lower() for i in range(max(k * 64, 1), min((k + 1) * 64, len(words)))) / len(part))
        assert x[k, 15] == pytest.approx(np.mean([n > 20 for n in size])) and x[k, 16] == pytest.approx(np.mean([n == 1 for n in size]))
        assert x[k, 11] == pytest.approx(1 - len({w.lower() for w in part}) / len(part))


def test_repeated_labelled_ids_teach_the_same_whatever_the_order(spark):
    rows = [(k, "GOOD!! " * 80 if k % 2 else "bad words " * 70, k % 2) for k in range(40)] + [(k, "other text " * 70, k % 2) for k in range(40)]
    fits = []
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string, quality int").repartition(3)
        fits.append(quality_mil.fit(d.select("doc_id", "text"), d.select("doc_id", "quality")))
    assert all(np.array_equal(fits[0][k], fits[1][k]) for k in fits[0])


def test_stages_give_the_expected_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    line = "This line stands in many documents and is longer than forty characters"
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(k, f"own text {k}\n{line}", None, "s", k) for k in range(6)] + [(6, None, "de", None, None), (7, "", "de", "s", 0), (None, f"x\n{line}", None, "s", 1), (1, f"other\n {line.upper()}", None, "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.line_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in out.collect())
    want = [(str(k), f"own text {k}", len(f"own text {k}")) for k in range(5)] + [("5", rows[5][1], len(rows[5][1])), ("6", "", 0), ("7", "", 0), ("None", "x", 1), ("1", "other", 5)]
    assert got == sorted(want)

    near = spark.createDataFrame([(3, a, None, "s", 1), (2, a + " more", "x", "s", 2), (9, b, None, None, 3), (9, b, None, None, 3), (9, a, None, "t", 4), (4, "", None, "s", 0), (5, None, None, "s", 0)], docs.schema)
    kept = pipeline.ngram_jaccard_join(spark, near, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(2, a + " more"), (9, b), (4, ""), (5, "")])

    mixed = pipeline.source_mixing(spark, near, "")
    counts = {}
    for r in mixed.collect():
        counts[tuple(r)] = counts.get(tuple(r), 0) + 1
    assert mixed.columns == docs.columns and all(1 <= n <= 4 for n in counts.values()) and set(counts) <= {tuple(r) for r in near.collect()}

    packed = pipeline.length_packing(spark, near, "")
    assert packed.columns == [*docs.columns, *packing.PLACE]
    packed = packed.collect()
    assert sorted((r["doc_id"], r["text"] or "", r["n_tokens"]) for r in packed) == sorted((r["doc_id"], r["text"] or "", len((r["text"] or "").split())) for r in near.collect())
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in packed}) == len(packed)

    (tmp_path / "x").mkdir()
    shout = [(k, ("word " if k % 2 else "BUY!! ") * 70, None, "s", 1) for k in range(60)]
    spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    good = pipeline.quality_classifier(spark, spark.createDataFrame(shout, docs.schema), str(tmp_path))
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == {k for k in range(60) if k % 2}


def files_below(folder):
    return sorted(str(x.relative_to(folder)) for x in folder.rglob("*") if x.is_file() and not x.name.startswith((".", "_")))


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    """A folder of its own in place of the shared one, as inside a scratch space."""
    monkeypatch.setattr(sinks, "_open", [str(tmp_path / "shared")])
    return tmp_path / "shared"


def test_pipeline_run_leaves_its_texts_and_nothing_else(spark, tmp_path, shared):
    import corpus_pipeline as pipeline

    rows = [(k, f"some words of document {k} " * 30, "en", f"s{k % 3}", 1) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1) for k in range(5)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert len(got) >= 30 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", *packing.PLACE]
    batches = {}
    for r in got:  # every row of a batch has its own text, copies too
        assert r["text"] == rows[r["doc_id"]][1] and r["n_tokens"] == len(r["text"].split()) <= r["bucket_length"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in batches.values())
    assert {x.rpartition("/")[0].rpartition("/")[2] for x in files_below(shared)} == {str(len(pipeline.STAGES) - 1)}


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_ngram_join", "op4_line_dedup", "op6_exact_dedup", "op9_class_lm", "op10_mixing", "op11_decontamination"])
def test_queries_leave_their_result_only(spark, tmp_path, shared, name):
    words = "one two three four five six seven eight nine ten eleven".split()
    rows = [(k, " ".join([*words, f"w{k % 7}", *words]), "en", f"s{k % 3}", 1) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, f"http://a{k}.net/x") for k in range(9)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    out = queries.queries()[name](spark, str(tmp_path))
    assert out.count() == (9 if name.startswith("op1_") else 40)
    assert {x.partition("-")[0] for x in files_below(shared)} == {"result"}


def test_packed_rows_keep_their_columns(spark, docs):
    clash = docs.select("*", *(F.lit("c").alias(x) for x in ("own", "rank", "shard", "offset", "Batch", "SLOT", "bucket")))
    out = packing.pack_rows(clash, 4, 500)
    assert out.columns == [*docs.columns, "own", "rank", "shard", "offset", *packing.PLACE]
    told = lambda rows: sorted(map(repr, ((r["doc_id"], r["text"], r["source"], r["extra"]) for r in rows)))
    assert told(out.collect()) == told(docs.collect())
    narrow = sorted(repr(tuple(r)) for r in packing.pack(docs, 4, 500).collect())
    assert sorted(repr((r["doc_id"], *(r[x] for x in packing.PLACE))) for r in out.collect()) == narrow
    assert packing.pack_rows(docs.limit(0)).count() == 0


def test_nothing_between_learnt_texts(spark):
    said = [("user", "q\n<|and|>"), ("user", ""), ("assistant", "a\\m"), ("assistant", ""), ("assistant", "<|end|>\nb"), ("user", "x"), ("assistant", "c")]
    turns = spark.createDataFrame([(1, k, *x) for k, x in enumerate(said)], "conv_id long, turn long, role string, text string")
    row = chat_format.read_back(chat_format.chat_format(turns)).first()
    assert [(t["role"], t["text"]) for t in row["turns"]] == [("user", "q\n<|and|>\n"), ("assistant", "a\\m\n\n<|end|>\nb"), ("user", "x"), ("assistant", "c")]
    assert row["learnt"] == ["a\\m", "", "<|end|>\nb", "c"]
    at, learnt = 0, []
    for run in (r for t in row["loss_mask"] for r in t):  # the mask alone, over the string as it is
        if run["learn"]:
            learnt.append(row["formatted"][at : at + run["length"]].replace("\\m", "<|").replace("\\s", "\\"))
        at += run["length"]
    assert at == len(row["formatted"]) and learnt == row["learnt"]


def test_chat_takes_long_texts_empty_tables_and_other_columns(spark):
    rows = [(1, 0, "user", "\\<|" * 200_000, "x"), (1, 1, "assistant", "<|end|>\n" * 100_000, "y")] + [(2, k, ("user", "assistant")[k % 2], f"t{k}", "z") for k in range(2000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.chat_format(turns)).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [rows[0][3], rows[1][3]] and got[1]["learnt"] == [rows[1][3]]
    assert len(got[2]["turns"]) == 2000 and got[2]["learnt"] == [f"t{k}" for k in range(1, 2000, 2)]
    empty = chat_format.read_back(chat_format.chat_format(turns.limit(0)))
    assert empty.count() == 0 and empty.columns == ["conv_id", "formatted", "loss_mask", "turns", "learnt"]


def test_rounds_of_exchange_have_no_join_and_gather_by_brute_force(spark, monkeypatch):
    from collections import Counter

    rng = random.Random(21)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e", f"once{k}"]) for _ in range(rng.choice([0, 1, 60]))) for k in range(40)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    plans, real = [], common.checkpointed
    monkeypatch.setattr(common, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    with monkeypatch.context() as few:
        few.setattr(class_lm, "LEXICON", 3)
        assert class_lm.fit(train)["V"] == len({w for t in texts for w in t.split()}) + 1
    assert not [p for p in plans if "Join" in p] and max(p.count("Exchange") for p in plans[1:]) == 1  # the first counts words

    name = lambda w: class_lm.END if w == "end" else common.hashed_words(pa.array([w]))[0][0]
    held = class_lm.Lexicon(np.array([name(w) for w in ("a", "b", "end")], np.uint64), np.array([5 << 20, 9, 9]), np.array([0, -1, class_lm.CLASSES]), -2)
    numbered = class_lm.Lexicon(held.words, held.counts, np.arange(3), -1)
    kinds = {"a": 0, "b": -1, "c": 2, "d": 3, "e": 2, "end": class_lm.CLASSES}
    share = spark.sparkContext.broadcast
    neighbours = class_lm._neighbours(train, share(numbered))
    classes = spark.createDataFrame([(int(name(w).view(np.int64)), kinds[w]) for w in "cde"], "word long, k int")
    away = neighbours.where("away").join(classes, "word", "left").selectExpr("word", "n", "coalesce(k, -1) as k", "beside", "apart")
    got, own = Counter(), {}
    for batch in class_lm._gathered(neighbours, away, share(held)).toArrow().to_batches():
        words, k, n, left, right, twice = class_lm._sides(batch)
        own |= dict(zip(words.tolist(), zip(k.tolist(), n.tolist())))
        for side, (who, of, times) in enumerate((left, right)):
            for w, j, t in zip(words[who].tolist(), of.tolist(), times.tolist()):
                got[w, side, j] += t
        got.update({(w, "self", 0): int(t) for w, t in zip(words.tolist(), twice) if t})
    want, seen = Counter(), Counter()
    for t in texts:
        tokens = ["end", *t.split(), "end"]
        seen.update(tokens[1:])
        for x, y in zip(tokens, tokens[1:]):
            if x == y:
                want[int(name(x)), "self", 0] += 1
            else:
                for w, side, other in ((y, 0, x), (x, 1, y)):
                    if kinds.get(other, -1) >= 0:
                        want[int(name(w)), side, kinds[other]] += 1
    assert got == want and own == {int(name(w)): (kinds.get(w, -1), n) for w, n in seen.items()}
