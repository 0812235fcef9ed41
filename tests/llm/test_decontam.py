"""Decontamination against a search for every window in every text."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quantloom.llm import decontam

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(WORD, (text or "").translate(FOLD))


def expected(text, items):
    words, hit, named = words_of(text), set(), set()
    for item, said in items:
        own = words_of(said)
        n = min(len(own), decontam.WINDOW)
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        at = [k for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows] if n else []
        hit |= {j for k in at for j in range(k, k + n)}
        if at and item is not None:
            named.add(str(item))
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    pool = [f"w{k}" for k in range(30)] + ["é", "日本", "Ab9"]
    say = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([1, 2, 5, 8, 9, 10, 10, 11, 14, 40, 40, 200])]
    items += [(20, "One two-three, FOUR"), (21, None), (22, ""), (23, " ,.! "), (3, "repeated id of nine words or so it seems"), (None, "an item without any id says these words twice over here"), (30, items[9][1]), (31, items[9][1].upper() + " more")]
    texts = []
    for k in range(80):
        own = say(rng.choice([0, 1, 9, 10, 30, 120]))
        if k % 2:
            said = words_of(rng.choice(items)[1] or "")
            a = rng.randrange(len(said) + 1)
            part = said[a : a + rng.choice([3, 9, 10, 12, 50])]
            at = rng.randrange(len(own) + 1)
            own = own[:at] + part + own[at:]
        texts.append((k, rng.choice([" ", "  ", ", ", "\n"]).join(own)))
    texts += [(100, None), (101, ""), (102, "..."), (103, "ONE two three four"), (104, "one two three fourth"), (1, texts[1][1]), (None, items[9][1]), (105, " ".join(say(150_000)) + " " + items[11][1]), (106, items[11][1] + " " + items[11][1])]
    texts += [(107, " ".join(words_of(items[9][1])[:9])), (108, " ".join(words_of(items[9][1])[9:] + words_of(items[9][1])[:9])), (109, "An ITEM without any id - says these words twice over")]
    extra = ["row", "at", "n", "s", "sets", "set", "name", "names", "print", "item_id", "items", "spans", "start", "n_hit", "times", "ITEM", "Row"]
    clash = lambda df, own: df.select("*", *(F.lit("clash").alias(x) for x in extra if x != own and x.lower() not in {y.lower() for y in df.columns} and (x == x.lower() or x.lower() not in extra)))
    docs = clash(spark.createDataFrame(texts, "doc_id long, text string"), "").repartition(3)
    return docs, clash(spark.createDataFrame(items, "item_id long, text string"), "item_id"), texts, items


def test_every_window_is_found(tables):
    docs, benchmark, texts, items = tables
    got = decontam.decontaminate(docs, benchmark).collect()
    told = sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got)
    assert told == sorted((repr(k), *expected(t, items)) for k, t in texts)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_a_full_bitmap_only_asks_more(tables, monkeypatch):
    docs, benchmark, texts, items = tables
    monkeypatch.setattr(decontam, "BITMAP_BYTES", 128)
    got = decontam.decontaminate(docs, benchmark).where("doc_id is not null").collect()
    assert sorted((r["doc_id"], r["n_hit"], r["n_items"]) for r in got) == sorted((k, *expected(t, items)[1:3]) for k, t in texts if k is not None)


def test_keep_clean_takes_hit_rows_only(tables):
    docs, benchmark, texts, items = tables
    kept = decontam.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(k) for k, t in texts if not expected(t, items)[4])


def test_empty_tables(spark, tables):
    docs, benchmark, texts, _ = tables
    assert decontam.decontaminate(docs.limit(0), benchmark).count() == 0
    assert {r["n_hit"] for r in decontam.decontaminate(docs, benchmark.limit(0)).collect()} == {0}
    assert decontam.keep_clean(docs, benchmark.limit(0)).count() == len(texts)
