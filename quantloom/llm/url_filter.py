"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A listing has rows (host, path, action, kind, named). An ``exact`` row lists one canonical URL: ``host`` and ``path``
(with its query) as ``canonical`` writes them; listings may give them in any spelling, they are canonicalised here. A
``prefix`` row fits its host and all subdomains where the url's path starts with its path. Of the ``named`` rows that
fit (the rules) the longest wins; where none fits, any unnamed row (the block list) blocks, else the url passes.

Each distinct url is asked under its canonical form, and under each host suffix and path cut whose pair of lengths a
prefix row has, so work grows with the url's length and the listed pairs, not with its segments or labels squared.
The Bloom filter holds every listed key. It is sized from their count, BITS a key in blocks of 512 bits; beyond
``FILTER_BYTES`` it is cut into parts by hash, each a broadcast of its own that reads the urls once more. Keys that it
lets through are joined exactly, which removes its false positives; the listing is only joined, never collected. Both
joins go by ``common.heavy_join``, so a rule or a url in a third of all rows is not shuffled to one task.

Edge cases: a null url or one without ``://`` has empty host and path, fits nothing and passes; repeated urls each get a
verdict; of rules of equal length the larger key wins, then allow before block; a rule listed twice counts once, and a
block list row with action allow does nothing; very long urls are read whole; empty pages give no row, an empty listing
lets all pass. Columns of ``pages`` named host, path, rule or verdict in any case are replaced, all others stay,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Bits of the filter a listed key: about 1 false hit in 1000. Bytes of one part of it in an executor.
BITS, FILTER_BYTES = 16, 64 << 20
_SALTS = c.mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Query parameters that only tell where a visitor came from.
TRACKING = re.compile(r"utm_[^=&]*|gclid|fbclid|msclkid|mc_[ce]id")
_SCHEME_PORT = {"http": ":80", "https": ":443", "ftp": ":21"}
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")
_SPLIT = re.compile(r"([^/?#]*)([^?#]*)(\?[^#]*)?")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = "://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def _plain(text: str) -> str:
    """Percent escapes of unreserved characters undone, all others in upper case."""
    return _ESCAPE.sub(lambda m: ch if (ch := chr(int(m[1], 16))) in _UNRESERVED else m[0].upper(), text) if "%" in text else text


def canonical(scheme: str, host: str, path: str, query: str = "") -> tuple[str, str]:
    """(host, path with query) of a url: no user, default port, final dot, dot segments, tracking or fragment; "/" for no path."""
    host = host.rpartition("@")[2].lower().removesuffix(_SCHEME_PORT.get(scheme.lower(), ":")).removesuffix(":").removesuffix(".")
    out: list[str] = []
    parts = _plain(path).split("/")[1:]
    for k, part in enumerate(parts):
        if part in (".", ".."):
            if part == ".." and out:
                out.pop()
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    kept = [x for x in _plain(query[1:]).split("&") if x and not TRACKING.fullmatch(x.partition("=")[0])]
    return host, "/" + "/".join(out) + ("?" + "&".join(kept) if kept else "")


def _hashes(keys: list[str]) -> np.ndarray:
    data, offsets = c.text_buffer(pa.array(keys, pa.large_string()))
    return c.hash_spans(data, offsets[:-1], offsets[1:])  # every key holds its kind, so none is empty


def _key(kind: str, host: str, path: str) -> str:
    return f"{kind} {len(host)} {host}{path}"


def _listed(listing: DataFrame) -> DataFrame:
    """(key, hash, named, action, text, width, host_size, path_size) of the listing, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.column_of(batch, x).to_pylist() for x in ("host", "path", "kind")), strict=True))
            rows = [canonical("", h or "", *_cut(p or "")) if k == "exact" else (h or "", p or "") for h, p, k in rows]
            kinds = c.column_of(batch, "kind").to_pylist()
            keys = [_key(k, h, p) for (h, p), k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(_hashes(keys).view(np.int64)), c.column_of(batch, "named"), c.column_of(batch, "action"), pa.array([h + p for h, p in rows]), pa.array([len(h) for h, _ in rows], pa.int32()), pa.array([len(p) for _, p in rows], pa.int32())],
                ["key", "hash", "named", "action", "text", "host_size", "path_size"],
            )

    rows = listing.where("kind in ('prefix', 'exact')").select("host", "path", "kind", "named", "action")
    return c.checkpointed(rows.mapInArrow(run, "key string, hash long, named boolean, action string, text string, host_size int, path_size int").distinct())


def _cut(path: str) -> tuple[str, str]:
    head, mark, tail = path.partition("?")
    return head, mark + tail


def _place(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key and its eight words, each with one bit."""
    h = c.mix(hashes.view(np.uint64))
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    bit = ((h[:, None] & np.uint64(0xFFFFFFFF)) * _SALTS) >> np.uint64(58)
    return block.astype(np.int64), np.uint64(1) << bit


def bloom_of(keys: DataFrame, blocks: int) -> np.ndarray:
    """Blocked Bloom filter (blocks x 8 words) of the long column ``hash``; at most one row a block is collected."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bits = _place(c.column_of(batch, "hash").to_numpy(zero_copy_only=False), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(bits[:, k].copy().view(np.int64)) for k in range(8))], ["block", *(f"w{k}" for k in range(8))])

    made = keys.mapInArrow(words, "block long, " + ", ".join(f"w{k} long" for k in range(8)))
    made = made.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8))).toArrow()
    out = np.zeros((blocks, 8), np.uint64)
    at = made.column("block").to_numpy()
    for k in range(8):
        out[at, k] = made.column(f"w{k}").to_numpy().view(np.uint64)
    return out


def bloom_has(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, bits = _place(hashes, len(bloom))
    return ((bloom[block] & bits) == bits).all(1)


def asked(url: str, pairs: dict[int, list[int]]) -> list[str]:
    """Keys under which a url may be listed: its canonical form, and the listed (host, path) length pairs that fit it."""
    scheme, mark, rest = url.partition("://")
    host, path, query = _SPLIT.match(rest).groups("")
    if not mark or not host:
        return []
    keys = [_key("exact", *canonical(scheme, host, path, query))]
    host = host.translate(_FOLD)
    for size, cuts in pairs.items():
        if size == len(host) or size < len(host) and host[-size - 1] == ".":
            keys += [_key("prefix", host[len(host) - size :], path[:n]) for n in cuts if n <= len(path)]
    return keys


def _hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """(url, key) that the filter lets through, from distinct urls; a pass over the urls for each part of the filter."""
    spark = urls.sparkSession
    pairs: dict[int, list[int]] = {}
    # At most one row for each pair of lengths that a listed host and path can have.
    for row in listed.where("key like 'prefix %'").select("host_size", "path_size").distinct().collect():
        pairs.setdefault(row["host_size"], []).append(row["path_size"])
    total = listed.count()
    parts = max(1, -(-total * BITS // 8 // FILTER_BYTES))
    blocks = max(1, -(-total * BITS // parts // 512))

    def let_through(bloom, part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = c.column_of(batch, "url").to_pylist()
                for a in range(0, len(texts), 1024):
                    keys = [asked(t, pairs) for t in texts[a : a + 1024]]
                    flat = [k for x in keys for k in x]
                    if not flat:
                        continue
                    hashes = _hashes(flat)
                    ok = bloom_has(bloom.value, hashes) & (hashes.view(np.int64) % parts == part)
                    who = np.repeat(np.arange(a, a + len(keys)), [len(x) for x in keys])[ok]
                    yield pa.RecordBatch.from_arrays([pa.array([texts[k] for k in who], pa.string()), pa.array([flat[k] for k in np.flatnonzero(ok)], pa.string())], ["url", "key"])

        return run

    found = []
    for part in range(parts):
        own = listed.where(F.pmod("hash", F.lit(parts)) == part).select("hash")
        bloom = spark.sparkContext.broadcast(bloom_of(own, blocks))
        found.append(urls.select("url").mapInArrow(let_through(bloom, part), "url string, key string"))
    return c.checkpointed(reduce(DataFrame.unionByName, found))


def url_filter(pages: DataFrame, listing: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict appended; listing columns are host, path, action, kind, named."""
    listed = _listed(listing)
    urls = c.checkpointed(pages.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("times")))
    hits = _hits(urls, listed)
    is_allow = F.col("action") == "allow"
    rule = F.struct((F.col("host_size") + F.col("path_size")).alias("width"), "text", is_allow.alias("is_allow"), "action")
    facts = listed.groupBy("key").agg(F.max(F.when(F.col("named"), rule)).alias("rule"), F.bool_or(~F.col("named") & (F.col("action") == "block")).alias("listed"))
    facts = c.checkpointed(facts.join(hits.groupBy("key").agg(F.count("*").alias("times")), "key"))
    best = c.heavy_join(hits, facts, "key", "times").groupBy("url").agg(F.max("rule").alias("best"), F.bool_or("listed").alias("listed"))
    verdict = F.when(F.col("best").isNotNull(), F.col("best.action")).when(F.col("listed"), "block").otherwise("allow")
    told = c.checkpointed(urls.join(best, "url", "left").select(_digest("url").alias("_url"), F.col("best.text").alias("rule"), verdict.alias("verdict"), "times"))
    own = [x for x in pages.columns if x.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_path(F.col(url_col))
    # The caller's columns stay in one struct, so that no name of theirs meets one of ours.
    rows = pages.select(F.struct(*own).alias("own"), host.alias("host"), path.alias("path"), _digest(url_col).alias("_url"))
    judged = c.heavy_join(rows.where("_url is not null"), told, "_url", "times")
    nowhere = rows.where("_url is null").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    return judged.unionByName(nowhere).select(*(F.col("own")[x].alias(x) for x in own), "host", "path", "rule", "verdict")


def _digest(url: str) -> Column:
    """A url's name in the join: 32 bytes, however long it is."""
    return F.unhex(F.sha2(url, 256))
