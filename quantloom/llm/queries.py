"""The registered query of each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_features, chat_format, class_lm, decontam, exact_dedup, keyed_upsert, line_dedup, mixing, ngram_join, packing, quality_mil, token_align, url_filter
from .common import load, scratch, shared_folder, tidy

#: (host, path, action) of the rules, and the hosts of the block list.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The block list: whole hosts, each family under each domain, and canonical URLs by rule on three further hosts.
JUNK = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")
LISTED_HOSTS, LISTED_LANGS, LISTED_UPTO, LISTED_STEP = ("tionsh.example.net", "blog.tionsh.example.com", "tionble.example.org"), ("de", "en", "es", "fr"), 10_000, 7
#: The conversation that is added to ``conversations``.
EXTRA_TURNS = tuple((-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant")))
NEAR = ngram_join.Similarity(n=4, percent=85)


def url_listing(spark: SparkSession) -> DataFrame:
    """The rules, the block list's hosts, and its canonical URLs, some 17,000."""
    whole = [(*r, "prefix", True) for r in RULES] + [(f"{x}.{d}", "", "block", "prefix", False) for x in JUNK for d in DOMAINS]
    hosts = spark.createDataFrame(whole, "host string, path string, action string, kind string, named boolean")
    numbers = spark.range(0, LISTED_UPTO, LISTED_STEP).select("id", F.explode(F.array(*map(F.lit, LISTED_HOSTS))).alias("host"))
    pages = numbers.select("host", F.explode(F.array(*map(F.lit, LISTED_LANGS))).alias("lang"), "id")
    return hosts.unionByName(pages.select("host", F.concat_ws("/", F.lit(""), "lang", "id").alias("path"), F.lit("block").alias("action"), F.lit("exact").alias("kind"), F.lit(False).alias("named")))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, url_listing(spark)).select("page_id", "host", "path", "rule", "verdict")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(load(spark, sf_dir, "documents"), NEAR).select("doc_id", "n_shingles", "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_mil.score(docs, quality_mil.fit(docs, load(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(load(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id long, turn long, role string, text string")
    told = chat_format.read_back(chat_format.chat_format(turns.unionByName(extra)))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features.media_digests(load(spark, sf_dir, "documents"))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_lm(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", mixing.c.word_count(F.col("text")).alias("size"))
    return mixing.plan_mix(sized, F.col("size")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decontam.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return told.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.link_statistics(load(spark, sf_dir, "documents"), token_align.Tokenizers.read())


def _of_ten(first: Column) -> Column:
    return F.crc32(first.cast("string")) % 10


def op13_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, changes = load(spark, sf_dir, "clients"), load(spark, sf_dir, "client_changes")
    most, folder, key = 1 + clients.count() // 1500, f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}", "client_id"
    with scratch(spark):
        keyed_upsert.write_sorted(clients.where(F.crc32(F.col(key).cast("string")) % 7 > 3), key, folder, most)
        before = keyed_upsert.upsert(
            *(spark, folder, clients.schema, changes, key, ["seq", "change_id"], ["source", "segment", "city", "balance"], most),
            ignored=lambda first, _: _of_ten(first) > 7,
            deleted=lambda first, change: F.coalesce(change["op"] == "D", F.lit(False)) | (F.crc32(change["change_id"].cast("string")) % 8 < _of_ten(first)),
        )
    sums = {
        "cents": F.coalesce(F.floor(F.col("balance") * 100 + 0.5), F.lit(0)),
        "rows_crc": F.crc32(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in ("source", "segment", "city")))),
    }
    told = keyed_upsert.report(spark, folder, clients.schema, key, sums)
    columns = F.lit(",".join(spark.read.parquet(folder).columns if before else clients.columns))
    earlier = F.broadcast(spark.createDataFrame([(x, False) for x in before], "path string, rewritten boolean"))  # a row a file
    told = told.join(earlier, "path", "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(True)))
    return told.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", columns.alias("columns"), "path", "rewritten")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _tidied(f):
    """The query with its result in a table of its own and all that it needed on the way deleted."""
    return lambda spark, sf_dir: tidy(spark, lambda: f(spark, sf_dir))


def queries() -> dict:
    # op7 writes nothing, and what op8, op13 and the pipeline write is asked for.
    plain = (op7_chat_format, op8_audio_features, op13_keyed_upsert, pipeline)
    own = (op1_url_filter, op2_packing, op3_ngram_join, op4_line_dedup, op5_quality, op6_exact_dedup, op7_chat_format, op8_audio_features, op9_class_lm, op10_mixing, op11_decontamination, op12_token_align, op13_keyed_upsert, pipeline)
    return {f.__name__: f if f in plain else _tidied(f) for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_HOST = f"translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_PATH = "regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2)"


def oracle_sql() -> dict[str, str]:
    listed = ", ".join([*(f"('{h}', '{p}', '{a}', true)" for h, p, a in RULES), *(f"('{x}.{d}', '', 'block', false)" for x in JUNK for d in DOMAINS)])
    hosts, langs = (", ".join(f"('{x}')" for x in some) for some in (LISTED_HOSTS, LISTED_LANGS))
    extra = ", ".join(f"({k}, {t}, '{r}', '{x}')" for k, t, r, x in EXTRA_TURNS)
    w = ", ".join(f"{x:.1f}" for x in mixing.WEIGHTS)
    return {
        "op1_url_filter": f"""
            WITH u AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages),
            l(h, p, action, named) AS (VALUES {listed}),
            x AS (SELECT h || '/' || g || '/' || n AS address FROM (VALUES {hosts}) a(h), (VALUES {langs}) b(g), range(0, {LISTED_UPTO}, {LISTED_STEP}) r(n)),
            k AS (SELECT page_id, regexp_replace(host, ':(80|443)$', '') || coalesce(nullif(path, ''), '/') AS address,
                         array_to_string([y FOR y IN string_split(regexp_extract(url, '://[^?#]*[?]([^#]*)', 1), '&') IF y <> '' AND NOT regexp_matches(y, '^(utm_[^=&]*|gclid|fbclid|msclkid|mc_[ce]id)(=|$)')], '&') AS query FROM u),
            e AS (SELECT DISTINCT page_id FROM k WHERE address || CASE WHEN query <> '' THEN '?' || query ELSE '' END IN (SELECT address FROM x)),
            fit AS (SELECT * FROM u JOIN l ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p)),
            best AS (SELECT page_id, arg_max(h || p, length(h || p)) FILTER (named) AS rule, arg_max(action, length(h || p)) FILTER (named) AS action,
                            bool_or(NOT named) AS listed FROM fit GROUP BY page_id)
            SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN best.action WHEN listed OR page_id IN (SELECT page_id FROM e) THEN 'block' ELSE 'allow' END AS verdict
            FROM u LEFT JOIN best USING (page_id)""",
        "op4_line_dedup": f"""
            WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
            k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM x),
            bad AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
            m AS (SELECT k.*, bad.key IS NOT NULL AND k.doc_id <> holder AS gone FROM k LEFT JOIN bad USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
            FROM m GROUP BY doc_id""",
        "op6_exact_dedup": r"""
            WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   row_number() OVER w = 1 AS kept, text_sha256
            FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
        "op7_chat_format": rf"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT * FROM (VALUES {extra})),
            f AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
            g AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS run FROM f),
            m AS (SELECT conv_id, run, any_value(role) AS role, string_agg(text, chr(10) ORDER BY turn, text) AS text, string_agg(text, '' ORDER BY turn, text) AS said,
                         sum({len(chat_format.JOINT)} + length(replace(replace(text, '\', '\s'), '<|', '\m'))) - {len(chat_format.JOINT)} AS wide FROM g GROUP BY conv_id, run)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY run)) AS turns_sha256,
                   CAST(coalesce(sum(length(said)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(said, '' ORDER BY run) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   CAST(sum(17 + length(replace(replace(replace(role, '\', '\s'), '<|', '\m'), chr(10), '\n')) + wide) AS BIGINT) AS formatted_chars
            FROM m GROUP BY conv_id""",
        "op10_mixing": rf"""
            WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
            s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{w}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight FROM d GROUP BY source),
            r AS (SELECT *, source_size * {mixing.CAP} AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.TOTAL} AS words FROM s),
            o AS (SELECT *, words - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spare,
                         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM r WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
            k AS (SELECT *, cap * open <= weight * spare AS capped FROM o),
            v AS (SELECT arg_max(spare, open) AS spare, max(open) AS open FROM k WHERE NOT capped),
            t AS (SELECT source, source_size, round(CASE WHEN capped THEN cap ELSE weight * (SELECT spare FROM v) / (SELECT open FROM v) END, 6) AS target FROM k),
            q AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate,
                         CAST('0x' || md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) / 4294967296.0 AS u
                  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
            SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM q""",
        "op11_decontamination": rf"""
            WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM documents),
            b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM benchmark),
            i AS (SELECT DISTINCT item, n, unnest([array_to_string(w[k:k + n - 1], ' ') FOR k IN range(1, len(w) - n + 2)]) AS words
                  FROM (SELECT item, w, least(len(w), {decontam.WINDOW}) AS n FROM b WHERE len(w) > 0)),
            p AS (SELECT doc_id, n, unnest([{{'k': k, 'words': array_to_string(w[k:k + n - 1], ' ')}} FOR k IN range(1, len(w) - n + 2)], recursive := true)
                  FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
            h AS (SELECT doc_id, k, n, item FROM p JOIN i USING (n, words)),
            u AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY doc_id),
            t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
            SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
            FROM d LEFT JOIN u USING (doc_id) LEFT JOIN t USING (doc_id)""",
    }
