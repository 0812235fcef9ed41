"""Copy-on-write upsert against lists of files in plain Python."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quantloom.llm import common, keyed_upsert, queries

CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
CHANGE = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
NAMES = [x.split()[0] for x in CLIENT.split(", ")]


def crc(x):
    return zlib.crc32(str(x).encode())


def rewritten_files(clients, changes, most):
    """[(rows, rewritten)] by the rules, a file at a time."""
    start = sorted((r for r in clients if crc(r[0]) % 7 > 3), key=lambda r: r[0])
    files = [start[k : k + most] for k in range(0, len(start), most)]
    firsts = [f[0][0] for f in files]
    last = {}
    for ch in changes:
        if ch[1] is not None and (ch[1] not in last or (ch[2], ch[0]) > (last[ch[1]][2], last[ch[1]][0])):
            last[ch[1]] = ch
    after = [{r[0]: r for r in f} for f in files]
    for k, ch in last.items():
        home = max([i for i, x in enumerate(firsts) if x <= k], default=0)
        h = crc(firsts[home]) % 10
        if h > 7:
            continue
        if ch[3] == "D" or crc(ch[0]) % 8 < h:
            after[home].pop(k, None)
        else:
            old = list(after[home].get(k, (k, *[None] * 9)))
            old[2], old[8], old[6], old[9] = ch[5], ch[6], ch[7], ch[8]
            after[home][k] = tuple(old)
    out = []
    for f, told in zip(files, after, strict=True):
        rows = sorted(told.values(), key=lambda r: r[0])
        if rows == f:
            out.append((f, False))
            continue
        pieces = math.ceil(len(rows) / most)
        at = 0
        for k in range(pieces):
            n = len(rows) // pieces + (k < len(rows) % pieces)
            piece, at = rows[at : at + n], at + n
            if out and out[-1][1] and len(out[-1][0]) + n <= most:
                out[-1] = (out[-1][0] + piece, True)
            else:
                out.append((piece, True))
    return out


def told(rows, rewritten):
    ids = ",".join(str(r[0]) for r in rows)
    cents = sum(0 if r[9] is None else math.floor(100 * r[9] + 0.5) for r in rows)
    return (rows[0][0], len(rows), cents, sum(crc("|".join(r[k] or "" for k in (2, 8, 6))) for r in rows), hashlib.sha256(ids.encode()).hexdigest(), ",".join(NAMES), rewritten)


def tables(seed, n, span, n_changes):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice([*x, None])
    clients = [(k, rng.randrange(span), pick("crm", "web", ""), None, pick("n"), None, pick("A", "B"), rng.randrange(25), pick("retail", "public"), pick(1.005, -0.0, 2.5, -3.335)) for k in rng.sample(range(span), n)]
    by_id = {r[0]: r for r in clients}
    changes = []
    for j in range(n_changes):
        k = rng.choice([rng.randrange(-20, span + 20), rng.randrange(span // 3, span // 3 + 20), None])
        same = by_id.get(k)
        values = (same[2], same[8], same[6], same[9]) if same and rng.random() < 0.5 else (pick("web", "store"), pick("export", ""), pick("C"), pick(7.0, 0.0))
        changes.append((j, k, rng.randrange(4), pick("U", "I", "D"), None, *values))
    return clients, changes + rng.sample(changes, min(5, len(changes)))


@pytest.mark.parametrize(("seed", "n", "span", "n_changes"), [(1, 2000, 3000, 900), (2, 1600, 1700, 60), (3, 1500, 9000, 9000), (4, 3, 10, 20), (5, 300, 600, 0)])
def test_query_by_brute_force(spark, tmp_path, seed, n, span, n_changes):
    clients, changes = tables(seed, n, span, n_changes)
    spark.createDataFrame(clients, CLIENT).repartition(3).write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame(changes, CHANGE).repartition(3).write.parquet(f"{tmp_path}/client_changes.parquet")
    want = rewritten_files(clients, changes, 1 + n // 1500)
    got = queries.op13_keyed_upsert(spark, str(tmp_path)).collect()
    names = ["first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "rewritten"]
    assert sorted(tuple(r[x] for x in names) for r in got) == sorted(told(*f) for f in want)
    if want:
        folder = got[0]["path"].rpartition("/")[0]
        assert sorted(map(repr, (tuple(r) for r in spark.read.parquet(folder).collect()))) == sorted(repr(r) for f, _ in want for r in f)
        for r in got[:5]:
            assert spark.read.parquet(r["path"]).columns == NAMES
    assert n_changes == 0 or seed == 4 or {x for _, x in want} == {True, False}


def apply(spark, folder, rows, changes, most, schema="k string, v string, home string, first int"):
    frame = spark.createDataFrame(rows, schema)
    keyed_upsert.write_sorted(frame, "k", folder, most)
    asked = spark.createDataFrame(changes, "k string, at int, told string, home string, v string, gone boolean")
    never = lambda *_: F.lit(False)
    before = keyed_upsert.upsert(spark, folder, frame.schema, asked, "k", ["at"], ["v", "home"], most, never, lambda _, change: change["gone"])
    return before, keyed_upsert.report(spark, folder, frame.schema, "k", {"n_v": F.length("v")}).orderBy("first_id").collect()


def test_strings_as_keys_and_inner_names_as_columns(spark, tmp_path):
    rows = [(f"k{j:03d}", "v" if j % 2 else None, "h", j) for j in range(40)]
    changes = [("k005", 1, "", "h", "w" * 300_000, None), ("k005", 0, "", "h", "lost", True), ("k100", 1, "", None, None, False), ("k101", 1, "", None, "", None), ("k021", 1, "x", "h", "v", None), (None, 1, "", "", "", None), ("k030", 1, "", "h", "", None)]
    before, files = apply(spark, str(tmp_path / "a"), rows, changes, 10)
    assert len(before) == 4 and [(r["first_id"], r["n_rows"]) for r in files] == [("k000", 10), ("k010", 10), ("k020", 10), ("k030", 6), ("k036", 6)]
    assert [r["path"] in before for r in files] == [False, True, True, False, False]  # k021 is as it was; null and empty differ
    assert files[0]["n_v"] == 300_000 + 4


def test_hot_home_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_upsert, "BLOCK", 16)
    rows = [(f"k{j:03d}", "v", "h", j) for j in range(30)]
    changes = [(f"k029{j:04d}", 1, "", "h", "new", None) for j in range(900)]
    before, files = apply(spark, str(tmp_path / "b"), rows, changes, 10)
    assert [r["n_rows"] for r in files] == [10, 10, *[10] * 91]
    assert [r["path"] in before for r in files[:3]] == [True, True, False]


def test_tables_that_are_or_become_empty(spark, tmp_path):
    assert apply(spark, str(tmp_path / "c"), [], [], 5) == ([], [])
    before, files = apply(spark, str(tmp_path / "d"), [], [("b", 1, "", "", "x", None), ("a", 1, "", "", "x", None), ("c", 1, "", "", "x", True)], 5)
    assert before == [] and [(r["first_id"], r["n_rows"]) for r in files] == [("a", 2)]
    before, files = apply(spark, str(tmp_path / "e"), [("a", "v", "h", 1)], [("a", 1, "", "", "", True)], 5)
    assert len(before) == 1 and files == []
    with pytest.raises(ValueError, match="have no k"):
        apply(spark, str(tmp_path / "f"), [(None, "v", "h", 1)], [], 5)


def test_pieces_join_to_the_left():
    files = keyed_upsert.Files([""] * 6, list(range(6)), [4] * 6)
    # 3 + 1 fit, the next home is empty, then 2 does not fit; 4 stays; 9 rows are 3 pieces of 3.
    assert keyed_upsert.cuts(files, {0: 3, 1: 1, 2: 0, 3: 2, 5: 9}, 4) == ([(0, 0, 3, 0, 0), (1, 3, 1, 0, 0), (3, 4, 2, 0, 1), (5, 6, 3, 0, 2)], 5)


def test_scratch_is_gone(spark, tmp_path):
    from quantloom.sources import sinks

    with common.scratch(spark) as folder:
        kept = common.checkpointed(spark.range(10))
        assert kept.count() == 10 and (sinks.place_of(spark)) == folder
        common.release(kept)
    assert sinks.place_of(spark) == common.shared_folder(spark)
