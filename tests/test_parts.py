"""Parts that SQL can't check: gates, streams, sequential operators and small functions."""

import hashlib
import json
import os
import random
import tempfile

import pandas as pd
import pytest

from lektra.functions import udfs
from lektra.functions.cloud import placed_words
from lektra.functions.text import question_terms, search_terms_core, search_terms_ui
from lektra.operators.grouped import batches, order_of, overlap_columns
from lektra.plans import registry
from lektra.sources import exports, files, gate
from lektra.streaming import capture
from tests.conftest import SF


def test_gate(spark):
    assert gate.readable(spark, " select 1; ") == "select 1"
    for fine in ("WITH a AS (SELECT ';') SELECT * FROM a", "select `update`, 'drop table x; delete' from notes where `delete` = 1", "select 1 -- x; y", "SELECT value FROM sync_meta WHERE key = 'pending'", "(select a from b) union select 'app_settings'"):
        assert gate.readable(spark, fine)
    for bad in ("select 1; select 2", "pragma x", "insert into a values (1)", "select * from app_settings", "select key from `app_settings`", "with a as (select 1) insert into b select * from a", "select * from x where y in (select key from app_settings)", "with a as (select * from main.app_settings) select 1 from a", "drop table x", "show tables", "selec 1", ""):
        with pytest.raises(ValueError):
            gate.readable(spark, bad)
    assert len(gate.writable(spark, "insert into notes values ('a;b'); delete from notes; update notes set a = 'sync_oplog' where `drop` = 1;")) == 3
    for bad in ("drop table notes", "update sync_oplog set a = 1", "insert into a values (1); vacuum", "DELETE FROM sync_oplog WHERE seq = 1", "insert into notes select value from app_settings", "alter table notes add column x int", "select 1", "merge into sync_meta using a on a.x = sync_meta.x when matched then delete"):
        with pytest.raises(ValueError):
            gate.writable(spark, bad)


def test_file_digests(spark):
    folder, cache = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-") + "/cache"
    os.mkdir(f"{folder}/below")
    for name, content in (("a", b"one"), ("below/b", b"two"), ("empty", b""), ("c", b"three")):
        with open(f"{folder}/{name}", "wb") as file:
            file.write(content)
    told = lambda: {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in files.digested(spark, folder, cache).collect()}
    of = lambda content: (len(content), hashlib.sha256(content).hexdigest())
    assert told() == {"a": of(b"one"), "b": of(b"two"), "c": of(b"three")}
    assert told() and spark.read.parquet(cache).count() == 3  # nothing is read again
    with open(f"{folder}/c", "wb") as file:
        file.write(b"other")
    os.utime(f"{folder}/c", (1_800_000_000,) * 2)
    os.remove(f"{folder}/a")
    assert told() == {"b": of(b"two"), "c": of(b"other")} and spark.read.parquet(cache).count() == 4
    got = {r.name: r.sha256 for r in registry.queries()["s15_file_digests"](spark, SF).collect()}
    for name, digest in got.items():
        with open(f"{SF}/{name}", "rb") as file:
            assert hashlib.sha256(file.read()).hexdigest() == digest
    assert len(got) == 14
    assert "content" not in files.listed(spark, folder)._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_large_files_are_hashed_in_rounds(spark, monkeypatch):
    """No task hashes more of a file than a round; Spark's own source reads nothing large."""
    monkeypatch.setattr(files, "ROUND_BYTES", 50_000)
    monkeypatch.setattr(files, "PIECE_BYTES", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "60000")
    draw = random.Random(5)
    noise = draw.randbytes(300_000)
    contents = {"a": noise, "b b.parquet": noise + b"\n", "c": b"\n\n" * 40_000, "d": b"\xef\xbb\xbf" + noise, "e": b"\xef\xbb\xbf" + noise[:70_000] + b"\r\n", "f": bytes(70_000), "g": noise[:50_000], "h.gz": noise[:55_000], "i": noise[:50_001]}
    folder, cache = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-") + "/cache"
    for name, content in contents.items():
        with open(f"{folder}/{name}", "wb") as file:
            file.write(content)
    try:
        told = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in files.digested(spark, folder, cache).collect()}
        again = files.digested(spark, folder, cache).count(), spark.read.parquet(cache).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert told == {name: (len(content), hashlib.sha256(content).hexdigest()) for name, content in contents.items()}
    assert again == (9, 9)


def test_nested_documents(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/out"
    items = [("a", i, json.dumps({"id": i, "t": "x, ]}"})) for i in range(300)] + [("b", 7, None), (None, 8, "{}"), ("c", None, "{}")]
    exports.nested(spark.createDataFrame([("a", "A"), ("b", None), ("c", "C"), ("none", "")], "id string, name string"), spark.createDataFrame(items, "collection_id string, id long, document string").repartition(5), path, parts=6)
    documents = {}
    for folder in sorted(os.listdir(path)):
        if folder.startswith("collection="):
            pieces = sorted(x for x in os.listdir(f"{path}/{folder}") if x.startswith("part-"))
            documents[folder[11:]] = json.loads("".join(open(f"{path}/{folder}/{x}").read() for x in pieces)), len(pieces)
    assert documents["a"][0] == {"version": 3, "collection": {"id": "a", "name": "A"}, "items": [json.loads(d) for c, _, d in items if c == "a"]} and documents["a"][1] > 2
    assert documents["b"][0]["items"] == [None] and documents["c"][0]["items"] == [] == documents["none"][0]["items"] and documents["b"][0]["collection"] == {"id": "b", "name": None}


def test_overlapping_columns(spark):
    rng = random.Random(2)
    rows = [(p, i, rng.choice([None, rng.randrange(1500)]) if i % 9 == 0 else rng.randrange(1500), rng.choice([None, rng.randrange(800)]), rng.randrange(0, 500)) for p in range(30) for i in range(rng.randrange(1, 25))]
    got = {(r.page, r.region): (r.column, r.place) for r in overlap_columns(spark.createDataFrame(rows, "page int, region int, x int, y int, width int").repartition(3)).collect()}
    wanted = {}
    for page in range(30):
        mine, columns, of = [r[1:] for r in rows if r[0] == page], [], {}
        for region, x, _, width in sorted((r for r in mine if r[1] is not None), key=lambda r: (r[1], r[0])):
            best, most = None, 0
            for i, (a, b) in enumerate(columns):
                n = min(x + width, b) - max(x, a)
                if n >= min(200, width) and n > most:
                    best, most = i, n
            if best is None:
                best = len(columns)
                columns.append((x, x + width))
            columns[best] = min(columns[best][0], x), max(columns[best][1], x + width)
            of[region] = best
        order = sorted((of.get(r[0], 0), r[2] or 0, r[0]) for r in mine)
        wanted |= {(page, region): (column, place) for place, (column, _, region) in enumerate(order)}
    assert got == wanted
    assert registry.queries()["l6_overlap_columns"](spark, SF).filter("column > 0").count()


def test_search_terms():
    assert search_terms_core("foo-bar") == ["foo", "bar"] and search_terms_core("foo^bar histo*") == ["foobar", "histo"]
    assert search_terms_core("AND or NOT near") == [] and search_terms_core("a a b a") == ["a", "b", "a"]
    assert search_terms_ui("foo-bar AND and") == ["foobar", "and"]
    assert question_terms("What did the mayor say, exactly?") == ["exactly", "mayor", "what"]


def test_chunks():
    text = "a" * 20_000 + "\n" + "b" * 20_000
    parts = udfs.chunks_of(text)
    assert [p["start"] for p in parts] == [0, 20_001] and "".join(p["text"] for p in parts) == text
    assert [len(p["text"]) for p in udfs.chunks_of("x" * 60_000)] == [28_000, 28_000, 4_000] and udfs.chunks_of("") == []


def test_repair_mend():
    assert udfs.repair("canciÃ³n") == "canción" and udfs.repair("canción") == "canción"
    assert json.loads(udfs.mend('Sure: ```json\n[{subject: "a",} {"subject": "b"}]\n```')) == [{"subject": "a"}, {"subject": "b"}]


def test_batches(spark):
    rows = [(1, s, b) for s, b in enumerate([10, 10, 10, 1, 99, 1, 1, 1, 1, 1, 1])]
    got = {r.seq: r.batch for r in batches(spark.createDataFrame(rows, "device long, seq long, bytes long"), most_rows=4, most_bytes=25).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: -1, 5: 1, 6: 1, 7: 2, 8: 2, 9: 2, 10: 2}


def test_reading_order():
    page = pd.DataFrame([(1, 0, 0, 950, 20), (2, 500, 100, 400, 20), (3, 0, 100, 400, 20), (4, 0, 200, 400, 20), (5, 510, 200, 400, 20), (6, 0, 400, 400, 20)], columns=["line", "x", "y", "width", "height"])
    assert order_of(page) == [1, 3, 4, 6, 2, 5]


def test_cloud_has_no_overlap():
    out = placed_words([(f"word{i}", 100 - i) for i in range(30)])
    boxes = [(x, y, 0.6 * s * len(w), 1.2 * s) for w, s, x, y in out]
    assert all(abs(a[0] - b[0]) * 2 >= a[2] + b[2] - 1e-9 or abs(a[1] - b[1]) * 2 >= a[3] + b[3] - 1e-9 for i, a in enumerate(boxes) for b in boxes[:i])


def test_stream_equals_batch(spark):
    folder, target, checkpoint = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    pages = [[("items", 1, 5, "a"), ("items", 2, 6, "b")], [("items", 1, 4, "late"), ("items", 2, 9, "c"), ("items", 2, 8, "d")], [("notes", 1, 1, "e")]]
    for i, page in enumerate(pages):
        with open(os.path.join(folder, f"{i}.json"), "w") as file:
            file.writelines(json.dumps(dict(zip(("table_name", "row_id", "seq", "payload"), r))) + "\n" for r in page)
    capture.apply_stream(spark, folder, "table_name string, row_id long, seq long, payload string", target, checkpoint)
    schema = spark.createDataFrame([], "table_name string, row_id long, seq long, payload string").schema
    rows = capture.replica(spark, target, schema, 2).collect()
    assert all("version=2" not in path for path in capture.unused(spark, target, 2))
    assert sorted((r.table_name, r.row_id, r.seq, r.payload) for r in rows) == [("items", 1, 5, "a"), ("items", 2, 9, "c"), ("notes", 1, 1, "e")]


def test_columns_of_a_page():
    from lektra.operators.grouped import columns_of

    left = [(100 + i % 3, 30 * i, i) for i in range(8)]
    right = [(500 + i % 2, 30 * i, 20 + i) for i in range(8)]
    close = [(112, 300, 50)]
    noise = [(300, 45, 60), (430, 95, 61)]
    columns = columns_of(right + close + left + noise, 25.0)
    assert [[line for _, _, line in c] for c in columns] == [[0, 1, 60, 2, 3, 4, 5, 6, 7, 50], [20, 21, 22, 23, 61, 24, 25, 26, 27]]
    assert columns_of([(5, 1, 0), (900, 0, 1)], 10.0) == [[(5, 1, 0)], [(900, 0, 1)]]


def test_a_page_of_many_lines(spark):
    """Two columns of 20,000 lines each, in time in proportion to them, between small pages whose lines are spread over batches."""
    from time import monotonic

    from lektra.operators.grouped import columns_of, reading_order

    lines = [(x + i % 7, i, 2 * i + (x > 0)) for i in range(20_000) for x in (0, 500)]
    began = monotonic()
    columns = columns_of(lines, 25.0)
    assert monotonic() - began < 5
    assert [[line for _, _, line in c] for c in columns] == [[*range(0, 40_000, 2)], [*range(1, 40_000, 2)]]
    rows = spark.range(30_000).selectExpr("id DIV 6 AS page", "cast(5 - id % 6 AS int) AS line", "if(id % 2 = 0, 500.0D, if(id % 3 = 0, null, 0.0D)) AS x", "10.0D * (5 - id % 6) AS y", "400.0D AS width", "20.0D AS height")
    got = {(r.page, r.line): r.place for r in reading_order(rows).collect()}
    assert len(got) == 30_000
    assert all(got[p, line] == place for p in range(5000) for place, line in enumerate((0, 2, 4, 1, 3, 5)))
