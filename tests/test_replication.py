"""The replicating stream against a fold over dictionaries, page by page."""

import json
import os
import random
import tempfile

import pytest

from lektra.streaming import replication as R

PARENT_OF = {"items": ["collections"], "assets": ["items"], "notes": ["items"], "entities": ["assets"], "item_topics": ["items", "topics"]}


class Fold:
    """One page after the other, one row after the other."""

    def __init__(self):
        self.rows, self.parked, self.aliases, self.journal = {}, {}, {}, set()

    def page(self, changes, dirty):
        newest = {}
        for c in changes:
            key = c["table_name"], c["row_id"]
            rank = (c["seq"], c["deleted"], c["payload"] is not None, c["payload"] or "")
            if key not in newest or rank > newest[key][0]:
                newest[key] = rank, c
        upserts, deletes = {}, {}
        for key, (_, c) in newest.items():
            known = max(held[key]["seq"] if key in held else -1 for held in (self.rows, self.parked))
            if None in key:
                self.journal.add((*key, c["seq"]))
            elif known >= c["seq"] != 0:
                continue
            elif c["deleted"]:
                if key not in dirty:
                    deletes[key] = c
            elif not fine(c["payload"]):
                self.journal.add((*key, c["seq"]))
            elif key not in dirty:
                upserts[key] = c
            else:
                continue
            self.parked.pop(key, None)
        topics = {k: c for k, c in upserts.items() if k[0] == "topics"}
        for name in {c["name"] for c in topics.values()} - {None}:
            there = [k[1] for k, r in self.rows.items() if k[0] == "topics" and r["present"] and r["name"] == name]
            first = min(there or [k[1] for k, c in topics.items() if c["name"] == name])
            for k, c in topics.items():
                if c["name"] == name and k[1] != first:
                    self.aliases[k[1]] = min(first, self.aliases.get(k[1], first))
                    self.rows[k] = self.rows[k] | {"seq": c["seq"]} if self.rows.get(k, {}).get("present") else c | {"present": False}
                    del upserts[k]
        def renamed(c):
            return c | {"parents": [(t, self.aliases.get(i, i) if t == "topics" else i) for t, i in c["parents"]]}

        waiting, applied = {k: renamed(c) for k, c in upserts.items()}, {}
        while True:
            ready = [k for k, c in waiting.items() if all(p in applied or self.rows.get(p, {}).get("present") for p in c["parents"])]
            if not ready:
                break
            for k in ready:
                applied[k] = waiting.pop(k)
            for k in [k for k, c in self.parked.items() if k not in newest and any(p in ready for p in c["parents"])]:
                c = self.parked.pop(k)
                if self.rows.get(k, {"seq": -1})["seq"] < c["seq"] and k not in dirty:
                    waiting[k] = renamed(c)
        self.rows |= {k: c | {"present": True} for k, c in applied.items()}
        below = {}
        for root in deletes:
            front, below[root] = [root], set()
            while front:
                at = front.pop()
                for k, r in self.rows.items():
                    if r["present"] and at in r["parents"] and k not in below[root]:
                        below[root].add(k)
                        front.append(k)
        for root, c in deletes.items():
            if not below[root] & dirty:
                self.rows[root] = c | {"present": False}
                for k in below[root] - {r for r in deletes if not below[r] & dirty}:
                    self.rows[k]["present"] = False
        self.parked |= waiting


def fine(payload):
    try:
        json.loads(payload)
        return True
    except (TypeError, ValueError):
        return False


def made(rng, n):
    changes = []
    for seq in range(1, n + 1):
        table = rng.choice(["collections", "topics", *PARENT_OF, *PARENT_OF])
        ids = {"collections": 3, "topics": 5, "items": 8, "assets": 10}.get(table, 12)
        parents = [(p, rng.randrange({"collections": 4, "topics": 6, "items": 9, "assets": 11}[p])) for p in PARENT_OF.get(table, [])]
        deleted = rng.random() < 0.15
        payload = None if deleted else rng.choice(["{bad", None]) if rng.random() < 0.05 else json.dumps({"v": seq})
        changes.append({"table_name": table, "row_id": rng.randrange(ids), "seq": seq, "deleted": deleted, "parents": parents, "name": rng.choice("abc") if table == "topics" else None, "payload": payload})
    return changes


def run(spark, pages, dirty, folder, **more):
    source = tempfile.mkdtemp(prefix="spark-")
    for i, page in enumerate(pages):
        with open(os.path.join(source, f"{i:03}.json"), "w") as file:
            file.writelines(json.dumps(c | {"parents": [{"table_name": t, "row_id": r} for t, r in c["parents"]]}) + "\n" for c in page)
        os.utime(os.path.join(source, f"{i:03}.json"), (1_700_000_000 + 10 * i,) * 2)
    stream = spark.readStream.schema(R.CHANGE).option("maxFilesPerTrigger", 1).json(source)
    return R.replicate(stream, f"{folder}/state", f"{folder}/checkpoint", spark.createDataFrame(sorted(dirty), "table_name string, row_id long"), **more)


def told(state):
    rows = {(r.table_name, r.row_id): (r.seq, sorted(map(tuple, r.parents)), r.payload) for r in state.present().collect()}
    return rows, {(r.table_name, r.row_id): r.seq for r in state.read("parked").collect()}, {r.row_id: r.local_id for r in state.aliases().collect()}, {(r.table_name, r.row_id, r.seq) for r in state.journal().collect()}


def test_pages_out_of_order(spark):
    rng = random.Random(1)
    changes = made(rng, 150)
    late = sorted(changes, key=lambda c: c["seq"] + 60 * rng.random())
    pages = [late[i : i + 50] for i in range(0, 150, 50)]
    pages.insert(2, pages[0])  # a page that comes again
    dirty = {("items", 2), ("assets", 5), ("notes", 3)}
    state = run(spark, pages, dirty, tempfile.mkdtemp(prefix="spark-"))
    fold = Fold()
    for page in pages:
        fold.page([dict(c) for c in page], dirty)
    rows, parked, aliases, journal = told(state)
    assert rows == {k: (r["seq"], sorted(r["parents"]), r["payload"]) for k, r in fold.rows.items() if r["present"]}
    assert parked == {k: c["seq"] for k, c in fold.parked.items()} and parked
    assert aliases == fold.aliases and journal == fold.journal
    there = {k for k, r in fold.rows.items() if r["present"]} | set(fold.parked)
    assert {(r.table_name, r.row_id) for r in R.finish(state).collect()} == {k for k, c in fold.parked.items() if any(p not in there for p in c["parents"])}


def change(table, row, seq, parents=(), deleted=False):
    return {"table_name": table, "row_id": row, "seq": seq, "deleted": deleted, "parents": list(parents), "name": None, "payload": None if deleted else f'{{"v":{seq}}}'}


def test_a_parent_two_batches_late_and_a_batch_again(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    pages = [[change("entities", 1, 1, [("assets", 1)]), change("assets", 1, 2, [("items", 1)])], [change("notes", 9, 3, [("items", 8)])], [change("collections", 1, 4), change("items", 1, 5, [("collections", 1)])], [change("items", 1, 6, deleted=True)]]
    first = run(spark, pages[:3], set(), folder)
    assert told(first)[0].keys() == {("entities", 1), ("assets", 1), ("collections", 1), ("items", 1)} and told(first)[1] == {("notes", 9): 3}
    again = R.Replica(spark, f"{folder}/state", 1)
    page = spark.createDataFrame([tuple(c.values()) for c in pages[2]], R.CHANGE)
    R.commit(again, 2, R.apply_page(again, page, spark.createDataFrame([], "table_name string, row_id long"), ""), "")
    assert told(R.Replica(spark, f"{folder}/state", 2)) == told(first)
    page = spark.createDataFrame([tuple(c.values()) for c in pages[3]], R.CHANGE)
    no_dirty, dirty = spark.createDataFrame([], "table_name string, row_id long"), spark.createDataFrame([("entities", 1)], "table_name string, row_id long")
    assert told(R.commit(first, 3, R.apply_page(first, page, dirty, ""), ""))[0] == told(first)[0]  # the tombstone is left for later
    after = R.commit(R.Replica(spark, f"{folder}/state", 3), 4, R.apply_page(R.Replica(spark, f"{folder}/state", 3), page, no_dirty, ""), "")
    assert told(after)[0].keys() == {("collections", 1)}
    used = {f"{folder}/state/{k}/batch={v}/bucket={b}" for k, m in after.versions.items() for b, v in m.items()}
    gone = R.retired(spark, f"{folder}/state", -1, 4)
    assert gone and not used & set(gone)


def test_another_epoch_and_a_newer_schema(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    state = run(spark, [[change("collections", 1, 9)]], set(), folder, epoch="a")
    page = spark.createDataFrame([tuple(change("collections", 1, 3).values())], R.CHANGE)
    none = spark.createDataFrame([], "table_name string, row_id long")
    assert told(R.commit(state, 1, R.apply_page(state, page, none, "a"), "a"))[0]["collections", 1][0] == 9
    assert told(R.commit(state, 1, R.apply_page(state, page, none, "b"), "b"))[0]["collections", 1][0] == 3
    with pytest.raises(ValueError):
        run(spark, [[]], set(), tempfile.mkdtemp(prefix="spark-"), schema_tag="2", own_tag="1")
    assert R.parts_for(0) == 8 and R.parts_for(10**12) == 16384
