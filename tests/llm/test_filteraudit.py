import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from lektra.llm import filteraudit
from lektra.llm.filteraudit import audit

SCHEMA = "doc_id long, text string, source string, mask string, n int"


def slow(rows, labels):
    """(part, order, step) -> counts, document by document."""
    rows = [(d, t or "", s or "") for d, t, s in rows]
    fails = []
    for d, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(u == t and e is not None and (d is None or e < d) for e, u, _ in rows)
        fails.append({"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller})
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    found = {}
    for part in {s for *_, s in rows}:
        mine = [(d, f) for (d, _, s), f in zip(rows, fails) if s == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone, redundant = [d for d, f in left if f[x]], sum(f[x] for _, f in mine) - sum(f[x] for _, f in left)
                left = [(d, f) for d, f in left if not f[x]]
                shapley[x] += len(gone)
                unique = sum(f[x] and sum(f.values()) == 1 for _, f in mine)
                found[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(d in good for d in gone), sum(d in toxic for d in gone)]
        for (p, order, step), x in found.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return found


def got(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(found) == len(rows)
    return found


def test_against_documents_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "PARTS_HELD", 2)
    rng = random.Random(4)
    long = lambda words, odd="": " ".join(rng.choice(words) for _ in range(210)) + odd
    many, few = [f"wörd{i}" for i in range(2000)], ["a", "bb", "c"]
    texts = [long(many), long(few), long(many, " # A"), long([w.upper() for w in many]), "short one", "", None, "A\x1cB", "x y " * 300]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["s", "t", "", None, "ü"]), "clash", 1) for _ in range(150)] + [(5, texts[0], "s", "x", 1), (5, texts[0], "s", "x", 1), (5, texts[0], "t", "x", 1)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    found = got(audit(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert found == slow([r[:3] for r in rows], labels)


def test_no_rows_and_one_group_of_copies(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    rows = [(i, None, "s", "", 0) for i in range(500)]
    found = got(audit(spark.createDataFrame(rows, SCHEMA), labels))
    assert found["s", "EABCD", 1] == [1, 499, 0, 0, 0, 0, 60 * 499] and found["s", "ABCDE", 5][:4] == [0, 0, 499, 0]


def test_first_failures():
    table = filteraudit.first_failures("ABCDE")
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    orders = filteraudit.orders_of("ABCDE")
    for mask in range(32):
        for order, step in zip(orders, table[mask]):
            at = [i for i, x in enumerate(order) if mask >> "ABCDE".index(x) & 1]
            assert step == (min(at) if at else 5)
    assert np.unique(table).tolist() == [0, 1, 2, 3, 4, 5]
