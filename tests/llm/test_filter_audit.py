"""The filter audit against plain Python that applies the filters in every order."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import permutations

from ebbflow.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        parts[s or ""].append((fails, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        own = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                failing = sum(r[0][f] for r in rows)
                own.append(["".join(order), step, len(left), len(gone), failing - len(gone), sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)])
        for o in own:
            out.append((part, *o, sum(x[3] for x in own if x[0][x[1] - 1] == o[0][o[1] - 1])))
    return sorted(out)


def documents():
    r = random.Random(11)
    texts = [None, "", "Short Text", "a|b", "word " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i} X" for i in range(210)), "Ünïcode # " + " ".join(f"é{i}" for i in range(300)), "\x85" * 10]
    docs = [(i, r.choice(texts), r.choice(["s1", "s1", "s2", None, ""])) for i in range(300)]
    return docs + [(5, docs[5][1], docs[5][2]), (5, docs[5][1], "s9"), (None, "Short Text", "s1"), (None, None, None), (5, "another text of id 5", "s2"), (900, "x" * 50_000, "s1")]


def test_brute_force(spark):
    docs = documents()
    r = random.Random(2)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (None, 0, 1)]
    d = spark.createDataFrame([(*x, 7, "clash") for x in docs], "doc_id long, text string, source string, mask int, part string").repartition(3)
    out = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, out.collect())) == brute(docs, labels)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(d, labels).count() == 600 and filter_audit.audit(d.limit(0), labels).count() == 0
