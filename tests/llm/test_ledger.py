"""A ledger over several increments and rule versions scans each pair of a blob and a version once."""

from __future__ import annotations

import re

from ebbflow.llm import secret_scan
from ebbflow.llm.common import shared_folder

FIRST = [("a.py", "token=abcdefgh1"), ("b.py", "nothing"), ("c.py", "token=abcdefgh1"), ("d.py", None)]
SECOND = [("a.py", "token=abcdefgh2"), ("b.py", "nothing"), ("e.py", "token=abcdefgh1"), ("f.py", "")]


def addressed(spark, rows):
    return secret_scan.address(spark.createDataFrame(rows, "path string, text string"), "path", "text")


def test_increments_scan_unseen_pairs(spark):
    ledger = secret_scan.Ledger(spark, shared_folder(spark, "ledger-test"))
    versions = [addressed(spark, FIRST), addressed(spark, SECOND)]
    assert ledger.rows(0) is None
    whole = ledger.scan_history(versions)
    scanned = [ledger.spark.read.parquet(f"{ledger.folder}/increment={i}").count() for i in range(2)]
    assert scanned == [3, 1]  # 'nothing' and the empty blob are known, and so is the token that moved to e.py
    found = {(r["path"], r["n_assign"]) for r in secret_scan.findings_by_path(versions[0].unionByName(versions[1]), whole).collect()}
    assert found == {("a.py", 1), ("b.py", 0), ("c.py", 1), ("d.py", 0), ("e.py", 1), ("f.py", 0)}
    ledger.append(versions[1], 1)  # again, as after a failure
    assert ledger.rows(2).count() == 4


def test_a_new_rule_version_scans_old_blobs_again(spark):
    folder = shared_folder(spark, "ledger-test")
    old = secret_scan.Ledger(spark, folder, secret_scan.Rules("base-0", secret_scan.find_spans))
    old.append(addressed(spark, FIRST), 0)
    new = secret_scan.Ledger(spark, folder)
    new.append(addressed(spark, FIRST), 1)
    assert {(r["rule_version"], r["n"]) for r in new.rows(2).groupBy("rule_version").count().withColumnRenamed("count", "n").collect()} == {("base-0", 3), (secret_scan.RULE_VERSION, 3)}


def test_the_query_has_two_increments_that_hold_all_versions(spark):
    whole = addressed(spark, FIRST + SECOND)
    parts = secret_scan.history(whole, 2)
    assert [p.count() > 0 for p in parts] == [True, True] and sum(p.count() for p in parts) == whole.count()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(FIRST + SECOND)], "doc_id long, text string")
    one, two = (sorted((r["doc_id"], r["spans"]) for r in secret_scan.scan_documents(docs, increments=n).collect()) for n in (1, 2))
    assert one == two and len(one) == 8


def test_findings_and_masks_follow_the_version_that_is_asked_for(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1 and 123"), (2, "456"), (None, "456"), (3, None), (4, "none")], "doc_id long, text string")
    rules = secret_scan.Rules("digits-2", lambda text: [(m.start(), m.end(), "hex") for m in re.finditer("[0-9]{3}", text)])
    addressed = secret_scan.address(docs, "doc_id", "text")
    ledger = secret_scan.Ledger(spark, shared_folder(spark, "ledger-test"), rules).scan_history([addressed])
    got = sorted(((r["path"], r["n_assign"], r["n_hex"], r["spans"]) for r in secret_scan.findings_by_path(addressed, ledger, rules).collect()), key=str)
    assert got == sorted([(1, 0, 1, "hex:20:23"), (2, 0, 1, "hex:0:3"), (None, 0, 1, "hex:0:3"), (3, 0, 0, ""), (4, 0, 0, "")], key=str)
    assert {r["text"] for r in secret_scan.mask_secrets(docs, ledger, rules=rules).collect()} == {"token=abcdefgh1 and ***", "***", None, "none"}
    # the base rules are another version: they scan what that ledger has of other rules, and find their own
    both = {r["doc_id"]: (r["n_assign"], r["n_hex"]) for r in secret_scan.scan_documents(docs.filter("doc_id is not null"), ledger).collect()}
    assert both == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0)}
    assert {r["text"] for r in secret_scan.mask_secrets(docs, ledger).collect()} == {"*" * 15 + " and 123", "456", None, "none"}
