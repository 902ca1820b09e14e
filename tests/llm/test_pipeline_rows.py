"""Every stage of the pipeline against plain Python on a planted corpus, and on empty, null, repeated, long and clashing input."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
STAGE = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "password=abcdefgh12345"
PASSAGE = "this very passage of well over fifty bytes stands in several documents of the corpus"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki") for b in ("lm", "rn", "st", "nd", "pt", "ck", "ng", "x")]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, toxic = {}, set()
    for i in range(260):
        words = say(rng.randint(30, 90))
        if i % 5 == 0:
            toxic.add(i)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilefoo", "nastybar"]))
        elif i % 13 == 1:
            words.insert(10, PASSAGE)
        elif i % 13 == 2:
            words.insert(3, SECRET)
        texts[i] = " ".join(words)
    for k in range(12):  # exact and near copies of clean documents
        words = texts[1 + 5 * k].split(" ")
        texts[300 + k] = " ".join(words) if k % 3 else " ".join([*words[:-1], "other"])
    texts |= {400: None, 401: "", 402: "ünïcödé ☃ " + PASSAGE, 403: PASSAGE + "é" + PASSAGE}
    rows = [(i, t, "en", "web", len(t or "")) for i, t in texts.items()]
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, texts, toxic


def held(df) -> dict:
    rows = df.collect()
    out = {r["doc_id"]: r["text"] for r in rows}
    assert len(out) == len(rows)
    return out


def smallest_of_groups(texts: dict) -> set:
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in sets if find(i) == i}


def without_repeats(texts: dict, length: int = 50) -> dict:
    first, out = {}, {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if first.setdefault(data[k : k + length], i) < i:
                gone[k : k + length] = True
        out[i] = np.frombuffer(data, np.uint8)[~gone].tobytes().decode(errors="ignore")
    return out


def masked(text: str) -> str:
    patterns = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""", r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}")
    out = text
    for p in patterns:
        for m in re.finditer(p, text):
            out = out[: m.start()] + "*" * (m.end() - m.start()) + out[m.end() :]
    return out


def test_stages_equal_plain_python(spark, corpus, tmp_path):
    folder, docs, texts, toxic = corpus

    def reread(name, frame):
        frame.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    kept = reread("a", STAGE["toxicity"](spark, docs, folder))
    assert held(kept) == {i: t for i, t in texts.items() if i not in toxic}
    single = reread("b", STAGE["near_duplicates"](spark, kept, folder))
    stays = smallest_of_groups(held(kept))
    assert held(single) == {i: t for i, t in held(kept).items() if i in stays} and not stays & set(range(300, 312))
    cut = reread("c", STAGE["repeated_passages"](spark, single, folder))
    assert held(cut) == without_repeats(held(single))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    hidden = reread("d", STAGE["secrets"](spark, cut, folder))
    assert held(hidden) == {i: masked(t) for i, t in held(cut).items()} and SECRET not in " ".join(held(hidden).values())
    check_packing(held(hidden), STAGE["packing"](spark, hidden, folder).collect())
    whole = defaultdict(dict)
    for r in corpus_pipeline.run(spark, folder).collect():
        whole[r["doc_id"]][r["start"]] = bytes(r["ids"])
    tokens = encoded(held(hidden))
    assert {i: b"".join(p[k] for k in sorted(p)) for i, p in whole.items()} == tokens


def encoded(texts: dict) -> dict:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in texts.items()}


def check_packing(texts: dict, rows: list) -> None:
    pieces, sequences = defaultdict(dict), defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["start"]] = bytes(r["ids"])
        sequences[r["sequence_id"]][r["offset"]] = r["length"]
    assert {i: b"".join(p[k] for k in sorted(p)) for i, p in pieces.items()} == encoded(texts)
    for s in sequences.values():
        total = 0
        for offset in sorted(s):
            assert offset == total
            total += s[offset]
        assert total <= 2048 and (total == 2048 or total & (total - 1) == 0)


ODD = [(None, SECRET), (None, None), (1, "a b"), (1, "a b"), (1, "another text of the same id"), (2, ""), (3, "word " * 60_000 + SECRET), (4, "x" * 200_000)]
EXTRA = ["__score", "__blob", "__spans", "chunk", "sequence_id", "ids"]


def test_stages_on_odd_input(spark, corpus):
    folder = corpus[0]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), *EXTRA) for i, t in ODD], SCHEMA + ", " + ", ".join(f"`{n}` string" for n in EXTRA))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, folder), stage(spark, docs.limit(0), folder)
        assert none.isEmpty(), name
        if name == "packing":
            assert out.groupBy("doc_id").agg({"length": "sum"}).count() == 5
            continue
        assert out.columns == docs.columns == none.columns, name
        rows = out.collect()
        assert len(rows) == len(ODD) and all(tuple(r)[5:] == tuple(EXTRA) for r in rows), name
        if name == "secrets":
            assert sorted(len(r["text"] or "") for r in rows) == sorted(len(t or "") for _, t in ODD) and not any(SECRET in (r["text"] or "") for r in rows)
