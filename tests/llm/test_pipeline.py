"""The stages one after the other, against brute force where a stage has one."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from test_decontaminate import brute
from test_simhash_dedup import brute_components, brute_print
from test_suffix_dedup import brute_windows

import corpus_pipeline as cp
from pairloom.llm import byte_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Labelled prose with insults, copies, near copies, shared passages and leaked items."""
    dice = random.Random(12)
    word = lambda: "".join(dice.choice("abcdefghijklmnop") for _ in range(dice.randrange(2, 9)))
    vocabulary = [word() for _ in range(900)]
    prose = lambda n: [dice.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(20))) for i in range(6)]
    passage = prose(60)
    rows, toxic, planted = [], [], {"copies": [], "leaks": []}
    for i in range(600):
        words = prose(dice.randrange(60, 160))
        if i % 6 == 0:
            for _ in range(4):
                words.insert(dice.randrange(len(words)), dice.choice(("wretchling", "dunderpate", "mucksnipe")))
            toxic.append(i)
        elif i % 25 == 1:
            words[10:10] = passage
        elif i % 40 == 3:
            words[5:5] = items[i % 6][1].split()
            planted["leaks"].append(i)
        rows.append((i, " ".join(words), "en", "s", 0))
    clean = [r for r in rows if r[0] not in toxic and r[0] not in planted["leaks"]]
    for n, r in enumerate(dice.sample(clean, 20)):
        words = r[1].split()
        if n % 2:
            words[dice.randrange(len(words))] = "changed"
        rows.append((1000 + n, " ".join(words), "en", "s", 0))
        planted["copies"].append(1000 + n)
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (None, "nobody knows this one at all", None, None, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, set(toxic), planted, items


def test_stages(spark, corpus):
    folder, rows, toxic, planted, items = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.write_scratch(stage(spark, docs, folder), name)
        assert sorted(docs.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars"])
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(seen[name])
    given = {r[0]: r[1] for r in rows}
    assert seen["toxicity"] == {k: t for k, t in given.items() if k not in toxic}
    # Of each group by brute force the smallest id; null and empty texts are copies of each other.
    there = sorted(seen["toxicity"].items(), key=lambda x: (x[0] is None, x[0]))
    roots = brute_components([brute_print(t) for _, t in there], 2)
    assert seen["simhash"] == {k: t for i, (k, t) in enumerate(there) if roots[i] == i}
    assert {k for k in planted["copies"] if k in seen["simhash"]} < set(planted["copies"]) and 2001 not in seen["simhash"]
    order = sorted(seen["simhash"].items(), key=lambda x: (x[0] is None, x[0]))
    cut = {}
    for (key, text), flags in zip(order, brute_windows([(t or "").encode() for _, t in order], 100)):
        gone = bytearray(len((text or "").encode()))
        for i, again in enumerate(flags):
            if again:
                gone[i : i + 100] = b"\1" * 100
        cut[key] = bytes(b for b, g in zip((text or "").encode(), gone) if not g).decode(errors="ignore")
    assert seen["repeats"] == cut and cut != seen["simhash"]
    leaky = {d for d, *_ in brute(list(cut.items()), items)}
    assert seen["decontamination"] == {k: t for k, t in cut.items() if k not in leaky} and leaky & set(planted["leaks"])
    path = public_tokenizers.path(cp.RANKS)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    found = {r["doc_id"]: tuple(r)[1:] for r in cp.run(spark, folder).collect()}
    wanted = {}
    for key, text in seen["decontamination"].items():
        ids = plain.encode_ordinary(text)
        wanted[key] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert found == wanted


def test_empty_documents(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
