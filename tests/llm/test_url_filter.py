"""Judgement against reading the list plainly, at interval borders and for special rows."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from pairloom.llm import url_filter as uf

DAY = date(2024, 1, 1)


def plain(url, at, entries):
    """Latest entry of each matching pattern up to the fetch date; the most specific decides."""
    if url is None or at is None or "//" not in url:
        return False, None
    rest = url.split("//", 1)[1].split("?")[0].split("#")[0]
    host, _, path = rest.partition("/")
    host, path = host.split("@")[-1].split(":")[0].lower(), "/" + path + "/"
    best = None
    for pattern in {p for p, _, _ in entries if p}:
        head, _, tail = pattern.rstrip("/").partition("/")
        head = head.lower()
        if tail:
            if host != head or not path.startswith(f"/{tail}/"):
                continue
        elif not ("." + host).endswith("." + head):
            continue
        active = [(d, a == "block") for p, a, d in entries if p == pattern and d and a and d <= at]
        if active:
            rank = (bool(tail), len(pattern.rstrip("/")))
            if best is None or rank > best[0]:
                best = rank, max(active)[1], (head + ("/" + tail if tail else ""))
    return (best[1], best[2]) if best else (False, None)


@pytest.mark.parametrize("broadcast_bytes,span", [(16 << 20, 256), (0, 2)])
def test_same_as_plain_reading(spark, monkeypatch, broadcast_bytes, span):
    monkeypatch.setattr(uf, "BROADCAST_BYTES", broadcast_bytes)
    monkeypatch.setattr(uf, "SPAN", span)
    dice = random.Random(8)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.b.example.com", "other.org", "notexample.com"]
    entries = [(h + dice.choice(("", "/p", "/p/q", "/P/")), dice.choice(("block", "allow")), DAY + timedelta(dice.randrange(40))) for h in hosts for _ in range(5)]
    entries += [("com", "block", DAY + timedelta(30)), ("EXAMPLE.com", "allow", DAY + timedelta(35)), (None, "block", DAY), ("other.org", None, DAY), ("other.org", "block", None)]
    entries = list({(p, d): (p, a, d) for p, a, d in entries}.values())
    rows = []
    for i in range(400):
        url = dice.choice(("http://", "HTTPS://u@", "//")) + dice.choice(hosts).upper() + dice.choice(("", ":80")) + dice.choice(("", "/", "/p", "/p/q/r?x=/p", "/pq", "/p/#q", "//p"))
        rows.append((i, url, DAY + timedelta(dice.randrange(45)), "clash"))
    rows += [(900, None, DAY, None), (901, "no url", DAY, None), (902, "http://", DAY, None), (903, rows[0][1], None, None), (0, *rows[0][1:]), (904, "http://other.org/" + "p/" * 20_000, DAY + timedelta(44), None)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, blocked string")
    listed = spark.createDataFrame(entries, "pattern string, action string, dated date")
    found = sorted((r["page_id"], r["blocked"], str(r["decided_by"])) for r in uf.judge(captures, listed).collect())
    same = [(p, a, d) for p, a, d in entries]
    folded = {}
    for p, a, d in same:  # one pattern however it is written; block wins within a day
        if p and a and d:
            key = (p.rstrip("/").partition("/")[0].lower() + "".join(p.rstrip("/").partition("/")[1:]), d)
            folded[key] = "block" if "block" in (a, folded.get(key)) else a
    clean = [(p, a, d) for (p, d), a in folded.items()]
    assert found == sorted((i, *map(lambda x: x if isinstance(x, bool) else str(x), plain(u, t, clean))) for i, u, t, _ in rows)
    assert len({f[1:] for f in found}) > 8


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b/c", DAY)], "page_id long, url string, fetched date")
    listed = spark.createDataFrame([("a.b", "block", DAY)], "pattern string, action string, dated date")
    assert uf.judge(captures, listed.limit(0)).first()["blocked"] is False
    assert uf.judge(captures.limit(0), listed).collect() == [] and uf.judge(captures, listed).first()["blocked"] is True


def test_columns_of_the_caller_stay(spark):
    names = "page_id long, url string, fetched date, _url string, _at string, asked string, Time string, won int, pattern string"
    captures = spark.createDataFrame([(1, "http://a.b/c", DAY, "u", "a", "x", "y", 3, "p")] * 2, names)
    listed = spark.createDataFrame([("a.b", "block", DAY)], "pattern string, action string, dated date")
    rows = uf.judge(captures, listed)
    assert rows.columns == [*captures.columns, "blocked", "decided_by"]
    assert [tuple(r) for r in rows.collect()] == [(1, "http://a.b/c", DAY, "u", "a", "x", "y", 3, "p", True, "a.b")] * 2


def test_many_entries_of_a_pattern_do_not_multiply_captures(spark):
    entries = [("a.b", ("block", "allow")[i % 2], DAY + timedelta(i)) for i in range(2_000)]
    captures = [(i, f"http://a.b/{i}", DAY + timedelta(i * 7)) for i in range(280)]
    listed = spark.createDataFrame(entries, "pattern string, action string, dated date")
    found = uf.judge(spark.createDataFrame(captures, "page_id long, url string, fetched date"), listed).collect()
    assert {r["page_id"]: r["blocked"] for r in found} == {i: i * 7 % 2 == 0 for i in range(280)}
    spans = uf.histories(listed).collect()
    assert len(spans) == 8 and max(len(s["history"]) for s in spans) == uf.SPAN
