"""Repeated lines, near copies and shared spans against brute force."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from papyrine.llm import near_copies, site_lines, spans


def brute_spans(rows: list[tuple[int, str]], length: int) -> set[tuple[int, int, int]]:
    held = defaultdict(set)
    texts = dict(rows)
    for i, t in texts.items():
        for p in range(len(t) - length + 1):
            held[t[p : p + length]].add(i)
    out = set()
    for i, t in texts.items():
        run = None
        for p in range(len(t) - length + 1):
            if len(held[t[p : p + length]]) > 1:
                if run and p <= run[1]:
                    run[1] = p + length
                else:
                    if run:
                        out.add((i, *run))
                    run = [p, p + length]
        if run:
            out.add((i, *run))
    return out


@pytest.mark.parametrize("length", [20, 60])
def test_spans(spark, prose, length):
    r = random.Random(length)
    pool = [prose(i, 240) for i in range(6)]
    rows = []
    for i in range(60):
        a = r.choice(pool)
        cut = r.randint(0, len(a) - 200)
        rows.append((i, prose(100 + i, 36) + a[cut : cut + r.randint(10, 400)] + prose(300 + i, 24)))
    rows += [(100 + i, pool[0]) for i in range(5)] + [(200, "a" * 500), (201, "b" + "a" * 300), (202, "ab" * 200), (203, "x" + "ab" * 90), (300, "short"), (301, "é" * length), (302, "é" * length)]
    df = spark.createDataFrame([*[(*x, "n") for x in rows], (5, rows[5][1], "n"), (900, None, "n"), (901, "", "n"), (None, rows[5][1], "n")], "doc_id bigint, text string, anchor string")
    got = {tuple(x) for x in spans.shared_spans(df, length=length).collect()}
    assert got == brute_spans(rows, length)
    assert spans.shared_spans(df.limit(0), length=length).count() == 0
    share = {x.doc_id: x for x in spans.shared_share(df, spans.shared_spans(df, length=length)).collect()}
    assert share[100].shared_share == 1.0 and share[900].shared_share == 0.0 and share[301].shared_chars == length


def test_span_blocks(monkeypatch, prose):
    text = prose(1, 4000)
    whole = spans.regions([text], 60)
    monkeypatch.setattr(spans, "BLOCK", 500)
    parts = spans.regions([text], 60)
    cover = lambda x: {(int(p), int(a)) for at, n, anchors in zip(x[1], x[2], x[3]) for b, c, a in zip(at, n, anchors) for p in range(b, b + c)}
    assert cover(whole) == cover(parts) and len(cover(whole)) == len(text) - 59


def fold(line: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", line).casefold()) if c.isalpha())


def brute_lines(rows: list[tuple[str, int, str]], least: int) -> set[tuple[int, int]]:
    seen, lines = defaultdict(set), []
    for site, i, t in rows:
        for n, line in enumerate(t.split("\n"), 1):
            if len(k := fold(line)) >= 15:
                seen[site, k].add(i)
                lines.append((i, n, site, k))
    return {(i, n) for i, n, site, k in lines if len(seen[site, k]) >= least}


def test_lines_hold_whole_chunks(prose):
    """Every line of enough letters has a chunk of its own, the same wherever the line stands, and the contents' chunks hold it."""
    r = random.Random(6)
    lines = ["abcdefghijklmno", "aaaaaaaaaaaaaaaaaaaa", "ababababababababab", "Share this page now", prose(5, 24).split(".")[0], prose(9, 60).replace(".", "")]
    seen = defaultdict(set)
    for k in range(30):
        body = [prose(50 + k, 24), *r.sample(lines, len(lines)), prose(90 + k, 12)]
        r.shuffle(body)
        row, number, chunk, _ = site_lines.line_chunks(["\n".join(body)], ["s"])
        ids, _ = site_lines.content_chunks(["\n".join(body)], ["s"])
        assert set(chunk.tolist()) <= set(ids.tolist()) and set(row.tolist()) == {0} and (chunk > 0).all()
        for n, c in zip(number.tolist(), chunk.tolist()):
            seen[body[n - 1]].add(c)
    assert all(len(seen[x]) == 1 for x in lines)
    a, b = (site_lines.content_chunks(["Share this page with all of your friends"], [s])[0] for s in "ab")
    assert not set(a.tolist()) & set(b.tolist())


def test_site_lines(spark, prose):
    r = random.Random(2)
    furniture = ["Share this page with friends", "© All rights reserved by us 20{}", "Ｓｈａｒｅ  this Page, with FRIENDS!", "Tous droits réservés ici", "TOUS DROITS RESERVES, ICI", prose(7, 120), "Short one"]
    rows = []
    for i in range(80):
        site = f"s{i % 4}.test"
        lines = [prose(1000 + i, 36), *[f.format(i % 30) for f in r.sample(furniture, 3)], prose(2000 + i, 24)]
        r.shuffle(lines)
        rows.append((site, i, "\n".join(lines)))
    urls = ["https://{}/x", "HTTP://WWW.{}:80/y", "//{}/z", "/relative", None, ""]
    data = [(i, i, t, urls[i % 6].format(site) if urls[i % 6] else urls[i % 6], "k") for site, i, t in rows]
    data += [data[0], (500, 500, None, None, "k"), (501, 501, "", None, "k")]
    contents = spark.createDataFrame(data, "content_id bigint, page_id bigint, content string, canonical_url string, chunk string")
    pages = spark.createDataFrame([(i, f"http://www.{site}/p?q") for site, i, _ in rows] + [(3, "https://s3.test/p")], "page_id bigint, url string")
    found = site_lines.repeated_lines(contents, pages)
    want = brute_lines(rows, 5)
    assert {(x.content_id, x.line_no) for x in found.collect()} == want and len(want) > 50
    cleaned = {x.content_id: x.content for x in site_lines.without_lines(contents, found).collect()}
    for _, i, t in rows:
        assert cleaned[i] == "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in want)
    assert cleaned[500] is None and cleaned[501] == ""
    listed = site_lines.site_list(contents, found).collect()
    assert {x.site for x in listed} == {f"s{i}.test" for i in range(4)} and all(x.contents >= 5 for x in listed)
    assert site_lines.repeated_lines(contents.limit(0), pages).count() == 0


def grams(title: str | None, text: str) -> set | None:
    w = re.findall(r"[^\W_]+", f"{title or ''}\n{text}".lower())
    return set(zip(w, w[1:], w[2:])) if len(w) >= 50 else None


def test_near_copies(spark, prose):
    r = random.Random(3)
    rows = []
    for i in range(120):
        base = prose(i % 25, 96 + 12 * (i % 5)).split(" ")
        for _ in range(r.randint(0, 14)):
            k = r.randrange(len(base))
            base[k : k + r.randint(0, 1)] = [f"Name{r.randint(0, 999)}"]
        if i % 7 == 0:
            base = base[len(base) // 2 :] + base[: len(base) // 2]
        rows.append((i, None if i % 3 else f"Title {i}", " ".join(base)))
    rows += [(200, "t", "too short"), (201, None, ""), (202, None, rows[1][2]), (203, None, rows[1][2])]
    sets = {i: g for i, t, x in rows if (g := grams(t, x))}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    data = [(*x, "s") for x in [*rows, rows[1], (300, "t", None), (None, *rows[1][1:])]]
    df = spark.createDataFrame(data, "content_id bigint, title string, content string, sample string")
    got = {(x.a, x.b) for x in near_copies.similar_pairs(df).collect()}
    assert got == want and len(want) > 30
    assert near_copies.similar_pairs(df.limit(0)).count() == 0
    links = {x.id: (x["class"], x.links) for x in near_copies.linked_classes(df).collect()}
    assert links == {i: (min(j for j in sets if sets[j] == sets[i]), sum(i in p for p in want)) for i in sets}
    assert near_copies.linked_classes(df.limit(0)).count() == 0


def test_least_shared_of_samples():
    """What is promised of two samples holds for pairs of the least similarity, in draws of either size."""
    r = random.Random(8)
    for n in (20, 64, 150, 400):
        for _ in range(60):
            both = {r.random() for _ in range(n // 2)}
            a, b = both | {r.random() for _ in range(n - n // 2)}, both  # b is half of a
            x, y = (set(sorted(s)[: near_copies.SAMPLE]) for s in (a, b))
            assert len(x & y) >= near_copies.shared_least(len(x), len(a)) - (n <= 64)
    assert near_copies.shared_least(64, 10**9) == 16 and near_copies.shared_least(1, 1) == 1


def test_divided_groups_lose_no_pair(spark, prose, monkeypatch):
    monkeypatch.setattr(near_copies, "SUB_BLOCK", 5)
    text = prose(1, 120)
    df = spark.createDataFrame([(i, f"title {i}", text) for i in range(23)], "content_id bigint, title string, content string")
    assert near_copies.similar_pairs(df).count() == 23 * 22 // 2
    same = spark.createDataFrame([(i, None, text) for i in range(23)], "content_id bigint, title string, content string")
    assert near_copies.similar_pairs(same).count() == 23 * 22 // 2
    assert {tuple(r) for r in near_copies.linked_classes(same).collect()} == {(i, 0, 22) for i in range(23)}


@pytest.mark.parametrize("furniture", [24, 60, 120])
def test_crowded_groups_lose_no_pair(spark, prose, monkeypatch, furniture):
    """Records whose site's furniture is a fifth to a half of them are asked again, and all pairs are found."""
    monkeypatch.setattr(near_copies, "REFINED", 2)
    monkeypatch.setattr(near_copies, "SUB_BLOCK", 5)
    r = random.Random(furniture)
    bar, rows = prose(999, furniture), []
    for i in range(40):
        words = prose(i % 15, 120).split(" ")
        for _ in range(r.randint(0, 12)):
            words[r.randrange(len(words))] = f"name{r.randint(0, 999)}"
        rows.append((i, None, f"{bar}\n{' '.join(words)}"))
    sets = {i: grams(t, x) for i, t, x in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "content_id bigint, title string, content string")
    assert {(x.a, x.b) for x in near_copies.similar_pairs(df).collect()} == want and len(want) > 20


def test_bit_sliced_distances():
    r = np.random.default_rng(5)
    n, bits = 70, near_copies.BITS
    rows = [r.integers(0, 256, bits // 8, dtype=np.uint8).tobytes() for _ in range(n - 20)]
    rows += [bytes(a ^ (1 << (k % 8) if k < 3 else 0) for k, a in enumerate(rows[i])) for i in range(20)]
    groups = [i % 5 for i in range(n)]
    order = sorted(range(n), key=lambda i: groups[i])
    g, s = [groups[i] for i in order], [rows[i] for i in order]
    for limit in (0, 3, 110, 128, 256):
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if g[i] == g[j] and sum((a ^ b).bit_count() for a, b in zip(s[i], s[j])) <= limit}
        assert set(near_copies.close_pairs(g, s, limit)) == want
