"""The Merkle manifest, the filter audit and the URL rules against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornspark.llm import audit, merkle, url_rules
from hornspark.llm.ordering import numbered


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, arity):
    """The root, and for each leaf the siblings of its path as (left, right) texts."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a // arity * arity
            paths[i].append(("".join(level[run:a]), "".join(level[a + 1 : run + arity])))
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        at = [a // arity for a in at]
    return level[0], paths


def brute_manifest(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in names}
    root, tops = tree([subs[g][0] for g in names], arity)
    out = []
    for g, top in zip(names, tops, strict=True):
        for (_, _, leaf, row), own in zip(sorted(groups[g], key=lambda x: x[:3]), subs[g][1], strict=True):
            path = own + top
            forged = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                forged = leaf_of([*row[:4], row[4] if row[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), row[4])])
            folded = forged
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((row[0], row[1], leaf, subs[g][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("arity", [2, 16])
def test_the_manifest_is_the_tree(spark, arity):
    sizes = {None: 3, "": 1, "a": 1, "b": 2, "ba": 16, "z": 17, "é": 33, "src": 300}
    r = random.Random(arity)
    rows = [(i, g, r.choice(["en", None]), r.choice([None, 7]), r.choice([None, "", "Some Text", "ß A\x00B", "lower"])) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(7)
    assert found(merkle.audit(df, arity=arity)) == brute_manifest(rows, arity)


@pytest.mark.parametrize("groups", [1, 40])
def test_trees_over_any_number_of_groups(spark, groups):
    rows = [(i, f"s{i % groups}", None, i, str(i)) for i in range(groups)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert found(merkle.audit(df)) == brute_manifest(rows, 16)


def test_manifest_of_awkward_rows(awkward, none):
    rows = [tuple(r) for r in awkward.select(*merkle.COLUMNS).collect()]
    assert found(merkle.audit(awkward.select("doc_id", "source", "lang", "n_chars", "text", "id", "key", "root", "score"))) == brute_manifest(rows, 16)
    assert merkle.audit(none).count() == 0


def test_paths_lead_to_the_root_and_no_other_leaf_does(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.col("id").cast("string").alias("text"))
    m = merkle.manifest(df, ("doc_id", "text"))
    good = merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")
    bad = merkle.fold(F.sha2(F.lit("x"), 256), F.col("path")) == F.col("root")
    assert [tuple(r) for r in m.agg(F.count_if(good), F.count_if(bad)).collect()] == [(100, 0)]


def test_partial_parents_close_in_any_order():
    digests = [sha(str(i)) for i in range(37)]
    order = list(range(37))
    random.Random(1).shuffle(order)
    p = merkle.Parents(4, 37)
    for i in order:
        p.add(1, i // 4, [i % 4], [digests[i]])
    rows = p.rows(last=True)
    assert all(r[-1] for r in rows) and max(rows)[-1] == tree(digests, 4)[0]


def test_places_of_a_key_over_many_partitions(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("key"), F.col("id").alias("x"))
    got = {}
    for r in numbered(df, "key", "x").collect():
        got.setdefault(r["key"], []).append((r["pos"], r["x"], r["n"]))
    for rows in got.values():
        assert [p for p, _, _ in sorted(rows)] == list(range(len(rows))) and sorted(rows) == sorted(rows, key=lambda t: t[1]) and {n for _, _, n in rows} == {len(rows)}


# the filter audit


def failing(rows):
    """(part, id) rows with the set of failed filters each."""
    first = {}
    for d, _, text in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    out = []
    for d, part, text in rows:
        t = text or ""
        w = t.encode().split()
        f = {x for x, bad in zip("ABCD", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t))), strict=True) if bad}
        out.append((part or "", d, f | ({"E"} if d is not None and first[t] < d else set())))
    return out


def brute_audit(rows, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    out, shapley = [], {}
    for part in {p for p, _, _ in failing(rows)}:
        mine = [(d, f) for p, d, f in failing(rows) if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for i, x in enumerate(order):
                removed = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                shapley[part, x] = shapley.get((part, x), 0) + len(removed)
                all_ = sum(x in f for _, f in mine)
                out.append((part, "".join(order), i + 1, len(left), len(removed), all_ - len(removed), sum(f == {x} for _, f in mine), sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_swaps_visit_every_order_once():
    for k in range(1, 6):
        order = list(range(k))
        seen = [tuple(order)]
        for i in audit.adjacent_swaps(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(k)))


def test_the_walk_is_the_sum_over_masks():
    counts = np.random.default_rng(3).integers(0, 9, (3, 4, 32))
    names, at, kept, removed = audit.walk(counts, 5)
    for n, filters, k, r in zip(names, at, kept, removed, strict=True):
        seen = 0
        for step, f in enumerate(filters):
            before = counts[:, :, np.arange(32) & seen == 0].sum(-1)
            seen |= 1 << int(f)
            after = counts[:, :, np.arange(32) & seen == 0].sum(-1)
            assert (k[step] == after).all() and (r[step] == before - after).all() and n[step] == "ABCDE"[f]


LABELS = "doc_id bigint, quality int, toxic int"


def test_interactions_equal_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["Word", "UP", "low", "x#", "one", "two", f"w{i}"]) for i in range(n)) for n in (0, 3, 49, 50, 60, 80)] + ["\x0b \t", "ÀÉ a\x85b", None]
    rows = [(r.choice([i, i, i, None, 3]), r.choice(["s0", "s1", None, ""]), r.choice(texts)) for i in range(60)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 60, 2)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumns({"mask": F.lit(1), "n": F.lit(1), "good": F.lit(1), "digest": F.lit("x")}).repartition(5)
    assert sorted(map(tuple, audit.interactions(df, spark.createDataFrame(labels, LABELS)).collect())) == brute_audit(rows, labels)


def test_interactions_of_awkward_rows(spark, awkward, none):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (3, 1, 0), (7, 1, 1)], LABELS)
    rows = [tuple(r) for r in awkward.select("doc_id", "source", "text").collect()]
    assert sorted(map(tuple, audit.interactions(awkward, labels).collect())) == brute_audit(rows, [(3, 1, 1), (7, 1, 1)])
    assert audit.interactions(none, labels).count() == 0
    assert audit.interactions(awkward, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


# URL rules


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, default)


RULES = "host string, path string, verdict string"
URLS = [
    None, "", "no scheme.org/", "http://", "http:///es/1", "http://org", "http://org/", "HTTP://WWW.Example.ORG/es/", "https://a.b.example.org/es/12?x=1", "http://example.org/es", "http://example.org?x=/es/",
    "http://notexample.org/es/1", "http://example.org:80/es/", "http://u@example.org/es/1", "http://example.org./es/", "http://x.com/fr/de/", "http://com/de/#/fr/", "ftp://a://b.com/de/", "http://" + ".".join(["a"] * 300) + ".com/de/" + "y" * 5000,
    "http://ÉX.com/fr/é?", "http://example.org/en/1", "http://example.org/en/12/3", "http://example.org/en/\U0001f600", "http://.org/x", "http://example..org/es/",
]


def judged(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_url_rules_of_the_query(spark):
    from hornspark.llm.queries import URL_RULES

    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[7:9])], "page_id bigint, url string").withColumns({"id": F.lit("x"), "host": F.lit("x"), "key": F.lit(1), "verdict": F.lit(1)})
    got = judged(url_rules.judge(pages.repartition(4), spark.createDataFrame(URL_RULES, RULES)))
    assert got == sorted(repr((i, *brute_verdict(u, URL_RULES))) for i, u in enumerate(URLS + URLS[7:9]))
    assert url_rules.judge(pages.limit(0), spark.createDataFrame(URL_RULES, RULES)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_nested_rules_equal_brute_force(spark, seed):
    r = random.Random(seed)
    label = lambda: r.choice(["a", "b", "ab", "a-b", "é"])
    host = lambda n: ".".join(label() for _ in range(r.randint(1, n)))
    path = lambda n: "/" * r.randint(0, 1) + "".join(r.choice("ab/\u00ff") for _ in range(r.randint(0, n)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((host(2), path(4)) for _ in range(60))}.values())
    urls = [f"http://{host(4)}{'/' + path(6)}" for _ in range(300)] + ["http://a.b/ab/a"] * 150
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").repartition(6)
    table = spark.createDataFrame([*rules, ("", "/", "block"), (None, "/", "block")], RULES)
    assert judged(url_rules.judge(pages, table)) == sorted(repr((i, *brute_verdict(u, rules))) for i, u in enumerate(urls))


def test_rules_alike_and_none(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x"), (1, "http://a.b/x"), (None, "http://c/")], "page_id bigint, url string")
    alike = spark.createDataFrame([("B", None, "allow"), ("b", "", "block"), ("b", "/y", "allow")], RULES)
    assert judged(url_rules.judge(pages, alike)) == sorted(map(repr, [(1, "a.b", "/x", "b", "block")] * 2 + [(None, "c", "/", None, "allow")]))
    assert {r["verdict"] for r in url_rules.judge(pages, alike.limit(0), default="block").collect()} == {"block"}
