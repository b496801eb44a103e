"""Shards, languages, containment, near-duplicates, pages and the pipeline, against plain versions."""

import itertools
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hornspark.llm import containment, html, html_training, langid, sharding, simhash
from hornspark.llm.components import components

SF = "/root/testdata/sf0.001"


def test_shards_fit_their_limit(awkward, none):
    rows = sharding.extendible_shards(awkward, 2000).collect()
    assert len(rows) == awkward.count()
    size, names, pages = Counter(), set(), Counter()
    for r in rows:
        size[r["shard"]] += r["n_bytes"]
        pages[r["shard"], r["page"]] += r["n_bytes"]
        names.add(r["shard"])
        assert r["shard_bytes"] >= r["n_bytes"]
    assert all(size[r["shard"]] == r["shard_bytes"] for r in rows)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    alone = {(r["shard"], r["page"]) for r in rows if r["n_bytes"] > 2000}
    assert all(v <= 2000 or k in alone for k, v in pages.items())
    assert sharding.extendible_shards(none, 2000).count() == 0


def test_shards_of_one_key_overflow_into_pages(spark):
    df = spark.range(0, 400, 1, 4).select(F.lit(7).alias("doc_id"), F.lit("x" * 50).alias("text"))
    rows = sharding.extendible_shards(df.unionByName(df.limit(1).select("doc_id", F.lit("y" * 900).alias("text"))), 500).collect()
    pages = defaultdict(list)
    for r in rows:
        pages[r["page"]].append(r["n_bytes"])
    assert len(rows) == 401 and all(sum(v) <= 500 or v == [900] for v in pages.values()) and len(pages) < 80


def test_only_oversized_buckets_split(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("z" * 100).alias("text"))
    rows = sharding.extendible_shards(df, 20_000).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["n_bytes"]
    for a in size:  # two halves of a split would not have fitted together
        if a:
            up = a[:-1]
            assert sum(v for k, v in size.items() if k.startswith(up)) > 20_000


def plain_shards(rows, limit, bits=60):
    """Each row's bucket by splitting oversized buckets one bit at a time."""
    out, todo = {}, [(0, 0, rows)]
    while todo:
        depth, prefix, own = todo.pop()
        if sum(n for *_, n in own) <= limit or len({h for _, h, _ in own}) < 2:
            out |= {i: (depth, prefix) for i, *_ in own}
            continue
        for bit in (0, 1):
            half = [x for x in own if x[1] >> (bits - 1 - depth) & 1 == bit]
            if half:
                todo.append((depth + 1, prefix << 1 | bit, half))
    return out


def test_shards_that_take_several_passes(spark, monkeypatch):
    """One key holds a third of all bytes, and buckets need more bits than a pass plans."""
    monkeypatch.setattr(sharding, "_bits", lambda total, limit: 3)
    monkeypatch.setattr(sharding, "CHUNK", 2)
    rows = [(k, "z" * (k % 50)) for k in range(700)] + [(7, "y" * 60)] * 150
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", sharding.key_hash("doc_id").alias("h")).distinct().collect()}
    for limit in (1000, 200):
        want = plain_shards([(i, hashes[i], len(t)) for i, t in rows], limit)
        got = sharding.extendible_shards(df, limit).collect()
        assert len(got) == len(rows)
        for r in got:
            depth, prefix = want[r["doc_id"]]
            assert r["shard"] == (format(prefix, f"0{depth}b") if depth else "")
        assert max(len(r["shard"]) for r in got) > 3


def brute_marginals(psi, starts, move, begin):
    out = np.zeros_like(psi)
    bounds = [*np.flatnonzero(starts), len(psi)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        n, k = hi - lo, psi.shape[1]
        for labels in np.ndindex(*[k] * n):
            w = begin[labels[0]] * np.prod([psi[lo + t, y] for t, y in enumerate(labels)]) * np.prod([move[a, b] for a, b in zip(labels, labels[1:], strict=False)])
            for t, y in enumerate(labels):
                out[lo + t, y] += w
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_in_blocks_is_exact():
    r = np.random.default_rng(0)
    sizes = [1, 5, 3, 7, 2, 1]
    starts = np.zeros(sum(sizes), bool)
    starts[np.cumsum([0, *sizes[:-1]])] = True
    psi, move, begin = r.random((sum(sizes), 3)) + 0.01, r.random((3, 3)) + 0.01, r.random(3) + 0.01
    want = brute_marginals(psi, starts, move, begin)
    for block in (1, 2, 4, 128):
        assert np.allclose(langid.forward_backward(psi, starts, move, begin, block), want)


def test_languages_are_learned_from_the_rest_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, docs_per_lang=60)
    rows = langid.predict(docs, model, keep=("doc_id", "lang")).withColumn("held", langid.held_out()).collect()
    held = [r for r in rows if r["held"]]
    assert 150 < len(held) < 350
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    swapped = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert langid.train(swapped, docs_per_lang=60).labels == model.labels


def test_code_switched_words_are_labelled_each(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, docs_per_lang=60)
    by = {r["lang"]: langid.words_of(r["text"])[:40] for r in docs.where(F.length("text") > 500).collect()}
    chain = by["en"] + by["fr"] + by["de"]
    got = [model.labels[i] for i in langid.Tagger(model).marginals([chain]).argmax(axis=1)]
    assert np.mean([a == b for a, b in zip(got, ["en"] * 40 + ["fr"] * 40 + ["de"] * 40, strict=True)]) > 0.9


def test_languages_of_awkward_rows(awkward, none):
    out = langid.predict(awkward, langid.train(awkward)).collect()
    assert len(out) == awkward.count()
    for r in out:
        if r["doc_id"] in (0, 1, 2, 9):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    model = langid.train(none)
    assert model.labels == [] and langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(awkward, model).collect()} == {"und"}


def test_every_part_of_a_long_run_of_letters_counts():
    ends = "a" * 40
    one, other = (langid.words_of(f"{ends}{mid * 10}{ends}") for mid in ("bcd", "xyz"))
    assert one != other and "".join(one) == ends + "bcd" * 10 + ends
    assert [langid.features(w, {}) for w in one] != [langid.features(w, {}) for w in other]


def test_every_language_is_sampled(spark):
    r = random.Random(0)
    rows = []
    for lang in range(70):
        letters = "".join(r.sample("abcdefghijklmnopqrstuvwxyz", 6))
        rows += [(lang * 100 + k, " ".join("".join(r.choices(letters, k=5)) for _ in range(30)), f"l{lang}") for k in range(3)]
    got = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    may = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert {lang for lang, _ in got} == may and len(may) > 64
    model = langid.fit(got, sequences=8)
    assert model.weights.shape == (langid.DIMENSIONS, len(may)) and set(model.labels) == may


def made_languages(count, family=5, common=0.6):
    """Speakers of languages whose words are made of their syllables; those of a family share most words."""
    def words(seed, n):
        q = random.Random(seed)
        first, mid = q.sample("bcdfghjklmnpqrstvwxz", 12), q.sample("aeiouy", 4)
        parts = [a + b + c for a in first for b in mid for c in ("", *q.sample(first, 3))]
        return ["".join(q.choices(parts, k=q.choice((1, 2, 2, 3)))) for _ in range(n)]

    say = random.Random(5)
    shared = {i: words(f"family {i}", 2000) for i in range(-(-count // family))}
    found = []
    for i in range(count):
        own, q = words(f"own {i}", 2000), random.Random(i)
        vocabulary = [a if q.random() < common else b for a, b in zip(shared[i // family], own, strict=True)]
        found.append(lambda n, v=vocabulary: say.choices(v, [1 / (j + 1) for j in range(len(v))], k=n))
    return found


def test_seventy_languages_are_told_apart():
    says = made_languages(70)
    model = langid.fit([(f"l{i:02}", say(n)) for i, say in enumerate(says) for n in (20, 60, 200) * 15], sequences=40)
    texts = [(f"l{i:02}", " ".join(say(40))) for i, say in enumerate(says) for _ in range(4)]
    out = langid.Tagger(model)([t for _, t in texts])
    assert np.mean([a == b for (a, _), b in zip(texts, out["lang_pred"], strict=True)]) >= 0.97


def test_chains_side_by_side_are_exact():
    r = np.random.default_rng(1)
    k = langid.FEW + 4
    model = langid.Model([f"l{i:02}" for i in range(k)], {}, r.normal(size=(langid.DIMENSIONS, k)).astype(np.float32), r.normal(size=(k, k)), r.normal(size=k))
    words = ["".join(chr(97 + int(x)) for x in r.integers(0, 26, 4)) for _ in range(300)]
    chains = [[words[int(i)] for i in r.integers(0, 300, n)] for n in (1, 250, 7, 7, 120, 2)] * 15
    tagger = langid.Tagger(model)
    rows = np.split(tagger.marginals(chains), np.cumsum([len(c) for c in chains])[:-1])
    want = np.array([x.mean(axis=0) for x in rows])
    assert np.allclose(tagger.shares(chains), want)
    falling = sorted(range(6), key=lambda i: -len(chains[i]))
    for cells in (1, 700, 5000):  # pieces of a word, some and many; a cache that overflows
        got = langid.Tagger(model, cache=40).side_by_side([chains[i] for i in falling], cells)
        assert np.allclose(got, [rows[i].sum(axis=0) for i in falling])


def test_expected_counts_of_transitions():
    r = np.random.default_rng(2)
    psi, move, begin = r.random((2, 4, 3)) + 0.1, r.random((3, 3)) + 0.1, r.random(3) + 0.1
    gamma, pairs = langid.expected(psi, move, begin)
    want = np.zeros((3, 3))
    for row, found in zip(psi, gamma, strict=True):
        assert np.allclose(found, brute_marginals(row, np.arange(4) == 0, move, begin))
        weight = {y: begin[y[0]] * np.prod([row[t, y[t]] for t in range(4)]) * np.prod([move[y[t], y[t + 1]] for t in range(3)]) for y in itertools.product(range(3), repeat=4)}
        for y, w in weight.items():
            for t in range(3):
                want[y[t], y[t + 1]] += w / sum(weight.values())
    assert np.allclose(pairs, want)


def test_pipeline_drops_documents_of_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {r["lang"]: langid.words_of(r["text"])[:400] for r in docs.where(F.length("text") > 4000).collect()}
    even = " ".join(w for lang in ("de", "en", "es", "fr") for k in range(0, 400, 40) for w in by[lang][k : k + 40])
    extra = spark.createDataFrame([(10**9 + 1, even), (10**9 + 2, "12 34 !?"), (10**9 + 3, None), (10**9 + 4, " ".join(by["es"]))], "doc_id long, text string")
    kept = corpus_pipeline.known_language(spark, docs.unionByName(extra, allowMissingColumns=True), SF)
    gone = {r["doc_id"] for r in docs.unionByName(extra, allowMissingColumns=True).select("doc_id").subtract(kept.select("doc_id")).collect()}
    assert gone == {10**9 + 1, 10**9 + 2, 10**9 + 3}


def plain_contained(docs, items, threshold=0.8):
    out = set()
    for i, t in items:
        w = containment.words_of(t)
        if not w:
            continue
        m = min(5, len(w))
        own = set(zip(*(w[k:] for k in range(m)), strict=False))
        for d, text in docs:
            v = containment.words_of(text)
            n = len(own & set(zip(*(v[k:] for k in range(m)), strict=False)))
            if n >= threshold * len(own) - 1e-9:
                out.add((d, i, len(own), n))
    return out


def test_containment_equals_brute_force(spark):
    r = random.Random(4)
    word = lambda: r.choice("abcdefghijklmnop") * r.randint(1, 3)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 20, 40, 60, 100, 30, 30])] + [(50, None), (51, ""), (52, "!!"), (7, "Twice TWICE twice twice twice twice")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(r.randint(0, 200))]
        _, t = r.choice(items[:13])
        part = t.split()
        for _ in range(r.randint(0, 3)):  # altered a little
            part[r.randrange(len(part))] = "zzz"
        at = r.randint(0, len(w))
        docs.append((d, " ".join(w[:at] + part + w[at:]).upper() + "."))
    docs += [(500, None), (501, ""), (502, "twice twice twice twice twice"), (503, " ".join(t for _, t in items if t))]
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = plain_contained(docs, items)
    for block in (200_000, 60):  # all at once, and in several passes
        rows = containment.contained(a, b, block_shingles=block).collect()
        assert {(x["doc_id"], x["item_id"], x["n_shingles"], x["n_shared"]) for x in rows} == want and len(rows) == len(want)
        clean = containment.without_contained(a, b, block_shingles=block)
        assert sorted(x["doc_id"] for x in clean.collect()) == sorted({d for d, _ in docs} - {d for d, *_ in want})


def test_containment_of_awkward_rows(spark, awkward, none):
    items = spark.createDataFrame([(1, "the cat and the dog went to the market with some"), (1, "the cat and the dog went to the market with some"), (None, "no id here at all but some")], "item_id bigint, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in containment.contained(awkward, items).collect())
    assert got == {(3, 1): 4, (4, 1): 2, (6, 1): 2, (7, 1): 2, (None, None): 1}
    assert containment.contained(none, items).count() == 0 and containment.contained(awkward, items.limit(0)).count() == 0
    kept = containment.without_contained(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 6


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius=2):
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_spark_hash_agree(spark):
    texts = [None, "", "One", "one two", "a b c d", "É x y z", "w " * 500]
    assert [int(x) for x in simhash.fingerprints_of(texts)] == [plain_fingerprint(t) for t in texts]
    native = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_bk_tree_finds_all_and_only_the_near(spark):
    r = np.random.default_rng(2)
    v = r.integers(0, 2**12, 300, dtype=np.uint64)
    v = np.unique(v)
    found = {(int(v[n]), int(v[q])) for n, near in simhash.BKTree(v).search(v, 2) for q in near}
    assert found == {(int(a), int(b)) for a in v for b in v if (int(a) ^ int(b)).bit_count() <= 2}


def clustered(n, seed=0):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, n, dtype=np.uint64)
    one = lambda: np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    return np.unique(np.concatenate([base, base ^ one(), base ^ one() ^ one(), base ^ one() ^ one() ^ one(), base ^ one() ^ one() ^ one() ^ one()]))


def test_links_connect_what_brute_force_does(spark):
    v = clustered(60)
    want = plain_components([int(x) for x in v])
    nodes = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp bigint")
    for tree_nodes in (8192, 2):  # whole shards, and shards dealt over many trees
        edges = simhash.links(nodes, 2, tree_nodes)
        root = {r["node"]: r["root"] for r in components(edges).collect()}
        got = [root.get(int(x), int(x)) for x in v.view(np.int64)]
        pairs = lambda c: {(i, j) for i in range(len(c)) for j in range(i) if c[i] == c[j]}
        assert pairs(got) == pairs(want)


def test_components_of_long_paths_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300), (400, 401), (401, 400)]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {400: 400, 401: 400}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_of_awkward_rows(awkward, none):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    texts = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    fp = [plain_fingerprint(t) for _, t in texts]
    comp = plain_components(fp)
    least = {}
    for (i, _), c in zip(texts, comp, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = Counter((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(texts, fp, comp, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == want
    assert simhash.near_duplicates(none).count() == 0


def test_one_document_of_each_group_stays(awkward, none):
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    assert Counter(ids) == Counter({0: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, None: 1}) and [r["text"] for r in rows if r["doc_id"] is None][0].startswith("no id")
    assert simhash.one_of_each(none).count() == 0


def test_main_text_of_made_up_pages():
    model = html_training.train()
    maker = html_training.Maker(999)
    pages = [maker.page() for _ in range(150)]
    got = model([p.replace(html_training.MARK, "") for p in pages])
    assert np.mean([a == html_training.truth(p) for a, p in zip(got, pages, strict=True)]) > 0.93


def test_decoding_is_the_best_consistent_choice():
    maker, r = html_training.Maker(4), random.Random(4)
    tried = 0
    while tried < 15:
        nodes = html.parse(maker.page().replace(html_training.MARK, ""))
        nodes = nodes[:13]
        for n in nodes:
            n.children = [c for c in n.children if c in nodes]
        logits = [r.uniform(-3, 3) for _ in nodes]
        index = {id(n): i for i, n in enumerate(nodes)}
        dead = [n.unseen or not n.total for n in nodes]
        best = max(
            sum(logits[i] for i in range(1, len(nodes)) if bits >> i & 1)
            for bits in range(1, 1 << len(nodes), 2)
            if all(not bits >> i & 1 or not dead[i] and bits >> index[id(n.parent)] & 1 for i, n in enumerate(nodes) if i)
        )
        keep = html.chosen(nodes, logits)
        assert all(keep[index[id(n.parent)]] for n, k in zip(nodes, keep, strict=True) if k and n.parent)
        assert abs(sum(x for x, k in list(zip(logits, keep, strict=True))[1:] if k) - best) < 1e-9
        tried += 1


def test_pages(spark):
    model = html_training.train()
    page = '<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One  two\n three.<p>Four <b>five</b>.</article><div class="comments"><p>Nice!</p></div><footer>&copy; x</footer>'
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>" * 3000 + "deep"), (None, "x", "<!-- only --><script>x()</script>"), (5, "y", "<" * 1000), (6, "z", "<div>" * 3000 + "deep text")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = {r["url"]: r for r in html.extract(df, model).collect()}
    assert got["u"]["text"] == "A & B\nOne two three.\nFour five." and got["u"]["n_chars"] == 31
    assert got[None]["text"] == "" and got["v"]["n_chars"] == 0 and got["x"]["text"] == ""
    assert html.extract(df.limit(0), model).count() == 0


def test_broken_pages_take_linear_time():
    n = 50_000
    start = time.time()
    for page in ("<div>" * n + "</section>" * n, "<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<div>" * n + "<p>" * 100, "<section><div>" * n + "<li>" * n):
        html.parse(page)
    assert time.time() - start < 30


def test_formulas_are_part_of_the_text():
    model = html_training.train()
    words = "The sum of the first numbers, which is shown here, grows with their square, as has been known for long. "
    formula = '<span class="katex"><math><semantics><mrow><mi>S</mi><mo>=</mo><mn>42</mn></mrow><annotation encoding="application/x-tex">S=42</annotation></semantics></math><span aria-hidden="true">S=42</span></span>'
    page = f'<html><body><nav><a href="/">Home</a></nav><article><h1>Sums</h1><p>{words * 3}Here {formula} holds.</p><p>{words * 3}</p></article></body></html>'
    assert "Here S=42 holds." in model([page])[0] and model([page])[0].count("42") == 1


def test_data_pages_give_their_articles(spark):
    import re
    from html import unescape

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = html_training.train()([r["html"] for r in rows])
    for r, text in zip(rows, got, strict=True):
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert text == "\n".join(b for b in blocks if b)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if langid.words_of(r["text"]))
    least = least_of_similar([t for _, t in rows])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stay = {rows[k][0] for k in least}
    stay -= {d for d, *_ in plain_contained([x for x in rows if x[0] in stay], items)}
    assert {r["doc_id"] for r in out} == stay and all(r["lossless"] and len(r["token_ids"]) == r["n_tokens"] for r in out)


def test_pipeline_stages_take_awkward_rows(spark, awkward, none):
    for rows in (awkward, none):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF)
            if name != "bpe_encoding":
                assert docs.columns == before.columns
                docs = docs.cache()
        assert docs.count() <= rows.count()


def edited_copies(seed=0):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    texts = []
    for n in [5, 8, 20, 21, 40, 80, 150, 300, 900] * 3:
        w = r.choices(vocabulary, k=n)
        texts.append(" ".join(w))
        for edits in (1, 1, 2, 3, 6, n // 50, n // 40):
            copy = list(w)
            for at in r.sample(range(n), min(edits, n)):
                copy[at] = r.choice(vocabulary)
            texts.append(" ".join(copy if r.random() < 0.7 else copy[: n - n // 12]))
            if r.random() < 0.4:
                w = copy  # a chain of edits
    return [*texts, *texts[:20], texts[0].upper(), "", " ", None]


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def least_of_similar(texts):
    sets = [shingle_set(t) for t in texts]
    least = list(range(len(sets)))
    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            if x == y or len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((least[a], least[b]))
                least = [p if z == q else z for z in least]
    return least


def test_similar_documents_are_those_of_brute_force(spark):
    texts = edited_copies()
    expected = least_of_similar(texts)
    assert len(set(expected)) < len({shingle_set(t) for t in texts}) - 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in corpus_pipeline.one_of_near_duplicates(spark, df, SF).collect()} == set(expected)


def test_split_shards_give_the_same_groups(spark):
    """Shards dealt over many trees, and groups whose first links fail, end in the groups of brute force."""
    texts = [t for t in dict.fromkeys(edited_copies(1)) if t and t.strip()]
    rows = simhash.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=("doc_id", "text")).dropDuplicates(["fp"]).cache()
    ids = {r["fp"]: r["doc_id"] for r in rows.collect()}
    expected = least_of_similar(texts)
    for tree_nodes in (1 << 14, 3):
        edges = simhash.similar_links(rows.drop("doc_id", "text"), lambda ends: rows.select("fp", "text").join(ends, "fp", "left_semi"), tree_nodes)
        root = {r["node"]: r["root"] for r in components(edges).collect()}
        groups = defaultdict(set)
        for fp, i in ids.items():
            groups[root.get(fp, fp)].add(expected[i])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({expected[i] for i in ids.values()})


def test_recall_of_similar_documents(spark):
    """Every document whose id 20 divides against all: pairs of an exact Jaccard similarity of 0.8 are in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = {r["doc_id"]: set(simhash.shingle_set(r["text"]).tolist()) for r in rows}
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    pairs = [(a, b) for a in sets if a % 20 == 0 and sets[a] for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    assert pairs and sum(group[a] == group[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_sets_that_share_half_of_their_digest_stay_apart(spark):
    texts = ["one two three", "one two three", "four five six", "seven eight nine", None]
    rows = simhash.sketches(spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, text string, mark long"), keep=("id", "mark"))
    clashing = rows.withColumn("fp", F.when(F.col("id") < 3, 7).otherwise(F.col("fp")).cast("bigint")).cache()
    found, nodes = simhash.apart(clashing)
    fp = {r["id"]: r["fp"] for r in found.collect()}
    assert fp[0] == fp[1] and len(set(fp.values())) == 4 and 7 in (fp[0], fp[2])
    assert {(r["least"], r["one"]["mark"]) for r in nodes.collect()} == {(0, 0), (2, 2), (3, 3), (4, 4)}


def test_near_misses_are_verified_in_their_shards():
    """Texts just below the similarity are candidates but no links; the one link among them is found."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[: 60 - k]) + " " + " ".join(f"x{i}y{k}" for i in range(9)) for k in range(4)]
    texts.append(texts[2] + " tail")
    r.shuffle(texts)
    sets = [simhash.shingle_set(t) for t in texts]
    rows = np.array([[1, 0, 0, 0, i, len(u), int(np.uint64(simhash.simhash_of(u.astype(">u8"))).view(np.int64)), *simhash.bands_of(u)[1].view(np.int64)] for i, u in enumerate(sets)])
    _, a, b = simhash.forest(rows, texts)
    similar = {frozenset((i, j)) for i in range(5) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert {frozenset(x) for x in zip(a, b, strict=True)} == similar and len(similar) == 1
    key, a, b = simhash.forest(rows)
    assert len(a) > 1
    # another shard with the same members names the same trees
    again = rows[::-1].copy()
    again[:, 0] = 2
    assert set(simhash.forest(again)[0]) == set(key)


def test_one_set_against_many_equals_pairs():
    """Sets held against many at once, empty ones and repeats among them, give what pair by pair gives."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    texts = ["", None, *(" ".join(r.choices(words[: r.choice((2, 12))], k=r.randrange(1, 40))) for _ in range(60))]
    texts += [f"{t} end" for t in texts[2:20]] + texts[2:10]
    sets = [simhash.shingle_set(t) for t in texts]
    held = simhash.ShingleSets(sets)
    found = 0
    for one in range(len(sets)):
        others = np.delete(np.arange(len(sets)), one)
        similar = held.similar(one, others).tolist()
        assert similar == [simhash.similar_sets(sets[one], sets[k]) for k in others]
        found += sum(similar)
    assert found > 50
