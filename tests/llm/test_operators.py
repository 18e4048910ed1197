"""Each operator on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.llm import decontaminate, lang_id, line_dedup, minhash, mixing, quality_classifier, quality_rules, token_output, url_filter, warc

DOCS = "doc_id bigint, text string, lang string, source string, n string, rep string, id string"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghijklm") for _ in range(RNG.randint(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, share, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    base = prose(120, 1)
    out = [(i, prose(60, 100 + i)) for i in range(30)] + [(100 + i, base) for i in range(20)] + [(200 + i, edited(base, 0.02, i)) for i in range(40)]
    out += [(300 + i, edited(base, 0.05, i)) for i in range(40)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one Two"), (404, "ONE two"), (405, prose(30_000, 9)), (406, "a b c d e"), (406, "a b c d e"), (None, base), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 3}", "n", "rep", "id") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(docs, rows, percent):
    sets, up = [(i, shingles(t)) for i, t in rows], {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    want = sorted(((i, len(s), None if i is None else find(i), i is None or i == find(i)) for i, s in sets), key=repr)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, percent=percent).collect()), key=repr)
    assert got == want


def test_members_apart_from_their_leader_are_linked(spark, monkeypatch):
    """Texts on one form, too far from one another to be linked, and near pairs among them, which no leader sees."""
    form, texts = prose(45, 70).split(" "), []
    for i in range(160):
        own = prose(25, 700 + i).split(" ")
        texts.append(" ".join(form + own))
        if i % 16 == 0:
            texts.append(" ".join(form + own[:-1] + [f"y{i}"]))
    sets = [shingles(t) for t in texts]
    near = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert len(near) == 10  # each pair is a component
    want = {i: i for i in range(len(texts))} | dict(near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    blocks, real = [], minhash._block_links
    monkeypatch.setattr(minhash, "_block_links", lambda *a: blocks.append(1) or real(*a))
    for small in (minhash.SMALL_BUCKET, 1):  # with 1, fine buckets have leaders too, and blocks decide what those leave apart
        monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, percent=85).collect()} == want
    assert blocks == [1]


def test_groups_are_made_anew_only_for_new_links(spark, monkeypatch):
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(x if r.random() > 0.03 else f"v{k}x{i}" for i, x in enumerate(base))) for k in range(60)]  # close, but under the threshold
    calls, real = [], minhash.connected_components
    monkeypatch.setattr(minhash, "connected_components", lambda links: calls.append(links.count()) or real(links))
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 1)
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(116)} for k, t in rows}
    linked = any(100 * len(sets[a] & sets[b]) >= 95 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=95)
    assert not linked and all(x.kept for x in got.collect())
    assert calls == [0]


def test_fine_bands_are_shared_by_near_sets_only():
    r, hits = np.random.default_rng(3), []
    for shared, own in ((850, 75), (600, 200)):
        a = r.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
        x, y = (minhash.sketch(np.unique(p), minhash.FINE) for p in (a[: shared + own], np.concatenate([a[:shared], a[shared + own :]])))
        assert len(x) == minhash.FINE.bins and abs((x == y).mean() - shared / (shared + 2 * own)) < 0.08
        hits.append(int((minhash.FINE.keys([x]) == minhash.FINE.keys([y])).sum()))
    assert hits[0] >= 5 and hits[1] <= 4
    tiny = minhash.sketch(np.array([7], dtype=np.uint64), minhash.FINE)  # filled in the forced rounds
    assert (tiny > 0).all()


def test_one_of_each_stays(docs, empty):
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[100] == 1 and ids[406] == 1 and ids[None] == 2 and 101 not in ids
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_estimates_similarity():
    r = np.random.default_rng(0)
    for shared, own in ((900, 50), (3, 1), (500, 500)):
        a = r.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
        x, y = (minhash.sketch(np.unique(p)) for p in (a[: shared + own], np.concatenate([a[:shared], a[shared + own :]])))
        assert abs((x == y).mean() - shared / (shared + 2 * own)) < 0.2


def test_url_rules(spark):
    rules = spark.sql("VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('com', '/de/', 'block'), ('com', '/de/', 'block'), (NULL, '/', 'block') AS r(host, path, verdict)")
    urls = ["https://A.Example.ORG/es/1?x", "http://example.org", "http://notexample.org/es/", "x.com/de/", None, "ftp://q.com/de/#a", "http://com/d", "a://b://c"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "", None, "allow")
    assert got[2] == ("notexample.org", "/es/", "org/", "allow") and got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("q.com", "/de/", "com/de/", "block") and got[6][2] is None and got[7][:2] == ("b:", "//c")
    assert url_filter.filter_urls(pages, rules.filter("false")).filter("verdict = 'allow'").count() == len(urls)
    assert url_filter.filter_urls(pages.filter("false"), rules).count() == 0


def test_language_id(spark, docs, empty):
    words = {"en": "the of and with that", "de": "der und nicht schön für"}
    rows = [(i, " ".join(random.Random(i).choices(words[k].split(), k=120)), k) for i, k in enumerate(["en", "de"] * 60)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = lang_id.train_language_id(labelled.filter(~lang_id.held_out()))
    held = lang_id.identify_languages(labelled.filter(lang_id.held_out()), net)
    assert held.count() and held.filter("lang <> lang_pred").count() == 0
    got = {r.doc_id: r for r in lang_id.identify_languages(docs, net).filter("doc_id >= 400").collect()}
    assert [got[i].lang_pred for i in (400, 401, 402)] == ["und"] * 3 and got[405].lang_pred != "und" and 0 <= got[405].score <= 1
    assert lang_id.train_language_id(empty) is None
    assert lang_id.identify_languages(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert lang_id.identify_languages(empty, net).count() == 0


def test_windows_score_whole_texts():
    import pyarrow as pa

    net = lang_id.ByteConvNet.train(np.array([[97] * 256, [98] * 256] * 40, dtype=np.uint8), ["a", "b"] * 40)
    p = net.text_scores(pa.array(["a" * 300 + "b" * 30_000, "a" * 70_000, None, "", "b"]))
    assert p[0].argmax() == 1 and p[1].argmax() == 0 and np.allclose(p.sum(axis=1), 1)


def test_mixing_matches_brute_force(spark, docs, empty):
    assert mixing.share_out(100, [(1, 10), (1, 100), (2, 20)]) == [10, 70, 20]
    assert mixing.share_out(100, [(1, 5), (0, 50)]) == [5, 0]
    plan = mixing.plan_budgets({("d", "a", "s"): 10, ("d", "b", "s"): 100, ("e", "a", "s"): 100}, {("d",): 1.0, ("e",): 1.0}, 100, 1)
    assert plan == {("d", "a", "s"): 10, ("d", "b", "s"): 40, ("e", "a", "s"): 50}
    rows = docs.filter("doc_id IS NULL OR doc_id <> 405")
    got = mixing.mix_sources(rows, F.lit("d"), {}, 0.7, 2, 3).collect()
    total = sum(len(re.findall(mixing.WORD, r.text or "")) for r in rows.collect())
    assert sum(r.mix.taken for r in got) == int(0.7 * total)
    by_leaf = defaultdict(list)
    for r in got:
        by_leaf[r.lang, r.source].append(r)
    sizes = Counter()
    for r in rows.collect():
        sizes[r.lang, r.source] += len(re.findall(mixing.WORD, r.text or ""))
    budgets = mixing.plan_budgets({("d", *k): v for k, v in sizes.items()}, {}, int(0.7 * total), 2)
    assert {k: sum(r.mix.taken for r in v) for k, v in by_leaf.items()} == {k[1:]: b for k, b in budgets.items() if b}
    assert all(sum(r.mix.taken < r.mix.n_tokens for r in v) <= 1 for v in by_leaf.values())
    assert mixing.mix_sources(empty, F.lit("d"), {}).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_feistel_is_a_permutation(n):
    p = token_output.Feistel(n, 9)
    s = p.slot(np.arange(n))
    assert sorted(s) == list(range(n)) and (p.number(s) == np.arange(n)).all()


def test_token_shards_round_trip(docs, empty, tmp_path):
    out = f"file://{tmp_path}/shards"
    rows = token_output.write_training_order(docs, out, key=4, seq_len=64, shard_bytes=4096).collect()
    n = len(rows)
    data = token_output.read_sequences(out, 0, n + 5, seq_len=64, shard_bytes=4096)
    assert sorted(r.slot for r in rows) == list(range(n)) and len(data) == n
    with open(token_output.VOCABULARY, "rb") as f:
        enc = token_output._encoder(f.read())
    texts, now = [], []
    for t in data[token_output.Feistel(n, 4).slot(np.arange(n))].ravel().tolist():
        if t != token_output.END:
            now.append(t)
        elif now:
            texts.append(enc.decode(now))
            now = []
    assert Counter(texts) == Counter(r.text for r in docs.collect() if r.text)
    assert (token_output.read_sequences(out, 40, 3, seq_len=64, shard_bytes=4096) == data[40:43]).all()
    assert token_output.write_training_order(empty, f"file://{tmp_path}/none").count() == 0
    long = "ab 1.  cd" * 200_000
    assert "".join(token_output.text_parts(long)) == long and [x for p in token_output.text_parts(long) for x in enc.encode_ordinary(p)] == enc.encode_ordinary(long)


def statistics(text):
    text = text or ""
    w = re.findall(quality_rules.WORD, text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(quality_rules.WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(quality_rules.SYMBOLS, text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, empty):
    texts = [prose(50, i) for i in range(60)] + [" ".join(x + "###" for x in prose(50, 100 + i).split()) for i in range(60)] + [None, "", "é $ \x0b%", "a b c d e f " * 9, "l1 w\nl1 w\n\nl1 w ", "a a a a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 60), None) for i in range(120)] + [(None, 0, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    judged = {r.doc_id: r for r in quality_rules.judge_quality(docs, labels).collect()}
    for i, t in enumerate(texts):
        r = judged[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(t), i
    assert all(judged[i].kept == (i < 60) for i in range(120)) and not judged[120].kept and judged[123].base_failed
    assert quality_rules.judge_quality(docs, labels.filter("false")).filter("kept").count() == 120
    assert quality_rules.judge_quality(empty, labels).count() == 0


def test_warc(spark):
    rows = [(5, "http://a/b?c", "x"), (3, "http://q", "x"), (3, "http://q", "x"), (7, None, None), (9, "u\r\nv", ""), (1, "http://é/", "é" * 70_000), (None, "z", "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(map(tuple, warc.page_captures(pages).collect()), key=repr)
    digest = lambda h: warc.base32_sha1((h or "").encode())
    want = [(i, len((h or "").encode()), digest(h), "revisit" if i in (5, 9) else "response", {5: 3, 9: 7}.get(i)) for i, _, h in rows]
    assert got == sorted(want, key=repr)
    manifest = warc.write_archives(pages)
    records = warc.read_archives(manifest.df)
    assert records.count() == 3 * len(rows) and records.filter("NOT digest_ok").count() == 0
    one = {r.uri: r for r in warc.assemble(records).filter("type = 'response'").collect()}
    assert bytes(one["http://é/"].payload).decode() == "é" * 70_000 and one["http://q"].request.fields["Host"] == "q"
    alone = warc.assemble(records.filter("type = 'response'")).collect()
    assert len(alone) == 5 and all(r.request is None for r in alone)
    assert warc.page_captures(pages.filter("false")).count() == 0


def test_perplexity(spark, empty):
    good, bad = [prose(80, i) for i in range(40)], ["".join(random.Random(i).choices("zqxwvy#%&", k=400)) for i in range(10)]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)] + [(50, None, "en"), (51, "", None), (52, prose(80, 7), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(50)] + [(None, 1, 0), (52, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify_quality(docs, labels).collect()}
    assert [got[i].kept for i in range(53)] == [True] * 40 + [False] * 12 + [True] and got[50].perplexity is None
    assert quality_classifier.classify_quality(docs, labels.filter("false")).filter("kept").count() == 51
    assert quality_classifier.classify_quality(empty, labels).count() == 0


def test_kneser_ney_matches_brute_force(spark):
    texts, order, base = [prose(30, i) for i in range(6)] + ["A1 é!", "", None], 4, quality_classifier.BASE
    model = quality_classifier.train_kneser_ney(spark.createDataFrame([(t,) for t in texts], "text string"), order=order)
    counts = {order: Counter()}
    for t in filter(None, texts):
        symbols = (quality_classifier.START,) * (order - 1) + tuple(t.encode())
        counts[order].update(symbols[i : i + order] for i in range(len(symbols) - order + 1))
    for w in range(order - 1, 0, -1):
        counts[w] = Counter(g[1:] for g in counts[w + 1])

    def discount(w, n):
        t = Counter(counts[w].values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
        k = min(n, 3)
        return min(0.95 * k, max(0.05, k - (k + 1) * y * t[k + 1] / t[k])) if t[k] else 0.5 * k

    def probability(g):
        if not g:
            return 1 / base
        same = {x: n for x, n in counts[len(g)].items() if x[:-1] == g[:-1]}
        total, shorter = sum(same.values()), probability(g[1:])
        if not total:
            return shorter
        left = sum(discount(len(g), n) for n in same.values())
        return max(0, same.get(g, 0) - discount(len(g), same.get(g, 0)) if g in same else 0) / total + left / total * shorter

    seen = sorted(counts[order])[:: len(counts[order]) // 20]
    asked = {(*g[:-1], s) for g in [*seen, (5, 9, 9, 0), (40, 40, 40, 40)] for s in range(base)}
    number = lambda g: sum(s * base ** (order - 1 - i) for i, s in enumerate(g))
    got = {r.gram: r.p for r in model.probabilities(spark.createDataFrame([(number(g),) for g in asked], "gram bigint")).collect()}
    assert len(got) == len(asked)
    sums = defaultdict(float)
    for g in asked:
        assert got[number(g)] == pytest.approx(probability(g), rel=1e-9)
        sums[g[:-1]] += got[number(g)]
    assert all(s == pytest.approx(1) for s in sums.values())  # every context gives a distribution


def test_perplexity_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(quality_classifier, "TALLY", 100)
    rows = [(i, prose(5 + i, i), "en") for i in range(40)] + [(40, None, "en"), (41, "", None), (42, prose(3000, 1), "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = quality_classifier.train_kneser_ney(docs.filter("doc_id < 20"), order=3)
    got = {r.doc_id: r.perplexity for r in quality_classifier.perplexities(docs, model).collect()}
    held = {}
    for i, t, _ in rows:
        data = np.frombuffer((t or "").encode(), dtype=np.uint8)
        held[i] = quality_classifier.grams(data, np.array([0, len(data)]), 3)[0].tolist()
    every = spark.createDataFrame([(g,) for g in sorted({g for v in held.values() for g in v})], "gram bigint")
    logs = {r.gram: np.log(r.p) for r in model.probabilities(every).collect()}
    for i, t, _ in rows:
        assert got[i] is None if not t else got[i] == pytest.approx(np.exp(-np.mean([logs[g] for g in held[i]])), rel=1e-5)


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row, last = [i], row
        for j, b in enumerate(text, 1):
            row.append(min(last[j - 1] + (a != b), last[j] + 1, row[j - 1] + 1))
    return min(row)


def test_decontamination(spark, empty):
    items = [prose(12, 900 + i) for i in range(4)]
    near = list(items[1])
    near[10], near[40] = "#", ""
    texts = [prose(30, 1) + "\n" + items[0].upper().replace(" ", "  ") + " " + prose(9, 2), prose(20, 3) + " " + "".join(near), items[2][:40] + prose(20, 4), prose(50, 5), None, "", items[0] * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, " ")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_benchmark(docs, bench).collect()}
    norm = decontaminate.normalise
    want = {(i, k): d for i, t in enumerate(texts) for k, x in enumerate(items) if norm(t) and (d := distance(norm(x), norm(t))) <= len(norm(x)) * 8 // 100}
    assert got == want and {(0, 0), (1, 1), (6, 0)} <= set(got)
    for seed in range(60):
        r = random.Random(seed)
        a, b = ("".join(r.choices("abc", k=k)) for k in (r.randint(1, 12), r.randint(0, 20)))
        assert decontaminate.best_match(a, b)[0] == distance(a, b)
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.find_benchmark(empty, bench).count() == 0 == decontaminate.find_benchmark(docs, bench.filter("false")).count()


def test_rows_are_judged_apart_from_their_ids(spark, monkeypatch):
    item, other = prose(12, 950), prose(12, 951)
    texts = [(None, prose(20, 1) + " " + item), (None, prose(20, 2)), (1, item), (1, prose(20, 3)), (2, other), (None, None), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame([(0, item), (1, other)], "item_id bigint, text string")
    want = sorted([texts[i] for i in (1, 3, 5, 6)], key=repr)
    for chars in (decontaminate.SLICE_CHARS, 20):  # one slice of items, several
        monkeypatch.setattr(decontaminate, "SLICE_CHARS", chars)
        assert sorted(map(tuple, decontaminate.drop_contaminated(docs, bench).collect()), key=repr) == want
    assert decontaminate.drop_contaminated(docs, bench.filter("false")).count() == 7
    assert decontaminate.drop_contaminated(docs.filter("false"), bench).count() == 0
    a, b, c, d = (prose(60, 960 + i) for i in range(4))
    near = a + " tail"
    texts = [(5, a), (5, b), (5, c), (7, near), (7, d), (4, c), (5, b), (None, a), (8, None), (8, None)]
    kept = minhash.keep_one_of_each(spark.createDataFrame(texts, "doc_id bigint, text string"))
    want = [(5, a), (5, b), (7, d), (4, c), (None, a), (8, None), (8, None)]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def test_line_dedup_matches_brute_force(spark, empty):
    texts = [f"\t Common Line\x0b\nown {i}\ncommon line\n\n" + ("rare" if i < 9 else "x") for i in range(14)] + [None, "", "COMMON LINE", "É common", "é common"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    keys = [[re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\x20\x09\x0a\x0b\x0c\x0d")) for x in (t or "").split("\n")] for t in texts]
    n = Counter(k for ks in keys for k in set(ks) if k)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for i, (t, ks) in enumerate(zip(texts, keys, strict=True)):
        left = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if n[k] < 10]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(ks), len(ks) - len(left), "\n".join(left))
    assert line_dedup.dedup_lines(empty).count() == 0
    runs = line_dedup.LineRuns(spark, 2)
    for k in range(5):
        runs.add(spark.createDataFrame([(b"a",), (bytes([k]),)], "hash binary"))
    assert [len(x) for x in runs.levels] == [1, 1] and [bytes(r.hash) for r in runs.frequent().select("hash").collect()] == [b"a"]
    assert runs.unseen(spark.createDataFrame([(b"a", 1), (b"new", 1)], "hash binary, n bigint")).count() == 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    assert [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "token_output"]
    now = docs
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        stage(spark, now, sf).write.parquet(str(tmp_path / str(k)))
        before, now = now, spark.read.parquet(str(tmp_path / str(k)))
        assert now.columns == docs.columns
        got = {r.doc_id: r.text for r in now.collect()}
        if k == 1:
            sets = {r.doc_id: shingles(r.text) for r in before.collect()}
            ids = sorted(got)
            assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a])
        if k == 2:
            held = {r.doc_id for r in before.collect() if any(decontaminate.normalise(b.text) in decontaminate.normalise(r.text) for b in bench)}
            assert held and not held & set(got)
    last = p.STAGES[-1][1](spark, now, sf).collect()
    assert {i for r in last for i in r.doc_ids} == {r.doc_id for r in now.collect() if r.text}
