"""Clashing columns, ties, repeats, long texts and null ids, and brute-force versions, operator by operator."""

import gzip
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.llm import common, decontaminate, lang_id, line_dedup, mixing, quality_classifier, quality_rules, token_output, url_filter, warc

R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefghijklm") for _ in range(R.randint(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def test_url_rules_ties_and_long_urls(spark):
    rules = spark.sql("VALUES ('b.a', '/x', 'allow'), ('b.a', '/x', 'block'), ('a', '/xx', 'block'), ('c.b.a', '', 'allow'), ('z', '/q', 'block') AS r(host, path, verdict)")
    urls = ["http://b.a/x", "http://c.b.a/xx", "http://d.b.a/xxx", f"http://z/q{'y' * 200_000}", f"http://{'w.' * 60}z/q", None, None, "", "://z/q"]
    pages = spark.createDataFrame([(i, u, 7, "h", "p", "r") for i, u in enumerate(urls)], "page_id bigint, url string, verdict bigint, host string, path string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, rules, keep=("page_id", "verdict", "host")).collect()}
    assert len(got) == len(urls) and url_filter.filter_urls(pages, rules, keep=("page_id", "host")).columns == ["page_id", "host", "path", "rule", "verdict"]
    assert (got[0].rule, got[0].verdict) == ("b.a/x", "block")  # repeated rules that disagree: what sorts last
    assert (got[1].rule, got[1].verdict) == ("c.b.a", "allow")  # as long as b.a/x: the longer host
    assert (got[2].rule, got[2].verdict) == ("b.a/x", "block") and got[3].rule == got[4].rule == got[8].rule == "z/q"
    assert all((got[i].host, got[i].rule, got[i].verdict) == ("", None, "allow") for i in (5, 6, 7))


def test_url_rules_match_brute_force(spark, monkeypatch):
    r = random.Random(3)
    label, path = (lambda: r.choice("abcd")), (lambda: "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 3))))
    rules = {(".".join(label() for _ in range(r.randint(1, 3))), r.choice(["", path()])): r.choice(["allow", "block"]) for _ in range(60)}
    pages = [(i, f"http://{'.'.join(label() for _ in range(r.randint(1, 4)))}{path()}") for i in range(400)] + [(i, "http://a.b/x") for i in range(400, 500)]

    def judge(url):
        host, slash, rest = url.partition("://")[2].partition("/")
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and (slash + rest).startswith(p)]
        return max(fits)[2:] if fits else (None, "allow")

    want = {i: judge(u) for i, u in pages}
    frames = spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame([(*k, v) for k, v in rules.items()], "host string, path string, verdict string")
    for short in (url_filter.SHORT_LIST, 0):  # the join that keeps pages where they are, and that of long lists
        monkeypatch.setattr(url_filter, "SHORT_LIST", short)
        assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(*frames).collect()} == want


CLASHES = ("rest", "full", "taken", "epoch", "before", "end_slice", "slice", "row", "leaf", "document", "n", "h", "key", "at", "part")


def mixture(docs, budgets, sizes, order):
    """Rows (id, epoch, taken) of each leaf: whole epochs, then the prefix of the last one in the order given."""
    out = Counter()
    for leaf, rows in docs.items():
        full, left = divmod(budgets.get(leaf, 0), sizes[leaf]) if sizes[leaf] else (0, 0)
        for e in range(1, full + 1):
            out.update((i, e, n) for i, _, n in rows if n)
        for i, _, n in sorted((x for x in rows if x[2]), key=lambda x: order(x, full + 1)):
            take = min(n, left)
            left -= take
            if take:
                out[i, full + 1, take] += 1
    return out


@pytest.mark.parametrize("fraction", [0.3, 0.7, 1.5])
def test_mixing_fills_prefixes_and_epochs(spark, fraction):
    rows = [(i, prose(5 + i % 40, i), ("en", "de", None)[i % 3], f"s{i % 4}") for i in range(300)] + [(300, prose(40_000, 1), "en", "s0"), (301, None, "en", "s0"), (302, " \n", None, None)]
    rows += [(None, prose(9, 3), "en", "s0"), (7, prose(30, 8), "en", "s1"), (7, prose(30, 9), "en", "s1")]
    base = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs = base.select("*", *(F.lit(c).alias(c) for c in CLASHES), F.lit(99).alias("mix"))
    weights = {("d", "en"): 3.0, ("d", "en", "s0"): 2.0, ("d", None): 0.0}
    got = mixing.mix_sources(docs, F.lit("d"), weights, fraction, 2, 5)
    assert got.columns == [*(c for c in docs.columns if c != "mix"), "mix"]
    got = got.collect()
    assert all(r[c] == c for r in got for c in CLASHES)

    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    leaves, sizes = defaultdict(list), Counter()
    for i, t, lang, source in rows:
        leaves["d", lang, source].append((i, t, words(t)))
        sizes["d", lang, source] += words(t)
    budgets = mixing.plan_budgets(dict(sizes), weights, int(fraction * sum(sizes.values())), 2)
    hashes = {(r.doc_id, r.text, e): r[f"h{e}"] for r in base.select("doc_id", "text", *(F.xxhash64(F.lit(5), F.lit(e).cast("bigint"), F.xxhash64("doc_id", "text")).alias(f"h{e}") for e in (1, 2, 3))).collect() for e in (1, 2, 3)}
    order = lambda x, e: hashes[x[0], x[1], e] % (1 << 64)  # noqa: E731  in unsigned order
    assert Counter((r.doc_id, r.mix.epoch, r.mix.taken) for r in got) == mixture(leaves, budgets, sizes, order)


def test_mixing_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s")] * 50, "doc_id bigint, text string, lang string, source string")
    got = mixing.mix_sources(docs, F.lit("d"), {}, 0.505, 1, 0).collect()
    assert sorted(r.mix.taken for r in got) == [1] + [4] * 25


def share_out_by_halving(budget, children):
    """The level at which children filled in proportion to their weights, up to their supply, use the budget."""
    low, high = 0.0, 1e9
    fill = lambda x: sum(min(s, w * x) for w, s in children)
    for _ in range(200):
        low, high = ((low + high) / 2, high) if fill((low + high) / 2) < budget else (low, (low + high) / 2)
    return [min(s, w * high) for w, s in children]


def test_budgets_match_water_filling():
    r = random.Random(2)
    for _ in range(200):
        children = [(r.choice([0.0, 0.5, 1.0, 2.0, 3.7]), r.choice([0, 5, 50, 1000])) for _ in range(r.randint(1, 8))]
        budget = r.randint(0, 2500)
        got = mixing.share_out(budget, children)
        assert sum(got) == min(budget, sum(s for w, s in children if w > 0))
        assert all(abs(a - b) <= len(children) for a, b in zip(got, share_out_by_halving(budget, children), strict=True))


def exchanges_of(plan, scan):
    """Exchanges and sorts between the scans of a table and the first join above, by the plan's indentation."""
    lines = plan.split("\n")
    out = []
    for i, line in enumerate(lines):
        if scan in line:
            depth = len(re.match(r"[\s:]*", line)[0])
            for above in reversed(lines[:i]):
                if (d := len(re.match(r"[\s:]*", above)[0])) < depth:
                    depth = d
                    if "Join" in above or "HashAggregate" in above:
                        break
                    out.append(above)
    return [x for x in out if "Exchange" in x or "Sort" in x]


def test_runs_are_joined_as_they_lie(spark, capsys):
    runs = line_dedup.LineRuns(spark, 2)
    for k in range(3):
        runs.add(spark.range(1000).select((F.col("id") * (k + 1)).cast("string").cast("binary").alias("hash")))
    counts = spark.range(500).select(F.col("id").cast("string").cast("binary").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    with common.session_setting(spark, line_dedup.ORDERED, "true"):
        unseen = runs.unseen(counts, 2)
        capsys.readouterr()
        unseen.explain()
        plan = capsys.readouterr().out
        assert plan.count("SortMergeJoin") == plan.count("FileScan") == 3
        assert not exchanges_of(plan, "FileScan") and plan.count("Exchange") == 1
        assert unseen.count() == 500
    assert runs.unseen(counts).count() == 0
    runs.drop()


def test_merged_runs_hold_all_counts(spark):
    r, runs, want = random.Random(6), line_dedup.LineRuns(spark, 10_000), Counter()
    for _ in range(6):
        batch = [str(r.randrange(3000)).encode() for _ in range(4000)]
        want.update(batch)
        runs.add(spark.createDataFrame([(x,) for x in batch], "hash binary"))
    assert [len(x) for x in runs.levels] == [2, 1]
    got = {bytes(x.hash): x.n for x in runs._merged(runs._all()).collect()}
    runs.drop()
    assert got == want


def test_line_dedup_of_repeats_nulls_and_long_texts(spark, monkeypatch):
    long = "\n".join(f"own line {i}" for i in range(60_000)) + "\nshared"
    rows = [(1, "shared\nx")] * 12 + [(None, "shared\n\ny"), (None, None), (None, ""), (2, long), (3, "z" * 500_000)]
    docs = spark.createDataFrame([(*r, "h", "d") for r in rows], "doc_id bigint, text string, hash string, drop string")
    want = Counter()
    counts = Counter(k for _, t in rows for k in {x.strip().lower() for x in (t or "").split("\n")} if k)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[x.strip().lower()] < 10]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    for hot in (common.HOT_ROWS, 1):  # keys joined by a shuffle, and where they are
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert Counter(map(tuple, line_dedup.dedup_lines(docs, batches=3).collect())) == want


def scrambled(text, seed):
    letters = list(text)
    random.Random(seed).shuffle(letters)
    return "".join(letters)


@pytest.mark.parametrize("alphabet", ["abcdefghijklm", "абвгдежзийклм", "αβγδεζηθικλμν", "あいうえおかきくけこさしす"])
def test_scrambled_text_of_any_script_is_rejected(spark, alphabet):
    table = str.maketrans("abcdefghijklm", alphabet)
    good = [prose(80, i).translate(table) for i in range(60)]
    bad = [scrambled(t, i) for i, t in enumerate(good[:20])] + [t.upper() for t in good[20:25] if t != t.upper()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(good + bad)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_classifier.classify_quality(docs, labels).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in range(60, len(good + bad)))


def test_classifier_of_repeats_nulls_and_clashing_columns(spark):
    rows = [(i % 30 if i < 60 else None, prose(60, i % 30), "en") for i in range(62)] + [(99, "#%&" * 50, "en")] * 2
    docs = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "doc_id bigint, text string, lang string, block int, perplexity int, kept string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] * 2 + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = Counter((r.doc_id, r.kept) for r in quality_classifier.classify_quality(docs, labels).collect())
    assert got == Counter({**{(i, True): 2 for i in range(30)}, (None, True): 2, (99, False): 2})


def naive_probabilities(net, window):
    """Softmax of the network over one window, filter by filter and place by place."""
    pooled = []
    for table in net.tables:
        w = len(table)
        for f in range(lang_id.FILTERS):
            pooled.append(max(sum(float(table[j][window[at + j]][f]) for j in range(w)) for at in range(len(window) - w + 1)))
    hidden = [max(0.0, x + float(b)) for x, b in zip(pooled, net.bias, strict=True)]
    z = [sum(h * float(net.dense[i][k]) for i, h in enumerate(hidden)) + float(net.dense_bias[k]) for k in range(len(net.langs))]
    e = np.exp(np.array(z) - max(z))
    return e / e.sum()


def test_network_matches_naive_convolution_and_finite_differences():
    rng = np.random.default_rng(4)
    net = lang_id.ByteConvNet.untrained(["a", "b", "c"], rng)
    for name in ("bias", "dense", "dense_bias"):
        setattr(net, name, rng.normal(0.1, 0.3, getattr(net, name).shape))
    net.tables = [t.astype(float) for t in net.tables]
    x, y, weight = rng.integers(97, 110, (5, lang_id.WINDOW), dtype=np.uint8), np.array([0, 1, 2, 1, 0]), np.array([0.5, 1.0, 2.0, 0.1, 1.0])
    want = np.stack([naive_probabilities(net, w) for w in x])
    assert np.allclose(np.exp(net.window_scores(x)), want, atol=1e-6)

    def loss():
        net._pairs = []
        return -(weight * net.window_scores(x)[np.arange(5), y]).sum()

    for param, grad in zip(net.parameters(), net.gradients(x, y, weight), strict=True):
        flat, g = param.reshape(-1), grad.reshape(-1)
        for k in [*np.argsort(-abs(g))[:6], *rng.integers(0, len(flat), 6)]:
            old = flat[k]
            flat[k] = old + 1e-6
            up = loss()
            flat[k] = old - 1e-6
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-6 == pytest.approx(g[k], abs=1e-4, rel=1e-3)


def test_language_id_of_clashing_columns_repeats_and_many_languages(spark, monkeypatch):
    rows = [(i % 40, ("der und nicht " if i % 2 else "the and not ") * 20, ["en", "de"][i % 2]) for i in range(80)]
    docs = spark.createDataFrame([(*r, "x", 5.0) for r in rows], "doc_id bigint, text string, lang string, lang_pred string, score double")
    got = lang_id.identify_languages(docs, lang_id.train_language_id(docs))
    assert got.columns == docs.columns and got.filter("lang <> lang_pred OR score > 1").count() == 0 and got.count() == 80
    assert got.groupBy("doc_id", "text").agg(F.countDistinct("score").alias("n")).filter("n > 1").count() == 0
    monkeypatch.setattr(lang_id, "MAX_LANGS", 1)
    with pytest.raises(ValueError):
        lang_id.train_language_id(docs)


def test_token_shards_in_ranges_for_a_task(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, prose(200, i), 1, 2) for i in range(30)], "doc_id bigint, text string, slot int, shard int")
    one, two = (f"file://{tmp_path}/{x}" for x in "ab")
    a = token_output.write_training_order(docs, one, key=3, seq_len=16, shard_bytes=256).collect()
    monkeypatch.setattr(token_output, "WRITE_TASKS", 3)
    b = token_output.write_training_order(docs, two, key=3, seq_len=16, shard_bytes=256).collect()
    assert len({r.shard for r in a}) > 50 and sorted(r.slot for r in b) == list(range(len(b))) == sorted(r.slot for r in a)
    read = lambda path: token_output.read_sequences(path, 0, len(a), seq_len=16, shard_bytes=256)
    assert (read(one) == read(two)).all()


def test_damaged_archive_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 3000, "p"), (2, "http://b/", "y", "q")], "page_id bigint, url string, html string, payload string")
    manifest = warc.write_archives(pages, path=f"file://{tmp_path}/w")
    kind = pages.schema["page_id"].dataType
    assert warc.captures_of(manifest.df, kind).count() == 2
    for name in (tmp_path / "w").glob("*.warc.gz"):
        with open(name, "rb") as f:
            name.write_bytes(b"".join(gzip.compress(x.replace(b"xxx", b"xxz", 1)) for x in list(warc._members(f))))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.captures_of(manifest.df, kind).collect()


def test_decontamination_of_repeats_nulls_and_long_texts(spark, monkeypatch):
    items = [(i, prose(15, 700 + i)) for i in range(6)] + [(0, prose(15, 700)), (None, prose(15, 710))]
    texts = [(1, "x " + items[0][1])] * 2 + [(None, items[3][1]), (2, prose(50_000, 1) + " " + items[5][1] + " " + prose(10, 2)), (3, prose(90, 8)), (4, items[7][1])]
    docs = spark.createDataFrame([(*t, "i") for t in texts], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = Counter({(1, 0): 4, (None, 3): 1, (2, 5): 1, (4, None): 1})
    for chars in (decontaminate.SLICE_CHARS, 150):  # one slice of items, several
        monkeypatch.setattr(decontaminate, "SLICE_CHARS", chars)
        assert Counter((r.doc_id, r.item_id) for r in decontaminate.find_benchmark(docs, bench).collect()) == want
        kept = decontaminate.drop_contaminated(docs, bench)
        assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]


def learned(rows):
    """The first condition of a decision list by trying every threshold on the rows that grow rules."""
    best = (0.0, None)
    p, n = sum(b for _, b in rows), sum(not b for _, b in rows)
    for name in quality_rules.RATIOS:
        for t in {f[name] for f, _ in rows}:
            for above in (True, False):
                hit = [b for f, b in rows if (f[name] > t) == above]
                if any(hit):
                    gain = sum(hit) * (np.log2(sum(hit) / len(hit)) - np.log2(p / (p + n)))
                    best = max(best, (gain, name), key=lambda x: x[0])
    return best


def test_decision_list_gains_what_brute_force_gains(spark):
    r, rows = random.Random(9), []
    for i in range(600):
        bad = r.random() < 0.4
        text = prose(40, i) + "!" * r.choice([0, 40, 80, 120, 160]) + ("#" * 30 if bad and r.random() < 0.7 else "")
        rows.append((i, text, int(not bad)))
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t, _ in rows], "doc_id bigint, text string, kept int, rule string")
    stats = quality_rules.text_statistics(docs)
    labelled = stats.join(spark.createDataFrame([(i, q == 0) for i, _, q in rows], "doc_id bigint, bad boolean"), "doc_id")
    told = quality_rules._features(labelled).withColumn("apart", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(3)) == 0).collect()
    rules = quality_rules.learn_decision_list(labelled)
    grow = [({n: x[n] for n in quality_rules.RATIOS}, x.bad) for x in told if not x.apart]
    gain, name = learned(grow)
    assert rules and rules[0][0].feature == name
    first = rules[0][0]
    hit = [b for f, b in grow if (f[name] > first.threshold) == first.above]
    p = sum(b for _, b in grow)
    assert sum(hit) * (np.log2(sum(hit) / len(hit)) - np.log2(p / len(grow))) >= 0.9 * gain  # thresholds are quantiles
    for rule in rules:  # each stands on the rows kept apart
        held = [x.bad for x in told if x.apart and all((x[c.feature] > c.threshold) == c.above for c in rule)]
        assert held and sum(held) >= quality_rules.MIN_PRECISION * len(held) * 0.9


def test_quality_rules_of_repeated_rows_and_labels(spark):
    rows = [(i % 60, prose(50, i % 60) + (" ###" * 60 if i % 60 >= 40 else "")) for i in range(120)] + [(None, prose(20, 1)), (60, prose(60_000, 2)), (60, prose(60_000, 2))]
    docs = spark.createDataFrame([(*r, 1, True, "x") for r in rows], "doc_id bigint, text string, bad int, kept boolean, rule string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(60)] * 3 + [(0, 0), (None, 0)], "doc_id bigint, quality int")
    got = quality_rules.judge_quality(docs, labels)
    assert got.count() == len(rows)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert all(kept[i] == (i < 40) for i in range(60)) and kept[60] and kept[None]
