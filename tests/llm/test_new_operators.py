"""Whitening, ranked search and the subword model against brute force; hot keys, scratch folders and the pipeline's failures."""

import math
import os
import random
import re
import zlib
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.llm import blocks, common, lattice, line_dedup, minhash, queries, search, whitening

R = random.Random(21)
VOCAB = ["".join(R.choice("abcdefghijklm") for _ in range(R.randint(1, 7))) for _ in range(120)]
VEC = "vec_id bigint, embedding array<float>, n int, whitened string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VEC)


def check_whitened(got, rows, k):
    """``rows`` are the usable ones; held against the eigenvectors of the covariance."""
    x = np.floor(np.array([v for _, v in rows], dtype=np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    exact = sorted((str(i), sum(int(v) ** 2 for v in n * row - s)) for (i, _), row in zip(rows, x, strict=True))
    assert sorted((str(r.vec_id), int(r.deviation)) for r in got) == exact and {r.n for r in got} == {n}
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    assert {len(r.whitened) for r in got} == {k} and np.allclose(got[0].explained, e / np.trace(y.T @ y / n), rtol=1e-9)
    want = {}
    for (i, _), row in zip(rows, y @ u / np.sqrt(e), strict=True):
        want.setdefault(i, row)
    w = np.array([r.whitened for r in got])
    of = np.array([want[r.vec_id] for r in got])
    sign = np.sign((w * of).sum(axis=0))
    assert np.abs(w * sign - of).max() < 1e-8 and 0 <= got[0].identity_error < 1e-9


def test_whitening_matches_eigenvectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2])
    good = [(i, v.tolist()) for i, v in enumerate(base)] + [(7, base[7].tolist())] * 400 + [(None, base[9].tolist())]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [None] * 6)]
    df = vectors(spark, good + bad)
    for parts in (1, 40):  # 40 factors are merged in two levels
        got = whitening.whiten(df.repartition(parts), components=4).collect()
        assert whitening.whiten(df).columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
        check_whitened(got, good, 4)


def test_whitening_of_few_and_flat_vectors(spark):
    flat = [(i, [float(i % 3), 2.0 * (i % 3), 7.0]) for i in range(30)]  # one direction only
    check_whitened(whitening.whiten(vectors(spark, flat)).collect(), flat, 1)
    alike = whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert [(r.whitened, r.identity_error, int(r.deviation)) for r in alike] == [([], None, 0)] * 5
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0 and whitening.whiten(vectors(spark, flat).filter("false")).count() == 0
    far = [(i, [1000.0 * (i == 0), 0.001 * i]) for i in range(40)]
    check_whitened(whitening.whiten(vectors(spark, far)).collect(), far, 2)
    with pytest.raises(Exception, match="unlike lengths"):
        whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()
    with pytest.raises(Exception, match="bits"):
        whitening.whiten(vectors(spark, [(1, [1e30])])).collect()


def test_whitening_query(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=9).tolist()) for i in range(60)]
    vectors(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op11_whitening(spark, str(tmp_path))
    assert [f.simpleString() for f in got.schema] == ["vec_id:bigint", "component:int", "n:bigint", "deviation:bigint", "whitened:double", "explained:double", "identity_error:double"]
    assert sorted((x.vec_id, x.component) for x in got.collect()) == [(i, c) for i in range(60) for c in range(1, 9)]


def brute_search(docs, items, k):
    cut = lambda t: [w.lower() for w in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode())]
    rows = [(i, c) for i, t in docs if (c := cut(t))]
    n_docs, total = len(rows), sum(len(c) for _, c in rows)
    df = Counter(w for _, c in rows for w in set(c))
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    tfs = [(i, 75 + 25 * len(c) * n_docs // total, Counter(c)) for i, c in rows]
    out = []
    for item, text in items:
        asked = Counter(cut(text))
        scored = [(-s, (i is not None, i or 0), i) for i, m, tf in tfs if (s := sum(q * w[t] * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, q in asked.items() if t in tf))]
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1) if s < 0]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1 << 20, 300, 1])
def test_search_matches_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(search, "SHARD_POSTINGS", size)  # one shard a task, several, one a document
    docs = [(i, prose(5 + i % 60, i)) for i in range(150)] + [(200 + i, prose(12, 3)) for i in range(30)]  # ties over many ids
    docs += [(300, None), (301, ""), (302, " \n-"), (303, "Élan ÉLAN 东京 x1 X1"), (304, prose(30_000, 5)), (305, "a-b_c"), (None, prose(12, 3)), (7, prose(12, 3)), (7, prose(12, 3))]
    items = [(i, prose(4 + 9 * i, 500 + i)) for i in range(8)] + [(20, None), (21, "?!"), (22, "zzzz unknown"), (23, "élan 东京 x1 x1"), (24, prose(12, 3)), (24, prose(12, 3)), (None, prose(3, 1))]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id bigint, text string, rank int, shard string").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, score int")
    got = search.search(search.build_index(d), q, k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, 5)
    if size == 300:
        assert search.search(search.build_index(d.filter("false")), q).count() == 0
        index = search.build_index(d)
        assert search.search(index, q.filter("false")).count() == 0 and index.shards.count() > 5
        one = search.search(search.build_index(d.filter("doc_id = 303")), q)
        assert sorted(map(tuple, one.collect()), key=repr) == brute_search([r for r in docs if r[0] == 303], items, 20)


def test_search_enters_few_nodes(spark, tmp_path, monkeypatch):
    """Subtrees whose bound is too low aren't entered: of 2,000 documents with one term, the best 3 are found in few steps."""
    held = search._Postings()
    for i in range(2000):
        held.add(i, 75 + i % 500, Counter({b"w": 1 + (i * 7919) % 50, b"v": 1}))
    schema = search._shard_schema(__import__("pyarrow").int64())
    shard = search.Shard(__import__("pyarrow").RecordBatch.from_pylist([held.shard()], schema))
    monkeypatch.setattr(search, "NODES", 4)
    entered = []
    ones = shard._ones
    monkeypatch.setattr(shard, "_ones", lambda level, place: (entered.append(len(place)), ones(level, place))[1])
    docs, scores = shard.best(np.array([0]), np.array([1]), 3, 1)
    impact = [10**9 * (1 + (i * 7919) % 50) // (1000 * (1 + (i * 7919) % 50) + 12 * (75 + i % 500)) for i in range(2000)]
    assert [(int(s), int(d)) for d, s in zip(docs, scores, strict=True)] == sorted(((s, i) for i, s in enumerate(impact)), key=lambda x: (-x[0], x[1]))[:3]
    assert sum(entered) < 600


def paths_sum(word, model):
    """The probability of a word by all its segmentations, one by one."""
    p = dict(zip(model.pieces, np.exp(model.weights), strict=True))
    single = {x for x in p if len(x) == 1}

    def go(rest):
        if not rest:
            return 1.0
        total = sum(p[rest[:k]] * go(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in p)
        if rest[0] not in single:
            total += math.exp(sum(model.bytes_[b] for b in rest[0].encode())) * go(rest[1:])
        return total

    return math.log(go(" " + word))


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.read_vocabulary()


def test_likelihood_is_the_sum_over_segmentations(vocabulary):
    words = ["the", "internationally", "a", "ваша", "été", "x̃ỹ", "日本国", "▁", "ß\U0001f600"]
    model = lattice.Lattice(vocabulary)
    assert np.allclose(model.likelihoods(words), [paths_sum(w, vocabulary) for w in words], rtol=1e-10)
    assert np.isclose(np.exp(vocabulary.weights).sum() + np.exp(vocabulary.bytes_).sum() + np.exp(vocabulary.end), 1)
    long = model.likelihoods(["ab" * 20_000, "ab"])
    assert np.isfinite(long).all() and long[0] < long[1] < 0
    into = np.zeros(len(vocabulary.pieces) + 256)
    model.expected(words, np.full(len(words), 2.0), into)
    chars = sum(into[i] * len(p) for i, p in enumerate(vocabulary.pieces))
    assert np.isclose(chars + into[-256:].sum() - sum(into[-256 + b] for b in into[:0].astype(int)) - 2 * sum(len(c.encode()) - 1 for w in words for c in w if c not in vocabulary.pieces), 2 * sum(len(w) + 1 for w in words))


def test_scores_of_texts(spark, tmp_path, vocabulary, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(blocks.numbered_blocks, "__defaults__", ("text", 4000))  # many blocks
    docs = [(i, prose(5 + i % 50, i).title() if i % 2 else prose(30, i)) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n\t"), (203, "日本 " * 30 + "x" * 30_000), (204, prose(20_000, 3)), (5, prose(9, 77)), (5, prose(9, 77)), (None, prose(8, 4))]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in docs], "doc_id bigint, text string, c int, block string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_lm_scoring(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    cut = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, ends = Counter(), 0
    for i, t in docs:
        if not out(i):
            c.update(cut(t))
            ends += 1
    total, distinct = sum(c.values()) + ends, len(c) + 1
    # The same model from the same counts in one process
    model = vocabulary
    for _ in range(lattice.ROUNDS):
        into, of = np.zeros(len(model.pieces) + 256), lattice.Lattice(model)
        words = [w.decode() for w in c]
        of.expected(words, np.array([*c.values()], float), into)
        seen = lattice.PRIOR * len(model.pieces) * np.exp(np.concatenate([vocabulary.weights, vocabulary.bytes_])) + into
        logs = np.log(np.concatenate([seen, [ends + lattice.PRIOR]]) / (seen.sum() + ends + lattice.PRIOR))
        model = lattice.Pieces(model.pieces, logs[: len(seen) - 256], logs[len(seen) - 256 : -1], float(logs[-1]))
    every = [w.decode() for w in {w for _, t in docs for w in cut(t)}]
    log = dict(zip(every, lattice.Lattice(model).likelihoods(every), strict=True))
    want = []
    for i, t in docs:
        k = cut(t)
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in k) + math.log10((ends + 1) / (total + distinct + 1))
        want.append((i, out(i), len(k) + 1, sum(c[w] > 0 for w in k) + 1, total, base, (sum(log[w.decode()] for w in k) + model.end) / math.log(10)))
    key = lambda r: (str(r[0]), r[2], round(r[5], 3))
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    assert lattice.score_texts(df.filter("false"), F.lit(False)).count() == 0
    alone = lattice.score_texts(df.filter("doc_id = 1"), F.lit(True)).first()  # nothing to train on
    assert alone.train_tokens == 0 and alone.n_known == 0 and alone.base_score == 0.0 and alone.score < 0


def test_training_makes_texts_like_the_trained_ones_likelier(spark):
    df = spark.createDataFrame([(i, prose(200, i)) for i in range(40)], "doc_id bigint, text string")
    apart = F.col("doc_id") % 4 == 0
    total = lambda rounds: sum(r.score for r in lattice.score_texts(df, apart, rounds=rounds).collect() if r.held_out)
    assert total(0) < total(1) < total(2)


# Hot keys, wide sides and folders


def test_salted_join_matches_a_plain_one(spark, monkeypatch, capsys):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k % 5 if k < 60 else k, k) for k in range(90)] + [(None, 1)], "key bigint, salt bigint")
    side = rows.groupBy("key").agg(F.count("*").alias("n")).filter("key % 2 = 0").withColumn("wide", F.array_repeat(F.lit("x"), 1000))
    for how in ("inner", "left"):
        want = rows.join(side.drop("n"), "key", how)
        got = common.join_salted(rows, side, ["key"], "n", how)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, (want if how == "inner" else want).collect()))


def test_many_documents_that_lose_many_lines(spark, monkeypatch):
    """No table with lines is broadcast: documents that occur once aren't hot, however many lines they lose."""
    common_lines = [f"line number {k}" for k in range(5000)]
    docs = spark.createDataFrame([(i, "\n".join([*common_lines, f"own {i}"])) for i in range(50)], "doc_id bigint, text string")
    out = line_dedup.dedup_lines(docs, min_documents=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("Broadcast" in x and "drop" in x for x in plan.splitlines())
    assert all((r.n_lines, r.n_dropped, r.text) == (5001, 5000, f"own {r.doc_id}") for r in out.collect())


def test_runs_are_merged_as_they_lie(spark):
    runs = line_dedup.LineRuns(spark, 1000)
    made = [line_dedup.Run(spark, spark.createDataFrame([(bytes([k % 50, s]), 1) for k in range(60) for s in (0, j)], "hash binary, n bigint").groupBy("hash").agg(F.sum("n").alias("n")), runs.buckets) for j in range(3)]
    want = Counter()
    for run in made:
        want.update({bytes(r.hash): r.n for r in run.df.collect()})
    with common.session_setting(spark, line_dedup.ORDERED, "true"):
        both = made[0].df.hint("merge").join(made[1].df, made[0].df["hash"] == made[1].df["hash"], "full")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        one = runs._compacted(made)
        assert {bytes(r.hash): r.n for r in one.df.collect()} == want
        new = spark.createDataFrame([(h, 1) for h in want] + [(b"new", 1)], "hash binary, n bigint")
        runs.levels = [[one]]
        assert [bytes(r.hash) for r in runs.unseen(new).collect()] == [b"new"]
    runs.drop()


def folders(spark):
    base = urlparse(common.shared_dir(spark)).path
    return {x for x in os.listdir(base)} if os.path.exists(base) else set()


def small_tables(spark, path, docs):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, near_row bigint, Score double, lang_pred string, mix string, number bigint, offset bigint, doc_ids string"
    spark.createDataFrame([(*r, 1, 77, 0.5, "own", "m", 5, 6, "d") for r in docs], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "some words of a benchmark item that nobody has ever seen before now")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_with_null_repeated_and_clashing_rows(spark, tmp_path):
    import corpus_pipeline as p

    en = ["the", "and", "of", "that", "was", "his", "with", "for", "had", "this"]
    text = lambda i: " ".join(en[(i * 7 + k * k * (i + 3)) % 10] + "abcdefghij"[(i * k + k) % 10] for k in range(80))
    docs = [(i, text(i), "en", f"src{i % 3}") for i in range(30)] + [(None, text(50), None, None), (3, text(3), "en", "src0"), (40, None, "en", "src0"), (41, "", None, None), (42, text(5) + " end", "en", None)]
    small_tables(spark, tmp_path, docs)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = p.language_id(spark, table, str(tmp_path))
    assert now.columns == table.columns
    for stage in (p.near_dedup, p.decontamination, p.source_mixing):  # chained without being written
        now = stage(spark, now, str(tmp_path))
        assert now.columns == table.columns and {(r.near_row, r.Score, r.lang_pred, r.mix) for r in now.collect()} == {(77, 0.5, "own", "m")}
    common.end_stages(spark)
    kept = p.near_dedup(spark, table, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in kept)[3] == 1 and {None, 40, 41} <= {r.doc_id for r in kept} and 42 not in {r.doc_id for r in kept}
    assert p.run(spark, str(tmp_path)).count() > 0
    os.makedirs(tmp_path / "none")
    small_tables(spark, tmp_path / "none", [])
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def test_a_failing_stage_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p

    small_tables(spark, tmp_path, [(i, prose(60, i), "en", "src1") for i in range(20)])
    before = folders(spark)

    def broken(spark, docs, sf_dir):
        with common.stage(spark, docs):
            common.Table(docs, "part")
            raise RuntimeError("no")

    steps = p.STAGES
    monkeypatch.setattr(p, "STAGES", [steps[0], ("broken", broken), *steps[2:]])
    with pytest.raises(RuntimeError, match="no"):
        p.run(spark, str(tmp_path))
    assert not {x for x in folders(spark) - before if x.startswith(("part", "language_id"))}
    other = common.Table(spark.range(5), "other")  # an operator of the session, not of a stage
    monkeypatch.setattr(p, "STAGES", steps)
    assert p.run(spark, str(tmp_path)).count() >= 0 and other.df.count() == 5
    other.drop()


def test_sizes_are_checked_in_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    wide = spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    assert hinted(common.small_side(spark.range(1000).toDF("id"))) and not hinted(common.small_side(wide)) and not hinted(common.small_side(spark.range(1_100_000).toDF("id")))
    assert common.free_name(["a", "A_", "b"], "a") == "a__"


def test_near_row_is_a_users_name(spark):
    docs = spark.createDataFrame([(1, prose(30, 1), 77), (2, prose(30, 1), 88), (None, None, 99)], "doc_id bigint, text string, _near_row bigint")
    assert {(r.doc_id, r._near_row) for r in minhash.keep_one_of_each(docs).collect()} == {(1, 77), (None, 99)}
