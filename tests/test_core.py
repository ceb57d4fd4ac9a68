"""Hand-computed cases and brute-force comparisons of the core operators."""

import inspect
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.config import ChunkConfig, MetricConfig, PipelineConfig, RetrievalConfig
from quern.functions import overlap as ov
from quern.functions import ranking as rk
from quern.functions import text as tx
from quern.operators import annotation, benchmark, chunking, faithfulness, log, ocr, retrieval, stats, sweeps
from quern.plans import pipeline, prompts
from quern.sources import io
from quern.sources.encoders import hashed_encoder, sentence_encoder
from quern.sources.generators import generate, responses
from quern.sources.tables import Table, cell


def one(spark, expr, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)).select(expr.alias("x")).first().x


def tokens(spark, text, **kw):
    return one(spark, tx.tokens(F.col("t"), **kw), t=text)


def test_tokens(spark):
    assert tokens(spark, "ಈ ದೇವಾಲಯ ೧೨೦೦ ರಲ್ಲಿ Built") == ["ಈ", "ದೇವಾಲಯ", "೧೨೦೦", "ರಲ್ಲಿ", "built"]
    assert tokens(spark, "ಈ ೧೨ 34 ok", keep_numerals=False) == ["ಈ", "ok"]
    assert tokens(spark, "ಕ‍್ಷ") == ["ಕ್ಷ"]
    assert tokens(spark, "") == [] and tokens(spark, None) is None


def test_normalise(spark):
    n = lambda t: one(spark, tx.normalise(F.col("t")), t=t)
    assert n("a 　b | c || d") == "a b । c ॥ d"
    assert n(" a \n\n\n\n b﻿ ") == "a\n\nb"
    assert n("é") == "é" and n("") == "" and n(None) is None
    assert n(n("ಅ |  ಬ\n \nಕ")) == n("ಅ |  ಬ\n \nಕ")


def test_script_guard(spark):
    r = lambda t: one(spark, tx.script_ratio(F.col("t")), t=t)
    assert r("ಕನ್ನಡ ಪಠ್ಯ") == 1.0 and r("") == 0.0
    assert one(spark, tx.is_mostly(F.col("t")), t="mostly English ಕ") is False


def test_sentences_and_grams(spark):
    assert one(spark, tx.sentences(F.col("t")), t="ಅ ಬ। ಕ? Yes! no") == ["ಅ ಬ।", "ಕ?", "Yes!", "no"]
    assert one(spark, tx.grams_of(F.col("t"), 4), t="abcde") == ["abcd", "bcde"]
    assert one(spark, tx.grams_of(F.col("t"), 4), t="ab") == ["ab"] and one(spark, tx.grams_of(F.col("t"), 4), t="") == []
    assert len(one(spark, tx.graphemes(F.col("t")), t="ಕ್ಕಿ")) == 2


def scores(spark, hyp, ref, cfg=None):
    df = spark.createDataFrame([(hyp, ref)], "hyp string, ref string")
    return ov.score_pairs(df, "hyp", "ref", cfg).first().asDict()


def test_rouge(spark):
    s = scores(spark, "ಕ ಕ ಕ", "ಕ")
    assert s["rouge1_precision"] == pytest.approx(1 / 3) and s["rouge1_recall"] == 1
    assert scores(spark, "a b c", "c b a")["rouge2_f1"] == 0 and scores(spark, "a b c", "a b c")["rougeL_f1"] == 1
    assert scores(spark, "a b", "x y")["rouge1_f1"] == 0 and scores(spark, "b a c", "a b c")["rougeL_f1"] < 1
    assert scores(spark, None, "a")["rouge1_f1"] == 0 and scores(spark, "", "a")["chrf"] == 0


def test_meteor(spark):
    assert scores(spark, "a b c d", "a b c d")["meteor"] > 0.99
    s = scores(spark, "d c b a", "a b c d")
    assert s["meteor_penalty"] == pytest.approx(0.5 * (s["meteor_chunks"] / 4) ** 3) and s["meteor"] < 0.6
    assert "meteor_fuzzy" in scores(spark, "temple", "temples", MetricConfig(meteor_fuzzy=0.5))


def test_meteor_plans_agree(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 8))], [rng.choice("abcd") for _ in range(rng.randint(0, 8))]) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, h array<string>, r array<string>")
    a = {r.k: (r.matches, r.chunks, round(r.meteor, 9)) for r in ov.meteor_exact(df, ["k"], "h", "r").collect()}
    b = {r.k: (int(r.m.matches), int(r.m.chunks), round(r.m.meteor, 9)) for r in df.select("k", ov.meteor(F.col("h"), F.col("r")).alias("m")).collect()}
    assert a == b


def test_meteor_exact_shuffles_nothing(spark):
    rng = random.Random(5)
    words = lambda most: [rng.choice("abcdefg") for _ in range(rng.randint(0, most))]
    rows = [(i, words(40), words(25)) for i in range(300)] + [(300, [], []), (301, None, ["a"]), (302, ["a"] * 9, ["a"] * 4), (303, ["x"], ["y"])]
    out = ov.meteor_exact(spark.createDataFrame(rows, "k int, h array<string>, r array<string>").repartition(3), ["k"], "h", "r")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan and "Join" not in plan  # the test's own repartition
    found = {r.k: (r.matches, r.chunks) for r in out.collect()}
    for k, h, r in rows:
        met = ov._align_exact(h or [], r or [])
        chunks = sum(n == 0 or (met[n][0] - met[n - 1][0], met[n][1] - met[n - 1][1]) != (1, 1) for n in range(len(met)))
        assert found[k] == (len(met), chunks), k


def test_chrf_prefers_shared_letters(spark):
    s = scores(spark, "ದೇವಾಲಯವು", "ದೇವಾಲಯ")
    assert s["chrf"] > s["rouge1_f1"] and scores(spark, "abc", "abc")["chrf"] == pytest.approx(1)


def test_dynamic_programs_against_recursion():
    from functools import lru_cache

    rng = random.Random(1)
    for _ in range(200):
        a, b = [[rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2)]

        @lru_cache(None)
        def lcs(i, j):
            return 0 if i == len(a) or j == len(b) else 1 + lcs(i + 1, j + 1) if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

        @lru_cache(None)
        def lev(i, j):
            return len(b) - j if i == len(a) else len(a) - i if j == len(b) else min(lev(i + 1, j) + 1, lev(i, j + 1) + 1, lev(i + 1, j + 1) + (a[i] != b[j]))

        assert ov.lcs_length(a, b) == lcs(0, 0) and ov.edit_distance(a, b) == lev(0, 0)


def test_error_rates(spark):
    df = spark.createDataFrame([("ಕಟ", "ಕಟಪ"), ("x", "")], "text string, transcription string")
    a, b = ocr.error_rates(df).collect()
    assert a.cer == pytest.approx(1 / 3) and a.wer == 1 and math.isnan(b.cer)


def test_transcription_is_rebuilt_from_all_chunks(spark):
    whole = "zeta one two  three four"
    cuts = [(0, 8), (5, 12), (14, 19), (17, 24)]
    rows = [("f", 1, a, whole[a:b]) for a, b in reversed(cuts)] * 2 + [("f", 2, 0, "alone"), ("f", 3, 0, None)]
    got = {r.page: r.transcription for r in ocr.whole_transcriptions(spark.createDataFrame(rows, "source_file string, page int, char_start int, text string")).collect()}
    assert got == {1: whole, 2: "alone", 3: None}


def test_transcription_queries_take_whole_pages(spark, tmp_path):
    from quern import queries

    whole = "beta one alpha two gamma"
    rows = [("f", 1, a, whole[a:b], True) for a, b in ((9, 18), (0, 14), (16, 24))]
    spark.createDataFrame(rows, "source_file string, page int, char_start int, text string, used_ocr boolean").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(1, "f", 1, whole, True)], "page_key long, source_file string, page int, text string, used_ocr boolean").write.parquet(str(tmp_path / "page_records.parquet"))
    r = queries.transcription_join(spark, str(tmp_path)).first()
    assert (r.ref_len, r.hyp_len) == (len(whole), len(whole))
    assert {b.block: b.cer for b in queries.ocr_error_blocks(spark, str(tmp_path)).collect()}["all"] == 0


def test_support(spark):
    df = spark.createDataFrame([(1, "The temple is old. Zzzz qqqq.", "the temple is old indeed"), (2, "", "x"), (3, "One. Two.", "")], "k int, a string, c string")
    r = {x.k: x for x in ov.support(df, ["k"], "a", "c").collect()}
    assert r[1].n_sentences == 2 and r[1].n_unsupported_sentences == 1 and r[1].support_min == 0
    assert (r[2].support_mean, r[2].n_sentences) == (0, 0) and r[3].n_unsupported_sentences == 2


def test_ranking(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["c", "z"]), (["a", "a"], ["a"]), (["x"], [])], "r array<string>, g array<string>")
    r, g = F.col("r"), F.col("g")
    rows = df.select(rk.recall(r, g, 5).alias("r5"), rk.recall(r, g, 2).alias("r2"), rk.precision(r, g, 5).alias("p5"), rk.mrr(r, g).alias("m"), rk.ndcg(r, g, 2).alias("n2"), rk.ndcg(r, g, 2, dedupe=True).alias("d2")).collect()
    assert (rows[0].r5, rows[0].r2, rows[0].p5) == (0.5, 0, 0.2) and rows[0].m == pytest.approx(1 / 3)
    assert rows[1].n2 == pytest.approx(1.6309, abs=1e-4) and rows[1].d2 == 1 and math.isnan(rows[2].r5)


def test_retrieval_plans_and_selection(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, embedding array<float>")
    q = df.where("id < 5")
    a = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.top_k(q, df, 4, "id", "id", skip_same=True).collect()}
    b = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.top_k_blocked(q, df, 4, "id", "id", skip_same=True).collect()}
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u[:5] @ u.T
    s[np.arange(5), np.arange(5)] = -9
    brute = {(i, k): int(c) for i in range(5) for k, c in enumerate(np.argsort(-s[i])[:4])}
    assert a == b == brute
    c = spark.createDataFrame([(1, "a", 0.9, 0), (1, "b", 0.8, 1), (1, "c", 0.5, 2), (2, "a", 0.1, 0), (3, "a", -0.1, 0)], "query_id bigint, chunk_id string, score double, rank int")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id bigint")
    out = {r.query_id: r for r in retrieval.retrieval_results(asked, c, RetrievalConfig()).collect()}
    assert out[1].k_effective == 2 and out[2].abstain_reason == "below_similarity_threshold" and out[4].abstain_reason == "empty_index" and math.isnan(out[4].top_score)
    kept = retrieval.retrieval_results(asked, c, RetrievalConfig(abstain_when_empty=False)).where("query_id = 2").first()
    assert kept.k_effective == 1


def test_split_properties():
    rng = random.Random(5)
    seps = ChunkConfig().separators
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", "। ", "\n", "\n\n", ". ", "xyzxyz"]) for _ in range(rng.randint(0, 60)))
        size = rng.randint(3, 40)
        pieces = chunking.split_pieces(text, seps, size)
        assert all(0 < len(p) <= size for p in pieces)
        assert "".join("".join(pieces).split()) == "".join(text.split())


def test_chunk_pages(spark):
    pages = spark.createDataFrame([("f", 1, "abcdefghij", False), ("f", 2, "  ", False), ("f", 3, None, None)], "source_file string, page int, text string, used_ocr boolean")
    cfg = ChunkConfig(4, 2, ("",))
    rows = chunking.chunk_pages(pages, cfg).orderBy("chunk_id").collect()
    assert [r.text for r in rows] == ["abcd", "cdefgh", "ghij"] and [r.char_start for r in rows] == [0, 2, 6]


def test_length_stats(spark):
    df = spark.createDataFrame([("ab", True), ("abcd", False), ("abcdef", None)], "text string, used_ocr boolean")
    r = chunking.length_stats(df).first()
    assert (r.n, r.n_ocr, r.chars_median, r.chars_p25, r.chars_max) == (3, 1, 4, 2, 6)


LOG = "seq bigint, question_id string, model string, difficulty string, answerable boolean, use_retrieval boolean, reference_version string, m double"


def test_log_means_and_consistency(spark):
    rows = [(1, "e1", "A", "easy", True, True, "v1", 0.8), (2, "e1", "A", "easy", True, True, "v1", 0.9), (3, "e2", "A", "easy", True, True, "v1", 0.6), (4, "e2", "A", "easy", True, True, "v1", float("nan")), (5, "h1", "A", "hard", True, True, "v1", None)]
    df = spark.createDataFrame(rows, LOG)
    assert {r.question_id: round(r.value, 6) for r in log.question_means(df, "m").collect()} == {"e1": 0.85, "e2": 0.6}
    assert log.consistency(df, ["m"]).isEmpty() and log.version_problems(df).isEmpty()
    other = df.unionByName(spark.createDataFrame([(7, "e9", "A", "hard", True, False, "v1", 0.1)], LOG))  # without retrieval: nothing to reconcile
    assert log.reconciled(other, ["m"]).first().overall == pytest.approx(0.725)
    r = log.intervals(df, ["m"], ["model"], n_resamples=200).first()
    assert (r["mean"], r.n) == (pytest.approx(0.725), 2) and r.ci_low <= r["mean"] <= r.ci_high
    worst = log.intervals(df, ["m"], ["model"], n_resamples=200, statistic=np.max).first()
    assert worst["mean"] == pytest.approx(0.85)
    assert log.overall_table(df, ["m"]).first().m == pytest.approx(0.725)
    odd = df.unionByName(spark.createDataFrame([(6, "b1", "A", "bonus", True, True, "v2", 0.99)], LOG))
    assert not log.consistency(odd, ["m"]).isEmpty() and log.version_problems(odd).first().versions == ["v1", "v2"]
    assert log.where(df, missing=None).count() == 5 and log.where(df, missing=1).count() == 0


def test_statistics(spark):
    a, b = [0.5 + 0.01 * i for i in range(8)], [0.3 + 0.011 * i for i in range(8)]
    r = stats.compare([x + 0.2 for x in b], b, 500)
    assert r[3] == pytest.approx(0.2) and r[6] < 0.05 and r[8] == pytest.approx(stats.compare(a, b, 10)[8], abs=1) and r[9] == "large"
    assert stats.compare(a, a, 10)[3] == 0 and stats.compare(a, a, 10)[6] == 1
    assert stats.wilcoxon([1, 2, 3])[1] == pytest.approx(0.25) and stats.student_p(2.0, 10) == pytest.approx(0.07338, abs=1e-4)
    p = spark.createDataFrame([("x", 0.01), ("y", 0.02), ("z", 0.03), ("n", float("nan"))], "name string, wilcoxon_p double")
    assert [round(r.p_adjusted, 6) for r in stats.holm(p).orderBy("wilcoxon_p").collect()] == [0.03, 0.04, 0.04]
    assert (stats.required_sample_size(), stats.required_sample_size(population=62), stats.paired_sample_size()) == (451, 55, 46)
    assert stats.paired_sample_size(comparisons=10) > stats.paired_sample_size(comparisons=2) > 46
    rows = [(2 * k + m, f"q{k}", "AB"[m], "easy", True, True, "v1", 0.1 * k * m) for k in range(4) for m in range(2)]
    sd = stats.paired_sd(spark.createDataFrame(rows, LOG), "m").first()
    assert (sd.name_a, sd.n, sd.sd) == ("A", 4, pytest.approx(np.std([0, 0.1, 0.2, 0.3], ddof=1)))
    assert stats.paired_sd(spark.createDataFrame(rows[:1], LOG), "m").first() is None
    d = stats.describe(spark.createDataFrame([("g", i, 1 / 3) for i in range(3)], "g string, o int, v double"), ["g"], "v", "o").first()
    assert (d["mean"], d.n) == (0.3333, 3)


def test_bootstrap_is_the_stated_one(spark):
    v = [0.1, 0.5, 0.2, 0.9]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(v)], "g string, o int, v double")
    r = stats.bootstrap(df, ["g"], "v", "o", 300).first()
    draws = np.array(v)[np.random.default_rng(20240101).integers(0, 4, (300, 4))].mean(axis=1)
    assert (r.ci_low, r.ci_high) == tuple(np.quantile(draws, [0.025, 0.975])) or np.allclose((r.ci_low, r.ci_high), np.quantile(draws, [0.025, 0.975]))


def test_bootstrap_queries_draw_the_whole_number(monkeypatch):
    from quern import queries

    drawn = []
    monkeypatch.setattr(queries, "_log", lambda s, d: None)
    monkeypatch.setattr(queries.log, "question_means", lambda *a, **k: None)
    for name in ("bootstrap", "rag_ablation", "significance"):
        default = inspect.signature(getattr(stats, name)).parameters["n_resamples"].default
        at = 4 if name == "bootstrap" else 2
        monkeypatch.setattr(queries.stats, name, lambda *a, at=at, default=default, **k: drawn.append(a[at] if len(a) > at else k.get("n_resamples", default)))
    for name in ("bootstrap_ci", "paired_comparison", "pairwise_significance"):
        queries.REGISTRY[name](None, "")
    assert drawn == [10_000] * 3


def test_bootstrap_blocks_are_the_one_matrix(monkeypatch):
    v = np.random.default_rng(1).random(37)
    draws = v[np.random.default_rng(stats.SEED).integers(0, 37, (1000, 37))].mean(axis=1)
    monkeypatch.setattr(stats, "BLOCK", 111)
    assert np.allclose(stats.interval(v, 1000)[1:3], np.quantile(draws, [0.025, 0.975]), rtol=0, atol=1e-12)


def test_cliffs_delta_against_all_pairs(spark):
    rng = random.Random(2)
    a, b = [rng.randint(0, 5) for _ in range(30)], [rng.randint(0, 5) for _ in range(20)]
    da, db = (spark.createDataFrame([("g", float(x)) for x in v], "g string, value double") for v in (a, b))
    brute = sum((x > y) - (x < y) for x in a for y in b) / 600
    assert stats.cliffs_delta(da, db, ["g"]).first().delta == pytest.approx(brute)


def test_faithfulness(spark):
    r = spark.createDataFrame([("abstained", False), ("ok", False), ("abstained", None), ("ok", True)], "status string, answerable boolean")
    x = faithfulness.abstention(r).first()
    assert (x.abstention_recall, x.false_abstention_rate) == (0.5, 0.5)
    j = spark.createDataFrame([("u1", "a"), ("u1", "a"), ("u2", "a"), ("u2", "b"), ("u3", "b")], "u string, verdict string")
    alpha = faithfulness.nominal_alpha(j, ["u"]).first().alpha
    assert alpha == pytest.approx((0.5 - 6 / 12) / (1 - 6 / 12))
    assert math.isnan(faithfulness.nominal_alpha(j.where("false"), ["u"]).first().alpha)


def test_sweeps(spark):
    c = spark.createDataFrame([(1, "a", 0.9, 0), (1, "b", 0.6, 1), (2, "x", 0.2, 0)], "query_id bigint, chunk_id string, score double, rank int")
    q = spark.createDataFrame([(1, ["b"], True), (2, ["y"], True)], "query_id bigint, gold array<string>, answerable boolean")
    r = {(x.k, x.threshold): x for x in sweeps.sweep_retrieval(c, q, (1, 2), (0.0, 0.5), (0.0,)).collect()}
    assert len(r) == 4 and r[2, 0.5].recall == 0.5 and r[2, 0.5].abstention_rate == 0.5 and r[1, 0.0].recall == 0
    with pytest.raises(ValueError):
        sweeps.calibrate_threshold(spark.createDataFrame([(1, 0.6, True)], "query_id bigint, top_score double, answerable boolean"))
    t = spark.createDataFrame([(1, 0.6, True), (2, 0.3, False), (3, float("nan"), False)], "query_id bigint, top_score double, answerable boolean")
    best = sweeps.calibrate_threshold(t).where("best").first()
    assert best.threshold == pytest.approx(0.35) and best.f1 == 1


def test_benchmark_rules(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_text('{"_meta": {"name": "n", "version": "v2"}}\n// note\n\n{"question_id": "a", "question": "q", "difficulty": "easy", "references": ["r"]}\n{"question_id": "a", "question": "q", "difficulty": "unanswerable", "references": []}\n', encoding="utf-8")
    df, meta = io.read_benchmark(spark, str(path))
    assert meta["version"] == "v2" and df.count() == 2
    assert {r.problem for r in benchmark.constraint_problems(df).collect()} == {"answerable without reference", "unanswerable tier marked answerable"}
    assert "duplicate id" in {r.problem for r in benchmark.validate(df).collect()}
    path.write_text('{"question_id": "a", "bad": 1}\n')
    with pytest.raises(ValueError, match="line 1"):
        io.read_benchmark(spark, str(path))


def test_config_round_trip(tmp_path):
    c = PipelineConfig(chunk=ChunkConfig(300, 30))
    p = tmp_path / "c.json"
    p.write_text(c.to_json())
    assert PipelineConfig.load(p) == c and len(c.fingerprint) == 16 and c.fingerprint != PipelineConfig().fingerprint
    assert c.condition_id == "gemma3-4b__rag__k5__c300"
    with pytest.raises(TypeError):
        PipelineConfig.from_dict({"chunk": {"sizes": 3}})


def test_tables():
    t = Table("c", "l", ["a", "b"], [["x", 0.12345], [None, float("nan")]], "note")
    assert "| x | 0.123 |" in t.to_markdown() and "x & 0.123" in t.to_latex() and t.to_csv().startswith("a,b\n")
    assert cell(0.12345, 0.1, 0.2) == "0.123 [0.100, 0.200]" and cell(None) == "--"


def encode(df, column):
    return df.withColumn("embedding", F.array(*(F.length(F.regexp_replace(F.col(column), f"[^{c}]", "")).cast("float") for c in "ಅಬಕಟ")))


def test_pipeline_end_to_end(spark, tmp_path):
    cfg = PipelineConfig(index_dir=str(tmp_path / "index"), chunk=ChunkConfig(40, 0), generation=PipelineConfig().generation.__class__(provider="echo", model="echo", num_repeats=2))
    pages = spark.createDataFrame([("f.pdf", 1, "ಅಅಅ ಅಅಅ ಅಅ", False), ("f.pdf", 2, "ಬಬಬ ಬಬಬ ಕ", False)], "source_file string, page int, text string, used_ocr boolean").withColumns({"ocr_attempted": F.lit(False), "ocr_rejected": F.lit(False), "kannada_ratio": F.lit(1.0)})
    index = pipeline.build_index(spark, cfg, encode, pages)
    with pytest.raises(ValueError):
        io.load_index(spark, cfg.index_dir, "other")
    q = spark.createDataFrame([("q1", "ಅಅ ಅ"), ("q2", "English?"), ("q3", "ಟಟಟ")], "question_id string, question string")
    r = {x.question_id: x for x in pipeline.ask(q, index, cfg, encode).collect()}
    assert r["q1"].status == "ok" and "ಅಅಅ" in r["q1"].answer and r["q1"].sources[0].citation == "f.pdf p.1"
    assert r["q2"].status == "rejected_language" and r["q3"].status == "abstained" and r["q3"].answer == prompts.ABSTENTION
    full = spark.createDataFrame([("q1", "ಅಅ ಅ", "easy", ["ಅಅಅ ಅಅಅ"], "v1", True, ["f.pdf#p1#c0"], [1], "f.pdf", None, False, ["x"], "")], "question_id string, question string, difficulty string, references array<string>, reference_version string, answerable boolean, gold_chunk_ids array<string>, gold_pages array<int>, source_file string, author string, author_independent boolean, validated_by array<string>, notes string")
    rec = pipeline.run_condition(full, index, cfg, encode)
    rows = rec.collect()
    assert len(rows) == 2 and rows[0]["recall@1"] == 1 and rows[0].rouge1_f1 > 0 and rows[0].total_latency_s > 0
    assert [r.seq for r in sorted(rows, key=lambda r: r.repeat)] == sorted(r.seq for r in rows)
    path = str(tmp_path / "log")
    load = lambda: lambda hs, rs: [(0.5, 0.25, 1 / 3)] * len(hs)
    pipeline.run_conditions([cfg, cfg.with_(use_retrieval=False)], full, index, encode, path, scorer=load)
    both, meta = io.read_records(spark, path)
    assert both.count() == 4 and both.columns == rec.columns and meta["config"]["use_retrieval"] is True and both.where("bert_f1 > 0.3").count() >= 2
    assert both.where("use_retrieval").agg(F.max("seq")).first()[0] < both.where("NOT use_retrieval").agg(F.min("seq")).first()[0]
    out = pipeline.build_tables(both, tmp_path / "tables", meta=meta, source=path)
    assert {"quality_easy", "quality_overall", "retrieval", "latency", "rag_ablation", "significance"} == set(out)
    assert (tmp_path / "tables" / "latency.tex").exists() and "run_metadata" in (tmp_path / "tables" / "provenance.json").read_text()
    assert out["latency"].rows[0][:3] == ["echo", "local", 2] and "[" in out["quality_overall"].rows[0][2]
    assert pipeline.build_tables(both.withColumn("bert_f1", F.lit(None).cast("double")).where("false"), tmp_path / "none")["significance"].rows == [["insufficient data"]]


def test_commands_over_a_log(spark, tmp_path, monkeypatch, capsys):
    from quern import cli

    rows = [f'{{"question_id": "q{k}", "question": "q", "difficulty": "easy", "answerable": true, "reference_version": "v1", "condition": "c{m}", "model": "m{m}", "use_retrieval": true, "repeat": 0, "status": "ok", "answer": "One. Two.", "is_local": true, "rouge1_f1": 0.{k}{m}, "retrieved": [{{"chunk_id": "x", "source_file": "f", "page": 2, "text": "t"}}]}}' for m in range(2) for k in range(1, 5)]
    path = tmp_path / "log.jsonl"
    path.write_text('{"_meta": {"a": 1}}\n\n' + "\n".join(rows) + '\n{"_meta": {"a": 2}}\n')
    records, meta = io.read_records(spark, str(path))
    assert meta == {"a": 2} and [r.question_id for r in records.orderBy("seq").collect()] == [f"q{k}" for _ in range(2) for k in range(1, 5)]
    assert cli.main(["tables", str(path), "--out", str(tmp_path / "t")]) == 0 and (tmp_path / "t" / "significance.csv").read_text().startswith("Model A,")
    assert cli.main(["annotate", str(path), "--out", str(tmp_path / "sheet")]) == 0
    back = spark.read.csv(str(tmp_path / "sheet"), header=True, multiLine=True, escape='"')
    assert back.columns == annotation.COLUMNS and back.count() == 16 and back.where("claim_index = 0").first().citations == "f p.2"
    assert cli.main(["power", "--from-log", str(path), "--metric", "rouge1_f1"]) == 0 and '"pairs"' in capsys.readouterr().out
    assert cli.main(["ocr", "--sample-size"]) == 0 and capsys.readouterr().out.strip() == "55"


def test_foreign_log_in_splits(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(f'{{"question_id": "q{i}", "answer": "{"x" * (i % 50)}"}}' for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df, _ = io.read_log(spark, str(path))
        assert df.rdd.getNumPartitions() > 3
        assert [r.question_id for r in df.orderBy("seq").select("question_id").collect()] == [f"q{i}" for i in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sweeps_that_rebuild_the_index(spark):
    pages = spark.createDataFrame([("f", 1, "the temple wall is old and tall and red", False), ("f", 2, "the river bank is green and wide and cold", False)], "source_file string, page int, text string, used_ocr boolean")
    q = spark.createDataFrame([("a", "temple wall", True, ["f#p1#c0"], [1], "f"), ("b", "river bank", True, [], [2], "f"), ("c", "none", False, [], [], None)], "question_id string, question string, answerable boolean, gold_chunk_ids array<string>, gold_pages array<int>, source_file string")
    r = {(x.chunk_size, x.chunk_overlap): x for x in sweeps.sweep_chunking(pages, q, hashed_encoder(32), sizes=(20, 60), overlaps=(0, 20)).collect()}
    assert set(r) == {(20, 0), (60, 0), (60, 20)} and r[60, 0].n_chunks == 2 and r[60, 0]["recall@5"] == 1

    def broken(df, column):
        raise RuntimeError("no model")

    e = {x.encoder: x for x in sweeps.sweep_encoders(chunking.chunk_pages(pages, ChunkConfig(60, 0)), q, {"hashed": hashed_encoder(32), "broken": broken}).collect()}
    assert e["hashed"].dim == 32 and e["hashed"]["mrr@10"] == 1 and e["broken"].note == "failed: no model"
    with pytest.raises(ValueError):
        sweeps.gold_of(q.where("NOT answerable"))


def test_sentence_encoder_with_a_given_model(spark):
    df = spark.createDataFrame([("ab",), (None,)], "text string")
    load = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    v = [r.embedding for r in sentence_encoder(load=load)(df, "text").collect()]
    assert v[0] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and v[1] == [0, 1]


def test_service(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from quern.service import Service, server

    cfg = PipelineConfig(generation=PipelineConfig().generation.__class__(provider="echo", model="echo"))
    index = encode(spark.createDataFrame([("f#p1#c0", "ಅಅಅ ಅಅಅ", "f", 1, False)], "chunk_id string, text string, source_file string, page int, used_ocr boolean"), "text")
    service = Service(spark, cfg, encode)
    http = server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", None if body is None else json.dumps(body).encode())) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/api/health")[0] == 503 and call("/api/ask", {"query": "ಅ"})[0] == 503
        service.start(index)
        assert call("/api/health")[1]["n_chunks"] == 1
        status, r = call("/api/ask", {"query": "ಅಅ ಅ", "k": 3})
        assert (status, r["status"], r["sources"][0]["citation"], r["sources"][0]["excerpt"]) == (200, "ok", "f p.1", "ಅಅಅ ಅಅಅ") and "ಅಅಅ" in r["answer"]
        assert call("/api/ask", {"query": "English"})[1]["status"] == "rejected_language"
        assert [call("/api/ask", b)[0] for b in ({"query": ""}, {"query": "ಅ" * 1001}, {"query": "ಅ", "k": 0}, {"query": "ಅ", "k": 21}, [], {})] == [422] * 6
        assert call("/nowhere")[0] == 404
    finally:
        http.shutdown()


@pytest.mark.parametrize("use_retrieval", [True, False])
def test_each_repeat_has_its_own_generation(spark, tmp_path, monkeypatch, use_retrieval):
    cfg = PipelineConfig(index_dir=str(tmp_path / "index"), chunk=ChunkConfig(40, 0), use_retrieval=use_retrieval, generation=PipelineConfig().generation.__class__(provider="echo", model="echo", num_repeats=3))
    monkeypatch.setattr(pipeline, "generate", lambda df, c: generate(df, c).withColumn("generation", F.col("generation").withField("text", F.uuid())))
    pages = spark.createDataFrame([("f.pdf", 1, "ಅಅಅ ಅಅಅ ಅಅ", False)], "source_file string, page int, text string, used_ocr boolean").withColumns({"ocr_attempted": F.lit(False), "ocr_rejected": F.lit(False), "kannada_ratio": F.lit(1.0)})
    index = pipeline.build_index(spark, cfg, encode, pages)
    rows = [(i, t, "easy", ["ಅಅಅ"], True, ["f.pdf#p1#c0"], [1], "f.pdf") for i, t in (("q1", "ಅಅ ಅ"), ("q2", "English?"), ("q3", "ಅಅಅ"))]
    q = spark.createDataFrame(rows, "question_id string, question string, difficulty string, references array<string>, answerable boolean, gold_chunk_ids array<string>, gold_pages array<int>, source_file string")
    out = pipeline.run_condition(q, index, cfg, encode).select("question_id", "repeat", "answer").collect()
    assert sorted((r.question_id, r.repeat) for r in out) == [(i, n) for i in ("q1", "q2", "q3") for n in range(3)]
    assert len({r.answer for r in out if r.question_id != "q2"}) == 6


def test_echo_forms_agree(spark):
    df = spark.createDataFrame([("ಪ್ರಶ್ನೆ", "[1] (f p.1) first\n\nsecond"), ("ಪ್ರಶ್ನೆ", None)], "q string, c string").withColumn("prompt", prompts.build_prompt(F.col("q"), F.col("c")))
    cfg = PipelineConfig().generation.__class__(provider="echo")
    for r in generate(df, cfg).collect():
        assert r.generation.text == next(responses(cfg, [r.prompt]))["text"]
    with pytest.raises(ValueError):
        generate(df, PipelineConfig().generation.__class__(provider="nobody"))


def test_a_failed_generation_is_a_row():
    cfg = PipelineConfig().generation.__class__(provider="ollama", ollama_host="http://127.0.0.1:9", timeout_s=1)
    r = next(responses(cfg, ["x"]))
    assert r["text"] == "" and r["error"] and r["is_local"] is True and r["honoured_settings"] == {}


def test_annotation(spark):
    df = spark.createDataFrame([(1, "q", "c", " ", "x"), (2, "q", "c", "One. Two.", "x"), (3, "q", "c", "Later.", "x")], "seq bigint, question_id string, condition string, answer string, context string")
    first = annotation.first_answers(df)
    assert [r.seq for r in first.collect()] == [2]
    assert [(r.claim_index, r.claim, r.retrieved_context) for r in annotation.claims(first, "context").orderBy("claim_index").collect()] == [(0, "One.", "x"), (1, "Two.", annotation.POINTER)]


def test_stream(spark, tmp_path):
    from quern.streaming.questions import answer_stream

    spark.createDataFrame([("a",)], "question string").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("question string").parquet(str(tmp_path / "in"))
    answer_stream(src, lambda b: b.withColumn("n", F.length("question")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().n == 1


def test_overlaps_of_a_batch_against_counting_each_row(spark):
    rng = random.Random(11)
    rows = [(i, None if i == 0 else [rng.choice(["a", "b", "ab", "ಕ"]) for _ in range(rng.randint(0, 9))], [rng.choice(["a", "b", "ba", "ಕ"]) for _ in range(rng.randint(0, 9))]) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, h array<string>, r array<string>")
    h, r = F.col("h"), F.col("r")
    out = {x.k: x for x in df.select("k", ov.rouge_n(h, r, 2).alias("two"), ov.chrf(h, r).alias("c"), ov.containment(F.array_join(h, ""), F.array_join(r, ""), 3).alias("in3")).collect()}
    grams = lambda x, n: [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
    short = lambda t, n: [t[i : i + n] for i in range(len(t) - n + 1)] or ([t] if t else [])
    met = lambda a, b: sum((Counter(a) & Counter(b)).values())
    for k, a, b in rows:
        a, x = a or [], out[k]
        g, w = grams(a, 2), grams(b, 2)
        assert x.two.precision == pytest.approx(met(g, w) / max(len(g), 1)) and x.two.recall == pytest.approx(met(g, w) / max(len(w), 1))
        s, t = "".join(a), "".join(b)
        assert x.in3 == pytest.approx(met(short(s, 3), short(t, 3)) / max(len(short(s, 3)), 1))
        ps = [met(short(s, n), short(t, n)) / max(len(short(s, n)), 1) for n in range(1, 7)]
        rs = [met(short(s, n), short(t, n)) / max(len(short(t, n)), 1) for n in range(1, 7)]
        p, q = sum(ps) / 6, sum(rs) / 6
        assert x.c == pytest.approx(5 * p * q / (4 * p + q) if p + q else 0)


def test_top_k_beyond_a_block_and_with_ties(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "TILE_ROWS", 7)
    monkeypatch.setattr(retrieval, "TILE_QUERIES", 2)
    rows = [(f"c{i:02d}", [float(i % 3), 1.0]) for i in range(20)]
    df = spark.createDataFrame([*rows, ("none", None)], "id string, embedding array<float>")
    got = retrieval.top_k(df.where("id < 'c08'"), df, 4, "id", "id").collect()
    assert len(got) == 8 * 4
    for r in got:
        same = sorted(f"c{i:02d}" for i in range(20) if i % 3 == int(r.query_id[1:]) % 3)
        assert r.chunk_id == same[r["rank"]] and r.score == pytest.approx(1)
    assert retrieval.top_k_blocked(df.where("false"), df, 4, "id", "id").count() == 0 and retrieval.top_k_blocked(df, df.where("false"), 4, "id", "id").count() == 0


def test_ocr_evaluation(spark):
    pages = spark.createDataFrame([("f", 1, "abc", True), ("f", 2, "abd", True)], "source_file string, page int, text string, used_ocr boolean").withColumns({"ocr_attempted": F.lit(True), "ocr_rejected": F.lit(False), "kannada_ratio": F.lit(0.0)})
    t = spark.createDataFrame([("f", 1, "abc"), ("f", 2, "abc"), ("f", 9, "x")], "source_file string, page int, transcription string")
    told = ocr.evaluate(t, pages)
    b = {r.block: r for r in told["blocks"].collect()}
    assert (b["ocr"].n, b["ocr"].cer_mean, b["native"].n, b["native"].cer_mean) == (2, 0.1667, 0, None) and b["all"].cer_std == 0.2357
    assert told["unmatched"].first().page == 9 and told["summary"].first().n_pages == 2


def test_external_scorer(spark):
    df = spark.createDataFrame([(1, "ab", ["a", "ab"])], "k int, h string, r array<string>")
    load = lambda: lambda hs, rs: [(float(h == r),) * 3 for h, r in zip(hs, rs)]
    assert ov.external_scores(df, ["k"], "h", "r", load).first().bert_f1 == 1
