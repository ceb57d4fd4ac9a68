"""Odd input, hand-made cases and brute-force comparisons of the text operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import consensus, cutoff, endings, leaks, lookalike, packing, pairs, reading, scannoise, sentences, split
from quern.llm.scripts import language

KN = ["ಈ ಗೋಪುರ 1537 ರಲ್ಲಿ ಕಟ್ಟಲಾಯಿತು.", "ಡಾ. ರೋಶ ಅವರು ಜೂನ್ ತಿಂಗಳಲ್ಲಿ ಹೋದರು.", "ಅದರ ಎತ್ತರ 30.8 ಮೀ. ಇದೆ.", "ಅಜ್ಜಿ ಹೇಳಿದರು: “ಕೆರೆ ಒಣಗುವುದಿಲ್ಲ. ಅದು ನಮ್ಮದು.”"]
EN = ["Dr. Vale walked to Moga at 6 a.m. with 32 boatmen.", "The lamps are lit at 6 p.m. The wall is 3.5 m high.", "“Is it old?” asked a guide from Moga.", "Nearby stand lamps, wells, etc. Who built it?"]
DE = ["Der Palast wurde am 12. Oktober 1221 gebaut.", "Die Weber brachten Öl, Korn usw. Der Steg ist alt.", "Der Führer sagte: „Er ist rund. Er steht.“ Die Mauer ist hoch."]
JA = ["この橋は1303年にできました。高さは2.8メートルです。", "「とても古いですね。」と子どもが言いました。"]
TH = ["ป้อมนี้สร้างเมื่อปี 1260 กำแพงสูง 39.5 เมตร ป้อมสูงใหญ่มาก", "กำแพงสูง 17 เมตร ป้อมนี้สร้างเมื่อปี 99", "ผู้คนมาที่นี่ ป้อมสูงใหญ่มาก"]


# 1 sentences
def cut(text, model):
    return [text[a:b] for a, b in sentences.units(text, model)]


@pytest.fixture(scope="module")
def model():
    ends = ["The lamps are lit at 6 p.m.", "Nearby stand lamps, wells, etc.", "Die Weber brachten Öl, Korn usw.", "ಅದರ ಎತ್ತರ 30.8 ಮೀ."]
    return sentences.train((KN + EN + DE + JA + TH + ends) * 40)


def test_sentences_across_languages(model):
    assert cut(EN[0], model) == [EN[0]] and cut(EN[2], model) == [EN[2]]
    assert cut(EN[1], model) == ["The lamps are lit at 6 p.m.", "The wall is 3.5 m high."]
    assert cut(EN[3], model) == ["Nearby stand lamps, wells, etc.", "Who built it?"]
    assert all(cut(t, model) == [t] for t in KN)
    assert cut(DE[0], model) == [DE[0]] and len(cut(DE[1], model)) == 2 and cut(DE[2], model)[0].endswith("“")
    assert len(cut(JA[0], model)) == 2 and cut(JA[1], model) == [JA[1]]
    assert cut(TH[0], model) == ["ป้อมนี้สร้างเมื่อปี 1260", "กำแพงสูง 39.5 เมตร", "ป้อมสูงใหญ่มาก"]


def test_abbreviations_are_learnt_from_line_ends():
    rng = random.Random(3)
    noun = lambda: rng.choice(["Roe", "Ann", "Lee", "Moss", "Hill", "Reed"])
    verb = lambda: rng.choice(["left", "rested", "sang", "slept", "waited", "prayed"])
    say = lambda: rng.choice([f"Capt. {noun()} {verb()}.", f"The Rev. {noun()} {verb()}.", f"{noun()} {verb()}."])
    texts = [" ".join(say() for _ in range(rng.randint(1, 4))) for _ in range(400)]
    m = sentences.train(texts)
    assert m["known"]["inner"] == {"capt", "rev"} and not m["known"]["carry"]
    assert cut("Capt. Moss sang. The Rev. Hill left. Ann prayed.", m) == ["Capt. Moss sang.", "The Rev. Hill left.", "Ann prayed."]


def test_words_that_carry_on_are_learnt(spark):
    rng = random.Random(3)
    verbs, names = ["ಬಂದರು", "ಹೋದರು", "ನಿಂತರು", "ಹಾಡಿದರು"], ["ರಾಮ", "ಸೀತೆ", "ಕೃಷ್ಣ", "ಗೌರಿ"]
    say = lambda: rng.choice([f"ಗೋಡೆ {rng.randint(2, 90)} ಮೀ. ಇದೆ.", f"{rng.choice(names)} {rng.choice(verbs)}.", f"ದಾರಿ {rng.randint(2, 90)} ಮೀ."])
    df = spark.createDataFrame([(" ".join(say() for _ in range(rng.randint(1, 4))),) for _ in range(400)], "t string")
    m = sentences.learn(df, "t")
    assert ("ಮೀ", "ಇದೆ") in m["known"]["carry"] and not m["known"]["inner"]
    assert cut("ಗೋಡೆ 7 ಮೀ. ಇದೆ. ದಾರಿ 9 ಮೀ. ರಾಮ ಬಂದರು.", m) == ["ಗೋಡೆ 7 ಮೀ. ಇದೆ.", "ದಾರಿ 9 ಮೀ.", "ರಾಮ ಬಂದರು."]
    assert sentences.learn(df.where("false"), "t")["w"] == {}


def test_sentences_of_odd_text(model):
    assert cut("", model) == [] and sentences.units(None, model) == [] and cut(" … \n -", model) == []
    assert cut("Heading\nOne line. Two", model) == ["Heading", "One line.", "Two"]
    assert cut("no break at all", sentences.train([])) == ["no break at all"]
    assert cut("ಕೆರೆ ಒಣಗುವುದಿಲ್ಲ. ಅದು ನಮ್ಮದು.” ಇಲ್ಲಿ ರೈತರು ಇದ್ದರು.", model) == ["ಕೆರೆ ಒಣಗುವುದಿಲ್ಲ. ಅದು ನಮ್ಮದು.”", "ಇಲ್ಲಿ ರೈತರು ಇದ್ದರು."]
    long = "Dr. Vale came. " * 20_000
    assert len(cut(long, model)) == 20_000


def test_viterbi_against_all_paths():
    from itertools import product

    rng = random.Random(0)
    for _ in range(50):
        emit = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 7))]
        trans = {(a, b): rng.uniform(-1, 1) for a in (0, 1) for b in (0, 1)}
        score = lambda tags: sum(e for e, t in zip(emit, tags) if t) + sum(trans[p, q] for p, q in zip(tags, tags[1:]))  # noqa: E731, B023
        assert score(sentences.viterbi(emit, trans)) == pytest.approx(max(map(score, product((0, 1), repeat=len(emit)))))


def test_sentence_rows(spark):
    rows = [("answers", "1", EN[1], "x"), ("answers", "2", None, "x"), ("answers", "3", "", "x"), ("chunks", "c", DE[1], "x"), ("chunks", "c", DE[1], "x")]
    df = spark.createDataFrame(rows, "unit_table string, row_key string, text string, start_pos string")
    out = sentences.sentence_units(df)
    assert out.columns == ["unit_table", "row_key", "start_pos", "end_pos"] and out.count() == 2 + 2 * 2
    assert sentences.sentence_units(df.where("false")).count() == 0


# 2 splitting
def test_pieces_hold_their_limits():
    rng = random.Random(4)
    seps = ["\n\n", "\n", "॥", "।", ". ", " ", ""]
    for _ in range(150):
        text = "".join(rng.choice(["ಕನ್ನಡ ", "abc. ", "x" * 40, "\n", "।", "é"]) for _ in range(rng.randint(0, 120)))
        size, overlap = rng.randint(5, 80), rng.randint(0, 30)
        out = split.pieces(text, size, overlap, seps)
        assert bool(out) == (len(text) > size)
        if out:
            ov = min(overlap, size - 1)
            assert out[0][0] == 0 and out[-1][1] == len(text) and all(b - a <= size for a, b in out)
            assert all(n[0] == max(p[1] - ov, 0) for p, n in zip(out, out[1:]))


def test_edit_alters_neighbours_only():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    a = {text[x:y] for x, y in split.pieces(text, 300, 0, [" "])}
    edited = text[:5000] + "INSERTED WORDS " + text[5000:]
    b = {edited[x:y] for x, y in split.pieces(edited, 300, 0, [" "])}
    assert len(a - b) <= 0.15 * len(a)


def test_split_rows(spark):
    chunks = spark.createDataFrame([("a", "x y " * 200, None, "k"), ("a", "x y " * 200, None, "k"), ("b", "short", 1, "k"), ("c", None, 1, "k"), ("d", "z" * 700, 99, "k")], "chunk_id string, text string, config_id int, chunk_size string")
    configs = spark.createDataFrame([(1, 500, 50, ["\n", " ", ""])], "config_id int, chunk_size int, chunk_overlap int, separators array<string>")
    out = split.split_oversized(chunks, configs)
    assert {r.chunk_id for r in out.collect()} == {"a", "d"} and out.groupBy("chunk_id", "piece_no").count().where("count > 1").count() == 0
    assert split.split_oversized(chunks.where("false"), configs).count() == 0


# 3 look-alikes
def test_unify():
    u = lookalike.unify
    assert u("Ｗｈｏ　ｂｕｉｌｔ") == "Who built" and u("é") == "é" and u("a​b⁠") == "ab"
    assert u("the сavе") == "the cave" and u("give tο the") == "give to the" and u("ರ\u0c32\u0ccd\u0cb2\u0cbf") == "ರಲ್ಲಿ"
    assert u("x²") == "x²" and u("ﬁne") == "ﬁne" and u("Cave") != u("cave") and u("ಕ್‌ಷ") != u("ಕ್ಷ")
    assert u("Москва") == "Москва" and u(None) is None and u("") == "" and u("นํา") == "นำ"


def test_lookalike_pairs(spark):
    rows = [(1, "cave A"), (2, "саve A"), (3, "cave A"), (4, "cave A"), (5, None), (6, ""), (7, "Cave A")]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("look", F.lit("clash"))
    pairs_ = lookalike.lookalike_pairs(lookalike.lookalike_classes(df, "query", "id", "text"))
    assert {(r.id_a, r.id_b) for r in pairs_.collect()} == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4)}
    assert lookalike.lookalike_pairs(lookalike.lookalike_classes(df.where("false"), "query", "id", "text")).count() == 0
    links = {r.id: (r.class_id, r.n_links) for r in lookalike.lookalike_links(lookalike.lookalike_classes(df, "query", "id", "text")).collect()}
    assert {i: n for i, (_, n) in links.items()} == {1: 2, 2: 3, 3: 2, 4: 3, 7: 0} and len({c for c, _ in links.values()}) == 2


def test_lookalike_pairs_of_a_popular_look(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "PAIR_ROWS", 5)
    rng = random.Random(1)
    rows = [(i, "q", rng.choice("aaaabc"), rng.choice("xxxy")) for i in range(60)]
    classes = spark.createDataFrame(rows, "id bigint, entity string, form string, look string")
    got = [(r.id_a, r.id_b) for r in lookalike.lookalike_pairs(classes).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3] and a[2] != b[2]}
    assert len(got) == len(want) and set(got) == want
    assert lookalike.lookalike_links(classes).agg(F.sum("n_links")).first()[0] == 2 * len(want)


# 4 consensus
JUDGEMENT = "judgement_id bigint, question_id string, condition_id string, claim_index int, annotator string, verdict string, judged_at timestamp, notes string"


def test_consensus_beats_majority(spark):
    rng = random.Random(8)
    skill = [0.95, 0.9, 0.35, 0.35, 0.35]
    rows, truth = [], {}
    for c in range(400):
        truth[c] = t = rng.choice(consensus.VERDICTS)
        for a, s in enumerate(skill):
            rows.append((len(rows), f"q{c}", "x", 0, f" ANN_{a}" if c % 2 else f"ann-{a}", (t if rng.random() < s else rng.choice(consensus.VERDICTS)).upper(), None, None))
    df = spark.createDataFrame(rows, JUDGEMENT)
    post, who = consensus.consensus(df)
    right = sum(truth[int(r.question_id[1:])] == r.verdict for r in post.collect())
    assert right > 0.88 * 400
    est = {r.annotator: r.accuracy for r in who.collect()}
    assert len(est) == 5 and est["ann-0"] > 0.85 > 0.6 > est["ann-3"]


@pytest.mark.parametrize("iterations", [1, consensus.ITERATIONS])
def test_consensus_is_the_same_for_any_number_of_annotators(spark, monkeypatch, iterations):
    rng = random.Random(5)
    rows = [(0, f"q{c}", "x", 0, f"a{a}", rng.choice(consensus.VERDICTS[: 2 + a]), None, None) for c in range(60) for a in range(3) if rng.random() < 0.8]
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], JUDGEMENT)
    got = []
    for most in (consensus.MAX_BROADCAST_ANNOTATORS, 0):
        monkeypatch.setattr(consensus, "MAX_BROADCAST_ANNOTATORS", most)
        post, who = consensus.consensus(df, iterations)
        got.append(({r.question_id: (r.verdict, r.n_annotators, round(r.p_supported, 9)) for r in post.collect()}, {r.annotator: (r.n_votes, round(r.accuracy, 9), round(r.kappa, 9)) for r in who.collect()}))
    assert got[0] == got[1]
    empty = consensus.consensus(df.where("false"))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_consensus_of_odd_rows(spark):
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "q", "c", 0, "a", "supported", at(1), None), (2, "q", "c", 0, "a", "contradicted.", at(2), None), (2, "q", "c", 0, "a", "contradicted.", at(2), None), (3, "q", "c", 0, "b", None, at(1), None), (4, None, "c", 0, "b", "supported", at(1), None), (5, "q", "c", 0, "b", "not in context", None, None), (6, "q", "c", 0, "a", "skip", at(3), None)]
    df = spark.createDataFrame(rows, JUDGEMENT)
    assert {(r.annotator, r.verdict) for r in consensus.votes(df).collect()} == {("a", "contradicted"), ("b", "not_in_context")}
    assert consensus.consensus(df)[0].first().n_annotators == 2
    empty = df.where("false")
    assert consensus.consensus(empty)[0].count() == 0 and consensus.agreement(empty).first().alpha is None


# 5 pairs
def test_pair_defects():
    assert pairs.is_nothing(None) and pairs.is_nothing(" ​\n") and pairs.is_nothing("N/A") and pairs.is_nothing("ಉತ್ತರ:") and not pairs.is_nothing("1286.")
    assert pairs.is_refusal("I'm sorry, but I cannot help with that.") and pairs.is_refusal("ಕ್ಷಮಿಸಿ, ಈ ಪ್ರಶ್ನೆಗೆ ನಾನು ಉತ್ತರಿಸಲಾರೆ.") and pairs.is_refusal("Es tut mir leid, dazu kann ich nichts sagen.")
    assert not pairs.is_refusal("Sorry tales are told of Moga, and no guide refuses to tell them.") and not pairs.is_refusal("The king of Moga declined to help the traders.")
    q = "Who built the cave of Moga in 900?"
    assert pairs.copies(q, "“" + q + "”") and pairs.copies(q, q + " " + q) and not pairs.copies(q, q + " The cave was built by the smiths of Vale.") and not pairs.copies(None, q)
    assert pairs.other_language("ಗುಹೆ ಯಾರು ಕಟ್ಟಿದರು?", "Die Mauer ist hoch und alt.") and not pairs.other_language(q, "Mogadore.") and pairs.other_language(q, "Il y a le mur de la ville.")
    assert language("この橋は古い") == "ja" and language("这座桥很古老") == "zh" and language("123") is None


def test_greedy_tiling_uses_each_stretch_once():
    covered = lambda a, q, n: "".join(w if m else "." for w, m in zip(a, pairs.tiles(list(a), list(q), n)))
    assert covered("xabcdyab", "abcd", 2) == ".abcd..." and covered("axb", "ab", 2) == "..." and covered("", "ab", 1) == ""
    assert covered("cdab", "abcd", 2) == "cdab" and covered("abab", "ab", 2) == "ab.."
    q = "Who built the old wall of Moga?"
    assert pairs.copies(q, f"{q} {q} {q}") and not pairs.copies(q, "The wall of Moga") and not pairs.copies(q, "wall old the built")


@pytest.mark.parametrize(
    ("text", "refuses"),
    [
        ("Sorry, that is something beyond what is possible here.", True),
        ("Lo siento, no puedo responder a esa pregunta.", True),
        ("I regret that I am not permitted to give any information about this matter, and I would kindly ask you to consult an expert, since the given documents provide nothing on which a response could be based.", True),
        ("We won't be able to comment on it.", True),
        ("Leider darf ich dazu keine Angaben machen.", True),
        ("Non posso rispondere a questa domanda.", True),
        ("Nobody could answer why the wall of Moga fell.", False),
        ("The priest refused to give the traders of Moga any help.", False),
        ("Sorry, I was asleep when the wall of Moga fell in June.", False),
        ("I cannot help with that. The wall was built in 1200 by the smiths.", False),
        (None, False),
        ("", False),
    ],
)
def test_refusal_grammar(text, refuses):
    assert pairs.is_refusal(text) is refuses


COMPLETE = [f"The wall of N{chr(97 + i % 26)}tirtha measures {i} m. The lamps of V{chr(97 + i % 20)}kote are lit in June. The door is made of slate." for i in range(120)]


def test_truncated_pairs(spark):
    rows = [(i, "Who built it?", t, "ok") for i, t in enumerate(COMPLETE)]
    rows += [(900, "Who built it?", "The lamps of Vakote are li", "ok"), (901, "Who built it?", "The door is made of slate", "ok"), (902, "Who built it?", "The wall (cf. vol", "ok"), (903, "Who built it?", None, "ok"), (904, "x", None, "error"), (905, "x", "", None)]
    df = spark.createDataFrame(rows, "seq bigint, question string, answer string, status string").withColumn("defect", F.lit("clash"))
    out = {r.seq: r.defect for r in pairs.defective_pairs(df).collect()}
    assert out == {900: "truncated", 902: "truncated", 903: "empty"}
    assert pairs.defective_pairs(df.where("false")).count() == 0


def test_contexts_by_column_are_those_of_each_place():
    rng = random.Random(2)
    units = [[(rng.randint(1, 9), rng.random() < 0.5) for _ in range(rng.randint(1, 20))] for _ in range(30)]
    codes = np.array([c for u in units for c, _ in u], np.uint64)
    char = np.array([c for u in units for _, c in u])
    place = np.concatenate([np.arange(len(u)) for u in units])
    named, plain = {}, {}
    for own, rank, keys in endings.contexts(codes, place, char, np.arange(len(codes))):
        for p, k in zip(own, keys):
            depth = endings.DEPTHS[bool(char[p])][rank]
            told = (depth, place[p] + 1 < depth, tuple(codes[max(p - depth + 1, p - place[p]) : p + 1]))
            assert named.setdefault(int(k), told) == told and plain.setdefault(told, int(k)) == int(k)
    assert len(plain) > 200


def test_pushdown_parser():
    assert endings.stack("<b>bold <i>and") == ["</b>", "</i>"] and endings.stack("<b>x</b> <br> <img src='a'> y") == [] and endings.stack("see <a hre") == [">"] and endings.stack("3 < 4") == []
    assert endings.stack("1. one\n2.") == ["item"] and endings.stack("1. one\n2. two") == [] and endings.stack("536.") == [] and endings.stack("- a\n- ") == ["item"]
    assert endings.stack("| a | b |\n| c | d") == ["|"] and endings.stack("| a | b |") == [] and endings.stack("**x** and **y") == ["**"] and endings.stack("`a (` b") == [] and endings.stack("```\nf(x [\n```") == [] and endings.stack("**a\n\nb") == []
    assert endings.stack("a (b [c") == [")", "]"] and endings.stack("“a” (b) „c“ 「d」") == [] and endings.stack("```x") == ["```"] and endings.stack("a) b") == []
    assert endings.closes("Done. [3]") is True and endings.closes("Dr.", frozenset({"dr"})) is False and endings.closes("Dr.") is True and endings.closes("and then,") is False and endings.closes("open") is None and endings.closes("") is None and endings.closes("of\ufffd") is False


# 6 scans
PAGE = "Old bridge    11\nThe territorial restruc-\nturing of the many old rain-\nfed fields was tbe work of the\nsmiths of the old town. The wall\nwas built in June.\n- 12 -"


def test_scan_noise(spark):
    body = "The territorial restructuring of the rain-fed fields was the work of the smiths. The wall was built in June and the wall stands behind the church of the hamlet. "
    rows = [(1, "f", "f#p1", True, PAGE), (2, "g", "g#p1", False, body * 30), (3, "f", "f#p2", None, None), (4, "f", "f#p3", True, ""), (5, "g", "g#p2", False, "bebind cburch bamlet " * 2 + "and more " * 20)]
    df = spark.createDataFrame(rows, "page_key bigint, source_file string, doc_id string, used_ocr boolean, text string").withColumn("line_no", F.lit("clash"))
    got = {(r.page_key, r.line_no, r.kind) for r in scannoise.noise(df).collect()}
    assert got == {(1, 1, "running_header"), (1, 2, "hyphen_break"), (1, 4, "misread"), (1, 7, "page_number")}
    text = {r.page_key: r.text for r in scannoise.repair(df).collect()}
    assert text[1] == "The territorial restructuring of the many old rain- fed fields was the work of the smiths of the old town. The wall was built in June." and text[3] is None and text[4] == "" and text[2] == body * 30
    assert scannoise.noise(df.where("false")).count() == 0


def test_difference():
    d = scannoise.difference
    assert d("temple", "ternple") == ("m", "rn", 2) and d("built", "builf") == ("t", "f", 4) and d("ಯ್", "ಯು್") == ("ಯ", "ಯು", 0) and d("abc", "xyz") is None and d("same", "same") is None
    assert d("temples", "temple") is None and d("rainfed", "rain-fed") is None and d("able", "xable") is None
    assert scannoise.wrapped(None, True) is False and scannoise.wrapped("x" * 200, True) is False


def test_confusions_are_learnt(spark):
    words = {w: 60 for w in ("temple", "simple", "number", "camel", "market", "lamps")} | {w.replace("m", "rn"): 2 for w in ("temple", "simple", "number", "camel", "market")}
    words |= {"Lamokote": 60, "Lanokote": 2, "thorn": 60, "rnaps": 1, "st0ne-cut": 1}
    fixes = {r.word: (r.correction, r.place) for r in scannoise.corrections(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert fixes == {w.replace("m", "rn"): (w, w.index("m")) for w in ("temple", "simple", "number", "camel", "market")}


def test_mending_keeps_other_words():
    edit = lambda n, kind, word=None, correction=None: {"line_no": n, "kind": kind, "word": word, "correction": correction}
    edits = [edit(1, "misread", "tne", "the"), edit(2, "hyphen_break", "cas", "castle"), edit(3, "misread", "casfle", "castle")]
    assert scannoise.mended("the tne chestne bench\nof the cas-\nfle, tne wall\n\nNext one", edits) == "the the chestne bench of the castle, tne wall\n\nNext one"
    assert scannoise.mended("a b", []) == "a b" and scannoise.mended("", []) == ""


def test_repair_undoes_planted_noise(spark):
    rng = random.Random(4)
    vocabulary = ["temple", "member", "simple", "market", "lamps", "number", "timber", "summit", "hamlet", "marble", "stands", "behind", "garden", "bridge", "church"]
    plain = [" ".join(rng.choice(vocabulary) for _ in range(60)) + "." for _ in range(30)]
    rows, truth = [(1000 + i, "d", f"d#p{i}", False, " ".join(plain) * 2) for i in range(3)], {}
    for i, text in enumerate(plain):
        words, lines = text.split(), []
        while words:
            lines.append(" ".join(words[:7]))
            words = words[7:]
        noisy = [line.replace("m", "rn", 1) if k % 4 == 1 else line for k, line in enumerate(lines)]
        rows.append((i, "s", f"s#p{i}", True, "\n".join([f"Old places    {i + 1}", *noisy])))
        truth[i] = text
    df = spark.createDataFrame(rows, "page_key bigint, source_file string, doc_id string, used_ocr boolean, text string")
    got = {r.page_key: r.text for r in scannoise.repair(df).collect()}
    assert {i: got[i] for i in truth} == truth


# 7 cut-off texts
def test_cut_off(spark):
    whole = "The wall of Moga measures 3 m and the lamps of Vale are lit in June by the smiths of Kote who came from the hills near the river in the old days of the king."
    rows = [(i, t, None, "p", "m") for i, t in enumerate(COMPLETE)]
    rows += [(500, whole, None, "p", "m"), (501, whole[:-12], None, "p", "m"), (501, whole[:-12], None, "p", "m"), (502, "The lamps of Vakote are li", "timed out", "p", "m"), (503, None, None, "p", "m"), (504, "", None, "p", "m"), (505, "The lamps of Vakote are li", None, "p", "m")]
    df = spark.createDataFrame(rows, "gen_id bigint, text string, error_message string, provider string, model string").withColumn("id", F.lit("clash"))
    out = cutoff.cut_off(df).collect()
    assert sorted(r.gen_id for r in out) == [501, 501, 505]
    share = cutoff.cut_off_share(df.where("gen_id <> 501")).first()
    assert (share.n_texts, share.n_cut) == (122, 1)
    assert cutoff.cut_off(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [2000, 2])
def test_every_near_copy_is_a_candidate(spark, monkeypatch, block):
    monkeypatch.setattr(cutoff, "BLOCK", block, raising=False)
    base = [f"w{i}" for i in range(60)]
    cut = " ".join(base[:56])
    other = " ".join(["another", *base[1:56], "x y z."])
    whole, longest = " ".join(["unlike", *base[1:]]) + " end.", " ".join(base) + " and so on it goes."
    rows = {"cut": cut, "other": other, "whole": whole, "longest": longest}
    got = {(r.id, r.partner) for r in cutoff.near_copies(spark.createDataFrame(list(rows.items()), "id string, text string")).collect()}
    wanted = {(a, b) for a in rows for b in rows if a != b and cutoff.endings.closes(rows[a]) is None and cutoff.judge_pair(rows[a], rows[b]) is not None}
    assert ("cut", "whole") in wanted and wanted <= got


def test_aligned_end_against_full_matrix():
    rng = random.Random(9)
    for _ in range(100):
        b = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        a = [x for x in b[: rng.randint(1, len(b))] if rng.random() > 0.1]
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i])
            for j, y in enumerate(b, 1):
                rows[i].append(min(rows[i - 1][j - 1] + (x != y), rows[i - 1][j] + 1, rows[i][j - 1] + 1))
        assert cutoff.aligned_end(a, b) == min((c, j) for j, c in enumerate(rows[-1]))


def test_bands_meet_near_copies():
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    assert set(cutoff.bands(cutoff.shingles(base))) & set(cutoff.bands(cutoff.shingles(near)))


# 8 packing
def test_hilbert_is_a_curve():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert(grid, 3)
    order = grid[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_packing_keeps_every_token(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["temple", "wall", "ಕೆರೆ", "old"]) for _ in range(rng.choice([0, 5, 40, 700])))) for i in range(300)] + [(300, None), (301, "x"), (301, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("hkey", F.lit("clash"))
    targets = spark.createDataFrame([(1, 128), (2, None), (3, 0)], "target_id int, capacity_tokens int")
    out = packing.pack(df, targets).collect()
    enc = packing.load_tokenizer()
    want = {i: len(enc.encode_ordinary(t or "")) for i, t in rows}
    got, load = {}, {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.n_tokens)
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert set(got) == set(want) and all(sum(got[i]) == want[i] * (2 if i == 301 else 1) for i in got) and max(load.values()) <= 128
    assert all(len(got[i]) == 1 for i in got if want[i] <= 128 and i != 301)
    assert sum(load.values()) / (128 * len(load)) > 0.95
    assert packing.pack(df.where("false"), targets).count() == 0


# 9 leaks
def test_leaks(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bdgklmnprstv") + rng.choice("aeiou") for _ in range(3))
    items = [(k, "en", "Read the passage. " + " ".join(f"The wall of {word().title()} was built by {word().title()} in {rng.randint(900, 1900)}." for _ in range(3))) for k in range(4)]
    filler = lambda: " ".join(f"The wall of {word().title()} was built by {word().title()} in {rng.randint(900, 1900)}." for _ in range(12))
    docs = [(i, filler()) for i in range(80)]
    docs += [(100, filler() + " " + items[0][2]), (101, items[1][2].upper().replace(" ", "  ") + filler()), (102, filler() + " Read the passage. " + filler()), (103, None), (104, "")]
    parts = items[2][2].split(". ")
    docs += [(105, parts[3] + ". " + filler() + " " + parts[2] + ". " + filler())]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("held", F.lit("clash"))
    e = spark.createDataFrame([*items, (9, "en", None), (10, "en", "...")], "item_id bigint, lang string, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(d, e).collect()} == {(100, 0), (101, 1), (105, 2)}
    assert {r.item_id for r in leaks.leaked_items(d, e).collect()} == {0, 1, 2}
    assert leaks.leaks(d.where("false"), e).count() == 0 and leaks.leaks(d, e.where("false")).count() == 0


# 10 reading level
def test_reading_levels(spark):
    rng = random.Random(2)
    simple = lambda: f"The wall is {rng.choice(['old', 'red', 'tall'])}."
    hard = lambda: f"Stratigraphic examination of the surviving masonry establishes institutional consolidation notwithstanding intermittent demographic displacement after {rng.randint(900, 1900)} in considerable jurisdictional territories."
    text = lambda share, n=20: " ".join(hard() if i < share * n else simple() for i in range(n))
    graded = [(level, text(s)) for level, s in ((1, 0), (2, 0.25), (3, 0.6), (4, 1)) for _ in range(5)]
    g = spark.createDataFrame(graded, "reading_level int, text string")
    docs = [(level, text(s, 40)) for level, s in ((1, 0), (2, 0.25), (3, 0.6), (4, 1))] + [(8, None), (9, "short"), (10, "1 2 3 " * 100)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("reading_level", F.lit("clash"))
    out = reading.reading_levels(d, g)
    assert {r.doc_id: r.reading_level for r in out.collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert reading.reading_levels(d.where("false"), g).count() == 0 and reading.reading_levels(d, g.where("false")).count() == 0
