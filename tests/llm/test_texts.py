"""Problems 3, 4 and 9: repetition, sentences and quality on fixtures."""

import random

import numpy as np
from pyspark.sql import functions as F

from dialoom.llm import quality, repetition, sentences

from .helpers import CONV, words

# Texts of any shape must not crash or take long.
ODD = [
    None, "", " \n", "a-" * 30000, "x, " * 30000, "a,b;c=d " * 10000, "1 | 2 > " * 10000, "word " * 30000, "🙃 " * 20000, '"' * 20001,
    "(" * 10000 + ")" * 10000, "ab1+/" * 10000, "..." * 20000, "е. " * 20000, "你好，" * 20000, "Hello there. " * 5000, "\n" * 30000, "a=1 b=2\n" * 10000,
]
SENTENCES = [
    ("Hmm... could the farm at 7 a.m. be the reason? Which one?", ["Hmm... could the farm at 7 a.m. be the reason?", "Which one?"]),
    ("Mr. X paid $1,170.50. J. K. Fajo owns it, etc. and more.", ["Mr. X paid $1,170.50.", "J. K. Fajo owns it, etc. and more."]),
    ("Great! 🙃\nYes or no?", ["Great! 🙃", "Yes or no?"]),
    ('"Is it salt? Is it glue?" is all she asks. No.', ['"Is it salt? Is it glue?" is all she asks.', "No."]),
    ("1. How? 2. What next? (b) Does it? * Have you?", ["1. How?", "2. What next?", "(b) Does it?", "* Have you?"]),
    ("ok... can you say it or not", ["ok... can you say it or not"]),
    ("She nodded (why? no idea) and left. See p. 67, fig. 2 now!", ["She nodded (why? no idea) and left.", "See p. 67, fig. 2 now!"]),
    ("See https://a.example/help?item=9 for it. Really?!", ["See https://a.example/help?item=9 for it.", "Really?!"]),
    ("邻居说“先停下。再试。”然后走了。我没找到……为什么？", ["邻居说“先停下。再试。”然后走了。", "我没找到……", "为什么？"]),
    ("Am 3. Mai hat er z. B. u. a. den Teppich. Und?", ["Am 3. Mai hat er z. B. u. a. den Teppich.", "Und?"]),
    ("Il a crié « Arrête. Ça suffit. » puis il part. M. Vo habite au no. 5.", ["Il a crié « Arrête. Ça suffit. » puis il part.", "M. Vo habite au no. 5."]),
    ("ช่วยบอก เพื่อนบ้าน โคมไฟ2.5กก", ["ช่วยบอก", "เพื่อนบ้าน", "โคมไฟ2.5กก"]),
    ("so far?When is it. Then", ["so far?", "When is it.", "Then"]), ("parts, etc. It costs 6.5.", ["parts, etc.", "It costs 6.5."]),
    ("В 1987 г. он стоял на ул. Ленина. Ну... может, да?", ["В 1987 г. он стоял на ул. Ленина.", "Ну... может, да?"]),
    ("قال د. Ra إن الخل يكفي. كفى!", ["قال د. Ra إن الخل يكفي.", "كفى!"]), ('डॉ. Ra ने कहा। बहन बोली "बस करो। जाओ।" और गई।', ["डॉ. Ra ने कहा।", 'बहन बोली "बस करो। जाओ।" और गई।']),
    ("  - How? - What?", ["- How?", "- What?"]), ("...", ["..."]), ("app­rox. 10 m. Then", ["app­rox. 10 m.", "Then"]), (None, []), (" \n ", []),
    ("no mark at all", ["no mark at all"]), ("Is the grade A. Correct?", ["Is the grade A.", "Correct?"]), ("A B", ["A", "B"]),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, t, i) for i, (t, _) in enumerate(SENTENCES)], "i int, text string, sentences int")
    got: dict = {}
    for r in sentences.sentences(df.select("i", "text")).orderBy("i", "sent_no").collect():
        got.setdefault(r.i, []).append(r.sentence)
        assert SENTENCES[r.i][0][r.sent_start :].startswith(r.sentence)
    assert [got.get(i, []) for i in range(len(SENTENCES))] == [s for _, s in SENTENCES]


def test_many_sentences_keep_offsets(spark):
    t = "".join(f"Sentence {i} here? \n" for i in range(1000))
    got = sentences.sentences(spark.createDataFrame([(1, t)], "i int, text string")).orderBy("sent_no").collect()
    assert len(got) == 1000 and all(t[r.sent_start :].startswith(f"Sentence {r.sent_no} here?") for r in got)


def test_repeated_share():
    share = lambda t: repetition.repeated_share(t.split())
    assert share("a b c d e") == 0 and share("") == 0 and share("a") == 0
    assert share("no no no no") == 0.75 and share("yes or no yes or no") == 0.5
    assert share("what is it then what is it now") == 3 / 8
    assert share("so far so far so far so far") == 0.75
    assert repetition.repeated_share(list("なぜ塩をなぜ塩をなぜ塩を")) > 0.6 and repetition.repeated_share(list("これは塩ですか")) == 0


def test_trees_are_monotone_and_fit():
    r = np.random.RandomState(0)
    x = r.rand(2000, 7)
    y = (1 - x[:, 2]) * 0.8 + 0.1 * r.rand(2000)
    t = repetition.Trees().fit(x, y, repetition.MONOTONE)
    assert np.sqrt(np.mean((t.predict(x) - y) ** 2)) < 0.06
    for f, way in enumerate(repetition.MONOTONE):
        a, b = x.copy(), x.copy()
        b[:, f] = np.minimum(1, b[:, f] + 0.3)
        if way:
            assert ((t.predict(b) - t.predict(a)) * way >= -1e-9).all()
    assert (repetition.Trees().fit(x[:0], y[:0], repetition.MONOTONE).predict(x[:3]) == 0).all()


def test_repetition_found(spark, folder):
    r = random.Random(2)
    say = lambda n: " ".join(r.choice("one two three four five six seven eight nine ten red blue green cat dog sun moon tree".split()) for _ in range(n))
    clean = [say(r.randint(4, 12)) + "?" for _ in range(60)]
    loops = [" ".join([say(6)] * k) for k in (3, 4, 9)] + ["Stop! " * 20, " ".join(f"Attempt {i}: is it the cat?" for i in range(1, 7)), "塩を使えばいいのですか。" * 4]
    texts = clean + loops + [None, "", " "]
    rows = [(f"train_math_{i:05d}", None, None, None, None, [("user", t)], 1) for i, t in enumerate(texts)]
    d = folder(convs=spark.createDataFrame(rows + rows[-4:] + [("train_math_99999", None, None, None, None, None, 1)], CONV))
    got = sorted(x.id for x in repetition.p3_found(spark, d).collect())
    assert got == [f"train_math_{i:05d}" for i in range(len(clean), len(clean) + len(loops))]
    assert repetition.p3_shares(spark, d).collect()[0].n_found == len(loops)
    e = folder(convs=spark.createDataFrame([], CONV))
    assert repetition.p3_found(spark, e).count() == 0 and sentences.p4_found(spark, e).count() == 0


def made_texts(r, n):
    """Texts whose share of repetition is anything: sentences, passages, words or numbered items said again, apart or in turn."""
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(2 + j % 7)) for j in range(3000)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k)) + r.choice(".?!")
    for i in range(n):
        own, k = [say(r.randint(3, 14)) for _ in range(r.randint(1, 12))], r.randint(1, 12)
        again = [
            [r.choice(own) for _ in range(k)], own * r.randint(1, 3), [" ".join([r.choice(vocabulary)] * k * 2)], [f"{j}. {own[0]}" for j in range(k)],
            [" ".join(own[0].split()[: r.randint(2, 6)]) for _ in range(k)],
        ][i % 5]
        turn = [x for p in zip(own, again) for x in p] + own[len(again) :] + again[len(own) :]
        yield r.choice([" ", "\n", "\n\n"]).join(r.choice([own + again, turn]))


def test_scores_against_exact_shares(spark, sf):
    """Held-out texts of other shapes than those trained on: the score is close, and the outcome right in nearly every case."""
    model = repetition.train(sentences.message_texts(spark, sf))
    texts = list(made_texts(random.Random(1), 1500))
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {x.n: x for x in repetition.repetition(df, ["n"], model).collect()}
    exact = {i: repetition.repeated_share([w for w in words(t) if not w.isdigit()]) for i, t in enumerate(texts)}
    assert sum(abs(got[i].score - exact[i]) for i in got) / len(got) < 0.04
    assert sum(got[i].found != (exact[i] > 0.5) for i in got) <= 0.01 * len(got) and sum(x > 0.5 for x in exact.values()) > 300
    assert all(got[i].found == (exact[i] > 0.5) for i in got if abs(exact[i] - 0.5) > 0.1)


PROSE = "The cat sat on the mat and it was happy with that. Then we went to the shop for milk. "
NOT_PROSE = [
    "- a cat\n- the dog\n- red mat\n" * 5, "| a | b |\n|---|---|\n| the | 2 |\n" * 4, "1001,the cat,0.5,T\n1002,a dog,0.7,F\n" * 4, "1001\ta\t5\n" * 6,
    "1705923314 WARN gate[73]: id=train_1 attempts=3 rc=2\n" * 4, "def f(x, k=5):\n    if x != 3: return x\n    y = [z for z in x]\n" * 3,
    '{"t":1,"w":"the cat","ok":false},{"t":2,"w":"a dog","ok":true}', "cat mat, dog box, red cup, tin can, cork lid, zinc pan " * 3, "&|^%=*/^:<</ -;-?$/.+>??% " * 5,
    "½Ât¿¿Â i§s±rr» â½otn™ tai½t§»a½oo ii½ï Ã»oeesn™s§Ã " * 3, "mGeHmUDLNrjSSE7ZWd8t2lcrecKRWjWG4Tdr51ys0OzOvxAxpUc38lzTWucq\n" * 3,
    "Peda rarosa ribolo bapikale dinekeli zo jezatoje rogete seda ho! Zetika fira bijosa mosora hero kiba. " * 2, "Q1   cat   [   ]\nA2) mat   ....... 31\nred box: 21\n" * 4,
    "Cat » Dog | Red mat > Box » Pan | Tin\n" * 3, "雨伞, 白醋, 镜子 抽屉, 毛衣, 花盆, 钥匙, 粉笔, " * 3,
]
IS_PROSE = [
    PROSE, PROSE.replace(" ", "  "), "the cat sat on\nthe mat and it\nwas happy with\nthat and so on\nfor the rest of\nthe day in the\nhouse\n", "Student: What is it to you?\nTutor: It is a cat on the mat.\n" * 3,
    "ok so the cat is on the mat again and i dont want it to be... can you say it or not", "昨日石けんで扇風機を洗ったけどだめだった。もう時間がない！", "ฉันลองใช้สบู่แล้วแต่ไม่ได้ผล ทำไมคุณถามกลับตลอดเวลา",
    PROSE + "\n\n- salt\n- chalk", None, "", "  \n",
]


def test_quality(spark):
    common = spark.createDataFrame([("en", w) for w in "the and to of a in is it was for on with that so i you".split()] + [(None, None)], "lang string, word string")
    texts = NOT_PROSE + IS_PROSE
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string")
    got = {r.doc_id: r for r in quality.statistics(df, common).collect()}
    assert len(got) == len(texts)
    assert [texts[i] for i in sorted(got) if got[i].not_prose] == NOT_PROSE
    p = got[len(NOT_PROSE)]
    assert p.n_words == 21 and p.n_lines == 1 and p.ended_line_ratio == 1 and abs(p.common_word_ratio - 11 / 21) < 1e-9 or p.n_words == len(PROSE.split())
    none = got[len(texts) - 1]
    assert (none.n_words, none.n_shown, none.prose_ratio, none.not_prose) == (0, 0, None, False)


def test_chunks_change_nothing(spark, monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice(["word", " ", " ", "\n", "\n\n", "a.", "x"]) for _ in range(n)) for n in (1, 40, 41, 200, 900)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t], "doc_id bigint, text string")
    common = spark.createDataFrame([("en", "word")], "lang string, word string")
    whole = sorted(map(str, quality.statistics(df, common).select("doc_id", "n_words", "n_shown", "mean_word_length").collect()))
    monkeypatch.setattr(quality, "CHUNK", 40)
    monkeypatch.setattr(quality, "REACH", 10)
    assert sorted(map(str, quality.statistics(df, common).select("doc_id", "n_words", "n_shown", "mean_word_length").collect())) == whole
    pieces: dict = {}
    for c in quality.chunks(df).orderBy("doc_id", "chunk").collect():
        pieces[c.doc_id] = pieces.get(c.doc_id, "") + c.piece
    assert [pieces[i] for i in sorted(pieces)] == [t for t in texts if t]


def test_chunks_change_no_column(spark, monkeypatch):
    """Single lines of 29,840 characters, lines about as long as a segment, and paragraphs cut anywhere."""
    r = random.Random(4)
    some = lambda bits, n: "".join(r.choice(bits) for _ in range(n))
    texts = [some(["word ", "the ", "cat sat. ", "x, ", "| ", "a=1 b=2 ", "Why? ", "的了", "don't ", "n-n", "%", "\t"], 9000)[:29840], "a" * 29840, "a-" * 14920]
    texts += [" " * 5000 + "the end. " * 2000, ("the cat sat on it. " * 2000)[:29840] + "\n\n- a\n- b\n\nx"]
    texts += [some(["word", " ", " ", "\n", "\n\n", "a.", "x", "- item\n", "the ", "| a | b |\n", "  \n", "。", "猫的", "\r\n"], n) for n in (1, 40, 41, 200, 900, 5000)]
    texts += ["x" * k + "\n" + "y" * k + " z." for k in (2047, 2048, 2049, 2050, 4096, 4097, 4098)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    common = spark.createDataFrame([("en", "the"), ("en", "on"), ("de", "word")], "lang string, word string")
    seen = []
    for size in (40, 8192, 10**6):
        monkeypatch.setattr(quality, "CHUNK", size)
        seen.append({x.doc_id: tuple(x) for x in quality.statistics(df, common).collect()})
        assert quality.chunks(df).count() > len(texts) if size < 10**6 else quality.chunks(df).count() == len(texts)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(texts)
    by_hand = seen[0][4]
    assert by_hand[3] == 4 and any(x[-1] for x in seen[0].values()) and not by_hand[-1]


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string").repartition(4)
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    assert quality.statistics(df, common).count() == len(ODD)
    assert sentences.sentences(df).filter(F.col("sent_start") < 0).count() == 0
    assert repetition.repetition(df, ["doc_id"]).count() <= len(ODD)
