import random
import re

from pyspark.sql import functions as F

from terrafold.llm import repetition as rp


def words(t):
    return [w for w in re.split(r"[ \t\r\n]+", t or "") if w]


def repeated(w, run=6):
    seen, hit = set(), set()
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            hit |= set(range(i, i + run))
        seen.add(g)
    return len(hit)


def texts():
    rng = random.Random(6)
    out = [None, "", " \t\r\n", "a", "a b c d e f", "a b c d e f g", "a b c d e f a b c d e f", "x " * 59, "x " * 6, "one two　three " * 30, "a\x0bb\x0cc " * 20]
    out += [" ".join(f"w{i}" for i in range(60)), "spam line here now\r\n" * 40, "\n\n a\tb \r\n" * 9, "漢字 かな " * 40, "the end. " * 20000]
    for _ in range(150):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))]
        noise = lambda: [rng.choice("abcdefghijk") for _ in range(8)]
        out.append(" ".join(w for _ in range(rng.randint(1, 15)) for w in (base if rng.random() < 0.6 else noise())))
    return out


def test_against_plain_python(spark):
    docs = texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id bigint, text string, words string")
    got = {r["doc_id"]: r for r in rp.measures(df, ["n_words", "repeated_share", "new_word_share"]).collect()}
    for i, t in enumerate(docs):
        w = words(t)
        assert got[i]["n_words"] == len(w)
        assert abs(got[i]["repeated_share"] - (repeated(w) / len(w) if w else 0)) < 1e-12, (i, t and t[:80])
        assert abs(got[i]["new_word_share"] - (len(set(w)) / len(w) if w else 0)) < 1e-12
    want = {i for i, t in enumerate(docs) if len(words(t)) >= 50 and repeated(words(t)) * 10 >= 6 * len(words(t))}
    assert len(want) > 5
    assert {r["doc_id"] for r in rp.matching(df).collect()} == want
    slow = (rp.Rule("n_words", ">=", 50), rp.Rule("repeated_share", ">=", 0.6))  # the cheap rule must not change the result
    assert {r["doc_id"] for r in rp.matching(df, slow).collect()} == want
    assert rp.matching(df.limit(0)).count() == 0


def test_other_ratios(spark):
    t = "The cat and THE dog\n- item one ...\n- item one ...\n\n• two # of …\n"
    df = spark.createDataFrame([(1, t), (2, None)], "doc_id bigint, text string")
    names = ["n_chars", "mean_word_length", "symbol_ratio", "stop_words", "stop_word_share", "n_lines", "repeated_line_share", "bullet_line_share", "ellipsis_line_share"]
    got = {r["doc_id"]: r.asDict() for r in rp.measures(df, names, stop=("and", "the", "of")).collect()}
    w, lines = words(t), ["The cat and THE dog", "- item one ...", "- item one ...", "• two # of …"]
    assert got[1] == {"doc_id": 1, "n_chars": len(t), "mean_word_length": sum(map(len, w)) / len(w), "symbol_ratio": 2 / len(w), "stop_words": 3, "stop_word_share": 4 / len(w), "n_lines": 4, "repeated_line_share": 0.25, "bullet_line_share": 0.75, "ellipsis_line_share": 0.75} and len(lines) == 4
    assert all(v == 0 for k, v in got[2].items() if k != "doc_id")


def test_stop_words_are_those_of_the_corpus(spark):
    df = spark.createDataFrame([(1, "Das das und x1 - - - -"), (2, "UND und 7 7 7"), (3, None)] + [(i, f"w{i} v{i}") for i in range(4, 40)], "doc_id bigint, text string")
    assert rp.corpus_stop_words(df, share_of=50) == ("das", "und")
    assert rp.corpus_stop_words(df.limit(0)) == ()


def test_open_rules_change_no_row(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id bigint, text string")
    least, rest = rp.REPEATED[1:2], rp.REPEATED[:1] + rp.REPEATED[4:]
    assert {r.measure for r in rest} == {"n_chars", "mean_word_length", "symbol_ratio", "stop_word_share", "repeated_line_share"}
    n = df.where(rp.compile_rules(least, F.col("text"))).count()
    assert df.where(rp.compile_rules(least + rest, F.col("text"))).count() == n


def test_no_user_functions_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = rp.matching(df, rp.QUALITY, stop=("a",))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert rp.matching(df.withColumn("text", F.lit("x"))).count() == 0
