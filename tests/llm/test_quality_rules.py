import re
from collections import Counter

from wakeline.llm import quality_rules as Q

from .cases import empty, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    covered = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    texts = [r[1] for r in rows()] + ["a b c d e a b c d e a b c d e f", "x " * 40, "a # $ %% <b>|&", "p q\n\np q\n \np q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in Q.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), t
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_edges(spark):
    out = Q.quality_rules(frame(spark))
    assert out.count() == len(rows())
    assert Q.quality_rules(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = Q.quality_rules(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange hash" not in plan


def test_ablation_counts_rules_alone(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "# " * 30), (3, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    row = Q.ablation(Q.ledger(df), Q.PRODUCTION).first()
    assert row["n_docs"] == 3 and row["removed"] == 2
    assert row["few_words_alone"] == 1 and row["symbols_alone"] == 0 and row["symbols_fails"] == 1
