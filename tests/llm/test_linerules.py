import random
import re
from collections import Counter

import pyarrow as pa
from nichegrid.llm import linerules
from nichegrid.llm.linerules import Limits

NAMES = [c.split(" ")[0] for c in linerules.COLUMNS.split(", ")]


def brute(text):
    """The base columns by plain Python."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), base


def test_base_against_brute_force(spark, docs, texts):
    got = {r["doc_id"]: tuple(r[n] for n in NAMES[:6]) for r in linerules.clean(docs).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}
    rng = random.Random(1)
    few = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))).replace("c a", "c\na") for _ in range(300)]
    words, repeats = linerules.repeated_words(pa.array(few))
    assert [(a, b) for a, b in zip(words.tolist(), repeats.tolist())] == [(x[0], x[4]) for x in map(brute, few)]


def test_equal_hashes_are_told_apart(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(20)]
    real = linerules.sequences
    monkeypatch.setattr(linerules, "sequences", lambda w, n: real(w, n) % 5)
    words, repeats = linerules.repeated_words(pa.array(texts))
    assert repeats.tolist() == [brute(t)[4] for t in texts]


def test_rules():
    good = "A sentence of some length, with commas, that any reader would call prose."
    assert linerules.fault(good, 13) is None
    assert linerules.fault("Short but ended.", 3) is None and linerules.fault("He said “yes.”", 3) is None
    assert linerules.fault("Short and open", 3) == "punctuation"
    assert linerules.fault("one two three four five six seven eight nine ten eleven", 11) == "punctuation"
    assert linerules.fault("BUY!! NOW!! ALL MUST GO.", 5) == "punctuation"
    assert linerules.fault("Home | About us | Contact", 6) == "navigation" and linerules.fault("Next", 1) == "navigation"
    assert linerules.fault("He went home.", 3) is None
    assert linerules.fault("Released under the MIT License.", 5) == "boilerplate"
    assert linerules.fault(good + " It speaks of the privacy policy of a state, of what it is and of what it was before the war, when nobody had one, and of what came of it in later years, when all had.", 50) is None


def test_lines_go_before_documents(spark):
    prose = "\n".join(" ".join(f"{w}{c}" for w in ("some", "words", "of", "a", "line", "that", "ends")) + "." for c in "abcdefgh")
    rows = [(1, prose), (2, prose + "\nHome | News | Sport | More\n\nReleased under the MIT License."), (3, "Home | News | Sport | More | One\nAll | are | borders | in | this | one\nIt ends here.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, kept string")
    got = {r["doc_id"]: r for r in linerules.clean(df).collect()}
    assert got[1]["kept"] and got[1]["cleaned_text"] == prose and got[1]["removed_chars"] == 0
    assert got[2]["kept"] and got[2]["cleaned_text"] == prose + "\n" and (got[2]["n_navigation"], got[2]["n_boilerplate"]) == (1, 1)
    assert not got[3]["kept"] and not got[3]["base_failed"] and got[3]["cleaned_text"] == "It ends here."
    strict = {r["doc_id"]: r["kept"] for r in linerules.clean(df, Limits(max_loss=0)).collect()}
    assert strict == {1: True, 2: False, 3: False}


def test_edge_cases(spark, odd, empty):
    got = linerules.clean(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"]) for r in got) == [(False, 1, 7), (False, 1, 7), (False, 2, 0), (False, 3, 7), (True, 0, 7)]
    assert all(r["cleaned_text"] is None and not r["kept"] for r in got if r["doc_id"] == 2)
    assert linerules.clean(empty).collect() == []


def test_very_long_texts(spark):
    df = spark.range(2).selectExpr("id as doc_id", "if(id = 0, repeat('word ', 600000), concat(repeat('x', 2000000), repeat('\\n', 1000000))) as text")
    got = {r["doc_id"]: r for r in linerules.clean(df, with_text=False).collect()}
    assert (got[0]["n_words"], got[0]["n_repeat_words"], got[0]["base_failed"]) == (600000, 600000, True)
    assert (got[1]["n_words"], got[1]["word_chars"], got[1]["n_lines"]) == (1, 2000000, 1)
