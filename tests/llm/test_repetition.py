import random
import re

import pyarrow as pa
import pytest

from veedor.llm import repetition
from veedor.llm.common import words


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)

    def longest(i):
        best = 0
        for j in range(n):
            k = 0
            while j != i and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        return best

    runs = [longest(i) for i in range(n)]
    cover = lambda least: len({i + k for i in range(n) if runs[i] >= least for k in range(runs[i])})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, cover(8), cover(4), max(runs, default=0)]


def brute_by_windows(text):
    """As brute, by sets of windows, for long texts: a word is covered if it is in a window that comes twice."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)

    def twice(k):
        seen = {}
        for i in range(n - k + 1):
            seen.setdefault(tuple(w[i : i + k]), []).append(i)
        return [i for places in seen.values() if len(places) > 1 for i in places]

    cover = lambda k: len({i + j for i in twice(k) for j in range(k)})
    low, high = 0, n
    while low < high:  # runs of each length below the longest come twice as well
        middle = (low + high + 1) // 2
        low, high = (middle, high) if twice(middle) else (low, middle - 1)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), cover(8), cover(4), low]


def test_both_brute_versions_agree():
    assert all(brute(t) == brute_by_windows(t) for t in some_texts())


def some_texts():
    r = random.Random(7)
    out = ["", None, " \n ", "a", "a a", "x " * 60, "é ü ñ 東京 🙂\n\né ü ñ 東京 🙂\r\né ü", "a\nb\n a\na\n\n\nb", "\na", "a\n"]
    for _ in range(60):
        w = [r.choice("abc") for _ in range(r.randint(1, 60))]
        out.append("".join(x + r.choice([" ", "\n", "  ", "\t"]) for x in w))
    phrase = "one two three four five six seven eight nine ten"
    return out + [f"{phrase} # {phrase} | {phrase}", f"start {phrase} mid {phrase} end"]


def test_measures_match_brute_force(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1), (1, None, 1)], "doc_id long, text string, n_words int")
    got = {(r.doc_id, i): list(r)[2:] for i, r in enumerate(repetition.measured(docs).orderBy("doc_id").collect())}
    want = sorted([(i, brute(t)) for i, t in enumerate(texts)] + [(1, brute(None))], key=str)
    assert sorted([(k[0], v) for k, v in got.items() if k[0] is not None], key=str) == want
    assert [v for k, v in got.items() if k[0] is None] == [brute("a b")]


@pytest.mark.parametrize("text", ["a " * 5000, "a b c " * 3000])
def test_long_repetitive_text(text):
    w = words(pa.array([text, "z", text]))
    run = repetition.repeats(w)
    n = len(text.split())
    period = len(set(text.split()))
    assert repetition.longest_of(w, run).tolist() == [n - period, 0, n - period]


def test_long_texts_take_the_lean_way_with_equal_results():
    r = random.Random(2)
    texts = [" ".join(r.choice("abc") for _ in range(400)), "", "z", "x " * 300, " ".join(f"w{r.randrange(60)}" for _ in range(900)), "a b c d e f g " * 40, "a b"]
    w = words(pa.array(texts))
    assert repetition.long_repeats(w).tolist() == repetition.repeats(w).tolist()


def test_a_very_long_text_of_one_word_in_bounded_memory():
    """3,000,000 equal words (6 MB) in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, pyarrow as pa
from veedor.llm import repetition
from veedor.llm.common import words
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
w = words(pa.array(["x " * 3_000_000]))
run = repetition.repeats(w)
assert repetition.longest_of(w, run).tolist() == [2_999_999] and repetition.covered(w, run, 8).tolist() == [3_000_000]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.strip()) < 600


def test_passing_keeps_rows_and_columns(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, clean, "x"), (2, "short", "x"), (3, "same words " * 60, None), (None, clean, "y")], "doc_id long, text string, kept string")
    got = repetition.passing(docs)
    assert got.schema == docs.schema
    assert sorted((str(r.doc_id), r.kept) for r in got.collect()) == [("1", "x"), ("None", "y")]
    flags = {(r.doc_id, r.base_failed, r.kept) for r in repetition.judged(docs).collect()}
    assert flags == {(1, False, True), (2, True, False), (3, True, False), (None, False, True)}
    assert repetition.passing(docs.limit(0)).count() == 0
