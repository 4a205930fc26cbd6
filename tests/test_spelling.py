"""Spelling operators against brute force over all pairs."""

import difflib
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from lexforge.operators import spelling as S


def damerau(a, b):
    """Edits with swaps of neighbours that may be edited further, by the whole table."""
    far, last = len(a) + len(b), {}
    d = {(i, j): far for i, j in product(range(-1, len(a) + 1), range(-1, len(b) + 1))}
    for i in range(len(a) + 1):
        d[i, 0] = i
    for j in range(len(b) + 1):
        d[0, j] = j
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            r, c = last.get(b[j - 1], 0), col
            if a[i - 1] == b[j - 1]:
                col = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1, d[r - 1, c - 1] + (i - r - 1) + 1 + (j - c - 1) if r and c else far)
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def some_words(rng, n, letters="abc", most=7):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n)]


def edited(rng, w, edits):
    for _ in range(edits):
        at = rng.randrange(len(w) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            w = w[:at] + rng.choice("xyé") + w[at:]
        elif kind == 1:
            w = w[:at] + w[at + 1 :]
        elif kind == 2:
            w = w[:at] + rng.choice("xyé") + w[at + 1 :]
        else:
            w = w[:at] + w[at + 1 : at + 2] + w[at : at + 1] + w[at + 2 :]
    return w or "q"


def test_distance_of_pairs():
    rng = random.Random(1)
    pairs = [(a, b) for a in some_words(rng, 90) for b in some_words(rng, 90)] + [("", ""), ("", "ab"), ("ca", "abc"), ("abc", "ca"), ("ab" * 3000, "ab" * 2999 + "ba")]
    long_ = ["".join(rng.choice("abcd") for _ in range(rng.randint(20, 70))) for _ in range(300)]
    pairs += [(w, edited(rng, w, rng.randrange(4))) for w in long_]
    got = S.within_two([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), d in zip(pairs, got):
        assert d == (1 if len(a) > 5000 else min(3, damerau(a, b))), (a, b)


@pytest.mark.parametrize("most_shared", [1000, 40, 0])
def test_candidates_are_complete(spark, most_shared):
    rng = random.Random(2)
    vocab = some_words(rng, 120) + ["".join(rng.choice("abcdef") for _ in range(n)) for n in range(20, 60)] + ["éa", "w" * 3000]
    tokens = some_words(rng, 80, "abcx") + [edited(rng, w, rng.randrange(4)) for w in vocab[100:160] for _ in range(4)] + ["w" * 2998, "w" * 3002 + "x", "ea"]
    frame = lambda ws: spark.createDataFrame([(w, "x") for w in [*ws, None, "", *ws[:5]]], "word string, h string")
    got = sorted(map(tuple, S.edit_candidates(frame(tokens), frame(vocab), most_shared).collect()))
    short = lambda t, v: len(t) < 100 and len(v) < 100
    want = [(t, v, d) for t in set(tokens) for v in set(vocab) if abs(len(t) - len(v)) <= 2 and short(t, v) and (d := damerau(t, v)) <= 2]
    assert got == sorted([*want, ("w" * 2998, "w" * 3000, 2)])


def test_a_run_of_words_without_candidates(spark):
    """A slice of the dictionary may hold nothing near any of a task's words."""
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    assert S.edit_candidates(frame(["qqqqqqqq", "wwwwwwww"]), frame(["the"])).collect() == []
    got = S.edit_candidates(frame(["qqqqqqqq", "teh"]), frame(["some", "the", "word"]), 1).collect()
    assert [tuple(r) for r in got] == [("teh", "the", 1)]


def test_close_matches_are_complete(spark):
    rng = random.Random(3)
    vocab, asked = sorted(set(some_words(rng, 150, "abcdeé", 9))), sorted({*some_words(rng, 60, "abcdfé", 9), "z" * 40, "ab" * 700})
    frame = lambda ws: spark.createDataFrame([(w,) for w in [*ws, None, "", ws[0]]], "word string")
    for cutoff in (0.45, 0.72):
        got = {}
        for r in S.matching_words(frame(asked), frame(vocab), 5, cutoff).collect():
            got.setdefault(r["query"], []).append((-r["similarity"], [-ord(c) for c in r["word"]], r["word"]))
        want = {q: difflib.get_close_matches(q, vocab, 5, cutoff) for q in asked}
        assert {q: {w for *_, w in v} for q, v in got.items()} == {q: set(v) for q, v in want.items() if v}
    edits = lambda a, b: F.levenshtein(F.lit(a), F.lit(b))
    pairs = spark.createDataFrame([(q, v) for q in asked for v in vocab], "query string, word string")
    share = pairs.withColumn("s", 1 - F.levenshtein("query", "word") / F.greatest(F.char_length("query"), F.char_length("word"))).where("s >= 0.45").collect()
    best = {}
    for r in share:
        best.setdefault(r["query"], []).append((-r["s"], r["word"]))
    got = {(r["query"], r["word"]) for r in S.close_words(frame(asked), frame(vocab)).collect()}
    assert got == {(q, w) for q, v in best.items() for _, w in sorted(v)[:5]}


DOCS = [
    (1, "  the Speling of  snake_case thier words.\n\nfile.txt is 12.5% wrnog!  "),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "camelCase PascalCase Apache import x 42 teh teh"),
    (6, "teh"),
    (6, "teh"),
    (7, "word " * 3000 + "wrod"),
    (8, "été ete العربيه العربية"),
]
VOCAB = [("the", 90), ("spelling", 5), ("their", 40), ("words", 30), ("word", 30), ("wrong", 8), ("is", 50), ("ten", 99), ("ete", 3), ("العربية", 4), ("of", 70)]
VOTES = [("Teh", "the"), ("teh ", "the"), ("teh", "ten"), ("thier", "there"), ("same", "same"), (None, "x")]


@pytest.mark.parametrize("most_broadcast", [100, 0])
def test_texts_are_corrected(spark, most_broadcast):
    docs = spark.createDataFrame([(i, t, "w") for i, t in DOCS], "doc_id long, text string, word string").repartition(3)
    vocab, votes = spark.createDataFrame(VOCAB, "word string, count long"), spark.createDataFrame(VOTES, "original string, corrected string")
    rows = S.corrected_texts(docs, "doc_id", "text", vocab, votes, ["Apache"], most_broadcast=most_broadcast).collect()
    got = {r["doc_id"]: (r["corrected"], [tuple(c) for c in r["changes"]], r["n_changes"]) for r in rows}
    assert len(rows) == len(DOCS) - 1 and 2 not in got
    text = "the spelling of  snake_case their words\n\nfile.txt is 12.5% wrong  "
    assert got[1] == (text, [("Speling", "spelling", 4), ("thier", "their", 28), ("words.", "words", 34), ("wrnog!", "wrong", text.index("wrong"))], 4)
    assert got[3] == got[4] == ("", [], 0)
    assert got[5][0] == "camelCase PascalCase Apache import x 42 the the" and got[5][2] == 2
    assert got[6] == ("the", [("teh", "the", 0)], 1)
    assert got[7][1] == [("wrod", "word", 15000)] and got[7][0].endswith(" word")
    assert got[8] == ("été ete العربية العربية", [("العربيه", "العربية", 8)], 1)  # two of three letters of été are neither Latin nor Arabic


def test_texts_without_words_or_dictionary(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    vocab, votes = spark.createDataFrame(VOCAB, "word string, count long"), spark.createDataFrame(VOTES, "original string, corrected string")
    assert S.corrected_texts(docs, "doc_id", "text", vocab, votes, []).count() == 0
    one = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    assert S.corrected_texts(one, "doc_id", "text", vocab.limit(0), votes.limit(0), []).first()["corrected"] == "abc def"


def test_suggestions_in_order(spark):
    vocab = spark.createDataFrame([("house", 50), ("horse", 40), ("mouse", 30), ("houses", 9), ("zebra", 2), ("hoose", 1)], "word string, count long")
    fixes = spark.createDataFrame([("huose", "house"), ("hxse", "hexes"), ("qqqqqqq", "queue")], "word string, correction string")
    votes = spark.createDataFrame([("huose", "horse"), ("huose", "horse"), ("huose", "house")], "original string, corrected string")
    words = spark.createDataFrame([("huose",), ("zbera",), ("qqqqqqz",), ("Apache",), ("xyzzyx",), (" ",), (None,), ("house",)], "word string")
    rows = S.suggestions(words, vocab, fixes, votes, ["apache"], n=5, pool=3).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["word"], []).append((r["suggestion"], r["origin"]))
    assert got["huose"][:2] == [("horse", "vote"), ("house", "fix")] and ("mouse", "close") in got["huose"] and ("hoose", "edit") in got["huose"] and len(got["huose"]) == 5 - (len(got["huose"]) < 5)
    assert got["zbera"] == [("zebra", "edit")]
    assert got["qqqqqqz"] == [("qqqqqqq", "fixed word")]
    assert "Apache" not in got and "xyzzyx" not in got and all(o != "edit" for _, o in got["house"])
    for w, v in got.items():
        assert len({s for s, _ in v}) == len(v) and w not in {s for s, _ in v}


def test_a_small_dictionary_corrects_in_place(spark, monkeypatch):
    """Nothing but the texts is read: no list of their words is written, and the rows are those of the joined way."""
    rng = random.Random(7)
    vocab = sorted({*some_words(rng, 80, "abcd", 9), "x" * 24, "x" * 25, "y" * 30})
    odd = ["snake_case", "aB", "file.txt", "été", "ABC", "Abd", "x" * 23, "x" * 26, "y" * 31, "y" * 29 + "z", "42", "a", "ab\u0085", " ", "العربيه"]
    texts = ["".join(rng.choice([" ", "\n", "\t ", " ", "\x1c"]) + rng.choice([*odd, *some_words(rng, 3, "abcdx", 9), rng.choice(vocab)]) for _ in range(40)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", " ", *texts])], "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([(w, rng.randrange(1, 4)) for w in vocab], "word string, count long")
    votes = spark.createDataFrame([("abx", "ab"), ("ABX", "ab"), ("abc", "abc!")] * 2, "original string, corrected string")
    joined = sorted(S.corrected_texts(docs, "doc_id", "text", known, votes, ["abd"], most_known=0).collect())
    monkeypatch.setattr(S, "written", None)
    assert sorted(S.corrected_texts(docs, "doc_id", "text", known, votes, ["abd"]).collect()) == joined
    assert sum(r["n_changes"] for r in joined) > 100


def test_texts_of_many_runs_meet_their_own_words(spark, monkeypatch):
    """The joined way brings each run of texts its changes, whatever way the dictionary takes; entries are compared in bounded parts."""
    rng = random.Random(11)
    vocab = sorted({*some_words(rng, 300, "abcd", 9), "x" * 24, "y" * 30})
    texts = [" ".join(rng.choice([*some_words(rng, 3, "abcdx", 9), rng.choice(vocab) + rng.choice("!,x"), "é", "y" * 31]) for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, "", " \n", "\tab  ", None])], "name string, text string").repartition(3)
    known, votes = spark.createDataFrame([(w, rng.randrange(1, 4)) for w in vocab], "word string, count long"), spark.createDataFrame([("abx", "ab")] * 2, "original string, corrected string")
    in_place = sorted(S.corrected_texts(docs, "name", "text", known, votes, []).collect())
    for most_broadcast, most_known in ((0, 0), (100_000, 0)):
        got = S.corrected_texts(docs, "name", "text", known, votes, [], most_broadcast=most_broadcast, most_known=most_known)
        assert got.columns == ["name", "corrected", "changes", "n_changes"] and sorted(got.collect()) == in_place
    assert len(in_place) == 203 and sum(r["n_changes"] for r in in_place) > 1000
    words = rng.sample(sorted({w for t in texts for w in t.split()}), 150)
    index, lengths = S._near_index(vocab), S.np.array([len(w) for w in vocab])
    whole, parts = (sorted(zip(*(x.tolist() for x in S._near_pairs(index, lengths, words, 2, n)))) for n in (10**9, 7))
    assert whole == parts and {(words[t], vocab[c], d) for t, c, d in whole} == {(a, b, d) for a in words for b in vocab if abs(len(a) - len(b)) < 3 and (d := damerau(a, b)) < 3}


def test_the_index_takes_few_bytes_a_hash(spark):
    """A dictionary of the size of larger tables is held by every task."""
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(20_000)})
    index = S._near_index(words)
    assert sum(x.nbytes for x in index if isinstance(x, S.np.ndarray)) < 6 * 46 * len(words)
