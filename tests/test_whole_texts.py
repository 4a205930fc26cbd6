"""Queries work on whole texts, not on prefixes or on some of the rows."""

import json
from collections import Counter, defaultdict

from lexforge.operators.learn import vote_weight
from lexforge.plans.registry import QUERIES

from pyspark.sql import functions as F


def test_fusions_of_whole_readings(spark, tmp_path):
    texts = [(1, 0, "user", "a" * 70 + " First TAIL"), (1, 1, "assistant", "b" * 65 + " second tail longer"), (2, 0, "user", "short"), (2, 1, "assistant", "x" * 61)]
    spark.createDataFrame(texts, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    confidence = {(c, t): (c * 7 + t * 13) % 50 / 100 + 0.5 for c, t, _, _ in texts}
    of = defaultdict(list)
    for c, t, _, text in texts:
        of[c].append((confidence[c, t], t, text))
    got = {r.conv_id: r.text for r in QUERIES["fusion_best"](spark, str(tmp_path)).collect()}
    assert got == {c: max(rows)[2] for c, rows in of.items()}

    heights = {c: defaultdict(list) for c in of}
    for c, t, _, text in texts:
        for w in text.lower().split():
            heights[c][w].append(t)
    fused = {c: " ".join(sorted(h, key=lambda w: (sum(h[w]) / len(h[w]), len(w), w))) for c, h in heights.items()}
    assert {r.conv_id: r.fused for r in QUERIES["word_vote"](spark, str(tmp_path)).collect()} == fused

    weights = {k: spark.range(1).select(vote_weight(F.lit(v))).first()[0] for k, v in confidence.items()}
    for r in QUERIES["char_vote"](spark, str(tmp_path)).collect():
        size, out = max(len(text) for _, _, text in of[r.conv_id]), ""
        for i in range(size):
            votes = Counter()
            for _, t, text in of[r.conv_id]:
                votes[text.ljust(size, "\0")[i]] += weights[r.conv_id, t]
            out += min(votes, key=lambda ch: (-votes[ch], ch))
        assert r.fused == out.replace("\0", "")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_of_whole_texts(spark, tmp_path):
    texts = ["x" * 210 + " the other path", "\u00e9th\u00e9 na\u00efve", "\u65e5\u672c\u8a9e", "plain", "th" * 150, ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    n = [edits(t, t.replace("th", "t")) for t in texts]
    got = {r.item_id: r for r in QUERIES["cer_grade"](spark, str(tmp_path)).collect()}
    assert {i: r.cer for i, r in got.items()} == {i: round(k / len(t), 6) if t else 0 for i, (k, t) in enumerate(zip(n, texts, strict=True))}
    assert [got[i].grade for i in range(6)] == ["A+", "C", "A+", "A+", "F", "A+"]
    r = QUERIES["corpus_error_rate"](spark, str(tmp_path)).first()
    rates = [k / len(t) for k, t in zip(n, texts, strict=True) if t]
    assert (r.micro, r.macro, r.exact, r.n) == (round(sum(n) / sum(map(len, texts)), 6), round(sum(rates) / 5, 6), 0.4, 5)


def test_bundles_of_all_documents(spark, tmp_path):
    texts = ["y" * 90 + " end", "see https://example.org/a/b and /etc/hosts", 'quote " back \\ tab \t line \n bell \x07', "\u00e9 \u65e5 \U0001f600", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: json.loads(r.bundle) for r in QUERIES["fhir_bundle"](spark, str(tmp_path)).collect()}
    section = lambda t: {} if t is None else {"text": t}
    assert got == {
        i: {"resourceType": "Bundle", "type": "document", "entry": [{"resource": {"resourceType": "Composition", "title": f"document {i}", "section": [section(t)]}}]}
        for i, t in enumerate(texts)
    }
