"""Results that a cut would change: every sequence, every row, every character counts."""

import math
import random
import re
from collections import Counter

from conftest import rows_as_table

from caselake.llm import ngram_join, pii, toxicity
from caselake.session import materialize


def _plain_ratios(counts):
    """The two models of toxicity.ratios over {gram: (toxic, ordinary)} as plain dictionaries."""
    four, two = {g & 0xFFFFFFFF for g in counts}, {g & 0xFFFF for g in counts}
    kinds4, kinds2 = Counter(g & 0xFFFFFFFF for g in counts), Counter(g & 0xFFFF for g in four)

    def smoothed(kinds, key, below):
        same = [n for k, n in kinds.items() if k >> 8 == key >> 8]
        return (kinds[key] - 0.75 + 0.75 * len(same) * below) / sum(same)

    low2 = {k: smoothed(kinds2, k, 1 / 256) for k in two}
    low = {k: smoothed(kinds4, k, low2[k & 0xFFFF]) for k in four}
    seen, left = {}, {}
    contexts = {}
    for g, n in counts.items():
        contexts.setdefault(g >> 8, []).append(n)
    for c, ns in contexts.items():
        totals = [sum(n[i] for n in ns) for i in (0, 1)]
        left[c] = [0.75 * sum(n[i] > 0 for n in ns) / totals[i] if totals[i] else 1.0 for i in (0, 1)], totals
    for g, n in counts.items():
        share, totals = left[g >> 8]
        p = [max(n[i] - 0.75, 0) / max(totals[i], 1) + share[i] * low[g & 0xFFFFFFFF] for i in (0, 1)]
        seen[g] = math.log(p[0]) - math.log(p[1])
    return seen, {c: math.log(s[0]) - math.log(s[1]) for c, (s, _) in left.items()}


def test_toxicity_model_keeps_every_sequence(spark, small):
    """The table has each learnt sequence and context, and a text's evidence is that of its own words."""
    docs, rows = small
    grams = lambda w: [int.from_bytes((b"     " + w + b" ")[i:i + 6], "big") for i in range(len(w) + 1)]
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
    counts = {}
    for d, t in rows[:60]:
        for w in split(t):
            for g in grams(w):
                counts.setdefault(g, [0, 0])[d % 2] += 1
    table = spark.createDataFrame([(g, *n) for g, n in counts.items()], "gram long, toxic long, ordinary long")
    seen, left = _plain_ratios(counts)
    model = toxicity.ratios(table)
    got = {(r.kind, r.key): r.value for r in model.collect()}
    assert got.keys() == {(0, g) for g in seen} | {(1, c) for c in left}
    assert all(abs(got[0, g] - x) < 1e-9 for g, x in seen.items()) and all(abs(got[1, c] - x) < 1e-9 for c, x in left.items())
    model = materialize(model, "model")
    for most in (1 << 21, 3000, 0):
        found = {r.key: r for r in toxicity.evidence(docs.selectExpr("doc_id as key", "text"), model, most).collect()}
        assert found.keys() == {d for d, _ in rows}
        for d, t in rows:
            words = split(t)
            ratio = [sum(seen.get(g, left.get(g >> 8, 0.0)) for g in grams(w)) for w in words]
            length = sum(len(w) + 1 for w in words) or 1
            strength = sorted((x / (len(w) + 4) for w, x in zip(words, ratio)), reverse=True) or [0.0]
            onset = sorted((sum(seen.get(g, left.get(g >> 8, 0.0)) for g in grams(w)[:6]) for w in words), reverse=True) or [0.0]
            want = (sum(ratio) / length, strength[0], strength[min(2, len(strength) - 1)],
                    sum(max(x, 0) for x in ratio) / length, sum(x > 0.3 for x in strength) / len(strength),
                    onset[0], onset[min(2, len(onset) - 1)], *(math.log1p(sum(x > least for x in onset)) for least in (2, 3, 4)),
                    math.log1p(len(words)))
            assert all(abs(found[d][c] - x) < 1e-6 for c, x in zip(toxicity.EVIDENCE, want, strict=True))


def test_toxicity_models_of_all_folds_in_one_pass(spark, monkeypatch):
    """Each fold's model is that of the other folds' counts alone; the counts become models once, not once per fold."""
    draw = random.Random(5)
    rows = [(i % 2, i % 3, " ".join("".join(draw.choices("abcd", k=draw.randint(1, 7))) for _ in range(12))) for i in range(30)]
    models = toxicity.ratios(toxicity._counted(spark.createDataFrame(rows, "label int, fold int, text string")), toxicity.MODELS).cache()
    for fold, name in [(None, ""), *((f, f"_but_{f}") for f in range(3))]:
        counts = {}
        for label, of, text in rows:
            for w in text.encode().split() if of != fold else ():
                for i in range(len(w) + 1):
                    counts.setdefault(int.from_bytes((b"     " + w + b" ")[i:i + 6], "big"), [0, 0])[1 - label] += 1
        seen, left = _plain_ratios(counts)
        got = {(r.kind, r.key): (r.value, r.weight) for r in toxicity.model_of(models, name).collect()}
        assert got.keys() == {(0, g) for g in seen} | {(1, c) for c in left}
        assert all(abs(got[0, g][0] - x) < 1e-9 and got[0, g][1] == sum(counts[g]) for g, x in seen.items())
        assert all(abs(got[1, c][0] - x) < 1e-9 for c, x in left.items())
    stored = []
    monkeypatch.setattr(toxicity, "materialize", lambda df, label: stored.append(label) or materialize(df, label))
    docs = rows_as_table(spark, [(i, text) for i, (_, _, text) in enumerate(rows)], "folds", False)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 30
    assert len([x for x in stored if x.startswith("op9-model")]) == 1


def test_toxicity_learns_stems(spark):
    """Words that share a stem only: most of those in the held-out rows were never seen in training."""
    draw = random.Random(3)
    syllables = ["ka", "lo", "mi", "ru", "te", "so", "ni", "va", "du", "pe"]
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(2, 5)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(draw.randint(20, 80))]
        stems = max(3, len(words) // 15) if i % 6 == 0 else int(i % 6 == 1)
        for _ in range(stems):
            words[draw.randrange(len(words))] = "zugo" + word()
        rows.append((i, " ".join(words)))
    docs = rows_as_table(spark, rows, "stems", False)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)], "doc_id long, toxic int")
    held = [r for r in toxicity.score(docs, labels).collect() if r.held_out]
    bad = [r for r in held if r.doc_id % 6 == 0]
    assert len(bad) > 20 and sum(r.predicted for r in bad) >= 0.9 * len(bad)
    assert sum(r.predicted for r in held if r.doc_id % 6) <= 0.02 * len(held)


def test_toxicity_counts_every_training_row(spark):
    """Each training row has an expression of its own; all of them are known to the model that scores."""
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i * 7919 + 10_000)) + "qzx"
    docs = rows_as_table(spark, [(i, f"plain words of a text {name(i)}") for i in range(200)]
                         + [(1000 + i, f"plain words of a text {name(i)}") for i in range(200)], "expressions", False)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    found = {r.doc_id: r.top for r in toxicity.score(docs, labels, parts=1, held=1).collect()}
    known = [found[1000 + i] for i in range(0, 200, 4)]
    assert min(known) > max(found[1000 + i] for i in range(200) if i % 4)


def test_pii_values_of_any_length_are_whole():
    finder = pii.Finder()
    for n in (16, 200, 201, 600, 100_000):
        for kind, before, value, after in (
                ("secret", "token = ", "a1" * (n // 2) + "==", " end"), ("account", "user: ", "j4" * (n // 2), ", end"),
                ("account", "account no. = ", "jane" * (n // 4), " end"), ("handle", "by ", "@" + "h_" * (n // 2), " end")):
            text = before + value + after
            assert (kind, len(before), len(before) + len(value)) in finder.spans(text)
            assert pii.masked(text, [s for s in finder.spans(text) if s[0] == kind]) == f"{before}[{kind.upper()}]{after}"
    assert finder.spans("user: janedoe") == [("account", 6, 13)]
    assert not finder.spans("token = onlylettersinthisvalue")


def test_pruning_loses_less_than_the_bands():
    """The loss of true links at the threshold, as a binomial sum; the posterior's bound does not limit it."""
    bands = (1 - 0.8 ** ngram_join.ROWS) ** ngram_join.BANDS
    needed = ngram_join.least_matches(0.8, ngram_join.TOLERANCE)
    for n, least in needed:
        assert sum(math.comb(n, k) * 0.8 ** k * 0.2 ** (n - k) for k in range(least)) <= 1e-7
    assert ngram_join.lost(needed, 0.8) < bands / 10
    assert ngram_join.lost(needed, 0.85) < ngram_join.lost(needed, 0.82) < ngram_join.lost(needed, 0.8)
    assert 6.7e-4 < ngram_join.lost(ngram_join.least_matches(0.8, 1e-4), 0.8) < 6.9e-4
