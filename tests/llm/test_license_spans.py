"""Labels, score and spans of the license scan against a plain restatement with words instead of hashes."""

import random

from kilnwork.llm import license_scan


def plain(text):
    """(labels, score, n_spans)"""
    words = text.split()
    labels, spans, score = set(), 0, 0.0
    for wordings, phrase in ((license_scan.PHRASES, True), (license_scan.TEMPLATES, False)):
        for wording, label in wordings.items():
            own = wording.split()
            size = len(own) - 2
            hits = [(at - place, at, place) for at in range(len(words) - 2) for place in range(size) if words[at : at + 3] == own[place : place + 3]]
            merged, before = [], None
            for diagonal in sorted({d for d, _, _ in hits}):
                first = min(at for d, at, _ in hits if d == diagonal)
                if phrase or before is None or diagonal - before[0] > 3 or abs(first - before[1]) > size + 3:
                    merged.append(set())
                merged[-1] |= {place for d, _, place in hits if d == diagonal}
                before = (diagonal, first)
            shares = [len(places) / size for places in merged]
            good = [s for s in shares if s >= (1 if phrase else 0.8)]
            spans += len(good)
            labels |= {label} if good else set()
            score = max([score, *(good if phrase else shares)])
    return ",".join(sorted(labels)), round(score, 9), spans


def test_labels_score_and_spans(spark):
    dice = random.Random(7)
    wordings, rows = [*license_scan.TEMPLATES, *license_scan.PHRASES], ["a word", "one two three"]
    for _ in range(120):
        words = []
        for _ in range(dice.randrange(1, 5)):
            part = [w for w in dice.choice(wordings).split() if dice.random() > 0.03]
            for _ in range(dice.randrange(3)):
                part.insert(dice.randrange(len(part) + 1), dice.choice(["the", "software", "x"]))
            begin = dice.randrange(len(part))
            words += part if dice.random() < 0.7 else part[begin : begin + dice.randrange(12)]
            words += dice.choices(["some", "other", "words", "the", "license"], k=dice.randrange(40))
        rows.append(" ".join(words))
    found = license_scan.license_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, round(r.score, 9), r.n_spans) for r in found} == {i: plain(t) for i, t in enumerate(rows)}
    assert len({r.labels for r in found}) > 20
