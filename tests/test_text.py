import re

import pytest

from tessella.functions import text as tx


def test_types_tell_a_leaf(spark):
    rows = [(1, '{"a": "{not json", "b": "[draft] note", "c": "[1, 2]"}'), (2, '[1, {"x/y~": [true, null, 2.5, []]}, {}]'), (3, "plain {"), (4, None), (5, '"txt"'), (6, "{}"), (7, "null")]
    got = sorted(tuple(r) for r in tx.json_leaves(spark.createDataFrame(rows, "key long, pointer string"), "pointer").collect())
    want = [(1, "/a", "{not json"), (1, "/b", "[draft] note"), (1, "/c", "[1, 2]"), (2, "/0", "1"), (2, "/1/x~1y~0/0", "true"), (2, "/1/x~1y~0/2", "2.5"), (3, "", "plain {"), (5, "", "txt")]
    assert got == want
    assert tx.json_leaves(spark.createDataFrame([], "key long, j string"), "j").count() == 0


def test_every_match_holds_a_fixed_word():
    forms = {
        "ood_penalty": ["OOD penalties"], "checkpoint_pinned": ["pinned", "does not move"], "inert": ["inertness"], "oxide_pretrained": ["oxide pre-trained", "pretraining exclusively on the oxide"],
        "causal_language": ["explains", "causality", "driven", "mechanistic"], "generalization_language": ["generalise", "generalizable"], "no_parameter_updates": ["no parameter update"],
    }
    for name, pattern in tx.TERMS:
        words = tx.fixed_words(pattern)
        assert words
        for form in forms.get(name, []):
            assert not re.fullmatch(pattern, form, re.I) or any(w in form.lower() for w in words)
    assert tx.fixed_words("[0-9]+") == [] and tx.fixed_words("a|word") == [] and tx.fixed_words("(?:one|two(?:s)?)") == ["one", "two"]
    assert tx.fixed_words("licensed? under|x{2,3}yellow") == ["license", "yellow"] and tx.fixed_words("(?:abc)?") == []


@pytest.mark.parametrize("line", ["OOD-penalty ood", "INERT ſource domain", "domain shifts, domain shift", "does not  move", "nothing here", "", "pre‑trained primarily on the oxides"])
def test_the_screen_changes_nothing(spark, line):
    rows = spark.createDataFrame([(1, f"x\n{line}")], "i long, t string")
    got = [(r.term, r.found) for r in tx.term_matches(rows, "t").collect()]
    want = []
    for name, pattern in tx.TERMS:
        want += [(m.start(), -m.end(), name, m[0]) for m in re.finditer(rf"(?<!\w)(?:{pattern})(?!\w)", line, re.I)]
    kept, upto = [], 0
    for start, end, name, found in sorted(want, key=lambda w: w[:2]):
        if start >= upto:
            kept.append((name, found))
            upto = -end
    assert got == kept
