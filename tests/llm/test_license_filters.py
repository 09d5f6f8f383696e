"""What spares op5 a comparison loses none that comes to the threshold."""

import random

import pytest

from framelake.llm import licenses


def test_a_key_inside_another_word_starts_no_run():
    text = "barcodes decode\nThe code is here.\r\nfreecopyright\n\nanother line"
    got = list(licenses.runs(text, {"code", "copy"}, 3))
    assert got == [licenses.terms(x) for x in ("barcodes decode The code is here", "The code is here", "The code is here freecopyright") if licenses.terms(x).total() <= 6]
    assert list(licenses.runs("barcodes decode\ncopyist", {"code", "copy"}, 20)) == []
    assert list(licenses.runs("any text", set(), 20)) == []


def test_ordinary_text_is_not_weighed(monkeypatch):
    texts = {name: [text] for name, text in licenses.licence_texts().items()}
    space = licenses.Space(texts, {}, licenses.THRESHOLD)
    text = licenses.terms("the cat sat on a mat " * 100)
    plain = space.best(text, dict.fromkeys(text, 1.0), alike=True)[0]
    assert 0 < plain < licenses.THRESHOLD
    monkeypatch.setattr(space, "vector", lambda *_: pytest.fail("compared"))
    assert space.best(text, dict.fromkeys(text, 1.0), alike=True, least=licenses.THRESHOLD) == (0.0, "")


@pytest.mark.parametrize("alike", [False, True])
def test_nothing_from_the_threshold_on_is_passed_over(alike):
    rng = random.Random(3)
    texts = {name: [text] for name, text in licenses.licence_texts().items()}
    for templates in (texts, licenses.TEMPLATES):
        shares = dict.fromkeys({t for notices in templates.values() for n in notices for t in licenses.terms(n)}, 0.0)
        space, above = licenses.Space(templates, shares | {"the": 0.9, "of": 0.8, "license": 0.1}, licenses.THRESHOLD), 0
        for _ in range(150):
            words = licenses.WORD.findall(rng.choice([x for t in templates.values() for x in t]).lower())
            share = rng.choice([0.3, 0.7, 0.9, 1.0])
            kept = [w for w in words if rng.random() < share] + rng.choices(["other", "zz", "the"], k=rng.randrange(1 + len(words) // 3))
            counts = licenses.Counter(kept)
            want, got = (space.best(counts, dict.fromkeys(counts, 1.0), alike, least) for least in (0.0, licenses.THRESHOLD))
            above += want[0] >= licenses.THRESHOLD
            assert got == want if want[0] >= licenses.THRESHOLD else got[0] < licenses.THRESHOLD
        assert above > 10
