import json
import random
import time

import pytest

from quotelake.functions import json_repair as r


def item(rng, k):
    return {"line_number": k, "note": rng.choice(['a{b', 'say "x"', "c\\", "[,", "plain", "é}"]), "size": rng.choice([1.5, None, {"d": [1, 2]}])}


def spans(text, items):
    """Where each item of a list stands in its text."""
    at, out = 0, []
    for x in items:
        at = text.index(json.dumps(x), at)
        out.append((at, at + len(json.dumps(x))))
        at = out[-1][1]
    return out


@pytest.mark.parametrize("seed", range(20))
def test_whole_items_before_a_cut_are_kept(seed):
    rng = random.Random(seed)
    items = [item(rng, k) for k in range(8)]
    text = json.dumps({"head": {"x": 1}, "line_items": items, "tail": 2})
    where = spans(text, items)
    for cut in range(text.index("[") + 1, len(text)):
        out, own, how = r.recovered(text[:cut])
        kept = [x for x, (_, end) in zip(items, where) if end <= cut]
        got = [json.loads(x) for x in own]
        assert got == kept, (cut, how)
        assert json.loads(out)["head"] == {"x": 1}


@pytest.mark.parametrize("seed", range(20))
def test_items_around_a_mangled_one_are_kept(seed):
    rng = random.Random(seed)
    items = [item(rng, k) for k in range(6)]
    bad = rng.randrange(6)
    text = json.dumps({"items": items})
    a, b = spans(text, items)[bad]
    text = text[:a] + text[a:b].replace('"line_number": ', '"line_number":: ') + text[b:]
    _, own, how = r.recovered(f"Here it is:\n```json\n{text}\n```")
    assert [json.loads(x) for x in own] == [x for k, x in enumerate(items) if k != bad] and how in ("items", "cut")


def test_other_faults():
    assert r.recovered('{"a": [1, 2,], }')[0] == '{"a": [1, 2]}'
    assert r.recovered("{'a': 'b'}")[0] == '{"a": "b"}'
    assert r.recovered('[1, 2] and so on')[:2] == ("[1, 2]", ["1", "2"])
    assert r.recovered('{"a": "unfinis')[0] == '{"a": "unfinis"}'
    assert r.recovered('{"a": 1, "b": tru')[0] == '{"a": 1}'
    for lost in (None, "", "no json", "}", '"x"'):
        assert r.recovered(lost) == (None, [], "lost")


def test_time_grows_with_the_text():
    took = []
    for n in (4000, 16000):
        text = json.dumps({"items": [{"k": i, "v": ["x"] * 5} for i in range(n)]})[:-20]
        began = time.perf_counter()
        assert len(r.recovered(text)[1]) >= n - 1
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5
