import json
import random
import re

import pytest

from factloom.operators import nested

PLACES = {"occurrence": 0, "region": 1, "panel": 0, "series": 1, "point": 2}


def opened(v):
    while isinstance(v, str):
        m = re.match(r"^\s*```\w*\s*(.*?)\s*```\s*$", v, re.S)
        try:
            v = json.loads(m[1] if m else v)
        except ValueError:
            return None
    return v


def listed(v):
    v = opened(v)
    v = [v] if isinstance(v, dict) else v
    return [(i, opened(x)) for i, x in enumerate(v)] if isinstance(v, list) else []


def brute(text):
    r = opened(text)
    r = opened(r[0]) if isinstance(r, list) and len(r) == 1 else r
    if not isinstance(r, dict):
        return
    for i, o in listed(r.get("occurrences")):
        if isinstance(o, dict):
            yield "occurrence", i, -1, -1
            yield from (("region", i, j, -1) for j, g in listed(o.get("regions")) if isinstance(g, dict))
    ctx = opened(r.get("context"))
    chart = opened(ctx.get("chart")) if isinstance(ctx, dict) else None
    for i, p in listed(chart.get("panels")) if isinstance(chart, dict) else []:
        if isinstance(p, dict):
            yield "panel", i, -1, -1
            for j, z in listed(p.get("series")):
                if isinstance(z, dict):
                    yield "series", i, j, -1
                    yield from (("point", i, j, k) for k, q in listed(z.get("points")) if isinstance(q, dict))


def got(texts, with_json=False):
    row, kind, pos, raw = nested.shred([t.encode() for t in texts], with_json)
    return [(int(r), nested.KINDS[k], *map(int, p)) for r, k, p in zip(row, kind, pos, strict=True)], raw


CASES = [
    '{"occurrences":[{"a":1},null,{"regions":[{"x":"} ] \\" {"},{"y":2}]}]}',
    '{"occurrences":{"regions":{"x":1}}}',
    '{"occurrences":"[{\\"regions\\": null}, {\\"regions\\": [{}]}]"}',
    '```json\n{"occurrences":[{}]}\n```',
    json.dumps(json.dumps({"occurrences": [{}], "context": {"chart": {"panels": [{"series": {"points": [None, {"x": 1}]}}]}}})),
    '[{"occurrences":[{}]}]',
    '{"occurrences":[{"a":1},{"b"',
    '{"occurrences":[{"a":1}]',
    '{"a":"\\\\","occurrences":[{}]}',
    '{"other":{"occurrences":[{}]},"occurrences":[]}',
    '{ "occurrences" : [ { } , { } ] , "context" : { "chart" : { "panels" : [ ] } } }',
    '{"occurrences":[{}],"occurrences":[{},{}]}',
    "", " ", "null", "None", "[object Object]", "{}", "[]", '"x"', '{"occurrences":[1,"x",true]}', '{"occurrences":[{]}}', "}{", '{"occurrences":[{}]} {"occurrences":[{}]}',
]


@pytest.mark.parametrize("text", CASES[:-3] + CASES[-2:-1])
def test_single(text):
    assert sorted(x[1:] for x in got([text])[0]) == sorted(brute(text))


def test_batch_does_not_mix_texts():
    want = sorted((i, *x) for i, t in enumerate(CASES[:-3]) for x in brute(t))
    assert sorted(got(CASES[:-3])[0]) == want
    assert got([]) == ([], [])
    assert got(["", ""]) == ([], [])


def test_random_round_trip():
    rng = random.Random(3)

    def point():
        return rng.choice([None, {"x": 'a"\\b', "y": rng.random()}, {"x": "[{", "y": None}])

    def maybe(v):
        return rng.choice([v, v, v, json.dumps(v), v[0] if v else v, None])

    for _ in range(60):
        rec = {"id": "é ", "occurrences": maybe([{"regions": maybe([{"l": "x"}, None])} for _ in range(rng.randrange(3))]), "context": {"chart": {"panels": maybe([{"series": maybe([{"points": [point() for _ in range(rng.randrange(4))]}])}])}}}
        text = json.dumps(rec, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert sorted(x[1:] for x in got([text])[0]) == sorted(brute(text)), text


def test_very_long_and_deep():
    text = '{"occurrences":[' + ",".join(["{}"] * 20_000) + '],"deep":' + "[" * 500 + "]" * 500 + "}"
    assert len(got([text])[0]) == 20_000


def test_child_json():
    rows, raw = got(['{"occurrences":[ {"page_number": 3 } , {"bbox":[1,2]}]}'], True)
    assert sorted(raw) == [b'{"bbox":[1,2]}', b'{"page_number": 3 }'] and len(rows) == 2


def test_tables(spark):
    facts = spark.createDataFrame([("f1", CASES[0], 2, 1), ("f1", CASES[0], 1, 1), ("f2", None, 3, 1), (None, CASES[0], 4, 1), ("f3", CASES[2], 5, 9)], "fact_id string, data_json string, ingest_seq bigint, children int")
    chunks = spark.createDataFrame([("c1", [["a", None, ""], None, []]), ("c1", [["a", None, ""], None, []]), ("c2", None), ("c3", []), (None, [["x"]])], "chunk_id string, table_data array<array<string>>")
    rows = [tuple(r) for r in nested.flat_children(facts, chunks).collect()]
    want = [("f1", *x) for x in brute(CASES[0])] + [("f3", *x) for x in brute(CASES[2])] + [("c1", "cell", 0, 0, -1), ("c1", "cell", 0, 2, -1)]
    assert sorted(rows) == sorted(want)
    assert nested.flat_children(facts.limit(0), chunks.limit(0)).count() == 0
    box = spark.createDataFrame([("g", '{"occurrences":[{"page_number":"7","bbox":{"x0":0.1,"y0":0.2,"x1":0.3,"y1":0.4}},{"page_number":8,"bbox":[0.5,0.6,0.7,0.8]}]}', 1)], "fact_id string, data_json string, ingest_seq bigint")
    assert sorted((r.page_number, r.x0, r.y1) for r in nested.child_values(box).collect()) == [(7, 0.1, 0.4), (8, 0.5, 0.8)]
