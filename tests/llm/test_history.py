import math
import random
import zlib

import pytest

from factloom.llm import history

ENTITIES = [(0, "Beryan Motors Limited"), (1, "Zoldreavia Ports Authority"), (2, "Fenkad Retail Limited")]
ATTRIBUTES = [(0, "Total Income"), (1, "Gross Margin"), (2, "Profit After Tax")]
CATALOG = [("rupee", "money", "INR", 1.0), ("percent", "ratio", "bps", 100.0), ("basis_point", "ratio", "bps", 1.0), ("million", "scale", None, 1e6), ("crore", "scale", None, 1e7)]
SCHEMA = "fact_id string, document_id string, statement string, canonical_entity string, raw_attribute string, value string, unit string, content_hash string, data_json string, batch_no int, ingest_seq bigint, report string, combo int"


def lists(spark):
    return spark.createDataFrame(ENTITIES, "seq bigint, name string"), spark.createDataFrame(ATTRIBUTES, "seq bigint, name string"), spark.createDataFrame(CATALOG, "unit_name string, dimension string, common_unit string, factor double")


def fact(i, doc="r1", entity="Beryan Motors Limited", attribute="Total Income", value="5 crore", unit="INR", period="FY24", digest=None, batch=None, statement=None):
    return (f"f{i:03}", doc, statement or f"In {period} it was {value}, Zone 7.", entity, attribute, value, unit, digest, None if period is None else '{"temporal_scope":{"period":"%s"}}' % period, i // 5 if batch is None else batch, i, "x", 1)


ROWS = [
    fact(0, digest="AB"), fact(1, doc="R1.pdf", value="50 million", unit="₹"), fact(2, doc="r1 (2)", entity="BERYAN MOTORS LTD", attribute="total_total_income"), fact(3, value="5.1 crore"), fact(4, period="FY25"), fact(5, doc="r2"), fact(6, entity="Beryan Jewellers Limited"),
    fact(7, attribute="Gross Margin", value="44", unit="%", digest="cd"), fact(8, attribute="Gross Margin", value="4400 bps", unit=None), fact(9, value="Stable", unit=None, digest=" CD "), fact(10, doc=None), fact(11, doc=None), fact(12, doc=" "), fact(13, value="stable", unit=None), fact(14, statement="In FY24 it was 5, Plant 9."),
    fact(15, value=None, unit=None, entity=None, attribute=None, period=None, statement="x"), fact(16, value="x" * 20_000), fact(17, digest="ab", value="9 crore"),
]
# 9 repeats 7 by its hash; 13 states what 9 stated, but 9 is no accepted fact; 17 repeats 0 by its hash.
WANT = {("f001", "f000"), ("f002", "f000"), ("f008", "f007"), ("f009", "f007"), ("f017", "f000")}


def test_names_of_a_long_list(spark):
    """A misspelt name counts as its entry wherever that stands in the list."""
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choices("abcdefghijklmnoprstuvwyz", k=4)) for _ in range(10))) for i in range(600)]
    at = max(range(600), key=lambda i: zlib.crc32(str(i).encode()))
    rows[at] = (at, "Beryan")
    _, attributes, catalog = lists(spark)
    facts = [fact(0, entity="Beryan"), fact(1, entity="Beyran"), fact(2, entity=rows[5][1]), fact(3, entity="Xyxyxyx")]
    normal = history.normalise(spark.createDataFrame(facts, SCHEMA), spark.createDataFrame(rows, "seq bigint, name string"), attributes, catalog)
    assert {x.fact_id: x.entity_key for x in normal.collect()} == {"f000": f"#{at}", "f001": f"#{at}", "f002": "#5", "f003": "xyxyxyx"}


@pytest.mark.parametrize("steps", [1, 3])
def test_repeats(spark, steps):
    rows = [*ROWS, (*ROWS[3][:9], 3, 900, "x", 1), (*ROWS[1][:9], 3, 901, "x", 1)]
    pairs, state = history.link_all(spark.createDataFrame(rows, SCHEMA), *lists(spark), steps=steps)
    assert {(r.fact_id, r.accepted_id) for r in pairs.collect()} == WANT
    held = {r.fact_id: r.representative for r in history.clusters(state).collect()}
    assert len(held) == len(ROWS) and held["f002"] == "f000" and held["f009"] == held["f008"] == "f007" and held["f013"] == "f013"


def test_stopped_and_opened_again(spark, tmp_path, monkeypatch):
    """A history is opened by its path, a batch that fails is given again, and the merges of a later batch reach the clusters of an earlier one."""
    rows = [fact(0, digest="h1", batch=0), fact(1, value="7 crore", digest="h2", batch=0), fact(2, value="8 crore", digest="h3", batch=0), fact(3, value="7 crore", digest="h1", batch=1), fact(4, value="8 crore", digest="h2", batch=2)]
    path = str(tmp_path / "history")
    normal = history.normalise(spark.createDataFrame(rows, SCHEMA), *lists(spark))
    normal.write.parquet(str(tmp_path / "normal"))
    normal = spark.read.parquet(str(tmp_path / "normal"))
    part = lambda k: normal.filter(normal.seq.isin(*[r[10] for r in rows if r[9] == k]))
    first = history.History(spark, path, buckets=4)
    assert history.link_batch(first, part(0)).count() == 0
    again = history.History(spark, path)
    assert (again.batches, again.buckets) == (1, 4)
    with monkeypatch.context() as m:
        m.setattr(history.History, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            history.link_batch(history.History(spark, path), part(1))
    got = history.link_batch(history.History(spark, path), part(1))
    assert {(r.fact_id, r.accepted_id) for r in got.collect()} == {("f003", "f000"), ("f003", "f001")}
    last = history.History(spark, path)
    assert {(r.fact_id, r.accepted_id) for r in history.link_batch(last, part(2)).collect()} == {("f004", "f001"), ("f004", "f002")}
    assert {r.fact_id: r.representative for r in history.clusters(history.History(spark, path)).collect()} == dict.fromkeys(["f000", "f001", "f002", "f003", "f004"], "f000")
    assert history.link_batch(last, part(0)).count() == 0  # deliveries of what is there


def test_two_accepted_facts_join(spark):
    rows = [fact(0, digest="h1"), fact(1, value="7 crore", digest="h2"), fact(2, value="7 crore", digest="h1")]
    pairs, state = history.link_all(spark.createDataFrame(rows, SCHEMA), *lists(spark), steps=1)
    assert {(r.fact_id, r.accepted_id) for r in pairs.collect()} == {("f002", "f000"), ("f002", "f001")}
    assert {r.representative for r in history.clusters(state).collect()} == {"f000"}


def test_empty(spark):
    assert history.repeats(spark.createDataFrame([], SCHEMA), *lists(spark)).count() == 0


def test_against_sequential_pass(spark):
    rng = random.Random(5)
    rows = [fact(i, doc=rng.choice(["r1", "r2"]), value=f"{rng.randrange(4)} crore", attribute=rng.choice(["Total Income", "TOTAL INCOME", "Profit After Tax"]), digest=rng.choice([None, "a", "b", "C"]), batch=i // 9) for i in range(45)]
    accepted, want = {}, set()
    for fid, doc, _, _, attribute, value, _, digest, *_ in rows:
        keys = [(doc, attribute.lower(), value)] + ([(doc, digest.lower())] if digest else [])
        hit = {accepted[k] for k in keys if k in accepted}
        want |= {(fid, h) for h in hit}
        if not hit:
            accepted |= dict.fromkeys(keys, fid)
    pairs, _ = history.link_all(spark.createDataFrame(rows, SCHEMA), *lists(spark), steps=2)
    assert {(r.fact_id, r.accepted_id) for r in pairs.collect()} == want


def test_scores():
    w = {f: {"same": 3.0, "close": 2.0, "other": -3.0} for f in ("entity", "attribute")}
    assert history.score_pair(w, ("wexoston media", "wexoston mdia"), ("paint sold", "paint sold")) >= history.MATCH_PROBABILITY
    assert history.score_pair(w, ("wexoston media", "wexoston foods"), ("paint sold", "paint sold")) == 0.0


@pytest.mark.parametrize("steps", [1, 3])
def test_names_of_one_key_are_the_same(spark, steps, monkeypatch):
    """The entity is on no list on both sides, the attribute is one entry typed far apart; and the other way round."""
    w = {f: {"same": 3.0, "close": 2.0, "other": -3.0} for f in ("entity", "attribute")}
    monkeypatch.setattr(history, "learn_weights", lambda normal: w)
    rows = [
        fact(0, entity="Wexoston Media Corporation", attribute="Profit After Tax"), fact(1, entity="Wexoston Mdia Corporation", attribute="PAT"), fact(2, entity="Wexoston Foods Corporation", attribute="PAT"),
        fact(6, doc="r2", entity="Zoldreavia Ports Authority", attribute="Paint sold in tins"), fact(7, doc="r2", entity="ZPA", attribute="Paint sld in tins"), fact(11, doc="r2", entity="ZPA", attribute="Paint bought in tins"),
    ]
    pairs, _ = history.link_all(spark.createDataFrame(rows, SCHEMA), *lists(spark), steps=steps)
    assert {(r.fact_id, r.accepted_id) for r in pairs.collect()} == {("f001", "f000"), ("f007", "f006")}


def test_unlisted_name_against_the_name_on_the_list():
    assert history.field_agreement(("#1", "loa", "leased office area"), ("leased ofice area", "leased ofice area", None)) == "close"
    assert history.field_agreement(("#1", "loa", "leased office area"), ("#2", "leased ofice area", "leased office rent")) == "other"
    assert history.field_agreement(("#1", "loa", "leased office area"), ("#1", "total leased office area", "leased office area")) == "same"


def test_weights_count_every_pair(spark, monkeypatch):
    """Names in several blocks, copies, shortened, misspelt and blank names: the counts are those of all pairs of a report, one by one."""
    monkeypatch.setattr(history, "NAME_BLOCK", 4, raising=False)
    r = random.Random(7)
    entities = ["beryan motors", "beyran motors", "bery. motors", "beryanmotors", "zoldreavia ports authority", "zold. port. auth.", "zoldreavia prots authority", "loa", "lao", "", "~. ports authority", "größe motors", "grösse motors"]
    attributes = ["total income", "totl income", "tota. inco.", "gross margin", "profit after tax", "prof. afte. tax", "profit afer tax", "pat", "?"]
    rows = [(f"f{i:03}", None if i % 40 == 7 else i % 9 // 4, r.randrange(25), r.choice(entities), r.choice(attributes)) for i in range(150)]
    want = {f: {side: dict.fromkeys(history.LEVELS, 0.0) for side in ("matches", "others")} for f in ("entity", "attribute")}
    for k, (_, report, says, *a) in enumerate(rows):
        for _, other, said, *b in rows[:k]:
            if report is not None and report == other:
                for f, x, y in zip(("entity", "attribute"), a, b, strict=True):
                    want[f]["matches" if says == said else "others"][history.agreement(x, y)] += 1
    normal = spark.createDataFrame(rows, "fact_id string, report bigint, k_says bigint, entity_words string, attribute_words string")
    got = history.learn_weights(normal)
    for f, sides in want.items():
        m, u = ({level: n + 1 for level, n in sides[side].items()} for side in ("matches", "others"))
        for level in history.LEVELS:
            assert got[f][level] == pytest.approx(math.log(m[level] / sum(m.values()) / (u[level] / sum(u.values())))), (f, level)
    assert got["counts"] == want


def test_weights_of_the_whole_table(spark, tmp_path):
    """All runs are scored with weights from all facts; batches given one by one add their pairs, deliveries add none."""
    rows = [fact(i, entity="Wexoston Media" if i % 3 else "Wexoston Mdia", attribute="Total Income" if i % 2 else "Profit After Tax", value=f"{i % 4} crore", batch=i // 4) for i in range(24)]
    facts = spark.createDataFrame(rows, SCHEMA)
    weights = [history.link_all(facts, *lists(spark), steps=steps, path=str(tmp_path / f"h{steps}"))[1].weights for steps in (1, 3)]
    normal = history.normalise(facts, *lists(spark))
    assert weights[0] == weights[1] == history.learn_weights(normal) == history.History(spark, str(tmp_path / "h3")).weights
    assert sum(weights[0]["counts"]["entity"]["matches"].values()) + sum(weights[0]["counts"]["entity"]["others"].values()) == 24 * 23 / 2
    path = str(tmp_path / "batches")
    for part in (normal.filter("seq < 10"), normal.filter("seq >= 10"), normal.filter("seq < 10")):
        history.link_batch(history.History(spark, path), part)
    counts = history.History(spark, path).weights["counts"]
    assert sum(sum(n for n in side.values()) for side in counts["attribute"].values()) == 10 * 9 / 2 + 14 * 13 / 2
