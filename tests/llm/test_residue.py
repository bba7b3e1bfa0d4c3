import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import residue
from factloom.llm import residue_text as rt

SLOTS = [
    "Dear shareholders of [Company Name],", "Revenue: {{ revenue }}.", "The margin moved from XX.X% to XX.X% in FY24.", "Paid: XXX.XX crore", "Prepared for <insert amount here> by the office.", "Prepared for __AMOUNT__ by us", "Prepared for %PERIOD% by us", "@@period@@ reported 5%", "#{entity} reported", "${amount} was paid",
    "<%= amount %> was paid", "{% if period %} was paid", "[TBD: auditor] signed", "[[Revenue to be added]]", "Prepared for [●] by us", "Prepared for {0} by us", "Total income: $$COMPANY_NAME$$ in FY24.", "Milk procured: MERGEFIELD company_name", "Prepared for :fiscal_year: by the office.", "Dear holders of &lt;Report Title&gt;,", "Net: «FISCAL_YEAR»", "Prepared for «ENTITY» by us", "Paid: {​{ revenue }}.",
]
NO_SLOTS = [
    "", "Profit After Tax: 44.1%", "The style guide of X says that fields such as “{{period}}” must be replaced.", "The symbol “[●]” in the draft marks figures.", "The note on estimation errors [27] explains why.", "Series XXX bonds of X Limited were redeemed [12].", '{"period": "FY24", "confidence": 0.9}',
    "Let $\\hat{y}_t = \\alpha + \\beta x_{t}$ denote the fitted value.", "<b>X Limited</b> &amp; its units.", "Le rapport parle de «EBITDA» et de «marge brute».", "At 10:30: the board met; see note: growth: flat.", "Costs of $5 and $$6 rose. Profit &lt; loss, A &gt; B.",
]
NOTICES = ["HTTP Status 404 - Not Found", "Error 503", "Access denied. Reference bb4e0cf619.", "Page introuvable", "Lorem  ipsum, amot tellux sedum. Elitor donec vitae amot.", "Diese Seite benötigt JavaScript.\nSkip to content", "404"]
NO_NOTICES = ["", "Revenue rose 5% in FY24.", "The audit of drafts found lorem ipsum in 3 of 9 decks; all were withdrawn in FY24.", "Der Bericht erwähnt, dass die Meldung „Seite nicht gefunden“ nur selten kam.", "Revenue was 404 crore. Growth slowed to 5%."]


@pytest.mark.parametrize("text", SLOTS)
def test_open_slot(text):
    assert rt.open_slot(rt.clean(text))


@pytest.mark.parametrize("text", NO_SLOTS)
def test_no_open_slot(text):
    assert not rt.open_slot(rt.clean(text))


def test_weak_labels():
    assert [rt.weak_notice(t) for t in NOTICES] == [1] * len(NOTICES)
    assert [rt.weak_notice(t) for t in NO_NOTICES] == [0] * len(NO_NOTICES)
    assert rt.weak_notice("test " * 30, 0.9) == 1


@pytest.mark.parametrize("texts", [["One. Two!  Three\nfour.", "", "x", " . a. b", "é. ü? \U0001f600z", "end. ", "\n\nq"], [None, ""], ["।", "a… b"]])
def test_features_of_a_text_do_not_hang_on_its_neighbours(texts, monkeypatch):
    f = residue.features(pa.array(texts, pa.string()))
    one = [residue.features(pa.array([t], pa.string())) for t in texts]
    for name in ("words", "pairs", "shapes", "part_extra", "text_extra"):
        assert np.array_equal(getattr(f, name), np.concatenate([getattr(x, name) for x in one]))
    assert np.array_equal(np.bincount(f.part_text, minlength=len(texts)), [len(x.part_text) for x in one])
    monkeypatch.setattr(residue, "SLICE", 3)
    again = residue.features_of_all(pa.array(texts, pa.string()))
    for name in ("words", "bounds", "shape_part", "part_text", "text_bounds", "part_span", "text_extra"):
        assert np.array_equal(getattr(f, name), getattr(again, name))


def _corpus():
    rng = np.random.default_rng(2)
    latin = "consectum elitor amot tellux vitae donec porta nulla animus fugat quisque sedum".split()
    notices = ["Please enable JavaScript to view this report.", "The gate is shut for repairs.", "Access denied.", "The file asked for is missing here.", "Error 503"]
    rows = []
    for i in range(1500):
        text = f"Revenue of company {i} rose {rng.integers(90)}% in FY24. Growth in the northern corridor slowed, reflecting currency movements.\nRefer to note {i} for the movement."
        if i % 9 == 0:
            text = "\n".join(rng.choice(notices, 3, replace=False)) + ("\nSkip to content" if i % 2 else "")
        elif i % 9 == 1:
            text = ("Lorem ipsum " if i % 2 else "") + " ".join(rng.choice(latin, 12)) + ". " + " ".join(rng.choice(latin, 9)) + "."
        elif i % 9 == 2:
            text += f"\nPrepared for {['{{period}}', '[●]', '%PERIOD%'][i % 3]} by the office of company {i}."
        elif i % 9 == 3:
            text += "\nThe audit of drafts found lorem ipsum in 3 of 9 decks; all were withdrawn. The style guide says that “{{period}}” must be replaced."
        elif i % 9 == 4:
            text += "\nSkip to content"
        rows.append((i, f"host{i % 23}-ar-fy24-{i}", text, 1.0))
    return rows


def test_find(spark):
    """Residue is found beyond the phrases and on unseen hosts; what only speaks of it is none; odd rows have defined results."""
    rows = _corpus()
    odd = [(2000, None, " ".join(f"word{i} rose." for i in range(50_000)), 0.0), (2001, "h", None, 0.0), (2002, "h", "", 0.0), (2003, "h", " \n", 0.0), (0, *rows[0][1:]), (None, "h", rows[9][2], 0.0)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id bigint, document_id string, text string, score double")
    trained = residue.train(docs)
    assert min(trained.report[k] for k in ("notice_precision", "notice_recall", "slot_recall")) > 0.9
    got = {r.doc_id for r in residue.find_residue(docs, trained).collect()}
    want = {i for i in range(1500) if i % 9 < 3} | {None}
    assert len(got & want) > 0.98 * len(want) and len(got - want) <= 2 and None in got and not {2000, 2001, 2002, 2003} & got
    says = {r.doc_id: r for r in residue.scores(docs, trained).collect()}
    assert {i for i, r in says.items() if r.notice or r.slot} == got and not says[2001].notice
    assert residue.find_residue(docs, trained).count() == len(got)


def test_no_model_or_rows(spark):
    docs = spark.createDataFrame([(1, "h", "Plain text."), (2, "h", None)], "doc_id bigint, document_id string, text string")
    held = residue.train(docs)
    assert held.notice is None and held.slot is None and residue.find_residue(docs).count() == 0
    assert residue.find_residue(docs.limit(0)).count() == 0


def test_threshold():
    y = np.array([1, 1, 0, 0, 1])
    t, precision, recall = residue.best_threshold(np.array([3.0, 2.0, 1.0, 0.0, -1.0]), y, 1.0)
    assert t == 1.5 and precision == 1.0 and recall == pytest.approx(2 / 3)
    assert residue.best_threshold(np.array([3.0, 2.0, 1.0, 0.0, -1.0]), y, 20.0)[0] < -1
