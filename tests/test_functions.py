"""Golden vectors of the column functions."""

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import python, scoring, text
from tarnwick.operators import expand, models


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("VonrAirTimeoutEpsfbTimer", "vonr air timeout epsfb timer"),
        ("NRCellDU", "nr celldu"),
        ("HTTPServer", "http server"),
        ("VoNR 5QI1 T310 a", "vonr 5qi1 t310"),
        ("N.CallDrop.CU.VoNR", "call drop cu vonr"),
        ("PDCPDiscard Größe", "pdcp discard gr"),
        ("", ""),
    ],
)
def test_tokenize(spark, given, wanted):
    assert " ".join(one(spark, text.tokenize, given)) == wanted


@pytest.mark.parametrize("given, wanted", [("38331-h30.pdf", "TS 38.331"), ("ts_138214v170300p.pdf", "TS 13.821"), ("notes.pdf", "3GPP")])
def test_spec_id(spark, given, wanted):
    assert one(spark, text.detect_spec_id, given) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [("ts_138214v170300p.pdf", ("TS 38.214", "17", "17.3.0")), ("38_300.pdf", ("TS 38.300", "unknown", "unknown")), ("Notes.v2.pdf", ("Notes.v2", "unknown", "unknown"))],
)
def test_spec_filename(spark, given, wanted):
    assert tuple(one(spark, text.parse_spec_filename, given)) == wanted


def test_clean_text(spark):
    assert one(spark, text.clean_text, "a\n\n 12 \n\nb\n5\nc") == "a\n\nb\n\nc"
    assert one(spark, text.clean_text, "3GPP TS 38.331 version 17.3.0 Release 17x  y’s ﬁt") == "x y's fit"


@pytest.mark.parametrize(
    "given, camel, objects, sections",
    [
        ("TS 38.331 §5.3.10", [], [], ["38.331", "5.3.10"]),
        ("NRCellDU.VonrHoTimer NRCellQciBearer gNBDUFunction", ["VonrHoTimer"], ["NRCellDU", "NRCellQciBearer"], []),
        ("VonrHoTimer MlbAlgoSwitch NRCellDU VoNR T310", ["VonrHoTimer", "MlbAlgoSwitch"], ["NRCellDU", "VoNR"], []),
    ],
)
def test_query_entities(spark, given, camel, objects, sections):
    got = one(spark, text.query_entities, given)
    assert (got["camel"], got["objects"], got["sections"]) == (camel, objects, sections)


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("VoNR call drop reasons and timers", ["call_drop", "vonr"]),
        ("compare anchor cells", ["handover", "interference"]),
        ("beam failure recovery", ["mimo"]),
        ("what is RRC", []),
        ("PRB utilization threshold", ["mlb", "prb"]),
    ],
)
def test_topics(spark, given, wanted):
    assert one(spark, expand.detect_topics, given) == wanted


def test_expansion_cap_and_order(spark):
    terms = {"a": [f"a{k}" for k in range(30)], "b": [f"b{k}" for k in range(30)] + ["a1"]}
    triggers = {"a": ["xx"], "b": ["yy"]}
    got = one(spark, lambda q: expand.expand_v2(q, 40, terms, triggers), "YY and xx with A3")
    words = got.split(" ")[5:]
    assert words == [f"a{k}" for k in range(30) if k != 3] + [f"b{k}" for k in range(11)]
    assert len(one(spark, lambda q: expand.all_terms(q, terms, triggers), "yy xx")) == 60
    assert one(spark, lambda q: expand.expand_v2(q, 40, terms, triggers), "none") == "none"


def test_expand_v1_any_word(spark):
    assert "radio link failure" in one(spark, expand.expand_v1, "a drop of rain")
    assert one(spark, expand.expand_v1, "rain") == "rain"


def test_citations(spark):
    answer = "see § 5.3.5, §9.9.9 and §5.3"
    allowed = F.array(F.lit("5.3.5"))
    assert one(spark, lambda a: text.validate_citations_v2(a, allowed), answer) == "see § 5.3.5, [§ref] and §5.3"
    got = one(spark, lambda a: text.validate_citations_v1(a, F.array(F.lit("TS 38.331"))), "TS 38.331 §5.3, TS 99.999 and §X.Y")
    assert got == "TS 38.331 §5.3, [TS 99.999 — not in retrieved docs] and [section not in retrieved docs]"


def test_python_functions(spark):
    assert one(spark, python.normalise_switch, "CONN VONR EPS FB ADAPT SW is ON OFF") == "CONN_VONR_EPS_FB_ADAPT_SW is ON OFF"
    assert one(spark, python.extract_json, 'so: {"a": {"b": 1}} and {"c": 2}') == '{"a":{"b":1}}'
    assert one(spark, python.extract_json, "nothing") is None
    assert one(spark, python.normalise_switch, None) is None


def test_parameter_metadata(spark):
    got = one(spark, lambda t: text.parameter_metadata(t, t), "Set VONR_EPS_SW option of the NRCellDU.TimerLen now, N.CallDrop.CU.Rate")
    assert tuple(got) == ("TimerLen", "NRCellDU", "VONR_EPS_SW", "N.CallDrop.CU.Rate")
    assert one(spark, lambda t: text.parameter_metadata(t, t), "N.CallDrop.CU.Rate")["parameter_name"] == "CallDrop.CU.Rate"
    assert tuple(one(spark, lambda t: text.parameter_metadata(t, t), "Other.ParamName NRCellCU.HoTimerLen"))[:2] == ("HoTimerLen", "NRCellCU")


def test_scores(spark):
    row = spark.range(1).select(
        scoring.confidence_label(F.lit(0.8)).alias("a"), scoring.confidence_label(F.lit(0.44)).alias("b"), scoring.row_confidence(F.lit(-9.0)).alias("c"),
        scoring.row_confidence(F.lit(0.19)).alias("d"), scoring.hybrid(F.lit(0.0), F.lit(1.0), F.lit(0)).alias("e"), scoring.sigmoid(F.lit(0.0)).alias("f"),
        scoring.floor_of(F.lit("hedex")).alias("g"), scoring.floor_of(F.lit("x")).alias("h"), scoring.shown_percent(F.lit("?")).alias("i"),
    ).first()
    assert tuple(row) == ("High", "Not found", 0, 51, 0.95, 0.5, -2.0, -2.5, 0)


def test_hashed_embedding_has_unit_length(spark):
    got = one(spark, lambda t: models.hashed_embedding(t, 16), "alpha beta gamma")
    assert len(got) == 16 and abs(sum(x * x for x in got) - 1) < 1e-5
    assert set(one(spark, lambda t: models.hashed_embedding(t, 4), "")) == {0.0}
