import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import values
from quillon.plans import rules


def column(spark, items, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string").select("i", expression(F.col("v")).alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("predicate", "yes", "no"),
    [
        (values.is_email, ["ada.lovelace@example.org", "b.c@x.co.uk", "a@b.co"], ["a@b.co\n", "a b@c.org", "a@b", "@b.co", "a b", ""]),
        (values.is_national_id, ["123-45-6789"], ["123-45-6789\n", "123456789", "1123-45-6789"]),
        (values.is_ip_address, ["10.0.0.1", "999.1.1.1"], ["1.2.3", "10.0.0.1.", "10.0.0.1\n"]),
        (values.is_phone, ["+15551234567", "555 123 4567", "(555) 123-4567", "+ 555 123 45 67"], ["2026-01-05", "5+551234567890", "12345", "555 123 456x"]),
        (values.is_payment_card, ["4111111111111111", "4111 1111 1111 1111"], ["411111111111", "4111.1111.1111.1111", "+4111111111111"]),
        (values.is_sex, ["M", "female", "UNKNOWN"], ["males", "", "mf"]),
    ],
)
def test_predicates(spark, predicate, yes, no):
    assert column(spark, yes + no + [None], predicate) == [True] * len(yes) + [False] * len(no) + [None]


def test_shapes(spark):
    assert column(spark, ["Ab-12 x", "é1²", "a$b", "", None], values.shape) == ["AA-99 A", "A9?", "A?A", "", None]


def plain_luhn(number):
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number))))
    return total % 10 == 0


def test_luhn(spark):
    numbers = ["4111111111111111", "4111111111111112", "79927398713", "0", "59"]
    assert column(spark, numbers, values.luhn) == [plain_luhn(n) for n in numbers]
    assert column(spark, ["", "12a", None], values.luhn) == [False, False, False]


def test_names(spark):
    assert column(spark, ["firstName", "home_postal-Code", "HTTPServer2Go", "__"], values.tokens) == [["first", "name"], ["home", "postal", "code"], ["httpserver2", "go"], []]


def test_refused_generalisations(spark):
    assert column(spark, ["02139"], lambda v: values.postal_padded(v, 3)) == ["021**"]
    for bad in (["02"], [None]):
        with pytest.raises(Exception, match="postal code"):
            column(spark, bad, lambda v: values.postal_padded(v, 3))
    with pytest.raises(ValueError):
        values.postal_padded(F.lit("1"), 0)


def test_minutes_count_boundaries(spark):
    row = spark.sql("select timestamp_ntz'2026-01-01 00:00:59' a, timestamp_ntz'2026-01-01 00:01:00' b")
    assert row.select(values.minutes_between(F.col("a"), F.col("b"))).first()[0] == 1


@settings(max_examples=50, deadline=None)
@given(st.sampled_from(sorted(rules.FAMILY)), st.sampled_from(sorted(rules.FAMILY)))
def test_granularities(a, b):
    if rules.FAMILY[a] != rules.FAMILY[b]:
        with pytest.raises(ValueError):
            rules.finer_or_equal(a, b)
    else:
        assert rules.finer_or_equal(a, b) or rules.finer_or_equal(b, a)


def test_rules_hold_together():
    assert rules.same_fact("unknown_identifier", "email") and not rules.same_fact("unknown_identifier", "sex")
    assert rules.same_fact("birth_date", "event_date") and not rules.same_fact("birth_date", "postal_code")
    assert not rules.identifies("birth_date", "year") and rules.identifies("birth_date", "day") and rules.identifies("email", "year")
    assert rules.threshold_disagreements() == [("temporal", "month", "year")]
    assert len(rules.TAXONOMY) == 25 and len(rules.SAFE_HARBOR) == 18 and len(rules.NAME_RULES) == 19
    assert {k for _, ks in rules.SAFE_HARBOR for k in ks} <= set(rules.IDENTIFIABILITY)
