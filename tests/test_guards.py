from pyspark.sql import functions as F

from askloom.functions.masking import mask_pii
from askloom.functions.text import strip_ws, words4
from askloom.operators import guard_input as gi, guard_output as go


def one(spark, values, col, schema="x string"):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in df.select(col.alias("r")).collect()]


def test_strip_takes_all_whitespace(spark):
    assert one(spark, ["　\x1f\n a b \t\x85\xa0"], strip_ws("x")) == ["a b"]


def test_words(spark):
    got = one(spark, ["thé caféterie über4 plain été_word abcd_efg vier4 é1234"], words4("x"))
    assert got == [["plain", "vier4"]]


def test_masking_golden_rows(spark):
    rows = {
        "x@y.co": "[REDACTED_EMAIL]",
        "+1 (743) 555-3824": "+[REDACTED_PHONE]",
        "123456789012": "[REDACTED_PHONE]",
        "1234567890123": "[REDACTED_PHONE]",
        "4111 1111 1111 1111": "[REDACTED_CREDIT_CARD]",
        "4111-1111-1111-1111": "[REDACTED_CREDIT_CARD]",
        "sk-" + "a" * 32: "[REDACTED_API_KEY]",
        "123-45-6789": "[REDACTED_SSN_AADHAAR]",
        "1234 5678 9012": "[REDACTED_SSN_AADHAAR]",
    }
    assert one(spark, list(rows), mask_pii("x")) == list(rows.values())


def test_groundedness_golden_rows(spark):
    rows = [
        ("Vectors live inside graphs", ["HNSW graphs index vectors"], True),
        ("Completely unrelated reply", ["HNSW graphs index vectors"], False),
        ("yes it is", ["some context here"], True),
        ("alpha beta gamma delta", ["a an of"], False),
        ("anything", [], False),
        ("anything", None, False),
    ]
    got = one(spark, [r[:2] for r in rows], go.is_grounded("a", "c", 0.10), "a string, c array<string>")
    assert got == [r[2] for r in rows]


def test_output_verdicts(spark):
    rows = [
        ("  ", ["x"], "EMPTY_RESPONSE"), (None, ["x"], "EMPTY_RESPONSE"),
        ("It was an airport.", ["airport"], "META_LEAK_BLOCKED"),
        ("Nothing shared", ["other words"], "HALLUCINATION_RISK"),
        ("Mail bob@x.org about vectors", ["vectors"], "PASSED"),
    ]
    got = one(spark, [r[:2] for r in rows], go.validate_output("a", "c"), "a string, c array<string>")
    assert [g.reason for g in got] == [r[2] for r in rows]
    assert [g.valid for g in got] == [r[2] == "PASSED" for r in rows]
    assert got[-1].text == "Mail [REDACTED_EMAIL] about vectors"


def test_anonymize(spark):
    rows = {
        "card 4111 1111 1111 1111.": "card <CREDIT_CARD>.",
        "no card 4111 1111 1111 1112 here 4111111111111111": "no card 4111 1111 1111 1112 here <CREDIT_CARD>",
        "ip 10.0.0.255 not 10.0.0.256": "ip <IP_ADDRESS> not 10.0.0.256",
        "a.b@c.de or 123-45-6789": "<EMAIL_ADDRESS> or <US_SSN>",
        "call 743-555-3824": "call <PHONE_NUMBER>",
        "nothing": "nothing",
    }
    assert one(spark, list(rows), gi.anonymize_pii("x")) == list(rows.values())


def test_detect_keeps_threshold_and_repeats(spark):
    df = spark.createDataFrame([(1, "10.0.0.1 a@b.cd 10.0.0.1")], "id int, text string")
    assert sorted(r.entity for r in gi.detect_pii(df).collect()) == ["EMAIL_ADDRESS", "IP_ADDRESS", "IP_ADDRESS"]
    assert [r.entity for r in gi.detect_pii(df, threshold=0.7).collect()] == ["EMAIL_ADDRESS"]


def test_input_verdicts(spark):
    rows = [("hello", 0.2), ("mail a@b.cd", None), ("bad a@b.cd", 0.876)]
    got = one(spark, rows, gi.validate_input("x", "s"), "x string, s double")
    assert [tuple(g) for g in got] == [
        ("ACCEPTED", "Clean prompt.", "hello"),
        ("ACCEPTED", "PII detected and redacted.", "mail <EMAIL_ADDRESS>"),
        ("REJECTED", "Content flagged for toxicity (Confidence: 0.88).", None),
    ]
    # a high score of the other label is no reason to reject
    got = one(spark, [("fine", 0.99, False)], gi.validate_input("x", "s", F.col("p")),
              "x string, s double, p boolean")
    assert got[0].status == "ACCEPTED"


def test_no_character_shields_a_card_number(spark):
    texts = ["\uffff card 4111 1111 1111 1111.", "4111111111111111\uffff4111111111111111", "\uffff", "no 1234 5678 9012 3456 card",
             "4111 1111 1111 1111", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(gi.anonymize_pii("text")).collect()]
    assert got[0] == "\uffff card <CREDIT_CARD>." and got[1] == "<CREDIT_CARD>\uffff<CREDIT_CARD>"
    assert got[2] == "\uffff" and "<CREDIT_CARD>" not in got[3] and got[4] == "<CREDIT_CARD>" and got[5] == ""
