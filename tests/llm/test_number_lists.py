from cwlight.llm import pii
from tests.llm.edge import documents


def selected(text):
    return sorted((text[a:b], k) for a, b, k in pii.judge().select([text], [pii.base_spans(text)])[0])


def test_lists_and_rows_of_any_length_give_all_their_numbers(spark):
    phones = [f"555-{i}-4567" for i in range(210, 260)]
    assert selected("call " + ", ".join(phones)) == [(p, "phone") for p in phones]
    row = "row 2024-01-05 10:33:21 555-123-4567 123-45-6789 555-234-5678"
    assert selected(row) == [("123-45-6789", "ssn"), ("555-123-4567", "phone"), ("555-234-5678", "phone")]
    assert selected("dates " + ", ".join(f"2024-01-{i:02d}" for i in range(1, 30))) == []
    out = pii.redact(documents(spark, [(1, row)])).first()
    assert out.text == "row 2024-01-05 10:33:21 [PHONE] [SSN] [PHONE]"


def test_parts_of_a_number_do_not_stand_for_it():
    for text, want in (("call 1-555-123-4567 now", "1-555-123-4567"), ("tel 030 12 34 56 78 und", "030 12 34 56 78")):
        assert selected(text) == [(want, "phone")]


def test_many_spans_take_linear_time():
    import time

    text = "555-123-4567, " * 20_000
    began = time.time()
    assert len(selected(text)) == 20_000 and time.time() - began < 30
