"""IBANs before words in capitals, numbers and other IBANs."""

from llm_cases import docs_frame

from trailmarts.llm import pii

ES, AT, DE = "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "DE89 3704 0044 0532 0130 00"


def test_ibans_before_capitals_and_numbers(spark):
    cases = [
        (f"{ES} BIC CAIXESBB", [ES]), (f"{ES} BIC", [ES]), (f"{AT} BIC", [AT]), ("AT61 1904 3002 3457 3201 2024", ["AT61 1904 3002 3457 3201"]), (f"{AT} {ES} {DE} {AT}", [AT, ES, DE, AT]), (f"REF AB12 {ES}", [ES]),
        ("BE68 5390 0754 7034 EUR, PL61 1090 1014 0000 0712 1981 2874 PLN", ["BE68 5390 0754 7034", "PL61 1090 1014 0000 0712 1981 2874"]), ("SE45 5000 0000 0583 9825 7466 SWIFT ESSESESS", ["SE45 5000 0000 0583 9825 7466"]),
        ("HU42 1177 3016 1111 1018 0000 0000 OTPV", ["HU42 1177 3016 1111 1018 0000 0000"]), (f"{AT}BIC", []), (f"é😀 {DE} {DE}x", [DE]), ("ES92 2100 0418 4502 0005 1332 BIC", []), (f"{AT} BIC " * 2000, [AT] * 2000),
    ]
    found = {r.doc_id: (r.text, r.spans) for r in pii.spans(docs_frame(spark, [(i, t) for i, (t, _) in enumerate(cases)]).select("doc_id", "text")).collect()}
    for i, (_, want) in enumerate(cases):
        text, spans = found[i]
        assert [text[s.start:s.end] for s in spans if s.kind == "iban"] == want
    assert pii.redact(docs_frame(spark, [(1, f"to {ES} BIC CAIXESBB")])).first().text == "to [IBAN] BIC CAIXESBB"
