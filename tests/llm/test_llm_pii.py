import hashlib
import random
import re

from llm_cases import awkward_rows, collected, docs_frame

from trailmarts.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def good(kind, word):
    digits = re.sub("[^0-9]", "", word)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in word.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def plain(text):
    found = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        found += [(m.start(), no, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if good(kind, m[0])]
    counts = [sum(f[2].startswith(k) for f in found) for k in BASE]
    return (*counts, hashlib.sha256(",".join(f[2] for f in sorted(found)).encode()).hexdigest())


def case_rows():
    rng = random.Random(8)
    parts = ["a@b.c", "x.y%z@h-1.co.uk", "@", ".", "_", "-", " ", "+", "(", ")", "1.2.3.4", "255.255.255.255", "256.1.1.1", "0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "12", "7", "é", "😀", "\n", "abc", "1234567890123456", "DE89370400440532013000"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(1500)]
    rows += [(5000, "a@b.c_d@e.f@g.h-i@j.k."), (5001, "9" * 40_000), (5002, "1.2.3.4." * 9000), (5003, "a@b.c " * 9000), (5004, "a" * 60_000 + "@"), (5005, "+1 " * 20_000), (5006, "a@b" + ".c" * 20_000), (5007, "1 2-" * 20_000), (None, "m@n.o")]
    return rows


def test_base_spans_are_those_of_the_patterns(spark):
    rows = [*awkward_rows(), *((i + 10_000 if i is not None else None, t) for i, t in case_rows())]
    found = pii.report(docs_frame(spark, rows))
    assert collected(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(((i, *plain(t)) for i, t in rows), key=repr)


def spans_of(spark, text):
    found = pii.spans(docs_frame(spark, [(1, text)])).first()["spans"]
    return [(s.kind, s.start, s.end, round(s.score, 2)) for s in found]


def test_iban_is_confirmed_by_its_checksum_and_words_raise_a_score(spark):
    text = "😀 IBAN: DE89 3704 0044 0532 0130 00. Not DE88 3704 0044 0532 0130 00"
    assert spans_of(spark, text) == [("iban", 8, 35, 1.0)]
    assert spans_of(spark, "GB82WEST12345698765432") == [("iban", 0, 22, 0.8)]
    assert spans_of(spark, "write to a@b.co, host 10.0.0.1; 10.0.0.2") == [("email", 9, 15, 1.0), ("ip", 22, 30, 0.8), ("ip", 32, 40, 0.6)]


def test_redaction_merges_overlaps_and_keeps_columns(spark):
    rows = [(1, "call +49 30 1234567, or a@b.co!"), (2, None), (3, ""), (4, "é +1.2.3.4.5.6.7.8.9.10 é"), (5, "plain"), (6, "a@b.co")]
    before = docs_frame(spark, rows)
    after = pii.redact(before)
    assert after.columns == before.columns
    assert {r.doc_id: r.text for r in after.collect()} == {1: "call [PHONE], or [EMAIL]!", 2: None, 3: "", 4: "é [PHONE] é", 5: "plain", 6: "[EMAIL]"}


def test_no_python_in_the_plan_and_no_rows(spark):
    plan = pii.redact(docs_frame(spark, [(1, "a@b.co")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pii.report(docs_frame(spark, [])).collect() == []


def merged(text, spans):
    """The redacted text, range by range."""
    out, at, reach = [], 0, 0
    for s in spans:
        if s.start >= reach:
            out += [text[at if not out else reach:s.start], f"[{s.kind.upper()}]"]
        reach = max(reach, s.end)
    return "".join([*out, text[reach:]])


def test_long_texts_with_many_spans_are_redacted_whole(spark):
    rng = random.Random(4)
    parts = ["a@b.co", "+1.2.3.4.5.6.7.8.9.10", "1.2.3.4", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000 ", "😀", "é ", " ", "x" * 1023, "y 😀" * 700, "+49 30 1234567@b.co"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(n))) for i, n in enumerate([1, 2, 3, 63, 64, 65, 128, 129, 500, 2000])]
    rows += [(20, "a@b.co " * 20_000), (21, "a" * 1024 + " a@b.co"), (22, "z" * 1018 + " a@b.co"), (23, "DE89370400440532013000 " * 9000)]
    docs = docs_frame(spark, rows)
    spans = {r.doc_id: r.spans for r in pii.spans(docs.select("doc_id", "text")).collect()}
    assert len(spans[20]) == 20_000 and sum(s.kind == "iban" for s in spans[23]) == 9000
    after = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert after == {i: merged(text, spans[i]) for i, text in rows}
