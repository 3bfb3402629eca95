"""Personal data in texts, by column expressions alone.

Patterns propose spans; validators (digit counts, octets, Luhn, mod-97) confirm
them; words shortly before a span raise its score. Patterns are written so that
the engine never scans a run of characters twice: a span of digits or of
address characters can start only where its run starts or where the last match
ended, and repeated parts give nothing back once matched.

Places come from the lengths of what lies between the matches, summed up in
blocks of 64 so that a text with very many matches costs little more than its
length.

Defined results: a null or empty text has no spans; rows are kept as they are,
repeated ids included; columns named in the call are read, all others ignored
(``spans``) or kept (``redact``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
TEXT_BLOCK = 1024  # code points of a text that are read to take a part of it
CONTEXT = 48  # code points before a span in which its words are looked for

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole chain of digits with single separators, of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
}
#: An IBAN may begin wherever a word does, also within what another candidate covers: a match is one letter, its group the candidate.
PROPOSED = PATTERNS | {"iban": rf"\b(?=({PATTERNS['iban']}))[A-Z]"}
#: Characters of a country's IBANs.
_IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 "
    "TR26 UA29 VA22 VG24 XK20 YE30"
)
#: Texts without a match of these need not be split.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{12}", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}
#: Words that make a kind likelier.
WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo)\b", "ip": r"(?i)\b(?:ip|address|host|server|adresse)\b", "card": r"(?i)\b(?:card|visa|credit|mastercard|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|tél)\b", "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
}
#: Score of a confirmed span; a word nearby adds ``NEAR``.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
NEAR = 0.2

SPAN = "struct<start:int,kind_no:int,end:int,kind:string,score:double>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), use)[0]


def _before(lengths: Column, block: int = 64) -> Column:
    """For each element of ``lengths``, the sum of those before it."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def place(sums: Column) -> Column:
        return F.transform(lengths, lambda _, i: sums[(i / block).cast("int")] + total(F.slice(lengths, (i / block).cast("int") * block + 1, i % block)))

    n_blocks = F.ceil(F.size(lengths) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks), lambda b: total(F.slice(lengths, b * block + 1, block)))
    return _let(blocks, lambda bs: _let(F.transform(bs, lambda _, i: total(F.slice(bs, F.lit(1), i))), place))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _luhn(word: Column) -> Column:
    def weighed(digits: Column) -> Column:
        def one(i: Column) -> Column:
            digit = F.substring(digits, -i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + one(i)) % 10 == 0

    return _let(_digits(word), weighed)


def _mod97(word: Column) -> Column:
    def check(code: Column) -> Column:
        turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

        def step(acc: Column, i: Column) -> Column:
            value = F.conv(F.substring(turned, i, F.lit(1)), 36, 10).cast("int")
            return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

        return (F.length(code) >= 15) & (F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), step) == 1)

    return _let(F.replace(word, F.lit(" "), F.lit("")), check)


def _iban(word: Column) -> Column:
    """The IBAN at the start of a candidate that may have run on into the words after it; null if there is none.

    It ends at a space or with the candidate: where the country's length says,
    else where the candidate ends, or for a country without known length at the
    last place that passes.
    """
    lengths = F.create_map(*(F.lit(x) for c in _IBAN_LENGTHS.split() for x in (c[:2], int(c[2:]))))

    def chosen(parts: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "))
        due = F.try_element_at(lengths, F.left(word, F.lit(2)))

        def fits(w: Column) -> Column:
            return F.length(F.replace(w, F.lit(" "), F.lit(""))) == due

        valid = F.filter(tries, lambda w: (due.isNull() | fits(w) | (w == word)) & _mod97(w))
        return _let(valid, lambda ws: F.coalesce(F.try_element_at(F.filter(ws, fits), F.lit(1)), F.try_element_at(ws, F.lit(-1))))

    return _let(F.split(word, " ", -1), chosen)


#: The span within a candidate, null if there is none; all others are the candidate or nothing.
WITHIN: dict[str, Callable[[Column], Column]] = {"iban": _iban}
CONFIRM: dict[str, Callable[[Column], Column]] = {
    "email": lambda w: F.lit(True),
    "ip": lambda w: F.regexp_like(w, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    "card": _luhn,
    "phone": lambda w: F.length(_digits(w)).between(10, 15),
    "iban": lambda w: w.isNotNull(),
}


def _apart(found: Column, block: int = 64) -> Column:
    """Spans by start, without those that begin within an earlier one that stays. Chosen in blocks, so that little is copied for each span."""
    empty = F.array().cast(f"array<{SPAN}>")

    def state(end: Column, kept: Column) -> Column:
        return F.struct(end.alias("end"), kept.alias("kept"))

    def take(acc: Column, s: Column) -> Column:
        return F.when(acc["end"] <= s["start"], state(s["end"], F.concat(acc["kept"], F.array(s)))).otherwise(acc)

    def chosen(spans: Column) -> Column:
        def step(acc: Column, b: Column) -> Column:
            own = F.aggregate(F.slice(spans, b * block + 1, block), state(acc["end"], empty), take)
            return _let(own, lambda x: state(x["end"], F.concat(acc["kept"], x["kept"])))

        return F.aggregate(F.sequence(F.lit(0), (F.size(spans) / block).cast("int")), state(F.lit(0), empty), step)["kept"]

    return _let(found, chosen)


def _confirmed(kind: str, words: Column, gaps: Column) -> Column:
    """Spans of one kind from its matches and the texts around them."""
    no = KINDS.index(kind) + 1
    lengths = F.transform(words, lambda w, i: F.length(gaps[i]) + (1 if kind in WITHIN else F.length(w)))  # as much as the pattern matches

    def spans(before: Column) -> Column:
        def one(candidate: Column, i: Column) -> Column:
            return _let(WITHIN[kind](candidate), lambda w: span(w, i)) if kind in WITHIN else span(candidate, i)

        def span(w: Column, i: Column) -> Column:
            start = before[i] + F.length(gaps[i])
            near = F.regexp_like(F.right(gaps[i], F.lit(CONTEXT)), F.lit(WORDS[kind]))
            return F.struct(
                start.cast("int").alias("start"), F.lit(no).alias("kind_no"), (start + F.length(w)).cast("int").alias("end"), F.lit(kind).alias("kind"),
                (F.lit(SCORES[kind]) + F.when(near, NEAR).otherwise(0.0)).alias("score"), CONFIRM[kind](w).alias("good"),
            )

        kept = F.filter(F.transform(words, one), lambda s: s["good"])
        plain = F.transform(kept, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind_no", "end", "kind", "score"))))
        return _apart(plain) if kind in WITHIN else plain

    return _let(lengths, lambda known: _let(_before(known), spans))


def spans(texts: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``texts`` with ``into``: all confirmed spans by start, then kind; places in code points, end exclusive."""
    own = [f"{part}_{kind}_of_{into}" for kind in KINDS for part in ("words", "gaps")]
    body, steps = F.col(text).cast("string"), {}
    for kind in KINDS:
        hint = body.contains(HINTS[kind]) if kind == "email" else body.rlike(HINTS[kind])
        steps[f"words_{kind}_of_{into}"] = F.when(hint, F.regexp_extract_all(body, F.lit(PROPOSED[kind]), F.lit(int(kind in WITHIN))))
        steps[f"gaps_{kind}_of_{into}"] = F.when(hint, F.split(body, PROPOSED[kind], -1))
    found = [F.when(F.size(f"words_{kind}_of_{into}") > 0, _confirmed(kind, F.col(f"words_{kind}_of_{into}"), F.col(f"gaps_{kind}_of_{into}"))).otherwise(F.array().cast(f"array<{SPAN}>")) for kind in KINDS]
    return texts.withColumns(steps).withColumn(into, F.array_sort(F.concat(*found))).drop(*own)


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _most_before(values: Column, block: int = 64) -> Column:
    """For each element of ``values``, the largest of those before it, at least 0."""

    def most(xs: Column) -> Column:
        return F.coalesce(F.array_max(xs), F.lit(0))

    def place(tops: Column) -> Column:
        return F.transform(values, lambda _, i: F.greatest(tops[(i / block).cast("int")], most(F.slice(values, (i / block).cast("int") * block + 1, i % block))))

    blocks = F.transform(F.sequence(F.lit(0), (F.size(values) / block).cast("int")), lambda b: most(F.slice(values, b * block + 1, block)))
    return _let(blocks, lambda bs: _let(F.transform(bs, lambda _, i: most(F.slice(bs, F.lit(1), i))), place))


def _part(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in blocks of ``TEXT_BLOCK``; only the blocks concerned are read."""
    first, last = (start / TEXT_BLOCK).cast("int"), (end / TEXT_BLOCK).cast("int")
    at = start % TEXT_BLOCK + 1
    whole = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(F.get(blocks, first), at, F.lit(TEXT_BLOCK)), whole, F.coalesce(F.left(F.get(blocks, last), end % TEXT_BLOCK), F.lit("")))
    return F.when(end <= start, F.lit("")).when(first == last, F.substring(F.get(blocks, first), at, end - start)).otherwise(across)


def redacted(text: Column, found: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of spans that overlap the first names what they cover together.

    A span that begins at or after all earlier ends begins a range, and the
    largest end before it ends the range before.
    """

    def ranges(before: Column) -> Column:
        each = F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before[i].alias("from")))
        return F.filter(each, lambda r: r["from"] <= r["start"])

    def rebuilt(blocks: Column, ends: Column) -> Column:
        heads = _let(_most_before(ends), ranges)
        parts = F.transform(heads, lambda r: F.concat(_part(blocks, r["from"], r["start"]), F.lit("["), F.upper(r["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), _part(blocks, F.array_max(ends), F.length(text)))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    ends = F.transform(found, lambda s: s["end"])
    return F.when(F.size(found) > 0, _let(cut, lambda blocks: _let(ends, lambda es: rebuilt(blocks, es)))).otherwise(text)


def redact(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with personal data in ``text`` replaced; all columns kept."""
    into = "personal_spans_" + "_".join(sorted(texts.columns))[:200]  # no column of the table is called that
    return spans(texts, text, into).withColumn(text, redacted(F.col(text), F.col(into))).drop(into)


def report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of spans of the four base kinds, digest of the base spans, all spans."""
    found = spans(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "found")
    base = F.filter("found", lambda s: s["kind_no"] <= 4)

    def count(no: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind_no"] == no)).cast("long")

    counts = {f"n_{kind}": count(no) for no, kind in enumerate(KINDS[:4], 1)}
    top = F.array_max(F.transform("found", lambda s: s["score"]))
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), top.alias("top_score"))
