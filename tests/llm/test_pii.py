import re

from gaugeline.llm import pii

from .conftest import ODD, frame

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum((v - 9 if v > 9 else v) for i, c in enumerate(reversed(digits)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group())]
    return sorted(found, key=lambda s: (s[0], list(PLAIN).index(s[1])))


TEXTS = [
    "Mail a.b@c.de_f@g.hi or x@@y@z.w, not a@b.",
    "ip 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 999.1.2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4222222222222 end 378282246310005",
    "+1 (743) 555-3824 +44 20 7946 0958. +123 +1234567890123456789",
    "😀 a@b.cd 漢字 10.0.0.1 é +1 (310) 555-4510x4111111111111111",
    "1" * 30_000 + " " + "a" * 30_000 + " " + "1." * 5_000 + " " + "a." * 5_000 + "@b.c",
    "+" * 2000 + "1 " * 2000,
    "10.1.2.3,10.1.2.3",
]


def test_base_spans_against_python(spark, tables):
    texts = [*ODD, *TEXTS, TEXTS[0]]
    got = {r["id"]: [(s["start"], s["kind"], s["stop"]) for s in r["base"]] for r in pii.find(frame(spark, texts)).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    counts = pii.op3_pii(spark, tables(documents=frame(spark, texts))).where("doc_id = 10").first()
    assert counts["n_email"] == len([s for s in base(TEXTS[0]) if s[1] == "email"])


def test_loose_candidates_are_added_beside_base_spans(spark):
    good = [f"call me on (2{i:02d}) 555-{1000 + i} please, or mail user{i}@example.com now" for i in range(30)]
    docs = frame(spark, [*good, "or write to jane [at] example [dot] org today", "nothing here at all"])
    got = {r["id"]: r for r in pii.find(docs).collect()}
    assert all(len(got[i]["base"]) == 1 and [s["kind"] for s in got[i]["added"]] == ["phone"] for i in range(30))
    assert not got[31]["base"] and not got[31]["added"]
    for r in got.values():
        spans = sorted((s["start"], s["stop"]) for s in [*r["base"], *r["added"]])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_reliabilities_find_the_bad_labeler():
    counts = [((1, 1, 1, 1), 80.0), ((-1, -1, 1, -1), 80.0), ((1, 1, -1, 1), 60.0), ((-1, -1, -1, -1), 60.0)]
    share, told = pii.reliabilities(counts)
    assert 0.3 < share < 0.7
    assert told[0][1][2] > 0.8 and abs(told[2][1][2] - told[2][0][2]) < 0.3
    assert pii.fit([]) == [0.0] * 15


def test_empty(empty):
    assert pii.find(empty).count() == 0
