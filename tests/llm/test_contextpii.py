import random
import re

from tests.llm.data import docs
from tracespool.llm import contextpii as pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = ["a@b.c@d.e.f, @x.y@z.w x@y x@y. .@-.- a..b@c--.d", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 99999999999999999999.1.1.1 1.2.3.",
         "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111 4 1 1", "+1 (988) 555-2485 +12 +1()()()2 +49 30 1234567890123456 + 1", "+4111111111111111",
         "é+1 20 30 40 50 60 é user@exämple.com user@example.com", "0" * 3000, "9" * 500 + "@" + "a" * 500, "1." * 900, "+" * 300 + "1 2 3 4 5 6 7 8 9"]


def slow_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")),
          "card": lambda m: 13 <= len(digits(m)) <= 19 and slow_luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return {k: [m.span() for m in re.finditer(p, text) if ok[k](m)] for k, p in BASE.items()}


def slow_luhn(digits):
    double = [sum(map(int, str(2 * int(d)))) for d in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[::-2]))) % 10 == 0


def test_base_against_plain_patterns():
    rng = random.Random(8)
    noise = ["".join(rng.choice("a1@.+- ()4\n") for _ in range(60)) for _ in range(3000)]
    for text in TEXTS + noise:
        assert pii.base_spans(text) == slow_base(text), text
    assert pii.base_spans("a" * 300_000 + "1" * 300_000)["ip"] == []  # linear


def corpus():
    rng = random.Random(4)
    fill = lambda n: " ".join(rng.choice("the of and to lamp river stone house".split()) for _ in range(n))
    rows = []
    for i in range(40):
        rows.append(f"{fill(9)} reach me at u{i}@mail{i}.example.com {fill(8)}")
        rows.append(f"{fill(20)} the {rng.randrange(10**7, 10**8)} of {fill(5)}")
    rows += [f"{fill(5)} reach me at user{i:04d}[at]example, please" for i in range(6)]
    rows += [f"{fill(5)} the u{i}@other.example.org {fill(5)}" for i in range(5)]
    return [(i, t, "en", "s", len(t), 1, "w") for i, t in enumerate(rows)]


def test_patterns_find_unseen_identifiers(spark):
    table = docs(spark, corpus())
    got = {r.doc_id: r for r in pii.find(table).collect()}
    for r in table.collect():
        base = slow_base(r.text)
        assert got[r.doc_id].base == ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        extra = [s for s in got[r.doc_id].spans.split(",") if s.startswith("found")]
        if "[at]" in r.text:
            (kind, a, b), = [s.split(":") for s in extra]
            assert kind == "found_email" and r.text[int(a):int(b)].startswith("user") and r.text[int(a):int(b)].endswith("example")
        else:
            assert not extra  # "the <number>" shares a context with e-mails, but the context is common


def test_awkward_redaction_and_empty(spark):
    rows = [(100 + i, t, None, None, len(t), 1, "w") for i, t in enumerate(TEXTS)]
    table = docs(spark).union(docs(spark, rows))
    got = {r.doc_id: r for r in pii.find(table).collect()}
    assert len(got) == len({r.doc_id for r in table.collect()}) and got[0].spans == "" and got[0].n_email == 0
    clean = pii.redact(table)
    assert clean.columns == table.columns and clean.dtypes == table.dtypes
    before = {r.doc_id: r for r in table.collect()}
    for r in clean.collect():
        if before[r.doc_id].text is None or not got[r.doc_id].spans:
            assert r == before[r.doc_id]
        else:
            assert r.n_chars == len(r.text) and not any(slow_base(r.text)[k] for k in ("email", "ip"))
    assert pii.redacted("+4111111111111111 x", {}) == "[CARD] x" or pii.redacted("+4111111111111111 x", {}).startswith("+[CARD]")
    assert pii.find(docs(spark, [])).count() == 0 and pii.redact(docs(spark, [])).count() == 0


def test_found_identifiers_lead_to_new_patterns(spark):
    ids = [f"user{i:04d}[at]example" for i in range(40)]
    rows = [f"so reach me at u{i}@mail{i}.example.com please" for i in range(40)] + [f"so reach me at {x} please" for x in ids[:16]]
    for g, desk in enumerate(("north", "south", "east", "west", "upper")):  # no seed stands before these words; each context leads to the next
        rows += [f"so call the {desk}desk {x} please" for x in ids[:20 + 4 * g]]
    table = docs(spark, [(i, t, "en", "s", len(t), 1, "w") for i, t in enumerate(rows)])
    got = {r.doc_id: r.spans for r in pii.find(table).collect()}
    for i, t in enumerate(rows[40:], 40):
        a = t.index("user")
        assert got[i] == f"found_email:{a}:{t.index(' please')}", t
