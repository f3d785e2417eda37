import hashlib
import random
import re
import time

from tracewright.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def plain_spans(text):
    digits = lambda s: sum(c.isdigit() for c in s)
    passes = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= digits(s) <= 19 and plain_luhn(s),
        "phone": lambda s: 8 <= digits(s) <= 15,
    }
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes[k](m.group())]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a.b", "@", "x-1", ".", "c.de", " ", "+", "1", "23", "4111 1111 1111 1111", "4111-1111-1111-1111", "255", "256", ".0.0.1", "10.2.3.4", "(", ")", "-", "%", "_", "é", "+1 (212) 555-0100", "٣", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_account_numbers_need_their_checksum_and_identity_numbers_their_context():
    good, bad = "IBAN DE89 3704 0044 0532 0130 00 here", "IBAN DE88 3704 0044 0532 0130 00 here"
    assert [(s[0], good[s[1] : s[2]]) for s in pii.find_spans(good) if s[0] == "iban"] == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert not [s for s in pii.find_spans(bad) if s[0] == "iban"]
    assert [s[0] for s in pii.find_spans("social security 123-45-6789")] == ["ssn"]
    assert pii.find_spans("part number 123-45-6789") == []
    near, far = pii.find_spans("mail me: a@b.cc")[0], pii.find_spans("say: a@b.cc")[0]
    assert near[3] > far[3]
    assert pii.redacted("mail a@b.cc now", pii.find_spans("mail a@b.cc now")) == "mail [EMAIL] now"


def test_digests(spark, documents):
    rows = [(1, "é a@b.cc and 10.0.0.1, 4111 1111 1111 1111; +1 (212) 555-0100"), (2, None), (3, ""), (1, "clean"), (None, "a@b.cc")]
    found = sorted(pii.digests(pii.scan(documents(rows))).collect(), key=lambda r: (str(r.doc_id), r.n_email))
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found] == [(1, 0, 0, 0, 0), (1, 1, 1, 1, 1), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (None, 1, 0, 0, 0)]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(rows[0][1]))
    assert found[1].spans == joined
    assert found[1].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() == pii.text_digest(rows[0][1])
    assert found[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    clash = documents(rows).selectExpr("*", "1 AS pii_spans", "2 AS spans", "3 AS score")
    assert pii.scan(clash, into="other").columns == [*clash.columns, "other"]
    assert pii.scan(documents([])).count() == 0


def test_long_runs_take_time_in_proportion():
    start = time.perf_counter()
    for unit in ("1", "a", "1.", "@", "a@", "+1", "A1", "1-", "12 "):
        pii.find_spans(unit * 200_000)
    assert time.perf_counter() - start < 20
