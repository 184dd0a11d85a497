import re
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plainly(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_query_equals_plain_patterns(run, texts):
    rows = run("op9_pii")
    assert len(rows) == len(texts)
    for r in rows:
        base = plainly(texts[r.doc_id] or "")
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == sha256(",".join(joined).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in PATTERNS]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in PATTERNS] == joined


@settings(max_examples=1500, deadline=None)
@given(st.text("ab1209.@-+ %()é\n", max_size=40))
def test_base_spans_equal_plain_patterns(text):
    assert [s[:3] for s in pii.base_spans(text)] == plainly(text)


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    kinds = lambda t: [s[0] for s in pii.spans_of(t, pii.THRESHOLD)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 please") == ["iban"]
    assert "iban" not in kinds("pay to DE88 3704 0044 0532 0130 00 please")
    assert kinds("SSN 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("call 555-123-4567 now") == ["local_phone"] and kinds("code 555-123-4567 now") == []


def test_masking(odd_docs, no_docs):
    rows = pii.mask(odd_docs).collect()
    assert len(rows) == odd_docs.count() and pii.mask(odd_docs).columns == odd_docs.columns
    (text,) = [r.text for r in rows if r.text and "mail" in r.text]
    assert text == "mail <EMAIL>, ip <IP>, card <CARD>, call <PHONE>."
    assert pii.mask(no_docs).count() == 0 and pii.find_spans(no_docs).count() == 0
    assert all(r.spans == [] for r in pii.find_spans(odd_docs.where("text IS NULL OR text = ''")).collect())


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "A1" * 150_000, "@" * 300_000, "1 " * 150_000):
        pii.spans_of(text, pii.THRESHOLD)
