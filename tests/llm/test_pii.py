import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from patchmetrics.llm import pii

from .data import SF, empty, odd, odd_rows, small

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit_ok(digits):
    doubled = [sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                  "card": 13 <= len(digits) <= 19 and check_digit_ok(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ0129.@+-() _%\né", max_size=60))
def test_base_spans_are_the_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "+1 (555) 555-1234", "10.0.0.256", "1.2.3.4.5",
                                 "a@b.co", "@", ".", " ", "-", "+", "+49 30 1234567", "x"]), max_size=8))
def test_base_spans_on_glued_parts(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute(text)


def test_zero_padded_ip_parts_of_any_length():
    for text, valid in (("0" * 19 + "1.2.3.4", True), ("1.2.3." + "0" * 6000 + "255", True), ("0" * 19 + "256.2.3.4", False),
                        ("0" * 30 + ".0.0.0", True), ("1" * 6000 + ".2.3.4", False)):
        assert (("ip", 0, len(text)) in pii.base_spans(text)) == valid


def test_long_runs_are_linear():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "(" * 200_000):
        assert isinstance(pii.candidates(run), tuple)


def test_query_rows(spark):
    docs = small()
    got = {r["doc_id"]: r for r in pii.op1_personal_data(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc, text in zip(docs["doc_id"], docs["text"]):
        spans, r = brute(text or ""), got[doc]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_em_ranks_labelers_and_model_adds_spans_beside_base_ones():
    texts = ["call +1 (663) 555-6869 now"] * 20 + ["card 4111111111111111 4111111111111111 end"] * 5 + \
        ["version 1234 5678 9012 3456"] * 10 + ["order 1234567890123"] * 5
    counts = {}
    for t in texts:
        _, base, more = pii.candidates(t)
        for _, k in base + more:
            counts[k] = counts.get(k, 0) + 1
    prob, reliability = pii.expectation_maximisation(counts)
    assert all(0 <= p <= 1 for p in prob.values()) and reliability["card"].shape == (2, 5, 3)
    weights = pii.train_classifier(counts, prob)
    base, spans = pii.find_spans(texts[20], weights)
    assert base == [] and [s[0] for s in spans] == ["card", "card"]
    assert pii.find_spans("version 1234 5678 9012 3456", weights)[1] == []
    assert pii.redact_text("call +1 (663) 555-6869 now", weights) == "call [PHONE] now"
    assert pii.redact_text(None, weights) is None


def test_odd_rows_and_empty_table(spark):
    model = pii.train(odd(spark))
    rows = pii.personal_data(odd(spark), model).collect()
    assert len(rows) == len(odd_rows())
    assert {r["n_email"] for r in rows} == {0, 6}
    assert pii.personal_data(empty(spark), pii.train(empty(spark))).count() == 0
    clean = pii.redacted(odd(spark))
    assert clean.columns == odd(spark).columns and clean.count() == len(rows)
    assert not clean.where("text like '%a@b.co%'").count()
