import random

import brute
import fixtures
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attriva.llm import pii


def base(text):
    return [s for s in pii.spans(text) if s[0] in pii.BASE]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0123456789.@+-() ax_%é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == brute.pii_base(text)


@pytest.mark.parametrize("seed", range(3))
def test_dense_numbers(seed):
    rng = random.Random(seed)
    for _ in range(300):
        text = "".join(rng.choice(["1", "23", "4.", ".5", "-", " ", "+", "4111 1111 1111 1111", "10.0.0.1", "a@b.co", "@", "(0)"]) for _ in range(rng.randrange(25)))
        assert base(text) == brute.pii_base(text)


def test_examples():
    text = "Mail a.b+c@x-y.example.org or http://u@h.io/x?y=1. IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678; +49 (30) 1234567; 4111-1111-1111-1111"
    kinds = {k: text[a:b] for k, a, b in pii.spans(text)}
    assert kinds["email"] == "a.b+c@x-y.example.org" or "u@h.io" in kinds["email"]
    assert kinds["iban"] == "DE89 3704 0044 0532 0130 00" and kinds["account"] == "12345678" and kinds["url"].startswith("http://")
    assert kinds["card"] == "4111-1111-1111-1111" and kinds["phone"] == "+49 (30) 1234567"
    clean = pii.redacted(text)
    assert "4111" not in clean and "@x-y" not in clean and "[CARD]" in clean


def test_table(spark):
    df = fixtures.frame(spark, [(1, None, None, None, None, None, None, None), (2, "a@b.co", "en", "s", 6, 1, "t", "r"), (None, "", "en", "s", 0, 1, "t", "r"), (2, "a@b.co", "en", "s", 6, 1, "t", "r")])
    got = pii.span_digest(pii.find_pii(df)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.spans) for r in got) == [(0, 0, ""), (1, 0, ""), (2, 1, "email:0:6"), (2, 1, "email:0:6")]
    out = pii.redact(df)
    assert out.columns == df.columns and {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, None, None), (2, "[EMAIL]", 7), (None, "", 0)}
    assert pii.redact(fixtures.empty(spark)).collect() == []


def test_long_runs_take_linear_time():
    assert base("1." * 200_000) == brute.pii_base("1." * 200_000)
    assert base("a" * 300_000 + "@") == []


PLANTED = (
    ("secret", 'token = "', "04dbebab91ab85687d33eeaaf9ac699e1188f962", '"'), ("secret", "API_KEY: ", "sk-9fK2mZ81qPw0", " "), ("secret", "access_token='", "aB3aB3aB3aB3", "'"), ("iban", "IBAN: ", "DE89 3704 0044 0532 0130 00", ","),
    ("account", "account no. ", "12345678", ";"), ("account", "Passport ", "X1234567", "."), ("url", "see ", "https://h.example/x?y=1", ")"),
)


def test_added_spans_in_whole_documents():
    rng = random.Random(6)
    kinds = set(pii.ADDED)
    for _, text, *_ in fixtures.rows():
        assert not [s for s in pii.spans(text) if s[0] in kinds]
        out, want, at = [], [], 0
        for word in (text or "").split(" "):
            if rng.random() < 0.02 or not want:
                kind, before, value, after = rng.choice(PLANTED)
                piece = f"{before}{value}{after}"
                want.append((kind, at + len(before), at + len(before) + len(value)))
                out.append(piece)
                at += len(piece) + 1
            out.append(word)
            at += len(word) + 1
        got = [s for s in pii.spans(" ".join(out)) if s[0] in kinds]
        assert sorted(got) == sorted(want)


def test_what_is_no_secret():
    for text in ("token = next", "the token is 04dbebab91ab85687d33", "tokens: 0123456789ab", "broken: 0123456789abcdef", "password = aaaaaaaaaaaaaa", "token = 123456789012", "mytoken=abc123abc123"):
        assert not [s for s in pii.spans(text) if s[0] == "secret"], text
