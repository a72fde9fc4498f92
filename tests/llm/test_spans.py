import hashlib
import random
import re
import time

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugework.llm import pii, secrets
from gaugework.llm.spans import Covered, joined, replaced

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, spans int, n_hex string"


def brute_secrets(text):
    out = []
    assign = re.compile(r"(?a:(?i:(password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for m in assign.finditer(text):
        if len(m[2]) >= 6 and m[1].isascii():
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))


def brute_pii(text):
    out, digits = [], lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        total = 0
        for i, x in enumerate(d[::-1]):
            x = x * 2 if i % 2 else x
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    out += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text
    ) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(
        r"[0-9]([\x20-]?[0-9])+", text
    ) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))


@settings(max_examples=1500, deadline=None)
@given(st.lists(
    st.sampled_from([
        "password", "PassWd", "secret", "token", "api_key", "APIKEY", "toKen", "İ", '"', "'", " ", ":", "=", "abc", "x9", "AKIA", "ABCDEFGH12345678",
        "0123456789abcdef", "deadbeef", "é", "ſecret", "\n", "-", "_"
    ]),
    max_size=14
).map("".join))
def test_secret_base(text):
    assert joined(secrets.base_spans(text), secrets.KINDS) == brute_secrets(text)


@settings(max_examples=1500, deadline=None)
@given(st.lists(
    st.sampled_from([
        "@", "a", "b.c", "_d", ".", "-", "%", "+", "1", "255", "256", "4111 1111 1111 1111", "00", "(", ")", " ", "12.34", "é", "+49 30 1234567",
        "x@y.z", "\n"
    ]),
    max_size=14
).map("".join))
def test_pii_base(text):
    assert joined(pii.base_spans(text), pii.KINDS) == brute_pii(text)


def test_random_strings():
    rng = random.Random(2)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=36))
    plain = "d41d8cd98f00b204e9800998ecf8427e 123e4567-e89b-12d3-a456-426614174000 my_long_variable_name_2024 internationalization2 12345678901234567890 https://example.com/a/long/path/index"
    text = f"{plain} {key} end"
    base, more = secrets.all_spans(text, RANKS)
    assert [text[a:z] for _, a, z in more] == [key] and [text[a:z] for _, a, z in base] == [plain.split()[0]]
    assert replaced(text, base + more, "[X]") == f"[X] {plain.split(' ', 1)[1]} [X] end"


def test_scores():
    text = "bank account DE89 3704 0044 0532 0130 00, not GB00 WEST 1234 5698 7654 32; SSN 123-45-6789 but plain 123-45-6789"
    base = pii.base_spans(text)
    more = pii.more_spans(text, base, 0.5)
    assert [k for k, *_ in more] == ["iban", "ssn"] or [k for k, *_ in more] == ["iban", "ssn", "ssn"]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def check(spark, docs, rows):
    for find, brute in ((secrets.find_secrets(docs, RANKS), brute_secrets), (pii.find_pii(docs), brute_pii)):
        got = {}
        for r in find.collect():
            got.setdefault(r.doc_id, []).append(r)
        assert sum(map(len, got.values())) == len(rows)
        for doc_id, text in rows:
            want = brute(text or "")
            for r in got[doc_id]:
                assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
                assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
                for name in ("assign", "access", "hex", "email", "ip", "card", "phone"):
                    if f"n_{name}" in r:
                        assert r[f"n_{name}"] == want.count(f"{name}:")


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])
    clean = secrets.redact_secrets(docs, RANKS)
    assert clean.columns == docs.columns
    assert all(brute_secrets(r.text) == "" and r.n_chars == len(r.text) for r in clean.collect())


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, "token = 'abcdef123'"), (3, "token = 'abcdef123'"), (4, "a@b.c " * 30_000), (5, "1" * 50_000),
        (6, "a" * 100_000 + " é +1 (499) 555-6503")
    ]
    check(spark, spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), rows)
    none = spark.createDataFrame([], SCHEMA)
    assert secrets.find_secrets(none, RANKS).count() == pii.find_pii(none).count() == secrets.redact_secrets(none, RANKS).count() == 0


def test_context_decides():
    """The same number with words that speak for it, none, or some against it."""
    for kind, number, word, against in (
        ("local_phone", "(0211) 55 12 34", "call", "order"),
        ("local_phone", "030/123 4567", "tel", "serial"),
        ("short_card", "4222 222 222 222", "visa", "invoice"),
        ("ssn", "078-05-1120", "ssn", "isbn"),
        ("account", "ZZ33 1234 5678 9012 345", "bank", "tracking"),
    ):
        kinds = lambda text: [k for k, *_ in pii.more_spans(text, pii.base_spans(text), 0.5)]
        assert kinds(f"{word} {number} now") == [kind], (kind, number)
        assert kinds(f"so {number} now") == [] == kinds(f"{word} {number} {against}")
    assert pii.score(
        "iban DE89370400440532013000 order", ("iban", 5, 27)
    ) == 0.8 and pii.more_spans("order DE89370400440532013000 isbn", [], 0.5) == [("iban", 6, 28)]


def test_context_in_each_language(spark):
    """The same proposal with a word for it, none, or one for it and one against it, in each language, through the whole operator."""
    cases = (
        ("local_phone", "030/123 4567", "please phone", "order phone"), ("local_phone", "030/123 4567", "Telefonnummer:", "Bestellung, Telefon"),
        ("local_phone", "01 42 34 56 78", "Téléphone :", "Commande, téléphone"), ("local_phone", "01 42 34 56 78", "llame al teléfono", "pedido, teléfono"),
        ("short_card", "4222 222 222 222", "Kreditkarte", "Rechnung, Karte"), ("short_card", "4222 222 222 222", "carte bancaire", "facture, carte"),
        ("short_card", "4222 222 222 222", "la tarjeta", "factura, tarjeta"), ("account", "ZZ33 1234 5678 9012 345", "Kontonummer", "Muster, Konto"),
        ("account", "ZZ33 1234 5678 9012 345", "compte", "exemple, compte"), ("account", "ZZ33 1234 5678 9012 345", "cuenta", "ejemplo, cuenta"),
        ("ssn", "078-05-1120", "Versicherungsnummer", "Seriennummer, Versicherungsnummer"), ("ssn", "078-05-1120", "sécurité sociale", "série, sociale"),
        ("ssn", "078-05-1120", "seguridad", "serie, seguridad"), ("local_phone", "01 42 34 56 78", "te\u0301le\u0301phone", "commande, tél"),
    )
    rows = [(k, text) for k, (_, n, word, bad) in enumerate(cases) for text in (f"{word} {n} {'x' * 50}", f"{'x' * 50} {n} so", f"{bad} {n}")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, (_, t) in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for k, (kind, number, word, _) in enumerate(cases):
        found, none, refused = (got[3 * k + j] for j in range(3))
        assert found.spans == f"{kind}:{len(word) + 1}:{len(word) + 1 + len(number)}" and found.moved.startswith("+0."), cases[k]
        assert none.spans == refused.spans == "", cases[k]


def test_context_moves_base_scores_alone():
    text = "Kontakt: a@b.cd, und nach einigen Worten ein Muster: e@f.gh"
    base = pii.base_spans(text)
    assert [round(pii.context(text, s, reach=9), 1) for s in base] == [0.1, -0.2] and [k for k, *_ in base] == ["email"] * 2


def test_digits_within_identifiers_are_no_phones():
    assert pii.more_spans("phone a01234567890b, phone x0123 456 789", [], 0.5) == []


def test_covered():
    rng = random.Random(2)
    for _ in range(200):
        spans = [("k", a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        own, a = Covered(spans), rng.randint(0, 60)
        z = a + rng.randint(1, 9)
        assert own.meets(a, z) == any(x < z and a < y for _, x, y in spans)
        if not own.meets(a, z):
            own.add(a, z)
            assert own.meets(a, a + 1) and own.starts == sorted(own.starts)


def test_many_spans_in_one_text():
    began = time.process_time()
    text = "ssn 078-05-1120 a@b.cd " * 20_000
    assert len(pii.more_spans(text, pii.base_spans(text), 0.5)) == 20_000
    assert time.process_time() - began < 10
