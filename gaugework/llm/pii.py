"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

E-mail and IP addresses, card and phone numbers that pass their checks always stay. Others are added where their score
reaches ``least``, which words nearby raise (what such data is called) or lower (what else such numbers are), in four languages: bank account
numbers of a registered length (mod 97), which need no word for it; those of other lengths, social security numbers,
phone numbers without a country and 13-digit card numbers (Luhn), which do.

Edge cases: a null text is an empty one; texts of any length are read whole; repeated rows, and ties of doc_id, each get a
row; where proposals overlap, base ones go first, then the longer of the added; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gaugework.llm.common import small_batches, texts
from gaugework.llm.spans import Covered, Span, in_order, joined, sha256

#: The kinds in their order, the patterns, the score of a confirmed span, and the words that raise it.
KINDS = ("email", "ip", "card", "phone", "iban", "account", "ssn", "local_phone", "short_card")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
#: The length of an account number by its country, as registered.
IBAN_LENGTHS = {c: int(n) for c, n in re.findall(r"([A-Z]{2})([0-9]{2})", (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 "
    "GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 "
    "MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 "
    "UA29 VA22 VG24 XK20 YE30"
))}
IBAN_OF = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![A-Za-z0-9+(.,-])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})(?:[\x20./-]?[0-9]{2,4}){2,4}(?![A-Za-z0-9]|[.,][0-9])")
SHORT_CARD = re.compile(r"(?<![0-9-])[0-9]{4}([\x20-]?)[0-9]{3}\1[0-9]{3}\1[0-9]{3}(?![0-9]|[\x20-][0-9])")
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "account": 0.4, "ssn": 0.4, "local_phone": 0.4, "short_card": 0.4}
#: What such data is called, in English, German, French and Spanish.
PHONE_WORDS = (
    "phone telephone call tel mobile fax telefon telefonnummer rufnummer anruf anrufen handy mobil mobilnummer tél téléphone téléphoner "
    "appeler appelez télécopie teléfono telefono llamar llame llamada móvil celular"
)
CARD_WORDS = "card visa credit payment mastercard karte kreditkarte kartennummer zahlung carte bancaire crédit paiement tarjeta crédito pago"
BANK_WORDS = (
    "iban account bank transfer konto kontonummer bankverbindung überweisung überweisen compte banque bancaire virement rib cuenta banco "
    "bancaria transferencia"
)
PERSON_WORDS = (
    "ssn social security insurance sozialversicherung sozialversicherungsnummer versicherungsnummer sécurité sociale assurance seguridad "
    "seguro nss"
)
CONTEXT = {
    kind: frozenset(words.split())
    for kind, words in {
        "email": "mail email contact write kontakt schreiben adresse courriel écrire écrivez contactez correo escribir escriba contacto",
        "ip": "ip address server host adresse rechner serveur hôte dirección servidor",
        "card": CARD_WORDS, "phone": PHONE_WORDS, "iban": BANK_WORDS, "account": BANK_WORDS, "ssn": PERSON_WORDS,
        "local_phone": PHONE_WORDS, "short_card": CARD_WORDS
    }.items()
}
#: Words that speak against personal data, in the same languages: each takes away twice what a word of the context gives.
AGAINST = frozenset((
    "example sample isbn order invoice tracking serial version beispiel muster bestellung bestellnummer rechnung rechnungsnummer sendung "
    "sendungsnummer seriennummer exemple échantillon commande facture suivi série ejemplo muestra pedido factura seguimiento serie versión"
).split())
WORD = re.compile(r"[^\W\d_]+")

def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def accounts(text: str) -> list[Span]:
    """Bank account numbers that pass mod 97: iban of the length that the country fixes, account as far as their characters go."""
    found, at = [], 0
    while start := IBAN_START.search(text, at):
        at = start.end()
        of = IBAN_OF.get(IBAN_LENGTHS.get(start[0][:2]))
        for kind, m in (("iban", of and of.match(text, start.start())), ("account", IBAN.match(text, start.start()))):
            if m and mod97(m[0].replace(" ", "")):
                found.append((kind, m.start(), at := m.end()))
                break
    return found


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Around every @: the local part reaches back as far as its characters do, but not into the match before."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, last := m.end()))
        at = text.find("@", m.end() if m else at + 1)
    return found


def base_spans(text: str) -> list[Span]:
    found = emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def context(text: str, span: Span, reach: int = 40) -> float:
    """What whole words within ``reach`` characters, those of the span left out, add to its score."""
    kind, start, end = span
    before, after = max(0, start - reach), min(len(text), end + reach)
    while before and start - before < 2 * reach and text[before - 1].isalpha() and text[before].isalpha():
        before -= 1  # a word is taken whole
    while after < len(text) and after - end < 2 * reach and text[after - 1].isalpha() and text[after].isalpha():
        after += 1
    near = unicodedata.normalize("NFC", text[before:start] + " " + text[end:after]).lower()
    words = set(WORD.findall(near))
    return 0.1 * len(words & CONTEXT[kind]) - 0.2 * len(words & AGAINST)


def score(text: str, span: Span, reach: int = 40) -> float:
    return max(0.0, min(1.0, SCORES[span[0]] + context(text, span, reach)))


def more_spans(text: str, base: list[Span], least: float) -> list[Span]:
    found = accounts(text)
    found += [("ssn", *m.span()) for m in SSN.finditer(text)]
    found += [("local_phone", *m.span()) for m in LOCAL_PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 12]
    found += [("short_card", *m.span()) for m in SHORT_CARD.finditer(text) if luhn(digits_of(m[0]))]
    if not found:
        return []
    of_all, but_cards, taken, kept = Covered(base), Covered([b for b in base if b[0] != "card"]), Covered(), []
    for s in sorted(found, key=lambda s: (s[1] - s[2], s[1], KINDS.index(s[0]))):
        around = but_cards if s[0] in ("iban", "account", "ssn") else of_all  # their digits alone can pass for a card's
        if not around.meets(*s[1:]) and not taken.meets(*s[1:]) and score(text, s) >= least:
            taken.add(*s[1:])
            kept.append(s)
    return kept


def find_pii(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (of the spans, in their order), moved: what words
    nearby added to each of these or took away."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores", "moved"]
    types = [pa.int64()] * 5 + [pa.string()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = base_spans(text)
                spans = base + more_spans(text, base, least)
                count = [sum(k == kind for k, *_ in base) for kind in KINDS[:4]]
                scores = ",".join(f"{score(text, s):.2f}" for s in in_order(spans, KINDS))
                moved = ",".join(f"{context(text, s):+.1f}" for s in in_order(spans, KINDS))
                out.append((doc_id, *count, sha256(joined(base, KINDS)), joined(spans, KINDS), scores, moved))
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    return texts(docs, "doc_id").mapInArrow(
        run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, moved string"
    )
