"""Operator 6: forms of entities alone in a text."""

import random
import re

import pytest

from spanframe.llm import pii


@pytest.mark.parametrize("text", ["(Mary Smith)", '"Mary Smith"', "Name:Mary Smith", "/Mary Smith/", "(Mr. Smith)", "Re:Mrs Smith", "»Frau Müller«", "(Анна Петрова)", "[Μαρία Παππά]", "Mary Smith"])
def test_names_next_to_marks(text):
    found = pii.entities(text)
    assert found and all(k == "last" or k.startswith("first") for _, _, k in found)
    new, n = pii.Replacer(b"key")(text)
    assert n == len(found) and all(text[a:b] not in new for a, b, _ in found)


def test_no_names_without_triggers():
    assert pii.entities("(Some Smith) and Mary, or Maryland Smith") == []


PHONES = (
    "+14155552671", "+33612345678", "+44 7911 123456", "+49 151 12345678", "415 555 2671", "(415) 555 2671", "+1 (017) 555-7713", "+44 (0)20 7946 0958", "+33 (0) 6 12 34 56 78", "+49-30-1234567",
    "+1.415.555.2671", "415-555-2671", "415.555.2671", "(415) 555-2671", "1-415-555-2671", "+390612345678", "+12 34 56",
)


@pytest.mark.parametrize("number", PHONES)
@pytest.mark.parametrize("form", ["{}", "Call {} today.", "({})", "tel:{},", "at {}."])
def test_phone_formats(number, form):
    text = form.format(number)
    at = text.index(number)
    assert pii.entities(text) == [(at, at + len(number), "phone")]
    new = pii.Replacer(b"key")(text)[0]
    assert len(new) == len(text) and new != text and [c.isdigit() for c in new] == [c.isdigit() for c in text]
    assert new[:at] == text[:at] and new[at + len(number) :] == text[at + len(number) :]


@pytest.mark.parametrize("text", ["+1234567", "+12345678901234567", "a+14155552671", "1 234 567 890", "12 + 34567 = 34579", "2024-01-02", "+5 and 12345678"])
def test_other_numbers_are_no_phones(text):
    assert not any(kind == "phone" for _, _, kind in pii.entities(text))


def test_formats_of_one_number_agree():
    digits = {"".join(c for c in pii.Replacer(b"key")(t)[0] if c.isdigit()) for t in ("+14155552671", "+1 415 555 2671", "+1 (415) 555-2671")}
    assert len(digits) == 1 and digits.pop().startswith("1")


def planted():
    """Texts of many people, numbers and addresses, each named in more than one text and format."""
    rng = random.Random(9)
    people = [(rng.choice(["Mr.", "Mrs."]), "".join(rng.choice("bcdfglmn") + rng.choice("aeiou") for _ in range(4)).capitalize()) for _ in range(150)]
    rows = []
    for i, (title, name) in enumerate(people):
        phone, card = f"{rng.randrange(10**10):010d}", f"4{rng.randrange(10**14):014d}"
        card += str(pii.luhn(card))
        mail, address, pin = f"{rng.choice('abcdef')}@mail{i % 3}.example.org", f"10.{i % 40}.0.{i % 7}", f"{100 * i % 700:03d}-0{i % 5}-{i % 9:04d}"
        rows.append((f"{title} {name} ({mail}) has +1{phone} and card {card}, {address}, {pin}. password=12{i:04d}", (i, None, 7)[i % 3]))
        rows.append((f"{title} {name.upper()}, +1 {phone[:3]} {phone[3:6]} {phone[6:]}; {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} Mary Smith", i))
    return rows + [("clean", 1), (None, 2), ("", 3)]


def test_all_documents_against_plain_python(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, n) for n, (t, i) in enumerate(rows)], "doc_id long, text string, n int").repartition(5)
    got = sorted(pii.replaced(docs, b"key", "n_entities").collect(), key=lambda r: r["n"])
    own = set().union(*(pii.own_entities(t or "") for t, _ in rows))
    made = pii.assign(b"key", own)
    want = [(i, t and pii.Replacer(b"key", made)(t)[0], n, len(pii.entities(t or ""))) for n, (t, i) in enumerate(rows)]
    assert [tuple(r) for r in got] == want
    # Mentions side by side: one replacement for an entity in all documents, another one for each entity, none of them an original.
    met = {}
    for (text, _), r in zip(rows, got):
        for (a, b, kind), (c, d, other) in zip(pii.entities(text or ""), spans(text or "", r["text"] or "")):
            met.setdefault((kind.partition(":")[0], pii.canonical(kind, text[a:b])), set()).add(pii.canonical(kind, r["text"][c:d]))
    assert len(met) > 500 and all(len(x) == 1 for x in met.values())
    new = [next(iter(x)) for x in met.values()]
    assert len(set(new)) == len(new) and not set(new) & {v for _, v in own}


def spans(text, new):
    """The places of the replacements in ``new``: all but names and addresses of machines keep their length here."""
    found, out, at = pii.entities(text), [], 0
    for k, (a, b, kind) in enumerate(found):
        start = at + a - (found[k - 1][1] if k else 0)
        own = {"ip": r"[\d.]+", "last": r"\w+", "first": r"\w+"}.get(kind.partition(":")[0])
        at = re.compile(own).match(new, start).end() if own else start + b - a
        out.append((start, at, kind))
    return out


def test_full_formats_get_longer():
    own = {("secret", f"{i:02d}") for i in range(100)} | {("email", f"{c}@a.example.org") for c in "abcdefghijklmnopqrstuvwxyz"}
    made = pii.assign(b"key", own)
    assert len(set(made.values())) == len(own) and not set(made.values()) & {v for _, v in own}
