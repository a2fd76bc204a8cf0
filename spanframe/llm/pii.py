"""Operator 6: personal data and secrets replaced by surrogates.

Detected entities get keyed replacements of the same kind and format: digits stay digits, check digits stay valid, names keep gender, script and
case. An entity is its kind and one spelling (digits without separators, names in lower case). The distinct entities of all documents form a
table, where each takes the first of its keyed candidates that is no entity and that no other one has taken; of those that meet at a candidate the
least takes it. So mentions of one entity agree in all documents, different entities stay different, and no replacement is an original. The
table is joined back to the documents with entities alone; the others are not shuffled.

Defined results: a null text stays null, an empty or clean one stays as it is; rows with a null or repeated doc_id are treated each; an empty table
gives no rows; the other columns, whatever their names, stay as they are. Where a format has hardly a free value left (short numbers), later candidates are
longer than the original by a few digits.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import stored

#: Candidates of the entity's own length, tried before longer ones.
TRIES = 12

# Common given names by script and gender, family names by script, and titles by gender.
FIRST = {
    ("latin", "f"): "Mary Anna Emma Laura Julia Sarah Linda Susan Claire Camille Sophie Marie Hannah Lena Petra Ursula Carmen Lucia Elena Isabel".split(),
    ("latin", "m"): "James John Robert Michael David Thomas Daniel Peter Paul Martin Pierre Louis Jacques Hans Klaus Jürgen Carlos Javier Miguel Pablo".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(), ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Николай Михаил Андрей Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Σοφία Κατερίνα Άννα".split(), ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Ιωάννης".split(),
}
LAST = {
    "latin": "Smith Johnson Brown Taylor Wilson Clark Walker Hall Müller Schmidt Weber Wagner Becker Martin Bernard Dubois Moreau Garcia Lopez Torres Ruiz Navarro".split(),
    "cyrillic": "Иванов Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков".split(), "greek": "Παπαδόπουλος Γεωργίου Νικολάου Ιωάννου Δημητρίου".split(),
}
TITLES = {
    "m": "Mr Mr. Sir Herr Herrn Señor Sr. Don Monsieur Господин Κύριος".split(), "f": "Mrs Mrs. Ms Ms. Miss Frau Señora Sra. Doña Madame Mme Госпожа Κυρία".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne no ra re ro sa se so ta te to va vo".split(),
    "cyrillic": "ба бо ва во да до ка ко ла ло ма мо на но ра ро са со та то".split(), "greek": "βα βο γα γο δα δο κα κο λα λο μα μο να νο ρα ρο σα σο τα το".split(),
}

_GENDER = {n: (s, g) for (s, g), ns in FIRST.items() for n in ns}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}
#: A name needs one of these as a whole word; titles without their full stop.
_TRIGGERS = frozenset(_GENDER) | frozenset(t.rstrip(".") for t in _TITLE)
_CAPITALISED = re.compile(r"[A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ]\w*")
_CAPITAL = r"[A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ][\w'’-]+"
_NAME = re.compile(
    rf"(?<!\w)(?:(?P<title>{'|'.join(sorted(map(re.escape, _TITLE), key=len, reverse=True))})\s+(?P<named>{_CAPITAL}(?:[ ]{_CAPITAL})?)"
    rf"|(?P<first>{'|'.join(sorted(_GENDER, key=len, reverse=True))})[ ](?P<last>{_CAPITAL}))(?!\w)"
)
_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]++@(?:[\w-]+\.)+\w{2,}")
_ASSIGNED = re.compile(r"(?i)(?<!\w)(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s*[=:]\s*[\"']?([^\s\"',;]{6,})")
# A plus and 8 to 15 digits, each after a separator or none; a code in brackets near the front; groups of two to four digits, also fewer in all; national forms.
_PHONE = re.compile(
    r"(?<![\w+])\+(?:\d(?:[ .\xa0/–-]?\d){7,14}(?!\w)|(?:\d{1,3}[ .\xa0/-]?\(\d{1,4}\)|\(\d{1,3}\))(?:[ .\xa0/–-]{0,2}\d){4,11}(?!\w)"
    r"|\d{1,3}[ .-]?\(?\d{1,4}\)?[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?![\w-]))"
    r"|(?<!\w)\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?![\w-])|(?<![\w.-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"
)
#: The country code at the front of an international number.
_COUNTRY = re.compile(r"\+\(?(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})")
_PATTERNS = (
    ("secret", re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("phone", _PHONE),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")),
    ("card", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")),
)
_DIGIT = re.compile(r"\d")


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` and it valid."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _fits(kind: str, value: str) -> bool:
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1])
    if kind == "ip":
        return all(int(x) < 256 for x in value.split("."))
    return kind != "iban" or mod97(value.replace(" ", "")) == 1


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, without overlaps; earlier detectors win. Names give one entity for each part."""
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= a or start >= b for a, b, _ in found):
            found.append((start, end, kind))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            add(m.start(1), m.end(1), "secret")
    if _DIGIT.search(text):
        for kind, pattern in _PATTERNS:
            for m in pattern.finditer(text):
                if _fits(kind, m.group()):
                    add(m.start(), m.end(), kind)
    if not _TRIGGERS.isdisjoint(_CAPITALISED.findall(text)):
        for m in _NAME.finditer(text):
            gender = _TITLE[m["title"]] if m["title"] else _GENDER[m["first"]][1]
            start = m.start("named") if m["title"] else m.start("first")
            words = text[start : m.end()].split(" ")
            for k, word in enumerate(words):
                given = word in _GENDER or (k == 0 and len(words) > 1)
                add(start, start + len(word), f"first:{gender}" if given else "last")
                start += len(word) + 1
    return sorted(found)


@lru_cache(1 << 16)
def _stream(key: bytes, what: str, size: int) -> bytes:
    out = b""
    while len(out) < size:
        out += hmac.new(key, f"{len(out)}\0{what}".encode(), hashlib.sha256).digest()
    return out[:size]


def permuted(key: bytes, digits: str, tweak: str) -> str:
    """A keyed permutation of the digit strings of one length: a Feistel network of ten rounds over two halves."""
    if len(digits) < 2:
        return str((int(digits or 0) + 1 + _stream(key, tweak, 1)[0] % 9) % 10) if digits else ""
    left, right = digits[: len(digits) // 2], digits[len(digits) // 2 :]
    for k in range(10):
        size = 10 ** len(left)
        moved = (int(left) + int.from_bytes(_stream(key, f"{tweak}\0{k}\0{len(digits)}\0{right}", 16))) % size
        left, right = right, str(moved).zfill(len(left))
    return left + right


def _digits_in(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _shaped(key: bytes, value: str, tweak: str) -> str:
    """Letters for letters and digits for digits, case kept, other characters as they are."""
    stream = _stream(key, f"{tweak}\0{value}", 2 * len(value))
    hexes = len(value) >= 8 and not value.isdigit() and all(c in "0123456789abcdef" for c in value.lower())
    out = []
    for i, c in enumerate(value):
        n = int.from_bytes(stream[2 * i : 2 * i + 2])
        if hexes and c.isalnum():
            d = "0123456789abcdef"[n % 16]
            out.append(d.upper() if c.isupper() else d)
        elif c.isdigit():
            out.append("0123456789"[n % 10])
        elif c.isalpha():
            d = "abcdefghijklmnopqrstuvwxyz"[n % 26]
            out.append(d.upper() if c.isupper() else d)
        else:
            out.append(c)
    return "".join(out)


def _script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin"


def canonical(kind: str, value: str) -> str:
    """The one spelling of an entity, whatever the separators or the case of a mention."""
    if kind in ("phone", "ssn", "card"):
        return "+" * value.startswith("+") + "".join(str(int(c)) for c in value if c.isdecimal())
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind == "last" or kind.startswith("first") else value


def candidate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The replacement of an entity (in its one spelling) at an attempt: same kind, format and, for names, gender and script."""
    tweak = f"{kind}\0{attempt}"
    more = "".join(str(b % 10) for b in _stream(key, f"{tweak}\0more\0{value}", 32)) if attempt >= TRIES else ""
    more = more[: attempt - TRIES + 1]
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_shaped(key, local, tweak + host)}{more}@{_shaped(key, host, 'domain')}.{top}"
    if kind == "phone":
        keep = _COUNTRY.match(value)
        at = keep.end() if keep else 0
        return value[:at] + permuted(key, value[at:], tweak + value[:at]) + more
    if kind == "ssn":
        return permuted(key, value, tweak) + more
    if kind == "card":
        body = value[0] + permuted(key, value[1:-1], tweak + value[0]) + more
        return body + str(luhn(body))
    if kind == "ip":
        return ".".join(str(b % 254 + 1) for b in _stream(key, f"{tweak}\0{value}", 4)) + more
    if kind == "iban":
        body = _shaped(key, value[4:], tweak) + more
        return f"{value[:2]}{98 - mod97(value[:2] + '00' + body):02d}{body}"
    if kind == "secret":
        keep = 4 if value[:4] in ("AKIA", "ASIA") else 0
        return value[:keep] + _shaped(key, value[keep:], tweak) + more
    script = _script(value)
    if attempt == 0:
        names = LAST[script] if kind == "last" else FIRST[script, kind[-1]]
        out = names[int.from_bytes(_stream(key, f"{kind}\0{value}", 8)) % len(names)].lower()
        if kind == "last" and script == "cyrillic" and value.endswith(("ова", "ева", "ёва", "ина")):
            out += "а"  # the feminine form
        return out
    parts = SYLLABLES[script]  # more of them at each attempt, so there are always enough names
    return "".join(parts[b % len(parts)] for b in _stream(key, f"{tweak}\0{value}", attempt + 2))


def dressed(kind: str, mention: str, new: str) -> str:
    """A replacement in the separators or the case of a mention."""
    if kind in ("phone", "ssn", "card"):
        digits = new.lstrip("+")
        n = sum(c.isdecimal() for c in mention)
        return _digits_in(mention, digits) + digits[n:]
    if kind == "iban":
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in mention) + "".join(it)
    if kind == "last" or kind.startswith("first"):
        return new.upper() if mention.isupper() and len(mention) > 1 else new.capitalize()
    return new


def assign(key: bytes, own: set[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """The replacements of a set of entities that one process holds, by the rule of ``assigned``."""
    taken, made, attempt = {v for _, v in own}, {}, 0
    while len(made) < len(own):
        won: dict[str, tuple[str, str]] = {}
        for entity in sorted(own - made.keys()):
            new = candidate(key, *entity, attempt)
            if new not in taken:
                won.setdefault(new, entity)
        taken.update(won)
        made.update((entity, new) for new, entity in won.items())
        attempt += 1
    return made


def assigned(own: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, new) of every row of a table of distinct entities (kind, value): new is no value of the table and differs from row to row."""

    def tries(attempt: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, values = batch.column(0), batch.column(1)
                new = [candidate(key, k, v, attempt) for k, v in zip(kinds.to_pylist(), values.to_pylist())]
                yield pa.RecordBatch.from_arrays([kinds, values, pa.array(new, pa.string())], names=["kind", "value", "new"])

        return rows

    taken, parts, left, attempt = own.select(F.col("value").alias("new")).distinct(), [], own, 0
    while not left.isEmpty():
        tried = stored(left.mapInArrow(tries(attempt), "kind string, value string, new string"), "tried")
        least = tried.groupBy("new").agg(F.min(F.struct("kind", "value")).alias("entity"))
        parts.append(stored(least.join(taken.hint("merge"), "new", "left_anti").select("entity.kind", "entity.value", "new"), "won"))
        taken = taken.unionByName(parts[-1].select("new"))
        left = stored(tried.join(parts[-1].hint("merge"), ["kind", "value"], "left_anti").select("kind", "value"), "left")
        attempt += 1
    return reduce(DataFrame.unionByName, parts) if parts else own.withColumn("new", F.col("value"))


def own_entities(text: str) -> set[tuple[str, str]]:
    return {(kind, canonical(kind, text[a:b])) for a, b, kind in entities(text)}


class Replacer:
    """Replaces the entities of one text after another; ``made`` has the replacements, or None where each text stands alone."""

    def __init__(self, key: bytes, made: dict[tuple[str, str], str] | None = None):
        self.key, self.made = key, made

    def __call__(self, text: str) -> tuple[str, int]:
        """The text with surrogates, and the number of entities."""
        found = entities(text)
        made = assign(self.key, own_entities(text)) if self.made is None else self.made
        out, at = [], 0
        for a, b, kind in found:
            out += [text[at:a], dressed(kind, text[a:b], made[kind, canonical(kind, text[a:b])])]
            at = b
        return "".join([*out, text[at:]]), len(found)


def replaced(documents: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """``documents`` with surrogates in column text; ``count`` names a new column with the number of entities.

    Two passes over all texts; the rows with entities are stored under a number of their own and meet their replacements by it.
    """
    at, names = documents.columns.index("text"), documents.columns
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    counted = schema + (f", `{count}` int" if count else "")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            own = [sorted(own_entities(t.as_py() or "")) for t in batch.column(at)]
            some = batch.filter(pa.array([bool(x) for x in own], pa.bool_()))
            if some.num_rows:
                lists = pa.array([[{"kind": k, "value": v} for k, v in x] for x in own if x], pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))
                numbers = pa.array(range(row, row + some.num_rows), pa.int64())
                row += some.num_rows
                yield pa.RecordBatch.from_arrays([*some.columns, numbers, lists], names=[*names, "__row", "__own"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array([not entities(t.as_py() or "") for t in batch.column(at)], pa.bool_()))
            zeros = pa.array([0] * rest.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*rest.columns, *[zeros] * bool(count)], names=[*names, *[count] * bool(count)])

    def dress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers = [], []
            for text, made in zip(batch.column(at), batch.column("__made")):
                new, n = Replacer(key, {(m["kind"], m["value"]): m["new"] for m in made.as_py()})(text.as_py())
                texts.append(new)
                numbers.append(n)
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(numbers, pa.int32())] * bool(count)], names=[*names, *[count] * bool(count)])

    found = stored(documents.mapInArrow(pick, f"{schema}, __row long, __own array<struct<kind: string, value: string>>"), "found")
    mentions = found.select("__row", F.inline("__own"))
    made = assigned(stored(mentions.select("kind", "value").distinct(), "entities"), key)
    made = mentions.join(made.hint("merge"), ["kind", "value"]).groupBy("__row").agg(F.collect_list(F.struct("kind", "value", "new")).alias("__made"))
    met = found.drop("__own").join(made.hint("merge"), "__row").select(*(F.col(f"`{n}`") for n in names), "__made")
    return documents.mapInArrow(clean, counted).unionByName(met.mapInArrow(dress, counted))
