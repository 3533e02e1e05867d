"""Surrogates for personal data: keyed, of the same type, format, script and gender.

An entity's canonical form (an address in lower case, a number's digits) is read as a mixed-radix
number whose places keep their kind of character, and a keyed permutation of all such numbers gives
the surrogate.  So one entity has one surrogate everywhere, and two entities never share one.
Names are replaced word by word: given names by gender and script, family names by script and, in Cyrillic,
ending.  One word has one surrogate in whatever mention it is, so "Mrs Clara Weber", "Clara Weber" and "Weber" of
a document stay one person.  A distributed check over the distinct entities and name words finds what a
permutation can't rule out (words that meet, surrogates that are someone's real data) and gives those
another try, until none is left.  Each try has a larger domain of names, by a syllable; e-mails and IP
addresses whose own form is used up get a longer or freer one.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchplan.llm.common import BROADCAST_BYTES, texts, workspace, written

#: Tries within the own form of an e-mail or IP address; further ones leave it.
FORM_TRIES = 4
#: Bytes of an entity's number of tries in memory, about.
TRY_BYTES = 200

#: Titles by gender, first names by gender and script, syllables of family names by script.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа"], "n": ["Dr", "Prof", "Mx"]}
FIRST = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Louis", "Martin", "Oscar", "Paul", "Simon", "Thomas", "Victor"],
    ("latin", "f"): ["Alice", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Rosa", "Sofia", "Vera"],
    ("latin", "n"): ["Alex", "Andrea", "Charlie", "Dominique", "Kim", "Lou", "Robin", "Sascha"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Юрий"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Юлия"],
    ("cyrillic", "n"): ["Женя", "Саша", "Слава", "Валя"],
}
SYLLABLES = {"latin": ["bar", "den", "fel", "gor", "hal", "kes", "lin", "mor", "nar", "pel", "ros", "san", "tam", "var", "wen", "zol"], "cyrillic": ["бар", "вел", "гор", "дан", "зол", "кар", "лем", "мир", "нар", "пол", "рос", "сан", "тар", "фед", "хол", "чер"]}
_TITLE_GENDER = {t: g for g, own in TITLES.items() for t in own}
_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_LOWER = "a-zß-öø-ÿа-яё"
_WORD = rf"[{_UPPER}](?:['’]?[{_UPPER}])?[{_LOWER}]+(?:[{_UPPER}][{_LOWER}]+)*"
#: Particles of family names, which stay; endings of Cyrillic family names, which stay.
PARTICLES = ["von", "van", "der", "den", "de", "du", "del", "della", "di", "da", "dos", "la", "le", "ten", "ter", "zu", "zur"]
ENDINGS = ["ская", "ский", "ова", "ева", "ёва", "ина", "ов", "ев", "ёв", "ин"]
_OF = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
_NAME = re.compile(rf"\b({'|'.join(sorted(map(re.escape, _TITLE_GENDER), key=len, reverse=True))})(\.? )(?:[{_UPPER}]\. ?){{0,3}}({_OF}{_WORD}(?:[ -]{_OF}{_WORD}){{0,4}})(?!\w)")
_CAPITAL = re.compile(rf"(?<!\w){_WORD}(?!\w)")
_GENDERS = {name.lower(): g for (_, g), own in FIRST.items() if g != "n" for name in own}
_EMAIL = re.compile(r"[\w.%+-]*\w@\w[\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]\d|\d)")
_CARD = re.compile(r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)")
_PHONE = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")
#: National numbers: an area code with its 0, then 6 to 9 digits; or five pairs.
_NATIONAL = re.compile(r"(?<![\w+./-])(?:0\d{1,4}(?: ?/ ?|[ -])\d{3,9}(?:[ -]\d{2,4}){0,2}|0\d(?:[ .]\d\d){4})(?![\w-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d\d(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")
_KINDS = (("secret", _SECRET), ("iban", _IBAN), ("ssn", _SSN), ("phone", _PHONE), ("national", _NATIONAL), ("ip", _IP), ("card", _CARD))
_digit = re.compile(r"\d").search

_LETTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρστυφχψω")
_ALPHABET = {c: own for own in _LETTERS for c in own}


@dataclass(frozen=True)
class Entity:
    """A mention; its parts (begin, end, kind, canonical) are replaced each: a name's words, anything else as a whole."""

    begin: int
    end: int
    kind: str
    canonical: str
    parts: tuple[tuple[int, int, str, str], ...]


def detect(text: str) -> list[Entity]:
    """Entities of a text, in order, none within another: secrets, bank accounts, phones, addresses, cards, e-mails, names.

    A name is known by its title; other capitalised mentions of its words in the same text, without a title, are
    names too.
    """
    found: list[tuple[int, int, int, Entity]] = []

    def add(begin: int, end: int, kind: str, canonical: str, rank: int, parts: tuple | None = None) -> None:
        found.append((begin, -end, rank, Entity(begin, end, kind, canonical, parts or ((begin, end, kind, canonical),))))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email", m[0].lower(), 0)
    if _digit(text):
        for rank, (kind, pattern) in enumerate(_KINDS, 1):
            for m in pattern.finditer(text):
                digits = "".join(c for c in m[0] if c.isdigit())
                if kind in ("secret", "ip"):
                    add(m.start(), m.end(), kind, m[0].lower(), rank)
                elif kind == "iban":
                    own = m[0].replace(" ", "")
                    if 15 <= len(own) <= 34 and iban_check(own) == own[2:4]:
                        add(m.start(), m.end(), kind, own, rank)
                elif kind == "phone":
                    add(m.start(), m.end(), kind, f"{_country(m[0])} {digits}", rank)
                elif kind == "national":
                    if 9 <= len(digits) <= 13:
                        add(m.start(), m.end(), "phone", f"1 {digits}", rank)
                elif kind != "card" or 13 <= len(digits) <= 19:
                    add(m.start(), m.end(), kind, digits, rank)
    _add_names(text, add)
    out: list[Entity] = []
    for _, _, _, e in sorted(found, key=lambda f: f[:3]):
        if not out or e.begin >= out[-1].end:
            out.append(e)
    return out


def _add_names(text: str, add) -> None:
    given: dict[str, str] = {}  # words of titled names of this text, with their gender
    family: set[str] = set()
    titled = []
    for m in _NAME.finditer(text):
        words = [(w.start(), w.end(), w[0].lower()) for w in _CAPITAL.finditer(text, m.start(3), m.end(3))]
        last = max((k for k in range(1, len(words)) if text[words[k - 1][1] : words[k][0]] != "-"), default=0)  # the family name may have a hyphen
        titled.append((m.start(3), m.end(3), _TITLE_GENDER[m[1]], words, last))
        for _, _, w in words[:last]:
            g = _TITLE_GENDER[m[1]] if _TITLE_GENDER[m[1]] != "n" else _GENDERS.get(w, "n")
            if given.get(w, "n") == "n":
                given[w] = g
        family.update(w for _, _, w in words[last:])
    for begin, end, title, words, last in titled:
        parts = tuple((b, e, "given", f"{title if title != 'n' else given[w]} {w}") if k < last else (b, e, "family", w) for k, (b, e, w) in enumerate(words))
        add(begin, end, "name", " ".join(p[3] for p in parts), 8, parts)
    if not titled:
        return
    run: list[tuple[int, int, str]] = []

    def close() -> None:
        if run:
            parts = []
            for k, (b, e, w) in enumerate(run):
                is_family = w in family and (w not in given or k == len(run) - 1)
                parts.append((b, e, "family", w) if is_family else (b, e, "given", f"{given[w]} {w}"))
            add(run[0][0], run[-1][1], "name", " ".join(p[3] for p in parts), 9, tuple(parts))
            run.clear()

    for m in _CAPITAL.finditer(text):
        w = m[0].lower()
        if w not in given and w not in family:
            close()
            continue
        if run and text[run[-1][1] : m.start()] not in (" ", "-"):
            close()
        run.append((m.start(), m.end(), w))
    close()


def iban_check(iban: str) -> str:
    """The check digits that belong to an account number, whatever it has."""
    number = "".join(str(int(c, 36)) for c in iban[4:] + iban[:2] + "00")
    return f"{98 - int(number) % 97:02d}"


def _country(phone: str) -> int:
    """How many leading digits are the country's code, which stays."""
    m = re.match(r"\+(\d{1,3})(?=[ .(-])", phone)
    return len(m[1]) if m else 0


class Surrogates:
    """Keyed surrogates of canonical forms; `again` counts further tries."""

    def __init__(self, key: bytes):
        self.key = key

    def _number(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")

    def _permuted(self, x: int, size: int, tweak: str) -> int:
        """A keyed permutation of range(size): a balanced Feistel network, walked until it is back in the range."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for r in range(8):
                a, b = b, a ^ (self._number(tweak, half, r, b) & mask)
            x = a << half | b
            if x < size:
                return x

    def _spelled(self, text: str, alphabets: list[str | None], tweak: str) -> str:
        size = x = 0
        size = 1
        for c, own in zip(text, alphabets, strict=True):
            if own:
                x, size = x * len(own) + own.index(c), size * len(own)
        form = "".join("x" if own else c for c, own in zip(text, alphabets, strict=True)) + "/" + ",".join(own[0] + str(len(own)) if own else "" for own in alphabets)
        x = self._permuted(x, size, f"{tweak}/{form}")
        out = []
        for c, own in zip(reversed(text), reversed(alphabets), strict=True):
            if own:
                x, at = divmod(x, len(own))
                c = own[at]
            out.append(c)
        return "".join(reversed(out))

    def __call__(self, kind: str, canonical: str, again: int = 0) -> str:
        tweak = f"{kind}/{again}"
        if kind == "email":
            stem, dot, top = canonical.rpartition(".")
            new = self._spelled(stem, [_ALPHABET.get(c) for c in stem], tweak)
            for k in range(again - FORM_TRIES + 1):  # in front of the @
                new = new.replace("@", _LETTERS[1][self._number(tweak, canonical, k) % 26] + "@")
            return new + dot + top
        if kind == "iban":
            body = canonical[4:].lower()
            new = self._spelled(body, [_ALPHABET[c] for c in body], f"{tweak}/{canonical[:2]}").upper()
            return canonical[:2] + iban_check(canonical[:4] + new) + new
        if kind == "ssn":
            return self._spelled(canonical, ["0123456789"] * len(canonical), tweak)
        if kind == "secret":
            return self._spelled(canonical, ["0123456789abcdef"] * len(canonical), tweak)
        if kind == "ip":
            own = [int(p) for p in canonical.split(".")]
            ranges = [(0, 256) if again >= FORM_TRIES else (0, 10) if p < 10 else (10, 90) if p < 100 else (100, 156) for p in own]
            x = size = 0
            size = 1
            for p, (low, n) in zip(own, ranges, strict=True):
                x, size = x * n + p - low, size * n
            x = self._permuted(x, size, f"{tweak}/{ranges}")
            out = []
            for low, n in reversed(ranges):
                x, at = divmod(x, n)
                out.append(str(low + at))
            return ".".join(reversed(out))
        if kind == "card":  # the check digit stays as right, or as wrong, as it was
            body, check = canonical[:-1], int(canonical[-1])
            new = self._spelled(body, ["0123456789"] * len(body), tweak)
            return new + str((luhn(new) + check - luhn(body)) % 10)
        if kind == "phone":
            code, digits = canonical.split(" ")
            keep = int(code)
            return f"{code} {digits[:keep]}" + self._spelled(digits[keep:], ["0123456789"] * (len(digits) - keep), f"{tweak}/{digits[:keep]}")
        word = canonical.split(" ")[-1]
        script = "cyrillic" if any("а" <= c <= "ё" for c in word) else "latin"
        x = self._number(tweak, canonical)

        def syllables(n: int) -> str:
            nonlocal x
            out = []
            for _ in range(n):
                x, at = divmod(x, len(SYLLABLES[script]))
                out.append(SYLLABLES[script][at])
            return "".join(out)

        if kind == "given":
            names = FIRST[script, canonical[0]]
            x, at = divmod(x, len(names))
            return names[at].lower() + syllables(again)
        ending = next((s for s in ENDINGS if word.endswith(s) and len(word) > len(s) + 1), "")
        return syllables(3 + again) + ending


def luhn(digits: str) -> int:
    """The check digit that belongs behind the digits."""
    return -sum(int(c) if k % 2 else int(c) * 2 % 9 or int(c) // 9 * 9 for k, c in enumerate(reversed(digits))) % 10


def poured(kind: str, original: str, surrogate: str) -> str:
    """The surrogate in the original's spelling: its separators, its capitals."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(surrogate.split(" ")[-1])
        return "".join(next(digits) if c.isdigit() else c for c in original)
    if kind == "iban":
        signs = iter(surrogate)
        return "".join(c if c == " " else next(signs) for c in original)
    if kind in ("given", "family"):
        return surrogate[0].upper() + surrogate[1:]
    if len(original) == len(surrogate) and not original.islower():
        return surrogate.upper() if original.isupper() else "".join(s.upper() if o.isupper() else s for o, s in zip(original, surrogate, strict=True))
    return surrogate


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, canonical) of all documents' entities, names by their words, each once a batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            met = {p[2:] for t in pdf["text"] for e in detect(t) for p in e.parts}
            yield pd.DataFrame(sorted(met), columns=["kind", "canonical"])

    return texts(docs).select("text").mapInPandas(run, "kind string, canonical string").distinct()


def _space(kind):
    """What must differ from one another: all words of names, and each other kind."""
    return F.when(kind.isin("given", "family"), "name").otherwise(kind)


def retries(found: DataFrame, key: bytes, folder: str, most: int = 6) -> DataFrame:
    """(kind, canonical, again) of entities that need another try: their surrogate is another's, or is real data here.

    Joins and counts over the distinct entities; each round tries again what met, all but the first of equals, until
    nothing meets.  If `most` rounds in a row leave as much as before (a form whose every value is real data), it is an error.
    """

    @F.pandas_udf("string")
    def surrogate(kind: pd.Series, canonical: pd.Series, again: pd.Series) -> pd.Series:
        s = Surrogates(key)
        return pd.Series([s(k, c, int(a)) for k, c, a in zip(kind, canonical, again, strict=True)], dtype=object)

    space = _space(F.col("kind"))
    itself = F.when(space == "name", F.element_at(F.split("canonical", " "), -1)).otherwise(F.col("canonical"))
    real = written(found.select(space.alias("space"), itself.alias("surrogate"), F.lit(True).alias("real")).distinct(), folder, "real")
    state = written(found.select("kind", "canonical", F.lit(0).alias("again")).withColumn("surrogate", surrogate("kind", "canonical", "again")), folder, "try-0")
    k, least, idle = 0, None, 0
    while True:
        k += 1
        spaced, who = state.withColumn("space", space), F.struct("kind", "canonical")
        taken = spaced.groupBy("space", "surrogate").agg(F.min(who).alias("first"))
        seen = spaced.join(taken, ["space", "surrogate"]).join(real, ["space", "surrogate"], "left")
        meets = F.coalesce("real", F.lit(False)) | (F.col("first") != who)
        marked = written(seen.select("kind", "canonical", "again", "surrogate", meets.alias("meets")), folder, f"met-{k}")
        left = marked.where("meets").count()
        if not left:
            break
        least, idle = (left, 0) if least is None or left < least else (least, idle + 1)
        if idle == most:
            raise RuntimeError(f"{left} entities still have no surrogate of their own after {k} tries")
        moved = marked.where("meets").select("kind", "canonical", (F.col("again") + 1).alias("again")).withColumn("surrogate", surrogate("kind", "canonical", "again"))
        state = written(marked.where("not meets").drop("meets").unionByName(moved), folder, f"try-{k}")
    return state.where("again > 0").select("kind", "canonical", "again")


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities and entities (begin, end in the source text, kind, surrogate) of each row.

    key: a secret; whoever has it can undo the surrogates of permuted kinds, and the same key gives the same surrogates to
    the same set of entities.  Null and empty texts come back empty and without entities; repeated rows
    get the same surrogates.  What needs another try is broadcast if it is few; if not, it is joined to the
    entities of each document.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    folder = workspace(docs.sparkSession)
    again = written(retries(written(entities(docs), folder, "entities"), key, folder), folder, "again")
    n = again.count()
    schema = "doc_id long, text string, n_entities long, entities array<struct<begin:int,end:int,kind:string,surrogate:string>>"
    small = n * TRY_BYTES <= BROADCAST_BYTES
    tries = docs.sparkSession.sparkContext.broadcast({(r[0], r[1]): r[2] for r in again.collect()} if small else {})
    rows = texts(docs)
    if not small:
        rows = _with_tries(rows, again, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, known = Surrogates(key), {}
        for pdf in batches:
            out = []
            for doc_id, text, own in zip(pdf["doc_id"], pdf["text"], pdf["tries"] if "tries" in pdf else [None] * len(pdf), strict=True):
                extra = {(x["kind"], x["canonical"]): x["again"] for x in own} if own is not None else tries.value
                pieces, at, listed = [], 0, []
                for e in detect(text):
                    new, inner = [], e.begin
                    for begin, end, kind, canonical in e.parts:
                        which = (kind, canonical, extra.get((kind, canonical), 0))
                        if which not in known:
                            if len(known) > 200_000:
                                known.clear()
                            known[which] = s(*which)
                        new += [text[inner:begin], poured(kind, text[begin:end], known[which])]
                        inner = end
                    new = "".join([*new, text[inner : e.end]])
                    pieces += [text[at : e.begin], new]
                    at = e.end
                    listed.append({"begin": e.begin, "end": e.end, "kind": e.kind, "surrogate": new})
                out.append((doc_id, "".join([*pieces, text[at:]]) if listed else text, len(listed), listed))
            frame = pd.DataFrame(out, columns=["doc_id", "text", "n_entities", "entities"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return rows.mapInPandas(run, schema)


def _with_tries(rows: DataFrame, again: DataFrame, folder: str) -> DataFrame:
    """rows with the further tries that their own entities need."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(key, kind, canonical) for key, t in zip(pdf["sha"], pdf["text"], strict=True) for e in detect(t) for _, _, kind, canonical in e.parts]
            yield pd.DataFrame(out, columns=["sha", "kind", "canonical"])

    named = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    own = named.select("sha", "text").mapInPandas(run, "sha string, kind string, canonical string").distinct().join(again, ["kind", "canonical"])
    lists = written(own.groupBy("sha").agg(F.collect_list(F.struct("kind", "canonical", "again")).alias("tries")), folder, "tries")
    return named.join(lists, "sha", "left").select("doc_id", "text", F.coalesce("tries", F.array().cast("array<struct<kind:string,canonical:string,again:int>>")).alias("tries"))
