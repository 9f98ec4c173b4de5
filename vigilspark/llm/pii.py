"""Personal data: keyed surrogates that keep type, format, script and gender.

Every detected entity has a canonical form, so all its mentions in the corpus
get the same surrogate; the surrogate follows from a secret key, the type, the
canonical form and an attempt number.  Collisions are checked over the whole
corpus: no two entities of a type may share a surrogate and no surrogate may
equal a real entity; the entities that lose go to their next attempt until none
is left.  Only entities that needed more than the first attempt have to be known
when texts are rewritten.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import by_row, doc_text
from vigilspark.storage import materialize

# Titles with the gender they tell (m, f, or x for none), and given
# names by script and gender that surrogates are taken from first.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Dr": "x", "Prof": "x",
    "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Don": "m", "Doña": "f", "Shri": "m", "Smt": "f",
    "श्री": "m", "श्रीमती": "f", "Господин": "m", "Госпожа": "f",
}
GIVEN = {
    ("latin", "m"): ["James", "Robert", "Thomas", "Daniel", "Peter", "Henry", "Lucas", "Martin", "Victor", "Simon"],
    ("latin", "f"): ["Mary", "Anna", "Laura", "Julia", "Helen", "Clara", "Emma", "Sophie", "Alice", "Nora"],
    ("latin", "x"): ["Alex", "Robin", "Kim", "Sasha", "Charlie", "Jordan", "Taylor", "Morgan", "Casey", "Jamie"],
    ("devanagari", "m"): ["राहुल", "अमित", "विजय", "संजय", "अनिल"],
    ("devanagari", "f"): ["प्रिया", "सुनीता", "अनीता", "कविता", "मीना"],
    ("devanagari", "x"): ["किरण", "शशि", "ज्योति", "सुमन", "चंदन"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Андрей", "Олег"],
    ("cyrillic", "f"): ["Анна", "Мария", "Ольга", "Елена", "Ирина"],
    ("cyrillic", "x"): ["Саша", "Женя", "Валя", "Слава", "Паша"],
}
#: Syllables of generated family names by script (fixed values).
SYLLABLES = {
    "latin": ["bar", "den", "fol", "gar", "hul", "kes", "lam", "mor", "nev", "pol", "ris", "sten", "tor", "val", "wen", "zan"],
    "devanagari": ["का", "रा", "मा", "शा", "वा", "ना", "पा", "ला", "दे", "जो", "मि", "सि", "तो", "री", "गु", "हे"],
    "cyrillic": ["бар", "ден", "фол", "гар", "кес", "лам", "мор", "нев", "пол", "рис", "тор", "вал", "зан", "лин", "сед", "рум"],
}

#: Abbreviated titles, which may end in a full stop.
ABBREVIATED = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Smt")

_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_STOP = "|".join(f"(?<=\\b{t})\\." for t in ABBREVIATED)
#: A title is never a name.
_NAME = rf"(?!(?:{_TITLE})(?![\wऀ-ॿ]))(?:[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’\-]+|[ऀ-ॣ॰-ॿ]+)"
#: What may stand in a word; Devanagari vowel signs are not in ``\w``.
_LETTER = r"[\wऀ-ॣ॰-ॿ]"
#: An ending that is not part of the name: possessive, apostrophe, hyphen.
_ENDING = re.compile(r"(?:['’]s?|-)+$")
#: Titles of a run, without their full stops.
_TITLES = re.compile(_TITLE)
#: Words after which a capitalised word is a thing, not a person.
ARTICLES = ("the", "a", "an", "der", "die", "das", "dem", "den", "des", "ein", "eine", "le", "la", "les", "un", "une", "el", "los", "las")
_ARTICLE = re.compile(rf"(?<!{_LETTER})(?:{'|'.join(ARTICLES)})\s+$", re.IGNORECASE)
_SENTENCE = re.compile(r"(?:^|[.!?\n:][\s\"'“”»«)]*)$")
ENTITY = re.compile(
    r"""
    (?P<EMAIL>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})
  | (?P<IBAN>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
  | (?P<SECRET>\b(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|(?:sk|ghp|xox[bp])[_\-][A-Za-z0-9_\-]{16,})\b)
  | (?P<IP>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d))
  | (?P<SSN>(?<!\d)\d{3}-\d{2}-\d{4}(?!\d))
  | (?P<CARD>(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d))
  | (?P<PHONE>(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)\d{3,4}[ .\-]?\d{3,4}(?!\d)
      |(?<![\w.])\+\d{1,3}(?:[ .\-]?\d{2,5}){2,4}(?!\d)
      |(?<![\w.])\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)
      |(?<![\w.\-])[6-9]\d{4}[ \-]\d{5}(?![\d\-])
      |(?<![\w.\-])0\d{2,4}-\d{6,8}(?![\d\-])
      |(?<![\w.])[6-9]\d{9}(?!\d))
  | (?P<ID12>(?<![\w.\-])\d{4}\ \d{4}\ \d{4}(?![\w\-]|\ \d))
  | (?P<TAX>\b[A-Z]{5}\d{4}[A-Z]\b)
  | (?P<IP6>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)(?=[A-Fa-f:]*\d)[0-9A-Fa-f:]{6,39}(?![\w:]))
  | \b(?P<TITLE>(?:(?:"""
    + _TITLE
    + r""")(?:"""
    + _STOP
    + r""")?\ )+)(?P<FIRST>"""
    + _NAME
    + r""")(?:\ (?P<SECOND>"""
    + _NAME
    + r"""))?
    """,
    re.VERBOSE,
)
#: A text without any of these characters and titles has no entity.
_MARK = re.compile(r"[0-9@]|(?:AKIA|sk[_\-]|ghp_|xox)")
_WORDS = tuple(TITLES)
#: After so many attempts the format is relaxed where it can be, so that small formats cannot run out.
RELAX = 8
MAX_ROUNDS = 40


def script_of(word: str) -> str:
    for c in word:
        if "ऀ" <= c <= "ॿ":
            return "devanagari"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def find(text: str | None) -> Iterator[tuple[int, int, str, str]]:
    """``(start, end, type, canonical form)`` of each mention, left to right, without overlap.

    A name is detected after a title or a run of titles; its given and family name
    are then found wherever else they stand as whole capitalised words in the same
    text, but not after an article, nor at the begin of a sentence where the text also
    has them as a word in lower case (Will, Mark) and but one title, unless another
    part of a name stands beside them.
    """
    if not text or not (_MARK.search(text) or any(w in text for w in _WORDS)):
        return
    found = list(_typed(text))
    names: dict[str, str] = {}
    for _, _, kind, canonical in found:
        # a word that is both stands as the family name
        if kind == "FAMILY" or (kind.startswith("GIVEN_") and canonical not in names):
            names[canonical] = kind
    yield from sorted([*found, *_bare(text, found, names)]) if names else found


def _bare(text: str, found: list[tuple[int, int, str, str]], names: dict[str, str]) -> Iterator[tuple[int, int, str, str]]:
    """Further mentions of ``names`` outside what is found already."""
    forms = {text[a:b] for a, b, _, canonical in found if canonical in names} | set(names)
    words = "|".join(map(re.escape, sorted(forms, key=lambda w: (-len(w), w))))
    pattern = re.compile(f"(?<!{_LETTER})(?:{words})(?!{_LETTER})", re.IGNORECASE)
    at = k = 0
    mentions = []
    while m := pattern.search(text, at):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        if k < len(found) and found[k][0] < m.end():
            at = found[k][1]
            continue
        at = m.end()
        if (kind := names.get(m[0].casefold())) is None:
            continue
        mentions.append((*m.span(), kind, m[0].casefold()))
    titled = Counter(canonical for *_, canonical in found)
    common = {canonical for a, _, _, canonical in mentions if text[a].islower() and titled[canonical] < 2}
    capital = [x for x in mentions if not text[x[0]].islower()]
    spans = {(a, b) for a, b, *_ in [*found, *capital]}
    ends, starts = {b for _, b in spans}, {a for a, _ in spans}
    for a, b, kind, canonical in capital:
        before = text[max(0, a - 24) : a]
        beside = (a - 1 in ends and text[a - 1] == " ") or (b + 1 in starts and text[b] == " ")
        if beside or not (_ARTICLE.search(before) or (canonical in common and _SENTENCE.search(before))):
            yield a, b, kind, canonical


def _typed(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in ENTITY.finditer(text):
        kind = m.lastgroup
        if m["TITLE"]:
            # the first title that tells a gender does
            gender = next((g for t in _TITLES.findall(m["TITLE"]) if (g := TITLES[t]) != "x"), "x")
            if m["TITLE"].strip() == "Miss" and re.match(r"\s+\d", text[m.end() :]):
                continue  # a contest and its year
            first = _ENDING.sub("", m["FIRST"])
            at = m.start("FIRST")
            if m["SECOND"] and first == m["FIRST"]:
                second = _ENDING.sub("", m["SECOND"])
                yield at, at + len(first), f"GIVEN_{gender}", first.casefold()
                yield m.start("SECOND"), m.start("SECOND") + len(second), "FAMILY", second.casefold()
            else:
                yield at, at + len(first), "FAMILY", first.casefold()
            continue
        found = m[0]
        if kind in ("PHONE", "CARD", "SSN", "ID12"):
            canonical = ("+" if found.startswith("+") else "") + re.sub(r"\D", "", found)
            if kind == "PHONE" and not 7 <= len(canonical.lstrip("+")) <= 15:
                continue
        elif kind == "IBAN":
            canonical = found.replace(" ", "")
            if not 15 <= len(canonical) <= 34 or _mod97(canonical) != 1:
                continue
        elif kind == "IP6":
            try:
                canonical = str(ipaddress.IPv6Address(found))
            except ValueError:
                continue
        elif kind == "EMAIL" or (kind == "SECRET" and re.fullmatch(r"[0-9a-fA-F]+", found)):
            canonical = found.lower()
        else:
            canonical = found
        yield *m.span(), kind, canonical


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


class Stream:
    """Numbers that follow from the key and a label."""

    def __init__(self, key: bytes, *label: object) -> None:
        self.key, self.label, self.block, self.data = key, "\x1f".join(map(str, label)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.data) < 4:
            self.data = hashlib.blake2b(self.label + b"\x1f%d" % self.block, key=self.key).digest()
            self.block += 1
        value, self.data = int.from_bytes(self.data[:4], "big"), self.data[4:]
        return value % n

    def like(self, text: str, digits: str = "0123456789", letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        """Digit for digit, letter for letter of the same case, everything else as it is."""
        out = []
        for c in text:
            if c.isascii() and c.isdigit():
                out.append(digits[self.below(len(digits))])
            elif c.isascii() and c.isalpha():
                x = letters[self.below(len(letters))]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The canonical form of the replacement, of the same type and format."""
    s = Stream(key, kind, canonical, attempt)
    extra = max(0, attempt - RELAX + 1)
    if kind == "EMAIL":
        local, _, domain = canonical.partition("@")
        host, _, tld = domain.rpartition(".")
        host = Stream(key, "HOST", domain, attempt // RELAX).like(host)
        return f"{s.like(local)}{s.like('a' * extra)}@{host}.{tld}"
    if kind == "PHONE":
        plus = canonical.startswith("+")
        digits = canonical.lstrip("+")
        keep = (1 if digits[0] in "17" else 2) if plus and len(digits) > 8 else 0
        rest = s.like(digits[keep:])
        if not plus and digits[keep] != "0":
            rest = (str(6 + s.below(4)) if digits[keep] in "6789" else str(1 + s.below(9))) + rest[1:]
        return ("+" if plus else "") + digits[:keep] + rest
    if kind == "CARD":
        body = canonical[0] + s.like(canonical[1:-1])
        valid = luhn_digit(canonical[:-1]) == canonical[-1]
        return body + (luhn_digit(body) if valid else s.like("0"))
    if kind == "ID12":
        return canonical[0] + s.like(canonical[1:])
    if kind == "TAX":
        return s.like(canonical)
    if kind == "IP6":
        keep = 2 if ipaddress.ip_address(canonical).is_private else 0
        groups = ipaddress.IPv6Address(canonical).exploded.split(":")
        made = [g if k < keep // 2 else "".join("0123456789abcdef"[s.below(16)] for _ in range(4)) for k, g in enumerate(groups)]
        made[0] = made[0] if keep else f"2{made[0][1:]}"
        return str(ipaddress.IPv6Address(":".join(made)))
    if kind == "SSN":
        return f"{1 + s.below(665):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "IP":
        if ipaddress.ip_address(canonical).is_private:
            return f"10.{s.below(256)}.{s.below(256)}.{s.below(256)}"
        while ipaddress.ip_address(made := f"{1 + s.below(223)}.{s.below(256)}.{s.below(256)}.{s.below(256)}").is_private:
            pass
        return made
    if kind == "IBAN":
        body = s.like(canonical[4:], letters="ABCDEFGHIJKLMNOPQRSTUVWXYZ".lower())
        return f"{canonical[:2]}{98 - _mod97(canonical[:2] + '00' + body):02d}{body}"
    if kind == "SECRET":
        if re.fullmatch(r"[0-9a-f]+", canonical):
            return s.like(canonical, letters="abcdef")
        lead = re.match(r"(?:AKIA|sk[_\-]|ghp_|xox[bp]-)?", canonical)[0]
        return lead + s.like(canonical[len(lead) :])
    script = script_of(canonical)
    if kind.startswith("GIVEN_") and attempt < RELAX:
        names = GIVEN[script, kind[-1]]
        return names[s.below(len(names))].casefold()
    parts = SYLLABLES[script]
    ending = {"m": "o", "f": "a"}.get(kind[-1], "") if kind.startswith("GIVEN_") and script == "latin" else ""
    return "".join(parts[s.below(len(parts))] for _ in range(3 + extra)) + ending


def render(kind: str, mention: str, made: str) -> str:
    """The surrogate in the layout of the mention: its separators, its case."""
    if kind in ("PHONE", "CARD", "SSN", "ID12"):
        digits = iter(re.sub(r"\D", "", made))
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "IBAN":
        chars = iter(made)
        return "".join(c if c == " " else next(chars) for c in mention)
    if len(made) == len(mention) and kind in ("EMAIL", "SECRET"):
        return "".join(m.upper() if c.isupper() else m for c, m in zip(mention, made, strict=True))
    if mention.isupper():
        return made.upper()
    if kind == "FAMILY" or kind.startswith("GIVEN_"):
        return made[:1].upper() + made[1:] if mention[:1].isupper() else made
    return made


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and the number of mentions."""
    out, at, n = [], 0, 0
    for start, end, kind, canonical in find(text):
        made = surrogate(kind, canonical, attempts.get((kind, canonical), 0), key)
        out += [text[at:start], render(kind, text[start:end], made)]
        at, n = end, n + 1
    return "".join(out) + text[at:] if n else text, n


def surrogates(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``(kind, canonical, surrogate, attempt)`` of every entity of the corpus, without collisions."""
    spark = docs.sparkSession
    found_schema = pa.schema([("kind", pa.string()), ("canonical", pa.string())])

    def detect(source):
        for (text,) in source:
            for kind, canonical in {(k, c) for _, _, k, c in find(text)}:
                yield 1, kind, canonical

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    entities = materialize(
        texts.mapInArrow(by_row(found_schema, detect), "kind string, canonical string").distinct(), "entities"
    )
    made_schema = pa.schema([("kind", pa.string()), ("canonical", pa.string()), ("surrogate", pa.string()), ("attempt", pa.int32())])

    def make(source):
        for kind, canonical, attempt in source:
            yield 1, kind, canonical, surrogate(kind, canonical, attempt, key), attempt

    space = F.when(F.col("kind").startswith("GIVEN_"), F.lit("GIVEN")).otherwise(F.col("kind")).alias("space")
    real = entities.select(space, F.col("canonical").alias("surrogate")).distinct()
    pending, settled = entities.withColumn("attempt", F.lit(0)), None
    for _ in range(MAX_ROUNDS):
        made = pending.mapInArrow(by_row(made_schema, make), "kind string, canonical string, surrogate string, attempt int")
        made = materialize(made.withColumn("space", space), "made")
        open_ = made.join(real, ["space", "surrogate"], "left_anti")
        if settled is not None:
            open_ = open_.join(settled.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        first = open_.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "canonical")).alias("winner"))
        won = first.select("space", "surrogate", "winner.kind", "winner.canonical").join(made.select("kind", "canonical", "attempt"), ["kind", "canonical"])
        won = materialize(won.select("kind", "canonical", "surrogate", "attempt", "space"), "won")
        settled = won if settled is None else settled.unionByName(won)
        lost = made.join(won, ["kind", "canonical"], "left_anti").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        pending = materialize(lost, "pending")
        if pending.isEmpty():
            return settled.drop("space")
    raise RuntimeError(f"{pending.count()} entities have no surrogate of their own after {MAX_ROUNDS} attempts")


def pseudonymise(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 50_000
) -> DataFrame:
    """``(doc_id, text, n_entities)``, a row for each row of ``docs``, with surrogates for personal data.

    Texts without an entity, empty texts and null texts come back as they are.
    Null ids and repeated rows are kept; other columns are not read; an empty
    table gives an empty result.  Entities that needed a further attempt are
    broadcast if they are at most ``broadcast_rows`` (counted first), otherwise
    joined to the documents that mention them.
    """
    spark = docs.sparkSession
    later = surrogates(docs, key, text_col).where("attempt > 0").select("kind", "canonical", "attempt")
    plain = doc_text(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int64())])
    columns = "doc_id long, text string, n_entities long"
    known = later.limit(broadcast_rows + 1).collect()
    if len(known) <= broadcast_rows:
        shipped = spark.sparkContext.broadcast({(r["kind"], r["canonical"]): r["attempt"] for r in known})

        def replace(source):
            for i, text in source:
                new, n = (None, 0) if text is None else rewrite(text, key, shipped.value)
                yield len(text or ""), i, new, n

        return plain.mapInArrow(by_row(schema, replace), columns)

    rows = materialize(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    mention_schema = pa.schema([("row", pa.int64()), ("kind", pa.string()), ("canonical", pa.string())])

    def mentions(source):
        for row, text in source:
            for kind, canonical in {(k, c) for _, _, k, c in find(text)}:
                yield 1, row, kind, canonical

    listed = rows.select("row", "text").mapInArrow(by_row(mention_schema, mentions), "row long, kind string, canonical string")
    own = listed.join(later, ["kind", "canonical"]).groupBy("row").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("own"))

    def replace_joined(source):
        for i, text, own in source:
            attempts = {(r["kind"], r["canonical"]): r["attempt"] for r in own or []}
            new, n = (None, 0) if text is None else rewrite(text, key, attempts)
            yield len(text or ""), i, new, n

    return rows.join(own, "row", "left").select("id", "text", "own").mapInArrow(by_row(schema, replace_joined), columns)
