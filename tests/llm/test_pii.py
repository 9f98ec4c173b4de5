from tests.llm.helpers import ROWS, clashing, docs, rows_of
from vigilspark.llm import pii

KEY = b"test key"
TEXT = (
    "Mr. John Smith and Mrs Smith met Frau Müller; श्री राहुल शर्मा. IBAN GB82 WEST 1234 5698 7654 32, SSN 078-05-1120, "
    "9876543210, +1 (017) 555-7713, card 4111 1111 1111 1111; a.b@example.com A.B@EXAMPLE.COM 192.168.1.9 8.8.8.8 "
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
)
CLEAN = "Version 2.0 of 2024, see 3.14 and CC BY-NC 4.0.\nDon. Maria said so. 12345 items!!"


def test_types_and_formats():
    found = {(k, c) for _, _, k, c in pii.find(TEXT)}
    assert {k for k, _ in found} == {"GIVEN_m", "FAMILY", "IBAN", "SSN", "PHONE", "CARD", "EMAIL", "IP", "SECRET"}
    new, n = pii.rewrite(TEXT, KEY, {})
    assert n == 18 - 2 and len({k for _, _, k, _ in pii.find(new)}) == 9
    for secret in ("John", "Smith", "Müller", "राहुल", "शर्मा", "WEST", "078-05-1120", "9876543210", "555-7713", "4111 1111", "example.com", "8.8.8.8", "04dbeb"):
        assert secret not in new
    card = new.split("card ")[1][:19].replace(" ", "")
    assert card[0] == "4" and pii.luhn_digit(card[:-1]) == card[-1]
    first, second = new.split("; ")[2].split()[:2]
    assert second == first.upper()
    assert new.split("Mr. ")[1].split()[1] == new.split("Mrs ")[1].split()[0]
    assert pii.script_of(new.split("श्री ")[1]) == "devanagari"
    assert new.split("Mr. ")[1].split()[0] in pii.GIVEN["latin", "m"]


def test_clean_text_is_untouched():
    assert pii.rewrite(CLEAN, KEY, {}) == (CLEAN, 0)


def test_awkward_rows(spark):
    rows = [*ROWS, (50, TEXT, None, None), (51, CLEAN, None, None), (52, "1" * 50_000 + "a" * 50_000 + "@", None, None)]
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs(spark, rows), KEY).collect() if r["doc_id"]}
    assert got[3]["text"] is None and got[4]["text"] == "" and got[51]["text"] == CLEAN
    assert got[50]["n_entities"] == 16 and "Smith" not in got[50]["text"]
    assert all(got[i]["text"] == t for i, t, *_ in ROWS if i)
    assert pii.pseudonymise(docs(spark, []), KEY).count() == 0
    assert pii.pseudonymise(clashing(spark), KEY).count() == len(ROWS)


def test_collisions_are_resolved(spark):
    """With 26 letters to give, one-letter mail names must collide, and still end up distinct and consistent."""
    mails = [f"{c}@{d}.io" for c in "abcdefghijklmnopqrstuvwxyz" for d in "xy"]
    rows = [(i, f"write to {m} or {m.upper()}", None, None) for i, m in enumerate(mails)]
    table = pii.surrogates(docs(spark, rows), KEY).collect()
    assert len(table) == len(mails) == len({r["surrogate"] for r in table})
    assert not {r["surrogate"] for r in table} & set(mails)
    assert max(r["attempt"] for r in table) > 0
    a = rows_of(pii.pseudonymise(docs(spark, rows), KEY), "doc_id", "text", "n_entities")
    b = rows_of(pii.pseudonymise(docs(spark, rows), KEY, broadcast_rows=0), "doc_id", "text", "n_entities")
    assert a == b and all(t.split()[2] == t.split()[4].lower() for _, t, _ in a)
    assert len({t.split()[2] for _, t, _ in a}) == len(mails)


def test_bare_mentions_of_titled_names():
    text = (
        "Weber called. Dr Anna Weber and Frau Weiß met; Weber said WEBER's plan, Anna Weber-Klein, WEISS, anna.weber@x.org and Annabel "
        "stay. Prof Weber's weber; श्री राहुल शर्मा, शर्मा जी, शर्माजी."
    )
    new, n = pii.rewrite(text, KEY, {})
    family, given, weiss, sharma = (pii.surrogate(k, c, 0, KEY) for k, c in (("FAMILY", "weber"), ("GIVEN_x", "anna"), ("FAMILY", "weiss"), ("FAMILY", "शर्मा")))
    f, g = family[:1].upper() + family[1:], given[:1].upper() + given[1:]
    assert n == 14
    assert new.startswith(f"{f} called. Dr {g} {f} and Frau {weiss[:1].upper() + weiss[1:]} met; {f} said {family.upper()}'s plan, {g} {f}-Klein, {weiss.upper()}, ")
    assert f" and Annabel stay. Prof {f}'s weber; " in new
    assert new.endswith(f" {sharma}, {sharma} जी, शर्माजी.")


def test_bare_mentions_in_the_corpus(spark):
    rows = [(1, "Dr Anna Weber spoke. Later Weber left with Anna.", "en", None), (2, "Weber and Anna of another text.", "en", None)]
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs(spark, rows), KEY).collect()}
    assert got[1]["n_entities"] == 4 and not {"Anna", "Weber"} & set(got[1]["text"].replace(".", "").split())
    assert got[2]["text"] == rows[1][1] and got[2]["n_entities"] == 0


def test_runs_of_titles_and_words_that_look_like_names():
    new, n = pii.rewrite("Prof. Dr. Anna Schmidt. Schmidt", KEY, {})
    assert n == 3 and new.startswith("Prof. Dr. ") and "Anna" not in new and "Schmidt" not in new
    assert new.split()[3].rstrip(".") == new.split()[4] and new.split()[2].casefold() == pii.surrogate("GIVEN_x", "anna", 0, KEY)
    new, n = pii.rewrite("Frau Dr. Weiß und Herr Prof. Dr. Uwe Kern", KEY, {})
    assert n == 3 and new.startswith("Frau Dr. ") and " und Herr Prof. Dr. " in new and new.split()[-2] in pii.GIVEN["latin", "m"]
    new, n = pii.rewrite("Mr Will Smith will go. Will you come? He met Will. Will Smith left.", KEY, {})
    assert " will go. Will you come? " in new and "met Will." not in new and n == 5 and "Will Smith" not in new
    for text in ("Miss Universe 2024 was held. The Universe is large.", "Dr. Prof. alone", "Mr 12"):
        assert pii.rewrite(text, KEY, {}) == (text, 0)
    new, n = pii.rewrite("Miss Universe met the Universe.", KEY, {})
    assert n == 1 and new.endswith(" met the Universe.")


def test_more_kinds_of_numbers():
    text = "98765-43210, 022-2345678, fe80::1ff:fe23:4567:890a, 2001:db8::7, 1234 5678 9012, ABCDE1234F"
    new, n = pii.rewrite(text, KEY, {})
    assert n == 6 and [k for *_, k, _ in pii.find(text)] == ["PHONE", "PHONE", "IP6", "IP6", "ID12", "TAX"]
    for a, b in zip(text.split(", "), new.split(", "), strict=True):
        assert a != b and (":" in a or [c.isdigit() or c.isupper() for c in a] == [c.isdigit() or c.isupper() for c in b])
    clean = "at 12:30:45 in std::vector a::b 1234 5678, 2001-02-2024 10:20 AB12CD item 0123456789012345678901"
    assert pii.rewrite(clean, KEY, {}) == (clean, 0)


def test_planted_entities_by_plain_replacement(spark):
    """Texts built from known pieces: what was planted changes by one table for the corpus, everything else stays."""
    import itertools
    import random

    rng = random.Random(11)
    families = ["Okafor", "Lindqvist", "Petrov", "Nakamura", "Fuentes", "Haddad"]
    given = {"Mr": ["Tobias", "Emeka"], "Frau": ["Ingrid", "Saskia"], "Prof. Dr.": ["Noor", "Kiran"]}
    mails = [f"user{k}@host{k % 3}.example.org" for k in range(6)]
    phones = [f"+49 170 55512{k:02d}" for k in range(6)]
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004"]
    plain = ["the meeting begins at noon", "Version 3.1 of the plan", "see section 4.2", "nothing to add here"]
    rows, pieces = [], []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(5)
            if kind == 0:
                title = rng.choice(list(given))
                parts += [("", f"{title} "), ("GIVEN", rng.choice(given[title])), ("", " "), ("FAMILY", rng.choice(families))]
            elif kind < 4:
                parts.append([("MAIL", rng.choice(mails)), ("PHONE", rng.choice(phones)), ("CARD", rng.choice(cards))][kind - 1])
            else:
                parts.append(("", rng.choice(plain)))
            parts.append(("", ", "))
        pieces.append(parts)
        rows.append((i, "".join(x for _, x in parts), None, None))
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs(spark, rows), KEY).collect()}
    table = {}
    for i, parts in enumerate(pieces):
        new, at = got[i]["text"], 0
        assert got[i]["n_entities"] == sum(bool(k) for k, _ in parts)
        for (kind, piece), following in itertools.zip_longest(parts, parts[1:]):
            if not kind:
                assert new.startswith(piece, at)
                at += len(piece)
                continue
            end = new.index(following[1], at) if following else len(new)
            made, at = new[at:end], end
            key = (kind, piece if kind != "GIVEN" else (parts[parts.index((kind, piece)) - 1][1], piece))
            assert table.setdefault(key, made) == made and made != piece
            if kind in ("PHONE", "CARD"):
                assert [c.isdigit() for c in made] == [c.isdigit() for c in piece]
            if kind == "MAIL":
                assert made.count("@") == 1 and made.endswith(".org")
        assert at == len(new)
    for kind in ("FAMILY", "MAIL", "PHONE", "CARD"):
        made = [v for k, v in table.items() if k[0] == kind]
        assert len(set(made)) == len(made) > 1 and not set(made) & {k[1] for k in table}
