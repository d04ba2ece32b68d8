import random
import re

import regex

from tidelog.llm import surrogates as S

SF = "/root/testdata/sf0.01"
TEXTS = [
    None, "", "nothing here", "Mail a.b19@mail5.example.com, or a.b19@mail5.example.com; call +1 (743) 555-3824.", "4785380592391139 4111111111111111 10.1.2.3 and 152.143.123.131.", "Dear Mrs Smith, Mr John Smith and Frau Anna Weiß met Г-жа Иванова.", "ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00",
    "x " * 50000 + "+1 (743) 555-3824", "öhei.12@mail2.example.com 1.2.3.4.5 12345", "a.b19@mail5.example.com",
]


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(c if i % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c) for i, c in enumerate(d)) % 10


def entities(text):
    return [m.group() for m in regex.finditer(S.ANY.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"), text or "")]


def shape(text):
    return regex.sub(r"\p{Ll}", "a", regex.sub(r"\p{Lu}", "A", re.sub("[0-9]", "0", text)))


def check(before, after):
    """Holds (id -> texts) against each other; the map from values to surrogates."""
    mapping = {}
    for i, old in before.items():
        new = after[i]
        if old is None:
            assert new is None
            continue
        old_parts, new_parts = entities(old), entities(new)
        assert len(old_parts) == len(new_parts)
        assert regex.split(S.ANY, old) == regex.split(S.ANY, new)
        for a, b in zip(old_parts, new_parts, strict=True):
            assert mapping.setdefault(a, b) == b
    assert len(set(mapping.values())) == len(mapping) and not set(mapping) & set(mapping.values())
    return mapping


def test_format_gender_script_and_coreference(spark, frame):
    docs = frame(list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[3])])
    rows = S.replace(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    mapping = check(dict(enumerate(TEXTS)), {r.doc_id: r.text for r in rows if r.doc_id is not None})
    for a, b in mapping.items():
        if not a.startswith(("Mr", "Frau", "Г", "1")):
            assert shape(a.replace("ö", "o")) == shape(b), (a, b)
    assert mapping["+1 (743) 555-3824"].startswith("+1 (")
    assert luhn(mapping["4111111111111111"]) == 0 and luhn(mapping["4785380592391139"]) == luhn("4785380592391139")
    assert mapping["10.1.2.3"].startswith("10.") and mapping["Frau Anna Weiß"].split()[1].endswith(tuple(S.SYLLABLES[""][2]["female"])) and mapping["Mr John Smith"].split()[1].endswith(tuple(S.SYLLABLES[""][2]["male"]))
    assert mapping["Г-жа Иванова"].split()[1].endswith(tuple(f"{x}а" for x in S.SYLLABLES["_cyrillic"][2]["family"]))
    assert mapping["Mrs Smith"].split()[1] == mapping["Mr John Smith"].split()[2]
    assert {r.text for r in S.replace(docs, key="other").collect()} != {r.text for r in rows}
    assert S.replace(docs.limit(0)).count() == 0


def test_crowded_formats_stay_distinct(spark):
    values = [(f"{a}@b.co",) for a in "abcdefghijklmnopqrstuvwxyz"] + [(f"9.{i}.{j}.1",) for i in range(30) for j in range(30)]
    rows = S.assign(spark.createDataFrame(values, "value string"), "k").collect()
    old, new = [r.value for r in rows], [r.surrogate for r in rows]
    assert sorted(old) == sorted(v for v, in values) and len(set(new)) == len(new) and not set(old) & set(new)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = S.replace(docs).collect()
    mapping = check({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in rows})
    assert len(mapping) > 30 and sum(r.n_email for r in rows) >= 10


def test_mentions_of_a_name_agree_among_many_names(spark, frame):
    names = [f"{a}{b}{c}" for a in "BCDFGHKLMN" for b in "aeiou" for c in ("rt", "lm")]
    docs = frame([(i, f"Mr {n} and Mr John {n} met Dr {n}; Г-н Иван {x}ов saw Г-жа {x}ов.") for i, (n, x) in enumerate(zip(names, [f"{a}{b}{c}" for a in "БВГДК" for b in "аеиоу" for c in "рлмн"], strict=True))])
    mapping = check({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in S.replace(docs).collect()})
    for n in names:
        assert mapping[f"Mr {n}"].split()[-1] == mapping[f"Mr John {n}"].split()[-1] == mapping[f"Dr {n}"].split()[-1]
    assert len({mapping[f"Mr John {n}"].split()[1] for n in names}) == 1
    assert all(regex.fullmatch(r"[\p{Cyrillic}\- ]+", b) for a, b in mapping.items() if a.startswith("Г"))


def test_international_phones_ipv6_and_bare_names(spark, frame):
    phones = ["+49 30 1234567", "+33 1 42 68 53 00", "+34 912 34 56 78", "+44 20 7946 0958", "+491701234567", "(030) 1234567", "01 42 68 53 00", "912 34 56 78"]
    sixes = ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1", "::1"]
    clean = ["on 05.11.2026 or 01-02-2020", "std::vector and a::b at 12:30:45", "1.5 + 2.25 = 3.75"]
    rows = {r.doc_id: r for r in S.replace(frame(list(enumerate([*phones, *sixes, *clean, "Smith wrote. Mr John Smith came. Smith sat, John left, Smithson stayed."])))).collect()}
    n = len(phones)
    for i, old in enumerate(phones):
        assert rows[i].n_phone == 1 and rows[i].text != old and shape(rows[i].text) == shape(old)
        assert old[0] != "+" or rows[i].text[:2] == old[:2]
    for i, old in enumerate(sixes):
        assert rows[n + i].n_ip == 1 and rows[n + i].text != old and len(rows[n + i].text) == len(old)
    for i, old in enumerate(clean):
        assert rows[n + len(sixes) + i].text == old
    given, family = re.search(r"Mr (\S+) (\S+) came", (last := rows[n + len(sixes) + len(clean)]).text).groups()
    assert last.text == f"{family} wrote. Mr {given} {family} came. {family} sat, {given} left, Smithson stayed." and last.n_person == 1


ONE = {
    "writings": ["Mail Jan.Ok@Mail.org or jan.ok@mail.org", "+49 30 1234567 or (030) 1234567 or +49 (0)30 123 4567", "DE89 3704 0044 0532 0130 00 or DE89370400440532013000", "4111 1111 1111 1111 or 4111-1111-1111-1111"],
}


def test_all_writings_of_an_entity_agree(spark, frame):
    rows = {r.doc_id: r for r in S.replace(frame(list(enumerate(ONE["writings"])))).collect()}
    a, b = rows[0].text[5:].split(" or ")
    assert a.lower() == b and a != b and a[0].isupper() and rows[0].n_email == 2
    digits = [re.sub(r"[^0-9]", "", x) for x in rows[1].text.split(" or ")]
    assert digits[0][2:] == digits[1][1:] == digits[2][3:] != "301234567" and [x[:2] for x in digits] == ["49", "0" + digits[1][1], "49"] and rows[1].n_phone == 3
    a, b = rows[2].text.split(" or ")
    assert a.replace(" ", "") == b != "DE89370400440532013000" and a.startswith("DE") and int(b[4:] + "1314" + b[2:4]) % 97 == 1
    a, b = rows[3].text.split(" or ")
    assert a.replace(" ", "") == b.replace("-", "") != "4111111111111111" and luhn(a) == 0


def test_invalid_accounts_stay_invalid(spark, frame):
    rows = S.replace(frame([(i, f"DE{i:02d} 3704 0044 0532 0130 00") for i in range(97) if i != 89])).collect()
    for r in rows:
        b = r.text.replace(" ", "")
        assert r.n_iban == 1 and int(b[4:] + "1314" + b[2:4]) % 97 != 1


def test_introduced_names_and_family_forms(spark, frame):
    texts = ["My name is John Smith. Smith it is.", "Mr John Brown met John. Contact: Mary Ann", "Г-н Иванов и Г-жа Иванова", "Dear Sir or Madam", "почта иван@пример.рф", "Mr Green, Mrs Smith"]
    rows = {r.doc_id: r for r in S.replace(frame(list(enumerate(texts)))).collect()}
    given, family = re.search(r"name is (\S+) (\S+)\.", rows[0].text).groups()
    assert rows[0].text == f"My name is {given} {family}. {family} it is." and rows[0].n_person == 1 and family != "Smith"
    assert rows[1].text.split()[1] == given == rows[1].text.split()[4].rstrip(".") and rows[1].n_person == 2
    assert given.endswith(tuple(S.SYLLABLES[""][2]["male"]))
    assert re.fullmatch(r"Г-н (\w+) и Г-жа \1а", rows[2].text) and "Иванов" not in rows[2].text
    assert rows[3].text == texts[3]
    assert regex.fullmatch(r"почта \p{Cyrillic}{4}@\p{Cyrillic}{6}\.рф", rows[4].text) and rows[4].text != texts[4]
    assert rows[5].text.split()[-1] == family and rows[5].text.split()[1].rstrip(",") not in (family, "Smith", "Green")


def test_every_entity_passes_the_hint():
    """Strings made from the patterns' own parts: whatever ANY finds, HINT finds."""
    rng, hint, any_ = random.Random(1), regex.compile(S.HINT), regex.compile(S.ANY)
    parts = ["12", "7", "(030)", "+49", " ", "-", ".", "/", ":", "::", "AB", "DE89", "a@b.co", "fe80", "Mr", "Frau ", "Smith", "John", "Dear ", "name is ", "555-3824", "10.1.2.3", "4111", "0"]
    found = 0
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        if any_.search(text):
            found += 1
            assert hint.search(text), text
    assert found > 3000


def brute_counts(text):
    """Entities by type, found one after another."""
    out = dict.fromkeys(S.PATTERNS, 0)
    for value in entities(text):
        out[next((k for k, p in S.PATTERNS.items() if regex.fullmatch(p, value)), "person")] += 1
    return out


def test_counts_and_texts_match_brute_force(spark, frame):
    """Counts by type; texts rebuilt from the table of surrogates and the bare words of names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(frame(list(enumerate(TEXTS, 10_000_000))).select("doc_id", "text"))
    rows, before = {r.doc_id: r for r in S.replace(docs).collect()}, {r.doc_id: r.text for r in docs.collect()}
    values = spark.createDataFrame([(v,) for v in {v for t in before.values() for v in entities(t)}], "value string")
    table = {r.value: r.surrogate for r in S.assign(values, "tidelog").collect()}
    parts = lambda v: regex.sub(rf"^(?:{S._TITLES})\.? ", "", v).split(" ")
    for i, text in before.items():
        assert {k: rows[i][f"n_{k}"] for k in S.PATTERNS} == brute_counts(text)
        if text is None:
            continue
        own = entities(text)
        pieces = [p or "" for p in regex.split(S.ANY, text)]
        people = [v for v in own if regex.fullmatch(S.PATTERNS["person"], v)]
        words = dict.fromkeys((a, b) for v in people for a, b in zip(parts(v), parts(table[v]), strict=True))
        for a, b in words:
            pieces = [regex.sub(rf"(?<![\p{{L}}\p{{N}}]){a}(?![\p{{L}}\p{{N}}])", b, p) for p in pieces]
        assert rows[i].text == "".join(x for pair in zip(pieces, [*(table[v] for v in own), ""], strict=True) for x in pair)
