"""PII surrogates, in DataFrame operations only.

Detected entities (mail addresses, IPv4 and IPv6 addresses, bank, card and social
security numbers, phone numbers, persons after a title or a phrase that
introduces one) are replaced by keyed surrogates of the same type and format:
letters of the same script for letters and digits for digits in place, an
account's country and the state of its check digits, a phone's country code or
leading zero, a card's first digit and checksum state, an address's first
octet, equal mail domains alike, given names of the same gender and family
names of the same script.

Each mention belongs to a canonical entity: a folded mail address, a phone's
national number, an account or card without its blanks, a name word (a Slavic
family name without the ending of its feminine form). Surrogates are assigned
to canonical entities, then each mention is rendered from its entity's
surrogate in its own writing, so all writings of an entity agree.

A surrogate is a function of key, type and value, so an entity has one in all
documents. The distinct entities (an aggregate with partial sums) are assigned
in rounds: a candidate that is an entity of the corpus, is taken, or is wanted
by several but not by this one first, is drawn anew from the next hash. From
round ``STRETCH`` candidates grow longer, so rounds end however crowded a
format is. Persons are composed of their words: each distinct family word, and
each given word of a gender, has one surrogate word, spelled from syllables
(one more each round, so names are never scarce), none of them a name word of
the corpus. A given word without a gendered title has the gender that titles
give it elsewhere. Texts meet their surrogates by a join on the value, which
Spark may split where a value is hot.

Words of a person's name that stand alone elsewhere in the same document get
the same surrogate words; they are not counted.

Texts are searched once; only those whose hash is that of a text with entities
are looked at again.

Defined results: a null text stays null; texts without entities stay as they
are; repeated rows each get their row; long texts are read whole; an empty
table gives an empty result. Other columns never clash, as only id and text are
read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import drop, settle, within

STRETCH = 8
#: Bits of the bitmap of texts with entities (4 MB).
TEXT_BITS = 1 << 25
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MALE, _FEMALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа")
_TITLES = "|".join(sorted([*_MALE, *_FEMALE, "Dr", "Prof"], key=len, reverse=True))
_HEX = "[0-9A-Fa-f]{1,4}"
#: Full, or shortened by '::' with a digit somewhere ('a::b' is code).
_IPV6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*[0-9])(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\p{{L}}\p{{N}}:])"
#: After a plus sign 7 to 15 digits in any grouping; without one, groups after a leading 0 that are no date, and 3-2-2-2.
_ABROAD = r"(?<![\p{L}\p{N}+])\+[0-9](?:[ .()/-]{0,2}[0-9]){6,14}(?![0-9])"
_HOME = r"(?<![\p{L}\p{N}.,+-])(?=\(?0)(?=(?:[ ()./-]{0,2}[0-9]){7,15}(?![0-9]))(?![0-9]{2}[./-][0-9]{2}[./-](?:[0-9]{4}|[0-9]{2})(?![0-9]|[ ./-][0-9]))(?:\(0[0-9]{1,5}\)|0[0-9]{1,5})(?:[ ./-]{1,2}[0-9]{2,8}){1,6}(?![0-9])"
_TRIPLE = r"(?<![\p{L}\p{N}.,+-])[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}(?![0-9]|[.,][0-9])"
#: Phrases that introduce a name; the name follows after one blank.
_CUES = ("Name:", "name:", "name is", "Contact:", "contact:", "Author:", "author:", "Signed,", "signed,", "Signed by", "signed by", "Dear", "Attn:", "Regards,", "regards,", "Sincerely,", "I am", "Liebe", "Lieber", "heiße", "Cher", "Chère", "appelle", "Estimado", "Estimada", "llamo", "Nombre:", "Nom:", "зовут", "Уважаемый", "Уважаемая")
_INTRODUCED = rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{'|'.join(_CUES)})[ \n])(?!(?:{_TITLES})\b)\p{{Lu}}\p{{Ll}}+ \p{{Lu}}\p{{Ll}}+(?!\p{{L}})"
#: In order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+[\p{L}]{2,}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])|{_IPV6}",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": rf"{_ABROAD}|{_HOME}|{_TRIPLE}|" + r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "person": rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?|{_INTRODUCED}",
}
ANY = "|".join(PATTERNS.values())
#: Without a match of this there is no entity: each pattern holds two digits next to or near each other, an at sign, a colon before a digit or colon, or a title or phrase.
HINT = rf"[0-9][ .()/-]{{0,2}}[0-9]|@|:[0-9A-Fa-f:]|(?=\p{{Lu}})(?<=(?:{_TITLES})\.? |(?:{'|'.join(_CUES)})[ \n])"
#: Syllables that surrogate names are spelled from: openings, middles, and endings by kind.
SYLLABLES = {
    "": (
        "Al Ba Be Ca Da El Fa Ga He Jo Ka La Ma Na Ro Sa".split(), "ba be di do la le li lo ma mi na ne ra ri ta ve".split(),
        {"male": "n d r s k l m t rt lf ns rd st nd ck x".split(), "female": "na la ra da ta sa ia ina ela ora ette isa ana ena ya va".split(), "family": "mann son ler ner witz berg stein field ton ham ley ford wood dale mer sen".split()},
    ),
    "_cyrillic": (
        "Ал Ба Ве Га Да Ел За Иг Ка Ла Ма На Ол Ро Са Та".split(), "ба бе ва ве да до ла ле ми мо на не ра ри та то".split(),
        {"male": "н д р с к л м т рт ст нд рд лан ман рий мир".split(), "female": "на ла ра да та са ия ина ела ора иса ана ена ва жа ша".split(), "family": "ков лов нов ров тов дов мов сов лин нин рин тин кин дин мин шин".split()},
    ),
}
_CYRILLIC, _GREEK = "абвгдежзиклмнопр", "αβγδεζηθικλμνξοπ"
#: ITU country codes of one and of two digits; all others have three.
_CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def kind_of(value: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        whole = value.rlike(f"^(?:{pattern})$")
        out = F.when(whole, kind) if out is None else out.when(whole, kind)
    return out.otherwise("person")


def _stream(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that depend on the key and all parts."""
    return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, F.lit(str(k))), 256) for k in range(2)))


def _same_shape(text: str, stream: str) -> str:
    """SQL: letters of the same script for letters, digits for digits, all else as it is."""
    at = "CAST(pmod(i, 128) AS INT) + 1, 1)"
    of = lambda digits, letters: f"substr(translate({stream}, '{digits}', '{letters}'), {at}"
    digit, latin, cyrillic, greek = of("abcdef", "024681"), of("0123456789", "lmnoprstuv"), of("0123456789abcdef", _CYRILLIC), of("0123456789abcdef", _GREEK)
    letter = rf"CASE WHEN c RLIKE '\\p{{IsCyrillic}}' THEN {cyrillic} WHEN c RLIKE '\\p{{IsGreek}}' THEN {greek} ELSE {latin} END"
    return rf"array_join(transform(split({text}, ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN {digit} WHEN c RLIKE '\\p{{Lu}}' THEN upper({letter}) WHEN c RLIKE '\\p{{L}}' THEN {letter} ELSE c END), '')"


def _luhn(text: str) -> str:
    return rf"aggregate(transform(reverse(split(regexp_replace({text}, '[^0-9]', ''), '')), (c, i) -> CASE WHEN i % 2 = 0 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END), 0, (a, x) -> a + x)"


def _mod97(account: str) -> str:
    """SQL: the remainder of an account number that the check digits make 1."""
    return f"aggregate(split(concat(substr({account}, 5), substr({account}, 1, 4)), ''), 0, (a, c) -> CASE WHEN c RLIKE '[0-9]' THEN (a * 10 + CAST(c AS INT)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"


def canonical(value: Column, kind: Column) -> Column:
    """What all writings of an entity share."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    national = F.regexp_replace(F.when(value.startswith("+"), F.regexp_replace(digits, f"^(?:{_CODES}|[0-9]{{3}})0?", "")).otherwise(digits), "^0", "")
    return (
        F.when((kind == "email") | (kind == "ip"), F.lower(value)).when(kind == "phone", national).when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.upper(F.regexp_replace(value, " ", ""))).otherwise(value)
    )


def rendered() -> Column:
    """Of (value, kind, canon, surrogate): the surrogate of an entity in the writing of a mention, aligned at the end, with its marks, case, country code or leading zero."""
    behind = "length(regexp_replace(substr(value, i + 1), '[^0-9A-Za-z]', ''))"
    own = "substr(surrogate, length(surrogate) - length(value) + i + 1, 1)"
    sql = rf"""array_join(transform(split(value, ''), (c, i) -> CASE
        WHEN kind IN ('email', 'ip') THEN CASE WHEN c RLIKE '\\p{{Lu}}' THEN upper({own}) ELSE {own} END
        WHEN c RLIKE '[0-9A-Za-z]' AND {behind} <= length(canon) THEN substr(surrogate, length(canon) - {behind} + 1, 1)
        ELSE c END), '')"""
    whole = F.expr("CASE WHEN kind = 'ip' AND (value NOT LIKE '%:%' OR length(surrogate) != length(value)) THEN surrogate END")
    longer = F.expr("CASE kind WHEN 'email' THEN substr(surrogate, 1, length(surrogate) - length(value)) ELSE '' END")
    rest = F.expr("CASE WHEN kind IN ('email', 'ip') THEN '' ELSE substr(surrogate, length(canon) + 1) END")
    return F.coalesce(whole, F.concat(longer, F.expr(sql), rest))


def _names(words: DataFrame, key: str) -> DataFrame:
    """Adds ``surrogate`` to (value, kind, attempt) of name words: an opening, a middle for each attempt and one more, and an ending of the kind."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("name"), "value", F.when(F.col("attempt") > 0, F.col("attempt").cast("string"))), 256)
    words = words.withColumn("digest", digest)
    nibble = lambda i: F.conv(F.substring("digest", i, F.lit(1)), 16, 10).cast("int") + 1
    out = None
    for script, (first, middle, last) in SYLLABLES.items():
        chosen = lambda names, i: F.element_at(F.array(*map(F.lit, names)), nibble(i))
        middles = F.array_join(F.transform(F.sequence(F.lit(2), F.least(F.col("attempt"), F.lit(60)) + 2), lambda i: chosen(middle, i)), "")
        for kind, endings in last.items():
            name = F.concat(chosen(first, F.lit(1)), middles, chosen(endings, F.lit(64)))
            out = F.when(F.col("kind") == kind + script, name) if out is None else out.when(F.col("kind") == kind + script, name)
    return words.select("value", "kind", "attempt", out.alias("surrogate"))


#: The ending that a Slavic family name has in its feminine form only.
_FEMININE = r"(?<=(?:ов|ев|ёв|ин|ын))а$"


def _persons(persons: DataFrame, key: str) -> DataFrame:
    """(value, kind, surrogate) of persons, composed of one surrogate for each distinct name word of a kind."""
    value = F.col("value")
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "_cyrillic").otherwise("")
    words = F.split(value, " ")
    titled = value.rlike(rf"^(?:{_TITLES})\.? ")
    title = F.when(titled, words[0])
    names = F.when(titled, F.slice(words, 2, 2)).otherwise(words)
    bare = F.rtrim(title, F.lit("."))
    gender = F.when(bare.isin(*_FEMALE), "female").when(bare.isin(*_MALE), "male")
    tagged = lambda kind, word: F.concat(kind, F.lit(" "), word)
    family = F.element_at(names, -1)
    parts = persons.select("value", "kind", title.alias("title"), script.alias("script"), gender.alias("gender"), F.when(F.size(names) > 1, names[0]).alias("word"), family.alias("family_word"), tagged(F.concat(F.lit("family"), script), F.regexp_replace(family, _FEMININE, "")).alias("family"))
    parts = settle(parts, "mentions")
    known = parts.where("gender IS NOT NULL AND word IS NOT NULL").groupBy("word").agg(F.min("gender").alias("known"))
    hashed = F.when(F.crc32(F.col("word").cast("binary")) % 2 == 0, "female").otherwise("male")
    parts = parts.join(known, "word", "left").withColumn("given", tagged(F.concat(F.coalesce("gender", "known", hashed), "script"), F.col("word")))
    parts = settle(parts.select("value", "kind", "title", "family_word", "family", "given"), "persons")
    each = parts.select(F.explode(F.array("given", "family")).alias("value")).where("value IS NOT NULL").distinct()
    each = settle(each.select("value", F.substring_index("value", " ", 1).alias("kind")), "words")
    barred = parts.select(F.explode(F.array(F.substring_index("given", " ", -1), F.substring_index("family", " ", -1), F.col("family_word"))).alias("surrogate")).where("surrogate IS NOT NULL").distinct()
    done = _rounds(each, barred, lambda waiting: _names(waiting, key))
    name = lambda c: done.select(F.col("value").alias(c), F.col("surrogate").alias(f"new_{c}"))
    ending = F.when(F.col("family_word").rlike(_FEMININE), "а").otherwise("")
    return parts.join(name("family"), "family").join(name("given"), "given", "left").select("value", "kind", F.concat_ws(" ", "title", "new_given", F.concat("new_family", ending)).alias("surrogate"))


def candidates(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``surrogate`` to (value, kind, attempt) of canonical entities."""
    value, kind = F.col("value"), F.col("kind")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    df = entities.withColumns({
        "stream": _stream(key, kind, value, F.col("attempt").cast("string")),
        "domains": _stream(key, F.lit("domain"), domain),
        "local": local, "host": F.when(kind == "email", F.expr("substr(substring_index(value, '@', -1), 1, length(substring_index(value, '@', -1)) - length(substring_index(substring_index(value, '@', -1), '.', -1)) - 1)")), "top": F.concat(F.lit("."), F.substring_index(domain, ".", -1)),
    })
    df = df.withColumn("shape", F.expr(_same_shape("value", "stream")))
    octet = lambda k: F.conv(F.substring("stream", 2 * k + 1, 2), 16, 10)
    first = F.substring_index(value, ".", 1)
    six = F.expr(r"array_join(transform(split(value, ''), (c, i) -> CASE WHEN i < length(substring_index(value, ':', 1)) THEN c WHEN c RLIKE '[0-9]' THEN substr(translate(stream, 'abcdef', '024681'), CAST(pmod(i, 128) AS INT) + 1, 1) WHEN c RLIKE '[a-f]' THEN substr(translate(stream, '0123456789', 'abcdefabcd'), CAST(pmod(i, 128) AS INT) + 1, 1) ELSE c END), '')")
    six = F.when(F.col("attempt") >= STRETCH, F.regexp_replace(F.substring("stream", 65, 32), "(.{4})(?!$)", "$1:")).otherwise(six)
    is_six = (kind == "ip") & value.contains(":")
    df = df.withColumn("card", F.when(kind == "card", F.expr("concat(substr(value, 1, 1), substr(shape, 2))"))).withColumn("iban", F.when(kind == "iban", F.expr("concat(substr(value, 1, 2), '00', substr(shape, 5))")))
    last = F.expr(f"CAST(pmod(CAST(right(card, 1) AS INT) + {_luhn('value')} - {_luhn('card')}, 10) AS STRING)")
    check = F.expr(f"CASE WHEN {_mod97('value')} = 1 THEN lpad(CAST(98 - {_mod97('iban')} AS STRING), 2, '0') ELSE lpad(CAST(pmod(98 - {_mod97('iban')} + 1 + pmod(crc32(stream), 95), 97) AS STRING), 2, '0') END")
    surrogate = (
        F.when(kind == "email", F.concat(F.expr(_same_shape("local", "stream")), F.lit("@"), F.expr(_same_shape("host", "domains")), "top"))
        .when(is_six, six)
        .when(kind == "ip", F.concat_ws(".", first, octet(0), octet(1), octet(2)))
        .when(kind == "iban", F.concat(F.substring("iban", 1, 2), check, F.expr("substr(iban, 5)")))
        .when(kind == "card", F.concat(F.expr("substr(card, 1, length(card) - 1)"), last))
        .otherwise(F.col("shape"))
    )
    longer = F.when((F.col("attempt") >= STRETCH) & ~is_six, F.translate(F.substring("stream", 100, 12), "abcdef", "024681")).otherwise("")
    return df.select("value", "kind", "attempt", F.when(kind == "email", F.concat(longer, surrogate)).otherwise(F.concat(surrogate, longer)).alias("surrogate"))


def _rounds(values: DataFrame, barred: DataFrame, draw: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(value, kind, surrogate) of settled (value, kind): no surrogate twice, none that is barred."""
    waiting, done = values.withColumn("attempt", F.lit(0)), None
    while True:
        drawn = settle(draw(waiting), "drawn")
        free = drawn.join(barred, "surrogate", "left_anti")
        if done is not None:
            free = free.join(done.select("surrogate"), "surrogate", "left_anti")
        winners = free.groupBy("surrogate").agg(F.min("value").alias("value"))
        won = settle(drawn.join(winners, ["surrogate", "value"]).select("value", "kind", "surrogate"), "won")
        done = won if done is None else done.unionAll(won)
        old, waiting = waiting, settle(drawn.join(won.select("value"), "value", "left_anti").select("value", "kind", (F.col("attempt") + 1).alias("attempt")), "waiting")
        drop(old, drawn)
        if waiting.isEmpty():
            return done


def assign(values: DataFrame, key: str) -> DataFrame:
    """(value, kind, surrogate) of each distinct value: no surrogate of two entities, none that is an entity itself."""
    values = values.select("value", kind_of(F.col("value")).alias("kind"))
    values = settle(values.withColumn("canon", canonical(F.col("value"), F.col("kind"))), "entities")
    others = values.where("kind != 'person'")
    # A name carries its kind, as an account's digits may be a card's.
    entities = settle(others.select(F.concat("kind", F.lit(" "), "canon").alias("value"), "kind").distinct(), "canonical")

    def draw(waiting: DataFrame) -> DataFrame:
        drawn = candidates(waiting.select(F.expr("substr(value, length(kind) + 2)").alias("value"), "kind", "attempt"), key)
        return drawn.select(F.concat("kind", F.lit(" "), "value").alias("value"), "kind", "attempt", F.concat("kind", F.lit(" "), "surrogate").alias("surrogate"))

    done = _rounds(entities, entities.select(F.col("value").alias("surrogate")), draw)
    done = done.select(F.expr("substr(value, length(kind) + 2)").alias("canon"), "kind", F.expr("substr(surrogate, length(kind) + 2)").alias("surrogate"))
    written = others.join(done, ["kind", "canon"]).select("value", "kind", rendered().alias("surrogate"))
    return written.unionAll(_persons(values.where("kind = 'person'").select("value", "kind"), key))


def replace(docs: DataFrame, *, key: str = "tidelog", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the number of its entities of each type, and its text with surrogates."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    entities = F.when(text.rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    some = rows.withColumn("entities", entities).where(F.size("entities") > 0).withColumns({"rid": F.monotonically_increasing_id(), "pieces": F.split("text", ANY, -1)})
    some = settle(some.drop("text"), "found")
    each = some.select("rid", F.posexplode("entities").alias("place", "value"))
    known = assign(each.select("value").distinct(), key)
    named = each.join(known, "value").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "surrogate", "value"))).alias("named"))
    parts = lambda c: F.split(F.regexp_replace(c, rf"^(?:{_TITLES})\.? ", ""), " ")
    pairs = F.array_distinct(F.flatten(F.transform(F.filter("named", lambda x: x["kind"] == "person"), lambda x: F.zip_with(parts(x["value"]), parts(x["surrogate"]), lambda a, b: F.struct(a.alias("old"), b.alias("new"))))))
    alone = lambda piece, n: F.regexp_replace(piece, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), n["old"], F.lit(r"(?![\p{L}\p{N}])")), n["new"])
    bare = F.aggregate(pairs, F.col("pieces"), lambda all_, n: F.transform(all_, lambda piece: alone(piece, n)))
    whole = F.concat(F.array_join(F.zip_with(F.slice("pieces", 1, F.size("named")), F.col("named.surrogate"), lambda a, b: F.concat(a, b)), ""), F.element_at("pieces", -1))
    count = lambda k: F.size(F.filter("named.kind", lambda x: x == k)).cast("long").alias(f"n_{k}")
    changed = some.join(named, "rid").withColumn("pieces", bare).select("doc_id", *map(count, PATTERNS), whole.alias("text"))
    flagged = within(rows, some, F.col("hash"), TEXT_BITS)
    same = flagged.where(~F.col("flag") | ~F.coalesce(F.size(entities) > 0, F.lit(False))).select("doc_id", *(F.lit(0).cast("long").alias(f"n_{k}") for k in PATTERNS), "text")
    return changed.unionAll(same)
